"""Canonical documents: names, paths, checks, and what a push should do about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import vocabulary as V
from weftline.operators import context, validate

VALID, MISSING, INVALID = "existing_valid", "missing", "existing_invalid"


def truthy(setting: Column) -> Column:
    return F.lower(T.strip(F.coalesce(setting, F.lit("")))).isin(V.TRUE_WORDS)


def threshold(setting: Column, default: float = V.MIN_CONFIDENCE) -> Column:
    """A setting's number; the default where it is none."""
    return F.coalesce(T.strip(setting).try_cast("double"), F.lit(default))


def remote_name(url: Column) -> Column:
    """The last part of a remote's address, without ``.git``; null without one."""
    tail = F.regexp_extract(F.regexp_replace(T.strip(F.coalesce(url, F.lit(""))), "/+$", ""), r"([^/:]*)$", 1)
    return F.nullif(T.strip(F.regexp_replace(tail, r"\.git$", "")), F.lit(""))


def repository_name(given: Column, remote: Column, folder: Column) -> Column:
    """From the given full name, else the remote's address, else the folder."""
    last = T.strip(F.element_at(F.split(T.strip(F.coalesce(given, F.lit(""))), "/"), -1))
    return F.coalesce(F.nullif(last, F.lit("")), remote_name(remote), F.nullif(folder, F.lit("")), F.lit(V.DEFAULT_REPOSITORY))


def document_path(name: Column) -> Column:
    """Where a repository's document stands; null if its name leaves nothing that is safe in a path."""
    return F.concat(F.lit(f"{V.DOCUMENT_FOLDER}/"), context.safe_name(name), F.lit(V.DOCUMENT_SUFFIX))


def unsupported_claims(docs: DataFrame, files: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, claims): technologies that a document speaks of and the repository's files don't show."""
    shown = validate.shown_claims(F.col("path"), F.col("content"))
    known = files.groupBy(*keys).agg(F.array_distinct(F.flatten(F.collect_list(shown))).alias("_known"))
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    made = F.filter(T.literals(sorted(V.LIBRARIES)), lambda c: F.rlike(low, F.concat(F.lit(r"(?<![\w-])\Q"), c, F.lit(r"\E(?![\w-])"))))
    return docs.join(known, keys, "left").select(*keys, F.array_except(made, F.coalesce("_known", F.array().cast("array<string>"))).alias("claims"))


def check(documents: DataFrame, keys: list[str], files: DataFrame | None = None) -> DataFrame:
    """(keys, status, exists, problems) of what stands at each canonical path.

    ``documents``: keys, kind (file, folder, link, none) and content (bytes).  With ``files`` (keys, path, content as
    text) claims must be shown by the repository.
    """
    decoded = F.col("content").cast("string")
    readable = F.coalesce(F.is_valid_utf8(decoded), F.lit(True))
    body = F.when(readable, F.coalesce(decoded, F.lit("")))
    rows = documents.select(*keys, "kind", body.alias("text"), readable.alias("readable"))
    if files is not None:
        rows = rows.join(unsupported_claims(rows, files, keys), keys)
    else:
        rows = rows.withColumn("claims", F.array().cast("array<string>"))
    wrong = (
        F.when(F.col("kind") == "none", F.array().cast("array<string>"))
        .when(F.col("kind") != "file", T.literals(["not a regular file"]))
        .when(~F.col("readable"), T.literals(["not UTF-8"]))
        .otherwise(F.concat(validate.summary_problems(F.col("text")), F.transform("claims", lambda c: F.concat(F.lit("unsupported claim: "), c))))
    )
    status = F.when(F.col("kind") == "none", MISSING).when(F.size(wrong) == 0, VALID).otherwise(INVALID)
    return rows.select(*keys, status.alias("status"), (F.col("kind") != "none").alias("exists"), wrong.alias("problems"))


def ci_outputs(status: Column, exists: Column, name: Column, path: Column) -> Column:
    """``key=value`` lines for a build system."""
    flag = lambda c: F.when(c, "true").otherwise("false")
    pairs = {"status": status, "exists": flag(exists), "repository_name": name, "path": path, "filename": T.file_name(path), "is_valid": flag(status == VALID)}
    return F.array_join(F.array(*(F.concat(F.lit(f"{k}="), v) for k, v in pairs.items())), "\n")


def permission(enabled: Column, provider: Column, known: list[str], injected: bool = False) -> tuple[Column, Column]:
    """(allowed, why not) of writing a baseline: enabled and a known provider named, or a generator handed over."""
    if injected:
        return F.lit(True), F.lit(None).cast("string")
    name = F.lower(T.strip(F.coalesce(provider, F.lit(""))))
    why = F.when(~truthy(enabled), "initialisation is not enabled").when(name == "", "no provider is named").when(~name.isin(known), F.concat(F.lit("unknown provider "), name))
    return why.isNull(), why


def push_action(status: Column, allowed: Column, legacy_valid: Column) -> Column:
    """What a push should do: update, ask for review, initialise, go on with the legacy baseline, or wait."""
    return (
        F.when(status == VALID, "incremental_update")
        .when(status == INVALID, "manual_review")
        .when(allowed, "initialize_baseline")
        .when(F.coalesce(legacy_valid, F.lit(False)), "incremental_update_legacy")
        .otherwise("initialization_pending")
    )
