"""Readers for repository trees, git text and JSON files."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every file under a folder, paths relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_replace("path", rf"^(?:file:)?/*\Q{path.rstrip('/').lstrip('/')}\E/", "").alias("path"), "content")


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, json, sha256): whole files, whatever they hold."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("content").cast("string").alias("json"), F.sha2("content", 256).alias("sha256"))


def project_configs(rows: DataFrame, json: str = "json") -> DataFrame:
    """(repository_name, project_id, production_branch, document_name, document_location); an entry without a field raises."""
    fields = ["project_id", "production_branch", "document_name", "document_location"]
    found = F.from_json(json, "map<string,struct<" + ",".join(f"{f}:string" for f in fields) + ">>")
    each = rows.select(F.explode(F.coalesce(found, F.raise_error(F.lit("configuration is no object")))).alias("repository_name", "c"))
    whole = [F.coalesce(F.nullif(F.col(f"c.{f}"), F.lit("")), F.raise_error(F.concat(F.lit(f"no {f} for "), F.col("repository_name")))).alias(f) for f in fields]
    return each.select("repository_name", *whole)


def resolve_project(repositories: DataFrame, configs: DataFrame, name: str = "repository_name") -> DataFrame:
    """Repositories with their configuration; one without raises."""
    out = repositories.join(configs, name, "left")
    return out.withColumn("project_id", F.coalesce("project_id", F.raise_error(F.concat(F.lit("no configuration for "), F.col(name)))))


def git_output(args: list[str], repo: str = ".", timeout: float = 60) -> str:
    """Output of a git command; it raises where git fails."""
    return subprocess.run(["git", "-C", repo, "--literal-pathspecs", *args], capture_output=True, check=True, timeout=timeout, text=True, errors="replace").stdout


def git_changes(spark: SparkSession, before: str, after: str, repo: str = ".", change_id: str = "change") -> dict[str, DataFrame]:
    """One-row tables (change_id, output) of a range's status and count streams, and (change_id, path, diff) of its files."""
    from weftline.operators.diff import status_stream

    run = lambda *a: git_output(["diff", *a, "-M", before, after], repo)
    status, counts = (spark.createDataFrame([(change_id, run(kind, "-z"))], "change_id string, output string") for kind in ("--name-status", "--numstat"))
    files = status_stream(status, ["change_id"]).collect()
    diffs = [(change_id, r["path"], git_output(["diff", "-M", before, after, "--", *filter(None, (r["old_path"], r["path"]))], repo)) for r in files]
    return {"status": status, "counts": counts, "diffs": spark.createDataFrame(diffs, "change_id string, path string, diff string")}


def git_remote(repo: str = ".") -> str | None:
    """The address of a repository's remote, from its own configuration; None where there is none."""
    try:
        return git_output(["config", "--get", "remote.origin.url"], repo, 5).strip() or None
    except (subprocess.SubprocessError, OSError):
        return None


def git_blob(sha: str, path: str, repo: str = ".") -> str:
    """A file's text at a commit; empty where it isn't there."""
    try:
        return git_output(["show", f"{sha}:{path}"], repo)
    except (subprocess.SubprocessError, OSError):
        return ""


def git_package(spark: SparkSession, before: str, after: str, repo: str = ".", change_id: str = "change", **header: str) -> DataFrame:
    """(change_id, json): the change package of a commit range, with hunks, blocks, symbols and summaries; git runs in tasks (``sources.git``)."""
    from weftline.sources import git

    branch, repository = header.pop("branch", "main"), header.pop("repository", repo)
    found = git.read(spark, repo, before=before, after=after, change_id=change_id)
    return git.packages(found, repository, branch, **header).select("change_id", "json")


def blobs(changes: DataFrame, contents: DataFrame, keys: list[str]) -> DataFrame:
    """Changes with file contents; a missing file is empty."""
    return changes.join(contents, keys, "left").withColumn("content", F.coalesce("content", F.lit("")))


SECTION_KEYS = ["section_id", "heading", "level", "parent_id", "path", "order", "content_hash"]


def skeletons(rows: DataFrame, keys: list[str], json: str = "json") -> DataFrame:
    """(keys, section fields) of skeleton files; broken JSON, missing sections and unknown keys raise."""
    from weftline.operators.validate import key_problems

    each = F.from_json(F.get_json_object(json, "$.sections"), "array<string>")
    sections = rows.select(*keys, F.explode(F.coalesce(each, F.raise_error(F.lit("no sections in skeleton")))).alias("s"))
    wrong = F.filter(key_problems(F.col("s"), SECTION_KEYS, ["section_id", "heading", "level", "path", "order"]), lambda p: p != "")
    checked = F.when(F.size(wrong) > 0, F.raise_error(F.concat(F.lit("bad section: "), F.array_join(wrong, ", ")))).otherwise(F.col("s"))
    parsed = F.from_json(checked, "section_id string, heading string, level int, parent_id string, path string, `order` int, content_hash string")
    return sections.select(*keys, parsed.alias("p")).select(*keys, "p.*")


def supported(rows: DataFrame, json: str = "json", versions: tuple[str, ...] = ("1", "2", "3")) -> DataFrame:
    """``rows`` with ``status``: ok, not_json, not_object or bad_version (an absent version is fine)."""
    version = F.get_json_object(json, "$.schema_version")
    status = (
        F.when(F.try_parse_json(F.col(json)).isNull(), "not_json")
        .when(~F.ltrim(json).startswith("{"), "not_object")
        .when(version.isNotNull() & ~version.isin(*versions), "bad_version")
        .otherwise("ok")
    )
    return rows.withColumn("status", status)
