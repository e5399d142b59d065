"""What a text about a change may rest on: the change's own paths, names and symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import vocabulary as V
from weftline.operators.validate import problems

NONE = "array<string>"


def _specific(names: Column) -> Column:
    """Without empty and too broad names."""
    return F.filter(names, lambda x: x.isNotNull() & (x != "") & ~F.lower(x).isin(V.BROAD_TERMS))


def concrete_evidence(files: DataFrame, hunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, paths, identifiers, added, deleted, modified, renamed, renamed_old): a change's specific names, all in order, and by status.

    ``files``: keys, ordinal, path, old_path, status.  ``hunks``: keys, ordinal, hunk, symbols; the first
    ``PATCH_HUNKS`` of a file count.  A dotted symbol also gives its last part.
    """
    names = lambda p: F.array(T.file_name(p), T.file_stem(p))
    none = F.array().cast(NONE)
    old = F.when(F.col("old_path").isNotNull(), _specific(names(F.col("old_path")))).otherwise(none)
    own = files.select(*keys, "ordinal", F.lower(F.coalesce("status", F.lit(""))).alias("status"), F.array_compact(F.array("path", "old_path")).alias("p"), F.concat(_specific(names(F.col("path"))), old).alias("n"), old.alias("o"))
    tail = lambda s: F.when(F.contains(s, F.lit(".")), F.element_at(F.split(s, r"\."), -1))
    first = hunks.where(F.col("hunk") < V.PATCH_HUNKS).groupBy(*keys, "ordinal").agg(F.flatten(F.collect_list("symbols")).alias("s"))
    symbols = _specific(F.coalesce("s", none))
    rows = own.join(first, [*keys, "ordinal"], "left").withColumn("n", F.concat("n", symbols, F.array_compact(F.transform(symbols, tail))))
    of = lambda c, keep=None: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(keep, F.col(c)) if keep is not None else F.col(c)))))
    return rows.groupBy(*keys).agg(of("p").alias("paths"), of("n").alias("identifiers"), *(of("n", F.col("status") == s).alias(s) for s in ("added", "deleted", "modified", "renamed")), of("o").alias("renamed_old"))


def mentioned(text: Column, names: Column) -> Column:
    """Those of ``names`` that stand in a text, whatever their case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(names, lambda x: F.contains(low, F.lower(x)))


def _has_any(low: Column, markers: list[str]) -> Column:
    return T.any_of(F.contains(low, F.lit(m)) for m in markers)


def status_rules(text: Column, evidence: dict[str, Column]) -> dict[str, Column]:
    """Rules on what a text says of files against their status; ``evidence`` has columns as ``concrete_evidence`` names them."""
    low = F.lower(F.coalesce(text, F.lit("")))
    named = lambda k: F.size(mentioned(text, evidence[k])) > 0
    active = low.rlike(r"\b(?:" + "|".join(V.ACTIVE_VERBS) + r")\b")
    removal = _has_any(low, V.REMOVAL_MARKERS)
    current = F.size(mentioned(text, F.array_except(evidence["identifiers"], evidence["renamed_old"]))) > 0
    return {
        "deleted shown as active": named("deleted") & active & ~removal,
        "added shown as removed": named("added") & removal,
        "modified shown as new": named("modified") & _has_any(low, V.ADDITION_MARKERS),
        "old name shown as current": named("renamed_old") & ~current & ~_has_any(low, V.RENAME_MARKERS),
    }


def claim_problems(text: Column, evidence: dict[str, Column]) -> Column:
    """Why a text can't be an edit's: no concrete name of the change in it, or a status denied."""
    cited = F.size(mentioned(text, F.concat(evidence["paths"], evidence["identifiers"]))) > 0
    return problems({"no concrete evidence": ~cited, **status_rules(text, evidence)})


def _distinctive(text: Column, least: int, broad: bool) -> Column:
    return F.filter(T.keywords(text), lambda t: (F.length(t) >= least) & (F.lit(True) if broad else ~t.isin(V.BROAD_TERMS)))


def reasoning_supported(reasoning: Column, candidates: Column, evidence: dict[str, Column]) -> Column:
    """Whether a reason names something of the change, or a distinctive word (five letters) of one of the first candidate texts."""
    cited = F.size(mentioned(reasoning, F.concat(evidence["paths"], evidence["identifiers"]))) > 0
    own = _distinctive(reasoning, 5, False)
    return cited | F.exists(F.slice(candidates, 1, V.PATCH_CANDIDATES), lambda t: F.arrays_overlap(_distinctive(t, 5, False), own))


def no_change_supported(reasoning: Column, candidates: Column) -> Column:
    """Whether a reason to change nothing cites a word of four letters or more of one of the first candidate texts."""
    own = T.keywords(reasoning)
    return F.exists(F.slice(candidates, 1, V.PATCH_CANDIDATES), lambda t: F.arrays_overlap(_distinctive(t, 4, True), own))


def has_evidence(*sets: Column) -> Column:
    """Whether any of a change's token sets holds something."""
    return T.any_of(F.coalesce(F.size(s) > 0, F.lit(False)) for s in sets)


def names_in_order(new: Column, old: Column) -> Column:
    """Names of the new side, then those of the old one, each once."""
    none = F.array().cast(NONE)
    return F.array_distinct(F.concat(F.coalesce(new, none), F.coalesce(old, none)))


def relevance_tokens(places: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, tokens): matched signals and keywords of each change's first candidates (rank, matched_signals, text)."""
    own = F.array_union(F.transform("matched_signals", F.lower), T.keywords(F.col(text)))
    return places.where(F.col("rank") <= V.PATCH_CANDIDATES).groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(own)))).alias("tokens"))
