"""What a preview reads, at its default places or others: checked and hashed before anything runs, and again after."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators.validate import key_problems
from weftline.plans import preview
from weftline.sources.readers import SECTION_KEYS

#: Where the inputs of a repository stand, and the codes that a run ends with.
PLACES = {
    "package": "artifacts/change_packages/latest_change_summary.json",
    "document": "artifacts/summaries/base_updated_summary.md",
    "skeleton": "artifacts/skeletons/base_skeleton.json",
}
OK, INVALID, STALE, CHANGED, NO_GENERATOR = range(5)
VERSIONS = ("1", "2", "3")


class InputError(RuntimeError):
    """A run can't go on; ``code`` is what it ends with."""

    def __init__(self, message: str, code: int):
        super().__init__(message)
        self.code = code


def skeleton_problem(json: Column) -> Column:
    """Why a skeleton can't be read; null if nothing is wrong."""
    sections = F.from_json(F.get_json_object(json, "$.sections"), "array<string>")
    required = ["section_id", "heading", "level", "path", "order"]
    wrong = F.exists(sections, lambda s: F.size(F.filter(key_problems(s, SECTION_KEYS, required), lambda p: p != "")) > 0)
    return F.when(F.try_parse_json(json).isNull(), "not JSON").when(sections.isNull(), "no sections").when(wrong, "a section lacks a field or has an unknown one")


def load(files: DataFrame, repos: DataFrame, key: str = "repo") -> DataFrame:
    """(key, package, document, skeleton, hashes, problem, code) of each repository; the first problem counts.

    ``files``: key, path, content (bytes).  ``repos``: key, and columns named like ``PLACES`` where an input stands elsewhere (null: where it always does).
    """
    place = lambda r: F.coalesce(F.col(r), F.lit(PLACES[r])) if r in repos.columns else F.lit(PLACES[r])
    wanted = repos.select(key, F.explode(F.array(*(F.struct(F.lit(r).alias("role"), place(r).alias("path")) for r in PLACES))).alias("w")).select(key, "w.*")
    found = wanted.join(files.select(key, "path", "content"), [key, "path"], "left")
    of = lambda r, c: F.max(F.when(F.col("role") == r, c))
    sha = F.when(F.col("content").isNotNull(), F.sha2("content", 256))
    told = found.groupBy(key).agg(*(of(r, F.col("content")).alias(r) for r in PLACES), *(of(r, F.col("path")).alias(f"_{r}") for r in PLACES), F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", sha.alias("sha"))))).alias("hashes"))
    text = lambda r: F.when(F.is_valid_utf8(F.col(r).cast("string")), F.col(r).cast("string"))
    out = told.withColumns({f"_missing_{r}": F.col(r).isNull() for r in PLACES}).withColumns({r: text(r) for r in PLACES})
    json = F.col("package")
    version = F.get_json_object(json, "$.schema_version")
    rules = [
        *((F.col(f"_missing_{r}"), F.concat(F.lit(f"missing {r}: "), f"_{r}"), INVALID) for r in PLACES),
        *((F.col(r).isNull(), F.lit(f"the {r} is no UTF-8"), INVALID) for r in PLACES),
        (F.try_parse_json(json).isNull(), F.lit("the package is no JSON"), INVALID),
        (~F.ltrim(json).startswith("{"), F.lit("the package is no object"), INVALID),
        (version.isNotNull() & ~version.isin(*VERSIONS), F.concat(F.lit("unsupported package version "), version), STALE),
        (skeleton_problem(F.col("skeleton")).isNotNull(), F.concat(F.lit("the skeleton can't be read: "), skeleton_problem(F.col("skeleton"))), INVALID),
    ]
    pick = lambda i: reduce(lambda acc, r: F.when(r[0], r[i]).otherwise(acc), reversed(rules), F.lit(None if i == 1 else OK))
    return out.select(key, *PLACES, "hashes", pick(1).cast("string").alias("problem"), pick(2).cast("int").alias("code"))


def changed(before: DataFrame, after: DataFrame, key: str = "repo") -> DataFrame:
    """(key, roles): inputs that differ from what they were; a preview must leave none."""
    rows = before.select(key, F.col("hashes").alias("_b")).join(after.select(key, F.col("hashes").alias("_a")), key)
    differ = F.filter(T.literals(list(PLACES)), lambda r: ~F.col("_b")[r].eqNullSafe(F.col("_a")[r]))
    return rows.select(key, differ.alias("roles")).where(F.size("roles") > 0)


def run(files: DataFrame, repos: DataFrame, key: str = "repo", **options) -> DataFrame:
    """(key, code, problem, hashes, report): the preview of each repository whose inputs are in order; the others say what is wrong."""
    from weftline.session import keep

    loaded = keep(load(files, repos, key), "inputs")
    fine = loaded.where(F.col("code") == OK)
    packages = fine.select(F.col(key).alias("change_id"), F.col(key).alias("doc_id"), F.col("package").alias("json"))
    made = preview.run(packages, fine.select(F.col(key).alias("doc_id"), F.col("document").alias("text")), **options)
    return loaded.select(key, "code", "problem", "hashes").join(made.select(F.col("change_id").alias(key), "report"), key, "left")
