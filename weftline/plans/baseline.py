"""Baselines: which repositories get a canonical document, what is in it, and how it is put in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import canonical, context, lines, prompts, validate
from weftline.operators.providers import Choice
from weftline.sources import sinks


def push_plan(documents: DataFrame, legacy: DataFrame, keys: list[str], choice: Choice, files: DataFrame | None = None) -> DataFrame:
    """(keys, action, status, problems, legacy_valid): what a push of each repository should do; nothing is written.

    ``documents`` and ``legacy``: keys, kind, content of the canonical and of the old baseline document.
    """
    now = canonical.check(documents, keys, files)
    old = canonical.check(legacy, keys, files).select(*keys, (F.col("status") == canonical.VALID).alias("legacy_valid"))
    rows = now.join(old, keys, "left").withColumn("legacy_valid", F.coalesce("legacy_valid", F.lit(False)))
    action = canonical.push_action(F.col("status"), F.lit(choice.name is not None), F.col("legacy_valid"))
    pending = T.literals([choice.why_not]) if choice.why_not else F.array().cast("array<string>")
    problems = F.when(action == "initialization_pending", pending).otherwise(F.col("problems"))
    return rows.select(*keys, action.alias("action"), "status", problems.alias("problems"), "legacy_valid")


def summaries(files: DataFrame, keys: list[str], choice: Choice, allow_fallback: bool = False) -> DataFrame:
    """(keys, summary, provider, problems): a valid summary of each repository, or none and why.

    ``files``: what ``context.collect`` gives.  A generator's text that breaks a rule gives way to the template only if that is allowed.
    """
    sources = files.select(*keys, "path", F.col("text").alias("content"))

    def judged(rows: DataFrame, name: str) -> DataFrame:
        claims = canonical.unsupported_claims(rows.withColumnRenamed("summary", "text"), sources, keys)
        wrong = F.concat(validate.summary_problems(F.col("summary")), F.transform("claims", lambda c: F.concat(F.lit("unsupported claim: "), c)))
        return rows.join(claims, keys).select(*keys, "summary", F.lit(name).alias("provider"), wrong.alias("problems"))

    template = judged(context.template_summary(files, keys), "deterministic")
    if choice.deterministic or choice.name is None:
        return template.withColumn("summary", F.when(F.size("problems") == 0, F.col("summary")))
    asked = context.prompt_excerpts(files, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("group", "path", "excerpt"))).alias("e"))
    ask = F.lit("Write a Markdown summary of this repository: one title, 4 to 12 sections, no claim that the files don't show.")
    text = F.concat_ws("\n\n", ask, F.array_join(F.transform("e", lambda x: F.concat(F.lit("File: "), x["path"], F.lit("\n"), x["excerpt"])), "\n\n"))
    answers = prompts.ask(asked.select(*keys, text.alias("prompt")), keys, choice.generate)
    own = judged(files.select(*keys).distinct().join(answers, keys, "left").select(*keys, F.col("answer").alias("summary")), choice.name)
    ok = F.size("problems") == 0
    if not allow_fallback:
        return own.withColumn("summary", F.when(ok, F.col("summary")))
    other = template.select(*keys, F.col("summary").alias("_s"), F.col("problems").alias("_p"))
    rows = own.join(other, keys)
    fine = F.size("_p") == 0
    return rows.select(*keys, F.when(ok, F.col("summary")).when(fine, F.col("_s")).alias("summary"), F.when(ok, F.col("provider")).otherwise("deterministic").alias("provider"), F.when(ok, F.col("problems")).otherwise(F.col("_p")).alias("problems"))


def initialise(documents: DataFrame, files: DataFrame, keys: list[str], choice: Choice, allow_fallback: bool = False, force: bool = False, copies: DataFrame | None = None) -> dict[str, DataFrame]:
    """``results`` (keys, status, provider, problems, and the new text's figures) and what is to be written: ``canonical``, ``updated``, ``skeletons``.

    A valid document stays, an invalid one too unless ``force``; a missing one is made if the choice allows it.
    ``copies``: keys of reviewable copies that exist.  These stay, also under ``force``, and a missing one is made
    anew from the document as it then stands.
    """
    sources = files.select(*keys, "path", F.col("text").alias("content"))
    checked = canonical.check(documents, keys, sources)

    def copied(written: DataFrame) -> DataFrame:
        if copies is None:
            return written
        held = F.col("content").cast("string")
        stands = documents.where((F.col("kind") == "file") & F.is_valid_utf8(held)).select(*keys, held.alias("text"))
        return written.unionByName(stands.join(written, keys, "left_anti")).join(copies.select(*keys), keys, "left_anti")

    wanted = F.lit(force) | (F.col("status") == canonical.MISSING)
    if choice.name is None:
        pending = F.when(wanted, "initialization_pending").otherwise(F.col("status"))
        why = F.when(wanted, T.literals([choice.why_not or "no provider"])).otherwise(F.col("problems"))
        nothing = checked.select(*keys, F.lit("").alias("text")).limit(0)
        results = checked.select(*keys, pending.alias("status"), F.lit(None).cast("string").alias("provider"), why.alias("problems"))
        return {"results": results, "canonical": nothing, "updated": copied(nothing), "skeletons": lines.skeleton(lines.sections(nothing, keys), keys)}
    open_ = checked.where(wanted).select(*keys)
    made = summaries(files.join(open_, keys, "left_semi"), keys, choice, allow_fallback)
    text = F.when(F.col("summary").endswith("\n"), F.col("summary")).otherwise(F.concat("summary", F.lit("\n")))
    written = made.where("summary is not null").select(*keys, text.alias("text"))
    status = F.when(~wanted, F.col("status")).when(F.col("summary").isNull(), "generation_failed").when(F.col("provider") == "deterministic", "generated_deterministic_fallback").otherwise("generated")
    own = made.withColumnRenamed("problems", "_p")
    results = checked.join(own, keys, "left").select(*keys, status.alias("status"), F.when(wanted, F.col("provider")).alias("provider"), F.when(wanted, F.coalesce("_p", F.array().cast("array<string>"))).otherwise(F.col("problems")).alias("problems"))
    results = results.join(lines.content_metadata(written, keys), keys, "left")
    return {"results": results, "canonical": written, "updated": copied(written), "skeletons": lines.skeleton(lines.sections(written, keys), keys)}


def install(spark: SparkSession, made: dict[str, DataFrame], root: str) -> str:
    """Put all three outputs in place at once, or none of them."""
    return sinks.publish(spark, {k: made[k] for k in ("canonical", "updated", "skeletons")}, root)
