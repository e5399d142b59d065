"""Bounded prompts, answers from an injected function, and what becomes of them.

The generator is any callable from text to text; it runs in batches next to the
data, and one that fails or answers nothing gives null, so the deterministic
result stands.  None is shipped: no query needs a network.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import vocabulary as V
from weftline.operators import validate

FACT_FILES, FACT_HUNKS, FACT_LINES, FACT_CHARS, FACT_SYMBOLS, PROMPT_CHARS = 8, 3, 6, 160, 8, 14_000


def change_facts(hunks: DataFrame, relevant: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, facts, omitted_files, omitted_hunks): the files most related to ``relevant`` (keys, tokens) with their first hunks and lines."""
    paths = hunks.select(*keys, "path").distinct().join(relevant, keys, "left")
    overlap = F.coalesce(F.size(F.array_intersect(T.keywords(F.col("path")), F.col("tokens"))), F.lit(0))
    w = Window.partitionBy(*keys)
    ranked = paths.withColumn("file_rank", F.row_number().over(w.orderBy(overlap.desc(), "path"))).withColumn("n_files", F.count("*").over(w)).drop("tokens")
    per_file = Window.partitionBy(*keys, "path")
    rows = hunks.withColumn("hunk_rank", F.row_number().over(per_file.orderBy("hunk"))).withColumn("n_hunks", F.count("*").over(per_file)).join(ranked, [*keys, "path"])
    side = lambda c, mark: F.transform(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, FACT_LINES), lambda x: F.concat(F.lit(mark), F.substring(x, 1, FACT_CHARS)))
    head = F.concat(F.lit("File "), "path", F.lit(": "), F.coalesce("summary", F.lit("")), F.lit(" "), F.array_join(F.slice("symbols", 1, FACT_SYMBOLS), ", "))
    lines = F.concat(F.array(head), side(F.col("removed_lines"), "- "), side(F.col("added_lines"), "+ "))
    shown = (F.col("file_rank") <= FACT_FILES) & (F.col("hunk_rank") <= FACT_HUNKS)
    out = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(shown, F.struct("file_rank", "hunk_rank", lines.alias("lines"))))).alias("r"),
        F.greatest(F.max("n_files") - FACT_FILES, F.lit(0)).alias("omitted_files"),
        F.count_if((F.col("file_rank") <= FACT_FILES) & (F.col("hunk_rank") > FACT_HUNKS)).alias("omitted_hunks"),
    )
    return out.select(*keys, F.array_join(F.flatten(F.transform("r", lambda x: x["lines"])), "\n").alias("facts"), "omitted_files", "omitted_hunks")


def selection_prompt(shortlists: DataFrame, summaries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, prompt, candidates): choose one of the shortlisted sections."""
    one = F.concat_ws(" | ", "section_id", "heading", F.concat(F.lit("score "), F.round("score", 1).cast("string")), F.array_join("matched_signals", ", "))
    rows = shortlists.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", one.alias("t"), F.col("section_id").alias("id")))).alias("r")).join(summaries, keys)
    ask = F.lit('Pick the section that this change affects. Answer with one JSON object with the keys decision, section_id, confidence and reasoning.')
    return rows.select(*keys, F.substring(F.concat_ws("\n", ask, F.lit("Change:"), "summary", F.lit("Sections:"), F.array_join(F.transform("r", lambda x: x["t"]), "\n")), 1, PROMPT_CHARS).alias("prompt"), F.transform("r", lambda x: x["id"]).alias("candidates"))


def patch_prompt(shortlists: DataFrame, facts: DataFrame, keys: list[str], operations: list[str] | None = None) -> DataFrame:
    """(keys, prompt, targets): edit one of the shortlisted texts; without ``operations`` those of the column of ``facts``."""
    one = F.concat_ws("\n", F.concat(F.lit("target "), "candidate_id"), "text")
    rows = shortlists.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", one.alias("t"), F.col("candidate_id").alias("id")))).alias("r")).join(facts, keys)
    allowed = F.array_join("operations", ", ") if operations is None else F.lit(", ".join(operations))
    ask = F.concat(F.lit("Allowed operations: "), allowed, F.lit(". Answer with one JSON object with the keys " + ", ".join(validate.PATCH_KEYS) + "."))
    return rows.select(*keys, F.substring(F.concat_ws("\n\n", ask, F.lit("Facts:"), "facts", F.array_join(F.transform("r", lambda x: x["t"]), "\n\n")), 1, PROMPT_CHARS).alias("prompt"), F.transform("r", lambda x: x["id"]).alias("targets"))


def ask(prompts: DataFrame, keys: list[str], generate: Callable[[str], str | None]) -> DataFrame:
    """(keys, answer): the generator's text for each prompt, null where it fails."""

    def one(prompt: str) -> str | None:
        try:
            return generate(prompt) or None
        except Exception:  # noqa: BLE001 - a generator may fail in any way, and then has no answer
            return None

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({**{k: frame[k] for k in keys}, "answer": [one(p) for p in frame["prompt"]]})

    kinds = dict(prompts.dtypes)
    return prompts.select(*keys, "prompt").mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", answer string")


def selected_sections(answers: DataFrame, prompts: DataFrame, leaders: DataFrame, keys: list[str], least: float = 0.0) -> DataFrame:
    """(keys, section_id, source): the answer's section where it holds, else the deterministic leader's."""
    json = validate.json_object(F.col("answer"))
    rows = leaders.join(prompts.select(*keys, "candidates"), keys, "left").join(answers, keys, "left")
    fine = F.coalesce((F.size(validate.selection_problems(json, F.col("candidates"))) == 0) & (validate.confidence(json) >= least), F.lit(False))
    picked = F.get_json_object(json, "$.section_id")
    return rows.select(*keys, F.when(fine, picked).otherwise(F.col("section_id")).alias("section_id"), F.when(fine, "generator").otherwise("scores").alias("source"))


def planned_patches(answers: DataFrame, prompts: DataFrame, keys: list[str], operations: list[str]) -> DataFrame:
    """(keys, status, operation, target_id, new_text, problems): patches are planned, never applied."""
    json = validate.strict_json_object(F.col("answer"))
    rows = prompts.select(*keys, "targets").join(answers, keys, "left")
    problems = validate.patch_problems(json, T.literals(operations), F.col("targets"))
    get = lambda k: F.get_json_object(json, f"$.{k}")
    status = F.when(F.col("answer").isNull() | (F.size(problems) > 0), "manual_review").otherwise(validate.gate(get("operation"), validate.confidence(json)))
    return rows.select(*keys, status.alias("status"), get("operation").alias("operation"), get("target_id").alias("target_id"), get("new_text").alias("new_text"), problems.alias("problems"))


def evidence_corpus(hunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, corpus, identifiers): what a patch may speak of."""
    text = F.concat_ws("\n", "path", "summary", "hunk_header", F.array_join("symbols", "\n"), F.array_join("added_lines", "\n"), F.array_join("removed_lines", "\n"))
    first = hunks.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "path").orderBy("hunk")))
    names = F.when(F.col("_n") <= FACT_HUNKS, F.concat(F.array("path", T.file_stem(F.col("path"))), F.col("symbols"), F.transform("symbols", lambda s: F.element_at(F.split(s, r"\."), -1))))
    rows = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("path", "hunk", text.alias("t")))).alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(names)))).alias("identifiers"))
    return rows.select(*keys, F.array_join(F.transform("r", lambda x: x["t"]), "\n").alias("corpus"), F.filter("identifiers", lambda x: (x != "") & ~F.lower(x).isin(V.STOP_WORDS)).alias("identifiers"))
