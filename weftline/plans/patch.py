"""From places to planned edits: one answer of a generator for each change, checked against all that the change shows.  Nothing is applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import vocabulary as V
from weftline.operators import evidence as E
from weftline.operators import package, prompts, suggestions, validate
from weftline.plans import preview
from weftline.session import keep

APPEND = "append_to_section"


def _candidates(found: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """The first places of each change with their texts."""
    places = found["places"].where(F.col("rank") <= V.PATCH_CANDIDATES)
    return places.select(*keys, "rank", "candidate_id", "candidate_type", "matched_signals").join(found["texts"], [*keys, "candidate_id"])


def _corpus(found: dict[str, DataFrame], candidates: DataFrame, sections: DataFrame, summaries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, corpus): all text that an edit's identifiers, paths, versions and numbers may come from."""
    names = ["paths", "modules", "symbols", "added", "removed", "hunk", "summary"]
    signals = found["evidence"].select(*keys, F.array_join(F.flatten(F.array(*names)), " ").alias("signals"))
    around = F.concat_ws("\n", "text", "parent_text", "previous_excerpt", "next_excerpt")
    shown = candidates.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(around)), "\n").alias("shown"))
    hunks = prompts.evidence_corpus(found["hunks"], keys).select(*keys, F.col("corpus").alias("hunk_text"))
    out = summaries.join(signals, keys, "left").join(shown, keys, "left").join(hunks, keys, "left").join(sections.select(*keys, F.concat_ws("\n", "heading", "path").alias("place")), keys, "left")
    return out.select(*keys, F.concat_ws("\n", "signals", "generated_summary", "place", "shown", "hunk_text").alias("corpus"))


def _field(json: Column, name: str) -> Column:
    return F.get_json_object(json, f"$.{name}")


def planned(packages: DataFrame, documents: DataFrame, found: dict[str, DataFrame], generate=None, least: float = V.MIN_CONFIDENCE, change: str = "change_id", doc: str = "doc_id") -> DataFrame:
    """(change, status, reason, operation, section_id, target_id, target_type, old_text, new_text, list_marker, source_sha256, confidence, reasoning, problems, allowed).

    ``found`` is what ``preview.route`` gives.  Without ``generate`` every change is ``not_invoked``; a change without a section to edit isn't
    asked about.  Only a plan that passed every guard has an edit; its section, target, old text and hash come from the index, never from the answer.
    """
    keys = [change]
    parsed = package.parse_packages(packages, [change, doc])
    candidates = keep(_candidates(found, keys), "candidates")
    found = found | {"hunks": keep(found["hunks"], "hunks")}
    held = found["catalog"].select(doc, "section_id", "heading", "path", F.lit(True).alias("in_index"))
    decided = found["decided"].where("action = 'update_section'").select(change, "section_id")
    sections = parsed.select(change, doc, "generated_summary").join(decided, change, "left").join(held, [doc, "section_id"], "left")
    listed = F.array_sort(F.collect_list(F.struct("rank", "candidate_id", "candidate_type", "text")))
    by_change = candidates.groupBy(change).agg(listed.alias("held"))
    base = sections.join(found["placed"].select(change, "recommendation"), change, "left").join(by_change, change, "left")
    none = F.array().cast(dict(by_change.dtypes)["held"])
    base = base.withColumns({"recommendation": F.coalesce("recommendation", F.lit(APPEND)), "held": F.coalesce("held", none), "in_index": F.coalesce("in_index", F.lit(False))})
    base = base.withColumn("operations", suggestions.allowed_operations(F.col("recommendation"), F.transform("held", lambda x: x["candidate_type"])))

    relevant = E.relevance_tokens(candidates, keys)
    facts = prompts.change_facts(found["hunks"], relevant, keys)
    told = base.where("in_index").select(change, "operations").join(facts, change, "left")
    asked = prompts.patch_prompt(candidates, told.withColumn("facts", F.coalesce("facts", F.lit(""))), keys)
    # A change that shows no candidate still may append to its section.
    bare = told.join(candidates.select(change).distinct(), change, "left_anti").select(change, F.concat(F.lit("Allowed operations: "), F.array_join("operations", ", "), F.lit(". Answer with one JSON object with the keys " + ", ".join(validate.PATCH_KEYS) + ".\n\nFacts:\n\n"), F.coalesce("facts", F.lit(""))).alias("prompt"))
    asked = keep(asked.select(change, "prompt").unionByName(bare), "prompts")
    answers = prompts.ask(asked, keys, generate) if generate is not None else asked.select(change, F.lit(None).cast("string").alias("answer"))

    concrete = E.concrete_evidence(found["files"], found["hunks"], keys)
    lists = [c for c in concrete.columns if c != change]
    empty = F.array().cast("array<string>")
    rows = base.join(answers, change, "left").join(concrete, change, "left").join(_corpus(found, candidates, sections, parsed.select(change, "generated_summary"), keys), change, "left")
    rows = rows.withColumns({c: F.coalesce(c, empty) for c in lists}).withColumn("json", validate.strict_json_object(F.col("answer")))
    rows = rows.withColumn("own", F.get(F.filter("held", lambda x: x["candidate_id"] == _field(F.col("json"), "target_id")), F.lit(0)))
    own_texts, named = F.transform("held", lambda x: x["text"]), {c: F.col(c) for c in lists}
    form = suggestions.answer_problems(F.col("json"), F.col("operations"), F.transform("held", lambda x: x["candidate_id"]), own_texts, named)
    problems = F.array_distinct(F.when(F.col("json").isNull(), T.literals(["not an object"])).otherwise(F.concat(form, suggestions.edit_problems(F.col("json"), F.col("own"), F.col("corpus")))))
    json = F.col("json")
    confidence, reasoning, operation = validate.confidence(json), T.strip(F.coalesce(_field(json, "reasoning"), F.lit(""))), _field(json, "operation")
    rows = keep(rows, "answers").withColumn("problems", F.when(F.col("answer").isNull(), empty).otherwise(problems))
    status, reason = suggestions.patch_status(F.lit(generate is not None), F.col("recommendation"), F.col("in_index"), F.col("answer").isNotNull(), F.col("problems"), operation, confidence, E.no_change_supported(reasoning, own_texts), least)
    rows = rows.withColumns({"status": status, "reason": reason})
    source = documents.select(doc, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("source_sha256"))
    ok = F.col("status") == "planned"
    given = lambda c: F.when(ok, c)
    return rows.join(source, doc, "left").select(
        change,
        "status",
        "reason",
        given(operation).alias("operation"),
        "section_id",
        given(F.col("own.candidate_id")).alias("target_id"),
        given(F.col("own.candidate_type")).alias("target_type"),
        given(F.coalesce("own.text", F.lit(""))).alias("old_text"),
        given(T.strip(F.coalesce(_field(json, "new_text"), F.lit("")))).alias("new_text"),
        given(F.nullif(F.regexp_extract(F.coalesce("own.text", F.lit("")), suggestions.LIST_MARKER, 1), F.lit(""))).alias("list_marker"),
        "source_sha256",
        confidence.alias("confidence"),
        reasoning.alias("reasoning"),
        "problems",
        F.col("operations").alias("allowed"),
    )


def run(packages: DataFrame, documents: DataFrame, generate=None, least: float = V.MIN_CONFIDENCE, choose=None, change: str = "change_id", doc: str = "doc_id") -> DataFrame:
    """Plan edits for change packages (change, doc, json) of documents (doc, text), from routing on."""
    return planned(packages, documents, preview.route(packages, documents, change, doc, choose), generate, least, change, doc)
