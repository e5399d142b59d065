"""Answers of a generator: checked, turned into decisions, and what stands where they don't hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import vocabulary as V
from weftline.operators import evidence as E
from weftline.operators import validate

UPDATE, CREATE = "update_existing_section", "create_new_section"


def _field(json: Column, name: str) -> Column:
    return F.get_json_object(json, f"$.{name}")


def suggestion_problems(answer: Column, section_ids: Column) -> Column:
    """What is wrong with a suggestion (free text around one JSON object) for a document with these sections."""
    json = validate.json_object(answer)
    decision, heading = F.coalesce(_field(json, "decision"), F.lit("")), T.strip(F.coalesce(_field(json, "target_heading"), F.lit("")))
    summary = T.strip(F.coalesce(_field(json, "suggested_summary"), F.lit("")))
    creates = decision == CREATE
    rules = validate.problems(
        {
            "bad decision": ~decision.isin(UPDATE, CREATE),
            "bad confidence": validate.confidence(json).isNull(),
            "unknown section": (decision == UPDATE) & ~F.array_contains(section_ids, F.coalesce(_field(json, "target_section_id"), F.lit(""))),
            "no heading": creates & (heading == ""),
            "generic heading": creates & F.regexp_replace(F.lower(heading), "[.:]+$", "").isin(V.GENERIC_HEADINGS),
            "short summary": F.length(summary) < V.SUMMARY_CHARS,
            "generic summary": summary.rlike(V.GENERIC_SUMMARY),
        }
    )
    return F.when(json.isNull(), T.literals(["no JSON object"])).otherwise(rules)


def suggested(answers: DataFrame, sections: DataFrame, keys: list[str], answer: str = "answer") -> DataFrame:
    """(keys, ok, problems, decision, section_id, heading, confidence, summary, reasoning) of each answer.

    ``sections``: keys, section_id, heading.  The heading of an existing section is its own, whatever the answer says.
    """
    own = sections.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("section_id", "heading"))).alias("_headings"))
    rows = answers.join(own, keys, "left")
    headings = F.coalesce("_headings", F.create_map().cast("map<string,string>"))
    json = validate.json_object(F.col(answer))
    wrong = suggestion_problems(F.col(answer), F.map_keys(headings))
    ok = F.size(wrong) == 0
    updates = _field(json, "decision") == UPDATE
    target = _field(json, "target_section_id")
    heading = F.when(updates, headings[target]).otherwise(T.strip(_field(json, "target_heading")))
    given = lambda c: F.when(ok, c)
    return rows.select(
        *keys,
        ok.alias("ok"),
        wrong.alias("problems"),
        given(_field(json, "decision")).alias("decision"),
        given(F.when(updates, target)).alias("section_id"),
        given(heading).alias("heading"),
        given(validate.confidence(json)).alias("confidence"),
        given(T.strip(_field(json, "suggested_summary"))).alias("summary"),
        given(T.strip(F.coalesce(_field(json, "reasoning"), F.lit("")))).alias("reasoning"),
    )


def or_rules(suggestions: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, decision, section_id, heading, confidence, source): the suggestion where it holds, else what rules decided, whose confidence is 1."""
    held = suggestions.where("ok").select(*keys, *(F.col(c).alias(f"_{c}") for c in ("decision", "section_id", "heading", "confidence")), F.lit(True).alias("_ok"))
    rows = decisions.join(held, keys, "left")
    pick = lambda c, other: F.when(F.col("_ok"), F.col(f"_{c}")).otherwise(other).alias(c)
    return rows.select(*keys, pick("decision", F.col("decision")), pick("section_id", F.col("section_id")), pick("heading", F.col("heading")), pick("confidence", F.lit(1.0)), F.when(F.col("_ok"), "generator").otherwise("rules").alias("source"))


def allowed_operations(recommendation: Column, types: Column) -> Column:
    """Operations that may be chosen, from the placement's verdict and the types of its first candidates."""
    always = T.literals(["append_to_section", "no_change_needed", "manual_review_needed"])
    some = lambda kind: F.when(F.array_contains(types, kind), T.literals([f"replace_{kind}", f"insert_after_{kind}"])).otherwise(F.array().cast("array<string>"))
    return F.when(recommendation == "append_to_section", always).otherwise(F.concat(some("sentence"), some("block"), always))


def patch_status(asked: Column, recommendation: Column, section_found: Column, answered: Column, problems: Column, operation: Column, confidence: Column, supported: Column, least: float = V.MIN_CONFIDENCE) -> tuple[Column, Column]:
    """(status, reason) of a planned patch; the first guard that holds decides.

    No generator; a placement that asks for review; a section that the index lacks; a placement without need of
    change; no answer; an answer with problems; a confidence under its bound; no support for changing nothing.
    """
    changes_nothing = operation == "no_change_needed"
    bound = F.when(changes_nothing, F.greatest(F.lit(V.NO_CHANGE_CONFIDENCE), F.lit(0.0))).otherwise(least)
    guards = [
        (~asked, "not_invoked", "no generator"),
        (recommendation == "manual_review_needed", "manual_review", "placement asks for review"),
        (~section_found, "manual_review", "section not in the index"),
        (recommendation == "no_change_needed", "manual_review", "placement needs no change"),
        (~answered, "manual_review", "generator failed"),
        (F.size(problems) > 0, "manual_review", "answer rejected"),
        (F.coalesce(confidence, F.lit(0.0)) < bound, "manual_review", "confidence under its bound"),
        (changes_nothing & ~supported, "manual_review", "reason cites no candidate"),
    ]
    status, reason = F.lit("planned"), F.lit("validated, not applied")
    for condition, says, why in reversed(guards):
        hit = F.coalesce(condition, F.lit(False))
        status, reason = F.when(hit, says).otherwise(status), F.when(hit, why).otherwise(reason)
    return status, reason


def answer_problems(json: Column, operations: Column, targets: Column, candidates: Column, evidence: dict[str, Column]) -> Column:
    """Problems of a patch answer: its form, what its text claims, and what its reason rests on."""
    edits = ~_field(json, "operation").isin("no_change_needed", "manual_review_needed")
    none = F.array().cast("array<string>")
    claims = F.when(edits, E.claim_problems(_field(json, "new_text"), evidence)).otherwise(none)
    reason = F.when(edits & ~E.reasoning_supported(F.coalesce(_field(json, "reasoning"), F.lit("")), candidates, evidence), T.literals(["reason without evidence"])).otherwise(none)
    return F.concat(validate.patch_problems(json, operations, targets), F.coalesce(claims, none), F.coalesce(reason, none))


#: What an edit may do, and to what.
SENTENCE_EDITS, BLOCK_EDITS = ["replace_sentence", "insert_after_sentence"], ["replace_block", "insert_after_block"]
REPLACEMENTS, WITHOUT_TARGET, WITHOUT_TEXT = ["replace_sentence", "replace_block"], ["append_to_section", "no_change_needed", "manual_review_needed"], ["no_change_needed", "manual_review_needed"]
LIST_MARKER = r"^(\s*(?:[-*+]|\d+[.)])\s+)"


def edit_problems(json: Column, own: Column, corpus: Column) -> Column:
    """Problems of an edit's target and text.  ``own`` is the target (candidate_type, text), null if the answer names none of the candidates."""
    operation, target = F.coalesce(_field(json, "operation"), F.lit("")), _field(json, "target_id")
    new, reason = T.strip(F.coalesce(_field(json, "new_text"), F.lit(""))), F.coalesce(_field(json, "reasoning"), F.lit(""))
    old = F.coalesce(own["text"], F.lit(""))
    replaces, mutates = operation.isin(REPLACEMENTS), ~operation.isin(WITHOUT_TEXT)
    listed = lambda c: c.rlike(LIST_MARKER)
    rules = validate.problems(
        {
            "target not allowed": operation.isin(WITHOUT_TARGET) & target.isNotNull(),
            "target is no candidate": ~operation.isin(WITHOUT_TARGET) & own.isNull(),
            "wrong kind of target": F.coalesce((own["candidate_type"] == "sentence") & operation.isin(BLOCK_EDITS), F.lit(False)) | F.coalesce((own["candidate_type"] == "block") & operation.isin(SENTENCE_EDITS), F.lit(False)),
            "text not allowed": ~mutates & (new != ""),
            "reasoning too long": F.length(reason) > V.REASONING_CHARS,
            "reasoning too short": F.length(T.strip(reason)) < V.LEAST_REASONING_CHARS,
            "no text": mutates & (new == ""),
            "text too long": F.length(new) > V.NEW_TEXT_CHARS,
            "unchanged": replaces & (new == T.strip(old)),
            "grows too much": replaces & (F.length(new) > F.greatest(F.length(old) * 2, F.length(old) + V.GROWTH_CHARS)),
            "list marker lost": replaces & listed(old) & ~listed(new),
            "becomes a list item": replaces & ~listed(old) & listed(new),
            "generic text": mutates & (new.rlike(V.GENERIC_TEXT) | T.any_of(F.contains(F.lower(new), F.lit(p)) for p in V.GENERIC_PHRASES)),
        }
    )
    none = F.array().cast("array<string>")
    return F.concat(rules, F.when(mutates, validate.grounding_problems(new, corpus)).otherwise(none))
