"""Planned edits: every guard, in one run."""

import json
import re

import pytest

from tests.test_flows import BASE, package
from weftline.plans import index, patch, preview

GOOD = "The step `load_rows` in src/loader.py does it."
#: case: (what its answer has, status, reason, a problem).  ``%`` stands for the case's own path.
CASES = {
    "good": ({}, "planned", "validated, not applied", None),
    "append": ({"operation": "append_to_section", "target_id": None, "new_text": "The function load_rows reads parquet files."}, "planned", "validated, not applied", None),
    "raises": (None, "manual_review", "generator failed", None),
    "words": ("no JSON at all", "manual_review", "answer rejected", "not an object"),
    "two": ('{"a": 1} {"a": 1}', "manual_review", "answer rejected", "not an object"),
    "more": ({"old_text": "x"}, "manual_review", "answer rejected", "unexpected old_text"),
    "version": ({"schema_version": 2}, "manual_review", "answer rejected", "bad version"),
    "operation": ({"operation": "delete_everything"}, "manual_review", "answer rejected", "operation not allowed"),
    "target": ({"target_id": "nobody"}, "manual_review", "answer rejected", "target is no candidate"),
    "surplus": ({"operation": "append_to_section"}, "manual_review", "answer rejected", "target not allowed"),
    "sure": ({"confidence": True}, "manual_review", "answer rejected", "bad confidence"),
    "beyond": ({"confidence": 1.5}, "manual_review", "answer rejected", "bad confidence"),
    "unsure": ({"confidence": 0.5}, "manual_review", "confidence under its bound", None),
    "silent": ({"reasoning": " "}, "manual_review", "answer rejected", "no reasoning"),
    "long": ({"reasoning": "load_rows " * 50}, "manual_review", "answer rejected", "reasoning too long"),
    "empty": ({"new_text": " "}, "manual_review", "answer rejected", "no text"),
    "same": ({"new_text": "OLD"}, "manual_review", "answer rejected", "unchanged"),
    "grown": ({"new_text": "load_rows reads. " * 60}, "manual_review", "answer rejected", "grows too much"),
    "item": ({"new_text": "- load_rows reads parquet files"}, "manual_review", "answer rejected", "becomes a list item"),
    "generic": ({"new_text": "load_rows brings various improvements"}, "manual_review", "answer rejected", "generic text"),
    "heading": ({"new_text": "# load_rows\nreads"}, "manual_review", "answer rejected", "heading"),
    "invented": ({"new_text": "load_rows calls src/other_place.py now."}, "manual_review", "answer rejected", "unknown path"),
    "number": ({"new_text": "load_rows reads 4711 rows."}, "manual_review", "answer rejected", "unknown number"),
    "vague": ({"new_text": "It reads other files than before."}, "manual_review", "answer rejected", "no concrete evidence"),
    "gone": ({"new_text": "The function load_rows was newly added."}, "manual_review", "answer rejected", "modified shown as new"),
    "idle": ({"operation": "no_change_needed", "target_id": None, "new_text": "", "confidence": 0.95, "reasoning": "the step reads csv files already"}, "planned", "validated, not applied", None),
    "shy": ({"operation": "no_change_needed", "target_id": None, "new_text": "", "confidence": 0.8, "reasoning": "the step reads csv files already"}, "manual_review", "confidence under its bound", None),
    "groundless": ({"operation": "no_change_needed", "target_id": None, "new_text": "", "confidence": 0.95, "reasoning": "qqq zzz"}, "manual_review", "reason cites no candidate", None),
    "unreasoned": ({"reasoning": "nice qqqqq zzzzz"}, "manual_review", "answer rejected", "reason without evidence"),
}


def generator():
    cases = CASES

    def generate(prompt):
        name = re.search(r"src/case_([a-z]+)\.py", prompt).group(1)
        change = cases[name][0]
        if change is None:
            raise RuntimeError("no answer")
        if isinstance(change, str):
            return change
        target = re.search(r"^target (\S+)$", prompt, re.M)
        kind = re.search(r"replace_(sentence|block)", prompt)
        old = re.search(r"^target \S+\n(.*)$", prompt, re.M).group(1)
        answer = {"schema_version": 1, "operation": kind.group(), "target_id": target.group(1), "new_text": f"The step `load_rows` in src/case_{name}.py reads parquet files.", "confidence": 0.9, "reasoning": "load_rows reads parquet files now"} | change
        return json.dumps(answer | ({"new_text": old} if answer["new_text"] == "OLD" else {}))

    return generate


@pytest.fixture(scope="module")
def plans(spark):
    packages = spark.createDataFrame([(n, "d", package(f"src/case_{n}.py")) for n in CASES], "change_id string, doc_id string, json string")
    documents = spark.createDataFrame([("d", BASE)], "doc_id string, text string")
    return {r["change_id"]: r for r in patch.run(packages, documents, generator()).collect()}


@pytest.mark.parametrize("name", CASES)
def test_case(plans, name):
    _, status, reason, problem = CASES[name]
    found = plans[name]
    assert (found["status"], found["reason"]) == (status, reason), found["problems"]
    assert problem is None or problem in found["problems"], found["problems"]
    assert (found["operation"] is not None) == (status == "planned")


def test_what_is_planned_comes_from_the_index(plans):
    import hashlib

    good = plans["good"]
    assert good["operation"].startswith("replace_") and good["old_text"] and good["old_text"] in BASE and good["new_text"].endswith("reads parquet files.")
    assert good["source_sha256"] == hashlib.sha256(BASE.encode()).hexdigest() and good["target_type"] in ("sentence", "block") and good["section_id"] == "project-loading"
    assert plans["append"]["target_id"] is None and plans["append"]["old_text"] == ""


def test_without_a_generator_and_without_a_section(spark):
    packages = spark.createDataFrame([("a", "d", package()), ("b", "e", package())], "change_id string, doc_id string, json string")
    documents = spark.createDataFrame([("d", BASE), ("e", "no headings\n")], "doc_id string, text string")
    routed = preview.route(packages, documents)
    assert {r["status"] for r in patch.planned(packages, documents, routed).collect()} == {"not_invoked"}
    found = {r["change_id"]: r for r in patch.planned(packages, documents, routed, lambda p: "{}").collect()}
    assert found["b"]["reason"] == "section not in the index" and found["a"]["reason"] == "answer rejected"


def test_preview_with_a_plan_and_a_stale_index(spark):
    packages = spark.createDataFrame([(n, n, package("src/case_good.py")) for n in ("fresh", "old", "none", "other")], "change_id string, doc_id string, json string")
    documents = spark.createDataFrame([(n, BASE) for n in ("fresh", "old", "none", "other")], "doc_id string, text string")
    stored = index.build(spark.createDataFrame([("fresh", BASE, "s"), ("old", BASE + "\nmore\n", "s")], "doc_id string, text string, source string"))
    stored = stored.unionByName(spark.createDataFrame([("other", '{"schema_version": 9, "source": {}, "sections": []}')], "doc_id string, json string"))
    found = {r["change_id"]: json.loads(r["report"]) for r in preview.run(packages, documents, patch=generator(), index=stored).collect()}
    assert {k: v["status"] for k, v in found.items()} == {"fresh": "ok", "old": "stale index", "none": "no index", "other": "unsupported version"}
    assert found["fresh"]["patch"]["status"] == "planned" and all("patch" not in found[k] and "placement" not in found[k] for k in ("old", "none", "other"))
