"""The flows of pushes and baselines, and the operators they are made of."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from weftline.functions import vocabulary as V
from weftline.operators import canonical, context, evidence, lines, providers, suggestions
from weftline.operators.providers import Choice
from weftline.plans import baseline, update
from weftline.sources import readers, sinks

BASE = """# Project

## Overview
A project that loads data and summarises it.

## Loading
The step `load_rows` in src/loader.py does it. It reads csv files.

```text
## Loading
```

### Details
More on loading rows.

## Testing
We use pytest for every module.
"""
HUNK = {"hunk_header": "def load_rows", "summary": "Modified function load_rows.", "symbols": ["load_rows"], "change_blocks": [{"old_line_count": 1, "new_line_count": 1, "removed_text": "read csv files", "added_text": "read parquet files"}]}


def package(path="src/loader.py", **more):
    return json.dumps({"schema_version": 3, "repository": "me/repo", "branch": "main", "actor": "someone", "before_sha": "abc", "after_sha": "def", "generated_summary": f"1 file(s) changed: {path}", "changed_files": [{"path": path, "status": "modified", "what_changed": [HUNK]}]} | more)


COPY = BASE + "\nA reviewer's line.\n"
WEAK = {"changed_files": [{"path": "zzz.qq", "status": "added"}], "generated_summary": "", "before_sha": "0000"}


@pytest.fixture(scope="module")
def flow(spark):
    """All cases in one run: (texts by document, results by change, skeleton rows)."""
    packages = [("a1", "a", package()), ("b1", "b", package()), ("b2", "b", package()), ("c1", "c", package("zzz.qq", **WEAK)), ("e1", "e", package()), ("f1", "f", package()), ("g1", "g", package()), ("g2", "g", package())]
    documents = [("a", BASE, None), ("b", BASE, COPY), ("c", BASE, None), ("e", "no headings here\n\n", None), ("f", BASE, "# Project\n\nOnly this.\n\n"), ("g", BASE, None)]
    frame = spark.createDataFrame(packages, "change_id string, doc_id string, json string")
    docs = spark.createDataFrame(documents, "doc_id string, baseline string, updated string")
    selected = spark.createDataFrame([("g1", "project-testing", 0.9), ("g2", "nowhere", 0.9)], "change_id string, section_id string, confidence double")
    out = update.run(frame, docs, selected=selected, time="2024-01-01 00:00 UTC")
    return {r["doc_id"]: r["text"] for r in out["updated"].collect()}, {r["change_id"]: r for r in out["results"].collect()}, out["skeletons"].collect()


def plain_insert(text, heading, block):
    """The definition, line by line."""
    out, inside, level, at = text.splitlines(), False, None, None
    for i, line in enumerate(out):
        bare = line.lstrip()
        if bare.startswith(("```", "~~~")):
            inside = not inside
        elif not inside and bare.startswith("#"):
            n = len(bare) - len(bare.lstrip("#"))
            if n <= 6 and bare[n:].startswith(" "):
                if level is None:
                    level = n if bare[n:].strip().lower() == heading.lower() else None
                elif n <= level:
                    at = i
                    break
    if level is None:
        return None
    at = len(out) if at is None else at
    joined = "\n".join([*out[:at], "", *block, "", *out[at:]])
    return joined + "\n" * (text.endswith("\n") and not joined.endswith("\n"))


BLOCK = [
    f"<!-- {V.REGION_START} -->",
    "### Automated Change Update - 2024-01-01 00:00 UTC",
    "",
    "Repository: repo",
    "Branch: main",
    "Actor: someone",
    "Before SHA: abc",
    "After SHA: def",
    "",
    "Changed files:",
    "- modified: src/loader.py",
    "",
    "Summary:",
    "1 file(s) changed: src/loader.py",
    f"<!-- {V.REGION_END} -->",
]


def test_update_goes_under_the_section(spark, flow):
    texts, results, skeleton = flow
    assert texts["a"] == plain_insert(BASE, "Loading", BLOCK)
    r = results["a1"]
    assert (r["decision"], r["heading"], r["source"], r["placement"], r["warnings"]) == ("update_existing_section", "Loading", "rules", "under existing section 'Loading'", [])
    assert "clear leader" in r["reason"] and not r["skeleton_changes"] and sum(x["doc_id"] == "a" for x in skeleton) == 5
    kinds = "change_id string, decision string, source string, confidence double, placement string, reason string, warnings array<string>"
    report = update.report(spark.createDataFrame([tuple(r[c.split(" ")[0]] for c in kinds.split(", "))], kinds)).collect()[0]["report"]
    assert "Placement:         under existing section 'Loading'" in report


def test_two_changes_and_the_reviewable_copy(flow):
    once = plain_insert(COPY, "Loading", BLOCK)
    assert flow[0]["b"] == plain_insert(once, "Loading", BLOCK)


def test_weak_changes_go_to_the_overview_and_empty_documents_grow(flow):
    texts, results, skeleton = flow
    assert results["c1"]["heading"] == "Overview" and any("needs review" in w for w in results["c1"]["warnings"]) and any("no before sha" in w for w in results["c1"]["warnings"])
    assert results["e1"]["decision"] == "create_new_section" and results["e1"]["skeleton_changes"]
    assert texts["e"] == "no headings here\n" + "\n".join(["", f"## {V.FIRST_HEADING}", "", *BLOCK, ""]) + "\n"
    assert [r["section_id"] for r in skeleton if r["doc_id"] == "e"] == ["system-overview"]


def test_a_section_that_the_copy_lacks_and_a_generators_choice(flow):
    texts, results, _ = flow
    assert texts["f"] == "# Project\n\nOnly this.\n\n" + "\n".join(BLOCK) + "\n" and results["f1"]["placement"].startswith("appended to end")
    assert (results["g1"]["heading"], results["g1"]["source"]) == ("Testing", "generator") and (results["g2"]["heading"], results["g2"]["source"]) == ("Loading", "rules")


def test_ids_of_duplicate_headings_match_in_turn(spark):
    text = "# A\n## X\none\n## X\ntwo\n## New\n## X\nthree\n"
    own = lines.sections(spark.createDataFrame([("d", text)], "doc_id string, text string"), ["doc_id"])
    skeleton = spark.createDataFrame([("d", 1, "root", "A"), ("d", 2, "first", "A > X"), ("d", 3, "a-new", "A > X")], "doc_id string, `order` int, section_id string, path string")
    found = lines.match_ids(own, skeleton, ["doc_id"]).orderBy("order").select("section_id", "content").collect()
    assert [tuple(r) for r in found] == [("root", ""), ("first", "one"), ("a-new", "two"), ("a-new-2", ""), ("a-x", "three")]


def one(spark, column, **values):
    kinds = {k: "array<string>" if isinstance(v, list) else "string" for k, v in values.items()}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in kinds.items())).select(column.alias("x")).collect()[0]["x"]


def test_evidence(spark):
    files = spark.createDataFrame([("c", 0, "src/loader.py", "src/reader.py", "renamed"), ("c", 1, "old.py", None, "deleted"), ("c", 2, "data.md", None, "added")], "id string, ordinal int, path string, old_path string, status string")
    hunks = spark.createDataFrame([("c", 0, 0, ["Loader.load_rows", "update"]), ("c", 0, 3, ["late"])], "id string, ordinal int, hunk int, symbols array<string>")
    e = evidence.concrete_evidence(files, hunks, ["id"]).collect()[0].asDict()
    assert e["paths"] == ["data.md", "old.py", "src/loader.py", "src/reader.py"] and e["renamed_old"] == ["reader", "reader.py"]
    assert e["identifiers"] == ["Loader.load_rows", "data.md", "load_rows", "loader", "loader.py", "old", "old.py", "reader", "reader.py"]
    assert e["deleted"] == ["old", "old.py"] and e["added"] == ["data.md"] and e["modified"] == []
    names = [k for k in e if k != "id"]
    of = {k: F.col(k) for k in names}
    claims = lambda text: one(spark, evidence.claim_problems(F.col("t"), of), t=text, **{k: e[k] for k in names})
    assert claims("The loader.py step reads rows.") == []
    assert claims("A better change of documents.") == ["no concrete evidence"]
    assert claims("The project uses old.py.") == ["deleted shown as active"] and claims("It no longer uses old.py.") == []
    assert claims("data.md was removed.") == ["added shown as removed"]
    assert claims("reader.py reads rows.") == ["old name shown as current"] and claims("reader.py was renamed.") == []
    backed = lambda reason, texts: one(spark, evidence.reasoning_supported(F.col("r"), F.col("c"), of), r=reason, c=texts, **{k: e[k] for k in names})
    assert backed("It names load_rows.", []) and backed("Parquet is read.", ["We read parquet here"]) and not backed("Relevant for people.", ["We read parquet"]) and not backed("x", ["a"] * 3 + ["x marks"])
    unchanged = lambda reason, texts: one(spark, evidence.no_change_supported(F.col("r"), F.col("c")), r=reason, c=texts)
    assert unchanged("rows are read", ["all rows"]) and not unchanged("it is so", ["it is so"])
    assert one(spark, evidence.names_in_order(F.col("a"), F.col("b")), a=["x", "y"], b=["y", "z"]) == ["x", "y", "z"]
    assert one(spark, evidence.has_evidence(F.col("a"), F.col("b")), a=[], b=["z"]) and not one(spark, evidence.has_evidence(F.col("a")), a=[])


def test_suggestions(spark):
    ids = F.array(F.lit("s1"))
    fine = {"decision": "update_existing_section", "target_section_id": "s1", "confidence": 0.8, "suggested_summary": "Loads parquet files now.", "reasoning": " r "}
    wrong = lambda **more: one(spark, suggestions.suggestion_problems(F.col("t"), ids), t="Sure: " + json.dumps(fine | more))
    assert wrong() == [] and wrong(decision="x") == ["bad decision"] and wrong(confidence=True) == ["bad confidence"] and wrong(target_section_id="s2") == ["unknown section"]
    assert wrong(decision="create_new_section") == ["no heading"] and wrong(decision="create_new_section", target_heading="Changes.") == ["generic heading"] and wrong(decision="create_new_section", target_heading="Storage") == []
    assert wrong(suggested_summary="short") == ["short summary"] and wrong(suggested_summary="The repository was updated.") == ["generic summary"]
    assert one(spark, suggestions.suggestion_problems(F.col("t"), ids), t="none") == ["no JSON object"]
    answers = spark.createDataFrame([("c", json.dumps(fine | {"target_heading": "Wrong"})), ("x", "no")], "id string, answer string")
    sections = spark.createDataFrame([("c", "s1", "Loading"), ("x", "s1", "Loading")], "id string, section_id string, heading string")
    got = suggestions.suggested(answers, sections, ["id"])
    assert [(r["ok"], r["section_id"], r["heading"], r["reasoning"]) for r in got.orderBy("id").collect()] == [(True, "s1", "Loading", "r"), (False, None, None, None)]
    rules = spark.createDataFrame([("c", "update_existing_section", "s9", "Other"), ("x", "update_existing_section", "s9", "Other")], "id string, decision string, section_id string, heading string")
    assert [(r["heading"], r["source"], r["confidence"]) for r in suggestions.or_rules(got, rules, ["id"]).orderBy("id").collect()] == [("Loading", "generator", 0.8), ("Other", "rules", 1.0)]
    operations = lambda verdict, types: one(spark, suggestions.allowed_operations(F.col("v"), F.col("t")), v=verdict, t=types)
    always = ["append_to_section", "no_change_needed", "manual_review_needed"]
    assert operations("append_to_section", ["block"]) == always and operations("use_existing_candidate", ["block", "sentence"]) == ["replace_sentence", "insert_after_sentence", "replace_block", "insert_after_block", *always]


@pytest.mark.parametrize(
    ("change", "want"),
    [
        ({}, "planned"),
        ({"asked": False, "found": False}, "not_invoked"),
        ({"recommendation": "manual_review_needed"}, "manual_review"),
        ({"found": False}, "manual_review"),
        ({"answered": False, "confidence": None}, "manual_review"),
        ({"problems": ["x"]}, "manual_review"),
        ({"confidence": 0.74}, "manual_review"),
        ({"operation": "no_change_needed", "confidence": 0.89}, "manual_review"),
        ({"operation": "no_change_needed", "confidence": 0.95}, "planned"),
        ({"operation": "no_change_needed", "confidence": 0.95, "supported": False}, "manual_review"),
    ],
)
def test_guards_of_a_patch(spark, change, want):
    row = {"asked": True, "recommendation": "use_existing_candidate", "found": True, "answered": True, "problems": [], "operation": "replace_block", "confidence": 0.8, "supported": True} | change
    df = spark.createDataFrame([tuple(row.values())], "asked boolean, recommendation string, found boolean, answered boolean, problems array<string>, operation string, confidence double, supported boolean")
    status, _ = suggestions.patch_status(*(F.col(c) for c in df.columns))
    assert df.select(status.alias("s")).collect()[0]["s"] == want


def test_names_and_checks(spark):
    name = lambda given, remote, folder: one(spark, canonical.repository_name(F.col("a"), F.col("b"), F.col("c")), a=given, b=remote, c=folder)
    assert name("me/repo", "x", "y") == "repo" and name("", "git@host:me/tool.git", "y") == "tool" and name(None, "https://h/me/t2.git/", "y") == "t2" and name(None, "", "dir") == "dir" and name(None, None, "") == V.DEFAULT_REPOSITORY
    path = lambda n: one(spark, canonical.document_path(F.col("n")), n=n)
    assert path("my repo") == "artifacts/summaries/my_repo_TechnicalDocument.md" and path("../x") is None and path("..") is None and path("---") is None
    good = "# T\n" + "".join(f"## S{i}\n" + "words that say something here " * 5 + "\n" for i in range(5))
    docs = [("a", "file", good.encode()), ("b", "none", None), ("c", "link", good.encode()), ("d", "file", b"\xff\xfe"), ("e", "file", b" "), ("f", "file", (good + "It uses deep learning.\n").encode())]
    documents = spark.createDataFrame(docs, "repo string, kind string, content binary")
    files = spark.createDataFrame([("a", "x.py", "import torch")], "repo string, path string, content string")
    found = {r["repo"]: (r["status"], r["problems"]) for r in canonical.check(documents, ["repo"], files).collect()}
    assert found["a"] == ("existing_valid", []) and found["b"] == ("missing", []) and found["c"] == ("existing_invalid", ["not a regular file"]) and found["d"] == ("existing_invalid", ["not UTF-8"])
    assert "empty" in found["e"][1] and found["f"] == ("existing_invalid", ["unsupported claim: deep learning"])
    outputs = one(spark, canonical.ci_outputs(F.col("s"), F.lit(True), F.lit("n"), F.lit("a/b.md")), s="existing_valid")
    assert outputs.split("\n") == ["status=existing_valid", "exists=true", "repository_name=n", "path=a/b.md", "filename=b.md", "is_valid=true"]
    assert one(spark, canonical.threshold(F.col("t")), t=" 0.6 ") == 0.6 and one(spark, canonical.threshold(F.col("t")), t="x") == 0.75
    assert one(spark, canonical.truthy(F.col("t")), t=" Yes") and not one(spark, canonical.truthy(F.col("t")), t="off")


GOOD = "# T\n" + "".join(f"## S{i}\n" + "words that say something here " * 5 + "\n" for i in range(5))


def repositories(spark):
    tree = spark.createDataFrame([(r, n, b"# T\n\nWhat it does.\n" if n == "README.md" else b"x = 1\n") for r in "abcd" for n in ("README.md", "src/summary_router.py", "tests/test_x.py")], "repo string, path string, content binary")
    documents = [("a", "file", GOOD.encode()), ("b", "file", b"bad"), ("c", "none", None), ("d", "none", None)]
    return context.collect(tree, ["repo"]), spark.createDataFrame(documents, "repo string, kind string, content binary")


def test_push_plans(spark):
    _, documents = repositories(spark)
    legacy = spark.createDataFrame([("d", "file", GOOD.encode())], "repo string, kind string, content binary")
    plan = lambda choice: {r["repo"]: r["action"] for r in baseline.push_plan(documents, legacy, ["repo"], choice).collect()}
    assert plan(Choice(None, None, "not enabled")) == {"a": "incremental_update", "b": "manual_review", "c": "initialization_pending", "d": "incremental_update_legacy"}
    assert plan(Choice("deterministic"))["c"] == plan(Choice("deterministic"))["d"] == "initialize_baseline"


def test_initialisation(spark, tmp_path):
    files, documents = repositories(spark)
    status = lambda made: {r["repo"]: (r["status"], r["provider"]) for r in made["results"].collect()}
    results = lambda *a, **k: status({"results": baseline.initialise(documents.where("repo in ('a', 'c')"), files, ["repo"], *a, **k)["results"]})
    assert results(Choice(None, None, "off")) == {"a": ("existing_valid", None), "c": ("initialization_pending", None)}
    made = baseline.initialise(documents, files, ["repo"], Choice("deterministic"))
    assert status(made) == {"a": ("existing_valid", None), "b": ("existing_invalid", None), "c": ("generated_deterministic_fallback", "deterministic"), "d": ("generated_deterministic_fallback", "deterministic")}
    root = f"file://{tmp_path}/out"
    baseline.install(spark, made, root)
    assert {r["repo"] for r in sinks.current(spark, root, "canonical").collect()} == {"c", "d"} and sinks.current(spark, root, "skeletons").where("level = 2").count() == 16
    assert results(Choice("own", lambda prompt: GOOD if "README.md" in prompt else None), force=True) == {"a": ("generated", "own"), "c": ("generated", "own")}
    failing = Choice("own", lambda prompt: "bad")
    assert results(failing)["c"][0] == "generation_failed"
    assert results(failing, allow_fallback=True)["c"] == ("generated_deterministic_fallback", "deterministic")


def test_providers():
    known = {"own": lambda p: "text"}
    assert providers.choose({}, known, "K").deterministic and providers.choose({"K": " OWN "}, known, "K").generate and providers.choose({"K": "x"}, known, "K").why_not == "unknown provider x"
    assert providers.for_initialisation({}, known, "E", "K").why_not == "initialisation is not enabled"
    assert providers.for_initialisation({"E": "true"}, known, "E", "K").why_not == "no provider is named"
    assert providers.for_initialisation({"E": "1", "K": "deterministic"}, known, "E", "K").deterministic and providers.for_initialisation({}, known, "E", "K", known["own"]).name == "injected"

    def broken(prompt):
        raise OSError("please sign in")

    assert providers.with_fallback(Choice("x", broken), lambda p: "other")("p") == "other"
    with pytest.raises(providers.UnavailableError):
        providers.with_fallback(Choice("x", broken), lambda p: "other", strict=True)("p")
    with pytest.raises(providers.OutputError):
        providers.with_fallback(Choice("x", lambda p: " "), lambda p: "other", strict=True)("p")
    assert providers.looks_like_auth_failure("Please sign in") and not providers.looks_like_auth_failure("fine")


def test_packages_from_git(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", tmp_path, "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.py").write_text("class A:\n    def run(self):\n        x = 1\n        return x\n\ndef go():\n    return 2\n")
    (tmp_path / "b.txt").write_text("one\ntwo\n")
    git("add", ".")
    git("commit", "-qm", "1")
    (tmp_path / "a.py").write_text("class A:\n    def run(self):\n        x = 10\n        y = 3\n        return x\n\ndef go():\n    return 5\n")
    (tmp_path / "b.txt").unlink()
    git("add", "-A")
    git("commit", "-qm", "2")
    made = json.loads(readers.git_package(spark, "HEAD~1", "HEAD", str(tmp_path), repository="me/repo").collect()[0]["json"])
    assert made["schema_version"] == 3 and made["generated_summary"] == "2 file(s) changed (1 deleted, 1 modified): a.py, b.txt."
    first, second = made["changed_files"]
    hunk = first["what_changed"][0]
    assert hunk["summary"] == "Modified method A.run with 3 added and 2 removed lines." and hunk["symbols"] == ["A.run", "go"]
    assert [(b["symbols"], b["removed_text"], b["added_text"]) for b in hunk["change_blocks"]] == [(["A.run"], "        x = 1", "        x = 10\n        y = 3"), (["go"], "    return 2", "    return 5")]
    assert second["what_changed"][0]["summary"] == "Deleted 2 lines." and second["what_changed"][0]["change_blocks"][0]["removed_text"] == "one\ntwo"
    assert readers.git_blob("HEAD", "gone", str(tmp_path)) == ""


def test_preview_reports_and_commands(spark, tmp_path):
    from weftline import cli
    from weftline.plans import preview

    docs = spark.createDataFrame([("d", BASE)], "doc_id string, text string")
    packages = spark.createDataFrame([("c1", "d", package()), ("c2", "d", package(schema_version=9)), ("c3", "d", package())], "change_id string, doc_id string, json string")
    override = spark.createDataFrame([("c3", "project-testing")], "change_id string, section_id string")
    made = {r["change_id"]: json.loads(r["report"]) for r in preview.run(packages, docs, override).collect()}
    assert made["c1"]["routing"]["section_id"] == "project-loading" and made["c1"]["placement"]["recommendation"] == "use_existing_candidate" and made["c1"]["candidates"]
    assert made["c2"]["status"] == "bad_version" and "routing" not in made["c2"] and made["c3"]["routing"]["section_id"] == "project-testing"
    (tmp_path / "a.md").write_text(BASE)
    (tmp_path / "p.json").write_text(package())
    at = f"file://{tmp_path}"
    assert cli.run(spark, ["sections", f"{at}/a.md", "--out", f"{at}/sections"]).count() == 5 and spark.read.json(f"{at}/sections").count() == 5
    assert cli.run(spark, ["index", f"{at}/a.md"]).where("block_type = 'code_block'").count() == 1
    assert cli.run(spark, ["check", f"{at}/a.md"]).collect()[0]["status"] == "existing_invalid"
    assert "src/loader.py" in cli.run(spark, ["report", f"{at}/p.json"]).collect()[0]["body"]


def test_index_is_kept_rebuilt_or_created(spark, tmp_path):
    from weftline.operators import package as P
    from weftline.plans import index

    text = "Before.\n\n# A\n## X\nOne here. Two there.\nThird line.\n\n- an item\n\n## X\n```\ncode\n```\n"
    docs = spark.createDataFrame([(i, text, f"{i}.md") for i in "abcde"], "doc_id string, text string, source string")
    skeleton = spark.createDataFrame([("a", 1, "kept", "A > X")], "doc_id string, `order` int, section_id string, path string")
    made = {r["doc_id"]: r["json"] for r in index.build(docs, skeleton).collect()}
    own = json.loads(made["a"])
    assert own["source"]["path"] == "a.md" and own["source"]["size_bytes"] == len(text) and made["a"].replace("a.md", "") != made["b"].replace("b.md", "")
    assert [(s["section_id"], s["heading_path"], len(s["blocks"])) for s in own["sections"]] == [("preamble", ["(preamble)"], 1), ("a", ["A"], 0), ("kept", ["A", "X"], 2), ("a-x", ["A", "X"], 1)]
    assert [s["section_id"] for s in json.loads(made["b"])["sections"]] == ["preamble", "a", "a-x", "a-x-2"]
    first, item = own["sections"][2]["blocks"]
    assert [(s["text"], s["start_line"], s["end_line"]) for s in first["sentences"]] == [("One here.", 5, 5), ("Two there.", 5, 5), ("Third line.", 6, 6)]
    assert all(text[s["source_start_offset"] : s["source_end_offset"]] == s["text"] for b in (first, item) for s in b["sentences"])
    assert item["sentences"][0]["text"] == "an item" and text[item["source_start_offset"] : item["source_end_offset"]] == "- an item"
    stored = spark.createDataFrame([("a", made["a"]), ("b", "{"), ("c", made["c"].replace("c.md", "z.md")), ("d", json.dumps({"schema_version": 9, "source": {}, "sections": []}))], "doc_id string, json string")
    found = {r["doc_id"]: (r["status"], r["json"]) for r in index.ensure(docs, stored, skeleton).collect()}
    assert {k: v[0] for k, v in found.items()} == {"a": "current", "b": "rebuilt", "c": "rebuilt", "d": "rebuilt", "e": "created"} and all(found[k][1] == made[k] for k in "abcde")
    assert one(spark, P.schema_version(F.col("t")), t='{"schema_version": 3}') == 3 and one(spark, P.schema_version(F.col("t")), t='{"schema_version": "x"}') is None
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    assert readers.git_remote(str(tmp_path)) is None
    subprocess.run(["git", "-C", str(tmp_path), "config", "remote.origin.url", "git@host:me/tool.git"], check=True)
    assert one(spark, canonical.remote_name(F.col("t")), t=readers.git_remote(str(tmp_path))) == "tool"
