import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from weftline.operators import blocks, context, diff, headings, lines, package, scoring, validate
from weftline.sources import docx, readers, sinks


def rows(df, *columns, order=None):
    out = [tuple(r[c] for c in columns) for r in df.collect()]
    return sorted(out, key=repr) if order is None else sorted(out, key=lambda r: r[order])


DIFF = """diff --git a/x.py b/x.py
--- a/x.py
@@ -1,4 +1,5 @@ def run(self):
 a
-b
+c
+d
\\ No newline at end of file
 e

@@ -10 +12,0 @@ class Old
-gone
diff --git a/y b/y
+not a hunk"""


def test_hunks_and_blocks(spark):
    df = spark.createDataFrame([("c", DIFF)], "id string, diff string")
    assert rows(diff.hunks(df, ["id"]), "old_start", "old_end", "new_start", "new_end", "added", "removed", "change_type", "summary") == [
        (1, 4, 1, 5, 2, 1, "modified", "Modified function run with 2 added and 1 removed lines."),
        (10, 10, 12, None, 0, 1, "deleted", "Deleted 1 lines from class Old."),
    ]
    body = diff.hunk_lines(df, ["id"])
    assert rows(diff.change_blocks(body, ["id", "hunk"]), "hunk", "old_start", "new_start", "new_end", "removed_text", "added_text", "summary") == [
        (1, 2, 2, 3, "b", "c\nd", "Replaced old line 2 with new lines 2–3."),
        (2, 10, None, None, "gone", "", "Deleted old line 10."),
    ]
    assert [r["text"] for r in diff.stored_lines(body, ["id", "hunk"], 1, 5, 5).orderBy("hunk", "pos").collect()] == ["b", "c", "gone"]


def test_greedy_budget_takes_later_shorter_lines(spark):
    text = "@@ -1 +1,3 @@\n+aaaa\n+bbbbbbbbbb\n+cc"
    body = diff.hunk_lines(spark.createDataFrame([("c", text)], "id string, diff string"), ["id"])
    assert rows(diff.stored_lines(body, ["id", "hunk"], 9, 100, 6), "text") == [("aaaa",), ("cc",)]


def test_streams(spark):
    status = spark.createDataFrame([("c", "M\0a b\0R090\0old\0new\0C1\0x\0y\0Q\0z\0")], "id string, output string")
    assert rows(diff.status_stream(status, ["id"]), "pos", "status", "path", "old_path") == [(0, "modified", "a b", None), (1, "renamed", "new", "old"), (2, "added", "y", "x"), (3, "modified", "z", None)]
    counts = spark.createDataFrame([("c", "1\t2\ta\tb\0-\t-\tbin\0" + "3\t4\t\0old\0new\0" + "9\t9\ta\tb\0bad\0")], "id string, output string")
    assert rows(diff.count_stream(counts, ["id"]), "path", "additions", "deletions", "binary", "old_path") == [("a\tb", 9, 9, False, None), ("bin", None, None, True, None), ("new", 3, 4, False, "old")]


def test_symbols_and_innermost(spark):
    source = "class A:\n    def f(self):\n        pass\n\nif True:\n    def hidden():\n        pass\n\nasync def g():\n    def inner():\n        pass\n"
    files = spark.createDataFrame([("p", source), ("q", "def (")], "path string, content string")
    found = diff.python_symbols(files, ["path"])
    assert rows(found, "qualified_name", "kind", "start_line", "end_line", order=2) == [("A", "class", 1, 3), ("A.f", "method", 2, 3), ("g", "async function", 9, 11), ("g.inner", "function", 10, 11)]
    points = spark.createDataFrame([("p", n) for n in (1, 3, 5, 9, 11)], "path string, line int")
    assert rows(diff.innermost(points, found, ["path"], "line", "start_line", "end_line", "qualified_name", "ordinal"), "line", "qualified_name") == [(1, "A"), (11, "g.inner"), (3, "A.f"), (9, "g")]


def test_packages_of_all_versions_agree(spark):
    line = lambda n, t: {"line_number": n, "text": t}
    v2 = {"schema_version": 2, "changed_files": [{"path": "a.py", "status": "modified", "what_changed": [{"old_start_line": 1, "new_start_line": 1, "old_end_line": 1, "new_end_line": 2, "symbols": ["f"], "removed_lines": [line(1, "x")], "added_lines": [line(1, "y"), line(2, "z")]}]}]}
    v3 = {"schema_version": 3, "changed_files": [{"path": "a.py", "change_type": "modified", "what_changed": [{"symbols": ["f"], "change_blocks": [{"old_line_count": 1, "new_line_count": 2, "removed_text": "x", "added_text": "y\nz"}]}]}]}
    empty = {"schema_version": 3, "changed_files": [{"path": "a.py", "what_changed": [{"change_blocks": [], "added_lines": [line(1, "no")]}]}]}
    v1 = {"changed_files": ["a.py", "b.py"]}
    df = spark.createDataFrame([(n, json.dumps(p)) for n, p in (("v1", v1), ("v2", v2), ("v3", v3), ("empty", empty))] + [("bad", "[")], "id string, json string")
    files = package.files(package.parse_packages(df, ["id"]), ["id"])
    assert rows(files, "id", "path") == [("empty", "a.py"), ("v1", "a.py"), ("v1", "b.py"), ("v2", "a.py"), ("v3", "a.py")]
    assert rows(package.hunks(files, ["id"]), "id", "removed_lines", "added_lines") == [("empty", [], []), ("v2", ["x"], ["y", "z"]), ("v3", ["x"], ["y", "z"])]
    made = package.package(files.where("id = 'v3'").drop("schema_version"), ["id"], F.lit("s"), repository="r").collect()[0]["json"]
    assert json.loads(made)["schema_version"] == 3 and json.loads(made)["changed_files"][0]["path"] == "a.py"


MARKDOWN = """intro
# Top
text one. E.g. this stays. Is `a. B` code? Yes.
## Sub
- item `x`
  continued
- `src/a.py`
```
# not a heading
~~~
```
<!-- UPDATE_START -->
generated
<!-- UPDATE_END -->
| t |
> q
# Top
"""


def test_sections_and_blocks(spark):
    df = spark.createDataFrame([("d", MARKDOWN)], "doc_id string, text string")
    found = rows(lines.sections(df, ["doc_id"]), "order", "section_id", "level", "parent_id", "path", order=0)
    # Here any fence line toggles, so the last heading stands inside one; the block scanner wants the same mark.
    assert found == [(1, "top", 1, None, "Top"), (2, "top-sub", 2, "top", "Top > Sub")]
    sections, own = blocks.block_index(df, ["doc_id"])
    assert rows(sections, "order", "section_id", "level", order=0) == [(1, "preamble", 0), (2, "top", 1), (3, "top-sub", 2), (4, "top-2", 1)]
    kinds = [r["block_type"] for r in own.orderBy("ordinal").collect()]
    assert kinds == ["paragraph", "paragraph", "unordered_list_item", "unordered_list_item", "code_block", "html_comment", "paragraph", "html_comment", "table", "blockquote"]
    flags = {r["block_text"]: (r["patchable"], r["generated"], r["structural_inventory"]) for r in own.collect()}
    assert flags["- `src/a.py`"] == (False, False, True) and flags["generated"] == (False, True, False) and flags["- item `x`\n  continued"][0]
    assert all(MARKDOWN[r["start"] : r["end"]] == r["block_text"] for r in own.collect())
    sentences = [r["text"] for r in blocks.sentence_rows(own, ["doc_id"]).where("block_id like 'top-paragraph%'").orderBy("sentence_order").collect()]
    assert sentences == ["text one.", "E.g. this stays.", "Is `a. B` code?", "Yes."]


@pytest.mark.parametrize(
    ("text", "want"),
    [("One. Two! Three? four", ["One.", "Two!", "Three? four"]), ("See fig. 3. Next.", ["See fig. 3.", "Next."]), ('He said "Go." Then', ['He said "Go."', "Then"]), ("J. Smith v1.5 x", ["J. Smith v1.5 x"]), ("", [])],
)
def test_sentences_two_ways(spark, text, want):
    assert [text[s:e] for s, e in blocks.sentence_spans(text)] == want
    assert spark.createDataFrame([(text,)], "t string").select(blocks.sentences_native(F.col("t")).alias("s")).collect()[0]["s"] == want


def test_unique_slugs_with_natural_collisions(spark):
    df = spark.createDataFrame([("d", i, s) for i, s in enumerate(["x", "x-2", "x", "x", "x-2"])], "doc string, pos int, b string")
    assert rows(lines.unique_slugs(df, ["doc"], "b"), "pos", "section_id", order=0) == [(0, "x"), (1, "x-2"), (2, "x-3"), (3, "x-4"), (4, "x-2-2")]


def test_insert_under_heading(spark):
    df = lines.explode_lines(spark.createDataFrame([("d", "# A\na\n## B\nb\n# C\nc")], "doc string, text string"), ["doc"])
    got = lambda h: rows(lines.insert_under_heading(df, ["doc"], h, ["NEW"]), "text", "inserted")
    assert got("a:") == [("# A\na\n## B\nb\nNEW\n# C\nc", True)] and got("C") == [("# A\na\n## B\nb\n# C\nc\nNEW", True)] and got("none")[0][1] is False


def test_scores_sum_and_confidence(spark):
    signals = scoring.change_signals(
        spark.createDataFrame([("c", 0, "src/router.py", None), ("c", 1, "tests/test_router.py", None)], "id string, ordinal int, path string, old_path string"),
        spark.createDataFrame([("c", 0, 0, ["route"], "Modified lines.", ["use the router"], ["old path"])], "id string, ordinal int, hunk int, symbols array<string>, summary string, added_lines array<string>, removed_lines array<string>"),
        spark.createDataFrame([("c", "2 files")], "id string, summary string"),
        ["id"],
    ).withColumn("doc", F.lit("d"))
    assert signals.collect()[0]["category_weights"] == {"automation_pipeline": 1.0, "testing": 0.35}
    text = "# T\n## Router\nThe router in src/router.py calls route.\n## Tests\nWe use pytest.\n## Other\nnothing"
    catalog = scoring.catalog(lines.sections(spark.createDataFrame([("d", text)], "doc string, text string"), ["doc"]), ["doc"])
    assert rows(catalog, "heading") == [("Other",), ("Router",), ("Tests",)]
    ranked = scoring.route(signals, catalog, ["id"], ["doc"]).orderBy("rank").collect()
    assert ranked[0]["heading"] == "Router" and all(r["score"] == sum(r["score_breakdown"].values()) for r in ranked)
    assert ranked[0]["score_breakdown"]["explicit_path"] == 15.0 and "src/router.py" in ranked[0]["matched_signals"]
    assessed = scoring.assess(scoring.route(signals, catalog, ["id"], ["doc"]), ["id"]).collect()[0]
    assert assessed["strength"] == "strong" and not assessed["ambiguous"] and assessed["confidence"] >= 0.6
    decided = scoring.decide(scoring.assess(scoring.route(signals, catalog, ["id"], ["doc"]), ["id"]).withColumn("doc", F.lit("d")), catalog, ["id"], ["doc"]).collect()[0]
    assert decided["action"] == "update_section" and decided["section_id"] == ranked[0]["section_id"]


def test_placement_prefers_specific_evidence(spark):
    base = spark.createDataFrame([("d", 0, "The pipeline is tested."), ("d", 1, "The loader calls run_job. It reads src/load.py.")], "doc string, block_order int, text string")
    change = spark.createDataFrame([("d", ["run_job"], ["src/load.py"], ["load"], ["reads"], ["calls"], ["job"], [], ["testing"])], "doc string, symbols array<string>, paths array<string>, modules array<string>, removed array<string>, added array<string>, hunk array<string>, summary array<string>, change_categories array<string>")
    scored = scoring.placement_scores(change.join(base, "doc")).withColumn("candidate_id", F.col("block_order").cast("string"))
    best = scored.orderBy(F.col("score").desc()).collect()[0]
    assert best["block_order"] == 1 and best["score_breakdown"]["symbol_match"] == 16.0 and "module_match" not in best["score_breakdown"]
    short = scoring.top(scored, ["doc"], [F.col("score").desc(), F.col("block_order")])
    placed = scoring.place(short, spark.createDataFrame([("d", ["run_job"])], "doc string, signals array<string>"), ["doc"]).collect()[0]
    assert placed["recommendation"] == "use_existing_candidate" and placed["candidate_id"] == "1" and not placed["ambiguous"]


def test_validators(spark):
    one = lambda column, **v: spark.createDataFrame([tuple(v.values())], ", ".join(f"{k} string" for k in v)).select(column.alias("x")).collect()[0]["x"]
    good = "# T\n" + "".join(f"## S{i}\n" + "words that say something here " * 5 + "\n" for i in range(5))
    assert one(validate.summary_problems(F.col("t")), t=good) == []
    assert "generic section" in one(validate.summary_problems(F.col("t")), t=good.replace("S1", "Changes"))
    assert one(validate.strict_json_object(F.col("t")), t='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(validate.strict_json_object(F.col("t")), t='x {"a": 1}') is None
    assert one(validate.json_object(F.col("t")), t='x {"a": 1} y') == '{"a": 1}'
    for raw, want in (("0.5", 0.5), ("1", 1.0), ("1.4", None), ("true", None), ('"0.5"', None), ("null", None)):
        assert one(validate.confidence(F.col("t")), t=f'{{"confidence": {raw}}}') == want
    answer = '{"decision": "d", "section_id": "s", "confidence": 0.9, "reasoning": "r"}'
    assert one(validate.selection_problems(F.col("t"), F.array(F.lit("s"))), t=answer) == []
    assert one(validate.selection_problems(F.col("t"), F.array(F.lit("z"))), t=answer) == ["unlisted section"]
    assert one(validate.mutation_problems(F.col("n"), F.col("o")), n="- new", o="- old") == []
    assert one(validate.mutation_problems(F.col("n"), F.col("o")), n="new", o="- old") == ["list marker lost"]
    assert one(validate.grounding_problems(F.col("n"), F.col("c")), n="uses `foo` and 99%", c="has foo") == ["unknown number"]
    assert one(validate.affirms("nlp", F.col("t")), t="We do not use NLP. Fast") is False


def test_context(spark):
    names = ["README.md", "src/app.py", "src/my_token.py", "img.png", "node_modules/x.py", ".env", "bin.py", "requirements.txt"]
    content = lambda n: b"a\0b" if n == "bin.py" else b"# T\n\nWhat it does.\n" if n == "README.md" else b"x" * 7000
    df = spark.createDataFrame([("r", n, content(n)) for n in names], "repo string, path string, content binary")
    found = context.collect(df, ["repo"])
    assert rows(found, "path", "truncated") == [("README.md", False), ("bin.py", False), ("requirements.txt", True), ("src/app.py", True)]
    assert rows(context.description(found, ["repo"]), "description") == [("What it does.",)]
    assert [r["path"] for r in context.prompt_excerpts(found, ["repo"]).orderBy("group", "path").collect()] == ["README.md", "requirements.txt", "src/app.py"]
    summary = context.template_summary(found, ["repo"])
    assert "- `src/app.py`" in summary.collect()[0]["summary"]
    # One short path is all that its modules' section has.
    assert summary.select(validate.summary_problems(F.col("summary")).alias("p")).collect()[0]["p"] == ["section without content"]


DOC = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{}</w:body></w:document>'
STYLES = """<w:styles xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="22"/><w:rFonts w:ascii="Sans"/></w:rPr></w:rPrDefault></w:docDefaults>
<w:style w:styleId="Base"><w:name w:val="Base"/><w:rPr><w:b/></w:rPr></w:style><w:style w:styleId="Kid"><w:name w:val="Kid"/><w:basedOn w:val="Base"/></w:style><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>"""
NUMBERING = """<w:numbering xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl>
<w:lvl w:ilvl="1"><w:start w:val="1"/><w:numFmt w:val="lowerLetter"/><w:lvlText w:val="%1.%2)"/></w:lvl></w:abstractNum><w:num w:numId="5"><w:abstractNumId w:val="0"/></w:num></w:numbering>"""


def paragraph(text, style=None, level=None, bold=False, size=None):
    own = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="5"/></w:numPr>' if level is not None else "")
    run = ("<w:b/>" if bold else "") + (f'<w:sz w:val="{size * 2}"/>' if size else "")
    return f"<w:p><w:pPr>{own}</w:pPr><w:r><w:rPr>{run}</w:rPr><w:t>{text}</w:t></w:r></w:p>"


def test_docx(spark):
    body = paragraph("Title", "H1") + paragraph("inherits", "Kid") + paragraph("one", level=0) + paragraph("in a", level=1) + paragraph("in b", level=1) + paragraph("two", level=0) + paragraph("in a again", level=1)
    body += paragraph("1 Scope:", bold=True, size=14) + "".join(paragraph(f"Plain words of a body sentence number {i}, which goes on.") for i in range(4))
    body += "<w:tbl><w:tr><w:tc><w:p><w:r><w:t> x </w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    file = io.BytesIO()
    with zipfile.ZipFile(file, "w") as z:
        z.writestr("word/document.xml", DOC.format(body))
        z.writestr("word/styles.xml", STYLES)
        z.writestr("word/numbering.xml", NUMBERING)
    parts = docx.parts(spark.createDataFrame([("d", file.getvalue()), ("bad", b"no zip")], "doc_id string, content binary")).cache()
    assert [r["marker"] for r in docx.list_items(parts).orderBy("pos").collect()] == ["1.", "1.a)", "1.b)", "2.", "2.a)"]
    scored = {r["text"]: r for r in docx.analyze(parts).collect()}
    assert scored["Title"]["score"] == 100 and scored["Title"]["predicted_level"] == 1
    assert scored["inherits"]["is_bold"] and scored["inherits"]["font_size"] == 11.0
    assert scored["1 Scope:"]["score"] >= 90 and scored["1 Scope:"]["classification"] == "heading"
    assert scored["Plain words of a body sentence number 1, which goes on."]["classification"] == "normal_content"
    assert parts.where("kind = 'table'").collect()[0]["cells"] == [["x"]]


def test_counters_with_gaps_and_unknown_levels(spark):
    df = spark.createDataFrame([("d", i, lv, 1) for i, lv in enumerate([2, 0, 2, 1, 1, 0])], "doc string, pos int, level int, start int")
    assert [r["counters"] for r in headings.list_counters(df, ["doc"]).orderBy("pos").collect()] == [[1, 1, 1], [1], [1, 1, 1], [1, 1], [1, 2], [2]]


def test_project_configs(spark):
    text = json.dumps({"r": {"project_id": "p", "production_branch": "main", "document_name": "n", "document_location": "l"}})
    configs = readers.project_configs(spark.createDataFrame([(text,)], "json string"))
    assert rows(configs, "repository_name", "project_id") == [("r", "p")]
    with pytest.raises(Exception, match="no configuration for q"):
        readers.resolve_project(spark.createDataFrame([("q",)], "repository_name string"), configs).collect()


def test_publish_is_all_or_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    one, two = spark.range(3), spark.range(5)
    sinks.publish(spark, {"a": one, "b": two}, root)
    assert sinks.current(spark, root, "b").count() == 5
    broken = spark.range(1).select(F.raise_error(F.lit("stop")).alias("x"))
    with pytest.raises(Exception, match="stop"):
        sinks.publish(spark, {"a": two, "b": broken}, root)
    assert sinks.current(spark, root, "a").count() == 3


def test_stream_runs_each_package_once(spark, tmp_path):
    from weftline.streaming.runner import run_packages

    (tmp_path / "in").mkdir()
    seen = []
    for n in range(2):
        (tmp_path / "in" / f"{n}.json").write_text("{}")
        run_packages(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/cp", lambda df, _: seen.append(df.count())).awaitTermination()
    assert seen == [1, 1]


def test_git(spark, tmp_path):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", tmp_path, "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True, text=True).stdout.strip()
    run("init", "-q")
    (tmp_path / "a b.py").write_text("x\n")
    (tmp_path / "old.txt").write_text("same\n" * 9)
    run("add", ".")
    run("commit", "-qm", "1")
    (tmp_path / "a b.py").write_text("y\n")
    (tmp_path / "old.txt").rename(tmp_path / "new.txt")
    run("add", "-A")
    run("commit", "-qm", "2")
    found = readers.git_changes(spark, "HEAD~1", "HEAD", str(tmp_path))
    both = diff.file_changes(diff.status_stream(found["status"], ["change_id"]), diff.count_stream(found["counts"], ["change_id"]), ["change_id"])
    assert rows(both, "path", "status", "old_path", "additions") == [("a b.py", "modified", None, 1), ("new.txt", "renamed", "old.txt", 0)]
    assert rows(diff.hunks(found["diffs"], ["path"]), "path", "added", "removed") == [("a b.py", 1, 1)]


PACKAGE = {
    "schema_version": 3,
    "generated_summary": "1 file(s) changed",
    "changed_files": [
        {
            "path": "src/loader.py",
            "status": "modified",
            "what_changed": [{"hunk_header": "@@ def load_rows", "summary": "Modified function load_rows.", "symbols": ["load_rows"], "change_blocks": [{"old_line_count": 1, "new_line_count": 1, "removed_text": "read csv files", "added_text": "read parquet files"}]}],
        }
    ],
}
DOCUMENT = """# Project
## Overview
A project that loads data.
## Loading
The step `load_rows` in src/loader.py does it. It reads csv files. Nothing else happens.

- `src/loader.py`
## Testing
We use pytest.
"""


def test_preview_from_package_to_sentence(spark):
    from weftline.plans import preview

    packages = spark.createDataFrame([("c", "d", json.dumps(PACKAGE))], "change_id string, doc_id string, json string")
    found = preview.route(packages, spark.createDataFrame([("d", DOCUMENT)], "doc_id string, text string"))
    decided = found["decided"].collect()[0]
    assert decided["section_id"] == "project-loading" and decided["action"] == "update_section" and not decided["ambiguous"] and decided["confidence"] >= 0.6
    best = found["places"].orderBy("rank").collect()[0]
    assert best["candidate_type"] == "sentence" and best["direct"] > 0
    assert found["placed"].collect()[0]["recommendation"] == "use_existing_candidate"


def test_prompts_and_answers(spark):
    from weftline.operators import package as P
    from weftline.operators import prompts

    packages = spark.createDataFrame([("c", json.dumps(PACKAGE)), ("x", json.dumps(PACKAGE))], "id string, json string")
    hunks = P.hunks(P.files(P.parse_packages(packages, ["id"]), ["id"]), ["id"])
    facts = prompts.change_facts(hunks, spark.createDataFrame([("c", ["loader"])], "id string, tokens array<string>"), ["id"])
    assert rows(facts, "facts", "omitted_files", "omitted_hunks")[0] == ("File src/loader.py: Modified function load_rows. load_rows\n- read csv files\n+ read parquet files", 0, 0)
    assert "load_rows" in rows(prompts.evidence_corpus(hunks, ["id"]), "identifiers")[0][0]
    short = spark.createDataFrame([(i, 1, "s1", "One", 9.0, ["a"]) for i in "cx"] + [("c", 2, "s2", "Two", 3.0, ["b"])], "id string, rank int, section_id string, heading string, score double, matched_signals array<string>")
    asked = prompts.selection_prompt(short, spark.createDataFrame([("c", "sum"), ("x", "sum")], "id string, summary string"), ["id"])

    def generate(prompt):
        if "s2" not in prompt:
            raise RuntimeError
        return 'Sure: {"decision": "use", "section_id": "s2", "confidence": 0.8, "reasoning": "r"}'

    answers = prompts.ask(asked, ["id"], generate)
    leaders = spark.createDataFrame([("c", "s1"), ("x", "s1")], "id string, section_id string")
    assert rows(prompts.selected_sections(answers, asked, leaders, ["id"]), "id", "section_id", "source") == [("c", "s2", "generator"), ("x", "s1", "scores")]
    targets = spark.createDataFrame([(i, 1, "t1", "old") for i in "cx"], "id string, rank int, candidate_id string, text string")
    wanted = prompts.patch_prompt(targets, facts, ["id"], ["replace_block", "no_change"])
    answer = '{"schema_version": 1, "operation": "replace_block", "target_id": "t1", "new_text": "new", "confidence": %s, "reasoning": "r"}'
    replies = spark.createDataFrame([("c", answer % 0.8), ("x", answer % 0.5)], "id string, answer string")
    assert rows(prompts.planned_patches(replies, wanted, ["id"], ["replace_block", "no_change"]), "id", "status") == [("c", "planned"), ("x", "manual_review")]


def test_skeleton_files(spark):
    section = {"section_id": "a", "heading": "A:", "level": 2, "path": "A", "order": 1}
    load = lambda s: readers.skeletons(spark.createDataFrame([("d", json.dumps(s))], "doc string, json string"), ["doc"])
    found = load({"sections": [section, section | {"section_id": "b", "order": 2}]})
    assert rows(lines.find_by_heading(found, ["doc"], "a"), "section_id") == [("a",)]
    with pytest.raises(Exception, match="unexpected extra"):
        load({"sections": [section | {"extra": 1}]}).collect()
    with pytest.raises(Exception, match="no sections"):
        load({}).collect()
    texts = spark.createDataFrame([("{}",), ("[1]",), ("{",), ('{"schema_version": 9}',), ('{"schema_version": 3}',)], "json string")
    assert [r["status"] for r in readers.supported(texts).collect()] == ["ok", "not_object", "not_json", "bad_version", "ok"]


def test_metadata_and_preference(spark):
    df = spark.createDataFrame([("d", "# A\n## B\n\ntext\n")], "doc string, text string")
    assert rows(lines.content_metadata(df, ["doc"]), "n_chars", "n_lines", "n_titles", "n_sections") == [(15, 4, 1, 1)]
    choices = spark.createDataFrame([("r", "legacy", 2, True), ("r", "canonical", 1, False), ("q", "canonical", 1, True), ("z", "legacy", 2, False)], "repo string, kind string, priority int, valid boolean")
    assert rows(lines.preferred(choices, ["repo"]), "repo", "kind") == [("q", "canonical"), ("r", "legacy")]


def test_skeleton_changes(spark):
    df = spark.createDataFrame([("d", 1, "a", "A", 2, None, "A", None), ("d", 2, "a-2", "A", 2, None, "A", None)], "doc string, order int, section_id string, heading string, level int, parent_id string, path string, content_hash string")
    added = lines.append_section(df, spark.createDataFrame([("d", "A", 2, None)], "doc string, heading string, level int, parent_id string"), ["doc"])
    assert rows(added, "order", "section_id", order=0) == [(1, "a"), (2, "a-2"), (3, "a-3")]
    assert rows(lines.update_section(df, "a", heading="N"), "section_id", "heading", order=0) == [("a", "N"), ("a-2", "A")]
    with pytest.raises(ValueError, match="unknown"):
        lines.update_section(df, "a", nope=1)
    assert rows(lines.best_by_keywords(df, ["doc"], ["a"]), "section_id") == [("a",)]
