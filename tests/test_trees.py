"""Trees of headings, styles based on styles, theme fonts, and the command lines over Word files."""

import io
import json
import random
import zipfile

import pytest

from weftline.operators import headings
from weftline.sources import docx

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
SCORED = "doc string, pos int, text string, style_name string, classification string, detection_method string, predicted_level int, score int, signals array<string>"


def scored(doc, pos, text, level=None, how="normal", style="Normal"):
    kinds = {"official": ("heading", "official_word_heading_style"), "heuristic": ("heading", "formatting_heuristic"), "probable": ("probable_heading", "formatting_heuristic"), "normal": ("normal_content", "formatting_heuristic")}
    return (doc, pos, text, style, *kinds[how], level, 90, ["bold:+15"])


def plain_tree(rows):
    """The definition, paragraph by paragraph."""
    out = {"title": "", "headings": [], "unassigned_content": [], "probable_headings": [], "n_warnings": 0, "counts": [0, 0, 0, 0]}
    stack = []
    for _, pos, text, style, kind, method, level, _, _ in rows:
        own = {"id": f"paragraph-{pos}", "text": text, "position": pos, "style": style}
        if style == "Title" and not out["title"]:
            out["title"] = text
            out["unassigned_content"].append(own)
            continue
        official = method == "official_word_heading_style"
        if official or (kind == "heading" and level is not None):
            out["counts"][0 if official else 1] += 1
            if level == 1 and not out["title"]:
                out["title"] = text
            node = {"id": f"heading-{pos}", "title": text, "level": level, "content": [], "children": []}
            while stack and stack[-1]["level"] >= level:
                stack.pop()
            (stack[-1]["children"] if stack else out["headings"]).append(node)
            stack.append(node)
            continue
        if kind == "probable_heading" or kind == "heading":
            out["probable_headings"].append(f"probable-{pos}")
            if kind == "heading":
                out["n_warnings"] += 1
            else:
                out["counts"][2] += 1
        else:
            out["counts"][3] += 1
        if stack:
            stack[-1]["content"].append(own)
        else:
            out["unassigned_content"].append(own)
            out["title"] = out["title"] or text
    out["n_warnings"] += (not out["headings"]) + bool(out["probable_headings"])
    return out


def bare(node):
    return {k: [bare(c) for c in node[k]] if k == "children" else node[k] for k in ("id", "title", "level", "content", "children")}


def test_trees_against_the_definition(spark):
    rng = random.Random(2)
    rows, by = [], {}
    for d in range(40):
        own = []
        for pos in range(rng.randrange(1, 25)):
            how = rng.choice(["official", "heuristic", "heuristic", "probable", "normal", "normal"])
            level = rng.randrange(1, 5) if how == "official" or (how == "heuristic" and rng.random() < 0.8) else None
            own.append(scored(f"d{d}", pos, f'text "{pos}" }}', level, how, "Title" if rng.random() < 0.1 else "Normal"))
        by[f"d{d}"] = own
        rows += own
    found = {r["doc"]: json.loads(r["json"]) for r in headings.document_tree(spark.createDataFrame(rows, SCORED).repartition(3), ["doc"]).collect()}
    assert len(found) == 40
    for d, own in by.items():
        want, got = plain_tree(own), found[d]
        assert got["title"] == want["title"], d
        assert [bare(h) for h in got["headings"]] == want["headings"], d
        assert got["unassigned_content"] == want["unassigned_content"]
        assert [p["id"] for p in got["probable_headings"]] == want["probable_headings"]
        assert len(got["warnings"]) == want["n_warnings"]
        assert list(got["analysis_summary"].values()) == want["counts"]


def test_no_rows(spark):
    assert headings.document_tree(spark.createDataFrame([], SCORED), ["doc"]).count() == 0


def word(styles="", body="", theme=""):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {NS}>{styles}</w:styles>")
        if theme:
            z.writestr("word/theme/theme1.xml", f'<a:theme xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main">{theme}</a:theme>')
    return data.getvalue()


def style(name, based=None, properties=""):
    return f'<w:style w:styleId="{name}"><w:name w:val="{name}"/>' + (f'<w:basedOn w:val="{based}"/>' if based else "") + f"<w:rPr>{properties}</w:rPr></w:style>"


def test_a_chain_of_styles_and_a_circle(spark):
    chain = "".join(style(f"s{i}", f"s{i - 1}" if i else None, '<w:sz w:val="28"/>' if i == 0 else "<w:b/>" if i == 5 else "") for i in range(15))
    circle = style("x", "y", "<w:i/>") + style("y", "x", '<w:rFonts w:ascii="Serif"/>') + style("self", "self", "<w:b/>") + style("lost", "nowhere", "<w:b/>")
    rows = docx.parts(spark.createDataFrame([("d", word(chain + circle)), ("e", word(style("s14", None, '<w:sz w:val="20"/>')))], "doc_id string, content binary"))
    found = {(r["doc_id"], r["style_id"]): r for r in docx.resolved_styles(rows).collect()}
    assert found["d", "s14"]["size"] == 14 and found["d", "s14"]["bold"] is True and found["d", "s4"]["bold"] is None
    assert found["d", "x"]["italic"] and found["d", "x"]["font"] == "Serif" and found["d", "y"]["italic"] and found["d", "self"]["bold"] and found["d", "lost"]["bold"]
    assert found["e", "s14"]["size"] == 10 and found["e", "s14"]["bold"] is None


def test_theme_fonts(spark):
    theme = '<a:themeElements><a:fontScheme><a:majorFont><a:latin typeface="Head Font"/></a:majorFont><a:minorFont><a:latin typeface="Body Font"/></a:minorFont></a:fontScheme></a:themeElements>'
    styles = '<w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:asciiTheme="minorHAnsi"/></w:rPr></w:rPrDefault></w:docDefaults>' + style("h", None, '<w:rFonts w:asciiTheme="majorHAnsi"/>') + style("own", None, '<w:rFonts w:ascii="Own"/>')
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>text</w:t></w:r></w:p>' for s in ("h", "own", "none"))
    _, runs = docx.paragraphs(docx.parts(spark.createDataFrame([("d", word(styles, body, theme))], "doc_id string, content binary")))
    assert [r["font"] for r in runs.orderBy("pos").collect()] == ["Head Font", "Own", "Body Font"]


@pytest.mark.parametrize("command", ["headings", "tree"])
def test_commands_over_word_files(spark, tmp_path, command):
    from weftline import cli

    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in (("Heading1", "One"), ("Body", "Some plain text that says what it is about, at length."), ("Heading2", "Two")))
    styles = '<w:style w:styleId="Heading1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="Heading2"><w:name w:val="heading 2"/></w:style>'
    (tmp_path / "a.docx").write_bytes(word(styles, body))
    out = str(tmp_path / "out")
    rows = cli.run(spark, [command, str(tmp_path), "--out", out]).collect()
    if command == "headings":
        assert [(r["text"], r["classification"], r["predicted_level"]) for r in rows][::2] == [("One", "heading", 1), ("Two", "heading", 2)]
        assert spark.read.option("header", True).csv(out).count() == 3
    else:
        tree = json.loads(rows[0]["json"])
        assert tree["headings"][0]["title"] == "One" and tree["headings"][0]["children"][0]["title"] == "Two" and len(tree["headings"][0]["content"]) == 1
