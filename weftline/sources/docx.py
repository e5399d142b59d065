"""Word documents as tables: a document is a zip of XML, read in Arrow batches and never on the driver."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
SCHEMA = """doc_id string, kind string, pos int, run_no int, text string, style_id string, style_name string, based_on string, bold boolean, italic boolean, underline boolean,
size double, font string, color string, alignment string, spacing_before double, spacing_after double, left_indent double, first_line_indent double,
num_id int, ilvl int, num_fmt string, lvl_text string, start int, cells array<array<string>>"""


def _value(node, path: str, attribute: str = "val"):
    found = node.find("/".join(W + p for p in path.split("/"))) if node is not None else None
    return None if found is None else found.get(W + attribute)


def _switch(node, tag: str):
    """On, off or unset (null)."""
    found = node.find(W + tag) if node is not None else None
    return None if found is None else found.get(W + "val", "true").lower() not in ("false", "0", "off", "none")


def _points(value, per: float):
    try:
        return None if value is None else float(value) / per
    except ValueError:
        return None


def _number(value):
    try:
        return None if value is None else int(value)
    except ValueError:
        return None


def _font(properties, themes: dict):
    """The font for Latin text: its name, or the theme's font that it stands for."""
    fonts = properties.find(W + "rFonts") if properties is not None else None
    if fonts is None:
        return None
    theme = fonts.get(W + "asciiTheme")
    return (themes.get("major" if theme.startswith("major") else "minor") if theme else None) or fonts.get(W + "ascii")


def theme_fonts(theme) -> dict:
    """The Latin fonts of a theme's headings (``major``) and body (``minor``)."""
    found = {}
    for kind in ("major", "minor"):
        latin = theme.find(f".//{A}{kind}Font/{A}latin") if theme is not None else None
        if latin is not None and latin.get("typeface"):
            found[kind] = latin.get("typeface")
    return found


def _run_format(properties, themes: dict) -> dict:
    color = properties.find(W + "color") if properties is not None else None
    theme = None if color is None else color.get(W + "themeColor")
    return {
        "bold": _switch(properties, "b"),
        "italic": _switch(properties, "i"),
        "underline": _switch(properties, "u"),
        "size": _points(_value(properties, "sz"), 2),
        "font": _font(properties, themes),
        "color": f"theme:{theme}" if theme else None if color is None else color.get(W + "val"),
    }


def _text(node) -> str:
    out = []
    for x in node.iter():
        if x.tag == W + "t":
            out.append(x.text or "")
        elif x.tag in (W + "br", W + "cr"):
            out.append("\n")
        elif x.tag == W + "tab":
            out.append("\t")
    return "".join(out)


def read_docx(doc_id: str, content: bytes) -> list[dict]:
    """Rows of one document: defaults, styles, numbering, paragraphs, runs, tables; a file that is no document gives none."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            part = lambda name: ElementTree.fromstring(z.read(name)) if name in z.namelist() else None
            body, styles, numbering, theme = (part(f"word/{name}.xml") for name in ("document", "styles", "numbering", "theme/theme1"))
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError):
        return []
    if body is None:
        return []
    rows, names, themes = [], {}, theme_fonts(theme)
    if styles is not None:
        rows.append({"kind": "defaults"} | _run_format(styles.find(f"{W}docDefaults/{W}rPrDefault/{W}rPr"), themes))
        for s in styles.iter(W + "style"):
            names[s.get(W + "styleId")] = _value(s, "name")
            rows.append({"kind": "style", "style_id": s.get(W + "styleId"), "style_name": _value(s, "name"), "based_on": _value(s, "basedOn"), "num_id": _number(_value(s, "pPr/numPr/numId")), "ilvl": _number(_value(s, "pPr/numPr/ilvl"))} | _run_format(s.find(W + "rPr"), themes))
    if numbering is not None:
        abstract = {a.get(W + "abstractNumId"): a for a in numbering.iter(W + "abstractNum")}
        for n in numbering.iter(W + "num"):
            own = abstract.get(_value(n, "abstractNumId"))
            for level in own.iter(W + "lvl") if own is not None else ():
                rows.append({"kind": "level", "num_id": _number(n.get(W + "numId")), "ilvl": _number(level.get(W + "ilvl")), "num_fmt": _value(level, "numFmt"), "lvl_text": _value(level, "lvlText"), "start": _number(_value(level, "start"))})
    inner = body.find(W + "body")
    for pos, p in enumerate(inner.findall(W + "p") if inner is not None else ()):
        own = p.find(W + "pPr")
        style = _value(own, "pStyle")
        space = lambda a, tag="spacing": _points(_value(own, tag, a), 20)  # noqa: E731, B023
        rows.append({"kind": "paragraph", "pos": pos, "text": _text(p), "style_id": style, "style_name": names.get(style, style) if style else "Normal", "alignment": _value(own, "jc"), "spacing_before": space("before"), "spacing_after": space("after"), "left_indent": space("left", "ind"), "first_line_indent": space("firstLine", "ind"), "num_id": _number(_value(own, "numPr/numId")), "ilvl": _number(_value(own, "numPr/ilvl"))})
        rows += ({"kind": "run", "pos": pos, "run_no": i, "text": _text(r), "style_id": style} | _run_format(r.find(W + "rPr"), themes) for i, r in enumerate(p.iter(W + "r")))
    for i, t in enumerate(inner.iter(W + "tbl") if inner is not None else ()):
        rows.append({"kind": "table", "pos": i + 1, "cells": [["\n".join(map(_text, c.iter(W + "p"))).strip() for c in r.findall(W + "tc")] for r in t.findall(W + "tr")]})
    return [{"doc_id": doc_id} | r for r in rows]


def parts(files: DataFrame) -> DataFrame:
    """All rows of documents given as (doc_id, content)."""

    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<array<string>>": pa.list_(pa.list_(pa.string()))}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in SCHEMA.replace("\n", " ").split(","))])

    def run(batches):
        for batch in batches:
            rows = [r for f in batch.to_pylist() for r in read_docx(f["doc_id"], f["content"] or b"")]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("doc_id", "content").mapInArrow(run, SCHEMA)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Rows of every .docx file under a path."""
    return parts(spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("doc_id"), "content"))


FORMAT = ["bold", "italic", "underline", "size", "font", "color"]


def resolved_styles(rows: DataFrame) -> DataFrame:
    """(doc_id, style_id, formats, num_id, ilvl) with unset values taken from the styles that a style is based on, however far.

    Each style walks up its document's styles in one fold, at most as many steps as there are styles, so that styles based on each other end too.
    """
    held = [*FORMAT, "num_id", "ilvl"]
    own = rows.where("kind = 'style' and style_id is not null").dropDuplicates(["doc_id", "style_id"])
    one = F.struct("based_on", *held)
    known = own.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("style_id", one))).alias("_known"))

    def up(acc: Column, _: Column) -> Column:
        above = F.when(acc["based_on"].isNotNull(), F.col("_known")[acc["based_on"]])
        return F.struct(above["based_on"].alias("based_on"), *(F.coalesce(acc[c], above[c]).alias(c) for c in held))

    found = own.join(known, "doc_id").withColumn("_all", F.aggregate(F.sequence(F.lit(1), F.size("_known")), one, up))
    return found.select("doc_id", "style_id", *(F.col(f"_all.{c}").alias(c) for c in held))


def paragraphs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paragraphs, runs) with styles applied; numId 0 switches numbering off."""
    styles = resolved_styles(rows)
    named = styles.select("doc_id", "style_id", *(F.col(c).alias(f"_{c}") for c in [*FORMAT, "num_id", "ilvl"]))
    base = rows.where("kind = 'defaults'").select("doc_id", F.col("size").alias("_base_size"), F.col("font").alias("_base_font"))
    paragraph = rows.where("kind = 'paragraph'").join(named, ["doc_id", "style_id"], "left")
    num = F.coalesce("num_id", "_num_id")
    paragraph = paragraph.withColumn("num_id", F.when(num != 0, num)).withColumn("ilvl", F.coalesce("ilvl", "_ilvl", F.lit(0))).drop("cells", *(f"_{c}" for c in [*FORMAT, "num_id", "ilvl"]))
    run = rows.where("kind = 'run'").join(named, ["doc_id", "style_id"], "left").join(base, "doc_id", "left")
    run = run.select("doc_id", "pos", "run_no", "text", *(F.coalesce(c, f"_{c}", F.lit(False)).alias(c) for c in FORMAT[:3]), F.coalesce("size", "_size", "_base_size").alias("size"), F.coalesce("font", "_font", "_base_font").alias("font"), F.coalesce("color", "_color").alias("color"))
    return paragraph.select("doc_id", "pos", "text", "style_id", "style_name", "alignment", "spacing_before", "spacing_after", "left_indent", "first_line_indent", "num_id", "ilvl"), run


def analyze(rows: DataFrame) -> DataFrame:
    """Scored paragraphs of documents, blank ones left out, with levels."""
    from weftline.operators import headings as H

    paragraph, run = paragraphs(rows)
    features = H.text_features(paragraph.where(F.trim("text") != "")).join(H.run_formatting(run, ["doc_id", "pos"]), ["doc_id", "pos"], "left")
    level = H.official_level(F.col("style_name"))
    features = features.withColumns({"is_official_heading": level.isNotNull(), "official_heading_level": level, "is_word_list_item": F.col("num_id").isNotNull()})
    features = features.join(H.body_formatting(features, ["doc_id"]), "doc_id", "left")
    return H.refine_levels(H.score(H.repeated_patterns(features, ["doc_id"])), ["doc_id"])


def list_items(rows: DataFrame) -> DataFrame:
    """(doc_id, pos, num_id, ilvl, counters, marker): numbered paragraphs; without a definition the marker is null."""
    from weftline.operators import headings as H

    paragraph, _ = paragraphs(rows)
    levels = rows.where("kind = 'level'").groupBy("doc_id", "num_id").agg(F.array_sort(F.collect_list(F.struct("ilvl", F.coalesce("start", F.lit(1)).alias("start"), "num_fmt", "lvl_text"))).alias("levels"))
    items = paragraph.where("num_id is not null").join(levels, ["doc_id", "num_id"], "left")
    own = lambda f: F.get(F.filter("levels", lambda x: x["ilvl"] == F.col("ilvl")), F.lit(0))[f]
    items = items.withColumn("start", F.coalesce(own("start"), F.lit(1))).withColumn("counts", ~F.coalesce(own("num_fmt"), F.lit("none")).isin("bullet", "none"))
    counted = H.list_counters(items, ["doc_id", "num_id"], level="ilvl", sequential="counts")
    marker = H.list_marker(own("lvl_text"), F.col("counters"), F.transform("levels", lambda x: x["num_fmt"]))
    return counted.select("doc_id", "pos", "num_id", "ilvl", "counters", marker.alias("marker"))


def numbering_warnings(items: DataFrame) -> DataFrame:
    """(doc_id, num_id, warning): numbered paragraphs without a definition, told once for each number."""
    return items.where("marker is null").select("doc_id", "num_id", F.concat(F.lit("no definition for list "), F.col("num_id").cast("string")).alias("warning")).dropDuplicates(["doc_id", "num_id"])
