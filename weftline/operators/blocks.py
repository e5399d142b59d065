"""Section, block and sentence index of Markdown; the block scanner is a true state machine, run per document."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import vocabulary as V

PATCHABLE = ["paragraph", "unordered_list_item", "ordered_list_item"]
HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*#*\s*$")
FENCE = re.compile(r"^\s*(`{3,}|~{3,})")
ITEM = {"unordered_list_item": re.compile(r"^\s*[-*+]\s+(?=\S)"), "ordered_list_item": re.compile(r"^\s*\d+[.)]\s+(?=\S)")}
RUNS = {"|": "table", ">": "blockquote"}


def line_kind(line: str) -> str:
    """What a line starts: blank, fence, comment, heading, table, blockquote, a list item, or text."""
    bare = line.strip()
    if not bare:
        return "blank"
    if FENCE.match(line):
        return "fence"
    if bare.startswith("<!--"):
        return "comment"
    if HEADING.match(line):
        return "heading"
    if bare[0] in RUNS:
        return RUNS[bare[0]]
    return next((name for name, pattern in ITEM.items() if pattern.match(line)), "text")


def scan(text: str) -> list[tuple]:
    """(section, level, heading, section generated, type, first, last line, generated) of each block; a heading gives a row of type ``heading``."""
    lines = text.splitlines()
    kinds = [line_kind(x) for x in lines]
    out, section, generated, at = [], 0, False, 0
    while at < len(lines):
        kind, first = kinds[at], at
        at += 1
        if kind == "blank":
            continue
        if kind == "heading":
            section += 1
            m = HEADING.match(lines[first])
            out.append((section, len(m[1]), m[2].strip(), generated, "heading", first, first, generated))
            continue
        marked = generated
        if kind == "fence":
            mark = FENCE.match(lines[first])[1][0]
            while at < len(lines) and not ((m := FENCE.match(lines[at])) and m[1][0] == mark):
                at += 1
            at = min(at + 1, len(lines))
            kind = "code_block"
        elif kind == "comment":
            at = next((i + 1 for i in range(first, len(lines)) if "-->" in lines[i]), len(lines))
            body = "\n".join(lines[first:at])
            opens, closes = V.REGION_START in body, V.REGION_END in body
            marked, generated = generated or opens or closes, (generated or opens) and not closes
            kind = "html_comment"
        elif kind in RUNS.values():
            while at < len(lines) and lines[at].strip()[:1] == lines[first].strip()[0]:
                at += 1
        else:
            while at < len(lines) and kinds[at] == "text":
                at += 1
            kind = "paragraph" if kind == "text" else kind
        out.append((section, None, None, None, kind, first, at - 1, marked))
    return out


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Sentence spans: an end mark, white space, then a capital, a digit or an opening sign; not in backticks or after abbreviations."""
    spans, start, code = [], len(text) - len(text.lstrip()), False
    for m in re.compile(r"""`|[.!?]+[)"'\]’”]*""").finditer(text, start):
        s, e = m.span()
        if m[0] == "`":
            code = not code
            continue
        if code:
            continue
        marks = s + len(m[0].rstrip(")\"']’”"))
        if text[marks - 1] == ".":
            token = re.search(r"[^\W_]*(?:[.]|[^\W_])*\Z", text[: marks - 1])[0].rstrip(".")
            if token and ((len(token) == 1 and token.isalpha()) or token.lower() in V.ABBREVIATIONS):
                continue
        ahead = e + len(text[e:]) - len(text[e:].lstrip())
        if ahead < len(text) and not (ahead > e and (text[ahead].isupper() or text[ahead].isdigit() or text[ahead] in "(\"'[‘“")):
            continue
        spans.append((start, e))
        start = ahead
    if rest := text[start:].rstrip():
        spans.append((start, start + len(rest)))
    return spans


def block_rows(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, ordinal, section, level, heading, block_type, first_line, last_line, start, end, generated, block_text); lines are 1-based."""
    kinds = dict(docs.dtypes)

    def run(frames):
        for frame in frames:
            rows = []
            for *key, body in frame[[*keys, "body"]].itertuples(index=False):
                lines = body.splitlines(keepends=True)
                starts = [0]
                for x in lines:
                    starts.append(starts[-1] + len(x))
                for i, (section, level, heading, _, kind, a, b, generated) in enumerate(scan(body)):
                    last = lines[b].removesuffix("\n").removesuffix("\r")
                    end = starts[b] + len(last)
                    rows.append((*key, i, section, level, heading, kind, a + 1, b + 1, starts[a], end, generated, body[starts[a] : end]))
            yield pd.DataFrame(rows, columns=[*keys, *names]).astype({"level": "Int32"})

    names = ["ordinal", "section", "level", "heading", "block_type", "first_line", "last_line", "start", "end", "generated", "block_text"]
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", ordinal int, section int, level int, heading string, block_type string, first_line int, last_line int, start int, end int, generated boolean, block_text string"
    return docs.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("body")).mapInPandas(run, schema)


def block_index(docs: DataFrame, keys: list[str], text: str = "text", skeleton: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(sections, blocks) with ids, hashes, keywords and flags.

    Text before the first heading is the section ``(preamble)`` of level 0.  With a ``skeleton`` (keys, order,
    section_id, path) sections keep its ids.
    """
    from weftline.operators.lines import match_ids, unique_slugs, with_ancestors

    rows = block_rows(docs, keys, text)
    heads = rows.where("block_type = 'heading'").withColumn("pos", F.col("section"))
    titled = with_ancestors(heads, keys).withColumn("path", F.array_join("path", " > ")).select(*keys, "pos", "heading", "level", "path", "generated")
    preamble = rows.where("section = 0").select(*keys, F.lit(0).alias("pos"), F.lit("").alias("heading"), F.lit(0).alias("level"), F.lit("(preamble)").alias("path"), F.lit(False).alias("generated")).distinct()
    every = titled.unionByName(preamble)
    if skeleton is None:
        named = unique_slugs(every.withColumn("_slug", T.slug(F.col("path"))), keys, "_slug").drop("_slug")
    else:
        named = match_ids(every.withColumn("order", F.col("pos")).withColumn("section_id", F.lit("")), skeleton, keys).drop("order")
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))
    sections = named.withColumn("order", order).withColumnRenamed("pos", "section")
    own = rows.where("block_type != 'heading'").join(sections.select(*keys, "section", "section_id"), [*keys, "section"])
    digest = F.sha2(F.col("block_text").cast("binary"), 256)
    again = F.row_number().over(Window.partitionBy(*keys, "section_id", "block_type", digest).orderBy("ordinal"))
    marker = F.length(F.regexp_extract("block_text", r"^(\s*(?:[-*+]|\d+[.)])\s+)\S", 1))
    offset = F.when(F.col("block_type").isin("unordered_list_item", "ordered_list_item"), marker).otherwise(0)
    content = F.substring(F.col("block_text"), offset + 1, F.length("block_text"))
    inventory = T.is_inventory_block(F.col("block_text"))
    blocks = own.withColumns(
        {
            "block_id": F.concat_ws("-", "section_id", "block_type", F.substring(digest, 1, 8), again.cast("string")),
            "block_order": F.row_number().over(Window.partitionBy(*keys, "section_id").orderBy("ordinal")),
            "content_text": content,
            "content_hash": digest,
            "keywords": T.keywords(content),
            "structural_inventory": inventory,
            "patchable": F.col("block_type").isin(PATCHABLE) & ~F.col("generated") & ~inventory,
        }
    )
    return sections, blocks


def sentence_rows(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block_id, sentence_id, sentence_order, text, start, end) of patchable kinds of blocks; offsets are within the content."""
    kinds = dict(blocks.dtypes)

    def run(frames):
        for frame in frames:
            rows = [(*key, i, body[s:e], s, e) for *key, body in frame.itertuples(index=False) for i, (s, e) in enumerate(sentence_spans(body))]
            yield pd.DataFrame(rows, columns=[*keys, "block_id", "sentence_order", "text", "start", "end"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", block_id string, sentence_order int, text string, start int, end int"
    found = blocks.where(F.col("block_type").isin(PATCHABLE)).select(*keys, "block_id", "content_text").mapInPandas(run, schema)
    digest = T.short_hash(F.col("text"))
    again = F.row_number().over(Window.partitionBy(*keys, "block_id", digest).orderBy("sentence_order"))
    return found.withColumn("sentence_id", F.concat_ws("-", "block_id", F.lit("sentence"), digest, again.cast("string")))


def eligible(blocks: DataFrame) -> DataFrame:
    """Blocks that may be edited."""
    return blocks.where("patchable")


def stale(documents: DataFrame, index: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Documents whose hash the index doesn't hold (keys, sha256): only these need indexing again."""
    hashed = documents.withColumn("sha256", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    return hashed.join(index.select(*keys, "sha256"), [*keys, "sha256"], "left_anti")


def sentences_native(c: Column) -> Column:
    """The sentences of a text as an array, in column functions; pieces after abbreviations and inside backticks are glued."""
    pieces = F.split(F.ltrim(c), r"""(?U)(?<=[.!?][)"'\]’”]{0,4})\s+(?=[\p{Lu}\d("'\[‘“])""")
    short = "|".join(a.replace(".", r"\.") for a in V.ABBREVIATIONS)
    glue = lambda t: t.rlike(rf"""(?Ui)(?:^|[^\p{{L}}\p{{N}}.])(?:\p{{L}}|{short})\.+[)"'\]’”]*$""") | (F.length(F.regexp_replace(t, "[^`]", "")) % 2 == 1)

    def step(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.when((F.size(acc) > 0) & glue(last), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat_ws(" ", last, p)))).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(F.filter(pieces, lambda p: F.trim(p) != ""), F.array().cast("array<string>"), step)
