"""Line tables: positions, offsets, fences, generated regions, ancestors, sections.

Every operator keeps the leading key columns given as ``keys`` and orders by
``pos``, so many documents go through one plan; windows are partitioned by key.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import vocabulary as V


def ordered(keys: list[str], pos: str = "pos"):
    return Window.partitionBy(*keys).orderBy(pos)


def explode_lines(docs: DataFrame, keys: list[str], text: str = "text", breaks: str = "\n") -> DataFrame:
    """(keys, pos, line), ``pos`` from 0; a null text gives no line."""
    return docs.where(F.col(text).isNotNull()).select(*keys, F.posexplode(F.split(text, breaks)).alias("pos", "line"))


def with_offsets(lines: DataFrame, keys: list[str]) -> DataFrame:
    """1-based line numbers and code-point offsets of each line; the end excludes the break."""
    w = ordered(keys)
    before = F.coalesce(F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = lines.withColumn("line_no", F.row_number().over(w).cast("long")).withColumn("start", before)
    return out.withColumn("end", F.col("start") + F.length("line"))


def line_of_offset(text: Column, offset: Column) -> Column:
    """The 1-based number of the line that holds a 0-based offset."""
    return F.length(F.regexp_replace(F.substring(text, 1, offset), "[^\n]", "")) + 1


def with_fences(lines: DataFrame, keys: list[str], is_fence: Column | None = None) -> DataFrame:
    """``fence`` and ``in_fence``: any fence line toggles."""
    fence = F.col("line").rlike(r"^\s*(```|~~~)") if is_fence is None else is_fence
    w = ordered(keys).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("fence", fence).withColumn("in_fence", (F.sum(F.col("fence").cast("int")).over(w) % 2 == 1) & ~F.col("fence"))


def with_regions(lines: DataFrame, keys: list[str], opens: Column | None = None, closes: Column | None = None) -> DataFrame:
    """``region_mark`` and ``in_region``: between a line that opens a region and one that closes it."""
    opens = F.contains("line", F.lit(V.REGION_START)) if opens is None else opens
    closes = F.contains("line", F.lit(V.REGION_END)) if closes is None else closes
    state = F.last(F.when(opens, True).when(closes, False), ignorenulls=True).over(ordered(keys).rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("region_mark", opens | closes).withColumn("in_region", F.coalesce(state, F.lit(False)) & ~F.col("region_mark"))


def with_ancestors(headings: DataFrame, keys: list[str], level: str = "level", name: str = "heading", levels: int = 9) -> DataFrame:
    """``parent_pos`` and ``path`` (array of names from the root) by nearest earlier lower levels."""
    w = ordered(keys).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col(level) == k, F.struct(F.col("pos").alias("p"), F.col(name).alias("n"))), ignorenulls=True).over(w) for k in range(1, levels + 1)]
    out = headings.withColumn("_last", F.array(*last))

    def keep(acc: Column, i: Column) -> Column:
        own = F.get(F.col("_last"), i - 1)
        after = (F.size(acc) == 0) | (F.get(acc, F.size(acc) - 1)["p"] < own["p"])
        # A level that was opened before the one above it has been closed since.
        return F.when(own.isNull(), acc).when(after, F.concat(acc, F.array(own))).otherwise(acc)

    empty = F.array().cast("array<struct<p:int,n:string>>")
    above = F.filter(F.sequence(F.lit(1), F.lit(levels)), lambda i: i < F.col(level))
    out = out.withColumn("_chain", F.aggregate(above, empty, keep))
    return out.withColumn("parent_pos", F.get(F.col("_chain"), F.size("_chain") - 1)["p"]).withColumn("path", F.concat(F.transform("_chain", lambda x: x["n"]), F.array(F.col(name)))).drop("_last", "_chain")


def in_turn(value: Column, nth: Column) -> Column:
    """``x``, ``x-2``, ``x-3``: a value with the number of its turn."""
    return F.when(nth == 1, value).otherwise(F.concat(value, F.lit("-"), nth.cast("string")))


def numbered(rows: DataFrame, keys: list[str], order: str, value: Column, fixed: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: each key's values made unique in order, ``x``, ``x-2``, ``x-3``; a ``fixed`` one stays as it is.

    Only values that are the same without numbers at their ends can meet, so each such family of a key stands for itself.
    A family of one value is numbered by a window, one whose values all differ needs nothing; in the others, where a natural
    value may look like a numbered one, rows are walked in order with the next free number of each value.
    """
    family = F.regexp_replace("_value", "(-[0-9]+)+$", "")
    out = rows.withColumn("_value", value).withColumn("_fixed", F.coalesce(fixed, F.lit(False))).withColumn("_family", family)
    own, every = Window.partitionBy(*keys, "_family", "_value"), Window.partitionBy(*keys, "_family")
    out = out.withColumn("_nth", F.row_number().over(own.orderBy(order)))
    alike = F.min("_value").over(every) == F.max("_value").over(every)
    out = out.withColumn("_plain", (alike & ~F.bool_or("_fixed").over(every)) | (F.max("_nth").over(every) == 1))
    kinds = dict(out.dtypes)

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable")
        taken, free, ids = set(), {}, []
        for value, is_fixed in zip(group["_value"], group["_fixed"], strict=True):
            if not is_fixed and value in taken:
                n = free.get(value, 2)
                while f"{value}-{n}" in taken:
                    n += 1
                free[value] = n + 1
                value = f"{value}-{n}"
            taken.add(value)
            ids.append(value)
        return group[[*keys, order]].assign(_id=ids)

    mixed = out.where(~F.col("_plain"))
    walked = mixed.select(*keys, "_family", order, "_value", "_fixed").groupBy(*keys, "_family").applyInPandas(walk, ", ".join(f"{k} {kinds[k]}" for k in [*keys, order]) + ", _id string")
    helpers = ["_value", "_fixed", "_family", "_nth", "_plain"]
    done = out.where("_plain").withColumn(name, in_turn(F.col("_value"), F.col("_nth"))).drop(*helpers)
    return done.unionByName(mixed.join(walked, [*keys, order]).withColumn(name, F.col("_id")).drop(*helpers, "_id"))


def unique_slugs(rows: DataFrame, keys: list[str], base: str, name: str = "section_id") -> DataFrame:
    """Slugs made unique in order of ``pos``, also where a natural slug looks like a numbered one."""
    return numbered(rows, keys, "pos", F.col(base), F.lit(False), name)


def sections(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Markdown sections: keys, order, section_id, heading, level, parent_id, path, content, content_hash.

    Headings are ATX at column 0 outside fences; text before the first is dropped.
    """
    lines = with_fences(docs.where(F.col(text).isNotNull()).select(*keys, F.posexplode(T.lines(F.col(text))).alias("pos", "line")), keys)
    pattern = r"(?U)^(#{1,6})\s+(.+?)\s*#*\s*$"
    heading = ~F.col("fence") & ~F.col("in_fence") & F.col("line").rlike(pattern)
    marked = lines.withColumn("h", heading).withColumn("no", F.sum(F.col("h").cast("int")).over(ordered(keys).rowsBetween(Window.unboundedPreceding, 0)))
    heads = marked.where("h").select(*keys, "pos", "no", F.length(F.regexp_extract("line", pattern, 1)).alias("level"), T.strip(F.regexp_extract("line", pattern, 2)).alias("heading"))
    body = marked.where("no > 0 and not h").groupBy(*keys, "no").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("b"))
    heads = with_ancestors(heads, keys).withColumn("path", F.array_join("path", " > "))
    named = unique_slugs(heads.withColumn("_slug", T.slug(F.col("path"))), keys, "_slug").join(body, [*keys, "no"], "left")
    parents = named.select(*keys, F.col("pos").alias("parent_pos"), F.col("section_id").alias("parent_id"))
    content = T.strip(F.coalesce(F.array_join(F.transform("b", lambda x: x["line"]), "\n"), F.lit("")))
    return named.join(parents, [*keys, "parent_pos"], "left").select(*keys, F.col("no").cast("int").alias("order"), "section_id", "heading", "level", "parent_id", "path", content.alias("content"), T.content_hash(content).alias("content_hash"))


def skeleton(sections: DataFrame, keys: list[str]) -> DataFrame:
    """Sections without content and without generated ones, numbered anew."""
    kept = sections.where(~F.lower(F.trim("heading")).startswith(V.GENERATED_HEADING)).drop("content")
    return kept.withColumn("order", F.row_number().over(Window.partitionBy(*keys).orderBy("order")))


def match_ids(sections: DataFrame, skeleton: DataFrame, keys: list[str]) -> DataFrame:
    """``sections`` with the skeleton's ids where paths are the same, duplicates in turn; others get slugs of their own.

    A slug that the document already holds, from the skeleton or an earlier section, is numbered on.
    """
    nth = F.row_number().over(Window.partitionBy(*keys, "path").orderBy("order"))
    known = skeleton.select(*keys, "path", nth.alias("_n"), F.col("section_id").alias("_id"))
    rows = sections.drop("section_id").withColumn("_n", nth).join(known, [*keys, "path", "_n"], "left")
    own = numbered(rows.withColumnRenamed("_id", "_known"), keys, "order", F.coalesce("_known", T.slug(F.col("path"))), F.col("_known").isNotNull(), "section_id")
    return own.drop("_n", "_known")


def append_section(skeleton: DataFrame, added: DataFrame, keys: list[str]) -> DataFrame:
    """``skeleton`` with one more section per key of ``added`` (keys, heading, level, parent_id)."""
    last = skeleton.groupBy(*keys).agg(F.max("order").alias("last"), F.collect_set("section_id").alias("taken"))
    parent = skeleton.select(*keys, F.col("section_id").alias("parent_id"), F.col("path").alias("parent_path"))
    rows = added.join(parent, [*keys, "parent_id"], "left").join(last, keys, "left").withColumn("path", F.concat_ws(" > ", "parent_path", "heading"))
    base = T.slug(F.col("path"))
    tries = F.transform(F.sequence(F.lit(2), F.coalesce(F.size("taken"), F.lit(0)) + 2), lambda i: F.concat(base, F.lit("-"), i.cast("string")))
    own = F.when(F.coalesce(F.array_contains("taken", base), F.lit(False)), F.get(F.filter(tries, lambda t: ~F.array_contains("taken", t)), F.lit(0))).otherwise(base)
    new = rows.select(*keys, (F.coalesce("last", F.lit(0)) + 1).cast("int").alias("order"), own.alias("section_id"), "heading", "level", "parent_id", "path", F.lit(None).cast("string").alias("content_hash"))
    return skeleton.unionByName(new)


def update_section(skeleton: DataFrame, section_id: str, **fields) -> DataFrame:
    """``skeleton`` with fields of one section changed; an unknown field raises."""
    unknown = set(fields) - set(skeleton.columns)
    if unknown:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    return skeleton.withColumns({k: F.when(F.col("section_id") == section_id, F.lit(v)).otherwise(F.col(k)).cast(skeleton.schema[k].dataType) for k, v in fields.items()})


def best_by_keywords(skeleton: DataFrame, keys: list[str], terms: list[str]) -> DataFrame:
    """The section that most terms hit (2 in the heading, else 1 in the path), the first of equals; none without a hit."""
    score = sum((F.when(F.contains(F.lower("heading"), F.lit(t.lower())), 2).when(F.contains(F.lower("path"), F.lit(t.lower())), 1).otherwise(0) for t in terms), F.lit(0))
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "order")
    return skeleton.withColumn("score", score).where("score > 0").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def insert_under_heading(lines: DataFrame, keys: list[str], heading: str, block: list[str]) -> DataFrame:
    """(keys, text, inserted): ``block`` put before the next heading at the same or a higher level, or at the end.

    Headings may be indented here, need a blank after the hashes and keep trailing ones; the first match wins.
    """
    fenced = with_fences(lines, keys)
    pattern = r"^\s*(#{1,6}) (.*)$"
    heads = fenced.withColumn("level", F.when(~F.col("fence") & ~F.col("in_fence") & F.col("line").rlike(pattern), F.length(F.regexp_extract("line", pattern, 1))))
    title = T.normal_heading(F.regexp_extract("line", pattern, 2))
    wanted = T.normal_heading(F.lit(heading))
    whole = Window.partitionBy(*keys)
    found = heads.withColumn("at", F.min(F.when(F.col("level").isNotNull() & (title == wanted), F.col("pos"))).over(whole))
    found = found.withColumn("at_level", F.max(F.when(F.col("pos") == F.col("at"), F.col("level"))).over(whole))
    stop = F.min(F.when((F.col("pos") > F.col("at")) & (F.col("level") <= F.col("at_level")), F.col("pos"))).over(whole)
    found = found.withColumn("stop", F.when(F.col("at").isNotNull(), F.coalesce(stop, F.max("pos").over(whole) + 1)))
    joined = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("r"), F.max("stop").alias("stop"))
    put = T.literals(block)
    all_lines = F.transform("r", lambda x: x["line"])
    text = F.when(F.col("stop").isNull(), F.array_join(all_lines, "\n")).otherwise(F.array_join(F.concat(F.slice(all_lines, F.lit(1), F.col("stop")), put, F.slice(all_lines, F.col("stop") + 1, F.size("r"))), "\n"))
    return joined.select(*keys, text.alias("text"), F.col("stop").isNotNull().alias("inserted"))


def insert_blocks(docs: DataFrame, inserts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, text, found): texts with blocks put at the end of the sections that they name.

    ``inserts``: keys, ordinal, heading, block (array of lines); several for a text stand in order of ``ordinal``, and
    ``found`` lists the ordinals whose heading is there.  A section ends before the next heading of its own or a higher
    level; a blank line stands on either side of a block.  A final line break is kept.
    """
    rows = docs.where(F.col(text).isNotNull())
    table = with_fences(rows.select(*keys, F.posexplode(T.lines(F.col(text))).alias("pos", "line")), keys)
    pattern = r"^\s*(#{1,6}) (.*)$"
    heads = table.where(~F.col("fence") & ~F.col("in_fence") & F.col("line").rlike(pattern))
    heads = heads.select(*keys, "pos", F.length(F.regexp_extract("line", pattern, 1)).alias("level"), T.normal_heading(F.regexp_extract("line", pattern, 2)).alias("title"))
    all_heads = heads.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "level", "title"))).alias("heads"))
    wanted = inserts.select(*keys, "ordinal", "block", T.normal_heading(F.col("heading")).alias("title")).join(all_heads, keys)
    own = F.get(F.filter("heads", lambda h: h["title"] == F.col("title")), F.lit(0))
    wanted = wanted.withColumn("own", own).where("own is not null")
    stop = F.get(F.filter("heads", lambda h: (h["pos"] > F.col("own.pos")) & (h["level"] <= F.col("own.level"))), F.lit(0))["pos"]
    framed = F.concat(T.literals([""]), F.col("block"), T.literals([""]))
    placed = wanted.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ordinal", stop.alias("stop"), framed.alias("lines")))).alias("ins"))
    body = T.lines(F.col(text))
    here = lambda i, n: F.flatten(F.transform(F.filter("ins", lambda x: F.coalesce(x["stop"], n) == i), lambda x: x["lines"]))
    woven = F.get(F.transform(F.array(body), lambda b: F.flatten(F.transform(F.sequence(F.lit(0), F.size(b)), lambda i: F.concat(here(i, F.size(b)), F.when(i < F.size(b), F.array(F.get(b, i))).otherwise(F.array().cast("array<string>")))))), F.lit(0))
    joined = F.array_join(woven, "\n")
    joined = F.when(F.col(text).endswith("\n") & ~joined.endswith("\n"), F.concat(joined, F.lit("\n"))).otherwise(joined)
    out = rows.select(*keys, text).join(placed, keys, "left")
    return out.select(*keys, F.when(F.col("ins").isNull(), F.col(text)).otherwise(joined).alias("text"), F.coalesce(F.transform("ins", lambda x: x["ordinal"]), F.array().cast("array<int>")).alias("found"))


def find_by_heading(skeleton: DataFrame, keys: list[str], heading: str) -> DataFrame:
    """The first section of each key whose heading is the same once normalised."""
    same = skeleton.where(T.normal_heading(F.col("heading")) == T.normal_heading(F.lit(heading)))
    return same.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("order"))).where("_r = 1").drop("_r")


def content_metadata(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, n_chars, n_lines, n_titles, n_sections)."""
    own = T.lines(F.col(text))
    heads = lambda p: F.size(F.filter(own, lambda x: x.rlike(p))).cast("long")
    return docs.select(*keys, F.length(F.coalesce(text, F.lit(""))).cast("long").alias("n_chars"), F.size(own).cast("long").alias("n_lines"), heads(r"^#\s").alias("n_titles"), heads(r"^##\s").alias("n_sections"))


def preferred(candidates: DataFrame, keys: list[str], priority: str = "priority", valid: str = "valid") -> DataFrame:
    """The valid candidate of the lowest priority number for each key; keys without one give no row."""
    w = Window.partitionBy(*keys).orderBy(priority)
    return candidates.where(F.col(valid)).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
