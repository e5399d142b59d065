"""Diffs as tables: status lists, counts, hunks, change blocks, stored text, symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import vocabulary as V
from weftline.operators.lines import ordered


def status_lines(changes: DataFrame, keys: list[str], output: str = "output") -> DataFrame:
    """(keys, pos, path, change_type, old_path) from tab-separated status lines; lines without a path give no row."""
    parts = changes.select(*keys, F.posexplode(F.split(F.coalesce(output, F.lit("")), "\n")).alias("pos", "line")).where(F.trim("line") != "")
    cell = lambda i: F.nullif(F.trim(F.get(F.split("line", "\t"), F.lit(i))), F.lit(""))
    code = F.upper(F.substring(F.trim(F.get(F.split("line", "\t"), F.lit(0))), 1, 1))
    kind = F.when(code == "A", "added").when(code == "M", "modified").when(code == "D", "deleted").when(code == "R", "renamed").when(code == "C", "copied").otherwise("unknown")
    two = kind.isin("renamed", "copied")
    out = parts.select(*keys, "pos", F.when(two, F.coalesce(cell(2), cell(1))).otherwise(cell(1)).alias("path"), kind.alias("change_type"), F.when(two & cell(2).isNotNull(), cell(1)).alias("old_path"))
    return out.where(F.col("path").isNotNull())


def _walk(tokens: Column, record) -> Column:
    """Fold a token stream whose records take one to three tokens.

    ``record(token, a, b)`` gives (struct or null, further tokens taken) for a record that starts at ``token``.
    """
    at = lambda i: F.coalesce(F.get(tokens, i), F.lit(""))

    def step(acc: Column, i: Column) -> Column:
        row, more = record(at(i), at(i + 1), at(i + 2))
        taken = F.struct((i + 1 + more).alias("next"), F.when(row.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(row))).alias("out"))
        return F.when(i < acc["next"], acc).when(at(i) == "", F.struct((i + 1).alias("next"), acc["out"].alias("out"))).otherwise(taken)

    kind = "struct<path:string,status:string,old_path:string,additions:int,deletions:int,binary:boolean>"
    start = F.struct(F.lit(0).alias("next"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.size(tokens) - 1), start, step, lambda a: a["out"])


def _row(path: Column, status=None, old=None, additions=None, deletions=None, binary=None) -> Column:
    cast = lambda v, t: (F.lit(None) if v is None else v).cast(t)
    return F.struct(path.alias("path"), cast(status, "string").alias("status"), cast(old, "string").alias("old_path"), cast(additions, "int").alias("additions"), cast(deletions, "int").alias("deletions"), cast(binary, "boolean").alias("binary"))


def status_stream(changes: DataFrame, keys: list[str], output: str = "output") -> DataFrame:
    """(keys, pos, path, status, old_path) from a NUL-delimited status stream; a copy is an addition."""

    def record(code: Column, a: Column, b: Column):
        letter = F.upper(F.substring(code, 1, 1))
        two = letter.isin("R", "C")
        status = F.when(letter == "R", "renamed").when(letter.isin("C", "A"), "added").when(letter == "D", "deleted").otherwise("modified")
        return _row(F.when(two, b).otherwise(a), status, F.when(two, F.nullif(a, F.lit("")))), F.when(two, 2).otherwise(1)

    found = changes.select(*keys, F.posexplode(_walk(F.split(F.coalesce(output, F.lit("")), "\0"), record)).alias("pos", "r"))
    return found.select(*keys, "pos", "r.path", "r.status", "r.old_path")


def count_stream(changes: DataFrame, keys: list[str], output: str = "output") -> DataFrame:
    """(keys, path, additions, deletions, binary, old_path) from a NUL-delimited count stream; the last row of a path wins."""

    def record(token: Column, a: Column, b: Column):
        parts = F.split(token, "\t")
        path = F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), "\t")
        renamed = path == ""
        binary = (F.get(parts, F.lit(0)) == "-") | (F.get(parts, F.lit(1)) == "-")
        number = lambda i: F.when(~binary, F.get(parts, F.lit(i)).try_cast("int"))
        row = _row(F.when(renamed, b).otherwise(path), None, F.when(renamed, F.nullif(a, F.lit(""))), number(0), number(1), binary)
        whole = F.size(parts) >= 3
        return F.when(whole, row), F.when(whole & renamed, 2).otherwise(0)

    found = changes.select(*keys, F.posexplode(_walk(F.split(F.coalesce(output, F.lit("")), "\0"), record)).alias("pos", "r")).select(*keys, "pos", "r.*")
    last = found.groupBy(*keys, "path").agg(F.max_by(F.struct("additions", "deletions", "binary", "old_path"), "pos").alias("r"))
    return last.select(*keys, "path", "r.*")


def file_changes(statuses: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Statuses with counts; a missing count is null, an old path comes from either side."""
    own = counts.withColumnRenamed("old_path", "_old")
    out = statuses.join(own, [*keys, "path"], "left").withColumn("old_path", F.coalesce("old_path", "_old")).drop("_old")
    binary = F.coalesce("binary", F.lit(False))
    return out.withColumn("binary", binary).withColumn("binary_note", F.when(binary, "Binary file; no text diff."))


def hunk_lines(diffs: DataFrame, keys: list[str], diff: str = "diff") -> DataFrame:
    """(keys, hunk, header parts, pos, marker, line, old_line, new_line, island) for each line inside a hunk.

    ``marker`` is ``+``, ``-``, ``\\`` or blank (context); ``island`` numbers runs of changes between context lines.
    """
    lines = diffs.select(*keys, F.posexplode(F.split(F.coalesce(diff, F.lit("")), "\n")).alias("pos", "line"))
    header = F.col("line").rlike(V.HUNK_HEADER)
    closes = F.col("line").startswith("@@") | F.col("line").startswith("diff --git ")
    w = ordered(keys).rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("is_header", header).withColumn("hunk", F.sum(header.cast("int")).over(w))
    inside = F.last(F.when(header, True).when(closes, False), ignorenulls=True).over(w)
    lines = lines.withColumn("inside", F.coalesce(inside, F.lit(False)))
    part = lambda i: F.nullif(F.regexp_extract("line", V.HUNK_HEADER, i), F.lit(""))
    head = F.when(F.col("is_header"), F.struct(part(1).cast("int").alias("old_start"), F.coalesce(part(2).cast("int"), F.lit(1)).alias("old_count"), part(3).cast("int").alias("new_start"), F.coalesce(part(4).cast("int"), F.lit(1)).alias("new_count"), F.coalesce(part(5), F.lit("")).alias("section")))
    by_hunk = ordered([*keys, "hunk"])
    lines = lines.withColumn("head", F.first(head, ignorenulls=True).over(by_hunk.rowsBetween(Window.unboundedPreceding, 0)))
    body = lines.where("inside and not is_header and hunk > 0")
    first = F.substring("line", 1, 1)
    body = body.withColumn("marker", F.when(first.isin("+", "-", "\\"), first).otherwise(" "))
    return number_lines(body, [*keys, "hunk"], F.col("head.old_start"), F.col("head.new_start"))


def number_lines(body: DataFrame, keys: list[str], old_start: Column, new_start: Column) -> DataFrame:
    """Line numbers on either side and change islands, from markers in order."""
    past = ordered(keys).rowsBetween(Window.unboundedPreceding, -1)
    upto = ordered(keys).rowsBetween(Window.unboundedPreceding, 0)
    on_old, on_new, context = F.col("marker").isin(" ", "-"), F.col("marker").isin(" ", "+"), F.col("marker") == " "
    count = lambda c, w: F.coalesce(F.sum(c.cast("int")).over(w), F.lit(0))
    out = body.withColumn("old_line", F.when(on_old, old_start + count(on_old, past))).withColumn("new_line", F.when(on_new, new_start + count(on_new, past)))
    return out.withColumn("island", count(context, upto))


def change_type(old: Column, new: Column) -> Column:
    return F.when((old == 0) & (new > 0), "added").when((new == 0) & (old > 0), "deleted").otherwise("modified")


def last_line(start: Column, count: Column) -> Column:
    return F.when(count > 0, start + count - 1)


def change_blocks(numbered: DataFrame, keys: list[str]) -> DataFrame:
    """A row per run of changes: ranges, counts, texts, type and a factual sentence."""
    changed = numbered.where(F.col("marker").isin("+", "-"))
    side = lambda m: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("marker") == m, F.struct("pos", F.expr("substring(line, 2)").alias("t"))))), lambda x: x["t"]), "\n")
    of = lambda m, c, f: f(F.when(F.col("marker") == m, F.col(c)))
    out = changed.groupBy(*keys, "island").agg(
        F.min("pos").alias("first_pos"),
        of("-", "old_line", F.min).alias("old_start"),
        of("-", "old_line", F.max).alias("old_end"),
        F.count_if(F.col("marker") == "-").alias("old_count"),
        of("+", "new_line", F.min).alias("new_start"),
        of("+", "new_line", F.max).alias("new_end"),
        F.count_if(F.col("marker") == "+").alias("new_count"),
        side("-").alias("removed_text"),
        side("+").alias("added_text"),
    )
    index = F.row_number().over(Window.partitionBy(*keys).orderBy("island"))
    kind = change_type(F.col("old_count"), F.col("new_count"))
    return out.withColumn("block_index", index).withColumn("change_type", kind).withColumn("summary", block_summary(kind)).drop("island")


def _range(start: str, end: str) -> Column:
    return F.when(F.col(start) == F.col(end), F.concat(F.lit("line "), F.col(start).cast("string"))).otherwise(F.concat(F.lit("lines "), F.col(start).cast("string"), F.lit("–"), F.col(end).cast("string")))


def block_summary(kind: Column) -> Column:
    old, new = _range("old_start", "old_end"), _range("new_start", "new_end")
    return F.when(kind == "added", F.concat(F.lit("Added new "), new, F.lit("."))).when(kind == "deleted", F.concat(F.lit("Deleted old "), old, F.lit("."))).otherwise(F.concat(F.lit("Replaced old "), old, F.lit(" with new "), new, F.lit(".")))


def stored_lines(numbered: DataFrame, keys: list[str], most_lines: int = V.STORED_LINES, line_chars: int = V.STORED_LINE_CHARS, hunk_chars: int = V.STORED_HUNK_CHARS) -> DataFrame:
    """(keys, pos, marker, text, text_truncated): changed lines kept under the caps of their hunk.

    A line that doesn't fit is left out, and a later, shorter one may still fit: one hunk's lines are folded in order.
    """
    text = F.expr("substring(line, 2)")
    rows = numbered.where(F.col("marker").isin("+", "-")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "marker", F.length(text).alias("n")))).alias("r"))
    start = F.struct(F.lit(0).alias("plus"), F.lit(0).alias("minus"), F.lit(0).alias("chars"), F.array().cast("array<int>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        n, plus = F.least(x["n"], F.lit(line_chars)), x["marker"] == "+"
        fits = (F.when(plus, acc["plus"]).otherwise(acc["minus"]) < most_lines) & (acc["chars"] + n <= hunk_chars)
        one = lambda own: F.when(own & fits, 1).otherwise(0)
        return F.struct((acc["plus"] + one(plus)).alias("plus"), (acc["minus"] + one(~plus)).alias("minus"), (acc["chars"] + F.when(fits, n).otherwise(0)).alias("chars"), F.when(fits, F.concat(acc["kept"], F.array(x["pos"]))).otherwise(acc["kept"]).alias("kept"))

    kept = rows.select(*keys, F.explode(F.aggregate("r", start, step, lambda a: a["kept"])).alias("pos"))
    return numbered.join(kept, [*keys, "pos"]).select(*keys, "pos", "marker", F.substring(text, 1, line_chars).alias("text"), (F.length(text) > line_chars).alias("text_truncated"))


def header_symbol(section: Column) -> Column:
    """(kind, name) that a hunk header names, a function before a class; null without."""
    of = lambda p: F.nullif(F.regexp_extract(F.coalesce(section, F.lit("")), p, 1), F.lit(""))
    function, klass = of(r"(?:^|\b)(?:async\s+def|def)\s+([A-Za-z_]\w*)"), of(r"(?:^|\b)class\s+([A-Za-z_]\w*)")
    kind = F.when(F.ltrim(section).startswith("async"), "async function").otherwise("function")
    return F.when(function.isNotNull(), F.struct(kind.alias("kind"), function.alias("name"))).when(klass.isNotNull(), F.struct(F.lit("class").alias("kind"), klass.alias("name")))


def hunk_summary(kind: Column, added: Column, removed: Column, phrase: Column) -> Column:
    """One factual sentence; ``phrase`` is a kind and a name, or null."""
    at = lambda w, after="": F.when(phrase.isNotNull(), F.concat(F.lit(w), phrase, F.lit(after))).otherwise("")
    a, r = added.cast("string"), removed.cast("string")
    return (
        F.when(kind == "added", F.concat(F.lit("Added "), a, F.lit(" lines"), at(" in "), F.lit(".")))
        .when(kind == "deleted", F.concat(F.lit("Deleted "), r, F.lit(" lines"), at(" from "), F.lit(".")))
        .otherwise(F.concat(F.lit("Modified"), at(" ", " with"), F.lit(" "), a, F.lit(" added and "), r, F.lit(" removed lines.")))
    )


def hunks(diffs: DataFrame, keys: list[str], diff: str = "diff") -> DataFrame:
    """A row per hunk with ranges, true counts, type and summary; a hunk without lines has none."""
    body = hunk_lines(diffs, keys, diff)
    out = body.groupBy(*keys, "hunk").agg(F.first("head").alias("head"), F.count_if(F.col("marker") == "+").alias("added"), F.count_if(F.col("marker") == "-").alias("removed"))
    kind = change_type(F.col("head.old_count"), F.col("head.new_count"))
    symbol = header_symbol(F.col("head.section"))
    phrase = F.when(symbol.isNotNull(), F.concat_ws(" ", symbol["kind"], symbol["name"]))
    return out.select(*keys, "hunk", "head.*", last_line(F.col("head.old_start"), F.col("head.old_count")).alias("old_end"), last_line(F.col("head.new_start"), F.col("head.new_count")).alias("new_end"), "added", "removed", kind.alias("change_type"), hunk_summary(kind, F.col("added"), F.col("removed"), phrase).alias("summary"))


def _symbol_lists(lines: DataFrame, symbols: DataFrame | None, keys: list[str], by: list[str], line: str, name: str) -> DataFrame:
    """(by, name): the innermost symbols (name, kind) around ``line`` of the rows of each ``by``, in order of their first lines."""
    points = lines.where(F.col(line).isNotNull()).select(*by, F.col(line).alias("_line")).distinct()
    if symbols is None:
        return points.select(*by).distinct().withColumn(name, F.array().cast("array<struct<name:string,kind:string>>"))
    own = symbols.withColumn("_symbol", F.struct(F.col("qualified_name").alias("name"), "kind"))
    found = innermost(points, own, keys, "_line", "start_line", "end_line", "_symbol", "ordinal")
    ordered_ = F.transform(F.array_sort(F.collect_list(F.struct("_line", "_symbol"))), lambda x: x["_symbol"])
    return found.groupBy(*by).agg(F.array_distinct(ordered_).alias(name))


def what_changed(diffs: DataFrame, keys: list[str], new_symbols: DataFrame | None = None, old_symbols: DataFrame | None = None, diff: str = "diff") -> DataFrame:
    """(keys, what_changed): all hunks of a file with their blocks, symbols and summaries, as change packages hold them.

    ``new_symbols`` and ``old_symbols``: keys and what ``python_symbols`` gives for the file after and before; a file
    without any gets none.  Texts hold the lines that ``stored_lines`` keeps; counts and ranges are true.
    """
    by = [*keys, "hunk"]
    body = hunk_lines(diffs, keys, diff)
    kept = stored_lines(body, by).select(*by, "pos", "text", "text_truncated")
    changed = body.where(F.col("marker").isin("+", "-")).join(kept, [*by, "pos"], "left").withColumn("line", F.concat("marker", "text"))
    none = F.array().cast("array<struct<name:string,kind:string>>")
    sides = lambda rows, at: _symbol_lists(rows.where("marker = '+'"), new_symbols, keys, at, "new_line", "new").join(_symbol_lists(rows.where("marker = '-'"), old_symbols, keys, at, "old_line", "old"), at, "full")
    names = lambda *cs: F.array_distinct(F.transform(F.concat(*(F.coalesce(c, none) for c in cs)), lambda x: x["name"]))

    per_island = changed.groupBy(*by, "island").agg(F.min("pos").alias("first_pos"), F.bool_or(F.coalesce("text_truncated", F.lit(True))).alias("cut"))
    blocks = change_blocks(changed, by).join(per_island, [*by, "first_pos"]).join(sides(changed, [*by, "island"]), [*by, "island"], "left")
    own = F.when(F.col("change_type") == "added", names(F.col("new"))).when(F.col("change_type") == "deleted", names(F.col("old"))).otherwise(names(F.col("new"), F.col("old")))
    block = F.struct(
        "block_index",
        "change_type",
        F.col("old_start").alias("old_start_line"),
        F.col("old_count").cast("int").alias("old_line_count"),
        F.col("old_end").alias("old_end_line"),
        F.col("new_start").alias("new_start_line"),
        F.col("new_count").cast("int").alias("new_line_count"),
        F.col("new_end").alias("new_end_line"),
        "removed_text",
        "added_text",
        "summary",
        own.alias("symbols"),
        F.col("cut").alias("text_truncated"),
    )
    gathered = blocks.groupBy(*by).agg(F.array_sort(F.collect_list(block)).alias("change_blocks"), F.bool_or("cut").alias("cut"))

    heads = body.groupBy(*by).agg(F.first("head").alias("head"), F.count_if(F.col("marker") == "+").alias("added"), F.count_if(F.col("marker") == "-").alias("removed"))
    rows = heads.join(gathered, by, "left").join(sides(changed, by), by, "left")
    kind = change_type(F.col("head.old_count"), F.col("head.new_count"))
    first = lambda c: F.get(F.coalesce(c, none), F.lit(0))
    primary = F.when(kind == "deleted", F.coalesce(first(F.col("old")), first(F.col("new")))).otherwise(F.coalesce(first(F.col("new")), first(F.col("old"))))
    header = header_symbol(F.col("head.section"))
    phrase = F.coalesce(F.when(primary.isNotNull(), F.concat_ws(" ", primary["kind"], primary["name"])), F.when(header.isNotNull(), F.concat_ws(" ", header["kind"], header["name"])))
    hunk = F.struct(
        "hunk",
        F.col("head.old_start").alias("old_start_line"),
        F.col("head.old_count").alias("old_line_count"),
        last_line(F.col("head.old_start"), F.col("head.old_count")).alias("old_end_line"),
        F.col("head.new_start").alias("new_start_line"),
        F.col("head.new_count").alias("new_line_count"),
        last_line(F.col("head.new_start"), F.col("head.new_count")).alias("new_end_line"),
        F.col("head.section").alias("hunk_header"),
        kind.alias("change_type"),
        hunk_summary(kind, F.col("added"), F.col("removed"), phrase).alias("summary"),
        names(F.col("new"), F.col("old")).alias("symbols"),
        F.coalesce("cut", F.lit(False)).alias("hunk_text_truncated"),
        F.coalesce("change_blocks", F.array().cast(dict(gathered.dtypes)["change_blocks"])).alias("change_blocks"),
    )
    out = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(hunk)).alias("h"))
    return out.select(*keys, F.transform("h", lambda x: x.dropFields("hunk")).alias("what_changed"))


def python_symbols(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """(keys, ordinal, qualified_name, kind, start_line, end_line) of Python sources; no rows where parsing fails."""
    from weftline.sources.symbols import symbol_rows

    schema = ", ".join(f"{k} {dict(files.dtypes)[k]}" for k in keys) + ", ordinal int, qualified_name string, kind string, start_line int, end_line int"
    return files.select(*keys, F.col(content).alias("content")).mapInPandas(symbol_rows(keys), schema)


def _nodes(start: Column, end: Column) -> Column:
    """The aligned blocks of 1, 4, 16, ... places that make up [start, end], as (level, block), at most six of a level.

    Of the blocks of a level that lie inside, those are left out whose four times larger block lies inside too.
    """
    shift = lambda x, level: F.call_function("shiftright", x, F.lit(2) * level)
    low = lambda level: -shift(-start, level)
    high = lambda level: shift(end + 1, level) - 1
    none = F.array().cast("array<bigint>")
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(none)

    def of(level: Column) -> Column:
        own, above = (low(level), high(level)), (low(level + 1), high(level + 1))
        larger = above[0] <= above[1]
        blocks = F.when(larger, F.concat(span(own[0], 4 * above[0] - 1), span(4 * above[1] + 4, own[1]))).otherwise(span(*own))
        return F.transform(blocks, lambda n: F.struct(level.alias("level"), n.alias("node")))

    top = F.ceil(F.log2((end - start + 1).cast("double")) / 2).cast("int")
    return F.flatten(F.transform(F.sequence(F.lit(0), top), of))


def innermost(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, start: str, end: str, name: str, tie: str) -> DataFrame:
    """Each point with the shortest interval around it, then the earliest, then by ``tie``; points outside all are left out.

    Intervals are taken apart into aligned blocks, and each block keeps the best interval that it belongs to, so a block is
    one row however many intervals lie over each other.  A point lies in one block of each size and meets one row in each
    at most: rows grow with the points and the logarithm of the longest interval, whatever overlaps, and no key's rows come together.
    """
    own = intervals.where(F.col(end) >= F.col(start)).select(*keys, F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e"), F.col(name).alias(name), F.col(tie).alias("_t"))
    order = F.struct((F.col("_e") - F.col("_s")).alias("n"), F.col("_s").alias("s"), F.col("_t").alias("t"))
    # Equal intervals first: of those only one can win.
    own = own.groupBy(*keys, "_s", "_e").agg(F.min_by(F.struct(F.col(name), "_t"), "_t").alias("_own")).select(*keys, "_s", "_e", f"_own.{name}", "_own._t")
    placed = own.select("*", F.inline(_nodes(F.col("_s"), F.col("_e"))).alias("_level", "_node"))
    best = placed.groupBy(*keys, "_level", "_node").agg(F.min_by(F.struct(F.col(name), F.col("_s").alias("start"), F.col("_e").alias("end"), F.col("_t").alias("t")), order).alias("_b"))
    levels = best.groupBy(*keys).agg(F.collect_set("_level").alias("_levels"))  # one row of a few numbers for each key
    asked = points.join(levels, keys).withColumn("_level", F.explode("_levels")).drop("_levels")
    asked = asked.withColumn("_node", F.call_function("shiftright", F.col(point).cast("long"), F.lit(2) * F.col("_level")))
    held = asked.join(best, [*keys, "_level", "_node"])
    first = F.min_by(F.col("_b"), F.struct((F.col("_b.end") - F.col("_b.start")).alias("n"), F.col("_b.start").alias("s"), F.col("_b.t").alias("t")))
    return held.groupBy(*points.columns).agg(first.alias("b")).select(*points.columns, f"b.{name}", F.col("b.start").alias("start"), F.col("b.end").alias("end"))


def type_summary(changes: DataFrame, keys: list[str], kind: str = "change_type", path: str = "path", pos: str = "pos", shown: int = 10) -> DataFrame:
    """``N file(s) changed (1 added, ...): first paths (and k more).`` per key."""
    rows = changes.groupBy(*keys).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(pos, F.col(path).alias("p")))).alias("paths"))
    kinds = changes.groupBy(*keys, kind).agg(F.count("*").alias("c")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(kind).alias("k"), "c"))).alias("kinds"))
    both = rows.join(kinds, keys)
    listed = F.array_join(F.transform("kinds", lambda x: F.concat(x["c"].cast("string"), F.lit(" "), x["k"])), ", ")
    first = F.array_join(F.transform(F.slice("paths", 1, shown), lambda x: x["p"]), ", ")
    more = F.when(F.col("n") > shown, F.concat(F.lit(" (and "), (F.col("n") - shown).cast("string"), F.lit(" more)"))).otherwise("")
    return both.select(*keys, F.concat(F.col("n").cast("string"), F.lit(" file(s) changed ("), listed, F.lit("): "), first, more, F.lit(".")).alias("summary"))
