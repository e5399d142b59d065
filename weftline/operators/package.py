"""Change packages of any version as one table of files, hunks and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE = "array<struct<line_number:int,text:string,text_truncated:boolean>>"
BLOCK = "struct<block_index:int,change_type:string,old_start_line:int,old_line_count:int,old_end_line:int,new_start_line:int,new_line_count:int,new_end_line:int,removed_text:string,added_text:string,summary:string,symbols:array<string>,text_truncated:boolean>"
HUNK = f"struct<old_start_line:int,old_line_count:int,old_end_line:int,new_start_line:int,new_line_count:int,new_end_line:int,hunk_header:string,change_type:string,summary:string,symbols:array<string>,hunk_text_truncated:boolean,added_lines:{LINE},removed_lines:{LINE},change_blocks:array<{BLOCK}>>"
FILE = f"struct<path:string,old_path:string,change_type:string,status:string,additions:int,deletions:int,binary:boolean,binary_note:string,what_changed:array<{HUNK}>>"
PACKAGE = f"schema_version int, repository string, branch string, actor string, before_sha string, after_sha string, changed_files array<{FILE}>, generated_summary string, generated_at string"


def parse_packages(rows: DataFrame, keys: list[str], json: str = "json") -> DataFrame:
    """Packages from JSON text; anything that is no JSON object gives nulls.  Files given as bare paths become files."""
    text = F.col(json)
    own = F.from_json(text, PACKAGE)
    paths = F.from_json(F.get_json_object(text, "$.changed_files"), "array<string>")
    bare = F.transform(paths, lambda p: F.from_json(F.to_json(F.struct(p.alias("path"))), FILE))
    is_bare = F.get_json_object(text, "$.changed_files[0]").isNotNull() & ~F.get_json_object(text, "$.changed_files[0]").startswith("{")
    return rows.select(*keys, own.alias("p"), F.when(is_bare, bare).alias("bare")).select(*keys, "p.*", "bare").withColumn("changed_files", F.coalesce("bare", "changed_files")).drop("bare")


def schema_version(json: Column) -> Column:
    """A package's version as a whole number; null without one."""
    return F.get_json_object(json, "$.schema_version").try_cast("int")


def files(packages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, schema_version, ordinal, path, old_path, status, additions, deletions, binary, what_changed)."""
    f = packages.select(*keys, "schema_version", F.posexplode("changed_files").alias("ordinal", "f"))
    status = F.coalesce(F.nullif(F.col("f.status"), F.lit("")), F.col("f.change_type"))
    return f.where(F.col("f.path").isNotNull()).select(*keys, "schema_version", "ordinal", "f.path", F.nullif(F.col("f.old_path"), F.lit("")).alias("old_path"), status.alias("status"), "f.additions", "f.deletions", F.coalesce("f.binary", F.lit(False)).alias("binary"), "f.what_changed")


def normal_blocks(hunk: Column) -> Column:
    """A hunk's blocks: its own if it has the field, even if empty, else one from its line lists."""
    texts = lambda c: F.array_join(F.transform(F.coalesce(hunk[c], F.array().cast(LINE)), lambda x: F.coalesce(x["text"], F.lit(""))), "\n")
    count = lambda c: F.coalesce(F.size(F.coalesce(hunk[c], F.array().cast(LINE))), F.lit(0))
    old, new = count("removed_lines"), count("added_lines")
    when = lambda n, c: F.when(n > 0, hunk[c])
    cut = lambda c: F.coalesce(F.exists(hunk[c], lambda x: F.coalesce(x["text_truncated"], F.lit(False))), F.lit(False))
    one = F.struct(
        F.lit(1).alias("block_index"),
        F.when((old == 0) & (new > 0), "added").when((new == 0) & (old > 0), "deleted").otherwise("modified").alias("change_type"),
        when(old, "old_start_line").alias("old_start_line"),
        old.alias("old_line_count"),
        when(old, "old_end_line").alias("old_end_line"),
        when(new, "new_start_line").alias("new_start_line"),
        new.alias("new_line_count"),
        when(new, "new_end_line").alias("new_end_line"),
        texts("removed_lines").alias("removed_text"),
        texts("added_lines").alias("added_text"),
        F.coalesce(hunk["summary"], F.lit("")).alias("summary"),
        F.coalesce(hunk["symbols"], F.array().cast("array<string>")).alias("symbols"),
        (F.coalesce(hunk["hunk_text_truncated"], F.lit(False)) | cut("removed_lines") | cut("added_lines")).alias("text_truncated"),
    )
    return F.when(hunk["change_blocks"].isNotNull(), hunk["change_blocks"]).otherwise(F.when(old + new > 0, F.array(one)).otherwise(F.array().cast(f"array<{BLOCK}>")))


def side_lines(blocks: Column, text: str, count: str) -> Column:
    """The lines of one side over all blocks; a block without lines on it gives none."""
    return F.flatten(F.transform(blocks, lambda b: F.when(F.coalesce(b[count], F.lit(0)) > 0, F.split(F.coalesce(b[text], F.lit("")), "\n")).otherwise(F.array().cast("array<string>"))))


def hunks(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ordinal, path, hunk, summary, hunk_header, symbols, added_lines, removed_lines, blocks)."""
    h = files.select(*keys, "ordinal", "path", F.posexplode("what_changed").alias("hunk", "h")).withColumn("blocks", normal_blocks(F.col("h")))
    return h.select(*keys, "ordinal", "path", "hunk", "h.summary", "h.hunk_header", F.coalesce("h.symbols", F.array().cast("array<string>")).alias("symbols"), side_lines(F.col("blocks"), "added_text", "new_line_count").alias("added_lines"), side_lines(F.col("blocks"), "removed_text", "old_line_count").alias("removed_lines"), "blocks")


def package(files: DataFrame, keys: list[str], summary: Column, **header: str) -> DataFrame:
    """One package (JSON text, version 3) per key from its files, in order of ``ordinal``."""
    fields = ["path", "old_path", "change_type", "status", "additions", "deletions", "binary", "binary_note", "what_changed"]
    present = [c for c in fields if c in files.columns]
    rows = files.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ordinal", *present))).alias("f"))
    own = F.transform("f", lambda x: F.struct(*(x[c].alias(c) for c in present)))
    head = [F.lit(v).alias(k) for k, v in header.items()]
    return rows.select(*keys, F.to_json(F.struct(F.lit(3).alias("schema_version"), *head, own.alias("changed_files"), summary.alias("generated_summary"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("generated_at"))).alias("json"))
