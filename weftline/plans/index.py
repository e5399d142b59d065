"""The index of documents as JSON, one object each, byte for byte the same for the same text; made anew only where it is stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import blocks as B

VERSIONS = ("1",)


def _line(first: Column, text: Column, offset: Column) -> Column:
    """The line of a block's offset, the block beginning at line ``first``."""
    return first + F.length(F.regexp_replace(F.substring(text, F.lit(1), offset), "[^\n]", ""))


def build(documents: DataFrame, skeletons: DataFrame | None = None, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, json): schema version, source (path, sha256, size_bytes) and sections with their blocks and sentences, all in order.

    ``documents``: key, text, source.  ``skeletons``: key, order, section_id, path, whose ids sections keep.
    """
    keys = [key]
    sections, rows = B.block_index(documents, keys, text, skeletons)
    sentence = B.sentence_rows(rows, keys).join(rows.select(key, "block_id", F.col("start").alias("_at"), "first_line", "block_text", "content_text"), [key, "block_id"])
    lead = F.length("block_text") - F.length("content_text")
    begin, end = lead + F.col("start"), lead + F.col("end")
    line = lambda o: _line(F.col("first_line"), F.col("block_text"), o)
    one = F.struct(
        "sentence_order",
        "sentence_id",
        "text",
        F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"),
        T.keywords(F.col("text")).alias("keywords"),
        begin.alias("block_start_offset"),
        end.alias("block_end_offset"),
        (F.col("_at") + begin).alias("source_start_offset"),
        (F.col("_at") + end).alias("source_end_offset"),
        line(begin).alias("start_line"),
        line(F.greatest(end - 1, begin)).alias("end_line"),
    )
    told = sentence.groupBy(key, "block_id").agg(F.array_sort(F.collect_list(one)).alias("s")).select(key, "block_id", F.transform("s", lambda x: x.dropFields("sentence_order")).alias("sentences"))
    empty = F.array().cast(dict(told.dtypes)["sentences"])
    block = F.struct(
        F.col("block_order").alias("order"),
        "block_id",
        "block_type",
        F.col("block_text").alias("text"),
        "content_text",
        "content_hash",
        "keywords",
        "patchable",
        "structural_inventory",
        "generated",
        F.col("start").alias("source_start_offset"),
        F.col("end").alias("source_end_offset"),
        F.col("first_line").alias("start_line"),
        F.col("last_line").alias("end_line"),
        F.coalesce("sentences", empty).alias("sentences"),
    )
    own = rows.join(told, [key, "block_id"], "left").groupBy(key, "section_id").agg(F.array_sort(F.collect_list(block)).alias("blocks"), F.min("start").alias("_from"), F.max("end").alias("_to"))
    bare = F.array().cast(dict(own.dtypes)["blocks"])
    held = sections.join(own, [key, "section_id"], "left").join(documents.select(key, F.coalesce(text, F.lit("")).alias("_text")), key)
    body = F.when(F.col("_from").isNotNull(), F.substring("_text", F.col("_from") + 1, F.col("_to") - F.col("_from"))).otherwise("")
    section = F.struct("order", "section_id", "heading", F.col("level").alias("heading_level"), F.split("path", " > ").alias("heading_path"), "generated", T.content_hash(body).alias("content_hash"), T.keywords(F.concat_ws(" ", "heading", body)).alias("keywords"), F.coalesce("blocks", bare).alias("blocks"))
    all_ = held.groupBy(key).agg(F.array_sort(F.collect_list(section)).alias("sections"))
    none = F.array().cast(dict(all_.dtypes)["sections"])
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    out = documents.join(all_, key, "left")
    origin = F.struct(F.col(source).alias("path"), F.sha2(whole, 256).alias("sha256"), F.octet_length(whole).alias("size_bytes"))
    return out.select(key, F.to_json(F.struct(F.lit(1).alias("schema_version"), origin.alias("source"), F.coalesce("sections", none).alias("sections"))).alias("json"))


def problem(json: Column) -> Column:
    """What makes a stored index unusable; null if nothing does."""
    parsed = F.try_parse_json(json)
    return (
        F.when(json.isNull(), "no index")
        .when(parsed.isNull(), "not JSON")
        .when(~F.ltrim(json).startswith("{"), "not an object")
        .when(F.get_json_object(json, "$.source").isNull() | F.get_json_object(json, "$.sections").isNull(), "no source or sections")
        .when(~F.coalesce(F.get_json_object(json, "$.schema_version"), F.lit("")).isin(*VERSIONS), "unsupported version")
    )


def ensure(documents: DataFrame, stored: DataFrame, skeletons: DataFrame | None = None, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, status, json) of every document: ``current`` with its stored index, else ``created`` or ``rebuilt``.

    An index is current if it is whole, of a known version, of the same source and of the same text; only the others' documents are indexed.
    """
    rows = documents.join(stored.select(key, F.col("json").alias("_json")), key, "left")
    j = F.col("_json")
    same = (F.get_json_object(j, "$.source.path") == F.col(source)) & (F.get_json_object(j, "$.source.sha256") == F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    wrong = problem(j)
    status = F.when(wrong == "no index", "created").when(wrong.isNotNull() | ~F.coalesce(same, F.lit(False)), "rebuilt").otherwise("current")
    judged = rows.withColumn("status", status)
    fresh = build(judged.where("status != 'current'").select(key, text, source), skeletons, key, text, source)
    return judged.select(key, "status", j.alias("_json")).join(fresh, key, "left").select(key, "status", F.coalesce("json", "_json").alias("json"))
