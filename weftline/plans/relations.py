"""Tables that stand for diffs, Markdown and paragraphs, derived from the driver's by whole-number arithmetic; the SQL twins stand beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import vocabulary as V
from weftline.operators.lines import explode_lines
from weftline.session import table


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    return explode_lines(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"])


LINES = "lines AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


def md_lines(spark: SparkSession, d: str) -> DataFrame:
    """role 0 heading, 1 fence, 2 list item, 3 table row, 4 region start, 5 region end, else prose."""
    role = F.pmod(F.col("doc_id") * 31 + F.col("pos") * 7, F.lit(11)).cast("int")
    return doc_lines(spark, d).withColumn("role", role).withColumn("level", (F.lit(1) + F.pmod(F.col("doc_id") + F.col("pos"), F.lit(6))).cast("int"))


MD = LINES + ", md AS (SELECT doc_id, pos, line, (doc_id * 31 + pos * 7) % 11 AS role, 1 + (doc_id + pos) % 6 AS level FROM lines)"


def md_text(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text): ``md_lines`` as real Markdown, with markers in place of roles."""
    hashes = F.array_join(F.array_repeat(F.lit("#"), F.col("level")), "")
    line = (
        F.when(F.col("role") == 0, F.concat(hashes, F.lit(" "), F.col("line")))
        .when(F.col("role") == 1, F.lit("```"))
        .when(F.col("role") == 2, F.concat(F.lit("- "), F.col("line")))
        .when(F.col("role") == 3, F.concat(F.lit("| "), F.col("line"), F.lit(" |")))
        .when(F.col("role") == 4, F.lit(f"<!-- {V.REGION_START} -->"))
        .when(F.col("role") == 5, F.lit(f"<!-- {V.REGION_END} -->"))
        .otherwise(F.col("line"))
    )
    rows = md_lines(spark, d).select("doc_id", "pos", line.alias("line")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("r"))
    return rows.select("doc_id", F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("text"))


#: (doc_id, pos, t): the lines of ``md_text``.
MD_TEXT = (
    MD
    + f""", mt AS (SELECT doc_id, pos, CASE role WHEN 0 THEN repeat('#', CAST(level AS INT)) || ' ' || line WHEN 1 THEN '```' WHEN 2 THEN '- ' || line WHEN 3 THEN '| ' || line || ' |'
 WHEN 4 THEN '<!-- {V.REGION_START} -->' WHEN 5 THEN '<!-- {V.REGION_END} -->' ELSE line END AS t FROM md)"""
)


def diff_lines(spark: SparkSession, d: str) -> DataFrame:
    """A hunk per document whose markers follow from positions; ``line`` has its marker before it."""
    m = F.pmod(F.col("doc_id") * 17 + F.col("pos") * 5, F.lit(7))
    marker = F.when(m < 2, "+").when(m == 2, "-").when(m == 3, "\\").otherwise(" ")
    return doc_lines(spark, d).withColumn("marker", marker).withColumn("line", F.concat("marker", "line"))


DIFF = LINES + r", diff AS (SELECT doc_id, pos, line, CASE WHEN m < 2 THEN '+' WHEN m = 2 THEN '-' WHEN m = 3 THEN '\' ELSE ' ' END AS marker FROM (SELECT *, (doc_id * 17 + pos * 5) % 7 AS m FROM lines))"


def sections(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as sections: the heading is the first three words."""
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("heading"), F.col("text").alias("content"))


SECTIONS = "sections AS (SELECT item_id, array_to_string(string_split(text, ' ')[1:3], ' ') AS heading, text AS content FROM benchmark)"


def paths(spark: SparkSession, d: str) -> DataFrame:
    """Pages as files: the url's path with an extension that follows from the id."""
    kinds = F.array(*map(F.lit, (".py", ".md", ".json", ".txt", "_test.py", "/config/a.yml", "/docs/readme", ".github/workflows/x")))
    tail = F.get(kinds, F.pmod("page_id", F.lit(8)).cast("int"))
    return table(spark, d, "pages").select("page_id", F.concat(F.regexp_replace(F.regexp_extract("url", r"://[^/]*/([^?#]*)", 1), "/$", ""), tail).alias("path"))


PATHS = "paths AS (SELECT page_id, regexp_replace(regexp_extract(url, '://[^/]*/([^?#]*)', 1), '/$', '') || ['.py', '.md', '.json', '.txt', '_test.py', '/config/a.yml', '/docs/readme', '.github/workflows/x'][page_id % 8 + 1] AS path FROM pages)"


def paragraph_features(spark: SparkSession, d: str) -> DataFrame:
    """Document lines as paragraphs with formatting that follows from positions."""
    from weftline.operators.headings import text_features

    rows = doc_lines(spark, d).where(F.trim("line") != "").withColumn("text", F.col("line"))
    k = lambda a, b, n: F.pmod(F.col("doc_id") * a + F.col("pos") * b, F.lit(n))
    rows = rows.withColumns(
        {
            "is_bold": k(3, 5, 4) == 0,
            "is_underlined": k(5, 7, 9) == 0,
            "is_colored": k(7, 3, 11) == 0,
            "font_size": (F.lit(10) + k(1, 3, 4) * 2).cast("double"),
            "font_family": F.when(k(2, 1, 5) == 0, "Serif").otherwise("Sans"),
            "font_color": F.lit(None).cast("string"),
            "spacing_before": k(1, 1, 3).cast("double"),
            "spacing_after": k(1, 2, 2).cast("double"),
            "alignment": F.lit("left"),
            "is_word_list_item": k(11, 1, 6) == 0,
            "is_official_heading": k(13, 1, 17) == 0,
            "official_heading_level": (F.lit(1) + k(1, 1, 3)).cast("int"),
            "style_name": F.when(k(1, 5, 3) == 0, "Body").otherwise("Normal"),
        }
    )
    return text_features(rows)


def _clean(c) -> Column:
    """Letters, digits and blanks."""
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N} ]", ""))


def summaries(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, heads, text): Markdown summaries whose sections are the lines of documents, each under its first two words; those with a language of ``de`` or ``en`` have a title."""
    parts = doc_lines(spark, d).withColumn("body", _clean("line")).where("body != ''").withColumn("heading", F.regexp_extract("body", "^[^ ]+(?: +[^ ]+)?", 0))
    one = F.struct("pos", "heading", F.concat(F.lit("## "), "heading", F.lit("\nSays "), "body").alias("t"))
    rows = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("r")).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    title = F.when(F.col("lang").isin("de", "en"), F.concat(F.lit("# "), F.col("r")[0]["heading"], F.lit("\n"))).otherwise("")
    return rows.select("doc_id", F.size("r").alias("heads"), F.concat(title, F.lit("opened\n"), F.array_join(F.transform("r", lambda x: x["t"]), "\n")).alias("text"))


#: ``body`` as it stands in the text.
SUMMARIES = (
    LINES
    + r""", summary_lines AS (SELECT doc_id, pos, trim(regexp_replace(line, '[^\p{L}\p{N} ]', '', 'g')) AS b FROM lines),
 summary_heads AS (SELECT doc_id, pos, 'Says ' || b AS body, regexp_extract(b, '^[^ ]+(?: +[^ ]+)?') AS heading FROM summary_lines WHERE b <> ''),
 summary_parts AS (SELECT s.*, d.lang IN ('de', 'en') AND d.lang IS NOT NULL AS titled, first_value(heading) OVER (PARTITION BY s.doc_id ORDER BY pos) AS title FROM summary_heads s JOIN documents d ON d.doc_id = s.doc_id)"""
)
