"""How far the sources of a language differ in their terms: DuckDB counts and compares shards, Spark merges them.

Terms are runs of letters A-Z, a-z and of anything beyond ASCII, with A-Z
lower-cased.  Each task counts the terms of what it reads in DuckDB, by language,
source and term, with the documents that hold them.  The counts are dealt to shards
by a hash of language and term; in each shard DuckDB adds them up and keeps the terms
that enough documents of the language hold.  Spark adds up the totals of all groups,
and every shard gets them beside its terms.  A shard then works out, for each
pair of sources, its part of the sum over kept terms, and the best terms of each source;
Spark adds the parts up and ranks them.

No term lies in two shards, so a shard holds one row at most for each source and term.
With ``a`` and ``b`` the probabilities of a term in two sources, ``a0`` and ``b0`` those of
terms that they lack, a shard's part of a pair's sum is

    sum over terms of both   f(a, b) - f(a, b0) - f(a0, b) + f(a0, b0)
    + sum over a's terms     f(a, b0)
    + sum over b's terms     f(a0, b)
    + (terms - a's - b's) *  f(a0, b0)

so only terms that two sources share are compared pair by pair, inside the shard.  All
numbers are whole.  The result has a row for each two sources of a language, which the
number of sources bounds, not the number of documents.

Defined results: a null text, language or source is empty; each row is a document, repeated or
not; a group without terms has its rows with the values of empty counts, and a language without kept
terms has pairs of value 0; an empty table gives an empty result; other columns aren't read.  Texts are
counted in parts of about a megabyte that end at a character outside terms; what is held grows with the largest such part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, by_bytes, chunks, give_back

#: A term is kept in a language if so many of its documents hold it.
LEAST_DOCUMENTS = 10
#: Ranks of the part ``term`` that are given.
TOP = 10
#: Rows of counts that a shard is meant to hold.
SHARD_ROWS = 500_000
#: Rows of counts that a task holds before it hands them on.
HELD_ROWS = 600_000
#: Bytes of text that DuckDB counts at a time.
COUNTED_BYTES = 8 << 20
#: Upper case to lower, other ASCII to a blank, the rest as it is; every byte beyond ASCII belongs to a term.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_KEPT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("is_first", pa.int64())])
_PARTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

#: Occurrences and documents by group and term, of one batch of texts; a group has a row of its own under the empty term.
_COUNT_BATCH = """INSERT INTO counts
 SELECT lang, source, term, CAST(sum(n) AS BIGINT), count(*) FROM
  (SELECT doc, lang, source, term, count(*) AS n FROM (SELECT doc, lang, source, unnest(string_split(text, ' ')) AS term FROM batch) WHERE term <> '' GROUP BY ALL)
 GROUP BY ALL
 UNION ALL SELECT DISTINCT lang, source, '', 0, 0 FROM batch"""
_ADD_UP = "CREATE OR REPLACE TABLE counts AS SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs FROM {0} GROUP BY ALL"
_KEEP = """SELECT lang, source, term, n, CAST(row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 AS BIGINT) AS is_first FROM counts
 JOIN (SELECT lang, term FROM counts WHERE term <> '' GROUP BY ALL HAVING sum(docs) >= {0}) USING (lang, term)"""

#: What a shard compares: groups with their totals, and the counts of its terms with probabilities.
_COMPARE = (
    "CREATE MACRO prob(n, total, kept) AS CAST(1 + (1000000000::HUGEINT * (n + 2)) // greatest(total + 2 * kept, 1) AS BIGINT)",
    "CREATE MACRO f(p, q) AS ((p - q) * (p - q)) // (p + q)",
    "CREATE TABLE held AS SELECT * FROM stream",
    "CREATE TABLE g AS SELECT DISTINCT lang, source, total, lang_total, kept, prob(0, total, kept) AS p0 FROM held WHERE term IS NULL",
    "CREATE TABLE t AS SELECT lang, source, term, n, prob(n, g.total, g.kept) AS p, p0, g.lang_total, g.kept FROM (SELECT lang, source, term, n FROM held WHERE term IS NOT NULL) JOIN g USING (lang, source)",
    "DROP TABLE held",
)
_PAIRS = """WITH own AS (SELECT lang, source, count(*) AS k FROM t GROUP BY ALL),
 every AS (SELECT lang, count(DISTINCT term) AS k FROM t GROUP BY ALL),
 levels AS (SELECT lang, source, p, count(*) AS k FROM t GROUP BY ALL),
 one AS (SELECT x.lang, x.source AS a, g.source AS b, sum(x.k * f(x.p, g.p0)) AS s FROM levels x JOIN g ON g.lang = x.lang AND g.source <> x.source GROUP BY ALL),
 two AS (SELECT x.lang, x.source AS a, y.source AS b, sum(f(x.p, y.p) - f(x.p, y.p0) - f(x.p0, y.p) + f(x.p0, y.p0)) AS s
  FROM t x JOIN t y ON x.lang = y.lang AND x.term = y.term AND x.source < y.source GROUP BY ALL)
 SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
  CAST(coalesce(two.s, 0) + coalesce(ab.s, 0) + coalesce(ba.s, 0) + (coalesce(every.k, 0) - coalesce(oa.k, 0) - coalesce(ob.k, 0)) * coalesce(f(a.p0, b.p0), 0) AS BIGINT) AS value
 FROM g a JOIN g b ON a.lang = b.lang AND a.source < b.source
 LEFT JOIN two ON two.lang = a.lang AND two.a = a.source AND two.b = b.source
 LEFT JOIN one ab ON ab.lang = a.lang AND ab.a = a.source AND ab.b = b.source
 LEFT JOIN one ba ON ba.lang = a.lang AND ba.a = b.source AND ba.b = a.source
 LEFT JOIN own oa ON oa.lang = a.lang AND oa.source = a.source
 LEFT JOIN own ob ON ob.lang = a.lang AND ob.source = b.source
 LEFT JOIN every ON every.lang = a.lang"""
_TERMS = """SELECT lang, source, 'term' AS part, term AS item, f(p, q) AS value
 FROM (SELECT *, prob(sum(n) OVER (PARTITION BY lang, term), lang_total, kept) AS q FROM t) WHERE p > q
 QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY f(p, q) DESC, term) <= {0}"""


def _duck():
    """A database in memory that takes one core and writes no files."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "temp_directory": "", "preserve_insertion_order": False})


def _rows(con, sql: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    reader = con.sql(sql).to_arrow_reader(20_000)
    for batch in reader:
        if len(batch):
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, schema, strict=True)], schema=schema)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's documents; (lang, source, term) comes more than once only if the task holds too many."""
    con = _duck()
    con.execute("CREATE TABLE counts (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")

    def take(parts: list) -> None:
        columns = list(zip(*parts, strict=True))
        batch = pa.table({"doc": pa.array(columns[0], pa.int64()), **{k: pa.array(v, pa.string()) for k, v in zip(("lang", "source", "text"), columns[1:], strict=True)}})
        con.register("batch", batch)
        con.execute(_COUNT_BATCH)
        con.unregister("batch")

    parts, size, doc = [], 0, 0
    for whole in batches:
        for batch in by_bytes(whole):
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                doc += 1
                for part in chunks((text or "").encode().translate(TERM_BYTES)):
                    # The parts of one document are counted together, however many there are.
                    parts.append((doc, lang or "", source or "", part.decode()))
                    size += len(part)
                if size >= COUNTED_BYTES:
                    take(parts)
                    parts, size = [], 0
                    if con.execute("SELECT count(*) FROM counts").fetchall()[0][0] > HELD_ROWS:
                        con.execute(_ADD_UP.format("counts"))
                        if con.execute("SELECT count(*) FROM counts").fetchall()[0][0] > HELD_ROWS // 2:
                            yield from _rows(con, "SELECT * FROM counts", _COUNTED)
                            con.execute("DELETE FROM counts")
    if parts:
        take(parts)
    con.execute(_ADD_UP.format("counts"))
    yield from _rows(con, "SELECT * FROM counts", _COUNTED)
    con.close()
    give_back()


def _streamed(con, batches: Iterator[pa.RecordBatch]) -> bool:
    """Register a partition's rows as ``stream``, to be read once; False if it has none."""
    first = next(batches, None)
    if first is None:
        return False

    def every():
        yield first
        yield from batches

    con.register("stream", pa.RecordBatchReader.from_batches(first.schema, every()))
    return True


def _keeper(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duck()
        if _streamed(con, batches):
            con.execute(_ADD_UP.format("stream"))
            yield from _rows(con, _KEEP.format(least), _KEPT)
        con.close()
        give_back()

    return run


def _comparer(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duck()
        if _streamed(con, batches):
            for statement in _COMPARE:
                con.execute(statement)
            yield from _rows(con, _PAIRS, _PARTS)
            yield from _rows(con, _TERMS.format(top), _PARTS)
        con.close()
        give_back()

    return run


def _shards(rows: DataFrame, shard_rows: int) -> int:
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // shard_rows))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_documents: int = LEAST_DOCUMENTS, top: int = TOP, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(lang, source, part, item, value, rank): how much each source differs from each other one of its language, and by which terms from the language."""
    scratch = Scratch(docs.sparkSession, "divergence")
    read = docs.select(F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    counts = scratch.keep(read.mapInArrow(_counted, "lang string, source string, term string, n long, docs long"))
    dealt = counts.where("term != ''").repartition(_shards(counts, shard_rows), "lang", "term")
    kept = scratch.keep(dealt.mapInArrow(_keeper(least_documents), "lang string, source string, term string, n long, is_first long"))

    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("is_first").alias("kept"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = counts.where("term = ''").select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(whole, "lang", "left")
    groups = scratch.keep(groups.select("lang", "source", zero("total"), zero("lang_total"), zero("kept")))

    n = _shards(kept, shard_rows)
    terms = kept.select(F.pmod(F.xxhash64("lang", "term"), F.lit(n)).alias("shard"), "lang", "source", "term", "n")
    every = groups.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("shard"), "*")
    held = terms.unionByName(every, allowMissingColumns=True).repartition(n, "shard").drop("shard")
    parts = scratch.keep(held.mapInArrow(_comparer(top), "lang string, source string, part string, item string, value long"))

    sums = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    # Both sides of a pair, from one read of its sum.
    ways = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    pairs = sums.select("lang", "part", "value", F.explode(ways).alias("way")).select("lang", "way.source", "part", "way.item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).alias("rank")
    best = parts.where("part = 'term'").select("lang", "source", "part", "item", "value", rank).where(F.col("rank") <= top)
    return pairs.select("lang", "source", "part", "item", "value", rank).unionByName(best)
