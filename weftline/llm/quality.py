"""Quality rules as a short-circuit cascade, in DataFrame functions only.

The base figures of a text are computed for every row.  The method's own rules
run only on rows that the base rule lets pass, one after another: a ``CASE``
stops at the first rule that rejects.  Their order comes from a sample, on which
one job counts what each rule rejects, and those that reject any are timed; they stand in falling order of
rejection per cost, before those that reject nothing there, which keep the order in which they were given.  The order changes how much work is done and which of several
rejecting rules is named in ``rejected_by``, never the verdict ``kept``.

Defined results: a null or blank text has no words, so ``base_failed``; a null
``doc_id`` is kept as it is; repeated rows and ties each get their own row; a
window that occurs twice counts each of its words once however windows overlap;
an empty table gives an empty result.  ``judge`` replaces input columns that have
its results' names, ``passing`` leaves every input column as it is.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import ascii_lower

SYMBOLS = "#*$%&|<>"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Characters on which a rule's cost is measured; short samples are repeated up to it.
SAMPLE_CHARS = 4_000_000


@dataclass(frozen=True)
class Rule:
    """Rejects where ``reject`` is true; ``reject`` is built from a text column and the base figures."""

    name: str
    reject: Callable[[Column, dict[str, Column]], Column]


#: A share of the text's words or characters, over which a text is junk.  Clean prose stays far from each.
RULES = (
    Rule("symbol_words", lambda t, f: f["n_symbols"] * 10 > f["n_words"]),
    Rule("word_length", lambda t, f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 20 * f["n_words"])),
    Rule("few_letters", lambda t, f: F.length(F.regexp_replace(t, r"[\p{L}\p{M}]+", "")) * 10 > F.length(t) * 6),
    Rule("digits", lambda t, f: F.length(t) - F.length(F.translate(t, "0123456789", "")) > F.length(t) * 0.5),
    Rule("repeated_lines", lambda t, f: f["n_dup_lines"] * 2 > F.size(F.split(t, "\n"))),
    Rule("few_distinct_words", lambda t, f: F.size(F.array_distinct(F.split(ascii_lower(t), " "))) * 50 < f["n_words"]),
    Rule("shouting", lambda t, f: F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")) * 2 > F.length(t)),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _non_blank_words(text: Column) -> Column:
    flat = F.translate(text, BLANKS[1:], " " * (len(BLANKS) - 1))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def _window_hashes(words: Column) -> Column:
    """A 64-bit hash of each five neighbouring words; fewer words give none."""
    last = F.size(words) - F.lit(WINDOW)
    at = lambda i, k: F.get(words, i + F.lit(k))
    return F.when(last < 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(at(i, k) for k in range(WINDOW)))))


def _covered(hashes: Column) -> Column:
    """Words in windows that occur again: neighbours in hash order give them, then overlaps are merged."""

    def repeated(s: Column) -> Column:
        same = F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def width(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(_let(ordered, repeated), width))


def _figures(t: Column) -> Column:
    """All base figures of a text as one struct; words and hashes are bound once (``_let``)."""
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, BLANKS, "") != "")

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _let(_window_hashes(words), _covered).cast("long").alias("n_repeat_words"),
        )

    return _let(_non_blank_words(t), of_words)


def base_figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    # Rows come out of a generator, which Spark pushes no filter through: the figures are worked out once.
    out = docs.select("*", F.inline(F.array(_figures(t))))
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def order_rules(docs: DataFrame, rules=RULES, text: str = "text", sample_rows: int = 256, sample_chars: int = 100_000, fraction: float = 0.02) -> tuple[list[Rule], list[tuple[str, float, float]]]:
    """The rules in falling order of rejection per cost, and (name, seconds a text, rejected share).

    The sample holds at most ``sample_rows`` texts of at most ``sample_chars``
    characters, so at most their product comes to the driver.  It only orders
    the rules; every row meets every rule that the order doesn't spare it.
    """
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.length("text") <= sample_chars)
    passed = lambda rows: base_figures(rows).where(~F.col("base_failed")).drop("base_failed").limit(sample_rows).collect()
    rows = passed(texts.sample(fraction, seed=1)) or passed(texts)
    if not rows:
        return list(rules), [(r.name, 0.0, 0.0) for r in rules]
    schema = T.StructType([T.StructField("text", T.StringType())] + [T.StructField(f, T.LongType()) for f in FIGURES])
    # Each text many times over, so that a rule's own work stands out from what any job takes.
    times = max(1, SAMPLE_CHARS // max(1, sum(len(r["text"]) for r in rows)))
    sample = docs.sparkSession.createDataFrame([tuple(r) for r in rows], schema).coalesce(1).withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(times))))
    figures = {f: F.col(f) for f in FIGURES}

    def timed(reject: Column) -> float:
        job, took = sample.select(F.count_if(reject).alias("n")), []
        for _ in range(3):
            began = time.perf_counter()
            job.collect()
            took.append(time.perf_counter() - began)
        return min(took)

    # What each rule rejects, of all rules in one job.
    shares = sample.agg(*(F.count_if(r.reject(F.col("text"), figures)).alias(f"r{i}") for i, r in enumerate(rules))).first()
    share = {r.name: shares[f"r{i}"] / (len(rows) * times) for i, r in enumerate(rules)}
    rejecting = [r for r in rules if share[r.name]]
    seconds = dict.fromkeys(share, 0.0)
    if len(rejecting) > 1:  # otherwise there is nothing to weigh
        idle = timed(F.length("text") < 0)
        seconds |= {r.name: max(timed(r.reject(F.col("text"), figures)) - idle, 0.0) / (len(rows) * times) for r in rejecting}
    # Costs in powers of four times a small unit: what differs less is noise, and rules keep their places; so do those that reject nothing here.
    cost = {name: 4.0 ** round(math.log(max(s, 1e-7), 4)) for name, s in seconds.items()}
    return sorted(rules, key=lambda r: -share[r.name] / cost[r.name]), [(r.name, seconds[r.name], share[r.name]) for r in rules]


def judge(docs: DataFrame, rules=RULES, text: str = "text", ordered: list[Rule] | None = None) -> DataFrame:
    """``docs`` with the base figures, ``kept`` and ``rejected_by`` (a rule's name, ``base`` or null)."""
    clash = [c for c in (*FIGURES, "base_failed", "kept", "rejected_by") if c in docs.columns]
    figured = base_figures(docs.drop(*clash), text)
    ordered = ordered or order_rules(docs, rules, text)[0]
    t, figures = F.coalesce(F.col(text), F.lit("")), {f: F.col(f) for f in FIGURES}
    verdict = F.when(F.col("base_failed"), F.lit("base"))
    for rule in ordered:
        verdict = verdict.when(rule.reject(t, figures), F.lit(rule.name))
    return figured.withColumn("rejected_by", verdict).withColumn("kept", F.col("rejected_by").isNull())


def passing(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns and no others."""
    whole = docs.select(F.struct(*docs.columns).alias("_whole"), F.col(text).alias("text"))
    return judge(whole, rules).where("kept").select("_whole.*")
