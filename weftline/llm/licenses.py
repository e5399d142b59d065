"""License scans in DataFrame functions only: MinHash bands find templates, exact containment confirms.

A text's words (ASCII letters lower-cased, punctuation dropped) give five-word
shingles.  Templates of like size share a grid of overlapping windows, long
enough that any run of the template's length lies in one of them.  A set of
shingles has one band per bucket of its hashes (one-permutation MinHash with
``BUCKETS`` buckets), and a band's value is the least hash in the bucket.  A
template is retrieved for a window where any band has the same value in both.

Only a window that holds a template's band value can match in that band.  So the
values of all templates are looked up among a text's hashes, and bands are worked
out for the windows around what is found; the windows retrieved are those that
working out every band of every window gives.  ``miss`` bounds the probability
that a window holding a share ``CONTAINMENT`` of a template is not retrieved.
Every window that is retrieved is then compared shingle for shingle.  Templates
of one family differ in a few words; of those that a window holds enough of, only
the ones with the most shingles in it match there.

Templates are notices, file headers and whole texts (``license_texts``), each of
which holds for itself: a header that contains a notice matches both.  A template of
a few shingles must stand word for word: three quarters of one shingle are all of it.

Defined results: null and empty texts, and texts of under five words, match
nothing; repeated rows give repeated results; a null ``doc_id`` is carried; an empty
table gives an empty result; other columns don't take part.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.license_texts import TEMPLATES

SHINGLE = 5
CONTAINMENT = 0.75
BUCKETS = 256
MISS = 1e-3
DROPPED = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "-+")
BLANKS = "\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    """The words of a template, as ``shingle_hashes`` cuts them from a text column."""
    return [w for w in text.translate(str.maketrans(UPPER + BLANKS, LOWER + " " * len(BLANKS), DROPPED)).split(" ") if w]


@dataclass(frozen=True)
class Grid:
    """Windows of ``length`` shingles, one every ``stride``, for templates of up to ``most`` shingles."""

    most: int

    @property
    def stride(self) -> int:
        return max(1, self.most // 2)

    @property
    def length(self) -> int:
        return self.most + self.stride - 1

    def miss(self, size: int) -> float:
        """A bound on the probability of not retrieving a window that contains enough of ``size`` shingles.

        Of the shingles in common, each is the least of its bucket unless one of the
        others, the window's or the template's, falls into the bucket and is less.
        """
        need = math.ceil(CONTAINMENT * size)
        others = self.length - need + size - 1
        return min(1.0, others / (2 * BUCKETS)) ** need


def grids(templates: dict[str, str]) -> dict[Grid, list[str]]:
    out = defaultdict(list)
    for name, text in sorted(templates.items()):
        size = len(words_of(text)) - SHINGLE + 1
        if size < 1:
            raise ValueError(f"template {name} has under {SHINGLE} words")
        out[Grid(1 << (size - 1).bit_length())].append(name)
    for grid, names in out.items():
        for name in names:
            if grid.most > 1 and (miss := grid.miss(len(words_of(templates[name])) - SHINGLE + 1)) > MISS:
                raise ValueError(f"template {name} may be missed with probability {miss:.2g}")
    return dict(out)


def bucket(h: int) -> int:
    return h % BUCKETS


def band_values(hashes: list[int]) -> list[int]:
    """The least hash of each bucket that has one."""
    least: dict[int, int] = {}
    for h in hashes:
        least[bucket(h)] = min(h, least.get(bucket(h), h))
    return sorted(least.values())


def shingle_hashes(text: Column) -> Column:
    flat = F.translate(text, UPPER + BLANKS + DROPPED, LOWER + " " * len(BLANKS))
    words = F.filter(F.split(flat, " "), lambda w: w != "")
    last = lambda w: F.size(w) - F.lit(SHINGLE)
    hashed = lambda w: F.transform(F.sequence(F.lit(0), last(w)), lambda i: F.xxhash64(*(F.get(w, i + F.lit(k)) for k in range(SHINGLE))))
    return F.get(F.transform(F.array(words), lambda w: F.when(last(w) < 0, F.array().cast("array<bigint>")).otherwise(hashed(w))), F.lit(0))


def template_hashes(spark, templates: dict[str, str]) -> dict[str, list[int]]:
    rows = spark.createDataFrame(sorted(templates.items()), "name string, text string").select("name", shingle_hashes(F.col("text")).alias("h"))
    return {r["name"]: sorted(set(r["h"])) for r in rows.collect()}


def _candidates(h: Column, found: Column, grid: Grid, values: list[int]) -> Column:
    """Starts of the grid's windows that match a template in a band; ``found``: where band values stand in ``h``."""
    last = F.greatest(F.size(h) - F.lit(grid.length - grid.stride) - 1, F.lit(0))

    def around(i: Column) -> Column:
        first = F.greatest(F.ceil((i - grid.length + 1) / F.lit(float(grid.stride))).cast("int") * grid.stride, F.lit(0))
        return F.sequence(first, (i / F.lit(float(grid.stride))).cast("int") * grid.stride, F.lit(grid.stride))

    def retrieved(s: Column) -> Column:
        window = F.slice(h, s + 1, F.lit(grid.length))
        least = lambda t: ~F.exists(window, lambda y: (F.pmod(y, F.lit(BUCKETS)) == F.pmod(t, F.lit(BUCKETS))) & (y < t))
        return (s <= last) & F.exists(window, lambda t: t.isin(values) & least(t))

    return F.filter(F.array_distinct(F.flatten(F.transform(found, around))), retrieved)


def _confirmed(starts: Column, h: Column, grid: Grid, name: str, shingles: list[int]) -> Column:
    """(name, most, window, first, common, share) of each window, by its shingles in common with the template."""
    known = F.expr("array(" + ", ".join(f"{x}L" for x in shingles) + ")")

    def one(s: Column) -> Column:
        window = F.slice(h, s + 1, F.lit(grid.length))
        common = F.size(F.array_intersect(window, known))
        at = F.array_min(F.transform(F.filter(F.transform(window, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda w: F.array_contains(known, w["x"])), lambda w: w["i"]))
        return F.struct(F.lit(name).alias("name"), F.lit(grid.most).alias("most"), s.alias("window"), (s + at).alias("first"), common.alias("common"), (common / F.lit(float(len(shingles)))).alias("share"))

    return F.transform(starts, one)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document and template that one of its windows contains enough of.

    Columns: the key, ``license``, ``form`` (notice, header or text), ``containment`` (the best window's),
    ``first_word`` (the first word, from 0, of the template in the first such window) and ``n_windows``.
    """
    known = template_hashes(docs.sparkSession, templates)
    by_grid = grids(templates)
    values = {grid: sorted({v for n in names for v in band_values(known[n])}) for grid, names in by_grid.items()}
    every = sorted({v for own in values.values() for v in own})
    confirmed = [_confirmed(F.col(f"r.c{i}"), F.col("r.h"), grid, n, known[n]) for i, (grid, names) in enumerate(by_grid.items()) for n in names]

    # One expression from text to candidate windows, so that no filter makes Spark cut a text twice.
    def of_hashes(h: Column) -> Column:
        found = F.filter(F.when(F.size(h) > 0, F.sequence(F.lit(0), F.size(h) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.get(h, i).isin(every))
        return F.get(F.transform(F.array(found), lambda at: F.struct(h.alias("h"), *(_candidates(h, at, grid, own).alias(f"c{i}") for i, (grid, own) in enumerate(values.items())))), F.lit(0))

    retrieved = F.get(F.transform(F.array(shingle_hashes(F.coalesce(F.col(text), F.lit("")))), of_hashes), F.lit(0))
    rows = docs.select(F.col(key), F.explode(F.array(retrieved)).alias("r"))
    matches = rows.select(key, F.explode(F.array(F.filter(F.concat(*confirmed), lambda m: m["share"] >= CONTAINMENT))).alias("m")).where(F.size("m") > 0)
    better = lambda m, o: (o["most"] == m["most"]) & (o["window"] == m["window"]) & (o["common"] > m["common"])
    matches = matches.withColumn("m", F.filter("m", lambda m: ~F.exists(F.col("m"), lambda o: better(m, o))))

    def summed(name: Column) -> Column:
        own = F.filter("m", lambda m: m["name"] == name)
        parts = F.split(name, "/")
        return F.struct(
            parts[0].alias("license"),
            F.get(parts, F.lit(1)).alias("form"),
            F.array_max(F.transform(own, lambda m: m["share"])).alias("containment"),
            F.array_min(F.transform(own, lambda m: m["first"])).cast("long").alias("first_word"),
            F.size(own).cast("long").alias("n_windows"),
        )

    return matches.select(key, F.inline(F.transform(F.array_distinct(F.transform("m", lambda m: m["name"])), summed)))
