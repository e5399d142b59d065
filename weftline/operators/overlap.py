"""The best partners of each row by capped counts of common tokens, without ever making the pairs.

Both sides are dealt to shares of bounded size, and each share of the one meets each share of the other once, in one
task.  The task turns its sections into lists by token, adds up each change's lists in numpy and hands on the best few of
its own.  So what is moved is both tables, each as often as the other has shares, and ``limit`` rows for each change and share;
pairs, however many a frequent token makes, stay inside a task as counts.  A token's list can't be longer than a share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Tokens that a share of either side is meant to hold.
SHARE_TOKENS = 2_000_000


def _shares(tokens: int, share_tokens: int) -> int:
    return max(1, -(-tokens // share_tokens))


class Lists:
    """For each component, the sections that hold a token."""

    def __init__(self, sections: pa.Table, components: list[str]):
        self.n = len(sections)
        self.codes: dict[str, int] = {}
        self.components = []
        for c in components:
            lists = sections.column(c).combine_chunks()
            flat = lists.flatten().to_pylist()
            codes = np.fromiter((self.codes.setdefault(t, len(self.codes)) for t in flat), np.int64, len(flat))
            sizes = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()], np.int64)
            owner = np.repeat(np.arange(self.n), sizes)
            order = np.argsort(codes, kind="stable")
            self.components.append((codes[order], owner[order]))
        self.spans = []
        for codes, owner in self.components:
            starts = np.searchsorted(codes, np.arange(len(self.codes) + 1))
            self.spans.append((starts[:-1], np.diff(starts), owner))

    def scores(self, tokens: list[str], tables: list[tuple[float, int]]) -> np.ndarray:
        known = np.array([i for t in tokens if (i := self.codes.get(t)) is not None], np.int64)
        total = np.zeros(self.n)
        for (starts, sizes, owner), (weight, cap) in zip(self.spans, tables, strict=True):
            s, n = starts[known], sizes[known]
            if not n.sum():
                continue
            ends = np.cumsum(n)
            held = owner[np.arange(ends[-1]) + np.repeat(s - ends + n, n)]
            total += np.minimum(np.bincount(held, minlength=self.n), cap) * weight
        return total


def top_overlaps(changes: DataFrame, sections: DataFrame, change: str, section: str, components: dict[str, tuple[float, int]], limit: int = 3, tokens: str = "tokens", share_tokens: int = SHARE_TOKENS) -> DataFrame:
    """(change, section, score, rank): the best sections of each change, by score and then the section's key.

    ``changes``: change, tokens (distinct).  ``sections``: section and an array of distinct tokens for each of ``components``,
    which give (weight, cap).  A section without a common token is no partner; null arrays are empty.
    """
    names = list(components)
    tables = [components[c] for c in names]
    size = lambda c: F.coalesce(F.sum(F.greatest(F.size(c), F.lit(1))), F.lit(0))
    n_changes = _shares(changes.agg(size(tokens)).first()[0], share_tokens)
    n_sections = _shares(sections.agg(size(F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in names)))).first()[0], share_tokens)
    # At least as many tasks as cores, if there is one share of each.
    n_changes = max(n_changes, -(-changes.sparkSession.sparkContext.defaultParallelism // n_sections))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = changes.select(own(change, n_changes).alias("_share"), every(n_sections).alias("_block"), F.col(change).alias("change"), F.coalesce(tokens, F.array().cast("array<string>")).alias("tokens"))
    right = sections.select(every(n_changes).alias("_share"), own(section, n_sections).alias("_block"), F.col(section).alias("section"), *names)
    kinds = {"change": dict(changes.dtypes)[change], "section": dict(sections.dtypes)[section]}

    def meet(one: pa.Table, other: pa.Table) -> pa.Table:
        other = other.sort_by("section")  # a section's place tells its order
        keys, found = other.column("section"), ([], [], [])
        if len(one) and len(other):
            lists, change_keys = Lists(other, names), one.column("change")
            for row, held in enumerate(_token_lists(one)):
                score = lists.scores(held, tables)
                some = np.flatnonzero(score)
                best = some[np.lexsort((some, -score[some]))[:limit]] if len(some) <= 4 * limit else _best(score, some, limit)
                found[0].extend([row] * len(best))
                found[1].extend(best.tolist())
                found[2].extend(score[best].tolist())
            return pa.table({"change": change_keys.take(pa.array(found[0], pa.int64())), "section": keys.take(pa.array(found[1], pa.int64())), "score": pa.array(found[2], pa.float64())})
        return pa.table({"change": one.column("change").slice(0, 0), "section": keys.slice(0, 0), "score": pa.array([], pa.float64())})

    met = left.groupBy("_share", "_block").cogroup(right.groupBy("_share", "_block")).applyInArrow(meet, f"change {kinds['change']}, section {kinds['section']}, score double")
    rank = F.row_number().over(Window.partitionBy("change").orderBy(F.col("score").desc(), "section"))
    return met.withColumn("rank", rank).where(F.col("rank") <= limit).select(F.col("change").alias(change), F.col("section").alias(section), "score", "rank")


def _token_lists(changes: pa.Table) -> Iterator[list[str]]:
    for batch in changes.select(["tokens"]).to_batches(max_chunksize=256):
        yield from batch.column(0).to_pylist()


def _best(score: np.ndarray, some: np.ndarray, limit: int) -> np.ndarray:
    """The first places under falling score and rising place, without sorting them all."""
    least = -np.partition(-score[some], limit - 1)[limit - 1]
    held = some[score[some] >= least]
    return held[np.lexsort((held, -score[held]))[:limit]]
