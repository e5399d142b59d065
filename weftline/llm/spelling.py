"""Spelling variants among a corpus' words: two sorted dictionaries, read forwards and backwards.

Two words are near if one code point is inserted, deleted or replaced between
them.  Where they first differ is the edit's place; all before it and all after it
is equal.  So either the first half stands unchanged, and the words are neighbours in the sorted
dictionary, or the second half, and they are neighbours in the dictionary of
reversed words.  Words of one length are compared with each other, and words of
one length with those one longer.

A block is what shares ``lo`` code points at the start and all from ``hi`` on, and
is searched for pairs whose edit lies in [lo, hi).  A block of over ``BLOCK`` words is divided: one part shares the first half of
[lo, hi) as well and is searched for edits in the second, the other part the other way round.  Ranges are disjoint,
so a pair is found once.  Where a range has one place only, words of a block differ
in one letter, so its 90 letters bound the block.

Blocks are sorted ranges of the dictionaries, dealt out by range; a task compares a block's words in numpy
and hands on, for each word, how many near words it met and the best of them.  No pair leaves a task.

Defined results: a null text has no words; a null id stands as empty text before the colon; repeated rows count
each; an empty table gives an empty result; other columns aren't read.  Texts are counted in parts of about a
megabyte that end at a blank or line feed, so memory grows with the longest run without either.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, by_bytes, chunks, give_back, if_small, ragged

#: Letters of a run after A-Z were lower-cased: all lie in one byte of Latin-1.
RUN = re.compile("[a-zA-ZÀ-ÿ]+")
#: The one run in so many of a document that is misspelt on purpose.
SPOILT = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A word's near word is its form if it is so many times as frequent.
TIMES = 2
#: Words of a block that is compared as it is; a larger one is divided.
BLOCK = 128
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 300_000
#: Bytes that are compared at a time.
COMPARED = 4 << 20


def runs(data: bytes) -> list[str]:
    return RUN.findall(data.lower().decode())  # lower() of bytes changes A-Z only


def as_counted(run: str, start: int, spoilt: int = SPOILT) -> str:
    """A document's run as it is counted; ``start`` is the checksum of its id and the colon."""
    h = zlib.crc32(run.encode(), start)
    if h % spoilt:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counter(least_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def hand_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for whole in batches:
            for batch in by_bytes(whole):
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if not text:
                        continue
                    start = zlib.crc32(f"{'' if key is None else key}:".encode())
                    for part in chunks(text.encode()):
                        for found, n in Counter(runs(part)).items():
                            word = as_counted(found, start)
                            if len(word) >= least_length:
                                counts[word] += n
                        if len(counts) >= HELD_WORDS:
                            yield hand_on()
        if counts:
            yield hand_on()
        give_back()

    return run


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of every word that is long and frequent enough."""
    read = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return read.mapInArrow(_counter(least_length), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _key(word: Column, length: Column) -> Column:
    """What a block's words share, beside its own numbers: their start, and their end read backwards."""
    tail = F.col("m") + F.col("longer") - F.col("hi")
    start, end = F.substring(word, F.lit(1), F.col("lo")), F.reverse(F.substring(word, length - tail + 1, tail))
    return F.concat_ws(" ", "m", "longer", "lo", "hi", start, end)


def dictionaries(counted: DataFrame) -> DataFrame:
    """(word, n, m, longer, lo, hi, key): each word in the forward and the reversed dictionary.

    ``m`` is the length of a block's shorter words; with ``longer`` 1 they meet those
    one longer, with 0 each other.
    """
    length = F.length("word")
    roles = F.array(*(F.struct(m.alias("m"), F.lit(longer).alias("longer")) for m, longer in ((length, 0), (length, 1), (length - 1, 1))))
    placed = counted.select("word", "n", F.explode(roles).alias("role")).select("word", "n", "role.*")
    places = F.col("m") + F.col("longer")
    half = F.floor((places + 1) / 2).cast("int")
    sides = F.array(F.struct(half.alias("lo"), places.alias("hi")), F.struct(F.lit(0).alias("lo"), half.alias("hi")))
    return placed.select("*", F.explode(sides).alias("side")).select("word", "n", "m", "longer", "side.*").withColumn("key", _key(F.col("word"), length))


def divided(rows: DataFrame) -> DataFrame:
    """Both halves of each row's block."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct("lo", mid.alias("hi")), F.struct(mid.alias("lo"), "hi"))
    return rows.select("word", "n", "m", "longer", F.explode(halves).alias("side")).select("word", "n", "m", "longer", "side.*").withColumn("key", _key(F.col("word"), F.length("word")))


def blocks(counted: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """All blocks that are small enough to be compared, as rows of ``dictionaries``."""
    rows, done = scratch.keep(dictionaries(counted)), []
    while True:
        sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.min(F.length("word")).alias("low"), F.max(F.length("word")).alias("high"), F.first("longer").alias("longer"), F.first(F.col("hi") - F.col("lo")).alias("places"))
        over = scratch.keep(sizes.where((F.col("size") > block) & (F.col("places") > 1)).select("key", ((F.col("longer") == 0) | (F.col("low") < F.col("high"))).alias("of_use")))
        done.append(rows.join(if_small(over.select("key")), "key", "left_anti"))
        large = over.where("of_use").select("key")  # the others hold words of one length, which meet those one longer only
        if large.isEmpty():
            break
        rows = scratch.keep(divided(rows.join(if_small(large), "key", "left_semi")))
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every


def near_in(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Where each row of ``short`` and the same row of ``long`` differ, if that is their only edit; else -1.

    Rows are letters; those of ``long`` are as long or one longer.
    """
    m = short.shape[1]
    other = short != long[:, :m]
    first = np.where(other.any(1), other.argmax(1), m)
    if long.shape[1] == m:
        return np.where(other.sum(1) == 1, first, -1)
    behind = (short != long[:, 1:])[:, ::-1]
    last = np.where(behind.any(1), m - 1 - behind.argmax(1), -1)
    return np.where(last < first, first, -1)


def _pairs(start: np.ndarray, size: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (earlier, later) members of blocks, about ``limit`` at a time."""
    members = ragged(start, size)
    after = np.repeat(start + size, size) - members - 1
    ends, at = np.cumsum(after), 0
    while at < len(members):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield np.repeat(members[at:end], after[at:end]), ragged(members[at:end] + 1, after[at:end])
        at = end


class Block:
    """Rows of whole blocks with one ``m`` and one ``longer``."""

    def __init__(self, m: int, longer: int, words: list[bytes], lo: np.ndarray, hi: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.lo, self.hi = lo, hi
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.letters = np.frombuffer(b"".join(w.ljust(m + longer) for w in words), np.uint8).reshape(len(words), m + longer)
        self.m, self.longer, self.start, self.size = m, longer, start, size

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows that are near, with the edit in their block's range."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for a, b in _pairs(self.start, self.size, max(1, COMPARED // (self.m + 1))):
            if self.longer:
                apart = self.lengths[a] != self.lengths[b]
                a, b = a[apart], b[apart]
                a, b = np.where(self.lengths[a] < self.lengths[b], a, b), np.where(self.lengths[a] < self.lengths[b], b, a)
            at = near_in(self.letters[a][:, : self.m], self.letters[b])
            found = (at >= self.lo[a]) & (at < self.hi[a])
            out.append((a[found], b[found]))
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


_MET = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())])


def _met(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """For each word of whole blocks that has near words in them: how many, and the most frequent one."""
    key, m, longer = (table.column(c).to_numpy() for c in ("key", "m", "longer"))
    lo, hi, n = (table.column(c).to_numpy() for c in ("lo", "hi", "n"))
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    starts, sizes = starts[sizes > 1], sizes[sizes > 1]
    if not len(starts):
        return
    text = table.column("word").to_pylist()
    for one in sorted(set(zip(m[starts].tolist(), longer[starts].tolist(), strict=True))):
        mine = (m[starts] == one[0]) & (longer[starts] == one[1])
        rows = ragged(starts[mine], sizes[mine])
        words = [text[i].encode("latin-1") for i in rows]
        size = sizes[mine]
        a, b = Block(*one, words, lo[rows], hi[rows], np.cumsum(size) - size, size).near()
        if not len(a):
            continue
        # Rows of one word in several blocks count as that word; letters sort as their bytes do.
        distinct, which = np.unique(np.array(words, object), return_inverse=True)
        freq = np.zeros(len(distinct), np.int64)
        freq[which] = n[rows]
        word, other = which[np.concatenate([a, b])], which[np.concatenate([b, a])]
        order = np.lexsort((other, -freq[other], word))
        word, other = word[order], other[order]
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        name = [w.decode("latin-1") for w in distinct]
        yield pa.RecordBatch.from_arrays(
            [pa.array([name[i] for i in word[first]], pa.string()), pa.array(np.diff(np.append(first, len(word))), pa.int64()), pa.array(freq[other[first]], pa.int64()), pa.array([name[i] for i in other[first]], pa.string())],
            schema=_MET,
        )


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted range of blocks; a batch's last block waits for the next batch."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        key = table.column("key").to_numpy()
        cut = int(np.searchsorted(key == key[-1], True))  # its rows are the last ones
        if cut:
            yield from _met(table.slice(0, cut))
        held = table.slice(cut)
    if held is not None:
        yield from _met(held)
    give_back()


def near_words(counted: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(word, n_near, near_n, near) of every word that has near ones; ``near`` is the most frequent, then the smallest."""
    sorted_ = blocks(counted, scratch, block).repartitionByRange("key").sortWithinPartitions("key")
    met = sorted_.select("key", "word", "n", "m", "longer", "lo", "hi").mapInArrow(_scan, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of each word in ``forms`` (word, form): where following forms ends.

    A form is at least twice as frequent as its word, so there are no circles; each round doubles the steps that are taken.
    """
    up = scratch.keep(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = up.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        after = scratch.keep(up.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")))
        scratch.drop(up)
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        up = after.select("word", "root")
        up._scratch_path = after._scratch_path


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", times: int = TIMES, block: int = BLOCK, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word with the more frequent spelling that it may be a variant of."""
    scratch = Scratch(docs.sparkSession, "spelling")
    counted = scratch.keep(words(docs, key, text, least_length, least_count))
    near = near_words(counted, scratch, block)
    better = F.col("near_n") >= times * F.col("n")
    told = scratch.keep(counted.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(better, F.col("near")).alias("form"), F.when(better, F.col("near_n")).alias("form_n")))
    ends = roots(told.where("form is not null"), scratch)
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
