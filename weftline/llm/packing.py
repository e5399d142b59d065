"""Packing by power-of-two decomposition: a sequence holds one piece of one document and needs no padding.

A document's ids, with the end id after them, are cut into pieces whose lengths
are powers of two: as many of ``LIMIT`` as fit, then the binary digits of the
rest, longest first.  Pieces of equal length form a bucket, named by the length's
logarithm; each is a sequence of its own, so none crosses documents and none is
padded.  ``write_buckets`` lays the buckets out as folders, from which batches of
equal lengths are read.

Ids are those of the tokenizer for the whole text.  It drops blanks and never
joins characters across them, so texts are cut at blanks and line feeds, each
distinct word of a block of documents is encoded once, and ids are gathered.

Defined results: a null or empty text gives the end id alone; a null ``doc_id``
is carried; repeated rows give pieces of their own with their own sequences; an
empty table gives no pieces.  ``sequence_id`` is unique; which number a piece gets
depends on how rows are dealt to tasks.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import WordCodes, per_batch, ragged, small_batches, tokenizer_file

LIMIT = 4096
#: Encoded units that a task remembers; fewer take less memory and more encoding.
REMEMBERED = 500_000
END_ID = 2
#: The tokenizer's name for its end, which it knows in any text: a mark between words that are encoded together.
MARK, MARK_ID = "<|endoftext|>", 49407
#: Latin letters that stay letters when they are lower-cased.
LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")


def split_words(text: str) -> list[str]:
    """Parts of a text between blanks and line feeds, some empty.  Other white space stays inside; the tokenizer deals with it.

    ASCII letters are lower-cased here, as the tokenizer would, unless the text may hold one of its special strings.
    """
    own = text if "<|" in text else text.encode().lower().decode()
    return own.replace("\n", " ").split(" ")


class WordIds:
    """Ids of texts by way of their distinct words, and of those by way of distinct units.

    A word that is letters and then full stops or commas has two units, for the
    tokenizer cuts there itself; any other word is one unit.  So is one whose last
    letter isn't a plain one: lower-casing may end it in a mark, which the tokenizer
    keeps with the full stop.
    """

    def __init__(self, file: str, remembered: int = REMEMBERED):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        if self.tokenizer.token_to_id(MARK) != MARK_ID:
            raise ValueError(f"{file} doesn't have {MARK} as {MARK_ID}")
        #: Which ids are a word's last piece.
        self.closing = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.closing[i] = piece.endswith("</w>")
        self.remembered = remembered
        self.units: WordCodes | None = None
        self.reset()

    def reset(self) -> None:
        """Forget all words, and units too if their table is full: units cost the encoding, words only a look at their units."""
        self.codes, self.flat = WordCodes(self.remembered // 2), np.zeros(0, np.uint32)
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.units is None or self.units.full():
            self.units, self.unit_flat = WordCodes(self.remembered), np.zeros(0, np.uint32)
            self.unit_starts, self.unit_lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each unit has.

        Units of letters have one last piece each, so they are encoded with blanks between them; the
        tokenizer's mark stands between others; units that may hold a special string are encoded alone.
        """
        kind = np.fromiter((0 if LETTERS.fullmatch(u) else 2 if "<|" in u else 1 for u in units), np.int8, len(units))
        parts, lengths = [], np.zeros(len(units), np.int64)
        for way in (0, 1, 2):
            at = np.flatnonzero(kind == way)
            for lot in range(0, len(at), 20_000):
                some = at[lot : lot + 20_000]
                ids, sizes = (self._letters, self._marked, self._alone)[way]([units[i] for i in some])
                parts.append(ids)
                lengths[some] = sizes
        # From the order of the ways to that of the units.
        order = np.argsort(kind, kind="stable")
        starts = np.empty(len(units), np.int64)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        every = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        return every[ragged(starts, lengths)], lengths

    def _joined(self, units: list[str], between: str, after: list[int]) -> np.ndarray:
        together = [between.join(units[at : at + 500]) for at in range(0, len(units), 500)]
        ids = [np.array(e.ids + after, np.uint32) for e in self.tokenizer.encode_batch_fast(together, add_special_tokens=False)]
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32)

    def _letters(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._joined(units, " ", [])
        ends = np.flatnonzero(self.closing[ids])
        if len(ends) != len(units):
            return self._marked(units)
        return ids, np.diff(ends, prepend=-1)

    def _marked(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._joined(units, MARK, [MARK_ID])
        ends = np.flatnonzero(ids == MARK_ID)
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def _alone(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [np.array(self.tokenizer.encode(u, add_special_tokens=False).ids, np.uint32) for u in units]
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)

    def learn(self) -> None:
        new = self.codes.words[len(self.starts) :]
        if not new:
            return
        pairs = []
        for w in new:
            core = w.rstrip(".,") if w[-1:] in (".", ",") else w
            if len(core) < len(w) and core.isalpha() and core[-1] < "\u0250" and core[-1] != "İ":
                pairs += (self.units[core], self.units[w[len(core) :]])
            else:
                pairs += (self.units[w], -1)
        unseen = self.units.words[len(self.unit_starts) :]
        if unseen:
            ids, lengths = self.encode(unseen)
            self.unit_starts = np.concatenate([self.unit_starts, len(self.unit_flat) + np.cumsum(lengths) - lengths])
            self.unit_flat, self.unit_lengths = np.concatenate([self.unit_flat, ids]), np.concatenate([self.unit_lengths, lengths])
        pairs = np.array(pairs, np.int64)
        sizes = np.where(pairs >= 0, self.unit_lengths[pairs], 0)
        lengths = sizes.reshape(-1, 2).sum(1)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, self.unit_flat[ragged(self.unit_starts[pairs], sizes)]])

    def of(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each document has."""
        self.learn()
        codes = np.concatenate(words) if words else np.zeros(0, np.int32)
        lengths = self.lengths[codes]
        ids = self.flat[ragged(self.starts[codes], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        return ids, np.diff(ends[at])


def cut(length: int, limit: int = LIMIT) -> list[int]:
    """Piece lengths of a document of ``length`` ids, longest first."""
    rest = length % limit
    return [limit] * (length // limit) + [1 << b for b in range(limit.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, file: str | None = None, key: str = "doc_id", text: str = "text", limit: int = LIMIT, end_id: int = END_ID, keep_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket) of each piece; with ``keep_ids`` also ``ids``.

    ``limit`` must be a power of two.
    """
    if limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    small_batches(docs.sparkSession)
    file = file or tokenizer_file("word_bpe_49k.json")

    def make():
        words = WordIds(file, remembered)

        def one(keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
            cols: list[list] = [[], [], [], [], [], []]

            def settle(first: int, coded: list[np.ndarray]) -> None:
                ids, sizes = words.of(coded)
                at = 0
                for i, n in enumerate(sizes.tolist(), first):
                    own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    start = 0
                    for length in cut(n + 1, limit):
                        part = own[start : start + length]
                        for col, v in zip(cols, (i, start, length, zlib.crc32(part), n + 1, part.astype(np.int32) if keep_ids else None), strict=True):
                            col.append(v)
                        start += length
                if words.codes.full() or words.units.full():
                    words.reset()

            first, coded, held = 0, [], 0
            for i, t in enumerate(texts.to_pylist()):
                own = np.concatenate([words.codes.of(split_words(x)) for x in _parts(t)] or [np.zeros(0, np.int32)]) if t else np.zeros(0, np.int32)
                coded.append(own)
                held += len(own)
                if held > 200_000:
                    settle(first, coded)
                    first, coded, held = i + 1, [], 0
            settle(first, coded)
            out = [keys.take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:5])]
            if keep_ids:
                sizes = np.append(0, np.cumsum(cols[2])).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(cols[5]) if cols[5] else np.zeros(0, np.int32))))
            return pa.RecordBatch.from_arrays(out, names=names)

        return one

    names = ["k", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
    kind = dict(docs.dtypes)[key]
    schema = f"k {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    pieces = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(per_batch(make, ["k", "t"]), schema)
    numbered = pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return numbered.withColumn("bucket", F.log2("length").cast("int")).withColumnRenamed("k", key)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """``pieces`` as Parquet with a folder for each bucket.  Tasks write what they hold; nothing is dealt out by bucket, for one may hold most rows."""
    pieces.write.partitionBy("bucket").parquet(path)


def _parts(t: str, limit: int = 1 << 20):
    """``t`` cut at blanks into parts of about ``limit`` characters."""
    at = 0
    while len(t) - at > limit:
        cut_at = max(t.rfind(" ", at, at + limit), t.rfind("\n", at, at + limit))
        if cut_at <= at:
            ahead = [x for x in (t.find(" ", at + limit), t.find("\n", at + limit)) if x >= 0]
            if not ahead:
                break
            cut_at = min(ahead)
        yield t[at:cut_at]
        at = cut_at
    yield t[at:]
