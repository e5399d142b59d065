"""SentencePiece encoding and decoding by shared-prefix Viterbi.

Blanks are marked and a mark is put before the text, as the vocabulary wants it.
The segmentation of a text is the concatenation of those of its marked words (no
piece goes from another character to a mark).

The vocabulary is one of merges: of neighbouring pieces whose union is a piece,
the pair whose union scores best is merged first, the leftmost of equals.  What
that leads to can be found by a forward pass.  Merges inside two neighbouring
pieces don't depend on what lies around them, so a segmentation is the library's
exactly if each two neighbours in it are what merging gives for the two of them
alone.  A transition of the lattice is therefore possible or not, a prefix has one
best path, and the last piece of it is all that a longer prefix needs to know.

A block's distinct marked words are sorted, which walks their trie depth first: a
word keeps the forward states of the prefix that it shares with the one before it
and works out only the rest.  Characters in no piece are given as byte pieces.

Defined results: a null text is empty, has no pieces and decodes to the empty
text; repeated rows each get their own row; a null ``doc_id`` is carried; an empty
table gives an empty result.  A mark that stands in the text itself counts as a
blank, as in the library, so such a text decodes to one with blanks there, and
``round_trip`` is false.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import WordCodes, per_batch, ragged, tokenizer_file

MARK = "▁"
WORD = re.compile(r" *[^ \n]+| +|\n")
#: Below the lowest score of the vocabulary: what a character without a piece costs.
UNKNOWN_PENALTY = 10.0
#: Pairs of pieces that a task remembers before it starts anew.
PAIRS = 400_000


class Vocabulary:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=file)
        ids = range(model.vocab_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): (model.get_score(i), i) for i in plain}
        self.byte_id = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        self.unknown = min(s for s, _ in self.score.values()) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.score))
        by_last: dict[str, set[int]] = {}
        for p in self.score:
            by_last.setdefault(p[-1], {1}).add(len(p))
        #: Lengths that pieces with a given last character have, longest first.
        self.lengths = {c: sorted(n, reverse=True) for c, n in by_last.items()}
        self.gain = {p: found[0] for p, found in self.score.items()}
        self.known: dict[tuple[str, str], bool] = {}
        self.spelled = np.empty(model.vocab_size(), object)
        self.spelled[:] = b""
        for p, (_, i) in self.score.items():
            self.spelled[i] = p.replace(MARK, " ").encode()
        for b, i in self.byte_id.items():
            self.spelled[i] = bytes([b])

    def merged(self, text: str) -> list[str]:
        """What merging gives for a short text."""
        parts, get, none = list(text), self.gain.get, -1e300
        gains = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while gains and (top := max(gains)) > none:
            at = gains.index(top)  # the leftmost of equals
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del gains[at]
            if at < len(gains):
                gains[at] = get(parts[at] + parts[at + 1], none)
            if at:
                gains[at - 1] = get(parts[at - 1] + parts[at], none)
        return parts

    def fits(self, before: str, piece: str) -> bool:
        """Whether ``piece`` can follow the piece ``before`` (empty at a word's start); remembered for later."""
        if len(self.known) >= PAIRS:
            self.known.clear()
        out = self.known[before, piece] = (not before or before + piece not in self.gain) and self.merged(before + piece) == ([before, piece] if before else [piece])
        return out

    def encode(self, words: list[str]) -> list[tuple[tuple[int, ...], float]]:
        """Ids and score of each word; blanks in words are marks."""
        out: list = [None] * len(words)
        get, lengths, known, alone = self.score.get, self.lengths, self.known, (1,)
        # The forward state of a prefix: its last piece, and the ids and the score of its best path.
        last, path, total, before = [""], [()], [0.0], ""
        for n in sorted(range(len(words)), key=words.__getitem__):
            word = words[n].replace(" ", MARK)
            kept = _shared(before, word) + 1
            del last[kept:], path[kept:], total[kept:]
            for end in range(kept, len(word) + 1):
                for size in lengths.get(word[end - 1], alone):
                    if size > end:
                        continue
                    start = end - size
                    piece = word[start:end]
                    if (found := get(piece)) is None and size > 1:
                        continue
                    pair = (last[start], piece)
                    if (fits := known.get(pair)) is None:
                        fits = self.fits(*pair)
                    if fits:
                        last.append(piece)
                        if found is None:
                            path.append(path[start] + tuple(self.byte_id[b] for b in piece.encode()))
                            total.append(total[start] + self.unknown)
                        else:
                            path.append((*path[start], found[1]))
                            total.append(total[start] + found[0])
                        break
            before = word
            out[n] = (path[-1], total[-1])
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self.spelled[ids])[1:].decode()


def _shared(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if a[low : mid + 1] == b[low : mid + 1] else (low, mid)
    return low


class WordPieces:
    """Pieces of texts by way of their distinct marked words."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.reset()

    def reset(self) -> None:
        self.codes = WordCodes(600_000)
        self.flat, self.starts, self.lengths, self.scores = (np.zeros(0, t) for t in (np.int32, np.int64, np.int64, np.float64))

    def learn(self) -> None:
        if new := self.codes.words[len(self.starts) :]:
            found = self.vocabulary.encode(new)
            lengths = np.fromiter((len(ids) for ids, _ in found), np.int64, len(found))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
            self.flat = np.concatenate([self.flat, np.fromiter((x for ids, _ in found for x in ids), np.int32, int(lengths.sum()))])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.scores = np.concatenate([self.scores, np.fromiter((s for _, s in found), np.float64, len(found))])


def encode(docs: DataFrame, file: str | None = None, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """(key, n_pieces, ids_crc32, score, round_trip) and, with ``keep_ids``, ``ids``.

    ``ids_crc32`` is of the ids as little-endian 32-bit numbers; ``round_trip`` says that decoding them gave the text.
    """
    file = file or tokenizer_file("piece_bpe_32k.model")

    def make():
        words = WordPieces(Vocabulary(file))

        def one(keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
            cols: list[list] = [[], [], [], [], []]
            coded: list[tuple[str, np.ndarray]] = []

            def settle() -> None:
                words.learn()
                for t, own in coded:
                    ids = words.flat[ragged(words.starts[own], words.lengths[own])]
                    for col, v in zip(cols, (len(ids), zlib.crc32(ids.astype("<u4")), float(words.scores[own].sum()), (words.vocabulary.decode(ids) if len(ids) else "") == t, ids if keep_ids else None), strict=True):
                        col.append(v)
                coded.clear()
                if words.codes.full():
                    words.reset()

            held = 0
            for t in texts.to_pylist():
                own = words.codes.of(WORD.findall(" " + t.replace(MARK, " "))) if t else np.zeros(0, np.int32)
                coded.append((t or "", own))
                held += len(own)
                if held > 500_000:
                    settle()
                    held = 0
            settle()
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.bool_())
            return pa.RecordBatch.from_arrays([keys, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=False)), *([pa.array(cols[4], pa.list_(pa.int32()))] * keep_ids)], names=names)

        return one

    names = ["k", "n_pieces", "ids_crc32", "score", "round_trip"] + ["ids"] * keep_ids
    schema = f"k {dict(docs.dtypes)[key]}, n_pieces long, ids_crc32 long, score double, round_trip boolean" + ", ids array<int>" * keep_ids
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(per_batch(make, ["k", "t"]), schema).withColumnRenamed("k", key)


def decode(pieces: DataFrame, file: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) from arrays of ids; null ids give a null text."""
    file = file or tokenizer_file("piece_bpe_32k.model")

    def make():
        vocabulary = Vocabulary(file)

        def one(keys: pa.Array, lists: pa.Array) -> pa.RecordBatch:
            texts = [None if x is None else vocabulary.decode(np.array(x, np.int64)) if x else "" for x in lists.to_pylist()]
            return pa.RecordBatch.from_arrays([keys, pa.array(texts, pa.string())], names=["k", "text"])

        return one

    out = pieces.select(F.col(key).alias("k"), F.col(ids).alias("ids")).mapInArrow(per_batch(make, ["k", "ids"]), f"k {dict(pieces.dtypes)[key]}, text string")
    return out.withColumnRenamed("k", key)
