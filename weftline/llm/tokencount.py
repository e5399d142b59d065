"""Token counts without ids: pieces are counted once per distinct pre-token.

Pieces of the vocabulary hold the blank mark only at their start, so no piece
crosses from another character to a blank; line feeds are in no piece of more
than one character.  A text therefore falls into pre-tokens (a run of blanks
and what follows up to the next blank or line feed; each line feed on its own),
and the library's count for the text is the sum over pre-tokens.  The library
takes the mark itself, where a text has it, for a blank, and so does the cut.

For each block of documents the distinct pre-tokens are encoded once; each
document's pre-token frequencies are worked out and joined to the piece counts
by pre-token.  A join over the whole corpus would move every (document,
pre-token) pair, several times the input; blocks move nothing, and a block's
table is bounded.

Defined results: a null text is empty and has no tokens; repeated rows each get
their own row; a null ``doc_id`` is carried; texts of any length are cut only
between pre-tokens; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import CHUNK_BYTES, WordCodes, per_batch, tokenizer_file

LIMIT = 4096
#: Cuts a text into pre-tokens; the first one of a text starts with the mark that the library puts before it.
PRE_TOKEN = re.compile(r" *[^ \n]+| +|\n")
BLANK = re.compile(r"(?<=[^ \n]) ")
MARK = "▁"
#: (document, pre-token) occurrences that are held before frequencies are joined.
HELD = 500_000


def counter(model: str):
    """A function from pre-tokens to their numbers of pieces.

    A pre-token at the start of a text has a blank put before it, so that the
    same string always means the same pieces; inside a text, one without a
    blank follows a line feed and is encoded without the library's mark.
    """
    import sentencepiece

    plain = sentencepiece.SentencePieceProcessor(model_file=model)

    def count(pre_tokens: list[str]) -> list[int]:
        # "\n" is one byte piece; after it, what follows has no mark.  The library puts a mark first: "▁", then the byte.
        led = [p[1:] if p[0] == " " else "\n" + p for p in pre_tokens]
        sizes = [len(x) for x in plain.encode(led, num_threads=1)]
        return [1 if p == " " else n if p[0] == " " else n - 2 for n, p in zip(sizes, pre_tokens, strict=True)]

    return count


def parts(t: str):
    """Lists of a text's pre-tokens, some at a time."""
    t = " " + t.replace(MARK, " ")
    at = 0
    while at < len(t):
        end = min(len(t), at + CHUNK_BYTES)
        if end < len(t):  # cut before a line feed, or before a blank that follows something else
            cut = t.rfind("\n", at + 1, end)
            blank = BLANK.search(t, max(at + 1, end - 4096)) if cut <= at else None
            end = cut if cut > at else blank.start() if blank else len(t)
        yield PRE_TOKEN.findall(t, at, end)
        at = end


def count_tokens(docs: DataFrame, model: str | None = None, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every row."""
    file = model or tokenizer_file("piece_bpe_32k.model")

    def make():
        count = counter(file)
        codes, sizes = WordCodes(), np.zeros(0, np.int64)

        def joined(number: list[int], own: list[np.ndarray], rows: int) -> np.ndarray:
            """Pieces of each document: its pre-token frequencies joined to the pre-tokens' piece counts."""
            nonlocal codes, sizes
            if len(codes.words) > len(sizes):
                sizes = np.concatenate([sizes, np.array(count(codes.words[len(sizes) :]), np.int64)])
            document = np.repeat(np.array(number, np.int64), [len(x) for x in own])
            pair, frequency = np.unique(document * len(sizes) + np.concatenate(own), return_counts=True)
            document, pre_token = np.divmod(pair, max(1, len(sizes)))
            out = np.bincount(document, frequency * sizes[pre_token], rows).astype(np.int64)
            if codes.full():
                codes, sizes = WordCodes(), np.zeros(0, np.int64)
            return out

        def one(keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
            tokens = np.zeros(len(texts), np.int64)
            number, own, held = [], [], 0
            for i, t in enumerate(texts.to_pylist()):
                for part in parts(t) if t else ():
                    number.append(i)
                    own.append(codes.of(part))
                    held += len(own[-1])
                    if held > HELD:
                        tokens += joined(number, own, len(tokens))
                        number, own, held = [], [], 0
            if own:
                tokens += joined(number, own, len(tokens))
            n_bytes = pa.compute.binary_length(texts.cast(pa.binary())).cast(pa.int64()).fill_null(0)
            return pa.RecordBatch.from_arrays([keys, n_bytes, pa.array(tokens), pa.array(tokens > limit)], names=["k", "n_bytes", "n_tokens", "over_limit"])

        return one

    kind = dict(docs.dtypes)[key]
    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(per_batch(make, ["k", "t"]), f"k {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("k", key)
