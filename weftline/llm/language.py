"""Language of a text by interpolated Kneser-Ney models of letters, one for each language.

A text is a sequence of words, runs of letters in lower case.  A model gives each
letter of a word, and its end, a probability from up to four letters before it
in the word (the word's start counts as a letter).  The text's language is the one whose model has the
lowest cross-entropy, in bits for each letter and end; ties go to the first language in code-point order.

Models are fitted on a documented, bounded sample: pieces of ``PIECE`` code points of labelled
texts, chosen by a checksum of id, place and content, about ``SAMPLE`` code points for all languages
together, an equal share for each.  One task fits one language.  A model is two sorted arrays of hashes,
one of letter sequences with their interpolated probabilities, one of contexts with the weight of what lies behind them.  Hashes have 64
bits and roll on from a context to its continuations.

As no sequence leaves its word, a word has the same entropy in every text: a task works out
each distinct word once and adds up over texts.

Pieces that no model was fitted on, cut to many lengths, calibrate the outcome.  ``score`` is the probability of the
chosen language, a softmax of entropies whose sharpness grows with a power of the length, both fitted to those pieces.
``rejected`` tells texts whose entropy is above that of nearly all calibration pieces of a like length: no learned language.

Defined results: ``und`` with score 0 and no entropy for a null text, one without a letter, or if nothing
was learned; a null id counts as held out; repeated rows each get their own row; an empty table gives an
empty result; other columns aren't read.  Texts of any length are taken in parts of about a megabyte that end at a blank.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, WordCodes, by_bytes, chunks, give_back, per_batch

UNDETERMINED = "und"
ORDER = 5
#: Code points of labelled text that models are fitted on, all languages together; a tenth of that calibrates them.
SAMPLE = 4_000_000
#: Code points of a piece of the sample.
PIECE = 10_000
#: More label values than this are an error: a label column of that kind names no languages.
MOST_LANGUAGES = 1000
#: Letters that a model takes to be possible where it has seen none.
ALPHABET = 5000
#: Of calibration pieces, so many are rejected.
REJECTED = 0.002
#: Entropies that a task remembers.
REMEMBERED = 2_000_000
START, END = 1, 2
RUN = re.compile(r"[^\W\d_]+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def runs(text: str) -> list[str]:
    return RUN.findall(unicodedata.normalize("NFC", text).lower())


def letters(run: str) -> str:
    """A run without the numerals that the pattern takes for letters."""
    return run if run.isalpha() else "".join(c for c in run if c.isalpha())


def sequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all words, each between start and end; each code's place in its word; each word's first row."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    place = np.arange(sizes.sum()) - np.repeat(starts, sizes)
    codes = np.zeros(len(place), np.uint64)
    inner = (place > 0) & (place < np.repeat(sizes, sizes) - 1)
    codes[inner] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + 3
    codes[starts], codes[starts + sizes - 1] = START, END
    return codes, place, starts


def hashes(codes: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: rows with a sequence of that length, their hashes, those of their contexts; the start is no sequence of its own."""
    before = np.zeros(len(codes), np.uint64)  # the empty context
    for order in range(1, ORDER + 1):
        context = np.concatenate([np.zeros(1, np.uint64), before[:-1]]) if order > 1 else before
        with np.errstate(over="ignore"):
            h = (context + codes + np.uint64(1)) * MIX
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        rows = np.flatnonzero(place >= max(order - 1, 1))
        yield order, rows, h, context
        before = h


class Model:
    """Sorted hashes of sequences with the logarithm of their probability, and of contexts with that of their weight."""

    def __init__(self, sequence: np.ndarray, log_p: np.ndarray, context: np.ndarray, log_weight: np.ndarray):
        self.sequence, self.log_p, self.context, self.log_weight = sequence, log_p, context, log_weight

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.sequence, self.log_p, self.context, self.log_weight

    @classmethod
    def fit(cls, counts: Counter) -> Model:
        """Interpolated Kneser-Ney: the longest sequences and those at a word's start by their counts, the others by how many letters they follow."""
        words = sorted(counts)
        codes, place, starts = sequences(words)
        weight = np.repeat(np.fromiter((counts[w] for w in words), np.float64, len(words)), np.diff(np.append(starts, len(codes))))
        found = []
        for order, rows, h, context in hashes(codes, place):
            unique, first, which = np.unique(h[rows], return_index=True, return_inverse=True)
            at = rows[first]
            found.append({"h": unique, "context": context[at], "at": at, "raw": np.bincount(which, weight[rows], len(unique)), "all": h, "led": place[at] == order - 1})
        sequence, log_p, contexts, weights = [], [], [], []
        below = None
        for i, now in enumerate(found):
            n = now["raw"]
            if i + 1 < len(found):
                longer = found[i + 1]
                follows = np.bincount(np.searchsorted(now["h"], now["all"][longer["at"]]), minlength=len(n)).astype(np.float64)
                n = np.where(now["led"] & (i > 0), n, follows)
            once, twice = np.count_nonzero(n == 1), np.count_nonzero(n == 2)
            discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
            context, which = np.unique(now["context"], return_inverse=True)
            total, kinds = np.bincount(which, n), np.bincount(which)
            spare = discount * kinds / total
            shorter = np.full(len(n), 1 / ALPHABET) if below is None else below["p"][np.searchsorted(below["h"], below["all"][now["at"]])]
            now["p"] = (n - discount) / total[which] + spare[which] * shorter
            below = now
            sequence.append(now["h"])
            log_p.append(np.log2(now["p"]))
            contexts.append(context)
            weights.append(np.log2(spare))
        s, c = np.concatenate(sequence), np.concatenate(contexts)
        by_s, by_c = np.argsort(s), np.argsort(c)
        return cls(s[by_s], np.concatenate(log_p)[by_s].astype(np.float32), c[by_c], np.concatenate(weights)[by_c].astype(np.float32))

    @staticmethod
    def _find(where: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(where, what), len(where) - 1)
        return where[at] == what, at

    def bits(self, words: list[str]) -> np.ndarray:
        """Bits of each word with its end."""
        codes, place, starts = sequences(words)
        log_p = np.full(len(codes), -np.log2(ALPHABET), np.float64)
        for _, rows, h, context in hashes(codes, place):
            seen, at = self._find(self.sequence, h[rows])
            known, behind = self._find(self.context, context[rows])
            log_p[rows] = np.where(seen, self.log_p[at], log_p[rows] + np.where(known, self.log_weight[behind], 0))
        log_p[starts] = 0  # the start is given
        return -np.add.reduceat(log_p, starts) if len(words) else np.zeros(0)


class Entropies:
    """Bits of each distinct word under all models, worked out once; ``sizes`` are letters and end, 0 without a letter."""

    def __init__(self, models: list[Model]):
        self.models = models
        self.fresh()

    def fresh(self) -> None:
        self.codes = WordCodes(max(1000, REMEMBERED // max(1, len(self.models))))
        self.bits, self.sizes = np.zeros((0, len(self.models))), np.zeros(0, np.int64)

    def add(self) -> None:
        new = [letters(w) for w in self.codes.words[len(self.sizes) :]]
        if new:
            sizes = np.fromiter(map(len, new), np.int64, len(new))
            self.sizes = np.concatenate([self.sizes, np.where(sizes > 0, sizes + 1, 0)])
            bits = np.stack([m.bits(new) for m in self.models], 1)
            bits[sizes == 0] = 0
            self.bits = np.concatenate([self.bits, bits])

    def of(self, run_lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(bits under each model, letters and ends) of each list of runs."""
        sizes = np.fromiter(map(len, run_lists), np.int64, len(run_lists))
        if self.codes.full():
            self.fresh()
        codes = np.concatenate([self.codes.of(r) for r in run_lists] or [np.zeros(0, np.int32)])
        self.add()
        owner = np.repeat(np.arange(len(run_lists)), sizes)
        bits = np.stack([np.bincount(owner, self.bits[codes, i], len(run_lists)) for i in range(len(self.models))], 1)
        return bits, np.bincount(owner, self.sizes[codes], len(run_lists)).astype(np.int64)


class Judge:
    """Models of languages and what calibration found."""

    def __init__(self, names: list[str], models: list[Model]):
        self.names, self.models = names, models
        self.sharpness, self.power, self.most = 8.0, 0.5, np.zeros(0)

    def probabilities(self, entropy: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = -self.sharpness * (n[:, None] ** self.power) * (entropy - entropy.min(1, keepdims=True))
        x = np.exp(x)
        return x / x.sum(1, keepdims=True)

    def calibrate(self, truth: np.ndarray, entropy: np.ndarray, n: np.ndarray) -> None:
        """Fit the softmax, and the entropies above which a text of a length is rejected."""
        if not len(truth):
            return
        rows, best = np.arange(len(truth)), None
        for power in np.arange(0.2, 1.01, 0.1):
            for sharpness in np.geomspace(0.25, 64, 17):
                self.sharpness, self.power = sharpness, power
                loss = -np.log(np.maximum(self.probabilities(entropy, n)[rows, truth], 1e-12)).mean()
                if best is None or loss < best[0]:
                    best = loss, sharpness, power
        _, self.sharpness, self.power = best
        lowest, level = entropy.min(1), np.log2(n).astype(int)
        most = np.array([np.quantile(lowest[level == i], 1 - REJECTED) if (level == i).any() else np.inf for i in range(level.max() + 1)])
        self.most = np.minimum.accumulate(most)  # longer texts aren't allowed more

    def verdicts(self, bits: np.ndarray, n: np.ndarray) -> tuple[list, np.ndarray, list, list]:
        """(language, score, entropy, rejected) of each text."""
        has = n > 0
        entropy = bits / np.maximum(n, 1)[:, None]
        which, lowest = entropy.argmin(1), entropy.min(1)
        score = np.where(has, self.probabilities(entropy, np.maximum(n, 1)).max(1), 0.0)
        limit = self.most[np.minimum(np.log2(np.maximum(n, 1)).astype(int), len(self.most) - 1)] if len(self.most) else np.full(len(n), np.inf)
        return [self.names[w] if h else UNDETERMINED for w, h in zip(which, has, strict=True)], score, [float(e) if h else None for e, h in zip(lowest, has, strict=True)], [bool(e > t) if h else None for e, t, h in zip(lowest, limit, has, strict=True)]


def _pieces(shares: dict[str, float]):
    """Chosen pieces (lang, text, fit) of labelled documents (key, lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole):
                out: list = [[], [], []]
                for key, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    share = shares[lang]
                    for i in range(0, len(text), PIECE):
                        piece = text[i : i + PIECE]
                        at = zlib.crc32(piece.encode(), zlib.crc32(f"{key}:{i}:".encode())) / 2**32
                        if at < 1.1 * share:
                            for column, value in zip(out, (lang, piece, at < share), strict=True):
                                column.append(value)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.bool_())], ["lang", "text", "fit"])
        give_back()

    return run


def _fit(group: pd.DataFrame) -> pd.DataFrame:
    counts: Counter = Counter()
    for text in group["text"]:
        counts.update(filter(None, map(letters, runs(text))))
    if not counts:
        return pd.DataFrame({"lang": [], "sequence": [], "log_p": [], "context": [], "log_weight": []})
    m = Model.fit(counts)
    return pd.DataFrame({"lang": [group["lang"].iloc[0]], "sequence": [m.sequence.tobytes()], "log_p": [m.log_p.tobytes()], "context": [m.context.tobytes()], "log_weight": [m.log_weight.tobytes()]})


def cuts(found: list[str]) -> list[list[str]]:
    """A piece's runs as consecutive cuts of 1, 2, 4, ... runs; the last one has what is left."""
    out, at, size = [], 0, 1
    while at < len(found):
        out.append(found[at : at + size])
        at, size = at + size, size * 2
    return out


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Judge:
    """Models of all labels of ``docs``, fitted and calibrated on a sample of about ``sample`` code points."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "language")
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} labels, so they name no languages")
    # At least a tenth of a language is left for calibration.
    shares = {name: min(0.9, sample / len(sizes) / max(1, n)) for name, n in sizes.items()}
    chosen = scratch.keep(rows.mapInArrow(_pieces(shares), "lang string, text string, fit boolean").dropDuplicates(["lang", "text"]))
    fitted = chosen.where("fit").groupBy("lang").applyInPandas(_fit, "lang string, sequence binary, log_p binary, context binary, log_weight binary").collect()  # bounded by the sample
    fitted.sort(key=lambda r: r["lang"])
    models = [Model(np.frombuffer(r["sequence"], np.uint64), np.frombuffer(r["log_p"], np.float32), np.frombuffer(r["context"], np.uint64), np.frombuffer(r["log_weight"], np.float32)) for r in fitted]
    judge = Judge([r["lang"] for r in fitted], models)
    if models:
        shared, index = spark.sparkContext.broadcast([m.arrays() for m in models]), {n: i for i, n in enumerate(judge.names)}

        def tried(batches):
            known = Entropies([Model(*m) for m in shared.value])
            for batch in batches:
                for name, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if name not in index:
                        continue
                    bits, n = known.of(cuts(runs(piece)))
                    bits, n = bits[n > 0], n[n > 0]
                    yield pa.RecordBatch.from_arrays([pa.array([index[name]] * len(n), pa.int32()), pa.array((bits / n[:, None]).tolist(), pa.list_(pa.float64())), pa.array(n, pa.int64())], ["truth", "entropy", "n"])

        held = chosen.where("not fit").select("lang", "text").mapInArrow(tried, "truth int, entropy array<double>, n long").orderBy("truth", "n", "entropy").toPandas()
        if len(held):
            judge.calibrate(held["truth"].to_numpy(), np.stack(held["entropy"].to_numpy()), held["n"].to_numpy())
    return judge


def predict(docs: DataFrame, judge: Judge, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, entropy, rejected) of each row."""
    if not judge.models:
        none = F.lit(None)
        return docs.select(F.col(key), F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), none.cast("double").alias("entropy"), none.cast("boolean").alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast([m.arrays() for m in judge.models])  # bounded by the sample
    names, fitted = judge.names, (judge.sharpness, judge.power, judge.most)
    kind = docs.select(key).schema[0].dataType.simpleString()

    def make():
        told = Judge(names, [Model(*m) for m in shared.value])
        told.sharpness, told.power, told.most = fitted
        known = Entropies(told.models)

        def one(keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
            lists, owner = [], []
            total, n = np.zeros((len(keys), len(known.models))), np.zeros(len(keys), np.int64)

            def take():
                bits, sizes = known.of(lists)
                np.add.at(total, owner, bits)
                np.add.at(n, owner, sizes)
                lists.clear()
                owner.clear()

            held = 0
            for i, t in enumerate(texts.to_pylist()):
                for part in chunks(t.encode()) if t else ():
                    found = runs(part.decode())
                    lists.append(found)
                    owner.append(i)
                    held += len(found)
                    if held > 500_000:
                        take()
                        held = 0
            if lists:
                take()
            name, score, entropy, rejected = told.verdicts(total, n)
            return pa.RecordBatch.from_arrays([keys, pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(rejected, pa.bool_())], ["k", "lang_pred", "score", "entropy", "rejected"])

        return one

    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(per_batch(make, ["k", "t"]), f"k {kind}, lang_pred string, score double, entropy double, rejected boolean")
    return out.withColumnRenamed("k", key)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """(key, held_out, lang_pred, score, entropy, rejected): learned from four fifths of ``docs``, predicted for all."""
    judge = learn(docs.where(~held_out(F.col(key))), key, text, lang, sample)
    return predict(docs, judge, key, text).select(key, held_out(F.col(key)).alias("held_out"), "lang_pred", "score", "entropy", "rejected")
