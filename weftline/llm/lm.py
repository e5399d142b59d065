"""Language-model scoring: a causal self-attention model over subword ids, trained in numpy.

Counts.  Words of the training documents are counted over the whole corpus; the
base score of a text is the sum of its tokens' smoothed log10 probabilities.
The most frequent words, at most ``HEAVY`` of them, are looked up in a broadcast
table; all others, wherever they occur, in a join with the counts.  A hot word
therefore never meets a join.

Attention.  A text is the pieces of its words and an end.  One head of causal
self-attention over a window tells whether the next piece starts a word (or is the
end), and then its *class*: each of the ``TOP`` most frequent pieces is a class of its
own, the others are classes by first letter, in which a piece has its share of the
corpus' pieces, with one added to each count.  Every piece has one class, so the
product is a probability of the piece.  Windows overlap: each scores its last
``BLOCK`` pieces, which see ``CONTEXT`` pieces before them, so each piece is scored
once.  All windows of a batch are worked out together under one mask.

Words.  A word's probability by the attention is that of its pieces, given that a
word starts, and of its end after them.  The model mixes it with the word's count:
``SPELL`` of the attention, and the rest of the counts, which give one more
occurrence to whatever the attention gives.  No count is left out.

Phrases.  A phrase ends where two words' hashes say so, after 16 words on average, or
with the text.  All phrases of the training documents are counted, and the model
mixes ``COPY`` of a phrase's share among them into its probability, so a text that
the corpus holds elsewhere is far more probable than its words are.  A training
document's own phrases don't count for itself.

Training.  All training documents take part with every piece.  They are dealt to
shards by their ids and texts, in the order of their texts' hashes; each shard is
walked once from the same start, and the weights are averaged, weighted by the
number of pieces seen, in whole numbers.  So the weights don't depend on how rows
lie in files and tasks.

Defined results: a null text is empty and has the end token alone; a document
with a null ``doc_id`` is a training document; without any training document
the counts are zero and the attention is at its start; repeated rows are each
counted and scored; an empty table gives an empty result; other columns don't take
part.
"""

from __future__ import annotations

from itertools import chain, repeat
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, WordCodes, by_bytes, give_back, groups_of, per_batch, ragged, tokenizer_file

#: Words that are broadcast: so many at most, each of so many bytes at most.
HEAVY, HEAVY_BYTES = 200_000, 64
#: Share of the attention's probability of a word, and of phrases' counts.
SPELL, COPY = 0.4, 0.05
#: One pair of neighbouring words in so many ends a phrase.
PHRASE = 16
BLOCK, CONTEXT = 32, 16
DIM, BATCH, RATE = 16, 128, 0.02
#: Windows that are scored at a time, so that their tables stay in the processor's cache.
PART = 128
#: Bytes of text that a shard of the training has, about.
SHARD_BYTES = 16 << 20
#: Rows of the embedding: the most frequent pieces have their own, the others share what is left; one more is a text's start.
EMBEDDED, SHARED = 1792, 256
#: Classes on either side: 26 letters and all else, the end (among what starts a word), frequent pieces.
TOP, LETTERS = 36, 27
N_CLASSES = LETTERS + 1 + TOP
MARK = "▁"


def is_held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


class Pieces:
    """Pieces and hashes of distinct words, kept in flat arrays; ``codes`` numbers the words."""

    def __init__(self, file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=file)
        self.end = self.model.vocab_size()
        self.reset()

    def encode(self, words: list[bytes]) -> list[list[int]]:
        return [e or [self.model.unk_id()] for e in self.model.encode([w.decode() for w in words], num_threads=1)]

    def reset(self) -> None:
        self.codes = WordCodes()
        self.flat, self.starts, self.lengths = (np.zeros(0, t) for t in (np.int32, np.int64, np.int64))
        self.hashes = np.zeros(0, np.uint64)

    def learn(self) -> list[bytes]:
        """Encode the words that are new since the last call and return them."""
        new = self.codes.words[len(self.starts) :]
        if new:
            encoded = self.encode(new)
            lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(encoded), np.int32, int(lengths.sum()))])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.hashes = np.concatenate([self.hashes, word_hashes(new)])
        return new


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class Phrases:
    """Cuts texts into phrases, whose hash depends on their words and those words' order."""

    STEP = np.uint64(0x9E3779B97F4A7C15)
    #: Its inverse modulo 2**64.
    BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    END = np.uint64(0xD1B54A32D192ED03)

    def __init__(self):
        self.forth = self.back = np.ones(1, np.uint64)

    def of(self, words: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first token, text) of each phrase of texts that stand one after another; ``words`` are hashes, and each text has an end token after its words.

        The end belongs to the last phrase; a text without words has no phrase.
        """
        n_tokens = n_words + 1
        total = int(n_tokens.sum())
        ends = np.cumsum(n_tokens) - 1
        token = np.full(total, self.END)
        inner = np.ones(total, bool)
        inner[ends] = False
        token[inner] = words
        closing = (mixed(np.append(self.END, token[:-1]) * self.STEP + token) % np.uint64(PHRASE) == 0) & inner
        first = np.cumsum(n_tokens) - n_tokens
        closing[first[n_words > 0]] = False  # the word before it is another text's
        closing[(ends - 1)[n_words > 0]] = False  # the last word goes with the end
        starts = np.append(True, closing[:-1]) if total else np.zeros(0, bool)
        starts[first] = True
        starts[first[n_words == 0]] = False
        starts = np.flatnonzero(starts)
        if total > len(self.forth):
            self.forth = np.multiply.accumulate(np.full(total, self.STEP))
            self.back = np.multiply.accumulate(np.full(total, self.BACK))
        sums = np.append(np.uint64(0), np.cumsum(token * self.forth[:total], dtype=np.uint64))
        text = np.repeat(np.arange(len(n_words)), n_tokens)[starts]
        stop = np.minimum(np.append(starts[1:], total), ends[text] + 1)
        return mixed((sums[stop] - sums[starts]) * self.back[starts] + (stop - starts).astype(np.uint64)), starts, text


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Alphabet:
    """Classes of the pieces, their shares in them, and their rows of the embedding, from how often each occurs.

    Pieces that start a word, with the end, and all others have classes of their own, each counted from 0.
    """

    def __init__(self, file: str, seen: np.ndarray):
        """``seen``: counts of all pieces and, last, of the end."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=file)
        size = model.vocab_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        self.leads = np.array([*(p.startswith(MARK) for p in pieces), True])
        letters = [p.lstrip(MARK)[:1] for p in pieces]
        self.classes = np.array([*(ord(x) - 97 if "a" <= x <= "z" else 26 for x in letters), LETTERS])
        order = np.lexsort((np.arange(size), -seen[:size]))
        for lead in (True, False):
            top = np.sort(order[self.leads[order] == lead][:TOP])
            self.classes[top] = LETTERS + 1 + np.arange(len(top))
        both = self.classes + N_CLASSES * self.leads
        self.shares = np.log((seen + 1) / np.bincount(both, seen + 1, 2 * N_CLASSES)[both]).astype(np.float32)
        self.rows = np.append(EMBEDDED + (np.arange(size) * 2654435761 >> 7) % SHARED, EMBEDDED + SHARED).astype(np.int32)
        self.rows[order[:EMBEDDED]] = np.arange(EMBEDDED)


class Attention:
    """Weights are float32 arrays in a dict; ``flat`` turns them into one vector."""

    #: The last row of the embedding is the end's and a text's start.
    START = EMBEDDED + SHARED
    #: ``o``, ``b``: classes of pieces inside words, then of those that start one; ``gate`` tells which.
    SHAPES = {"emb": (START + 1, DIM), "q": (DIM, DIM), "k": (DIM, DIM), "v": (DIM, DIM), "gate": (2 * DIM,), "gate0": (1,), "o": (2, 2 * DIM, N_CLASSES), "b": (2, N_CLASSES), "near": (BLOCK + CONTEXT,)}
    #: Exponents are cut here, far above what training reaches.
    MOST = np.float32(60)

    def __init__(self, vector: np.ndarray | None = None):
        rng = np.random.default_rng(5)
        self.w = {n: (rng.standard_normal(s) * (0.3 if n == "emb" else 0.0 if n in ("b", "near", "gate0") else DIM**-0.5)).astype(np.float32) for n, s in self.SHAPES.items()}
        if vector is not None:
            at = 0
            for n, s in self.SHAPES.items():
                size = int(np.prod(s))
                self.w[n] = vector[at : at + size].reshape(s).astype(np.float32)
                at += size
        # Query i stands at position CONTEXT + i of its window and may see positions up to there.
        far = (CONTEXT + np.arange(BLOCK))[:, None] - np.arange(BLOCK + CONTEXT)[None, :]
        self.far, self.later = np.maximum(far, 0), far < 0
        self.rooms: dict[tuple, np.ndarray] = {}

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[n].ravel() for n in self.SHAPES])

    def room(self, name: str, n: int, *shape: int) -> np.ndarray:
        """An array of ``n`` rows as the last call left it, zeros at first: fresh memory for each step costs more than filling it."""
        kind, held = self.w["emb"].dtype, self.rooms.get((name, *shape))
        if held is None or len(held) < n or held.dtype != kind:
            held = self.rooms[name, *shape] = np.zeros((n, *shape), kind)
        return held[:n]

    def raised(self, x: np.ndarray) -> np.ndarray:
        """Exponentials in place."""
        if x.size and x.max() > self.MOST:
            np.minimum(x, self.MOST, out=x)
        return np.exp(x, out=x)

    def weigh(self, s: np.ndarray, absent: np.ndarray) -> np.ndarray:
        """Exponentials of attention scores under the mask; ``absent`` marks places before a text's start."""
        s += self.bias
        self.raised(s)
        first = np.flatnonzero(absent[:, 0])
        if len(first):
            s[first] *= ~absent[first][:, None, :]
        return s

    def mask(self) -> None:
        self.bias = np.where(self.later, -np.float32(1e4), self.w["near"][self.far])

    def joint(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """What scores a row as query against a row as key; and, for either side, what the weighed rows, then the asked one and then a 1 give to classes and, last, the gate.

        Products with the weights of keys and values are left out this way: a window's matrices only meet its rows of the embedding.
        """
        w = self.w
        outs = [np.append(np.append(o, b[None], 0), np.append(w["gate"], w["gate0"])[:, None], 1) for o, b in zip(w["o"], w["b"], strict=True)]
        return w["q"] @ w["k"].T * np.float32(DIM**-0.5), [np.concatenate([w["v"] @ out[:DIM], out[DIM:]]) for out in outs]

    def prepare(self) -> None:
        """Tables of what each embedding row gives as query, to classes and to the gate: weights that stand need no products."""
        w = self.w
        self.mask()
        match, self.outs = self.joint()
        self.query = w["emb"] @ match
        self.to_class = [w["emb"] @ out[DIM:-1, :-1] + out[-1, :-1] for out in self.outs]
        self.to_gate = w["emb"] @ w["gate"][DIM:] + w["gate0"]

    def log_scores(self, rows: np.ndarray, absent: np.ndarray, goal: np.ndarray, leads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """At each place of each window: the log probability of the class ``goal`` among those of its side, and the gate's score for a piece that starts a word; after ``prepare``.

        ``rows`` are (windows, BLOCK + CONTEXT) embedding rows; ``leads`` tells which side's class is meant.
        """
        n, asked, room = len(rows), rows[:, CONTEXT:], self.room
        x = self.w["emb"].take(rows, 0, room("x", n, BLOCK + CONTEXT, DIM), "clip")
        q = self.query.take(asked, 0, room("q", n, BLOCK, DIM), "clip")
        s = self.weigh(np.matmul(q, x.transpose(0, 2, 1), out=room("s", n, BLOCK, BLOCK + CONTEXT)), absent)
        h = np.matmul(s, x, out=room("h", n, BLOCK, DIM))
        h /= (s.reshape(-1, BLOCK + CONTEXT) @ np.ones(BLOCK + CONTEXT, s.dtype)).reshape(n, BLOCK, 1)
        h, asked, goal, leads = h.reshape(-1, DIM), asked.ravel(), goal.ravel(), leads.ravel()
        out = np.empty(len(h), h.dtype)
        for side in (0, 1):
            at = np.flatnonzero(leads == side)
            z = np.matmul(h.take(at, 0), self.outs[side][:DIM, :-1], out=room("z", len(at), N_CLASSES))
            z += self.to_class[side].take(asked[at], 0, room("from", len(at), N_CLASSES), "clip")
            own = z.ravel().take(np.arange(0, z.size, N_CLASSES) + goal[at])
            out[at] = np.minimum(own, self.MOST) - np.log(self.raised(z) @ np.ones(N_CLASSES, z.dtype))
        gate = h @ self.outs[0][:DIM, -1]
        gate += self.to_gate.take(asked)
        return out.reshape(n, BLOCK), gate.reshape(n, BLOCK)

    def gradient(self, rows: np.ndarray, absent: np.ndarray, goal: np.ndarray, leads: np.ndarray, real: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log probability of gates and goals at the ``real`` places."""
        w, n, room, width = self.w, len(rows), self.room, BLOCK + CONTEXT
        ones, scale = np.ones(N_CLASSES + 1, w["emb"].dtype), np.float32(DIM**-0.5)
        flat = lambda a: a.reshape(-1, a.shape[-1])
        self.mask()
        match, outs = self.joint()
        # A row's last column is 1: what it is multiplied with is added, or taken off, in the same product.
        rows = rows.astype(np.int64)
        x1 = np.append(w["emb"], ones[:1].repeat(len(w["emb"]))[:, None], 1).take(rows, 0, room("x1", n, width, DIM + 1), "clip")
        x = x1[:, :, :DIM]
        # ``s`` and its gradient stand one after the other, and so do what they are multiplied with on the way back.
        both, to = room("both", n, 2 * BLOCK, width), room("to", n, 2 * BLOCK, DIM + 1)
        s, ds, t, u = both[:, :BLOCK], both[:, BLOCK:], to[:, :BLOCK], to[:, BLOCK:, :DIM]
        u[:] = (w["emb"] @ match).take(rows[:, CONTEXT:], 0)
        self.weigh(np.matmul(u, x.transpose(0, 2, 1), out=s), absent)
        part = 1 / (s @ ones[:width])[:, :, None]
        f = room("f", n, BLOCK, 2 * DIM + 1)
        h = f[:, :, :DIM]
        np.matmul(s, x, out=h)
        h *= part
        f[:, :, DIM:] = x1[:, CONTEXT:]
        share = np.float32(1 / max(1, real.sum()))
        real, goal, leads = real.ravel(), goal.ravel(), leads.ravel()
        # Rows of both sides stand one after another, and a row of zeros for places that aren't real.
        sides = [np.flatnonzero((leads == side) & real) for side in (0, 1)]
        n_real, first = sum(map(len, sides)), 0
        place, df = np.full(len(real), n_real), room("df", len(real) + 1, 2 * DIM)
        df[n_real] = 0
        own = flat(f).take(np.concatenate(sides), 0, room("own", len(real), 2 * DIM + 1)[:n_real], "clip")
        douts = []
        for side, at in enumerate(sides):
            of = slice(first, first + len(at))
            z = self.raised(np.matmul(own[of], outs[side], out=room("z", len(real), N_CLASSES + 1)[: len(at)]))
            started = z[:, -1] / (1 + z[:, -1])
            z[:, -1] = 0
            z *= (share / (z @ ones))[:, None]
            z.reshape(-1)[np.arange(0, z.size, N_CLASSES + 1) + goal[at]] -= share
            z[:, -1] = (started - side) * share
            np.matmul(z, outs[side][:-1].T, out=df[of])
            douts.append(own[of].T @ z)
            place[at] = np.arange(first, first + len(at))
            first += len(at)
        df = df.take(place, 0, room("placed", len(place), 2 * DIM), "clip").reshape(n, BLOCK, 2 * DIM)
        # ``s`` isn't divided by its sums; what comes back is.
        np.multiply(df[:, :, :DIM], part, out=t[:, :, :DIM])
        np.negative(np.einsum("wid,wid->wi", t[:, :, :DIM], h), out=t[:, :, DIM])
        np.matmul(t, x1.transpose(0, 2, 1), out=ds)
        ds *= s
        near = np.bincount(self.far.ravel(), (ds.sum(0) * ~self.later).ravel(), width).astype(np.float32)
        asking = flat(np.matmul(ds, x, out=room("asking", n, BLOCK, DIM)))
        dx = np.matmul(both.transpose(0, 2, 1), to[:, :, :DIM], out=room("dx", n, width, DIM))
        dasked = (asking @ match.T).reshape(n, BLOCK, DIM)
        dasked += df[:, :, DIM:]
        dx[:, CONTEXT:] += dasked
        cells = rows.reshape(-1, 1) * DIM + np.arange(DIM)
        emb = np.bincount(cells.ravel(), dx.ravel(), w["emb"].size).astype(np.float32).reshape(w["emb"].shape)
        dmatch = flat(f)[:, DIM:-1].T @ asking * scale
        do = np.stack([np.concatenate([w["v"].T @ d[:DIM], d[DIM:]]) for d in douts])
        dv = sum(d[:DIM, :-1] @ o[:DIM].T for d, o in zip(douts, w["o"], strict=True)) + sum(douts)[:DIM, -1:] * w["gate"][:DIM]
        gate = do[:, :, -1].sum(0)
        return {"emb": emb, "q": dmatch @ w["k"], "k": dmatch.T @ w["q"], "v": dv, "gate": gate[:-1], "gate0": gate[-1:], "o": do[:, :-1, :-1].copy(), "b": do[:, -1, :-1].copy(), "near": near}


def windows(sizes: np.ndarray):
    """Positions of each window's inputs and targets over texts that stand one after another.

    A text of n pieces has targets 0..n-1; the input of target j is piece j-1, or the start.
    Returns (input positions, absent, target positions, real), -1 being the start of the text.
    """
    blocks = -(-sizes // BLOCK)
    text = np.repeat(np.arange(len(sizes)), blocks)
    number = ragged(np.zeros(len(sizes), np.int64), blocks)
    begin = (np.cumsum(sizes) - sizes)[text]
    place = (number * BLOCK)[:, None] + np.arange(-CONTEXT, BLOCK)[None, :]
    size = sizes[text][:, None]
    absent = place < 0
    at = np.where(absent | (place == 0), -1, begin[:, None] + np.minimum(place, size) - 1)
    target = (number * BLOCK)[:, None] + np.arange(BLOCK)[None, :]
    real = target < size
    return at, absent, begin[:, None] + np.minimum(target, size - 1), real


def sequences(p: Pieces, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pieces of coded texts, each with its end, the number of each text, and where each token begins."""
    own = np.concatenate(held)
    n_words = np.fromiter(map(len, held), np.int64, len(held))
    ends = np.cumsum(n_words + 1) - 1
    inner = np.ones(len(own) + len(held), bool)
    inner[ends] = False
    lengths = np.ones(len(inner), np.int64)
    lengths[inner] = p.lengths[own]
    starts = np.cumsum(lengths) - lengths
    out = np.empty(lengths.sum(), np.int32)
    last = np.zeros(len(out), bool)
    last[starts[ends]] = True
    out[last] = p.end
    out[~last] = p.flat[ragged(p.starts[own], p.lengths[own])]
    return out, np.diff(starts[ends], prepend=-1), starts


def softplus(x: np.ndarray) -> np.ndarray:
    """log(1 + exp(x))"""
    return np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))


def word_logs(net: Attention, letters: Alphabet, p: Pieces, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities by the attention of all tokens of coded texts, each text's end after its words; and each text's number of pieces."""
    ids, sizes, starts = sequences(p, held)
    at, absent, target, real = windows(sizes)
    rows = np.append(letters.rows[ids], Attention.START).take(at, mode="wrap")
    classes, leads = letters.classes[ids], letters.leads[ids]
    each, gate = np.empty(len(ids), np.float32), np.empty(len(ids), np.float32)
    goal, lead = classes.take(target), leads.take(target)
    own, started = np.empty(target.shape, np.float32), np.empty(target.shape, np.float32)
    for b in range(0, len(at), PART):
        part = slice(b, b + PART)
        own[part], started[part] = net.log_scores(rows[part], absent[part], goal[part], lead[part])
    to = target[real]
    each[to], gate[to] = own[real], started[real]
    each += letters.shares[ids]
    # Inside a word a piece also stands for the word's going on; at a token's start the word before it has ended.
    inner = np.ones(len(ids), bool)
    inner[starts] = False
    each[inner] -= softplus(np.where(leads[inner], -gate[inner], gate[inner]))
    logs = np.add.reduceat(each, starts, dtype=np.float64)
    words = np.flatnonzero(ids[starts] != p.end)
    logs[words] -= softplus(-gate[starts[words + 1]])
    return logs, sizes


class Reader:
    """Turns texts into word codes, about ``BYTES`` of text at a time."""

    BYTES = 1 << 20

    def __init__(self, file: str):
        self.pieces = Pieces(file)

    def of(self, texts: pa.Array):
        """(first, codes of each text's words); the tables are fresh where they had become large."""
        first = 0
        for part in by_bytes(pa.RecordBatch.from_arrays([texts], names=["t"]), self.BYTES):
            yield first, self.pieces.codes.of_texts(part.column(0))
            first += len(part)


def least_of_most(rows: DataFrame, most: int, column: str = "n") -> int:
    """A value that at most ``most`` rows reach, as low as steps of a sixteenth of a power of two allow."""
    steps = rows.groupBy(F.floor(F.log2(column) * 16).alias("step")).agg(F.count("*").alias("rows"), F.min(column).alias("least")).collect()
    least, total = None, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        total += r["rows"]
        if total > most:
            break
        least = r["least"]
    return least if least is not None else max((r["least"] for r in steps), default=0) * 2 + 1


def corpus_counts(training: DataFrame) -> DataFrame:
    """(word, phrase, n) over all rows of column t: counts of words, with a null phrase, and of phrases, with a null word.

    A task sums up before anything is moved, as far as its tables go.
    """

    def make():
        cutter = Phrases()
        codes, seen, hashes, phrases = WordCodes(), np.zeros(1 << 16, np.int64), np.zeros(0, np.uint64), []

        def table() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(phrases), return_counts=True) if phrases else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            words = pa.array([*codes.words, *[None] * len(found)], pa.binary())
            blank = np.zeros(len(words), bool)
            blank[: len(codes.words)] = True
            number = np.append(np.zeros(len(codes.words), np.int64), found.view(np.int64))
            return pa.RecordBatch.from_arrays([words, pa.array(number, mask=blank), pa.array(np.append(seen[: len(codes.words)], n))], names=["word", "phrase", "n"])

        def run(batches):
            nonlocal codes, seen, hashes, phrases
            held = 0
            for batch in batches:
                for part in by_bytes(batch):
                    coded = codes.of_texts(part.column(0))
                    while len(codes.words) > len(seen):
                        seen = np.concatenate([seen, np.zeros_like(seen)])
                    own = np.concatenate(coded)
                    seen[: len(codes.words)] += np.bincount(own, minlength=len(codes.words))
                    hashes = np.concatenate([hashes, word_hashes(codes.words[len(hashes) :])])
                    phrases.append(cutter.of(hashes[own], np.fromiter(map(len, coded), np.int64, len(coded)))[0])
                    held += len(phrases[-1])
                    if codes.full() or held > 1_000_000:
                        yield table()
                        codes, seen, hashes, phrases, held = WordCodes(), np.zeros(1 << 16, np.int64), np.zeros(0, np.uint64), [], 0
            yield table()
            codes = seen = hashes = phrases = None
            give_back()

        return run

    return training.select("t").mapInArrow(lambda batches: make()(batches), "word binary, phrase long, n long").groupBy("word", "phrase").agg(F.sum("n").alias("n"))


def piece_counts(words: DataFrame, file: str, size: int) -> np.ndarray:
    """How often each piece of the vocabulary occurs in the counted words; one row for each piece comes to the driver."""

    def make():
        pieces = Pieces(file)

        def one(words: pa.Array, n: pa.Array) -> pa.RecordBatch:
            encoded = pieces.encode(words.to_numpy(zero_copy_only=False).tolist())
            flat = np.fromiter(chain.from_iterable(encoded), np.int64)
            seen = np.bincount(flat, np.repeat(n.to_numpy(), [len(e) for e in encoded]), size).astype(np.int64)
            there = np.flatnonzero(seen)
            return pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(seen[there])], names=["piece", "n"])

        return one

    out = np.zeros(size, np.int64)
    for r in words.mapInArrow(per_batch(make, ["word", "n"]), "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        out[r["piece"]] = r["n"]
    return out


def walk(texts: list[list[bytes]], pieces: Pieces, letters: Alphabet, model: Attention, rng: np.random.Generator, state: dict) -> None:
    """Train ``model`` on every piece of these texts, once."""
    coded = pieces.codes.of_texts(pa.array(texts, pa.binary()))
    pieces.learn()
    ids, sizes, _ = sequences(pieces, coded)
    at, absent, target, real = windows(sizes)
    rows = np.append(letters.rows[ids], Attention.START).take(at, mode="wrap")
    goal, leads = letters.classes[ids].take(target), letters.leads[ids].take(target)
    order = rng.permutation(len(at))
    for b in range(0, len(order), BATCH):
        own = order[b : b + BATCH]
        state["steps"] += 1
        state["seen"] += int(real[own].sum())
        steps = state["steps"]
        total = model.gradient(rows[own], absent[own], goal[own], leads[own], real[own])
        rate = np.float32(RATE / (1 + steps / 400) * (1 - 0.99**steps) ** 0.5 / (1 - 0.9**steps))
        for n, g in total.items():
            first, second = state["first"][n], state["second"][n]
            first += np.float32(0.1) * (g - first)
            g *= g
            second += np.float32(0.01) * (g - second)
            model.w[n] -= rate * first / (np.sqrt(second) + np.float32(1e-7))
    if pieces.codes.full():
        pieces.reset()


def train(training: DataFrame, file: str, letters: Alphabet, n_bytes: int) -> np.ndarray:
    """The averaged weights; ``training`` has k and t."""
    shards = max(1, -(-n_bytes // SHARD_BYTES))

    def run(batches):
        pieces, shard, part, held = Pieces(file), None, [], 0
        model = rng = state = None

        def begin():
            model = Attention()
            return model, np.random.default_rng(1), {"steps": 0, "seen": 0, **{n: {k: np.zeros_like(a) for k, a in model.w.items()} for n in ("first", "second")}}

        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([state["seen"]], pa.int64()), pa.array([model.flat()], pa.list_(pa.float32()))], names=["seen", "w"])

        for batch in batches:
            for some in by_bytes(batch):
                for s, t in zip(some.column(0).to_pylist(), some.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    if s != shard or held > 1 << 20:
                        if part:
                            walk(part, pieces, letters, model, rng, state)
                            part, held = [], 0
                        if s != shard:
                            if shard is not None:
                                yield result()
                            model, rng, state = begin()
                            shard = s
                    part.append(t)
                    held += len(t)
        if part:
            walk(part, pieces, letters, model, rng, state)
        if shard is not None:
            yield result()
        pieces = model = state = part = None
        give_back()

    dealt = training.select("t", F.xxhash64("t").alias("h"), F.pmod(F.xxhash64("k", "t"), F.lit(shards)).cast("int").alias("shard"))
    # Each shard has a task of its own; its texts come in the order of their hashes.
    ordered = dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "h").select("shard", "t")
    rows = ordered.mapInArrow(run, "seen long, w array<float>").select("seen", F.posexplode("w").alias("i", "w"))
    # Whole numbers, whose sum doesn't depend on their order.
    fixed = F.round(F.col("w") * (1 << 20)).cast("decimal(18,0)") * F.col("seen").cast("decimal(18,0)")
    mean = rows.groupBy("i").agg((F.sum(fixed).cast("double") / F.sum("seen") / (1 << 20)).alias("w")).orderBy("i").collect()
    return np.array([r["w"] for r in mean], np.float32) if mean else Attention().flat()


def softplus10(x: Column) -> Column:
    """log10(1 + 10**x)"""
    return F.greatest(x, F.lit(0.0)) + F.log10(F.lit(1.0) + F.pow(F.lit(10.0), -F.abs(x)))


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", file: str | None = None) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, n_pieces, copied, gain) for every row.

    ``copied`` is the share of the text's phrases that other training documents hold, ``gain`` what the
    model gives over the base for each token, in powers of ten.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    file = file or tokenizer_file("piece_bpe_32k.model")
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), is_held_out(F.col(key)).alias("held"))
    training = rows.where("not held")
    counts = scratch.keep(corpus_counts(training))
    words, phrases = counts.where("word is not null").select("word", "n"), counts.where("word is null").select("phrase", "n")
    texts = training.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("bytes")).collect()[0]
    n_docs = texts["n"]
    total = words.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect()[0]
    n_phrases = phrases.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect()[0]["n"]
    n, v = total["n"] + n_docs, total["v"] + (n_docs > 0)
    short = F.length("word") <= HEAVY_BYTES
    least = least_of_most(words.where(short), HEAVY)
    is_heavy = short & (F.col("n") >= least)
    heavy = spark.sparkContext.broadcast(dict(zip(*(c.to_pylist() for c in words.where(is_heavy).select("word", "n").toArrow().columns), strict=True)))
    size = Pieces(file).end
    letters = Alphabet(file, np.append(piece_counts(words, file, size), n_docs))
    model = spark.sparkContext.broadcast((train(training, file, letters, texts["bytes"]), vars(letters)))
    below, end_log = float(np.log10(n + v + 1)), float(np.log10(n_docs + 1))
    # The probability of a word that occurs c times: counted * c + spelled * (its probability by the attention).
    counted, spelled = (1 - SPELL) / (n + 1), SPELL + (1 - SPELL) / (n + 1)
    not_copied = float(np.log10(1 - COPY))

    def make():
        reader, net, cutter = Reader(file), Attention(model.value[0]), Phrases()
        # Of each distinct word: its count, what that gives the base, and the logarithm of what it gives the model.  The end stands last.
        logs_of = lambda c: np.stack([np.log10(c + 1.0), np.log(np.maximum(counted * c, 1e-300))])
        known_counts, known_logs = np.array([n_docs]), logs_of(np.array([n_docs]))
        letters, counts_of = SimpleNamespace(**model.value[1]), heavy.value
        net.prepare()

        def one(keys: pa.Array, texts: pa.Array, held_out: pa.Array) -> pa.RecordBatch:
            nonlocal known_counts, known_logs
            size, p = len(texts), reader.pieces
            training_row = ~held_out.to_numpy(zero_copy_only=False)
            n_tokens, n_pieces, n_known, n_own = (np.zeros(size, np.int64) for _ in range(4))
            base, got = np.zeros(size), np.zeros(size)
            rare: list[tuple] = []
            own_phrases: list[tuple] = []
            for first, held in reader.of(texts):
                if new := p.learn():
                    more = np.append(np.fromiter(map(counts_of.get, new, repeat(0)), np.int64, len(new)), n_docs)
                    known_counts, known_logs = np.append(known_counts[:-1], more), np.concatenate([known_logs[:, :-1], logs_of(more)], 1)
                span = slice(first, first + len(held))
                n_words = np.fromiter(map(len, held), np.int64, len(held))
                text = np.repeat(np.arange(len(held)), n_words + 1)
                is_word = np.ones(len(text), bool)
                is_word[np.cumsum(n_words + 1) - 1] = False
                codes = np.full(len(text), -1, np.int64)  # the end's: the last place
                codes[is_word] = np.concatenate(held)
                c = known_counts[codes]
                n_tokens[span] = n_words + 1
                n_known[span] = np.bincount(text, c > 0, len(held)).astype(np.int64)
                base[span] = np.bincount(text, known_logs[0][codes], len(held))
                logs, n_pieces[span] = word_logs(net, letters, p, held)
                spelling, count = np.log(spelled) + logs, known_logs[1][codes]
                mixture = (np.maximum(spelling, count) + np.log1p(np.exp(-np.abs(spelling - count)))) / np.log(10)
                mixture[c == 0] = spelling[c == 0] / np.log(10)
                hashes, starts, of = cutter.of(p.hashes[codes[is_word]], n_words)
                # Phrases follow one another but for texts without words, which have none.
                phrase = np.cumsum(np.bincount(starts, minlength=len(text))) - 1
                inside = (n_words > 0)[text]
                got[span] = np.bincount(text, mixture, len(held)) + not_copied * np.bincount(of, minlength=len(held))
                place = np.cumsum(np.bincount(of, minlength=len(held))) - np.bincount(of, minlength=len(held))
                # How often a training document itself has the phrase.
                _, back, times = np.unique(mixed(hashes + mixed(of.astype(np.uint64) + np.uint64(1))), return_inverse=True, return_counts=True)
                own = np.where(training_row[first + of], times[back.ravel()], 0)
                n_own[span] = np.where(training_row[span], np.bincount(of, minlength=len(held)), 0)
                own_phrases.append((first + of, hashes.view(np.int64), own.astype(np.int32), np.bincount(phrase[inside], mixture[inside], len(starts)).astype(np.float32)))
                lone = np.flatnonzero((c == 0) & is_word)
                all_words = p.codes.words
                rare.append((first + text[lone], [all_words[x] for x in codes[lone].tolist()], (phrase[lone] - place[text[lone]]).astype(np.int32), (logs[lone] / np.log(10)).astype(np.float32)))
                if p.codes.full():
                    p.reset()
                    known_counts, known_logs = np.array([n_docs]), logs_of(np.array([n_docs]))

            def ragged_rows(of: list[np.ndarray], fields: list, names: list[str]) -> pa.Array:
                each = np.concatenate(of) if of else np.zeros(0, np.int64)
                offsets = np.append(0, np.cumsum(np.bincount(each, minlength=size))).astype(np.int32)
                return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, names))

            joined = lambda parts, i, kind: pa.array(np.concatenate([x[i] for x in parts]) if parts else np.zeros(0, kind))
            rare_column = ragged_rows([x[0] for x in rare], [pa.array([w for x in rare for w in x[1]], pa.binary()), joined(rare, 2, np.int32), joined(rare, 3, np.float32)], ["word", "at", "log"])
            phrase_column = ragged_rows([x[0] for x in own_phrases], [joined(own_phrases, 1, np.int64), joined(own_phrases, 2, np.int32), joined(own_phrases, 3, np.float32)], ["phrase", "own", "log"])
            arrays = [keys, *map(pa.array, (n_tokens, n_pieces, n_known, n_own, base, got)), rare_column, phrase_column]
            return pa.RecordBatch.from_arrays(arrays, names=["k", "n_tokens", "n_pieces", "known", "n_own", "base", "score", "rare", "phrases"])

        return one

    schema = f"k {dict(rows.dtypes)['k']}, n_tokens long, n_pieces long, known long, n_own long, base double, score double, rare array<struct<word: binary, at: int, log: float>>, phrases array<struct<phrase: long, own: int, log: float>>"
    scored = scratch.keep(rows.mapInArrow(per_batch(make, ["k", "t", "held"]), schema).withColumn("row", F.monotonically_increasing_id()))
    # What the broadcast words leave: rare words, wherever they stand, and phrases that other documents have.
    found = scored.select("row", F.inline("rare")).join(words.where(~is_heavy), "word")
    listed = scored.select("row", "n_own", F.posexplode("phrases").alias("at", "p")).select("row", "n_own", "at", "p.*").join(phrases, "phrase").where("n > own")
    share = (F.col("n") - F.col("own")) / (F.lit(n_phrases) - F.col("n_own"))
    # Narrow rows: a rare word has its count and what its spelling gives, a phrase no count and what copying gives.
    rare = found.select("row", "at", F.col("n").cast("long").alias("n"), F.col("log").alias("x"))
    copied = listed.select("row", "at", F.lit(0).cast("long").alias("n"), (F.log10(F.lit(COPY / (1 - COPY)) * share) - F.col("log").cast("double")).cast("float").alias("x"))
    is_word = F.col("n") > 0
    counts_more = softplus10(F.log10(F.lit(counted / spelled) * F.greatest("n", F.lit(1))) - F.col("x").cast("double"))
    each = rare.unionByName(copied).repartition("row").groupBy("row", "at").agg(F.count_if(is_word).alias("rare"), F.sum(F.when(is_word, F.log10(F.col("n") + 1)).otherwise(0.0)).alias("logs"), F.sum(F.when(is_word, counts_more).otherwise(0.0)).alias("more"), F.max(F.when(~is_word, F.col("x").cast("double"))).alias("copy"))
    mixed_in = F.coalesce(softplus10(F.col("copy") - F.col("more")), F.lit(0.0))
    extra = each.groupBy("row").agg(F.sum("rare").alias("x_known"), F.sum("logs").alias("x_base"), F.sum(F.col("more") + mixed_in).alias("x_score"), F.count("copy").alias("x_copied"))
    out = scored.select("row", "k", "n_tokens", "n_pieces", "known", "base", "score", F.size("phrases").alias("n_phrases")).join(extra, "row", "left").na.fill(0, ["x_known", "x_base", "x_score", "x_copied"])
    out = out.select("k", "n_tokens", "n_pieces", (F.col("known") + F.col("x_known")).alias("n_known"), (F.col("base") + F.col("x_base") - F.col("n_tokens") * F.lit(below)).alias("base_score"), (F.col("score") + F.col("x_score")).alias("score"), (F.col("x_copied") / F.greatest("n_phrases", F.lit(1))).alias("copied"))
    return out.select(F.col("k").alias(key), is_held_out(F.col("k")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", "n_pieces", "copied", ((F.col("score") - F.col("base_score")) / F.col("n_tokens")).alias("gain"))
