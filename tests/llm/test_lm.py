import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tests.llm.texts import EDGE, edge, empty
from weftline.llm import lm, queries


def brute(rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    training = [(t or "") for i, t in rows if not held(i)]
    counts = Counter(w for t in training for w in t.encode().lower().split())
    n, v = sum(counts.values()) + len(training), len(counts) + bool(training)
    out = []
    for i, t in rows:
        words = (t or "").encode().lower().split()
        c = [counts[w] for w in words] + [len(training)]
        out.append((i, held(i), len(c), sum(x > 0 for x in c), n, float(np.sum(np.log10(np.array(c) + 1.0)) - len(c) * np.log10(n + v + 1))))
    return out


def check(found, rows):
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in found), key=repr)
    for g, w in zip(got, sorted(brute(rows), key=repr), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5])


def naive_logs(weights, letters, words):
    """Natural logs of the attention's probabilities of a text's tokens, piece after piece, in plain loops."""
    w = {}
    at = 0
    for name, shape in lm.Attention.SHAPES.items():
        size = int(np.prod(shape))
        w[name] = weights[at : at + size].reshape(shape).astype(np.float64)
        at += size
    pieces = lm.Pieces(lm.tokenizer_file("piece_bpe_32k.model"))
    tokens = [*pieces.encode(words), [pieces.end]] if words else [[pieces.end]]
    ids = [i for t in tokens for i in t]
    inputs = [lm.Attention.START, *(letters.rows[i] for i in ids)]
    emb, each, gates = w["emb"], [], []
    for j, goal in enumerate(ids):
        begin = max(0, j - j % lm.BLOCK - lm.CONTEXT)
        seen = inputs[begin : j + 1]
        q = emb[seen[-1]] @ w["q"] / np.sqrt(lm.DIM)
        s = np.array([q @ (emb[x] @ w["k"]) + w["near"][len(seen) - 1 - i] for i, x in enumerate(seen)])
        a = np.exp(s) / np.exp(s).sum()
        f = np.concatenate([sum(p * (emb[x] @ w["v"]) for p, x in zip(a, seen)), emb[seen[-1]]])
        side = int(letters.leads[goal])
        z = f @ w["o"][side] + w["b"][side]
        each.append(z[letters.classes[goal]] - np.log(np.exp(z).sum()) + letters.shares[goal])
        starts = 1 / (1 + np.exp(-(f @ w["gate"] + w["gate0"][0])))
        gates.append((starts, bool(side)))
    out, j = [], 0
    for t in tokens:
        total = 0.0
        for k in range(len(t)):
            total += each[j + k]
            if k:
                starts, side = gates[j + k]
                total += np.log(starts if side else 1 - starts)
        j += len(t)
        if j < len(ids):
            total += np.log(gates[j][0])
        out.append(total)
    return out


def naive_phrases(words):
    """Lists of a text's phrases, as tuples of words, the end being None."""
    step, end, h = int(lm.Phrases.STEP), int(lm.Phrases.END), [xxhash.xxh3_64_intdigest(w) for w in words]
    out, now = [], []
    for i, w in enumerate(words):
        now.append(w)
        before = h[i - 1] if i else end
        pair = np.array([(before * step + h[i]) % (1 << 64)], np.uint64)
        if 0 < i < len(words) - 1 and int(lm.mixed(pair)[0]) % lm.PHRASE == 0:
            out.append(tuple(now))
            now = []
    return [*out, (*now, None)] if words else []


def naive_scores(rows, weights, letters):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    texts = [((t or "").encode().lower().split(), held(i)) for i, t in rows]
    counts, phrases, n_docs = Counter(), Counter(), 0
    for words, out in texts:
        if not out:
            counts.update(words)
            phrases.update(naive_phrases(words))
            n_docs += 1
    n, m = sum(counts.values()) + n_docs, sum(phrases.values())
    got = []
    for words, out in texts:
        logs = naive_logs(weights, letters, words)
        p = [lm.SPELL * np.exp(x) + (1 - lm.SPELL) * (c + np.exp(x)) / (n + 1) for x, c in zip(logs, [*(counts[w] for w in words), n_docs], strict=True)]
        own, at, total = Counter() if out else Counter(naive_phrases(words)), 0, 0.0
        for phrase in naive_phrases(words):
            mine = float(np.prod(p[at : at + len(phrase)]))
            at += len(phrase)
            others = phrases[phrase] - own[phrase]
            total += np.log10((1 - lm.COPY) * mine + (lm.COPY * others / (m - own.total()) if others else 0.0))
        got.append(total if words else float(np.log10(p[0])))
    return got


@pytest.fixture
def captured(monkeypatch):
    """What ``score`` trained: weights and alphabet."""
    held, train, alphabet = {}, lm.train, lm.Alphabet
    monkeypatch.setattr(lm, "train", lambda *a: held.setdefault("weights", train(*a)))
    monkeypatch.setattr(lm, "Alphabet", lambda *a: held.setdefault("letters", alphabet(*a)))
    return held


TEXTS = [f"the {w} of a w{i} and {w} nothing x{i * 7} " * (1 + i % 3) + "the quick brown fox jumps over the lazy dog again" * (i % 4 == 0) for i, w in enumerate("alpha beta gamma delta epsilon zeta eta theta iota kappa".split() * 3)]


def test_scores_match_a_plain_forward_pass(spark, captured):
    """Attention, words, phrases and what copies add, against loops over the definition; with and without broadcast words."""
    rows = [*enumerate(TEXTS), (100, TEXTS[3]), (101, TEXTS[0]), (102, None), (103, ""), (104, "Üñï ▁ \x00 odd"), (None, TEXTS[5]), (105, " ".join(TEXTS))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"]): r for r in lm.score(docs).collect()}
    want = naive_scores(rows, captured["weights"], captured["letters"])
    for (i, _), w in zip(rows, want, strict=True):
        assert found[i]["score"] == pytest.approx(w, rel=1e-4, abs=1e-3), i


def test_rare_words_count_as_broadcast_ones_do(spark, monkeypatch):
    rows = [*enumerate(TEXTS), (200, TEXTS[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r["doc_id"]: r for r in lm.score(docs).collect()}
    monkeypatch.setattr(lm, "HEAVY", 0)
    found = lm.score(docs).collect()
    check(found, rows)
    assert all(r["score"] == pytest.approx(want[r["doc_id"]]["score"], rel=1e-5) for r in found)


def test_scores_dont_depend_on_partitions(spark):
    rows = list(enumerate(TEXTS * 2))
    one = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    many = spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(7)
    a, b = ({r["doc_id"]: r["score"] for r in lm.score(d).collect()} for d in (one, many))
    assert all(a[i] == pytest.approx(b[i], abs=1e-6) for i in a)


def test_texts_that_occur_twice_stand_apart(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").dropDuplicates(["text"]).collect() if len((r["text"] or "").split()) > 40]
    twice = [(100_000 + i, t) for i, t in rows[::10]]
    found = lm.score(spark.createDataFrame(rows + twice, "doc_id long, text string")).collect()
    held = {r["doc_id"]: r["held_out"] for r in found}
    pairs = [(i, j) for (i, _), (j, _) in zip(rows[::10], twice, strict=True)]
    both = {x for p in pairs for x in p}
    marked = {x for i, j in pairs for x, y in ((i, j), (j, i)) if not held[y]}  # the other one was learnt from
    gain = {r["doc_id"]: r["gain"] for r in found}
    clean = sorted(g for i, g in gain.items() if i not in both)
    assert len(marked) > 20 and sum(gain[i] > clean[int(len(clean) * 0.9)] for i in marked) > 0.9 * len(marked)


def test_base_scores_on_edges(spark):
    found = lm.score(edge(spark)).collect()
    check(found, EDGE)
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in found)


def test_query(spark, data):
    """Held-out texts are likelier by the model than by words' counts with unknown words spelled by pieces' counts."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    found = queries.op2_lm_scoring(spark, data).collect()
    check(found, rows)
    held = {r["doc_id"]: r for r in found if r["held_out"]}
    pieces = lm.Pieces(lm.tokenizer_file("piece_bpe_32k.model"))
    training = Counter(w for i, t in rows if i not in held for w in (t or "").encode().lower().split())
    encoded = dict(zip(training, pieces.encode(list(training)), strict=True))
    seen = np.ones(pieces.end + 1)
    for w, ids in encoded.items():
        np.add.at(seen, ids, training[w])
    seen[pieces.end] += sum(training.values())  # a word's end
    chance, total, plain = np.log10(seen / seen.sum()), training.total(), 0.0
    for i, t in rows:
        if i in held:
            for w in (t or "").encode().lower().split():
                c = training[w]
                plain += np.log10(c / (total + 1)) if c else np.log10(1 / (total + 1)) + chance[pieces.encode([w])[0]].sum() + chance[pieces.end]
    assert sum(r["score"] for r in held.values()) > plain


def test_empty(spark):
    assert lm.score(empty(spark)).count() == 0


def test_only_held_out(spark):
    """Nothing to train on."""
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    found = lm.score(spark.createDataFrame([(i, "some words here") for i in ids], "doc_id long, text string")).collect()
    assert len(found) == len(ids) and all(r["train_tokens"] == 0 and np.isfinite(r["score"]) for r in found)


def test_windows_score_each_piece_once():
    sizes = np.array([1, 5, 32, 33, 100])
    at, absent, target, real = lm.windows(sizes)
    assert sorted(target[real]) == list(range(sizes.sum()))
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    for row, gone, goals, ok in zip(at, absent, target, real, strict=True):
        for k in np.flatnonzero(ok):
            seen = row[: lm.CONTEXT + k + 1][~gone[: lm.CONTEXT + k + 1]]
            first = begin[goals[k]]
            assert seen[-1] == (goals[k] - 1 if goals[k] > first else -1)
            assert all(x == -1 or first <= x < goals[k] for x in seen)


def example(n):
    rng = np.random.default_rng(0)
    rows = rng.integers(0, lm.EMBEDDED + lm.SHARED, (n, lm.BLOCK + lm.CONTEXT))
    return rows, np.zeros(rows.shape, bool), rng.integers(0, lm.N_CLASSES, (n, lm.BLOCK)), rng.integers(0, 2, (n, lm.BLOCK)).astype(bool)


def test_attention_is_causal_and_batched():
    """A piece's probability depends on nothing after it, and not on its batch."""
    net = lm.Attention()
    net.prepare()
    rows, absent, goal, leads = example(3)
    absent[1, :5] = True
    whole = net.log_scores(rows, absent, goal, leads)
    changed = rows.copy()
    changed[:, lm.CONTEXT + 10 :] = 1
    again = net.log_scores(changed, absent, goal, leads)
    for a, b in zip(whole, again, strict=True):
        assert np.allclose(a[:, :10], b[:, :10], atol=1e-5) and not np.allclose(a[:, 10:], b[:, 10:])
    alone = net.log_scores(rows[:1], absent[:1], goal[:1], leads[:1])
    assert all(np.allclose(a[0], b[0], atol=1e-5) for a, b in zip(whole, alone, strict=True))
    every = [np.exp(net.log_scores(rows, absent, np.full_like(goal, c), leads)[0]) for c in range(lm.N_CLASSES)]
    assert np.allclose(sum(every), 1, atol=1e-4)


def test_gradient_matches_differences():
    net = lm.Attention()
    rows, absent, goal, leads = example(2)
    real = np.ones(goal.shape, bool)
    real[1, 20:] = False
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}

    def loss():
        net.prepare()
        own, gate = net.log_scores(rows, absent, goal, leads)
        return -(own - np.logaddexp(0, np.where(leads, -1, 1) * gate))[real].mean()

    gradient = net.gradient(rows, absent, goal, leads, real)
    for name in net.SHAPES:
        at = np.unravel_index(np.abs(gradient[name]).argmax(), gradient[name].shape)
        net.w[name][at] += 1e-4
        up = loss()
        net.w[name][at] -= 2e-4
        down = loss()
        net.w[name][at] += 1e-4
        assert gradient[name][at] == pytest.approx((up - down) / 2e-4, rel=1e-2, abs=2e-5), name


def test_training_takes_every_piece():
    """Each piece of each training text, and each text's end, is a target once."""
    texts = [x.encode() for x in [f"one w{i} three" for i in range(30)] + ["", " ".join(f"w{i % 97}" for i in range(2000))]]
    pieces = lm.Pieces(lm.tokenizer_file("piece_bpe_32k.model"))
    letters = lm.Alphabet(lm.tokenizer_file("piece_bpe_32k.model"), np.ones(pieces.end + 1))
    model = lm.Attention()
    state = {"steps": 0, "seen": 0, **{n: {k: np.zeros_like(a) for k, a in model.w.items()} for n in ("first", "second")}}
    lm.walk(texts, pieces, letters, model, np.random.default_rng(1), state)
    assert state["seen"] == sum(len(e) for t in texts for e in pieces.encode(t.split())) + len(texts)
    assert lm.BLOCK >= 32 and lm.CONTEXT >= 16


def test_a_step_works_out_its_batch_at_once(monkeypatch):
    """One gradient for each step of the training, the last of what is left."""
    texts = [" ".join(f"w{i % 97}" for i in range(9000)).encode()]
    pieces = lm.Pieces(lm.tokenizer_file("piece_bpe_32k.model"))
    letters = lm.Alphabet(lm.tokenizer_file("piece_bpe_32k.model"), np.ones(pieces.end + 1))
    model, sizes, gradient = lm.Attention(), [], lm.Attention.gradient
    monkeypatch.setattr(lm.Attention, "gradient", lambda self, rows, *a: sizes.append(len(rows)) or gradient(self, rows, *a))
    state = {"steps": 0, "seen": 0, **{n: {k: np.zeros_like(a) for k, a in model.w.items()} for n in ("first", "second")}}
    lm.walk(texts, pieces, letters, model, np.random.default_rng(1), state)
    assert sizes[:-1] == [lm.BATCH] * (state["steps"] - 1) and sum(sizes) == -(-state["seen"] // lm.BLOCK) and len(sizes) > 2


def test_phrases():
    words = [f"w{i % 400}".encode() for i in range(3000)]
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    sizes = np.array([1000, 0, 1, 1000, 999])
    found, starts, text = lm.Phrases().of(hashes, sizes)
    want, at = [], 0
    for i, n in enumerate(sizes):
        want += [(i, p) for p in naive_phrases(words[at : at + n])]
        at += n
    assert text.tolist() == [i for i, _ in want]
    same = {}
    for (_, p), h in zip(want, found.tolist(), strict=True):
        assert same.setdefault(p, h) == h
    assert len(set(same.values())) == len(same)


def test_a_step_reuses_its_memory():
    """Steps and scoring work in arrays that they keep: fresh ones cost page faults. What is left in them changes nothing."""
    net, other = lm.Attention(), lm.Attention()
    rows, absent, goal, leads = example(lm.BATCH)
    real = np.ones(goal.shape, bool)
    first = net.gradient(rows, absent, goal, leads, real)
    gone, fewer = absent.copy(), real.copy()
    gone[:7, :5], fewer[20:30, 3:] = True, False
    net.gradient(rows[::-1], gone, goal, ~leads, fewer)
    net.gradient(rows[:5], gone[:5], goal[:5], leads[:5], fewer[:5])
    again = net.gradient(rows, absent, goal, leads, real)
    assert all(np.array_equal(first[k], again[k]) for k in first)
    half = other.gradient(rows[:5], gone[:5], goal[:5], leads[:5], fewer[:5])
    got = net.gradient(rows[:5], gone[:5], goal[:5], leads[:5], fewer[:5])
    assert all(np.array_equal(half[k], got[k]) for k in half)
    net.prepare()
    net.log_scores(rows, absent, goal, leads)
    tracemalloc.start()
    net.gradient(rows, absent, goal, leads, real)
    _, step = tracemalloc.get_traced_memory()
    tracemalloc.reset_peak()
    held, _ = tracemalloc.get_traced_memory()
    net.log_scores(rows, absent, goal, leads)
    _, scoring = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    scores = lm.BATCH * lm.BLOCK * (lm.BLOCK + lm.CONTEXT) * 4
    assert step < 5 * scores and scoring - held < 2 * scores, (step / scores, (scoring - held) / scores)


def test_words_of_many_texts_at_once():
    """As text by text: the same words in the same order, whatever lies between them."""
    texts = ["", " ", " a  B ", "".join(map(chr, range(300))) + " x", "A\x1cB\x85c d\x0be\x0cf", "İ É é a", "\x00 \x00\x00", "b a" * 50]
    for given in (texts, texts[2:5], [], [b"a\tB", b""]):
        one, many = lm.WordCodes(), lm.WordCodes()
        want = [one.of_text((t.encode() if isinstance(t, str) else t).lower()) for t in given]
        found = many.of_texts(pa.array(given, pa.binary() if given and isinstance(given[0], bytes) else pa.string()))
        assert [x.tolist() for x in found] == [x.tolist() for x in want] and many.words == one.words
    sliced = pa.array(texts)[1:4]
    assert [len(x) for x in lm.WordCodes().of_texts(sliced)] == [len(t.encode().split()) for t in texts[1:4]]
