import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import same
from tests.llm.texts import clashing, edge, empty
from weftline.llm import queries, spelling
from weftline.llm.common import Scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    met = {w: sorted((v for v in n if near(w, v)), key=lambda v: (-n[v], v)) for w in n}
    form = {w: m[0] if m and n[m[0]] >= 2 * n[w] else None for w, m in met.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(met[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=lambda r: r[0])


def found(spark, rows, **options):
    out = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), **options)
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in out.collect()), key=lambda r: r[0])


def corpus(rng, n):
    """Words over few letters, so that blocks are large and edits meet in several places."""
    stems = ["".join(rng.choices("abÀç", k=rng.randrange(5, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "aaaaaaaaaaaaa", "aaaabaaaaaaaa"]
    rows = []
    for i in range(n):
        words = rng.choices(stems, k=40)
        for j in range(0, 40, 5):
            w, at = words[j], rng.randrange(len(words[j]))
            words[j] = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abç") + w[at:], w[:at] + rng.choice("abZ") + w[at + 1 :]])
        rows.append((rng.choice([i, None, 7]), " ".join(words) + rng.choice(["", "\n÷×", "-x9", "ÉCOLE"])))
    return rows


@pytest.mark.parametrize("block", [2, 8, 128])
def test_against_brute_force(spark, block):
    rows = corpus(random.Random(block), 60)
    rows += [(1, None), (2, ""), (3, "   "), rows[0], rows[0]]
    assert found(spark, rows, block=block) == brute(rows)


def test_a_hot_start(spark):
    """All words share both halves of most of their letters: blocks divide down to one place."""
    words = [f"{'k' * 12}{a}{b}{'z' * 12}" for a in "abcdefghijklm" for b in "nopqrstuvwxyz"] + ["k" * 12 + a + "z" * 12 for a in "abcd"]
    rows = [(i, " ".join(words)) for i in range(1, 7)]
    assert found(spark, rows, block=16) == brute(rows)


def test_blocks_are_bounded_and_ranges_disjoint(spark):
    words = [f"common{a}{b}{c}{d}" for a in "abcde" for b in "abcde" for c in "abcde" for d in "abc"]
    counted = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    rows = spelling.blocks(counted, Scratch(spark, "test"), 10)
    sizes = rows.where("longer = 0").groupBy("key").agg(F.count("*").alias("size"), F.first(F.col("hi") - F.col("lo")).alias("places")).where("places > 1").agg(F.max("size")).first()[0]
    assert sizes <= 10
    for w in ("commonaaaa", "commoneeec"):
        spans = sorted((r["lo"], r["hi"]) for r in rows.where((F.col("word") == w) & (F.col("longer") == 0)).select("lo", "hi").collect())
        assert spans[0][0] >= 0 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_near_in():
    def at(a, b):
        return int(spelling.near_in(*(np.frombuffer(x.encode("latin-1"), np.uint8)[None] for x in (a, b)))[0])

    assert at("abcde", "abxde") == 2 and at("abcde", "abcde") == -1 and at("abcde", "xbcdx") == -1
    assert at("aaaa", "aaaaa") == 4 and at("abcde", "xabcde") == 0 and at("abcde", "abcdxe") == 4 and at("abcde", "xxabcd") == -1


def test_edges(spark):
    assert spelling.variants(empty(spark)).count() == 0
    assert spelling.variants(clashing(spark, "word", "n", "key")).count() == 0
    long = [(r["word"], r["n"]) for r in spelling.variants(edge(spark)).collect()]
    assert ("three", 3) in long
    run = "q" * 2_000_000
    assert found(spark, [(i, f"{run} {run}r word{run}") for i in (1, 2, 3)]) == sorted([(run, None, run, 3, 1, None), (run + "r", None, run + "r", 3, 1, None), ("word" + run, None, "word" + run, 3, 0, None)])


def test_query(spark, data, duck):
    same(queries.op12_spelling_variants(spark, data), duck, queries.ORACLE_SQL["op12_spelling_variants"])
