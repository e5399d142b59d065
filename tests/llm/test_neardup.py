import random

import numpy as np

from tests.compare import same
from tests.llm.texts import clashing, edge, empty
from weftline.llm import components, neardup, queries
from weftline.llm.common import Scratch


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return sorted((d, len(sets[i]), low[root(i)], low[root(i)] == d) for i, (d, _) in enumerate(rows))


def found(docs):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.classes(docs).collect())


def test_hot_group_of_near_copies(spark):
    """Chains of edits around one text: links that no single hub sees."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 160):
        words = rows[rng.randrange(len(rows))][1].split() if i % 3 else list(base)
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9999)}"
        rows.append((i * 7 % 1000, " ".join(words)))
    rows += [(2000 + i, f"a short text number {i}") for i in range(20)] + [(3000 + i, "a b c d e") for i in range(4)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_edges(spark):
    rows = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.classes(edge(spark)).collect()}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 5, True), (6, 1, 5, False), (None, 1, None, True)} <= rows
    assert neardup.classes(empty(spark)).count() == 0
    assert neardup.classes(clashing(spark, "node", "digest", "component_id")).count() == 1
    kept = neardup.keep_one(edge(spark)).collect()
    assert sorted(r["doc_id"] or -1 for r in kept) == [-1, 1, 2, 3, 4, 5, 7, 8, 9]


def test_rows_that_share_an_id(spark):
    rows = [(1, "a b c d e f"), (1, "p q r s t u"), (2, "p q r s t u"), (3, "a b c d e f"), (3, "a b c d e f")]
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, "a b c d e f"), (1, "p q r s t u")]


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(1)
    for size, common in ((400, 300), (50, 45), (3000, 1000)):
        every = rng.integers(0, 1 << 63, 2 * size - common, dtype=np.uint64)
        a, b = np.sort(every[:size]), np.sort(every[-size:])
        sketch = neardup.sketch([a, b])
        like = neardup.estimate(sketch[:1], sketch[1:], np.array([size]), np.array([size]))[0]
        assert abs(like - common / (2 * size - common)) < 0.15


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (100, 102)]
    out = components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"))
    assert {(r["node"], r["component"]) for r in out.collect()} == {(i, 0) for i in range(31)} | {(i, 100) for i in (100, 101, 102)}


def test_query(spark, data, duck):
    same(queries.op5_near_duplicates(spark, data), duck, queries.ORACLE_SQL["op5_near_duplicates"])
