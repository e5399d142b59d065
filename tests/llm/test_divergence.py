import random

import duckdb
import pytest

from tests.compare import same
from weftline.llm import divergence, queries

SCHEMA = "text string, lang string, source string"


def rows_of(rng, n, sources=4):
    words = [f"{a}{b}" for a in ("lo", "né", "KA", "tu", "ß") for b in ("m", "ri", "Xa", "東")]
    weights = {(lang, s): [rng.random() ** 3 for _ in words] for lang in ("a", "b", None) for s in range(sources)}
    out = []
    for _ in range(n):
        lang, s = rng.choice(["a", "a", "b", None]), rng.choice([0] * 4 + list(range(sources)))
        out.append((" ".join(rng.choices(words, weights[lang, s], k=rng.randrange(1, 30))) + rng.choice(["", "\n", "_x1 y-z", "\x00"]), lang, None if s == 3 else f"s{s}"))
    return out


def against_sql(spark, rows, **options):
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["text", "lang", "source"]))
    same(divergence.audit(spark.createDataFrame(rows, SCHEMA), **options), con, queries.ORACLE_SQL["op11_source_divergence"])


@pytest.mark.parametrize("seed", [1, 2])
def test_against_sql(spark, seed):
    rows = rows_of(random.Random(seed), 240)
    rows += [(None, "a", "s0"), ("", "a", "only here"), ("few terms", "z", "one"), ("few", "z", "two"), ("", "", "s0"), (rows[0])]
    against_sql(spark, rows, shard_rows=20)


def test_long_texts_and_a_hot_source(spark):
    rng = random.Random(3)
    rows = rows_of(rng, 120) + [(" ".join(rng.choice(["lom", "nég", "tuß"]) for _ in range(400_000)), "a", "s0"), ("x" * 3_000_000 + " lom", "a", "s1")]
    against_sql(spark, rows + [("lom tum", "a", "s0")] * 200)


def test_tasks_that_hold_too_much(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_ROWS", 10)
    monkeypatch.setattr(divergence, "COUNTED_BYTES", 200)
    against_sql(spark, rows_of(random.Random(4), 150))


def test_empty_and_clashing(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []
    clash = spark.createDataFrame([("one", "a", "s", "x", "y", 1), ("one", "a", "t", "x", "y", 2)], SCHEMA + ", term string, value string, shard int")
    assert sorted(tuple(r) for r in divergence.audit(clash).collect()) == [("a", "s", "pair", "t", 0, 1), ("a", "t", "pair", "s", 0, 1)]


def test_query(spark, data, duck):
    same(queries.op11_source_divergence(spark, data), duck, queries.ORACLE_SQL["op11_source_divergence"])
