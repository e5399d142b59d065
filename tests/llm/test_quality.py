from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.compare import same
from tests.llm.texts import EDGE, clashing, edge, empty
from weftline.llm import queries, quality


def brute(text):
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in quality.SYMBOLS for c in text or ""), dup, len(covered)


def test_figures_match_brute_force(spark):
    for r in quality.base_figures(edge(spark)).collect():
        want = brute(r["text"])
        assert tuple(r[f] for f in quality.FIGURES) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n\t\x0b\xa0#", max_size=60), min_size=1, max_size=20))
def test_random_texts(spark, texts):
    rows = quality.base_figures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(tuple(r[f] for f in quality.FIGURES) == brute(r["text"]) for r in rows)


def test_order_changes_no_verdict(spark):
    docs = edge(spark)
    forward = {(r["doc_id"], r["text"]): r["kept"] for r in quality.judge(docs, ordered=list(quality.RULES)).collect()}
    backward = {(r["doc_id"], r["text"]): r["kept"] for r in quality.judge(docs, ordered=list(quality.RULES)[::-1]).collect()}
    assert forward == backward and len(forward) == len(EDGE) - 1


def test_rules_are_ordered_by_rejection_per_cost(spark, data):
    ordered, told = quality.order_rules(spark.read.parquet(f"{data}/documents.parquet"))
    shares = {name: share for name, _, share in told}
    assert {r.name for r in ordered} == {r.name for r in quality.RULES} and all(0 <= s <= 1 for s in shares.values())
    rejecting = [shares[r.name] > 0 for r in ordered]
    assert rejecting == sorted(rejecting, reverse=True)


def test_the_order_stands(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert len({tuple(r.name for r in quality.order_rules(docs)[0]) for _ in range(6)}) == 1


def test_costs_are_of_the_rule(spark, monkeypatch):
    """A rule that does a hundred times the work stands behind one that rejects as much."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(quality, "SAMPLE_CHARS", 200_000)

    def slow(t, f):
        return F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.lit(0), lambda a, i: a + F.length(F.regexp_replace(F.concat(t, i.cast("string")), "[aeiou]+", ""))) > 0

    rules = [quality.Rule("slow", slow), quality.Rule("fast", lambda t, f: F.length(t) > 0)]
    docs = spark.createDataFrame([(i, f"some {i} words that stand here again and again for a while number {i}") for i in range(300)], "doc_id long, text string")
    for _ in range(3):
        ordered, told = quality.order_rules(docs, rules)
        assert [r.name for r in ordered] == ["fast", "slow"] and dict((n, s) for n, _, s in told) == {"slow": 1.0, "fast": 1.0}


def test_passing_keeps_columns_as_they_are(spark):
    text = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, text, 99, "mine"), (2, "x", 98, "too short")], "doc_id long, text string, n_words int, kept string")
    assert [tuple(r) for r in quality.passing(docs).collect()] == [(1, text, 99, "mine")]
    assert quality.passing(empty(spark)).columns == ["doc_id", "text"]


def test_edges(spark):
    assert quality.judge(empty(spark)).count() == 0
    assert quality.judge(clashing(spark, "n_words", "kept")).count() == 1


def test_query(spark, data, duck):
    same(queries.op1_quality_rules(spark, data), duck, queries.ORACLE_SQL["op1_quality_rules"])
