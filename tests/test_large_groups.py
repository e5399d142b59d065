"""One document, key or token that holds a great part of all rows."""

import random
import time

from pyspark.sql import functions as F

from weftline.operators import diff, lines


def plain_ids(values, fixed):
    taken, out = [], []
    for v, f in zip(values, fixed, strict=True):
        own = v
        if not f and v in taken:
            n = 2
            while f"{v}-{n}" in taken:
                n += 1
            own = f"{v}-{n}"
        taken.append(own)
        out.append(own)
    return out


def test_numbered_against_the_definition(spark):
    rng = random.Random(5)
    pool = ["a", "a-2", "a-3", "a-2-2", "b", "b-2", "c", "section-1", "section-2", "section", "x-10", "x", "x-02", "2", "2-2"]
    rows, want = [], {}
    for doc in range(60):
        values = [rng.choice(pool[: 3 + doc % 13]) for _ in range(rng.randrange(1, 25))]
        fixed = [rng.random() < (0.3 if doc % 2 else 0) for _ in values]
        rows += [(doc, i, v, f) for i, (v, f) in enumerate(zip(values, fixed, strict=True))]
        want |= {(doc, i): x for i, x in enumerate(plain_ids(values, fixed))}
    out = lines.numbered(spark.createDataFrame(rows, "doc int, pos int, v string, f boolean"), ["doc"], "pos", F.col("v"), F.col("f"), "id")
    assert out.columns == ["doc", "pos", "v", "f", "id"]
    assert {(r["doc"], r["pos"]): r["id"] for r in out.collect()} == want


def test_twenty_thousand_equal_headings(spark):
    began = time.perf_counter()
    docs = spark.createDataFrame([("d", "# T\n" + "## Same\n" * 20_000), ("e", "# T\n" + "## Same 2\n## Same\n## Same\n" * 3_000)], "doc string, text string")
    ids = {(r["doc"], r["order"]): r["section_id"] for r in lines.sections(docs, ["doc"]).select("doc", "order", "section_id").collect()}
    assert time.perf_counter() - began < 60
    assert len(ids) == 29_002 and ids["d", 20_001] == "t-same-20000" and ids["d", 2] == "t-same"
    values = ["t", *["t-same-2", "t-same", "t-same"] * 40]
    assert [ids["e", i + 1] for i in range(len(values))] == plain_ids(values, [False] * len(values))


def test_kept_ids_of_a_large_document(spark):
    text = "# T\n" + "## Same\n" * 5_000
    found = lines.sections(spark.createDataFrame([("d", text)], "doc string, text string"), ["doc"])
    known = found.where("order <= 3000").withColumn("section_id", F.concat(F.lit("kept-"), F.col("order").cast("string")))
    ids = {r["order"]: r["section_id"] for r in lines.match_ids(found, lines.skeleton(known, ["doc"]), ["doc"]).collect()}
    assert ids[1] == "kept-1" and ids[3000] == "kept-3000" and ids[3001] == "t-same" and ids[5001] == "t-same-2001"


def plain_innermost(point, intervals):
    held = [(e - s, s, t, name) for name, s, e, t in intervals if s <= point <= e]
    return min(held)[3] if held else None


def test_innermost_against_the_definition(spark):
    rng = random.Random(8)
    intervals = []
    for i in range(1500):
        s = rng.choice([rng.randrange(-300, 300), rng.randrange(-5, 5)])
        intervals.append((i % 3, f"i{i}", s, s + rng.choice([0, 1, 3, 15, 16, 17, 63, 64, 300, 5000, -1]), rng.randrange(50) * 2000 + i))
    points = [(i, i % 4, rng.randrange(-400, 700)) for i in range(800)]
    found = diff.innermost(spark.createDataFrame(points, "id int, k int, line int"), spark.createDataFrame(intervals, "k int, name string, s int, e int, t int"), ["k"], "line", "s", "e", "name", "t")
    want = {i: plain_innermost(p, [x[1:] for x in intervals if x[0] == k]) for i, k, p in points}
    assert {r["id"]: r["name"] for r in found.collect()} == {i: n for i, n in want.items() if n is not None}


def test_intervals_over_each_other_make_no_product(spark):
    """All of 20,000 intervals hold all of 20,000 points."""
    intervals = spark.range(20_000).selectExpr("0 as k", "concat('i', id) as name", "-id as s", "1000000 + id as e", "id as t")
    points = spark.range(20_000).selectExpr("id", "0 as k", "id as line")
    began = time.perf_counter()
    assert diff.innermost(points, intervals, ["k"], "line", "s", "e", "name", "t").where("name = 'i0'").count() == 20_000
    assert time.perf_counter() - began < 40


def test_top_overlaps_against_the_definition(spark):
    from weftline.operators import overlap

    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)]
    some = lambda n: rng.sample(words[: rng.choice([5, 40])], min(n, 5))
    changes = [(i, some(rng.randrange(0, 5)) if i % 9 else None) for i in range(70)]
    sections = [(f"s{i:03}", some(3), some(5) if i % 7 else None) for i in range(60)]
    weights = {"h": (6.0, 2), "c": (2.0, 3)}
    want = set()
    for change, tokens in changes:
        count = lambda x: len(set(tokens or ()) & set(x or ()))  # noqa: E731, B023
        scored = sorted((-score, name) for name, h, c in sections if (score := 6.0 * min(2, count(h)) + 2.0 * min(3, count(c))))
        want |= {(change, name, -score, r + 1) for r, (score, name) in enumerate(scored[:3])}
    frames = spark.createDataFrame(changes, "change int, tokens array<string>"), spark.createDataFrame(sections, "section string, h array<string>, c array<string>")
    for share in (7, 1000):
        out = overlap.top_overlaps(*frames, "change", "section", weights, share_tokens=share)
        assert {(r["change"], r["section"], r["score"], r["rank"]) for r in out.collect()} == want
    assert overlap.top_overlaps(frames[0].limit(0), frames[1], "change", "section", weights).count() == 0
    assert overlap.top_overlaps(frames[0], frames[1].limit(0), "change", "section", weights).count() == 0


def test_routing_makes_no_pairs(spark, data):
    """No operator of the plan joins documents and sections by token."""
    from weftline.plans import catalog

    plan = catalog.QUERIES["section_route_top3"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_names_in_texts_against_contains(spark):
    from weftline.operators.names import named_in

    rng = random.Random(3)
    names = [(i % 4, "".join(rng.choices("abé.", k=rng.randrange(0, 4)))) for i in range(200)] + [(0, None)]
    texts = [(i % 5, f"t{i}", "".join(rng.choices("abcé. ", k=rng.randrange(0, 30))) if i % 11 else None) for i in range(120)]
    frames = spark.createDataFrame(texts, "doc int, id string, body string"), spark.createDataFrame(names, "doc int, name string")
    want = {(d, i): sorted({n for k, n in names if k == d and n and n in (t or "")}) for d, i, t in texts}
    for share in (3, 1000):
        found = {(r["doc"], r["id"]): r["found"] for r in named_in(*frames, ["doc"], "id", "body", share_names=share).collect()}
        assert found == {k: v for k, v in want.items() if v}
    assert named_in(frames[0], frames[1].limit(0), ["doc"], "id", "body").count() == 0
