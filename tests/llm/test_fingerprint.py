import hashlib
import random

import pytest

from tests.llm.texts import edge, empty
from weftline.llm import fingerprint, queries


def paragraphs(text):
    """Lines, cut after the first sentence end from the 201st character on; again for what is left.  Short texts also by words."""
    out = set()
    for line in text.split("\n"):
        while len(line) > fingerprint.LONG:
            ends = [i + 1 for i in range(fingerprint.LONG, min(2 * fingerprint.LONG, len(line) - 1)) if line[i] in ".!?" and line[i + 1] in " \t\x0b\x0c\r"]
            if not ends and len(line) < 2 * fingerprint.LONG:
                break
            ends = ends or [2 * fingerprint.LONG]
            out.add(line[: ends[0]])
            line = line[ends[0] :]
        if line:
            out.add(line)
    if len(text) <= fingerprint.SHORT:
        while text:
            at = next((i + 1 for i in range(fingerprint.PIECE, len(text)) if text[i] in " \t\n\x0b\x0c\r"), len(text))
            out.add((1, text[:at]))
            text = text[at:]
    return out


def likeness(a, b):
    x, y = paragraphs(a), paragraphs(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def brute(rows):
    """By id and text, for rows with distinct ids."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: -(r[0] if r[0] is not None else -(1 << 63)))
    out = []
    for k, (i, t) in enumerate(rows):
        after, take = rows[(k + 1) % len(rows)][1], len(t) // 3
        edited = t[: len(t) - take] + after[:take]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), likeness(t, edited), likeness(t, after)))
    return sorted(out, key=repr)


def check(found, rows):
    got = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in found), key=repr)
    for g, w in zip(got, brute(rows), strict=True):
        assert g[:3] == w[:3] and g[3:] == pytest.approx(w[3:])


def test_many_paragraphs_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "ROWS_PER_RANGE", 7)
    rng = random.Random(1)
    rows = [(i * 3 - 40, "\n".join(f"line {rng.randrange(40)}" for _ in range(rng.choice([0, 1, 3, 40, 400])))) for i in range(40)]
    found = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(found, rows)
    by_text = {}
    for r, (_, t) in zip(sorted(found, key=lambda r: r["doc_id"]), rows, strict=True):
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]


def test_long_lines(spark):
    rng = random.Random(3)
    say = lambda n: " ".join("word " * rng.randrange(1, 12) + rng.choice(["end.", "what?", "so!", "no.more", "."]) for _ in range(n))
    rows = [(i, "\n".join(say(rng.choice([1, 5, 40])) for _ in range(rng.choice([1, 1, 3])))) for i in range(30)]
    found = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(found, rows)
    long_line = {i for i, t in rows if len(t) > 1200 and t.count("\n") < 2}
    assert long_line and all(r["near_edited"] > 0.3 for r in found if r["doc_id"] in long_line)


def test_retries_until_everything_peels(spark, monkeypatch):
    """Groups far too small fail at first and are built again larger."""
    monkeypatch.setattr(fingerprint, "PER_GROUP", 400)
    rows = [(i, "\n".join(f"{i} {k}" for k in range(100))) for i in range(5)]
    check(fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_edges(spark):
    docs = edge(spark).where("doc_id is null or doc_id != 6")
    check(fingerprint.fingerprints(docs).collect(), [tuple(r) for r in docs.collect()])
    repeated = fingerprint.fingerprints(edge(spark).where("doc_id = 6")).collect()
    assert len(repeated) == 2 and repeated[0] == repeated[1] and repeated[0]["near_next"] == 1.0
    assert fingerprint.fingerprints(empty(spark)).count() == 0
    one = spark.createDataFrame([(1, "a\nb", "x")], "doc_id long, text string, kid string")
    assert fingerprint.fingerprints(one).collect()[0]["near_next"] == 1.0


def test_likeness_from_the_returned_strings_alone(spark):
    """Folded, subtracted and peeled; strings that don't peel are few among edited texts, and what peels is exact."""
    rng = random.Random(9)
    texts = ["\n".join(f"line {rng.randrange(10_000)}" for _ in range(rng.choice([0, 1, 5, 30, 300]))) for _ in range(60)]
    found = fingerprint.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    told = {r["doc_id"]: r["near_edited"] for r in found.collect()}
    near = {r["doc_id"]: r["near"] for r in fingerprint.compare(found, ["doc_id"]).collect()}
    assert set(near) == set(told) and sum(v is None for v in near.values()) <= 6
    assert all(v is None or v == pytest.approx(told[k]) for k, v in near.items())
    # Any two fingerprints, of whatever sizes.
    pairs = found.selectExpr("doc_id", "fingerprint as a").crossJoin(found.where("doc_id < 8").selectExpr("doc_id as other", "fingerprint as b"))
    for r in fingerprint.compare(pairs, ["doc_id", "other"], "a", "b").where("near is not null").collect():
        assert r["near"] == pytest.approx(likeness(texts[r["doc_id"]], texts[r["other"]]))
    assert fingerprint.compare(spark.createDataFrame([(1, None, "iblt1"), (2, "iblt1", "iblt4")], "doc_id int, a string, b string"), ["doc_id"], "a", "b").orderBy("doc_id").collect() == [(1, None), (2, 1.0)]


def test_short_texts_have_a_likeness(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("length(text) > 150")
    found = fingerprint.fingerprints(docs).select("near_edited").collect()
    assert sum(r["near_edited"] == 0 for r in found) <= 0.01 * len(found)


def test_query(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    check(queries.op10_fingerprint(spark, data).collect(), rows)
