import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.texts import clashing, edge, empty
from weftline.llm import pii, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def brute(t):
    """The patterns as they are written in the contract."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m) for m in EMAIL.finditer(t)]
    out += [("ip", m) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = digits(m[0])
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1]))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(((k, m.start(), m.end()) for k, m in out), key=lambda x: (x[1], pii.KINDS.index(x[0])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-+12 (3)4_59%é", max_size=80))
def test_base_spans_match_the_patterns(t):
    assert pii.detect(t) == brute(t)
    base, every = pii.find(t)
    assert base == brute(t) and set(base) <= set(every)


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("mail joe at example dot com now", "email", "joe at example dot com"),
        ("write joe [at] mail.example (dot) org.", "email", "joe [at] mail.example (dot) org"),
        ("jоe@exаmple.com", "email", "jоe@exаmple.com"),
        ("４１１１１１１１１１１１１１１１", "card", "４１１１１１１１１１１１１１１１"),
        ("call plus one two one two five five five one two three four ok", "phone", "plus one two one two five five five one two three four"),
        ("host 192 dot 168 dot 1 dot 1 is up", "ip", "192 dot 168 dot 1 dot 1"),
    ],
)
def test_disguises(text, kind, span):
    base, every = pii.find(text)
    assert base == [] and [(k, text[s:e]) for k, s, e in every] == [(kind, span)]
    assert pii.masked(text) == text.replace(span, f"[{kind.upper()}]")


@pytest.mark.parametrize("text", ["one two three four five", "look at this dot that", "we met at noon. two dots", "прогулка в парке", "four one one", "a (at) b"])
def test_clean_texts_stay(text):
    assert pii.find(text) == ([], []) and pii.masked(text) == text


def test_hidden_start_of_an_address():
    """The base span begins after the invisible character; the added one covers both parts."""
    text = "x j\u200boe@example.com y"
    base, every = pii.find(text)
    assert base == [("email", 4, 18)] and every == [("email", 2, 18), ("email", 4, 18)]
    assert pii.masked(text) == "x [EMAIL] y"


def test_mask_overlaps():
    assert pii.masked("a 4111 1111 1111 1111 b +1 (212) 555-1234 c x@y.zz") == "a [CARD] b [PHONE] c [EMAIL]"


def test_edges(spark):
    rows = {r["doc_id"]: r for r in pii.scan(edge(spark)).collect()}
    assert rows[1]["spans"] == "" and rows[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.scan(empty(spark)).count() == 0
    assert pii.scan(clashing(spark, "spans", "n_ip")).count() == 1
    masked = pii.mask(clashing(spark, "spans", "k"))
    assert masked.columns == ["doc_id", "text", "spans", "k"] and masked.count() == 1
    assert {r["doc_id"]: r["text"] for r in pii.mask(edge(spark)).collect()}[1] is None


def test_query(spark, data):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in queries.op8_personal_data(spark, data).collect():
        spans = brute(rows[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(pii.joined(spans).encode()).hexdigest()
        assert set(filter(None, pii.joined(spans).split(","))) <= set(r["spans"].split(","))
