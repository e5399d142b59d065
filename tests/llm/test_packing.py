import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from tests.llm.texts import EDGE, clashing, edge, empty
from weftline.llm import packing, queries
from weftline.llm.common import tokenizer_file


def brute(texts):
    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    return [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [packing.END_ID], "<u4") for t in texts]


def check(rows, docs, limit=packing.LIMIT):
    want = [(i, len(ids), zlib.crc32(ids)) for (i, _), ids in zip(docs, brute(t for _, t in docs), strict=True)]
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == {i for i, _, _ in want}
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    for i, size, crc in want:
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        assert [r["start"] for r in pieces] == [sum(p["length"] for p in pieces[:k]) for k in range(len(pieces))]
        assert sum(r["length"] for r in pieces) == size == pieces[0]["doc_tokens"]
        assert all(r["length"] <= limit and r["length"] & (r["length"] - 1) == 0 and r["offset"] == 0 for r in pieces)
        if "ids" in pieces[0].asDict():
            ids = np.array([x for p in pieces for x in p["ids"]], "<u4")
            assert zlib.crc32(ids) == crc and all(zlib.crc32(np.array(p["ids"], "<u4")) == p["ids_crc32"] for p in pieces)


def test_edges(spark):
    docs = [d for d in EDGE if d[0] != 6]
    check(packing.pack(edge(spark).where("doc_id is null or doc_id != 6"), keep_ids=True).collect(), docs)
    repeated = packing.pack(edge(spark).where("doc_id = 6")).collect()
    assert len({r["sequence_id"] for r in repeated}) == len(repeated)
    assert packing.pack(empty(spark)).count() == 0
    assert packing.pack(clashing(spark, "k", "t", "length")).count() > 0


def test_query(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    check(packing.pack(spark.read.parquet(f"{data}/documents.parquet"), keep_ids=True, limit=256).collect(), docs, 256)
    check(queries.op3_packing(spark, data).collect(), docs)


def test_random_texts(spark):
    """Letters whose lower case ends in a mark, before full stops and commas, among others."""
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "\t", "İ", "ı", "ß", "é", "É", "e\u0301", "Σ", "ΑΣ", "日", "a", "The", "it's", "'ll", ".", ",", "..", ".,", "1", "23", "<|endoftext|>", "<|", "😀", "ǅ", "ŉ", "ﬁ", "\u0307", "\u00a0", "\u200b", "-", "x"]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))) for i in range(20_000)]
    want = {i: (len(ids), zlib.crc32(ids)) for (i, _), ids in zip(docs, brute(t for _, t in docs), strict=True)}
    got = {}
    for r in packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), keep_ids=True).orderBy("doc_id", "start").collect():
        got.setdefault(r["doc_id"], []).extend(r["ids"])
    wrong = [docs[i] for i, ids in got.items() if (len(ids), zlib.crc32(np.array(ids, "<u4"))) != want[i]]
    assert len(got) == len(docs) and not wrong, wrong[:5]


def test_buckets(spark, tmp_path):
    pieces = packing.pack(edge(spark), keep_ids=True)
    packing.write_buckets(pieces, f"{tmp_path}/b")
    back = spark.read.parquet(f"{tmp_path}/b")
    assert back.count() == pieces.count() and back.where("length != shiftleft(1, bucket) or size(ids) != length").isEmpty()


def test_cut():
    assert packing.cut(1) == [1] and packing.cut(4096) == [4096] and packing.cut(4097 + 6) == [4096, 4, 2, 1]
