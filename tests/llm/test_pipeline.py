import zlib

import numpy as np

import corpus_pipeline
from tests.llm.test_neardup import brute as components
from tests.llm.test_packing import brute as token_ids
from tests.llm.texts import edge
from weftline.llm import pii, quality


def test_run_matches_the_operators_in_turn(spark, data):
    """Stages against brute force: base rule and verdicts, components, masks, ids."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = quality.judge(docs, ordered=list(quality.RULES)[::-1]).where("kept").select("doc_id", "text").collect()
    lone = {i for i, _, _, own in components([(r["doc_id"], r["text"]) for r in kept]) if own}
    masked = {r["doc_id"]: pii.masked(r["text"]) for r in kept if r["doc_id"] in lone}
    want = {i: (len(ids), zlib.crc32(ids)) for i, ids in zip(masked, token_ids(masked.values()), strict=True)}
    out = {}
    for r in corpus_pipeline.run(spark, data).collect():
        out.setdefault(r["doc_id"], []).append(r)
    assert set(out) == set(want)
    assert all(sum(r["length"] for r in rows) == rows[0]["doc_tokens"] == want[i][0] for i, rows in out.items())
    for i, rows in out.items():
        ids = [x for r in sorted(rows, key=lambda r: r["start"]) for x in r["ids"]]
        assert zlib.crc32(np.array(ids, "<u4")) == want[i][1]
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4")) for r in rows)


def test_stages_keep_columns_and_cope_with_edges(spark, data):
    docs = edge(spark).selectExpr("doc_id", "text", "'en' lang", "'s' source", "cast(1 as long) n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns, name
        out.collect()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, data).count() > 0
    nothing = docs.limit(0)
    assert all(stage(spark, nothing, data).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_masked_lengths_are_true(spark, data):
    docs = spark.createDataFrame([(1, "mail x@y.zz now", "en", "s", 15)], "doc_id long, text string, lang string, source string, n_chars long")
    row = corpus_pipeline.personal_data(spark, docs, data).collect()[0]
    assert row["text"] == "mail [EMAIL] now" and row["n_chars"] == 16 and np.all(row["lang"] == "en")
