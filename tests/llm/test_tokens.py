import random
import zlib

import numpy as np
import sentencepiece

from tests.llm.texts import EDGE, clashing, edge, empty
from weftline.llm import queries, tokencount, viterbi
from weftline.llm.common import tokenizer_file

MODEL = tokenizer_file("piece_bpe_32k.model")


def test_counts_match_the_library(spark, data):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for rows, found in ((docs.collect(), queries.op6_token_counts(spark, data)), (edge(spark).collect(), tokencount.count_tokens(edge(spark), limit=50))):
        limit = 4096 if len(rows) > 50 else 50
        want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()), n := len(library.encode(r["text"] or "")), n > limit) for r in rows)
        assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in found.collect()) == want


def test_counts_of_chunked_texts(spark, monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    monkeypatch.setattr(tokencount, "CHUNK_BYTES", 37)
    texts = ["ab  cd\n\nef " * 40, "x" * 300 + " y " * 50, "a\n" * 100]
    found = tokencount.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in found} == {i: len(library.encode(t)) for i, t in enumerate(texts)}


def words_of(text):
    return viterbi.WORD.findall(" " + text.replace(viterbi.MARK, " ")) if text else []


def random_texts(n, seed=1):
    rng = random.Random(seed)
    parts = [" ", "  ", "\n", "▁", "\0", "a", "e", "th", "ing", "The", "é", "İ", "ß", "日", "本", "😀", "<s>", "</s>", "<0x0A>", "\t", "\r", "1", "23", ".", ",", "Σ", "ﬁ", "\u200b", "\u00a0", "aaaa", "bb", "--", "==", "ion", "tion", "un", "re"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(n)]


def test_shared_prefixes_change_nothing():
    """A word alone, words together in any order, and merging from the start give the same."""
    vocabulary, fresh = viterbi.Vocabulary(MODEL), viterbi.Vocabulary(MODEL)
    words = ["", " the", " then", " theory", "theory", " th", "  gap", "naïve", " \x00", "日本語", "aaaaaaaaaaaaaaaaaaaaaaaa", " the", "ab", "abc", " undoing", " undo"]
    for word, (ids, _) in zip(words, vocabulary.encode(words), strict=True):
        assert [ids] == [x for x, _ in fresh.encode([word])]
        merged = fresh.merged(word.replace(" ", viterbi.MARK))
        assert list(ids) == [i for p in merged for i in ([fresh.score[p][1]] if p in fresh.score else [fresh.byte_id[b] for b in p.encode()])]


def test_encoding_is_the_librarys():
    """20,000 random texts, and counts of tokens for the same."""
    vocabulary, library, count = viterbi.Vocabulary(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL), tokencount.counter(MODEL)
    for text in random_texts(20_000):
        want = library.encode(text)
        assert [i for ids, _ in vocabulary.encode(words_of(text)) for i in ids] == want, text
        assert sum(n for part in tokencount.parts(text) for n in count(part)) == len(want), text


def test_query_gives_the_librarys_ids(spark, data):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries.op7_sentencepiece(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]])
        assert (r["n_pieces"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4")))


def test_encode_and_decode(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").unionByName(edge(spark))
    encoded = viterbi.encode(docs, keep_ids=True)
    rows = encoded.collect()
    marked = {t for _, t in EDGE if t and viterbi.MARK in t}
    assert len(rows) == 200 + len(EDGE) and sum(not r["round_trip"] for r in rows) == len(marked)
    assert all(r["n_pieces"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4")) for r in rows)
    texts = sorted((r["doc_id"] or -1, r["text"]) for r in viterbi.decode(encoded).collect())
    assert texts == sorted((r["doc_id"] or -1, (r["text"] or "").replace(viterbi.MARK, " ")) for r in docs.collect())


def test_edges(spark):
    for operator in (tokencount.count_tokens, viterbi.encode):
        assert operator(empty(spark)).count() == 0
        assert operator(clashing(spark, "k", "t", "ids", "n_tokens")).count() == 1
    assert viterbi.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).collect()[0]["text"] is None


def test_every_prefix_has_one_path_and_it_is_the_best():
    """The forward pass over all pieces, scores compared: what fits is one piece for each prefix, so the first fit is the best."""
    vocabulary = viterbi.Vocabulary(MODEL)
    words = sorted({w for t in random_texts(300, 5) for w in words_of(t)} | {" undoing", " theoretically", "aaaaaaaaaaaaa", "  gap", "naïve"})
    for word, (ids, score) in zip(words, vocabulary.encode(words), strict=True):
        marked = word.replace(" ", viterbi.MARK)
        best = [(0.0, "", ())]
        for end in range(1, len(marked) + 1):
            found = []
            for start in range(max(0, end - vocabulary.longest), end):
                piece = marked[start:end]
                if best[start] is None or (piece not in vocabulary.score and end - start > 1) or not vocabulary.fits(best[start][1], piece):
                    continue
                own, number = vocabulary.score.get(piece, (vocabulary.unknown, None))
                more = (number,) if number is not None else tuple(vocabulary.byte_id[b] for b in piece.encode())
                found.append((best[start][0] + own, piece, best[start][2] + more))
            assert len(found) == 1, (word, end)
            best.append(max(found))
        assert best[-1][2] == ids and abs(best[-1][0] - score) < 1e-6 * max(1, abs(score))
