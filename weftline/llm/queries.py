"""The registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.llm import divergence, fingerprint, language, licenses, lm, neardup, packing, pii, quality, spelling, tokencount, urls, viterbi
from weftline.llm.common import documents, pages


def op1_quality_rules(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return quality.judge(docs).select("doc_id", *quality.FIGURES, "base_failed", "kept")


def op2_lm_scoring(spark, sf_dir):
    return lm.score(documents(spark, sf_dir).select("doc_id", "text"))


def op3_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir).select("doc_id", "text"))


def op4_license_scan(spark, sf_dir):
    return licenses.scan(documents(spark, sf_dir).select("doc_id", "text"))


def op5_near_duplicates(spark, sf_dir):
    return neardup.classes(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "kept")


def op6_token_counts(spark, sf_dir):
    return tokencount.count_tokens(documents(spark, sf_dir).select("doc_id", "text"))


def op7_sentencepiece(spark, sf_dir):
    return viterbi.encode(documents(spark, sf_dir).select("doc_id", "text"))


def op8_personal_data(spark, sf_dir):
    return pii.scan(documents(spark, sf_dir).select("doc_id", "text"))


def op9_url_filter(spark, sf_dir):
    return urls.judge(pages(spark, sf_dir).select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def op10_fingerprint(spark, sf_dir):
    return fingerprint.fingerprints(documents(spark, sf_dir).select("doc_id", "text"))


def op11_source_divergence(spark, sf_dir):
    return divergence.audit(documents(spark, sf_dir).select("lang", "source", "text"))


def op12_spelling_variants(spark, sf_dir):
    return spelling.variants(documents(spark, sf_dir).select("doc_id", "text"))


def op13_language_id(spark, sf_dir):
    return language.identify(documents(spark, sf_dir).select("doc_id", "text", "lang"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_lm_scoring,
        op3_packing,
        op4_license_scan,
        op5_near_duplicates,
        op6_token_counts,
        op7_sentencepiece,
        op8_personal_data,
        op9_url_filter,
        op10_fingerprint,
        op11_source_divergence,
        op12_spelling_variants,
        op13_language_id,
    )
}
#: Words as the contracts cut them, in order.
_WORDS = "list_filter(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda w: w <> '')"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
 p AS (SELECT r, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM d),
 v AS (SELECT r, i, x || chr(32) || lead(x, 1) OVER o || chr(32) || lead(x, 2) OVER o || chr(32) || lead(x, 3) OVER o || chr(32) || lead(x, 4) OVER o AS s FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
 again AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS j FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM v WHERE s IS NOT NULL) WHERE c > 1),
 covered AS (SELECT r, sum(least(5, coalesce(j - i, 5))) AS n FROM again GROUP BY r),
 f AS (SELECT d.*, CAST(len(w) AS BIGINT) AS n_words, CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS wc, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
 CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
 FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: translate(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') <> '') AS l FROM d) d LEFT JOIN covered c USING (r)),
 g AS (SELECT doc_id, t, w, n_words, coalesce(wc, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR n_symbols * 10 > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
 OR length(regexp_replace(t, '[\p{{L}}\p{{M}}]+', '', 'g')) * 10 > length(t) * 6 OR length(t) - length(translate(t, '0123456789', '')) > length(t) * 0.5 OR n_dup_lines * 2 > len(string_split(t, chr(10)))
 OR len(list_distinct(string_split({_LOWER.format("t")}, ' '))) * 50 < n_words OR length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) * 2 > length(t)) AS kept FROM g"""

_OP5 = rf"""WITH RECURSIVE d AS (SELECT doc_id, list_transform({_WORDS}, lambda x: {_LOWER.format("x")}) AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
 e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
 both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 reach AS (SELECT a AS doc_id, a AS other FROM both_ways UNION SELECT r.doc_id, w.b FROM reach r JOIN both_ways w ON w.a = r.other),
 low AS (SELECT doc_id, min(other) AS least_id FROM reach GROUP BY doc_id)
 SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(low.least_id, d.doc_id) AS component_id, coalesce(low.least_id, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)"""

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP11 = rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
 g AS (SELECT DISTINCT lang, source FROM d),
 w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(t, '{_UP}', '{_LOW}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
 k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
 c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
 x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
 p AS (SELECT *, CAST(1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS BIGINT) AS p FROM x),
 l AS (SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS BIGINT) AS q FROM (SELECT lang, term, sum(n) AS n FROM p GROUP BY lang, term)),
 v AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
 LEFT JOIN (SELECT y.lang, y.source, z.source AS other, CAST(sum(((y.p - z.p) * (y.p - z.p)) // (y.p + z.p)) AS BIGINT) AS value FROM p y JOIN p z ON y.lang = z.lang AND y.term = z.term AND y.source <> z.source GROUP BY y.lang, y.source, z.source) s
 ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
 UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM v)
 SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10"""

#: Checksums byte by byte from a table that a recursion over bits gives; near words share what is left without one code point at the same place, or one is what is left of the other.
_OP12 = r"""WITH RECURSIVE bits AS (SELECT 0 AS k, i, i AS c FROM range(256) t(i) UNION ALL SELECT k + 1, i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
 crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
 d AS (SELECT row_number() OVER () AS r, coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS start, text FROM documents WHERE text IS NOT NULL),
 w AS (SELECT r, start, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM d),
 u AS (SELECT start || run AS s, run, count(*) AS n FROM w GROUP BY start, run),
 b AS (SELECT *, hex(encode(s)) AS x FROM u),
 h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(s)), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT))), lambda c, y: xor(c >> 8, tab[CAST((xor(c, y) & 255) + 1 AS INT)])), 4294967295) AS h FROM b, crc),
 t AS (SELECT CASE WHEN h % 97 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h),
 v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM t WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
 cut AS (SELECT word, n, i, word[1:i] || word[i + 2:] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
 near AS (SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
 UNION SELECT a.word, v.word, v.n FROM cut a JOIN v ON a.rest = v.word UNION SELECT v.word, a.word, a.n FROM cut a JOIN v ON a.rest = v.word),
 best AS (SELECT word, count(*) AS n_near, min(struct_pack(less := -n, other := other)) AS m FROM near GROUP BY word),
 f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -m.less >= 2 * v.n THEN m.other END AS form, CASE WHEN -m.less >= 2 * v.n THEN -m.less END AS form_n FROM v LEFT JOIN best USING (word)),
 up AS (SELECT word, word AS at FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.at WHERE f.form IS NOT NULL),
 ends AS (SELECT up.word, up.at AS root FROM up JOIN f ON f.word = up.at WHERE f.form IS NULL)
 SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN ends USING (word)"""

#: The others need tokenizers, models, hashes or iteration that SQL doesn't have; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op1_quality_rules": _OP1, "op5_near_duplicates": _OP5, "op11_source_divergence": _OP11, "op12_spelling_variants": _OP12}
