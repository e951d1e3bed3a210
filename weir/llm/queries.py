"""The registered queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession

from . import audio, bpe, chat, langid, lexical, linededup, mixing, packing, pii, simhash, spelling, substring, topk


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(_docs(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_docs(spark, sf_dir), distance=4)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_docs(spark, sf_dir), min_docs=10, digest=True)


def op5_media_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.media_digest(_docs(spark, sf_dir))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_words(_docs(spark, sf_dir))


#: The session setting of the pseudonyms' key; where it is unset, a key that ends with this driver.
PII_KEY, _OWN_KEY = "spark.weir.pii.key", secrets.token_bytes(32)


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(PII_KEY, None)
    return pii.pseudonymise(_docs(spark, sf_dir), key.encode() if key else _OWN_KEY).select("doc_id", "text", "pii")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_passages(_docs(spark, sf_dir), window=20, digest=True)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_docs(spark, sf_dir))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build_index(_docs(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=50)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(_docs(spark, sf_dir), every=31, shortest=7, least=2, ratio=10)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_docs(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_simhash, op3_topk, op4_line_dedup, op5_media_audio, op6_mix_sources, op7_pseudonyms, op8_substring_dedup, op9_chat_format, op10_pack, op11_lexical_search, op12_spelling_variants, op13_byte_bpe)}

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_KEY = f"translate(trim(line, {_WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_UP, _LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
_TERMS = rf"regexp_extract_all(translate(text, {_UP}, {_LOW}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op3_topk": """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
           FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(CAST(q.c AS DOUBLE[]), CAST(v.c AS DOUBLE[])) AS BIGINT) AS score
      FROM v AS q, v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id AND len(q.c) = len(v.c)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
""",
    "op4_line_dedup": f"""
WITH l AS (SELECT doc_id, i, lines[i] AS line
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) AS r(i)),
k AS (SELECT doc_id, i, line, {_KEY} AS key FROM l),
d AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(d.key) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN d.key IS NULL THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM k LEFT JOIN d USING (key) GROUP BY k.doc_id
""",
    "op8_substring_dedup": """
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM t WHERE len(w) >= 20)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM s) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM d)),
x AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM t)),
k AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) FILTER (g.p IS NULL) AS kept, count(g.p) AS n FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.p = g.p GROUP BY x.doc_id)
SELECT t.doc_id, len(t.w) AS n_words, coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM t LEFT JOIN k USING (doc_id)
""",
    "op9_chat_format": """
WITH c AS (
  SELECT conv_id, count(*) AS n,
         list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l
  FROM conversations GROUP BY conv_id),
g AS (SELECT l, n, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY l, n),
p AS (SELECT DISTINCT list_slice(l, 1, i) AS l FROM (SELECT l, unnest(range(1, n)) AS i FROM g))
SELECT conv_id, n AS n_turns, n_copies,
       array_to_string(list_transform(l, lambda x: '<|im_start|>' || coalesce(x.r, '') || chr(10) || coalesce(x.t, '') || '<|im_end|>'), chr(10)) AS rendered
FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.l = g.l)
""",
    "op11_lexical_search": f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
d AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, w FROM t WHERE len(w) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, n, term),
f AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT docs FROM s) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p GROUP BY term),
x AS (SELECT item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score
      FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE score > 0) WHERE rank <= 50
""",
    "op12_spelling_variants": f"""
WITH RECURSIVE poly AS (SELECT list_transform(range(256), lambda b: list_reduce([CAST(b AS BIGINT)] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), {_UP}, {_LOW}) AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY doc_id, run),
b AS (SELECT doc_id, run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM c),
h AS (SELECT doc_id, run, n, xor(4294967295, list_reduce([4294967295] || list_transform(range(0, len(x), 2), lambda i: CAST('0x' || x[i + 1:i + 2] AS BIGINT)), lambda s, v: xor(s >> 8, t[CAST(xor(s, v) & 255 AS INTEGER) + 1]))) AS h FROM b, poly),
m AS (SELECT CASE WHEN h % 31 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM m WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
g AS (SELECT word, n, word[1:i - 1] || '*' || word[i + 1:] AS k FROM p),
d AS (SELECT DISTINCT word, n, word[1:i - 1] || word[i + 1:] AS k FROM p),
e AS (SELECT a.word, o.word AS o, o.n AS o_n FROM g a JOIN g o ON a.k = o.k AND a.word <> o.word
      UNION ALL SELECT d.word, w.word, w.n FROM d JOIN w ON d.k = w.word
      UNION ALL SELECT w.word, d.word, d.n FROM d JOIN w ON d.k = w.word),
f AS (SELECT word, count(*) AS n_near, first(o ORDER BY o_n DESC, encode(o)) AS o, max(o_n) AS o_n FROM e GROUP BY word),
x AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN o_n >= 10 * w.n THEN o END AS form, CASE WHEN o_n >= 10 * w.n THEN o_n END AS form_n FROM w LEFT JOIN f USING (word)),
y AS (SELECT word, word AS root, form AS up FROM x UNION ALL SELECT y.word, x.word, x.form FROM y JOIN x ON y.up = x.word)
SELECT x.word, x.form, y.root, x.n, x.n_near, x.form_n FROM x JOIN y ON x.word = y.word WHERE y.up IS NULL
""",
}
