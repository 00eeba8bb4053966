"""The driver's queries of this subpackage: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, exact_dedup, hard_negatives, language_id, line_dedup, lm_scoring, ngram_join, packing, quality, suffix_dedup, token_counts, warc

#: The tokenizer whose ids packing and token counts use; found where its package is installed.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), longest=2048, end_id=1)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"), percent=80, width=5)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), digest=True)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.capture_histories(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=50)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.learn(docs))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "n_words", "spans")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"), least_docs=10, top=10)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", noisy), F.col("vec_id") % 100 == 0)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.drop_lines(table(spark, sf_dir, "documents"), least_docs=10, least_chars=1)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""


#: Words of ASCII-lowered texts.
WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
OP2_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
u AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS o FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p WHERE 100 * o >= 80 * (na + nb - o)), f AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c AS (SELECT doc_id AS id, doc_id AS root FROM s UNION SELECT f.b, c.root FROM c JOIN f ON f.a = c.id AND c.root < f.b)
SELECT doc_id, len(g) AS n_shingles, (SELECT min(root) FROM c WHERE c.id = doc_id) AS component_id FROM s
"""
#: Base32 of a SHA-1 in hex: five digits are four symbols.
BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha, {at}, 5))::BIGINT >> {shift}) & 31)::INT + 1, 1)" for at in range(1, 41, 5) for shift in (15, 10, 5, 0))
OP8_SQL = f"""
WITH p AS (SELECT page_id, lower(url) AS url, coalesce(html, '') AS h FROM pages),
q AS (SELECT *, sha1(h) AS sha, max(page_id) OVER (PARTITION BY h) AS lead, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), '^www\\.', '') AS host, regexp_extract(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '^([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query FROM p)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, {BASE32} AS payload_digest, CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> lead THEN lead END AS refers_to,
       array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url_key,
       strftime(make_timestamp((1704067200 + page_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured
FROM q
"""
#: Bytes as two hex digits each: 50 of them are 100 characters.
OP9_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s),
b AS (SELECT w.doc_id, w.i FROM w JOIN m ON w.s = m.s AND m.low < w.doc_id),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS new FROM b)),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM g GROUP BY doc_id, run),
k AS (SELECT r.doc_id, a, z, h, coalesce(lag(z) OVER (PARTITION BY r.doc_id ORDER BY a), 0) AS before FROM r JOIN d ON d.doc_id = r.doc_id),
t AS (SELECT doc_id, count(*) AS spans, sum(z - a) AS gone, max(z) AS z, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(CASE WHEN spans IS NULL THEN h ELSE kept || substr(h, 2 * z + 1) END)) AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id
"""

#: ASCII letters, for translate().
LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), {LETTERS}) AS t FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY 1, 2 HAVING count(DISTINCT rid) >= 10),
g AS (SELECT DISTINCT lang, source FROM d), v AS (SELECT lang, count(*) AS v, sum(total)::HUGEINT AS n FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS c FROM w GROUP BY 1, 2, 3),
x AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, total FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
n AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM x GROUP BY 1, 2),
p AS (SELECT x.lang, x.source, term, c, 1 + 1000000000::HUGEINT * (c + 2) // (n.n + 2 * v.v) AS p, 1 + 1000000000::HUGEINT * (total + 2) // (v.n + 2 * v.v) AS q FROM x JOIN n ON n.lang = x.lang AND n.source = x.source JOIN v ON v.lang = x.lang),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE c > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r) WHERE part = 'pair' OR rank <= 10
"""
OP12_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS s FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, s FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.a, p.b, p.s, s.b AS c, s.s AS t, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b)::INT AS rank FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.s <= 100 * s.s AND 100 * s.s <= 100 * p.s)
SELECT a AS anchor_id, b AS positive_id, rank, c AS negative_id, s AS positive_score, t AS negative_score FROM n WHERE rank <= 5
"""
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT rid, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {LETTERS}) AS key FROM x),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON f.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY rid, doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_ngram_join, op3_quality, op4_decontamination, op5_exact_dedup, op6_token_counts, op7_lm_scoring, op8_warc, op9_suffix_dedup, op10_language_id, op11_divergence, op12_hard_negatives, op13_line_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_join": OP2_SQL, "op5_exact_dedup": OP5_SQL, "op8_warc": OP8_SQL, "op9_suffix_dedup": OP9_SQL, "op11_divergence": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_line_dedup": OP13_SQL}
