"""The driver's tables as the engine's: documents are articles, languages are categories, events are logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

NOW = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now():  # noqa: ANN201
    return F.lit(NOW).cast("timestamp")


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


def articles(spark: SparkSession, sf_dir: str, whole: bool = True, sized: bool = False) -> DataFrame:
    """Documents with the columns of articles. Labels give the states: toxic ones are filtered, poor ones archived. Without
    `whole` there is no content, and the join shuffles titles and summaries instead of texts; `sized`, they have its length."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    cut = {"title": F.substring_index("text", "\n", 1), "summary": F.substring("text", 1, 200)}
    rows = (d if whole else d.withColumns(cut | ({"length": F.length("text")} if sized else {})).drop("text")).join(l, "doc_id", "left")
    rows = rows.withColumns(cut) if whole else rows
    return rows.select(
        F.col("doc_id").alias("id"), "title", *[F.col("text").alias("content")] * whole, *["length"] * (sized and not whole), "summary", F.concat(F.lit("doc/"), F.col("doc_id")).alias("url"), F.col("source").alias("source_id"),
        F.col("lang").alias("primary_category_id"), F.col("lang").alias("category"), F.array("lang", "source").alias("tags"),
        F.when(F.col("toxic") == 1, "filtered").when(F.col("quality") == 0, "knowledge_duplicate").otherwise("normal").alias("status"), F.when(F.col("quality") == 0, "covered").when(F.col("quality") == 1, "new").alias("knowledge_status"),
        F.when(F.col("quality").isNotNull(), F.timestamp_seconds(F.lit(1704067200) + F.col("n_chars"))).alias("published_at"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).alias("crawled_at"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).alias("created_at"),
        F.coalesce(F.col("quality").cast("double"), F.lit(0.0)).alias("weight"), (F.coalesce("toxic", F.lit(0)) == 0).alias("is_accessible"), "n_chars",
    )


#: The same in SQL, to start a statement with.
ARTICLES = """a AS (SELECT d.doc_id AS id, split_part(text, chr(10), 1) AS title, text AS content, left(text, 200) AS summary, 'doc/' || d.doc_id AS url, source AS source_id, lang AS category,
  CASE WHEN toxic = 1 THEN 'filtered' WHEN quality = 0 THEN 'knowledge_duplicate' ELSE 'normal' END AS status, CASE WHEN quality = 0 THEN 'covered' WHEN quality = 1 THEN 'new' END AS knowledge_status,
  CASE WHEN quality IS NOT NULL THEN make_timestamp((1704067200 + n_chars) * 1000000) END AS published_at, make_timestamp((1704067200 + d.doc_id) * 1000000) AS crawled_at,
  coalesce(quality, 0)::DOUBLE AS weight, coalesce(toxic, 0) = 0 AS is_accessible, n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
NORMAL = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
PRINTS = f"""n AS (SELECT doc_id AS id, {NORMAL} AS t FROM documents WHERE trim(text) <> ''),
h AS (SELECT id, ('0x' || substr(md5(w), 1, 8))::UBIGINT * 4294967296 + ('0x' || substr(md5(w), 9, 8))::UBIGINT AS v, count(*) AS k FROM (SELECT id, unnest(regexp_extract_all(lower(t), '[A-Za-z0-9_]+')) AS w FROM n) GROUP BY id, w),
b AS (SELECT id, {" + ".join(f"CASE WHEN sum(CASE WHEN (v >> {k}) & 1 = 1 THEN k ELSE -k END) > 0 THEN {1 << k}::HUGEINT ELSE 0::HUGEINT END" for k in range(64))} AS u FROM h GROUP BY id),
p AS (SELECT n.id, sha256(n.t) AS content_hash, CASE WHEN coalesce(u, 0) >= 9223372036854775808 THEN (u - 18446744073709551616)::BIGINT ELSE coalesce(u, 0)::BIGINT END AS simhash FROM n LEFT JOIN b USING (id)),
x AS (SELECT id, min(id) OVER (PARTITION BY content_hash) AS first_id FROM p)"""
NEAREST = "SELECT q.id, q.s AS nearest, q.d AS distance FROM (SELECT b.id, a.id AS s, bit_count(xor(a.simhash, b.simhash))::INT AS d, row_number() OVER (PARTITION BY b.id ORDER BY bit_count(xor(a.simhash, b.simhash)), a.id) AS r FROM p a JOIN p b ON a.id < b.id) q WHERE r = 1 AND d <= {d}"
LINKS = f"""{PRINTS}, near AS ({NEAREST.format(d=6)}),
l AS (SELECT id, first_id AS parent, 'exact_duplicate' AS relation_type, 1.0::DOUBLE AS similarity FROM x WHERE first_id < id
  UNION ALL SELECT id, nearest, 'near_duplicate', 1 - distance / 64.0::DOUBLE FROM near WHERE id NOT IN (SELECT id FROM x WHERE first_id < id))"""
GROUPS = f"""{LINKS}, t AS (SELECT id, parent AS root FROM l UNION ALL SELECT t.id, l.parent FROM t JOIN l ON t.root = l.id),
r AS (SELECT id, min(root) AS root FROM t GROUP BY id), g AS (SELECT 'group_' || md5(root::VARCHAR) AS group_key, root, id FROM (SELECT id, root FROM r UNION SELECT root, root FROM r))"""
