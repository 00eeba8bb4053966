"""Queries that run as streams over the tables' files until all is read."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import limits
from ..session import ship
from ..sources.store import shared_dir
from ..streaming import arrivals, ingest
from .tables import LINKS, NEAREST, NORMAL, contents, table


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream. A table that is one file is read through a pattern of its folder."""
    ship(spark)
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")


def finished(stream: DataFrame, mode: str) -> DataFrame:
    """The result of a stream that has run to its end, as a table."""
    spark, path = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    each = lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/out/batch={n}")
    stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out").drop("batch")


def stream_tumbling_counts(spark, sf_dir):  # noqa: ANN001, ANN201
    """Daily counts by type, complete at the end."""
    out = finished(ingest.tumbling_counts(streamed(spark, sf_dir, "events"), late="60 days"), "update")
    return out.groupBy("start", "event_type").agg(F.max("n").alias("n"))


def stream_sliding_counts(spark, sf_dir):  # noqa: ANN001, ANN201
    out = finished(ingest.sliding_counts(streamed(spark, sf_dir, "events"), late="60 days"), "update")
    return out.groupBy(F.col("w.start").alias("start"), "user_id").agg(F.max("n").alias("n"))


def stream_dedup_first_seen(spark, sf_dir):  # noqa: ANN001, ANN201
    """Each user and type once."""
    out = finished(ingest.first_seen(streamed(spark, sf_dir, "events"), ["user_id", "event_type"], late="60 days"), "append")
    return out.select("user_id", "event_type")


def stream_exact_dedup(spark, sf_dir):  # noqa: ANN001, ANN201
    """Documents ingested with the first one of the same content."""
    path = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    docs = streamed(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    ingest.ingest_articles(docs, f"{path}/articles", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/articles").select("id", "first_id")


def in_order(spark: SparkSession, rows: DataFrame, key: str, batches: int, run: Callable[[DataFrame], StreamingQuery]) -> None:
    """Rows as a stream in so many batches, in order of a key: what would have arrived day by day. Each part is written by as
    many tasks as the rows have, then the stream, started again, reads all its files as one batch."""
    path = f"{shared_dir(spark)}/arrivals-{uuid.uuid4().hex}"
    edges = rows.approxQuantile(key, [k / batches for k in range(1, batches)], 0.01)
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        part = rows.where(F.lit(True) if low is None else F.col(key) > low).where(F.lit(True) if high is None else F.col(key) <= high)
        part.write.mode("append").parquet(path)
        run(spark.readStream.schema(rows.schema).parquet(path)).awaitTermination()


def stream_near_dedup(spark, sf_dir):  # noqa: ANN001, ANN201
    """Documents that arrive in five batches, each linked with what came before: exact, near or related."""
    path = f"{shared_dir(spark)}/arrivals-{uuid.uuid4().hex}"
    in_order(spark, contents(spark, sf_dir), "id", 5, lambda docs: arrivals.dedup_arrivals(docs, path, f"{path}/state"))
    return spark.read.parquet(f"{path}/links").drop("batch").withColumn("similarity", F.round("similarity", 6))


#: Requests of an address, or a network address, that may create a subscription within an hour.
REQUESTS = 5


def requests(spark, sf_dir):  # noqa: ANN001, ANN201
    """Events as requests: the user is the address, a third of the users share a network address."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat("user_id", F.lit("@example.org")).alias("email"), F.concat(F.lit("10.0.0."), F.col("user_id") % 3).alias("ip"), F.col("ts").cast("timestamp").alias("at"))


def rate_decisions(spark, sf_dir):  # noqa: ANN001, ANN201
    """Which request is refused, by what, in order of time."""
    return limits.rate_decisions(requests(spark, sf_dir), REQUESTS)


def stream_rate_limits(spark, sf_dir):  # noqa: ANN001, ANN201
    """The same of requests that arrive in three batches."""
    path = f"{shared_dir(spark)}/requests-{uuid.uuid4().hex}"
    rows = requests(spark, sf_dir).withColumn("second", F.unix_seconds("at"))
    in_order(spark, rows, "second", 3, lambda arriving: ingest.limit_requests(arriving.drop("second"), path, f"{path}-state", REQUESTS))
    return spark.read.parquet(path).select("id", "refused")


QUERIES = {f.__name__: f for f in (stream_tumbling_counts, stream_sliding_counts, stream_dedup_first_seen, stream_exact_dedup, stream_near_dedup, rate_decisions, stream_rate_limits)}
SQL = {
    "stream_tumbling_counts": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_sliding_counts": "SELECT time_bucket(INTERVAL 10 MINUTE, ts) - k * INTERVAL 10 MINUTE AS start, user_id, count(*) AS n FROM events, range(6) r(k) GROUP BY 1, 2",
    "stream_dedup_first_seen": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_exact_dedup": f"SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY {NORMAL}) AS first_id FROM documents WHERE trim(text) <> ''",
    "stream_near_dedup": f"""WITH {LINKS}, f AS ({NEAREST.format(d=32)})
  SELECT id, parent, relation_type, round(similarity, 6) AS similarity, CASE WHEN relation_type = 'exact_duplicate' THEN '正文指纹相同（仅模板/导航差异）' ELSE printf('SimHash 相似度 %.3f ≥ 阈值 0.90', similarity) END AS evidence FROM l
  UNION ALL SELECT id, nearest, 'related', round(1 - distance / 64.0::DOUBLE, 6), printf('相似度 %.3f < 合并阈值 0.90，按不同视角关联（不合并）', 1 - distance / 64.0::DOUBLE) FROM f WHERE id NOT IN (SELECT id FROM l)""",
}
