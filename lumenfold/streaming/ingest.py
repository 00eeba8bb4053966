"""Streams: pages as they arrive, exact dedup against all history, windows on events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import limits
from ..operators.dedup import fingerprints
from ..sources import tiers
from ..sources.store import stored


def read_stream(spark: SparkSession, path: str, schema: StructType, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def tumbling_counts(events: DataFrame, every: str = "1 day", late: str = "1 day", time: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """Events by window and key; events later than `late` are left out."""
    w = F.window(F.col(time).cast("timestamp"), every)
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sliding_counts(events: DataFrame, length: str = "1 hour", step: str = "10 minutes", late: str = "1 hour", time: str = "ts", key: str = "user_id") -> DataFrame:
    w = F.window(F.col(time).cast("timestamp"), length, step)
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"))


def weekly(time: Column) -> Column:
    """Windows from Monday to Monday."""
    return F.window(time, "7 days", "7 days", "4 days")


def first_seen(events: DataFrame, keys: list[str], time: str = "ts", late: str = "1 day") -> DataFrame:
    """Each key once within the watermark: keyed state that expires."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Everything that is there now, in batches; a restart goes on where it stopped, and a batch that is run again must
    write the same files."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def existing(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def ingest_articles(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Articles (id, content, ...) appended with their fingerprint and the first article with the same content, in this
    batch or before. What is known of earlier batches is a table of its own beside the articles, with one row (24 bytes or
    so) for each content and the batch that brought it; a batch reads that table and adds the contents it is first with, so
    articles are never read again. Each batch has folders of its own, overwritten if the batch is run again."""
    spark, known_path = stream.sparkSession, f"{target.rstrip('/')}-known"
    known_schema = spark.createDataFrame([], "content_hash binary, first_id long, batch int").schema

    def each(batch: DataFrame, n: int) -> None:
        prints = stored(fingerprints(batch).select("id", F.unhex("content_hash").alias("content_hash"), "simhash"), "batch-prints")
        first = prints.groupBy("content_hash").agg(F.min("id").alias("batch_id"))
        # Folders of earlier batches alone: on a retry the own one must not count.
        known = existing(spark, known_path, known_schema).where(F.col("batch") < n).select("content_hash", F.col("first_id").alias("known_id"))
        # A content may come again with a smaller id, so the smallest of its rows counts.
        known = known.join(first.select("content_hash"), "content_hash", "left_semi").groupBy("content_hash").agg(F.min("known_id").alias("known_id"))
        told = stored(first.join(known, "content_hash", "left").select("content_hash", F.least("known_id", "batch_id").alias("first_id"), (F.col("known_id").isNull() | (F.col("batch_id") < F.col("known_id"))).alias("new")), "batch-first")
        told.where("new").select("content_hash", "first_id").write.mode("overwrite").parquet(f"{known_path}/batch={n}")
        prints.join(told, "content_hash").select("id", F.lower(F.hex("content_hash")).alias("content_hash"), "simhash", "first_id").write.mode("overwrite").parquet(f"{target}/batch={n}")

    return run_available(stream, checkpoint, each)


def limit_requests(stream: DataFrame, target: str, checkpoint: str, limit: int, seconds: int = limits.HOUR, keys: tuple[str, str] = ("email", "ip")) -> StreamingQuery:
    """Requests (id, both keys, at) as they arrive, each with `refused` (see limits.rate_decisions), in a folder for each batch
    and hour. A batch is decided given what was created in the `seconds` before its first request, which is all the state
    there is: older hours are not read. Batches come in order of time."""
    spark = stream.sparkSession
    schema = StructType(stream.schema.fields).add("refused", "string").add("batch", "integer").add("hour", "long")

    def each(batch: DataFrame, n: int) -> None:
        rows = stored(batch, "batch-requests")
        first = rows.agg(F.min(F.unix_seconds("at"))).first()[0]
        if first is None:
            return
        since = existing(spark, target, schema).where((F.col("batch") < n) & (F.col("hour") >= (first - seconds) // 3600) & (F.unix_micros("at") >= (first - seconds) * 1_000_000))
        told = limits.decided(rows, limit, since.where("refused is null").select("id", *keys, "at"), seconds, keys)
        # An hour's rows meet before they are written: not a file for each task and hour. Only a large hour is more tasks' work.
        out = told.withColumn("hour", F.floor(F.unix_seconds("at") / 3600)).hint("rebalance", "hour")
        out.write.mode("overwrite").partitionBy("hour").parquet(f"{target}/batch={n}")

    return run_available(stream, checkpoint, each)


def upsert_pages(stream: DataFrame, target: str, checkpoint: str, keys: list[str], version: str) -> StreamingQuery:
    """Each batch is a run of tiers.py, merged with others of its size. A batch that is run again adds nothing."""
    return run_available(stream, checkpoint, lambda batch, n: tiers.add(stored(batch, "batch-pages"), n, target, keys, version))


def pages_now(spark: SparkSession, target: str, keys: list[str], version: str) -> DataFrame:
    return tiers.now(spark, target, keys, version)
