"""Duplicates of articles as they arrive: exact, near and related ones, against everything that came before.

What is known is two tables that each batch adds to: contents (hash, first article) and distinct SimHash values (value, first
article). The related tier has no index by its definition: a value that is new is compared with all known ones. The nearest of
them tells near from related, so one pass finds both. New values are sent, in bounded blocks, to the known ones, which are
dealt over the tasks and compared where they lie."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import rules, text
from ..operators.dedup import fingerprints, most_distance
from ..operators.hamming import AT_ONCE
from ..session import ship
from ..sources.store import stored
from .ingest import existing, run_available

#: New values of a batch that are sent to the known ones at once: 16 bytes each.
SENT = 1 << 20
#: Tasks over which known values are dealt, at least.
TASKS = 24


def nearest_stored(block, low: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    """(id, other, distance): of the sent articles the best among a task's stored values: a smaller distance, then a smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values = block.value
        best, other = np.full(len(ids), 255, np.int32), np.zeros(len(ids), np.int64)
        for b in batches:
            have, first, old = (b.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("simhash", "first_id", "old"))
            for earlier in (True, False):
                order = np.flatnonzero((old == 1) == earlier)
                order = order[np.argsort(first[order], kind="stable")]
                y, own = have[order].view(np.uint64), first[order]
                step = max(1, AT_ONCE // max(1, len(y)))
                for at in range(0, len(ids) if len(y) else 0, step):
                    d = np.bitwise_count(values[at : at + step, None] ^ y[None, :])
                    if not earlier:
                        d[own[None, :] >= ids[at : at + step, None]] = 255
                    k = d.argmin(1)
                    low_d, low_id = d[np.arange(len(d)), k].astype(np.int32), own[k]
                    span = slice(at, at + len(d))
                    better = (low_d < best[span]) | ((low_d == best[span]) & (low_id < other[span]))
                    best[span][better], other[span][better] = low_d[better], low_id[better]
        some = best <= low
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(other[some]), pa.array(best[some])], names=["id", "other", "distance"])

    return run


def related_to(alone: DataFrame, values: DataFrame, low: float) -> DataFrame:
    """(id, other, distance) of articles `alone` (id, simhash) with the nearest of `values` (simhash, first_id, old); values
    that are not old count only if their first_id is smaller. Sent in blocks of SENT."""
    spark, total = alone.sparkSession, alone.count()
    values = values.repartition(max(TASKS, int(spark.conf.get("spark.sql.shuffle.partitions"))), "simhash")
    parts, found = -(-total // SENT), None
    for n in range(parts):
        table = alone.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == n).toArrow()
        block = spark.sparkContext.broadcast((table.column("id").to_numpy(), table.column("simhash").to_numpy().view(np.uint64)))
        one = values.mapInArrow(nearest_stored(block, most_distance(low)), "id long, other long, distance int")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "id long, other long, distance int")
    return found.groupBy("id").agg(F.min(F.struct("distance", "other")).alias("m")).select("id", "m.other", "m.distance")


def dedup_arrivals(stream: DataFrame, target: str, checkpoint: str, threshold: float = rules.NEAR_THRESHOLD, low: float = rules.RELATED_THRESHOLD) -> StreamingQuery:
    """Articles (id long, content) as they arrive. Written below `target`, a folder for each batch, overwritten if the batch is
    run again: `links` (id, parent, relation_type, similarity, evidence), `contents` (content_hash, first_id) and `values`
    (simhash, first_id), the contents and distinct values that are new.

    An article is an exact duplicate of the first one with its content, else a near one of the most similar article before
    it (threshold), else related to that (low). Before it are all articles of earlier batches, and those of its own with a
    smaller id. Of equally similar ones the smallest id counts. Articles without content are left out."""
    spark = stream.sparkSession
    ship(spark)
    distance = most_distance(threshold)
    contents_schema = spark.createDataFrame([], "content_hash string, first_id long, batch int").schema
    values_schema = spark.createDataFrame([], "simhash long, first_id long, batch int").schema
    similarity = F.lit(1.0) - F.col("distance") / F.lit(64.0)

    def firsts(rows: DataFrame, before: DataFrame, key: str) -> DataFrame:
        """key, first_id, known: of each key of the batch its first article, in an earlier batch or in this one."""
        old = before.select(key, F.col("first_id").alias("old_id"))
        new = rows.groupBy(key).agg(F.min("id").alias("new_id")).join(old, key, "left")
        return stored(new.select(key, F.coalesce("old_id", "new_id").alias("first_id"), F.col("old_id").isNotNull().alias("known")), f"arrivals-{key}")

    def each(batch: DataFrame, n: int) -> None:
        rows = stored(fingerprints(batch), "arrivals")
        contents = firsts(rows, existing(spark, f"{target}/contents", contents_schema).where(F.col("batch") < n), "content_hash")
        before = existing(spark, f"{target}/values", values_schema).where(F.col("batch") < n).select("simhash", "first_id")
        own = firsts(rows, before, "simhash")
        fresh = own.where("not known").select("simhash", "first_id")
        values = before.withColumn("old", F.lit(1)).unionByName(fresh.withColumn("old", F.lit(0)))
        found = stored(related_to(fresh.select(F.col("first_id").alias("id"), "simhash"), values, min(low, threshold)), "arrivals-nearest")
        told = rows.join(contents.select("content_hash", F.col("first_id").alias("exact")), "content_hash").join(own.withColumnRenamed("first_id", "alike"), "simhash").join(found, "id", "left")
        same = F.col("known") | (F.col("alike") != F.col("id"))  # its value was there before it
        told = told.select("id", F.when(F.col("exact") != F.col("id"), F.col("exact")).alias("exact"), F.when(same, F.col("alike")).otherwise(F.col("other")).alias("parent"), F.when(same, F.lit(0)).otherwise(F.col("distance")).alias("distance"))
        exact = told.where("exact is not null").select("id", F.col("exact").alias("parent"), F.lit("exact_duplicate").alias("relation_type"), F.lit(1.0).alias("similarity"), F.lit(rules.EXACT_EVIDENCE).alias("evidence"))
        near = F.col("distance") <= distance
        close = told.where("exact is null and parent is not null").where(near | (F.col("distance") <= most_distance(low)))
        close = close.select("id", "parent", F.when(near, "near_duplicate").otherwise("related").alias("relation_type"), similarity.alias("similarity"))
        evidence = F.when(F.col("relation_type") == "near_duplicate", text.near_evidence(F.col("similarity"), threshold)).otherwise(text.related_evidence(F.col("similarity"), threshold))
        exact.unionByName(close.withColumn("evidence", evidence)).write.mode("overwrite").parquet(f"{target}/links/batch={n}")
        contents.where("not known").select("content_hash", "first_id").write.mode("overwrite").parquet(f"{target}/contents/batch={n}")
        fresh.write.mode("overwrite").parquet(f"{target}/values/batch={n}")

    return run_available(stream, checkpoint, each)
