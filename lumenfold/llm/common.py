"""What the corpus operators share: tables in the shared folder, Arrow helpers, connected components.

Nothing here is collected to the driver unless its size has a stated bound.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Rows, and bytes, of one Arrow batch between the JVM and Python; texts may be long, so both are small.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor shares: the session's spark.checkpoint.dir, or a local one where that is unset (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if where:
        return where
    if "local-cluster" in spark.sparkContext.master or not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    where = f"file:///tmp/lumenfold-checkpoints/{spark.sparkContext.applicationId}"
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps neither recompute it nor depend on live executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    tidy(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let go of finished plans, so that Spark drops their shuffle files now and not when the driver's memory is full."""
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts small, and see that workers can import this package. The session keeps these two
    settings: Spark reads them only when the plan runs."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts; one scan, one number."""
    return df.agg(F.sum(F.octet_length(F.col(text_col)).cast("long")).alias("n")).first()["n"] or 0


#: Partitions of a table however small it is, unless the session has fewer.
LEAST_PARTS = 8


def parts_for(spark: SparkSession, total: int, each: int) -> int:
    """So many partitions that each gets about `each` of `total`. Small tables get a few, whatever number the session shuffles
    with: each partition is a task, and a file of every table that is written."""
    return max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), LEAST_PARTS), -(-total // each), 1)


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def words_in(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, list[bytes]]:
    """(distinct words, index of each word of the texts in order, where each text's words begin and the last one's end, each text's
    words with single spaces between). A-Z is lowered; words are runs without ASCII white space, as of bytes.split()."""
    body = pc.ascii_trim_whitespace(pc.ascii_lower(pa.array(texts, pa.binary()).cast(pa.string())))
    split = pc.ascii_split_whitespace(body)  # of an empty text: one empty word
    runs = split.flatten().dictionary_encode()
    names, index = runs.dictionary.cast(pa.binary()).to_pylist(), runs.indices.to_numpy()
    offsets = split.offsets.to_numpy().astype(np.int64)
    joined = pc.binary_join(split, " ").cast(pa.binary()).to_pylist()
    if b"" in names:
        real = index != names.index(b"")
        offsets, index = np.append(0, np.cumsum(real))[offsets], index[real]
    return names, index, offsets, joined


def arrow(fields: dict[str, pa.DataType], columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[k], pa.Array) else pa.array(x, t) for k, t in fields.items()], names=list(fields))


def mapped(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes (splitmix)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def smallest_hashes(df: DataFrame, most: int, *columns: str) -> DataFrame:
    """At most `most` rows, chosen by a hash of the columns: the same rows wherever they lie. Rows above the hash that a
    quarter more would stay below are cut where they are read, so little meets in one place."""
    h, bound = F.xxhash64(*columns), 2**63 - 1
    total = df.count()
    if total > most:
        bound = min(bound, int(-(2**63) + 2**64 * 1.25 * most / total))
    return df.where(h <= F.lit(bound)).orderBy(h, *columns).limit(most)


def powers(base: int, n: int) -> np.ndarray:
    """base ** k modulo 2 ** 64 for k below n."""
    out, done = np.ones(n, np.uint64), 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


#: Rows of one file of a round of components(), at least: a round of few edges is a few files, not one for each partition.
ROUND_ROWS = 5_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list: (id, component), component the smallest id.

    Alternating large-star and small-star steps, each a shuffle of at most about as many rows as there are edges; every
    round is written to the shared folder. Ends when a round changes nothing.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = stored(e, "edges")
    print_ = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        small = small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        e = stored(small.coalesce(max(1, -(-print_[0] // ROUND_ROWS))), "edges")  # edges never grow in number
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == print_:
            break
        print_ = now
    stars = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())


def dealt(rows: DataFrame, parts: int, *by: str) -> DataFrame:
    """`rows` with a column `chunk`, dealt so that chunk n is partition n. A row's chunk follows from the columns `by`
    alone, so it is the same in every job and on every retry."""
    return rows.withColumn("chunk", F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int")).repartitionById(parts, "chunk")


def answered(rows: DataFrame, replies: DataFrame, parts: int, *by: str) -> DataFrame:
    """As dealt(), with the reply rows of each chunk (columns chunk, a, b) before its rows; these have null a."""
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int"))
    every = replies.select("chunk", "a", "b").unionByName(rows, allowMissingColumns=True)
    return every.repartitionById(parts, "chunk").sortWithinPartitions(F.col("a").isNull())


def part_id() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()
