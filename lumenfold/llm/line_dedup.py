"""Line dedup: lines that many documents hold are dropped everywhere. Levelled sorted runs of line hashes count the documents.

A run is a table (key, n): a line's 128-bit hash and how many documents of the run hold it, bucketed and sorted by key. Each
batch of documents is merge-anti-joined with the runs, so that lines which are settled there (in `least_docs` documents or
more) are not counted again, and what is left becomes a run of its own on level 0. `fan_in` runs of a level are compacted to
one of the next, in which counts are summed. So a key is rewritten as often as there are levels, not batches.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, parts_for, shared_dir, stored, utf8

#: What is stripped at both ends of a line.
SPACES = b" \t\n\x0b\x0c\r"
#: Batches in which a table is taken up, at every size: each is a few jobs.
BATCHES = 8
#: Keys of one bucket of the runs, about.
BUCKET_KEYS = 1_000_000
#: Keys that a task gathers before it sends them on; some 150 bytes each.
GATHERED = 200_000
#: Frequent lines that may be sent to every executor, 16 bytes each and several times that as a hash table. More are joined by shuffle.
BROADCAST_KEYS = 250_000


def key_of(line: bytes, least_chars: int = 1) -> bytes | None:
    """The hash of a line's key: stripped, A-Z lowered; None if it has fewer code points than `least_chars`."""
    key = line.strip(SPACES).lower()  # of bytes: A-Z alone
    if len(key) < least_chars or (least_chars > 1 and len(key.decode("utf-8", "surrogateescape")) < least_chars):
        return None
    return blake2b(key, digest_size=16).digest()


def keys_of(text: bytes, least_chars: int = 1) -> list[bytes | None]:
    return [key_of(line, least_chars) for line in text.split(b"\n")]


class LineRuns:
    """Levelled runs in the shared folder. `levels` (the runs' paths, lowest level first) is all its state: give it to a new
    object to go on in another session."""

    def __init__(self, spark: SparkSession, least_docs: int, fan_in: int = 4, buckets: int = 8, levels: list[list[str]] | None = None) -> None:
        self.spark, self.least_docs, self.fan_in, self.buckets, self.levels = spark, least_docs, fan_in, buckets, [list(x) for x in levels or []]
        self.tables: dict[str, str] = {}

    def write(self, keys: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/{name}"
        by_bucket = keys.repartitionById(self.buckets, F.pmod(F.hash("key"), F.lit(self.buckets)))  # a file for each bucket
        by_bucket.write.bucketBy(self.buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
        self.tables[path] = name
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def read(self, path: str) -> DataFrame:
        return self.spark.read.schema("key binary, n long").parquet(path)

    def runs(self) -> list[DataFrame]:
        """All runs; by their tables where this session wrote them, so that joins by key need no shuffle of them."""
        return [self.spark.table(self.tables[path]) if path in self.tables else self.read(path) for level in self.levels for path in level]

    def add(self, keys: DataFrame) -> None:
        """Take up one batch: (key, n), n the documents of the batch that hold the line; a key may come in several rows."""
        fresh = keys.groupBy("key").agg(F.sum("n").alias("n"))
        for run in self.runs():
            fresh = fresh.join(run.where(F.col("n") >= self.least_docs).select("key"), "key", "left_anti")
        self.write(fresh, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fan_in:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        """All runs of a level become one of the next, written before they are given up."""
        old = self.levels[level]
        self.write(summed([self.read(path) for path in old]), level + 1)
        self.levels[level] = []

    def frequent(self) -> DataFrame:
        """key of the lines that `least_docs` documents or more hold."""
        some = [self.read(path) for level in self.levels for path in level]
        return summed(some).where(F.col("n") >= self.least_docs).select("key") if some else self.spark.createDataFrame([], "key binary")

    def forget(self) -> None:
        """Take the runs' names out of the catalog; their files stay in the shared folder."""
        for name in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables = {}


def summed(runs: list[DataFrame]) -> DataFrame:
    """Runs as plain files: Spark 4.1 takes a union of bucketed tables for bucketed itself and then sums each table alone."""
    every = runs[0]
    for run in runs[1:]:
        every = every.unionByName(run)
    return every.groupBy("key").agg(F.sum("n").alias("n"))


def line_counts(docs: DataFrame, text_col: str, least_chars: int) -> DataFrame:
    """(key, n), n documents of a task that hold the line; a key comes from many tasks."""

    def batch(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in batches:
            for text in utf8(b, "body"):
                found.update({k for k in keys_of(text, least_chars) if k})
                if len(found) >= GATHERED:
                    yield batch(found)
                    found = Counter()
        yield batch(found)

    return mapped(docs.select(F.col(text_col).alias("body")), run, "key binary, n long")


def count_lines(docs: DataFrame, least_docs: int, least_chars: int = 1, text_col: str = "text", batches: int = BATCHES) -> LineRuns:
    """The runs of a whole table, taken up in batches of its partitions."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/line-keys-{uuid.uuid4().hex}"
    counted = line_counts(docs, text_col, least_chars).withColumn("batch", F.spark_partition_id() % batches)
    counted.write.partitionBy("batch").parquet(path)
    every = spark.read.schema("key binary, n long, batch int").parquet(path)
    runs = LineRuns(spark, least_docs, buckets=parts_for(spark, every.count(), BUCKET_KEYS))
    for k in range(batches):
        runs.add(every.where(F.col("batch") == k).drop("batch"))
    return runs


def cleaner(least_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lines, dropped = [], [], []
            for text, hits in zip(utf8(b, "body"), b.column("hits").to_pylist(), strict=True):
                own = text.split(b"\n")
                lines.append(len(own))
                if hits:
                    gone = set(hits)
                    own = [x for x in own if key_of(x, least_chars) not in gone]
                dropped.append(lines[-1] - len(own))
                texts.append(b"\n".join(own) if hits else text)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=["id", "body", "n_lines", "n_dropped"])

    return run


def drop_lines(docs: DataFrame, least_docs: int = 10, least_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", runs: LineRuns | None = None) -> DataFrame:
    """One row per row of `docs`: id, text (the lines that stay, joined by \\n), n_lines (before), n_dropped.

    A text is split at \\n. A line's key is the line without white space (space, \\x09-\\x0D) at its ends, A-Z lowered. A key of
    `least_chars` code points or more that `least_docs` rows or more hold loses all its lines in every row. `runs` are counts
    that were kept so far (see LineRuns); without them the table itself is counted.

    A null or empty text is one empty line, and stays that. Each row is a document of its own, whether ids repeat or are null.
    Other columns are not read. An empty table gives no rows. Lines are told apart by 128-bit hashes, and so are texts.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), body.alias("body")).withColumns({"t1": F.xxhash64("body"), "t2": F.xxhash64(F.lit(1), "body")})
    own = runs or count_lines(docs, least_docs, least_chars, text_col)
    frequent = stored(own.frequent(), "frequent-lines")
    if runs is None:
        own.forget()
    few = frequent.count() <= BROADCAST_KEYS

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, keys = [], []
            for n, text in enumerate(utf8(b, "body")):
                some = {k for k in keys_of(text, least_chars) if k}
                at += [n] * len(some)
                keys += some
            index = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("t1").take(index), b.column("t2").take(index), pa.array(keys, pa.binary())], names=["t1", "t2", "key"])

    held = mapped(rows.select("t1", "t2", "body"), lines, "t1 long, t2 long, key binary").join(F.broadcast(frequent) if few else frequent, "key", "left_semi")
    hits = stored(held.groupBy("t1", "t2").agg(F.collect_set("key").alias("hits")), "line-hits")
    kind = docs.schema[id_col].dataType.simpleString()
    done = mapped(rows.join(hits, ["t1", "t2"], "left").select("id", "body", "hits"), cleaner(least_chars), f"id {kind}, body string, n_lines long, n_dropped long")
    return done.select(F.col("id").alias(id_col), F.col("body").alias(text_col), "n_lines", "n_dropped")
