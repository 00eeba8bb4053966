"""Tables in buckets of a key, several of them under one list of versions: a commit replaces the buckets that changed, in all
tables at once, and points to the old files of the others. So a small change reads and writes the buckets it touches alone.

A bucket's rows are one folder of Parquet files, which never changes. What is read of a table is a list of such folders, from
the manifest, so that buckets left out are not even listed."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import versions

#: So many tasks at most write one bucket, by a hash of the whole row, so that a hot key's bucket is no single task.
SPREAD = 8
#: Name of the column that holds a row's bucket.
BUCKET = "__bucket"


class Parts:
    """State at a path. tables: {name: (key column, schema)}; buckets: how many each table has, fixed when it is made."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, tuple[str, StructType]], buckets: int = 256) -> None:
        self.spark, self.path, self.tables, self.buckets = spark, path, tables, buckets

    def version(self) -> int:
        return max(versions.versions(self.spark, self.path), default=0)

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of the keys in a table of one column: at most `buckets` numbers."""
        return sorted(r[0] for r in keys.select(self.bucket(F.col(keys.columns[0]))).distinct().collect())

    def told(self, version: int) -> dict:
        return versions.manifest(self.spark, self.path, version) if version else {"tables": {}, "note": ""}

    def read(self, name: str, buckets: Iterable[int] | None = None, version: int | None = None) -> DataFrame:
        """A table's rows, or those of some buckets."""
        folders = self.told(self.version() if version is None else version)["tables"].get(name, {})
        chosen = [f"{self.path}/{folders[str(b)]}" for b in (range(self.buckets) if buckets is None else sorted(set(buckets))) if str(b) in folders]
        schema = self.tables[name][1]
        return self.spark.read.schema(schema).parquet(*chosen) if chosen else self.spark.createDataFrame([], schema)

    def commit(self, changes: dict[str, tuple[DataFrame, list[int]]], expected: int, note: str = "") -> int:
        """Replace, for each table given, the buckets listed by the rows given, all of which are in those buckets; a bucket
        listed without rows becomes empty. The new version's number; versions.Conflict if `expected` is not the newest."""
        now = self.told(expected)
        for name, (rows, buckets) in changes.items():
            if not buckets:
                continue
            key, schema = self.tables[name]
            data = f"data/{uuid.uuid4().hex}"
            placed = rows.select(*schema.names, self.bucket(F.col(key)).alias(BUCKET))
            placed.repartition(BUCKET, F.pmod(F.xxhash64(*schema.names), F.lit(SPREAD))).write.partitionBy(BUCKET).parquet(f"{self.path}/{data}")
            fs, at = versions._fs(self.spark, self.path)
            folder = at(f"{self.path}/{data}")
            there = {s.getPath().getName() for s in fs.listStatus(folder)} if fs.exists(folder) else set()
            own = now["tables"].setdefault(name, {})
            for b in buckets:
                own.pop(str(b), None)
                if f"{BUCKET}={b}" in there:
                    own[str(b)] = f"{data}/{BUCKET}={b}"
        versions.publish(self.spark, self.path, expected + 1, now | {"note": note})
        return expected + 1
