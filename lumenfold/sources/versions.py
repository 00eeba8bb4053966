"""Versioned snapshots: a table is a list of numbered versions, each a folder of Parquet files that never changes.

A commit writes its rows to a folder of its own and then creates the next version's manifest, which must not exist yet. So
a write that fails leaves the version before, readers see whole versions, a plan may read the version it replaces, and of
two writers that started from one version the second is refused. The store must create files exclusively, as HDFS does."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Conflict(Exception):  # noqa: N818
    """Another writer committed the version that was to be written."""


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop.Path


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of all versions, from the oldest."""
    fs, at = _fs(spark, path)
    folder = at(f"{path}/versions")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def manifest(spark: SparkSession, path: str, version: int) -> dict:
    return json.loads(spark.read.option("wholetext", True).text(f"{path}/versions/{version:010d}.json").first()[0])


def publish(spark: SparkSession, path: str, version: int, told: dict) -> None:
    """Create a version's manifest; Conflict if that version is there already."""
    fs, at = _fs(spark, path)
    name = at(f"{path}/versions/{version:010d}.json")
    try:
        out = fs.create(name, False)
    except Exception as e:
        if fs.exists(name):
            raise Conflict(f"version {version} of {path} is there already") from e
        raise
    out.write(bytearray(json.dumps(told).encode()))
    out.close()


def commit(df: DataFrame, path: str, expected: int | None = None, note: str = "") -> int:
    """Write the rows as the version after `expected` (the newest one now, if not given); its number. Conflict if that is there."""
    spark = df.sparkSession
    if expected is None:
        expected = max(versions(spark, path), default=0)
    data = f"data/{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{data}")
    publish(spark, path, expected + 1, {"data": data, "schema": df.schema.json(), "note": note})
    return expected + 1


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version's rows; the newest one's, if no number is given."""
    from pyspark.sql.types import StructType

    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise LookupError(f"{path} has no version {version or ''}")
    told = manifest(spark, path, version or known[-1])
    return spark.read.schema(StructType.fromJson(json.loads(told["schema"]))).parquet(f"{path}/{told['data']}")


def update(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], attempts: int = 5, note: str = "") -> int:
    """Replace the newest version by what `change` makes of it; if another writer is first, again from that one's version."""
    for n in range(attempts):
        base = versions(spark, path)[-1]
        try:
            return commit(change(read(spark, path, base)), path, base, note)
        except Conflict:
            if n == attempts - 1:
                raise
    raise AssertionError
