"""Keyed versions in tiers: each batch adds a run of its newest rows, and runs of like size are merged into one, of which the
newest row of each key stays. A read sees live rows and the open runs, not all that was ever written.

The list of runs is a manifest of versions.py. A merge replaces runs by a new one in that list, so that readers see either
those or this, and the old files are never touched. A batch that is run again finds its number in the list and adds nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import versions

#: So many runs of one tier are merged into one of the next.
FAN = 4
#: Rows of the lowest tier; a tier is FAN times the one below.
TIER_ROWS = 100_000
BATCH, BUCKET = "__batch", "__bucket"


def runs(spark: SparkSession, path: str) -> tuple[int, dict]:
    """The newest version and its manifest: runs (folder, rows, first and last batch), last batch, buckets, schema."""
    number = max(versions.versions(spark, path), default=0)
    return number, versions.manifest(spark, path, number) if number else {"runs": [], "batch": -1, "buckets": None, "schema": None}


def newest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of each key with the greatest version, of equals that of the later batch, then the greatest row."""
    rest = [c for c in sorted(rows.columns) if c not in (*keys, version, BATCH, BUCKET)]
    w = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc(BATCH), *[F.desc(c) for c in rest])
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def tier(rows: int) -> int:
    """0 up to TIER_ROWS, then one more for each factor of FAN."""
    n, most = 0, TIER_ROWS
    while rows > most:
        n, most = n + 1, most * FAN
    return n


def write(rows: DataFrame, path: str, keys: list[str], buckets: int) -> tuple[str, int]:
    """A run in buckets of its keys, sorted by them: its folder under the path, and how many rows it has."""
    folder = f"data/{uuid.uuid4().hex}"
    placed = rows.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).repartition(BUCKET).sortWithinPartitions(BUCKET, *keys)
    placed.write.partitionBy(BUCKET).parquet(f"{path}/{folder}")
    return folder, rows.sparkSession.read.schema(placed.schema).parquet(f"{path}/{folder}").count()


def load(spark: SparkSession, path: str, told: dict, chosen: list[dict]) -> DataFrame:
    schema = StructType.fromJson(told["schema"]).add(BUCKET, "integer")
    parts = [spark.read.schema(schema).parquet(f"{path}/{r['folder']}") for r in chosen if r["rows"]]
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def add(batch: DataFrame, n: int, path: str, keys: list[str], version: str, buckets: int = 16) -> int:
    """Add batch n, then merge what is due. The number of the list's version after it."""
    spark = batch.sparkSession
    number, told = runs(spark, path)
    if n > told["batch"]:
        rows = newest(batch.withColumn(BATCH, F.lit(n)), keys, version)
        schema = told["schema"] or rows.schema.jsonValue()
        buckets = told["buckets"] or buckets
        folder, count = write(rows, path, keys, buckets)
        told = {"runs": [*told["runs"], {"folder": folder, "rows": count, "first": n, "last": n}], "batch": n, "buckets": buckets, "schema": schema}
        versions.publish(spark, path, number + 1, told)
        number += 1
    return compact(spark, path, keys, version)


def due(told: dict) -> list[dict]:
    """The runs of the lowest tier that has FAN of them; none, if no tier has."""
    by_tier: dict[int, list[dict]] = {}
    for r in told["runs"]:
        by_tier.setdefault(tier(r["rows"]), []).append(r)
    return next((group for _, group in sorted(by_tier.items()) if len(group) >= FAN), [])


def compact(spark: SparkSession, path: str, keys: list[str], version: str) -> int:
    """Merge until no tier has FAN runs. A merge of runs that mostly hold the same keys may stay in its tier; it is one run
    then, so each merge leaves fewer runs and the loop ends."""
    while True:
        number, told = runs(spark, path)
        old = due(told)
        if not old:
            return number
        folder, count = write(newest(load(spark, path, told, old).drop(BUCKET), keys, version), path, keys, told["buckets"])
        gone = {r["folder"] for r in old}
        merged = {"folder": folder, "rows": count, "first": min(r["first"] for r in old), "last": max(r["last"] for r in old)}
        versions.publish(spark, path, number + 1, told | {"runs": [*(r for r in told["runs"] if r["folder"] not in gone), merged]})


def now(spark: SparkSession, path: str, keys: list[str], version: str, only: DataFrame | None = None) -> DataFrame:
    """The newest row of each key. With `only`, a table of keys, the rows of those: other buckets are not read, as far as the
    keys leave some out."""
    _, told = runs(spark, path)
    if told["schema"] is None:
        raise LookupError(f"{path} has no runs")
    rows = load(spark, path, told, told["runs"])
    if only is not None:
        wanted = only.select(*keys).distinct()
        numbers = [r[0] for r in wanted.select(F.pmod(F.xxhash64(*keys), F.lit(told["buckets"])).cast("int")).distinct().collect()]
        rows = rows.where(F.col(BUCKET).isin(numbers)).join(wanted, keys, "left_semi")
    return newest(rows, keys, version).drop(BATCH, BUCKET)
