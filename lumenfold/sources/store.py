"""Tables on shared storage: snapshots, append-only logs, keyed upserts, seeds, and connectors."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor shares: the session's spark.checkpoint.dir, or a local one where that is unset and
    all runs in one process (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where and ("local-cluster" in spark.sparkContext.master or not spark.sparkContext.master.startswith("local")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return where or f"file:///tmp/lumenfold-checkpoints/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """A table written to the shared folder and read back, so that later steps survive lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scan(spark: SparkSession, path: str, **equal) -> DataFrame:  # noqa: ANN003
    """A table, with a filter for each column given; both reach the Parquet reader."""
    df = spark.read.parquet(path)
    for name, value in equal.items():
        df = df.where(F.col(name).isNull() if value is None else F.col(name) == value)
    return df


def by_key(df: DataFrame, key: str, value) -> DataFrame:  # noqa: ANN001
    return df.where(F.col(key) == value)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in the given order (descending columns), ties broken by that order alone."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(snapshot: DataFrame, changes: DataFrame, keys: list[str], version: str, tie: str) -> DataFrame:
    """The snapshot after keyed changes: the newest row of each key counts. A change overwrites all columns, with nulls
    too (a failed fetch empties the stored page)."""
    every = snapshot.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    return latest(every, keys, [F.desc(version), F.desc("__new"), F.desc(tie)]).drop("__new")


def natural_id(prefix: str, *key: Column) -> Column:
    """An id that follows from the natural key, so that a retried task makes the same one."""
    return F.concat(F.lit(f"{prefix}_"), F.md5(F.concat_ws("\x1f", *key)))


def seed(existing: DataFrame, seeds: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows to create, rows that are there already)."""
    return seeds.join(existing.select(key), key, "left_anti"), seeds.join(existing.select(key), key, "left_semi")


def default_categories(existing: DataFrame) -> DataFrame:
    """The seven initial categories, if there is none at all."""
    rows = existing.sparkSession.createDataFrame([(i, x, "active", True) for i, x in enumerate(rules.DEFAULT_CATEGORIES)], "ord int, name string, status string, is_default boolean")
    return rows if existing.isEmpty() else rows.limit(0)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int, int] | None = None, parts: int = 1) -> DataFrame:
    """A table of a relational database. With a whole-number key it is read in parallel ranges: of bounds (low, high, parts),
    or in `parts` ranges between the key's least and largest value, which the database is asked for. Rows beyond the bounds
    are in the outer ranges, null keys in the first; none is lost."""
    reader = spark.read.format("jdbc").option("url", url)
    if key and bounds is None and parts > 1:
        name = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)  # as Spark itself quotes it
        low, high = reader.option("dbtable", f"(SELECT MIN({name}) AS low, MAX({name}) AS high FROM {table}) ends").load().first()
        bounds = None if low is None else (int(low), int(high) + 1, parts)
    reader = reader.option("dbtable", table)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", bounds[2])
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, parts: int = 8, mode: str = "append") -> None:
    """Rows into a table of a relational database over at most `parts` connections. Each task commits on its own, so a run
    that broke off leaves some rows: write to a staging table, and let the database move them."""
    df.write.format("jdbc").option("url", url).option("dbtable", table).option("numPartitions", parts).mode(mode).save()


def fetched(fetcher: Callable[[str], dict], url: str) -> dict:
    """What a fetcher gives, as a row; whatever it raises, or gives that is no page, is the row's error."""
    try:
        got = fetcher(url)
        status, page, error = got.get("http_status"), got.get("html"), got.get("error")
        status = None if status is None else int(status)
        page = page.decode(errors="replace") if isinstance(page, bytes) else None if page is None else str(page)
        error = str(error) if error else None
    except Exception as e:  # noqa: BLE001
        status, page, error = None, None, str(e) or type(e).__name__
    return {"url": url, "html": page, "http_status": status, "error": error, "ok": not error and status is not None and 200 <= status < 300}


def fetch_pages(urls: DataFrame, fetcher: Callable[[str], dict]) -> DataFrame:
    """(url, html, http_status, error, ok) of each URL by an injected fetcher that never stops the job: an exception is an
    error of its row. ok: no error and a 2xx status."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([fetched(fetcher, url) for url in batch["url"]], columns=["url", "html", "http_status", "error", "ok"])

    return urls.select("url").mapInPandas(run, "url string, html string, http_status int, error string, ok boolean")


def fetch_politely(urls: DataFrame, fetcher: Callable[[str], dict], interval: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(host, url, html, http_status, error, ok, at) as fetch_pages(), but requests of one host are at least `interval` seconds
    apart. urls: host, ord, url.

    All URLs of a host are in one partition, so one task alone talks to it. A task takes the first URL of each of its hosts,
    then the second, and so on, and waits only where a host's turn has not come. `at` is the clock's time of the request.
    The clock and the waiting may be given, as in tests. A task that is run again starts with no memory of the attempt
    before; speculative execution must be off."""
    turn = Window.partitionBy("host").orderBy("ord", "url")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free: dict[str, float] = {}
        for batch in batches:
            rows = []
            for host, url in zip(batch["host"], batch["url"], strict=True):
                wait = free.get(host, clock()) - clock()
                if wait > 0:
                    sleep(wait)
                at = clock()
                free[host] = at + interval
                rows.append({"host": host, **fetched(fetcher, url), "at": at})
            yield pd.DataFrame(rows, columns=["host", "url", "html", "http_status", "error", "ok", "at"])

    ordered = urls.select("host", "ord", "url").withColumn("turn", F.row_number().over(turn))
    return ordered.repartition("host").sortWithinPartitions("turn", "host").mapInPandas(run, "host string, url string, html string, http_status int, error string, ok boolean, at double")


def outbox(mails: DataFrame, path: str) -> None:
    """The mail sink: messages are appended as JSON for a sender outside the engine."""
    mails.write.mode("append").json(path)
