"""Exact dedup by progressive refinement: length, then prefix hash, then full hash of the groups that survive."""

from __future__ import annotations

from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from .common import stored

#: Keys of groups that may be sent to every executor; 16 bytes each, so 64 MB at most. Beyond it the keys are joined by shuffle.
BROADCAST_KEYS = 4_000_000


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, digest: bool = False) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept text_sha256 (null for rows whose full hash was not needed, unless `digest`).

    Rows are equal when their texts are identical (null counts as empty). The row with the largest id stays; of repeated
    rows with that id one stays. A null id is the smallest. Other columns are not read. An empty table gives no rows.

    Length and prefix hash are the only keys of the first rounds. SHA-256 is taken of texts that share both with another
    row; of the others only if their digest is asked for.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("body"),
    ).withColumns({"n_bytes": F.octet_length("body"), "prefix": F.xxhash64(F.substring("body", 1, prefix_chars))})
    lengths = survivors(rows.groupBy("n_bytes"), "length-groups")
    keys = survivors(rows.join(lengths, "n_bytes", "left_semi").groupBy("n_bytes", "prefix"), "prefix-groups")
    sha = F.sha2("body", 256).alias("text_sha256")
    again = rows.join(keys, ["n_bytes", "prefix"], "left_semi")
    full = stored(again.select("id", F.monotonically_increasing_id().alias("rid"), "n_bytes", sha), "full-hashes")
    # Kept as a table, so that the join below has its own exchanges and Spark can split a group that very many rows share.
    groups = full.groupBy("n_bytes", "text_sha256").agg(F.max(F.struct("id", "rid")).alias("keep"), F.count("*").alias("size")).where("size > 1")
    groups = stored(groups, "equal-texts")
    dealt = full.join(groups, ["n_bytes", "text_sha256"], "left").select(
        "id", F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("rid") == F.col("keep.rid"), F.lit(True)).alias("kept"), "text_sha256"
    )
    alone = rows.join(keys, ["n_bytes", "prefix"], "left_anti").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha if digest else F.lit(None).cast("string").alias("text_sha256"))
    return dealt.unionByName(alone).withColumnRenamed("id", id_col)


def survivors(groups: GroupedData, tag: str) -> DataFrame:
    """The keys of groups with two rows or more; marked for broadcast if their count allows it."""
    keys = stored(groups.agg(F.count("*").alias("n")).where("n > 1").drop("n"), tag)
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns. Of rows repeated with one id and text, one stays."""
    names, sha = docs.columns, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    lost = stored(exact_dedup(docs.select(id_col, text_col), id_col, text_col).where("not kept").select(F.col(id_col).alias("__id"), "keep_id", F.col("text_sha256").alias("__sha")), "dropped")
    other = lost.where("not (__id <=> keep_id)").select("__id", "__sha").distinct()
    left = docs.withColumn("__own", sha).join(other, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__sha")), "left_anti")
    if not lost.where("__id <=> keep_id").isEmpty():
        left = left.dropDuplicates([id_col, "__own"])
    return left.select(*names)
