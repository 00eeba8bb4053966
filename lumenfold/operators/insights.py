"""Counts over the whole collection, with empty buckets filled from the domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from .browse import counted, without_hidden


def domain(spark: SparkSession, values: tuple[str, ...], name: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in values], f"{name} string")


def counts_by(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Rows of each value of a closed domain, 0 for those without."""
    found = df.groupBy(column).agg(F.count("*").alias("n"))
    return domain(df.sparkSession, values, column).join(found, column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def category_distribution(categories: DataFrame, articles: DataFrame, hidden: DataFrame) -> DataFrame:
    """Visible articles by category name, and those without one under a label of their own if there are any."""
    from .browse import category_counts

    named = category_counts(categories, articles, hidden).select("name", "articles")
    none = without_hidden(articles.where(counted() & F.col("primary_category_id").isNull()), hidden)
    bare = none.agg(F.count("*").alias("articles")).where("articles > 0").select(F.lit(rules.UNCATEGORIZED_LABEL).alias("name"), "articles")
    return named.unionByName(bare)


def dedup_stats(articles: DataFrame, relations: DataFrame) -> DataFrame:
    """One row: exact, near, related, merged, total, unique. Unique subtracts member rows, not members."""
    n = lambda kind: F.count_if((F.col("relation_type") == kind) & ~F.col("is_primary")).alias(kind)
    rel = relations.agg(n("exact_duplicate"), n("near_duplicate"), n("related"))
    total = articles.where(counted()).agg(F.count("*").alias("total"))
    merged = F.col("exact_duplicate") + F.col("near_duplicate")
    return rel.crossJoin(total).select(F.col("exact_duplicate").alias("exact"), F.col("near_duplicate").alias("near"), "related", merged.alias("merged"), "total", F.greatest(F.lit(0), F.col("total") - merged).alias("unique_articles"))  # one row each


def usage_of_day(extractions: DataFrame, now: Column) -> DataFrame:
    """Model calls since midnight: calls, failed, tokens."""
    today = extractions.where((F.col("created_at") >= F.date_trunc("day", now)) & (F.col("created_at") <= now))
    return today.agg(F.count("*").alias("calls"), F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(F.sum(F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))), F.lit(0)).alias("tokens"))


def delivery_health(digests: DataFrame, threshold: float, paused: bool = False, sample: int = rules.HEALTH_SAMPLE) -> DataFrame:
    """Of the latest digests: sampled, sent, failed, skipped, failure rate of attempts, and whether sending pauses."""
    last = digests.orderBy(F.desc("created_at"), F.desc("id")).limit(sample)
    n = lambda s: F.count_if(F.col("status") == s)
    out = last.agg(F.count("*").alias("sampled"), n("sent").alias("sent"), n("failed").alias("failed"), n("skipped_empty").alias("skipped"))
    rate = F.coalesce(F.try_divide(F.col("failed"), F.col("sent") + F.col("failed")), F.lit(0.0))
    return out.withColumn("failure_rate", rate).withColumn("paused", F.lit(paused) | ((F.col("sent") + F.col("failed") > 0) & (F.col("failure_rate") >= threshold)))


def backlog(digests: DataFrame) -> DataFrame:
    return counts_by(digests, "status", rules.DIGEST_STATUSES)


def knowledge_stats(articles: DataFrame, categories: DataFrame) -> DataFrame:
    """Archived articles by category name with a label for none; and how many are pending and partial."""
    c = categories.select(F.col("id").alias("primary_category_id"), F.col("name"))
    named = articles.join(c, "primary_category_id", "left").withColumn("name", F.coalesce("name", F.lit(rules.UNCATEGORIZED_LABEL)))
    archived = named.where("status = 'knowledge_duplicate'").groupBy("name").agg(F.count("*").alias("n")).select(F.lit("archived").alias("kind"), "name", "n")
    rest = articles.where(F.col("knowledge_status").isin("pending", "partial")).groupBy(F.col("knowledge_status").alias("kind")).agg(F.count("*").alias("n")).select("kind", F.lit("").alias("name"), "n")
    return archived.unionByName(rest)


def report(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """A run's report: one row with how many rows had each outcome."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(F.col(column) == v).alias(v) for v in values])
