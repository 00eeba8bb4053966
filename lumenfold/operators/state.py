"""State as snapshots and logs: settings with history, categories, sources, manual overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules


def overlay(defaults: DataFrame, kv: DataFrame) -> DataFrame:
    """Effective settings: defaults (key, value) under the stored ones."""
    return defaults.join(kv.select("key", F.col("value").alias("own")), "key", "left").select("key", F.coalesce("own", "value").alias("value"))


def parsed_threshold(value: Column, default: float = rules.NEAR_THRESHOLD) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(default))


def with_old_values(history: DataFrame, default: Column | None = None) -> DataFrame:
    """History with the value before each change."""
    w = Window.partitionBy("key").orderBy("created_at", "id")
    lag = F.lag("new_value").over(w)
    return history.withColumn("old_value", lag if default is None else F.coalesce(lag, default))


def current_settings(history: DataFrame) -> DataFrame:
    return history.groupBy("key").agg(F.max_by("new_value", F.struct("created_at", "id")).alias("value"))


def check_setting(key: str, value) -> str:  # noqa: ANN001
    """A setting as stored text; an illegal one is an error."""
    whole = {"max_items_per_digest": (1, 50), "send_window_start_hour": (0, 24), "send_window_end_hour": (0, 24), "max_retries": (0, 10)}
    if key == "default_frequency" and str(value) in rules.PERIOD_DAYS:
        return str(value)
    if key in whole and whole[key][0] <= int(value) <= whole[key][1]:
        return str(int(value))
    if key in ("send_empty_digest", "sends_paused"):
        return "true" if str(value).strip().lower() in ("1", "true", "yes", "on") else "false"
    if key in ("bounce_pause_threshold", "near_duplicate_threshold") and 0 <= float(value) <= 1:
        return str(float(value))
    raise ValueError(f"{key}: {value}")


def patch_settings(kv: DataFrame, changes: dict, actor: str, now: Column, defaults: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(settings, history rows) after changes. Only real changes make history; the window must start before it ends."""
    spark = kv.sparkSession
    base = rules.SETTING_DEFAULTS if defaults is None else defaults
    old = base | {r["key"]: r["value"] for r in kv.where(F.col("key").isin(*base)).collect()}  # one row a key at most
    new = {k: check_setting(k, v) for k, v in changes.items() if v is not None and k in base}
    if {"send_window_start_hour", "send_window_end_hour"} & new.keys():
        start, end = (int((old | new)[k]) for k in ("send_window_start_hour", "send_window_end_hour"))
        if start >= end:
            raise ValueError("the window must start before it ends")
    rows = [(k, old[k], v, actor) for k, v in sorted(new.items()) if old[k] != v]
    log = spark.createDataFrame(rows, "key string, old_value string, new_value string, actor string").withColumn("created_at", now)
    keep = kv.join(log.select("key"), "key", "left_anti").select("key", "value")
    return keep.unionByName(log.select("key", F.col("new_value").alias("value"))), log


def rollback(history: DataFrame, history_id, actor: str, now: Column) -> DataFrame:  # noqa: ANN001
    """The history row that takes a change back."""
    return history.where(F.col("id") == history_id).select("key", F.col("new_value").alias("old_value"), F.col("old_value").alias("new_value"), F.lit(actor).alias("actor"), now.alias("created_at"))


def history_row(df: DataFrame, action: str, actor: str, **columns: Column) -> DataFrame:
    return df.select(F.col("id").alias("category_id"), F.lit(action).alias("action"), F.lit(actor).alias("actor"), *[v.alias(k) for k, v in columns.items()])


def merge_category(articles: DataFrame, categories: DataFrame, source, target, actor: str = "system") -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: ANN001
    """(articles, categories, history) after moving all articles of one category to another and closing the first."""
    if source == target:
        raise ValueError("a category can't be merged into itself")
    moved = articles.withColumn("primary_category_id", F.when(F.col("primary_category_id") == source, target).otherwise(F.col("primary_category_id")))
    shut = categories.withColumn("status", F.when(F.col("id") == source, "inactive").otherwise(F.col("status")))
    return moved, shut, history_row(categories.where(F.col("id") == source), "merge", actor, old_name=F.col("name"), target_category_id=F.lit(target))


def set_category_status(categories: DataFrame, category_id, active: bool, actor: str = "system") -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    own = F.col("id") == category_id
    out = categories.withColumn("status", F.when(own, "active" if active else "inactive").otherwise(F.col("status")))
    return out, history_row(categories.where(own), "activate" if active else "deactivate", actor, old_name=F.col("name"))


def rename_category(categories: DataFrame, category_id, name: str, actor: str = "system") -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    if not categories.where((F.col("name") == name) & (F.col("id") != category_id)).isEmpty():
        raise ValueError(f"there is a category {name}")
    own = F.col("id") == category_id
    out = categories.withColumn("name", F.when(own, name).otherwise(F.col("name")))
    return out, history_row(categories.where(own), "rename", actor, old_name=F.col("name"), new_name=F.lit(name))


def create_unique(existing: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(table with what could be created, conflicts)."""
    fresh = new.join(existing.select(key), key, "left_anti").dropDuplicates([key])
    return existing.unionByName(fresh, allowMissingColumns=True), new.join(existing.select(key), key, "left_semi")


def valid_sources(sources: DataFrame) -> DataFrame:
    """Sources with `reject`. A whitelisted one needs a focus area, a keyword or an example."""
    empty = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) == 0
    aimless = (F.col("list_type") == "whitelist") & (F.trim(F.coalesce("focus_area", F.lit(""))) == "") & empty("include_keywords") & empty("example_urls")
    return sources.withColumn("reject", F.when(~F.col("site_url").rlike("^https?://"), "site_url").when(F.coalesce("weight", F.lit(1.0)) <= 0, "weight").when(aimless, "focus"))


def reclassify(articles: DataFrame, categories: DataFrame, overrides: DataFrame) -> DataFrame:
    """Manual categories, applied last: only active categories count; the article becomes normal.
    overrides: id, category_id."""
    ok = overrides.join(categories.where("status = 'active'").select(F.col("id").alias("category_id")), "category_id", "left_semi").select("id", F.col("category_id").alias("__c"))
    rows = articles.join(ok, "id", "left")
    return rows.withColumns({"primary_category_id": F.coalesce("__c", "primary_category_id"), "status": F.when(F.col("__c").isNotNull(), "normal").otherwise(F.col("status"))}).drop("__c")


def drop_dangling(articles: DataFrame, sources: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Referential actions: articles of deleted sources lose the reference; relations of deleted articles go, and lost
    targets become null."""
    s = sources.select(F.col("id").alias("source_id"), F.lit(True).alias("__s"))
    kept = articles.join(s, "source_id", "left").withColumn("source_id", F.when(F.col("__s"), F.col("source_id"))).drop("__s")
    own = relations.join(articles.select(F.col("id").alias("article_id")), "article_id", "left_semi")
    t = articles.select(F.col("id").alias("target_article_id"), F.lit(True).alias("__t"))
    return kept, own.join(t, "target_article_id", "left").withColumn("target_article_id", F.when(F.col("__t"), F.col("target_article_id"))).drop("__t")
