"""Reading articles: visibility, filters, pages, details, categories and source lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules


def visible() -> Column:
    """For readers: not hidden by status, and its knowledge not covered."""
    return ~F.col("status").isin(*rules.HIDDEN_STATUSES) & (F.col("knowledge_status").isNull() | (F.col("knowledge_status") != "covered"))


def counted() -> Column:
    """For insights and category counts: all but filtered ones."""
    return F.col("status") != "filtered"


def pushable() -> Column:
    """For digests: neither hidden by status nor covered or pending by knowledge."""
    return ~F.col("status").isin(*rules.HIDDEN_STATUSES) & (F.col("knowledge_status").isNull() | ~F.col("knowledge_status").isin("covered", "pending"))


def push_blocked(articles: DataFrame) -> DataFrame:
    return articles.where((F.col("status") == "knowledge_duplicate") | F.col("knowledge_status").isin("covered", "pending")).select("id")


def without_hidden(articles: DataFrame, hidden: DataFrame) -> DataFrame:
    return articles.join(hidden.select(F.col("article_id").alias("id")), "id", "left_anti")


def effective_time() -> Column:
    return F.coalesce("published_at", "crawled_at")


def by_category(articles: DataFrame, categories: DataFrame, wanted: str) -> DataFrame:
    """Of a category given by id or name."""
    keys = categories.where((F.col("id") == wanted) | (F.col("name") == wanted)).select(F.col("id").alias("primary_category_id"))
    return articles.join(keys, "primary_category_id", "left_semi")


def by_tag(articles: DataFrame, article_tags: DataFrame, tags: DataFrame, wanted: str) -> DataFrame:
    keys = tags.where((F.col("id") == wanted) | (F.col("name") == wanted)).select(F.col("id").alias("tag_id"))
    return articles.join(article_tags.join(keys, "tag_id", "left_semi").select(F.col("article_id").alias("id")), "id", "left_semi")


def by_source(articles: DataFrame, sources: DataFrame, wanted: str) -> DataFrame:
    keys = sources.where((F.col("id") == wanted) | (F.col("name") == wanted) | (F.col("site_url") == wanted)).select(F.col("id").alias("source_id"))
    return articles.join(keys, "source_id", "left_semi")


def between(articles: DataFrame, start=None, end=None) -> DataFrame:  # noqa: ANN001
    """Effective time from start to end, both included; an open end is None."""
    for bound, test in ((start, lambda t, b: t >= b), (end, lambda t, b: t <= b)):
        if bound is not None:
            articles = articles.where(test(effective_time(), F.lit(bound)))
    return articles


def validated(df: DataFrame, column: str, domain: str, value: str | None) -> DataFrame:
    """A filter by an enumeration; an unknown value is an error."""
    if value is None:
        return df
    if value not in rules.ENUMS[domain]:
        raise ValueError(f"unknown {domain}: {value}")
    return df.where(F.col(column) == value)


def search(df: DataFrame, text: str, *columns: str) -> DataFrame:
    """Either column contains the text, whatever the case; its wild cards count as such."""
    test = F.lit(False)
    for name in columns:
        test = test | F.col(name).ilike(f"%{text.strip()}%")
    return df.where(test)


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20, most: int = 100) -> DataFrame:
    """One page in a total order; number and size are at least 1, size at most `most`."""
    number, size = max(1, number), min(max(1, size), most)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def pages(total: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / size))


def envelope(found: DataFrame, items: DataFrame, number: int, size: int) -> DataFrame:
    """One JSON row as a REST list has it: total, page, page_size, items (one page, so bounded by its size)."""
    rows = items.agg(F.collect_list(F.struct(*items.columns)).alias("items"))
    total = found.agg(F.count("*").alias("total"))
    return total.crossJoin(rows).select(F.to_json(F.struct("total", F.lit(number).alias("page"), F.lit(size).alias("page_size"), "items")).alias("body"))  # one row each


def list_items(found: DataFrame, categories: DataFrame, sources: DataFrame, tags: DataFrame, sizes: DataFrame, decisions: DataFrame) -> DataFrame:
    """Items of one page: small tables are joined after the page was cut, so joins see its rows only."""
    c = categories.select(F.col("id").alias("primary_category_id"), F.col("name").alias("category_name"))
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    out = found.join(c, "primary_category_id", "left").join(s, "source_id", "left").join(tags, "id", "left").join(sizes, "id", "left").join(decisions, "id", "left")
    return out.select(
        "id", "title", "summary", "url", effective_time().alias("time"), F.when(F.col("category_name").isNull(), F.array().cast("array<string>")).otherwise(F.array("category_name")).alias("categories"),
        F.coalesce("source_name", F.lit(rules.UNKNOWN_SOURCE)).alias("source_name"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("sources", F.lit(1)).alias("sources"), "knowledge_status", "decision",
    )


def tag_names(article_tags: DataFrame, tags: DataFrame) -> DataFrame:
    return article_tags.join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id").groupBy(F.col("article_id").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("tags"))


def detail(articles: DataFrame, relations: DataFrame, edges: DataFrame, article_id) -> DataFrame:  # noqa: ANN001
    """The record that an article id stands for: its group's primary, all sources of the group, related articles."""
    from .dedup import members_of, related_both_ways

    group = members_of(relations, article_id)
    primary = group.where("is_primary").select(F.col("article_id").alias("id"))
    own = articles.where(F.col("id") == article_id).select("id")
    target = primary.unionByName(own.join(group.limit(1).select(F.lit(1)), how="left_anti", on=F.lit(True)))
    members = group.select("article_id", "is_primary").join(articles.select(F.col("id").alias("article_id"), "url", "title"), "article_id").agg(F.array_sort(F.collect_set(F.struct("article_id", "url", "title", "is_primary"))).alias("sources"))
    near = related_both_ways(edges).join(target.select(F.col("id").alias("article_id")), "article_id", "left_semi").agg(F.array_sort(F.collect_set("related_id")).alias("related"))
    return articles.join(target, "id", "left_semi").crossJoin(members).crossJoin(near)  # one row each


def category_counts(categories: DataFrame, articles: DataFrame, hidden: DataFrame) -> DataFrame:
    """Every category with its visible articles, empty ones with 0. The right side is filtered before the outer join."""
    right = without_hidden(articles.where(counted()), hidden).select("primary_category_id", F.col("id").alias("article_id"))
    left = categories.select(F.col("id").alias("primary_category_id"), "name")
    return left.join(right, "primary_category_id", "left").groupBy("primary_category_id", "name").agg(F.count("article_id").alias("articles"))


def freshness(sources: DataFrame) -> DataFrame:
    """When each active source was last reached, and last with success: what readers see of it. Its tier is not shown."""
    return sources.where("is_active").select("id", "name", "site_url", "last_crawled_at", "last_success_at").orderBy("name", "id")


def tiers(sources: DataFrame) -> DataFrame:
    """All sources with their tier and what follows from it, for administrators."""
    from .crawl import interval

    return sources.select("id", "name", "list_type", "is_active", "update_frequency", interval().cast("long").alias("seconds")).orderBy("id")


def public_sources(sources: DataFrame) -> DataFrame:
    return sources.where("is_active").select("id", "name", "site_url", "update_frequency", "last_success_at").orderBy("name", "id")


def topic_options(categories: DataFrame, tags: DataFrame, sources: DataFrame) -> DataFrame:
    """kind, value, label: what can be subscribed to."""
    a = categories.where("status = 'active'").select(F.lit("category").alias("kind"), F.col("name").alias("value"), F.col("name").alias("label"))
    b = tags.select(F.lit("tag").alias("kind"), F.col("name").alias("value"), F.col("name").alias("label"))
    c = sources.where("is_active and list_type <> 'blacklist'").select(F.lit("source").alias("kind"), F.col("id").cast("string").alias("value"), F.col("name").alias("label"))
    return a.unionByName(b).unionByName(c).orderBy("kind", "label")
