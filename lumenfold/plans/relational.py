"""Queries of the relational core on the star tables: joins, counts, pages, upserts, state changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import browse, crawl, insights, state
from ..sources import store
from .tables import ARTICLES, articles, table


def outer_join_conditional_count(spark, sf_dir):  # noqa: ANN001, ANN201
    """Nations with their customers of positive balance, none included."""
    good = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return table(spark, sf_dir, "nation").join(good, "n_nationkey", "left").groupBy("n_nationkey", "n_name").agg(F.count("c_custkey").alias("customers"))


def semi_by_id_or_name(spark, sf_dir):  # noqa: ANN001, ANN201
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("primary_category_id"))
    return browse.by_category(c, n, "3").unionByName(browse.by_category(c, n, n.agg(F.max("name")).first()[0])).select("c_custkey")


def anti_never_ordered(spark, sf_dir):  # noqa: ANN001, ANN201
    o = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


def paged_topk(spark, sf_dir):  # noqa: ANN001, ANN201
    return browse.page(table(spark, sf_dir, "orders"), [F.desc("o_orderdate"), F.col("o_orderkey")], 3, 40).select("o_orderkey", "o_custkey")


def seed_antijoin(spark, sf_dir):  # noqa: ANN001, ANN201
    """Parts that are still to be created where those of big orders exist."""
    seeds = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"))
    there = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("key"))
    return store.seed(there, seeds, "key")[0]


def ordered_distinct_first(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"), "l_suppkey")
    return crawl.first_seen(rows, ["l_partkey"], "position")


def latest_page_upsert(spark, sf_dir):  # noqa: ANN001, ANN201
    """The newest event of each user and type, as pages are overwritten by later fetches."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").alias("fetched_at"), "event_id")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    return store.upsert(e.where(F.col("fetched_at") < cut), e.where(F.col("fetched_at") >= cut), ["user_id", "event_type"], "fetched_at", "event_id").select("user_id", "event_type", "event_id")


def category_merge_update(spark, sf_dir):  # noqa: ANN001, ANN201
    c = spark.createDataFrame([("es", "Spanish", "active"), ("fr", "French", "active")], "id string, name string, status string")
    moved, _, _ = state.merge_category(articles(spark, sf_dir), c, "es", "fr")
    return moved.groupBy("primary_category_id").agg(F.count("*").alias("n"))


def override_join(spark, sf_dir):  # noqa: ANN001, ANN201
    c = spark.createDataFrame([("junk", "active"), ("old", "inactive")], "id string, status string")
    l = table(spark, sf_dir, "labels")
    o = l.where("quality = 0").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "old").otherwise("junk").alias("category_id"))
    return state.reclassify(articles(spark, sf_dir), c, o).groupBy("primary_category_id", "status").agg(F.count("*").alias("n"))


def source_filter_time_range(spark, sf_dir):  # noqa: ANN001, ANN201
    s = spark.createDataFrame([("src3", "Site 3", "https://three.example"), ("src4", "Site 4", "https://four.example")], "id string, name string, site_url string")
    rows = browse.by_source(articles(spark, sf_dir).where(browse.visible()), s, "https://three.example")
    return browse.between(rows, "2024-01-01 00:05:00", "2024-01-01 01:00:00").select("id")


def tag_filter(spark, sf_dir):  # noqa: ANN001, ANN201
    """Articles with the tag src5, through the bridge table."""
    a = articles(spark, sf_dir)
    bridge = a.select(F.col("id").alias("article_id"), F.explode("tags").alias("tag_id"))
    tags = bridge.select(F.col("tag_id").alias("id"), F.upper("tag_id").alias("name")).distinct()
    return browse.by_tag(a, bridge, tags, "SRC5").select("id")


def tag_lists(spark, sf_dir):  # noqa: ANN001, ANN201
    a = articles(spark, sf_dir)
    bridge = a.select(F.col("id").alias("article_id"), F.explode("tags").alias("tag_id"))
    tags = bridge.select(F.col("tag_id").alias("id"), F.upper("tag_id").alias("name")).distinct()
    return browse.tag_names(bridge, tags).select("id", F.array_join("tags", ",").alias("tags"))


def search_parts(spark, sf_dir):  # noqa: ANN001, ANN201
    return browse.search(table(spark, sf_dir, "part"), " rINg ", "p_name", "p_type").select("p_partkey")


def status_filter(spark, sf_dir):  # noqa: ANN001, ANN201
    return browse.validated(articles(spark, sf_dir), "status", "article_status", "filtered").select("id")


def public_sources(spark, sf_dir):  # noqa: ANN001, ANN201
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("https://s"), "s_suppkey", F.lit(".example")).alias("site_url"), F.lit("normal").alias("update_frequency"), F.lit(None).cast("timestamp").alias("last_success_at"), (F.col("s_acctbal") > 0).alias("is_active"))
    return browse.public_sources(s).select("id", "name", "site_url")


def topic_options(spark, sf_dir):  # noqa: ANN001, ANN201
    c = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.when(F.col("r_regionkey") < 3, "active").otherwise("inactive").alias("status"))
    t = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct()
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_acctbal") > 0).alias("is_active"), F.lit("neutral").alias("list_type"))
    return browse.topic_options(c, t, s)


def counts_with_domain(spark, sf_dir):  # noqa: ANN001, ANN201
    return insights.counts_by(table(spark, sf_dir, "orders"), "o_orderstatus", ("F", "O", "P", "X"))


def dangling_references(spark, sf_dir):  # noqa: ANN001, ANN201
    """Orders as articles whose customer (source) may be gone; items as relations whose part (target) may be gone."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source_id"))
    s = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("article_id"), F.col("l_partkey").alias("target_article_id"))
    a, rel = state.drop_dangling(o, s, r)
    return a.agg(F.count("*").alias("articles"), F.count("source_id").alias("with_source")).crossJoin(rel.agg(F.count("*").alias("relations"), F.count("target_article_id").alias("with_target")))  # one row each


QUERIES = {f.__name__: f for f in (
    outer_join_conditional_count, semi_by_id_or_name, anti_never_ordered, paged_topk, seed_antijoin, ordered_distinct_first, latest_page_upsert, category_merge_update, override_join, source_filter_time_range, tag_filter, tag_lists,
    search_parts, status_filter, public_sources, topic_options, counts_with_domain, dangling_references,
)}
SQL = {
    "outer_join_conditional_count": "SELECT n_nationkey, n_name, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 0 GROUP BY 1, 2",
    "semi_by_id_or_name": "SELECT c_custkey FROM customer WHERE c_nationkey = 3 UNION ALL SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_name = (SELECT max(n_name) FROM nation))",
    "anti_never_ordered": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "paged_topk": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 40 OFFSET 80",
    "seed_antijoin": "SELECT p_partkey AS key FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    "ordered_distinct_first": "SELECT l_partkey, min(l_orderkey * 10 + l_linenumber) AS position, arg_min(l_suppkey, l_orderkey * 10 + l_linenumber) AS l_suppkey FROM lineitem GROUP BY 1",
    "latest_page_upsert": "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2",
    "category_merge_update": "SELECT CASE lang WHEN 'es' THEN 'fr' ELSE lang END AS primary_category_id, count(*) AS n FROM documents GROUP BY 1",
    "override_join": f"WITH {ARTICLES} SELECT CASE WHEN quality = 0 AND toxic = 0 THEN 'junk' ELSE category END AS primary_category_id, CASE WHEN quality = 0 AND toxic = 0 THEN 'normal' ELSE status END AS status, count(*) AS n FROM a LEFT JOIN labels ON doc_id = id GROUP BY 1, 2",
    "source_filter_time_range": f"WITH {ARTICLES} SELECT id FROM a WHERE source_id = 'src3' AND status = 'normal' AND coalesce(published_at, crawled_at) BETWEEN TIMESTAMP '2024-01-01 00:05:00' AND TIMESTAMP '2024-01-01 01:00:00'",
    "tag_filter": "SELECT doc_id AS id FROM documents WHERE source = 'src5'",
    "tag_lists": "SELECT doc_id AS id, upper(lang) || ',' || upper(source) AS tags FROM documents",
    "search_parts": "SELECT p_partkey FROM part WHERE p_name ILIKE '%RING%' OR p_type ILIKE '%RING%'",
    "status_filter": f"WITH {ARTICLES} SELECT id FROM a WHERE status = 'filtered'",
    "public_sources": "SELECT s_suppkey AS id, s_name AS name, 'https://s' || s_suppkey || '.example' AS site_url FROM supplier WHERE s_acctbal > 0",
    "topic_options": "SELECT 'category' AS kind, r_name AS value, r_name AS label FROM region WHERE r_regionkey < 3 UNION ALL SELECT DISTINCT 'tag', p_brand, p_brand FROM part UNION ALL SELECT 'source', s_suppkey::VARCHAR, s_name FROM supplier WHERE s_acctbal > 0",
    "counts_with_domain": "SELECT o_orderstatus, n FROM (SELECT v AS o_orderstatus, count(o.o_orderstatus) AS n FROM (SELECT unnest(['F', 'O', 'P', 'X']) AS v) LEFT JOIN orders o ON o.o_orderstatus = v GROUP BY 1)",
    "dangling_references": "SELECT (SELECT count(*) FROM orders) AS articles, (SELECT count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS with_source, count(*) AS relations, count(*) FILTER (WHERE l_partkey IN (SELECT o_orderkey FROM orders)) AS with_target FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)",
}
