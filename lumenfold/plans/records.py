"""Queries of stored records: lookups, fetches, state changes of categories, sources, settings and entries, scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import rules, text, vectors
from ..operators import browse, crawl, dedup, insights, knowledge, state
from ..sources import store
from ..streaming import ingest
from .streams import streamed
from .notices import STORED
from .tables import ARTICLES, articles, now, table


def pk_lookup(spark, sf_dir):  # noqa: ANN001, ANN201
    o = table(spark, sf_dir, "orders")
    return store.by_key(o, "o_orderkey", 5).unionByName(store.by_key(o, "o_orderkey", -1)).select("o_orderkey", "o_custkey")


def equality_scan(spark, sf_dir):  # noqa: ANN001, ANN201
    return store.scan(spark, f"{sf_dir}/lineitem.parquet", l_returnflag="R", l_linenumber=3).select("l_orderkey", "l_partkey")


def answer(url: str) -> dict:
    """A site for fetches: some pages are gone, some connections fail."""
    if "#" in url:
        raise OSError("down")
    return {"http_status": 404 if "?" in url else 200, "html": url.upper()}


def fetch_outcomes(spark, sf_dir):  # noqa: ANN001, ANN201
    return store.fetch_pages(table(spark, sf_dir, "pages").select("url").distinct(), answer)


def crawl_run(spark, sf_dir):  # noqa: ANN001, ANN201
    """Sources as a crawl leaves them a report: a source for each host, some of them closed, blacklisted or denied."""
    from ..functions import urls

    p = table(spark, sf_dir, "pages")
    host = urls.authority(F.col("url"))
    pages = p.select(host.alias("source_id"), "url", F.col("page_id").alias("position"))
    sources = pages.select(F.col("source_id").alias("id")).distinct().withColumns({"is_active": F.length("id") % 5 != 0, "list_type": F.when(F.length("id") % 7 == 0, "blacklist").otherwise("neutral")})
    robots = crawl.robots_rules(p.select(urls.origin(F.col("url")).alias("origin"), F.lit("User-agent: *\nDisallow: /en/").alias("text")).distinct())
    none = spark.createDataFrame([], "source_id string, url string, raw_html string, http_status int, status string, error_message string, fetched_at timestamp")
    _, report = crawl.crawl(sources, pages, robots, answer, none, now(), sleep=lambda seconds: None)  # a made-up site needs no rest
    return report


def robots_gates(spark, sf_dir):  # noqa: ANN001, ANN201
    p = table(spark, sf_dir, "pages")
    return crawl.gate(p, True).unionByName(crawl.gate(p, False)).groupBy("allowed").agg(F.count("*").alias("n"))


def default_categories(spark, sf_dir):  # noqa: ANN001, ANN201
    """What is made where there are categories (the languages of documents) and where there are none (blank languages)."""
    d = table(spark, sf_dir, "documents").select(F.trim("lang").alias("name")).distinct()
    made = lambda kind, df: store.default_categories(df).select(F.lit(kind).alias("kind"), "ord", "name", "status")
    return made("blank", d.where("name = ''")).unionByName(made("some", d.where("name <> ''")))


def outbox_mails(spark, sf_dir):  # noqa: ANN001, ANN201
    """Mails of the outbox, appended in two runs, as a sender reads them."""
    path = f"{store.shared_dir(spark)}/outbox-{uuid.uuid4().hex}"
    b = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("r"), "item_id", F.lit("@example.org")).alias("to"), F.col("text").alias("body"), "item_id")
    store.outbox(b.where("item_id % 2 = 0").drop("item_id"), path)
    store.outbox(b.where("item_id % 2 = 1").drop("item_id"), path)
    return spark.read.schema("to string, body string").json(path)


def pages_to_parse(spark, sf_dir):  # noqa: ANN001, ANN201
    """Fetched pages that were not parsed since; every third one was."""
    p = table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.lit("/"), "page_id").alias("url"), F.timestamp_seconds("page_id").alias("fetched_at"), F.when(F.col("page_id") % 4 == 1, "failed").otherwise("fetched").alias("status"))
    return crawl.fetched_pages(p, p.where("page_id % 3 = 0")).select("page_id")


def extraction_run(spark, sf_dir):  # noqa: ANN001, ANN201
    """A model's points of the first 200 articles (a run's limit)."""
    a = articles(spark, sf_dir).select(F.col("id").alias("article_id"), F.col("url").alias("fingerprint"), "title", "content")
    out = knowledge.extract_points(a, knowledge.stub_client)
    return out.select("article_id", "ok", F.size("points").cast("long").alias("n_points"), F.element_at("points", 1)["name"].alias("name"), "tokens")


def extraction_cache(spark, sf_dir):  # noqa: ANN001, ANN201
    """The cache after a run, and which articles hit it."""
    a = articles(spark, sf_dir).select("id", F.col("url").alias("content_hash"), "title", "content", "weight")
    cache = a.where("id % 2 = 0").select(F.col("id").alias("article_id"), F.when(F.col("id") % 4 == 0, F.col("content_hash")).otherwise("old").alias("fingerprint"), F.lit("ok").alias("status"), F.array("title").alias("points"), F.lit(1).alias("attempts"), F.lit(10).cast("long").alias("tokens"))
    hits, rest = knowledge.cached_extractions(a, cache)
    r = rest.where("article_id % 3 = 0").select("article_id", "fingerprint", (F.col("article_id") % 5 != 0).alias("ok"), F.array(F.lit("p")).alias("points"), F.lit(7).cast("long").alias("tokens"))
    after = knowledge.save_extractions(cache, r).groupBy("status", "attempts", "tokens").agg(F.count("*").alias("n"))
    return after.unionByName(hits.agg(F.lit("hits").alias("status"), F.lit(0).alias("attempts"), F.lit(0).cast("long").alias("tokens"), F.count("*").alias("n")))


def extraction_retries(spark, sf_dir):  # noqa: ANN001, ANN201
    l = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("article_id"), F.when(F.col("quality") == 1, "ok").otherwise("failed").alias("status"))
    return knowledge.retry_set(articles(spark, sf_dir), l, 50).select("id")


def list_envelope(spark, sf_dir):  # noqa: ANN001, ANN201
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return browse.envelope(o, browse.page(o, [F.desc("o_orderkey")], 2, 5), 2, 5)


def created_page(spark, sf_dir):  # noqa: ANN001, ANN201
    """The second page of the log by time of creation."""
    return browse.page(table(spark, sf_dir, "events"), [F.desc("ts"), F.desc("event_id")], 2, 50).select("event_id", "user_id")


def valid_sources(spark, sf_dir):  # noqa: ANN001, ANN201
    k = F.col("s_suppkey")
    none = F.array().cast("array<string>")
    s = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.when(k % 11 == 0, "ftp://x").otherwise("https://x").alias("site_url"), (F.col("s_acctbal") / 1000).alias("weight"), F.when(k % 2 == 0, "whitelist").otherwise("neutral").alias("list_type"), F.when(k % 3 == 0, "topic").otherwise(" ").alias("focus_area"),
        F.when(k % 5 == 0, F.array(F.lit("word"))).otherwise(none).alias("include_keywords"), F.when(k % 7 == 0, F.array(F.lit("u"))).alias("example_urls"),
    )
    return state.valid_sources(s).select("s_suppkey", "reject")


def created_sources(spark, sf_dir):  # noqa: ANN001, ANN201
    """Sources after creating some of which half are there already."""
    old = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    new = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000).alias("id"), F.col("s_name").alias("name"))
    made, clash = state.create_unique(old, new, "name")
    return made.withColumn("conflict", F.lit(False)).unionByName(clash.withColumn("conflict", F.lit(True)))


def source_tiers(spark, sf_dir):  # noqa: ANN001, ANN201
    from .notices import source_rows

    s = source_rows(spark, sf_dir).withColumn("name", F.concat(F.lit("s"), "id"))
    return browse.tiers(s).select("id", "list_type", "is_active", "seconds")


def source_freshness(spark, sf_dir):  # noqa: ANN001, ANN201
    from .notices import source_rows

    s = source_rows(spark, sf_dir).withColumns({"name": F.concat(F.lit("s"), "id"), "site_url": F.lit("https://x")})
    return browse.freshness(s).select("id", "name", "last_crawled_at", "last_success_at")


def category_changes(spark, sf_dir):  # noqa: ANN001, ANN201
    """Regions as categories: one renamed, one closed; the history of both beside the states they leave."""
    c = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("active").alias("status"))
    c, a = state.rename_category(c, 1, "Renamed", "admin")
    c, b = state.set_category_status(c, 2, False)
    rows = c.select("id", "name", "status")
    log = a.select(F.col("category_id").alias("id"), F.concat_ws(" ", "actor", "action", "old_name", "new_name").alias("name")).unionByName(b.select(F.col("category_id").alias("id"), F.concat_ws(" ", "actor", "action", "old_name").alias("name")))
    return rows.unionByName(log.withColumn("status", F.lit("history")))


def settings_patch(spark, sf_dir):  # noqa: ANN001, ANN201
    """Settings after a patch, and its history: what is as it was makes none."""
    from .notices import stored_settings

    kv = stored_settings(spark, sf_dir)
    new, log = state.patch_settings(kv, {"max_items_per_digest": 30, "max_retries": "3", "sends_paused": "yes", "unknown": 1}, "admin", now())
    return new.select("key", "value", F.lit("now").alias("kind")).unionByName(log.select("key", F.concat("old_value", F.lit(">"), "new_value").alias("value"), F.col("actor").alias("kind")))


def wiki_entries(spark, sf_dir):  # noqa: ANN001, ANN201
    """Nations as entries: two merged into a new one, one retired, one changed, one created."""
    e = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("entry_id"), F.col("n_name").alias("name"), F.concat(F.lit("in "), "n_regionkey").alias("summary"), F.lit("active").alias("status"), F.array(F.col("n_nationkey").cast("long")).alias("article_ids"), F.lit(None).cast("long").alias("merged_into_id"))
    e = knowledge.retire(knowledge.merge_entries(e, [4, 2], 100, "Both"), 7)
    e = knowledge.update_entries(e, spark.createDataFrame([(9, " New name ", None, [1, 9])], "entry_id long, name string, summary string, article_ids array<long>"))
    e = knowledge.create_entries(e, spark.createDataFrame([(200, " Fresh ", None)], "entry_id long, name string, summary string"))
    return e.select("entry_id", "name", "summary", "status", F.array_join(F.col("article_ids").cast("array<string>"), ",").alias("articles"), "merged_into_id")


def entry_links(spark, sf_dir):  # noqa: ANN001, ANN201
    old = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("entry_id"), F.col("n_nationkey").alias("article_id"))
    new = table(spark, sf_dir, "nation").select(F.lit(0).alias("entry_id"), F.col("n_nationkey").alias("article_id"))
    return knowledge.link_articles(old, new.unionByName(new))


def entries_by_name(spark, sf_dir):  # noqa: ANN001, ANN201
    e = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("entry_id"), F.concat(F.lit(" "), "n_name").alias("name"), F.when(F.col("n_nationkey") % 6 == 0, "retired").otherwise("active").alias("status"))
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("point_id"), F.concat(F.lit("NATION_"), "c_nationkey", F.when(F.col("c_custkey") % 2 == 0, " ").otherwise("x")).alias("name"))
    return knowledge.entry_by_name(e, p)


def nearest_by_text(spark, sf_dir):  # noqa: ANN001, ANN201
    """Nearest brands (each known by its first part) by the likeness of names, as no side has a vector."""
    none = F.lit(None).cast("array<double>")
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("point_id"), none.alias("embedding"), F.concat(F.lit("Brand#"), F.col("s_nationkey")).alias("text"))
    e = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("p_partkey")).select(F.col("p_partkey").alias("entry_id"), none.alias("embedding"), F.col("p_brand").alias("name"), F.lit("").alias("summary"), F.lit("active").alias("status"))
    return knowledge.nearest_vectors(p, e, 0.1).select("point_id", "entry_id", F.round("similarity", 6).alias("similarity"))


def held_for_push(spark, sf_dir):  # noqa: ANN001, ANN201
    """Articles whose knowledge is still to be judged are held back from digests, and shown to readers."""
    a = articles(spark, sf_dir).withColumn("knowledge_status", F.when(F.col("id") % 3 == 0, "pending").otherwise(F.col("knowledge_status")))
    return a.groupBy(browse.pushable().alias("pushable"), browse.visible().alias("visible")).agg(F.count("*").alias("n"))


def scalar_functions(spark, sf_dir):  # noqa: ANN001, ANN201
    c, name = table(spark, sf_dir, "customer"), F.col("c_name")
    return c.select(
        "c_custkey", text.hash_token(name).alias("token_hash"), text.point_text(name, F.lit(""), F.array(F.col("c_mktsegment"), F.lit(" "))).alias("point"), text.article_fingerprint(F.when(F.col("c_custkey") % 2 == 0, name), name, F.lit("x")).alias("fingerprint"),
        text.parse_bool(F.when(F.col("c_custkey") % 3 == 0, " YES ").when(F.col("c_custkey") % 3 == 1, "0").otherwise("on")).alias("flag"), text.published_label(F.when(F.col("c_custkey") % 2 == 0, F.timestamp_seconds(F.col("c_custkey") * 86461))).alias("label"),
        text.link(F.lit("https://x.org//"), "/confirm?token=", name).alias("link"), text.client_ip(F.concat(F.lit(" 10.0.0."), F.col("c_nationkey"), F.lit(" , 10.9.9.9"))).alias("ip"), F.array_join(text.clean_array(F.array(F.concat(F.lit(" "), name), F.lit("  "), F.col("c_mktsegment"))), "|").alias("cleaned"),
        store.natural_id("art", name, F.col("c_nationkey").cast("string")).alias("natural_id"), text.fold_text(F.concat(name, F.lit(" STRASSE Straße ＡＢ１"))).alias("folded"),
    )


def threshold_sanity(spark, sf_dir):  # noqa: ANN001, ANN201
    """The thresholds (low, high) that pairs of settings give: an order line's discount and tax, tenfold; many are 0 or
    crossed, those of returned lines unset."""
    high, low = F.when(F.col("l_returnflag") != "R", F.round(F.col("l_discount") * 10, 2)), F.round(F.col("l_tax") * 10, 2)
    t = vectors.sane_threshold_columns(high, low)
    return table(spark, sf_dir, "lineitem").select(t.alias("t")).groupBy("t.low", "t.high").agg(F.count("*").alias("n"))


def usage_by_kind(spark, sf_dir):  # noqa: ANN001, ANN201
    """Shown articles of every category, those without articles too; later copies of a text are hidden."""
    c = spark.createDataFrame([(x, x.upper()) for x in ("de", "en", "es", "fr", "it")], "id string, name string")
    a = articles(spark, sf_dir)
    texts = a.select("id", F.sha2("content", 256).alias("content_hash"))
    shown = insights.category_distribution(c, a, dedup.exact_parents(texts).select(F.col("id").alias("article_id")))
    return shown.select("name", F.col("articles").alias("n"))


def stream_page_upserts(spark, sf_dir):  # noqa: ANN001, ANN201
    """The newest event of each user and type, from versions appended by a stream."""
    path = f"{store.shared_dir(spark)}/upserts-{uuid.uuid4().hex}"
    e = streamed(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    ingest.upsert_pages(e, f"{path}/pages", f"{path}/state", ["user_id", "event_type"], "ts").awaitTermination()
    return ingest.pages_now(spark, f"{path}/pages", ["user_id", "event_type"], "ts").select("user_id", "event_type", "event_id")


QUERIES = {f.__name__: f for f in (
    pk_lookup, equality_scan, fetch_outcomes, crawl_run, robots_gates, default_categories, outbox_mails, pages_to_parse, extraction_run, extraction_cache, extraction_retries, list_envelope, created_page, valid_sources, created_sources, source_tiers,
    source_freshness, category_changes, settings_patch, wiki_entries, entry_links, entries_by_name, nearest_by_text, held_for_push, scalar_functions, threshold_sanity, usage_by_kind, stream_page_upserts,
)}
GRAMS = "list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i::INT, 2)))"
HOST = "regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)"
SOURCES = "s AS (SELECT user_id AS id, max(ts) AS last_crawled_at, arg_max(event_type, (ts, event_id)) AS kind, count(*) AS n FROM events GROUP BY 1)"
SQL = {
    "pk_lookup": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 5",
    "equality_scan": "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 3",
    "fetch_outcomes": "SELECT DISTINCT url, CASE WHEN contains(url, '#') THEN NULL ELSE upper(url) END AS html, CASE WHEN contains(url, '#') THEN NULL WHEN contains(url, '?') THEN 404 ELSE 200 END::INT AS http_status, CASE WHEN contains(url, '#') THEN 'down' END AS error, NOT contains(url, '#') AND NOT contains(url, '?') AS ok FROM pages",
    "crawl_run": f"""WITH d AS (SELECT DISTINCT source_id, url, pos FROM (SELECT {HOST} AS source_id, url, min(page_id) AS pos FROM pages GROUP BY 1, 2)), w AS (SELECT source_id, url FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY pos) AS n FROM d) WHERE n <= {rules.MOST_LINKS} AND length(source_id) % 5 <> 0 AND length(source_id) % 7 <> 0),
  o AS (SELECT source_id, CASE WHEN starts_with(regexp_replace(url, '^[a-zA-Z]+://[^/?#]*', ''), '/en/') THEN 'd' WHEN contains(url, '#') OR contains(url, '?') THEN 'f' ELSE 'k' END AS x FROM w)
  SELECT source_id, count(*) AS total, count(*) FILTER (WHERE x = 'k') AS fetched, count(*) FILTER (WHERE x = 'f') AS failed, count(*) FILTER (WHERE x = 'd') AS robots_denied, NULL::VARCHAR AS error FROM o GROUP BY 1""",
    "robots_gates": "SELECT unnest([true, false]) AS allowed, count(*) AS n FROM pages",
    "default_categories": "SELECT kind, ord, t.name, status FROM (VALUES " + ", ".join(f"({i}, '{x}', 'active')" for i, x in enumerate(rules.DEFAULT_CATEGORIES)) + ") t(ord, name, status), (SELECT 'blank' AS kind, count(*) FILTER (WHERE trim(lang) = '') AS n FROM documents UNION ALL SELECT 'some', count(*) FILTER (WHERE trim(lang) <> '') FROM documents) WHERE n = 0",
    "outbox_mails": "SELECT 'r' || item_id || '@example.org' AS to, text AS body FROM benchmark",
    "pages_to_parse": "SELECT page_id FROM pages WHERE page_id % 4 <> 1 AND page_id % 3 <> 0",
    "extraction_run": f"WITH {ARTICLES} SELECT id AS article_id, true AS ok, CASE WHEN trim(title) <> '' THEN 1 ELSE 0 END::BIGINT AS n_points, CASE WHEN trim(title) <> '' THEN left(trim(title), 300) END AS name, (least(length(content), 8000) // 4)::BIGINT AS tokens FROM a ORDER BY id LIMIT 200",
    "extraction_cache": f"""WITH {ARTICLES}, c AS (SELECT id, CASE WHEN id % 2 = 0 THEN 10 ELSE 0 END AS t, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS k, id % 4 <> 0 AND id % 3 = 0 AS ran FROM a)
  SELECT CASE WHEN ran AND id % 5 = 0 THEN 'failed' ELSE 'ok' END AS status, (k + ran::INT)::INT AS attempts, (t + 7 * ran::INT)::BIGINT AS tokens, count(*) AS n FROM c WHERE id % 2 = 0 OR ran GROUP BY 1, 2, 3 UNION ALL SELECT 'hits', 0, 0, count(*) FROM a WHERE id % 4 = 0""",
    "extraction_retries": "SELECT doc_id AS id FROM labels WHERE quality = 0 ORDER BY 1 LIMIT 50",
    "list_envelope": """SELECT '{"total":' || (SELECT count(*) FROM orders) || ',"page":2,"page_size":5,"items":[' || string_agg('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey DESC) || ']}' AS body FROM (SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 5 OFFSET 5)""",
    "created_page": "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 50",
    "valid_sources": "SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 0 THEN 'site_url' WHEN s_acctbal <= 0 THEN 'weight' WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 THEN 'focus' END AS reject FROM supplier",
    "created_sources": "SELECT s_suppkey AS id, s_name AS name, false AS conflict FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey + 1000, s_name, s_suppkey % 2 = 0 FROM supplier",
    "source_tiers": f"WITH {SOURCES} SELECT id, CASE WHEN n < 8 THEN 'blacklist' ELSE 'whitelist' END AS list_type, kind <> 'signup' AS is_active, CASE kind WHEN 'view' THEN 10800 WHEN 'click' THEN 604800 WHEN 'error' THEN n * 60 ELSE 86400 END::BIGINT AS seconds FROM s",
    "source_freshness": f"WITH {SOURCES} SELECT id, 's' || id AS name, last_crawled_at, NULL::TIMESTAMP AS last_success_at FROM s WHERE kind <> 'signup'",
    "category_changes": "SELECT r_regionkey AS id, CASE r_regionkey WHEN 1 THEN 'Renamed' ELSE r_name END AS name, CASE r_regionkey WHEN 2 THEN 'inactive' ELSE 'active' END AS status FROM region UNION ALL SELECT r_regionkey, CASE r_regionkey WHEN 1 THEN 'admin rename ' || r_name || ' Renamed' ELSE 'system deactivate ' || r_name END, 'history' FROM region WHERE r_regionkey IN (1, 2)",
    "settings_patch": f"""WITH {STORED}, o AS (SELECT * FROM (VALUES ('max_items_per_digest', '30', '10'), ('max_retries', '3', '3'), ('sends_paused', 'true', 'false')) t(key, new, base)),
  x AS (SELECT o.key, new, coalesce(e.value, base) AS old FROM o LEFT JOIN e USING (key)) SELECT key, old || '>' || new AS value, 'admin' AS kind FROM x WHERE old <> new UNION ALL SELECT key, new, 'now' FROM x WHERE old <> new UNION ALL SELECT key, value, 'now' FROM e WHERE key NOT IN (SELECT key FROM x WHERE old <> new)""",
    "wiki_entries": "SELECT n_nationkey::BIGINT AS entry_id, CASE n_nationkey WHEN 9 THEN 'New name' ELSE n_name END AS name, 'in ' || n_regionkey AS summary, CASE WHEN n_nationkey IN (2, 4) THEN 'merged' WHEN n_nationkey = 7 THEN 'retired' ELSE 'active' END AS status, CASE n_nationkey WHEN 9 THEN '9,1' ELSE n_nationkey::VARCHAR END AS articles, CASE WHEN n_nationkey IN (2, 4) THEN 100 END::BIGINT AS merged_into_id FROM nation UNION ALL SELECT 100, 'Both', (SELECT string_agg('in ' || n_regionkey, '；' ORDER BY n_nationkey DESC) FROM nation WHERE n_nationkey IN (2, 4)), 'active', '2,4', NULL UNION ALL SELECT 200, 'Fresh', '', 'active', NULL, NULL",
    "entry_links": "SELECT n_regionkey AS entry_id, n_nationkey AS article_id FROM nation UNION SELECT 0, n_nationkey FROM nation",
    "entries_by_name": "SELECT c_custkey AS point_id, n_nationkey AS entry_id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 0 AND n_nationkey % 6 <> 0",
    "nearest_by_text": f"WITH x AS (SELECT s_suppkey AS point_id, 'brand#' || s_nationkey AS a FROM supplier), y AS (SELECT p_partkey AS entry_id, lower(p_brand) AS b FROM (SELECT p_brand, min(p_partkey) AS p_partkey FROM part GROUP BY 1)), z AS (SELECT point_id, entry_id, {GRAMS.format('a')} AS g, {GRAMS.format('b')} AS h FROM x, y), q AS (SELECT point_id, entry_id, len(list_intersect(g, h)) / len(list_distinct(g || h))::DOUBLE AS s FROM z) SELECT point_id, entry_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY s DESC, entry_id) AS r FROM q WHERE s >= 0.1) WHERE r = 1",
    "held_for_push": f"WITH {ARTICLES}, b AS (SELECT status, CASE WHEN id % 3 = 0 THEN 'pending' ELSE knowledge_status END AS k FROM a) SELECT status = 'normal' AND coalesce(k NOT IN ('covered', 'pending'), true) AS pushable, status = 'normal' AND coalesce(k <> 'covered', true) AS visible, count(*) AS n FROM b GROUP BY 1, 2",
    "scalar_functions": "SELECT c_custkey, sha256(c_name) AS token_hash, c_name || chr(10) || chr(10) || c_mktsegment AS point, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE sha256(c_name || chr(10) || 'x') END AS fingerprint, c_custkey % 3 <> 1 AS flag, CASE WHEN c_custkey % 2 = 0 THEN strftime(make_timestamp(c_custkey * 86461 * 1000000), '%Y-%m-%d %H:%M') ELSE '" + rules.UNKNOWN_TIME + "' END AS label, 'https://x.org/confirm?token=' || c_name AS link, '10.0.0.' || c_nationkey AS ip, c_name || '|' || c_mktsegment AS cleaned, 'art_' || md5(c_name || chr(31) || c_nationkey) AS natural_id, lower(c_name) || ' strasse strasse ab1' AS folded FROM customer",
    "threshold_sanity": f"WITH x AS (SELECT coalesce(nullif(CASE WHEN l_returnflag <> 'R' THEN round(l_discount * 10, 2) END::DOUBLE, 0), {rules.COVERED_SIMILARITY}) AS hi, coalesce(nullif(round(l_tax * 10, 2)::DOUBLE, 0), {rules.NEW_SIMILARITY}) AS lo FROM lineitem) SELECT CASE WHEN lo > hi THEN {rules.NEW_SIMILARITY} ELSE lo END::DOUBLE AS low, CASE WHEN lo > hi THEN {rules.COVERED_SIMILARITY} ELSE hi END::DOUBLE AS high, count(*) AS n FROM x GROUP BY 1, 2",
    "usage_by_kind": f"WITH {ARTICLES} SELECT upper(c) AS name, count(id) AS n FROM (SELECT unnest(['de', 'en', 'es', 'fr', 'it']) AS c) LEFT JOIN (SELECT * FROM a WHERE status <> 'filtered' AND id NOT IN (SELECT id FROM (SELECT id, content, min(id) OVER (PARTITION BY content) AS f FROM a) WHERE f < id AND content IS NOT NULL)) ON category = c GROUP BY 1",
    "stream_page_upserts": "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2",
}
