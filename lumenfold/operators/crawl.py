"""Crawling as tables: due sources, robots rules, throttled schedules, link discovery, page upserts, reports."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html, rules, urls
from ..sources.store import fetch_politely, stored, upsert


def interval() -> Column:
    """Seconds between crawls of a source: its own if custom and positive, else its tier's, else the normal one."""
    tiers = F.create_map(*[F.lit(x) for pair in rules.INTERVALS.items() for x in pair])
    own = (F.col("update_frequency") == "custom") & (F.col("update_interval_seconds") > 0)
    return F.when(own, F.col("update_interval_seconds")).otherwise(F.coalesce(F.element_at(tiers, F.col("update_frequency")), F.lit(rules.INTERVALS["normal"])))


def due(sources: DataFrame, now: Column) -> DataFrame:
    waited = F.unix_timestamp(now) - F.unix_timestamp("last_crawled_at")
    return sources.where(F.col("is_active") & (F.col("list_type") != "blacklist") & (F.col("last_crawled_at").isNull() | (waited >= interval())))


def crawlable(sources: DataFrame) -> DataFrame:
    """Sources with the outcome of those that are not crawled: skipped."""
    return sources.withColumn("outcome", F.when(~F.col("is_active") | (F.col("list_type") == "blacklist"), "skipped"))


def robots_rules(files: DataFrame) -> DataFrame:
    """origin, grp, agent, line, allow, prefix: the rules of robots.txt files (origin, text), as the standard library reads
    them. A group's lines are told for each of its agents; the first group with `*` among them is for all others, its agent
    is `*` here. Groups without rules have none. A file that could not be had (null) makes no rules, so all is allowed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from urllib.robotparser import RobotFileParser

        for batch in batches:
            rows = []
            for origin, text in zip(batch["origin"], batch["text"], strict=True):
                parser = RobotFileParser()
                parser.parse((text or "").splitlines())
                groups = [(e.useragents, e.rulelines) for e in parser.entries] + ([(["*"], parser.default_entry.rulelines)] if parser.default_entry else [])
                for grp, (agents, lines) in enumerate(groups):
                    # A group without lines still hides the groups below it: it allows everything.
                    told = [(x.allowance, x.path) for x in lines] or [(True, "")]
                    rows += [(origin, grp, agent, n, allow, path) for agent in agents for n, (allow, path) in enumerate(told)]
            yield pd.DataFrame(rows, columns=["origin", "grp", "agent", "line", "allow", "prefix"])

    return files.select("origin", "text").mapInPandas(run, "origin string, grp int, agent string, line int, allow boolean, prefix string")


def rules_for(robots: DataFrame, agent: str) -> DataFrame:
    """The rules of the group that counts for an agent: the first with one of its names in the agent's, else that for all."""
    own = F.lit(agent.split("/")[0].lower())
    for_all = F.col("agent") == "*"
    fits = robots.where(for_all | F.contains(own, F.lower("agent")))
    group = fits.groupBy("origin").agg(F.coalesce(F.min(F.when(~for_all, F.col("grp"))), F.min("grp")).alias("grp"))
    return robots.join(group, ["origin", "grp"], "left_semi").select("origin", "line", "allow", "prefix").distinct()


def allowed_by_robots(pages: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """Pages with `allowed`: the first line of the agent's group that is a prefix of the page's path and query decides;
    a prefix `*` fits all; without such a line the page is allowed. robots: as robots_rules() makes it."""
    rows = pages.withColumns({"__origin": urls.origin(F.col("url")), "__path": urls.robots_target(F.col("url"))})
    own = rules_for(robots, agent).withColumnRenamed("origin", "__origin")
    targets = rows.select("__origin", "__path").distinct()
    hit = targets.join(own, "__origin").where("prefix = '*' or startswith(__path, prefix)").groupBy("__origin", "__path").agg(F.min_by("allow", "line").alias("__allow"))
    return rows.join(hit, ["__origin", "__path"], "left").withColumn("allowed", F.coalesce("__allow", F.lit(True))).select(*pages.columns, "allowed")


def gate(pages: DataFrame, allow: bool) -> DataFrame:
    """The constant policies: all pages are allowed, or none."""
    return pages.withColumn("allowed", F.lit(allow))


def schedule(pages: DataFrame, seconds: float, order: str = "position") -> DataFrame:
    """`not_before`: seconds from the start at which each page may be fetched, so that hits of one host keep their
    distance. A host's pages are ranked within it; hosts are independent."""
    host = Window.partitionBy(urls.authority(F.col("url"))).orderBy(order, "url")
    return pages.withColumn("not_before", (F.row_number().over(host) - 1) * F.lit(float(seconds)))


def first_seen(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The first row of each key in order of position; copies are cut before the shuffle by the aggregate."""
    rest = [c for c in df.columns if c not in (*keys, position)]
    return df.groupBy(*keys).agg(F.min(F.struct(position, *rest)).alias("m")).select(*keys, *[F.col(f"m.{c}").alias(c) for c in (position, *rest)])


def discover(pages: DataFrame, url: str = "url", page_html: str = "html", key: str = "page_id", same_domain: bool = True, limit: int = rules.MOST_LINKS, prefer_articles: bool = True, terminated: bool = False) -> DataFrame:
    """key, rank, link, score: the links of each page that look most like articles.

    Each link once, at its first place; of the first COLLECT_TIMES * limit of a page the best by score, then place.
    Without `prefer_articles` the first `limit` in order of place. terminated: see html.tree()."""
    rows = pages.select(key, F.col(url).alias("__base"), F.explode(html.page_links(F.col(page_html), F.col(url), terminated)).alias("x"))
    rows = rows.select(key, "__base", F.col("x.pos").alias("pos"), F.col("x.url").alias("link"), F.col("x.text").alias("anchor"))
    if same_domain:
        rows = rows.where(urls.authority(F.col("link")) == urls.authority(F.col("__base")))
    rows = first_seen(rows.where("link <> __base"), [key, "link"], "pos")
    place = Window.partitionBy(key).orderBy("pos")
    cap = limit * (rules.COLLECT_TIMES if prefer_articles else 1)
    rows = rows.withColumn("n", F.row_number().over(place)).where(F.col("n") <= cap).withColumn("score", urls.article_score(F.col("link"), F.col("anchor")))
    best = Window.partitionBy(key).orderBy(*([F.desc("score")] if prefer_articles else []), "n")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).select(key, "rank", "link", "score")


def by_host(pages: DataFrame, order: str) -> DataFrame:
    """host, ord, url: each URL once, at its first place, for fetch_politely()."""
    return pages.groupBy("url").agg(F.min(order).alias("ord")).select(urls.authority(F.col("url")).alias("host"), "ord", "url")


def index_links(sources: DataFrame, robots: DataFrame, fetch: Callable[[DataFrame], DataFrame], limit: int = rules.MOST_LINKS, agent: str = "*") -> tuple[DataFrame, DataFrame]:
    """(source_id, url, position of what the index pages link to; source_id, outcome, error of each index page). Sources that
    are not crawled are passed over; an index page that is denied, fails or breaks the parser has no links, and the other
    sources go on."""
    live = crawlable(sources).where("outcome is null").select(F.col("id").alias("source_id"), F.col("site_url").alias("url"))
    checked = allowed_by_robots(live, robots, agent)
    got = fetch(by_host(checked.where("allowed"), "source_id"))
    pages = stored(checked.join(got, "url", "left"), "index-pages")
    got_one = F.coalesce("ok", F.lit(False))
    broken = got_one & html.page_links(F.col("html"), F.col("url")).isNull()
    why = F.when(broken, rules.BROKEN_PAGE).when(F.col("allowed") & ~got_one, F.coalesce("error", F.concat(F.lit("HTTP "), "http_status"), F.lit(rules.NO_PAGE)))
    pages = stored(pages.withColumns({"ok": got_one & ~broken, "error": why}), "index-outcomes")
    outcome = F.when(~F.col("allowed"), "robots_denied").when(F.col("ok"), "fetched").otherwise("failed")
    links = discover(pages.where("allowed and ok"), key="source_id", limit=limit)
    return links.select("source_id", F.col("link").alias("url"), F.col("rank").alias("position")), pages.select("source_id", outcome.alias("outcome"), "error")


def crawl(
    sources: DataFrame, page_urls: DataFrame | None, robots: DataFrame, fetcher, stored_pages: DataFrame, now: Column, seconds: float = 1.0, most: int = rules.MOST_LINKS, agent: str = "*",  # noqa: ANN001
    clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep,
) -> tuple[DataFrame, DataFrame]:
    """(page snapshot, report by source). page_urls: source_id, url, position; without it, what the sources' index pages
    link to. Pages of skipped sources are not fetched; denied ones are recorded; failures never stop the run; at most
    `most` pages of a source. An index page counts in its source's report, and
    why it gave nothing is the report's `error`. Requests of one host are `seconds` apart, by one
    task, in the order of `schedule`; see fetch_politely() for the clock and the waiting."""
    fetch = lambda pages: fetch_politely(pages, fetcher, seconds, clock, sleep).drop("host", "at")
    index = None
    if page_urls is None:
        page_urls, index = index_links(sources, robots, fetch, most, agent)
    wanted = first_seen(page_urls.join(crawlable(sources).where("outcome is null").select(F.col("id").alias("source_id")), "source_id", "left_semi"), ["source_id", "url"], "position")
    nth = Window.partitionBy("source_id").orderBy("position")
    wanted = wanted.withColumn("n", F.row_number().over(nth)).where(F.col("n") <= most)
    checked = schedule(allowed_by_robots(wanted, robots, agent), seconds)
    got = fetch(by_host(checked.where("allowed"), "not_before"))
    rows = checked.join(got, "url", "left").select(
        "source_id", "url", F.when(F.col("ok"), F.col("html")).alias("raw_html"), "http_status", F.when(~F.col("allowed"), "robots_denied").when(F.col("ok"), "fetched").otherwise("failed").alias("status"), F.col("error").alias("error_message"), now.alias("fetched_at"),
    )
    outcomes = rows.select("source_id", F.col("status").alias("outcome"), F.lit(None).cast("string").alias("error"))
    outcomes = outcomes if index is None else outcomes.unionByName(index)
    report = outcomes.groupBy("source_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("outcome") == s).alias(s) for s in ("fetched", "failed", "robots_denied")], F.min("error").alias("error"))
    return upsert(stored_pages, rows, ["source_id", "url"], "fetched_at", "status"), report


def finalize(sources: DataFrame, report: DataFrame, now: Column) -> DataFrame:
    """last_crawled_at of every crawled source; last_success_at of those that fetched a page."""
    r = report.select(F.col("source_id").alias("id"), F.col("fetched").alias("__fetched"))
    out = sources.join(r, "id", "left")
    return out.withColumns({"last_crawled_at": F.when(F.col("__fetched").isNotNull(), now).otherwise(F.col("last_crawled_at")), "last_success_at": F.when(F.col("__fetched") > 0, now).otherwise(F.col("last_success_at"))}).drop("__fetched")


def fetched_pages(pages: DataFrame, parsed: DataFrame | None = None, source_id=None) -> DataFrame:  # noqa: ANN001
    """Pages to parse, oldest first; with `parsed` (url, fetched_at) those of it are passed over."""
    out = pages.where("status = 'fetched'")
    out = out if source_id is None else out.where(F.col("source_id") == source_id)
    out = out if parsed is None else out.join(parsed.select("url", "fetched_at"), ["url", "fetched_at"], "left_anti")
    return out.orderBy("fetched_at", "url")
