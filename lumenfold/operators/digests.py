"""Subscriptions and periodic digests, for all subscriptions in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from . import keywords
from .browse import pushable, without_hidden


def period_start(frequency: Column, now: Column) -> Column:
    return F.when(frequency == "daily", F.date_trunc("day", now)).otherwise(F.date_trunc("week", now))


def period_end(frequency: Column, now: Column) -> Column:
    return period_start(frequency, now) + F.when(frequency == "daily", F.expr("interval 1 day")).otherwise(F.expr("interval 7 days"))


def is_due(now: Column) -> Column:
    since = F.coalesce("last_sent_at", "confirmed_at", "created_at")
    return F.unix_timestamp(now) - F.unix_timestamp(since) >= F.when(F.col("frequency") == "daily", 86400).otherwise(7 * 86400)


def in_window(start: Column, end: Column, now: Column) -> Column:
    return (start == end) | ((F.hour(now) >= start) & (F.hour(now) < end))


def match_topics(articles: DataFrame, topics: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """subscription_id, article_id, reasons (in topic order). Three kinds of topic are equi-joins. Keyword topics are
    containment: one automaton of all distinct folded keywords runs over each folded text.

    articles: id, title, summary, category, tags, source_id; topics: subscription_id, ord, topic_type, topic_value."""
    t = topics.select("subscription_id", "ord", "topic_type", "topic_value")
    named = t.withColumn("reason", text.describe_topic(F.col("topic_type"), F.col("topic_value")))
    if sources is not None:
        s = sources.select(F.col("id").cast("string").alias("topic_value"), F.col("name").alias("source_name"))
        named = t.join(s, "topic_value", "left").withColumn("reason", text.describe_topic(F.col("topic_type"), F.col("topic_value"), F.col("source_name")))
    of = lambda kind: named.where(F.col("topic_type") == kind)
    pick = lambda df: df.select("subscription_id", F.col("id").alias("article_id"), "ord", "reason")
    a = pick(articles.select("id", F.col("category").alias("topic_value")).join(of("category"), "topic_value"))
    b = pick(articles.select("id", F.explode("tags").alias("topic_value")).distinct().join(of("tag"), "topic_value"))
    c = pick(articles.select("id", F.col("source_id").cast("string").alias("topic_value")).join(of("source"), "topic_value"))
    words = of("keyword").select("topic_value").distinct().withColumn("needle", text.fold_text(F.col("topic_value"))).where("needle <> ''")
    plain = articles.select("id", F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("summary", F.lit(""))).alias("haystack"))
    d = pick(keywords.containing(plain, words, text.folded).join(words, "needle").select("id", "topic_value").join(of("keyword"), "topic_value"))
    every = a.unionByName(b).unionByName(c).unionByName(d)
    return every.groupBy("subscription_id", "article_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "reason"))), lambda x: x["reason"]).alias("reasons"))


def collect_entries(subscriptions: DataFrame, topics: DataFrame, articles: DataFrame, hidden: DataFrame, digested: DataFrame, now: Column, sources: DataFrame | None = None) -> DataFrame:
    """subscription_id, article_id, position, reasons: what each subscription's digest of this period would hold.

    Articles crawled since the period's start, fit to push, matched by a topic, not digested before; newest first
    (no publication time counts as now), then by crawl time and id; at most max_items."""
    fit = without_hidden(articles.where(pushable()), hidden)
    matched = match_topics(fit, topics, sources)
    s = subscriptions.select(F.col("id").alias("subscription_id"), "frequency", "max_items")
    rows = matched.join(s, "subscription_id").join(fit.select(F.col("id").alias("article_id"), "published_at", "crawled_at"), "article_id")
    rows = rows.where(F.col("crawled_at") >= period_start(F.col("frequency"), now)).join(digested.select("subscription_id", "article_id"), ["subscription_id", "article_id"], "left_anti")
    w = Window.partitionBy("subscription_id").orderBy(F.coalesce("published_at", now).desc(), F.desc("crawled_at"), F.desc("article_id"))
    return rows.withColumn("position", F.row_number().over(w)).where("position <= max_items").select("subscription_id", "article_id", "position", "reasons")


def plan(subscriptions: DataFrame, digests: DataFrame, entries: DataFrame, now: Column, send_empty: bool, max_retries: int, manual: bool = False) -> DataFrame:
    """subscription_id, period_start, items, action: return (this period has one already), resend, none (not due), skip
    (nothing new) or create. A manual run ignores whether it is due, not what the period has."""
    s = subscriptions.where("status = 'confirmed'").withColumn("period_start", period_start(F.col("frequency"), now)).withColumn("due", F.lit(manual) | is_due(now))
    d = digests.select(F.col("subscription_id").alias("id"), "period_start", F.col("status").alias("old"), "retry_count")
    n = entries.groupBy(F.col("subscription_id").alias("id")).agg(F.count("*").alias("items"))
    rows = s.join(d, ["id", "period_start"], "left").join(n, "id", "left").withColumn("items", F.coalesce("items", F.lit(0)).cast("long"))
    action = F.when(F.col("old").isNotNull() & ((F.col("old") != "failed") | (F.col("retry_count") >= max_retries)), "return").when(F.col("old") == "failed", "resend").when(~F.col("due"), "none").when((F.col("items") == 0) & F.lit(not send_empty), "skip").otherwise("create")
    return rows.select(F.col("id").alias("subscription_id"), "period_start", "items", action.alias("action"))


def apply_outcomes(digests: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Digests after delivery: sent ones get their time; failed ones count a retry. outcomes: id, ok, error."""
    o = outcomes.select("id", F.col("ok").alias("__ok"), F.col("error").alias("__error"))
    rows, ok = digests.join(o, "id", "left"), F.col("__ok")
    return rows.withColumns({
        "status": F.when(ok, "sent").when(~ok, "failed").otherwise(F.col("status")), "sent_at": F.when(ok, now).otherwise(F.col("sent_at")),
        "retry_count": F.col("retry_count") + F.when(~ok, 1).otherwise(0), "error": F.when(ok.isNotNull(), F.col("__error")).otherwise(F.col("error")),
    }).drop("__ok", "__error")


def mark_sent(subscriptions: DataFrame, delivered: DataFrame, now: Column) -> DataFrame:
    d = delivered.where("ok").select(F.col("subscription_id").alias("id"), F.lit(True).alias("__sent")).distinct()
    return subscriptions.join(d, "id", "left").withColumn("last_sent_at", F.when(F.col("__sent"), now).otherwise(F.col("last_sent_at"))).drop("__sent")


def escaped(c: Column) -> Column:
    """Text for HTML."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&#34;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def render(
    entries: DataFrame, subscriptions: DataFrame, articles: DataFrame, now: Column, sources: DataFrame | None = None, topics: DataFrame | None = None, sizes: DataFrame | None = None, tokens: DataFrame | None = None, base_url: str = "", send_empty: bool = False
) -> DataFrame:
    """subscription_id, email, subject, html, text of each digest: the period, the number of items, and for each item, in
    their positions, title and link, source, time of publication, the topics it matched, how many other sources have it,
    and its summary; then the subscription's topics and the link to leave. HTML is escaped.

    sources: id, name; topics: subscription_id, ord, topic_type, topic_value; sizes: article_id, sources (of its duplicate
    group); tokens: subscription_id, token. With `send_empty` subscriptions without items get a mail that says so. A digest
    has at most max_items items, so collecting them is bounded."""
    a = articles.select(F.col("id").alias("article_id"), "title", "url", "summary", "published_at", "source_id")
    named = lambda df, *names: df if df is not None else entries.sparkSession.createDataFrame([], ", ".join(names))
    s = named(sources, "id string", "name string").select(F.col("id").cast("string").alias("source_id"), F.col("name").alias("source_name"))
    g = named(sizes, "article_id long", "sources long").groupBy("article_id").agg(F.max("sources").alias("sources"))
    rows = entries.join(a.withColumn("source_id", F.col("source_id").cast("string")), "article_id").join(s, "source_id", "left").join(g, "article_id", "left")
    source, when, matched = F.coalesce("source_name", F.lit(rules.UNKNOWN_SOURCE)), text.published_label(F.col("published_at")), F.array_join("reasons", rules.LIST_SEPARATOR)
    others = F.coalesce("sources", F.lit(1)).cast("int") - 1
    summary = F.when(F.coalesce("summary", F.lit("")) == "", rules.MAIL_NO_SUMMARY).otherwise(F.col("summary"))
    title, url, dot = F.coalesce("title", F.lit("")), F.coalesce("url", F.lit("")), F.lit(rules.MAIL_DOT)
    again = F.when(others > 0, F.format_string("另有 %d 个来源转载", others))
    html = F.concat(
        F.lit('<li><a href="'), escaped(url), F.lit('">'), escaped(title), F.lit("</a><p>"), escaped(source), dot, when, dot, F.lit("命中方向："), escaped(matched), F.coalesce(F.concat(dot, again), F.lit("")), F.lit("</p><p>"), escaped(summary), F.lit("</p></li>")
    )
    plain = F.concat(
        F.col("position").cast("string"), F.lit(". "), title, F.lit("\n   来源："), source, F.lit("　发布时间："), when, F.lit("\n   命中方向："), matched, F.lit("\n   摘要："), summary, F.lit("\n   原文："), url, F.coalesce(F.concat(F.lit("\n   （该内容"), again, F.lit("）")), F.lit(""))
    )
    items = rows.groupBy("subscription_id").agg(F.array_sort(F.collect_list(F.struct("position", html.alias("html"), plain.alias("text")))).alias("items"))
    t = named(topics, "subscription_id long", "ord int", "topic_type string", "topic_value string")
    shown = t.select("subscription_id", "ord", F.col("topic_type").alias("kind"), F.col("topic_value").alias("source_id")).join(s, "source_id", "left").select("subscription_id", "ord", text.describe_topic(F.col("kind"), F.col("source_id"), F.col("source_name")).alias("label"))
    shown = shown.groupBy("subscription_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "label"))), lambda x: x["label"]), rules.LIST_SEPARATOR).alias("topics"))
    links = named(tokens, "subscription_id long", "token string").select("subscription_id", text.link(F.lit(base_url), "/unsubscribe?token=", F.col("token")).alias("leave"))
    own = subscriptions.select(F.col("id").alias("subscription_id"), "email", "frequency")
    every = own.join(items, "subscription_id", "left" if send_empty else "inner").join(shown, "subscription_id", "left").join(links, "subscription_id", "left")
    n, start = F.coalesce(F.size("items"), F.lit(0)), period_start(F.col("frequency"), now)
    n = F.when(F.col("items").isNull(), 0).otherwise(n)
    label = F.element_at(F.create_map(*[F.lit(x) for pair in rules.FREQUENCY_LABELS.items() for x in pair]), F.col("frequency"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    period = F.concat(day(start), F.lit(" ~ "), day(period_end(F.col("frequency"), now) - F.expr("interval 1 day")), F.lit("（"), label, F.lit("）"))
    masked_, subject = text.mask_email(F.col("email")), F.when(n > 0, F.concat(F.lit("["), label, F.lit("摘要] "), F.date_format(start, "MM-dd"), F.lit(" 起 "), n.cast("string"), F.lit(" 篇新内容"))).otherwise(F.concat(F.lit("["), label, F.lit("摘要] 本周期无新内容")))
    topics_, leave = F.coalesce("topics", F.lit("")), F.coalesce("leave", F.lit(""))
    joined = lambda field, between: F.array_join(F.transform("items", lambda x: x[field]), between)
    page = F.concat(
        F.lit(f"<h1>{rules.MAIL_HEADING}</h1>\n<p>"), escaped(masked_), dot, period, dot, F.format_string("本期 %d 篇", n), F.lit("</p>\n"), F.when(n > 0, F.concat(F.lit("<ol>"), joined("html", ""), F.lit("</ol>"))).otherwise(f"<p>{rules.MAIL_NOTHING}</p>"),
        F.lit(f"\n<p>{rules.MAIL_WHY}"), escaped(topics_), F.lit('。<br><a href="'), escaped(leave), F.lit(f'">{rules.MAIL_LEAVE}</a>{rules.MAIL_DOT}{rules.MAIL_NOTE}</p>'),
    )
    body = F.concat(
        masked_, F.lit(f" 的{rules.MAIL_HEADING}（"), period, F.lit("）\n\n"), F.when(n > 0, F.concat(F.format_string("本期共 %d 篇与你的订阅方向相关的新内容：", n), F.lit("\n\n"), joined("text", "\n"))).otherwise(rules.MAIL_NOTHING),
        F.lit(f"\n\n——\n{rules.MAIL_WHY}"), topics_, F.lit(f"。\n{rules.MAIL_LEAVE_TEXT}"), leave, F.lit(f"\n{rules.MAIL_NOTE}"),
    )
    return every.select("subscription_id", "email", subject.alias("subject"), page.alias("html"), body.alias("text"))


def requests_of_hour(events: DataFrame, key: str, time: str = "created_at", seconds: int = 3600) -> DataFrame:
    """Every request with how many the same key made in the hour up to it (as one long frame within each key)."""
    w = Window.partitionBy(key).orderBy(F.unix_timestamp(time)).rangeBetween(-seconds, 0)
    return events.withColumn("requests", F.count("*").over(w))


def topic_signatures(topics: DataFrame) -> DataFrame:
    """subscription_id, signature: the set of topics, sorted."""
    return topics.groupBy("subscription_id").agg(F.array_sort(F.collect_set(F.struct("topic_type", "topic_value"))).alias("signature"))


def same_topics(topics: DataFrame, wanted: DataFrame) -> DataFrame:
    """Subscriptions whose set of topics equals a wanted one (wanted_id)."""
    w = topic_signatures(wanted.withColumnRenamed("wanted_id", "subscription_id")).withColumnRenamed("subscription_id", "wanted_id")
    return topic_signatures(topics).join(w, "signature").select("wanted_id", "subscription_id")


def valid_subscriptions(requests: DataFrame) -> DataFrame:
    """Requests with `reject`: what is wrong with each, null if nothing. requests: email, max_items, topics (structs)."""
    bad = F.when(text.normalize_email(F.col("email")).isNull(), "email").when(~F.col("max_items").between(1, 50), "max_items").when(~F.size("topics").between(1, 20), "topics")
    long_word = F.exists("topics", lambda t: (t["topic_type"] == "keyword") & ((F.length(F.trim(t["topic_value"])) > 50) | (F.trim(t["topic_value"]) == "")))
    kind = F.exists("topics", lambda t: ~t["topic_type"].isin(*rules.ENUMS["topic_type"]))
    return requests.withColumn("reject", bad.when(long_word, "keyword").when(kind, "topic_type"))


def subscription_state(events: DataFrame, now: Column) -> DataFrame:
    """Subscriptions as a fold of their events: id, status, confirmed_at. events: id, kind (create, confirm, unsubscribe,
    delete), at, expires_at. A confirmation after its token expired does not count (just then it does); deleted ones go."""
    ok = events.where("kind <> 'confirm' or expires_at is null or at <= expires_at")
    last = ok.groupBy("id").agg(F.max_by("kind", F.struct("at", "kind")).alias("kind"), F.max(F.when(F.col("kind") == "confirm", F.col("at"))).alias("confirmed_at"), F.min("at").alias("created_at"))
    status = F.when(F.col("kind") == "unsubscribe", "unsubscribed").when(F.col("kind") == "confirm", "confirmed").otherwise("pending_confirmation")
    return last.where("kind <> 'delete'").select("id", status.alias("status"), "confirmed_at", "created_at")


def by_token(subscriptions: DataFrame, requests: DataFrame, column: str) -> DataFrame:
    """Requests (token, ...) with the subscription whose `column` holds the token's hash, or with none; an empty token
    never has one."""
    own = subscriptions.select(F.col(column).alias("__hash"), F.struct(*subscriptions.columns).alias("subscription"))
    asked = requests.withColumn("__hash", F.when(F.col("token") != "", text.hash_token(F.col("token"))))
    return asked.join(own, "__hash", "left").drop("__hash")


def confirm(subscriptions: DataFrame, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(subscriptions, token and outcome of each request): confirmed (again: no change), expired, unsubscribed, invalid.
    subscriptions: id, email, status, confirm_token_hash, confirm_expires_at, confirmed_at, ..."""
    found, s = by_token(subscriptions, requests, "confirm_token_hash"), F.col("subscription")
    late = (s["status"] == "pending_confirmation") & s["confirm_expires_at"].isNotNull() & (s["confirm_expires_at"] < now)
    outcome = F.when(s.isNull(), "invalid").when(s["status"] == "unsubscribed", "unsubscribed").when(late, "expired").otherwise("confirmed")
    told = found.select("token", s["id"].alias("id"), outcome.alias("outcome"))
    done = told.where("outcome = 'confirmed'").select("id", F.lit(True).alias("__done")).distinct()
    fresh = F.col("__done").isNotNull() & (F.col("status") == "pending_confirmation")
    out = subscriptions.join(done, "id", "left").withColumns({"confirmed_at": F.when(fresh, now).otherwise(F.col("confirmed_at")), "status": F.when(fresh, "confirmed").otherwise(F.col("status"))})
    return out.select(*subscriptions.columns), told.select("token", "outcome")


def unsubscribe(subscriptions: DataFrame, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(subscriptions, token and how many subscriptions each request ended; 0 for an invalid token). requests: token, scope,
    where `self` ends the token's own subscription and `all` every one of its address; another scope is an error."""
    wrong = F.raise_error(F.concat(F.lit("scope is self or all, not "), F.coalesce("scope", F.lit("null"))))
    found = by_token(subscriptions, requests.withColumn("scope", F.when(F.col("scope").isin("self", "all"), F.col("scope")).otherwise(wrong)), "unsubscribe_token_hash")
    found = found.select("token", "scope", F.col("subscription.id").alias("own"), F.col("subscription.email").alias("email"))
    all_ = found.where("scope = 'all'").join(subscriptions.select("id", "email"), "email").select("token", "id")
    hit = found.where("scope = 'self' and own is not null").select("token", F.col("own").alias("id")).unionByName(all_)
    gone = hit.select("id", F.lit(True).alias("__gone")).distinct()
    out = subscriptions.join(gone, "id", "left").withColumns({"status": F.when(F.col("__gone"), "unsubscribed").otherwise(F.col("status")), "unsubscribed_at": F.when(F.col("__gone"), now).otherwise(F.col("unsubscribed_at"))})
    ended = hit.groupBy("token").agg(F.count("*").alias("ended"))
    return out.select(*subscriptions.columns), requests.select("token").join(ended, "token", "left").select("token", F.coalesce("ended", F.lit(0)).cast("long").alias("ended"))


def delete_by_token(subscriptions: DataFrame, topics: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(subscriptions, topics) without those whose token asks for it: personal data can be deleted."""
    gone = by_token(subscriptions, requests, "unsubscribe_token_hash").where("subscription is not null").select(F.col("subscription.id").alias("id")).distinct()
    return subscriptions.join(gone, "id", "left_anti"), topics.join(gone.select(F.col("id").alias("subscription_id")), "subscription_id", "left_anti")


def digest_detail(digests: DataFrame, items: DataFrame, articles: DataFrame, sources: DataFrame, digest_id) -> DataFrame:  # noqa: ANN001
    """The items of one digest in their positions: position, article_id, title, url, source_name, matched_topics; a deleted
    article leaves its place with nulls."""
    own = digests.where(F.col("id") == digest_id).select(F.col("id").alias("digest_id"))
    a = articles.select(F.col("id").alias("article_id"), "title", "url", "source_id")
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    rows = items.join(own, "digest_id", "left_semi").join(a, "article_id", "left").join(s, "source_id", "left")
    return rows.select("position", "article_id", "title", "url", F.coalesce("source_name", F.lit(rules.UNKNOWN_SOURCE)).alias("source_name"), "matched_topics").orderBy("position")


def masked(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.select("id", text.mask_email(F.col("email")).alias("email"), "status", "frequency", "created_at")
