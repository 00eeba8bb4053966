"""Queries of subscriptions, digests, rate limits, health, settings and knowledge states."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import browse, crawl, delivery, digests, insights, knowledge, state
from ..sources.store import natural_id
from .tables import ARTICLES, NOW, articles, now, table

STATUS = {"click": "sent", "purchase": "sent", "error": "failed", "view": "pending"}
KINDS = {"signup": "create", "click": "confirm", "view": "confirm", "purchase": "unsubscribe", "error": "delete"}


def mapping(names: dict[str, str], default: str | None = None):  # noqa: ANN201
    out = None
    for k, v in names.items():
        out = (F if out is None else out).when(F.col("event_type") == k, v)
    return out if default is None else out.otherwise(default)


def logged(spark, sf_dir):  # noqa: ANN001, ANN201
    """Events with a proper timestamp."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def delivered(spark, sf_dir):  # noqa: ANN001, ANN201
    """Events as digests."""
    return logged(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("user_id").alias("subscription_id"), F.col("ts").alias("created_at"), mapping(STATUS, "skipped_empty").alias("status"))


def period_bucket_daily(spark, sf_dir):  # noqa: ANN001, ANN201
    e = logged(spark, sf_dir)
    return e.groupBy(digests.period_start(F.lit("daily"), F.col("ts")).alias("start"), digests.period_end(F.lit("daily"), F.col("ts")).alias("end")).agg(F.count("*").alias("n"))


def period_bucket_weekly(spark, sf_dir):  # noqa: ANN001, ANN201
    e = logged(spark, sf_dir)
    return e.groupBy(digests.period_start(F.lit("weekly"), F.col("ts")).alias("start"), digests.period_end(F.lit("weekly"), F.col("ts")).alias("end")).agg(F.count("*").alias("n"))


def topics(spark, sf_dir):  # noqa: ANN001, ANN201
    """A subscription for each benchmark item: the second word as keyword, a language, a source and a tag."""
    b = table(spark, sf_dir, "benchmark")
    t = lambda ord_, kind, value: F.struct(F.lit(ord_).alias("ord"), F.lit(kind).alias("topic_type"), value.alias("topic_value"))
    word = F.element_at(F.split("text", " "), 2)
    lang = F.when(F.col("text").contains("ñ"), "es").when(F.col("text").contains("é"), "fr")
    source = F.concat(F.lit("src"), F.length("text"))
    return b.select(F.col("item_id").alias("subscription_id"), F.explode(F.array(t(0, "keyword", word), t(1, "category", lang), t(2, "source", source), t(3, "tag", lang))).alias("t")).select("subscription_id", "t.*").where("topic_value is not null")


def topic_match_reasons(spark, sf_dir):  # noqa: ANN001, ANN201
    a = articles(spark, sf_dir, whole=False)
    return digests.match_topics(a, topics(spark, sf_dir)).select("subscription_id", "article_id", F.array_join("reasons", ";").alias("reasons"))


def subscriptions(spark, sf_dir):  # noqa: ANN001, ANN201
    b = table(spark, sf_dir, "benchmark")
    return b.select(
        F.col("item_id").alias("id"), F.lit("daily").alias("frequency"), F.lit(5).alias("max_items"), F.when(F.length("text") > 120, "confirmed").otherwise("unsubscribed").alias("status"), F.lit(None).cast("timestamp").alias("last_sent_at"),
        F.when(F.length("text") > 200, F.lit("2024-01-30 12:00:00")).otherwise(F.lit("2023-12-30 00:00:00")).cast("timestamp").alias("confirmed_at"), F.lit("2023-12-01 00:00:00").cast("timestamp").alias("created_at"), F.concat(F.lit("reader"), "item_id", F.lit("@example.org")).alias("email"),
    )


def entries(spark, sf_dir):  # noqa: ANN001, ANN201
    a = articles(spark, sf_dir)
    digested = a.where("n_chars > 2000").select(F.lit(3).cast("long").alias("subscription_id"), F.col("id").alias("article_id"))
    hidden = a.where("n_chars % 5 = 0").select(F.col("id").alias("article_id"))
    return digests.collect_entries(subscriptions(spark, sf_dir), topics(spark, sf_dir), a, hidden, digested, NOON())


def NOON():  # noqa: ANN201, N802
    return F.lit("2024-01-01 12:00:00").cast("timestamp")


def digest_entries(spark, sf_dir):  # noqa: ANN001, ANN201
    return entries(spark, sf_dir).select("subscription_id", "article_id", F.col("position").cast("long").alias("position"))


def digest_plan(spark, sf_dir):  # noqa: ANN001, ANN201
    """Actions at NOW, when no article is new; every item of 200 characters or so has a failed digest already."""
    s = subscriptions(spark, sf_dir)
    old = table(spark, sf_dir, "benchmark").where(F.length("text") > 180).select(F.col("item_id").alias("subscription_id"), F.lit(NOW).cast("timestamp").alias("period_start"), F.when(F.length("text") > 250, "sent").otherwise("failed").alias("status"), F.when(F.length("text") > 220, 3).otherwise(1).alias("retry_count"))
    none = s.limit(0).select(F.col("id").alias("subscription_id"))
    return digests.plan(s, old, none, now(), False, 3).select("subscription_id", "action")


def digest_actions(spark, sf_dir):  # noqa: ANN001, ANN201
    """Actions at noon of the first day, with what each digest would hold."""
    s = subscriptions(spark, sf_dir)
    old = table(spark, sf_dir, "benchmark").where("item_id % 7 = 0").select(F.col("item_id").alias("subscription_id"), F.lit("2024-01-01").cast("timestamp").alias("period_start"), F.when(F.col("item_id") % 2 == 0, "sent").otherwise("failed").alias("status"), F.lit(1).alias("retry_count"))
    return digests.plan(s, old, entries(spark, sf_dir), NOON(), False, 3).select("subscription_id", "items", "action")


def rendered_digests(spark, sf_dir):  # noqa: ANN001, ANN201
    """The mails of noon of the first day, empty ones too."""
    a = articles(spark, sf_dir)
    sources = a.select(F.col("source_id").alias("id"), F.concat(F.lit("Site <"), "source_id", F.lit(">")).alias("name")).distinct().where("id <> 'src1'")
    sizes = a.select(F.col("id").alias("article_id"), (F.col("n_chars") % 3).alias("sources"))
    s = subscriptions(spark, sf_dir)
    tokens = s.select(F.col("id").alias("subscription_id"), F.concat(F.lit("t"), "id").alias("token"))
    return digests.render(entries(spark, sf_dir), s, a, NOON(), sources, topics(spark, sf_dir), sizes, tokens, "https://site.example/", send_empty=True)


def tokens(spark, sf_dir):  # noqa: ANN001, ANN201
    """Subscriptions with the hashes of their tokens; addresses are shared by four."""
    b = table(spark, sf_dir, "benchmark")
    id_ = F.col("item_id")
    status = F.when(id_ % 3 == 0, "pending_confirmation").when(id_ % 3 == 1, "confirmed").otherwise("unsubscribed")
    none = F.lit(None).cast("timestamp")
    return b.select(
        id_.alias("id"), F.concat(F.lit("r"), F.floor(id_ / 4), F.lit("@example.org")).alias("email"), status.alias("status"), text.hash_token(F.concat(F.lit("c"), id_)).alias("confirm_token_hash"), text.hash_token(F.concat(F.lit("u"), id_)).alias("unsubscribe_token_hash"),
        F.when(id_ % 2 == 0, F.lit("2024-01-01")).otherwise(F.lit("2024-02-01")).cast("timestamp").alias("confirm_expires_at"), none.alias("confirmed_at"), none.alias("unsubscribed_at"),
    )


def confirmations(spark, sf_dir):  # noqa: ANN001, ANN201
    """Outcomes of all tokens and a wrong one, beside the states they leave."""
    s = tokens(spark, sf_dir)
    asked = s.select(F.concat(F.lit("c"), "id").alias("token")).unionByName(spark.createDataFrame([("wrong",), ("",)], "token string"))
    out, told = digests.confirm(s, asked, now())
    return told.select("token", F.col("outcome").alias("state")).unionByName(out.select(F.concat(F.lit("after "), "id").alias("token"), F.concat_ws(" ", "status", F.col("confirmed_at").cast("string")).alias("state")))


def unsubscriptions(spark, sf_dir):  # noqa: ANN001, ANN201
    """How many subscriptions each request ended, beside the states they leave."""
    s = tokens(spark, sf_dir)
    asked = s.where("id % 5 = 0").select(F.concat(F.lit("u"), "id").alias("token"), F.when(F.col("id") % 2 == 0, "all").otherwise("self").alias("scope")).unionByName(spark.createDataFrame([("wrong", "all")], "token string, scope string"))
    out, told = digests.unsubscribe(s, asked, now())
    return told.select("token", F.col("ended").cast("string").alias("state")).unionByName(out.select(F.concat(F.lit("after "), "id").alias("token"), F.concat_ws(" ", "status", F.col("unsubscribed_at").cast("string")).alias("state")))


def deleted_subscriptions(spark, sf_dir):  # noqa: ANN001, ANN201
    s = tokens(spark, sf_dir)
    kept, own = digests.delete_by_token(s, topics(spark, sf_dir), s.where("id % 3 = 0").select(F.concat(F.lit("u"), "id").alias("token")))
    return kept.select("id").join(own.groupBy(F.col("subscription_id").alias("id")).agg(F.count("*").alias("topics")), "id", "full")


def mail_log(spark, sf_dir):  # noqa: ANN001, ANN201
    """Clicks, errors and purchases as tries to deliver the user's digest of the day; purchases are taken."""
    e = logged(spark, sf_dir).where("event_type in ('click', 'error', 'purchase')")
    e = e.withColumn("digest_id", F.col("user_id").cast("long") * 1000 + F.dayofyear("ts")).withColumn("attempt", F.row_number().over(Window.partitionBy("digest_id").orderBy("ts", "event_id")))
    mail_id, ok = natural_id("mail", F.col("digest_id").cast("string"), F.col("attempt").cast("string")), F.col("event_type") == "purchase"
    return e.select(mail_id.alias("mail_id"), "digest_id", F.col("user_id").cast("long").alias("subscription_id"), "attempt", text.hash_token(delivery.token(F.lit("s"), mail_id)).alias("token_hash"), ok.alias("ok"), F.when(~ok, F.col("event_type")).alias("error"), F.col("ts").alias("at"))


def mail_digests(spark, sf_dir):  # noqa: ANN001, ANN201
    """A digest for each user and day; every fifth user's were empty."""
    e = logged(spark, sf_dir).select(F.col("user_id").cast("long").alias("subscription_id"), F.dayofyear("ts").alias("day")).distinct()
    none = lambda kind: F.lit(None).cast(kind)
    return e.select((F.col("subscription_id") * 1000 + F.col("day")).alias("id"), "subscription_id", F.when(F.col("subscription_id") % 5 == 0, "skipped_empty").otherwise("pending").alias("status"), none("timestamp").alias("sent_at"), F.lit(0).cast("long").alias("retry_count"), none("string").alias("error"))


def due_mails(spark, sf_dir):  # noqa: ANN001, ANN201
    """What is to be sent, given all tries so far and at most three."""
    return delivery.due_mails(mail_digests(spark, sf_dir), mail_log(spark, sf_dir), 3, "s")


def settled_digests(spark, sf_dir):  # noqa: ANN001, ANN201
    """All digests as the log leaves them."""
    return delivery.settled_digests(mail_digests(spark, sf_dir), mail_log(spark, sf_dir))


def rotated_tokens(spark, sf_dir):  # noqa: ANN001, ANN201
    """Each user's last mail and the token that counts."""
    s = logged(spark, sf_dir).select(F.col("user_id").cast("long").alias("id")).distinct().withColumns({"unsubscribe_token_hash": F.lit("first"), "last_sent_at": F.lit(None).cast("timestamp")})
    return delivery.settled_subscriptions(s, mail_log(spark, sf_dir))


def send_windows(spark, sf_dir):  # noqa: ANN001, ANN201
    e = logged(spark, sf_dir)
    open_ = digests.in_window(F.lit(9), F.lit(21), F.col("ts"))
    always = digests.in_window(F.lit(5), F.lit(5), F.col("ts"))
    return e.groupBy(open_.alias("open"), always.alias("always")).agg(F.count("*").alias("n"))


def delivery_outcomes(spark, sf_dir):  # noqa: ANN001, ANN201
    """Digests after a delivery that reached some of them."""
    d = delivered(spark, sf_dir).withColumns({"sent_at": F.lit(None).cast("timestamp"), "retry_count": F.lit(1), "error": F.lit("old")})
    o = d.where("id % 3 <> 0").select("id", (F.col("id") % 3 == 1).alias("ok"), F.when(F.col("id") % 3 == 2, "refused").alias("error"))
    return digests.apply_outcomes(d, o, now()).groupBy("status", "retry_count", "error", F.col("sent_at").isNotNull().alias("sent_now")).agg(F.count("*").alias("n"))


def sent_marks(spark, sf_dir):  # noqa: ANN001, ANN201
    s = subscriptions(spark, sf_dir)
    d = s.where("id % 2 = 0").select(F.col("id").alias("subscription_id"), (F.col("id") % 4 == 0).alias("ok"))
    return digests.mark_sent(s, d, now()).select("id", "last_sent_at")


def digest_detail(spark, sf_dir):  # noqa: ANN001, ANN201
    """What the digest of noon of subscription 3 holds, one of its articles deleted since."""
    a = articles(spark, sf_dir)
    items = entries(spark, sf_dir).select(F.col("subscription_id").alias("digest_id"), "article_id", "position", F.array_join("reasons", ";").alias("matched_topics"))
    d = subscriptions(spark, sf_dir).select("id")
    sources = a.select(F.col("source_id").alias("id"), F.upper("source_id").alias("name")).distinct().where("id <> 'src1'")
    out = digests.digest_detail(d, items, a.where("id % 2 = 0"), sources, 3)
    return out.select(F.col("position").cast("long").alias("position"), "article_id", "url", "source_name", "matched_topics")


def valid_requests(spark, sf_dir):  # noqa: ANN001, ANN201
    """What is wrong with subscription requests made of customers."""
    key = F.col("c_custkey")
    email = F.when(key % 7 == 0, "nobody at home").otherwise(F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@x.org")))
    topic = F.struct(F.when(key % 5 == 0, "mood").otherwise("keyword").alias("topic_type"), F.repeat(F.lit("x"), (key % 55).cast("int")).alias("topic_value"))
    r = table(spark, sf_dir, "customer").select("c_custkey", email.alias("email"), (key % 60).alias("max_items"), F.array_repeat(topic, (key % 23).cast("int")).alias("topics"))
    return digests.valid_subscriptions(r).select("c_custkey", "reject")


def knowledge_run(spark, sf_dir):  # noqa: ANN001, ANN201
    """A run over the candidates: points are their titles, entries the titles of labelled articles, vectors tell titles
    by their first letters. Articles with a short title have no points; extraction failed for some."""
    a = articles(spark, sf_dir)
    point = F.struct(F.col("title").alias("name"), F.lit("").alias("summary"), F.array().cast("array<string>").alias("claims"))
    x = a.select(F.col("id").alias("article_id"), (F.col("id") % 11 != 0).alias("ok"), F.when(F.col("id") % 11 == 0, "slow").alias("error"), F.when(F.length("title") > 8, F.array(point)).otherwise(F.array().cast(f"array<{point_type()}>")).alias("points"))
    vector = F.array(*[F.ascii(F.substring("name", k, 1)).cast("double") for k in (1, 2, 3)])
    e = a.where("weight = 1").select(F.col("id").alias("entry_id"), F.col("title").alias("name"), F.lit("").alias("summary"), F.lit("active").alias("status"), F.array(F.col("id")).alias("article_ids"), F.lit(None).cast("long").alias("merged_into_id"))
    e = e.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    decided, _, _ = knowledge.judge_run(a.withColumn("knowledge_status", F.lit(None).cast("string")).where("status = 'normal'"), x, e, vector, 0.99, 0.999, now(), limit=40)
    return decided.groupBy("decision").agg(F.count("*").alias("n"))


def point_type() -> str:
    return "struct<name:string,summary:string,claims:array<string>>"




def digest_topn_per_user(spark, sf_dir):  # noqa: ANN001, ANN201
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return logged(spark, sf_dir).withColumn("position", F.row_number().over(w).cast("long")).where("position <= 5").select("user_id", "event_id", "position")


def digest_unsent(spark, sf_dir):  # noqa: ANN001, ANN201
    """Views of users who had bought nothing by the fifth of the month."""
    e = logged(spark, sf_dir)
    sent = e.where("event_type = 'purchase' and ts < timestamp '2024-01-05'").select("user_id").distinct()
    return e.where("event_type = 'view'").join(sent, "user_id", "left_anti").select("event_id", "user_id")


def rate_limit_hour(spark, sf_dir):  # noqa: ANN001, ANN201
    return digests.requests_of_hour(logged(spark, sf_dir), "user_id", "ts").select("event_id", "requests")


def usage_today(spark, sf_dir):  # noqa: ANN001, ANN201
    e = logged(spark, sf_dir).select(F.col("ts").alias("created_at"), mapping({"error": "failed"}, "ok").alias("status"), F.floor("value").alias("prompt_tokens"), F.lit(None).cast("long").alias("completion_tokens"))
    return insights.usage_of_day(e, F.lit("2024-01-15 18:00:00").cast("timestamp"))


def delivery_health(spark, sf_dir):  # noqa: ANN001, ANN201
    return insights.delivery_health(delivered(spark, sf_dir), 0.05).withColumn("failure_rate", F.round("failure_rate", 6))


def backlog_zero_filled(spark, sf_dir):  # noqa: ANN001, ANN201
    return insights.backlog(delivered(spark, sf_dir).where("status <> 'pending'"))


def run_report(spark, sf_dir):  # noqa: ANN001, ANN201
    return insights.report(delivered(spark, sf_dir), "status", rules.DIGEST_STATUSES)


def source_rows(spark, sf_dir):  # noqa: ANN001, ANN201
    last = logged(spark, sf_dir).groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("last_crawled_at"), F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"), F.count("*").alias("n"))
    frequency = F.when(F.col("kind") == "view", "high").when(F.col("kind") == "click", "low").when(F.col("kind") == "error", "custom").otherwise("normal")
    return last.select("id", "last_crawled_at", F.lit(None).cast("timestamp").alias("last_success_at"), frequency.alias("update_frequency"), (F.col("n") * 60).alias("update_interval_seconds"), (F.col("kind") != "signup").alias("is_active"), F.when(F.col("n") < 8, "blacklist").otherwise("whitelist").alias("list_type"))


def due_sources(spark, sf_dir):  # noqa: ANN001, ANN201
    return crawl.due(source_rows(spark, sf_dir), now()).select("id")


def interval_map(spark, sf_dir):  # noqa: ANN001, ANN201
    return source_rows(spark, sf_dir).select("id", crawl.interval().cast("long").alias("seconds"))


def crawl_finalize(spark, sf_dir):  # noqa: ANN001, ANN201
    """Sources after a run that reached those that log often."""
    s = source_rows(spark, sf_dir)
    report = s.where("update_interval_seconds > 600").select(F.col("id").alias("source_id"), F.when(F.col("is_active"), 2).otherwise(0).alias("fetched"))
    out = crawl.finalize(s, report, now())
    return out.select("id", "last_crawled_at", "last_success_at")


def history(spark, sf_dir):  # noqa: ANN001, ANN201
    return logged(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("event_type").alias("key"), F.round("value", 2).cast("string").alias("new_value"), F.col("ts").alias("created_at"))


def settings_history_lag(spark, sf_dir):  # noqa: ANN001, ANN201
    return state.with_old_values(history(spark, sf_dir)).select("id", "old_value")


def settings_current(spark, sf_dir):  # noqa: ANN001, ANN201
    return state.current_settings(history(spark, sf_dir)).select("key", F.round(state.parsed_threshold(F.col("value")), 2).alias("value"))


def settings_rollback(spark, sf_dir):  # noqa: ANN001, ANN201
    """What taking the last change of the log back would write."""
    h = state.with_old_values(history(spark, sf_dir))
    last = h.agg(F.max("id")).first()[0]
    return state.rollback(h, last, "admin", now()).select("key", F.col("old_value").cast("double").alias("old_value"), F.col("new_value").cast("double").alias("new_value"), "actor")


#: Which setting an event type's last value stands for.
STORED_SETTINGS = {"click": "max_items_per_digest", "error": "max_retries", "purchase": "bounce_pause_threshold", "signup": "unknown"}


def stored_settings(spark, sf_dir):  # noqa: ANN001, ANN201
    """key, value: whole numbers below 50 (a threshold: hundredths) from the last value of each event type."""
    last = state.current_settings(history(spark, sf_dir).withColumn("new_value", (F.floor(F.col("new_value").cast("double")) % 50).cast("long")))
    key = F.element_at(F.create_map(*[F.lit(x) for pair in STORED_SETTINGS.items() for x in pair]), F.col("key"))
    value = F.when(F.col("key") == "purchase", (F.col("value") / 100).cast("string")).otherwise(F.col("value").cast("string"))
    return last.select(key.alias("key"), value.alias("value")).where("key is not null")


def settings_overlay(spark, sf_dir):  # noqa: ANN001, ANN201
    """Effective settings, when the log's last values are stored under the names of some; one name is no setting."""
    base = spark.createDataFrame(list(rules.SETTING_DEFAULTS.items()), "key string, value string")
    return state.overlay(base, stored_settings(spark, sf_dir))


def knowledge_stats(spark, sf_dir):  # noqa: ANN001, ANN201
    c = spark.createDataFrame([("en", "English"), ("fr", "French")], "id string, name string")
    return insights.knowledge_stats(articles(spark, sf_dir), c)


def push_blocked(spark, sf_dir):  # noqa: ANN001, ANN201
    return browse.push_blocked(articles(spark, sf_dir))


def knowledge_candidates(spark, sf_dir):  # noqa: ANN001, ANN201
    return knowledge.candidates(articles(spark, sf_dir), 50).select("id")


def decisions(spark, sf_dir):  # noqa: ANN001, ANN201
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "covered").when(F.length("text") > 200, "partial").otherwise("new_knowledge")
    return c.select((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), F.col("conv_id").alias("article_id"), kind.alias("decision"), F.col("role").alias("actor"), F.timestamp_seconds(F.col("turn")).alias("created_at"))


def latest_decision_per_article(spark, sf_dir):  # noqa: ANN001, ANN201
    return knowledge.latest_decisions(decisions(spark, sf_dir)).select("article_id", "id", "decision")


def decided_articles(spark, sf_dir):  # noqa: ANN001, ANN201
    out = knowledge.apply_decisions(articles(spark, sf_dir), knowledge.latest_decisions(decisions(spark, sf_dir)))
    return out.groupBy("status", "knowledge_status").agg(F.count("*").alias("n"))


def subscription_states(spark, sf_dir):  # noqa: ANN001, ANN201
    e = logged(spark, sf_dir).select(F.col("user_id").alias("id"), mapping(KINDS).alias("kind"), F.col("ts").alias("at"), F.lit("2024-01-25 00:00:00").cast("timestamp").alias("expires_at"))
    return digests.subscription_state(e, now()).select("id", "status", "confirmed_at")


def equal_topic_sets(spark, sf_dir):  # noqa: ANN001, ANN201
    """Users with the very same set of event types in the first two days."""
    e = logged(spark, sf_dir).where("ts < timestamp '2024-01-03'")
    t = e.select(F.col("user_id").alias("subscription_id"), F.lit("tag").alias("topic_type"), F.col("event_type").alias("topic_value"))
    w = spark.createDataFrame([(1, "tag", "view"), (2, "tag", "view"), (2, "tag", "click")], "wanted_id int, topic_type string, topic_value string")
    return digests.same_topics(t, w)


def typed_points(spark, sf_dir):  # noqa: ANN001, ANN201
    """Model replies made of conversations: a nameless point is dropped, a broken reply has none."""
    c = table(spark, sf_dir, "conversations")
    ok = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit(" "), F.col("role")).alias("name")), F.struct(F.lit("").alias("name"))).alias("points")))
    reply = F.when(F.col("turn") == 1, F.lit("{broken")).otherwise(ok)
    return c.select("conv_id", "turn", knowledge.typed_points(reply).alias("p")).select("conv_id", "turn", F.col("p")[0]["name"].alias("name"), F.coalesce(F.size("p"), F.lit(-1)).cast("long").alias("n"))


def masked_subscriptions(spark, sf_dir):  # noqa: ANN001, ANN201
    return digests.masked(subscriptions(spark, sf_dir)).select("id", "email", "status")


def topic_labels(spark, sf_dir):  # noqa: ANN001, ANN201
    return topics(spark, sf_dir).select("subscription_id", "ord", text.describe_topic(F.col("topic_type"), F.col("topic_value")).alias("label"))


QUERIES = {f.__name__: f for f in (
    period_bucket_daily, period_bucket_weekly, topic_match_reasons, digest_entries, digest_plan, rendered_digests, digest_topn_per_user, digest_unsent, rate_limit_hour, usage_today, delivery_health, backlog_zero_filled, run_report, due_sources,
    interval_map, crawl_finalize, settings_history_lag, settings_current, settings_rollback, settings_overlay, knowledge_stats, push_blocked, knowledge_candidates, latest_decision_per_article, decided_articles, subscription_states,
    due_mails, settled_digests, rotated_tokens, equal_topic_sets, typed_points, masked_subscriptions, topic_labels, digest_actions, confirmations, unsubscriptions, deleted_subscriptions, send_windows, delivery_outcomes, sent_marks, digest_detail, valid_requests, knowledge_run,
)}
TOPIC = """t AS (SELECT item_id AS subscription_id, unnest([{'o': 0, 'k': 'keyword', 'v': string_split(text, ' ')[2]}, {'o': 1, 'k': 'category', 'v': CASE WHEN contains(text, 'ñ') THEN 'es' WHEN contains(text, 'é') THEN 'fr' END},
  {'o': 2, 'k': 'source', 'v': 'src' || length(text)}, {'o': 3, 'k': 'tag', 'v': CASE WHEN contains(text, 'ñ') THEN 'es' WHEN contains(text, 'é') THEN 'fr' END}]) AS s FROM benchmark),
u AS (SELECT subscription_id, s.o AS o, s.k AS k, s.v AS v, CASE s.k WHEN 'keyword' THEN '关键词：' WHEN 'category' THEN '类别：' WHEN 'source' THEN '来源：' ELSE '标签：' END || s.v AS reason FROM t WHERE s.v IS NOT NULL)"""
FOLD = "replace(lower({}), 'ß', 'ss')"
MATCH = f"""{ARTICLES}, {TOPIC}, m AS (SELECT u.subscription_id, a.id AS article_id, o, reason FROM u JOIN a ON (k = 'category' AND v = category) OR (k = 'source' AND v = source_id) OR (k = 'tag' AND v IN (category, source_id)) OR (k = 'keyword' AND v <> '' AND contains({FOLD.format("title || chr(10) || summary")}, {FOLD.format('v')})))"""
STATUS_SQL = "CASE event_type WHEN 'click' THEN 'sent' WHEN 'purchase' THEN 'sent' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'pending' ELSE 'skipped_empty' END"
SOURCES = "s AS (SELECT user_id AS id, max(ts) AS last_crawled_at, arg_max(event_type, (ts, event_id)) AS kind, count(*) AS n FROM events GROUP BY 1), i AS (SELECT *, CASE kind WHEN 'view' THEN 10800 WHEN 'click' THEN 604800 WHEN 'error' THEN n * 60 ELSE 86400 END::BIGINT AS seconds FROM s)"
HISTORY = "h AS (SELECT event_id AS id, event_type AS key, round(value, 2) AS new_value, ts, lag(round(value, 2)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS old_value FROM events)"
STORED = f"""{HISTORY}, v AS (SELECT key AS k, arg_max(floor(new_value)::BIGINT % 50, (ts, id)) AS x FROM h GROUP BY 1),
e AS (SELECT CASE k {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in STORED_SETTINGS.items())} END AS key, CASE WHEN k = 'purchase' THEN (x / 100)::DOUBLE::VARCHAR ELSE x::VARCHAR END AS value FROM v WHERE k IN ({', '.join(f"'{a}'" for a in STORED_SETTINGS)}))"""
DECISIONS = "d AS (SELECT conv_id AS article_id, arg_max(conv_id * 100000 + turn, turn) AS id, arg_max(CASE WHEN role = 'user' THEN 'covered' WHEN length(text) > 200 THEN 'partial' ELSE 'new_knowledge' END, turn) AS decision FROM conversations GROUP BY 1)"
TOKENS = "k AS (SELECT item_id AS id, item_id // 4 AS e, CASE item_id % 3 WHEN 0 THEN 'pending_confirmation' WHEN 1 THEN 'confirmed' ELSE 'unsubscribed' END AS status, item_id % 2 = 0 AS late FROM benchmark)"


def ESC(c: str) -> str:  # noqa: N802
    return f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(39), '&#39;'), chr(34), '&#34;')"


ENTRIES = "n AS (SELECT subscription_id, article_id, position FROM (SELECT subscription_id, article_id, row_number() OVER (PARTITION BY subscription_id ORDER BY coalesce(published_at, TIMESTAMP '2024-01-01 12:00:00') DESC, crawled_at DESC, article_id DESC) AS position FROM (SELECT DISTINCT subscription_id, article_id FROM m) JOIN a ON a.id = article_id WHERE status NOT IN ('filtered', 'error', 'knowledge_duplicate') AND (knowledge_status IS NULL OR knowledge_status NOT IN ('covered', 'pending')) AND crawled_at >= TIMESTAMP '2024-01-01' AND n_chars % 5 <> 0 AND NOT (subscription_id = 3 AND n_chars > 2000)) WHERE position <= 5)"
MAIL_ID = "'mail_' || md5(digest_id || chr(31) || attempt)"
MAILS = f"""w AS (SELECT DISTINCT user_id::BIGINT * 1000 + dayofyear(ts) AS id, user_id::BIGINT AS subscription_id, CASE WHEN user_id % 5 = 0 THEN 'skipped_empty' ELSE 'pending' END AS status FROM events),
  n AS (SELECT user_id::BIGINT * 1000 + dayofyear(ts) AS digest_id, user_id::BIGINT AS subscription_id, event_type = 'purchase' AS ok, CASE WHEN event_type <> 'purchase' THEN event_type END AS error, ts::TIMESTAMP AS tried, row_number() OVER (PARTITION BY user_id, dayofyear(ts) ORDER BY ts, event_id)::INT AS attempt FROM events WHERE event_type IN ('click', 'error', 'purchase')),
  m AS (SELECT *, {MAIL_ID} AS mail_id FROM n),
  t AS (SELECT digest_id, max(attempt) AS tries, count(*) FILTER (WHERE NOT ok) AS failures, bool_or(ok) AS sent, min(CASE WHEN ok THEN tried END) AS sent_at, arg_max(error, attempt) AS error FROM m GROUP BY 1)"""
SQL = {
    "period_bucket_daily": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS end, count(*) AS n FROM events GROUP BY 1, 2",
    "period_bucket_weekly": "SELECT date_trunc('week', ts)::TIMESTAMP AS start, date_trunc('week', ts)::TIMESTAMP + INTERVAL 7 DAY AS end, count(*) AS n FROM events GROUP BY 1, 2",
    "topic_match_reasons": f"WITH {MATCH} SELECT subscription_id, article_id, string_agg(reason, ';' ORDER BY o) AS reasons FROM m GROUP BY 1, 2",
    "digest_entries": f"WITH {MATCH}, {ENTRIES} SELECT * FROM n",
    "digest_plan": "SELECT item_id AS subscription_id, CASE WHEN length(text) > 220 THEN 'return' WHEN length(text) > 180 THEN 'resend' ELSE 'skip' END AS action FROM benchmark WHERE length(text) > 120",
    "digest_actions": f"WITH {MATCH}, {ENTRIES} SELECT item_id AS subscription_id, count(article_id) AS items, CASE WHEN item_id % 14 = 0 THEN 'return' WHEN item_id % 7 = 0 THEN 'resend' WHEN length(text) > 200 THEN 'none' WHEN count(article_id) = 0 THEN 'skip' ELSE 'create' END AS action FROM benchmark LEFT JOIN n ON n.subscription_id = item_id WHERE length(text) > 120 GROUP BY item_id, text",
    "rendered_digests": f"""WITH {MATCH}, {ENTRIES}, r AS (SELECT subscription_id, article_id, string_agg(reason, '、' ORDER BY o) AS reasons FROM m GROUP BY 1, 2),
  i AS (SELECT subscription_id, position, title, url, CASE WHEN source_id = 'src1' THEN '{rules.UNKNOWN_SOURCE}' ELSE 'Site <' || source_id || '>' END AS source, coalesce(strftime(published_at, '%Y-%m-%d %H:%M'), '{rules.UNKNOWN_TIME}') AS pub, reasons, CASE WHEN coalesce(summary, '') = '' THEN '{rules.MAIL_NO_SUMMARY}' ELSE summary END AS summary, CASE WHEN n_chars % 3 = 2 THEN '另有 1 个来源转载' END AS again FROM n JOIN r USING (subscription_id, article_id) JOIN a ON a.id = article_id),
  g AS (SELECT subscription_id, count(*) AS k, string_agg('<li><a href="' || {ESC('url')} || '">' || {ESC('title')} || '</a><p>' || {ESC('source')} || '　·　' || pub || '　·　命中方向：' || {ESC('reasons')} || coalesce('　·　' || again, '') || '</p><p>' || {ESC('summary')} || '</p></li>', '' ORDER BY position) AS h,
    string_agg(position || '. ' || title || chr(10) || '   来源：' || source || '　发布时间：' || pub || chr(10) || '   命中方向：' || reasons || chr(10) || '   摘要：' || summary || chr(10) || '   原文：' || url || coalesce(chr(10) || '   （该内容' || again || '）', ''), chr(10) ORDER BY position) AS t FROM i GROUP BY 1),
  w AS (SELECT subscription_id, string_agg(reason, '、' ORDER BY o) AS topics FROM u GROUP BY 1),
  b AS (SELECT item_id AS subscription_id, 'reader' || item_id || '@example.org' AS email, 're' || repeat('*', length('reader' || item_id) - 2) || '@example.org' AS masked, coalesce(k, 0) AS k, h, t, coalesce(topics, '') AS topics, 'https://site.example/unsubscribe?token=t' || item_id AS leave, '2024-01-01 ~ 2024-01-01（每日）' AS period FROM benchmark LEFT JOIN g ON g.subscription_id = item_id LEFT JOIN w ON w.subscription_id = item_id)
  SELECT subscription_id, email, CASE WHEN k > 0 THEN '[每日摘要] 01-01 起 ' || k || ' 篇新内容' ELSE '[每日摘要] 本周期无新内容' END AS subject,
  '<h1>订阅摘要</h1>' || chr(10) || '<p>' || masked || '　·　' || period || '　·　本期 ' || k || ' 篇</p>' || chr(10) || CASE WHEN k > 0 THEN '<ol>' || h || '</ol>' ELSE '<p>{rules.MAIL_NOTHING}</p>' END || chr(10) || '<p>{rules.MAIL_WHY}' || {ESC('topics')} || '。<br><a href="' || {ESC('leave')} || '">{rules.MAIL_LEAVE}</a>　·　{rules.MAIL_NOTE}</p>' AS html,
  masked || ' 的订阅摘要（' || period || '）' || chr(10) || chr(10) || CASE WHEN k > 0 THEN '本期共 ' || k || ' 篇与你的订阅方向相关的新内容：' || chr(10) || chr(10) || t ELSE '{rules.MAIL_NOTHING}' END || chr(10) || chr(10) || '——' || chr(10) || '{rules.MAIL_WHY}' || topics || '。' || chr(10) || '{rules.MAIL_LEAVE_TEXT}' || leave || chr(10) || '{rules.MAIL_NOTE}' AS text FROM b""",
    "confirmations": f"WITH {TOKENS}, o AS (SELECT *, CASE WHEN status = 'unsubscribed' THEN 'unsubscribed' WHEN status = 'pending_confirmation' AND late THEN 'expired' ELSE 'confirmed' END AS outcome FROM k) SELECT 'c' || id AS token, outcome AS state FROM o UNION ALL SELECT unnest(['wrong', '']), 'invalid' UNION ALL SELECT 'after ' || id, CASE WHEN status = 'pending_confirmation' AND NOT late THEN 'confirmed {NOW}' ELSE status END FROM o",
    "unsubscriptions": f"WITH {TOKENS}, q AS (SELECT id, e, CASE WHEN id % 2 = 0 THEN 'all' ELSE 'self' END AS scope FROM k WHERE id % 5 = 0), h AS (SELECT q.id AS asked, k.id FROM q JOIN k ON k.id = q.id OR (scope = 'all' AND k.e = q.e)) SELECT 'u' || asked AS token, count(*)::VARCHAR AS state FROM h GROUP BY asked UNION ALL SELECT 'wrong', '0' UNION ALL SELECT 'after ' || id, CASE WHEN id IN (SELECT id FROM h) THEN 'unsubscribed {NOW}' ELSE status END FROM k",
    "deleted_subscriptions": f"WITH {TOPIC} SELECT item_id AS id, count(k) AS topics FROM benchmark LEFT JOIN u ON subscription_id = item_id WHERE item_id % 3 <> 0 GROUP BY 1",
    "send_windows": "SELECT hour(ts) BETWEEN 9 AND 20 AS open, true AS always, count(*) AS n FROM events GROUP BY 1, 2",
    "delivery_outcomes": f"SELECT CASE event_id % 3 WHEN 1 THEN 'sent' WHEN 2 THEN 'failed' ELSE s END AS status, CASE event_id % 3 WHEN 2 THEN 2 ELSE 1 END::INT AS retry_count, CASE event_id % 3 WHEN 0 THEN 'old' WHEN 2 THEN 'refused' END AS error, event_id % 3 = 1 AS sent_now, count(*) AS n FROM (SELECT event_id, {STATUS_SQL} AS s FROM events) GROUP BY 1, 2, 3, 4",
    "sent_marks": f"SELECT item_id AS id, CASE WHEN item_id % 4 = 0 THEN TIMESTAMP '{NOW}' END AS last_sent_at FROM benchmark",
    "digest_detail": f"WITH {MATCH}, {ENTRIES}, r AS (SELECT subscription_id, article_id, string_agg(reason, ';' ORDER BY o) AS matched_topics FROM m GROUP BY 1, 2) SELECT position, article_id, CASE WHEN article_id % 2 = 0 THEN url END AS url, CASE WHEN article_id % 2 = 0 AND source_id <> 'src1' THEN upper(source_id) ELSE '{rules.UNKNOWN_SOURCE}' END AS source_name, matched_topics FROM n JOIN r USING (subscription_id, article_id) JOIN a ON a.id = article_id WHERE subscription_id = 3",
    "valid_requests": "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'email' WHEN c_custkey % 60 NOT BETWEEN 1 AND 50 THEN 'max_items' WHEN c_custkey % 23 NOT BETWEEN 1 AND 20 THEN 'topics' WHEN c_custkey % 5 <> 0 AND c_custkey % 55 NOT BETWEEN 1 AND 50 THEN 'keyword' WHEN c_custkey % 5 = 0 THEN 'topic_type' END AS reject FROM customer",
    "digest_topn_per_user": "SELECT user_id, event_id, position FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS position FROM events) WHERE position <= 5",
    "digest_unsent": "SELECT event_id, user_id FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND ts < TIMESTAMP '2024-01-05')",
    "rate_limit_hour": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS requests FROM events",
    "usage_today": "SELECT count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS failed, coalesce(sum(floor(value)), 0)::BIGINT AS tokens FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND ts <= TIMESTAMP '2024-01-15 18:00:00'",
    "delivery_health": f"SELECT *, round(CASE WHEN sent + failed = 0 THEN 0 ELSE failed / (sent + failed)::DOUBLE END, 6) AS failure_rate, sent + failed > 0 AND failed / (sent + failed)::DOUBLE >= 0.05 AS paused FROM (SELECT count(*) AS sampled, count(*) FILTER (WHERE s = 'sent') AS sent, count(*) FILTER (WHERE s = 'failed') AS failed, count(*) FILTER (WHERE s = 'skipped_empty') AS skipped FROM (SELECT {STATUS_SQL} AS s FROM events ORDER BY ts DESC, event_id DESC LIMIT 50))",
    "backlog_zero_filled": f"SELECT status, count(s) AS n FROM (SELECT unnest(['pending', 'sent', 'failed', 'skipped_empty']) AS status) LEFT JOIN (SELECT {STATUS_SQL} AS s FROM events WHERE event_type <> 'view') ON s = status GROUP BY 1",
    "run_report": f"SELECT count(*) AS total, {', '.join(f'count(*) FILTER (WHERE s = {x!r}) AS {x}' for x in rules.DIGEST_STATUSES)} FROM (SELECT {STATUS_SQL} AS s FROM events)",
    "due_sources": f"WITH {SOURCES} SELECT id FROM i WHERE kind <> 'signup' AND n >= 8 AND floor(epoch(TIMESTAMP '{NOW}')) - floor(epoch(last_crawled_at)) >= seconds",
    "interval_map": f"WITH {SOURCES} SELECT id, seconds FROM i",
    "crawl_finalize": f"WITH {SOURCES} SELECT id, CASE WHEN n > 10 THEN TIMESTAMP '{NOW}' ELSE last_crawled_at END AS last_crawled_at, CASE WHEN n > 10 AND kind <> 'signup' THEN TIMESTAMP '{NOW}' END AS last_success_at FROM s",
    "settings_history_lag": f"WITH {HISTORY} SELECT id, old_value::VARCHAR AS old_value FROM h",
    "settings_current": f"WITH {HISTORY} SELECT key, arg_max(new_value, (ts, id)) AS value FROM h GROUP BY 1",
    "settings_rollback": f"WITH {HISTORY} SELECT key, new_value AS old_value, old_value AS new_value, 'admin' AS actor FROM h WHERE id = (SELECT max(id) FROM h)",
    "settings_overlay": f"WITH {STORED}, b AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in rules.SETTING_DEFAULTS.items()) + ") t(key, value)) SELECT b.key, coalesce(e.value, b.value) AS value FROM b LEFT JOIN e USING (key)",
    "knowledge_stats": f"WITH {ARTICLES} SELECT 'archived' AS kind, CASE category WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE '{rules.UNCATEGORIZED_LABEL}' END AS name, count(*) AS n FROM a WHERE status = 'knowledge_duplicate' GROUP BY 2",
    "push_blocked": f"WITH {ARTICLES} SELECT id FROM a WHERE status = 'knowledge_duplicate' OR knowledge_status IN ('covered', 'pending')",
    "knowledge_candidates": f"WITH {ARTICLES} SELECT id FROM a WHERE status NOT IN ('filtered', 'error', 'knowledge_duplicate') AND knowledge_status IS NULL ORDER BY crawled_at DESC, id DESC LIMIT 50",
    "latest_decision_per_article": f"WITH {DECISIONS} SELECT article_id, id, decision FROM d",
    "decided_articles": f"WITH {ARTICLES}, {DECISIONS} SELECT CASE WHEN decision = 'covered' THEN 'knowledge_duplicate' WHEN decision IS NOT NULL AND status = 'knowledge_duplicate' THEN 'normal' ELSE status END AS status, CASE WHEN decision = 'new_knowledge' THEN 'new' ELSE coalesce(decision, knowledge_status) END AS knowledge_status, count(*) AS n FROM a LEFT JOIN d ON d.article_id = a.id GROUP BY 1, 2",
    "subscription_states": "SELECT id, CASE k WHEN 'purchase' THEN 'unsubscribed' WHEN 'confirm' THEN 'confirmed' ELSE 'pending_confirmation' END AS status, confirmed_at FROM (SELECT user_id AS id, arg_max(CASE WHEN event_type IN ('click', 'view') THEN 'confirm' ELSE event_type END, (ts, CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'unsubscribe' WHEN 'error' THEN 'delete' ELSE 'confirm' END)) AS k, max(ts) FILTER (WHERE event_type IN ('click', 'view')) AS confirmed_at FROM events WHERE event_type NOT IN ('click', 'view') OR ts <= TIMESTAMP '2024-01-25' GROUP BY 1) WHERE k <> 'error'",
    "equal_topic_sets": "SELECT CASE WHEN s = ['view'] THEN 1 ELSE 2 END::INT AS wanted_id, user_id AS subscription_id FROM (SELECT user_id, list_sort(list_distinct(list(event_type))) AS s FROM events WHERE ts < TIMESTAMP '2024-01-03' GROUP BY 1) WHERE s = ['view'] OR s = ['click', 'view']",
    "typed_points": "SELECT conv_id, turn, CASE WHEN turn <> 1 THEN role END AS name, CASE WHEN turn = 1 THEN -1 ELSE 1 END::BIGINT AS n FROM conversations",
    "masked_subscriptions": "SELECT item_id AS id, 're' || repeat('*', length('reader' || item_id) - 2) || '@example.org' AS email, CASE WHEN length(text) > 120 THEN 'confirmed' ELSE 'unsubscribed' END AS status FROM benchmark",
    "topic_labels": f"WITH {TOPIC} SELECT subscription_id, o::INT AS ord, reason AS label FROM u",
    "due_mails": f"WITH {MAILS}, q AS (SELECT w.id AS digest_id, subscription_id, (coalesce(tries, 0) + 1)::INT AS attempt FROM w LEFT JOIN t ON w.id = t.digest_id WHERE status = 'pending' AND (tries IS NULL OR (NOT sent AND failures < 3))), k AS (SELECT *, {MAIL_ID} AS mail_id FROM q), z AS (SELECT *, sha256('s' || sha256('s' || mail_id)) AS token FROM k) SELECT mail_id, digest_id, subscription_id, attempt, token, sha256(token) AS token_hash FROM z",
    "settled_digests": f"WITH {MAILS} SELECT id, subscription_id, CASE WHEN sent THEN 'sent' WHEN NOT sent THEN 'failed' ELSE status END AS status, t.sent_at, coalesce(failures, 0)::BIGINT AS retry_count, CASE WHEN NOT sent THEN t.error END AS error FROM w LEFT JOIN t ON w.id = t.digest_id",
    "knowledge_run": f"""WITH RECURSIVE {ARTICLES}, c AS (SELECT id, title FROM a WHERE status = 'normal' ORDER BY crawled_at DESC, id DESC LIMIT 40), e AS (SELECT id, trim(title) AS name FROM a WHERE weight = 1),
  p AS (SELECT c.id, trim(title) AS name, [unicode(title[k])::DOUBLE FOR k IN [1, 2, 3]] AS v, trim(title) IN (SELECT name FROM e) AS named, row_number() OVER (ORDER BY id) AS n FROM c WHERE id % 11 <> 0 AND length(title) > 8),
  q AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM e) THEN list_cosine_similarity(v, [1.0, 0.0, 0.0]::DOUBLE[]) ELSE 0 END AS known FROM p),
  g AS (SELECT 0::BIGINT AS n, []::DOUBLE[][] AS kept, []::VARCHAR[] AS names, NULL::BIGINT AS id, false AS covered
    UNION ALL SELECT z.n, CASE WHEN z.hit OR z.named OR list_contains(z.names, z.name) THEN z.kept ELSE list_append(z.kept, z.v) END, CASE WHEN z.hit OR z.named OR list_contains(z.names, z.name) THEN z.names ELSE list_append(z.names, z.name) END, z.id, z.hit
    FROM (SELECT q.n, q.id, q.name, q.v, q.named, g.kept, g.names, greatest(q.known, coalesce(list_max(list_transform(g.kept, lambda w: list_cosine_similarity(w, q.v))), 0)) >= 0.999 AS hit FROM g JOIN q ON q.n = g.n + 1) z)
  SELECT CASE WHEN c.id % 11 = 0 THEN 'pending' WHEN covered THEN 'covered' ELSE 'new_knowledge' END AS decision, count(*) AS n FROM c LEFT JOIN g ON c.id = g.id GROUP BY 1""",
    "rotated_tokens": f"WITH {MAILS} SELECT user_id::BIGINT AS id, coalesce(max_by(sha256(sha256('s' || sha256('s' || mail_id))), (tried, digest_id, attempt)), 'first') AS unsubscribe_token_hash, max(CASE WHEN ok THEN tried END) AS last_sent_at FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN m ON m.subscription_id = user_id GROUP BY 1",
}
