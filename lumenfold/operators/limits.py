"""Subscription requests: what is asked for is checked and resolved, repeated subscriptions and too frequent requests are
refused, and what is left is created.

The rate limit is a decision in order of time: a request is refused if its address, or its network address, created `limit`
subscriptions in the hour before. Refused requests create nothing and so do not count. Both keys depend on each other: a
request that one refuses does not count for the other. A round folds the requests of each network address given what the
addresses refused in the round before, then those of each address given what that fold refused; rows go through both as they
are, so nothing is joined. The earliest request that is not settled depends on earlier ones alone, so every round settles
more of them, and a round in which no request changes that the other key let through is the sequential result. Where each
address has one network address, and both have one limit, that is the first round."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..session import ship
from ..sources.store import natural_id, stored

HOUR = 3600


def fold(requests: DataFrame, key: str, other: str, name: str, limit: int, seconds: int = HOUR) -> DataFrame:
    """The rows with another column: refused by `key`, given the column of what the other key refused. requests: id, `key`,
    __at (long, microseconds), __fixed (created before), `other`. Rows without a key are not limited, and lie in any task. A
    key's requests are read in order of time by one task, as the decision asks; what a task holds is a batch and the last
    creations of one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, made = None, deque()
        for b in batches:
            keys = b.column(key)
            same = np.zeros(b.num_rows, bool)  # has the key of the row before
            if b.num_rows:
                same[0] = keys[0].as_py() == now
                same[1:] = pc.fill_null(pc.equal(keys[1:], keys[:-1]), False).to_numpy(zero_copy_only=False)
                now = keys[-1].as_py()
            out = []
            columns = (keys.is_null(), b.column("__at"), b.column(other), b.column("__fixed"))
            for old, free, at, skip, fixed in zip(same.tolist(), *(c.to_numpy(zero_copy_only=False).tolist() for c in columns), strict=True):
                if not old:
                    made.clear()
                while made and made[0] < at - seconds * 1_000_000:
                    made.popleft()
                out.append(not (free or fixed) and len(made) >= limit)
                if fixed or not (out[-1] or skip):
                    made.append(at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.bool_())], names=[*b.schema.names, name])

    rows = requests.repartition(key, F.when(F.col(key).isNull(), F.xxhash64("id"))).sortWithinPartitions(key, "__at", F.desc("__fixed"), "id")
    return rows.mapInArrow(run, requests.withColumn(name, F.lit(False)).schema)


def decided(requests: DataFrame, limit: int, made: DataFrame | None = None, seconds: int = HOUR, keys: tuple[str, str] = ("email", "ip")) -> DataFrame:
    """The requests with `refused`, as rate_decisions() has it; further columns stay with their rows."""
    ship(requests.sparkSession)
    a, b = keys
    now = requests.withColumn("__fixed", F.lit(False))
    if made is not None:
        now = now.unionByName(made.select("id", a, b, "at", F.lit(True).alias("__fixed")), allowMissingColumns=True)
    now = now.withColumns({"__at": F.unix_micros("at"), "__was": F.lit(False)})
    while True:
        told = stored(fold(fold(now, b, "__was", "__b", limit, seconds), a, "__b", "__a", limit, seconds), "decisions")
        if told.where("__a <> __was and not __b").isEmpty():
            return told.where("not __fixed").select(*requests.columns, F.when(F.col("__a"), F.lit(a)).when(F.col("__b"), F.lit(b)).alias("refused"))
        now = told.drop("__b", "__was").withColumnRenamed("__a", "__was")


def rate_decisions(requests: DataFrame, limit: int, made: DataFrame | None = None, seconds: int = HOUR, keys: tuple[str, str] = ("email", "ip")) -> DataFrame:
    """id, refused (the first of `keys` that refuses, null if the request is created). requests: id (distinct), both keys,
    at; `made`: such rows that were created before. At one time the smaller id comes first; an hour ago still counts."""
    return decided(requests.select("id", *keys, "at"), limit, made, seconds, keys).select("id", "refused")


def resolved_topics(requests: DataFrame, categories: DataFrame, tags: DataFrame, sources: DataFrame) -> DataFrame:
    """id, ord, topic_type, topic_value, bad: each topic of a request with the value that is stored: names of active
    categories and of tags as they are, sources by id or site_url to their id, keywords trimmed. bad: what is wrong, or null."""
    t = requests.select("id", F.posexplode("topics").alias("ord", "t")).select("id", "ord", "t.topic_type", F.trim(F.coalesce("t.topic_value", F.lit(""))).alias("value"))
    names = categories.where("status = 'active'").select(F.lit("category").alias("topic_type"), F.col("name").alias("value"), F.col("name").alias("known"))
    names = names.unionByName(tags.select(F.lit("tag").alias("topic_type"), F.col("name").alias("value"), F.col("name").alias("known")))
    open_ = sources.where("list_type <> 'blacklist'").select(F.col("id").cast("string").alias("id"), "site_url")
    by_id = open_.select(F.lit("source").alias("topic_type"), F.col("id").alias("value"), F.col("id").alias("known"))
    taken = sources.select(F.col("id").cast("string").alias("value"))  # an id goes before an address, even that of a closed source
    by_url = open_.groupBy(F.col("site_url").alias("value")).agg(F.min("id").alias("known")).join(taken, "value", "left_anti").select(F.lit("source").alias("topic_type"), "value", "known")
    known = names.unionByName(by_id).unionByName(by_url).groupBy("topic_type", "value").agg(F.min("known").alias("known"))
    rows = t.join(known, ["topic_type", "value"], "left")
    bad = F.when(~F.coalesce(F.col("topic_type").isin(*rules.ENUMS["topic_type"]), F.lit(False)), "topic_type").when(F.col("value") == "", "empty")
    bad = bad.when((F.col("topic_type") == "keyword") & (F.length("value") > rules.MOST_KEYWORD), "keyword").when((F.col("topic_type") != "keyword") & F.col("known").isNull(), "unknown")
    return rows.select("id", "ord", "topic_type", F.when(F.col("topic_type") == "keyword", F.col("value")).otherwise(F.col("known")).alias("topic_value"), bad.alias("bad"))


def create_subscriptions(requests: DataFrame, categories: DataFrame, tags: DataFrame, sources: DataFrame, subscriptions: DataFrame, topics: DataFrame, limit: int, secret: Column, made: DataFrame | None = None, hours: int = 48) -> tuple[DataFrame, DataFrame]:
    """(outcomes, topics) of requests: id (distinct), email, ip, at, frequency, max_items, topics (array of topic_type,
    topic_value).

    outcomes: id, outcome (created, or what refuses the request: email, topics, topic_type, empty, unknown, keyword,
    frequency, max_items, ALREADY_SUBSCRIBED, RATE_LIMITED), and of created ones subscription_id, email, ip, at, frequency,
    max_items, status, confirm_expires_at, and confirm_token, whose hash is what a store keeps. Tokens follow from `secret`
    and the request, so a task that runs again makes the same. Checks go in that order. subscriptions: id, email, status;
    topics: subscription_id, topic_type, topic_value, of what there is; a confirmed one of the same address with the same
    topics stands in the way. made: id, email, ip, at of earlier creations."""
    every = resolved_topics(requests, categories, tags, sources)
    # The first bad topic in order decides; repeated topics count once.
    judged = every.groupBy("id").agg(F.min_by("bad", F.when(F.col("bad").isNotNull(), F.col("ord"))).alias("bad"), F.array_sort(F.collect_set(F.when(F.col("bad").isNull(), F.struct("topic_type", "topic_value")))).alias("signature"))
    rows = requests.withColumn("address", text.normalize_email(F.col("email"))).join(judged, "id", "left")
    often = F.lower(F.trim(F.coalesce(F.col("frequency"), F.lit(rules.SETTING_DEFAULTS["default_frequency"]))))
    most = F.coalesce("max_items", F.lit(int(rules.SETTING_DEFAULTS["max_items_per_digest"])))
    count = F.size(F.coalesce("topics", F.array().cast(requests.schema["topics"].dataType)))
    wrong = F.when(F.col("address").isNull(), "email").when(~count.between(1, rules.MOST_TOPICS), "topics").when(F.col("bad").isNotNull(), F.col("bad"))
    wrong = wrong.when(~often.isin(*rules.ENUMS["subscription_frequency"]), "frequency").when(~most.between(1, rules.MOST_ITEMS), "max_items")
    rows = rows.select("id", F.col("address").alias("email"), "ip", "at", often.alias("frequency"), most.alias("max_items"), "signature", wrong.alias("wrong"))
    have = topics.groupBy(F.col("subscription_id").alias("sid")).agg(F.array_sort(F.collect_set(F.struct("topic_type", "topic_value"))).alias("signature"))
    twin = subscriptions.where("status = 'confirmed'").select(F.col("id").alias("sid"), "email").join(have, "sid").select("email", "signature", F.lit(True).alias("twin")).distinct()
    rows = rows.join(twin, ["email", "signature"], "left")
    rows = stored(rows.withColumn("wrong", F.when(F.col("wrong").isNull() & F.coalesce("twin", F.lit(False)), "ALREADY_SUBSCRIBED").otherwise(F.col("wrong"))).drop("twin", "signature"), "checked-requests")
    fair = rate_decisions(rows.where("wrong is null").select("id", "email", "ip", "at"), limit, made)
    told = rows.join(fair, "id", "left").withColumn("outcome", F.coalesce("wrong", F.when(F.col("refused").isNotNull(), "RATE_LIMITED"), F.lit("created")))
    ok = F.col("outcome") == "created"
    sid = natural_id("sub", F.col("id").cast("string"))
    given = {"subscription_id": sid, "email": F.col("email"), "ip": F.col("ip"), "at": F.col("at"), "frequency": F.col("frequency"), "max_items": F.col("max_items"), "status": F.lit("pending_confirmation"), "confirm_expires_at": F.col("at") + F.make_interval(hours=F.lit(hours)), "confirm_token": F.sha2(F.concat_ws("\x1f", secret, sid, F.lit("confirm")), 256)}
    outcomes = stored(told.select("id", "outcome", *[F.when(ok, c).alias(n) for n, c in given.items()]), "outcomes")
    first = Window.partitionBy("id", "topic_type", "topic_value").orderBy("ord")
    kept = every.withColumn("n", F.row_number().over(first)).where("n = 1").join(outcomes.where(ok).select("id", "subscription_id"), "id")
    return outcomes, kept.select("subscription_id", "ord", "topic_type", "topic_value")
