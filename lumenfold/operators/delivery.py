"""Mails that are sent once: an append-only log of outcomes decides what is due, what each digest is and which token counts.

A mail is known by its digest and attempt, and its id and token follow from these, so that whoever makes it again makes the
same one. The log is all the state there is: digests and subscriptions are what its rows leave."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources import versions
from ..sources.store import natural_id

#: A row of the log. `ok` with no error, or the error of a mail that was not taken.
LOG = "mail_id string, digest_id long, subscription_id long, attempt int, token_hash string, ok boolean, error string, at timestamp"


def token(secret: Column, mail_id: Column) -> Column:
    """The link of a mail that ends the subscription: made of a secret, never stored; the log has its hash."""
    return F.sha2(F.concat(secret, F.sha2(F.concat(secret, mail_id), 256)), 256)


def attempts(log: DataFrame) -> DataFrame:
    """digest_id, tries, failures, sent, sent_at, error: what the log says of each digest that was tried. Rows that a run wrote
    twice count once."""
    rows = log.dropDuplicates(["mail_id"])
    last = F.max_by("error", "attempt")
    return rows.groupBy("digest_id").agg(
        F.max("attempt").alias("tries"), F.count_if(~F.col("ok")).alias("failures"), F.bool_or("ok").alias("sent"), F.min(F.when(F.col("ok"), F.col("at"))).alias("sent_at"), F.when(~F.bool_or("ok"), last).alias("error"),
    )


def due_mails(digests: DataFrame, log: DataFrame, max_retries: int, secret: str) -> DataFrame:
    """mail_id, digest_id, subscription_id, attempt, token, token_hash of all mails to be sent now: of pending digests never
    tried, and of those whose tries all failed, fewer than max_retries of them. digests: id, subscription_id, status; what
    is skipped or sent by its status is never due. An unknown digest in the log is nobody's."""
    d = digests.where("status in ('pending', 'failed')").select(F.col("id").alias("digest_id"), "subscription_id")
    rows = d.join(attempts(log), "digest_id", "left").where(f"tries is null or (not sent and failures < {int(max_retries)})")
    rows = rows.select("digest_id", "subscription_id", (F.coalesce("tries", F.lit(0)) + 1).cast("int").alias("attempt"))
    rows = rows.withColumn("mail_id", natural_id("mail", F.col("digest_id").cast("string"), F.col("attempt").cast("string")))
    rows = rows.withColumn("token", token(F.lit(secret), F.col("mail_id")))
    return rows.withColumn("token_hash", text.hash_token(F.col("token"))).select("mail_id", "digest_id", "subscription_id", "attempt", "token", "token_hash")


def settled_digests(digests: DataFrame, log: DataFrame) -> DataFrame:
    """The digests as the log leaves them: status, sent_at, retry_count (failed tries) and error; untried ones as they are.
    A mail that was sent settles its digest, whatever came before."""
    a = attempts(log).select(F.col("digest_id").alias("id"), "failures", "sent", F.col("sent_at").alias("__at"), F.col("error").alias("__error"))
    tried = F.col("sent").isNotNull()
    return digests.join(a, "id", "left").withColumns({
        "status": F.when(F.col("sent"), "sent").when(tried, "failed").otherwise(F.col("status")), "sent_at": F.when(tried, F.col("__at")).otherwise(F.col("sent_at")),
        "retry_count": F.when(tried, F.col("failures")).otherwise(F.col("retry_count")).cast("long"), "error": F.when(tried, F.col("__error")).otherwise(F.col("error")),
    }).drop("failures", "sent", "__at", "__error")


def settled_subscriptions(subscriptions: DataFrame, log: DataFrame) -> DataFrame:
    """Subscriptions with the time of their last mail and the hash of their newest token. Each mail has a token of its own, and
    the newest counts whether or not its mail was taken; those before it end nothing any more."""
    newest = F.max_by("token_hash", F.struct("at", "digest_id", "attempt"))
    l = log.dropDuplicates(["mail_id"]).groupBy(F.col("subscription_id").alias("id")).agg(newest.alias("__token"), F.max(F.when(F.col("ok"), F.col("at"))).alias("__at"))
    return subscriptions.join(l, "id", "left").withColumns({"unsubscribe_token_hash": F.coalesce("__token", "unsubscribe_token_hash"), "last_sent_at": F.greatest("last_sent_at", "__at")}).drop("__token", "__at")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All runs of the log that came to their end; none, if there is no log yet."""
    runs = finished_runs(spark, path)
    return spark.read.schema(LOG).parquet(*runs) if runs else spark.createDataFrame([], LOG)


def finished_runs(spark: SparkSession, path: str) -> list[str]:
    fs, at = versions._fs(spark, path)
    if not fs.exists(at(path)):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(at(path)))
    return [f"{path}/{n}" for n in names if n.startswith("run-") and fs.exists(at(f"{path}/{n}/_SUCCESS"))]


def deliver(mails: DataFrame, send: Callable[[dict], None], path: str, run: str, now: Column) -> DataFrame:
    """Give each mail (due_mails() with the columns of a message) to `send`, which raises what keeps it from taking the mail, and
    add the outcomes to the log at `path` as run `run`. The run's rows of the log.

    A run that is in the log already is not sent again but read; nor is a mail that another run has an outcome of. A run that
    broke off left no outcome, so its mails are sent again with the same mail_id and the same token: the sender must take an
    id once, as mail gateways do by message id. Outcomes are written as they come; nothing is held or collected."""
    spark = mails.sparkSession
    folder = f"{path}/run-{run}"
    if folder not in finished_runs(spark, path):
        fresh = mails.dropDuplicates(["mail_id"]).join(read_log(spark, path).select("mail_id"), "mail_id", "left_anti")
        fields = ["mail_id", "digest_id", "subscription_id", "attempt", "token_hash"]

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                errors: list[str | None] = []
                for mail in batch.to_dict("records"):
                    try:
                        send(mail)
                        errors.append(None)
                    except Exception as e:  # noqa: BLE001
                        errors.append(str(e) or type(e).__name__)
                out = batch[fields].copy()
                out["error"] = pd.Series(errors, index=out.index, dtype=object)
                out["ok"] = out["error"].isna()
                yield out

        told = fresh.mapInPandas(each, "mail_id string, digest_id long, subscription_id long, attempt int, token_hash string, error string, ok boolean")
        told.withColumn("at", now.cast("timestamp")).select("mail_id", "digest_id", "subscription_id", "attempt", "token_hash", "ok", "error", "at").write.mode("overwrite").parquet(folder)
    return spark.read.schema(LOG).parquet(folder)
