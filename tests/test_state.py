"""Groups kept up to date, mails sent once, versions in tiers: against the whole computed at once."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import dedup, delivery, forest
from lumenfold.sources import parts, store, tiers, versions

T0 = datetime(2026, 9, 14, 10)


# Groups


def people(spark, ids, rng):
    rows = [(i, rng.choice([True, True, False, None]), rng.choice([0.5, 1.0, None]), rng.choice([None, T0 + timedelta(hours=rng.randrange(5))]), "x" * rng.randrange(4), rng.choice(["a title", "无标题", None]), T0 + timedelta(hours=rng.randrange(3))) for i in ids]
    return spark.createDataFrame(rows, "id long, is_accessible boolean, weight double, published_at timestamp, content string, title string, created_at timestamp")


def told(df):
    return {r["id"]: (r["root"], r["group_key"], r["primary_id"]) for r in df.collect()}


def whole(links, articles):
    g = dedup.groups(links)
    return told(g.join(dedup.elect(g.join(articles, "id")), "group_key"))


def test_groups_absorb_links(spark, tmp_path):
    """Random links in an order of their own, so that stored roots are hung below others; repeats, nulls, own links, an
    empty batch. After each batch the state is what all links so far give."""
    rng = random.Random(3)
    links = [(i, rng.randrange(max(0, i - 30), i)) for i in range(1, 120) if rng.random() < 0.7]
    articles = store.stored(people(spark, range(120), rng), "people")
    looked_at = store.stored(forest.candidates(articles), "looked-at")
    rng.shuffle(links)
    kept = forest.state(spark, str(tmp_path / "state"), 8)
    size = -(-len(links) // 3)
    for n in range(3):
        batch = links[n * size : (n + 1) * size]
        extra = [(links[0][0], links[0][1]), (None, 3), (5, None), (7, 7)]
        forest.absorb(kept, spark.createDataFrame(batch + batch[:2] + extra, "id long, parent long"), looked_at)
        seen = spark.createDataFrame(links[: (n + 1) * size], "id long, parent long")
        assert told(forest.groups(kept)) == whole(seen, articles)
    assert kept.version() == 3 and forest.absorb(kept, spark.createDataFrame([], "id long, parent long"), looked_at) == 3
    assert Counter(r["id"] for r in kept.read("members").collect()) == Counter(r["id"] for r in kept.read("trees").collect())
    # An article of a group is no longer reachable: its group elects again.
    gone = next(v[2] for v in told(forest.groups(kept)).values())
    lost = articles.withColumn("is_accessible", F.when(F.col("id") == gone, False).otherwise(F.col("is_accessible")))
    forest.refresh(kept, forest.candidates(lost.where(F.col("id") == gone)))
    assert told(forest.groups(kept)) == whole(spark.createDataFrame(links, "id long, parent long"), lost)
    assert forest.refresh(kept, forest.candidates(lost.limit(0))) == kept.version()


def test_untouched_buckets_are_not_read(spark, tmp_path):
    """A new pair: the buckets of the other groups keep their files, and a damaged one of them is not noticed."""
    rng = random.Random(4)
    looked_at = store.stored(forest.candidates(people(spark, range(60), rng)), "looked-at")
    kept = forest.state(spark, str(tmp_path / "state"), 32)
    forest.absorb(kept, spark.createDataFrame([(i + 1, i) for i in range(0, 40, 2)], "id long, parent long"), looked_at)
    before = kept.told(1)["tables"]
    touched = {name: {str(b) for b in kept.touched(spark.createDataFrame([(50,), (51,)] if name == "trees" else [(50,)], "id long"))} for name in before}
    for name, folders in before.items():
        for b, folder in folders.items():
            if b not in touched[name]:
                for file in (tmp_path / "state" / folder).glob("*.parquet"):
                    file.write_bytes(b"damaged")
    forest.absorb(kept, spark.createDataFrame([(51, 50)], "id long, parent long"), looked_at)
    after = kept.told(2)["tables"]
    for name in before:
        assert {b: f for b, f in after[name].items() if b not in touched[name]} == {b: f for b, f in before[name].items() if b not in touched[name]}
    new = kept.read("primaries", kept.touched(spark.createDataFrame([(50,)], "root long"))).where("root = 50").first()
    assert new["primary_id"] in (50, 51)


def test_a_second_writer_of_buckets_is_refused(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, v string").schema
    kept = parts.Parts(spark, str(tmp_path / "p"), {"t": ("k", schema)}, 4)
    rows = lambda *v: spark.createDataFrame(list(v), schema)
    first = rows((1, "a"), (2, "b"), (3, "c"))
    assert kept.commit({"t": (first, kept.touched(first.select("k")))}, 0) == 1
    one = kept.touched(rows((1, "")).select("k"))
    others = [r for r in first.collect() if kept.touched(rows((r["k"], "")).select("k")) == one and r["k"] != 1]
    assert kept.commit({"t": (rows((1, "z"), *[tuple(r) for r in others]), one)}, 1) == 2
    with pytest.raises(versions.Conflict):
        kept.commit({"t": (rows((1, "late")), one)}, 1)
    assert sorted(map(tuple, kept.read("t").collect())) == [(1, "z"), (2, "b"), (3, "c")] and sorted(map(tuple, kept.read("t", version=1).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    kept.commit({"t": (rows(), one)}, 2)
    assert 1 not in {r["k"] for r in kept.read("t").collect()}


# Mails


def gateway(folder):
    """A sender that takes a message id once and notes every call; digest 2 is never taken, digest 3 at the second attempt."""

    def send(mail):
        import uuid
        from pathlib import Path

        Path(folder, "calls").mkdir(exist_ok=True)
        Path(folder, "calls", f"{mail['mail_id']}-{uuid.uuid4().hex}").write_text(mail["token"])
        if mail["digest_id"] == 2 or (mail["digest_id"] == 3 and mail["attempt"] == 1):
            raise OSError(f"refused {mail['attempt']}")

    return send


def test_mails_are_sent_once(spark, tmp_path):
    (tmp_path / "out").mkdir()
    send, log = gateway(str(tmp_path / "out")), str(tmp_path / "log")
    digests = spark.createDataFrame([(1, 10, "pending"), (2, 20, "pending"), (3, 10, "failed"), (4, 30, "skipped_empty"), (5, 30, "sent"), (6, 40, "pending")], "id long, subscription_id long, status string").withColumns({"sent_at": F.lit(None).cast("timestamp"), "retry_count": F.lit(0).cast("long"), "error": F.lit(None).cast("string")})
    calls = lambda: Counter(p.name.rsplit("-", 1)[0] for p in (tmp_path / "out" / "calls").iterdir())
    first = store.stored(delivery.due_mails(digests, delivery.read_log(spark, log), 3, "s"), "mails")
    assert {(r["digest_id"], r["attempt"]) for r in first.collect()} == {(1, 1), (2, 1), (3, 1), (6, 1)} and first.where("token_hash = token").isEmpty()
    for again in range(2):  # the same run, then the same mails as another run
        delivery.deliver(first, send, log, "a", F.lit(T0))
    delivery.deliver(first.union(first), send, log, "b", F.lit(T0))
    assert set(calls().values()) == {1} and len(calls()) == 4 and delivery.read_log(spark, log).count() == 4
    for n in range(4):
        due = store.stored(delivery.due_mails(delivery.settled_digests(digests, delivery.read_log(spark, log)), delivery.read_log(spark, log), 3, "s"), "mails")
        assert {(r["digest_id"], r["attempt"]) for r in due.collect()} == ({(2, 2), (3, 2)}, {(2, 3)}, set(), set())[n]
        delivery.deliver(due, send, log, f"r{n}", F.lit(T0 + timedelta(hours=n + 1)))
    got = {r["id"]: (r["status"], r["sent_at"], r["retry_count"], r["error"]) for r in delivery.settled_digests(digests, delivery.read_log(spark, log)).collect()}
    assert got == {1: ("sent", T0, 0, None), 2: ("failed", None, 3, "refused 3"), 3: ("sent", T0 + timedelta(hours=1), 1, None), 4: ("skipped_empty", None, 0, None), 5: ("sent", None, 0, None), 6: ("sent", T0, 0, None)}
    subs = spark.createDataFrame([(i, "old", None) for i in (10, 20, 30, 40)], "id long, unsubscribe_token_hash string, last_sent_at timestamp")
    now = {r["id"]: r for r in delivery.settled_subscriptions(subs, delivery.read_log(spark, log)).collect()}
    hashes = {(r["digest_id"], r["attempt"]): r["token_hash"] for r in delivery.read_log(spark, log).collect()}
    assert [now[i]["unsubscribe_token_hash"] for i in (10, 20, 30, 40)] == [hashes[3, 2], hashes[2, 3], "old", hashes[6, 1]] and len(set(hashes.values())) == len(hashes)
    assert [now[i]["last_sent_at"] for i in (10, 20, 30, 40)] == [T0 + timedelta(hours=1), None, None, T0]


def test_a_broken_run_is_sent_again_under_the_same_ids(spark, tmp_path):
    """A run whose task dies leaves no outcome; the next makes the very same mails, ids and tokens."""
    (tmp_path / "out").mkdir()
    log, digests = str(tmp_path / "log"), spark.createDataFrame([(1, 10, "pending")], "id long, subscription_id long, status string")
    make = lambda: delivery.due_mails(digests, delivery.read_log(spark, log), 3, "s")
    send = gateway(str(tmp_path / "out"))

    def dies(mail):
        send(mail)
        raise SystemExit(1)

    first = make().collect()
    with pytest.raises(Exception):  # noqa: B017, PT011
        delivery.deliver(make(), dies, log, "a", F.lit(T0))
    assert delivery.read_log(spark, log).isEmpty() and make().collect() == first
    delivery.deliver(make(), send, log, "a", F.lit(T0))
    texts = {(p.name.rsplit("-", 1)[0], p.read_text()) for p in (tmp_path / "out" / "calls").iterdir()}
    assert len(texts) == 1 and make().isEmpty()


# Tiers


def test_tiers_keep_the_newest(spark, tmp_path, monkeypatch):
    """Batches that repeat keys, ties of versions, null keys and versions, an empty batch, a batch run again; reads see no more
    than live rows and open runs."""
    monkeypatch.setattr(tiers, "TIER_ROWS", 20)
    rng, path, best, written = random.Random(5), str(tmp_path / "t"), {}, 0
    schema = "k long, kind string, ts long, v string"
    for n in range(9):
        rows = [] if n == 4 else [(rng.choice([None, *range(25)]), rng.choice("ab"), rng.choice([None, *range(12)]), f"{n}-{i}") for i in range(20)]
        written += len(rows)
        for again in range(2 if n == 3 else 1):
            tiers.add(spark.createDataFrame(rows, schema), n, path, ["k", "kind"], "ts", 4)
        for k, kind, ts, v in rows:
            new = (ts is not None, ts or 0, n, v)
            if (k, kind) not in best or new > best[k, kind]:
                best[k, kind] = new
        _, told = tiers.runs(spark, path)
        assert not tiers.due(told)
        got = {(r["k"], r["kind"]): r["v"] for r in tiers.now(spark, path, ["k", "kind"], "ts").collect()}
        assert got == {key: b[3] for key, b in best.items()}
    held = sum(r["rows"] for r in told["runs"])
    assert len(best) <= held < written and len(told["runs"]) < 9
    some = spark.createDataFrame([(1, "a"), (2, "b"), (99, "a")], "k long, kind string")
    assert {(r["k"], r["kind"]): r["v"] for r in tiers.now(spark, path, ["k", "kind"], "ts", some).collect()} == {key: b[3] for key, b in best.items() if key in ((1, "a"), (2, "b"))}
