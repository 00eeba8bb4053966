"""Vector cells, keyword automata, rate limits and the create flow, polite fetching, versions, dedup on arrival: against
brute force."""

import math
import random
import threading
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import rules
from lumenfold.operators import dedup, digests, hamming, keywords, knowledge, limits, vector_index
from lumenfold.sources import store, versions
from lumenfold.streaming import arrivals, ingest

T0 = datetime(2026, 9, 14, 10)


# Vectors


def cosine(a, b):
    na, nb = math.hypot(*a) if a else 0, math.hypot(*b) if b else 0
    return sum(x * y for x, y in zip(a, b, strict=True)) / (na * nb) if a and len(a) == len(b) and na and nb else 0.0


@pytest.mark.parametrize(("least", "k"), [(0.8, 1), (-1.0, 3)])
def test_vector_cells(spark, monkeypatch, least, k):
    """Clustered vectors, copies (ties), zero vectors, other dimensions; small parts, so that cells are split."""
    for name, value in (("ENTRIES", 16), ("VISITS", 8)):
        monkeypatch.setattr(vector_index, name, value)
    rng = random.Random(k)
    centre = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    near = lambda: [x + rng.gauss(0, 0.15) for x in rng.choice(centre)]
    entries = [(i, near()) for i in range(150)] + [(200 + i, [1.0] * 6) for i in range(40)] + [(300, [0.0] * 6), (301, [1.0, 2.0]), (302, [2.0, 1.0]), (303, [0.0, 0.0])]
    points = [(i, near()) for i in range(40)] + [(100, [1.0] * 6), (101, [0.0] * 6), (102, [1.0, 1.0]), (103, [1.0, 2.0, 3.0])]
    e = spark.createDataFrame([(i, "active", v, "n", "s") for i, v in entries] + [(-1, "retired", [1.0] * 6, "n", "s")], "entry_id long, status string, embedding array<double>, name string, summary string")
    p = spark.createDataFrame(points, "point_id long, embedding array<double>")
    got = {}
    for r in knowledge.nearest_vectors(p, e, least, k).collect():
        got.setdefault(r["point_id"], {})[r["rank"]] = (r["entry_id"], round(r["similarity"], 9))
    for i, v in points:
        want = sorted((-round(cosine(v, w), 9), n) for n, w in entries)[:k]
        assert got.get(i, {}) == {r + 1: (n, -s + 0.0) for r, (s, n) in enumerate(want) if -s >= least}, i
    index = vector_index.build(e.where("status = 'active'"), cells=8)
    made, every = vector_index.visited(p, index, 0.95)
    assert 0 < made < every / 2  # clusters are told apart


def test_vector_blocks(spark, monkeypatch):
    """Small blocks and products, many copies and near ties: the same as brute force, and no more copies than can be found."""
    monkeypatch.setattr(vector_index, "BLOCK_BYTES", 64 * 8 * 5)
    rng = random.Random(5)
    entries = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(200)] + [(1000 - i, [0.5, 0.25, 0.0, 1.0, 2.0]) for i in range(300)] + [(2000, [1.0, 0.5, 0.0, 2.0, 4.0])]
    points = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(150)] + [(500, [0.5, 0.25, 0.0, 1.0, 2.0]), (501, [-0.5, 0.25, 0.0, 1.0, 2.0])]
    e, p = (spark.createDataFrame(x, f"{n} long, embedding array<double>").repartition(3) for x, n in ((entries, "entry_id"), (points, "point_id")))
    got = {}
    for r in vector_index.best(vector_index.products(p, e, -1.0, 3), 3).collect():
        got.setdefault(r["point_id"], {})[r["rank"]] = (r["entry_id"], round(r["similarity"], 9))
    for i, v in points:
        want = sorted((-round(cosine(v, w), 9), n) for n, w in entries)[:3]
        assert got[i] == {r + 1: (n, -s + 0.0) for r, (s, n) in enumerate(want)}, i


def test_native_search_makes_no_list_of_pairs(spark):
    """nearest_entries() multiplies blocks of vectors; it does not send each pair through a row of its own."""
    p = spark.createDataFrame([(1, [1.0, 0.0])], "point_id long, embedding array<double>")
    e = spark.createDataFrame([(7, "active", [1.0, 0.1], "n", "s")], "entry_id long, status string, embedding array<double>, name string, summary string")
    plan = knowledge.nearest_entries(p, e, 0.5)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


# Pairs by distance


def test_stored_preview_is_counted_without_pairs(spark, monkeypatch):
    """Weights, copies, groups of several parts and of one, related edges inside and outside of groups: as the list of pairs has it."""
    monkeypatch.setattr(hamming, "PART", 40)
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(4)]
    flip = lambda v, n: v ^ sum(1 << k for k in rng.sample(range(64), n))
    values = [flip(base[k % 4], rng.randrange(12)) for k in range(220)]
    rows = [(i, f"h{v}{i % 3 if i % 5 == 0 else ''}", v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values + values[:40])]
    prints = spark.createDataFrame(rows, "id long, content_hash string, simhash long")
    group = {i: "big" if i % 220 < 150 else f"g{i % 220 % 7}" for i, _, _ in rows if i % 220 < 200}
    members = spark.createDataFrame([(g, i) for i, g in group.items()], "group_key string, id long")
    edges = spark.createDataFrame([(rng.randrange(260), rng.randrange(260)) for _ in range(60)], "article_id long, target_article_id long")
    for proposed in (0.85, 0.97):
        want = Counter(r["change"] for r in dedup.preview_stored(prints, members, edges, proposed).collect())
        assert {r["change"]: r["pairs"] for r in dedup.preview_stored_counts(prints, members, edges, proposed).collect()} == want and len(want) >= 3


def test_sums_by_distance():
    rng = random.Random(4)
    make = lambda n: hamming.Rows(np.array([rng.getrandbits(8) for _ in range(n)], np.uint64), np.arange(n), np.array([rng.choice([1, 1, 1, 3]) for _ in range(n)]))
    x, y = make(50), make(70)
    want = Counter()
    for v, n in zip(x.v.tolist(), x.n.tolist(), strict=True):
        for w, m in zip(y.v.tolist(), y.n.tolist(), strict=True):
            want[(v ^ w).bit_count()] += n * m
    assert hamming.sums_by_distance(x, y, 4).tolist() == [want[d] if d <= 4 else 0 for d in range(65)]
    below = Counter()
    for k in range(50):
        for j in range(k):
            below[(int(x.v[k]) ^ int(x.v[j])).bit_count()] += int(x.n[k] * x.n[j])
    assert hamming.sums_below(x, 64).tolist() == [below[d] for d in range(65)]


# Keywords


def test_keywords_in_one_pass(spark, monkeypatch):
    rng = random.Random(3)
    letters = "abé日"
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))) for _ in range(120)})
    texts = [(i, "".join(rng.choice(letters + " ") for _ in range(rng.randrange(40)))) for i in range(50)] + [(90, ""), (91, None), (92, words[0] * 2000)]
    t, w = spark.createDataFrame(texts, "id long, haystack string").repartition(3), spark.createDataFrame([(x,) for x in [*words, "", words[0]]], "needle string")
    want = {(i, x) for i, s in texts for x in words if x in (s or "")}
    for most in (8_000_000, 100):
        monkeypatch.setattr(keywords, "MOST_CHARS", most)
        got = [tuple(r) for r in keywords.containing(t, w).collect()]
        assert len(got) == len(want) and set(got) == want
    assert keywords.containing(t, w.limit(0)).count() == keywords.containing(t.limit(0), w).count() == 0


def test_many_keyword_topics(spark):
    """20,000 keywords, many subscriptions of one, and forms that fold to one word."""
    a = spark.createDataFrame([(1, "Ａlpha w19999", "", "c", [], "s"), (2, "nothing", "w1", "c", [], "s")], "id long, title string, summary string, category string, tags array<string>, source_id string")
    topics = [(i, 0, "keyword", f"w{i}") for i in range(20_000)] + [(30_000 + i, 0, "keyword", x) for i, x in enumerate(["ALPHA", "alpha", "Ａlpha"])]
    got = {(r[0], r[1]): r[2] for r in digests.match_topics(a, spark.createDataFrame(topics, "subscription_id long, ord int, topic_type string, topic_value string")).collect()}
    want = {(i, n): [f"关键词：w{i}"] for n, s in ((1, "w19999"), (2, "w1")) for i in (1, 19, 199, 1999, 19999) if f"w{i}" in s}
    assert got == want | {(30_000, 1): ["关键词：ALPHA"], (30_001, 1): ["关键词：alpha"], (30_002, 1): ["关键词：Ａlpha"]}


def test_topics_are_folded_where_they_are_searched(spark, monkeypatch):
    """Articles go through one Python step, not one that folds and one that searches, and found keywords leave in small batches."""
    search, plans = keywords.search, []
    monkeypatch.setattr(keywords, "search", lambda texts, *x: plans.append(texts._jdf.queryExecution().executedPlan().toString()) or search(texts, *x))
    monkeypatch.setattr(keywords, "MOST_FOUND", 5)
    words = [f"w{i}" for i in range(40)]
    texts = [(i, f"Ｗ{i} W{i + 1} Straße", None if i % 2 else f"w{i + 2}", "c", [], "s") for i in range(30)] + [(30, None, None, "c", [], "s")]
    a = spark.createDataFrame(texts, "id long, title string, summary string, category string, tags array<string>, source_id string")
    t = spark.createDataFrame([(k, 0, "keyword", x) for k, x in enumerate([*words, "STRASSE"])], "subscription_id long, ord int, topic_type string, topic_value string")
    df = digests.match_topics(a, t)
    assert len(plans) == 1 and "Python" not in plans[0]
    fold = lambda s: (s or "").replace("Ｗ", "w").casefold()
    want = {(k, r[0]) for k, x in enumerate([*words, "strasse"]) for r in texts if x in fold(r[1]) + "\n" + fold(r[2])}
    got = [(r["subscription_id"], r["article_id"]) for r in df.collect()]
    assert len(got) == len(want) and set(got) == want


def test_articles_without_texts(spark):
    """The rows are those of whole articles; what is joined with the labels has no texts."""
    from lumenfold.plans import tables

    sf = "/root/testdata/sf0.001"
    cut, all_ = tables.articles(spark, sf, whole=False), tables.articles(spark, sf).drop("content")
    node = cut._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().head()
    assert "title#" in (joined := node.children().head().output().mkString(",")) and "text#" not in joined
    assert cut.columns == all_.columns and sorted(cut.collect(), key=repr) == sorted(all_.collect(), key=repr)


def test_elections_join_no_texts(spark):
    """Members of groups have their content's length, so that no join of theirs reads texts, and elect as whole articles do."""
    from lumenfold.plans import duplicates, tables

    sf = "/root/testdata/sf0.001"
    rows, todo, joined = duplicates.members(spark, sf), [], []
    todo.append(rows._jdf.queryExecution().optimizedPlan())
    while todo:
        node = todo.pop()
        below = [node.children().apply(k) for k in range(node.children().size())]
        joined += [x.output().mkString(",") for x in below] if node.nodeName() == "Join" else []
        todo += below
    assert len(joined) >= 4 and not any("text#" in x for x in joined)
    whole = duplicates.dedup_groups(spark, sf).join(tables.articles(spark, sf), "id")
    elected = lambda x: sorted(map(tuple, dedup.elect(x).collect()))
    assert elected(rows) == elected(whole) and len(elected(rows)) > 0
    assert sorted(dedup.relation_rows(rows, duplicates.linked(spark, sf)).collect(), key=repr) == sorted(dedup.relation_rows(whole, duplicates.linked(spark, sf)).collect(), key=repr)


def test_pairs_between_bounds():
    """Pairs counted between bounds are those of the histogram by distance; weights common and rare."""
    rng = np.random.default_rng(5)
    rows = lambda k: hamming.Rows(rng.integers(0, 1 << 63, k, dtype=np.uint64) & np.uint64(0xFFFFFFFF0F), np.arange(k), rng.choice([1, 1, 1, 2, 3, 7, 1000], k).astype(np.int64))
    for a, b in ((300, 1000), (1, 70), (90, 1), (700, 40)):
        x, y = rows(a), rows(b)
        for bounds in ((9, 32), (12,), (0, 15), (9, 64)):
            fold = lambda sums, t=bounds: [int(sums[(low + 1) : high + 1].sum()) for low, high in zip((-1, *t), t, strict=False)]
            assert sums_at(hamming.sums_by_bound(x, y, bounds), bounds) == fold(hamming.sums_by_distance(x, y, bounds[-1]))
            assert sums_at(hamming.sums_below(x, bounds[-1], bounds), bounds) == fold(hamming.sums_below(x, bounds[-1]))


def sums_at(sums, bounds):
    assert sums.sum() == sums[list(bounds)].sum()
    return [int(sums[b]) for b in bounds]


def test_pairs_within_groups_between_bounds(spark):
    """Small groups and large ones; what large ones cost does not show in their bytes, so their tasks are not merged."""
    rng = np.random.default_rng(6)
    rows = [(g, int(v), int(n)) for g, size in (("a", 2), ("b", 60), ("c", 300), ("d", 1)) for v, n in zip(np.unique(rng.integers(-(1 << 20), 1 << 20, size)), rng.choice([1, 1, 2, 9], size), strict=False)]
    values = spark.createDataFrame(rows, "g string, simhash long, n long")
    exact = {r["distance"]: r["w"] for r in hamming.counts_within(values).collect()}
    found = hamming.counts_within(values, (9, 64))
    total = lambda got, low, high: sum(w for d, w in got.items() if low < d <= high)
    got = {r["distance"]: r["w"] for r in found.collect()}
    assert total(exact, -1, 9) > 0 and [total(got, *x) for x in ((-1, 9), (9, 64))] == [total(exact, *x) for x in ((-1, 9), (9, 64))]
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


# Rate limits


def folded(requests, limit, made=(), seconds=3600):
    """One request after the other."""
    created, out = list(made), {}
    for i, email, ip, at in sorted(requests, key=lambda r: (r[3], r[0])):
        recent = [r for r in created if at - timedelta(seconds=seconds) <= r[3]]
        by = "email" if sum(r[1] == email for r in recent) >= limit else "ip" if ip and sum(r[2] == ip for r in recent) >= limit else None
        out[i] = by
        if not by:
            created.append((i, email, ip, at))
    return out


def some_requests(seed, n=220):
    rng = random.Random(seed)
    return [(i, f"u{rng.randrange(12)}@x.org", rng.choice([None, "1.1.1.1", "2.2.2.2", "3.3.3.3"]), T0 + timedelta(seconds=rng.randrange(0, 6 * 3600, 300))) for i in range(n)]


REQUEST = "id long, email string, ip string, at timestamp"


@pytest.mark.parametrize("limit", [1, 3])
def test_rate_decisions(spark, limit):
    rows = some_requests(limit)
    made = [(-1, "u1@x.org", "1.1.1.1", T0 - timedelta(minutes=30)), (-2, "u2@x.org", None, T0 - timedelta(minutes=60)), (-3, "u3@x.org", None, T0 - timedelta(minutes=61))]
    for before in ([], made):
        got = limits.rate_decisions(spark.createDataFrame(rows, REQUEST).repartition(3), limit, spark.createDataFrame(before, REQUEST) if before else None)
        assert {r["id"]: r["refused"] for r in got.collect()} == folded(rows, limit, before)
    assert set(folded(rows, limit).values()) == {None, "email", "ip"}
    assert limits.rate_decisions(spark.createDataFrame([], REQUEST), limit).count() == 0


def test_rate_limits_of_a_stream(spark, tmp_path):
    """Batches in order of time give the decisions of one fold; a batch that runs again writes the same."""
    rows = sorted(some_requests(9), key=lambda r: (r[3], r[0]))
    cut = [k for k in range(1, len(rows)) if rows[k][3] != rows[k - 1][3]]
    edges = [0, *sorted(random.Random(1).sample(cut, 3)), len(rows)]
    for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        spark.createDataFrame(rows[a:b], REQUEST).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(REQUEST).parquet(f"{tmp_path}/in/*")
        ingest.limit_requests(stream, f"{tmp_path}/out", f"{tmp_path}/state", 3).awaitTermination()
    assert {r["id"]: r["refused"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == folded(rows, 3)


def test_rate_limits_of_nested_keys_settle_at_once(spark, monkeypatch):
    """Addresses that have one network address each, most of them refused: one round, one table is written."""
    rng, tags = random.Random(4), []
    users = [(u, rng.randrange(40)) for u in range(600)]
    rows = [(i, f"u{u}@x.org", f"1.1.1.{u % 3}", T0 + timedelta(seconds=30 * s)) for i, (u, s) in enumerate((u % 12, s) for u, s in users)]
    write = limits.stored
    monkeypatch.setattr(limits, "stored", lambda df, tag: tags.append(tag) or write(df, tag))
    got = limits.rate_decisions(spark.createDataFrame(rows, REQUEST).repartition(3), 4)
    want = folded(rows, 4)
    assert {r["id"]: r["refused"] for r in got.collect()} == want and {None, "ip"} <= set(want.values())
    assert tags == ["decisions"]


def test_limited_requests_keep_their_columns_in_a_file_an_hour(spark, tmp_path):
    """Rows of six tasks: an hour of a batch is one file, further columns stay, and a request of no network address too."""
    rows = [(*r, f"note {r[0]}") for r in some_requests(5)]
    schema = f"{REQUEST}, note string"
    spark.createDataFrame(rows, schema).repartition(6).write.parquet(f"{tmp_path}/in/0")
    ingest.limit_requests(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), f"{tmp_path}/out", f"{tmp_path}/state", 3).awaitTermination()
    got = {r["id"]: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert {i: r["refused"] for i, r in got.items()} == folded([r[:4] for r in rows], 3)
    assert all((r["email"], r["ip"], r["note"]) == (x[1], x[2], x[4]) for x in rows for r in [got[x[0]]])
    hours = [len(list(h.glob("*.parquet"))) for h in (tmp_path / "out" / "batch=0").glob("hour=*")]
    assert hours == [1] * 6


def test_arrivals_in_order_of_many_files(spark, tmp_path):
    """Each batch is all rows of its part, read from the files of several tasks."""
    from lumenfold.plans import streams

    seen = []

    def run(stream):
        each = lambda batch, n: seen.append((n, sorted(r[0] for r in batch.collect()), batch.select(F.input_file_name()).distinct().count()))
        return ingest.run_available(stream, f"{tmp_path}/state", each)

    streams.in_order(spark, spark.range(300).repartition(4), "id", 3, run)
    assert [n for n, _, _ in seen] == [0, 1, 2] and sum((ids for _, ids, _ in seen), []) == list(range(300))
    assert all(files == 4 for _, _, files in seen)


def test_registered_rate_limits(spark):
    from lumenfold.plans import streams

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in streams.requests(spark, sf).collect()]
    want = folded(rows, streams.REQUESTS)
    assert {r["id"]: r["refused"] for r in streams.rate_decisions(spark, sf).collect()} == want
    assert {r["id"]: r["refused"] for r in streams.stream_rate_limits(spark, sf).collect()} == want


def test_create_subscriptions(spark):
    categories = spark.createDataFrame([("数据库", "active"), ("旧", "inactive")], "name string, status string")
    tags = spark.createDataFrame([("Python",)], "name string")
    sources = spark.createDataFrame([("s1", "https://a", "neutral"), ("s2", "https://b", "blacklist"), ("s3", "https://c", "whitelist")], "id string, site_url string, list_type string")
    have = spark.createDataFrame([("old", "taken@x.org", "confirmed"), ("pend", "free@x.org", "pending_confirmation")], "id string, email string, status string")
    have_topics = spark.createDataFrame([("old", "tag", "Python"), ("old", "source", "s1"), ("pend", "tag", "Python")], "subscription_id string, topic_type string, topic_value string")
    tag, url = ("tag", "Python"), ("source", "https://a")
    asked = [
        (1, " A@X.org ", "9", "weekly", 5, [("category", " 数据库 "), ("keyword", " k "), ("keyword", "k")], "created"),
        (2, "bad", "9", "weekly", 5, [tag], "email"),
        (3, "b@x.org", "9", "weekly", 5, [], "topics"),
        (4, "b@x.org", "9", "weekly", 5, [tag] * 21, "topics"),
        (5, "b@x.org", "9", "weekly", 5, [("mood", "x")], "topic_type"),
        (6, "b@x.org", "9", "weekly", 5, [tag, ("category", "旧")], "unknown"),
        (7, "b@x.org", "9", "weekly", 5, [("source", "s2"), ("mood", "x")], "unknown"),
        (8, "b@x.org", "9", "weekly", 5, [("keyword", "k" * 51)], "keyword"),
        (9, "b@x.org", "9", "weekly", 5, [("keyword", " ")], "empty"),
        (10, "b@x.org", "9", "hourly", 5, [tag], "frequency"),
        (11, "b@x.org", "9", "daily", 51, [tag], "max_items"),
        (12, "taken@x.org", "9", None, None, [url, tag, tag], "ALREADY_SUBSCRIBED"),
        (13, "taken@x.org", "8", None, None, [tag], "created"),
        (14, "free@x.org", "8", "DAILY", 50, [tag], "created"),
        (15, "c@x.org", "8", None, None, [("source", "s3"), url], "RATE_LIMITED"),
        (16, "c@x.org", None, None, None, [("source", "s3"), url], "created"),
        (17, "c@x.org", None, None, None, None, "topics"),
    ]
    df = spark.createDataFrame([(i, e, ip, T0 + timedelta(minutes=i), f, m, t) for i, e, ip, f, m, t, _ in asked], f"{REQUEST}, frequency string, max_items int, topics array<struct<topic_type:string,topic_value:string>>")
    outcomes, topics = limits.create_subscriptions(df, categories, tags, sources, have, have_topics, 2, F.lit("secret"))
    rows = {r["id"]: r for r in outcomes.collect()}
    assert {i: r["outcome"] for i, r in rows.items()} == {x[0]: x[-1] for x in asked}
    one = rows[1]
    assert (one["email"], one["frequency"], one["max_items"], one["status"]) == ("a@x.org", "weekly", 5, "pending_confirmation")
    assert one["confirm_expires_at"] - one["at"] == timedelta(hours=48) and len(one["confirm_token"]) == 64
    assert rows[13]["frequency"] == rules.SETTING_DEFAULTS["default_frequency"] and rows[14]["frequency"] == "daily"
    assert rows[2]["subscription_id"] is None and len({r["confirm_token"] for r in rows.values() if r["confirm_token"]}) == 4
    name = {r["subscription_id"]: i for i, r in rows.items()}
    kept = sorted((name[r["subscription_id"]], r["ord"], r["topic_type"], r["topic_value"]) for r in topics.collect())
    assert kept == [(1, 0, "category", "数据库"), (1, 1, "keyword", "k"), (13, 0, "tag", "Python"), (14, 0, "tag", "Python"), (16, 0, "source", "s3"), (16, 1, "source", "s1")]


# Polite fetching


def test_hosts_are_left_in_peace(spark, tmp_path):
    """Recorded times of a host are the interval apart, one task alone talks to it, other hosts do not wait for it."""
    urls = [(f"h{i % 5}" if i < 40 else "big", i, f"http://x/{i}") for i in range(60)]

    def fetcher(url):
        from pyspark import TaskContext

        if url.endswith("/7"):
            raise OSError("no route")
        return {"http_status": 200, "html": str(TaskContext.get().partitionId())}

    got = store.fetch_politely(spark.createDataFrame(urls, "host string, ord int, url string").repartition(7), fetcher, 0.02).collect()
    assert Counter(r["url"] for r in got) == Counter(u for _, _, u in urls)
    assert [r["error"] for r in got if not r["ok"]] == ["no route"]
    for host in {h for h, _, _ in urls}:
        own = sorted((r["at"], r["url"]) for r in got if r["host"] == host)
        assert all(b[0] - a[0] >= 0.02 for a, b in zip(own, own[1:], strict=False))
        assert [u for _, u in own] == [u for h, _, u in urls if h == host]  # in order
        assert len({r["html"] for r in got if r["host"] == host and r["ok"]}) == 1


# Versions


def test_versions(spark, tmp_path):
    path, rows = f"file://{tmp_path}/t", lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    ids = lambda v=None: sorted(r["id"] for r in versions.read(spark, path, v).collect())
    with pytest.raises(LookupError):
        versions.read(spark, path)
    assert versions.commit(rows(1, 2), path) == 1
    assert versions.update(spark, path, lambda df: df.where("id > 1").unionByName(rows(3))) == 2  # reads what it replaces
    assert ids() == [2, 3] and ids(1) == [1, 2]
    broken = rows(9).select(F.raise_error(F.lit("killed")).cast("long").alias("id"))
    with pytest.raises(Exception, match="killed"):
        versions.commit(broken, path)
    assert ids() == [2, 3] and versions.versions(spark, path) == [1, 2]  # a killed write leaves the old version
    versions.commit(rows(4), path, expected=2)
    with pytest.raises(versions.Conflict):
        versions.commit(rows(5), path, expected=2)  # of two writers from one version one wins
    assert ids() == [4]
    with pytest.raises(LookupError):
        versions.read(spark, path, 7)


def test_writers_at_once(spark, tmp_path):
    """Four writers, each adding its row to the newest version: all rows are there in the end."""
    path = f"file://{tmp_path}/t"
    versions.commit(spark.createDataFrame([(0,)], "id long"), path)
    add = lambda i: versions.update(spark, path, lambda df: df.unionByName(spark.createDataFrame([(i,)], "id long")), attempts=10)
    threads = [threading.Thread(target=add, args=(i,)) for i in range(1, 5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(r["id"] for r in versions.read(spark, path).collect()) == list(range(5)) and versions.versions(spark, path) == [1, 2, 3, 4, 5]


# Dedup on arrival


def test_dedup_on_arrival(spark, tmp_path):
    """Four batches, the last run again from a lost checkpoint's point of view: links are those of the whole."""
    rng = random.Random(8)
    words = [f"word{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=60)) for _ in range(4)]
    docs = []
    for i in range(48):
        text = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 12])):
            text[rng.randrange(60)] = rng.choice(words)
        docs.append((i, " ".join(text)))
    docs += [(48, None), (49, "  "), (50, docs[0][1]), (51, docs[3][1])]
    schema = "id long, content string"
    for n in range(4):
        spark.createDataFrame(docs[n * 13 : (n + 1) * 13], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        arrivals.dedup_arrivals(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = {r["id"]: (r["parent"], r["relation_type"], r["evidence"]) for r in spark.read.parquet(f"{tmp_path}/out/links").collect()}
    prints = store.stored(dedup.fingerprints(spark.createDataFrame(docs, schema)), "prints")
    links = dedup.links(prints)
    want = {r["id"]: (r["parent"], r["relation_type"], r["evidence"]) for r in links.collect()}
    want |= {r["article_id"]: (r["target_article_id"], "related", r["evidence"]) for r in dedup.related(prints, links).collect()}
    assert got == want and {"exact_duplicate", "near_duplicate", "related"} == {x[1] for x in got.values()}
    values = [r["simhash"] for r in spark.read.parquet(f"{tmp_path}/out/values").collect()]
    assert len(values) == len(set(values)) == prints.select("simhash").distinct().count()


def test_arrivals_keep_tables_not_keyed_state(spark, tmp_path):
    """A copy, a known value with another content, and a new article in a later batch; no state of its own for each key."""
    schema = "id long, content string"
    for n, docs in enumerate(([(5, "a b c d"), (7, "x y z")], [(1, "a b c d"), (2, "A b c d"), (3, "x y z")])):
        spark.createDataFrame(docs, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        arrivals.dedup_arrivals(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = {r["id"]: (r["parent"], r["relation_type"]) for r in spark.read.parquet(f"{tmp_path}/out/links").collect() if r["id"] != 7}
    assert got == {1: (5, "exact_duplicate"), 2: (5, "near_duplicate"), 3: (7, "exact_duplicate")}
    assert not (tmp_path / "state" / "state").exists()
