import random
from collections import Counter
from datetime import datetime, timedelta
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import html, rules, text
from lumenfold.operators import browse, classify, crawl, dedup, digests, hamming, insights, knowledge, state
from lumenfold.sources import store

T0 = datetime(2026, 9, 14, 10)
MEMBER = "id long, weight double, published_at timestamp, content string, is_accessible boolean, title string, created_at timestamp, group_key string"


def member(i, weight=1.0, published=None, content="内容", ok=True, title="正常标题", created=0):
    return (i, weight, published, content, ok, title, T0 + timedelta(hours=created), "g")


@pytest.mark.parametrize(
    ("better", "worse"),
    [
        (member(2, weight=9.0), member(1, published=T0, content="很长的内容" * 9)),
        (member(2, published=T0), member(1, published=T0 + timedelta(days=1))),
        (member(2, content="long content"), member(1)),
        (member(2, weight=0.5), member(1, weight=9.0, ok=False)),
        (member(2), member(1, title="首页")),
        (member(2, created=0), member(1, created=1)),
        (member(1), member(2)),
    ],
)
def test_election(spark, better, worse):
    assert dedup.elect(spark.createDataFrame([worse, better], MEMBER)).first()["primary_id"] == better[0]


def key_of(a):
    return (not a["ok"], -a["w"], a["p"] is None, a["p"] or 0, -len(a["c"]), -(len(a["t"]) - (100 if "首页" in a["t"] else 0)), a["id"])


def simulate(arts, threshold=0.90):
    """One pass in order of id, article by article."""
    links, rows, group_of, primary, members = {}, {}, {}, {}, {}
    for a in arts:
        earlier = [b for b in arts if b["id"] < a["id"]]
        same = [b for b in earlier if b["hash"] == a["hash"]]
        if same:
            links[a["id"]] = (same[0]["id"], "exact_duplicate", 1.0)
        elif earlier:
            d, b = min((bin((a["sim"] ^ b["sim"]) & (2**64 - 1)).count("1"), b["id"]) for b in earlier)
            if d <= 6:
                links[a["id"]] = (b, "near_duplicate", 1 - d / 64)
        if a["id"] not in links:
            continue
        parent, kind, s = links[a["id"]]
        g = group_of.get(parent)
        if g is None:
            g = group_of[parent] = parent
            primary[g], members[g] = parent, [parent]
            rows[parent] = (kind, 1.0, rules.PRIMARY_EVIDENCE)
        group_of[a["id"]] = g
        members[g].append(a["id"])
        rows[a["id"]] = (kind, s, "own")
        best = min((x for x in arts if x["id"] in members[g]), key=key_of)["id"]
        if best != primary[g]:
            near = any(rows[m][0] == "near_duplicate" for m in members[g])
            for m in members[g]:
                k, sim, ev = rows[m]
                k = "near_duplicate" if near else k
                rows[m] = (k, 1.0, rules.PRIMARY_EVIDENCE) if m == best else (k, 1.0, None) if m == primary[g] else (k, sim, ev)
            primary[g] = best
    return {m: (group_of[m], primary[group_of[m]], *rows[m]) for m in rows}


@pytest.mark.parametrize("seed", range(4))
def test_groups_and_relation_rows(spark, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(4)]
    arts = []
    for i in range(30):
        sim = rng.choice(base)
        for _ in range(rng.randrange(8)):
            sim ^= 1 << rng.randrange(64)
        if arts and rng.random() < 0.25:
            twin = rng.choice(arts)
            sim, h = twin["sim"] % (1 << 64), twin["hash"]
        else:
            h = f"h{i}"
        arts.append({"id": i, "sim": sim - (1 << 64) if sim >> 63 else sim, "hash": h, "ok": rng.random() < 0.8, "w": float(rng.randrange(3)), "p": rng.choice([None, 1, 2, 3]), "c": "x" * rng.randrange(1, 4), "t": rng.choice(["首页", "title", "tt"])})
    want = simulate(arts)
    prints = spark.createDataFrame([(a["id"], a["hash"], a["sim"]) for a in arts], "id long, content_hash string, simhash long")
    linked = dedup.links(prints)
    info = spark.createDataFrame([(a["id"], a["w"], None if a["p"] is None else datetime(2026, 1, a["p"]), a["c"], a["ok"], a["t"], T0 + timedelta(seconds=a["id"])) for a in arts], MEMBER.rsplit(",", 1)[0])
    got = {}
    for r in dedup.relation_rows(dedup.groups(linked).join(info, "id"), linked).collect():
        got[r["article_id"]] = (r["target_article_id"], r["relation_type"], round(r["similarity"], 6), r["is_primary"], r["evidence"])
    own = {r["id"]: r["evidence"] for r in linked.collect()}
    assert got == {m: (p, k, round(s, 6), m == p, own[m] if e == "own" else e) for m, (_, p, k, s, e) in want.items()}


def clustered(n, seed, bits=64):
    """Distinct values, most of them few bits away from one of three."""
    rng = random.Random(seed)
    base, found = [rng.getrandbits(bits) for _ in range(3)], {}
    while len(found) < n:
        v = rng.choice(base)
        for _ in range(rng.randrange(12)):
            v ^= 1 << rng.randrange(bits)
        found[hamming.signed(v)] = rng.randrange(1, 4)
    order = list(found)
    rng.shuffle(order)
    return [(v, 10 * k, found[v]) for k, v in enumerate(order)]


def hamming_plans(values, distance, monkeypatch):
    """Tiles; tables of all numbers of blocks; tables with split keys."""
    sample = np.array([v for v, _, _ in values], np.int64).view(np.uint64)
    yield hamming.Plan(distance, [], [], [], len(values))
    for blocks in range(distance + 1, distance + 4):
        tables = list(combinations(range(blocks), blocks - distance))
        if len(tables) <= 60:
            yield hamming.Plan(distance, hamming.deal_bits(sample, blocks), tables, [], len(values))
    with monkeypatch.context() as m:
        m.setattr(hamming, "HOT_KEY", 8)
        m.setattr(hamming, "PAIR_S", 1.0)  # tiles are dear
        plan = hamming.plan_for(sample, len(values), distance)
        assert plan.tables and (plan.hot or not distance)
        yield plan


@pytest.mark.parametrize("distance", [0, 3, 6])
def test_hamming_joins_lose_nothing(spark, distance, monkeypatch):
    values = clustered(160, distance)
    df = spark.createDataFrame(values, "simhash long, first_id long, n long").repartition(3)
    want, near, sums = set(), {}, Counter()
    for x, fx, nx in values:
        for y, fy, ny in values:
            d = bin((x ^ y) & (2**64 - 1)).count("1")
            if d <= distance and fy < fx:
                want.add((min(x, y), max(x, y), d))
                sums[d] += nx * ny
                near[fx] = min(near.get(fx, (99, 0)), (d, fy))
    for plan in hamming_plans(values, distance, monkeypatch):
        got = [tuple(r) for r in hamming.pairs(df, distance, plan).collect()]
        assert len(got) == len(want) and set(got) == want
        assert {r["distance"]: r["w"] for r in hamming.counts(df, distance, plan).collect()} == sums
        assert {r["id"]: (r["distance"], r["nearest"]) for r in hamming.nearest(df, distance, plan).collect()} == near


def test_hamming_tiles(spark, monkeypatch):
    """Many tiles, the related tier's distance, ties, and a table without rows."""
    monkeypatch.setattr(hamming, "TILE", 20)
    values = clustered(150, 9)
    df = spark.createDataFrame(values, "simhash long, first_id long, n long")
    near = {}
    for x, fx, _ in values:
        best = min(((bin((x ^ y) & (2**64 - 1)).count("1"), fy) for y, fy, _ in values if fy < fx), default=(99, 0))
        if best[0] <= 32:
            near[fx] = best
    plan = hamming.Plan(32, [], [], [], len(values))
    assert {r["id"]: (r["distance"], r["nearest"]) for r in hamming.nearest(df, 32, plan).collect()} == near
    assert hamming.nearest(df.limit(0), 32).count() == hamming.pairs(df.limit(0), 6).count() == hamming.counts(df.limit(0), 6).count() == 0


def test_hamming_plans_follow_the_data():
    """Evenly spread values take tables when they are many, clustered ones tiles for longer; tables grow with the number."""
    spread = np.random.default_rng(1).integers(0, 2**63, 20_000, np.int64).view(np.uint64)
    assert [len(hamming.plan_for(spread, n, 6).tables) for n in (10**3, 10**7)] == [0, 28]
    tight = spread & np.uint64(0xFFF)
    assert not hamming.plan_for(tight, 10**5, 9).tables
    assert hamming.plan_for(spread, 10**6, 6).meetings < hamming.plan_for(spread, 10**7, 6).meetings


def test_most_distance():
    assert [dedup.most_distance(x) for x in (0.90, 0.90625, 0.5, 1.0, 0.85)] == [6, 6, 32, 0, 9]


def test_quality_cascade(spark):
    rows = [("t", "short"), ("t", "明天 " + "x" * 20 + " Casino"), ("文章目录", "一些链接 一些链接 一些链接"), ("t", "立即购买 和 限时优惠 " + "y" * 200), ("t", "z" * 300)]
    df = spark.createDataFrame(rows, "title string, content string")
    reason = classify.quality_reason(F.col("title"), F.col("content"), exclude=F.array(F.lit("casino"), F.lit("")))
    got = [r[0] for r in df.select(reason).collect()]
    assert got == [rules.SHORT_REASON, "命中排除词: casino", rules.NAV_REASON, "疑似广告页: 立即购买、限时优惠", None]


def test_classification(spark):
    rows = [(0, "深度学习入门", "神经网络 训练 python"), (1, "随笔", "今天天气很好"), (2, "email", "nothing"), (3, "SQL 安全", "加密 数据库")]
    c = classify.classify(F.col("title"), F.col("content"))
    got = {r["id"]: r["c"] for r in spark.createDataFrame(rows, "id int, title string, content string").select("id", c.alias("c")).collect()}
    assert got[0]["category"] == "AI/机器学习" and got[0]["tags"] == ["机器学习", "深度学习", "Python"]
    assert got[1]["category"] is None and got[1]["tags"] == []
    assert got[2]["category"] == "AI/机器学习"  # substrings count
    assert got[3]["category"] == "安全"[:0] + ("数据库" if got[3]["score"] and got[3]["category"] == "数据库" else "安全")
    only = classify.classify(F.col("title"), F.col("content"), allowed={"数据库"})
    assert {r[0] for r in spark.createDataFrame(rows, "id int, title string, content string").select(only["category"]).collect()} == {None, "数据库"}


def test_insights_example(spark):
    """Six articles: one exact copy, one related view, one filtered ad, one without category."""
    cats = spark.createDataFrame([("c1", "AI/机器学习"), ("c2", "数据库"), ("c3", "空")], "id string, name string")
    arts = spark.createDataFrame([(1, "c1", "normal"), (2, "c1", "normal"), (3, "c2", "normal"), (4, None, "normal"), (5, "c1", "filtered"), (6, "c2", "normal")], "id long, primary_category_id string, status string")
    rel = spark.createDataFrame([(1, 1, "g", "exact_duplicate", True), (6, 1, "g", "exact_duplicate", False), (2, 1, None, "related", False)], "article_id long, target_article_id long, group_key string, relation_type string, is_primary boolean")
    dist = {r["name"]: r["articles"] for r in insights.category_distribution(cats, arts, dedup.hidden(rel)).collect()}
    assert dist == {"AI/机器学习": 2, "数据库": 1, "空": 0, rules.UNCATEGORIZED_LABEL: 1}
    assert insights.dedup_stats(arts, rel).first().asDict() == {"exact": 1, "near": 0, "related": 1, "merged": 1, "total": 5, "unique_articles": 4}
    assert {r["article_id"] for r in dedup.members_of(rel, 6).collect()} == {1, 6}
    assert dedup.group_sizes(rel).first()["sources"] == 2
    assert {tuple(r) for r in dedup.related_both_ways(rel.where("relation_type = 'related'")).collect()} == {(1, 2), (2, 1)}


def test_detail(spark):
    arts = spark.createDataFrame([(1, "a", "t1"), (2, "b", "t2"), (3, "c", "t3")], "id long, url string, title string")
    rel = spark.createDataFrame([(1, 1, "g", "exact_duplicate", True), (2, 1, "g", "exact_duplicate", False)], "article_id long, target_article_id long, group_key string, relation_type string, is_primary boolean")
    edges = spark.createDataFrame([(3, 1)], "article_id long, target_article_id long")
    got = browse.detail(arts, rel, edges, 2).first()
    assert got["id"] == 1 and len(got["sources"]) == 2 and got["related"] == [3]
    assert browse.detail(arts, rel, edges, 3).first()["id"] == 3


def test_pages(spark):
    assert [r["id"] for r in browse.page(spark.range(10), [F.desc("id")], 2, 3).collect()] == [6, 5, 4]
    assert browse.page(spark.range(300), [F.col("id")], 0, 1000).count() == 100
    with pytest.raises(ValueError):
        browse.validated(spark.range(1), "id", "digest_status", "nope")


def test_crawl(spark):
    src = spark.createDataFrame([("s", True, "whitelist"), ("b", True, "blacklist")], "id string, is_active boolean, list_type string")
    urls_ = spark.createDataFrame([("s", "https://x.org/p", 1), ("s", "https://x.org/p", 5), ("s", "https://x.org/no/q", 2), ("s", "https://x.org/bad", 3), ("b", "https://y.org/", 1)], "source_id string, url string, position int")
    robots = crawl.robots_rules(spark.createDataFrame([("https://x.org", "User-agent: *\nDisallow: /no")], "origin string, text string"))

    def fetcher(url):
        if url.endswith("bad"):
            raise OSError("down")
        return {"http_status": 200, "html": f"<p>{url}</p>"}

    old = spark.createDataFrame([("s", "https://x.org/bad", "<old>", 200, "fetched", None, T0)], "source_id string, url string, raw_html string, http_status int, status string, error_message string, fetched_at timestamp")
    pages, report = crawl.crawl(src, urls_, robots, fetcher, old, F.lit(T0 + timedelta(hours=1)), seconds=0.01)
    got = {r["url"]: (r["status"], r["raw_html"]) for r in pages.collect()}
    assert got == {"https://x.org/p": ("fetched", "<p>https://x.org/p</p>"), "https://x.org/no/q": ("robots_denied", None), "https://x.org/bad": ("failed", None)}
    assert report.first().asDict() == {"source_id": "s", "total": 3, "fetched": 1, "failed": 1, "robots_denied": 1, "error": None}
    assert [r["url"] for r in crawl.fetched_pages(pages).collect()] == ["https://x.org/p"]


def test_robots_as_the_standard_library(spark):
    """First matching line of the first group that fits, escapes and queries, comments and blank lines."""
    from urllib.robotparser import RobotFileParser

    rng = random.Random(3)
    paths = ["/", "", "/a", "/a/b", "/a%20b", "/s?q=", "/s?q=x", "*", "/é", "/%C3%A9", "/a;p", "/A", "/a#f", "/x?y#z"]
    files = []
    for k in range(60):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            lines += [f"{rng.choice(['User-agent', 'user-AGENT '])}: {rng.choice(['*', 'bot', 'Lumen', 'other', 'lumenbot'])}" for _ in range(rng.randrange(1, 3))]
            lines += [f"{rng.choice(['Disallow', 'Allow', 'allow'])}: {rng.choice(paths)}{rng.choice(['', ' # why'])}" for _ in range(rng.randrange(4))]
            lines += rng.choice([[], [""], ["Crawl-delay: 3"], ["nonsense"]])
        files.append((f"https://h{k}.org", "\n".join(lines)))
    files.append(("https://none.org", None))
    urls_ = [(o + p + more,) for o, _ in files for p in paths if p[:1] in ("", "/") for more in ("", "c") if p or not more]
    robots = crawl.robots_rules(spark.createDataFrame(files, "origin string, text string"))
    for agent in ("*", "LumenBot/2.0", "nobody"):
        got = {r["url"]: r["allowed"] for r in crawl.allowed_by_robots(spark.createDataFrame(urls_, "url string"), robots, agent).collect()}
        for o, t in files:
            parser = RobotFileParser()
            parser.parse((t or "").splitlines())
            for (u,) in urls_:
                if u.startswith(o):
                    assert got[u] == parser.can_fetch(agent, u), (agent, u, t)


def test_crawl_from_index_pages(spark):
    src = spark.createDataFrame([("s", True, "whitelist", "https://x.org/"), ("d", True, "neutral", "https://d.org/"), ("f", True, "neutral", "https://f.org/"), ("b", True, "blacklist", "https://b.org/")], "id string, is_active boolean, list_type string, site_url string")
    robots = crawl.robots_rules(spark.createDataFrame([("https://d.org", "User-agent: *\nDisallow: /"), ("https://x.org", "User-agent: *\nDisallow: /posts/no")], "origin string, text string"))

    def fetcher(url):
        if url == "https://x.org/":
            return {"http_status": 200, "html": '<a href="/posts/1">A first article</a><a href="/posts/no">A closed article</a><a href="/posts/2">A second article</a><a href="https://y.org/">elsewhere</a>'}
        return {"http_status": 500 if "f.org" in url else 200, "html": url}

    none = spark.createDataFrame([], "source_id string, url string, raw_html string, http_status int, status string, error_message string, fetched_at timestamp")
    pages, report = crawl.crawl(src, None, robots, fetcher, none, F.lit(T0), seconds=0.01)
    assert {r["url"]: r["status"] for r in pages.collect()} == {"https://x.org/posts/1": "fetched", "https://x.org/posts/no": "robots_denied", "https://x.org/posts/2": "fetched"}
    assert {r["source_id"]: (r["total"], r["fetched"], r["failed"], r["robots_denied"]) for r in report.collect()} == {"s": (4, 3, 0, 1), "d": (1, 0, 0, 1), "f": (1, 0, 1, 0)}


def test_a_bad_source_stops_no_other(spark):
    """Fetchers that raise, give no dict, bytes or odd statuses, index pages that break the parser, sites that are no URL."""
    sites = {"good": "https://g.org/", "broken": "https://b.org/", "none": "https://n.org/", "bytes": "https://y.org/", "odd": "https://o.org/", "gone": "https://x.org/", "no-url": "::::", "null": None}
    src = spark.createDataFrame([(k, True, "neutral", v) for k, v in sites.items()], "id string, is_active boolean, list_type string, site_url string")
    robots = crawl.robots_rules(spark.createDataFrame([], "origin string, text string"))

    def fetcher(url):
        page = '<a href="/posts/1">A first article</a>'
        if url.endswith("/posts/1"):
            return {"http_status": 200, "html": "<![foo[ an article ]]>"}
        return {"https://g.org/": {"http_status": "200", "html": page}, "https://b.org/": {"http_status": 200, "html": page + "<![foo[ x ]]>"}, "https://y.org/": {"http_status": 200, "html": page.encode()}, "https://o.org/": {"http_status": "teapot"}, "https://x.org/": {"http_status": 410}, "https://n.org/": None}[url]

    none = spark.createDataFrame([], "source_id string, url string, raw_html string, http_status int, status string, error_message string, fetched_at timestamp")
    pages, report = crawl.crawl(src, None, robots, fetcher, none, F.lit(T0), seconds=0.01)
    got = {r["source_id"]: (r["total"], r["fetched"], r["failed"], r["error"] is None) for r in report.collect()}
    assert got == {"good": (2, 2, 0, True), "bytes": (2, 2, 0, True)} | {k: (1, 0, 1, False) for k in ("broken", "none", "odd", "gone", "no-url", "null")}
    assert {r["source_id"]: r["error"] for r in report.collect()}["broken"] == rules.BROKEN_PAGE
    parsed = classify.parse_pages(crawl.fetched_pages(pages).select("url", "raw_html"), F.lit("https://g.org/")).collect()
    assert [(r["status"], r["reason"].split(":")[0]) for r in parsed] == [("error", "AssertionError")] * 2


def test_odd_dates_are_no_dates():
    page = '<meta property="article:published_time" content="0900-01-01"><h1>T</h1><article><p>' + "word " * 60 + "</p></article>"
    got = html.parse_page(page)
    assert got["error"] is None and got["published_at"] is None


def test_jdbc(spark):
    """A table written to and read from a database in the JVM's memory, in ranges; none of its rows is lost."""
    url = "jdbc:derby:memory:lumenfold;create=true"
    rows = [(k, k * 7 % 1000, f"n{k}") for k in range(500)] + [(500, None, "none")]
    df = spark.createDataFrame(rows, "id int, k int, name string")
    store.write_jdbc(df, url, "things", 3)
    for got in (store.read_jdbc(spark, url, "things"), store.read_jdbc(spark, url, "things", "k", parts=4), store.read_jdbc(spark, url, "things", "k", (100, 200, 3))):
        assert sorted((r["ID"], r["K"] if r["K"] is not None else -1, r["NAME"]) for r in got.toDF("ID", "K", "NAME").collect()) == sorted((a, -1 if b is None else b, c) for a, b, c in rows)
    assert store.read_jdbc(spark, url, "things", "k", parts=4).rdd.getNumPartitions() == 4
    store.write_jdbc(df.limit(0), url, "empty_things")
    assert store.read_jdbc(spark, url, "empty_things", "k", parts=4).count() == 0


def test_discovery(spark):
    page = "".join(f'<a href="/{x}">{x}</a>' for x in ("about", "login", "tags", "home")) + '<a href="/posts/1">A first article</a><a href="/posts/2.html">second one here</a><a href="/posts/1">again</a>'
    df = spark.createDataFrame([(1, "https://h.org/", page)], "page_id long, url string, html string")
    assert [r["link"] for r in crawl.discover(df, limit=2).orderBy("rank").collect()] == ["https://h.org/posts/2.html", "https://h.org/posts/1"]
    assert [r["link"] for r in crawl.discover(df, limit=2, prefer_articles=False).orderBy("rank").collect()] == ["https://h.org/about", "https://h.org/login"]


def test_periods(spark):
    now = F.lit(datetime(2026, 9, 16, 10))
    row = spark.range(1).select(digests.period_start(F.lit("daily"), now), digests.period_end(F.lit("daily"), now), digests.period_start(F.lit("weekly"), now), digests.period_end(F.lit("weekly"), now)).first()
    assert list(row) == [datetime(2026, 9, 16), datetime(2026, 9, 17), datetime(2026, 9, 14), datetime(2026, 9, 21)]


def test_folded_keyword_matches(spark):
    a = spark.createDataFrame([(1, "Ｋｕｂｅｒｎｅｔｅｓ 入门", "", None, ["DevOps"], "s1"), (2, "x", "y", "运维", [], "s2")], "id long, title string, summary string, category string, tags array<string>, source_id string")
    t = spark.createDataFrame([(1, 0, "keyword", "kubernetes"), (1, 1, "tag", "DevOps"), (2, 0, "category", "运维"), (3, 0, "source", "s2"), (4, 0, "keyword", "")], "subscription_id long, ord int, topic_type string, topic_value string")
    got = {(r["subscription_id"], r["article_id"]): r["reasons"] for r in digests.match_topics(a, t).collect()}
    assert got == {(1, 1): ["关键词：kubernetes", "标签：DevOps"], (2, 2): ["类别：运维"], (3, 2): ["来源：s2"]}


def test_delivery_outcomes(spark):
    d = spark.createDataFrame([(1, "pending", None, 0, None), (2, "failed", None, 1, "x"), (3, "sent", T0, 0, None)], "id int, status string, sent_at timestamp, retry_count int, error string")
    o = spark.createDataFrame([(1, True, None), (2, False, "smtp")], "id int, ok boolean, error string")
    got = {r["id"]: (r["status"], r["sent_at"], r["retry_count"], r["error"]) for r in digests.apply_outcomes(d, o, F.lit(T0)).collect()}
    assert got == {1: ("sent", T0, 0, None), 2: ("failed", None, 2, "smtp"), 3: ("sent", T0, 0, None)}


def test_rejects(spark):
    rows = [("a@b.org", 5, [("tag", "x")]), ("bad", 5, [("tag", "x")]), ("a@b.org", 51, [("tag", "x")]), ("a@b.org", 5, []), ("a@b.org", 5, [("keyword", "k" * 51)]), ("a@b.org", 5, [("mood", "x")])]
    df = spark.createDataFrame(rows, "email string, max_items int, topics array<struct<topic_type:string,topic_value:string>>")
    assert [r["reject"] for r in digests.valid_subscriptions(df).collect()] == [None, "email", "max_items", "topics", "keyword", "topic_type"]
    src = spark.createDataFrame([("https://a", 1.0, "neutral", None, None, None), ("ftp://a", 1.0, "neutral", None, None, None), ("https://a", 0.0, "neutral", None, None, None), ("https://a", None, "whitelist", " ", [], None)], "site_url string, weight double, list_type string, focus_area string, include_keywords array<string>, example_urls array<string>")
    assert [r["reject"] for r in state.valid_sources(src).collect()] == [None, "site_url", "weight", "focus"]


def test_settings(spark):
    kv = spark.createDataFrame([("max_items_per_digest", "10")], "key string, value string")
    new, log = state.patch_settings(kv, {"max_items_per_digest": 20, "send_empty_digest": False, "sends_paused": True}, "admin", F.lit(T0))
    assert {(r["key"], r["value"]) for r in new.collect()} == {("max_items_per_digest", "20"), ("sends_paused", "true")}
    assert {(r["key"], r["old_value"], r["new_value"]) for r in log.collect()} == {("max_items_per_digest", "10", "20"), ("sends_paused", "false", "true")}
    for bad in ({"max_items_per_digest": 51}, {"send_window_start_hour": 22, "send_window_end_hour": 8}, {"bounce_pause_threshold": 2}):
        with pytest.raises(ValueError):
            state.patch_settings(kv, bad, "admin", F.lit(T0))
    assert spark.range(1).select(state.parsed_threshold(F.lit("x"))).first()[0] == 0.90


def test_category_changes(spark):
    c = spark.createDataFrame([("1", "a", "active"), ("2", "b", "active")], "id string, name string, status string")
    with pytest.raises(ValueError):
        state.rename_category(c, "1", "b")
    assert state.rename_category(c, "1", "z")[1].first()["new_name"] == "z"
    assert {r["status"] for r in state.set_category_status(c, "1", False)[0].collect()} == {"active", "inactive"}
    made, clash = state.create_unique(c, spark.createDataFrame([("3", "b", "active"), ("4", "d", "active")], "id string, name string, status string"), "name")
    assert made.count() == 3 and clash.first()["name"] == "b"
    assert store.default_categories(c).count() == 0 and store.default_categories(c.limit(0)).count() == 7


def test_coverage(spark):
    pts = spark.createDataFrame([(1, 1, 0, "p", [1.0, 0.1, 0.0]), (2, 1, 1, "q", [0.0, 1.0, 0.0]), (3, 2, 0, "r", [1.0, 0.55, 0.0])], "point_id long, article_id long, pos int, text string, embedding array<double>")
    ent = spark.createDataFrame([(7, "active", [1.0, 0.0, 0.0], "n", "s"), (8, "retired", [0.0, 1.0, 0.0], "n", "s")], "entry_id long, status string, embedding array<double>, name string, summary string")
    for near in (knowledge.nearest_entries(pts, ent, 0.8), knowledge.nearest_vectors(pts, ent, 0.8)):
        rolled = {r["article_id"]: (r["decision"], r["matched_entry_id"]) for r in knowledge.roll_up(knowledge.verdicts(pts, near, 0.80, 0.92)).collect()}
        assert rolled == {1: ("partial", 7), 2: ("new_knowledge", None)}
    judged = knowledge.roll_up(knowledge.verdicts(pts, knowledge.nearest_entries(pts, ent, 0.8), 0.80, 0.92, judge=lambda p, e: F.lit(True)))
    assert {r["article_id"]: r["decision"] for r in judged.collect()} == {1: "partial", 2: "covered"}


def test_greedy_entries(spark):
    pts = spark.createDataFrame([(1, 1, 0, "a", [1.0, 0.0]), (2, 1, 1, "b", [1.0, 0.1]), (3, 2, 0, "a", [0.0, 1.0])], "point_id long, article_id long, pos int, name string, embedding array<double>")
    got = {r["point_id"]: (r["entry_id"], r["is_new"], r["created"]) for r in knowledge.greedy_entries(pts, 0.8, 0.92).collect()}
    assert got == {1: (1, True, True), 2: (1, False, False), 3: (1, True, False)}
    with pytest.raises(ValueError):
        knowledge.greedy_entries(pts, 0.8, 0.92, limit=1)


def test_vectors_of_all_shapes(spark):
    """Missing and ragged vectors: texts decide, or nothing does."""
    pts = spark.createDataFrame([(1, [1.0, 0.0], "abc"), (2, None, "abcd"), (3, [1.0], "zz"), (4, [], "")], "point_id long, embedding array<double>, text string")
    ent = spark.createDataFrame([(7, "active", [1.0, 0.0], "n", ""), (8, "active", None, "abcd", ""), (9, "active", [0.0, 1.0], "q", ""), (10, "retired", [1.0, 0.0], "abcd", "")], "entry_id long, status string, embedding array<double>, name string, summary string")
    got = {(r["point_id"], r["entry_id"]): round(r["similarity"], 6) for r in knowledge.nearest_vectors(pts, ent, 0.3, 3).collect()}
    assert got == {(1, 7): 1.0, (1, 8): round(2 / 3, 6), (2, 8): 1.0}
    assert {(r["point_id"], r["entry_id"]): round(r["similarity"], 6) for r in knowledge.nearest_entries(pts, ent, 0.3, 3).collect()} == got
    assert knowledge.nearest_vectors(pts, ent.limit(0), 0.0).count() == knowledge.nearest_vectors(pts.limit(0), ent, 0.0).count() == 0


def test_knowledge_run(spark):
    """Stored entries, entries made in the run, names, the judge, failures and articles without points."""
    a = spark.createDataFrame([(i, s, k, T0 + timedelta(hours=-i)) for i, s, k in [(1, "normal", None), (2, "normal", "pending"), (3, "normal", None), (4, "normal", None), (5, "filtered", None), (6, "normal", "new"), (7, "normal", None)]], "id long, status string, knowledge_status string, crawled_at timestamp")
    p = lambda *names: [(n, "", []) for n in names]
    x = spark.createDataFrame([(1, True, p("known"), None), (2, True, p("fresh", "known"), None), (3, False, None, "slow"), (4, True, [], None), (5, True, p("known"), None), (7, True, p("fresh2", "between", "named"), None)], "article_id long, ok boolean, points array<struct<name:string,summary:string,claims:array<string>>>, error string")
    e = spark.createDataFrame([(100, "known", "", "active", [1.0, 0.0, 0.0], [50], None), (101, "named", "", "active", [0.0, 0.0, -1.0], None, None)], "entry_id long, name string, summary string, status string, embedding array<double>, article_ids array<long>, merged_into_id long")
    vector = F.create_map(*[F.lit(v) if isinstance(v, str) else F.array(*map(F.lit, v)) for pair in {"known": [1.0, 0.0, 0.0], "fresh": [0.0, 1.0, 0.0], "fresh2": [0.0, 1.0, 0.01], "between": [1.0, 0.55, 0.0], "named": [0.0, 0.0, 1.0]}.items() for v in pair])
    asked = lambda name, entry: True
    decided, articles, entries = knowledge.judge_run(a, x, e, F.element_at(vector, F.col("name")), 0.80, 0.92, F.lit(T0), asked)
    got = {r["article_id"]: (r["decision"], r["matched_entry_id"], r["new_points"], r["covered_points"]) for r in decided.collect()}
    fresh = next(r["entry_id"] for r in entries.collect() if r["name"] == "fresh")
    assert got == {1: ("covered", 100, 0, 1), 2: ("partial", 100, 1, 1), 3: ("pending", None, 0, 0), 4: ("new_knowledge", None, 0, 0), 7: ("partial", fresh, 1, 2)}
    assert {r["id"]: (r["status"], r["knowledge_status"]) for r in articles.collect()} == {1: ("knowledge_duplicate", "covered"), 2: ("normal", "partial"), 3: ("normal", "pending"), 4: ("normal", "new"), 5: ("filtered", None), 6: ("normal", "new"), 7: ("normal", "partial")}
    assert {r["name"]: r["article_ids"] for r in entries.collect()} == {"known": [50], "named": [7], "fresh": [2]}
    why = {r["article_id"]: r["rationale"] for r in decided.collect()}
    assert why[3] == rules.EXTRACTION_FAILED + "slow" and why[4] == rules.NO_POINTS and why[1] == rules.ALL_COVERED % (1, 1.0)
    doubted, _, _ = knowledge.judge_run(a, x, e, F.element_at(vector, F.col("name")), 0.80, 0.92, F.lit(T0))
    assert {r["article_id"]: r["new_points"] for r in doubted.collect()}[7] == 2


def test_extraction_cache(spark):
    a = spark.createDataFrame([(1, "h1", "t", "c"), (2, "h2", "t", "c")], "id long, content_hash string, title string, content string")
    c = spark.createDataFrame([(1, "h1", "ok", ["p"], 1, 10), (2, "old", "ok", ["q"], 1, 5)], "article_id long, fingerprint string, status string, points array<string>, attempts int, tokens long")
    hit, miss = knowledge.cached_extractions(a, c)
    assert [r["article_id"] for r in hit.collect()] == [1] and [r["article_id"] for r in miss.collect()] == [2]
    r = spark.createDataFrame([(2, "h2", False, None, 7)], "article_id long, fingerprint string, ok boolean, points array<string>, tokens long")
    got = {x["article_id"]: (x["status"], x["attempts"], x["tokens"], x["points"]) for x in knowledge.save_extractions(c, r).collect()}
    assert got == {1: ("ok", 1, 10, ["p"]), 2: ("failed", 2, 12, ["q"])}


def test_merge_entries(spark):
    e = spark.createDataFrame([(1, "a", "s1", "active", [3, 1], None), (2, "b", "", "active", [2], None), (3, "c", "s3", "active", [1], None)], "entry_id long, name string, summary string, status string, article_ids array<long>, merged_into_id long")
    got = {r["entry_id"]: r for r in knowledge.merge_entries(e, [3, 2, 1], 9, "new").collect()}
    assert (got[9]["name"], got[9]["summary"], got[9]["article_ids"], got[9]["status"]) == ("new", "s3；s1", [1, 2, 3], "active")
    assert {(got[k]["status"], got[k]["merged_into_id"]) for k in (1, 2, 3)} == {("merged", 9)}
    for bad, ids in ((knowledge.retire(e, 1), [1, 2]), (e, [1]), (e, [1, 1])):
        with pytest.raises(ValueError):
            knowledge.merge_entries(bad, ids, 9, "x")
    with pytest.raises(Exception, match="needs a name"):
        knowledge.create_entries(e, spark.createDataFrame([(5, " ", None)], "entry_id long, name string, summary string")).collect()
    with pytest.raises(Exception, match="scope"):
        s = spark.createDataFrame([(1, "m", "confirmed", "h", None)], "id long, email string, status string, unsubscribe_token_hash string, unsubscribed_at timestamp")
        digests.unsubscribe(s, spark.createDataFrame([("t", "some")], "token string, scope string"), F.lit(T0))[1].collect()


def test_parse_states(spark):
    rows = [(1, "https://s.org/", "<title>t</title>"), (2, "https://s.org/a", None), (3, "https://s.org/b", "<title>t</title><article><p>" + "word " * 50 + "</p></article>"), (4, "https://s.org/c", "<title>t</title><p>立即购买，限时优惠，今天就来</p>")]
    df = classify.parse_pages(spark.createDataFrame(rows, "page_id long, url string, raw_html string"), F.lit("http://s.org"))
    assert {r["page_id"]: r["status"] for r in df.collect()} == {1: "filtered", 2: "error", 3: "pending", 4: "filtered"}


def test_ids_are_stable(spark):
    a, b = (spark.range(1).select(store.natural_id("art", F.lit("u"))).first()[0] for _ in range(2))
    assert a == b and a.startswith("art_")
    assert text.simhash_of([]) == 0


def test_extraction(spark):
    a = spark.createDataFrame([(1, "f1", "One", "text"), (2, "f2", "Two", "boom"), (3, "f3", " ", "text")], "article_id long, fingerprint string, title string, content string")

    def client(title, content):
        if content == "boom":
            raise TimeoutError("slow")
        return knowledge.stub_client(title, content)

    got = {r["article_id"]: (r["ok"], [p["name"] for p in r["points"] or []], r["error"]) for r in knowledge.extract_points(a, client).collect()}
    assert got == {1: (True, ["One"], None), 2: (False, [], "slow"), 3: (True, [], None)}


def test_envelope(spark):
    import json

    body = json.loads(browse.envelope(spark.range(5), spark.range(2), 1, 2).first()["body"])
    assert body == {"total": 5, "page": 1, "page_size": 2, "items": [{"id": 0}, {"id": 1}]}
    assert {r["allowed"] for r in crawl.gate(spark.range(2), False).collect()} == {False}


def test_a_page_without_an_article_has_no_summary(spark):
    rows = [(1, "http://s.org/a/1", "<h1>Short</h1><article><p>few</p></article>"), (2, "http://s.org/a/2", f"<h1>Long</h1><article><p>{'word ' * 60}</p></article>"), (3, "http://s.org/a/3", ""), (4, "http://s.org/", "<h1>Home</h1>")]
    df = classify.parse_pages(spark.createDataFrame(rows, "page_id long, url string, raw_html string"), F.lit("http://s.org"))
    got = {r["page_id"]: (r["status"], r["summary"]) for r in df.collect()}
    assert got == {1: ("error", None), 2: ("pending", ("word " * 40).rstrip() + "…"), 3: ("error", None), 4: ("filtered", None)}
