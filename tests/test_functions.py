import hashlib
import re
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenfold.functions import html, rules, text, urls, vectors


def one(spark, c, **row):
    df = spark.createDataFrame([tuple(row.values())], list(row)) if row else spark.range(1)
    return df.select(c.alias("v")).first()["v"]


def reference_simhash(s):
    words = re.findall(r"[A-Za-z0-9_]+", s.lower())
    cjk = "".join(x for x in s if "一" <= x <= "鿿")
    tokens = words + [cjk[i : i + 2] for i in range(len(cjk) - 1)]
    votes = [0] * 64
    for t in tokens:
        h = int.from_bytes(hashlib.md5(t.encode()).digest()[:8], "big")
        for k in range(64):
            votes[k] += 1 if h >> k & 1 else -1
    u = sum(1 << k for k in range(64) if votes[k] > 0) if tokens else 0
    return u - (1 << 64) if u >> 63 else u


def test_normalising(spark):
    rows = spark.createDataFrame([(0, "  a   b\n\nc "), (1, "ＡＩ　x​"), (2, None), (3, "é\xa0 z")], "id int, s string")
    got = {r["id"]: r["n"] for r in text.with_normal(rows, "s", "n").collect()}
    assert got == {0: "a b c", 1: "AI x", 2: "", 3: "é z"}


def test_separators_are_white_space(spark):
    """As str.split() has it: the four ASCII separators too."""
    rows = [(" a\x1c\x1db\x1e c\x1f",), ("\x1fx",), ("a\x85b\u2003c\u00a0d",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(text.normalize_content(F.col("t"))).collect()]
    assert got == [" ".join(unicodedata.normalize("NFKC", t).split()) for (t,) in rows]


def test_fold(spark):
    assert one(spark, text.fold_text(F.lit("Ｋｕｂｅ Straße"))) == "kube strasse"


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab AB_1中文字，é", max_size=30), min_size=1, max_size=20))
def test_simhash_forms_agree(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, normal string")
    want = {i: reference_simhash(x) for i, x in enumerate(texts)}
    assert {r["id"]: r["simhash"] for r in rows.select("id", text.simhash(F.col("normal")).alias("simhash")).collect()} == want
    assert {r["id"]: r["simhash"] for r in text.simhash_native(rows, "id", "normal").collect()} == want


def test_similarity_of_hashes(spark):
    got = one(spark, F.array(text.simhash_similarity(F.lit(0).cast("long"), F.lit(-1).cast("long")), text.simhash_similarity(F.lit(7).cast("long"), F.lit(6).cast("long"))))
    assert got == [0.0, 1 - 1 / 64]


def test_scalars(spark):
    assert one(spark, text.mask_email(F.lit("a@x.org"))) == "a*@x.org"
    assert one(spark, text.mask_email(F.lit("nobody"))) == "***"
    assert one(spark, text.normalize_email(F.lit(" A@B.Org "))) == "a@b.org"
    assert one(spark, text.normalize_email(F.lit("a b@c"))) is None
    assert one(spark, text.summarize(F.lit("x " * 300))) == ("x " * 100).rstrip() + "…"
    assert one(spark, text.title_quality(F.lit(" 首页 "))) == 2 - 100
    assert one(spark, text.keyword_similarity(F.lit(""), F.lit(" "))) == 1.0
    assert one(spark, text.keyword_similarity(F.lit(""), F.lit("x"))) == 0.0
    assert one(spark, text.keyword_similarity(F.lit("ab c"), F.lit("ABC"))) == 1.0
    assert one(spark, text.point_text(F.lit("n"), F.lit(""), F.array(F.lit("c"), F.lit("d")))) == "n\n\nc\nd"
    assert one(spark, text.parse_bool(F.lit(" Yes "))) is True
    assert one(spark, text.describe_topic(F.lit("source"), F.lit("s1"), F.lit("Site"))) == "来源：Site"
    assert one(spark, text.client_ip(F.lit(" 1.2.3.4 , 5.6.7.8"))) == "1.2.3.4"
    assert one(spark, text.link(F.lit("https://x.org//"), "/confirm/", F.lit("t"))) == "https://x.org/confirm/t"
    assert one(spark, text.clean_array(F.array(F.lit(" a "), F.lit(" ")))) == ["a"]
    assert one(spark, text.published_label(F.lit(None).cast("timestamp"))) == rules.UNKNOWN_TIME
    assert one(spark, text.near_evidence(F.lit(0.90625), 0.9)) == "SimHash 相似度 0.906 ≥ 阈值 0.90"


def test_entry_pages(spark):
    cases = [
        ("https://blog.example.com/", "https://blog.example.com", True), ("http://blog.example.com/", "https://blog.example.com/", True), ("https://blog.example.com/posts/1", "https://blog.example.com/", False),
        ("https://other.example.com/", "https://blog.example.com/", False), ("", "https://blog.example.com/", False), ("https://Blog.example.com:80?x=1", "https://blog.example.com:80/", True),
    ]
    rows = spark.createDataFrame(cases, "url string, site string, want boolean")
    assert rows.where(urls.is_entry_page(F.col("url"), F.col("site")) != F.col("want")).count() == 0


def test_link_scores(spark):
    score = lambda u, t: one(spark, urls.article_score(F.lit(u), F.lit(t)))
    assert score("https://x.org/2024/05/a.html", "A long enough title") == 3 + 2 + 2 + 1
    assert score("https://x.org/about", "关于") == -2 - 3 - 3
    assert score("https://x.org/blog/one", "") == 3 + 1


def test_vectors(spark):
    arr = lambda *x: F.array(*map(F.lit, map(float, x))) if x else F.array().cast("array<double>")
    assert one(spark, vectors.cosine(arr(1, 0), arr(1, 0))) == 1.0
    assert one(spark, vectors.cosine(arr(1, 0), arr(0, 1))) == 0.0
    assert one(spark, vectors.cosine(arr(1), arr(1, 0))) == 0.0
    assert one(spark, vectors.cosine(arr(), arr())) == 0.0
    assert one(spark, vectors.cosine(arr(0, 0), arr(1, 0))) == 0.0
    assert vectors.sane_thresholds(0.0, None) == (0.80, 0.92)
    assert vectors.sane_thresholds(0.5, 0.9) == (0.80, 0.92)


PAGE = """<html><head><title>Site: The real one</title><meta name="author" content=" Ann ">
<script type="application/ld+json">{"datePublished": "2026-09-01T10:00:00+08:00", "author": {"name": "Bob"}}</script><script type="application/ld+json">{broken</script></head>
<body><nav><a href="/n">navigation</a></nav><article><h1>Site</h1><p>First <b>part<p>Second paragraph here</p><ul><li>item <p>nested</p></li></ul></article><footer>foot</footer></body></html>"""


def test_parsing():
    got = html.parse_page(PAGE)
    assert got["title"] == "The real one"
    assert got["author"] == "Ann"
    assert got["published_at"].isoformat() == "2026-09-01T02:00:00"
    assert got["error"] is None
    blocks = got["content"].split("\n\n")
    assert blocks[0].startswith("First part") and "Second paragraph here" in blocks and blocks[-2:] == ["item nested", "nested"]
    assert "navigation" not in got["content"] and "foot" not in got["content"]


def test_parse_errors():
    assert html.parse_page(" ")["error"] == "原始 HTML 为空"
    assert html.parse_page("<p>some text that is long</p>")["error"] == "未能提取标题"
    assert html.parse_page("<title>t</title><p>short</p>")["error"] == "未能提取有效正文"
    assert html.parse_page("<title>only title</title><body>" + "plain words " * 3)["content"].startswith("plain words")


def test_link_ratio():
    assert html.link_ratio_of("") == 1.0
    assert html.link_ratio_of("<title>ab</title><a href=x>cd</a><script>zzzz</script>") == 2 / 5


def test_links(spark):
    page = '<a href="/a#x">A</a><a href="#t">t</a><a href="mailto:x@y.z">m</a><a href="https://o.org/b"> B <i>c</i></a>'
    rows = spark.createDataFrame([(page, "https://h.org/i/")], "h string, u string").select(html.page_links(F.col("h"), F.col("u")).alias("l")).first()["l"]
    assert [(r["pos"], r["url"], r["text"]) for r in rows] == [(0, "https://h.org/a", "A"), (1, "https://o.org/b", "B c")]


def test_unicode_form():
    assert unicodedata.normalize("NFKC", "ﬁ") == "fi"


def test_batches_and_tokens_stay_small(spark):
    """Texts go to Python as texts, a thousand rows at a time, and not as lists of their tokens; what a worker remembers is bounded."""
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
    plan = spark.range(1).select(text.simhash(F.concat(F.col("id").cast("string"), F.lit(" b")))).select("*")._jdf.queryExecution().toString()
    assert "regexp_extract_all" not in plan
    bits, words = text.TokenBits(), ["ab", "b_1", "ab", "x"]
    assert text.simhash_of_text("ab b_1, ab-x", bits) == text.simhash_of(words)
    bits.index = {str(k): k for k in range(text.REMEMBERED)}
    assert text.simhash_of_text("ab b_1, ab-x", bits) == text.simhash_of(words) and len(bits.index) == 3
    assert text.simhash_of_text("日本 x 語", bits) == text.simhash_of(["x", "日本", "本語"])


def test_references_without_a_semicolon():
    """The queries' SQL takes references with a semicolon alone; browsers, and the parser unless asked otherwise, others too."""
    page = "<title>a&amp;&amp</title><h1>a&amp;&amp</h1><script>x='&amp'</script><p>" + "word " * 60 + "&lt;&copy &x; &#39;&#39 AT&T</p><a href='/q?a=1&lt=2&amp;b'>b&gt</a>"
    loose, strict = html.parse_page(page), html.parse_page(page, True)
    assert loose["title"] == "a&&" and strict["title"] == "a&&amp"
    assert strict["content"].endswith("<&copy &x; '&#39 AT&T") and "© " in loose["content"]
    root = html.tree(page, True)
    link = root.first(lambda x: x.tag == "a")
    assert link.attrs["href"] == "/q?a=1&lt=2&b" and link.text() == "b&gt"
    assert root.first(lambda x: x.tag == "script").text() == "x='&amp'"
    assert html.link_ratio_of("<a href=x>&amp</a>bcd") == 1 / 5 and html.link_ratio_of("<a href=x>&amp</a>bcd", True) == 4 / 8


def test_native_simhash_shuffles_texts_not_tokens(spark):
    """One shuffle by the text's key: tokens do not leave the task that reads them."""
    rows = spark.createDataFrame([(1, "a b c"), (2, "")], "id long, normal string")
    plan = text.simhash_native(rows, "id", "normal")._jdf.queryExecution().executedPlan().toString()
    assert "token" not in "".join(x for x in plan.splitlines() if "Exchange" in x)


def test_titles_of_pages_without_an_article(spark):
    rows = [("<h1>Éaux.</h1><article><p>few</p></article>",), ("<title>A</title><h1> A &amp b&lt; </h1>",), ("<p>no title</p>",), ("",), (None,), ("<script type='application/ld+json'>{\"headline\": \"H\"}</script>",)]
    got = [r[0] for r in spark.createDataFrame(rows, "h string").select(html.page_title(F.col("h"), terminated=True)).collect()]
    assert got == ["Éaux.", "A &amp b<", "", "", None, "H"]


def test_fingerprints_in_one_step(spark):
    """A text goes to Python once, and hash and SimHash are those of the functions that take one step each."""
    from lumenfold.operators import dedup

    texts = ["", " ", "plain  Text_1\n a\x1cb", "ＡＩ　x\u200b y\ufeff", "é\xa0 É\x85z", "日本 X 語 ﬁ K İstanbul", "\u200b", "a\u2028\u2029b \t", "x" * 5000, "ß ſ ① ½", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    plain = text.with_normal(rows.where(F.trim(F.coalesce("content", F.lit(""))) != ""), "content", "n")
    want = plain.select("id", F.sha2("n", 256).alias("content_hash"), text.simhash(F.col("n")).alias("simhash"))
    got = dedup.fingerprints(rows)
    assert sorted(got.collect()) == sorted(want.collect())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_replace" not in plan
