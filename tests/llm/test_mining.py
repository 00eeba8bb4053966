"""Operators 11 to 13 against brute force, on odd rows: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing
columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import divergence, hard_negatives, line_dedup

EXTRA = ["id", "body", "key", "n", "t1", "hits", "term", "count", "docs", "salt", "other", "zero", "p", "q", "vec", "anchor", "place", "score", "rank", "value", "item", "part"]


def clashing(df):
    for name in EXTRA:
        if name not in df.columns:
            df = df.withColumn(name, F.lit("x"))
    return df


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# Line dedup


def line_rows():
    rng = random.Random(1)
    common = ["Subscribe NOW", "ÉCOLE é", "x", " ", "\t", "a\x1cb"]
    out = []
    for i in range(40):
        lines = [rng.choice([*common, f"own line {i} {k}"]) for k in range(rng.randrange(1, 9))]
        out.append((i, "\n".join(rng.choice(["", " ", "\t\x0b\x0c"]) + (x.upper() if rng.random() < 0.3 and x.isascii() else x) + rng.choice(["", " \r"]) for x in lines)))
    long_ = "\n".join(f"line {k % 5000}" for k in range(20_000))
    out += [(100, None), (101, ""), (102, "\n\n"), (103, "subscribe now"), (104, "subscribe now\n\nsubscribe now\n"), (105, long_), (105, long_), (None, "x\nlast of all"), (None, None), (7, out[7][1])]
    return out


def cleaned(rows, least, chars):
    key = lambda line: lowered(line.strip(" \t\n\x0b\x0c\r"))
    held = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    gone = {k for k, n in held.items() if n >= least and len(k) >= chars}
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if key(x) not in gone]
        out[i, "\n".join(left), len(lines), len(lines) - len(left)] += 1
    return out


@pytest.mark.parametrize(("least", "chars", "few"), [(10, 1, True), (2, 3, False), (1, 1, True)])
def test_line_dedup(spark, monkeypatch, least, chars, few):
    if not few:
        monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", -1)
        monkeypatch.setattr(line_dedup, "GATHERED", 7)
    rows = line_rows()
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    got = line_dedup.drop_lines(docs, least_docs=least, least_chars=chars)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert Counter(tuple(r) for r in got.collect()) == cleaned(rows, least, chars)
    assert line_dedup.drop_lines(docs.limit(0)).count() == 0


def test_line_runs(spark):
    """Batches taken up one by one, with compaction, in one session and going on in another, count as all at once."""
    rng = random.Random(2)
    batches = [[(f"k{int(rng.expovariate(0.1))}".encode(), rng.randrange(1, 3)) for _ in range(60)] for _ in range(11)]
    runs, total = line_dedup.LineRuns(spark, 12, fan_in=3), Counter()
    for k, batch in enumerate(batches):
        if k == 6:
            runs.forget()
            runs = line_dedup.LineRuns(spark, 12, fan_in=3, levels=runs.levels)
        runs.add(spark.createDataFrame(batch, "key binary, n long"))
        for key, n in batch:
            total[key] += n
        assert all(len(x) < 3 for x in runs.levels)
        assert {bytes(r[0]) for r in runs.frequent().collect()} == {x for x, n in total.items() if n >= 12}
    assert [len(x) for x in runs.levels] == [2, 0, 1]  # 11 in base 3
    kept = Counter(bytes(r["key"]) for run in runs.runs() for r in run.collect())
    assert max(kept.values()) <= 3  # never more rows of a key than runs
    runs.forget()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run")]


def test_runs_need_no_shuffle(spark):
    """A new batch is joined with a run as it lies."""
    runs = line_dedup.LineRuns(spark, 2, buckets=4)
    runs.add(spark.createDataFrame([(bytes([k]), 2) for k in range(50)], "key binary, n long"))
    batch = spark.createDataFrame([(bytes([k]), 1) for k in range(100)], "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))
    plan = batch.hint("merge").join(runs.runs()[0].select("key"), "key", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan
    runs.forget()


# Source divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def diverged(rows, least, top):
    rows = [(a or "", b or "", TERM.findall(lowered(t or ""))) for a, b, t in rows]
    held, occurs, groups = Counter(), Counter(), defaultdict(set)
    for lang, source, terms in rows:
        groups[lang].add(source)
        for t in set(terms):
            held[lang, t] += 1
        for t in terms:
            occurs[lang, source, t] += 1
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for (a, t), n in held.items() if a == lang and n >= least)
        total = {t: sum(occurs[lang, s, t] for s in sources) for t in kept}

        def shares(counts, v=len(kept)):
            n = sum(counts.values())
            return {t: 1 + 10**9 * (c + 2) // (n + 2 * v) for t, c in counts.items()}

        q = shares(total)
        p = {s: shares({t: occurs[lang, s, t] for t in kept}) for s in sources}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if occurs[lang, s, t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, 10**9), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return Counter(out)


@pytest.mark.parametrize(("least", "top", "gathered"), [(3, 10, 300_000), (1, 2, 5), (10**6, 10, 300_000)])
def test_divergence(spark, monkeypatch, least, top, gathered):
    rng = random.Random(4)
    monkeypatch.setattr(divergence, "GATHERED", gathered)
    words = ["the", "The", "über", "ÜBER", "naïve", "x1y", "don't", "word_two", "zeta", "日本", "日", "ab", "AB", "q"]
    rows = [(rng.choice(["en", "fr", None]), rng.choice(["a", "b", "é", "hot", "hot", "hot", "", None]), " ".join(rng.choices(words, k=rng.randrange(20)))) for _ in range(80)]
    rows += [("en", "empty", None), ("en", "empty", ""), ("xx", "alone", "the the"), ("yy", "1", "12 34"), ("yy", "2", None), ("en", "long", "zeta ab " * 30_000), rows[3], rows[3]]
    docs = clashing(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "lang string, source string, text string, doc_id long").repartition(4))
    got = divergence.divergence(docs, least_docs=least, top=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == diverged(rows, least, top)
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_shares_are_exact(spark):
    """Counts whose product with 10^9 passes 64 bits."""
    rows = [(c, n, v) for c in (0, 1, 10**12 + 7, 9 * 10**17) for n in (10**18 + 3, 10**12 + 9) for v in (1, 10**9)]
    got = spark.createDataFrame(rows, "c long, n long, v long").select("c", "n", "v", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).where("c <= n").collect()
    assert [r["p"] for r in got] == [1 + 10**9 * (r["c"] + 2) // (r["n"] + 2 * r["v"]) for r in got] and len(got) > 8


# Hard negatives


def vector_rows(scale=1.0):
    rng = random.Random(6)
    rows = [(k, rng.randrange(3), [round(rng.uniform(-1, 1), 2) * scale for _ in range(4)]) for k in range(120)]
    rows += [(k, rng.randrange(3), rows[k % 7][2]) for k in range(120, 160)]  # ties
    odd = [(200, 1, None), (201, None, [1.0] * 4), (None, 1, [1.0] * 4), (202, 1, [1.0, None, 0.0, 0.0]), (203, 1, [1.0, math.nan, 0.0, 0.0]), (204, 1, [math.inf, 0.0, 0.0, 0.0]), (210, 2, [1.0, 2.0]), (211, 2, [1.0, 1.5]), (212, 0, [1.0, 1.9]), (220, 1, []), (221, 1, []), (222, 2, []), (rows[30][0], *rows[30][1:]), (rows[40][0], *rows[40][1:])]
    return rows + odd


def mined(rows, every, k, low=80, high=100):
    good = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for a, lab, v in good:
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, m) for i, m, w in good if len(w) == len(v)]
        for ps, p, _ in sorted(x for x in scored if x[2] == lab and x[1] != a)[:k]:
            for rank, (ns, n, _) in enumerate(sorted(x for x in scored if x[2] != lab and low * -ps <= 100 * -x[0] <= high * -ps)[:k]):
                out[a, p, rank + 1, n, -ps, -ns] += 1
    return out


@pytest.mark.parametrize(("every", "k", "scale", "block"), [(10, 5, 1.0, 1 << 24), (10, 5, 1.0, 200), (1, 2, 1.0, 1 << 24), (10, 3, 1e5, 1 << 24)])
def test_hard_negatives(spark, monkeypatch, every, k, scale, block):
    for name, value in (("BLOCK_BYTES", block), ("TILE_ROWS", 32), ("TILE_ANCHORS", 16)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vector_rows(scale)
    df = clashing(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3))
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % every == 0, positives=k, negatives=k)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(tuple(r) for r in got.collect()) == mined(rows, every, k)
    assert hard_negatives.hard_negatives(df.limit(0), F.lit(True)).count() == 0
    assert hard_negatives.hard_negatives(df, F.lit(False)).count() == 0


def test_products_beyond_floats():
    a = np.array([[2.0**27 + 1, 3.0]])
    assert hard_negatives.products(a, a).tolist() == [[(2**27 + 1) ** 2 + 9]]
    with pytest.raises(ValueError, match="64 bits"):
        hard_negatives.products(a * 2**8, a * 2**8)
