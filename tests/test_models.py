"""The model client: its answers, its errors, and a whole run against a plain fold."""

import json
import math
import random
import sys
from datetime import datetime, timedelta

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lumenfold.functions import rules
from lumenfold.operators import knowledge, models

cloudpickle.register_pickle_by_value(sys.modules[__name__])
T0 = datetime(2026, 9, 16, 8)
POINTS = "array<struct<name:string,summary:string,claims:array<string>>>"


def vector(name):
    """Directions that are the same, near or far for different names; none for some."""
    if name.startswith("z"):
        return None
    angle = int(name[1:]) * 0.12 + int(name[1:]) ** 2 * 0.0007  # no name halfway between two others
    return [math.cos(angle), math.sin(angle)]


class Scripted:
    """Articles hold their points' names; the judge goes by the summaries; some texts and pairs fail."""

    def extract(self, title, content):
        if content.startswith("slow"):
            raise TimeoutError("slow")
        return json.dumps({"points": [{"name": x, "summary": x * 2, "claims": [x]} for x in content.split()]}), 10

    def embed(self, text):
        name = text.split("\n")[0]
        if name == "a7":
            raise OSError("no vector")
        return vector(name), 2

    def covers(self, point, entry_name, entry_summary):
        assert point["claims"] == [point["name"]]
        if (point["name"], entry_name) == ("a3", "a0"):
            raise TimeoutError("slow")
        return (len(point["summary"]) + len(entry_summary)) % 2 == 0 and entry_name <= point["name"], 3


def likeness(a, b):
    of = lambda x: {x[i : i + 2] for i in range(len(x) - 1)} if len(x) > 1 else {x}
    x, y = of("".join(a.lower().split())), of("".join(b.lower().split()))
    return len(x & y) / len(x | y)


def folded(articles, stored_entries, low, high):
    """decision of each article, names of made entries, tokens: one after the other."""
    client, tokens, decisions, made = Scripted(), 0, {}, []

    def ask(name, entry):
        try:
            return client.covers({"name": name, "summary": name * 2, "claims": [name]}, *entry)
        except TimeoutError:
            return False, 0

    names_asked, asked_stored = set(), {}
    for i, content in sorted(articles):
        if content.startswith("slow"):
            decisions[i] = "pending"
            continue
        tokens += 10
        new = []
        for name in content.split():
            v = None if name == "a7" else vector(name)
            if name not in names_asked:
                names_asked.add(name)
                tokens += 0 if name == "a7" else 2
            best = max(((sum(x * y for x, y in zip(v, vector(e), strict=True)) if v and vector(e) else likeness("\n".join((name, name * 2, name)), f"{e}\n{s}"), -k, (e, s)) for k, (e, s) in enumerate(stored_entries)), default=(0, 0, None))
            best = best if best[0] >= low else (0, 0, None)
            if best[2] and best[0] < high:
                asked_stored[i, len(new), name] = ask(name, best[2])
                tokens += asked_stored[i, len(new), name][1]
            rows = [(best[0], 1, best[2])] if best[2] else []
            rows += [(sum(x * y for x, y in zip(v, w, strict=True)), -k, e) for k, (e, w) in enumerate(made) if v and w]
            s, own, entry = max(rows, key=lambda x: x[:2], default=(0, 0, None))
            if entry is None or s < low:
                covered = False
            elif s >= high:
                covered = True
            elif own == 1:
                covered = asked_stored[i, len(new), name][0]
            else:
                covered, more = ask(name, entry)
                tokens += more
            new.append(not covered)
            if not covered and name not in {e for e, _ in stored_entries} and name not in {e[0] for e, _ in made}:
                made.append(((name, name * 2), v))
        decisions[i] = "new_knowledge" if all(new) else "partial" if any(new) else "covered"
    return decisions, sorted(e[0] for e, _ in made), tokens


@pytest.mark.parametrize("seed", [1, 2])
def test_model_run(spark, seed):
    rng = random.Random(seed)
    names = [f"a{k}" for k in range(14)] + ["z1", "zz22"]
    articles = [(i, "slow" if rng.random() < 0.1 else " ".join(rng.choice(names) for _ in range(rng.randrange(4)))) for i in range(40)]
    known = [("a0", "s"), ("a9", "tt"), ("zz22", "zz22zz22")]
    a = spark.createDataFrame([(i, "normal", None, T0 + timedelta(minutes=i), f"h{i}", f"t{i}", c) for i, c in articles], "id long, status string, knowledge_status string, crawled_at timestamp, content_hash string, title string, content string")
    e = spark.createDataFrame([(900 + k, n, s, "active", vector(n), None, None) for k, (n, s) in enumerate(known)], "entry_id long, name string, summary string, status string, embedding array<double>, article_ids array<long>, merged_into_id long")
    cache = spark.createDataFrame([], f"article_id long, fingerprint string, status string, points {POINTS}, attempts int, tokens long")
    out = models.model_run(a, cache, e, Scripted(), 0.80, 0.97, F.lit(T0))
    decisions, made, tokens = folded(articles, known, 0.80, 0.97)
    assert {r["article_id"]: r["decision"] for r in out["decisions"].collect()} == decisions
    assert sorted(r["name"] for r in out["entries"].collect() if r["entry_id"] not in (900, 901, 902)) == made
    assert out["usage"].agg(F.sum("tokens")).first()[0] == tokens
    assert out["usage"].where("kind = 'extract' and error = 'slow'").count() == sum(c == "slow" for _, c in articles)
    # with the cache of this run only what failed is extracted again
    again = models.model_run(a, out["cache"], e, Scripted(), 0.80, 0.97, F.lit(T0))
    assert again["usage"].where("kind = 'extract'").count() == sum(c == "slow" for _, c in articles)
    assert {r["article_id"]: r["decision"] for r in again["decisions"].collect()} == decisions


def test_texts_are_embedded_once(spark):
    points = spark.createDataFrame([(1, "a1"), (2, "a1"), (3, None), (4, " "), (5, "a7"), (6, "z1")], "point_id long, text string")
    out, usage = models.embed_points(points, Scripted())
    assert {r["point_id"]: r["embedding"] for r in out.collect()} == {1: vector("a1"), 2: vector("a1"), 3: None, 4: None, 5: None, 6: None}
    assert sorted((r["tokens"], r["error"] or "") for r in usage.collect()) == [(0, "no vector"), (2, ""), (2, "")]
    assert models.embed_points(points.limit(0), Scripted())[0].count() == 0


def replies(*of):
    """A post() that gives one reply after the other, and what it was asked."""
    left, asked = list(of), []

    def post(path, payload):
        asked.append((path, payload))
        got = left.pop(0)
        if isinstance(got, Exception):
            raise got
        return got

    return post, asked


def chat(content, tokens=5):
    return 200, json.dumps({"choices": [{"message": {"content": content}}], "usage": {"prompt_tokens": tokens, "completion_tokens": 1}})


def test_http_client():
    post, asked = replies(chat("nonsense"), chat('{"points": [{"name": "n"}]}'))
    assert models.HttpClient(post, "m").extract("t", "c") == ('{"points": [{"name": "n"}]}', 12)
    assert [p for p, _ in asked] == ["chat/completions"] * 2 and asked[0][1]["model"] == "m"
    post, asked = replies((200, json.dumps({"data": [{"embedding": [1, 2]}], "usage": {"prompt_tokens": 4}})))
    assert models.HttpClient(post, "m").embed("x" * 9000) == ([1.0, 2.0], 4)
    assert len(asked[0][1]["input"]) == rules.EMBED_CHARS
    point = {"name": "n", "summary": "s", "claims": ["c"]}
    for content, want in (('{"covered": true}', True), ('{"covered": "true"}', False), ("{}", False)):
        assert models.HttpClient(replies(chat(content))[0], "m").covers(point, "e", "") == (want, 6)
    for got, says in (
        ((429, ""), rules.MODEL_QUOTA), ((500, ""), rules.MODEL_STATUS % 500), ((200, "<html>"), rules.MODEL_NO_JSON), (TimeoutError("5 s"), rules.MODEL_TIMEOUT % "5 s"), (ConnectionError("gone"), rules.MODEL_DOWN % "gone"),
    ):
        with pytest.raises(models.ModelError) as e:
            models.HttpClient(replies(got)[0], "m").extract("t", "c")
        assert str(e.value) == says
    for bad in (chat("[1]"), (200, "{}")):
        with pytest.raises(models.ModelError, match="JSON"):
            models.HttpClient(replies(bad, bad)[0], "m").extract("t", "c")
    with pytest.raises(models.ModelError, match="embedding"):
        models.HttpClient(replies((200, "{}"))[0], "m").embed("t")


def test_runs_are_bounded(spark):
    points = spark.range(101).select(F.col("id").alias("point_id"), F.lit(1).cast("long").alias("article_id"), F.col("id").cast("int").alias("pos"), F.lit("n").alias("name"), F.array(F.lit(1.0)).alias("embedding"))
    with pytest.raises(ValueError, match="100 points"):
        knowledge.greedy_entries(points, 0.8, 0.92, limit=2)
