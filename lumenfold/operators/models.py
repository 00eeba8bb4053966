"""A language model as an injected client: extraction, vectors and second opinions, each a Spark job over its rows.

A client is any picklable object with the methods of `Client`. Each answer comes with the tokens it took; an exception is the
error of its row and never stops a job. Answers are written as soon as they are there, so that no plan asks twice.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, text
from ..sources.store import stored
from . import knowledge


class Client(Protocol):
    def extract(self, title: str, content: str) -> tuple[str, int]:
        """(JSON with `points`, tokens)"""

    def embed(self, text: str) -> tuple[list[float] | None, int]:
        """(vector, or None where there are no vectors, tokens)"""

    def covers(self, point: dict, entry_name: str, entry_summary: str) -> tuple[bool, int]:
        """(whether the entry says all that the point says, tokens); point: name, summary, claims"""


class ModelError(Exception):
    """A call that gave no usable answer."""


def http_post(base_url: str, key: str, seconds: float) -> Callable[[str, dict], tuple[int, str]]:
    """post(path, payload) -> (status, body) over HTTP; a status is never an exception."""

    def post(path: str, payload: dict) -> tuple[int, str]:
        headers = {"Authorization": f"Bearer {key}", "Content-Type": "application/json"}
        request = urllib.request.Request(f"{base_url.rstrip('/')}/{path}", json.dumps(payload).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=seconds) as reply:
                return reply.status, reply.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, ""

    return post


class HttpClient:
    """A client of an endpoint with `chat/completions` and `embeddings`. post(path, payload) gives (status, body).

    Answers that are no JSON of the wanted shape are asked for again, `attempts` times in all; refusals, time-outs and
    statuses from 400 on are errors at once. Tokens of all attempts count."""

    def __init__(self, post: Callable[[str, dict], tuple[int, str]], model: str, attempts: int = 2):
        self.post, self.model, self.attempts = post, model, attempts

    def call(self, path: str, payload: dict) -> dict:
        try:
            status, body = self.post(path, payload)
        except TimeoutError as e:
            raise ModelError(rules.MODEL_TIMEOUT % e) from e
        except OSError as e:
            raise ModelError(rules.MODEL_DOWN % e) from e
        if status == 429:
            raise ModelError(rules.MODEL_QUOTA)
        if status >= 400:
            raise ModelError(rules.MODEL_STATUS % status)
        try:
            return json.loads(body)
        except ValueError as e:
            raise ModelError(rules.MODEL_NO_JSON) from e

    def chat(self, prompt: str, question: str) -> tuple[dict, int]:
        tokens, why = 0, None
        messages = [{"role": "system", "content": prompt}, {"role": "user", "content": question}]
        for _ in range(self.attempts):
            data = self.call("chat/completions", {"model": self.model, "messages": messages, "response_format": {"type": "json_object"}, "temperature": 0})
            used = data.get("usage") or {}
            tokens += int(used.get("prompt_tokens") or 0) + int(used.get("completion_tokens") or 0)
            try:
                answer = json.loads(data["choices"][0]["message"]["content"])
                if isinstance(answer, dict):
                    return answer, tokens
                why = type(answer).__name__
            except (KeyError, IndexError, TypeError, ValueError) as e:
                why = e
        raise ModelError(rules.MODEL_SHAPE % why)

    def extract(self, title: str, content: str) -> tuple[str, int]:
        answer, tokens = self.chat(rules.EXTRACT_PROMPT, f"{title}\n\n{content}")
        return json.dumps(answer), tokens

    def embed(self, text: str) -> tuple[list[float] | None, int]:
        data = self.call("embeddings", {"model": self.model, "input": text[: rules.EMBED_CHARS]})
        try:
            vector = [float(x) for x in data["data"][0]["embedding"]]
        except (KeyError, IndexError, TypeError, ValueError) as e:
            raise ModelError(rules.MODEL_VECTOR % e) from e
        return vector, int((data.get("usage") or {}).get("prompt_tokens") or 0)

    def covers(self, point: dict, entry_name: str, entry_summary: str) -> tuple[bool, int]:
        claims = "; ".join(point["claims"])
        answer, tokens = self.chat(rules.JUDGE_PROMPT, f"Known: {entry_name}\n{entry_summary}\n\nNew: {point['name']}\n{point['summary']}\n{claims}")
        return answer.get("covered") is True, tokens


def embed_points(points: DataFrame, client: Client, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(points with `embedding`, usage: kind, tokens, error of each call).

    Every different text is sent once. Null and blank texts are not sent; these, failures and clients without vectors leave
    a null vector, and such points are compared by their texts later on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for value in batch["__text"]:
                try:
                    vector, tokens = client.embed(value)
                    rows.append((value, None if vector is None else [float(x) for x in vector], int(tokens), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((value, None, 0, str(e)))
            yield pd.DataFrame(rows, columns=["__text", "__vector", "tokens", "error"])

    asked = points.select(F.col(text_col).alias("__text")).where(F.trim("__text") != "").distinct()
    got = stored(asked.mapInPandas(run, "__text string, __vector array<double>, tokens long, error string"), "model-vectors")
    out = points.drop("embedding").join(got.select("__text", F.col("__vector").alias("embedding")), F.col(text_col) == F.col("__text"), "left").drop("__text")
    return out, got.select(F.lit("embed").alias("kind"), "tokens", "error")


def ask_pairs(pairs: DataFrame, client: Client) -> tuple[DataFrame, DataFrame]:
    """(point_id, entry_id, covered; usage). pairs: point_id, name, summary, claims, entry_id, entry_name, entry_summary.
    Any doubt is no: a failure, or an answer that is not true."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for x in batch.itertuples():
                covered, tokens, error = opinion(client, x.name, x.summary, x.claims, x.entry_name, x.entry_summary)
                rows.append((x.point_id, x.entry_id, covered, tokens, error))
            yield pd.DataFrame(rows, columns=["point_id", "entry_id", "covered", "tokens", "error"])

    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    asked = pairs.select("point_id", blank("name"), blank("summary"), F.coalesce("claims", F.array().cast("array<string>")).alias("claims"), "entry_id", blank("entry_name"), blank("entry_summary"))
    got = stored(asked.mapInPandas(run, "point_id long, entry_id long, covered boolean, tokens long, error string"), "model-opinions")
    return got.select("point_id", "entry_id", "covered"), got.select(F.lit("judge").alias("kind"), "tokens", "error")


def opinion(client: Client, name: str, summary: str, claims, entry_name: str, entry_summary: str) -> tuple[bool, int, str | None]:  # noqa: ANN001
    try:
        covered, tokens = client.covers({"name": name, "summary": summary, "claims": list(claims)}, entry_name, entry_summary)
        return covered is True, int(tokens), None
    except Exception as e:  # noqa: BLE001
        return False, 0, str(e)


def model_run(articles: DataFrame, cache: DataFrame, entries: DataFrame, client: Client, low: float, high: float, now: Column, limit: int = 200) -> dict[str, DataFrame]:
    """A run of the knowledge stage with a model: `decisions`, `articles`, `entries`, `cache`, and `usage` (kind, tokens, error).

    The run's candidates are extracted unless the cache (article_id, fingerprint, status, points, attempts, tokens) has them,
    their points get vectors, and points whose most similar stored entry lies between the thresholds are judged against it,
    all in parallel and before the ordered step, which asks the client only about entries that the run itself has made."""
    chosen = stored(knowledge.candidates(articles, limit), "model-candidates")
    hits, rest = knowledge.cached_extractions(chosen, cache)
    fresh = stored(knowledge.extract_points(rest, client.extract, limit), "model-points")
    shape = "array<struct<name:string,summary:string,claims:array<string>>>"
    own = hits.select("article_id", F.lit(True).alias("ok"), F.col("points").cast(shape).alias("points"), F.lit(None).cast("string").alias("error"))
    own = own.unionByName(fresh.select("article_id", "ok", F.col("points").cast(shape).alias("points"), "error"))
    rows = own.where("ok").select("article_id", F.posexplode("points").alias("pos", "p")).select("article_id", "pos", "p.*")
    rows = rows.withColumns({"point_id": F.xxhash64("article_id", "pos"), "text": text.point_text(F.col("name"), F.col("summary"), F.col("claims"))})
    rows, embedded = embed_points(stored(rows, "model-rows"), client)
    rows = stored(rows, "model-embedded")
    near = stored(knowledge.nearest_vectors(rows, entries, low).select("point_id", "entry_id", "similarity"), "model-near")
    about = entries.select("entry_id", F.col("name").alias("entry_name"), F.col("summary").alias("entry_summary"))
    pairs = near.where(F.col("similarity") < high).join(rows.select("point_id", "name", "summary", "claims"), "point_id").join(about, "entry_id")
    opinions, judged = ask_pairs(pairs, client)
    near = near.join(opinions, ["point_id", "entry_id"], "left")
    decisions, states, united, late = knowledge.decide_run(articles, own, rows, near, entries, low, high, now, limit, client=client)
    usage = fresh.select(F.lit("extract").alias("kind"), "tokens", "error").unionByName(embedded).unionByName(judged).unionByName(late)
    return {"decisions": decisions, "articles": states, "entries": united, "cache": knowledge.save_extractions(cache, fresh), "usage": usage}
