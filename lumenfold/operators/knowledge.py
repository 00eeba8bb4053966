"""Knowledge coverage by vectors: nearest entries, tiers, roll-ups, decisions, and the entries' own states."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text, vectors
from ..sources.store import stored
from . import vector_index


def by_text(points: DataFrame, entries: DataFrame, least: float, k: int) -> DataFrame:
    """point_id, entry_id, similarity of pairs of which one has no vector, by their texts, pair by pair."""
    e = entries.select("entry_id", F.concat_ws("\n", F.coalesce("name", F.lit("")), F.coalesce("summary", F.lit(""))).alias("e_text"))
    pairs = points.select("point_id", F.col("text").alias("p_text")).crossJoin(e)
    pairs = pairs.select("point_id", "entry_id", text.keyword_similarity(F.col("p_text"), F.col("e_text")).alias("similarity")).where(F.col("similarity") >= least)
    return vector_index.best(pairs, k).drop("rank")


def found_by(search: Callable[[DataFrame, DataFrame], DataFrame], points: DataFrame, entries: DataFrame, least: float, k: int) -> DataFrame:
    """The best k of a search over vectors, of pairs of unlike vectors, and of pairs without one."""
    points = points if "text" in points.columns else points.withColumn("text", F.lit(""))
    size = F.size(vector_index.vector("embedding"))
    active = entries.where("status = 'active'")
    real, known = points.where(size > 0), active.where(size > 0)
    out = search(real, known)
    if least <= 0:
        out = out.unionByName(unlike(real, known, k))
    bare = points.where(size == 0), active.where(size == 0)
    if not bare[0].isEmpty():
        out = out.unionByName(by_text(bare[0], active, least, k))
    if not bare[1].isEmpty():
        out = out.unionByName(by_text(real, bare[1], least, k))
    return vector_index.best(out, k)


def nearest_entries(points: DataFrame, entries: DataFrame, least: float, k: int = 1) -> DataFrame:
    """point_id, entry_id, similarity, rank: of the active entries the k most similar at `least` or above, of equals the
    first by id. Every vector meets every other, in blocks; no index.

    Vectors of other dimensions have similarity 0, as those of zero length; such pairs count where `least` lets them, the
    first k by id for each point. Points or entries without a vector are compared by their texts; where points have no text,
    such pairs have similarity 0."""
    return found_by(lambda real, known: vector_index.products(real, known, least, k), points, entries, least, k)


def nearest_vectors(points: DataFrame, entries: DataFrame, least: float, k: int = 1, index: vector_index.Cells | None = None) -> DataFrame:
    """The same through an index of cells (built here, unless given): exact, and entries never pass the driver. Without a given
    index and a least similarity above zero, cells would leave little out, so vectors meet in blocks."""
    if index is None and least <= 0:
        return nearest_entries(points, entries, least, k)
    return found_by(lambda real, known: vector_index.nearest(real, index or vector_index.build(known), least, k), points, entries, least, k)


def unlike(points: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """(point_id, entry_id, similarity 0): for each point the first k entries by id whose vector has another dimension or norm
    zero, or any where its own norm is zero. Only the first k of each kind of vector are looked at."""
    v = vector_index.vector("embedding")
    kind = F.when(F.exists(v, lambda x: x != 0), F.size(v)).otherwise(F.lit(0))
    first = Window.partitionBy("kind").orderBy("entry_id")
    few = entries.select("entry_id", kind.alias("kind")).withColumn("n", F.row_number().over(first)).where(F.col("n") <= k).drop("n")
    kinds = points.select(kind.alias("own")).distinct()
    pairs = kinds.join(F.broadcast(few), (F.col("own") == 0) | (F.col("own") != F.col("kind")))  # k rows a dimension, of which there are few
    order = Window.partitionBy("own").orderBy("entry_id")
    pairs = pairs.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    return points.select("point_id", kind.alias("own")).join(F.broadcast(pairs), "own").select("point_id", "entry_id", F.lit(0.0).alias("similarity"))


def verdicts(points: DataFrame, nearest: DataFrame, low: float, high: float, judge: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Points with entry_id, similarity, is_new. Between the thresholds a judge (point, entry) may call it covered; any
    doubt is new."""
    rows = points.join(nearest.where("rank = 1").select("point_id", "entry_id", "similarity"), "point_id", "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    second = F.coalesce(judge(F.col("point_id"), F.col("entry_id")), F.lit(False)) if judge else F.lit(False)
    level = vectors.coverage(F.col("similarity"), low, high)
    covered = F.when(level == "covered", True).when(level == "judge", second).otherwise(False)
    return rows.withColumn("is_new", ~covered)


def roll_up(points: DataFrame, articles: DataFrame | None = None) -> DataFrame:
    """article_id, decision, similarity, matched_entry_id, new_points, covered_points, rationale: all covered, some, or none.

    With `articles` (article_id, ok, error: how their extraction went) each of them has a row: one whose extraction failed
    is pending, one without points is new, both without a similarity."""
    out = points.groupBy("article_id").agg(
        F.max("similarity").alias("similarity"), F.min_by(F.when(~F.col("is_new"), F.col("entry_id")), F.when(~F.col("is_new"), F.col("pos"))).alias("matched_entry_id"),
        F.count_if(F.col("is_new")).alias("new_points"), F.count_if(~F.col("is_new")).alias("covered_points"),
    )
    if articles is None:
        out = out.withColumns({"ok": F.lit(True), "error": F.lit(None).cast("string")})
    else:
        out = articles.select("article_id", "ok", "error").join(out, "article_id", "left").fillna(0, ["new_points", "covered_points"])
    new, covered, s = F.col("new_points"), F.col("covered_points"), F.col("similarity")
    none = new + covered == 0
    decision = F.when(~F.col("ok"), "pending").when(none | (covered == 0), "new_knowledge").when(new == 0, "covered").otherwise("partial")
    why = (
        F.when(~F.col("ok"), F.concat(F.lit(rules.EXTRACTION_FAILED), F.coalesce("error", F.lit(rules.UNKNOWN_REASON)))).when(none, rules.NO_POINTS).when(new == 0, F.format_string(rules.ALL_COVERED, covered, s))
        .when(covered > 0, F.format_string(rules.SOME_COVERED, covered, new, s)).otherwise(F.format_string(rules.NONE_COVERED, new, s))
    )
    return out.select("article_id", decision.alias("decision"), F.when(F.col("ok") & ~none, s).alias("similarity"), F.when(F.col("ok"), F.col("matched_entry_id")).alias("matched_entry_id"), "new_points", "covered_points", why.alias("rationale"))


#: Points of one article that an ordered run takes at most, on average; a model is asked for five.
ARTICLE_POINTS = 50


def greedy_entries(points: DataFrame, low: float, high: float, judge: Callable[[str, int], bool] | None = None, limit: int = 200, client=None) -> DataFrame:  # noqa: ANN001
    """point_id, article_id, pos, entry_id, similarity, is_new, created, rationale, tokens, error: a run's points judged in order.

    points: point_id, article_id, pos, name, embedding, and, where known, what the stored entries say: stored_id and
    stored_similarity (the most similar one at `low` or above), stored_covered (what the judge says of it, asked before) and
    named_id (the one with the point's name). With a `client` (see models.py) it is asked about entries made in this run, and
    points have summary and claims too; tokens and error are of that call. A point is covered by the most similar entry, stored or made before in this run, from `high` on, or between the thresholds if the
    judge (name, entry_id) says so; any doubt or error is new. A new point joins the entry with its name or makes one.
    Each point can be covered by those before it, so a run is one ordered group; it takes at most `limit` articles with
    ARTICLE_POINTS points each, and more are an error."""
    from .models import opinion

    for name, kind in (("stored_id", "long"), ("stored_similarity", "double"), ("stored_covered", "boolean"), ("named_id", "long"), ("summary", "string"), ("claims", "array<string>")):
        if name not in points.columns:
            points = points.withColumn(name, F.lit(None).cast(kind))
    if points.select("article_id").distinct().limit(limit + 1).count() > limit:
        raise ValueError(f"a run takes at most {limit} articles")
    if points.limit(limit * ARTICLE_POINTS + 1).count() > limit * ARTICLE_POINTS:
        raise ValueError(f"a run takes at most {limit * ARTICLE_POINTS} points")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names: dict[str, int] = {}
        about: dict[int, tuple[str, str]] = {}
        kept: list[tuple[int, np.ndarray]] = []
        out = []
        for row in pdf.sort_values(["article_id", "pos"]).itertuples():
            v = np.asarray([] if row.embedding is None else row.embedding, float)
            sims = [(float(v @ w / (np.linalg.norm(v) * np.linalg.norm(w) or 1)), -n, e) for n, (e, w) in enumerate(kept, 1) if len(w) == len(v) > 0]
            if not pd.isna(row.stored_id):
                sims.append((float(row.stored_similarity), 0, int(row.stored_id)))
            s, _, found = max(sims, default=(0.0, 0, None))
            covered, why, tokens, error = False, rules.NO_SIMILAR, 0, None
            if found is None or s < low:
                s, found = 0.0, None
            elif s >= high:
                covered, why = True, rules.COVERED_BY % (s, high)
            else:
                if found not in about and not pd.isna(row.stored_covered):
                    covered = bool(row.stored_covered)
                elif client is not None and found in about:
                    covered, tokens, error = opinion(client, row.name, row.summary or "", [] if row.claims is None else row.claims, *about[found])
                else:
                    try:
                        covered = bool(judge and judge(row.name, found))
                    except Exception:  # noqa: BLE001
                        covered = False
                why = (rules.JUDGED_COVERED if covered else rules.TAKEN_AS_NEW) % s
            entry, made = found, False
            if not covered:
                name = row.name.strip()
                entry = None if pd.isna(row.named_id) else int(row.named_id)
                entry = names.get(name) if entry is None else entry
                if entry is None:
                    entry, made = int(row.point_id), True
                    names[name], about[entry] = entry, (name, row.summary or "")
                    kept.append((entry, v))
            out.append((row.point_id, row.article_id, row.pos, entry, s, not covered, made, why, tokens, error))
        return pd.DataFrame(out, columns=["point_id", "article_id", "pos", "entry_id", "similarity", "is_new", "created", "rationale", "tokens", "error"])

    some = points.select("point_id", "article_id", "pos", "name", "summary", "claims", "embedding", "stored_id", "stored_similarity", "stored_covered", "named_id")
    return some.withColumn("__one", F.lit(1)).groupBy("__one").applyInPandas(run, "point_id long, article_id long, pos int, entry_id long, similarity double, is_new boolean, created boolean, rationale string, tokens long, error string")


def judge_run(articles: DataFrame, extractions: DataFrame, entries: DataFrame, embed: Column, low: float, high: float, now: Column, judge: Callable[[str, int], bool] | None = None, limit: int = 200) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(decisions, articles, entries) after a run of the knowledge stage over its candidates.

    articles: id, status, knowledge_status, crawled_at, ...; extractions: article_id, ok, points (name, summary, claims),
    error, of the candidates; entries: entry_id, name, summary, status, embedding, article_ids, merged_into_id. `embed` makes
    a vector of the columns name, summary and claims of a point, or null. Decisions are roll_up()'s; articles take their
    states; entries gain those that new points made, and the articles of new points."""
    chosen = stored(candidates(articles, limit).select(F.col("id").alias("article_id")), "run-articles")
    own = extractions.join(chosen, "article_id", "left_semi")
    rows = own.where("ok").select("article_id", F.posexplode("points").alias("pos", "p")).select("article_id", "pos", "p.*")
    rows = rows.withColumn("point_id", F.xxhash64("article_id", "pos")).withColumn("text", text.point_text(F.col("name"), F.col("summary"), F.col("claims"))).withColumn("embedding", embed)
    rows = stored(rows, "run-points")
    return decide_run(articles, own, rows, nearest_vectors(rows, entries, low), entries, low, high, now, limit, judge)[:3]


def decide_run(
    articles: DataFrame, own: DataFrame, rows: DataFrame, near: DataFrame, entries: DataFrame, low: float, high: float, now: Column, limit: int = 200, judge: Callable[[str, int], bool] | None = None, client=None,  # noqa: ANN001
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The second half of a run: (decisions, articles, entries, usage of the calls it made: kind, tokens, error).

    own: article_id, ok, error of the run's articles; rows: their points with vectors; near: point_id, entry_id, similarity and,
    where a judge was asked before, covered."""
    near = near if "covered" in near.columns else near.withColumn("covered", F.lit(None).cast("boolean"))
    near = near.select("point_id", F.col("entry_id").alias("stored_id"), F.col("similarity").alias("stored_similarity"), F.col("covered").alias("stored_covered"))
    named = entry_by_name(entries, rows).select("point_id", F.col("entry_id").alias("named_id"))
    judged = stored(greedy_entries(rows.join(near, "point_id", "left").join(named, "point_id", "left"), low, high, judge, limit, client), "run-verdicts")
    usage = judged.where("tokens > 0 or error is not null").select(F.lit("judge").alias("kind"), "tokens", "error")
    decided = roll_up(judged, own.select("article_id", "ok", "error"))
    made = judged.where("created").select("point_id", "entry_id").join(rows, "point_id").select("entry_id", F.substring(F.trim("name"), 1, 300).alias("name"), "summary", F.lit("active").alias("status"), "embedding")
    links = judged.where("is_new").groupBy("entry_id").agg(F.array_sort(F.collect_set("article_id")).alias("__new"))
    every = entries.unionByName(made, allowMissingColumns=True).join(links, "entry_id", "left")
    none = F.array().cast("array<bigint>")
    united = every.withColumn("article_ids", F.array_distinct(F.concat(F.coalesce("article_ids", none), F.coalesce("__new", none)))).drop("__new")
    states = decided.select("article_id", "decision")
    return decided.withColumn("created_at", now), apply_decisions(articles, states), united, usage


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The last decision of each article, human ones included; of equal times the higher id."""
    return decisions.groupBy("article_id").agg(F.max_by(F.struct("id", "decision", "actor", "created_at"), F.struct("created_at", "id")).alias("d")).select("article_id", "d.*")


def apply_decisions(articles: DataFrame, decided: DataFrame) -> DataFrame:
    """Article states after decisions: covered ones are archived; others come back from the archive."""
    d = decided.select(F.col("article_id").alias("id"), F.col("decision").alias("__d"))
    rows = articles.join(d, "id", "left")
    status = F.when(F.col("__d") == "covered", "knowledge_duplicate").when(F.col("__d").isin("partial", "new_knowledge") & (F.col("status") == "knowledge_duplicate"), "normal").otherwise(F.col("status"))
    # A pending decision leaves the article's status alone.
    known = F.when(F.col("__d") == "new_knowledge", "new").when(F.col("__d").isNotNull(), F.col("__d")).otherwise(F.col("knowledge_status"))
    return rows.withColumns({"status": status, "knowledge_status": known}).drop("__d")


def candidates(articles: DataFrame, limit: int = 200) -> DataFrame:
    from ..functions.rules import HIDDEN_STATUSES

    some = articles.where(~F.col("status").isin(*HIDDEN_STATUSES) & (F.col("knowledge_status").isNull() | (F.col("knowledge_status") == "pending")))
    return some.orderBy(F.desc("crawled_at"), F.desc("id")).limit(limit)


def cached_extractions(articles: DataFrame, cache: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(articles with stored points, articles to extract). A hit has the same fingerprint and went well."""
    good = cache.where("status = 'ok'").select("article_id", "fingerprint", "points")
    own = articles.withColumn("fingerprint", text.article_fingerprint(F.col("content_hash"), F.col("title"), F.col("content"))).withColumnRenamed("id", "article_id")
    hits = own.join(good, ["article_id", "fingerprint"])
    return (hits.limit(0), own) if force else (hits, own.join(good, ["article_id", "fingerprint"], "left_anti"))


def save_extractions(cache: DataFrame, results: DataFrame) -> DataFrame:
    """The cache after a run: attempts and tokens add up; a failure keeps the row. results: article_id, fingerprint, ok,
    points, tokens."""
    r = results.select("article_id", F.col("fingerprint").alias("__f"), F.col("ok").alias("__ok"), F.col("points").alias("__p"), F.col("tokens").alias("__t"))
    rows = cache.join(r, "article_id", "full")
    return rows.select(
        "article_id", F.coalesce("__f", "fingerprint").alias("fingerprint"), F.when(F.col("__ok"), "ok").when(~F.col("__ok"), "failed").otherwise(F.col("status")).alias("status"), F.when(F.col("__ok"), F.col("__p")).otherwise(F.col("points")).alias("points"),
        (F.coalesce("attempts", F.lit(0)) + F.when(F.col("__ok").isNotNull(), 1).otherwise(0)).alias("attempts"), (F.coalesce("tokens", F.lit(0)) + F.coalesce("__t", F.lit(0))).alias("tokens"),
    )


def extract_points(articles: DataFrame, client, limit: int = 200) -> DataFrame:  # noqa: ANN001
    """article_id, fingerprint, ok, points, tokens, error of a model's extraction, for at most `limit` articles.

    client(title, content) gives (reply, tokens); it is injected, runs in Arrow batches, and a failure is its row's error.
    A reply without a list of points is a failure. Content is cut to 8,000 characters, as the model's input is bounded."""

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            rows = []
            for row in batch.itertuples():
                try:
                    reply, tokens = client(row.title, row.content)
                    rows.append((row.article_id, row.fingerprint, reply, int(tokens), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((row.article_id, row.fingerprint, None, 0, str(e)))
            yield pd.DataFrame(rows, columns=["article_id", "fingerprint", "reply", "tokens", "error"])

    own = articles.select("article_id", "fingerprint", F.coalesce("title", F.lit("")).alias("title"), F.substring(F.coalesce("content", F.lit("")), 1, 8000).alias("content")).orderBy("article_id").limit(limit)
    got = own.mapInPandas(run, "article_id long, fingerprint string, reply string, tokens long, error string").withColumn("points", typed_points(F.col("reply")))
    return got.select("article_id", "fingerprint", F.col("points").isNotNull().alias("ok"), "points", "tokens", F.when(F.col("points").isNull(), F.coalesce("error", F.lit("no points"))).alias("error"))


def stub_client(title: str, content: str) -> tuple[str, int]:
    """A model for tests and dry runs: the title is the only point."""
    import json

    return json.dumps({"points": [{"name": title, "summary": content[:200], "claims": []}]}), len(content) // 4


def retry_set(articles: DataFrame, extractions: DataFrame, limit: int) -> DataFrame:
    return articles.join(extractions.where("status <> 'ok'").select(F.col("article_id").alias("id")), "id").orderBy("id").limit(limit)


def typed_points(reply: Column) -> Column:
    """Points of a model's JSON reply: those with a name, cut to 300 characters; null if the reply has no list."""
    shape = "struct<points:array<struct<name:string,summary:string,claims:array<string>>>>"
    got = F.from_json(reply, shape)["points"]
    fill = lambda p: F.struct(F.substring(F.trim(p["name"]), 1, 300).alias("name"), F.coalesce(p["summary"], F.lit("")).alias("summary"), F.coalesce(p["claims"], F.array().cast("array<string>")).alias("claims"))
    return F.transform(F.filter(got, lambda p: F.coalesce(F.trim(p["name"]), F.lit("")) != ""), fill)


def merge_entries(entries: DataFrame, ids: list, target_id, target_name: str, target_summary: str = "") -> DataFrame:  # noqa: ANN001
    """Entries after merging two active ones or more into a new one, `target_id`: they are `merged` into it; without a
    summary of its own it has theirs, joined in the order given; it has the articles of all, sorted.
    entries: entry_id, name, summary, status, article_ids, merged_into_id."""
    order = {x: n for n, x in enumerate(ids)}
    chosen = entries.where(F.col("entry_id").isin(*order) & (F.col("status") == "active"))
    if len(order) < 2 or chosen.count() < len(order):
        raise ValueError("a merge takes two entries or more, all of them active")
    place = F.element_at(F.create_map(*[F.lit(x) for pair in order.items() for x in pair]), F.col("entry_id"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("n"), "summary"))), lambda x: F.nullif(x["summary"], F.lit(""))), "；")
    target = chosen.agg(
        F.lit(target_id).cast(entries.schema["entry_id"].dataType).alias("entry_id"), F.lit(target_name[:300]).alias("name"), (F.lit(target_summary) if target_summary else joined).alias("summary"), F.lit("active").alias("status"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("article_ids")))).alias("article_ids"),
    )
    gone = F.col("entry_id").isin(*order)
    rest = entries.withColumns({"status": F.when(gone, "merged").otherwise(F.col("status")), "merged_into_id": F.when(gone, F.lit(target_id)).otherwise(F.col("merged_into_id"))})
    return rest.unionByName(target, allowMissingColumns=True)


def create_entries(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Entries with new ones (entry_id, name, summary, ...), active, names trimmed and cut to 300; a blank name is an error."""
    name = F.substring(F.trim("name"), 1, 300)
    checked = F.when(F.coalesce(name, F.lit("")) == "", F.raise_error("an entry needs a name")).otherwise(name)
    return entries.unionByName(new.withColumns({"name": checked, "summary": F.coalesce("summary", F.lit("")), "status": F.lit("active")}), allowMissingColumns=True)


def update_entries(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """Entries after changes (entry_id, name, summary, article_ids; null: no change). A blank name is an error; articles are
    added, each once."""
    c = changes.select("entry_id", F.substring(F.trim("name"), 1, 300).alias("__n"), F.col("summary").alias("__s"), F.col("article_ids").alias("__a"))
    rows, none = entries.join(c, "entry_id", "left"), F.array().cast("array<bigint>")
    return rows.withColumns({
        "name": F.when(F.col("__n") == "", F.raise_error("an entry needs a name")).otherwise(F.coalesce("__n", "name")), "summary": F.coalesce("__s", "summary"), "article_ids": F.array_distinct(F.concat(F.coalesce("article_ids", none), F.coalesce("__a", none))),
    }).drop("__n", "__s", "__a")


def retire(entries: DataFrame, entry_id) -> DataFrame:  # noqa: ANN001
    return entries.withColumn("status", F.when(F.col("entry_id") == entry_id, "retired").otherwise(F.col("status")))


def link_articles(links: DataFrame, new: DataFrame) -> DataFrame:
    return links.unionByName(new.join(links, ["entry_id", "article_id"], "left_anti")).dropDuplicates(["entry_id", "article_id"])


def entry_by_name(entries: DataFrame, points: DataFrame) -> DataFrame:
    """point_id, entry_id of active entries with the point's very name, trimmed."""
    e = entries.where("status = 'active'").select(F.trim("name").alias("key"), "entry_id")
    return points.select("point_id", F.trim("name").alias("key")).join(e, "key").groupBy("point_id").agg(F.min("entry_id").alias("entry_id"))
