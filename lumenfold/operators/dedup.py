"""Duplicates of articles: exact and near groups, related pairs, election of primaries, previews of thresholds.

`articles` have id (in order of creation), content, and what the election needs. Similarity joins run over distinct
fingerprints, so copies are one value; near pairs are found by equal blocks of bits, which loses none."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..sources.store import stored
from . import hamming


def fingerprints(articles: DataFrame, nfkc: bool = True) -> DataFrame:
    """id, content_hash, simhash of articles with content."""
    some = articles.where(F.trim(F.coalesce("content", F.lit(""))) != "").select("id", "content")
    if nfkc:
        return some.select("id", text.fingerprint(F.col("content")).alias("p")).select("id", "p.content_hash", "p.simhash")
    some = some.withColumn("normal", text.normalize_content(F.col("content"), nfkc=False))
    return some.select("id", F.sha2("normal", 256).alias("content_hash"), text.simhash(F.col("normal")).alias("simhash"))


def exact_groups(prints: DataFrame) -> DataFrame:
    """content_hash, first_id, members of hashes that two articles or more share."""
    return prints.groupBy("content_hash").agg(F.min("id").alias("first_id"), F.count("*").alias("members")).where("members > 1")


def exact_parents(prints: DataFrame) -> DataFrame:
    """id, parent: the first article with the same content, of all later ones."""
    return prints.join(exact_groups(prints), "content_hash").where("id > first_id").select("id", F.col("first_id").alias("parent"))


def most_distance(threshold: float) -> int:
    """The Hamming distance that a similarity threshold still allows."""
    return math.floor(64 * (1 - threshold) + 1e-9)


def value_rows(prints: DataFrame) -> DataFrame:
    """simhash, first_id, n: the distinct values with their first article and how many have them."""
    return stored(prints.groupBy("simhash").agg(F.min("id").alias("first_id"), F.count("*").alias("n")), "simhash-values")


def nearest_predecessors(prints: DataFrame, threshold: float, plan: hamming.Plan | None = None) -> DataFrame:
    """id, nearest, distance: of all earlier articles within the threshold the most similar, of equals the first.

    A later article of a value has the value's first one at distance 0. So only first articles look for others, and the
    join is over distinct values."""
    values = value_rows(prints)
    copies = prints.join(values.select("simhash", "first_id"), "simhash").where("first_id < id").select("id", F.col("first_id").alias("nearest"), F.lit(0).alias("distance"))
    return hamming.nearest(values, min(most_distance(threshold), 63), plan).unionByName(copies)


def links(prints: DataFrame, threshold: float = rules.NEAR_THRESHOLD) -> DataFrame:
    """id, parent, relation_type, similarity, evidence: an exact copy's first article, else the nearest predecessor that
    reaches the threshold."""
    exact = exact_parents(prints).select("id", "parent", F.lit("exact_duplicate").alias("relation_type"), F.lit(1.0).alias("similarity"))
    near = nearest_predecessors(prints, threshold).join(exact.select("id"), "id", "left_anti")
    similarity = F.lit(1.0) - F.col("distance") / F.lit(64.0)
    near = near.select("id", F.col("nearest").alias("parent"), F.lit("near_duplicate").alias("relation_type"), similarity.alias("similarity"))
    evidence = F.when(F.col("relation_type") == "near_duplicate", text.near_evidence(F.col("similarity"), threshold)).otherwise(rules.EXACT_EVIDENCE)
    return exact.unionByName(near).withColumn("evidence", evidence)


def roots(parents: DataFrame) -> DataFrame:
    """id, root: pointers followed to their end, doubling the step each round. Parents come before their children, so
    there is no cycle; an id that is its own parent ends a chain."""
    now = stored(parents.select("id", "parent"), "pointers")
    while True:
        step = now.alias("x").join(now.select(F.col("id").alias("parent"), F.col("parent").alias("next")), "parent", "left")
        new = stored(step.select("id", F.coalesce("next", "parent").alias("parent"), F.col("next").isNotNull().alias("moved")), "pointers")
        if new.where("moved").isEmpty():
            return new.select("id", F.col("parent").alias("root"))
        now = new.select("id", "parent")


def groups(linked: DataFrame) -> DataFrame:
    """group_key, root, id: the trees of links with two members or more, the root among them."""
    tree = roots(linked)
    every = tree.unionByName(tree.select(F.col("root").alias("id"), "root").distinct())
    return every.select(F.concat(F.lit("group_"), F.md5(F.col("root").cast("string"))).alias("group_key"), "root", "id")


def length_of(articles: DataFrame) -> Column:
    """Characters of the contents; articles without `content` have them as `length`, so that no join moves texts."""
    return F.length(F.coalesce("content", F.lit(""))) if "content" in articles.columns else F.coalesce("length", F.lit(0))


def election_key(members: DataFrame) -> Column:
    """How primaries are chosen, the least first: accessible first, weight, earliest, longest, title, creation, id."""
    return F.struct(
        (~F.coalesce("is_accessible", F.lit(False))).alias("a"), (-F.coalesce("weight", F.lit(0.0))).alias("b"), F.col("published_at").isNull().alias("c"), F.col("published_at").alias("d"), (-length_of(members)).alias("e"),
        (-text.title_quality(F.col("title"))).alias("f"), F.col("created_at").alias("g"), F.col("id").alias("id"),
    )


def elect(members: DataFrame) -> DataFrame:
    """group_key, primary_id of members with the election's columns, as a minimum that is found before the shuffle."""
    return members.groupBy("group_key").agg(F.min(election_key(members)).alias("best")).select("group_key", F.col("best.id").alias("primary_id"))


def reelect(members: DataFrame, previous: DataFrame) -> DataFrame:
    """group_key, previous, chosen, changed: what a refresh of all groups finds."""
    return elect(members).join(previous, "group_key", "left").select("group_key", F.col("previous_id").alias("previous"), F.col("primary_id").alias("chosen"), (~F.col("previous_id").eqNullSafe(F.col("primary_id"))).alias("changed"))


def mark_inaccessible(members: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select("id").withColumn("__gone", F.lit(True))
    return members.join(gone, "id", "left").withColumn("is_accessible", F.coalesce("is_accessible", F.lit(False)) & F.col("__gone").isNull()).drop("__gone")


def relation_rows(members: DataFrame, linked: DataFrame) -> DataFrame:
    """The rows that the groups leave after one pass: article_id, target_article_id, group_key, relation_type, is_primary,
    similarity, evidence.

    Members join in order of id. At each join the group's primary is elected anew. When it changes, all rows are written
    again: as near ones if any row so far is near; and the primary that lost keeps similarity 1 and no evidence."""
    rows = members.join(linked.select("id", "relation_type", "similarity", "evidence"), "id", "left")
    rows = rows.withColumn("key", election_key(rows)).select("group_key", "id", "relation_type", "similarity", "evidence", "key")  # the windows move no more
    so_far = Window.partitionBy("group_key").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    onward = Window.partitionBy("group_key").orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)  # from the last row back, so each is added once
    order = Window.partitionBy("group_key").orderBy("id")
    whole = Window.partitionBy("group_key")
    rows = rows.withColumn("lead", F.min("key").over(so_far)["id"]).withColumn("near", F.coalesce(F.col("relation_type") == "near_duplicate", F.lit(False)))
    rows = rows.withColumn("any_near", F.max("near").over(so_far)).withColumn("switch", F.coalesce(F.col("lead") != F.lag("lead").over(order), F.lit(False)))
    rows = rows.withColumn("recast", F.max(F.col("switch") & F.col("any_near")).over(onward)).withColumn("primary", F.last("lead").over(whole.orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    led = F.collect_set("lead").over(whole)
    own = F.coalesce("relation_type", F.lead("relation_type").over(order))  # the founder's row has the first link's type
    lost = F.array_contains(led, F.col("id")) & (F.col("id") != F.col("primary"))
    is_primary = F.col("id") == F.col("primary")
    return rows.select(
        F.col("id").alias("article_id"), F.col("primary").alias("target_article_id"), "group_key",
        F.when(F.col("recast"), "near_duplicate").otherwise(own).alias("relation_type"), is_primary.alias("is_primary"),
        F.when(is_primary | lost, 1.0).otherwise(F.col("similarity")).alias("similarity"),
        F.when(is_primary, rules.PRIMARY_EVIDENCE).when(lost, F.lit(None)).otherwise(F.col("evidence")).alias("evidence"),
    )


def related(prints: DataFrame, linked: DataFrame, low: float = rules.RELATED_THRESHOLD, threshold: float = rules.NEAR_THRESHOLD) -> DataFrame:
    """article_id, target_article_id, similarity, evidence: the nearest predecessor of an article that joined no group, if
    it reaches `low` though not the `threshold` of merging. Created once for each pair."""
    near = nearest_predecessors(prints, low).join(linked.select("id"), "id", "left_anti")
    rows = near.select(F.col("id").alias("article_id"), F.col("nearest").alias("target_article_id"), (F.lit(1.0) - F.col("distance") / F.lit(64.0)).alias("similarity")).dropDuplicates(["article_id", "target_article_id"])
    return rows.withColumn("evidence", text.related_evidence(F.col("similarity"), threshold))


def related_both_ways(edges: DataFrame) -> DataFrame:
    """article_id, related_id: edges seen from either end, own ones left out, each once."""
    back = edges.select(F.col("target_article_id").alias("article_id"), F.col("article_id").alias("related_id"))
    return edges.select("article_id", F.col("target_article_id").alias("related_id")).unionByName(back).where("article_id <> related_id").distinct()


def members_of(relations: DataFrame, article_id) -> DataFrame:  # noqa: ANN001
    """Rows of the merge groups of one article."""
    merged = relations.where(F.col("relation_type").isin(*rules.MERGE_TYPES))
    return merged.join(merged.where(F.col("article_id") == article_id).select("group_key").distinct(), "group_key", "left_semi")


def hidden(relations: DataFrame) -> DataFrame:
    """article_id of members that their group's primary stands for."""
    return relations.where(~F.col("is_primary") & F.col("relation_type").isin(*rules.MERGE_TYPES)).select("article_id").distinct()


def group_sizes(relations: DataFrame) -> DataFrame:
    """group_key, sources: distinct members, one at least."""
    merged = relations.where(F.col("relation_type").isin(*rules.MERGE_TYPES) & F.col("group_key").isNotNull())
    return merged.groupBy("group_key").agg(F.greatest(F.lit(1), F.countDistinct("article_id")).cast("long").alias("sources"))


def hit_report(relations: DataFrame, articles: DataFrame) -> DataFrame:
    """Relations with the titles of both ends; the target may be gone."""
    a = articles.select(F.col("id").alias("article_id"), F.col("title").alias("article_title"))
    b = articles.select(F.col("id").alias("target_article_id"), F.col("title").alias("target_title"))
    return relations.join(a, "article_id").join(b, "target_article_id", "left").withColumn("similarity", F.round("similarity", 4))


def tier(similarity: Column, threshold: float, low: float = rules.RELATED_THRESHOLD) -> Column:
    return F.when(similarity >= threshold, "near").when(similarity >= low, "related").otherwise("none")


def preview(prints: DataFrame, current: float, proposed: float, low: float = rules.RELATED_THRESHOLD) -> DataFrame:
    """change, pairs: would_merge, would_unmerge, unchanged: what another threshold would do to pairs of articles.

    Pairs are counted on distinct (content, simhash) values with how many articles have them. Only pairs that reach the
    lower of the two thresholds can change, so no others are looked for, and those found are summed by distance where they
    are found; the number of the unchanged ones, among them all pairs of equal contents, follows from the total."""
    within = same_values(prints)
    across = hamming.counts(value_rows(prints), most_distance(min(current, proposed)))
    s = F.lit(1.0) - F.col("distance") / F.lit(64.0)
    old, new = tier(s, current, low), tier(s, proposed, low)
    change = F.when((old != "near") & (new == "near"), "would_merge").when((old == "near") & (new != "near"), "would_unmerge").otherwise("unchanged")
    changed = stored(within.unionByName(across).groupBy(change.alias("change")).agg(F.sum("w").alias("pairs")).where("pairs > 0 and change <> 'unchanged'"), "preview-changes")
    return with_unchanged(prints, changed)


def with_unchanged(prints: DataFrame, changes: DataFrame) -> DataFrame:
    """Counts of changed pairs (change, pairs) with a row `unchanged` for all other pairs of articles."""
    n = F.col("n").cast("decimal(20,0)")
    rest = prints.agg(F.count("*").alias("n")).crossJoin(changes.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("some")))  # one row each
    rest = rest.select(F.lit("unchanged").alias("change"), (n * (n - 1) / 2 - F.col("some")).cast("long").alias("pairs"))
    return changes.select("change", F.col("pairs").cast("long").alias("pairs")).unionByName(rest)


def same_values(prints: DataFrame, *group: str) -> DataFrame:
    """(distance 0, w): pairs of articles of one simhash with other contents, within `group` if given."""
    same = prints.groupBy(*group, "simhash", "content_hash").agg(F.count("*").alias("k"))
    return same.groupBy(*group, "simhash").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("sq")).select(F.lit(0).alias("distance"), ((F.col("n") * F.col("n") - F.col("sq")) / 2).cast("long").alias("w"))


def preview_stored_counts(prints: DataFrame, group_members: DataFrame, edges: DataFrame, proposed: float, low: float = rules.RELATED_THRESHOLD) -> DataFrame:
    """change, pairs: how many rows of each change preview_stored() has, without a list of pairs.

    Pairs are summed by state and distance: those of one group within it, related ones from their edges; what is left of all
    pairs at a distance has no state. An article is in one group at most, as groups() has it."""
    bounds = sorted({most_distance(proposed), most_distance(min(proposed, low))})  # what pairs become follows from these alone
    total = same_values(prints).unionByName(hamming.counts(value_rows(prints), bounds[-1], bounds=tuple(bounds))).withColumn("state", F.lit("none"))
    own = prints.join(group_members.select("id", F.col("group_key").alias("g")), "id")
    merged = same_values(own, "g").unionByName(hamming.counts_within(stored(own.groupBy("g", "simhash").agg(F.count("*").alias("n")), "group-values"), (*bounds, 64))).withColumn("state", F.lit("near_duplicate"))
    g = group_members.select("group_key", "id")
    ends = edges.select(F.least("article_id", "target_article_id").alias("x"), F.greatest("article_id", "target_article_id").alias("y")).where("x < y").distinct()
    for end in "xy":
        ends = ends.join(prints.select(F.col("id").alias(end), F.col("simhash").alias(f"s{end}"), F.col("content_hash").alias(f"h{end}")), end).join(g.select(F.col("id").alias(end), F.col("group_key").alias(f"g{end}")), end, "left")
    ends = ends.where("hx <> hy and coalesce(gx <> gy, true)")
    linked = ends.groupBy(text.hamming(F.col("sx"), F.col("sy")).cast("int").alias("distance")).agg(F.count("*").alias("w")).withColumn("state", F.lit("related"))
    some = stored(merged.unionByName(linked).groupBy("state", "distance").agg(F.sum("w").alias("w")), "stored-pairs")
    rest = total.unionByName(some.where(F.col("distance") <= most_distance(min(proposed, low))).select("distance", (-F.col("w")).alias("w"), F.lit("none").alias("state")))
    s = F.lit(1.0) - F.col("distance") / F.lit(64.0)
    new = F.when(s >= proposed, "near_duplicate").when(s >= low, "related").otherwise("none")
    change = F.when(F.col("proposed") == "near_duplicate", "would_merge").when(F.col("state") == "near_duplicate", "would_unmerge").when(F.col("proposed") == "related", "would_relate").otherwise("would_unrelate")
    every = rest.unionByName(some.select("distance", "w", "state")).withColumn("proposed", new).where("state <> proposed")
    return every.groupBy(change.alias("change")).agg(F.sum("w").alias("pairs")).where("pairs > 0")


def preview_stored(prints: DataFrame, group_members: DataFrame, edges: DataFrame, proposed: float, low: float = rules.RELATED_THRESHOLD) -> DataFrame:
    """article_id, other_article_id, similarity, current, proposed, change: pairs of articles with other contents whose
    stored state is not what another threshold would give. group_members: group_key, id; edges: article_id,
    target_article_id of related pairs. Stored pairs and pairs at `low` or above are looked at; no other can change."""
    values = value_rows(prints)
    near = hamming.pairs(values, most_distance(min(proposed, low)))
    near = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance")).unionByName(values.select(F.col("simhash").alias("a"), F.col("simhash").alias("b"), F.lit(0).alias("distance")))
    x = prints.select(F.col("id").alias("article_id"), F.col("simhash").alias("a"), F.col("content_hash").alias("h"))
    y = prints.select(F.col("id").alias("other_article_id"), F.col("simhash").alias("b"), F.col("content_hash").alias("k"))
    alike = x.join(near, "a").join(y, "b").where("article_id < other_article_id").select("article_id", "other_article_id")
    g = group_members.select("group_key", "id")
    merged = g.withColumnRenamed("id", "article_id").join(g.withColumnRenamed("id", "other_article_id"), "group_key").where("article_id < other_article_id").select("article_id", "other_article_id", F.lit("near_duplicate").alias("state"))
    linked = edges.select(F.least("article_id", "target_article_id").alias("article_id"), F.greatest("article_id", "target_article_id").alias("other_article_id"), F.lit("related").alias("state")).where("article_id < other_article_id")
    state = merged.unionByName(linked).groupBy("article_id", "other_article_id").agg(F.min("state").alias("state"))  # merged before related
    pairs = alike.join(state, ["article_id", "other_article_id"], "full").join(x, "article_id").join(y, "other_article_id").where("h <> k")
    s = text.simhash_similarity(F.col("a"), F.col("b"))
    new = F.when(s >= proposed, "near_duplicate").when(s >= low, "related").otherwise("none")
    rows = pairs.select("article_id", "other_article_id", F.round(s, 4).alias("similarity"), F.coalesce("state", F.lit("none")).alias("current"), new.alias("proposed")).where("current <> proposed")
    change = F.when(F.col("proposed") == "near_duplicate", "would_merge").when(F.col("current") == "near_duplicate", "would_unmerge").when(F.col("proposed") == "related", "would_relate").otherwise("would_unrelate")
    return rows.withColumn("change", change)
