"""Duplicate groups kept up to date: new links are united with the stored forest of pointers, and only the groups that they
touch are read, joined and elected anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import text
from ..sources.parts import Parts
from ..sources.store import stored
from . import dedup

#: The columns of an article that an election looks at; `content` and `title` are held as what counts of them.
ELECTION = "is_accessible boolean, weight double, published_at timestamp, length long, quality long, created_at timestamp"


def state(spark: SparkSession, path: str, buckets: int = 256) -> Parts:
    """Three tables. trees: id, root of each article in a group; members: root, id and what elections look at; primaries:
    root, group_key, primary_id."""
    long = lambda *names: [StructField(n, LongType()) for n in names]
    seen = spark.createDataFrame([], ELECTION).schema.fields
    tables = {"trees": ("id", StructType(long("id", "root"))), "members": ("root", StructType([*long("root", "id"), *seen])), "primaries": ("root", StructType([*long("root"), StructField("group_key", StringType()), *long("primary_id")]))}
    return Parts(spark, path, tables, buckets)


def candidates(articles: DataFrame) -> DataFrame:
    """Articles (id, title, content or length, ...) with the columns that an election looks at."""
    return articles.select("id", "is_accessible", F.col("weight").cast("double").alias("weight"), "published_at", dedup.length_of(articles).cast("long").alias("length"), text.title_quality(F.col("title")).cast("long").alias("quality"), "created_at")


def elected(members: DataFrame) -> DataFrame:
    """root, group_key, primary_id by the order of dedup.election_key(), as a minimum that is found before the shuffle."""
    order = [~F.coalesce("is_accessible", F.lit(False)), -F.coalesce("weight", F.lit(0.0)), F.col("published_at").isNull(), F.col("published_at"), -F.col("length"), -F.col("quality"), F.col("created_at"), F.col("id")]
    best = F.min(F.struct(*[c.alias(f"c{n}") for n, c in enumerate(order)]))
    return members.groupBy("root").agg(best.alias("best")).select("root", F.concat(F.lit("group_"), F.md5(F.col("root").cast("string"))).alias("group_key"), F.col(f"best.c{len(order) - 1}").alias("primary_id"))


def absorb(kept: Parts, links: DataFrame, articles: DataFrame) -> int:
    """Unite new links (id, parent; a parent is older than its id) with the stored groups; the number of the state's new
    version. articles: all that links name and no group has yet, at least (see candidates()).

    A link whose id has a parent already (stored as no root of its own) is left out, and of several links of one id in a batch
    the one with the smallest parent counts; so each article has one pointer and the result is what dedup.groups() makes of
    all links at once. Null ids are left out. A link may hang a stored root below an older article: its whole group moves.

    What is read: the buckets of the ids that the links name, then those of the groups touched. The driver gets bucket
    numbers. What is written is in proportion to the groups touched, whose rows are spread over tasks. An empty batch changes
    nothing and makes no version."""
    before = kept.version()
    new = stored(links.where("id is not null and parent is not null and id <> parent").groupBy("id").agg(F.min("parent").alias("parent")), "forest-links")
    ends = new.select("id").union(new.select("parent")).distinct()
    known = stored(kept.read("trees", kept.touched(ends), before).join(ends, "id", "left_semi"), "forest-known")
    rooted = new.join(known.withColumnRenamed("root", "own"), "id", "left").where("own is null or own = id")
    above = known.select(F.col("id").alias("parent"), F.col("root").alias("above"))
    pointers = stored(rooted.join(above, "parent", "left").select("id", F.coalesce("above", "parent").alias("parent")), "forest-pointers")
    if pointers.isEmpty():
        return before
    moved = stored(dedup.roots(pointers), "forest-roots")  # each a new article or a stored root, with the root it has now
    roots = moved.select("root").distinct()
    reached = stored(moved.select(F.col("id").alias("old"), "root").union(roots.select(F.col("root").alias("old"), "root")), "forest-reached")
    group_buckets = kept.touched(roots.union(moved.join(known, "id", "left_semi").select("id")))  # a new article had no group
    members = kept.read("members", group_buckets, before)
    untouched = members.join(reached.select(F.col("old").alias("root")), "root", "left_anti")
    names = kept.tables["members"][1].names
    gathered = members.withColumnRenamed("root", "old").join(reached, "old").select(*names, (F.col("old") != F.col("root")).alias("moved"))
    fresh = reached.select(F.col("old").alias("id"), "root").join(gathered.select("id"), "id", "left_anti").join(articles, "id").select(*names, F.lit(True).alias("moved"))
    now = stored(gathered.unionByName(fresh), "forest-members")
    changed = now.where("moved").select("id", "root")
    id_buckets = kept.touched(changed.select("id"))
    trees = kept.read("trees", id_buckets, before).join(changed.select("id"), "id", "left_anti").unionByName(changed)
    primaries = kept.read("primaries", group_buckets, before).join(reached.select(F.col("old").alias("root")), "root", "left_anti").unionByName(elected(now))
    return kept.commit({"trees": (trees, id_buckets), "members": (untouched.unionByName(now.select(*names)), group_buckets), "primaries": (primaries, group_buckets)}, before)


def refresh(kept: Parts, changes: DataFrame) -> int:
    """Articles changed (candidates() of them: no longer reachable, say): the groups that have one elect again, no others.
    Articles in no group are left out. The number of the state's new version."""
    before = kept.version()
    given = stored(changes.dropDuplicates(["id"]), "forest-changes")
    hit = stored(kept.read("trees", kept.touched(given.select("id")), before).join(given.select("id"), "id", "left_semi"), "forest-hit")
    if hit.isEmpty():
        return before
    roots = hit.select("root").distinct()
    buckets = kept.touched(roots)
    members = kept.read("members", buckets, before)
    names = kept.tables["members"][1].names
    own = members.join(roots, "root", "left_semi")
    now = stored(own.join(given.select("id"), "id", "left_anti").select(*names).unionByName(hit.join(given, "id").select(*names)), "forest-members")
    primaries = kept.read("primaries", buckets, before).join(roots, "root", "left_anti").unionByName(elected(now))
    return kept.commit({"members": (members.join(roots, "root", "left_anti").unionByName(now), buckets), "primaries": (primaries, buckets)}, before)


def groups(kept: Parts) -> DataFrame:
    """group_key, root, id, primary_id of all groups as they are now."""
    return kept.read("trees").join(kept.read("primaries"), "root").select("group_key", "root", "id", "primary_id")
