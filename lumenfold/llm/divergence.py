"""Source divergence audit: how far the word use of each source is from that of every other source of its language, and of
which words it has more than its language. All arithmetic is in whole numbers.

Of two sources' shares p and q of a term (parts of 10^9, smoothed), f = floor((p - q)^2 / (p + q)); a pair's value is the sum
of f over all kept terms. Most counts are zero, so a pair starts at V times the f of two zero counts, and the inverted index
of terms gives what differs from that:

* a term that one of both has: the same for all terms with one count, so a source's histogram of counts is enough;
* a term that both have: its postings meet, and give f less the two one-sided values plus the f of zeros.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import mapped, stored, utf8

#: A-Z are lowered, all other ASCII but a-z separates terms, bytes of other characters stay.
TERM_BYTES = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Terms of all groups that a task gathers before it sends them on; some 150 bytes each.
GATHERED = 300_000
#: Parts in which a language's sources are joined with all its others.
SALTS = 16
#: p is a share of so many.
WHOLE = 1_000_000_000


def term_counts(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """(lang, source, term, count, docs) of the rows of a task, and with an empty term one row at least for each group."""
    fields = ["lang", "source", "term", "count", "docs"]

    def batch(groups: dict[tuple[str, str], dict[bytes, int]]) -> pa.RecordBatch:
        lang, source, term, packed = [], [], [], []
        for (a, b), found in groups.items():
            lang += [a] * len(found)
            source += [b] * len(found)
            term += found
            packed += found.values()
        counts, n_docs = [x >> 32 for x in packed], [x & 0xFFFFFFFF for x in packed]
        columns = [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(n_docs, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], dict[bytes, int]] = defaultdict(lambda: {b"": 0})
        size = 0
        for b in batches:
            for text, lang, source in zip(utf8(b, "body"), b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True):
                found = groups[lang, source]
                before = len(found)
                for term, n in Counter(text.translate(TERM_BYTES).split()).items():
                    found[term] = found.get(term, 0) + (n << 32) + 1  # occurrences above, documents below
                size += len(found) - before
                if size >= GATHERED:
                    yield batch(groups)
                    groups.clear()
                    size = 0
        if groups:
            yield batch(groups)

    known = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    rows = docs.select(known(lang_col).alias("lang"), known(source_col).alias("source"), known(text_col).alias("body"))
    return mapped(rows, run, "lang string, source string, term string, count long, docs long")


def share(count: Column, total: Column, terms: Column) -> Column:
    """p = 1 + floor(10^9 (count + 2) / (total + 2 terms)), exact: products of longs may pass 64 bits. Null without terms."""
    over = (total + 2 * terms).cast("decimal(20,0)")
    top = F.lit(WHOLE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    return F.when(terms > 0, F.lit(1).cast("long") + F.call_function("div", top, over))


def gap(p: Column, q: Column) -> Column:
    """f of two shares; both are at most 10^9 + 1, so their difference's square is a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def with_others(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Each row (lang, source, ...) with every other source of its language: columns other, other_zero. Salted: a language
    is SALTS keys, as one may hold most sources."""
    spread = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    other = groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("other_zero"), F.pmod(F.xxhash64("source"), F.lit(SALTS)).cast("int").alias("salt"))
    return spread.join(other, ["lang", "salt"]).where("source <> other")


def divergence(docs: DataFrame, least_docs: int = 10, top: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: how each source of a language differs.

    Part `pair`: item is each other source of the language, value the sum of f over the language's kept terms (0 without
    any), all ranks. Part `term`: item is each kept term that the source has and has more of than its language, value f,
    ranks to `top`. Ranks go by value from the largest, then by item.

    Null language, source and text are ''. A term is a run of ASCII letters and characters beyond ASCII, A-Z lowered; kept
    are those in `least_docs` rows of a language or more. A source without terms is a group too; a language with one source
    has no pairs. Repeated rows count as often as they are there, ids and other columns are not read. An empty table gives no
    rows.
    """
    counted = term_counts(docs, lang_col, source_col, text_col).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    counted = stored(counted, "term-counts")
    kept = counted.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("total")).where(F.col("docs") >= least_docs)
    kept = stored(kept.select("lang", "term", "total"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    postings = counted.where("count > 0").select("lang", "source", "term", "count").join(kept, ["lang", "term"])
    sums = postings.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = counted.where("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n", "v", "lang_n"])
    groups = stored(groups.withColumn("zero", share(F.lit(0).cast("long"), F.col("n"), F.col("v"))), "sources")
    shares = postings.join(groups, ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("n"), F.col("v")))
    shares = stored(shares.select("lang", "source", "term", "count", "p", "zero", share(F.col("total"), F.col("lang_n"), F.col("v")).alias("q")), "postings")
    return pair_part(shares, groups).unionByName(term_part(shares, top))


def pair_part(shares: DataFrame, groups: DataFrame) -> DataFrame:
    base = with_others(groups, groups).where("source < other").select("lang", F.col("source").alias("a"), F.col("other").alias("b"), F.when(F.col("v") > 0, F.col("v") * gap(F.col("zero"), F.col("other_zero"))).otherwise(F.lit(0)).cast("long").alias("value"))
    levels = shares.groupBy("lang", "source", "zero", "p").agg(F.count("*").alias("terms"))
    alone = F.col("terms") * (gap(F.col("p"), F.col("other_zero")) - gap(F.col("zero"), F.col("other_zero")))
    one = with_others(levels, groups).select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), alone.alias("value"))
    x, y = (shares.select("lang", "term", F.col("source").alias(f"{s}_source"), F.col("p").alias(f"{s}_p"), F.col("zero").alias(f"{s}_zero")) for s in "ab")
    met = gap(F.col("a_p"), F.col("b_p")) - gap(F.col("a_p"), F.col("b_zero")) - gap(F.col("a_zero"), F.col("b_p")) + gap(F.col("a_zero"), F.col("b_zero"))
    both = x.join(y, ["lang", "term"]).where("a_source < b_source").select("lang", F.col("a_source").alias("a"), F.col("b_source").alias("b"), met.alias("value")).where("value <> 0")
    # Summed apart, so that each kind is one row a pair and task before the shuffle.
    values = base.unionByName(summed(one)).unionByName(summed(both)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    values = stored(values, "pair-values")
    ways = values.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(values.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    return ranked(ways, "pair")


def summed(values: DataFrame) -> DataFrame:
    return values.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def term_part(shares: DataFrame, top: int) -> DataFrame:
    more = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    return ranked(more, "term").where(F.col("rank") <= top)


def ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
