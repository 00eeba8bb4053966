"""Many keywords in many texts: one automaton over all distinct keywords runs once over each text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..sources.store import stored

#: Characters of the keywords of one automaton; more keywords are several automata, each a pass over the texts.
MOST_CHARS = 8_000_000
#: Found needles that a task holds before it hands them on.
MOST_FOUND = 20_000


def containing(texts: DataFrame, needles: DataFrame, prepare: Callable[[str], str] | None = None) -> DataFrame:
    """(id, needle): which needles each text contains. texts: id long, haystack; needles: needle, distinct and not empty.
    Both are compared character by character: needles as they are, texts as `prepare` makes them, in the same Python worker."""
    spark = texts.sparkSession
    ship(spark)
    words = stored(needles.select("needle").where("needle <> ''").distinct(), "needles")
    size = words.agg(F.sum(F.length("needle"))).first()[0] or 0
    parts, out = -(-size // MOST_CHARS), None
    for n in range(parts):
        own = words.where(F.pmod(F.xxhash64("needle"), F.lit(parts)) == n)
        one = search(texts, spark.sparkContext.broadcast([r[0] for r in own.collect()]), prepare)  # MOST_CHARS, about
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], "id long, needle string") if out is None else out


def search(texts: DataFrame, shared, prepare: Callable[[str], str] | None = None) -> DataFrame:  # noqa: ANN001
    """One text is a Python string at a time, however many a batch has, and found needles leave in bounded batches."""
    most = MOST_FOUND

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        words = shared.value
        for k, word in enumerate(words):
            automaton.add_word(word, k)
        if words:
            automaton.make_automaton()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], names=["id", "needle"])
        ids, found = [], []
        for b in batches:
            for key, text in zip(b.column("id"), b.column("haystack"), strict=True):
                text = text.as_py()
                text = prepare(text) if prepare and text else text
                hit = {k for _, k in automaton.iter(text)} if words and text else ()
                ids += [key.as_py()] * len(hit)
                found += [words[k] for k in hit]
                if len(ids) >= most:
                    yield rows()
                    ids, found = [], []
        yield rows()

    return texts.select(F.col("id").cast("long").alias("id"), "haystack").mapInArrow(run, "id long, needle string")
