"""Hard-negative mining: for anchors and their best rows of the same label, rows of other labels that score almost as high.

Blocks of anchors, bounded in bytes, are broadcast and multiplied with blocks of all rows in float64, which is exact while
products stay below 2^53 (beyond it in 64-bit whole numbers). Each task keeps the best few of each anchor; these merge by
rank. A first pass finds the positives, a second one the negatives within the score window of each positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import mapped, stored

#: Bytes of the vectors of one broadcast block of anchors.
BLOCK_BYTES = 16 << 20
#: Anchors, and rows, of one product: 32 MB of scores.
TILE_ANCHORS, TILE_ROWS = 1024, 4096
NONE = np.iinfo(np.int64).min


def whole(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """(ids, labels, {length: (positions, matrix)}) of the rows that take part: components times `scale`, floored."""
    ids, labels, vectors = batch.column("id"), batch.column("label"), batch.column("vec")
    size = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.zeros(0, np.int64)
    start = vectors.offsets.to_numpy()[:-1].astype(np.int64) if len(vectors) else size
    usable = np.asarray(vectors.is_valid()) & np.asarray(ids.is_valid()) & np.asarray(labels.is_valid())
    parts = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    with np.errstate(over="ignore", invalid="ignore"):
        parts = np.floor(parts * scale)
    found = {}
    for n in np.unique(size[usable]).tolist():
        at = np.flatnonzero(usable & (size == n))
        matrix = parts[start[at, None] + np.arange(n)]
        good = np.isfinite(matrix).all(1)
        if good.any():
            found[n] = at[good], matrix[good]
    as_long = lambda c: c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return as_long(ids), as_long(labels), found


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all of b, exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most >= 2**63:
        raise ValueError("inner products pass 64 bits")
    return a.astype(np.int64) @ b.astype(np.int64).T


class Best:
    """The k best (score, id) of each of n keys: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int) -> None:
        self.score, self.id, self.k = np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max), k

    def add(self, at: int, scores: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        """scores, fits: of the keys at, at + 1, ... (rows) with candidates `ids` (columns)."""
        top, k = at + len(scores), self.k
        fits = fits & (scores >= self.score[at:top, -1:])
        if scores.shape[1] > k and np.count_nonzero(fits) > 16 * len(scores):
            fits &= scores >= np.partition(np.where(fits, scores, NONE), -k, axis=1)[:, -k, None]
        r, c = np.nonzero(fits)
        if not len(r):
            return
        hit = np.unique(r)
        r = np.concatenate([r, np.repeat(hit, k)])
        s = np.concatenate([scores[r[: len(c)], c], self.score[at + hit].ravel()])
        i = np.concatenate([ids[c], self.id[at + hit].ravel()])
        order = np.lexsort((i, np.negative(np.maximum(s, NONE + 1)), r))
        r, s, i = r[order], s[order], i[order]
        begin = np.flatnonzero(np.diff(r, prepend=-1))
        place = np.arange(len(r)) - np.repeat(begin, np.diff(np.append(begin, len(r))))
        good = place < k
        self.score[at + r[good], place[good]], self.id[at + r[good], place[good]] = s[good], i[good]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, score, id) of what was found."""
        key, place = np.nonzero(self.score > NONE)
        return key, self.score[key, place], self.id[key, place]


def tiles(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """{length: (ids, labels, matrix)} of some TILE_ROWS rows at a time."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    size = 0
    for batch in batches:
        ids, labels, found = whole(batch, scale)
        for n, (at, matrix) in found.items():
            held.setdefault(n, []).append((ids[at], labels[at], matrix))
            size += len(at)
        if size >= TILE_ROWS:
            yield {n: tuple(np.concatenate(x) for x in zip(*parts, strict=True)) for n, parts in held.items()}
            held, size = {}, 0
    if held:
        yield {n: tuple(np.concatenate(x) for x in zip(*parts, strict=True)) for n, parts in held.items()}


def slices(rows: dict[int, tuple], anchors: dict[int, tuple]) -> Iterator[tuple]:
    """(length, where these anchors begin, anchors' ids and labels, rows' ids and labels, scores) tile by tile."""
    for n, (ids, labels, matrix) in rows.items():
        if n in anchors:
            own_ids, own_labels, own = anchors[n]
            for low in range(0, len(ids), TILE_ROWS):
                span = slice(low, low + TILE_ROWS)
                for at in range(0, len(own), TILE_ANCHORS):
                    part = slice(at, at + TILE_ANCHORS)
                    yield n, at, own_ids[part], own_labels[part], ids[span], labels[span], products(own[part], matrix[span])


def positives_task(block, scale: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, anchors = block.value
        best = {n: Best(len(x[0]), k) for n, x in anchors.items()}
        for rows in tiles(batches, scale):
            for n, at, own_ids, own_labels, ids, labels, scores in slices(rows, anchors):
                best[n].add(at, scores, ids, (own_labels[:, None] == labels) & (own_ids[:, None] != ids))
        for n, b in best.items():
            key, score, other = b.rows()
            yield pa.RecordBatch.from_arrays([pa.array(places[n][key]), pa.array(score), pa.array(other)], names=["anchor", "score", "other"])

    return run


def negatives_task(block, windows, scale: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    """windows: {length: (low, high)}, each of shape (positives, anchors); an empty window is low > high."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (places, anchors), bounds = block.value, windows.value
        best = {n: [Best(len(x[0]), k) for _ in bounds[n][0]] for n, x in anchors.items()}
        for rows in tiles(batches, scale):
            for n, at, own_ids, own_labels, ids, labels, scores in slices(rows, anchors):
                other, low, high = own_labels[:, None] != labels, bounds[n][0], bounds[n][1]
                for w, b in enumerate(best[n]):
                    span = slice(at, at + len(own_ids))
                    b.add(at, scores, ids, other & (scores >= low[w, span, None]) & (scores <= high[w, span, None]))
        for n, each in best.items():
            for w, b in enumerate(each):
                key, score, other = b.rows()
                yield pa.RecordBatch.from_arrays([pa.array(places[n][key]), pa.array(np.full(len(key), w + 1, np.int32)), pa.array(score), pa.array(other)], names=["anchor", "place", "score", "other"])

    return run


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component x counts as floor(scale * x), a row's score is its inner product with the anchor; higher scores come first,
    then smaller ids. `anchors` says which rows are anchors. An anchor's positives are its first rows of the same label with
    another id. For each of them, the negatives are the first rows of another label with
    low * positive_score <= 100 * negative_score <= high * positive_score; rank counts them from 1.

    Rows with a null id, label or vector, or with a component that is null or not finite, take no part. Only vectors of one
    length meet. Repeated rows are rows of their own: each is counted, a repeated anchor gives its rows again. Other columns
    are not read. An empty table, or one without anchors, gives no rows. Scores beyond 64 bits raise an error.

    The table is read twice for each BLOCK_BYTES of anchors. What tasks send on is `positives` (or positives x negatives)
    rows an anchor at most.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    mine = vectors.where(anchors).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    mine = stored(mine.where("id is not null and label is not null and vec is not null").withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    size = mine.agg(F.sum(8 * (F.size("vec") + 3))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    at = F.pmod(F.xxhash64("anchor"), F.lit(max(blocks, 1)))
    sent, found = [], []
    for n in range(blocks):
        table = mine.where(at == n).toArrow().combine_chunks()
        batch = pa.RecordBatch.from_arrays([c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns], schema=table.schema)
        ids, labels, parts = whole(batch, scale)
        number = batch.column("anchor").to_numpy()
        block = spark.sparkContext.broadcast(({k: number[p] for k, (p, _) in parts.items()}, {k: (ids[p], labels[p], m) for k, (p, m) in parts.items()}))
        found.append(stored(mapped(rows, positives_task(block, scale, positives), "anchor long, score long, other long"), "positives"))
        sent.append(block)
    nothing = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not blocks:
        return nothing
    order = lambda *keys: Window.partitionBy(*keys).orderBy(F.desc("score"), "other")
    best = united(found).withColumn("place", F.row_number().over(order("anchor"))).where(F.col("place") <= positives)
    best = stored(best, "best-positives")
    more = []
    for n, block in enumerate(sent):
        have = best.join(mine.where(at == n).select("anchor"), "anchor").toArrow()
        score = dict(zip(zip(have.column("anchor").to_pylist(), have.column("place").to_pylist(), strict=True), have.column("score").to_pylist(), strict=True))
        bounds = {}
        for k, numbers in block.value[0].items():
            of = [[score.get((a, p + 1)) for a in numbers.tolist()] for p in range(positives)]
            bounds[k] = tuple(np.array([[empty if s is None else f(s) for s in row] for row in of], np.int64) for empty, f in ((1, lambda s: -(-low * s // 100)), (0, lambda s: high * s // 100)))
        more.append(stored(mapped(rows, negatives_task(block, spark.sparkContext.broadcast(bounds), scale, negatives), "anchor long, place int, score long, other long"), "negatives"))
        block.unpersist()
    chosen = united(more).withColumn("rank", F.row_number().over(order("anchor", "place"))).where(F.col("rank") <= negatives)
    chosen = chosen.select("anchor", "place", "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    out = chosen.join(best.select("anchor", "place", F.col("other").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor", "place"])
    return out.join(mine.select("anchor", F.col("id").alias("anchor_id")), "anchor").select(nothing.columns)


def united(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
