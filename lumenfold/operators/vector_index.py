"""Exact nearest neighbours by cosine: entries in k-means cells, cells left out by the triangle inequality.

Of unit vectors, cosine c is distance sqrt(2 - 2c). An entry of a cell with centre m and radius r is at least |q - m| - r from a
point q. So a point first searches the nearest cells that hold k entries; its k-th distance there, or that of the least
similarity, bounds all other cells that it must visit. No entry goes through the driver: only centres, radii and counts of
cells do, of which there are MOST_CELLS at most for each dimension. Cells with many entries or many visits are split.

Where no least similarity bounds the search, a point visits most cells, and products() costs less: blocks of points meet blocks
of entries, so that a vector is sent once for each block of the other side, and not once for each cell."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from ..sources.store import stored

#: Vectors that the centres are fitted to, chosen by a hash of the id; cells of a dimension, and dimensions, at most.
SAMPLE, MOST_CELLS, MOST_DIMENSIONS = 20_000, 1024, 64
ROUNDS = 6
#: Entries, and visits, of one task of a cell.
ENTRIES, VISITS = 8192, 65_536
#: Distances are compared with this much to spare, so that rounding loses nothing.
SLACK = 1e-6
#: Of products(): bytes of vectors in a block, numbers in one product, and tasks that a search is dealt to at least.
BLOCK_BYTES, AT_ONCE, TASKS = 16 << 20, 1 << 18, 24
#: Rows of visits that leave a task at once.
VISIT_ROWS = 4096


@dataclass
class Cells:
    """entries: dim, cell, part, entry_id, unit; centres, radii and counts by dimension; parts: how many a cell has."""

    entries: DataFrame
    centres: dict[int, np.ndarray]
    radii: dict[int, np.ndarray]
    counts: dict[int, np.ndarray]

    def parts(self, dim: int, cell: int) -> int:
        return max(1, -(-int(self.counts[dim][cell]) // ENTRIES))


def vector(c: str) -> Column:
    return F.coalesce(F.col(c).cast("array<double>"), F.array().cast("array<double>"))


def units(series: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{dimension: (positions, unit vectors)} of those with a norm above zero."""
    sizes, out = series.map(len).to_numpy(), {}
    for d in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == d)
        m = np.array(series.iloc[at].tolist(), np.float64)
        norm = np.linalg.norm(m, axis=1)
        good = norm > 0
        if good.any():
            out[d] = at[good], m[good] / norm[good, None]
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0))


def fit(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres by Lloyd's rounds, from evenly spaced rows of the sample; the same for the same sample."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(ROUNDS):
        near = distances(sample, centres).argmin(1)
        for c in np.unique(near).tolist():
            centres[c] = sample[near == c].mean(0)
    return centres


def build(entries: DataFrame, cells: int | None = None) -> Cells:
    """The index of entries (entry_id long, embedding). Entries without a vector, or of norm zero, are left out."""
    spark = entries.sparkSession
    ship(spark)
    rows = entries.select("entry_id", vector("embedding").alias("embedding")).where(F.size("embedding") > 0)
    dims = [(r["d"], r["n"]) for r in rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(MOST_DIMENSIONS + 1).collect()]
    if len(dims) > MOST_DIMENSIONS:
        raise ValueError(f"vectors of more than {MOST_DIMENSIONS} dimensions")
    centres = {}
    for d, n in dims:
        own = rows.where((F.size("embedding") == d) & (F.xxhash64("entry_id") <= F.lit(-(2**63) + int(2**64 * min(1.0, SAMPLE / n)) - 1)))
        found = units(own.orderBy("entry_id").limit(2 * SAMPLE).toPandas()["embedding"])
        if d in found:
            centres[d] = fit(found[d][1], max(1, min(cells or int(n**0.5 / 2), MOST_CELLS, len(found[d][1]))))
        else:
            centres[d] = np.eye(1, d)  # a sample of zero vectors: one cell for what else there is
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, (at, m) in units(b["embedding"]).items():
                away = distances(m, shared.value[d])
                cell = away.argmin(1)
                yield pd.DataFrame({"dim": d, "cell": cell, "entry_id": b["entry_id"].to_numpy()[at], "unit": pd.Series(list(m), dtype=object), "away": away[np.arange(len(cell)), cell]})

    told = stored(rows.mapInPandas(assign, "dim int, cell int, entry_id long, unit array<double>, away double"), "cells")
    radii = {d: np.zeros(len(c)) for d, c in centres.items()}
    counts = {d: np.zeros(len(c), np.int64) for d, c in centres.items()}
    for r in told.groupBy("dim", "cell").agg(F.max("away").alias("r"), F.count("*").alias("n")).collect():  # a row for each cell
        radii[r["dim"]][r["cell"]], counts[r["dim"]][r["cell"]] = r["r"], r["n"]
    index = Cells(told, centres, radii, counts)
    many = [(d, c, index.parts(d, c)) for d in centres for c in range(len(centres[d]))]
    parts = spark.createDataFrame(many, "dim int, cell int, parts int")
    index.entries = told.join(F.broadcast(parts), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("entry_id"), F.col("parts")).cast("int")).drop("parts", "away")
    return index


def visits(points: DataFrame, index: Cells, k: int, first: bool, farthest: float) -> DataFrame:
    """(point_id, dim, cell, unit) of cells to search; points: point_id, embedding, and if not `first`, kth (the k-th distance
    found in the first cells, null for none). The first cells of a point are the nearest that hold k entries together."""
    centres, radii, counts = index.centres, index.radii, index.counts
    shared = points.sparkSession.sparkContext.broadcast((centres, radii, counts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, radii, counts = shared.value
        for b in batches:
            for d, (at, m) in units(b["embedding"]).items():
                if d not in centres:
                    continue
                away = distances(m, centres[d])
                order = np.argsort(np.where(counts[d] > 0, away, np.inf), axis=1, kind="stable")
                filled = np.cumsum(counts[d][order], axis=1)
                lead = np.zeros(away.shape, bool)
                np.put_along_axis(lead, order, np.concatenate([np.zeros((len(m), 1), np.int64), filled[:, :-1]], axis=1) < k, axis=1)
                if first:
                    take = lead
                else:
                    kth = np.minimum(b["kth"].to_numpy(np.float64)[at], farthest)
                    take = ~lead & (away - radii[d] <= np.where(np.isnan(kth), farthest, kth)[:, None] + SLACK)
                p, c = np.nonzero(take & (counts[d] > 0))
                for n in range(0, len(p), VISIT_ROWS):
                    i = p[n : n + VISIT_ROWS]
                    yield pd.DataFrame({"point_id": b["point_id"].to_numpy()[at[i]], "dim": d, "cell": c[n : n + VISIT_ROWS], "unit": pd.Series(list(m[i]), dtype=object)})

    return points.mapInPandas(run, "point_id long, dim int, cell int, unit array<double>")


def search_cells(asked: DataFrame, index: Cells, least: float, k: int) -> DataFrame:
    """(point_id, entry_id, similarity): of each visited part of a cell the best k at `least` or above."""
    spark = asked.sparkSession
    asked = stored(asked, "visits")
    per_cell = asked.groupBy("dim", "cell").agg(F.count("*").alias("n")).collect()  # a row for each cell
    split = [(r["dim"], r["cell"], index.parts(r["dim"], r["cell"]), -(-r["n"] // VISITS)) for r in per_cell]
    plan = F.broadcast(spark.createDataFrame(split, "dim int, cell int, parts int, slices int"))
    q = asked.join(plan, ["dim", "cell"]).withColumn("slice", F.pmod(F.xxhash64("point_id"), F.col("slices")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    e = index.entries.join(plan, ["dim", "cell"]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    keys, schema = ["dim", "cell", "part", "slice"], pa.schema([("point_id", pa.int64()), ("entry_id", pa.int64()), ("similarity", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        points, ids = left.column("point_id").to_numpy(), right.column("entry_id").to_numpy()
        if not len(points) or not len(ids):
            return schema.empty_table()
        a, b, out = matrix(left), matrix(right), []
        for at in range(0, len(a), max(1, (1 << 22) // len(b))):
            s = a[at : at + max(1, (1 << 22) // len(b))] @ b.T
            best = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
            rows = np.repeat(np.arange(len(s)), best.shape[1])
            value = s[rows, best.ravel()]
            good = value >= least
            out.append(pa.table([points[at + rows[good]], ids[best.ravel()[good]], value[good]], schema=schema))
        return pa.concat_tables(out)

    one = q.select(*keys, "point_id", "unit").groupBy(*keys).cogroup(e.select(*keys, "entry_id", "unit").groupBy(*keys))
    return one.applyInArrow(run, "point_id long, entry_id long, similarity double")


def matrix(table: pa.Table) -> np.ndarray:
    column = table.column("unit").combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b, summed in one order, so that equal vectors have equal products wherever they lie."""
    return (a * b).sum(1)


def best_products(points: np.ndarray, a: np.ndarray, ids: np.ndarray, b: np.ndarray, least: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, entry, similarity): of each point the best k entries, of equals the first by id. Products in single precision show
    which entries may be among them; those alone are computed in double precision."""
    order = np.argsort(ids, kind="stable")
    ids, b = ids[order], b[order]
    slack = 4e-7 * (a.shape[1] + 8)
    fast_a, fast_b = a.astype(np.float32), np.ascontiguousarray(b.astype(np.float32).T)
    rows = max(1, min(1024, AT_ONCE // max(1, min(len(ids), 1024))))
    out = []
    for at in range(0, len(a), rows):
        x, i_all, j_all = fast_a[at : at + rows], [], []
        top = np.full((len(x), k), -2.0, np.float32)  # the best k so far, the smallest first
        for lo in range(0, len(ids), 1024):
            s = x @ fast_b[:, lo : lo + 1024]
            some = np.flatnonzero(s.max(1) >= top[:, 0] - slack)
            if not len(some):
                continue
            own = s[some]
            high = own if own.shape[1] <= k else np.partition(own, own.shape[1] - k, axis=1)[:, -k:]
            top[some] = np.sort(np.concatenate([top[some], high], axis=1), axis=1)[:, -k:]
            hit = np.flatnonzero((own >= np.maximum(top[some, :1], least) - slack).ravel())
            i, j = np.divmod(hit, own.shape[1])
            i_all.append(some[i])
            j_all.append(j + lo)
        if not i_all:
            continue
        i, j = np.concatenate(i_all), np.concatenate(j_all)
        for lo in range(0, len(x), 64):  # bounds what is compared at once where many entries are alike
            own = (i >= lo) & (i < lo + 64)
            p, e = i[own], j[own]
            value = np.concatenate([in_order(a[at + p[n : n + 16_384]], b[e[n : n + 16_384]]) for n in range(0, len(p), 16_384)]) if len(p) else np.zeros(0)
            by = np.lexsort((e, -value, p))
            p, e, value = p[by], e[by], value[by]
            place = np.arange(len(p)) - np.searchsorted(p, p)
            keep = (place < k) & (value >= least)
            out.append((points[at + p[keep]], ids[e[keep]], value[keep]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def products(points: DataFrame, entries: DataFrame, least: float, k: int = 1) -> DataFrame:
    """As nearest(), without an index: every block of points meets every block of entries in a task of its own, which sends its best
    k of each point. A block holds BLOCK_BYTES of vectors. Of entries with one vector the first k by id alone can be found, so
    copies beyond them are left out before."""
    spark = points.sparkSession
    ship(spark)

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, (at, m) in units(batch.column("embedding").to_pandas()).items():
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, d, dtype=np.int32)), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array(np.full(len(at), d, np.int32)), flat], names=["id", "dim", "unit"])

    def made(df: DataFrame, key: str, tag: str) -> DataFrame:
        rows = df.select(F.col(key).alias("id"), vector("embedding").alias("embedding")).where(F.size("embedding") > 0)
        if key == "entry_id":
            rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("embedding").orderBy("id"))).where(F.col("n") <= k).drop("n")
        return stored(rows.mapInArrow(unit, "id long, dim int, unit array<double>"), tag)

    p, e = made(points, "point_id", "points"), made(entries, "entry_id", "entries")
    told = {x: {r["dim"]: r["n"] for r in df.groupBy("dim").agg(F.count("*").alias("n")).collect()} for x, df in (("p", p), ("e", e))}  # a row for each dimension
    plan = []
    for d in told["p"].keys() & told["e"].keys():
        each = max(64, BLOCK_BYTES // (8 * d))
        right = -(-told["e"][d] // each)
        left = max(-(-told["p"][d] // each), min(-(-TASKS // right), -(-told["p"][d] // 256)))
        plan.append((d, left, right))
    blocks = F.broadcast(spark.createDataFrame(plan, "dim int, lefts int, rights int"))
    deal = lambda df, own, other: df.join(blocks, "dim").withColumn(own, F.pmod(F.xxhash64("id"), F.col(f"{own}s")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))
    keys, schema = ["dim", "left", "right"], pa.schema([("point_id", pa.int64()), ("entry_id", pa.int64()), ("similarity", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        return pa.table(list(best_products(left.column("id").to_numpy(), matrix(left), right.column("id").to_numpy(), matrix(right), least, k)), schema=schema)

    q = deal(p, "left", "right").select(*keys, "id", "unit").groupBy(*keys)
    one = q.cogroup(deal(e, "right", "left").select(*keys, "id", "unit").groupBy(*keys))
    return best(one.applyInArrow(run, "point_id long, entry_id long, similarity double"), k).drop("rank")


def best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("point_id").orderBy(F.desc("similarity"), "entry_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(points: DataFrame, index: Cells, least: float, k: int = 1) -> DataFrame:
    """(point_id, entry_id, similarity) of the k most similar entries of the point's dimension, at `least` or above, of equals
    the first by id; points (point_id long, embedding) without a vector or of norm zero find none."""
    rows = points.select("point_id", vector("embedding").alias("embedding")).where(F.size("embedding") > 0)
    farthest = float(np.sqrt(max(0.0, 2 - 2 * least)))
    near = stored(best(search_cells(visits(rows, index, k, True, farthest), index, least, k), k), "first-cells")
    kth = near.where(F.col("rank") == k).select("point_id", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("similarity"))).alias("kth"))
    more = search_cells(visits(rows.join(kth, "point_id", "left"), index, k, False, farthest), index, least, k)
    return best(near.drop("rank").unionByName(more), k).drop("rank")


def visited(points: DataFrame, index: Cells, least: float, k: int = 1) -> tuple[int, int]:
    """(visits made, visits of all points to all cells): what the bounds save."""
    rows = points.select("point_id", vector("embedding").alias("embedding")).where(F.size("embedding") > 0)
    farthest = float(np.sqrt(max(0.0, 2 - 2 * least)))
    first = visits(rows, index, k, True, farthest)
    near = best(search_cells(first, index, least, k), k)
    kth = near.where(F.col("rank") == k).select("point_id", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("similarity"))).alias("kth"))
    made = first.count() + visits(rows.join(kth, "point_id", "left"), index, k, False, farthest).count()
    return made, rows.count() * sum(int((c > 0).sum()) for c in index.counts.values())
