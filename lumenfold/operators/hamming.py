"""Similarity joins of 64-bit values by Hamming distance, without loss: pairs, nearest predecessors, counts by distance.

`values` have simhash (distinct), first_id (distinct, the order of arrival) and n (a weight). Two plans give the same rows:

* tables: with b blocks of bits, values at most d apart agree on b - d blocks, so they meet under the key of one of the
  combinations of so many. Bits are dealt to blocks by how evenly they are set in a sample, so that no block has only the
  lopsided ones. Keys that the sample shows to be frequent are split into cells, each a task of its own.
* tiles: every value meets all earlier ones, as xor and bit count over blocks of values; no pair leaves a tile unless it
  is near enough.

What each plan costs is taken from a bounded sample's keys, not from evenly spread ones: real SimHashes cluster."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Keys of one value, at most: what one plan can bear.
MOST_TABLES = 300
#: Values of the sample from which the plan follows; hashes choose them.
SAMPLE = 20_000
#: Seconds: a row of a table (made, shuffled, sorted), a meeting under a key, a pair of a tile. Measured on one core.
ROW_S, MEET_S, PAIR_S = 2e-6, 2e-8, 2e-9
#: A key with more values than this is split into cells of two such parts.
HOT_KEY = 16_384
#: Values that a tile's task holds, at least, and tasks at most, before tiles grow.
TILE, MOST_TILES = 4096, 512
#: Compared at once: what a step holds stays in a core's cache, which is four times as fast as steps of 4 million.
AT_ONCE = 1 << 16


@dataclass
class Plan:
    """distance; the masks of bits of each block; tables as sets of block numbers (none: tiles); hot: (table, bits, parts)."""

    distance: int
    bits: list[int]
    tables: list[tuple[int, ...]]
    hot: list[tuple[int, int, int]]
    total: int
    meetings: float = 0.0

    def mask(self, t: int) -> int:
        return sum(self.bits[k] for k in self.tables[t])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def deal_bits(sample: np.ndarray, blocks: int) -> list[int]:
    """Masks of `blocks` blocks. Bits go out by how evenly they are set, to and fro, so that all blocks tell values apart alike."""
    share = np.array([((sample >> np.uint64(k)) & np.uint64(1)).mean() if len(sample) else 0.5 for k in range(64)])
    masks, order = [0] * blocks, np.argsort(np.abs(share - 0.5), kind="stable")
    for n, k in enumerate(order.tolist()):
        lap, at = divmod(n, blocks)
        masks[blocks - 1 - at if lap % 2 else at] |= 1 << k
    return masks


def plan_for(sample: np.ndarray, total: int, distance: int) -> Plan:
    """The cheapest plan for `total` values of which `sample` (uint64) is a random part."""
    best, cost = Plan(distance, [], [], [], total, total**2 / 2), total**2 / 2 * PAIR_S
    scale = total / max(1, len(sample))
    for blocks in range(distance + 1, min(distance + 7, 33)):
        same = blocks - distance
        if math.comb(blocks, same) > MOST_TABLES or math.comb(blocks, same) * total * ROW_S > cost:
            continue
        found = Plan(distance, deal_bits(sample, blocks), list(combinations(range(blocks), same)), [], total)
        for t in range(len(found.tables)):
            mask = found.mask(t)
            keys, counts = np.unique(sample & np.uint64(mask), return_counts=True)
            c = counts.astype(float)
            found.meetings += (c * (c - 1) / 2).sum() * scale**2 + total**2 / 2 ** (bin(mask).count("1") + 1)
            for k, many in zip(keys.tolist(), (counts * scale).tolist(), strict=True):
                if many > HOT_KEY:
                    found.hot.append((t, signed(k), math.ceil(many / HOT_KEY)))
        price = len(found.tables) * total * ROW_S + found.meetings * MEET_S
        if price < cost:
            best, cost = found, price
    return best


def sampled(values: DataFrame) -> tuple[np.ndarray, int]:
    """(at most some SAMPLE values, number of all), chosen by a hash of the value."""
    total = values.count()
    bound = -(2**63) + int(2**64 * min(1.0, SAMPLE / max(1, total))) - 1
    rows = values.where(F.xxhash64("simhash") <= F.lit(bound)).select("simhash").limit(2 * SAMPLE).toArrow()
    return rows.column(0).to_numpy().astype(np.int64).view(np.uint64), total


# Kernels over numpy arrays


def met(x: np.ndarray, y: np.ndarray, distance: int, below: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of pairs of x and y at most so far apart; below: x is y, and j < i alone."""
    step = max(1, AT_ONCE // max(1, len(y)))
    for at in range(0, len(x), step):
        top = min(len(x), at + step)
        other = y[:top] if below else y
        d = np.bitwise_count(x[at:top, None] ^ other[None, :])
        i, j = np.divmod(np.flatnonzero((d <= distance).ravel()), len(other))
        if below:
            i, j = i[keep := j < i + at], j[keep]
        yield i + at, j, d[i, j]


def met_in_runs(v: np.ndarray, starts: np.ndarray, sizes: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same within runs of v, given by start and size; runs of one size are compared together."""
    for size in np.unique(sizes[sizes > 1]).tolist():
        own = starts[sizes == size]
        if size > 128:
            for s in own.tolist():
                for i, j, d in met(v[s : s + size], v[s : s + size], distance, True):
                    yield i + s, j + s, d
            continue
        low, high = np.triu_indices(size, 1)
        step = max(1, AT_ONCE // len(low))
        for at in range(0, len(own), step):
            base = own[at : at + step, None]
            i, j = base + high, base + low
            d = np.bitwise_count(v[i] ^ v[j])
            keep = d <= distance
            yield i[keep], j[keep], d[keep]


def as_batch(schema: pa.Schema, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("distance", pa.int32())])
COUNTS = pa.schema([("distance", pa.int32()), ("w", pa.int64())])
NEAREST = pa.schema([("id", pa.int64()), ("nearest", pa.int64()), ("distance", pa.int32())])
#: Columns in Spark's words, by what is asked for.
SCHEMAS = {"pairs": "a long, b long, distance int", "counts": "distance int, w long", "nearest": "id long, nearest long, distance int"}


class Rows:
    """Columns simhash, first_id, n of some rows."""

    def __init__(self, v: np.ndarray, first: np.ndarray, n: np.ndarray) -> None:
        self.v, self.first, self.n = v, first, n

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Rows:
        get = lambda name: batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)
        return cls(get("simhash").view(np.uint64), get("first_id"), get("n"))

    def __len__(self) -> int:
        return len(self.v)

    def at(self, index) -> Rows:  # noqa: ANN001
        return Rows(self.v[index], self.first[index], self.n[index])


def told(kind: str, x: Rows, y: Rows, d: np.ndarray) -> pa.RecordBatch:
    """What is asked for of pairs (x, y) at distances d."""
    if kind == "pairs":
        a, b = x.v.view(np.int64), y.v.view(np.int64)
        return as_batch(PAIRS, np.minimum(a, b), np.maximum(a, b), d.astype(np.int32))
    if kind == "counts":
        return as_counts(np.bincount(d, x.n * y.n, 65).astype(np.int64))
    later, earlier = np.maximum(x.first, y.first), np.minimum(x.first, y.first)
    order = np.lexsort((earlier, d, later))
    lead = order[np.flatnonzero(np.diff(later[order], prepend=later[order][:1] - 1))]
    return as_batch(NEAREST, later[lead], earlier[lead], d[lead].astype(np.int32))


def as_counts(sums: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(sums)
    return as_batch(COUNTS, some.astype(np.int32), sums[some])


def sums_by_distance(x: Rows, y: Rows, distance: int) -> np.ndarray:
    """65 sums of n * n of all pairs (x, y), by distance; those beyond `distance` are 0. Most values have n = 1: their pairs are
    counted, the rest is summed row by row."""
    sums, once = np.zeros(65, np.int64), y.n == 1
    y = y.at(np.argsort(~once, kind="stable"))
    ones, weights = int(once.sum()), y.n.astype(np.float64)
    for own, at_most in ((x.at(x.n == 1), ones), (x.at(x.n != 1), 0)):
        step = max(1, AT_ONCE // max(1, len(y)))
        for at in range(0, len(own), step):
            d = np.bitwise_count(own.v[at : at + step, None] ^ y.v[None, :])
            if at_most:
                left = d[:, :at_most].ravel()
                near = left <= distance
                some = np.count_nonzero(near)
                if some:
                    sums += np.bincount(left if some * 8 > len(left) else left[near], minlength=65)
            if at_most < len(y):
                for k, n in enumerate(own.n[at : at + step].tolist()):
                    sums += n * np.bincount(d[k, at_most:], weights[at_most:], 65).astype(np.int64)
    sums[distance + 1 :] = 0
    return sums


#: Columns of one weight that are counted apart, at least.
ALIKE = 64


def sums_by_bound(x: Rows, y: Rows, bounds: tuple[int, ...]) -> np.ndarray:
    """The same 65 sums, but a pair counts at the first of the bounds (rising) that it does not exceed: a comparison and a count for
    each bound, which a histogram takes twice as long for. Rows and columns of one weight are counted together."""
    sums = np.zeros(65, np.int64)
    weights, sizes = np.unique(y.n, return_counts=True)
    alike = weights[sizes >= ALIKE]
    rare = ~np.isin(y.n, alike)
    y = y.at(np.lexsort((y.n, rare)))
    edges = np.concatenate([[0], np.cumsum(sizes[sizes >= ALIKE])]).tolist()
    spans = list(zip(edges, edges[1:], alike.tolist(), strict=False))
    others = y.n[edges[-1] :].astype(np.float64)
    step = max(1, AT_ONCE // max(1, len(y)))
    for n in np.unique(x.n).tolist():
        own, found = x.v[x.n == n], [0] * len(bounds)
        for at in range(0, len(own), step):
            d = np.bitwise_count(own[at : at + step, None] ^ y.v[None, :])
            for k, bound in enumerate(bounds):
                near = d <= bound
                for lo, hi, w in spans:
                    found[k] += w * int(np.count_nonzero(near[:, lo:hi]))
                if len(others):
                    found[k] += int(np.count_nonzero(near[:, edges[-1] :], 0) @ others)
        for k, bound in enumerate(bounds):
            sums[bound] += n * (found[k] - (found[k - 1] if k else 0))
    return sums


def sums_below(x: Rows, distance: int, bounds: tuple[int, ...] = ()) -> np.ndarray:
    """The same of the pairs of x with itself, each once."""
    sums = sums_by_bound(x, x, bounds) if bounds else sums_by_distance(x, x, distance)
    sums[bounds[0] if bounds else 0] -= (x.n * x.n).sum()
    return sums // 2


def tile_task(kind: str, distance: int, bounds: tuple[int, ...] = ()) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's own values come first (column own), then all values before them; both in order of first_id."""

    def nearest(own: Rows, best: np.ndarray, at: np.ndarray, y: Rows, below: bool) -> None:
        step = max(1, AT_ONCE // max(1, len(y)))
        for lo in range(0, len(own), step):
            hi = min(len(own), lo + step)
            d = np.bitwise_count(own.v[lo:hi, None] ^ y.v[None, :])
            if below:
                d[y.first[None, :] >= own.first[lo:hi, None]] = 255
            k = d.argmin(1)  # of equals the first
            low = d[np.arange(hi - lo), k]
            better = low < best[lo:hi]
            best[lo:hi][better], at[lo:hi][better] = low[better], y.first[k][better]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rest, mine = None, [], []
        for batch in batches:
            flag = np.asarray(batch.column("own"))
            rows = Rows.of(batch)
            mine.append(rows.at(flag == 1))
            if not (flag == 0).any():
                continue
            if own is None:
                own = joined(mine)
                yield from begin(own)
            rest = rows.at(flag == 0)
            yield from meet(own, rest, False)
        if own is None and mine:
            own = joined(mine)
            yield from begin(own)
        if own is not None and kind == "nearest":
            some = state["best"] <= distance
            yield as_batch(NEAREST, own.first[some], state["at"][some], state["best"][some].astype(np.int32))

    state: dict[str, np.ndarray] = {}

    def begin(own: Rows) -> Iterator[pa.RecordBatch]:
        state["best"], state["at"] = np.full(len(own), 254, np.uint8), np.zeros(len(own), np.int64)
        yield from meet(own, own, True)

    def meet(own: Rows, y: Rows, below: bool) -> Iterator[pa.RecordBatch]:
        if kind == "nearest":
            # Values come in order of first_id, the own ones last of all; on a tie the earlier one must win.
            best, at = np.full(len(own), 254, np.uint8), np.zeros(len(own), np.int64)
            nearest(own, best, at, y, below)
            better = (best < state["best"]) | ((best == state["best"]) & (best < 254) & (at < state["at"]))
            state["best"][better], state["at"][better] = best[better], at[better]
            return
        if kind == "counts":
            if below:
                yield as_counts(sums_below(own, distance, bounds))
            else:
                yield as_counts(sums_by_bound(own, y, bounds) if bounds else sums_by_distance(own, y, distance))
            return
        for i, j, d in met(own.v, y.v, distance, below):
            if len(i):
                yield told(kind, own.at(i), y.at(j), d)

    return run


def joined(parts: list[Rows]) -> Rows:
    return Rows(np.concatenate([p.v for p in parts]), np.concatenate([p.first for p in parts]), np.concatenate([p.n for p in parts]))


def tiles(values: DataFrame, plan: Plan, kind: str, bounds: tuple[int, ...] = ()) -> DataFrame:
    """Each task holds the values of one range of first_id and reads all values before them."""
    tasks = max(1, min(MOST_TILES, -(-plan.total // TILE)))
    parts = values.select("simhash", "first_id", "n").repartitionByRange(tasks, "first_id").withColumn("part", F.spark_partition_id())
    dealt = parts.withColumn("task", F.explode(F.sequence("part", F.lit(tasks - 1)))).withColumn("own", (F.col("part") == F.col("task")).cast("int"))
    ready = dealt.select("task", "own", "simhash", "first_id", "n").repartitionById(tasks, "task").sortWithinPartitions(F.desc("own"), "first_id")
    return ready.mapInArrow(tile_task(kind, plan.distance, bounds), SCHEMAS[kind])


def key_task(kind: str, plan: Plan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by key (t, bits, cell): all that share one are compared. A cell of a split key has rows of one part or
    of two (column part); rows of two parts meet across alone."""
    blocks, same = [np.uint64(b) for b in plan.bits], len(plan.tables[0])
    sets = np.array([sum(1 << k for k in t) for t in plan.tables], np.int64)
    by_set = np.argsort(sets)

    def first_table(x: np.ndarray) -> np.ndarray:
        """The table under which pairs with these differing bits are counted: that of the first blocks they agree on."""
        have, agreed = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for k, bits in enumerate(blocks):
            more = ((x & bits) == 0) & (have < same)
            agreed |= more.astype(np.int64) << k
            have += more
        return by_set[np.searchsorted(sets[by_set], agreed)]

    def emit(t: np.ndarray, rows: Rows, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> Iterator[pa.RecordBatch]:
        if kind != "nearest" and len(i):  # a pair that meets twice does no harm to a minimum
            once = first_table(rows.v[i] ^ rows.v[j]) == t[i]
            i, j, d = i[once], j[once], d[once]
        if len(i):
            yield told(kind, rows.at(i), rows.at(j), d)

    def runs(t: np.ndarray, cell: np.ndarray, part: np.ndarray, edges: np.ndarray, rows: Rows) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(edges)
        starts = edges[:-1]
        for at in np.flatnonzero((cell[starts] >= 0) & (sizes > 1)).tolist():
            lo, hi = int(starts[at]), int(edges[at + 1])
            x = np.arange(lo, hi)[part[lo:hi] == part[lo]]
            y = np.arange(lo, hi)[part[lo:hi] != part[lo]]
            if len(y):
                for i, j, d in met(rows.v[x], rows.v[y], plan.distance, False):
                    yield from emit(t, rows, x[i], y[j], d)
                sizes[at] = 1
        whole = (cell[starts] < 0) | (sizes > 1)
        for i, j, d in met_in_runs(rows.v, starts[whole], sizes[whole], plan.distance):
            yield from emit(t, rows, i, j, d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        for batch in batches:
            get = lambda name, b=batch: b.column(name).to_numpy(zero_copy_only=False).astype(np.int64)
            kept.append((get("t"), get("bits"), get("cell"), get("part"), Rows.of(batch)))
            if [k[-1] for k in kept[-1][:3]] == [k[0] for k in kept[0][:3]]:
                continue  # one key so far
            t, bits, cell, part = (np.concatenate([k[n] for k in kept]) for n in range(4))
            rows = joined([k[4] for k in kept])
            new = np.flatnonzero((np.diff(t) != 0) | (np.diff(bits) != 0) | (np.diff(cell) != 0)) + 1
            last = int(new[-1])
            yield from runs(t, cell, part, np.concatenate([[0], new]), rows.at(slice(0, last)))
            kept = [(t[last:], bits[last:], cell[last:], part[last:], rows.at(slice(last, None)))]
        if kept:
            t, bits, cell, part = (np.concatenate([k[n] for k in kept]) for n in range(4))
            rows = joined([k[4] for k in kept])
            new = np.flatnonzero((np.diff(t) != 0) | (np.diff(bits) != 0) | (np.diff(cell) != 0)) + 1
            yield from runs(t, cell, part, np.concatenate([[0], new, [len(t)]]), rows)

    return run


def by_tables(values: DataFrame, plan: Plan, kind: str) -> DataFrame:
    """Values under the keys of all tables; each key, or cell of a split key, is compared in one place."""
    spark = values.sparkSession
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("simhash").bitwiseAND(F.lit(signed(plan.mask(t)))).alias("bits")) for t in range(len(plan.tables))])
    rows = values.select("simhash", "first_id", "n", F.explode(keys).alias("k")).select("simhash", "first_id", "n", "k.t", "k.bits")
    if plan.hot:  # at most a few for each row of the sample
        hot = spark.createDataFrame(plan.hot, "t int, bits long, parts int")
        rows = rows.join(F.broadcast(hot), ["t", "bits"], "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("simhash"), F.col("parts")).cast("int")).otherwise(F.lit(0)))
        others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.least(k, F.col("part")) * F.col("parts") + F.greatest(k, F.col("part")))
        rows = rows.withColumn("cell", F.explode(F.when(F.col("parts").isNotNull(), others).otherwise(F.array(F.lit(-1))))).drop("parts")
    else:
        rows = rows.withColumns({"part": F.lit(0), "cell": F.lit(-1)})
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-len(plan.tables) * plan.total // 2_000_000))
    ready = rows.repartition(tasks, "t", "bits", "cell").sortWithinPartitions("t", "bits", "cell")
    return ready.mapInArrow(key_task(kind, plan), SCHEMAS[kind])


def asked(values: DataFrame, distance: int, kind: str, plan: Plan | None, bounds: tuple[int, ...] = ()) -> DataFrame:
    ship(values.sparkSession)
    plan = plan or plan_for(*sampled(values), distance)
    return by_tables(values, plan, kind) if plan.tables else tiles(values, plan, kind, bounds)


def pairs(values: DataFrame, distance: int, plan: Plan | None = None) -> DataFrame:
    """(a, b, distance), a < b: each pair of values at most so far apart, once."""
    return asked(values, distance, "pairs", plan)


def counts(values: DataFrame, distance: int, plan: Plan | None = None, bounds: tuple[int, ...] = ()) -> DataFrame:
    """(distance, w): the sum of the products of both n over the pairs at each distance; no pair is kept. bounds (rising, the last
    is the distance): that is asked alone between which of them pairs lie; a pair may be told by the bound that it does not exceed."""
    return asked(values, distance, "counts", plan, bounds).groupBy("distance").agg(F.sum("w").alias("w"))


#: Values of a group in one part of counts_within().
PART = 8192
#: Tasks that pairs of parts are dealt to, at least. Their cost is the square of their few bytes, by which Spark would merge them.
WITHIN_TASKS = 128


def counts_within(values: DataFrame, bounds: tuple[int, ...] = ()) -> DataFrame:
    """(distance, w): counts() of the pairs of values of one group alone, at all distances; values: g, simhash, n, a simhash
    once in a group. A group is dealt to parts of PART values, and each pair of parts is summed in one place. bounds: as counts()
    has them, the last is 64."""
    ship(values.sparkSession)
    sizes = values.groupBy("g").agg(F.count("*").alias("size")).where("size > 1")
    rows = values.join(sizes, "g").withColumn("parts", F.ceil(F.col("size") / PART).cast("int")).withColumn("part", F.pmod(F.xxhash64("simhash"), F.col("parts")).cast("int"))
    a, b = (rows.where("size <= 64").select("g", F.col("simhash").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    few = a.join(b, "g").where("a < b").groupBy(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).cast("int").alias("distance")).agg(F.sum(F.col("na") * F.col("nb")).alias("w"))
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, F.col("part")).alias("i"), F.greatest(k, F.col("part")).alias("j")))
    cells = rows.where("size > 64").withColumn("cell", F.explode(others)).select("g", "cell.i", "cell.j", "part", "simhash", F.lit(0).cast("long").alias("first_id"), "n")

    def run(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        x, part = Rows.of(batch), batch.column("part").to_numpy()
        i, j = batch.column("i")[0].as_py(), batch.column("j")[0].as_py()
        if i == j:
            sums = sums_below(x, 64, bounds)
        else:
            a, b = x.at(part == i), x.at(part == j)
            sums = sums_by_bound(a, b, bounds) if bounds else sums_by_distance(a, b, 64)
        return pa.Table.from_batches([as_counts(sums)])

    tasks = max(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), WITHIN_TASKS)
    many = cells.repartition(tasks, "g", "i", "j").groupBy("g", "i", "j").applyInArrow(run, SCHEMAS["counts"])
    return few.unionByName(many).groupBy("distance").agg(F.sum("w").alias("w"))


def nearest(values: DataFrame, distance: int, plan: Plan | None = None) -> DataFrame:
    """(id, nearest, distance): for each value, told by its first_id, the first_id of the nearest value with a smaller one,
    of equals the smallest; none beyond the distance."""
    found = asked(values, distance, "nearest", plan)
    best = found.groupBy("id").agg(F.min(F.struct("distance", "nearest")).alias("m"))
    return best.select("id", F.col("m.nearest").alias("nearest"), F.col("m.distance").alias("distance"))
