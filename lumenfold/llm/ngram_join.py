"""N-gram Jaccard self-join: size-banded tiles, hashed bitmaps whose bit counts bound the overlap, exact intersection.

Which sets meet in a tile is found without loss:

1. Every shingle is counted over the corpus, block by block (one block for each chunk of documents and bucket of
   hashes). A set with J >= t to another shares t of its own shingles with it, so a set with fewer shared ones is out.
2. The sets that are left are counted again among themselves. In order of frequency, rarest first, two linked sets
   share one of their first n - ceil(t n) + 1 shingles; sets of compatible sizes with a common one are chained.
3. Chains make clusters. A cluster is cut into tiles of bounded weight by size band, and sets are compared in tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import answered, components, dealt, mapped, mix64, part_id, parts_for, stored, text_bytes, utf8

#: Shingles of one chunk; bytes of text for one bucket; shingles, and sets, of one block of a tile.
CHUNK, BUCKET_BYTES, BLOCK, BLOCK_SETS = 1_000_000, 12 << 20, 1_500_000, 20_000
#: Sets whose ids may be sent to every executor (24 bytes each); more are joined by shuffle.
BROADCAST_IDS = 300_000
CACHE_WORDS = 300_000
ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes, known: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a text with fewer words is one shingle, one without words none."""
    words = text.lower().split()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    n = max(1, len(h) - width + 1)
    with np.errstate(over="ignore"):
        out = np.full(n, min(width, len(h)), np.uint64)
        for k in range(min(width, len(h))):
            out = mix64((out ^ h[k : k + n]) * ODD)
    return np.unique(out)


def set_id(h: np.ndarray) -> int:
    """64-bit id of a set; of n different sets about n^2 / 2^65 pairs would share one."""
    import xxhash

    return xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63)


def buckets_of(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each hash: consecutive ranges, so sorted hashes have sorted buckets."""
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


SHARES = "to int, chunk long, kind string, a binary, b binary, c binary, d binary, e binary"
SHARE_TYPES = [pa.int32(), pa.int64(), pa.string(), *[pa.binary()] * 5]
NULL_ID = np.iinfo(np.int64).min


def share(rows: list[tuple]) -> pa.RecordBatch:
    full = [(*x, *[None] * (8 - len(x))) for x in rows]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*full) if full else [[]] * 8, SHARE_TYPES, strict=True)], names=["to", "chunk", "kind", "a", "b", "c", "d", "e"])


def shared_counts(rows: DataFrame, buckets: int, width: int) -> DataFrame:
    """doc_id, key (hash of the text), sid, n, n_shared of every row: how many of its shingles another set has too (never too few)."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seq, part = WordHashes(), 0, part_id()
        docs: list[tuple[int, int, int, int, int]] = []
        of: dict[int, int] = {}
        sets: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            chunk = part << 24 | seq
            h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            keys, back, n = np.unique(h, return_inverse=True, return_counts=True)
            own = n[back] == 1
            base = np.bincount(owner[~own], minlength=len(sets)).astype("<u4")
            ids, keys_, *cols = (np.array(x, t).tobytes() for x, t in zip(zip(*docs), ("<i8", "<i8", "<i8", "<u4", "<u4"), strict=True))
            yield share([(chunk % buckets, chunk, "docs", ids + keys_, *cols, base.tobytes())])
            alone, who = h[own], owner[own]
            to = buckets_of(alone, buckets)
            by = np.argsort(to.astype(np.uint16) if buckets < 65536 else to, kind="stable")
            cuts = np.searchsorted(to[by], np.arange(buckets + 1))
            several = keys[n > 1]
            scuts = np.searchsorted(buckets_of(several, buckets), np.arange(buckets + 1))
            low = (h & np.uint64(0xFFFFFFFF)).astype("<u4")[own][by]
            more = (several & np.uint64(0xFFFFFFFF)).astype("<u4")
            who = who[by]
            for k in np.flatnonzero((cuts[1:] > cuts[:-1]) | (scuts[1:] > scuts[:-1])).tolist():
                each = np.bincount(who[cuts[k] : cuts[k + 1]], minlength=len(sets)).astype("<u4")
                yield share([(k, chunk, "ask", low[cuts[k] : cuts[k + 1]].tobytes(), each.tobytes(), more[scuts[k] : scuts[k + 1]].tobytes())])

        weight = 0
        for batch in batches:
            for doc, key, text in zip(batch.column("id").to_pylist(), batch.column("key").to_pylist(), utf8(batch, "body"), strict=True):
                h = shingles(text, known, width)
                sid = set_id(h)
                at = of.setdefault(sid, len(sets))
                if at == len(sets):
                    sets.append(h)
                    weight += len(h)
                docs.append((NULL_ID if doc is None else doc, key, sid, len(h), at))
                if weight > CHUNK:
                    yield from flush()
                    seq, weight = seq + 1, 0
                    docs, of, sets = [], {}, []
        if docs:
            yield from flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, several = [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[2] == "docs":
                    yield share([row])
                else:
                    asked.append((row[1], np.frombuffer(row[3], "<u4"), row[4]))
                    several.append(np.frombuffer(row[5], "<u4"))
        if not asked:
            return
        keys, back, n = np.unique(np.concatenate([x[1] for x in asked]), return_inverse=True, return_counts=True)
        shared = (n > 1) | np.isin(keys, np.unique(np.concatenate(several)))
        at = 0
        for chunk, low, each in asked:
            hit = shared[back[at : at + len(low)]]
            at += len(low)
            sizes = np.frombuffer(each, "<u4")
            got = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[hit], minlength=len(sizes)).astype("<u4")
            yield share([(0, chunk, "got", got.tobytes())])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: dict[int, tuple] = {}
        got: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[2] == "docs":
                    docs[row[1]] = tuple(np.frombuffer(x, t) for x, t in zip(row[3:], ("<i8", "<i8", "<u4", "<u4", "<u4"), strict=True))
                else:
                    got[row[1]] = got.get(row[1], 0) + np.frombuffer(row[3], "<u4").astype(np.int64)
        for chunk, (ids, sids, n, at, base) in docs.items():
            ids, keys = ids.reshape(2, -1)
            total = (base + got.get(chunk, 0))[at] if len(base) else np.zeros(len(ids), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=ids == NULL_ID), pa.array(keys), pa.array(sids), pa.array(n.astype(np.int64)), pa.array(np.asarray(total, np.int64))], names=["doc_id", "key", "sid", "n", "n_shared"])

    asked = mapped(rows, ask, SHARES).repartitionById(buckets, "to")
    replies = stored(mapped(asked, count, SHARES), "shingle-blocks")
    return stored(mapped(replies.repartition(buckets, "chunk"), collect, "doc_id long, key long, sid long, n long, n_shared long"), "shared-shingles")


def frequent_prefixes(sets: DataFrame, chunks: int, percent: int) -> DataFrame:
    """sid, n, shared (sorted hashes that other sets have too), prefix (those of the prefix), of sets that can have links."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = set(), []
        for batch in batches:
            for sid, h in zip(batch.column("sid").to_pylist(), batch.column("hashes").to_pylist(), strict=True):
                if sid not in seen:
                    seen.add(sid)
                    held.append(np.frombuffer(h, "<u8"))
        keys, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
        cuts = np.searchsorted(buckets_of(keys, chunks), np.arange(chunks + 1))
        for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            yield share([(k, part_id(), "ask", keys[cuts[k] : cuts[k + 1]].tobytes(), n[cuts[k] : cuts[k + 1]].astype("<u4").tobytes())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [(c, np.frombuffer(a, "<u8"), np.frombuffer(b, "<u4")) for x in batches for c, a, b in zip(x.column("chunk").to_pylist(), x.column("a").to_pylist(), x.column("b").to_pylist(), strict=True)]
        if asked:
            keys, back = np.unique(np.concatenate([x[1] for x in asked]), return_inverse=True)
            total = np.bincount(back, np.concatenate([x[2] for x in asked]))
            for chunk, own, _ in asked:
                n = total[np.searchsorted(keys, own)]
                yield share([(0, chunk, "got", own[n > 1].tobytes(), n[n > 1].astype("<u4").tobytes())])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, keys, freq, seen = [], None, None, set()
        for batch in batches:
            out = []
            for a, b, sid, n, h in zip(*(batch.column(x).to_pylist() for x in ("a", "b", "sid", "n", "hashes")), strict=True):
                if a is not None:
                    parts.append((np.frombuffer(a, "<u8"), np.frombuffer(b, "<u4")))
                    continue
                if keys is None:
                    keys, freq = np.concatenate([np.zeros(0, np.uint64), *(x[0] for x in parts)]), np.concatenate([np.zeros(0, np.uint32), *(x[1] for x in parts)])
                    by = np.argsort(keys)
                    keys, freq = np.append(keys[by], ~np.uint64(0)), np.append(freq[by], 0)
                if sid in seen:
                    continue
                seen.add(sid)
                h = np.frombuffer(h, "<u8")
                at = np.searchsorted(keys, h)
                real = keys[at] == h
                h, f = h[real], freq[at[real]]
                if 100 * len(h) < percent * n:
                    continue
                first = n - -(-percent * n // 100) + 1 - (n - len(h))
                out.append((sid, n, h.tobytes(), h[np.lexsort((h, f))[: max(0, first)]].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["sid", "n", "shared", "prefix"])

    asked = mapped(dealt(sets, chunks, "sid"), ask, SHARES).repartitionById(chunks, "to")
    replies = mapped(asked, count, SHARES).select(F.col("chunk").cast("int").alias("chunk"), "a", "b")
    both = answered(sets, stored(replies, "shingle-counts"), chunks, "sid")
    return stored(mapped(both, choose, "sid long, n long, shared binary, prefix binary"), "prefixes")


def chains(prefixes: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between sets that follow each other by size under one prefix shingle, if their sizes are compatible.

    Each task chains its own sets first and passes on one set for each shingle and size, so a shingle that very many sets
    share arrives as few rows."""
    schema = "key long, sid long, n long, other long"

    def linked(key: np.ndarray, sid: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        by = np.lexsort((sid, n, key))
        key, sid, n = key[by], sid[by], n[by]
        near = (key[1:] == key[:-1]) & (100 * n[:-1] >= percent * n[1:])
        first = np.append(True, (key[1:] != key[:-1]) | (n[1:] != n[:-1]))[: len(key)]
        return by[first], sid[:-1][near], sid[1:][near]

    def batch_of(key, sid, n, other) -> pa.RecordBatch:  # noqa: ANN001
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key, sid, n, other)], names=["key", "sid", "n", "other"])

    def edges(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(a):
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            none = pa.nulls(len(pairs), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(pairs[:, 0]), none, pa.array(pairs[:, 1])], names=["key", "sid", "n", "other"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            sizes = [len(x[2]) for x in held]
            key = np.concatenate([x[2] for x in held]).view(np.int64)
            sid, n = np.repeat([x[0] for x in held], sizes), np.repeat([x[1] for x in held], sizes)
            keep, a, b = linked(key, sid, n)
            yield from edges(a, b)
            for at in range(0, len(keep), 100_000):
                own = keep[at : at + 100_000]
                yield batch_of(key[own], sid[own], n[own], pa.nulls(len(own), pa.int64()))

        weight = 0
        for batch in batches:
            for sid, n, prefix in zip(*(batch.column(x).to_pylist() for x in ("sid", "n", "prefix")), strict=True):
                held.append((sid, n, np.frombuffer(prefix, "<u8")))
                weight += len(held[-1][2])
                if weight > 1_000_000:
                    yield from flush()
                    held, weight = [], 0
        if held:
            yield from flush()

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            key, sid, n, other = (batch.column(x) for x in ("key", "sid", "n", "other"))
            done = key.is_null().to_numpy(zero_copy_only=False)
            if done.any():
                yield batch.filter(pa.array(done))
                key, sid, n = (x.filter(pa.array(~done)) for x in (key, sid, n))
            key, sid, n = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (key, sid, n))
            if last is not None:
                key, sid, n = (np.append(x, y) for x, y in zip(last, (key, sid, n), strict=True))
            if len(key):
                _, a, b = linked(key, sid, n)
                yield from edges(a, b)
                last = key[-1:], sid[-1:], n[-1:]

    rows = mapped(prefixes.select("sid", "n", "prefix"), emit, schema)
    rows = rows.repartition(F.coalesce("key", "sid")).sortWithinPartitions("key", "n", "sid")
    return mapped(rows, chain, schema).where("other is not null").select(F.col("sid").alias("a"), F.col("other").alias("b"))


class Links:
    """Disjoint sets with path halving."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def roots(self) -> np.ndarray:
        up = np.array(self.up)
        while not np.array_equal(above := up[up], up):
            up = above
        return up


def bands_of(n: np.ndarray, percent: int) -> np.ndarray:
    """Size bands: two sets with J >= percent / 100 are in one band or in neighbours."""
    return np.floor(np.log(n) / np.log(100 / percent) + 1e-9).astype(np.int64)


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    maps = np.zeros((len(sets), bits // 64), np.uint64)
    for i, x in enumerate(sets):
        at = (x >> np.uint64(20)) & np.uint64(bits - 1)
        np.bitwise_or.at(maps[i], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return maps


def compare_tile(sids: list[int], n: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect every pair of sets of the tile that has J >= percent / 100, no more than a forest of them.

    Sets come with all shingles that another set has (n counts them all). Each size band is compared with itself and the
    band below, by bitmaps as wide as its own sets ask for, so they take a few bytes for each shingle of the two bands,
    whatever else the tile holds. Bits of one bitmap that the other lacks are shingles that it lacks, so they bound the
    overlap from above; pairs that pass are intersected exactly. Pairs that are connected already are passed over."""
    by = np.argsort(n, kind="stable")
    n, sets, sids = n[by], [sets[i] for i in by], [sids[i] for i in by]
    own = np.array([len(x) for x in sets])
    up, out = Links(len(sets)), []
    band = bands_of(n, percent)
    for b in np.unique(band)[::-1].tolist():
        first, start, stop = np.searchsorted(band, (b - 1, b, b + 1)).tolist()
        if stop - first < 2:
            continue
        bits = max(256, 1 << int(8 * own[start:stop].max()).bit_length())
        maps, step = bitmaps(sets[first:stop], bits), max(1, (1 << 27) // bits)
        for i in range(stop - 1, start - 1, -1):
            if i == stop - 1 or not i & 127:
                top = up.roots()  # of a while ago; a pair that is connected since then is seen below
            low = max(first, int(np.searchsorted(n, -(-percent * n[i] // 100))))
            other = low + np.flatnonzero(top[low:i] != up.root(i))
            mine = maps[i - first]
            for at in range(0, len(other), step):
                j = other[at : at + step]
                need = -(-percent * (n[i] + n[j]) // (100 + percent))
                theirs = maps[j - first]
                most = np.minimum(own[i] - np.bitwise_count(mine & ~theirs).sum(1, dtype=np.int64), own[j] - np.bitwise_count(theirs & ~mine).sum(1, dtype=np.int64))
                j, need = j[most >= need], need[most >= need]
                for k, least in zip(j.tolist(), need.tolist(), strict=True):
                    a, c = up.root(i), up.root(k)
                    if a == c:
                        continue
                    x, y = sets[i], sets[k]
                    place = np.minimum(np.searchsorted(x, y), len(x) - 1)
                    if np.count_nonzero(x[place] == y) >= least:
                        up.up[max(a, c)] = min(a, c)
                        out.append((sids[i], sids[k]))
    return out


def tiles(prefixes: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within clusters. A cluster of up to BLOCK shingles and BLOCK_SETS sets is one tile, compared band by
    band. A larger one is cut into size bands (two sets with a link are in one band or in neighbours) and these into
    blocks; each pair of blocks is one tile."""
    members = prefixes.select("sid", "n", "shared").join(clusters.select(F.col("id").alias("sid"), F.col("component").alias("cluster")), "sid")
    members = members.withColumn("band", F.floor(F.log("n") / float(np.log(100 / percent)) + 1e-9).cast("int"))
    weights = members.groupBy("cluster", "band").agg(F.sum(F.length("shared") / 8).alias("w"), F.count("*").alias("m"))
    blocks = weights.groupBy("cluster").agg(
        ((F.sum("w") <= BLOCK) & (F.sum("m") <= BLOCK_SETS)).alias("whole"),
        F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.greatest(F.col("w") / BLOCK, F.col("m") / BLOCK_SETS)).cast("int")))).alias("blocks"),  # at most 100 or so bands
    )
    rows = members.join(blocks, "cluster").withColumn("own", F.pmod(F.xxhash64("sid"), F.element_at("blocks", F.col("band"))).cast("int"))
    name = lambda band, a, b: F.xxhash64("cluster", band, a, b)
    here = F.transform(F.sequence(F.lit(0), F.element_at("blocks", F.col("band")) - 1), lambda k: name(F.col("band") * 2, F.least(k, "own"), F.greatest(k, "own")))
    none = F.array().cast("array<bigint>")
    beside = lambda d, pair: F.when(F.map_contains_key("blocks", F.col("band") + d), F.transform(F.sequence(F.lit(0), F.element_at("blocks", F.col("band") + d) - 1), pair)).otherwise(none)
    above = beside(1, lambda k: name(F.col("band") * 2 + 1, F.col("own"), k))
    below = beside(-1, lambda k: name(F.col("band") * 2 - 1, k, F.col("own")))
    rows = rows.withColumn("tile", F.explode(F.when(F.col("whole"), F.array(F.col("cluster"))).otherwise(F.concat(here, above, below)))).select("tile", "sid", "n", "shared")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                found = compare_tile([x[0] for x in held], np.array([x[1] for x in held]), [np.frombuffer(x[2], "<u8") for x in held], percent)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(x).to_pylist() for x in ("tile", "sid", "n", "shared")), strict=True):
                if row[0] != tile:
                    yield from done()
                    tile, held = row[0], []
                held.append(row[1:])
        yield from done()

    return mapped(rows.repartition("tile").sortWithinPartitions("tile"), compare, "a long, b long")


def jaccard_join(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Words are runs without ASCII white space, A-Z lowered, of the whole text. A text's set is its distinct shingles of
    `width` words; with fewer words, the whole sequence as one; without words (null, empty) it is empty. Texts link when
    100 |A and B| >= percent |A or B|; an empty set links with nothing. component_id is the smallest doc_id reachable by
    links, the own one included. Rows with equal sets, repeated rows and rows that share a doc_id count as texts of their
    own; a null doc_id is ignored as a smallest one. Shingles are 64-bit hashes. Only the id and the text are read.

    No pair of documents is left out: see the module's text for why candidates are complete. Copies are one vertex.
    """
    vertices = joined(docs, percent, width, id_col, text_col)
    smallest = vertices.where("n > 0").groupBy("vertex").agg(F.min("doc_id").alias("least"))
    out = vertices.join(smallest, "vertex", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def joined(docs: DataFrame, percent: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key (hash of the text), n, vertex of every row; rows with one vertex are reachable by links."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"), F.xxhash64(text_col).alias("key"))
    buckets = parts_for(spark, text_bytes(docs, text_col), BUCKET_BYTES)
    every = shared_counts(rows, buckets, width)
    able = every.where(f"n > 0 and 100 * n_shared >= {percent} * n").groupBy("sid").agg(F.min(F.struct("doc_id", "key")).alias("rep"), F.first("n").alias("n"))
    able = stored(able, "able-sets")
    some, weight = able.agg(F.count("*"), F.sum("n")).first()
    ids = F.broadcast(able) if some <= BROADCAST_IDS else able

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            out = []
            for sid, text in zip(batch.column("sid").to_pylist(), utf8(batch, "body"), strict=True):
                h = shingles(text, known, width)
                if set_id(h) == sid:  # else another text with this hash
                    out.append((sid, len(h), h.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 3, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["sid", "n", "hashes"])

    # By the text's hash too: rows without a doc_id, however many, are not all taken for each other.
    texts = rows.join(ids.select("sid", "rep"), (F.col("key") == F.col("rep.key")) & F.col("id").eqNullSafe(F.col("rep.doc_id"))).select("sid", "body")
    sets = stored(mapped(texts, resolve, "sid long, n long, hashes binary"), "sets")
    prefixes = frequent_prefixes(sets, parts_for(spark, weight or 0, 2 * CHUNK), percent)
    clusters = components(chains(prefixes, percent))
    links = components(tiles(prefixes, clusters, percent))
    return every.join(links.select(F.col("id").alias("sid"), "component"), "sid", "left").withColumn("vertex", F.coalesce("component", "sid"))


def keep_first(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the rows with its smallest (doc_id, hash of the text), with all columns; a null doc_id comes after
    all others. Each row is judged by its own text, whatever else has its doc_id; rows equal in both stay together, as do
    all rows without words. An empty table stays empty."""
    vertices = joined(docs, percent, width, id_col, text_col).where("n > 0")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    first = vertices.groupBy("vertex").agg(F.min(rank).alias("first"))
    lost = vertices.join(first, "vertex").where(~rank.eqNullSafe(F.col("first"))).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct()
    return docs.join(lost, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__key")), "left_anti")
