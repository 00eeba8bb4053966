"""Benchmark decontamination by q-gram lemma filtering: shared q-grams are counted in overlapping diagonal bands, and
regions that meet the lemma's bound are verified by banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, utf8

#: Bytes of a q-gram at most: eight, so that one is one 64-bit number.
Q = 8
#: Bytes of benchmark passages whose index goes to every task at once; more passages take more scans.
BLOCK_BYTES = 8 << 20
TABLE_BITS = 22
#: Between the documents of a batch. Normalised passages have no NUL, so no q-gram of theirs lies across.
GAP = bytes(Q)
SIGNS = bytes(32 if x < 128 and not chr(x).isalnum() else x for x in range(256))
FIELDS = {"doc_id": pa.int64(), "item_id": pa.int64(), "start": pa.int64(), "end": pa.int64(), "edits": pa.int64(), "shared_qgrams": pa.int64(), "regions": pa.int64(), "text_key": pa.int64()}


def normal(text: bytes) -> bytes:
    """Lower case; ASCII signs and white space become single spaces."""
    return b" ".join(text.decode().lower().encode().translate(SIGNS).split())


def qgrams(text: bytes, q: int = Q) -> np.ndarray:
    if len(text) < q:
        return np.zeros(0, "<u8")
    return np.ndarray((len(text) - q + 1,), "<u8", text + bytes(8 - q), strides=(1,)) & np.uint64((1 << 8 * q) - 1)


def hashed(gram: np.ndarray) -> np.ndarray:
    return (gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)


def budget(length: int, rate: float) -> int:
    """Edits allowed in a passage of so many bytes: fewer than its bytes, so that it can't be edited away."""
    return max(0, min(int(length * rate), length - 1))


def gram_size(length: int, edits: int) -> int:
    """The longest q-gram, up to Q bytes, of which the lemma still asks for one: len - q + 1 - q * edits >= 1."""
    return min(Q, length // (edits + 1))


class Index:
    """All q-grams of some passages: sorted keys with their (passage, place), behind a bit table."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float, q: int = Q):
        self.q, self.items, self.edits = q, items, [budget(len(x), rate) for _, x in items]
        grams = [qgrams(x, q) for _, x in items]
        self.own = grams
        keys = np.concatenate([np.zeros(0, "<u8"), *grams])
        owner = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(g)) for g in grams)])
        by = np.argsort(keys, kind="stable")
        self.keys, self.owner, self.place = keys[by], owner[by], place[by]
        self.distinct, first = np.unique(self.keys, return_index=True)
        self.first = np.append(first, len(self.keys))
        self.least = np.array([len(x) - q + 1 - q * e for (_, x), e in zip(items, self.edits, strict=True)], np.int64)
        self.wide = np.array(self.edits, np.int64) + 1
        #: Added to diagonals so that none is negative.
        self.shift = max((len(x) for _, x in items), default=0)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[hashed(self.keys).astype(np.int64)] = True

    def strips(self, texts: list[bytes], step: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, passage, strip, shared q-grams) of every strip of diagonals with any, in this order. Diagonals are those
        of the text itself, so a strip never reaches into another text of the batch."""
        starts = np.cumsum([0, *(len(x) + len(GAP) for x in texts)])
        room = (max(map(len, texts), default=0) + self.shift + 2).bit_length()
        many = max(1, len(self.items) - 1).bit_length()
        gram, keys, counts = qgrams(GAP.join(texts), self.q), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(0, len(gram), step):
            part = gram[i : i + step]
            at = np.flatnonzero(self.table[hashed(part).astype(np.int64)])
            low = np.searchsorted(self.distinct, part[at])
            real = self.distinct[np.minimum(low, len(self.distinct) - 1)] == part[at]
            at, low = at[real], low[real]
            text = np.searchsorted(starts, at + i, side="right") - 1
            n = self.first[low + 1] - self.first[low]
            which = np.repeat(self.first[low] - np.cumsum(n) + n, n) + np.arange(n.sum())
            owner = self.owner[which]
            strip = (np.repeat(at + i - starts[text], n) - self.place[which] + self.shift) // self.wide[owner]
            key, n = np.unique((np.repeat(text, n) << many | owner) << room | strip, return_counts=True)
            keys.append(key), counts.append(n)
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        own = key >> room
        return own >> many, own & (1 << many) - 1, key & (1 << room) - 1, np.bincount(back, np.concatenate(counts), len(key)).astype(np.int64)

    def regions(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, passage, first byte, end, shared q-grams) of bands of diagonals that share enough q-grams.

        An occurrence with e edits keeps len - q + 1 - q * e q-grams, on diagonals at most e apart and from its start. So
        these lie in two neighbouring strips of e + 1 diagonals; every such pair is a band, half over the next."""
        of, owner, strip, n = self.strips(texts)
        beside = np.zeros(len(n), np.int64)
        if len(n) > 1:
            next_ = (of[1:] == of[:-1]) & (owner[1:] == owner[:-1]) & (strip[1:] == strip[:-1] + 1)
            beside[:-1] = np.where(next_, n[1:], 0)
        total = n + beside
        for k in np.flatnonzero(total >= self.least[owner]).tolist():
            o, text = int(owner[k]), texts[of[k]]
            e, size = self.edits[o], len(self.items[o][1])
            low = int(strip[k]) * (e + 1) - self.shift - e
            low, high = max(0, low), max(0, min(len(text), low + 2 * (e + 1) + size + 2 * e))
            # The lemma counts each of the passage's q-grams once; repeats in the text may have counted for more.
            if np.isin(self.own[o], qgrams(text[low:high], self.q)).sum() >= self.least[o]:
                yield int(of[k]), o, low, high, int(total[k])


def align(item: bytes, region: bytes, edits: int) -> tuple[int, int, int] | None:
    """(edits, first byte, end) of the best place of the item in the region with at most `edits` edits; the leftmost end
    of equals. Rows are the item's bytes; only cells within the band of diagonals that the region allows are kept."""
    if (at := region.find(item)) >= 0:
        return 0, at, at + len(item)
    if not edits:
        return None
    text, far = np.frombuffer(region, np.uint8), 1 << 20
    n, width = len(region), len(region) - len(item) + 2 * edits + 1
    if width <= 0:
        return None
    # Column j of row i is the text's place i - edits + j; a free start anywhere in the band.
    j = np.arange(width)
    cost, start = np.where((j - edits >= 0) & (j - edits <= n), 0, far), j - edits
    for i in range(1, len(item) + 1):
        a, z = max(0, edits + 1 - i), min(width, n + edits - i + 1)  # cells with a text byte before them
        new, begin = np.full(width, far), start
        if a < z:
            new[a:z] = cost[a:z] + (text[i - edits + a - 1 : i - edits + z - 1] != item[i - 1])
        up = cost[1:] + 1
        better = up < new[:-1]
        if better.any():
            begin = start.copy()
            new[:-1][better], begin[:-1][better] = up[better], start[1:][better]
        new[: max(0, edits - i)] = far
        new[max(0, n + edits - i + 1) :] = far
        lead = new - j
        least = np.minimum.accumulate(lead)  # text bytes that are left out, along the row
        cost, start = least + j, begin[np.maximum.accumulate(np.where(lead == least, j, 0))]
        cost[max(0, n + edits - i + 1) :] = far
        if not i & 7 and cost.min() > edits:
            return None
    best = int(cost.argmin())
    return (int(cost[best]), int(start[best]), len(item) - edits + best) if cost[best] <= edits else None


def places(item: bytes, text: bytes) -> list[int]:
    """Every first byte of the item in the text; occurrences may overlap."""
    out, at = [], text.find(item)
    while at >= 0:
        out.append(at)
        at = text.find(item, at + 1)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and benchmark passage that occurs in it: doc_id, item_id, start, end (bytes of the
    normalised text), edits, shared_qgrams, regions (verified bands), text_key (hash of the document's text).

    Texts are normalised (lower case, signs and white space to single spaces). A passage occurs where a stretch of the
    text is within `rate` of its bytes of edits; of several places the one with fewest edits, then the first, is given.
    Each text is searched on its own, so its rows don't depend on its neighbours. Passages too short for q-grams of Q
    bytes have shorter ones. Those under Q bytes with no edits allowed are looked for as they are (no shared q-grams, each
    place a region); passages without bytes never occur. Null passages and texts are empty. Equal passages each give
    rows, as do rows with the same doc_id. Every document is read whole. Passages are read on the driver in blocks of at
    most BLOCK_BYTES, and each block is one scan of the documents. Without passages or documents there are no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"), F.xxhash64(text_col).alias("key"))
    blocks: list[list[tuple[int, bytes]]] = [[]]
    size, out = 0, None
    for row in benchmark.select(F.col(item_col).cast("long"), item_text_col).toLocalIterator():
        item = normal((row[1] or "").encode())
        if item:
            if size + len(item) > BLOCK_BYTES:
                blocks.append([])
                size = 0
            blocks[-1].append((row[0], item))
            size += len(item)
    for block in blocks:
        index = docs.sparkSession.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            short, by_size = [], {}
            for item in index.value:
                size, edits = len(item[1]), budget(len(item[1]), rate)
                (by_size.setdefault(gram_size(size, edits), []) if edits or size >= Q else short).append(item)
            indexes = [Index(of, rate, q) for q, of in sorted(by_size.items())]
            for batch in batches:
                texts = [normal(x) for x in utf8(batch, "body")]
                ids, text_keys = batch.column("id").to_pylist(), batch.column("key").to_pylist()
                found = [(ids[of], k, at, at + len(item), 0, 0, len(places(item, x)), text_keys[of]) for k, item in short for of, x in enumerate(texts) if (at := x.find(item)) >= 0]
                for own in indexes:
                    best: dict[tuple[int, int], tuple] = {}
                    ends: dict[tuple[int, int], set] = {}
                    for of, o, low, high, shared in own.regions(texts):
                        if (got := align(own.items[o][1], texts[of][low:high], own.edits[o])) is not None:
                            place = (got[0], low + got[1], low + got[2], shared)
                            ends.setdefault((of, o), set()).add(place[2])
                            best[of, o] = min(best.get((of, o), place), place)
                    found += [(ids[of], own.items[o][0], p[1], p[2], p[0], p[3], len(ends[of, o]), text_keys[of]) for (of, o), p in sorted(best.items())]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found) if found else [[]] * 8, FIELDS.values(), strict=True)], names=list(FIELDS))

        part = mapped(rows, search, "doc_id long, item_id long, start long, end long, edits long, shared_qgrams long, regions long, text_key long")
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows of `docs` in which no passage occurs, with all their columns; each row is judged by its own text, null ones as
    empty. Rows equal in id and text go or stay together; an empty table stays empty."""
    lost = contaminated(docs, benchmark, id_col=id_col, text_col=text_col, **more).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    return docs.join(lost, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__key")), "left_anti")
