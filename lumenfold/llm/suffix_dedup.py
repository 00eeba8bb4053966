"""Removal of repeated byte strings by suffix sorting with a difference cover, spread over the cluster by anchors.

Equal strings of `length` bytes have the same anchor: the leftmost place where the hash of Q bytes is least. Strings whose
anchor no other document has are never sorted. The others go, in runs of neighbouring strings with one anchor, to a bucket
of their anchor, where the suffixes of all runs are sorted by difference cover and adjacent prefixes are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, mix64, part_id, parts_for, powers, stored, text_bytes, tidy, utf8
from .ngram_join import NULL_ID, SHARES, buckets_of, share

#: Bytes of an anchor's gram; bytes of text of one chunk; bytes of runs that are sorted at once; bytes packed at once.
Q, CHUNK_BYTES, SORT_BYTES, PACK_BYTES = 26, 16 << 20, 1 << 19, 24 << 20
#: An anchor that more documents have sends each string by itself, to the bucket of its own hash.
HOT = 2_000
STEP = 1 << 19
_ODD = mix64(np.arange(300, 304, dtype=np.uint64)) | np.uint64(1)
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D


_UP = powers(_BASE, STEP + 4096)
_DOWN = powers(pow(_BASE, -1, 1 << 64), STEP + 4096)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of integers from 1 on, by the difference cover {1, 2} of 3.

    Triples at places not divisible by 3 are sorted and named; equal names are told apart by the suffix array of the
    names; the other suffixes are sorted by (first, rank of the next); each finds its place among the sampled ones by
    their common keys."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    s = s.astype(np.int64)
    padded = np.concatenate([s, np.zeros(3 + (n % 3 == 1), np.int64)])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    top = int(s.max()) + 1
    a, b, c = padded[sample], padded[sample + 1], padded[sample + 2]
    if top < 1 << 21:
        triple = (a * top + b) * top + c
        by = np.argsort(triple, kind="stable")
        new = np.append(True, triple[by][1:] != triple[by][:-1])
    else:
        by = np.lexsort((c, b, a))
        new = np.append(True, (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1]) | (c[by][1:] != c[by][:-1]))
    names = np.empty(len(sample), np.int64)
    names[by] = np.cumsum(new)
    order = by if new.all() else suffix_array(names)
    rank = np.zeros(len(padded) + 1, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    zero = np.arange(0, n, 3)
    m = len(rank) + 1
    key = padded[zero] * m + rank[zero + 1]
    zero = zero[np.argsort(key, kind="stable")]
    first, second = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    below = np.searchsorted(padded[first] * m + rank[first + 1], padded[zero] * m + rank[zero + 1])
    pair = np.concatenate([padded[second] * top + padded[second + 1], padded[zero] * top + padded[zero + 1]])
    _, pair = np.unique(pair, return_inverse=True)
    below += np.searchsorted(pair[: len(second)] * m + rank[second + 2], pair[len(second) :] * m + rank[zero + 2])
    out = np.empty(n, np.int64)
    place = below + np.arange(len(zero))
    out[place] = zero
    free = np.ones(n, bool)
    free[place] = False
    out[free] = sampled
    return out


class Runs:
    """The strings of `length` bytes of some documents, in runs with one anchor: anchor hash, document, first string,
    strings, and what hashes any stretch of the buffer."""

    def __init__(self, texts: list[bytes], length: int):
        self.length, wide = length, length - Q + 1
        self.buffer = b"".join(texts) + bytes(length + 8)
        self.starts = np.cumsum([0, *map(len, texts)])
        total, parts = int(self.starts[-1]), []
        for at in range(0, max(0, total - length + 1), STEP):
            stop = min(at + STEP, total - length + 1)  # strings that start here
            grams = stop - at + wide - 1
            words = np.ndarray((grams + Q - 8,), "<u8", self.buffer, at, strides=(1,))
            h = words[:grams] * _ODD[0]
            for k, odd in zip((8, 16, Q - 8), _ODD[1:], strict=True):
                h += words[k : k + grams] * odd
            h = mix64(h)
            low = (h >> np.uint64(20) << np.uint64(20)) | np.arange(grams, dtype=np.uint64)
            done = 1
            while 2 * done <= wide:
                low = np.minimum(low[: len(low) - done], low[done:])
                done *= 2
            if done < wide:
                low = np.minimum(low[: len(low) - wide + done], low[wide - done :])
            anchor = (low & np.uint64(0xFFFFF)).astype(np.int64)
            first_doc, last_doc = np.searchsorted(self.starts, (at, stop - 1), side="right") - 1
            of = np.arange(first_doc, last_doc + 1)
            inside = np.minimum(self.starts[of + 1], stop) - np.maximum(self.starts[of], at)
            doc = np.repeat(of, inside)
            anchor[np.arange(at, stop) + length > np.repeat(self.starts[of + 1], inside)] = -1
            cut = np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))
            first = np.flatnonzero(cut)
            count = np.diff(np.append(first, len(anchor)))
            real = anchor[first] >= 0
            first, count = first[real], count[real]
            # The least of many hashes is small; mixed again, anchors are spread evenly over the buckets.
            parts.append((mix64(h[anchor[first]] + np.uint64(1)), doc[first], first + at, count))
        self.anchor, self.doc, self.first, self.count = (np.concatenate([np.zeros(0, t), *(p[i] for p in parts)]) for i, t in enumerate((np.uint64, np.int64, np.int64, np.int64)))

    def pick(self, which: np.ndarray) -> Runs:
        out = object.__new__(Runs)
        out.length, out.buffer, out.starts = self.length, self.buffer, self.starts
        out.anchor, out.doc, out.first, out.count = self.anchor[which], self.doc[which], self.first[which], self.count[which]
        return out

    def split(self, hot: np.ndarray) -> Runs:
        """Runs of hot anchors as runs of one string each."""
        many = np.isin(self.anchor, hot)
        if not many.any():
            return self
        n = np.where(many, self.count, 1)
        out = self.pick(np.repeat(np.arange(len(n)), n))
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out.first = out.first + step
        out.count = np.where(np.repeat(many, n), 1, out.count)
        return out

    def hashes(self) -> np.ndarray:
        """64-bit hash of each run's bytes."""
        out = np.empty(len(self.first), np.uint64)
        end = self.first + self.count - 1 + self.length
        for at in range(0, len(self.buffer), STEP):
            a, z = np.searchsorted(self.first, (at, at + STEP))
            if a < z:
                data = np.frombuffer(self.buffer, np.uint8, min(STEP + 2 * self.length, len(self.buffer) - at), at)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * _UP[: len(data)], dtype=np.uint64)])
                out[a:z] = (sums[end[a:z] - at] - sums[self.first[a:z] - at]) * _DOWN[self.first[a:z] - at]
        return mix64(out + self.count.astype(np.uint64))

    def bytes_of(self) -> tuple[bytes, np.ndarray]:
        """(all runs' bytes in a row, their sizes)."""
        sizes = self.count - 1 + self.length
        place = np.repeat(self.first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return np.frombuffer(self.buffer, np.uint8)[place].tobytes(), sizes


def sort_and_mark(data: bytes, sizes: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """Mask of each run's strings that also start in a run of a smaller document: suffixes sorted, adjacent prefixes
    compared."""
    ends = np.cumsum(sizes)
    run = np.repeat(np.arange(len(sizes)), sizes)
    text = np.frombuffer(data, np.uint8)
    # Each run is closed by a symbol below all bytes.
    spaced = np.zeros(len(text) + len(sizes), np.int64)
    at = np.arange(len(text)) + run
    spaced[at] = text.astype(np.int64) + 2
    spaced[spaced == 0] = 1
    order = suffix_array(spaced)
    back = np.full(len(spaced), -1, np.int64)
    back[at] = np.arange(len(text))
    order = back[order]
    order = order[order >= 0]
    order = order[order + length <= ends[run[order]]]  # string starts alone
    padded = data + bytes(8)
    same = np.ones(max(0, len(order) - 1), bool)
    words = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    for k in [*range(0, length - 7, 8), length - 8]:
        w = words[np.minimum(order + k, len(data))]
        same &= w[1:] == w[:-1]
    masks = np.zeros(len(sizes), np.uint64)
    if len(order):
        heads = np.flatnonzero(np.append(True, ~same))
        least = np.repeat(np.minimum.reduceat(docs[run[order]], heads), np.diff(np.append(heads, len(order))))
        hit = order[least < docs[run[order]]]
        np.bitwise_or.at(masks, run[hit], np.uint64(1) << (hit - (ends - sizes)[run[hit]]).astype(np.uint64))
    return masks


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes, with `with_text`).

    Whole texts are UTF-8 bytes (null: empty). A byte goes if a string of `length` bytes that covers it also starts in a
    row with a smaller doc_id; strings are judged on the input. n_spans counts maximal removed stretches. Rows with the
    same doc_id don't remove from each other; rows without a doc_id neither remove nor lose anything. Texts shorter than
    `length` stay; an empty table gives no rows. Equality of strings is tested on their bytes where runs differ; whole runs are told equal by 64-bit
    hashes. Only the id and the text are read.
    """
    if not Q + 1 <= length <= Q + 63:
        raise ValueError(f"length must be from {Q + 1} to {Q + 63}")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    chunks = parts_for(spark, text_bytes(docs, text_col), CHUNK_BYTES)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    joined = lambda parts, t: np.concatenate([np.zeros(0, t), *parts])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts as compressed blocks, one of each chunk for some megabytes of input."""
        import zstandard

        press, held, weight = zstandard.ZstdCompressor(level=3), {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            for chunk, of in held.items():
                ids, texts = zip(*of, strict=True)
                yield share([(chunk, chunk, "text", np.array(ids, "<i8").tobytes(), np.array(list(map(len, texts)), "<i8").tobytes(), press.compress(b"".join(texts)))])

        for batch in batches:
            for chunk, i, text in zip(batch.column("chunk").to_pylist(), batch.column("id").to_pylist(), utf8(batch, "body"), strict=True):
                held.setdefault(chunk, []).append((NULL_ID if i is None else i, text))
                weight += len(text)
            if weight > PACK_BYTES:
                yield from flush()
                held, weight = {}, 0
        yield from flush()

    def loads(batches: Iterator[pa.RecordBatch], replies: dict[str, list] | None = None) -> Iterator[tuple[np.ndarray, list[bytes], Runs]]:
        """(ids, texts, runs) of a chunk's blocks; reply rows, which come before, are put aside by their kind."""
        import zstandard

        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for kind, a, b, c in zip(*(batch.column(x).to_pylist() for x in ("kind", "a", "b", "c")), strict=True):
                if kind != "text":
                    replies.setdefault(kind, []).append((a, b, c))
                    continue
                ids, sizes, data = np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8"), press.decompress(c, max_output_size=int(np.frombuffer(b, "<i8").sum()) or 1) if len(c) else b""
                ends = np.cumsum(sizes)
                texts = [data[e - n : e] for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                yield ids, texts, Runs([b"" if i == NULL_ID else x for i, x in zip(ids.tolist(), texts, strict=True)], length)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, of = [], []
        for ids, _, runs in loads(batches):
            keys.append(runs.anchor)
            of.append(ids[runs.doc])
        key, doc = joined(keys, np.uint64), joined(of, np.int64)
        by = np.argsort(key, kind="stable")
        key, doc = key[by], doc[by]
        head = np.append(True, key[1:] != key[:-1])[: len(key)]
        other = np.append(False, (key[1:] == key[:-1]) & (doc[1:] != doc[:-1]))[: len(key)]  # at least so many documents but one
        first = np.flatnonzero(head)
        n = 1 + (np.add.reduceat(other.astype(np.int64), first) if len(first) else np.zeros(0, np.int64))
        key = key[first]
        cuts = np.searchsorted(buckets_of(key, chunks), np.arange(chunks + 1))
        low = (key & np.uint64(0xFFFFFFFF)).astype("<u4")
        for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            own = slice(cuts[k], cuts[k + 1])
            several = np.flatnonzero(n[own] > 1).astype("<u4")
            yield share([(k, part_id(), "ask", low[own].tobytes(), several.tobytes(), n[own][several].astype("<u4").tobytes())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = []
        for batch in batches:
            for chunk, a, b, c in zip(*(batch.column(x).to_pylist() for x in ("chunk", "a", "b", "c")), strict=True):
                low = np.frombuffer(a, "<u4")
                n = np.ones(len(low), np.int64)
                n[np.frombuffer(b, "<u4")] = np.frombuffer(c, "<u4")
                asked.append((chunk, low, n))
        if asked:
            keys, back = np.unique(np.concatenate([x[1] for x in asked]), return_inverse=True)
            df = np.bincount(back, np.concatenate([x[2] for x in asked]))
            at, lead = 0, np.uint64(part_id())
            for chunk, low, _ in asked:
                n = df[back[at : at + len(low)]]
                at += len(low)
                key = lead << np.uint64(32) | low.astype(np.uint64)
                if (n > 1).any():
                    yield share([(chunk, chunk, "keys", key[(n > 1) & (n <= HOT)].tobytes(), key[n > HOT].tobytes())])

    def bucket_key(anchor: np.ndarray) -> np.ndarray:
        return buckets_of(anchor, chunks).astype(np.uint64) << np.uint64(32) | (anchor & np.uint64(0xFFFFFFFF))

    class Known:
        """What a chunk was told: shared anchors, hot ones, the smallest document of runs by hash, masks of runs."""

        def __init__(self, replies: dict[str, list]):
            keys = replies.get("keys", [])
            self.some, self.hot = (np.unique(joined([np.frombuffer(x[i], "<u8") for x in keys], np.uint64)) for i in (0, 1))
            self.h, self.least, self.raw = (joined([np.frombuffer(x[i], t) for x in replies.get("least", [])], t) for i, t in enumerate((np.uint64, np.int64, np.uint8)))
            by = np.argsort(self.h, kind="stable")
            self.h, self.least, self.raw = self.h[by], self.least[by], self.raw[by]
            self.run, self.mask = (joined([np.frombuffer(x[i], "<u8") for x in replies.get("masks", [])], np.uint64) for i in (0, 1))
            by = np.argsort(self.run, kind="stable")
            self.run, self.mask = self.run[by], self.mask[by]

        def chosen(self, runs: Runs) -> tuple[Runs, np.ndarray, np.ndarray]:
            """(runs of shared anchors, hashes of their bytes, where they are sorted)."""
            key = bucket_key(runs.anchor)
            at = np.minimum(np.searchsorted(self.some, key), max(0, len(self.some) - 1))
            real = self.some[at] == key if len(self.some) else np.zeros(len(key), bool)
            if len(self.hot):
                many = np.isin(key, self.hot)
                hot = np.unique(runs.anchor[many])
                runs = runs.pick(np.flatnonzero(real | many)).split(hot)
                h = runs.hashes()
                return runs, h, np.where(np.isin(runs.anchor, hot), h, runs.anchor)
            runs = runs.pick(np.flatnonzero(real))
            return runs, runs.hashes(), runs.anchor

        def told(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(is there a reply, smallest document, to be sent) of runs."""
            at = np.minimum(np.searchsorted(self.h, h), max(0, len(self.h) - 1))
            found = self.h[at] == h if len(self.h) else np.zeros(len(h), bool)
            return found, self.least[at] if len(self.h) else np.zeros(len(h), np.int64), self.raw[at].astype(bool) if len(self.h) else found

        def masks(self, h: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(self.run, h), max(0, len(self.run) - 1))
            return np.where(self.run[at] == h, self.mask[at], 0).astype(np.uint64) if len(self.run) else np.zeros(len(h), np.uint64)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ask for the smallest document of each run's bytes; of a chunk's equal runs the smallest document asks."""
        replies: dict[str, list] = {}
        parts, known = [], None
        for ids, _, runs in loads(batches, replies):
            known = known or Known(replies)
            runs, h, where = known.chosen(runs)
            parts.append((h, where, ids[runs.doc]))
        if not parts:
            return
        h, where, doc = (np.concatenate([p[i] for p in parts]) for i in range(3))
        by = np.lexsort((doc, h))
        h, where, doc = h[by], where[by], doc[by]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
        last = np.append(first[1:], len(h))[: len(first)] - 1
        several = (doc[first] != doc[last]).astype(np.uint8)
        h, where, doc = h[first], where[first], doc[first]
        by = np.argsort(where, kind="stable")
        cuts = np.searchsorted(buckets_of(where[by], chunks), np.arange(chunks + 1))
        for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            own = by[cuts[k] : cuts[k + 1]]
            yield share([(k, part_id(), "runs", h[own].tobytes(), (where[own] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), doc[own].tobytes(), several[own].tobytes())])

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(x).to_pylist() for x in ("chunk", "a", "b", "c", "d")), strict=True):
                got.append((row[0], *(np.frombuffer(x, t) for x, t in zip(row[1:], ("<u8", "<u4", "<i8", np.uint8), strict=True))))
        if not got:
            return
        h, where, doc, several = (np.concatenate([x[i] for x in got]) for i in range(1, 5))
        by = np.lexsort((doc, h, where))
        head = np.append(True, (h[by][1:] != h[by][:-1]) | (where[by][1:] != where[by][:-1]))
        sizes = np.diff(np.append(np.flatnonzero(head), len(by)))
        low = np.empty(len(h), np.int64)
        low[by] = np.repeat(doc[by][head], sizes)
        # Runs with one anchor but other bytes may still share strings.
        cut = np.append(True, where[by][head][1:] != where[by][head][:-1])
        kinds = np.bincount(np.cumsum(cut) - 1)[np.cumsum(cut) - 1]
        raw = np.empty(len(h), bool)
        raw[by] = np.repeat(kinds > 1, sizes)
        raw &= doc == low
        tell = raw | (low < doc) | (several > 0)
        at = 0
        for chunk, own, *_ in got:
            own = slice(at, at + len(own))
            at = own.stop
            t = tell[own]
            if t.any():
                yield share([(int(chunk), int(chunk), "least", h[own][t].tobytes(), low[own][t].tobytes(), raw[own][t].astype(np.uint8).tobytes())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of runs that must be compared with others of their anchor."""
        replies: dict[str, list] = {}
        parts, known = [], None
        for ids, _, runs in loads(batches, replies):
            known = known or Known(replies)
            runs, h, where = known.chosen(runs)
            found, low, raw = known.told(h)
            own = np.flatnonzero(found & raw & (ids[runs.doc] == low))
            own = own[np.sort(np.unique(h[own], return_index=True)[1])]
            data, sizes = runs.pick(own).bytes_of()
            parts.append((h[own], where[own], ids[runs.doc[own]], sizes, data))
        if not parts:
            return
        h, where, doc, sizes = (np.concatenate([p[i] for p in parts]) for i in range(4))
        text = np.frombuffer(b"".join(p[4] for p in parts), np.uint8)
        starts = np.cumsum(sizes) - sizes
        by = np.argsort(where, kind="stable")
        cuts = np.searchsorted(buckets_of(where[by], chunks), np.arange(chunks + 1))
        for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            own = by[cuts[k] : cuts[k + 1]]
            n = sizes[own]
            data = text[np.repeat(starts[own] - np.cumsum(n) + n, n) + np.arange(n.sum())].tobytes()
            yield share([(k, part_id(), "bytes", h[own].tobytes(), where[own].tobytes(), doc[own].tobytes(), n.astype("<u4").tobytes(), data)])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(x).to_pylist() for x in ("chunk", "a", "b", "c", "d", "e")), strict=True):
                got.append((row[0], *(np.frombuffer(x, t) for x, t in zip(row[1:], ("<u8", "<u8", "<i8", "<u4", np.uint8), strict=True))))
        if not got:
            return
        chunk = np.repeat([x[0] for x in got], [len(x[1]) for x in got])
        h, where, doc, sizes, text = (np.concatenate([x[i] for x in got]) for i in range(1, 6))
        del got
        sizes = sizes.astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        by = np.argsort(where, kind="stable")
        cut = np.flatnonzero(np.append(True, where[by][1:] != where[by][:-1]))
        block = (np.cumsum(np.add.reduceat(sizes[by], cut)) - 1) // SORT_BYTES  # whole anchors together
        block = np.repeat(block, np.diff(np.append(cut, len(by))))
        mask = np.zeros(len(h), np.uint64)
        edges = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        for a, z in zip(edges, np.append(edges, len(by))[1:], strict=True):
            own = by[a:z]
            n = sizes[own]
            data = text[np.repeat(starts[own] - np.cumsum(n) + n, n) + np.arange(n.sum())].tobytes()
            mask[own] = sort_and_mark(data, n, doc[own], length)
        by = np.argsort(chunk, kind="stable")
        by = by[mask[by] != 0]
        edges = np.flatnonzero(np.append(True, chunk[by][1:] != chunk[by][:-1])[: len(by)])
        for a, z in zip(edges, np.append(edges, len(by))[1:], strict=True):
            own = by[a:z]
            yield share([(int(chunk[own[0]]), int(chunk[own[0]]), "masks", h[own].tobytes(), mask[own].tobytes())])

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replies: dict[str, list] = {}
        known = None
        for ids, texts, runs in loads(batches, replies):
            known = known or Known(replies)
            replies.clear()
            runs, h, _ = known.chosen(runs)
            found, low, _ = known.told(h)
            runs, h, low = runs.pick(np.flatnonzero(found)), h[found], low[found]
            own = ids[runs.doc]
            mask = np.where(own > low, (np.uint64(1) << runs.count.astype(np.uint64)) - np.uint64(1), np.where(own == low, known.masks(h), np.uint64(0)))
            begins = np.zeros(len(runs.buffer) + 1, np.int32)
            for k in range(int(runs.count.max()) if len(runs.count) else 0):
                begins[runs.first[(mask >> np.uint64(k)) & np.uint64(1) == 1] + k] = 1
            sums = np.cumsum(begins)
            sums[length:] -= sums[:-length].copy()
            gone = sums > 0
            sizes, removed, spans, kept = [], [], [], []
            for i, text in enumerate(texts):
                on = gone[runs.starts[i] : runs.starts[i + 1]]
                n = int(np.count_nonzero(on))
                sizes.append(len(text)), removed.append(n)
                spans.append(int(on[0]) + int(np.count_nonzero(on[1:] & ~on[:-1])) if n else 0)
                kept.append(np.frombuffer(text, np.uint8)[~on].tobytes() if n else text)
            out = [pa.array(ids, pa.int64(), mask=ids == NULL_ID), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([sha(x) for x in kept], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*out, *([pa.array(kept, pa.binary())] if with_text else [])], names=[*names, *(["kept"] if with_text else [])])

    # The same texts are read five times, each time with more replies; blocks are a third of the texts.
    chunk = F.pmod(F.xxhash64("id", "body"), F.lit(chunks)).cast("int")
    blocks = stored(mapped(rows.withColumn("chunk", chunk), pack, SHARES), "text-blocks")

    def with_replies(*replies: DataFrame) -> DataFrame:
        every = blocks
        for r in replies:
            every = every.unionByName(r)
        return every.repartitionById(chunks, "to").sortWithinPartitions(F.col("kind") == "text")

    def exchange(asked: DataFrame, answer, tag: str) -> DataFrame:  # noqa: ANN001
        return stored(mapped(asked.repartitionById(chunks, "to"), answer, SHARES), tag)

    keys = exchange(mapped(with_replies(), ask, SHARES), count, "shared-anchors")
    lows = exchange(mapped(with_replies(keys), compare, SHARES), least, "smallest-documents")
    masks = exchange(mapped(with_replies(keys, lows), send, SHARES), sort, "repeat-masks")
    tidy(spark)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return mapped(with_replies(keys, lows, masks), cover, schema)
