"""LM scoring by logistic context mixing over bits, with counts of the whole training corpus.

A text's bytes are predicted twice: by the mix of contexts of up to ORDER bytes, and by short contexts alone. Which of the
two is believed is learned online within each text, from how well each did on the bytes just before.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import answered, dealt, mapped, mix64, part_id, parts_for, stored, text_bytes, utf8, words_in

#: Bytes of context of the longest predictor. Contexts of LOW bytes or fewer are counted in one table for all (at most
#: 2^24 grams); longer ones within the bucket of their last LOW + 1 bytes (at most 2^24 grams for each such key).
ORDER, LOW = 5, 2
#: Bits of each order's slot numbers, for a model of one text whose counts are hashed.
SLOT_BITS = (8, 16, 19, 20, 21, 22)
#: Tasks that sum the table of short contexts; bytes of text for one cell of grams, and grams for one task that fits weights.
LOW_TASKS, CELL_BYTES, FIT_GRAMS = 64, 2 << 20, 1_000_000
#: Bytes of text in one chunk, at most about.
CHUNK_BYTES = 16 << 20
#: Scores are whole numbers of this unit (of log10), and sums of fits of FIT_UNIT, so that no order of adding changes them.
UNIT, FIT_UNIT = 1 / 65536, 1 / 4096
#: Bytes of a text that say whom to believe, the weight of what they say, and where a text begins (in stretched odds).
WINDOW, TRUST, START = 64, 0.25, 2.0
GATES, APM = 6 * 8 * 6, 33
PAD, LN10 = b"\n" * ORDER, math.log(10)


def canonical(text: bytes) -> bytes:
    """The bytes that are scored: A-Z lowered, words each followed by one space, then one more space as the end."""
    return written_out(b" ".join(text.lower().split()))


def written_out(words: bytes) -> bytes:
    """So for words with single spaces between."""
    return words + b"  " if words else b" "


def slots(gram: np.ndarray, order: int, bit: int) -> np.ndarray:
    """Slot of the order's context and the bits of the byte so far, at a bit from 0 to 7."""
    context = (gram >> np.uint64(8)) & np.uint64((1 << 8 * order) - 1)
    node = (gram & np.uint64(255) | np.uint64(256)) >> np.uint64(8 - bit)
    return (mix64(((context << np.uint64(9)) | node) + np.uint64((order + 1) << 57)) >> np.uint64(64 - SLOT_BITS[order])).astype(np.int64)


def rounded(log10: np.ndarray) -> np.ndarray:
    return np.rint(log10 / UNIT) * UNIT


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Mixer:
    """Bit predictors of contexts of 0 to ORDER bytes, combined by gated weights and refined by an adaptive map.

    tallies() says how often each context saw a 0 and a 1; here, from hashed tables. The weight set is chosen by the bit's
    place and by how much the longest contexts have seen; the last stage interpolates a table over (bit's place and gate,
    mixed odds). Weight sets of different bits have nothing in common, so each bit is gone through on its own.
    """

    def __init__(self, zeros: list[np.ndarray], ones: list[np.ndarray], weights: np.ndarray | None = None, refine: np.ndarray | None = None):
        self.n = zeros, ones
        self.weights = np.full((GATES, ORDER + 2), 0.3) if weights is None else weights
        self.refine = refine

    def tallies(self, gram: np.ndarray, bit: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """(the bit itself, (zeros, ones) of each order's context with the bits before)."""
        at = [slots(gram, order, bit) for order in range(ORDER + 1)]
        return ((gram >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64), [(self.n[0][k][x], self.n[1][k][x]) for k, x in enumerate(at)]

    def inputs(self, gram: np.ndarray, bit: int, without: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(stretched predictions with a bias, gate, the bit itself). `without`: as if this occurrence had not been counted."""
        y, tallies = self.tallies(gram, bit)
        x, seen = np.empty((len(gram), ORDER + 2)), []
        for order, (n0, n1) in enumerate(tallies):
            n0, n1 = n0.astype(np.float64), n1.astype(np.float64)
            if without:
                n0 = np.maximum(n0 - (y == 0), 0)
                n1 = np.maximum(n1 - (y == 1), 0)
            x[:, order] = stretch((n1 + 0.02) / (n0 + n1 + 0.04))
            x[n0 + n1 == 0, order] = 0
            seen.append(n0 + n1)
        x[:, -1] = 0.3
        level = lambda n: np.minimum(np.log2(n + 1).astype(np.int64), 5)
        return x, (level(seen[ORDER]) * 6 + level(seen[ORDER - 2])) * 8 + bit, y

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip((self.weights[gate] * x).sum(1), -12, 12)

    def train(self, gram: np.ndarray, times: np.ndarray, rate: float = 0.02, step: int = 2048) -> None:
        """Online gradient steps on coding cost over these grams, each weighted by how often it occurs."""
        for bit in range(8):
            for at in range(0, len(gram), step):
                g, t = gram[at : at + step], times[at : at + step].astype(np.float64)
                x, gate, y = self.inputs(g, bit, True)
                miss = (y - squash(self.mixed(x, gate))) * t
                sums = np.stack([np.bincount(gate, miss * x[:, k], GATES) for k in range(x.shape[1])], 1)
                total = np.bincount(gate, t, GATES)[:, None]
                self.weights += rate * sums / np.maximum(total, 1) * np.minimum(np.sqrt(total), 8)

    def spots(self, mixed: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = (mixed + 12) * (APM - 1) / 24
        low = np.minimum(place.astype(np.int64), APM - 2)
        return gate * APM + low, place - low

    def outcomes(self, gram: np.ndarray, times: np.ndarray, step: int = 1 << 15) -> np.ndarray:
        """(zeros, ones) seen at each spot of the adaptive map, for these grams."""
        out = np.zeros((2, GATES * APM))
        for bit in range(8):
            for i in range(0, len(gram), step):
                x, gate, y = self.inputs(gram[i : i + step], bit, True)
                at, part = self.spots(self.mixed(x, gate), gate)
                for k in (0, 1):
                    of = times[i : i + step] * (y == k)
                    out[k] += np.bincount(at, of * (1 - part), GATES * APM) + np.bincount(at + 1, of * part, GATES * APM)
        return out

    def log10(self, gram: np.ndarray, step: int = 1 << 15) -> np.ndarray:
        """log10 probability of each gram's last byte after its context."""
        total = np.zeros(len(gram))
        for bit in range(8):
            for i in range(0, len(gram), step):
                x, gate, y = self.inputs(gram[i : i + step], bit, False)
                mixed = self.mixed(x, gate)
                p = squash(mixed)
                if self.refine is not None:
                    at, part = self.spots(mixed, gate)
                    p = 0.5 * p + 0.5 * (self.refine[at] * (1 - part) + self.refine[at + 1] * part)
                p = np.clip(p, 1e-6, 1 - 1e-6)
                total[i : i + step] += np.log10(np.where(y == 1, p, 1 - p))
        return total


class BlockMixer(Mixer):
    """A mixer with exact counts, however large the corpus. It holds one block of distinct grams with all that share their
    last LOW + 1 bytes of context, and `low`: the whole corpus's distinct grams of LOW bytes of context, sorted, with
    their counts. Its methods take places in the block for grams."""

    def __init__(self, low: tuple[np.ndarray, np.ndarray], weights: np.ndarray | None = None, refine: np.ndarray | None = None):
        super().__init__([], [], weights, refine)
        self.low = low

    def hold(self, gram: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Take this block; the places of its grams."""
        self.gram, self.bit, self.keys = gram, -1, []
        after = np.unique(gram >> np.uint64(8) & np.uint64((1 << 8 * LOW) - 1))
        own = np.isin(self.low[0] >> np.uint64(8), after)
        for order in range(ORDER + 1):
            key = gram & np.uint64((1 << 8 * (order + 1)) - 1)
            if order > LOW:
                keys, at = np.unique(key, return_inverse=True)
                times = np.bincount(at, n, len(keys)).astype(np.int64)
            else:
                of = (self.low[0][own], self.low[1][own]) if order == LOW else self.low
                keys, times = of if order == LOW else summed(of[0] & np.uint64((1 << 8 * (order + 1)) - 1), of[1])
                at = np.searchsorted(keys, key)
            self.keys.append((keys, times, at))
        return np.arange(len(gram))

    def tallies(self, gram: np.ndarray, bit: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        if bit != self.bit:
            self.bit, self.sums = bit, []
            for keys, times, _ in self.keys:  # sorted keys: those with the same first bits stand together
                own, every = runs(keys >> np.uint64(7 - bit), times), runs(keys >> np.uint64(8 - bit), times)
                self.sums.append((own, every - own))
        y = ((self.gram[gram] >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64)
        out = []
        for (_, _, at), (own, other) in zip(self.keys, self.sums, strict=True):
            same, rest = own[at[gram]], other[at[gram]]
            out.append((np.where(y == 0, same, rest), np.where(y == 1, same, rest)))
        return y, out


def runs(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each place of sorted keys the sum of n over all places with its key."""
    new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    return np.add.reduceat(n, np.flatnonzero(new))[np.cumsum(new) - 1] if len(keys) else n


def turned(gram: np.ndarray) -> np.ndarray:
    """The gram with the LOW + 1 bytes before its last one moved to the front, so that a bucket's keys sort together."""
    near = gram >> np.uint64(8) & np.uint64((1 << 24) - 1)
    return near << np.uint64(24) | (gram >> np.uint64(32)) << np.uint64(8) | gram & np.uint64(255)


def turned_back(key: np.ndarray) -> np.ndarray:
    near, rest = key >> np.uint64(24), key & np.uint64((1 << 24) - 1)
    return (rest >> np.uint64(8)) << np.uint64(32) | near << np.uint64(8) | rest & np.uint64(255)


def planes(sorted_: np.ndarray, width: int) -> bytes:
    """Differences of ascending numbers, the lowest bytes of all first: most higher ones are zeros and pack well."""
    return np.diff(sorted_, prepend=sorted_.dtype.type(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def of_planes(data: bytes, width: int) -> np.ndarray:
    x = np.zeros((len(data) // width, 8), np.uint8)
    x[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return np.cumsum(x.view("<u8")[:, 0], dtype=np.uint64)


def counts_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view("<i8")[:, 0]


def count_bytes(n: np.ndarray) -> bytes:
    return n.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


class GramTable:
    """A bounded hash table from grams to slots of parallel arrays, with two probes; what finds no room is left out."""

    def __init__(self, bits: int = 22):
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)

    def find(self, gram: np.ndarray) -> np.ndarray:
        """Slot of each gram, -1 if it has none."""
        h = mix64(gram)
        a = (h & self.mask).astype(np.int64)
        out = np.where(self.keys[a] == gram + np.uint64(1), a, -1)
        rest = np.flatnonzero(out < 0)
        if len(rest):
            b = (h[rest] >> np.uint64(40) & self.mask).astype(np.int64)
            out[rest] = np.where(self.keys[b] == gram[rest] + np.uint64(1), b, -1)
        return out

    def add(self, gram: np.ndarray) -> np.ndarray:
        """Give distinct new grams slots where one is free; the slots, -1 where none was."""
        h, out = mix64(gram), np.full(len(gram), -1, np.int64)
        for at in ((h & self.mask).astype(np.int64), (h >> np.uint64(40) & self.mask).astype(np.int64)):
            todo = np.flatnonzero((out < 0) & (self.keys[at] == 0))
            _, first = np.unique(at[todo], return_index=True)
            todo = todo[first]
            self.keys[at[todo]] = gram[todo] + np.uint64(1)
            out[todo] = at[todo]
        return out


class GramCounts:
    """How often each gram was seen; exact, whatever finds no room in the table."""

    def __init__(self) -> None:
        self.table, self.rest = GramTable(), []
        self.n = np.zeros(len(self.table.keys), np.int64)

    def see(self, gram: np.ndarray, times: int = 1) -> None:
        """Count these grams `times` times each; with 0 they are only listed."""
        at = self.table.find(gram)
        if times:
            np.add.at(self.n, at[at >= 0], times)
        if len(new := gram[at < 0]):
            new, n = np.unique(new, return_counts=True)
            n *= times
            at = self.table.add(new)
            self.n[at[at >= 0]] += n[at >= 0]
            self.rest.append((new[at < 0], n[at < 0]))

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        own = np.flatnonzero(self.table.keys)
        gram, n = np.concatenate([self.table.keys[own] - np.uint64(1), *(x[0] for x in self.rest)]), np.concatenate([self.n[own], *(x[1] for x in self.rest)])
        return summed(gram, n)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, n, len(keys)).astype(np.int64)


def slices(texts: list[bytes], step: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams, index of their text) of canonical texts, about `step` at a time."""
    starts = np.cumsum([0, *(len(x) + ORDER for x in texts)])
    buffer = b"".join(PAD + x for x in texts)
    for at in range(0, len(buffer) - ORDER, step):
        gram = grams_of(buffer, at, min(at + step, len(buffer) - ORDER))
        place = np.arange(at, at + len(gram)) + ORDER
        text = np.searchsorted(starts, place, side="right") - 1
        real = place - starts[text] >= ORDER
        yield gram[real], text[real]


def grams_of(buffer: bytes, start: int, stop: int) -> np.ndarray:
    a = np.frombuffer(buffer, np.uint8, stop - start + ORDER, start).astype(np.uint64)
    k = a[: stop - start].copy()
    for j in range(1, ORDER + 1):
        k = (k << np.uint64(8)) | a[j : j + stop - start]
    return k


class ShortScores:
    """log10 probability of a byte after the two before it: counts of two, one and no bytes of context, each smoothed by the
    shorter one in proportion to how many bytes it was followed by. One row of 256 for each two bytes that occur."""

    def __init__(self, low: tuple[np.ndarray, np.ndarray], step: int = 1 << 12):
        keys, n = low
        keys = keys.astype(np.int64)
        one = np.bincount(keys & 0xFFFF, n, 1 << 16).reshape(256, 256)
        one = self.smoothed(one, ((one.sum(0) + 0.5) / (one.sum() + 128))[None])
        context, at = np.unique(keys >> 8, return_inverse=True)
        self.row = np.arange(1 << 16) & 255  # two bytes that never occur are scored by the second alone
        self.row[context] = 256 + np.arange(len(context))
        table = [one]
        for k in range(0, len(context), step):
            own = slice(*np.searchsorted(at, (k, k + step)))  # the keys are sorted
            two = np.bincount((at[own] - k) << 8 | keys[own] & 255, n[own], min(step, len(context) - k) << 8).reshape(-1, 256)
            table.append(self.smoothed(two, one[context[k : k + step] & 255]))
        self.table = rounded(np.log10(np.concatenate(table))).astype(np.float32).ravel()

    @staticmethod
    def smoothed(n: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        kinds = (n > 0).sum(1, keepdims=True) + 1
        return (n + kinds * shorter) / (n.sum(1, keepdims=True) + kinds)

    def of(self, gram: np.ndarray) -> np.ndarray:
        gram = gram.astype(np.int64)
        return self.table[self.row[gram >> 8 & 0xFFFF] << 8 | gram & 255].astype(np.float64)


class Online:
    """Believes one of two scorers of the same bytes, text by text: the weight of the first follows from how much better it
    did on the WINDOW bytes before, in the same text. What a byte is given depends on earlier bytes alone, so the result is a
    distribution over the next byte if both are."""

    def __init__(self) -> None:
        self.d, self.doc = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def scores(self, doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """log10 probabilities, of the bytes that come next; `doc` says which text each is of."""
        ahead, before = np.minimum(a - b, 30), len(self.d)
        d = np.append(self.d, np.rint(ahead / UNIT).astype(np.int64))
        doc = np.append(self.doc, doc)
        first = np.flatnonzero(doc[1:] != doc[:-1]) + 1
        begin = np.repeat(np.append(0, first), np.diff(np.concatenate([[0], first, [len(d)]])))
        sums = np.append(0, np.cumsum(d))
        told = (sums[:-1] - sums[np.maximum(np.arange(-WINDOW, len(d) - WINDOW), begin)])[before:]
        self.d, self.doc = d[-WINDOW:], doc[-WINDOW:]
        # Single precision is finer than UNIT.
        w = 1 / (1 + np.exp(-np.clip(START + told * (TRUST * LN10 * UNIT), -30, 30).astype(np.float32)))
        return b + np.log(w * np.exp((ahead * LN10).astype(np.float32)) + (1 - w)) / LN10


def rows_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"), held.alias("held"))


FLOW = "to int, chunk int, kind string, a binary, b binary"


def flow(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 5, types, strict=True)], names=["to", "chunk", "kind", "a", "b"])


def gather(rows: DataFrame, parts: int, cells: int) -> DataFrame:
    """Corpus counts: for each chunk of documents the training counts of its words (kind `words`, chunk, words, counts);
    all distinct grams with their training counts (kind `grams`), one block for each cell (in place of the chunk), whole by the
    last LOW + 1 bytes of context; the same summed by the last LOW bytes (kind `low`); the grams of each chunk and bucket
    (kind `asked`). Each chunk and bucket exchange one block of words and one of grams. Cells follow from the grams and
    from the corpus's size; `parts` only says how many cells a bucket has."""

    def cell_of(key: np.ndarray) -> np.ndarray:
        return (mix64(key >> np.uint64(24)) % np.uint64(cells)).astype(np.int64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[Counter] = [Counter(), Counter()]
        counts, chunk = GramCounts(), part_id()
        for batch in batches:
            texts, own = utf8(batch, "body"), np.array(batch.column("held").to_pylist(), bool)
            for held in (0, 1):
                names, index, _, joined = words_in([texts[k] for k in np.flatnonzero(own == held).tolist()])
                for x, n in zip(names, np.bincount(index, minlength=len(names)).tolist(), strict=True):
                    if n:
                        words[held][x] += n
                for gram, _ in slices([written_out(x) for x in joined]):
                    counts.see(gram, 1 - held)
        blocks: dict[int, list[bytes]] = {}
        for word in words[0].keys() | words[1].keys():
            blocks.setdefault(zlib.crc32(word) % parts, []).append(word)
        for to, block in blocks.items():
            yield flow([(to, chunk, "words", b" ".join(block), np.array([words[0][x] for x in block], "<i8").tobytes())])
        gram, n = counts.result()
        key = turned(gram)
        to = cell_of(key) * parts // cells
        by = np.lexsort((key, to))
        ends = np.searchsorted(to[by], np.arange(parts + 1))
        for k in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
            own = by[ends[k] : ends[k + 1]]
            yield flow([(k, chunk, "grams", planes(key[own], 6), count_bytes(n[own]))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter = Counter()
        asked, key, n, to = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], part_id()
        for batch in batches:
            for chunk, kind, a, b in zip(*(batch.column(x).to_pylist() for x in ("chunk", "kind", "a", "b")), strict=True):
                if kind == "grams":
                    yield flow([(to, chunk, "asked", a, b"")])
                    key.append(of_planes(a, 6)), n.append(counts_of(b))
                    if len(key) > 16:
                        one = summed(np.concatenate(key), np.concatenate(n))
                        key, n = [one[0]], [one[1]]
                    continue
                block = a.split(b" ")
                for word, k in zip(block, np.frombuffer(b, "<i8").tolist(), strict=True):
                    totals[word] += k
                asked.append((chunk, a))
        for chunk, a in asked:
            yield flow([(to, chunk, "words", a, np.array([totals[x] for x in a.split(b" ")], "<i8").tobytes())])
        known = [x for x in totals.values() if x]
        yield flow([(to, -1, "sums", b"", np.array([sum(known), len(known)], ">i8").tobytes())])
        keys, times = summed(np.concatenate(key), np.concatenate(n))
        cell = cell_of(keys)
        by = np.argsort(cell, kind="stable")
        edges = np.flatnonzero(np.append(True, cell[by][1:] != cell[by][:-1])[: len(by)])
        for a, z in zip(edges, np.append(edges, len(by))[1:], strict=True):
            yield flow([(to, int(cell[by[a]]), "grams", planes(keys[by[a:z]], 6), count_bytes(times[by[a:z]]))])
        low, times = summed(turned_back(keys) & np.uint64((1 << 8 * (LOW + 1)) - 1), times)
        task = (mix64(low) % np.uint64(LOW_TASKS)).astype(np.int64)
        for k in np.unique(task).tolist():
            yield flow([(k, -1, "low", planes(low[task == k], 3), count_bytes(times[task == k]))])

    asked = mapped(dealt(rows, parts, "id", "body"), ask, FLOW)
    return stored(mapped(asked.repartitionById(parts, "to"), count, FLOW), "lm-counts")


def added(rows: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """The 64-bit integers in `a` and in `b`, each summed over all rows: by 16 tasks, then on the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            for row in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                own = [np.frombuffer(x, "<i8") for x in row]
                sums = own if sums is None else [x + y for x, y in zip(sums, own, strict=True)]
        if sums is not None:
            yield flow([(0, 0, "sum", sums[0].tobytes(), sums[1].tobytes())])

    got = [[np.frombuffer(x, "<i8") for x in (r["a"], r["b"])] for r in mapped(rows.repartition(16), add, FLOW).collect()]
    return [sum(x) for x in zip(*got, strict=True)] if got else []


def build(counts: DataFrame, n_grams: int, cells: int) -> BlockMixer:
    """The model from the distinct grams: the table of short contexts, then weights, then the adaptive map. The last two
    each run over all training grams, FIT_GRAMS or so in a task; weights are averaged and outcomes summed. All that
    decides the result (which grams a task has, and their order) follows from the grams alone."""
    spark = counts.sparkSession
    tasks = max(1, min(cells, -(-n_grams // FIT_GRAMS)))
    grams_ = counts.where("kind = 'grams'").withColumn("to", F.floor(F.col("chunk").cast("long") * tasks / cells).cast("int")).repartitionById(tasks, "to").sortWithinPartitions("chunk")

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            a, b = ([np.zeros(0, np.uint64), *(of_planes(x, 3) for x in batch.column("a").to_pylist())], [np.zeros(0, np.int64), *map(counts_of, batch.column("b").to_pylist())])
            key, n = summed(np.concatenate([key, *a]), np.concatenate([n, *b]))
        if len(key):
            yield flow([(0, 0, "low", planes(key, 3), count_bytes(n))])

    lows = [(of_planes(r["a"], 3), counts_of(r["b"])) for r in mapped(counts.where("kind = 'low'").repartitionById(LOW_TASKS, "to"), total, FLOW).select("a", "b").toLocalIterator()]  # at most 2^24 grams
    low = summed(np.concatenate([np.zeros(0, np.uint64), *(x[0] for x in lows)]), np.concatenate([np.zeros(0, np.int64), *(x[1] for x in lows)]))
    lows = spark.sparkContext.broadcast(low)

    def blocks(mixer: BlockMixer, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, counts) of each block's training grams, in an order that has nothing to do with the grams, the same in every run."""
        for batch in batches:
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                gram, n = turned_back(of_planes(a.as_py(), 6)), counts_of(b.as_py())
                at = mixer.hold(gram, n)[np.argsort(mix64(gram))]
                at = at[n[at] > 0]
                yield at, n[at]

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, seen = BlockMixer(lows.value), 0
        for at, n in blocks(mixer, batches):
            mixer.train(at, n)
            seen += len(at)
        if seen:
            yield flow([(0, 0, "weights", np.array([seen], "<i8").tobytes(), np.rint(mixer.weights * seen / FIT_UNIT).astype("<i8").tobytes())])

    sums = added(mapped(grams_, train, FLOW))
    weights = (sums[1] / sums[0] * FIT_UNIT).reshape(GATES, ORDER + 2) if sums else None

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, sums = BlockMixer(lows.value, weights), np.zeros((2, GATES * APM))
        for at, n in blocks(mixer, batches):
            sums += mixer.outcomes(at, n)
        yield flow([(0, 0, "refine", *(np.rint(x / FIT_UNIT).astype("<i8").tobytes() for x in sums))])

    seen = np.array(added(mapped(grams_, refine, FLOW)) or np.zeros((2, GATES * APM))) * FIT_UNIT
    start = np.tile(squash(np.linspace(-12, 12, APM)), GATES)
    mixer = BlockMixer(low, weights, (seen[1] + 4 * start) / (seen.sum(0) + 4))
    mixer.lows = lows
    return mixer


def scored(counts: DataFrame, mixer: BlockMixer, parts: int) -> DataFrame:
    """For each chunk and bucket the chunk's grams (a, after one space) with their log10 probabilities (b)."""
    lows, weights, refine = mixer.lows, mixer.weights, mixer.refine

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, key, score = BlockMixer(lows.value, weights, refine), [], []
        for batch in batches:
            for chunk, kind, a, b in zip(*(batch.column(x).to_pylist() for x in ("chunk", "kind", "a", "b")), strict=True):
                own = of_planes(a, 6)
                if kind == "grams":
                    key.append(own), score.append(rounded(model.log10(model.hold(turned_back(own), counts_of(b)))).astype("<f4"))
                    continue
                if len(key) > 1:
                    by = np.argsort(keys := np.concatenate(key))
                    key, score = [keys[by]], [np.concatenate(score)[by]]
                yield flow([(0, chunk, "scores", b" " + a, score[0][np.searchsorted(key[0], own)].tobytes())])

    rows = counts.where("kind in ('grams', 'asked')").repartitionById(parts, "to").sortWithinPartitions(F.col("kind") == "asked")
    return mapped(rows, reply, FLOW)


class Scores:
    """The scores of a chunk's grams: in a hash table; whatever finds no room there is searched for."""

    def __init__(self, gram: np.ndarray, score: np.ndarray):
        self.table = GramTable()
        self.score = np.zeros(len(self.table.keys), np.float32)
        at = self.table.add(gram)
        self.score[at[at >= 0]] = score[at >= 0]
        by = np.flatnonzero(at < 0)[np.argsort(gram[at < 0])]
        self.gram, self.rest = gram[by], score[by]

    def of(self, gram: np.ndarray) -> np.ndarray:
        at = self.table.find(gram)
        out = self.score[at].astype(np.float64)
        if len(lost := np.flatnonzero(at < 0)):
            out[lost] = self.rest[np.searchsorted(self.gram, gram[lost])]
        return out


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte of each whole text.

    Training texts are those whose crc32(id as text) mod 7 is not 2 (a null id trains). A-Z is lowered; tokens are words
    `[^\\x20\\x09-\\x0D]+` and one end. base_score is the add-one unigram log10 probability of the tokens. score is the
    model's log10 probability of the same tokens written as bytes, each word and the end closed by a space: every bit is
    predicted from the exact counts of its contexts of 0 to 5 bytes in all training texts, mixed and refined; within each
    text this and the short contexts' prediction are weighed online (see Online). A text's score depends on it and the
    training texts alone: neither on its neighbours nor on the number of partitions. Null and empty texts are one end
    token. Rows that repeat count and score each time. Without training texts all counts are 0. Only the id and the text
    are read; one row per input row, so none for an empty table.
    """
    rows = rows_of(docs, id_col, text_col)
    total = text_bytes(docs, text_col)
    parts, cells = parts_for(docs.sparkSession, total, CHUNK_BYTES), max(1, -(-total // CELL_BYTES))
    counts = gather(rows, parts, cells)
    ends = rows.where("not held").count()
    number = lambda at: F.coalesce(F.sum(F.conv(F.hex(F.substring("b", at, 8)), 16, 10).cast("long")), F.lit(0))
    sums = counts.where("kind = 'sums'").agg(number(1), number(9)).first()
    n, v = sums[0] + ends, sums[1] + (ends > 0)
    n_grams = counts.where("kind = 'grams'").agg(F.sum(F.length("a"))).first()[0] or 0
    mixer = build(counts, n_grams // 6, cells)
    lows = mixer.lows

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, told, scores, short = {}, [], None, None
        for batch in batches:
            ask = batch.column("a").is_valid().to_numpy(zero_copy_only=False)
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                if a is not None and a[:1] == b" ":
                    told.append((turned_back(of_planes(a[1:], 6)), np.frombuffer(b, "<f4")))
                elif a is not None:
                    known.update(zip(a.split(b" "), np.frombuffer(b, "<i8").tolist(), strict=True))
            batch = batch.filter(pa.array(~ask))
            if not batch.num_rows:
                continue
            if scores is None:
                scores, told = Scores(np.concatenate([x[0] for x in told]), np.concatenate([x[1] for x in told])), []
                short = ShortScores(lows.value)
            texts, tokens, have, base = utf8(batch, "body"), [], [], []
            lead = -math.log10(n + v + 1)
            names, index, offsets, joined = words_in(texts)
            times = np.fromiter(map(known.get, names, repeat(0)), np.int64, len(names))[index]
            written = [written_out(x) for x in joined]
            for a, z in pairwise(offsets.tolist()):
                c = times[a:z]
                tokens.append(len(c) + 1)
                have.append(int((c > 0).sum()) + (ends > 0))
                base.append(float(np.log10(c + 1.0).sum()) + math.log10(ends + 1) + tokens[-1] * lead)
            total, online = np.zeros(len(texts)), Online()
            for gram, of in slices(written):
                log10 = online.scores(of, scores.of(gram), short.of(gram))
                total += np.bincount(of, np.rint(log10 / UNIT), len(texts))
            total *= UNIT
            sizes = np.array(list(map(len, written)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held"), pa.array(tokens, pa.int64()), pa.array(have, pa.int64()), pa.array([n] * len(texts), pa.int64()), pa.array(base, pa.float64()), pa.array(total), pa.array(sizes, pa.int64()), pa.array(-total / math.log10(2) / sizes)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"],
            )

    replies = counts.where("kind = 'words'").select("chunk", "a", "b").unionByName(scored(counts, mixer, parts).select("chunk", "a", "b"))
    out = answered(rows, replies, parts, "id", "body")
    return mapped(out, score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double")
