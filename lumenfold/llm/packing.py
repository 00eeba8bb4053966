"""Packing by power-of-two decomposition: every sequence is a piece of one document, its length a power of two."""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Callable, Iterator
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, stored, utf8

FIELDS = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "bucket": pa.int32(), "part": pa.int64(), "row": pa.int64()}
#: Bytes of memory for the ids of runs that one worker remembers, about; bytes of text, and runs, that are encoded at once.
CACHE_BYTES, TOGETHER_BYTES, TOGETHER = 192 << 20, 6 << 20, 512
#: Python's own bytes for a byte string, a number and their place in a dictionary.
ENTRY_BYTES = 160
SIGNS = bytes(x for x in range(33, 127) if not chr(x).isalnum())


def binary_pieces(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of n tokens cut into pieces of `longest` (a power of two) and then the binary digits of the rest."""
    whole = n // longest * longest
    out = [(at, longest) for at in range(0, whole, longest)]
    at, size = whole, longest >> 1
    while size:
        if n - whole & size:
            out.append((at, size))
            at += size
        size >>= 1
    return out


class Ids:
    """Runs and their ids: a number for each run, and where its ids stand in one array."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {b"": 0}
        self.flat, self.ends, self.size = np.zeros(0, "<u4"), np.zeros(1, np.int64), 0

    def of(self, k: int) -> bytes:
        return self.flat[self.ends[k - 1] if k else 0 : self.ends[k]].tobytes()

    def add(self, runs: list[bytes], ids: list[bytes]) -> None:
        self.number.update(zip(runs, range(len(self.ends), len(self.ends) + len(runs)), strict=True))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), "<u4")])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes) // 4])
        self.size += int(sizes.sum()) + sum(map(len, runs)) + ENTRY_BYTES * len(runs)


class Memory:
    """Ids of runs in two generations: when the young one is full it becomes the old one, and whatever recurs is taken over
    from there. So what is frequent stays, and the bytes are bounded."""

    def __init__(self) -> None:
        self.young, self.old = Ids(), Ids()

    def room(self) -> None:
        if self.young.size > CACHE_BYTES // 2:
            self.young, self.old = Ids(), self.young

    def get(self, run: bytes) -> bytes | None:
        for of in (self.young, self.old):
            if (k := of.number.get(run)) is not None:
                return of.of(k)
        return None


#: What this worker has encoded, by tokenizer file; kept from task to task.
_KNOWN: dict[str, Memory] = {}


def cut_signs(run: bytes) -> tuple[bytes, bytes, bytes]:
    """(signs before, the rest, signs after) of a run that are words of their own; signs are ASCII. They are where a letter or
    digit stands beside them. One apostrophe alone before a letter may begin a contraction, so it stays."""
    rest = run.rstrip(SIGNS)
    end = len(rest)
    start = end - len(rest.lstrip(SIGNS))
    if not end or (not start and end == len(run)) or b"<|" in run:
        return b"", run, b""
    # What is left begins and ends with a letter, a digit or something beyond ASCII.
    if start and (run[:start] == b"'" or (rest[start] > 127 and not unicodedata.normalize("NFC", rest[start:].decode()[0]).lower()[0].isalnum())):
        start = 0
    if rest[-1] > 127 and not unicodedata.normalize("NFC", rest.decode()[-1]).lower()[-1].isalnum():
        end = len(run)
    return run[:start], run[start:end], run[end:]


def chunk_encoder(path: str) -> Callable[[list[bytes]], Iterator[bytes]]:
    """Encode texts as little-endian 32-bit ids, each run without white space once.

    Valid for a lower-casing tokenizer that splits at white space, drops it, and keeps letters, digits and signs in
    separate words: then a run has the same ids wherever it stands, A-Z can be lowered first (not where `<|` may begin a
    special token), and signs beside a letter or digit can be encoded apart. Runs of letters alone are encoded many in a text,
    whose ids are told apart by the mark that ends each word; texts with another number of marks are encoded run by run."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    ends = np.zeros(tokenizer.get_vocab_size() + 1, bool)
    if suffix:
        ends[[k for x, k in tokenizer.get_vocab().items() if x.endswith(suffix)]] = True
    if path not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[path] = Memory()
    memory = _KNOWN[path]

    def one_by_one(runs: list[bytes]) -> Iterator[bytes]:
        for got in tokenizer.encode_batch_fast([x.decode() for x in runs], add_special_tokens=False):
            yield np.array(got.ids, "<u4").tobytes()

    def joined(runs: list[bytes]) -> Iterator[bytes]:
        groups = [runs[k : k + TOGETHER] for k in range(0, len(runs), TOGETHER)]
        for group, got in zip(groups, tokenizer.encode_batch_fast([b" ".join(x).decode() for x in groups], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, "<u4")
            stops = (np.flatnonzero(ends[ids]) + 1) * 4
            if len(stops) != len(group) or stops[-1] != 4 * len(ids):
                yield from one_by_one(group)
                continue
            data, stops = ids.tobytes(), stops.tolist()
            yield from map(data.__getitem__, map(slice, [0, *stops[:-1]], stops))

    def learn(new: list[bytes]) -> None:
        """Give these runs their ids: from the old generation, else from their parts."""
        old, found, cut = memory.old, {}, {}
        if old.number.keys() > {b""}:
            for x in new:
                if (k := old.number.get(x)) is not None:
                    found[x] = old.of(k)
            new = [x for x in new if x not in found]
        runs = pa.array(new, pa.binary()).cast(pa.string())
        bare = pc.ascii_trim(runs, SIGNS.decode())
        same = pc.equal(pc.binary_length(bare), pc.binary_length(runs)).to_numpy(zero_copy_only=False)
        alone = [new[k] for k in np.flatnonzero(same).tolist()]
        for k in np.flatnonzero(~same).tolist():
            cut[new[k]] = cut_signs(new[k])
        parts = {y for of in cut.values() for y in of if y}
        parts.difference_update(found, alone)
        words, odd = [], []
        for x in parts:
            if x not in cut and (ids := memory.get(x)) is not None:
                found[x] = ids
            else:
                alone.append(x)
        for x in alone:
            (words if suffix and x.decode().isalpha() else odd).append(x)
        found.update(zip(words, joined(words), strict=True))
        found.update(zip(odd, one_by_one(odd), strict=True))
        for x, (before, rest, after) in cut.items():
            if rest is not x:
                found[x] = found.get(before, b"") + found[rest] + found.get(after, b"")
        fresh = [x for x in found if x not in memory.young.number]
        memory.young.add(fresh, [found[x] for x in fresh])

    def encode(texts: list[bytes]) -> Iterator[bytes]:
        memory.room()
        body = pa.array(texts, pa.binary()).cast(pa.string())
        body = pc.if_else(pc.match_substring(body, "<|"), body, pc.ascii_lower(body))
        split = pc.ascii_split_whitespace(body)  # as bytes.split(), but for empty runs at either end
        runs = split.flatten().dictionary_encode()
        names = runs.dictionary.cast(pa.binary()).to_pylist()
        known = memory.young.number
        number = np.fromiter(map(known.get, names, repeat(-1)), np.int32, len(names))
        new = np.flatnonzero(number < 0)
        learn([names[k] for k in new.tolist()])
        number[new] = [known[names[k]] for k in new.tolist()]
        lists = pa.LargeListArray.from_arrays(np.append(0, memory.young.ends), memory.young.flat)
        picked = lists.take(pa.array(number).take(runs.indices))
        cuts = picked.offsets.to_numpy()[split.offsets.to_numpy() - split.offsets[0].as_py()]
        ids = picked.values.to_numpy()
        for a, z in pairwise(cuts.tolist()):
            yield ids[a:z].tobytes()

    return encode


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined until they have TOGETHER_BYTES, so that fewer runs have to be looked up again and again."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size > TOGETHER_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def cut_documents(docs: DataFrame, tokenizer_path: str, longest: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document before they get sequence ids: doc_id, start, length, ids_crc32, doc_tokens, bucket."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, row = chunk_encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in together(batches):
            out = {k: [] for k in FIELDS}
            for doc, ids in zip(batch.column("id").to_pylist(), encode(utf8(batch, "body")), strict=True):
                ids += end
                n = len(ids) // 4
                for start, length in binary_pieces(n, longest):
                    for k, v in zip(FIELDS, (doc, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]), n, length.bit_length() - 1, part, row), strict=True):
                        out[k].append(v)
                    row += 1
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in FIELDS.items()], names=list(FIELDS))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    return mapped(rows, cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int, part long, row long")


def pack(docs: DataFrame, tokenizer_path: str, longest: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack documents into sequences of a power of two of at most `longest` tokens; no sequence crosses documents.

    Each document (null text: empty) is its ids and `end_id`, so an empty one is a single token. It is cut into pieces of
    `longest` and, for the rest, the powers of two in its length: no padding at all. Pieces of one length share a bucket,
    and buckets take consecutive ranges of sequence ids, so that batches of one length are ranges of ids. One row per
    piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (always 0), bucket. Rows with the same or no
    doc_id are packed each on its own. Other columns are not read. An empty table gives no rows.
    """
    if longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    pieces = stored(cut_documents(docs, tokenizer_path, longest, end_id, id_col, text_col), "pieces")
    # A few numbers for each task and bucket: where its ids begin.
    counts = pieces.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    each = counts.groupBy("bucket").agg(F.sum("n").alias("total"))
    first = each.alias("a").join(each.alias("b"), F.col("a.bucket") > F.col("b.bucket"), "left").groupBy("a.bucket").agg(F.coalesce(F.sum("b.total"), F.lit(0)).alias("base"))
    within = counts.withColumn("before", F.sum("n").over(Window.partitionBy("bucket").orderBy("part")) - F.col("n")).join(F.broadcast(first), "bucket")
    starts = within.select("bucket", "part", (F.col("base") + F.col("before")).alias("id0"))
    numbered = pieces.withColumn("k", F.row_number().over(Window.partitionBy("part", "bucket").orderBy("row")))
    return numbered.join(starts, ["bucket", "part"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("id0") + F.col("k") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "bucket"
    )
