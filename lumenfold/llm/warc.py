"""WARC archives of pages, and capture histories by an external merge of locally sorted index runs."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, parts_for, shared_dir, stored

RECORD_END, HTTP_HEAD = "\r\n\r\n", "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Records of one archive file at most, so of one index run; records of one range of the merge, about.
FILE_RECORDS, RANGE_RECORDS = 5_000, 50_000
FIELDS = {
    "url_key": pa.string(), "captured": pa.string(), "page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(),
    "payload_bytes": pa.int64(), "payload_digest": pa.string(), "archive": pa.string(), "position": pa.int64(), "length": pa.int64(), "run": pa.string(), "seq": pa.int64(),
}
SCHEMA = "url_key string, captured string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, position long, length long, run string, seq long"


def base32_of_hex(hexed: Column) -> Column:
    """Bare upper-case base32 of 40 hex digits: each five digits are four symbols of five bits."""
    letters, out = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), []
    for at in range(1, 41, 5):
        bits = F.conv(F.substring(hexed, at, 5), 16, 10).cast("int")
        out += [F.substr(letters, F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*out)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """One WARC record for each row of pages, in files of at most FILE_RECORDS under `path`.

    Of records with equal payloads of at least `min_bytes` bytes the one with the largest page_id is a response; the
    others are revisit records that refer to it and hold no payload. Smaller payloads are all responses. Null html is
    an empty payload. Rows repeated with the page_id of a response are responses too; a null page_id is below all others
    and written as `none`. The capture time is the page_id in seconds from 2024-01-01.

    Only (page_id, digest) is grouped, and the groups are a table of their own, so that Spark can split the join of a digest
    that very many pages share; payloads are joined by page_id, so such a payload moves once.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\r\n]", "").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumns({"n": F.octet_length("html").cast("long"), "sha": F.sha1("html")})
    keys = stored(rows.select("page_id", "url", "n", "sha"), "payload-keys")
    first = stored(keys.where(F.col("n") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("response_id")), "responses")
    revisits = keys.where(F.col("n") >= min_bytes).join(first, "sha").where("not (page_id <=> response_id)").withColumn("html", F.lit(""))
    responses = rows.where(F.col("n") < min_bytes).withColumn("response_id", F.lit(None).cast("long"))
    responses = responses.unionByName(rows.where(F.col("n") >= min_bytes).join(first.withColumnRenamed("sha", "top_sha"), F.col("page_id").eqNullSafe(F.col("response_id")) & (F.col("sha") == F.col("top_sha"))).drop("top_sha").withColumn("response_id", F.lit(None).cast("long")))
    every = responses.withColumn("kind", F.lit("response")).unionByName(revisits.select(*rows.columns, "response_id").withColumn("kind", F.lit("revisit")))
    name = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    block = F.concat(F.lit(HTTP_HEAD), "html")
    when = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), "kind", F.lit("\r\nWARC-Record-ID: <urn:page:"), name(F.col("page_id")), F.lit(">\r\nWARC-Date: "), when,
        F.lit("\r\nWARC-Target-URI: "), "url", F.lit("\r\nWARC-Payload-Digest: sha1:"), base32_of_hex(F.col("sha")), F.lit("\r\nPayload-Length: "), F.col("n").cast("string"),
        F.when(F.col("kind") == "revisit", F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), name(F.col("response_id")), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(RECORD_END),
    )
    every.select(F.concat(head, block).alias("value")).write.option("maxRecordsPerFile", FILE_RECORDS).text(path, compression="gzip", lineSep=RECORD_END)


def surt(url: str) -> str:
    """URL key: host labels reversed, then path and query; scheme, port 80 or 443 and `www.` dropped, lower case."""
    try:
        parts = urlsplit(url.strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.lower()
    labels = ",".join(reversed(host.removeprefix("www.").split("."))) if host else ""
    return f"{labels}{f':{port}' if port not in (None, 80, 443) else ''}){parts.path or '/'}{f'?{parts.query}' if parts.query else ''}"


class Records:
    """The records of one uncompressed archive, led by Content-Length alone. It is fed with the archive cut at blank lines
    (payloads may have some too, so these are no borders of records) and holds no more than the record that is being read."""

    def __init__(self, name: str):
        self.name, self.at, self.parts, self.have, self.head = name, 0, [], 0, None

    def feed(self, piece: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
        """(position, length, headers, block) of each record that ends with the piece and the blank line after it."""
        end = RECORD_END.encode()
        self.parts += [piece, end]
        self.have += len(piece) + len(end)
        while self.head is not None or self.have > len(end):
            if self.head is None:
                data = b"".join(self.parts)
                lines, found, rest = data.partition(end)
                first, *lines = lines.decode(errors="replace").split("\r\n")
                if not first.startswith("WARC/"):
                    raise ValueError(f"{self.name}: no WARC record at byte {self.at}")
                if not found:
                    return
                self.head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
                self.lead, self.parts, self.have = len(data) - len(rest), [rest], len(rest)
            size = int(self.head["Content-Length"])
            if self.have < size + len(end):
                return
            data = b"".join(self.parts)
            if data[size : size + len(end)] != end:
                raise ValueError(f"{self.name}: the record at byte {self.at} has a wrong length")
            length = self.lead + size + len(end)
            yield self.at, length, self.head, data[:size]
            self.at, self.head, self.parts, self.have = self.at + length, None, [data[size + len(end) :]], self.have - size - len(end)

    def close(self) -> None:
        """After the last piece, whose blank line is not always there."""
        if self.head is not None or b"".join(self.parts).strip(b"\r\n"):
            raise ValueError(f"{self.name}: the record at byte {self.at} is cut off")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Index runs: the records of each archive file, checked against their digests, sorted by URL key, time and page_id.

    Files are read as streams: a worker holds one record and the index of one file."""
    page = lambda x: None if (m := re.search(r"page:(-?\d+)", x)) is None else int(m[1])

    def entry(name: str, at: int, length: int, head: dict[str, str], block: bytes) -> tuple:
        kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
        size = int(head["Payload-Length"])
        if kind == "response":
            payload = memoryview(block)[block.index(b"\r\n\r\n") + 4 :]
            digest, size, said = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload), digest
            if said != digest:
                raise ValueError(f"{name}, byte {at}: the payload doesn't have its digest")
        url = head["WARC-Target-URI"]
        return surt(url), head["WARC-Date"], page(head["WARC-Record-ID"]), url, kind, page(head.get("WARC-Refers-To", "")), size, digest, name, at, length

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, rows = None, []

        def run() -> Iterator[pa.RecordBatch]:
            if reader is not None:
                reader.close()
                rows.sort(key=order)
                for at in range(0, len(rows), 5000):
                    some = [(*x, reader.name, at + i) for i, x in enumerate(rows[at : at + 5000])]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some), FIELDS.values(), strict=True)], names=list(FIELDS))
                rows.clear()

        for batch in batches:
            pieces = batch.column("value").cast(pa.binary())
            for k, name in enumerate(batch.column("path").to_pylist()):
                if reader is None or name != reader.name:
                    yield from run()
                    reader = Records(name)
                rows += [entry(name, *x) for x in reader.feed(pieces[k].as_py())]
        yield from run()

    lines = spark.read.option("pathGlobFilter", "part-*").option("lineSep", RECORD_END).text(path)
    return stored(mapped(lines.select(F.col("_metadata.file_path").alias("path"), "value"), index, SCHEMA), "index-runs")


def order(row: tuple) -> tuple:
    return row[0], row[1], -1 if row[2] is None else row[2], row[8], row[9]


def loser_tree(runs: list[list[tuple]]) -> Iterable[tuple]:
    """Merge sorted runs of (key, value). Inner nodes hold the loser of their match, so a pop replays one path of log k
    matches."""
    k = len(runs)
    if not k:
        return
    at, last = [0] * k, (2,)
    key = lambda i: (1, runs[i][at[i]][0], i) if at[i] < len(runs[i]) else last
    keys, tree = [key(i) for i in range(k)], [0] * k

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        win, lose = (a, b) if keys[a] <= keys[b] else (b, a)
        tree[node] = lose
        return win

    win = play(1) if k > 1 else 0
    while keys[win] != last:
        yield runs[win][at[win]][1]
        at[win] += 1
        keys[win] = key(win)
        node = (win + k) // 2
        while node:
            if keys[tree[node]] < keys[win]:
                tree[node], win = win, tree[node]
            node //= 2


def merge_runs(runs: DataFrame) -> DataFrame:
    """Globally ordered captures: partition n holds keys below those of partition n+1, each merged from its parts of all
    runs. Ranges are of (URL key, time, page_id, place), so one hot URL is split too, and there are so many of them that
    each has about RANGE_RECORDS records, which is what a worker holds."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts.setdefault(row[11], []).append((order(row), row))
        for part in parts.values():
            if any(a[0] > b[0] for a, b in zip(part, part[1:])):  # blocks of one run may arrive in another order
                part.sort(key=lambda x: x[1][12])
        out = []
        for row in loser_tree(list(parts.values())):
            out.append(row)
            if len(out) == 5000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), FIELDS.values(), strict=True)], names=list(FIELDS))
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), FIELDS.values(), strict=True)], names=list(FIELDS))

    parts = parts_for(runs.sparkSession, runs.count(), RANGE_RECORDS)
    return mapped(runs.repartitionByRange(parts, "url_key", "captured", "page_id", "archive", "position"), merge, SCHEMA)


def capture_histories(pages: DataFrame, path: str | None = None, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages as WARC archives under `path` (default: a new folder in the shared one), read them back, and merge
    their index runs: one row per record, ordered by URL key and time. An empty table gives no rows."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, min_bytes, id_col, url_col, html_col)
    return merge_runs(read_runs(spark, path)).drop("run", "seq")
