"""Language ID: script ranges narrow the candidates, then Viterbi over per-word scores labels spans."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped

#: Hash buckets of byte n-grams; with at most MOST_LANGS languages this bounds the model.
BUCKETS, MOST_LANGS = 1 << 16, 250
ORDERS = (2, 3, 4)
CACHE_ENTRIES = 300_000
# First and last code points of the scripts told apart; anything else with letters is "other".
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF),
    ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]
NAMES = [*dict.fromkeys(x[0] for x in SCRIPTS), "other"]
#: ASCII characters other than letters and white space; they carry no language.
NO_LETTERS = bytes(x for x in range(128) if not chr(x).isalpha() and chr(x) not in " \t\n\r\v\f")


def held_out(id_col: str | Column = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """crc32 of the id as text, modulo `parts`, is `part`; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")) % parts == part, F.lit(False))


def words_of(text: bytes) -> list[bytes]:
    return text.decode().lower().encode().translate(None, NO_LETTERS).split()


def script_of(word: bytes) -> int:
    """Index of the script of a word's first letter; -1 without a letter. Numbers like a half or a square are no letters."""
    if (letter := next(filter(str.isalpha, word.decode()), None)) is None:
        return -1
    x = ord(letter)
    return NAMES.index(next((name for name, low, high in SCRIPTS if low <= x <= high), "other"))


def ngrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of its word) of all byte n-grams of words framed by spaces, in one pass over one buffer."""
    buffer = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    spaces = np.cumsum(buffer == 32)
    found, owner = [], []
    h = buffer.astype(np.uint64)
    for n in range(2, max(ORDERS) + 1):
        if len(buffer) < n:
            break
        h = (h[: len(buffer) - n + 1] << np.uint64(8)) | buffer[n - 1 :]
        if n in ORDERS:
            inner = spaces[n - 2 : len(buffer) - 1] - spaces[: len(buffer) - n + 1] == 0 if n > 1 else True
            ok = np.flatnonzero(inner & ((buffer[: len(buffer) - n + 1] != 32) | (buffer[1 : len(buffer) - n + 2] != 32)))
            mixed = (h[ok] + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)
            found.append((mixed >> np.uint64(48)).astype(np.int64))
            owner.append(spaces[ok] - 1)
    return (np.concatenate(found), np.concatenate(owner)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", part: int = 2) -> dict:
    """The model, from all rows with a language that are not held out: log odds of n-gram buckets by language, and the
    languages seen in each script. Counts are summed in each task, then by Spark; the driver gets the bounded model. Rows
    without a language or a text teach nothing, repeated rows count each time, and from an empty table nothing is learned."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, Counter] = {}
        sums: dict[str, np.ndarray] = {}
        scripts: dict[str, Counter] = {}

        def flush(lang: str) -> None:
            words = list(by[lang])
            times = np.array([by[lang][x] for x in words], np.float64)
            for at in range(0, len(words), 100_000):
                buckets, owner = ngrams(words[at : at + 100_000])
                sums[lang] = sums.get(lang, 0) + np.bincount(buckets, times[at : at + 100_000][owner], BUCKETS)
            for word, n in by[lang].items():
                scripts.setdefault(lang, Counter())[script_of(word)] += n
            by[lang] = Counter()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("body").cast(pa.binary()).to_pylist(), strict=True):
                of = by.setdefault(lang, Counter())
                of.update(words_of(text))
                if len(of) > CACHE_ENTRIES:
                    flush(lang)
        for lang in by:
            flush(lang)
            keys = np.flatnonzero(sums.get(lang, np.zeros(0)))
            more = [(-2 - k, n) for k, n in scripts.get(lang, {}).items() if k >= 0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(keys) + len(more)), pa.string()), pa.array([*keys.tolist(), *(x[0] for x in more)], pa.int32()), pa.array([*(sums[lang][keys].astype(np.int64).tolist() if len(keys) else []), *(x[1] for x in more)], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    rows = docs.where(~held_out(id_col, part=part) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("body"))
    table = mapped(rows, count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = table.toArrow().to_pandas().sort_values(["lang", "bucket"])
    langs = sorted(got["lang"].unique())
    if len(langs) > MOST_LANGS:
        raise ValueError(f"{len(langs)} languages; the model is bounded for {MOST_LANGS}")
    counts, seen = np.zeros((BUCKETS, len(langs))), np.zeros((len(NAMES), len(langs)))
    of = got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64, na_value=0)
    b, n = got["bucket"].to_numpy(), got["n"].to_numpy()
    counts[b[b >= 0], of[b >= 0]] = n[b >= 0]
    seen[-2 - b[b < 0], of[b < 0]] = n[b < 0]
    logs = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * BUCKETS)) if langs else counts
    odds = (logs - logs.mean(1, keepdims=True)) / len(ORDERS) if langs else logs
    odds[counts.sum(1) == 0] = 0
    share = seen / np.maximum(seen.sum(0), 1)
    return {"langs": langs, "odds": odds.astype(np.float32), "scripts": share >= 0.001}


def label_words(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Viterbi: the best label of each word of each text, where a change of label costs `penalty`. scores: words x labels.

    All texts step together, longest first, so a step is one array operation over the texts that are as long.
    """
    by = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.array([len(scores[i]) for i in by], np.int64)
    paths: list[np.ndarray] = [np.zeros(0, np.int16)] * len(scores)
    if not len(by) or not lengths[0]:
        return paths
    labels, longest = scores[by[0]].shape[1], int(lengths[0])
    alive = np.searchsorted(-lengths, -np.arange(longest), side="left")
    starts = np.concatenate([[0], np.cumsum(alive)])
    flat = np.empty((starts[-1], labels), np.float32)
    for rank, i in enumerate(by):
        flat[starts[: lengths[rank]] + rank] = scores[i]
    stay, top = np.ones((starts[-1], labels), bool), np.zeros(starts[-1], np.int16)
    path, best = np.zeros(starts[-1], np.int16), flat[: alive[0]].copy()
    for t in range(longest):
        to = slice(starts[t], starts[t + 1])
        if t:
            best = best[: alive[t]]
            lead = best.argmax(1)
            other = best[np.arange(len(lead)), lead][:, None] - penalty
            stay[to], top[to] = best >= other, lead
            best = np.maximum(best, other) + flat[to]
            best -= best.max(1, keepdims=True)
        ends = alive[t + 1] if t + 1 < longest else 0
        path[starts[t] + ends : starts[t + 1]] = best[ends:].argmax(1)
    for t in range(longest - 1, 0, -1):
        at = np.arange(starts[t], starts[t + 1])
        now = path[at]
        path[starts[t - 1] : starts[t - 1] + len(at)] = np.where(stay[at, now], now, top[at])
    for rank, i in enumerate(by):
        paths[i] = path[starts[: lengths[rank]] + rank]
    return paths


#: Scores of words that this worker has met, by the model's key; kept from task to task.
_MET: dict[str, tuple[dict[bytes, int], list[np.ndarray]]] = {}


class Scorer:
    """Per-word scores: mean-free log odds summed over a word's n-grams; languages not seen in its script are ruled out."""

    def __init__(self, model: dict, key: str):
        self.odds, self.scripts, self.key = model["odds"], model["scripts"], key
        if key not in _MET:
            _MET.clear()
            _MET[key] = {}, []
        self.index, self.table = _MET[key][0], np.zeros((0, self.odds.shape[1]), np.float32)
        if _MET[key][1]:
            self.table = _MET[key][1][0]

    def ready(self, words: set[bytes]) -> None:
        new = [x for x in words if x not in self.index]
        if len(self.index) + len(new) > CACHE_ENTRIES:
            self.index.clear()
            self.table, new = self.table[:0], list(words)
        if not new:
            return
        buckets, owner = ngrams(new)
        rows = np.stack([np.bincount(owner, self.odds[buckets, k], len(new)) for k in range(self.odds.shape[1])], 1)
        for i, x in enumerate(new):
            script = script_of(x)
            if script < 0:
                rows[i] = 0
            elif self.scripts[script].any():
                rows[i, ~self.scripts[script]] -= 30
        at = len(self.table)
        self.index.update(zip(new, range(at, at + len(new)), strict=True))
        self.table = np.concatenate([self.table, rows.astype(np.float32)])
        _MET[self.key][1][:] = [self.table]

    def of(self, words: list[bytes]) -> np.ndarray:
        return self.table[np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))]


def identify(docs: DataFrame, model: dict, penalty: float = 8.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, n_words, spans: the language of each whole text and of its spans.

    Words are runs without white space, lowered, without ASCII digits and signs. Spans are (first word, last word,
    language), gapless. lang_pred is the language of most words and score its share of them. A null text, one without a
    letter, and any text under a model that learned nothing get `und`, 0 and no spans. Of languages with equally many words
    the first by name is taken. Only the text is read. One row per input row, whatever its doc_id; none for an empty table.
    """
    import uuid

    key, langs = uuid.uuid4().hex, model["langs"]
    span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model, key)
        for batch in batches:
            texts = batch.column("body").cast(pa.binary()).to_pylist()
            words = [words_of(x) if langs and x and any(map(str.isalpha, x.decode())) else [] for x in texts]
            scorer.ready({x for of in words for x in of})
            pred, score, spans = [], [], []
            for path in label_words([scorer.of(of) for of in words], penalty):
                if not len(path):
                    pred.append("und"), score.append(0.0), spans.append([])
                    continue
                sizes = np.bincount(path, minlength=len(langs))
                pred.append(langs[int(sizes.argmax())])
                score.append(float(sizes.max() / len(path)))
                cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
                spans.append([{"first": a, "last": b - 1, "lang": langs[path[a]]} for a, b in zip(cuts, cuts[1:])])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(list(map(len, words)), pa.int64()), pa.array(spans, span)], names=["doc_id", "lang_pred", "score", "n_words", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    return mapped(rows, run, "doc_id long, lang_pred string, score double, n_words long, spans array<struct<first:int,last:int,lang:string>>")
