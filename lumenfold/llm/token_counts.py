"""Token counts by a linear longest-match automaton: a vocabulary trie with failure links and popped-token counts."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, mapped, utf8

#: Words whose counts one worker remembers.
CACHE_ENTRIES = 500_000
FIELDS = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_tokens": pa.int64()}


class Automaton:
    """Greedy longest-match-first cutting of a word, counted in one pass.

    Trie states hold prefixes of pieces. When no edge fits, the failure link goes to the state of what remains once the
    greedy cutter has popped its pieces off the state's string; `pops` is how many it popped. So each byte is read once
    and each failure pays for pieces that are counted, never built.
    """

    def __init__(self, pieces: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}]
        self.final = [False]
        for piece in pieces:
            at = 0
            for x in piece:
                to = self.next[at].get(x)
                if to is None:
                    to = self.next[at][x] = len(self.next)
                    self.next.append({})
                    self.final.append(False)
                at = to
            self.final[at] = at != 0
        n = len(self.next)
        self.fail, self.pops = [-1] * n, [0] * n
        queue = deque([0])
        while queue:
            at = queue.popleft()
            for x, to in self.next[at].items():
                queue.append(to)
                if self.final[to]:
                    self.fail[to], self.pops[to] = 0, 1
                    continue
                back, popped = self.fail[at], self.pops[at]
                while back >= 0 and x not in self.next[back]:
                    popped += self.pops[back]
                    back = self.fail[back]
                if back >= 0:
                    self.fail[to], self.pops[to] = self.next[back][x], popped

    def count(self, word: bytes) -> int:
        """Pieces of a word; a word that the vocabulary can't spell is one unknown token; an empty word has none."""
        at, total, step, fail, pops = 0, 0, self.next, self.fail, self.pops
        for x in word:
            to = step[at].get(x)
            while to is None:
                total += pops[at]
                at = fail[at]
                if at < 0 or (at == 0 and x not in step[0]):
                    return 1
                to = step[at].get(x)
            at = to
        while at > 0:
            total += pops[at]
            at = fail[at]
        return total if at == 0 else 1


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins for bytes that byte-level vocabularies use: printable Latin-1 stands for itself, the rest
    for code points from 256 on."""
    plain = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255]
    rest = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(rest)}


def vocabulary(path: str, word_end: str = "</w>") -> list[bytes]:
    """Pieces of a byte-level vocabulary file; the mark of a word's end is the byte 0x20, which no word holds."""
    symbols, pieces = byte_symbols(), []
    for piece in json.load(open(path))["model"]["vocab"]:
        body, end = (piece[: -len(word_end)], b" ") if piece.endswith(word_end) else (piece, b"")
        if body and all(x in symbols for x in body):
            pieces.append(bytes(symbols[x] for x in body) + end)
    return pieces


def token_counts(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens: greedy word-piece lengths of every whole text.

    Words are runs without ASCII white space, A-Z lowered, each followed by the end mark. Null and empty texts have no
    words and no tokens. One row per input row, whatever its doc_id (none for an
    empty table); other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, known = Automaton(vocabulary(vocab_path)).count, {}
        for batch in batches:
            words, tokens = [], []
            for text in utf8(batch, "body"):
                of = text.lower().split()
                new = {x for x in of if x not in known}
                if len(known) + len(new) > CACHE_ENTRIES:
                    known.clear()
                    new = set(of)
                for x in new:
                    known[x] = count(x + b" ")
                words.append(len(of))
                tokens.append(sum(map(known.__getitem__, of)))
            yield arrow(FIELDS, {"doc_id": batch.column("id"), "n_words": words, "n_tokens": tokens})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    return mapped(rows, run, "doc_id long, n_words long, n_tokens long")
