"""Text functions as columns: normalising, fingerprints, SimHash, similarity, masking, labels."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rules


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def folded(s: str) -> str:
    """Compatibility form and case folding of one text."""
    return unicodedata.normalize("NFKC", s).casefold()


@F.pandas_udf(T.StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.map(folded, na_action="ignore")


#: White space as str.split() has it: Java's own class lacks the four ASCII separators.
SPACES = r"(?U)[\s\x1c-\x1f]+"


def ascii_only(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def squeeze(c: Column) -> Column:
    """Zero-width marks dropped, white space (of any script, and the four separators U+001C to U+001F) to single spaces,
    ends trimmed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[​﻿]", ""), SPACES, " "), "^ | $", "")


def normalize_content(c: Column, nfkc: bool = True) -> Column:
    """Compatibility form, then squeeze(); null is empty. `nfkc=False` for text known to be in that form: no Python."""
    c = F.coalesce(c, F.lit(""))
    return squeeze(_nfkc(c)) if nfkc else squeeze(c)


def with_normal(df: DataFrame, source: str, target: str) -> DataFrame:
    """normalize_content() as a column, with Python for the rows that are not plain ASCII only."""
    plain = ascii_only(F.coalesce(F.col(source), F.lit("")))
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(source), F.lit("")), r"[\s\x1c-\x1f]+", " "), "^ | $", "")  # squeeze() of plain ASCII
    a = df.where(plain).withColumn(target, bare)
    return a.unionByName(df.where(~plain).withColumn(target, normalize_content(F.col(source))))


def content_fingerprint(c: Column, nfkc: bool = True) -> Column:
    return F.sha2(normalize_content(c, nfkc), 256)


def fold_text(c: Column) -> Column:
    """Compatibility form and case folding, for keyword topics."""
    return _folded(F.coalesce(c, F.lit("")))


def bigrams(c: Column) -> Column:
    """Adjacent pairs of characters, in order; none for fewer than two."""
    return F.when(F.length(c) >= 2, F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substr(c, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def simhash_tokens(normal: Column) -> Column:
    """ASCII words of the lowered text, and pairs of its CJK characters with all else left out."""
    low = F.lower(normal)
    return F.concat(F.regexp_extract_all(low, F.lit("([A-Za-z0-9_]+)"), F.lit(1)), bigrams(F.regexp_replace(low, r"[^\x{4e00}-\x{9fff}]", "")))


def token_hash(token: Column) -> Column:
    """The first eight bytes of MD5 as a signed long."""
    md = F.md5(token)
    half = lambda at: F.conv(F.substring(md, at, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def simhash_native(df: DataFrame, key: str, normal: str) -> DataFrame:
    """key, simhash: majority vote of each bit over all token occurrences, with built-in functions alone. No tokens: 0. Ones are
    counted, two bits in the halves of a long, before the shuffle, which gets a row of counts for each text of a task."""
    hashed = df.select(F.col(key), F.explode(simhash_tokens(F.col(normal))).alias("token")).select(key, token_hash(F.col("token")).alias("h"))
    both = lambda k: F.shiftrightunsigned("h", k).bitwiseAND(F.lit((1 << 32) + 1))
    bits = hashed.groupBy(key).agg(F.count("*").alias("n"), *[F.sum(both(k)).alias(f"b{k}") for k in range(32)])
    value = F.lit(0).cast("long")
    for k in range(64):
        ones = F.shiftrightunsigned(f"b{k - 32}", 32) if k >= 32 else F.col(f"b{k}").bitwiseAND(F.lit((1 << 32) - 1))
        value = value.bitwiseOR(F.when(2 * ones > F.col("n"), F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))
    return df.select(key).join(bits.select(key, value.alias("simhash")), key, "left").select(key, F.coalesce("simhash", F.lit(0).cast("long")).alias("simhash"))


def simhash_of(tokens) -> int:  # noqa: ANN001
    """The same from a list of tokens."""
    import hashlib

    counts = Counter(tokens)
    if not counts:
        return 0
    digests = np.frombuffer(b"".join(hashlib.md5(t.encode()).digest()[:8] for t in counts), np.uint8).reshape(-1, 8)
    votes = (np.unpackbits(digests, axis=1).astype(np.int64) * 2 - 1).T @ np.fromiter(counts.values(), np.int64, len(counts))
    return int(np.packbits(votes > 0).view(">i8")[0])


#: Tokens whose bits a worker remembers, at most.
REMEMBERED = 200_000
CJK = re.compile(r"[\u4e00-\u9fff]+")
#: What is no ASCII letter, digit or underscore becomes a space.
WORD_BYTES = bytes(c if chr(c).isalnum() and c < 128 or c == 95 else 32 for c in range(256))


class TokenBits:
    """The bits of tokens' hashes as rows of +1 and -1, each token (in bytes) hashed once while it is remembered."""

    def __init__(self) -> None:
        self.index: dict[bytes, int] = {}
        self.rows = np.zeros((1024, 64), np.int8)

    def of(self, tokens) -> np.ndarray:  # noqa: ANN001
        index = self.index
        if len(index) + len(tokens) > REMEMBERED:
            index.clear()
        found = [index.get(t) for t in tokens]
        if None in found:
            import hashlib

            new = [t for t, k in zip(tokens, found, strict=True) if k is None]
            digests = np.frombuffer(b"".join([hashlib.md5(t).digest()[:8] for t in new]), np.uint8).reshape(-1, 8)
            at = len(index)
            if at + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows[:at], np.zeros((at + 2 * len(new), 64), np.int8)])
            self.rows[at : at + len(new)] = np.unpackbits(digests, axis=1).astype(np.int8) * 2 - 1
            index.update(zip(new, range(at, at + len(new)), strict=True))
            found = [index[t] for t in tokens]
        return self.rows.take(found, 0)


def simhash_of_text(low: str | None, bits: TokenBits) -> int:
    """simhash_of() the tokens of a lowered text, as simhash_tokens() has them."""
    if not low:
        return 0
    counts = Counter(low.encode("ascii", "replace").translate(WORD_BYTES).split())
    if not low.isascii() and len(cjk := "".join(CJK.findall(low))) > 1:
        counts.update((x + y).encode() for x, y in zip(cjk, cjk[1:], strict=False))
    if not counts:
        return 0
    votes = np.fromiter(counts.values(), np.float64, len(counts)) @ bits.of(counts).astype(np.float64)
    return int(np.packbits(votes > 0).view(">i8")[0])


@F.pandas_udf(T.LongType())
def _simhash(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    bits = TokenBits()
    for low in parts:
        yield low.map(lambda x: simhash_of_text(x, bits))


def simhash(normal: Column) -> Column:
    """SimHash in Arrow batches: no shuffle, and only the text itself goes to Python."""
    return _simhash(F.lower(normal))


def normal_of(s: str) -> str:
    """normalize_content() of one text."""
    if not s.isascii():
        s = unicodedata.normalize("NFKC", s).replace("\u200b", "").replace("\ufeff", "")
    return " ".join(s.split())


@F.pandas_udf(T.StructType([T.StructField("content_hash", T.StringType()), T.StructField("simhash", T.LongType())]))
def _prints(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    import hashlib

    bits = TokenBits()
    for texts in parts:
        normal = [normal_of(x) if x else "" for x in texts]
        yield pd.DataFrame({"content_hash": [hashlib.sha256(x.encode()).hexdigest() for x in normal], "simhash": np.array([simhash_of_text(x.lower(), bits) for x in normal], np.int64)})


def fingerprint(c: Column) -> Column:
    """struct(content_hash, simhash) of the normal form, in one Python step: the text goes there once, and only two numbers
    come back."""
    return _prints(c)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def simhash_similarity(a: Column, b: Column) -> Column:
    return F.lit(1.0) - hamming(a, b) / F.lit(64.0)


def summarize(c: Column, most: int = 200) -> Column:
    flat = squeeze(F.coalesce(c, F.lit("")))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, most), r"(?U)[\s\x1c-\x1f]+$", ""), F.lit("…")))


def hash_token(c: Column) -> Column:
    return F.sha2(c, 256)


def mask_email(c: Column) -> Column:
    """First two characters of the name, stars for the rest (one at least), then the domain."""
    name = F.substring_index(c, "@", 1)
    domain = F.substr(c, F.length(name) + 2)
    return F.when(c.contains("@"), F.concat(F.substring(name, 1, 2), F.repeat(F.lit("*"), F.greatest(F.length(name) - 2, F.lit(1))), F.lit("@"), domain)).otherwise("***")


def normalize_email(c: Column) -> Column:
    """Trimmed and lowered; null where it is not an address."""
    flat = F.lower(F.trim(c))
    return F.when(flat.rlike(rules.EMAIL_PATTERN), flat)


def title_quality(c: Column, penalties: tuple[str, ...] = rules.TITLE_PENALTIES) -> Column:
    flat = F.trim(F.coalesce(c, F.lit("")))
    bad = contains_any(F.lower(flat), penalties)
    return F.length(flat) - F.when(bad, 100).otherwise(0)


def contains_any(haystack: Column, needles: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for needle in needles:
        out = out | haystack.contains(needle)
    return out


def keyword_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of sets of character pairs of lowered text without white space; shorter text is its own set."""
    flat = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), SPACES, "")
    of = lambda c: F.when(F.length(c) >= 2, F.array_distinct(bigrams(c))).otherwise(F.array(c))
    x, y = of(flat(a)), of(flat(b))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def point_text(name: Column, summary: Column, claims: Column) -> Column:
    joined = F.array_join(F.concat(F.array(name, summary), claims), "\n")
    return F.regexp_replace(joined, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def article_fingerprint(content_hash: Column, title: Column, content: Column) -> Column:
    return F.coalesce(content_hash, F.sha2(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(content, F.lit(""))), 256))


def parse_bool(c: Column) -> Column:
    return F.lower(F.trim(c)).isin("1", "true", "yes", "on")


def near_evidence(similarity: Column, threshold: float) -> Column:
    return F.format_string(rules.NEAR_EVIDENCE, F.bround(similarity, 3), F.lit(threshold))


def related_evidence(similarity: Column, threshold: float) -> Column:
    """Similarities are 64ths, so ties at the third place are exact; they go to the even digit."""
    return F.format_string(rules.RELATED_EVIDENCE, F.bround(similarity, 3), F.lit(threshold))


def describe_topic(kind: Column, value: Column, source_name: Column | None = None) -> Column:
    shown = value if source_name is None else F.when(kind == "source", F.coalesce(source_name, value)).otherwise(value)
    label = F.create_map(*[F.lit(x) for pair in rules.TOPIC_LABELS.items() for x in pair])
    return F.concat(F.element_at(label, kind), shown)


def published_label(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm"), F.lit(rules.UNKNOWN_TIME))


def link(base: Column, path: str, token: Column) -> Column:
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit(path), token)


def client_ip(forwarded: Column) -> Column:
    return F.trim(F.element_at(F.split(forwarded, ","), 1))


def clean_array(c: Column) -> Column:
    """Items trimmed, blank ones dropped."""
    return F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "")
