"""Quality classifier from weak labels: EM over heuristic labellers, then a hashed linear scorer on their posterior.

Two questions are asked in this way of every text: is it well formed, and is it civil."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, smallest_hashes, stored, utf8
from .language_id import words_of

#: Buckets of the linear scorers; the default bound on the rows they are fitted on.
BUCKETS, FIT_ROWS = 1 << 12, 20_000
#: The default bound on the labelled rows that insults are learned from; in how many toxic texts a word must stand, and its
#: share of toxic ones were both kinds of text equally many.
FIT_LABELS, LEAST_TOXIC, LEAST_SHARE = 50_000, 8, 0.98
# Words that insult whatever stands around them, by language (en, de, es, fr, it), and words that may be meant
# plainly and so count only beside others.
INSULTS = (
    "asshole bastard bitch cretin cunt dumbass faggot idiot idiots imbecile jackass moron morons retard retarded scum scumbag slut stupid subhuman whore".split()
    + "abschaum arschloch dummkopf fotze hure hurensohn missgeburt schlampe vollidiot wichser".split()
    + "cabrón estúpida estúpido gilipollas idiota imbécil maricón mierda pendejo puta zorra".split()
    + "abruti connard connasse crétin débile enculé ordure pute salaud salope".split()
    + "bastardo coglione stronza stronzo troia".split()
)
AMBIGUOUS = "clown degenerate disgusting filth freak loser losers pathetic trash vermin worthless".split()
#: Who is spoken to, and what a threat says will be done to them.
SPOKEN_TO = frozenset(x.encode() for x in "you your yours u ur yourself du dich dir dein deine euch tu te toi ton ta vous votre ti usted ustedes eres vosotros sei".split())
THREATS = frozenset(x.encode() for x in "kill murder stab shoot strangle hurt beat burn hang umbringen töten matar mataré matarte tuer tuerai uccidere".split())
STRONG, PLAIN, LEARNED = 3, 2, 1
LABELLERS = ["symbols", "tables", "shouting", "repeats", "adjacent", "lines", "words", "length", "shapes", "runs"]
CIVILITY = ["listed", "distinct", "learned", "addressed", "dense", "threat"]
SHAPE = bytes(65 if 65 <= x <= 90 else 97 if 97 <= x <= 122 or x >= 128 else 48 if 48 <= x <= 57 else x for x in range(256))
RUNS, JUNK = re.compile(rb"a{2,}|A{2,}|0{2,}"), re.compile(rb"[^\w\s]{2,}")


def vote(value: float, good: float, bad: float) -> int:
    """1 on the good side, 0 on the bad side, -1 (no vote) between. The sides are told by which bound is larger."""
    if good < bad:
        return 1 if value <= good else 0 if value >= bad else -1
    return 1 if value >= good else 0 if value <= bad else -1


class Insults:
    """Words with their kind: listed ones, and those that labels taught (taught: whether there are any)."""

    def __init__(self, learned: set[bytes] = frozenset()) -> None:
        strong, plain = (dict.fromkeys((x.encode() for x in some), kind) for some, kind in ((INSULTS, STRONG), (AMBIGUOUS, PLAIN)))
        self.words, self.taught = dict.fromkeys(learned, LEARNED) | strong | plain, bool(learned)


def beside(words: list[bytes], at: int, others: frozenset[bytes], span: int) -> bool:
    return not others.isdisjoint(words[max(0, at - span) : at + span + 1])


def uncivil(text: bytes, insults: Insults) -> tuple[list[int], dict[int, float], int]:
    """(votes on civility, hashed features, number of insults) of a text. A threat to someone spoken to counts as an insult.

    The labellers see different things: two listed insults; how many distinct ones; words learned from labels; an insult next
    to someone spoken to; how many of the words are insults; threats. A single word that may be meant plainly moves none of
    them against the text, and no labeller alone decides. Features are the insults where there are two or more, their number,
    the labellers' views, and the text's own words, each by its share."""
    words = words_of(text)
    threats = [k for k, x in enumerate(words) if x in THREATS and beside(words, k, SPOKEN_TO, 3)]
    kinds = [insults.words.get(x, 0) for x in words]
    found = [k for k, kind in enumerate(kinds) if kind]
    hits, learned = len(found) + len(threats), kinds.count(LEARNED)
    distinct = len({words[k] for k in found}) + len({words[k] for k in threats})
    spoken = bool(threats) or any(beside(words, k, SPOKEN_TO, 4) for k in found if kinds[k] == STRONG or hits > 1)
    dense = hits > 1 and hits >= 0.01 * len(words)
    votes = [0 if hits - learned > 1 else -1, vote(distinct, 0, 2), vote(learned, 0, 2) if insults.taught else -1, 0 if spoken else -1, 0 if dense else -1, 0 if threats else -1]
    told = [b"insult" + words[k] for k in found] if hits > 1 else []
    told += [b"hits%d" % min(hits, 3), b"distinct%d" % min(distinct, 3)] + [b"spoken"] * spoken + [b"dense"] * dense + [b"threat"] * bool(threats)
    features = {zlib.crc32(x) % BUCKETS: 1.0 for x in told}
    for x, n in Counter(words).items():
        if x not in insults.words:
            at = zlib.crc32(b"word" + x) % BUCKETS
            features[at] = features.get(at, 0.0) + n / len(words)
    return votes, features, hits


def measure(text: bytes) -> tuple[list[int], dict[int, float]]:
    """(votes on form, hashed features) of a text."""
    words = text.split()
    n = max(len(words), 1)
    shaped = text.translate(SHAPE)
    shapes = Counter(RUNS.sub(lambda m: m[0][:2], shaped).split())
    upper, lower = shaped.count(b"A"), shaped.count(b"a")
    counts = Counter(words)
    top = max(counts.values(), default=0)
    letters = max(upper + lower, 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    same = bytes(map(bytes.__eq__, words, words[1:]))
    share = {
        "symbols": len(JUNK.findall(text)) / n,
        "tables": sum(v for k, v in counts.items() if not k.isalnum() and len(k) == 1 and k < b"\x80") / n,
        "shouting": upper / letters,
        "repeats": top / n if n >= 10 else 0.0,
        "adjacent": same.count(1) / n,
        "lines": 1 - len(set(lines)) / max(len(lines), 1),
        "words": sum(v for k, v in shapes.items() if k.strip(b".,;:!?\"'()-") in (b"a", b"aa", b"A", b"Aa", b"Aaa")) / n,
        "length": min(len(words), 1000) / 1000,
        "shapes": len(shapes) / n if n >= 20 else 0.0,
    }
    against = lambda value, bad: 0 if value >= bad else -1  # noqa: E731  these see one defect, and say nothing without it
    votes = [
        against(share["symbols"], 0.15), against(share["tables"], 0.1), against(share["shouting"], 0.4), against(share["repeats"], 0.25), against(share["adjacent"], 0.15),
        vote(share["lines"], 0.3, 0.6), vote(share["words"], 0.88, 0.75), -1 if len(words) > 4 else 0, vote(share["shapes"], 0.3, 0.6),
        vote(max(map(len, same.split(b"\x00")), default=0), 1, 4),
    ]
    features = {zlib.crc32(b"share" + k.encode() + b"%d" % min(int(v * 20), 20)) % BUCKETS: 1.0 for k, v in share.items()}
    for k, v in shapes.items():
        at = zlib.crc32(b"shape" + k) % BUCKETS
        features[at] = features.get(at, 0.0) + v / n
    return votes, features


def learn_insults(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", fit_labels: int = FIT_LABELS) -> Insults:
    """The listed insults, and words that stand in LEAST_TOXIC toxic texts or more and hardly in others, of at most `fit_labels` labelled rows (those
    with the smallest hashes of id and label). Rows without an id or a label teach nothing."""
    some = labels.where(F.col(toxic_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), (F.col(toxic_col) > 0).alias("toxic"))
    some = stored(smallest_hashes(some, fit_labels, "id", "toxic"), "labelled")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body")).join(F.broadcast(some), "id").select("toxic", "body")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = (Counter(), Counter()), [0, 0]
        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), utf8(batch, "body"), strict=True):
                seen[toxic].update(set(words_of(text)))
                n[toxic] += 1
        seen[0][b""], seen[1][b""] = n
        words = list(seen[1])  # a word that no toxic text has here may have some elsewhere; its clean count follows below
        rest = [x for x in seen[0] if x not in seen[1]]
        every = words + rest
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.binary()), pa.array([seen[1][x] for x in every], pa.int64()), pa.array([seen[0][x] for x in every], pa.int64())], names=["word", "toxic", "clean"])

    table = stored(mapped(rows, count, "word binary, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where((F.col("toxic") >= LEAST_TOXIC) | (F.length("word") == 0)), "toxic-words")
    total = table.where(F.length("word") == 0).first()
    if not total or not total["toxic"] or not total["clean"]:
        return Insults()
    share = F.col("toxic") / total["toxic"] / (F.col("toxic") / total["toxic"] + F.col("clean") / total["clean"])
    return Insults({bytes(r["word"]) for r in table.where((F.length("word") > 0) & (share >= LEAST_SHARE)).select("word").toLocalIterator()})


def signs(votes: list[int]) -> str:
    return "".join("-" if v < 0 else str(v) for v in votes)


def measured(docs: DataFrame, insults: Insults, id_col: str, text_col: str) -> DataFrame:
    """id, key (hash of the text), for form and civility each votes (a string of 0, 1 and -), buckets and values, and the
    number of insults, of every text, in one scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch, "body")
            form, civil = [measure(x) for x in texts], [uncivil(x, insults) for x in texts]
            parts = [x for of in (form, civil) for x in (pa.array([signs(x[0]) for x in of], pa.string()), pa.array([list(x[1]) for x in of], pa.list_(pa.int32())), pa.array([list(x[1].values()) for x in of], pa.list_(pa.float32())))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), *parts, pa.array([x[2] for x in civil], pa.int64())], names=["id", "key", "votes", "buckets", "weights", "civil_votes", "civil_buckets", "civil_weights", "insults"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"), F.xxhash64(text_col).alias("key"))
    return mapped(rows, run, "id long, key long, votes string, buckets array<int>, weights array<float>, civil_votes string, civil_buckets array<int>, civil_weights array<float>, insults long")


def posteriors(patterns: dict[str, int], rounds: int = 50) -> dict[str, float]:
    """P(good) of each vote pattern by expectation-maximisation; patterns: how many texts voted so.

    Each labeller has, for good and for bad texts, its own chances of voting good, bad or not at all, so its accuracy and
    its coverage are estimated together; votes are independent given the class. The start takes texts with a vote
    against them as bad. An empty table gives no patterns."""
    keys = list(patterns)
    if not keys:
        return {}
    votes = np.array([[{"0": 0, "1": 1, "-": 2}[x] for x in k] for k in keys])
    times = np.array([patterns[k] for k in keys], float)
    cast = votes[:, :, None] == np.arange(3)
    good = np.where((votes == 0).any(1), 0.05, 0.95)
    for _ in range(rounds):
        prior = float(np.clip((good * times).sum() / times.sum(), 0.05, 0.95))
        logs = []
        for weight in ((1 - good) * times, good * times):
            chance = (weight[:, None, None] * cast).sum(0) + 0.5
            logs.append((np.log(chance / chance.sum(1, keepdims=True))[None] * cast).sum((1, 2)))
        good = 1 / (1 + np.exp(np.clip(logs[0] + np.log(1 - prior) - logs[1] - np.log(prior), -500, 500)))
    return dict(zip(keys, good.tolist(), strict=True))


def features_of(table: pa.Table | pa.RecordBatch, lead: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, values, row of each) of all rows of a batch: arrays, not Python objects, as texts have hundreds of features."""
    parts = [table.column(f"{lead}{x}") for x in ("buckets", "weights")]
    parts = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in parts]
    sizes = pc.list_value_length(parts[0]).to_numpy(zero_copy_only=False)
    return parts[0].flatten().to_numpy(), parts[1].flatten().to_numpy(), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)


def fit(index: np.ndarray, value: np.ndarray, owner: np.ndarray, good: np.ndarray, epochs: int = 30, rate: float = 1.0) -> np.ndarray:
    """Weights (the last is the bias) of a logistic scorer on soft labels; AdaGrad over minibatches in a fixed order."""
    w, seen = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-6)
    edges = np.searchsorted(owner, np.arange(0, len(good) + 256, 256))
    for _ in range(epochs):
        for k, at in enumerate(range(0, len(good), 256)):
            some, y = slice(edges[k], edges[k + 1]), good[at : at + 256]
            row, own = owner[some] - at, index[some]
            miss = 1 / (1 + np.exp(-(np.bincount(row, w[own] * value[some], len(y)) + w[-1]))) - y
            slope = np.bincount(own, miss[row] * value[some], BUCKETS + 1)
            slope[-1] = miss.sum()
            slope = slope / len(y) + 1e-4 * w
            seen += slope**2
            w -= rate * 0.1 * slope / np.sqrt(seen)
    return w


def fit_task(good: dict[str, dict[str, float]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The weights of each scorer (lead of its columns, posteriors of its patterns), fitted by the one task that holds the sample,
    so that the driver gets the weights alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(some) if (some := list(batches)) else None
        if table is None or not table.num_rows:
            return
        w = [fit(*features_of(table, lead), np.array([of[v] for v in table.column(f"{lead}votes").to_pylist()])) for lead, of in good.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(good)), pa.array(w, pa.list_(pa.float64()))], names=["lead", "w"])

    return run


def score_quality(
    docs: DataFrame, labels: DataFrame | None = None, threshold: float = 0.5, toxic_threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, fit_labels: int = FIT_LABELS
) -> DataFrame:
    """doc_id, text_key, votes, posterior, quality_score, insults, toxicity, toxic, kept: one row per input row.

    Ten labellers vote on the form of every whole text and six on its civility. EM over the counts of their vote patterns (at
    most 3^10 and 3^6) estimates accuracies and posteriors. For each question a linear scorer over hashed features (word
    shapes and measures; insults, the labellers' views and the text's words) is fitted to the posteriors of at most `fit_rows` texts, chosen by the
    smallest hashes of id and text, and scores all. Insults are listed ones and those that learn_insults() takes from at most
    `fit_labels` rows of `labels` (id, toxic). quality_score is P(well formed); toxicity is P(not civil), and a text is toxic
    from `toxic_threshold` on. kept says that it is neither toxic nor below `threshold`. Null and empty texts score by the same
    rules (no words: the length labeller votes against). Rows that repeat, or share a doc_id, each count and are scored on
    their own; an empty table gives no rows. Only the id and the text are read.
    """
    insults = learn_insults(docs, labels, id_col, text_col, fit_labels=fit_labels) if labels is not None else Insults()
    rows = stored(measured(docs, insults, id_col, text_col), "measures")
    sample = smallest_hashes(rows, fit_rows, "id", "key").select("votes", "buckets", "weights", "civil_votes", "civil_buckets", "civil_weights")
    leads = ["", "civil_"]
    good = [posteriors({r["v"]: r["n"] for r in rows.groupBy(F.col(f"{x}votes").alias("v")).agg(F.count("*").alias("n")).collect()}) for x in leads]  # at most 3^10 rows
    told = {r["lead"]: np.array(r["w"]) for r in mapped(sample, fit_task(dict(zip(leads, good, strict=True))), "lead string, w array<double>").collect()}
    w = [told.get(x, np.zeros(BUCKETS + 1)) for x in leads]

    def chance(batch: pa.RecordBatch, lead: str, w: np.ndarray) -> np.ndarray:
        index, value, owner = features_of(batch, lead)
        return 1 / (1 + np.exp(-(np.bincount(owner, w[index] * value, batch.num_rows) + w[-1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, rude = chance(batch, "", w[0]), 1 - chance(batch, "civil_", w[1])
            toxic = rude >= toxic_threshold
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("key"), batch.column("votes"), pa.array([good[0][v] for v in batch.column("votes").to_pylist()], pa.float64()), pa.array(score, pa.float64()), batch.column("insults"), pa.array(rude, pa.float64()), pa.array(toxic, pa.bool_()), pa.array((score >= threshold) & ~toxic, pa.bool_())],
                names=["doc_id", "text_key", "votes", "posterior", "quality_score", "insults", "toxicity", "toxic", "kept"],
            )

    return mapped(rows, run, "doc_id long, text_key long, votes string, posterior double, quality_score double, insults long, toxicity double, toxic boolean, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows of `docs` that the classifier keeps, with all their columns; each row is judged by its own text, null ones as
    empty. An empty table stays empty."""
    lost = score_quality(docs, labels, id_col=id_col, text_col=text_col, **more).where("not kept").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    return docs.join(lost, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__key")), "left_anti")
