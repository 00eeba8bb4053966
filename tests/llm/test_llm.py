"""The ten operators and the pipeline against brute force, on odd rows: nulls, empty and very long texts, copies, ties,
repeated rows, extra columns whose names clash."""

import hashlib
import math
import random
import zlib
from base64 import b32encode
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import common, decontaminate, exact_dedup, language_id, lm_scoring, ngram_join, packing, quality, suffix_dedup, token_counts, warc
from lumenfold.llm.queries import oracle_sql, queries, tokenizer_path

SF = "/root/testdata/sf0.001"
EXTRA = ["id", "body", "key", "chunk", "sid", "n", "kind", "a", "b", "votes", "prefix", "kept", "title"]


def words(rng, n):
    return " ".join("".join(rng.choice(["on", "the", "er", "ti", "re", "an", "st"]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i, words(rng, rng.randrange(5, 120)), rng.choice(["en", "fr", None])) for i in range(60)]
    long_ = words(rng, 30_000)
    passage = words(rng, 80)
    out += [(100, None, "en"), (101, "", None), (102, " \n\t ", "en"), (103, "a b", "fr"), (104, "a b", "fr"), (105, long_, "en"), (106, long_, "en"), (107, long_ + " end", "en"), (108, "é" * 5000, "fr"), (109, "A B", None)]
    out += [(110 + i, words(rng, 20) + " " + passage + " " + words(rng, 20), "en") for i in range(6)]
    base = words(rng, 60).split()
    for i in range(14):  # a chain of near copies
        base[rng.randrange(60)] = f"w{i}"
        out.append((130 + i, " ".join(base), "en"))
    out += [(3, out[3][1], "en"), (105, long_, "en"), (None, "no id at all here", "en"), (None, passage, "en"), (None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    for name in EXTRA:
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def raw(text):
    return (text or "").encode()


def counted(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


def test_exact_dedup(docs, rows, nothing):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[raw(t)].append(i)
    got = exact_dedup.exact_dedup(docs, digest=True)
    want = Counter()
    for i, t, _ in rows:
        g = groups[raw(t)]
        want[i, max((x for x in g if x is not None), default=None), len(g), hashlib.sha256(raw(t)).hexdigest()] += 1
    assert counted(got, "doc_id", "keep_id", "group_size", "text_sha256") == want
    assert got.where("kept").count() == len(groups)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(raw(r["text"]) for r in kept.collect()) == Counter(groups.keys())
    assert exact_dedup.exact_dedup(nothing, digest=True).count() == 0
    assert exact_dedup.keep_one(nothing).count() == 0


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    """Whole tables against DuckDB."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cur = con.execute(oracle_sql()[name])
    names = [d[0] for d in cur.description]
    got = queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert counted(got, *names) == Counter(cur.fetchall())


def test_binary_pieces():
    for n in [*range(70), 2047, 2048, 2049, 5000]:
        pieces = packing.binary_pieces(n, 32)
        assert [s for s, _ in pieces] == [sum(x for _, x in pieces[:k]) for k in range(len(pieces))]
        assert sum(x for _, x in pieces) == n and all(x & (x - 1) == 0 and x <= 32 for _, x in pieces)


def packed(rows, longest):
    """The pieces of each (doc_id, text), by the tokenizer itself."""
    from tokenizers import Tokenizer

    tokenizer, want = Tokenizer.from_file(tokenizer_path()), Counter()
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for start, n in packing.binary_pieces(len(ids), longest):
            want[i, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), 0] += 1
    return want


def test_packing(docs, rows, nothing):
    want = packed([r[:2] for r in rows], 256)
    got = packing.pack(docs, tokenizer_path(), longest=256)
    assert counted(got, "doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset") == want
    ids = sorted((r["sequence_id"], r["length"]) for r in got.collect())
    assert [x for x, _ in ids] == list(range(len(ids)))
    assert [n for _, n in ids] == sorted(n for _, n in ids)  # a bucket is a range of ids
    assert packing.pack(nothing, tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, tokenizer_path(), longest=100)


ODD_RUNS = ["Don't, stop.It's  A<|startoftext|>B, <|StartOfText|>, x…, É́., ΑΣ. Σ, 1,000.5! a\xa0b,c x İ, ﬁ. Á, '' 's, !!? ))) a)b| é.", "क़, THE<|END", "", " \x0b ", "('super 'super ''super 'S 't. .'t 'the' \"'ll\" don't' (don't) '", "&&&what%%% _x_ <a> <| |> <|endoftext|> x<|endoftext|>, ½x) (½ ①. ≮ <\u0338a a\u0338> क़) (क़ İstanbul, İ) (İ", "ΣΑΣ) (ΑΣ ﬀ] [ﬀ ǰ) ( ̌j", "12ab34! #1.2.3# a1,b2;"]


def test_encoding_in_chunks(monkeypatch):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    tokenizer, encode = Tokenizer.from_file(tokenizer_path()), packing.chunk_encoder(tokenizer_path())
    made = ["".join(rng.choice(["a", "'", "s", "é", "1", ",", "(", "<", "|", ">", "\u0301", "II", "Ⅷ", " ", "中", "t"]) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    want = [np.array(tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in ODD_RUNS + made]
    assert list(encode([x.encode() for x in ODD_RUNS + made])) == want
    monkeypatch.setattr(packing, "CACHE_BYTES", 20_000)  # generations come and go
    monkeypatch.setattr(packing, "TOGETHER", 3)
    packing._KNOWN.clear()
    encode = packing.chunk_encoder(tokenizer_path())
    for k in range(0, len(want), 40):
        assert list(encode([x.encode() for x in (ODD_RUNS + made)[k : k + 40]])) == want[k : k + 40]
    assert packing._KNOWN[tokenizer_path()].young.size < 40_000


def test_automaton():
    rng = random.Random(1)
    for _ in range(300):
        pieces = {bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 8))}
        count = token_counts.Automaton(pieces).count
        for _ in range(20):
            word = bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 12)))
            at, n = 0, 0
            while at < len(word):
                size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in pieces), 0)
                if not size:
                    n = 1
                    break
                at, n = at + size, n + 1
            assert count(word) == n, (pieces, word)


def test_token_counts(docs, rows, nothing):
    vocab = set(token_counts.vocabulary(tokenizer_path()))
    longest = max(map(len, vocab))

    def greedy(word):
        at, n = 0, 0
        while at < len(word):
            at += next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in vocab)
            n += 1
        return n

    want = Counter((i, len(raw(t).split()), sum(greedy(w + b" ") for w in raw(t).lower().split())) for i, t, _ in rows)
    assert counted(token_counts.token_counts(docs, tokenizer_path()), "doc_id", "n_words", "n_tokens") == want
    assert token_counts.token_counts(nothing, tokenizer_path()).count() == 0


def shingle_set(text):
    w = raw(text).lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def linked(rows):
    sets = [shingle_set(t) for _, t, _ in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= 80 * (len(sets[i]) + len(sets[j]) - o):
                up[root(i)] = root(j)
    least = defaultdict(lambda: None)
    for i, (doc, _, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = doc if least[root(i)] is None else min(least[root(i)], doc)
    return Counter((rows[i][0], len(sets[i]), least[root(i)] if sets[i] else rows[i][0]) for i in range(len(rows)))


def test_jaccard_join(docs, rows, nothing):
    want = linked(rows)
    assert counted(ngram_join.jaccard_join(docs), "doc_id", "n_shingles", "component_id") == want
    assert any(k[0] is not None and k[0] >= 130 and k[2] == 130 for k in want)
    assert ngram_join.jaccard_join(nothing).count() == 0
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns
    gone = {d for d, _, c in want if d is not None and d != c}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(d for d, _, _ in rows if d not in gone)


def test_near_copies_with_one_id(spark):
    """Clean texts stay whatever has their doc_id; of near copies with one doc_id or none a single one stays."""
    rng = random.Random(9)
    base = [words(rng, 60) for _ in range(4)]
    rows = [(1, base[0]), (2, base[0] + " end"), (2, base[1]), (5, base[2]), (5, base[2] + " end"), (None, base[3]), (None, base[3] + " end"), (None, base[0] + " stop"), (None, None)]
    kept = {(r["doc_id"], r["text"]) for r in ngram_join.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(1, base[0]), (2, base[1]), (None, None)} <= kept and len(kept) == 5
    assert len(kept & set(rows[3:5])) == len(kept & set(rows[5:7])) == 1


def test_jaccard_join_in_small_tiles(spark, monkeypatch):
    """Clusters of many tiles, several size bands and blocks."""
    rng = random.Random(8)
    base = words(rng, 120).split()
    rows = []
    for i in range(150):
        w = base[: rng.randrange(70, 121)]
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"q{rng.randrange(50)}"
        rows.append((i, " ".join(w), None))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    for limits in ((1500, 20_000), (10**9, 20)):
        for name, value in (("BLOCK", limits[0]), ("BLOCK_SETS", limits[1]), ("CHUNK", 2000), ("BROADCAST_IDS", 10)):
            monkeypatch.setattr(ngram_join, name, value)
        assert counted(ngram_join.jaccard_join(df), "doc_id", "n_shingles", "component_id") == linked(rows)


def test_tile_of_very_unequal_sets():
    """A large set does not widen the bitmaps of small ones: a tile's memory stays in proportion to its shingles."""
    import tracemalloc

    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 1 << 63, 200_000).astype(np.uint64))]
    for _ in range(100):
        base = rng.integers(0, 1 << 63, 40).astype(np.uint64)
        sets += [np.unique(np.append(base, rng.integers(0, 1 << 63, 3).astype(np.uint64))) for _ in range(40)]
    tracemalloc.start()
    found = ngram_join.compare_tile(list(range(len(sets))), np.array(list(map(len, sets))), sets, 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    up = ngram_join.Links(len(sets))
    for a, b in found:
        up.up[up.root(a)] = up.root(b)
    groups = Counter(up.roots().tolist())
    assert sorted(groups.values()) == [1, *[40] * 100] and len(found) == 100 * 39
    assert peak < 60e6


def test_jaccard_join_of_rows_without_ids(spark):
    """Many rows without a doc_id: each finds its own copies, none is paired with all the others."""
    rng = random.Random(4)
    rows = [(None, words(rng, 30), None) for _ in range(300)]
    rows += [(None, t + " more", None) for _, t, _ in rows[:150]] + [(k, t, None) for k, (_, t, _) in enumerate(rows[:50])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert counted(ngram_join.jaccard_join(df), "doc_id", "n_shingles", "component_id") == linked(rows)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(k, k + 1) for k in range(1000, 1080)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in {y for e in edges for y in e if e[0] != e[1]}}


def test_repeats(docs, rows, nothing, monkeypatch):
    length = 50
    first = {}
    for i, t, _ in rows:
        if i is not None:
            b = raw(t)
            for k in range(len(b) - length + 1):
                w = b[k : k + length]
                first[w] = min(first.get(w, i), i)
    want = Counter()
    for i, t, _ in rows:
        b = raw(t)
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1) if i is not None else ():
            if first[b[k : k + length]] < i:
                gone[k : k + length] = True
        gone = gone[: len(b)]
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        want[i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert counted(suffix_dedup.remove_repeats(docs), *names) == want
    for name, value in (("HOT", 2), ("CHUNK_BYTES", 20_000), ("SORT_BYTES", 3000), ("PACK_BYTES", 50_000), ("STEP", 4096)):
        monkeypatch.setattr(suffix_dedup, name, value)
    assert counted(suffix_dedup.remove_repeats(docs), *names) == want
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_suffix_array():
    rng = random.Random(4)
    for _ in range(200):
        s = np.array([rng.randint(1, rng.choice([2, 3, 9])) for _ in range(rng.randint(0, 60))], np.int64)
        assert suffix_dedup.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def edit_distance_in(item, text):
    prev = [0] * (len(text) + 1)
    for c in item:
        cur = [prev[0] + 1]
        for j, t in enumerate(text):
            cur.append(min(prev[j] + (c != t), prev[j + 1] + 1, cur[-1] + 1))
        prev = cur
    return min(prev)


def test_alignment():
    rng = random.Random(1)
    for _ in range(200):
        item = bytes(rng.choice(b"abcde ") for _ in range(rng.randint(20, 60)))
        e, x = rng.randint(0, 5), bytearray(item)
        for _ in range(rng.randint(0, 8)):
            p = rng.randrange(len(x))
            x[p : p + rng.randrange(2)] = bytes([rng.choice(b"abcde")]) * rng.randrange(2)
        edge = lambda: bytes(rng.choice(b"abcde ") for _ in range(rng.randint(0, e + 1)))
        region = edge() + bytes(x) + edge()
        want, got = edit_distance_in(item, region), decontaminate.align(item, region, e)
        assert (got is None) == (want > e)
        if got:
            assert got[0] == want == edit_distance_in(item, region[got[1] : got[2]])


def test_decontamination(spark):
    rng = random.Random(6)
    items = [(k, words(rng, rng.randrange(12, 40))) for k in range(8)] + [(90, None), (91, "tiny"), (92, ""), (93, "ab yz cdxyzx"), (94, "yzabcdxyza bcdxyzab zy")]
    rows = []
    for i in range(60):
        text = words(rng, 60)
        if i % 3:
            leak = bytearray(rng.choice(items[:8])[1].upper().encode())
            for _ in range(rng.choice([0, 0, 1, 3, 8, 30])):
                p = rng.randrange(len(leak))
                leak[p : p + rng.randrange(2)] = bytes([rng.choice(b"abcdxyz")]) * rng.randrange(2)
            text += "!!  \n" + leak.decode() + ". " + words(rng, 10)
        rows.append((i, text))
    rows += [(100, None), (101, ""), (None, items[0][1]), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for i, t in rows:
        for k, item in items:
            x = decontaminate.normal(raw(item))
            if x and (d := edit_distance_in(x, decontaminate.normal(raw(t)))) <= decontaminate.budget(len(x), 0.1):
                want[i, k, d] += 1
    assert counted(decontaminate.contaminated(docs, bench), "doc_id", "item_id", "edits") == want
    assert {k[2] for k in want} >= {0, 1}
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    gone = {k[0] for k in want}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, _ in rows if i not in gone)
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


def found_in(index, texts):
    """(text, passage, edits, start, end, shared q-grams) of verified bands."""
    return {(of, o, *((got := decontaminate.align(index.items[o][1], texts[of][low:high], index.edits[o]))[0], low + got[1], low + got[2]), shared) for of, o, low, high, shared in index.regions(texts) if decontaminate.align(index.items[o][1], texts[of][low:high], index.edits[o])}


def test_texts_are_searched_alone(spark):
    """Neither a passage cut in two by the border of neighbours nor anything else of a batch changes what a text gives."""
    rng = random.Random(12)
    items = [(k, decontaminate.normal(words(rng, rng.randrange(40, 120)).encode())) for k in range(6)]
    texts = []
    for _ in range(200):
        x = rng.choice(items)[1]
        cut = len(x) * rng.randrange(20, 80) // 100
        texts += [decontaminate.normal((words(rng, 15) + " ").encode() + x[:cut]), x[cut:] + decontaminate.normal((" " + words(rng, 15)).encode())]
    texts += [b"", items[2][1], items[3][1] + b" " + items[3][1], decontaminate.normal(words(rng, 30_000).encode()) + b" " + items[1][1]]
    index = decontaminate.Index(items, 0.1)
    alone = {(k, *x[1:]) for k, t in enumerate(texts) for x in found_in(index, [t])}
    assert alone == found_in(index, texts) == {(len(texts) - 1 - k, *x[1:]) for k, *x in ((y[0], *y) for y in found_in(index, texts[::-1]))}
    assert {x[0] for x in alone} == {401, 402, 403}
    docs = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(k, t.decode()) for k, t in items], "item_id long, text string")
    rows = decontaminate.contaminated(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"], r["edits"], r["start"], r["end"]) for r in rows} == {(401, 2, 0, 0, len(items[2][1])), (402, 3, 0, 0, len(items[3][1])), (403, 1, 0, len(texts[403]) - len(items[1][1]), len(texts[403]))}


def test_short_passages(spark):
    """Passages under Q bytes are found too, alone or beside long ones."""
    docs = spark.createDataFrame([(1, "It says: X1-y2, x1 y2."), (2, "x1y2"), (3, None), (4, "a longer passage here")], "doc_id long, text string")
    items = [(7, "x1 Y2"), (8, "x1 y2!"), (9, ""), (10, None), (11, "zz")]
    for more in ([], [(12, "longer passage")]):
        bench = spark.createDataFrame(items + more, "item_id long, text string")
        want = Counter({(1, 7, 8, 13, 0, 2): 1, (1, 8, 8, 13, 0, 2): 1} | {(4, 12, 2, 16, 0, 1): 1 for _ in more})
        assert counted(decontaminate.contaminated(docs, bench), "doc_id", "item_id", "start", "end", "edits", "regions") == want
        assert {r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()} == {2, 3, 4} - {4 for _ in more}


def test_language_model(spark, docs, rows, nothing):
    counts, n_train = Counter(), 0
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    for i, t, _ in rows:
        if not held(i):
            counts.update(raw(t).lower().split())
            n_train += 1
    counts[b" "] = n_train
    n, v = sum(counts.values()), len(counts)
    got = defaultdict(list)
    for r in lm_scoring.lm_scores(docs).collect():
        got[r["doc_id"]].append(r)
        assert r["score"] < 0 and abs(r["bits_per_byte"] + r["score"] / math.log10(2) / r["n_bytes"]) < 1e-9
    for i, t, _ in rows:
        tokens = [*raw(t).lower().split(), b" "]
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens)
        assert any(r["held_out"] == held(i) and r["n_tokens"] == len(tokens) and r["n_known"] == sum(counts[x] > 0 for x in tokens) and r["train_tokens"] == n and abs(r["base_score"] - base) < 1e-6 * abs(base) for r in got[i])
    assert lm_scoring.lm_scores(nothing).count() == 0
    only_held = lm_scoring.lm_scores(docs.where("doc_id is not null and crc32(cast(doc_id as string)) % 7 = 2"))
    assert {(r["train_tokens"], r["n_known"]) for r in only_held.collect()} == {(0, 0)}


def test_model_is_a_distribution():
    """After any context the probabilities of the next byte add up to one."""
    rng = np.random.default_rng(1)
    text = rng.integers(97, 101, 5000, dtype=np.uint8).tobytes()
    counts = lm_scoring.GramCounts()
    for gram, _ in lm_scoring.slices([text]):
        counts.see(gram)
    gram, n = counts.result()
    tables = [np.zeros((1 << b, 2)) for b in lm_scoring.SLOT_BITS]
    for bit in range(8):
        y = ((gram >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64)
        for order, t in enumerate(tables):
            np.add.at(t, (lm_scoring.slots(gram, order, bit), y), n)
    mixer = lm_scoring.Mixer([t[:, 0] for t in tables], [t[:, 1] for t in tables])

    def cost():
        total = 0.0
        for bit in range(8):
            x, gate, y = mixer.inputs(gram, bit, True)
            p = lm_scoring.squash(mixer.mixed(x, gate))
            total -= np.log(np.where(y == 1, p, 1 - p)) @ n
        return total

    before = cost()
    mixer.train(gram, n)
    assert cost() < before
    context = gram[0] >> np.uint64(8) << np.uint64(8)
    assert abs((10 ** mixer.log10(context | np.arange(256, dtype=np.uint64))).sum() - 1) < 1e-6
    assert int(n.sum()) == len(text)


def test_lm_counts_are_exact(spark):
    """No two contexts share a count, and every count is of the whole training corpus."""
    rng = random.Random(5)
    texts = [(i, " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 5))) for _ in range(40))) for i in range(30)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want, grams = Counter(), set()
    for i, t in texts:
        body = lm_scoring.PAD + lm_scoring.canonical(raw(t))
        for at in range(lm_scoring.ORDER, len(body)):
            grams.add(int.from_bytes(body[at - lm_scoring.ORDER : at + 1], "big"))
            if zlib.crc32(str(i).encode()) % 7 != 2:
                for order in range(lm_scoring.ORDER + 1):
                    want.update((order, body[at - order : at], f"{body[at]:08b}"[: bit + 1]) for bit in range(8))
    rows = lm_scoring.gather(lm_scoring.rows_of(docs, "doc_id", "text"), 4, 9).where("kind in ('grams', 'low')").collect()
    low = [(lm_scoring.of_planes(r["a"], 3), lm_scoring.counts_of(r["b"])) for r in rows if r["kind"] == "low"]
    mixer = lm_scoring.BlockMixer(lm_scoring.summed(*map(np.concatenate, zip(*low))))
    found = []
    for r in rows:
        if r["kind"] == "grams":
            gram = lm_scoring.turned_back(lm_scoring.of_planes(r["a"], 6))
            found += gram.tolist()
            at = mixer.hold(gram, lm_scoring.counts_of(r["b"]))
            for bit in range(8):
                _, tallies = mixer.tallies(at, bit)
                for order, n in enumerate(tallies):
                    for k, g in enumerate(gram.tolist()):
                        g = g.to_bytes(6, "big")
                        assert [int(n[y][k]) for y in (0, 1)] == [want[order, g[5 - order : 5], f"{g[5]:08b}"[:bit] + str(y)] for y in (0, 1)]
    assert len(found) == len(grams) and set(found) == grams
    text = np.frombuffer(b"".join(x.to_bytes(8, "big") for x in range(1000)), ">u8").astype(np.uint64) * np.uint64(262_147_000)
    assert (lm_scoring.turned_back(lm_scoring.of_planes(lm_scoring.planes(text, 6), 6)) == lm_scoring.turned_back(text)).all()
    few = lm_scoring.Scores(text, np.arange(1000, dtype=np.float32))
    assert (few.of(text[::-1]) == np.arange(1000)[::-1]).all()


def test_lm_weighs_by_counts():
    """A gram that occurs 5,000 times weighs more in the fit than one that occurs 257 times."""
    gram, n = np.arange(97, 107, dtype=np.uint64), np.ones(10, np.int64)
    low = gram[:], n
    found = []
    for most in (257, 5000):
        mixer = lm_scoring.BlockMixer(low)
        mixer.train(mixer.hold(gram, n * 10), np.where(np.arange(10) == 3, most, 1))
        found.append(mixer.weights)
    assert not np.allclose(*found)


def test_lm_scores_follow_from_the_data(spark, monkeypatch):
    """The same scores, to the last bit, whatever the partitions, the batches and the order of the rows."""
    for name, value in (("CELL_BYTES", 50_000), ("FIT_GRAMS", 20_000)):  # several tasks, each of several cells
        monkeypatch.setattr(lm_scoring, name, value)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for k, n in enumerate((4, 9, 31)):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            monkeypatch.setattr(common, "BATCH_ROWS", (1000, 7, 40)[k])
            rows = lm_scoring.lm_scores(docs.repartition(n) if k else docs).select("doc_id", "score", "base_score").collect()
            found.append({r["doc_id"]: r["score"] for r in rows})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2] and len(found[0]) == docs.count()


def test_lm_score_against_plain_python(spark):
    """Counts, fit, map, mix and the online choice between the scorers, written out bit by bit in plain Python."""
    rng = random.Random(11)
    texts = [(i, " ".join("".join(rng.choice("abé") for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(40)))) for i in range(24)] + [(50, None)]
    got = {r["doc_id"]: r["score"] for r in lm_scoring.lm_scores(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    order = lm_scoring.ORDER
    bodies = {i: lm_scoring.PAD + lm_scoring.canonical(raw(t)) for i, t in texts}
    train = [b for i, b in bodies.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    count, grams = Counter(), Counter()
    for b in train:
        for at in range(order, len(b)):
            grams[b[at - order : at + 1]] += 1
            for o in range(order + 1):
                count.update((o, b[at - o : at], f"{b[at]:08b}"[: k + 1]) for k in range(8))
    clip = lambda x, low, high: max(low, min(high, x))
    squash = lambda x: 1 / (1 + math.exp(-clip(x, -30, 30)))
    gates = lm_scoring.GATES

    def inputs(gram, bit, without):
        bits = f"{gram[-1]:08b}"
        x, seen = [], []
        for o in range(order + 1):
            n = [count[o, gram[order - o : order], bits[:bit] + y] for y in "01"]
            if without:
                n[int(bits[bit])] = max(n[int(bits[bit])] - 1, 0)
            p = (n[1] + 0.02) / (sum(n) + 0.04)
            x.append(math.log(p / (1 - p)) if sum(n) else 0.0)
            seen.append(sum(n))
        level = lambda n: min(int(math.log2(n + 1)), 5)
        return [*x, 0.3], (level(seen[order]) * 6 + level(seen[order - 2])) * 8 + bit, int(bits[bit])

    # One cell at this size, so one task; its grams in the order of their hashes.
    key = lambda g: int(common.mix64(np.array([int.from_bytes(g, "big")], np.uint64))[0])
    every = sorted(grams, key=key)
    weights = [[0.3] * (order + 2) for _ in range(gates)]
    for bit in range(8):
        for at in range(0, len(every), 2048):
            sums, total = defaultdict(lambda: [0.0] * (order + 2)), Counter()
            for g in every[at : at + 2048]:
                x, gate, y = inputs(g, bit, True)
                miss = (y - squash(clip(sum(map(math.prod, zip(weights[gate], x))), -12, 12))) * grams[g]
                sums[gate] = [s + miss * v for s, v in zip(sums[gate], x)]
                total[gate] += grams[g]
            for gate, of in sums.items():
                weights[gate] = [w + 0.02 * s / max(total[gate], 1) * min(math.sqrt(total[gate]), 8) for w, s in zip(weights[gate], of)]
    apm = lm_scoring.APM
    seen = [[0.0, 4 * squash(-12 + 24 * k / (apm - 1)), 4.0] for k in range(apm)] * gates
    seen = [list(x) for x in seen]

    def spot(mixed, gate):
        place = (mixed + 12) * (apm - 1) / 24
        low = min(int(place), apm - 2)
        return gate * apm + low, place - low

    mix = lambda x, gate: clip(sum(map(math.prod, zip(weights[gate], x))), -12, 12)
    for bit in range(8):
        for g in every:
            x, gate, y = inputs(g, bit, True)
            at, part = spot(mix(x, gate), gate)
            for k, share in ((at, 1 - part), (at + 1, part)):
                seen[k][1] += share * grams[g] * y
                seen[k][2] += share * grams[g]

    def long_(gram):
        total = 0.0
        for bit in range(8):
            x, gate, y = inputs(gram, bit, False)
            mixed = mix(x, gate)
            at, part = spot(mixed, gate)
            p = 0.5 * squash(mixed) + 0.5 * (seen[at][1] / seen[at][2] * (1 - part) + seen[at + 1][1] / seen[at + 1][2] * part)
            p = clip(p, 1e-6, 1 - 1e-6)
            total += math.log10(p if y else 1 - p)
        return total

    follow = defaultdict(Counter)
    for g, n in grams.items():
        for o in range(3):
            follow[g[order - o : order]][g[order]] += n

    def short(gram):
        n = sum(follow[b""].values())
        p = (follow[b""][gram[order]] + 0.5) / (n + 128)
        for o in (1, 2):
            own = follow[gram[order - o : order]]
            p = (own[gram[order]] + (len(own) + 1) * p) / (sum(own.values()) + len(own) + 1)
        return math.log10(p)

    for i, b in bodies.items():
        total, ahead = 0.0, []
        for at in range(order, len(b)):
            one, two = long_(b[at - order : at + 1]), short(b[at - order : at + 1])
            w = squash(lm_scoring.START + sum(ahead[-lm_scoring.WINDOW :]) * lm_scoring.TRUST * math.log(10))
            total += math.log10(w * 10**one + (1 - w) * 10**two)
            ahead.append(one - two)
        assert abs(got[i] - total) < 1e-3 + 1e-4 * abs(total)


def test_words():
    rng = random.Random(1)
    texts = [b"", b" ", b"A b", b" \x0b\x0c a\xc3\x89\t\r\nB  ", b"\xc2\xa0x\x1cy\x00 z"] + ["".join(rng.choice(" \t\n\x0b\x0c\r\x1c\u2003aBÉ") for _ in range(rng.randrange(9))).encode() for _ in range(500)]
    names, index, offsets, joined = common.words_in(texts)
    want = [x.lower().split() for x in texts]
    assert [[names[k] for k in index[a:z]] for a, z in zip(offsets, offsets[1:])] == want
    assert joined == [b" ".join(x) for x in want]
    assert [len(x) for x in common.words_in([])] == [0, 0, 1, 0]


def test_online_choice():
    """Each text is weighed by itself, wherever it is cut and whatever stands beside it."""
    rng = np.random.default_rng(3)
    a, b, doc = lm_scoring.rounded(rng.normal(-1, 0.5, 900)), lm_scoring.rounded(rng.normal(-1, 0.5, 900)), np.repeat([0, 1, 3], [100, 500, 300])
    whole = lm_scoring.Online().scores(doc, a, b)
    online = lm_scoring.Online()
    assert (np.concatenate([online.scores(doc[i : i + 77], a[i : i + 77], b[i : i + 77]) for i in range(0, 900, 77)]) == whole).all()
    assert (lm_scoring.Online().scores(doc[100:600], a[100:600], b[100:600]) == whole[100:600]).all()


def test_short_scores_are_a_distribution():
    rng = np.random.default_rng(5)
    keys, n = np.unique(rng.integers(97, 103, (500, 3)) @ np.array([1 << 16, 256, 1]), return_counts=True)
    for step in (4096, 7):
        short = lm_scoring.ShortScores((keys.astype(np.uint64), n), step)
        for context in (97 << 8 | 98, 5 << 8 | 97, 0):
            assert abs((10 ** short.of(np.uint64(context << 8) + np.arange(256, dtype=np.uint64))).sum() - 1) < 2e-3


def test_lm_beats_unigrams(spark):
    r = lm_scoring.lm_scores(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert r[1] > r[0]


def test_warc(spark, nothing, tmp_path):
    rows = [(1, "http://www.Ex.org/b?q=1", "<p>one</p>"), (2, "https://ex.org:8080/a", "<p>one</p>"), (3, None, None), (4, "http://ex.org/\r\nX", ""), (5, "http://ex.org/b", "a\r\n\r\nWARC/1.1\r\nlines"), (6, "ü://%zz[", "é" * 50_000), (None, "http://ex.org/n", "<p>one</p>"), (7, "http://ex.org/b", "<p>one</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n", F.lit(1)).withColumn("sha", F.lit("x")).repartition(3)
    for least in (0, 100):
        top = {}
        for i, _, h in rows:
            top[raw(h)] = max(top.get(raw(h), -1), -1 if i is None else i)
        want = Counter()
        for i, _, h in rows:
            lead = len(raw(h)) < least or (-1 if i is None else i) == top[raw(h)]
            want[i, len(raw(h)), b32encode(hashlib.sha1(raw(h)).digest()).decode(), "response" if lead else "revisit", None if lead else top[raw(h)]] += 1
        got = warc.capture_histories(pages, f"file://{tmp_path}/w{least}", min_bytes=least)
        assert counted(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want
        keys = [(r["url_key"], r["captured"]) for r in got.collect()]
        assert keys == sorted(keys)
    assert warc.surt("http://www.Ex.org/b?q=1") == "org,ex)/b?q=1"
    assert warc.capture_histories(pages.limit(0)).count() == 0


def test_archive_of_odd_payloads(spark, tmp_path, monkeypatch):
    """Payloads with blank lines, record ends and whole records in them, over many files; each read back as it was."""
    rng = random.Random(13)
    monkeypatch.setattr(warc, "FILE_RECORDS", 7)
    monkeypatch.setattr(warc, "RANGE_RECORDS", 20)
    bits = ["\r\n\r\n", "\r", "\n", "\r\n", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc", "é", "x" * 70_000, ""]
    rows = [(k, f"http://h{k % 3}.org/{k % 5}", "".join(rng.choice(bits) for _ in range(rng.randrange(7)))) for k in range(150)]
    got = warc.capture_histories(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), f"file://{tmp_path}/w").collect()
    assert {(r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got} == {(i, len(raw(h)), b32encode(hashlib.sha1(raw(h)).digest()).decode()) for i, _, h in rows}
    assert len({r["archive"] for r in got}) > 10
    keys = [(r["url_key"], r["captured"], r["page_id"]) for r in got]
    assert keys == sorted(keys) and len(keys) == 150
    by_place = defaultdict(list)
    for r in got:
        by_place[r["archive"]].append((r["position"], r["length"]))
    for of in by_place.values():
        assert [a for a, _ in sorted(of)] == [0, *np.cumsum([n for _, n in sorted(of)])[:-1].tolist()]


def test_broken_archives():
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.Records("x").feed(b"HTTP/1.1"))
    for block, says in ((b"too long", "wrong length"), (b"", "cut off")):
        reader = warc.Records("x")
        with pytest.raises(ValueError, match=says):
            list(reader.feed(b"WARC/1.1\r\nContent-Length: 5")), list(reader.feed(block))
            reader.close()
    for block in (b"", b"abc", b"\r", b"a\r\n", b"\r\n\r\n\r\n", b"\n\r\n\r"):
        data, reader = b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block) * 3, warc.Records("x")
        pieces = data.split(b"\r\n\r\n")
        got = [x for piece in (pieces if pieces[-1] else pieces[:-1]) for x in reader.feed(piece)]
        reader.close()
        assert [(at, data[at : at + n].endswith(b"\r\n\r\n"), found) for at, n, _, found in got] == [(len(data) // 3 * k, True, block) for k in range(3)]


def test_loser_tree():
    rng = random.Random(1)
    for k in range(9):
        runs = [sorted((rng.randrange(20), i, j) for j in range(rng.randrange(6))) for i in range(k)]
        assert list(warc.loser_tree([[(x, x) for x in r] for r in runs])) == sorted(x for r in runs for x in r)


def test_language_id(spark, docs, nothing):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.learn(real)
    found = language_id.identify(real, model).join(real.select("doc_id", "lang", language_id.held_out().alias("held")), "doc_id").where("held")
    assert found.where("lang = lang_pred").count() > 0.97 * found.count()
    odd = {r["doc_id"]: r for r in language_id.identify(docs, model).where("doc_id between 100 and 109").collect()}
    assert [odd[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3
    assert odd[105]["n_words"] == 30_000 and 0 < odd[105]["score"] <= 1
    de, fr = ("{}".format(real.where(f"lang = '{x}'").orderBy(F.desc("n_chars")).first()["text"])[:1500] for x in ("de", "fr"))
    spans = language_id.identify(spark.createDataFrame([(1, de + " " + fr), (2, "12 34 --")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [s["lang"] for s in spans[0]["spans"]] == ["de", "fr"]
    assert spans[0]["spans"][0]["last"] + 1 == spans[0]["spans"][1]["first"]
    assert spans[1]["lang_pred"] == "und" and spans[1]["score"] == 0
    empty = language_id.learn(nothing)
    assert {r["lang_pred"] for r in language_id.identify(docs, empty).collect()} == {"und"}
    assert language_id.identify(nothing, model).count() == 0


def test_language_against_plain_python(spark):
    """Counts, odds, scripts and the best path of every text, by plain Python and all labellings."""
    from itertools import product

    rng = random.Random(17)
    letters = {"aa": "abcd", "bb": "bcde", "cc": "абвг"}
    texts = []
    for k in range(60):
        lang = rng.choice(sorted(letters))
        texts.append((k, " ".join("".join(rng.choice(letters[rng.choice([lang, lang, lang, "bb"])]) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(0, 7))), lang if k % 9 else None))
    texts += [(70, None, "aa"), (71, "½ ² Ⅷ ① 12 !", "bb"), (72, "½ abcd", "aa"), (None, "абвг abcd", "cc"), (73, "ébc", None), (3, texts[3][1], "bb")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    got = Counter((r["doc_id"], r["lang_pred"], round(r["score"], 6), r["n_words"]) for r in language_id.identify(docs, language_id.learn(docs), penalty=0.8).collect())

    def buckets(word):
        framed = b" " + word + b" "
        return [((int.from_bytes(framed[i : i + n], "big") + (n << 40)) * 0x9E3779B97F4A7C15 % (1 << 64)) >> 48 for n in (2, 3, 4) for i in range(len(framed) - n + 1)]

    langs = sorted({lang for i, t, lang in texts if lang and t is not None and not (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)})
    counts, scripts = {x: Counter() for x in langs}, {x: Counter() for x in langs}
    for i, t, lang in texts:
        if lang and t is not None and not (i is not None and zlib.crc32(str(i).encode()) % 4 == 2):
            for w in language_id.words_of(t.encode()):
                counts[lang].update(buckets(w))
                scripts[lang][language_id.script_of(w)] += 1
    total = {x: sum(counts[x].values()) + 0.5 * language_id.BUCKETS for x in langs}

    def word_scores(word):
        if not any(map(str.isalpha, word.decode())):
            return [0.0] * len(langs)
        out = [0.0] * len(langs)
        for b in buckets(word):
            if any(counts[x][b] for x in langs):
                logs = [math.log((counts[x][b] + 0.5) / total[x]) for x in langs]
                out = [o + (v - sum(logs) / len(logs)) / 3 for o, v in zip(out, logs)]
        script = language_id.script_of(word)
        ok = [scripts[x][script] / max(1, sum(n for k, n in scripts[x].items() if k >= 0)) >= 0.001 for x in langs]
        return [o - (0 if fine or not any(ok) else 30) for o, fine in zip(out, ok)]

    want = Counter()
    for i, t, _ in texts:
        of = language_id.words_of(raw(t)) if any(map(str.isalpha, t or "")) else []
        if not of:
            want[i, "und", 0.0, 0] += 1
            continue
        rows = [word_scores(w) for w in of]
        path = max(product(range(len(langs)), repeat=len(of)), key=lambda p: sum(r[x] for r, x in zip(rows, p)) - 0.8 * sum(a != b for a, b in zip(p, p[1:])))
        n = [path.count(k) for k in range(len(langs))]
        want[i, langs[n.index(max(n))], round(max(n) / len(path), 6), len(of)] += 1
    assert got == want


def test_viterbi():
    rng = np.random.default_rng(3)
    texts = [rng.normal(size=(n, 3)).astype(np.float32) for n in (0, 1, 5, 6, 6, 3)]
    from itertools import product

    for scores, path in zip(texts, language_id.label_words(texts, 0.7), strict=True):
        value = lambda p, s=scores: sum(s[i, x] for i, x in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:]))
        assert len(path) == len(scores)
        assert not len(path) or abs(value(path.tolist()) - max(map(value, product(range(3), repeat=len(scores))))) < 1e-5


def test_quality(spark, docs, rows, nothing):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    given = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    labels = given.withColumnRenamed("toxic", "is_toxic")
    got = quality.score_quality(real, given).join(labels, "doc_id")
    good = got.where("quality = 1 and is_toxic = 0")
    assert good.where("kept").count() > 0.98 * good.count()
    poor = got.where("quality = 0")
    assert poor.where("not kept").count() > 0.9 * poor.count()
    assert quality.score_quality(docs).count() == len(rows)
    assert quality.score_quality(nothing).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == quality.score_quality(docs).where("kept").count()
    odd = spark.createDataFrame([(1, 1), (None, 1), (3, None), (500, 1), (1, 0)], "doc_id long, toxic int")
    assert quality.score_quality(docs, odd).count() == len(rows)
    assert not quality.learn_insults(nothing, odd).taught and not quality.learn_insults(docs, odd.limit(0)).taught
    taught = spark.createDataFrame([(i, ("grumbel " if i % 3 == 0 else "") + f"plain word{i}") for i in range(60)], "doc_id long, text string")
    learned = quality.learn_insults(taught, taught.selectExpr("doc_id", "int(doc_id % 3 = 0) AS toxic"))
    assert {x for x, kind in learned.words.items() if kind == quality.LEARNED} == {b"grumbel"}


def test_single_words_do_not_decide(spark):
    """Plain sentences with a word that may insult stay; insults in other languages go. Fitted to sf0.01 with its labels."""
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    given = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    clean = real.join(given.where("toxic = 0 and quality = 1"), "doc_id").orderBy("doc_id").first()["text"]
    plain = ["Please take the trash out on Monday.", "The circus clown made the children laugh.", "A moron is also the name of a small sea worm."]
    rude = ["You are a worthless idiot, really", "Eres un hijo de puta y te odio, imbécil de mierda.", "Du bist ein Arschloch und ein Hurensohn"]
    texts = [(kind, lead + x) for kind, some in ((False, plain), (True, rude)) for x in some for lead in ("", clean + " ")]
    extra = spark.createDataFrame([(10**9 + k, x) for k, (_, x) in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"] - 10**9: r["toxic"] for r in quality.score_quality(real.unionByName(extra), given).where("doc_id >= 1000000000").collect()}
    assert got == {k: kind for k, (kind, _) in enumerate(texts)}


def test_features_of_all_shapes():
    """Neither a text's rarer shapes nor the far end of a long one are left out of its features."""
    many = [b"," * k + b"a" + b"." * j for k in range(8) for j in range(8)]
    found = [quality.measure(b" ".join([*many, *many, x]))[1] for x in (b"-x-", b"+x+")]
    assert found[0] != found[1]
    assert len(found[0]) > 60
    found = [quality.measure(b"a0" * 9 + x)[1] for x in (b"-", b"+")]
    assert found[0] != found[1]


def test_votes_on_civility():
    taught = quality.Insults({b"grumbel"})
    for text, votes, hits in [
        (b"", [-1, 1, 1, -1, -1, -1], 0), (b"You IDIOT!", [-1, -1, 1, 0, -1, -1], 1), (b"You clown", [-1, -1, 1, -1, -1, -1], 1), (b"grumbel", [-1, -1, -1, -1, -1, -1], 1), (b"grumbel grumbel", [-1, -1, 0, -1, 0, -1], 2),
        (b"trash and a clown", [0, 0, 1, -1, 0, -1], 2), (b"I will kill you", [-1, -1, 1, 0, -1, 0], 1), (b"kill the lights before you go out", [-1, 1, 1, -1, -1, -1], 0), (b"idiocy is plural", [-1, 1, 1, -1, -1, -1], 0),
        (b"idiot idiot " + b"calm words here " * 100, [0, -1, 1, -1, -1, -1], 2),
    ]:
        got = quality.uncivil(text, taught)
        assert (got[0], got[2]) == (votes, hits), text
    assert quality.uncivil(b"calm", quality.Insults())[0] == [-1, 1, -1, -1, -1, -1]
    assert quality.uncivil("Eres IMBÉCIL".encode(), quality.Insults())[0][3] == 0


def plain_quality(spark, rows):
    """EM and both scorers written out in plain Python over the votes and features of every (doc_id, text): the posteriors and
    scores of form and of civility by row."""
    insults = quality.Insults()
    key = {(r["id"], r["text"]): (r["h"], r["key"]) for r in spark.createDataFrame(rows, "id long, text string").selectExpr("id", "text", "xxhash64(id, xxhash64(text)) AS h", "xxhash64(text) AS key").collect()}
    in_order = sorted(rows, key=lambda r: (key[r][0], r[0] is not None, r[0] or 0, key[r][1]))

    def chances(of):
        votes = {r: quality.signs(of(raw(r[1]))[0]) for r in rows}
        times, n = Counter(votes[r] for r in rows), len(next(iter(votes.values())))
        good = {v: 0.05 if "0" in v else 0.95 for v in times}
        for _ in range(50):
            prior = min(0.95, max(0.05, sum(good[v] * k for v, k in times.items()) / len(rows)))
            logs = []
            for share in (lambda v: 1 - good[v], lambda v: good[v]):
                table = [{x: 0.5 + sum(share(v) * k for v, k in times.items() if v[at] == x) for x in "01-"} for at in range(n)]
                logs.append({v: sum(math.log(table[at][v[at]] / sum(table[at].values())) for at in range(n)) for v in times})
            good = {v: 1 / (1 + math.exp(max(-500, min(500, logs[0][v] + math.log(1 - prior) - logs[1][v] - math.log(prior))))) for v in times}
        w, seen = defaultdict(float), defaultdict(lambda: 1e-6)
        for _ in range(30):
            slope = Counter()
            for r in in_order:  # fewer than one minibatch
                f = {**of(raw(r[1]))[1], quality.BUCKETS: 1.0}
                miss = 1 / (1 + math.exp(-sum(w[k] * v for k, v in f.items()))) - good[votes[r]]
                for k, v in f.items():
                    slope[k] += miss * float(np.float32(v)) / len(rows)
            for k, v in slope.items():
                v += 1e-4 * w[k]
                seen[k] += v * v
                w[k] -= 0.1 * v / math.sqrt(seen[k])
        return {r: (good[votes[r]], 1 / (1 + math.exp(-sum(w[k] * v for k, v in {**of(raw(r[1]))[1], quality.BUCKETS: 1.0}.items())))) for r in rows}

    return chances(quality.measure), chances(lambda x: quality.uncivil(x, insults))


def test_quality_against_plain_python(spark):
    """Posteriors, scores and decisions of every text."""
    rng = random.Random(21)
    rows = [(k, words(rng, rng.randrange(1, 40)) + rng.choice(["", " idiot", " you stupid scum", " a filthy trash clown", " | | | ###"])) for k in range(120)] + [(7, None), (None, ""), (9, "a a a a a a a a a a a a a")]
    got = quality.score_quality(spark.createDataFrame(rows, "doc_id long, text string").withColumn("votes", F.lit("x")), threshold=0.6)
    form, civil = plain_quality(spark, rows)
    want = Counter((r[0], round(form[r][0], 4), round(form[r][1], 4), round(1 - civil[r][1], 4), civil[r][1] <= 0.5, form[r][1] >= 0.6 and civil[r][1] > 0.5) for r in rows)
    assert Counter((r["doc_id"], round(r["posterior"], 4), round(r["quality_score"], 4), round(r["toxicity"], 4), r["toxic"], r["kept"]) for r in got.collect()) == want
    assert {k[4] for k in want} == {True, False} == {k[5] for k in want}


def test_posteriors():
    got = quality.posteriors({"11": 80, "00": 15, "0-": 5, "-1": 20})
    assert got["11"] > 0.9 > 0.1 > got["00"]
    assert quality.posteriors({}) == {}


def test_pipeline(spark):
    """Stage by stage against brute force over what the stage was given."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r["item_id"], decontaminate.normal(raw(r["text"]))) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    kept = [{(r["doc_id"], r["text"]) for r in docs.collect()}]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = common.stored(stage(spark, docs, SF), "test-stage")
        assert out.columns == docs.columns
        docs = out
        kept.append({(r["doc_id"], r["text"]) for r in docs.collect()})
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = {r["doc_id"] for r in quality.score_quality(spark.read.parquet(f"{SF}/documents.parquet"), labels).where("kept").collect()}
    assert kept[1] == {x for x in kept[0] if x[0] in scored}
    top = {}
    for i, t in kept[1]:
        top[t] = max(top.get(t, -1), i)
    assert kept[2] == {(i, t) for t, i in top.items()}
    assert kept[3] == {(i, t) for i, t in kept[2] if any(k[0] == i == k[2] for k in linked([(a, b, None) for a, b in kept[2]]))}
    assert kept[4] == {(i, t) for i, t in kept[3] if not any(x in decontaminate.normal(raw(t)) for _, x in bench)}
    final = corpus_pipeline.run(spark, SF)
    assert counted(final, "doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset") == packed(kept[4], 2048)
    ids = sorted((r["sequence_id"], r["length"]) for r in final.collect())
    assert [x for x, _ in ids] == list(range(len(ids))) and [n for _, n in ids] == sorted(n for _, n in ids)


def test_first_stage_against_plain_python(spark, tmp_path):
    """What the classifier's stage keeps, by plain Python, of a table with nulls, repeats and clashing columns; no labels."""
    import corpus_pipeline

    rng = random.Random(22)
    rows = [(k, words(rng, rng.randrange(1, 60)) + rng.choice(["", "", " you idiot", " you stupid scum", " | | | ###"])) for k in range(150)] + [(7, None), (None, ""), (9, "a a a a a a a a a a a a a"), (3, "The end.")]
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"file://{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("votes", "kept", "id")})
    out = corpus_pipeline.classify(spark, docs, f"file://{tmp_path}")
    form, civil = plain_quality(spark, rows)
    want = Counter(r for r in rows if form[r][1] >= 0.5 and civil[r][1] > 0.5)
    assert out.columns == docs.columns and Counter((r["doc_id"], r["text"]) for r in out.collect()) == want
    assert 0 < sum(want.values()) < len(rows)
