"""Operators on texts and groups against brute force; nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.llm.leakage import RUN, at_ends, leaked_items, winnow, words_of
from memlake.llm.neardup import expand_pairs, similar_texts
from memlake.llm.spans import CUT, LENGTH, cuts, merged_spans, shared_spans
from memlake.llm.tokens import FOLDER, PATTERN, byte_characters, byte_level, decode, encode, encode_offsets
from memlake.llm.topn import above_floors, latest_candidates, score_bucket, top_n

TOKENIZER = f"{FOLDER}/byte_bpe_50k.json"
needs_tokenizer = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer file")


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


# ---- near-duplicate texts


def word_pairs(texts, least):
    sets = [(i, frozenset(words_of(t))) for i, t in texts if i is not None]
    sets = [(i, s) for i, s in sets if s]
    return {(min(a, b), max(a, b)) for a, s in sets for b, t in sets if a != b and len(s & t) / len(s | t) >= least}


@pytest.mark.parametrize("least", [0.7, 0.8])
def test_similar_texts(spark, least):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(120):
        base = r.sample(vocabulary, r.choice([1, 2, 3, 5, 12, 20, 30, 45]))
        texts.append((3 * i, " ".join(base)))
        edited = [w for w in base if r.random() > 0.1] + r.sample(vocabulary, r.choice([0, 0, 1, 2]))
        r.shuffle(edited)
        texts.append((3 * i + 1, " - ".join(edited).upper()))
    texts += [(1_000, None), (1_001, ""), (1_002, "--- ..."), (1_003, "Ünïcode wörds ẞ"), (1_004, "ünïcode WÖRDS ß"), (None, "w1 w2"), (1_005, " ".join(vocabulary * 50)), (1_006, " ".join(vocabulary[:55]))]
    texts += texts[:9]
    df = spark.createDataFrame(texts, "id long, text string").withColumn("head", F.lit(1))
    assert set(rows(expand_pairs(*similar_texts(df, least)))) == word_pairs(texts, least)


def test_similar_texts_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "id long, text string")
    assert rows(expand_pairs(*similar_texts(df))) == []
    with pytest.raises(ValueError):
        similar_texts(df, 0.5)


# ---- top n


@pytest.mark.parametrize("broadcast", [1, 7, 200_000])
def test_top_n_of_more_groups_than_are_broadcast(spark, broadcast):
    """Whatever the bound on what is broadcast: the threshold comes before any shuffle of the rows, and the result is the same."""
    g = np.random.default_rng(5)
    data = [(int(k), i, float(s)) for i, (k, s) in enumerate(zip(np.minimum(g.zipf(1.6, 4_000), 300), g.gamma(2, size=4_000)))] + [(None, 9_000 + i, float(i)) for i in range(20)] + [(900 + i, 9_100 + i, 1e-9) for i in range(5)]
    df = spark.createDataFrame(data, "g long, i long, s double").withColumn("_bucket", score_bucket(F.col("s")))
    kept = above_floors(df, "g", 3, broadcast)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    left, want = defaultdict(list), defaultdict(list)
    for k, i, s in rows(kept, "g", "i", "s"):
        left[k].append((-s, i))
    for k, i, s in data:
        want[k].append((-s, i))
    assert all(sorted(left[k])[:3] == sorted(want[k])[:3] for k in want)
    if broadcast >= 7:
        assert sum(map(len, left.values())) < 0.6 * len(data)


def test_top_n(spark):
    r = random.Random(5)
    data = [(f"g{i % 7}" if i % 13 else None, f"i{i}", r.choice([0.0, 0.5, 0.25, r.random(), -r.random(), float("inf")]), r.choice([None, 1, 2])) for i in range(900)]
    data += [("g1", "n", None, 1), ("g1", "nan", float("nan"), 1), ("lonely", "a", 0.1, None)]
    data += [("hot", f"h{i}", 0.75, 1) for i in range(500)]
    df = spark.createDataFrame(data, "g string, i string, s double, p int").withColumn("rank_", F.lit(1))
    found = defaultdict(list)
    for g, i, k in sorted(rows(top_n(df, "g", "s", [F.col("p").asc_nulls_last(), F.col("i")], 5), "g", "i", "rank"), key=lambda x: (str(x[0]), x[2])):
        found[g].append(i)
    want = defaultdict(list)
    for g, i, s, p in sorted((x for x in data if x[2] is not None and x[2] == x[2]), key=lambda x: (-x[2], x[3] is None, x[3] or 0, x[1])):
        if len(want[g]) < 5:
            want[g].append(i)
    assert found == want
    assert rows(top_n(df.limit(0), "g", "s", [F.col("i")])) == []


def test_buckets_keep_the_order(spark):
    values = sorted([-(10.0**k) for k in range(-300, 300, 7)] + [10.0**k for k in range(-300, 300, 7)] + [0.0, float("inf"), float("-inf"), 5e-324])
    got = [x[0] for x in spark.createDataFrame([(v,) for v in values], "s double").coalesce(1).select(score_bucket(F.col("s"))).collect()]
    assert got == sorted(got)


def test_latest_candidates(spark):
    import datetime as dt

    t = [dt.datetime(2025, 1, k) for k in (1, 2)]
    data = [("r", "k", "c", 0.9, 1, t[0]), ("r", "k", "c", 0.1, 2, t[1]), ("r", "k", "c", 0.1, 2, t[1]), ("r", "k", "d", 0.3, None, None), ("r", None, "d", 0.3, None, t[0])]
    df = spark.createDataFrame(data, "retrieval_id string, candidate_kind string, candidate_id string, rrf_score double, selected_position int, loaded_at timestamp")
    assert rows(latest_candidates(df), "candidate_kind", "candidate_id", "rrf_score") == [("k", "c", 0.1), ("k", "d", 0.3), (None, "d", 0.3)]


# ---- tokens

TEXTS = ["", None, "Hello world", "  spaces \t\n\n tabs  ", "naïve 漢字 🙂🙂‍🙂 é", "<|endoftext|> <|startoftext|>", "a" * 5_000, "1" * 3_000, "\x00\x07﻿​", "don't we'll I'VE", "x \n", " "]


@needs_tokenizer
def test_tokens_of_other_files(spark):
    """Each kind of public file gives its library's ids; files without a place in the bytes can't be decoded here."""
    import base64

    import sentencepiece
    import tiktoken
    from tokenizers import Tokenizer

    texts = ["Hello, the World's 12 Größen!", "", None, "  a\tb\n", "日本語 text", "word" * 50, "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{FOLDER}/byte_bpe_multi_50k.tiktoken", "rb"))}
    ordinary = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    words = Tokenizer.from_file(f"{FOLDER}/word_bpe_49k.json")
    words.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=f"{FOLDER}/piece_bpe_32k.model")
    for name, ids in (("byte_bpe_multi_50k.tiktoken", ordinary), ("word_bpe_49k.json", lambda t: words.encode(t, add_special_tokens=False).ids), ("piece_bpe_32k.model", pieces.encode)):
        found = dict(rows(encode(df, tokenizer=f"{FOLDER}/{name}")))
        assert all(found[i] == (ids(t) if t else []) for i, t in enumerate(texts)), name
    assert byte_level(TOKENIZER) and not byte_level(f"{FOLDER}/word_bpe_49k.json")
    with pytest.raises(Exception, match="no byte-level BPE"):
        rows(decode(spark.createDataFrame([(1, [5])], "doc_id long, ids array<int>"), tokenizer=f"{FOLDER}/word_bpe_49k.json"))


@needs_tokenizer
def test_tokens(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    plain.encode_special_tokens = True
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("key", F.lit(1))
    ids = encode(df)
    for i, found in rows(ids):
        assert found == plain.encode(TEXTS[i] or "", add_special_tokens=False).ids
    assert [t for _, t in sorted(rows(decode(ids)))] == [t or "" for t in TEXTS]
    for i, found, at, chars in rows(encode_offsets(df)):
        text = TEXTS[i] or ""
        assert len(found) == len(at) == len(chars)
        for b, c in zip(at, chars):
            assert len(text.encode()[:b].decode("utf-8", "ignore")) == c
    assert rows(encode(df.limit(0))) == []
    nulls = spark.createDataFrame([(1, None), (2, []), (3, [0])], "doc_id long, ids array<int>")
    assert rows(decode(nulls)) == [(1, None), (2, ""), (3, "!")]


def test_byte_characters():
    table = byte_characters()
    assert len(table) == 256 and sorted(table.values()) == list(range(256)) and table["!"] == 33 and table["Ġ"] == 32


# ---- leakage


def leaks(texts, items):
    found = set()
    for i, item in items:
        w = words_of(item)
        n = min(RUN, len(w))
        for d, t in texts:
            words = words_of(t)
            runs = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
            if w and any(tuple(w[k : k + n]) in runs for k in range(len(w) - n + 1)):
                found.add((i, d))
    return found


@pytest.mark.parametrize("known", [100_000, 0])
def test_leaks(spark, known):
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 9, 12, 13, 14, 20, 40, 60])]
    items += [(50, None), (51, ""), (52, "..."), (53, "same " * 30), (54, "A_b-C")]
    texts = []
    for d in range(150):
        words = [r.choice(vocabulary) for _ in range(r.choice([0, 3, 30, 200]))]
        w = words_of(r.choice(items)[1])
        if w and r.random() < 0.7:
            a = r.randrange(len(w))
            k = r.randrange(len(words) + 1)
            words[k:k] = w[a : a + r.choice([5, 12, 13, 14, 60])]
        texts.append((d, " ".join(words).upper().replace(" ", r.choice([" ", "_", ", "]))))
    texts += [(900, None), (901, ""), (902, "same " * 13), (903, "same " * 12), (904, "x a b c y")]
    schema = "id long, text string"
    found = rows(leaked_items(spark.createDataFrame(texts, schema), spark.createDataFrame(items, schema), known))
    assert {(i, d) for i, d, *_ in found} == leaks(texts, items)
    assert len(found) == len({(i, d) for i, d, *_ in found})
    by = dict(texts)
    for i, d, n, q, p in found:
        assert words_of(dict(items)[i])[q : q + n] == words_of(by[d])[p : p + n]


def test_leaks_of_nothing(spark):
    none = spark.createDataFrame([], "id long, text string")
    one = spark.createDataFrame([(1, "a b c")], "id long, text string")
    assert rows(leaked_items(none, one)) == rows(leaked_items(one, none)) == rows(leaked_items(none, none)) == []


def test_repetitions_keep_two_places(spark):
    """Texts of one repeated word, alone, before, after or between others: few places are kept, no shared run is lost."""
    g = random.Random(4)
    words = ["la"] * 6 + ["x", "y", "z"]
    items = [" ".join(g.choice(words[-3:]) for _ in range(g.randrange(0, 9))) + " la" * g.randrange(0, 25) + " " + " ".join(g.choice(words) for _ in range(g.randrange(0, 12))) for _ in range(40)]
    texts = [" ".join(g.choice(words) for _ in range(g.randrange(0, 14))) + " la" * g.randrange(0, 30) + " " + " ".join(g.choice(words[-3:]) for _ in range(g.randrange(0, 9))) for _ in range(60)]
    texts += ["la " * 2_000, items[3] + " end " + items[5]]
    frame = lambda x: spark.createDataFrame(list(enumerate(x)), "id long, text string")
    want = set()
    for i, item in enumerate(items):
        w = words_of(item)
        n = min(RUN, len(w))
        for t, text in enumerate(texts):
            v = words_of(text)
            grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
            if n and any(tuple(w[k : k + n]) in grams for k in range(len(w) - n + 1)):
                want.add((i, t))
    assert set(rows(leaked_items(frame(texts), frame(items)), "item_id", "doc_id")) == want and len(want) > 200
    one = np.full(2_000, 7, np.uint64)
    assert at_ends(winnow(one, 9), one).tolist() == [0, 1_999]


def test_winnow_meets_every_window():
    g = np.random.default_rng(1).integers(0, 5, 200).astype(np.uint64)
    kept = set(winnow(g, 9).tolist())
    assert all(any(p in kept for p in range(s, s + 9)) for s in range(len(g) - 8))
    assert len(winnow(g[:8], 9)) == 0


# ---- spans


def spans(texts):
    seen = defaultdict(set)
    for d, t in texts:
        for p in range(len(t or "") - LENGTH + 1):
            seen[t[p : p + LENGTH]].add(d)
    found = set()
    for d, t in texts:
        start = end = None
        for p in range(len(t or "") - LENGTH + 1):
            if len(seen[t[p : p + LENGTH]]) > 1:
                if start is None or p > end:
                    if start is not None:
                        found.add((d, start, end))
                    start = p
                end = p + LENGTH
        if start is not None:
            found.add((d, start, end))
    return found


def test_shared_spans(spark):
    r = random.Random(2)
    letters = "abcdefghij 漢🙂é"
    draw = lambda n: "".join(r.choice(letters) for _ in range(n))
    passages = [draw(n) for n in (299, 300, 301, 350, 420, 700, 1_500)]
    texts = []
    for d in range(60):
        t = draw(r.choice([0, 10, 200, 900]))
        for _ in range(r.choice([0, 1, 2])):
            p = r.choice(passages)
            a, b = r.randrange(0, 80), r.randrange(0, 80)
            t += r.choice([p, p, p[a:], p[: len(p) - b], p[a : len(p) - b]]) + draw(r.choice([0, 5, 400]))
        texts.append((d, t))
    texts += [(100, texts[3][1]), (101, texts[3][1]), (102, None), (103, ""), (104, "0" * 1_000), (105, "x" + "0" * 450), (106, "ab" * 400), (107, "cab" + "ab" * 200), (108, passages[5] * 3), (109, "z" * 299), (110, "z" * 299)]
    data = texts + texts[:5]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("core", F.lit(1)).repartition(3)
    assert set(rows(shared_spans(df.select("doc_id", "text")))) == spans(texts)


def test_shared_spans_of_one_record(spark):
    g = random.Random(4)
    t = "".join(g.choice("abc ") for _ in range(400))
    df = spark.createDataFrame([(1, t * 3), (1, t * 3), (2, None)], "doc_id long, text string")
    assert rows(shared_spans(df)) == []
    assert rows(shared_spans(df.limit(0))) == []


def test_cuts_depend_on_the_window_alone():
    g = random.Random(6)
    text = "".join(g.choice("abcdefgh \n") for _ in range(3_000))
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    every = lambda c: list(zip(*(x.tolist() for x in cuts(c, np.ones(len(c), bool)))))
    whole, part = every(codes), every(codes[500:1_500])
    inside = [(p, e) for p, e in whole if 500 + CUT <= p < 1_500 - LENGTH]
    assert [(p + 500, e + 500) for p, e in part if CUT <= p < 1_000 - LENGTH] == inside
    assert np.diff([p for p, _ in whole]).max() <= CUT
    # chunks differ in length, are no longer than CUT, and end at cuts
    lengths = {e - p for p, e in inside}
    assert len(lengths) > 5 and min(lengths) >= 1 and max(lengths) <= CUT and {e for _, e in inside} <= {p for p, _ in whole}


def test_merged_spans(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 10, 20), (1, 2, 5), (1, 21, 30), (2, 5, 6), (2, 5, 6)], "doc_id long, s int, e int")
    assert rows(merged_spans(df)) == [(1, 0, 20), (1, 21, 30), (2, 5, 6)]
