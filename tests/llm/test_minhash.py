import random
import re

import numpy as np
import pytest

from tessera.llm import minhash
from tessera.llm.minhash import CHUNKS, SYMBOLS, WIDTH, Settings, chunk_keys, first_key, keep_representatives, near_duplicates

SCHEMA = "doc_id long, text string, component_id string, kept int, n_shingles int, sig string, key string, rep string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, k):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if None not in (i, j) and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return sorted(((i, len(s), None if i is None else find(i), i is not None and find(i) == i) for i, s in sets), key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ünïcode", "UPPER", "x" * 300]
    rows, bases = [], [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 60, 200]))] for _ in range(12)]
    for i in range(150):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i * 3 % 151, rng.choice([" ", "\n", "\t \v"]).join(words)))
    return rows + [(1000, None), (1001, ""), (1002, " \n "), (None, "w1 w2 w3"), (None, None), (1003, "THE w1"), (1004, "the W1")]


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_equals_brute_force(spark, k, percent):
    rows = corpus(k)
    df = spark.createDataFrame([(i, t, "x", 1, 2, "s", "k", "r") for i, t in rows], SCHEMA)
    got = near_duplicates(df, Settings(k, percent))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, k, percent)


def test_blocks_of_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.choice([2, 3, 5, 7])):
            words[rng.randrange(100)] = f"v{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Settings(3, 85))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 3, 85)


def test_empty_table_and_repeated_rows(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]
    got = [tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]


def test_keys_cover_the_radius():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 16, (300, SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for k in range(300):
        at = rng.choice(SYMBOLS, 2 * CHUNKS - 1, replace=False)
        b[k, at] ^= 1
    shared = chunk_keys(a) == chunk_keys(b)
    assert shared.any(1).all()
    assert (shared.argmax(1) == first_key(a != b)).all()
    assert WIDTH * CHUNKS == SYMBOLS


def test_representatives(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(5, text, "a"), (3, text + " x", "b"), (9, "other words here and more of them", "c"), (7, None, "d"), (None, text, "e"), (8, "", None)]
    got = keep_representatives(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert got.columns == ["doc_id", "text", "lang"]
    assert sorted(str(r.doc_id) for r in got.collect()) == ["3", "7", "8", "9", "None"]


def test_texts_that_only_share_an_id(spark):
    text = lambda p: " ".join(f"{p}{i}" for i in range(50))
    rows = [(1, text("a")), (1, text("b")), (2, text("a") + " x"), (3, text("b")), (4, text("c")), (4, text("c")), (4, None), (5, text("d")), (5, text("d") + " y"), (6, text("d"))]
    df = spark.createDataFrame([(*r, 7, "k", "r") for r in rows], "doc_id long, text string, _id int, _once string, rest string")
    want = [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (4, 4), (5, 5), (5, 5), (6, 5)]
    got = near_duplicates(df)
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == want
    kept = keep_representatives(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text or "", r["_id"], r["_once"], r.rest) for r in kept.collect()) == sorted((i, t or "", 7, "k", "r") for i, t in [rows[0], rows[1], rows[4], rows[6], rows[7]])
    hot = [(1, text("a")), (1, text("b"))] * 500 + [(2, text("a"))]
    assert keep_representatives(spark.createDataFrame(hot, "doc_id long, text string")).count() == 2
