import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import repeats
from tessera.llm.repeats import Settings, remove_repeats, repeat_report, sliding_least
from tessera.llm.run_index import RunLengthIndex, repeated_starts, suffix_array


def brute(rows, width):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + width] for _, t in texts for k in range(len(t) - width + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - width + 1):
            if seen[t[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not p for g, p in zip(gone, b"\0" + gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzéß日 \n"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [text(70) for _ in range(5)]
    rows = []
    for i in range(80):
        parts = [text(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(shared)
            a = rng.randrange(10)
            parts += [p[a : len(p) - rng.randrange(10)], text(rng.randrange(20))]
        rows.append((i, "".join(parts)))
    rows += [(100, "ab" * 60), (101, "x" * 200), (102, "x" * 30), (103, None), (104, ""), (None, rows[0][1]), (106, rows[3][1]), (107, rows[3][1]), (108, rows[4][1] * 2)]
    return rows + [rows[5], (5, "another text with the same id")]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("block", [1024, 2])
def test_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(repeats, "BLOCK", block)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, "r", "t") for i, t in rows], "doc_id long, text string, n_bytes int, row string, tag string")
    got = repeat_report(df, Settings(width=40, gram=8))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    got = got.collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows, 40)
    ascii_only = [r for r in got if len(r.text.encode()) == r.n_bytes - r.n_removed]
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in ascii_only)
    assert len(ascii_only) > 20 and all(len(r.text.encode()) >= r.n_bytes - r.n_removed for r in got)


def test_removal_keeps_characters_and_columns(spark):
    passage = "é" * 10 + "the passage that two texts share, long enough to go " * 2
    rows = [(1, "èa" + passage + "tail one", "x", None), (2, "ab" + passage + "other tail", "y", 3), (3, None, "z", 4), (4, "alone", None, 5)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, kind string, low int"), Settings(width=64, gram=16))
    assert got.columns == ["doc_id", "text", "kind", "low"]
    assert {r.doc_id: (r.text, r.kind, r.low) for r in got.collect()} == {1: ("èatail one", "x", None), 2: ("abother tail", "y", 3), 3: (None, "z", 4), 4: ("alone", None, 5)}


def test_empty_table(spark):
    assert repeat_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_words(texts, words, width=0):
    """Words (and bytes) in repeats, by every window of every text."""
    found = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for t in texts]
    named = [[t[a:b] for a, b in f] for t, f in zip(texts, found)]
    seen = Counter(tuple(n[k : k + words]) for n in named for k in range(len(n) - words + 1))
    strings = Counter(t[k : k + width] for t in texts for k in range(len(t) - width + 1)) if width else {}
    kept = []
    for t, f, n in zip(texts, found, named):
        gone = bytearray(len(t))
        spans = [(f[k][0], f[k + words - 1][1]) for k in range(len(n) - words + 1) if seen[tuple(n[k : k + words])] > 1]
        spans += [(k, k + width) for k in range(len(t) - width + 1) if width and strings[t[k : k + width]] > 1]
        for a, b in spans:
            gone[a:b] = b"\1" * (b - a)
        kept.append(bytes(c for c, g in zip(t, gone) if not g).decode())
    return kept


@pytest.mark.parametrize("block", [1024, 2])
def test_runs_of_words_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(repeats, "BLOCK", block)
    rng = random.Random(3)
    words = lambda n: [rng.choice("aé日xyz") * rng.randrange(1, 3) + rng.choice("0123456789") for _ in range(n)]
    shared = [words(24) for _ in range(4)]
    texts = []
    for _ in range(60):
        p = rng.choice(shared)
        a = rng.randrange(8)
        parts = words(rng.randrange(8)) + p[a : len(p) - rng.randrange(8)] * rng.randrange(3) + words(rng.randrange(8))
        texts.append("".join(w + rng.choice([" ", "\n", "  "]) for w in parts))
    texts += ["a " * 60, "b " * 11, "", " ", "solid" * 20, "x" + "solid" * 20]
    got = remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), Settings(width=64, gram=16, words=12, word_gram=3)).collect()
    assert [r.text for r in sorted(got)] == brute_words([t.encode() for t in texts], 12, 64)


def test_pipeline_cuts_51_short_words_and_not_50(spark):
    rng = random.Random(8)
    words = lambda n, k: " ".join("".join(rng.choice("abcdefghij") for _ in range(k)) for _ in range(n))
    long, short = words(51, 2), words(50, 2)
    assert len(long) < 256
    rows = [(i, f"{words(20, 6)} {p} {words(20, 6)}") for i, p in enumerate([long, long, short, short])]
    got = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    for i, text in rows:
        assert got[i] == (text.replace(long, "") if i < 2 else text)


def test_index_runs_and_statistics():
    rng = np.random.default_rng(0)
    for _ in range(200):
        text = np.append(rng.integers(0, rng.integers(1, 4), rng.integers(0, 40)), 255).astype(np.uint8)
        raw = text.tobytes()
        order = suffix_array(text)
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        index = RunLengthIndex(text)
        assert index.lengths.sum() == len(text) and (np.diff(index.symbols) != 0).all()
        want = [max((k for j in range(len(raw)) if j != i for k in [len_common(raw[i:], raw[j:])]), default=0) for i in range(len(raw))]
        assert index.self_statistics().tolist() == want


def len_common(a, b):
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return k


def test_matches_end_with_the_text():
    texts = np.frombuffer(b"abcabcab", np.uint8)
    assert repeated_starts(texts, np.array([0, 3, 6, 8]), 3, 255).tolist() == [True, False, False, True, False, False, False, False]


def test_sliding_least():
    values = np.random.default_rng(1).integers(0, 100, 57).astype(np.uint64)
    for m in (1, 2, 7, 57):
        assert sliding_least(values, m).tolist() == [values[i : i + m].min() for i in range(57 - m + 1)]


def test_a_passage_in_thousands_of_contexts(spark, monkeypatch):
    """More contexts than a shard is indexed with: dealt anew, twice."""
    monkeypatch.setattr(repeats, "BLOCK", 64)
    rng = random.Random(11)
    letters = "abcdefghijklmnop "
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passage = text(150)
    rows = [(i, f"{text(40)}{passage}{text(40)}") for i in range(5000)]
    got = sorted((tuple(r)[:5] for r in repeat_report(spark.createDataFrame(rows, "doc_id long, text string"), Settings(width=100, gram=12)).collect()), key=str)
    assert got == brute(rows, 100) and all(150 <= r[2] <= 160 for r in got)


def test_rows_without_an_id_and_columns_of_any_name(spark):
    rows = [(None, f"text {i} of its own", i, "k", "r") for i in range(50)] + [(None, None, 1, "k", None), (3, "x" * 300, 2, None, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _null int, rest string, others string")
    got = remove_repeats(df, Settings(width=40, gram=8))
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([*rows[:-1], (3, "", 2, None, "r")], key=str)
