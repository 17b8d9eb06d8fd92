"""Spelling variants, importance resampling and decontamination against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings as limits, strategies as st

from tessera.llm import decontamination, importance, spelling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(0x41, 0x5B)}


def words_of(text):
    return WORD.findall((text or "").translate(UPPER))


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as word", "1 as h", "2 as k1", "3 as n", "'y' as window")


# ------------------------------------------------------------------ spelling


def variants(rows, rule):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if rule.every and h % rule.every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= rule.length and n >= rule.occurs}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    form, found = {}, {}
    for w, n in words.items():
        others = [x for x in words if x != w and near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= rule.ratio * n else None
        found[w] = len(others)
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, found[w], words.get(form[w])))
    return sorted(out, key=str)


def spelled(spark, rows, rule):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.variants(docs_of(spark, rows), rule).collect()), key=str)


def test_spelling_variants(spark):
    rng = random.Random(3)
    base = ["banana", "kettle", "letters", "élèvés", "aaaaaa", "straße"]
    def slip(w):
        k = rng.randrange(len(w))
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abé") + w[k:], w[:k] + rng.choice("abé") + w[k + 1 :]])
    pool = base * 25 + [slip(w) for w in base for _ in range(12)] * 2
    pool += [slip(slip(w)) for w in base for _ in range(12)]
    rows = [(i % 5 if i else None, " ".join(rng.choice([w, w.upper(), w.capitalize()]) for w in rng.choices(pool, k=60))) for i in range(40)]
    rows += [(1, None), (2, ""), (3, "1234 ..."), (4, "banana" * 3000)]
    rule = spelling.Settings(length=5, occurs=1, ratio=2, every=7)
    want = variants(rows, rule)
    assert spelled(spark, rows, rule) == want
    assert sum(r[1] is not None for r in want) > 20 and sum(r[1] is not None and r[1] != r[2] for r in want) > 3


def test_spelling_ties_chains_and_no_words(spark):
    rows = [(1, "bottle " * 400 + "bottlé " * 80 + "bottéé " * 16 + "boteéé " * 3), (2, "cattle cattlx cattly " * 9 + "cattlz")]
    rule = spelling.Settings(every=0, occurs=1)
    got = {r[0]: r for r in spelled(spark, rows, rule)}
    assert got["boteéé"][1:3] == ("bottéé", "bottle") and got["bottéé"][2] == "bottle" and got["bottle"][1] is None
    assert got["cattlz"][1:] == ("cattle", "cattle", 1, 3, 9) and got["cattlx"][1] is None and got["cattlx"][4] == 3
    assert spelled(spark, [(1, None)], rule) == [] == spelled(spark, [], rule)


# ---------------------------------------------------------------- importance


def drawn(rows, target, rule):
    def feats(text):
        w = [x.encode() for x in words_of(text)]
        return len(w), [zlib.crc32(b" ".join(w[i : i + n])) % rule.buckets for n in range(1, rule.runs + 1) for i in range(len(w) - n + 1)]

    found = [feats(t) for _, t in rows]
    s, t = Counter(b for _, f in found for b in f), Counter(b for x in target for b in feats(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for (i, _), (n, f) in zip(rows, found):
        gain = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + rule.buckets) / ((s[b] + 1) * (big_t + rule.buckets)))) for b in f)
        weight = gain // len(f) if f else 0
        h = int(hashlib.sha256(f"{rule.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n])
    able = sorted((k for k, r in enumerate(out) if r[4] >= rule.least_words), key=lambda k: (-out[k][3], out[k][0] is not None, out[k][0] or 0, out[k][1], out[k][2]))
    rank = {k: place for place, k in enumerate(able[: len(able) * rule.percent // 100], 1)}
    return [("" if r[0] is None else r[0], *r[1:4], rank.get(k)) for k, r in enumerate(out)]


@pytest.mark.parametrize("rule", [importance.Settings(least_words=5, percent=30), importance.Settings(buckets=97, runs=3, least_words=3, percent=50, seed=7)])
def test_importance_resampling(spark, rule):
    rng = random.Random(5)
    pool = "the of and reactor sum naïve 日本 x1 Über theorem proof".split()
    texts = [" ".join(rng.choices(pool, k=rng.randrange(30))) for _ in range(150)] + [None, "", " .,", "w" * 9000, "one two\n" * 4000]
    rows = [(i % 140 if i != 3 else None, t) for i, t in enumerate(texts)]
    target = ["proof of the theorem", None, "sum of the theorem and the proof", ""]
    got = importance.scored(docs_of(spark, rows), spark.createDataFrame([(x,) for x in target], "text string"), rule).collect()
    got = [tuple("" if k == "doc_id" and v is None else v for k, v in r.asDict().items()) for r in got]
    assert sorted(got, key=str) == sorted(drawn(rows, target, rule), key=str)
    assert sum(r[4] is not None for r in got) > 10


def test_resampled_rows(spark):
    rows = [(i, f"word{i % 7} and more " * 10) for i in range(50)] + [(None, "word1 " * 30)]
    target = spark.createDataFrame([("word3 word3 and",)], "text string")
    docs = docs_of(spark, rows).selectExpr("*", "1 as drawn_id")
    out = importance.resampled(docs, target)
    assert out.columns == docs.columns
    want = {r.doc_id for r in importance.scored(docs, target).where("rank is not null").collect()} - {None}
    assert {r.doc_id for r in out.collect()} == want and 0 < len(want) <= 5
    nothing = target.limit(0)
    assert importance.scored(docs.limit(0), target).count() == 0 and importance.scored(docs, nothing).count() == 51
    with pytest.raises(ValueError):
        importance.Settings(buckets=70_000)


@given(st.lists(st.binary(max_size=90), max_size=40))
@limits(max_examples=60, deadline=None)
def test_checksums_of_spans(parts):
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts]).astype(np.int64)
    starts = ends - [len(p) for p in parts]
    assert importance.span_crcs(data, starts, ends).tolist() == [zlib.crc32(p) for p in parts]


# ----------------------------------------------------------- decontamination


def contaminated(rows, items, width):
    held = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        for k in range(max(0, len(w) - width) + 1 if w else 0):
            held[tuple(w[k : k + width])].add(item)
    out = []
    for i, text in rows:
        w, hit, found = words_of(text), set(), set()
        for n in {len(x) for x in held}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in held:
                    hit.update(range(k, k + n))
                    found |= held[tuple(w[k : k + n])]
        found = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("rule", [decontamination.Settings(), decontamination.Settings(width=4, shingle=2), decontamination.Settings(width=3, shingle=1)])
def test_decontamination(spark, rule):
    rng = random.Random(9)
    pool = ["a", "B", "cé", "日本", "d4", "E", "x-y", "f,", "g\n"]
    items = [(i % 30, " ".join(rng.choices(pool, k=rng.choice([0, 1, 2, 3, 5, 12, 25])))) for i in range(1, 34)]
    items = [x for x in items if len(words_of(x[1])) != 1 or rng.random() < 0.3] + [(None, "null item of four"), (77, None), (78, "!!")]
    rows = []
    for i in range(60):
        parts = [" ".join(rng.choices(pool + ["rare", "other"], k=rng.randrange(25)))]
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items)[1] or "").split(" ")
            k = rng.randrange(len(w))
            parts += [" ".join(w[k : k + rng.choice([3, 9, 10, 11, 25])]), rng.choice(pool)]
        rows.append((i % 50, " ".join(parts)))
    rows += [(90, None), (91, ""), (92, " ,."), (None, items[1][1]), (93, "null ITEM of four"), (94, "E x f " * 4000)] + rows[:3]
    got = decontamination.report(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'z' as item", "1 as n"), rule)
    got = sorted((tuple(r) for r in got.collect()), key=str)
    want = contaminated(rows, items, rule.width)
    assert got == want and 5 < sum(r[5] for r in want) < len(want)


def test_decontamination_of_empty_tables(spark):
    docs, items = docs_of(spark, [(1, "some words here")]), spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert [tuple(r)[1:4] for r in decontamination.report(docs, items.limit(0)).collect()] == [(3, 0, 0)]
    assert [tuple(r)[1:4] for r in decontamination.report(docs, items).collect()] == [(3, 2, 1)]
    assert decontamination.report(docs.limit(0), items).count() == 0


def test_a_passage_of_many_documents_and_items(spark):
    """Starts are bounded by the places of shingles, not by documents times items."""
    passage = " ".join(f"p{k}" for k in range(14))
    rows = [(i, f"{passage} own{i}") for i in range(300)]
    items = [(i, f"{passage} item{i}") for i in range(200)]
    found, _ = decontamination.passages(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert found.count() == 300 * 5
    got = decontamination.report(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.n_hit, r.n_items) for r in got} == {(14, 200)}
