import itertools
import random
import zlib

import numpy as np
import pytest

from tessera.llm import language_id as L, mixing as X

WORDS = {"en": "the of and to in is that for with this house".split(), "de": "der die und zu ist das mit für dieses haus ein".split(), "fr": "le la et de est que pour avec cette maison une".split()}


def labelled(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(3, 40))), lang))
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = labelled(300) + [(1000, None, "en"), (1001, "", "de"), (1002, "123 !?", "fr"), (1003, "日本", None), (None, "the house", "en"), (1004, "the house " * 20000, None)]
    df = spark.createDataFrame([(*r, "s", 0.5) for r in rows], "doc_id long, text string, lang string, source string, score double")
    got = L.report(df)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    out = {r.doc_id: r for r in got.collect()}
    assert len(out) == len(rows)
    truth = {i: lang for i, _, lang in rows}
    for i, r in out.items():
        assert 0 <= r.score <= 1
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0)
        if i is not None and i < 300:
            assert r.lang_pred == truth[i]
    assert [out[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert out[1003].lang_pred in WORDS and out[1004].lang_pred == "en"
    kept = L.keep_identified(df)
    assert kept.columns == df.columns and {1000, 1001, 1002, 1003}.isdisjoint(r.doc_id for r in kept.collect()) and kept.count() == len(rows) - 4


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark):
    rows = labelled(200, 1)
    wrong = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in rows]
    a = L.report(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    b = L.report(spark.createDataFrame(wrong, "doc_id long, text string, lang string"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_no_labels_and_empty_table(spark):
    schema = "doc_id long, text string, lang string"
    assert [(r.lang_pred, r.score) for r in L.report(spark.createDataFrame([(1, "text", None)], schema)).collect()] == [("und", 0.0)]
    assert L.report(spark.createDataFrame([], schema)).count() == 0


def test_one_label_or_none_keeps_the_texts(spark):
    schema = "doc_id long, text string, lang string"
    texts = [(i, t) for i, t, lang in labelled(120, 3) if lang == "en"]
    empty = [(1000, None), (1001, ""), (1002, "123 !?")]
    one = L.keep_identified(spark.createDataFrame([(i, t, "en") for i, t in texts + empty] + [(1003, "日本", "en")], schema))
    assert sorted((r.doc_id, r.text, r.lang) for r in one.collect()) == [(i, t, "en") for i, t in texts]
    none = L.keep_identified(spark.createDataFrame([(i, t, None) for i, t in texts + empty], schema))
    assert sorted((r.doc_id, r.text) for r in none.collect()) == texts


def test_folded_scores_equal_the_kernel():
    rows = labelled(60, 2)
    texts, langs = [t.encode() for _, t, _ in rows], [lang for _, _, lang in rows]
    settings = L.Settings(grams=(1, 2, 3))
    model = L.fit(texts, langs, [i % 3 == 0 for i in range(60)], settings)
    known = set(model.keys.tolist())

    def grams(text):
        data = np.frombuffer(text, np.uint8)
        return set(L.gram_hashes(data, np.array([0, len(data)]), settings.grams)[0].tolist()) & known

    marks = [grams(t) for t in texts[::3]]
    kernel = lambda a, b: len(a & b) / np.sqrt(max(len(a), 1) * max(len(b), 1))
    K = np.array([[kernel(a, b) for b in marks] for a in marks])
    F = np.array([[kernel(grams(t), b) for b in marks] for t in texts])
    values, vectors = np.linalg.eigh(K)
    good = values > 1e-6 * values[-1]
    phi = F @ (vectors[:, good] / np.sqrt(values[good]))
    y = np.where(np.array(langs)[:, None] == np.array(model.languages), 1.0, -1.0)
    w = np.array([len(langs) / langs.count(x) / len(model.languages) for x in langs])
    beta = np.linalg.solve(phi.T @ (phi * w[:, None]) + settings.ridge * len(texts) * np.eye(phi.shape[1]), phi.T @ (y * w[:, None]))
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    assert np.allclose(model.scores(data, offsets), phi @ beta, atol=1e-4)


def test_rows_that_repeat_and_long_labelled_texts(spark):
    rows = [(7, "the house and the street", "en")] * 3000 + [(i, t, lang) for i, t, lang in labelled(80, 5) if lang != "en"] + [(500 + i, "la casa y el perro " * 2000, "es") for i in range(8)]
    few = L.Settings(examples=20, landmarks=5, longest=400)
    out = L.report(spark.createDataFrame(rows, "doc_id long, text string, lang string"), few).collect()
    assert len(out) == len(rows) and {r.lang_pred for r in out if r.doc_id == 7} == {"en"} and {r.lang_pred for r in out if r.doc_id >= 500} == {"es"}


def test_bounds_of_the_model():
    rows = labelled(90, 6)
    texts, langs = [t.encode() for _, t, _ in rows], [lang for _, _, lang in rows]
    small = L.fit(texts, langs, [True] * 90, L.Settings(features=150))
    assert len(small.keys) == 150 and small.weights.shape == (150, 3)
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    assert [small.languages[k] for k in small.scores(data, offsets).argmax(1)] == langs
    whole = small.presence(data, offsets)
    held, L.CELLS = L.CELLS, 400
    try:
        assert all(np.array_equal(a, b) for a, b in zip(whole, small.presence(data, offsets)))
        assert np.allclose(small.scores(data, offsets), small.scores(data, offsets))
    finally:
        L.CELLS = held


def test_knapsack_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(150):
        lengths = np.unique(rng.integers(1, 12, rng.integers(1, 5)))
        counts = rng.integers(1, 4, len(lengths))
        budget = int(rng.integers(0, 40))
        sums = [sum(a * b for a, b in zip(t, lengths)) for t in itertools.product(*[range(c + 1) for c in counts])]
        got = X.knapsack(lengths, counts, budget)
        assert (got <= counts).all() and (got * lengths).sum() == max(s for s in sums if s <= budget)


def test_fit_of_large_budgets_is_near():
    rng = np.random.default_rng(2)
    lengths = np.unique(rng.integers(1, 5000, 600))
    counts = rng.integers(1, 2000, len(lengths))
    total = int((lengths * counts).sum())
    for budget in (0, 1, total // 3, total - 1, total, total + 5):
        got = X.fit_counts(lengths, counts, budget)
        assert (got >= 0).all() and (got <= counts).all()
        # what can be left out of nearly everything is one document at least
        assert abs(int((got * lengths).sum()) - min(budget, total)) <= (5000 if budget == total - 1 else 1)
    few = np.array([10**6 + 3, 2 * 10**6 + 1, 7 * 10**5])
    for budget in range(0, 9 * 10**6, 370_001):
        got = X.fit_counts(few, np.array([3, 2, 1]), budget)
        gap = min(budget, int(few @ [3, 2, 1])) - int(got @ few)
        assert 0 <= gap and (gap == 0 or gap < few[got < [3, 2, 1]].min())
    assert X.fit_counts(lengths := np.array([10**6, 3 * 10**6]), np.array([5, 2]), 4_000_000) @ lengths == 4_000_000


def brute_targets(sizes, weights, share, most):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = budget / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = most * sizes[s]
            budget -= out[s]
        free -= over
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_mix(spark, hot):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        source = rng.choice(["b", "a", "é", "Z", None, "empty"])
        n = 7 if hot and i % 2 else rng.randrange(0, 60)
        rows.append((i, None if rng.random() < 0.05 else "w " * (0 if source == "empty" else n), "a" if hot and i % 2 else source))
    rows += [(3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame([(*r, 5, 1.0) for r in rows], "doc_id long, text string, source string, size int, target double")
    got = X.report(df).collect()
    assert len(got) == len(rows) and sorted(map(tuple, X.report(df).collect())) == sorted(map(tuple, got))
    sizes, taken, target = {}, {}, {}
    by_id = {i: s for i, _, s in rows}
    for r in got:
        s = by_id[r.doc_id]
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        assert r.taken in (0, r.size, 2 * r.size)
    want = brute_targets(sizes, (3.0, 1.0, 2.0), 1.5, 2.0)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 62
    mixed = X.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.taken // r.size for r in got if r.size)


def test_repeated_rows_are_taken_one_by_one(spark):
    schema = "doc_id long, text string, source string, _h int, _size string, rest string, copies int"
    rows = [(7, "one two three", "a")] * 1000 + [(i, "w " * (i % 9), "a") for i in range(100)] + [(1, "x y", "b"), (2, None, "b")]
    df = spark.createDataFrame([(*r, 1, "s", "t", 2) for r in rows], schema).repartition(5)
    got = X.report(df).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got)) == sorted(map(tuple, X.report(df).collect()))
    of = [r for r in got if r.size and r.source_size > 2]
    assert abs(sum(r.taken for r in of) - of[0].target) <= 9 and all(r.taken in (r.size, 2 * r.size) for r in of)
    mixed = X.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.taken // r.size for r in got if r.size)
    assert {(r["_h"], r["_size"], r["rest"], r["copies"]) for r in mixed.collect()} == {(1, "s", "t", 2)}
    assert mixed.where("text = 'one two three'").count() == sum(r.taken for r in got if r.doc_id == 7 and r.size == 3 and r.source_size > 2) // 3


def test_mix_of_nothing(spark):
    schema = "doc_id long, text string, source string"
    assert X.report(spark.createDataFrame([], schema)).count() == 0
    assert [r.taken for r in X.report(spark.createDataFrame([(1, None, None), (2, "", "a")], schema)).collect()] == [0, 0]
