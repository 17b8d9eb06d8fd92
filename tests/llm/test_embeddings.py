import numpy as np
import pytest

from tessera.llm import embedding_dedup as E


def brute(rows, threshold):
    good = [(i, np.array(v, float), x) for i, v, x in rows if i is not None and x is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    parent = {i: i for i, *_ in rows if i is not None}
    count = [0] * len(good)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(good)):
        for b in range(a + 1, len(good)):
            (i, x, p), (j, y, q) = good[a], good[b]
            if p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                count[a] += 1
                count[b] += 1
                r, s = find(i), find(j)
                parent[max(r, s)] = min(r, s)
    links = {}
    for (i, *_), n in zip(good, count):
        links.setdefault(i, []).append(n)
    out = []
    for i, v, x in rows:
        usable = any(g[0] == i and g[2] == x for g in good) and v and all(c is not None and np.isfinite(c) for c in v) and any(v)
        out.append((i, links[i].pop(0) if usable else 0, None if i is None else find(i), i is not None and find(i) == i))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [512, 3])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = []
    centres = rng.standard_normal((6, 16))
    for i in range(120):
        v = centres[rng.integers(6)] + rng.standard_normal(16) * rng.choice([0, 0.02, 0.1, 0.3])
        rows.append((i, [float(x) for x in (v * rng.choice([1, 5])).astype(np.float32)], int(rng.integers(2)) if rng.random() > 0.1 else None))
    one = rows[0][1]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [None] + one[1:], 1), (203, [float("nan")] + one[1:], 1), (204, [float("inf")] + one[1:], 1), (205, [], 1), (206, one[:8], 0), (207, one[:8], 0), (None, one, 0), (208, one, 1), (209, one, 1), (210, [x * 2 for x in one], 1)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "vec_id long, embedding array<float>, label int, n_links int, kept string")
    got = E.near_duplicates(df)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 0.98)


def test_rows_that_repeat_an_id(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    near = lambda v: [x + 0.01 for x in v]
    rows = [(1, a), (1, b), (2, near(a)), (3, c), (4, near(b)), (4, near(c)), (1, a)]
    got = E.near_duplicates(spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int"))
    # classes: a of id 1 twice and of 2; b of 1 and 4; c of 3 and 4
    want = [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (1, 1, 1, True), (4, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_empty_table(spark):
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((300, 64))
    b = 0.9 * a + 0.4 * rng.standard_normal((300, 64))
    exact = np.einsum("ij,ij->i", a, b) / np.linalg.norm(a, axis=1) / np.linalg.norm(b, axis=1)
    errors = []
    for seed in range(20):
        ra, rb = E.rotated(a, 256, seed), E.rotated(b, 256, seed)
        signs, factors = E.encode(ra)
        estimate, width = E.estimates(signs, factors, rb, 6.0)
        errors.append(np.diag(estimate) - exact)
        assert (np.abs(np.diag(estimate) - exact) <= width).all()
    assert abs(np.mean(errors)) < 0.002


def test_recall_of_the_tables():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal((2000, 64))
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * side
    for vectors in (1000, 10**6):
        t = E.tables_for(vectors, E.Settings())
        keys = [E.table_keys(E.encode(E.rotated(x, t.length, 5))[0], t) for x in (a, b)]
        assert (keys[0] == keys[1]).any(1).all()
