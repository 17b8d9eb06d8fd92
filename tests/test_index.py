"""The stored index against BM25 over the corpus, and what it skips."""

import random

import pytest

from tessera.operators import index as I, retrieval as R


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    rare = [f"w{k}" for k in range(300)]
    rows = [(i, "en" if i % 3 else "fr", " ".join(rng.choices(["the", "of", "and"], k=rng.randrange(30)) + rng.choices(rare, weights=[1 / (k + 1) for k in range(300)], k=rng.randrange(20)))) for i in range(900)]
    rows += [(900, "en", None), (901, None, ""), (902, None, "the Ünïcode of W7 w7 w7"), (None, "en", "the the w1")]
    return spark.createDataFrame(rows, "id long, lang string, text string")


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(1, "the w3 w250"), (2, "w7 w7 of"), (3, "nothing known"), (4, None), (5, "ünïcode"), (6, "the of and w1 w2 w3 w4 w5 w6")]
    return spark.createDataFrame(rows, "qid long, query string")


def plain(df):
    return sorted((r.qid, r["rank"], r.id, r.score, r.matched) for r in df.collect())


@pytest.mark.parametrize("size, cluster, k", [(16, None, 5), (64, "lang", 10), (4, "lang", 3), (1000, None, 2000)])
def test_search_equals_bm25(spark, corpus, queries, tmp_path, size, cluster, k):
    path = str(tmp_path / "index")
    I.save(corpus.repartition(3), path, cluster, size=size, shards=3)
    got = I.search(I.load(spark, path), queries, k, first=2)
    # a row without an id is no hit but counts for the mean length, so scores don't depend on it
    want = R.top_k(R.bm25(corpus, queries).where("id is not null"), k)
    near = lambda rows: [(q, p, i, m) for q, p, i, _, m in rows]
    assert len(near(plain(got))) == len(near(plain(want))) and {r[0] for r in plain(got)} == {1, 2, 5, 6}


def test_search_equals_bm25_exactly(spark, corpus, queries, tmp_path):
    known = corpus.where("id is not null")
    path = str(tmp_path / "index")
    I.save(known, path, "lang", size=32)
    index = I.load(spark, path)
    assert plain(I.search(index, queries, 7, first=1)) == plain(R.top_k(R.bm25(known, queries), 7))
    weighted = queries.where("query is not null").selectExpr("qid", "transform(split(query, ' '), x -> struct(x as term, 2.0D as weight)) as terms")
    assert plain(I.search(index, weighted, 4, weight_col="terms")) == plain(R.top_k(R.bm25(known, weighted, weight_col="terms"), 4))
    assert sorted(map(tuple, I.term_statistics(index).collect())) == sorted(map(tuple, R.term_statistics(R.postings(known)).collect()))


def test_ranges_below_the_threshold_are_skipped(spark, tmp_path):
    rows = [(i, "common " * (1 + i // 500 * 5) + ("rare " * 3 if i % 501 == 0 else "") + f"own{i} " * 20) for i in range(2000)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(4, "id")
    path = str(tmp_path / "index")
    I.save(docs, path, size=25)
    index = I.load(spark, path)
    asked = I.asked(index, spark.createDataFrame([(1, "common rare")], "qid long, query string"))
    sums = I.bounds(index, asked)
    hits = R.top_k(I.scores(index, asked, sums), 3)
    least = hits.groupBy("qid").agg({"score": "min"}).toDF("qid", "least")
    assert 0 < I.surviving(sums, least).count() < sums.count() / 4
    # a bound is one
    best = {r.range: r.bound for r in sums.collect()}
    of = {r.ids[0]: r.range for r in index.blocks.where("term like 'own%'").collect()}
    assert all(best[of[r.id]] + 1e-9 >= r.score for r in I.scores(index, asked, sums).collect())


def test_an_index_cut_short_is_not_loaded(spark, corpus, tmp_path):
    path = str(tmp_path / "index")
    I.save(corpus.limit(5), path)
    with pytest.raises(Exception, match="already exists"):
        I.save(corpus.limit(5), path)
    I.save(corpus.limit(0), path, mode="overwrite")
    assert I.search(I.load(spark, path), spark.createDataFrame([(1, "the")], "qid long, query string"), 3).count() == 0
    spark.createDataFrame([], "format int").write.mode("overwrite").parquet(f"{path}/about")
    with pytest.raises(ValueError):
        I.load(spark, path)


def test_hash_vectors_equal_the_embedding(spark, corpus):
    docs = corpus.where("id is not null")
    want = {}
    for r in R.hash_embedding(docs, 16).collect():
        want.setdefault(r.id, [0.0] * 16)[r.idx] = r.value
    got = {r.id: r.vector for r in R.hash_vectors(docs, 16).collect()}
    assert set(got) == set(want) and all(abs(x - y) < 1e-12 for i in got for x, y in zip(got[i], want[i]))
    assert R.hash_vectors(docs.limit(0)).count() == 0
