"""What the findings of round 3 showed, in the small."""

import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import classify as C, structure as S
from tessera.operators import aliases as A, graph, grounding, metrics, mldata, ranking, regions, retrieval as R
from tessera.session import scratch_path

DATA = "/root/testdata/sf0.001"


def test_wilcoxon_of_more_pairs_than_a_long_can_cube(spark):
    n = 1_700_000
    row = metrics.wilcoxon(spark.range(n).select((F.col("id") % 2).alias("a"), F.lit(0.5).alias("b")), "a", "b").first()
    assert (row["n"], row["z"]) == (n, 0.0) and row["w_plus"] == row["w_minus"] == n * (n + 1) / 4


@pytest.mark.parametrize("query", ["compiled_records", "bridge_facts"])
def test_records_are_put_together_without_a_join(spark, query):
    """A join's small-looking side was a map for each document, held by the driver."""
    plan = catalog.QUERIES[query](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_word_boundaries_are_those_of_ascii(spark):
    """As in the SQL: an accent ends a word there."""
    row = spark.createDataFrame([("isé that not",)], "x string").select(C.query_contract(F.col("x"), "[A-Z][a-z]+").alias("c"), S.question_families(F.col("x")).alias("f"), C.unnegated_mention(F.lit("é the ou théthe"), "the").alias("m"), C.unnegated_mention(F.lit("éthe"), "the").alias("n"), C.unnegated_mention(F.lit("the nové"), "the").alias("o")).first()
    assert (row["c"]["predicate"], row["c"]["mode"], row["f"]) == ("boolean", "negative", ["boolean", "negative"])
    assert (row["m"], row["n"], row["o"]) == (True, True, True)


def test_occurrences_of_one_name_lie_apart(spark):
    texts, names = spark.createDataFrame([(1, "the the the the, athe the the")], "id int, text string"), spark.createDataFrame([("the the", "pair", 1), ("the", "word", 2)], "alias string, kind string, entity int")
    got = sorted((r["alias"], r["start"]) for r in A.spans(texts, names, apart=True).collect())
    assert got == [("the", 0), ("the", 4), ("the", 8), ("the", 12), ("the", 22), ("the", 26), ("the the", 0), ("the the", 8)]


@pytest.mark.parametrize("block", [512, 2])
def test_best_by_bm25_without_all_pairs(spark, block):
    """The k best of the full scoring, from k rows of each task and query."""
    words = "a b c d e f g h".split()
    docs = [(i, " ".join(words[(i * j + j) % 8] for j in range(i % 7))) for i in range(200)] + [(200, None), (201, "")]
    corpus = spark.createDataFrame(docs, "id long, text string").repartition(3)
    queries = spark.createDataFrame([(1, "a b zz"), (2, "c"), (3, "zz"), (4, None), (5, "h g A a")], "qid int, query string")
    got = R.bm25_top_k(corpus, queries, 7, block=block)
    want = R.top_k(R.bm25(corpus, queries), 7).select("qid", "id", "score", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 21
    odd = R.bm25_top_k(corpus, queries, 7, among=F.col("id") % 2 == 1, block=block)
    want = R.top_k(R.bm25(corpus, queries).where("id % 2 = 1"), 7).select("qid", "id", "score", "rank")
    assert sorted(map(tuple, odd.collect())) == sorted(map(tuple, want.collect()))


def test_rankings_shuffle_only_the_best(spark, monkeypatch):
    monkeypatch.setattr(R, "bm25", None)
    assert catalog.QUERIES["variant_fusion"](spark, DATA).count() and catalog.QUERIES["bm25_filtered_topk"](spark, DATA).count()


@pytest.mark.parametrize("together", [1, 1024])
def test_paths_that_meet_are_not_rows(spark, together):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (None, 9), (2, None), (7, 8)], "src long, dst long")
    seeds = spark.createDataFrame([("a", 1), ("a", 2), ("b", 4), ("b", 4), ("c", 99), (None, 1), ("d", None)], "qid string, node long")
    got = graph.expand(seeds, edges, 2, together)
    assert sorted(map(tuple, got.collect())) == [("a", 1, 0), ("a", 2, 0), ("a", 3, 1), ("a", 4, 1), ("b", 1, 1), ("b", 2, 2), ("b", 3, 2), ("b", 4, 0), ("c", 99, 0)]
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()


def test_confusers_of_many_alike_are_no_pairs(spark):
    """2,000 questions of four kinds share a word: 4,000,000 pairs before."""
    rows = spark.range(2000).select(F.col("id").alias("qid"), F.concat(F.lit("all k"), (F.col("id") % 4).cast("string")).alias("query"), F.when(F.col("id") % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.col("id") % 7, F.lit(3).cast("long"))).alias("gold")).repartition(4)
    got = {}
    for r in mldata.confusers(rows).collect():
        got.setdefault(r["qid"], set()).add((r["other"], r["page"]))
    data = rows.collect()
    for q in data[::97]:
        best = {}
        for o in data:
            if o["qid"] != q["qid"] and o["gold"] and o["gold"][0] not in q["gold"]:
                shared = 2 if o["qid"] % 4 == q["qid"] % 4 else 1
                best[o["gold"][0]] = min(best.get(o["gold"][0], (0, 0)), (-shared, o["qid"]))
        assert got[q["qid"]] == {(o, page) for (_, o), page in sorted((v, p) for p, v in best.items())[:2]}
    assert len(got) == 2000


@pytest.mark.parametrize("block", [1 << 13, 3])
def test_late_interaction_by_products(spark, block, monkeypatch):
    """As before by every pair of vectors, zero vectors and single ones included."""
    import random

    rng = random.Random(1)
    v = lambda: [0.0, 0.0] if rng.random() < 0.2 else [rng.uniform(-1, 1), rng.uniform(-1, 1)]
    rows = [(i, pos, v(), i % 3 if i != 5 else None) for i in range(20) for pos in range(1 + i % 3)] + [(30, 0, [0.0, 0.0], 1), (31, 0, None, 1)]
    t = spark.createDataFrame(rows, "qid long, pos int, v array<float>, key int")
    p = t.select(F.col("qid").alias("id"), "v", "key")
    pairs = t.alias("q").join(p.alias("p"), F.expr("q.key = p.key and q.v is not null and p.v is not null")).groupBy("qid", "pos", "id").agg(F.max(R.cosine(F.col("q.v"), F.col("p.v"))).alias("best"))
    want = {(r[0], r[1]): r[2] for r in pairs.groupBy("qid", "id").agg(F.avg("best")).collect()}
    monkeypatch.setattr(R, "cosine", None)
    got = {(r["qid"], r["id"]): r["score"] for r in R.max_sim(t, p, block).collect()}
    assert got.keys() == want.keys() and all((got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 1e-12) for k in want)


def test_bootstrap_draws_once_for_equal_values(spark):
    rows = spark.range(60_000).select("id", (F.col("id") % 50).cast("double").alias("v"))
    plan = metrics.bootstrap_mean(rows, "v", 300)
    row, again = plan.first(), metrics.bootstrap_mean(rows.orderBy(F.rand(3)), "v", 300).first()
    error = (sum((i - 24.5) ** 2 for i in range(50)) / 50 / 60_000) ** 0.5
    assert row == again and abs(row["mean"] - 24.5) < error and abs((row["high"] - row["low"]) / (3.92 * error) - 1) < 0.25
    assert "xxhash64(id" not in plan._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("together", [(1 << 13, 1 << 16), (7, 5)])
def test_nearest_sets_without_pairs(spark, together):
    """Sets meet in blocks; no row is a pair of a question and a document, as before by each item."""
    rows = spark.range(60).select("id", F.array(F.lit("hot"), F.concat(F.lit("t"), (F.col("id") % 7).cast("string")), F.concat(F.lit("u"), (F.col("id") % 11).cast("string"))).alias("items"))
    asked = rows.withColumnRenamed("id", "qid").where("qid % 3 = 0")
    got = mldata.nearest_sets(asked, rows.where("id % 2 = 1"), together)
    sets = {r["id"]: {*r["items"]} for r in rows.collect()}
    want = {(q, *min((-len(sets[q] & sets[d]) / len(sets[q] | sets[d]), d) for d in range(1, 60, 2))[::-1]) for q in range(0, 60, 3)}
    assert {(r["qid"], r["id"], -r["similarity"]) for r in got.collect()} == want
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()


def test_regions_are_read_where_the_page_is(spark):
    """Windows over a page's lines sorted (and spilled) all lines of all pages."""
    pages = spark.createDataFrame([(1, "a | b\n---|---\nc | d\n\nplainé\nx  y\n| z | q |\r\n"), (2, None), (3, " \n"), (4, "k\tl\nmm\tn")], "page_id int, text string")
    got = regions.regions(pages)
    assert [(r["id"], r["region"], r["kind"], r["start"], r["end"], r["n_lines"], r["rows"]) for r in got.orderBy("id", "region").collect()] == [(1, 0, "table", 0, 19, 2, [["a", "b"], ["c", "d"]]), (1, 1, "text", 21, 27, 1, None), (1, 2, "text", 28, 32, 1, None), (1, 3, "table", 33, 43, 1, [["z", "q"]]), (4, 0, "text", 0, 3, 1, None), (4, 1, "text", 4, 8, 1, None)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan and "Sort" not in plan


@pytest.mark.parametrize("together", [4096, 2])
def test_similar_sets_are_shuffled_once_for_a_group(spark, together):
    """Not once for each candidate, nor token by token to count and to order them."""
    sets = [(f"d{i:03}", [f"w{k}" for k in range(i % 5, 30 + i // 40)] + ["x"] * (i % 2) + [f"own{i % 7}"]) for i in range(120)] + [("none", []), ("null", None)]
    got = ranking.similar_sets(spark.createDataFrame(sets, "id string, tokens array<string>"), 80, together=together)
    want = {}
    held = [(i, {*t}) for i, t in sets if t]
    for i, x in held:
        for j, y in held:
            if i < j and 100 * len(x & y) >= 80 * len(x | y):
                want[i, j] = len(x & y), round(len(x & y) / len(x | y), 6)
    assert {(r["a"], r["b"]): (r["common"], r["jaccard"]) for r in got.collect()} == want and len(want) > 3000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Window" not in plan


@pytest.mark.parametrize("queries", [3, 700])
def test_best_by_bm25_reads_a_text_once_for_a_block(spark, queries):
    """Not once to count its terms and again to score it."""
    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: (read.add(1), x)[1], "string").asNondeterministic()
    corpus = spark.createDataFrame([(i, f"w{i % 7} w{i % 3}") for i in range(50)], "id long, text string").withColumn("text", seen("text"))
    asked = spark.range(queries).select(F.col("id").alias("qid"), F.concat(F.lit("w"), (F.col("id") % 7).cast("string")).alias("query"))
    assert R.bm25_top_k(corpus, asked, 2).count() == 2 * queries
    assert read.value == 50 * -(-queries // 512)


def test_texts_of_few_pairs_stay_where_they_are(spark):
    """All texts were shuffled to the pairs; a run's key was put together as a string for each word."""
    docs = spark.createDataFrame([(i, f"d{i} " + " ".join(f"w{(i * j) % 50}" for j in range(40))) for i in range(60)] + [(60, None), (61, "x")], "doc_id long, text string")
    asked = docs.where("doc_id % 9 = 1").select(F.col("doc_id").alias("item_id"), F.substring("text", 8, 60).alias("text"))
    path = scratch_path(spark, "docs")
    docs.write.parquet(path)
    got = grounding.contained(asked, spark.read.parquet(path))
    held = {(a["item_id"], d["doc_id"]) for a in asked.collect() for d in docs.collect() if d["text"] and a["text"] in d["text"]}
    assert {(r["item_id"], r["doc_id"]) for r in got.collect()} == held and len(held) >= 7
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning(doc_id" not in plan


def test_triples_shuffle_the_texts_of_their_pages(spark):
    texts = spark.range(500).select(F.col("id").alias("page"), F.concat(F.lit("text "), "id").alias("text"))
    mined = spark.createDataFrame([(1, 7, "lexical"), (1, 8, "alias"), (2, 9, "lexical")], "qid long, page long, source string")
    gold = spark.createDataFrame([(1, 3), (1, 4), (2, 600)], "qid long, page long")
    queries = spark.createDataFrame([(1, "a"), (2, "b")], "qid long, query string")
    got = mldata.negative_triples(mined, queries, gold, texts)
    assert sorted(map(tuple, got.collect())) == [(1, p, n, s, "a", f"text {p}", f"text {n}") for p in (3, 4) for n, s in ((7, "lexical"), (8, "alias"))]
    assert got._jdf.queryExecution().executedPlan().toString().count("LeftSemi") >= 2
