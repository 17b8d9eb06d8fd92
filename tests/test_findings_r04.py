"""What the findings of round 4 showed, in the small."""

import ast
import collections
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from tessera import catalog, queries
from tessera.operators import graph, mldata, retrieval as R

DATA = "/root/testdata/sf0.001"


def test_no_helper_hides_another():
    """a second ``_gold`` of the module took the place of the first."""
    for path in pathlib.Path(queries.__file__).parent.glob("*.py"):
        names = collections.Counter(x.name for x in ast.parse(path.read_text()).body if isinstance(x, ast.FunctionDef))
        assert [n for n, k in names.items() if k > 1] == []


def test_hit_rate_by_source_reads_its_own_labels(spark):
    rows = {r["source"]: r["n"] for r in catalog.QUERIES["hit_rate_by_source"](spark, DATA).collect()}
    asked = [r[0] for r in spark.read.parquet(f"{DATA}/customer.parquet").select("c_custkey").collect()]
    assert rows == dict(collections.Counter(f"s{k % 3}" for k in asked if k % 4))


def test_selected_page_metrics_reads_its_own_labels(spark):
    row = catalog.QUERIES["selected_page_metrics"](spark, DATA).first()
    assert row["n"] == spark.read.parquet(f"{DATA}/customer.parquet").count() and 0 < row["hit_rate"] <= 1


def test_weak_triples_read_whole_texts(spark, tmp_path):
    """the words that decide stand after the first 240 characters."""
    opening = "common " * 60
    turns = [(1, 0, "user", f"{opening} walnut harbour"), (1, 1, "assistant", f"{opening} granite meadow lantern"), (2, 1, "assistant", f"{opening} walnut harbour"), (3, 1, "assistant", "something else")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    row = catalog.QUERIES["weak_triples"](spark, str(tmp_path)).first()
    assert (row["positive"], row["similarity"]) == (2001, 1.0)


def test_nearest_sets_in_blocks_of_few_items(spark):
    questions = spark.createDataFrame([(i, ["a", f"b{i % 7}", f"c{i}"]) for i in range(40)], "qid int, items array<string>")
    docs = spark.createDataFrame([(i, ["a", f"b{i}", f"c{i}"]) for i in range(30)], "id int, items array<string>")
    got, want = (sorted(map(tuple, mldata.nearest_sets(questions, docs, items=n).collect())) for n in (8, 1 << 21))
    assert got == want and len(got) == 40


@pytest.mark.parametrize("block", [512, 2])
def test_both_rankings_without_all_pairs(spark, block):
    """the best by score and by terms held, from those of each task and query."""
    words = "a b c d e f g h".split()
    docs = [(i, " ".join(words[(i * j + j) % 8] for j in range(i % 7))) for i in range(200)] + [(200, None), (201, "")]
    corpus = spark.createDataFrame(docs, "id long, text string").repartition(3)
    queries = spark.createDataFrame([(1, "a b zz"), (2, "c"), (3, "zz"), (4, None), (5, "h g A a")], "qid int, query string")
    hits = R.bm25(corpus, queries)
    wanted = R.top_k(hits, 7), R.top_k(hits.select("qid", "id", F.col("matched").cast("double").alias("score")), 7)
    for got, want in zip(R.bm25_rankings(corpus, queries, 7, block=block), wanted):
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect())) and got.count() == 21


@pytest.mark.parametrize("query", ["rrf_weighted", "rrf_rerank"])
def test_fused_rankings_keep_no_pairs(spark, monkeypatch, query):
    monkeypatch.setattr(R, "bm25", None)
    assert catalog.QUERIES[query](spark, DATA).count()


def test_hops_read_seeds_and_edges_once(spark):
    """their joins were shuffled again for each use; what is walked are kept lists."""
    plan = catalog.QUERIES["citation_hops"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "orders" not in plan


@pytest.mark.parametrize("together, kind", [(1, "string"), (3, "long"), (2048, "long")])
def test_hops_of_groups_of_neighbours(spark, together, kind):
    rng = random.Random(together)
    links = [(rng.randrange(30), rng.randrange(30)) for _ in range(50)] + [(3, 3), (3, 4), (3, 4)]
    starts = [(i, rng.randrange(40)) for i in range(20) for _ in range(rng.randrange(1, 4))]
    seeds = spark.createDataFrame(starts, "qid long, node long").select(F.col("qid").cast(kind).alias("qid"), "node").repartition(3)
    want = {}
    for qid in {i for i, _ in starts}:
        front = {n for i, n in starts if i == qid}
        for hop in range(4):
            new = {n for n in front if (qid, n) not in want}
            want |= {(qid, n): hop for n in new}
            front = {b for a, b in links if a in new}
    got = graph.expand(seeds, spark.createDataFrame(links, "src long, dst long"), 3, together).collect()
    assert {(int(r["qid"]), r["node"]): r["hop"] for r in got} == want and len(got) == len(want)
