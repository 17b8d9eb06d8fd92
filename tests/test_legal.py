"""Strict answers, families, segments, guarantees, negatives, normal records."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import structure as S, text as T
from tessera.operators import answers, assembly, chunking, grounding, metrics, mldata, ranking, retrieval as R
from tessera.sources import files


def one(spark, expr, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(expr).first()[0]


@pytest.mark.parametrize("text, near, want", [("pays USD 1,234.50 now", None, "1234.50"), ("AED 3 million or $5", None, "3000000"), ("costs of USD 7. The claim for EUR 2 billion", "claim", "2000000000"), ("costs of USD 7", "claim", "7"), ("nothing", None, None), (None, None, None)])
def test_money(spark, text, near, want):
    assert one(spark, answers.money(F.col("x"), near), x=text) == want


def test_strict_answers(spark):
    asked = [
        (1, "number", "What is the fine under the law?"),
        (2, "number", "What is the law number?"),
        (3, "number", "How many days may it take?"),
        (4, "date", "When did it come into force?"),
        (5, "names", "Who were the defendants?"),
        (6, "name", "Who was the claimant or the defendant?"),
        (7, "boolean", "Under Article 4, can a person trade?"),
        (8, "boolean", "Under Article 4, is it prohibited to trade?"),
        (9, "boolean", "Under Article 4, may a person trade?"),
        (10, "date", "When?"),
        (11, "number", None),
    ]
    text = {
        1: ["Costs of USD 5.", "A fine of USD 9,000 applies."],
        2: ["See Law No. 12 of 2004."],
        3: ["within 30 days of notice"],
        4: ["Signed 1 May 2001.", "In force on 2 June 2003."],
        5: ["x"],
        6: ["x"],
        7: ["No person shall trade."],
        8: ["No person shall trade."],
        9: ["A person may trade unless it is barred."],
        10: ["on 31 February 2001", "on 3 March 2002"],
        11: [None],
    }
    rows = [(q, k, f"c{q}{k}", "CFI 010/2020 Ann Lee v (1) Bo Ltd, (2) Cy and Di", t) for q, ts in text.items() for k, t in enumerate(ts)] + [(1, 9, "far", None, "fine of USD 1")]
    got = {r.qid: (r.answer, r.cited) for r in answers.strict_answers(spark.createDataFrame(asked, "qid int, kind string, query string"), spark.createDataFrame(rows, "qid int, pos int, id string, title string, text string")).collect()}
    # the first row with an amount answers, the later one does not
    assert got[1] == ("5", ["c10"]) and got[2] == ("12", ["c20"]) and got[3] == ("30", ["c30"])
    assert got[4] == ("2003-06-02", ["c41"]) and got[5] == ("Bo Ltd, Cy, Di", ["c50"])
    assert got[7] == ("No", ["c70"]) and got[8] == ("Yes", ["c80"]) and got[10] == ("2002-03-03", ["c101"])
    assert not {6, 9, 11} & set(got)


@pytest.mark.parametrize("text, family, kind", [("An enactment notice of regulations", "enactment_notice", "other"), ("an enactment notice of regulations " + "x" * 3000, "regulations", "statute"), ("tracked_change in an enactment notice", "tracked_changes_amendment", "amendment"), ("CFI 3/2019 between A and B under Law No 5", "order", "case"), ("", "other", "other"), (None, "other", "other")])
def test_families(spark, text, family, kind):
    assert one(spark, S.document_family(F.lit("T"), F.col("x")), x=text) == family
    assert one(spark, S.document_type(S.document_family(F.lit("T"), F.col("x"))), x=text) == kind


def test_pages_questions_and_regions(spark):
    assert one(spark, S.page_family(F.col("x"), F.col("p")), x="  Contents\n1", p=2) == "contents"
    assert one(spark, S.page_family(F.col("x"), F.col("p")), x="pays costs of USD 5", p=2) == "costs"
    assert one(spark, S.page_family(F.col("x"), F.col("p")), x=None, p=1) == ""
    assert one(spark, S.question_families(F.col("x")), x="List all judges in  common") == ["enumeration", "broad_enumeration", "common_elements", "common_judge", "person"]
    assert one(spark, S.question_families(F.col("x")), x=None) == []
    long = " word" * 40
    for text, hard in [("few words", True), (long, False), (long + " | cell", True), (long + " signed by J", True), (long + " �", True), (None, True)]:
        assert one(spark, S.is_hard_page(F.col("x")), x=text) is hard
    assert one(spark, S.table_rows(F.col("x")), x="a | b\n\n c   d ") == [["a", "b"], ["c", "d"]]
    assert tuple(one(spark, S.signature(F.col("x")), x="Signed by: Jo Poe, Registrar, 3 May 2020")) == ("Jo Poe", "Registrar", "3 May 2020")


def test_segments_cross_pages(spark):
    pages = [("d", 1, "preface\nArticle 1. First\nbody"), ("d", 2, "more\n\nIt is hereby ordered\nthat"), ("d", 3, 'Schedule A\n"Goods" means x'), ("e", 1, None)]
    got = chunking.segments(spark.createDataFrame(pages, "doc string, page int, text string")).orderBy("idx").collect()
    assert [(r.kind, r.label, r.title, r.first_page, r.last_page, r.n_lines) for r in got] == [("article", "Article 1", "First", 1, 2, 3), ("operative_order", "operative_order", None, 2, 2, 2), ("schedule", "Schedule A", "", 3, 3, 1), ("definition", "definition", None, 3, 3, 1)]
    assert got[0].text == "Article 1. First\nbody\nmore"


def test_dense_top_k_of_odd_vectors_and_many_queries(spark):
    rng = random.Random(3)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(4)], i % 2) for i in range(50)] + [(100, None, 0), (101, [], 0), (102, [0.0] * 4, 0), (103, [float("nan")] * 4, 0), (104, [1.0, None, 1.0, 1.0], 0), (105, [1.0, 2.0], 0), (106, [1.0, 0.0, 0.0, 0.0], None), (None, [1.0] * 4, 0)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")
    asked = df.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"), "label")
    for block in (1 << 14, 7):
        got = {(r.qid, r.rank): (r.id, r.score) for r in R.dense_top_k(df, asked, 3, block).collect()}
        by_label = {(r.qid, r.rank): r.id for r in R.dense_top_k(df, asked, 3, block, condition="label").collect()}
        good = [(i, v) for i, v, _ in vectors if i is not None and i < 50 or i in (105, 106)]
        cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
        for i, v in good:
            want = sorted(((-round(cos(v, w), 6), j) for j, w in good if len(w) == len(v)))[:3]
            assert [got[i, r + 1] for r in range(len(want))] == [(j, pytest.approx(-s)) for s, j in want]
        assert {q for q, _ in got} == {i for i, _ in good} and {q for q, _ in by_label} == {i for i, _ in good} - {106}
        assert all(q % 2 == i % 2 for (q, _), i in by_label.items() if q < 50)


@pytest.mark.parametrize("measures", [["a"], ["a", "b"], ["a", "b", "c"]])
def test_pareto_equals_brute_force(spark, measures):
    rng = random.Random(1)
    rows = [(i, rng.randrange(2), rng.randrange(5), rng.randrange(5), rng.choice([None, 0, 1, 2])) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, g int, a int, b int, c int")
    at = {"a": 2, "b": 3, "c": 4}
    beats = lambda x, y: all(x[at[m]] is not None and y[at[m]] is not None and x[at[m]] >= y[at[m]] for m in measures) and any(x[at[m]] > y[at[m]] for m in measures)
    want = sorted(y[0] for y in rows if any(x[1] == y[1] and beats(x, y) for x in rows))
    assert sorted(r.id for r in ranking.dominated(df, measures, "id", ["g"]).collect()) == want


def test_contained_passages_of_any_length(spark):
    docs = [(1, "The quick brown fox jumps over the lazy dog and then it runs far away"), (2, "a quick one"), (3, None), (4, ""), (5, "foxes")]
    asked = ["ick brown fox jumps over the lazy dog and then it ru", "quick", "brown fox jumps", "fox", "", "no such thing at all here", None, "!", "quick one"]
    got = {tuple(r) for r in grounding.contained(spark.createDataFrame(list(enumerate(asked)), "item_id int, text string"), spark.createDataFrame(docs, "doc_id int, text string")).collect()}
    assert got == {(i, d) for (i, p), (d, t) in itertools.product(enumerate(asked), docs) if p is not None and t is not None and p in t}


def test_similar_sets_equals_brute_force(spark):
    rng = random.Random(2)
    sets = [(i, rng.sample("abcdefghijkl", rng.randrange(1, 9))) for i in range(60)]
    got = {(r.a, r.b): r.common for r in ranking.similar_sets(spark.createDataFrame(sets, "id int, tokens array<string>"), 60).collect()}
    want = {(i, j): len(set(x) & set(y)) for (i, x), (j, y) in itertools.combinations(sets, 2) if 100 * len(set(x) & set(y)) >= 60 * len(set(x) | set(y))}
    assert got == want


def packed(texts, limit, overlap):
    done, open_ = [], []
    size = lambda xs: sum(len(x.split()) for x in xs)
    for x in texts:
        if open_ and size(open_) + size([x]) > limit:
            done.append(open_)
            kept = []
            for y in reversed(open_ if overlap else []):
                if kept and size(kept) + size([y]) > overlap:
                    break
                kept.insert(0, y)
            open_ = kept
        open_ = [*open_, x]
    return done + [open_] * bool(open_)


@pytest.mark.parametrize("limit, overlap", [(10, 0), (10, 4), (3, 3)])
def test_pack_equals_a_plain_loop(spark, limit, overlap):
    rng = random.Random(7)
    for _ in range(6):
        texts = [" ".join("w" * rng.randrange(1, 3) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(0, 12))]
        df = spark.createDataFrame([(texts,)], "x array<string>")
        assert df.select(chunking.pack(F.col("x"), limit, overlap)).first()[0] == packed(texts, limit, overlap)


def test_guarantees_and_escalation(spark):
    hits = spark.createDataFrame([(1, "a2", "a", 2, 9.0, 1), (1, "b3", "b", 3, 8.0, 2), (1, "a1", "a", 1, 2.0, 7), (1, "b1", "b", 1, 3.0, 6), (1, "b0", "b", 1, 1.0, 8)], "qid int, id string, doc string, page int, score double, rank int")
    slots = R.page_one_first(hits.where("rank <= 2"), hits, 3)
    assert [r.id for r in slots.orderBy("slot").collect()] == ["a1", "a2", "b1"]
    more = spark.createDataFrame([(1, "x", 1.0), (2, "y", 1.0)], "qid int, id string, score double")
    first = spark.createDataFrame([(1, "p", 0.2), (2, "q", 0.9)], "qid int, id string, score double")
    assert {tuple(r) for r in R.retried(first, more, 0.3).collect()} == {(1, "x", 1.0, True), (2, "q", 0.9, False)}
    assert {tuple(r) for r in R.escalated(first, [more, more.withColumn("id", F.lit("p"))], 0.5).collect()} == {(1, "p", 0), (1, "x", 1), (2, "q", 0)}
    rows = R.per_reference(spark.createDataFrame([(1, "compare Law A with Law B", ["Law A", "Law B"])], "qid int, query string, refs array<string>"))
    assert {(r.ref, r.query) for r in rows.collect()} == {("Law A", "compare Law A with"), ("Law B", "compare with Law B")}


def test_negatives_questions_and_folds(spark):
    gold = spark.createDataFrame([(1, 10)], "qid int, page int")
    s = spark.createDataFrame([(1, 10, 5.0), (1, 11, 1.0), (1, 12, 1.2)], "qid int, page int, overlap double")
    got = mldata.mined_negatives({"lexical": s, "alias": s.where("page = 11")}, gold, 2, spark.createDataFrame([(1, 13), (1, 10)], "qid int, page int"))
    assert [tuple(r) for r in got.orderBy("place").collect()] == [(1, 13, "false_positive", 100.0, 1), (1, 11, "alias", 1.25, 2)]
    facts = spark.createDataFrame([("Law X", "date", "3 May 2020", 1), ("Law Y", "date", "4 May 2020", 1), ("Law Z", "amount", "7", 2)], "name string, field string, value string, page int")
    made = mldata.synthetic_questions(facts, spark.createDataFrame([(1, "Law X on 3 May 2020"), (2, "no figure")], "page int, text string"), 5)
    assert {(r.family, r.question, r.answer) for r in made.collect()} == {("single_field", "When was Law X issued?", "3 May 2020"), ("compare", "Do Law X and Law Y have the same date?", "No")}
    rows = spark.createDataFrame([(i, float(i % 10) / 10, int(i % 10 > 4)) for i in range(200)], "id int, s double, label int")
    fitted = []
    fit = lambda train: (fitted.append(train.count()), lambda test: test.withColumn("score", F.col("s")))[1]
    out = metrics.cross_validation(rows, fit, threshold=0.5).collect()
    assert sorted(r.fold for r in out) == list(range(5)) and sum(r.n for r in out) == 200 and sum(fitted) == 800 and all(r.accuracy == r.auroc == 1.0 for r in out)


def test_normal_records_and_golden_rows(spark, tmp_path):
    rows = spark.createDataFrame([(None, "q", [("1", None, "a"), ("2", "d", None)]), ("x", None, None)], "id string, question string, passages array<struct<id:string,doc:string,text:string>>")
    got = sorted(files.normalise_passages(rows, "p", "train").collect(), key=lambda r: r.sample_id)
    assert got[0].sample_id.startswith("p-") and got[0].text == "[1] a\n\n[2]" and got[0].scope_label == "multi_passage_support"
    assert (got[1].sample_id, got[1].text, got[1].question, json.loads(got[1].metadata)) == ("x", "", "", {"split": "train", "passages": 0})
    (tmp_path / "g.json").write_text(json.dumps([{"question": "a?", "answer_type": "date"}, {"question": " ", "answer_type": "odd", "gold_chunk_ids": [""]}]))
    good, bad = files.read_checked_golden(spark, str(tmp_path / "g.json"))
    assert good.count() == 1 and bad.first().wrong == ["no question", "unknown answer type", "empty chunk id"]
    assert one(spark, T.plausible_case(F.col("x")), x="CFI 012/2019") and not one(spark, T.plausible_case(F.col("x")), x="CFI 012/1019")


def test_plugged_models(spark, tmp_path):
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def overlap(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([len(set(a.split()) & set(b.split())) / 3 for a, b in zip(q, t)])

    rows = spark.createDataFrame([(1, "a b", "b c"), (2, None, "x"), (3, "a", None), (4, "z", "y")], "id int, query string, text string")
    assert {r.id: r.rerank for r in assembly.rescored(rows, overlap).collect()} == {1: 0.333333, 2: None, 3: None, 4: 0.0}

    folder = str(tmp_path)

    @pandas_udf("array<double>")
    def encoder(x: pd.Series) -> pd.Series:
        with open(f"{folder}/{random.random()}", "w") as f:
            f.write("\n".join(x))
        return x.map(lambda t: [float(len(t))])

    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["one", "three", "one", None, "one"])], "id int, text string")
    out = {r.id: r.vector for r in assembly.encoded(texts, encoder).collect()}
    assert out == {0: [3.0], 1: [5.0], 2: [3.0], 3: None, 4: [3.0]}
    assert sorted(line for p in tmp_path.iterdir() for line in p.read_text().split("\n") if line) == ["one", "three"]


def test_assembled_texts(spark):
    rows = spark.createDataFrame([(1, 2, "b", "", "second "), (1, 1, "a", "T", "first"), (2, 1, "c", None, None)], "qid int, pos int, id string, title string, text string")
    got = {r.qid: r.context for r in assembly.context_text(rows).collect()}
    assert got == {1: "[1] a | T\nfirst\n\n[2] b\nsecond", 2: "[1] c\n"}
    assert one(spark, assembly.numbered_list(F.array(F.col("x"), F.lit(None), F.lit(" b "), F.col("x")), "L: "), x="a") == "L: 1. a\n2. b"
    assert one(spark, assembly.numbered_list(F.array(F.col("x"))), x="  ") == ""
    pages = spark.createDataFrame([(1, 1, "p", "abcdef"), (1, 2, "q", "ghij"), (1, 3, "r", "x")], "qid int, pos int, page string, text string")
    assert [r.sources for r in assembly.capped_sources(pages, 2, 8).collect()] == ["--- p\nabcdef\n--- q\ngh"]
    assert [r.sources for r in assembly.capped_sources(pages, 9, 6).collect()] == ["--- p\nabcdef"]
    chunks = spark.createDataFrame([(1, "d", "Law 2", ["Law 9"]), (2, "d", None, None), (3, "e", "none", None)], "id int, doc string, text string, refs array<string>")
    assert {r.id: r.refs for r in assembly.with_references(chunks, "Law [0-9]+").collect()} == {1: ["Law 2", "Law 9"], 2: ["Law 2", "Law 9"], 3: []}
