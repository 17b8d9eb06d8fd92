"""Claim spans, names in texts, skylines, regions, slots and weak triples against plain versions."""

import random
import re

import pytest
from hypothesis import given, settings as limits, strategies as st
from pyspark.sql import functions as F

from tessera.operators import aliases as A, assembly, compiling, metrics, mldata, ranking, regions, selection, skyline, spans
from tessera.queries import evidence
from tessera.queries.registry import Tables

DATA = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j - 1] + (x != y), before[j] + 1, row[j - 1] + 1))
    return row[-1]


def aligned(claim, source, ratio):
    """The nearest substring by the whole table of distances."""
    rows = [[0] * (len(source) + 1)]
    for i, x in enumerate(claim, 1):
        row = [i]
        for j, y in enumerate(source, 1):
            row.append(min(rows[-1][j - 1] + (x != y), rows[-1][j] + 1, row[j - 1] + 1))
        rows.append(row)
    best = min(rows[-1])
    if best > int((1 - ratio) * len(claim) + 1e-9):
        return None
    end = rows[-1].index(best)
    start = next(s for s in range(end, -1, -1) if distance(claim, source[s:end]) == best)
    return start, end, best


@given(st.text("abc ", min_size=1, max_size=30), st.text("abc ", max_size=60), st.sampled_from([0.5, 0.72, 0.9]))
@limits(max_examples=300, deadline=None)
def test_alignment(claim, source, ratio):
    assert spans.align(claim, source, ratio) == aligned(claim, source, ratio)


def test_alignment_of_edited_parts():
    rng = random.Random(2)
    found = 0
    for _ in range(150):
        source = "".join(rng.choice("abcdefgh .") for _ in range(rng.randrange(40, 120)))
        a = rng.randrange(len(source) - 20)
        claim = list(source[a : a + rng.randrange(15, 60)])
        for _ in range(rng.randrange(len(claim) // 3)):
            k = rng.randrange(len(claim))
            claim[k : k + rng.randrange(2)] = rng.choice(["", "x", "ab"])
        claim = "".join(claim) or "x"
        got = spans.align(claim, source, 0.72)
        found += got is not None
        assert got == aligned(claim, source, 0.72)
    assert 50 < found < 150


def test_kinds_of_support(spark):
    source = "The claimant  lost the APPEAL. It was heard in March, in the old court. Costs follow the event."
    rows = [(1, "claimant lost the appeal", source), (2, "It was heerd in Marsh in the old court", source), (3, "old court in the heard March", source), (4, "something else entirely here", source), (5, None, source), (6, "x", None), (7, "", ""), (8, "the", source), (9, "?!", source)]
    got = {}
    for r in spans.evidence_spans(spark.createDataFrame(rows, "id int, claim string, source string").withColumn("start_", F.lit(1))).collect():
        got.setdefault(r.id, []).append((r.support, r.start, r.end))
    assert got[1] == [("exact", 4, 29)] and source[slice(*got[2][0][1:])] == "It was heard in March, in the old court" and got[2][0][0] == "fuzzy"
    assert got[3] == [("overlap", 31, 71)] and got[8] == [("exact", 0, 3), ("exact", 19, 22), ("exact", 57, 60)]
    assert all(got[k] == [("none", None, None)] for k in (4, 5, 6, 7, 9))
    best = spans.best_support(spans.evidence_spans(spark.createDataFrame([(1, "a", "lost the case", "they lost the cause"), (1, "b", "lost the case", "we lost the case")], "id int, doc string, claim string, source string")), ["id"]).collect()
    assert [(r.id, r.doc, r.support) for r in best] == [(1, "b", "exact")]


def test_claim_spans_of_the_conversations(spark):
    """Offsets and ratios of all approximate spans, by the whole table of distances."""
    t = Tables(spark, DATA)
    told = {(r.conv_id, r.turn, r.pos): r for r in evidence.told_claims(t).collect()}
    got = [r for r in evidence.claim_spans(t).collect()]
    assert {r.support for r in got} == {"exact", "fuzzy", "overlap", "none"}
    assert {(r.conv_id, r.turn, r.pos) for r in got} == set(told)
    some = [r for r in got if r.support == "fuzzy"]
    for r in random.Random(0).sample(some, min(25, len(some))):
        c = told[r.conv_id, r.turn, r.pos]
        claim, source = spans.lowered(" ".join(c.claim.split())), spans.lowered(re.sub(r"\s", " ", c.source))
        start, end, d = aligned(claim, source, 0.72)
        assert (r.start, r.end, r.ratio) == (start, end, round(1 - d / len(claim), 6))
    for r in got:
        if r.support == "exact":
            c = told[r.conv_id, r.turn, r.pos]
            assert c.source[r.start : r.end].lower().split() == c.claim.lower().split()


# --------------------------------------------------------------------- names


def plain_spans(texts, names):
    found = set()
    for i, text in texts:
        for alias, kind, entity in names:
            if text and alias and len(alias) >= 3:
                for m in re.finditer(f"(?={re.escape(alias.lower())})", text.lower()):
                    a, b = m.start(), m.start() + len(alias)
                    if not re.match("[a-z0-9]", text.lower()[a - 1 : a] if a else "") and not re.match("[a-z0-9]", text.lower()[b : b + 1]):
                        found.add((i, a, b, alias.lower(), kind, entity))
    return found


NAMES = [("Data Law", "law", 1), ("data law", "law", 2), ("Data Law 2020", "law", 3), ("law", "term", 4), ("of", "term", 5), ("a a", "term", 6), ("(x)", "term", 7), ("émile", "person", 8), (None, "term", 9), ("", "term", 9), ("2020", "year", 10)]
TEXTS = [(1, "The Data Law 2020 and the data  law; DATA LAW20 data law."), (2, "a a a a, lawyer outlaw law"), (3, "f(x) (x)y Émile émiles"), (4, None), (5, ""), (6, "2020")]


@pytest.mark.parametrize("shard", [A.SHARD, 5])
def test_names_in_texts(spark, shard):
    texts, names = spark.createDataFrame(TEXTS, "id int, text string"), spark.createDataFrame(NAMES, "alias string, kind string, entity int")
    got = {tuple(r) for r in A.spans(texts, names, shard=shard).select("id", "start", "end", "alias", "kind", "entity").collect()}
    assert got == plain_spans(TEXTS, NAMES) and len(got) >= 15
    chosen = sorted(tuple(r) for r in A.longest(A.spans(texts, names, shard=shard)).select("id", "start", "end", "alias", "entity").collect())
    want = []
    for i in {x[0] for x in got}:
        kept = []
        for x in sorted((x for x in got if x[0] == i), key=lambda x: (x[1] - x[2], x[1], x[4], x[5])):
            if all(x[2] <= k[1] or k[2] <= x[1] for k in kept):
                kept.append(x)
        want += [(x[0], x[1], x[2], x[3], x[5]) for x in kept]
    assert chosen == sorted(want)


def test_no_names_and_typed_keys(spark):
    texts, names = spark.createDataFrame(TEXTS, "id int, text string"), spark.createDataFrame([], "alias string, kind string, entity int")
    assert A.spans(texts, names).count() == 0 and A.spans(texts.limit(0), spark.createDataFrame(NAMES, "alias string, kind string, entity int")).count() == 0
    keyed = spark.createDataFrame([("a", "x", 1), ("a", "x", 0), ("b", "x", 2), ("b", None, 3), ("b", "", 4)], "kind string, key string, entity int")
    asked = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, None, "x"), (4, "c", "x"), (5, "b", None), (6, "b", ""), (7, None, None)], "id int, kind string, key string")
    assert {r.id: r.entity for r in A.resolve(asked, keyed).collect()} == {1: 0, 2: 2, 3: 0, 4: None, 5: None, 6: None, 7: None}


# -------------------------------------------------------------------- skyline


@pytest.mark.parametrize("parts", [(1 << 15, 2048), (20, 7)])
def test_skyline(spark, parts):
    rng = random.Random(1)
    rows = [(i, rng.choice("ab") if i % 10 else None, *[rng.choice([rng.randrange(4), rng.random()]) * 1.0 for _ in range(5)]) for i in range(400)] + [(900, "a", None, 1.0, 1.0, 1.0, 1.0), (901, "a", float("nan"), 9.0, 9.0, 9.0, 9.0)]
    rows += [(1000 + i, *rows[i][1:]) for i in range(0, 400, 9)]
    df = spark.createDataFrame(rows, "id int, g string, own double, n double, pid double, v double, other double")
    better = ["own", "n", "pid", "v", "other"]
    whole = [r for r in rows if all(x is not None and x == x for x in r[2:])]
    beats = lambda a, b: a[1] == b[1] and all(x >= y for x, y in zip(a[2:], b[2:])) and a[2:] != b[2:]
    best = {r[1:] for r in whole if not any(beats(o, r) for o in whole)}
    got = skyline.frontier(df, better, ["g"], *parts).collect()
    assert sorted(map(tuple, got), key=str) == sorted(best, key=str) and 5 < len(got) < 300
    lost = {r.id for r in ranking.dominated(df.where("g is not null"), better, "id", ["g"]).collect()}
    assert lost == {r[0] for r in whole if r[1] and r[1:] not in best}
    assert skyline.frontier(df.limit(0), better).count() == 0


# -------------------------------------------------------------------- regions


def test_regions_of_a_page(spark):
    page = "Smith v Jones\n\nname    price\n----    -----\ntea     2\ncoffee  30\nplain line\n\n\n|a|b|\n|1|2|\n|111|2|3|\n \nSigned by: Ann Lee, Judge on 1 May 2020"
    rows = [(1, page), (2, None), (3, ""), (4, "  \n\t\n"), (5, "one   cell   row"), (6, "a  b\nc     d")]
    got = {}
    for r in regions.regions(spark.createDataFrame(rows, "page_id int, text string")).orderBy("id", "region").collect():
        text = dict(rows)[r.id]
        assert text[r.start : r.end].replace("\n----    -----", "") == r.text
        got.setdefault(r.id, []).append((r.kind, r.n_lines, r.rows, r.signed.signer if r.signed else None))
    assert got[1] == [("caption", 1, None, None), ("table", 3, [["name", "price"], ["tea", "2"], ["coffee", "30"]], None), ("text", 1, None, None), ("table", 2, [["a", "b"], ["1", "2"]], None), got[1][4], ("signature", 1, None, "Ann Lee")]
    assert got[1][4][1] == 1 and set(got) == {1, 5, 6} and [g[0] for g in got[6]] != ["table"]


# ---------------------------------------------------------------------- slots


def test_merged_slots(spark):
    rows = [(["a", "b", "c", "d"], ["d", "b"], ["b", "d", "x"]), (["a", "b"], ["b"], ["a", "b"]), (["a", "b"], ["b", "b"], ["a", "b"]), (["a"], ["a", "z"], ["a"]), (["a"], [], []), (None, ["a"], ["a"]), (["a"], None, ["a"]), ([], [], ["q"])]
    df = spark.createDataFrame(rows, "o array<string>, r array<string>, c array<string>")
    got = [r[0] for r in df.select(assembly.merge_slots(F.col("o"), F.col("r"), F.col("c"))).collect()]
    assert got == [["a", "d", "c", "b"], None, None, None, ["a"], None, None, []]


# --------------------------------------------------------------------- triples


@pytest.mark.parametrize("seed", range(3))
def test_nearest_sets(spark, seed):
    rng = random.Random(seed)
    pool = [f"t{k}" for k in range(14)] + ["hot"] * 8
    sets = lambda n, most: [(i, list({*rng.choices(pool, k=rng.randrange(most))}) or None) for i in range(n)]
    questions, docs = sets(60, 9), sets(80, 12) + [(200, ["hot"]), (201, ["hot"]), (202, ["none of these"])]
    got = {r.qid: (r.id, r.similarity) for r in mldata.nearest_sets(spark.createDataFrame(questions, "qid int, items array<string>"), spark.createDataFrame(docs, "id int, items array<string>")).collect()}
    want = {}
    for q, a in questions:
        best = [(-len({*a} & {*d}) / len({*a} | {*d}), i) for i, d in docs if a and d and {*a} & {*d}]
        if best:
            want[q] = (min(best)[1], -min(best)[0])
    assert got == want and len(want) > 30


def test_weak_triples(spark):
    questions = spark.createDataFrame([(i, ["a", f"b{i}"]) for i in range(20)] + [(99, ["zz"])], "qid int, items array<string>")
    docs = spark.createDataFrame([(i, ["a", f"b{i}"]) for i in range(30)], "id int, items array<string>")
    got = mldata.weak_triples(questions, docs).collect()
    assert len(got) == 20 and all(r.positive == r.qid and r.negative != r.positive and r.similarity == 1 for r in got) and len({r.negative for r in got}) > 5
    assert sorted(map(tuple, got)) == sorted(map(tuple, mldata.weak_triples(questions.repartition(5), docs.repartition(3)).collect()))
    assert mldata.weak_triples(questions, docs.limit(1)).count() == 0
    places = sorted((r.place, r.id) for r in mldata.in_order(docs.repartition(7), [F.desc("id")]).collect())
    assert places == [(k, 29 - k) for k in range(30)]


# ------------------------------------------------------------ joins and metrics


def test_document_shortlist(spark):
    rows = [(1, 0, "a", 1, 5, 0.1), (1, 0, "b", 2, 5, 0.9), (1, 0, "c", 3, 4, 0.9), (1, 5, "z", 4, 9, 0.9), (1, 1, "d", 5, 0, 0.9), (1, 0, "c", 6, 4, None), (2, 0, "a", 7, 0, 0.5), (3, 9, "a", 8, 3, 0.5), (4, 0, "a", 9, 2, 0.1), (4, 0, "b", 10, 2, 0.1), (4, 0, "c", 11, 2, 0.1)]
    chunks = spark.createDataFrame(rows, "qid int, pos int, doc string, id int, doc_score int, score double")
    keep = spark.createDataFrame([(1, "d"), (1, "d")], "qid int, doc string")
    got = lambda k: sorted(r.id for r in selection.document_shortlist(chunks, k).collect())
    assert got(keep) == [1, 2, 5, 7, 8, 10, 11] and got(None) == [1, 2, 7, 8, 10, 11]
    assert selection.document_shortlist(chunks.limit(0), keep).count() == 0


def test_labelled_candidates(spark):
    run = lambda rows: spark.createDataFrame(rows, "qid int, pages array<string>")
    out = mldata.labelled_candidates(run([(1, ["a", "b", "a"]), (2, ["x"]), (3, None)]), run([(1, ["b"]), (4, ["q"])]), run([(1, ["b", "c"]), (4, []), (5, None)]))
    got = sorted((r.qid, r.page, r.legacy_rank, r.sidecar_rank, r.label, r.labelled, r.n_candidates) for r in out.collect())
    assert got == [(1, "a", 1, None, 0, True, 3), (1, "b", 2, 1, 1, True, 3), (1, "c", None, None, 1, True, 3), (2, "x", 1, None, None, False, 1), (4, "q", None, 1, 0, True, 1)]


def test_reference_hits(spark):
    refs = spark.createDataFrame([(1, ["A ", "a", "B"]), (2, []), (3, None), (4, ["", "x"])], "qid int, refs array<string>")
    cited = spark.createDataFrame([(1, ["a"]), (1, [" A"]), (4, None), (9, ["x"])], "qid int, citations array<string>")
    assert {r.qid: (r.n_refs, r.n_hit, r.rate) for r in metrics.reference_hit_rate(refs, cited).collect()} == {1: (2, 1, 0.5), 2: (0, 0, 1.0), 3: (0, 0, 1.0), 4: (1, 0, 0.0)}


def test_bootstrap(spark):
    rng = random.Random(0)
    rows = [(i, rng.gauss(10, 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, x double")
    one = metrics.bootstrap_mean(df, "x", rounds=2000).first()
    assert one == metrics.bootstrap_mean(df.repartition(7), "x", rounds=2000).first()
    assert abs(one.mean - 10) < 0.3 and 0.3 < one.high - one.low < 0.5  # 2 * 1.96 * 2 / 20
    # rows that are equal in all columns are rows of their own
    same = metrics.bootstrap_mean(df.selectExpr("cast(x as int) * 1.0D as x"), "x", rounds=2000).first()
    assert 0.3 < same.high - same.low < 0.55
    assert metrics.bootstrap_mean(df.selectExpr("cast(null as double) as x"), "x", rounds=10).first() == (None, None, None)


def test_bridge_facts_and_field_pages(spark):
    pages = spark.createDataFrame([(1, 1, "Order\nABC 1/2020"), (1, 2, "It is hereby ordered that costs\t follow. See ABC 1/2020"), (2, 1, None)], "doc long, page long, text string")
    got = sorted((r.doc, r.kind, r.text, r.pages) for r in compiling.bridge_facts(compiling.compile_records(pages)).collect())
    assert got == [(1, "case_outcome", "In Order it was ordered that costs\t follow", [2]), (1, "citation", "Order refers to ABC 1/2020", [1, 2])]
    values = spark.createDataFrame([(1, "outcome", "that COSTS follow"), (1, "title", "nowhere"), (1, "x", "nowhere"), (1, "y", None), (9, "title", "z")], "doc long, field string, value string")
    assert sorted((r.doc, r.field, r.pages) for r in compiling.field_pages(values, pages).collect()) == [(1, "outcome", [2]), (1, "title", [1]), (1, "x", []), (9, "title", [])]
