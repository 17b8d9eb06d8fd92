import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import minhash, mixing, repeats


def test_stages_one_after_another(spark, tmp_path):
    rng = random.Random(1)
    words = {"en": "the of and to in is that for with this house garden window letter".split(), "fr": "le la et de est que pour avec cette maison une jardin lettre porte".split()}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) + str(rng.randrange(300)) for _ in range(n))
    passage = text("en", 70)
    rows = []
    for i in range(120):
        lang = rng.choice(["en", "fr"])
        rows.append((i, text(lang, rng.randrange(20, 120)), lang, f"src{i % 5}"))
    base = rows[0][1]
    rows += [(200, base, "en", "src1"), (201, base.rsplit(" ", 1)[0] + " changed", "en", "src2")]
    rows += [(202 + k, f"{text('en', 30)} {passage} {text('en', 30)}", "en", "src3") for k in range(3)]
    rows += [(300, None, "en", "src0"), (301, "??? 123", "en", None), (302, "", None, "src0")]
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))

    frames, now = [], spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_dedup", "suffix_array_dedup", "mixing", "sentencepiece"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage{k}"))
        frames.append(now)
        if k < 4:
            assert now.columns == docs.columns
    ids = [sorted(r.doc_id for r in f.collect()) for f in frames]
    assert set(i for i, *_ in rows) - set(ids[0]) == {300, 301, 302}

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    kept = {i: shingles(t) for i, t, *_ in rows if i in set(ids[1])}
    for i, t, *_ in rows:
        if i in set(ids[0]) - set(ids[1]):
            assert any(j < i and len(s & shingles(t)) >= 0.8 * len(s | shingles(t)) for j, s in kept.items())
    assert {200, 201}.isdisjoint(ids[1]) and 0 in ids[1]
    assert ids[2] == ids[1]
    before, after = ({r.doc_id: r.text for r in f.collect()} for f in frames[1:3])
    for i in before:
        assert (passage in before[i]) == (i in (202, 203, 204)) and passage[5:-5] not in after[i]
        if i < 200:
            assert after[i] == before[i]
    report = {r.doc_id: r.taken // max(r.size, 1) for r in mixing.report(frames[2]).collect()}
    assert ids[3] == sorted(i for i, n in report.items() for _ in range(n))
    last = frames[4].collect()
    assert len(last) == len(ids[3]) and all(r.round_trip for r in last)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(last)


def test_each_stage_is_written_once_for_the_next(spark, tmp_path, monkeypatch):
    spark.range(50).selectExpr("id as doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    mark = lambda spark, docs, _: docs.withColumn("mark", F.expr("uuid()"))
    twice = lambda spark, docs, _: docs.join(docs.withColumnRenamed("mark", "again"), "doc_id")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("mark", mark), ("twice", twice)])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.where("mark = again").count() == 50
    assert [r.mark for r in out.orderBy("doc_id").collect()] == [r.mark for r in out.orderBy("doc_id").collect()]


def test_settings():
    assert minhash.Settings() == minhash.Settings(words=5, percent=80)
    assert repeats.Settings().width == 400
