import os

import pytest
from pyspark.sql import functions as F

from tessera.llm import common, language_id, minhash, mixing, mpeg_audio, repeats, sentencepiece_codec, sharding, token_count
from tessera.llm.queries import PIECE_MODEL


def files(spark):
    return {f for f in os.listdir(common.scratch_dir(spark)) if f.startswith("tessera-")}


def test_scratch_tables_go_when_they_are_tidied(spark):
    before = files(spark)
    with common.tidied(spark) as outer:
        with common.tidied(spark) as kept:
            first = common.stored(spark.range(5))
            assert len(files(spark)) == len(before) + 1
            second = kept(first.selectExpr("id + 1 as id"))
        assert len(files(spark)) == len(before) + 1 and second.count() == 5
        third = outer(second)
    assert len(files(spark)) == len(before) + 1 and third.agg(F.sum("id")).first()[0] == 15
    with pytest.raises(ZeroDivisionError):
        with common.tidied(spark):
            common.stored(spark.range(3))
            raise ZeroDivisionError
    assert len(files(spark)) == len(before) + 1


def test_a_cluster_needs_a_shared_folder():
    class Unset:
        class conf:
            get = staticmethod(lambda name, other: None)

        class sparkContext:
            master = "local-cluster[3,2,1000]"

    with pytest.raises(ValueError):
        common.scratch_dir(Unset)
    Unset.sparkContext.master = "local[4]"
    assert os.path.isdir(common.scratch_dir(Unset))


#: Names that an operator might use for a column of its own.
NAMES = ["_h", "_size", "_copy", "_id", "_once", "_null", "_slot", "_shard", "_lang", "_score", "rest", "row", "tag", "key", "rep", "kept", "slot", "size", "h", "base", "lang_pred", "known", "spans", "copies", "number"]
TEXTS = [None, "", " \n", "one two three four five six", "One two THREE four five six", "x" * 5000, "a b " * 3000, "日本 😀", "one two three four five six"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i % 7 if i % 4 else None, t, None if i % 3 else "en", None if i % 2 else "s") for i, t in enumerate(TEXTS * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return docs.withColumns({n: F.lit("own " + n) for n in NAMES})


@pytest.mark.parametrize("stage", [language_id.keep_identified, minhash.keep_representatives, lambda d: repeats.remove_repeats(d, repeats.Settings(width=400)), mixing.mix])
def test_stages_keep_columns_of_any_name(spark, odd, stage):
    out = stage(odd)
    assert out.columns == odd.columns
    assert all(r[n] == "own " + n for r in out.select(*NAMES).collect() for n in NAMES)
    assert stage(odd.limit(0)).count() == 0


@pytest.mark.parametrize(
    "report",
    [
        language_id.report,
        minhash.near_duplicates,
        repeats.repeat_report,
        mixing.report,
        mpeg_audio.text_media_digest,
        sharding.place,
        lambda d: token_count.count_tokens(d, PIECE_MODEL),
        lambda d: sentencepiece_codec.encode_documents(d, PIECE_MODEL),
    ],
)
def test_reports_have_a_row_for_each_row(spark, odd, report):
    assert report(odd).count() == odd.count()
    assert report(odd.limit(0)).count() == 0
