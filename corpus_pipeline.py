"""Corpus preparation in five stages, each a DataFrame of documents for the next.

1. ``language_id`` drops documents whose language can't be told.
2. ``minhash_dedup`` keeps one document of each group of near duplicates
   (shingles of five words, similarity 0.8 or more).
3. ``suffix_array_dedup`` removes passages that occur more than once: runs of 51
   words, however short, and strings of 256 bytes.
4. ``mixing`` takes documents of each source, some twice, up to its target.
5. ``sentencepiece`` encodes what is left; its rows are the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import language_id, minhash, mixing, repeats, sentencepiece_codec
from tessera.llm.common import tidied
from tessera.llm.queries import PIECE_MODEL

#: Learned models and seeded choices aren't SQL; tests compare with brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_representatives(docs, minhash.Settings(words=5, percent=80))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(docs, repeats.Settings(width=256, words=51))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(docs, PIECE_MODEL)


STAGES = [
    ("language_id", identify_language),
    ("minhash_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written and read again, so the next ones, which
    read it several times, all get the same rows and nothing is made twice. A
    stage's own tables are deleted when it is done."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        with tidied(spark) as kept:
            docs = kept(stage(spark, docs, sf_dir))
    return docs
