"""A stored inverted index: BM25 without a scan of the corpus.

Documents that a task reads together are ranges of at most ``size`` (apart by a
``cluster`` column, say the language). A block holds a term's postings of one range,
so it is bounded however frequent the term is, with the largest saturated frequency
in it; it is whole when it leaves the task that read its documents, so only finished
blocks are shuffled. Blocks lie in folders by term hash and are sorted by term: a
search reads the folders of its terms alone, and of most blocks only term, range and
bound.

A search sums the bounds of a query's terms by range: no document of a range can
score more. The ranges of the highest sums are scored first; the k-th best score
there is a threshold, and only ranges whose sum reaches it are scored after them.
What is skipped can't be among the k best, so the result is exact.

Folders of an index: ``terms``, ``blocks`` and, written last, ``about``; an index that
was cut short has no ``about`` and isn't loaded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from tessera.functions import text as T
from tessera.operators import retrieval as R
from tessera.session import stored

FORMAT = 1
#: Scores are rounded to six digits, and sums differ in the last of a double.
SLACK = 2e-6
#: Questions that a task scores at once.
QUESTIONS = 512


@dataclass(frozen=True)
class Index:
    about: Row
    terms: DataFrame
    blocks: DataFrame


def _saturated(tf, dl, avgdl: float, k1: float, b: float):
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def _shard(term: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(shards)).cast("int")


def _blocks(size: int, avgdl: float, k1: float, b: float):
    """Finished blocks of the ranges of a task: its documents as they come, apart by cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            apart = batch.column("apart").to_numpy()
            order = np.argsort(apart, kind="stable")
            edges = [0, *(np.flatnonzero(np.diff(apart[order])) + 1).tolist(), len(order)]
            for low, high in zip(edges, edges[1:]):
                for a in range(low, high, size):
                    part = batch.take(pa.array(order[a : min(a + size, high)]))
                    n = part.num_rows
                    dl = part.column("tokens").value_lengths().to_numpy()
                    found = part.column("tokens").flatten().dictionary_encode()
                    both, tf = np.unique(found.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), dl), return_counts=True)
                    term, doc = both // n, both % n
                    starts = np.flatnonzero(np.diff(term, prepend=-1))
                    ends = pa.array(np.append(starts, len(term)).astype(np.int32))
                    top = np.maximum.reduceat(_saturated(tf.astype(float), dl[doc], avgdl, k1, b), starts) if len(starts) else np.zeros(0)
                    lists = [pa.ListArray.from_arrays(ends, x) for x in (part.column("id").take(pa.array(doc)), pa.array(tf.astype(np.int32)), pa.array(dl[doc].astype(np.int32)))]
                    yield pa.RecordBatch.from_arrays([found.dictionary.take(pa.array(term[starts])), pa.array(np.full(len(starts), number)), pa.array(top), *lists], ["term", "range", "top", "ids", "tfs", "dls"])
                    number += 1

    return run


def save(corpus: DataFrame, path: str, cluster: str | None = None, size: int = 1024, shards: int = 16, files: int = 2, k1: float = R.K1, b: float = R.B, id_col: str = "id", text_col: str = "text", mode: str = "error") -> None:
    """Write the index of ``corpus`` to ``path``.

    A shard is a folder of ``files`` files; for a large corpus take so many that a
    file holds some hundred MB. ``mode`` is ``error`` or ``overwrite``. Documents
    without an id or without tokens are in no block but count for the mean length, as
    in ``bm25``.
    """
    spark = corpus.sparkSession
    n, avgdl = R.corpus_size(corpus, text_col).first()
    apart = F.lit(0).cast("long") if cluster is None else F.xxhash64(F.col(cluster))
    of = corpus.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), apart.alias("apart"), T.tokens(F.col(text_col)).alias("tokens"))
    kind = of.schema["id"].dataType.simpleString()
    blocks = of.mapInArrow(_blocks(size, avgdl or 1.0, k1, b), f"term string, range long, top double, ids array<{kind}>, tfs array<int>, dls array<int>")
    blocks = blocks.select(_shard(F.col("term"), shards).alias("shard"), "term", "range", "top", "ids", "tfs", "dls")
    # the ranges of a term spread over a shard's files, so a frequent term is in no single task
    dealt = blocks.repartition("shard", F.pmod(F.xxhash64("range"), F.lit(files))).sortWithinPartitions("shard", "term")
    dealt.write.mode(mode).partitionBy("shard").parquet(f"{path}/blocks")
    held = _read(spark, path, "blocks", kind).select("shard", "term", F.size("ids").cast("long").alias("df"), F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x).alias("cf"))
    terms = held.groupBy("shard", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    terms.repartition("shard").sortWithinPartitions("shard", "term").write.mode(mode).partitionBy("shard").parquet(f"{path}/terms")
    about = spark.range(1).select(*[F.lit(v).alias(k) for k, v in {"format": FORMAT, "n": n, "avgdl": avgdl or 0.0, "k1": k1, "b": b, "shards": shards, "size": size, "id_type": kind}.items()])
    about.write.mode(mode).parquet(f"{path}/about")


def load(spark: SparkSession, path: str) -> Index:
    """The index at ``path``; an error if it isn't whole or of another format."""
    about = spark.read.schema("format int, n long, avgdl double, k1 double, b double, shards int, size int, id_type string").parquet(f"{path}/about").first()
    if about is None or about["format"] != FORMAT:
        raise ValueError(f"{path} holds no index of format {FORMAT}")
    return Index(about, _read(spark, path, "terms", about["id_type"]), _read(spark, path, "blocks", about["id_type"]))


def _read(spark: SparkSession, path: str, name: str, kind: str) -> DataFrame:
    columns = {"terms": "term string, df long, cf long", "blocks": f"term string, range long, top double, ids array<{kind}>, tfs array<int>, dls array<int>"}
    return spark.read.schema(f"{columns[name]}, shard int").parquet(f"{path}/{name}")


def term_statistics(index: Index) -> DataFrame:
    """term, df (documents with it), cf (occurrences)."""
    return index.terms.select("term", "df", "cf")


def asked(index: Index, queries: DataFrame, weight_col: str | None = None) -> DataFrame:
    """qid, shard, term and w (idf and the query's weight) of the queries' terms that
    the index has. A repeated term counts once; ``weight_col`` gives terms with
    weights that aren't negative (array<struct<term, weight>>)."""
    if weight_col:
        q = queries.select("qid", F.inline(weight_col))
    else:
        q = queries.select("qid", F.explode(F.array_distinct(T.tokens(F.col("query")))).alias("term"), F.lit(1.0).alias("weight"))
    q = q.withColumn("shard", _shard(F.col("term"), index.about["shards"]))
    idf = F.log(1 + (F.lit(index.about["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return stored(q.join(_folders(index.terms, q), ["shard", "term"]).select("qid", "shard", "term", (F.col("weight") * idf).alias("w")))


def _folders(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """The shards of ``table`` that ``wanted`` names: as many numbers as an index has shards."""
    return table.where(F.col("shard").isin([r[0] for r in wanted.select("shard").distinct().collect()]))


def bounds(index: Index, terms: DataFrame) -> DataFrame:
    """qid, range and bound: what no document of the range can exceed for the query."""
    heads = _folders(index.blocks, terms).select("shard", "term", "range", "top")
    return heads.join(terms, ["shard", "term"]).groupBy("qid", "range").agg(F.sum(F.greatest(F.col("w") * F.col("top"), F.lit(0.0))).alias("bound"))


def _scored(a: Row, k: int | None):
    """The questions and blocks of a range -> (qid, id, score, matched), of each question
    the ``k`` best with all that tie with the last of them."""

    def run(asked: pa.Table, blocks: pa.Table) -> pa.Table:
        block = pc.index_in(asked.column("term").combine_chunks(), blocks.column("term").combine_chunks())
        asked, block = asked.filter(block.is_valid()), block.drop_null().to_numpy()
        lists = [blocks.column(c).combine_chunks() for c in ("ids", "tfs", "dls")]
        sizes = lists[0].value_lengths().to_numpy().astype(np.int64) if len(blocks) else np.zeros(0, np.int64)
        first = np.cumsum(sizes) - sizes
        docs = lists[0].flatten().dictionary_encode()
        doc, tf, dl = docs.indices.to_numpy(), lists[1].flatten().to_numpy().astype(float), lists[2].flatten().to_numpy()
        part = _saturated(tf, dl, a["avgdl"], a["k1"], a["b"])
        names = asked.column("qid").combine_chunks().dictionary_encode()
        q, w, d = names.indices.to_numpy(), asked.column("w").to_numpy(), len(docs.dictionary)
        score, matched = np.zeros(len(names.dictionary) * d), np.zeros(len(names.dictionary) * d, np.int64)
        for low in range(0, len(q), 4096):
            n = sizes[block[low : low + 4096]]
            at = np.arange(n.sum()) + np.repeat(first[block[low : low + 4096]] - (np.cumsum(n) - n), n)
            row = np.repeat(np.arange(low, low + len(n)), n)
            key = q[row] * d + doc[at]
            score += np.bincount(key, w[row] * part[at], len(score))
            matched += np.bincount(key, minlength=len(score))
        found = matched > 0
        if k is not None and d > k:
            rounded = np.round(np.where(found, score, -np.inf), R.DIGITS).reshape(-1, d)
            found &= (rounded >= np.partition(rounded, -k, axis=1)[:, -k, None]).ravel()
        at = np.flatnonzero(found)
        return pa.table([names.dictionary.take(pa.array(at // max(d, 1))), docs.dictionary.take(pa.array(at % max(d, 1))), pa.array(score[at]), pa.array(matched[at])], ["qid", "id", "score", "matched"])

    return run


def scores(index: Index, terms: DataFrame, ranges: DataFrame, k: int | None = None) -> DataFrame:
    """qid, id, score and matched of the documents of ``ranges(qid, range)``; with ``k``,
    of each range only those that can be among a question's ``k`` best.

    A range's blocks and ``QUESTIONS`` of its questions on average meet in one task,
    which has all terms of its documents and adds them up there.
    """
    parts = max(1, -(-terms.select("qid").distinct().count() // QUESTIONS))
    part = F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int").alias("part")
    held = ranges.select("qid", F.col("range").alias("of"))
    wanted = held.join(terms, "qid").select("of", part, "qid", "term", "w")
    blocks = _folders(index.blocks, terms).join(terms.select("shard", "term").distinct(), ["shard", "term"], "left_semi")
    blocks = blocks.join(held.select(F.col("of").alias("range")).distinct(), "range", "left_semi")
    blocks = blocks.select("range", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("turn"), "term", "ids", "tfs", "dls")
    types = {f.name: f.dataType.simpleString() for f in terms.schema.fields}
    schema = f"qid {types['qid']}, id {index.about['id_type']}, score double, matched long"
    return wanted.groupBy("of", "part").cogroup(blocks.groupBy("range", "turn")).applyInArrow(_scored(index.about, k), schema)


def search(index: Index, queries: DataFrame, k: int, first: int = 8, weight_col: str | None = None) -> DataFrame:
    """qid, id, score, matched and rank: the ``k`` best documents of each query by
    BM25, with what ``bm25`` and ``top_k`` give over the corpus.

    The ``first`` ranges of a query by bound set its threshold. A query without a
    term of the index has no rows.
    """
    terms = asked(index, queries, weight_col)
    sums = stored(bounds(index, terms))
    probe = R.top_k(sums, first, "bound", "range").select("qid", "range")
    probe = stored(probe)
    seen = stored(scores(index, terms, probe, k))
    least = R.top_k(seen, k).groupBy("qid").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("held")).where(F.col("held") == k)
    more = surviving(sums, least).join(probe, ["qid", "range"], "left_anti")
    return R.top_k(seen.unionByName(scores(index, terms, more, k)), k)


def surviving(sums: DataFrame, least: DataFrame) -> DataFrame:
    """The ranges whose bound reaches the query's threshold ``least(qid, least)``,
    all of a query that has none."""
    return sums.join(least.select("qid", "least"), "qid", "left").where(F.col("least").isNull() | (F.col("bound") + SLACK >= F.col("least"))).select("qid", "range")
