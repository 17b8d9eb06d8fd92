"""Plans made of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.functions import text as T
from tessera.operators import chunking, ranking, registry, retrieval


def hybrid(corpus: DataFrame, queries: DataFrame, dims: int = 64, depth: int = 120, k: int = 10, dense_weight: float = 0.7, sparse_weight: float = 0.3) -> DataFrame:
    """qid, id, score, rank: BM25 and hashed-embedding rankings fused by RRF.

    ``corpus`` has id and text, ``queries`` qid and query. BM25 scores documents that
    share a term with the query; of the vectors the nearest are found by blocks of
    queries, of which only the ``depth`` best of a batch leave a task.
    """
    sparse = retrieval.bm25_top_k(corpus, queries, depth)
    probe = retrieval.hash_vectors(queries.select(F.col("qid").alias("id"), F.col("query").alias("text")), dims).toDF("qid", "query")
    dense = retrieval.dense_top_k(retrieval.hash_vectors(corpus, dims), probe, depth, id_col="id", vector_col="vector")
    return retrieval.top_k(retrieval.rrf([(dense, dense_weight), (sparse, sparse_weight)]), k)


def ingest(base: DataFrame, manifest: DataFrame, current: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunk table, manifest and plan after an incremental run.

    ``current`` is the whole input; ``base`` the chunk table (with ``id``),
    ``manifest`` the hashes of the last run. Only new and changed documents are
    chunked; chunks of changed and deleted ones go. A second run changes nothing.
    """
    seen = current.select(key, T.short_hash(F.col(text), 64).alias("digest"))
    plan = registry.change_plan(manifest, seen, key, "digest")
    gone = plan.where("status in ('changed', 'deleted')").select(F.col(key).alias("id"))
    fresh = current.join(plan.where("status in ('new', 'changed')").select(key), key, "left_semi")
    chunks = registry.delete(base, gone, "id").unionByName(chunking.chunks(fresh, id_col=key, text_col=text))
    return chunks, seen, plan


def answer_context(hits: DataFrame, chunks: DataFrame, budget: int) -> DataFrame:
    """qid, id, pos, tokens, kept: ranked chunks packed into a token budget."""
    rows = hits.join(chunks, "id").select("qid", "id", F.col("rank").alias("pos"), T.tokens(F.col("text")).alias("tokens"))
    return ranking.pack_context(rows, budget, by="qid")
