"""Importance resampling towards a target distribution by external sort-count.

Every feature (a run of up to ``runs`` words) falls into one of at most 65,536
buckets by its CRC-32. The buckets of a portion of texts are written as one packed
stream of 16-bit numbers, with the offsets of its documents. All later steps read
only these streams, two bytes a feature: they are sorted and run-length encoded to
count the buckets of the corpus and of the target, and in a last pass the gains of
a stream's buckets are gathered and added up by document with ``np.add.reduceat``.

A bucket's gain is the logarithm of its smoothed share in the target over that in
the corpus, in thousandths. A document's score is its mean gain plus Gumbel noise
of its id, so the highest scores are a draw without replacement by weight. Scores
are sorted in ranges over all tasks and ranked by the counts of the ranges.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import LOWER, arrow, binary_column, group_starts, portions, ragged, stored, text_buffer, unused

#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` in lower-cased UTF-8.
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes of text in a stream, features that are sorted at once, and the longest
#: feature whose checksum is computed with those of others.
PORTION, RUN, SHORT = 1 << 17, 1 << 20, 64


@dataclass(frozen=True)
class Settings:
    """``percent`` of the documents of at least ``least_words`` words are drawn."""

    buckets: int = 10_000
    runs: int = 1
    least_words: int = 20
    percent: int = 10
    seed: int = 2024

    def __post_init__(self):
        if not 0 < self.buckets <= 1 << 16:
            raise ValueError("buckets are 16-bit numbers")


def _crc_table() -> np.ndarray:
    """CRC-32 of each byte, by its (reflected) polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


CRC = _crc_table()


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each span: those up to ``SHORT`` bytes advance together, longest first."""
    length = ends - starts
    order = np.argsort(np.minimum(length, SHORT + 1).astype(np.uint8), kind="stable")[::-1]
    long = int((length > SHORT).sum())
    out = np.empty(len(starts), np.uint32)
    for k in order[:long].tolist():
        out[k] = zlib.crc32(data[starts[k] : ends[k]])
    order = order[long:]
    at, size = starts[order], length[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -k, "left"))  # spans longer than k
        crc[:n] = CRC[(crc[:n] ^ data[at[:n] + k]) & np.uint32(0xFF)] ^ (crc[:n] >> np.uint32(8))
    out[order] = ~crc
    return out


def features(data: np.ndarray, offsets: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the features of each text, one text after another; their offsets;
    and the words of each text."""
    data = LOWER[data]
    inside = WORD[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    begin[edge] = inside[edge]
    starts = np.flatnonzero(begin)
    words = np.diff(np.searchsorted(starts, offsets))
    # the words alone, with a space after each, so a run of words is one span
    length = np.add.reduceat(inside, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    end = np.cumsum(length + 1)
    clean = np.full(int(end[-1]) if len(end) else 0, 0x20, np.uint8)
    first = end - length - 1
    clean[ragged(first, length)] = data[inside]
    owner, last = np.repeat(np.arange(len(words)), words), np.repeat(np.cumsum(words), words)
    made, of = [], []
    for n in range(settings.runs):
        i = np.flatnonzero(np.arange(len(owner)) + n < last)
        made.append((span_crcs(clean, first[i], end[i + n] - 1) % np.uint32(settings.buckets)).astype(np.uint16))
        of.append(owner[i])
    of_all = np.concatenate(of)
    stream = np.concatenate(made)
    if settings.runs > 1:
        stream = stream[np.argsort(of_all, kind="stable")]
    return stream, np.concatenate([[0], np.cumsum(np.bincount(of_all, minlength=len(words)))]), words


def _streams(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for i, j in portions(offsets, PORTION):
                stream, ends, words = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], settings)
                listed = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (batch.column("doc_id").slice(i, j - i), pa.array(words), pa.array(ends[1:]))]
                yield pa.RecordBatch.from_arrays([*listed, binary_column(stream.view(np.uint8), np.array([0, 2 * len(stream)]))], ["ids", "words", "ends", "stream"])

    return run


def streams(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored streams: ids, words and ends (of the features) of a portion's
    documents, and the packed buckets."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stored(rows.transform(arrow, _streams(settings), "ids array<long>, words array<long>, ends array<long>, stream binary"))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of buckets, each with its length."""
    for batch in batches:
        packed = np.frombuffer(text_buffer(batch.column("stream"))[0].tobytes(), np.uint16)
        for k in range(0, len(packed), RUN):
            run = np.sort(packed[k : k + RUN], kind="stable")
            starts = group_starts(run)
            yield pa.RecordBatch.from_arrays([pa.array(run[starts].astype(np.int32)), pa.array(np.diff(np.append(starts, len(run))))], ["bucket", "n"])


def bucket_counts(packed: DataFrame, settings: Settings) -> np.ndarray:
    """Features of each bucket over all streams: a number for each bucket, however
    large the corpus is."""
    found = packed.select("stream").transform(arrow, _counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(settings.buckets, np.int64)
    for r in found:
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(smoothed share in the target / that in the corpus)) of each bucket."""
    s, t, buckets = corpus.astype(np.float64), target.astype(np.float64), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _weights(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, words, ends = (batch.column(c).slice(row, 1).flatten() for c in ("ids", "words", "ends"))
                ends = np.concatenate([[0], ends.to_numpy()])
                n = np.diff(ends)
                full = n > 0
                weight = np.zeros(len(n), np.int64)
                if full.any():
                    packed = np.frombuffer(text_buffer(batch.column("stream").slice(row, 1))[0].tobytes(), np.uint16)
                    weight[full] = np.add.reduceat(gain[packed], ends[:-1][full]) // n[full]
                yield pa.RecordBatch.from_arrays([ids, words, pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return run


def scored(docs: DataFrame, target: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank for each row of ``docs``; those
    drawn have a rank, from 1.

    A null, empty or wordless text has no features and the weight 0. A null id has
    the hash of an empty one and comes before others of its score. Ties go to the
    smaller id; rows that repeat an id are drawn each by its own weight. An empty
    target is as even a distribution as the smoothing makes it. Other columns are
    ignored.
    """
    packed = streams(docs, settings, id_col, text_col)
    aim = streams(target.select(F.lit(None).cast("long").alias("doc_id"), F.col(target_col).alias("text")), settings)
    gain = gains(bucket_counts(packed, settings), bucket_counts(aim, settings))
    rows = packed.transform(arrow, _weights(gain), "doc_id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    rows = rows.withColumn("score", F.col("weight") + noise)
    able = F.col("n_words") >= settings.least_words
    # in the order of rank: the number tells a row's range of the sort and its place there
    order = stored(rows.where(able).orderBy(F.desc("score"), F.asc("doc_id"), "n_features", "weight").withColumn("at", F.monotonically_increasing_id()))
    sizes = order.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.expr("sum(n) over (order by part) - n")).drop("n")
    drawn = order.count() * settings.percent // 100
    place = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    ranked = order.join(F.broadcast(before), F.shiftright("at", 33) == F.col("part")).withColumn("rank", F.when(place <= drawn, place))
    names = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*names, "rank").union(rows.where(~able).select(*names, F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is drawn, columns unchanged, whatever their
    names: of rows that repeat an id all, if one is drawn. Rows without an id stay out."""
    name = unused("drawn_id", docs.columns)
    drawn = scored(docs, target, settings, id_col, text_col, target_col).where("rank is not null").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(drawn, docs[id_col].cast("long") == drawn[name], "left_semi")
