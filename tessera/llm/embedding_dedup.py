"""Near-duplicate vectors by randomly rotated binary codes.

A unit vector o, padded to the code's length and rotated, is coded by its signs:
the code is the unit vector x with entries of +-1/sqrt(bits). Its correction
factor <x, o> is stored with it. For another unit vector q, <x, q> / <x, o> is
an unbiased estimate of the cosine, whose error is within
``sigmas`` * sqrt((1 - <x, o>^2) / <x, o>^2 / (bits - 1)) but for a probability
that falls off as that of a normal variable. Pairs whose upper bound reaches the
threshold are computed exactly, in double precision; only those make links.

Pairs meet in tables keyed by disjoint parts of the code. The number of tables
follows from the length of their keys, so that a pair at the threshold is in no
common table with a probability of ``miss`` at most, and the length grows with
the logarithm of the largest label. A pair counts in the first table it shares.
Copies of a vector are one class; buckets above ``BLOCK`` classes are dealt to
cells of two blocks, so no task holds more than those.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import arrow, group_starts, local_components, stored, whole_groups
from tessera.llm.components import components, least_ids

BLOCK = 512
WHOLE = -1


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.98
    sigmas: float = 6.0
    miss: float = 1e-7
    least_bits: int = 256
    bucket: int = 64
    seed: int = 5


@dataclass(frozen=True)
class Tables:
    """``count`` tables with keys of ``bits`` of the code's ``length`` bits."""

    bits: int
    count: int
    length: int


def tables_for(vectors: int, settings: Settings) -> Tables:
    """Keys long enough for buckets of about ``settings.bucket`` unrelated vectors."""
    bits = min(48, max(4, math.ceil(math.log2(max(vectors, 1) / settings.bucket + 1))))
    agree = (1 - math.acos(min(1.0, settings.threshold)) / math.pi) ** bits
    count = max(1, math.ceil(math.log(settings.miss) / math.log(1 - agree))) if agree < 1 else 1
    return Tables(bits, count, max(settings.least_bits, -(-bits * count // 64) * 64))


@lru_cache(8)
def rotation(length: int, dim: int, seed: int) -> np.ndarray:
    """The columns of a random rotation of max(length, dim) that padding leaves."""
    rng = np.random.default_rng([seed, length, dim])
    return np.linalg.qr(rng.standard_normal((max(length, dim), dim)))[0]


def rotated(vectors: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Unit vectors in the rotated space; double precision, safe for any scale."""
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(1, keepdims=True)
    wide /= np.linalg.norm(wide, axis=1, keepdims=True)
    return wide @ rotation(length, vectors.shape[1], seed).T


def encode(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs (as bits) and correction factors."""
    return turned >= 0, np.abs(turned).sum(1) / math.sqrt(turned.shape[1])


def estimates(signs: np.ndarray, factors: np.ndarray, turned: np.ndarray, sigmas: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of coded vectors (rows) with ``turned`` (columns), and
    the half-width of the confidence interval of each row."""
    bits = turned.shape[1]
    code = np.where(signs, np.float32(1), np.float32(-1)) / np.float32(math.sqrt(bits))
    estimate = code @ turned.astype(np.float32).T / factors[:, None].astype(np.float32)
    return estimate, sigmas * np.sqrt(np.maximum(1 - factors**2, 0) / factors**2 / (bits - 1)) + 1e-5


def table_keys(signs: np.ndarray, tables: Tables) -> np.ndarray:
    """Key of each vector (row) in each table (column)."""
    used = signs[:, : tables.bits * tables.count].reshape(len(signs), tables.count, tables.bits)
    return used.astype(np.int64) @ (np.int64(1) << np.arange(tables.bits, dtype=np.int64))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = batch.column("vec").value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        for i in range(0, len(at), 2048):
            yield at[i : i + 2048], _matrix(batch.column("vec").take(pa.array(at[i : i + 2048])))


def _keys(tables: Tables, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, vectors in _by_dimension(batch):
                keys = table_keys(encode(rotated(vectors, tables.length, seed))[0], tables)
                part = batch.select(["label", "dim", "rep"]).take(pa.array(np.repeat(at, tables.count)))
                table = np.tile(np.arange(tables.count, dtype=np.int32), len(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(table), pa.array(keys.ravel())], ["label", "dim", "rep", "tab", "key"])

    return run


def cell_links(turned: np.ndarray, vectors: np.ndarray, sides: np.ndarray, table: int, tables: Tables, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (i < j) of a cell whose first common table is ``table``."""
    signs, factors = encode(turned)
    keys = table_keys(signs, tables)
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(1, keepdims=True)
    norm = np.linalg.norm(wide, axis=1)
    found = []
    for low in range(0, len(turned), 256):
        estimate, width = estimates(signs[low : low + 256], factors[low : low + 256], turned, settings.sigmas)
        i, j = np.nonzero(estimate + width[:, None] >= settings.threshold)
        i += low
        ok = (i < j) & ((sides[i] == WHOLE) | (sides[i] != sides[j]))
        i, j = i[ok], j[ok]
        for a in range(0, len(i), 1 << 15):
            x, y = i[a : a + (1 << 15)], j[a : a + (1 << 15)]
            exact = np.einsum("ij,ij->i", wide[x], wide[y]) / (norm[x] * norm[y])
            x, y = x[exact >= settings.threshold], y[exact >= settings.threshold]
            first = (keys[x] == keys[y]).argmax(1) == table
            found.append((x[first], y[first]))
    return tuple(np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def _links(tables: Tables, settings: Settings):
    """Per cell: each linked class, how many vectors it is linked with, and the
    least class of its component in the cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches, ["bucket", "cell"], least=2048):
            whole = whole.combine_chunks()
            bucket, cell, tab, rep, mult, side = (whole.column(c).to_numpy() for c in ("bucket", "cell", "tab", "rep", "mult", "side"))
            starts = group_starts(bucket, cell)
            out = []
            for a, b in zip(starts, np.append(starts[1:], len(rep))):
                vectors = _matrix(whole.column("vec").slice(a, b - a).combine_chunks())
                i, j = cell_links(rotated(vectors, tables.length, settings.seed), vectors, side[a:b], int(tab[a]), tables, settings)
                if not len(i):
                    continue
                total = np.bincount(i, mult[a + j], b - a) + np.bincount(j, mult[a + i], b - a)
                order = np.argsort(rep[a:b], kind="stable")
                place = np.empty(b - a, np.int64)
                place[order] = np.arange(b - a)
                root = rep[a:b][order[local_components(b - a, place[i], place[j])[place]]]
                hit = np.flatnonzero(total)
                out.append((rep[a + hit], total[hit].astype(np.int64), root[hit]))
            columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["rep", "n", "root"])

    return run


def near_duplicates(vectors: DataFrame, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``vectors``.

    Vectors are compared where labels and dimensions are equal and the label
    isn't null. A vector that is null, empty, zero or has a null or non-finite
    component is linked with nothing, nor is a row without an id, which has no
    component and isn't kept. Rows that repeat an id are vectors of their own, each
    with its own links; a component has the smallest of its rows' ids.
    Other columns are ignored.
    """
    vec = F.col(vector_col)
    good = F.exists(vec, lambda x: x != 0) & F.forall(vec, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    good = F.coalesce(good, F.lit(False))
    key = [F.when(good, F.xxhash64(F.lit(k), F.col(label_col), vec)) for k in (1, 2)]
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), vec.alias("vec"), key[0].alias("k1"), key[1].alias("k2"))
    one = rows.where("k1 is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("mult"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    # a class has a number of its own: rows that repeat an id may be in several
    classes = stored(one.withColumns({"dim": F.size("vec"), "rep": F.monotonically_increasing_id()}))
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    tables = tables_for(largest, settings)

    label = classes.schema["label"].dataType.simpleString()
    keyed = classes.select("label", "dim", "rep", "vec").transform(arrow, _keys(tables, settings.seed), f"label {label}, dim int, rep long, tab int, key long")
    keyed = stored(keyed.select(F.xxhash64("label", "dim", "tab", "key").alias("bucket"), "tab", "rep"))
    full = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("bucket", F.expr(f"cast(ceil(m / {BLOCK}) as int) as blocks"))
    dealt = keyed.join(full, "bucket").withColumn("own", F.expr("cast(pmod(xxhash64(rep), blocks) as int)")).withColumn("other", F.expr("explode(sequence(0, blocks - 1))"))
    dealt = dealt.selectExpr("bucket", "tab", "rep", "cast(least(own, other) as long) * 1000000 + greatest(own, other) as cell", f"cast(if(own = other, {WHOLE}, own) as long) as side")
    cells = dealt.join(classes.select("rep", "label", "dim", "mult", "vec"), "rep")
    # a bucket is a hash; of two buckets with one hash, the label and size keep the vectors apart
    cells = cells.withColumn("cell", F.xxhash64("cell", "label", "dim", "tab")).select("bucket", "cell", "tab", "rep", "mult", "side", "vec")
    links = stored(cells.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell").transform(arrow, _links(tables, settings), "rep long, n long, root long"))

    joined = least_ids(components(links.select(F.col("rep").alias("u"), F.col("root").alias("v"))), classes.select(F.col("rep").alias("node"), "id"))
    counts = links.groupBy("rep").agg(F.sum("n").alias("n"))
    final = classes.select("k1", "k2", "rep", "id", "mult").join(counts, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left")
    final = final.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("least", "id").alias("component"))
    component = F.coalesce("component", "vec_id")
    return rows.drop("vec", "label").join(final, ["k1", "k2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
