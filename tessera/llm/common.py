"""Helpers shared by the operators: Arrow buffers as numpy arrays, 64-bit
hashes, runs of whole groups out of sorted partitions, and scratch tables."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
BASE = 0x9E3779B97F4A7C55 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


# ---------------------------------------------------------------- scratch


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A temporary folder is used only where that setting is absent and everything
    runs in one process; on a cluster its absence is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (where or _own_scratch()).rstrip("/")


@cache
def _own_scratch() -> str:
    return tempfile.mkdtemp(prefix="tessera-")


def stored(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back; in few files
    if it is known to have at most some ``rows``.

    The lineage is cut, so a lost executor costs a reread and not a
    recomputation. The table stays until an enclosing ``tidied`` deletes it.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tessera-{uuid.uuid4().hex}"
    for made in _made[-1:]:
        made.append(path)
    schema = df.schema
    (df if rows is None else df.coalesce(1 + rows // ROWS)).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


#: Rows of a task that writes a table of a known size.
ROWS = 1 << 16
_made: list[list[str]] = []


@contextmanager
def tidied(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables that ``stored`` writes within. What is needed later goes
    through the function that it gives: that writes a table which stays.

        with tidied(spark) as kept:
            result = kept(near_duplicates(docs))
    """
    _made.append([])

    def kept(df: DataFrame) -> DataFrame:
        out = stored(df)
        last = _made[-1].pop()
        for made in _made[-2:-1]:
            made.append(last)
        return out

    try:
        yield kept
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path
        for path in _made.pop():
            where = folder(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose workers give freed memory back when a task ends."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(released, schema)


def give_back() -> None:
    """Return free memory to the system: Arrow's pool, and the C library's where
    it has a call for it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def unused(name: str, names: list[str]) -> str:
    """``name``, with underscores if a column has it."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name += "_"
    return name


# ---------------------------------------------------------------- buffers


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the offsets of its values.

    A null counts as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, at, data = column.buffers()
    if n == 0 or at is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def portions(offsets: np.ndarray, limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of values of at most ``limit`` bytes, or one longer value."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each of many runs, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def binary_column(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], weight: str | None = None, least: int = 1 << 20) -> Iterator[pa.Table]:
    """Tables of whole groups out of a stream that is sorted by ``keys``.

    Groups are gathered until they have ``least`` rows, or bytes of column
    ``weight``.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column(weight).nbytes if weight else batch.num_rows
        if size < least:
            continue
        table = pa.Table.from_batches(held)
        cut = _last_group(table, keys)
        if cut:
            yield table.slice(0, cut)
            rest = table.slice(cut).combine_chunks()
            held = rest.to_batches()
        size = sum(b.column(weight).nbytes if weight else b.num_rows for b in held)
    if held:
        yield pa.Table.from_batches(held)


def _last_group(table: pa.Table, keys: list[str]) -> int:
    same = np.ones(table.num_rows, bool)
    for k in keys:
        column = table.column(k).combine_chunks().to_numpy(zero_copy_only=False)
        same &= column == column[-1]
    return int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """First positions of the runs of equal keys."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def pairs_within(starts: np.ndarray, n: int, limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j of positions in the same group, some at a time."""
    ends = np.append(starts[1:], n)
    after = np.repeat(ends, ends - starts) - np.arange(n) - 1
    total = np.concatenate([[0], np.cumsum(after)])
    for i, j in portions(total, limit):
        count = after[i:j]
        first = np.repeat(np.arange(i, j), count)
        yield first, ragged(np.arange(i, j) + 1, count)


# ----------------------------------------------------------------- hashes


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Powers:
    """Powers of the hash base and of its inverse, as far as they were asked for."""

    up = np.ones(1, U64)
    down = np.ones(1, U64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up), 1 << 16)
            for name, base in (("up", BASE), ("down", BASE_INVERSE)):
                p = np.full(size, base, U64)
                p[0] = 1
                setattr(cls, name, np.multiply.accumulate(p))
        return cls.up[:n], cls.down[:n]


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hash`` gets the hash of any span."""
    up, _ = Powers.upto(len(symbols) + 1)
    out = np.zeros(len(symbols) + 1, U64)
    terms = symbols.astype(U64)
    terms += U64(1)
    terms *= up[:-1]
    np.cumsum(terms, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = Powers.upto(len(prefix))
    return mix64((prefix[ends] - prefix[starts]) * down[starts])


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and words per value."""
    inside = ~SPACE[data]
    n = len(data)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < n]
    begin[edge] = inside[edge]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    last = offsets[1:] - 1
    last = last[last >= 0]
    finish[last] = inside[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    per = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, per


class HashMemory:
    """Numbers remembered by 64-bit hash: sorted levels that are merged as they
    grow, so adding stays cheap however many there are."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def __len__(self) -> int:
        return sum(len(k) for k, _ in self.levels)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is known, and its number (0 where it isn't)."""
        known, value = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        for level, numbers in self.levels:
            at = np.minimum(np.searchsorted(level, keys), len(level) - 1)
            hit = level[at] == keys
            known |= hit
            value[hit] = numbers[at[hit]]
        return known, value

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Remember new, distinct keys."""
        if not len(keys):
            return
        self.levels.append((keys, values))
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) >= len(self.levels[-2][0]):
            (a, x), (b, y) = self.levels.pop(), self.levels.pop()
            self.levels.append((np.concatenate([b, a]), np.concatenate([y, x])))
        key, value = self.levels[-1]
        order = np.argsort(key)
        self.levels[-1] = key[order], value[order]


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each of ``n`` positions over links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        open_ = label[a] != label[b]
        if np.array_equal(before, label) and not open_.any():
            break
        a, b = a[open_], b[open_]
    return label
