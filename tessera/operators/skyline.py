"""Pareto frontiers over any number of measures without comparing all pairs.

Points are dealt to parts of bounded size. In a part they are read in falling order
of their sum, so a point is only compared with those before it that nothing beats;
few are left. Those are dealt to blocks, and each two blocks of a group meet in one
cell, whose points are compared both ways. No task holds more than a part or a cell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.session import stored

#: Points of a part and of a block, and how many are compared at once.
PART, BLOCK, STEP = 1 << 15, 2048, 512


def beaten(points: np.ndarray, rivals: np.ndarray) -> np.ndarray:
    """Which points some rival equals or exceeds in all measures and exceeds in one."""
    out = np.zeros(len(points), bool)
    for a in range(0, len(rivals), STEP):
        at = np.flatnonzero(~out)
        r = rivals[a : a + STEP]
        for b in range(0, len(at), STEP):
            p = points[at[b : b + STEP]]
            least, more = np.ones((len(p), len(r)), bool), np.zeros((len(p), len(r)), bool)
            for m in range(points.shape[1]):
                least &= r[None, :, m] >= p[:, m, None]
                more |= r[None, :, m] > p[:, m, None]
            out[at[b : b + STEP]] = (least & more).any(1)
    return out


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table.column("v").combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _unbeaten(table: pa.Table) -> pa.Table:
    """The points of a part that no other of it beats."""
    v = _matrix(table)
    v_order = np.argsort(-v.sum(1), kind="stable")
    kept = v_order[:0]
    for a in range(0, len(v), STEP):
        at = v_order[a : a + STEP]
        at = at[~beaten(v[at], v[kept])]
        kept = np.concatenate([kept, at[~beaten(v[at], v[at])]])
    return table.select(["g", "pid", "v"]).take(pa.array(kept))


def _lost(table: pa.Table) -> pa.Table:
    """The points of a cell that one of the other block (of its own, in a cell of one
    block) beats."""
    v, own = _matrix(table), table.column("own").to_numpy()
    sides = [np.flatnonzero(own == k) for k in np.unique(own)]
    pairs = [(a, b) for a in sides for b in sides if a is not b] or [(sides[0], sides[0])]
    gone = np.concatenate([a[beaten(v[a], v[b])] for a, b in pairs])
    return table.select(["pid"]).take(pa.array(np.unique(gone)))


def frontier(df: DataFrame, better: list[str], by: list[str] | None = None, part: int = PART, block: int = BLOCK) -> DataFrame:
    """The distinct combinations of ``by`` and the measures ``better`` (more is better)
    that no other of their group beats: equal or more in all, and more in one.

    Rows with a null or NaN measure are left out: they neither beat nor are beaten.
    """
    keys = by or []
    names = {**{f"k{i}": c for i, c in enumerate(keys)}, **{f"m{i}": c for i, c in enumerate(better)}}
    measures = [n for n in names if n[0] == "m"]
    whole = df.where(" and ".join(f"`{m}` is not null and not isnan(cast(`{m}` as double))" for m in better)).select(*[F.col(c).alias(n) for n, c in names.items()]).distinct()
    points = stored(whole.withColumns({"pid": F.monotonically_increasing_id(), "g": F.xxhash64(F.lit(0), *[n for n in names if n[0] == "k"])}))
    rows = points.select("g", "pid", F.array(*[F.col(m).cast("double") for m in measures]).alias("v"))

    def blocks(of: DataFrame, size: int) -> DataFrame:
        """``of`` with ``own``, the block of a point, and ``n``, how many its group has."""
        counts = of.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("n"))
        return of.join(counts, "g").withColumn("own", F.pmod(F.xxhash64("pid"), F.col("n")).cast("int"))

    left = stored(blocks(rows, part).groupBy("g", "own").applyInArrow(_unbeaten, "g long, pid long, v array<double>"))
    dealt = blocks(left, block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    cells = dealt.select("g", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "pid", "v")
    gone = cells.groupBy("g", "low", "high").applyInArrow(_lost, "pid long").distinct()
    best = left.select("pid").join(gone, "pid", "left_anti")
    return points.join(best, "pid", "left_semi").select(*[F.col(n).alias(c) for n, c in names.items()])
