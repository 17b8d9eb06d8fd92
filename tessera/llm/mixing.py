"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a target number of words. Its documents are first taken whole
as often as fits; for the words that remain, the source's documents are counted
by exact length and a number of documents of each length is fitted: most of the
budget in proportion to the lengths, the rest by a bounded-knapsack dynamic
program over the remaining counts. The documents of a length that are taken
once more are those with the least seeded hash.

A fit sees one row for each distinct length of a source, not its documents. The
hash limit of a length is found by counts of hash ranges, so only one range of
about 128 documents is ranked for each length, however many share it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a budget that the dynamic program gets, besides the last document's.
PROGRAM = 1 << 15
RANGE = 128


@dataclass(frozen=True)
class Settings:
    """``weights`` repeat over the sources in code-point order, null last. All
    targets add up to ``share`` of all words; none exceeds ``most`` times its
    source."""

    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    share: float = 1.5
    most: float = 2.0
    seed: int = 11


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Numbers of items of each length, within ``counts``, whose lengths add up
    to the largest reachable sum that isn't above ``budget``."""
    taken = np.zeros(len(lengths), np.int64)
    if budget <= 0 or not len(lengths):
        return taken
    items = []
    for k, (length, count) in enumerate(zip(lengths.tolist(), counts.tolist())):
        left, size = min(count, budget // length), 1
        while left > 0:
            n = min(size, left)
            items.append((k, n, n * length))
            left, size = left - n, size * 2
    by = np.full(budget + 1, -1, np.int32)
    reach, mask = 1, (1 << budget + 1) - 1
    for i, (_, _, weight) in enumerate(items):
        new = reach << weight & mask & ~reach
        if new:
            bits = np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8)
            by[np.flatnonzero(np.unpackbits(bits, bitorder="little")[: budget + 1])] = i
            reach |= new
            if reach >> budget & 1:
                break
    total = reach.bit_length() - 1
    while total:
        k, n, weight = items[by[total]]
        taken[k] += n
        total -= weight
    return taken


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Documents of each length that together come near ``budget`` words from
    below, spread over the lengths in proportion.

    The program's part is exact: no choice of the documents then left comes
    nearer. Where few, very long documents leave more than that part can hold,
    the longest that fits goes first; the gap is then still smaller than the
    shortest document that isn't taken."""
    order = np.argsort(-lengths, kind="stable")
    lengths, counts = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    taken = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    real = lengths > 0
    direct = max(0, budget - PROGRAM)
    if total and direct:
        used = wanted = 0
        for k in np.flatnonzero(real).tolist():
            wanted += int(lengths[k] * counts[k]) * direct // total
            taken[k] = min(int(counts[k]), max(0, wanted - used) // int(lengths[k]))
            used += int(taken[k] * lengths[k])
        for k in np.flatnonzero(real).tolist():
            more = min(int(counts[k] - taken[k]), max(0, direct - used) // int(lengths[k]))
            taken[k] += more
            used += more * int(lengths[k])
    left = int(min(budget, total) - (taken * lengths).sum())
    while left > 4 * PROGRAM:  # few, very long documents: the largest that fits
        fits = np.flatnonzero(real & (lengths <= left - PROGRAM) & (taken < counts))
        if not len(fits):
            break
        taken[fits[0]] += 1
        left -= int(lengths[fits[0]])
    free = real & (taken < counts) & (lengths <= left)
    taken[free] += knapsack(lengths[free], (counts - taken)[free], left)
    out = np.empty(len(taken), np.int64)
    out[order] = taken
    return out


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    lengths, counts = rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    total, target = int((lengths * counts).sum()), float(rows["target"].iloc[0])
    base = int(target // total) if total else 0
    extra = fit_counts(lengths, counts, round(target - base * total)) if total else np.zeros(len(rows), np.int64)
    return pd.DataFrame({"source": rows["source"], "size": lengths, "n": counts, "base": base, "extra": extra})


def targets(totals: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """source, source_size, target: shares by weight, none above its limit, what
    is above shared again by weight.

    Sources are few: one row each is ordered in one task.
    """
    weights = F.element_at(F.array(*[F.lit(float(w)) for w in settings.weights]), F.pmod(F.expr("row_number() over (order by source is null, source)") - 1, F.lit(len(settings.weights))) + 1)
    rows = totals.withColumn("w", weights).withColumn("top", settings.most * F.col("source_size"))
    rows = rows.selectExpr("*", "top / w as ratio", f"{settings.share} * sum(source_size) over () as budget", "sum(w) over () as all_w")
    before = "over (order by ratio, source is null, source rows between unbounded preceding and 1 preceding)"
    rows = rows.selectExpr("*", f"(budget - coalesce(sum(top) {before}, 0)) / (all_w - coalesce(sum(w) {before}, 0)) as level")
    # levels fall until the first source below its limit and don't rise before it
    rows = rows.selectExpr("*", "min(case when level < ratio then struct(ratio, source is null as last, coalesce(source, '') as name, level) end) over () as water")
    return rows.selectExpr("source", "source_size", "cast(case when level < ratio then w * water.level else top end as double) as target")


def _matched(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right`` where keys are equal, null with null."""
    other = right.withColumnsRenamed({n: f"_{n}" for n in names})
    return left.join(other, [left[n].eqNullSafe(other[f"_{n}"]) for n in names], how).drop(*[f"_{n}" for n in names])


def plan(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Sizes and hashes of the rows, and for each source and size: source_size,
    target, base (copies of all), cut (one more copy up to this hash), ties (rows
    with the hash at the cut) and some (how many of these are taken)."""
    rows = stored(_tagged(docs, settings, id_col, text_col, source_col, doc_id=F.col(id_col).cast("long")))
    lengths = stored(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    goal = stored(targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), settings))
    known = _matched(lengths, goal.select("source", "target"), ["source"])
    fitted = stored(known.groupBy("source").applyInPandas(_fit, "source string, size long, n long, base long, extra long"))

    part = fitted.where("extra > 0 and extra < n").select("source", "size", "extra", F.ceil(F.col("n") / RANGE).alias("ranges"))
    place = F.floor(F.col("h") / F.lit(float(1 << 62)) * F.col("ranges"))
    spread = stored(_matched(rows, part, ["source", "size"]).select("source", "size", "extra", "h", place.alias("range")))
    counted = spread.groupBy("source", "size", "range").agg(F.count(F.lit(1)).alias("m"), F.first("extra").alias("extra"))
    counted = counted.withColumn("upto", F.expr("sum(m) over (partition by source, size order by range)"))
    edge = counted.where("upto >= extra and upto - m < extra").select("source", "size", "range", (F.col("extra") - F.col("upto") + F.col("m")).alias("place"))
    near = _matched(spread.drop("extra"), edge, ["source", "size", "range"]).groupBy("source", "size", "h").agg(F.count(F.lit(1)).alias("ties"), F.first("place").alias("place"))
    near = near.withColumn("upto", F.expr("sum(ties) over (partition by source, size order by h)"))
    cut = near.where("upto >= place and upto - ties < place").selectExpr("source", "size", "h as cut", "ties", "place - upto + ties as some")
    last = F.expr(f"case when extra = 0 then -1 when extra = n then {(1 << 62) - 1} else cut end")
    whole = _matched(fitted, cut, ["source", "size"], "left").select("source", "size", "base", last.alias("cut"), F.coalesce("ties", F.lit(0)).alias("ties"), F.coalesce("some", F.lit(0)).alias("some"))
    return rows, stored(_matched(whole, goal, ["source"]))


def numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``number``, from 1 within equal ``keys``. They are written
    first, so the numbers stay. A window sees the rows of one key and partition;
    sums over the partitions' counts do the rest."""
    held = stored(rows.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    names = ", ".join(keys)
    counts = held.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.expr(f"sum(n) over (partition by {names} order by part) - n")).drop("n")
    own = held.withColumn("own", F.expr(f"row_number() over (partition by {names}, part order by at)"))
    return _matched(own, before, [*keys, "part"]).withColumn("number", F.col("own") + F.col("before")).drop("own", "before", "part", "at")


def _copies(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """``rows(source, size, h, ...)`` with what was ``chosen`` for them, and
    ``copies``. Of rows with the hash at the cut only some may be taken once more:
    those are numbered."""
    joined = _matched(rows, chosen, ["source", "size"])
    copies = lambda more: F.when(F.col("size") > 0, F.col("base") + more.cast("int")).otherwise(0).cast("int")
    plain = joined.withColumn("copies", copies(F.col("h") <= F.col("cut")))
    if chosen.where("some < ties").isEmpty():
        return plain
    tied = F.expr("h = cut and some < ties")
    return plain.where(~tied).unionByName(numbered(joined.where(tied), ["source", "size"]).withColumn("copies", copies(F.col("number") <= F.col("some"))).drop("number"))


def _tagged(docs: DataFrame, settings: Settings, id_col: str, text_col: str, source_col: str, **more: Column) -> DataFrame:
    """source, size and seeded hash of each row, and ``more``."""
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    h = F.shiftrightunsigned(F.xxhash64(F.lit(settings.seed), F.col(id_col), F.col(text_col)), 2)
    return docs.select(F.col(source_col).cast("string").alias("source"), size.alias("size"), h.alias("h"), *[c.alias(n) for n, c in more.items()])


def report(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target and taken for each row of ``docs``.

    Null texts and texts without words have size 0 and are never taken. A null
    source is a source, the last. Rows that repeat an id and text are rows of
    their own; which of them is taken once more is their order in the table.
    Other columns are ignored.
    """
    rows, chosen = plan(docs, settings, id_col, text_col, source_col)
    return _copies(rows, chosen).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row as often as the mix takes it, columns unchanged,
    whatever their names. Nulls, ties and repeated rows as in ``report``."""
    _, chosen = plan(docs, settings, id_col, text_col, source_col)
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = _copies(_tagged(docs, settings, id_col, text_col, source_col, rest=rest), chosen)
    each = rows.select("rest", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy"))
    return each.select(*[F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
