"""Known names in texts: a multi-pattern scan with word boundaries and typed keys.

The names go into an automaton that reads a text once, however many there are. An
alias table is dealt by hash to shards of at most ``SHARD`` characters on average;
each is one automaton, sent to the tasks in turn, so no task and not the driver
holds more than one shard's names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators.spans import lowered
from tessera.session import stored

#: Characters of a shard, and the shortest alias that is looked for in texts.
SHARD, SHORTEST = 1 << 24, 3


def keyed(names: DataFrame, keys: dict[str, Column], kind: str = "kind") -> DataFrame:
    """``names`` with ``key``: by its kind one of the given expressions; null for
    other kinds."""
    cases = [F.when(F.col(kind) == k, expression) for k, expression in keys.items()]
    return names.withColumn("key", F.coalesce(*cases))


def resolve(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """``names`` (kind, key, ...) with entity: that of the alias with its kind and key,
    the smallest of several, else null. A name whose kind is null takes the first
    kind in order that knows its key. Null and empty keys are nobody's."""
    known = aliases.where("key <> ''").groupBy(F.col("key").alias("known"), F.col("kind").alias("of")).agg(F.min("entity").alias("entity"))
    first = known.groupBy("known").agg(F.min(F.struct("of", "entity")).alias("first"))
    typed = names.where("kind is not null").join(known, F.expr("kind = of and key = known"), "left").select(*names.columns, "entity")
    free = names.where("kind is null").join(first, F.expr("key = known"), "left").select(*names.columns, F.col("first.entity").alias("entity"))
    return typed.unionByName(free)


def _scan(names, apart: bool = False):
    def boundary(c: str) -> bool:
        return not (c.isascii() and c.isalnum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = None
        for batch in batches:
            if automaton is None:
                automaton = ahocorasick.Automaton()
                for alias in names.value:
                    automaton.add_word(alias, alias)
                automaton.make_automaton()
            at, found = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                low, upto = lowered(text or ""), {}
                for last, alias in automaton.iter(low) if len(automaton) else ():
                    start, end = last + 1 - len(alias), last + 1
                    if apart:
                        if start < upto.get(alias, 0):
                            continue
                        upto[alias] = end
                    if (start == 0 or boundary(low[start - 1])) and (end == len(low) or boundary(low[end])):
                        at.append(k)
                        found.append((start, end, alias))
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), *columns], ["id", "start", "end", "low"])

    return run


def _lowered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("low", pa.array([lowered(a) for a in batch.column("alias").to_pylist()], pa.string()))


def spans(texts: DataFrame, aliases: DataFrame, id_col: str = "id", text_col: str = "text", shard: int = SHARD, apart: bool = False) -> DataFrame:
    """id, start, end, alias (in lower case), kind and entity of every alias in every
    text, nested and overlapping ones included; once for each entity that has it. With
    ``apart`` the occurrences of one alias are those that a text is split at: from the
    left, none within the one before, whatever stands around them.

    ``aliases`` has alias, kind and entity. Case doesn't count; a letter or digit
    (a-z, 0-9) before or after is no boundary. Aliases of fewer than three code
    points, null or empty ones and null texts find nothing. Offsets are code points.
    """
    spark = texts.sparkSession
    rows = aliases.where(F.length("alias") >= SHORTEST).select("alias", "kind", "entity")
    rows = stored(rows.mapInArrow(_lowered, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", low string").drop("alias").distinct())
    distinct = rows.select("low").distinct()
    shards = max(1, -(-int(distinct.agg(F.sum(F.length("low"))).first()[0] or 0) // shard))
    corpus = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = corpus.schema["id"].dataType.simpleString()
    parts = []
    for part in range(shards):
        mine = distinct.where(F.pmod(F.xxhash64("low"), F.lit(shards)) == part) if shards > 1 else distinct
        names = spark.sparkContext.broadcast(mine.toArrow().column("low").to_pylist())
        parts.append(corpus.mapInArrow(_scan(names, apart), f"id {kind}, start int, end int, low string"))
    found = functools.reduce(DataFrame.unionByName, parts)
    return found.distinct().join(rows, "low").select("id", "start", "end", F.col("low").alias("alias"), "kind", "entity")


def longest(found: DataFrame) -> DataFrame:
    """Of the spans of a text those that no longer span overlaps: the longest alias
    first, of equal ones the first in the text, then the first by kind and entity; each
    place of a text belongs to one span at most.

    A text's spans are folded in one array, which its length bounds.
    """
    order = F.struct((F.col("start") - F.col("end")).alias("less"), "start", "kind", "entity", "end", "alias")
    all_ = found.groupBy("id").agg(F.sort_array(F.collect_set(order)).alias("all"))
    taken = F.aggregate("all", F.filter("all", lambda x: F.lit(False)), lambda kept, x: F.when(F.exists(kept, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"])), kept).otherwise(F.concat(kept, F.array(x))))
    return all_.select("id", F.inline(taken)).select("id", "start", "end", "alias", "kind", "entity")
