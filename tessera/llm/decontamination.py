"""Benchmark passages in documents by a prefix-filtered set join, in DataFrame
operations alone.

An item's windows are its runs of ``width`` words; a shorter item is one window. A
window is a set of shingles (``shingle`` words each, fewer for a shorter item) with
their places. A document holds a window only if it holds all its shingles, so the
prefix that a join needs is one shingle: the rarest, by the shingles' counts over all
documents. A window with a shingle that no document has is dropped at once.

Of the documents' shingles only those leave the scan whose bit is set in a map of
fixed size, made of the windows' shingles. Where one of them is a window's rarest,
its place gives the window's start and, with the width, bounds it within the document:
a shingle gives at most a few starts, however many windows share it. The words at
these starts are then joined with the windows' words, which is exact.

Items are found for each distinct set of windows once and not for each document, so a
passage that many documents and many items share doesn't multiply.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same where A-Z aren't lower-cased yet.
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Longs of the map of shingles: 4,194,304 bits, 512 KB.
LONGS = 1 << 16


@dataclass(frozen=True)
class Settings:
    width: int = 10
    shingle: int = 3


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWERED), F.lit(WORD), F.lit(0))


def _shingles(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, by place."""
    places = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.lit(size), *[words[i + k] for k in range(size)]))


def windows(items: DataFrame, settings: Settings = Settings(), id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """window (its words with a space between), n (how many) and item, each once.
    An item without an id has none of its own to report (null)."""
    each = items.select(F.col(id_col).cast("string").alias("item"), _words(F.col(text_col)).alias("words")).where("size(words) > 0")
    each = each.withColumn("n", F.least(F.size("words"), F.lit(settings.width)))
    runs = F.transform(F.sequence(F.lit(0), F.size("words") - F.col("n")), lambda i: F.array_join(F.slice("words", i + 1, F.col("n")), " "))
    return each.select("item", "n", F.explode(runs).alias("window")).distinct()


def _known(hashes: DataFrame, h: str) -> Column:
    """Whether the bit of column ``h`` is set by one of ``hashes(h)``: true for all of
    these and few others. The map is an array of ``LONGS`` longs, however many set it."""
    place = F.shiftright(h, 6).bitwiseAND(LONGS - 1)
    bits = hashes.groupBy(place.alias("id")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({h} & 63 as int))")).alias("bits"))
    every = hashes.sparkSession.range(LONGS).join(bits, "id", "left").select(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("x"))
    known = stored(every.agg(F.sort_array(F.collect_list("x")).alias("all")).select(F.col("all.bits").alias("map")))
    return F.getbit(F.element_at(known.scalar(), place.cast("int") + 1), F.col(h).bitwiseAND(63).cast("int")) == 1


def _row_keys(id_col: str, text_col: str) -> list[Column]:
    """128 bits that tell a document's id and text."""
    return [F.xxhash64(F.lit(k), F.col(id_col), F.col(text_col)).alias(f"k{k}") for k in (1, 2)]


def passages(docs: DataFrame, items: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """k1, k2 (of a document's id and text), start (in words, from 0), n and wid of
    each window that a document holds; and wid and item of all windows."""
    held = stored(windows(items, settings, item_col, item_text_col))
    distinct = stored(held.select("window", "n").distinct().withColumn("wid", F.monotonically_increasing_id()))
    size = F.least(F.col("n"), F.lit(settings.shingle))
    sizes = sorted(r[0] for r in distinct.select(size).distinct().collect())  # at most ``shingle`` numbers
    parts = [distinct.where(size == k).select("wid", "n", F.split("window", " ").alias("words")).select("wid", "n", F.posexplode(_shingles(F.col("words"), k)).alias("at", "h")) for k in sizes]
    named = [F.col("item"), F.col("wid")]
    if not parts:
        nothing = distinct.select(*[F.lit(0).cast("long").alias(c) for c in ("k1", "k2")], F.lit(0).alias("start"), "n", "wid")
        return nothing, held.join(distinct, "window").select(*named)
    every = parts[0]
    for more in parts[1:]:
        every = every.union(more)
    every = stored(every)

    keys = _row_keys(id_col, text_col)
    texts = docs.where(F.col(text_col).isNotNull()).select(*keys, F.col(text_col).alias("text"))
    split = texts.select("k1", "k2", _words(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    places = [split.select("k1", "k2", "n_words", F.posexplode(_shingles(F.col("words"), k)).alias("pos", "h")) for k in sizes]
    seen = places[0]
    for more in places[1:]:
        seen = seen.union(more)
    seen = stored(seen.where(_known(every, "h")))

    counts = seen.groupBy("h").agg(F.count(F.lit(1)).alias("m"))
    rarest = every.join(counts, "h", "left").groupBy("wid", "n").agg(F.count("m").alias("found"), F.count(F.lit(1)).alias("all"), F.min(F.struct("m", "h", "at")).alias("first"))
    anchors = stored(rarest.where("found = all").select("first.h", "first.at", "n").distinct())
    starts = seen.join(anchors, "h").select("k1", "k2", (F.col("pos") - F.col("at")).alias("start"), "n", "n_words").where("start >= 0 and start + n <= n_words")
    starts = stored(starts.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "n")).alias("starts")))

    # few texts but those that have starts leave the scan
    split = texts.where(_known(starts, "k1")).join(starts, ["k1", "k2"]).select("k1", "k2", "starts", _words(F.col("text")).alias("words"))
    there = lambda s: F.when(F.size("words") >= s["start"] + s["n"], F.array_join(F.slice("words", s["start"] + 1, s["n"]), " "))
    cut = split.select("k1", "k2", F.inline(F.transform("starts", lambda s: F.struct(s["start"].alias("start"), there(s).alias("window")))))
    return cut.join(distinct, "window").select("k1", "k2", "start", "n", "wid"), held.join(distinct, "window").select(*named)


def report(docs: DataFrame, items: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each row of
    ``docs``.

    Null, empty and wordless texts have no words and are not contaminated; such items
    have no windows. An item without an id makes words hit but isn't among the items.
    Rows that repeat an item's id are one item; rows that repeat a document's id are
    judged each by its own text. Other columns are ignored.
    """
    found, of_window = passages(docs, items, settings, id_col, text_col, item_col, item_text_col)
    span = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("upto")),
        lambda a, s: F.struct((a["hit"] + F.greatest(F.lit(0), s["start"] + s["n"] - F.greatest(s["start"], a["upto"]))).alias("hit"), F.greatest(a["upto"], s["start"] + s["n"]).alias("upto")),
        lambda a: a["hit"],
    )
    found = found.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "n")).alias("spans"), F.sort_array(F.collect_set("wid")).alias("wids"))
    found = stored(found.select("k1", "k2", span.alias("n_hit"), "wids", F.sha2(F.array_join(F.col("wids").cast("array<string>"), ","), 256).alias("set")))
    sets = found.groupBy("set").agg(F.first("wids").alias("wids"))
    listed = sets.select("set", F.explode("wids").alias("wid")).join(of_window, "wid").where("item is not null").select("set", "item").distinct()
    listed = listed.groupBy("set").agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("items_sha256"))
    hit = found.select("k1", "k2", "n_hit", "set").join(listed, "set", "left").drop("set")

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.regexp_count(text_col, F.lit(ANY_CASE)), F.lit(0)).cast("long").alias("n_words"), *_row_keys(id_col, text_col))
    zero = F.lit(0).cast("long")
    return rows.join(hit, ["k1", "k2"], "left").select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"))
