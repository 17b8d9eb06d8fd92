"""Removal of long repeated strings with run-length indexes.

A string of ``width`` bytes belongs to the shard named by the least hash of
the k-grams inside it, so equal strings always meet in one shard. Neighbouring
strings with the same least hash form one segment; shards with a single segment
hold no repeat and are dropped after a count. Of the rest, segments with equal
bytes are kept once, and each shard's distinct segments go into a run-length
index (``run_index``) whose self-matching statistics say which strings also
start elsewhere. A shard with many distinct segments (a passage common to many
documents, in as many contexts) is dealt anew: its segments are the texts of
another round with k-grams nearly as long as the strings, in which what the
contexts add falls apart and what is common has equal segments. The last round's
k-grams are the strings themselves, so the work stays in proportion to the hot
segments, and no index gets more than ``BLOCK`` of them. Counts and hashes cover
all documents; the result is exact up to 128-bit hash collisions.

Runs of ``words`` words are found in the same way over the texts' words, each a
symbol of 64 bits, so short words and other white space between them don't hide
a repeat. Both kinds are found in the same texts and removed together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm.common import U64, arrow, binary_column, group_starts, mix64, portions, prefix_hash, ragged, span_hash, stored, text_buffer, unused, whole_groups, word_spans
from tessera.llm.run_index import SEPARATOR, repeated_starts

#: Distinct segments up to which a shard is indexed.
BLOCK = 1024
#: What a text is: bytes, words, or the words' hashes in the rounds after the first.
BYTES, WORDS, HASHES = range(3)


@dataclass(frozen=True)
class Settings:
    """``width`` bytes make a repeat; k-grams of ``gram`` bytes choose shards.
    ``words`` words make one too, however few bytes they take (0: they don't);
    k-grams of ``word_gram`` of them choose shards."""

    width: int = 400
    gram: int = 80
    words: int = 0
    word_gram: int = 12


def sliding_least(values: np.ndarray, m: int) -> np.ndarray:
    """Least of each m neighbouring values."""
    n = len(values) - m + 1
    if n <= 0:
        return values[:0]
    rows = -(-len(values) // m)
    grid = np.full(rows * m, ~U64(0), U64)
    grid[: len(values)] = values
    grid = grid.reshape(rows, m)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[m - 1 : m - 1 + n])


def segments(symbols: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Owner, start and length of each segment, its shard, its content's hash,
    and whether its least k-gram occurs in it more than once: only then can it
    repeat a string of its own."""
    prefix = prefix_hash(symbols)
    n = len(symbols)
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none, none.astype(U64), none.astype(U64), none.astype(bool)
    at = np.arange(n - gram + 1)
    m = width - gram + 1
    grams = span_hash(prefix, at, at + gram)
    least = sliding_least(grams, m)
    sizes = np.diff(offsets)
    count = np.maximum(sizes - width + 1, 0)
    window = ragged(offsets[:-1], count)
    owner = np.repeat(np.arange(len(sizes)), count)
    shard = least[window]
    if not len(window):
        return none, none, none, none.astype(U64), none.astype(U64), none.astype(bool)
    first = group_starts(owner, shard)
    last = np.append(first[1:], len(window)) - 1
    start, end = window[first], window[last] + width
    edge = np.zeros(m - 1, U64)
    anchors = np.flatnonzero(grams == ~sliding_least(~np.concatenate([edge, least, edge]), m))
    low, high = np.searchsorted(anchors, start), np.searchsorted(anchors, end - gram, "right")
    own = grams[anchors[ragged(low, high - low)]] == np.repeat(shard[first], high - low)
    twice = np.bincount(np.repeat(np.arange(len(first)), high - low), own, len(first)) > 1
    content = mix64(span_hash(prefix, start, end) ^ (end - start).astype(U64))
    return owner[first], start - offsets[owner[first]], end - start, shard[first], content, twice


def _symbols(data: np.ndarray, offsets: np.ndarray, form: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, or a hash of each of their words, and the texts' offsets."""
    if form == BYTES:
        return data, offsets
    if form == HASHES:
        return np.frombuffer(data.tobytes(), U64), offsets // 8
    starts, ends, per = word_spans(data, offsets)
    return mix64(span_hash(prefix_hash(data), starts, ends) ^ (ends - starts).astype(U64)), np.concatenate([[0], np.cumsum(per)])


def _scan(width: int, gram: int, form: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            row, tag = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "tag"))
            for i, j in portions(offsets):
                owner, start, length, shard, content, twice = segments(*_symbols(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], form), width, gram)
                columns = [shard.view(np.int64), content.view(np.int64), row[i + owner], tag[i + owner], start.astype(np.int32), length.astype(np.int32), twice]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shard", "content", "row", "tag", "start", "length", "twice"])

    return run


def _cut(form: int):
    """The segments' symbols, as bytes, out of their documents; of neighbouring
    rows of one text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            row, tag = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "tag"))
            first = group_starts(row, tag)
            if len(first):
                first, last = first[1:] if (row[0], tag[0]) == last else first, (row[-1], tag[-1])
            batch = batch.take(pa.array(first))
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                symbols, offsets = _symbols(*text_buffer(part.column("text")), form)
                wanted = part.column("wanted")
                per = wanted.value_lengths().to_numpy(zero_copy_only=False)
                flat = wanted.flatten()
                start, length, shard, content = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                taken = symbols[ragged(np.repeat(offsets[:-1], per) + start, length.astype(np.int64))]
                sizes = length.astype(np.int64) * symbols.itemsize
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(content), binary_column(taken.view(np.uint8), np.concatenate([[0], np.cumsum(sizes)]))], ["shard", "content", "bytes"])

    return run


def _index(width: int, form: int):
    """Repeated strings of each segment as (first, last + 1) pairs of starts.
    Strings of different shards differ, so shards may share an index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["shard"], weight="bytes"):
            table = table.take(pa.array(group_starts(*(table.column(c).combine_chunks().to_numpy() for c in ("shard", "content")))))
            data, all_offsets = text_buffer(table.column("bytes"))
            if form != BYTES:
                data, all_offsets = np.frombuffer(data.tobytes(), U64), all_offsets // 8
            all_content, all_shard = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("content", "shard"))
            for i, j in apart(all_shard, all_offsets, 1 << (19 if form == BYTES else 17)):
                content, shard, offsets = all_content[i:j], all_shard[i:j], all_offsets[i : j + 1] - all_offsets[i]
                symbols, separator = data[all_offsets[i] : all_offsets[j]], SEPARATOR
                if form != BYTES:
                    symbols, separator = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1, 0
                found = repeated_starts(symbols, offsets, width, separator)
                edge = np.diff(np.concatenate([[0], found.astype(np.int8), [0]]))
                first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                owner = np.searchsorted(offsets, first, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(shard[owner]), pa.array(content[owner]), pa.array((first - offsets[owner]).astype(np.int32)), pa.array((last - offsets[owner]).astype(np.int32))], ["shard", "content", "low", "high"])

    return run


def apart(shard: np.ndarray, offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole shards to index together: up to ``limit`` symbols, or one shard."""
    starts = group_starts(shard)
    edges = np.append(starts, len(shard))
    for i, j in portions(offsets[edges], limit):
        yield int(edges[i]), int(edges[j])


def repeated_spans(texts: DataFrame, width: int, gram: int, form: int = BYTES, size: int | None = None) -> DataFrame:
    """row, tag, low, high: bytes (or words, by number) [low, high) of
    ``texts(row, tag, text)`` are in a repeat of ``width`` of them. Spans may
    overlap and repeat; (row, tag) stands for one text. ``size`` is at least the
    number of segments, where it is known."""
    seen = stored(texts.transform(arrow, _scan(width, gram, form), "shard long, content long, row long, tag long, start int, length int, twice boolean"), size)
    shared = seen.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("one"), F.max("content").alias("two"), F.max("twice").alias("self")).where("n > 1 or self")
    kept = stored(seen.drop("twice").join(shared.select("shard", F.expr("one <> two or self").alias("varied")), "shard"), size)
    distinct = kept.groupBy("shard", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "tag", "start", "length")).alias("at"), F.first("varied").alias("varied"))
    distinct = stored(distinct.select("shard", "content", "n", "varied", "at.*"), size)

    varied = distinct.where("varied")
    wanted = varied.groupBy("row", "tag").agg(F.collect_list(F.struct("start", "length", "shard", "content")).alias("wanted"))
    pieces = texts.join(wanted, ["row", "tag"]).select("row", "tag", "text", "wanted").transform(arrow, _cut(form), "shard long, content long, bytes binary")
    hot = varied.groupBy("shard").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK)
    many = (hot.agg(F.sum("m")).first()[0] or 0) if gram < width else 0
    again, hot = many > 0, hot.select("shard")
    pieces = stored(pieces, size) if again else pieces  # else the texts would be dealt out twice
    cool = pieces.join(hot, "shard", "left_anti") if again else pieces
    partial = cool.repartition("shard").sortWithinPartitions("shard", "content").transform(arrow, _index(width, form), "shard long, content long, low int, high int")
    whole = distinct.where("n > 1").select("shard", "content", F.lit(0).alias("low"), (F.col("length") - width + 1).alias("high"))
    strings = partial.union(whole)
    if again:
        longer = width - width // 24
        parts = stored(pieces.join(hot, "shard").select(F.col("shard").alias("row"), F.col("content").alias("tag"), F.col("bytes").alias("text")).dropDuplicates(["row", "tag"]), many)
        found = _runs(repeated_spans(parts, width, longer if gram < longer else width, BYTES if form == BYTES else HASHES, many * width))
        strings = strings.union(found.select("row", "tag", "low", F.col("high") - width + 1))
    return kept.join(strings.distinct(), ["shard", "content"]).select("row", "tag", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high") - 1 + width).alias("high"))


def _runs(spans: DataFrame) -> DataFrame:
    """Spans that cover the same, none touching another of its text: the last
    round has one for each string."""
    order = Window.partitionBy("row", "tag").orderBy("low")
    upto = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.distinct().withColumn("first", F.coalesce(F.col("low") > upto, F.lit(True)).cast("int"))
    runs = marked.withColumn("run", F.sum("first").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("row", "tag", "run").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def merged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted disjoint spans that cover the same bytes; touching spans are one."""
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.ones(len(low), bool)
    new[1:] = low[1:] > high[:-1]
    first = np.flatnonzero(new)
    return low[first], high[np.append(first[1:], len(low)) - 1]


def _in_bytes(text: np.ndarray, kind: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted disjoint spans of bytes that cover spans of bytes (kind 0) and of
    words (kind 1)."""
    words = kind == 1
    if words.any():
        starts, ends, _ = word_spans(text, np.array([0, len(text)]))
        low, high = low.copy(), high.copy()
        low[words], high[words] = starts[low[words]], ends[high[words] - 1]
    return merged(low.astype(np.int64), high.astype(np.int64)) if len(low) else (np.zeros(0, np.int64),) * 2


def _finish(make, names: list[str], types: list[pa.DataType]):
    """What ``make`` makes of each text and its spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            spans = batch.column("spans")
            ends = np.concatenate([[0], np.cumsum(spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            kind, low, high = (spans.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(3))
            at = zip(offsets, offsets[1:], ends, ends[1:])
            out = [make(text, *_in_bytes(text, kind[x:y], low[x:y], high[x:y])) for text, x, y in ((data[a:b], x, y) for a, b, x, y in at)]
            yield pa.RecordBatch.from_arrays([batch.column("rest"), *(pa.array([x[k] for x in out], t) for k, t in enumerate(types))], ["rest", *names])

    return run


def _digest(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple:
    edges = np.concatenate([[0], np.stack([low, high], 1).ravel(), [len(data)]]).astype(np.int64)
    left = b"".join(data[a:b].tobytes() for a, b in edges.reshape(-1, 2).tolist())
    return len(data), int((high - low).sum()), len(low), hashlib.sha256(left).hexdigest(), _whole_characters(data, low, high)[0]


def _whole_characters(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple:
    """The text without the spans; a character that is covered in part stays."""
    if not len(low):
        return data.tobytes().decode("utf-8", "replace"), 0
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, low, 1)
    np.add.at(edge, high, -1)
    drop = np.cumsum(edge[:-1]) > 0
    inside = (data & 0xC0) == 0x80
    if inside.any():
        char = np.maximum(np.cumsum(~inside) - 1, 0)
        drop &= (np.bincount(char[drop], minlength=char[-1] + 1) == np.bincount(char))[char]
    return data[~drop].tobytes().decode("utf-8", "replace"), int(drop.sum())


def _over(docs: DataFrame, text_col: str, id_col: str, settings: Settings, make, fields: str) -> DataFrame:
    """``rest`` (the other columns, in a struct) and ``fields`` for each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.lit(0).alias(unused("none", docs.columns)))
    rest = F.struct(others.alias("others"), F.col(text_col).isNull().alias("null"))
    # rows without an id are told apart by their texts, so they don't meet in one task
    row = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text))
    rows = docs.select(row.alias("row"), F.hash(text).cast("long").alias("tag"), text.alias("text"), rest.alias("rest"))
    texts = rows.select("row", "tag", "text")
    spans = repeated_spans(texts, settings.width, settings.gram).withColumn("kind", F.lit(0))
    if settings.words:
        spans = spans.union(repeated_spans(texts, settings.words, settings.word_gram, WORDS).withColumn("kind", F.lit(1)))
    kind_of = rows.schema["rest"].dataType
    found = spans.groupBy("row", "tag").agg(F.collect_list(F.struct("kind", "low", "high")).alias("spans"))
    names, types = zip(*(f.strip().split() for f in fields.split(",")))
    kinds = [{"long": pa.int64(), "string": pa.string()}[t] for t in types]
    joined = rows.join(found, ["row", "tag"], "left").select("text", "rest", "spans")
    return joined.transform(arrow, _finish(make, list(names), kinds), f"rest {kind_of.simpleString()}, {fields}")


def repeat_report(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of ``docs``,
    and the text that is left, in which a character cut in part stays whole.

    A null text counts as empty. Rows with the same id and text, or without an
    id, get a result each. Other columns are ignored, whatever their names.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _over(docs, "text", "doc_id", settings, _digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string").select("rest.others.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text")


def remove_repeats(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeats of each text removed, columns unchanged.

    All occurrences go. A character of which only some bytes are covered stays
    whole. A null text stays null.
    """
    out = _over(docs, text_col, id_col, settings, _whole_characters, "kept_text string, n_removed long")
    text = F.when(~F.col("rest.null"), F.col("kept_text"))
    return out.select(*[text.alias(c) if c == text_col else F.col(f"rest.others.`{c}`").alias(c) for c in docs.columns])
