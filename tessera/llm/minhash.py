"""Near-duplicate documents by a multi-index Hamming join of MinHash signatures.

A document's word shingles are reduced to a signature of ``symbols`` MinHash
values of 16 bits each. Two signatures whose Hamming distance (symbols that
differ) is at most ``radius`` must, by the pigeonhole principle, agree in one
of the signature's chunks up to one symbol: with m chunks and one error
allowed in each, distances up to 2m - 1 are covered. The allowed error is
enumerated by leaving out each symbol of a chunk in turn, so candidates meet in
an equality join on the remaining symbols. No pair within the radius is missed;
a pair at a similarity of 0.8 exceeds it with a probability of 3e-6, one at
0.85 of 1e-8.

Candidates are confirmed on the full shingle sets. Documents with equal sets
are one class and only its representative is compared. In a bucket all members
are first compared with one hub, then with neighbours in a seeded order; pairs
whose ends are by then in the same component cannot change the result and are
skipped, and all other pairs of the bucket are compared in blocks of bounded
size. The result is therefore the
exact components of the links found, without all pairs of a group being made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import LOWER, U64, arrow, binary_column, group_starts, mix64, pairs_within, portions, prefix_hash, ragged, span_hash, stored, text_buffer, whole_groups, word_spans
from tessera.llm.components import components, least_ids

CHUNKS = 12
WIDTH = 4
SYMBOLS = CHUNKS * WIDTH
#: 8-bit symbols of the long signatures that judge the pairs left at the end.
LONG = 1024
BLOCK = 512
#: Side of the rows of a cell in which every two are compared.
WHOLE = -1


@dataclass(frozen=True)
class Settings:
    """``words`` per shingle; links have ``percent`` * union <= 100 * intersection."""

    words: int = 5
    percent: int = 80
    radius: int = 2 * CHUNKS - 1


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix64(np.arange(1, 2 * n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    return seeds[:n], seeds[n:] | U64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and the sets' sizes.

    Letters A-Z are lower-cased. A text with fewer words is one shingle of all
    of them; a text without words has an empty set.
    """
    data = LOWER[data]
    starts, ends, per = word_spans(data, offsets)
    word = span_hash(prefix_hash(data), starts, ends)
    chain = prefix_hash(word)
    first = np.concatenate([[0], np.cumsum(per)])[:-1]
    count = np.where(per >= words, per - words + 1, np.minimum(per, 1))
    at = ragged(first, count)
    length = np.repeat(np.minimum(per, words), count)
    shingle = mix64(span_hash(chain, at, at + length) + length.astype(U64))
    owner = np.repeat(np.arange(len(per)), count)
    order = np.lexsort((shingle, owner))
    shingle, owner = shingle[order], owner[order]
    keep = np.ones(len(shingle), bool)
    keep[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    return shingle[keep], np.bincount(owner[keep], minlength=len(per))


def signatures(sets: np.ndarray, sizes: np.ndarray, n: int = SYMBOLS, kind: type = np.uint16) -> np.ndarray:
    """``n`` MinHash symbols, a row for each set that isn't empty."""
    starts = np.concatenate([[0], np.cumsum(sizes[sizes > 0])])[:-1]
    out = np.empty((len(starts), n), kind)
    if len(starts):
        flips, factors = _permutations(n)
        for k in range(n):
            low = np.minimum.reduceat((sets ^ flips[k]) * factors[k], starts)
            out[:, k] = (mix64(low) >> U64(48)).astype(kind)
    return out


def long_radius(percent: int) -> int:
    """Symbols of a long signature that may differ: what is expected at the
    threshold and 5.2 standard deviations, which one pair in ten million exceeds."""
    q = 1 - percent / 100
    return math.ceil(LONG * q + 5.2 * math.sqrt(LONG * q * (1 - q)))


def set_keys(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each set; 0 for an empty one."""
    full = sizes > 0
    starts = np.concatenate([[0], np.cumsum(sizes[full])])[:-1]
    keys = np.zeros((2, len(sizes)), np.int64)
    if len(starts):
        keys[0, full] = np.add.reduceat(mix64(sets), starts).view(np.int64)
        keys[1, full] = np.add.reduceat(mix64(sets ^ U64(0x5851F42D4C957F2D)), starts).view(np.int64)
    return keys


def _keys_of(column: pa.Array, words: int) -> np.ndarray:
    """``set_keys`` of a column of texts."""
    data, offsets = text_buffer(column)
    keys = [set_keys(*shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)) for i, j in portions(offsets)]
    return np.concatenate(keys, axis=1) if keys else np.zeros((2, 0), np.int64)


def _of_class(words: int):
    """Texts that are their class's: an id may be repeated with other texts. Of
    neighbouring rows of a class one is enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keys = _keys_of(batch.column("text"), words)
            rep = batch.column("rep").to_numpy(zero_copy_only=False)
            at = np.flatnonzero((keys[0] == batch.column("k1").to_numpy(zero_copy_only=False)) & (keys[1] == batch.column("k2").to_numpy(zero_copy_only=False)))
            at = np.sort(at[np.unique(rep[at], return_index=True)[1]])
            at = at[1:] if len(at) and rep[at[0]] == last else at
            last = rep[at[-1]] if len(at) else last
            yield batch.select(["rep", "text"]).take(pa.array(at))

    return run


def _row_keys(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _keys_of(batch.column("text"), words)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys[0]), pa.array(keys[1])], ["doc_id", "text", "rest", "k1", "k2"])

    return run


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for i, j in portions(offsets):
                sets, sizes = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                full = sizes > 0
                keys = set_keys(sets, sizes)
                made = signatures(sets, sizes)
                at = np.concatenate([[0], np.cumsum(full * (2 * SYMBOLS))])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(sizes.astype(np.int64)), pa.array(keys[0]), pa.array(keys[1]), binary_column(made.view(np.uint8).ravel(), at)], ["doc_id", "n_shingles", "k1", "k2", "sig"])

    return run


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """Keys of each signature: every chunk with each of its symbols left out."""
    wide = sig.astype(U64)
    out = np.empty((len(sig), SYMBOLS), U64)
    for c in range(CHUNKS):
        for gap in range(WIDTH):
            key = np.zeros(len(sig), U64)
            for k in range(c * WIDTH, (c + 1) * WIDTH):
                if k != c * WIDTH + gap:
                    key = (key << U64(16)) | wide[:, k]
            out[:, c * WIDTH + gap] = mix64(mix64(key) + U64(c * WIDTH + gap))
    return out.view(np.int64)


def first_key(differ: np.ndarray) -> np.ndarray:
    """Index of the first key that two signatures share, from the symbols that differ."""
    chunks = differ.reshape(-1, CHUNKS, WIDTH)
    errors = chunks.sum(2)
    chunk = (errors <= 1).argmax(1)
    row = np.arange(len(differ))
    return chunk * WIDTH + np.where(errors[row, chunk] == 1, chunks[row, chunk].argmax(1), 0)


def _sig_matrix(column: pa.Array) -> np.ndarray:
    data, _ = text_buffer(column)
    return np.frombuffer(data.tobytes(), np.uint16).reshape(-1, SYMBOLS)


def _emit_shingles(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            rep = batch.column("rep").to_numpy(zero_copy_only=False)
            for i, j in portions(offsets):
                sets, sizes = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                yield pa.RecordBatch.from_arrays([pa.array(sets.view(np.int64)), pa.array(np.repeat(rep[i:j], sizes))], ["key", "rep"])

    return run


def _long(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for i, j in portions(offsets):
                made = signatures(*shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words), LONG, np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column("rep").slice(i, j - i), binary_column(made.ravel(), np.arange(j - i + 1) * LONG)], ["rep", "long"])

    return run


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = chunk_keys(_sig_matrix(batch.column("sig")))
        rep = np.repeat(batch.column("rep").to_numpy(zero_copy_only=False), SYMBOLS)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(rep)], ["key", "rep"])


def _hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (key, rep): rows of keys with several members, with
    the key's first member as hub. Streams; keeps one row between batches."""
    key = hub = None
    alone = False
    for batch in batches:
        k, r = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "rep"))
        if not len(k):
            continue
        starts = group_starts(k)
        sizes = np.diff(np.append(starts, len(k)))
        hubs = r[starts].copy()
        going_on = key is not None and k[0] == key
        if going_on:
            hubs[0] = hub
        several = sizes > 1
        several[0] |= going_on
        rows = np.repeat(several, sizes)
        out_k, out_r, out_h = k[rows], r[rows], np.repeat(hubs, sizes)[rows]
        if going_on and alone:
            out_k, out_r, out_h = (np.append(x, y) for x, y in ((out_k, key), (out_r, hub), (out_h, hub)))
        alone = sizes[-1] == 1 and not (going_on and len(starts) == 1)
        key, hub = k[-1], hubs[-1]
        yield pa.RecordBatch.from_arrays([pa.array(out_k), pa.array(out_r), pa.array(out_h)], ["key", "rep", "hub"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of neighbouring rows of a key that are in different components."""
    last = None
    for batch in batches:
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "rep", "comp")]
        if not len(rows[0]):
            continue
        key, rep, comp = (np.append(x, y) for x, y in zip(last, rows)) if last else rows
        pair = np.flatnonzero((key[1:] == key[:-1]) & (comp[1:] != comp[:-1]))
        a, b = rep[pair], rep[pair + 1]
        last = [x[-1:] for x in (key, rep, comp)]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _near(percent: int, radius: int):
    """Pairs of a cell that may be links: the shingles that each shares with any
    document and the signatures allow it, the components so far differ, and this
    is the first key that the two have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key", "cell"], least=1 << 14):
            table = table.combine_chunks()
            key, cell, rep, comp, n, held, side = (table.column(c).to_numpy(zero_copy_only=False) for c in ("key", "cell", "rep", "comp", "n", "held", "side"))
            sig = _sig_matrix(table.column("sig"))
            wide = np.frombuffer(text_buffer(table.column("long"))[0].tobytes(), np.uint8).reshape(-1, LONG)
            index = (chunk_keys(sig) == key[:, None]).argmax(1)
            whole = side == WHOLE
            for i, j in pairs_within(group_starts(key, cell), len(key), 1 << 18):
                most = np.minimum(held[i], held[j])
                ok = (comp[i] != comp[j]) & (100 * most >= percent * (n[i] + n[j] - most)) & (whole[i] | (side[i] != side[j]))
                i, j = i[ok], j[ok]
                differ = sig[i] != sig[j]
                ok = differ.sum(1) <= radius
                i, j = i[ok], j[ok]
                ok = first_key(differ[ok]) == index[i]
                i, j = i[ok], j[ok]
                ok = [(wide[i[k : k + 4096]] != wide[j[k : k + 4096]]).sum(1) <= long_radius(percent) for k in range(0, len(i), 4096)]
                ok = np.concatenate(ok) if ok else np.zeros(0, bool)
                a, b = rep[i[ok]], rep[j[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _confirm(words: int, percent: int):
    """From rows sorted by (a, salt, kind): the hub's text, then its partners'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub = None, np.zeros(0, U64)
        for batch in batches:
            a, salt, kind, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "salt", "kind", "b"))
            data, offsets = text_buffer(batch.column("text"))
            found = []
            for i, j in portions(offsets):
                sets, sizes = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                edge = np.concatenate([[0], np.cumsum(sizes)])
                for x in range(i, j):
                    own = sets[edge[x - i] : edge[x - i + 1]]
                    if kind[x] == 0:
                        at, hub = (a[x], salt[x]), own
                    elif at == (a[x], salt[x]):
                        place = np.searchsorted(hub, own)
                        place[place == len(hub)] = 0
                        common = int((hub[place] == own).sum()) if len(hub) else 0
                        if common and 100 * common >= percent * (len(hub) + len(own) - common):
                            found.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(a[found]), pa.array(b[found])], ["u", "v"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough.

    A hub with many partners is split into parts of about 256 by a salt.
    """
    hubs = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m")).withColumn("parts", F.ceil(F.col("m") / 256).cast("int"))
    hubs = hubs.select("a", "parts")
    partners = pairs.join(hubs, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"), "b")
    own = hubs.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("a").alias("b"))
    both = own.union(partners.select("a", "salt", F.lit(1).alias("kind"), "b"))
    rows = both.join(texts, both.b == texts.rep).drop("rep").repartition("a", "salt").sortWithinPartitions("a", "salt", "kind", "b")
    return rows.transform(arrow, _confirm(words, percent), "u long, v long")


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept, a row for each row of ``docs``.

    component_id is the smallest id reachable over links, the row's own
    included; kept says that it is the row's own. Null and wordless texts have
    no shingles and no links. A row without an id is returned without a
    component and not kept. Rows with the same id and text share a component;
    rows with the same id and other texts are linked each by its own text.
    Other columns of ``docs`` are ignored, whatever their names.
    """
    sketch, found = _resolved(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), settings)
    own = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), own)
    return sketch.join(found, ["k1", "k2"], "left").select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def _numbered(classes: DataFrame) -> DataFrame:
    """``classes`` with ``rep``, a number of each one's own: its id, or a hash of
    its set where rows that repeat an id are in several."""
    several = stored(classes.groupBy("id").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    if several.isEmpty():
        return classes.withColumn("rep", F.col("id"))
    seed = 0
    while True:
        number = F.when(F.col("m").isNull(), F.col("id")).otherwise(F.xxhash64(F.lit(seed), "k1", "k2"))
        out = stored(classes.join(several, "id", "left").withColumn("rep", number).drop("m"))
        if out.groupBy("rep").agg(F.count(F.lit(1)).alias("m")).where("m > 1").isEmpty():
            return out
        seed += 1


def _resolved(docs: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_shingles, k1 and k2 of each row of ``docs(doc_id, text)``; and
    root and component (the smallest id) of each class k1, k2."""
    sketch = stored(docs.transform(arrow, _sketch(settings.words), "doc_id long, n_shingles long, k1 long, k2 long, sig binary"))
    linkable = sketch.where("n_shingles > 0 and doc_id is not null")
    classes = linkable.groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    classes = _numbered(stored(classes))

    keyed = classes.transform(arrow, _emit_keys, "key long, rep long").repartition("key").sortWithinPartitions("key", "rep")
    members = stored(keyed.transform(arrow, _hubs, "key long, rep long, hub long"))
    wanted = members.select("rep").distinct().join(classes.select("rep", "id", "k1", "k2"), "rep")
    texts = stored(docs.join(wanted, F.col("doc_id") == F.col("id")).select("rep", "text", "k1", "k2").transform(arrow, _of_class(settings.words), "rep long, text string"))
    p, r = settings.percent, settings.radius
    side = lambda name: classes.select(F.col("rep").alias(name), F.col("n").alias(f"n_{name}"), F.col("sig").alias(f"s_{name}"))

    def close(pairs: DataFrame) -> DataFrame:
        both = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(n_a, n_b) >= {p} * greatest(n_a, n_b)")
        return both.transform(arrow, _close(r), "a long, b long")

    def together(links: DataFrame, joined: DataFrame) -> DataFrame:
        return components(links.union(joined.select(F.col("node").alias("u"), F.col("component").alias("v"))))

    def place(joined: DataFrame) -> DataFrame:
        return members.join(joined, members.rep == joined.node, "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))

    tried = stored(close(members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()))
    joined = components(confirmed(tried, texts, settings.words, p))

    # a quarter of the keys is enough to bring together what one hub could not
    placed = place(joined).where(f"pmod(key, {WIDTH}) = 0")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("m")).where("low <> high and m > 2").select("key")
    rows = placed.join(mixed, "key").withColumn("turn", F.xxhash64("key", "rep")).repartition("key").sortWithinPartitions("key", "turn")
    second = stored(close(rows.transform(arrow, _neighbours, "a long, b long").distinct().join(tried, ["a", "b"], "left_anti")))
    if not second.isEmpty():
        joined = together(confirmed(second, texts, settings.words, p), joined)
        tried = tried.union(second)

    placed = place(joined)
    # of a key, the members of its first component are only compared with the others
    sizes = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"))
    open_ = sizes.groupBy("key").agg(F.min(F.struct("comp", "m")).alias("first"), F.max("comp").alias("high"), F.sum("m").alias("m")).where("first.comp <> high and m > 2")
    open_ = open_.select("key", F.col("first.comp").alias("main"), F.expr(f"cast(ceil(first.m / {BLOCK}) as int) as mains"), F.expr(f"cast(ceil((m - first.m) / {BLOCK}) as int) as others"))
    rest = placed.join(open_, "key").withColumn("own", F.expr("pmod(xxhash64(rep), if(comp = main, mains, others))"))
    against = "transform(sequence(0, if(comp = main, others, mains) - 1), x -> struct(if(comp = main, x, own) * 1000000 + if(comp = main, own, x) as cell, if(comp = main, 0L, 1L) as side))"
    among = f"transform(sequence(0, others - 1), x -> struct(-1 - (least(x, own) * 1000000 + greatest(x, own)) as cell, if(x = own, {WHOLE}L, own) as side))"
    rest = rest.withColumn("at", F.explode(F.expr(f"if(comp = main, {against}, concat({against}, {among}))")))
    near = stored(texts.join(placed.join(open_, "key").select("rep").distinct(), "rep"))
    shingles = near.transform(arrow, _emit_shingles(settings.words), "key long, rep long")
    held = shingles.repartition("key").sortWithinPartitions("key").transform(arrow, _hubs, "key long, rep long, hub long").groupBy("rep").agg(F.count(F.lit(1)).alias("held"))
    rest = rest.select("key", "at.cell", "at.side", "rep", "comp").join(classes.join(held, "rep").where(f"100 * held >= {p} * n").join(near.transform(arrow, _long(settings.words), "rep long, long binary"), "rep").select("rep", "n", "sig", "held", "long"), "rep")
    more = rest.repartition("key", "cell").sortWithinPartitions("key", "cell").transform(arrow, _near(p, r), "a long, b long")
    more = stored(more.join(tried, ["a", "b"], "left_anti"))
    found = joined if more.isEmpty() else together(confirmed(more, texts, settings.words, p), joined)

    found = least_ids(found, classes.select(F.col("rep").alias("node"), "id"))
    named = classes.select("k1", "k2", "rep", "id").join(found, F.col("rep") == F.col("node"), "left")
    return sketch.drop("sig"), named.select("k1", "k2", F.coalesce("root", "rep").alias("root"), F.coalesce("least", "id").alias("component"))


def _close(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (_sig_matrix(batch.column("s_a")) != _sig_matrix(batch.column("s_b"))).sum(1) <= radius
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return run


def keep_representatives(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of near duplicates, columns
    unchanged, whatever their names: that with the smallest id, and of rows with
    that id the first by text.

    Rows without an id or without words have no duplicates and stay, and so do
    rows that share nothing but an id.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rest"))
    sketch, found = _resolved(rows.select("doc_id", "text"), settings)
    judged = sketch.where("doc_id is not null").join(found, ["k1", "k2"], "left").groupBy("doc_id")
    judged = judged.agg(F.count(F.lit(1)).alias("rows"), F.max(F.expr("n_shingles > 0 and component <> doc_id")).alias("gone")).where("gone or rows > 1")
    judged = stored(judged.select("doc_id", "rows"))
    back = [F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
    alone = rows.join(judged, "doc_id", "left_anti").select(*back)
    several = judged.where("rows > 1").select("doc_id")
    if several.isEmpty():
        return alone
    kind = rows.schema["rest"].dataType.simpleString()
    keyed = rows.join(several, "doc_id").transform(arrow, _row_keys(settings.words), f"doc_id long, text string, rest {kind}, k1 long, k2 long")
    keyed = stored(keyed).join(found, ["k1", "k2"], "left")
    first = keyed.where("component = doc_id").groupBy("root").agg(F.min_by("rest", F.struct("text", F.xxhash64(F.to_json("rest")))).alias("rest"))
    return alone.union(keyed.where("component is null").select(*back)).union(first.select(*back))
