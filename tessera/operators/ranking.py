"""Windows over ranked rows, context packing, set algebra, similarity reranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions import text as T
from tessera.operators import skyline
from tessera.operators.retrieval import DIGITS
from tessera.session import stored


def best_per(df: DataFrame, by: list[str], order: list[Column], n: int = 1, name: str = "place") -> DataFrame:
    """The first ``n`` rows of each group in a total order, with their place."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)


def min_max(score: Column, by: list[str]) -> Column:
    """Scores of a list scaled to 0..1; a constant list gives 0.5."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high > low, (score - low) / (high - low)).otherwise(0.5)


def margins(ranked: DataFrame, by: str = "qid") -> DataFrame:
    """Difference of the first two scores of each list; the first score if alone."""
    first = F.max(F.when(F.col("rank") == 1, F.col("score")))
    second = F.max(F.when(F.col("rank") == 2, F.col("score")))
    return ranked.where("rank <= 2").groupBy(by).agg(F.round(first - F.coalesce(second, F.lit(0.0)), DIGITS).alias("margin"))


def page_scores(chunks: DataFrame) -> DataFrame:
    """qid, page, score from chunk rows (qid, page, id, rerank, retrieval): best
    rerank + 0.15 of its retrieval + 0.05 of the second + 0.01 for each of up to three."""
    rows = best_per(chunks, ["qid", "page"], [F.desc("rerank"), F.asc("id")], n=1 << 30)
    top = lambda c, r: F.max(F.when(F.col("place") == r, F.col(c)))
    score = top("rerank", 1) + 0.15 * top("retrieval", 1) + 0.05 * F.coalesce(top("rerank", 2), F.lit(0.0)) + 0.01 * F.least(F.count(F.lit(1)), F.lit(3))
    return rows.groupBy("qid", "page").agg(F.round(score, DIGITS).alias("score"))


def pack_context(rows: DataFrame, budget: int, least: int = 40, by: str = "key", order: str = "pos", tokens_col: str = "tokens") -> DataFrame:
    """Rows in order while their tokens fit the budget. The first that doesn't is
    cut to what remains if that is more than ``least`` tokens; then it stops."""
    w = Window.partitionBy(by).orderBy(order)
    n = F.size(tokens_col)
    rows = rows.withColumn("upto", F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("room", F.lit(budget) - (F.col("upto") - n))
    kept = F.when(F.col("upto") <= budget, n).when(F.col("room") > least, F.col("room")).otherwise(0)
    return rows.withColumn("kept", kept).where("room > 0 and kept > 0").drop("upto", "room")


def dominated(df: DataFrame, better: list[str], id_col: str, by: list[str] | None = None) -> DataFrame:
    """Rows that another row of the group equals or beats in all measures and
    beats in one. Left out of ``df`` they leave the Pareto frontier. Rows with a
    null measure neither beat nor are beaten.

    Measures are first reduced to their distinct combinations. With one or two,
    the best seen in order of the first tells; more go through ``skyline.frontier``.
    """
    keys = by or []
    points = df.where(" and ".join(f"`{m}` is not null" for m in better)).select(*keys, *better).distinct()
    if len(better) <= 2:
        # the best second measure for each value of the first, then a running maximum over better values
        x, y = better[0], better[-1]
        tops = points.groupBy(*keys, F.col(x).alias("x")).agg(F.max(y).alias("top"))
        above = Window.partitionBy(*keys).orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, -1)
        tops = tops.withColumn("above", F.max("top").over(above))
        beaten = points.withColumn("x", F.col(x)).join(tops, [*keys, "x"]).where(f"above >= `{y}` or top > `{y}`").select(*keys, *better)
    else:
        points = points.where(" and ".join(f"not isnan(cast(`{m}` as double))" for m in better))
        beaten = points.join(skyline.frontier(points, better, by), [*keys, *better], "left_anti")
    return df.join(beaten, [*keys, *better], "left_semi").select(id_col)


def dedupe_first(df: DataFrame, keys: list[Column], order: list[str], per: list[str], n: int) -> DataFrame:
    """First row of each key in the given order, then at most ``n`` of each ``per``."""
    named = df.withColumns({f"_k{i}": k for i, k in enumerate(keys)})
    once = best_per(named, [f"_k{i}" for i in range(len(keys))], [F.asc(o) for o in order])
    return best_per(once, per, [F.asc(o) for o in order], n).drop("place", *[f"_k{i}" for i in range(len(keys))])


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


#: Of the hashes by which ``similar_sets`` tells rare tokens from frequent ones.
BUCKETS = 1 << 20


def similar_sets(rows: DataFrame, percent: int, id_col: str = "id", tokens_col: str = "tokens", together: int = 4096) -> DataFrame:
    """a, b, common, jaccard of all pairs of token sets with at least ``percent``, ids
    unique.

    Prefix filter: tokens are in one order for all sets, those of rarer buckets of
    hashes first, and two sets that similar share a token among the first
    n - ceil(percent * n / 100) + 1 of each, so only prefixes meet in the join; sizes,
    and what can still be common after the places where the token stands, prune the
    rest, and then the bits of one set's sketch that the other's lacks. What is left is compared whole: sets with the same first neighbour go to one
    place, each once, about ``together`` of them in a group. Exact up to collisions of
    the 64-bit hashes that stand for tokens. The driver holds a count for each of the
    1,048,576 buckets. ``rows`` are read three times.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    spark = rows.sparkSession
    distinct = rows.select(F.col(id_col).alias("id"), F.array_distinct(tokens_col).alias("t")).where(F.size("t") > 0)
    sets = distinct.select("id", F.array_sort(F.transform("t", lambda x: F.xxhash64(x))).alias("t"))
    kind = sets.schema["id"].dataType.simpleString()
    counts = sets.select(F.explode("t").alias("term")).groupBy(F.col("term").bitwiseAND(BUCKETS - 1).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    weight = np.zeros(BUCKETS, np.int64)
    weight[counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    shared = spark.sparkContext.broadcast(weight)

    def first(batches):
        for batch in batches:
            lists = batch.column("t")
            n, term = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy()
            own = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((term, shared.value[term & (BUCKETS - 1)], own))
            at = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + 1
            held = at <= np.repeat(n - -(-n * percent // 100) + 1, n)
            own, at, term = own[held], at[held], term[order][held]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(own)), pa.array(n[own].astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(term)], ["id", "n", "at", "term"])

    prefix = sets.mapInArrow(first, f"id {kind}, n int, at int, term long")
    x, y = prefix.toDF("a", "na", "ia", "term"), prefix.toDF("b", "nb", "ib", "term")
    fits = f"a < b and 100L * least(na, nb) >= {percent} * greatest(na, nb) and (100L + {percent}) * (1 + least(na - ia, nb - ib)) >= {percent}L * (na + nb)"
    pairs = x.join(y, "term").where(fits).select("a", "b").distinct()

    def sketch(batches):
        """Bits of each set by its hashes, two to four for a token."""
        for batch in batches:
            term, bits = batch.column("t"), []
            for t in (term[i].values.to_numpy() for i in range(batch.num_rows)):
                held = np.zeros(max(64, 1 << (2 * len(t) - 1).bit_length()), np.uint8)
                held[(t >> 20) & (len(held) - 1)] = 1
                bits.append(np.packbits(held, bitorder="little").view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(term.value_lengths(), pa.int32()), pa.array(bits, pa.list_(pa.int64()))], ["id", "n", "s"])

    sketches = stored(sets.mapInArrow(sketch, f"id {kind}, n int, s array<long>"))
    known = pairs.join(sketches.toDF("a", "na", "sa"), "a").join(sketches.toDF("b", "nb", "sb"), "b")
    half = lambda c: f"if(size(sa) = size(sb) or size({c}) = least(size(sa), size(sb)), {c}, zip_with(slice({c}, 1, int(size({c}) / 2)), slice({c}, int(size({c}) / 2) + 1, int(size({c}) / 2)), (x, y) -> x | y))"
    known = known.withColumns({"fa": F.expr(half("sa")), "fb": F.expr(half("sb"))})
    # a bit of one alone is a token, or more, that the other hasn't
    alone = "aggregate(zip_with({0}, {1}, (x, y) -> bit_count(x & ~y)), 0, (x, y) -> x + y)"
    pairs = stored(known.where(f"size(fa) <> size(fb) or (100L + {percent}) * least(na - {alone.format('fa', 'fb')}, nb - {alone.format('fb', 'fa')}) >= {percent}L * (na + nb)").select("a", "b"))
    hubs = stored(pairs.groupBy("b").agg(F.min("a").alias("hub")))
    near = pairs.join(hubs.toDF("a", "ha"), "a", "left").join(hubs.toDF("b", "hb"), "b").withColumn("hub", F.when(F.coalesce("ha", "a") == F.col("hb"), F.col("hb")).otherwise(F.col("a")))
    # a hub of many neighbours is several groups, by blocks of both sides
    many = near.groupBy("hub").agg(F.ceil(F.approx_count_distinct("b") / together).alias("m"))
    parts = max(1, -(-hubs.count() // together))
    block = lambda c: F.pmod(F.xxhash64(c), F.col("m"))
    near = stored(near.join(many, "hub").select(F.pmod(F.xxhash64("hub", block("a"), block("b")), F.lit(parts)).alias("key"), "a", "b"))
    members = near.select(F.col("key").alias("place"), F.explode(F.array("a", "b")).alias("id")).distinct().join(sets, "id")

    def compare(near: pa.Table, members: pa.Table) -> pa.Table:
        ids, lists = members.column("id").combine_chunks(), members.column("t").combine_chunks()
        term, at = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        common, union = np.zeros(len(near), np.int64), np.zeros(len(near), np.int64)
        for k, (i, j) in enumerate(zip(*(pc.index_in(near.column(c).combine_chunks(), value_set=ids).to_numpy() for c in "ab"))):
            p, q = term[at[i] : at[i + 1]], term[at[j] : at[j + 1]]
            common[k] = np.count_nonzero(q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p)
            union[k] = len(p) + len(q) - common[k]
        held = pa.array(100 * common >= percent * union)
        return pa.table({"a": near.column("a"), "b": near.column("b"), "common": pa.array(common), "union": pa.array(union)}).filter(held)

    both = near.repartition(parts, "key").groupBy("key").cogroup(members.repartition(parts, "place").groupBy("place")).applyInArrow(compare, f"a {kind}, b {kind}, common long, union long")
    return both.select("a", "b", F.col("common").cast("int").alias("common"), F.round(F.col("common") / F.col("union"), DIGITS).alias("jaccard"))


def bigrams(tokens: Column) -> Column:
    return F.when(F.size(tokens) > 1, F.transform(F.sequence(F.lit(1), F.size(tokens) - 1), lambda i: F.concat_ws(" ", F.element_at(tokens, i), F.element_at(tokens, i + 1)))).otherwise(F.array().cast("array<string>"))


def ordered_overlap(query: Column, words: Column) -> Column:
    """Query tokens found in order, each after the one before, as a share."""
    start = F.struct(F.lit(0).alias("at"), query.alias("q"))
    found = F.aggregate(words, start, lambda s, w: F.struct(F.when(F.try_element_at(s["q"], s["at"] + 1) == w, s["at"] + 1).otherwise(s["at"]).alias("at"), s["q"].alias("q")), lambda s: s["at"])
    return F.when(F.size(query) > 0, found / F.size(query)).otherwise(0.0)


def share_of(query: Column, words: Column) -> Column:
    """Share of the distinct query items that are among the words."""
    q = F.array_distinct(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, words)) / F.size(q)).otherwise(0.0)


def with_heuristic_score(rows: DataFrame, query: str, text: str, references: Column, same_family: Column, same_page: Column, name: str = "rerank") -> DataFrame:
    """``rows`` with a deterministic rerank score from unigrams, bigrams, order,
    phrase, references, family and page.

    Tokens are computed once for each row, in an array that is exploded away
    again, so no expression repeats them.
    """
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    parts = F.struct(T.tokens(F.col(query)).alias("q"), T.tokens(F.col(text)).alias("t"))
    rows = rows.withColumn("_p", F.explode(F.array(parts)))
    q, t = F.col("_p.q"), F.col("_p.t")
    phrase = flag(F.instr(F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join(q, " "), F.lit(" "))) > 0)
    refs = F.when(F.size(references) > 0, F.size(F.filter(references, lambda r: F.contains(F.lower(text), F.lower(r)))) / F.size(references)).otherwise(0.0)
    weighted = ((0.28, share_of(q, t)), (0.18, share_of(bigrams(q), bigrams(t))), (0.16, ordered_overlap(q, t)), (0.18, phrase), (0.12, refs), (0.08, flag(same_family)), (0.05, flag(same_page)))
    return rows.withColumn(name, F.round(reduce(lambda a, b: a + b, [w * x for w, x in weighted]), DIGITS)).drop("_p")
