"""Sparse, dense and hybrid retrieval, filters, reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.functions import text as T
from tessera.operators import graph, grounding, index, metrics, mldata, ranking, retrieval as R
from tessera.queries.registry import Tables, query
from tessera.session import scratch_path, stored

TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"

#: Scores of all documents that share a term with a benchmark passage.
BM25 = rf"""
words as (select doc_id as id, unnest({TOKENS}) as term from documents),
lengths as (select doc_id as id, len({TOKENS}) as dl from documents),
size as (select count(*) as n, avg(dl) as avgdl from lengths),
asked as (select item_id as qid, unnest(list_distinct({TOKENS})) as term from benchmark),
tf as (select id, term, count(*) as tf from words where term in (select term from asked) group by all),
df as (select term, count(*) as df from tf group by all),
scores as (select qid, tf.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score
 from asked join tf using (term) join df using (term) join lengths on lengths.id = tf.id cross join size group by all),
sparse as (select *, row_number() over (partition by qid order by score desc, id) as rank from scores)
"""


def corpus(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("id"), "text", "source", "lang")


def passages(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def all_hits(t: Tables) -> DataFrame:
    """Every document that shares a term with a passage, scored once for all who rank them."""
    return stored(R.bm25(corpus(t), passages(t)))


def sparse_hits(t: Tables, k: int = 10, hits: DataFrame | None = None) -> DataFrame:
    return R.bm25_top_k(corpus(t), passages(t), k) if hits is None else R.top_k(hits, k)


def asked_vectors(t: Tables) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20."""
    return t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"), "label")


@query("SPR-1 SPR-3 WN-1 WN-3 HYB-1", f"with {BM25} select qid, id, score, rank from sparse where rank <= 10")
def bm25_topk(t: Tables) -> DataFrame:
    return sparse_hits(t).select("qid", "id", "score", "rank")


@query("SRC-25 SPR-1 SPR-3", f"with {BM25} select qid, id, score, rank from sparse where rank <= 10")
def indexed_topk(t: Tables) -> DataFrame:
    """Saved, loaded and searched: the corpus is read once, to build the index."""
    path = scratch_path(t.spark, "index")
    index.save(corpus(t), path, cluster="lang")
    return index.search(index.load(t.spark, path), passages(t), 10).select("qid", "id", "score", "rank")


@query("SRC-25", rf"with w as (select doc_id, unnest({TOKENS}) as term from documents) select term, count(distinct doc_id) as df, count(*) as cf from w group by term")
def indexed_terms(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "index")
    index.save(corpus(t), path, size=256, shards=8)
    return index.term_statistics(index.load(t.spark, path))


@query("SPR-1", rf"with w as (select doc_id, unnest({TOKENS}) as term from documents) select term, count(distinct doc_id) as df, count(*) as cf from w group by term")
def bm25_term_stats(t: Tables) -> DataFrame:
    return R.term_statistics(R.postings(corpus(t)))


@query("FLT-1 SPR-3 FLT-3", f"with {BM25} select qid, id, score, rank from (select qid, id, score, row_number() over (partition by qid order by score desc, id) as rank from scores join documents on doc_id = id where lang in ('en', 'fr') and not source = 'src3') where rank <= 5")
def bm25_filtered_topk(t: Tables) -> DataFrame:
    allowed = F.col("lang").isin("en", "fr") & ~(F.col("source") == "src3")
    return R.bm25_top_k(corpus(t), passages(t), 5, among=allowed).select("qid", "id", "score", "rank")


@query("SPR-2", rf"""
with words as (select doc_id as id, unnest({TOKENS}) as term from documents), lengths as (select doc_id as id, len({TOKENS}) as dl from documents), size as (select avg(dl) as avgdl from lengths),
tf as (select id, term, count(*) as tf from words group by all)
select tf.id, count(*) as n_terms, round(sum(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 4) as total from tf join lengths on lengths.id = tf.id cross join size group by tf.id
""")
def sparse_vectors(t: Tables) -> DataFrame:
    values = F.map_values("vector")
    return R.sparse_vectors(corpus(t)).select("id", F.size("vector").cast("long").alias("n_terms"), F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("SPR-4", f"""
with {BM25}, first as (select item_id as qid, {TOKENS}[1] as term from benchmark), more as (select qid, tf.id, 2 * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) as extra from first join tf using (term) join df using (term) join lengths on lengths.id = tf.id cross join size),
total as (select qid, id, round(sum(s), 5) as score from (select qid, tf.id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) as s from asked join tf using (term) join df using (term) join lengths on lengths.id = tf.id cross join size union all select qid, id, extra from more) group by all)
select qid, id, score, rank from (select *, row_number() over (partition by qid order by score desc, id) as rank from total) where rank <= 5
""")
def boosted_query_topk(t: Tables) -> DataFrame:
    asked = passages(t).withColumn("terms", R.boosted_terms(F.col("query"), F.array(T.tokens(F.col("query"))[0])))
    hits = R.bm25(corpus(t), asked, weight_col="terms").withColumn("score", F.round("score", 5))
    return R.top_k(hits, 5).select("qid", "id", "score", "rank")


@query("SPR-5", """
with q as (select c_custkey as qid, 'customer of ' || n_name || ' today' as query, n_name as n0, n_regionkey as k from customer join nation on c_nationkey = n_nationkey)
select qid, query, array_to_string(list_sort(list(n_name)), '|') as extras from q join nation on n_regionkey = k and n_name <> n0 group by qid, query
""")
def alias_expand(t: Tables) -> DataFrame:
    asked = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("qid"), F.concat(F.lit("customer of "), "n_name", F.lit(" today")).alias("query"))
    clusters = t.nation.select(F.col("n_regionkey").alias("cluster"), F.col("n_name").alias("alias"))
    return R.alias_expansion(asked, clusters).withColumn("extras", F.array_join("extras", "|"))


COSINE = "list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda z: z[1]::double * z[2]::double)) / (sqrt(list_sum(list_transform(q.embedding, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(d.embedding, lambda x: x::double * x::double))))"


@query("DEN-1 RR-1", f"""
with s as (select q.vec_id as qid, d.vec_id as id, round({COSINE}, 6) as score from embeddings q join embeddings d on q.vec_id % 20 = 0)
select qid, id, score, rank from (select *, row_number() over (partition by qid order by score desc, id) as rank from s) where rank <= 10
""")
def dense_topk(t: Tables) -> DataFrame:
    return R.dense_top_k(t.embeddings, asked_vectors(t), 10).select("qid", "id", "score", "rank")


@query("DEN-1 FLT-1", f"""
with s as (select q.vec_id as qid, d.vec_id as id, round({COSINE}, 6) as score from embeddings q join embeddings d on q.vec_id % 20 = 0 and q.label = d.label)
select qid, id, score, rank from (select *, row_number() over (partition by qid order by score desc, id) as rank from s) where rank <= 5
""")
def dense_topk_filtered(t: Tables) -> DataFrame:
    return R.dense_top_k(t.embeddings.select("vec_id", "embedding", "label"), asked_vectors(t), 5, condition="label").select("qid", "id", "score", "rank")


@query("DEN-3", rf"""
with w as (select doc_id as id, unnest({TOKENS}) as term from documents), h as (select id, cast(('0x' || substr(sha1(term), 1, 8)) as bigint) % 64 as idx, case when cast(('0x' || substr(sha1(term), 9, 2)) as bigint) % 2 = 0 then 1 else -1 end as sign from w),
s as (select id, cast(idx as integer) as idx, sum(sign) as s from h group by all), n as (select id, sqrt(sum(s * s)) as n from s group by id)
select id, idx, round(case when n > 0 then s / n else 0 end, 6) as value from s join n using (id)
""")
def hash_embed(t: Tables) -> DataFrame:
    return R.hash_embedding(corpus(t), 64).withColumn("value", F.round("value", 6))


@query("DEN-4", rf"""
with tri as (select d.doc_id, d.lang as query, coalesce(d.text, '') as positive, b.text as negative from documents d join benchmark b on d.doc_id % (select count(*) from benchmark) = b.item_id),
x as (select unnest(list_distinct(regexp_extract_all(lower(query || ' ' || positive), '[\p{{L}}\p{{N}}]+'))) as term, 1.0 as w from tri union all select unnest(list_distinct(regexp_extract_all(lower(query || ' ' || negative), '[\p{{L}}\p{{N}}]+'))), -0.5 from tri)
select term, sum(w) as weight from x group by term having abs(sum(w)) > 1
""", doubles="weight")
def token_weights(t: Tables) -> DataFrame:
    n = t.benchmark.agg(F.count(F.lit(1)).alias("n"))
    docs = t.documents.crossJoin(F.broadcast(n)).withColumn("k", F.col("doc_id") % F.col("n"))
    rows = docs.join(t.benchmark.select("item_id", F.col("text").alias("negative")), F.col("k") == F.col("item_id"))
    return R.token_weights(rows.select(F.col("lang").alias("query"), F.col("text").alias("positive"), "negative"), 0.5, 1.0)


FUSED = f"""
with {BM25}, exact as (select qid, id, row_number() over (partition by qid order by cnt desc, id) as rank from (select qid, tf.id, count(*) as cnt from asked join tf using (term) group by all)),
parts as (select qid, id, 0.3 / (rank - 1 + 60) as part from sparse where rank <= 120 union all select qid, id, 0.7 / (rank - 1 + 60) from exact where rank <= 120), fused as (select qid, id, round(sum(part), 6) as score from parts group by all)
"""


def overlap_hits(hits: DataFrame, k: int = 120) -> DataFrame:
    """Documents by the number of distinct query terms they hold."""
    return R.top_k(hits.select("qid", "id", F.col("matched").cast("double").alias("score")), k)


def fused_hits(t: Tables) -> DataFrame:
    sparse, exact = R.bm25_rankings(corpus(t), passages(t), 120)
    return R.rrf([(sparse, 0.3), (exact, 0.7)])


VARIANTS = """base as (select item_id as qid, trim(text) as q, case when item_id % 2 = 0 then regexp_extract_all(text, '[A-Z][a-z]+')[1:3] else [] end as refs from benchmark),
kw as (select *, trim(regexp_replace(q, '(?i)^\\s*(what|when|where|which|who|how|is|are|was|were|does|did|can|should|would|will)\\s+', '')) as k from base),
variants as (select qid, unnest([0, 1, 2]) as v, unnest([q, 'legal provision article: ' || q, case when len(refs) > 0 then array_to_string(refs, ' ') || ' ' || q when length(k) > 10 then k else q end]) as text from kw where q <> ''),
"""
VARIED = "with " + VARIANTS + BM25.replace("select item_id as qid, unnest", "select qid * 3 + v as qid, unnest").replace("from benchmark)", "from variants)")


@query("HYB-4", VARIED + """, parts as (select qid // 3 as qid, id, 1.0 / (rank - 1 + 60) as part from sparse where rank <= 40), fused as (select qid, id, round(sum(part), 6) as score from parts group by all)
select qid, id, score, rank from (select *, row_number() over (partition by qid order by score desc, id) as rank from fused) where rank <= 10""")
def variant_fusion(t: Tables) -> DataFrame:
    refs = F.when(F.col("qid") % 2 == 0, F.regexp_extract_all("query", F.lit("[A-Z][a-z]+"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return R.fused_variants(corpus(t), passages(t).select("qid", R.query_variants(F.col("query"), refs, "legal provision article").alias("variants"))).select("qid", "id", "score", "rank")


@query("HYB-1 HYB-2", FUSED + "select qid, id, score, rank from (select *, row_number() over (partition by qid order by score desc, id) as rank from fused) where rank <= 10")
def rrf_weighted(t: Tables) -> DataFrame:
    return R.top_k(fused_hits(t), 10).select("qid", "id", "score", "rank")


@query("HYB-3", FUSED + ", input as (select qid, id, rank as pos from sparse where rank <= 20) select qid, id, row_number() over (partition by qid order by s desc, pos, id) as rank from (select input.qid, input.id, pos, coalesce(score, 0) as s from input left join (select qid, id, round(0.7 / (rank - 1 + 60), 6) as score from exact where rank <= 120) e on e.qid = input.qid and e.id = input.id)")
def rrf_rerank(t: Tables) -> DataFrame:
    sparse, exact = R.bm25_rankings(corpus(t), passages(t), 120)
    rows = sparse.where("rank <= 20").select("qid", "id", F.col("rank").alias("pos"))
    return R.rrf_rerank(rows, [(exact, 0.7)]).select("qid", "id", "rank")


@query("HYB-7 HYB-18 SET-1", FUSED + """, surfaces as (select qid, id, score, 'sparse' as source from sparse where rank <= 10 union all select qid, id, cast(cnt as double), 'overlap' from (select qid, tf.id, count(*) as cnt from asked join tf using (term) group by all) x where (qid, id) in (select (qid, id) from exact where rank <= 10))
select qid, id, max(score) as score, array_to_string(list_sort(list(distinct source)), '|') as sources from surfaces group by qid, id""")
def surface_union(t: Tables) -> DataFrame:
    hits = all_hits(t)
    return R.surface_union([("sparse", sparse_hits(t, 10, hits)), ("overlap", overlap_hits(hits, 10))]).withColumn("sources", F.array_join("sources", "|"))


@query("HYB-9", f"with {BM25} select qid, id, round(score + case when lang = 'en' then 0.06 else 0 end + case when source = 'src0' then 0.15 else 0 end, 6) as score from sparse join documents on doc_id = id where rank <= 10")
def payload_boost(t: Tables) -> DataFrame:
    hits = sparse_hits(t).join(corpus(t).select("id", "lang", "source"), "id")
    return R.boosted(hits, [(F.col("lang") == "en", 0.06), (F.col("source") == "src0", 0.15)]).select("qid", "id", F.round("score", 6).alias("score"))


@query("HYB-11", f"with {BM25}, hits as (select qid, id, score, lower(source) as key from sparse join documents on doc_id = id where rank <= 20), best as (select *, row_number() over (partition by qid, key order by score desc, id) as r from hits) select qid, id, score from best where r = 1")
def dup_title_suppress(t: Tables) -> DataFrame:
    hits = sparse_hits(t, 20).join(corpus(t).select("id", F.col("source").alias("title")), "id").withColumn("doc", F.col("id"))
    return R.suppress_duplicate_titles(hits).select("qid", "id", "score")


@query("HYB-15 WN-2", f"with {BM25} select qid, source, id, place from (select qid, source, id, row_number() over (partition by qid, source order by score desc, id) as place from sparse join documents on doc_id = id where rank <= 40) where place <= 2")
def per_ref_topk(t: Tables) -> DataFrame:
    hits = sparse_hits(t, 40).join(corpus(t).select("id", "source"), "id")
    return ranking.best_per(hits, ["qid", "source"], [F.desc("score"), F.asc("id")], 2).select("qid", "source", "id", "place")


@query("FLT-4", f"""
with {BM25}, hits as (select qid, id, score, source, lang from sparse join documents on doc_id = id where rank <= 20), l as (select qid, id, 0 as level from hits where source = 'src1' and lang = 'fr' union all select qid, id, 1 from hits where source = 'src1' union all select qid, id, 2 from hits)
select qid, id, level from l where level = (select min(level) from l m where m.qid = l.qid)
""")
def fail_open_levels(t: Tables) -> DataFrame:
    hits = sparse_hits(t, 20).join(corpus(t).select("id", "source", "lang"), "id").select("qid", "id", "source", "lang")
    return R.fail_open([hits.where("source = 'src1' and lang = 'fr'"), hits.where("source = 'src1'"), hits]).select("qid", "id", "level")


@query("FLT-6", f"""
with {BM25}, gold as (select item_id as qid, min(doc_id) as id from benchmark b join documents d on contains(d.text, b.text) group by all), cand as (select qid, id, 0 as part, 1 as spot from gold union all select qid, id, 1, rank from sparse where rank <= 10), once as (select qid, id, min(part * 1000 + spot) as o from cand group by all)
select qid, id, slot from (select qid, id, row_number() over (partition by qid order by o, id) as slot from once) where slot <= 5
""")
def must_include_topk(t: Tables) -> DataFrame:
    gold = contained(t).groupBy(F.col("item_id").alias("qid")).agg(F.min("doc_id").alias("id")).withColumn("pos", F.lit(1))
    return R.must_include(sparse_hits(t), gold, 5)


def contained(t: Tables) -> DataFrame:
    return grounding.contained(t.benchmark, t.documents)


@query("JN-9", "select item_id, doc_id from benchmark b join documents d on contains(d.text, b.text)")
def contamination(t: Tables) -> DataFrame:
    return contained(t)


@query("AG-17 JN-4 AG-14 AG-19", f"""
with {BM25}, gold as (select item_id as qid, list(doc_id) as g from benchmark b join documents d on contains(d.text, b.text) group by all), top as (select qid, list(id order by rank) as ids from sparse where rank <= 10 group by all)
select gold.qid, len(g) as n_gold, round(len(list_intersect(g, coalesce(ids, []))) / len(g), 6) as recall_10 from gold left join top using (qid)
""")
def recall_at_k(t: Tables) -> DataFrame:
    gold = contained(t).groupBy(F.col("item_id").alias("qid")).agg(F.collect_set("doc_id").alias("g"))
    top = sparse_hits(t).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"))
    both = gold.join(top, "qid", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<bigint>")))
    return both.select("qid", F.size("g").cast("long").alias("n_gold"), F.round(metrics.recall_at(F.col("g"), F.col("ids"), 10), 6).alias("recall_10"))


@query("AG-18", f"""
with {BM25}, gold as (select distinct item_id as qid, doc_id as id from benchmark b join documents d on contains(d.text, b.text)), f as (select qid, min(case when gold.id is not null then rank end) as first from sparse left join gold using (qid, id) where rank <= 10 group by qid)
select count(*) as questions, round(avg(case when first <= 1 then 1.0 else 0.0 end), 6) as hit_1, round(avg(case when first <= 2 then 1.0 else 0.0 end), 6) as hit_2, round(avg(coalesce(1.0 / first, 0.0)), 6) as mrr from f
""")
def mrr_hits(t: Tables) -> DataFrame:
    gold = contained(t).select(F.col("item_id").alias("qid"), F.col("doc_id").alias("id"), F.lit(1).alias("label"))
    return metrics.hits_and_mrr(sparse_hits(t).join(gold, ["qid", "id"], "left"))


@query("WN-4 WN-5", f"with {BM25} select qid, round(max(case when rank = 1 then score end) - coalesce(max(case when rank = 2 then score end), 0), 6) as margin from sparse where rank <= 10 group by qid")
def rerank_margin(t: Tables) -> DataFrame:
    return ranking.margins(sparse_hits(t))


@query("WN-4", f"with {BM25} select qid, id, round(case when max(score) over w > min(score) over w then (score - min(score) over w) / (max(score) over w - min(score) over w) else 0.5 end, 5) as scaled from sparse where rank <= 10 window w as (partition by qid)")
def rank_normalize(t: Tables) -> DataFrame:
    return sparse_hits(t).select("qid", "id", F.round(ranking.min_max(F.col("score"), ["qid"]), 5).alias("scaled"))


@query("AG-1 HYB-8", f"""
with {BM25}, c as (select qid, source as page, id, score as rerank, 1.0 / rank as retrieval from sparse join documents on doc_id = id where rank <= 40), p as (select *, row_number() over (partition by qid, page order by rerank desc, id) as place from c)
select qid, page, round(round(max(case when place = 1 then rerank end) + 0.15 * max(case when place = 1 then retrieval end) + 0.05 * coalesce(max(case when place = 2 then rerank end), 0) + 0.01 * least(count(*), 3), 6), 4) as score from p group by all
""")
def page_score_agg(t: Tables) -> DataFrame:
    hits = sparse_hits(t, 40).join(corpus(t).select("id", F.col("source").alias("page")), "id")
    scores = ranking.page_scores(hits.select("qid", "page", "id", F.col("score").alias("rerank"), (1 / F.col("rank")).alias("retrieval")))
    # scaled, then rounded, as in the SQL: a tie is that of the scaled double
    return scores.withColumn("score", F.round(F.col("score") * 10000) / 10000)


@query("RR-2", rf"""
with {BM25}, x as (select qid, s.id, rank, b.text as query, d.text, source, lang, regexp_extract_all(lower(b.text), '[\p{{L}}\p{{N}}]+') as q, regexp_extract_all(lower(d.text), '[\p{{L}}\p{{N}}]+') as t from sparse s join benchmark b on item_id = qid join documents d on doc_id = s.id where rank <= 10),
y as (select *, list_distinct(list_transform(range(len(q) - 1), lambda i: q[i + 1] || ' ' || q[i + 2])) as q2, list_transform(range(len(t) - 1), lambda i: t[i + 1] || ' ' || t[i + 2]) as t2 from x),
z as (select qid, id, round(0.28 * (len(list_intersect(list_distinct(q), t)) / len(list_distinct(q))) + 0.18 * case when len(q2) > 0 then len(list_intersect(q2, t2)) / len(q2) else 0 end
 + 0.16 * (list_reduce(range(len(t)), lambda found, i: case when q[found + 1] = t[i + 1] then found + 1 else found end, 0::bigint) / len(q)) + 0.18 * case when contains(' ' || array_to_string(t, ' ') || ' ', ' ' || array_to_string(q, ' ') || ' ') then 1 else 0 end
 + 0.12 * case when contains(lower(text), lower(source)) then 1 else 0 end + 0.08 * case when lang = 'en' then 1 else 0 end + 0.05 * case when rank = 1 then 1 else 0 end, 6) as rerank from y)
select qid, id, rerank, place from (select *, row_number() over (partition by qid order by rerank desc, id) as place from z) where place <= 8
""")
def heuristic_rerank(t: Tables) -> DataFrame:
    hits = sparse_hits(t, 10).join(corpus(t), "id").join(passages(t), "qid")
    rows = ranking.with_heuristic_score(hits, "query", "text", F.array(F.col("source")), F.col("lang") == "en", F.col("rank") == 1)
    return ranking.best_per(rows, ["qid"], [F.desc("rerank"), F.asc("id")], 8).select("qid", "id", "rerank", "place")


@query("HYB-13 GRF-7", """
with recursive edges as (select distinct l_partkey as src, l_suppkey as dst from lineitem), h0 as (select distinct o_custkey as qid, l_partkey as node from orders join lineitem on o_orderkey = l_orderkey)
select qid, node, min(hop) as hop from (select qid, node, 0 as hop from h0 union all select qid, dst, 1 from h0 join edges on src = node union all select qid, e2.dst, 2 from h0 join edges e1 on e1.src = node join edges e2 on e2.src = e1.dst) group by qid, node
""")
def citation_hops(t: Tables) -> DataFrame:
    edges = t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    seeds = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("qid"), F.col("l_partkey").alias("node"))
    return graph.expand(seeds, edges, 2)


@query("JN-9", f"""
with {BM25}, gold as (select distinct item_id as qid, doc_id as page from benchmark b join documents d on contains(d.text, b.text)), s as (select qid, id as page, source as doc, round(score, 4) as overlap from sparse join documents on doc_id = id where rank <= 20),
near as (select distinct qid, source as doc from gold join documents on doc_id = page), x as (select qid, page, round(overlap + case when (qid, doc) in (select (qid, doc) from near) then 0.35 else 0.1 end, 6) as score from s where (qid, page) not in (select (qid, page) from gold))
select qid, page, score, place from (select *, row_number() over (partition by qid order by score desc, page) as place from x) where place <= 3
""")
def hard_negatives(t: Tables) -> DataFrame:
    sources = corpus(t).select("id", F.col("source").alias("doc"))
    overlaps = sparse_hits(t, 20).join(sources, "id").select("qid", F.col("id").alias("page"), "doc", F.round("score", 4).alias("overlap"))
    gold = contained(t).join(sources, F.col("doc_id") == F.col("id")).select(F.col("item_id").alias("qid"), F.col("doc_id").alias("page"), "doc")
    return mldata.hard_negatives(overlaps, gold)


@query("SRC-21", "select doc_id, n_chars from documents where doc_id in (select item_id from benchmark)")
def fetch_by_ids(t: Tables) -> DataFrame:
    return t.documents.join(t.benchmark.select(F.col("item_id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "n_chars")


@query("GR-3 GR-5 GR-14", f"""
with {BM25}, support as (select asked.qid, term as slot, id as doc from asked join tf using (term) where (qid, id) in (select (qid, id) from sparse where rank <= 5))
select qid, count(*) as slots, cast(sum(ok) as bigint) as covered, round(avg(ok), 6) as ratio from (select a.qid, a.term, case when count(distinct doc) >= 2 then 1 else 0 end as ok from asked a left join support s on s.qid = a.qid and s.slot = a.term group by all) group by qid
""")
def slot_audit(t: Tables) -> DataFrame:
    slots = passages(t).select("qid", F.explode(F.array_distinct(T.tokens(F.col("query")))).alias("slot"))
    words = R.postings(corpus(t)).select(F.col("term").alias("slot"), "id")
    support = sparse_hits(t, 5).select("qid", "id").join(words, "id").join(slots, ["qid", "slot"], "left_semi").select("qid", "slot", F.col("id").alias("doc"))
    return grounding.slot_audit(slots.withColumn("least_docs", F.lit(2)), support)
