"""Context guarantees, topic rules, page pairs and expansions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.functions import classify as C, text as T
from tessera.operators import mldata, selection as S
from tessera.queries.registry import Tables, query
from tessera.queries.search import BM25, all_hits, corpus, overlap_hits, sparse_hits


@query("HYB-12", f"""
with {BM25}, h as (select qid, id, source as doc, score, rank from sparse join documents on doc_id = id where rank <= 40), t as (select * from h where rank <= 10), few as (select qid from t group by qid having count(distinct doc) < 9),
m as (select *, row_number() over (partition by qid order by score desc, id) as r from h where qid in (select qid from few) and (qid, doc) not in (select (qid, doc) from t))
select qid, id, doc, score, false as extra from t union all select qid, id, doc, score, true from m where r <= 5
""")
def diversity_expansion(t: Tables) -> DataFrame:
    hits = sparse_hits(t, 40).join(corpus(t).select("id", F.col("source").alias("doc")), "id").select("qid", "id", "doc", "score", "rank")
    return S.diversify(hits.where("rank <= 10").drop("rank"), hits.drop("rank"), 9, limit=5)


@query("HYB-19 CLS-9", r"""
with x as (select conv_id, turn, list_distinct(regexp_extract_all(text, '[A-Z][a-z]+')) as n, list_distinct(regexp_extract_all(text, '[0-9]+')) as r from conversations)
select conv_id, turn, len(n) + len(r) as variants from x
""")
def entity_variants(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.size(S.entity_variants(F.col("text"), "[A-Z][a-z]+", "[0-9]+")).cast("long").alias("variants"))


@query("JN-1", """
with c as (select o_orderkey as id, o_custkey as page, o_orderstatus as t from orders), s as (select o_custkey as page, o_orderkey as segment, row_number() over (partition by o_custkey order by o_orderkey) as pos, case when o_orderpriority like '1%' then 'article' else 'other' end as kind, o_orderstatus as body from orders), x as (select id, segment, row_number() over (partition by id order by pos, segment) as r from c join s using (page) where contains(body, t) or kind = 'article')
select id, segment from x where r = 1
""")
def segment_of_chunk(t: Tables) -> DataFrame:
    chunks = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("page"), F.col("o_orderstatus").alias("text"))
    pos = F.expr("row_number() over (partition by o_custkey order by o_orderkey)")
    segments = t.orders.select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("segment"), pos.alias("pos"), F.when(F.col("o_orderpriority").like("1%"), "article").otherwise("other").alias("kind"), F.col("o_orderstatus").alias("text"))
    return S.first_segment(chunks, segments)


@query("JN-3", """
select c_custkey as src, n_nationkey as dst from customer join nation on n_nationkey in (c_nationkey, (c_nationkey + 1) % 25) where c_custkey <> n_nationkey
""")
def title_mentions(t: Tables) -> DataFrame:
    names = t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    texts = t.customer.join(names, F.col("c_nationkey") == F.col("k")).drop("k").withColumnRenamed("name", "one").join(names, (F.col("c_nationkey") + 1) % 25 == F.col("k"))
    texts = texts.select(F.col("c_custkey").alias("src"), F.concat(F.lit("amends "), "one", F.lit(" and then "), "name").alias("text"))
    return S.mentions(texts, t.nation.select(F.col("n_nationkey").alias("dst"), F.col("n_name").alias("title")))


@query("WN-9", f"""
with {BM25}, h as (select qid, id, lang as doc, rank from sparse join documents on doc_id = id where rank <= 20), t as (select * from h where rank <= 3), c as (select qid, min(doc) as sole from t group by qid having count(distinct doc) = 1), o as (select h.qid, h.id, row_number() over (partition by h.qid order by rank) as r from h join c using (qid) where rank > 3 and doc <> sole)
select qid, id, rank from t where not (rank = 3 and qid in (select qid from o)) union all select qid, id, 3 from o where r = 1
""")
def uncrowded(t: Tables) -> DataFrame:
    hits = sparse_hits(t, 20).join(corpus(t).select("id", F.col("lang").alias("doc")), "id").select("qid", "id", "doc", "rank")
    return S.uncrowd(hits, 3).select("qid", "id", "rank")


@query("WN-14", """
select qid, array_to_string(list(n order by n) filter (where d > 0.05), ',') as ids from (select l_orderkey as qid, l_linenumber as n, max(l_discount) as d from lineitem where l_linenumber <= 6 group by all) group by qid
""")
def best_subset(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("id")).agg(F.max("l_discount").alias("d"))
    rows = lines.select("qid", "id", F.col("id").alias("pos"), F.when(F.col("d") > 0.05, 2.0).otherwise(0.5).alias("gain"), F.lit(1.0).alias("cost"))
    out = S.best_subset(rows, 6)
    return out.select("qid", F.when(F.size("ids") > 0, F.array_join("ids", ",")).alias("ids"))


@query("RR-5 AG-30", f"""
with {BM25}, o as (select qid, id, row_number() over (partition by qid order by count(*) desc, id) as other from asked join tf using (term) group by qid, id)
select s.qid, count(other) as common, cast(sum(case when other <> rank then 1 else 0 end) as bigint) as moved from sparse s left join (select * from o where other <= 10) o using (qid, id) where rank <= 10 group by s.qid
""")
def shadow_rerank(t: Tables) -> DataFrame:
    hits = all_hits(t)
    return S.rank_overlap(sparse_hits(t, 10, hits), overlap_hits(hits, 10), 10)


@query("RR-6 RR-9 GR-13", r"""
with f as (select conv_id as qid, turn as pos, text as fragment from conversations where role = 'assistant'), c as (select conv_id as qid, turn as id, text from conversations where role = 'user'),
x as (select f.qid, pos, id, list_distinct(regexp_extract_all(lower(fragment), '[\p{L}\p{N}]+')) as q, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w, contains(lower(text), lower(fragment)) as ex from f join c using (qid)),
s as (select qid, pos, id, round(case when len(q) > 0 then len(list_intersect(q, w)) / len(q) else 0 end + case when ex then 1.0 else 0.0 end, 6) as score from x)
select qid, pos, id, score from (select *, row_number() over (partition by qid, pos order by score desc, id) as r from s) where r = 1
""")
def best_support(t: Tables) -> DataFrame:
    c = t.conversations
    fragments = c.where("role = 'assistant'").select(F.col("conv_id").alias("qid"), F.col("turn").alias("pos"), F.col("text").alias("fragment"))
    return S.best_support(fragments, c.where("role = 'user'").select(F.col("conv_id").alias("qid"), F.col("turn").alias("id"), "text"))


@query("RR-7 RR-10", r"""
with x as (select doc_id as id, text from documents), h as (select id, 'contact' as topic, 2.0 as w from x where regexp_matches(text, '@') union all select id, 'contact', 1.5 from x where regexp_matches(text, '[0-9]{3}') union all select id, 'loud', 1.0 from x where regexp_matches(text, '!!'))
select id, topic, round(sum(w), 6) as score from h group by all
""", doubles="score")
def topic_scores(t: Tables) -> DataFrame:
    return S.topic_scores(t.documents.select(F.col("doc_id").alias("id"), "text"), [("contact", "@", 2.0), ("contact", "[0-9]{3}", 1.5), ("loud", "!!", 1.0)])


@query("RR-8 GR-12", f"""
with {BM25}, h as (select qid, id, lang as ref, rank, row_number() over (partition by qid, lang order by rank, id) = 1 as must from sparse join documents on doc_id = id where rank <= 30)
select qid, id, ref, rank from (select *, row_number() over (partition by qid order by must desc, rank, id) as r from h) where r <= 4
""")
def guaranteed_context(t: Tables) -> DataFrame:
    hits = sparse_hits(t, 30).join(corpus(t).select("id", F.col("lang").alias("ref")), "id").select("qid", "id", "ref", "rank")
    return S.guarantee_each(hits, 4)


@query("GR-6 GRF-9", """
with p as (select l_orderkey as qid, l_suppkey % 2 as doc, l_linenumber as page, l_returnflag as role, l_quantity as score from lineitem), b as (select *, row_number() over (partition by qid, doc, role order by score desc, page) as r from p)
select a.qid, a.doc, a.page as a, c.page as b from b a join b c on a.qid = c.qid and a.doc = c.doc and a.role = 'R' and c.role = 'N' and a.r = 1 and c.r = 1
""")
def page_pairs(t: Tables) -> DataFrame:
    pages = t.lineitem.select(F.col("l_orderkey").alias("qid"), (F.col("l_suppkey") % 2).alias("doc"), F.col("l_linenumber").alias("page"), F.col("l_returnflag").alias("role"), F.col("l_quantity").alias("score"))
    return S.page_pairs(pages, "R", "N")


@query("DB-11", """
select o_custkey as doc, max(round(o_totalprice, 2)) as amount, arg_min(o_orderkey, (-round(o_totalprice, 2), o_orderkey)) as pos from orders group by o_custkey
""")
def largest_amount(t: Tables) -> DataFrame:
    text = F.concat(F.lit("pays USD "), F.format_number("o_totalprice", 2), F.lit(" and $ 5 in 2020"))
    return S.largest_amount(t.orders.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("pos"), text.alias("text")))


@query("DB-9", r"""
with f as (select doc_id as id, 'mail' as kind, unnest(list_distinct(regexp_extract_all(text, '[a-z]+[0-9.]*[0-9]+@[a-z0-9.]+[a-z]'))) as value from documents union all select doc_id, 'number', unnest(list_distinct(regexp_extract_all(text, '[0-9]{2,}'))) from documents)
select id, kind, value from f
""")
def page_facts(t: Tables) -> DataFrame:
    return S.page_facts(t.documents.select(F.col("doc_id").alias("id"), "text"), [("mail", r"[a-z]+[0-9.]*[0-9]+@[a-z0-9.]+[a-z]"), ("number", "[0-9]{2,}")])


@query("CH-10 CH-7", rf"""
with a as (select item_id as qid, case when item_id % 2 = 0 then 'en' else 'xx' end as wanted, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'))) as term from benchmark), h as (select doc_id as id, lang as ref, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'))) as term from documents),
x as (select qid, id, case when ref <> wanted then 1 else 0 end as level, count(*) as hits from a join h using (term) group by all), y as (select *, min(level) over (partition by qid) as best from x)
select qid, id, hits from (select *, row_number() over (partition by qid order by hits desc, id) as place from y where level = best or best = 1) where place <= 5
""")
def lexical_segments(t: Tables) -> DataFrame:
    segments = t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("ref"), T.tokens(F.col("text")).alias("tokens"))
    questions = t.benchmark.select(F.col("item_id").alias("qid"), F.when(F.col("item_id") % 2 == 0, "en").otherwise("xx").alias("ref"), T.tokens(F.col("text")).alias("tokens"))
    return S.lexical_segments(segments, questions, 5).select("qid", "id", "hits")


@query("UDF-4 GR-11", """
select doc_id, array_to_string(regexp_extract_all(text, '(?s).{0,10}@.{0,10}'), ' ... ') as around from documents where contains(text, '@')
""")
def compacted_context(t: Tables) -> DataFrame:
    return t.documents.where(F.contains("text", F.lit("@"))).select("doc_id", S.windows_around(F.col("text"), "@", 10, 10).alias("around"))


@query("ML-17 AG-16", """
with p as (select l_orderkey as qid, list(distinct l_partkey) filter (where l_returnflag = 'R') as g, list(distinct l_partkey) as f, list(distinct l_partkey) filter (where l_returnflag = 'A') as w from lineitem group by 1), q as (select qid, coalesce(g, []) as g, f, list_filter(f, lambda x: not list_contains(coalesce(w, []), x)) as h from p),
n as (select qid, len(g) as ng, len(f) as nf, len(h) as nh, len(list_intersect(g, f)) as a, len(list_intersect(g, h)) as b from q)
select qid, round(case when ng = 0 and nf = 0 then 1.0 when ng = 0 or nf = 0 or a = 0 then 0.0 else 7.25 * (a / nf) * (a / ng) / (6.25 * (a / nf) + a / ng) end, 6) as full, round(case when ng = 0 and nh = 0 then 1.0 when ng = 0 or nh = 0 or b = 0 then 0.0 else 7.25 * (b / nh) * (b / ng) / (6.25 * (b / nh) + b / ng) end, 6) as alone from n
""")
def twin_effect(t: Tables) -> DataFrame:
    some = lambda flag: F.collect_set(F.when(F.col("l_returnflag") == flag, F.col("l_partkey")))
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("qid")).agg(some("R").alias("gold"), F.collect_set("l_partkey").alias("found"), some("A").alias("twin"))
    return S.twin_effect(rows)


@query("ML-16", r"""
with h as (select 'mail' as rule from documents where regexp_matches(text, '@') union all select 'digits' from documents where regexp_matches(text, '[0-9]'))
select rule, count(*) as support, count(*) >= 20 as promoted from h group by rule
""")
def activated_rules(t: Tables) -> DataFrame:
    return S.activated_rules(t.documents, [("mail", "@"), ("digits", "[0-9]")], 20)


@query("TXT-8", "select n_nationkey, 'Nation_' || n_nationkey || ' Law' as title from nation")
def trailing_titles(t: Tables) -> DataFrame:
    text = F.concat(F.lit("as amended by THE  "), "n_name", F.lit(" law"))
    return t.nation.select("n_nationkey", T.trailing_title(text, ("the", "by")).alias("title"))


@query("CLS-10 CLS-11", r"""
with x as (select conv_id, turn, lower(text) as q, len(regexp_extract_all(text, '[A-Z][a-z]+')) > 0 as named from conversations), m as (select *, case when regexp_matches(q, '\bpage [0-9]+') then 'explicit_page' when regexp_matches(q, '\b(compare|both|differ|versus)') then 'compare' when regexp_matches(q, '\b(all|each|every|list)\b') then 'all' when regexp_matches(q, '\b(no|not|never|without)\b') then 'negative' when regexp_matches(q, '\b(when|date|before|after|since)\b') then 'temporal' else 'single' end as mode,
 case when regexp_matches(q, '^\s*who\b') then 'who' when regexp_matches(q, '^\s*when\b') then 'when' when regexp_matches(q, 'how many') then 'count' when regexp_matches(q, '^\s*(is|are|was|were|does|do|did|can|has|have)\b') then 'boolean' else 'open' end as predicate from x)
select conv_id, turn, predicate, mode, case mode when 'explicit_page' then 1 when 'compare' then 4 when 'all' then 6 when 'negative' then 3 when 'temporal' then 2 else 1 end as budget, 0.5 + case when named then 0.25 else 0 end + case when predicate <> 'open' then 0.25 else 0 end as confidence from m
""", doubles="confidence")
def query_contracts(t: Tables) -> DataFrame:
    c = C.query_contract(F.col("text"), "[A-Z][a-z]+")
    return t.conversations.select("conv_id", "turn", c["predicate"].alias("predicate"), c["mode"].alias("mode"), c["budget"].alias("budget"), c["confidence"].alias("confidence"))


@query("CH-9 TXT-33", "select event_id, cast(json_extract(props, '$.k') as bigint) as k, 'k=' || cast(json_extract(props, '$.k') as varchar) as compact from events")
def interrogation_records(t: Tables) -> DataFrame:
    r = T.record(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")), "k bigint")
    return t.events.select("event_id", r["k"].alias("k"), F.concat(F.lit("k="), r["k"].cast("string")).alias("compact"))


@query("ML-11 GR-4")
def greedy_cover(t: Tables) -> DataFrame:
    pages = t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", T.tokens(F.col("text")).alias("w")))), lambda x: x["w"]).alias("p"))
    return pages.select("conv_id", F.array_join(F.transform(mldata.greedy_cover(F.col("p"), 1, 3), lambda i: i.cast("string")), ",").alias("kept"))
