"""Registries, joins, merges, upserts and graphs over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.functions import text as T
from tessera.operators import graph, grounding, metrics, mldata, ranking, registry
from tessera.queries.registry import Tables, query


def values(t: Tables) -> DataFrame:
    """Fields of the orders' customers, long."""
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("pages", F.when(F.col("c_custkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("p1"))))
    return registry.field_values(rows, "c_custkey", "c_custkey", ["c_name", "n_name", "c_mktsegment"], "pages")


VALUES = """v as (select c_custkey as id, c_name, n_name, c_mktsegment, case when c_custkey % 3 = 0 then 0.82 else 0.98 end as confidence from customer join nation on c_nationkey = n_nationkey)"""


@query("DB-1 JN-8 DB-2", f"with {VALUES} select id, 'c_name' as field, c_name as value, confidence from v union all select id, 'n_name', n_name, confidence from v union all select id, 'c_mktsegment', c_mktsegment, confidence from v", doubles="confidence")
def field_values(t: Tables) -> DataFrame:
    return values(t).select("id", "field", "value", "confidence")


@query("JN-11 DB-1", f"""
with {VALUES}, q as (select o_orderkey as qid, o_custkey as a, o_custkey + 1 as b from orders), x as (select q.*, va.confidence >= 0.85 as oka, vb.confidence >= 0.85 as okb, va.n_name as na, vb.n_name as nb from q left join v va on va.id = a left join v vb on vb.id = b)
select qid, case when oka then a when okb then b end as found_id, case when oka then na when okb then nb end as value from x
""")
def field_lookup(t: Tables) -> DataFrame:
    asked = t.orders.select(F.col("o_orderkey").alias("qid"), F.lit("n_name").alias("field"), F.array("o_custkey", F.col("o_custkey") + 1).alias("ids"))
    return registry.lookup(asked, values(t)).select("qid", "found_id", "value")


@query("AG-3 AG-5 AG-11", f"""
with {VALUES}, l as (select id, 'n_name' as field, n_name as value from v union all select id, 'c_mktsegment', c_mktsegment from v), m as (select c_custkey // 2 as gid, c_custkey as doc from customer), n as (select gid, count(*) as n from m group by gid)
select m.gid, field, value from m join l on l.id = m.doc join n on n.gid = m.gid group by m.gid, field, value, n having count(*) = n
""")
def shared_attributes(t: Tables) -> DataFrame:
    groups = t.customer.select(F.expr("c_custkey div 2").alias("gid"), F.col("c_custkey").alias("doc"))
    return registry.shared_values(values(t).where("field <> 'c_name'"), groups)


@query("AG-4 WN-7", """
select o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) as first_label, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as last_label, strftime(min(o_orderdate), '%Y-%m-%d') as first_date from orders group by o_custkey
""")
def attribute_compare(t: Tables) -> DataFrame:
    out = registry.compare_first_last(t.orders, "o_custkey", F.col("o_orderkey"), F.col("o_orderdate"))
    return out.select("o_custkey", "first_label", "last_label", F.date_format("first_date", "yyyy-MM-dd").alias("first_date"))


@query("AG-6 AG-9", """
with x as (select c_custkey, c_mktsegment as segment, unnest(range(c_custkey % 3 + 1)) as k from customer)
select c_custkey, case when c_custkey % 2 = 0 then 'merged' else arg_max(segment || k, (k * 7) % 3) end as segment from x group by c_custkey
""")
def registry_merge(t: Tables) -> DataFrame:
    """The last of a customer's rows by position, and over it the later table's."""
    rows = t.customer.select("c_custkey", F.explode(F.expr("sequence(0, c_custkey % 3)")).alias("k"), F.col("c_mktsegment").alias("segment"))
    base = registry.last_by_position(rows.select("c_custkey", F.concat("segment", "k").alias("segment"), (F.col("k") * 7 % 3).alias("pos")), ["c_custkey"], "pos").drop("pos")
    later = t.customer.where("c_custkey % 2 = 0").select("c_custkey", F.lit("merged").alias("segment"))
    return registry.merge_later_wins([base, later], "c_custkey")


@query("AG-7 TXT-35", """
select 'customer' as kind, trim(regexp_replace(lower(c_mktsegment), '[^a-z0-9]+', ' ', 'g')) as key, count(distinct c_nationkey) as n_sources, max(c_mktsegment) as alias from customer group by 2
""")
def alias_clusters(t: Tables) -> DataFrame:
    rows = t.customer.select(F.lit("customer").alias("kind"), F.col("c_mktsegment").alias("name"), F.col("c_nationkey").alias("source"))
    return registry.alias_clusters(rows, "kind", "name", "source").select("kind", "key", F.size("sources").cast("long").alias("n_sources"), F.array_max("aliases").alias("alias"))


@query("AG-8", """
select 'order' as kind, min(o_orderstatus || o_orderpriority) as text, count(distinct o_custkey) as n_pages from orders group by lower(o_orderstatus || o_orderpriority)
""")
def dedupe_facts(t: Tables) -> DataFrame:
    facts = t.orders.select(F.lit("order").alias("kind"), F.concat("o_orderstatus", "o_orderpriority").alias("text"), F.array(F.col("o_custkey").cast("string")).alias("pages")).distinct()
    return registry.dedupe_facts(facts).select("kind", "text", F.size("pages").cast("long").alias("n_pages"))


@query("DB-7", "select c_custkey, case when c_custkey % 4 = 0 then 'X' else c_mktsegment end as c_mktsegment from customer")
def manual_overrides(t: Tables) -> DataFrame:
    changes = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "X").otherwise(" ").alias("c_mktsegment"))
    return registry.override(t.customer.select("c_custkey", "c_mktsegment"), changes, "c_custkey", ["c_mktsegment"])


@query("JN-12 GRF-5", """
with r as (select o_custkey as k, min(o_orderdate) as s, max(o_orderdate) as e from orders group by 1)
select o_orderkey, case when o_orderdate + interval 400 day < s then 'not_yet' when o_orderdate + interval 400 day < e then 'in_force' else 'ended' end as status from orders join r on k = o_custkey
""")
def point_in_time_status(t: Tables) -> DataFrame:
    records = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("start"), F.max("o_orderdate").alias("end"))
    asked = t.orders.select("o_orderkey", "o_custkey", (F.col("o_orderdate") + F.expr("interval 400 day")).alias("ref"))
    return registry.point_in_time(records, asked, "o_custkey", "start", "end", "ref").select("o_orderkey", "status")


@query("JN-12 JN-2", """
with p as (select o_custkey as k, o_orderdate as d, o_totalprice as v from orders where o_orderstatus = 'F')
select o.o_orderkey, (select max(v) from p where k = o_custkey and d = (select max(d) from p where k = o_custkey and d <= o_orderdate)) as price from orders o where o_orderstatus = 'O'
""")
def as_of_join(t: Tables) -> DataFrame:
    prices = t.orders.where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderdate").alias("d"), F.col("o_totalprice").alias("price"))
    asked = t.orders.where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_orderdate")
    return registry.as_of(asked, prices, "o_custkey", "o_orderdate", "d", "price").select("o_orderkey", "price")


@query("SRC-14 SRC-15 INC-4", "select o_orderkey, case when o_orderkey % 3 = 0 then 'changed' else o_orderstatus end as status from orders where o_orderkey % 7 <> 0 union all select -1 - o_orderkey, 'new' from orders where o_orderkey % 7 = 0")
def upsert_latest(t: Tables) -> DataFrame:
    base = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"))
    delta = base.where("o_orderkey % 3 = 0").withColumn("status", F.lit("changed")).union(base.where("o_orderkey % 7 = 0").select((-1 - F.col("o_orderkey")).alias("o_orderkey"), F.lit("new")))
    return registry.delete(registry.upsert(base, delta, "o_orderkey"), base.where("o_orderkey % 7 = 0"), "o_orderkey")


@query("SRC-16 SRC-17", "select o_orderkey, o_custkey, o_orderstatus as version from orders where o_orderstatus = 'F' or o_custkey % 2 = 0")
def stale_delete(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("version"))
    keep = rows.where("o_custkey % 2 = 1").select("o_custkey").distinct().withColumn("version", F.lit("F"))
    return registry.delete_stale(rows, keep, "o_custkey", "version").select("o_orderkey", "o_custkey", "version")


@query("INC-1 INC-2 INC-3", """
with a as (select doc_id, text from documents where doc_id % 5 <> 0), b as (select doc_id, case when doc_id % 5 = 2 then text || '!' else text end as text from documents where doc_id % 5 <> 1)
select coalesce(a.doc_id, b.doc_id) as doc_id, case when b.doc_id is null then 'deleted' when a.doc_id is null then 'new' when a.text = b.text then 'unchanged' else 'changed' end as status from a full outer join b using (doc_id)
""")
def manifest_diff(t: Tables) -> DataFrame:
    digest = lambda c: F.sha2(c.cast("binary"), 256).alias("digest")
    old = t.documents.where("doc_id % 5 <> 0").select("doc_id", digest(F.col("text")))
    new = t.documents.where("doc_id % 5 <> 1").select("doc_id", digest(F.when(F.col("doc_id") % 5 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text"))))
    return registry.change_plan(old, new, "doc_id", "digest")


def chain(t: Tables) -> DataFrame:
    """Each order is superseded by its customer's next."""
    return graph.next_edges(t.orders, "o_custkey", "o_orderdate", "o_orderkey")


CHAIN = "e as (select * from (select o_custkey, o_orderkey as src, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as dst from orders) where dst is not null)"


@query("GRF-8 GRF-1", f"with {CHAIN} select o_custkey, src, dst from e")
def next_edges(t: Tables) -> DataFrame:
    return chain(t)


@query("GRF-2 GRF-6", f"""
with {CHAIN}, r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as i, count(*) over (partition by o_custkey) as n, last_value(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following) as z from orders)
select o_orderkey as node, z as newest, n - i as hops from r where i < n
""")
def supersession_chain(t: Tables) -> DataFrame:
    return graph.newest(chain(t))


def supply(t: Tables) -> DataFrame:
    """Edges between nations: supplier's to customer's, for adjacent keys."""
    return t.nation.select(F.col("n_nationkey").cast("long").alias("src"), F.expr("case when n_nationkey < 5 then (n_nationkey + 1) % 5 when n_nationkey < 24 then n_nationkey + 1 else 99 end").cast("long").alias("dst"), F.when(F.col("n_nationkey") % 6 != 0, F.lit("2020-01-01")).alias("date"))


EDGES = "e as (select cast(n_nationkey as bigint) as src, cast(case when n_nationkey < 5 then (n_nationkey + 1) % 5 when n_nationkey < 24 then n_nationkey + 1 else 99 end as bigint) as dst, case when n_nationkey % 6 <> 0 then '2020-01-01' end as date from nation)"


@query("GRF-3", f"with recursive {EDGES}, r as (select src, dst from e union select r.src, e.dst from r join e on r.dst = e.src) select distinct src as node from r where src = dst")
def cycle_nodes(t: Tables) -> DataFrame:
    return graph.cycle_nodes(supply(t))


@query("GRF-4", f"with recursive {EDGES}, r as (select src, dst from e union select r.src, e.dst from r join e on r.dst = e.src) select 'cycle' as kind, src as node from r where src = dst union all select 'orphan', dst from e where dst not in (select n_nationkey from nation) union all select 'missing_date', src from e where date is null")
def graph_warnings(t: Tables) -> DataFrame:
    return graph.warnings(t.nation.select(F.col("n_nationkey").cast("long").alias("node")), supply(t))


@query("GRF-3 HYB-13", f"with recursive {EDGES}, r as (select src, dst, 1 as hops from e union select r.src, e.dst, hops + 1 from r join e on r.dst = e.src where hops < 30) select src, dst, min(hops) as hops from r group by src, dst")
def transitive_closure(t: Tables) -> DataFrame:
    return graph.closure(supply(t))


@query("GRF-7", "select l_suppkey as node, count(distinct l_partkey) as n_citing, min(l_partkey) as first from lineitem group by l_suppkey")
def citation_index(t: Tables) -> DataFrame:
    edges = t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return graph.cited_by(edges).select("node", "n_citing", F.array_min("citing").alias("first"))


def runs(t: Tables) -> tuple[DataFrame, DataFrame]:
    a = t.orders.where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("qid"), F.col("o_orderstatus").alias("answer"), F.array(F.col("o_custkey").cast("string")).alias("pages"))
    b = t.orders.where("o_orderkey % 13 <> 0").select(F.col("o_orderkey").alias("qid"), F.when(F.col("o_orderkey") % 4 == 0, "Z").otherwise(F.col("o_orderstatus")).alias("answer"), F.when(F.col("o_orderkey") % 3 == 0, F.array(F.col("o_custkey").cast("string"), F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("pages"))
    return a, b


@query("JN-5 AG-30 SET-5", """
select o_orderkey as qid, case when o_orderkey % 13 = 0 then 'only_a' when o_orderkey % 11 = 0 then 'only_b' else 'both' end as status,
 o_orderkey % 13 = 0 or o_orderkey % 11 = 0 or (o_orderkey % 4 = 0 and o_orderstatus <> 'Z') as answer_changed,
 (case when o_orderkey % 13 = 0 then 0 when o_orderkey % 3 = 0 then 2 else 0 end) - (case when o_orderkey % 11 = 0 then 0 else 1 end) as page_delta
from orders where not (o_orderkey % 11 = 0 and o_orderkey % 13 = 0)
""")
def run_diff(t: Tables) -> DataFrame:
    a, b = runs(t)
    return metrics.run_diff(a, b, "qid", "answer", "pages")


@query("JN-6 FLT-8", """
select o_orderkey as qid, o_orderstatus as answer, case when o_orderkey % 5 = 0 and o_orderkey % 13 <> 0 then case when o_orderkey % 3 = 0 then 2 else 0 end else 1 end as n_pages from orders where o_orderkey % 11 <> 0
""")
def answer_stable_merge(t: Tables) -> DataFrame:
    a, b = runs(t)
    allowed = a.where("qid % 5 = 0")
    return metrics.answer_stable_merge(a, b, "qid", "answer", "pages", allowed).select("qid", "answer", F.size("pages").cast("long").alias("n_pages"))


@query("WN-13", """
with p as (select p_partkey as id, p_brand as g, -p_retailprice as a, p_size as b from part)
select id from p x where not exists (select 1 from p y where y.g = x.g and y.a >= x.a and y.b >= x.b and (y.a > x.a or y.b > x.b))
""")
def pareto(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("g"), (-F.col("p_retailprice")).alias("a"), F.col("p_size").alias("b"))
    return rows.join(ranking.dominated(rows, ["a", "b"], "id", ["g"]), "id", "left_anti").select("id")


@query("WN-13", """
with x as (select o_orderpriority as g, o_orderkey as id, sum(l_quantity)::double as a, -min(l_extendedprice)::double as b, max(l_discount)::double as c, -max(l_tax)::double as d, count(*)::double as e, -(min(l_partkey) % 97)::double as f, max(l_suppkey % 13)::double as h from orders join lineitem on o_orderkey = l_orderkey group by all)
select g, id from x where not exists (select 1 from x y where y.g = x.g and y.a >= x.a and y.b >= x.b and y.c >= x.c and y.d >= x.d and y.e >= x.e and y.f >= x.f and y.h >= x.h and (y.a > x.a or y.b > x.b or y.c > x.c or y.d > x.d or y.e > x.e or y.f > x.f or y.h > x.h))
""")
def pareto_seven(t: Tables) -> DataFrame:
    """Orders of each priority that no other beats in seven measures."""
    lines = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    rows = lines.groupBy(F.col("o_orderpriority").alias("g"), F.col("o_orderkey").alias("id")).agg(
        F.sum("l_quantity").alias("a"), (-F.min("l_extendedprice")).alias("b"), F.max("l_discount").alias("c"), (-F.max("l_tax")).alias("d"),
        F.count(F.lit(1)).alias("e"), (-(F.min("l_partkey") % 97)).alias("f"), F.max(F.col("l_suppkey") % 13).alias("h"),
    )
    return rows.join(ranking.dominated(rows, ["a", "b", "c", "d", "e", "f", "h"], "id", ["g"]), "id", "left_anti").select("g", "id")


@query("WN-12 WN-2", """
with d as (select p_partkey, p_brand, lower(p_name) as k, row_number() over (partition by lower(p_name) order by p_partkey) as r from part), f as (select *, row_number() over (partition by p_brand order by p_partkey) as n from d where r = 1)
select p_partkey, p_brand from f where n <= 5
""")
def family_dedupe(t: Tables) -> DataFrame:
    return ranking.dedupe_first(t.part.select("p_partkey", "p_brand", "p_name"), [F.lower("p_name")], ["p_partkey"], ["p_brand"], 5).select("p_partkey", "p_brand")


@query("WN-6", """
select l_orderkey, l_linenumber, max(l_linenumber) over (partition by l_orderkey) as last_page, count(*) over (partition by l_linenumber) - count(*) over (partition by l_orderkey, l_linenumber) as competitors from lineitem
""")
def page_positions(t: Tables) -> DataFrame:
    per = t.lineitem.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("all"))
    doc = t.lineitem.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("last_page"))
    own = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("own"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber").join(F.broadcast(per), "l_linenumber").join(doc, "l_orderkey").join(own, ["l_orderkey", "l_linenumber"])
    return rows.select("l_orderkey", "l_linenumber", "last_page", (F.col("all") - F.col("own")).alias("competitors"))


@query("JN-14", """
with p as (select l_orderkey as doc, l_linenumber as page from lineitem group by all), h as (select doc, page from p where page % 3 = 1)
select doc, page from p where (doc, page - 1) in (select (doc, page) from h) and (doc, page) not in (select (doc, page) from h)
""")
def adjacent_pages(t: Tables) -> DataFrame:
    pages = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page")).distinct().withColumn("text", F.lit("No stop here"))
    hits = pages.where("page % 3 = 1").select(F.lit(1).alias("qid"), "doc", "page")
    return grounding.adjacent_pages(hits, pages).select("doc", "page")


@query("JN-9", """
with p as (select l_orderkey as doc, l_linenumber as page from lineitem group by all), g as (select doc, min(page) as gold from p where page > 1 group by doc), x as (select doc, page, abs(page - gold) as distance from p join g using (doc) where page <> gold)
select doc, page, distance from (select *, row_number() over (partition by doc order by distance, page) as r from x) where r <= 2
""")
def nearby_negatives(t: Tables) -> DataFrame:
    pages = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page")).distinct()
    gold = pages.where("page > 1").groupBy("doc").agg(F.min("page").alias("page")).withColumn("qid", F.col("doc"))
    return mldata.nearby_negatives(gold, pages).select("doc", "page", "distance")


@query("ML-1 ML-2 ML-3", """
with k as (select distinct c_nationkey as g from customer), o as (select g, row_number() over (order by sha256('7:' || g)) as r, count(*) over () as n from k)
select c_custkey, case when r <= greatest(1, least(round_even(n * 0.2, 0), n - 1)) then 'dev' else 'train' end as split from customer join o on g = c_nationkey
""")
def group_split(t: Tables) -> DataFrame:
    return mldata.hash_split(t.customer.select("c_custkey", "c_nationkey"), 0.2, key="c_nationkey").select("c_custkey", "split")


@query("ML-1", """
with o as (select o_orderkey, row_number() over (order by sha256('7:' || o_orderkey)) as r, count(*) over () as n from orders)
select o_orderkey, case when r <= round_even(n * 0.1, 0) then 'dev' else 'train' end as split from o
""")
def hash_split(t: Tables) -> DataFrame:
    return mldata.hash_split(t.orders.select("o_orderkey"), 0.1, key="o_orderkey")


@query("ML-9", """
select l_orderkey, l_linenumber, case when l_linenumber = 1 then 'reviewed' when l_linenumber = 2 then 'soft' when l_linenumber = 3 then 'sidecar' else 'legacy' end as source, case when l_linenumber = 1 then 3.0 when l_linenumber = 2 then 1.5 when l_linenumber = 3 then 0.35 else 0.2 end as weight from lineitem
""", doubles="weight")
def supervision(t: Tables) -> DataFrame:
    some = lambda k: F.when(F.col("l_linenumber") == k, F.array(F.lit("p"))).otherwise(F.array().cast("array<string>"))
    label = mldata.supervision(some(1), some(2), some(3), F.array(F.lit("q")))
    return t.lineitem.select("l_orderkey", "l_linenumber", label["source"].alias("source"), label["weight"].alias("weight"))


@query("SET-2 SET-4", """
with p as (select l_orderkey as k, list(distinct l_partkey) as a, list(distinct l_suppkey) as b from lineitem group by 1)
select k, len(list_intersect(a, b)) as common, len(a) - len(list_intersect(a, b)) as only_a, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) as jaccard from p
""")
def set_algebra(t: Tables) -> DataFrame:
    p = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_partkey").alias("a"), F.collect_set("l_suppkey").alias("b"))
    return p.select("k", F.size(F.array_intersect("a", "b")).cast("long").alias("common"), F.size(F.array_except("a", "b")).cast("long").alias("only_a"), F.round(ranking.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query("JN-10", """
with p as (select o_custkey as k, o_orderkey as id, o_orderstatus as s, row_number() over (partition by o_custkey order by o_orderkey) as pos from orders), x as (select a.k, a.id as a, b.id as b, row_number() over (partition by a.k order by a.pos, b.pos) as r from p a join p b on a.k = b.k and a.pos < b.pos and b.pos <= 8 and a.s <> b.s)
select k, a, b from x where r <= 3
""")
def conflicts(t: Tables) -> DataFrame:
    top = ranking.best_per(t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s")), ["k"], [F.asc("id")], 8)
    a, b = top.toDF("k", "a", "sa", "pa"), top.toDF("k", "b", "sb", "pb")
    return ranking.best_per(a.join(b, "k").where("pa < pb and sa <> sb"), ["k"], [F.asc("pa"), F.asc("pb")], 3).select("k", "a", "b")


@query("TXT-2", """
select s_suppkey, n_name, regexp_matches(s_name, '[0-9]') as digits from supplier join nation on s_nationkey = n_nationkey
""")
def supplier_pages(t: Tables) -> DataFrame:
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select("s_suppkey", "n_name", T.any_match(F.col("s_name"), ["[0-9]"]).alias("digits"))
