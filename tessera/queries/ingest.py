"""Files, manifests, compiled records and logs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.functions import text as T
from tessera.operators import compiling, registry
from tessera.queries.registry import Tables, query
from tessera.session import scratch_path
from tessera.sources import files, folders, logs, manifest, pdf

LINE = r"[^\p{L}\p{N}.,;:!?]+"


def as_pdf(t: Tables) -> DataFrame:
    """Every document as a PDF file of 50 lines a page; one in three writes its lines
    from the last to the first, each at its own place."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, LINE, " "))), lambda x: x != "")
    rows = t.documents.select("doc_id", lines.alias("lines"))

    def write(batches):
        for batch in batches:
            files = []
            for number, found in zip(batch.column("doc_id").to_pylist(), batch.column("lines").to_pylist()):
                pages = [[(50, 760 - 14 * k, line) for k, line in enumerate(found[a : a + 50])] for a in range(0, len(found), 50)]
                files.append(pdf.document([p[::-1] if number % 3 == 0 else p for p in pages]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(["pdf"] * len(files), pa.string()), pa.array(files, pa.binary())], ["doc_id", "suffix", "content"])

    return rows.mapInArrow(write, "doc_id long, suffix string, content binary")


@query("SRC-2 SRC-4", r"""
with l as (select doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '[^\p{L}\p{N}.,;:!?]+', ' ', 'g'))), lambda x: x <> '') as lines from documents),
p as (select doc_id, lines, list_transform(range((len(lines) + 49) // 50), lambda k: lines[50 * k + 1 : 50 * k + 50]) as pages from l),
f as (select *, array_to_string(list_transform(pages, lambda p: array_to_string(case when doc_id % 3 = 0 then list_reverse(p) else p end, chr(10))), chr(10) || chr(10)) as fast, array_to_string(list_transform(pages, lambda p: array_to_string(p, chr(10))), chr(10) || chr(10)) as layout from p),
e as (select *, (length(fast) >= 400 or len(regexp_extract_all(fast, '\S+')) >= 80) and length(regexp_replace(fast, '[^\p{L}\p{N}]', '', 'g')) >= 0.2 * length(fast) as enough from f)
select doc_id, len(pages) as n_pages, case when enough then 'stream' when len(lines) > 0 then 'layout' else 'none' end as read, md5(case when enough then fast else layout end) as digest from e
""")
def pdf_documents(t: Tables) -> DataFrame:
    """Written as PDF files and read back, those short of text by their layout."""
    return folders.parsed(as_pdf(t)).select("doc_id", F.size("pages").cast("long").alias("n_pages"), "read", F.md5("text").alias("digest"))


@query("INC-3 INC-1", """
with c as (select doc_id, doc_id % 2 = 0 as old, doc_id % 10 = 0 as edited from documents),
s as (select doc_id, old, edited, unnest(['same', 'ingest', 'schema', 'missing', 'after_a_lost_run', 'again']) as run from c)
select run, case run when 'ingest' then 'ingest' when 'schema' then 'schema' when 'missing' then 'missing' else 'ok' end as state, case when run in ('ingest', 'schema', 'missing') or run <> 'again' and not old then 'new' when run <> 'again' and edited then 'changed' else 'unchanged' end as status, count(*) as n from s group by all
""")
def guarded_manifest(t: Tables) -> DataFrame:
    """What is to be ingested by a manifest of half the documents, one in ten of them
    edited since: under the same versions, under others, without one, after a run that
    died while writing, and after the next commit."""
    spark, path, schema = t.spark, scratch_path(t.spark, "manifest"), "doc_id long, digest string"
    now = t.documents.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    old = now.where("doc_id % 2 = 0").withColumn("digest", F.when(F.col("doc_id") % 10 == 0, "edited since").otherwise(F.col("digest")))
    runs: list[tuple[str, DataFrame, str]] = []

    def planned(run: str, where: str, *versions) -> None:
        held, state, _ = manifest.load(spark, where, schema, *versions)
        runs.append((run, registry.change_plan(held, now, "doc_id", "digest"), state))

    first = manifest.save(old, path, 2, "a")
    planned("same", path, 2, "a")
    planned("ingest", path, 2, "b")
    planned("schema", path, 3, "a")
    planned("missing", scratch_path(spark, "manifest"), 2, "a")
    now.limit(1).write.parquet(f"{path}/versions/lost")
    planned("after_a_lost_run", path, 2, "a")
    manifest.save(now, path, 2, "a", after=first)
    planned("again", path, 2, "a")
    parts = [plan.groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(F.lit(run).alias("run"), F.lit(state).alias("state"), "status", "n") for run, plan, state in runs]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("ST-10", r"""
select conv_id, turn, case when conv_id % 7 > 0 then role end as role, case when conv_id % 7 = 0 then 'cut off' end as error, md5('[' || conv_id || ':' || turn || '] ' || case when conv_id % 7 > 0 then 'role=' || role else '' end || chr(10) || coalesce(text, '')) as digest from conversations
""")
def log_records(t: Tables) -> DataFrame:
    """Conversations as log files whose records span lines, written and read back; one
    in seven lacks its role."""
    path = scratch_path(t.spark, "log")
    head = F.concat(F.lit("["), "conv_id", F.lit(":"), "turn", F.lit("] "), F.when(F.col("conv_id") % 7 > 0, F.concat(F.lit("role="), "role")).otherwise(""))
    t.conversations.select(F.concat(head, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("value")).write.option("lineSep", "\n").text(path)
    form = logs.Format(r"^\[[0-9]+:[0-9]+\] ", {"conv_id": ("long", (r"^\[([0-9]+):",)), "turn": ("long", (r"^\[[0-9]+:([0-9]+)\]",)), "role": ("string", (r"^[^\n]* role=(\w+)\n",))}, ("role",))
    return logs.parsed(logs.records(t.spark, path, form.start), form).select("conv_id", "turn", "role", "error", F.md5("text").alias("digest"))


def law_pages(t: Tables) -> DataFrame:
    """Three pages for each order: a law, a case, an order, a practice direction, an
    amendment or something else."""
    o = t.orders.selectExpr("o_orderkey as doc", "o_orderkey % 6 as k", "o_orderkey % 9000 + 1 as n", "o_custkey as c", "o_orderkey % 28 + 1 as d", "o_orderkey % 4 as v")
    case = "concat('ABC ', n, '/2020')"
    first = f"case k when 0 then concat('Data Law\nLaw No. ', n, ' of 2019\nIssued by: Office ', c) when 1 then concat('Smith v Jones ', {case}, '\nClaimant: Firm ', c, '\nRespondent: Firm ', c + 1) when 2 then concat('Order of the court\n', {case}, ' on ', d, ' May 2021') when 3 then concat('Directions\nThis practice direction is issued by: Registry ', c) when 4 then concat('Amendment Law\nLaw No. ', n, ' of 2020\nIt amends the Data Law. It amends the Fee Code') else concat('Notes\nplain ', c) end"
    second = "case k when 0 then concat('This may be cited as the Data Act ', n, '. It comes into force on ', d, ' March 2020') when 1 then concat('Before Justice Ann Lee and Judge Bo\nIt is ordered that the claim ', n, ' is dismissed. dated ', d, ' June 2022, see XY 7/2001') when 2 then 'It is hereby ordered that costs are paid. Justice Ann Lee' when 3 then concat('dated ', d, ' July 2020') when 4 then concat('Enacted by the Ruler ', c, ' on ', d, ' April 2021') end"
    third = "case when v = 0 then concat('Corrected number: N-', n) when v = 1 then concat('Corrected date: ', d, ' January 2023; ABC ', n, '/2020') else 'nothing' end"
    return o.selectExpr("doc", f"inline(array(named_struct('page', 1L, 'text', {first}), named_struct('page', 2L, 'text', {second}), named_struct('page', 3L, 'text', {third})))")


@query("DB-4", """
with o as (select o_orderkey as doc, o_orderkey % 6 as k, o_orderkey % 9000 + 1 as n, o_custkey as c, o_orderkey % 28 + 1 as d, o_orderkey % 4 as v from orders), y as (select *, 'ABC ' || n || '/2020' as cn from o)
select doc, ['law', 'case', 'order', 'practice_direction', 'amendment', 'other'][k + 1] as type, case when v = 0 then 'N-' || n when k in (0, 4) then cast(n as varchar) when k in (1, 2) then cn when v = 1 and k = 3 then cn end as number,
 case when v = 0 then '3' when k in (0, 4) then '1' when k = 1 then case when v = 1 then '1,3' else '1' end when k = 2 then case when v = 1 then '1,3' else '1' end when v = 1 and k = 3 then '3' end as number_pages,
 case when v = 1 then d || ' January 2023' when k = 0 then d || ' March 2020' when k = 1 then d || ' June 2022' when k = 2 then d || ' May 2021' when k = 3 then d || ' July 2020' when k = 4 then d || ' April 2021' end as date,
 case when k = 0 then 'Office ' || c when k = 3 then 'Registry ' || c when k = 4 then 'the Ruler ' || c end as issued_by, case k when 1 then 'Ann Lee|Bo' when 2 then 'Ann Lee' end as judges, case when k = 1 then 'Firm ' || c || '|Firm ' || (c + 1) end as parties,
 case k when 1 then 'the claim ' || n || ' is dismissed' when 2 then 'costs are paid' end as outcome, case when k = 4 then 'Data Law|Fee Code' end as amends, case when k = 1 then cn || '|XY 7/2001' when k = 2 or v = 1 then cn end as cites from y
""")
def compiled_records(t: Tables) -> DataFrame:
    rows = compiling.compile_records(law_pages(t))
    value = lambda f: F.col("fields")[f]["value"]
    each = lambda f: F.array_join(F.transform(F.col("lists")[f], lambda x: x["value"]), "|")
    return rows.select("doc", "type", value("number").alias("number"), F.array_join(F.col("fields")["number"]["pages"].cast("array<string>"), ",").alias("number_pages"), value("date").alias("date"), value("issued_by").alias("issued_by"), each("judges").alias("judges"), each("parties").alias("parties"), value("outcome").alias("outcome"), each("amends").alias("amends"), each("cites").alias("cites"))


@query("DB-6", """
with p as (select o_orderkey as doc, o_orderkey % 9000 + 1 as n, o_custkey as c, o_orderkey % 6 as k from orders)
select doc, 'number' as field, cast(n as varchar) as value, '1' as pages from p where k = 0
union all select doc, 'issued_by', 'OFFICE ' || c, '1' from p where k = 0 union all select doc, 'short_title', 'data   act', '2' from p where k = 0 union all select doc, 'title', 'No Such Title', '1' from p where k = 0 union all select doc, 'judge', 'Nobody Known', '' from p where k = 0
""")
def field_pages(t: Tables) -> DataFrame:
    """The pages of the laws that tell given values, some in other words' case and
    spacing, some told nowhere."""
    law = t.orders.where("o_orderkey % 6 = 0")
    told = "inline(array(named_struct('field', 'number', 'value', cast(o_orderkey % 9000 + 1 as string)), named_struct('field', 'issued_by', 'value', concat('OFFICE ', o_custkey)), named_struct('field', 'short_title', 'value', 'data   act'), named_struct('field', 'title', 'value', 'No Such Title'), named_struct('field', 'judge', 'value', 'Nobody Known'), named_struct('field', 'none', 'value', ' ')))"
    pages = law_pages(t).withColumn("text", F.when((F.col("page") == 1) | F.col("text").rlike("cited"), F.regexp_replace("text", r"(Act) [0-9]+\. .*", "$1")))
    return compiling.field_pages(law.selectExpr("o_orderkey as doc", told), pages).select("doc", "field", "value", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


@query("DB-8", """
with o as (select o_orderkey as doc, o_orderkey % 6 as k, o_orderkey % 9000 + 1 as n, o_custkey as c, o_orderkey % 28 + 1 as d, o_orderkey % 4 as v from orders), y as (select *, 'ABC ' || n || '/2020' as cn, case when v = 0 then 'N-' || n end as fixed, case when v = 1 then d || ' January 2023' end as late from o),
f as (
 select doc, 'law_number' as kind, case k when 0 then 'Data Law' else 'Amendment Law' end || ' is Law No. ' || coalesce(fixed, cast(n as varchar)) as text from y where k in (0, 4)
 union all select doc, 'law_authority', case k when 0 then 'Data Law was issued by Office ' || c else 'Amendment Law was issued by the Ruler ' || c end from y where k in (0, 4)
 union all select doc, 'law_commencement', case k when 0 then 'Data Law came into force on ' || coalesce(late, d || ' March 2020') else 'Amendment Law came into force on ' || coalesce(late, d || ' April 2021') end from y where k in (0, 4)
 union all select doc, 'law_short_title', 'Data Law may be cited as Data Act ' || n from y where k = 0
 union all select doc, 'amendment_target', 'Amendment Law amends ' || unnest(['Data Law', 'Fee Code']) from y where k = 4
 union all select doc, 'case_number', 'Smith v Jones ' || cn || ' has the case number ' || coalesce(fixed, cn) from y where k = 1
 union all select doc, 'case_judge', 'Smith v Jones ' || cn || ' was heard by ' || unnest(['Ann Lee', 'Bo']) from y where k = 1
 union all select doc, 'case_judge', 'Order of the court was heard by Ann Lee' from y where k = 2
 union all select doc, 'case_party', 'Smith v Jones ' || cn || ' has the party Firm ' || unnest([c, c + 1]) from y where k = 1
 union all select doc, 'case_outcome', 'In Smith v Jones ' || cn || ' it was ordered that the claim ' || n || ' is dismissed' from y where k = 1
 union all select doc, 'case_outcome', 'In Order of the court it was ordered that costs are paid' from y where k = 2
 union all select doc, 'case_date', case k when 1 then 'Smith v Jones ' || cn || ' is dated ' || coalesce(late, d || ' June 2022') when 2 then 'Order of the court is dated ' || coalesce(late, d || ' May 2021') else 'Directions is dated ' || coalesce(late, d || ' July 2020') end from y where k in (1, 2, 3)
 union all select doc, 'order_authority', 'Directions was issued by Registry ' || c from y where k = 3
 union all select doc, 'citation', 'Smith v Jones ' || cn || ' refers to ' || unnest([cn, 'XY 7/2001']) from y where k = 1
 union all select doc, 'citation', ['Data Law', '', 'Order of the court', 'Directions', 'Amendment Law', 'Notes'][k + 1] || ' refers to ' || cn from y where k = 2 or v = 1 and k <> 1)
select doc, kind, text from f
""")
def bridge_facts(t: Tables) -> DataFrame:
    return compiling.bridge_facts(compiling.compile_records(law_pages(t))).select("doc", "kind", "text")


@query("SRC-10", """
select conv_id, turn, role, false as bad, null as line from conversations where conv_id % 5 > 0 and role is not null
union all select null, null, null, true, md5('{"conv_id":' || conv_id || ',"turn":' || turn || ',"ro') from conversations where conv_id % 5 = 0 and role is not null
""")
def jsonl_rows(t: Tables) -> DataFrame:
    """Conversations written as JSON lines, one in five cut off, and read back."""
    path = scratch_path(t.spark, "jsonl")
    rows = t.conversations.where("role is not null")
    whole = F.to_json(F.struct("conv_id", "turn", "role"))
    cut = F.concat(F.lit('{"conv_id":'), "conv_id", F.lit(',"turn":'), "turn", F.lit(',"ro'))
    rows.select(F.when(F.col("conv_id") % 5 > 0, whole).otherwise(cut).alias("value")).write.text(path)
    good, bad = files.read_jsonl(t.spark, path, "conv_id long, turn long, role string")
    nothing = [F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role")]
    return good.select("conv_id", "turn", "role", F.lit(False).alias("bad"), F.lit(None).cast("string").alias("line")).unionByName(bad.select(*nothing, F.lit(True).alias("bad"), F.md5("value").alias("line")))


@query("SRC-12", """
select case when p_partkey % 2 = 0 then 'part ' || p_partkey else p_name end as name, case when p_partkey % 2 = 0 then 'http://x/' || p_partkey end as url, case when p_partkey % 3 > 0 then p_size * 1.0 end as score from part
""", doubles="score")
def benchmark_rows(t: Tables) -> DataFrame:
    """Parts written as CSV, half of the names as links, a third of the scores no numbers."""
    path = scratch_path(t.spark, "csv")
    name = F.when(F.col("p_partkey") % 2 == 0, F.format_string("[part %d](http://x/%d)", "p_partkey", "p_partkey")).otherwise(F.col("p_name"))
    score = F.when(F.col("p_partkey") % 3 > 0, F.concat(F.col("p_size"), F.lit("%"))).otherwise("n/a")
    t.part.select(name.alias("model"), score.alias("score")).write.csv(path, header=True)
    return files.read_benchmark_csv(t.spark, path)
