"""Text functions, classification and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.functions import classify as C, text as T
from tessera.operators import metrics
from tessera.queries.registry import Tables, query
from tessera.sources import files

TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


@query("TXT-1 TXT-2 TXT-3 TXT-29 TXT-30", r"""
select doc_id, trim(regexp_replace(lower(t), '[^\p{L}\p{N}]+', ' ', 'g')) as key, regexp_replace(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug, substr(sha256(text), 1, 8) as hash8
from (select *, translate(translate(translate(regexp_replace(translate(text, chr(8208)||chr(8209)||chr(8210)||chr(8211)||chr(8212)||chr(8213)||chr(8722), '-------'), '[\x{200b}\x{200c}\x{200d}\x{2060}\x{feff}]', '', 'g'), chr(160), ' '), chr(8216)||chr(8217)||chr(8218)||chr(8220)||chr(8221)||chr(8222), repeat(chr(39), 3) || repeat(chr(34), 3)), chr(1632)||chr(1633)||chr(1634)||chr(1635)||chr(1636)||chr(1637)||chr(1638)||chr(1639)||chr(1640)||chr(1641), '0123456789') as t from documents)
""")
def normalize_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.lookup_key(F.col("text")).alias("key"), T.slug(F.col("source")).alias("slug"), T.short_hash(F.col("text")).alias("hash8"))


@query("TXT-16 TXT-17 TXT-15", r"""
select doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}]+')) as n_tokens, len(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) as n_distinct, regexp_extract(text, '[A-Z][a-z]+', 0) as first_word from documents
""")
def token_statistics(t: Tables) -> DataFrame:
    text = F.col("text")
    return t.documents.select("doc_id", T.token_count(text).cast("long").alias("n_tokens"), F.size(F.array_distinct(T.tokens(text))).cast("long").alias("n_distinct"), F.regexp_extract(text, "[A-Z][a-z]+", 0).alias("first_word"))


@query("TXT-10 TXT-11 TXT-12 CLS-9", r"""
with found as (select doc_id, regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+[a-z]') as mails, regexp_extract_all(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}') as ips, regexp_extract_all(text, '"([A-Z][^"]{2,80})"', 1) as terms from documents)
select doc_id, array_to_string(list_sort(list_distinct(list_concat(mails, ips))), '|') as refs, array_to_string(list_sort(list_distinct(terms)), '|') as terms from found where len(mails) + len(ips) + len(terms) > 0
""")
def citation_extract(t: Tables) -> DataFrame:
    refs = T.extract_unique(F.col("text"), r"[A-Za-z0-9._]+@[A-Za-z0-9.]+[a-z]", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}")
    rows = t.documents.select("doc_id", refs.alias("r"), T.quoted_terms(F.col("text")).alias("t")).where("size(r) + size(t) > 0")
    return rows.select("doc_id", F.array_join(F.array_sort("r"), "|").alias("refs"), F.array_join(F.array_sort("t"), "|").alias("terms"))


@query("TXT-4 TXT-5 TXT-6 TXT-13", r"""
with names as (select c_custkey, c_name, 'Dr. ' || c_name || ' CJ' as person, 'The ' || c_name || ' and Company Limited' as firm from customer)
select c_custkey, trim(regexp_replace(lower(regexp_replace(regexp_replace(person, '^(mr|mrs|ms|dr|prof|sir|justice|judge)\.?\s+', '', 'i'), '\s+(J|CJ|JA)\.?$', '')), '[^\p{L}\p{N}]+', ' ', 'g')) as person_key,
 trim(regexp_replace(lower(regexp_replace(firm, '^the\s+', '', 'i')), '[^\p{L}\p{N}]+', ' ', 'g')) as firm_key,
 case when length(ini) between 3 and 8 then ini end as acronym, c_name as left_party, 'State' as right_party
from (select *, array_to_string(list_transform(list_filter(regexp_extract_all(firm, '[A-Za-z]+'), lambda w: length(w) > 2 or w = upper(w)), lambda w: upper(substr(w, 1, 1))), '') as ini from names)
""")
def entity_keys(t: Tables) -> DataFrame:
    name = F.col("c_name")
    person, firm = F.concat(F.lit("Dr. "), name, F.lit(" CJ")), F.concat(F.lit("The "), name, F.lit(" and Company Limited"))
    sides = T.caption_parties(F.concat(name, F.lit(" (Claimant) v. State (Defendant)")))
    return t.customer.select("c_custkey", T.person_key(person).alias("person_key"), T.organisation_key(firm).alias("firm_key"), T.acronym(firm).alias("acronym"), sides[0].alias("left_party"), sides[1].alias("right_party"))


@query("TXT-7 TXT-9 FLT-2", """
select o_orderkey, 'CFI ' || lpad(cast(o_orderkey % 1000 as varchar), 3, '0') || '/' || year(o_orderdate) as plain, 'CFI ' || lpad(cast(o_orderkey % 1000 as varchar), 3, '0') || '/' || year(o_orderdate) as bracket from orders
""")
def case_numbers(t: Tables) -> DataFrame:
    n, y = (F.col("o_orderkey") % 1000).cast("string"), F.year("o_orderdate").cast("string")
    return t.orders.select("o_orderkey", T.case_number(F.concat(F.lit("See CFI "), n, F.lit(" of "), y)).alias("plain"), T.case_number(F.concat(F.lit("["), y, F.lit("] CFI "), n)).alias("bracket"))


@query("TXT-20", """
select o_orderkey, round(o_totalprice, 2) as amount, cast(null as double) as none from orders
""")
def coerce_number(t: Tables) -> DataFrame:
    text = F.concat(F.lit("USD "), F.format_number("o_totalprice", 2), F.lit(" in AB 12/2020"))
    return t.orders.select("o_orderkey", T.coerce_number(text).alias("amount"), T.coerce_number(F.lit("see AB 12/2020")).alias("none"))


@query("TXT-21", """
select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as iso, strftime(o_orderdate, '%Y-%m-%d') as long_form, strftime(o_orderdate, '%Y-%m-%d') as slash from orders
""")
def coerce_date(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", T.coerce_date(F.concat(F.lit("on "), F.date_format(d, "yyyy-MM-dd"), F.lit(" or 1/2/2030"))).alias("iso"), T.coerce_date(F.concat(F.lit("dated "), F.date_format(d, "d MMMM yyyy"))).alias("long_form"), T.coerce_date(F.date_format(d, "d/M/yyyy")).alias("slash"))


@query("TXT-22 TXT-23 TXT-32", """
select n_nationkey, n_name || '|' || r_name as names, case when n_nationkey % 2 = 0 then true else false end as flag, cast(n_nationkey as double) as num
from nation join region on n_regionkey = r_regionkey
""")
def coerce_names(t: Tables) -> DataFrame:
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.concat("n_name", F.lit(", "), F.lower("n_name"), F.lit(" and "), "r_name", F.lit("; "), "n_name")
    flag = T.coerce_answer(F.lit("boolean"), F.when(F.col("n_nationkey") % 2 == 0, "Yes, it is").otherwise("no"))["bool_v"]
    number = T.coerce_answer(F.lit("number"), F.concat(F.lit("it is "), F.col("n_nationkey").cast("string")))["num_v"]
    return rows.select("n_nationkey", F.array_join(T.coerce_names(text), "|").alias("names"), flag.alias("flag"), number.alias("num"))


@query("TXT-24 TXT-28", r"""
with a as (select conv_id, turn, case when turn % 5 = 0 then 'N/A' when turn % 5 = 1 then 'I do not know that' else text end as answer from conversations)
select conv_id, turn, lower(trim(answer)) in ('', 'n/a', 'na', 'none', 'null', 'unknown', 'not found', 'no answer') or regexp_matches(lower(trim(answer)), '^(i (do not|don''t) know|cannot be determined|there is no information)') as unanswerable from a
""")
def unanswerable(t: Tables) -> DataFrame:
    answer = F.when(F.col("turn") % 5 == 0, "N/A").when(F.col("turn") % 5 == 1, "I do not know that").otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", T.unanswerable(answer).alias("unanswerable"))


@query("TXT-25 TXT-26 TXT-27 SET-3", """
select l_orderkey, l_linenumber, l_partkey || ':' || l_linenumber || ':x' as cited, 'ok' as rest, l_partkey || '_' || (l_linenumber + 1) as page, cast(l_partkey as varchar) as doc, l_linenumber + 1 as page_no, true as subset from lineitem
""")
def cited_pages(t: Tables) -> DataFrame:
    chunk = F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string"), F.lit("x"))
    answer = F.concat(F.lit("ok (cite: "), chunk, F.lit(", "), chunk, F.lit(")"))
    ids, page = T.cited_ids(answer), T.page_of_chunk(chunk)
    where = T.split_page_id(page)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.array_join(ids, ",").alias("cited"), T.strip_citations(answer).alias("rest"), page.alias("page"), where["doc"].alias("doc"), where["page"].alias("page_no"), (F.size(F.array_except(ids, F.array(chunk))) == 0).alias("subset"))


@query("TXT-33 TXT-34", """
select event_id, cast(json_extract(props, '$.k') as bigint) as k from events
""")
def json_from_text(t: Tables) -> DataFrame:
    noisy = F.concat(F.lit("Here: ```json\n"), F.col("props"), F.lit("\n``` done"))
    return t.events.select("event_id", F.get_json_object(T.json_in(noisy), "$.k").cast("long").alias("k"))


@query("TXT-18 TXT-19 TXT-31", r"""
select doc_id, len(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')) as n_sentences,
 case when length(text) <= 80 then text else regexp_replace(substr(text, 1, 80), '\s+\S*$', '') end as teaser, source || ' | ' || lang as search_text from documents
""")
def sentences_and_teasers(t: Tables) -> DataFrame:
    text = F.col("text")
    return t.documents.select("doc_id", F.size(T.sentences(text)).cast("long").alias("n_sentences"), T.truncate_words(text, 80).alias("teaser"), T.search_text(F.col("source"), F.lit(" "), F.col("lang")).alias("search_text"))


@query("SRC-8 CLS-6 AG-35", r"""
with l as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as ls, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as raw from documents), t as (select *, ls[1:6] as top from l)
select doc_id, coalesce(list_filter(ls, lambda x: regexp_matches(x, '\p{L}') and length(x) <= 200)[1], 'doc ' || doc_id) as title, len(top) as n_lines,
 len(list_filter(top, lambda x: length(x) <= 60 and not regexp_matches(x, '[.!?]$'))) > 0 as has_heading, len(raw) - len(list_distinct(raw)) as duplicate_lines from t
""")
def page_top_structure(t: Tables) -> DataFrame:
    text, top = F.col("text"), C.page_top(F.col("text"))
    return t.documents.select("doc_id", files.title(text, F.concat(F.lit("doc "), F.col("doc_id").cast("string"))).alias("title"), top["n_lines"].cast("long").alias("n_lines"), top["has_heading"].alias("has_heading"), metrics.text_noise(text).cast("long").alias("duplicate_lines"))


PATTERNS = [("english", r"(?:^|[^\p{L}])(?:the|of|and)(?:[^\p{L}]|$)"), ("french", r"(?:^|[^\p{L}])(?:de|la|les)(?:[^\p{L}]|$)"), ("german", r"(?:^|[^\p{L}])(?:der|die|und)(?:[^\p{L}]|$)")]


@query("CLS-1 CLS-2", r"""
with c as (select doc_id, source, len(regexp_extract_all(text, '(?:^|[^\p{L}])(?:the|of|and)(?:[^\p{L}]|$)')) as e, len(regexp_extract_all(text, '(?:^|[^\p{L}])(?:de|la|les)(?:[^\p{L}]|$)')) as f, len(regexp_extract_all(text, '(?:^|[^\p{L}])(?:der|die|und)(?:[^\p{L}]|$)')) as g from documents)
select doc_id, case when e = greatest(e, f, g) and greatest(e, f, g) >= 2 then 'english' when f = greatest(e, f, g) and greatest(e, f, g) >= 2 then 'french' when g = greatest(e, f, g) and greatest(e, f, g) >= 2 then 'german' else 'other' end as kind,
 case when regexp_matches(source, '[05]$') then 'north' when regexp_matches(source, '[16]$') then 'south' else 'none' end as region from c
""")
def doc_type_vote(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", C.by_most_matches(F.col("text"), PATTERNS).alias("kind"), C.by_mention(F.col("source"), [("[05]$", "north"), ("[16]$", "south")], "none").alias("region"))


@query("AG-27 AG-28", r"""
with r as (select doc_id, length(text) < 100 as short, regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+[a-z]') as mail, regexp_matches(text, '(AKIA[0-9A-Z]{8}|sk-[A-Za-z0-9]{8}|ghp_[A-Za-z0-9]{8}|api_key)') as secret,
 case when length(text) > 0 then (length(text) - length(regexp_replace(text, '[\p{L}]', '', 'g'))) / length(text) else 0.0 end as letters from documents)
select doc_id, array_to_string(list_filter([case when short then 'short' end, case when mail then 'contact' end, case when secret then 'secret' end, case when letters < 0.7 then 'symbols' end], lambda x: x is not null), ',') as reasons,
 (case when short then 2.0 else 0.0 end) + (case when mail then 3.0 else 0.0 end) + (case when secret then 8.0 else 0.0 end) + (case when letters < 0.7 then 4.0 else 0.0 end) as score, round(letters, 6) as letters from r
""", doubles="score")
def anomaly_score(t: Tables) -> DataFrame:
    text = F.col("text")
    letters = T.char_ratio(text, r"[\p{L}]")
    secret = T.any_match(text, ["AKIA[0-9A-Z]{8}", "sk-[A-Za-z0-9]{8}", "ghp_[A-Za-z0-9]{8}", "api_key"])
    names, score = C.weighted_reasons([("short", F.length(text) < 100, 2.0), ("contact", text.rlike(r"[A-Za-z0-9._]+@[A-Za-z0-9.]+[a-z]"), 3.0), ("secret", secret, 8.0), ("symbols", letters < 0.7, 4.0)])
    return t.documents.select("doc_id", F.array_join(names, ",").alias("reasons"), score.alias("score"), F.round(letters, 6).alias("letters"))


@query("CLS-8", r"""
select conv_id, turn, length(text) > 150 or len(regexp_extract_all(text, '\b(?:compare|difference|between|both|and)\b')) >= 2 or len(regexp_extract_all(text, '[A-Z][a-z]+ [A-Z][a-z]+')) >= 2 or regexp_matches(text, '\?.*\?') as complex from conversations
""")
def query_complexity(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", C.is_complex(F.col("text"), r"\b(?:compare|difference|between|both|and)\b", "[A-Z][a-z]+ [A-Z][a-z]+", r"\?.*\?").alias("complex"))


@query("CLS-14", r"""
select doc_id, len(list_filter(regexp_extract_all(lower(text), '(?s).{0,48}\bthe\b.{0,24}'), lambda w: not regexp_matches(w, '\b(no|not|never|without|neither|nor)\b'))) > 0 as mentioned from documents
""")
def premise_guard(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", C.unnegated_mention(F.col("text"), "the").alias("mentioned"))


@query("SRC-4", r"""
select doc_id, length(text) >= 400 and len(string_split_regex(trim(text), '\s+')) >= 80 as sufficient from documents
""")
def text_sufficiency(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", files.sufficient(F.col("text")).alias("sufficient"))


@query("AG-15", """
select event_id, round(case when s < 1 then 1.05 when s < 2 then 1.02 when s <= 3 then 1.0 when s >= 5 then 0.85 else 0.99 - (s - 3) * 0.07 end, 6) as factor from (select event_id, value / 20 as s from events)
""")
def latency_factor(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(C.interval_factor(F.col("value") / 20), 6).alias("factor"))
