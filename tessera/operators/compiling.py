"""Typed records of documents out of their pages, with the pages that told each field.

Rules in several passes read every page; a field's value is that of the last pass
that found one, from its first page. What the rules found on a page goes with it to its
document, which is put together where its pages met: one shuffle, and no join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.classify import first_rule

DATE = r"[0-9]{1,2} [A-Z][a-z]+ [0-9]{4}"
CASE = r"[A-Z]{2,6} [0-9]{1,4}/[0-9]{4}"
NAME = r"[A-Z][\w'-]+(?: [A-Z][\w'-]+)*"
#: Types by what a title, or any page, says; the first that holds.
TYPES = (
    ("practice_direction", r"practice direction", r"practice direction"),
    ("enactment_notice", r"enactment notice", r"enactment notice"),
    ("amendment", r"amendment law|\bamends\b", None),
    ("case", r"[a-z]{2,6} [0-9]{1,4}/[0-9]{4}", None),
    ("law", r"\b(law|act|code|regulations?|schedule)\b", None),
    ("order", r"\border\b", r"it is hereby ordered"),
)


@dataclass(frozen=True)
class Rule:
    """A field of records of ``types`` (None: all): group 1 of ``pattern``. ``many``
    fields keep all distinct values in order."""

    field: str
    pattern: str
    types: tuple[str, ...] | None = None
    many: bool = False


LAWS, ORDERS = ("law", "amendment"), ("order", "enactment_notice", "practice_direction")
#: Passes, the later ones more to be trusted.
PASSES: tuple[tuple[Rule, ...], ...] = (
    (
        Rule("number", r"Law No\.? ?([0-9]+)", LAWS), Rule("year", r"Law No\.? ?[0-9]+ of ([0-9]{4})", LAWS), Rule("number", f"({CASE})", ("case", *ORDERS)),
        Rule("date", f"({DATE})"), Rule("issued_by", r"(?i)issued by:? ([^\n.]+)", (*LAWS, *ORDERS)),
        Rule("judges", f"(?:Justice|Judge|Registrar) ({NAME})", ("case", "order"), True), Rule("cites", f"({CASE})", None, True), Rule("amends", r"(?i)amends (?:the )?([^\n.]+)", ("amendment",), True),
        Rule("parties", r"(?:Claimant|Respondent|Appellant|Appellee): ([^\n]+)", ("case",), True),
    ),
    (
        Rule("date", f"(?i:comes? into force on|commencement:?|dated) ({DATE})"), Rule("issued_by", r"(?i)enacted by (.+?) on ", LAWS),
        Rule("outcome", r"(?i)ordered that ([^\n.]+)", ("case", "order")), Rule("short_title", r"(?i)may be cited as (?:the )?([^\n.]+)", LAWS),
    ),
    (Rule("number", r"Corrected number: ([^\n]+)"), Rule("date", f"Corrected date: ({DATE})")),
)


def object_type(title: Column, pages: Column) -> Column:
    """The first type whose pattern the title, or, where it has one for these, the
    joined pages hold; else ``other``."""
    low, all_ = F.lower(title), F.lower(pages)
    return first_rule([(low.rlike(t) | all_.rlike(p) if p else low.rlike(t), name) for name, t, p in TYPES], "other")


def compile_records(pages: DataFrame, passes: tuple[tuple[Rule, ...], ...] = PASSES) -> DataFrame:
    """doc, type, title, n_pages, fields (map of name to value, pass and pages) and lists
    (map of name to an array of value and pages).

    ``pages`` has doc, page and text. The title is the first line with letters of the
    first page. Null pages tell nothing but count; a document that no rule tells about
    has empty maps. A field's pages are those where its pass found that value.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"\p{L}"))
    marks = [F.bool_or(F.coalesce(F.lower("text").rlike(p), F.lit(False))).alias(f"_{name}") for name, _, p in TYPES if p]
    rules = [(n, r) for n, each in enumerate(passes) for r in each]
    of = lambda c, values: F.get(F.array(*[F.lit(v) for v in values]), c)
    # what a page tells is small and goes with it to its document, by the number of the rule
    told = [F.transform(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(1)), lambda x, at: F.struct(F.lit(k).alias("rule"), F.col("page"), at.alias("pos"), F.trim(x).alias("value"))) for k, (_, r) in enumerate(rules)]
    told = F.filter(F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<struct<rule:int,page:bigint,pos:int,value:string>>")) for x in told])), lambda x: x["value"] != "")
    docs = pages.select("doc", F.col("page").cast("long").alias("page"), "text").select("doc", "page", "text", told.alias("_told"))
    docs = docs.groupBy("doc").agg(F.min_by(F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")), "page").alias("title"), F.count(F.lit(1)).alias("n_pages"), *marks, F.flatten(F.collect_list("_told")).alias("_told"))
    low = F.lower("title")
    kind = first_rule([(low.rlike(t) | F.col(f"_{name}") if p else low.rlike(t), name) for name, t, p in TYPES], "other")

    # all further groups are of one document, so its rows stay where they are
    own = ["doc", "type", "title", "n_pages"]
    found = docs.select("doc", kind.alias("type"), "title", "n_pages", "_told").select(*own, F.explode_outer("_told").alias("x"))
    allowed = first_rule([((F.col("x.rule") == k) & ~F.col("type").isin(*r.types), False) for k, (_, r) in enumerate(rules) if r.types], True)
    found = found.withColumn("x", F.when(allowed, F.col("x"))).select(*own, "x.page", "x.pos", "x.value", of(F.col("x.rule"), [r.field for _, r in rules]).alias("field"), of(F.col("x.rule"), [r.many for _, r in rules]).alias("many"), of(F.col("x.rule"), [0 if r.many else -n for n, r in rules]).alias("late"))
    each = found.groupBy(*own, "field", "many", "late", "value").agg(F.min(F.struct("page", "pos")).alias("at"), F.array_sort(F.collect_set("page")).alias("pages"))
    each = each.groupBy(*own, "field", "many").agg(F.min(F.struct("late", "at", "value", "pages")).alias("x"), F.array_sort(F.collect_list(F.when(F.col("many"), F.struct("at", "value", "pages")))).alias("all"))
    one = F.when(~F.col("many"), F.struct("field", F.struct("x.value", (-F.col("x.late")).alias("pass"), "x.pages")))
    many = F.when(F.col("many"), F.struct("field", F.transform("all", lambda x: F.struct(x["value"].alias("value"), x["pages"].alias("pages")))))
    return each.groupBy(*own).agg(F.map_from_entries(F.array_sort(F.collect_list(one))).alias("fields"), F.map_from_entries(F.array_sort(F.collect_list(many))).alias("lists"))


def field_pages(values: DataFrame, pages: DataFrame, fallback: tuple[str, ...] = ("title", "number")) -> DataFrame:
    """doc, field, value and pages: those of the document whose text has the value, in
    any case and with any white space between its words; for ``fallback`` fields that no
    page has, its first page. Null and empty values have no row.

    ``values`` has doc, field and value, ``pages`` doc, page and text; a document's own
    pages are the only ones that are read for it.
    """
    flat = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    wanted = values.where(F.trim("value") != "").select("doc", "field", "value").distinct()
    rows = wanted.join(pages.select("doc", "page", flat(F.col("text")).alias("_text")), "doc", "left")
    held = rows.groupBy("doc", "field", "value").agg(F.array_sort(F.collect_set(F.when(F.contains("_text", flat(F.col("value"))), F.col("page")))).alias("pages"), F.min("page").alias("_first"))
    first = F.when(F.col("field").isin(*fallback) & F.col("_first").isNotNull(), F.array("_first")).otherwise(F.col("pages"))
    return held.select("doc", "field", "value", F.when(F.size("pages") > 0, F.col("pages")).otherwise(first).alias("pages"))


#: Facts that records tell: kind, the types that have it, field, and how it is said.
FACTS = (
    ("law_number", ("law", "amendment"), "number", "%s is Law No. %s"),
    ("law_authority", ("law", "amendment"), "issued_by", "%s was issued by %s"),
    ("law_commencement", ("law", "amendment"), "date", "%s came into force on %s"),
    ("law_short_title", ("law", "amendment"), "short_title", "%s may be cited as %s"),
    ("amendment_target", ("amendment",), "amends", "%s amends %s"),
    ("case_number", ("case",), "number", "%s has the case number %s"),
    ("case_judge", ("case", "order"), "judges", "%s was heard by %s"),
    ("case_party", ("case",), "parties", "%s has the party %s"),
    ("case_outcome", ("case", "order"), "outcome", "In %s it was ordered that %s"),
    ("case_date", ("case", "order", "practice_direction", "enactment_notice"), "date", "%s is dated %s"),
    ("order_authority", ("order", "practice_direction", "enactment_notice"), "issued_by", "%s was issued by %s"),
    ("citation", ("law", "amendment", "case", "order", "practice_direction", "enactment_notice", "other"), "cites", "%s refers to %s"),
)


def bridge_facts(records: DataFrame, facts: tuple = FACTS) -> DataFrame:
    """doc, kind, text and pages: a sentence for each field, or each value of a list, of
    ``compile_records`` that ``facts`` name for its type. A document's title stands for
    it, or its id where it has none."""
    name = F.when(F.col("title") != "", F.col("title")).otherwise(F.col("doc").cast("string"))
    one = F.array(F.struct(F.lit("").alias("value"), F.array().cast("array<bigint>").alias("pages")))
    none = F.slice(one, 1, 0)

    def told(kind: str, types: tuple[str, ...], field: str, form: str) -> Column:
        single = F.when(F.col("fields")[field].isNotNull(), F.array(F.struct(F.col("fields")[field]["value"].alias("value"), F.col("fields")[field]["pages"].alias("pages")))).otherwise(none)
        values = F.when(F.col("type").isin(*types), F.concat(single, F.coalesce(F.col("lists")[field], none))).otherwise(none)
        return F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), F.format_string(form, F.col("_name"), x["value"]).alias("text"), x["pages"].alias("pages")))

    return records.withColumn("_name", name).select("doc", F.inline(F.flatten(F.array(*[told(*f) for f in facts]))))
