"""Closed-world registries, joins on attributes, merges, and upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions import text as T

WITH_PAGES, WITHOUT_PAGES, LEAST_CONFIDENCE = 0.98, 0.82, 0.85


def field_values(entities: DataFrame, id_col: str, doc_col: str, fields: list[str], pages_col: str | None = None) -> DataFrame:
    """Long table id, doc, field, value, confidence of the fields that aren't blank."""
    pages = F.col(pages_col) if pages_col else F.array().cast("array<string>")
    rows = entities.select(F.col(id_col).alias("id"), F.col(doc_col).alias("doc"), pages.alias("pages"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("e"))
    sure = F.when(F.size("pages") > 0, WITH_PAGES).otherwise(WITHOUT_PAGES)
    return rows.select("id", "doc", "e.field", "e.value", "pages", sure.alias("confidence")).where(F.trim("value") != "")


def lookup(questions: DataFrame, values: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """qid, value: of ``questions(qid, field, ids)`` the value of the first id, in
    order, that has the field with enough confidence; null if none has."""
    asked = questions.select("qid", "field", F.posexplode("ids").alias("pos", "id"))
    found = asked.join(values.where(F.col("confidence") >= least), ["id", "field"])
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("pos", "value"))).where("place = 1")
    return questions.select("qid", "field").join(best.select("qid", F.col("id").alias("found_id"), "value", "confidence"), "qid", "left")


def shared_values(values: DataFrame, groups: DataFrame) -> DataFrame:
    """gid, field, value that all documents of ``groups(gid, doc)`` have."""
    members = groups.select("gid", "doc").distinct()
    size = members.groupBy("gid").agg(F.count(F.lit(1)).alias("n"))
    held = members.join(values.select("doc", "field", "value").distinct(), "doc").groupBy("gid", "field", "value").agg(F.count(F.lit(1)).alias("m"))
    return held.join(size, "gid").where("m = n").select("gid", "field", "value")


def compare_first_last(values: DataFrame, by: str, label: Column, date: Column) -> DataFrame:
    """Earliest and latest label of each group by date; ties by label."""
    rows = values.select(by, label.alias("label"), date.alias("date")).where("date is not null")
    key = F.struct("date", "label")
    return rows.groupBy(by).agg(F.min(key).alias("a"), F.max(key).alias("z")).select(by, F.col("a.label").alias("first_label"), F.col("a.date").alias("first_date"), F.col("z.label").alias("last_label"), F.col("z.date").alias("last_date"))


def merge_later_wins(tables: list[DataFrame], key: str) -> DataFrame:
    """One row for each key: that of the last table that has it."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn("_at", F.lit(i)) for i, t in enumerate(tables)])
    return union.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_at")))).where("_n = 1").drop("_at", "_n")


def alias_clusters(names: DataFrame, kind: str, name: str, source: str) -> DataFrame:
    """kind, key, aliases and sources of names that normalise alike, sorted."""
    return names.groupBy(F.col(kind).alias("kind"), T.lookup_key(F.col(name)).alias("key")).agg(F.array_sort(F.collect_set(name)).alias("aliases"), F.array_sort(F.collect_set(source)).alias("sources"))


def override(base: DataFrame, overrides: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``base`` with the non-empty values of ``overrides``."""
    other = overrides.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    return base.join(other, key, "left").withColumns({f: F.coalesce(F.nullif(F.trim(f"_{f}"), F.lit("")), F.col(f)) for f in fields}).drop(*[f"_{f}" for f in fields])


def dedupe_facts(facts: DataFrame) -> DataFrame:
    """kind, text, pages: facts (kind, text, pages) equal but for case, merged."""
    return facts.groupBy("kind", F.lower("text").alias("key")).agg(F.min("text").alias("text"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages")).drop("key")


def last_by_position(rows: DataFrame, key: list[str], pos: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(pos)))).where("_n = 1").drop("_n")


def point_in_time(records: DataFrame, references: DataFrame, key: str, start: str, end: str, ref: str) -> DataFrame:
    """Status of each reference date: in force from ``start`` up to ``end``."""
    both = references.join(records, key)
    status = F.when(F.col(start).isNull(), "unknown").when(F.col(ref) < F.col(start), "not_yet").when(F.col(end).isNull() | (F.col(ref) < F.col(end)), "in_force").otherwise("ended")
    return both.withColumn("status", status)


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """``left`` with the value of the latest ``right`` row not after it.

    One sort of the union and a running last value: rows of a key aren't paired.
    """
    a = left.withColumns({"_t": F.col(left_time), "_side": F.lit(1), "_value": F.lit(None).cast(right.schema[value].dataType)})
    b = right.select(key, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_value"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_t", "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn(value, F.last("_value", ignorenulls=True).over(w))
    return filled.where("_side = 1").drop("_t", "_side", "_value")


def upsert(base: DataFrame, delta: DataFrame, key: str | list[str]) -> DataFrame:
    """``base`` with the rows of ``delta`` in place of those with their keys.

    The last of equal keys in ``delta`` isn't defined; it must have none.
    """
    return base.join(delta.select(key).distinct(), key, "left_anti").unionByName(delta, allowMissingColumns=True)


def delete(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key).distinct(), key, "left_anti")


def delete_stale(base: DataFrame, keep: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of the keys in ``keep(key, version)`` with another version go."""
    kept = keep.select(key, F.col(version).alias("_keep"))
    return base.join(kept, key, "left").where(F.col("_keep").isNull() | (F.col(version) == F.col("_keep"))).drop("_keep")


def change_plan(manifest: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """key, status: unchanged, changed, new or deleted, by the content's hash."""
    a, b = manifest.select(F.col(key).alias("_a"), F.col(digest).alias("_da")), current.select(F.col(key).alias("_b"), F.col(digest).alias("_db"))
    both = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    status = F.when(F.col("_b").isNull(), "deleted").when(F.col("_a").isNull(), "new").when(F.col("_da").eqNullSafe(F.col("_db")), "unchanged").otherwise("changed")
    return both.select(F.coalesce("_a", "_b").alias(key), status.alias("status"))
