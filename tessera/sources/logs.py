"""Logs and reports whose records span lines.

A record begins where a line matches its format's start pattern and holds all lines up
to the next one, also where Spark cuts the file in between: each part of a file counts
its own starts, and the counts of the parts before say which record its first lines
belong to. Nothing is gathered but a record.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


@dataclass(frozen=True)
class Format:
    """``fields``: name -> (type, sources), the first source that gives a value wins: a
    JSON path ($.a.b) or a pattern with one group. A record without one of
    ``required`` is told as cut off, and one that ought to be JSON and isn't as that."""

    start: str
    fields: dict[str, tuple[str, tuple[str, ...]]] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    json: bool = False


NUMBER = r"([-+]?[0-9]*\.?[0-9]+)"
FORMATS = {
    "evaluation": Format(r"^\{", {"total_cases": ("int", ("$.summary.total_cases", "$.summary.matched_count", "$.summary.golden_count")), "grounding": ("double", ("$.summary.overall_grounding_f_beta", "$.summary.grounding_fbeta", "$.summary.g_score")), "exact": ("double", ("$.summary.overall_exact_match_rate", "$.summary.exact_match_rate", "$.summary.det_pct")), "ttft_p50": ("double", ("$.summary.ttft_p50_ms",))}, ("total_cases",), True),
    "matrix": Format(r"^\{", {"team": ("string", ("$.leaderboard_summary.team_name", "$.summary.team")), "rank": ("int", ("$.leaderboard_summary.rank",)), "s": ("double", ("$.leaderboard_summary.s", "$.summary.current_s")), "g": ("double", ("$.leaderboard_summary.g", "$.summary.current_g")), "submissions": ("int", ("$.leaderboard_summary.submissions",))}, ("team",), True),
    "benchmark": Format(r"^# ", {"title": ("string", (r"^# ([^\n]+)",)), "f_beta": ("double", (rf"(?i)f[_ -]?beta[^0-9\n]*{NUMBER}",)), "orphan_rate": ("double", (rf"(?i)orphan[^0-9\n]*{NUMBER}",)), "slot_recall": ("double", (rf"(?i)slot[_ ]recall[^0-9\n]*{NUMBER}",)), "cases": ("int", (r"(?i)cases[^0-9\n]*([0-9]+)",))}, ("f_beta", "cases")),
    "judge": Format(r"^\{", {"case_id": ("string", ("$.case_id",)), "verdict": ("string", ("$.judge_result.verdict",)), "accuracy": ("double", ("$.judge_result.scores.accuracy",)), "grounding": ("double", ("$.judge_result.scores.grounding",))}, ("case_id", "verdict"), True),
    "team": Format(r"^\[?[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:]{5,8}", {"at": ("string", (r"^\[?([0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:]{5,8})",)), "level": ("string", (r"^\S+ ?\S*? (DEBUG|INFO|WARN|ERROR)\b",)), "agent": ("string", (r"\bagent=(\S+)",)), "message": ("string", (r"(?:DEBUG|INFO|WARN|ERROR)\s+([^\n]+)",))}, ("level",)),
}


def records(spark: SparkSession, path: str, start: str) -> DataFrame:
    """file, record (from 1 in each file) and text of the records of the files at
    ``path``. What stands before a file's first record is its record 0."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at"), "value")
    lines = lines.withColumn("own", F.sum(F.when(F.col("value").rlike(start), 1).otherwise(0)).over(Window.partitionBy("file", "part").orderBy("at")))
    counts = lines.groupBy("file", "part").agg(F.max("own").alias("n"))
    counts = counts.select("file", "part", (F.sum("n").over(Window.partitionBy("file").orderBy("part")) - F.col("n")).alias("before"))
    held = lines.join(counts, ["file", "part"]).groupBy("file", (F.col("before") + F.col("own")).alias("record"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "at", "value"))), lambda x: x["value"]), "\n")
    return held.agg(text.alias("text"))


def _value(sources: tuple[str, ...], kind: str) -> Column:
    found = [F.get_json_object("text", s) if s.startswith("$") else F.nullif(F.regexp_extract("text", s, 1), F.lit("")) for s in sources]
    return F.coalesce(*found).try_cast(kind)


def parsed(rows: DataFrame, form: Format) -> DataFrame:
    """``rows`` (text, ...) with the format's fields and ``error``: null, ``no start``
    for text before a file's first record, ``not JSON``, or ``cut off``."""
    out = rows.withColumns({name: _value(sources, kind) for name, (kind, sources) in form.fields.items()})
    missing = F.lit(False)
    for name in form.required:
        missing = missing | F.col(name).isNull()
    broken = F.expr("try_parse_json(text) is null") if form.json else F.lit(False)
    return out.withColumn("error", F.when(~F.col("text").rlike(form.start), "no start").when(broken, "not JSON").when(missing, "cut off"))


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """file, record, text, the fields of format ``name`` and error."""
    return parsed(records(spark, path, FORMATS[name].start), FORMATS[name])
