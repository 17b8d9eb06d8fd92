"""Document files, JSON, JSONL, CSV and Parquet as DataFrames, and sinks.

Files that can't be read become rows with ``error``; the rest of a folder is
not held up by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.functions import structure as S, text as T
from tessera.sources import folders
from tessera.sources.folders import SUFFIXES

LEAST_CHARS, LEAST_WORDS = 400, 80


def list_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """path, suffix, length, modified of the supported files below a folder, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{','.join(suffixes)}}}").load(folder)
    return files.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("suffix"), "length", F.col("modificationTime").alias("modified"))


def fingerprints(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """path, sha256, length, modified."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{','.join(suffixes)}}}").load(folder)
    return files.select("path", F.sha2("content", 256).alias("sha256"), "length", F.col("modificationTime").alias("modified"))


def read_documents(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """doc_id (file name), path, suffix, title, type, jurisdiction, text, pages, read,
    error of each file; see ``folders.parsed``."""
    rows = folders.documents(spark, folder, suffixes)
    kind = S.document_type(S.document_family(F.col("title"), F.coalesce(F.get("pages", F.lit(0)), F.col("text"))))
    rows = rows.withColumn("title", title(F.col("text"), F.col("doc_id")))
    return rows.select("doc_id", "path", "suffix", "title", kind.alias("type"), folders.jurisdiction(F.col("text")).alias("jurisdiction"), "text", "pages", "read", "error")


def title(text: Column, fallback: Column, longest: int = 200) -> Column:
    """First line with letters of at most ``longest`` characters, without heading marks."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^#+\s*", "")))
    return F.coalesce(F.try_element_at(F.filter(lines, lambda x: x.rlike(r"\p{L}") & (F.length(x) <= longest)), F.lit(1)), fallback)


def sufficient(text: Column) -> Column:
    """Whether extracted text is long enough not to need layout recognition."""
    return (F.length(text) >= LEAST_CHARS) & (F.size(F.split(F.trim(text), r"\s+")) >= LEAST_WORDS)


def read_chunked_json(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, chunk_id, pos, text of JSON documents whose chunks keep their ids."""
    docs = spark.read.schema("doc_id string, title string, chunks array<struct<chunk_id:string,text:string>>").json(path, multiLine=True)
    rows = docs.select("doc_id", F.posexplode("chunks").alias("pos", "c"))
    return rows.select("doc_id", F.coalesce("c.chunk_id", F.concat_ws(":", "doc_id", "pos", T.short_hash(F.col("c.text")))).alias("chunk_id"), "pos", "c.text")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden cases; a malformed file fails. Missing ids become 'case-<hash>'."""
    rows = spark.read.schema("id string, question string, answer_type string, gold_chunk_ids array<string>, expected_short_answer string, doc_ids array<string>, tags array<string>").json(path, multiLine=True, mode="FAILFAST")
    empty = F.array().cast("array<string>")
    rows = rows.withColumn("id", F.coalesce("id", F.concat(F.lit("case-"), T.short_hash(F.col("question")))))
    return rows.withColumns({c: F.coalesce(c, empty) for c in ("gold_chunk_ids", "doc_ids", "tags")}).withColumn("answer_type", F.coalesce("answer_type", F.lit("free_text")))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows that fit the schema, and the text of the lines that don't."""
    rows = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad is null").drop("_bad"), spark.read.text(path).where(F.trim("value") != "").where(F.expr("try_parse_json(value) is null"))


def read_benchmark_csv(spark: SparkSession, path: str, name_col: str = "model", score_cols: tuple[str, ...] = ("score",)) -> DataFrame:
    """Rows of a CSV whose name cell may be a Markdown link; scores that aren't numbers are null."""
    rows = spark.read.csv(path, header=True)
    link = r"\[([^\]]*)\]\(([^)]*)\)"
    name = F.when(F.col(name_col).rlike(link), F.regexp_extract(name_col, link, 1)).otherwise(F.col(name_col))
    url = F.when(F.col(name_col).rlike(link), F.regexp_extract(name_col, link, 2))
    return rows.select(name.alias("name"), url.alias("url"), *[F.regexp_replace(c, "[%,]", "").try_cast("double").alias(c) for c in score_cols])


def unify(records: list[tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """External records of several schemas as one row type: a select each, then a union."""
    parts = [df.select(*[c.alias(n) for n, c in columns.items()]) for df, columns in records]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def write_postings(index: DataFrame, table: str, buckets: int = 64) -> None:
    """A BM25 index as a table bucketed by term: query terms then join without a shuffle of it."""
    index.write.bucketBy(buckets, "term").sortBy("term").mode("overwrite").saveAsTable(table)


def write_results(results: DataFrame, path: str, id_col: str = "question_id") -> None:
    """Results as JSON lines, one object with the id and the rest."""
    rest = [c for c in results.columns if c != id_col]
    results.select(F.to_json(F.struct(F.col(id_col), F.struct(*rest).alias("result"))).alias("value")).write.text(path)


def _normal(name: str, sample: Column, text: Column, question: Column, kind: str, role: Column, scope: Column, support: Column, **more: Column) -> list[Column]:
    given = F.when(F.trim(sample.cast("string")) != "", F.trim(sample.cast("string")))
    own = F.concat(F.lit(f"{name}-"), T.short_hash(F.concat_ws("|", question, text), 12))
    values = {"source_dataset": F.lit(name), "sample_id": F.coalesce(given, own), "text": F.coalesce(text, F.lit("")), "question": F.trim(F.coalesce(question, F.lit(""))), "label_type": F.lit(kind), "role_label": role, "scope_label": scope, "support_label": support, "metadata": F.to_json(F.struct(*[c.alias(n) for n, c in more.items()]))}
    return [c.alias(n) for n, c in values.items()]


def normalise_passages(records: DataFrame, name: str, split: str) -> DataFrame:
    """Records (id, question, passages array<struct<id, doc, text>>) as normal rows."""
    text = F.array_join(F.transform("passages", lambda p: F.trim(F.concat(F.lit("["), p["id"].cast("string"), F.lit("] "), F.coalesce(p["text"], F.lit(""))))), "\n\n")
    n = F.coalesce(F.size("passages"), F.lit(0))
    scope = F.when(n > 1, "multi_passage_support").otherwise("single_field_single_doc")
    return records.select(*_normal(name, F.col("id"), text, F.col("question"), "support_scope", F.lit(""), scope, F.lit("supported"), split=F.lit(split), passages=n))


def normalise_spans(records: DataFrame, name: str, split: str) -> DataFrame:
    """Records (id, question, context, answers array<string>); the role is what the
    question quotes."""
    answers = F.filter(F.coalesce("answers", F.array().cast("array<string>")), lambda a: F.trim(a) != "")
    role = F.regexp_extract("question", r'"([^"]+)"', 1)
    support = F.when(F.size(answers) > 0, "supported").otherwise("unanswerable")
    return records.select(*_normal(name, F.col("id"), F.col("context"), F.col("question"), "role_label", role, F.lit("single_field_single_doc"), support, split=F.lit(split), answers=F.size(answers)))


def normalise_entailment(records: DataFrame, name: str, split: str, labels: tuple[str, ...]) -> DataFrame:
    """Records (id, premise, hypothesis, label number); ``labels`` name the numbers."""
    names = F.array(*[F.lit(x) for x in labels])
    label = F.coalesce(F.get(names, F.col("label").cast("int")), F.lit("unknown"))
    return records.select(*_normal(name, F.col("id"), F.col("premise"), F.col("hypothesis"), "support", F.lit(""), F.lit("single_field_single_doc"), label, split=F.lit(split)))


def normalise_labelled(records: DataFrame, name: str, split: str) -> DataFrame:
    """Records (id, text, labels array<string>) without a question."""
    labels = F.array_sort(F.coalesce("labels", F.array().cast("array<string>")))
    return records.select(*_normal(name, F.col("id"), F.col("text"), F.lit(""), "role_label", F.array_join(labels, ","), F.lit(""), F.lit(""), split=F.lit(split), labels=F.size(labels)))


def read_checked_golden(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Golden cases that are whole, and the others with what is wrong with each."""
    rows = read_golden(spark, path)
    wrong = F.filter(F.array(F.when(F.coalesce(F.trim("question"), F.lit("")) == "", "no question"), F.when(~F.col("answer_type").isin("boolean", "number", "date", "name", "names", "free_text"), "unknown answer type"), F.when(F.exists("gold_chunk_ids", lambda g: F.trim(g) == ""), "empty chunk id")), lambda x: x.isNotNull())
    told = rows.withColumn("wrong", wrong)
    return told.where("size(wrong) = 0").drop("wrong"), told.where("size(wrong) > 0")


def markdown_rows(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """place, line: a Markdown table of a report, head first; bars are escaped."""
    cells = lambda xs: F.concat(F.lit("| "), F.array_join(F.array(*xs), " | "), F.lit(" |"))
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    spark = rows.sparkSession
    head = spark.range(1).select(F.lit(-2).cast("long").alias("place"), cells([F.lit(c) for c in columns]).alias("line"))
    rule = spark.range(1).select(F.lit(-1).cast("long").alias("place"), cells([F.lit("---") for _ in columns]).alias("line"))
    body = rows.select(F.col(order).cast("long").alias("place"), cells([cell(c) for c in columns]).alias("line"))
    return head.union(rule).union(body)
