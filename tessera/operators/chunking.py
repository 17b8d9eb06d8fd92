"""Sections, paragraphs, chunks and pages of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions import text as T

CHUNK, OVERLAP = 450, 45


def sections(docs: DataFrame, heading: str = r"^(#{1,6}) +(.+)$", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, idx, level, heading, path, text: parts opened by heading lines.

    ``heading`` has two groups: marks, whose number is the level, and the title.
    Text before the first heading is section 0 without a heading. A path joins
    the titles of the open headings with ' > '.
    """
    w = Window.partitionBy("id").orderBy("pos")
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("pos", "line"))
    rows = rows.withColumn("is_head", F.col("line").rlike(heading)).withColumn("idx", F.sum(F.col("is_head").cast("int")).over(w))
    parts = rows.groupBy("id", "idx").agg(
        F.array_sort(F.collect_list(F.when(~F.col("is_head"), F.struct("pos", "line")))).alias("body"),
        F.max(F.when(F.col("is_head"), F.regexp_extract("line", heading, 2))).alias("heading"),
        F.max(F.when(F.col("is_head"), F.length(F.regexp_extract("line", heading, 1)))).alias("level"),
    )
    parts = parts.withColumn("text", F.array_join(F.transform("body", lambda x: x["line"]), "\n"))
    v = Window.partitionBy("id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    heads = F.filter(F.collect_list(F.struct("level", "heading")).over(v), lambda x: x["level"].isNotNull())
    start = F.array().cast("array<struct<level:int,heading:string>>")
    stack = F.aggregate(heads, start, lambda kept, x: F.concat(F.filter(kept, lambda k: k["level"] < x["level"]), F.array(x)))
    return parts.withColumn("path", F.array_join(F.transform(stack, lambda x: x["heading"]), " > ")).select("id", "idx", "level", "heading", "path", "text").where("idx > 0 or trim(text) <> ''")


def paragraphs(docs: DataFrame, delimiter: str = r"\n\s*\n", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, pos, text of the paragraphs that aren't blank."""
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, delimiter)).alias("pos", "text"))
    return rows.withColumn("text", F.trim("text")).where("text <> ''")


def pack(texts: Column, limit: int = CHUNK, overlap: int = 0) -> Column:
    """Greedy packing of an array of paragraphs into chunks of ``limit`` tokens.

    A chunk is flushed when the next paragraph would exceed the limit; then its
    trailing paragraphs of together at most ``overlap`` tokens, at least one if
    ``overlap`` isn't 0, start the next. Returns array<array<string>>.
    """
    part = F.transform(texts, lambda x: F.struct(x.alias("x"), T.token_count(x).cast("int").alias("n")))
    kind = "array<struct<x:string,n:int>>"
    start = F.struct(F.array().cast(kind).alias("open"), F.lit(0).alias("n"), F.array().cast("array<array<string>>").alias("done"))
    words = lambda xs: F.transform(xs, lambda p: p["x"])

    def tail(xs: Column) -> Column:
        """The trailing paragraphs that start the next chunk, and their tokens."""
        if not overlap:
            return F.struct(F.array().cast(kind).alias("open"), F.lit(0).alias("n"))
        first = F.struct(F.array().cast(kind).alias("open"), F.lit(0).alias("n"), F.lit(False).alias("full"))

        def grow(s: Column, p: Column) -> Column:
            fits = ~s["full"] & ((F.size(s["open"]) == 0) | (s["n"] + p["n"] <= overlap))
            return F.struct(F.when(fits, F.concat(F.array(p), s["open"])).otherwise(s["open"]).alias("open"), F.when(fits, s["n"] + p["n"]).otherwise(s["n"]).alias("n"), (~fits).alias("full"))

        return F.aggregate(F.reverse(xs), first, grow, lambda s: F.struct(s["open"].alias("open"), s["n"].alias("n")))

    def step(s: Column, p: Column) -> Column:
        flush = (F.size(s["open"]) > 0) & (s["n"] + p["n"] > limit)
        kept = F.when(flush, tail(s["open"])).otherwise(F.struct(s["open"].alias("open"), s["n"].alias("n")))
        return F.struct(F.concat(kept["open"], F.array(p)).alias("open"), (kept["n"] + p["n"]).cast("int").alias("n"), F.when(flush, F.concat(s["done"], F.array(words(s["open"])))).otherwise(s["done"]).alias("done"))

    return F.aggregate(part, start, step, lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(words(s["open"])))).otherwise(s["done"]))


def hard_split(tokens: Column, size: int = CHUNK, step: int = CHUNK - OVERLAP) -> Column:
    """Windows of ``size`` tokens every ``step``; the last reaches the end."""
    last = F.greatest(F.ceil((F.size(tokens) - size) / step), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(tokens, i * step + 1, size))


def chunk_ids(doc: Column, section: Column, chunk: Column, text: Column) -> Column:
    """'doc:section:chunk:hash8'."""
    return F.concat_ws(":", doc.cast("string"), section.cast("string"), chunk.cast("string"), T.short_hash(text))


def chunks(docs: DataFrame, limit: int = CHUNK, overlap: int = 0, delimiter: str = "\n", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """chunk_id, id, pos, text, tokens: paragraphs packed to ``limit`` tokens.

    A document is folded in one row, so nothing is shuffled.
    """
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), delimiter), lambda p: F.trim(p)), lambda p: p != "")
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(pack(parts, limit, overlap)).alias("pos", "parts"))
    rows = rows.withColumn("text", F.array_join("parts", "\n"))
    return rows.select(chunk_ids(F.col("id"), F.lit(0), F.col("pos"), F.col("text")).alias("chunk_id"), "id", "pos", "text", T.token_count(F.col("text")).alias("tokens"))


#: A heading of a segment: kind, number, title.
HEADING = r"^(Article|Section|Schedule|Part|Chapter) ([0-9A-Z]+)[.:]? *(.*)$"
#: Other lines that open a segment.
OPENINGS = (("operative_order", "(?i)it is hereby ordered"), ("issued_by", "(?i)^issued by"), ("definition", r'"[^"]+" means'))


def segments(pages: DataFrame, heading: str = HEADING, openings: tuple = OPENINGS, doc_col: str = "doc", page_col: str = "page", text_col: str = "text") -> DataFrame:
    """doc, idx, kind, label, title, first_page, last_page, n_lines, text: a document's
    lines from one boundary to the next, across its pages. What comes before the
    first boundary belongs to none."""
    lines = pages.select(F.col(doc_col).alias("doc"), F.col(page_col).alias("page"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("pos", "line")).where("trim(line) <> ''")
    kind = F.when(F.col("line").rlike(heading), F.lower(F.regexp_extract("line", heading, 1)))
    for name, pattern in openings:
        kind = kind.when(F.col("line").rlike(pattern), name)
    lines = lines.withColumn("kind", kind)
    idx = F.sum(F.col("kind").isNotNull().cast("int")).over(Window.partitionBy("doc").orderBy("page", "pos"))
    parts = lines.withColumn("idx", idx).where("idx > 0").groupBy("doc", "idx").agg(
        F.max("kind").alias("kind"),
        F.max(F.when(F.col("line").rlike(heading), F.concat_ws(" ", F.regexp_extract("line", heading, 1), F.regexp_extract("line", heading, 2)))).alias("label"),
        F.max(F.when(F.col("line").rlike(heading), F.trim(F.regexp_extract("line", heading, 3)))).alias("title"),
        F.min("page").alias("first_page"),
        F.max("page").alias("last_page"),
        F.count(F.lit(1)).alias("n_lines"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "pos", "line"))), lambda x: x["line"]), "\n").alias("text"),
    )
    return parts.withColumn("label", F.coalesce("label", "kind"))


def html_text(source: Column) -> Column:
    """Text of markup by tag stripping; scripts, styles and comments are removed."""
    t = F.regexp_replace(source, r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return T.collapse(t)


def links(source: Column) -> Column:
    """Targets of anchors, first occurrences."""
    return F.array_distinct(F.regexp_extract_all(source, F.lit(r'<a [^>]*href="([^"]*)"'), F.lit(1)))
