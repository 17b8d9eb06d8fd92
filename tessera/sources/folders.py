"""Folders of documents (text, Markdown, JSON, DOCX, PDF) as rows.

``documents`` reads what Spark's ``binaryFile`` source gives, so it takes any store
that Spark reads. ``DocumentSource`` is the same as a data source of its own:

    spark.dataSource.register(DocumentSource)
    spark.read.format("tessera_documents").option("path", folder).load()

It lists a folder once and deals the files to tasks by size; it needs a file system
that pyarrow opens. In both, a file that can't be read is a row with ``error`` and
costs no other file.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.sources import pdf

SUFFIXES = ("txt", "md", "json", "docx", "pdf")
FIELDS = "text string, pages array<string>, read string, error string"
ROW = f"doc_id string, path string, suffix string, {FIELDS}"
#: Bytes and files of a task.
BYTES, FILES = 128 << 20, 4096
#: How a text names a jurisdiction, and its code.
JURISDICTIONS = (("US", r"U\.?S\.?A?|United States"), ("UK", r"U\.?K|United Kingdom"), ("EU", r"E\.?U|European Union"), ("AU", "Australia"), ("SG", "Singapore"), ("IE", "Ireland"))


def docx_text(content: bytes) -> str:
    """Paragraphs of a DOCX file, one to a line."""
    import xml.etree.ElementTree as tree

    name = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = tree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{name}t")) for p in body.iter(f"{name}p"))


def parse(suffix: str, content: bytes) -> tuple[str | None, list[str] | None, str | None, str | None]:
    """Text, pages (PDF only), how it was read, and error of a file's bytes."""
    try:
        if suffix == "pdf":
            pages, read = pdf.page_texts(content)
            return "\n\n".join(p for p in pages if p), pages, read, None
        return docx_text(content) if suffix == "docx" else content.decode("utf-8-sig"), None, "whole", None
    except Exception as error:  # a row of its own, see the module
        return None, None, None, f"{type(error).__name__}: {error}"[:500]


def parsed(files: DataFrame) -> DataFrame:
    """``files`` (suffix, content, ...) with text, pages, read and error for its content.

    ``read`` tells how: ``whole``; of a PDF ``stream`` order, ``layout`` order where
    that gave fewer than 400 characters and 80 words or few letters, or ``none`` where
    no page shows text, which is left to recognition. Null content is an error.
    """
    kept = [f for f in files.schema.fields if f.name != "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one file at a time: they may be large
                content = batch.column("content")[k].as_py()
                row = parse(batch.column("suffix")[k].as_py(), content) if content is not None else (None, None, None, "no content")
                found = [pa.array([v], kind) for v, kind in zip(row, (pa.string(), pa.list_(pa.string()), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.select([f.name for f in kept]).slice(k, 1).columns, *found], [*[f.name for f in kept], "text", "pages", "read", "error"])

    return files.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", {FIELDS}")


def documents(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """doc_id (the file's name without suffix), path, suffix, text, pages, read, error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{','.join(suffixes)}}}").load(folder)
    name = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return parsed(files.select(name.alias("doc_id"), "path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("suffix"), "content"))


@dataclass
class Files(InputPartition):
    paths: list[str]


class DocumentReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.suffixes = tuple(options.get("suffixes", ",".join(SUFFIXES)).split(","))
        self.bytes, self.files = int(options.get("bytes", BYTES)), int(options.get("files", FILES))

    def partitions(self) -> list[Files]:
        """Files in order of their paths, cut where a task has enough of them."""
        store, root = fs.FileSystem.from_uri(self.path)
        listed = store.get_file_info(fs.FileSelector(root, recursive=True))
        out, size = [Files([])], 0
        for f in sorted((f for f in listed if f.is_file and f.extension.lower() in self.suffixes), key=lambda f: f.path):
            if out[-1].paths and (size + f.size > self.bytes or len(out[-1].paths) >= self.files):
                out.append(Files([]))
                size = 0
            out[-1].paths.append(f.path)
            size += f.size
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(self.path)
        for path in partition.paths:
            name, _, suffix = path.rpartition("/")[2].rpartition(".")
            try:
                with store.open_input_stream(path) as file:
                    content = file.read()
            except OSError as error:
                yield name, path, suffix.lower(), None, None, None, f"{type(error).__name__}: {error}"[:500]
                continue
            yield name, path, suffix.lower(), *parse(suffix.lower(), content)


class DocumentSource(DataSource):
    """Options: ``path``; ``suffixes`` (comma-separated); ``bytes`` and ``files`` of a task."""

    @classmethod
    def name(cls) -> str:
        return "tessera_documents"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> DocumentReader:
        return DocumentReader(self.options)


def jurisdiction(text: Column, opening: int = 3000) -> Column:
    """Code of the jurisdiction that the opening of a text names first, else ''."""
    first = F.regexp_extract(F.substring(text, 1, opening), rf"(?i)\b({'|'.join(p for _, p in JURISDICTIONS)})\b", 1)
    found = F.lit("")
    for code, pattern in reversed(JURISDICTIONS):
        found = F.when(first.rlike(rf"(?i)^({pattern})$"), code).otherwise(found)
    return F.when(first == "", "").otherwise(found)


def page_sections(rows: DataFrame) -> DataFrame:
    """doc_id, page, heading and text of the pages that show text."""
    pages = rows.select("doc_id", F.posexplode("pages").alias("at", "text")).where(F.trim("text") != "")
    return pages.select("doc_id", (F.col("at") + 1).alias("page"), F.concat(F.lit("Page "), F.col("at") + 1).alias("heading"), "text")
