"""Regions of a page: blocks of lines that belong together, with their offsets.

A line with two cells or more, apart by a bar, a tab or two spaces, is a row. Rows one
after another are one table while they share columns: two cells that start at the
same place, or as many cells where bars part them. A blank line ends a region, and so
does a change between rows and other lines.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from tessera.functions import structure as S

GAP = re.compile(r"(\s*\|\s*|\t+| {2,})", re.ASCII)
#: A line without cells of its own, under the head of a table; a last line separator aside.
RULE = re.compile(r"[\s|:+=-]+[\u0085\u2028\u2029]?", re.ASCII)
BLANK = re.compile(r"\s*", re.ASCII)


def cells(line: str) -> tuple[list[int], list[str]]:
    """Where each cell of a line starts, and its text."""
    at, texts, upto = [], [], 0
    for k, part in enumerate(GAP.split(line)):
        if not k % 2 and (text := part.strip(" ")):
            at.append(upto)
            texts.append(text)
        upto += len(part)
    return at, texts


def read(page: str) -> list[tuple[int, int, bool, list[str], list[list[str]]]]:
    """start, end, whether its lines are rows, lines and cells of each region."""
    found, upto, before = [], 0, None
    for line in page.split("\n"):
        start, upto = upto, upto + len(line) + 1
        if BLANK.fullmatch(line):
            before = None
            continue
        if RULE.fullmatch(line):  # goes with what is above it
            continue
        at, texts = cells(line)
        row, barred = len(at) > 1, "|" in line
        if before and before[0] == row and (not row or len({*at} & {*before[2]}) > 1 or (barred and before[1] and len(at) == len(before[2]))):
            found[-1][1] = upto - 1
            found[-1][3].append(line)
            found[-1][4].append(texts)
        else:
            found.append([start, upto - 1, row, [line], [texts]])
        before = row, barred, at
    return found


def regions(pages: DataFrame, id_col: str = "page_id", text_col: str = "text") -> DataFrame:
    """id, region (from 0), kind, start, end, n_lines, text, rows and signed of the
    regions of each page, ids unique.

    Offsets are code points of the page, the end excluded. ``kind`` is ``table`` for two
    rows or more (``rows`` has their cells), else what ``structure.region_kind`` says
    of the text, else ``text``; ``signed`` is the signer, authority and date of a
    signature. Null, empty and blank pages have no regions. Each page is read where it
    is, in one pass over its lines: nothing is shuffled or sorted.
    """
    import pyarrow as pa

    def told(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                found = [read(page or "") for page in part.column("text").to_pylist()]
                own = pa.array([k for k, x in enumerate(found) for _ in x], pa.int64())
                start, end, row, lines, rows = zip(*(x for held in found for x in held)) if len(own) else ((),) * 5
                numbers = [n for x in found for n in range(len(x))]
                columns = [pa.array(numbers, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(map(len, lines), pa.int32()), pa.array(map("\n".join, lines), pa.string()), pa.array(rows, pa.list_(pa.list_(pa.string()))), pa.array(row, pa.bool_())]
                yield pa.RecordBatch.from_arrays([part.column("id").take(own), *columns], ["id", "region", "start", "end", "n_lines", "text", "rows", "row"])

    texts = pages.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = texts.mapInArrow(told, f"id {texts.schema['id'].dataType.simpleString()}, region int, start int, end int, n_lines int, text string, rows array<array<string>>, row boolean")
    kind = F.when(F.col("row") & (F.col("n_lines") > 1), "table").otherwise(F.coalesce(S.region_kind(F.col("text")), F.lit("text")))
    out = out.withColumn("kind", kind)
    return out.select("id", "region", "kind", "start", "end", "n_lines", "text", F.when(F.col("kind") == "table", F.col("rows")).alias("rows"), F.when(F.col("kind") == "signature", S.signature(F.col("text"))).alias("signed"))
