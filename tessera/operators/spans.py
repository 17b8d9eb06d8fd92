"""Where a claim stands in a source: exact, approximate or by its words.

An approximate match is the substring of the source with the smallest edit distance
to the claim. A match within the allowed distance keeps a number of the claim's
trigrams, all within a band of diagonals as wide as that distance (the q-gram lemma);
only stretches of the source that hold such a band are aligned, with bit-parallel
columns, so most pairs cost one lookup of trigrams. Claims too short for the lemma
are aligned with the whole source.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

GRAM = 3
SENTENCE = re.compile(r"(?<=[.!?])\s+")
TOKEN = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Settings:
    """``ratio`` of an approximate match, ``overlap`` of one by words, and how many
    exact matches of a source count."""

    ratio: float = 0.72
    overlap: float = 0.62
    most: int = 3


def lowered(text: str) -> str:
    """Lower case, one code point for each: offsets stay those of ``text``."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _columns(pattern: str, text: str, anchored: bool) -> Iterator[int]:
    """Edit distance of ``pattern`` to the best substring of ``text`` that ends at each
    place, or, ``anchored``, to the text up to there."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    places: dict[str, int] = {}
    for i, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << i
    up, down, score = full, 0, m
    for c in text:
        eq = places.get(c, 0)
        vertical = eq | down
        across = (((eq & up) + up) ^ up) | eq
        more, less = down | ~(across | up) & full, up & across
        score += bool(more & high) - bool(less & high)
        more = (more << 1 | anchored) & full
        less = less << 1 & full
        up, down = less | ~(vertical | more) & full, more & vertical
        yield score


def grams(text: str) -> np.ndarray:
    """The trigrams of a text as numbers: 21 bits for each code point."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]


class Source:
    """What claims about a source share: its text to align with, and its trigrams and
    the words of its sentences, once they are asked for."""

    def __init__(self, text: str):
        self.text = text
        self.plain = lowered(re.sub(r"\s", " ", text))
        self.flat = " ".join(self.plain.split())
        self._sorted = self._sentences = None

    def sorted_grams(self) -> tuple[np.ndarray, np.ndarray]:
        if self._sorted is None:
            found = grams(self.plain)
            order = np.argsort(found, kind="stable")
            self._sorted = found[order], order
        return self._sorted

    def sentences(self) -> list[tuple[int, int, set[str]]]:
        if self._sentences is None:
            starts = [0, *[m.end() for m in SENTENCE.finditer(self.text)]]
            ends = [*[m.start() for m in SENTENCE.finditer(self.text)], len(self.text)]
            self._sentences = [(a, b, set(TOKEN.findall(self.text[a:b].lower()))) for a, b in zip(starts, ends)]
        return self._sentences


#: Claims about one source come one after another.
source_of = lru_cache(64)(Source)


def stretches(claim: str, source: Source, errors: int) -> list[tuple[int, int]]:
    """Parts of the source outside of which no substring is within ``errors``."""
    m, n = len(claim), len(source.plain)
    need = m - GRAM + 1 - GRAM * errors
    if need <= 0:
        return [(0, n)]
    if n < GRAM:
        return []
    own, (held, place) = grams(claim), source.sorted_grams()
    low, high = np.searchsorted(held, own, "left"), np.searchsorted(held, own, "right")
    count = high - low
    i = np.repeat(np.arange(len(own)), count)
    j = place[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - low, count)]
    diagonal = np.sort(j - i)
    if len(diagonal) < need:
        return []
    at = np.flatnonzero(diagonal[need - 1 :] - diagonal[: len(diagonal) - need + 1] <= errors)
    out: list[tuple[int, int]] = []
    for a, b in zip((diagonal[at] - errors).tolist(), (diagonal[at + need - 1] + m + errors).tolist()):
        a, b = max(0, a), min(n, b)
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        elif a < b:
            out.append((a, b))
    return out


def align(claim: str, source: str | Source, ratio: float) -> tuple[int, int, int] | None:
    """Start, end and edit distance of the substring nearest to the claim, if
    1 - distance / length of the claim is ``ratio`` at least: of several the one that
    ends first, and of these the shortest."""
    if isinstance(source, str):
        source = Source(source)
    m, text = len(claim), source.plain
    errors = int((1 - ratio) * m + 1e-9)
    best = errors + 1
    for a, b in stretches(claim, source, errors):
        for k, score in enumerate(_columns(claim, text[a:b], False), a + 1):
            if score < best:
                best, end = score, k
    if best > errors or not m:
        return None
    # backwards from the end, no further than the distance allows
    for k, score in enumerate(_columns(claim[::-1], text[max(0, end - m - best) : end][::-1], True), 1):
        if score == best:
            return end - k, end, best
    return end, end, best


def _spans(claim: str, source: str, rule: Settings) -> list[tuple[str, int, int, float]]:
    words = claim.split()
    if not words or not source.strip():
        return []
    low, of = lowered(" ".join(words)), source_of(source)
    if low in of.flat:
        pattern = re.compile(r"\s+".join(map(re.escape, words)), re.IGNORECASE)
        found = [("exact", x.start(), x.end(), 1.0) for x, _ in zip(pattern.finditer(source), range(rule.most))]
        if found:
            return found
    near = align(low, of, rule.ratio)
    if near and near[0] < near[1]:
        return [("fuzzy", near[0], near[1], round(1 - near[2] / len(low), 6))]
    asked = set(TOKEN.findall(low))
    best = (0.0, 0, 0)
    for start, end, held in of.sentences() if asked else ():
        share = len(asked & held) / len(asked)
        if share > best[0]:
            best = (share, start, end)
    return [("overlap", best[1], best[2], round(best[0], 6))] if best[0] >= rule.overlap else []


def evidence_spans(pairs: DataFrame, rule: Settings = Settings(), claim: str = "claim", source: str = "source") -> DataFrame:
    """``pairs`` without its source, with support, start, end (code points of the
    source, the end excluded) and ratio: a row for each span.

    ``exact``: the claim's words with any white space between, in any case, the first
    ``most`` times. Else ``fuzzy``: the nearest substring, if near enough. Else
    ``overlap``: the first sentence with most of the claim's distinct words, if they
    are enough. Else one row with ``none`` and nulls, as for a null or empty claim or
    source. Pairs are what the caller joined; the work is by row.
    """
    kept = [f for f in pairs.schema.fields if f.name != source]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", support string, start int, end int, ratio double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, (c, s) in enumerate(zip(batch.column(claim).to_pylist(), batch.column(source).to_pylist())):
                spans = _spans(c or "", s or "", rule) or [("none", None, None, None)]
                at += [k] * len(spans)
                rows += spans
            part = batch.select([f.name for f in kept]).take(pa.array(at, pa.int64()))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]], [f.name for f in kept] + ["support", "start", "end", "ratio"])

    return pairs.mapInArrow(run, schema)


def best_support(spans: DataFrame, by: list[str]) -> DataFrame:
    """The best span of each claim over its sources: exact before fuzzy before
    overlap, then by ratio, then in the order of all other columns."""
    order = F.struct(F.expr("array_position(array('exact', 'fuzzy', 'overlap', 'none'), support)").alias("kind"), (-F.coalesce("ratio", F.lit(0.0))).alias("less"), *[F.col(c) for c in spans.columns if c not in by and c not in ("support", "ratio")], "support", "ratio")
    best = spans.groupBy(*by).agg(F.min(order).alias("best"))
    return best.select(*by, *[f"best.{c}" for c in spans.columns if c not in by])
