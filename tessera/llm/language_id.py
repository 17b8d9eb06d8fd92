"""Language identification with a string kernel.

The kernel of two texts is the number of character n-grams (a blended spectrum
of byte n-grams, with case folded for A-Z) present in both, over the square
root of the two texts' own numbers. n-grams that no landmark holds are left
out. Landmarks are a seeded, bounded sample of the labelled texts; their kernel
matrix gives the Nyström features, on which one ridge regression for each
language is fitted against the rest. Because the kernel counts shared n-grams,
the fitted weights of all landmarks fold into one matrix of n-grams by
languages, so a batch is scored by a product of its presence matrix with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import LOWER, U64, arrow, mix64, portions, text_buffer

LETTER = regex.compile(r"\p{L}")
UNDETERMINED = "und"
#: Cells of a presence matrix that are held at once.
CELLS = 1 << 25
COLUMNS = 4096


@dataclass(frozen=True)
class Settings:
    """The bound of what is fitted: of the ``languages`` most frequent languages
    the ``examples`` different texts each with the least seeded hash, and
    ``all_examples`` in all; of each its first ``longest`` characters. The first
    ``landmarks`` of a language are landmarks, ``all_landmarks`` in all. The kernel
    has the ``features`` n-grams that most landmarks hold. ``ridge`` is the
    regression's."""

    grams: tuple[int, ...] = (2, 3, 4)
    landmarks: int = 64
    all_landmarks: int = 2048
    examples: int = 400
    all_examples: int = 16384
    features: int = 1 << 16
    longest: int = 8000
    languages: int = 200
    ridge: float = 1e-3
    seed: int = 17


def gram_hashes(data: np.ndarray, offsets: np.ndarray, grams: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each n-gram and the text it is in. Each text counts as one space
    longer at either end."""
    sizes = np.diff(offsets)
    n = len(sizes)
    wide = np.full(len(data) + 2 * n, 0x20, U64)
    place = np.arange(len(data)) + 2 * np.repeat(np.arange(n), sizes) + 1
    wide[place] = LOWER[data]
    owner = np.repeat(np.arange(n), sizes + 2)
    hashes, owners = [], []
    key = np.zeros(len(wide), U64)
    for k in range(max(grams)):
        key = (key[: len(wide) - k] << U64(8)) | wide[k:]
        if k + 1 in grams:
            inside = owner[: len(key)] == owner[k:]
            hashes.append(mix64(key[inside] + U64(k + 1 << 56)))
            owners.append(owner[: len(key)][inside])
    return np.concatenate(hashes), np.concatenate(owners)


@dataclass
class Model:
    """``keys`` are the sorted n-gram hashes; ``weights`` a row for each."""

    languages: list[str]
    keys: np.ndarray
    weights: np.ndarray
    grams: tuple[int, ...]
    table: np.ndarray | None = None

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash, or -1: a table by the hash's high bits, then a check."""
        if self.table is None:
            self.bits = max(4, int(np.ceil(np.log2(max(len(self.keys), 1)))) + 2)
            bucket = (self.keys >> U64(64 - self.bits)).astype(np.int64)
            self.table = np.searchsorted(bucket, np.arange(1 << self.bits)).astype(np.int32)
            self.deepest = int(np.bincount(bucket).max()) if len(bucket) else 0
        at = self.table[(hashes >> U64(64 - self.bits)).astype(np.int64)]
        out = np.full(len(hashes), -1, np.int32)
        for step in range(self.deepest):
            here = np.minimum(at + step, len(self.keys) - 1)
            out = np.where(self.keys[here] == hashes, here, out)
        return out

    def presence(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, n-gram row) pairs, sorted."""
        width = max(len(self.keys), 1)
        step = max(1, CELLS // width)
        texts, rows = [], []
        for low in range(0, len(offsets) - 1, step):
            high = min(low + step, len(offsets) - 1)
            hashes, owner = gram_hashes(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], self.grams)
            slot = self._slots(hashes)
            known = slot >= 0
            seen = np.zeros((high - low) * width, bool)
            seen[owner[known] * width + slot[known]] = True
            flat = np.flatnonzero(seen)
            texts.append(low + flat // width)
            rows.append(flat % width)
        return (np.concatenate(texts), np.concatenate(rows)) if texts else (np.zeros(0, np.int64),) * 2

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Regression outputs, a row for each text and a column for each language."""
        return self.outputs(data, offsets)[0]

    def outputs(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The scores, and how many known n-grams each text holds."""
        n = len(offsets) - 1
        text, row = self.presence(data, offsets)
        total = np.zeros((n, len(self.languages)))
        held = np.bincount(text, minlength=n)
        for i, j in portions(np.concatenate([[0], np.cumsum(held)]), max(1, CELLS // 8 // max(1, len(self.languages)))):
            low, high = np.searchsorted(text, [i, j])
            starts = np.flatnonzero(np.diff(text[low:high], prepend=-1))
            if len(starts):
                total[text[low + starts]] = np.add.reduceat(self.weights[row[low:high]], starts, dtype=np.float64)
        return total / np.sqrt(np.maximum(held, 1))[:, None], held


class Presence:
    """Sparse rows of a presence matrix, each over the root of its own number,
    multiplied in blocks of columns."""

    def __init__(self, model: Model, data: np.ndarray, offsets: np.ndarray):
        self.text, self.row = model.presence(data, offsets)
        self.size, self.width = len(offsets) - 1, len(model.keys)
        self.scale = 1 / np.sqrt(np.maximum(np.bincount(self.text, minlength=self.size), 1))
        order = np.argsort(self.row, kind="stable")
        self.text, self.row = self.text[order], self.row[order]

    def columns(self, low: int, high: int) -> np.ndarray:
        a, b = np.searchsorted(self.row, [low, high])
        out = np.zeros((self.size, high - low), np.float32)
        out[self.text[a:b], self.row[a:b] - low] = self.scale[self.text[a:b]]
        return out

    def kernel(self, other: Presence) -> np.ndarray:
        out = np.zeros((self.size, other.size))
        for low in range(0, self.width, COLUMNS):
            high = min(low + COLUMNS, self.width)
            mine = self.columns(low, high)
            out += mine @ (mine if other is self else other.columns(low, high)).T
        return out


def fit(texts: list[bytes], langs: list[str], is_landmark: list[bool], settings: Settings = Settings()) -> Model:
    """Nyström features from the landmarks, then ridge regression for each language."""
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.zeros(0, U64), np.zeros((0, 0)), settings.grams)

    def joined(some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(some), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in some])]).astype(np.int64)

    marks = [t for t, m in zip(texts, is_landmark) if m]
    hashes, owner = gram_hashes(*joined(marks), settings.grams)
    keys, at = np.unique(hashes, return_inverse=True)
    once = np.unique(at.astype(np.int64) * len(marks) + owner) // len(marks)
    of = np.array(languages).searchsorted([x for x, m in zip(langs, is_landmark) if m])
    lonely = (np.bincount(of, minlength=len(languages)) == 1)[of]
    holders = np.bincount(once, minlength=len(keys))
    shared = holders > 1
    shared[at[lonely[owner]]] = True
    if shared.sum() > settings.features:
        most = np.lexsort((keys, -holders, ~shared))[: settings.features]
        shared = np.zeros(len(keys), bool)
        shared[most] = True
    model = Model(languages, keys[shared], np.zeros((0, 0), np.float32), settings.grams)
    landmarks = Presence(model, *joined(marks))
    values, vectors = np.linalg.eigh(landmarks.kernel(landmarks))
    good = values > 1e-6 * values[-1]
    whiten = vectors[:, good] / np.sqrt(values[good])
    each = np.array(languages).searchsorted(langs)
    weight = len(texts) / (np.bincount(each, minlength=len(languages)) * len(languages))
    gram, right = settings.ridge * len(texts) * np.eye(whiten.shape[1]), np.zeros((whiten.shape[1], len(languages)))
    for i in range(0, len(texts), 200):
        features = Presence(model, *joined(texts[i : i + 200])).kernel(landmarks) @ whiten
        weighted = features * weight[each[i : i + 200], None]
        gram += features.T @ weighted
        right += weighted.T @ ((each[i : i + 200, None] == np.arange(len(languages))) * 2.0 - 1)
    solved = whiten @ np.linalg.solve(gram, right)
    model.weights = np.concatenate([landmarks.columns(low, min(low + COLUMNS, len(model.keys))).T @ solved for low in range(0, len(model.keys), COLUMNS)]).astype(np.float32) if len(model.keys) else np.zeros((0, len(languages)), np.float32)
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """One fifth of the documents, by the CRC-32 of the id's text."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on a bounded sample of the labelled texts that aren't held out.

    Counts of the different texts set a hash threshold per language at three times the
    sample; below it equal texts count once and the least hashes are kept, so what
    reaches the driver is bounded by the settings, however often a row repeats.
    """
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang_col).alias("lang"), F.substring(text_col, 1, settings.longest).alias("text"), F.shiftrightunsigned(F.xxhash64(F.lit(settings.seed), F.col(id_col), F.col(text_col)), 2).alias("h"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("different"))
    counts = counts.orderBy(F.desc("n"), "lang").limit(settings.languages).collect()
    if not counts:
        return fit([], [], [], settings)
    each = lambda one, whole: max(1, min(one, whole // len(counts)))
    examples, landmarks = each(settings.examples, settings.all_examples), each(settings.landmarks, settings.all_landmarks)
    limits = docs.sparkSession.createDataFrame([(r["lang"], int(min(1.0, 3 * examples / max(r["different"], 1)) * (1 << 62))) for r in counts], "lang string, top long")
    few = rows.join(F.broadcast(limits), "lang").where("h <= top").groupBy("lang", "h").agg(F.min("text").alias("text"))
    few = few.withColumn("place", F.expr("row_number() over (partition by lang order by h)")).where(F.col("place") <= examples).collect()
    few = sorted((r["lang"], r["place"], r["text"]) for r in few)
    return fit([t.encode() for _, _, t in few], [x for x, _, _ in few], [k <= landmarks for _, k, _ in few], settings)


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for i, j in portions(offsets, 1 << 19):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                letters = np.array([bool(LETTER.search(part[a:b].tobytes().decode("utf-8", "replace"))) for a, b in zip(at[:-1].tolist(), at[1:].tolist())])
                langs, score, known = np.full(j - i, UNDETERMINED, object), np.zeros(j - i), letters
                if model.languages:
                    outputs, held = model.outputs(part, at)
                    known = letters & (held > 0)
                    likely = (np.clip(outputs, -1, 1) + 1) / 2
                    best = likely.argmax(1)
                    top = likely[np.arange(j - i), best] / np.maximum(likely.sum(1), 1e-12)
                    langs = np.where(letters, np.array(model.languages, object)[best], UNDETERMINED)
                    score = np.where(letters, top, 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("rest").slice(i, j - i), pa.array(langs.tolist(), pa.string()), pa.array(score), pa.array(known)], ["rest", "lang_pred", "score", "known"])

    return run


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and a score from 0 to 1.

    The score is the winner's share of all languages' outputs. A null text, one
    without a letter, or a model without languages gives ``und`` and 0; a text
    with letters but no known n-gram gives equal outputs, the first language by
    name and the least score. Columns of ``docs`` with the new names are
    replaced.
    """
    kept = [c for c in docs.columns if c not in (lang_pred, score)]
    out = _judged(docs, kept, model, text_col)
    return out.select(*[F.col(f"rest.`{c}`").alias(c) for c in kept], F.col("lang_pred").alias(lang_pred), F.col("score").alias(score))


def _judged(docs: DataFrame, kept: list[str], model: Model, text_col: str) -> DataFrame:
    """rest (the columns ``kept``, in a struct), lang_pred, score, and known:
    whether the text has a letter and, if any language was learned, a known n-gram."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("rest"))
    return rows.transform(arrow, lambda batches: _predict(shared.value)(batches), f"rest {rows.schema['rest'].dataType.simpleString()}, lang_pred string, score double, known boolean")


def report(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of ``docs``.

    A row without an id isn't held out. Other columns are ignored.
    """
    model = train(docs, settings, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without texts that have no letter or no known n-gram, so that no
    text in a learned language is lost, however many languages there are. If no
    row has a label, nothing is learned and only texts without a letter go."""
    model = train(docs, settings, id_col, text_col, lang_col)
    return _judged(docs, docs.columns, model, text_col).where("known").select(*[F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
