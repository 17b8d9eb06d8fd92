"""SentencePiece encoding and decoding with a batched Viterbi search in numpy.

A text is divided where no piece can cross: before each run of spaces, and on
both sides of a byte that is in no piece. The distinct units of a batch are
grouped by length in bytes; all units of a length advance together. For every
end, the hashes of the substrings from all starts before it probe the sorted
hashes of the pieces, and a vectorised maximum over the starts stores the best
score, the piece and the back pointer. Characters without a piece fall back to
byte pieces, at a score below every other.

Scores are those of the model file, taken as unigram scores and added exactly
in float64; of equal sums the one whose last piece is longest wins, then so on
to the left. A space stands for the model's mark, and so does the mark itself;
one space is put before a text and taken off again when decoding. For a unigram
model the ids are the library's; a model of merges (BPE) is segmented by the best
sum of its scores too, which need not be its sequence of merges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import U64, HashMemory, Powers, arrow, group_starts, mix64, portions, prefix_hash, ragged, span_hash, text_buffer

MARK = "▁"
SPACE = 0x20
UNKNOWN_PENALTY = 10.0
#: Distinct units that a worker remembers between batches.
CACHE = 1 << 19


class Codec:
    """The model's pieces as arrays. ``hashes`` are sorted; ``ids`` and
    ``scores`` go with them. ``text`` and ``ends`` hold the pieces by id."""

    def __init__(self, pieces: list[tuple[int, str, float]], byte_ids: list[int], size: int):
        raw = [p.replace(MARK, " ").encode() for _, p, _ in pieces]
        for p in raw:
            if b" " in p.lstrip(b" "):
                raise ValueError("a piece with a space inside can't be divided at spaces")
        data = np.frombuffer(b"".join(raw), np.uint8)
        lengths = np.array([len(p) for p in raw], np.int64)
        ends = np.cumsum(lengths)
        self.hashes = self._hash(data, ends - lengths, ends)
        order = np.argsort(self.hashes)
        self.hashes = self.hashes[order]
        self.ids = np.array([i for i, _, _ in pieces], np.int32)[order]
        self.scores = np.array([s for _, _, s in pieces])[order]
        self.longest = int(lengths.max())
        self.present_shift = U64(64 - 21)
        self.present = np.zeros(1 << 21, bool)
        self.present[(self.hashes >> self.present_shift).astype(np.int64)] = True
        self.unknown = float(self.scores.min()) - UNKNOWN_PENALTY
        self.alone = np.ones(256, bool)
        self.alone[np.unique(data)] = False
        self.alone[0x80:] = False
        self.byte_ids = np.array(byte_ids, np.int32)
        self.bits = max(4, int(np.ceil(np.log2(len(pieces)))) + 2)
        bucket = (self.hashes >> U64(64 - self.bits)).astype(np.int64)
        self.bucket = np.searchsorted(bucket, np.arange(1 << self.bits)).astype(np.int32)
        self.deepest = int(np.bincount(bucket).max())
        by_id = [b""] * size
        for (i, _, _), p in zip(pieces, raw):
            by_id[i] = p
        for byte, i in enumerate(byte_ids):
            by_id[i] = bytes([byte])
        self.text = np.frombuffer(b"".join(by_id), np.uint8)
        self.ends = np.cumsum([0, *map(len, by_id)])
        self.digest = hashlib.sha256(b"".join([self.text.tobytes(), self.ends.tobytes(), self.hashes.tobytes(), self.ids.tobytes(), self.scores.tobytes(), self.byte_ids.tobytes()])).hexdigest()

    @classmethod
    def load(cls, path: str) -> Codec:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        pieces = [(i, m.id_to_piece(i), m.get_score(i)) for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        return cls(pieces, [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)], n)

    @staticmethod
    def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return span_hash(prefix_hash(data), starts, ends) ^ (ends - starts).astype(U64)

    def _probe(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash among the pieces, or -1."""
        at = self.bucket[(hashes >> U64(64 - self.bits)).astype(np.int64)]
        out = np.full(len(hashes), -1, np.int32)
        for k in range(self.deepest):
            here = np.minimum(at + k, len(self.hashes) - 1)
            hit = self.hashes[here] == hashes
            out[hit] = here[hit]
        return out

    def viterbi(self, data: np.ndarray, prefix: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units of one length, and how many each has. ``prefix`` is
        the prefix hash of ``data``."""
        n = len(starts)
        _, down = Powers.upto(len(prefix))
        place = np.arange(length + 1)[:, None] + starts
        lead = np.ones((length + 1, n), bool)
        lead[:-1] = (data[place[:-1]] & 0xC0) != 0x80
        sums, scale = prefix[place], down[place]
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        piece = np.full((length + 1, n), -1, np.int32)
        back = np.zeros((length + 1, n), np.int32)
        rows, char = np.arange(n), np.zeros(n, np.int32)
        for end in range(1, length + 1):
            char = np.where(lead[end - 1], end - 1, char)
            whole = lead[end]
            best[end] = np.where(whole, best[char, rows] + self.unknown, -np.inf)
            back[end] = char
            first = max(0, end - self.longest)
            hashes = mix64((sums[end] - sums[first:end]) * scale[first:end])
            hashes ^= np.arange(end - first, 0, -1, dtype=U64)[:, None]
            maybe = self.present[(hashes >> self.present_shift).astype(np.int64)] & whole & lead[first:end]
            start, unit = np.nonzero(maybe)
            at = self._probe(hashes[start, unit])
            start, unit, at = start[at >= 0] + first, unit[at >= 0], at[at >= 0]
            value = best[start, unit] + self.scores[at]
            order = np.lexsort((start, -value, unit))  # of equal sums the longest last piece
            start, unit, at, value = start[order], unit[order], at[order], value[order]
            top = group_starts(unit)
            top = top[value[top] >= best[end, unit[top]]]
            best[end, unit[top]], piece[end, unit[top]], back[end, unit[top]] = value[top], self.ids[at[top]], start[top]
        steps_unit, steps_from, steps_to, steps_piece = [], [], [], []
        at, live = np.full(n, length), rows
        while len(live):
            to = at[live]
            of = back[to, live]
            steps_unit.append(live)
            steps_from.append(of)
            steps_to.append(to)
            steps_piece.append(piece[to, live])
            at[live] = of
            live = live[of > 0]
        unit, low, high, ids = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (steps_unit, steps_from, steps_to, steps_piece))
        order = np.lexsort((low, unit))
        unit, low, high, ids = unit[order], low[order].astype(np.int64), high[order], ids[order]
        width = np.where(ids < 0, high - low, 1)
        out = np.repeat(ids, width)
        unknown = np.repeat(ids < 0, width)
        out[unknown] = self.byte_ids[data[ragged(starts[unit] + low, width)[unknown]]]
        return out.astype(np.int32), np.bincount(unit, width, n).astype(np.int64)

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the units of texts that begin with a space each."""
        space = data == SPACE
        alone = self.alone[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        return edges[:-1], edges[1:]

    def encode(self, data: np.ndarray, offsets: np.ndarray, memory: Memory | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and the number of each text."""
        data, offsets = with_space(data, offsets)
        memory = memory or Memory()
        starts, ends = self.units(data, offsets)
        prefix = prefix_hash(data)
        hashes = span_hash(prefix, starts, ends) ^ (ends - starts).astype(U64)
        unique, first, where = np.unique(hashes, return_index=True, return_inverse=True)
        new = np.flatnonzero(~memory.known(unique))
        length = (ends - starts)[first[new]]
        order = np.argsort(length, kind="stable")
        new, length = new[order], length[order]
        ids, counts, keys = [], [], []
        for a, b in zip(s := group_starts(length), [*s[1:], len(length)]):
            step = max(1, (1 << 19) // int(length[a]))
            for c in range(a, b, step):
                some = new[c : min(b, c + step)]
                made, n = self.viterbi(data, prefix, starts[first[some]], int(length[a]))
                ids.append(made)
                counts.append(n)
                keys.append(unique[some])
        memory.add(keys, ids, counts)
        begin, count = memory.spans(unique)
        each = count[where]
        tokens = memory.ids.data[ragged(begin[where], each)]
        upto = np.concatenate([[0], np.cumsum(each)])
        per_text = np.diff(upto[np.searchsorted(starts, offsets)])
        memory.trim()
        return tokens, per_text

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts and their offsets; the first space of each goes."""
        lengths = self.ends[ids + 1] - self.ends[ids]
        data = self.text[ragged(self.ends[ids], lengths)]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        offsets = upto[np.concatenate([[0], np.cumsum(counts)])]
        full = np.flatnonzero(np.diff(offsets) > 0)
        keep = np.ones(len(data), bool)
        head = offsets[full]
        keep[head[data[head] == SPACE]] = False
        cut = np.concatenate([[0], np.cumsum(keep)])
        return data[keep], cut[offsets]


class Memory:
    """Ids of units seen before, by 64-bit hash: that two of a worker's half a
    million units collide has a probability of 1e-8, and the round trip shows it."""

    def __init__(self):
        self.place = HashMemory()
        self.begin, self.count, self.ids = Growing(np.int64), Growing(np.int32), Growing(np.int32)

    def known(self, keys: np.ndarray) -> np.ndarray:
        return self.place.find(keys)[0]

    def add(self, keys: list, ids: list, counts: list) -> None:
        if not keys:
            return
        count = np.concatenate(counts)
        self.place.add(np.concatenate(keys), np.arange(len(count)) + self.begin.size)
        self.begin.add(self.ids.size + np.cumsum(count) - count)
        self.count.add(count)
        self.ids.add(np.concatenate(ids))

    def spans(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.place.find(keys)[1]
        return self.begin.data[at], self.count.data[at].astype(np.int64)

    def trim(self) -> None:
        if len(self.place) > CACHE or self.ids.size > 8 * CACHE:
            self.__init__()


class Growing:
    def __init__(self, kind: type):
        self.data, self.size = np.zeros(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.data):
            data = np.zeros(2 * need, self.data.dtype)
            data[: self.size] = self.data[: self.size]
            self.data = data
        self.data[self.size : need] = values
        self.size = need


def with_space(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a space put before each that isn't empty; marks become spaces."""
    mark = np.frombuffer(MARK.encode(), np.uint8)
    if len(data) > 2:
        at = np.flatnonzero((data[:-2] == mark[0]) & (data[1:-1] == mark[1]) & (data[2:] == mark[2]))
        if len(at):
            data, keep = data.copy(), np.ones(len(data), bool)
            data[at] = SPACE
            keep[at + 1] = keep[at + 2] = False
            data, offsets = data[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]
    extra = np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])
    out = np.full(len(data) + int(extra[-1]), SPACE, np.uint8)
    place = np.arange(len(data)) + np.repeat(extra[1:], np.diff(offsets))
    out[place] = data
    return out, offsets + extra


_remembered: dict[str, Memory] = {}


def _memory(codec: Codec) -> Memory:
    """What this worker knows of the model with these very pieces; of one model at a time."""
    if codec.digest not in _remembered:
        _remembered.clear()
        _remembered[codec.digest] = Memory()
    return _remembered[codec.digest]


def _encode_all(codec: Codec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _memory(codec)  # a worker's tasks share it
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for i, j in portions(offsets, 1 << 21):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                ids, counts = codec.encode(part, at, memory)
                back, edge = codec.decode(ids, counts)
                want, want_edge = with_space(part, at)
                ends = np.concatenate([[0], np.cumsum(counts)])
                sha, same = [], []
                for k in range(j - i):
                    sha.append(hashlib.sha256(ids[ends[k] : ends[k + 1]].astype("<i4").tobytes()).hexdigest())
                    same.append(bool(np.array_equal(back[edge[k] : edge[k + 1]], want[want_edge[k] + (want_edge[k] < want_edge[k + 1]) : want_edge[k + 1]])))
                fallback = np.isin(ids, codec.byte_ids)
                pieces = np.diff(np.concatenate([[0], np.cumsum(fallback)])[ends])
                column = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("rest").slice(i, j - i), pa.array(counts), pa.array(pieces), pa.array(sha), pa.array(same, pa.bool_()), column], ["rest", "n_tokens", "n_byte_tokens", "ids_sha256", "round_trip", "ids"])

    return run


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids_sha256 (of the ids as little-endian
    32-bit), round_trip (the ids decode to the text) and ids, for each row.

    ``model`` is the path of a SentencePiece model with byte pieces, read on the
    driver. Null and empty texts have no tokens and make the round trip. Other
    columns are ignored.
    """
    codec = docs.sparkSession.sparkContext.broadcast(Codec.load(model))
    rows = docs.select(F.struct(F.col(id_col).cast("long").alias("doc_id")).alias("rest"), F.col(text_col).alias("text"))
    out = rows.transform(arrow, lambda batches: _encode_all(codec.value)(batches), "rest struct<doc_id: bigint>, n_tokens long, n_byte_tokens long, ids_sha256 string, round_trip boolean, ids array<int>")
    return out.select("rest.doc_id", "n_tokens", "n_byte_tokens", "ids_sha256", "round_trip", "ids")


def decode_documents(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows of ids; null ids give null."""
    codec = encoded.sparkSession.sparkContext.broadcast(Codec.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, edge = codec.value.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
            texts = [None if null else data[a:b].tobytes().decode("utf-8", "replace") for a, b, null in zip(edge[:-1], edge[1:], lists.is_null().to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).transform(arrow, run, "doc_id long, text string")
