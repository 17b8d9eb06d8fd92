"""Token counts of greedy word pieces by a linear longest-match automaton.

The vocabulary is a trie with two roots: one for a word's first piece and one
for its later pieces. Every node has a failure link, to the node reached after
the pieces that must end before it have been popped, and the number of pieces
popped on that link. A word's length in pieces is then a walk of its bytes that
adds up popped counts; no piece is ever built. All distinct words of a batch
walk together.

Words are ``[^\\x20\\x09-\\x0D]+``. A word that the vocabulary cannot spell
counts as one unknown token.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import HashMemory, arrow, portions, prefix_hash, span_hash, text_buffer, word_spans

#: Marks a piece that starts a word in SentencePiece vocabularies.
MARK = "▁"
#: Distinct words that a task remembers.
CACHE = 1 << 20


def piece_vocabulary(path: str) -> tuple[list[str], list[str]]:
    """First and later pieces of a SentencePiece model's vocabulary.

    Control, unknown and byte pieces and pieces of marks alone are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    first, later = [], []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) or not piece.strip(MARK):
            continue
        (first if piece.startswith(MARK) else later).append(piece.removeprefix(MARK))
    return first, later


class LongestMatch:
    """The automaton. ``keys`` are node * 256 + byte, sorted, with the child in
    ``children``; ``fail`` is -1 where a word is unknown."""

    def __init__(self, first: Iterable[str], later: Iterable[str]):
        child: list[dict[int, int]] = [{}, {}]
        final = [False, False]
        for root, words in ((0, first), (1, later)):
            for word in words:
                node = root
                for byte in word.encode():
                    if byte not in child[node]:
                        child[node][byte] = len(child)
                        child.append({})
                        final.append(False)
                    node = child[node][byte]
                final[node] = node > 1
        fail, popped = np.full(len(child), -1, np.int32), np.zeros(len(child), np.int32)
        layer = [0, 1]
        while layer:
            deeper = []
            for node in layer:
                for byte, below in child[node].items():
                    deeper.append(below)
                    if final[below]:
                        fail[below], popped[below] = 1, 1
                        continue
                    back, count = int(fail[node]), int(popped[node])
                    while back >= 0 and byte not in child[back]:
                        count += int(popped[back])
                        back = int(fail[back])
                    if back >= 0:
                        fail[below], popped[below] = child[back][byte], count
            layer = deeper
        edges = sorted((node << 8 | byte, below) for node, of in enumerate(child) for byte, below in of.items())
        self.keys = np.array([k for k, _ in edges], np.int64)
        self.children = np.array([c for _, c in edges], np.int32)
        self.fail, self.popped = fail, popped

    def _step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(node), -1, np.int32)
        key = node.astype(np.int64) << 8 | byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.children[at], -1)

    def lengths(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of each word data[start:end]; -1 where a word is unknown."""
        n = len(starts)
        count, node = np.zeros(n, np.int64), np.zeros(n, np.int32)
        order = np.argsort(starts - ends, kind="stable")  # longest first
        size = (ends - starts)[order]
        base = starts[order]
        for k in range(int(size[0]) if n else 0):
            live = int(np.searchsorted(-size, -k, "left"))
            todo = np.arange(live)
            todo = todo[count[:live] >= 0]
            while len(todo):
                to = self._step(node[todo], data[base[todo] + k])
                ok = to >= 0
                node[todo[ok]] = to[ok]
                todo = self._pop(todo[~ok], node, count)
        todo = np.flatnonzero((node != 1) & (count >= 0))
        while len(todo):
            todo = self._pop(todo, node, count)
            todo = todo[node[todo] != 1]
        out = np.empty(n, np.int64)
        out[order] = count
        return out

    def _pop(self, which: np.ndarray, node: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Follow the failure links; returns those of ``which`` that go on."""
        back = self.fail[node[which]]
        dead = back < 0
        count[which] += self.popped[node[which]]
        count[which[dead]] = -1
        node[which[~dead]] = back[~dead]
        return which[~dead]


def _count(automaton: LongestMatch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = HashMemory()
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for i, j in portions(offsets):
                part = data[offsets[i] : offsets[j]]
                starts, ends, per = word_spans(part, offsets[i : j + 1] - offsets[i])
                word = span_hash(prefix_hash(part), starts, ends)
                unique, first, where = np.unique(word, return_index=True, return_inverse=True)
                known, pieces = memory.find(unique)
                new = ~known
                pieces[new] = automaton.lengths(part, starts[first[new]], ends[first[new]])
                if len(memory) > CACHE:
                    memory = HashMemory()
                memory.add(unique[new], pieces[new])
                each = pieces[where]
                owner = np.repeat(np.arange(j - i), per)
                total = np.bincount(owner, np.abs(each), j - i).astype(np.int64)
                unknown = np.bincount(owner, each < 0, j - i).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *(pa.array(x) for x in (per.astype(np.int64), total, unknown))], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str | tuple[list[str], list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown (words counted as one unknown
    token) for each row of ``docs``.

    ``vocabulary`` is the path of a SentencePiece model, read on the driver, or
    first and later pieces. Null and empty texts have no words; every row, also
    one that repeats another, gets a result; other columns are ignored.
    """
    first, later = piece_vocabulary(vocabulary) if isinstance(vocabulary, str) else vocabulary
    shared = docs.sparkSession.sparkContext.broadcast(LongestMatch(first, later))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.transform(arrow, lambda batches: _count(shared.value)(batches), "doc_id long, n_words long, n_tokens long, n_unknown long")
