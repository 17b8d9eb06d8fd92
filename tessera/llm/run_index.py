"""A run-length Burrows-Wheeler index of a sequence with self-matching statistics.

The suffix array (prefix doubling on the ties only) gives the Burrows-Wheeler
transform, of which the runs are kept: their symbols, lengths, and the text
positions sampled at both ends of each run. Inside a run the common prefix of
neighbouring suffixes shrinks by exactly one from a text position to the next,
so only run ends need a comparison of texts; from those samples the matching
statistics of the whole text against the rest of itself stream out in one pass
of running maxima per direction.
"""

from __future__ import annotations

import numpy as np

from tessera.llm.common import U64

#: Never part of UTF-8; divides the texts of an index.
SEPARATOR = 0xFF


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of bytes, or of symbols of any integer type."""
    n = len(text)
    if text.dtype == np.uint8:
        padded = np.zeros(n + 8, U64)
        padded[:n] = text
        padded[:n] += U64(1)
        padded[:n] -= (padded[:n] > U64(255)).astype(U64)  # the separator keeps 255
        key, depth = np.zeros(n, U64), 8
        for k in range(8):
            key <<= U64(8)
            key |= padded[k : k + n]
    else:
        key, depth = np.unique(text, return_inverse=True)[1].astype(U64), 1
    order = np.argsort(key)
    rank = np.empty(n, np.int64)
    slots = np.arange(n)
    key = key[order]
    while True:
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(key)))
        rank[order[slots]] = np.repeat(slots[first], size)
        tied = np.repeat(size > 1, size)
        slots = slots[tied]
        if not len(slots):
            return order
        here = order[slots]
        after = here + depth
        key = (rank[here].astype(U64) << U64(32)) | np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0).astype(U64)
        sort = np.argsort(key)
        order[slots], key = here[sort], key[sort]
        depth *= 2


class RunLengthIndex:
    """``heads[r]`` and ``tails[r]`` are the text positions of the suffixes at
    the first and last row of run r; ``symbols`` and ``lengths`` are the runs."""

    def __init__(self, text: np.ndarray):
        self.text, n = text, len(text)
        order = suffix_array(text)
        before = text[order - 1].astype(np.int64)
        before[order == 0] = -1
        first = np.ones(n, bool)
        first[1:] = before[1:] != before[:-1]
        rows = np.flatnonzero(first)
        self.symbols = before[rows]
        self.lengths = np.diff(np.append(rows, n))
        self.heads = order[rows]
        self.tails = order[np.append(rows[1:], n) - 1]

    def common_prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of suffixes a[i] and b[i]."""
        text, n = self.text, len(self.text)
        step = 8 if text.dtype == np.uint8 else 1
        wide = np.lib.stride_tricks.sliding_window_view(np.append(text, np.zeros(step, text.dtype)), step)
        out = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            fits = np.maximum(x, y) < n
            live, x, y = live[fits], x[fits], y[fits]
            same = wide[x] == wide[y]
            whole = same.all(1)
            run = np.where(whole, step, np.argmin(same, 1))
            out[live] += np.minimum(run, n - np.maximum(x, y))
            live = live[whole]
        return out

    def self_statistics(self) -> np.ndarray:
        """For each text position the length of the longest string that starts
        there and also somewhere else."""
        n = len(self.text)
        here = np.arange(n)
        shared = self.common_prefix(self.heads[1:], self.tails[:-1])
        down, up = np.zeros(n, np.int64), np.zeros(n, np.int64)
        down[self.heads[0]] = self.heads[0]
        down[self.heads[1:]] = shared + self.heads[1:]
        up[self.tails[-1]] = self.tails[-1]
        up[self.tails[:-1]] = shared + self.tails[:-1]
        return np.maximum(np.maximum.accumulate(down), np.maximum.accumulate(up)) - here


def repeated_starts(texts: np.ndarray, offsets: np.ndarray, width: int, separator: int) -> np.ndarray:
    """Whether a string of ``width`` symbols starts at each position of the
    concatenated texts that also starts anywhere else within a text."""
    sizes = np.diff(offsets)
    joined = np.full(len(texts) + len(sizes), separator, texts.dtype)
    place = np.arange(len(texts)) + np.repeat(np.arange(len(sizes)), sizes)
    joined[place] = texts
    found = RunLengthIndex(joined).self_statistics()[place]
    room = np.repeat(offsets[1:], sizes) - np.arange(len(texts))
    return np.minimum(found, room) >= width
