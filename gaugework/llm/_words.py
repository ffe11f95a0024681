"""Vectorised word tables over Arrow batches of texts (words are runs of bytes outside 0x20, 0x09-0x0D)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
U = np.uint64
#: Bytes of text worked on at once; a longer single text is a chunk of its own.
CHUNK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit (murmur's finaliser)."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(batches: Iterable[pa.RecordBatch], text: str, limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``limit`` bytes of text each, and the texts."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        total, start = np.concatenate([[0], np.cumsum(sizes)]), 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(total, total[start] + limit, side="right")) - 1)
            part = batch.slice(start, end - start)
            yield part, texts_of(part.column(text))
            start = end


class Words:
    """The words of some texts: ``start``, ``end`` (bytes of ``buf``), ``doc`` (index of the text)."""

    def __init__(self, data: list[bytes]):
        self.n_docs = len(data)
        self.buf = np.frombuffer(b" ".join(data) + b" ", np.uint8)
        self.offset = np.zeros(len(data) + 1, np.int64)
        np.cumsum([len(x) + 1 for x in data], out=self.offset[1:])
        space = SPACE[self.buf]
        self.space = space
        before = np.empty_like(space)
        before[0], before[1:] = True, space[:-1]
        self.start = np.flatnonzero(before & ~space)
        self.end = np.flatnonzero(~before & space)
        self.doc = np.searchsorted(self.offset, self.start, side="right") - 1
        self.count = np.bincount(self.doc, minlength=self.n_docs)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a flag over the bytes of each text."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        edge = np.minimum(self.offset, len(flags))
        return total[edge[1:]] - total[edge[:-1]]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a random odd factor for each place, summed, then mixed."""
        if not len(self.start):
            return np.zeros(0, U)
        length = self.end - self.start
        factor = mix(np.arange(1, int(length.max()) + 1, dtype=U)) | U(1)
        word = np.repeat(np.arange(len(self.start)), length)
        first = np.zeros(len(length), np.int64)
        np.cumsum(length[:-1], out=first[1:])
        place = np.arange(len(word)) - first[word]
        value = (self.buf[place + self.start[word]].astype(U) + U(1)) * factor[place]
        return mix(np.add.reduceat(value, first) ^ (length.astype(U) << U(48)))

    def shingles(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text index of each run of ``k`` words; a text with 1 to k-1 words gives its whole run."""
        out, doc = windows(h, self.doc, k)
        short = np.flatnonzero((self.count > 0) & (self.count < k))
        if len(short):
            first = np.searchsorted(self.doc, short)
            whole = np.full(len(short), 0x5157, U)
            for i in range(k - 1):
                live = self.count[short] > i
                whole[live] = mix(whole[live] * U(0x9E3779B97F4A7C15) + h[first[live] + i])
            out, doc = np.concatenate([out, whole]), np.concatenate([doc, short])
        return out, doc


def windows(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``k`` items that stays within a text, and its text; run i starts at item i of those kept."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    w = np.full(n, 0x5157, U)
    for i in range(k):
        w = mix(w * U(0x9E3779B97F4A7C15) + h[i : i + n])
    inside = doc[:n] == doc[k - 1 :]
    return w[inside], doc[:n][inside]
