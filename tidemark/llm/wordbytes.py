"""The words of texts as byte ranges of Arrow buffers, their hashes and those of runs of them, on numpy arrays inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of texts worked on at a time in a task, and words of a text that is longer than that.
PORTION, STRETCH = 250_000, 50_000
C1, C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """The words of texts that lie one after the other in `data`: byte ranges, the text of each and each text's first word."""

    def __init__(self, data: np.ndarray, begin: np.ndarray):
        self.data = data
        space = (data == 32) | ((data >= 9) & (data <= 13))
        before, after = np.concatenate([[True], space[:-1]]), np.concatenate([space[1:], [True]])
        inner = begin[(begin > 0) & (begin < len(data))]
        before[inner], after[inner - 1] = True, True
        self.starts, self.ends = np.flatnonzero(before[: len(data)] & ~space), np.flatnonzero(after[: len(data)] & ~space) + 1
        self.doc = np.searchsorted(begin, self.starts, side="right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(begin) + 1))

    def hashes(self, low: int, high: int) -> np.ndarray:
        """64-bit hashes of the words [low, high), a portion of bytes at a time."""
        out = [np.zeros(0, dtype=np.uint64)]
        while low < high:
            stop = min(high, max(low + 1, int(np.searchsorted(self.ends, self.starts[low] + PORTION))))
            starts, ends = self.starts[low:stop], self.ends[low:stop]
            length = ends - starts
            first = np.cumsum(length) - length
            at = np.arange(length.sum()) - np.repeat(first, length)
            value = self.data[at + np.repeat(starts, length)].astype(np.uint64) + np.uint64(1)
            out.append(mixed(np.add.reduceat(value * powers(C2, int(length.max()))[at], first)))
            low = stop
        return np.concatenate(out)

    def stretches(self) -> Iterator[tuple[int, int]]:
        """Ranges of words that are worked on together."""
        yield from ((low, min(low + STRETCH, len(self.starts))) for low in range(0, len(self.starts), STRETCH))


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of the `size` words from each place on."""
    n = max(0, len(h) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = out * C1 + h[k : k + n]
    return mixed(out)


def portions(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Rows whose texts hold PORTION bytes together, or one row with a longer text, and their words."""
    for batch in batches:
        column = batch.column(text)
        kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
        offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, dtype=np.int64)
        data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
        low = 0
        while low < len(column):
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + PORTION, side="right")) - 1)
            yield batch.slice(low, high - low), Words(data[offsets[low] : offsets[high]], offsets[low:high] - offsets[low])
            low = high
    pa.default_memory_pool().release_unused()
