"""Words of Arrow text columns as flat numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Byte tables: separators become spaces, other bytes stay or lose their case.
BLANKS = np.array([32 if c == 32 or 9 <= c <= 13 else c for c in range(256)], np.uint8)
LETTERS = np.array([32 if c < 128 and not chr(c).isalnum() else c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)

_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Word k is data[start[k]:end[k]]; those of text t are first[t] to first[t+1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64-bit hashes of the words' bytes, eight bytes a step."""
        lanes = np.ndarray((len(self.data) - 7,), "<u8", self.data.tobytes(), strides=(1,))
        at, left = self.start.copy(), self.end - self.start
        h = mix(left.astype(np.uint64) + np.uint64(seed * 2 + 1) * np.uint64(0x9E3779B97F4A7C15))
        live = np.arange(len(at))
        while len(live):
            h[live] = mix(h[live] ^ (lanes[at] & _LOW_BYTES[np.minimum(left, 8)]))
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
        return h


def split(column: pa.Array, table: np.ndarray) -> Words:
    """Cuts a text column without nulls at the bytes that ``table`` makes spaces."""
    offset = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    size = int(offset[-1] - offset[0])
    data = np.zeros(size + 8, np.uint8)
    if size:
        data[:size] = table[np.frombuffer(column.buffers()[2], np.uint8)[offset[0] : offset[-1]]]
    offset -= offset[0]
    inner = np.zeros(size + 2, bool)  # inner[i + 1]: byte i belongs to a word
    inner[1:-1] = data[:size] != 32
    begins, ends = inner[1:-1] & ~inner[:-2], inner[1:-1] & ~inner[2:]
    at = offset[(offset > 0) & (offset < size)]
    begins[at] = inner[at + 1]
    ends[at - 1] = inner[at]
    start = np.flatnonzero(begins)
    return Words(data, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offset))


def batches_of(batch: pa.RecordBatch, text_col: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text, at least one row each."""
    n = batch.num_rows
    column = batch.column(text_col)
    if not n:
        return
    offset = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offset, offset[low] + limit, "right")) - 1)
        yield batch.slice(low, high - low)
        low = high
