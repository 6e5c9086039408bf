"""Words of Arrow text batches as numpy arrays, in groups of bounded size.

A word is a longest run of bytes other than space and the five ASCII control spaces (9 to 13). Texts arrive as
binary columns: their bytes are one buffer, and a group of documents is a slice of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

GROUP_BYTES = 1 << 21
# Words of so many bytes are hashed at a time: numbers of eight bytes each, which stay in a processor's cache.
HASH_BYTES = 1 << 15


def groups(column: pa.Array, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into them) for runs of rows of about ``limit`` bytes.

    A row longer than ``limit`` is a group of its own, whole. A null text has no bytes.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"")
    rows = len(column)
    if not rows:
        return
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, at, values = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + rows + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, np.uint8)
    first = 0
    while first < rows:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(rows, max(first + 1, end))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    capital = (data - np.uint8(65)) < 26
    return data + (capital.view(np.uint8) << np.uint8(5))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document number) of all words; a document's end also ends a word."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    solid = (data - np.uint8(9)) > 4
    solid &= data != 32
    opens, shuts = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    shuts[:-1] &= ~solid[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    opens[cuts] = solid[cuts]
    shuts[cuts - 1] = solid[cuts - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))


@lru_cache(maxsize=16)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    def table(factor: int) -> np.ndarray:
        steps = np.full(size, factor, dtype=np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)

    return table(base), table(pow(base, -1, 1 << 64))


def mix(values: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit values (an invertible finaliser)."""
    values = values.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        values ^= values >> np.uint64(shift)
        values *= np.uint64(factor)
    values ^= values >> np.uint64(31)
    return values


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in the odd ``base`` over its bytes, then mixed."""
    made = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        end = max(first + 1, int(np.searchsorted(starts, starts[first] + HASH_BYTES)))
        low, high = int(starts[first]), int(ends[end - 1])
        size = HASH_BYTES
        while size < high - low:
            size *= 2
        up, down = _powers(base, size)
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.add(data[low:high], np.uint64(1), out=sums[1:])
        sums[1:] *= up[: high - low]
        np.cumsum(sums[1:], out=sums[1:])
        own, own_ends = starts[first:end] - low, ends[first:end] - low
        made[first:end] = mix((sums[own_ends] - sums[own]) * down[own] + (own_ends - own).astype(np.uint64))
        first = end
    return made


def word_lists(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of one text in lists of at most about ``size`` bytes, so that a very long text stays bounded."""
    if len(data) <= size:
        yield data.split()
        return
    at = 0
    while at < len(data):
        end = at + size
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield data[at:end].split()
        at = end
