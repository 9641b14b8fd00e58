"""Texts of an Arrow batch as byte arrays, for functions that run inside tasks."""

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Text bytes worked on at a time; a longer text is a piece of its own.
PIECE_BYTES = 2_000_000

_ODD = 0x9E3779B97F4A7C15 | 1
_WRAP = (1 << 64) - 1


def pieces(
    batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, cut so that ``column`` holds about ``limit`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(lengths(batch.column(column)))
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last


def lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each text; null counts as empty."""
    return np.diff(encoded(column)[1])


def encoded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, end to end, and the places where each begins and ends."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, places, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    places = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), places - places[0]
    data = np.frombuffer(data, np.uint8)[places[0] : places[-1]]
    return data, places - places[0]


def spans(inside: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of true values; a run never crosses a text's end."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(inside) + 1, bool)
    edge[places] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def ragged(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, ..., ``sizes[0]`` numbers in all; then the same for the next."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(begins - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    return np.arange(total, dtype=np.int64) + shift


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def rising(base: int) -> np.ndarray:
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)

    return rising(_ODD), rising(pow(_ODD, -1, 1 << 64))


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0, 1, ... of an odd number modulo 2**64, and of its inverse."""
    up, down = _powers(1 << max(10, (size + 1).bit_length()))
    return up[: size + 1], down[: size + 1]


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, _WRAP, 256, np.uint64, endpoint=True)


_BYTE = _table(7)


def rolling(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``hashed`` reads the hash of any stretch of ``data``."""
    up, _ = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return sums


def hashed(sums: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches; equal stretches have equal hashes wherever they lie."""
    _, down = powers(len(sums))
    return mixed((sums[ends] - sums[begins]) * down[begins])


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit numbers whose low and high bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
