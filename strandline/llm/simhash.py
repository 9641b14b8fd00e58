"""SimHash fingerprints of texts, for tasks."""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

from strandline.llm.bytetext import encoded, pieces

SHINGLE_WORDS = 4
SEED = 42

_LOW_BITS = np.uint64(0x0101010101010101)
_MOST = 255  # additions until a byte lane is full


def shingle_hashes(text: bytes, words: int = SHINGLE_WORDS) -> list[int]:
    """XXH64 of each run of ``words`` words joined by spaces; of all words where fewer."""
    tokens = text.lower().split()
    if not tokens:
        return []
    line = b" ".join(tokens)
    begins, at = [], 0
    for token in tokens:
        begins.append(at)
        at += len(token) + 1
    if len(tokens) <= words:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = begins[words:]
    ends.append(at)
    digest = xxhash.xxh64_intdigest
    return [digest(line[a : b - 1], SEED) for a, b in zip(begins, ends)]


def majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each group of consecutive hashes, the bits set in over half of them; 0 if none.

    Bits are added in eight byte lanes of a 64-bit word, at most 255 rows at a time.
    """
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    sizes = counts[full]
    firsts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    parts = -(-sizes // _MOST)
    owner = np.repeat(np.arange(len(full)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    cuts = firsts[owner] + nth * _MOST
    heads = np.cumsum(parts) - parts
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LOW_BITS, cuts)
        for byte in range(8):
            lane = (lanes >> np.uint64(8 * byte)) & np.uint64(255)
            total = np.add.reduceat(lane.astype(np.int64), heads)
            out[full] |= (2 * total > sizes).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``text`` replaced by ``bits``, its fingerprint as a signed long; other columns as before."""
    for batch in pieces(batches):
        data, places = encoded(batch.column("text"))
        raw = data.tobytes()
        bounds = places.tolist()
        found: list[int] = []
        counts = []
        for a, b in zip(bounds, bounds[1:]):
            own = shingle_hashes(raw[a:b])
            found += own
            counts.append(len(own))
        bits = majorities(np.array(found, np.uint64), np.array(counts, np.int64))
        names = [name for name in batch.schema.names if name != "text"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(name) for name in names] + [pa.array(bits.view(np.int64))],
            names=[*names, "bits"],
        )
