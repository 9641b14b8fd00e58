"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on the words that set toxic
text apart. A window, one word between short stretches that don't change, is compressed twice: with the
ordinary dictionary, and with the toxic one behind it. What the second saves is the window's
distance. How many of a text's windows reach which distance is what the score is made of.
"""

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from strandline.llm.bytetext import encoded, hashed, mixed, pieces, ragged, rolling, spans

#: Labelled documents that the model is made from, at most.
TOXIC_ROWS = 1200
ORDINARY_ROWS = 3000
THRESHOLD = 0.3

_GRAMS = (5, 6, 7, 8)
_APART = 6.0  # standard deviations
_LIFT = 2.0  # times as often as in all texts
_OFTEN = 4  # times in toxic texts
_ORDINARY_BYTES, _TOXIC_BYTES = 32000, 7_600
_LEVEL = 3
_LEAD = bytes(8) + b" "
_TAIL = b" " + bytes(8)  # the library looks for no match in the last eight bytes
_FARTHEST = 11
_MOST = 4  # windows that count at one distance
_SLOTS = 20  # bits
_BYTES = np.arange(256)
_WORD = (
    (_BYTES >= 0x80)
    | ((_BYTES >= 0x30) & (_BYTES <= 0x39))
    | (((_BYTES | 0x20) >= 0x61) & ((_BYTES | 0x20) <= 0x7A))
)
_LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES | 0x20, _BYTES).astype(np.uint8)


@dataclass
class _Words:
    """The words of some texts, A-Z as a-z: bytes, places, hashes, and each text's number."""

    data: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> "_Words":
        data, places = encoded(column)
        data = _LOWER[data]
        begins, ends = spans(_WORD[data], places)
        counts = np.diff(np.searchsorted(begins, places))
        return cls(data, begins, ends, hashed(rolling(data), begins, ends), counts)

    def word(self, i: int) -> bytes:
        return self.data[self.begins[i] : self.ends[i]].tobytes()


@dataclass(frozen=True)
class Model:
    """Contents of the two dictionaries, and the weights of the distances."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters.from_level(
        _LEVEL,
        source_size=64,
        dict_size=_ORDINARY_BYTES + _TOXIC_BYTES,  # alike for both
        write_checksum=False,
        write_content_size=False,
        write_dict_id=False,
    )
    if len(content) < 8:  # nothing was learned
        return zstandard.ZstdCompressor(compression_params=settings)
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=known, compression_params=settings)


class Distances:
    """Distances of words; those met lately are remembered, a fixed number of them."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.lead = _LEAD
        self.without = _compressor(ordinary).compress
        self.with_toxic = _compressor(ordinary + toxic).compress
        self.keys = np.zeros(1 << _SLOTS, np.uint64)
        self.values = np.zeros(1 << _SLOTS, np.int8)

    def of(self, words: _Words) -> np.ndarray:
        slot = words.hashes >> np.uint64(64 - _SLOTS)
        out = self.values[slot]
        missed = np.flatnonzero(self.keys[slot] != words.hashes)
        if len(missed):
            new, first, which = np.unique(
                words.hashes[missed], return_index=True, return_inverse=True
            )
            found = np.fromiter(
                (self._one(words.word(i)) for i in missed[first].tolist()), np.int8, len(new)
            )
            out[missed] = found[which]
            at = new >> np.uint64(64 - _SLOTS)
            self.keys[at], self.values[at] = new, found
        return out

    def _one(self, word: bytes) -> int:
        window = self.lead + word + _TAIL
        return min(max(len(self.without(window)) - len(self.with_toxic(window)), 0), _FARTHEST)


@lru_cache(maxsize=1)
def _distances(ordinary: bytes, toxic: bytes) -> Distances:
    """One for each worker process, kept from task to task."""
    return Distances(ordinary, toxic)


def _features(words: _Words, distance: np.ndarray) -> np.ndarray:
    """For each text: 1, the number of windows at each distance or over it up to a limit, the
    largest distance, and the logarithm of the number of words."""
    stops = np.concatenate(([0], np.cumsum(words.counts)))
    columns = [np.ones(len(words.counts))]
    largest = np.zeros(len(words.counts))
    for least in range(1, _FARTHEST + 1):
        reached = np.diff(np.concatenate(([0], np.cumsum(distance >= least)))[stops])
        columns.append(np.minimum(reached, _MOST))
        largest[reached > 0] = least
    return np.stack([*columns, largest, np.log1p(words.counts)], axis=1)


def _apart(toxic: _Words, ordinary: _Words) -> tuple[list[bytes], np.ndarray]:
    """Words of toxic texts with n-grams that ordinary texts have far more seldom, and how often.

    A word counts once for each word before it, so that copies of a text count little.
    """

    def contexts(words: _Words) -> np.ndarray:
        before = np.concatenate((np.zeros(1, np.uint64), words.hashes[:-1]))[: len(words.hashes)]
        return np.unique(mixed(before) + words.hashes, return_index=True)[1]

    parts = [(words, contexts(words)) for words in (toxic, ordinary)]
    widths = [words.ends[at] - words.begins[at] for words, at in parts]
    text = np.concatenate(
        [words.data[ragged(words.begins[at], n)] for (words, at), n in zip(parts, widths)]
    )
    widths = np.concatenate(widths)
    keys = np.concatenate([words.hashes[at] for words, at in parts])
    is_toxic = np.arange(len(keys)) < len(parts[0][1])
    _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    n_toxic = np.bincount(which, is_toxic, len(first))
    n_all = np.bincount(which, minlength=len(first))
    # the different words, each between spaces
    begins = (np.cumsum(widths) - widths)[first]
    widths = widths[first]
    room = widths + 2
    places = np.cumsum(room) - room
    line = np.full(int(room.sum()), 0x20, np.uint8)
    line[ragged(places + 1, widths)] = text[ragged(begins, widths)]
    sums = rolling(line)
    share = is_toxic.mean() if len(keys) else 0.0
    best = np.zeros(len(first))
    for size in _GRAMS:
        each = np.maximum(room - size + 1, 0)
        at = ragged(places, each)
        owner = np.repeat(np.arange(len(first)), each)
        _, gram = np.unique(hashed(sums, at, at + size), return_inverse=True)
        t = np.bincount(gram, n_toxic[owner])
        n = np.bincount(gram, n_all[owner])
        z = (t - n * share) / np.sqrt(n * share * (1 - share) + 1)
        z[(t < _OFTEN) | (t < _LIFT * n * share)] = 0
        np.maximum.at(best, owner, z[gram])
    chosen = np.flatnonzero((best > _APART) & (n_toxic > 0))
    words = [line[places[i] + 1 : places[i] + 1 + widths[i]].tobytes() for i in chosen.tolist()]
    return words, n_toxic[chosen].astype(np.int64)


def _dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """The content of a trained dictionary; of few samples, the samples themselves."""
    try:
        return zstandard.train_dictionary(size + 600, samples, k=segment, d=6).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    out = np.zeros(x.shape[1])
    for _ in range(40):
        chance = 1 / (1 + np.exp(-np.clip(x @ out, -30, 30)))
        curve = (x * (weight * chance * (1 - chance))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        out += np.linalg.solve(curve, x.T @ (weight * (y - chance)) - 0.1 * out)
    return out


def fitted(toxic: pa.Array, ordinary: pa.Array, share: float, seed: int = 0) -> Model:
    """A model from labelled texts. ``share``: of toxic rows among all.

    Two thirds of the texts make the dictionaries; the other third calibrates the distances.
    """
    rng = np.random.default_rng(seed)
    cut = [len(texts) * 2 // 3 or len(texts) for texts in (toxic, ordinary)]
    bad, good = (_Words.of(x.slice(0, n)) for x, n in zip((toxic, ordinary), cut))
    words, counts = _apart(bad, good)
    order = rng.permutation(np.repeat(np.arange(len(words)), counts))
    windows = [b" " + words[i] + b" " for i in order.tolist()]
    lines = [b"".join(windows[i : i + 8]) for i in range(0, len(windows), 8)]
    at = np.sort(rng.choice(max(len(good.begins) - 12, 1), 60_000))
    plain = [
        good.data[good.begins[i] : good.ends[min(i + 11, len(good.ends) - 1)]].tobytes() + b" "
        for i in np.unique(at).tolist()
        if i < len(good.begins)
    ]
    model = Model(_dictionary(plain, _ORDINARY_BYTES, 32), _dictionary(lines, _TOXIC_BYTES, 16), ())
    distances = Distances(model.ordinary, model.toxic)
    rest = [x.slice(n) if n < len(x) else x for x, n in zip((toxic, ordinary), cut)]
    x, y, weight = [], [], []
    for label, texts in enumerate(reversed(rest)):
        read = _Words.of(texts)
        x.append(_features(read, distances.of(read)))
        y.append(np.full(len(texts), float(label)))
        part = share if label else 1 - share
        weight.append(np.full(len(texts), part / max(len(texts), 1)))
    total = sum(map(len, y))
    weights = _logistic(np.concatenate(x), np.concatenate(y), total * np.concatenate(weight))
    return Model(model.ordinary, model.toxic, tuple(weights.tolist()))


def _scorer(model: Model) -> Callable:
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = _distances(model.ordinary, model.toxic)
        weights = np.array(model.weights)
        for batch in pieces(batches):
            words = _Words.of(batch.column("text"))
            margin = _features(words, distances.of(words)) @ weights
            chance = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(chance)],
                names=["doc_id", "held_out", "score"],
            )

    return score


def held_out_quarter(doc_id: str = "doc_id"):
    """Whether no label is learned: the CRC-32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def learned(
    docs: DataFrame,
    labels: DataFrame,
    toxic_rows: int = TOXIC_ROWS,
    ordinary_rows: int = ORDINARY_ROWS,
) -> Model | None:
    """A model from a bounded sample of the labelled rows that are not held out, drawn by a hash
    of the id. The share of toxic rows is of all labelled rows. None where either label lacks."""
    known = labels.select(F.col("doc_id").alias("label_id"), "toxic").filter(
        F.col("toxic").isin(0, 1) & F.col("label_id").isNotNull() & ~held_out_quarter("label_id")
    )
    counts = {row["toxic"]: row["count"] for row in known.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    texts = []
    for label, most in ((1, toxic_rows), (0, ordinary_rows)):
        drawn = known.filter(F.col("toxic") == label).select("label_id").distinct()
        drawn = drawn.orderBy(F.xxhash64("label_id"), "label_id").limit(most)
        found = (
            docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
            .join(drawn, F.col("doc_id") == F.col("label_id"))
            .orderBy(F.xxhash64("doc_id"), "doc_id", "text")
            .limit(most)
            .select("text")
        )
        texts.append(found.toArrow().column("text").combine_chunks())
    if not all(map(len, texts)):
        return None
    return fitted(*texts, share=counts[1] / (counts[0] + counts[1]))


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    toxic_rows: int = TOXIC_ROWS,
    ordinary_rows: int = ORDINARY_ROWS,
) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` for each row of ``docs``.

    ``labels`` has ``doc_id`` and ``toxic``, 0 or 1; rows with another value or without an id are
    passed over. The score uses the whole text and nothing else; ``predicted`` is 1 from a score
    of ``THRESHOLD`` on. Null and empty texts have no window and the score of such. Where no row
    of either label is there to learn from, all scores are 0. Repeated rows are each scored;
    other columns are not read; an empty table gives an empty one.
    """
    rows = docs.select(
        "doc_id", held_out_quarter().alias("held_out"), F.coalesce("text", F.lit("")).alias("text")
    )
    model = learned(docs, labels, toxic_rows, ordinary_rows)
    if model is None:
        scored = rows.select("doc_id", "held_out", F.lit(0.0).alias("score"))
    else:
        kind = dict(rows.dtypes)["doc_id"]
        scored = rows.mapInArrow(_scorer(model), f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
