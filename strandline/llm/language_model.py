"""Language-model scores from a Bloom filter that holds logarithms of n-gram counts.

An n-gram with the quantised logarithm q of its count is in the filter q times, with the numbers
1 to q beside it. Asking for 1, 2, 3, ... until the answer is no gives q back; a wrong yes is rare
and each makes q one larger at most. How much a history leaves to shorter ones is held likewise.

All n-grams of training are held, so the filter grows with the corpus; it is dealt out to shards by
the n-grams' first words. Every piece of the corpus sends each shard the tree of its distinct
n-grams there, with their counts in training, and gets back what the shard's filter says of them.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strandline.llm.bytetext import encoded, hashed, mixed, pieces, rolling, spans
from strandline.plans.storage import discard, scratch_path, stored_at

ORDER = 3
#: ``train``: an n-gram is in the filter if it is one of so many tokens of training, or more often.
#: So there are no more of any order than this, however large the corpus is.
FREQUENT = 1 << 20
#: Tokens of training a shard has about, and the least number of shards (a power of 2).
SHARD = 1 << 20
SHARDS = 32
#: Words that are one of so many tokens of training, or more often, don't choose a shard.
HOT = 256
#: A token is exactly known to every task if it is one of so many, or more often, and
#: has this many bytes at most. All others are counted by a join.
KNOWN = 100_000
KNOWN_BYTES = 64
#: Counts of an order's n-grams by hash, before they are counted exactly.
SKETCH = 1 << 22

BASE = 1.5
DISCOUNT = 0.75
_RATIO = 1.25  # between neighbouring quantised shares that a history leaves over
_LEAST = 1e-3
_BITS = 12  # for each entry
_HASHES = 4
_PIECE = 3_000_000
_AT_ONCE = 1 << 18  # keys, so that what is worked on stays small
_SLICES = 64

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 0x41) & (_BYTES <= 0x5A)
_LOWER = np.where(_UPPER, _BYTES + 0x20, _BYTES).astype(np.uint8).tobytes()
_INSIDE = (~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))).tobytes()

_BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"

_MIX = np.uint64(0xD6E8FEB86659FD93)
_STEP = 0xA0761D6478BD642F
_LEFT = np.uint64(0x5851F42D4C957F2D)
_END = np.uint64(0xE7037ED1A0B428DB)


@dataclass
class _Tokens:
    """Tokens of some texts: distinct words, and for each text its words and one end, in a row."""

    words: pa.Array
    codes: np.ndarray  # the end's is the number of words
    firsts: np.ndarray  # of each text, and of what follows the last

    @classmethod
    def of(cls, column: pa.Array) -> "_Tokens":
        data, places = encoded(column)
        raw = data.tobytes()
        begins, ends = spans(np.frombuffer(raw.translate(_INSIDE), bool), places)
        starts = np.zeros(len(begins) + 1, np.int64)
        np.cumsum(ends - begins, out=starts[1:])
        packed = raw.translate(_LOWER, _BLANKS)
        buffers = [None, pa.py_buffer(starts), pa.py_buffer(packed)]
        words = pa.Array.from_buffers(pa.large_string(), len(begins), buffers)
        known = words.dictionary_encode()
        firsts = np.searchsorted(begins, places) + np.arange(len(places))
        codes = np.full(firsts[-1], len(known.dictionary), np.int64)
        text = np.repeat(np.arange(len(places) - 1), np.diff(firsts) - 1)
        codes[np.arange(len(begins)) + text] = known.indices.to_numpy(zero_copy_only=False)
        return cls(known.dictionary, codes, firsts)

    def keys(self) -> np.ndarray:
        """A number for each distinct word, and the end's."""
        return np.append(word_keys(self.words), _END)

    def texts(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.firsts) - 1), np.diff(self.firsts))


def word_keys(words: pa.Array) -> np.ndarray:
    data, places = encoded(words)
    return hashed(rolling(data), places[:-1], places[1:])


def _longer(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The number of an n-gram, from those of its history and its last word."""
    return mixed(history * _MIX + word)


def _held(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(keys), bool)
    order = np.argsort(keys)  # neighbours are found near each other
    ordered = keys[order]
    held = np.empty(len(keys), bool)
    held[order] = among[np.minimum(np.searchsorted(among, ordered), len(among) - 1)] == ordered
    return held


class _Grams:
    """The n-grams of a piece's tokens, order by order, only such as may be frequent.

    Each token ends one of each order. The first word follows the end; nothing goes back further.
    """

    def __init__(self, tokens: _Tokens):
        self.keys = tokens.keys()
        self.word = self.keys[tokens.codes]
        self.codes = tokens.codes
        self.nth = np.arange(len(self.codes)) - np.repeat(tokens.firsts[:-1], np.diff(tokens.firsts))
        self.gram, self.order = self.word, 1

    def grow(self, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next order: where the history and all but the first word are held.

        ``held`` tells which of this order's n-grams are. Returns the places and the histories.
        """
        before = np.empty_like(self.gram)
        before[1:], before[:1] = self.gram[:-1], _END
        fits = held.copy()
        fits[1:] &= held[:-1]
        if self.order == 1:
            before[self.nth == 0] = _END
            fits[:1] = held[:1]
        else:
            fits &= self.nth >= self.order - 1
        at = np.flatnonzero(fits)
        history = before[at]
        gram = np.zeros_like(self.gram)
        gram[at] = _longer(history, self.word[at])
        self.gram, self.order = gram, self.order + 1
        return at, history


_ONE_BIT = (1 << np.arange(8)).astype(np.uint8)


def _step(level: int) -> np.uint64:
    return np.uint64(level * _STEP & (1 << 64) - 1)


class CountFilter:
    """A Bloom filter of (key, 1), ..., (key, q) for every key with the number q."""

    def __init__(self, keys: np.ndarray, levels: np.ndarray, bits: int | None = None):
        entries = max(1, int(levels.sum()))
        self.bits = max(10, int(entries * (bits or _BITS) - 1).bit_length())
        self.table = np.zeros(1 << (self.bits - 3), np.uint8)
        self.most = int(levels.max(initial=0))
        for first in range(0, len(keys), _AT_ONCE):
            some, rest = keys[first : first + _AT_ONCE], levels[first : first + _AT_ONCE]
            for level in range(1, int(rest.max(initial=0)) + 1):
                reached = rest >= level
                some, rest = some[reached], rest[reached]
                for at in self._places(some, level):
                    bit = np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)
                    np.bitwise_or.at(self.table, at >> np.uint64(3), bit)

    def _places(self, keys: np.ndarray, level: int) -> Iterator[np.ndarray]:
        x = mixed(keys + _step(level))
        step = (x >> np.uint64(32)) | np.uint64(1)
        mask = np.uint64((1 << self.bits) - 1)
        for _ in range(_HASHES):
            yield x & mask
            x = x + step

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, found by asking for one more until the answer is no."""
        if len(keys) > _AT_ONCE:
            return np.concatenate([self(keys[i : i + _AT_ONCE]) for i in range(0, len(keys), _AT_ONCE)])
        found = np.zeros(len(keys), np.int64)
        rest = np.arange(len(keys))
        for level in range(1, self.most + 1):
            asked, yes = keys[rest], np.arange(len(rest))
            x = mixed(asked + _step(level))
            step = (x >> np.uint64(32)) | np.uint64(1)
            mask = np.uint64((1 << self.bits) - 1)
            for _ in range(_HASHES):
                at = (x & mask).view(np.int64)
                here = np.flatnonzero(self.table[at >> 3] & _ONE_BIT[at & 7])
                x, step, yes = x[here] + step[here], step[here], yes[here]
            rest = rest[yes]
            if not len(rest):
                break
            found[rest] = level
        return found


@dataclass
class Model:
    """What the tasks need: the filter, and a few sums over the training texts."""

    counts: CountFilter
    least: int
    order: int
    tokens: int
    distinct: int
    rare: float  # mean count of the tokens that are not in the filter

    def count(self, keys: np.ndarray) -> np.ndarray:
        """Counts as held, 0 for those that aren't: the middle of the quantised range."""
        return _middles(self.least, self.counts.most)[self.counts(keys)]

    def left(self, histories: np.ndarray) -> np.ndarray:
        """The share that histories leave to shorter ones; 1 if nothing is known of them."""
        return _RATIO ** -self.counts(histories ^ _LEFT).astype(float)

    def probabilities(self, tokens: _Tokens) -> np.ndarray:
        """Of every token, after those before it."""
        grams = _Grams(tokens)
        own = self.count(grams.keys)
        known = own > 0
        single = (np.where(known, own, self.rare) + 0.1) / (self.tokens + 0.1 * (self.distinct + 1))
        chance = single[tokens.codes]
        left = self.left(grams.keys)[tokens.codes]
        count, held = own[tokens.codes], known[tokens.codes]
        for order in range(2, self.order + 1):
            ends = tokens.codes == len(tokens.words)
            if order == 2:  # every token has a history of one, if only the end
                old_left, old_count = np.empty_like(left), np.empty_like(count)
                end = len(grams.keys) - 1
                old_left[1:], old_count[1:] = left[:-1], count[:-1]
                old_left[:1], old_count[:1] = self.left(grams.keys[end:])[0], own[end]
                usable = old_count > 0
            else:
                old_left, old_count = np.ones_like(left), np.zeros_like(count)
                old_left[1:], old_count[1:] = left[:-1], count[:-1]
                usable = (grams.nth >= order - 2) & (old_count > 0)
            at, _ = grams.grow(held)
            keys, where = np.unique(grams.gram[at], return_inverse=True)
            seen = self.count(keys)[where]
            count = np.zeros_like(count)
            count[at] = seen
            chance = np.where(usable, chance * old_left, chance)
            gain = at[usable[at] & (seen > 0)]
            whole = np.maximum(old_count[gain], count[gain])
            chance[gain] += np.maximum(count[gain] - DISCOUNT, 0) / whole
            held = count > 0
            if order < self.order:
                left = np.ones_like(left)
                inside = np.flatnonzero(held & ~ends)
                keys, where = np.unique(grams.gram[inside], return_inverse=True)
                left[inside] = self.left(keys)[where]
        return np.minimum(chance, 1.0)


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, limit=_PIECE):
        tokens = _Tokens.of(piece.column("text"))
        n = np.bincount(tokens.codes, minlength=len(tokens.words) + 1)
        yield pa.RecordBatch.from_arrays(
            [tokens.words.cast(pa.string()), pa.array(n[:-1], pa.int64())], names=["word", "n"]
        )


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = word_keys(batch.column("word")).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column("n")], names=["key", "n"])


def _candidates(tokens: _Tokens, known: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """N-grams one longer than those known, all parts of which are known; and their histories."""
    grams = _Grams(tokens)
    held = _held(grams.keys, known[0])[tokens.codes]
    for more in known[1:]:
        at, _ = grams.grow(held)
        held = np.zeros(len(held), bool)
        held[at] = _held(grams.gram[at], more)
    at, history = grams.grow(held)
    return grams.gram[at], history


def _sketcher(known: list[np.ndarray], size: int):
    """The Arrow function that counts candidates by hash; each task sends slices of counts.

    Bytes of the counts of one significance lie together, so that they pack well.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for piece in pieces(batches, limit=_PIECE):
            grams, _ = _candidates(_Tokens.of(piece.column("text")), known)
            np.add.at(counts, (grams % np.uint64(size)).view(np.int64), 1)
        if not counts.any():
            return
        for i, part in enumerate(np.array_split(counts, _SLICES)):
            planes = part.view(np.uint8).reshape(-1, 8).T.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.array([planes], pa.binary())],
                names=["slice", "counts"],
            )

    return sketch


def _frequent_slices(least: int):
    """The Arrow function that adds up the slices and tells which counts are large enough."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, planes in zip(*(batch.column(n).to_pylist() for n in ("slice", "counts"))):
                own = np.frombuffer(planes, np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel()
                sums[i] = sums[i] + own if i in sums else own
        for i, counts in sums.items():
            bits = np.packbits(counts >= least).tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.array([bits], pa.binary())],
                names=["slice", "frequent"],
            )

    return add


def _frequent(texts: DataFrame, known: list[np.ndarray], size: int, least: int) -> np.ndarray:
    """Whether the n-grams of each hash are ``least`` or more together; ``size`` answers."""
    slices = (
        texts.mapInArrow(_sketcher(known, size), "slice int, counts binary")
        .repartition("slice")
        .mapInArrow(_frequent_slices(least), "slice int, frequent binary")
    )
    parts = np.array_split(np.zeros(size, bool), _SLICES)
    for row in slices.collect():  # a bit for each hash, whatever the corpus
        i, bits = row["slice"], np.frombuffer(row["frequent"], np.uint8)
        parts[i] = np.unpackbits(bits, count=len(parts[i])).astype(bool)
    return np.concatenate(parts)


def _gram_counter(known: list[np.ndarray], frequent: np.ndarray):
    bits = np.packbits(frequent)
    size = np.uint64(len(frequent))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, limit=_PIECE):
            grams, histories = _candidates(_Tokens.of(piece.column("text")), known)
            at = grams % size
            maybe = (bits[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 > 0
            grams, histories = grams[maybe], histories[maybe]
            order = np.argsort(grams)
            sorted_grams = grams[order]
            heads = np.flatnonzero(np.append(True, sorted_grams[1:] != sorted_grams[:-1])[: len(order)])
            n = np.diff(np.append(heads, len(order)))
            columns = (sorted_grams[heads], histories[order[heads]])
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c.view(np.int64)) for c in columns), pa.array(n)],
                names=["key", "history", "n"],
            )

    return count


def _column(table: DataFrame, *names: str) -> list[np.ndarray]:
    found = table.select(*names).toArrow()
    return [found.column(name).to_numpy() for name in names]


def train(
    texts: DataFrame,
    words: DataFrame,
    order: int = ORDER,
    frequent: int = FREQUENT,
    sketch: int = SKETCH,
) -> Model:
    """The model of ``texts``, whose ``words`` are counted already (``word_counts``).

    An n-gram is held if its count is one ``frequent``-th of all tokens or more, at every size of
    the corpus alike. Longer ones can only be as frequent if their parts are, so each order is
    one pass that counts by hash which of them may be, and one that counts those exactly. The
    driver gets ``frequent`` numbers an order at most.
    """
    spark = texts.sparkSession
    documents = texts.count()
    total = words.agg(F.sum("n"), F.count("*")).first()
    tokens, distinct = (total[0] or 0) + documents, total[1] + (documents > 0)
    least = max(1, -(-tokens // frequent))
    often = words.filter(F.col("n") >= least)
    keys, n = _column(often.mapInArrow(_keyed, "key long, n long"), "key", "n")
    keys = keys.view(np.uint64)
    rare_tokens, rare_kinds = tokens - documents - int(n.sum()), total[1] - len(keys)
    if documents:
        keys, n = np.append(keys, _END), np.append(n, documents)
    known = [np.unique(keys)]
    entries, levels = [keys], [_levels(n, least)]
    totals = dict(zip(keys.tolist(), n.tolist()))
    for size in range(2, order + 1):
        maybe = _frequent(texts, known, sketch, least)
        path = scratch_path(spark, "grams")
        grams = stored_at(
            texts.mapInArrow(_gram_counter(known, maybe), "key long, history long, n long")
            .groupBy("key", "history")
            .agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= least),
            path,
        )
        keys, history, n = _column(grams, "key", "history", "n")
        discard(spark, path)
        keys, history = keys.view(np.uint64), history.view(np.uint64)
        entries.append(keys)
        levels.append(_levels(n, least))
        before, where = np.unique(history, return_inverse=True)
        taken = np.bincount(where, n - DISCOUNT, minlength=len(before))
        whole = np.array([totals.get(key, 0) for key in before.tolist()], float)
        entries.append(before ^ _LEFT)
        levels.append(_left_levels(whole, taken))
        known.append(np.unique(keys))
        totals = dict(zip(keys.tolist(), n.tolist()))
    counts = CountFilter(np.concatenate(entries), np.concatenate(levels))
    return Model(counts, least, order, tokens, distinct, rare_tokens / max(1, rare_kinds))


def _levels(n: np.ndarray, least: int) -> np.ndarray:
    steps = least * BASE ** np.arange(0, 120)
    return np.searchsorted(steps, n, side="right")


def _left_levels(whole: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """The quantised share that histories leave, of which ``taken`` of ``whole`` is taken."""
    left = np.maximum(_LEAST, 1 - taken / np.maximum(whole, taken + _LEAST))
    return np.rint(-np.log(left) / np.log(_RATIO)).astype(np.int64)


def _middles(least: int, most: int) -> np.ndarray:
    """The count that each level stands for, the middle of its range; 0 for level 0."""
    levels = np.arange(most + 1)
    low = np.ceil(least * BASE ** (levels - 1.0))
    high = np.maximum(low, np.ceil(least * BASE ** levels.astype(float)) - 1)
    middle = (low + high) / 2
    middle[0] = 0.0
    return middle


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, n`` of all whole texts, A-Z as a-z."""
    return (
        texts.select("text")
        .mapInArrow(_counted_words, "word string, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
    )


def _scorer(shared, known: pa.Array, counts: np.ndarray, ends: int):
    """The Arrow function that scores texts: a row a text, and a row a text's other word."""

    def rows(nth, doc, held_out, tokens, known, base, score, word, times):
        n = len(nth)
        empty = [pa.nulls(n, pa.int64())] * 2 + [pa.nulls(n, pa.float64())] * 2
        figures = empty if tokens is None else [pa.array(x) for x in (tokens, known, base, score)]
        names = ["nth", "doc_id", "held_out", "n_tokens", "known", "base", "score", "word", "times"]
        columns = [pa.array(nth), doc, held_out, *figures, word, times]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        whole = np.log10(model.tokens + 0.1 * (model.distinct + 1))
        passed = 0
        for piece in pieces(batches, limit=_PIECE):
            tokens = _Tokens.of(piece.column("text"))
            texts, n = tokens.texts(), piece.num_rows
            at = pc.index_in(tokens.words, known).fill_null(-1).to_numpy(zero_copy_only=False)
            exact = np.append(np.where(at >= 0, counts[at] if len(counts) else 0, 0), ends)
            mine = np.append(at >= 0, True)  # the end's count is known, even if it is 0
            terms = np.where(mine, np.log10(exact + 0.1) - whole, 0.0)
            chances = np.log10(model.probabilities(tokens))
            nth = np.arange(passed, passed + n)
            yield rows(
                nth,
                piece.column("doc_id"),
                piece.column("held_out"),
                np.diff(tokens.firsts),
                np.bincount(texts, exact[tokens.codes] > 0, minlength=n).astype(np.int64),
                np.bincount(texts, terms[tokens.codes], minlength=n),
                np.bincount(texts, chances, minlength=n),
                pa.nulls(n, pa.string()),
                pa.nulls(n, pa.int64()),
            )
            other = ~mine[tokens.codes]
            width = len(tokens.words) + 1
            pairs, times = np.unique(texts[other] * width + tokens.codes[other], return_counts=True)
            for block in range(0, len(pairs), 200_000):
                some = pairs[block : block + 200_000]
                yield rows(
                    nth[some // width],
                    pa.nulls(len(some), piece.column("doc_id").type),
                    pa.nulls(len(some), pa.bool_()),
                    *[None] * 4,
                    tokens.words.take(pa.array(some % width)).cast(pa.string()),
                    pa.array(times[block : block + 200_000], pa.int64()),
                )
            passed += n

    return score


# --- All n-grams: shards by first words ---


def _planes(x: np.ndarray) -> bytes:
    """Bytes of one significance together, so that they pack well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _unplaned(data: np.ndarray, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(data.reshape(size, -1).T).view(kind).ravel()


def _risen(keys: np.ndarray) -> bytes:
    """Of rising numbers, each less the one before."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _squeezed(x: np.ndarray) -> bytes:
    return pa.compress(_planes(x.astype(np.int32)), codec="zstd", asbytes=True)


def _spread(data: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True) if n else b""
    return _unplaned(np.frombuffer(raw, np.uint8), np.int32).astype(np.int64)


class _Paths:
    """The distinct n-grams of a piece as a tree, in the order in which shards get them.

    A path is a token's predecessor (the end at a text's begin), the token, and those after it, of
    ``order`` words in all; what lies past the text's end is a word of its own, the last code. The
    shard of a path is that of its first word; of its second or third, if those before are hot.

    ``to`` is the shard of each distinct path; at each level, ``words`` has the codes of the nodes,
    ``node`` the number of each path's node, and ``of`` that of each token's.
    """

    def __init__(self, codes, lengths, end, shard, hot, order):
        past, width = len(shard), len(shard) + 1
        before = np.empty_like(codes)
        before[1:], before[:1] = codes[:-1], end
        words, after = [before, codes][:order], codes
        while len(words) < order:
            more = np.full_like(codes, past)
            more[:-1] = codes[1:] if after is codes else after[1:]
            more[(after == end) | (after == past)] = past
            words.append(more)
            after = more
        kinds, path = np.unique(words[0], return_inverse=True)
        tables, levels = [kinds], [kinds]
        for word in words[1:]:
            kinds, path = np.unique(path * width + word, return_inverse=True)
            tables.append(kinds)
        # back from the longest: each path's word and prefix at every level
        prefix, symbols, prefixes = np.arange(len(tables[-1])), [], []
        for table in tables[:0:-1]:
            prefixes.append(prefix)
            symbols.append(table[prefix] % width)
            prefix = table[prefix] // width
        prefixes.append(prefix)
        symbols.append(levels[0][prefix])
        prefixes.reverse()
        symbols.reverse()
        route = symbols[0]
        hot = np.append(hot, False)
        for symbol in symbols[1:3]:
            route = np.where(hot[route] & (symbol != past), symbol, route)
        to = shard[route]
        sent = np.argsort(to, kind="stable")
        place = np.empty(len(sent), np.int64)
        place[sent] = np.arange(len(sent))
        self.to, self.path = to[sent], place[path]
        self.words, self.node, self.heads = [], [], []
        for symbol, prefix in zip(symbols, prefixes):
            own = prefix[sent]
            new = np.ones(len(sent), bool)
            new[1:] = (own[1:] != own[:-1]) | (self.to[1:] != self.to[:-1])
            heads = np.flatnonzero(new)
            self.heads.append(heads)
            self.words.append(symbol[sent][heads])
            self.node.append(np.cumsum(new) - 1)

    def of(self, level: int) -> np.ndarray:
        return self.node[level][self.path]

    def shards(self) -> Iterator[tuple[int, int, int]]:
        """Each shard with its first path and what follows its last."""
        begins = np.flatnonzero(np.append(True, self.to[1:] != self.to[:-1])[: len(self.to)])
        ends = np.append(begins[1:], len(self.to))
        return zip(self.to[begins].tolist(), begins.tolist(), ends.tolist())

    def within(self, begin: int, end: int) -> list[slice]:
        """At each level, the nodes of a shard."""
        return [slice(int(n[begin]), int(n[end - 1]) + 1) for n in self.node]


_HOME = "piece long, doc_id array<{}>, held_out array<boolean>, words int, keys binary, codes binary, "
_HOME += "lengths binary, tokens long, hot array<long>, times array<long>"


def _homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a piece: its words' numbers, rising, and its tokens as places among them.

    ``tokens`` are those of training; ``hot`` has the words with one in twice ``HOT`` of them. Any word with
    one in ``HOT`` of all tokens is found so: where it is not listed it has less than half of that.
    """
    context, nth = TaskContext.get(), 0
    for piece in pieces(batches, limit=_PIECE):
        tokens = _Tokens.of(piece.column("text"))
        keys = tokens.keys()
        order = np.argsort(keys)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        keys, codes, lengths = keys[order], rank[tokens.codes], np.diff(tokens.firsts)
        held = piece.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        n = np.bincount(codes[np.repeat(~held, lengths)], minlength=len(keys))
        often = np.flatnonzero((n > 0) & (n * 2 * HOT >= n.sum()))

        def listed(column: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)

        yield pa.RecordBatch.from_arrays(
            [
                pa.array([(context.partitionId() << 32) + nth]),
                listed(piece.column("doc_id")),
                listed(piece.column("held_out")),
                pa.array([len(keys)], pa.int32()),
                pa.array([_risen(keys)], pa.binary()),
                pa.array([_squeezed(codes)], pa.binary()),
                pa.array([_squeezed(lengths)], pa.binary()),
                pa.array([int(n.sum())], pa.int64()),
                listed(pa.array(keys[often].view(np.int64))),
                listed(pa.array(n[often])),
            ],
            names=[
                *("piece", "doc_id", "held_out", "words", "keys", "codes", "lengths"),
                *("tokens", "hot", "times"),
            ],
        )
        nth += 1


def _keys_of(row: dict) -> np.ndarray:
    return np.cumsum(_unplaned(np.frombuffer(row["keys"], np.uint8), np.uint64))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i] for name in batch.schema.names}


def _asker(hot: np.ndarray, bits: int, order: int):
    """The Arrow function that makes, for each piece, a row for each shard that it has n-grams of.

    A row has the sizes of the levels; the first words' numbers, and the low 32 bits of the numbers
    of second, 24 of later ones; how many nodes each has below it; and the paths' counts.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            keys = _keys_of({"keys": row["keys"].as_py()})
            lengths = _spread(row["lengths"].as_py(), len(row["held_out"].values))
            codes = _spread(row["codes"].as_py(), int(lengths.sum()))
            held = row["held_out"].values.to_numpy(zero_copy_only=False).astype(bool)
            end = int(np.searchsorted(keys, _END))
            shard = (keys >> np.uint64(64 - bits)).astype(np.int64)
            paths = _Paths(codes, lengths, end, shard, _held(keys, hot), order)
            mine = paths.path[np.repeat(~held, lengths)]
            times = np.bincount(mine, minlength=len(paths.to)).astype(np.uint32)
            low = np.append(keys, np.uint64(0)).astype(np.uint32)
            below = [
                np.diff(np.append(paths.node[k + 1][heads], len(paths.words[k + 1]))).astype(np.uint32)
                for k, heads in enumerate(paths.heads[:-1])
            ]
            shards, asked = [], []
            for to, begin, stop in paths.shards():
                own = paths.within(begin, stop)
                parts = [np.array([x.stop - x.start for x in own], np.int64).tobytes()]
                for k, x in enumerate(own):
                    words = paths.words[k][x]
                    if k:
                        parts.append(_planes(low[words] & np.uint32(0xFFFFFFFF if k == 1 else 0xFFFFFF)))
                    else:  # rising but for what hot words bring along
                        parts.append(_risen(keys[words]))
                    if k + 1 < order:
                        parts.append(_planes(below[k][x]))
                parts.append(_planes(times[begin:stop]))
                shards.append(to)
                asked.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shards, pa.int32()),
                    pa.array([row["piece"].as_py()] * len(shards), pa.int64()),
                    pa.array(asked, pa.binary()),
                ],
                names=["shard", "piece", "asked"],
            )

    return ask


def _told(asked: bytes, order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Of a row of ``_asker``: the words and the numbers of nodes below by level, and the counts."""
    data, at = np.frombuffer(asked, np.uint8), 8 * order
    sizes = data[:at].view(np.int64).tolist()

    def take(n: int, kind: type) -> np.ndarray:
        nonlocal at
        size = n * np.dtype(kind).itemsize
        at += size
        return _unplaned(data[at - size : at], kind)

    words, below = [], []
    for k, n in enumerate(sizes):
        words.append(take(n, np.uint32) if k else np.cumsum(take(n, np.uint64)))
        if k + 1 < order:
            below.append(take(n, np.uint32))
    return words, below, take(sizes[-1], np.uint32)


_ANSWERS = "piece long, shard int, answer binary, level int, key long, n long, below long"


def _answerer(hot: np.ndarray, order: int, filter_bits: int):
    """The function that counts a shard's n-grams and tells every piece what the filter has of them.

    Besides, a row with the number of its distinct words (level -1), and one for each node whose paths
    lie in several shards: a hot first word (level 0), two hot words (level 1). Their ``below``
    leaves out the nodes that lie in several shards themselves.
    """
    low = hot.astype(np.uint32)

    def answer(table: pa.Table) -> pa.Table:
        rows = [_told(x.as_py(), order) for x in table.column("asked")]
        sizes = [[len(row[0][k]) for row in rows] for k in range(order)]
        kinds, node = np.unique(np.concatenate([row[0][0] for row in rows]), return_inverse=True)
        keys, up, nodes = [kinds], [], [node.astype(np.int32)]
        for k in range(1, order):
            parent = np.repeat(nodes[-1], np.concatenate([row[1][k - 1] for row in rows]))
            word = np.concatenate([row[0][k] for row in rows])
            parent = parent.astype(np.int64) << 32 | word
            del word
            kinds, node = np.unique(parent, return_inverse=True)
            del parent
            up.append((kinds >> 32).astype(np.int32))
            keys.append(_longer(keys[-1][up[-1]], (kinds & 0xFFFFFFFF).astype(np.uint64)))
            nodes.append(node.astype(np.int32))
            if k == 1:
                second = (kinds & 0xFFFFFFFF).astype(np.uint32)
        times = np.concatenate([row[2] for row in rows])
        del rows, kinds, node
        n = [np.bincount(nodes[-1], times, len(keys[-1])).astype(np.int64)]
        for parents, above in zip(up[::-1], keys[-2::-1]):
            n.append(np.bincount(parents, n[-1], len(above)).astype(np.int64))
        n.reverse()
        parted = [_held(keys[0], hot) if order > 1 else np.zeros(len(keys[0]), bool)]
        if order > 2:
            parted.append(parted[0][up[0]] & np.isin(second, low))
        parted += [np.zeros(len(k), bool) for k in keys[len(parted) :]]
        below = [
            np.bincount(parents[(n[k + 1] > 0) & ~parted[k + 1]], minlength=len(keys[k]))
            for k, parents in enumerate(up)
        ]
        entries, levels = [], []
        for k, own in enumerate(keys):
            had = n[k] > 0
            entries.append(own[had])
            levels.append(_levels(n[k][had], 1).astype(np.uint8))
            if k + 1 < order:
                taken = n[k][had] - DISCOUNT * below[k][had]
                entries.append(own[had] ^ _LEFT)
                levels.append(_left_levels(n[k][had], taken).astype(np.uint8))
        held = CountFilter(np.concatenate(entries), np.concatenate(levels), filter_bits)
        del entries, levels
        found = [held(own).astype(np.uint8) for own in keys]
        left = [held(own ^ _LEFT).astype(np.uint8) for own in keys[:-1]]
        begins, answers = [0] * order, []
        for i in range(table.num_rows):
            parts = []
            for k in range(order):
                own = nodes[k][begins[k] : begins[k] + sizes[k][i]]
                begins[k] += sizes[k][i]
                if not k:
                    parts.append(_planes(n[0][own]))
                parts.append(found[k][own].tobytes())
                if k + 1 < order:
                    parts.append(left[k][own].tobytes())
            answers.append(b"".join(parts))
        sums = [(-1, 0, 0, int(((n[0] > 0) & ~parted[0]).sum()))]
        for k, own in enumerate(parted[: order - 1]):
            for i in np.flatnonzero(own & (n[k] > 0)):
                sums.append((k, int(keys[k][i].view(np.int64)), int(n[k][i]), int(below[k][i])))
        m, columns = len(sums), list(zip(*sums))
        return pa.table(
            [
                pa.array(table.column("piece").to_pylist() + [None] * m, pa.int64()),
                pa.array(table.column("shard").to_pylist() + [None] * m, pa.int32()),
                pa.array(answers + [None] * m, pa.binary()),
                pa.array([None] * table.num_rows + list(columns[0]), pa.int32()),
                *(pa.array([None] * table.num_rows + list(x), pa.int64()) for x in columns[1:]),
            ],
            names=["piece", "shard", "answer", "level", "key", "n", "below"],
        )

    return answer


@dataclass
class _Totals:
    """What no shard knows: sums over all, and the nodes that lie in several shards.

    These have, by level, their numbers, rising, their counts and how much they leave.
    """

    tokens: int
    distinct: int
    parted: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, tokens: int, rows: list, hot: np.ndarray) -> "_Totals":
        """``rows`` of ``level, key, n, below``, summed up over the shards."""
        distinct = sum(row["below"] for row in rows if row["level"] == -1)
        by_level = []
        for level in range(2):
            own = sorted((row["key"] % (1 << 64), row["n"], row["below"]) for row in rows if row["level"] == level)
            columns = list(zip(*own)) or [(), (), ()]
            by_level.append([np.array(columns[0], np.uint64), *(np.array(c, np.int64) for c in columns[1:])])
        # a hot word's other successors that are hot lie in several shards, too
        keys, n, below = by_level[0]
        distinct += len(keys)
        for key in hot.astype(np.uint32).astype(np.uint64):
            below += _held(_longer(keys, key), by_level[1][0])
        parted = [(k, c, _left_levels(c, c - DISCOUNT * b)) for k, c, b in by_level]
        return cls(tokens, distinct, parted)

    def put(self, level: int, keys: np.ndarray, these: np.ndarray, *into: np.ndarray) -> None:
        """Replaces what shards say of ``these`` nodes, whose numbers are ``keys``."""
        known, n, left = self.parted[level]
        at = np.searchsorted(known, keys)
        at[at == len(known)] = 0
        had = known[at] == keys if len(known) else np.zeros(len(keys), bool)
        values = [np.where(had, x[at] if len(x) else 0, 0) for x in (_levels(n, 1), left, n)]
        for target, value in zip(into, values):
            target[these] = value


def _slimmer(hot: np.ndarray, bits: int):
    """The Arrow function that leaves of a piece's words where shards begin, and which are hot."""

    def slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        for row in _each(batches):
            keys = _keys_of({"keys": row["keys"].as_py()})
            at = np.flatnonzero(_held(keys, hot))
            names = ["piece", "doc_id", "held_out", "words", "codes", "lengths"]
            arrays = [pa.array([row[x].as_py()], row[x].type) for x in names[:1] + names[3:]]
            lists = [
                pa.ListArray.from_arrays(pa.array([0, len(row[x].values)], pa.int32()), row[x].values)
                for x in names[1:3]
            ]
            begins = np.append(np.searchsorted(keys, edges), np.searchsorted(keys, _END))
            yield pa.RecordBatch.from_arrays(
                [
                    arrays[0],
                    *lists,
                    *arrays[1:],
                    pa.array([_squeezed(begins)], pa.binary()),
                    pa.array([at.astype(np.int64).tobytes()], pa.binary()),
                    pa.array([keys[at].tobytes()], pa.binary()),
                ],
                names=[*names, "begins", "hot_at", "hot"],
            )

    return slim


def _piece_scorer(shared, bits: int, order: int, kind: pa.DataType):
    """The function that scores a piece's texts from what the shards answered."""

    def score(home: pa.Table, answers: pa.Table) -> pa.Table:
        totals: _Totals = shared.value
        row = {name: home.column(name)[0] for name in home.column_names}
        texts, width = len(row["held_out"].values), row["words"].as_py()
        lengths = _spread(row["lengths"].as_py(), texts)
        codes = _spread(row["codes"].as_py(), int(lengths.sum()))
        begins = _spread(row["begins"].as_py(), (1 << bits) + 1)
        end, begins = int(begins[-1]), begins[:-1]
        hot_at = np.frombuffer(row["hot_at"].as_py(), np.int64)
        hot_key = np.frombuffer(row["hot"].as_py(), np.uint64)
        hot = np.zeros(width, bool)
        hot[hot_at] = True
        shard = np.repeat(np.arange(1 << bits), np.diff(np.append(begins, width)))
        paths = _Paths(codes, lengths, end, shard, hot, order)
        by_shard = dict(zip(answers.column("shard").to_pylist(), answers.column("answer")))
        exact = np.zeros(len(paths.words[0]), np.int64)
        found = [np.zeros(len(words), np.uint8) for words in paths.words]
        left = [np.zeros(len(words), np.uint8) for words in paths.words]
        for to, first, stop in paths.shards():
            data, at = np.frombuffer(by_shard[to].as_py(), np.uint8), 0
            for k, own in enumerate(paths.within(first, stop)):
                n = own.stop - own.start
                if not k:
                    exact[own], at = _unplaned(data[: 8 * n], np.int64), 8 * n
                found[k][own], at = data[at : at + n], at + n
                if k + 1 < order:
                    left[k][own], at = data[at : at + n], at + n
        key = np.zeros(width + 1, np.uint64)
        key[hot_at] = hot_key
        if order > 1:
            these = np.flatnonzero(hot[paths.words[0]])
            totals.put(0, key[paths.words[0][these]], these, found[0], left[0], exact)
        if order > 2:
            above = paths.words[0][paths.node[0][paths.heads[1]]]
            these = np.flatnonzero(hot[above] & np.append(hot, False)[paths.words[1]])
            second = key[paths.words[1][these]].astype(np.uint32).astype(np.uint64)
            totals.put(1, _longer(key[above[these]], second), these, found[1], left[1])
        middle = _middles(1, 255)
        count = np.zeros(width, np.int64)
        count[paths.words[0]] = exact
        level = np.zeros(width, np.int64)
        level[paths.words[0]] = found[0]
        whole = totals.tokens + 0.1 * (totals.distinct + 1)
        text = np.repeat(np.arange(texts), lengths)
        nth = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        chance = ((middle[level] + 0.1) / whole)[codes]
        held = (level > 0)[codes]
        for k in range(1, order):
            at = np.flatnonzero(nth >= k - 1)  # tokens with a history of k
            path = paths.path[at - (k - 1)]
            history, own = paths.node[k - 1][path], paths.node[k][path]
            before = middle[found[k - 1][history]]
            usable = before > 0
            seen = np.where(usable & held[at], middle[found[k][own]], 0.0)
            share = _RATIO ** -left[k - 1][history].astype(float)
            chance[at] = np.where(usable, chance[at] * share, chance[at])
            gain = seen > 0
            more = np.maximum(seen[gain] - DISCOUNT, 0) / np.maximum(before[gain], seen[gain])
            chance[at[gain]] += more
            held = np.zeros(len(codes), bool)
            held[at[gain]] = True
        terms = (np.log10(count + 0.1) - np.log10(whole))[codes]
        return pa.table(
            [
                row["doc_id"].values.cast(kind),
                row["held_out"].values,
                pa.array(lengths),
                pa.array(np.bincount(text, (count > 0)[codes], texts).astype(np.int64)),
                pa.array(np.full(texts, totals.tokens)),
                pa.array(np.bincount(text, terms, texts)),
                pa.array(np.bincount(text, np.log10(np.minimum(chance, 1.0)), texts)),
            ],
            names=[
                *("doc_id", "held_out", "n_tokens", "n_known"),
                *("train_tokens", "base_score", "score"),
            ],
        )

    return score


def _whole_model(rows: DataFrame, order: int) -> DataFrame:
    """``language_model`` with every n-gram of training, whatever its count."""
    spark = rows.sparkSession
    kind = dict(rows.dtypes)["doc_id"]
    homes = stored_at(rows.mapInArrow(_homes, _HOME.format(kind)), scratch_path(spark, "homes"))
    tokens = homes.agg(F.sum("tokens")).first()[0] or 0
    listed = homes.select(F.explode(F.arrays_zip("hot", "times")).alias("x")).select("x.*")
    often = listed.groupBy("hot").agg(F.sum("times").alias("n"))
    often = often.filter(F.col("n") * 2 * HOT >= tokens).collect()  # twice HOT at most
    hot = np.sort(np.array([row["hot"] % (1 << 64) for row in often], np.uint64))
    bits = max(SHARDS, -(-tokens // SHARD)) - 1
    bits = bits.bit_length()
    asked = homes.select("piece", "held_out", "keys", "codes", "lengths").mapInArrow(
        _asker(hot, bits, order), "shard int, piece long, asked binary"
    )
    answers = stored_at(
        asked.groupBy("shard").applyInArrow(_answerer(hot, order, _BITS), _ANSWERS),
        scratch_path(spark, "answers"),
    )
    sums = answers.filter("level is not null").groupBy("level", "key")
    sums = sums.agg(F.sum("n").alias("n"), F.sum("below").alias("below")).collect()
    shared = spark.sparkContext.broadcast(_Totals.of(tokens, sums, hot))
    whole = StructType.fromDDL(f"doc_id {kind}")
    slim = homes.select("piece", "doc_id", "held_out", "words", "keys", "codes", "lengths").mapInArrow(
        _slimmer(hot, bits),
        f"piece long, doc_id array<{kind}>, held_out array<boolean>, words int, codes binary,"
        " lengths binary, begins binary, hot_at binary, hot binary",
    )
    told = answers.filter("piece is not null").select("piece", "shard", "answer")
    return (
        slim.groupBy("piece")
        .cogroup(told.groupBy("piece"))
        .applyInArrow(
            _piece_scorer(shared, bits, order, to_arrow_schema(whole).field(0).type),
            f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long,"
            " base_score double, score double",
        )
    )


def held_out(doc_id: Column, folds: int = 10) -> Column:
    """Whether the CRC-32 of the id in text is a multiple of ``folds``; null counts as empty."""
    text = F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")
    return F.crc32(text) % folds == 0


def language_model(
    docs: DataFrame,
    folds: int = 10,
    order: int = ORDER,
    frequent: int | None = None,
    known: int = KNOWN,
    sketch: int = SKETCH,
) -> DataFrame:
    """Scores of all whole texts by a model of those that are not ``held_out``.

    Tokens are the runs of characters other than ASCII white space, A-Z as a-z, then one end.
    Returns, for each row, ``doc_id, held_out, n_tokens, n_known`` (tokens that training has),
    ``train_tokens``, ``base_score`` (sum of log10 of (c + 0.1) / (N + 0.1 (V + 1)), with exact
    counts) and ``score``, the text's log10 probability under the model: absolute discounting,
    interpolated down to (c + 0.1) / (N + 0.1 (V + 1)), all counts from the filter. It has every
    n-gram of training; or, if ``frequent`` is given, those that are one of so many tokens or more often, in
    one filter sent to every task, and words that aren't in it share the mean count of such words.

    Null and empty texts are one end. Null ids are held out, and repeated rows are each scored;
    other columns are not read. With no training text both scores are 0 for any text; an empty
    table gives an empty one.

    Words are told apart by 64 bits, longer n-grams by these and 32 and 24 bits for the second and later
    words. With ``frequent``, the counts of words that are not ``known`` to every task are joined, each to
    the texts that have it, so that the largest join key has one ``known``-th of all tokens of training.
    """
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id"), folds).alias("held_out"))
    if frequent is None:
        return _whole_model(rows, order)
    spark = docs.sparkSession
    context = spark.sparkContext
    kind = dict(docs.dtypes)["doc_id"]
    training = rows.filter(~F.col("held_out")).select("text")
    words_path, found_path = scratch_path(spark, "words"), scratch_path(spark, "found")
    words = stored_at(word_counts(training), words_path)
    model = train(training, words, order, frequent, sketch)
    tell = words.filter(
        (F.col("n") * known >= model.tokens) & (F.octet_length("word") <= KNOWN_BYTES)
    ).toArrow()  # ``known`` words of KNOWN_BYTES at most
    ends = model.tokens - (words.agg(F.sum("n")).first()[0] or 0)
    shared = context.broadcast(model)
    told = tell.column("word").combine_chunks().cast(pa.large_string())
    score = _scorer(shared, told, tell.column("n").to_numpy(), ends)
    found = stored_at(
        rows.mapInArrow(
            score,
            f"nth long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double,"
            " score double, word string, times long",
        ).withColumn("task", F.spark_partition_id()),
        found_path,
    )
    shared.destroy()
    whole = F.log10(F.lit(model.tokens + 0.1 * (model.distinct + 1)))
    others = (
        found.filter("word is not null")
        .select("task", "nth", "word", "times")
        .join(words, "word", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .groupBy("task", "nth")
        .agg(
            F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("also"),
            F.sum(F.col("times") * (F.log10(F.col("n") + 0.1) - whole)).alias("more"),
        )
    )
    return (
        found.filter("n_tokens is not null")
        .select("task", "nth", "doc_id", "held_out", "n_tokens", "known", "base", "score")
        .join(others, ["task", "nth"], "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"),
            F.lit(model.tokens).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
            "score",
        )
    )
