"""Quality rules: simple statistics of a text, fixed limits, and an isolation forest on the rest."""

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strandline.llm.bytetext import encoded, hashed, mixed, pieces, ragged, rolling, spans
from strandline.plans.storage import stored

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # percent of the words
TREES = 100
#: Rows that a tree is grown from; the sample has TREES times as many, about.
TREE_ROWS = 256
#: Of the labelled good rows, the share that the forest may reject, at most.
MOST_LOST = 0.002
_BINS = 2000
_EULER = 0.5772156649
_USUAL_LINES = 3
_SHRUNK = 120
_FINE = 2000  # words among which one symbol is much

_BYTES = np.arange(256)
_WHITE = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
_SYMBOL = np.isin(_BYTES, list(b"#*$%&|<>"))
_FIRST = (_BYTES < 0x80) | (_BYTES >= 0xC0)  # of a code point

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's words, and those inside windows that its text has twice or more."""
    begins, ends = spans(~_WHITE[data], places)
    firsts = np.searchsorted(begins, places)
    words = hashed(rolling(data), begins, ends)
    counts = np.diff(firsts)
    each = np.maximum(counts - WINDOW + 1, 0)
    at = ragged(firsts[:-1], each)
    window = words[at]
    for nth in range(1, WINDOW):
        window = mixed(window) + words[at + nth]
    owner = np.repeat(np.arange(len(counts), dtype=np.uint64), each)
    window = mixed(mixed(window) + owner)
    _, which, n = np.unique(window, return_inverse=True, return_counts=True)
    step = np.zeros(len(words) + 1, np.int64)
    twice = at[n[which] > 1]
    np.add.at(step, twice, 1)
    np.add.at(step, twice + WINDOW, -1)
    inside = np.concatenate(([0], np.cumsum(np.cumsum(step[:-1]) > 0)))
    return counts, np.diff(inside[firsts])


def _sums(marked: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(marked, dtype=np.int64)))[places])


def _dup_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def _statistics(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        data, places = encoded(batch.column("text"))
        n_words, n_repeat = _repeated(data, places)
        raw, bounds = data.tobytes(), places.tolist()
        found = (
            n_words,
            _sums(_FIRST[data] & ~_WHITE[data], places),
            _sums(_SYMBOL[data], places),
            np.array([_dup_lines(raw[a:b]) for a, b in zip(bounds, bounds[1:])], np.int64),
            n_repeat,
        )
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in found)],
            names=["doc_id", *STATISTICS],
        )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )


def _features(statistics: Iterable[np.ndarray], usual: np.ndarray) -> np.ndarray:
    """One row of rates a word for each text; none grows with its length.

    ``usual`` has the rates of letters and of further repeated lines in all texts together. Every
    text is given ``_SHRUNK`` words more at these rates, as such rates of a few words mean little;
    not so for symbols, as ordinary texts of any length have hardly any, and the logarithm of their
    rate counts, so that few differ from none as much as many from few. Repeated words have their
    limit in ``base_failed``, and a few repeated lines are usual, so only further ones count here.
    """
    words, chars, symbols, dup, *_ = (np.asarray(x, float) for x in statistics)
    counts = np.stack((chars, np.maximum(dup - _USUAL_LINES, 0)), axis=1)
    shrunk = (counts + _SHRUNK * usual) / (words + _SHRUNK)[:, None]
    rate = np.log1p(symbols / np.maximum(words, 1) * _FINE)
    return np.column_stack((shrunk[:, 0], rate, shrunk[:, 1]))


@dataclass
class Forest:
    """Trees of random splits; node n of a tree has the children 2n + 1 and 2n + 2."""

    feature: np.ndarray  # tree x node, -1 for a leaf
    limit: np.ndarray
    depth: np.ndarray  # expected path length at a leaf
    usual: float

    @staticmethod
    def _path(rows: float) -> float:
        """Mean path of an unsuccessful search among ``rows`` values."""
        return 2 * (math.log(rows - 1) + _EULER) - 2 * (rows - 1) / rows if rows > 2 else rows - 1.0

    @classmethod
    def grown(cls, sample: np.ndarray, trees: int = TREES, seed: int = 0) -> "Forest":
        rng = np.random.default_rng(seed)
        if not len(sample):
            sample, trees = np.zeros((1, sample.shape[1])), 1
        size = min(TREE_ROWS, len(sample))
        high = max(1, math.ceil(math.log2(max(size, 2))))
        nodes = (1 << (high + 1)) - 1
        feature = np.full((trees, nodes), -1, np.int8)
        limit, depth = np.zeros((trees, nodes)), np.zeros((trees, nodes))

        def grow(tree: int, node: int, rows: np.ndarray, level: int) -> None:
            spread = np.ptp(rows, axis=0) if len(rows) else np.zeros(sample.shape[1])
            ways = np.flatnonzero(spread > 0)
            if level == high or not len(ways):
                depth[tree, node] = level + cls._path(max(len(rows), 1))
                return
            way = rng.choice(ways)
            low = rows[:, way].min()
            feature[tree, node] = way
            limit[tree, node] = cut = low + spread[way] * rng.uniform(1e-9, 1 - 1e-9)
            grow(tree, 2 * node + 1, rows[rows[:, way] <= cut], level + 1)
            grow(tree, 2 * node + 2, rows[rows[:, way] > cut], level + 1)

        for tree in range(trees):
            grow(tree, 0, sample[rng.choice(len(sample), size, replace=False)], 0)
        return cls(feature, limit, depth, cls._path(max(size, 2)))

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly, 0 to 1: the shorter the paths, the higher."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, limit, depth in zip(self.feature, self.limit, self.depth):
            node = np.zeros(len(rows), np.int64)
            inner = feature[node] >= 0
            while inner.any():
                way = np.maximum(feature[node], 0)
                right = rows[every, way] > limit[node]
                node = np.where(inner, 2 * node + 1 + right, node)
                inner = feature[node] >= 0
            total += depth[node]
        return 2.0 ** (-total / len(self.feature) / self.usual)


def _scorer(forest: Forest, usual: np.ndarray) -> Callable:
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _features((batch.column(name).to_numpy() for name in STATISTICS), usual)
            yield batch.append_column("anomaly", pa.array(forest.scores(rows)))

    return score


def quality(docs: DataFrame, labels: DataFrame, most_lost: float = MOST_LOST) -> DataFrame:
    """Rule statistics and verdict for every whole text of ``docs``.

    Returns, one row per row of ``docs``, ``doc_id``, the columns ``STATISTICS``, ``anomaly``
    (0 to 1), ``base_failed`` (too few words, or too many inside windows that are there twice or
    more) and ``kept``: false if ``base_failed``, else whether the anomaly is below the threshold.

    The forest is grown from a sample of about ``TREES * TREE_ROWS`` rows that are not
    ``base_failed``, drawn by a hash. The threshold comes from all rows that ``labels`` (``doc_id``,
    ``quality`` 0 or 1) has a label for: of those cuts that reject ``most_lost`` of the good rows
    at most, the one that rejects most bad rows, and the highest such. Without bad rows nothing is
    rejected.

    Null texts count as empty. Null ids and unlabelled rows only lack a label; ids that ``docs``
    or ``labels`` repeat weigh as often as they meet. Other columns are not read. An empty table
    gives an empty one.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    columns = ", ".join(f"{name} long" for name in STATISTICS)
    found = stored(rows.mapInArrow(_statistics, f"doc_id {kind}, {columns}"), "statistics")
    sound = found.filter(~base_failed())
    extra = F.greatest(F.col("n_dup_lines") - _USUAL_LINES, F.lit(0))
    total, words, *sums = sound.agg(
        F.count("*"), F.sum("n_words"), F.sum("word_chars"), F.sum(extra)
    ).first()
    usual = np.array([x or 0 for x in sums], float) / max(words or 0, 1)
    draw = F.pmod(F.xxhash64("doc_id", *STATISTICS), F.lit(1 << 30)) / float(1 << 30)
    wanted = TREES * TREE_ROWS
    sample = sound.filter(draw * total < wanted).select(*STATISTICS).orderBy(*STATISTICS).toPandas()
    forest = Forest.grown(_features((sample[name].to_numpy() for name in STATISTICS), usual))
    scored = found.mapInArrow(_scorer(forest, usual), f"doc_id {kind}, {columns}, anomaly double")
    limit = _threshold(scored.filter(~base_failed()), labels, most_lost)
    return scored.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & (F.col("anomaly") < limit)
    )


def _threshold(scored: DataFrame, labels: DataFrame, most_lost: float) -> float:
    """From a histogram of all labelled rows' anomalies, two numbers a bin."""
    given = labels.select(F.col("doc_id").alias("labelled_id"), "quality").filter(
        "quality is not null"
    )
    bins = (
        scored.join(given, F.col("doc_id") == F.col("labelled_id"))
        .groupBy(F.floor(F.col("anomaly") * _BINS).alias("bin"))
        .agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
        .collect()
    )
    good, bad = np.zeros(_BINS + 2), np.zeros(_BINS + 2)
    for row in bins:
        good[row["bin"]], bad[row["bin"]] = row["good"], row["bad"]
    lost = np.cumsum(good[::-1])[::-1]  # rejected from this bin on
    caught = np.where(lost <= most_lost * good.sum(), np.cumsum(bad[::-1])[::-1], -1)
    best = len(caught) - 1 - int(np.argmax(caught[::-1]))
    return best / _BINS if caught[best] > 0 else 2.0
