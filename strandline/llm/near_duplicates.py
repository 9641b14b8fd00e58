"""Near-duplicates by SimHash, found through the anchors of a covering code.

The 64 bits of a fingerprint are three blocks of 21, 21 and 22 bits. Two fingerprints that
differ in at most four bits differ in at most two over some two of the blocks. Blocks, with
zeros before them, are words of 23 bits, and the anchors are the 4,096 words of the binary
Golay code: each word is within three bits of exactly one anchor, its home. For two blocks an
anchor is a pair. A fingerprint is compared, at each pair of anchors within the covering radius
plus the threshold, with the fingerprints at home there; see Norouzi et al. and the older
literature on covering codes for the principle.
"""

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandline.llm.bytetext import ragged
from strandline.llm.components import components
from strandline.llm.frames import matched, row_hash
from strandline.llm.simhash import fingerprints
from strandline.plans.storage import stored

THRESHOLD = 4
#: An anchor with more fingerprints at home is left to ``_by_midpoints``.
CROWDED = 1000
#: Fingerprints whose replicas one task makes, about 180 for each.
TASK_PRINTS = 20_000

BLOCKS = ((0, 21), (21, 21), (42, 22))
PAIRS = ((0, 1), (0, 2), (1, 2))
_PAIR_THRESHOLD = 2
_RADIUS = 3
_GENERATOR = 0xC75  # of the binary Golay code, a fixed value
_ROWS = 4000


@lru_cache(maxsize=1)
def _code() -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The error of each remainder, and nearby anchors.

    The second part has, for each excess 0, 1, 2 over the radius, the anchors at that excess
    from the error with a given remainder, end to end, and where each remainder's begin. The
    code is linear, so an anchor near a word is its home's number XOR a number found here.
    """
    one = 1 << np.arange(23, dtype=np.int64)
    light = [np.zeros(1, np.int64)]
    for size in range(1, _RADIUS + 1):
        light.append(np.array([sum(x) for x in combinations(one.tolist(), size)], np.int64))
    light = np.concatenate(light)
    errors = np.zeros(1 << 11, np.int64)
    errors[_remainder(light)] = light
    numbers = np.arange(1 << 12, dtype=np.int64) << 11
    anchors = numbers ^ _remainder(numbers)
    far = np.bitwise_count(errors[:, None] ^ anchors[None, :])
    near = []
    for excess in range(_PAIR_THRESHOLD + 1):
        at = far <= _RADIUS if not excess else far == _RADIUS + excess
        near.append((np.nonzero(at)[1], np.concatenate(([0], np.cumsum(at.sum(1))))))
    return errors, near


def _remainder(words: np.ndarray) -> np.ndarray:
    """Of 23-bit words as polynomials, divided by the generator."""
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest ^= ((rest >> bit) & 1) * (_GENERATOR << (bit - 11))
    return rest


def _home(bits: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each block, the number of the home anchor and the remainder."""
    errors, _ = _code()
    out = []
    for low, size in BLOCKS:
        word = ((bits >> np.uint64(low)) & np.uint64((1 << size) - 1)).astype(np.int64)
        left = _remainder(word)
        out.append(((word ^ errors[left]) >> 11, left))
    return out


def _key(pair: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return ((pair << 24) | (first << 12) | second).astype(np.int32)


def _rows(keys: list[np.ndarray], bits: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(keys)), pa.array(np.concatenate(bits).view(np.int64))],
        names=["anchor", "bits"],
    )


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        bits = batch.column("bits").to_numpy().view(np.uint64)
        for first in range(0, len(bits), _ROWS):
            yield bits[first : first + _ROWS]


def _at_home(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bits in _parts(batches):
        home = _home(bits)
        keys = [_key(n, home[a][0], home[b][0]) for n, (a, b) in enumerate(PAIRS)]
        yield _rows(keys, [bits] * len(PAIRS))


def _replicated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint at every pair of anchors within the radius plus the threshold."""
    _, near = _code()
    for bits in _parts(batches):
        home = _home(bits)
        reach = []
        for anchor, left in home:
            by_excess = []
            for numbers, begins in near:
                sizes = np.diff(begins)[left]
                at = ragged(begins[left], sizes)
                by_excess.append((np.repeat(anchor, sizes) ^ numbers[at], sizes))
            reach.append(by_excess)
        for n, (a, b) in enumerate(PAIRS):
            keys, rows = [], []
            for over in range(_PAIR_THRESHOLD + 1):
                for more in range(_PAIR_THRESHOLD + 1 - over):
                    one, n_one = reach[a][over]
                    two, n_two = reach[b][more]
                    # row by row, each of the one with each of the two
                    times = np.repeat(n_two, n_one)
                    begins = np.repeat(np.cumsum(n_two) - n_two, n_one)
                    keys.append(_key(n, np.repeat(one, times), two[ragged(begins, times)]))
                    rows.append(np.repeat(bits, n_one * n_two))
            yield _rows(keys, rows)


def _midpoints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint with every word within half the threshold of it."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    flips = np.concatenate((np.zeros(1, np.uint64), one, one[i] | one[j]))
    for bits in _parts(batches):
        for first in range(0, len(bits), 500):
            own = bits[first : first + 500]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((own[:, None] ^ flips[None, :]).ravel().view(np.int64)),
                    pa.array(np.repeat(own, len(flips)).view(np.int64)),
                ],
                names=["middle", "bits"],
            )


def links(prints: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Pairs ``a, b`` of different ``bits`` from which all links of at most four bits follow.

    ``prints`` has distinct non-null longs in ``bits``. Every pair returned is a link, and every
    link is returned or follows from returned ones by way of other links; pairs may repeat.

    At most ``crowded`` fingerprints at home are met at an anchor. Where more are at home, all
    that meet there are instead grouped by the words within two bits of them: two are linked
    if and only if they have such a word in common, and no word has more than 2,081
    fingerprints, so the work stays in proportion however many there are.

    Spark takes replicas and homes for no larger than ``prints``, so the join that they meet in
    is told not to broadcast either.
    """
    home = prints.mapInArrow(_at_home, "anchor int, bits long")
    homes = home.groupBy("anchor").agg(F.count("*").alias("n"))
    full = homes.filter(F.col("n") > crowded).select("anchor")
    few = (
        home.join(full, "anchor", "left_anti")
        .groupBy("anchor")
        .agg(F.collect_list("bits").alias("home"))
    )
    replicas = prints.mapInArrow(_replicated, "anchor int, bits long")
    own = F.col("bits")
    near = F.filter("home", lambda x: (x < own) & (F.bit_count(x.bitwiseXOR(own)) <= THRESHOLD))
    met = (
        replicas.hint("merge")
        .join(few, "anchor")
        .select("bits", near.alias("near"))
        .filter(F.size("near") > 0)
        .select(F.explode("near").alias("a"), F.col("bits").alias("b"))
    )
    crowd = replicas.join(full, "anchor", "left_semi").select("bits").distinct()
    return met.union(_by_midpoints(crowd))


def _by_midpoints(prints: DataFrame) -> DataFrame:
    groups = (
        prints.mapInArrow(_midpoints, "middle long, bits long")
        .groupBy("middle")
        .agg(F.min("bits").alias("a"), F.collect_list("bits").alias("all"))
        .filter(F.size("all") > 1)
    )
    return groups.select("a", F.explode("all").alias("b")).filter("a <> b")


def near_duplicates(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """The near-duplicate group of every document.

    Returns one row per row of ``docs``: ``doc_id``, ``row_hash`` (of the whole row), ``bits``
    (the fingerprint as a signed long), ``root`` (one fingerprint of the group) and ``component_id``, the smallest id among the documents
    reached over links of at most four differing bits, the document's own included.

    Null texts count as empty; texts without words have the fingerprint zero and are linked like
    others. Null ids are passed over by the minimum, so a group of nulls only has a null
    ``component_id``. Repeated rows are returned as often as given. Other columns of ``docs``,
    whatever their names, only enter ``row_hash``. An empty table gives an empty table.
    """
    rows = docs.select(
        "doc_id", row_hash(docs).alias("row_hash"), F.coalesce("text", F.lit("")).alias("text")
    )
    kind = dict(rows.dtypes)["doc_id"]
    found = stored(
        rows.mapInArrow(fingerprints, f"doc_id {kind}, row_hash long, bits long"), "prints"
    )
    classes = stored(found.groupBy("bits").agg(F.min("doc_id").alias("least_id")), "classes")
    # few bytes a fingerprint, but many replicas: more tasks than the bytes would give
    tasks = max(1, -(-classes.count() // TASK_PRINTS))
    prints = classes.select("bits").repartition(tasks, "bits")
    roots = components(stored(links(prints, crowded), "links")).select(
        F.col("node").alias("bits"), "root"
    )
    placed = classes.join(roots, "bits", "left").select(
        "bits", "least_id", F.coalesce("root", "bits").alias("root")
    )
    least = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    labels = placed.join(least, "root").select("bits", "root", "component_id")
    return found.join(labels, "bits").select("doc_id", "row_hash", "bits", "root", "component_id")


def without_near_duplicates(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """One document of each near-duplicate group, whole, with the columns of ``docs``.

    Kept is the row with the smallest id (null last); of several with that id, any one, the same
    in every run.
    """
    least = F.min_by(
        F.struct("doc_id", "row_hash"),
        F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_hash"),
    )
    kept = near_duplicates(docs, crowded).groupBy("root").agg(least.alias("row"))
    return matched(docs, kept.select("row.doc_id", "row.row_hash"))
