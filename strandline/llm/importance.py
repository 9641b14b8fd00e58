"""Importance resampling towards a target, by array-scored weights and distributed quickselect.

Hashed word features are counted in all documents and in all target texts. What each bucket's
share of the target gains over its share of the documents is one array, and a document's weight
is the sum of the gains at its features. With noise added, the highest scores are a sample by
weight. The k-th of them is found by quickselect: random pivot keys, exact counts of the keys
below and equal to each, and on between the two pivots around the k-th.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from strandline.llm.bytetext import encoded, pieces, spans
from strandline.llm.frames import matched, row_hash, unused
from strandline.plans.storage import discard, scratch_path, stored, stored_at

BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Pivot keys of a round, each a row on the driver and two counts.
PIVOTS = 16

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 0x41) & (_BYTES <= 0x5A)
_LOWER = np.where(_UPPER, _BYTES + 0x20, _BYTES).astype(np.uint8)
_DIGIT = (_BYTES >= 0x30) & (_BYTES <= 0x39)
_WORD = _DIGIT | ((_LOWER >= 0x61) & (_LOWER <= 0x7A)) | (_BYTES >= 0x80)
_LONG = 64  # bytes of a word that are worked on together with those of other words

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, _CRC >> 1 ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


def _crc(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 registers ``before``, each moved on over one stretch of ``data``."""
    sizes = ends - begins
    order = np.argsort(-sizes, kind="stable")
    at, sizes, state = begins[order], sizes[order], before[order]
    for i in range(min(_LONG, int(sizes[0]) if len(sizes) else 0)):
        more = np.searchsorted(-sizes, -i, side="left")  # the longest come first
        now = state[:more]
        state[:more] = _CRC[(now ^ data[at[:more] + i]) & 0xFF] ^ (now >> 8)
    for i in range(np.searchsorted(-sizes, -_LONG, side="left")):
        rest = data[at[i] + _LONG : at[i] + sizes[i]].tobytes()
        state[i] = zlib.crc32(rest, int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(state)
    out[order] = state
    return out


def _features(
    column: pa.Array, longest: int, buckets: int
) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text; and for each run length the buckets of all runs, and each text's first."""
    data, places = encoded(column)
    data = _LOWER[data]
    begins, ends = spans(_WORD[data], places)
    firsts = np.searchsorted(begins, places)
    words = np.diff(firsts)
    last = np.repeat(firsts[1:], words)  # of the text, for each word
    starts = np.arange(len(begins))
    state = np.full(len(begins), 0xFFFFFFFF, np.uint32)
    found = []
    for size in range(1, longest + 1):
        inside = starts + size <= last[starts]
        starts, state = starts[inside], state[inside]
        if size > 1:
            state = _CRC[(state ^ 0x20) & 0xFF] ^ (state >> 8)
        end = starts + size - 1
        state = _crc(data, begins[end], ends[end], state)
        found.append(((state ^ np.uint32(0xFFFFFFFF)) % buckets, np.searchsorted(starts, firsts)))
    return words, found


def feature_counts(
    texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS
) -> DataFrame:
    """``bucket, n``: the features of all whole texts by bucket; a task sends a row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for piece in pieces(batches):
            for found, _ in _features(piece.column("text"), longest, buckets)[1]:
                total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.array(total[used])], names=["bucket", "n"]
        )

    return (
        texts.select("text")
        .mapInArrow(count, "bucket long, n long")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"))
    )


def bucket_gains(
    docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS
) -> np.ndarray:
    """What a feature in each bucket adds to a weight, in thousandths; ``buckets`` numbers."""

    def of(texts: DataFrame) -> np.ndarray:
        counts = np.zeros(buckets)
        for row in feature_counts(texts, longest, buckets).collect():
            counts[row.bucket] = row.n
        return counts

    ours, theirs = of(docs), of(target)
    ratio = (theirs + 1) * (ours.sum() + buckets) / ((ours + 1) * (theirs.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weigher(gains: np.ndarray, longest: int):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            words, found = _features(piece.column("text"), longest, len(gains))
            weight = np.zeros(len(words), np.int64)
            features = np.zeros(len(words), np.int64)
            for buckets, firsts in found:
                sums = np.concatenate(([0], np.cumsum(gains[buckets])))
                weight += np.diff(sums[firsts])
                features += np.diff(firsts)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    piece.column("row_hash"),
                    pa.array(words, pa.int64()),
                    pa.array(features, pa.int64()),
                    pa.array(weight, pa.int64()),
                ],
                names=["doc_id", "row_hash", "n_words", "n_features", "weight"],
            )

    return weigh


def _noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from a hash of the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def kth_key(keys: DataFrame, k: int, pivots: int = PIVOTS) -> Row:
    """The ``k``-th smallest row of ``keys``, counted from 1, in the order of its columns.

    Nulls come first. The last column is a number that no two rows share, from which each round
    draws its pivots. A round counts, exactly and in one pass, the rows below and equal to every
    pivot, and goes on with the rows between the two around the ``k``-th, written anew, about one
    in ``pivots``. So all rounds together read little more than the first. The driver gets
    ``pivots`` rows and their counts.
    """
    spark = keys.sparkSession
    kinds = dict(keys.dtypes)
    key = F.struct(*keys.columns)

    def literal(row: Row) -> Column:
        return F.struct(*[F.lit(row[name]).cast(kinds[name]).alias(name) for name in kinds])

    rest, path, turn = keys, None, 0
    while True:
        turn += 1
        lot = F.xxhash64(F.col(keys.columns[-1]), F.lit(turn))
        drawn = rest.orderBy(lot, keys.columns[-1]).limit(pivots).collect()
        counts = [f(key, literal(row)) for row in drawn for f in (_below, _equal)]
        found = rest.agg(*[count.alias(f"n{i}") for i, count in enumerate(counts)]).first()
        lower = upper = None
        for row, below, equal in zip(drawn, found[::2], found[1::2]):
            if below < k <= below + equal:
                if path:
                    discard(spark, path)
                return row
            if below + equal < k and (lower is None or below > lower[1]):
                lower = row, below, below + equal
            if below >= k and (upper is None or below < upper[1]):
                upper = row, below
        between = rest
        if lower:
            between = between.filter(key > literal(lower[0]))
            k -= lower[2]
        if upper:
            between = between.filter(key < literal(upper[0]))
        before, path = path, scratch_path(spark, "between")
        rest = stored_at(between, path)
        if before:
            discard(spark, before)


def _below(key: Column, pivot: Column) -> Column:
    return F.count_if(key < pivot)


def _equal(key: Column, pivot: Column) -> Column:
    return F.count_if(key == pivot)


def importance(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    seed: int = SEED,
    pivots: int = PIVOTS,
) -> DataFrame:
    """Weight, score and, where drawn, rank of every row of ``docs``.

    Words are runs of ASCII letters and digits and of any other character from U+0080; A-Z count
    as a-z. Features are the runs of 1 to ``longest`` words, repeats counted, in ``buckets`` by
    the CRC-32 of their UTF-8 bytes. ``weight`` sums the gains of a document's features, ``score``
    adds noise from a hash of ``seed`` and the id. Of the n documents with ``least_words`` words
    at least, the ``percent * n // 100`` highest scores are drawn and ranked from 1; ties go to
    the smaller ``doc_id``, null last, then to fewer features; rows equal in all these are
    interchangeable, and as many of them are drawn as there is room for.

    Returns ``doc_id, row_hash, n_words, n_features, weight, score, rank``, the rank null for
    rows that are not drawn. Null and empty texts have no words and the weight 0. Repeated rows
    are each scored. Other columns are not read. An empty target gives every feature of the
    documents the smallest gain that its count allows; an empty table gives an empty one.

    All documents are read twice, to count and to weigh. Of them the driver gets ``buckets``
    numbers, and ``pivots`` keys a round; the winners alone are sorted, by ranges.
    """
    gains = bucket_gains(docs, target, longest, buckets)
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", row_hash(docs).alias("row_hash"), "text")
    weighed = rows.mapInArrow(
        _weigher(gains, longest),
        f"doc_id {kind}, row_hash long, n_words long, n_features long, weight long",
    )
    scored = stored(
        weighed.withColumns(
            {
                "score": F.col("weight") + _noise(F.col("doc_id"), seed),
                "place": F.monotonically_increasing_id(),
            }
        ),
        "scored",
    )
    order = {
        "worse": -F.col("score"),
        "nameless": F.col("doc_id").isNull(),
        "doc_id": F.col("doc_id"),
        "n_features": F.col("n_features"),
        "place": F.col("place"),
    }
    key = [column.alias(name) for name, column in order.items()]
    enough = F.col("n_words") >= least_words
    names = ["doc_id", "row_hash", "n_words", "n_features", "weight", "score"]
    drawn = percent * scored.filter(enough).count() // 100
    if drawn < 1:
        return scored.select(*names, F.lit(None).cast("long").alias("rank"))
    last = kth_key(scored.filter(enough).select(*key), drawn, pivots)
    kinds = dict(scored.select(*key).dtypes)
    last = F.struct(*[F.lit(last[name]).cast(kinds[name]).alias(name) for name in order])
    wins = enough & (F.struct(*key) <= last)
    return ranked(scored.filter(wins), list(order.values())).select(*names, "rank").unionByName(
        scored.filter(~wins).select(*names, F.lit(None).cast("long").alias("rank"))
    )


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank``, 1, 2, 3, ... in ``order``, numbered by ranges.

    Each range is sorted in a task of its own; a table of one row a range has the numbers before
    each. The order must be total, and the rows from a stored table, for the numbers to be
    the same when a task runs again.
    """
    local = F.col("place_in_order")
    placed = stored(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("place_in_order", F.monotonically_increasing_id()),
        "ranked",
    ).withColumn("range", F.shiftright(local, 33))
    sizes = placed.groupBy("range").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.orderBy("range")) - F.col("size")
    return (
        placed.join(sizes.select("range", before.alias("before")), "range")
        .withColumn("rank", F.col("before") + local.bitwiseAND(F.lit((1 << 33) - 1)) + 1)
        .drop("range", "before", "place_in_order")
    )


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The documents that ``importance`` draws, whole, columns as in ``docs``.

    Rows equal in all columns are one document, given as often as it is drawn.
    """
    drawn = (
        importance(docs, target, **options)
        .filter("rank is not null")
        .groupBy("doc_id", "row_hash")
        .agg(F.count("*").cast("int").alias("copies"))
    )
    times = unused(docs, "copies")
    names = [f"`{name}`" for name in docs.columns]
    return (
        matched(docs, drawn, "copies")
        .select(*names, F.explode(F.array_repeat(F.lit(0), F.col(times))))
        .select(*names)
    )
