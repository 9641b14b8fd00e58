"""Documents that repeat passages of benchmark items."""

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from strandline.llm.bytetext import pieces, spans as runs
from strandline.llm.frames import unused
from strandline.llm.wu_manber import Words, searchers
from strandline.plans.storage import discard, scratch_path, stored, stored_at

WINDOW = 10
#: Bytes of item texts whose windows are searched for at once.
BLOCK_BYTES = 8_000_000


def _parts(items: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The items in parts of about ``block_bytes`` of text."""
    rows = items.select(
        F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    if count > 1:
        rows = stored(rows, "items")
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    return [rows.filter(part == number) for number in range(count)]


def _block(part: DataFrame, window: int) -> Broadcast:
    """The searchers of one part of the items, and the items' ids."""
    rows = part.toArrow()
    words = Words.of(rows.column("text").combine_chunks())
    ids = rows.column("item_id").to_pylist()
    return part.sparkSession.sparkContext.broadcast((searchers(words, window), ids))


def _searched(
    docs: DataFrame, items: DataFrame, window: int, block_bytes: int, describe: Callable, schema
) -> DataFrame:
    """``describe`` of each document's words, words hit, and items met.

    One pass over the documents for each part of the items. Between two passes the documents are
    written with the hits so far (runs of words, and items), and the part's searchers are
    released: driver and workers hold those of one part at any time.
    """
    parts = _parts(items, block_bytes)
    spans, met = unused(docs, "hit_spans"), unused(docs, "hit_items")
    previous = None
    for nth, part in enumerate(parts):
        block, earlier = _block(part, window), (spans, met) if nth else None
        if nth == len(parts) - 1:
            return docs.mapInArrow(_matcher(block, earlier, describe), schema)
        more = StructType(
            [
                *[field for field in docs.schema.fields if field.name not in (spans, met)],
                StructField(spans, ArrayType(LongType())),
                StructField(met, ArrayType(StringType())),
            ]
        )
        found = docs.mapInArrow(_matcher(block, earlier, _carried(spans, met)), more)
        path = scratch_path(docs.sparkSession, "searched")
        docs = stored_at(found, path)
        block.destroy()
        if previous:
            discard(docs.sparkSession, previous)
        previous = path


def _matcher(block: Broadcast, earlier: tuple[str, str] | None, describe: Callable) -> Callable:
    """Adds the hits of one block to those in the columns ``earlier``."""

    def match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, ids = block.value
        for batch in pieces(batches):
            words = Words.of(batch.column("text"))
            step = np.zeros(len(words.begins) + 1, np.int64)
            items: list[set[str]] = [set() for _ in range(batch.num_rows)]
            if earlier:
                for doc, edges in enumerate(batch.column(earlier[0]).to_pylist()):
                    at = np.array(edges, np.int64) + words.firsts[doc]
                    np.add.at(step, at[0::2], 1)
                    np.add.at(step, at[1::2], -1)
                for doc, own in enumerate(batch.column(earlier[1]).to_pylist()):
                    items[doc].update(own)
                batch = batch.drop_columns(list(earlier))
            for searcher in parts:
                first, pattern = searcher.find(words)
                np.add.at(step, first, 1)
                np.add.at(step, first + searcher.size, -1)
                doc = np.searchsorted(words.firsts, first, side="right") - 1
                met = np.unique(np.stack((doc, pattern)), axis=1)
                for d, p in met.T.tolist():
                    own = searcher.owners[slice(*searcher.owner_begins[p : p + 2])]
                    items[d].update(ids[i] for i in own.tolist() if ids[i] is not None)
            yield describe(batch, words, np.cumsum(step[:-1]) > 0, items)

    return match


def _n_hit(words: Words, hit: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(hit)))[words.firsts])


def _carried(spans: str, met: str) -> Callable:
    """The rows as they are, with the runs of words hit (begin and end in turn) and items met."""

    def carry(batch, words, hit, items) -> pa.RecordBatch:
        begins, ends = runs(hit, words.firsts)
        doc = np.searchsorted(words.firsts, begins, side="right") - 1
        edges = np.stack((begins, ends), axis=1) - words.firsts[doc][:, None]
        places = 2 * np.searchsorted(begins, words.firsts)
        lists = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(edges.ravel()))
        own = pa.array([sorted(each) for each in items], pa.list_(pa.string()))
        return batch.append_column(spans, lists).append_column(met, own)

    return carry


def _report(batch, words, hit, items) -> pa.RecordBatch:
    n_hit = _n_hit(words, hit)
    joined = [",".join(sorted(own)) for own in items]
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            pa.array(words.counts, pa.int64()),
            pa.array(n_hit, pa.int64()),
            pa.array([len(own) for own in items], pa.int64()),
            pa.array([hashlib.sha256(ids.encode()).hexdigest() for ids in joined]),
            pa.array(n_hit > 0),
        ],
        names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    )


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """How far each whole text of ``docs`` repeats the texts of ``items``.

    Words are runs of ASCII letters and digits and of any other character from U+0080; A-Z count
    as a-z. A window is ``window`` consecutive words of an item, or all words of an item that has
    fewer. Returns, for each row of ``docs`` in no order, ``doc_id``, ``n_words``, ``n_hit``
    (words inside any occurrence of a window), ``n_items`` (different ids of the items with
    occurring windows), ``items_sha256`` (of those ids as strings, sorted, with commas between)
    and ``contaminated`` (``n_hit`` > 0).

    Null and empty texts have no words. Null item ids hit words but are not listed; several items
    with one id count once; an item repeated changes nothing. Without items nothing is hit. Other
    columns are not read. Repeated rows are each reported.

    The items are a stated query set: ``block_bytes`` of their texts at a time are gathered and
    sent to the tasks, one pass over the documents each, and released after it; a single longer
    item is a block by itself.
    """
    rows = docs.select("doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]
    return _searched(
        rows,
        items,
        window,
        block_bytes,
        _report,
        f"doc_id {kind}, n_words long, n_hit long, n_items long,"
        " items_sha256 string, contaminated boolean",
    )


def without_contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The rows of ``docs`` that have no word inside a window of ``items``, all columns as given."""

    def flag(batch, words, hit, items) -> pa.RecordBatch:
        return batch.append_column(name, pa.array(_n_hit(words, hit) > 0))

    name = unused(docs, "contaminated")
    schema = docs.select("*", F.lit(False).alias(name)).schema
    flagged = _searched(docs, items, window, block_bytes, flag, schema)
    return flagged.filter(~F.col(name)).drop(name)
