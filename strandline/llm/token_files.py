"""Token ids of documents in binary files, and back.

A file set has two tables. ``ranks`` numbers the ids that occur by falling frequency.
``blocks`` has the documents in ascending order of their ids, cut into shards; a block holds the
ranks of some documents as control bytes, two bits an id for its number of bytes (1 to 4) and
four ids a byte, and apart from them the data bytes, the low byte of a rank first. Spark writes
both, so that a lost task is written anew and nothing half-written is read.
"""

import os
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strandline.llm.bytetext import encoded, hashed, pieces, ragged, rolling
from strandline.plans.storage import discard, scratch_path

END_ID = 2
SHARD_IDS = 8_000_000
BLOCK_IDS = 100_000
#: Words whose ids a task remembers; when there are more it begins anew.
REMEMBERED = 800_000

_BYTES = np.arange(256)
_SPACE, _NEWLINE = 0x20, 0x0A
_LATIN = 0xC3  # first byte of the letters from U+00C0 to U+00FF
_SEEN = (_BYTES > 0x20) & (_BYTES < 0x7F)
_LETTER = ((_BYTES | 0x20) >= 0x61) & ((_BYTES | 0x20) <= 0x7A) & (_BYTES < 0x80)
_MARK = np.isin(_BYTES, list(b".,;:!?"))
_SLOTS = 21  # bits
_JOINED = 4000


def _parts(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of parts that a byte-level tokenizer encodes alike alone and in their text.

    Its pattern begins a new word at a single space between two characters that are not white
    space, before and after a single line end between two such, and at a mark after a letter.
    Only ASCII and Latin letters are looked at; where others stand there is no cut. The third
    array tells which parts neither begin nor end with white space, but for one space before.
    """
    size = len(data)
    before = _SEEN[data]
    latin = np.zeros(size, bool)
    latin[1:] = (data[:-1] == _LATIN) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    before |= latin
    after = _SEEN[data] | (data == _LATIN)
    cut = np.zeros(size + 1, bool)
    if size > 2:
        between = before[:-2] & after[2:]
        line = (data[1:-1] == _NEWLINE) & between
        cut[1 : size - 1] = (data[1:-1] == _SPACE) & between | line
        cut[2:size] |= line
        cut[1:size] |= _MARK[data[1:]] & (_LETTER[data[:-1]] | latin[:-1])
    cut[places] = True
    begins = np.flatnonzero(cut[:size])
    ends = np.append(begins[1:], size) if len(begins) else begins
    spaced = (data[begins] == _SPACE) & (ends - begins > 1)
    whole = after[np.minimum(begins + spaced, size - 1)] & before[ends - 1]
    return begins, ends, whole


class Encoder:
    """Encodes texts with a tokenizer of the tokenizers library, each part once."""

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        words = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(words.values()) + 1, np.int64)
        for word, number in words.items():
            self.bytes_of[number] = len(word)  # one character of the vocabulary is one byte
        for number, added in self.tokenizer.get_added_tokens_decoder().items():
            self.bytes_of[number] = len(added.content.encode())
        self._forget()

    def _forget(self) -> None:
        self.slots = np.zeros(1 << _SLOTS, np.int32)  # the part last seen with these first bits
        self.keys = np.zeros(1, np.uint64)
        self.begins = np.zeros(1, np.int64)
        self.sizes = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def __call__(self, data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and the number of each text's ids."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(places) - 1, np.int64)
        if len(self.keys) > REMEMBERED:
            self._forget()
        begins, ends, whole = _parts(data, places)
        keys = hashed(rolling(data), begins, ends)
        at = self.slots[keys >> np.uint64(64 - _SLOTS)].astype(np.int64)
        missed = np.flatnonzero(self.keys[at] != keys)
        if len(missed):
            new, first, which = np.unique(keys[missed], return_index=True, return_inverse=True)
            first = missed[first]
            at[missed] = len(self.keys) + which
            self._learn(new, data, begins[first], ends[first], whole[first])
        sizes = self.sizes[at]
        owner = np.searchsorted(begins, places)
        stops = np.concatenate(([0], np.cumsum(sizes)))
        return self.ids[ragged(self.begins[at], sizes)], np.diff(stops[owner])

    def _learn(
        self,
        keys: np.ndarray,
        data: np.ndarray,
        begins: np.ndarray,
        ends: np.ndarray,
        whole: np.ndarray,
    ) -> None:
        """Encode new parts: those that are ``whole`` joined by line ends, the others alone."""
        sizes = np.zeros(len(keys), np.int64)
        found, order = [], []
        joined = np.flatnonzero(whole)
        if len(joined):
            ids, counts = self._together(data, begins[joined], ends[joined])
            sizes[joined] = counts
            found.append(ids)
            order.append(joined)
        alone = np.flatnonzero(~whole)
        if len(alone):
            texts = [data[begins[i] : ends[i]].tobytes().decode() for i in alone.tolist()]
            each = [self._ids(x) for x in self._encode(texts)]
            sizes[alone] = [len(x) for x in each]
            found += each
            order.append(alone)
        place = np.zeros(len(keys), np.int64)
        order = np.concatenate(order)
        place[order] = len(self.ids) + np.cumsum(sizes[order]) - sizes[order]
        self.slots[keys >> np.uint64(64 - _SLOTS)] = len(self.keys) + np.arange(len(keys))
        self.keys = np.concatenate((self.keys, keys))
        self.begins = np.concatenate((self.begins, place))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.ids = np.concatenate([self.ids, *found])

    def _together(
        self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts, end to end, and the number of each part's ids.

        A line end between two parts is a word of its own, so every id's bytes tell its part.
        """
        widths = ends - begins + 1
        stops = np.cumsum(widths)
        text = np.full(int(stops[-1]), _NEWLINE, np.uint8)
        inside = np.ones(len(text), bool)
        inside[stops - 1] = False
        text[inside] = data[ragged(begins, ends - begins)]
        lines, a = [], 0
        while a < len(stops):
            low = int(stops[a] - widths[a])
            b = max(a + 1, int(np.searchsorted(stops, low + _JOINED)))
            lines.append(text[low : int(stops[b - 1])].tobytes().decode() + "x")
            a = b
        # the last line end is a word of its own only before another character
        ids = np.concatenate([self._ids(each)[:-1] for each in self._encode(lines)])
        reach = np.cumsum(self.bytes_of[ids])
        part = np.searchsorted(stops, reach)
        kept = reach != stops[part]
        return ids[kept], np.bincount(part[kept], minlength=len(stops))

    def _encode(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    @staticmethod
    def _ids(encoding) -> np.ndarray:
        return np.array(encoding.ids, np.uint32)


@lru_cache(maxsize=1)
def _kept_encoder(tokenizer_file: str) -> Encoder:
    """One for each worker process, kept from task to task."""
    return Encoder(tokenizer_file)


def _encoder(tokenizer_file: str, end_id: int) -> Callable:
    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _kept_encoder(tokenizer_file)
        for batch in pieces(batches):
            ids, counts = encoder(*encoded(batch.column("text")))
            stops = np.cumsum(counts + 1)
            out = np.full(int(stops[-1]), end_id, np.uint32)
            inside = np.ones(len(out), bool)
            inside[stops - 1] = False
            out[inside] = ids
            # the ids as 16-bit numbers where all fit
            wide = len(encoder.bytes_of) > 1 << 16 or end_id >= 1 << 16
            raw = out if wide else out.astype(np.uint16)
            places = np.concatenate(([0], stops * raw.itemsize)).astype(np.int32)
            ends = [
                zlib.crc32(out[a:b].tobytes())
                for a, b in zip([0, *stops[:-1].tolist()], stops.tolist())
            ]
            binary = pa.Array.from_buffers(
                pa.binary(), len(stops), [None, pa.py_buffer(places), pa.py_buffer(raw)]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(ends, pa.int64()),
                    pa.array(np.full(len(stops), raw.itemsize, np.int8)),
                    binary,
                ],
                names=["doc_id", "crc", "width", "ids"],
            )

    return encode


def _numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch of encoded documents, and how many each document has."""
    column = batch.column("ids").cast(pa.large_binary())
    _, places, data = column.buffers()
    places = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    kind = np.dtype(f"<u{batch.column('width')[0].as_py()}")
    raw = np.frombuffer(data, np.uint8)[places[0] : places[-1]]
    return raw.view(kind), np.diff(places) // kind.itemsize


def _tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        if batch.num_rows:
            counts = np.bincount(_numbers(batch)[0], minlength=len(total))
            counts[: len(total)] += total
            total = counts
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])


def compress(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of numbers below 2**32."""
    sizes = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    control = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    control[: len(ranks)] = sizes - 1
    control = (control.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    data = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), data[np.arange(4) < sizes[:, None]].tobytes()


#: Bytes of each of the four numbers that a control byte stands for.
_SIZES = 1 + (_BYTES[:, None] >> np.array([0, 2, 4, 6]) & 3)


def decompress(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ``count`` numbers that ``compress`` was given."""
    sizes = _SIZES[np.frombuffer(control, np.uint8)].ravel()[:count]
    begins = np.cumsum(sizes) - sizes
    raw = np.frombuffer(data, np.uint8)
    out = raw[begins].astype(np.uint32)
    for byte in (1, 2, 3):
        more = np.flatnonzero(sizes > byte)
        out[more] |= raw[begins[more] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return out


def _writer(ranked: np.ndarray, kind: pa.DataType, block_ids: int) -> Callable:
    """``ranked``: the ids by falling frequency."""
    rank = np.zeros(int(ranked.max()) + 1 if len(ranked) else 1, np.uint32)
    rank[ranked] = np.arange(len(ranked), dtype=np.uint32)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, counts = _numbers(batch)
            stops = np.cumsum(counts)
            a = 0
            while a < len(counts):
                low = int(stops[a] - counts[a])
                b = max(a + 1, int(np.searchsorted(stops, low + block_ids, side="right")))
                control, data = compress(rank[ids[low : stops[b - 1]]])
                row = {
                    "shard": [shard],
                    "block": [block],
                    "first": [first],
                    "doc_ids": [batch.column("doc_id").slice(a, b - a).to_pylist()],
                    "sizes": [counts[a:b].tolist()],
                    "control": [control],
                    "data": [data],
                }
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row[field.name], field.type) for field in fields], schema=fields
                )
                block, first, a = block + 1, first + int(stops[b - 1]) - low, b

    fields = pa.schema(
        {
            "shard": pa.int32(),
            "block": pa.int32(),
            "first": pa.int64(),
            "doc_ids": pa.list_(kind),
            "sizes": pa.list_(pa.int32()),
            "control": pa.binary(),
            "data": pa.binary(),
        }
    )
    return write


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_file: str,
    end_id: int = END_ID,
    shard_ids: int = SHARD_IDS,
    block_ids: int = BLOCK_IDS,
) -> None:
    """Write the ids of every whole text of ``docs`` (null: empty), each with an end id, to ``path``.

    Documents go by ascending ``doc_id``, null first; rows with one id by the checksum of their
    ids, so that repeated rows stay and the order is the same in every run. Other columns are not
    read. An empty table gives empty files. A text is held whole in one task and a document is
    never divided between blocks.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, crc long, width byte, ids binary"
    scratch = scratch_path(spark, "ids")
    encoded_rows = rows.mapInArrow(_encoder(tokenizer_file, end_id), schema)
    encoded_rows.write.option("compression", "zstd").parquet(scratch)
    found = spark.read.schema(schema).parquet(scratch)
    # one row for each id of the vocabulary at most, whatever the number of documents
    tally = (
        found.select("width", "ids")
        .mapInArrow(_tally, "id long, n long")
        .groupBy("id")
        .agg(F.sum("n").alias("n"))
        .toPandas()
        .sort_values(["n", "id"], ascending=[False, True])
    )
    ranked = tally["id"].to_numpy(np.int64)
    spark.createDataFrame(
        list(enumerate(ranked.tolist())), "rank long, id long"
    ).write.parquet(f"{path}/ranks")
    shards = max(1, -(-int(tally["n"].sum()) // shard_ids))
    in_arrow = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    (
        found.repartitionByRange(shards, "doc_id", "crc")
        .sortWithinPartitions("doc_id", "crc")
        .select("doc_id", "width", "ids")
        .mapInArrow(
            _writer(ranked, in_arrow, block_ids),
            f"shard int, block int, first long, doc_ids array<{kind}>, sizes array<int>,"
            " control binary, data binary",
        )
        .write.option("compression", "zstd")
        .parquet(f"{path}/blocks")
    )
    discard(spark, scratch)


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """The documents of a file set: ``doc_id``, ``start`` (ids of all documents before it) and
    ``ids``; with ``digest`` instead of the ids ``n_tokens`` and ``ids_crc32``, the checksum of
    the ids as little-endian unsigned 32-bit integers."""
    blocks = spark.read.parquet(f"{path}/blocks")
    ranks = spark.read.parquet(f"{path}/ranks").toPandas().sort_values("rank")
    ranked = ranks["id"].to_numpy(np.uint32)
    kind = dict(blocks.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")
    tail = "n_tokens long, ids_crc32 long" if digest else "ids array<int>"
    docs = blocks.drop("block").mapInArrow(
        _reader(ranked, digest), f"shard int, doc_id {kind}, first long, {tail}"
    )
    # one row a shard
    in_shard = F.aggregate("sizes", F.lit(0).cast("long"), lambda total, n: total + n)
    sizes = blocks.groupBy("shard").agg(F.sum(in_shard).alias("n"))
    before = sizes.select(
        "shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before")
    )
    names = ("n_tokens", "ids_crc32") if digest else ("ids",)
    return docs.join(before, "shard").select(
        "doc_id", (F.col("before") + F.col("first")).alias("start"), *names
    )


def _reader(ranked: np.ndarray, digest: bool) -> Callable:
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield one(batch.slice(row, 1))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc_ids = batch.column("doc_ids").flatten()
        sizes = batch.column("sizes").flatten().to_numpy().astype(np.int64)
        control, data = (batch.column(name)[0].as_py() for name in ("control", "data"))
        ids = ranked[decompress(control, data, int(sizes.sum()))]
        stops = np.cumsum(sizes)
        shard = np.full(len(sizes), batch.column("shard")[0].as_py(), np.int32)
        columns = [
            pa.array(shard),
            doc_ids,
            pa.array(stops - sizes + batch.column("first")[0].as_py()),
        ]
        bounds = [0, *stops.tolist()]
        if digest:
            sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])]
            columns += [pa.array(sizes), pa.array(sums, pa.int64())]
            names = ["shard", "doc_id", "first", "n_tokens", "ids_crc32"]
        else:
            columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), ids.view(np.int32)))
            names = ["shard", "doc_id", "first", "ids"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    return read
