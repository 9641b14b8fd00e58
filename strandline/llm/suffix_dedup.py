"""Removal of byte stretches that a document with a smaller id has too."""

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from strandline.llm.bytetext import encoded, hashed, mixed, pieces, ragged, rolling
from strandline.llm.repeats import LENGTH, Q, anchors, refined, surroundings
from strandline.plans.storage import stored

#: Anchors that one task compares, about.
PART_ANCHORS = 1_000_000
#: Anchors that are compared where they are found.
BLOCK_ANCHORS = 500_000
#: Surroundings that one task refines, about; a q-gram with more of them is dealt to several.
PART_ASKED = 15_000
_PIECE = 1_000_000

_BLOCK = (
    "part int, doc_ids binary, checks binary, lengths binary, counts binary, before binary,"
    " after binary, around binary, width byte, places binary, runs binary, bounds binary"
)
_FOUND = (
    "bucket int, doc_ids binary, checks binary, n_runs binary, runs binary, n_asked binary,"
    " asked binary"
)
_BY_TEXT = "doc_id long, check long, runs binary, asked binary"


def _packed(numbers: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number."""
    whole = np.ascontiguousarray(numbers.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return whole[:, :width].tobytes()


def _unpacked(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _binary(data: np.ndarray, places: np.ndarray) -> pa.Array:
    """Stretches of an array as one binary each; ``places`` in numbers of the array."""
    raw = pa.py_buffer(np.ascontiguousarray(data))
    at = pa.py_buffer((places * data.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, at, raw])


def _first_in_class(
    around: np.ndarray, sides: np.ndarray, doc_ids: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Class of each anchor by its surroundings, and each class's smallest document.

    Surroundings count as equal if all 64 bits of their hash agree, and 64 of two more: those of
    the q-gram with the bytes on either side (``sides``).
    """
    order = np.argsort(around, kind="stable")
    same = around[order][1:] == around[order][:-1]
    if (same & (sides[order][1:] != sides[order][:-1])).any():
        order = np.lexsort((sides, around))
        same = around[order][1:] == around[order][:-1]
    new = np.ones(len(order), bool)
    new[1:] = ~same | (sides[order][1:] != sides[order][:-1])
    member = np.empty(len(order), np.int64)
    member[order] = np.cumsum(new) - 1
    least = np.minimum.reduceat(doc_ids[order], np.flatnonzero(new)) if len(order) else doc_ids
    return member, least


def _merged(
    owner: np.ndarray, begins: np.ndarray, ends: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the stretches of each owner, by owner and place."""
    order = np.lexsort((begins, owner))
    owner, begins, ends = owner[order], begins[order], ends[order]
    # owners apart, so that one running maximum serves all
    far = int(ends.max()) + 2 if len(ends) else 1
    reach = np.maximum.accumulate(ends + owner * far)
    new = np.ones(len(owner), bool)
    new[1:] = begins[1:] + owner[1:] * far > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner)) - 1 if len(first) else first
    return owner[first], begins[first], reach[last] - owner[first] * far


def _dealt(
    ids: np.ndarray,
    checks: np.ndarray,
    runs: tuple[np.ndarray, np.ndarray],
    asked: tuple[np.ndarray, np.ndarray],
    buckets: int,
) -> pa.Table:
    """What was found, with the documents' numbers, as one row for each bucket of documents."""
    bucket = (mixed(ids.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    used = np.unique(np.concatenate((runs[0], asked[0])))
    used = used[np.argsort(bucket[used], kind="stable")]
    rank = np.zeros(len(ids), np.int64)
    rank[used] = np.arange(len(used))
    columns = {}
    cuts = np.searchsorted(bucket[used], np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(cuts))
    at = np.append(cuts[full], len(used))
    columns["bucket"] = pa.array(full.astype(np.int32))
    columns["doc_ids"] = _binary(ids[used].astype("<i8"), at)
    columns["checks"] = _binary(checks[used].astype("<u4"), at)
    for name, (owner, values) in (("runs", runs), ("asked", asked)):
        order = np.argsort(rank[owner], kind="stable")
        counts = np.bincount(rank[owner], minlength=len(used))
        columns[f"n_{name}"] = _binary(counts.astype("<u4"), at)
        width = values[0].size if len(values) else 1
        begins = np.concatenate(([0], np.cumsum(counts)))[at] * width
        columns[name] = _binary(values[order].astype("<u4").ravel(), begins)
    return pa.table(columns)


def _gathered(table: pa.Table) -> pa.Table:
    """The parts' findings of a bucket: one row a text, its runs as unions."""

    def joined(name: str, kind: str) -> np.ndarray:
        raw = b"".join(table.column(name).to_pylist())
        return np.frombuffer(raw, kind).astype(np.int64)

    both = np.stack((joined("doc_ids", "<i8"), joined("checks", "<u4")))
    texts, which = np.unique(both, axis=1, return_inverse=True)
    which = which.ravel()
    bounds = joined("runs", "<u4").reshape(-1, 2)
    owner, begins, ends = _merged(
        np.repeat(which, joined("n_runs", "<u4")), bounds[:, 0], bounds[:, 1]
    )
    asked = np.repeat(which, joined("n_asked", "<u4"))
    order = np.argsort(asked, kind="stable")
    every = np.arange(texts.shape[1] + 1)
    return pa.table(
        {
            "doc_id": pa.array(texts[0]),
            "check": pa.array(texts[1]),
            "runs": _binary(
                np.stack((begins, ends), axis=1).astype("<u4").ravel(),
                2 * np.searchsorted(owner, every),
            ),
            "asked": _binary(
                joined("asked", "<u4")[order].astype("<u4"),
                np.searchsorted(asked[order], every),
            ),
        }
    )


class _Block:
    """Anchors of documents of one task, compared with each other before they are sent on."""

    def __init__(self, parts: int):
        self.parts = parts
        self.docs: list[np.ndarray] = []
        self.found: list[np.ndarray] = []
        self.n_docs = self.n_found = 0

    def add(self, batch: pa.RecordBatch) -> None:
        data, places = encoded(batch.column("text"))
        at, text, *names = anchors(data, places)
        ids = batch.column("doc_id").to_numpy()
        docs = np.stack((ids, batch.column("check").to_numpy(), np.diff(places)))
        rows = np.stack((text + self.n_docs, at - places[text]))
        self.docs.append(docs)
        self.found.append((rows, np.stack(names)))
        self.n_docs += len(ids)
        self.n_found += len(at)

    def emptied(self) -> Iterator[pa.RecordBatch]:
        ids, checks, lengths = np.concatenate(self.docs, axis=1)
        doc, place = np.concatenate([rows for rows, _ in self.found], axis=1)
        gram, around, before, after = np.concatenate([names for _, names in self.found], axis=1)
        self.__init__(self.parts)
        high = np.uint64(32)
        sides = before >> high << high | after >> high
        member, least = _first_in_class(around, sides, ids[doc])
        twice = ids[doc] > least[member]
        begins, ends = surroundings(place[twice], 0, lengths[doc[twice]])
        run_doc, run_begin, run_end = _merged(doc[twice], begins, ends)
        doc, place, gram, around, before, after = (
            x[~twice] for x in (doc, place, gram, around, before, after)
        )
        part = (gram % np.uint64(self.parts)).astype(np.int64)
        order = np.lexsort((place, doc, part))
        cuts = np.searchsorted(part[order], np.arange(self.parts + 1))
        run_part = run_doc % self.parts
        rows: dict[str, list] = {field.name: [] for field in _SCHEMA}
        for number in range(self.parts):
            own = order[cuts[number] : cuts[number + 1]]
            mine = run_part == number
            if not len(own) and not mine.any():
                continue
            used, index = np.unique(np.concatenate((doc[own], run_doc[mine])), return_inverse=True)
            rows["part"].append(number)
            rows["doc_ids"].append(ids[used].astype("<i8").tobytes())
            rows["checks"].append(checks[used].astype("<u4").tobytes())
            rows["lengths"].append(lengths[used].astype("<u4").tobytes())
            counts = np.bincount(index[: len(own)], minlength=len(used))
            rows["counts"].append(counts.astype("<u4").tobytes())
            rows["before"].append(_packed(before[own] >> np.uint64(32), 4))
            rows["after"].append(_packed(after[own] >> np.uint64(32), 4))
            rows["around"].append(_packed(around[own], 8))
            width = (int(place[own].max(initial=1)).bit_length() + 7) // 8
            rows["width"].append(width)
            rows["places"].append(_packed(place[own], width))
            rows["runs"].append(index[len(own) :].astype("<u4").tobytes())
            bounds = np.stack((run_begin[mine], run_end[mine]), axis=1)
            rows["bounds"].append(bounds.astype("<u4").tobytes())
        yield pa.RecordBatch.from_pydict(rows, schema=_SCHEMA)


_SCHEMA = pa.schema(
    (name, {"int": pa.int32(), "byte": pa.int8(), "binary": pa.binary()}[kind])
    for name, kind in (column.split() for column in _BLOCK.split(", "))
)


def _anchored(parts: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(parts)
        for batch in pieces(batches, limit=_PIECE):
            block.add(batch)
            if block.n_found >= BLOCK_ANCHORS:
                yield from block.emptied()
        if block.n_docs:
            yield from block.emptied()

    return run


def _compared(table: pa.Table, buckets: int) -> pa.Table:
    """Of all anchors of a part: runs of documents found in a smaller one, and what is to be
    looked at in the text, as surroundings that differ may share a stretch."""

    def joined(name: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
        each = [np.frombuffer(raw, kind) for raw in table.column(name).to_pylist()]
        return np.concatenate(each).astype(np.int64), np.array([len(x) for x in each])

    def unpacked(name: str, width: int) -> np.ndarray:
        return np.concatenate([_unpacked(raw, width) for raw in table.column(name).to_pylist()])

    ids, n_docs = joined("doc_ids", "<i8")
    checks, lengths = joined("checks", "<u4")[0], joined("lengths", "<u4")[0]
    doc = np.repeat(np.arange(len(ids)), joined("counts", "<u4")[0])
    widths = table.column("width").to_pylist()
    place = np.concatenate(
        [_unpacked(raw, n) for raw, n in zip(table.column("places").to_pylist(), widths)]
    ).astype(np.int64)
    around, before, after = unpacked("around", 8), unpacked("before", 4), unpacked("after", 4)
    run_doc, n_runs = joined("runs", "<u4")
    run_doc = run_doc + np.repeat(np.cumsum(n_docs) - n_docs, n_runs)
    bounds = joined("bounds", "<u4")[0].reshape(-1, 2)

    sides = before << np.uint64(32) | after
    member, least = _first_in_class(around, sides, ids[doc])
    twice = ids[doc] > least[member]
    begins, ends = surroundings(place[twice], 0, lengths[doc[twice]])
    owner, begins, ends = _merged(
        np.concatenate((run_doc, doc[twice])),
        np.concatenate((bounds[:, 0], begins)),
        np.concatenate((bounds[:, 1], ends)),
    )
    # classes that may share a stretch are compared byte by byte, each by its smallest document
    shared = np.zeros(len(least), bool)
    for side in (before, after):
        of_class = np.zeros(len(least), np.uint64)
        of_class[member] = side
        _, which, several = np.unique(of_class, return_inverse=True, return_counts=True)
        shared |= several[which] > 1
    asked = np.flatnonzero(shared[member] & ~twice)
    runs = np.stack((begins, ends), axis=1)
    return _dealt(ids, checks, (owner, runs), (doc[asked], place[asked]), buckets)


def _looked_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The surroundings that are asked for, with where they are."""
    with_id = (batch.filter(batch.column("doc_id").is_valid()) for batch in batches)
    for batch in pieces(with_id, limit=_PIECE):
        data, places = encoded(batch.column("text"))
        asked = [np.frombuffer(raw, "<u4") for raw in batch.column("asked").to_pylist()]
        owner = np.repeat(np.arange(len(asked)), [len(x) for x in asked])
        at = np.concatenate(asked).astype(np.int64) + places[owner]
        begins, ends = surroundings(at, places[owner], places[owner + 1])
        sizes = ends - begins
        index = pa.array(owner)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(hashed(rolling(data), at, at + Q).view(np.int64)),
                batch.column("doc_id").take(index),
                batch.column("check").take(index),
                pa.array(begins - places[owner], pa.int64()),
                _binary(data[ragged(begins, sizes)], np.concatenate(([0], np.cumsum(sizes)))),
            ],
            names=["gram", "doc_id", "check", "begin", "bytes"],
        )


def _refined(table: pa.Table, buckets: int) -> pa.Table:
    table = table.combine_chunks()
    raw = table.column("bytes").to_pylist()
    data = np.frombuffer(b"".join(raw), np.uint8)
    places = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
    ids = table.column("doc_id").to_numpy()
    checks, begin = table.column("check").to_numpy(), table.column("begin").to_numpy()
    live, bucket = refined(data, places)
    text = np.searchsorted(places, live, side="right") - 1
    if len(live):
        order = np.argsort(bucket, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = bucket[order][1:] != bucket[order][:-1]
        least = np.minimum.reduceat(ids[text][order], np.flatnonzero(new))
        twice = np.empty(len(order), bool)
        twice[order] = ids[text][order] > least[np.cumsum(new) - 1]
        live, text = live[twice], text[twice]
    return _as_runs(ids, checks, text, live - places[text] + begin[text], buckets)


def _as_runs(
    ids: np.ndarray, checks: np.ndarray, text: np.ndarray, at: np.ndarray, buckets: int
) -> pa.Table:
    """Stretches that go, given by their begins ``at`` in the texts."""
    text, begins, ends = _merged(text, at, at + LENGTH)
    nothing = np.zeros(0, np.int64)
    runs = np.stack((begins, ends), axis=1)
    return _dealt(ids, checks, (text, runs), (nothing, nothing), buckets)


def _stretches(table: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """All stretches of ``LENGTH`` bytes of surroundings: row, place in it, 128-bit digest."""
    raw = table.column("bytes").to_pylist()
    sizes = np.array([len(x) for x in raw], np.int64)
    each = np.maximum(sizes - LENGTH + 1, 0)
    digests = [
        hashlib.blake2b(text[i : i + LENGTH], digest_size=16).digest()
        for text, n in zip(raw, each.tolist())
        for i in range(n)
    ]
    owner = np.repeat(np.arange(len(raw)), each)
    return owner, ragged(np.zeros(len(raw), np.int64), each), pa.array(digests, pa.binary())


def _least_of_share(table: pa.Table) -> pa.Table:
    """Each distinct stretch of a share once, with its smallest and largest document."""
    owner, _, digests = _stretches(table)
    ids = table.column("doc_id").combine_chunks().take(pa.array(owner))
    found = pa.table({"digest": digests, "doc_id": ids}).group_by("digest")
    found = found.aggregate([("doc_id", "min"), ("doc_id", "max")])
    share = pa.array(np.full(len(found), table.column("share")[0].as_py()), pa.int64())
    return pa.table(
        {
            "share": share,
            "digest": found.column("digest"),
            "least": found.column("doc_id_min"),
            "most": found.column("doc_id_max"),
        }
    )


def _settled(table: pa.Table, known: pa.Table, buckets: int) -> pa.Table:
    """A share's stretches that are in a smaller document of any share."""
    owner, at, digests = _stretches(table)
    ids = table.column("doc_id").to_numpy()
    checks, begin = table.column("check").to_numpy(), table.column("begin").to_numpy()
    nth = pc.index_in(digests, value_set=known.column("digest").combine_chunks())
    met = nth.is_valid().to_numpy(zero_copy_only=False)
    least = known.column("least").to_numpy()[nth.drop_null().to_numpy()]
    owner, at = owner[met], at[met]
    twice = ids[owner] > least
    owner, at = owner[twice], at[twice]
    return _as_runs(ids, checks, owner, at + begin[owner], buckets)


def _refined_in_shares(crowded: DataFrame, count: int, buckets: int) -> DataFrame:
    """As ``_refined``, for q-grams with more questions than a task can take.

    Shares of the questions, dealt by a hash, tell their distinct stretches; the smallest
    document of each comes from all shares and goes back to those that have it.
    """
    shares = -(-count // PART_ASKED)
    dealt = F.pmod(F.xxhash64("doc_id", "check", "begin"), F.lit(shares)).alias("share")
    # a repeated row asks the same again
    dealt = crowded.dropDuplicates().select("doc_id", "check", "begin", "bytes", dealt)
    told = stored(
        dealt.groupBy("share").applyInArrow(
            _least_of_share, "share long, digest binary, least long, most long"
        ),
        "stretches",
    )
    least = told.groupBy("digest").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    known = told.select("share", "digest").join(
        least.filter("least < most").select("digest", "least"), "digest"
    )

    def settled(table: pa.Table, known: pa.Table) -> pa.Table:
        return _settled(table, known, buckets)

    return dealt.groupBy("share").cogroup(known.groupBy("share")).applyInArrow(settled, _FOUND)


def _kept(batches: Iterable[pa.RecordBatch], describe: Callable) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        data, places = encoded(batch.column("text"))
        gone, n_spans, left = [], [], []
        raw, bounds = data.tobytes(), places.tolist()
        for a, b, runs in zip(bounds, bounds[1:], batch.column("runs").to_pylist()):
            text = raw[a:b]
            if runs:
                each = np.frombuffer(b"".join(runs), "<u4").reshape(-1, 2).astype(np.int64)
                _, begins, ends = _merged(np.zeros(len(each), np.int64), each[:, 0], each[:, 1])
                edges = [0, *np.stack((begins, ends), axis=1).ravel().tolist(), len(text)]
                text = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2]))
                n_spans.append(len(begins))
            else:
                n_spans.append(0)
            gone.append(b - a - len(text))
            left.append(text)
        yield describe(batch, np.diff(places), gone, n_spans, left)


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def describe(batch, sizes, gone, n_spans, left) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(sizes, pa.int64()),
                pa.array(gone, pa.int64()),
                pa.array(n_spans, pa.int64()),
                pa.array([hashlib.sha256(text).hexdigest() for text in left]),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    return _kept(batches, describe)


def _remaining(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def describe(batch, sizes, gone, n_spans, left) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(left, pa.binary())], names=["doc_id", "kept"]
        )

    return _kept(batches, describe)


def _with_runs(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` with ``runs``, the stretches to remove, several to a document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # never null, so that both joins below read one shuffle of the texts
    rows = rows.select(
        F.coalesce("doc_id", F.lit(0)).alias("key"),
        F.coalesce(F.crc32("text"), F.lit(0)).alias("check"),
        "doc_id",
        "text",
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # about one anchor in 18 bytes
    parts = max(1, -(-total // (16 * PART_ANCHORS)))

    def by_text(found: DataFrame) -> DataFrame:
        return found.groupBy("bucket").applyInArrow(_gathered, _BY_TEXT)

    def compared(table: pa.Table) -> pa.Table:
        return _compared(table, parts)

    def refined(table: pa.Table) -> pa.Table:
        return _refined(table, parts)

    found = stored(
        by_text(
            rows.filter(f"doc_id is not null and octet_length(text) >= {LENGTH}")
            .select("doc_id", "check", "text")
            .mapInArrow(_anchored(parts), _BLOCK)
            .groupBy("part")
            .applyInArrow(compared, _FOUND)
        ),
        "anchors",
    )
    asked = found.filter(F.octet_length("asked") > 0)
    # four bytes a question
    count = asked.agg(F.sum(F.octet_length("asked"))).first()[0] or 0
    groups = max(1, -(-count // (4 * PART_ASKED)))
    looked_up = stored(
        rows.join(asked.select(F.col("doc_id").alias("key"), "check", "asked"), ["key", "check"])
        .select("doc_id", "check", "text", "asked")
        .mapInArrow(_looked_up, "gram long, doc_id long, check long, begin long, bytes binary"),
        "asked",
    )
    # one q-gram's questions meet in one task, unless they are too many
    sizes = looked_up.groupBy("gram").agg(F.count("*").alias("n"))
    crowded = stored(sizes.filter(F.col("n") > PART_ASKED), "crowded")
    n_crowded = crowded.agg(F.sum("n")).first()[0] or 0
    rest = looked_up
    if n_crowded:
        rest = looked_up.join(crowded, "gram", "left_anti")
    settled = rest.groupBy(F.pmod("gram", F.lit(groups)).alias("part")).applyInArrow(refined, _FOUND)
    if n_crowded:
        many = looked_up.join(crowded, "gram", "left_semi")
        settled = settled.union(_refined_in_shares(many, n_crowded, parts))
    more = by_text(settled)
    runs = (
        found.filter(F.octet_length("runs") > 0)
        .select("doc_id", "check", "runs")
        .union(more.select("doc_id", "check", "runs"))
        .groupBy("doc_id", "check")
        .agg(F.collect_list("runs").alias("runs"))
        .withColumnRenamed("doc_id", "key")
    )
    found = F.when(F.col("doc_id").isNotNull(), F.col("runs")).alias("runs")
    return rows.join(runs, ["key", "check"], "left").select("doc_id", "text", found)


def deduplicated(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``kept``, the bytes of each text that remain, for each row of ``docs``.

    Every byte is removed that a stretch of ``LENGTH`` bytes covers which also starts in a row
    with a smaller ``doc_id`` (an integer). Matches stay within a text; all are judged on the
    texts as given. Null texts count as empty. A null id is neither smaller nor larger: such rows
    stay whole and remove nothing; rows with one id remove nothing from each other. Repeated rows
    are each returned; other columns are not read; an empty table gives an empty one.

    Places are compared in three steps, and only anchors, about one in 18 bytes, are shuffled.
    (1) Anchors whose whole surroundings are in a smaller document settle all stretches that
    have them; those of one task are compared before the shuffle, and one document goes on for
    all. (2) Where a q-gram stands in different surroundings, these are looked up, one for each
    kind, and refined by bucket pointers; those of a q-gram with very many are dealt out to
    several tasks and compared stretch by stretch (128-bit digests). (3) Runs meet their texts.
    """
    return _with_runs(docs).mapInArrow(_remaining, "doc_id long, kept binary")


def removal(docs: DataFrame) -> DataFrame:
    """Instead of the bytes that remain ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed
    runs) and ``kept_sha256``; see ``deduplicated``."""
    return _with_runs(docs).mapInArrow(
        _digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
