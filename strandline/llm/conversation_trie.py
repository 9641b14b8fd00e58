"""Prefix trie of conversations: range-partitioned shards around a skeleton of splitters.

Every conversation is a path of turn digests. The paths are dealt to shards by range, and the
prefixes of the splitters between shards are the trie's skeleton, which all tasks get. The paths
of any other node lie in one shard, whose task finishes it in one walk over its sorted paths.
A skeleton node may lie in several; its shards send partial aggregates, which are added up along
the skeleton.
"""

import hashlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from strandline.plans.storage import discard, scratch_path, stored, stored_at

BLOCK = 5
HEAD = 9
#: Turns that a shard holds, about.
SHARD_TURNS = 200_000
#: Shards and skeleton nodes at most. Beyond, shards grow; results don't change.
MOST_SHARDS = 1 << 16
MOST_SKELETON = 1 << 20
#: Turns of a splitter at most; longer ones are cut.
SPLITTER_TURNS = 64

_DIGEST = 16
_SAMPLED = 8  # conversations looked at for each splitter
_EMPTY = hashlib.sha256(b"").digest()
_TOP = -1  # the skeleton node over the root

_FOUND = (
    "shard int, skeleton int, conv_id long, depth long, parent_skeleton int, parent_conv_id long,"
    " n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary"
)


def rebuilt(turns: DataFrame, block: int = BLOCK, head: int = HEAD) -> DataFrame:
    """``conv_id, path, sizes`` of every conversation as it is rebuilt.

    Conversation c gets the first h original turns of conversation c - c % ``block`` (the
    remainder has the sign of c), then its own turns after its first h; h is the CRC-32 of c in
    decimal, modulo ``head``. ``path`` has 16 bytes a turn, of the SHA-256 of role and text, and
    ``sizes`` the bytes of the texts. Turns are ordered by ``turn``, null first, then by digest.
    Texts are read once and go no further than their digests.
    """
    role, text = (F.coalesce(name, F.lit("")) for name in ("role", "text"))
    marked = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    conv_id = F.col("conv_id").cast("long")
    numbered = turns.filter("conv_id is not null").select(
        conv_id.alias("conv_id"),
        "turn",
        F.substring(F.unhex(F.sha2(marked, 256)), 1, _DIGEST).alias("digest"),
        F.octet_length(text).alias("size"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest", "size")
    numbered = numbered.withColumn("nth", F.row_number().over(order) - 1)

    def copied(of):
        return F.crc32(of.cast("string").cast("binary")) % head

    # A turn goes to its own conversation, and a base's first turns to those that start with them.
    # Each is there with all its own rows, used or not, so that none is made up or lost.
    own = F.struct(
        F.col("conv_id").alias("to"),
        F.lit(True).alias("own"),
        (F.col("nth") >= copied(F.col("conv_id"))).alias("used"),
    )
    others = F.filter(
        F.transform(
            F.sequence(F.lit(1 - block), F.lit(block - 1)),
            lambda step: F.struct(
                F.try_add("conv_id", step).alias("to"),
                F.lit(False).alias("own"),
                F.lit(True).alias("used"),
            ),
        ),
        lambda x: x["to"].isNotNull()
        & (x["to"] - x["to"] % block == F.col("conv_id"))
        & (F.col("nth") < copied(x["to"])),
    )
    is_base = (F.col("conv_id") % block == 0) & (F.col("nth") < head - 1)
    sent = F.when(is_base, F.concat(F.array(own), others)).otherwise(F.array(own))
    turn = F.struct("nth", "digest", "size")
    return (
        numbered.select("nth", "digest", "size", F.inline(sent))
        .groupBy(F.col("to").alias("conv_id"))
        .agg(
            F.max("own").alias("there"),
            F.sort_array(F.collect_list(F.when(F.col("used"), turn))).alias("turns"),
        )
        .filter("there")
        .select(
            "conv_id",
            F.unhex(
                F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")
            ).alias("path"),
            F.transform("turns", lambda t: t["size"]).alias("sizes"),
        )
    )


class Skeleton:
    """The trie of the splitters' paths. Node 0 is the root; parents come before children."""

    def __init__(self, splitters: list[tuple[bytes, list[int]]]):
        self.children: dict[tuple[int, bytes], int] = {}
        self.parent, self.depth, self.size = [_TOP], [0], [0]
        for path, sizes in splitters:
            node = 0
            for depth in range(len(path) // _DIGEST):
                key = node, path[depth * _DIGEST : (depth + 1) * _DIGEST]
                if key not in self.children:
                    self.children[key] = len(self.parent)
                    self.parent.append(node)
                    self.depth.append(depth + 1)
                    self.size.append(sizes[depth])
                node = self.children[key]


def _splitters(
    paths: DataFrame, shards: int, most_skeleton: int
) -> list[tuple[bytes, int, list[int]]]:
    """Keys (path and id) between ``shards`` ranges of about as many turns each, in order.

    They come from a fixed number of conversations a shard, those with the smallest hashes of
    their ids; what is drawn changes how even the shards are, and no result.
    """
    cut = max(1, min(SPLITTER_TURNS, most_skeleton // shards))
    weight = F.size("sizes") + 1
    drawn = (
        paths.select(
            F.substring("path", 1, cut * _DIGEST).alias("path"),
            F.when(F.size("sizes") <= cut, F.col("conv_id")).alias("conv_id"),
            F.slice("sizes", 1, cut).alias("sizes"),
            weight.cast("long").alias("weight"),
            F.xxhash64("conv_id").alias("lot"),
        )
        .orderBy("lot")
        .limit(shards * _SAMPLED)
    )
    order = Window.orderBy("path", F.col("conv_id").asc_nulls_first())
    total = F.sum("weight").over(Window.partitionBy())
    at = F.floor(F.sum("weight").over(order) * shards / (total + 1))
    chosen = (
        drawn.withColumn("at", at)
        .withColumn("before", F.lag("at", 1, 0).over(order))
        .filter("at > before")
        .select("path", F.coalesce("conv_id", F.lit(-(1 << 63))).alias("conv_id"), "sizes")
        .distinct()
        .collect()
    )
    return sorted((bytes(row.path), row.conv_id, row.sizes) for row in chosen)


def _dealer(keys: list[tuple[bytes, int]]):
    """The Arrow function that adds each conversation's shard."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist())
            shards = [bisect_right(keys, pair) for pair in pairs]
            yield batch.append_column("shard", pa.array(shards, pa.int32()))

    return deal


class _Shard:
    """The nodes of one shard, in the order of a walk; a node's parent comes before it."""

    def __init__(self, shard: int, skeleton: Skeleton):
        self.shard, self.skeleton = shard, skeleton
        self.parent, self.depth, self.node = array("q"), array("q"), array("q")
        self.size, self.least, self.count = array("q"), array("q"), array("q")
        self.ends: dict[int, "hashlib._Hash | bytearray"] = {}
        self.path, self.open = b"", []
        self._add(-1, 0, 0, 0)

    def _add(self, parent: int, depth: int, size: int, node: int) -> None:
        self.open.append(len(self.parent))
        for column, value in (
            (self.parent, parent),
            (self.depth, depth),
            (self.size, size),
            (self.node, node),
            (self.least, (1 << 63) - 1),
            (self.count, 0),
        ):
            column.append(value)

    def add(self, path: bytes, sizes: list[int], conv_id: int) -> None:
        """The next conversation, in the order of path and id."""
        same = _common(self.path, path)
        del self.open[same + 1 :]
        self.path = path
        for depth in range(same, len(path) // _DIGEST):
            above = self.open[-1]
            node = self.node[above]
            if node >= 0:
                turn = path[depth * _DIGEST : (depth + 1) * _DIGEST]
                node = self.skeleton.children.get((node, turn), -1)
            self._add(above, depth + 1, sizes[depth], node)
        end = self.open[-1]
        self.least[end] = min(self.least[end], conv_id)
        self.count[end] += 1
        text = str(conv_id).encode()
        if end not in self.ends:  # a skeleton node's ids go on in the next shard
            self.ends[end] = bytearray(text) if self.node[end] >= 0 else hashlib.sha256(text)
        elif self.node[end] >= 0:
            self.ends[end] += b"," + text
        else:
            self.ends[end].update(b"," + text)

    def rows(self) -> Iterator[tuple]:
        """Finished nodes, and a partial aggregate of each skeleton node.

        What is below a skeleton node's own skeleton children is not in its partial.
        """
        n = len(self.parent)
        children, leaves, saved = (array("q", bytes(8 * n)) for _ in range(3))
        for i in range(n - 1, 0, -1):
            above = self.parent[i]
            if self.node[i] >= 0:
                continue
            if not children[i]:
                leaves[i] = 1
            saved[i] += (self.count[i] - 1) * self.size[i]
            self.least[above] = min(self.least[above], self.least[i])
            self.count[above] += self.count[i]
            children[above] += 1
            leaves[above] += leaves[i]
            saved[above] += saved[i]
        for i in range(n):
            above, ends = self.parent[i], self.ends.get(i)
            partial = self.node[i] >= 0
            if not partial and ends is not None:
                ends = ends.digest()
            over = self.node[above] if above >= 0 else _TOP
            yield (
                self.shard,
                self.node[i] if partial else None,
                self.least[i],
                self.depth[i],
                over if not partial and over >= 0 else None,
                self.least[above] if not partial and over < 0 else None,
                self.count[i],
                children[i],
                leaves[i],
                saved[i],
                bytes(ends) if ends is not None else None,
            )


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths share at their start."""
    low, high = 0, min(len(a), len(b)) // _DIGEST
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * _DIGEST : middle * _DIGEST] == b[low * _DIGEST : middle * _DIGEST]:
            low = middle
        else:
            high = middle - 1
    return low


def _walker(skeleton: Skeleton, schema: pa.Schema):
    """The Arrow function that turns sorted shards into nodes and partial aggregates."""

    def batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        while block := list(islice(rows, 20_000)):
            columns = [pa.array(*column) for column in zip(zip(*block), schema.types)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            names = ("shard", "path", "sizes", "conv_id")
            for shard, path, sizes, conv_id in zip(*(batch.column(n).to_pylist() for n in names)):
                if own is None or own.shard != shard:
                    if own is not None:
                        yield from batched(own.rows())
                    own = _Shard(shard, skeleton)
                own.add(path, sizes, conv_id)
        if own is not None:
            yield from batched(own.rows())

    return walk


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each skeleton node's ids, which lie in the order of its shards, streamed."""
    node, state = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([node], pa.int32()), pa.array([state.digest()], pa.binary())],
            names=["skeleton", "ends"],
        )

    for batch in batches:
        for own, ids in zip(batch.column("skeleton").to_pylist(), batch.column("ends").to_pylist()):
            if own != node:
                if state is not None:
                    yield done()
                node, state = own, hashlib.sha256(ids)
            else:
                state.update(b",")
                state.update(ids)
    if state is not None:
        yield done()


def _skeleton_nodes(found: DataFrame, skeleton: Skeleton) -> DataFrame:
    """The skeleton's nodes, from partial aggregates that are added up along the skeleton."""
    spark = found.sparkSession
    lines = []
    for node, above in enumerate(skeleton.parent):
        over = [node]
        while skeleton.parent[over[-1]] != _TOP:
            over.append(skeleton.parent[over[-1]])
        lines.append((node, above, skeleton.depth[node], skeleton.size[node], over))
    table = spark.createDataFrame(
        lines, "skeleton int, above int, depth long, size long, over array<int>"
    )
    kinship = F.broadcast(table)  # MOST_SKELETON nodes at most
    partial = (
        found.filter("skeleton is not null")
        .groupBy("skeleton")
        .agg(
            F.min("conv_id").alias("least"),
            F.sum("n_convs").alias("convs"),
            F.sum("n_children").alias("others"),
            F.sum("n_leaves").alias("leaves"),
            F.sum("saved_tokens").alias("saved"),
        )
        .join(kinship, "skeleton")
    )
    members = (
        partial.select(F.explode("over").alias("skeleton"), "least", "convs")
        .groupBy("skeleton")
        .agg(F.min("least").alias("conv_id"), F.sum("convs").alias("n_convs"))
    )
    kin = (
        table.filter("above >= 0")
        .groupBy(F.col("above").alias("skeleton"))
        .agg(F.count("*").alias("kin"))
    )
    own = (
        partial.join(members, "skeleton")
        .join(kin, "skeleton", "left")
        .withColumn("n_children", F.col("others") + F.coalesce("kin", F.lit(0)))
        .withColumn("leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("leaves")))
        .withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("size"))
    )
    below = (
        own.select(F.explode("over").alias("skeleton"), "leaves", "saved")
        .groupBy("skeleton")
        .agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    )
    ends = (
        found.filter("skeleton is not null and ends is not null")
        .select("skeleton", "shard", "ends")
        .repartition("skeleton")
        .sortWithinPartitions("skeleton", "shard")
        .mapInArrow(_joined, "skeleton int, ends binary")
    )
    return (
        own.select("skeleton", "above", "conv_id", "depth", "n_convs", "n_children")
        .join(below, "skeleton")
        .join(ends, "skeleton", "left")
    )


def conversation_trie(
    turns: DataFrame,
    block: int = BLOCK,
    head: int = HEAD,
    shard_turns: int = SHARD_TURNS,
    most_skeleton: int = MOST_SKELETON,
) -> DataFrame:
    """The nodes of the prefix trie of all conversations, rebuilt as in ``rebuilt``.

    A node is a distinct sequence of first turns, by role and text; the root has none. Returns
    ``conv_id`` (the smallest member, a conversation that starts with the node), ``depth``,
    ``parent_conv_id`` (null for the root), ``n_convs`` (members), ``n_children``, ``n_leaves``
    (childless nodes in the subtree, itself included), ``saved_tokens`` (over the subtree, members
    less one times the UTF-8 bytes of the last text) and ``ends_sha256`` (of the ids of members
    that end here, ascending, with commas between).

    Null roles and texts count as empty. Turns that are null come first, equal ones are ordered by
    their digests, and repeated rows are turns like others. Rows without ``conv_id`` belong to no
    conversation and are left out. Turns are the same if the first 16 bytes of their SHA-256 are.
    Other columns are not read. Without conversations there is no node.

    A task holds the digests of one conversation, and 48 bytes for each node of one shard. The
    ids that end at a hot node are put in order by the shards; one task streams their text into
    the hash, which has no other order.
    """
    spark = turns.sparkSession
    path = scratch_path(spark, "paths")
    paths = stored_at(rebuilt(turns, block, head), path)
    total = paths.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = min(MOST_SHARDS, max(parallel, -(-total // shard_turns)))
    splitters = _splitters(paths, shards, most_skeleton)
    skeleton = Skeleton([(key, sizes) for key, _, sizes in splitters])
    keys = [(key, conv_id) for key, conv_id, _ in splitters]
    dealt = paths.mapInArrow(
        _dealer(keys), StructType([*paths.schema.fields, *StructType.fromDDL("shard int").fields])
    )
    schema = spark.createDataFrame([], _FOUND).toArrow().schema
    found = stored(
        dealt.repartition(shards, "shard")
        .sortWithinPartitions("shard", "path", "conv_id")
        .mapInArrow(_walker(skeleton, schema), _FOUND),
        "nodes",
    )
    discard(spark, path)
    tops = _skeleton_nodes(found, skeleton)
    tops = stored(tops, "skeleton")
    above = tops.select(
        F.col("skeleton").alias("parent_skeleton"), F.col("conv_id").alias("their_conv_id")
    )
    figures = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    digest = F.lower(F.hex(F.coalesce("ends", F.lit(_EMPTY)))).alias("ends_sha256")
    parent = F.coalesce("parent_conv_id", "their_conv_id").alias("parent_conv_id")
    others = (
        found.filter("skeleton is null")
        .join(F.broadcast(above), "parent_skeleton", "left")  # MOST_SKELETON rows at most
        .select("conv_id", "depth", parent, *figures, digest)
    )
    parents = above.withColumnRenamed("parent_skeleton", "above")
    inner = tops.join(F.broadcast(parents), "above", "left").select(
        "conv_id", "depth", F.col("their_conv_id").alias("parent_conv_id"), *figures, digest
    )
    return others.unionByName(inner)
