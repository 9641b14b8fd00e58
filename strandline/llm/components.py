"""Connected components of a graph given as rows, by alternating stars."""

from pyspark.sql import DataFrame, functions as F

from strandline.plans.storage import discard, scratch_path, stored_at

#: Parts that a node's links are dealt to, by their other end.
PARTS = 32


def components(links: DataFrame) -> DataFrame:
    """Every node of ``links`` with the smallest node that it reaches.

    ``links`` has two columns of one type, in any order and with repeats; links with a null or
    of a node with itself are passed over. Returns ``node, root``, one row per node that has a
    link to another; no links give no rows.

    Each round moves every node's links to its smallest neighbour, first those to larger nodes,
    then those to smaller ones (Kiveris et al., "Connected Components in MapReduce and Beyond").
    A node's links are dealt to ``PARTS`` parts, each part's minimum is combined before the shuffle,
    and the least of these goes back to the parts that the node has, so that no task gathers a
    neighbourhood. A round is written to the shared folder; only two figures reach the driver.
    """
    spark = links.sparkSession
    a, b = (F.col(name) for name in links.columns)
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = edges.filter("u > v").distinct()
    path, seen = scratch_path(spark, "links"), None
    edges = stored_at(edges, path)
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select("v", "v").distinct()
            )
        before, seen = path, now
        path = scratch_path(spark, "links")
        edges = stored_at(_small_star(_large_star(edges)), path)
        discard(spark, before)


def _dealt(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edges`` with the part of each, and every ``u`` with its least ``v`` and its parts."""
    dealt = edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)))
    by_part = dealt.groupBy("u", "part").agg(F.min("v").alias("v"))
    least = by_part.groupBy("u").agg(F.min("v").alias("to"), F.collect_list("part").alias("parts"))
    return dealt, least


def _joined(dealt: DataFrame, least: DataFrame) -> DataFrame:
    """``dealt`` with ``to``. Not by broadcast: Spark counts ``to_parts`` as it is before the explode."""
    to_parts = least.select("u", "to", F.explode("parts").alias("part"))
    return dealt.hint("merge").join(to_parts, ["u", "part"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest one, or to itself."""
    dealt, least = _dealt(edges.union(edges.select("v", "u")))
    least = least.withColumn("to", F.least("u", "to"))
    return _joined(dealt.filter("v > u"), least).select(
        F.col("v").alias("u"), F.col("to").alias("v")
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    dealt, least = _dealt(edges)
    moved = _joined(dealt, least).filter("v > to")
    moved = moved.select(F.col("v").alias("u"), F.col("to").alias("v"))
    return moved.union(least.select("u", F.col("to").alias("v"))).distinct()
