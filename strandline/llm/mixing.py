"""Mixing of sources to target weights by systematic sampling."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandline.llm.frames import matched, row_hash, unused
from strandline.plans.storage import stored

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
#: Documents that one task puts in order, about.
RUN = 20_000
_CLASSES = 17.0  # size classes for each power of e


def _hash(column: Column) -> Column:
    """32 bits of the MD5 of a string; other engines compute the same."""
    return F.conv(F.substring(F.md5(column), 1, 8), 16, 10).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """``target`` for every ``source, source_size``.

    Sources by code point, null last, have the weights in turn. They share ``share`` times the
    sum of all sizes by weight; no target is above ``most`` times its source's size, and what is
    over goes to the others by weight until none is above.

    The level, what a weight of one gets, only rises from round to round; a round is one sum over
    the sources, of which three numbers reach the driver.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = stored(
        sizes.select(
            "source",
            "source_size",
            F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).alias("weight"),
        ),
        "sources",
    )
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = F.col("weight") * level >= F.col("source_size") * most if level else F.lit(False)
        row = weighed.agg(
            F.count_if(full),
            F.sum(F.when(full, F.col("source_size") * most).otherwise(0.0)),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))),
        ).first()
        if row[0] == capped or not row[2]:
            break
        capped, level = row[0], (share * total - row[1]) / row[2]
    limit = F.col("source_size") * F.lit(most)
    return weighed.select(
        "source", "source_size", F.least(F.col("weight") * F.lit(level), limit).alias("target")
    )


def copies(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    run: int = RUN,
) -> DataFrame:
    """How often the mix takes every document.

    A document's size is the number of its words, runs of characters other than ASCII white
    space; a null text has none. Every document of a source is expected ``target / source_size``
    times. In an order that goes from small to large, the sums of these before and after each
    document, with the source's one random offset, tell the copies: one for each integer
    between. So all prefixes of the order, of small and of large documents, come near their
    share.

    Returns, one row per row of ``docs``, ``doc_id``, ``source``, ``row_hash``, ``size``,
    ``source_size``, ``target`` and ``copies``. A source without words has the target 0 and no
    copies. Null sources are a source, null ids go first among equals, repeated rows are each
    placed. Offsets and order follow from the data, so reruns agree. Other columns are not read;
    an empty table gives an empty one.

    The sums are made at three levels: over a source's size classes, over a class's runs, dealt
    by a hash of id and text, and within a run of about ``run`` documents at most, so that no task
    has a whole source, nor all documents without an id. Only rows of one id and one text share
    a run.
    """
    text = F.coalesce("text", F.lit(""))
    size = F.regexp_count(text, F.lit(r"[^ \t-\r]+"))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), F.md5(text))
    rows = stored(
        docs.select(
            "doc_id",
            "source",
            row_hash(docs).alias("row_hash"),
            size.cast("long").alias("size"),
            _hash(name).alias("deal"),
        ),
        "sizes",
    )
    by_source = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("n")
    )
    total = rows.count()
    runs = max(1, -(-total // run))
    placed = rows.withColumns(
        {
            "class": F.floor(F.log(F.col("size") + 1.0) * _CLASSES),
            "run": F.col("deal") % runs,
        }
    )
    by_run = placed.groupBy("source", "class", "run").agg(F.count("*").alias("n"))
    by_class = by_run.groupBy("source", "class").agg(F.sum("n").alias("n"))

    def before(*keys: str, order: str) -> Column:
        w = Window.partitionBy(*keys).orderBy(order)
        return F.sum("n").over(w) - F.col("n")

    class_start = by_class.select(
        F.col("source").alias("s"),
        F.col("class").alias("c"),
        before("source", order="class").alias("class_start"),
    )
    run_start = by_run.withColumn("run_start", before("source", "class", order="run"))
    run_start = run_start.join(
        class_start, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c"))
    ).select(
        F.col("source").alias("s"),
        F.col("class").alias("c"),
        F.col("run").alias("r"),
        (F.col("class_start") + F.col("run_start")).alias("start"),
    )
    targets = source_targets(by_source.select("source", "source_size"), weights, share, most)
    targets = targets.select(
        F.col("source").alias("t"),
        "source_size",
        "target",
        (_hash(F.concat(F.lit("offset/"), F.coalesce("source", F.lit("")))) / float(1 << 32)).alias(
            "offset"
        ),
    )
    nth = F.row_number().over(
        Window.partitionBy("source", "class", "run").orderBy("size", "doc_id", "row_hash")
    )
    starts = run_start.join(targets, F.col("s").eqNullSafe(F.col("t")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    at = F.col("start") + F.col("nth")
    taken = F.floor(rate * at + F.col("offset")) - F.floor(rate * (at - 1) + F.col("offset"))
    return (
        placed.withColumn("nth", nth)
        .join(
            starts,
            F.col("source").eqNullSafe(F.col("s"))
            & (F.col("class") == F.col("c"))
            & (F.col("run") == F.col("r")),
        )
        .select(
            "doc_id",
            "source",
            "row_hash",
            "size",
            "source_size",
            "target",
            taken.cast("long").alias("copies"),
        )
    )


def mixed(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """The documents of the mix, whole, each as often as ``copies`` says; columns as in ``docs``.

    Rows equal in all columns are one document, taken as often as all of them together.
    """
    taken = (
        copies(docs, weights, share, most)
        .groupBy("doc_id", "row_hash")
        .agg(F.sum("copies").cast("int").alias("copies"))
        .filter("copies > 0")
    )
    times = unused(docs, "copies")
    names = [f"`{name}`" for name in docs.columns]
    return (
        matched(docs, taken, "copies")
        .select(*names, F.explode(F.array_repeat(F.lit(0), F.col(times))))
        .select(*names)
    )
