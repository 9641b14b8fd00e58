"""Row numbers of a total order, without one task that sees all rows."""

from pyspark.sql import DataFrame, Window, functions as F

from strandline.plans.storage import stored

# ``monotonically_increasing_id`` has the partition above, the row inside it below.
_ROW_BITS = 33


def numbered(ordered: DataFrame, name: str = "place") -> DataFrame:
    """The rows of a sorted table with their number in its order, from 1.

    A sort leaves one range of the order in each partition. Each row is written with its
    partition and its number inside it; the numbers of rows before a partition are prefix sums
    over one row a partition. An empty table gives an empty one.
    """
    marked = stored(
        ordered.withColumn(name, F.monotonically_increasing_id()), "ordered"
    ).withColumn("_part", F.shiftright(name, _ROW_BITS))
    sizes = marked.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")
    inside = F.col(name).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return marked.join(sizes.select("_part", before.alias("_before")), "_part").select(
        *ordered.columns, (F.col("_before") + inside + 1).alias(name)
    )
