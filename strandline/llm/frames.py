"""Small helpers on DataFrames."""

from pyspark.sql import Column, DataFrame, Window, functions as F


def unused(frame: DataFrame, name: str) -> str:
    """``name``, with as many ``_`` before it as make it differ from all columns."""
    taken = {column.lower() for column in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_hash(frame: DataFrame) -> Column:
    """A hash of all columns that Spark can hash; rows that differ have different ones."""
    names = [name for name, kind in frame.dtypes if "map<" not in kind and "variant" not in kind]
    columns = [F.col(f"`{name}`") for name in names]
    return F.xxhash64(*columns, *(column.isNull() for column in columns))


def matched(docs: DataFrame, chosen: DataFrame, value: str | None = None) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` and ``row_hash`` are in ``chosen``.

    Of rows that are equal in all columns one is kept. ``chosen`` has a pair once. The columns
    are those of ``docs``, and ``value`` from ``chosen`` if named (under a name that ``docs``
    doesn't use, the last one).
    """
    key, nth = unused(docs, "row_hash"), unused(docs, "nth")
    other_id, other_key = unused(docs, "chosen_id"), unused(docs, "chosen_hash")
    kept = [F.col("doc_id").alias(other_id), F.col("row_hash").alias(other_key)]
    if value:
        kept.append(F.col(value).alias(unused(docs, value)))
    first = F.row_number().over(Window.partitionBy("doc_id", key).orderBy(key))
    same = F.col("doc_id").eqNullSafe(F.col(other_id)) & (F.col(key) == F.col(other_key))
    names = [f"`{name}`" for name in docs.columns] + ([unused(docs, value)] if value else [])
    return (
        docs.withColumn(key, row_hash(docs))
        .withColumn(nth, first)
        .filter(F.col(nth) == 1)
        .join(chosen.select(*kept), same, "inner" if value else "left_semi")
        .select(*names)
    )
