"""Alignment records: filters, duplicate removal, ordering, statistics."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandline.functions import flags
from strandline.functions.sequence import ratio

DUPLICATE_KEY = ("sample_id", "chrom", "pos0", "seq")


def mapped_only(alignments: DataFrame) -> DataFrame:
    """Drop unmapped records; secondary and supplementary ones stay."""
    return alignments.filter(flags.is_mapped(F.col("flag")))


def min_mapq(alignments: DataFrame, threshold: int = 0) -> DataFrame:
    return alignments.filter(F.col("mapq") >= threshold)


def remove_duplicates(
    alignments: DataFrame, order_by: Sequence[str] = ("ordinal",)
) -> DataFrame:
    """Keep the first record, by input order, of each (chrom, position, sequence).

    The ``= 1`` filter on the row number lets Spark keep one row per key in each
    map task before the shuffle, so a key that holds a third of all records costs
    its reducer one row per map task.
    """
    first = Window.partitionBy(*DUPLICATE_KEY).orderBy(*order_by)
    return (
        alignments.withColumn("_rank", F.row_number().over(first))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def coordinate_sort(
    alignments: DataFrame,
    chrom_sizes: DataFrame | None = None,
    contig_order: str = "name",
    within_samples: bool = True,
) -> DataFrame:
    """Total order by contig, position and input order; unplaced records last.

    ``contig_order`` is ``"header"`` (needs ``chrom_sizes`` with ``chrom_idx``) or
    ``"name"``.  Input order is part of the range key, so records that share one
    position, or have none, still spread over many sort tasks.
    """
    if contig_order == "header":
        if chrom_sizes is None:
            raise ValueError("contig_order='header' needs chrom_sizes")
        # One row per contig on the right, so this join adds no rows.  A header is
        # small, and dealing records out by contig would put a contig into one task.
        ranked = alignments.join(
            F.broadcast(chrom_sizes.select("chrom", F.col("chrom_idx").alias("_contig"))),
            "chrom",
            "left",
        ).select(*alignments.columns, "_contig")
    elif contig_order == "name":
        ranked = alignments.withColumn("_contig", F.col("chrom"))
    else:
        raise ValueError(f"unknown contig_order: {contig_order}")
    # Contigs outside the header sort after it by name, as records without a
    # contig do at the very end.
    keys = [
        F.col("_contig").asc_nulls_last(),
        F.col("chrom").asc_nulls_last(),
        F.col("pos0").asc_nulls_last(),
        F.col("ordinal").asc(),
    ]
    if within_samples:
        keys.insert(0, F.col("sample_id").asc())
    return ranked.orderBy(*keys).drop("_contig")


def flagstat(alignments: DataFrame) -> DataFrame:
    """Flag statistics per sample; quality-failed records in ``*_qc_failed``.

    Pair figures count primary records only, total and mapped count all.
    """
    flag = F.col("flag")
    elsewhere = flags.is_both_mapped(flag) & F.col("_other")
    figures = {
        "total_reads": F.lit(True),
        "mapped_reads": flags.is_mapped(flag),
        "paired_reads": flags.is_paired_primary(flag),
        "properly_paired": flags.is_properly_paired(flag),
        "both_mapped": flags.is_both_mapped(flag),
        "singletons": flags.is_singleton(flag),
        "different_chr": elsewhere,
        "different_chr_mapq5": elsewhere & F.col("_sure"),
    }
    # Records differ here in a few thousand ways at most: count those first, and
    # derive all figures from the counts.
    kinds = alignments.groupBy(
        "sample_id",
        "flag",
        # '=' in RNEXT stands for the record's own contig.
        F.coalesce(
            (F.col("rnext") != "=") & (F.col("rnext") != F.col("chrom")), F.lit(False)
        ).alias("_other"),
        F.coalesce(F.col("mapq") >= 5, F.lit(False)).alias("_sure"),
    ).agg(F.count("*").alias("_records"))
    failed = flags.is_qc_failed(flag)

    def total(test: Column) -> Column:
        return F.sum(F.when(test, F.col("_records")).otherwise(0))

    counts = [total(test & ~failed).alias(name) for name, test in figures.items()]
    counts += [
        total(test & failed).alias(f"{name}_qc_failed") for name, test in figures.items()
    ]
    return (
        kinds.groupBy("sample_id")
        .agg(*counts)
        .withColumn(
            "mapping_rate", ratio(F.col("mapped_reads"), F.col("total_reads"), 100.0)
        )
    )


def alignment_stats(
    alignments: DataFrame,
    mapq_threshold: int = 0,
    duplicates_removed: bool = False,
    order_by: Sequence[str] = ("ordinal",),
) -> DataFrame:
    """Totals, mapped, kept after filtering, their rates, mean quality of the kept.

    With ``duplicates_removed`` the records are first reduced to one row per
    duplicate key with map-side combining, then summed per sample.
    """
    mapped = flags.is_mapped(F.col("flag"))
    kept = mapped & (F.col("mapq") >= mapq_threshold)
    if duplicates_removed:
        order = ", ".join(f"{name} as _o{i}" for i, name in enumerate(order_by))
        first = F.expr(f"min(struct({order}, mapq)) filter (where _kept)")
        rows = (
            alignments.withColumn("_kept", kept)
            .groupBy(*DUPLICATE_KEY)
            .agg(
                F.count("*").alias("_total"),
                F.count_if(mapped).alias("_mapped"),
                first.alias("_first"),
            )
            .select(
                "sample_id",
                "_total",
                "_mapped",
                F.col("_first.mapq").alias("_mapq"),
                F.lit(1).alias("_weight"),
            )
        )
    else:
        rows = (
            alignments.groupBy("sample_id", mapped.alias("_is_mapped"), "mapq")
            .agg(F.count("*").alias("_total"))
            .select(
                "sample_id",
                "_total",
                F.when(F.col("_is_mapped"), F.col("_total")).otherwise(0).alias("_mapped"),
                F.when(
                    F.col("_is_mapped") & (F.col("mapq") >= mapq_threshold),
                    F.col("mapq"),
                ).alias("_mapq"),
                F.col("_total").alias("_weight"),
            )
        )
    total, used = F.col("total_reads"), F.col("filtered_reads")
    return (
        rows.groupBy("sample_id")
        .agg(
            F.sum("_total").cast("long").alias("total_reads"),
            F.sum("_mapped").cast("long").alias("mapped_reads"),
            F.sum(F.when(F.col("_mapq").isNotNull(), F.col("_weight")).otherwise(0))
            .cast("long")
            .alias("filtered_reads"),
            F.coalesce(F.sum(F.col("_mapq") * F.col("_weight")), F.lit(0)).alias("_sum"),
        )
        .select(
            "sample_id",
            "total_reads",
            "mapped_reads",
            "filtered_reads",
            ratio(F.col("mapped_reads"), total, 100.0).alias("mapping_rate"),
            ratio(used, total, 100.0).alias("filter_rate"),
            ratio(F.col("_sum"), used).alias("average_mapping_quality"),
        )
    )


def filter_alignments(
    alignments: DataFrame,
    mapq_threshold: int = 0,
    duplicates_removed: bool = False,
    order_by: Sequence[str] = ("ordinal",),
) -> DataFrame:
    """Mapped records of sufficient mapping quality, duplicates optionally removed."""
    kept = min_mapq(mapped_only(alignments), mapq_threshold)
    return remove_duplicates(kept, order_by) if duplicates_removed else kept
