"""Genome depth, its statistics, windows and multi-resolution summaries."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandline.functions.alignment import DEPTH_CLASSES, reference_length
from strandline.functions.sequence import ratio
from strandline.operators.alignments import mapped_only

TILE = 100_000
#: Figures that reports write with a decimal point (a fixed format).
DECIMAL_FIGURES = (
    "mean_coverage",
    "median_coverage",
    "max_coverage",
    "min_coverage",
    "std_coverage",
)


def aligned_intervals(alignments: DataFrame) -> DataFrame:
    """Reference span of each mapped record, deletions and skips included."""
    return mapped_only(alignments).filter(F.col("chrom").isNotNull()).select(
        "sample_id",
        "chrom",
        F.col("pos0").alias("start"),
        (F.col("pos0") + reference_length(F.col("cigar"))).alias("end"),
    )


def interval_depth(intervals: DataFrame, tile: int = TILE) -> DataFrame:
    """Maximal runs of equal depth > 0 as (sample_id, chrom, start, end, depth).

    Each interval adds one at its start and takes one at its end.  The steps are
    summed per position with map-side combining; what remains is cut into tiles of
    ``tile`` positions, so a running sum never holds more than ``tile`` rows however
    deep or long a chromosome is.  The depth entering a tile comes from a window
    over one row per tile.
    """
    where = ["sample_id", "chrom"]
    steps = intervals.select(
        *where,
        F.inline(
            F.array(
                F.struct(F.col("start").alias("pos"), F.lit(1).alias("step")),
                F.struct(F.col("end").alias("pos"), F.lit(-1).alias("step")),
            )
        ),
    )
    # A position whose steps cancel does not change the depth; without those, no
    # two adjacent runs are equal and nothing has to be merged afterwards.  The
    # coalesce tells Spark that a tile is never null: otherwise the join below would
    # filter one of its two sides for that, and the shuffle they share be done twice.
    net = (
        steps.groupBy(*where, "pos")
        .agg(F.sum("step").alias("step"))
        .filter(F.col("step") != 0)
        .withColumn("tile", F.coalesce(F.expr(f"pos div {int(tile)}"), F.lit(0)))
        .repartition(*where, "tile")
    )
    by_tile = Window.partitionBy(*where).orderBy("tile")
    entering = (
        net.groupBy(*where, "tile")
        .agg(F.sum("step").alias("net"), F.min("pos").alias("first"))
        .select(
            *where,
            "tile",
            F.coalesce(
                F.sum("net").over(by_tile.rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ).alias("depth_in"),
            F.lead("first").over(by_tile).alias("next_first"),
        )
    )
    in_tile = Window.partitionBy(*where, "tile").orderBy("pos")
    running = net.select(
        *where,
        "tile",
        F.col("pos").alias("start"),
        F.lead("pos").over(in_tile).alias("next"),
        F.sum("step")
        .over(in_tile.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        .alias("rise"),
    )
    return (
        running.join(entering, [*where, "tile"])
        .select(
            *where,
            "start",
            F.coalesce("next", "next_first").alias("end"),
            (F.col("depth_in") + F.col("rise")).alias("depth"),
        )
        .filter(F.col("depth") > 0)
    )


def genome_depth(alignments: DataFrame, tile: int = TILE) -> DataFrame:
    """Depth of all mapped records."""
    return interval_depth(aligned_intervals(alignments), tile)


def bed_sort(depth: DataFrame) -> DataFrame:
    """Total order by sample, contig name and start."""
    return depth.orderBy("sample_id", "chrom", "start")


def depth_histogram(depth: DataFrame) -> DataFrame:
    """Intervals and bases at each depth; all statistics start from here."""
    return depth.groupBy("sample_id", "depth").agg(
        F.count("*").alias("regions"),
        F.sum(F.col("end") - F.col("start")).alias("bases"),
    )


def depth_stats(depth: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Statistics over depth *intervals*, with length-weighted ones beside them.

    ``total_bases_covered`` is the sum of interval depths and
    ``bases_with_coverage`` the number of intervals with depth > 0, names kept for
    compatibility; ``covered_bases`` and ``weighted_mean_depth`` count bases.
    ``samples`` adds samples without any interval: 0 regions, null statistics.
    """
    n, d = F.col("regions"), F.col("depth")
    exact = "decimal(38,0)"
    summed = (
        depth_histogram(depth)
        .groupBy("sample_id")
        .agg(
            F.sum(n).alias("total_regions"),
            F.sum(d * n).alias("_sum"),
            F.sum(d.cast("decimal(19,0)") * d * n).cast(exact).alias("_squares"),
            F.expr("percentile(depth, 0.5, regions)").alias("median_coverage"),
            F.max(d).alias("max_coverage"),
            F.min(d).alias("min_coverage"),
            F.sum(F.when(d > 0, n).otherwise(0)).alias("bases_with_coverage"),
            F.sum(F.when(d > 0, F.col("bases")).otherwise(0)).alias("covered_bases"),
            F.sum(d * F.col("bases")).alias("_weighted"),
            F.sum("bases").alias("_bases"),
        )
    )
    count, total = F.col("total_regions"), F.col("_sum")
    # n * sum(d^2) - sum(d)^2 is exact in integers, so nothing cancels.
    spread = count.cast("decimal(19,0)") * F.col("_squares") - (
        total.cast("decimal(19,0)") * total
    )
    stats = summed.select(
        "sample_id",
        "total_regions",
        (total.cast("double") / count.cast("double")).alias("mean_coverage"),
        "median_coverage",
        "max_coverage",
        "min_coverage",
        F.when(
            count > 1,
            F.sqrt(
                spread.cast("double")
                / (count.cast("double") * (count.cast("double") - 1))
            ),
        ).alias("std_coverage"),
        total.alias("total_bases_covered"),
        "bases_with_coverage",
        "covered_bases",
        F.when(
            F.col("_bases") > 0,
            F.col("_weighted").cast("double") / F.col("_bases").cast("double"),
        ).alias("weighted_mean_depth"),
    )
    if samples is None:
        return stats
    counters = [
        "total_regions",
        "total_bases_covered",
        "bases_with_coverage",
        "covered_bases",
    ]
    return (
        samples.select("sample_id")
        .distinct()
        .join(stats, "sample_id", "left")
        .fillna(0, counters)
    )


def depth_stats_filled(depth: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """The record-level variant of the statistics: 0 instead of null."""
    stats = depth_stats(depth, samples)
    return stats.select(
        "sample_id",
        "total_regions",
        "total_bases_covered",
        *[
            F.coalesce(F.col(name), F.lit(0)).alias(name)
            for name in (
                "mean_coverage",
                "median_coverage",
                "max_coverage",
                "min_coverage",
            )
        ],
        "bases_with_coverage",
    )


def depth_classes(depth: DataFrame) -> DataFrame:
    """Number of intervals in each depth class, one column per class."""
    d, n = F.col("depth"), F.col("regions")
    columns = []
    for name, lower, upper in DEPTH_CLASSES:
        inside = d >= lower if upper is None else (d >= lower) & (d < upper)
        columns.append(F.sum(F.when(inside, n).otherwise(0)).alias(f"{name}_regions"))
    return depth_histogram(depth).groupBy("sample_id").agg(*columns)


def depth_report(depth: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Interval statistics and class counts of each sample as one map of text."""
    stats = depth_stats(depth, samples).drop("covered_bases", "weighted_mean_depth")
    classes = depth_classes(depth)
    counts = [name for name in classes.columns if name != "sample_id"]
    return stats_as_text(stats.join(classes, "sample_id", "left").fillna(0, counts))


def stats_as_text(
    stats: DataFrame, key: str = "sample_id", decimal: tuple[str, ...] = DECIMAL_FIGURES
) -> DataFrame:
    """A row of figures as map<string,string>, the form reports are exchanged in.

    Figures named in ``decimal`` are written with a decimal point even where they
    are whole; counts stay whole, and null is ``nan``.
    """
    names = [name for name in stats.columns if name != key]
    return stats.select(
        key,
        F.map_from_arrays(
            F.array(*[F.lit(name) for name in names]),
            F.array(
                *[
                    F.coalesce(
                        _decimal_text(F.col(name))
                        if name in decimal
                        else F.col(name).cast("string"),
                        F.lit("nan"),
                    )
                    for name in names
                ]
            ),
        ).alias("stats"),
    )


def _decimal_text(figure: Column) -> Column:
    """Shortest decimal digits of a double, plain up to 10**16."""
    value = figure.cast("double")
    whole = (F.floor(value) == value) & (F.abs(value) < 1e16)
    plain = F.concat(value.cast("decimal(17,0)").cast("string"), F.lit(".0"))
    return F.when(whole, plain).otherwise(value.cast("string"))


def depth_windows(
    depth: DataFrame,
    width: int = 1000,
    chrom_sizes: DataFrame | None = None,
    samples: DataFrame | None = None,
) -> DataFrame:
    """Depth summed over fixed windows.

    Without ``chrom_sizes`` only windows that hold depth appear and the mean is
    taken over ``width`` bases.  With it, every window of every contig of the index
    appears for every sample (of ``samples``, or those with depth), the last one is
    as short as the contig's end, and depth outside the contigs does not count; see
    ``on_unknown_contigs``.
    """
    width = int(width)
    where = ["sample_id", "chrom"]
    low = F.expr(f"window_idx * {width}")
    high = F.expr(f"(window_idx + 1) * {width}")
    counted = depth if chrom_sizes is None else on_known_contigs(depth, chrom_sizes)
    pieces = counted.select(
        *where,
        "start",
        "end",
        "depth",
        F.explode(
            F.expr(f"sequence(start div {width}, (end - 1) div {width})")
        ).alias("window_idx"),
    ).withColumn("bases", F.least("end", high) - F.greatest("start", low))
    summed = pieces.groupBy(*where, "window_idx").agg(
        F.sum(F.col("depth") * F.col("bases")).alias("depth_sum"),
        F.sum("bases").alias("covered_bases"),
        F.max("depth").alias("max_depth"),
        F.min("depth").alias("min_depth"),
    )
    if chrom_sizes is not None:
        # The index has one short row per contig; each sample gets all of them.
        contigs = chrom_sizes.filter(F.col("length") > 0).agg(
            F.collect_list(F.struct("chrom", "length"))
        )
        grid = (
            (depth if samples is None else samples)
            .select("sample_id")
            .distinct()
            .select("sample_id", F.inline(contigs.scalar()))
            .select(
                *where,
                "length",
                F.explode(
                    F.expr(f"sequence(cast(0 as bigint), (length - 1) div {width})")
                ).alias("window_idx"),
            )
        )
        summed = grid.join(summed, [*where, "window_idx"], "left").fillna(
            0, ["depth_sum", "covered_bases", "max_depth", "min_depth"]
        )
        window_end = F.least("length", high)
    else:
        window_end = high
    return summed.select(
        *where,
        low.alias("window_start"),
        window_end.alias("window_end"),
        "covered_bases",
        "depth_sum",
        "min_depth",
        "max_depth",
        ratio(F.col("depth_sum"), window_end - low).alias("mean_depth"),
    )


def signal_levels(
    depth: DataFrame, width: int = 1000, factor: int = 4, levels: int = 5
) -> DataFrame:
    """Summaries at ``width * factor**level``: the zoom levels of a signal track.

    All levels come from the finest one in a single shuffle; sums, minima and
    maxima combine, so coarse bins are already small before they move.
    """
    bases = int(width)
    base = depth_windows(depth, bases)
    grouped = (
        base.select(
            "sample_id",
            "chrom",
            F.expr(f"window_start div {bases}").alias("_bin"),
            "covered_bases",
            "depth_sum",
            "min_depth",
            "max_depth",
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(level).alias("level"),
                            F.lit(factor**level).cast("long").alias("_bins"),
                        )
                        for level in range(levels)
                    ]
                )
            ),
        )
        .withColumn("bin_start", F.expr(f"(_bin div _bins) * _bins * {bases}"))
        .withColumn("bin_end", F.expr(f"bin_start + _bins * {bases}"))
        .groupBy("sample_id", "chrom", "level", "bin_start", "bin_end")
        .agg(
            F.sum("covered_bases").alias("covered"),
            F.sum("depth_sum").cast("double").alias("sum"),
            F.min("min_depth").alias("min"),
            F.max("max_depth").alias("max"),
        )
    )
    return grouped


def on_known_contigs(depth: DataFrame, chrom_sizes: DataFrame) -> DataFrame:
    """Depth inside the contigs of the index; only that may enter a signal track."""
    sizes = chrom_sizes.select("chrom", F.col("length").alias("_length"))
    return (
        depth.join(sizes, "chrom")
        .withColumn("end", F.least("end", "_length"))
        .filter(F.col("start") < F.col("end"))
        .select(*depth.columns)
    )


def on_unknown_contigs(depth: DataFrame, chrom_sizes: DataFrame) -> DataFrame:
    """The rest: depth on contigs that the index lacks, and past a contig's end."""
    sizes = chrom_sizes.select("chrom", F.col("length").alias("_length"))
    return (
        depth.join(sizes, "chrom", "left")
        .withColumn("start", F.greatest("start", "_length"))
        .filter(F.col("start") < F.col("end"))
        .select(*depth.columns)
    )
