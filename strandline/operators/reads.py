"""Read records: quality control, filtering, trimming, mate pairs."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandline.functions import cycles, sequence as S
from strandline.functions.overlap import overlap_offset

# Default filter limits (fixed values).
LOW_QUALITY_PHRED = 15
LOW_QUALITY_PERCENT = 40
MAX_N_BASES = 5
MIN_LENGTH = 15

# Bytes of a file whose records one task numbers.
STRETCH = 1 << 26


def verdict(
    seq: Column,
    qual: Column,
    low_phred: int = LOW_QUALITY_PHRED,
    low_percent: int = LOW_QUALITY_PERCENT,
    max_n: int = MAX_N_BASES,
    min_length: int = MIN_LENGTH,
) -> Column:
    """``passed`` or the first reason to reject a read."""
    low = S.bases_below(qual, low_phred)
    return (
        F.when(low * 100 > F.length(seq) * low_percent, "low_quality")
        .when(S.n_count(seq) > max_n, "too_many_n")
        .when(F.length(seq) < min_length, "too_short")
        .otherwise("passed")
    )


def label_reads(reads: DataFrame, **limits) -> DataFrame:
    return reads.withColumn("verdict", verdict(F.col("seq"), F.col("qual"), **limits))


def quality_filter(
    reads: DataFrame,
    low_phred: int = LOW_QUALITY_PHRED,
    low_percent: int = LOW_QUALITY_PERCENT,
    max_n: int = MAX_N_BASES,
) -> DataFrame:
    """Drop reads with too many low-quality or unknown bases."""
    accepted = verdict(F.col("seq"), F.col("qual"), low_phred, low_percent, max_n, 0)
    return reads.filter(accepted == "passed")


def mean_quality_filter(reads: DataFrame, threshold: float = 20.0) -> DataFrame:
    return reads.filter(
        (F.length("qual") > 0)
        & (S.phred_sum(F.col("qual")) >= F.length("qual") * threshold)
    )


def length_filter(reads: DataFrame, min_length: int = 50) -> DataFrame:
    return reads.filter(F.length("seq") >= min_length)


def filter_reasons(reads: DataFrame, **limits) -> DataFrame:
    """Reads per sample and verdict."""
    return (
        label_reads(reads, **limits)
        .groupBy("sample_id", "verdict")
        .agg(F.count("*").alias("reads"))
    )


def tail_trim(reads: DataFrame, window: int = 4, threshold: int = 20) -> DataFrame:
    """Cut each read where a sliding window first falls below a mean quality."""
    low = cycles.first_low_window(window, (threshold + S.PHRED_OFFSET) * window)
    kept, cut = F.col("_kept"), F.col("_kept").isNotNull()
    return (
        reads.withColumn("_kept", low("qual"))
        .withColumns(
            {
                name: F.when(cut, F.substring(name, F.lit(1), kept)).otherwise(F.col(name))
                for name in ("seq", "qual")
            }
        )
        .drop("_kept")
    )


def read_qc(reads: DataFrame) -> DataFrame:
    """Reads, bases, Q20/Q30, GC and mean length per sample and mate."""
    bases = F.col("bases")
    return (
        reads.groupBy("sample_id", "mate")
        .agg(
            F.count("*").alias("reads"),
            F.sum(F.length("seq").cast("long")).alias("bases"),
            F.sum(S.bases_at_least(F.col("qual"), 20)).alias("q20_bases"),
            F.sum(S.bases_at_least(F.col("qual"), 30)).alias("q30_bases"),
            F.sum(S.gc_count(F.col("seq"))).alias("gc_bases"),
        )
        .select(
            "*",
            S.ratio(F.col("q20_bases"), bases).alias("q20_rate"),
            S.ratio(F.col("q30_bases"), bases).alias("q30_rate"),
            S.ratio(F.col("gc_bases"), bases).alias("gc_rate"),
            S.ratio(bases, F.col("reads")).alias("mean_length"),
        )
    )


def cycle_profile(reads: DataFrame) -> DataFrame:
    """Mean quality and base composition at each position of the reads.

    Each Arrow batch is counted as a whole and leaves one row per sample, mate and position,
    so no row stands for a base, and the shuffle is bounded by read length.
    """
    figures = ("bases", "quality_sum", *(f"{b.lower()}_bases" for b in cycles.BASES))
    return (
        reads.select(
            F.col("sample_id").cast("string").alias("sample_id"),
            F.col("mate").cast("byte").alias("mate"),
            "seq",
            "qual",
        )
        .mapInArrow(cycles.counted(S.PHRED_OFFSET), cycles.COUNTED)
        .groupBy("sample_id", "mate", "cycle")
        .agg(*[F.sum(name).alias(name) for name in figures])
        .withColumn("mean_quality", S.ratio(F.col("quality_sum"), F.col("bases")))
    )


def mate_join(reads: DataFrame) -> DataFrame:
    """One row per pair: both mates matched on sample and read id."""
    mate = F.col("mate")
    return join_mates(reads.filter(mate == 1), reads.filter(mate == 2))


def join_mates(first: DataFrame, second: DataFrame) -> DataFrame:
    return _side(first, 1).join(_side(second, 2), ["sample_id", "read_id"])


def join_mates_checked(first: DataFrame, second: DataFrame) -> DataFrame:
    """Like ``join_mates``, but what cannot be paired stays, with ``error`` set.

    That is malformed records, which have no read id, and reads without a mate.
    ``ordinal`` is the place of the pair in the file of mate 1.
    """
    joined = _side(first, 1, "error", "ordinal").join(
        _side(second, 2, "error"), ["sample_id", "read_id"], "full"
    )
    alone = F.col("seq1").isNull() | F.col("seq2").isNull()
    return joined.withColumn(
        "error",
        F.coalesce(
            "error1",
            "error2",
            F.when(alone, F.concat(F.lit("read without mate: "), "read_id")),
        ),
    ).drop("error1", "error2").withColumnRenamed("ordinal1", "ordinal")


def pair_by_record(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mates paired by their place in their files, whatever they are called.

    The n-th record of a sample's mate 1 goes with the n-th of mate 2; names may repeat
    or differ.  What has no partner or is malformed stays, with ``error`` set.  The pair
    has the name of mate 1; ``names_differ`` tells where that of mate 2 is another, but
    for a last 1 or 2 behind a dot, slash, underscore or blank.  ``ordinal`` is the place
    of the pair in the file of mate 1.
    """
    joined = _numbered(first, 1).join(_numbered(second, 2), ["sample_id", "_record"], "full")

    def name(mate: int) -> Column:
        return F.regexp_replace(f"read_id{mate}", "[./_ ][12]$", "")

    read_id = F.coalesce("read_id1", "read_id2")
    alone = F.col("ordinal1").isNull() | F.col("ordinal2").isNull()
    return joined.select(
        "sample_id",
        read_id.alias("read_id"),
        *[f"{column}{mate}" for mate in (1, 2) for column in ("seq", "qual")],
        F.coalesce("ordinal1", "ordinal2").alias("ordinal"),
        F.coalesce(
            "error1", "error2", F.when(alone, F.concat(F.lit("read without mate: "), read_id))
        ).alias("error"),
        F.coalesce(name(1) != name(2), F.lit(False)).alias("names_differ"),
    )


def _numbered(reads: DataFrame, mate: int) -> DataFrame:
    """Reads with the number of their record in the file.

    Records are numbered within stretches of the file; the records before a stretch are
    a sum over one row per stretch.
    """
    stretch = ["sample_id", "_stretch"]
    rows = reads.withColumn("_stretch", F.expr(f"ordinal div {STRETCH}"))
    counts = rows.groupBy(*stretch).agg(F.count("*").alias("_n"))
    so_far = F.sum("_n").over(Window.partitionBy("sample_id").orderBy("_stretch"))
    before = counts.select(*stretch, (so_far - F.col("_n")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy(*stretch).orderBy("ordinal"))
    return (
        rows.withColumn("_nth", nth)
        .join(before, stretch)
        .select(
            "sample_id",
            (F.col("_before") + F.col("_nth")).alias("_record"),
            *[
                F.col(name).alias(f"{name}{mate}")
                for name in ("read_id", "seq", "qual", "ordinal", "error")
            ],
        )
    )


def _side(reads: DataFrame, mate: int, *extra: str) -> DataFrame:
    return reads.select(
        "sample_id",
        "read_id",
        *[F.col(name).alias(f"{name}{mate}") for name in ("seq", "qual", *extra)],
    )


def split_pairs(pairs: DataFrame) -> DataFrame:
    """The inverse of ``mate_join``: one row per mate.

    Where pairs have an ``ordinal``, so have the reads: 2n and 2n + 1.
    """

    def mate(number: int) -> Column:
        return F.struct(
            F.lit(number).cast("byte").alias("mate"),
            F.col(f"seq{number}").alias("seq"),
            F.col(f"qual{number}").alias("qual"),
        )

    ordered = "ordinal" in pairs.columns
    reads = pairs.select(
        "sample_id",
        "read_id",
        *(["ordinal"] if ordered else []),
        F.inline(F.array(mate(1), mate(2))),
    )
    if ordered:
        place = F.col("ordinal") * 2 + F.col("mate") - 1
        reads = reads.withColumn("ordinal", place)
    return reads


def find_overlap(
    pairs: DataFrame,
    min_overlap: int = 30,
    max_mismatches: int = 5,
    max_percent: int = 20,
) -> DataFrame:
    """Add where the two mates overlap, and the insert length that follows.

    ``overlap_start`` is the position, relative to the first base of mate 1, at
    which the reverse complement of mate 2 begins; negative when the insert is
    shorter than mate 2.  All three columns are null for pairs without overlap.
    """
    start = F.col("overlap_start")
    n1, n2 = F.length("seq1"), F.length("seq2")
    offset = overlap_offset(min_overlap, max_mismatches, max_percent)
    return (
        pairs.withColumn(
            "overlap_start", offset(F.col("seq1"), S.reverse_complement(F.col("seq2")))
        )
        .withColumn("overlap_length", F.least(n1, start + n2) - F.greatest(F.lit(0), start))
        .withColumn("insert_length", start + n2)
        .withColumn(
            "overlap_length",
            F.when(start.isNotNull(), F.col("overlap_length")),
        )
    )


def pair_overlap_trim(pairs: DataFrame, **limits) -> DataFrame:
    """Remove what lies beyond the insert, that is adapter, from both mates."""
    found = find_overlap(pairs, **limits)
    insert = F.col("insert_length")
    for name in ("seq1", "qual1", "seq2", "qual2"):
        found = found.withColumn(
            name,
            F.when(insert.isNotNull(), F.substring(name, F.lit(1), insert)).otherwise(
                F.col(name)
            ),
        )
    return found


def label_pairs(pairs: DataFrame, **limits) -> DataFrame:
    """Verdict on a pair: that of mate 1 unless it passed, else that of mate 2."""
    first = verdict(F.col("seq1"), F.col("qual1"), **limits)
    second = verdict(F.col("seq2"), F.col("qual2"), **limits)
    return pairs.withColumn("verdict", F.when(first != "passed", first).otherwise(second))


def insert_sizes(overlapped: DataFrame) -> DataFrame:
    """Pairs per insert length, from the output of ``find_overlap``."""
    return (
        overlapped.filter(F.col("insert_length").isNotNull())
        .groupBy("sample_id", "insert_length")
        .agg(F.count("*").alias("pairs"))
    )


def duplication_levels(pairs: DataFrame) -> DataFrame:
    """How many distinct pairs occur once, twice, ... in each sample.

    Pairs are compared by two 64-bit hashes, 16 bytes in the shuffle instead of
    both sequences; copies of one pair meet in the map task first.
    """
    copies = pairs.groupBy(
        "sample_id",
        F.xxhash64("seq1", "seq2").alias("_h1"),
        F.xxhash64(F.lit(1), "seq2", "seq1").alias("_h2"),
    ).agg(F.count("*").alias("copies"))
    return copies.groupBy("sample_id", "copies").agg(
        F.count("*").alias("distinct_pairs")
    )


def duplication_rate(pairs: DataFrame) -> DataFrame:
    """Share of pairs that repeat another pair of the sample."""
    total, distinct = F.col("pairs"), F.col("distinct_pairs")
    return (
        duplication_levels(pairs)
        .groupBy("sample_id")
        .agg(
            F.sum(F.col("copies") * F.col("distinct_pairs")).alias("pairs"),
            F.sum("distinct_pairs").alias("distinct_pairs"),
        )
        .withColumn("duplication_rate", S.ratio(total - distinct, total))
    )


def clean_pairs(
    pairs: DataFrame,
    trim_tails: bool = False,
    **limits,
) -> DataFrame:
    """Adapter removal, optional tail trimming, and the verdict on each pair."""
    trimmed = pair_overlap_trim(pairs)
    if trim_tails:
        for mate in (1, 2):
            trimmed = (
                tail_trim(
                    trimmed.withColumnsRenamed(
                        {f"seq{mate}": "seq", f"qual{mate}": "qual"}
                    )
                ).withColumnsRenamed({"seq": f"seq{mate}", "qual": f"qual{mate}"})
            )
    return label_pairs(trimmed, **limits)
