import pytest
from pyspark.sql import functions as F

from strandline.functions import flags, sequence as S
from strandline.functions.alignment import depth_class, reference_length


@pytest.mark.parametrize(
    "cigar, expected",
    [
        ("100M", 100),
        ("5S10M2D3M4I", 15),
        ("10M1000N10M", 1020),
        ("4=1X5=", 10),
        ("*", 0),
        ("20S", 0),
    ],
)
def test_reference_length(spark, cigar, expected):
    row = spark.range(1).select(reference_length(F.lit(cigar)).alias("n")).first()
    assert row.n == expected


def test_sequences(spark):
    row = (
        spark.createDataFrame([("AACGTN", "!5I+#?")], "seq string, qual string")
        .select(
            S.reverse_complement(F.col("seq")).alias("rc"),
            S.gc_count(F.col("seq")).alias("gc"),
            S.n_count(F.col("seq")).alias("n"),
            S.phred(F.col("qual")).alias("phred"),
            S.phred_sum(F.col("qual")).alias("total"),
            S.bases_at_least(F.col("qual"), 20).alias("q20"),
            S.bases_below(F.col("qual"), 15).alias("low"),
            S.mean_phred(F.col("qual")).alias("mean"),
        )
        .first()
    )
    assert row.rc == "NACGTT"
    assert (row.gc, row.n) == (2, 1)
    assert row.phred == [0, 20, 40, 10, 2, 30]
    assert (row.total, row.q20, row.low, row.mean) == (102, 3, 3, 17.0)


def test_empty_strings(spark):
    row = (
        spark.range(1)
        .select(
            S.phred(F.lit("")).alias("phred"),
            S.phred_sum(F.lit("")).alias("total"),
            S.mean_phred(F.lit("")).alias("mean"),
            S.characters(F.lit("")).alias("chars"),
        )
        .first()
    )
    assert (row.phred, row.total, row.mean, row.chars) == ([], 0, 0.0, [])


def test_flag_predicates(spark):
    tests = {
        flags.is_mapped: lambda f: not f & 4,
        flags.is_paired_primary: lambda f: f & 1 and not f & (256 | 2048),
        flags.is_properly_paired: lambda f: f & 1
        and f & 2
        and not f & (4 | 256 | 2048),
        flags.is_both_mapped: lambda f: f & 1 and not f & (4 | 8 | 256 | 2048),
        flags.is_singleton: lambda f: f & 1 and f & 8 and not f & (4 | 256 | 2048),
        flags.is_qc_failed: lambda f: f & 512,
    }
    every = spark.range(4096).select(F.col("id").cast("int").alias("flag"))
    found = every.select("flag", *[t(F.col("flag")) for t in tests]).collect()
    for row in found:
        assert list(row)[1:] == [bool(t(row.flag)) for t in tests.values()]


def test_depth_class(spark):
    depths = [0, 1, 9, 10, 49, 50, 99, 100, 5000]
    rows = (
        spark.createDataFrame([(d,) for d in depths], "depth long")
        .select(depth_class(F.col("depth")).alias("name"))
        .collect()
    )
    assert [row.name.split("_coverage")[0] for row in rows] == [
        "no",
        "low",
        "low",
        "medium",
        "medium",
        "high",
        "high",
        "very_high",
        "very_high",
    ]


def test_ratio_guards_zero(spark):
    row = spark.range(1).select(S.ratio(F.lit(3), F.lit(0)).alias("r")).first()
    assert row.r == 0.0
