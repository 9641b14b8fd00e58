import random

import pytest

from strandline.operators import depth as D

BEDGRAPH = "sample_id string, chrom string, start long, end long, depth long"
FOUR = [
    ("s", "chr1", 0, 100, 10),
    ("s", "chr1", 100, 200, 25),
    ("s", "chr1", 200, 300, 5),
    ("s", "chr2", 0, 100, 15),
]
SPANS = "sample_id string, chrom string, start long, end long"


def test_stats_of_four_intervals(spark):
    row = D.depth_stats(spark.createDataFrame(FOUR, BEDGRAPH)).first()
    assert row.total_regions == 4
    assert row.mean_coverage == 13.75
    assert row.median_coverage == 12.5
    assert (row.max_coverage, row.min_coverage) == (25, 5)
    assert row.std_coverage == pytest.approx(8.539125638299666, abs=1e-12)
    assert (row.total_bases_covered, row.bases_with_coverage) == (55, 4)
    assert (row.covered_bases, row.weighted_mean_depth) == (400, 13.75)


def test_classes_of_four_intervals(spark):
    row = D.depth_classes(spark.createDataFrame(FOUR, BEDGRAPH)).first()
    assert list(row)[1:] == [0, 1, 3, 0, 0]


def test_stats_of_little(spark):
    one = spark.createDataFrame(FOUR[:1], BEDGRAPH)
    everyone = spark.createDataFrame([("s",), ("none",)], "sample_id string")
    rows = {r.sample_id: r for r in D.depth_stats(one, everyone).collect()}
    assert rows["s"].std_coverage is None and rows["s"].mean_coverage == 10
    assert rows["none"].total_regions == 0 and rows["none"].mean_coverage is None
    filled = {r.sample_id: r for r in D.depth_stats_filled(one, everyone).collect()}
    assert filled["none"].mean_coverage == 0 and filled["none"].max_coverage == 0
    text = D.depth_report(one).first().stats
    assert text["total_regions"] == "1" and text["std_coverage"] == "nan"
    assert text["max_coverage"] == "10.0" and text["medium_coverage_regions"] == "1"
    million = spark.createDataFrame([("s", "c", 0, 1, 10_000_000)], BEDGRAPH)
    assert D.depth_report(million).first().stats["mean_coverage"] == "10000000.0"


def random_spans(seed, count=400, length=300):
    rng = random.Random(seed)
    spans = []
    for _ in range(count):
        start = rng.choice([rng.randint(0, length), 7])
        spans.append(
            (rng.choice("ab"), rng.choice(["c1", "c2"]), start, start + rng.randint(0, 40))
        )
    return spans


def brute_depth(spans):
    found = {}
    for sample, chrom, start, end in spans:
        for at in range(start, end):
            found[sample, chrom, at] = found.get((sample, chrom, at), 0) + 1
    return found


@pytest.mark.parametrize("seed, tile", [(1, 1), (2, 7), (3, 64), (4, 100_000)])
def test_depth_equals_brute_force(spark, seed, tile):
    spans = random_spans(seed)
    frame = spark.createDataFrame(spans, SPANS)
    rows = D.bed_sort(D.interval_depth(frame, tile)).collect()
    found = {
        (r.sample_id, r.chrom, at): r.depth for r in rows for at in range(r.start, r.end)
    }
    assert found == brute_depth(spans)
    assert sum(r.depth * (r.end - r.start) for r in rows) == sum(
        end - start for _, _, start, end in spans
    )
    # Runs are maximal: neighbours that touch differ in depth.
    for a, b in zip(rows, rows[1:]):
        if (a.sample_id, a.chrom, a.end) == (b.sample_id, b.chrom, b.start):
            assert a.depth != b.depth


def test_depth_ignores_unmapped_and_counts_deletions(spark):
    frame = spark.createDataFrame(
        [
            ("s", 0, "c", 10, "5M2D3M"),
            ("s", 256, "c", 10, "2S4M"),
            ("s", 4, "c", 10, "50M"),
            ("s", 4, None, None, "*"),
        ],
        "sample_id string, flag int, chrom string, pos0 long, cigar string",
    )
    rows = [tuple(r)[2:] for r in D.bed_sort(D.genome_depth(frame)).collect()]
    assert rows == [(10, 14, 2), (14, 20, 1)]


def test_depth_reads_its_input_once(spark, tmp_path):
    path = str(tmp_path / "spans")
    spark.createDataFrame(random_spans(5), SPANS).write.parquet(path)
    result = D.interval_depth(spark.read.schema(SPANS).parquet(path), 50)
    result.toArrow()
    plan = result._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan parquet") == 1 and "ReusedExchange" in plan


def test_windows_and_levels(spark):
    spans = random_spans(6)
    base = brute_depth(spans)
    runs = D.interval_depth(spark.createDataFrame(spans, SPANS))
    length = 233  # inside the data
    sizes = spark.createDataFrame(
        [("c1", length, 0), ("c3", 120, 1)], "chrom string, length long, chrom_idx long"
    )
    samples = spark.createDataFrame([("a",), ("b",), ("none",)], "sample_id string")
    windows = D.depth_windows(runs, 50, sizes, samples).collect()
    assert len(windows) == 3 * (5 + 3)
    for r in windows:
        end = {"c1": length, "c3": 120}[r.chrom]
        assert r.window_end - r.window_start == min(50, end - r.window_start)
        inside = [
            base.get((r.sample_id, r.chrom, at), 0)
            for at in range(r.window_start, r.window_end)
        ]
        assert r.depth_sum == sum(inside)
        assert r.covered_bases == sum(1 for d in inside if d)
        assert r.max_depth == max(inside)
        assert r.mean_depth == pytest.approx(sum(inside) / len(inside))
    outside = {
        (r.sample_id, r.chrom, at): r.depth
        for r in D.on_unknown_contigs(runs, sizes).collect()
        for at in range(r.start, r.end)
    }
    assert outside == {
        key: d for key, d in base.items() if key[1] != "c1" or key[2] >= length
    }
    for r in D.signal_levels(runs, 10, 4, 3).collect():
        inside = [
            base.get((r.sample_id, r.chrom, at), 0) for at in range(r.bin_start, r.bin_end)
        ]
        assert r.bin_end - r.bin_start == 10 * 4**r.level
        assert (r.sum, r.covered) == (sum(inside), sum(1 for d in inside if d))
        assert (r.min, r.max) == (min(d for d in inside if d), max(inside))
