import random

from strandline.operators import accounting, alignments as A

RECORD = (
    "sample_id string, qname string, flag int, chrom string, pos0 long, mapq int, "
    "rnext string, seq string, ordinal long"
)


def records(spark, rows):
    return spark.createDataFrame(rows, RECORD)


def random_records(seed, count=500):
    rng = random.Random(seed)
    return [
        (
            rng.choice(["a", "b"]),
            f"q{i}",
            sum(rng.choice([0, bit]) for bit in (1, 2, 4, 8, 256, 512, 2048)),
            rng.choice(["chr2", "chr10", "chr1"]),
            rng.choice([5, rng.randint(0, 60)]),
            rng.randint(0, 60),
            rng.choice(["chr2", "chr10", "="]),
            rng.choice(["A", "C"]),
            i,
        )
        for i in range(count)
    ]


def test_flagstat(spark):
    rows = random_records(1)
    found = {r.sample_id: r for r in A.flagstat(records(spark, rows)).collect()}
    for sample in "ab":
        for suffix, failed in (("", 0), ("_qc_failed", 512)):
            mine = [r for r in rows if r[0] == sample and r[2] & 512 == failed]
            primary = [r for r in mine if r[2] & 1 and not r[2] & (256 | 2048)]
            both = [r for r in primary if not r[2] & 12]
            away = [r for r in both if r[6] not in ("=", r[3])]
            expected = {
                "total_reads": len(mine),
                "mapped_reads": sum(not r[2] & 4 for r in mine),
                "paired_reads": len(primary),
                "properly_paired": sum(r[2] & 6 == 2 for r in primary),
                "both_mapped": len(both),
                "singletons": sum(r[2] & 12 == 8 for r in primary),
                "different_chr": len(away),
                "different_chr_mapq5": sum(r[5] >= 5 for r in away),
            }
            for name, value in expected.items():
                assert found[sample][name + suffix] == value, name


def test_flagstat_without_passing_records(spark):
    row = A.flagstat(
        records(spark, [("s", "q", 512, "c", 1, 0, "=", "A", 0)])
    ).first()
    assert row.total_reads == 0 and row.mapping_rate == 0.0


def first_copies(rows):
    kept = {}
    for row in sorted(rows, key=lambda r: r[8]):
        kept.setdefault((row[0], row[3], row[4], row[7]), row)
    return sorted(kept.values())


def test_remove_duplicates_keeps_the_first(spark, rows):
    data = random_records(2)
    frame = A.remove_duplicates(records(spark, data))
    assert sorted(tuple(r) for r in frame.collect()) == first_copies(data)
    assert sorted(tuple(r) for r in A.remove_duplicates(frame).collect()) == first_copies(
        data
    )
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_null_keys_are_duplicates_of_each_other(spark):
    data = [("s", f"q{i}", 4, None, None, 0, None, "A", i) for i in range(3)]
    assert [r.qname for r in A.remove_duplicates(records(spark, data)).collect()] == ["q0"]


def test_stats_with_and_without_duplicates(spark):
    data = random_records(3)
    for dedup in (False, True):
        found = {
            r.sample_id: r
            for r in A.alignment_stats(records(spark, data), 20, dedup).collect()
        }
        for sample in "ab":
            mine = [r for r in data if r[0] == sample]
            mapped = [r for r in mine if not r[2] & 4]
            kept = [r for r in mapped if r[5] >= 20]
            if dedup:
                kept = first_copies(kept)
            row = found[sample]
            assert (row.total_reads, row.mapped_reads, row.filtered_reads) == (
                len(mine),
                len(mapped),
                len(kept),
            )
            assert abs(row.filter_rate - 100 * len(kept) / len(mine)) < 1e-9
            mean = sum(r[5] for r in kept) / len(kept)
            assert abs(row.average_mapping_quality - mean) < 1e-9


def test_stats_when_nothing_is_kept(spark):
    row = A.alignment_stats(
        records(spark, [("s", "q", 4, None, None, 0, None, "A", 0)])
    ).first()
    assert (row.filtered_reads, row.mapping_rate, row.average_mapping_quality) == (0, 0, 0)


def test_sort_orders(spark):
    data = random_records(4, 200) + [
        ("a", "u", 4, None, None, 0, None, "A", 900),
        ("a", "x", 0, "other", 3, 0, None, "A", 901),
    ]
    frame = records(spark, data)
    sizes = spark.createDataFrame(
        [("chr2", 100, 0), ("chr10", 100, 1), ("chr1", 100, 2)],
        "chrom string, length long, chrom_idx long",
    )
    header = {"chr2": 0, "chr10": 1, "chr1": 2, "other": 3, None: 4}
    by_header = A.coordinate_sort(frame, sizes, "header").collect()
    assert [tuple(r) for r in by_header] == sorted(
        data, key=lambda r: (r[0], header[r[3]], r[4] if r[4] is not None else 1 << 40, r[8])
    )
    by_name = A.coordinate_sort(frame).collect()
    assert [tuple(r) for r in by_name] == sorted(
        data, key=lambda r: (r[0], r[3] or "~", r[4] if r[4] is not None else 1 << 40, r[8])
    )


def test_filters(spark):
    data = random_records(5)
    kept = A.filter_alignments(records(spark, data), 30, True).collect()
    expected = [r for r in data if not r[2] & 4 and r[5] >= 30]
    assert sorted(tuple(r) for r in kept) == first_copies(expected)


def test_accounting(spark):
    ledger = spark.createDataFrame(
        [("s1", "a", "success"), ("s2", "a", "failed"), ("s1", "b", "error")],
        "sample_id string, stage string, status string",
    )
    stages = {r.stage: r for r in accounting.stage_accounting(ledger).collect()}
    assert (stages["a"].success_count, stages["a"].total_count) == (1, 2)
    breakdown = {r.stage: r for r in accounting.status_breakdown(ledger).collect()}
    assert tuple(breakdown["b"])[1:] == (1, 0, 0, 1)
    from pyspark.sql import functions as F

    wide = accounting.with_stage_result(
        ledger, "result", status=F.col("status"), error=F.lit(None).cast("string")
    )
    assert [r.sample_id for r in accounting.successful(wide, "result").collect()] == ["s1"]
    empty = accounting.with_stage_result(ledger.limit(0), "result", status=F.col("status"))
    assert accounting.successful(empty, "result").count() == 0


def test_places_of_a_total_order(spark):
    from strandline.operators.ordering import numbered

    rows = spark.range(3000, numPartitions=7).selectExpr("id", "(id * 7919) % 3001 AS pos")
    placed = numbered(rows.orderBy("pos"))
    found = {row.pos: row.place for row in placed.collect()}
    assert [found[pos] for pos in sorted(found)] == list(range(1, 3001))
    nothing = numbered(rows.filter("id < 0").orderBy("pos"))
    assert nothing.columns == ["id", "pos", "place"] and nothing.isEmpty()


def test_header_order_deals_no_contig_to_one_task(spark):
    """Whatever the header's estimated size, records are not moved by contig."""
    records = spark.range(400).selectExpr(
        "'s' as sample_id", "id as ordinal", "if(id % 2 = 0, 'b', 'a') as chrom", "id as pos0"
    )
    sizes = spark.createDataFrame([("b", 0), ("a", 1)], "chrom string, chrom_idx long")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = A.coordinate_sort(records, sizes, "header")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(chrom" not in plan
        assert [row.chrom for row in found.collect()] == ["b"] * 200 + ["a"] * 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
