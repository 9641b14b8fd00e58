import gzip
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline import testbed
from strandline.operators import depth as D
from strandline.operators.placement import reference_tiles
from strandline.sources import fasta, fastq, fastq_source, manifest, sam, tables


def fastq_records(seed, count=60):
    """Records whose qualities are full of '@' and '+', some of them empty."""
    rng = random.Random(seed)
    found = []
    for i in range(count):
        size = rng.choice([0, 1, 5, 9])
        found.append(
            (
                f"r{i}",
                "".join(rng.choice("ACGT") for _ in range(size)),
                "".join(rng.choice("@@+I#") for _ in range(size)),
            )
        )
    return found


def fastq_text(records, newline="\n"):
    return "".join(
        f"@{name}/1 comment{newline}{seq}{newline}+{newline}{qual}{newline}"
        for name, seq, qual in records
    )


def read_ranges(path, size, split, block):
    reader = fastq.range_reader(block)
    ranges = [
        {"sample_id": "s", "mate": 1, "path": str(path), "start": at, "end": at + split}
        for at in range(0, max(size, 1), split)
    ]
    rows = []
    for batch in reader([pa.RecordBatch.from_pylist(ranges)]):
        rows += batch.to_pylist()
    return sorted(rows, key=lambda r: r["ordinal"])


@pytest.mark.parametrize("seed", [1, 2])
def test_every_split_size_finds_every_record(tmp_path, seed):
    records = fastq_records(seed)
    path = tmp_path / "x_1.fastq"
    path.write_text(fastq_text(records))
    size = path.stat().st_size
    for split in range(1, size + 3):
        rows = read_ranges(path, size, split, random.Random(split).choice([7, 64, 4096]))
        assert [(r["read_id"], r["seq"], r["qual"]) for r in rows] == records, split
        assert all(r["error"] is None for r in rows)


def test_truncated_and_malformed_files(tmp_path):
    records = fastq_records(3, 20)
    text = fastq_text(records)
    for cut in (3, 12, 25):
        path = tmp_path / f"cut{cut}_1.fastq"
        path.write_text(text + "@last\nACGTACGTAC\n+\nIIIIIIIIII\n"[:cut])
        size = path.stat().st_size
        for split in (17, 60, size):
            errors = [r for r in read_ranges(path, size, split, 64) if r["error"]]
            assert errors, (cut, split)
    path = tmp_path / "bad_1.fastq"
    path.write_text("@a\nACGT\n+\nIII\n" + text)
    rows = read_ranges(path, path.stat().st_size, 1 << 20, 4096)
    assert [r["error"] for r in rows] == ["malformed record"]
    missing = read_ranges(tmp_path / "none_1.fastq", 10, 100, 64)
    assert missing[0]["error"].startswith("unreadable")
    (tmp_path / "no_1.fastq.gz").write_bytes(b"not gzip at all")
    assert read_ranges(tmp_path / "no_1.fastq.gz", 10, 100, 64)[0]["error"]


def test_windows_line_ends(tmp_path):
    records = fastq_records(4, 10)
    path = tmp_path / "w_1.fastq"
    path.write_bytes(fastq_text(records, "\r\n").encode())
    for split in (11, 50, 5000):
        rows = read_ranges(path, path.stat().st_size, split, 64)
        assert [(r["read_id"], r["seq"], r["qual"]) for r in rows] == records


def test_manifest_and_reads(spark, tmp_path):
    records = fastq_records(5)
    text = fastq_text(records)
    for name in ("S_10_1", "S_10_2", "A_1", "A_2", "lonely_1", "other_2"):
        (tmp_path / f"{name}.fastq").write_text(text)
    for name in ("Z_1", "Z_2"):
        with gzip.open(tmp_path / f"{name}.fastq.gz", "wt") as out:
            out.write(text)
    (tmp_path / "notes.txt").write_text("x")
    table = manifest.fastq_manifest(spark, str(tmp_path))
    rows = {r.sample_id: r for r in manifest.with_sizes_in_mb(table).collect()}
    assert set(rows) == {"S_10", "A", "Z"}
    assert rows["A"].r1_bytes == len(text)
    assert rows["A"].r1_size_mb == f"{len(text) / 1048576:.2f}"
    orphans = manifest.fastq_orphans(spark, str(tmp_path)).collect()
    assert [r.sample_id for r in orphans] == ["lonely"]
    for split in (200, 1 << 20):
        reads = fastq.read_fastq(fastq.mate_files(table), split)
        assert reads.count() == 6 * len(records)
        mine = reads.filter("sample_id = 'Z' and mate = 2").orderBy("ordinal")
        assert [(r.read_id, r.seq, r.qual) for r in mine.collect()] == records


def test_failed_samples(spark, tmp_path):
    good = fastq_text(fastq_records(6, 5))
    for name, text in (("g_1", good), ("g_2", good), ("b_1", good), ("b_2", good[:-4])):
        (tmp_path / f"{name}.fastq").write_text(text)
    table = manifest.fastq_manifest(spark, str(tmp_path))
    reads = fastq.read_fastq(fastq.mate_files(table))
    assert [r.sample_id for r in fastq.failed_samples(reads).collect()] == ["b"]
    assert {r.sample_id for r in fastq.sound_reads(reads).collect()} == {"g"}


CONTIGS = {"c2": "ACGTNNACgtacgt" * 9, "c10": "TTTT", "c1": "GATTACA" * 40}


def write_reference(folder, width=10, newline="\n"):
    text, index = "", []
    for name, bases in CONTIGS.items():
        text += f">{name} about it{newline}"
        index.append(f"{name}\t{len(bases)}\t{len(text)}\t{width}\t{width + len(newline)}")
        for i in range(0, len(bases), width):
            text += bases[i : i + width] + newline
    (folder / "ref.fa").write_bytes(text.encode())
    (folder / "ref.fa.fai").write_text("\n".join(index) + "\nbroken line\n")
    return str(folder / "ref.fa"), str(folder / "ref.fa.fai")


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_reference(spark, tmp_path, newline):
    path, index = write_reference(tmp_path, newline=newline)
    contigs = fasta.read_fasta(spark, path)
    rows = contigs.orderBy("chrom_idx").collect()
    assert [(r.chrom, r.seq, r.length) for r in rows] == [
        (name, bases, len(bases)) for name, bases in CONTIGS.items()
    ]
    sizes = fasta.read_fai(spark, index).orderBy("chrom_idx").collect()
    assert [(r.chrom, r.length) for r in sizes] == [
        (name, len(bases)) for name, bases in CONTIGS.items()
    ]
    assert {tuple(r) for r in fasta.chrom_sizes(contigs).collect()} == {
        tuple(r) for r in sizes
    }
    whole = reference_tiles(contigs, 16, 5)
    ranged = fasta.read_fasta_tiles(spark, path, index, 16, 5, tiles_per_task=4)

    def content(tiles):
        return sorted(
            (r.chrom, r.tile, r.context_start, bytes(r.context)) for r in tiles.collect()
        )

    assert content(whole) == content(ranged)
    assert b"N" not in b"".join(row[3] for row in content(whole))


SAM = """@HD\tVN:1.6\tSO:unsorted
@SQ\tSN:chr2\tLN:500
@SQ\tSN:chr10\tLN:400
r1\t99\tchr2\t11\t60\t5S10M2D3M4I\t=\t51\t60\tACGT\tIIII\tNM:i:2\tXA:Z:a:b:c
r2\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\tIIII
"""


def test_sam(spark, tmp_path):
    path = tmp_path / "in.sam"
    path.write_text(SAM)
    records = sam.read_sam(spark, str(path), "s").orderBy("ordinal")
    one, two = records.collect()
    assert (one.qname, one.flag, one.chrom, one.pos0, one.mapq) == ("r1", 99, "chr2", 10, 60)
    assert (one.rnext, one.pnext0, one.tlen) == ("=", 50, 60)
    assert one.tags == {"NM": "i:2", "XA": "Z:a:b:c"}
    assert (two.chrom, two.pos0, two.pnext0, two.tags) == (None, None, None, {})
    header = sam.read_sam_header(spark, str(path), "s").orderBy("chrom_idx").collect()
    assert [(r.chrom, r.length) for r in header] == [("chr2", 500), ("chr10", 400)]
    depth = D.genome_depth(records).first()
    assert (depth.start, depth.end) == (10, 25)

    out = str(tmp_path / "out")
    sam.write_sam(records, out, fasta.read_fai(spark, write_reference(tmp_path)[1]))
    again = sam.read_sam(spark, f"{out}/records").drop("ordinal")
    lines = {r.value for r in spark.read.text(f"{out}/records").collect()}
    assert lines == set(SAM.splitlines()[3:])
    assert sorted(map(str, again.collect())) == sorted(
        map(str, records.drop("ordinal").collect())
    )
    assert spark.read.text(f"{out}/header").count() == 3


def test_store_prunes_by_region(spark, tmp_path):
    path = tmp_path / "in.sam"
    path.write_text(SAM)
    out = str(tmp_path / "store")
    sam.write_alignment_store(sam.read_sam(spark, str(path), "007"), out)
    store = sam.read_alignment_store(spark, out)
    assert {r.sample_id for r in store.collect()} == {"007"}
    assert [r.qname for r in sam.region(store, "chr2", 0, 11).collect()] == ["r1"]
    plan = sam.region(store, "chr2", 0, 11)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(chrom" in plan and "GreaterThanOrEqual(pos0,0)" in plan


def test_store_overlaps_read_bins_in_reach(spark, tmp_path):
    spans = {"short": "20M", "far": "100M5000N50M", "none": "*", "wide": "30M90000000N30M"}
    starts = {"short": (0, 95, 199, 200), "far": (10, 5000, 150), "none": (100, 99), "wide": (3,)}
    lines = ["@HD\tVN:1.6", "@SQ\tSN:chr1\tLN:100000000"]
    for kind, places in starts.items():
        for at in places:
            lines.append(f"{kind}{at}\t0\tchr1\t{at + 1}\t60\t{spans[kind]}\t*\t0\t0\tACGT\tIIII")
    (tmp_path / "in.sam").write_text("\n".join(lines) + "\n")
    out = str(tmp_path / "store")
    records = sam.read_sam(spark, str(tmp_path / "in.sam"), "s")
    sam.write_alignment_store(records, out)
    found = sam.stored_overlaps(spark, out, "chr1", 100, 200)
    names = {row.qname for row in found.collect()}
    assert names == {"short95", "short199", "far10", "far150", "none100", "wide3"}
    assert names == {r.qname for r in sam.overlapping(records, "chr1", 100, 200).collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "span_bin" in plan and "GreaterThan(pos0,-156)" in plan and "LessThan(pos0,200)" in plan
    files = {f.rsplit("span_bin=", 1)[1][0] for f in spark.read.parquet(out).inputFiles()}
    assert files == {"0", "2", "7"}


def test_bedgraph(spark, tmp_path):
    (tmp_path / "d.bed").write_text("chr1\t0\t100\t10\nchr1\t100\t200\t25\n")
    depth = tables.read_bedgraph(spark, str(tmp_path / "d.bed"), "s")
    assert [tuple(r) for r in depth.orderBy("start").collect()] == [
        ("s", "chr1", 0, 100, 10),
        ("s", "chr1", 100, 200, 25),
    ]
    tables.write_bedgraph(depth, str(tmp_path / "out"))
    text = "".join(
        part.read_text() for part in sorted((tmp_path / "out/sample_id=s").glob("part-*"))
    )
    assert text == "chr1\t0\t100\t10\nchr1\t100\t200\t25\n"
    (tmp_path / "empty.bed").write_text("")
    assert tables.read_bedgraph(spark, str(tmp_path / "empty.bed"), "s").isEmpty()


def test_bedgraph_with_decimal_depth(spark, tmp_path):
    (tmp_path / "d.bed").write_text("c\t0\t9\t10.0\nc\t9\t12\t1.5\nc\tx\t12\t1\nc\t0\n")
    rows = tables.read_bedgraph_checked(spark, str(tmp_path / "d.bed"), "s").collect()
    assert [(r.start, r.end, r.depth) for r in rows if r.error is None] == [(0, 9, 10)]
    assert sum(r.error is not None for r in rows) == 3
    with pytest.raises(Exception, match="not a depth interval"):
        tables.read_bedgraph(spark, str(tmp_path / "d.bed"), "s").collect()


def test_sam_with_broken_lines(spark, tmp_path):
    good = "r1\t0\tc\t5\t60\t4M\t*\t0\t0\tACGT\tIIII"
    lines = [good + "\tNM:i:1\tNM:i:2\tXX:Z:a", "r2\t0\tc", good.replace("\t5\t", "\tx\t")]
    (tmp_path / "a.sam").write_text("\n".join(lines) + "\n")
    checked = sam.read_sam_checked(spark, str(tmp_path / "a.sam"), "s")
    rows = checked.orderBy("ordinal").collect()
    assert rows[0].tags == {"NM": "i:2", "XX": "Z:a"} and rows[0].error is None
    assert all(r.error and r.qname is None for r in rows[1:])
    failed = sam.failed_samples(checked).collect()
    assert [(r.sample_id, r.error) for r in failed] == [
        ("s", "not an alignment record: r2\t0\tc")
    ]
    with pytest.raises(Exception, match="not an alignment record"):
        sam.read_sam(spark, str(tmp_path / "a.sam"), "s").collect()


def test_one_packing_for_each_sample(spark, tmp_path):
    for name in ("A_1.fastq", "A_2.fastq", "A_1.fastq.gz", "A_2.fastq.gz"):
        (tmp_path / name).write_text("@a\nA\n+\nI\n")
    for name in ("B_1.fastq", "B_2.fastq.gz", "C_1.fastq.gz", "D_2.fastq"):
        (tmp_path / name).write_text("@a\nA\n+\nI\n")
    rows = manifest.fastq_manifest(spark, str(tmp_path)).orderBy("sample_id").collect()
    found = [(r.sample_id, r.r1_path.rsplit("/")[-1], r.r2_path.rsplit("/")[-1]) for r in rows]
    assert found == [
        ("A", "A_1.fastq", "A_2.fastq"),
        ("B", "B_1.fastq", "B_2.fastq.gz"),
    ]
    orphans = manifest.fastq_orphans(spark, str(tmp_path)).collect()
    assert [r.sample_id for r in orphans] == ["C"]


def test_store_is_sorted_once(spark, tmp_path):
    from strandline.schemas import ALIGNMENTS

    records = spark.range(5000).selectExpr(
        "'s' AS sample_id", "concat('q', id) AS qname", "0 AS flag",
        "if(id % 2 = 0, 'chr10', 'chr2') AS chrom", "(id * 7919) % 5003 AS pos0",
        "0 AS mapq", "'1M' AS cigar", "cast(null AS string) AS rnext",
        "cast(null AS long) AS pnext0", "0 AS tlen", "'A' AS seq", "'I' AS qual",
        "cast(null AS map<string,string>) AS tags", "id AS ordinal",
    ).to(ALIGNMENTS)
    out = str(tmp_path / "store")
    sam.write_alignment_store(records, out)
    files = spark.read.parquet(out).select("pos0", F.col("_metadata.file_path").alias("f"))
    by_file = {}
    for row in files.collect():
        by_file.setdefault(row.f, []).append(row.pos0)
    assert all(places == sorted(places) for places in by_file.values())


REPORT = """4096 + 0 in total (QC-passed reads + QC-failed reads)
3072 + 0 mapped (75.00% : N/A)
{primary}640 + 0 paired in sequencing
512 + 0 properly paired (80.00% : N/A)
96 + 0 singletons (15.00% : N/A)
{far} + 0 with mate mapped to a different chr
{sure} + 2 with mate mapped to a different chr (mapQ>=5)
"""


def test_flagstat_reports(spark, tmp_path):
    (tmp_path / "a.txt").write_text(REPORT.format(primary="", far=0, sure=0))
    primary = "2900 + 0 primary mapped (70.80% : N/A)\n"
    (tmp_path / "b.txt").write_text(REPORT.format(primary=primary, far=7, sure=3))
    rows = {
        r.file.rsplit("/", 1)[-1]: r
        for r in tables.read_flagstat(spark, str(tmp_path)).collect()
    }
    for row in rows.values():
        assert (row.total_reads, row.mapped_reads, row.paired_reads) == (4096, 3072, 640)
        assert (row.properly_paired, row.singletons, row.both_mapped) == (512, 96, None)
        assert row.mapping_rate == 75.0 and row.different_chr_mapq5_qc_failed == 2
    assert (rows["a.txt"].different_chr, rows["a.txt"].different_chr_mapq5) == (0, 0)
    assert (rows["b.txt"].different_chr, rows["b.txt"].different_chr_mapq5) == (7, 3)


def test_json_reports(spark, tmp_path):
    stats = D.depth_stats(
        spark.createDataFrame(
            [("s", "c", 0, 5, 2)],
            "sample_id string, chrom string, start long, end long, depth long",
        )
    )
    tables.write_json(stats, str(tmp_path / "j"), by_sample=True)
    row = spark.read.schema(stats.schema).json(str(tmp_path / "j")).first()
    assert (row.sample_id, row.total_regions, row.mean_coverage) == ("s", 1, 2.0)


def test_fastq_as_a_data_source(spark, tmp_path):
    from strandline.sources import fastq_source

    record = "@{0}.{1}/{2} note\nACGTN\n+\n@II#I\n"
    for sample, mate, count in (("A", 1, 40), ("A", 2, 40), ("S_1", 1, 25)):
        text = "".join(record.format(sample, i, mate) for i in range(count))
        (tmp_path / f"{sample}_{mate}.fastq").write_text(text)
    with gzip.open(tmp_path / "Z_2.fastq.gz", "wt") as out:
        out.write(record.format("Z", 0, 2) + "@cut\nAC\n")
    (tmp_path / "E_1.fastq").write_text("")
    (tmp_path / "notes.txt").write_text("@x\nA\n+\nI\n")
    fastq_source.register(spark)
    found = spark.read.format("fastq").option("split_bytes", 64).load(f"file://{tmp_path}")
    files = spark.createDataFrame(
        [
            (sample, mate, str(path), path.stat().st_size)
            for sample, mate, path in (
                ("A", 1, tmp_path / "A_1.fastq"),
                ("A", 2, tmp_path / "A_2.fastq"),
                ("S_1", 1, tmp_path / "S_1_1.fastq"),
                ("Z", 2, tmp_path / "Z_2.fastq.gz"),
            )
        ],
        "sample_id string, mate byte, path string, bytes long",
    )
    want = fastq.read_fastq(files, 64)
    assert found.schema == want.schema
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    chosen = found.filter("sample_id = 'S_1' and mate = 1 and length(seq) = 5")
    assert chosen.count() == 25
    size = (tmp_path / "S_1_1.fastq").stat().st_size
    assert chosen.rdd.getNumPartitions() == -(-size // 64)


def test_reference_of_a_run_is_written_in_parts(spark, tmp_path):
    """No task writes the whole reference; tiles are read across its parts as from one file."""
    source = "/root/testdata/sf0.001"
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    usual = spark.conf.get(name)
    spark.conf.set(name, "false")  # which would join parts as small as these
    try:
        testbed.write_run_input(spark, source, str(tmp_path))
    finally:
        spark.conf.set(name, usual)
    parts = [p for p in (tmp_path / "ref.fa").glob("part-*") if p.stat().st_size]
    assert len(parts) > 1
    whole = sum(p.stat().st_size for p in parts)
    assert max(p.stat().st_size for p in parts) < whole / 2
    ranged = fasta.read_fasta_tiles(
        spark, str(tmp_path / "ref.fa"), str(tmp_path / "ref.fa.fai"), 512, 20, tiles_per_task=40
    )
    tiles = reference_tiles(testbed.view(spark, source, "contigs"), 512, 20)

    def content(found):
        return sorted((r.chrom, r.tile, r.context_start, bytes(r.context)) for r in found.collect())

    assert content(ranged) == content(tiles)


def test_small_fastq_files_share_a_task(spark, tmp_path):
    """Tasks follow the bytes, not the files; every file is read."""
    for i in range(40):
        (tmp_path / f"s{i}_1.fastq").write_text(fastq_text(fastq_records(i, 5)))
    fastq_source.register(spark)
    found = spark.read.format("fastq").option("split_bytes", 1 << 20).load(str(tmp_path))
    assert found.rdd.getNumPartitions() == 3
    counts = found.filter("error is null").groupBy("sample_id").count().collect()
    assert sorted(tuple(r) for r in counts) == sorted((f"s{i}", 5) for i in range(40))
    apart = spark.read.format("fastq").option("split_bytes", 1 << 10).load(str(tmp_path))
    assert apart.rdd.getNumPartitions() >= 40
    assert apart.count() == found.count() == 200


def test_files_of_a_run_are_written_by_tasks(spark, tmp_path, monkeypatch):
    """No folder a file, and no renaming by the driver, for which many files took most of the time."""
    source, moved = "/root/testdata/sf0.001", []
    move = testbed._move
    monkeypatch.setattr(testbed, "_move", lambda s, pattern, *a: moved.append(pattern) or move(s, pattern, *a))
    testbed.write_run_input(spark, source, str(tmp_path))
    assert [pattern for pattern in moved if "reads" in pattern] == []
    assert not list(tmp_path.glob("parts/reads/*"))  # nothing is left of attempts
    want = {}
    rows = testbed.view(spark, source, "run_mates").collect()
    for row in sorted(rows, key=lambda r: r.read_id.encode()):
        lines = want.setdefault(f"{row.sample_id}_{row.mate}.fastq", [])
        lines.append(f"@{row.read_id}\n{row.seq}\n+\n{row.qual}\n")
    found = {p.name: p.read_text() for p in (tmp_path / "reads").glob("*.fastq")}
    assert found == {name: "".join(lines) for name, lines in want.items()}


def test_lines_are_written_to_the_file_of_each_run_of_rows(tmp_path):
    import pyarrow as pa

    from strandline.sources.files import lines_writer

    def batch(*rows):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["file", "value"])

    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "a").write_text("of an attempt before")
    batches = [batch(("a", "1"), ("a", "é")), batch(("a", ""), ("b", "2\n3")), batch(("c", "4"))]
    done = list(lines_writer(f"file:{tmp_path}/out", f"{tmp_path}/scratch")(iter(batches)))
    sizes = {r["file"]: r["bytes"] for b in done for r in b.to_pylist()}
    found = {p.name: p.read_text() for p in (tmp_path / "out").iterdir()}
    assert found == {"a": "1\né\n\n", "b": "2\n3\n", "c": "4\n"}
    assert sizes == {name: len(text.encode()) for name, text in found.items()}
    assert not list((tmp_path / "scratch").iterdir())


def test_names_of_many_files_are_read_in_few_tasks(spark, tmp_path):
    for i in range(60):
        for mate in (1, 2)[: 1 + (i > 0)]:
            (tmp_path / f"s{i}_{mate}.fastq").write_text("@r\nA\n+\nI\n" * (i + 1))
    name = "spark.sql.files.maxPartitionBytes"
    usual = spark.conf.get(name)
    spark.conf.set(name, "1m")
    try:
        adaptive = spark.conf.get("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found = manifest.fastq_manifest(spark, str(tmp_path))
        ran = spark.sparkContext.statusTracker()
        spark.sparkContext.setJobGroup("names", "names")
        rows = found.collect()
        stages = [s for job in ran.getJobIdsForGroup("names") for s in ran.getJobInfo(job).stageIds]
        tasks = [info.numTasks for info in map(ran.getStageInfo, stages) if info]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set(name, usual)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r.sample_id: r.r2_bytes for r in rows} == {f"s{i}": 9 * (i + 1) for i in range(1, 60)}
    assert tasks and max(tasks) <= 8
    assert [r.sample_id for r in manifest.fastq_orphans(spark, str(tmp_path)).collect()] == ["s0"]


def test_small_files_of_a_run_share_tasks(spark, tmp_path):
    rows = []
    for i in range(40):
        path = tmp_path / f"s{i}_1.fastq"
        path.write_text(fastq_text(fastq_records(i, 5)))
        rows.append((f"s{i}", 1, str(path), path.stat().st_size))
    files = spark.createDataFrame(rows, "sample_id string, mate byte, path string, bytes long")
    found = fastq.read_fastq(files)
    assert found.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    assert fastq.read_fastq(files.limit(3)).rdd.getNumPartitions() == 3
    counts = found.filter("error is null").groupBy("sample_id").count().collect()
    assert sorted(tuple(r) for r in counts) == sorted((f"s{i}", 5) for i in range(40))


def test_signal_of_many_contigs_is_few_files(spark, tmp_path):
    rows = [("s", f"c{c}", level, b, b * 10, 1.0) for c in range(50) for level in (0, 1) for b in range(3)]
    signal = spark.createDataFrame(
        rows, "sample_id string, chrom string, level int, bin_start long, bin_end long, mean double"
    )
    tables.write_signal(signal, str(tmp_path / "signal"))
    assert len(list((tmp_path / "signal").rglob("part-*.parquet"))) < 20
    found = spark.read.parquet(str(tmp_path / "signal"))
    assert sorted(map(tuple, found.select(*signal.columns).collect())) == sorted(rows)
    one = found.filter("chrom = 'c7' and level = 1")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(chrom,c7)" in plan.split("PushedFilters")[1]
    assert "level" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert one.count() == 3
