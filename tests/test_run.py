"""A staged run over generated FASTQ and FASTA files."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from strandline.plans.run import Options, Run

PARTNER = str.maketrans("ACGT", "TGCA")


def reverse_complement(text):
    return text.translate(PARTNER)[::-1]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("input")
    rng = random.Random(5)
    contigs = {
        name: "".join(rng.choice("ACGT") for _ in range(size))
        for name, size in (("chr2", 3000), ("chr10", 2000), ("chr1", 1500))
    }
    width, offset, index, text = 60, 0, [], ""
    for name, bases in contigs.items():
        head = f">{name} something\n"
        body = "\n".join(bases[i : i + width] for i in range(0, len(bases), width)) + "\n"
        index.append(f"{name}\t{len(bases)}\t{offset + len(head)}\t{width}\t{width + 1}")
        text += head + body
        offset += len(head) + len(body)
    (folder / "ref.fa").write_text(text)
    (folder / "ref.fa.fai").write_text("\n".join(index) + "\n")
    reads = folder / "reads"
    reads.mkdir()
    truth = {}

    def pairs(sample, count):
        one, two = [], []
        for i in range(count):
            name = rng.choice(list(contigs))
            size = rng.randint(120, 250)
            start = rng.randint(0, len(contigs[name]) - size)
            insert = contigs[name][start : start + size]
            mate1, mate2 = insert[:80], reverse_complement(insert)[:80]
            truth[(sample, f"{sample}.{i}")] = (name, start, size)
            one.append(f"@{sample}.{i}/1\n{mate1}\n+\n{'I' * 80}\n")
            two.append(f"@{sample}.{i}/2\n{mate2}\n+\n{'I' * 80}\n")
        return "".join(one), "".join(two)

    for sample in ("S_10", "B"):
        one, two = pairs(sample, 120)
        (reads / f"{sample}_1.fastq").write_text(one)
        (reads / f"{sample}_2.fastq").write_text(two)
    one, two = pairs("Z", 30)
    with gzip.open(reads / "Z_1.fastq.gz", "wt") as out:
        out.write(one)
    with gzip.open(reads / "Z_2.fastq.gz", "wt") as out:
        out.write(two)
    one, two = pairs("broken", 10)
    (reads / "broken_1.fastq").write_text(one[:-40])
    (reads / "broken_2.fastq").write_text(two)
    (reads / "orphan_1.fastq").write_text(one)
    return folder, contigs, truth


def test_run(spark, files, tmp_path, rows):
    folder, contigs, truth = files
    run = Run(
        spark,
        str(folder / "reads"),
        str(folder / "ref.fa"),
        str(folder / "ref.fa.fai"),
        str(tmp_path / "out"),
        Options(write_fastq=True, write_sam=True, window_size=500),
    )
    accounting = {row.stage: row for row in run.execute().collect()}
    assert accounting["preprocessing"].success_count == 3
    assert accounting["preprocessing"].total_count == 5
    assert accounting["coverage"].success_count == 3
    ledger = rows(run.ledger().filter("status <> 'success'"), "stage", "sample_id", "error")
    assert [row[:2] for row in ledger] == [
        ("preprocessing", "broken"),
        ("preprocessing", "orphan"),
    ]
    assert ledger[1][2] == "no file of mate 2"

    placed = run.load("alignments").collect()
    assert len(placed) == 2 * (120 + 120 + 30)
    for record in placed:
        name, start, size = truth[(record.sample_id, record.qname)]
        assert record.chrom == name
        first = record.flag & 64
        assert record.pos0 == (start if first else start + size - 80)
        assert bool(record.flag & 16) == (not first)
        assert record.flag & 2 and record.flag & 1
        assert record.tlen == (size if first else -size)
        assert record.seq == contigs[name][record.pos0 : record.pos0 + 80]
        assert record.tags == {"NM": "i:0"} and record.mapq == 60

    depth = run.load("depth").collect()
    covered = {}
    for record in placed:
        for at in range(record.pos0, record.pos0 + 80):
            key = (record.sample_id, record.chrom, at)
            covered[key] = covered.get(key, 0) + 1
    found = {
        (row.sample_id, row.chrom, at): row.depth
        for row in depth
        for at in range(row.start, row.end)
    }
    assert found == covered

    for mate in (1, 2):
        names = [
            line[1:]
            for part in sorted((tmp_path / "out/trimmed/sample_id=B" / f"mate={mate}").glob("part-*"))
            for line in part.read_text().splitlines()[0::4]
        ]
        assert names == [f"B.{i}" for i in range(120)]

    sorted_rows = spark.read.text(str(tmp_path / "out/sam/records/sample_id=S_10"))
    assert sorted_rows.count() == 240
    header = sorted(
        line
        for part in (tmp_path / "out/sam/header").glob("part-*")
        for line in part.read_text().splitlines()
    )
    assert header == ["@SQ\tSN:chr1\tLN:1500", "@SQ\tSN:chr10\tLN:2000", "@SQ\tSN:chr2\tLN:3000"]
    report = [
        json.loads(line)
        for part in (tmp_path / "out/reports/run").glob("part-*")
        for line in part.read_text().splitlines()
    ]
    states = {row["stage"]: row["status"] for row in report}
    assert states["run"] == "completed" and len(states) == 5


def test_runs_in_one_folder_keep_apart(spark, files, tmp_path):
    folder, _, _ = files
    good, bad = tmp_path / "good", tmp_path / "bad"
    for place, text in ((good, None), (bad, "@a\nACGT\n+\nII\n")):
        place.mkdir()
        for mate in (1, 2):
            own = text or (folder / "reads" / f"B_{mate}.fastq").read_text()
            (place / f"B_{mate}.fastq").write_text(own)

    def run(place):
        return Run(
            spark,
            str(place),
            str(folder / "ref.fa"),
            str(folder / "ref.fa.fai"),
            str(tmp_path / "out"),
        )

    first, second = run(good), run(bad)
    assert len(first.execute().collect()) == 4
    result = [(row.stage, row.success_count) for row in second.execute().collect()]
    assert result == [("preprocessing", 0)]
    assert first.ledger().count() == 4 and second.ledger().count() == 1


def test_run_with_repeated_names(spark, files, tmp_path):
    folder, contigs, _ = files
    place = tmp_path / "reads"
    place.mkdir()
    bases = contigs["chr2"]
    starts = range(0, 1000, 100)
    for mate in (1, 2):
        text = ""
        for start in starts:
            insert = bases[start : start + 180]
            read = insert[:80] if mate == 1 else reverse_complement(insert)[:80]
            text += f"@same.{mate}\n{read}\n+\n{'I' * 80}\n"
        (place / f"R_{mate}.fastq").write_text(text)
    run = Run(
        spark,
        str(place),
        str(folder / "ref.fa"),
        str(folder / "ref.fa.fai"),
        str(tmp_path / "out"),
    )
    assert [row.success_count for row in run.execute().collect()] == [1] * 4
    records = run.load("alignments").collect()
    assert len(records) == 20
    assert sorted(r.pos0 for r in records if r.flag & 64) == list(starts)
    assert all(r.flag & 2 and abs(r.tlen) == 180 for r in records)


def test_run_stops_without_success(spark, files, tmp_path):
    folder, _, _ = files
    reads = tmp_path / "reads"
    reads.mkdir()
    (reads / "bad_1.fastq").write_text("@a\nACGT\n+\nII\n")
    (reads / "bad_2.fastq").write_text("@a\nACGT\n+\nIIII\n")
    run = Run(
        spark,
        str(reads),
        str(folder / "ref.fa"),
        str(folder / "ref.fa.fai"),
        str(tmp_path / "out"),
    )
    result = run.execute().collect()
    assert [(row.stage, row.success_count) for row in result] == [("preprocessing", 0)]
    report = spark.read.json(str(tmp_path / "out/reports/run"))
    assert report.filter("stage = 'run'").first().status == "stopped"


def test_run_without_input(spark, files, tmp_path):
    folder, _, _ = files
    reads = tmp_path / "reads"
    reads.mkdir()
    (reads / "orphan_1.fastq").write_text("@a\nACGT\n+\nIIII\n")
    run = Run(spark, str(reads), str(folder / "ref.fa"), "", str(tmp_path / "out"))
    with pytest.raises(ValueError, match="no pair"):
        run.execute()
    report = spark.read.json(str(tmp_path / "out/reports/run")).first()
    assert report.status == "failed" and "no pair" in report.error


def test_run_records_what_broke(spark, files, tmp_path):
    folder, _, _ = files
    reads = tmp_path / "reads"
    reads.mkdir()
    for mate in (1, 2):
        text = (folder / "reads" / f"B_{mate}.fastq").read_text()
        (reads / f"B_{mate}.fastq").write_text(text)
    run = Run(
        spark,
        str(reads),
        str(folder / "ref.fa"),
        str(tmp_path / "missing.fai"),
        str(tmp_path / "out"),
    )
    with pytest.raises(Exception, match="missing.fai"):
        run.execute()
    rows = {row.stage: row for row in run.ledger().collect()}
    assert rows["preprocessing"].status == "success"
    assert rows["alignment"].status == "error" and "missing.fai" in rows["alignment"].error
    report = spark.read.json(str(tmp_path / "out/reports/run"))
    assert report.filter("stage = 'run'").first().status == "failed"


def test_pipeline_types(spark, files, tmp_path):
    folder, _, _ = files
    reads = tmp_path / "reads"
    reads.mkdir()
    for mate in (1, 2):
        own = (folder / "reads" / f"B_{mate}.fastq").read_text().splitlines()[:80]
        own += [f"@nowhere/{mate}", "ACGGT" * 16, "+", "I" * 80]
        (reads / f"B_{mate}.fastq").write_text("\n".join(own) + "\n")
    found = {}
    for kind in ("hybrid", "classic"):
        out = str(tmp_path / kind)
        options = Options(pipeline=kind, mapq_threshold=20)
        Run(
            spark, str(reads), str(folder / "ref.fa"), str(folder / "ref.fa.fai"), out, options
        ).execute()
        store = spark.read.parquet(f"{out}/sorted_alignments")
        depth = spark.read.parquet(f"{out}/depth").selectExpr("sum((end - start) * depth)")
        report = spark.read.json(f"{out}/reports/run").filter("stage = 'run'").first()
        found[kind] = (store.count(), store.filter("flag & 4 <> 0").count(), depth.first()[0])
        assert report.pipeline_type == kind
    assert found == {"hybrid": (40, 0, 3200), "classic": (42, 2, 3200)}
    with pytest.raises(ValueError):
        Run(spark, "r", "f", "i", "o", Options(pipeline="other"))


def test_one_bad_sample_in_each_stage(spark, files, tmp_path):
    folder, _, _ = files
    reads = tmp_path / "reads"
    reads.mkdir()
    for sample in ("fine", "nosequence", "outside"):
        for mate in (1, 2):
            own = (folder / "reads" / f"B_{mate}.fastq").read_text().splitlines()[:80]
            if sample == "nosequence":
                own[1] = own[1][:-1] + "?"
            (reads / f"{sample}_{mate}.fastq").write_text("\n".join(own) + "\n")

    class Moved(Run):
        """A run whose alignments of one sample are spoilt before the next stage."""

        def process_alignments(self):
            placed = self.load("alignments")
            spoilt = placed.sample_id == "outside"
            moved = placed.withColumn("pos0", F.when(spoilt, placed.pos0 + 10**6).otherwise(placed.pos0))
            rows = spark.createDataFrame(moved.collect(), placed.schema)
            self.save(rows, "alignments")
            super().process_alignments()

    run = Moved(
        spark, str(reads), str(folder / "ref.fa"), str(folder / "ref.fa.fai"), str(tmp_path / "out")
    )
    run.execute()
    bad = run.ledger().filter("status = 'error'").select("stage", "sample_id", "error").collect()
    assert sorted((r.stage, r.sample_id, r.error.split(":")[0]) for r in bad) == [
        ("alignment", "nosequence", "read that is no sequence"),
        ("sam_processing", "outside", "record outside the contigs"),
    ]
    assert [r.sample_id for r in run.successes("coverage").collect()] == ["fine"]
    assert {r.sample_id for r in run.load("depth").collect()} == {"fine"}
