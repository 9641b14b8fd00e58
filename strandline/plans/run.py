"""The staged run: paired FASTQ files to depth, with a ledger row per sample.

Each stage writes its table before the next one reads it, which cuts lineage where
the data shrinks and lets a failed run be inspected.  The session is the caller's;
nothing here sets masters, memory or executors.
"""

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandline.functions.alignment import reference_length
from strandline.operators import accounting, alignments, depth, placement, reads
from strandline.schemas import LEDGER
from strandline.sources import fasta, fastq, manifest, sam, tables

PREPROCESSING = "preprocessing"
ALIGNMENT = "alignment"
SAM_PROCESSING = "sam_processing"
COVERAGE = "coverage"
PIPELINE = "run"

#: What the alignment store keeps: records that pass the filters, or all as they are.
HYBRID, CLASSIC = "hybrid", "classic"

RAW = ("seq1", "qual1", "seq2", "qual2")


@dataclass(frozen=True)
class Options:
    """Parameters of a run; the defaults are those of the original tools.

    A ``pipeline`` of the type ``classic`` stores all alignments in order, unmapped ones too, and
    filters none; its depth counts all that are mapped.
    """

    pipeline: str = HYBRID
    mapq_threshold: int = 0
    remove_duplicates: bool = False
    contig_order: str = "header"
    window_size: int = 1000
    signal_levels: int = 5
    max_mismatches: int = 2
    seed_length: int = 16
    trim_tails: bool = False
    read_limits: dict = field(default_factory=dict)
    write_fastq: bool = False
    write_sam: bool = False


class Run:
    """One run over a folder of paired FASTQ files."""

    def __init__(
        self,
        spark: SparkSession,
        reads_dir: str,
        reference: str,
        index: str,
        output: str,
        options: Options = Options(),
    ):
        self.spark = spark
        self.reads_dir = reads_dir
        self.reference = reference
        self.index = index
        self.output = output.rstrip("/")
        if options.pipeline not in (HYBRID, CLASSIC):
            raise ValueError(f"a pipeline of the type {options.pipeline}")
        self.options = options
        self.run_id = uuid.uuid4().hex
        self.started_at = None

    # Tables of the run

    def path(self, name: str) -> str:
        return f"{self.output}/{name}"

    def save(self, table: DataFrame, name: str) -> DataFrame:
        table.write.mode("overwrite").parquet(self.path(name))
        return self.load(name)

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def ledger(self) -> DataFrame:
        """The rows of this run; a folder may hold other runs' too."""
        rows = self.spark.read.schema(LEDGER).parquet(self.path("ledger"))
        return rows.filter(F.col("run_id") == self.run_id)

    def record(
        self, stage: str, samples: DataFrame, status: Column, error: Column, begun: float
    ) -> None:
        """Write the ledger rows of one stage."""
        rows = samples.select(
            F.lit(self.run_id).alias("run_id"),
            F.lit(stage).alias("stage"),
            "sample_id",
            status.alias("status"),
            error.alias("error"),
            F.timestamp_micros(F.lit(int(begun * 1e6))).alias("started_at"),
            F.lit(time.time() - begun).alias("execution_time"),
        )
        place = f"{self.path('ledger')}/run_id={self.run_id}/stage={stage}"
        rows.drop("run_id", "stage").write.mode("overwrite").parquet(place)

    def successes(self, stage: str) -> DataFrame:
        return accounting.successful(
            self.ledger().filter(F.col("stage") == stage)
        ).select("sample_id")

    def record_error(self, stage: str, error: str, begun: float) -> None:
        """Ledger rows for the samples that reached a stage that broke off."""
        previous = {
            ALIGNMENT: PREPROCESSING,
            SAM_PROCESSING: ALIGNMENT,
            COVERAGE: SAM_PROCESSING,
        }
        if stage in previous:
            self.record(
                stage,
                self.successes(previous[stage]),
                F.lit(accounting.ERROR),
                F.lit(error),
                begun,
            )

    # The stages

    def execute(self) -> DataFrame:
        """Run all stages; returns stage accounting.  Failures are recorded, then raised."""
        self.started_at = time.time()
        status, error = "completed", None
        stages: list[tuple[str, Callable[[], None]]] = [
            (PREPROCESSING, self.preprocess),
            (ALIGNMENT, self.align),
            (SAM_PROCESSING, self.process_alignments),
            (COVERAGE, self.cover),
        ]
        name, begun = None, self.started_at
        try:
            for name, stage in stages:
                begun = time.time()
                stage()
                if name != COVERAGE and self.successes(name).isEmpty():
                    status, error = "stopped", f"no sample passed {name}"
                    break
        except Exception as reason:
            status, error = "failed", str(reason)
            self.record_error(name, error, begun)
            raise
        finally:
            self.finish(status, error)
        return accounting.stage_accounting(self.ledger())

    def finish(self, status: str, error: str | None) -> None:
        """Write the run report: one row for the run, one per stage reached."""
        end = time.time()
        summary = self.spark.range(1).select(
            F.lit(PIPELINE).alias("stage"),
            F.lit(self.options.pipeline).alias("pipeline_type"),
            F.lit(status).alias("status"),
            F.lit(error).cast("string").alias("error"),
            F.lit(_iso(self.started_at)).alias("start_time"),
            F.lit(_iso(end)).alias("end_time"),
            F.lit(end - self.started_at).alias("execution_time"),
        )
        try:
            per_stage = accounting.stage_accounting(self.ledger())
            breakdown = accounting.status_breakdown(self.ledger())
            summary = summary.unionByName(per_stage, allowMissingColumns=True)
            tables.write_json(breakdown, self.path("reports/status_breakdown"))
        except AnalysisException as reason:
            # No stage has written a ledger yet, so the run row stands alone.
            if status != "failed" or reason.getCondition() != "PATH_NOT_FOUND":
                raise
        tables.write_json(summary, self.path("reports/run"))

    def preprocess(self) -> None:
        """Pair files, read them, find overlaps, label every pair."""
        begun = time.time()
        samples = manifest.fastq_manifest(self.spark, self.reads_dir)
        if samples.isEmpty():
            raise ValueError(f"no pair of FASTQ files in {self.reads_dir}")
        samples = self.save(manifest.with_sizes_in_mb(samples), "manifest")
        files = fastq.mate_files(samples)
        # Pairs keep their raw sequences, and what could not be paired stays as
        # rows with an error, so the files are parsed once.
        joined = reads.pair_by_record(
            fastq.read_fastq(files.filter(F.col("mate") == 1)),
            fastq.read_fastq(files.filter(F.col("mate") == 2)),
        )
        raw = {f"raw_{name}": F.col(name) for name in RAW}
        pairs = self.save(
            reads.clean_pairs(
                joined.withColumns(raw),
                self.options.trim_tails,
                **self.options.read_limits,
            ),
            "labelled_pairs",
        )
        broken = self.save(fastq.failed_samples(pairs), "broken_samples")
        kept = pairs.filter(
            F.col("error").isNull() & (F.col("verdict") == "passed")
        ).join(broken, "sample_id", "left_anti")
        clean = self.save(reads.split_pairs(kept), "reads_clean")
        if self.options.write_fastq:
            fastq.write_fastq(clean, self.path("trimmed"))

        report = self.path("reports")
        sound = pairs.filter(F.col("error").isNull())
        untouched = sound.drop(*RAW).withColumnsRenamed(
            {f"raw_{name}": name for name in RAW}
        )
        before = reads.split_pairs(untouched)
        quality = (
            reads.read_qc(before)
            .withColumn("phase", F.lit("before"))
            .unionByName(reads.read_qc(clean).withColumn("phase", F.lit("after")))
        )
        verdicts = sound.groupBy("sample_id", "verdict").agg(F.count("*").alias("pairs"))
        names = sound.groupBy("sample_id").agg(
            F.count("*").alias("pairs"), F.count_if("names_differ").alias("names_differ")
        )
        tables.write_json(names, f"{report}/pairing")
        tables.write_json(quality, f"{report}/read_quality")
        tables.write_json(verdicts, f"{report}/filtering")
        tables.write_json(reads.cycle_profile(clean), f"{report}/cycles")
        tables.write_json(reads.insert_sizes(sound), f"{report}/insert_sizes")
        tables.write_json(
            reads.duplication_rate(untouched), f"{report}/duplication"
        )

        unpaired = manifest.fastq_orphans(self.spark, self.reads_dir).select(
            "sample_id", "r1_path", "r1_bytes", F.lit("no file of mate 2").alias("error")
        )
        status = (
            self.load("manifest")
            .join(broken, "sample_id", "left")
            .unionByName(unpaired, allowMissingColumns=True)
        )
        failed = F.col("error").isNotNull()
        outcome = F.when(failed, accounting.FAILED).otherwise(accounting.SUCCESS)
        result = accounting.with_stage_result(
            status, "preprocessing_result", status=outcome, error=F.col("error")
        ).drop("error")
        self.save(result, "preprocessed_results")
        self.record(PREPROCESSING, status, outcome, F.col("error"), begun)

    def _finish_stage(
        self, name: str, begun: float, previous: str, broken: DataFrame | None = None
    ) -> None:
        """Ledger rows of all samples that reached a stage; ``broken`` ones have an error."""
        samples = self.successes(previous).withColumn("error", F.lit(None).cast("string"))
        if broken is not None:
            samples = samples.drop("error").join(broken, "sample_id", "left")
        failed = F.col("error").isNotNull()
        status = F.when(failed, accounting.ERROR).otherwise(accounting.SUCCESS)
        self.record(name, samples, status, F.col("error"), begun)

    def _sound(self, table: DataFrame, fault: Column, stage: str) -> tuple[DataFrame, DataFrame]:
        """The rows of samples without a faulty row, and the other samples with one complaint.

        ``fault`` is null for a sound row. The complaints are a small table of their own, which
        takes the samples out of what goes on and is what the ledger says of them.
        """
        broken = self.save(
            table.select("sample_id", fault.alias("error"))
            .filter("error is not null")
            .groupBy("sample_id")
            .agg(F.min("error").alias("error")),
            f"errors/{stage}",
        )
        return table.join(broken, "sample_id", "left_anti").select(*table.columns), broken

    def align(self) -> None:
        """Best placement of every clean read, as alignment records.

        A sample with a read that isn't letters, or whose qualities don't fit, has an error.
        """
        begun = time.time()
        odd = F.col("seq").rlike("[^A-Za-z]") | (F.length("seq") != F.length("qual"))
        fault = F.when(odd, F.concat(F.lit("read that is no sequence: "), "read_id"))
        clean, broken = self._sound(self.load("reads_clean"), fault, ALIGNMENT)
        margin = placement.longest_read(clean)
        tiles = fasta.read_fasta_tiles(
            self.spark, self.reference, self.index, margin=margin
        )
        placed = placement.best_placement(
            clean,
            tiles,
            self.options.max_mismatches,
            k=self.options.seed_length,
            margin=margin,
        )
        records = placement.placed_alignments(clean, placed, by_ordinal=True)
        self.save(records, "alignments")
        self._finish_stage(ALIGNMENT, begun, PREPROCESSING, broken)

    def process_alignments(self) -> None:
        """Filter, order and count the alignments.

        A sample with a record outside the contigs of the index, or whose CIGAR can't be read,
        has an error.
        """
        begun = time.time()
        options = self.options
        sizes = fasta.read_fai(self.spark, self.index)
        records, broken = self._records(sizes)
        kept = records
        if options.pipeline == HYBRID:
            kept = alignments.filter_alignments(
                records, options.mapq_threshold, options.remove_duplicates
            )
        sam.write_alignment_store(kept, self.path("sorted_alignments"))
        if options.write_sam:
            sam.write_sam(
                alignments.coordinate_sort(records, sizes, options.contig_order),
                self.path("sam"),
                sizes,
            )
        stats = alignments.alignment_stats(
            records, options.mapq_threshold, options.remove_duplicates
        )
        tables.write_json(stats, self.path("reports/alignment_stats"), by_sample=True)
        tables.write_json(alignments.flagstat(records), self.path("reports/flagstat"))
        self._finish_stage(SAM_PROCESSING, begun, ALIGNMENT, broken)

    def _records(self, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
        placed = self.load("alignments")
        ends = sizes.select("chrom", F.col("length").alias("contig_end"))
        end = F.col("pos0") + reference_length(F.col("cigar"))
        unknown = F.col("contig_end").isNull() | (F.col("pos0") < 0) | (end > F.col("contig_end"))
        fault = F.when(F.col("chrom").isNull(), None).otherwise(
            F.when(~F.col("cigar").rlike(r"^(\*|(\d+[MIDNSHPX=])+)$"), F.lit("unreadable CIGAR: "))
            .when(unknown, F.lit("record outside the contigs: "))
        )
        checked = placed.join(ends, "chrom", "left")
        broken = self._sound(checked, F.concat(fault, "qname"), SAM_PROCESSING)[1]
        return placed.join(broken, "sample_id", "left_anti").select(*placed.columns), broken

    def cover(self) -> None:
        """Depth, its statistics, windows and signal levels."""
        begun = time.time()
        options = self.options
        records = sam.read_alignment_store(self.spark, self.path("sorted_alignments"))
        runs = self.save(depth.genome_depth(records), "depth")
        sizes = fasta.read_fai(self.spark, self.index)
        known = depth.on_known_contigs(runs, sizes)
        reached = self.successes(SAM_PROCESSING)
        tables.write_bedgraph(runs, self.path("coverage"))
        windows = depth.depth_windows(runs, options.window_size, sizes, reached)
        self.save(windows, "windows")
        tables.write_json(
            depth.on_unknown_contigs(runs, sizes), self.path("reports/outside_contigs")
        )
        tables.write_signal(
            depth.signal_levels(known, options.window_size, levels=options.signal_levels),
            self.path("signal"),
        )
        tables.write_json(
            depth.depth_report(runs, reached), self.path("reports/depth"), by_sample=True
        )
        tables.write_json(
            depth.depth_stats(runs, reached), self.path("reports/depth_stats")
        )
        tables.write_json(depth.depth_classes(runs), self.path("reports/depth_classes"))
        self._finish_stage(COVERAGE, begun, SAM_PROCESSING)


def _iso(seconds: float) -> str:
    return datetime.fromtimestamp(seconds, timezone.utc).isoformat()
