"""Every operator as a query over the testbed views."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline import testbed
from strandline.functions.alignment import depth_class
from strandline.operators import accounting, alignments, depth, placement, reads
from strandline.operators.ordering import numbered
from strandline.plans.run import Run
from strandline.plans.storage import scratch_path, stored
from strandline.schemas import ALIGNMENTS
from strandline.sources import fasta, fastq, fastq_source, manifest, sam, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ALIGNMENT_COLUMNS = (
    "sample_id",
    "qname",
    "flag",
    "chrom",
    "pos0",
    "mapq",
    "cigar",
    "rnext",
    "seq",
    "ordinal",
)
PLACE = ("sample_id", "chrom", "pos0", "ordinal", "place")
SEED = 20
MAX_MISMATCHES = 2


def query(function: Query) -> Query:
    QUERIES[function.__name__.rstrip("_")] = function
    return function


def rounded(frame: DataFrame, *names: str) -> DataFrame:
    return frame.withColumns({name: F.round(name, 6) for name in names})


def _alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testbed.view(spark, sf_dir, "alignments").select(*ALIGNMENT_COLUMNS)


def _depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depth.genome_depth(_alignments(spark, sf_dir))


# Depth


@query
def depth_(spark, sf_dir):
    return _depth(spark, sf_dir)


@query
def depth_labels(spark, sf_dir):
    return _depth(spark, sf_dir).withColumn("label", depth_class(F.col("depth")))


@query
def bed_sort(spark, sf_dir):
    return depth.bed_sort(_depth(spark, sf_dir))


@query
def depth_stats(spark, sf_dir):
    return rounded(
        depth.depth_stats(_depth(spark, sf_dir)),
        "mean_coverage",
        "median_coverage",
        "std_coverage",
        "weighted_mean_depth",
    )


@query
def depth_stats_filled(spark, sf_dir):
    # regions stand for samples without any alignment
    regions = spark.read.parquet(f"{sf_dir}/region.parquet")
    everyone = _alignments(spark, sf_dir).select("sample_id").union(regions.select("r_name"))
    return rounded(
        depth.depth_stats_filled(_depth(spark, sf_dir), everyone),
        "mean_coverage",
        "median_coverage",
    )


@query
def depth_stats_text(spark, sf_dir):
    text = depth.depth_report(_depth(spark, sf_dir))
    figures = text.select("sample_id", F.explode("stats").alias("name", "value"))
    # the last digit of a root may differ between engines
    root = F.format_string("%.9f", F.col("value").cast("double"))
    rounded_root = F.when(F.col("name") == "std_coverage", root).otherwise(F.col("value"))
    return figures.select("sample_id", "name", rounded_root.alias("value"))


@query
def depth_classes(spark, sf_dir):
    return depth.depth_classes(_depth(spark, sf_dir))


@query
def depth_windows(spark, sf_dir):
    return rounded(depth.depth_windows(_depth(spark, sf_dir)), "mean_depth")


@query
def depth_windows_all(spark, sf_dir):
    sizes = testbed.view(spark, sf_dir, "chrom_sizes")
    samples = _alignments(spark, sf_dir).select("sample_id")
    windows = depth.depth_windows(_depth(spark, sf_dir), 700, sizes, samples)
    return rounded(windows, "mean_depth")


@query
def signal_levels(spark, sf_dir):
    return depth.signal_levels(_depth(spark, sf_dir))


@query
def known_contigs(spark, sf_dir):
    sizes = testbed.view(spark, sf_dir, "chrom_sizes")
    return depth.on_known_contigs(_depth(spark, sf_dir), sizes)


@query
def unknown_contigs(spark, sf_dir):
    sizes = testbed.view(spark, sf_dir, "chrom_sizes")
    return depth.on_unknown_contigs(_depth(spark, sf_dir), sizes)


# Alignments


@query
def flagstat(spark, sf_dir):
    return rounded(alignments.flagstat(_alignments(spark, sf_dir)), "mapping_rate")


@query
def alignment_stats(spark, sf_dir):
    return rounded(
        alignments.alignment_stats(_alignments(spark, sf_dir), 20),
        "mapping_rate",
        "filter_rate",
        "average_mapping_quality",
    )


@query
def alignment_stats_dedup(spark, sf_dir):
    return rounded(
        alignments.alignment_stats(
            _alignments(spark, sf_dir), 20, True, testbed.RECORD_ORDER
        ),
        "mapping_rate",
        "filter_rate",
        "average_mapping_quality",
    )


@query
def mapped_filter(spark, sf_dir):
    return alignments.mapped_only(_alignments(spark, sf_dir))


@query
def mapq_filter(spark, sf_dir):
    return alignments.min_mapq(_alignments(spark, sf_dir), 20)


@query
def dedup(spark, sf_dir):
    return alignments.remove_duplicates(
        _alignments(spark, sf_dir), testbed.RECORD_ORDER
    )


@query
def filtered_alignments(spark, sf_dir):
    return alignments.filter_alignments(
        _alignments(spark, sf_dir), 20, True, testbed.RECORD_ORDER
    )


@query
def coordinate_sort(spark, sf_dir):
    return alignments.coordinate_sort(_alignments(spark, sf_dir))


@query
def coordinate_sort_header(spark, sf_dir):
    sizes = testbed.view(spark, sf_dir, "chrom_sizes")
    return alignments.coordinate_sort(_alignments(spark, sf_dir), sizes, "header")


# Orders: each record's place


@query
def coordinate_order(spark, sf_dir):
    return numbered(alignments.coordinate_sort(_alignments(spark, sf_dir))).select(*PLACE)


@query
def coordinate_order_header(spark, sf_dir):
    sizes = testbed.view(spark, sf_dir, "chrom_sizes")
    found = alignments.coordinate_sort(_alignments(spark, sf_dir), sizes, "header")
    return numbered(found).select(*PLACE)


@query
def bed_order(spark, sf_dir):
    return numbered(depth.bed_sort(_depth(spark, sf_dir)))


# Reads


@query
def read_qc(spark, sf_dir):
    return rounded(
        reads.read_qc(testbed.view(spark, sf_dir, "reads")),
        "q20_rate",
        "q30_rate",
        "gc_rate",
        "mean_length",
    )


@query
def quality_filter(spark, sf_dir):
    return reads.quality_filter(testbed.view(spark, sf_dir, "reads"))


@query
def mean_quality_filter(spark, sf_dir):
    return reads.mean_quality_filter(testbed.view(spark, sf_dir, "reads"))


@query
def length_filter(spark, sf_dir):
    return reads.length_filter(testbed.view(spark, sf_dir, "reads"))


@query
def filter_reasons(spark, sf_dir):
    return reads.filter_reasons(testbed.view(spark, sf_dir, "reads"))


@query
def tail_trim(spark, sf_dir):
    return reads.tail_trim(testbed.view(spark, sf_dir, "reads"))


@query
def cycle_profile(spark, sf_dir):
    return rounded(
        reads.cycle_profile(testbed.view(spark, sf_dir, "reads")), "mean_quality"
    )


@query
def mate_join(spark, sf_dir):
    return reads.mate_join(testbed.view(spark, sf_dir, "mates"))


@query
def orphans(spark, sf_dir):
    return manifest.orphans(
        testbed.view(spark, sf_dir, "r1_files"), testbed.view(spark, sf_dir, "r2_files")
    )


@query
def paired_files(spark, sf_dir):
    return manifest.paired(
        testbed.view(spark, sf_dir, "r1_files"), testbed.view(spark, sf_dir, "r2_files")
    )


@query
def pair_overlap_trim(spark, sf_dir):
    return reads.pair_overlap_trim(testbed.view(spark, sf_dir, "read_pairs"))


@query
def pair_verdicts(spark, sf_dir):
    labelled = reads.clean_pairs(testbed.view(spark, sf_dir, "read_pairs"))
    return labelled.groupBy("sample_id", "verdict").agg(F.count("*").alias("pairs"))


@query
def insert_size(spark, sf_dir):
    return reads.insert_sizes(
        reads.find_overlap(testbed.view(spark, sf_dir, "read_pairs"))
    )


@query
def duplication(spark, sf_dir):
    return reads.duplication_levels(testbed.view(spark, sf_dir, "read_pairs"))


@query
def duplication_rate(spark, sf_dir):
    return rounded(
        reads.duplication_rate(testbed.view(spark, sf_dir, "read_pairs")),
        "duplication_rate",
    )


# Placement, over stored reads and contigs as in a staged run


def _stored_view(spark, sf_dir, name):
    return stored(testbed.view(spark, sf_dir, name), name)


def _tiles(spark, sf_dir, margin):
    contigs = _stored_view(spark, sf_dir, "contigs")
    return placement.reference_tiles(contigs, margin=margin)


def _placeable(spark, sf_dir, name):
    """Reads, tiles that reach as far as the longest of them, and that margin."""
    found = _stored_view(spark, sf_dir, name)
    margin = placement.longest_read(found)
    return found, _tiles(spark, sf_dir, margin), margin


@query
def exact_placement(spark, sf_dir):
    found, tiles, margin = _placeable(spark, sf_dir, "reads")
    return placement.exact_placement(found, tiles, margin=margin)


@query
def approx_placement(spark, sf_dir):
    mates, tiles, margin = _placeable(spark, sf_dir, "mates")
    return placement.approximate_placement(
        mates, tiles, MAX_MISMATCHES, k=SEED, margin=margin
    ).drop("best")


@query
def best_placement(spark, sf_dir):
    mates, tiles, margin = _placeable(spark, sf_dir, "mates")
    return placement.best_placement(mates, tiles, MAX_MISMATCHES, k=SEED, margin=margin)


# Accounting


@query
def stage_accounting(spark, sf_dir):
    return accounting.stage_accounting(testbed.view(spark, sf_dir, "ledger"))


@query
def status_breakdown(spark, sf_dir):
    return accounting.status_breakdown(testbed.view(spark, sf_dir, "ledger"))


@query
def successful_samples(spark, sf_dir):
    return accounting.successful(testbed.view(spark, sf_dir, "ledger"))


@query
def stage_results(spark, sf_dir):
    samples = accounting.with_stage_result(
        testbed.view(spark, sf_dir, "ledger").drop("stage"),
        "result",
        status=F.col("status"),
        reference=F.lit("ref.fa"),
    )
    return accounting.successful(samples.drop("status"), "result").select(
        "sample_id", "result.status", "result.reference"
    )


# Files: each query writes a table in a sequencing format and reads it back


@query
def fastq_round_trip(spark, sf_dir):
    path = scratch_path(spark, "fastq")
    fastq.write_fastq(testbed.view(spark, sf_dir, "mates"), path)
    return fastq.read_fastq(fastq.written_files(spark, path), 4 << 20).drop("ordinal")


@query
def sam_round_trip(spark, sf_dir):
    path = scratch_path(spark, "sam")
    records = testbed.view(spark, sf_dir, "alignments")
    sam.write_sam(
        records.withColumns(
            {
                "pnext0": F.col("pos0") + 7,
                "tlen": F.lit(0),
                "qual": F.lit("*"),
                "tags": F.create_map(F.lit("NM"), F.concat(F.lit("i:"), "seq")),
            }
        ),
        path,
    )
    return (
        sam.read_sam(spark, f"{path}/records")
        .withColumn("nm", F.col("tags")["NM"])
        .drop("tags", "ordinal", "qual", "tlen")
    )


@query
def alignment_store_region(spark, sf_dir):
    path = scratch_path(spark, "store")
    records = testbed.view(spark, sf_dir, "alignments").to(ALIGNMENTS)
    sam.write_alignment_store(records, path)
    stored_records = sam.read_alignment_store(spark, path)
    return sam.region(stored_records, "chr2", 200, 6000).select(*ALIGNMENT_COLUMNS)


@query
def alignment_store_overlaps(spark, sf_dir):
    path = scratch_path(spark, "store")
    records = testbed.view(spark, sf_dir, "alignments").to(ALIGNMENTS)
    sam.write_alignment_store(records, path)
    return sam.stored_overlaps(spark, path, "chr2", 230, 6000).select(*ALIGNMENT_COLUMNS)


@query
def bedgraph_round_trip(spark, sf_dir):
    path = scratch_path(spark, "bedgraph")
    tables.write_bedgraph(_depth(spark, sf_dir), path)
    return tables.read_bedgraph(spark, path)


@query
def signal_store_level(spark, sf_dir):
    path = scratch_path(spark, "signal")
    tables.write_signal(depth.signal_levels(_depth(spark, sf_dir)), path)
    return spark.read.parquet(path).filter("chrom = 'chr3' and level = 2")


@query
def fasta_round_trip(spark, sf_dir):
    path = scratch_path(spark, "fasta")
    testbed.write_fasta(testbed.view(spark, sf_dir, "contigs"), path)
    return fasta.read_fasta(spark, path).drop("chrom_idx")


@query
def fai_round_trip(spark, sf_dir):
    path = scratch_path(spark, "fai")
    testbed.write_fai(testbed.view(spark, sf_dir, "contigs"), path)
    return fasta.read_fai(spark, path).drop("chrom_idx")


@query
def flagstat_parse(spark, sf_dir):
    path = scratch_path(spark, "flagstat")
    stats = alignments.flagstat(_alignments(spark, sf_dir))
    tables.flagstat_lines(stats).write.partitionBy("sample_id").text(path)
    sample = F.regexp_extract("file", "sample_id=([^/]*)/", 1)
    return rounded(
        tables.read_flagstat(spark, path).withColumn("sample_id", sample).drop("file"),
        "mapping_rate",
    )


# From placement to depth, as a run does it


@query
def placed_flagstat(spark, sf_dir):
    return rounded(alignments.flagstat(_placed(spark, sf_dir)), "mapping_rate")


@query
def placed_depth_stats(spark, sf_dir):
    return rounded(
        depth.depth_stats(depth.genome_depth(_placed(spark, sf_dir))),
        "mean_coverage",
        "median_coverage",
        "std_coverage",
        "weighted_mean_depth",
    )


def _placed(spark, sf_dir):
    mates, tiles, margin = _placeable(spark, sf_dir, "mates")
    placed = placement.best_placement(mates, tiles, MAX_MISMATCHES, k=SEED, margin=margin)
    return stored(placement.placed_alignments(mates, placed))


# Files of paired reads, and a whole run over them


@query
def file_manifest(spark, sf_dir):
    folder = scratch_path(spark, "input")
    testbed.write_run_input(spark, sf_dir, folder)
    paired = manifest.with_sizes_in_mb(manifest.fastq_manifest(spark, f"{folder}/reads"))
    alone = manifest.fastq_orphans(spark, f"{folder}/reads")
    found = paired.unionByName(alone, allowMissingColumns=True)
    names = {
        f"r{mate}_path": F.regexp_extract(f"r{mate}_path", "[^/]*$", 0) for mate in (1, 2)
    }
    return found.withColumns(names)


@query
def fastq_format(spark, sf_dir):
    folder = scratch_path(spark, "input")
    testbed.write_run_input(spark, sf_dir, folder)
    fastq_source.register(spark)
    found = spark.read.format("fastq").option("split_bytes", 1 << 20).load(f"{folder}/reads")
    return found.filter("mate = 2").drop("ordinal")


@query
def run_ledger(spark, sf_dir):
    folder = scratch_path(spark, "run")
    testbed.write_run_input(spark, sf_dir, folder)
    run = Run(spark, f"{folder}/reads", f"{folder}/ref.fa", f"{folder}/ref.fa.fai", f"{folder}/out")
    run.execute()
    products = {
        "preprocessing": run.load("reads_clean"),
        "alignment": run.load("alignments"),
        "sam_processing": sam.read_alignment_store(spark, run.path("sorted_alignments")),
        "coverage": run.load("depth"),
    }
    amounts = None
    for stage, product in products.items():
        amount = F.sum(F.col("end") - F.col("start")) if stage == "coverage" else F.count("*")
        each = product.groupBy("sample_id").agg(amount.alias("amount"))
        each = each.withColumn("stage", F.lit(stage))
        amounts = each if amounts is None else amounts.unionByName(each)
    ledger = run.ledger().join(amounts, ["stage", "sample_id"], "left")
    report = spark.read.json(run.path("reports/run"))
    counts = report.select("stage", "success_count", "total_count")
    samples = ledger.join(counts, "stage").select(
        "stage",
        "sample_id",
        "status",
        F.split("error", ":")[0].alias("error"),
        F.coalesce("amount", F.lit(0)).alias("amount"),
        "success_count",
        "total_count",
    )
    whole = report.filter("stage = 'run'").select("stage", "status", "pipeline_type")
    return samples.unionByName(whole, allowMissingColumns=True)


@query
def json_reports(spark, sf_dir):
    path = scratch_path(spark, "reports")
    stats = alignments.alignment_stats(_alignments(spark, sf_dir), 20)
    tables.write_json(stats, path, by_sample=True)
    return rounded(
        spark.read.schema(stats.schema).json(path),
        "mapping_rate",
        "filter_rate",
        "average_mapping_quality",
    )
