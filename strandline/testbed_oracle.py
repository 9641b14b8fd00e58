"""The testbed queries as SQL for an independent engine."""

from strandline.testbed import NO_FILE, NO_LETTERS, NO_PARTNER, with_views
from strandline.testbed_queries import ALIGNMENT_COLUMNS, MAX_MISMATCHES, SEED

_RECORD = ", ".join(ALIGNMENT_COLUMNS)
_ORDER = "ordinal, flag, mapq, cigar, rnext"

_DEPTH = """
depth AS (
    SELECT sample_id, chrom, "start", "end", depth FROM (
        SELECT sample_id, chrom, pos AS "start",
               lead(pos) OVER (PARTITION BY sample_id, chrom ORDER BY pos) AS "end",
               CAST(sum(step) OVER (PARTITION BY sample_id, chrom ORDER BY pos
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS depth
        FROM (SELECT sample_id, chrom, pos, sum(step) AS step
              FROM (SELECT sample_id, chrom, pos0 AS pos, 1 AS step FROM alignments
                    WHERE flag & 4 = 0
                    UNION ALL
                    SELECT sample_id, chrom, pos0 + span, -1 FROM alignments
                    WHERE flag & 4 = 0)
              GROUP BY sample_id, chrom, pos HAVING sum(step) <> 0))
    WHERE depth > 0)"""


def _over_depth(select: str, *views: str, ctes: str = "") -> str:
    return with_views(f", {_DEPTH.strip()}{ctes}\n{select}", "alignments", *views)


def _windows(width: int) -> str:
    return f"""
        SELECT sample_id, chrom, w AS window_idx,
               least("end", (w + 1) * {width}) - greatest("start", w * {width}) AS bases,
               depth
        FROM (SELECT *, unnest(range("start" // {width}, ("end" - 1) // {width} + 1)) AS w
              FROM depth)"""


_DEPTH_STATS = """
        SELECT sample_id, CAST(count(*) AS BIGINT) AS total_regions,
               round(avg(depth), 6) AS mean_coverage,
               round(median(depth), 6) AS median_coverage,
               max(depth) AS max_coverage, min(depth) AS min_coverage,
               round(stddev_samp(depth), 6) AS std_coverage,
               CAST(sum(depth) AS BIGINT) AS total_bases_covered,
               CAST(count(*) FILTER (WHERE depth > 0) AS BIGINT) AS bases_with_coverage,
               CAST(sum("end" - "start") AS BIGINT) AS covered_bases,
               round(CAST(sum(depth * ("end" - "start")) AS DOUBLE)
                     / CAST(sum("end" - "start") AS DOUBLE), 6) AS weighted_mean_depth
        FROM depth GROUP BY sample_id"""

_FLAG_FIGURES = {
    "total_reads": "true",
    "mapped_reads": "flag & 4 = 0",
    "paired_reads": "flag & 2305 = 1",
    "properly_paired": "flag & 2311 = 3",
    "both_mapped": "flag & 2317 = 1",
    "singletons": "flag & 2317 = 9",
    "different_chr": "flag & 2317 = 1 AND rnext <> chrom",
    "different_chr_mapq5": "flag & 2317 = 1 AND rnext <> chrom AND mapq >= 5",
}

_PHRED_SUM = "list_sum(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33))"


def _count_quality(test: str, qual: str = "qual") -> str:
    return (
        f"CAST(len(list_filter(string_split({qual}, ''), "
        f"lambda c: ascii(c) - 33 {test})) AS BIGINT)"
    )


def _verdict(seq: str, qual: str) -> str:
    n_bases = f"length({seq}) - length(replace({seq}, 'N', ''))"
    return f"""CASE WHEN {_count_quality('< 15', qual)} * 100 > length({seq}) * 40
                        THEN 'low_quality'
                    WHEN {n_bases} > 5 THEN 'too_many_n'
                    WHEN length({seq}) < 15 THEN 'too_short'
                    ELSE 'passed' END"""


# For each pair: offsets 0, 1, ... and then -1, -2, ...; the first good one wins.
_OVERLAP = """
offsets AS (
    SELECT *, unnest(range(30 - length(seq2), length(seq1) - 29)) AS s,
           reverse(translate(seq2, 'ACGT', 'TGCA')) AS rc2
    FROM read_pairs),
overlapping AS (
    SELECT sample_id, read_id, s, n
    FROM (SELECT sample_id, read_id, s, n,
                 hamming(substr(seq1, CAST(greatest(0, s) + 1 AS INTEGER), CAST(n AS INTEGER)),
                         substr(rc2, CAST(greatest(0, -s) + 1 AS INTEGER), CAST(n AS INTEGER)))
                     AS differ
          FROM (SELECT *, least(length(seq1), s + length(rc2)) - greatest(0, s) AS n
                FROM offsets)
          WHERE n >= 30)
    WHERE differ <= 5 AND differ * 100 <= n * 20),
chosen AS (
    SELECT sample_id, read_id,
           CAST(arg_min(s, CASE WHEN s >= 0 THEN s ELSE 1000000 - s END) AS INTEGER)
               AS overlap_start
    FROM overlapping GROUP BY sample_id, read_id),
found AS (
    SELECT p.*, c.overlap_start,
           CASE WHEN c.overlap_start IS NOT NULL THEN
               CAST(least(length(seq1), overlap_start + length(seq2))
                    - greatest(0, overlap_start) AS INTEGER) END AS overlap_length,
           CAST(overlap_start + length(seq2) AS INTEGER) AS insert_length
    FROM read_pairs p LEFT JOIN chosen c USING (sample_id, read_id)),
trimmed AS (
    SELECT sample_id, read_id,
           coalesce(substr(seq1, 1, insert_length), seq1) AS seq1,
           coalesce(substr(qual1, 1, insert_length), qual1) AS qual1,
           coalesce(substr(seq2, 1, insert_length), seq2) AS seq2,
           coalesce(substr(qual2, 1, insert_length), qual2) AS qual2,
           overlap_start, overlap_length, insert_length
    FROM found)"""


def _over_pairs(select: str) -> str:
    return with_views(f", {_OVERLAP.strip()}\n{select}", "read_pairs")


# Contigs in pieces that overlap by the longest read, as a slice of a long text costs its length;
# and the first bases at every position, a row each, which all threads share.
_STEP = 1000


def _pieces(reads: str) -> str:
    return f"""
reach AS (SELECT max(length(seq)) AS reach FROM {reads}),
pieces AS MATERIALIZED (
    SELECT chrom_idx, chrom, length, i * {_STEP} AS start,
           substr(seq, CAST(i * {_STEP} + 1 AS INTEGER), CAST({_STEP} + reach AS INTEGER)) AS piece
    FROM (SELECT *, unnest(range(CAST(ceil(length / {_STEP}.0) AS BIGINT))) AS i FROM contigs),
         reach),
positions AS MATERIALIZED (
    SELECT chrom_idx, start, p, substr(piece, CAST(p + 1 AS INTEGER), {SEED}) AS ahead
    FROM (SELECT *, unnest(range(least({_STEP}, length(piece)))) AS p FROM pieces))"""


# All placements with few mismatches. Of m + 1 disjoint blocks of a read one is clean; reads of
# less than three bases a block meet all different windows of their length instead.
_LEAST = 3 * (MAX_MISMATCHES + 1)
_BLOCK = f"least({SEED}, length(q) // {MAX_MISMATCHES + 1})"
_PLACED = f"""
{_pieces("mates")},
queries AS (SELECT DISTINCT seq FROM mates WHERE length(seq) > 0),
oriented AS (
    SELECT seq, '+' AS strand, seq AS q FROM queries
    UNION ALL
    SELECT seq, '-', reverse(translate(seq, 'ACGT', 'TGCA')) FROM queries),
seeds AS (
    SELECT *, substr(q, CAST(b * {_BLOCK} + 1 AS INTEGER), CAST({_BLOCK} AS INTEGER)) AS kmer,
           {_BLOCK} AS size
    FROM (SELECT *, unnest(range({MAX_MISMATCHES + 1})) AS b FROM oriented
          WHERE length(q) >= {_LEAST})),
kmers AS (
    SELECT chrom_idx, start + p AS p, size, substr(ahead, 1, CAST(size AS INTEGER)) AS kmer
    FROM positions, (SELECT DISTINCT size FROM seeds) WHERE length(ahead) >= size),
proposed AS (
    SELECT DISTINCT s.seq, s.strand, s.q, k.chrom_idx, k.p - s.b * s.size AS pos0
    FROM seeds s JOIN kmers k USING (kmer, size)
    WHERE k.p >= s.b * s.size),
compared AS (
    SELECT o.seq, o.strand, c.chrom, o.chrom_idx, o.pos0,
           hamming(o.q, substr(piece, CAST(o.pos0 - start + 1 AS INTEGER), length(o.q))) AS mm
    FROM proposed o JOIN pieces c
        ON c.chrom_idx = o.chrom_idx AND c.start = o.pos0 // {_STEP} * {_STEP}
    WHERE o.pos0 + length(o.q) <= c.length),
windows AS (
    SELECT size, substr(ahead, 1, CAST(size AS INTEGER)) AS win, count(*) AS copies,
           min(struct_pack(i := chrom_idx, p := start + p)) AS first
    FROM positions, (SELECT DISTINCT length(seq) AS size FROM queries
                     WHERE length(seq) < {_LEAST})
    WHERE length(ahead) >= size GROUP BY ALL),
hits AS (
    SELECT seq, strand, chrom, chrom_idx, pos0, mm, 1 AS copies FROM compared
    WHERE mm <= {MAX_MISMATCHES}
    UNION ALL
    SELECT oriented.seq, strand, chrom, first.i, first.p, hamming(q, win), copies
    FROM oriented JOIN windows ON size = length(q) AND hamming(q, win) <= {MAX_MISMATCHES}
    JOIN contigs ON contigs.chrom_idx = first.i),
summed AS (
    SELECT seq,
           CAST(coalesce(sum(copies) FILTER (WHERE mm = 0), 0) AS BIGINT) AS hits_0,
           CAST(coalesce(sum(copies) FILTER (WHERE mm = 1), 0) AS BIGINT) AS hits_1,
           CAST(coalesce(sum(copies) FILTER (WHERE mm = 2), 0) AS BIGINT) AS hits_2
    FROM hits GROUP BY seq),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY seq
                                 ORDER BY mm, chrom_idx, pos0, strand) AS r
    FROM hits)"""


def _over_placed(select: str) -> str:
    return with_views(f", {_PLACED.strip()}\n{select}", "mates", "contigs")


ORACLE: dict[str, str] = {
    "depth": _over_depth("SELECT * FROM depth"),
    "depth_labels": _over_depth("""
        SELECT *, CASE WHEN depth < 1 THEN 'no_coverage' WHEN depth < 10 THEN 'low_coverage'
                       WHEN depth < 50 THEN 'medium_coverage'
                       WHEN depth < 100 THEN 'high_coverage'
                       ELSE 'very_high_coverage' END AS label
        FROM depth"""),
    "stage_results": with_views(
        """SELECT sample_id, status, 'ref.fa' AS reference FROM ledger
        WHERE status = 'success'""",
        "ledger",
    ),
    "bed_sort": _over_depth('SELECT * FROM depth ORDER BY sample_id, chrom, "start"'),
    "depth_stats": _over_depth(_DEPTH_STATS),
    "depth_stats_filled": _over_depth("""
        SELECT s.sample_id, CAST(count(depth) AS BIGINT) AS total_regions,
               CAST(coalesce(sum(depth), 0) AS BIGINT) AS total_bases_covered,
               round(coalesce(avg(depth), 0), 6) AS mean_coverage,
               round(coalesce(median(depth), 0), 6) AS median_coverage,
               coalesce(max(depth), 0) AS max_coverage,
               coalesce(min(depth), 0) AS min_coverage,
               CAST(count(depth) AS BIGINT) AS bases_with_coverage
        FROM (SELECT sample_id FROM alignments UNION SELECT r_name FROM region) s
        LEFT JOIN depth d USING (sample_id)
        GROUP BY s.sample_id"""),
    "depth_stats_text": _over_depth("""
        SELECT sample_id, name, value FROM (
            UNPIVOT (
                SELECT sample_id, CAST(count(*) AS VARCHAR) AS total_regions,
                       CAST(CAST(sum(depth) AS DOUBLE) / count(*) AS VARCHAR) AS mean_coverage,
                       CAST(CAST(median(depth) AS DOUBLE) AS VARCHAR) AS median_coverage,
                       printf('%.9f', stddev_samp(depth)) AS std_coverage,
                       CAST(CAST(max(depth) AS DOUBLE) AS VARCHAR) AS max_coverage,
                       CAST(CAST(min(depth) AS DOUBLE) AS VARCHAR) AS min_coverage,
                       CAST(CAST(sum(depth) AS BIGINT) AS VARCHAR) AS total_bases_covered,
                       CAST(count(*) FILTER (WHERE depth > 0) AS VARCHAR)
                           AS bases_with_coverage,
                       CAST(count(*) FILTER (WHERE depth < 1) AS VARCHAR)
                           AS no_coverage_regions,
                       CAST(count(*) FILTER (WHERE depth >= 1 AND depth < 10) AS VARCHAR)
                           AS low_coverage_regions,
                       CAST(count(*) FILTER (WHERE depth >= 10 AND depth < 50) AS VARCHAR)
                           AS medium_coverage_regions,
                       CAST(count(*) FILTER (WHERE depth >= 50 AND depth < 100) AS VARCHAR)
                           AS high_coverage_regions,
                       CAST(count(*) FILTER (WHERE depth >= 100) AS VARCHAR)
                           AS very_high_coverage_regions
                FROM depth GROUP BY sample_id)
            ON COLUMNS(* EXCLUDE sample_id) INTO NAME name VALUE value)"""),
    "depth_classes": _over_depth("""
        SELECT sample_id,
               CAST(count(*) FILTER (WHERE depth < 1) AS BIGINT) AS no_coverage_regions,
               CAST(count(*) FILTER (WHERE depth >= 1 AND depth < 10) AS BIGINT)
                   AS low_coverage_regions,
               CAST(count(*) FILTER (WHERE depth >= 10 AND depth < 50) AS BIGINT)
                   AS medium_coverage_regions,
               CAST(count(*) FILTER (WHERE depth >= 50 AND depth < 100) AS BIGINT)
                   AS high_coverage_regions,
               CAST(count(*) FILTER (WHERE depth >= 100) AS BIGINT)
                   AS very_high_coverage_regions
        FROM depth GROUP BY sample_id"""),
    "depth_windows": _over_depth(f"""
        SELECT sample_id, chrom, CAST(window_idx * 1000 AS BIGINT) AS window_start,
               CAST((window_idx + 1) * 1000 AS BIGINT) AS window_end,
               CAST(sum(bases) AS BIGINT) AS covered_bases,
               CAST(sum(depth * bases) AS BIGINT) AS depth_sum,
               min(depth) AS min_depth, max(depth) AS max_depth,
               round(CAST(sum(depth * bases) AS DOUBLE) / 1000, 6) AS mean_depth
        FROM ({_windows(1000)}) GROUP BY sample_id, chrom, window_idx"""),
    "depth_windows_all": _over_depth(
        """
        SELECT g.sample_id, g.chrom, CAST(g.w * 700 AS BIGINT) AS window_start,
               CAST(g.high AS BIGINT) AS window_end,
               CAST(coalesce(sum(least("end", g.high) - greatest("start", g.w * 700))
                             FILTER (WHERE depth IS NOT NULL), 0) AS BIGINT) AS covered_bases,
               CAST(coalesce(sum(depth * (least("end", g.high) - greatest("start", g.w * 700))),
                             0) AS BIGINT) AS depth_sum,
               coalesce(min(depth), 0) AS min_depth, coalesce(max(depth), 0) AS max_depth,
               round(CAST(coalesce(sum(depth * (least("end", g.high)
                                                - greatest("start", g.w * 700))), 0) AS DOUBLE)
                     / CAST(g.high - g.w * 700 AS DOUBLE), 6) AS mean_depth
        FROM (SELECT *, least(length, (w + 1) * 700) AS high
              FROM (SELECT sample_id, chrom, length,
                           unnest(range((length - 1) // 700 + 1)) AS w
                    FROM (SELECT DISTINCT sample_id FROM alignments), chrom_sizes)) g
        LEFT JOIN depth d
            ON d.sample_id = g.sample_id AND d.chrom = g.chrom
               AND d."start" < g.high AND d."end" > g.w * 700
        GROUP BY g.sample_id, g.chrom, g.w, g.high""",
        "chrom_sizes",
    ),
    "signal_levels": _over_depth(f"""
        SELECT sample_id, chrom, CAST(level AS INTEGER) AS level,
               CAST(window_idx // f * f * 1000 AS BIGINT) AS bin_start,
               CAST((window_idx // f + 1) * f * 1000 AS BIGINT) AS bin_end,
               CAST(sum(bases) AS BIGINT) AS covered,
               CAST(sum(depth * bases) AS DOUBLE) AS "sum",
               min(depth) AS "min", max(depth) AS "max"
        FROM ({_windows(1000)})
        CROSS JOIN (VALUES (0, 1), (1, 4), (2, 16), (3, 64), (4, 256)) AS l(level, f)
        GROUP BY sample_id, chrom, level, f, window_idx // f"""),
    "known_contigs": _over_depth(
        """SELECT sample_id, chrom, "start", least("end", length) AS "end", depth
        FROM depth JOIN chrom_sizes USING (chrom) WHERE "start" < length""",
        "chrom_sizes",
    ),
    "unknown_contigs": _over_depth(
        """SELECT sample_id, chrom, greatest("start", coalesce(length, 0)) AS "start", "end",
               depth
        FROM depth LEFT JOIN chrom_sizes USING (chrom)
        WHERE length IS NULL OR "end" > length""",
        "chrom_sizes",
    ),
    "flagstat": with_views(
        "SELECT sample_id, "
        + ", ".join(
            f"CAST(count(*) FILTER (WHERE {test} AND flag & 512 = {bit}) AS BIGINT) "
            f"AS {name}{suffix}"
            for bit, suffix in ((0, ""), (512, "_qc_failed"))
            for name, test in _FLAG_FIGURES.items()
        )
        + """, round(100.0 * CAST(count(*) FILTER (WHERE flag & 516 = 0) AS DOUBLE)
                / CAST(count(*) FILTER (WHERE flag & 512 = 0) AS DOUBLE), 6) AS mapping_rate
        FROM alignments GROUP BY sample_id""",
        "alignments",
    ),
    "alignment_stats": with_views(
        """
        SELECT sample_id, CAST(count(*) AS BIGINT) AS total_reads,
               CAST(count(*) FILTER (WHERE flag & 4 = 0) AS BIGINT) AS mapped_reads,
               CAST(count(*) FILTER (WHERE flag & 4 = 0 AND mapq >= 20) AS BIGINT)
                   AS filtered_reads,
               round(100.0 * CAST(count(*) FILTER (WHERE flag & 4 = 0) AS DOUBLE)
                     / CAST(count(*) AS DOUBLE), 6) AS mapping_rate,
               round(100.0 * CAST(count(*) FILTER (WHERE flag & 4 = 0 AND mapq >= 20) AS DOUBLE)
                     / CAST(count(*) AS DOUBLE), 6) AS filter_rate,
               round(coalesce(avg(mapq) FILTER (WHERE flag & 4 = 0 AND mapq >= 20), 0), 6)
                   AS average_mapping_quality
        FROM alignments GROUP BY sample_id""",
        "alignments",
    ),
    "alignment_stats_dedup": with_views(
        f""", kept AS (
            SELECT sample_id, mapq FROM (
                SELECT *, row_number() OVER (PARTITION BY sample_id, chrom, pos0, seq
                                             ORDER BY {_ORDER}) AS r
                FROM alignments WHERE flag & 4 = 0 AND mapq >= 20) WHERE r = 1)
        SELECT a.sample_id, total_reads, mapped_reads, filtered_reads,
               round(100.0 * CAST(mapped_reads AS DOUBLE) / CAST(total_reads AS DOUBLE), 6)
                   AS mapping_rate,
               round(100.0 * CAST(filtered_reads AS DOUBLE) / CAST(total_reads AS DOUBLE), 6)
                   AS filter_rate,
               round(average, 6) AS average_mapping_quality
        FROM (SELECT sample_id, CAST(count(*) AS BIGINT) AS total_reads,
                     CAST(count(*) FILTER (WHERE flag & 4 = 0) AS BIGINT) AS mapped_reads
              FROM alignments GROUP BY sample_id) a
        JOIN (SELECT sample_id, CAST(count(*) AS BIGINT) AS filtered_reads,
                     avg(mapq) AS average
              FROM kept GROUP BY sample_id) k USING (sample_id)""",
        "alignments",
    ),
    "mapped_filter": with_views(
        f"SELECT {_RECORD} FROM alignments WHERE flag & 4 = 0", "alignments"
    ),
    "mapq_filter": with_views(
        f"SELECT {_RECORD} FROM alignments WHERE mapq >= 20", "alignments"
    ),
    "dedup": with_views(
        f"""SELECT {_RECORD} FROM (
            SELECT *, row_number() OVER (PARTITION BY sample_id, chrom, pos0, seq
                                         ORDER BY {_ORDER}) AS r FROM alignments)
        WHERE r = 1""",
        "alignments",
    ),
    "filtered_alignments": with_views(
        f"""SELECT {_RECORD} FROM (
            SELECT *, row_number() OVER (PARTITION BY sample_id, chrom, pos0, seq
                                         ORDER BY {_ORDER}) AS r
            FROM alignments WHERE flag & 4 = 0 AND mapq >= 20)
        WHERE r = 1""",
        "alignments",
    ),
    "coordinate_sort": with_views(f"SELECT {_RECORD} FROM alignments", "alignments"),
    "coordinate_sort_header": with_views(
        f"SELECT {_RECORD} FROM alignments", "alignments"
    ),
    "read_qc": with_views(
        f"""
        SELECT sample_id, mate, CAST(count(*) AS BIGINT) AS reads,
               CAST(sum(length(seq)) AS BIGINT) AS bases,
               CAST(sum(q20) AS BIGINT) AS q20_bases,
               CAST(sum(q30) AS BIGINT) AS q30_bases,
               CAST(sum(gc) AS BIGINT) AS gc_bases,
               round(CAST(sum(q20) AS DOUBLE) / CAST(sum(length(seq)) AS DOUBLE), 6)
                   AS q20_rate,
               round(CAST(sum(q30) AS DOUBLE) / CAST(sum(length(seq)) AS DOUBLE), 6)
                   AS q30_rate,
               round(CAST(sum(gc) AS DOUBLE) / CAST(sum(length(seq)) AS DOUBLE), 6) AS gc_rate,
               round(CAST(sum(length(seq)) AS DOUBLE) / CAST(count(*) AS DOUBLE), 6)
                   AS mean_length
        FROM (SELECT *, {_count_quality('>= 20')} AS q20, {_count_quality('>= 30')} AS q30,
                     length(regexp_replace(seq, '[^GC]', '', 'g')) AS gc FROM reads)
        GROUP BY sample_id, mate""",
        "reads",
    ),
    "quality_filter": with_views(
        f"""SELECT * FROM reads
        WHERE {_count_quality('< 15')} * 100 <= length(seq) * 40
          AND length(seq) - length(replace(seq, 'N', '')) <= 5""",
        "reads",
    ),
    "mean_quality_filter": with_views(
        f"SELECT * FROM reads WHERE {_PHRED_SUM} >= 20 * length(qual)", "reads"
    ),
    "length_filter": with_views("SELECT * FROM reads WHERE length(seq) >= 50", "reads"),
    "filter_reasons": with_views(
        f"""SELECT sample_id, verdict, CAST(count(*) AS BIGINT) AS reads
        FROM (SELECT sample_id, {_verdict('seq', 'qual')} AS verdict FROM reads)
        GROUP BY sample_id, verdict""",
        "reads",
    ),
    "tail_trim": with_views(
        """, windows AS (
            SELECT sample_id, read_id, min(i) AS cut
            FROM (SELECT *, unnest(range(length(qual) - 3)) AS i FROM reads
                  WHERE length(qual) >= 4)
            WHERE ascii(substr(qual, CAST(i + 1 AS INTEGER), 1))
                + ascii(substr(qual, CAST(i + 2 AS INTEGER), 1))
                + ascii(substr(qual, CAST(i + 3 AS INTEGER), 1))
                + ascii(substr(qual, CAST(i + 4 AS INTEGER), 1)) - 4 * 33 < 80
            GROUP BY sample_id, read_id)
        SELECT r.sample_id, r.read_id, mate,
               CASE WHEN cut IS NULL THEN seq ELSE substr(seq, 1, CAST(cut AS INTEGER)) END
                   AS seq,
               CASE WHEN cut IS NULL THEN qual ELSE substr(qual, 1, CAST(cut AS INTEGER)) END
                   AS qual,
               ordinal
        FROM reads r LEFT JOIN windows USING (sample_id, read_id)""",
        "reads",
    ),
    "cycle_profile": with_views(
        """
        SELECT sample_id, mate, CAST(p AS INTEGER) AS cycle,
               CAST(count(*) AS BIGINT) AS bases,
               CAST(sum(q) AS BIGINT) AS quality_sum,
               CAST(count(*) FILTER (WHERE b = 'A') AS BIGINT) AS a_bases,
               CAST(count(*) FILTER (WHERE b = 'C') AS BIGINT) AS c_bases,
               CAST(count(*) FILTER (WHERE b = 'G') AS BIGINT) AS g_bases,
               CAST(count(*) FILTER (WHERE b = 'T') AS BIGINT) AS t_bases,
               CAST(count(*) FILTER (WHERE b = 'N') AS BIGINT) AS n_bases,
               round(CAST(sum(q) AS DOUBLE) / CAST(count(*) AS DOUBLE), 6) AS mean_quality
        FROM (SELECT sample_id, mate, p, substr(seq, CAST(p AS INTEGER), 1) AS b,
                     ascii(substr(qual, CAST(p AS INTEGER), 1)) - 33 AS q
              FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS p FROM reads))
        GROUP BY sample_id, mate, p""",
        "reads",
    ),
    "mate_join": with_views("SELECT * FROM read_pairs", "read_pairs"),
    "orphans": with_views(
        "SELECT * FROM r1_files WHERE sample_id NOT IN (SELECT sample_id FROM r2_files)",
        "r1_files",
        "r2_files",
    ),
    "paired_files": with_views(
        "SELECT * FROM r1_files WHERE sample_id IN (SELECT sample_id FROM r2_files)",
        "r1_files",
        "r2_files",
    ),
    "pair_overlap_trim": _over_pairs("SELECT * FROM trimmed"),
    "pair_verdicts": _over_pairs(f"""
        SELECT sample_id, verdict, CAST(count(*) AS BIGINT) AS pairs
        FROM (SELECT sample_id, CASE WHEN v1 <> 'passed' THEN v1 ELSE v2 END AS verdict
              FROM (SELECT sample_id, {_verdict('seq1', 'qual1')} AS v1,
                           {_verdict('seq2', 'qual2')} AS v2 FROM trimmed))
        GROUP BY sample_id, verdict"""),
    "insert_size": _over_pairs("""
        SELECT sample_id, insert_length, CAST(count(*) AS BIGINT) AS pairs
        FROM found WHERE insert_length IS NOT NULL GROUP BY sample_id, insert_length"""),
    "duplication": with_views(
        """
        SELECT sample_id, copies, CAST(count(*) AS BIGINT) AS distinct_pairs
        FROM (SELECT sample_id, seq1, seq2, CAST(count(*) AS BIGINT) AS copies
              FROM read_pairs GROUP BY sample_id, seq1, seq2)
        GROUP BY sample_id, copies""",
        "read_pairs",
    ),
    "duplication_rate": with_views(
        """
        SELECT sample_id, CAST(sum(n) AS BIGINT) AS pairs,
               CAST(count(*) AS BIGINT) AS distinct_pairs,
               round(CAST(sum(n) - count(*) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 6)
                   AS duplication_rate
        FROM (SELECT sample_id, seq1, seq2, count(*) AS n
              FROM read_pairs GROUP BY sample_id, seq1, seq2)
        GROUP BY sample_id""",
        "read_pairs",
    ),
    "exact_placement": with_views(
        f""", {_pieces("reads").strip()},
        starts AS (
            SELECT DISTINCT seq, substr(seq, 1, 15) AS kmer,
                   length(substr(seq, 1, 15)) AS size
            FROM reads WHERE length(seq) > 0),
        found AS (
            SELECT r.seq, k.chrom_idx, k.start, k.p
            FROM starts r
            JOIN (SELECT chrom_idx, start, p, size,
                         substr(ahead, 1, CAST(size AS INTEGER)) AS kmer
                  FROM positions, (SELECT DISTINCT size FROM starts)
                  WHERE length(ahead) >= size) k USING (kmer, size)),
        hits AS (
            SELECT seq, chrom_idx, count(*) AS n, min(start + p) AS p FROM found
            WHERE length(seq) <= 15 GROUP BY ALL
            UNION ALL
            SELECT f.seq, chrom_idx, count(*), min(start + p)
            FROM found f JOIN pieces USING (chrom_idx, start)
            WHERE length(f.seq) > 15
                  AND substr(piece, CAST(p + 1 AS INTEGER), length(f.seq)) = f.seq
            GROUP BY ALL),
        summed AS (
            SELECT seq, sum(n) AS n_hits, count(*) AS n_contigs,
                   min(CAST(chrom_idx AS BIGINT) * 1000000000 + p) AS first
            FROM hits GROUP BY seq)
        SELECT r.sample_id, r.read_id, r.mate,
               CAST(coalesce(n_hits, 0) AS BIGINT) AS n_hits,
               CAST(coalesce(n_contigs, 0) AS BIGINT) AS n_contigs,
               CAST(first // 1000000000 AS VARCHAR) AS chrom,
               CAST(first % 1000000000 AS BIGINT) AS pos0
        FROM reads r LEFT JOIN summed USING (seq)""",
        "reads",
        "contigs",
    ),
    "approx_placement": _over_placed("""
        SELECT sample_id, read_id, mate, coalesce(hits_0, 0) AS hits_0,
               coalesce(hits_1, 0) AS hits_1, coalesce(hits_2, 0) AS hits_2
        FROM mates LEFT JOIN summed USING (seq)"""),
    "best_placement": _over_placed("""
        SELECT sample_id, read_id, mate, chrom, chrom_idx, pos0, strand, mismatches,
               n_best, runner_up,
               CAST(CASE WHEN mismatches IS NULL OR n_best > 1 THEN 0
                         WHEN runner_up IS NULL THEN 60
                         ELSE (runner_up - mismatches) * 10 END AS INTEGER) AS mapq
        FROM (SELECT sample_id, read_id, mate, chrom, chrom_idx,
                     CAST(pos0 AS BIGINT) AS pos0, strand,
                     CAST(mm AS INTEGER) AS mismatches,
                     CASE mm WHEN 0 THEN hits_0 WHEN 1 THEN hits_1 WHEN 2 THEN hits_2 END
                         AS n_best,
                     CAST(CASE WHEN mm < 1 AND hits_1 > 0 THEN 1
                               WHEN mm < 2 AND hits_2 > 0 THEN 2 END AS INTEGER) AS runner_up
              FROM mates LEFT JOIN summed USING (seq)
              LEFT JOIN (SELECT * FROM ranked WHERE r = 1) USING (seq))"""),
    "stage_accounting": with_views(
        """
        SELECT stage, CAST(count(*) FILTER (WHERE status = 'success') AS BIGINT)
                   AS success_count,
               CAST(count(*) AS BIGINT) AS total_count, 'completed' AS status
        FROM ledger GROUP BY stage""",
        "ledger",
    ),
    "status_breakdown": with_views(
        """
        SELECT stage, CAST(count(*) AS BIGINT) AS total_samples,
               CAST(count(*) FILTER (WHERE status = 'success') AS BIGINT) AS success_samples,
               CAST(count(*) FILTER (WHERE status = 'failed') AS BIGINT) AS failed_samples,
               CAST(count(*) FILTER (WHERE status = 'error') AS BIGINT) AS error_samples
        FROM ledger GROUP BY stage""",
        "ledger",
    ),
    "successful_samples": with_views(
        "SELECT * FROM ledger WHERE status = 'success'", "ledger"
    ),
    "fastq_round_trip": with_views(
        "SELECT *, CAST(NULL AS VARCHAR) AS error FROM mates", "mates"
    ),
    "sam_round_trip": with_views(
        """SELECT sample_id, qname, flag, chrom, pos0, mapq, cigar, rnext,
               pos0 + 7 AS pnext0, seq, 'i:' || seq AS nm FROM alignments""",
        "alignments",
    ),
    "alignment_store_region": with_views(
        f"""SELECT {_RECORD} FROM alignments
        WHERE chrom = 'chr2' AND pos0 >= 200 AND pos0 < 6000""",
        "alignments",
    ),
    "alignment_store_overlaps": with_views(
        f"""SELECT {_RECORD} FROM alignments
        WHERE chrom = 'chr2' AND pos0 < 6000 AND pos0 + greatest(span, 1) > 230""",
        "alignments",
    ),
    "bedgraph_round_trip": _over_depth("SELECT * FROM depth"),
    "fasta_round_trip": with_views("SELECT chrom, length, seq FROM contigs", "contigs"),
    "fai_round_trip": with_views("SELECT chrom, length FROM contigs", "contigs"),
}
ORACLE["signal_store_level"] = (
    f"SELECT * FROM ({ORACLE['signal_levels']}) WHERE chrom = 'chr3' AND level = 2"
)
ORACLE["placed_depth_stats"] = _over_placed(f""", alignments AS (
    SELECT sample_id, chrom, CAST(pos0 AS BIGINT) AS pos0, length(mates.seq) AS span,
           0 AS flag
    FROM mates JOIN ranked ON ranked.seq = mates.seq AND ranked.r = 1),
{_DEPTH.strip()}
{_DEPTH_STATS}""")
ORACLE["placed_flagstat"] = _over_placed("""
, best AS (
    SELECT sample_id, read_id, mate, length(m.seq) AS size, chrom, pos0, strand,
           CASE WHEN mm IS NULL THEN 0
                WHEN (CASE mm WHEN 0 THEN hits_0 WHEN 1 THEN hits_1 ELSE hits_2 END) > 1 THEN 0
                WHEN mm < 1 AND hits_1 > 0 THEN 10
                WHEN mm < 2 AND hits_2 > 0 THEN (2 - mm) * 10
                ELSE 60 END AS mapq
    FROM mates m LEFT JOIN summed USING (seq)
    LEFT JOIN (SELECT * FROM ranked WHERE r = 1) USING (seq)),
ends AS (
    SELECT a.sample_id, a.chrom, b.chrom AS other, a.mapq,
           a.chrom = b.chrom AND a.strand <> b.strand
           AND CASE WHEN a.strand = '+' THEN a.pos0 ELSE b.pos0 END
               < CASE WHEN a.strand = '+' THEN b.pos0 + b.size ELSE a.pos0 + a.size END
           AND greatest(a.pos0 + a.size, b.pos0 + b.size) - least(a.pos0, b.pos0) <= 1000
               AS proper
    FROM best a JOIN best b
        ON a.sample_id = b.sample_id AND a.read_id = b.read_id AND a.mate <> b.mate)
SELECT sample_id, CAST(count(*) AS BIGINT) AS total_reads,
       CAST(count(chrom) AS BIGINT) AS mapped_reads,
       CAST(count(*) AS BIGINT) AS paired_reads,
       CAST(count(*) FILTER (WHERE proper) AS BIGINT) AS properly_paired,
       CAST(count(*) FILTER (WHERE chrom IS NOT NULL AND other IS NOT NULL) AS BIGINT)
           AS both_mapped,
       CAST(count(*) FILTER (WHERE chrom IS NOT NULL AND other IS NULL) AS BIGINT)
           AS singletons,
       CAST(count(*) FILTER (WHERE chrom <> other) AS BIGINT) AS different_chr,
       CAST(count(*) FILTER (WHERE chrom <> other AND mapq >= 5) AS BIGINT)
           AS different_chr_mapq5,
       """ + ", ".join(
    f"CAST(0 AS BIGINT) AS {name}_qc_failed" for name in _FLAG_FIGURES
) + """,
       round(100.0 * CAST(count(chrom) AS DOUBLE) / CAST(count(*) AS DOUBLE), 6)
           AS mapping_rate
FROM ends GROUP BY sample_id""")
ORACLE["flagstat_parse"] = ORACLE["flagstat"]
ORACLE["json_reports"] = ORACLE["alignment_stats"]


def _places(order: str) -> str:
    return f"SELECT sample_id, chrom, pos0, ordinal, row_number() OVER (ORDER BY {order}) AS place"


ORACLE["coordinate_order"] = with_views(
    f"""{_places('sample_id, chrom NULLS LAST, pos0 NULLS LAST, ordinal')}
    FROM alignments""",
    "alignments",
)
ORACLE["coordinate_order_header"] = with_views(
    f"""{_places('sample_id, chrom_idx NULLS LAST, chrom NULLS LAST, pos0 NULLS LAST, ordinal')}
    FROM alignments LEFT JOIN chrom_sizes USING (chrom)""",
    "alignments",
    "chrom_sizes",
)
ORACLE["bed_order"] = _over_depth("""
    SELECT *, row_number() OVER (ORDER BY sample_id, chrom, "start") AS place FROM depth""")

# A file's bytes: four lines a read, of which the header has a sign more and the third is one.
ORACLE["file_manifest"] = with_views(
    """, files AS (
        SELECT sample_id, mate, sample_id || '_' || CAST(mate AS VARCHAR) || '.fastq' AS path,
               CAST(sum(length(read_id) + length(seq) + length(qual) + 6) AS BIGINT) AS bytes
        FROM run_mates GROUP BY sample_id, mate)
    SELECT a.sample_id, a.path AS r1_path, b.path AS r2_path, a.bytes AS r1_bytes,
           b.bytes AS r2_bytes,
           CASE WHEN b.path IS NOT NULL THEN printf('%.2f', a.bytes / 1048576) END AS r1_size_mb,
           CASE WHEN b.path IS NOT NULL THEN printf('%.2f', b.bytes / 1048576) END AS r2_size_mb
    FROM files a LEFT JOIN files b ON a.sample_id = b.sample_id AND b.mate = 2
    WHERE a.mate = 1""",
    "run_mates",
)

ORACLE["fastq_format"] = with_views(
    "SELECT *, CAST(NULL AS VARCHAR) AS error FROM run_mates WHERE mate = 2", "run_mates"
)

# Samples leave the run where their fault shows; what is left is cleaned, placed and covered.
ORACLE["run_ledger"] = with_views(
    f""",
{_OVERLAP.strip().replace("FROM read_pairs", "FROM run_pairs")},
samples AS (SELECT DISTINCT sample_id, fault FROM run_pairs),
passed AS (
    SELECT * FROM trimmed JOIN samples USING (sample_id)
    WHERE fault NOT IN ({NO_PARTNER}, {NO_FILE})
      AND {_verdict('seq1', 'qual1')} = 'passed' AND {_verdict('seq2', 'qual2')} = 'passed'),
cleaned AS (
    SELECT sample_id, fault, seq1 AS seq FROM passed
    UNION ALL
    SELECT sample_id, fault, seq2 FROM passed),
aligned AS (SELECT sample_id, seq FROM cleaned WHERE fault <> {NO_LETTERS}),
{_PLACED.strip().replace("FROM mates", "FROM aligned")},
alignments AS (
    SELECT sample_id, chrom, CAST(pos0 AS BIGINT) AS pos0, length(aligned.seq) AS span, 0 AS flag
    FROM aligned JOIN ranked ON ranked.seq = aligned.seq AND ranked.r = 1),
{_DEPTH.strip()},
amounts AS (
    SELECT 'preprocessing' AS stage, sample_id, count(*) AS amount FROM cleaned
    GROUP BY sample_id
    UNION ALL SELECT 'alignment', sample_id, count(*) FROM aligned GROUP BY sample_id
    UNION ALL SELECT 'sam_processing', sample_id, count(*) FROM alignments GROUP BY sample_id
    UNION ALL SELECT 'coverage', sample_id, sum("end" - "start") FROM depth GROUP BY sample_id),
ledger AS (
    SELECT 'preprocessing' AS stage, sample_id,
           CASE WHEN fault IN ({NO_PARTNER}, {NO_FILE}) THEN 'failed' ELSE 'success' END AS status,
           CASE fault WHEN {NO_PARTNER} THEN 'read without mate'
                      WHEN {NO_FILE} THEN 'no file of mate 2' END AS error
    FROM samples
    UNION ALL
    SELECT 'alignment', sample_id,
           CASE WHEN letterless THEN 'error' ELSE 'success' END,
           CASE WHEN letterless THEN 'read that is no sequence' END
    FROM (SELECT sample_id, fault = {NO_LETTERS}
                 AND sample_id IN (SELECT sample_id FROM passed) AS letterless
          FROM samples WHERE fault NOT IN ({NO_PARTNER}, {NO_FILE}))
    UNION ALL
    SELECT unnest(['sam_processing', 'coverage']), sample_id, 'success', NULL
    FROM samples
    WHERE fault NOT IN ({NO_PARTNER}, {NO_FILE})
      AND NOT (fault = {NO_LETTERS} AND sample_id IN (SELECT sample_id FROM passed)))
SELECT stage, sample_id, status, error, CAST(coalesce(amount, 0) AS BIGINT) AS amount,
       CAST(count(*) FILTER (WHERE status = 'success') OVER w AS BIGINT) AS success_count,
       CAST(count(*) OVER w AS BIGINT) AS total_count, CAST(NULL AS VARCHAR) AS pipeline_type
FROM ledger LEFT JOIN amounts USING (stage, sample_id) WINDOW w AS (PARTITION BY stage)
UNION ALL
SELECT 'run', NULL, 'completed', NULL, NULL, NULL, NULL, 'hybrid'""",
    "run_pairs",
    "contigs",
)
