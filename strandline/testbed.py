"""Sequencing-shaped views of general tables, for checks and benchmarks.

Each view exists twice: as a Spark DataFrame and as the SQL that other engines run.
"""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strandline.operators.reads import split_pairs
from strandline.sources.fastq import record_text
from strandline.sources.files import lines_writer

# Each character of a text is one base: a letter its own, "_" stands for any other.
LETTERS = "abcdefghijklmnopqrstuvwxyz_"
BASES = "ACGTACGTACGTACGTACGTACGTACG"
QUALITIES = "#5?+F-%B9C7#DE$<&2;:@8>!=4I"

READ_LENGTH = 100
PAIR_STRIDE = 150
PAIR_SHIFT = 60

#: Documents of one language whose reads are one sample of a run, at most.
RUN_DOCUMENTS = 50
#: What is wrong with every fourth such sample; the others are sound.
NO_PARTNER, NO_FILE, NO_LETTERS = 1, 2, 3

# Tie-break of records whose input order is equal in the source table.
RECORD_ORDER = ("ordinal", "flag", "mapq", "cigar", "rnext")

SQL_VIEWS = {
    "alignments": """
        SELECT l_returnflag AS sample_id,
               CAST(l_orderkey AS VARCHAR) AS qname,
               CAST((CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END)
                  + (CASE WHEN l_linestatus = 'F' AND l_partkey % 3 = 0 THEN 2 ELSE 0 END)
                  + (CASE WHEN l_suppkey % 10 = 0 THEN 4 ELSE 0 END)
                  + (CASE WHEN l_linestatus = 'F' AND l_suppkey % 10 = 1 THEN 8 ELSE 0 END)
                  + (CASE WHEN l_linenumber = 7 THEN 256 ELSE 0 END)
                  + (CASE WHEN l_partkey % 50 = 0 THEN 512 ELSE 0 END)
                  + (CASE WHEN l_partkey % 20 = 0 THEN 1024 ELSE 0 END)
                  + (CASE WHEN l_linenumber = 6 THEN 2048 ELSE 0 END) AS INTEGER) AS flag,
               'chr' || CAST(l_suppkey % 4 + 1 AS VARCHAR) AS chrom,
               CAST(l_partkey * 5 AS BIGINT) AS pos0,
               CAST(CAST(floor(l_extendedprice) AS BIGINT) % 61 AS INTEGER) AS mapq,
               CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)
                   || CASE l_partkey % 20 WHEN 17 THEN 'M4S' WHEN 18 THEN 'M3D4M'
                                          WHEN 19 THEN 'M2I5M10N1M' ELSE 'M' END AS cigar,
               'chr' || CAST(l_orderkey % 4 + 1 AS VARCHAR) AS rnext,
               CAST(CAST(l_quantity AS BIGINT) % 4 AS VARCHAR) AS seq,
               CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS ordinal,
               CAST(l_quantity AS BIGINT)
                   + CASE l_partkey % 20 WHEN 18 THEN 7 WHEN 19 THEN 16 ELSE 0 END AS span
        FROM lineitem""",
    "sequences": f"""
        SELECT doc_id, lang,
               translate(letters, '{LETTERS}', '{BASES}') AS seq,
               translate(letters, '{LETTERS}', '{QUALITIES}') AS qual
        FROM (SELECT doc_id, lang,
                     regexp_replace(lower(text), '[^a-z]', '_'{{global}}) AS letters
              FROM documents)""",
    "contigs": """
        SELECT CAST(doc_id AS VARCHAR) AS chrom, CAST(doc_id AS BIGINT) AS chrom_idx,
               CAST(length(seq) AS BIGINT) AS length, seq
        FROM sequences""",
    # One contig ends inside the data, one beyond, one has none, and chr3 is missing.
    "chrom_sizes": """
        SELECT chrom,
               CAST(CASE chrom WHEN 'chr1' THEN last WHEN 'chr2' THEN floor(last / 2)
                               ELSE last + 500 END AS BIGINT) AS length,
               CAST(CASE chrom WHEN 'chr4' THEN 0 WHEN 'chr2' THEN 1 ELSE 3 END AS BIGINT)
                   AS chrom_idx
        FROM (SELECT chrom, max(pos0 + span) AS last FROM alignments GROUP BY chrom)
        WHERE chrom <> 'chr3'
        UNION ALL
        SELECT 'chr9', CAST(2500 + max(r_regionkey) AS BIGINT), CAST(2 AS BIGINT)
        FROM region""",
    "ledger": """
        SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, o_orderpriority AS stage,
               CASE o_orderstatus WHEN 'O' THEN 'success' WHEN 'F' THEN 'failed'
                                  ELSE 'error' END AS status
        FROM orders""",
    "r1_files": "SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS sample_id FROM orders",
    "r2_files": "SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS sample_id FROM lineitem",
}

# The two views that need a row generator, which each engine spells its own way.
_READS = f"""
        SELECT lang AS sample_id,
               CAST(doc_id AS VARCHAR) || '_' || CAST(i AS VARCHAR) AS read_id,
               CAST(1 AS TINYINT) AS mate,
               CAST(substr(seq, CAST(i * {READ_LENGTH} + 1 AS INTEGER), {READ_LENGTH})
                    AS VARCHAR) AS seq,
               CAST(substr(qual, CAST(i * {READ_LENGTH} + 1 AS INTEGER), {READ_LENGTH})
                    AS VARCHAR) AS qual,
               CAST(doc_id * 1000000 + i AS BIGINT) AS ordinal
        FROM ({{numbered}})"""

# A text is cut into inserts, all of it, and each insert is read from both ends, so far that
# the mates overlap.  Mate 1 of every other pair carries one substitution.
_CUT = f"({PAIR_STRIDE} * {{i}} + (7 * doc_id + 13 * {{i}}) % {PAIR_SHIFT})"
_PAIRS = f"""
        SELECT lang AS sample_id,
               CAST(doc_id AS VARCHAR) || '_' || CAST(i AS VARCHAR) AS read_id,
               CASE WHEN (doc_id + i) % 2 = 0
                    THEN substr(insert_seq, 1, err)
                         || translate(substr(insert_seq, err + 1, 1), 'ACGT', 'CGTA')
                         || substr(insert_seq, err + 2, size - 1 - err)
                    ELSE substr(insert_seq, 1, size) END AS seq1,
               substr(insert_qual, 1, size) AS qual1,
               reverse(translate(substr(insert_seq, whole - size + 1, size),
                                 'ACGT', 'TGCA')) AS seq2,
               reverse(substr(insert_qual, whole - size + 1, size)) AS qual2
        FROM (SELECT *, CAST((13 * i + doc_id) % size AS INTEGER) AS err
              FROM (SELECT *, CAST(length(insert_seq) AS INTEGER) AS whole,
                           CAST(ceil(length(insert_seq) * 0.65) AS INTEGER) AS size
                    FROM (SELECT doc_id, lang, i,
                                 CAST(substr(seq, CAST(low + 1 AS INTEGER),
                                             CAST(high - low AS INTEGER)) AS VARCHAR)
                                     AS insert_seq,
                                 CAST(substr(qual, CAST(low + 1 AS INTEGER),
                                             CAST(high - low AS INTEGER)) AS VARCHAR)
                                     AS insert_qual
                          FROM (SELECT *,
                                       CASE WHEN i = 0 THEN 0 ELSE {_CUT.format(i="i")} END
                                           AS low,
                                       CASE WHEN i + 1 >= floor(length(seq) / {PAIR_STRIDE}.0)
                                            THEN length(seq)
                                            ELSE {_CUT.format(i="(i + 1)")} END AS high
                                FROM ({{numbered}})))))"""

_MATES = """
        SELECT sample_id, read_id, CAST(1 AS TINYINT) AS mate, seq1 AS seq, qual1 AS qual
        FROM read_pairs
        UNION ALL
        SELECT sample_id, read_id, CAST(2 AS TINYINT) AS mate, seq2 AS seq, qual2 AS qual
        FROM read_pairs"""

# The input of a run: samples of some documents each, most of them faulty in one way.
_RUN_PAIRS = f"""
        SELECT sample_id || '.' || CAST(part AS VARCHAR) AS sample_id, read_id, part % 4 AS fault,
               CASE WHEN part % 4 = {NO_LETTERS} THEN '1' || substr(seq1, 2) ELSE seq1 END AS seq1,
               qual1, seq2, qual2
        FROM (SELECT *, CAST(floor(CAST(split_part(read_id, '_', 1) AS BIGINT)
                                   / {RUN_DOCUMENTS}.0) AS BIGINT) AS part
              FROM read_pairs)"""

_RUN_MATES = f"""
        SELECT sample_id, read_id, CAST(1 AS TINYINT) AS mate, seq1 AS seq, qual1 AS qual
        FROM run_pairs
        UNION ALL
        SELECT sample_id, read_id, CAST(2 AS TINYINT) AS mate, seq2 AS seq, qual2 AS qual
        FROM run_pairs
        WHERE fault <> {NO_FILE}
          AND (fault <> {NO_PARTNER} OR split_part(read_id, '_', 2) <> '0')"""


def _number(count: str, spark: bool) -> str:
    """Rows of ``sequences`` repeated for i = 0 .. count - 1."""
    if spark:
        # Binary, as a slice of a Spark string costs time in its position.
        return f"""SELECT doc_id, lang, seq, qual,
                          explode(slice(sequence(0L, bigint({count})), 1, int({count}))) AS i
                   FROM (SELECT doc_id, lang, CAST(seq AS BINARY) AS seq,
                                CAST(qual AS BINARY) AS qual FROM sequences)"""
    return f"""SELECT doc_id, lang, seq, qual,
                      unnest(range(CAST({count} AS BIGINT))) AS i FROM sequences"""


def view_sql(name: str, spark: bool = False) -> str:
    """The SQL of one view, over source tables and other views."""
    if name == "reads":
        count = f"ceil(length(seq) / {READ_LENGTH}.0)"
        return _READS.format(numbered=_number(count, spark))
    if name == "read_pairs":
        count = (
            f"CASE WHEN length(seq) > 0"
            f" THEN greatest(1, floor(length(seq) / {PAIR_STRIDE}.0)) ELSE 0 END"
        )
        return _PAIRS.format(numbered=_number(count, spark))
    fixed = {"mates": _MATES, "run_pairs": _RUN_PAIRS, "run_mates": _RUN_MATES}
    if name in fixed:
        return fixed[name]
    text = SQL_VIEWS[name]
    if name == "sequences":
        return text.format(**{"global": "" if spark else ", 'g'"})
    return text.replace("VARCHAR", "STRING") if spark else text


# Views that a view reads.
DEPENDENCIES = {
    "chrom_sizes": ("alignments",),
    "contigs": ("sequences",),
    "reads": ("sequences",),
    "read_pairs": ("sequences",),
    "mates": ("sequences", "read_pairs"),
    "run_pairs": ("sequences", "read_pairs"),
    "run_mates": ("sequences", "read_pairs", "run_pairs"),
}

SOURCE_TABLES = ("lineitem", "documents", "orders", "region")


def with_views(query: str, *names: str) -> str:
    """``query`` preceded by the definitions of the views it names.

    A query with common table expressions of its own starts with a comma.
    """
    needed: list[str] = []
    for name in names:
        for view in (*DEPENDENCIES.get(name, ()), name):
            if view not in needed:
                needed.append(view)
    parts = ",\n".join(f"{view} AS ({view_sql(view)})" for view in needed)
    return f"WITH {parts}\n{query}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view as a DataFrame over the parquet tables in ``sf_dir``."""
    if name == "mates":
        return split_pairs(view(spark, sf_dir, "read_pairs")).select(
            "sample_id", "read_id", "mate", "seq", "qual"
        )
    needed = (*DEPENDENCIES.get(name, ()), name)
    parts = []
    for each in needed:
        sql = view_sql(each, spark=True).replace("VARCHAR", "STRING")
        parts.append(f"{each} AS ({sql})")
    tables = {
        table: spark.read.parquet(f"{sf_dir}/{table}.parquet")
        for table in SOURCE_TABLES
        if any(f"FROM {table}" in part for part in parts)
    }
    ctes = ",\n".join(parts)
    for table in tables:
        ctes = ctes.replace(f"FROM {table}", f"FROM {{{table}}}")
    return spark.sql(f"WITH {ctes}\nSELECT * FROM {name}", **tables)


def write_fasta(contigs: DataFrame, path: str, width: int = 60) -> None:
    """Contigs as FASTA text; each file has its contigs in order."""
    wrapped = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    (
        contigs.select(F.concat(F.lit(">"), "chrom", F.lit("\n"), wrapped).alias("value"))
        .write.mode("overwrite")
        .text(path)
    )


def write_fai(sizes: DataFrame, path: str) -> None:
    (
        sizes.orderBy("chrom_idx")
        .select(F.concat_ws("\t", "chrom", F.col("length").cast("string")).alias("value"))
        .write.mode("overwrite")
        .text(path)
    )


def write_run_input(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The folder of a run: ``reads/{sample}_{mate}.fastq``, ``ref.fa`` and ``ref.fa.fai``.

    The reference is a folder of parts, each of them a range of contigs.
    """
    mates = view(spark, sf_dir, "run_mates")
    # a file may not be named as it is in the table; Spark's folders escape these, too
    name = F.concat_ws("_", "sample_id", "mate")
    for letter in '%"#\'*/:=?{[]^':
        name = F.replace(name, F.lit(letter), F.lit(f"%{ord(letter):02X}"))
    (
        mates.withColumn("file", F.concat(name, F.lit(".fastq")))
        .repartition("file")
        .sortWithinPartitions("file", "read_id")
        .select("file", record_text())
        .mapInArrow(lines_writer(f"{path}/reads", f"{path}/parts/reads"), "file string, bytes long")
        .agg(F.sum("bytes"))
        .collect()
    )
    contigs = view(spark, sf_dir, "contigs")
    write_fasta(contigs.orderBy("chrom_idx"), f"{path}/ref.fa")
    _index(contigs).write.text(f"{path}/parts/fai")
    _move(spark, f"{path}/parts/fai/part-*", path, "ref.fa.fai")


def _index(contigs: DataFrame, width: int = 60) -> DataFrame:
    """Lines of the index of a reference by ``write_fasta``; offsets are sums of sums by thousands.

    They run through all parts of the reference.
    """
    breaks = F.expr(f"greatest(0L, (length - 1) div {width})")
    sized = contigs.select(
        "chrom",
        "chrom_idx",
        "length",
        (F.length("chrom") + 2).alias("head"),
        (F.length("chrom") + 3 + F.col("length") + breaks).alias("size"),
        F.expr("chrom_idx div 1000").alias("block"),
    )
    order = Window.orderBy("block")
    blocks = sized.groupBy("block").agg(F.sum("size").alias("block_size")).select(
        "block", (F.sum("block_size").over(order) - F.col("block_size")).alias("block_start")
    )
    inside = F.sum("size").over(Window.partitionBy("block").orderBy("chrom_idx")) - F.col("size")
    line = F.concat_ws(
        "\t",
        "chrom",
        F.col("length").cast("string"),
        (F.col("block_start") + F.col("inside") + F.col("head")).cast("string"),
        F.lit(str(width)),
        F.lit(str(width + 1)),
    )
    return (
        sized.withColumn("inside", inside)
        .join(blocks, "block")
        .repartition(1)
        .sortWithinPartitions("chrom_idx")
        .select(line.alias("value"))
    )


def _move(spark: SparkSession, pattern: str, folder: str, name: str) -> None:
    """Give a written file its place and name."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(path(folder))
    for found in system.globStatus(path(pattern)):
        system.rename(found.getPath(), path(f"{folder}/{name}"))
