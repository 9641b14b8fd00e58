"""Folders of paired FASTQ files as a data source: ``spark.read.format("fastq").load(folder)``."""

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from strandline.schemas import READS
from strandline.sources.fastq import BLOCK_BYTES, OPEN_BYTES, SPLIT_BYTES, range_reader
from strandline.sources.files import list_files
from strandline.sources.manifest import MATE_FILE


class FastqRanges(InputPartition):
    """Byte ranges of files that one task reads, in a row.

    A range's ``end`` is None for a gzipped file, which is one range.
    """

    def __init__(self, ranges: list[dict]):
        self.ranges = ranges


class FastqReader(DataSourceReader):
    def __init__(self, folder: str, split_bytes: int):
        self.folder, self.split_bytes = folder, split_bytes
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Samples and mates are chosen by file name; other filters are left to Spark."""
        for each in filters:
            known = isinstance(each, (EqualTo, In)) and each.attribute in (("sample_id",), ("mate",))
            if not known:
                yield each
                continue
            values = {each.value} if isinstance(each, EqualTo) else set(each.value)
            name = each.attribute[0]
            self.wanted[name] = self.wanted.get(name, values) & values

    def partitions(self) -> list[FastqRanges]:
        """Ranges of all files; small ones share a task, up to ``split_bytes`` together."""
        found, own, filled = [], [], 0
        for path, size in list_files(self.folder):
            named = re.fullmatch(MATE_FILE, path.rsplit("/", 1)[-1])
            if not named:
                continue
            names = {"sample_id": named[1], "mate": int(named[2])}
            if any(names[name] not in values for name, values in self.wanted.items()):
                continue
            step = max(size, 1) if named[3] else self.split_bytes
            for start in range(0, max(size, 1), step):
                end = None if named[3] else start + step
                cost = max(min(step, size - start), OPEN_BYTES)
                if own and filled + cost > self.split_bytes:
                    found.append(FastqRanges(own))
                    own, filled = [], 0
                own.append({**names, "path": path, "start": start, "end": end})
                filled += cost
        return [*found, FastqRanges(own)] if own else found

    def read(self, partition: FastqRanges) -> Iterator[pa.RecordBatch]:
        for each in partition.ranges:
            yield from range_reader(BLOCK_BYTES)([pa.RecordBatch.from_pylist([each])])


class FastqSource(DataSource):
    """Reads of all files ``{sample}_{1|2}.fastq[.gz]`` of a folder, paired or not.

    Rows, errors and ranges are those of ``read_fastq``; the option ``split_bytes`` sets the size
    of a range. With ``spark.sql.python.filterPushdown.enabled``, ``FastqSource`` opens only the
    files of the samples and mates asked for.
    """

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self):
        return READS

    def reader(self, schema) -> FastqReader:
        split_bytes = int(self.options.get("split_bytes", SPLIT_BYTES))
        if split_bytes < 1:
            raise ValueError("split_bytes must be positive")
        return FastqReader(self.options["path"], split_bytes)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it push filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FastqSource)
