"""Raw report files: CSV with a header row, every column text."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlead.schema import RAW_COLUMNS

_CSV_NAMES = "*.[cC][sS][vV]"
_OPTIONS = {"header": "true", "enforceSchema": "false"}


def list_report_files(spark: SparkSession, folder: str) -> list[str]:
    """The CSV files under ``folder``, by name. Only names are read, not contents."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", _CSV_NAMES).load(folder).select("path")
    return sorted(row.path for row in found.toLocalIterator())


def stream_files(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """The CSV files that arrive in ``folder``, as a stream of names; each is delivered once, contents aren't read."""
    layout = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(layout).option("pathGlobFilter", _CSV_NAMES)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder).select("path")


def header_of(spark: SparkSession, file: str) -> tuple[str, ...]:
    return tuple(spark.read.option("header", True).csv(as_written(file)).columns)


#: No file is cut, and none shares a task with another, below this size.
_APART = 1 << 40


def first_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """path and digest of the first line that isn't blank, of each file that has one: one job, which reads the files' beginnings only.

    Each file is a task of its own, and the task ends with the line it looks for. No built-in operator
    stops there, hence the function in Python; it sees one batch of lines a file.
    """
    alone = spark.newSession()
    for name in ("maxPartitionBytes", "openCostInBytes"):
        alone.conf.set(f"spark.sql.files.{name}", str(_APART))
    lines = alone.read.text([as_written(file) for file in files]).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.trim("value").alias("line")
    )

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, (line, start) in enumerate(zip(batch.column("line"), batch.column("start"))):
                if line.as_py() and start.as_py() == 0:
                    yield batch.slice(at, 1).select(["path", "line"])
                    # A worker that has seen the end of its input, as of a small file, serves the next task.
                    next(batches, None)
                    return

    found = lines.mapInArrow(first, "path string, line string")
    return found.select("path", F.sha2("line", 256).alias("digest"))


def _plain(path: str) -> str:
    """A path with one slash after its scheme; Spark's readers write one or three."""
    return re.sub(r"^(\w+):/+", r"\1:/", path)


def as_written(path: str) -> str:
    """A listed path with its glob characters escaped, so that reading it finds that file."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def _text_layout(header: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType(), True) for name in header])


def read_reports(spark: SparkSession, paths: str | list[str], header: tuple[str, ...] | None = None) -> DataFrame:
    """Reports of files that share one header (a file, folder, glob or list), as the thirteen raw columns.

    Spark maps CSV columns by position, so the files are read at full width and each file's header
    is checked against the first one's: a file in another order fails instead of mixing columns up.
    """
    reader = spark.read.options(**_OPTIONS).option("pathGlobFilter", _CSV_NAMES)
    if header is not None:
        reader = reader.schema(_text_layout(header))
    return reader.csv(paths).select(*(f"`{name}`" for name in RAW_COLUMNS))


def files_by_header(spark: SparkSession, files: list[str]) -> dict[tuple[str, ...], list[str]]:
    """The files of each header. A constant number of jobs, and one file opened again for each kind of first line."""
    named = {_plain(file): file for file in files}
    alike: dict[str, list[str]] = defaultdict(list)
    for path, digest in first_lines(spark, files).collect():
        alike[digest].append(named[_plain(unquote(path))])
    groups: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for group in alike.values():
        groups[header_of(spark, min(group))] += group
    return {header: sorted(group) for header, group in sorted(groups.items())}


def read_mixed_reports(spark: SparkSession, folder: str, files: list[str] | None = None) -> DataFrame:
    """Reports of a folder, or of listed files in it, that differ in column order or in extra columns.

    The files' first lines are read in one job, then there is one read per distinct header, and a union by name; files without any line
    hold no report. A folder with one known layout needs only ``read_reports``.
    """
    files = list_report_files(spark, folder) if files is None else files
    if not files:
        raise FileNotFoundError(f"no CSV file in {folder}")
    groups = files_by_header(spark, files)
    if not groups:
        raise FileNotFoundError(f"no CSV file with a header in {folder}")
    return reduce(DataFrame.unionByName, (read_reports(spark, [as_written(f) for f in group], header) for header, group in groups.items()))
