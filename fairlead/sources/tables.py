"""Parquet tables: positions by day, and staged tables between the steps of a run."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.schema import DAY, POSITION_COLUMNS, POSITION_SCHEMA, expect
from fairlead.sources.daytable import BATCH, DayTable

def with_day(positions: DataFrame) -> DataFrame:
    return positions.withColumn(DAY, F.to_date("timestamp"))


def write_positions(
    positions: DataFrame, path: str, mode: str = "append", batch: str | None = None, again: str = "refuse"
) -> None:
    """Positions as Parquet, one folder per day and batch, so that a period query reads only its days.

    A batch written again under its name takes the place of what it wrote before, so a job that is repeated after a
    failure adds nothing twice; batches of other names, also from other jobs, stay. Without a name it
    is a new batch. Days merged by ``merge_positions`` are final; see ``DayTable.append`` for ``again``.
    ``mode="overwrite"`` begins the table anew. No shuffle: report files come by day, so a task writes to one or two folders.
    """
    rows = with_day(expect(positions, POSITION_SCHEMA))
    if mode == "append":
        DayTable(positions.sparkSession, path).append(rows, batch, again)
    else:
        named = rows.withColumn(BATCH, F.lit(batch or f"batch-{uuid.uuid4().hex}"))
        named.write.partitionBy(DAY, BATCH).mode(mode).option("partitionOverwriteMode", "static").parquet(path)


def read_positions(spark: SparkSession, path: str, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """Positions written by ``write_positions``, optionally of some days only (both ends included)."""
    table = DayTable(spark, path).read(first=first_day, last=last_day)
    if first_day is not None:
        table = table.filter(F.col(DAY) >= F.lit(first_day).cast("date"))
    if last_day is not None:
        table = table.filter(F.col(DAY) <= F.lit(last_day).cast("date"))
    return expect(table, POSITION_SCHEMA).select(*POSITION_COLUMNS)


def merge_positions(spark: SparkSession, path: str, first_day: str | None = None, last_day: str | None = None) -> list[str]:
    """Merges the batches of each day into one folder, while other jobs read and add; returns the days that had several.

    The hidden folders stay until ``DayTable(spark, path).clean()``.
    """
    return DayTable(spark, path).merge(first_day, last_day, by="mmsi")


def write_table(table: DataFrame, path: str, mode: str = "overwrite") -> None:
    table.write.mode(mode).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """Where staged tables go: the session's checkpoint folder.

    A session in one process without one gets a temporary folder; where there are executors, that would be lost
    with a machine, so there the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="fairlead-")


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """What is executed inside gives its shuffle files back when it has ended, not only when the driver forgets it.

    For writes: their result does not read the shuffles again.
    """
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)


class Staging:
    """Writes a table and reads it back: later steps scan columns of a file instead of recomputing.

    The files lie in shared storage, so a lost executor costs its running tasks only, and Spark
    knows a staged table's size when it plans a join with it.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark = spark
        self.tables: list[str] = []
        self.folder = folder or f"{shared_folder(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"

    def keep(self, table: DataFrame, name: str, by: str | tuple[str, ...] | None = None, bucket_by: tuple[str, ...] = (), buckets: int = 0, codec: str | None = None) -> DataFrame:
        """The table, stored; ``by``: a column, or several, to lay it out by, so that readers skip other values.

        ``bucket_by``: columns by whose hash rows are dealt to ``buckets`` files a folder, or as many as a shuffle has partitions. A later
        join or aggregation on these columns takes the rows where they lie. The session's catalog then knows the table until ``remove``.
        ``codec``: how a table that isn't bucketed is compressed, if not as the session says.
        """
        path = f"{self.folder}/{name}"
        by = [by] if isinstance(by, str) else by
        if not bucket_by:
            writer = table.write.mode("overwrite")
            writer = writer.option("compression", codec) if codec else writer
            with shuffles_cleaned(self.spark):
                (writer.partitionBy(*by) if by else writer).parquet(path)
            return self.spark.read.schema(table.schema).parquet(path)
        buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        own = f"staged_{uuid.uuid4().hex}"
        self.tables.append(own)
        # Dealt as the buckets are: a task writes one file a folder.
        writer = table.repartition(buckets, *bucket_by).write.mode("overwrite").bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
        with shuffles_cleaned(self.spark):
            (writer.partitionBy(*by) if by else writer).option("path", path).format("parquet").saveAsTable(own)
        return self.spark.table(own).select(*table.columns)

    def remove(self) -> None:
        """Deletes what was stored, when nothing reads it any more."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
