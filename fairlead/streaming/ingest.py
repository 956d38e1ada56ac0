"""Report files -> position table, each file once.

Cleaning keeps no state, so the stream needs no watermark; the checkpoint remembers the files. The stream is of
file names: each batch reads its files by their own headers and writes as the batch job does, so both can share one table.
"""

from __future__ import annotations

from concurrent.futures import Future

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from fairlead.operators.cleaning import clean_reports
from fairlead.params import ReportRules
from fairlead.sources.reports import read_mixed_reports, stream_files
from fairlead.sources.tables import write_positions


def start_ingest(
    spark: SparkSession,
    folder: str,
    table: str,
    checkpoint: str,
    rules: ReportRules = ReportRules(),
    max_files: int = 1000,
) -> StreamingQuery:
    """Clean the files that arrived in ``folder`` since the last call, append them to ``table``, stop.

    ``max_files`` bounds a batch, and with it the names that reach the driver. A batch is named by the query's own id, which its
    checkpoint keeps, and its number: repeated after a failure it replaces what it wrote, and a new checkpoint,
    also at an old path, is another query.
    """
    known: Future[str] = Future()

    def write(names: DataFrame, number: int) -> None:
        files = sorted({row.path for row in names.collect()})
        if files:
            positions = clean_reports(read_mixed_reports(spark, folder, files), rules)
            write_positions(positions, table, batch=f"stream-{known.result()}-{number}", again="skip")

    query = (
        stream_files(spark, folder, max_files)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    known.set_result(str(query.id))
    return query


def ingest_new_files(*args, **options) -> None:
    """``start_ingest``, waiting until the files are in the table."""
    start_ingest(*args, **options).awaitTermination()
