"""Text documents: the collision result and the trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.operators.results import collision_document, feature_parts


def write_collision_document(validated: DataFrame, path: str) -> None:
    """The result document as text parts, in order. ``validated`` should be a stored table."""
    collision_document(validated).write.mode("overwrite").text(path)


#: Rows of a monotonically increasing id in one partition.
_IDS = 1 << 33


def write_trajectories(candidates: DataFrame, pieces: DataFrame, path: str) -> None:
    """One GeoJSON feature per line for each vessel of each collision. ``pieces`` should be a stored table.

    A line is put together by the writer from a path's parts, which follow each other in one file with a blank between them; no row
    holds a whole path.
    """
    parts = feature_parts(candidates, pieces)
    # By a hash of its own: dealt by the columns, as both tables under the union are, Spark leaves this exchange out, and coalesces the
    # partitions of either table by themselves, so that a path's parts come into several files.
    dealt = parts.repartition(F.xxhash64("candidate_id", "vessel_side")).sortWithinPartitions("candidate_id", "vessel_side", "part", "piece")
    # Every feature but a file's first begins with the end of the line before.
    begins = (F.col("part") == 0) & (F.col("at") % _IDS > 0)
    lines = dealt.withColumn("at", F.monotonically_increasing_id())
    text = lines.select(F.concat(F.when(begins, F.lit("\n")).otherwise(F.lit("")), F.col("value")).alias("value"))
    text.write.mode("overwrite").option("lineSep", " ").text(path)
