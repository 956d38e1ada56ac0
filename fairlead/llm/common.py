"""Helpers several operators share: a global order, a bounded filter, salted joins."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlead.sources.tables import Staging

#: Slots of a row filter are 2**FILTER_BITS; it is broadcast, and has at most 2**(FILTER_BITS - 6) rows.
FILTER_BITS = 22
SALTS = 16


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole(text: str | Column = "text") -> Column:
    """The text, or the empty text for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


_shipped: dict[str, str] = {}


def ship(context: SparkContext) -> None:
    """Lets Python workers import this library: Spark's file server hands its modules out, once per application."""
    if _shipped.get("to") == context.applicationId:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="modules-"), "fairlead-modules.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    _shipped["to"] = context.applicationId


Batches = Iterator[pa.RecordBatch]
#: Bytes of text that a Python worker works on at once.
PORTION = 1 << 21


def portions(batches: Batches, column: str = "text", most: int = PORTION) -> Batches:
    """Cuts batches so that the texts of each have at most ``most`` bytes, or are a single one."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends, low = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while low < batch.num_rows:
            before = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(low, high - low)
            low = high


def in_batches(df: DataFrame, function: Callable[[Batches], Batches], schema) -> DataFrame:
    """``mapInArrow`` with this library at hand in the workers."""
    ship(df.sparkSession.sparkContext)
    return df.mapInArrow(function, schema)


def numbered(df: DataFrame, order: Sequence[Column], staging: Staging, name: str, sums: Sequence[str] = ()) -> DataFrame:
    """Adds ``position`` (from 0) in the total order and, per column of ``sums``, its sum before the row.

    Rows are ranged by the order and written with their range; the sums of whole ranges, one row
    each, give where a range begins. No task sees more than its range.
    """
    ranged = staging.keep(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), name)
    totals = ranged.groupBy("__range").agg(
        F.count(F.lit(1)).alias("__rows"), *(F.sum(c).alias(f"__{c}") for c in sums)
    )
    # One row per range: as many as the shuffle has partitions, however many rows there are.
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    begins = totals.select(
        "__range",
        F.coalesce(F.sum("__rows").over(ahead), F.lit(0)).alias("__first"),
        *(F.coalesce(F.sum(f"__{c}").over(ahead), F.lit(0)).alias(f"__from_{c}") for c in sums),
    )
    inside = Window.partitionBy("__range").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select(
        "*",
        (F.row_number().over(inside) - 1).alias("__at"),
        *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__in_{c}") for c in sums),
    )
    return local.join(F.broadcast(begins), "__range").select(
        *df.columns,
        (F.col("__first") + F.col("__at")).alias("position"),
        *((F.col(f"__from_{c}") + F.col(f"__in_{c}")).alias(f"{c}_before") for c in sums),
    )


def _slot(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << bits))


def row_filter(keys: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """A bitmap of the keys (long) by their hash, as words of 64 slots: a bounded number of rows."""
    slots = keys.select(_slot(F.col(key), bits).alias("slot"))
    return slots.groupBy(F.shiftright("slot", 6).alias("__word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("__mask")
    )


def may_hold(df: DataFrame, key: str, keys: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose key may be among those of the filter: all that are, and a few others.

    Nothing is shuffled. The broadcast side is bounded by ``bits``; with very many keys the filter
    lets all rows through, which costs time only.
    """
    slot = _slot(F.col(key), bits)
    hit = F.expr("(__mask & shiftleft(1L, cast(__slot & 63 as int))) != 0")
    return (
        df.withColumn("__slot", slot)
        .withColumn("__word", F.shiftright("__slot", 6))
        .join(F.broadcast(keys), "__word")
        .filter(hit)
        .drop("__slot", "__word", "__mask")
    )


def salted(df: DataFrame, by: Column, salts: int = SALTS) -> DataFrame:
    """The many side of a join: rows of one key go to several tasks."""
    return df.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))


def spread(df: DataFrame, salts: int = SALTS) -> DataFrame:
    """The few side of a join: each row once per salt."""
    return df.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
