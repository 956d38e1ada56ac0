"""Exact duplicates by progressive refinement: by length, then prefix hash, then full hash.

Each level looks only at rows of groups that still have two members. Which rows those are is told by
a bitmap of bounded size, so that no text is ever shuffled. The prefix is read for rows whose length
repeats, the whole text for rows whose length and prefix repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.llm.common import documents, may_hold, row_filter, salted, spread, whole
from fairlead.sources.tables import Staging

PREFIX_CHARS = 256


def exact_duplicates(docs: DataFrame, staging: Staging, payload: tuple[str, ...] = (), prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, and the ``payload`` columns; native expressions only.

    A group is the rows of one text; null counts as empty. Its largest doc_id is kept (nulls are
    smaller than any). Rows of one doc_id and text are all kept or all dropped. A group without
    any doc_id has a null keep_id and keeps its rows. Other columns are not read. An empty table
    gives an empty result. A group of any size is first summed per task, then joined by salt.
    """
    rows = docs.select("doc_id", whole().alias("__text"), *payload)
    rows = rows.withColumn("__length", F.octet_length("__text").cast("long"))

    lengths = rows.groupBy("__length").count().filter("count > 1")
    by_length = may_hold(rows, "__length", row_filter(lengths, "__length"))

    prefix = F.xxhash64("__length", F.substring("__text", 1, prefix_chars))
    prefixes = by_length.groupBy(prefix.alias("__prefix")).count().filter("count > 1")

    # All rows, as the dropped ones are reported too; the full hash only where the prefix repeats.
    words = row_filter(prefixes, "__prefix")
    slot = F.pmod(F.xxhash64("__prefix"), F.lit(1 << 22))
    marked = (
        rows.withColumn("__prefix", prefix)
        .withColumn("__slot", slot)
        .withColumn("__word", F.shiftright("__slot", 6))
        .join(F.broadcast(words), "__word", "left")
        .withColumn("__hit", F.expr("coalesce((__mask & shiftleft(1L, cast(__slot & 63 as int))) != 0, false)"))
        .select(
            "doc_id",
            *payload,
            "__length",
            "__prefix",
            F.when(F.col("__hit"), F.unhex(F.sha2("__text", 256))).alias("__full"),
        )
    )
    marked = staging.keep(marked, "signatures")

    key = ["__length", "__prefix", "__full"]
    groups = (
        marked.filter("__full is not null")
        .groupBy(*key)
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
    )
    joined = salted(marked, F.col("doc_id")).join(spread(groups), [*key, "__salt"], "left")
    single = F.col("group_size").isNull()
    keep = F.when(single, F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        *payload,
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table; the hash of every text is the query's own column, carried along."""
    docs = documents(spark, sf_dir).withColumn("text_sha256", F.sha2(whole(), 256))
    return exact_duplicates(docs, Staging(spark), payload=("text_sha256",))


OP6_SQL = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
