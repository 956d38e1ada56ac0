"""Raw reports derived from the ``events`` table, for the registered queries and the benchmark.

The given tables hold no positions. Each event becomes one report: blocks of 10,000 events form a
sailing of 25 vessel pairs that meet head-on, so vessels, encounters and collisions all grow with the
table. A sailing crosses midnight. The text is deliberately untidy (three time spellings, blanks, words where numbers or
times belong, four kinds of unusable identities, places off the globe, GPS spikes, undefined and excluded ship types). Some
vessels report once or twice, one falls silent after its encounter, one is heard only near it, one tells no speed, and one pair lies still.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.schema import RAW_COLUMNS, RAW_TIME

REPORTS_PER_SAILING = 10_000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events. A table of fewer partitions than cores (one small file) is spread over the cores."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "user_id", "value")
    cores = spark.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores, "event_id")


def sample_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id`` and the thirteen raw text columns."""
    sailing = events(spark, sf_dir).selectExpr(
        "event_id",
        "event_type",
        "value",
        "event_id DIV 2 AS clock",
        f"event_id DIV {REPORTS_PER_SAILING} AS sailing",
        f"event_id % {REPORTS_PER_SAILING} DIV 2 AS s",
        "user_id % 50 AS v",
        "user_id % 50 DIV 2 AS pair",
        "300 + 60 * (user_id % 50 DIV 2) AS meeting",
        "CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END AS heading_sign",
    )
    typed = sailing.selectExpr(
        "event_id",
        "event_type",
        "value",
        "v",
        "timestampadd(SECOND, clock, TIMESTAMP_NTZ'2021-12-12 23:45:00') AS time",
        """CAST(CASE WHEN event_id % 211 = 0 THEN 555555555
                     WHEN event_id % 223 = 0 THEN 999000000 + v
                     WHEN event_id % 227 = 0 OR v = 15 AND s > meeting OR v = 21 AND abs(s - meeting) > 40 THEN 12345
                     WHEN event_id % 229 = 0 THEN 123456789
                     WHEN event_id % 1009 = 5 THEN 265000000 + event_id % 1000000
                     WHEN event_id % 1013 IN (7, 17) THEN 266000000 + event_id DIV 1013 % 1000000
                     ELSE 219000000 + 50 * (sailing % 20000) + v END AS STRING) AS mmsi""",
        """CASE WHEN event_id % 239 = 0 THEN 95.0D WHEN event_id % 1013 = 7 THEN 55.6D WHEN event_id % 1013 = 17 THEN 55.6023D
                WHEN pair = 9 THEN 55.18D + 0.00001D * heading_sign
                ELSE 55.0D + 0.02D * pair + 0.00005D * (heading_sign * (s - meeting))
                     + CASE WHEN event_id % 97 = 0 THEN 1.0D ELSE 0.0D END END AS latitude""",
        "CASE WHEN event_id % 1013 IN (7, 17) THEN 14.2D ELSE 14.0D + 0.02D * pair END AS longitude",
        "CASE WHEN pair = 9 THEN '0.2' WHEN v = 25 THEN 'n/a' WHEN s <= meeting THEN '10.0' ELSE '6.0' END AS sog",
        "CASE WHEN heading_sign = 1 THEN '0.0' ELSE '180.0' END AS cog",
        """CASE WHEN v % 10 = 3 THEN 'Pilot' WHEN event_id % 5 = 0 THEN 'Undefined' ELSE 'Cargo' END AS ship_type""",
    )
    texts = {
        RAW_TIME: """CASE WHEN event_id % 233 = 0 THEN 'no time'
                          WHEN event_id % 3 = 0 THEN concat('  ', date_format(time, 'dd/MM/yyyy HH:mm:ss'), ' ')
                          WHEN event_id % 3 = 1 THEN date_format(time, 'yyyy-MM-dd HH:mm:ss')
                          ELSE date_format(time, "yyyy-MM-dd'T'HH:mm:ss") END""",
        "MMSI": "CASE WHEN event_id % 7 = 0 THEN concat(' ', mmsi, '  ') ELSE mmsi END",
        "Latitude": "CAST(latitude AS STRING)",
        "Longitude": "CAST(longitude AS STRING)",
        "Navigational status": "concat(' ', event_type)",
        "SOG": "CASE WHEN event_id % 131 = 0 THEN 'n/a' WHEN event_id % 137 = 0 THEN '' ELSE concat(' ', sog) END",
        "COG": "cog",
        "Heading": "CASE WHEN event_id % 11 = 0 THEN 'unknown' ELSE CAST(event_id % 360 AS STRING) END",
        "Name": "concat(' V', CAST(v AS STRING), ' ')",
        "Ship type": "concat(ship_type, ' ')",
        "Width": "CAST(10 + v % 20 AS STRING)",
        "Length": "CAST(100 + v AS STRING)",
        "Draught": "CAST(value AS STRING)",
    }
    return typed.select("event_id", *(F.expr(texts[name]).alias(name) for name in RAW_COLUMNS))
