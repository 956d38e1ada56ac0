"""Runs every registered query against its SQL twin: python tests/check_oracle.py FOLDER [name ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from compare import compare, connect  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as contract  # noqa: E402


def main(sf_dir: str, names: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, wrong = connect(sf_dir), 0
    queries, statements = contract.queries(), contract.oracle_sql()
    for name in names or queries:
        started = time.time()
        rows, difference = compare(spark, connection, queries[name], statements[name], sf_dir) if name in statements else (queries[name](spark, sf_dir).count(), "")
        wrong += bool(difference)
        print(f"{name}: {rows} rows, {time.time() - started:.1f} s, {difference or 'equal'}", flush=True)
    return wrong


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
