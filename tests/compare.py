"""Compares a registered query with its SQL twin, value by value."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def bag(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, connection, query, sql: str, sf_dir: str) -> tuple[int, str]:
    """Number of rows and, if they differ, how."""
    frame = query(spark, sf_dir)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "NestedLoopJoin", "PythonUDF", "ArrowEval", "MapInPandas"):
        assert operator not in plan, operator
    ours = bag(frame.columns, frame.collect())
    answer = connection.execute(sql)
    names = [column[0] for column in answer.description]
    theirs = bag(names, answer.fetchall())
    if sorted(frame.columns) != sorted(names):
        return sum(ours.values()), f"columns: {sorted(frame.columns)} / {sorted(names)}"
    if ours == theirs:
        return sum(ours.values()), ""
    only_ours, only_theirs = ours - theirs, theirs - ours
    return sum(ours.values()), (
        f"{sum(only_ours.values())} rows only in Spark, e.g. {next(iter(only_ours), None)}; "
        f"{sum(only_theirs.values())} only in SQL, e.g. {next(iter(only_theirs), None)}"
    )
