"""Nearest neighbours by low-dimensional stable projections, kd-trees and a chi-square stopping test.

Projected by independent standard normal vectors, the squared distance of two points becomes that distance times a chi-square
variable. So a neighbour at distance d is, with probability p, among the points whose projected squared distance is at
most d**2 times the p-quantile. Points are visited in order of projected distance and verified on the original vectors, until the
next projected distance is beyond this bound for the k-th distance found.

The upper levels of one kd-tree over the projected points are fitted on a bounded sample and route every row to a cell; the rows
of a cell are dealt to blocks of bounded size, each with a kd-tree of its own.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairlead.llm.common import in_batches, ship
from fairlead.sources.tables import Staging


@dataclass(frozen=True)
class NeighbourRules:
    """``k`` nearest, each missed with probability at most ``1 - chance``.

    The cells are fitted on at most ``sample`` rows, drawn by hash, and number at most ``most_cells``. A task holds about ``block`` rows
    and ``queries`` queries.
    """

    k: int = 10
    dimensions: int = 8
    chance: float = 0.98
    sample: int = 20_000
    most_cells: int = 1024
    block: int = 8192
    queries: int = 4096
    leaf: int = 256
    seed: int = 5


def chi_square_quantile(chance: float, freedom: int) -> float:
    """Where the chi-square distribution function reaches ``chance``, by bisection on its series."""

    def below(x: float) -> float:
        a, x = freedom / 2, x / 2
        term = total = 1 / a
        for n in range(1, 500):
            term *= x / (a + n)
            total += term
        return total * math.exp(a * math.log(x) - x - math.lgamma(a)) if x else 0.0

    low, high = 0.0, 10.0 * freedom + 100
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < chance else (low, middle)
    return high


def projection(width: int, rules: NeighbourRules) -> np.ndarray:
    return np.random.default_rng(rules.seed).standard_normal((width, rules.dimensions))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def fit_cells(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """Splits (axis, value) of a complete binary tree, in heap order: each halves its points on their widest axis."""
    splits: list[tuple[int, float]] = [(0, 0.0)] * ((1 << depth) - 1)
    waiting = [(0, points)]
    while waiting:
        node, own = waiting.pop()
        if node >= len(splits):
            continue
        axis = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if len(own) else 0
        value = float(np.median(own[:, axis])) if len(own) else 0.0
        splits[node] = (axis, value)
        right = own[:, axis] > value
        waiting += [(2 * node + 1, own[~right]), (2 * node + 2, own[right])]
    return splits


def route(points: np.ndarray, splits: list[tuple[int, float]], depth: int) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    axes = np.array([a for a, _ in splits] or [0])
    values = np.array([v for _, v in splits] or [0.0])
    for _ in range(depth):
        node = 2 * node + 1 + (points[np.arange(len(points)), axes[node]] > values[node])
    return node - ((1 << depth) - 1)


class Tree:
    """A kd-tree: halves by rank on the widest axis down to leaves, so equal points don't make it deep."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        self.nodes: list[tuple[np.ndarray, np.ndarray, object]] = []
        self._grow(points, np.arange(len(points)), leaf)

    def _grow(self, points: np.ndarray, rows: np.ndarray, leaf: int) -> int:
        own = points[rows]
        low, high = own.min(axis=0), own.max(axis=0)
        number = len(self.nodes)
        self.nodes.append((low, high, rows))
        if len(rows) > leaf:
            order = np.argpartition(own[:, int(np.argmax(high - low))], len(rows) // 2)
            halves = [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
            self.nodes[number] = (low, high, tuple(self._grow(points, half, leaf) for half in halves))
        return number

    def nearest_first(self, point: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """(squared distance of its box, rows) of the leaves, nearest box first."""
        waiting = [(_to_box(point, *self.nodes[0][:2]), 0)]
        while waiting:
            apart, number = heapq.heappop(waiting)
            below = self.nodes[number][2]
            if isinstance(below, tuple):
                for child in below:
                    heapq.heappush(waiting, (_to_box(point, *self.nodes[child][:2]), child))
            else:
                yield apart, below


def _to_box(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> float:
    gap = np.maximum(np.maximum(low - point, point - high), 0)
    return float(gap @ gap)


def search(
    tree: Tree, vectors: np.ndarray, places: np.ndarray, names: np.ndarray, ids: np.ndarray,
    query: np.ndarray, place: np.ndarray, own: int, bound: float, rules: NeighbourRules, quantile: float,
) -> tuple[np.ndarray, np.ndarray]:
    """Rows and distances of the nearest found in one block, at most k, in order; ``bound``: a k-th distance known already."""
    rows, apart, kth = np.zeros(0, np.int64), np.zeros(0), bound
    for box, leaf in tree.nearest_first(place):
        reach = kth * kth * quantile * (1 + 1e-9) + 1e-12  # equal vectors' projections may differ in the last bit
        if box > reach:
            break
        gaps = places[leaf] - place
        near = leaf[((gaps * gaps).sum(axis=1) <= reach) & (names[leaf] != own)]
        if len(near):
            differences = vectors[near] - query
            rows = np.concatenate([rows, near])
            apart = np.concatenate([apart, np.sqrt((differences * differences).sum(axis=1))])
            best = np.lexsort((ids[rows], apart))[: rules.k]
            rows, apart = rows[best], apart[best]
            if len(rows) == rules.k:
                kth = min(kth, float(apart[-1]))
    return rows, apart


def _searched(data: DataFrame, visits: DataFrame, rules: NeighbourRules, width: int) -> DataFrame:
    """query, query_id, vec_id, score of the nearest in each (cell, block, share) of data to the visits there."""
    quantile = chi_square_quantile(rules.chance, rules.dimensions)

    def block(key: tuple, rows: pd.DataFrame, visitors: pd.DataFrame) -> pd.DataFrame:
        found: list[pd.DataFrame] = []
        if len(rows) and len(visitors):
            vectors = np.stack(rows["vector"].to_numpy()).astype(np.float64)
            places = np.stack(rows["place"].to_numpy())
            names, ids = rows["row"].to_numpy(), rows["vec_id"].to_numpy()
            tree = Tree(places, rules.leaf)
            for visit in visitors.itertuples(index=False):
                at, apart = search(
                    tree, vectors, places, names, ids, np.asarray(visit.vector, np.float64), np.asarray(visit.place),
                    visit.row, visit.bound, rules, quantile,
                )
                found.append(pd.DataFrame({"query": visit.row, "query_id": visit.vec_id, "vec_id": ids[at], "score": apart}))
        columns = {"query": "int64", "query_id": "int64", "vec_id": "int64", "score": "float64"}
        return pd.concat(found).astype(columns) if found else pd.DataFrame({c: pd.Series(dtype=t) for c, t in columns.items()})

    ship(data.sparkSession.sparkContext)
    keys = ("cell", "block", "share")
    return data.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInPandas(
        block, "query long, query_id long, vec_id long, score double"
    )


def nearest(vectors: DataFrame, is_query: str, staging: Staging, rules: NeighbourRules = NeighbourRules()) -> DataFrame:
    """query_id, rank, vec_id, score of the nearest found to each row of ``vectors`` (vec_id, vector) that ``is_query`` holds for.

    Candidates are all rows but the query's own; ties go to the smaller vec_id. Rows take no part if the vec_id is null, or
    the vector is null, empty, zero or of another length than most (the longer one, if as many), or has null or non-finite components. Repeated rows are
    rows of their own. Other columns are not read. The cells' boxes and counts, at most ``most_cells`` of each, are on the driver.
    """
    sound = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "vector").filter(
        F.col("vec_id").isNotNull() & sound & F.exists("vector", lambda v: v != 0)
    )
    lengths = usable.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    width = lengths["n"] if lengths else 1
    usable = usable.filter(F.size("vector") == width)
    total = lengths["count"] if lengths else 0
    matrix = projection(width, rules)

    depth = max(0, min(rules.most_cells, -(-total // rules.block)) - 1).bit_length()
    drawn = usable.orderBy(F.xxhash64(F.lit(rules.seed), "vec_id"), "vec_id").limit(rules.sample).select("vector").toArrow()
    splits = fit_cells(_matrix(drawn.column(0).combine_chunks(), width) @ matrix, depth)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.einsum("ij,jk->ik", _matrix(batch.column("vector"), width), matrix)
            cell = pa.array(route(points, splits, depth))
            place = pa.ListArray.from_arrays(
                pa.array(np.arange(len(points) + 1) * rules.dimensions, pa.int32()), pa.array(points.ravel())
            )
            columns = [batch.column("vec_id"), batch.column("vector"), place, cell]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "vector", "place", "cell"])

    kind = usable.schema["vector"].dataType.simpleString()
    index = in_batches(usable, placed, f"vec_id long, vector {kind}, place array<double>, cell long")
    index = staging.keep(index.withColumn("row", F.monotonically_increasing_id()), "index")

    ends = [f(F.col("place")[j]).alias(f"{n}{j}") for j in range(rules.dimensions) for n, f in (("l", F.min), ("h", F.max))]
    cells = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *ends).orderBy("cell").collect()
    lows = np.array([[c[f"l{j}"] for j in range(rules.dimensions)] for c in cells]).reshape(-1, rules.dimensions)
    highs = np.array([[c[f"h{j}"] for j in range(rules.dimensions)] for c in cells]).reshape(-1, rules.dimensions)
    names = np.array([c["cell"] for c in cells], np.int64)
    spark = vectors.sparkSession
    sizes = spark.createDataFrame(
        [(c["cell"], -(-c["n"] // rules.block)) for c in cells], "cell long, blocks long"
    )
    dealt = index.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")))

    # First each query looks in one block of its own cell: what it finds there bounds the k-th distance.
    asking = dealt.filter(is_query)
    share = F.pmod(F.xxhash64(F.col("row"), F.lit(1)), F.col("shares"))

    def with_shares(visits: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Data and visits, both cut so that no task gets too many queries."""
        counted = visits.groupBy("cell", "block").agg(F.ceil(F.count(F.lit(1)) / rules.queries).alias("shares"))
        data = dealt.join(counted, ["cell", "block"])
        data = data.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
        visits = visits.join(counted, ["cell", "block"]).withColumn("share", share)
        # Both sides come from one table: new names tell Spark which side a column is of.
        return data, visits.select(*(F.col(c).alias(c) for c in visits.columns))

    first = asking.withColumn("bound", F.lit(float("inf")))
    found = _searched(*with_shares(first), rules, width)
    bounds = found.groupBy("query").agg(F.when(F.count(F.lit(1)) >= rules.k, F.max("score")).alias("bound"))
    bounded = staging.keep(
        asking.select("row", "vec_id", "vector", "place")
        .join(bounds.withColumnRenamed("query", "row"), "row", "left")
        .withColumn("bound", F.coalesce("bound", F.lit(float("inf")))),
        "bounded",
    )
    quantile = chi_square_quantile(rules.chance, rules.dimensions)

    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch.column("place"), rules.dimensions)
            bound = batch.column("bound").to_numpy()
            for low in range(0, len(points), 256):
                part = points[low : low + 256, None, :]
                gap = np.maximum(np.maximum(lows[None] - part, part - highs[None]), 0)
                reach = bound[low : low + 256] ** 2 * quantile * (1 + 1e-9) + 1e-12
                at, cell = np.nonzero((gap * gap).sum(axis=2) <= reach[:, None])
                rows = batch.take(pa.array(at + low))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(names[cell])], [*batch.schema.names, "cell"])

    schema = f"row long, vec_id long, vector {kind}, place array<double>, bound double, cell long"
    visits = in_batches(bounded, visiting, schema).join(F.broadcast(sizes), "cell")
    visits = visits.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    every = _searched(*with_shares(visits), rules, width)
    order = Window.partitionBy("query").orderBy("score", "vec_id")
    best = every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= rules.k)
    return best.select("query_id", "rank", "vec_id", "score")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    return nearest(vectors, "vec_id % 100 = 0", Staging(spark))
