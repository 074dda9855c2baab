"""Connected components of an edge table, by alternating stars (Kiveris et al., 2014)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phaseloom.llm.common import stored


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1] or 0


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.join(least, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    joined = edges.join(least, F.col("a") == F.col("u"))
    return joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("u", "m")).distinct()


#: So many distinct edges or fewer are joined up in one task at once, instead of in rounds.
FEW_EDGES = 200_000


def _together(t: pa.Table) -> pa.Table:
    """Components of a table of edges, by halving paths to the least node."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in zip(t.column("a").to_pylist(), t.column("b").to_pylist(), strict=True):
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    nodes = list(up)
    return pa.table({"node": pa.array(nodes, pa.int64()), "component": pa.array([top(x) for x in nodes], pa.int64())})


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component): for every node of edges (a, b), the least node it is
    connected to.  Each round is written to the shared folder."""
    now = stored(spark, edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    mark = _mark(now)
    if mark[0] <= FEW_EDGES:
        return stored(spark, now.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_together, "node long, component long"), "components")
    while mark[0]:
        now = stored(spark, _small(_large(now)), "edges")
        last, mark = mark, _mark(now)
        if last == mark:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b"))).distinct()
