"""Bridges that don't ask the geometry: by seeded draws, or to the nodes of most edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phaseloom.functions import draws
from phaseloom.operators.graph import adjacency
from phaseloom.plans.shared import cut, ranked


def degrees(edges: DataFrame) -> DataFrame:
    """id, degree: ends of edges, repeats counted, self-loops not."""
    e = edges.filter("src <> '' and dst <> '' and src <> dst")
    return e.select(F.col("src").alias("id")).union(e.select("dst")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def _drawn(sources: DataFrame, nodes: DataFrame, count: int, seed: int, near: DataFrame | None) -> DataFrame:
    """source, place, other: ``count`` nodes for each source, drawn by its name and not put
    back, from those in order of name that are neither it nor in near (u, v).

    What is drawn is a place among the nodes that are left; how many of the others come
    before it gives its place among all, and a join its name.  A row holds the places of a
    source's own neighbours, and no more."""
    order = cut(ranked(nodes.select("id").distinct(), "id").select("id", F.col("rank").cast("long").alias("rank")))
    total = order.count()
    own = sources.select("source").distinct().join(order.withColumnRenamed("id", "source"), "source", "left")
    if near is None:
        own = own.withColumn("out", F.array_compact(F.array("rank")))
    else:
        tied = near.join(order.withColumnRenamed("id", "v"), "v").groupBy(F.col("u").alias("source")).agg(F.collect_set(F.col("rank")).alias("tied"))
        out = F.array_sort(F.array_union(F.array_compact(F.array("rank")), F.coalesce("tied", F.array().cast("array<long>"))))
        own = own.join(tied, "source", "left").withColumn("out", out)
    start = F.pmod(draws.fnv1a(F.col("source")) + seed, F.lit(1 << 32))
    places = draws.sample(start, F.lit(total).cast("long") - F.size("out"), count)
    drawn = own.select("source", "out", F.posexplode(places).alias("place", "p")).select("source", "place", draws.past(F.col("out"), F.col("p")).alias("rank"))
    return drawn.join(order.withColumnRenamed("id", "other"), "rank").select("source", "place", "other")


def random_proposals(sources: DataFrame, nodes: DataFrame, count: int, seed: int = 5) -> DataFrame:
    """source, place, other: seeded proposals out of all other nodes."""
    return _drawn(sources, nodes, count, seed, None)


def random_query_bridges(sources: DataFrame, nodes: DataFrame, edges: DataFrame, count: int, seed: int = 7) -> DataFrame:
    """a, b, place: seeded bridges to nodes that aren't adjacent."""
    return _drawn(sources, nodes, count, seed, adjacency(edges)).select(F.col("source").alias("a"), F.col("other").alias("b"), "place")


def random_bridges(nodes: DataFrame, edges: DataFrame, count: int, seed: int = 7, tries: int = 20_000) -> DataFrame:
    """a, b, place: the first seeded pairs that are neither adjacent nor drawn before.  A try
    is two draws, so all tries are made at once and the first sound ones taken."""
    order = cut(ranked(nodes.select("id").distinct(), "id").select("id", F.col("rank").cast("long").alias("rank")))
    total = order.count()
    at = lambda k: F.floor(draws.draw(F.lit(seed), k) * total).cast("long")
    pairs = order.sparkSession.range(tries if total > 1 else 0).select(F.col("id").alias("t"), at(2 * F.col("id") + 1).alias("i"), at(2 * F.col("id") + 2).alias("j")).filter("i <> j")
    first = pairs.groupBy(F.least("i", "j").alias("low"), F.greatest("i", "j").alias("high")).agg(F.min(F.struct("t", "i", "j")).alias("f")).select("f.*")
    named = first.join(order.select(F.col("rank").alias("i"), F.col("id").alias("u")), "i").join(order.select(F.col("rank").alias("j"), F.col("id").alias("v")), "j")
    best = named.join(adjacency(edges), ["u", "v"], "left_anti").orderBy("t").limit(count)
    return best.select(F.col("u").alias("a"), F.col("v").alias("b"), (F.row_number().over(Window.orderBy("t")) - 1).alias("place"))  # of count rows


def hub_query_bridges(sources: DataFrame, edges: DataFrame, count: int) -> DataFrame:
    """a, b, place: each source's nodes of highest degree that aren't adjacent.

    A source is adjacent to fewer nodes than it has edges, so those it may take are among
    the first degree + count + 1 by rank: it is joined with these only."""
    rank = cut(ranked(degrees(edges).select(F.struct((-F.col("degree")).alias("d"), "id").alias("k"), "id", "degree"), "k").select("id", "degree", (F.col("rank") + 1).alias("n")))
    src = sources.select(F.col("source").alias("u")).distinct().join(rank.select(F.col("id").alias("u"), F.col("degree").alias("own")), "u", "left")
    tries = src.select("u", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("own", F.lit(0)) + count + 1)).alias("n"))
    p = tries.join(rank.select(F.col("id").alias("v"), "n"), "n").filter("u <> v").join(adjacency(edges), ["u", "v"], "left_anti")
    own = Window.partitionBy("u").orderBy("n")
    return p.withColumn("place", F.row_number().over(own)).filter(F.col("place") <= count).select(F.col("u").alias("a"), F.col("v").alias("b"), "place")


def hub_bridges(edges: DataFrame, count: int) -> DataFrame:
    """a, b, place: the first pairs, in order of both ranks by degree, that aren't adjacent.

    A node of the first ranks has fewer neighbours than edges, so with its own number of
    edges and ``count`` partners of the ranks behind it, it yields count pairs or all it
    has.  Nodes are asked in growing numbers until there are enough pairs."""
    rank = cut(ranked(degrees(edges).select(F.struct((-F.col("degree")).alias("d"), "id").alias("k"), "id", "degree"), "k").select("id", "degree", (F.col("rank") + 1).alias("n")))
    near, total, asked = adjacency(edges), rank.count(), 16
    while True:
        src = rank.filter(F.col("n") <= asked).select(F.col("id").alias("u"), F.col("n").alias("i"), "degree")
        tries = src.select("u", "i", F.explode(F.sequence(F.col("i") + 1, F.col("i") + F.col("degree") + count)).alias("j"))
        p = cut(tries.join(rank.select(F.col("id").alias("v"), F.col("n").alias("j")), "j").join(near, ["u", "v"], "left_anti").orderBy("i", "j").limit(count))
        if asked >= total or p.count() >= count:
            break
        asked *= 4
    return p.select(F.col("u").alias("a"), F.col("v").alias("b"), F.row_number().over(Window.orderBy("i", "j")).alias("place"))  # of count rows
