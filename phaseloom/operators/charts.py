"""Operators over points of either space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phaseloom.functions import ball as B
from phaseloom.functions import torus as T
from phaseloom.functions.ball import rounded
from phaseloom.operators.blocks import against_all
from phaseloom.plans.shared import cut

TORUS_NODES, PAIR_NODES, PAIR_NODES_MOST = 1024, 128, 256
MOVED = 1e-4


def atlas_stats(points: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean_edge_dist, depth_min, depth_max, depth_mean.
    points: id, ball; edges: src, dst (self-loops and unknown ends left out)."""
    p = points.select("id", "ball")
    ends = edges.filter("src <> dst").select("src", "dst")
    d = ends.join(p.select(F.col("id").alias("src"), F.col("ball").alias("u")), "src").join(p.select(F.col("id").alias("dst"), F.col("ball").alias("v")), "dst")
    e = d.agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.avg(B.distance(F.col("u"), F.col("v"))), F.lit(0.0)).alias("m"))
    depths = p.select(B.depth(F.col("ball")).alias("d")).agg(F.count(F.lit(1)).alias("nodes"), *(F.coalesce(f("d"), F.lit(0.0)).alias(n) for f, n in ((F.min, "lo"), (F.max, "hi"), (F.avg, "mid"))))
    return depths.crossJoin(e).select("nodes", "edges", rounded(F.col("m"), 4).alias("mean_edge_dist"), rounded(F.col("lo"), 4).alias("depth_min"), rounded(F.col("hi"), 4).alias("depth_max"), rounded(F.col("mid"), 4).alias("depth_mean"))


def _k(k: int) -> int:
    return max(1, min(50, k))


def _asked(points: DataFrame, query: str | list[float], column: str) -> tuple[DataFrame, DataFrame]:
    """The point asked for, as a table of one row or none, and the points to compare: all
    others of a node, or all of a vector's dimension."""
    if isinstance(query, str):
        return points.filter(F.col("id") == query).select(F.col(column).alias("q")).limit(1), points.filter(F.col("id") != query)
    q = points.sparkSession.range(1).select(F.array(*(F.lit(float(x)) for x in query)).alias("q"))
    return q, points.filter(F.size(column) == len(query))


def hyper_neighbors(points: DataFrame, query: str | list[float], k: int = 5) -> DataFrame:
    """id, dist, depth of the k nearest to a node or a vector; ties by ord.  points: ord, id, ball."""
    q, others = _asked(points, query, "ball")
    d = others.crossJoin(F.broadcast(q))
    return d.select("ord", "id", rounded(B.distance(F.col("q"), F.col("ball")), 4).alias("dist"), rounded(B.depth(F.col("ball")), 4).alias("depth")).orderBy("dist", "ord").limit(_k(k)).drop("ord")


def torus_neighbors(points: DataFrame, query: str | list[float], k: int = 5, weighted: bool = True) -> DataFrame:
    """id, dist, align of the k nearest to a node or a vector on the torus; ties by ord."""
    q, others = _asked(points, query, "torus")
    d = others.crossJoin(F.broadcast(q))
    dist = T.torus_distance(F.col("q"), F.col("torus"), T.scale_weights() if weighted else None)
    return d.select("ord", "id", rounded(dist, 5).alias("dist"), T.translation_align(F.col("q"), F.col("torus"))[1].alias("align")).orderBy("dist", "ord").limit(_k(k)).drop("ord")


def nearest_by_phase(queries: DataFrame, points: DataFrame, k: int = 5) -> DataFrame:
    """a, b, place, dist: for each of a stated set of nodes (id), the k nearest others on the
    torus, all points compared; ties by id.  points: id, torus."""
    axis = lambda c: [F.col(c)[i].alias(f"{c}{i}") for i in range(T.DIM)]
    asked = points.join(queries.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("a"), F.col("torus").alias("s")).select("a", *axis("s"))
    others = points.select(F.col("id").alias("b"), F.col("torus").alias("t")).select("b", *axis("t"))
    # Plain columns: a loop over the axes of a pair would leave compiled code.
    square = sum((F.lit(w * w) * T.wrap(F.col(f"s{i}") - F.col(f"t{i}")) ** 2 for i, w in enumerate(T.scale_weights())), F.lit(0.0))
    pairs = against_all(asked, others, "a", "b").filter("a <> b").select("a", "b", rounded(F.sqrt(square), 5).alias("dist"))
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy("dist", "b"))).filter(F.col("place") <= k)


def golden_sequence(spark: SparkSession, n: int, dim: int = T.DIM, seed: float = 0.5) -> DataFrame:
    return spark.range(1, n + 1).select(F.col("id").alias("k"), T.golden_point(F.col("id").cast("double"), dim, seed).alias("seat"))


def winding_numbers(sequences: DataFrame) -> DataFrame:
    """traj, axis, winding, turns.  sequences: traj, k, vec."""
    own = Window.partitionBy("traj", "axis").orderBy("k")
    long = sequences.select("traj", "k", F.posexplode("vec").alias("axis", "a"))
    step = long.withColumn("d", T.wrap(F.col("a") - F.lag("a").over(own)))
    turns = F.coalesce(F.sum("d"), F.lit(0.0)) / T.TURN
    return step.groupBy("traj", "axis").agg(F.floor(turns + 0.5).cast("long").alias("winding"), rounded(turns, 4).alias("turns"))


def recognition_invariant(sequences: DataFrame) -> DataFrame:
    """traj, invariant array<long>: the winding vector."""
    w = winding_numbers(sequences).groupBy("traj").agg(F.sort_array(F.collect_list(F.struct("axis", "winding"))).alias("w"))
    return w.select("traj", F.transform("w", lambda x: x["winding"]).alias("invariant"))


def same_recurrence_class(sequences: DataFrame, one: int, two: int) -> DataFrame:
    inv = recognition_invariant(sequences).filter(F.col("traj").isin(one, two))
    return inv.agg((F.count_distinct("invariant") == 1).alias("same"))


def metric_return(sequences: DataFrame) -> DataFrame:
    """traj, closest: the least distance to the start; infinite for one point."""
    own = Window.partitionBy("traj").orderBy("k")
    d = sequences.withColumn("start", F.first("vec").over(own)).withColumn("n", F.row_number().over(own))
    gap = F.when(F.col("n") > 1, T.torus_distance(F.col("start"), F.col("vec")))
    best = d.groupBy("traj").agg(F.min(gap).alias("g"))
    return best.select("traj", F.when(F.col("g").isNull(), float("inf")).otherwise(rounded(F.col("g"), 6)).alias("closest"))


def axis_discrepancy(points: DataFrame) -> DataFrame:
    """axis, d: the star discrepancy of each axis.  points: torus; one axis a task,
    so callers bound the points (torus_map does, by TORUS_NODES)."""
    x = points.select(F.posexplode("torus").alias("axis", "a")).select("axis", (T.turn(F.col("a")) / T.TURN).alias("x"))
    own = Window.partitionBy("axis")
    i, n = F.row_number().over(own.orderBy("x")), F.count(F.lit(1)).over(own)
    return x.select("axis", F.greatest(F.abs(i / n - F.col("x")), F.abs((i - 1) / n - F.col("x"))).alias("d")).groupBy("axis").agg(F.max("d").alias("d"))


def atlas_discrepancy(points: DataFrame) -> DataFrame:
    """One row: mean, max."""
    return axis_discrepancy(points).agg(F.avg("d").alias("m"), F.max("d").alias("x")).select(rounded(F.coalesce("m", F.lit(0.0)), 5).alias("mean"), rounded(F.coalesce("x", F.lit(0.0)), 5).alias("max"))


def nobility(ratios: DataFrame, n_max: int = 300) -> DataFrame:
    """name, nobility: min n ||n omega|| for n up to n_max.  ratios: name, omega."""
    w = ratios.select("name", (((F.col("omega") % 1.0) + 1.0) % 1.0).alias("w")).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(n_max))))
    nw = F.col("n") * F.col("w")
    return w.select("name", (F.col("n") * F.abs(nw - F.floor(nw + 0.5))).alias("v")).groupBy("name").agg(F.min("v").alias("v")).select("name", rounded(F.col("v"), 5).alias("nobility"))


def torus_map(nodes: DataFrame, dim: int = T.DIM, most: int = TORUS_NODES) -> DataFrame:
    """ord, id, torus, placed.  nodes: ord, id, phases.  The first ``most`` nodes are
    taken; those with phases stand at them, the others take golden seats in order."""
    firsts = nodes.filter("id <> ''").groupBy("id").agg(F.min("ord").alias("ord"), F.min_by("phases", "ord").alias("phases")).orderBy("ord").limit(most)
    real = F.coalesce(F.exists("phases", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & (x != 0)), F.lit(False))
    m = firsts.withColumn("placed", real)
    seat = F.row_number().over(Window.partitionBy("placed").orderBy("ord")).cast("double")
    return m.withColumn("seat", seat).select("ord", "id", F.when(F.col("placed"), T.phases_to_torus(F.col("phases"), dim)).otherwise(T.golden_point(F.col("seat"), dim)).alias("torus"), "placed")


def product_pairs(balls: DataFrame, tori: DataFrame) -> DataFrame:
    """id, depth, phase: nodes with a point in both spaces."""
    return balls.select("id", "ball").join(tori.select("id", "torus"), "id").select("id", rounded(B.depth(F.col("ball")), 4).alias("depth"), F.col("torus").alias("phase"))


def node_pairs(points: DataFrame, order: str, most: int, columns: list[str]) -> DataFrame:
    """All pairs i < j of the first ``most`` nodes: a, b, oa, ob and <column>_a, <column>_b.
    most is a bound that the caller sets, so one side fits every task.  The first rows
    stand in one partition, so the other side is dealt out before pairs are made."""
    p = cut(points.orderBy(order).limit(most))
    one = p.select(F.col("id").alias("a"), F.col(order).alias("oa"), *(F.col(c).alias(f"{c}_a") for c in columns)).repartition("a")
    two = p.select(F.col("id").alias("b"), F.col(order).alias("ob"), *(F.col(c).alias(f"{c}_b") for c in columns))
    return one.join(F.broadcast(two), F.col("oa") < F.col("ob"))


def disagreements(points: DataFrame, max_nodes: int = PAIR_NODES, top_k: int = 8, hyperbolic: float = 1.0, toroidal: float = 1.0) -> DataFrame:
    """list, place, a, b, ball, torus: pairs far in one space and near in the other.
    points: ord, id, ball, torus; ties by the order of pairs."""
    n, k = min(PAIR_NODES_MOST, max_nodes), min(50, top_k)
    p = node_pairs(points, "ord", n, ["ball", "torus"]).select("a", "b", "oa", "ob", B.distance(F.col("ball_a"), F.col("ball_b")).alias("ball"), T.torus_distance(F.col("torus_a"), F.col("torus_b"), T.scale_weights()).alias("torus"))
    p = cut(p)
    most = p.agg(F.greatest(F.lit(1e-9), F.max("ball")).alias("bm"), F.greatest(F.lit(1e-9), F.max("torus")).alias("tm"))
    s = p.crossJoin(F.broadcast(most)).withColumn("s", hyperbolic * (F.col("ball") / F.col("bm")) - toroidal * (F.col("torus") / F.col("tm")))

    def top(name: str, key: Column) -> DataFrame:
        best = s.orderBy(key, "oa", "ob").limit(k)
        place = F.row_number().over(Window.orderBy(key, "oa", "ob"))  # of k rows
        return best.select(F.lit(name).alias("list"), place.alias("place"), "a", "b", rounded(F.col("ball"), 4).alias("ball"), rounded(F.col("torus"), 4).alias("torus"))

    return top("same_rhythm_diff_lineage", F.desc("s")).unionByName(top("same_lineage_drift_phase", F.asc("s")))


def atlas_drift(prior: DataFrame, now: DataFrame) -> DataFrame:
    """One row: mean, max, moved over nodes of both (id, ball of one dimension)."""
    p = prior.select("id", F.col("ball").alias("u")).join(now.select("id", F.col("ball").alias("v")), "id").filter(F.size("u") == F.size("v"))
    d = p.select(B.distance(F.col("u"), F.col("v")).alias("d"))
    return d.agg(rounded(F.coalesce(F.avg("d"), F.lit(0.0)), 6).alias("mean"), rounded(F.coalesce(F.max("d"), F.lit(0.0)), 6).alias("max"), F.coalesce(F.sum((F.col("d") > MOVED).cast("long")), F.lit(0).cast("long")).alias("moved"))
