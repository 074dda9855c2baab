"""The driver's tables as ledgers, edges, points and walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phaseloom.functions import ball, torus
from phaseloom.plans.shared import table

KINDS = {"click": "assoc", "view": "session", "purchase": "causal", "signup": "derived", "error": "contradicts"}
PHASE_SCALE = 3.0


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a ledger: seq, kind, src, dst, weight, ts (epoch seconds)."""
    e = table(spark, sf_dir, "events")
    kind = F.lit("about")
    for event, edge in KINDS.items():
        kind = F.when(F.col("event_type") == event, F.lit(edge)).otherwise(kind)
    return e.select(
        F.col("event_id").alias("seq"),
        kind.alias("kind"),
        F.concat(F.lit("u"), F.col("user_id")).alias("src"),
        F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("dst"),
        (F.col("value") / 50).alias("weight"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("ts"),
    )


def key_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (pos, src, dst) between consecutive keys of a user: a graph with many cycles."""
    own = Window.partitionBy("src").orderBy("seq")
    e = ledger(spark, sf_dir).select("seq", "src", F.col("dst").alias("a"), F.lead("dst").over(own).alias("b"))
    return e.filter("b is not null").select(F.col("seq").alias("pos"), F.col("a").alias("src"), F.col("b").alias("dst"))


def tree_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, nation and supplier as a forest of derived edges."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pos"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("src"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("dst"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000).alias("pos"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("src"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("dst"))
    return n.select(F.col("pos").cast("long").alias("pos"), "src", "dst").unionByName(s.select(F.col("pos").cast("long").alias("pos"), "src", "dst"))


def supply_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a ledger between parts and suppliers, the large one."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("seq"),
        F.lit("assoc").alias("kind"),
        F.concat(F.lit("p"), F.col("l_partkey")).alias("src"),
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("dst"),
        (F.col("l_quantity").cast("double") / 50).alias("weight"),
        F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("double").alias("ts"),
    )


def charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as nodes with a point in each space: ord, id, topic, ball (3), torus (8)."""
    e = table(spark, sf_dir, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    return e.select(
        F.col("vec_id").alias("ord"),
        F.format_string("v%06d", F.col("vec_id")).alias("id"),
        F.col("label").cast("long").alias("topic"),
        ball.place_features(F.slice(v, 1, 3), 3).alias("ball"),
        torus.phases_to_torus(F.transform(F.slice(v, 4, 8), lambda x: x * (torus.TURN / 2 * PHASE_SCALE))).alias("torus"),
    )


def chart_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (pos, src, dst) over the nodes of charts: each node to the one of a third
    of its number, and three of five to their successors."""
    ids = table(spark, sf_dir, "embeddings").select("vec_id")
    name = lambda c: F.format_string("v%06d", c)
    up = ids.filter("vec_id > 0").select(F.col("vec_id").alias("pos"), name(F.floor(F.col("vec_id") / 3)).alias("src"), name(F.col("vec_id")).alias("dst"))
    known = ids.select((F.col("vec_id") - 1).alias("vec_id"))
    along = ids.join(known, "vec_id", "left_semi").filter("vec_id % 5 < 3").select((F.col("vec_id") + 1000000000).alias("pos"), name(F.col("vec_id")).alias("src"), name(F.col("vec_id") + 1).alias("dst"))
    return up.unionByName(along)


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase sequences: traj (ord div 10), k, and the torus point as vec."""
    return charts(spark, sf_dir).select(F.floor(F.col("ord") / 10).alias("traj"), (F.col("ord") % 10).alias("k"), F.col("torus").alias("vec"))
