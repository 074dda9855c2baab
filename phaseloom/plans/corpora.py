"""Planted corpora and ledgers, each row a function of its number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phaseloom.functions import draws
from phaseloom.functions.torus import DIM, TURN, turn


def corpus_nodes(spark: SparkSession, lineages: int = 6, per_lineage: int = 6, topics: int = 4, aligned: bool = False, noise: float = 0.25, dim: int = DIM, seed: int = 1) -> DataFrame:
    """ord, id, topic, phases: nodes of chains, whose topic (by place in the chain, or by
    chain if aligned) sets their phases but for a seeded jitter."""
    chain, place = F.floor(F.col("id") / per_lineage), F.col("id") % per_lineage
    rows = spark.range(lineages * per_lineage).select(F.col("id").alias("ord"), F.format_string("n%d_%d", chain, place).alias("id"), F.concat(F.lit("t"), (chain if aligned else place) % topics).alias("topic"))
    seed_of_topic = draws.fnv1a(F.concat(F.lit("topic:"), F.col("topic")))
    axes = F.sequence(F.lit(1), F.lit(dim))
    jitter = lambda j: (draws.draw(F.lit(seed), F.col("ord") * dim + j) - 0.5) * 2 * noise
    return rows.select("ord", "id", "topic", F.transform(axes, lambda j: turn(turn(draws.draw(seed_of_topic, j) * TURN) + jitter(j))).alias("phases"))


def corpus_edges(spark: SparkSession, lineages: int = 6, per_lineage: int = 6, ring: bool = False) -> DataFrame:
    """pos, src, dst, kind: along the chains, then between their roots, as a star or a ring."""
    name = lambda chain, place: F.format_string("n%d_%d", chain, place)
    steps = per_lineage - 1
    chain, place = F.floor(F.col("id") / steps), F.col("id") % steps
    along = spark.range(lineages * steps).select(F.col("id").alias("pos"), name(chain, place).alias("src"), name(chain, place + 1).alias("dst"), F.lit("derived").alias("kind"))
    own, nil = F.col("id"), F.lit(0).cast("long")
    roots = spark.range(0 if ring else 1, lineages).select((own + lineages * steps).alias("pos"), name(own if ring else nil, nil).alias("src"), name((own + 1) % lineages if ring else own, nil).alias("dst"), F.lit("assoc").alias("kind"))
    return along.unionByName(roots)


def ledger(spark: SparkSession, topics: int = 4, per_topic: int = 6, cycles: int = 12, cycle_len: int = 100, future_per_topic: int = 4) -> DataFrame:
    """seq, kind, src, dst, weight, ts: topics keep a cadence in every cycle and are tied
    across; their own nodes are tied only after the last cycle, which ends at cycles times
    cycle_len.

    A cycle's events are numbered by topic and node: those of the first topic are a link
    to the next topic and, but for the first node, a link to the node before; those of the
    last topic are none."""
    t, p = topics, per_topic
    first, size = 2 * p - 1, t * p - 1
    n = F.col("id")
    name = lambda k, i: F.format_string("t%d_%d", k, i)
    cycle, r = F.floor(n / size), n % size
    k = F.when(r < first, 0).otherwise(1 + F.floor((r - first) / p)).cast("long")
    i = F.when(r < first, F.floor((r + 1) / 2)).otherwise((r - first) % p).cast("long")
    beside = (r < first) & (r > 0) & (r % 2 == 0)
    at = cycle * cycle_len + F.floor(k * cycle_len / t + 0.5) + i
    inside = spark.range(cycles * size).select(
        n.alias("seq"), F.when(beside, "assoc").otherwise("derived").alias("kind"), F.when(beside, name(k, i - 1)).otherwise(name(k, i)).alias("src"), F.when(beside, name(k, i)).otherwise(name(k + 1, i)).alias("dst"), F.lit(1.0).alias("weight"), at.cast("double").alias("ts")
    )
    k, j = F.floor(n / future_per_topic), n % future_per_topic
    after = spark.range(t * future_per_topic).select((n + cycles * size).alias("seq"), F.lit("assoc").alias("kind"), name(k, j % p).alias("src"), name(k, (j + 2) % p).alias("dst"), F.lit(1.0).alias("weight"), (cycles * cycle_len + 10 + j).cast("double").alias("ts"))
    return inside.unionByName(after.filter("src <> dst"))
