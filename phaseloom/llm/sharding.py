"""Sharding (operator 7): a uniform shuffle with exact shard sizes.

Rows belong to logical partitions.  A communication matrix, how many rows each
partition sends to each shard, is drawn from the multivariate hypergeometric law
with exact row and column sums (Sanders, 1998).  It is drawn in two levels: the
driver draws what GROUPS groups of partitions send, and a task for each group
deals that out over the group's own partitions.  A partition permutes its rows and
deals them out by its row of the matrix; each shard permutes what it got.  The
second permutation goes by random blocks, so that a shard of any size is spread
over many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phaseloom.llm.common import stored, text_or_empty

#: Groups of partitions, which is what the driver draws for, whatever the number of rows.
GROUPS = 1024
#: A draw looks at so many standard deviations either way; the law has less than 1e-30 beyond.
REACH = 12


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many good ones a sample without replacement has.  The law's logarithm is summed
    up from its mode outwards and inverted, so the numbers may be of any size."""
    low, high = max(0, sample - bad), min(sample, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (sample + 1) * (good + 1) // (total + 2)))
    share = good / total
    spread = (sample * share * (1 - share) * ((total - sample) / max(1, total - 1))) ** 0.5
    width = int(REACH * spread) + 40
    first, last = max(low, mode - width), min(high, mode + width)
    k = np.arange(first, last, dtype=np.float64)
    step = np.log(good - k) + np.log(sample - k) - np.log(k + 1) - np.log(bad - sample + k + 1)
    log_law = np.concatenate(([0.0], np.cumsum(step)))
    law = np.exp(log_law - log_law[mode - first])
    upto = np.cumsum(law)
    return first + int(np.searchsorted(upto, rng.random() * upto[-1], "right").clip(0, last - first))


def dealt(rng: np.random.Generator, left: np.ndarray, sample: int) -> np.ndarray:
    """How a sample without replacement falls on kinds of which there are left[i]."""
    out = np.zeros(len(left), np.int64)
    rest = int(left.sum())
    for i, n in enumerate(left.tolist()):
        rest -= n
        out[i] = hypergeometric(rng, n, rest, sample)
        sample -= int(out[i])
    return out


def communication_matrix(counts: np.ndarray, sizes: np.ndarray, seed: int | list[int]) -> np.ndarray:
    """matrix[p, s]: rows from partition p to shard s; row sums counts, column sums sizes."""
    rng = np.random.default_rng(seed)
    left = sizes.astype(np.int64).copy()
    out = np.zeros((len(counts), len(sizes)), np.int64)
    for p, n in enumerate(counts.tolist()):
        out[p] = dealt(rng, left, n)
        left -= out[p]
    return out


def matrix_table(spark: SparkSession, per: DataFrame, sizes: np.ndarray, seed: int, per_group: int) -> DataFrame:
    """(part, bounds): the running sums of a matrix row for each partition of per (part, n)."""
    per = per.withColumn("group", F.floor(F.col("part") / per_group).cast("long"))
    groups = per.groupBy("group").agg(F.sum("n").alias("n")).toPandas().sort_values("group")  # GROUPS rows at most
    top = communication_matrix(groups["n"].to_numpy(np.int64), sizes, seed)
    shares = spark.createDataFrame(pd.DataFrame({"group": groups["group"].to_numpy(np.int64), "share": top.tolist()}), "group long, share array<long>")

    def draw(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("part")
        matrix = communication_matrix(own["n"].to_numpy(np.int64), np.array(own["share"].iloc[0], np.int64), [seed, int(own["group"].iloc[0])])
        return pd.DataFrame({"part": own["part"], "bounds": np.cumsum(matrix, axis=1).tolist()})

    return per.join(F.broadcast(shares), "group").groupBy("group").applyInPandas(draw, "part long, bounds array<long>")


def shard(spark: SparkSession, docs: DataFrame, shards: int = 16, seed: int = 7, block_rows: int = 20_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row.

    The law is ``rows``: shard counts differ by one at most.  size is the UTF-8
    length plus 1; null text has neither bytes nor, like the empty text, a crc
    other than 0.  Repeated rows and null doc_id are rows like others.  Empty
    table: no rows.  The driver holds GROUPS rows of the matrix, a task those of
    a group's partitions of about block_rows rows each.
    """
    text = text_or_empty(docs)
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = stored(spark, narrow.withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    total = rows.count()
    partitions = max(1, -(-total // block_rows))
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(partitions)))
    sizes = np.full(shards, total // shards, np.int64)
    sizes[: total % shards] += 1
    matrix = stored(spark, matrix_table(spark, rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")), sizes, seed, -(-partitions // GROUPS)), "shard-matrix")
    local = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed + 1), "row"), "row")
    blocks = max(1, -(-total // (shards * block_rows)))
    sent = (
        rows.withColumn("rank", F.row_number().over(local))
        .join(matrix, "part")
        .select("doc_id", "size", "text_crc32", "row", F.size(F.filter("bounds", lambda b: b < F.col("rank"))).alias("shard"), F.pmod(F.xxhash64(F.lit(seed + 2), "row"), F.lit(blocks)).alias("block"))
    )
    sent = stored(spark, sent, "shard-sent")
    offsets = sent.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    offsets = offsets.select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("before"))
    final = Window.partitionBy("shard", "block").orderBy(F.xxhash64(F.lit(seed + 3), "row"), "row")
    return (
        sent.withColumn("within", F.row_number().over(final) - 1)
        .join(offsets, ["shard", "block"])
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("before") + F.col("within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
