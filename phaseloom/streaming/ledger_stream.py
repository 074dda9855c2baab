"""Streaming ingest of a ledger, and edges kept up to date per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from phaseloom.operators.ledger import fold_events

LEDGER = "seq long, kind string, src string, dst string, weight double, ts double"


def ingest(events: DataFrame, ledger_path: str, edges_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends a stream of events to ledger_path, and writes under edges_path the
    fold of the triples that each micro-batch touches.

    A late event changes the number of every later repeat of its triple, so touched
    triples are folded anew from the ledger; others are not read into the fold.
    A batch that runs again overwrites its own folders.
    """
    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        rows = df.select("seq", "kind", "src", "dst", "weight", "ts")
        rows.write.mode("overwrite").parquet(f"{ledger_path}/batch={number}")
        touched = rows.select("src", "dst", "kind").distinct()
        known = spark.read.schema(LEDGER).parquet(ledger_path).filter(F.col("batch") <= number).drop("batch") if number else spark.read.schema(LEDGER).parquet(f"{ledger_path}/batch={number}")
        fold_events(known.join(touched, ["src", "dst", "kind"], "left_semi")).write.mode("overwrite").parquet(f"{edges_path}/batch={number}")

    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_edges(spark: SparkSession, edges_path: str) -> DataFrame:
    """The latest fold of every triple."""
    rows = spark.read.parquet(edges_path)
    held = [c for c in rows.columns if c not in ("src", "dst", "kind", "batch")]
    return rows.groupBy("src", "dst", "kind").agg(F.max_by(F.struct(*held), "batch").alias("f")).select("src", "dst", "kind", "f.*")


def windowed_activity(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Weight per kind and time window of a stream (ts in epoch seconds), with a watermark."""
    e = events.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    return e.groupBy(F.window("at", window), "kind").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
