"""Operators over ledgers (seq, kind, src, dst, weight, ts)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phaseloom.functions.ball import rounded
from phaseloom.functions.torus import DIM, PHI, wrap

BINS, BASE_PERIOD, LEAST_EVENTS, AMPLITUDE_FLOOR = 128, 4.0, 2, 1e-9
WEIGHT_CAP = 5.0
#: Weights count up to WEIGHT_MOST, so repeats after the first TERMS of an edge add less than 1e-14 together.
TERMS, WEIGHT_MOST = 128, 1e12


def _at() -> Column:
    return F.coalesce(F.col("ts"), F.col("seq").cast("double"))


def linked(events: DataFrame) -> DataFrame:
    """Without self-loops and empty endpoints."""
    return events.filter("src <> '' and dst <> '' and src <> dst")


def fold_events(events: DataFrame) -> DataFrame:
    """Edges: src, dst, kind, weight, and first_ts, first_seq, which order them.

    The n-th repeat (from 0) of a triple adds its weight times PHI^-n; the sum is
    capped.  Order is (ts or seq, seq); a missing weight counts 1, a negative
    one 0, one above WEIGHT_MOST that.  Only TERMS repeats of a triple leave a task,
    however many it has.
    """
    own = Window.partitionBy("src", "dst", "kind").orderBy("_at", "seq")
    e = linked(events).select("src", "dst", "kind", "seq", _at().alias("_at"), F.least(F.lit(WEIGHT_MOST), F.greatest(F.lit(0.0), F.coalesce(F.col("weight"), F.lit(1.0)))).alias("w"))
    e = e.withColumn("n", F.row_number().over(own)).filter(F.col("n") <= TERMS)
    total = F.sum(F.col("w") * F.pow(F.lit(PHI), 1 - F.col("n")))
    return e.groupBy("src", "dst", "kind").agg(F.least(F.lit(WEIGHT_CAP), total).alias("weight"), F.min("_at").alias("first_ts"), F.min_by("seq", "n").alias("first_seq"))


def periods() -> list[float]:
    return [BASE_PERIOD * PHI**k for k in range(DIM)]


def _bounded(events: DataFrame) -> DataFrame:
    """Events with a finite time, their weight and their bin of the whole range."""
    e = events.filter("src <> '' and dst <> '' and ts is not null and not isnan(ts) and abs(ts) < double('Infinity')")
    e = e.select("src", "dst", "ts", F.greatest(F.lit(0.0), F.coalesce(F.col("weight"), F.lit(1.0))).alias("w"))
    span = e.agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.count(F.lit(1)).alias("n")).filter(f"n >= {LEAST_EVENTS} and t1 > t0")
    place = F.floor((F.col("ts") - F.col("t0")) / F.greatest(F.lit(1.0), F.col("t1") - F.col("t0")) * BINS)
    return e.crossJoin(F.broadcast(span)).select("src", "dst", "w", F.least(F.lit(BINS - 1), F.greatest(F.lit(0), place)).cast("int").alias("bin"))


def activity_bins(events: DataFrame) -> DataFrame:
    """id, bin, w: each node's weight per bin; a self-loop counts twice."""
    e = _bounded(events).select(F.explode(F.array("src", "dst")).alias("id"), "bin", "w")
    return e.groupBy("id", "bin").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))


def _probes(rows: DataFrame, *keys: str) -> DataFrame:
    """Sine and cosine sums s<k>, c<k> of the de-meaned series, per key."""
    turn = 2 * math.pi
    aggs = [F.sum("w").alias("total"), F.sum("n").alias("n")]
    for k, period in enumerate(periods()):
        angle = F.col("bin") * F.lit(turn / period)
        aggs += [F.sum(F.col("w") * F.sin(angle)).alias(f"s{k}"), F.sum(F.col("w") * F.cos(angle)).alias(f"c{k}")]
    out = rows.groupBy(*keys).agg(*aggs)
    cols = []
    for k, period in enumerate(periods()):
        ss = sum(math.sin(turn * t / period) for t in range(BINS))
        cc = sum(math.cos(turn * t / period) for t in range(BINS))
        cols += [(F.col(f"s{k}") - F.col("total") / BINS * ss).alias(f"s{k}"), (F.col(f"c{k}") - F.col("total") / BINS * cc).alias(f"c{k}")]
    return out.select(*keys, "n", *cols)


def node_phases(events: DataFrame) -> DataFrame:
    """id, phases: each node's phase against the whole ledger at DIM periods.

    One pass sums bins per node; the ledger's own sums are those of its bins.
    Nodes with fewer than two entries, or without any phase, are left out; no
    rows if all events happen at one instant.
    """
    bins = activity_bins(events)
    nodes = _probes(bins, "id").filter(f"n >= {LEAST_EVENTS}")
    whole = _bounded(events).groupBy("bin").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))
    whole = _probes(whole)
    whole = whole.select(*(F.col(c).alias(f"all_{c}") for c in whole.columns if c != "n"))
    phases = []
    for k in range(DIM):
        own, all_ = (F.hypot(f"{p}s{k}", f"{p}c{k}") / BINS for p in ("", "all_"))
        angle = wrap(F.atan2(f"s{k}", f"c{k}") - F.atan2(f"all_s{k}", f"all_c{k}"))
        phases.append(F.when((own < AMPLITUDE_FLOOR) | (all_ < AMPLITUDE_FLOOR), 0.0).otherwise(angle))
    out = nodes.crossJoin(F.broadcast(whole)).select("id", F.array(*phases).alias("raw"))
    out = out.filter(F.exists("raw", lambda x: x != 0))
    return out.select("id", F.transform("raw", lambda x: rounded(x, 6)).alias("phases"))


def split_time(events: DataFrame, fraction: float = 0.7) -> float | None:
    """The cut: the time at place floor(fraction (n - 1)) in order; None for no events.
    Only the counts per time reach one task, and only up to the cut."""
    f = min(0.95, max(0.05, fraction))
    times = events.select(_at().alias("t"))
    n = times.count()
    if not n:
        return None
    k = math.floor(f * (n - 1))
    # Narrow the range by quantiles until few times are left; exact at the end.
    low, high, below = None, None, 0
    while True:
        part = times
        part = part.filter(F.col("t") >= low) if low is not None else part
        part = part.filter(F.col("t") <= high) if high is not None else part
        counts = part.groupBy("t").count()
        if counts.count() <= 100_000:
            for t, c in sorted(map(tuple, counts.collect())):
                below += c
                if below > k:
                    return t
        bounds = part.select(F.percentile_approx("t", [i / 64 for i in range(65)], 10_000)).first()[0]
        edges = sorted(set(bounds))
        upto = part.agg(*(F.sum((F.col("t") <= b).cast("long")) for b in edges)).first()
        i = next(i for i, c in enumerate(upto) if below + c > k)
        if i and edges[i - 1] != low:
            below += upto[i - 1] - part.filter(F.col("t") == edges[i - 1]).count()
            low = edges[i - 1]
        high = edges[i]


def split_events(events: DataFrame, fraction: float = 0.7) -> tuple[DataFrame, DataFrame, float | None]:
    """(train, test, cut): up to the cut, and after it."""
    at = split_time(events, fraction)
    if at is None:
        return events, events, None
    return events.filter(_at() <= at), events.filter(_at() > at), at


def pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def future_links(train: DataFrame, test: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs that are new in test, of nodes known in train."""
    old = linked(train).select(*pair("src", "dst")).distinct()
    nodes = old.select(F.col("a").alias("id")).union(old.select("b")).distinct()
    new = linked(test).select(*pair("src", "dst")).distinct().join(old, ["a", "b"], "left_anti")
    return new.join(nodes.withColumnRenamed("id", "a"), "a", "left_semi").join(nodes.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")
