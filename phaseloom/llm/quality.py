"""Quality classifier (operator 8): a Gaussian-kernel ridge by random Fourier
features (Rahimi and Recht, 2007) over document statistics, calibrated by
isotonic regression.

Each partition of the labelled rows gives the sums of its normal equations; the
sums are added up in groups of FAN_IN until few are left, so the driver sees
FAN_IN matrices at most, and every labelled row counts.  Calibration counts
labels per score bin, so its size doesn't depend on the input either.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phaseloom.llm.common import released, stored, text_or_empty, utf8_of
from phaseloom.llm.pretokens import hash_spans

COMPONENTS, RIDGE, WIDTH, SEED = 256, 1e-4, 4.0, 11
FAN_IN, BINS, LOW, HIGH = 16, 512, -0.5, 1.5
#: The share of a score that isn't calibrated, which ranks the rows of one level.
ORDER_SHARE = 0.01
#: Folds are crc32(doc_id as text) mod 4: two fit the ridge, one calibrates, one is held out.
FIT_FOLDS, CALIBRATION_FOLD, HELD_OUT_FOLD = (0, 1), 3, 2
CHUNK_BYTES = 1 << 18
SCORED_ROWS = 128

_CLASS = np.full(256, 6, np.uint8)  # other ASCII
_CLASS[np.arange(128, 256)] = 0
_CLASS[[*range(97, 123)]] = 1
_CLASS[[*range(65, 91)]] = 2
_CLASS[[*range(48, 58)]] = 3
_CLASS[[0x20, 9, 10, 11, 12, 13]] = 4
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 5
_SINGLE = [ord(c) for c in "!|#$%&*<>{}=_@/"]
N_STATS = 7 + len(_SINGLE) + 10


def statistics(texts: pa.Array) -> np.ndarray:
    """N_STATS numbers for each text; an empty text has zeros."""
    data, off = utf8_of(texts)
    out = np.zeros((len(off) - 1, N_STATS))
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK_BYTES, "right")) - 1)
        full = np.flatnonzero(np.diff(off[i : j + 1])) + i
        if len(full):
            out[full] = _statistics(data[off[i] : off[j]], off[full] - off[i], np.diff(off)[full])
        i = j
    return out


def _statistics(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    kind = _CLASS[data]
    total = lambda x: np.add.reduceat(x, at, dtype=np.int64)
    blank = kind == 4
    begin = ~blank
    begin[1:] &= blank[:-1]
    first = np.zeros(len(data), bool)
    first[at] = True
    begin |= first & ~blank
    words = np.maximum(total(begin), 1)
    cols = [total(kind == k) / size for k in range(7)]
    cols += [np.sqrt(total(data == c) / size) for c in _SINGLE]
    letters = np.maximum(total((kind == 1) | (kind == 2) | (kind == 0)), 1)
    same = np.zeros(len(data), bool)
    same[1:] = (data[1:] == data[:-1]) & ~blank[1:]
    same[at] = False
    lines = total(data == 10) + 1
    places = np.flatnonzero(begin)
    owner = np.searchsorted(at, places, "right") - 1
    length = np.diff(np.append(places, len(data)))
    square = np.bincount(owner, length.astype(float) ** 2, len(at)) / words
    mean = np.bincount(owner, length, len(at)) / words
    capital = np.bincount(owner, (kind[places] == 2).astype(float), len(at)) / words
    odd = np.bincount(owner, (kind[places] == 6).astype(float), len(at)) / words
    stop = ~blank
    stop[:-1] &= blank[1:] | first[1:]
    low = data.copy()
    low[kind == 2] += 32
    h = hash_spans(low.tobytes(), places, np.flatnonzero(stop) + 1)
    echo = np.zeros(len(h))
    echo[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    cols += [np.sqrt(np.bincount(owner, echo, len(at)) / words)]
    cols += [np.log1p(size), np.log(words), mean, np.sqrt(np.maximum(square - mean**2, 0)), total(kind == 2) / letters, total(same) / size, lines / words, capital, odd]
    return np.stack(cols, 1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray
    beta: np.ndarray | None = None
    knots: np.ndarray | None = None
    levels: np.ndarray | None = None

    @property
    def learned(self) -> bool:
        return self.beta is not None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.phase
        return np.hstack((np.sqrt(2 / COMPONENTS) * np.cos(z), np.ones((len(x), 1))))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.learned:
            return np.full(len(x), 0.5)
        raw = self.raw(x)
        order = np.clip((raw - LOW) / (HIGH - LOW), 0, 1)
        return np.clip((1 - ORDER_SHARE) * np.interp(raw, self.knots, self.levels) + ORDER_SHARE * order, 0, 1)


def _sums(spark: SparkSession, df: DataFrame, part, width: int) -> np.ndarray | None:
    """The sum over df's Arrow batches of part(batch), vectors of the given width."""

    @released
    def first(batches):
        total = np.zeros(width)
        for b in batches:
            if b.num_rows:
                total += part(b)
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "v": pa.array([total.tobytes()], pa.binary())})

    def again(t: pa.Table) -> pa.Table:
        total = np.zeros(width)
        for v in t.column("v").to_pylist():
            total += np.frombuffer(v)
        return pa.table({"part": pa.array([t.column("part")[0].as_py() // FAN_IN], pa.int64()), "v": pa.array([total.tobytes()], pa.binary())})

    sums = df.mapInArrow(first, "part long, v binary")
    n = df.rdd.getNumPartitions()
    sums = stored(spark, sums, "sums")
    while n > FAN_IN:
        sums = stored(spark, sums.groupBy(F.floor(F.col("part") / FAN_IN)).applyInArrow(again, "part long, v binary"), "sums")
        n = -(-n // FAN_IN)
    rows = sums.collect()
    return np.sum([np.frombuffer(r["v"]) for r in rows], axis=0) if rows else np.zeros(width)


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    x = b.column("x")
    return np.asarray(x.flatten(), np.float64).reshape(-1, N_STATS)


def isotonic(n: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the rising means of bins with weights n."""
    blocks: list[list[float]] = []
    for weight, total in zip(n.tolist(), positive.tolist(), strict=True):
        blocks.append([total, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t, w, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t, blocks[-1][1] + w, blocks[-1][2] + k]
    return np.concatenate([np.full(int(k), t / w) for t, w, k in blocks])


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def statistics_table(docs: DataFrame) -> DataFrame:
    """doc_id, x array<double> for every row."""

    @released
    def run(batches):
        for b in batches:
            x = statistics(b.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * N_STATS), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists], ["doc_id", "x"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from all labelled rows outside the held-out fold.  Labels other
    than 0 and 1 and null ids are left out; of several labels the largest counts.
    Without any label, the model's scores are 0.5."""
    usable = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    usable = usable.withColumn("fold", fold(F.col("doc_id"))).filter(F.col("fold") != HELD_OUT_FOLD)
    rows = stored(spark, statistics_table(docs).join(usable, "doc_id").select("x", "y", "fold"), "labelled")
    fit = rows.filter(F.col("fold").isin(*FIT_FOLDS))

    def moments(b: pa.RecordBatch) -> np.ndarray:
        x = _matrix(b)
        return np.concatenate((x.sum(0), (x**2).sum(0), [len(x)]))

    m = _sums(spark, fit, moments, 2 * N_STATS + 1)
    n = max(m[-1], 1.0)
    mean = m[:N_STATS] / n
    scale = np.sqrt(np.maximum(m[N_STATS:-1] / n - mean**2, 0))
    rng = np.random.default_rng(SEED)
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), rng.normal(0, 1 / WIDTH, (N_STATS, COMPONENTS)), rng.uniform(0, 2 * np.pi, COMPONENTS))
    if not m[-1]:
        return model
    d = COMPONENTS + 1

    def normal(b: pa.RecordBatch) -> np.ndarray:
        z = model.features(_matrix(b))
        return np.concatenate(((z.T @ z).ravel(), z.T @ b.column("y").to_numpy()))

    s = _sums(spark, fit, normal, d * d + d)
    penalty = np.eye(d) * RIDGE * n
    penalty[-1, -1] = 1e-9
    model.beta = np.linalg.solve(s[: d * d].reshape(d, d) + penalty, s[d * d :])

    def bins(b: pa.RecordBatch) -> np.ndarray:
        k = np.clip((model.raw(_matrix(b)) - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(int)
        return np.concatenate((np.bincount(k, minlength=BINS), np.bincount(k, b.column("y").to_numpy(), BINS)))

    counts = _sums(spark, rows.filter(F.col("fold") == CALIBRATION_FOLD), bins, 2 * BINS)
    if not counts[:BINS].sum():
        counts = _sums(spark, fit, bins, 2 * BINS)
    held = np.flatnonzero(counts[:BINS])
    model.knots = LOW + (held + 0.5) * (HIGH - LOW) / BINS
    model.levels = isotonic(counts[held], counts[BINS + held])
    return model


def score(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        parts = (s.iloc[i : i + SCORED_ROWS] for i in range(0, len(s), SCORED_ROWS))
        return pd.Series(np.concatenate([np.zeros(0), *(model.score(statistics(pa.array(x.tolist(), pa.large_string()))) for x in parts)]))

    return run(F.coalesce(text.cast("string"), F.lit("")))


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs.

    Null text counts as empty and is scored like any text; a null doc_id isn't
    held out.  Repeated rows are scored alike.  Empty table: no rows.
    """
    model = train(spark, docs, labels)
    out = docs.select(docs["doc_id"].cast("long").alias("doc_id"), score(model, docs["text"]).alias("score"))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT_FOLD, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
