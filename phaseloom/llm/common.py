"""Shared helpers: input tables, the shared folder, Arrow text access."""

from __future__ import annotations

import atexit
import ctypes
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_scratch: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; read through Spark only, so any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.  If it is unset, a private one in local
    mode, where all tasks are on this machine; on a cluster that is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in a folder of this application's own, which goes when it ends."""
    app = spark.sparkContext.applicationId
    folder = f"{shared_dir(spark)}/scratch-{app}"
    if folder not in _scratch:
        _scratch.add(folder)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: later stages survive a
    lost executor, and nothing upstream is computed twice."""
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch: a Python worker holds a batch or two of whole texts.
BATCH_BYTES = 4 << 20


def text_or_empty(df: DataFrame, name: str = "text") -> Column:
    """The text as a string, null as empty.  Whole texts go to Python in batches of
    BATCH_BYTES from here on in the session, so a worker's memory is bounded."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return F.coalesce(df[name].cast("string"), F.lit(""))


def utf8_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array without copying the text."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[off[0] : off[-1]]
    return raw, off - off[0]


Batches = Iterator[pa.RecordBatch]


def released(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, and then the memory that it has freed goes back to the system: a worker
    stays for the tasks of later stages, and idle ones count in an executor's memory."""

    @functools.wraps(run)
    def whole(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return whole
