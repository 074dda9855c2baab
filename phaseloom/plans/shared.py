"""Tables, and cutting lineage through the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_scratch: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.  If it is unset, a private one in local
    mode, where all tasks are on this machine; on a cluster that is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, _own[sc.applicationId], ignore_errors=True)
    return f"file://{_own[sc.applicationId]}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed and kept in the folder of spark.checkpoint.dir."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in a folder of this application's own, which goes when it ends."""
    folder = f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}"
    if folder not in _scratch:
        _scratch.add(folder)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder.  For tables that are joined with
    themselves round after round: a checkpoint keeps the estimated size of its plan, which
    such joins square each time, until planning takes longer than the work."""
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, key: str, name: str = "rank") -> DataFrame:
    """df with its place from 0 in order of a unique key.  Rows are dealt out by
    ranges of the key; the driver adds up one count a range."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    parts = cut(df.repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    counts = sorted(map(tuple, parts.groupBy("_part").count().collect()))
    before, total = {}, 0
    for part, n in counts:
        before[part], total = total, total + n
    offsets = df.sparkSession.createDataFrame([(p, b) for p, b in before.items()], "_part int, _before long")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return parts.withColumn("_own", own).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")
