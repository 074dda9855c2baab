"""A stated set of queries against all rows, in blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries that meet a slice of the rows in one task, about.
BLOCK_ROWS = 4096


def against_all(queries: DataFrame, rows: DataFrame, query: str, row: str) -> DataFrame:
    """Every query with every row.  Queries go to blocks and rows to slices by hash; a block
    meets a slice by an equal pair of numbers, so neither side is broadcast, whatever
    its size.  ``query`` and ``row`` name their keys."""
    spark = queries.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("_block", F.pmod(F.hash(query), F.lit(blocks))).withColumn("_slice", number(slices))
    r = rows.withColumn("_slice", F.pmod(F.hash(row), F.lit(slices))).withColumn("_block", number(blocks))
    return q.join(r.hint("shuffle_hash") if blocks > 1 else r, ["_block", "_slice"]).drop("_block", "_slice")
