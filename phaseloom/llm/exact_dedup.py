"""Exact dedup (operator 2), in DataFrame functions only.

A digest index is two tables bucketed and sorted by digest.  The first has a row
for every digest seen, with the document that stays; a new batch is reduced to
its distinct digests, those already held are taken out by a sort-merge anti-join,
and the rest is appended.  The second has how often each batch held each digest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phaseloom.llm.common import fresh_path, shared_dir, stored, text_or_empty

#: Digests with more than 1/HOT_SHARE of a batch's rows are looked up by broadcast; there
#: are fewer than HOT_SHARE of them in any batch.
HOT_SHARE = 10_000
_LAST = (1 << 63) - 1


def normalised(text: Column) -> Column:
    """Every run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


class DigestIndex:
    """A persistent index: digest, keep_id, keep_row (the row that stays, within its
    batch), batch; and its tally: digest, n, batch."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digests_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.exists = spark.catalog.tableExists(self.name)
        # An index with a name of its own stays, another goes with the application.
        self.path = None if self.exists else f"{shared_dir(spark)}/{name}" if name else fresh_path(spark, self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def tally(self) -> DataFrame:
        return self.spark.table(f"{self.name}_tally")

    def digests(self, docs: DataFrame) -> DataFrame:
        """(doc_id, row, digest) of docs, stored, so that rows keep their numbers."""
        own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(text_or_empty(docs)), 256)).alias("digest"))
        return stored(self.spark, own.withColumn("row", F.monotonically_increasing_id()), "digests")

    def _put(self, df: DataFrame, name: str, path: str | None) -> None:
        writer = df.write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest")
        (writer.option("path", path) if path else writer).saveAsTable(name)

    def append(self, digests: DataFrame) -> str:
        """Adds what is new in a batch from digests(); returns the batch's name."""
        batch = uuid.uuid4().hex
        order = F.coalesce("doc_id", F.lit(_LAST))
        groups = digests.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.min_by("row", order).alias("keep_row"), F.count(F.lit(1)).alias("n"))
        groups = stored(self.spark, groups.withColumn("batch", F.lit(batch)), "batch")
        new = groups
        if self.exists:
            new = groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        self._put(new.select("digest", "keep_id", "keep_row", "batch"), self.name, self.path)
        self._put(groups.select("digest", "n", "batch"), f"{self.name}_tally", f"{self.path}-tally" if self.path else None)
        self.exists = True
        return batch

    def compact(self) -> DigestIndex:
        """The same index under a new name with one sorted file a bucket, as many appends
        leave many.  No shuffle: a task reads a bucket and writes it."""
        other = DigestIndex(self.spark, None, self.buckets)
        other._put(self.rows(), other.name, other.path)
        other._put(self.tally().groupBy("digest", "batch").agg(F.sum("n").alias("n")).select("digest", "n", "batch"), f"{other.name}_tally", f"{other.path}-tally")
        other.exists = True
        return other

    def resolve(self, digests: DataFrame, *batches: str) -> DataFrame:
        """For every row of digests, which the given batches brought: doc_id, keep_id,
        group_size (rows with the text in all batches of the index), kept, digest.
        A hot text's rows never meet in one task: the digests that are hot among these
        rows are few by their definition, and what the index has of them is broadcast."""
        hot = digests.groupBy("digest").count().filter(F.col("count") > digests.count() // HOT_SHARE).select("digest")
        hot = F.broadcast(stored(self.spark, hot, "hot"))
        size = self.tally().groupBy("digest").agg(F.sum("n").alias("group_size"))
        kept = F.col("batch").isin(*batches) & (F.col("row") == F.col("keep_row"))
        columns = ["doc_id", "keep_id", "group_size", kept.alias("kept"), "digest"]
        of_hot = self.rows().join(hot, "digest", "left_semi").join(size.join(hot, "digest", "left_semi"), "digest")
        first = digests.join(F.broadcast(of_hot), "digest")
        rest = digests.join(hot, "digest", "left_anti").join(self.rows().hint("merge"), "digest").join(size.hint("merge"), "digest")
        return first.select(*columns).unionByName(rest.select(*columns))


def exact_duplicates(spark: SparkSession, docs: DataFrame, index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of docs.

    docs go to the index in ``batches`` parts by ascending doc_id, so of equal texts
    the smallest doc_id is appended first and stays; of repeated rows with that
    doc_id, one of them.  Null text counts as empty.  A null doc_id stays only where
    no other row has the text, and keep_id is null then.  With an index that holds
    earlier documents, texts known to it are not kept, and group_size counts theirs
    too.  Empty table: no rows.
    """
    index = index or DigestIndex(spark)
    digests = index.digests(docs)
    marks = digests.select(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)] or [1.0], 1000)).first()[0] or []
    part = F.lit(0)
    for m in marks[: batches - 1]:
        part = part + F.coalesce(F.col("doc_id") > m, F.lit(True)).cast("int")  # null last
    digests = digests.withColumn("part", part)
    names = [index.append(digests.filter(F.col("part") == k)) for k in range(batches)]
    return index.resolve(digests, *names).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
