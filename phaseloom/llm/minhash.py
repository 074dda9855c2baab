"""MinHash near-dedup (operator 9) with min-max hashing (Ji et al., 2013).

Each of PERMUTATIONS hash functions gives two signature values, its least and
its greatest over a document's word shingles.  Signatures are banded; documents
that share a band's values are candidates, and links are confirmed on the full
shingle sets.  Documents with equal sets are one class, of which only the
representative is compared.  The work in a bucket of n classes is about n:

1. every member is compared with CENTRES members of the bucket by signature; its
   most similar pairs are confirmed, and components are formed of the links;
2. in buckets that still hold several components, members outside the main one are
   compared with all others, by a longer signature and in blocks of bounded size;
   the most similar pairs are confirmed first and components formed anew;
3. then all pairs that are left between different components are confirmed.

So no link between different texts is lost after banding: a pair of a bucket is
either within a component already, or compared.  At similarity 0.75 a pair
shares none of the bands with probability (1 - 0.75^3)^24 = 2e-6, and falls
below LEAST_ESTIMATE with probability 5e-7, or below LEAST_LONG with 1e-6.
A pair that shares several buckets is compared in the first of them only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phaseloom.llm.common import released, stored, text_or_empty, utf8_of
from phaseloom.llm.graph import components
from phaseloom.llm.mph import mix
from phaseloom.llm.pretokens import hash_spans

WORDS, PERMUTATIONS, BANDS, ROWS = 5, 36, 24, 3
VALUES = 2 * PERMUTATIONS
LEAST_ESTIMATE = 0.5
#: Of documents in buckets: min-max hashes of LONG permutations, a byte each.
LONG, LEAST_LONG = 256, 0.66
CENTRES, BEST = 4, 2
BLOCK = 512
CHUNK_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(1, 1 << 62, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_LONG_FACTORS = _rng.integers(1, 1 << 62, LONG, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _rng.integers(1, 1 << 62, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts in data, repeats included, and the
    offsets of each text's own."""
    n = len(off) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    low = _LOWER[data]
    word = ~_BLANK[low]
    first = np.zeros(len(data), bool)
    first[off[:-1][off[:-1] < len(data)]] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | first[1:]
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    a, b = np.flatnonzero(begin), np.flatnonzero(last) + 1
    h = hash_spans(low.tobytes(), a, b)
    upto = np.searchsorted(a, off)  # words before each text
    words = np.diff(upto)
    per = np.where(words >= WORDS, words - WORDS + 1, (words > 0).astype(np.int64))
    out_off = np.concatenate(([0], np.cumsum(per)))
    at = np.repeat(upto[:-1], per) + np.arange(int(out_off[-1])) - np.repeat(out_off[:-1], per)
    size = np.repeat(np.minimum(words, WORDS), per)
    s = size.astype(np.uint64)
    with np.errstate(over="ignore"):
        for j in range(WORDS):
            live = size > j
            s[live] += h[at[live] + j] * _PLACES[j]
    return mix(s, 31), out_off


def shingle_set(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return np.unique(shingles(data, np.array([0, len(data)]))[0])


def _sign(texts: pa.Array):
    """(distinct shingles, digest of the set, signature) of each text."""
    data, off = utf8_of(texts)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK_BYTES, "right")) - 1)
        s, so = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i])
        full = np.flatnonzero(np.diff(so))
        sig = np.zeros((j - i, VALUES), np.uint32)
        if len(full):
            with np.errstate(over="ignore"):
                for k in range(PERMUTATIONS):
                    v = s * _FACTORS[k]
                    sig[full, k] = np.minimum.reduceat(v, so[full]) >> np.uint64(32)
                    sig[full, PERMUTATIONS + k] = np.maximum.reduceat(v, so[full]) >> np.uint64(32)
        for d in range(j - i):
            own = np.unique(s[so[d] : so[d + 1]])
            yield len(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest(), sig[d]
        i = j


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_hash and sig array<int> of every whole text."""

    @released
    def run(batches):
        for b in batches:
            n, digest, sig = [], [], []
            for size, d, s in _sign(b.column("text")):
                n.append(size)
                digest.append(d)
                sig.append(s.view(np.int32))
            flat = np.concatenate(sig) if sig else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * VALUES), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), lists], ["doc_id", "n_shingles", "set_hash", "sig"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, sig array<int>")


def _long_signature(s: np.ndarray) -> bytes:
    out = np.empty(2 * LONG, np.uint8)
    with np.errstate(over="ignore"):
        for k in range(LONG):
            v = s * _LONG_FACTORS[k]
            out[k], out[LONG + k] = (v.min() >> np.uint64(20)) & np.uint64(255), (v.max() >> np.uint64(20)) & np.uint64(255)
    return out.tobytes()


def with_long_signature(texts: DataFrame) -> DataFrame:
    """(node, text) with size, the number of shingles, and long, LONG's bytes."""

    @released
    def run(batches):
        for b in batches:
            sets = [shingle_set(t) for t in b.column("text").to_pylist()]
            long = [_long_signature(s) if len(s) else bytes(2 * LONG) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("text"), pa.array(list(map(len, sets)), pa.int64()), pa.array(long, pa.binary())], ["node", "text", "size", "long"])

    return texts.mapInArrow(run, "node long, text string, size long, long binary")


def _agreement(x: Column, y: Column) -> Column:
    same = F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda acc, v: acc + v)
    return same / F.lit(VALUES)


def _buckets(spark: SparkSession, reps: DataFrame) -> DataFrame:
    """(bucket, n, centres, node): buckets of two nodes or more.  Bands that bring
    the same nodes together count once."""
    keys = F.array(*(F.xxhash64(F.lit(i), *(F.col("sig")[i + BANDS * r] for r in range(ROWS))) for i in range(BANDS)))
    # Stored like chosen below, so that the join alone deals them out and a hot bucket can be split.
    rows = stored(spark, reps.select("node", F.explode(keys).alias("bucket")).distinct(), "bands")
    mixed = [F.xxhash64("node", F.lit(j)) for j in range(CENTRES)]
    first = [F.min_by("node", m).alias(f"c{j}") for j, m in enumerate(mixed)]
    groups = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(mixed[0]).alias("x"), F.bit_xor(mixed[1]).alias("y"), *first).filter("n > 1")
    chosen = groups.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket"), *(F.min(f"c{j}").alias(f"c{j}") for j in range(CENTRES)))
    chosen = chosen.select("bucket", "n", F.array(*(f"c{j}" for j in range(CENTRES))).alias("centres"))
    chosen = stored(spark, chosen, "chosen")
    return stored(spark, rows.join(chosen.hint("merge"), "bucket").select("bucket", "n", "centres", "node"), "buckets")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of (a, b), the pairs whose full sets are alike."""

    @released
    def run(batches):
        last, held = None, None
        for t in batches:
            a, b = [], []
            for x, y, tx, ty in zip(*(t.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
                if tx != last:
                    last, held = tx, shingle_set(tx)
                other = shingle_set(ty)
                both = len(np.intersect1d(held, other, assume_unique=True))
                if len(held) and len(other) and 100 * both >= percent * (len(held) + len(other) - both):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    of_b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    of_a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    return pairs.join(of_b, "b").join(of_a, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _best(pairs: DataFrame, most: int) -> DataFrame:
    """Of (node, other, alike), the most similar others of each node, as (a, b)."""
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("alike"), "other"))
    return pairs.distinct().withColumn("place", place).filter(F.col("place") <= most).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _across(members: DataFrame, labels: DataFrame, texts: DataFrame, percent: int, best: int | None) -> DataFrame:
    """(node, other, alike): pairs of one bucket that are in different components
    and may be alike by their sizes and long signatures.  node is outside the
    component that most of the bucket is in; other is any.  With ``best``, the most
    similar ones of each node and block."""
    known = members.join(labels, "node", "left").select("bucket", "n", "node", F.coalesce("component", "node").alias("component"))
    held = known.groupBy("bucket", "n", "component").agg(F.count(F.lit(1)).alias("rows"))
    main = F.max_by("component", F.struct("rows", "component")).alias("main")
    open_ = held.groupBy("bucket", "n").agg(main, (F.sum("rows") - F.max("rows")).alias("n_out")).filter("n_out > 0")
    # A bucket's rows are dealt out in parts of about BLOCK, each of which meets the bucket's own row.
    parts = F.ceil(F.col("n") / BLOCK)
    spread = open_.select("bucket", "main", "n_out", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("salt"))
    marked = known.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(7)), parts)).join(spread, ["bucket", "salt"]).drop("salt").withColumn("out", F.col("component") != F.col("main"))
    own = F.collect_set("bucket").over(Window.partitionBy("node"))  # BANDS buckets at most
    rows = marked.withColumn("own", own).join(texts.select("node", "size", "long"), "node")
    n_all, n_out = F.ceil(F.col("n") / BLOCK), F.ceil(F.col("n_out") / BLOCK)
    mine = F.pmod(F.xxhash64("node", F.lit(5)), n_all)
    mine_out = F.pmod(F.xxhash64("node", F.lit(6)), n_out)
    columns = ["bucket", "node", "component", "size", "long", "own", "out"]
    right = rows.select(*columns, mine.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), n_out - 1)).alias("part"), F.lit(False).alias("left"))
    left = rows.filter("out").select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), n_all - 1)).alias("block"), mine_out.alias("part"), F.lit(True).alias("left"))

    def run(t: pa.Table) -> pa.Table:
        node, comp, size = (t.column(c).to_numpy() for c in ("node", "component", "size"))
        is_left = t.column("left").to_numpy(zero_copy_only=False)
        long = np.frombuffer(b"".join(t.column("long").to_pylist()), np.uint8).reshape(-1, 2 * LONG)
        outside = t.column("out").to_numpy(zero_copy_only=False)
        own = [set(x) for x in t.column("own").to_pylist()]
        bucket = t.column("bucket")[0].as_py()
        r = np.flatnonzero(~is_left)
        out: list[tuple[int, int, int]] = []
        for i in np.flatnonzero(is_left).tolist():
            near = np.minimum(size[r], size[i]) * 100 >= percent * np.maximum(size[r], size[i])
            q = r[near & (comp[r] != comp[i])]
            if best is None:  # of two nodes outside, each sees the other
                q = q[~outside[q] | (node[q] > node[i])]
            alike = (long[q] == long[i]).sum(axis=1)
            left = best
            for k in np.argsort(-alike, kind="stable").tolist():
                if alike[k] < LEAST_LONG * 2 * LONG or left == 0:
                    break
                j = int(q[k])
                if min(own[i] & own[j]) == bucket:
                    out.append((int(node[i]), int(node[j]), int(alike[k])))
                    left = None if left is None else left - 1
        a, b, c = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"node": pa.array(a, pa.int64()), "other": pa.array(b, pa.int64()), "alike": pa.array(c, pa.int64())})

    return left.unionByName(right).groupBy("bucket", "block", "part").applyInArrow(run, "node long, other long, alike long")


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs.

    Null, empty and blank texts have no shingles and are linked with nothing;
    equal sets are linked.  Rows that share a doc_id are one document: a link of
    one is a link of all, and all are kept or none.  A row with null doc_id is
    linked with nothing, has a null component_id and is kept.  Empty table: no
    rows.
    """
    signed = stored(spark, signatures(docs), "signatures")
    usable = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = stored(spark, usable.groupBy("set_hash").agg(F.min("doc_id").alias("node")), "classes")
    reps = usable.join(classes, "set_hash").filter("doc_id = node").select("node", "set_hash", "sig").dropDuplicates(["node", "set_hash"])
    reps = stored(spark, reps.select("node", "sig"), "representatives")
    members = _buckets(spark, reps)
    nodes = members.select("node").distinct()
    ids = docs.select(docs["doc_id"].cast("long").alias("node"), text_or_empty(docs).alias("text"))
    texts = stored(spark, with_long_signature(ids.join(nodes.hint("merge"), "node", "left_semi")), "candidate-texts")

    stars = members.select("node", F.explode("centres").alias("other")).filter("node <> other").distinct()
    one = reps.select("node", F.col("sig").alias("sa"))
    two = reps.select(F.col("node").alias("other"), F.col("sig").alias("sb"))
    stars = stars.join(one, "node").join(two, "other").select("node", "other", _agreement(F.col("sa"), F.col("sb")).alias("alike")).filter(F.col("alike") >= LEAST_ESTIMATE)
    tested = stored(spark, _best(stars, BEST), "pairs")
    links = stored(spark, _confirmed(tested, texts, percent), "links")
    # A doc_id that occurs with several texts ties their classes together.
    again = usable.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    own = usable.join(again, "doc_id").join(classes, "set_hash").select("doc_id", "node")
    shared = own.join(own.groupBy("doc_id").agg(F.min("node").alias("first")), "doc_id").select(F.col("node").alias("a"), F.col("first").alias("b"))
    links = links.unionByName(shared)
    labels = components(spark, links)
    for best in (BEST, 2 * BEST, None):
        across = stored(spark, _across(members, labels, texts, percent, best), "across")
        if across.isEmpty():
            continue
        across = across.withColumn("a", F.least("node", "other")).withColumn("b", F.greatest("node", "other")).join(tested, ["a", "b"], "left_anti")
        pairs = across.select("a", "b").distinct() if best is None else _best(across.select("node", "other", "alike"), best)
        pairs = stored(spark, pairs, "pairs")
        tested = tested.unionByName(pairs)
        more = stored(spark, _confirmed(pairs, texts, percent), "links")
        if not more.isEmpty():
            labels = components(spark, labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    found = classes.join(labels, "node", "left").select("set_hash", F.coalesce("component", "node").alias("component"))
    rows = signed.select("doc_id", "n_shingles", "set_hash")
    linked = rows.filter("n_shingles > 0 and doc_id is not null").join(found, "set_hash").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = rows.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
