"""Document fingerprints (operator 4): Order MinHash (Marçais et al., 2019), in
DataFrame functions only.

A text's k-mers are K words in a row; a word over 16 characters is cut into
pieces.  The nth repeat of a k-mer counts as a k-mer of its own.  Under each of
SKETCHES orders the TAKEN least k-mers are selected; they keep their order in
the text, and the hash of that tuple is one coordinate.  The likeness of two
fingerprints is the share of equal coordinates.

All orders come from one strong hash: order j compares (hash - r_j) mod 2^64, so
its least elements are those that follow r_j on the ring.  One sort of a text's
hashes serves every order.  Neighbouring orders of a short text may select the same
k-mers; README compares the error with that of independent orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phaseloom.llm.common import stored, text_or_empty

K, SKETCHES, TAKEN = 3, 128, 2
#: Bits of an entry that hold its place: this many, or as many as a longer text needs.
#: What identifies a k-mer are its hash's bits above MOST_BITS, in every text.
PLACE_BITS, MOST_BITS = 22, 31
#: Quantiles of doc_id that the driver holds; parts of the order, which are a task each; rows of a part, if there are fewer.
QUANTILES, PARTS, PART_ROWS = 1024, 65_536, 1_000
_STEP = (1 << 64) // SKETCHES
RING = [-(1 << 63) + _STEP // 2 + j * _STEP for j in range(SKETCHES)]


def _right(x: Column, bits: Column) -> Column:
    return F.call_function("shiftright", x, bits)


def _power(bits: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits)


def _halving(n: Column) -> Column:
    """2^k, 2^(k-1), ... 1 for the least k with 2^k >= n."""
    return F.transform(F.sequence(F.greatest(F.ceil(F.log2(F.greatest(n, F.lit(2)))), F.lit(1)).cast("int"), F.lit(0), F.lit(-1)), lambda k: _power(k).cast("int"))


def _repeat(sorted_: Column, e: Column, p: Column, bits: Column) -> Column:
    """How many equal k-mers stand before place p of the sorted entries: binary search
    by halving steps."""

    def same(back: Column) -> Column:
        return (p >= back) & (_right(F.get(sorted_, p - back), bits) == _right(e, bits))

    search = F.aggregate(_halving(p), F.lit(0), lambda n, step: F.when(same(n + step), n + step).otherwise(n))
    return F.when(~same(F.lit(1)), 0).otherwise(search)


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with column name: array<int>, the SKETCHES coordinates of df[text]
    (never null).  A text without words has the coordinates of the empty tuple.

    An entry is a long: the upper bits of a k-mer's hash, and its place in the text.
    """
    keep = df.columns
    ring = F.array(*map(F.lit, RING))
    step = df.select(*keep, F.regexp_extract_all(text, F.lit(r"(\S{1,16})"), F.lit(1)).alias("_w"))
    bits = F.least(F.greatest(F.ceil(F.log2(F.size("_w") + 1)).cast("int"), F.lit(PLACE_BITS)), F.lit(MOST_BITS))
    step = step.select(*keep, F.transform("_w", lambda w: F.xxhash64(w)).alias("_w"), bits.alias("_b"))
    step = step.select(*keep, "_w", "_b", (_power(F.col("_b")) - 1).alias("_m"))

    def entry(h: Column, place: Column) -> Column:
        return h.bitwiseAND(F.bitwise_not("_m")).bitwiseOR(place)

    step = step.select(*keep, "_b", "_m", F.transform("_w", lambda w, i: entry(F.xxhash64(w, *(F.get("_w", i + d) for d in range(1, K))), i.cast("long"))).alias("_e"))
    step = step.select(*keep, "_b", "_m", F.sort_array("_e").alias("_s"))
    # A k-mer that repeats gets a new hash for each repeat, and the entries are sorted again.
    b = F.col("_b")
    again = F.transform("_s", lambda e, p: F.when((p > 0) & (_right(F.get("_s", p - 1), b) == _right(e, b)), entry(F.xxhash64(F.shiftright(e, MOST_BITS), _repeat(F.col("_s"), e, p, b)), e.bitwiseAND(F.col("_m")))).otherwise(e))
    step = step.select(*keep, "_m", again.alias("_v"))
    step = step.select(*keep, "_m", F.sort_array("_v").alias("_o"))
    step = step.select(*keep, "_m", "_o", F.greatest(F.size("_o"), F.lit(1)).alias("_n"), _halving(F.size("_o")).alias("_h"))
    # The entries below each point of the ring, by halving steps.
    below = F.transform(ring, lambda r: F.aggregate("_h", F.lit(0), lambda n, h: F.when((n + h <= F.col("_n")) & (F.get("_o", n + h - 1) < r), n + h).otherwise(n)))
    step = step.select(*keep, "_m", "_o", "_n", below.alias("_c"))
    pick = F.transform("_c", lambda c: F.array(*(F.get("_o", (c + t) % F.col("_n")) for t in range(TAKEN))))
    step = step.select(*keep, "_m", pick.alias("_x"))
    coordinate = F.transform("_x", lambda xs: F.shiftright(F.xxhash64(*_by_place(xs, F.col("_m"))), 32).cast("int"))
    return step.select(*keep, coordinate.alias(name))


def _by_place(xs: Column, places: Column) -> list[Column]:
    """The hashes of two entries, as they stand in the text."""
    x, y = F.get(xs, 0), F.get(xs, 1)
    straight = x.bitwiseAND(places) <= y.bitwiseAND(places)
    x, y = F.shiftright(x, MOST_BITS), F.shiftright(y, MOST_BITS)
    return [F.when(straight, x).otherwise(y), F.when(straight, y).otherwise(x)]


def as_string(coordinates: Column) -> Column:
    return F.array_join(F.transform(coordinates, lambda c: F.lpad(F.lower(F.hex(c.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, v: s + v) / F.lit(float(SKETCHES))


def _order_parts(docs: DataFrame) -> tuple[Column, Column, Column]:
    """Of _key and _hash, the part of the order that a row is in: its number among the
    driver's ranges of _key, the number within that range, and the parts of the range.

    A quantile of _key that occurs again and again is a frequent key.  It is a range by
    itself and has parts by _hash; between two quantiles, parts go by _key."""
    total = docs.count()
    n = max(1, min(QUANTILES, -(-total // PART_ROWS)))
    got = docs.select(F.percentile_approx("_key", [i / n for i in range(n + 1)], 10_000).alias("q")).first()["q"] or [0]
    bounds = sorted(set(got))
    each = max(1, min(-(-total // (n * PART_ROWS)), PARTS // (4 * n)))
    at = F.size(F.filter(F.lit(bounds).cast("array<long>"), lambda b: b <= F.col("_key")))
    on = F.coalesce(F.get(F.lit(bounds).cast("array<long>"), at - 1) == F.col("_key"), F.lit(False))
    often = F.get(F.lit([got.count(b) - 1 for b in bounds]), at - 1)  # quantiles that the key fills
    parts = F.when(on, F.greatest(often, F.lit(1)) * each).otherwise(F.lit(each))
    ends = F.lit([float(b) for b in [bounds[0], *bounds, bounds[-1]]])
    low, high = F.get(ends, at), F.get(ends, at + 1)
    by_key = F.when(high > low, (F.col("_key").cast("double") - low) / (high - low)).otherwise(0.0)
    by_hash = F.col("_hash").cast("double") / float(1 << 64) + 0.5
    within = F.floor(F.when(on, by_hash).otherwise(by_key) * parts)
    return 2 * at - on.cast("int"), F.least(F.greatest(within, F.lit(0)), parts - 1).cast("int"), parts


def in_order(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with _range, _part, _key, _hash and _guest.  Within a part, rows
    by (_guest, _key, _hash, text) are those by (_key, _hash, text) and then, as a guest,
    the row that follows the last; the first row of all follows the last of all.

    There are 2 PARTS parts at most, so the key of each part's first row is a table of a few
    MB that is broadcast: rows find out by themselves whether they are guests, and
    whole texts are dealt out once."""
    keyed = docs.withColumn("_key", F.coalesce(docs["doc_id"], F.lit(-(1 << 63)))).withColumn("_hash", F.xxhash64("text"))
    range_, part, _ = _order_parts(keyed)
    rows = keyed.withColumn("_range", range_).withColumn("_part", part)
    firsts = stored(docs.sparkSession, rows.groupBy("_range", "_part").agg(F.min(F.struct("_key", "_hash")).alias("first")), "part-firsts")
    # A row for each range, 2 QUANTILES + 2 at most.
    heads = sorted(firsts.groupBy("_range").agg(F.min("first").alias("first")).collect())
    following = docs.sparkSession.createDataFrame([(h["_range"], heads[(i + 1) % len(heads)]["first"]) for i, h in enumerate(heads)], firsts.select("_range", F.col("first").alias("after")).schema)
    ends = firsts.join(F.broadcast(following), "_range")
    after = F.coalesce(F.lead("first").over(Window.partitionBy("_range").orderBy("_part")), F.col("after"))
    ends = ends.select("_range", "_part", after.alias("next")).select("_range", "_part", F.col("next._key").alias("_key"), F.col("next._hash").alias("_hash"))
    # One row of those that share a place in the order is enough as a guest.
    guests = keyed.join(F.broadcast(ends), ["_key", "_hash"]).select(*rows.columns)
    guests = guests.groupBy("_range", "_part").agg(*(F.min(F.struct("text", *[c for c in rows.columns if c not in ("text", "_range", "_part")])).alias("g"),)).select(*(F.col(f"g.{c}") if c not in ("_range", "_part") else F.col(c) for c in rows.columns))
    return rows.withColumn("_guest", F.lit(False)).unionByName(guests.withColumn("_guest", F.lit(True)))


def fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next for every row of docs.

    The edited text has its last half (rounded down) replaced by as many first
    characters of the next document, or all of it.  Null text counts as empty.
    Repeated doc_ids stand in the order of their texts' hashes, null doc_id first; a
    lone row follows itself.  Two texts without words are alike (1.0).  Empty
    table: no rows.
    """
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text"))
    every = with_fingerprint(in_order(base), "text", "fp")
    w = Window.partitionBy("_range", "_part").orderBy("_guest", "_key", "_hash", "text")
    rows = every.select("doc_id", "text", "fp", "_guest", F.lead("text").over(w).alias("next_text"), F.lead("fp").over(w).alias("next_fp")).filter("not _guest")
    n = F.char_length("text")
    cut = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "fp", "next_fp", F.sha2("edited", 256).alias("edited_sha256"), "edited")
    rows = with_fingerprint(rows, "edited", "efp")
    return rows.select("doc_id", "n_chars", "edited_sha256", as_string(F.col("fp")).alias("fingerprint"), as_string(F.col("efp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
