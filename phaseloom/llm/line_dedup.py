"""Line dedup (operator 3) by pairwise alignment.

The unit that documents share is a *key*: a shortest run of whole lines with
LEAST_WORDS words or more, from each line onwards and back from each line.  A line
of that many words is a key by itself, a shorter one only together with its
neighbours, so keys are rare where lines of a word or two are not.  Two documents
have a common block of LEAST_WORDS words if and only if they share a key, and
such a block is covered by the keys they share.

A key of up to RARE rows pairs all of its documents.  A more frequent one pairs
each later document with the first that has it, which is n - 1 entries for n rows:
every shared key is in a pair of its later document, however frequent it is.

Within a pair, patience diff aligns the lines: keys that stand once in both documents
are the anchors, of which the longest sequence that rises in both is taken; between
two anchors the same is done with the keys that repeat.  Aligned lines that follow
each other in both documents are a block.  Blocks of LEAST_WORDS words are deleted
from the later document.  Text that is common but in another order isn't aligned;
of it, only passages of MOVED_WORDS words or more are deleted.
"""

from __future__ import annotations

import bisect
import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phaseloom.llm.common import released, stored, text_or_empty

#: Keys of an Arrow batch, about.
KEY_ROWS = 10_000
#: Words of a common block at least; of one that isn't in order; rows of a key that pairs all with all.
LEAST_WORDS, MOVED_WORDS, RARE = 8, 30, 8

Anchor = tuple[int, int]  # places in the later and in the earlier document


def patience(anchors: list[Anchor]) -> list[Anchor]:
    """A longest sequence of anchors that rises in both places."""
    anchors = sorted(anchors, key=lambda x: (x[0], -x[1]))  # of one place, only one can be taken
    tails: list[int] = []
    tops: list[int] = []
    back = [-1] * len(anchors)
    for i, (_, b) in enumerate(anchors):
        k = bisect.bisect_left(tails, b)
        back[i] = tops[k - 1] if k else -1
        if k == len(tails):
            tails.append(b)
            tops.append(i)
        else:
            tails[k], tops[k] = b, i
    out, i = [], tops[-1] if tops else -1
    while i >= 0:
        out.append(anchors[i])
        i = back[i]
    return out[::-1]


def aligned(unique: Iterable[Anchor], repeated: Iterable[Anchor]) -> list[Anchor]:
    """The alignment of a pair: a rising sequence of the unique anchors, and in each gap
    between two of them a rising sequence of the repeated ones that fit there."""
    spine = patience(list(unique))
    firsts = [a for a, _ in spine]
    gaps: dict[int, list[Anchor]] = defaultdict(list)
    for a, b in repeated:
        k = bisect.bisect_left(firsts, a)
        if (k == len(spine) or (spine[k][0] > a and spine[k][1] > b)) and (not k or spine[k - 1][1] < b):
            gaps[k].append((a, b))
    return sorted(spine + [x for g in gaps.values() for x in patience(g)])


def blocks(anchors: Iterable[Anchor]) -> list[list[Anchor]]:
    """Runs of anchors that follow each other in both documents."""
    out: list[list[Anchor]] = []
    for a, b in sorted(anchors, key=lambda x: (x[0] - x[1], x[0])):
        if out and out[-1][-1] == (a - 1, b - 1):
            out[-1].append((a, b))
        else:
            out.append([(a, b)])
    return out


def common_lines(keys: Iterable[tuple[int, int, list[int], bool]], least_words: int = LEAST_WORDS, moved_words: int = MOVED_WORDS) -> set[int]:
    """The lines (places among those that aren't blank) that a later document loses to
    one earlier document.  keys: what both share, as place in the later one, place in the
    earlier one, words of each line, and whether it stands once in both."""
    words: dict[int, int] = {}
    unique: set[Anchor] = set()
    every: set[Anchor] = set()
    for a, b, sizes, once in keys:
        for i, n in enumerate(sizes):
            words[a + i] = n
            every.add((a + i, b + i))
            if once:
                unique.add((a + i, b + i))
    total = lambda block: sum(words[a] for a, _ in block)
    chosen = aligned(unique, every - unique)
    gone = {a for block in blocks(chosen) if total(block) >= least_words for a, _ in block}
    taken, given = {a for a, _ in chosen}, {b for _, b in chosen}
    left = (x for x in every if x[0] not in taken and x[1] not in given)
    return gone | {a for block in blocks(left) if total(block) >= moved_words for a, _ in block}


def key_runs(sizes: list[int], least_words: int) -> list[tuple[int, int]]:
    """Of lines with so many words, the shortest runs [i, j) of least_words or more from
    each line onwards and back from each line."""
    upto = [0]
    for n in sizes:
        upto.append(upto[-1] + n)
    out, end, start = set(), 0, 0
    for i in range(len(sizes)):
        while end < len(sizes) and upto[end] - upto[i] < least_words:
            end += 1
        if upto[end] - upto[i] >= least_words:
            out.add((i, end))
    for j in range(1, len(sizes) + 1):
        while upto[j] - upto[start + 1] >= least_words:
            start += 1
        if upto[j] - upto[start] >= least_words:
            out.add((start, j))
    return sorted(out)


KEYS = "key long, hash long, place int, words array<int>, once boolean, h1 long, h2 long"


def key_rows(docs: DataFrame, least_words: int) -> DataFrame:
    """KEYS: a row for every key of every document (key, hash, text).  The nth repeat of a
    key in a document counts as a key of its own."""

    def rows(cols, digest) -> pa.RecordBatch:
        h = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
        kinds = (("key", pa.int64()), ("hash", pa.int64()), ("place", pa.int32()), ("words", pa.list_(pa.int32())), ("once", pa.bool_()))
        return pa.RecordBatch.from_arrays([*(pa.array(cols[n], t) for n, t in kinds), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], ["key", "hash", "place", "words", "once", "h1", "h2"])

    @released
    def run(batches):
        cols, digest = defaultdict(list), []
        for b in batches:
            for key, th, text in zip(*(b.column(c).to_pylist() for c in ("key", "hash", "text")), strict=True):
                lines = [x for line in text.split("\n") if (x := line.strip())]
                sizes = [len(x.split()) for x in lines]
                runs = key_runs(sizes, least_words)
                texts = [lines[i] if j == i + 1 else "\n".join(lines[i:j]) for i, j in runs]
                times, seen = Counter(texts), Counter()
                for (i, j), x in zip(runs, texts, strict=True):
                    digest.append(hashlib.blake2b(b"%d\n%s" % (seen[x], x.encode("utf-8", "surrogatepass")), digest_size=16).digest())
                    seen[x] += 1
                    for name, v in (("key", key), ("hash", th), ("place", i), ("words", sizes[i:j]), ("once", times[x] == 1)):
                        cols[name].append(v)
                if len(digest) > KEY_ROWS:
                    yield rows(cols, digest)
                    cols, digest = defaultdict(list), []
        yield rows(cols, digest)

    return docs.mapInArrow(run, KEYS)


_ROW = ("key", "hash", "place", "words", "once")


def _entries(spark: SparkSession, keys: DataFrame, groups: DataFrame) -> DataFrame:
    """A row for each key that a later document shares with an earlier one of its pairs:
    key, hash (the later), place, words, first_key, first_hash, first_place, once."""
    # Stored, so that nothing above this join needs a key's rows together, and only rare keys are gathered.
    shared = stored(spark, keys.join(groups.hint("merge"), ["h1", "h2"]), "shared")
    before = lambda x, y: (x["key"] < y["key"]) | ((x["key"] == y["key"]) & (x["hash"] < y["hash"]))

    def entry(later: Column, first: Column) -> Column:
        return F.struct(later["key"].alias("key"), later["hash"].alias("hash"), later["place"].alias("place"), later["words"].alias("words"), first["key"].alias("first_key"), first["hash"].alias("first_hash"), first["place"].alias("first_place"), (later["once"] & first["once"]).alias("once"))

    own = F.struct(*_ROW)
    often = shared.filter(F.col("n") > RARE).filter(before(F.col("first"), own)).select(entry(own, F.col("first")).alias("e"))
    held = shared.filter(F.col("n") <= RARE).groupBy("h1", "h2").agg(F.collect_list(own).alias("held"))  # RARE rows at most
    pairs = F.flatten(F.transform("held", lambda y: F.transform(F.filter("held", lambda x: before(x, y)), lambda x: entry(y, x))))
    return often.unionByName(held.select(F.explode(pairs).alias("e"))).select("e.*")


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with _key (doc_id, null last) and _hash (of the text)."""
    return docs.withColumn("_key", F.coalesce(docs["doc_id"].cast("long"), F.lit((1 << 63) - 1))).withColumn("_hash", F.xxhash64(text_or_empty(docs)))


def deletion_table(spark: SparkSession, docs: DataFrame, least_words: int = LEAST_WORDS, moved_words: int = MOVED_WORDS) -> DataFrame:
    """_key, _hash, _deleted array<int> (places of lines): for every document that loses lines."""
    keyed = _keyed(docs)
    keys = stored(spark, key_rows(keyed.select(F.col("_key").alias("key"), F.col("_hash").alias("hash"), text_or_empty(docs).alias("text")), least_words), "keys")
    # Stored, so that both sides of the join are dealt out for it alone and a hot key can be split.
    groups = keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("key", "hash", "place", "once"), F.struct("key", "hash", "place")).alias("first")).filter("n > 1")
    groups = stored(spark, groups, "shared-keys")

    @F.pandas_udf("array<int>")
    def choose(entries: pd.Series) -> pd.Series:
        def one(rows) -> list[int]:
            pairs = defaultdict(set)
            for r in rows:
                pairs[(r["first_key"], r["first_hash"])].add((r["place"], r["first_place"], tuple(r["words"]), r["once"]))
            return sorted(set().union(*(common_lines(p, least_words, moved_words) for p in pairs.values())))

        return entries.map(one)

    own = _entries(spark, keys, groups).groupBy("key", "hash").agg(F.collect_list(F.struct("place", "words", "first_key", "first_hash", "first_place", "once")).alias("entries"))
    chosen = own.select(F.col("key").alias("_key"), F.col("hash").alias("_hash"), choose("entries").alias("_deleted"))
    return stored(spark, chosen.filter(F.size("_deleted") > 0), "deletions")


def dedup_lines(spark: SparkSession, docs: DataFrame, least_words: int = LEAST_WORDS, moved_words: int = MOVED_WORDS) -> DataFrame:
    """docs with cleaned text and the column _lines_deleted.

    The earlier document (lesser doc_id, null last, then the text's hash) keeps a
    common block.  Rows equal in doc_id and text are one document.  Null text
    stays null.  Lines are compared without white space at their ends; blank
    lines are left out of account and stay.  Columns named _key, _hash, _deleted or
    _lines_deleted are replaced; others stay.  Empty table: no rows.
    """

    @F.pandas_udf("string")
    def without(text: pd.Series, deleted: pd.Series) -> pd.Series:
        def one(t, d):
            if t is None or d is None or not len(d):
                return t
            gone, place, left = set(np.asarray(d).tolist()), 0, []
            for line in t.split("\n"):
                if not line.strip():
                    left.append(line)
                    continue
                if place not in gone:
                    left.append(line)
                place += 1
            return "\n".join(left)

        return pd.Series([one(t, d) for t, d in zip(text, deleted, strict=True)], dtype=object)

    docs = docs.drop("_key", "_hash", "_deleted", "_lines_deleted")
    found = deletion_table(spark, docs, least_words, moved_words)
    joined = _keyed(docs).join(found.hint("merge"), ["_key", "_hash"], "left")
    text = without(F.col("text").cast("string"), F.col("_deleted"))
    return joined.withColumn("_lines_deleted", F.coalesce(F.size("_deleted"), F.lit(0))).withColumn("text", text).drop("_key", "_hash", "_deleted")


def left_over(docs: DataFrame) -> DataFrame:
    """Of dedup_lines' rows, those with text left or without deletions."""
    return docs.filter((F.col("_lines_deleted") <= 0) | (F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) > 0))
