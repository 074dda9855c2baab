"""Graph structure: edges are (pos, src, dst); pos orders them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phaseloom.functions.ball import rounded
from phaseloom.plans.shared import cut, ranked, stored


def edge_key(a: Column, b: Column) -> Column:
    return F.concat_ws(" ", F.least(a, b), F.greatest(a, b))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Without self-loops, empty ends and undirected repeats; the first stays as it is."""
    e = edges.filter("src <> '' and dst <> '' and src <> dst").withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst"))
    first = e.groupBy("a", "b").agg(F.min(F.struct("pos", "src", "dst")).alias("f"))
    return first.select(F.col("f.pos").alias("pos"), F.col("f.src").alias("src"), F.col("f.dst").alias("dst"))


def node_set(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """(u, v) both ways, distinct; edges may be an adjacency themselves."""
    if edges.columns == ["u", "v"]:
        return edges
    e = edges.filter("src <> '' and dst <> '' and src <> dst")
    return e.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(e.select("dst", "src")).distinct()


#: So many distinct edges or fewer are joined up in one task instead of in rounds.
FEW_EDGES = 200_000


def _joined_up(pdf: pd.DataFrame) -> pd.DataFrame:
    up: dict[str, str] = {}

    def top(x: str) -> str:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in zip(pdf["a"], pdf["b"], strict=True):
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return pd.DataFrame({"id": list(up), "component": [top(x) for x in list(up)]}, dtype=object)


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id of the component, by alternating stars."""
    e = edges.filter("src <> '' and dst <> '' and src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct()
    now = cut(e)
    if now.count() <= FEW_EDGES:
        return cut(now.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(lambda pdf: _joined_up(pdf), "id string, component string"))
    mark = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "u")
        large = both.join(least, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(low, F.col("a") == F.col("u")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("u", "m")).distinct()
        now = cut(small)
        last, mark = mark, now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if last == mark:
            break
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select("b", "b")).distinct()


#: Of searches on few edges: sources of a block; rows that a block may give; rows of edges, copied for every block.
BLOCK_SOURCES, BLOCK_FOUND, COPIED = 16, 1 << 21, 1 << 24


class Arrays:
    """A graph in one task.  names: of near's nodes (u, v) and the others given; from first[i] to
    first[i + 1] lie node i's neighbours in heads, and what near has as pos in pos."""

    def __init__(self, near: pd.DataFrame, *others: pd.Series) -> None:
        parts = [near["u"], near["v"], *others]
        codes, self.names = pd.factorize(np.concatenate([np.asarray(p, dtype=object) for p in parts]), use_na_sentinel=False)
        u, v, *self.others = np.split(codes, np.cumsum([len(p) for p in parts])[:-1])
        order = np.argsort(u, kind="stable")
        self.heads = v[order]
        self.pos = near["pos"].to_numpy(dtype=np.int64)[order] if "pos" in near else None
        self.first = np.searchsorted(u[order], np.arange(len(self.names) + 1))

    def out_of(self, front: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in front, places in heads) of all neighbours of some nodes."""
        span = self.first[front + 1] - self.first[front]
        start = np.repeat(self.first[front] - np.cumsum(span) + span, span)
        return np.repeat(np.arange(len(front)), span), start + np.arange(len(start))

    def levels(self, source: int, most: int | None = None, own: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[np.ndarray]:
        """The nodes found at each level from 1 on.  own: more edges, from and to."""
        seen = np.zeros(len(self.names), dtype=bool)
        seen[source] = True
        front, level = np.array([source]), 0
        while len(front) and (most is None or level < most):
            level += 1
            step = self.heads[self.out_of(front)[1]]
            if own is not None:
                step = np.concatenate([step, own[1][np.isin(own[0], front)]])
            front = np.unique(step[~seen[step]])
            seen[front] = True
            if len(front):
                yield front


def in_blocks(near: DataFrame, asked: DataFrame, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame | None:
    """kernel's rows for each block of asked's sources (asked: source and more) with all of
    near (u, v and more, both ways).  None if near has more than FEW_EDGES edges, or would be
    copied too often: then searches go in rounds."""
    size = near.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("u").alias("nodes")).crossJoin(asked.agg(F.count_distinct("source").alias("sources"))).first()
    slices = int(near.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, min(slices, -(-size["sources"] // BLOCK_SOURCES)), -(-size["sources"] * (size["nodes"] + 1) // BLOCK_FOUND))
    if size["rows"] > 2 * FEW_EDGES or blocks * size["rows"] > COPIED:
        return None
    one = asked.withColumn("_block", F.pmod(F.hash("source"), F.lit(blocks)))
    two = near.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return one.groupBy("_block").cogroup(two.groupBy("_block")).applyInPandas(kernel, schema)


def _searched(asked: pd.DataFrame, near: pd.DataFrame, most: int | None) -> pd.DataFrame:
    """hops of a block.  asked: the sources, with u and v missing, and edges that only a
    source may use."""
    sources, extra = asked[asked["u"].isna()], asked[asked["u"].notna()]
    g = Arrays(near, sources["source"], extra["u"], extra["v"])
    at, u, v = g.others
    rows = extra.reset_index(drop=True).groupby("source").indices
    start, times = dict(zip(sources["source"], at, strict=True)), Counter(sources["source"])
    found = {"source": [np.empty(0, dtype=object)], "id": [np.empty(0, dtype=object)], "hops": [np.empty(0, dtype=np.int32)]}
    for source, i in start.items():
        own = (u[rows[source]], v[rows[source]]) if source in rows else None
        for level, nodes in enumerate([np.repeat(i, times[source]), *g.levels(i, most, own)]):
            found["source"].append(np.full(len(nodes), source, dtype=object))
            found["id"].append(g.names[nodes])
            found["hops"].append(np.full(len(nodes), level, dtype=np.int32))
    return pd.DataFrame({k: np.concatenate(x) for k, x in found.items()})


def _met(asked: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
    """source, id, hops of a block's pairs (source, id), -1 if unreachable."""
    asked = asked[["source", "id"]].reset_index(drop=True)
    g = Arrays(near, asked["source"], asked["id"])
    at, to = g.others
    out = np.full(len(asked), -1, dtype=np.int32)
    for rows in asked.groupby("source").indices.values():
        i = at[rows[0]]
        out[rows[to[rows] == i]] = 0
        left = rows[to[rows] != i]
        for level, nodes in enumerate(g.levels(i), 1):
            here = np.isin(to[left], nodes)
            out[left[here]] = level
            left = left[~here]
            if not len(left):
                break
    return asked.assign(hops=out)


def _on_cycles(pdf: pd.DataFrame) -> pd.DataFrame:
    """The edges (a, b) on some cycle: all but those whose end, in a depth-first walk, leads
    back to no node before it."""
    m = len(pdf)
    codes, names = pd.factorize(np.concatenate([pdf["a"].to_numpy(dtype=object), pdf["b"].to_numpy(dtype=object)]))
    near: list[list[tuple[int, int]]] = [[] for _ in names]
    for e, (a, b) in enumerate(zip(codes[:m].tolist(), codes[m:].tolist(), strict=True)):
        near[a].append((b, e))
        near[b].append((a, e))
    when, low, cycle, now = [0] * len(names), [0] * len(names), np.ones(m, dtype=bool), 0
    for root in range(len(names)):
        if when[root]:
            continue
        now += 1
        when[root] = low[root] = now
        path = [(root, -1, iter(near[root]))]
        while path:
            node, came, rest = path[-1]
            for other, e in rest:
                if e == came:
                    continue
                if when[other]:
                    low[node] = min(low[node], when[other])
                    continue
                now += 1
                when[other] = low[other] = now
                path.append((other, e, iter(near[other])))
                break
            else:
                path.pop()
                if path:
                    up = path[-1][0]
                    low[up] = min(low[up], low[node])
                    cycle[came] = low[node] <= when[up]
    return pdf[cycle][["a", "b"]]


def graph_invariants(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, components, cycle_rank, cycle_density."""
    e = distinct_edges(edges)
    v = components(edges).agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("component").alias("components"))
    row = e.agg(F.count(F.lit(1)).alias("edges")).crossJoin(v)
    rank = F.greatest(F.lit(0).cast("long"), F.col("edges") - F.col("nodes") + F.col("components"))
    return row.select("nodes", "edges", "components", rank.alias("cycle_rank"), rounded(rank / F.greatest(F.lit(1), F.col("edges")), 4).alias("cycle_density"))


def cycle_basis(edges: DataFrame) -> DataFrame:
    """The distinct edges with chord (boolean): those that a greedy forest in order of
    pos leaves out.  That forest is the minimum spanning forest by pos, so it
    grows by Boruvka rounds: each component takes its first edge outwards."""
    e = cut(distinct_edges(edges))
    label = node_set(e).withColumn("c", F.col("id"))
    tree = None
    while True:
        lab = label.select(F.col("id").alias("src"), F.col("c").alias("cs"))
        lab2 = label.select(F.col("id").alias("dst"), F.col("c").alias("cd"))
        between = e.join(lab, "src").join(lab2, "dst").filter("cs <> cd").select("pos", "src", "dst", "cs", "cd")
        best = between.select(F.col("cs").alias("c"), "pos", "src", "dst").union(between.select("cd", "pos", "src", "dst")).groupBy("c").agg(F.min(F.struct("pos", "src", "dst")).alias("f"))
        chosen = cut(best.select("f.*").distinct())
        if chosen.isEmpty():
            break
        tree = chosen if tree is None else cut(tree.union(chosen).distinct())
        label = cut(components(tree).withColumnRenamed("component", "c").unionByName(node_set(e).join(node_set(tree), "id", "left_anti").withColumn("c", F.col("id"))))
    if tree is None:
        return e.withColumn("chord", F.lit(False))
    return e.join(tree.withColumn("in_tree", F.lit(True)), ["pos", "src", "dst"], "left").select("pos", "src", "dst", F.col("in_tree").isNull().alias("chord"))


def homology(walks: DataFrame, basis: DataFrame) -> DataFrame:
    """Signed crossings per walk and chord: walk_id, chord (number by pos), crossings.
    walks: walk_id, k, id."""
    number = ranked(basis.filter("chord").select("pos", "src", "dst"), "pos", "chord").select("src", "dst", "chord")
    step = walks.withColumn("was", F.lag("id").over(Window.partitionBy("walk_id").orderBy("k"))).filter("was is not null and was <> id")
    keyed = number.select("chord", F.col("src").alias("from"), F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    hit = step.withColumn("a", F.least("was", "id")).withColumn("b", F.greatest("was", "id")).join(keyed, ["a", "b"])
    return hit.groupBy("walk_id", "chord").agg(F.sum(F.when(F.col("was") == F.col("from"), 1).otherwise(-1)).alias("crossings"))


def same_recurrence_class(crossings: DataFrame, one: int, two: int) -> DataFrame:
    """One row: whether two walks have equal signed crossings."""
    sides = crossings.filter(F.col("walk_id").isin(one, two)).groupBy("chord").agg(F.sum(F.when(F.col("walk_id") == one, F.col("crossings")).otherwise(0)).alias("x"), F.sum(F.when(F.col("walk_id") == two, F.col("crossings")).otherwise(0)).alias("y"))
    return sides.agg((F.count(F.when(F.col("x") != F.col("y"), 1)) == 0).alias("same"))


def _tour(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """r, tail, rev, next, first: every tree edge's two arcs (tail to head), numbered by
    (tail, head), in a closed walk along the tree.  After an arc comes the one that leaves
    its head for the neighbour that follows its tail; next is null at the end of a tree's
    walk, which begins with the first arc of its root.  first: whether the arc is its
    tail's first."""
    arcs = tree.select(F.col("src").alias("tail"), F.col("dst").alias("head")).union(tree.select("dst", "src"))
    arcs = cut(ranked(arcs.select(F.struct("tail", "head").alias("k")), "k", "r").select("r", "k.tail", "k.head"))
    ends = arcs.groupBy("tail").agg(F.min("r").alias("low"), F.max("r").alias("high"))
    after = arcs.join(ends, "tail").select("tail", "head", "r", "low", F.when(F.col("r") < F.col("high"), F.col("r") + 1).otherwise(F.col("low")).alias("turn"))
    reverse = after.select(F.col("head").alias("tail"), F.col("tail").alias("head"), F.col("r").alias("rev"), F.col("turn").alias("next"))
    starts = roots.join(ends, roots["id"] == ends["tail"]).select(F.col("low").alias("next"), F.lit(True).alias("begins"))
    walk = after.select("tail", "head", "r", (F.col("r") == F.col("low")).alias("first")).join(reverse, ["tail", "head"]).join(starts, "next", "left")
    return walk.select("r", "tail", "rev", F.when(F.col("begins").isNull(), F.col("next")).alias("next"), "first")


def non_bridge_edges(edges: DataFrame) -> DataFrame:
    """(a, b), a < b: the edges on some cycle.  FEW_EDGES distinct edges or fewer go to one task.

    Chords of a spanning forest are.  A tree edge is if a chord joins both sides of it:
    each chord has a 64-bit tag, and the tags of the chords' ends that lie on one side,
    added up without carry, leave those of the chords between the sides.  Arcs after
    an arc, in a walk along the tree, and arcs after its reverse, differ by just one side,
    so the tags after every arc are all that is needed.  They come by doubling: each
    round joins an arc with the one it points at, for as many rounds as the logarithm of
    the longest walk.  That no chord is overlooked is certain but for 2^-64 an edge."""
    e = cut(distinct_edges(edges).select("pos", "src", "dst", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")))
    if e.count() <= FEW_EDGES:
        return cut(e.select("a", "b", F.lit(0).alias("all")).groupBy("all").applyInPandas(lambda pdf: _on_cycles(pdf), "a string, b string"))
    basis = cut(cycle_basis(e))
    chords, tree = basis.filter("chord"), basis.filter("not chord").select("src", "dst")
    tag = F.xxhash64("src", "dst")
    at = chords.select(F.col("src").alias("tail"), tag.alias("tag")).union(chords.select("dst", tag)).groupBy("tail").agg(F.bit_xor("tag").alias("tag"))
    roots = components(tree).filter("id = component").select("id")
    walk = cut(_tour(tree, roots).join(at, "tail", "left").select("r", "tail", "rev", "next", F.when(F.col("first"), F.col("tag")).otherwise(0).alias("own")).na.fill(0, ["own"]))
    own = walk.select(F.col("r").alias("next"), F.col("own").alias("beyond"))
    now = stored(walk.join(own, "next", "left").select("r", "next", F.coalesce("beyond", F.lit(0)).alias("after")))
    while not now.filter("next is not null").isEmpty():
        far = now.select(F.col("r").alias("next"), F.col("next").alias("far"), F.col("after").alias("beyond"))
        step = now.filter("next is not null").join(far, "next").select("r", F.col("far").alias("next"), F.col("after").bitwiseXOR(F.col("beyond")).alias("after"))
        now = stored(step.unionByName(now.filter("next is null")))
    sides = walk.select("r", "rev", "tail").join(now.select("r", "after"), "r").join(now.select(F.col("r").alias("rev"), F.col("after").alias("other")), "rev")
    heads = walk.select(F.col("r").alias("rev"), F.col("tail").alias("head"))
    covered = sides.filter("after <> other").join(heads, "rev").filter("tail < head").select(F.col("tail").alias("a"), F.col("head").alias("b"))
    return covered.union(chords.select(F.least("src", "dst"), F.greatest("src", "dst")))


def hops(edges: DataFrame, sources: DataFrame, most: int | None = None, extra: DataFrame | None = None) -> DataFrame:
    """(source, id, hops) for all nodes reached from sources (source), breadth
    first: in blocks of sources if edges are few, or else one join of the frontier a level.
    extra: edges (source, u, v) that only that source may use.  Ends when a level finds
    nothing, or at ``most`` hops."""
    near = adjacency(edges)
    near = near if near is edges else cut(near)
    own, asked = None, sources.select("source", F.lit(None).cast("string").alias("u"), F.lit(None).cast("string").alias("v"))
    if extra is not None:
        own = cut(extra.select("source", "u", "v").union(extra.select("source", "v", "u")).distinct())
        asked = asked.union(own)
    at_once = in_blocks(near, asked, lambda one, two: _searched(one, two, most), "source string, id string, hops int")
    if at_once is not None:
        return at_once
    seen = cut(sources.select("source", F.col("source").alias("id"), F.lit(0).alias("hops")))
    front, level = seen, 0
    while most is None or level < most:
        level += 1
        step = front.join(near, F.col("id") == F.col("u")).select("source", F.col("v").alias("id"))
        if own is not None:
            step = step.union(front.join(own.withColumnRenamed("u", "id"), ["source", "id"]).select("source", F.col("v").alias("id")))
        front = cut(step.distinct().join(seen, ["source", "id"], "left_anti").withColumn("hops", F.lit(level)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def pair_hops(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source, id, hops) of given pairs (source, id), -1 if unreachable.  If edges are few, in
    blocks of sources, or else one search for 64 sources at a time: a node holds a bit for each
    that has come to it, so a level takes a row a node for every 64 sources, not one for each.
    Ends when all pairs are met, or at a level that finds nothing."""
    near = adjacency(edges)
    near = near if near is edges else stored(near)
    at_once = in_blocks(near, pairs.select("source", "id").distinct(), lambda one, two: _met(one, two), "source string, id string, hops int")
    if at_once is not None:
        return at_once
    number = ranked(pairs.select(F.col("source").alias("k")).distinct(), "k", "n").select(F.col("k").alias("source"), F.floor(F.col("n") / 64).alias("block"), F.expr("shiftleft(1L, cast(n % 64 as int))").alias("bit"))
    asked = stored(pairs.select("source", "id").distinct().join(number, "source"))
    zero = F.lit(0).cast("long")
    met = asked.filter("id = source").select("source", "id", F.lit(0).alias("hops"))
    state = stored(number.select("block", F.col("source").alias("id"), "bit").groupBy("block", "id").agg(F.bit_or("bit").alias("seen")).withColumn("new", F.col("seen")))
    left, level = asked.filter("id <> source").count(), 0
    while left:
        level += 1
        come = state.filter("new <> 0").join(near, F.col("id") == F.col("u")).select("block", F.col("v").alias("id"), zero.alias("seen"), "new")
        both = state.select("block", "id", "seen", zero.alias("new")).unionByName(come).groupBy("block", "id").agg(F.bit_or("seen").alias("was"), F.bit_or("new").alias("come"))
        state = stored(both.select("block", "id", F.col("was").bitwiseOR(F.col("come")).alias("seen"), F.col("come").bitwiseAND(F.bitwise_not("was")).alias("new")))
        if state.filter("new <> 0").isEmpty():
            break
        here = cut(asked.join(state.filter("new <> 0"), ["block", "id"]).filter(F.col("new").bitwiseAND(F.col("bit")) != 0).select("source", "id", F.lit(level).alias("hops")))
        left, met = left - here.count(), met.unionByName(here)
    return asked.select("source", "id").join(met, ["source", "id"], "left").withColumn("hops", F.coalesce("hops", F.lit(-1)))


def delta_hyperbolicity(edges: DataFrame, sample: int = 32) -> DataFrame:
    """One row: delta, over all quadruples of the first ``sample`` nodes."""
    ids = node_set(distinct_edges(edges)).orderBy("id").limit(sample)
    chosen = cut(ids)
    d = hops(edges, chosen.withColumnRenamed("id", "source")).join(chosen, "id", "left_semi")
    n = node_set(distinct_edges(edges)).limit(4).count()
    d = cut(d)
    pair = lambda x, y, h: d.select(F.col("source").alias(x), F.col("id").alias(y), F.col("hops").alias(h))
    q = pair("x", "y", "xy").filter("x < y").join(pair("x", "u", "xu"), "x").filter("y < u").join(pair("y", "u", "yu"), ["y", "u"])
    q = q.join(pair("x", "v", "xv"), "x").filter("u < v").join(pair("y", "v", "yv"), ["y", "v"]).join(pair("u", "v", "uv"), ["u", "v"])
    s = F.sort_array(F.array(F.col("xy") + F.col("uv"), F.col("xu") + F.col("yv"), F.col("xv") + F.col("yu")), asc=False)
    best = q.agg(F.coalesce(F.max((s[0] - s[1]) / 2.0), F.lit(0.0)).alias("delta"))
    return best.select(rounded(F.when(F.lit(n) < 4, 0.0).otherwise(F.col("delta")), 4).alias("delta"))


def curvature_signature(edges: DataFrame, invariants: DataFrame | None = None) -> DataFrame:
    """One row: delta, cycle_rank, tree_likeness, cycle_density, hyperbolic, toroidal.
    invariants: the edges' graph_invariants, if they are at hand."""
    row = (graph_invariants(edges) if invariants is None else invariants).crossJoin(delta_hyperbolicity(edges))
    likeness = 1 / (1 + F.col("delta"))
    tree = F.when(F.col("edges") > 0, (F.col("edges") - F.col("cycle_rank")) / F.greatest(F.lit(1), F.col("edges"))).otherwise(1.0)
    h = tree * likeness
    t = F.col("cycle_rank") / (F.col("cycle_rank") + F.greatest(F.lit(1).cast("long"), F.col("components")))
    both = F.when(h + t == 0, 1.0).otherwise(h + t)
    return row.select("delta", "cycle_rank", rounded(likeness, 4).alias("tree_likeness"), "cycle_density", rounded(h / both, 4).alias("hyperbolic"), rounded(t / both, 4).alias("toroidal"))
