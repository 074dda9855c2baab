"""Operators on planted micro fixtures."""

from __future__ import annotations

import datetime
import math
import random
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from phaseloom.functions import draws
from phaseloom.functions.torus import PHI
from phaseloom.operators import bridges, charts, graph, kernels, ledger, metrics, proposals, recovery
from phaseloom.plans import atlas, corpora
from phaseloom.plans import experiments as X
from phaseloom.plans.shared import ranked

SQUARE = [("0", "1"), ("1", "2"), ("2", "3"), ("3", "0")]
CHAINS = [("u0", "u1"), ("u1", "u2"), ("u2", "u3"), ("u0", "v0"), ("v0", "v1"), ("v1", "v2"), ("v2", "v3")]
PLANTED = {"u0": (0, 0), "u1": (0.2, 0), "u2": (0.4, 0), "u3": (0.6, 0), "v0": (0, 0.3), "v1": (-0.3, 0.3), "v2": (-0.55, 0.3), "v3": (0.6, 0.02)}


@pytest.fixture(scope="module")
def edges(spark):
    return lambda pairs: spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "pos long, src string, dst string")


@pytest.fixture(scope="module")
def events(spark):
    return lambda rows: spark.createDataFrame(rows, atlas.EVENT_SCHEMA)


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([(i, k, [float(x) for x in v], [0.0] * 8) for i, (k, v) in enumerate(PLANTED.items())], "ord long, id string, ball array<double>, torus array<double>")


def test_fold(events):
    e = events([(i, "assoc", "a", "b", None, float(i)) for i in range(3)] + [(3, "causal", "a", "b", 0.7, 9.0), (4, "assoc", "a", "a", 1.0, 1.0), (5, "assoc", "", "b", 1.0, 1.0), (6, "assoc", "b", "a", -4.0, None)])
    got = {(r.src, r.dst, r.kind): r.weight for r in ledger.fold_events(e).collect()}
    assert got == pytest.approx({("a", "b", "assoc"): 1 + 1 / PHI + PHI**-2, ("a", "b", "causal"): 0.7, ("b", "a", "assoc"): 0.0})
    many = events([(i, "assoc", "a", "b", 4.0, float(-i)) for i in range(200)])
    assert ledger.fold_events(many).first().weight == 5.0
    assert ledger.fold_events(events([])).count() == 0


def test_phases_tell_rhythms_apart(events):
    rows, seq = [], 0
    for name, step, offset, n in (("a", 100, 0, 40), ("b", 100, 0, 40), ("c", 317, 50, 13)):
        for i in range(n):
            rows.append((seq, "assoc", name, f"x{seq}", 1.0, float(offset + i * step)))
            seq += 1
    p = {r.id: r.phases for r in ledger.node_phases(events(rows)).collect()}
    assert set(p) == {"a", "b", "c"}
    assert X.torus_distance(p["a"], p["b"]) < X.torus_distance(p["a"], p["c"])
    assert ledger.node_phases(events([])).count() == 0
    assert ledger.node_phases(events([(0, "assoc", "a", "b", 1.0, 5.0), (1, "assoc", "a", "b", 1.0, 5.0)])).count() == 0


def test_split_and_future(events):
    e = events([(0, "assoc", "a", "b", 1.0, 10.0), (1, "assoc", "b", "c", 1.0, 10.0), (2, "assoc", "a", "c", 1.0, 99.0), (3, "assoc", "a", "zzz", 1.0, 99.0)])
    train, test, cut = ledger.split_events(e, 0.5)
    assert cut == 10 and train.count() == 2 and test.count() == 2
    assert [tuple(r) for r in ledger.future_links(train, test).collect()] == [("a", "c")]
    assert ledger.split_events(events([]), 0.5)[2] is None


@pytest.mark.parametrize(("pairs", "rank", "parts"), [([("0", "1"), ("1", "2"), ("2", "3"), ("3", "4")], 0, 1), (SQUARE, 1, 1), ([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "z"), ("z", "x")], 2, 2), ([("a", "b"), ("b", "a"), ("a", "a")], 0, 1)])
def test_invariants(edges, pairs, rank, parts):
    r = graph.graph_invariants(edges(pairs)).first()
    assert (r.cycle_rank, r.components) == (rank, parts)


def test_structure_on_random_graphs(spark, edges):
    rng = random.Random(3)
    for _ in range(2):
        pairs = list({tuple(sorted(rng.sample(range(14), 2))) for _ in range(18)})
        pairs = [(f"n{a:02d}", f"n{b:02d}") for a, b in pairs]
        g = X.Graph(pairs)
        on_cycle = {tuple(sorted(p)) for p in pairs if p[1] in X.Graph([q for q in pairs if q != p]).hops(p[0])}
        assert {tuple(r) for r in graph.non_bridge_edges(edges(pairs)).collect()} == on_cycle
        up = {n: n for p in pairs for n in p}

        def top(x, up=up):
            return x if up[x] == x else top(up[x])

        chords = []
        for p in pairs:
            a, b = map(top, p)
            if a == b:
                chords.append(p)
            up[a] = b
        basis = graph.cycle_basis(edges(pairs))
        assert {(r.src, r.dst) for r in basis.filter("chord").collect()} == set(chords)
        hop = {(r.source, r.id): r.hops for r in graph.hops(edges(pairs), spark.createDataFrame([("n00",), ("n05",)], "source string")).collect()}
        assert hop == {(s, n): h for s in ("n00", "n05") for n, h in g.hops(s).items()}


def test_components_in_rounds_and_at_once(edges, monkeypatch):
    rng = random.Random(5)
    e = edges([(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(30)] + [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(20)])
    at_once = {tuple(r) for r in graph.components(e).collect()}
    monkeypatch.setattr(graph, "FEW_EDGES", 0)
    assert {tuple(r) for r in graph.components(e).collect()} == at_once and at_once


def test_homology(spark, edges):
    basis = graph.cycle_basis(edges(SQUARE))
    steps = {1: "01230", 2: "01210", 3: "03210", 4: "012301230"}
    w = spark.createDataFrame([(i, k, c) for i, s in steps.items() for k, c in enumerate(s)], "walk_id long, k int, id string")
    got = {r.walk_id: r.crossings for r in graph.homology(w, basis).collect()}
    assert got[1] == -got[3] != 0 and got[4] == 2 * got[1] and got.get(2, 0) == 0


def test_delta_and_signature(edges):
    tree = [("r", "a"), ("r", "b"), ("a", "c"), ("a", "d"), ("b", "e"), ("b", "f")]
    k4 = [("0", "1"), ("1", "2"), ("2", "3"), ("3", "0"), ("0", "2"), ("1", "3")]
    assert graph.delta_hyperbolicity(edges(tree)).first().delta == 0
    assert graph.delta_hyperbolicity(edges(SQUARE)).first().delta > 0
    assert graph.delta_hyperbolicity(edges(k4)).first().delta == 0
    s = graph.curvature_signature(edges(k4)).first()
    assert s.cycle_rank == 3 and s.toroidal > s.hyperbolic
    assert graph.curvature_signature(edges(tree)).first().toroidal == 0


def test_bridges(points, edges):
    r = bridges.bridge_edges(points, edges(CHAINS), scoring="ball").orderBy("geo").collect()
    top = [x for x in r if {x.a, x.b} == {"u3", "v3"}][0]
    assert top.hops == 7 and top.gain == 6 and top.considered == 28 and top.fold is None


def test_query_bridges_as_the_small_graph_version(spark):
    f = X.fit("ring")
    c = f["corpus"]
    p = spark.createDataFrame([(n, f["balls"][n], f["tori"][n]) for n in c["nodes"]], "id string, ball array<double>, torus array<double>")
    e = spark.createDataFrame([(i, a, b) for i, (a, b, *_) in enumerate(c["edges"])], "pos long, src string, dst string")
    src = ["n0_0", "n3_4"]
    got = bridges.query_bridges(p, e, spark.createDataFrame([(s,) for s in src], "source string"), count=3, diversify=True).orderBy("a", "place").collect()
    assert [(r.a, r.b) for r in got] == [x for s in src for x in X.query_bridges(s, f["balls"], f["tori"], f["graph"], count=3, diversify=True)]


def test_walks(spark, edges):
    q = spark.createDataFrame([("u3", ["v3", "v2"]), ("u0", [])], "source string, targets array<string>")
    far = {r.source: r for r in metrics.evidence_walks(edges(CHAINS), q, 4).collect()}
    assert far["u3"].coverage == 0 and far["u3"].effective_hops == 5 and far["u0"].coverage == 1 and far["u0"].expanded == 0
    near = {r.source: r for r in metrics.evidence_walks(edges(CHAINS), q, 7).collect()}["u3"]
    assert (near.coverage, near.mean_hops) == (1, 6.5)
    b = spark.createDataFrame([(0, "u3", "v3")], "pos long, a string, b string")
    with_ = {r.source: r for r in metrics.evidence_walks(edges(CHAINS), q, 4, b).collect()}["u3"]
    assert (with_.coverage, with_.mean_hops) == (1, 1.5)


def test_walks_expand_as_a_queue(spark, edges):
    rng = random.Random(7)
    pairs = [(f"n{rng.randrange(12):02d}", f"n{rng.randrange(12):02d}") for _ in range(20)]
    ids = sorted({n for p in pairs for n in p})
    queries = [(s, rng.sample(ids, 3)) for s in ids[:6]]
    got = {r.source: r.asDict() for r in metrics.evidence_walks(edges(pairs), spark.createDataFrame(queries, "source string, targets array<string>"), 3).collect()}
    for s, t in queries:
        assert got[s] == {"source": s} | X.walk(X.Graph(pairs), s, t, 3)


def test_contradictions(edges, spark):
    e = edges(CHAINS).selectExpr("*", "'derived' as kind").union(spark.createDataFrame([(99, "u3", "v3", "contradicts")], "pos long, src string, dst string, kind string"))
    r = metrics.contradiction_exposure(e, 3).first()
    assert r.pairs == 1 and r.rate < 1
    assert metrics.contradiction_exposure(e, 7).first().rate == 1
    assert tuple(metrics.contradiction_exposure(e.filter("kind = 'derived'")).first()) == (0.0, 0, 0)


def test_charts(spark, points):
    seq = spark.createDataFrame([(i, k, [float(a)]) for i, s in enumerate(((0, 0.3, -0.2, 0.1, 0), (0, 2, 4, 6, 0), (1,))) for k, a in enumerate(s)], "traj long, k int, vec array<double>")
    assert {r.traj: r.invariant for r in charts.recognition_invariant(seq).collect()} == {0: [0], 1: [1], 2: [0]}
    assert {r.traj: r.closest for r in charts.metric_return(seq).collect()} == {0: 0.0, 1: 0.0, 2: math.inf}
    nodes = spark.createDataFrame([(0, "a", [1.0] * 8), (1, "b", None), (2, "c", [0.0] * 8), (3, "a", None)], "ord long, id string, phases array<double>")
    m = charts.torus_map(nodes).collect()
    assert {r.id: r.placed for r in m} == {"a": True, "b": False, "c": False}
    assert charts.hyper_neighbors(points, "u0", 2).first().id == "u1" and charts.hyper_neighbors(points, "nobody").count() == 0
    d = charts.atlas_drift(points, points).first()
    assert tuple(d) == (0.0, 0.0, 0)


def test_disagreements(spark):
    pad = lambda x: [x, x, *[0.0] * 6]
    p = spark.createDataFrame([(0, "p", [0.0, 0.0], pad(0.0)), (1, "q", [0.9, 0.0], pad(0.05)), (2, "r", [0.02, 0.0], pad(3.0)), (3, "s", [0.4, 0.4], pad(1.5))], "ord long, id string, ball array<double>, torus array<double>")
    got = {r["list"]: {r.a, r.b} for r in charts.disagreements(p, top_k=1).collect()}
    assert got == {"same_rhythm_diff_lineage": {"p", "q"}, "same_lineage_drift_phase": {"p", "r"}}


def test_recovery(spark):
    series = {"decay": [0.2 * math.exp(-0.5 * t) for t in range(8)], "quiet": [0.00001, 0.00001, *[0.3 * math.exp(-0.4 * t) for t in range(6)]], "short": [0.1, 0.2], "step": [0.001, 0.3, 0.1, 0.02, 0.005], "flat": [0.001] * 3, "up": [0.1, 0.3, 0.9]}
    d = spark.createDataFrame([(k, t, x) for k, s in series.items() for t, x in enumerate(s)], "series string, t int, drift double")
    rate = {r.series: r.rate for r in recovery.recovery_rate(d).collect()}
    assert rate["decay"] == pytest.approx(0.5) and rate["quiet"] == pytest.approx(0.4) and rate["short"] is None
    back = {r.series: r.builds for r in recovery.recovery_time(d).collect()}
    assert back["step"] == 3 and back["flat"] == 0 and back["up"] is None
    effort = {r.series: (r.epochs, r.lr) for r in recovery.regulate(d).collect()}
    assert effort["up"] == (200, 0.01) and effort["flat"][0] in (20, 21)
    pairs = spark.createDataFrame([("up", "a", "b", 3.0, 0.1)], "series string, a string, b string, ball double, torus double")
    assert sorted(r.kind for r in recovery.stop_loss(d, pairs).filter("series = 'up'").collect()) == ["diverging", "reroll", "runaway_lineage"]


def test_kernels():
    assert kernels.fnv1a("a") == 0xE40C292C
    r = kernels.mulberry32(42)
    assert r() == pytest.approx(0.6011037519201636)
    fit = kernels.hyper_map([], [("root", "mid", "derived", 1.0), ("mid", "leaf", "derived", 1.0)], epochs=400)
    depth = {n: math.hypot(*p) for n, p in fit["points"].items()}
    assert depth["root"] < depth["mid"] < depth["leaf"] < 1
    assert kernels.numeric_leaves({"b": [1, {"c": 2}], "a": True, "d": None}) == [("b[0]", 1.0), ("b[1].c", 2.0)]
    assert kernels.canonical_json({"b": 1.0, "a": [0.5, None, "é"]}) == '{"a":[0.5,null,"é"],"b":1}'
    assert len(kernels.content_hash("x")) == 16
    edges = [(a, b, "assoc", 2.0) for a, b in (("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"))]
    cold = kernels.hyper_map([], edges)
    warm = kernels.temporal_hyper_map([], [*edges, ("a", "f", "assoc", 2.0)], cold["points"])
    assert warm["new_nodes"] == ["f"] and warm["drift"]["mean"] < 0.25 and warm["points"]["e"] == cold["points"]["e"]


@pytest.mark.parametrize(("topology", "arm", "recall", "hops", "topic"), [("ring", "baseline", 0.241, 4.61, None), ("ring", "geometry+div", 0.588, 3.14, 63), ("ring", "random", 0.639, 3.47, None), ("ring", "hub", 0.560, 3.67, None), ("ring", "resonance", 0.611, 3.01, 72), ("star", "geometry+div", 0.657, 3.10, 58), ("star", "resonance", 0.648, 2.94, 71), ("star", "random", 0.667, 3.42, None)])
def test_published_figures(topology, arm, recall, hops, topic):
    f = X.fit(topology)
    makers = X._makers(f, 3)
    r = X.run_arms(f, {arm: makers[arm]} if arm in makers else {})[-1]
    assert r["coverage"] == pytest.approx(recall, abs=6e-4) and r["effective_hops"] == pytest.approx(hops, abs=6e-3)
    assert topic is None or r["on_topic"] == topic


def test_ranked(spark):
    d = spark.createDataFrame([(f"k{i:03d}",) for i in range(100)], "id string").repartition(7)
    assert [(r.id, r["rank"]) for r in ranked(d, "id").orderBy("id").collect()] == [(f"k{i:03d}", i) for i in range(100)]


def test_the_flagship_compares_with_all_users(spark):
    from phaseloom.functions import torus as T
    from phaseloom.plans.kernel_queries import flagship
    from phaseloom.sources import adapters

    folder = "/root/testdata/sf0.1"
    p = ledger.node_phases(adapters.ledger(spark, folder)).filter("id like 'u%'")
    at = {r.id: np.array(r.torus) for r in p.select("id", T.phases_to_torus(F.col("phases")).alias("torus")).collect()}
    ids = sorted(at)
    tori, w = np.array([at[i] for i in ids]), np.array(T.scale_weights())
    got = {}
    for r in flagship(spark, folder).collect():
        got.setdefault(r.a, {})[r.place] = (r.b, r.dist)
    assert len(ids) > charts.TORUS_NODES and sorted(got) == [i for i in ids if int(i[1:]) % 100 == 0]
    for i in got:
        turned = (tori - at[i] + np.pi) % (2 * np.pi) - np.pi
        d = np.sqrt(((w * turned) ** 2).sum(1))
        d[ids.index(i)] = np.inf
        assert sorted(got[i]) == [1, 2, 3, 4, 5] and [got[i][k][1] for k in range(1, 6)] == pytest.approx(np.sort(d)[:5], abs=2e-5)


def test_draws_are_those_of_the_generator(spark):
    seeds = spark.createDataFrame([(s,) for s in (0, 1, 42, 4294967295)], "s long")
    for r in seeds.select("s", *(draws.draw(F.col("s"), F.lit(k)).alias(f"d{k}") for k in (1, 2, 3))).collect():
        one = kernels.mulberry32(r.s)
        assert list(r)[1:] == [one(), one(), one()] == kernels.draws(r.s, 3).tolist()
    names = spark.createDataFrame([(s,) for s in ("a", "u12", "é", "")], "s string")
    for r in names.select("s", draws.hash_direction(F.col("s"), 3).alias("v"), draws.sample(draws.fnv1a(F.col("s")), F.lit(4).cast("long"), 6).alias("p")).collect():
        assert r.v == pytest.approx(kernels.hash_direction(r.s, 3)) and r.p == kernels._sample(list(range(4)), 6, kernels.fnv1a(r.s))


@pytest.mark.parametrize("ring", [False, True])
def test_corpora_as_tables_and_as_values(spark, ring):
    c = X.synthetic_corpus(topology="ring" if ring else "star")
    got = corpora.corpus_nodes(spark).orderBy("ord").collect()
    assert [(r.id, r.topic, r.phases) for r in got] == [(n, c["topics"][n], c["phases"][n]) for n in c["nodes"]]
    assert [(r.src, r.dst, r.kind) for r in corpora.corpus_edges(spark, ring=ring).orderBy("pos").collect()] == [e[:3] for e in c["edges"]]


def test_planted_ledger(spark):
    rows = [tuple(r) for r in corpora.ledger(spark, topics=3, per_topic=3, cycles=4, future_per_topic=2).orderBy("seq").collect()]
    assert [r[0] for r in rows] == list(range(len(rows))) and len(rows) == 4 * 8 + 6
    assert [r[1:4] for r in rows[:8]] == [("derived", "t0_0", "t1_0"), ("derived", "t0_1", "t1_1"), ("assoc", "t0_0", "t0_1"), ("derived", "t0_2", "t1_2"), ("assoc", "t0_1", "t0_2"), ("derived", "t1_0", "t2_0"), ("derived", "t1_1", "t2_1"), ("derived", "t1_2", "t2_2")]
    assert [r[5] for r in rows[:8]] == [0, 1, 1, 2, 2, 33, 34, 35] and rows[8][5] == 100
    assert rows[-2:] == [(36, "assoc", "t2_0", "t2_2", 1.0, 410.0), (37, "assoc", "t2_1", "t2_0", 1.0, 411.0)]


def test_proposals_as_the_small_graph_version(spark, edges):
    c = X.synthetic_corpus(topology="ring")
    pairs, g = [(a, b) for a, b, *_ in c["edges"]], X.Graph(c["edges"])
    ids = spark.createDataFrame([(n,) for n in c["nodes"]], "id string")
    src = ids.withColumnRenamed("id", "source")
    own = lambda df, *names: {s: [r[1] for r in sorted(rows)] for s, rows in _by(df, *names).items()}
    got = own(proposals.random_query_bridges(src, ids, edges(pairs), 3), "a", "place", "b")
    assert got == {n: [b for _, b in kernels.random_query_bridges(n, c["nodes"], g.pairs, 3)] for n in c["nodes"]}
    got = own(proposals.random_proposals(src, ids, 6), "source", "place", "other")
    assert got == {n: [b for _, b in kernels.random_proposals(n, c["nodes"], 6)] for n in c["nodes"]}
    assert [(r.a, r.b) for r in proposals.random_bridges(ids, edges(pairs), 8).orderBy("place").collect()] == kernels.random_bridges(c["nodes"], g.pairs, 8)
    got = own(proposals.hub_query_bridges(src, edges(pairs), 3), "a", "place", "b")
    assert got == {n: [b for _, b in X.hub_query_bridges(n, g, 3)] for n in c["nodes"]}


def _by(df, key: str, *names: str) -> dict:
    out: dict = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(tuple(r[c] for c in names))
    return out


def test_hub_bridges_beyond_a_clique(edges):
    """The first 20 by rank are all tied to each other, so pairs come from behind them."""
    clique = [(f"c{i:02d}", f"c{j:02d}") for i in range(20) for j in range(i)]
    pairs = clique + [("x", "y")]
    got = [(r.a, r.b) for r in proposals.hub_bridges(edges(pairs), 4).orderBy("place").collect()]
    assert got == [("c00", "x"), ("c00", "y"), ("c01", "x"), ("c01", "y")]
    assert proposals.hub_bridges(edges(clique), 4).count() == 0


def test_neighbours_of_a_vector(points):
    assert charts.hyper_neighbors(points, [0.6, 0.01], 2).count() == 2 and charts.hyper_neighbors(points, [0.0] * 3).count() == 0
    assert [r.id for r in charts.hyper_neighbors(points, [0.0, 0.0], 1).collect()] == ["u0"]
    assert charts.torus_neighbors(points, [0.0] * 8, 50).count() == 8


def test_a_cycle_in_a_long_path(edges):
    pairs = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(300)] + [("p010", "p250"), ("q0", "q1")]
    got = {tuple(r) for r in graph.non_bridge_edges(edges(pairs)).collect()}
    assert got == {(f"p{i:03d}", f"p{i + 1:03d}") for i in range(10, 250)} | {("p010", "p250")}


def test_all_queries_meet_all_rows(spark, monkeypatch):
    from phaseloom.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK_ROWS", 3)
    q, r = spark.range(8).withColumnRenamed("id", "q"), spark.range(11).withColumnRenamed("id", "r")
    assert sorted(map(tuple, blocks.against_all(q, r, "q", "r").select("q", "r").collect())) == [(i, j) for i in range(8) for j in range(11)]


def test_series_of_equal_values_tie_on_the_frontier(spark, tmp_path):
    """Means that are added up in another order differ in their last digit."""
    from phaseloom.plans import table_queries

    rng = random.Random(5)
    values = [round(rng.uniform(0, 130), 2) for _ in range(60)]
    orders = [rng.sample(values, 60) for _ in range(4)]
    rows = [(60 * u + i, datetime.datetime(2024, 1, 1), u, "click", x, '{"k": 1}') for u, own in enumerate(orders) for i, x in enumerate(own)]
    rows += [(1000, datetime.datetime(2024, 1, 1), 9, "click", max(values), '{"k": 1}'), (1001, datetime.datetime(2024, 1, 1), 9, "click", 0.0, '{"k": 1}')]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert len({reduce(lambda s, x: s + x / 50 / 10, own, 0.0) for own in orders}) > 1
    means = table_queries.drift_series(spark, str(tmp_path)).filter("series <> 'u9'").groupBy("series").agg(table_queries.steady_mean("drift").alias("m"))
    assert means.select("m").distinct().count() == 1
    got = {r.series for r in table_queries.a5_frontier(spark, str(tmp_path)).collect()}
    assert sum(values) / 60 > max(values) / 2 and got == {"u0", "u1", "u2", "u3"}
    odd = spark.createDataFrame([("a", 1e300), ("a", 1.0), ("b", float("nan")), ("c", None), ("d", -2.5)], "series string, x double")
    told = {r.series: r.m for r in odd.groupBy("series").agg(table_queries.steady_mean("x").alias("m")).collect()}
    assert told["a"] == 5e299 and math.isnan(told["b"]) and told["c"] is None and told["d"] == -2.5


def test_walks_that_reach_nothing_are_summed_up_as_in_sql(spark, tmp_path):
    """Eight nodes further apart than six hops."""
    import duckdb

    from phaseloom.plans import table_queries

    rng = random.Random(2)
    rows = [(100_000 + 50_021 * i, i % 3, [rng.uniform(-0.5, 0.5) for _ in range(64)]) for i in range(8)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = table_queries.m3_aggregate_walks(spark, str(tmp_path))
    with duckdb.connect() as c:
        c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
        want = c.execute(table_queries.ORACLE_SQL["m3_aggregate_walks"]).fetchall()
    assert got.columns == ["coverage", "mean_hops", "effective_hops", "reached", "targets"]
    assert [tuple(map(str, r)) for r in got.collect()] == [tuple(map(str, r)) for r in want] == [("0.0", "nan", "7.0", "0", "32")]


def test_bridges_search_hops_for_the_chosen_pairs_alone(spark, edges, monkeypatch):
    """No search without a bound, and the same hops as that search has."""
    rng = random.Random(4)
    pairs = [(f"n{rng.randrange(i):03d}", f"n{i:03d}") for i in range(1, 90)] + [("x0", "x1")]
    e, src = edges(pairs), spark.createDataFrame([(f"n{i:03d}",) for i in range(90)], "source string")
    ids = graph.node_set(e)
    want = {(r.source, r.id): r.hops for r in graph.hops(e, src).collect()}
    got = {(r.source, r.id): r.hops for r in graph.pair_hops(e, src.crossJoin(ids)).collect()}
    assert len(got) == 90 * 92 and got == {k: want.get(k, -1) for k in got}
    whole, bounds = bridges.hops, []
    monkeypatch.setattr(bridges, "hops", lambda edges, sources, most=None, extra=None: bounds.append(most) or whole(edges, sources, most, extra))
    p = ids.select("id", F.array(*(F.rand(i) / 2 for i in range(3))).alias("ball"), F.array(*(F.rand(9 + i) * 6 for i in range(8))).alias("torus"))
    p = spark.createDataFrame(p.collect(), p.schema)
    found = bridges.query_bridges(p, e, src.limit(5), count=4).collect()
    assert len(found) == 20 and bounds and None not in bounds
    near = p.alias("x").crossJoin(p.alias("y")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.ball").alias("ball_a"), F.col("x.torus").alias("torus_a"), F.col("y.ball").alias("ball_b"), F.col("y.torus").alias("torus_b"))
    geo = {(r.a, r.b): r.g for r in near.select("a", "b", bridges.geometry("resonance", (1.0, 1.0), {}).alias("g")).collect()}
    for a in {r.a for r in found}:
        best = sorted((g, b) for (x, b), g in geo.items() if x == a and not 0 <= want.get((a, b), -1) < 3)[:4]
        assert [r.b for r in sorted((r for r in found if r.a == a), key=lambda r: r.place)] == [b for _, b in best]


def test_searches_on_few_edges_are_those_in_rounds(spark, edges, monkeypatch):
    """One job for all levels, and the same rows as a join a level has."""
    rng = random.Random(11)
    pairs = [(f"n{rng.randrange(40):02d}", f"n{rng.randrange(40):02d}") for _ in range(45)] + [("x0", "x1"), ("x0", "x0"), ("", "n01")]
    e, ids = edges(pairs), [f"n{i:02d}" for i in range(40)] + ["x0", "gone"]
    src = spark.createDataFrame([(n,) for n in ids], "source string")
    own = spark.createDataFrame([("n01", 1, "n01", "x1"), ("n02", 1, "n07", "x0"), ("gone", 1, "gone", "n03"), ("n02", 2, "n02", "far")], "source string, pos long, a string, b string")
    extra = own.selectExpr("source", "a as u", "b as v")
    made = {
        "hops": lambda: graph.hops(e, src),
        "near": lambda: graph.hops(graph.adjacency(e), src, 2),
        "extra": lambda: graph.hops(e, src, 4, extra),
        "none": lambda: graph.hops(e.limit(0), src.limit(3)),
        "pairs": lambda: graph.pair_hops(e, src.crossJoin(src.withColumnRenamed("source", "id"))),
        "walk": lambda: metrics.ordered_walk(e, src, 3, spark.createDataFrame([(0, "n09", "x1"), (1, "n09", "n10")], "pos long, a string, b string"), own),
        "cycles": lambda: graph.non_bridge_edges(e),
    }
    rows = lambda: {k: sorted(map(tuple, f().collect())) for k, f in made.items()}
    whole, cuts = graph.cut, []
    monkeypatch.setattr(graph, "cut", lambda df: cuts.append(1) or whole(df))
    graph.hops(e, src).count()
    assert len(cuts) == 1  # two a level before
    at_once = rows()
    monkeypatch.setattr(graph, "FEW_EDGES", 0)
    in_rounds = rows()
    assert at_once == in_rounds and all(at_once.values())
    monkeypatch.setattr(graph, "FEW_EDGES", 200_000)
    monkeypatch.setattr(graph, "BLOCK_FOUND", 50)
    assert sorted(map(tuple, graph.hops(e, src).collect())) == in_rounds["hops"]
