"""DuckDB SQL for the scalars, written out by component."""

from __future__ import annotations

import math

from phaseloom.functions import ball, torus
from phaseloom.sources.adapters import KINDS, PHASE_SCALE

Vec = list[str]
PI, TURN, PHI = repr(math.pi), repr(torus.TURN), repr(torus.PHI)


def vec(name: str, n: int) -> Vec:
    return [f"{name}{i}" for i in range(1, n + 1)]


def r(x: str, places: int) -> str:
    return f"floor(({x}) * 1e{places} + 0.5) / 1e{places}"


def add(terms: Vec) -> str:
    return "(" + " + ".join(terms) + ")"


def dot(u: Vec, v: Vec) -> str:
    return add([f"({a}) * ({b})" for a, b in zip(u, v, strict=True)])


def norm(u: Vec) -> str:
    return f"sqrt({dot(u, u)})"


def scaled(u: Vec, k: str) -> Vec:
    return [f"({a}) * ({k})" for a in u]


def project(u: Vec) -> Vec:
    m = repr(1 - ball.BOUNDARY)
    return [f"CASE WHEN {norm(u)} <= {m} THEN {a} ELSE ({a}) * ({m} / {norm(u)}) END" for a in u]


def room(u: Vec) -> str:
    return f"greatest(1e-12, 1 - {dot(u, u)})"


def gap(u: Vec, v: Vec) -> str:
    return add([f"(({a}) - ({b})) * (({a}) - ({b}))" for a, b in zip(u, v, strict=True)])


def gamma(u: Vec, v: Vec) -> str:
    return f"(1 + 2 * {gap(u, v)} / ({room(u)} * {room(v)}))"


def distance(u: Vec, v: Vec) -> str:
    return f"acosh(greatest(1.0, {gamma(u, v)}))"


def depth(u: Vec) -> str:
    return f"(2 * atanh(least({1 - ball.BOUNDARY!r}, {norm(u)})))"


def turn(a: str) -> str:
    return f"(CASE WHEN (({a}) % {TURN}) < 0 THEN (({a}) % {TURN}) + {TURN} ELSE (({a}) % {TURN}) END)"


def wrap(a: str) -> str:
    m = f"(({a}) % {TURN})"
    return f"(CASE WHEN {m} > {PI} THEN {m} - {TURN} WHEN {m} <= -{PI} THEN {m} + {TURN} ELSE {m} END)"


def torus_distance(a: Vec, b: Vec, weighted: bool) -> str:
    w = torus.scale_weights(len(a)) if weighted else [1.0] * len(a)
    return "sqrt(" + add([f"{x!r} * {x!r} * {wrap(f'{p} - {q}')} * {wrap(f'{p} - {q}')}" for x, p, q in zip(w, a, b, strict=True)]) + ")"


def resonance(a: Vec, b: Vec) -> str:
    powers = [f"power({PHI}, -{i}.0)" for i in range(len(a))]
    return r(add([f"{p} * cos({wrap(f'{x} - {y}')})" for p, x, y in zip(powers, a, b, strict=True)]) + " / " + add(powers), 6)


def regulator(x: str) -> str:
    return r(f"greatest({torus.FLOOR}, 1 - {torus.GAIN} * power(greatest(0.0, {x}), {torus.SHARPNESS}))", 6)


def shift(a: Vec, b: Vec) -> str:
    d = [wrap(f"{x} - {y}") for x, y in zip(a, b, strict=True)]
    return f"atan2({add([f'sin({x})' for x in d])}, {add([f'cos({x})' for x in d])})"


def draw(seed: str, k: str) -> str:
    """The k-th draw (from 1) of a seed, in 128-bit integers cut to 32 bits."""
    word = lambda x: f"(({x}) % 4294967296::HUGEINT)"
    s = word(f"{seed}::HUGEINT + {k}::HUGEINT * 1831565813::HUGEINT")
    one = word("xor(s, s >> 15) * (s | 1::HUGEINT)")
    two = word("xor(t, t >> 7) * (t | 61::HUGEINT)")
    two = f"xor(t, {word('t + ' + two)})"
    return f"(SELECT CAST(xor(z, z >> 14) AS DOUBLE) / 4294967296.0::DOUBLE FROM (SELECT {two} AS z FROM (SELECT {one} AS t FROM (SELECT {s} AS s))))"


_F = [f"CAST(embedding[{i}] AS DOUBLE)" for i in (1, 2, 3)]

#: ord, id, topic, b1..b3, t1..t8: the rows of adapters.charts.
CHARTS = f"""
f AS (SELECT vec_id AS ord, printf('v%06d', vec_id) AS id, CAST(label AS BIGINT) AS topic, embedding,
             {', '.join(f'{x} AS f{i + 1}' for i, x in enumerate(_F))} FROM embeddings),
g AS (SELECT *, {', '.join(f"CASE WHEN {norm(vec('f', 3))} > 1 THEN f{i} * (0.9 / {norm(vec('f', 3))}) ELSE f{i} * 0.9 END AS g{i}" for i in (1, 2, 3))} FROM f),
charts AS (SELECT ord, id, topic,
    {', '.join(f"CASE WHEN {norm(vec('g', 3))} < 1e-12 THEN 0.0 ELSE g{i} * (tanh({norm(vec('g', 3))}) / {norm(vec('g', 3))}) END AS b{i}" for i in (1, 2, 3))},
    {', '.join(f"{turn(f'CAST(embedding[{i + 3}] AS DOUBLE) * {torus.TURN / 2 * PHASE_SCALE!r}')} AS t{i}" for i in range(1, 9))}
    FROM g)"""

#: Neighbours by number: a point (u, s) and its successor (v, t).
PAIRS = CHARTS + f""",
pairs AS (SELECT x.id, {', '.join(f'x.b{i} AS u{i}, y.b{i} AS v{i}' for i in (1, 2, 3))},
    {', '.join(f'x.t{i} AS s{i}, y.t{i} AS t{i}' for i in range(1, 9))} FROM charts x JOIN charts y ON y.ord = x.ord + 1)"""

LEDGER = f"""
ledger AS (SELECT event_id AS seq,
    CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items())} ELSE 'about' END AS kind,
    'u' || CAST(user_id AS VARCHAR) AS src, 'k' || json_extract_string(props, '$.k') AS dst,
    value / 50 AS weight, epoch_us(ts) / 1000000.0 AS ts FROM events)"""

KEY_GRAPH = LEDGER + """,
steps AS (SELECT seq AS pos, dst AS src, lead(dst) OVER (PARTITION BY src ORDER BY seq) AS dst FROM ledger),
edges AS (SELECT * FROM steps WHERE dst IS NOT NULL)"""

TREE_GRAPH = """
edges AS (
    SELECT CAST(n_nationkey AS BIGINT) AS pos, 'r' || CAST(n_regionkey AS VARCHAR) AS src, 'n' || CAST(n_nationkey AS VARCHAR) AS dst FROM nation
    UNION ALL
    SELECT s_suppkey + 1000, 'n' || CAST(s_nationkey AS VARCHAR), 's' || CAST(s_suppkey AS VARCHAR) FROM supplier)"""

CHART_GRAPH = """
edges AS (
    SELECT vec_id AS pos, printf('v%06d', CAST(floor(vec_id / 3) AS BIGINT)) AS src, printf('v%06d', vec_id) AS dst FROM embeddings WHERE vec_id > 0
    UNION ALL
    SELECT vec_id + 1000000000, printf('v%06d', vec_id), printf('v%06d', vec_id + 1) FROM embeddings
    WHERE vec_id % 5 < 3 AND vec_id + 1 IN (SELECT vec_id FROM embeddings))"""

DISTINCT = """
sound AS (SELECT *, least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> '' AND dst <> '' AND src <> dst),
uniq AS (SELECT pos, src, dst, a, b FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY pos) AS n FROM sound) WHERE n = 1),
near AS (SELECT a AS u, b AS v FROM uniq UNION SELECT b, a FROM uniq),
nodes AS (SELECT DISTINCT u AS id FROM near)"""

COMPONENTS = """
reach(id, other) AS (SELECT id, id FROM nodes UNION SELECT reach.id, near.v FROM reach JOIN near ON near.u = reach.other),
comp AS (SELECT id, min(other) AS component FROM reach GROUP BY id)"""


def hops(sources: str, most: int) -> str:
    """CTEs walk and hop (source, id, hops) from a query for (source)."""
    return f"""
walk(source, id, h) AS (SELECT source, source, 0 FROM ({sources}) UNION SELECT walk.source, near.v, walk.h + 1 FROM walk JOIN near ON near.u = walk.id WHERE walk.h < {most}),
hop AS (SELECT source, id, min(h) AS hops FROM walk GROUP BY source, id)"""


def queue(name: str, sources: str, levels: int, near: str, own: str = "") -> str:
    """CTEs <name> (source, id, hops, rank, parent): the order in which a breadth-first
    search dequeues nodes, level by level.  near: a table (u, v, pos); own: a table (source, u, v, pos)."""
    ctes = [f"{name}0 AS (SELECT source, source AS id, 0 AS hops, 1 AS rank, 0 AS parent FROM ({sources}))"]
    for h in range(1, levels + 1):
        seen = " UNION ALL ".join(f"SELECT source, id, hops, rank, parent FROM {name}{i}" for i in range(h))
        step = f"SELECT f.source, n.v AS id, f.rank, n.pos FROM {name}{h - 1} f JOIN {near} n ON n.u = f.id"
        if own:
            step += f" UNION ALL SELECT f.source, n.v, f.rank, n.pos FROM {name}{h - 1} f JOIN {own} n ON n.u = f.id AND n.source = f.source"
        ctes.append(f"{name}_s{h} AS (SELECT source, id, min(row(rank, pos)) AS f, min(rank) AS parent FROM ({step}) GROUP BY source, id)")
        ctes.append(f"{name}_b{h} AS ({seen})")
        ctes.append(f"{name}{h} AS (SELECT s.source, s.id, {h} AS hops, (SELECT count(*) FROM {name}_b{h} b WHERE b.source = s.source) + row_number() OVER (PARTITION BY s.source ORDER BY s.f) AS rank, s.parent FROM {name}_s{h} s WHERE NOT EXISTS (SELECT 1 FROM {name}_b{h} b WHERE b.source = s.source AND b.id = s.id))")
    every = " UNION ALL ".join(f"SELECT source, id, hops, rank, parent FROM {name}{i}" for i in range(levels + 1))
    return ", ".join([*ctes, f"{name} AS ({every})"])


def walked(name: str, order: str, want: str, budget: int) -> str:
    """CTE <name>: evidence walks of targets want (source, id) along a queue."""
    return f"""
{name}_t AS (SELECT w.source, count(*) AS targets, count(q.hops) AS reached, coalesce(sum(q.hops), 0) AS s, max(q.parent) AS last FROM {want} w LEFT JOIN {order} q ON q.source = w.source AND q.id = w.id GROUP BY w.source),
{name} AS (SELECT t.source, {r('reached / targets', 4)} AS coverage, CASE WHEN reached = 0 THEN 0.0 ELSE {r('s / reached', 4)} END AS mean_hops, {r(f'(s + (targets - reached) * {budget + 1}) / targets', 4)} AS effective_hops, CASE WHEN reached = targets THEN last ELSE (SELECT count(*) FROM {order} q WHERE q.source = t.source) END AS expanded, reached, targets FROM {name}_t t)"""


def aggregated(walks: str) -> str:
    """One row over walks: coverage, mean_hops, effective_hops, expanded, reached, targets."""
    return f"SELECT {r('sum(reached) / sum(targets)', 4)} AS coverage, CASE WHEN sum(reached) = 0 THEN 0.0 ELSE {r('sum(mean_hops * reached) / sum(reached)', 4)} END AS mean_hops, {r('sum(effective_hops) / count(*)', 4)} AS effective_hops, CAST(sum(expanded) AS BIGINT) AS expanded, CAST(sum(reached) AS BIGINT) AS reached, CAST(sum(targets) AS BIGINT) AS targets FROM {walks}"


def compared(base: str, bridged: str, queries: str, spent: str) -> str:
    """The row of compare_traversal."""
    names = ("coverage", "mean_hops", "effective_hops", "expanded", "reached", "targets")
    return f"""SELECT {', '.join(f'x.{c} AS base_{c}' for c in names)}, {', '.join(f'y.{c} AS bridged_{c}' for c in names)}, CAST((SELECT count(*) FROM {queries}) AS INTEGER) AS queries,
    {r('y.coverage - x.coverage', 4)} AS delta_coverage, {r('y.effective_hops - x.effective_hops', 4)} AS delta_effective_hops, y.expanded - x.expanded AS delta_expanded, CAST((SELECT count(*) FROM {spent}) AS INTEGER) AS edges_spent FROM ({aggregated(base)}) x, ({aggregated(bridged)}) y"""
