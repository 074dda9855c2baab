"""One query for every scalar, over neighbouring points of the charts adapter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phaseloom.functions import ball as B
from phaseloom.functions import torus as T
from phaseloom.functions.ball import rounded
from phaseloom.plans import sqltwin as S
from phaseloom.sources import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PLACES = 6


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = adapters.charts(spark, sf_dir)
    nxt = c.select((F.col("ord") - 1).alias("ord"), F.col("ball").alias("v"), F.col("torus").alias("t"))
    return c.select("ord", "id", F.col("ball").alias("u"), F.col("torus").alias("s")).join(nxt, "ord")


def _columns() -> list[Column]:
    return [F.col(c) for c in "uvst"]


def _scalar(name: str, column: Callable[..., Column], sql: str, places: int = PLACES) -> None:
    QUERIES[name] = lambda spark, sf_dir: neighbours(spark, sf_dir).select("id", rounded(column(*_columns()), places).alias("x"))
    ORACLE_SQL[name] = f"WITH {S.PAIRS} SELECT id, {S.r(sql, places)} AS x FROM pairs"


def _vector(name: str, column: Callable[..., Column], sql: list[str], places: int = PLACES) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = neighbours(spark, sf_dir).select("id", column(*_columns()).alias("w"))
        return df.select("id", *(rounded(F.col("w")[i], places).alias(f"x{i + 1}") for i in range(len(sql))))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"WITH {S.PAIRS} SELECT id, {', '.join(f'{S.r(x, places)} AS x{i + 1}' for i, x in enumerate(sql))} FROM pairs"


U, V, A, C = S.vec("u", 3), S.vec("v", 3), S.vec("s", 8), S.vec("t", 8)
_n = S.norm

_scalar("h1_dot", lambda u, v, s, t: B.dot(u, v), S.dot(U, V))
_scalar("h2_norm", lambda u, v, s, t: B.norm(u), _n(U))
_vector("h3_project", lambda u, v, s, t: B.project(B.scaled(u, F.lit(3.0))), S.project(S.scaled(U, "3.0")))
_den = f"(CASE WHEN 1 + 2 * {S.dot(U, V)} + {S.dot(U, U)} * {S.dot(V, V)} = 0 THEN 1e-12 ELSE 1 + 2 * {S.dot(U, V)} + {S.dot(U, U)} * {S.dot(V, V)} END)"
_vector("h4_mobius_add", lambda u, v, s, t: B.mobius_add(u, v), S.project([f"((1 + 2 * {S.dot(U, V)} + {S.dot(V, V)}) / {_den}) * {a} + ((1 - {S.dot(U, U)}) / {_den}) * {b}" for a, b in zip(U, V, strict=True)]), 5)
_scalar("h5_poincare_dist", lambda u, v, s, t: B.distance(u, v), S.distance(U, V))
_scalar("h6_depth", lambda u, v, s, t: B.depth(u), S.depth(U))
_vector("h7_exp_map0", lambda u, v, s, t: B.exp_origin(B.scaled(u, F.lit(1.5))), S.project([f"{a} * (tanh({_n(S.scaled(U, '1.5'))}) / {_n(S.scaled(U, '1.5'))})" for a in S.scaled(U, "1.5")]))
_vector("h8_log_map0", lambda u, v, s, t: B.log_origin(u), [f"{a} * (atanh(least({1 - B.BOUNDARY!r}, {_n(U)})) / {_n(U)})" for a in U])
_k = f"(4 / ({S.room(V)} * sqrt(greatest(1e-12, {S.gamma(U, V)} * {S.gamma(U, V)} - 1))))"
_vector("h9_dist_grad", lambda u, v, s, t: B.distance_gradient(u, v), [f"{_k} * (({S.dot(V, V)} - 2 * {S.dot(U, V)} + 1) / ({S.room(U)} * {S.room(U)}) * {a} - {b} / {S.room(U)})" for a, b in zip(U, V, strict=True)], 5)
_scalar("h14_symlog", lambda u, v, s, t: B.symlog(u[0] * 100 - 3), "sign(u1 * 100 - 3) * ln(1 + abs(u1 * 100 - 3))", 5)
_scalar("h19_round_to", lambda u, v, s, t: u[0] * 1000 - 0.5, "u1 * 1000 - 0.5", 2)
_vector("h16_place_features", lambda u, v, s, t: u, U)

_U0 = f"sqrt(1 + {S.dot(U, U)})"
_V0 = f"sqrt(1 + {S.dot(V, V)})"
_up = B.to_hyperboloid
_mink = f"({_U0} * {_V0} + {S.dot(U, V)} - 2 * {_U0} * {_V0})"
_scalar("l1_minkowski_dot", lambda u, v, s, t: B.minkowski(_up(u), _up(v)), _mink)
_scalar("l2_lorentz_dist", lambda u, v, s, t: B.hyperboloid_distance(_up(u), _up(v)), f"acosh(greatest(1.0, -{_mink}))", 5)
_vector("l3_project_to_hyperboloid", lambda u, v, s, t: _up(u), [_U0, *U])
_below = f"greatest(1e-12, 1 - {S.dot(U, U)})"
_vector("l4_poincare_to_lorentz", lambda u, v, s, t: B.ball_to_hyperboloid(u), [f"(1 + {S.dot(U, U)}) / {_below}", *[f"{a} * (2 / {_below})" for a in U]])
_vector("l5_lorentz_to_poincare", lambda u, v, s, t: B.hyperboloid_to_ball(_up(u)), [f"{a} / ({_U0} + 1)" for a in U])
_vector("l6_lorentz_exp_map", lambda u, v, s, t: B.hyperboloid_exp(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)), F.concat(F.array(F.lit(0.0)), v)), [f"cosh({_n(V)})", *[f"sinh({_n(V)}) / {_n(V)} * {b}" for b in V]])

_scalar("t1_norm2pi", lambda u, v, s, t: T.turn(s[0] - 4), S.turn("s1 - 4"))
_scalar("t2_wrap", lambda u, v, s, t: T.wrap(s[0] * 3 - 9), S.wrap("s1 * 3 - 9"))
_scalar("t3_torus_dist", lambda u, v, s, t: T.torus_distance(s, t), S.torus_distance(A, C, False))
_scalar("t3_torus_dist_weighted", lambda u, v, s, t: T.torus_distance(s, t, T.scale_weights()), S.torus_distance(A, C, True))
_scalar("t8_translation_shift", lambda u, v, s, t: T.shift_of(s, t), S.shift(A, C), 4)
_scalar("t8_translation_score", lambda u, v, s, t: T.translation_align(s, t)[1], S.add([f"cos({S.wrap(f'{a} - {b} - {S.shift(A, C)}')})" for a, b in zip(A, C, strict=True)]) + " / 8", 5)
_vector("t12_phases_to_torus", lambda u, v, s, t: T.phases_to_torus(F.transform(s, lambda x: x - 3)), [S.turn(f"{a} - 3") for a in A])
_scalar("x2_product_dist", lambda u, v, s, t: T.product_distance(u, s, v, t, 0.7, 0.3), f"sqrt(0.7 * {S.distance(U, V)} * {S.distance(U, V)} + 0.3 * {S.torus_distance(A, C, True)} * {S.torus_distance(A, C, True)})")
_scalar("r1_resonance", lambda u, v, s, t: T.resonance(s, t), S.resonance(A, C))
_scalar("r1_resonance_transposed", lambda u, v, s, t: T.resonance(s, t, transposed=True), S.add([f"cos({S.wrap(f'{a} - {b} - {S.shift(A, C)}')})" for a, b in zip(A, C, strict=True)]) + " / 8", 5)
_scalar("r2_regulator", lambda u, v, s, t: T.regulator(u[0] * 3), S.regulator("u1 * 3"))
_scalar("r3_resonant_dist", lambda u, v, s, t: T.resonant_distance(u, s, v, t), f"{S.distance(U, V)} * {S.regulator(S.resonance(A, C))}", 6)
_scalar("r4_fold_factor", lambda u, v, s, t: T.fold_factor(s, t), S.regulator(S.resonance(A, C)))


def t4_phi_scale_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(T.DIM).select(F.col("id").alias("axis"), rounded(F.array(*map(F.lit, T.scale_weights()))[F.col("id").cast("int")], 9).alias("x"))


def t6_golden_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phaseloom.operators.charts import golden_sequence

    return golden_sequence(spark, 200, 3).select("k", *(rounded(F.col("seat")[i], 6).alias(f"x{i + 1}") for i in range(3)))


def h17_edge_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.ledger(spark, sf_dir)
    w = B.edge_strength(F.col("kind"), F.col("weight"))
    return e.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum(w), 4).alias("strength"))


def h18_target_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.ledger(spark, sf_dir)
    return e.select("seq", rounded(B.target_distance(B.edge_strength(F.col("kind"), F.col("weight"))), 6).alias("x"))


QUERIES |= {f.__name__: f for f in (t4_phi_scale_weights, t6_golden_sequence, h17_edge_strength, h18_target_dist)}
_g = T.golden_ratio(3)
_cond = "CASE kind " + " ".join(f"WHEN '{k}' THEN {c}" for k, c in B.CONDUCTANCE.items()) + " ELSE 0.5 END"
_strength = f"least(1.0, greatest(0.0, weight) * ({_cond}) / 2)"
ORACLE_SQL |= {
    "t4_phi_scale_weights": f"SELECT axis, {S.r(f'power({S.PHI}, -axis / 2.0)', 9)} AS x FROM range(8) AS a(axis)",
    "t6_golden_sequence": "SELECT k, " + ", ".join(S.r(S.turn(f"((k * {_g ** -(j + 1)!r} + 0.5) % 1) * {S.TURN}"), 6) + f" AS x{j + 1}" for j in range(3)) + " FROM range(1, 201) AS a(k)",
    "h17_edge_strength": f"WITH {S.LEDGER} SELECT kind, count(*) AS n, {S.r(f'sum({_strength})', 4)} AS strength FROM ledger GROUP BY kind",
    "h18_target_dist": f"WITH {S.LEDGER} SELECT seq, {S.r(f'{B.FAR} - ({B.FAR} - {B.NEAR}) * {_strength}', 6)} AS x FROM ledger",
}
