"""Scalars of both spaces against closed forms."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from phaseloom.functions import ball as B
from phaseloom.functions import torus as T
from phaseloom.plans import experiments as X


@pytest.fixture(scope="module")
def value(spark):
    return lambda column: spark.range(1).select(column.alias("x")).first()["x"]


def vec(*xs):
    return F.array(*(F.lit(float(x)) for x in xs))


def test_ball(value):
    assert value(B.distance(vec(0, 0), vec(0.5, 0))) == pytest.approx(2 * math.atanh(0.5))
    assert value(B.depth(vec(0.5, 0))) == pytest.approx(2 * math.atanh(0.5))
    assert value(B.norm(B.project(vec(3, 4)))) == pytest.approx(1 - 1e-5)
    assert value(B.exp_origin(vec(0, 0))) == [0.0, 0.0]
    assert value(B.log_origin(B.exp_origin(vec(0.3, 0.1)))) == pytest.approx([0.3, 0.1])
    assert value(B.mobius_add(vec(0, 0), vec(0.2, 0.3))) == pytest.approx([0.2, 0.3])
    assert value(B.rounded(F.lit(-2.5), 0)) == -2.0
    u, v, e = (0.3, 0.2), (-0.1, 0.4), 1e-6
    g = value(B.distance_gradient(vec(*u), vec(*v)))
    d = lambda x: value(B.distance(vec(*x), vec(*v)))
    assert g[0] == pytest.approx((d((u[0] + e, u[1])) - d((u[0] - e, u[1]))) / (2 * e), rel=1e-4)


def test_hyperboloid_agrees_with_ball(value):
    assert value(B.minkowski(vec(1, 0, 0), vec(1, 0, 0))) == -1 and value(B.minkowski(vec(0, 1, 0), vec(0, 1, 0))) == 1
    for p, q in (((0, 0), (0.3, -0.4)), ((0.6, 0.1), (-0.2, 0.7))):
        x, y = B.ball_to_hyperboloid(vec(*p)), B.ball_to_hyperboloid(vec(*q))
        assert value(B.minkowski(y, y)) == pytest.approx(-1)
        assert value(B.hyperboloid_distance(x, y)) == pytest.approx(value(B.distance(vec(*p), vec(*q))))
        assert value(B.hyperboloid_to_ball(y)) == pytest.approx(list(map(float, q)))
    at = B.hyperboloid_exp(vec(1, 0, 0), vec(0, 0.7, 0))
    assert value(B.hyperboloid_distance(vec(1, 0, 0), at)) == pytest.approx(0.7)


def test_torus(value):
    assert value(T.turn(F.lit(-0.1))) == pytest.approx(T.TURN - 0.1)
    assert value(T.wrap(F.lit(-math.pi))) == pytest.approx(math.pi)
    assert value(T.wrap(F.lit(1.5 * math.pi))) == pytest.approx(-0.5 * math.pi)
    assert value(T.torus_distance(vec(0), vec(T.TURN - 0.01))) < 0.02
    shift, score = T.translation_align(vec(0.2, 1, 2.5, 4), vec(0.9, 1.7, 3.2, 4.7))
    assert value(shift) == pytest.approx(-0.7) and value(score) > 0.999
    assert value(T.phases_to_torus(F.array(F.lit(float("nan")), F.lit(None).cast("double"), F.lit(7.0)), 4)) == pytest.approx([0, 0, 7 - T.TURN, 0])


def test_resonance(value):
    a = [0.1 * i for i in range(8)]
    assert value(T.resonance(vec(*a), vec(*a))) == 1
    assert value(T.resonance(vec(*a), vec(*(x + math.pi for x in a)))) == -1
    assert value(T.resonance(vec(*a), vec(*(x + math.pi / 2 for x in a)))) == 0
    assert value(T.resonance(F.array().cast("array<double>"), F.array().cast("array<double>"))) == 0
    for r, want in ((0.0, 1), (-0.5, 1), (-1.0, 1), (1.0, 0.05)):
        assert value(T.regulator(F.lit(r))) == pytest.approx(want)
    b = [2.0, 0.3, 1.1, 5.0, 0.2, 0.9, 3.3, 4.4]
    assert value(T.resonance(vec(*a), vec(*b))) == X.resonance(a, b)


def test_strengths(value):
    assert value(B.edge_strength(F.lit("supersedes"), F.lit(1.0))) == pytest.approx(0.45)
    assert value(B.edge_strength(F.lit("unheard"), F.lit(9.0))) == 1
    assert value(B.target_distance(F.lit(0.0))) == 1.6
