"""The hyperbolic ball and the hyperboloid, as expressions over array<double>."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the model.
BOUNDARY, TINY = 1e-5, 1e-12
TANGENT_SCALE = 0.9
CONDUCTANCE = {"assoc": 0.6, "causal": 0.7, "derived": 0.8, "refines": 0.7, "supersedes": 0.9, "contradicts": 0.3, "session": 0.5, "about": 0.6, "tool": 0.5}
HIERARCHY = ("causal", "derived", "refines", "supersedes")
UNKNOWN_CONDUCTANCE = 0.5
NEAR, FAR = 0.3, 1.6


def rounded(x: Column, places: int) -> Column:
    """Halves go up, towards +infinity."""
    f = float(10**places)
    return F.floor(x * f + 0.5) / f


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(u: Column, v: Column) -> Column:
    return total(F.zip_with(u, v, lambda a, b: a * b))


def norm(u: Column) -> Column:
    return F.sqrt(dot(u, u))


def scaled(u: Column, k: Column) -> Column:
    return F.transform(u, lambda x: x * k)


def project(u: Column) -> Column:
    """Within radius 1 - BOUNDARY."""
    most = 1 - BOUNDARY
    return F.when(norm(u) <= most, u).otherwise(scaled(u, F.lit(most) / norm(u)))


def _or_tiny(x: Column) -> Column:
    return F.when(x == 0, F.lit(TINY)).otherwise(x)


def mobius_add(u: Column, v: Column) -> Column:
    uv, uu, vv = dot(u, v), dot(u, u), dot(v, v)
    below = _or_tiny(1 + 2 * uv + uu * vv)
    a, b = (1 + 2 * uv + vv) / below, (1 - uu) / below
    return project(F.zip_with(u, v, lambda x, y: a * x + b * y))


def _gap(u: Column, v: Column) -> Column:
    return total(F.zip_with(u, v, lambda a, b: (a - b) * (a - b)))


def _room(u: Column) -> Column:
    return F.greatest(F.lit(TINY), 1 - dot(u, u))


def distance(u: Column, v: Column) -> Column:
    return F.acosh(F.greatest(F.lit(1.0), 1 + 2 * _gap(u, v) / (_room(u) * _room(v))))


def depth(u: Column) -> Column:
    return 2 * F.atanh(F.least(F.lit(1 - BOUNDARY), norm(u)))


def exp_origin(t: Column) -> Column:
    n = norm(t)
    return F.when(n < TINY, F.transform(t, lambda _: F.lit(0.0))).otherwise(project(scaled(t, F.tanh(n) / n)))


def log_origin(y: Column) -> Column:
    n = norm(y)
    return F.when(n < TINY, F.transform(y, lambda _: F.lit(0.0))).otherwise(scaled(y, F.atanh(F.least(F.lit(1 - BOUNDARY), n)) / n))


def distance_gradient(u: Column, v: Column) -> Column:
    """Of distance(u, v) in u, Euclidean."""
    alpha, beta = _room(u), _room(v)
    gamma = 1 + 2 * _gap(u, v) / (alpha * beta)
    k = 4 / (beta * F.sqrt(F.greatest(F.lit(TINY), gamma * gamma - 1)))
    a = (dot(v, v) - 2 * dot(u, v) + 1) / (alpha * alpha)
    return F.zip_with(u, v, lambda x, y: k * (a * x - y / alpha))


def symlog(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def place_features(f: Column, dim: int) -> Column:
    """A feature vector, cut or filled to dim, as a point of the ball."""
    g = F.slice(F.concat(f, F.array_repeat(F.lit(0.0), dim)), 1, dim)
    n = norm(g)
    return exp_origin(F.when(n > 1, scaled(g, F.lit(TANGENT_SCALE) / n)).otherwise(scaled(g, F.lit(TANGENT_SCALE))))


def conductance(kind: Column) -> Column:
    return reduce(lambda other, kv: F.when(kind == kv[0], F.lit(kv[1])).otherwise(other), CONDUCTANCE.items(), F.lit(UNKNOWN_CONDUCTANCE))


def edge_strength(kind: Column, weight: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), weight) * conductance(kind) / 2)


def target_distance(strength: Column) -> Column:
    return FAR - (FAR - NEAR) * strength


def minkowski(u: Column, v: Column) -> Column:
    return dot(u, v) - 2 * u[0] * v[0]


def hyperboloid_distance(u: Column, v: Column) -> Column:
    return F.acosh(F.greatest(F.lit(1.0), -minkowski(u, v)))


def to_hyperboloid(space: Column) -> Column:
    """The point of the hyperboloid above space coordinates."""
    return F.concat(F.array(F.sqrt(1 + dot(space, space))), space)


def ball_to_hyperboloid(p: Column) -> Column:
    s = dot(p, p)
    below = F.greatest(F.lit(TINY), 1 - s)
    return F.concat(F.array((1 + s) / below), scaled(p, 2 / below))


def hyperboloid_to_ball(x: Column) -> Column:
    return F.transform(F.slice(x, 2, F.size(x) - 1), lambda c: c / (x[0] + 1))


def hyperboloid_exp(x: Column, v: Column) -> Column:
    """The point reached from x along the tangent v."""
    n = F.sqrt(F.greatest(F.lit(0.0), minkowski(v, v)))
    return F.when(n < TINY, x).otherwise(F.zip_with(x, v, lambda a, b: F.cosh(n) * a + F.sinh(n) / n * b))
