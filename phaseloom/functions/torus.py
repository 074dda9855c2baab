"""The flat torus, the product of both spaces, and resonance."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from phaseloom.functions.ball import distance, rounded, total

#: Fixed values of the model.
TURN = 2 * math.pi
PHI = (1 + math.sqrt(5)) / 2
GOLDEN_ANGLE = TURN * (2 - PHI)
DIM = 8
GAIN, SHARPNESS, FLOOR = 0.95, 3.0, 0.05


def turn(a: Column) -> Column:
    """In [0, 2 pi)."""
    r = a % F.lit(TURN)
    return F.when(r < 0, r + TURN).otherwise(r)


def wrap(d: Column) -> Column:
    """In (-pi, pi]."""
    r = d % F.lit(TURN)
    return F.when(r > math.pi, r - TURN).when(r <= -math.pi, r + TURN).otherwise(r)


def scale_weights(dim: int = DIM) -> list[float]:
    return [PHI ** (-i / 2) for i in range(dim)]


def _common(a: Column, b: Column) -> tuple[Column, Column]:
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, 1, n), F.slice(b, 1, n)


def _differences(a: Column, b: Column) -> Column:
    a, b = _common(a, b)
    return F.zip_with(a, b, lambda x, y: wrap(x - y))


def torus_distance(a: Column, b: Column, weights: list[float] | None = None) -> Column:
    d = _differences(a, b)
    if weights is None:
        return F.sqrt(total(F.transform(d, lambda x: x * x)))
    w = F.array(*map(F.lit, weights))
    return F.sqrt(total(F.transform(d, lambda x, i: w[i] * w[i] * x * x)))


def golden_ratio(dim: int) -> float:
    """The root of g^(dim+1) = 1 + g, by 64 steps of its fixed point."""
    g = 2.0
    for _ in range(64):
        g = (1 + g) ** (1 / (dim + 1))
    return g


def golden_point(k: Column, dim: int = DIM, seed: float = 0.5) -> Column:
    """The k-th seat (from 1) of the additive recurrence."""
    g = golden_ratio(dim)
    return F.array(*(turn(((k * F.lit(g ** -(j + 1)) + seed) % 1) * TURN) for j in range(dim)))


def shift_of(a: Column, b: Column) -> Column:
    d = _differences(a, b)
    return F.atan2(total(F.transform(d, F.sin)), total(F.transform(d, F.cos)))


def translation_align(a: Column, b: Column) -> tuple[Column, Column]:
    """(shift, score): the circular mean difference and how well it fits, 5 places."""
    x, y = _common(a, b)
    shift = shift_of(a, b)
    n = F.size(x)
    fit = total(F.zip_with(x, y, lambda p, q: F.cos(wrap(p - q - shift)))) / F.greatest(n, F.lit(1))
    return F.when(n == 0, 0.0).otherwise(rounded(shift, 5)), F.when(n == 0, 0.0).otherwise(rounded(fit, 5))


def phases_to_torus(phases: Column, dim: int = DIM) -> Column:
    """Missing and not finite phases stand at 0."""
    def at(i: int) -> Column:
        p = F.get(phases, F.lit(i))
        return turn(F.when(p.isNull() | F.isnan(p) | (F.abs(p) == float("inf")), 0.0).otherwise(p))

    return F.array(*map(at, range(dim)))


def product_distance(ball_a: Column, torus_a: Column, ball_b: Column, torus_b: Column, hyperbolic: float | Column = 1.0, toroidal: float | Column = 1.0, dim: int = DIM) -> Column:
    h, t = distance(ball_a, ball_b), torus_distance(torus_a, torus_b, scale_weights(dim))
    return F.sqrt(hyperbolic * h * h + toroidal * t * t)


def resonance(a: Column, b: Column, transposed: bool = False) -> Column:
    """How far two phase vectors agree, -1 to 1, 6 places; 0 for empty ones."""
    if transposed:
        return translation_align(a, b)[1]
    d = _differences(a, b)
    power = lambda i: F.pow(F.lit(PHI), -i.cast("double"))
    num = total(F.transform(d, lambda x, i: power(i) * F.cos(x)))
    den = total(F.transform(d, lambda x, i: power(i)))
    return F.when(F.size(d) == 0, 0.0).otherwise(rounded(num / F.when(den == 0, 1.0).otherwise(den), 6))


def regulator(r: Column, gain: float = GAIN, sharpness: float = SHARPNESS, floor: float = FLOOR) -> Column:
    gain, sharpness, floor = min(1.0, max(0.0, gain)), max(1.0, sharpness), min(1.0, max(1e-6, floor))
    return rounded(F.greatest(F.lit(floor), 1 - gain * F.pow(F.greatest(F.lit(0.0), r), F.lit(sharpness))), 6)


def fold_factor(a: Column, b: Column, transposed: bool = False, **regulation: float) -> Column:
    return regulator(resonance(a, b, transposed), **regulation)


def resonant_distance(ball_a: Column, torus_a: Column, ball_b: Column, torus_b: Column, transposed: bool = False, **regulation: float) -> Column:
    return rounded(distance(ball_a, ball_b) * fold_factor(torus_a, torus_b, transposed, **regulation), 6)
