"""Seeded draws as expressions.  The generator steps its state by a constant, so the
k-th draw is a function of seed and k, and no row waits for another's."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from phaseloom.functions.ball import TINY

#: Fixed values of the hash and the generator.
FNV_BASE, FNV_PRIME = 2166136261, 16777619
STEP, WORD = 0x6D2B79F5, 0xFFFFFFFF


def _word(x: Column) -> Column:
    return x.bitwiseAND(F.lit(WORD))


def _times(a: Column, b: Column) -> Column:
    """The product of two 32-bit words in 32 bits; b goes in halves, so nothing overflows."""
    high = F.shiftleft(_word(a * F.shiftright(b, 16)), 16)
    return _word(high + a * b.bitwiseAND(F.lit(0xFFFF)))


def fnv1a(text: Column) -> Column:
    """The 32-bit hash of a text of the basic plane."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(FNV_BASE).cast("long"), lambda h, c: _word(h.bitwiseXOR(F.ascii(c).cast("long")) * FNV_PRIME))


def draw(seed: Column, k: Column) -> Column:
    """The k-th draw (from 1) of a seed, in [0, 1)."""
    s = F.array(_word(seed.cast("long") + k.cast("long") * F.lit(STEP).cast("long")))
    # Each step is bound to a name by a lambda, so that no step is written out twice.
    s = F.transform(s, lambda x: _times(x.bitwiseXOR(F.shiftright(x, 15)), x.bitwiseOR(F.lit(1).cast("long"))))
    s = F.transform(s, lambda x: x.bitwiseXOR(_word(x + _times(x.bitwiseXOR(F.shiftright(x, 7)), x.bitwiseOR(F.lit(61).cast("long"))))))
    return F.element_at(F.transform(s, lambda x: x.bitwiseXOR(F.shiftright(x, 14)) / F.lit(4294967296.0)), 1)


def hash_direction(key: Column, dim: int) -> Column:
    """A unit vector from a text: normal deviates of two draws each."""
    seed = fnv1a(key)
    raw = F.transform(F.sequence(F.lit(1), F.lit(2 * dim - 1), F.lit(2)), lambda k: F.sqrt(-2 * F.log(F.greatest(F.lit(TINY), draw(seed, k)))) * F.cos(2 * math.pi * draw(seed, k + 1)))
    n = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: x / F.when(n == 0, 1.0).otherwise(n))


def past(taken: Column, place: Column) -> Column:
    """The place-th (from 0) of the whole numbers that aren't in ``taken`` (rising)."""
    return F.aggregate(taken, place, lambda p, t: F.when(p >= t, p + 1).otherwise(p))


def sample(seed: Column, n: Column, count: int) -> Column:
    """Places (from 0) of ``count`` of n things, drawn in order and not put back; all of
    them if there are fewer."""
    def take(got: Column, k: Column) -> Column:
        left = F.floor(draw(seed, k) * (n - k + 1)).cast("long")
        return F.when(k > n, got).otherwise(F.concat(got, F.array(past(F.sort_array(got), left))))

    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(count).cast("long")), F.array().cast("array<long>"), take)
