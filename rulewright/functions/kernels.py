"""Aggregation and influence functions of gradual semantics, over arrays of strengths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def product(xs: Column) -> Column:
    """Product of an array, 1 when empty."""
    return F.aggregate(xs, F.lit(1.0), lambda a, x: a * x)


def minimum(xs: Column) -> Column:
    """Least of an array, 1 when empty."""
    return F.coalesce(F.array_min(xs), F.lit(1.0))


def survive(xs: Column) -> Column:
    """Product of 1 - x."""
    return F.aggregate(xs, F.lit(1.0), lambda a, x: a * (1 - x))


def balance_product(attacks: Column, supports: Column) -> Column:
    return survive(attacks) - survive(supports)


def balance_sum(attacks: Column, supports: Column) -> Column:
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    return total(supports) - total(attacks)


def linear(base: Column, weight: Column) -> Column:
    return base + base * F.least(F.lit(0.0), weight) + (1 - base) * F.greatest(F.lit(0.0), weight)


def quadratic(base: Column, weight: Column) -> Column:
    def h(w: Column) -> Column:
        x = F.greatest(F.lit(0.0), w)
        return x * x / (1 + x * x)

    return base - base * h(-weight) + (1 - base) * h(weight)


def noisy_or(xs: Column) -> Column:
    """1 - product of 1 - x, 0 when empty."""
    return 1 - survive(xs)


def combine(base: Column, attack: Column, support: Column, tolerance: float = 1e-12) -> Column:
    """Base moved towards 0 by the surplus of attack, towards 1 by that of support, unchanged on a tie."""
    d = support - attack
    return F.when(F.abs(d) <= tolerance, base).when(d < 0, base + base * d).otherwise(base + (1 - base) * d)


#: name -> (set aggregation, balance, influence)
KERNELS: dict[str, tuple[Callable, Callable, Callable]] = {
    "prod-dfquad": (product, balance_product, linear),
    "min-dfquad": (minimum, balance_product, linear),
    "prod-qe": (product, balance_sum, quadratic),
    "min-qe": (minimum, balance_sum, quadratic),
}


def plain(kernel: str, base: float, attacks: list[list[float]], supports: list[list[float]]) -> float:
    """One update of one argument in plain numbers: sets of strengths of its attackers and supporters."""
    joint, balance = kernel.split("-")
    force = lambda sets: [_fold(sorted(xs), lambda x: x) if joint == "prod" else min(xs, default=1.0) for xs in sets]
    a, s = sorted(force(attacks)), sorted(force(supports))
    if balance == "dfquad":
        w = _fold(a, lambda x: 1 - x) - _fold(s, lambda x: 1 - x)
        return base + base * min(0.0, w) + (1 - base) * max(0.0, w)
    w = sum(s) - sum(a)
    h = lambda x: max(0.0, x) ** 2 / (1 + max(0.0, x) ** 2)
    return base - base * h(-w) + (1 - base) * h(w)


def _fold(xs: list[float], of: Callable[[float], float]) -> float:
    out = 1.0
    for x in xs:
        out *= of(x)
    return out
