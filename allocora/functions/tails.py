"""Tail probabilities.

Per-row p-values are native expressions. Normal and chi-square tails are needed
only for a handful of driver-side statistics.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


# Gauss-Legendre nodes and weights on (0, 1).
_NODES = [((x + 1) / 2, w / 2) for x, w in zip(*np.polynomial.legendre.leggauss(60), strict=True)]


def trend_p_value(r2: Column, n: Column) -> Column:
    """Two-sided p-value of a regression slope from its R² and point count.

    With t = r·sqrt(df / (1 - r²)) and sin a = |r|, the tail of Student's t is the
    integral of cos^(df - 1) from a to a right angle, as a share of that from 0.
    Both are taken by a fixed number of nodes over the part that is not negligible,
    so the cost does not depend on the point count. NULL below three points or
    without a fit.
    """
    df = n.cast("double") - 2
    angle = F.asin(F.sqrt(F.least(F.greatest(r2, F.lit(0.0)), F.lit(1.0))))
    nodes = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(w)).alias("w")) for x, w in _NODES])

    def integral(start: Column) -> Column:
        width = F.least(F.lit(math.pi / 2) - start, F.lit(14.0) / F.sqrt(df))
        return width * F.aggregate(
            nodes, F.lit(0.0), lambda acc, q: acc + q["w"] * F.pow(F.cos(start + width * q["x"]), df - 1)
        )

    tail = integral(angle) / integral(F.lit(0.0))
    return F.when((df >= 1) & r2.isNotNull(), F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0)))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def chi2_tail(x: float, df: int) -> float:
    """P(chi-square with df degrees of freedom > x), by the finite series in df."""
    if x <= 0:
        return 1.0
    half = x / 2.0
    if df % 2 == 0:
        term, total = 1.0, 1.0
        for j in range(1, df // 2):
            term *= half / j
            total += term
        return math.exp(-half) * total
    term, total = math.sqrt(2 * x / math.pi) * math.exp(-half), 0.0
    for j in range(1, (df - 1) // 2 + 1):
        total += term
        term *= x / (2 * j + 1)
    return math.erfc(math.sqrt(half)) + total


def rank_sum_two_sided(u: float, small: int, large: int) -> float:
    """Exact two-sided p-value of Mann-Whitney's U without ties, by counting rank orders.

    The number of orders with each U are the coefficients of a Gaussian binomial,
    built up factor by factor in whole numbers.
    """
    size = small * large
    ways = [1] + [0] * size
    for i in range(1, small + 1):
        for j in range(size, large + i - 1, -1):
            ways[j] -= ways[j - large - i]
        for j in range(i, size + 1):
            ways[j] += ways[j - i]
    extreme = int(max(u, size - u))
    return min(1.0, 2 * sum(ways[extreme:]) / math.comb(small + large, small))
