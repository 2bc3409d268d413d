"""Rank tests from counted values."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allocora.functions.tails import chi2_tail, normal_two_sided, rank_sum_two_sided
from allocora.operators.ordered import average_rank, order_by_value

#: The exact p-value counts rank orders over the product of the group sizes; beyond this it is refused.
EXACT_PRODUCT = 1_000_000


@dataclass(frozen=True)
class RankSums:
    n: dict[str, int]
    ranks: dict[str, float]
    ties: float

    @property
    def total(self) -> int:
        return sum(self.n.values())


def rank_sum_table(df: DataFrame, value: str, group: str, levels: Sequence[str]) -> DataFrame:
    """One row: per group its size and rank sum, and Σ(t³ − t) over ties.

    Ranks run over all groups together. Each distinct value carries its count per
    group, so no rank is ever joined back to rows.
    """
    members = {f"g{i}": F.count_if(F.col(group) == level) for i, level in enumerate(levels)}
    ordered = order_by_value(df.filter(F.col(group).isin(list(levels))), value, sums=members)
    t = F.col("ties").cast("double")
    columns: list[Column] = [F.sum(t * t * t - t).alias("ties")]
    for g in members:
        columns += [F.sum(g).alias(f"n_{g}"), F.sum(F.col(g) * average_rank()).alias(f"r_{g}")]
    return ordered.agg(*columns)


def rank_sums(df: DataFrame, value: str, group: str, levels: Sequence[str]) -> RankSums:
    row = rank_sum_table(df, value, group, levels).first()
    sizes = {level: int(row[f"n_g{i}"] or 0) for i, level in enumerate(levels)}
    ranks = {level: float(row[f"r_g{i}"] or 0.0) for i, level in enumerate(levels)}
    return RankSums(sizes, ranks, float(row["ties"] or 0.0))


def kruskal(df: DataFrame, value: str, group: str, levels: Sequence[str]) -> dict[str, float | int | None]:
    """Tie-corrected Kruskal-Wallis H over the groups, with its chi-square p-value."""
    s = rank_sums(df, value, group, levels)
    n = s.total
    if n < 2 or any(c == 0 for c in s.n.values()):
        return {"n": n, "h": None, "p": None}
    correction = 1 - s.ties / (n**3 - n)
    if correction <= 0:
        return {"n": n, "h": None, "p": None}
    h = 12 / (n * (n + 1)) * sum(s.ranks[g] ** 2 / s.n[g] for g in levels) - 3 * (n + 1)
    h /= correction
    return {"n": n, "h": h, "p": chi2_tail(h, len(levels) - 1)}


def mann_whitney(
    df: DataFrame, value: str, group: str, first: str, second: str, method: str = "asymptotic"
) -> dict[str, float | int | None]:
    """U of the first group and its two-sided p-value.

    ``asymptotic``: normal with tie and continuity correction, for groups of any
    size. ``exact``: by counting rank orders; an error with ties, or if the product
    of the sizes is above ``EXACT_PRODUCT``.
    """
    if method not in ("asymptotic", "exact"):
        raise ValueError(f"no such method: {method}")
    s = rank_sums(df, value, group, [first, second])
    n1, n2, n = s.n[first], s.n[second], s.total
    if not n1 or not n2:
        return {"n1": n1, "n2": n2, "u": None, "p": None}
    u = s.ranks[first] - n1 * (n1 + 1) / 2
    variance = n1 * n2 / 12 * ((n + 1) - s.ties / (n * (n - 1)))
    if variance <= 0:
        return {"n1": n1, "n2": n2, "u": u, "p": None}
    if method == "exact":
        if s.ties or n1 * n2 > EXACT_PRODUCT:
            raise ValueError(f"exact p-value: ties, or sizes {n1} and {n2} too large")
        return {"n1": n1, "n2": n2, "u": u, "p": rank_sum_two_sided(u, min(n1, n2), max(n1, n2))}
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / variance**0.5
    return {"n1": n1, "n2": n2, "u": u, "p": min(1.0, normal_two_sided(max(z, 0.0)))}
