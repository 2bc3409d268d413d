"""Least squares from per-cell sums.

The design matrix is never built. Rows are aggregated to one row per combination
of categorical levels with the sums and products of the centred numeric terms;
the dummy blocks of X'X are read off these cells on the driver. One partially
combined aggregate serves any number of nested models, splits and folds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allocora.model.spec import Design, ModelSpec, dummy_name
from allocora.runtime import collect_bounded

MAX_CELLS = 200_000
#: Levels that may become dummies; the driver solves for all of them. Effects with more are absorbed, see ``absorb``.
MAX_LEVELS = 500
ALIAS_TOLERANCE = 1e-10


def make_design(df: DataFrame, spec: ModelSpec) -> Design:
    """Centres of the numeric terms and levels of the categorical ones; a categorical has a bounded number of levels."""
    terms = spec.numeric_terms
    row = df.agg(
        F.avg(F.col(spec.outcome)).alias("_y"),
        *[F.avg(spec.term_column(t)).alias(f"_c{i}") for i, t in enumerate(terms)],
    ).first()
    levels, references = {}, {}
    for c, reference in spec.categorical:
        found = collect_bounded(df.select(c).filter(F.col(c).isNotNull()).distinct(), MAX_LEVELS, f"levels of {c}")
        levels[c] = sorted(r[0] for r in found)
        present = reference in levels[c]
        references[c] = reference if present else (levels[c][0] if levels[c] else None)
    centres = {t: float(row[f"_c{i}"] or 0.0) for i, t in enumerate(terms)}
    return Design(spec, levels, centres, float(row["_y"] or 0.0), references)


def cell_sums(df: DataFrame, design: Design, by: Sequence[str] = ()) -> DataFrame:
    """Count, sums and products of the centred numeric terms and outcome per cell."""
    spec = design.spec
    terms = spec.numeric_terms
    y = F.col(spec.outcome) - F.lit(design.outcome_centre)
    centred = df.select(
        *by,
        *[c for c, _ in spec.categorical],
        y.alias("_y"),
        *[design.centred(t).alias(f"_x{i}") for i, t in enumerate(terms)],
    )
    p = len(terms)
    sums = ["count(*) AS n", "sum(_y) AS sy", "sum(_y * _y) AS syy"]
    sums += [f"sum(_x{i}) AS s{i}" for i in range(p)]
    sums += [f"sum(_x{i} * _y) AS sy{i}" for i in range(p)]
    sums += [f"sum(_x{i} * _x{j}) AS s{i}_{j}" for i in range(p) for j in range(i, p)]
    return centred.groupBy(*by, *[c for c, _ in spec.categorical]).agg(*map(F.expr, sums))


@dataclass(frozen=True)
class Gram:
    """X'X, X'y, y'y and n over centred numeric terms and plain dummies."""

    design: Design
    terms: tuple[str, ...]
    xx: np.ndarray
    xy: np.ndarray
    yy: float
    y_sum: float
    n: int

    def __sub__(self, other: Gram) -> Gram:
        return Gram(
            self.design, self.terms, self.xx - other.xx, self.xy - other.xy,
            self.yy - other.yy, self.y_sum - other.y_sum, self.n - other.n,
        )

    def __add__(self, other: Gram) -> Gram:
        return Gram(
            self.design, self.terms, self.xx + other.xx, self.xy + other.xy,
            self.yy + other.yy, self.y_sum + other.y_sum, self.n + other.n,
        )

    def only(self, terms: Sequence[str]) -> Gram:
        """The Gram of a nested model."""
        keep = [self.terms.index(t) for t in terms]
        return Gram(
            self.design, tuple(terms), self.xx[np.ix_(keep, keep)], self.xy[keep], self.yy, self.y_sum, self.n
        )


def assemble(rows: Sequence, design: Design) -> Gram:
    terms = design.terms
    place = {t: i for i, t in enumerate(terms)}
    p = len(design.spec.numeric_terms)
    xx, xy = np.zeros((len(terms), len(terms))), np.zeros(len(terms))
    yy = y_sum = 0.0
    n = 0
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    for r in rows:
        on = [0] + [
            place[dummy_name(c, r[c])] for c, _ in design.spec.categorical if r[c] != design.references[c]
        ]
        s = np.array([r[f"s{i}"] for i in range(p)])
        xx[np.ix_(on, on)] += r["n"]
        for a in on:
            xx[a, 1 : p + 1] += s
            xx[1 : p + 1, a] += s
            xy[a] += r["sy"]
        for i, j in upper:
            v = r[f"s{i}_{j}"]
            xx[i + 1, j + 1] += v
            if i != j:
                xx[j + 1, i + 1] += v
        xy[1 : p + 1] += [r[f"sy{i}"] for i in range(p)]
        yy += r["syy"]
        y_sum += r["sy"]
        n += r["n"]
    return Gram(design, tuple(terms), xx, xy, yy, y_sum, n)


def gram(df: DataFrame, design: Design) -> Gram:
    return assemble(collect_bounded(cell_sums(df, design), MAX_CELLS, "categorical cells"), design)


def grams_by(df: DataFrame, design: Design, key: str) -> dict[object, Gram]:
    """One Gram per value of ``key`` (a split or fold), from one aggregate."""
    rows = collect_bounded(cell_sums(df, design, [key]), MAX_CELLS, "categorical cells")
    groups: dict[object, list] = {}
    for r in rows:
        groups.setdefault(r[key], []).append(r)
    return {k: assemble(v, design) for k, v in sorted(groups.items())}


@dataclass(frozen=True)
class Solution:
    """Coefficients on the original scale and what is needed for their covariance."""

    design: Design
    terms: tuple[str, ...]
    coefficients: dict[str, float]
    aliased: tuple[str, ...]
    kept: tuple[str, ...]
    inverse: np.ndarray
    n: int
    r2: float
    sse: float

    @property
    def rank(self) -> int:
        return len(self.kept)

    @property
    def adj_r2(self) -> float:
        return 1 - (1 - self.r2) * (self.n - 1) / (self.n - self.rank)

    def uncentre(self) -> np.ndarray:
        """Map from coefficients of centred terms to those of the original ones."""
        shift = np.eye(self.rank)
        for i, t in enumerate(self.kept):
            if t in self.design.centres:
                shift[0, i] = -self.design.centres[t]
        return shift


def solve(g: Gram) -> Solution:
    """Solve the normal equations; columns that earlier ones determine are left out and named."""
    scale = np.sqrt(np.where(np.diag(g.xx) > 0, np.diag(g.xx), 1.0))
    scaled = g.xx / np.outer(scale, scale)
    kept: list[int] = []
    for i in range(len(g.terms)):
        if g.xx[i, i] <= 0:
            continue
        rest = scaled[i, i]
        if kept:
            block = scaled[np.ix_(kept, kept)]
            rest -= scaled[i, kept] @ np.linalg.solve(block, scaled[kept, i])
        if rest > ALIAS_TOLERANCE:
            kept.append(i)
    inverse = np.linalg.inv(scaled[np.ix_(kept, kept)]) / np.outer(scale[kept], scale[kept])
    b = inverse @ g.xy[kept]
    sst = g.yy - g.y_sum**2 / g.n
    sse = float(g.yy - 2 * b @ g.xy[kept] + b @ g.xx[np.ix_(kept, kept)] @ b)
    names = tuple(g.terms[i] for i in kept)
    coefficients = dict(zip(names, map(float, b)))
    centre = sum(coefficients[t] * c for t, c in g.design.centres.items() if t in coefficients)
    coefficients["Intercept"] += g.design.outcome_centre - centre
    return Solution(
        g.design, g.terms, coefficients, tuple(t for t in g.terms if t not in names), names,
        inverse, g.n, float(1 - sse / sst), sse,
    )


def fit(df: DataFrame, spec: ModelSpec, make: Callable = make_design) -> Solution:
    """Fit ``spec`` on the complete rows of ``df``."""
    rows = spec.complete(df)
    return solve(gram(rows, make(rows, spec)))


def vif(g: Gram, predictors: Sequence[str]) -> dict[str, float]:
    """Variance inflation of each numeric predictor against the others and a constant."""
    at = [g.terms.index(t) for t in predictors]
    mean = g.xx[0, at] / g.n
    cov = g.xx[np.ix_(at, at)] - g.n * np.outer(mean, mean)
    sd = np.sqrt(np.diag(cov))
    return dict(zip(predictors, map(float, np.diag(np.linalg.inv(cov / np.outer(sd, sd))))))
