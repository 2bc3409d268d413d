"""Several fixed effects with any number of levels, absorbed instead of fitted as dummies.

Rows become one row of sums per combination of effect levels (a cell). The outcome
and the numeric terms are freed of all effects at once by conjugate gradients over
the levels: a step joins the levels' values to the cells and adds them up again per
level. What is left goes into a small least squares. Neither a level nor a cell ever
becomes a column or a value on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allocora.functions.tails import normal_two_sided
from allocora.runtime import small_table, stage

#: Residuals of the level equations, relative to their right sides, at which the steps end.
TOLERANCE = 1e-12
MAX_STEPS = 500
#: A term whose part not explained by effects and earlier terms is below this share of it is left out.
ALIAS_TOLERANCE = 1e-10


@dataclass(frozen=True)
class AbsorbSpec:
    """Outcome, numeric terms and the columns whose levels are absorbed; errors are clustered by ``cluster``."""

    outcome: str
    numeric: tuple[str, ...]
    effects: tuple[str, ...]
    cluster: str

    @property
    def variables(self) -> tuple[str, ...]:
        return (self.outcome, *self.numeric)

    @property
    def keys(self) -> list[str]:
        return list(dict.fromkeys((*self.effects, self.cluster)))

    def complete(self, df: DataFrame) -> DataFrame:
        return df.na.drop(subset=[*self.variables, *self.keys])


def _pairs(count: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(count) for j in range(i, count)]


def _sum(columns: Sequence[Column]) -> Column:
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    return total


@dataclass(frozen=True)
class Absorbed:
    """Cells, the effects in the order they were used, their numbers of levels, and each level's values.

    ``values`` has one table per effect: its level, and per variable (``a0``, ``a1``, …)
    what the level adds. The first effect is the one with the most levels.
    """

    spec: AbsorbSpec
    cells: DataFrame
    order: tuple[str, ...]
    levels: Mapping[str, int]
    centres: tuple[float, ...]
    values: Mapping[str, DataFrame]
    steps: int

    def with_effects(self, rows: DataFrame, prefix: str = "_a") -> DataFrame:
        """``rows`` with the sum of their levels' values for each variable."""
        k = len(self.spec.variables)
        return _with_levels(rows, self.values, "a", k, prefix)


def _with_levels(rows: DataFrame, values: Mapping[str, DataFrame], column: str, count: int, prefix: str) -> DataFrame:
    """Join each effect's values and add them up; tables proven small are broadcast."""
    for e, table in values.items():
        named = table.select(F.col(table.columns[0]).alias(f"_level_{e}"), *[F.col(f"{column}{i}").alias(f"_{e}_{i}") for i in range(count)])
        rows = rows.join(named, F.col(e) == F.col(f"_level_{e}")).drop(f"_level_{e}")
    summed = rows.withColumns({f"{prefix}{i}": _sum([F.col(f"_{e}_{i}") for e in values]) for i in range(count)})
    return summed.drop(*[f"_{e}_{i}" for e in values for i in range(count)])


def make_cells(df: DataFrame, spec: AbsorbSpec) -> tuple[DataFrame, tuple[str, ...], dict[str, int], tuple[float, ...]]:
    """A row per combination of levels and cluster: n, sums (s) and products (q) of the centred variables.

    The cells are bucketed by the effect with the most levels, whose levels are the
    smallest groups; every other effect is only ever joined and summed.
    """
    rows = spec.complete(df)
    first = rows.agg(
        *[F.avg(F.col(v).cast("double")).alias(f"c{i}") for i, v in enumerate(spec.variables)],
        *[F.count_distinct(e).alias(f"l{i}") for i, e in enumerate(spec.effects)],
    ).first()
    levels = {e: first[f"l{i}"] for i, e in enumerate(spec.effects)}
    centres = tuple(float(first[f"c{i}"] or 0.0) for i in range(len(spec.variables)))
    order = tuple(sorted(spec.effects, key=lambda e: -levels[e]))
    values = rows.select(*spec.keys, *[(F.col(v).cast("double") - F.lit(c)).alias(f"v{i}") for i, (v, c) in enumerate(zip(spec.variables, centres, strict=True))])
    k = len(spec.variables)
    sums = [F.count("*").alias("n"), *[F.sum(f"v{i}").alias(f"s{i}") for i in range(k)]]
    sums += [F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"q{i}_{j}") for i, j in _pairs(k)]
    return stage(values.groupBy(*spec.keys).agg(*sums), "absorb_cells", bucket_by=order[0]), order, levels, centres


def absorb(df: DataFrame, spec: AbsorbSpec, tolerance: float = TOLERANCE, max_steps: int = MAX_STEPS) -> Absorbed:
    """Free the outcome and the numeric terms of all effects.

    The first effect is projected out in every step (its means need no shuffle), the
    others are solved for by conjugate gradients with the levels' counts as
    preconditioner, all variables in the same passes. Raises if the equations do not
    reach ``tolerance``.
    """
    cells, order, levels, centres = make_cells(df, spec)
    k = len(spec.variables)
    lead, others = order[0], order[1:]

    def freed(rows: DataFrame, weighted: str) -> DataFrame:
        """``weighted`` sums per cell less the lead effect's mean."""
        means = rows.groupBy(lead).agg(*[(F.sum(f"{weighted}{i}") / F.sum("n")).alias(f"_m{i}") for i in range(k)])
        joined = rows.join(means, lead)
        return joined.withColumns({f"{weighted}{i}": F.col(f"{weighted}{i}") - F.col("n") * F.col(f"_m{i}") for i in range(k)})

    def per_level(rows: DataFrame, weighted: str, name: str) -> dict[str, DataFrame]:
        return {e: rows.groupBy(e).agg(F.sum("n").alias("n"), *[F.sum(f"{weighted}{i}").alias(f"{name}{i}") for i in range(k)]) for e in others}

    slim = cells.select(*order, "n", *[f"s{i}" for i in range(k)])
    right = per_level(freed(slim, "s"), "s", "r")
    zero = F.lit(0.0)
    state = {
        e: stage(
            t.select(e, "n", *[zero.alias(f"x{i}") for i in range(k)], *[f"r{i}" for i in range(k)], *[(F.col(f"r{i}") / F.col("n")).alias(f"p{i}") for i in range(k)]),
            "absorb_start",
        )
        for e, t in right.items()
    }

    def total(value) -> np.ndarray:
        """Sums over all levels of all effects but the lead, per variable."""
        found = np.zeros(k)
        for t in state.values():
            row = t.agg(*[F.sum(value(i)).alias(f"t{i}") for i in range(k)]).first()
            found += [row[f"t{i}"] or 0.0 for i in range(k)]
        return found

    def preconditioned(i: int) -> Column:
        return F.col(f"r{i}") * F.col(f"r{i}") / F.col("n")

    size = total(preconditioned)
    goal = size * tolerance**2
    steps = 0
    while others and (size > goal).any():
        if steps == max_steps:
            raise ValueError(f"effects not absorbed to {tolerance} within {max_steps} steps")
        steps += 1
        spread = _with_levels(cells.select(*order, "n"), {e: small_table(t.select(e, *[f"p{i}" for i in range(k)])) for e, t in state.items()}, "p", k, "_w")
        weighted = spread.select(*order, "n", *[(F.col("n") * F.col(f"_w{i}")).alias(f"w{i}") for i in range(k)])
        image = per_level(freed(weighted, "w"), "w", "g")
        state = {e: stage(t.join(image[e].drop("n"), e), "absorb_step") for e, t in state.items()}
        curved = total(lambda i: F.col(f"p{i}") * F.col(f"g{i}"))
        alpha = np.where((size > goal) & (curved > 0), size / np.where(curved > 0, curved, 1.0), 0.0)
        state = {
            e: t.withColumns(
                {f"x{i}": F.col(f"x{i}") + F.lit(float(alpha[i])) * F.col(f"p{i}") for i in range(k)}
                | {f"r{i}": F.col(f"r{i}") - F.lit(float(alpha[i])) * F.col(f"g{i}") for i in range(k)}
            ).drop(*[f"g{i}" for i in range(k)])
            for e, t in state.items()
        }
        renewed = total(preconditioned)
        beta = np.where(alpha > 0, renewed / np.where(size > 0, size, 1.0), 0.0)
        size = np.where(alpha > 0, renewed, np.minimum(size, goal))
        state = {e: t.withColumns({f"p{i}": F.col(f"r{i}") / F.col("n") + F.lit(float(beta[i])) * F.col(f"p{i}") for i in range(k)}) for e, t in state.items()}
    found = {e: t.select(e, *[F.col(f"x{i}").alias(f"a{i}") for i in range(k)]) for e, t in state.items()}
    found = {e: small_table(stage(t, "absorb_levels")) for e, t in found.items()}
    if others:
        rest = _with_levels(slim, found, "a", k, "_a").withColumns({f"s{i}": F.col(f"s{i}") - F.col("n") * F.col(f"_a{i}") for i in range(k)})
    else:
        rest = slim
    means = rest.groupBy(lead).agg(*[(F.sum(f"s{i}") / F.sum("n")).alias(f"a{i}") for i in range(k)])
    found[lead] = small_table(stage(means, "absorb_lead", bucket_by=lead, partitioned=True))
    return Absorbed(spec, cells, order, levels, centres, found, steps)


@dataclass(frozen=True)
class AbsorbedFit:
    """Coefficients of the numeric terms given all effects, with their cluster-robust covariance.

    ``rank`` counts the kept terms and the effects' levels, less one for each effect
    after the first, as if the effects' levels were all connected.
    """

    absorbed: Absorbed
    kept: tuple[str, ...]
    aliased: tuple[str, ...]
    coefficients: dict[str, float]
    covariance: np.ndarray
    n: int
    clusters: int
    rank: int
    within_r2: float
    sse: float

    def term(self, name: str) -> dict[str, float]:
        at = self.kept.index(name)
        se = float(np.sqrt(max(self.covariance[at, at], 0.0)))
        z = self.coefficients[name] / se if se else float("nan")
        return {"estimate": self.coefficients[name], "se": se, "z": z, "p": normal_two_sided(z)}


def _freed_products(found: Absorbed) -> DataFrame:
    """Cells with the sums of products (g) of their rows' freed variables, exact within a cell."""
    k = len(found.spec.variables)
    cells = found.with_effects(found.cells)
    away = [F.col(f"s{i}") / F.col("n") - F.col(f"_a{i}") for i in range(k)]
    within = {(i, j): F.col(f"q{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n") for i, j in _pairs(k)}
    return cells.select(*found.spec.keys, "n", *[(within[i, j] + F.col("n") * away[i] * away[j]).alias(f"g{i}_{j}") for i, j in _pairs(k)])


def fit_absorbed(df: DataFrame, spec: AbsorbSpec, tolerance: float = TOLERANCE, max_steps: int = MAX_STEPS) -> AbsorbedFit:
    """Least squares of the outcome on the numeric terms within all effects.

    Rows with a missing value, level or cluster are left out. Terms that the effects
    or earlier terms determine are named and left out. A null level is a missing one.
    """
    found = absorb(df, spec, tolerance, max_steps)
    k = len(spec.variables)
    cells = stage(_freed_products(found), "absorbed_cells", bucket_by=spec.cluster)
    raw = found.cells.agg(*[F.sum(f"q{i}_{i}").alias(f"q{i}") for i in range(k)]).first()
    row = cells.agg(F.sum("n").alias("n"), F.count_distinct(spec.cluster).alias("clusters"), *[F.sum(f"g{i}_{j}").alias(f"g{i}_{j}") for i, j in _pairs(k)]).first()
    if not row["n"]:
        raise ValueError("no complete rows")
    g = np.zeros((k, k))
    for i, j in _pairs(k):
        g[i, j] = g[j, i] = row[f"g{i}_{j}"]
    kept: list[int] = []
    for i in range(1, k):
        scale = raw[f"q{i}"]
        rest = g[i, i] - (g[i, kept] @ np.linalg.solve(g[np.ix_(kept, kept)], g[kept, i]) if kept else 0.0)
        if scale > 0 and rest > ALIAS_TOLERANCE * scale:
            kept.append(i)
    inverse = np.linalg.inv(g[np.ix_(kept, kept)]) if kept else np.zeros((0, 0))
    b = inverse @ g[kept, 0]
    sse = float(g[0, 0] - b @ g[kept, 0])

    def product(i: int, j: int) -> Column:
        return F.col(f"g{min(i, j)}_{max(i, j)}")

    scores = [
        _sum([product(i, 0), *[F.lit(-float(v)) * product(i, j) for v, j in zip(b, kept, strict=True)]]).alias(f"u{i}") for i in kept
    ]
    meat = score_products(cells.select(spec.cluster, *scores).groupBy(spec.cluster).agg(*[F.sum(f"u{i}").alias(f"u{i}") for i in kept]), [f"u{i}" for i in kept])
    rank = len(kept) + sum(found.levels.values()) - (len(found.order) - 1)
    freedom = row["n"] - rank
    many = row["clusters"] / (row["clusters"] - 1) if row["clusters"] > 1 else float("nan")
    factor = many * (row["n"] - 1) / freedom if freedom > 0 else float("nan")
    names = tuple(spec.variables[i] for i in kept)
    return AbsorbedFit(
        found,
        names,
        tuple(t for t in spec.numeric if t not in names),
        dict(zip(names, map(float, b), strict=True)),
        inverse @ meat @ inverse * factor,
        row["n"],
        row["clusters"],
        rank,
        float(1 - sse / g[0, 0]) if g[0, 0] > 0 else float("nan"),
        sse,
    )


def score_products(scores: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Sum over rows of score·score', per task first."""
    k = len(columns)
    if not k:
        return np.zeros((0, 0))

    def outer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, k))
        for batch in batches:
            u = batch.to_numpy(float)
            total += u.T @ u
        yield pd.DataFrame({f"c{i}": total[i] for i in range(k)}).assign(row=np.arange(k))

    schema = ", ".join([*(f"c{i} double" for i in range(k)), "row int"])
    added = scores.select(*columns).mapInPandas(outer, schema).groupBy("row").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(k)])
    meat = np.zeros((k, k))
    for r in added.collect():
        meat[r["row"]] = [r[f"c{i}"] for i in range(k)]
    return meat


def add_absorbed_scores(df: DataFrame, fit: AbsorbedFit, predicted: str = "predicted", score: str = "score") -> DataFrame:
    """Fitted value with all effects, and residual, of the complete rows."""
    found, spec = fit.absorbed, fit.absorbed.spec
    rows = found.with_effects(spec.complete(df))
    centre = dict(zip(spec.variables, found.centres, strict=True))
    shift = F.col("_a0") + F.lit(centre[spec.outcome])
    for i, name in enumerate(spec.variables[1:], 1):
        if name in fit.coefficients:
            shift = shift + F.lit(fit.coefficients[name]) * (F.col(name) - F.lit(centre[name]) - F.col(f"_a{i}"))
    fitted = rows.withColumn(predicted, shift).drop(*[f"_a{i}" for i in range(len(spec.variables))])
    return fitted.withColumn(score, F.col(spec.outcome) - F.col(predicted))
