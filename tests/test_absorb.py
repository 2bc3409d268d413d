"""Absorbed effects against dense dummies and against plain alternating projections."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from allocora.model import absorb


def panel(seed=3, units=60, periods=9, plants=7, missing=0.4):
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(units):
        effect = rng.normal() * 3
        for t in range(periods):
            if rng.random() < missing:
                continue
            plant = f"p{rng.integers(plants)}"
            a, b = rng.normal() + effect, rng.normal() + 0.2 * t
            for _ in range(rng.integers(1, 3)):
                rows.append((f"u{u}", 1990 + t, plant, a + rng.normal(), b, 2 * a - b + effect + 0.5 * t + len(plant) + rng.normal()))
    return pd.DataFrame(rows, columns=["unit", "period", "plant", "a", "b", "y"])


def dense(pdf, effects, numeric, cluster):
    parts = [pdf[list(numeric)].to_numpy(float)]
    for i, e in enumerate(effects):
        parts.append(pd.get_dummies(pdf[e], drop_first=i > 0).to_numpy(float))
    x, y = np.column_stack(parts), pdf.y.to_numpy()
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ beta
    bread = np.linalg.pinv(x.T @ x)
    sums = pd.DataFrame(x * e[:, None]).groupby(pdf[cluster].to_numpy()).sum().to_numpy()
    g, (n, k) = len(sums), x.shape
    cov = bread @ (sums.T @ sums) @ bread * g / (g - 1) * (n - 1) / (n - k)
    return beta[: len(numeric)], np.sqrt(np.diag(cov))[: len(numeric)], e, k


@pytest.mark.parametrize(("effects", "cluster"), [(("unit",), "unit"), (("unit", "period"), "unit"), (("period", "unit"), "plant"), (("unit", "period", "plant"), "unit")])
def test_against_dummies(spark, effects, cluster):
    pdf = panel()
    df = spark.createDataFrame(pdf).repartition(5)
    odd = spark.createDataFrame([(None, 1990, "p0", 1.0, 1.0, 1.0), ("u0", 1990, "p0", None, 1.0, 1.0)], df.schema)
    spec = absorb.AbsorbSpec("y", ("a", "b"), effects, cluster)
    fit = absorb.fit_absorbed(df.unionByName(odd), spec)
    beta, se, e, k = dense(pdf, effects, ("a", "b"), cluster)
    assert [fit.coefficients[t] for t in ("a", "b")] == pytest.approx(beta, abs=1e-9)
    assert [fit.term(t)["se"] for t in ("a", "b")] == pytest.approx(se, rel=1e-7)
    assert (fit.n, fit.rank, fit.sse) == (len(pdf), k, pytest.approx(e @ e))
    scored = absorb.add_absorbed_scores(df, fit).toPandas()
    assert sorted(scored.score) == pytest.approx(sorted(e), abs=1e-8)
    assert set(scored.columns) == {*pdf.columns, "predicted", "score"}
    for effect in effects:
        assert scored.groupby(effect).score.sum().abs().max() < 1e-8


def test_terms_that_effects_determine(spark):
    pdf = panel()
    pdf["fixed"] = pdf.unit.str[1:].astype(float)
    pdf["double"] = 2 * pdf.a
    fit = absorb.fit_absorbed(spark.createDataFrame(pdf), absorb.AbsorbSpec("y", ("fixed", "a", "double", "b"), ("unit", "period"), "unit"))
    assert fit.aliased == ("fixed", "double")
    beta, *_ = dense(pdf, ("unit", "period"), ("a", "b"), "unit")
    assert [fit.coefficients[t] for t in ("a", "b")] == pytest.approx(beta, abs=1e-8)


def test_bounds(spark):
    df = spark.createDataFrame(panel())
    with pytest.raises(ValueError, match="not absorbed"):
        absorb.fit_absorbed(df, absorb.AbsorbSpec("y", ("a",), ("unit", "period"), "unit"), max_steps=1)
    with pytest.raises(ValueError, match="no complete rows"):
        absorb.fit_absorbed(df.limit(0), absorb.AbsorbSpec("y", ("a",), ("unit", "period"), "unit"))


def test_many_levels_of_two_effects(spark):
    """100,000 units over 20,000 plants, one of which holds a third of all rows."""
    rng = np.random.default_rng(5)
    n = 400_000
    unit = rng.integers(0, 100_000, n)
    plant = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, 20_000, n))
    x = rng.normal(size=n) + 0.01 * (unit % 97) + 0.001 * (plant % 31)
    y = 1.5 * x + 0.02 * (unit % 89) - 0.01 * (plant % 53) + rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"unit": unit, "plant": plant, "x": x, "y": y})).repartition(8)
    fit = absorb.fit_absorbed(df, absorb.AbsorbSpec("y", ("x",), ("plant", "unit"), "unit"), tolerance=1e-9)
    freed = [x - x.mean(), y - y.mean()]
    for _ in range(200):
        for level in (unit, plant):
            count = np.maximum(np.bincount(level), 1)
            freed = [v - (np.bincount(level, v) / count)[level] for v in freed]
    slope = freed[0] @ freed[1] / (freed[0] @ freed[0])
    assert fit.coefficients["x"] == pytest.approx(slope, abs=1e-8)
    assert fit.absorbed.order == ("unit", "plant") and fit.absorbed.steps < 60


def test_a_step_shuffles_no_rows_by_the_lead_effect(spark):
    found = absorb.absorb(spark.createDataFrame(panel()), absorb.AbsorbSpec("y", ("a",), ("unit", "period"), "unit"))
    joined = found.cells.join(found.cells.groupBy("unit").agg(F.sum("n").alias("all")), "unit")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
