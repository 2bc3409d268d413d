import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from allocora.model import cluster, cv, gram, score
from allocora.model.spec import ModelSpec

SPEC = ModelSpec("y", ("a", "b"), (("tier", "L"), ("period", None)))


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    units = 120
    rows = []
    for u in range(units):
        tier = rng.choice(["L", "M", "H"])
        effect = rng.normal()
        for period in range(2000, 2000 + rng.integers(1, 8)):
            a, b = rng.normal() + 10, rng.normal() * 3
            y = 1 + 2 * a - 0.5 * b + {"L": 0, "M": 1, "H": 2}[tier] + 0.1 * (period - 2000) + effect + rng.normal()
            rows.append((u, period, tier, float(a), float(b), float(y)))
    pdf = pd.DataFrame(rows, columns=["unit", "period", "tier", "a", "b", "y"])
    return pdf, spark.createDataFrame(pdf).repartition(7).cache()


def design_matrix(pdf):
    columns = {"Intercept": np.ones(len(pdf)), "a": pdf.a, "b": pdf.b}
    for level in ("H", "M"):
        columns[f"tier[{level}]"] = (pdf.tier == level) * 1.0
    for p in sorted(pdf.period.unique())[1:]:
        columns[f"period[{p}]"] = (pdf.period == p) * 1.0
    return pd.DataFrame(columns)


def sandwich(x, e, groups):
    bread = np.linalg.inv(x.T @ x)
    sums = pd.DataFrame(x * e[:, None]).groupby(np.asarray(groups)).sum().to_numpy()
    g, (n, k) = len(sums), x.shape
    return bread @ (sums.T @ sums) @ bread * g / (g - 1) * (n - 1) / (n - k)


def test_fit_matches_dense_least_squares(data):
    pdf, df = data
    x = design_matrix(pdf)
    beta = np.linalg.lstsq(x.to_numpy(), pdf.y.to_numpy(), rcond=None)[0]
    e = pdf.y.to_numpy() - x.to_numpy() @ beta
    found = gram.fit(df, SPEC)
    assert set(found.terms) == set(x.columns) and not found.aliased
    for t, b in zip(x.columns, beta):
        assert found.coefficients[t] == pytest.approx(b, abs=1e-9)
    assert found.r2 == pytest.approx(1 - (e @ e) / ((pdf.y - pdf.y.mean()) ** 2).sum())
    f = cluster.cluster_fit(df, found)
    expected = np.sqrt(np.diag(sandwich(x.to_numpy(), e, pdf.unit)))
    for t, se in zip(x.columns, expected):
        assert f.term(t)["se"] == pytest.approx(se, rel=1e-8)
    assert f.clusters == pdf.unit.nunique()


def test_residual_invariants(data):
    _, df = data
    scored = score.add_scores(df, gram.fit(df, SPEC))
    row = scored.agg(F.sum("score").alias("s"), F.sum(F.col("score") * F.col("a")).alias("a")).first()
    assert abs(row.s) < 1e-8 and abs(row.a) < 1e-7
    for by in ("tier", "period"):
        assert all(abs(r.m) < 1e-9 for r in scored.groupBy(by).agg(F.avg("score").alias("m")).collect())


def test_duplicated_rows_leave_coefficients(data):
    _, df = data
    once, twice = gram.fit(df, SPEC), gram.fit(df.unionByName(df), SPEC)
    for t in once.terms:
        assert twice.coefficients[t] == pytest.approx(once.coefficients[t], abs=1e-9)


def test_aliased_column_is_named(data):
    _, df = data
    spec = ModelSpec("y", ("a", "b", "c"), (("tier", "L"),))
    found = gram.fit(df.withColumn("c", F.col("a") * 2 - F.col("b")), spec)
    assert found.aliased == ("c",)
    assert found.rank == len(found.terms) - 1


def test_product_term_and_combination(data):
    pdf, df = data
    spec = ModelSpec("y", ("a", "b"), (("tier", "L"), ("period", None)), (("a", "post"),))
    rows = df.withColumn("post", (F.col("period") >= 2003).cast("int"))
    f = cluster.cluster_fit(rows, gram.fit(rows, spec))
    x = design_matrix(pdf)
    x["a:post"] = pdf.a * (pdf.period >= 2003)
    beta = np.linalg.lstsq(x.to_numpy(), pdf.y.to_numpy(), rcond=None)[0]
    cov = sandwich(x.to_numpy(), pdf.y.to_numpy() - x.to_numpy() @ beta, pdf.unit)
    i, j = list(x.columns).index("a"), list(x.columns).index("a:post")
    both = f.combination({"a": 1.0, "a:post": 1.0})
    assert both["estimate"] == pytest.approx(beta[i] + beta[j], abs=1e-8)
    assert both["se"] == pytest.approx(math.sqrt(cov[i, i] + cov[j, j] + 2 * cov[i, j]), rel=1e-6)


def test_nested_and_split_from_one_pass(data):
    pdf, df = data
    whole = gram.gram(df, gram.make_design(df, SPEC))
    small = score.nested_models(whole, {"small": ("a",)})["small"]
    slope, intercept = np.polyfit(pdf.a, pdf.y, 1)
    assert small.coefficients["a"] == pytest.approx(slope) and small.coefficients["Intercept"] == pytest.approx(intercept)
    parts = gram.grams_by(df.withColumn("late", F.col("period") >= 2003), gram.make_design(df, SPEC), "late")
    assert sum(g.n for g in parts.values()) == whole.n
    late = pdf[pdf.period >= 2003]
    x = design_matrix(late)
    beta = np.linalg.lstsq(x.to_numpy(), late.y.to_numpy(), rcond=None)[0]
    assert gram.solve(parts[True]).coefficients["a"] == pytest.approx(beta[1], abs=1e-8)


def test_many_fits_share_one_pass(data):
    pdf, df = data
    rows = df.withColumn("late", F.col("period") >= 2003)
    design = gram.make_design(df, SPEC)
    fits = score.nested_models(gram.gram(df, design), {"small": ("a",), "both": ("a", "b"), "all": design.terms[1:]})
    parts = {side: gram.solve(g) for side, g in gram.grams_by(rows, design, "late").items()}
    where = {str(side): F.col("late") == side for side in parts}
    together = cluster.cluster_fits(rows, fits | {str(side): s for side, s in parts.items()}, where)
    for name, s in fits.items():
        alone = cluster.cluster_fit(df, s)
        assert together[name].clusters == alone.clusters
        np.testing.assert_allclose(together[name].covariance, alone.covariance, rtol=1e-9, atol=1e-14)
    for side, s in parts.items():
        alone = cluster.cluster_fit(rows.filter(F.col("late") == side), s)
        assert together[str(side)].clusters == alone.clusters == pdf[(pdf.period >= 2003) == side].unit.nunique()
        np.testing.assert_allclose(together[str(side)].covariance, alone.covariance, rtol=1e-9, atol=1e-14)
    plan = cluster.cluster_scores(rows, fits | {str(side): s for side, s in parts.items()}, where)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(unit") == 1


def test_fits_of_one_pass_need_one_cluster(data):
    _, df = data
    other = ModelSpec("y", ("a",), cluster="period")
    with pytest.raises(ValueError, match="one cluster"):
        cluster.cluster_fits(df, {"x": gram.fit(df, SPEC), "y": gram.fit(df, other)})


def test_too_many_levels_for_dummies(spark):
    df = spark.range(2000).selectExpr("id AS unit", "CAST(id AS DOUBLE) AS y", "id AS level")
    with pytest.raises(ValueError, match="levels of level"):
        gram.fit(df, ModelSpec("y", (), (("level", None),)))


def test_vif_matches_regressions(data):
    pdf, df = data
    rows = df.withColumn("c", F.col("a") + F.col("b") * 0.3 + F.col("y"))
    spec = ModelSpec("y", ("a", "b", "c"))
    found = gram.vif(gram.gram(rows, gram.make_design(rows, spec)), ["a", "b", "c"])
    x = np.column_stack([pdf.a, pdf.b, pdf.a + pdf.b * 0.3 + pdf.y])
    for i, name in enumerate("abc"):
        others = np.column_stack([np.ones(len(x)), np.delete(x, i, 1)])
        fitted = others @ np.linalg.lstsq(others, x[:, i], rcond=None)[0]
        r2 = 1 - ((x[:, i] - fitted) ** 2).sum() / ((x[:, i] - x[:, i].mean()) ** 2).sum()
        assert found[name] == pytest.approx(1 / (1 - r2))


def test_group_cv_matches_refits(data):
    pdf, df = data
    out = {r.fold: r for r in cv.group_cv(cv.key_fold(df, "unit"), SPEC).collect()}
    x = design_matrix(pdf).to_numpy()
    for fold in range(5):
        held = (pdf.unit % 5 == fold).to_numpy()
        beta = np.linalg.lstsq(x[~held], pdf.y[~held], rcond=None)[0]
        e = pdf.y[held] - x[held] @ beta
        assert out[fold].r2 == pytest.approx(1 - (e**2).sum() / ((pdf.y[held] - pdf.y[held].mean()) ** 2).sum(), abs=1e-9)
        assert out[fold].mae == pytest.approx(e.abs().mean())


def test_hash_folds_keep_units_whole(data):
    _, df = data
    folds = cv.hash_fold(df, "unit")
    assert folds.groupBy("unit").agg(F.countDistinct("fold").alias("n")).filter("n > 1").isEmpty()


def lightest_fold_first(sizes, k):
    """Brute force: one unit at a time to the lightest fold, lowest number among ties."""
    loads, out = [0] * k, []
    for size in sizes:
        f = loads.index(min(loads))
        out.append(f)
        loads[f] += size
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=80), st.integers(2, 6))
def test_fold_order_equals_brute_force(sizes, k):
    sizes = sorted(sizes, reverse=True)
    classes = [(s, sizes.count(s)) for s in sorted(set(sizes))]
    sequences = cv.fold_order(classes, k)
    found = []
    for size, count in sorted(classes, reverse=True):
        sequence = sequences[size]
        start = max(len(sequence) - k, 0)
        found += [sequence[i if i < start else start + (i - start) % k] for i in range(count)]
    assert found == lightest_fold_first(sizes, k)


def test_balanced_folds_on_frame(data):
    pdf, df = data
    out = cv.balanced_fold(df.select("unit", "period"), "unit").select("unit", "fold").distinct().collect()
    sizes = pdf.groupby("unit").size().reset_index(name="n").sort_values(["n", "unit"], ascending=[False, True])
    expected = dict(zip(sizes.unit, lightest_fold_first(sizes.n, 5)))
    assert {r.unit: r.fold for r in out} == expected


def test_balanced_folds_on_text_keys(data):
    pdf, df = data
    out = cv.balanced_fold(df.select(F.concat(F.lit("u"), F.col("unit")).alias("unit"), "period"), "unit").select("unit", "fold").distinct().collect()
    sizes = pdf.assign(unit="u" + pdf.unit.astype(str)).groupby("unit").size().reset_index(name="n").sort_values(["n", "unit"], ascending=[False, True])
    expected = dict(zip(sizes.unit, lightest_fold_first(sizes.n, 5)))
    assert {r.unit: r.fold for r in out} == expected


def test_balanced_folds_with_one_very_large_unit(spark):
    df = spark.range(3000).selectExpr("IF(id < 2000, 0, id) AS unit", "id AS period")
    loads = {r.fold: r["count"] for r in cv.balanced_fold(df, "unit").groupBy("fold").count().collect()}
    assert loads == {0: 2000, 1: 250, 2: 250, 3: 250, 4: 250}


def test_coefficient_table(spark, data):
    _, df = data
    rows = score.coefficient_rows(spark, cluster.cluster_fit(df, gram.fit(df, SPEC)))
    table = score.coefficient_table(rows, r"^period\[", {"a": "A"}, ["b", "a", "Intercept"]).orderBy("place").collect()
    assert [r.predictor for r in table][:2] == ["b", "A"]
    assert not any(r.predictor.startswith("period") for r in table)
    assert table[1].sig == "***" and table[1].p_text == "<0.001" and table[1].significant
