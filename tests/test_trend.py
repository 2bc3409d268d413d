import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from allocora.functions.labels import abs_gap_trend, direction, gap_status
from allocora.functions.tails import chi2_tail, normal_two_sided, trend_p_value
from allocora.operators import rank_tests, trend
from allocora.operators.slopes import count_inversions, inversions, median_slope


def t_tail(r2, n):
    """Two-sided p by integrating Student's density."""
    df = n - 2
    t = math.sqrt(r2 * df / (1 - r2))
    x = np.linspace(0, math.atan(t / math.sqrt(df)), 20001)
    y = np.cos(x) ** (df - 1)
    area = np.sum((y[1:] + y[:-1]) / 2) * (x[1] - x[0])
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return 1 - 2 * scale * area


def test_p_value_matches_density(spark):
    cases = [(r2, n) for r2 in (0.0, 0.03, 0.3, 0.72, 0.97) for n in (3, 4, 5, 6, 7, 14, 15, 40, 101)]
    df = spark.createDataFrame(cases, "r2 double, n bigint").withColumn("p", trend_p_value(F.col("r2"), F.col("n")))
    for r in df.collect():
        assert r.p == pytest.approx(t_tail(r.r2, r.n), abs=1e-7)


def test_p_value_missing(spark):
    df = spark.createDataFrame([(0.5, 2), (None, 9), (1.0, 5)], "r2 double, n bigint")
    assert [r[0] for r in df.select(trend_p_value(F.col("r2"), F.col("n"))).collect()] == [None, None, 0.0]


def test_tails():
    assert normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert chi2_tail(0.6437, 3) == pytest.approx(0.886, abs=5e-4)
    assert chi2_tail(10.5674, 3) == pytest.approx(0.0143, abs=5e-5)
    assert chi2_tail(5.991464547, 2) == pytest.approx(0.05)
    assert chi2_tail(3.841458821, 1) == pytest.approx(0.05)
    assert chi2_tail(11.07049769, 5) == pytest.approx(0.05)
    assert chi2_tail(0, 4) == 1.0


def test_fit_and_degenerate_groups(spark):
    rows = [("line", 2000 + i, 1.0 + 2 * i) for i in range(5)]
    rows += [("flat", 2000 + i, 3.0) for i in range(4)]
    rows += [("two", 2000, 1.0), ("two", 2005, 2.0), ("one", 2001, 4.0), ("gap", 2000, None)]
    df = spark.createDataFrame(rows, "g string, period int, v double")
    out = {r.g: r for r in trend.trend_fit(df, ["g"], "v").collect()}
    assert "gap" not in out
    assert out["line"].slope == pytest.approx(2) and out["line"].intercept == pytest.approx(1 - 4000)
    assert out["line"].p == pytest.approx(0, abs=1e-7) and out["line"].n_periods == 5
    assert out["flat"].slope == 0 and out["flat"].p is None
    assert out["two"].p is None and out["two"].slope == pytest.approx(0.2)
    assert out["one"].slope is None and out["one"].p is None


def test_projection_labels(spark):
    df = spark.createDataFrame([(0.5, 1.0), (-0.5, -2.0), (0.3, 0.5)], "slope double, annual double")
    out = df.select(direction("annual").alias("d"), gap_status(F.lit(-1.0), "slope").alias("s")).collect()
    assert [r.d for r in out] == ["Flat", "Falling", "Flat"]
    assert [r.s for r in out] == ["closing", "widening", "closing"]
    edge = spark.createDataFrame([(0.02, 2), (-0.02, 3), (0.0, 3), (0.02, 9)], "s double, n int")
    assert [r[0] for r in edge.select(abs_gap_trend("s", "n")).collect()] == ["Too few years", "Narrowing", "Steady", "Widening"]


def test_projection_floor(spark):
    fits = spark.createDataFrame([(-0.5, 1000.0, 0.01)], "slope double, intercept double, p double")
    plain = trend.project_log(fits, 2001, 2008).first()
    assert plain.fit_horizon < 0 and plain.trend_significant and plain.direction == "Falling"
    assert trend.project_log(fits, 2001, 2008, floor_at_zero=True).first().fit_horizon == 0


def brute_theil_sen(t, v):
    i, j = np.triu_indices(len(t), 1)
    return float(np.median((v[j] - v[i]) / (t[j] - t[i])))


def test_theil_sen_short_and_long_series(spark):
    rng = np.random.default_rng(2)
    rows, expected = [], {}
    for g, m in (("short", 9), ("even", 8), ("long", 300), ("single", 1)):
        t = np.sort(rng.choice(5000, m, replace=False))
        v = 0.3 * t + rng.normal(size=m)
        rows += [(g, int(a), float(b)) for a, b in zip(t, v)]
        expected[g] = brute_theil_sen(t.astype(float), v) if m > 1 else None
    df = spark.createDataFrame(rows, "g string, period int, v double")
    out = {r.g: r.theil_sen for r in trend.theil_sen(df, ["g"], "v").collect()}
    assert out["single"] is None
    for g in ("short", "even", "long"):
        assert out[g] == pytest.approx(expected[g])


@pytest.mark.parametrize("m", [3, 50, 400, 401])
@pytest.mark.parametrize("tied", [False, True])
def test_median_slope_in_small_blocks(m, tied):
    rng = np.random.default_rng(m)
    t = np.arange(m, dtype=float)
    v = np.round(rng.normal(size=m), 0 if tied else 9)
    assert median_slope(t, v, block=50) == pytest.approx(brute_theil_sen(t, v), abs=1e-12)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 100])
def test_inversions(n):
    order = np.random.default_rng(n).permutation(n)
    expected = {(int(order[p]), int(order[q])) for p in range(n) for q in range(p + 1, n) if order[p] > order[q]}
    larger, smaller = inversions(order)
    assert sorted(zip(larger.tolist(), smaller.tolist())) == sorted(expected)
    assert count_inversions(order) == len(expected)


@pytest.mark.parametrize("kind", ["equal periods", "few values", "one line", "flat", "far off", "steps"])
@pytest.mark.parametrize("m", [60, 151])
def test_median_slope_of_awkward_points(kind, m):
    rng = np.random.default_rng(m)
    t = np.arange(m, dtype=float)
    v = rng.normal(size=m)
    if kind == "equal periods":
        t = np.sort(rng.integers(0, 12, m)).astype(float)
    elif kind == "few values":
        v = rng.integers(0, 3, m).astype(float)
    elif kind == "one line":
        v = 0.1 * t + 3
    elif kind == "flat":
        v = np.zeros(m)
    elif kind == "far off":
        t, v = t * 1e-3 + 1e6, v * 1e-6 + 1e5
    else:
        v = np.floor(t / 7)
    i, j = np.triu_indices(m, 1)
    i, j = i[t[j] > t[i]], j[t[j] > t[i]]
    expected = float(np.median((v[j] - v[i]) / (t[j] - t[i])))
    shuffled = rng.permutation(m)
    assert median_slope(t[shuffled], v[shuffled], block=40) == pytest.approx(expected, rel=1e-12, abs=1e-15)


def test_one_long_series(spark):
    import time

    rng = np.random.default_rng(8)
    n = 100_000
    t = np.arange(n, dtype=float)
    v = 0.25 * t + rng.standard_cauchy(n)
    start = time.perf_counter()
    found = median_slope(t, v)
    assert time.perf_counter() - start < 30
    assert found == pytest.approx(0.25, abs=1e-4)
    # The same points as a smaller block of slopes sees them.
    assert median_slope(t, v, block=200_000) == found
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "period": t.astype(int), "v": v}))
    assert trend.theil_sen(df, ["g"], "v").first().theil_sen == found


def test_rank_tests_by_hand(spark):
    groups = {"a": [1.0, 2, 2, 5], "b": [2.0, 6, 7], "c": [3.0, 8, 9, 9, 10]}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    import pandas as pd

    pdf = df.toPandas()
    ranks = pdf.v.rank()
    n = len(pdf)
    ties = sum(c**3 - c for c in pdf.v.value_counts())
    h = 12 / (n * (n + 1)) * sum(ranks[pdf.g == g].sum() ** 2 / (pdf.g == g).sum() for g in groups) - 3 * (n + 1)
    found = rank_tests.kruskal(df, "v", "g", ["a", "b", "c"])
    assert found["h"] == pytest.approx(h / (1 - ties / (n**3 - n)))
    assert found["p"] == pytest.approx(math.exp(-found["h"] / 2))
    pair = rank_tests.mann_whitney(df, "v", "g", "a", "c")
    u = sum((x > y) + 0.5 * (x == y) for x in groups["a"] for y in groups["c"])
    assert pair["u"] == u and 0 < pair["p"] < 0.1


def test_exact_rank_sum_by_enumeration(spark):
    from itertools import combinations

    from allocora.functions.tails import rank_sum_two_sided

    for m, n in ((1, 4), (3, 5), (4, 4)):
        us = [sum(ranks) - m * (m + 1) / 2 for ranks in combinations(range(1, m + n + 1), m)]
        for u in sorted(set(us)):
            tail = sum(x >= max(u, m * n - u) for x in us) / len(us)
            assert rank_sum_two_sided(u, m, n) == pytest.approx(min(1.0, 2 * tail))
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 4.0), ("b", 5.0)], "g string, v double")
    exact = rank_tests.mann_whitney(df, "v", "g", "a", "b", method="exact")
    assert exact == {"n1": 2, "n2": 3, "u": 0.0, "p": pytest.approx(0.2)}
    assert rank_tests.mann_whitney(df, "v", "g", "a", "b")["p"] != exact["p"]
    tied = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 2.0)], "g string, v double")
    with pytest.raises(ValueError, match="exact"):
        rank_tests.mann_whitney(tied, "v", "g", "a", "b", method="exact")


def test_rank_tests_without_variation(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "g string, v double")
    assert rank_tests.kruskal(df, "v", "g", ["a", "b"])["h"] is None
    assert rank_tests.mann_whitney(df, "v", "g", "a", "b")["p"] is None
    assert rank_tests.kruskal(df, "v", "g", ["a", "z"])["h"] is None


def test_theil_sen_leaves_out_equal_periods(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 5.0), ("a", 2, 2.0), ("a", 4, 9.0), ("b", 3, 1.0), ("b", 3, 2.0)], "g string, period int, y double")
    got = {r.g: r.theil_sen for r in trend.theil_sen(df, ["g"], "y").collect()}
    slopes = sorted([1.0, -3.0, 8 / 3, 4 / 3, 3.5])
    assert got == {"a": pytest.approx(slopes[2]), "b": None}


def test_p_value_of_any_count(spark):
    rows = [(r2, n) for n in (3, 4, 5, 10, 31, 1000, 3_000_000) for r2 in (0.0, 1e-7, 0.01, 0.3, 0.9, 1.0)]
    df = spark.createDataFrame(rows, "r2 double, n long")
    got = {(r.r2, r.n): r.p for r in df.withColumn("p", trend_p_value(F.col("r2"), F.col("n"))).collect()}
    for r2, n in rows:
        angle, df_ = math.asin(math.sqrt(r2)), n - 2
        if n <= 31:
            # Finite sums of Student's t for whole degrees of freedom.
            sine, cosine_sq = math.sin(angle), math.cos(angle) ** 2
            if df_ % 2:
                term, total = math.cos(angle), 0.0
                for j in range(1, (df_ - 1) // 2 + 1):
                    total += term
                    term *= cosine_sq * 2 * j / (2 * j + 1)
                inside = (angle + sine * total) * 2 / math.pi
            else:
                term, total = 1.0, 0.0
                for j in range(1, df_ // 2 + 1):
                    total += term
                    term *= cosine_sq * (2 * j - 1) / (2 * j)
                inside = sine * total
            assert got[r2, n] == pytest.approx(1 - inside, abs=1e-11)
        elif n == 3_000_000 and r2 < 0.5:
            z = math.sqrt(r2 * df_ / (1 - r2))
            assert got[r2, n] == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-6)
