import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from allocora.operators import quantiles
from allocora.operators.aggregates import box_stats, describe, flag_counts, histogram, spearman
from allocora.operators.concentration import concentration_facts, gini, lorenz, top_k_shares
from allocora.operators.ordered import average_rank, exact_quantiles, find_ranges, min_rank, order_by_value, with_order
from allocora.operators.quantiles import column_quantiles
from allocora.operators.ranking import quartile_profile, relative_position, tier_ranks


def frame_of(n=3000, hot_share=0.4, seed=3):
    """Values with nulls, ties and one value holding a large share of all rows."""
    rng = np.random.default_rng(seed)
    value = np.round(rng.normal(size=n), 1)
    value[rng.random(n) < hot_share] = 0.5
    pdf = pd.DataFrame({"id": np.arange(n), "g": rng.choice(["a", "b", "c"], n, p=[0.7, 0.2, 0.1]), "v": value})
    pdf.loc[rng.random(n) < 0.05, "v"] = None
    return pdf


def spark_frame(spark, pdf):
    rows = [tuple(None if pd.isna(x) else x for x in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame([tuple(x.item() if hasattr(x, "item") else x for x in r) for r in rows], "id long, g string, v double")


@pytest.mark.parametrize("hot_share", [0.0, 0.4])
def test_ranks_match_pandas_with_ties_and_hot_value(spark, hot_share):
    pdf = frame_of(hot_share=hot_share)
    df = spark_frame(spark, pdf)
    assert bool(find_ranges(df, "v").hot) == bool(hot_share)
    out = with_order(df, "v", {"lo": min_rank(), "avg": average_rank(), "n": F.col("total")}, ["g"]).toPandas().sort_values("id")
    by_group = pdf.groupby("g")["v"]
    assert len(out) == len(pdf)
    np.testing.assert_allclose(out["lo"].to_numpy(float), by_group.rank(method="min").to_numpy())
    np.testing.assert_allclose(out["avg"].to_numpy(float), by_group.rank().to_numpy())


def test_rows_without_group_are_a_group(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, None, 1.0), (3, "x", 5.0)], "id int, g string, v double")
    out = with_order(df, "v", {"r": min_rank()}, ["g"])
    assert {r.id: r.r for r in out.collect()} == {1: 2, 2: 1, 3: 1}


@pytest.mark.parametrize("hot_share", [0.0, 0.5])
@pytest.mark.parametrize("kind", ["string", "date", "binary", "boolean"])
def test_ranks_of_other_types(spark, kind, hot_share):
    pdf = frame_of(n=1500, hot_share=hot_share)
    pdf.loc[pdf.index % 7 == 0, "g"] = None
    numbers = spark_frame(spark, pdf)
    tenth = F.round(F.col("v") * 10).cast("int")
    made = {
        "string": F.concat(F.lit("é"), tenth.cast("string")),
        "date": F.date_add(F.lit("2000-01-01").cast("date"), tenth),
        "binary": F.encode(tenth.cast("string"), "utf-8"),
        "boolean": tenth > 3,
    }
    df = numbers.select("id", "g", made[kind].alias("v"))
    out = with_order(df, "v", {"lo": min_rank(), "avg": average_rank(), "n": F.col("total")}, ["g"]).toPandas().sort_values("id")
    keys = {"string": lambda v: f"é{round(v * 10)}", "date": lambda v: round(v * 10), "binary": lambda v: str(round(v * 10)), "boolean": lambda v: round(v * 10) > 3}
    values = pdf["v"].map(keys[kind], na_action="ignore")
    codes = values.map({v: i for i, v in enumerate(sorted(values.dropna().unique()))})
    by_group = codes.groupby(pdf["g"].fillna("none"))
    assert len(out) == len(pdf)
    np.testing.assert_allclose(out["lo"].to_numpy(float), by_group.rank(method="min").to_numpy())
    np.testing.assert_allclose(out["avg"].to_numpy(float), by_group.rank().to_numpy())
    whole = with_order(df.limit(0), "v", {"lo": min_rank()})
    assert whole.collect() == []


def test_quantiles_match_numpy(spark):
    pdf = frame_of()
    probs = {"q1": 0.25, "q2": 0.5, "q3": 0.75, "p9": 0.9}
    out = exact_quantiles(spark_frame(spark, pdf), "v", probs, ["g"]).collect()
    for row in out:
        values = pdf[pdf.g == row.g].v.dropna()
        for name, p in probs.items():
            assert row[name] == pytest.approx(np.quantile(values, p), abs=1e-12)


@pytest.mark.parametrize("ranges", [1, 2, 40])
def test_any_number_of_ranges(spark, ranges):
    pdf = frame_of()
    df = spark_frame(spark, pdf)
    out = with_order(df, "v", {"r": min_rank()}, ["g"], ranges=ranges, keep=["id"]).toPandas().sort_values("id")
    np.testing.assert_allclose(out["r"].to_numpy(float), pdf.groupby("g")["v"].rank(method="min").to_numpy())
    row = exact_quantiles(df, "v", {"q": 0.1, "m": 0.5}, ranges=ranges).first()
    assert (row.q, row.m) == (pytest.approx(pdf.v.quantile(0.1)), pytest.approx(pdf.v.median()))
    counted = order_by_value(df, "v", ranges=ranges).toPandas().sort_values("v")
    assert list(counted["before"]) == list(counted["ties"].cumsum() - counted["ties"])


def test_whole_numbers_and_infinities(spark):
    df = spark.createDataFrame([(i, i // 3) for i in range(30)], "id int, v int")
    assert {r.id: r.r for r in with_order(df, "v", {"r": min_rank()}).collect()} == {i: i // 3 * 3 + 1 for i in range(30)}
    wide = spark.createDataFrame([(float("-inf"),), (0.0,), (-0.0,), (float("inf"),)], "v double")
    assert sorted(r.r for r in with_order(wide, "v", {"r": min_rank()}).collect()) == [1, 2, 2, 4]


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert exact_quantiles(empty, "v", {"q": 0.5}, ["g"]).count() == 0
    one = spark.createDataFrame([("a", 7.0)], "g string, v double")
    assert exact_quantiles(one, "v", {"q": 0.25}, ["g"]).first().q == 7.0


def test_tier_pct_is_average_rank(spark):
    df = spark.createDataFrame([(i, "L", s) for i, s in enumerate([1.0, 1.0, 2.0, 3.0])], "unit int, tier string, s double")
    out = {r.unit: (r.tier_rank, r.tier_n, r.tier_pct) for r in tier_ranks(df, "s", "tier").collect()}
    assert out == {0: (1, 4, 0.375), 1: (1, 4, 0.375), 2: (3, 4, 0.75), 3: (4, 4, 1.0)}


def test_tier_rank_keeps_units_without_tier(spark):
    df = spark.createDataFrame([(1, "L", 1.0), (2, None, 0.0)], "unit int, tier string, s double")
    out = {r.unit: r.tier_rank for r in tier_ranks(df, "s", "tier").collect()}
    assert out == {1: 1, 2: None}


def test_quartiles_match_qcut(spark):
    rng = np.random.default_rng(5)
    values = rng.normal(size=138)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "unit int, s double")
    found = quartile_profile(df, "s", labels=["a", "b", "c", "d"]).toPandas().sort_values("unit")["profile"]
    assert list(found) == list(pd.qcut(values, 4, labels=["a", "b", "c", "d"]))


def test_quartiles_all_tied(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(6)], "unit int, s double")
    assert {r.profile for r in quartile_profile(df, "s", labels=list("abcd")).collect()} == {"a"}


def test_relative_position_text(spark):
    df = spark.createDataFrame([(1, -2.0), (2, 0.0), (3, 1.0), (4, 3.0)], "unit int, s double")
    out = {r.unit: r.position for r in relative_position(df, "s").collect()}
    assert out[1] == "More underfunded than 75% of countries"
    assert out[2] == "Right on the model line"
    assert out[4] == "Better funded than 75% of countries"


def mean_difference_share(values):
    """Gini by its definition: the mean absolute difference of all pairs, by twice the mean."""
    n = len(values)
    return sum(abs(a - b) for a in values for b in values) / n**2 / (2 * sum(values) / n)


@pytest.mark.parametrize("values", [[1.0, 2, 3, 4, 10], [5.0] * 7, [0.0, 0, 0, 8], [0.0, 1, 1, 1, 2, 2, 9]])
def test_concentration_by_definition(spark, values):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "unit int, v double")
    rising, total = sorted(values), sum(values)
    curve, held = [0.0], 0.0
    for v in rising:
        held += v
        curve.append(held / total)
    half = next(k for k, share in enumerate(curve) if share >= 0.5)
    assert gini(df, "v").first().gini == pytest.approx(mean_difference_share(values))
    points = lorenz(df, "v").orderBy("point").collect()
    assert [p.cum_value for p in points] == pytest.approx(curve)
    assert [p.cum_units for p in points] == pytest.approx([k / len(values) for k in range(len(values) + 1)])
    facts = concentration_facts(df, "v", top=2).first()
    assert facts.half_index == half
    assert facts.bottom_half_share == pytest.approx(sum(rising[: round(len(values) / 2)]) / total)
    assert facts.top_share == pytest.approx(sum(rising[-2:]) / total)


def test_concentration_of_nothing(spark):
    zeros = spark.createDataFrame([(1, 0.0), (2, 0.0)], "unit int, v double")
    assert gini(zeros, "v").first().gini is None
    assert concentration_facts(zeros, "v").first().half_index is None
    negative = spark.createDataFrame([(1, -4.0), (2, 1.0), (3, 3.0)], "unit int, v double")
    assert gini(negative, "v").first().n == 2


def test_lorenz_many_ties_over_blocks(spark):
    df = spark.range(2500).select(F.col("id").alias("unit"), F.lit(2.0).alias("v"))
    points = lorenz(df, "v")
    assert points.count() == 2501
    assert points.filter(F.abs(F.col("cum_units") - F.col("cum_value")) > 1e-9).isEmpty()


def test_top_k_beyond_all(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0)], "unit int, v double")
    assert {r.k: r.share for r in top_k_shares(df, "v", "unit", [1, 5]).collect()} == {1: 0.75, 5: 1.0}


def test_spearman_matches_ranks(spark):
    pdf = frame_of()
    pdf["w"] = np.round(pdf.v.fillna(0) + np.random.default_rng(1).normal(size=len(pdf)), 1)
    df = spark.createDataFrame([tuple(map(lambda x: None if pd.isna(x) else float(x), r)) for r in pdf[["v", "w"]].itertuples(index=False)], "v double, w double")
    both = pdf.dropna()
    row = spearman(df, "v", "w").first()
    assert row.n == len(both)
    assert row.rho == pytest.approx(both.v.rank().corr(both.w.rank()))


def test_describe_and_box(spark):
    pdf = frame_of(hot_share=0.0)
    row = describe(spark_frame(spark, pdf), ["v"]).first()
    assert (row.n, row.median, row.q25) == (pdf.v.count(), pytest.approx(pdf.v.median()), pytest.approx(pdf.v.quantile(0.25)))
    assert row["skew"] == pytest.approx(pdf.v.skew())
    assert row["std"] == pytest.approx(pdf.v.std())
    for box in box_stats(spark_frame(spark, pdf), "v", ["g"]).collect():
        v = pdf[pdf.g == box.g].v.dropna()
        q1, q3 = v.quantile(0.25), v.quantile(0.75)
        kept = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        assert (box.whisker_low, box.whisker_high) == (kept.min(), kept.max())


@pytest.mark.parametrize("accuracy", [10_000, 200])
def test_quantiles_of_many_columns_and_groups(spark, monkeypatch, accuracy):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    pdf = frame_of(n=4000, hot_share=0.3)
    pdf["w"] = np.random.default_rng(2).normal(size=len(pdf)).round(4)
    pdf.loc[pdf.index % 9 == 0, "g"] = None
    pdf["none"] = None
    df = spark_frame(spark, pdf[["id", "g", "v"]]).join(spark.createDataFrame(pdf[["id", "w"]]), "id").withColumn("none", F.lit(None).cast("double"))
    probs = {"least": 0.0, "q1": 0.25, "q2": 0.5, "p99": 0.99, "most": 1.0}
    found, figures = column_quantiles(df, ["v", "w", "none"], probs, ["g"], [F.count("*").alias("rows")])
    found = {(r.g, r["column"]): r for r in found.collect()}
    assert {r.g: r["rows"] for r in figures.collect()} == pdf.g.fillna("").value_counts().rename({"": None}).to_dict()
    assert {c for _, c in found} == {"v", "w"} and {g for g, _ in found} == {None, "a", "b", "c"}
    for (g, c), r in found.items():
        values = pdf[pdf.g.isna() if g is None else pdf.g == g][c].dropna()
        assert r.n == len(values)
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.quantile(values, p), abs=1e-12)
    whole, _ = column_quantiles(df, ["v", "none"], probs)
    assert [r["column"] for r in whole.collect()] == ["v"]
    assert column_quantiles(df.limit(0), ["v"], probs)[0].collect() == []


def test_a_wrongly_placed_quantile_fails(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "_bracket", lambda c, probs: F.array(*[F.lit(1e9) for _ in range(2 * len(probs))]))
    with pytest.raises(Exception, match="placed a quantile wrongly"):
        column_quantiles(spark_frame(spark, frame_of()), ["v"], {"q": 0.5})[0].collect()


def test_box_of_rows_without_group(spark):
    df = spark.createDataFrame([(None, float(v)) for v in range(9)] + [("a", 1.0), ("b", None)], "g string, v double")
    found = {r.g: (r.median, r.n) for r in box_stats(df, "v", ["g"]).collect()}
    assert found == {None: (4.0, 9), "a": (1.0, 1)}


def test_flag_counts_multiply_no_rows(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 1, None), (2, 0, 0), (None, 1, 1)], "unit long, a int, b int")
    counted = flag_counts(df, ["a", "b"])
    assert "Expand" not in counted._jdf.queryExecution().executedPlan().toString()
    assert {r.flag: (r.n_rows, r.pct, r.n_units) for r in counted.collect()} == {"a": (3, 75.0, 1), "b": (1, 25.0, 0)}


def test_histogram_counts(spark):
    pdf = frame_of()
    out = histogram(spark_frame(spark, pdf), "v", 20).orderBy("bin").toPandas()
    assert out["n"].sum() == pdf.v.count()
    assert len(out) == 20
    constant = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert histogram(constant, "v", 4).agg(F.sum("n")).first()[0] == 2
