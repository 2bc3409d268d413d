"""Scores, fit statistics, nested models and coefficient tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allocora.functions import fixed
from allocora.functions.labels import p_text, stars
from allocora.model.cluster import ClusteredFit
from allocora.model.gram import Gram, Solution, solve


def add_scores(df: DataFrame, s: Solution, predicted: str = "predicted", score: str = "score") -> DataFrame:
    """Fitted value and residual as plain expressions; the residual is the allocation score."""
    return df.withColumn(predicted, s.design.linear(s.coefficients)).withColumn(
        score, F.col(s.design.spec.outcome) - F.col(predicted)
    )


def fit_statistics(scored: DataFrame, outcome: str, predicted: str, n_coefficients: int) -> DataFrame:
    """R², adjusted R², mean absolute error and n of a scored frame, in one pass."""
    e = F.col(outcome) - F.col(predicted)
    sums = scored.filter(e.isNotNull()).agg(
        F.count("*").alias("n"),
        F.sum(e * e).alias("_sse"),
        (F.var_pop(outcome) * F.count("*")).alias("_sst"),
        F.avg(F.abs(e)).alias("mae"),
    )
    r2 = 1 - F.try_divide("_sse", "_sst")
    return sums.select(
        "n",
        r2.alias("r2"),
        (1 - (1 - r2) * (F.col("n") - 1) / (F.col("n") - n_coefficients)).alias("adj_r2"),
        "mae",
    )


def nested_models(g: Gram, models: Mapping[str, Sequence[str]]) -> dict[str, Solution]:
    """Solutions of several nested models from one Gram."""
    return {name: solve(g.only(["Intercept", *terms])) for name, terms in models.items()}


def coefficient_rows(spark: SparkSession, f: ClusteredFit) -> DataFrame:
    """One row per coefficient of a fit; a handful of numbers from the driver."""
    rows = []
    for i, term in enumerate(f.solution.terms):
        if term in f.solution.aliased:
            rows.append((i, term, None, None, None, None))
            continue
        t = f.term(term)
        rows.append((i, term, t["estimate"], t["se"], t["z"], t["p"]))
    return spark.createDataFrame(rows, "term_no int, term string, coef double, se double, z double, p double")


def coefficient_table(
    coefficients: DataFrame, hidden: str, labels: Mapping[str, str], order: Sequence[str]
) -> DataFrame:
    """Report table: labelled, ordered, with formatted p-value, stars and interval.

    Terms matching the pattern ``hidden`` are left out.
    """
    spark = coefficients.sparkSession
    names = spark.createDataFrame(
        [(t, labels.get(t, t), i) for i, t in enumerate(order, 1)], "term string, label string, place int"
    )
    margin = fixed.CI_Z * F.col("se")
    return (
        coefficients.filter(~F.col("term").rlike(hidden))
        .join(names, "term", "left")
        .select(
            F.coalesce("place", F.lit(99)).alias("place"),
            F.coalesce("label", "term").alias("predictor"),
            "coef",
            "se",
            p_text("p").alias("p_text"),
            stars("p").alias("sig"),
            (F.col("coef") - margin).alias("lo"),
            (F.col("coef") + margin).alias("hi"),
            ((F.col("coef") - margin > 0) | (F.col("coef") + margin < 0)).alias("significant"),
        )
    )
