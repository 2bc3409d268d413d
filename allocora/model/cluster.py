"""Cluster-robust covariance and coefficient tests."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allocora.functions.tails import normal_two_sided
from allocora.model.gram import Solution
from allocora.model.spec import dummy_name


def _score_sums(s: Solution, rows: Column, name: str) -> list[Column]:
    """Per fitted term Σ x·e over the rows of a fit, and their number."""
    design = s.design
    e = F.col(design.spec.outcome) - design.linear(s.coefficients)
    sums = [F.count_if(rows).alias(f"{name}_n")]
    for i, term in enumerate(s.kept):
        if term == "Intercept":
            x = e
        elif term in design.centres:
            x = design.centred(term) * e
        else:
            column, level = next((c, v) for c, v in design.dummies if dummy_name(c, v) == term)
            x = F.when(F.col(column) == F.lit(level), e).otherwise(F.lit(0.0))
        sums.append(F.sum(F.when(rows, x).otherwise(F.lit(0.0))).alias(f"{name}_{i}"))
    return sums


def cluster_scores(df: DataFrame, fits: Mapping[str, Solution], where: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per cluster with the score sums of all fits, each over its own complete rows for which ``where`` holds."""
    clusters = {s.design.spec.cluster for s in fits.values()}
    if len(clusters) != 1:
        raise ValueError("the fits of one pass need one cluster column")
    sums = []
    for at, (name, s) in enumerate(fits.items()):
        rows = F.lit(True)
        for c in s.design.spec.inputs:
            rows = rows & F.col(c).isNotNull()
        if where and name in where:
            rows = rows & F.coalesce(where[name], F.lit(False))
        sums += _score_sums(s, rows, f"u{at}")
    return df.groupBy(*clusters).agg(*sums)


def cluster_meats(df: DataFrame, fits: Mapping[str, Solution], where: Mapping[str, Column] | None = None) -> dict[str, tuple[np.ndarray, int]]:
    """Per fit Σ over clusters of score·score' and the number of clusters, from one pass over the rows.

    A task adds up a block per fit. The blocks meet row by row, so the driver gets
    one row per fitted term of each fit.
    """
    sizes = [s.rank for s in fits.values()]
    columns = [[f"u{at}_{i}" for i in range(k)] for at, k in enumerate(sizes)]
    wide = max(sizes)

    def outer_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = [np.zeros((k, wide)) for k in sizes]
        clusters = [0] * len(sizes)
        for batch in batches:
            for at, k in enumerate(sizes):
                u = batch[columns[at]].to_numpy(float)
                totals[at][:, :k] += u.T @ u
                clusters[at] += int((batch[f"u{at}_n"] > 0).sum())
        for at, k in enumerate(sizes):
            rows = pd.DataFrame(totals[at], columns=[f"c{i}" for i in range(wide)])
            yield rows.assign(fit=at, term=np.arange(k), clusters=clusters[at])

    schema = ", ".join([*(f"c{i} double" for i in range(wide)), "fit int", "term int", "clusters bigint"])
    parts = cluster_scores(df, fits, where).drop(*{s.design.spec.cluster for s in fits.values()}).mapInPandas(outer_sums, schema)
    added = parts.groupBy("fit", "term").agg(F.sum("clusters").alias("clusters"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(wide)])
    meats = [np.zeros((k, k)) for k in sizes]
    clusters = [0] * len(sizes)
    for r in added.collect():
        meats[r["fit"]][r["term"]] = [r[f"c{i}"] for i in range(sizes[r["fit"]])]
        clusters[r["fit"]] = int(r["clusters"])
    return {name: (meats[at], clusters[at]) for at, name in enumerate(fits)}


@dataclass(frozen=True)
class ClusteredFit:
    """A solution with its cluster-robust covariance (original scale)."""

    solution: Solution
    covariance: np.ndarray
    clusters: int

    def index(self, term: str) -> int:
        return self.solution.kept.index(term)

    def combination(self, weights: Mapping[str, float]) -> dict[str, float]:
        """Estimate, standard error, z and p of a weighted sum of coefficients."""
        c = np.zeros(self.solution.rank)
        for term, w in weights.items():
            c[self.index(term)] = w
        estimate = sum(w * self.solution.coefficients[t] for t, w in weights.items())
        se = float(np.sqrt(max(c @ self.covariance @ c, 0.0)))
        z = estimate / se if se else math.nan
        return {"estimate": estimate, "se": se, "z": z, "p": normal_two_sided(z)}

    def term(self, term: str) -> dict[str, float]:
        return self.combination({term: 1.0})


def cluster_fits(df: DataFrame, fits: Mapping[str, Solution], where: Mapping[str, Column] | None = None) -> dict[str, ClusteredFit]:
    """Sandwich covariances by cluster with the usual small-sample factor, of any number of fits in one pass."""
    out = {}
    for name, (meat, clusters) in cluster_meats(df, fits, where).items():
        s = fits[name]
        factor = clusters / (clusters - 1) * (s.n - 1) / (s.n - s.rank)
        centred = s.inverse @ meat @ s.inverse * factor
        shift = s.uncentre()
        out[name] = ClusteredFit(s, shift @ centred @ shift.T, clusters)
    return out


def cluster_fit(df: DataFrame, s: Solution) -> ClusteredFit:
    """The same for one fit."""
    return cluster_fits(df, {"": s})[""]
