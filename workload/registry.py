"""Query registry and the stage tables the queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allocora.functions import numeric
from allocora.model.gram import Solution, fit
from allocora.model.score import add_scores
from allocora.operators.quality import stage_measured
from allocora.operators.trend import region_gap_trend, unit_projection
from allocora.plans import order_panel as op
from allocora.plans.unit_table import unit_table
from allocora.runtime import stage
from workload import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, select: str | None = None, uses: str = "panel"):
    """Register a query; ``select`` runs over the common tables up to ``uses``."""

    def register(fn: Callable[[Stages], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Stages.of(spark, sf_dir))
        if select is not None:
            ORACLES[name] = sql.compose(uses, select)
        return fn

    return register


class Stages:
    """Stage tables of one data folder, each written once per application."""

    _known: dict[tuple[str, str], Stages] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, object] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Stages:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._known:
            cls._known = {k: v for k, v in cls._known.items() if k[0] == key[0]}
            cls._known[key] = cls(spark, sf_dir)
        return cls._known[key]

    def _once(self, name: str, make: Callable[[], object]):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def _bucketed(self, df: DataFrame, label: str) -> DataFrame:
        return stage(df, label, bucket_by="unit", sort_by=("unit", "period"), partitioned=True)

    def table(self, name: str) -> DataFrame:
        return op.table(self.spark, self.sf_dir, name)

    @property
    def panel(self) -> DataFrame:
        return self._once(
            "panel",
            lambda: self._bucketed(op.order_panel(self.spark, self.sf_dir), "panel"),
        )

    @property
    def model(self) -> DataFrame:
        return self._measured_model[0]

    @property
    def model_figures(self) -> dict[str, int]:
        """What the quality gate looks at, measured while the model's rows were written."""
        return self._measured_model[1]

    @property
    def _measured_model(self) -> tuple[DataFrame, dict[str, int]]:
        complete = ["outcome", *op.INPUTS, "tier"]
        return self._once(
            "model",
            lambda: stage_measured(op.model_frame(self.panel), "model", "unit", "period", complete, partitioned=True),
        )

    @property
    def solution(self) -> Solution:
        return self._once("solution", lambda: fit(self.model, op.SPEC))

    @property
    def scored(self) -> DataFrame:
        return self._once(
            "scored",
            lambda: self._bucketed(add_scores(self.model, self.solution), "scored"),
        )

    @property
    def units(self) -> DataFrame:
        return self._once("units", lambda: stage(unit_table(self.scored), "units", bucket_by="unit"))

    @property
    def projection(self) -> DataFrame:
        def make():
            attributes = ["unit_name", "region", "profile", "tier"]
            return stage(
                unit_projection(self.panel, self.units, attributes, op.BASE_PERIOD, op.HORIZON),
                "projection",
                bucket_by="unit",
            )

        return self._once("projection", make)

    @property
    def periods(self) -> list[int]:
        """All periods from the first to the last that the panel holds."""

        def make():
            ends = self.panel.agg(F.min("period").alias("first"), F.max("period").alias("last")).first()
            return list(range(ends["first"], ends["last"] + 1)) if ends["first"] is not None else []

        return self._once("periods", make)

    @property
    def regional(self) -> DataFrame:
        return region_gap_trend(self.scored, op.BASE_PERIOD, op.HORIZON)


def rnd(c, digits: int):
    """Rounded double without negative zero."""
    return numeric.rounded(c, digits)


def r6(*names: str):
    return [rnd(n, 6).alias(n) for n in names]


def r9(*names: str):
    """For averages of two-decimal figures, whose sixth decimal is often a half-way case."""
    return [rnd(n, 9).alias(n) for n in names]


def r4up(*names: str):
    """For large averages of two-decimal figures: four decimals, half-way cases always up."""
    return [rnd(F.col(n) + F.lit(1e-9), 4).alias(n) for n in names]
