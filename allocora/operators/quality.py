"""Data-quality gate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from allocora.runtime import by_unit, stage


class QualityError(ValueError):
    """A frame does not meet its declared expectations."""


def measure(df: DataFrame, unit: str, not_null: Sequence[str]) -> DataFrame:
    """Everything the gate looks at, in one aggregate."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct(unit).alias("n_units"),
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_missing") for c in not_null],
    )


def stage_measured(
    df: DataFrame, label: str, unit: str, order: str, not_null: Sequence[str] = (), partitioned: bool = False
) -> tuple[DataFrame, dict[str, int]]:
    """Write a panel as a stage table bucketed by unit, and measure it in the pass that writes it.

    The figures are those of :func:`measure` and ``n_repeated``, rows that repeat the
    unit and ``order`` of another. They are taken by the tasks that write, of which each
    partition counts once, so that a lost executor's rows are not counted twice. A row
    without a unit counts for no unit. Rows already partitioned as by
    :func:`~allocora.runtime.by_unit` (``partitioned``) are written as they lie.
    """
    seen = Observation()
    rows = Window.partitionBy(unit).orderBy(order)
    first = F.row_number().over(rows) == 1
    measured = (
        (df if partitioned else by_unit(df, unit))
        .withColumns({"_first": first, "_repeated": ~first & F.lag(order).over(rows).eqNullSafe(F.col(order))})
        .observe(
            seen,
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col("_first") & F.col(unit).isNotNull()).alias("n_units"),
            F.count_if("_repeated").alias("n_repeated"),
            *[F.count_if(F.col(c).isNull()).alias(f"{c}_missing") for c in not_null],
        )
        .drop("_first", "_repeated")
    )
    written = stage(measured, label, bucket_by=unit, sort_by=(unit, order), partitioned=True)
    return written, seen.get


def require(
    found: Mapping[str, int], n_rows: int | None = None, n_units: int | None = None, not_null: Sequence[str] = ()
) -> None:
    """Raise naming every expectation the figures break; repeated rows always do."""
    broken = []
    if n_rows is not None and found["n_rows"] != n_rows:
        broken.append(f"{found['n_rows']} rows, expected {n_rows}")
    if n_units is not None and found["n_units"] != n_units:
        broken.append(f"{found['n_units']} units, expected {n_units}")
    if found.get("n_repeated"):
        broken.append(f"{found['n_repeated']} repeated rows")
    broken += [f"{found[f'{c}_missing']} rows without {c}" for c in not_null if found[f"{c}_missing"]]
    if broken:
        raise QualityError("; ".join(broken))


def expect(
    df: DataFrame,
    unit: str = "unit",
    n_rows: int | None = None,
    n_units: int | None = None,
    not_null: Sequence[str] = (),
) -> DataFrame:
    """Return ``df`` unchanged, or raise naming every expectation it breaks."""
    require(measure(df, unit, not_null).first().asDict(), n_rows, n_units, not_null)
    return df
