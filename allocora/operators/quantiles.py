"""Exact quantiles of many columns and groups in two reads.

The first read takes a rank sketch per column and group, which places two values
round each wanted position: the sketch errs by a known share of the rows, and the two
lie twice as far apart. The second read counts what lies below and between them, the
latter by value. The position is among these few values, which alone are sorted, and
that in ranges of their own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allocora.operators.ordered import join_ranges, range_offsets
from allocora.runtime import shuffle_width, small_table, stage

#: The sketches' ranks err by at most one in this many rows.
ACCURACY = 10_000
_BELOW, _INSIDE = 0, 1


def _bracket(column: str, probs: Sequence[float]) -> Column:
    """Two values round each wanted position; where the sketch's error is less than a row, the smallest and largest."""
    value = F.col(column).cast("double")
    around = [min(max(p + side * 2 / ACCURACY, 0.0), 1.0) for p in probs for side in (-1, 1)]
    ends = F.array(*[end for _ in probs for end in (F.min(value), F.max(value))])
    return F.when(F.count(column) <= ACCURACY, ends).otherwise(F.percentile_approx(value, around, ACCURACY))


def column_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Mapping[str, float], by: Sequence[str] = (), figures: Sequence[Column] = ()
) -> tuple[DataFrame, DataFrame]:
    """Linearly interpolated exact quantiles per group and column, and ``figures`` per group from the first read.

    The first frame has the group columns, ``column``, ``n`` (values) and one column
    per entry of ``probs``; a column without values has no row. Rows without a group
    are a group. Should a sketch ever place a position wrongly the query fails
    rather than give another value.
    """
    marks = list(probs.values())
    sketched = df.groupBy(*by).agg(*[_bracket(c, marks).alias(f"_q_{i}") for i, c in enumerate(columns)], *figures)
    if by:
        sketched = stage(sketched, "brackets")
        limits = sketched.select(*[F.col(b).alias(f"_by_{b}") for b in by], *[f"_q_{i}" for i in range(len(columns))])
        same = F.lit(True)
        for b in by:
            same = same & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
        rows = df.select(*by, *columns).join(small_table(limits), same)
        bounds = F.array(*[F.col(f"_q_{i}") for i in range(len(columns))])
    else:
        found = sketched.first()
        sketched = df.sparkSession.createDataFrame([found], sketched.schema)
        rows = df.select(*columns)
        bounds = F.array(*[F.array(*[F.lit(v).cast("double") for v in found[f"_q_{i}"] or [None] * (2 * len(marks))]) for i in range(len(columns))])

    width = shuffle_width(df.sparkSession)
    # One value below the other first, so that what follows is one expression whatever the number of columns.
    values = F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in columns])
    kept = ["_i", *by, *[c for c in rows.columns if c.startswith("_q_")]]
    long = rows.select("*", F.posexplode(values).alias("_i", "_v")).filter("_v IS NOT NULL").select(*kept, "_v")
    long = long.select(*by, "_i", "_v", F.element_at(bounds, F.col("_i") + 1).alias("_q"))
    value, q = F.col("_v"), F.col("_q")
    states = [(value >= q[2 * k]).cast("int") + (value > q[2 * k + 1]).cast("int") for k in range(len(marks))]
    long = long.select("*", *[s.alias(f"_s{k}") for k, s in enumerate(states)])
    code, inside, part = F.lit(0).cast("long"), F.lit(False), F.lit(0).cast("long")
    for k in range(len(marks)):
        code = code + F.col(f"_s{k}") * F.lit(3**k)
        inside = inside | (F.col(f"_s{k}") == _INSIDE)
        share = F.coalesce((value - q[2 * k]) / F.nullif(q[2 * k + 1] - q[2 * k], F.lit(0.0)), F.lit(0.0))
        part = F.when(F.col(f"_s{k}") == _INSIDE, F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * (width - 1))).otherwise(part)
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("_i") + 1).alias("column")
    # Codes and the parts of a bracket rise with the value, so together they number its ranges.
    coded = long.select(*by, name, code.alias("code"), (code * width + part).alias("_range"), F.when(inside, value).alias("value"))
    keys = [*by, "column"]
    counted = coded.groupBy(*keys, "code", "_range", "value").agg(F.count("*").alias("ties"))

    def state(k: int) -> Column:
        return (F.floor(F.col("code") / F.lit(3**k)) % 3).cast("int")

    def ties(k: int, wanted: int) -> Column:
        return F.sum(F.when(state(k) == wanted, F.col("ties")).otherwise(F.lit(0)))

    sums = {"n": F.sum("ties")}
    for k in range(len(marks)):
        sums |= {f"below{k}": ties(k, _BELOW), f"inside{k}": ties(k, _INSIDE)}
    local = Window.partitionBy(*keys, "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    running = counted.select("*", *[F.coalesce(ties(k, _INSIDE).over(local), F.lit(0)).alias(f"_run{k}") for k in range(len(marks))])
    starts = [(F.col(f"_all_below{k}") + F.col(f"_off_inside{k}") + F.col(f"_run{k}")).alias(f"_start{k}") for k in range(len(marks))]
    placed = join_ranges(running, range_offsets(counted, keys, sums), keys).select(*keys, "code", "value", "ties", F.col("_all_n").alias("_n"), *starts)

    def value_at(k: int, position: Column) -> Column:
        holds = (state(k) == _INSIDE) & (F.col(f"_start{k}") <= position) & (position < F.col(f"_start{k}") + F.col("ties"))
        found = F.max(F.when(holds, F.col("value")))
        return F.coalesce(found, F.raise_error(F.lit("a sketch placed a quantile wrongly")).cast("double"))

    results = []
    for k, (name, p) in enumerate(probs.items()):
        at = F.lit(float(p)) * (F.col("_n") - 1)
        low, high = value_at(k, F.floor(at)), value_at(k, F.ceil(at))
        results.append((low + F.max(at - F.floor(at)) * (high - low)).alias(name))
    return placed.groupBy(*keys).agg(F.max("_n").alias("n"), *results), sketched.drop(*[f"_q_{i}" for i in range(len(columns))])
