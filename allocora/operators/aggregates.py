"""Grouped and whole-table aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations_with_replacement
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allocora.functions.numeric import count_where, ratio, share, skewness_corrected
from allocora.operators.ordered import Ranges, find_ranges_of
from allocora.operators.quantiles import column_quantiles
from allocora.runtime import small_table


def sum_by_key(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Sum per key; a group without values sums to 0, rows without a key are left out."""
    return df.na.drop(subset=list(keys)).groupBy(*keys).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(value))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, the missing one included, with their percentage."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("pct", 100.0 * F.col("n") / total)


def crosstab(
    df: DataFrame, row: str, column: str, levels: Sequence[str], rows: Sequence[str] | None = None
) -> DataFrame:
    """Counts with one column per level, 0 where a cell is empty.

    With ``rows``, one row for each of them, in their order, and for no other value.
    """
    counts = df.groupBy(row).pivot(column, list(levels)).count()
    if rows is not None:
        spark = df.sparkSession
        order = spark.createDataFrame(list(enumerate(rows)), T.StructType([T.StructField("_at", T.IntegerType()), df.schema[row]]))
        counts = F.broadcast(order).join(counts, row, "left").orderBy("_at").drop("_at")
    return counts.na.fill(0, list(levels))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, quartiles, spread, extremes and skew of each column, in two reads."""
    figures = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(c).alias("n"),
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"),
            F.min(c).cast("double").alias("min"),
            F.max(c).cast("double").alias("max"),
            skewness_corrected(c).alias("skew"),
        )
        for c in columns
    ]
    quartiles, shape = column_quantiles(df, columns, {"q25": 0.25, "median": 0.5, "q75": 0.75}, figures=[F.array(*figures).alias("_shape")])
    return shape.select(F.inline("_shape")).join(quartiles.drop("n"), "column", "left")


def missing_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing cells per column, counted in one pass."""
    wide = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return wide.unpivot(["_n"], [F.col(c) for c in columns], "column", "missing").select(
        "column", "missing", (100.0 * ratio("missing", "_n")).alias("pct")
    )


def any_missing(columns: Sequence[str]) -> Column:
    condition = F.col(columns[0]).isNull()
    for c in columns[1:]:
        condition = condition | F.col(c).isNull()
    return condition


def missing_footprint(df: DataFrame, columns: Sequence[str], unit: str = "unit") -> DataFrame:
    """Rows with a missing input per unit, and whether an input is missing in all of them."""
    return df.groupBy(unit).agg(
        F.count_if(any_missing(columns)).alias("rows_missing"),
        *[F.every(F.col(c).isNull()).alias(f"{c}_never") for c in columns],
    )


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each full row and of each key.

    Equal rows share their key, so whole rows are compared only where a key occurs
    more than once; the others are shuffled by their key alone.
    """
    repeated = df.groupBy(*keys).count().filter(F.col("count") > 1)
    key = repeated.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("v"))
    suspects = small_table(repeated.select(*[F.col(k).alias(f"_k_{k}") for k in keys]))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    whole = df.join(suspects, same, "left_semi").groupBy(*df.columns).count()
    full = whole.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("v"))
    return df.sparkSession.range(1).select(
        full.scalar().cast("bigint").alias("duplicate_rows"), key.scalar().cast("bigint").alias("duplicate_keys")
    )


def panel_balance(df: DataFrame, unit: str = "unit", period: str = "period") -> DataFrame:
    counts = df.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct(unit).alias("n_units"),
        F.countDistinct(period).alias("n_periods"),
    )
    return counts.withColumn("possible", F.col("n_units") * F.col("n_periods")).withColumn(
        "absent", F.col("possible") - F.col("n_rows")
    )


def modal_level(df: DataFrame, unit: str, level: str, period: str, name: str) -> DataFrame:
    """Most frequent level of each unit; the most recent one among ties."""
    cells = df.filter(F.col(level).isNotNull()).groupBy(unit, level).agg(
        F.count("*").alias("_c"), F.max(period).alias("_last")
    )
    return cells.groupBy(unit).agg(F.max_by(level, F.struct("_c", "_last", level)).alias(name))


def recent_level(level: str, period: str) -> Column:
    """Last known level."""
    return F.max_by(F.col(level), F.when(F.col(level).isNotNull(), F.col(period)))


def reclassified_units(df: DataFrame, unit: str, level: str) -> DataFrame:
    """How many units have had more than one level."""
    changed = df.groupBy(unit).agg((F.min(level) != F.max(level)).alias("changed"))
    return changed.agg(F.count("*").alias("n_units"), count_where(F.col("changed")).alias("n_changed"))


def conditional_shares(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    return df.agg(*[share(c).alias(name) for name, c in conditions.items()])


def correlation_by_group(df: DataFrame, x: str, y: str, by: Sequence[str] = (), min_rows: int = 3) -> DataFrame:
    """Pearson correlation of complete pairs, for groups with enough of them."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), F.corr(x, y).alias("r")).filter(F.col("n") >= min_rows)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation of complete pairs, ties at their average rank.

    Three reads of the two columns: one finds the cut points of both, one counts
    their ranges, one ranks the rows within the ranges, first of x, then of y. A
    range that is a single value needs no order, so its rows stay spread.
    """
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("_x"), F.col(y).alias("_y"))
    cuts = dict(zip(("_x", "_y"), find_ranges_of(pairs, ["_x", "_y"]), strict=True))
    ranked = pairs
    for c, cut in cuts.items():
        ranked = cut.mark(ranked, c).withColumnRenamed("_range", f"{c}_range")
    sides = [F.struct(F.lit(c).alias("side"), F.col(f"{c}_range").alias("range")) for c in cuts]
    counted = ranked.select(F.explode(F.array(*sides)).alias("_s")).groupBy("_s.side", "_s.range").count().collect()
    for c, cut in cuts.items():
        ranked = ranked.withColumn(f"{c}_rank", _average_rank(c, cut, {r["range"]: r["count"] for r in counted if r["side"] == c}))
    return ranked.agg(F.count("*").alias("n"), F.corr("_x_rank", "_y_rank").alias("rho"))


def _average_rank(column: str, cut: Ranges, rows: Mapping[int, int]) -> Column:
    """Average rank from the rows of the lower ranges and the order within the own one."""
    count = len(cut.splits)
    lower = [sum(rows.get(i, 0) for i in range(at)) for at in range(count)]
    own = F.col(f"{column}_range")
    before = F.element_at(F.array(*[F.lit(v).cast("long") for v in lower]), own + 1)
    if not cut.hot:
        spread, hot = F.lit(0), F.lit(False)
    else:
        hot = own.isin(*cut.hot)
        # Rows of a hot value are ranked by their range alone; the window only has to leave them where they are.
        spread = F.when(hot, F.spark_partition_id()).otherwise(F.lit(-1))
    alike = F.element_at(F.array(*[F.lit(rows.get(i, 0)).cast("long") for i in range(count)]), own + 1)
    local = Window.partitionBy(own, spread).orderBy(F.when(~hot, F.col(column)))
    peers = Window.partitionBy(own, spread, F.when(~hot, F.col(column)))
    ties = F.when(hot, alike).otherwise(F.count("*").over(peers))
    return before + F.when(hot, F.lit(0)).otherwise(F.rank().over(local) - 1) + (ties + 1) / F.lit(2.0)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise Pearson correlations of the complete rows, in one pass."""
    pairs = list(combinations_with_replacement(columns, 2))
    rows = df.na.drop(subset=list(columns))
    wide = rows.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")))
        if a != b:
            cells.append(F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), F.col(f"c{i}").alias("r")))
    return wide.select(F.inline(F.array(*cells)))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins from minimum to maximum, the last closed on the right; empty bins included."""
    bounds = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    lo = bounds.select("lo").scalar()
    hi = bounds.select("hi").scalar()
    position = F.floor(F.col(value).cast("double").__sub__(lo) / F.nullif(hi - lo, F.lit(0.0)) * bins)
    bin_no = F.coalesce(F.least(position, F.lit(bins - 1)), F.lit(0)).cast("int")
    counts = df.filter(F.col(value).isNotNull()).groupBy(bin_no.alias("bin")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = (hi - lo) / bins
    return grid.join(counts, "bin", "left").select(
        "bin",
        (lo + F.col("bin") * width).alias("left_edge"),
        (lo + (F.col("bin") + 1) * width).alias("right_edge"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def box_stats(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Quartiles and whiskers (extremes within 1.5 interquartile ranges) per group; rows without a group are one."""
    rows = df.filter(F.col(value).isNotNull())
    quartiles, _ = column_quantiles(rows, [value], {"q1": 0.25, "median": 0.5, "q3": 0.75}, by)
    boxes = quartiles.select(*[F.col(b).alias(f"_box_{b}") for b in by], "q1", "median", "q3")
    same = reduce(and_, [F.col(b).eqNullSafe(F.col(f"_box_{b}")) for b in by])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        rows.join(small_table(boxes), same)
        .groupBy(*by, "q1", "median", "q3")
        .agg(
            F.count("*").alias("n"),
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        )
    )


def flag_counts(df: DataFrame, flags: Sequence[str], unit: str = "unit") -> DataFrame:
    """Rows, share and distinct units of each 0/1 flag.

    Rows become one row per unit with a mark per flag, and the marks are counted, so
    no row is multiplied by the number of flags.
    """
    per_unit = df.groupBy(unit).agg(
        F.count("*").alias("_n"),
        *[F.sum(f).alias(f"{f}_rows") for f in flags],
        *[F.coalesce(F.bool_or(F.col(f) == 1), F.lit(False)).alias(f"{f}_mark") for f in flags],
    )
    wide = per_unit.agg(
        F.sum("_n").alias("_n"),
        *[F.sum(f"{f}_rows").alias(f"{f}_rows") for f in flags],
        *[F.count_if(F.col(f"{f}_mark") & F.col(unit).isNotNull()).alias(f"{f}_units") for f in flags],
    )
    cells = [
        F.struct(
            F.lit(f).alias("flag"),
            F.col(f"{f}_rows").cast("bigint").alias("n_rows"),
            (100.0 * ratio(f"{f}_rows", "_n")).alias("pct"),
            F.col(f"{f}_units").alias("n_units"),
        )
        for f in flags
    ]
    return wide.select(F.inline(F.array(*cells)))


def extreme_row(df: DataFrame, score: str, columns: Sequence[str], unit: str, lowest: bool = True) -> DataFrame:
    """The whole row with the lowest or highest score; the smallest unit among ties."""
    row = F.struct(*columns)
    order = F.struct(F.col(score) if lowest else -F.col(score), F.col(unit))
    best = F.min_by(row, F.when(F.col(score).isNotNull(), order))
    return df.agg(best.alias("_row")).select("_row.*")


def envelope(df: DataFrame, a: str, b: str) -> DataFrame:
    """Common range of two columns."""
    return df.agg(
        F.least(F.min(a), F.min(b)).alias("lo"),
        F.greatest(F.max(a), F.max(b)).alias("hi"),
        F.max(F.abs(F.col(a))).alias("max_abs"),
    )


def value_ranges(df: DataFrame, columns: Sequence[str], positive: str) -> DataFrame:
    """Smallest and largest value of each column, and rows where ``positive`` is not above 0."""
    wide = df.agg(
        *[F.min(c).alias(f"{c}_min") for c in columns],
        *[F.max(c).alias(f"{c}_max") for c in columns],
        *[(count_where(F.col(c) <= 0) if c == positive else F.lit(None).cast("bigint")).alias(f"{c}_np") for c in columns],
    )
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"{c}_min").cast("double").alias("min"),
            F.col(f"{c}_max").cast("double").alias("max"),
            F.col(f"{c}_np").alias("not_positive"),
        )
        for c in columns
    ]
    return wide.select(F.inline(F.array(*cells)))
