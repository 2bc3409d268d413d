"""Ranks, running sums and exact quantiles without a single-task sort.

Numbers are cut by sketches, any other orderable type (texts, dates, binaries) by
Spark's own range partitioning of the distinct values. Approximate cut points split the values into ranges of similar row counts. Order
within a range is settled by one task per group and range; the counts and sums of
the earlier ranges, a small table, are added to it. A value that alone fills more
than a range becomes a range of its own, whose rows need no sorting at all.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import accumulate, pairwise

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allocora.runtime import shuffle_width, small_table, stage

#: Sketches are merged in this many groups of tasks first, so that no task meets those of all.
SKETCH_GROUPS = 64
# Groups times ranges; a row has a few whole numbers, so this stays near 10 MB.
OFFSET_ROWS = 200_000


def _number(value: str) -> Column:
    """The value as a double; both zeros are one, which cut points would tell apart."""
    return F.col(value).cast("double") + F.lit(0.0)


@dataclass(frozen=True)
class Ranges:
    """Boundaries of the ranges, and the numbers of those that hold one hot value."""

    splits: tuple[float, ...]
    hot: tuple[int, ...]

    def mark(self, rows: DataFrame, value: str) -> DataFrame:
        numbered = Bucketizer(splits=list(self.splits), inputCol="_v", outputCol="_range", handleInvalid="keep").transform(
            rows.withColumn("_v", _number(value))
        )
        return numbered.withColumn("_range", F.col("_range").cast("int")).drop("_v")

    def is_hot(self) -> Column:
        return F.col("_range").isin(*self.hot) if self.hot else F.lit(False)


def find_ranges(rows: DataFrame, value: str, ranges: int | None = None) -> Ranges:
    """Cut the non-null values of one column, as :func:`find_ranges_of` does."""
    return find_ranges_of(rows, [value], ranges)[0]


def find_ranges_of(rows: DataFrame, values: Sequence[str], ranges: int | None = None) -> list[Ranges]:
    """Cut the non-null values of each column by quantile sketches, in one pass without a shuffle of rows.

    Groups of tasks have cut points of their own; the cut points of all values are
    found among those, weighted by the groups' rows. Results do not depend on where
    the cuts are, only the balance does. A value found at two neighbouring cut
    points holds more rows than a range should.
    """
    n = ranges or shuffle_width(rows.sparkSession)
    probs = [i / n for i in range(1, n)] or [0.5]
    groups = rows.groupBy((F.spark_partition_id() % SKETCH_GROUPS).alias("_group"))
    accuracy = max(10_000, 20 * n)
    figures = [F.struct(F.percentile_approx(_number(v), probs, accuracy).alias("cuts"), F.count(v).alias("rows")).alias(f"_{i}") for i, v in enumerate(values)]
    found = groups.agg(*figures).collect()
    return [_cut([r[f"_{i}"] for r in found], probs) for i in range(len(values))]


def _cut(found: Sequence, probs: Sequence[float]) -> Ranges:
    weighted = sorted((c, r["rows"] / len(r["cuts"])) for r in found for c in r["cuts"] or [] if not math.isnan(c))
    reached = list(accumulate(w for _, w in weighted))
    cuts = [weighted[min(bisect_left(reached, p * reached[-1]), len(weighted) - 1)][0] for p in probs] if weighted else [0.0]
    repeated = {a for a, b in pairwise(cuts) if a == b}
    splits = sorted({-math.inf, math.inf, *cuts, *(math.nextafter(v, math.inf) for v in repeated)})
    return Ranges(tuple(splits), tuple(i for i, v in enumerate(splits) if v in repeated))


def range_offsets(ranged: DataFrame, by: Sequence[str], counts: Mapping[str, Column]) -> DataFrame:
    """Per group and range: its own figures, those of the earlier ranges and of the whole group."""
    totals = ranged.groupBy(*by, "_range").agg(*[e.alias(f"_in_{c}") for c, e in counts.items()])
    # One row per group and range: small, and never the rows themselves.
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    return totals.select(
        *by,
        "_range",
        *[F.col(f"_in_{c}") for c in counts],
        *[F.coalesce(F.sum(f"_in_{c}").over(earlier), F.lit(0)).alias(f"_off_{c}") for c in counts],
        *[F.sum(f"_in_{c}").over(whole).alias(f"_all_{c}") for c in counts],
    )


def join_ranges(rows: DataFrame, offsets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join on group and range; rows without a group belong together too."""
    keys = [*by, "_range"]
    renamed = offsets.withColumnsRenamed({c: f"_k_{c}" for c in keys})
    condition = rows["_range"] == renamed["_k__range"]
    for c in by:
        condition = condition & rows[c].eqNullSafe(renamed[f"_k_{c}"])
    return rows.join(renamed, condition, "inner").drop(*[f"_k_{c}" for c in keys])


def _is_number(df: DataFrame, value: str) -> bool:
    return isinstance(df.schema[value].dataType, T.NumericType)


def _range_counted(counted: DataFrame, value: str, by: Sequence[str], ranges: int | None) -> DataFrame:
    """Distinct values per group, dealt to range partitions in the order of group and value; ``_range`` is the partition.

    Spark samples the rows for the cut points. A value is one row here however many
    rows have it, so no range is filled by a hot value.
    """
    width = ranges or shuffle_width(counted.sparkSession)
    dealt = counted.repartitionByRange(width, *by, value).withColumn("_range", F.spark_partition_id())
    return stage(dealt, "value_ranges")


def order_by_value(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    sums: Mapping[str, Column] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Distinct non-null values per group in value order, with running figures.

    Has the group columns, the value, ``ties`` (rows with the value), ``before``
    (rows of the group below it), ``total`` (rows of the group), and for each extra
    sum ``s``: ``s`` itself, ``s_before`` and ``s_total``.
    """
    figures = {"ties": F.count("*"), **(sums or {})}
    sums = list(sums or {})
    rows = df.filter(F.col(value).isNotNull())
    counted = rows.groupBy(*by, value).agg(*[e.alias(c) for c, e in figures.items()])
    counts = ["ties", *sums]
    if _is_number(df, value):
        cut = find_ranges(rows, value, ranges)
        ranged = cut.mark(counted, value)
        # Totals of the ranges come from the rows, which combine to a few before their shuffle.
        offsets = small_table(range_offsets(cut.mark(rows, value), by, figures), OFFSET_ROWS)
    else:
        ranged = _range_counted(counted, value, by, ranges)
        offsets = small_table(range_offsets(ranged, by, {c: F.sum(c) for c in counts}), OFFSET_ROWS)
    local = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    running = ranged.select("*", *[F.coalesce(F.sum(c).over(local), F.lit(0)).alias(f"_run_{c}") for c in counts])
    return join_ranges(running, offsets, by).select(
        *by,
        value,
        "ties",
        (F.col("_run_ties") + F.col("_off_ties")).alias("before"),
        F.col("_all_ties").alias("total"),
        *[F.col(s) for s in sums],
        *[(F.col(f"_run_{s}") + F.col(f"_off_{s}")).alias(f"{s}_before") for s in sums],
        *[F.col(f"_all_{s}").alias(f"{s}_total") for s in sums],
    )


def min_rank() -> Column:
    return (F.col("before") + 1).cast("int")


def average_rank() -> Column:
    return F.col("before") + (F.col("ties") + 1) / F.lit(2.0)


def with_order(
    df: DataFrame,
    value: str,
    columns: Mapping[str, Column],
    by: Sequence[str] = (),
    ranges: int | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add figures made of ``before``, ``ties`` and ``total`` to every row; rows without a value get NULL.

    ``keep`` limits the columns that are carried along.

    Rows with a number are shuffled once, by group and range. Rows with a hot value
    are not shuffled: their figures are those of their range. Values of other types
    are counted first and their figures joined back.
    """
    keep = list(keep or df.columns)
    rows = df.filter(F.col(value).isNotNull())
    if not _is_number(df, value):
        return _with_counted_order(df, value, columns, by, ranges, keep)
    cut = find_ranges(rows, value, ranges)
    ranged = cut.mark(rows, value)
    offsets = small_table(range_offsets(ranged, by, {"n": F.count("*")}), OFFSET_ROWS)
    local = Window.partitionBy(*by, "_range").orderBy(value)
    peers = Window.partitionBy(*by, "_range", value)
    sorted_rows = ranged.filter(~cut.is_hot()).select(
        "*", (F.rank().over(local) - 1).alias("_run"), F.count("*").over(peers).alias("ties")
    )
    parts = [
        join_ranges(sorted_rows, offsets, by).select(
            *keep, (F.col("_off_n") + F.col("_run")).alias("before"), "ties", F.col("_all_n").alias("total")
        )
    ]
    if cut.hot:
        hot_rows = ranged.filter(cut.is_hot())
        parts.append(
            join_ranges(hot_rows, offsets, by).select(
                *keep, F.col("_off_n").alias("before"), F.col("_in_n").alias("ties"), F.col("_all_n").alias("total")
            )
        )
    missing = F.lit(None).cast("bigint")
    parts.append(
        df.filter(F.col(value).isNull()).select(*keep, missing.alias("before"), missing.alias("ties"), missing.alias("total"))
    )
    ordered = parts[0]
    for part in parts[1:]:
        ordered = ordered.unionByName(part)
    return ordered.select(*keep, *[e.alias(c) for c, e in columns.items()])


def _with_counted_order(
    df: DataFrame, value: str, columns: Mapping[str, Column], by: Sequence[str], ranges: int | None, keep: Sequence[str]
) -> DataFrame:
    """Figures of the distinct values, joined back to the rows.

    A value that fills more than a range meets its rows by broadcast, so that these
    are not shuffled; there are no more such values than ranges.
    """
    width = ranges or shuffle_width(df.sparkSession)
    placed = stage(order_by_value(df, value, by, ranges=ranges), "value_places")
    figures = placed.withColumnsRenamed({c: f"_k_{c}" for c in (*by, value)})
    all_rows = placed.agg(F.sum("ties")).first()[0] or 0
    hot = figures.filter(F.col("ties") * width > all_rows)
    rows = df.select(*dict.fromkeys((*keep, *by, value)))

    def met(part: DataFrame, table: DataFrame) -> DataFrame:
        same = part[value] == table[f"_k_{value}"]
        for c in by:
            same = same & part[c].eqNullSafe(table[f"_k_{c}"])
        return part.join(table, same, "left").drop(*[f"_k_{c}" for c in (*by, value)])

    if hot.isEmpty():
        return met(rows, figures).select(*keep, *[e.alias(c) for c, e in columns.items()])
    marked = met(rows, small_table(hot, width + 1))
    rest = met(marked.filter("ties IS NULL").drop("before", "ties", "total"), figures)
    found = marked.filter("ties IS NOT NULL").unionByName(rest)
    return found.select(*keep, *[e.alias(c) for c, e in columns.items()])


def exact_quantiles(
    df: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """Linearly interpolated exact quantiles per group.

    Counting the ranges tells which of them hold the wanted positions; only the
    rows of those few ranges are shuffled and sorted.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*by, value)
    ranged = find_ranges(rows, value, ranges).mark(rows, value)
    offsets = range_offsets(ranged, by, {"n": F.count("*")})

    def positions(p: float) -> tuple[Column, Column, Column]:
        at = F.lit(float(p)) * (F.col("_all_n") - 1)
        return at, F.floor(at), F.ceil(at)

    def holds(start: Column, length: Column, position: Column) -> Column:
        return (start <= position) & (position < start + length)

    wanted = F.lit(False)
    for p in probs.values():
        for position in positions(p)[1:]:
            wanted = wanted | holds(F.col("_off_n"), F.col("_in_n"), position)
    counted = (
        join_ranges(ranged, small_table(offsets.filter(wanted)), by)
        .groupBy(*by, "_range", value, "_off_n", "_all_n")
        .agg(F.count("*").alias("ties"))
    )
    local = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_off_n") + F.coalesce(F.sum("ties").over(local), F.lit(0))
    placed = counted.withColumn("before", before)
    figures = []
    for name, p in probs.items():
        at, low, high = positions(p)
        x = F.col(value).cast("double")
        lower = F.max(F.when(holds(F.col("before"), F.col("ties"), low), x))
        upper = F.max(F.when(holds(F.col("before"), F.col("ties"), high), x))
        weight = F.max(at - low)
        figures.append((lower + weight * (upper - lower)).alias(name))
    return placed.groupBy(*by).agg(*figures)
