"""Cross-validation with whole units in one fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allocora.model.gram import grams_by, make_design, solve
from allocora.model.spec import ModelSpec
from allocora.operators.ordered import with_order
from allocora.runtime import collect_bounded, small_table


def key_fold(df: DataFrame, unit: str, k: int = 5, fold: str = "fold") -> DataFrame:
    """Fold from the remainder of a whole-number key; needs no shuffle."""
    return df.withColumn(fold, F.pmod(F.col(unit), F.lit(k)).cast("int"))


def hash_fold(df: DataFrame, unit: str, k: int = 5, fold: str = "fold") -> DataFrame:
    """Fold from the hash of any key; needs no shuffle."""
    return df.withColumn(fold, F.pmod(F.xxhash64(unit), F.lit(k)).cast("int"))


def fold_order(sizes: Sequence[tuple[int, int]], k: int) -> dict[int, list[int]]:
    """Fold sequence of each size class when units go, largest first, to the lightest fold.

    ``sizes`` lists (rows per unit, number of units). Once the loads of the folds
    differ by less than one unit of the class, the assignment repeats with
    period k, so a short start and one cycle describe a class of any length.
    """
    loads = [0] * k
    sequences: dict[int, list[int]] = {}
    for size, count in sorted(sizes, reverse=True):
        sequence: list[int] = []
        while len(sequence) < count:
            level = max(loads) - min(loads) < size
            lightest = sorted(range(k), key=lambda f: (loads[f], f)) if level else [loads.index(min(loads))]
            for f in lightest[: count - len(sequence)]:
                sequence.append(f)
                loads[f] += size
            if level:
                rest = count - len(sequence)
                for position, f in enumerate(lightest):
                    loads[f] += size * (rest // k + (1 if position < rest % k else 0))
                break
        sequences[size] = sequence
    return sequences


def balanced_fold(df: DataFrame, unit: str, k: int = 5, fold: str = "fold") -> DataFrame:
    """Folds of nearly equal row counts: units by size, largest first, to the lightest fold.

    Units of one size are taken in key order; keys may be of any type that has one.
    """
    sizes = df.groupBy(unit).agg(F.count("*").cast("int").alias("_size"))
    classes = collect_bounded(sizes.groupBy("_size").count(), 100_000, "unit sizes")
    sequences = fold_order([(r["_size"], r["count"]) for r in classes], k)
    placed = with_order(sizes, unit, {"_at": F.col("before")}, ["_size"])
    spark = df.sparkSession
    # A row per place of the sequences; a sequence is a start and one cycle, however many units there are.
    places = [(size, at, f) for size, sequence in sequences.items() for at, f in enumerate(sequence)]
    starts = [(size, max(len(sequence) - k, 0)) for size, sequence in sequences.items()]
    place_of = small_table(spark.createDataFrame(places, f"_size int, _place long, `{fold}` int"))
    start_of = small_table(spark.createDataFrame(starts, "_size int, _start long"))
    turn = F.col("_start") + (F.col("_at") - F.col("_start")) % k
    at_place = placed.join(start_of, "_size").withColumn(
        "_place", F.when(F.col("_at") < F.col("_start"), F.col("_at")).otherwise(turn)
    )
    return df.join(at_place.join(place_of, ["_size", "_place"]).select(unit, fold), unit)


def group_cv(df: DataFrame, spec: ModelSpec, fold: str = "fold") -> DataFrame:
    """R² and mean absolute error of each fold, predicted from the others.

    One aggregate gives the Gram of every fold; training Grams are differences.
    One scoring pass predicts every row with the coefficients of its own fold.
    """
    rows = spec.complete(df)
    design = make_design(rows, spec)
    parts = grams_by(rows, design, fold)
    whole = None
    for g in parts.values():
        whole = g if whole is None else whole + g
    trained = {f: solve(whole - g).coefficients for f, g in parts.items()}
    terms = {
        t: F.element_at(F.create_map(*[F.lit(v) for f, b in trained.items() for v in (f, b.get(t, 0.0))]), F.col(fold))
        for t in design.terms
    }
    e = F.col(spec.outcome) - design.linear(terms)
    sums = rows.withColumn("_e", e).groupBy(fold).agg(
        F.count("*").alias("n"),
        F.sum(F.col("_e") * F.col("_e")).alias("_sse"),
        (F.var_pop(spec.outcome) * F.count("*")).alias("_sst"),
        F.avg(F.abs("_e")).alias("mae"),
    )
    return sums.select(fold, "n", (1 - F.try_divide("_sse", "_sst")).alias("r2"), "mae")


def cv_summary(folds: DataFrame) -> DataFrame:
    """Mean and population deviation over the folds."""
    return folds.agg(
        F.avg("r2").alias("r2_mean"),
        F.stddev_pop("r2").alias("r2_std"),
        F.avg("mae").alias("mae_mean"),
        F.stddev_pop("mae").alias("mae_std"),
    )
