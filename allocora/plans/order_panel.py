"""Panel built from order tables: unit = customer, period = order year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allocora.functions.text import map_labels
from allocora.model.spec import ModelSpec
from allocora.operators.reshape import complete_cases, fill_within_unit
from allocora.runtime import by_unit

# Order priority to tier; every other priority has none.
TIER_BY_PRIORITY = {
    "1-URGENT": "H",
    "2-HIGH": "UM",
    "3-MEDIUM": "LM",
    "4-NOT SPECIFIED": "L",
}

# Horizon and split of the panel.
BASE_PERIOD = 2001
HORIZON = 2008
SPLIT_PERIOD = 1998

INPUTS = ("need", "wealth", "gov", "size")
PREDICTORS = ("need", "composite", "wealth", "gov", "tier")

SPEC = ModelSpec(
    outcome="log_outcome",
    numeric=("need", "log_wealth", "gov", "log_size", "flag_a", "flag_b"),
    categorical=(("tier", "L"), ("period", None)),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer and order year.

    Line items are reduced per order before the join, orders per customer, year
    and priority before the customer join, so a customer with very many orders is
    combined before each shuffle. Nation and region are joined by their file size.
    """
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.avg("l_discount").alias("need"),
        F.avg("l_extendedprice").alias("wealth"),
        F.avg("l_tax").alias("gov"),
        F.sum("l_quantity").alias("qty"),
        F.avg("l_quantity").alias("qavg"),
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("unit"),
        F.year("o_orderdate").alias("period"),
        "o_totalprice",
        F.col("o_orderpriority").alias("priority"),
    )
    means = ("need", "wealth", "gov", "qavg")
    levels = (
        orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left")
        .groupBy("unit", "period", "priority")
        .agg(
            F.count("*").alias("c"),
            F.max("o_orderkey").alias("last"),
            F.sum("o_totalprice").alias("price"),
            F.count("l_orderkey").alias("with_lines"),
            F.sum("qty").alias("qty"),
            *[F.sum(m).alias(m) for m in means],
        )
    )
    # At most one row per priority is left of a unit's year, so no unit is hot here;
    # the year totals, the customer join and the stage table share this shuffle.
    cells = by_unit(levels, "unit").groupBy("unit", "period").agg(
        F.sum("c").alias("n_orders"),
        (F.sum("price") / 1000).alias("outcome"),
        F.sum("qty").alias("size"),
        F.max_by("priority", F.struct("c", "last")).alias("priority"),
        *[F.try_divide(F.sum(m), F.sum("with_lines")).alias(m) for m in means],
    )
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("unit"), F.col("c_name").alias("unit_name"), "c_nationkey"
    )
    places = (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("region"))
    )
    return (
        cells.join(customers, "unit")
        .join(places, "c_nationkey")
        .select(
            "unit",
            "unit_name",
            "period",
            "n_orders",
            "outcome",
            "need",
            (50 - 200 * F.col("need") + F.col("qavg")).alias("composite"),
            "wealth",
            "gov",
            "size",
            map_labels("priority", TIER_BY_PRIORITY).alias("tier"),
            "region",
            (F.col("c_nationkey") % 4 == 0).cast("int").alias("flag_a"),
            (F.col("c_nationkey") % 4 == 1).cast("int").alias("flag_b"),
        )
    )


def model_frame(panel: DataFrame) -> DataFrame:
    """Complete rows with the tier filled within the unit and the log transforms."""
    rows = fill_within_unit(complete_cases(panel, ["outcome", *INPUTS]), "tier")
    return rows.filter(F.col("tier").isNotNull()).withColumns(
        {
            "log_outcome": F.log1p("outcome"),
            "log_wealth": F.ln("wealth"),
            "log_size": F.ln("size"),
        }
    )
