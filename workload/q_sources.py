"""Sources, sinks, reshaping and cleaning."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allocora.functions import fixed, labels, numeric, text
from allocora.operators import reshape
from allocora.plans.order_panel import HORIZON
from allocora.runtime import scratch_path
from allocora.sources import files
from workload.registry import Stages, query, r6, rnd

# Columns that the checking SQL has to name; the queries take the periods they find.
SQL_YEARS = [1995, 1996, 1997, 1998, 1999, 2000, 2001]
CSV_SCHEMA = "unit bigint, label string, period int, outcome double, tier string"


def _labelled(s: Stages) -> DataFrame:
    return s.panel.select(
        "unit", F.concat_ws(", ", "unit_name", "region").alias("label"), "period", "outcome", "tier"
    )


def _wide(s: Stages) -> DataFrame:
    """One text column per year, headed like ``1995 [YR1995]``, and an empty trailing column."""
    wide = s.panel.groupBy("unit").pivot("period", s.periods).agg(F.first("n_orders"))
    cells = [F.coalesce(F.col(str(y)).cast("string"), F.lit("..")).alias(f"{y} [YR{y}]") for y in s.periods]
    return wide.select("unit", *cells, F.lit(None).cast("string").alias(f"Unnamed: {len(cells) + 1}"))


@query("src_csv_scan", """
SELECT unit, unit_name || ', ' || region AS label, period, round(outcome, 6) AS outcome, tier FROM panel""")
def src_csv_scan(s: Stages) -> DataFrame:
    path = scratch_path(s.spark, "scan")
    files.write_csv(_labelled(s), path)
    return files.read_csv(s.spark, path, CSV_SCHEMA).select("unit", "label", "period", *r6("outcome"), "tier")


@query("src_csv_preamble", """
WITH y AS (SELECT unnest(range(min(period), max(period) + 1))::INTEGER AS period FROM panel)
FINAL SELECT CAST(u.unit AS VARCHAR) AS unit, y.period, CAST(p.n_orders AS DOUBLE) AS n_orders
FROM (SELECT DISTINCT unit FROM panel) u CROSS JOIN y LEFT JOIN panel p ON p.unit = u.unit AND p.period = y.period""")
def src_csv_preamble(s: Stages) -> DataFrame:
    wide = _wide(s)
    path = scratch_path(s.spark, "preamble")
    head = ["Source,orders", "", "Updated,daily", "", ",".join(wide.columns[:-1]) + ","]
    foot = "End of orders"

    def whole_file(batches):
        """Each task writes a file with preamble, header, rows and footer."""
        for batch in (pa.RecordBatch.from_pydict({"line": head}), *batches, pa.RecordBatch.from_pydict({"line": [foot]})):
            yield batch

    files.csv_text(wide).mapInArrow(whole_file, "line string").write.text(path)
    read = files.read_csv_with_preamble(s.spark, path, 4, "unit", r"^\d+$", footer=[foot])
    clean = reshape.plain_year_headers(reshape.drop_columns_like(read, "^Unnamed"))
    long = reshape.unpivot_years(clean, ["unit"], s.periods[0], s.periods[-1], "n_orders")
    return long.withColumn("n_orders", reshape.clean_number("n_orders"))


@query("src_pruned_scan", "SELECT DISTINCT c_nationkey FROM customer", uses="")
def src_pruned_scan(s: Stages) -> DataFrame:
    return s.table("customer").select("c_nationkey").distinct()


@query("src_json_records", """
SELECT event_id, event_type AS code, CAST(json_extract(props, '$.k') AS BIGINT) AS k
FROM events WHERE event_type <> '' AND json_extract(props, '$.k') IS NOT NULL""", uses="")
def src_json_records(s: Stages) -> DataFrame:
    events = s.table("events").select("event_id", F.col("event_type").alias("code"), "props")
    return files.usable_records(files.records_from_text(events, "props", "k bigint"), "code", "k")


@query("src_json_files", """
SELECT event_type AS code, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n
FROM events WHERE event_type <> '' AND json_extract(props, '$.k') IS NOT NULL GROUP BY ALL""", uses="")
def src_json_files(s: Stages) -> DataFrame:
    path = scratch_path(s.spark, "records")
    props = F.get_json_object("props", "$.k").cast("bigint").alias("k")
    s.table("events").select(F.col("event_type").alias("code"), props).write.json(path)
    records = files.read_json_records(s.spark, path, "code string, k bigint", "code", "k")
    return records.groupBy("code", "k").agg(F.count("*").alias("n"))


@query("src_json_pages", """
SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id END AS v, event_type AS code FROM events
WHERE event_type <> '' AND event_type <> 'error' AND event_id % 7 <> 0""", uses="")
def src_json_pages(s: Stages) -> DataFrame:
    path = scratch_path(s.spark, "pages")
    code = F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("code")
    value = F.when(F.col("event_id") % 7 != 0, F.col("event_id")).alias("v")
    # Pages of at most 500 records.
    pages = s.table("events").groupBy(F.floor(F.col("event_id") / 500).alias("page")).agg(
        F.to_json(F.collect_list(F.struct(code, value))).alias("records")
    )
    line = F.concat(F.lit('[{"page": '), F.col("page").cast("string"), F.lit("}, "), F.col("records"), F.lit("]"))
    pages.select(line).write.text(path)
    return files.read_json_pages(s.spark, path, "code: string, v: bigint", "code", "v")


@query("sink_csv_roundtrip", """
SELECT region, tier, count(*) AS n, round(sum(outcome), 6) AS outcome FROM panel GROUP BY region, tier""")
def sink_csv_roundtrip(s: Stages) -> DataFrame:
    path = scratch_path(s.spark, "sink")
    files.write_csv(s.panel.select("region", "tier", "outcome"), path)
    back = files.read_csv(s.spark, path, "region string, tier string, outcome double")
    return back.groupBy("region", "tier").agg(F.count("*").alias("n"), rnd(F.sum("outcome"), 6).alias("outcome"))


@query("sink_csv_text", """
SELECT concat_ws(',', unit, period, coalesce(tier, '')) AS line FROM panel UNION ALL SELECT 'unit,period,tier'""")
def sink_csv_text(s: Stages) -> DataFrame:
    return files.csv_text(s.panel, ["unit", "period", "tier"], header=True)


@query("reshape_unpivot", """
WITH y AS (SELECT unnest(range(1996, 2001))::INTEGER AS period)
FINAL SELECT u.unit, y.period, p.tier AS tier
FROM (SELECT DISTINCT unit FROM panel) u CROSS JOIN y LEFT JOIN panel p ON p.unit = u.unit AND p.period = y.period""")
def reshape_unpivot(s: Stages) -> DataFrame:
    wide = s.panel.groupBy("unit").pivot("period", s.periods).agg(F.first("tier"))
    headed = wide.toDF("unit", *[f"{y} [YR{y}]" for y in s.periods])
    return reshape.unpivot_years(reshape.plain_year_headers(headed), ["unit"], 1996, 2000, "tier")


@query("proj_drop_columns_regex", """
SELECT unit, """ + ", ".join(f"coalesce(CAST(max(n_orders) FILTER (period = {y}) AS VARCHAR), '..') AS \"{y}\"" for y in SQL_YEARS) + """
FROM panel GROUP BY unit""")
def proj_drop_columns_regex(s: Stages) -> DataFrame:
    return reshape.plain_year_headers(reshape.drop_columns_like(_wide(s), "^Unnamed"))


@query("clean_try_cast", """
SELECT unit, period, CASE WHEN tier IS NOT NULL THEN CAST(n_orders AS DOUBLE) END AS value FROM panel""")
def clean_try_cast(s: Stages) -> DataFrame:
    raw = F.when(F.col("tier").isNull(), "..").otherwise(F.col("n_orders").cast("string"))
    return s.panel.select("unit", "period", reshape.clean_number(raw).alias("value"))


@query("clean_sentinel_null", "SELECT unit, period, tier FROM panel")
def clean_sentinel_null(s: Stages) -> DataFrame:
    raw = F.coalesce("tier", F.lit(".."))
    return s.panel.select("unit", "period", reshape.sentinel_to_null(raw).alias("tier"))


@query("proj_rename_reorder", """
SELECT period AS year, unit AS id, round(outcome, 6) AS value, tier AS level FROM panel""")
def proj_rename_reorder(s: Stages) -> DataFrame:
    renamed = s.panel.withColumnsRenamed({"period": "year", "unit": "id", "outcome": "value", "tier": "level"})
    return renamed.select("year", "id", *r6("value"), "level")


@query("filter_range", """
SELECT unit, period, round(outcome, 6) AS outcome FROM panel WHERE period BETWEEN 1997 AND 2000 AND outcome > 100""")
def filter_range(s: Stages) -> DataFrame:
    return s.panel.filter(F.col("period").between(1997, 2000) & (F.col("outcome") > 100)).select(
        "unit", "period", *r6("outcome")
    )


@query("clean_listwise_deletion", """
SELECT unit, period, round(outcome, 6) AS outcome, tier FROM panel
WHERE outcome IS NOT NULL AND need IS NOT NULL AND wealth IS NOT NULL AND gov IS NOT NULL AND tier IS NOT NULL""")
def clean_listwise_deletion(s: Stages) -> DataFrame:
    rows = reshape.complete_cases(s.panel, ["outcome", "need", "wealth", "gov", "tier"])
    return rows.select("unit", "period", *r6("outcome"), "tier")


@query("filter_exclude_key", "SELECT unit, period, tier FROM panel WHERE tier IS DISTINCT FROM 'H'")
def filter_exclude_key(s: Stages) -> DataFrame:
    return reshape.exclude_key(s.panel, "tier", "H").select("unit", "period", "tier")


@query("proj_conditional_update", """
SELECT unit, period, CASE WHEN region = 'ASIA' AND flag_a = 1 THEN 'Asia inland' ELSE unit_name END AS unit_name FROM panel""")
def proj_conditional_update(s: Stages) -> DataFrame:
    where = (F.col("region") == "ASIA") & (F.col("flag_a") == 1)
    return reshape.replace_where(s.panel, "unit_name", where, "Asia inland").select("unit", "period", "unit_name")


@query("clean_trim_unicode", "SELECT c_custkey AS unit, c_name AS unit_name FROM customer", uses="")
def clean_trim_unicode(s: Stages) -> DataFrame:
    padded = F.concat(F.lit(" \t"), F.col("c_name"), F.lit("\u00a0"))
    return s.table("customer").select(
        F.col("c_custkey").alias("unit"), text.trim_unicode(padded).alias("unit_name")
    )


@query("filter_regex", r"""
SELECT c_custkey AS unit, c_name AS unit_name FROM customer WHERE NOT regexp_matches(c_name, '#0+[1-4]')""", uses="")
def filter_regex(s: Stages) -> DataFrame:
    return (
        s.table("customer")
        .filter(~F.col("c_name").rlike(r"#0+[1-4]"))
        .select(F.col("c_custkey").alias("unit"), F.col("c_name").alias("unit_name"))
    )


@query("proj_ratio", """
SELECT unit, period, round(CASE WHEN need <> 0 THEN outcome / need END + 1e-9, 4) AS ratio FROM panel""")
def proj_ratio(s: Stages) -> DataFrame:
    return s.panel.select("unit", "period", rnd(numeric.ratio("outcome", "need") + F.lit(1e-9), 4).alias("ratio"))


@query("proj_log_transforms", """
SELECT unit, period, round(CASE WHEN outcome > 0 THEN ln(outcome) END, 6) AS ln_value,
       round(ln(1 + outcome), 6) AS log1p_value, round(exp(need), 6) AS exp_need, round(exp(gov) - 1, 6) AS expm1_gov
FROM panel""")
def proj_log_transforms(s: Stages) -> DataFrame:
    return s.panel.select(
        "unit",
        "period",
        rnd(F.ln("outcome"), 6).alias("ln_value"),
        rnd(F.log1p("outcome"), 6).alias("log1p_value"),
        rnd(F.exp("need"), 6).alias("exp_need"),
        rnd(F.expm1("gov"), 6).alias("expm1_gov"),
    )


@query("label_ordered_levels", """
WITH levels AS (SELECT * FROM (VALUES ('L', 'Low', 1), ('LM', 'Lower-middle', 2), ('UM', 'Upper-middle', 3), ('H', 'High', 4), ('X', NULL, 5)) v(tier, label, tier_order))
FINAL SELECT l.tier, l.label, CAST(l.tier_order AS INTEGER) AS tier_order, count(p.unit) AS n
FROM levels l LEFT JOIN panel p ON p.tier = l.tier GROUP BY l.tier, l.label, l.tier_order""")
def label_ordered_levels(s: Stages) -> DataFrame:
    levels = labels.ordered_levels(s.spark, [*fixed.TIER_ORDER, "X"], "tier")
    counts = s.panel.groupBy("tier").agg(F.count("*").alias("n"))
    return counts.join(levels, "tier", "right").select(
        "tier",
        text.map_labels("tier", fixed.TIER_LABELS).alias("label"),
        "tier_order",
        F.coalesce("n", F.lit(0)).alias("n"),
    )


@query("encode_dummies", """
SELECT unit, period, CAST(tier = 'L' AS INTEGER) AS "tier_L", CAST(tier = 'LM' AS INTEGER) AS "tier_LM", CAST(tier = 'UM' AS INTEGER) AS "tier_UM",
""" + ", ".join(f"CAST(period = {y} AS INTEGER) AS \"year_{y}\"" for y in SQL_YEARS[1:]) + " FROM model", uses="model")
def encode_dummies(s: Stages) -> DataFrame:
    rows = s.model.select("unit", "period", "tier")
    return reshape.dummies(reshape.dummies(rows, "tier", fixed.TIER_ORDER), "period", s.periods, "year").drop("tier")


@query("fmt_ordinal_and_signed", """
SELECT unit,
       CAST(tier_rank AS VARCHAR) || CASE WHEN tier_rank % 100 BETWEEN 11 AND 13 THEN 'th' WHEN tier_rank % 10 = 1 THEN 'st'
         WHEN tier_rank % 10 = 2 THEN 'nd' WHEN tier_rank % 10 = 3 THEN 'rd' ELSE 'th' END AS rank_text,
       printf('%+.2f', round(score_mean, 8) + sign(score_mean) * 1e-9) AS score_text,
       printf('%.0f', round(tier_pct * 100, 8) + sign(tier_pct) * 1e-9) || '%' AS pct_text,
       format('{:,.1f}', round(wealth_mean, 8) + sign(wealth_mean) * 1e-9) AS wealth_text,
       round(score_mean, 3) AS score_rounded
FROM units""", uses="units")
def fmt_ordinal_and_signed(s: Stages) -> DataFrame:
    return s.units.select(
        "unit",
        text.ordinal("tier_rank").alias("rank_text"),
        text.fixed("score_mean", signed=True).alias("score_text"),
        text.percent("tier_pct").alias("pct_text"),
        text.fixed("wealth_mean", 1, grouped=True).alias("wealth_text"),
        rnd("score_mean", 3).alias("score_rounded"),
    )


@query("str_short_name", "SELECT DISTINCT unit, unit_name AS short FROM panel")
def str_short_name(s: Stages) -> DataFrame:
    return _labelled(s).select("unit", text.short_name("label").alias("short")).distinct()


@query("distinct_sorted", "SELECT DISTINCT region, tier FROM panel ORDER BY region, tier")
def distinct_sorted(s: Stages) -> DataFrame:
    return s.panel.select("region", "tier").distinct().orderBy("region", "tier")


@query("forecast_grid", """
SELECT unit, CAST(unnest(range((SELECT min(period) FROM panel), 2009)) AS INTEGER) AS period FROM (SELECT DISTINCT unit FROM panel) u""")
def forecast_grid(s: Stages) -> DataFrame:
    return s.panel.select("unit").distinct().select("unit", F.explode(F.sequence(F.lit(s.periods[0]), F.lit(HORIZON))).alias("period"))
