"""Sources, cleaning, joins, text, quality and reports on small frames."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from allocora.functions import fixed, text
from allocora.functions.labels import p_text, stars
from allocora.functions.numeric import nan_to_null, ratio, skewness_corrected, to_number
from allocora.model.within import demean
from allocora.operators import aggregates as agg
from allocora.operators import joins, quality, ranking, reshape
from allocora.plans import reports
from allocora.runtime import collect_bounded, drop_stage_tables, scratch_path, small_table, stage
from allocora.sources import files


def col_of(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_csv_scan_with_bom_crlf_and_quoted_comma(spark, tmp_path):
    path = tmp_path / "names.csv"
    path.write_bytes('\ufeffname,n\r\n"Bahamas, The",1\r\nHaiti\u00a0,2\r\n'.encode())
    df = files.read_csv(spark, str(path), "name string, n int")
    assert sorted(col_of(df, text.trim_unicode("name"))) == ["Bahamas, The", "Haiti"]


def test_csv_scan_fails_on_mismatch(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("name,n\nx,not a number\n")
    with pytest.raises(Exception):
        files.read_csv(spark, str(path), "name string, n int").collect()


def test_preamble_source(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text('"Data Source","x",\n\n"Last Updated","y",\n\n"Name","Code","2010","2011",\n"A, B","AAA","1.5","..",\n"C","CCC","","2",\nfooter\n')
    df = files.read_csv_with_preamble(spark, str(path), 4, "Code", "^[A-Z]{3}$", footer=["footer"])
    assert df.columns == ["Name", "Code", "2010", "2011", "Unnamed: 4"]
    long = reshape.unpivot_years(reshape.drop_columns_like(df, "^Unnamed"), ["Code"], 2010, 2023, "v")
    cells = {(r.Code, r.period): r.v for r in long.withColumn("v", reshape.clean_number("v")).collect()}
    assert cells == {("AAA", 2010): 1.5, ("AAA", 2011): None, ("CCC", 2010): None, ("CCC", 2011): 2.0}


@pytest.mark.parametrize("bad", ["A7,6", "4,8,9,10", "7", '"8'])
def test_preamble_source_rejects_what_is_not_announced(spark, tmp_path, bad):
    path = tmp_path / "bad.csv"
    path.write_text(f"Source,x\n\nid,v\n1,5\n{bad}\n3,7\nthe end\n")
    rows, rejected = files.preamble_rows(spark, str(path), 2, "id", "^[0-9]+$", footer=["the end"])
    assert sorted((r.id, r.v) for r in rows.collect()) == [("1", "5"), ("3", "7")]
    assert [r.line for r in rejected.collect()] == [bad]
    with pytest.raises(files.RejectedRowsError, match="1 rows rejected"):
        files.read_csv_with_preamble(spark, str(path), 2, "id", "^[0-9]+$", footer=["the end"])


def test_preamble_in_every_file(spark, tmp_path):
    for name, row in (("a.csv", "1,5"), ("b.csv", "2,6")):
        (tmp_path / name).write_text(f"Source,x\nid,v\n{row}\n")
    df = files.read_csv_with_preamble(spark, str(tmp_path), 1, "id", "^[0-9]+$")
    assert sorted((r.id, r.v) for r in df.collect()) == [("1", "5"), ("2", "6")]


def test_malformed_json_fails(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"code":"AAA","v":3}\n{"code":"B","v":"x"}\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_json_records(spark, str(tmp_path / "r.json"), "code string, v bigint", "code", "v").collect()
    (tmp_path / "p.json").write_text('[{"page":1},[{"code":"AAA","v":3}]]\n[{"page":2},[{"code":')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_json_pages(spark, str(tmp_path / "p.json"), "code: string, v: bigint", "code", "v").collect()
    texts = spark.createDataFrame([("{",)], "t string")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.records_from_text(texts, "t", "k bigint").collect()


def test_nan_in_sources_is_missing(spark, tmp_path):
    (tmp_path / "n.csv").write_text("name,v\na,NaN\nb,1.5\n")
    got = files.read_csv(spark, str(tmp_path / "n.csv"), "name string, v double").collect()
    assert {r.name: r.v for r in got} == {"a": None, "b": 1.5}


def test_csv_text_with_header(spark):
    df = spark.createDataFrame([(1, "x")], "id int, name string")
    assert [r.line for r in files.csv_text(df, header=True).collect()] == ["id,name", "1,x"]


def test_unit_scores_of_unscored_periods_and_large_means(spark):
    from allocora.plans.unit_table import unit_scores

    rows = [(1, p, s, t) for p, (s, t) in enumerate([(1.0, "H"), (None, "H"), (None, None)])]
    rows += [(2, p, 1e8 + p / 10, "LH"[p % 2]) for p in range(5)] + [(3, 0, None, "L"), (4, 0, 2.0, "L")]
    df = spark.createDataFrame(rows, "unit int, period int, score double, tier string")
    df = df.selectExpr("*", "1D need", "1D outcome", "1D wealth", "1D gov", "'n' unit_name", "'r' region")
    got = {r.unit: (r.n_periods, r.score_mean, r.score_std) for r in unit_scores(df).collect()}
    assert got[1] == (3, 1.0, None) and got[3] == (1, None, None) and got[4] == (1, 2.0, None)
    assert got[2] == (5, pytest.approx(1e8 + 0.2), pytest.approx(0.15811388, rel=1e-6))


def test_crosstab_has_every_row_asked_for(spark):
    df = spark.createDataFrame([("b", "x"), ("b", "y"), (None, "x"), ("z", "x")], "r string, c string")
    got = agg.crosstab(df, "r", "c", ["x", "y"], rows=["a", "b"]).collect()
    assert [tuple(r) for r in got] == [("a", 0, 0), ("b", 1, 1)]


def test_first_candidate_falls_back(spark):
    df = spark.createDataFrame([(1, "b", 0.9), (2, "a", 0.5)], "unit int, name string, r2 double")
    best = [F.col("r2").desc(), F.col("unit")]
    assert ranking.first_candidate(df, F.col("r2") > 0.3, best, ["name"]).first().unit == 1
    assert ranking.first_candidate(df, F.col("r2") > 2, best, ["name"]).first().unit == 2


def test_json_pages_and_records(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"page":1},[{"code":"AAA","v":3},{"code":"","v":1},{"code":"BBB","v":null}]]\n')
    rows = files.read_json_pages(spark, str(tmp_path / "p.json"), "code: string, v: bigint", "code", "v").collect()
    assert [(r.code, r.v) for r in rows] == [("AAA", 3)]
    (tmp_path / "r.json").write_text('[{"code":"AAA","v":3},\n{"code":"","v":1}]')
    rows = files.read_json_records(spark, str(tmp_path / "r.json"), "code string, v bigint", "code", "v", multiline=True)
    assert rows.count() == 1


def test_stage_is_bucketed_and_readable(spark):
    df = spark.range(100).select((F.col("id") % 10).alias("unit"), F.col("id").alias("period"))
    table = stage(df, "t", bucket_by="unit", sort_by=("unit", "period"))
    assert table.count() == 100
    plan = table.groupBy("unit").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert stage(df, "plain").count() == 100
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_stage_tables_leave_the_catalog(spark):
    session = spark.newSession()
    stage(session.range(5).toDF("unit"), "gone", bucket_by="unit")
    names = {t.name for t in session.catalog.listTables()}
    assert any(n.startswith("allocora_gone") for n in names)
    from allocora import runtime

    kept = runtime._stage_tables[spark.sparkContext.applicationId]
    runtime._stage_tables[spark.sparkContext.applicationId] = [t for t in kept if t.startswith("allocora_gone")]
    drop_stage_tables(session)
    runtime._stage_tables[spark.sparkContext.applicationId] = [t for t in kept if not t.startswith("allocora_gone")]
    assert not any(t.name.startswith("allocora_gone") for t in session.catalog.listTables())


def test_small_table_broadcasts_only_when_proven(spark):
    big = spark.range(50).toDF("k")
    left = spark.range(100).toDF("k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda df: left.join(df, "k")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan(small_table(big, 50))
        assert "BroadcastHashJoin" not in plan(small_table(big, 49))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(ValueError):
        collect_bounded(big, 49, "rows")


def test_nan_and_division(spark):
    df = nan_to_null(spark.createDataFrame([(float("nan"), 0.0), (None, 2.0), (4.0, 2.0)], "a double, b double"))
    assert col_of(df, "a") == [None, None, 4.0]
    assert col_of(df, ratio("a", "b")) == [None, None, 2.0]
    assert col_of(spark.createDataFrame([("..",), ("1.5",), (None,)], "t string"), to_number("t")) == [None, 1.5, None]


def test_skewness_small_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 2.0), ("c", 1.0), ("c", 2.0), ("c", 9.0)], "g string, v double")
    out = {r.g: r.s for r in df.groupBy("g").agg(skewness_corrected("v").alias("s")).collect()}
    assert out["a"] is None and out["b"] is None and out["c"] == pytest.approx(pd.Series([1.0, 2, 9]).skew())


def test_text_forms(spark):
    df = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 11, 12, 13, 21, 101, 111, 112, 123)], "n int")
    assert col_of(df, text.ordinal("n")) == ["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "101st", "111th", "112th", "123rd"]
    x = spark.createDataFrame([(0.125,), (-1234.5,), (None,)], "x double")
    assert col_of(x, text.fixed("x", 2, signed=True)) == ["+0.13", "-1234.50", None]
    assert col_of(x, text.fixed("x", 0, grouped=True)) == ["0", "-1,235", None]
    assert col_of(x, text.percent("x"))[0] == "13%"
    assert col_of(x.limit(1), text.render("{a} of {b}!", a=F.lit("x"), b=3)) == ["x of 3!"]
    p = spark.createDataFrame([(0.0001,), (0.004,), (0.02,), (0.2,)], "p double")
    assert col_of(p, stars("p")) == ["***", "**", "*", ""]
    assert col_of(p, p_text("p")) == ["<0.001", "0.004", "0.020", "0.200"]


def test_fill_stays_within_unit(spark):
    rows = [(1, 1, "L"), (1, 2, None), (1, 3, "M"), (1, 4, None), (2, 1, None), (2, 2, None), (3, 1, None), (3, 2, "H")]
    df = spark.createDataFrame(rows, "unit int, period int, tier string")
    out = {(r.unit, r.period): r.tier for r in reshape.fill_within_unit(df, "tier").collect()}
    assert out == {(1, 1): "L", (1, 2): "M", (1, 3): "M", (1, 4): "M", (2, 1): None, (2, 2): None, (3, 1): "H", (3, 2): "H"}


def test_exclude_key_keeps_missing(spark):
    df = spark.createDataFrame([("x",), (None,), ("y",)], "k string")
    assert {r.k for r in reshape.exclude_key(df, "k", "x").collect()} == {None, "y"}


def test_modal_and_recent_level(spark):
    rows = [(1, 1, "L"), (1, 2, "M"), (1, 3, "M"), (1, 4, "L"), (1, 5, None), (2, 1, None)]
    df = spark.createDataFrame(rows, "unit int, period int, tier string")
    assert [tuple(r) for r in agg.modal_level(df, "unit", "tier", "period", "m").collect()] == [(1, "L")]
    recent = {r.unit: r.t for r in df.groupBy("unit").agg(agg.recent_level("tier", "period").alias("t")).collect()}
    assert recent == {1: "L", 2: None}


def test_sum_by_key_rules(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None), (None, 5.0)], "k string, v double")
    assert {r.k: r.v for r in agg.sum_by_key(df, ["k"], "v").collect()} == {"a": 1.0, "b": 0.0}


def test_duplicates_counts(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1)], "k int, v int")
    assert tuple(agg.duplicates(df, ["k"]).first()) == (1, 2)
    assert tuple(agg.duplicates(df.limit(0), ["k"]).first()) == (0, 0)


def test_fanout_guard(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(joins.DuplicateKeyError):
        joins.guarded_left_join(left, right, ["k"])
    assert joins.guarded_left_join(left, right.limit(1), ["k"]).count() == 2


@pytest.mark.parametrize("edits", [1, 2])
@pytest.mark.parametrize("most_aliases", [1000, 3])
def test_near_names_equal_brute_force(spark, edits, most_aliases):
    draw = random.Random(edits)
    alias = ["", "a", "b", "zz", "aaaaaaaa", "aaaaaaaaaa", "ab", "ba", "ünï"]
    alias += ["".join(draw.choice("abc") for _ in range(draw.randint(1, 9))) for _ in range(150)]
    alias += [f"unit#{draw.randint(0, 9999):08d}" for _ in range(100)]

    def edited(text):
        for _ in range(draw.randint(0, 4)):
            at = draw.randint(0, len(text))
            text = text[:at] + draw.choice(["", "a", "7", "x"]) + text[at + draw.randint(0, 1) :]
        return text

    names = sorted({edited(draw.choice(alias)) for _ in range(200)} | {"", "q", "qq", "qqq"})
    alias = sorted(set(alias))
    wanted = spark.createDataFrame([(n,) for n in names], "_key string")
    offered = spark.createDataFrame([(a, a) for a in alias], "_cand string, _code string")
    pairs = joins.near_pairs(wanted, offered, edits, most_aliases).withColumn("d", F.levenshtein("_key", "_cand", edits)).filter("d >= 0")
    found = {r["_key"]: (r["d"], r["_cand"]) for r in pairs.groupBy("_key").agg(F.min(F.struct("d", "_cand")).alias("b")).select("_key", "b.*").collect()}
    every = wanted.join(offered, F.levenshtein("_key", "_cand") <= edits).withColumn("d", F.levenshtein("_key", "_cand"))
    best = {r["_key"]: (r["d"], r["_cand"]) for r in every.groupBy("_key").agg(F.min(F.struct("d", "_cand")).alias("b")).select("_key", "b.*").collect()}
    assert found == best and len(best) > 100


def test_figures_of_the_writing_pass(spark):
    rows = [("a", 1, 1.0), ("a", 2, None), ("b", 1, 2.0), ("b", 1, 3.0), (None, 1, 4.0), ("c", None, 1.0), ("c", None, None)]
    df = spark.createDataFrame(rows, "unit string, period int, v double").repartition(3)
    spark.sparkContext.setJobGroup("writing", "one pass")
    written, found = quality.stage_measured(df, "measured", "unit", "period", ["v", "unit"])
    made = len(spark.sparkContext.statusTracker().getJobIdsForGroup("writing"))
    spark.sparkContext.setJobGroup("plain", "one pass")
    stage(df, "plain", bucket_by="unit", sort_by=("unit", "period"))
    assert made == len(spark.sparkContext.statusTracker().getJobIdsForGroup("plain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == {"n_rows": 7, "n_units": 3, "n_repeated": 2, "v_missing": 2, "unit_missing": 1}
    assert sorted(map(str, written.collect())) == sorted(map(str, df.collect()))
    with pytest.raises(quality.QualityError, match="2 repeated rows; 2 rows without v"):
        quality.require(found, n_rows=7, n_units=3, not_null=["v"])
    empty, none = quality.stage_measured(df.limit(0), "empty", "unit", "period")
    assert empty.isEmpty() and none["n_rows"] == none["n_units"] == 0
    quality.require(none)


def test_name_resolution(spark):
    aliases = spark.createDataFrame([("Haiti", "HTI"), ("Fiji", "FJI"), ("Mali", "MLI"), ("Malo", "MLO"), ("São Tomé", "STP")], "name string, code string")
    over = spark.createDataFrame([("St. Lucia", "LCA"), ("Fiji", "OVR")], "name string, code string")
    names = spark.createDataFrame([("Haiti\u00a0",), ("HAITI",), ("Hayti",), ("Fiji",), ("St. Lucia",), ("Mal",), ("Nowhere",), ("sao Tomé",), ("Hayty",)], "name string")
    out = {r.name: (r.code, r.method) for r in joins.resolve_names(names, aliases, over).collect()}
    assert out["Haiti"] == ("HTI", "alias") and out["HAITI"] == ("HTI", "alias")
    assert out["Hayti"] == ("HTI", "nearest") and out["sao Tomé"] == ("STP", "nearest")
    assert out["Fiji"] == ("OVR", "override") and out["St. Lucia"] == ("LCA", "override")
    assert out["Mal"] == ("MLI", "nearest")
    assert out["Nowhere"] == (None, None) and out["Hayty"] == (None, None)
    two = {r.name: r.code for r in joins.resolve_names(names, aliases, over, max_edits=2).collect()}
    assert two["Hayty"] == "HTI" and two["Nowhere"] is None


def test_region_lookup(spark):
    units = spark.createDataFrame([("KEN", "Eastern Africa"), ("TUR", "Western Asia"), ("ZZZ", "Atlantis")], "unit string, sub string")
    over = spark.createDataFrame([("TUR", "North"), ("CYP", "North")], "unit string, region string")
    lookup = spark.createDataFrame([("Eastern Africa", "South"), ("Western Asia", "East")], "sub string, region string")
    out = {r.unit: r.region for r in joins.lookup_with_override(units, "unit", "sub", over, lookup, "region").collect()}
    assert out == {"KEN": "South", "TUR": "North", "ZZZ": None}


def test_membership_and_alignment(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    members = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert {r.k: r.f for r in joins.membership_flag(df, members, "k", "f").collect()} == {1: 1, 2: 0}
    a = spark.createDataFrame([(1, 5), (2, 7)], "k int, n int")
    b = spark.createDataFrame([(1, 2)], "k int, n int")
    assert [tuple(r) for r in joins.aligned_difference(a, b, "k", "n").collect()] == [(1, 3)]


def test_quality_gate(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (2, 3.0)], "unit int, v double")
    assert quality.expect(df, n_rows=3, n_units=2) is df
    with pytest.raises(quality.QualityError, match="4 rows|expected 4"):
        quality.expect(df, n_rows=4)
    with pytest.raises(quality.QualityError, match="without v"):
        quality.expect(df, not_null=["v"])


def test_demean(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 5.0)], "p int, v double")
    assert sorted(col_of(demean(df, ["v"], "p"), "v")) == [-1.0, 0.0, 1.0]


UNITS = (
    "unit int, unit_name string, region string, profile string, score_mean double, tier string, tier_rank int, tier_n int,"
    " need_mean double, outcome_mean double, n_periods int, thin_data boolean"
)


@pytest.fixture(scope="module")
def units(spark):
    rows = [
        (1, "Alpha, The", "North", "Underfunded", -0.5, "L", 1, 2, 0.4, 12.5, 7, False),
        (2, "Beta", "North", "Over-Resourced", 1.5, "L", 2, 2, 0.3, 1234.0, 7, False),
        (3, "Gamma", "South", "Adequately Funded", 0.0, "H", 1, 1, 0.2, 7.0, 2, True),
    ]
    return spark.createDataFrame(rows, UNITS)


def test_unit_summary(units):
    out = {r.unit: r for r in reports.unit_summary(units).collect()}
    assert "ranking 1st of 2 in the low-income tier (the most underfunded in its tier)" in out[1].unit_text
    assert "(the most over-resourced in its tier)" in out[2].unit_text
    assert out[1].unit_text.startswith("**Alpha, The** is **Underfunded**. Its adaptation aid sits 0.50 log units below")
    assert "Alpha, The runs 1.00 log units more underfunded than that regional average." in out[1].region_text
    assert "fall below the model line" not in out[1].region_text
    assert out[3].region_text == "Gamma is the only sampled country in **South**, so no regional comparison is available."
    assert out[3].unit_text.endswith("read with caution.")


def test_facts_leave_out_what_is_missing(spark, units):
    regional = spark.createDataFrame([("North", "closing", -0.2, -0.1)], "region string, status string, gap_base double, gap_horizon double")
    projection = spark.createDataFrame([(1, 1500.4, 12.6, 1.25, True)], "unit int, fit_horizon double, pct_change double, annual_pct double, trend_significant boolean")
    rows = reports.facts(units, regional, projection)
    out = {r.unit: r.facts.split("\n") for r in reports.facts_text(rows, 2010, 2023, 2030).collect()}
    assert [len(out[u]) for u in (1, 2, 3)] == [8, 7, 7]
    assert out[1][0] == "Country: Alpha, The (region: North)"
    assert out[1][5] == "Mean annual adaptation aid observed: $12.50 million over 7 years"
    assert out[1][6] == "Regional gap for North is closing: -0.20 in 2023, projected to -0.10 by 2030."
    assert "near $1,500 million by 2030 (+13% vs 2023, +1.3% per year, trend statistically significant)." in out[1][7]
    assert out[3][6].startswith("Data caveat")


def test_kpis_scale_and_labels(spark, units):
    row = reports.headline_kpis(units).first()
    assert (row.n_units, row.n_regions_below, row.n_regions, row.regions_below) == (3, 0, 2, "")
    assert row.top_share == 1.0
    ticks = {r.tick: r.text for r in reports.map_scale(units).collect()}
    assert ticks == {-1: "-1  · far below predicted", 0: "0  · as predicted", 1: "+1  · far above predicted"}
    points = spark.createDataFrame([(1, 1.0, 2.0), (3, 0.0, 0.0)], "unit int, lat double, lon double")
    assert [r.short for r in reports.label_points(units, points, 5).collect()] == ["Alpha"]


def test_regional_cards(spark):
    rows = [("A", -0.2, -0.1, 0.01, "closing"), ("B", -0.4, -0.7, -0.04, "widening"), ("C", -0.1, -0.5, -0.06, "widening"), ("D", 0.3, 0.4, 0.01, "widening")]
    df = spark.createDataFrame(rows, "region string, gap_base double, gap_horizon double, slope double, status string")
    card = reports.regional_cards(df).first()
    assert (card.n_regions, card.n_widening, card.n_closing, card.balance) == (4, 3, 1, 2)
    assert (card.closing_region, card.widening_region) == ("A", "C")
    assert card.widening_change == pytest.approx(0.4)
    none = reports.regional_cards(df.filter("region = 'D'")).first()
    assert none.closing_region is None and none.widening_region is None


def test_meanings_cover_every_case(spark):
    rows = [(i, f"U{i}", p, d, s, 9) for i, (p, d, s) in enumerate((p, d, s) for p in fixed.PROFILES for d in ("Rising", "Falling", "Flat") for s in (True, False))]
    df = spark.createDataFrame(rows, "unit int, unit_name string, profile string, direction string, trend_significant boolean, n_periods int")
    out = reports.meanings(df).collect()
    assert len(out) == 24 and all(r.meaning for r in out)
    assert sum("not statistically significant (9 observed periods)" in r.meaning for r in out) == 12


def test_exclusions(spark):
    panel = spark.createDataFrame([(1, "A", 2000, None, 5.0), (1, "A", 2003, None, 1500.0), (2, "B", 2000, 1.0, 2.0), (3, "C", 2000, 1.0, 3.0)], "unit int, unit_name string, period int, need double, outcome double")
    rows = {r.unit: r for r in reports.exclusions(panel, panel.filter("unit = 2"), {"need": "Need"}).collect()}
    assert set(rows) == {1, 3}
    assert (rows[1].missing_inputs, rows[1].periods, rows[1].total_text) == ("Need", "2000 to 2003", "$1,505M")
    assert rows[3].missing_inputs == ""


def test_growth_verdict(spark):
    rows = [("Chronically Underfunded", 3.0, True), ("Chronically Underfunded", 9.0, False), ("Over-Resourced", 5.0, True)]
    growth = reports.growth_by_profile(spark.createDataFrame(rows, "profile string, annual_pct double, trend_significant boolean"))
    medians = {(r.trends, r.profile): (r.median, r.n) for r in growth.collect()}
    assert medians[("all", "Chronically Underfunded")] == (6.0, 2) and medians[("significant", "Chronically Underfunded")] == (3.0, 1)
    assert reports.growth_verdict(growth).first().verdict == "CLOSING"
