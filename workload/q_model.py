"""The regression model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allocora.functions import fixed
from allocora.model import absorb, cluster, cv, gram, score
from allocora.model.spec import ModelSpec
from allocora.plans.order_panel import SPEC, SPLIT_PERIOD
from workload import sql
from workload.registry import Stages, query, r6

TERMS = sql.terms()
TERM_VALUES = ", ".join(f"({i}, '{t}')" for i, t in enumerate(TERMS, 1))
TWO = ("need", "log_size")

# Within-period demeaned regression on two covariates, by Cramer's rule.
TWO_SQL = """
m2 AS (SELECT unit, period, ln(1 + outcome) AS y, need AS x1, ln(size) AS x2 FROM panel WHERE outcome IS NOT NULL AND need IS NOT NULL AND size IS NOT NULL),
d2 AS (SELECT unit, period, y - avg(y) OVER w AS y, x1 - avg(x1) OVER w AS x1, x2 - avg(x2) OVER w AS x2 FROM m2 WINDOW w AS (PARTITION BY period)),
g2 AS (SELECT sum(x1*x1) AS s11, sum(x1*x2) AS s12, sum(x2*x2) AS s22, sum(x1*y) AS s1y, sum(x2*y) AS s2y, count(*) AS n, sum(y*y) AS yy,
              count(DISTINCT unit) AS ng, count(DISTINCT period) AS np FROM d2),
b2 AS (SELECT (s22*s1y - s12*s2y)/(s11*s22 - s12*s12) AS b1, (s11*s2y - s12*s1y)/(s11*s22 - s12*s12) AS b2, g2.*, s11*s22 - s12*s12 AS det FROM g2),
s2 AS (SELECT d2.unit, sum(d2.x1*(d2.y - b1*d2.x1 - b2*d2.x2)) AS u1, sum(d2.x2*(d2.y - b1*d2.x1 - b2*d2.x2)) AS u2 FROM d2, b2 GROUP BY d2.unit),
q2 AS (SELECT sum(u1*u1) AS m11, sum(u1*u2) AS m12, sum(u2*u2) AS m22 FROM s2)"""


def _two_spec() -> ModelSpec:
    return ModelSpec("log_outcome", TWO, (("period", None),))


def _two_rows(s: Stages) -> DataFrame:
    return s.panel.withColumns({"log_outcome": F.log1p("outcome"), "log_size": F.ln("size")})


def _fitted(s: Stages) -> cluster.ClusteredFit:
    rows = s.model
    return cluster.cluster_fit(rows, gram.fit(rows, SPEC))


@query("model_ols", f"""
SELECT t.term, round(c.coef, 6) AS coef FROM (VALUES {TERM_VALUES}) t(i, term) JOIN (SELECT i, b[i] AS coef FROM fe_b, generate_series(1, 16) s(i)) c ON c.i = t.i""", uses="scored")
def model_ols(s: Stages) -> DataFrame:
    found = gram.fit(s.model, SPEC)
    rows = [(t, found.coefficients.get(t)) for t in found.terms]
    return s.spark.createDataFrame(rows, "term string, coef double").select("term", *r6("coef"))


@query("model_ols_fwl2", "WITH " + TWO_SQL + "\nFINAL SELECT round(b1, 6) AS b_need, round(b2, 6) AS b_size, n FROM b2")
def model_ols_fwl2(s: Stages) -> DataFrame:
    found = gram.fit(_two_rows(s), _two_spec())
    row = (found.coefficients["need"], found.coefficients["log_size"], found.n)
    return s.spark.createDataFrame([row], "b_need double, b_size double, n bigint").select(*r6("b_need", "b_size"), "n")


@query("model_within_demean", "WITH " + TWO_SQL + "\nFINAL SELECT unit, period, round(y, 6) AS y, round(x1, 6) AS x1, round(x2, 6) AS x2 FROM d2")
def model_within_demean(s: Stages) -> DataFrame:
    from allocora.model.within import demean

    rows = _two_rows(s).select("unit", "period", F.col("log_outcome").alias("y"), F.col("need").alias("x1"), F.col("log_size").alias("x2"))
    return demean(rows.na.drop(), ["y", "x1", "x2"], "period").select("unit", "period", *r6("y", "x1", "x2"))


@query("model_cluster_se", f"""
SELECT t.term, round(c.coef, 6) AS coef, round(c.se, 6) AS se FROM (VALUES {TERM_VALUES}) t(i, term) JOIN fe_coef c ON c.i = t.i""", uses="scored")
def model_cluster_se(s: Stages) -> DataFrame:
    return score.coefficient_rows(s.spark, _fitted(s)).select("term", *r6("coef", "se"))


@query("model_cluster_se_fwl2", "WITH " + TWO_SQL + """
FINAL SELECT
  round(sqrt((s22*s22*m11 - 2*s22*s12*m12 + s12*s12*m22)/(det*det) * (ng*1.0/(ng-1)) * ((n-1)*1.0/(n-2-np))), 6) AS se_need,
  round(sqrt((s12*s12*m11 - 2*s12*s11*m12 + s11*s11*m22)/(det*det) * (ng*1.0/(ng-1)) * ((n-1)*1.0/(n-2-np))), 6) AS se_size
FROM b2, q2""")
def model_cluster_se_fwl2(s: Stages) -> DataFrame:
    rows = _two_rows(s)
    f = cluster.cluster_fit(rows, gram.fit(rows, _two_spec()))
    row = (f.term("need")["se"], f.term("log_size")["se"])
    return s.spark.createDataFrame([row], "se_need double, se_size double").select(*r6("se_need", "se_size"))


@query("model_scores", "SELECT unit, period, round(predicted, 6) AS predicted, round(score, 6) AS score FROM scored", uses="scored")
def model_scores(s: Stages) -> DataFrame:
    rows = s.model
    return score.add_scores(rows, gram.fit(rows, SPEC)).select("unit", "period", *r6("predicted", "score"))


@query("model_scores_fwl2", "WITH " + TWO_SQL + "\nFINAL SELECT unit, period, round(d2.y - b1*x1 - b2*x2, 6) AS score FROM d2, b2")
def model_scores_fwl2(s: Stages) -> DataFrame:
    rows = _two_spec().complete(_two_rows(s))
    return score.add_scores(rows, gram.fit(rows, _two_spec())).select("unit", "period", *r6("score"))


@query("model_fit_stats", """
SELECT f.n, round(f.r2, 6) AS r2, round(f.adj_r2, 6) AS adj_r2, round((SELECT avg(abs(score)) FROM scored), 6) AS mae FROM fe_fit f""", uses="scored")
def model_fit_stats(s: Stages) -> DataFrame:
    stats = score.fit_statistics(s.scored, "log_outcome", "predicted", s.solution.rank)
    return stats.select("n", *r6("r2", "adj_r2", "mae"))


# Unit effects by demeaning, period effects as dummies demeaned like the rest; the units count in the degrees of freedom.
ABSORB_TERMS = ("need", "log_size")
ABSORB_SQL = "WITH ab_rows AS (SELECT unit, period, " + ", ".join(
    f"{x} - avg({x}) OVER w AS {name}"
    for name, x in [(c, c) for c in ("log_outcome", *ABSORB_TERMS)] + [(f"p{p}", f"(period = {p})::INT") for p in sql.PERIODS]
) + " FROM model WINDOW w AS (PARTITION BY unit))," + sql.ols("ab", "ab_rows", "[" + ", ".join([*ABSORB_TERMS, *[f"p{p}" for p in sql.PERIODS]]) + "]", 8) + """,
ab_size AS (SELECT count(*) AS n, count(DISTINCT unit) AS units FROM model)
FINAL """


def _absorbed(s: Stages) -> absorb.AbsorbedFit:
    return absorb.fit_absorbed(s.model, absorb.AbsorbSpec("log_outcome", ABSORB_TERMS, ("unit", "period"), "unit"))


@query("model_absorbed", ABSORB_SQL + """
SELECT t.term, round(c.coef, 6) AS coef, round(c.se * sqrt((z.n - 8.0) / (z.n - 8 - z.units)), 6) AS se, z.n, z.units + 8 AS coefficients
FROM (VALUES (1, 'need'), (2, 'log_size')) t(i, term) JOIN ab_coef c ON c.i = t.i, ab_size z""", uses="model")
def model_absorbed(s: Stages) -> DataFrame:
    f = _absorbed(s)
    rows = [(t, f.term(t)["estimate"], f.term(t)["se"], f.n, f.rank) for t in f.kept]
    columns = "term string, coef double, se double, n bigint, coefficients bigint"
    return s.spark.createDataFrame(rows, columns).select("term", *r6("coef", "se"), "n", "coefficients")


@query("model_absorbed_scores", ABSORB_SQL + "SELECT unit, period, round(e, 6) AS score FROM ab_e", uses="model")
def model_absorbed_scores(s: Stages) -> DataFrame:
    return absorb.add_absorbed_scores(s.model, _absorbed(s)).select("unit", "period", *r6("score"))


VIF = ["need", "composite", "log_wealth"]


@query("model_vif", """
WITH c AS (SELECT corr(need, composite) AS a, corr(need, log_wealth) AS b, corr(composite, log_wealth) AS c FROM model)
FINAL SELECT 'need' AS predictor, round((1 - c*c) / (1 + 2*a*b*c - a*a - b*b - c*c), 6) AS vif FROM c
UNION ALL SELECT 'composite', round((1 - b*b) / (1 + 2*a*b*c - a*a - b*b - c*c), 6) FROM c
UNION ALL SELECT 'log_wealth', round((1 - a*a) / (1 + 2*a*b*c - a*a - b*b - c*c), 6) FROM c""", uses="model")
def model_vif(s: Stages) -> DataFrame:
    spec = ModelSpec("log_outcome", tuple(VIF))
    rows = spec.complete(s.model)
    found = gram.vif(gram.gram(rows, gram.make_design(rows, spec)), VIF)
    return s.spark.createDataFrame(list(found.items()), "predictor string, vif double").select("predictor", *r6("vif"))


@query("cv_fold_assignment", "SELECT DISTINCT unit, CAST(unit % 5 AS INTEGER) AS fold FROM model", uses="model")
def cv_fold_assignment(s: Stages) -> DataFrame:
    return cv.key_fold(s.model.select("unit").distinct(), "unit").select("unit", "fold")


CV_SQL = "WITH " + sql.ols("cv", "(SELECT m.*, f.fold FROM model m JOIN (SELECT unnest(range(5)) AS fold) f ON m.unit % 5 <> f.fold) t",
    sql.design_list(), 16, group="fold", cov=False) + """,
held AS (SELECT t.unit % 5 AS fold, t.log_outcome AS y, t.log_outcome - list_dot_product(""" + sql.design_list() + """, q.b) AS e
  FROM model t JOIN cv_b q ON q.g = t.unit % 5),
folds AS (SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n, 1 - sum(e * e) / (var_pop(y) * count(*)) AS r2, avg(abs(e)) AS mae FROM held GROUP BY fold)
FINAL """


@query("model_group_cv", CV_SQL + "SELECT fold, n, round(r2, 6) AS r2, round(mae, 6) AS mae FROM folds", uses="model")
def model_group_cv(s: Stages) -> DataFrame:
    return cv.group_cv(cv.key_fold(s.model, "unit"), SPEC).select("fold", "n", *r6("r2", "mae"))


@query("model_group_cv_summary", CV_SQL + """
SELECT round(avg(r2), 6) AS r2_mean, round(stddev_pop(r2), 6) AS r2_std, round(avg(mae), 6) AS mae_mean, round(stddev_pop(mae), 6) AS mae_std FROM folds""", uses="model")
def model_group_cv_summary(s: Stages) -> DataFrame:
    folds = cv.group_cv(cv.key_fold(s.model, "unit"), SPEC)
    return cv.cv_summary(folds).select(*r6("r2_mean", "r2_std", "mae_mean", "mae_std"))


# One unit at a time, largest first, to the lightest fold; the lowest fold among ties.
BALANCED_SQL = """
WITH queue AS MATERIALIZED (SELECT unit, count(*) AS c, row_number() OVER (ORDER BY count(*) DESC, unit) AS rn FROM model GROUP BY unit),
walk(rn, unit, fold, loads) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS INTEGER), CAST([0, 0, 0, 0, 0] AS BIGINT[])
  UNION ALL
  SELECT q.rn, q.unit, CAST(list_position(w.loads, list_min(w.loads)) - 1 AS INTEGER),
         list_transform(w.loads, lambda v, i: v + CASE WHEN i = list_position(w.loads, list_min(w.loads)) THEN q.c ELSE 0 END)
  FROM walk w JOIN queue q ON q.rn = w.rn + 1)
FINAL SELECT unit, fold FROM walk WHERE rn > 0"""


@query("cv_balanced_folds", BALANCED_SQL, uses="model")
def cv_balanced_folds(s: Stages) -> DataFrame:
    return cv.balanced_fold(s.model.select("unit", "period"), "unit").select("unit", "fold").distinct()


CV_BALANCED_SQL = BALANCED_SQL[: BALANCED_SQL.index("FINAL")].rstrip() + """,
dealt AS MATERIALIZED (SELECT m.*, w.fold FROM model m JOIN walk w ON w.unit = m.unit),
""" + sql.ols("cv", "(SELECT m.* EXCLUDE (fold), f.fold FROM dealt m JOIN (SELECT unnest(range(5)) AS fold) f ON m.fold <> f.fold) t",
    sql.design_list(), 16, group="fold", cov=False).lstrip() + """,
held AS (SELECT t.fold, t.log_outcome AS y, t.log_outcome - list_dot_product(""" + sql.design_list() + """, q.b) AS e
  FROM dealt t JOIN cv_b q ON q.g = t.fold),
folds AS (SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n, 1 - sum(e * e) / (var_pop(y) * count(*)) AS r2, avg(abs(e)) AS mae FROM held GROUP BY fold)
FINAL """


@query("model_group_cv_balanced", CV_BALANCED_SQL + "SELECT fold, n, round(r2, 6) AS r2, round(mae, 6) AS mae FROM folds", uses="model")
def model_group_cv_balanced(s: Stages) -> DataFrame:
    return cv.group_cv(cv.balanced_fold(s.model, "unit"), SPEC).select("fold", "n", *r6("r2", "mae"))


@query("model_group_cv_balanced_summary", CV_BALANCED_SQL + """
SELECT round(avg(r2), 6) AS r2_mean, round(stddev_pop(r2), 6) AS r2_std, round(avg(mae), 6) AS mae_mean, round(stddev_pop(mae), 6) AS mae_std FROM folds""", uses="model")
def model_group_cv_balanced_summary(s: Stages) -> DataFrame:
    folds = cv.group_cv(cv.balanced_fold(s.model, "unit"), SPEC)
    return cv.cv_summary(folds).select(*r6("r2_mean", "r2_std", "mae_mean", "mae_std"))


# The same folds with keys that are text, in the order of their characters.
TEXT_SQL = BALANCED_SQL.replace("count(*) DESC, unit)", "count(*) DESC, CAST(unit AS VARCHAR))")
CV_TEXT_SQL = CV_BALANCED_SQL.replace("count(*) DESC, unit)", "count(*) DESC, CAST(unit AS VARCHAR))")


def _coded(s: Stages) -> DataFrame:
    return s.model.withColumn("code", F.col("unit").cast("string"))


@query("cv_balanced_folds_text", TEXT_SQL.replace("FINAL SELECT unit, fold", "FINAL SELECT CAST(unit AS VARCHAR) AS code, fold"), uses="model")
def cv_balanced_folds_text(s: Stages) -> DataFrame:
    return cv.balanced_fold(_coded(s).select("code", "period"), "code").select("code", "fold").distinct()


@query("model_group_cv_balanced_text", CV_TEXT_SQL + "SELECT fold, n, round(r2, 6) AS r2, round(mae, 6) AS mae FROM folds", uses="model")
def model_group_cv_balanced_text(s: Stages) -> DataFrame:
    return cv.group_cv(cv.balanced_fold(_coded(s), "code"), SPEC).select("fold", "n", *r6("r2", "mae"))


INTER_LIST = sql.design_list((*sql.NUMERICS, f"need * (period >= {SPLIT_PERIOD})::INT"))
INTER_SQL = "WITH " + sql.ols("ix", "model", INTER_LIST, 17) + f""",
cell AS (SELECT b.b[2] AS pre, b.b[8] AS shift, v22.v AS v22, v88.v AS v88, v28.v AS v28 FROM ix_b b
  JOIN ix_cov v22 ON v22.i = 2 AND v22.j = 2 JOIN ix_cov v88 ON v88.i = 8 AND v88.j = 8 JOIN ix_cov v28 ON v28.i = 2 AND v28.j = 8)
FINAL """
# Two-sided normal tail by Simpson's rule on the density.
NORMAL_P = """(SELECT 1 - 2 * sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-power(i * {z} / 2000, 2) / 2)) * ({z} / 2000) / 3 / sqrt(2 * pi())
  FROM generate_series(0, 2000) g(i))"""


def _inter_spec() -> ModelSpec:
    return ModelSpec(SPEC.outcome, SPEC.numeric, SPEC.categorical, (("need", "post"),))


def _inter_fit(s: Stages) -> cluster.ClusteredFit:
    rows = s.model.withColumn("post", (F.col("period") >= SPLIT_PERIOD).cast("int"))
    return cluster.cluster_fit(rows, gram.fit(rows, _inter_spec()))


@query("model_interaction", INTER_SQL + f"""
SELECT round(pre, 6) AS slope_pre, round(pre + shift, 6) AS slope_post, round(shift, 6) AS shift, round(sqrt(v88), 6) AS shift_se,
       round(p, 6) AS shift_p, p < 0.05 AS shifted FROM (SELECT *, {NORMAL_P.format(z='abs(shift / sqrt(v88))')} AS p FROM cell) c""", uses="model")
def model_interaction(s: Stages) -> DataFrame:
    f = _inter_fit(s)
    pre, shift = f.term("need"), f.term("need:post")
    row = (pre["estimate"], pre["estimate"] + shift["estimate"], shift["estimate"], shift["se"], shift["p"], shift["p"] < fixed.SIGNIFICANCE)
    columns = "slope_pre double, slope_post double, shift double, shift_se double, shift_p double, shifted boolean"
    return s.spark.createDataFrame([row], columns).select(*r6("slope_pre", "slope_post", "shift", "shift_se", "shift_p"), "shifted")


@query("model_linear_test", INTER_SQL + f"""
SELECT round(est, 6) AS estimate, round(se, 6) AS se, round({NORMAL_P.format(z='abs(est / se)')}, 6) AS p
FROM (SELECT pre + shift AS est, sqrt(v22 + v88 + 2 * v28) AS se FROM cell) c""", uses="model")
def model_linear_test(s: Stages) -> DataFrame:
    t = _inter_fit(s).combination({"need": 1.0, "need:post": 1.0})
    return s.spark.createDataFrame([(t["estimate"], t["se"], t["p"])], "estimate double, se double, p double").select(*r6("estimate", "se", "p"))


SPLIT_SQL = (
    "WITH "
    + sql.ols("pre", "(SELECT * FROM model WHERE period < 1998) t", sql.design_list(periods=(1996, 1997)), 12)
    + ","
    + sql.ols("post", "(SELECT * FROM model WHERE period >= 1998) t", sql.design_list(periods=(1999, 2000, 2001)), 13)
    + """
FINAL SELECT 'post' AS side, b.n, round(c.coef, 6) AS coef, round(c.se, 6) AS se FROM post_b b JOIN post_coef c ON c.i = 2
UNION ALL SELECT 'pre', b.n, round(c.coef, 6), round(c.se, 6) FROM pre_b b JOIN pre_coef c ON c.i = 2"""
)


@query("model_split_sample", SPLIT_SQL, uses="model")
def model_split_sample(s: Stages) -> DataFrame:
    rows = s.model.withColumn("side", F.when(F.col("period") < SPLIT_PERIOD, "pre").otherwise("post"))
    design = gram.make_design(SPEC.complete(rows), SPEC)
    sides = {side: gram.solve(g) for side, g in gram.grams_by(SPEC.complete(rows), design, "side").items()}
    out = []
    for side, f in cluster.cluster_fits(rows, sides, {side: F.col("side") == side for side in sides}).items():
        t = f.term("need")
        out.append((side, f.solution.n, t["estimate"], t["se"]))
    return s.spark.createDataFrame(out, "side string, n bigint, coef double, se double").select("side", "n", *r6("coef", "se"))


LABELS = {
    "need": "Need", "log_size": "Log size", "log_wealth": "Log wealth", "gov": "Governance", "flag_a": "Landlocked",
    "flag_b": "Island", "tier[H]": "Tier: High (vs Low)", "tier[LM]": "Tier: Lower-middle (vs Low)",
    "tier[UM]": "Tier: Upper-middle (vs Low)", "Intercept": "Intercept",
}
LABEL_VALUES = ", ".join(f"('{t}', '{label}', {i})" for i, (t, label) in enumerate(LABELS.items(), 1))


@query("model_coef_table", f"""
WITH t AS (SELECT * FROM (VALUES {TERM_VALUES}) v(i, term)), l AS (SELECT * FROM (VALUES {LABEL_VALUES}) v(term, label, place)),
c AS (SELECT t.term, f.coef, f.se, {NORMAL_P.format(z='least(abs(f.coef / f.se), 30)')} AS p FROM fe_coef f JOIN t ON t.i = f.i)
FINAL SELECT CAST(l.place AS INTEGER) AS place, l.label AS predictor, round(coef, 6) AS coef, round(se, 6) AS se,
  CASE WHEN p < 0.001 THEN '<0.001' ELSE printf('%.3f', p) END AS p_text,
  CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS sig,
  round(coef - 1.96 * se, 6) AS lo, round(coef + 1.96 * se, 6) AS hi, coef - 1.96 * se > 0 OR coef + 1.96 * se < 0 AS significant
FROM c JOIN l ON l.term = c.term""", uses="scored")
def model_coef_table(s: Stages) -> DataFrame:
    rows = score.coefficient_rows(s.spark, _fitted(s))
    table = score.coefficient_table(rows, r"^period\[", LABELS, list(LABELS))
    return table.select("place", "predictor", *r6("coef", "se"), "p_text", "sig", *r6("lo", "hi"), "significant")


@query("model_significant_count", f"""
WITH c AS (SELECT i, coef, se FROM fe_coef WHERE i BETWEEN 2 AND 10)
FINAL SELECT count(*) FILTER (abs(coef / se) > 1.9599639845400545) AS n_significant FROM c""", uses="scored")
def model_significant_count(s: Stages) -> DataFrame:
    rows = score.coefficient_rows(s.spark, _fitted(s)).filter(~F.col("term").rlike(r"^period\[|^Intercept$"))
    return rows.agg(F.count_if(F.col("p") < fixed.SIGNIFICANCE).alias("n_significant"))


BASE = ("need", "log_wealth", "gov", "flag_a", "flag_b")
SIZED = ("need", "log_wealth", "gov", "log_size", "flag_a", "flag_b")


def _nested_sql(name: str, p: str, numerics: tuple[str, ...]) -> str:
    names = ["Intercept", *numerics]
    values = ", ".join(f"({i}, '{t}')" for i, t in enumerate(names, 1))
    return f"""SELECT '{name}' AS model, t.term, round(c.coef, 6) AS coef, round(c.se, 6) AS se, f.n, round(f.r2, 6) AS r2, round(f.adj_r2, 6) AS adj_r2
FROM (VALUES {values}) t(i, term) JOIN {p}_coef c ON c.i = t.i JOIN {p}_fit f ON f.g = c.g"""


NESTED_SQL = (
    "WITH "
    + sql.ols("nb", "model", sql.design_list(BASE, (), ()), 6)
    + "," + sql.ols("ns", "model", sql.design_list(SIZED, (), ()), 7)
    + "," + sql.ols("nf", "model", sql.design_list(SIZED), 16)
    + "\nFINAL " + _nested_sql("base", "nb", BASE) + " UNION ALL " + _nested_sql("with size", "ns", SIZED)
    + " UNION ALL " + _nested_sql("full", "nf", SIZED)
)


@query("model_nested_specs", NESTED_SQL, uses="model")
def model_nested_specs(s: Stages) -> DataFrame:
    rows = SPEC.complete(s.model)
    full = gram.gram(rows, gram.make_design(rows, SPEC))
    dummies = [t for t in full.terms if "[" in t]
    models = {"base": BASE, "with size": SIZED, "full": (*SIZED, *dummies)}
    out = []
    for name, f in cluster.cluster_fits(rows, score.nested_models(full, models)).items():
        found = f.solution
        for term in found.kept:
            if "[" not in term:
                t = f.term(term)
                out.append((name, term, t["estimate"], t["se"], found.n, found.r2, found.adj_r2))
    columns = "model string, term string, coef double, se double, n bigint, r2 double, adj_r2 double"
    return s.spark.createDataFrame(out, columns).select("model", "term", *r6("coef", "se"), "n", *r6("r2", "adj_r2"))
