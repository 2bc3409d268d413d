"""Common tables of the checking SQL, in DuckDB's dialect."""

from __future__ import annotations

import re

PANEL = """
li AS (
  SELECT l_orderkey, avg(l_discount) AS need, avg(l_extendedprice) AS wealth, avg(l_tax) AS gov,
         sum(l_quantity) AS qty, avg(l_quantity) AS qavg
  FROM lineitem GROUP BY l_orderkey),
o AS (
  SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS period
  FROM orders),
lvl AS (
  SELECT o_custkey, period, o_orderpriority AS p, count(*) AS c, max(o_orderkey) AS last
  FROM o GROUP BY o_custkey, period, o_orderpriority),
tier_of AS (
  SELECT o_custkey, period,
         CASE p WHEN '1-URGENT' THEN 'H' WHEN '2-HIGH' THEN 'UM' WHEN '3-MEDIUM' THEN 'LM'
                WHEN '4-NOT SPECIFIED' THEN 'L' END AS tier
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, period ORDER BY c DESC, last DESC) AS rn FROM lvl) x
  WHERE rn = 1),
cells AS (
  SELECT o.o_custkey AS unit, o.period, count(*) AS n_orders, sum(o.o_totalprice) / 1000 AS outcome,
         avg(li.need) AS need, avg(li.wealth) AS wealth, avg(li.gov) AS gov, sum(li.qty) AS size, avg(li.qavg) AS qavg
  FROM o LEFT JOIN li ON o.o_orderkey = li.l_orderkey GROUP BY o.o_custkey, o.period),
panel AS (
  SELECT a.unit, c.c_name AS unit_name, a.period, a.n_orders, a.outcome, a.need,
         50 - 200 * a.need + a.qavg AS composite, a.wealth, a.gov, a.size, t.tier, r.r_name AS region,
         CASE WHEN c.c_nationkey % 4 = 0 THEN 1 ELSE 0 END AS flag_a,
         CASE WHEN c.c_nationkey % 4 = 1 THEN 1 ELSE 0 END AS flag_b
  FROM cells a
  JOIN customer c ON c.c_custkey = a.unit
  JOIN nation n ON n.n_nationkey = c.c_nationkey
  JOIN region r ON r.r_regionkey = n.n_regionkey
  LEFT JOIN tier_of t ON t.o_custkey = a.unit AND t.period = a.period)"""

MODEL = """
complete AS (
  SELECT * FROM panel
  WHERE outcome IS NOT NULL AND need IS NOT NULL AND wealth IS NOT NULL AND gov IS NOT NULL AND size IS NOT NULL),
filled AS (
  SELECT * REPLACE (coalesce(
    first_value(tier IGNORE NULLS) OVER (PARTITION BY unit ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
    last_value(tier IGNORE NULLS) OVER (PARTITION BY unit ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS tier)
  FROM complete),
model AS (
  SELECT *, ln(1 + outcome) AS log_outcome, ln(wealth) AS log_wealth, ln(size) AS log_size
  FROM filled WHERE tier IS NOT NULL)"""

NUMERICS = ("need", "log_wealth", "gov", "log_size", "flag_a", "flag_b")
TIERS = ("H", "LM", "UM")
PERIODS = (1996, 1997, 1998, 1999, 2000, 2001)


def terms(numerics=NUMERICS, tiers=TIERS, periods=PERIODS) -> list[str]:
    return ["Intercept", *numerics, *[f"tier[{t}]" for t in tiers], *[f"period[{p}]" for p in periods]]


def design_list(numerics=NUMERICS, tiers=TIERS, periods=PERIODS) -> str:
    parts = ["1.0::DOUBLE", *[f"({n})::DOUBLE" for n in numerics]]
    parts += [f"(tier = '{t}')::INT::DOUBLE" for t in tiers]
    parts += [f"(period = {p})::INT::DOUBLE" for p in periods]
    return "[" + ", ".join(parts) + "]"


def ols(p: str, source: str, x: str, k: int, group: str = "0", cov: bool = True) -> str:
    """Least squares per ``g``: Gauss-Jordan on [X'X | I | X'y], then the sandwich by unit.

    Tables: {p}_b(g, n, b, inv), {p}_fit(g, r2), {p}_cov(g, i, j, v), {p}_coef(g, i, coef, se).
    """
    text = f"""
{p}_d AS (SELECT {group} AS g, unit, period, log_outcome AS y, {x} AS x FROM {source}),
{p}_xx AS (
  SELECT g, i, j, sum(x[i] * x[j]) AS v
  FROM {p}_d, generate_series(1, {k}) a(i), generate_series(1, {k}) b(j) GROUP BY g, i, j),
{p}_xy AS (SELECT g, i, sum(x[i] * y) AS v, count(*) AS n FROM {p}_d, generate_series(1, {k}) a(i) GROUP BY g, i),
{p}_row AS (SELECT g, i, list(v ORDER BY j) AS r FROM {p}_xx GROUP BY g, i),
{p}_gj(g, step, n, m) AS (
  SELECT q.g, 0, max(s.n),
         list(list_concat(list_concat(q.r, list_transform(range(1, {k + 1}), lambda c: (c = q.i)::INT::DOUBLE)), [s.v]) ORDER BY q.i)
  FROM {p}_row q JOIN {p}_xy s ON s.g = q.g AND s.i = q.i GROUP BY q.g
  UNION ALL
  SELECT g, step + 1, n, list_transform(m, lambda r, i:
    CASE WHEN i = step + 1 THEN list_transform(r, lambda v: v / r[step + 1])
         ELSE list_transform(r, lambda v, j: v - r[step + 1] * m[step + 1][j] / m[step + 1][step + 1]) END)
  FROM {p}_gj WHERE step < {k}),
{p}_b AS (
  SELECT g, n, list_transform(m, lambda r: r[{2 * k + 1}]) AS b,
         list_transform(m, lambda r: r[{k + 1}:{2 * k}]) AS inv
  FROM {p}_gj WHERE step = {k}),
{p}_e AS (SELECT d.*, d.y - list_dot_product(d.x, q.b) AS e FROM {p}_d d JOIN {p}_b q ON q.g = d.g),
{p}_fit AS (
  SELECT e.g, count(*) AS n, 1 - sum(e.e * e.e) / (var_pop(e.y) * count(*)) AS r2,
         1 - (sum(e.e * e.e) / (var_pop(e.y) * count(*))) * (count(*) - 1) / (count(*) - {k}) AS adj_r2
  FROM {p}_e e GROUP BY e.g)"""
    if cov:
        text += f""",
{p}_s AS (SELECT g, unit, i, sum(x[i] * e) AS u FROM {p}_e, generate_series(1, {k}) a(i) GROUP BY g, unit, i),
{p}_meat AS (
  SELECT a.g, a.i, b.i AS j, sum(a.u * b.u) AS v, count(*) AS ng
  FROM {p}_s a JOIN {p}_s b ON a.g = b.g AND a.unit = b.unit GROUP BY a.g, a.i, b.i),
{p}_bm AS (
  SELECT q.g, r.i, m.j, sum(q.inv[r.i][m.i] * m.v) AS v, max(m.ng) AS ng, max(q.n) AS n
  FROM {p}_b q JOIN {p}_meat m ON m.g = q.g, generate_series(1, {k}) r(i) GROUP BY q.g, r.i, m.j),
{p}_cov AS (
  SELECT q.g, t.i, c.j, sum(t.v * q.inv[t.j][c.j]) * (max(t.ng) * 1.0 / (max(t.ng) - 1)) * ((max(t.n) - 1) * 1.0 / (max(t.n) - {k})) AS v
  FROM {p}_bm t JOIN {p}_b q ON q.g = t.g, generate_series(1, {k}) c(j) GROUP BY q.g, t.i, c.j),
{p}_coef AS (SELECT q.g, v.i, q.b[v.i] AS coef, sqrt(v.v) AS se FROM {p}_b q JOIN {p}_cov v ON v.g = q.g AND v.i = v.j)"""
    return text


SCORED = (
    ols("fe", "model", design_list(), 16)
    + """,
scored AS (
  SELECT m.*, f.y - f.e AS predicted, f.e AS score
  FROM model m JOIN fe_e f ON f.unit = m.unit AND f.period = m.period)"""
)

UNITS = """
unit_base AS (
  SELECT unit, any_value(unit_name) AS unit_name, any_value(region) AS region, CAST(count(*) AS INTEGER) AS n_periods,
         avg(score) AS score_mean, stddev_samp(score) AS score_std, avg(need) AS need_mean, avg(outcome) AS outcome_mean,
         avg(wealth) AS wealth_mean, avg(gov) AS gov_mean,
         avg(CASE WHEN need <> 0 THEN outcome / need END) AS ratio_mean, arg_max(tier, period) AS tier_recent
  FROM scored GROUP BY unit),
unit_mode AS (
  SELECT unit, tier FROM (
    SELECT *, row_number() OVER (PARTITION BY unit ORDER BY c DESC, last DESC) AS rn
    FROM (SELECT unit, tier, count(*) AS c, max(period) AS last FROM scored GROUP BY unit, tier) a) b
  WHERE rn = 1),
unit_rank AS (
  SELECT b.*, m.tier,
         CAST(rank() OVER (PARTITION BY m.tier ORDER BY score_mean) AS INTEGER) AS tier_rank,
         CAST(count(*) OVER (PARTITION BY m.tier) AS INTEGER) AS tier_n,
         count(*) OVER (PARTITION BY m.tier, score_mean) AS ties
  FROM unit_base b JOIN unit_mode m ON m.unit = b.unit),
edges AS (
  SELECT quantile_cont(score_mean, 0.25) AS q1, quantile_cont(score_mean, 0.5) AS q2, quantile_cont(score_mean, 0.75) AS q3
  FROM unit_base),
units AS (
  SELECT u.* EXCLUDE (ties), round((tier_rank + (ties - 1) / 2.0) / tier_n, 3) AS tier_pct, n_periods < 5 AS thin_data,
         CASE WHEN score_mean <= q1 THEN 'Chronically Underfunded' WHEN score_mean <= q2 THEN 'Underfunded'
              WHEN score_mean <= q3 THEN 'Adequately Funded' ELSE 'Over-Resourced' END AS profile
  FROM unit_rank u, edges)"""


def p_value(r2: str, n: str) -> str:
    """Closed forms of Student's t for 1 to 8 degrees of freedom; s = |r|, c² = 1 − r²."""
    s, c2 = f"sqrt({r2})", f"(1 - {r2})"
    a = f"asin(least({s}, 1.0))"
    c = f"sqrt(greatest({c2}, 0.0))"
    forms = [
        f"2 / pi() * {a}",
        s,
        f"2 / pi() * ({a} + {s} * {c})",
        f"{s} * (1 + {c2} / 2)",
        f"2 / pi() * ({a} + {s} * ({c} + 2.0 / 3 * {c} * {c2}))",
        f"{s} * (1 + {c2} / 2 + 3.0 / 8 * {c2} * {c2})",
        f"2 / pi() * ({a} + {s} * ({c} + 2.0 / 3 * {c} * {c2} + 8.0 / 15 * {c} * {c2} * {c2}))",
        f"{s} * (1 + {c2} / 2 + 3.0 / 8 * {c2} * {c2} + 15.0 / 48 * {c2} * {c2} * {c2})",
    ]
    cases = " ".join(f"WHEN {n} - 2 = {i} THEN greatest(1 - ({f}), 0.0)" for i, f in enumerate(forms, 1))
    return f"CASE WHEN {r2} IS NULL THEN NULL {cases} END"


PROJECTION = f"""
fits AS (
  SELECT unit, count(*) AS n, CAST(count(DISTINCT period) AS INTEGER) AS n_periods,
         regr_slope(ln(1 + outcome), period - 2001) AS slope,
         regr_intercept(ln(1 + outcome), period - 2001) - regr_slope(ln(1 + outcome), period - 2001) * 2001 AS intercept,
         CASE WHEN min(outcome) <> max(outcome) AND count(*) > 1 THEN regr_r2(ln(1 + outcome), period - 2001) END AS r2
  FROM panel WHERE outcome IS NOT NULL GROUP BY unit),
proj_base AS (
  SELECT f.*, u.unit_name, u.region, u.profile, u.tier, {p_value("f.r2", "f.n")} AS p,
         exp(intercept + slope * 2001) - 1 AS fit_base, exp(intercept + slope * 2008) - 1 AS fit_horizon,
         (exp(slope) - 1) * 100 AS annual_pct
  FROM fits f JOIN units u ON u.unit = f.unit WHERE f.n_periods >= 5),
projection AS (
  SELECT *, (fit_horizon / nullif(fit_base, 0) - 1) * 100 AS pct_change, coalesce(p < 0.05, false) AS trend_significant,
         CASE WHEN annual_pct > 1 THEN 'Rising' WHEN annual_pct < -1 THEN 'Falling' ELSE 'Flat' END AS direction
  FROM proj_base)"""

REGIONAL = f"""
series AS (SELECT region, period, avg(score) AS gap FROM scored GROUP BY region, period),
reg_fit AS (
  SELECT region, count(*) AS n, regr_slope(gap, period - 2001) AS slope,
         regr_intercept(gap, period - 2001) AS gap_base, regr_r2(gap, period - 2001) AS r2
  FROM series GROUP BY region),
regional AS (
  SELECT region, n, slope, gap_base - slope * 2001 AS intercept, r2, {p_value("r2", "n")} AS p, gap_base, gap_base + 7 * slope AS gap_horizon,
         CASE WHEN gap_base * slope < 0 THEN 'closing' WHEN gap_base * slope > 0 THEN 'widening' ELSE 'flat' END AS status
  FROM reg_fit)"""

CHAIN = {
    "": [],
    "panel": [PANEL],
    "model": [PANEL, MODEL],
    "scored": [PANEL, MODEL, SCORED],
    "units": [PANEL, MODEL, SCORED, UNITS],
    "projection": [PANEL, MODEL, SCORED, UNITS, PROJECTION],
    "regional": [PANEL, MODEL, SCORED, REGIONAL],
    "all": [PANEL, MODEL, SCORED, UNITS, PROJECTION, REGIONAL],
}


def compose(uses: str, select: str) -> str:
    """Full statement; a ``select`` starting with WITH adds tables of its own."""
    parts = list(CHAIN[uses])
    # Adding zero turns a rounded negative zero into zero.
    body = re.sub(r"\bround\(", "0.0 + round(", select.strip())
    if body.upper().startswith("WITH "):
        own, body = split_with(body)
        parts.append(own)
    if not parts:
        return body
    return "WITH RECURSIVE " + ",".join(parts) + "\n" + body


def split_with(body: str) -> tuple[str, str]:
    own, marker, rest = body[5:].partition("\nFINAL ")
    if not marker:
        raise ValueError("own tables must be followed by a line starting with FINAL")
    return "\n" + own.rstrip().rstrip(","), rest


def text2(x: str, digits: int = 2) -> str:
    """Fixed-point text with half-way values moved away from zero."""
    return f"printf('%.{digits}f', round({x}, 8) + sign({x}) * 1e-9)"


def signed2(x: str, digits: int = 2) -> str:
    return f"printf('%+.{digits}f', round({x}, 8) + sign({x}) * 1e-9)"
