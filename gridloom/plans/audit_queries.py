"""Audits of a detector: controls it has never seen, and pairs before and after."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import draws
from ..operators import audit as U
from . import proxies as P
from .registry import query

r6 = lambda c: F.round(c, 6)
RESAMPLES, C, GAMMA = 100, 0.8, 0.4
BEGIN, END = "1993-04-01", "1998-03-01"

#: Customers as households, their years of orders as scored years.
_HOUSES = """WITH y AS MATERIALIZED (SELECT o_custkey AS gp_nr, CAST(year(o_orderdate) AS INTEGER) AS year, count(DISTINCT month(o_orderdate)) AS n_months, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders GROUP BY ALL),
l AS MATERIALIZED (SELECT c_custkey AS gp_nr, CAST(c_nationkey AS INTEGER) AS region, c_mktsegment IN ('BUILDING', 'FURNITURE') AS pos, c_mktsegment = 'MACHINERY' AS neg, c_nationkey % 3 <> 0 AS pv, c_acctbal > 0 AS meter, DATE '1993-01-01' + CAST(c_custkey % 1600 AS INTEGER) AS day FROM customer),
oof AS MATERIALIZED (SELECT y.gp_nr, y.year, (cents % 101) / 101 AS probability, CASE WHEN pos AND y.year > year(day) THEN 'P' ELSE 'U' END AS pu_label FROM y JOIN l ON y.gp_nr = l.gp_nr) """
#: Weighted rows e (b, s, p, n) to metrics by b.
_METRICS = """run AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY b ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS less, sum(p) OVER (PARTITION BY b ORDER BY s DESC) AS tp, sum(n) OVER (PARTITION BY b ORDER BY s DESC) AS fp FROM e),
m AS (SELECT b, (sum(p) FILTER (s >= 0.5) / sum(p) + sum(n) FILTER (s < 0.5) / sum(n)) / 2 AS balanced_accuracy, sum(p * (less + n / 2)) / (sum(p) * sum(n)) AS roc_auc, sum(CASE WHEN p > 0 THEN p * tp / (tp + fp) ELSE 0 END) / sum(p) AS average_precision
  FROM run GROUP BY b HAVING sum(p) > 0 AND sum(n) > 0)"""
_CONTROL = (
    _HOUSES
    + f""", s AS (SELECT gp_nr, year, n_months, least(1, 1 / (1 + exp(-(cents % 1009 / 500 - 1))) / {C}) AS q FROM y),
c AS MATERIALIZED (SELECT o.gp_nr, 1 AS label, arg_max(probability, o.year) AS probability FROM oof o JOIN l ON o.gp_nr = l.gp_nr WHERE pu_label = 'P' AND pos AND pv AND meter GROUP BY o.gp_nr
  UNION ALL SELECT s.gp_nr, 0, arg_max(1 / (1 + exp(-(ln(greatest(1e-6, least(1 - 1e-6, q)) / (1 - greatest(1e-6, least(1 - 1e-6, q)))) + {GAMMA}))), s.year) FROM s JOIN l ON s.gp_nr = l.gp_nr WHERE neg AND pv AND meter AND n_months >= 2 GROUP BY s.gp_nr)"""
)


def _years(spark, sf):
    o = P.load(spark, sf, "orders")
    return o.groupBy(F.col("o_custkey").alias("gp_nr"), F.year("o_orderdate").alias("year")).agg(F.count_distinct(F.month("o_orderdate")).alias("n_months"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


def _labels(spark, sf):
    c = P.load(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("gp_nr"), F.col("c_nationkey").cast("int").alias("region"), F.col("c_mktsegment").isin("BUILDING", "FURNITURE").alias("battery_positive"), (F.col("c_mktsegment") == "MACHINERY").alias("audit_negative"),
        (F.col("c_nationkey") % 3 != 0).alias("has_pv_row"), (F.col("c_acctbal") > 0).alias("has_meter"), F.date_add(F.lit("1993-01-01").cast("date"), (F.col("c_custkey") % 1600).cast("int")).alias("battery_commissioning_date"))


def _oof(spark, sf):
    rows = _years(spark, sf).join(_labels(spark, sf), "gp_nr")
    label = F.when(F.col("battery_positive") & (F.col("year") > F.year("battery_commissioning_date")), "P").otherwise("U")
    return rows.select("gp_nr", "year", ((F.col("cents") % 101) / 101).alias("probability"), label.alias("pu_label"))


def _control(spark, sf):
    score = 1 / (1 + F.exp(-(F.col("cents") % 1009 / 500 - 1)))
    return U.control_rows(_oof(spark, sf), _labels(spark, sf), _years(spark, sf), score, C, GAMMA, 2)


@query(_CONTROL + " SELECT gp_nr, label, round(probability, 6) AS probability FROM c")
def audit_controls(spark, sf):
    """Out-of-fold scores of positives, the final model's scores of negatives"""
    return _control(spark, sf).withColumn("probability", r6("probability"))


_WEIGHT = draws.sql_poisson("u")
_PAIR_COUNTS = ("n", "n_positives", "n_negatives", "tp", "fn", "fp", "tn")


@query(_CONTROL + f""", h AS (SELECT count(*) AS n, count(*) FILTER (label = 1) AS n_positives, count(*) FILTER (label = 0) AS n_negatives, count(*) FILTER (label = 1 AND probability >= 0.5) AS tp, count(*) FILTER (label = 1 AND probability < 0.5) AS fn,
  count(*) FILTER (label = 0 AND probability >= 0.5) AS fp, count(*) FILTER (label = 0 AND probability < 0.5) AS tn FROM c),
w AS (SELECT b, label, probability, {_WEIGHT} AS w FROM (SELECT *, {draws.SQL_UNIFORM.format("'0', CAST(gp_nr AS VARCHAR), CAST(b AS VARCHAR)")} AS u FROM c, range({RESAMPLES}) t(b))),
x AS (SELECT b, label, probability, w FROM w UNION ALL SELECT -1, label, probability, 1 FROM c),
e AS (SELECT b, probability AS s, CAST(coalesce(sum(w) FILTER (label = 1), 0) AS DOUBLE) AS p, CAST(coalesce(sum(w) FILTER (label = 0), 0) AS DOUBLE) AS n FROM x WHERE w > 0 GROUP BY ALL), {_METRICS},
i AS (SELECT {", ".join(f"round(quantile_cont({m}, {q}), 6) AS {m}_{k}" for m in U.METRICS for k, q in (("low", 0.025), ("high", 0.975)))}, count(*) AS resamples FROM m WHERE b >= 0)
SELECT {", ".join(f"h.{c}" for c in _PAIR_COUNTS)}, 0.5::DOUBLE AS threshold, round(tp / n_positives, 6) AS sensitivity, round(h.tn / n_negatives, 6) AS specificity, round((tp + h.tn) / h.n, 6) AS accuracy, round(greatest(n_positives, n_negatives) / h.n, 6) AS no_skill,
  printf('%.1f%% vs %.1f%% no-skill baseline', 100 * ((tp + h.tn) / h.n), 100 * (greatest(n_positives, n_negatives) / h.n)) AS accuracy_vs_baseline, CAST(NULL AS VARCHAR) AS error, round(balanced_accuracy, 6) AS balanced_accuracy, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision, i.*
FROM h, i, m WHERE m.b = -1""")  # fmt: skip
def audit_set_a(spark, sf):
    """Held-out controls with intervals"""
    out = U.audit_set_a(_control(spark, sf), resamples=RESAMPLES)
    return out.withColumns({c: r6(c) for c, t in out.dtypes if t == "double"})


_PAIRS = (
    _HOUSES
    + f""", k AS MATERIALIZED (SELECT l.gp_nr, region, a.p AS before, z.p AS after, z.p - a.p AS d FROM l
  JOIN (SELECT o.gp_nr, arg_max(probability, o.year) AS p FROM oof o JOIN l ON o.gp_nr = l.gp_nr WHERE o.year < year(day) GROUP BY ALL) a ON l.gp_nr = a.gp_nr
  JOIN (SELECT o.gp_nr, arg_min(probability, o.year) AS p FROM oof o JOIN l ON o.gp_nr = l.gp_nr WHERE o.year > year(day) GROUP BY ALL) z ON l.gp_nr = z.gp_nr WHERE pos AND day BETWEEN DATE '{BEGIN}' AND DATE '{END}') """
)
_WAYS = "list_reduce(list_prepend([1.0::DOUBLE], list_transform(range(1, least(n, 50) + 1), lambda k: [k::DOUBLE])), lambda a, k: list_transform(range(1, len(a) + k[1]::BIGINT + 1), lambda i: (CASE WHEN i <= len(a) THEN a[i] ELSE 0 END) + (CASE WHEN i > k[1] THEN a[i - k[1]::BIGINT] ELSE 0 END)))"
_ERF = "least(1, 2 / sqrt(pi()) * exp(-x * x) * list_reduce(list_prepend([x, x], list_transform(range(1, 161), lambda k: [k::DOUBLE, 0])), lambda a, e: [a[1] + a[2] * 2 * x * x / (2 * e[1] + 1), a[2] * 2 * x * x / (2 * e[1] + 1)])[1])"


def _set_b(key: str) -> str:
    by = f"{key}, " if key else ""
    part = f"PARTITION BY {key}" if key else ""
    on = f"s.{key} = t.{key}" if key else "true"
    group = f"GROUP BY {key}" if key else ""
    return f""", s AS (SELECT {by}count(*) AS n_pairs, avg(CASE WHEN d > 0 THEN 1.0 ELSE 0 END) AS win_rate, quantile_cont(d, 0.5) AS median_jump, avg(before) AS mean_before, avg(after) AS mean_after, count(*) FILTER (d = 0) AS zeros FROM k {group}),
q AS (SELECT {by}d, abs(d) AS m, rank() OVER ({part} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {by}abs(d)) - 1) / 2 AS r FROM k WHERE d <> 0),
g AS (SELECT {by}m, any_value(r) AS r, count(*) AS t, count(*) FILTER (d > 0) AS up FROM q GROUP BY {by}m),
t AS (SELECT {by}CAST(sum(t) AS BIGINT) AS n, sum(r * up) AS w_plus, sum(t * t * t - t)::DOUBLE AS ties FROM g {group}),
f AS (SELECT s.*, n, w_plus, n <= 50 AND ties = 0 AND zeros = 0 AS few, abs(w_plus - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24) / sqrt(2) AS x FROM s JOIN t ON {on}),
v AS (SELECT *, CASE WHEN few THEN {_WAYS} END AS ways FROM f),
z AS (SELECT *, CASE WHEN few THEN least(1, 2 * least(list_sum(ways[1:w_plus::BIGINT + 1]), list_sum(ways[w_plus::BIGINT + 1:])) / pow(2, n)) WHEN x >= 6 THEN 0 ELSE 1 - {_ERF} END AS p FROM v)
SELECT {by}n_pairs, CASE WHEN n_pairs >= 5 THEN round(win_rate, 6) END AS win_rate, CASE WHEN n_pairs >= 5 THEN round(median_jump, 6) END AS median_jump, CASE WHEN n_pairs >= 5 THEN round(mean_before, 6) END AS mean_before, CASE WHEN n_pairs >= 5 THEN round(mean_after, 6) END AS mean_after,
  CASE WHEN n_pairs >= 5 THEN w_plus END AS w_plus, CASE WHEN n_pairs >= 5 THEN CASE WHEN few THEN 'exact' ELSE 'normal' END END AS method, CASE WHEN n_pairs >= 5 THEN round(p, 6) END AS wilcoxon_p, CASE WHEN n_pairs < 5 THEN 'too few paired households' END AS note FROM z"""


def _pairs(spark, sf):
    return U.retrofit_pairs(_oof(spark, sf), _labels(spark, sf), BEGIN, END).join(_labels(spark, sf).select("gp_nr", "region"), "gp_nr")


def _rounded(out):
    return out.withColumns({c: r6(c) for c in ("win_rate", "median_jump", "mean_before", "mean_after", "wilcoxon_p")})


@query(_PAIRS + _set_b(""))
def audit_set_b(spark, sf):
    """The same household before and after, all together"""
    return _rounded(U.audit_set_b(_pairs(spark, sf)))


@query(_PAIRS + _set_b("region"))
def audit_set_b_regions(spark, sf):
    """The same, region by region: few pairs, whose signs are counted"""
    return _rounded(U.audit_set_b(_pairs(spark, sf), ["region"]))


@query(_HOUSES + f""", e AS (SELECT 0 AS b, probability AS s, CAST(count(*) FILTER (pu_label = 'P') AS DOUBLE) AS p, CAST(count(*) FILTER (pu_label = 'U') AS DOUBLE) AS n FROM oof GROUP BY probability), {_METRICS},
h AS (SELECT count(*) AS n_years, count(*) FILTER (pu_label = 'P') AS n_positive, count(*) FILTER (pu_label = 'U') AS n_unlabelled, {C}::DOUBLE AS c, round(avg(CASE WHEN probability >= 0.5 THEN 1.0 ELSE 0 END) FILTER (pu_label = 'P'), 6) AS recall, round(avg(CASE WHEN probability >= 0.5 THEN 1.0 ELSE 0 END) FILTER (pu_label = 'U'), 6) AS flag_rate FROM oof)
SELECT h.*, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision FROM h, m""")  # fmt: skip
def positive_unlabelled_audit(spark, sf):
    """Positive against unlabelled years"""
    out = U.positive_unlabelled_audit(_oof(spark, sf), C)
    return out.withColumns({c: r6(c) for c in ("recall", "flag_rate", "roc_auc", "average_precision")})
