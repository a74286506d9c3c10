"""Queries of the week operators and rule scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import weeks as K
from . import proxies as P
from .registry import query


@query(P.sql("r") + """, links AS (SELECT DISTINCT plz AS gp_nr, mp_id FROM r), m AS (SELECT gp_nr, count(*) AS n_meters FROM links GROUP BY ALL),
d AS (SELECT plz AS gp_nr, mp_id, date, round(sum(CASE WHEN register = 'import' THEN kwh ELSE -kwh END), 4) AS v FROM r GROUP BY ALL),
h AS (SELECT d.gp_nr, date, sum(v) AS v FROM d JOIN m ON d.gp_nr = m.gp_nr GROUP BY d.gp_nr, date HAVING count(*) = any_value(n_meters)),
w AS (SELECT DISTINCT gp_nr, CAST(date_trunc('week', date) AS DATE) AS week_start FROM d),
s AS (SELECT w.gp_nr, week_start, k, v FROM w CROSS JOIN range(0, 7) t(k) LEFT JOIN h ON h.gp_nr = w.gp_nr AND h.date = week_start + CAST(k AS INTEGER)),
a AS (SELECT gp_nr, week_start, list(v ORDER BY k) AS raw, count(v) AS observed FROM s GROUP BY ALL)
SELECT a.gp_nr, week_start, n_meters, CAST(observed AS INTEGER) AS observed, CASE WHEN 7 - observed > 2 THEN 'too_many_missing_timestamps' WHEN array_to_string(list_transform(raw, lambda x: CASE WHEN x IS NULL THEN '0' ELSE '1' END), '') LIKE '%00%' THEN 'missing_run_too_long' WHEN raw[1] IS NULL OR raw[7] IS NULL THEN 'leading_or_trailing_gap' END AS exclusion_reason
FROM a JOIN m ON a.gp_nr = m.gp_nr""")
def week_quality(spark, sf):
    """Weeks of days, for the readings are too sparse for weeks of quarter hours"""
    r = P.readings(spark, sf)
    links = r.select(F.col("plz").alias("gp_nr"), "mp_id").distinct()
    days = r.groupBy("mp_id", "date").agg(F.array(F.round(F.sum(F.when(F.col("register") == "import", F.col("kwh")).otherwise(-F.col("kwh"))), 4)).alias("q"))
    out = K.assemble_weeks(days, links, 1, 2, 1)
    return out.select("gp_nr", "week_start", "n_meters", "observed", "exclusion_reason")


_DAYS = P.sql("vec") + ", d AS (SELECT CAST(label AS VARCHAR) AS sample_id, DATE '2024-01-01' + CAST(CAST(mp_id AS BIGINT) % 360 AS INTEGER) AS date, q, list_transform(q, lambda x: greatest(-x, 0)) AS e, list_transform(q, lambda x: greatest(x, 0)) AS i FROM vec)"


def day_curves(spark, sf):
    v = P.profiles(spark, sf)
    return v.select(F.col("label").cast("string").alias("sample_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("mp_id").cast("bigint") % 360).cast("int")).alias("date"), F.col("q").alias("net"), F.transform("q", lambda x: F.greatest(x, F.lit(0.0))).alias("imp"))


@query(_DAYS + " SELECT sample_id, CAST(max(CASE WHEN list_max(e) > 0 THEN 1 ELSE 0 END) AS INTEGER) AS pv_export_any, round(avg(CASE WHEN list_max(e) > 0 THEN 1.0 ELSE 0 END), 6) AS pv_export_days_frac, round(avg(list_sum(e) / 4), 6) AS pv_export_kwh_d, round(avg(list_avg(i[41:60])) FILTER (month(date) BETWEEN 3 AND 10) / avg(list_avg(i[1:20])) FILTER (month(date) BETWEEN 3 AND 10), 6) AS pv_midday_night_ratio, count(*) FILTER (month(date) BETWEEN 3 AND 10) AS n_sun_days FROM d GROUP BY sample_id")
def pv_rule_scores(spark, sf):
    """V12"""
    out = K.pv_scores(day_curves(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("pv_export_days_frac", "pv_export_kwh_d", "pv_midday_night_ratio")})


@query(_DAYS + " SELECT sample_id, round(sum(list_sum(e[51:64])) FILTER (month(date) IN (3, 4, 9, 10)) / sum(list_sum(e)) FILTER (month(date) IN (3, 4, 9, 10)), 6) AS bat_pm_share_shoulder, round(sum(list_sum(e[51:64])) FILTER (month(date) BETWEEN 3 AND 10) / sum(list_sum(e)) FILTER (month(date) BETWEEN 3 AND 10), 6) AS bat_pm_share_sun, round(avg(list_avg(i[41:56])) FILTER (month(date) BETWEEN 3 AND 10) / avg(list_avg(i[1:20])) FILTER (month(date) BETWEEN 3 AND 10), 6) AS bat_eve_night FROM d GROUP BY sample_id")
def battery_rule_scores(spark, sf):
    """V13"""
    out = K.battery_scores(day_curves(spark, sf), evening=(40, 56))
    return out.select("sample_id", *[F.round(c, 6).alias(c) for c in out.columns if c != "sample_id"])


@query("WITH f AS (SELECT s_nationkey AS plz, s_acctbal > 4000 AS flag FROM supplier), g AS (SELECT c_nationkey AS plz, avg(c_acctbal) AS rate FROM customer GROUP BY ALL), s AS (SELECT f.plz, count(*) AS n, avg(CAST(flag AS DOUBLE)) AS share, any_value(rate) AS rate FROM f JOIN g ON f.plz = g.plz GROUP BY f.plz), x AS (SELECT t AS support, share, rate FROM s, (SELECT unnest([1, 3]) AS t) WHERE n >= t), k AS (SELECT support, rank() OVER (PARTITION BY support ORDER BY share) + (count(*) OVER (PARTITION BY support, share) - 1) / 2.0 AS a, rank() OVER (PARTITION BY support ORDER BY rate) + (count(*) OVER (PARTITION BY support, rate) - 1) / 2.0 AS b FROM x), v AS (SELECT support, count(*) AS n, CASE WHEN count(*) > 1 THEN round(corr(a, b), 6) END AS rho FROM k GROUP BY support) SELECT t AS support, coalesce(n, 0) AS n, rho FROM (SELECT unnest([1, 3]) AS t) LEFT JOIN v ON support = t")
def flag_rate_comparison(spark, sf):
    """A30, L20, P14"""
    f = P.load(spark, sf, "supplier").select(F.col("s_nationkey").alias("plz"), (F.col("s_acctbal") > 4000).alias("flag"))
    g = P.load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("plz")).agg(F.avg("c_acctbal").alias("rate"))
    return K.flag_rates(f, g, "plz", "flag", "rate", (1, 3)).select("support", "n", F.round("rho", 6).alias("rho"))


@query("SELECT o_custkey, count(*) FILTER (o_totalprice >= 300000) AS strong_weeks, CAST(sum(o_custkey % 3) AS BIGINT) AS events, count(*) FILTER (o_custkey % 3 > 0) AS weeks_with_events, max(o_totalprice) AS score_max FROM orders GROUP BY o_custkey")
def evidence_counts(spark, sf):
    """A39"""
    o = P.load(spark, sf, "orders").withColumn("e", F.col("o_custkey") % 3)
    return K.evidence_counts(o, "o_custkey", "e", "o_totalprice", 300000)


@query(P.sql("facts") + ", known AS (SELECT CAST(s_suppkey AS VARCHAR) AS mp_id FROM supplier WHERE s_acctbal > 0), s AS (SELECT DISTINCT strftime(make_date(year, month, 1), '%Y-%m') AS month, mp_id FROM facts) SELECT month, count(*) AS seen, count(k.mp_id) AS linked, (SELECT count(*) FROM known) - count(k.mp_id) AS missing FROM s LEFT JOIN known k ON s.mp_id = k.mp_id GROUP BY month")
def month_report(spark, sf):
    """A42, U03, U04"""
    from ..functions.text import month_key

    f = P.facts(spark, sf).withColumn("month", month_key(F.col("year"), F.col("month")))
    known = P.load(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("mp_id"))
    return K.month_report(f, known)


@query(P.sql("facts") + "SELECT year AS month, count(*) AS n, CAST(sum(CASE WHEN kwh > 300 THEN 1 ELSE 0 END) AS BIGINT) AS candidates, round(avg(CASE WHEN n_days / 100.0 <= 0.0625 THEN 1.0 ELSE 0 END), 6) AS quiet FROM facts GROUP BY year")
def sweep_summary(spark, sf):
    """A49"""
    f = P.facts(spark, sf).select(F.col("year").alias("month"), (F.col("kwh") > 300).alias("c"), (F.col("n_days") / 100).alias("noise"))
    return K.sweep_summary(f, "month", "c", "noise").withColumn("quiet", F.round("quiet", 6))


@query(P.sql("vec") + "SELECT mp_id, round(CASE WHEN list_sum(q[1:20]) <> 0 THEN list_sum(q) / list_sum(q[1:20]) END, 3) AS ratio FROM vec")
def winter_over_night(spark, sf):
    """V16"""
    v = P.profiles(spark, sf)
    return v.select("mp_id", F.round(K.winter_over_night(V.total(F.col("q")), V.total(V.part(F.col("q"), 0, 20))), 3).alias("ratio"))


@query(P.STEPS + """, n AS (SELECT f.*, label FROM found f JOIN vec ON f.mp_id = vec.mp_id WHERE start >= 40 OR start < 12), d AS (SELECT label, count(*) AS days FROM vec GROUP BY label),
e AS (SELECT label, count(DISTINCT start // 96) AS nights, quantile_cont(length, 0.5) / 4 AS hours, CASE WHEN count(*) >= 3 AND avg(length * excess / 4) > 0 THEN stddev_pop(length * excess / 4) / avg(length * excess / 4) END AS cv FROM n GROUP BY label)
SELECT CAST(d.label AS VARCHAR) AS sample_id, round(100 * coalesce(nights, 0) / days::DOUBLE, 6) AS ev_mode2_nights100, round(coalesce(hours, 0), 6) AS ev_mode2_med_hours, round(cv, 6) AS ev_mode2_energy_cv FROM d LEFT JOIN e ON d.label = e.label""")
def night_plateaus(spark, sf):
    """From the sequential detector's events"""
    from ..operators.events import sequential_events

    v = P.profiles(spark, sf).select(F.col("label").cast("string").alias("sample_id"), "q")
    e = sequential_events(v, ["sample_id"], "q", 0.1, 0.6, 2)
    out = K.night_plateau_scores(e, v.groupBy("sample_id").agg(F.count("*").alias("n_days")), window=(40, 64, 0, 12))
    return out.select("sample_id", *[F.round(c, 6).alias(c) for c in out.columns if c != "sample_id"])


_CHARGERS = (("a", 0.1, 0.2, 3, 5), ("b", 0.2, 0.35, 2, 3), ("c", 0.35, float("inf"), 2, 4))
_RATES = ", ".join(f"round(100 * count(*) FILTER (band = '{n}' AND length >= {x}) / any_value(n_days)::DOUBLE, 6) AS ev_{n}_{tag}_rate100" for n, _, _, *least in _CHARGERS for tag, x in zip(("spec", "tuned"), least))
_ANY = lambda k, names: " OR ".join(f"band = '{c[0]}' AND length >= {c[k]}" for c in _CHARGERS if c[0] in names)


@query("WITH RECURSIVE i AS (SELECT CAST(vec_id // 4 AS VARCHAR) AS mp_id, vec_id % 4 AS d, list_transform(embedding, lambda x: greatest(CAST(x AS DOUBLE), 0)) AS imp FROM embeddings WHERE vec_id % 13 <> 0), "
       "f AS (SELECT mp_id, list_max(list_transform(list_zip(imp[2:], imp[1:63]), lambda z: z[1] - z[2])) AS rise FROM i), day AS (SELECT mp_id, count(*) AS n_days, round(max(rise), 6) AS ev_ramp_max, round(100 * avg(CASE WHEN rise >= 0.3 THEN 1.0 ELSE 0 END), 6) AS ev_ramp_days100, round(100 * avg(CASE WHEN rise >= 0.2 THEN 1.0 ELSE 0 END), 6) AS ev_ramp_spec_days100 FROM f GROUP BY mp_id), "
       "ser AS MATERIALIZED (SELECT mp_id, flatten(list(imp ORDER BY d)) AS q FROM i GROUP BY mp_id), " + ", ".join(P.steps(f"e_{n}", "ser", low, high, 2) for n, low, high, _, _ in _CHARGERS)
       + ", e AS (" + " UNION ALL ".join(f"SELECT '{c[0]}' AS band, * FROM e_{c[0]}" for c in _CHARGERS) + f") SELECT day.mp_id AS sample_id, any_value(n_days) AS n_days, any_value(ev_ramp_max) AS ev_ramp_max, any_value(ev_ramp_days100) AS ev_ramp_days100, any_value(ev_ramp_spec_days100) AS ev_ramp_spec_days100, {_RATES}, "
       f"round(100 * count(*) FILTER ({_ANY(3, 'abc')}) / any_value(n_days)::DOUBLE, 6) AS ev_spec_rate100, round(100 * count(*) FILTER ({_ANY(4, 'bc')}) / any_value(n_days)::DOUBLE, 6) AS ev_tuned_rate100, round(count(DISTINCT start // 64) FILTER ({_ANY(3, 'abc')}) / any_value(n_days)::DOUBLE, 6) AS ev_spec_daysfrac FROM day LEFT JOIN e ON day.mp_id = e.mp_id GROUP BY day.mp_id")  # fmt: skip
def charger_scores(spark, sf):
    """Ramps and the runs of each class of chargers, over days that are whole"""
    e = P.load(spark, sf, "embeddings")
    net = F.transform("embedding", lambda x, i: F.when((F.col("vec_id") % 13 != 0) | (i != 5), x.cast("double")))
    days = e.select((F.col("vec_id") / 4).cast("bigint").cast("string").alias("sample_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("vec_id") % 4).cast("int")).alias("date"), net.alias("net"))
    out = K.charger_scores(days, classes=_CHARGERS, untuned="a", ramp_kw=0.3, spec_kw=0.2, slots=64)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c not in ("sample_id", "n_days")})
