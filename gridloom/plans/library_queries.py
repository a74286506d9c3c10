"""Queries that reach what the others leave out: day features, guards, look-ups, splits, sources, sinks and streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import numbers as N
from ..functions import text as T
from ..functions import vectors as V
from ..operators import aggregates as A
from ..operators import events as E
from ..operators import labels as L
from ..operators import models as M
from ..operators import relational as R
from ..operators import stats as S
from ..operators import windows as W
from ..session import scratch
from ..sources import exports, sinks
from ..streaming import pairing
from . import proxies as P
from .registry import query

r4 = lambda c: F.round(c, 4)
r6 = lambda c: F.round(c, 6)

# -- day features ---------------------------------------------------------------
_DAY = P.sql("r") + ", q AS (SELECT mp_id, plz, date, slot, sum(kwh) AS v FROM r WHERE register = '{reg}' GROUP BY ALL)"
_BAND = "coalesce(sum(v) FILTER (slot // 4 >= {0} AND slot // 4 < {1}), 0)"
_V07 = _DAY.format(reg="import") + f""", b AS (SELECT mp_id, plz, date, sum(v) AS day, {_BAND.format(11, 15)} AS mid, {_BAND.format(18, 22)} AS eve, {_BAND.format(0, 5)} AS dark, {_BAND.format(9, 17)} AS solar,
  count(*) FILTER (v < 0.01 AND slot // 4 >= 9 AND slot // 4 < 17) / 32.0 AS zero, min(v) FILTER (slot // 4 >= 9 AND slot // 4 < 17) AS low FROM q GROUP BY ALL),
days AS (SELECT mp_id, plz, date, isodow(date) >= 6 AS is_weekend, day AS day_kwh, CASE WHEN day / 24 > 1e-6 THEN mid / 4 / (day / 24) END AS midday_ratio, CASE WHEN mid / 4 > 1e-6 THEN eve / 4 / (mid / 4) END AS evening_midday_ratio,
  dark AS night_kwh, solar AS solar_kwh, zero AS frac_daytime_zero, CASE WHEN low < dark / 5 / 4 THEN 1.0 ELSE 0 END AS below_night FROM b)"""
_DAY_COLUMNS = ("day_kwh", "midday_ratio", "evening_midday_ratio", "night_kwh", "solar_kwh", "frac_daytime_zero", "below_night")


def day_curves(spark, sf, register, *keys):
    """(mp_id, *keys, date, q): 96 slots, missing ones null"""
    r = P.readings(spark, sf).where(F.col("register") == register).groupBy("mp_id", *keys, "date", "slot").agg(F.sum("kwh").alias("v"))
    days = r.groupBy("mp_id", *keys, "date").agg(F.map_from_entries(F.collect_list(F.struct("slot", "v"))).alias("m"))
    return days.select("mp_id", *keys, "date", F.transform(F.sequence(F.lit(0), F.lit(95)), lambda k: F.try_element_at("m", k)).alias("q"))


@query(_V07 + " SELECT mp_id, plz, date, is_weekend, " + ", ".join(f"round({c}, 4) AS {c}" for c in _DAY_COLUMNS) + " FROM days")
def day_features(spark, sf):
    """V07"""
    out = A.day_features(day_curves(spark, sf, "import", "plz"))
    return out.select("mp_id", "plz", "date", "is_weekend", *[r4(c).alias(c) for c in _DAY_COLUMNS])


_SHIFT = 10227  # days from 1996 to 2024: the orders' weather on the readings' dates
_MONTH = {"n_days": "CAST(count(DISTINCT d.date) AS INTEGER)", "day_kwh_mean": "avg(day_kwh)", "day_kwh_p10": "quantile_cont(day_kwh, 0.1)", "day_kwh_p50": "quantile_cont(day_kwh, 0.5)", "day_kwh_p90": "quantile_cont(day_kwh, 0.9)", "midday_ratio_mean": "avg(midday_ratio)",
          "midday_ratio_std": "stddev_samp(midday_ratio)", "midday_ratio_clear": "avg(midday_ratio) FILTER (is_clear)", "evening_midday_ratio_mean": "avg(evening_midday_ratio)", "night_kwh_mean": "avg(night_kwh)", "frac_daytime_zero_mean": "avg(frac_daytime_zero)", "below_night_frac": "avg(below_night)",
          "day_kwh_weekday": "avg(day_kwh) FILTER (NOT is_weekend)", "day_kwh_weekend": "avg(day_kwh) FILTER (is_weekend)", "irr_n": "count(y)", "irr_sx": "sum(x)", "irr_sy": "sum(y)", "irr_sxy": "sum(x * y)", "irr_sxx": "sum(x * x)", "irr_syy": "sum(y * y)"}


@query(_V07 + f""", o AS (SELECT CAST(o_orderdate AS DATE) + {_SHIFT} AS date, avg(o_totalprice) AS radiation FROM orders GROUP BY ALL), lim AS (SELECT month(date) AS m, quantile_cont(radiation, 0.75) AS q, quantile_cont(radiation, 0.95) AS top FROM o GROUP BY ALL),
sky AS (SELECT date, radiation >= q AS is_clear, least(1.5, greatest(0, radiation / top)) AS clearness FROM o JOIN lim ON month(date) = m), d AS (SELECT days.*, is_clear, CASE WHEN midday_ratio IS NOT NULL THEN clearness END AS x, CASE WHEN clearness IS NOT NULL THEN midday_ratio END AS y FROM days LEFT JOIN sky ON days.date = sky.date)
SELECT mp_id, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, min(plz) AS plz, """ + ", ".join(f"round({e}, 6) AS {n}" if n not in ("n_days", "irr_n") else f"{e} AS {n}" for n, e in _MONTH.items()) + " FROM d GROUP BY ALL")
def month_features(spark, sf):
    """Day features of a month, with the clearness sums"""
    sky = W.clear_days(P.weather(spark, sf).withColumn("date", F.date_add("date", _SHIFT)))
    out = A.monthly_features(A.day_features(day_curves(spark, sf, "import", "plz")), sky)
    return out.select("mp_id", "year", "month", "plz", *[(F.col(c) if c in ("n_days", "irr_n") else r6(c)).alias(c) for c in _MONTH])


_EXPORT = P.sql("vec") + ", days AS (SELECT CAST(label AS VARCHAR) AS mp_id, DATE '2024-01-01' + CAST(CAST(mp_id AS BIGINT) % 700 AS INTEGER) AS date, mp_id AS id, list_transform(q, lambda x: greatest(x, 0)) AS q FROM vec), e AS (SELECT mp_id, id, date, list_sum(q) AS kwh, list_sum(q[41:60]) AS mid, CASE WHEN list_sum(q) > 1e-6 THEN CAST(list_position(q, list_max(q)) - 1 AS INTEGER) END AS peak FROM days)"


def export_days(spark, sf):
    v = P.profiles(spark, sf)
    date = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("mp_id").cast("bigint") % 700).cast("int"))
    days = v.select(F.col("label").cast("string").alias("mp_id"), date.alias("date"), F.transform("q", lambda x: F.greatest(x, F.lit(0.0))).alias("q"))
    return A.export_day_features(days)


@query(_EXPORT + " SELECT mp_id, date, round(kwh, 4) AS exp_day_kwh, round(mid, 4) AS exp_midday_kwh, peak AS peak_slot FROM e")
def export_day_features(spark, sf):
    """V08"""
    return export_days(spark, sf).select("mp_id", "date", r4("exp_day_kwh").alias("exp_day_kwh"), r4("exp_midday_kwh").alias("exp_midday_kwh"), "peak_slot")


@query(_EXPORT + """, m AS (SELECT mp_id, year(date) AS y, month(date) AS mo, count(DISTINCT date) AS days, count(DISTINCT date) FILTER (kwh > 0) AS ed, sum(kwh) AS kwh, quantile_cont(peak, 0.5) AS peak, count(*) FILTER (mid > 0) AS md FROM e GROUP BY ALL),
y AS (SELECT mp_id, y, sum(CASE WHEN mo BETWEEN 5 AND 8 THEN md ELSE 0 END) AS md FROM m GROUP BY ALL), b AS (SELECT mp_id, CAST(arg_max(y, (md, -y)) AS INTEGER) AS best_summer FROM y GROUP BY mp_id)
SELECT m.mp_id, CAST(sum(days) AS BIGINT) AS days, CAST(sum(ed) AS BIGINT) AS export_days, round(sum(kwh), 4) AS export_kwh, round(quantile_cont(peak, 0.5), 4) AS peak_slot, any_value(best_summer) AS best_summer FROM m JOIN b ON m.mp_id = b.mp_id GROUP BY m.mp_id""")
def export_summary(spark, sf):
    """A12, A13, A51"""
    return A.export_summary(export_days(spark, sf)).withColumns({"export_kwh": r4("export_kwh"), "peak_slot": r4("peak_slot")})


@query(P.sql("vec") + "SELECT CAST(label AS VARCHAR) AS sample_id, round(max(r), 4) AS max_ramp, round(100 * avg(CASE WHEN r >= 1.5 THEN 1.0 ELSE 0 END), 4) AS ramp_days_per_100 FROM (SELECT label, list_max(list_transform(list_zip(q[2:64], q[1:63]), lambda p: (p[1] - p[2]) * 4)) AS r FROM vec) GROUP BY label")
def ramp_scores(spark, sf):
    """V14"""
    v = P.profiles(spark, sf).select(F.col("label").cast("string").alias("sample_id"), "q")
    return E.ramp_scores(v, ["sample_id"], "q", 1.5).withColumns({c: r4(c) for c in ("max_ramp", "ramp_days_per_100")})


@query(P.sql("vec") + ", s AS (SELECT mp_id, i, abs(q[i + 1] - q[i]) <= 0.1 AS f FROM vec, range(1, 64) t(i)), g AS (SELECT mp_id, i - row_number() OVER (PARTITION BY mp_id ORDER BY i) AS g FROM s WHERE f), l AS (SELECT mp_id, g, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 3) SELECT v.mp_id, round(coalesce(sum(n + 1), 0) / 64.0, 4) AS stable FROM vec v LEFT JOIN l ON v.mp_id = l.mp_id GROUP BY v.mp_id")
def stable_share(spark, sf):
    """W21"""
    return P.profiles(spark, sf).select("mp_id", r4(E.stable_share(F.col("q"), 0.1, 4)).alias("stable"))


@query(P.sql("vec") + ", c AS (SELECT mp_id, list_transform(q, lambda x: abs(x)) AS q FROM vec), r AS (SELECT mp_id, list_transform(range(0, 16), lambda i: q[CAST(floor(i * 63 / 15.0) AS BIGINT) + 1] + (q[least(CAST(floor(i * 63 / 15.0) AS BIGINT) + 2, 64)] - q[CAST(floor(i * 63 / 15.0) AS BIGINT) + 1]) * (i * 63 / 15.0 - floor(i * 63 / 15.0))) AS v, list_sum(q) AS total FROM c) SELECT mp_id, CAST(i - 1 AS INTEGER) AS slot, round(v[i] * total / list_sum(v), 4) AS v FROM r, range(1, 17) t(i)")
def stretched_shape(spark, sf):
    """M09"""
    out = P.profiles(spark, sf).select("mp_id", F.posexplode(V.resample(F.transform("q", lambda x: F.abs(x)), 16)).alias("slot", "v"))
    return out.select("mp_id", "slot", r4("v").alias("v"))


@query(P.sql("vec") + """, m AS (SELECT mp_id, q, list_aggregate(q[17:32], 'quantile_cont', 0.5) AS m FROM vec), x AS (SELECT mp_id, i - 1 AS k, q[i] >= m / 2 AS f FROM m, range(1, 65) t(i)), g AS (SELECT mp_id, k, k - row_number() OVER (PARTITION BY mp_id ORDER BY k) AS g FROM x WHERE f),
runs AS (SELECT mp_id, min(k) AS start, count(*) AS length FROM g GROUP BY mp_id, g), o AS (SELECT *, least(start + length, 32) - greatest(start, 16) AS overlap FROM runs)
SELECT mp_id, CAST(arg_max(start, (overlap, -start)) AS INTEGER) AS start, CAST(arg_max(length, (overlap, -start)) AS INTEGER) AS length FROM o WHERE overlap > 0 GROUP BY mp_id""")
def donor_events(spark, sf):
    """E08"""
    out = P.profiles(spark, sf).select("mp_id", E.donor_event(F.col("q"), 20, 8).alias("e")).where("e is not null")
    return out.select("mp_id", "e.start", "e.length")


@query("SELECT c_custkey, round(0.35 * c_acctbal / 10000 + 0.45 * c_nationkey / 25.0 + 0.2 * (c_custkey % 7) / 7.0, 10) AS score FROM customer")
def weighted_scores(spark, sf):
    """E13"""
    return P.load(spark, sf, "customer").select("c_custkey", F.round(E.weighted_score(F.col("c_acctbal") / 10000, F.col("c_nationkey") / 25, (F.col("c_custkey") % 7) / 7), 10).alias("score"))


# -- joins, guards, aggregates -----------------------------------------------------
@query("""WITH h AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS gp_nr, o_orderkey AS zpb FROM orders), m AS (SELECT DISTINCT l_orderkey AS zpb, CAST(l_suppkey AS VARCHAR) AS mp_id FROM lineitem),
l AS (SELECT h.gp_nr, h.zpb, m.mp_id FROM h JOIN m ON h.zpb = m.zpb JOIN (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS gp_nr FROM customer) c ON h.gp_nr = c.gp_nr)
SELECT gp_nr, l.zpb, l.mp_id, meters_of_zpb, customers_of_meter FROM l JOIN (SELECT zpb, count(DISTINCT mp_id) AS meters_of_zpb FROM l GROUP BY ALL) a ON l.zpb = a.zpb JOIN (SELECT mp_id, count(DISTINCT gp_nr) AS customers_of_meter FROM l GROUP BY ALL) b ON l.mp_id = b.mp_id""")
def linked_meters(spark, sf):
    """Customers to meters through designations, with how many of each a link has"""
    o, l = P.load(spark, sf, "orders"), P.load(spark, sf, "lineitem")
    customers = P.load(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("gp_nr"))
    out = R.linked_meters(o.select(F.col("o_custkey").cast("string").alias("gp_nr"), F.col("o_orderkey").alias("zpb")), l.select(F.col("l_orderkey").alias("zpb"), F.col("l_suppkey").cast("string").alias("mp_id")), customers)
    return out.select("gp_nr", "zpb", "mp_id", "meters_of_zpb", "customers_of_meter")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS status FROM orders")
def literal_lookup(spark, sf):
    """J10"""
    return R.look_up(P.load(spark, sf, "orders"), "o_orderstatus", {"F": "finished", "O": "open"}, "status").select("o_orderkey", "status")


@query("SELECT l_orderkey, l_linenumber, o_custkey, o_orderdate FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def enriched_rows(spark, sf):
    """J19"""
    o = P.load(spark, sf, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return R.enrich(P.load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), o, "l_orderkey", ["o_custkey", "o_orderdate"])


@query("SELECT count(*) AS hosts, count(*) AS distinct_hosts, 0 AS without_donor, true AS same_again FROM customer")
def random_assignment_holds(spark, sf):
    """Every host has one donor, the same one again"""
    hosts, donors = P.load(spark, sf, "customer").select("c_custkey"), P.load(spark, sf, "nation").select("n_nationkey")
    once, again = R.assign_random(hosts, donors), R.assign_random(hosts.repartition(3), donors).select("c_custkey", F.col("n_nationkey").alias("again"))
    return once.join(again, "c_custkey", "full").agg(F.count("c_custkey").alias("hosts"), F.count_distinct("c_custkey").alias("distinct_hosts"), F.count_if(F.col("n_nationkey").isNull()).cast("int").alias("without_donor"), F.bool_and(F.col("n_nationkey") == F.col("again")).alias("same_again"))


@query(f"SELECT c_custkey, row_number() OVER (ORDER BY {P.NUMBER.format("'1', CAST(c_custkey AS VARCHAR)")}, c_custkey) - 1 AS place FROM customer")
def shuffled_order(spark, sf):
    """Each row's place in an order drawn by hash"""
    return R.shuffled(P.load(spark, sf, "customer").select("c_custkey"), "c_custkey", 1)


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 12) GROUP BY o_custkey")
def supported_groups(spark, sf):
    """P14"""
    return R.with_support(P.load(spark, sf, "orders"), ["o_custkey"], 12).groupBy("o_custkey").agg(F.count("*").alias("n"))


@query(P.sql("scored") + "SELECT doc_id, score, label FROM scored WHERE quality = 1 AND label IS NOT NULL")
def guarded_features(spark, sf):
    """Needed columns are there, no target among the features, constant columns go, eligible rows stay"""
    x = R.eligible(R.require_columns(P.scored(spark, sf), ["doc_id", "score", "label"]), "quality", "label")
    x = R.drop_constant(x.withColumn("one", F.lit(1)), ["one", "quality", "score"])
    features = R.feature_columns(x, ["doc_id", "label"])
    R.guard_features(features, ["label"], ["score"])
    return x.select("doc_id", *features, "label")


_SLOT_NAMES = [f"net_load_{d}_{(k + 1) * 15 % 1440 // 60:02d}_{(k + 1) * 15 % 60:02d}_kwh" for d in ("mon", "tue", "wed", "thu", "fri", "sat", "sun") for k in range(96)]


@query(P.sql("vec") + "SELECT mp_id, " + ", ".join(f"q[{i % 64 + 1}] AS {n}" for i, n in enumerate(_SLOT_NAMES)) + " FROM vec")
def named_slots(spark, sf):
    """672 named columns"""
    week = F.slice(F.flatten(F.array_repeat("q", 11)), 1, 672)
    return R.named_slots(P.profiles(spark, sf).select("mp_id", week.alias("q")), "q")


@query("SELECT o_custkey, CAST(max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS INTEGER) AS flag, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderpriority <> '5-LOW') AS priority FROM orders GROUP BY o_custkey")
def household_labels(spark, sf):
    """A23, A24"""
    o = P.load(spark, sf, "orders").withColumn("mark", F.when(F.col("o_orderstatus") == "F", " X "))
    return o.groupBy("o_custkey").agg(A.any_mark("mark").alias("flag"), A.first_filled("o_orderpriority", "o_orderkey", "5-LOW").alias("priority"))


_W_COUNTS = ("w_n_meters", "w_n_meters_with_data", "w_is_multi_meter", "w_is_multi_unit", "w_n_heat_pump_like_meters", "w_is_winter_dominant", "w_has_dedicated_hp_meter", "w_n_production_only_meters", "w_has_production_only_meter", "w_n_months_in_window")
_W_RATIOS = ("w_meter_max_winter_summer_ratio", "w_meter_min_summer_share", "w_meter_concentration")


@query(P.sql("facts") + """, m AS (SELECT CAST(CAST(mp_id AS BIGINT) % 20 AS VARCHAR) AS gp_nr, mp_id, make_date(year, month, 1) AS month, register, kwh, n_days FROM facts), t AS (SELECT gp_nr, count(DISTINCT mp_id) AS total FROM m GROUP BY gp_nr),
w AS (SELECT o_orderkey AS sample_id, CAST(o_custkey % 20 AS VARCHAR) AS gp_nr, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate + INTERVAL 300 DAY AS DATE) AS b FROM orders),
p AS (SELECT sample_id, w.gp_nr, mp_id, avg(kwh / n_days) FILTER (register = 'import' AND month(month) IN (5,6,7,8)) AS su, avg(kwh / n_days) FILTER (register = 'import' AND month(month) IN (11,12,1,2)) AS wi, sum(kwh) FILTER (register = 'import') AS imp, count(*) FILTER (register = 'import') AS n, coalesce(sum(kwh) FILTER (register = 'export'), 0) AS exp
  FROM w JOIN m ON w.gp_nr = m.gp_nr AND month BETWEEN date_trunc('month', a) AND date_trunc('month', b) GROUP BY ALL HAVING count(*) FILTER (register = 'import') > 0),
r AS (SELECT *, CASE WHEN su > 0.01 THEN wi / su END AS ratio, CASE WHEN coalesce(su, 0) + coalesce(wi, 0) > 0 THEN su / (coalesce(su, 0) + coalesce(wi, 0)) END AS share FROM p),
h AS (SELECT *, coalesce(ratio >= 1.1 AND share <= 0.48 AND n >= 2, false) AS hp, exp > 0 AND imp <= 400 AS made FROM r),
g AS (SELECT sample_id, gp_nr, count(*) AS n, max(ratio) AS ratio, min(share) AS share, max(imp) / sum(imp) AS conc, count(*) FILTER (hp) AS hp, count(*) FILTER (made) AS made, max(n) AS months FROM h GROUP BY ALL)
SELECT sample_id, total AS w_n_meters, n AS w_n_meters_with_data, CAST(total > 1 AS INTEGER) AS w_is_multi_meter, CAST(total >= 4 AS INTEGER) AS w_is_multi_unit, round(ratio, 6) AS w_meter_max_winter_summer_ratio, round(share, 6) AS w_meter_min_summer_share, round(conc, 6) AS w_meter_concentration,
  hp AS w_n_heat_pump_like_meters, CAST(hp > 0 AS INTEGER) AS w_is_winter_dominant, CAST(n > 1 AND hp > 0 AND n > hp AS INTEGER) AS w_has_dedicated_hp_meter, made AS w_n_production_only_meters, CAST(made > 0 AS INTEGER) AS w_has_production_only_meter, months AS w_n_months_in_window FROM g JOIN t ON g.gp_nr = t.gp_nr""")
def windowed_profile(spark, sf):
    """13 outputs; limits are set so that the stand-ins pass and fail them"""
    m = P.facts(spark, sf).select((F.col("mp_id").cast("bigint") % 20).cast("string").alias("gp_nr"), "mp_id", F.make_date("year", "month", F.lit(1)).alias("month"), "register", "kwh", "n_days")
    d = F.to_date("o_orderdate")
    w = P.load(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_id"), (F.col("o_custkey") % 20).cast("string").alias("gp_nr"), d.alias("first_day"), F.date_add(d, 300).alias("last_day"))
    out = A.windowed_profile(m, w, 1.1, 0.48, 400.0)
    return out.select("sample_id", *_W_COUNTS, *[r6(c).alias(c) for c in _W_RATIOS])


@query("SELECT CAST(count(DISTINCT c_custkey) AS BIGINT) AS households, CAST(count(*) FILTER (c_acctbal > 0) AS BIGINT) AS positive, CAST(count(*) FILTER (c_acctbal > 0 AND c_nationkey < 10) AS BIGINT) AS positive_metered, CAST(count(*) FILTER (c_nationkey BETWEEN 3 AND 7) AS BIGINT) AS in_window FROM customer")
def acceptance_counts(spark, sf):
    """Counts that have to come out as agreed"""
    c = P.load(spark, sf, "customer")
    return A.acceptance(c, "c_custkey", {"positive": F.col("c_acctbal") > 0, "positive_metered": (F.col("c_acctbal") > 0) & (F.col("c_nationkey") < 10), "in_window": F.col("c_nationkey").between(3, 7)})


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS stamped, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, least(CAST(o_orderdate AS DATE), DATE '1996-06-15') AS earliest, greatest(CAST(o_orderdate AS DATE), DATE '1996-06-15') AS latest FROM orders")
def date_columns(spark, sf):
    """D03, D07, D11"""
    d, edge = F.to_date("o_orderdate"), F.lit("1996-06-15").cast("date")
    return P.load(spark, sf, "orders").select("o_orderkey", D.stamp_date(F.date_format("o_orderdate", "dd.MM.yyyy HH:mm")).alias("stamped"), D.month_of(d).alias("month"), D.first_date(d, edge).alias("earliest"), D.last_date(d, edge).alias("latest"))


@query("SELECT o_custkey, round(CASE WHEN avg(o_totalprice) > 0 THEN stddev_pop(o_totalprice) / avg(o_totalprice) END, 6) AS variation FROM orders GROUP BY o_custkey")
def variation(spark, sf):
    """M08"""
    return P.load(spark, sf, "orders").groupBy("o_custkey").agg(r6(N.variation(F.stddev_pop("o_totalprice"), F.avg("o_totalprice"))).alias("variation"))


@query("WITH p AS (SELECT c_custkey, greatest(1e-6, least(1 - 1e-6, c_acctbal / 10000)) AS p FROM customer) SELECT c_custkey, round(ln(p / (1 - p)), 6) AS logit, round(1 / (1 + exp(-(ln(p / (1 - p)) + 0.5))), 6) AS shifted FROM p")
def shifted_logits(spark, sf):
    """M12"""
    p = F.col("c_acctbal") / 10000
    return P.load(spark, sf, "customer").select("c_custkey", r6(N.logit(p)).alias("logit"), r6(N.shift_logit(p, 0.5)).alias("shifted"))


@query("SELECT o_custkey, array_to_string(list_sort(list(o_orderkey))[1:3], '|') AS first_orders, count(*) AS n FROM orders GROUP BY o_custkey")
def per_group_function(spark, sf):
    """A Python function of each customer's rows"""
    import pandas as pd

    def summary(rows: pd.DataFrame) -> pd.DataFrame:
        keys = sorted(rows.o_orderkey)
        return pd.DataFrame({"o_custkey": [rows.o_custkey.iloc[0]], "first_orders": ["|".join(map(str, keys[:3]))], "n": [len(keys)]})

    return R.per_group(P.load(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], summary, "o_custkey long, first_orders string, n long")


# -- labels and evaluation -----------------------------------------------------------
@query(P.sql("scored") + "SELECT CAST(label AS INTEGER) AS label, count(*) AS groups, count(*) AS distinct_groups, true AS as_shared FROM (SELECT doc_id, max(label) AS label FROM scored GROUP BY ALL) GROUP BY label")
def split_holds(spark, sf):
    """A group lies in one split; each label's groups are shared out 60:20:20 to within one"""
    s = L.split_groups(P.scored(spark, sf), "doc_id", "label")
    of = lambda name: F.count_if(F.col("split") == name)
    near = lambda name, share: F.abs(of(name) - share * F.count("*")) <= 1
    return s.groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("groups"), F.count_distinct("doc_id").alias("distinct_groups"), (near("train", 0.6) & near("validation", 0.2) & near("test", 0.2)).alias("as_shared"))


@query(P.sql("scored") + "SELECT CAST(label AS INTEGER) AS label, CAST(f AS INTEGER) AS fold, n // 5 + CASE WHEN f < n % 5 THEN 1 ELSE 0 END AS groups FROM (SELECT label, count(*) AS n FROM (SELECT doc_id, max(label) AS label FROM scored GROUP BY ALL) GROUP BY label), range(0, 5) t(f)")
def fold_sizes(spark, sf):
    """The groups of each label are dealt to five folds in turn"""
    return L.folds(P.scored(spark, sf), "doc_id", "label").groupBy(F.col("label").cast("int").alias("label"), "fold").agg(F.count("*").alias("groups"))


@query("SELECT o_orderkey, " + ", ".join(f"CASE WHEN o_orderstatus = 'O' THEN 0 WHEN date_trunc('week', o_orderdate) + INTERVAL 7 DAY <= DATE '1998-01-01' THEN 0 WHEN date_trunc('week', o_orderdate) >= DATE '1998-03-01' + INTERVAL {w} DAY THEN 1 END AS label_{w}" for w in (0, 28, 56, 84)) + " FROM orders")
def label_washouts(spark, sf):
    """L23"""
    d = F.to_date("o_orderdate")
    o = P.load(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", 0).otherwise(1).alias("ev"), D.week_start(d).alias("week"), F.lit("1998-01-01").cast("date").alias("a"), F.lit("1998-03-01").cast("date").alias("b"))
    return L.label_variants(o, "week", "a", "b", "ev").select("o_orderkey", *[f"label_{w}" for w in (0, 28, 56, 84)])


@query("SELECT count(*) FILTER (c_custkey % 3 = 0) AS labelled, count(*) FILTER (c_custkey % 3 > 0 AND c_custkey % 7 > 0 OR c_custkey % 33 = 0) AS exploratory, count(*) AS whole, count(*) FILTER (c_custkey % 33 = 0) AS twice, count(*) FILTER (c_custkey % 3 > 0 AND c_custkey % 7 = 0) AS left_out, CAST(0 AS BIGINT) AS foreign FROM customer")
def reconciled(spark, sf):
    """Labelled and exploratory keys held against all: some twice, some left out"""
    c = P.load(spark, sf, "customer").select("c_custkey")
    rest = c.where("c_custkey % 3 > 0 and c_custkey % 7 > 0 or c_custkey % 33 = 0")
    return L.reconciliation(c.where("c_custkey % 3 = 0"), rest, c, "c_custkey")


@query(P.sql("scored") + """, y AS (SELECT lang, quality, label, CASE WHEN score >= 1500 THEN 1 ELSE 0 END AS p FROM scored), c AS (SELECT lang, count(*) FILTER (label = 1 AND p = 1) AS tp, count(*) FILTER (label = 0 AND p = 1) AS fp, count(*) FILTER (label = 0 AND p = 0) AS tn, count(*) FILTER (label = 1 AND p = 0) AS fn FROM y GROUP BY lang)
SELECT lang, tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy FROM c WHERE tp + fn >= 3 AND fp + tn >= 3""")
def metrics_by_year(spark, sf):
    """Here a year is a language"""
    y = P.scored(spark, sf).withColumn("p", (F.col("score") >= 1500).cast("int"))
    return S.by_year(y, "lang", "label", "p", 3).select("lang", "tp", "fp", "tn", "fn", r6("accuracy").alias("accuracy"))


@query(P.sql("scored") + """, r AS (SELECT doc_id % 3 AS fold, label, score FROM scored), o AS (SELECT f.fold, score AS t, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM r JOIN (SELECT DISTINCT fold FROM r) f ON r.fold <> f.fold GROUP BY ALL),
c AS (SELECT fold, t, sum(p) OVER w / (SELECT sum(p) FROM o x WHERE x.fold = o.fold) - sum(n) OVER w / (SELECT sum(n) FROM o x WHERE x.fold = o.fold) AS j FROM o WINDOW w AS (PARTITION BY fold ORDER BY t DESC)), b AS (SELECT fold, arg_max(t, (j, t)) AS threshold FROM c GROUP BY fold)
SELECT CAST(r.fold AS INTEGER) AS fold, any_value(threshold) AS threshold, count(*) AS n, count(*) FILTER (score >= threshold) AS flagged, count(*) FILTER (score >= threshold AND label = 1) AS hits FROM r JOIN b ON r.fold = b.fold GROUP BY r.fold""")
def out_of_fold_rule(spark, sf):
    """A single rule whose threshold never saw the rows that it judges"""
    rows = P.scored(spark, sf).withColumn("fold", (F.col("doc_id") % 3).cast("int"))
    out = S.youden_out_of_fold(rows, "label", "score", "fold", 3)
    return out.groupBy("fold").agg(F.max("threshold").alias("threshold"), F.count("*").alias("n"), F.sum("predicted").alias("flagged"), F.count_if((F.col("predicted") == 1) & (F.col("label") == 1)).alias("hits"))


@query("SELECT c_custkey, round(quantile_cont(c_acctbal, 0.9) OVER (), 4) AS threshold, c_acctbal >= quantile_cont(c_acctbal, 0.9) OVER () AS flagged FROM customer")
def rate_threshold(spark, sf):
    """The threshold that flags a tenth, on each row"""
    c = P.load(spark, sf, "customer")
    threshold = M.rate_matched_threshold(c, "c_acctbal", 0.1)
    return c.select("c_custkey", F.lit(round(threshold, 4)).alias("threshold"), (F.col("c_acctbal") >= threshold).alias("flagged"))


@query("""SELECT sha256('{"langs": [' || string_agg('"' || lang || '"', ', ' ORDER BY lang) || '], "rows": ' || CAST(sum(n) AS BIGINT) || '}') AS digest FROM (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang)""")
def frozen_configuration(spark, sf):
    """The digest of a configuration that a table gives; it doesn't depend on the order of keys"""
    by = P.load(spark, sf, "documents").where("lang is not null").groupBy("lang").count()
    row = by.agg(F.sum("count").alias("rows"), F.array_sort(F.collect_list("lang")).alias("langs")).first()  # a configuration: a few languages
    return by.select(F.lit(M.freeze({"rows": row.rows, "langs": row.langs})).alias("digest")).distinct()


# -- sources and sinks ------------------------------------------------------------------
@query(P.sql("r") + "SELECT mp_id, CASE WHEN register = 'import' THEN '1-1:1.29.0*255' ELSE '1-1:2.29.0*255' END AS obis, date, plz, slot, round(round(sum(kwh), 3), 3) AS kwh FROM r GROUP BY ALL")
def export_files(spark, sf):
    """Readings written as a monthly export in German spelling, discovered and read by position"""
    root = scratch(spark, "exports")
    r = P.readings(spark, sf).withColumn("obis", F.when(F.col("register") == "import", exports.IMPORT).otherwise(exports.EXPORT))
    r = r.groupBy("mp_id", "obis", "date", "plz", "slot").agg(F.round(F.sum("kwh"), 3).alias("v"))
    days = r.groupBy("mp_id", "obis", "date", "plz").agg(F.map_from_entries(F.collect_list(F.struct("slot", "v"))).alias("m"))
    cell = lambda k: F.replace(F.try_element_at("m", F.lit(k)).cast("decimal(18,3)").cast("string"), F.lit("."), F.lit(","))
    names = exports.interval_names()
    wide = days.select(F.col("mp_id").alias("MP ID"), F.col("obis").alias("OBIS-Code"), F.date_format("date", "dd.MM.yyyy").alias("Datum"), F.col("plz").alias("PLZ"), *[cell(k).alias(n) for k, n in enumerate(names)])
    sinks.write_csv(wide, f"{root}/Januar 2024", ";")
    found = exports.discover_exports(spark, root)
    read = exports.by_content(exports.read_exports(spark, [e.path for e in found]), 2024, (1, 1))
    return R.slots(read, ["mp_id", "obis", "date", "plz"], "q").where("value is not null").select("mp_id", "obis", "date", "plz", "slot", F.round(F.col("value").cast("double"), 3).alias("kwh"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS gp_nr, n_name AS name, CAST(n_regionkey AS VARCHAR) AS obis FROM nation")
def reference_file(spark, sf):
    """Padded cells of a reference table"""
    path = f"{scratch(spark, 'reference')}/nation.csv"
    n = P.load(spark, sf, "nation")
    sinks.write_csv(n.select(F.concat(F.lit(" "), F.col("n_nationkey").cast("string"), F.lit(" ")).alias(" GP-Nr"), F.concat(F.col("n_name"), F.lit("  ")).alias("Name "), F.col("n_regionkey").alias("OBIS")), path, ";")
    return exports.read_reference(spark, path, rename={"GP-Nr": "gp_nr", "Name": "name", "OBIS": "obis"})


@query("SELECT n_regionkey AS obis, count(*) AS \"count\" FROM nation GROUP BY ALL")
def register_profile(spark, sf):
    """A bounded look at a table's registers"""
    return exports.register_profile(P.load(spark, sf, "nation").withColumnRenamed("n_regionkey", "obis"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def sequence_file(spark, sf):
    """A typed CSV read by its suffix"""
    path = f"{scratch(spark, 'sequence')}/nation.csv"
    n = P.load(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    sinks.write_csv(n, path)
    return exports.read_table(spark, path, schema=n.schema)


@query("SELECT event_id, CAST(ts AS DATE) AS date, CAST(year(ts) AS INTEGER) AS year FROM events")
def yearly_parquet(spark, sf):
    """Folders by year, written twice, with properties beside them"""
    path = scratch(spark, "yearly")
    e = P.load(spark, sf, "events").select("event_id", F.to_date("ts").alias("date"))
    for _ in range(2):
        sinks.write_by_year(e, f"{path}/data", "date")
    sinks.write_table(e.limit(1), f"{path}/more", kind="events")
    if exports.read_config(spark, f"{path}/more/properties") != {"kind": "events"}:
        raise ValueError("the properties aren't what was written")
    return exports.read_table(spark, f"{path}/data").select("event_id", "date", "year")


@query("SELECT lang AS key, CAST(count(*) AS DOUBLE) AS value FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def json_artifact(spark, sf):
    """A table's summary as an artefact, and back"""
    path = f"{scratch(spark, 'json')}/config"
    found = P.load(spark, sf, "documents").where("lang is not null").groupBy("lang").agg(F.count("*").cast("double").alias("n")).collect()  # a few languages
    sinks.write_json(spark, {r.lang: r.n for r in found}, path)
    if exports.read_config(spark, path) != {r.lang: r.n for r in found}:
        raise ValueError("the artefact isn't what was written")
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,double>")).alias("key", "value"))


@query("SELECT n_nationkey, n_name, n_regionkey * 10 AS feed_in, true AS refused, 1 AS made FROM nation")
def guarded_sinks(spark, sf):
    """Written once, channels apart, made once and read from the cache"""
    path, made = scratch(spark, "sinks"), []
    n = P.load(spark, sf, "nation").select("n_nationkey", "n_name", (F.col("n_regionkey") * 10).alias("feed_in"))
    load, feed = sinks.split_channels(n, ["n_nationkey"], ["feed_in"])
    sinks.write_once(load, f"{path}/once")
    try:
        sinks.write_once(load, f"{path}/once")
        refused = False
    except Exception as error:
        refused = "PATH_ALREADY_EXISTS" in str(error)
    key = sinks.cache_key("feed", 1)
    for _ in range(2):
        kept = sinks.cached(spark, path, key, lambda: made.append(1) or feed)
    return spark.read.parquet(f"{path}/once").join(kept, "n_nationkey").select("n_nationkey", "n_name", "feed_in", F.lit(refused).alias("refused"), F.lit(len(made)).alias("made"))


@query("""WITH t AS (SELECT o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL) SELECT 0 AS place, '| priority | n |' AS line UNION ALL SELECT 1, '| --- | --- |'
UNION ALL SELECT CAST(row_number() OVER (ORDER BY priority) + 1 AS INTEGER), '| ' || priority || ' | ' || n || ' |' FROM t""")
def markdown_report(spark, sf):
    """A small table as the lines of a report"""
    t = P.load(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))
    return sinks.markdown_lines(t, "priority")


@query("SELECT o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_custkey) > 500000 AS large, count(*) OVER (PARTITION BY o_custkey) AS orders_of_customer FROM orders")
def group_on_rows(spark, sf):
    """A group's aggregates on each of its rows"""
    o = R.with_group(P.load(spark, sf, "orders"), ["o_custkey"], F.sum("o_totalprice").alias("total"), F.count("*").alias("orders_of_customer"))
    return o.select("o_orderkey", (F.col("total") > 500000).alias("large"), "orders_of_customer")


@query("SELECT c_custkey, list_sum(list_transform(regexp_extract_all(c_name || CAST(c_custkey AS VARCHAR), '[0-9]'), lambda d: CAST(d AS BIGINT))) % 10 AS digit FROM customer")
def per_value_function(spark, sf):
    """A check digit, by a Python function of each value"""
    def digit(texts):
        return texts.map(lambda t: sum(int(c) for c in t if "0" <= c <= "9") % 10)

    c = P.load(spark, sf, "customer").withColumn("t", F.concat("c_name", F.col("c_custkey").cast("string")))
    return R.per_value(c, "t", digit, "long", "digit").select("c_custkey", "digit")


# -- streams --------------------------------------------------------------------------------
def _streamed(spark, sf, make):
    """All of a stream over the readings, in time order, and a last reading far behind that closes every window."""
    path = scratch(spark, "stream")
    r = P.readings(spark, sf).select("mp_id", F.col("ts").cast("timestamp").alias("ts"), "register", "kwh")
    far = spark.createDataFrame([("end", dt.datetime(2030, 1, 1), "import", 0.0)], r.schema)
    r.write.parquet(f"{path}/in")
    far.write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(r.schema).parquet(f"{path}/in")
    q = make(stream).writeStream.outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).format("parquet").option("path", f"{path}/out").start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out").where("mp_id <> 'end'")


_NTZ = lambda c: F.col(c).cast("timestamp_ntz")


@query(P.sql("r") + "SELECT mp_id, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, round(sum(kwh) FILTER (register = 'import'), 4) AS import, round(sum(kwh) FILTER (register = 'export'), 4) AS export FROM r GROUP BY ALL")
def streamed_pairs(spark, sf):
    """Registers paired by a stream; what never met its other side is sent when the watermark passes"""
    out = _streamed(spark, sf, pairing.pair_registers_stream)
    return out.select("mp_id", _NTZ("ts").alias("ts"), r4("import").alias("import"), r4("export").alias("export"))


@query(P.sql("r") + "SELECT mp_id, register, date_trunc('day', ts)::TIMESTAMP AS ts, round(sum(kwh), 4) AS kwh, count(*) AS n FROM r GROUP BY ALL")
def streamed_days(spark, sf):
    """X05"""
    return _streamed(spark, sf, pairing.daily_energy_stream).select("mp_id", "register", _NTZ("ts").alias("ts"), r4("kwh").alias("kwh"), "n")


@query(P.sql("r") + "SELECT mp_id, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL (k * 15) MINUTE AS ts, round(sum(kwh), 4) AS kwh FROM r, range(0, 4) t(k) GROUP BY ALL")
def streamed_hours(spark, sf):
    """X07"""
    return _streamed(spark, sf, pairing.rolling_hour_stream).select("mp_id", _NTZ("ts").alias("ts"), r4("kwh").alias("kwh"))


@query(P.sql("r") + ", g AS (SELECT mp_id, ts, kwh, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM r WINDOW w AS (PARTITION BY mp_id ORDER BY ts)), s AS (SELECT *, sum(f) OVER (PARTITION BY mp_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT mp_id, min(ts) AS start, count(*) AS n, round(sum(kwh), 4) AS kwh FROM s GROUP BY mp_id, k")
def streamed_sessions(spark, sf):
    """X06"""
    return _streamed(spark, sf, pairing.sessions_stream).select("mp_id", _NTZ("start").alias("start"), "n", r4("kwh").alias("kwh"))
