"""Queries of the window, vector, event, label and evaluation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import draws
from ..functions import vectors as V
from ..operators import events as E
from ..operators import labels as L
from ..operators import stats as S
from ..operators import windows as W
from . import proxies as P
from .registry import query

r4 = lambda c: F.round(c, 4)
_HOURS = ", h AS (SELECT plz, date, CAST(slot // 4 AS INTEGER) AS hour, round(sum(kwh), 4) AS x FROM r GROUP BY ALL)"


def hours(spark, sf):
    """(plz, date, hour, x): dense enough for ordered windows"""
    r = P.readings(spark, sf)
    return r.groupBy("plz", "date", F.floor(F.col("slot") / 4).cast("int").alias("hour")).agg(r4(F.sum("kwh")).alias("x"))


# -- windows ------------------------------------------------------------------
@query(P.sql("weather") + ", q AS (SELECT month(date) AS m, quantile_cont(radiation, 0.75) AS q, quantile_cont(radiation, 0.95) AS top FROM weather GROUP BY ALL) SELECT date, radiation >= q AS is_clear, round(least(1.5, greatest(0, radiation / top)), 4) AS clearness FROM weather JOIN q ON month(date) = m")
def clear_sky_flag(spark, sf):
    """W02"""
    return W.clear_days(P.weather(spark, sf)).select("date", "is_clear", r4("clearness").alias("clearness"))


@query(P.sql("facts") + ", y AS (SELECT mp_id, year, sum(kwh) AS kwh FROM facts GROUP BY ALL), d AS (SELECT mp_id, lag(kwh) OVER (PARTITION BY mp_id ORDER BY year) - kwh AS d FROM y) SELECT mp_id, max(d) AS \"drop\" FROM d GROUP BY mp_id")
def yoy_drop(spark, sf):
    """W03, W10"""
    y = P.facts(spark, sf).groupBy("mp_id", "year").agg(F.sum("kwh").alias("kwh"))
    return W.largest_drop(y, "mp_id", "kwh")


@query("WITH k AS (SELECT s_suppkey, s_nationkey AS v, rank() OVER (ORDER BY s_nationkey) AS a, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) SELECT s_suppkey, round((a + (n - 1) / 2.0) / (SELECT count(*) FROM supplier), 6) AS pct FROM k")
def pct_rank_avg(spark, sf):
    """W07"""
    return W.percentile_rank(P.load(spark, sf, "supplier"), "s_nationkey").select("s_suppkey", F.round("pct", 6).alias("pct"))


@query("SELECT c_custkey, round((SELECT count(*) FROM supplier WHERE s_acctbal <= c_acctbal) / (SELECT count(*) FROM supplier)::DOUBLE, 6) AS pct FROM customer")
def reference_percentile(spark, sf):
    """W08, M11"""
    return W.reference_percentile(P.load(spark, sf, "customer"), "c_acctbal", P.load(spark, sf, "supplier"), "s_acctbal").select("c_custkey", F.round("pct", 6).alias("pct"))


@query(P.sql("facts") + """, m AS (SELECT mp_id, year * 12 + month AS t, sum(kwh) AS v FROM facts GROUP BY ALL),
k AS (SELECT mp_id, t, rank() OVER (PARTITION BY mp_id ORDER BY v) + (count(*) OVER (PARTITION BY mp_id, v) - 1) / 2.0 AS rk, row_number() OVER (PARTITION BY mp_id ORDER BY t) AS i, count(*) OVER (PARTITION BY mp_id) AS n FROM m),
u AS (SELECT mp_id, i, n, abs(2 * sum(rk) OVER (PARTITION BY mp_id ORDER BY t) - i * (n + 1)) AS u FROM k),
b AS (SELECT mp_id, max(u) AS k, arg_max(i, (u, -i)) AS "at", any_value(n) AS n FROM u WHERE i < n GROUP BY mp_id)
SELECT mp_id, CAST(CASE WHEN n >= 4 THEN "at" - 1 ELSE -1 END AS INTEGER) AS "at", CAST(CASE WHEN n >= 4 THEN k ELSE 0 END AS DOUBLE) AS k, round(CASE WHEN n >= 4 THEN least(1, 2 * exp(-6 * k * k / (CAST(n AS DOUBLE) ** 3 + CAST(n AS DOUBLE) ** 2))) ELSE 1 END, 6) AS p FROM b""")
def pettitt(spark, sf):
    """W09, E11"""
    m = P.facts(spark, sf).groupBy("mp_id", (F.col("year") * 12 + F.col("month")).alias("t")).agg(F.sum("kwh").alias("v"))
    return W.pettitt(m, ["mp_id"], "t", "v").withColumn("p", F.round("p", 6))


@query(P.sql("r") + _HOURS + " SELECT plz, date, hour, " + ", ".join(f"round(x - lag(x, {k}) OVER w, 4) AS diff_{k}" for k in (1, 2, 4, 8)) + " FROM h WINDOW w AS (PARTITION BY plz, date ORDER BY hour)")
def multi_lag(spark, sf):
    """W10, W11"""
    out = W.lag_differences(hours(spark, sf), ["plz", "date"], "hour", "x")
    return out.select("plz", "date", "hour", *[r4(f"diff_{k}").alias(f"diff_{k}") for k in (1, 2, 4, 8)])


@query(P.sql("r") + _HOURS + ", b AS (SELECT plz, date, quantile_cont(x, 0.2) AS base FROM h GROUP BY ALL) SELECT h.plz, h.date, hour, round(x - base, 4) AS residual FROM h JOIN b ON h.plz = b.plz AND h.date = b.date")
def daily_q20_residual(spark, sf):
    """W13"""
    return W.daily_residual(hours(spark, sf), ["plz", "date"], "x").select("plz", "date", "hour", r4("residual").alias("residual"))


@query(P.sql("r") + _HOURS + " SELECT plz, date, hour, round(quantile_cont(x, 0.5) OVER (PARTITION BY plz, date ORDER BY hour ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 4) AS before FROM h")
def trailing_median(spark, sf):
    """W15"""
    return W.trailing_median(hours(spark, sf), ["plz", "date"], "hour", "x").select("plz", "date", "hour", r4("before").alias("before"))


@query(P.sql("r") + _HOURS + " SELECT plz, date, hour, round(x - min(x) OVER (PARTITION BY plz, date ORDER BY hour ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING), 4) AS fall FROM h")
def leading_fall(spark, sf):
    """W16"""
    return W.leading_fall(hours(spark, sf), ["plz", "date"], "hour", "x", 8).select("plz", "date", "hour", r4("fall").alias("fall"))


@query(P.sql("r") + _HOURS + """, g AS (SELECT plz, date, hour, CASE WHEN hour - lag(hour) OVER w > 2 OR lag(hour) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM h WHERE x >= 20 WINDOW w AS (PARTITION BY plz, date ORDER BY hour)),
n AS (SELECT plz, date, hour, sum(new) OVER (PARTITION BY plz, date ORDER BY hour) AS run FROM g) SELECT plz, date, min(hour) AS start, CAST(max(hour) - min(hour) + 1 AS INTEGER) AS length, count(*) AS hits FROM n GROUP BY plz, date, run HAVING max(hour) - min(hour) + 1 >= 2""")
def islands(spark, sf):
    """W17, X06"""
    return W.islands(hours(spark, sf), ["plz", "date"], "hour", F.col("x") >= 20, 1, 2)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) = 1)")
def dedupe_keep_none(spark, sf):
    """W23"""
    return W.keep_unique(P.load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT s_suppkey, round(s_acctbal / sum(s_acctbal) OVER (PARTITION BY s_nationkey), 6) AS share FROM supplier")
def share_of_group(spark, sf):
    """W25, W06"""
    out = W.share_of_group(P.load(spark, sf, "supplier"), ["s_nationkey"], "s_acctbal")
    return out.select("s_suppkey", F.round(F.col("share"), 6).alias("share"))


@query("SELECT s_suppkey, CAST(row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS INTEGER) AS position FROM (SELECT * FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 20)")
def leaderboard(spark, sf):
    """A leaderboard of twenty"""
    s = P.load(spark, sf, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(20)
    return W.leaderboard(s, F.desc("s_acctbal"), F.asc("s_suppkey")).select("s_suppkey", "position")


# -- vectors --------------------------------------------------------------------
def _vec(cols: str, more: str = "", where: str = "") -> str:
    return P.sql("vec") + more + f" SELECT mp_id, {cols} FROM vec {where}"


@query(_vec(", ".join([f"round(list_aggregate(q, 'quantile_cont', {p}), 4) AS q{round(100 * p):02d}" for p in (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)] + ["round(list_avg(q), 4) AS mean", "round(list_aggregate(q, 'stddev_pop'), 4) AS std0", "round(list_aggregate(q, 'stddev_samp'), 4) AS std1", "round(list_avg(list_sort(q, 'DESC')[1:7]), 4) AS top7", "CAST(list_position(q, list_max(q)) - 1 AS INTEGER) AS peak", "len(list_filter(q, lambda x: x > 0.1)) / 4.0 AS above"])))
def compact_stats(spark, sf):
    """V01, M04-M08, O05, O08"""
    q = F.col("q")
    return P.profiles(spark, sf).select("mp_id", *[r4(V.quantile(q, p)).alias(f"q{round(100 * p):02d}") for p in (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)], r4(V.mean(q)).alias("mean"), r4(V.std(q)).alias("std0"), r4(V.std(q, 1)).alias("std1"),
        r4(V.largest(q, 7)).alias("top7"), V.peak_slot(q, -1e9).alias("peak"), V.hours_above(q, 0.1).alias("above"))


@query(P.sql("vec") + ", x AS (SELECT mp_id, i - 1 AS k, q[i] AS v FROM vec, range(1, 65) t(i)) SELECT mp_id, " + ", ".join(f"round(sqrt(sum(v * cos(2 * pi() * {c} * k / 64)) ** 2 + sum(v * sin(2 * pi() * {c} * k / 64)) ** 2) / 64, 5) AS fourier_{c}" for c in (1, 2, 3, 7)) + " FROM x GROUP BY mp_id")
def dft_bins(spark, sf):
    """V02, M02"""
    return P.profiles(spark, sf).select("mp_id", *[F.round(V.fourier(F.col("q"), k), 5).alias(f"fourier_{k}") for k in (1, 2, 3, 7)])


@query(_vec("round(list_sum(q[1:16]), 4) AS band, " + ", ".join(f"round(list_avg(list_transform(list_zip(q[{k + 1}:64], q[1:{64 - k}]), lambda p: abs(p[1] - p[2]))), 4) AS diff_{k}" for k in (1, 2, 4, 8))))
def hour_bands_and_lags(spark, sf):
    """V06, V04, W11"""
    q = F.col("q")
    return P.profiles(spark, sf).select("mp_id", r4(V.hour_band(q, range(0, 4))).alias("band"), *[r4(V.mean(F.transform(V.steps(q, k), F.abs))).alias(f"diff_{k}") for k in (1, 2, 4, 8)])


@query(_vec("round(list_min(list_transform(range(1, 65), lambda i: (c[i] + c[i + 1] + c[i + 2] + c[i + 3]) / 4)), 4) AS floor", ", ring AS (SELECT mp_id, list_concat(q, q[1:3]) AS c FROM vec)").replace("FROM vec ", "FROM ring "))
def circular_baseline(spark, sf):
    """W14"""
    return P.profiles(spark, sf).select("mp_id", r4(V.circular_floor(F.col("q"))).alias("floor"))


@query(_vec("round(list_sort(c[i:i + 8])[2], 4) AS low, CAST(i - 1 AS INTEGER) AS slot", ", ring AS (SELECT mp_id, list_concat(list_concat([q[1], q[1], q[1], q[1]], q), [q[64], q[64], q[64], q[64]]) AS c FROM vec)").replace("FROM vec ", "FROM ring, range(1, 65) t(i) "))
def rolling_order_stat(spark, sf):
    """W12"""
    out = P.profiles(spark, sf).select("mp_id", F.posexplode(V.rank_filter(F.col("q"), 9, 0.2)).alias("slot", "low"))
    return out.select("mp_id", "slot", r4("low").alias("low"))


_FLAGS = ", x AS (SELECT mp_id, i - 1 AS k, q[i] > 0.05 AS f FROM vec, range(1, 65) t(i))"
_RUNS = _FLAGS + ", g AS (SELECT mp_id, k, k - row_number() OVER (PARTITION BY mp_id ORDER BY k) AS g FROM x WHERE f), runs AS (SELECT mp_id, min(k) AS start, count(*) AS length FROM g GROUP BY mp_id, g)"


@query(P.sql("vec") + _RUNS + " SELECT v.mp_id, CAST(coalesce(max(length), 0) AS INTEGER) AS longest FROM vec v LEFT JOIN runs ON v.mp_id = runs.mp_id GROUP BY v.mp_id")
def longest_run(spark, sf):
    """W19"""
    return P.profiles(spark, sf).select("mp_id", V.longest_run(F.transform("q", lambda x: x > 0.05)).alias("longest"))


@query(P.sql("vec") + _RUNS + """, ends AS (SELECT mp_id, max(CASE WHEN start = 0 THEN length END) AS head, max(CASE WHEN start + length = 64 THEN start END) AS tail FROM runs GROUP BY mp_id),
ring AS (SELECT r.mp_id, start, length + CASE WHEN start = tail AND head IS NOT NULL AND length < 64 THEN head ELSE 0 END AS length FROM runs r JOIN ends e ON r.mp_id = e.mp_id WHERE NOT (start = 0 AND tail IS NOT NULL AND length < 64))
SELECT mp_id, CAST(start AS INTEGER) AS start, CAST(length AS INTEGER) AS length FROM ring WHERE length >= 4""")
def circular_islands(spark, sf):
    """W18"""
    out = P.profiles(spark, sf).select("mp_id", F.explode(V.runs(F.transform("q", lambda x: x > 0.05), 4, circular=True)).alias("r"))
    return out.select("mp_id", "r.start", "r.length")


@query(P.sql("vec") + """, x AS (SELECT mp_id, i - 1 AS k, CASE WHEN q[i] > -0.1 THEN q[i] END AS v FROM vec, range(1, 65) t(i)),
n AS (SELECT mp_id, k, v, max(CASE WHEN v IS NOT NULL THEN k END) OVER (PARTITION BY mp_id ORDER BY k) AS a, min(CASE WHEN v IS NOT NULL THEN k END) OVER (PARTITION BY mp_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM x)
SELECT n.mp_id, CAST(n.k AS INTEGER) AS slot, round(CASE WHEN n.v IS NOT NULL THEN n.v WHEN n.b - n.a - 1 <= 4 THEN p.v + (q.v - p.v) * (n.k - n.a) / (n.b - n.a) END, 4) AS v
FROM n LEFT JOIN x p ON p.mp_id = n.mp_id AND p.k = n.a LEFT JOIN x q ON q.mp_id = n.mp_id AND q.k = n.b""")
def interpolate(spark, sf):
    """Gaps made where the curve is low"""
    q = F.transform("q", lambda x: F.when(x > -0.1, x))
    out = P.profiles(spark, sf).select("mp_id", F.posexplode(V.interpolate(q)).alias("slot", "v"))
    return out.select("mp_id", "slot", r4("v").alias("v"))


@query(_vec("CAST(coalesce(list_position(list_transform(q, lambda x: x > -0.1), false), 65) - 1 AS INTEGER) AS leading"))
def leading_run(spark, sf):
    """W20"""
    return P.profiles(spark, sf).select("mp_id", V.leading_run(F.transform("q", lambda x: x > -0.1)).alias("leading"))


@query(P.sql("vec") + ", c AS (SELECT mp_id, list_transform(q, lambda x: abs(x)) AS q FROM vec), r AS (SELECT mp_id, list_transform(range(0, 16), lambda i: q[CAST(floor(i * 63 / 15.0) AS BIGINT) + 1] + (q[least(CAST(floor(i * 63 / 15.0) AS BIGINT) + 2, 64)] - q[CAST(floor(i * 63 / 15.0) AS BIGINT) + 1]) * (i * 63 / 15.0 - floor(i * 63 / 15.0))) AS v, list_sum(q) AS total FROM c) SELECT mp_id, list_transform(v, lambda x: round(x * total / list_sum(v), 4)) AS v FROM r")
def resampled_shape(spark, sf):
    """Tests hold energy and shape against NumPy"""
    out = P.profiles(spark, sf).select("mp_id", V.resample(F.transform("q", lambda x: F.abs(x)), 16).alias("v"))
    return out.select("mp_id", F.transform("v", lambda x: F.round(x, 4)).alias("v"))


@query(P.sql("vec") + """, k AS (SELECT mp_id, i - 1 AS i, q[i] * 4 AS x, q[i] * 4 - q[i - 1] * 4 AS rise, list_avg(list_transform(q[i:i + 1], lambda v: v * 4)) AS level FROM vec, range(2, 65) t(i)),
r AS (SELECT mp_id, count(*) AS ramps, quantile_cont(rise, 0.5) AS rise_median, max(rise) AS rise_max, sum(sin(i * 2 * pi() / 96)) AS s, sum(cos(i * 2 * pi() / 96)) AS c FROM k WHERE rise >= 0.3 AND level >= 0.3 GROUP BY mp_id)
SELECT v.mp_id, CAST(coalesce(ramps, 0) AS INTEGER) AS ramps, round(rise_median, 4) AS rise_median, round(rise_max, 4) AS rise_max, CASE WHEN ramps > 0 THEN 1 ELSE 0 END AS days, round(CASE WHEN ramps > 0 THEN (atan2(s, c) * 24 / (2 * pi()) + 24) % 24 END, 4) AS start_mean FROM vec v LEFT JOIN r ON v.mp_id = r.mp_id""")
def timed_ramps(spark, sf):
    """Rises of a ring that last"""
    out = E.timed_ramps(P.profiles(spark, sf), ["mp_id"], "q", 0.3, 2)
    return out.withColumns({c: r4(c) for c in ("rise_median", "rise_max", "start_mean")})


@query(_vec("round(list_avg(q), 4) AS dist_mean, round(list_aggregate(q, 'stddev_pop'), 4) AS dist_std, round(list_avg(q), 4) AS dist_top, round(list_aggregate(q, 'quantile_cont', 0.99) - list_aggregate(q, 'quantile_cont', 0.5), 4) AS dist_tail, "
            + ", ".join(f"round(list_avg(list_transform(range(1, {65 - k}), lambda i: abs(q[i + {k}] - q[i]))), 4) AS multi_diff_{k}" for k in (1, 2, 4, 8))
            + ", round(-list_sum(list_transform(range(0, 10), lambda k: CASE WHEN len(list_filter(l, lambda v: v = k)) > 0 THEN len(list_filter(l, lambda v: v = k)) / 64.0 * ln(len(list_filter(l, lambda v: v = k)) / 64.0) ELSE 0 END)), 4) AS multi_entropy",
            ", lev AS (SELECT *, list_transform(q, lambda v: least(9, CAST(floor((v - list_min(q)) / greatest(list_max(q) - list_min(q), 1e-9) * 10) AS INTEGER))) AS l FROM vec)").replace("FROM vec ", "FROM lev "))
def distribution_features(spark, sf):
    """V04, V05"""
    out = E.distribution_features(P.profiles(spark, sf), ["mp_id"], "q")
    return out.select("mp_id", *[r4(c).alias(c) for c in out.columns if c != "mp_id"])


@query(_vec(", ".join(f"round(list_avg(z[{16 * b + 1}:{16 * b + 16}]), 4) AS shape_block{b}" for b in range(4)) + ", "
            + ", ".join(f"round(sqrt(list_sum(list_transform(range(0, 64), lambda k: z[k + 1] * cos(2 * pi() * {c} * k / 64))) ** 2 + list_sum(list_transform(range(0, 64), lambda k: z[k + 1] * sin(2 * pi() * {c} * k / 64))) ** 2) / 64, 4) AS fourier_{c}" for c in (1, 2, 3)),
            ", sc AS (SELECT mp_id, list_transform(q, lambda v: (v - list_aggregate(q, 'quantile_cont', 0.5)) / greatest(list_aggregate(q, 'quantile_cont', 0.95) - list_aggregate(q, 'quantile_cont', 0.05), 0.1)) AS z FROM vec)").replace("FROM vec ", "FROM sc "))
def shape_features(spark, sf):
    """V02, V05"""
    out = E.shape_features(P.profiles(spark, sf), ["mp_id"], "q", (1, 2, 3), 4)
    return out.select("mp_id", *[r4(c).alias(c) for c in out.columns if c != "mp_id"])


# -- events -----------------------------------------------------------------------
@query(P.sql("vec") + """, x AS (SELECT mp_id, i - 1 AS k, q[i] AS v, q[i] >= 0.1 AS f FROM vec, range(1, 65) t(i)),
c AS (SELECT mp_id, k, v, f OR (coalesce(lag(f) OVER w, false) AND coalesce(lead(f) OVER w, false)) AS f FROM x WINDOW w AS (PARTITION BY mp_id ORDER BY k)),
g AS (SELECT mp_id, k, v, k - row_number() OVER (PARTITION BY mp_id ORDER BY k) AS g FROM c WHERE f)
SELECT mp_id, CAST(min(k) AS INTEGER) AS start, CAST(count(*) AS INTEGER) AS length, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.9), 4) AS p90, round(sum(v), 4) AS energy FROM g GROUP BY mp_id, g HAVING count(*) >= 4""")
def block_events(spark, sf):
    """E01, Y04"""
    e = E.block_events(P.profiles(spark, sf), ["mp_id"], "q", 0.1)
    return e.select("mp_id", "start", "length", r4("median").alias("median"), r4("p90").alias("p90"), r4("energy").alias("energy"))


@query(P.STEPS + "SELECT mp_id, start, length, round(excess, 4) AS excess FROM found")
def sequential_events(spark, sf):
    """Stateful scan"""
    return E.sequential_events(P.profiles(spark, sf), ["mp_id"], "q", 0.1, 0.6, 2).withColumn("excess", r4("excess"))


@query(P.sql("vec") + """, ring AS (SELECT mp_id, q, list_min(list_transform(range(1, 65), lambda i: (list_concat(q, q[1:3])[i] + list_concat(q, q[1:3])[i + 1] + list_concat(q, q[1:3])[i + 2] + list_concat(q, q[1:3])[i + 3]) / 4)) AS f FROM vec),
x AS (SELECT mp_id, i - 1 AS k, (q[i] - f) * 4 >= 0.9 AS f FROM ring, range(1, 65) t(i)),
g AS (SELECT mp_id, k, k - row_number() OVER (PARTITION BY mp_id ORDER BY k) AS g FROM x WHERE f), runs AS (SELECT mp_id, min(k) AS start, count(*) AS length FROM g GROUP BY mp_id, g),
ends AS (SELECT mp_id, max(CASE WHEN start = 0 THEN length END) AS head, max(CASE WHEN start + length = 64 THEN start END) AS tail FROM runs GROUP BY mp_id),
p AS (SELECT r.mp_id, start, length + CASE WHEN start = tail AND head IS NOT NULL AND length < 64 THEN head ELSE 0 END AS length FROM runs r JOIN ends e ON r.mp_id = e.mp_id WHERE NOT (start = 0 AND tail IS NOT NULL AND length < 64)),
v AS (SELECT p.mp_id, start, length, (list_aggregate(list_concat(q, q)[start + 1:start + length], 'quantile_cont', 0.5) - f) * 4 AS kw FROM p JOIN ring ON p.mp_id = ring.mp_id WHERE length >= 4)
SELECT mp_id, CAST(start AS INTEGER) AS start, CAST(length AS INTEGER) AS length, round(kw, 4) AS amplitude_kw, start + length > 64 AS wraps, CASE WHEN kw >= 1.5 THEN 'resistance_boiler' WHEN kw BETWEEN 0.25 AND 1.2 AND length / 4.0 BETWEEN 1.5 AND 9 THEN 'wpb_candidate' ELSE 'other' END AS class FROM v""")
def plateaus(spark, sf):
    """E05, E06"""
    p = E.plateaus(P.profiles(spark, sf), ["mp_id"], "q", "q", 0.9, 1.0)
    return p.select("mp_id", "start", "length", r4("amplitude_kw").alias("amplitude_kw"), "wraps", E.plateau_class(F.col("amplitude_kw"), F.col("hours")).alias("class"))


@query("SELECT s_suppkey, round(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 0.5 + 0.3 * least(a, b) / greatest(a, b) + 0.2 * greatest(0, 1 - least(abs(s - w) / 4.0, 24 - abs(s - w) / 4.0) / 3) WHEN a IS NOT NULL OR b IS NOT NULL THEN 0.35 ELSE 0 END, 6) AS score FROM (SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS a, CASE WHEN s_nationkey > 5 THEN s_nationkey END AS b, s_suppkey % 96 AS s, s_suppkey * 7 % 96 AS w FROM supplier)")
def two_season_score(spark, sf):
    """E07, E13"""
    a, b = F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")), F.when(F.col("s_nationkey") > 5, F.col("s_nationkey"))
    return P.load(spark, sf, "supplier").select("s_suppkey", F.round(E.two_season_score(a, b, F.col("s_suppkey") % 96, F.col("s_suppkey") * 7 % 96), 6).alias("score"))


@query("SELECT c_custkey, CASE WHEN c_acctbal > 8000 AND NOT c_nationkey < 5 THEN 1 WHEN c_nationkey < 5 AND NOT c_acctbal > 8000 THEN 0 ELSE CAST(c_custkey % 2 AS INTEGER) END AS predicted, CASE WHEN c_acctbal / 100000 <= 0.0625 THEN 'quiet' WHEN c_acctbal / 100000 <= 0.125 THEN 'medium' ELSE 'noisy' END AS band FROM customer")
def score_override(spark, sf):
    """E12, E10"""
    return P.load(spark, sf, "customer").select("c_custkey", E.override((F.col("c_custkey") % 2).cast("int"), F.col("c_acctbal") > 8000, F.col("c_nationkey") < 5).alias("predicted"), E.noise_band(F.col("c_acctbal") / 100000).alias("band"))


@query(P.sql("facts") + """, m AS (SELECT mp_id, sum(n_days) AS days, sum(n_days) FILTER (register = 'export') AS export_days, sum(kwh) FILTER (register = 'export') AS export_kwh, sum(kwh) FILTER (register = 'import') AS import_kwh, max(month) * 4 AS peak_slot FROM facts GROUP BY mp_id),
p AS (SELECT *, coalesce(export_days / days > 0.95 AND coalesce(import_kwh, 0) < 0.01 * export_kwh, false) AS is_production FROM m)
SELECT mp_id, is_production, coalesce(export_days >= 30 AND peak_slot BETWEEN 44 AND 60 AND export_days / days >= 0.5, false) AND NOT is_production AS is_silver FROM p""")
def silver_rules(spark, sf):
    """E14"""
    of = lambda c, s: F.sum(F.when(F.col("register") == s, F.col(c)))
    m = P.facts(spark, sf).groupBy("mp_id").agg(F.sum("n_days").alias("days"), of("n_days", "export").alias("export_days"), of("kwh", "export").alias("export_kwh"), of("kwh", "import").alias("import_kwh"), (F.max("month") * 4).alias("peak_slot"))
    return E.silver_flags(m).select("mp_id", "is_production", "is_silver")


@query(P.sql("vec") + "SELECT mp_id, CASE WHEN list_sum(list_transform(q[11:18], lambda x: abs(x))) <> 0 THEN 2.0 END AS added FROM vec")
def injected_events(spark, sf):
    """Tests hold the energy against what was injected"""
    v = P.profiles(spark, sf).withColumn("q", F.transform("q", lambda x: F.abs(x)))
    event = F.slice("q", 11, 8)
    out = E.inject(F.col("q"), event, F.lit(60), F.lit(2.0))
    return v.select("mp_id", r4(V.total(out) - V.total(F.col("q"))).alias("added"))


# -- labels and evaluation -----------------------------------------------------------
def predicted(spark, sf):
    return P.scored(spark, sf).withColumn("predicted", (F.col("score") >= 1500).cast("int"))


_CONF = "count(*) FILTER (label = 1 AND p = 1) AS tp, count(*) FILTER (label = 0 AND p = 1) AS fp, count(*) FILTER (label = 0 AND p = 0) AS tn, count(*) FILTER (label = 1 AND p = 0) AS fn"


@query(P.sql("scored") + f", c AS (SELECT lang, {_CONF} FROM (SELECT *, CASE WHEN score >= 1500 THEN 1 ELSE 0 END AS p FROM scored) GROUP BY lang) SELECT lang, tp, fp, tn, fn, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END, 6) AS mcc FROM c")
def confusion_metrics(spark, sf):
    """L12, L13, A47"""
    out = S.confusion(predicted(spark, sf), "label", "predicted", ["lang"])
    return out.select("lang", "tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1", "mcc")])


@query(P.sql("scored") + ", k AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM scored), n AS (SELECT sum(r) FILTER (label = 1) AS s, CAST(count(*) FILTER (label = 1) AS DOUBLE) AS p, CAST(count(*) FILTER (label = 0) AS DOUBLE) AS n FROM k) SELECT round((s - p * (p + 1) / 2) / (p * n), 6) AS roc_auc FROM n")
def roc_auc(spark, sf):
    """L12"""
    return S.roc_auc(P.scored(spark, sf), "label", "score").select(F.round("roc_auc", 6).alias("roc_auc"))


@query(P.sql("scored") + ", g AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) AS n FROM scored GROUP BY score), c AS (SELECT p, sum(p) OVER w AS tp, sum(n) OVER w AS a FROM g WINDOW w AS (ORDER BY score DESC)) SELECT round(sum(p * tp / a) / sum(p), 6) AS average_precision FROM c")
def average_precision(spark, sf):
    """L12"""
    return S.average_precision(P.scored(spark, sf), "label", "score").select(F.round("average_precision", 6).alias("average_precision"))


@query(P.sql("scored") + f", c AS (SELECT threshold, {_CONF}, count(*) AS n FROM (SELECT label, threshold, CASE WHEN score >= threshold THEN 1 ELSE 0 END AS p FROM scored, (SELECT unnest([500.0, 1000.0, 2000.0, 4000.0])::DOUBLE AS threshold)) GROUP BY threshold) SELECT threshold, tp, fp, tn, fn, round((tp + fp) / n, 6) AS flag_rate, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy FROM c")
def threshold_sweep(spark, sf):
    """A46"""
    out = S.sweep(P.scored(spark, sf), "label", "score", [500, 1000, 2000, 4000])
    return out.select("threshold", "tp", "fp", "tn", "fn", F.round("flag_rate", 6).alias("flag_rate"), F.round("balanced_accuracy", 6).alias("balanced_accuracy"))


@query(P.sql("scored") + """, g AS (SELECT score AS t, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM scored GROUP BY score UNION ALL SELECT 1.0000000000000002, 0, 0),
c AS (SELECT t, sum(p) OVER w AS tp, sum(n) OVER w AS fp, (SELECT sum(p) FROM g) AS ap, (SELECT sum(n) FROM g) AS an FROM g WINDOW w AS (ORDER BY t DESC)),
m AS (SELECT t, (tp / ap + (an - fp) / an) / 2 AS ba, CASE WHEN 2 * tp + fp + ap - tp > 0 THEN 2 * tp / (2 * tp + fp + ap - tp) ELSE 0 END AS f1 FROM c)
SELECT t AS threshold, round(ba, 6) AS balanced_accuracy, round(f1, 6) AS f1 FROM m ORDER BY ba DESC, f1 DESC, t DESC LIMIT 1""")
def choose_threshold(spark, sf):
    """L11, M14"""
    out = S.choose_threshold(P.scored(spark, sf), "label", "score")
    return out.select("threshold", F.round("balanced_accuracy", 6).alias("balanced_accuracy"), F.round("f1", 6).alias("f1"))


@query(P.sql("scored") + ", g AS (SELECT score AS t, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM scored GROUP BY score), c AS (SELECT t, sum(p) OVER w / (SELECT sum(p) FROM g) - sum(n) OVER w / (SELECT sum(n) FROM g) AS j FROM g WINDOW w AS (ORDER BY t DESC)) SELECT round(j, 6) AS j, t AS threshold FROM c ORDER BY c.j DESC, t DESC LIMIT 1")
def youden_threshold(spark, sf):
    """L16"""
    return S.youden(P.scored(spark, sf), "label", "score").select(F.round("j", 6).alias("j"), "threshold")


@query(P.sql("scored") + ", f AS (SELECT 'score' AS feature, label, score AS v FROM scored UNION ALL SELECT 'quality', label, quality FROM scored), m AS (SELECT feature, count(v) FILTER (label = 0) AS n0, count(v) FILTER (label = 1) AS n1, avg(v) FILTER (label = 0) AS m0, avg(v) FILTER (label = 1) AS m1, var_samp(v) FILTER (label = 0) AS v0, var_samp(v) FILTER (label = 1) AS v1 FROM f GROUP BY feature) SELECT feature, round((m1 - m0) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)), 6) AS d FROM m")
def cohens_d(spark, sf):
    """A48"""
    return S.cohens_d(P.scored(spark, sf), "label", ["score", "quality"]).select("feature", F.round("d", 6).alias("d"))


@query("WITH k AS (SELECT rank() OVER (ORDER BY s_acctbal) + (count(*) OVER (PARTITION BY s_acctbal) - 1) / 2.0 AS a, rank() OVER (ORDER BY s_nationkey) + (count(*) OVER (PARTITION BY s_nationkey) - 1) / 2.0 AS b FROM supplier) SELECT round(corr(a, b), 6) AS rho, count(*) AS n FROM k")
def spearman(spark, sf):
    """L20, A30"""
    return S.spearman(P.load(spark, sf, "supplier"), "s_acctbal", "s_nationkey").select(F.round("rho", 6).alias("rho"), "n")


@query(P.sql("scored") + ", s AS (SELECT label, 1 - exp(-score / 3000) AS p FROM scored), t AS (SELECT CAST(k / 20.0 AS DOUBLE) AS threshold FROM range(0, 21) r(k)), c AS (SELECT threshold, avg(CASE WHEN p >= threshold THEN 1.0 ELSE 0 END) FILTER (label = 1) AS recall, avg(CASE WHEN p >= threshold THEN 1.0 ELSE 0 END) AS flagged FROM s, t GROUP BY threshold) SELECT threshold, round(recall, 6) AS recall, round(flagged, 6) AS flagged, round(CASE WHEN flagged > 0 THEN least(1, recall * 0.3 / flagged) END, 6) AS precision, round(greatest(0, least(1, (flagged - recall * 0.3) / 0.7)), 6) AS fpr FROM c")
def pu_pr_curve(spark, sf):
    """L15, M02"""
    s = P.scored(spark, sf).withColumn("p", 1 - F.exp(-F.col("score") / 3000))
    out = S.pu_curve(s, "label", "p", 0.3, 21)
    return out.select("threshold", *[F.round(c, 6).alias(c) for c in ("recall", "flagged", "precision", "fpr")])


@query("WITH s AS (SELECT s_suppkey / 100.0 AS x, s_acctbal AS y FROM supplier), w AS (SELECT (x - lag(x) OVER (ORDER BY x)) * (y + lag(y) OVER (ORDER BY x)) / 2 AS a FROM s) SELECT round(sum(a), 6) AS area FROM w")
def trapezoid_area(spark, sf):
    """M10"""
    s = P.load(spark, sf, "supplier").select((F.col("s_suppkey") / 100).alias("x"), F.col("s_acctbal").alias("y"))
    return S.trapezoid(s, "x", "y").select(F.round("area", 6).alias("area"))


@query(P.sql("scored") + ", w AS (SELECT lang, label, score, count(*) OVER (PARTITION BY lang) AS n FROM scored) SELECT lang, round(sum((SELECT count(*) FROM scored) / (SELECT count(DISTINCT lang) FROM scored) / CAST(n AS DOUBLE)), 4) AS weight FROM w GROUP BY lang")
def equal_weights(spark, sf):
    """L04"""
    return L.equal_weights(P.scored(spark, sf), "lang").groupBy("lang").agg(r4(F.sum("weight")).alias("weight"))


@query("""WITH c AS (SELECT o_custkey AS gp_nr, min(year(o_orderdate)) AS y0 FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), y AS (SELECT DISTINCT o_custkey AS gp_nr, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders), l AS (SELECT gp_nr, max(year) AS last FROM y GROUP BY ALL)
SELECT y.gp_nr, year, CASE WHEN y0 IS NOT NULL THEN CASE WHEN year > y0 THEN 'P' WHEN year < y0 THEN 'U' ELSE 'DROP' END WHEN year = last THEN 'U' ELSE 'DROP' END AS role FROM y JOIN l ON y.gp_nr = l.gp_nr LEFT JOIN c ON y.gp_nr = c.gp_nr""")
def positive_unlabelled(spark, sf):
    """L10"""
    o = P.load(spark, sf, "orders")
    c = o.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("gp_nr")).agg(F.to_date(F.min("o_orderdate")).alias("commissioned"))
    y = o.select(F.col("o_custkey").alias("gp_nr"), F.year("o_orderdate").alias("year")).distinct().join(c, "gp_nr", "left").withColumn("label", F.lit(0))
    return L.positive_unlabelled(y).select("gp_nr", "year", "role")


@query("WITH g AS (SELECT c_nationkey AS k, c_acctbal AS v FROM customer), m AS (SELECT quantile_cont(v, 0.5) AS m FROM (SELECT CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS v FROM customer)) SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal ELSE (SELECT m FROM m) END AS v, CASE WHEN c_custkey % 4 <> 0 THEN 0 ELSE 1 END AS v_missing FROM customer")
def impute_median(spark, sf):
    """A quarter of the values is taken away to be filled in"""
    c = P.load(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("v"))
    return L.impute_median(c, ["v"])


@query(P.sql("scored") + f""", g AS (SELECT doc_id, max(label) AS label FROM scored GROUP BY doc_id), p AS (SELECT doc_id, label, (row_number() OVER (PARTITION BY label ORDER BY {P.NUMBER.format("'0', CAST(doc_id AS VARCHAR)")}, doc_id) - 0.5) / count(*) OVER (PARTITION BY label) AS placed FROM g)
SELECT doc_id, label, CASE WHEN placed < 0.6::DOUBLE THEN 'train' WHEN placed < 0.8::DOUBLE THEN 'validation' ELSE 'test' END AS split FROM p""")
def stratified_split(spark, sf):
    """Drawn by hash; tests assert that splits are disjoint, stratified and stable"""
    return L.split_groups(P.scored(spark, sf), "doc_id", "label")


@query(P.sql("scored") + f""", w AS (SELECT b, label, score >= 1500 AS a, score >= 3000 AS z, {draws.sql_poisson("u")} AS w FROM (SELECT *, {draws.SQL_UNIFORM.format("'0', CAST(doc_id AS VARCHAR), CAST(b AS VARCHAR)")} AS u FROM scored, range(100) t(b))),
m AS (SELECT b, (sum(CASE WHEN z THEN w ELSE 0 END) FILTER (label = 1) / sum(w) FILTER (label = 1) + sum(CASE WHEN NOT z THEN w ELSE 0 END) FILTER (label = 0) / sum(w) FILTER (label = 0)
  - sum(CASE WHEN a THEN w ELSE 0 END) FILTER (label = 1) / sum(w) FILTER (label = 1) - sum(CASE WHEN NOT a THEN w ELSE 0 END) FILTER (label = 0) / sum(w) FILTER (label = 0)) / 2 AS v FROM w WHERE w > 0 GROUP BY b)
SELECT round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, count(*) AS resamples FROM m WHERE v IS NOT NULL""")
def bootstrap_interval(spark, sf):
    """L14, L21, Y05"""
    d = predicted(spark, sf).withColumn("other", (F.col("score") >= 3000).cast("int"))
    out = S.paired_gain(d, "label", "predicted", "other", 100, key="doc_id")
    return out.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "resamples")


@query(P.sql("facts") + """, f AS (SELECT mp_id, sum(kwh) FILTER (year = 1997) - sum(kwh) FILTER (year = 1996) AS d FROM facts GROUP BY mp_id), k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM f WHERE d <> 0),
w AS (SELECT sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, count(*)::DOUBLE AS n FROM k) SELECT w_plus, n, round((w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24), 6) AS z FROM w""")
def signed_ranks(spark, sf):
    """L17"""
    f = P.facts(spark, sf).groupBy("mp_id").agg(F.sum(F.when(F.col("year") == 1996, F.col("kwh"))).alias("a"), F.sum(F.when(F.col("year") == 1997, F.col("kwh"))).alias("b"))
    return S.wilcoxon(f, "a", "b").select("w_plus", "n", F.round("z", 6).alias("z"))


def _newton(rounds: int = 12) -> str:
    """The optimum of the balanced, penalised likelihood of two scaled features, by Newton's steps."""
    steps = ["t0 AS (SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2)"]
    for k in range(rounds):
        steps.append(f"""g{k} AS (SELECT sum(r) AS g0, sum(r * u) - any_value(b1) / any_value(n) AS g1, sum(r * v) - any_value(b2) / any_value(n) AS g2, sum(h) AS h00, sum(h * u) AS h01, sum(h * v) AS h02, sum(h * u * u) + 1 / any_value(n) AS h11, sum(h * u * v) AS h12, sum(h * v * v) + 1 / any_value(n) AS h22, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2
  FROM (SELECT *, w * (y - p) AS r, w * p * (1 - p) AS h FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * u + b2 * v))) AS p FROM z, t{k})))""")
        steps.append(f"""t{k + 1} AS MATERIALIZED (SELECT b0 + (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / d AS b0, b1 + (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / d AS b1,
  b2 + (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / d AS b2 FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS d FROM g{k}))""")
    return ", ".join(steps) + f", fit AS (SELECT * FROM t{rounds})"


@query("WITH RECURSIVE " + P.SQL["scored"] + """, x AS (SELECT doc_id, ln(1 + score) AS a, CAST(quality AS DOUBLE) AS b, CAST(label AS DOUBLE) AS y FROM scored), m AS (SELECT avg(a) AS ma, stddev_samp(a) AS sa, avg(b) AS mb, stddev_samp(b) AS sb, CAST(count(*) AS DOUBLE) AS n, sum(y) AS np FROM x),
z AS MATERIALIZED (SELECT doc_id, y, (a - ma) / sa AS u, (b - mb) / sb AS v, n, CASE WHEN y = 1 THEN 1 / (2 * np) ELSE 1 / (2 * (n - np)) END AS w FROM x, m), """ + _newton() + """,
s AS MATERIALIZED (SELECT doc_id, y, n, 1 / (1 + exp(-(b0 + b1 * u + b2 * v))) AS score FROM z, fit), c AS (SELECT avg(score) FILTER (y = 1) AS c FROM s),
q AS MATERIALIZED (SELECT doc_id, n, score, greatest(1e-6, least(1 - 1e-6, least(score / c, 1))) AS p FROM s, c), bins AS MATERIALIZED (SELECT round(ln(p / (1 - p)) * 64) / 64 AS x, count(*) AS k, any_value(n) AS n FROM q GROUP BY ALL),
edge AS (SELECT sum(k / (1 + exp(-(x - 10)))) / any_value(n) - 0.3 AS low, sum(k / (1 + exp(-(x + 10)))) / any_value(n) - 0.3 AS high FROM bins),
bis AS (SELECT 0 AS i, -10.0::DOUBLE AS lo, 10.0::DOUBLE AS hi UNION ALL SELECT i + 1, CASE WHEN f * (SELECT low FROM edge) > 0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN f * (SELECT low FROM edge) > 0 THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT i, lo, hi, sum(k / (1 + exp(-(x + (lo + hi) / 2)))) / any_value(n) - 0.3 AS f FROM bis, bins WHERE i < 80 GROUP BY i, lo, hi)),
gamma AS (SELECT CASE WHEN low * high > 0 THEN 0 ELSE (SELECT (lo + hi) / 2 FROM bis WHERE i = 80) END AS g FROM edge)
SELECT doc_id, round(score, 4) AS score, round(1 / (1 + exp(-(ln(p / (1 - p)) + g))), 4) AS p FROM q, gamma""")
def logistic_scores(spark, sf):
    """The fit against the optimum that Newton's steps find"""
    from ..operators import models as M

    x = P.scored(spark, sf).withColumn("log_chars", F.log1p("score")).withColumnRenamed("score", "n_chars")
    scored = M.score(M.fit_logistic(x, ["log_chars", "quality"], "label"), x)
    return M.elkan_noto(scored, "label", prior=0.3).select("doc_id", r4("score").alias("score"), r4("p").alias("p"))