"""Queries of week events and feature families, over weeks made of the profiles' rings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import families as K
from ..operators import relational as R
from . import proxies as P
from .registry import query

r4 = lambda c: F.round(c, 4)
r9 = lambda c: F.round(c, 9)
#: A week of 672 slots: the ring of 64, doubled, and moved on by five slots each day.
_WEEK = P.sql("vec") + ", x AS (SELECT mp_id, CAST(k AS INTEGER) AS k, CAST(k // 96 AS INTEGER) AS d, CAST(k % 96 AS INTEGER) AS s, 4.0 * (2.0 * q[(k + 5 * (k // 96)) % 64 + 1]) AS x FROM vec, range(0, 672) t(k))"


def weeks(spark, sf):
    """(mp_id, q): 672 slots"""
    at = lambda k: F.get("q", ((k + 5 * F.floor(k / 96)) % 64).cast("int"))
    return P.profiles(spark, sf).select("mp_id", F.transform(F.sequence(F.lit(0), F.lit(671)), lambda k: 2.0 * at(k)).alias("q"))


_EVENTS = _WEEK + """, base AS (SELECT mp_id, d, quantile_cont(x, 0.2) AS base FROM x GROUP BY ALL),
r AS (SELECT x.*, x.x - base AS res, x.x - base >= 1.0 AS high FROM x JOIN base ON x.mp_id = base.mp_id AND x.d = base.d),
c AS (SELECT *, high OR (coalesce(lag(high) OVER w, false) AND coalesce(lead(high) OVER w, false)) AS m, coalesce(x - lag(x) OVER w, 0) AS up, coalesce(x - lead(x) OVER w, 0) AS down FROM r WINDOW w AS (PARTITION BY mp_id ORDER BY k)),
g AS (SELECT *, k - row_number() OVER (PARTITION BY mp_id ORDER BY k) AS g FROM c WHERE m),
e AS (SELECT mp_id, g, min(k) AS s, max(k) + 1 AS e, count(*) AS n, quantile_cont(res, 0.5) AS power, quantile_cont(res, 0.9) AS power90, sum(greatest(res, 0)) / 4 AS energy, (arg_max(res, k) - arg_min(res, k)) / greatest(count(*) - 1, 1) AS slope,
  arg_min(up, k) AS rise, arg_max(down, k) AS fall, avg(CASE WHEN x < 0 THEN 1.0 ELSE 0 END) AS negative_share, avg(CASE WHEN x < 0 AND k % 96 >= 40 AND k % 96 < 60 THEN 1.0 ELSE 0 END) AS midday_export_share,
  avg(CASE WHEN high THEN 0.0 ELSE 1 END) AS interrupted_share FROM g GROUP BY mp_id, g HAVING count(*) >= 4),
f AS (SELECT e.mp_id, e.s, quantile_cont(abs(res - power), 0.5) AS mad, avg(CASE WHEN abs(res - power) <= greatest(0.5, 0.2 * power) THEN 1.0 ELSE 0 END) AS plateau,
  least(avg(abs(res / greatest(power, 0.1) - 1)), avg(abs(res / greatest(power, 0.1) - (1.2 - 0.4 * (k - e.s) / greatest(n - 1, 1))))) AS miss FROM e JOIN g ON e.mp_id = g.mp_id AND e.g = g.g GROUP BY e.mp_id, e.s),
near AS (SELECT e.mp_id, e.s, max(abs(c.up)) AS nearby_ramp FROM e JOIN c ON e.mp_id = c.mp_id AND c.k > e.s - 4 AND c.k > 0 AND c.k < e.e + 4 GROUP BY ALL),
events AS (SELECT e.mp_id, e.s AS start, e.e AS "end", n / 4.0 AS duration, power, power90, energy, mad, slope, plateau, rise, fall, least(greatest(rise, 0), greatest(fall, 0)) / greatest(abs(rise), abs(fall), 0.1) AS symmetry, e.s // 96 AS day,
  (e.e - 1) // 96 <> e.s // 96 AS cross_midnight, negative_share, midday_export_share, interrupted_share, nearby_ramp, 1 / (1 + miss) AS template, (e.s % 96) / 4.0 AS start_hour, (e.e % 96) / 4.0 AS end_hour
  FROM e JOIN f ON e.mp_id = f.mp_id AND e.s = f.s JOIN near ON e.mp_id = near.mp_id AND e.s = near.s)"""
_MEASURES = ("duration", "power", "power90", "energy", "mad", "slope", "plateau", "rise", "fall", "symmetry", "negative_share", "midday_export_share", "interrupted_share", "nearby_ramp", "template", "start_hour", "end_hour")


#: The same over the second baseline: the seventh of the 33 slots around each, the ends repeated.
_ROLLING = _EVENTS.replace(
    """base AS (SELECT mp_id, d, quantile_cont(x, 0.2) AS base FROM x GROUP BY ALL),
r AS (SELECT x.*, x.x - base AS res, x.x - base >= 1.0 AS high FROM x JOIN base ON x.mp_id = base.mp_id AND x.d = base.d),""",
    """whole AS (SELECT mp_id, list(x ORDER BY k) AS all_x FROM x GROUP BY mp_id), r0 AS (SELECT x.*, list_sort(list_transform(range(k - 16, k + 17), lambda i: all_x[least(greatest(i, 0), 671) + 1]))[7] AS base FROM x JOIN whole ON x.mp_id = whole.mp_id),
r AS (SELECT * EXCLUDE (base), x - base AS res, x - base >= 1.0 AS high FROM r0),""",
)


def events(spark, sf):
    return E.load_events(weeks(spark, sf), ["mp_id"], amplitude=1.0)


@query(_EVENTS + ' SELECT mp_id, start, "end", CAST(day AS INTEGER) AS day, cross_midnight, ' + ", ".join(f"round({c}, 9) AS {c}" for c in _MEASURES) + " FROM events")
def load_events(spark, sf):
    """22 columns of every event"""
    e = events(spark, sf)
    return e.select("mp_id", "start", "end", "day", "cross_midnight", *[r9(c).alias(c) for c in _MEASURES])


@query(_ROLLING + ' SELECT mp_id, start, "end", CAST(day AS INTEGER) AS day, cross_midnight, ' + ", ".join(f"round({c}, 9) AS {c}" for c in _MEASURES) + " FROM events")
def load_events_rolling(spark, sf):
    """Events over the rolling baseline"""
    e = E.load_events(weeks(spark, sf), ["mp_id"], amplitude=1.0, residual="rolling_q20")
    return e.select("mp_id", "start", "end", "day", "cross_midnight", *[r9(c).alias(c) for c in _MEASURES])


_FEATURES = ("count", "days", "duration", "energy", "longest", "power", "plateau", "paired", "repetition", "template", "night", "negative", "interruptions")
_BY_WEEK = """{n} AS (SELECT a.mp_id, count(*)::DOUBLE AS event_count, count(DISTINCT day)::DOUBLE AS event_days, sum(duration) AS event_duration, sum(energy) AS event_energy, max(duration) AS event_longest, quantile_cont(power, 0.5) AS event_power, avg(plateau) AS event_plateau,
  avg(CASE WHEN rise > 0.8 AND fall > 0.8 AND symmetry > 0.3 THEN 1.0 ELSE 0 END) AS event_paired, max(rep)::DOUBLE AS event_repetition, avg(template) AS event_template, avg(CASE WHEN start_hour < 6 OR start_hour >= 22 THEN 1.0 ELSE 0 END) AS event_night, avg(negative_share) AS event_negative, avg(interrupted_share) AS event_interruptions
  FROM {n}_e a JOIN (SELECT a.mp_id, a.start, count(DISTINCT b.day) AS rep FROM {n}_e a JOIN {n}_e b ON a.mp_id = b.mp_id AND abs(a.power - b.power) <= 0.3 GROUP BY ALL) r ON a.mp_id = r.mp_id AND a.start = r.start GROUP BY a.mp_id)"""
_ROW = "SELECT v.mp_id, '{f}' AS family, " + ", ".join(f"round(coalesce(event_{c}, 0), 9) AS event_{c}" for c in _FEATURES) + ", round((1 - exp(-coalesce(event_count, 0) / 2)) * {w}, 9) AS score FROM vec v LEFT JOIN {n} ON v.mp_id = {n}.mp_id"


@query(_EVENTS + ", b_e AS (SELECT * FROM events WHERE duration >= 1.5), p_e AS (SELECT * FROM b_e WHERE mad / greatest(power, 0.1) <= 0.3 AND rise >= 0.8 AND fall >= 0.8 AND symmetry >= 0.3), " + _BY_WEEK.format(n="b") + ", " + _BY_WEEK.format(n="p") + " "
       + " UNION ALL ".join(_ROW.format(f=f, w=w, n=n) for f, w, n in (("block", "1", "b"), ("template", "coalesce(event_template, 0)", "b"), ("repeat_block", "least(coalesce(event_repetition, 0) / 2, 1)", "b"), ("plateau", "1", "p"), ("repeat_plateau", "least(coalesce(event_repetition, 0) / 2, 1)", "p"))))
def load_event_features(spark, sf):
    """13 columns and the score of each family; repetition by like power"""
    w, e = weeks(spark, sf), events(spark, sf)
    out = [E.event_features(w, e, ["mp_id"], f, tolerance=0.3).withColumn("family", F.lit(f)) for f in ("block", "template", "repeat_block", "plateau", "repeat_plateau")]
    return R.stacked(*out).select("mp_id", "family", *[r9(f"event_{c}").alias(f"event_{c}") for c in _FEATURES], r9("score").alias("score"))


@query(_EVENTS + ", s AS (SELECT mp_id, count(*) AS n, max(rise) AS r FROM events WHERE duration >= 1 AND rise >= 1 AND power > 0 AND mad / greatest(power, 0.1) <= 0.3 AND fall >= 0.5 AND symmetry >= 0.3 GROUP BY ALL) SELECT v.mp_id, coalesce(n, 0) AS strong_event_count, round(coalesce(r, 0), 9) AS maximum_rise FROM vec v LEFT JOIN s ON v.mp_id = s.mp_id")
def edge_evidence(spark, sf):
    """E03"""
    return E.edge_evidence(weeks(spark, sf), events(spark, sf), ["mp_id"], paired=True).withColumn("maximum_rise", r9("maximum_rise"))


_TIMED = ("ramp_count", "all_ramp_count", "sustained_count", "paired_count", "active_days", "cross_midnight_count", "max_rise_kw", "median_rise_kw", "mean_level_kw", "mean_plateau_cv", "mean_edge_symmetry", "start_concentration", "start_sin", "start_cos")
_TIMED_SQL = """, d AS (SELECT *, x - coalesce(lag(x) OVER (PARTITION BY mp_id ORDER BY k), x) AS delta FROM x),
l AS (SELECT mp_id, list(x ORDER BY k) AS xs, list(delta ORDER BY k) AS ds FROM d GROUP BY mp_id),
a AS (SELECT d.mp_id, k, d, s, delta AS rise, xs, ds FROM d JOIN l ON d.mp_id = l.mp_id WHERE delta >= 2),
c AS (SELECT mp_id, k, d, s, rise, list_aggregate(xs[k - 3:k], 'quantile_cont', 0.5) AS base, xs[k + 1:k + 6] AS part, list_aggregate(xs[k + 1:k + 6], 'quantile_cont', 0.5) AS mid, greatest(0, coalesce(-list_min(ds[k + 7:k + 38]), 0)) AS fall
  FROM a WHERE (s >= 72 OR s < 24) AND k >= 4 AND k + 6 <= 672),
j AS (SELECT mp_id, d, s, rise, mid - base AS level, list_aggregate(list_transform(part, lambda v: abs(v - mid)), 'quantile_cont', 0.5) / greatest(abs(mid - base), 0.1) AS cv, len(list_filter(part, lambda v: v < base + 0.6 * rise)) <= 1 AS sustained,
  fall >= 0.5 * rise AS falls, least(rise, fall) / greatest(rise, fall, 0.1) AS symmetry FROM c),
t AS (SELECT mp_id, count(*) AS ramp_count, count(*) FILTER (sustained) AS sustained_count, count(*) FILTER (sustained AND falls) AS paired_count, count(DISTINCT d) FILTER (sustained) AS active_days, count(*) FILTER (s + 6 > 96) AS cross_midnight_count, max(rise) AS max_rise_kw,
  quantile_cont(rise, 0.5) AS median_rise_kw, avg(level) AS mean_level_kw, avg(cv) AS mean_plateau_cv, avg(symmetry) AS mean_edge_symmetry, avg(sin(s * 2 * pi() / 96)) AS start_sin, avg(cos(s * 2 * pi() / 96)) AS start_cos FROM j GROUP BY mp_id),
n AS (SELECT mp_id, count(*) AS all_ramp_count FROM a GROUP BY mp_id),
timed AS (SELECT v.mp_id, t.*, all_ramp_count, sqrt(start_sin ** 2 + start_cos ** 2) AS start_concentration FROM vec v LEFT JOIN (SELECT mp_id AS m, * EXCLUDE (mp_id) FROM t) t ON v.mp_id = t.m LEFT JOIN n ON v.mp_id = n.mp_id)"""


@query(_WEEK + _TIMED_SQL + " SELECT mp_id, " + ", ".join(f"round(coalesce({c}, 0)::DOUBLE, 4) AS timed_{c}" for c in _TIMED) + " FROM timed")
def timed_features(spark, sf):
    """14 columns"""
    out = K.timed_features(weeks(spark, sf), ["mp_id"])
    return out.select("mp_id", *[r4(f"timed_{c}").alias(f"timed_{c}") for c in _TIMED])


_DIST = ("all_high_hours", "window_high_hours", "window_high_fraction", "all_excess_kwh", "window_excess_kwh", "window_excess_fraction", "active_days", "peak_time_concentration", "peak_time_sin", "peak_time_cos", "day_profile_consistency", "midday_negative_share",
         "window_longest_high_run_hours", "level_concentration", "level_mode_count", "level_entropy", "tail_mean_kw", "tail_area_kwh")
_DIST_SQL = """, f AS (SELECT *, s >= 72 OR s < 24 AS inside, x >= 1.5 AS high, greatest(x - 1.5, 0) AS over FROM x),
h AS (SELECT mp_id, count(*) FILTER (high) / 4.0 AS ah, count(*) FILTER (high AND inside) / 4.0 AS wh, sum(over) AS ex, sum(over) FILTER (inside) AS wex, count(DISTINCT d) FILTER (high AND inside) AS active, avg(CASE WHEN x < 0 THEN 1.0 ELSE 0 END) FILTER (s >= 40 AND s < 60) AS noon FROM f GROUP BY mp_id),
pk AS (SELECT mp_id, d, arg_max(s, (x, -s)) AS p FROM f GROUP BY ALL), pa AS (SELECT mp_id, avg(sin(p * 2 * pi() / 96)) AS ps, avg(cos(p * 2 * pi() / 96)) AS pc FROM pk GROUP BY ALL),
pr AS (SELECT mp_id, s, quantile_cont(x, 0.5) AS m FROM f GROUP BY ALL), pz AS (SELECT mp_id, s, m - avg(m) OVER (PARTITION BY mp_id) AS m FROM pr), dz AS (SELECT mp_id, d, s, x - avg(x) OVER (PARTITION BY mp_id, d) AS z FROM f),
cs AS (SELECT dz.mp_id, d, sum(z * m) / nullif(sqrt(sum(z * z)) * sqrt(sum(m * m)), 0) AS c FROM dz JOIN pz ON dz.mp_id = pz.mp_id AND dz.s = pz.s GROUP BY ALL), cn AS (SELECT mp_id, avg(coalesce(c, 0)) AS con FROM cs GROUP BY ALL),
ri AS (SELECT mp_id, high, row_number() OVER (PARTITION BY mp_id ORDER BY k) AS i FROM f WHERE inside), rg AS (SELECT mp_id, i - row_number() OVER (PARTITION BY mp_id ORDER BY i) AS g FROM ri WHERE high), rl AS (SELECT mp_id, g, count(*) AS n FROM rg GROUP BY ALL), rm AS (SELECT mp_id, max(n) / 4.0 AS run FROM rl GROUP BY ALL),
lv AS (SELECT mp_id, round_even(x / 0.5, 0) AS l, count(*) AS n FROM f WHERE high GROUP BY ALL), le AS (SELECT mp_id, max(p) AS top, count(*) AS modes, -sum(p * ln(p)) AS ent FROM (SELECT mp_id, n / sum(n) OVER (PARTITION BY mp_id) AS p FROM lv) GROUP BY ALL),
tl AS (SELECT mp_id, avg(x) AS tm, sum(over) / 4 AS ta FROM (SELECT *, row_number() OVER (PARTITION BY mp_id ORDER BY x DESC) AS n FROM f) WHERE n <= 67 GROUP BY mp_id),
dist AS (SELECT h.mp_id, ah AS all_high_hours, wh AS window_high_hours, wh / greatest(ah, 0.25) AS window_high_fraction, ex / 4 AS all_excess_kwh, wex / 4 AS window_excess_kwh, wex / greatest(ex, 0.1) AS window_excess_fraction, active AS active_days, sqrt(ps ** 2 + pc ** 2) AS peak_time_concentration,
  ps AS peak_time_sin, pc AS peak_time_cos, con AS day_profile_consistency, noon AS midday_negative_share, run AS window_longest_high_run_hours, top AS level_concentration, modes AS level_mode_count, ent AS level_entropy, tm AS tail_mean_kw, ta AS tail_area_kwh
  FROM h JOIN pa ON h.mp_id = pa.mp_id JOIN cn ON h.mp_id = cn.mp_id JOIN tl ON h.mp_id = tl.mp_id LEFT JOIN rm ON h.mp_id = rm.mp_id LEFT JOIN le ON h.mp_id = le.mp_id),
""" + ", ".join(f"m{k} AS (SELECT mp_id, quantile_cont(v, 0.95) AS multi_pos_q95_{t}m, quantile_cont(-v, 0.95) AS multi_neg_q95_{t}m, avg(abs(v)) AS multi_abs_mean_{t}m, avg(v * v) AS multi_energy_{t}m FROM (SELECT mp_id, x - lag(x, {k}) OVER (PARTITION BY mp_id ORDER BY k) AS v FROM x) WHERE v IS NOT NULL GROUP BY mp_id)" for k, t in ((1, 15), (2, 30), (4, 60), (8, 120)))  # fmt: skip
_MULTI = [f"multi_{n}_{t}m" for t in (15, 30, 60, 120) for n in ("pos_q95", "neg_q95", "abs_mean", "energy")]


@query(_WEEK + _DIST_SQL + " SELECT dist.mp_id, " + ", ".join(f"round(coalesce({c}, 0)::DOUBLE, 4) AS dist_{c}" for c in _DIST) + ", " + ", ".join(f"round({c}, 4) AS {c}" for c in _MULTI) + " FROM dist " + " ".join(f"JOIN m{k} ON dist.mp_id = m{k}.mp_id" for k in (1, 2, 4, 8)))
def week_distribution(spark, sf):
    """34 columns"""
    out = K.distribution_features(weeks(spark, sf), ["mp_id"], floor_kw=1.5)
    return out.select("mp_id", *[r4(c).alias(c) for c in [*(f"dist_{c}" for c in _DIST), *_MULTI]])


_SHAPES = [f"shape_day{d}_block{b}" for d in range(7) for b in range(4)]
_Z = ", c AS (SELECT mp_id, quantile_cont(x, 0.5) AS m, greatest(quantile_cont(x, 0.95) - quantile_cont(x, 0.05), 0.1) AS w FROM x GROUP BY mp_id), z AS (SELECT x.mp_id, k, d, s, (x - m) / w AS z FROM x JOIN c ON x.mp_id = c.mp_id)"


@query(_WEEK + _Z + " SELECT mp_id, " + ", ".join(f"round(avg(z) FILTER (d = {d} AND s // 24 = {b}), 4) AS shape_day{d}_block{b}" for d in range(7) for b in range(4)) + ", "
       + ", ".join(f"round(sqrt(sum(z * cos(2 * pi() * {k} * k / 672)) ** 2 + sum(z * sin(2 * pi() * {k} * k / 672)) ** 2) / 672, 4) AS fourier_{k}" for k in (1, 2, 3, 7, 14, 21, 28)) + " FROM z GROUP BY mp_id")
def shape_grid(spark, sf):
    """7 days by 4 blocks, 7 Fourier components"""
    out = K.shape_grid(weeks(spark, sf), ["mp_id"])
    return out.select("mp_id", *[r4(c).alias(c) for c in out.columns if c != "mp_id"])


_STATS = {f"stat_q{round(100 * p):02d}": f"quantile_cont(x, {p})" for p in (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)} | {"stat_range": "quantile_cont(x, 0.95) - quantile_cont(x, 0.05)", "stat_mean": "avg(x)", "stat_load_factor": "avg(x) / greatest(max(abs(x)), 0.1)"}
_STATS |= {f"stat_ramp{round(100 * p)}": f"quantile_cont(ramp, {p})" for p in (0.5, 0.95, 0.99)} | {"stat_night_kwh": "sum(x) FILTER (s < 24 OR s >= 88) / 4", "stat_day_kwh": "sum(x) FILTER (s >= 24 AND s < 88) / 4", "stat_weekday_daily_kwh": "sum(x) FILTER (d < 5) / 20", "stat_weekend_daily_kwh": "sum(x) FILTER (d >= 5) / 8"}
_STATS |= {f"stat_hours_above_{v}": f"count(*) FILTER (x > {v}) / 4.0" for v in (1.5, 3.0, 5.0, 7.0, 11.0)}


@query(_WEEK + ", y AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY mp_id ORDER BY k)) AS ramp FROM x) SELECT mp_id, " + ", ".join(f'round({e}, 4) AS "{n}"' for n, e in _STATS.items()) + " FROM y GROUP BY mp_id")
def compact_week(spark, sf):
    """21 statistics"""
    out = K.compact_features(weeks(spark, sf), ["mp_id"])
    return out.select("mp_id", *[r4(f"`{c}`").alias(c) for c in out.columns if c != "mp_id"])


_TOP = "round(avg({c}), 4) AS {n}_mean, round(max({c}), 4) AS {n}_max, round(list_avg(list_sort(list({c}), 'DESC')[1:3]), 4) AS {n}_top3, round(stddev_pop({c}), 4) AS {n}_std"


@query(_WEEK + _TIMED_SQL + ", w AS (SELECT CAST(label AS VARCHAR) AS customer, " + ", ".join(f"coalesce({c}, 0)::DOUBLE AS timed_{c}" for c in _TIMED) + " FROM timed JOIN vec ON timed.mp_id = vec.mp_id) SELECT customer, " + ", ".join(_TOP.format(c=f"timed_{c}", n=f"timed_{c}") for c in _TIMED) + " FROM w GROUP BY customer")
def customer_family(spark, sf):
    """The timed family over a customer's weeks"""
    w = weeks(spark, sf).join(P.profiles(spark, sf).select("mp_id", F.col("label").cast("string").alias("customer")), "mp_id")
    out = K.customer_family(w, "customer", "mp_id", "timed")
    return out.select("customer", *[r4(c).alias(c) for c in out.columns if c != "customer"])
