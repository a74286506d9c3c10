"""Battery day features and their monthly profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import battery as B
from . import proxies as P
from .registry import query

r4 = lambda c: F.round(c, 4)

#: Days of 96 slots made of the rings: import is what is above zero, export what is below; some registers and slots are missing.
_DAYS = """WITH v AS (SELECT vec_id AS id, CAST(vec_id % 40 AS VARCHAR) AS mp_id, CAST(label AS VARCHAR) AS plz, CAST(DATE '2024-01-01' + CAST(vec_id % 360 AS INTEGER) AS DATE) AS date, vec_id % 3 = 0 AS is_clear, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS q FROM embeddings),
g AS (SELECT *, 2 * pi() / 365 * (dayofyear(date) - 1) AS g FROM v),
t AS (SELECT *, 229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) AS eq, 0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS decl FROM g),
h AS (SELECT *, degrees(acos(greatest(-1, least(1, cos(radians(90.833)) / (cos(radians(47.4)) * cos(decl)) - tan(radians(47.4)) * tan(decl))))) AS half FROM t),
d AS MATERIALIZED (SELECT id, mp_id, plz, date, is_clear, q, id % 17 <> 0 AS hi, id % 19 <> 0 AS he, month(date) BETWEEN 3 AND 10 AS season, least(95, greatest(0, CAST(ceil(((720 - 4 * 8.1 - eq + 4 * half) / 60 + 1) * 4) AS INTEGER))) AS dusk,
  greatest(0, CAST(floor(((720 - 4 * 8.1 - eq - 4 * half) / 60 + 1) * 4) AS INTEGER)) AS up, least(96, CAST(ceil(((720 - 4 * 8.1 - eq + 4 * half) / 60 + 1) * 4) AS INTEGER)) AS down FROM h),
s AS MATERIALIZED (SELECT id, dusk, up, down, i, CASE WHEN hi AND (i + id) % 29 <> 0 THEN greatest(q[i % 64 + 1], 0) / 2 END AS imp, CASE WHEN he AND (i + id) % 31 <> 0 THEN greatest(-q[i % 64 + 1], 0) / 2 END AS exp FROM d, range(96) t(i)),
a AS MATERIALIZED (SELECT id, coalesce(sum(imp), 0) AS day_kwh, coalesce(sum(imp) FILTER (i BETWEEN 4 AND 15), 0) AS night_kwh, count(*) FILTER (i >= dusk AND imp < 0.01) / count(*) FILTER (i >= dusk) AS evening_zero_share,
  coalesce(min(i) FILTER (i >= dusk AND NOT coalesce(imp < 0.01, false)), 96) - any_value(dusk) AS run, coalesce(sum(imp) FILTER (i BETWEEN 44 AND 55), 0) AS mid, coalesce(sum(exp), 0) AS exp_day_kwh, max(exp) AS peak,
  CAST(min(i) FILTER (exp > 0.01) AS DOUBLE) AS exp_start_slot, CAST(max(i) FILTER (exp > 0.01) AS DOUBLE) AS exp_end_slot, count(*) FILTER (exp > 0.01) AS pos, count(*) FILTER (imp < 0.01 AND exp < 0.01) / 96 AS both_zero_share,
  count(*) FILTER (imp < 0.01 AND exp < 0.01 AND i >= up AND i < down) / nullif(count(*) FILTER (i >= up AND i < down), 0) AS both_zero_share_daylight, coalesce(sum(exp) FILTER (i >= up AND i < down), 0) AS sold FROM s GROUP BY id),
b AS (SELECT s.id, min(i) FILTER (i >= dusk + run AND imp > 0.5 * night_kwh / 12) AS step, count(*) FILTER (exp > 0.01 AND exp >= 0.95 * peak) AS high FROM s JOIN a ON s.id = a.id GROUP BY s.id),
f AS (SELECT id, i, imp - lag(imp) OVER (PARTITION BY id ORDER BY i) AS x FROM s),
r AS (SELECT id, stddev_pop(x) FILTER (i BETWEEN 45 AND 59) AS ramp_std_midday, stddev_pop(x) FILTER (i BETWEEN 29 AND 39) AS ramp_std_morning FROM f GROUP BY id), """


def _flat(name: str, source: str, slots: int) -> str:
    """(id, share, power) of the flat blocks of ``source`` (id, p, x), in a CTE called ``name``."""
    return f"""{name}1 AS MATERIALIZED (SELECT id, p, x, abs(x - lag(x) OVER w) <= greatest(0.05, 0.1 * greatest(abs(x), abs(lag(x) OVER w))) AS calm FROM ({source}) WINDOW w AS (PARTITION BY id ORDER BY p)),
{name}2 AS (SELECT id, p, p - row_number() OVER (PARTITION BY id ORDER BY p) AS g FROM {name}1 WHERE calm), {name}3 AS (SELECT id, p, count(*) OVER (PARTITION BY id, g) AS n FROM {name}2),
{name}4 AS (SELECT DISTINCT id, unnest([p - 1, p]) AS p FROM {name}3 WHERE n >= 3), {name}5 AS (SELECT x.id, round_even(4 * x / 0.25, 0) * 0.25 + 0.0 AS v, count(*) AS n FROM {name}4 y JOIN {name}1 x ON x.id = y.id AND x.p = y.p GROUP BY ALL),
{name} AS MATERIALIZED (SELECT id, CAST(sum(n) AS DOUBLE) / {slots} AS share, arg_max(v, (n, -v)) AS power FROM {name}5 GROUP BY id)"""


_MEASURES = (
    _DAYS
    + _flat("night", "SELECT id, CASE WHEN i >= 88 THEN i - 88 ELSE i + 8 END AS p, imp AS x FROM s WHERE i >= 88 OR i < 24", 32)
    + ", "
    + _flat("net", "SELECT id, i AS p, imp - exp AS x FROM s", 96)
    + """, m AS (SELECT d.id, mp_id, plz, date, is_clear, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, hi AND he AS has_both,
  CASE WHEN hi THEN day_kwh END AS day_kwh, CASE WHEN hi THEN night_kwh END AS night_kwh, CASE WHEN hi THEN evening_zero_share END AS evening_zero_share, CASE WHEN hi AND season THEN run / 4 END AS zero_run_after_sunset,
  CASE WHEN hi AND season THEN CAST(step AS DOUBLE) END AS step_slot, CASE WHEN hi AND season THEN s.imp END AS step_magnitude, CASE WHEN hi AND day_kwh > 0 THEN mid / day_kwh END AS midday_import_share, ramp_std_midday, ramp_std_morning,
  CASE WHEN hi AND season THEN coalesce(night.share, 0) END AS night_flat_block_share, CASE WHEN hi AND season THEN night.power END AS night_block_power,
  CASE WHEN he THEN exp_day_kwh END AS exp_day_kwh, 4 * peak AS exp_peak_kw, exp_start_slot, exp_end_slot, CASE WHEN pos > 0 AND peak > 0 THEN high / pos END AS exp_peak_flatness,
  CASE WHEN hi AND he THEN both_zero_share END AS both_zero_share, CASE WHEN hi AND he THEN both_zero_share_daylight END AS both_zero_share_daylight, CASE WHEN hi AND he AND season THEN coalesce(net.share, 0) END AS flat_interval_share,
  CASE WHEN hi AND he AND season THEN net.power END AS flat_interval_power_mode, CASE WHEN hi AND he AND sold + mid > 0 THEN sold / (sold + mid) END AS export_share_of_daylight_energy
  FROM d JOIN a ON d.id = a.id JOIN b ON d.id = b.id JOIN r ON d.id = r.id LEFT JOIN s ON s.id = d.id AND s.i = step LEFT JOIN night ON night.id = d.id LEFT JOIN net ON net.id = d.id) """
)


def stand_in_days(spark, sf):
    """(id, mp_id, plz, date, is_clear, imp, exp, sunrise, sunset)"""
    e = P.load(spark, sf, "embeddings")
    id = F.col("vec_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (id % 360).cast("int"))
    ring = lambda f, gap: F.transform(F.sequence(F.lit(0), F.lit(95)), lambda i: F.when((i + id) % gap != 0, F.greatest(f(F.get("q", i % 64)), F.lit(0.0)) / 2))
    v = e.select("vec_id", F.col("embedding").cast("array<double>").alias("q"), (id % 40).cast("string").alias("mp_id"), F.col("label").cast("string").alias("plz"), day.alias("date"), (id % 3 == 0).alias("is_clear"))
    up, down = D.solar(F.dayofyear("date"))
    return v.select(id.alias("id"), "mp_id", "plz", "date", "is_clear", F.when(id % 17 != 0, ring(lambda x: x, 29)).alias("imp"), F.when(id % 19 != 0, ring(lambda x: -x, 31)).alias("exp"), up.alias("sunrise"), down.alias("sunset"))


@query(_MEASURES + "SELECT id, mp_id, plz, date, is_clear, year, month, has_both, " + ", ".join(f"round({c}, 4) AS {c}" for c in B.DAY_MEASURES) + " FROM m")
def battery_days(spark, sf):
    """All measures of a day"""
    out = B.battery_day(stand_in_days(spark, sf), ("id", "mp_id", "plz", "date", "is_clear"))
    return out.withColumns({c: r4(c) for c in B.DAY_MEASURES})


_MONTH = ", ".join(f"round(avg({c}), 4) AS {c}_mean, round(stddev_samp({c}), 4) AS {c}_std" for c in B.DAY_MEASURES) + ", " + ", ".join(f"round(avg({c}) FILTER (is_clear), 4) AS {c}_clear" for c in B.CLEAR_MEASURES)


@query(_MEASURES + f"SELECT mp_id, year, month, {_MONTH}, count(DISTINCT date) AS n_days, any_value(plz) AS plz FROM (SELECT m.* REPLACE (mp_id AS plz) FROM m) GROUP BY mp_id, year, month")
def battery_months(spark, sf):
    """The monthly profile"""
    days = B.battery_day(stand_in_days(spark, sf)).withColumn("plz", F.col("mp_id"))
    out = B.battery_month(days)
    return out.select("mp_id", "year", "month", *[r4(c).alias(c) for c in out.columns if c.endswith(("_mean", "_std", "_clear"))], "n_days", "plz")
