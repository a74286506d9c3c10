"""Feature families of a week's load curve: 7 days of ``day`` slots, in kWh, as one array."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.dates import in_window
from .aggregates import customer_features

#: Named windows of the day, in hours; they wrap past midnight.
WINDOWS = {"late_afternoon_night": (16, 2), "evening_overnight": (18, 6), "night": (20, 8)}


def _in_kw(weeks: DataFrame, ids: Sequence[str], vector: str) -> DataFrame:
    return weeks.select(*ids, F.transform(vector, lambda e: e * 4.0).alias("x"))


def _mean(values: Column) -> Column:
    return F.coalesce(V.mean(values), F.lit(0.0))


def timed_features(weeks: DataFrame, ids: Sequence[str], vector: str = "q", window: str = "evening_overnight", ramp_kw: float = 2.0, persistence_hours: float = 1.5, day: int = 96) -> DataFrame:
    """14 columns of rises that begin in a window of the day: how many, how many last, end with a fall, on how many
    days, and their rise, level, flatness, symmetry and time of day."""
    keep = round(persistence_hours * day / 24)
    x, delta = F.col("x"), F.col("delta")
    rows = _in_kw(weeks, ids, vector)
    rows = rows.withColumn("delta", F.concat(F.array(F.lit(0.0)), V.steps(x)))
    rows = rows.withColumn("all", F.filter(F.transform(delta, lambda d, i: F.when(d >= ramp_kw, i)), lambda i: i.isNotNull()))
    allowed = lambda i: in_window(i % day * 24 / day, *WINDOWS[window]) & (i >= 4) & (i + keep <= F.size(x))

    def ramp(i: Column) -> Column:
        base, part, rise = V.median(F.slice(x, i - 3, 4)), F.slice(x, i + 1, keep), F.get(delta, i)
        later = F.slice(delta, i + keep + 1, F.least(F.lit(32), F.size(x) - i - keep))
        return F.struct(i.alias("i"), rise.alias("rise"), base.alias("base"), part.alias("part"), V.median(part).alias("mid"), F.greatest(F.lit(0.0), F.coalesce(-F.array_min(later), F.lit(0.0))).alias("fall"))

    def judged(r: Column) -> Column:
        level = r["mid"] - r["base"]
        broken = F.size(F.filter(r["part"], lambda v: v < r["base"] + 0.6 * r["rise"]))
        flat = V.median(F.transform(r["part"], lambda v: F.abs(v - r["mid"]))) / F.greatest(F.abs(level), F.lit(0.1))
        return F.struct(r["i"].alias("i"), r["rise"].alias("rise"), level.alias("level"), flat.alias("cv"), (broken <= 1).alias("sustained"),
            ((broken <= 1) & (r["fall"] >= 0.5 * r["rise"])).alias("paired"), (F.least(r["rise"], r["fall"]) / F.greatest(r["rise"], r["fall"], F.lit(0.1))).alias("symmetry"))

    rows = rows.withColumn("ramps", F.transform(F.transform(F.filter("all", allowed), ramp), judged))
    of = lambda name: F.transform("ramps", lambda r: r[name])
    count = lambda test: F.size(F.filter("ramps", test)).cast("double")
    angle = lambda f: _mean(F.transform("ramps", lambda r: f(r["i"] % day * (2 * math.pi / day))))
    days = F.array_distinct(F.transform(F.filter("ramps", lambda r: r["sustained"]), lambda r: F.floor(r["i"] / day)))
    out = rows.select(
        *ids, count(lambda r: F.lit(True)).alias("timed_ramp_count"), F.size("all").cast("double").alias("timed_all_ramp_count"), count(lambda r: r["sustained"]).alias("timed_sustained_count"), count(lambda r: r["paired"]).alias("timed_paired_count"),
        F.size(days).cast("double").alias("timed_active_days"), count(lambda r: r["i"] % day + keep > day).alias("timed_cross_midnight_count"),
        F.coalesce(F.array_max(of("rise")), F.lit(0.0)).alias("timed_max_rise_kw"), F.coalesce(V.median(of("rise")), F.lit(0.0)).alias("timed_median_rise_kw"), _mean(of("level")).alias("timed_mean_level_kw"),
        _mean(of("cv")).alias("timed_mean_plateau_cv"), _mean(of("symmetry")).alias("timed_mean_edge_symmetry"), angle(F.sin).alias("timed_start_sin"), angle(F.cos).alias("timed_start_cos"))
    return out.withColumn("timed_start_concentration", F.hypot("timed_start_sin", "timed_start_cos"))


def distribution_features(weeks: DataFrame, ids: Sequence[str], vector: str = "q", window: str = "evening_overnight", floor_kw: float = 3.0, level_kw: float = 0.5, day: int = 96, tail: int = 67) -> DataFrame:
    """18 ``dist_*`` columns (high hours, excess energy, times of peaks, likeness of days, levels, tail) and 16
    ``multi_*`` ones (differences over a quarter hour to two hours)."""
    x, n = F.col("x"), F.size("x")
    inside = lambda i: in_window(i % day * 24 / day, *WINDOWS[window])
    rows = _in_kw(weeks, ids, vector)
    daily = F.transform(F.sequence(F.lit(0), (n / day).cast("int") - 1), lambda d: F.slice(x, d * day + 1, day))
    rows = rows.withColumns({"daily": daily, "over": F.transform(x, lambda v: F.greatest(v - floor_kw, F.lit(0.0))), "high": F.transform(x, lambda v: v >= floor_kw)})
    rows = rows.withColumn("profile", F.transform(F.sequence(F.lit(0), F.lit(day - 1)), lambda k: V.median(F.transform("daily", lambda d: F.get(d, k)))))
    rows = rows.withColumn("inside", F.filter("high", lambda h, i: inside(i)))
    centred = lambda v: V.bind(V.mean(v), lambda m: F.transform(v, lambda e: e - m))
    dot = lambda a, b: V.total(F.zip_with(a, b, lambda p, q: p * q))
    rows = rows.withColumn("shape", centred(F.col("profile")))
    size = F.sqrt(dot(F.col("shape"), F.col("shape")))
    like = lambda d: V.bind(centred(d), lambda c: V.bind(F.sqrt(dot(c, c)) * size, lambda s: F.when(s > 0, dot(c, F.col("shape")) / s).otherwise(0.0)))
    peak = lambda f: V.mean(F.transform("daily", lambda d: f((F.array_position(d, F.array_max(d)) - 1) * (2 * math.pi / day))))
    active = F.filter(F.sequence(F.lit(0), (n / day).cast("int") - 1), lambda d: F.exists(F.filter("high", lambda h, i: inside(i) & (F.floor(i / day) == d)), lambda h: h))
    levels = F.array_sort(F.transform(F.filter(x, lambda v: v >= floor_kw), lambda v: F.rint(v / level_kw)))
    rows = rows.withColumn("levels", levels)
    share = F.transform(F.array_distinct("levels"), lambda k: F.size(F.filter("levels", lambda v: v == k)) / F.size("levels"))
    rows = rows.withColumn("share", share)
    noon = F.filter(x, lambda v, i: (i % day >= 40 * day // 96) & (i % day < 60 * day // 96))
    top = F.slice(F.reverse(V.sorted_slots(x)), 1, tail)
    high_hours, window_hours = F.size(F.filter("high", lambda h: h)) / 4, F.size(F.filter("inside", lambda h: h)) / 4
    excess, window_excess = V.total(F.col("over")), V.total(F.filter("over", lambda v, i: inside(i)))
    out = [
        high_hours.alias("dist_all_high_hours"), window_hours.alias("dist_window_high_hours"), (window_hours / F.greatest(high_hours, F.lit(0.25))).alias("dist_window_high_fraction"),
        (excess / 4).alias("dist_all_excess_kwh"), (window_excess / 4).alias("dist_window_excess_kwh"), (window_excess / F.greatest(excess, F.lit(0.1))).alias("dist_window_excess_fraction"),
        F.size(active).cast("double").alias("dist_active_days"), F.hypot(peak(F.sin), peak(F.cos)).alias("dist_peak_time_concentration"), peak(F.sin).alias("dist_peak_time_sin"), peak(F.cos).alias("dist_peak_time_cos"),
        V.mean(F.transform("daily", like)).alias("dist_day_profile_consistency"), (F.size(F.filter(noon, lambda v: v < 0)) / F.size(noon)).alias("dist_midday_negative_share"),
        (V.longest_run(F.col("inside")) / 4).alias("dist_window_longest_high_run_hours"), F.coalesce(F.array_max("share"), F.lit(0.0)).alias("dist_level_concentration"), F.size("share").cast("double").alias("dist_level_mode_count"),
        (-V.total(F.transform("share", lambda p: p * F.ln(p)))).alias("dist_level_entropy"), V.mean(top).alias("dist_tail_mean_kw"), (V.total(F.transform(top, lambda v: F.greatest(v - floor_kw, F.lit(0.0)))) / 4).alias("dist_tail_area_kwh"),
    ]
    for lag, minutes in ((1, 15), (2, 30), (4, 60), (8, 120)):
        d = V.steps(x, lag)
        out += [V.quantile(d, 0.95).alias(f"multi_pos_q95_{minutes}m"), V.quantile(F.transform(d, lambda v: -v), 0.95).alias(f"multi_neg_q95_{minutes}m"), V.mean(F.transform(d, F.abs)).alias(f"multi_abs_mean_{minutes}m"), V.mean(F.transform(d, lambda v: v * v)).alias(f"multi_energy_{minutes}m")]
    return rows.select(*ids, *out)


def shape_grid(weeks: DataFrame, ids: Sequence[str], vector: str = "q", day: int = 96, blocks: int = 4, components: Sequence[int] = (1, 2, 3, 7, 14, 21, 28)) -> DataFrame:
    """Means of each day's blocks of the centred and scaled curve, and Fourier magnitudes."""
    x, size = F.col("x"), day // blocks
    scale = F.greatest(V.quantile(x, 0.95) - V.quantile(x, 0.05), F.lit(0.1))
    rows = _in_kw(weeks, ids, vector)
    rows = rows.select(*ids, V.bind(F.struct(V.median(x).alias("m"), scale.alias("s")), lambda c: F.transform(x, lambda v: (v - c["m"]) / c["s"])).alias("z"))
    means = [V.mean(F.slice("z", d * day + b * size + 1, size)).alias(f"shape_day{d}_block{b}") for d in range(7) for b in range(blocks)]
    return rows.select(*ids, *means, *[V.fourier(F.col("z"), k).alias(f"fourier_{k}") for k in components])


def compact_features(weeks: DataFrame, ids: Sequence[str], vector: str = "q") -> DataFrame:
    """21 statistics of a week."""
    return weeks.select(*ids, *[c.alias(n) for n, c in V.compact_week(F.col(vector)).items()])


def week_family(weeks: DataFrame, ids: Sequence[str], family: str, vector: str = "q", timed: dict | None = None, distribution: dict | None = None) -> DataFrame:
    """The columns of a family: timed, distribution, or combined (both, behind the compact statistics)."""
    parts = []
    if family == "combined":
        parts.append(compact_features(weeks, ids, vector))
    if family in ("timed", "combined"):
        parts.append(timed_features(weeks, ids, vector, **(timed or {})))
    if family in ("distribution", "combined"):
        parts.append(distribution_features(weeks, ids, vector, **(distribution or {})))
    if not parts:
        raise ValueError(f"no feature family {family}")
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, list(ids))
    return out


def customer_family(weeks: DataFrame, key: str, week: str, family: str, vector: str = "q", **options) -> DataFrame:
    """A family's columns over a customer's weeks: mean, greatest, mean of three greatest, deviation."""
    columns = week_family(weeks, [key, week], family, vector, **options)
    return customer_features(columns, key, [c for c in columns.columns if c not in (key, week)])
