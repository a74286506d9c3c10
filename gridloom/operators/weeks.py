"""Customer weeks and rule scores of day curves."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.dates import dst_week, season, week_start


def assemble_weeks(days: DataFrame, links: DataFrame, slots: int = 96, most_missing: int = 12, longest_gap: int = 4, zone: str | None = None) -> DataFrame:
    """(gp_nr, week_start, load, quality) of each household's week, from a meter's net day (mp_id, date, q).

    A slot counts only if all of the household's meters have it.  A week is eligible if few slots are missing, no
    gap is long and none lies at an end; its gaps are then filled on straight lines.  With a zone, weeks in which
    its clock changes are left out.  A day is a row throughout: arrays are added, slots never become rows.
    """
    meters = links.groupBy("gp_nr").agg(F.count_distinct("mp_id").alias("n_meters"))
    none = F.array_repeat(F.lit(None).cast("double"), slots)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    by_day = days.join(links.select("gp_nr", "mp_id").distinct(), "mp_id").groupBy("gp_nr", "date").agg(F.collect_list(F.col("q").cast("array<double>")).alias("all")).join(meters, "gp_nr")
    zero = F.array_repeat(F.lit(0.0), slots)
    by_day = by_day.withColumn("v", F.when(F.size("all") == F.col("n_meters"), F.aggregate("all", zero, add)).otherwise(none))
    entry = F.struct(F.weekday("date").alias("d"), F.col("v").alias("v"))
    weeks = by_day.groupBy("gp_nr", week_start(F.col("date")).alias("week_start"), F.col("n_meters")).agg(F.map_from_entries(F.collect_list(entry)).alias("days"))
    raw = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda d: F.coalesce(F.try_element_at("days", d), none)))
    weeks = weeks.withColumn("raw", raw).drop("days")
    missing = F.size(F.filter("raw", lambda x: x.isNull()))
    gap = V.longest_run(F.transform("raw", lambda x: x.isNull()))
    ends = F.get("raw", F.lit(0)).isNull() | F.element_at("raw", -1).isNull()
    reason = F.when(F.col("missing") > most_missing, "too_many_missing_timestamps").when(F.col("longest_missing_run") > longest_gap, "missing_run_too_long").when(ends, "leading_or_trailing_gap")
    if zone:
        reason = F.when(dst_week(F.col("week_start"), zone), "dst_transition_week").otherwise(reason)
    out = weeks.withColumns({"missing": missing, "longest_missing_run": gap}).withColumn("exclusion_reason", reason)
    filled = F.when(F.col("exclusion_reason").isNull(), V.interpolate(F.col("raw"), longest_gap))
    return out.select("gp_nr", "week_start", "n_meters", (7 * slots - F.col("missing")).alias("observed"), F.when(F.col("exclusion_reason").isNull(), F.col("missing")).otherwise(0).alias("imputed"),
        "longest_missing_run", F.col("exclusion_reason").isNull().alias("eligible"), "exclusion_reason", filled.alias("load"))


def valid_days(days: DataFrame, vector: str = "net") -> DataFrame:
    """Days of which every slot is there."""
    return days.where(~F.exists(vector, lambda x: x.isNull()))


def pv_scores(days: DataFrame, key: str = "sample_id", midday=(40, 60), night=(0, 20)) -> DataFrame:
    """From days (key, date, net, imp) in kW: any export, share of days with export, kWh a day, and midday
    over night draw in the sunlit half-year."""
    d = valid_days(days)
    export = F.transform("net", lambda x: F.greatest(-x, F.lit(0.0)))
    sun = season(F.month("date"), "sun") == "sun"
    part = lambda r: F.avg(F.when(sun, V.mean(V.part(F.col("imp"), *r))))
    kwh, any_ = V.total(export) / 4, F.array_max(export) > 0
    night_draw = part(night)
    return d.groupBy(key).agg(F.max(any_.cast("int")).alias("pv_export_any"), F.avg(any_.cast("double")).alias("pv_export_days_frac"), F.avg(kwh).alias("pv_export_kwh_d"),
        F.when(night_draw > 0, part(midday) / night_draw).alias("pv_midday_night_ratio"), F.count_if(sun).alias("n_sun_days"))


def battery_scores(days: DataFrame, key: str = "sample_id", noon: int = 50, evening=(72, 88), night=(0, 20)) -> DataFrame:
    """Shares of export after solar noon in the shoulder season and the sunlit half-year, and evening over
    night draw; null for a house that never exports."""
    d = valid_days(days)
    export = F.transform("net", lambda x: F.greatest(-x, F.lit(0.0)))
    drawn = F.transform("net", lambda x: F.greatest(x, F.lit(0.0)))
    m = F.month("date")
    sun, shoulder = season(m, "sun") == "sun", season(m, "battery") == "shoulder"
    late, all_ = V.total(F.slice(export, noon + 1, 96)), V.total(export)
    share = lambda test: F.when(F.sum(F.when(test, all_)) > 0, F.sum(F.when(test, late)) / F.sum(F.when(test, all_)))
    part = lambda r: F.avg(F.when(sun, V.mean(V.part(drawn, *r))))
    return d.groupBy(key).agg(share(shoulder).alias("bat_pm_share_shoulder"), share(sun).alias("bat_pm_share_sun"), F.when(part(night) > 0, part(evening) / part(night)).alias("bat_eve_night"))


#: Name, power band in kW, least samples as specified and as tuned; the one that isn't counted among the tuned.
EV_CLASSES = (("L1", 1.4, 1.8, 24, 24), ("L2_small", 3.6, 4.8, 4, 12), ("L2_large", 5.8, float("inf"), 2, 8))
EV_UNTUNED, EV_SCAN, EV_RAMP_KW, EV_SPEC_KW = "L1", 2, 9.0, 5.8


def charger_scores(days: DataFrame, key: str = "sample_id", classes=EV_CLASSES, untuned: str = EV_UNTUNED, ramp_kw: float = EV_RAMP_KW, spec_kw: float = EV_SPEC_KW, slots: int = 96) -> DataFrame:
    """From days (key, date, net) in kW: the greatest rise within a day, days with a large one for each 100, and for each class of
    chargers its runs for each 100 days: all that are long enough, and those longer than tuned.

    Only whole days count.  Runs may pass midnight: a household's days are put end to end, one row each, and scanned once for all classes.
    """
    from .events import banded_events

    whole = valid_days(days).select(key, "date", F.transform("net", lambda x: F.greatest(x, F.lit(0.0))).alias("imp"))
    rise = F.array_max(V.steps(F.col("imp")))
    share = lambda kw: 100 * F.avg((rise >= kw).cast("double"))
    daily = whole.groupBy(key).agg(F.count("*").alias("n_days"), F.max(rise).alias("ev_ramp_max"), share(ramp_kw).alias("ev_ramp_days100"), share(spec_kw).alias("ev_ramp_spec_days100"))
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("date", "imp"))), lambda d: d["imp"]))
    runs = banded_events(whole.groupBy(key).agg(joined.alias("q")), [key], "q", {n: (low, high) for n, low, high, _, _ in classes}, min(EV_SCAN, *[c[3] for c in classes]))
    hit = lambda name, least: (F.col("band") == name) & (F.col("length") >= least)
    spec = functools.reduce(lambda a, b: a | b, [hit(n, least) for n, _, _, least, _ in classes])
    tuned = functools.reduce(lambda a, b: a | b, [hit(n, least) for n, _, _, _, least in classes if n != untuned])
    counts = [F.count_if(hit(n, x)).alias(f"ev_{n}_{tag}_rate100") for n, _, _, *least in classes for tag, x in zip(("spec", "tuned"), least)]
    counts += [F.count_if(spec).alias("ev_spec_rate100"), F.count_if(tuned).alias("ev_tuned_rate100"), F.count_distinct(F.when(spec, F.floor(F.col("start") / slots))).alias("ev_spec_daysfrac")]
    found = runs.groupBy(key).agg(*counts)
    names = [c for c in found.columns if c != key]
    out = daily.join(found, key, "left")
    rate = lambda c: (1 if c == "ev_spec_daysfrac" else 100) * F.coalesce(F.col(c), F.lit(0)) / F.col("n_days")
    return out.select(key, "n_days", "ev_ramp_max", "ev_ramp_days100", "ev_ramp_spec_days100", *[rate(c).alias(c) for c in names])


def night_plateau_scores(events: DataFrame, n_days: DataFrame, key: str = "sample_id", window=(80, 96, 0, 24), least: int = 3) -> DataFrame:
    """Of sequential events (key, start over all days, length, excess): nights with one for each 100 days, median
    hours, and variation of energy over at least three of them."""
    slot = F.col("start") % 96
    night = events.where(((slot >= window[0]) & (slot < window[1])) | ((slot >= window[2]) & (slot < window[3])))
    kwh = F.col("length") * F.col("excess") / 4
    found = night.groupBy(key).agg(F.count_distinct(F.floor(F.col("start") / 96)).alias("nights"), (F.percentile("length", 0.5) / 4).alias("med_hours"), F.when((F.count("*") >= least) & (F.avg(kwh) > 0), F.stddev_pop(kwh) / F.avg(kwh)).alias("energy_cv"))
    out = n_days.join(found, key, "left")
    return out.select(key, (100 * F.coalesce("nights", F.lit(0)) / F.greatest("n_days", F.lit(1))).alias("ev_mode2_nights100"), F.coalesce("med_hours", F.lit(0.0)).alias("ev_mode2_med_hours"), F.col("energy_cv").alias("ev_mode2_energy_cv"))


def winter_over_night(winter_summer: Column, night_share: Column) -> Column:
    """Null where a divisor is 0 or the ratio isn't finite."""
    r = F.when(night_share != 0, winter_summer / night_share)
    return F.when(~F.isnan(r) & (F.abs(r) != float("inf")), r)


def flag_rates(flags: DataFrame, register: DataFrame, plz: str, flag: str, rate: str, supports: Sequence[int] = (1, 30, 100)) -> DataFrame:
    """Spearman's correlation of flagged shares with a register's rates, for several least supports."""
    from .stats import spearman

    shares = flags.groupBy(plz).agg(F.count("*").alias("n"), F.avg(F.col(flag).cast("double")).alias("share")).join(register.select(plz, rate), plz)
    out = None
    for s in supports:
        one = spearman(shares.where(F.col("n") >= s), "share", rate).withColumn("support", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out


def evidence_counts(weeks: DataFrame, key: str, events: str, score: str, strong: float = 0.5) -> DataFrame:
    """Strong weeks, events, weeks with events and the greatest score of each customer."""
    return weeks.groupBy(key).agg(F.count_if(F.col(score) >= strong).alias("strong_weeks"), F.sum(events).alias("events"), F.count_if(F.col(events) > 0).alias("weeks_with_events"), F.max(score).alias("score_max"))


def month_report(readings: DataFrame, linked: DataFrame, month: str = "month", meter: str = "mp_id") -> DataFrame:
    """For each month, meters seen, linked ones among them, and linked ones that are missing."""
    seen = readings.select(month, meter).distinct()
    known = linked.select(meter).distinct()
    total = known.count()
    inside = seen.join(known.withColumn("known", F.lit(1)), meter, "left").groupBy(month).agg(F.count("*").alias("seen"), F.sum(F.coalesce("known", F.lit(0))).alias("linked"))
    return inside.withColumn("missing", F.lit(total) - F.col("linked"))


def sweep_summary(months: DataFrame, month: str, candidate: str, noise: str, quiet: float = 0.0625) -> DataFrame:
    """Candidates and the share of quiet meters of each month."""
    return months.groupBy(month).agg(F.count("*").alias("n"), F.sum(F.col(candidate).cast("int")).alias("candidates"), F.avg((F.col(noise) <= quiet).cast("double")).alias("quiet"))
