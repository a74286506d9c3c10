"""Aggregations from readings to meter-months, meters, households and postcodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.dates import season
from ..functions.numbers import clip, ratio, slope_and_r


def needed_sum(c: Column, n: Column) -> Column:
    """Null unless ``n`` values are there."""
    return F.when(F.count(c) >= n, F.sum(c))


def mode_or_null(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Most frequent cleaned value in its first spelling; a tie is null and a conflict.

    ``conflict`` tells whether there is more than one value at all.
    """
    counted = df.select(*keys, text.clean(F.col(column)).alias("__v"), text.squeezed(F.col(column)).alias("__raw")).where("__v is not null")
    counted = counted.groupBy(*keys, "__v").agg(F.count("*").alias("__n"), F.min("__raw").alias("__raw"))
    top = counted.groupBy(*keys).agg(F.max("__n").alias("__top"), F.count("*").alias("__k"), F.max_by("__raw", "__n").alias("__mode"), F.collect_list("__n").alias("__all"))
    tie = F.size(F.filter("__all", lambda x: x == F.col("__top"))) > 1
    return top.select(*keys, F.when(~tie, F.col("__mode")).alias(column), (F.col("__k") > 1).alias("conflict"))


def smallest_mode(c: str) -> Column:
    """Of the most frequent values the smallest."""
    return F.expr(f"mode() within group (order by {c})")


def distinct_values(c: Column) -> Column:
    """Sorted distinct cleaned values."""
    return F.array_sort(F.collect_set(text.clean(c)))


def consolidate(applications: DataFrame, key: str, flags: Sequence[str], places: Sequence[str], capacity: str | None, dates: Sequence[str]) -> DataFrame:
    """One row for each customer: any mark, most frequent place, greatest capacity, first and last
    dates, conflicts and the raw values as JSON."""
    aggs = [F.count("*").alias("n_applications")]
    for f in flags:
        aggs += [F.max(text.is_marked(F.col(f)).cast("int")).alias(f), (F.count_distinct(text.is_marked(F.col(f))) > 1).alias(f"{f}_conflict")]
    for d in dates:
        aggs += [F.min(d).alias(f"{d}_earliest"), F.max(d).alias(f"{d}_latest")]
    if capacity:
        aggs.append(F.max(text.number(F.col(capacity).cast("string"))).alias(capacity))
    aggs += [F.to_json(F.array_sort(F.collect_set(text.squeezed(F.col(p))))).alias(f"{p}_values") for p in places]
    out = applications.groupBy(key).agg(*aggs)
    for p in places:
        out = out.join(mode_or_null(applications, [key], p).withColumnRenamed("conflict", f"{p}_conflict"), key, "left")
    return out


def any_mark(c: str) -> Column:
    """A23."""
    return F.max(text.is_marked(F.col(c)).cast("int"))


def first_filled(c: str, order: str, sentinel: str = "unlabeled") -> Column:
    """The first value that isn't blank or the sentinel, by an order."""
    value = F.nullif(text.squeezed(F.col(c)), F.lit(sentinel))
    return F.min_by(value, F.when(value.isNotNull(), F.col(order)))


def meter_months(readings: DataFrame, midday=(10, 15), night=(0, 5)) -> DataFrame:
    """A10: energy, days, midday and night energy of each meter, month and register, from (mp_id, date,
    slot, register, kwh, plz)."""
    hour = F.floor(F.col("slot") / 4)
    inside = lambda w: F.coalesce(F.sum(F.when((hour >= w[0]) & (hour < w[1]), F.col("kwh"))), F.lit(0.0))
    return readings.groupBy("mp_id", F.year("date").alias("year"), F.month("date").alias("month"), "register").agg(
        F.sum("kwh").alias("kwh"), F.count_distinct("date").cast("int").alias("n_days"), inside(midday).alias("midday_kwh"), inside(night).alias("night_kwh"), F.min("plz").alias("plz"))


def day_features(days: DataFrame, midday=range(11, 15), evening=range(18, 22), night=range(0, 5), solar=range(9, 17), eps: float = 1e-6) -> DataFrame:
    """Of each day's import array ``q``: energy, ratios of mean power, near-zero share of daylight."""
    from ..functions import vectors as V

    q = F.col("q")
    day = V.total(q)
    mid, eve, dark = (V.hour_band(q, h) for h in (midday, evening, night))
    per = lambda x, h: x / len(h)
    light = V.part(q, 4 * solar[0], 4 * solar[-1] + 4)
    return days.select(
        "mp_id", "plz", "date", (F.weekday("date") >= 5).alias("is_weekend"), day.alias("day_kwh"),
        F.when(day / 24 > eps, per(mid, midday) / (day / 24)).alias("midday_ratio"),
        F.when(per(mid, midday) > eps, per(eve, evening) / per(mid, midday)).alias("evening_midday_ratio"),
        dark.alias("night_kwh"), V.hour_band(q, solar).alias("solar_kwh"),
        V.share_below(light, 0.01).alias("frac_daytime_zero"),
        (F.coalesce(F.array_min(V.finite(light)) < per(dark, night) / 4, F.lit(False))).cast("double").alias("below_night"))


def export_day_features(days: DataFrame, midday=range(10, 15)) -> DataFrame:
    """V08."""
    from ..functions import vectors as V

    q = F.col("q")
    return days.select("mp_id", "date", V.total(q).alias("exp_day_kwh"), V.hour_band(q, midday).alias("exp_midday_kwh"), V.peak_slot(q).alias("peak_slot"))


def monthly_features(days: DataFrame, weather: DataFrame) -> DataFrame:
    """A meter's month from its day features and the days' clearness (date, clearness, is_clear)."""
    d = days.join(weather.select("date", "clearness", "is_clear"), "date", "left")
    x, y = F.col("clearness"), F.when(F.col("clearness").isNotNull(), F.col("midday_ratio"))
    x = F.when(y.isNotNull(), x)
    q = lambda p: F.percentile("day_kwh", p)
    return d.groupBy("mp_id", F.year("date").alias("year"), F.month("date").alias("month")).agg(
        F.count_distinct("date").cast("int").alias("n_days"), F.avg("day_kwh").alias("day_kwh_mean"),
        q(0.1).alias("day_kwh_p10"), q(0.5).alias("day_kwh_p50"), q(0.9).alias("day_kwh_p90"),
        F.avg("midday_ratio").alias("midday_ratio_mean"), F.stddev_samp("midday_ratio").alias("midday_ratio_std"),
        F.avg(F.when(F.col("is_clear"), F.col("midday_ratio"))).alias("midday_ratio_clear"),
        F.avg("evening_midday_ratio").alias("evening_midday_ratio_mean"), F.avg("night_kwh").alias("night_kwh_mean"),
        F.avg("frac_daytime_zero").alias("frac_daytime_zero_mean"), F.avg("below_night").alias("below_night_frac"),
        F.avg(F.when(~F.col("is_weekend"), F.col("day_kwh"))).alias("day_kwh_weekday"), F.avg(F.when(F.col("is_weekend"), F.col("day_kwh"))).alias("day_kwh_weekend"),
        smallest_mode("plz").alias("plz"), F.count(y).alias("irr_n"), F.sum(x).alias("irr_sx"), F.sum(y).alias("irr_sy"),
        F.sum(x * y).alias("irr_sxy"), F.sum(x * x).alias("irr_sxx"), F.sum(y * y).alias("irr_syy"))


def pooled_slope(months: DataFrame, keys: Sequence[str], least: int = 20) -> DataFrame:
    """Slope and correlation from the months' sums."""
    s = {c: F.sum(f"irr_{c}") for c in ("n", "sx", "sy", "sxy", "sxx", "syy")}
    summed = months.groupBy(*keys).agg(*[v.alias(k) for k, v in s.items()])
    slope, r = slope_and_r(*[F.col(c) for c in s], least=least)
    return summed.select(*keys, slope.alias("load_irr_slope"), r.alias("load_irr_corr"))


def export_summary(days: DataFrame) -> DataFrame:
    """Of a meter's export days: days seen and with export, median of the months' median peak
    slots, and the summer with most midday export (the earlier one of equals)."""
    month = days.groupBy("mp_id", F.year("date").alias("year"), F.month("date").alias("month")).agg(
        F.count_distinct("date").alias("days"), F.count_distinct(F.when(F.col("exp_day_kwh") > 0, F.col("date"))).alias("export_days"),
        F.sum("exp_day_kwh").alias("kwh"), F.percentile("peak_slot", 0.5).alias("peak"),
        F.count_if(F.col("exp_midday_kwh") > 0).alias("midday_days"))
    year = month.groupBy("mp_id", "year").agg(F.sum(F.when(F.col("month").between(5, 8), F.col("midday_days")).otherwise(0)).alias("midday_days"))
    best = year.groupBy("mp_id").agg(F.max_by("year", F.struct("midday_days", -F.col("year"))).alias("best_summer"))
    return month.groupBy("mp_id").agg(F.sum("days").alias("days"), F.sum("export_days").alias("export_days"), F.sum("kwh").alias("export_kwh"), F.percentile("peak", 0.5).alias("peak_slot")).join(best, "mp_id")


def seasonal(months: DataFrame, value: str, keys: Sequence[str] = ("mp_id",), calendar: str = "meter") -> DataFrame:
    """Summer and winter means with their contrast, ratio and the summer's share."""
    s = season(F.col("month"), calendar)
    of = lambda n: F.avg(F.when(s == n, F.col(value)))
    out = months.groupBy(*keys).agg(of("summer").alias("summer"), of("winter").alias("winter"), F.avg(value).alias("mean"), F.count("*").alias("n_months"))
    w, u = F.col("winter"), F.col("summer")
    return out.withColumns({"contrast": u - w, "winter_summer_ratio": ratio(w, u), "summer_share": ratio(u, u + w)})


def yearly_trend(years: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Least-squares slope of a yearly value; pairs with a null don't count."""
    n = F.count(F.when(F.col(value).isNotNull(), F.col("year")))
    return years.groupBy(*keys).agg(F.when(n >= 2, F.regr_slope(F.col(value), F.col("year").cast("double"))).alias("slope"))


def weighted_rollup(meters: DataFrame, keys: Sequence[str], values: Sequence[str], weight: str = "day_kwh_mean", least: float = 0.1) -> DataFrame:
    """Means over meters, weighted by energy of ``least`` at least; a null is left out on both sides."""
    w = clip(F.coalesce(F.col(weight), F.lit(0.0)), least)
    mean = lambda c: F.sum(F.col(c) * w) / F.sum(F.when(F.col(c).isNotNull(), w))
    return meters.groupBy(*keys).agg(*[mean(c).alias(c) for c in values], F.count("*").alias("n_meters"))


def household_extremes(meters: DataFrame, key: str, values: Sequence[str], flags: Sequence[str] = (), share_of: str | None = None) -> DataFrame:
    """Greatest and least of the meters, number of flagged ones, share of the largest meter."""
    aggs = [F.count("*").alias("n_meters")]
    for v in values:
        aggs += [F.max(v).alias(f"{v}_max"), F.min(v).alias(f"{v}_min")]
    aggs += [F.sum(F.col(f).cast("int")).alias(f"n_{f}") for f in flags]
    if share_of:
        aggs.append(ratio(F.max(share_of), F.sum(share_of)).alias("concentration"))
    return meters.groupBy(key).agg(*aggs)


def windowed_extremes(months: DataFrame, windows: DataFrame, values: Sequence[str], least_months: int = 2) -> DataFrame:
    """The same over the months that a sample's window touches.  Samples of a household whose windows touch the same
    months share one result, which is made once."""
    from .relational import months_overlapping

    asked = windows.where("first_day <= last_day").select("sample_id", "gp_nr", F.trunc("first_day", "month").alias("first_day"), F.trunc("last_day", "month").alias("last_day"))
    keys = ["gp_nr", "first_day", "last_day"]
    inside = months_overlapping(asked.select(*keys).distinct(), months)
    per_meter = inside.groupBy(*keys, "mp_id").agg(F.count("*").alias("n"), *[F.avg(v).alias(v) for v in values]).where(F.col("n") >= least_months)
    aggs = [F.count("*").alias("n_meters")]
    for v in values:
        aggs += [F.max(v).alias(f"{v}_max"), F.min(v).alias(f"{v}_min")]
    return asked.join(per_meter.groupBy(*keys).agg(*aggs), keys).drop(*keys)


def windowed_profile(months: DataFrame, windows: DataFrame, hp_ratio: float = 3.0, hp_share: float = 0.2, production_kwh: float = 50.0, multi_unit: int = 4, least_months: int = 2) -> DataFrame:
    """The 13 ``w_*`` outputs of a sample's window, from meter-months (gp_nr, mp_id, month, register, kwh, n_days):
    meters, their greatest winter over summer ratio and least summer share, meters like heat pumps, and meters that only
    produce.  A window without import has no row."""
    from .relational import months_overlapping

    keys = ["gp_nr", "first_day", "last_day"]
    asked = windows.where("first_day <= last_day").select("sample_id", "gp_nr", F.trunc("first_day", "month").alias("first_day"), F.trunc("last_day", "month").alias("last_day"))
    total = months.groupBy("gp_nr").agg(F.count_distinct("mp_id").alias("w_n_meters"))
    inside = months_overlapping(asked.select(*keys).distinct(), months)
    drawn, s = F.col("register") == "import", season(F.month("month"))
    a_day = F.col("kwh") / F.greatest(F.col("n_days"), F.lit(1))
    per = inside.groupBy(*keys, "mp_id").agg(
        F.avg(F.when(drawn & (s == "summer"), a_day)).alias("summer"), F.avg(F.when(drawn & (s == "winter"), a_day)).alias("winter"), F.sum(F.when(drawn, F.col("kwh"))).alias("imp"),
        F.count_if(drawn).alias("n"), F.coalesce(F.sum(F.when(~drawn, F.col("kwh"))), F.lit(0.0)).alias("exp")).where("n > 0")
    both = F.coalesce("summer", F.lit(0.0)) + F.coalesce("winter", F.lit(0.0))
    per = per.withColumns({"ratio": F.when(F.col("summer") > 0.01, F.col("winter") / F.col("summer")), "share": F.when(both > 0, F.col("summer") / both)})
    hp = F.coalesce((F.col("ratio") >= hp_ratio) & (F.col("share") <= hp_share) & (F.col("n") >= least_months), F.lit(False))
    made = (F.col("exp") > 0) & (F.col("imp") <= production_kwh)
    out = per.groupBy(*keys).agg(
        F.count("*").alias("w_n_meters_with_data"), F.max("ratio").alias("w_meter_max_winter_summer_ratio"), F.min("share").alias("w_meter_min_summer_share"), ratio(F.max("imp"), F.sum("imp")).alias("w_meter_concentration"),
        F.count_if(hp).alias("w_n_heat_pump_like_meters"), F.count_if(made).alias("w_n_production_only_meters"), F.max("n").alias("w_n_months_in_window")).join(total, "gp_nr")
    flag = lambda c: c.cast("int")
    n, h = F.col("w_n_meters_with_data"), F.col("w_n_heat_pump_like_meters")
    out = out.withColumns({"w_is_multi_meter": flag(F.col("w_n_meters") > 1), "w_is_multi_unit": flag(F.col("w_n_meters") >= multi_unit), "w_is_winter_dominant": flag(h > 0),
        "w_has_dedicated_hp_meter": flag((n > 1) & (h > 0) & (n > h)), "w_has_production_only_meter": flag(F.col("w_n_production_only_meters") > 0)})
    return asked.join(out, keys).drop(*keys)


def means_and_stds(df: DataFrame, keys: Sequence[str], columns: Sequence[str], clear: str | None = None, date: str = "date") -> DataFrame:
    """Mean and standard deviation of each column, and means over clear days."""
    aggs = [F.count_distinct(date).alias("n_days")]
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
        if clear:
            aggs.append(F.avg(F.when(F.col(clear), F.col(c))).alias(f"{c}_clear"))
    return df.groupBy(*keys).agg(*aggs)


def daily_weather(stations: DataFrame) -> DataFrame:
    """Mean radiation, extremes of temperature, stations of each day."""
    return stations.groupBy("date").agg(F.avg("radiation").alias("radiation"), F.min("t_min").alias("t_min"), F.max("t_max").alias("t_max"), F.count_distinct("station").alias("stations"))


def shrunken_rate(df: DataFrame, key: str, hits: Column, total: Column, weight: float = 50.0, most: float = 0.95) -> DataFrame:
    """Rates drawn towards the overall one; the overall rate is one row, joined by a literal key."""
    groups = df.groupBy(key).agg(F.sum(hits).cast("double").alias("k"), F.sum(total).cast("double").alias("n"))
    overall = groups.agg((F.sum("k") / F.sum("n")).alias("mean")).first()
    mean = (overall.mean if overall else 0.0) or 0.0
    return groups.select(key, "k", "n", clip((F.col("k") + weight * mean) / (F.col("n") + weight), 0.0, most).alias("rate"))


def register_rates(buildings: DataFrame, entrances: DataFrame, marks: dict[str, Column], plz: str = "plz", building: str = "egid") -> DataFrame:
    """Shares of marked buildings for each postcode; a building with more than one postcode is out."""
    where = entrances.groupBy(building).agg(F.count_distinct(plz).alias("n"), F.min(plz).alias(plz)).where("n = 1").drop("n")
    both = buildings.join(where, building)
    return both.groupBy(plz).agg(F.count("*").alias("n"), *[F.avg(c.cast("double")).alias(f"{n}_rate") for n, c in marks.items()])


def best_meter(scores: DataFrame, key: str = "gp_nr", score: str = "score", meter: str = "mp_id") -> DataFrame:
    """A household's greatest meter score (of equals the smallest id) and counts."""
    return scores.groupBy(key).agg(F.max(score).alias(score), F.min_by(meter, F.struct((-F.col(score)).alias("s"), F.col(meter).alias("m"))).alias(meter), F.count("*").alias("n_meters"))


def stability(flags: DataFrame, key: str, flag: str) -> DataFrame:
    """Years seen, years flagged and their share."""
    return flags.groupBy(key).agg(F.count("*").alias("years"), F.sum(F.col(flag).cast("int")).alias("flagged"), F.avg(F.col(flag).cast("double")).alias("share"))


def spread(df: DataFrame, keys: Sequence[str], value: str, below: float) -> DataFrame:
    """Quartiles and the share below a limit."""
    return df.groupBy(*keys).agg(*[F.percentile(value, q).alias(f"p{round(100 * q)}") for q in (0.25, 0.5, 0.75)], F.avg((F.col(value) < below).cast("double")).alias("below"))


def slot_profile(readings: DataFrame, least_slots: int = 72, least_days: int = 10, least_values: int = 10, keys: Sequence[str] = ("mp_id", "month")) -> DataFrame:
    """p10, p50 and p90 of each slot over a month's days with enough readings, from (keys, date, slot, kwh).

    Negative readings are missing.
    """
    x = readings.where("kwh >= 0")
    days = x.groupBy(*keys, "date").agg(F.count("*").alias("n")).where(F.col("n") >= least_slots).select(*keys, "date")
    enough = days.groupBy(*keys).agg(F.count_distinct("date").alias("d")).where(F.col("d") >= least_days).select(*keys)
    x = x.join(days.join(enough, list(keys), "left_semi"), [*keys, "date"], "left_semi")
    n = F.count("kwh")
    return x.groupBy(*keys, "slot").agg(*[F.when(n >= least_values, F.percentile("kwh", q)).alias(f"p{round(100 * q)}") for q in (0.1, 0.5, 0.9)], n.alias("n"))


def mad_noise(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """1.4826 times the median distance from the median."""
    mid = df.groupBy(*keys).agg(F.percentile(value, 0.5).alias("__m"))
    return df.join(mid, list(keys)).groupBy(*keys).agg((1.4826 * F.percentile(F.abs(F.col(value) - F.col("__m")), 0.5)).alias("noise"))


def customer_scores(weeks: DataFrame, key: str, score: str, rule: str = "top3", scale: float = 3.0) -> DataFrame:
    """Greatest score, mean of the three greatest, or 1 - exp(-sum / scale)."""
    if rule == "top3":
        top = F.slice(F.reverse(F.array_sort(F.collect_list(score))), 1, 3)
        from ..functions.vectors import mean

        return weeks.groupBy(key).agg(mean(top).alias("score"))
    return weeks.groupBy(key).agg((F.max(score) if rule == "max" else 1 - F.exp(-F.sum(score) / scale)).alias("score"))


def customer_features(weeks: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """Mean, greatest, mean of the three greatest and population deviation of each feature."""
    from ..functions.vectors import mean

    aggs = []
    for f in features:
        top = F.slice(F.reverse(F.array_sort(F.collect_list(f))), 1, 3)
        aggs += [F.avg(f).alias(f"{f}_mean"), F.max(f).alias(f"{f}_max"), mean(top).alias(f"{f}_top3"), F.stddev_pop(f).alias(f"{f}_std")]
    return weeks.groupBy(key).agg(*aggs)


def cohort(weeks: DataFrame, key: str, order: str, target: str, cap: int = 12, least: int = 2) -> DataFrame:
    """Number of a customer's latest weeks (``cap`` at most), its target, and whether that is enough."""
    n = F.least(F.count(order), F.lit(cap))
    return weeks.groupBy(key).agg(F.min_by(target, order).alias("target"), n.cast("int").alias("weeks"), F.when(n >= least, "ok").otherwise("insufficient_history").alias("status"))


def negative_load(pairs: DataFrame, key: str = "mp_id") -> DataFrame:
    """Of paired intervals (key, ts, import, export): valid and negative ones, the first negative one."""
    net = F.col("import") - F.col("export")
    return pairs.groupBy(key).agg(
        F.count(net).alias("valid"), F.count_if(net < 0).alias("negative"),
        F.min(F.when(net < 0, F.col("ts"))).alias("first_negative"),
        F.min_by(F.when(net < 0, net), F.when(net < 0, F.col("ts"))).alias("first_value"))


def negative_status(valid: Column, negative: Column) -> Column:
    """A40, P08."""
    return F.when(valid.isNull() | (valid == 0), "no_data").when(negative > 0, "negative").otherwise("never_negative")


def asset_timeline(rows: DataFrame, key: str, date: str, assets: Sequence[str], source: str | None = None) -> DataFrame:
    """When a customer's assets first appear: (key, date, assets added), one row a date."""
    marked = F.array(*[F.when(F.col(a) == 1, F.lit(a)) for a in assets])
    each = rows.select(key, date, *([source] if source else []), F.explode(F.filter(marked, lambda x: x.isNotNull())).alias("asset")).where(F.col(date).isNotNull())
    first = each.groupBy(key, "asset").agg(F.min(F.struct(date, *([source] if source else []))).alias("f")).select(key, "asset", "f.*")
    return first.groupBy(key, date, *([source] if source else [])).agg(F.array_sort(F.collect_set("asset")).alias("added"))


def coverage(linked: DataFrame, observed: DataFrame, eligible_: DataFrame, key: str) -> DataFrame:
    """Linked, observed and eligible counts of each customer."""
    count = lambda df, n: df.groupBy(key).agg(F.count("*").alias(n))
    return count(linked, "linked").join(count(observed, "observed"), key, "left").join(count(eligible_, "eligible"), key, "left").fillna(0)


def slices(df: DataFrame, dimensions: Sequence[str], aggs: dict[str, str], least: int = 5) -> DataFrame:
    """One group-by for each dimension in one pass (grouping sets); small cells are left out."""
    df.createOrReplaceTempView("__slices")
    sets = ", ".join(f"({d})" for d in dimensions)
    name = "CASE " + " ".join(f"WHEN grouping({d}) = 0 THEN '{d}'" for d in dimensions) + " END"
    value = "CASE " + " ".join(f"WHEN grouping({d}) = 0 THEN cast({d} AS string)" for d in dimensions) + " END"
    what = ", ".join(f"{e} AS {n}" for n, e in aggs.items())
    return df.sparkSession.sql(f"SELECT {name} AS dimension, {value} AS cell, count(*) AS n, {what} FROM __slices GROUP BY GROUPING SETS ({sets}) HAVING count(*) >= {least}")


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence) -> DataFrame:
    """A45."""
    return df.groupBy(rows).pivot(columns, list(values)).count().fillna(0)


def totals(df: DataFrame, label: str, weight: str | None = None) -> DataFrame:
    """Rows, positives, prevalence, weighted prevalence."""
    y = F.col(label).cast("double")
    aggs = [F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("positives"), F.avg(y).alias("prevalence")]
    if weight:
        aggs.append((F.sum(y * F.col(weight)) / F.sum(weight)).alias("weighted_prevalence"))
    return df.agg(*aggs)


def universe(meters: DataFrame, key: str, export_days: str, flag: str, least_days: int = 30, least_kept: float = 0.95, labelled: Column | None = None) -> DataFrame:
    """Households with enough export days or a flagged meter; an error if too few labelled ones remain."""
    out = meters.groupBy(key).agg(F.sum(export_days).alias("export_days"), F.max(F.col(flag).cast("int")).alias("flag"))
    inside = (F.col("export_days") >= least_days) | (F.col("flag") == 1)
    if labelled is not None:
        row = out.where(labelled).agg(F.avg(inside.cast("double")).alias("kept")).first()
        if row.kept is not None and row.kept < least_kept:
            raise ValueError(f"only {row.kept:.3f} of the labelled households are in the universe")
    return out.where(inside)


def acceptance(df: DataFrame, key: str, counts: dict[str, Column], expected: dict[str, int] | None = None) -> DataFrame:
    """Households and rows that pass each test, in one row; an error if any differs from what is expected."""
    out = df.agg(F.count_distinct(key).alias("households"), *[F.count_if(test).alias(name) for name, test in counts.items()])
    if expected:
        row = out.first().asDict()
        if wrong := {n: row.get(n) for n, want in expected.items() if row.get(n) != want}:
            raise ValueError(f"counts aren't as expected: {wrong}")
    return out
