"""Battery signatures of a day's import and export, slot by slot, and their monthly profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V

#: Energy of a slot that counts as none; months in which runs are meaningful; slots around midnight; the middle of the day.
EPS = 0.01
RUN_MONTHS = tuple(range(3, 11))
NIGHT_SLOTS = (*range(88, 96), *range(24))
NIGHT_PART, MIDDAY = (4, 16), (44, 56)
#: Steps that count as flat (kWh, and share of the larger value), slots of a flat block, grid of its power (kW).
FLAT_STEP, FLAT_SHARE, FLAT_SLOTS, POWER_GRID = 0.05, 0.10, 4, 0.25

DAY_MEASURES = (
    "day_kwh", "night_kwh", "evening_zero_share", "zero_run_after_sunset", "step_slot", "step_magnitude", "midday_import_share", "ramp_std_midday", "ramp_std_morning",
    "night_flat_block_share", "night_block_power", "exp_day_kwh", "exp_peak_kw", "exp_start_slot", "exp_end_slot", "exp_peak_flatness",
    "both_zero_share", "both_zero_share_daylight", "flat_interval_share", "flat_interval_power_mode", "export_share_of_daylight_energy",
)
CLEAR_MEASURES = ("evening_zero_share", "both_zero_share", "flat_interval_share", "exp_start_slot")


def picked(v: Column, slots: Sequence[int]) -> Column:
    """The values of ``slots``, which need not be next to one another, in that order."""
    return F.transform(F.array(*[F.lit(s) for s in slots]), lambda i: F.get(v, i))


def most_frequent(values: Column) -> Column:
    """The most frequent value of an array, the smallest of equally frequent ones; null if there is none."""

    def best(v: Column) -> Column:
        counted = F.transform(F.array_distinct(v), lambda x: F.struct(F.size(F.filter(v, lambda y: y == x)).alias("n"), (-x).alias("least")))
        return -F.get(F.reverse(F.array_sort(counted)), F.lit(0))["least"]

    return V.bind(values, best)


def flat_block(v: Column) -> Column:
    """(share, power): share of slots in blocks of at least four in which each step is small, and the power, in kW on a grid,
    at which most of these slots lie.  A missing slot ends a block."""
    small = lambda a, b: F.coalesce(F.abs(b - a) <= F.greatest(F.lit(FLAT_STEP), FLAT_SHARE * F.greatest(F.abs(a), F.abs(b))), F.lit(False))

    def measured(x: Column) -> Column:
        calm = F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), small)

        def summary(runs: Column) -> Column:
            inside = F.flatten(F.transform(runs, lambda r: F.slice(x, r["start"] + 1, r["length"] + 1)))
            return V.bind(inside, lambda w: F.struct((F.size(w) / F.size(x)).alias("share"), most_frequent(F.transform(w, lambda e: F.rint(4 * e / POWER_GRID) * POWER_GRID + 0.0)).alias("power")))

        return V.bind(V.runs(calm, FLAT_SLOTS - 1), summary)

    return V.bind(v, measured)


def _below(x: Column) -> Column:
    return F.coalesce(x < EPS, F.lit(False))


def _import_measures(imp: Column, sunset: Column, in_season: Column) -> list[Column]:
    night = V.total(V.part(imp, *NIGHT_PART))
    first = F.least(F.lit(95), F.greatest(F.lit(0), F.ceil(sunset * 4).cast("int")))
    evening = F.slice(imp, first + 1, 96 - first)

    def behind(b: Column) -> Column:
        # the first slot behind the run that draws more than half of an average slot of the night
        high = F.transform(imp, lambda x, i: F.when((i >= b["from"]) & (x > b["limit"]), i))
        return F.struct(b["run"], F.array_min(F.filter(high, lambda i: i.isNotNull())).alias("step"))

    zero = V.bind(V.leading_run(F.transform(evening, _below)), lambda run: F.struct(run.alias("run"), (first + run).alias("from"), (0.5 * night / 12).alias("limit")))
    found = V.bind(zero, behind)
    run, step = found["run"], found["step"]
    block = flat_block(picked(imp, NIGHT_SLOTS))
    seasonal = lambda c: F.when(in_season, c)
    day = V.total(imp)
    return [
        day.alias("day_kwh"), night.alias("night_kwh"), V.share_below(evening, EPS).alias("evening_zero_share"), seasonal(run / 4).alias("zero_run_after_sunset"),
        seasonal(step).cast("double").alias("step_slot"), seasonal(F.get(imp, step)).cast("double").alias("step_magnitude"), F.when(day > 0, V.total(V.part(imp, *MIDDAY)) / day).alias("midday_import_share"),
        V.std(V.steps(V.part(imp, 44, 60))).alias("ramp_std_midday"), V.std(V.steps(V.part(imp, 28, 40))).alias("ramp_std_morning"), seasonal(block).alias("night_block"),
    ]


def _export_measures(exp: Column) -> list[Column]:
    peak = F.array_max(V.finite(exp))
    places = F.filter(F.transform(exp, lambda x, i: F.when(x > EPS, i)), lambda i: i.isNotNull())
    high = F.size(F.filter(exp, lambda x: (x > EPS) & (x >= 0.95 * peak)))
    return [
        V.total(exp).alias("exp_day_kwh"), (4 * peak).cast("double").alias("exp_peak_kw"), F.array_min(places).cast("double").alias("exp_start_slot"), F.array_max(places).cast("double").alias("exp_end_slot"),
        F.when((F.size(places) > 0) & (peak > 0), high / F.size(places)).alias("exp_peak_flatness"),
    ]


def _joint_measures(imp: Column, exp: Column, sunrise: Column, sunset: Column, in_season: Column) -> list[Column]:
    none = F.zip_with(imp, exp, lambda a, b: _below(a) & _below(b))
    up, down = F.greatest(F.lit(0), F.floor(sunrise * 4).cast("int")), F.least(F.lit(96), F.ceil(sunset * 4).cast("int"))
    light = lambda v: F.slice(v, up + 1, F.greatest(F.lit(0), down - up))
    share = lambda v: F.when(F.size(v) > 0, F.size(F.filter(v, lambda x: x)) / F.size(v))
    sold, used = V.total(light(exp)), V.total(V.part(imp, *MIDDAY))
    return [
        share(none).alias("both_zero_share"), share(light(none)).alias("both_zero_share_daylight"), F.when(in_season, flat_block(V.net(imp, exp))).alias("net_block"),
        F.when(sold + used > 0, sold / (sold + used)).alias("export_share_of_daylight_energy"),
    ]


def battery_day(days: DataFrame, keep: Sequence[str] = ("mp_id", "plz", "date", "is_clear")) -> DataFrame:
    """21 measures of a day.

    ``days`` has the columns ``keep``, a ``date``, ``imp`` and ``exp`` (96 slots in kWh; null if the register is missing, with null slots) and
    ``sunrise`` and ``sunset`` in hours.  What needs a register that is missing is null; measures of runs and blocks are null
    outside of ``RUN_MONTHS``.
    """
    season = F.month("date").isin(*RUN_MONTHS)
    imp, exp = F.col("imp"), F.col("exp")
    has = [imp.isNotNull(), exp.isNotNull(), imp.isNotNull() & exp.isNotNull()]
    parts = [_import_measures(imp, F.col("sunset"), season), _export_measures(exp), _joint_measures(imp, exp, F.col("sunrise"), F.col("sunset"), season)]
    out = days.select(*keep, F.year("date").alias("year"), F.month("date").alias("month"), has[2].alias("has_both"), *[F.when(h, F.struct(*p)).alias(f"__{i}") for i, (h, p) in enumerate(zip(has, parts))])
    flat = out.select(*[c for c in out.columns if not c.startswith("__")], "__0.*", "__1.*", "__2.*")
    named = {"night_flat_block_share": "night_block.share", "night_block_power": "night_block.power", "flat_interval_share": "net_block.share", "flat_interval_power_mode": "net_block.power"}
    return flat.select(*[c for c in out.columns if not c.startswith("__")], *[F.col(named.get(c, c)).alias(c) for c in DAY_MEASURES])


def battery_month(days: DataFrame) -> DataFrame:
    """Mean and deviation of each measure over a meter's month, means over clear days, and the number of days."""
    spec = [f(c).alias(f"{c}_{n}") for c in DAY_MEASURES for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    spec += [F.avg(F.when(F.col("is_clear"), F.col(c))).alias(f"{c}_clear") for c in CLEAR_MEASURES]
    return days.groupBy("mp_id", "year", "month").agg(*spec, F.count_distinct("date").alias("n_days"), F.min_by("plz", "date").alias("plz"))
