"""Events, runs, plateaus and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V


def block_events(series: DataFrame, ids: Sequence[str], vector: str = "residual", amplitude: float = 0.5, gap: int = 1, least: int = 4) -> DataFrame:
    """Runs of residual >= amplitude, gaps of one slot closed, an hour at least, with their shape."""
    flags = V.close_gaps(F.transform(vector, lambda x: F.coalesce(x >= amplitude, F.lit(False))), gap)
    run = series.select(*ids, vector, F.explode(V.runs(flags, least)).alias("r")).select(*ids, vector, F.col("r.start").alias("start"), F.col("r.length").alias("length"))
    x = F.slice(vector, F.col("start") + 1, F.col("length"))
    off = lambda of: V.bind(V.median(x), lambda mid: of(mid))
    before = F.when(F.col("start") > 0, F.get(vector, F.col("start") - 1))
    after = F.get(vector, F.col("start") + F.col("length"))
    return run.select(
        *ids, "start", "length", (F.col("length") / 4).alias("hours"), V.median(x).alias("median"), V.quantile(x, 0.9).alias("p90"), V.total(x).alias("energy"),
        off(lambda mid: V.median(F.transform(x, lambda e: F.abs(e - mid)))).alias("mad"),
        ((F.element_at(x, -1) - F.get(x, 0)) / F.greatest(F.col("length") - 1, F.lit(1))).alias("slope"),
        (off(lambda mid: F.size(F.filter(x, lambda e: F.abs(e - mid) <= 0.15 * mid))) / F.col("length")).alias("plateau_share"),
        (F.get(x, 0) - F.coalesce(before, F.lit(0.0))).alias("rise"), (F.element_at(x, -1) - F.coalesce(after, F.lit(0.0))).alias("fall"),
        V.std(x).alias("std"))


def daily_residual(power: Column, day: int = 96, q: float = 0.2) -> Column:
    """Power less the quantile of its day."""
    base = lambda i: V.quantile(F.slice(power, i * day + 1, day), q)
    bases = F.transform(F.sequence(F.lit(0), (F.size(power) / day).cast("int") - 1), base)
    return V.bind(bases, lambda b: F.transform(power, lambda x, i: x - F.get(b, F.floor(i / day).cast("int"))))


def rolling_residual(power: Column, day: int = 96, width: int = 33, q: float = 0.2) -> Column:
    """Power less the order statistic of the slots around it."""
    return V.bind(V.rank_filter(power, width, q), lambda base: F.zip_with(power, base, lambda x, b: x - b))


#: Baselines by name.
BASELINES = {"daily_q20": daily_residual, "rolling_q20": rolling_residual}


def load_events(weeks: DataFrame, ids: Sequence[str], kwh: str = "q", amplitude: float = 3.0, day: int = 96, residual="daily_q20") -> DataFrame:
    """Events of a week's curve, in kW: runs of residual >= amplitude, one slot closed, an hour at least, each with
    its power, energy, edges, shape and place.  ``residual`` takes the baseline off: one of BASELINES, or a function of (power, day)."""
    residual = BASELINES.get(residual, residual)
    base = weeks.select(*ids, F.transform(kwh, lambda e: e * 4.0).alias("x"))
    base = base.select(*ids, "x", residual(F.col("x"), day).alias("res"))
    base = base.select(*ids, "x", "res", F.transform("res", lambda e: e >= amplitude).alias("high"))
    run = base.select(*ids, "x", "res", "high", F.explode(V.runs(V.close_gaps(F.col("high"), 1), 4)).alias("r"))
    s, n = F.col("r.start"), F.col("r.length")
    run = run.select(*ids, "x", "high", s.alias("start"), (s + n).alias("end"), n.alias("n"), F.slice("res", s + 1, n).alias("y"), F.slice("x", s + 1, n).alias("p"))
    run = run.withColumn("power", V.median(F.col("y")))
    s, e, n, x, y, p, mid = (F.col(c) for c in ("start", "end", "n", "x", "y", "p", "power"))
    share = lambda flags: F.size(F.filter(flags, lambda f: f)) / n
    rise = F.when(s > 0, F.get(x, s) - F.get(x, s - 1)).otherwise(0.0)
    fall = F.when(e < F.size(x), F.get(x, e - 1) - F.get(x, e)).otherwise(0.0)
    scaled = F.transform(y, lambda v: v / F.greatest(mid, F.lit(0.1)))
    line = lambda i: 1.2 - 0.4 * i / F.greatest(n - 1, F.lit(1))
    miss = F.least(V.mean(F.transform(scaled, lambda v: F.abs(v - 1))), V.mean(F.transform(scaled, lambda v, i: F.abs(v - line(i)))))
    near = F.slice(x, F.greatest(s - 4, F.lit(0)) + 1, F.least(e + 4, F.size(x)) - F.greatest(s - 4, F.lit(0)))
    noon = lambda v, i: (v < 0) & (((s + i) % day) >= 40 * day // 96) & (((s + i) % day) < 60 * day // 96)
    run = run.withColumns({"rise": rise, "fall": fall})
    r, f = F.col("rise"), F.col("fall")
    return run.select(
        *ids, "start", "end", (n / 4).alias("duration"), "power", V.quantile(y, 0.9).alias("power90"),
        (V.total(F.transform(y, lambda v: F.greatest(v, F.lit(0.0)))) / 4).alias("energy"),
        V.median(F.transform(y, lambda v: F.abs(v - mid))).alias("mad"), ((F.element_at(y, -1) - F.get(y, 0)) / F.greatest(n - 1, F.lit(1))).alias("slope"),
        share(F.transform(y, lambda v: F.abs(v - mid) <= F.greatest(F.lit(0.5), 0.2 * mid))).alias("plateau"), "rise", "fall",
        (F.least(F.greatest(r, F.lit(0.0)), F.greatest(f, F.lit(0.0))) / F.greatest(F.abs(r), F.abs(f), F.lit(0.1))).alias("symmetry"),
        F.floor(s / day).cast("int").alias("day"), (F.floor((e - 1) / day) != F.floor(s / day)).alias("cross_midnight"),
        share(F.transform(p, lambda v: v < 0)).alias("negative_share"), share(F.transform(p, noon)).alias("midday_export_share"),
        share(F.transform(F.slice("high", s + 1, n), lambda h: ~h)).alias("interrupted_share"),
        F.array_max(F.transform(V.steps(near), F.abs)).alias("nearby_ramp"), (1 / (1 + miss)).alias("template"),
        (s % day * 24 / day).alias("start_hour"), (e % day * 24 / day).alias("end_hour"))


def event_features(weeks: DataFrame, events: DataFrame, ids: Sequence[str], family: str = "block", duration: float = 1.5, tolerance: float = 0.75, variation: float = 0.3, edge: float = 0.8, symmetry: float = 0.3, min_events: float = 2.0, repeat_days: float = 2.0) -> DataFrame:
    """13 ``event_*`` columns and ``score`` of every week, from its events (E01) of enough duration; all 0 without any.

    Repetition is the number of days with an event of like power.  Families: block, plateau (flat, with two edges alike),
    template (score times the mean fit to a template), repeat_block and repeat_plateau (score times the share of
    ``repeat_days``).  A week's events are few: they meet in one array.
    """
    e = events.where(F.col("duration") >= duration)
    if family in ("plateau", "repeat_plateau"):
        e = e.where((F.col("mad") / F.greatest("power", F.lit(0.1)) <= variation) & (F.col("rise") >= edge) & (F.col("fall") >= edge) & (F.col("symmetry") >= symmetry))
    paired = (F.col("rise") > 0.8) & (F.col("fall") > 0.8) & (F.col("symmetry") > 0.3)
    night = (F.col("start_hour") < 6) | (F.col("start_hour") >= 22)
    each = F.collect_list(F.struct("power", "day"))
    g = e.groupBy(*ids).agg(
        F.count("*").cast("double").alias("event_count"), F.count_distinct("day").cast("double").alias("event_days"), F.sum("duration").alias("event_duration"), F.sum("energy").alias("event_energy"),
        F.max("duration").alias("event_longest"), F.percentile("power", 0.5).alias("event_power"), F.avg("plateau").alias("event_plateau"), F.avg(paired.cast("double")).alias("event_paired"),
        F.avg("template").alias("event_template"), F.avg(night.cast("double")).alias("event_night"), F.avg("negative_share").alias("event_negative"), F.avg("interrupted_share").alias("event_interruptions"),
        each.alias("__all"))
    alike = lambda a: F.size(F.array_distinct(F.transform(F.filter("__all", lambda b: F.abs(b["power"] - a["power"]) <= tolerance), lambda b: b["day"])))
    g = g.withColumn("event_repetition", F.array_max(F.transform("__all", alike)).cast("double")).drop("__all")
    out = weeks.select(*ids).join(g, list(ids), "left").fillna(0.0, [c for c in g.columns if c not in ids])
    score = 1 - F.exp(-F.col("event_count") / min_events)
    if family.startswith("repeat"):
        score = score * F.least(F.col("event_repetition") / repeat_days, F.lit(1.0))
    if family == "template":
        score = score * F.col("event_template")
    return out.withColumn("score", score)


def edge_evidence(weeks: DataFrame, events: DataFrame, ids: Sequence[str], duration: float = 1.0, rise: float = 1.0, variation: float = 0.3, paired: bool = False) -> DataFrame:
    """Of a week's events those that last, begin with a rise and are flat (and, if asked for, end with a fall like
    it): ``strong_event_count`` and ``maximum_rise``."""
    test = (F.col("duration") >= duration) & (F.col("rise") >= rise) & (F.col("power") > 0) & (F.col("mad") / F.greatest("power", F.lit(0.1)) <= variation)
    if paired:
        test = test & (F.col("fall") >= rise / 2) & (F.col("symmetry") >= 0.3)
    g = events.where(test).groupBy(*ids).agg(F.count("*").alias("strong_event_count"), F.max("rise").alias("maximum_rise"))
    return weeks.select(*ids).join(g, list(ids), "left").fillna(0, ["strong_event_count"]).fillna(0.0, ["maximum_rise"])


def sequential_events(series: DataFrame, ids: Sequence[str], vector: str = "q", low: float = 0.8, high: float = 3.0, least: int = 4) -> DataFrame:
    """Steps of at least 0.8 * low over the median of up to four samples before, as long as the excess stays
    above it; accepted if the median excess is within [low, high] and the run is long enough.
    """
    return banded_events(series, ids, vector, {"": (low, high)}, least).drop("band")


def banded_events(series: DataFrame, ids: Sequence[str], vector: str, bands: dict[str, tuple[float, float]], least: int) -> DataFrame:
    """E04 for several bands of power in one pass: (ids, band, start, length, excess).  The scan goes on behind an accepted
    run, so it is told in Python over Arrow batches, a series and a band at a time."""
    import numpy as np

    def scan(x: np.ndarray, low: float, high: float) -> list[tuple[int, int, float]]:
        out, i = [], 1
        rises = np.flatnonzero(np.diff(x) >= 0.8 * low) + 1
        for at in rises.tolist():
            if at < i:
                continue
            before = x[max(0, at - 4) : at]
            before = before[np.isfinite(before)]
            if not len(before):
                continue
            base = float(np.median(before))
            low_again = np.flatnonzero(~(x[at:] - base >= 0.8 * low))
            length = int(low_again[0]) if len(low_again) else len(x) - at
            excess = float(np.median(x[at : at + length] - base)) if length else 0.0
            if length >= least and low <= excess <= high:
                out.append((at, length, excess))
                i = at + length
        return out

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            curves = batch.column(len(ids)).to_pylist()
            arrays = [np.array([np.nan if v is None else v for v in x or ()], float) for x in curves]
            found = [(k, name, *e) for k, x in enumerate(arrays) for name, (low, high) in bands.items() for e in scan(x, low, high)]
            at, band, start, length, excess = zip(*found) if found else ((), (), (), (), ())
            keys = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(band, pa.string()), pa.array(start, pa.int32()), pa.array(length, pa.int32()), pa.array(excess, pa.float64())], [*ids, "band", "start", "length", "excess"])

    fields = ", ".join(f"`{c}` {t}" for c, t in series.select(*ids).dtypes)
    return series.select(*ids, vector).mapInArrow(run, f"{fields}, band string, start int, length int, excess double")


def plateaus(profiles: DataFrame, ids: Sequence[str], p10: str = "p10", p50: str = "p50", least_kw: float = 0.25, least_hours: float = 0.5) -> DataFrame:
    """Runs on the ring where the median stands ``least_kw`` over the ring's floor; long and strong ones first.

    The floor is the least hourly mean of the 10th percentile.
    """
    floor = V.circular_floor(F.col(p10))
    base = profiles.withColumn("__f", floor)
    flags = F.transform(p50, lambda x: (x - F.col("__f")) * 4 >= least_kw)
    found = base.select(*ids, p50, "__f", F.explode(V.runs(flags, int(least_hours * 4), circular=True)).alias("r"))
    ring = F.concat(p50, p50)
    x = F.slice(ring, F.col("r.start") + 1, F.col("r.length"))
    return found.select(*ids, F.col("r.start").alias("start"), F.col("r.length").alias("length"), (F.col("r.length") / 4).alias("hours"),
        ((V.median(x) - F.col("__f")) * 4).alias("amplitude_kw"), (F.col("r.start") + F.col("r.length") > F.size(p50)).alias("wraps"))


def plateau_class(kw: Column, hours: Column) -> Column:
    """E06."""
    return F.when(kw >= 1.5, "resistance_boiler").when(kw.between(0.25, 1.2) & hours.between(1.5, 9.0), "wpb_candidate").otherwise("other")


def two_season_score(summer_kw: Column, winter_kw: Column, summer_start: Column, winter_start: Column) -> Column:
    """0 without a plateau, 0.35 with one season's, else by likeness of power and start on the clock."""
    ratio = F.least(summer_kw, winter_kw) / F.greatest(summer_kw, winter_kw)
    d = F.abs(summer_start - winter_start) / 4
    shift = F.least(d, 24 - d)
    both = 0.5 + 0.3 * ratio + 0.2 * F.greatest(F.lit(0.0), 1 - shift / 3)
    return F.when(summer_kw.isNotNull() & winter_kw.isNotNull(), both).when(summer_kw.isNotNull() | winter_kw.isNotNull(), 0.35).otherwise(0.0)


def donor_event(vector: Column, start: int, length: int, margin: int = 4) -> Column:
    """Of the runs of at least half the core's power, the one that overlaps the core (and an hour around) most."""
    n = F.size(vector)
    core = V.part(vector, max(0, start - margin), start + length + margin)
    flags = V.bind(V.median(core), lambda m: F.transform(vector, lambda x: x >= m / 2))
    lo, hi = start - margin, start + length + margin
    scored = F.transform(V.runs(flags), lambda r: F.struct((F.least(r["start"] + r["length"], F.lit(hi)) - F.greatest(r["start"], F.lit(lo))).alias("overlap"), (-r["start"]).alias("order"), r["start"].alias("start"), r["length"].alias("length")))
    return F.when(n > 0, F.array_max(F.filter(scored, lambda r: r["overlap"] > 0)))


def inject(host: Column, event: Column, at: Column, kwh: Column) -> Column:
    """An event's shape, scaled to an energy, added to a host's day on the ring: its energy is kept."""
    n = F.size(host)
    shaped = lambda scale: F.transform(host, lambda x, i: x + F.when(F.pmod(i - at, n) < F.size(event), F.get(event, F.pmod(i - at, n)) * scale).otherwise(0.0))
    return V.bind(kwh / V.total(event), shaped)


def noise_band(x: Column) -> Column:
    """E10."""
    return F.when(x <= 0.0625, "quiet").when(x <= 0.125, "medium").when(x > 0.125, "noisy")


def override(base: Column, rescue: Column, veto: Column) -> Column:
    """A rescue makes a negative positive, a veto a positive negative; both together change nothing."""
    return F.when(rescue & ~veto, 1).when(veto & ~rescue, 0).otherwise(base)


def weighted_score(peak: Column, high: Column, night: Column) -> Column:
    """E13."""
    return 0.35 * peak + 0.45 * high + 0.20 * night


def silver_flags(meters: DataFrame, export_days: int = 30, peak=(44, 60), least_share: float = 0.5) -> DataFrame:
    """Production meters and silver positives by thresholds of export statistics."""
    share = F.col("export_days") / F.greatest(F.col("days"), F.lit(1))
    production = (share > 0.95) & (F.coalesce(F.col("import_kwh"), F.lit(0.0)) < 0.01 * F.col("export_kwh"))
    silver = (F.col("export_days") >= export_days) & F.col("peak_slot").between(*peak) & (share >= least_share)
    out = meters.withColumn("is_production", F.coalesce(production, F.lit(False)))
    return out.withColumn("is_silver", F.coalesce(silver, F.lit(False)) & ~F.col("is_production"))


def ramp_scores(weeks: DataFrame, ids: Sequence[str], vector: str = "q", level_kw: float = 9.0) -> DataFrame:
    """Greatest rise in kW within a day, and days with such a rise for each 100."""
    rise = F.array_max(F.transform(V.steps(F.col(vector)), lambda d: d * 4))
    days = weeks.select(*ids, rise.alias("rise"))
    return days.groupBy(*ids).agg(F.max("rise").alias("max_ramp"), (100 * F.avg((F.col("rise") >= level_kw).cast("double"))).alias("ramp_days_per_100"))


def timed_ramps(series: DataFrame, ids: Sequence[str], vector: str, least_rise: float = 2.0, sustain: int = 4) -> DataFrame:
    """Rises of at least ``least_rise`` kW that last: count, days, median and greatest rise, mean start on the clock."""
    def found(kw: Column) -> Column:
        at = lambda x, i: F.struct(i.alias("i"), (x - F.when(i > 0, F.get(kw, i - 1))).alias("rise"), V.mean(F.slice(kw, i + 1, sustain)).alias("level"))
        return F.filter(F.transform(kw, at), lambda p: (p["rise"] >= least_rise) & (p["level"] >= least_rise))

    def summary(big: Column) -> Column:
        rises = F.transform(big, lambda p: p["rise"])
        return F.struct(F.size(big).alias("ramps"), V.median(rises).alias("rise_median"), F.array_max(rises).alias("rise_max"),
            F.size(F.array_distinct(F.transform(big, lambda p: F.floor(p["i"] / 96)))).alias("days"),
            V.circular_mean(F.transform(big, lambda p: (p["i"] % 96) / 4)).alias("start_mean"))

    out = V.bind(V.bind(F.transform(vector, lambda x: x * 4), found), summary)
    return series.select(*ids, out.alias("r")).select(*ids, "r.*")


def distribution_features(series: DataFrame, ids: Sequence[str], vector: str) -> DataFrame:
    """Tails, concentration, entropy of levels and differences over several lags."""
    x = F.col(vector)
    top = V.largest(x, 67)
    out = [*ids, V.mean(x).alias("dist_mean"), V.std(x).alias("dist_std"), top.alias("dist_top"), (V.quantile(x, 0.99) - V.median(x)).alias("dist_tail")]
    out += [V.mean(F.transform(V.steps(x, k), F.abs)).alias(f"multi_diff_{k}") for k in (1, 2, 4, 8)]
    ends = F.struct(F.array_min(x).alias("low"), F.greatest(F.array_max(x) - F.array_min(x), F.lit(1e-9)).alias("range"))
    level = V.bind(ends, lambda e: F.transform(x, lambda v: F.least(F.lit(9), F.floor((v - e["low"]) / e["range"] * 10).cast("int"))))
    share = V.bind(level, lambda l: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.size(F.filter(l, lambda v: v == k)) / F.size(x)))
    out.append((-V.total(F.transform(share, lambda p: F.when(p > 0, p * F.ln(p)).otherwise(0.0)))).alias("multi_entropy"))
    return series.select(*out)


def shape_features(series: DataFrame, ids: Sequence[str], vector: str, components: Sequence[int] = (1, 2, 3, 7, 14, 21, 28), blocks: int = 4) -> DataFrame:
    """Means of blocks of the centred and scaled curve, and Fourier magnitudes."""
    x = F.col(vector)
    scale = F.struct(V.median(x).alias("m"), F.greatest(V.quantile(x, 0.95) - V.quantile(x, 0.05), F.lit(0.1)).alias("s"))

    def summary(z: Column) -> Column:
        n = F.size(z)
        means = [V.mean(F.slice(z, (n * b / blocks).cast("int") + 1, (n / blocks).cast("int"))).alias(f"shape_block{b}") for b in range(blocks)]
        return F.struct(*means, *[V.fourier(z, k).alias(f"fourier_{k}") for k in components])

    out = V.bind(V.bind(scale, lambda c: F.transform(x, lambda v: (v - c["m"]) / c["s"])), summary)
    return series.select(*ids, out.alias("r")).select(*ids, "r.*")


def stable_share(vector: Column, width: float = 0.05, least: int = 8) -> Column:
    """Share of slots in runs in which no step is larger than ``width``."""
    calm = V.runs(F.transform(V.steps(vector), lambda d: F.abs(d) <= width), least - 1)
    return F.aggregate(calm, F.lit(0), lambda a, r: a + r["length"] + 1) / F.size(vector)
