"""Functions of load-curve arrays.  Slot k of a day ends at (k + 1) quarter hours; a null slot is missing."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOTS = 96


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: array lambdas evaluate what they mention for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(v: Column) -> Column:
    """Sum that takes a missing slot for 0."""
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))


def strict_total(v: Column) -> Column:
    """Null if any slot is missing."""
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))


def finite(v: Column) -> Column:
    return F.filter(v, lambda x: x.isNotNull())


def mean(v: Column) -> Column:
    w = finite(v)
    return F.when(F.size(w) > 0, total(w) / F.size(w))


def part(v: Column, begin: int, end: int) -> Column:
    """Slots ``begin`` to ``end`` (exclusive)."""
    return F.slice(v, begin + 1, end - begin)


def hour_band(v: Column, hours) -> Column:
    """Energy of clock hours; hour h has slots 4h to 4h + 3."""
    out = F.lit(0.0)
    for h in hours:
        out = out + total(part(v, 4 * h, 4 * h + 4))
    return out


def net(imported: Column, exported: Column) -> Column:
    """Import less export, slot by slot; missing if either is."""
    return F.zip_with(imported, exported, lambda a, b: a - b)


def sorted_slots(v: Column) -> Column:
    return F.array_sort(finite(v))


def quantile(v: Column, q: float) -> Column:
    """Linear interpolation between order statistics; null without values."""
    def between(s: Column) -> Column:
        at = (F.size(s) - 1) * F.lit(q)
        low = F.floor(at).cast("int")
        a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
        return F.when(F.size(s) > 0, a + (b - a) * (at - low))

    return bind(sorted_slots(v), between)


def median(v: Column) -> Column:
    return quantile(v, 0.5)


def std(v: Column, ddof: int = 0) -> Column:
    """M06, M07."""
    square = lambda w, m: F.aggregate(w, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))
    return bind(finite(v), lambda w: bind(mean(w), lambda m: F.when(F.size(w) > ddof, F.sqrt(square(w, m) / (F.size(w) - ddof)))))


def steps(v: Column, lag: int = 1) -> Column:
    """Differences over ``lag`` slots, within the array only."""
    return F.zip_with(F.slice(v, lag + 1, F.greatest(F.size(v) - lag, F.lit(0))), F.slice(v, 1, F.greatest(F.size(v) - lag, F.lit(0))), lambda b, a: b - a)


def largest(v: Column, k: int) -> Column:
    """Mean of the k largest."""
    return mean(F.slice(F.reverse(sorted_slots(v)), 1, k))


def peak_slot(v: Column, least: float = 1e-6) -> Column:
    """First slot of the maximum; null if all is missing or the total is nothing."""
    top = F.array_max(finite(v))
    return F.when(total(v) > least, (F.array_position(v, top) - 1).cast("int"))


def share_below(v: Column, limit: float) -> Column:
    """Share of all slots below a limit; a missing slot counts, but not as below."""
    n = F.size(F.filter(v, lambda x: F.coalesce(x < limit, F.lit(False))))
    return F.when(F.size(v) > 0, n / F.size(v))


def hours_above(v: Column, limit: float) -> Column:
    return F.size(F.filter(v, lambda x: x > limit)) / 4


def circular_floor(v: Column, width: int = 4) -> Column:
    """Least mean of ``width`` consecutive slots of the ring."""
    means = lambda ring: F.transform(F.sequence(F.lit(1), F.size(v)), lambda i: mean(F.slice(ring, i, width)))
    return bind(F.concat(v, F.slice(v, 1, width - 1)), lambda ring: F.array_min(finite(means(ring))))


def fourier(v: Column, k: int) -> Column:
    """Magnitude of the k-th Fourier component, divided by the length."""
    n = F.size(v)
    angle = lambda i: 2 * math.pi * k * i / n
    re = F.aggregate(F.transform(v, lambda x, i: x * F.cos(angle(i))), F.lit(0.0), lambda a, x: a + x)
    im = F.aggregate(F.transform(v, lambda x, i: x * F.sin(angle(i))), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(re * re + im * im) / n


def longest_run(flags: Column) -> Column:
    """Length of the longest run of true."""
    start = F.struct(F.lit(0).alias("best"), F.lit(0).alias("now"))
    step = lambda a, x: F.struct(F.greatest(a["best"], F.when(x, a["now"] + 1).otherwise(0)).alias("best"), F.when(x, a["now"] + 1).otherwise(0).alias("now"))
    return F.aggregate(flags, start, step, lambda a: a["best"])


def leading_run(flags: Column) -> Column:
    """How many leading values are true."""
    first = F.array_position(F.transform(flags, lambda x: F.coalesce(x, F.lit(False))), False)
    return F.when(first == 0, F.size(flags)).otherwise((first - 1).cast("int"))


def runs(flags: Column, least: int = 1, circular: bool = False) -> Column:
    """(start, length) of each maximal run of true; on a ring a run may wrap.

    A run of the ring is told from its start: a true slot whose neighbour before it isn't.  Its
    length is the number of leading trues of the ring read from there.
    """
    return bind(F.transform(flags, lambda x: F.coalesce(x, F.lit(False))), lambda f: _runs(f, least, circular))


def _runs(f: Column, least: int, circular: bool) -> Column:
    n = F.size(f)
    before = lambda i: F.when(i > 0, F.get(f, i - 1)).otherwise(F.get(f, n - 1) if circular else F.lit(False))
    starts = F.filter(F.transform(f, lambda x, i: F.when(x & ~before(i), i)), lambda i: i.isNotNull())
    starts = F.when(~F.exists(f, lambda x: ~x) & (n > 0), F.array(F.lit(0))).otherwise(starts)
    read = (lambda i: F.concat(F.slice(f, i + 1, n), F.slice(f, 1, i))) if circular else (lambda i: F.slice(f, i + 1, n))
    found = F.transform(starts, lambda i: F.struct(i.alias("start"), leading_run(read(i)).alias("length")))
    return F.filter(found, lambda r: r["length"] >= least)


def close_gaps(flags: Column, gap: int = 1) -> Column:
    """False runs of at most ``gap`` slots between true ones become true."""

    def closed(f: Column) -> Column:
        at = lambda i: F.when((i >= 0) & (i < F.size(f)), F.get(f, i)).otherwise(False)

        def fill(x: Column, i: Column) -> Column:
            # a run of k false slots is closed if true ones stand at distances a before and b after it with a + b = k + 1
            for a in range(1, gap + 1):
                for b in range(1, gap + 2 - a):
                    x = x | (at(i - a) & at(i + b))
            return x

        return F.transform(f, fill)

    return bind(F.transform(flags, lambda x: F.coalesce(x, F.lit(False))), closed)


def interpolate(v: Column, limit: int = 4) -> Column:
    """Interior gaps of at most ``limit`` slots filled on the straight line between their ends."""
    point = lambda x, i: F.struct(i.alias("i"), x.alias("x"))

    def line(i: Column, a: Column, b: Column) -> Column:
        return F.when(b["i"] - a["i"] - 1 <= limit, a["x"] + (b["x"] - a["x"]) * (i - a["i"]) / (b["i"] - a["i"]))

    def filled(known: Column) -> Column:
        before = lambda i: F.try_element_at(F.filter(known, lambda p: p["i"] < i), F.lit(-1))
        after = lambda i: F.get(F.filter(known, lambda p: p["i"] > i), F.lit(0))
        return F.transform(v, lambda x, i: F.coalesce(x, bind(before(i), lambda a: bind(after(i), lambda b: line(i, a, b)))))

    return bind(F.filter(F.transform(v, point), lambda p: p["x"].isNotNull()), filled)


def rank_filter(v: Column, width: int = 33, q: float = 0.2) -> Column:
    """Centred rolling order statistic; the edges repeat the end values."""
    half = width // 2
    wide = F.concat(F.array_repeat(F.get(v, 0), half), v, F.array_repeat(F.element_at(v, -1), half))
    k = int(q * width)
    return bind(wide, lambda w: F.transform(F.sequence(F.lit(1), F.size(v)), lambda i: F.get(F.array_sort(F.slice(w, i, width)), k)))


def resample(v: Column, n: int) -> Column:
    """The shape stretched to ``n`` points by straight lines, scaled to the same energy."""
    old = F.size(v)
    at = lambda i: i * (old - 1) / F.lit(max(n - 1, 1)).cast("double")
    low = lambda i: F.floor(at(i)).cast("int")
    value = lambda i: F.get(v, low(i)) + (F.get(v, F.least(low(i) + 1, old - 1)) - F.get(v, low(i))) * (at(i) - low(i))
    raw = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), value)
    return bind(raw, lambda r: bind(total(r), lambda whole: bind(total(v), lambda old: F.transform(r, lambda x: F.when(whole != 0, x * old / whole).otherwise(x)))))


def circular_mean(hours: Column, period: float = 24.0) -> Column:
    """Mean of times of a cycle."""
    s = F.aggregate(F.transform(hours, lambda h: F.sin(h * (2 * math.pi / period))), F.lit(0.0), lambda a, x: a + x)
    c = F.aggregate(F.transform(hours, lambda h: F.cos(h * (2 * math.pi / period))), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(hours) > 0, F.pmod(F.atan2(s, c) * (period / (2 * math.pi)), F.lit(period)))


def compact_week(kwh: Column) -> dict[str, Column]:
    """21 statistics of a week of 672 slots, in kW."""
    x = F.transform(kwh, lambda e: e * 4.0)
    ramp = F.transform(steps(x), F.abs)
    out = {f"stat_q{round(100 * q):02d}": quantile(x, q) for q in (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)}
    out["stat_range"] = out["stat_q95"] - out["stat_q05"]
    out["stat_mean"] = mean(x)
    out["stat_load_factor"] = mean(x) / F.greatest(F.array_max(F.transform(x, F.abs)), F.lit(0.1))
    out |= {f"stat_ramp{round(100 * q)}": quantile(ramp, q) for q in (0.5, 0.95, 0.99)}
    night = F.filter(F.transform(x, lambda e, i: F.when((i % 96 < 24) | (i % 96 >= 88), e)), lambda e: e.isNotNull())
    out["stat_night_kwh"] = total(night) / 4
    out["stat_day_kwh"] = (total(x) - total(night)) / 4
    out["stat_weekday_daily_kwh"] = total(part(x, 0, 480)) / 20
    out["stat_weekend_daily_kwh"] = total(part(x, 480, 672)) / 8
    return out | {f"stat_hours_above_{level}": hours_above(x, level) for level in (1.5, 3.0, 5.0, 7.0, 11.0)}
