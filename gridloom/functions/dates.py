"""Date and time column functions.  Times are local, fixed at UTC+1, without zone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Named calendars of seasons: month -> season.
CALENDARS = {
    "meter": {**{m: "summer" for m in (5, 6, 7, 8)}, **{m: "winter" for m in (11, 12, 1, 2)}},
    "battery": {**{m: "summer" for m in (5, 6, 7, 8)}, **{m: "winter" for m in (11, 12, 1, 2)}, **{m: "shoulder" for m in (3, 4, 9, 10)}},
    "quarters": {**{m: "winter" for m in (12, 1, 2)}, **{m: "spring" for m in (3, 4, 5)}, **{m: "summer" for m in (6, 7, 8)}, **{m: "autumn" for m in (9, 10, 11)}},
    "sun": {**{m: "sun" for m in range(3, 11)}, **{m: "dark" for m in (11, 12, 1, 2)}},
}


def strict_date(c: Column) -> Column:
    """D01: 'dd.MM.yyyy' and nothing else; invalid is null."""
    return F.when(F.regexp_like(F.trim(c), F.lit(r"^\d{2}\.\d{2}\.\d{4}$")), F.try_to_date(F.trim(c), "dd.MM.yyyy"))


def lenient_date(c: Column) -> Column:
    """Day first, with one or two digits, points, slashes or ISO; else null."""
    t = F.trim(c)
    forms = [(r"^\d{1,2}\.\d{1,2}\.\d{4}", "d.M.yyyy"), (r"^\d{1,2}/\d{1,2}/\d{4}", "d/M/yyyy"), (r"^\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d")]
    return F.coalesce(*[F.when(F.regexp_like(t, F.lit(p)), F.try_to_date(F.regexp_extract(t, p, 0), f)) for p, f in forms])


def stamp_date(c: Column) -> Column:
    """The date of 'dd.MM.yyyy HH:mm'."""
    return F.try_to_timestamp(F.trim(c), F.lit("dd.MM.yyyy HH:mm")).cast("date")


def week_start(d: Column) -> Column:
    """The Monday of the week."""
    return F.date_sub(d, F.weekday(d))


def season(month: Column, calendar: str = "meter", other: str = "shoulder") -> Column:
    """D06."""
    out = None
    for name in dict.fromkeys(CALENDARS[calendar].values()):
        test = month.isin(*[m for m, s in CALENDARS[calendar].items() if s == name])
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(other)


def month_of(d: Column) -> Column:
    """A month as its first day."""
    return F.trunc(d, "month")


def spine(spark: SparkSession, begin: str, end: str, step: str = "1 day") -> DataFrame:
    """Every date of a range, to be joined from the left."""
    return spark.sql(f"SELECT explode(sequence(DATE'{begin}', DATE'{end}', INTERVAL {step})) AS date")


def dst_week(start: Column, zone: str = "Europe/Zurich") -> Column:
    """Whether the zone's clock changes within the seven days from ``start``."""
    noon = lambda d: F.to_utc_timestamp(d.cast("timestamp_ntz").cast("timestamp"), zone).cast("long") - d.cast("timestamp_ntz").cast("timestamp").cast("long")
    return noon(start) != noon(F.date_add(start, 7))


def first_date(*c: Column) -> Column:
    """D11."""
    return F.least(*c)


def last_date(*c: Column) -> Column:
    return F.greatest(*c)


def clock(slot: Column) -> Column:
    """The end of a quarter-hour slot counted from 0, '00:15' to '00:00'."""
    minute = ((slot + 1) * 15) % 1440
    return F.format_string("%02d:%02d", F.floor(minute / 60).cast("int"), (minute % 60).cast("int"))


def in_window(hour: Column, begin: float, end: float) -> Column:
    """Half-open window of the day that may wrap past midnight."""
    return (hour >= begin) & (hour < end) if begin <= end else (hour >= begin) | (hour < end)


def temporal_label(ev: Column, week: Column, earliest: Column, latest: Column, washout: int = 0) -> Column:
    """0 if never, or if the week ends before the earliest date; 1 from the latest date and a
    washout on; null between and without dates."""
    return (
        F.when(ev == 0, 0)
        .when(earliest.isNull() | latest.isNull(), F.lit(None).cast("int"))
        .when(F.date_add(week, 7) <= earliest, 0)
        .when(week >= F.date_add(latest, washout), 1)
    )


def solar(day_of_year: Column, latitude: float = 47.4, longitude: float = 8.1, zone: float = 1.0, zenith: float = 90.833) -> tuple[Column, Column]:
    """Hours of sunrise and sunset by the NOAA equation of time and declination."""
    g = F.lit(2 * math.pi / 365) * (day_of_year - 1 + F.lit(0.0))
    time = 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))
    decl = 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)
    lat = math.radians(latitude)
    arc = math.cos(math.radians(zenith)) / (math.cos(lat) * F.cos(decl)) - math.tan(lat) * F.tan(decl)
    half = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), arc))))
    noon = 720 - 4 * longitude - time
    return (noon - 4 * half) / 60 + zone, (noon + 4 * half) / 60 + zone
