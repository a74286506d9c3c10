"""Projections, filters, reshaping, joins, sorts and set operations."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws, text
from .windows import numbered

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


# -- projections and guards ---------------------------------------------------
def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """P01."""
    return df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns])


def feature_columns(df: DataFrame, prohibited: Sequence[str] = (), pattern: str | None = None) -> list[str]:
    """Numeric columns that aren't prohibited and match a pattern, by name."""
    return sorted(c for c, kind in df.dtypes if kind in NUMERIC and c not in prohibited and (not pattern or re.search(pattern, c)))


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """P17."""
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def guard_features(features: Sequence[str], prohibited: Sequence[str], prefixes: Sequence[str] = ()) -> None:
    """An error for a leaking column, or one outside the allowed prefixes."""
    bad = [f for f in features if f in prohibited or prefixes and not f.startswith(tuple(prefixes))]
    if bad:
        raise ValueError(f"not allowed as features: {', '.join(bad)}")


def drop_constant(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One aggregation over all columns."""
    row = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if row[c] < 2])


def with_support(df: DataFrame, keys: Sequence[str], least: int, what: str = "*") -> DataFrame:
    """Rows of groups that have at least so many rows."""
    groups = df.groupBy(*keys).agg(F.count(what).alias("__n")).where(F.col("__n") >= least).select(*keys)
    return df.join(groups, list(keys), "left_semi")


def eligible(df: DataFrame, flag: str, target: str) -> DataFrame:
    """P20."""
    return df.where((F.col(flag) == 1) & F.col(target).isNotNull())


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "interval", value: str = "value") -> DataFrame:
    """P21."""
    return df.unpivot(list(ids), list(columns), name, value)


def slots(df: DataFrame, ids: Sequence[str], vector: str = "q") -> DataFrame:
    """P21 of an array: (ids, slot, value)."""
    return df.select(*ids, F.posexplode(vector).alias("slot", "value"))


def pivot(df: DataFrame, ids: Sequence[str], name: str, values: Sequence, agg: Column) -> DataFrame:
    """The values are given, so no pass is spent to find them."""
    return df.groupBy(*ids).pivot(name, list(values)).agg(agg)


def named_slots(df: DataFrame, vector: str, prefix: str = "net_load") -> DataFrame:
    """A week's array as columns ``prefix_day_HH_MM_kwh``; for exports only."""
    days = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
    names = [f"{prefix}_{d}_{(k + 1) * 15 % 1440 // 60:02d}_{(k + 1) * 15 % 60:02d}_kwh" for d in days for k in range(96)]
    return df.select(*[c for c in df.columns if c != vector], *[F.get(vector, F.lit(i)).alias(n) for i, n in enumerate(names)])


# -- joins ----------------------------------------------------------------------
def meter_chain(households: DataFrame, mapping: DataFrame) -> DataFrame:
    """(gp_nr, zpb, anlage) with the meters of each designation; many to many."""
    return households.join(mapping.select("zpb", "mp_id"), "zpb", "left").select("gp_nr", "zpb", "anlage", "mp_id")


def linked_meters(households: DataFrame, mapping: DataFrame, customers: DataFrame) -> DataFrame:
    """Distinct links of known customers to meters, with how many meters a designation and how
    many customers a meter has."""
    meters = mapping.select("zpb", "mp_id").where("mp_id is not null").distinct()
    known = households.select("gp_nr", "zpb").distinct().join(customers.select("gp_nr").distinct(), "gp_nr", "left_semi")
    links = known.join(meters, "zpb")
    per_zpb = meters.groupBy("zpb").agg(F.count("*").alias("meters_of_zpb"))
    per_meter = links.select("mp_id", "gp_nr").distinct().groupBy("mp_id").agg(F.count("*").alias("customers_of_meter"))
    return links.join(per_zpb, "zpb").join(per_meter, "mp_id")


def join_checked(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", one_to_one: bool = False) -> DataFrame:
    """An error if a key of the right (or, one to one, of either) side repeats."""
    for side in (right, left) if one_to_one else (right,):
        if side.groupBy(*on).count().where("count > 1").limit(1).count():
            raise ValueError(f"keys {', '.join(on)} repeat")
    return left.join(right, list(on), how)


def with_household(meters: DataFrame, links: DataFrame) -> DataFrame:
    """Every meter has a household, made up from its id if it isn't linked."""
    return meters.join(links, "mp_id", "left").withColumn("gp_nr", text.meter_household(F.col("gp_nr"), F.col("mp_id")))


def semi(left: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """J08, U03."""
    return left.join(keys.select(*on).distinct(), list(on), "left_semi")


def anti(left: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """J09, U04."""
    return left.join(keys.select(*on).distinct(), list(on), "left_anti")


def look_up(df: DataFrame, key: str, table: dict, name: str) -> DataFrame:
    """A literal map for a few entries; larger ones are a join."""
    if len(table) > 1000:
        raise ValueError("too many entries for a literal: join a table")
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return df.withColumn(name, F.try_element_at(F.create_map(*pairs), F.col(key)) if pairs else F.lit(None))


def months_overlapping(windows: DataFrame, months: DataFrame, key: str = "gp_nr") -> DataFrame:
    """Months of the same household from the month of ``first_day`` to that of ``last_day``.

    A window is spelled out as its months, so the range join is a hash join on household and month.
    """
    each = F.explode(F.sequence(F.trunc("first_day", "month"), F.trunc("last_day", "month"), F.expr("interval 1 month")))
    spelled = windows.where("first_day <= last_day").withColumn("month", each)
    return spelled.join(months, [key, "month"])


def pair_registers(readings: DataFrame, keys: Sequence[str], register: str = "register", value: str = "kwh", names: tuple[str, str] = ("import", "export"), outer: bool = False) -> DataFrame:
    """Import and export of the same keys side by side: one conditional aggregation, no self-join."""
    side = lambda n: F.sum(F.when(F.col(register) == n, F.col(value))).alias(n)
    both = readings.groupBy(*keys).agg(side(names[0]), side(names[1]))
    return both if outer else both.where(F.col(names[0]).isNotNull() & F.col(names[1]).isNotNull())


def before_after(df: DataFrame, key: str, date: str, event: str, values: Sequence[str]) -> DataFrame:
    """The last row before and the first one from the event on, side by side."""
    row = F.struct(F.col(date), *values)
    both = df.groupBy(key).agg(F.max(F.when(F.col(date) < F.col(event), row)).alias("a"), F.min(F.when(F.col(date) >= F.col(event), row)).alias("b"))
    return both.where("a is not null and b is not null").select(key, *[F.col(f"{s}.{v}").alias(f"{v}_{n}") for s, n in (("a", "pre"), ("b", "post")) for v in (date, *values)])


def month_pair(profiles: DataFrame, summer: str, winter: str, key: str = "mp_id", month: str = "month") -> DataFrame:
    """A meter's July row with its January row, where there is one."""
    values = [c for c in profiles.columns if c not in (key, month)]
    one = lambda m, n: profiles.where(F.col(month) == m).select(key, *[F.col(c).alias(f"{c}_{n}") for c in values])
    return one(summer, "summer").join(one(winter, "winter"), key, "left")


def realign(df: DataFrame, keys: DataFrame, on: Sequence[str], fill: float = 0) -> DataFrame:
    """One row for each given key; what isn't there is ``fill``."""
    return keys.join(df, list(on), "left").fillna(fill)


def grid(spark, **values: Sequence) -> DataFrame:
    """All combinations of a few literal parameters."""
    out = spark.range(1).select()
    for name, items in values.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(x) for x in items])))
    return out


def assign_random(hosts: DataFrame, donors: DataFrame, seed: int = 0) -> DataFrame:
    """Each host gets one donor, the same one for a seed.

    Donors get numbers without a partition that holds all of them; hosts draw a number and meet them by it.
    """
    n = donors.count()
    placed = numbered(donors, donors.columns, seed=seed, name="__n").withColumn("__k", F.col("__n") - 1).drop("__n")
    picked = hosts.withColumn("__k", draws.number(f"host {seed}", *hosts.columns) % F.lit(max(n, 1)))
    return picked.join(placed, "__k").drop("__k")  # Spark broadcasts the donors if they are small enough


def enrich(df: DataFrame, rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Columns of the row that an id names; ids without one have nulls, an id that repeats is an error."""
    return join_checked(df, rows.select(key, *columns), [key])


def with_group(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """A group's aggregates on each of its rows; aggregated before the join, unlike a window."""
    return df.join(df.groupBy(*keys).agg(*aggs), list(keys))


def side_by_side(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer by key."""
    return left.join(right, list(on), "full")


# -- sorts, limits, top-k -----------------------------------------------------------
def ordered(df: DataFrame, *keys: str, nulls_last: bool = True) -> DataFrame:
    """O01, O02: '-name' is descending."""
    order = []
    for k in keys:
        c = F.col(k.lstrip("-"))
        order.append((c.desc_nulls_last() if nulls_last else c.desc()) if k[0] == "-" else (c.asc_nulls_last() if nulls_last else c.asc()))
    return df.orderBy(*order)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """N rows of each group; Spark pushes the limit below the shuffle."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def best_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row with the greatest (order); one aggregation."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__b")) if keys else df.agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__b"))
    return top.select(*keys, "__b.*")


def explain_rows(df: DataFrame, labels: dict[str, str], least: float = 0.7, n: int = 3, name: str = "reasons") -> DataFrame:
    """The names of the n largest scores above a limit, in one string."""
    scored = F.array(*[F.struct((-F.col(c)).alias("s"), F.lit(text_).alias("t")) for c, text_ in labels.items()])
    top = F.slice(F.array_sort(F.filter(scored, lambda x: x["s"] < -least)), 1, n)
    return df.withColumn(name, F.array_join(F.transform(top, lambda x: x["t"]), "; "))


def shuffled(df: DataFrame, key: str, seed: int, name: str = "place") -> DataFrame:
    """Position of each row, from 0, in an order drawn by a hash of its key: no driver, no partition that holds all rows, the same
    order each time."""
    return numbered(df, [key], seed=seed, name=name).withColumn(name, F.col(name) - 1)


# -- sets -----------------------------------------------------------------------------
def stacked(*frames: DataFrame) -> DataFrame:
    """Columns by name; missing ones are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def per_group(df: DataFrame, keys: Sequence[str], function: Callable, schema: str) -> DataFrame:
    """A Python function of a group's rows, as Arrow-backed pandas."""
    return df.groupBy(*keys).applyInPandas(function, schema)


def per_value(df: DataFrame, column: str, function: Callable, kind: str, name: str | None = None) -> DataFrame:
    """A Python function of each value of a column, told to it in Arrow batches as a pandas series; for what built-in functions can't say."""

    def each(values: pd.Series) -> pd.Series:
        return function(values)

    return df.withColumn(name or column, F.pandas_udf(each, kind)(F.col(column)))
