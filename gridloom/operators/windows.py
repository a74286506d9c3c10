"""Ordered and window operators on rows (see ``functions.vectors`` for those on arrays)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws


def clear_days(weather: DataFrame, q: float = 0.75, top: float = 0.95, most: float = 1.5) -> DataFrame:
    """A day is clear if its radiation reaches the upper quartile of its calendar month; clearness is
    radiation over the 95th percentile.

    A month's limits and its days come from one pass: means of doubles that are worked out again, in another order of
    addition, differ in their last bit, and the day that is the quartile itself wouldn't reach it.
    """
    month = Window.partitionBy("__month")  # a row a day, which the percentile holds in any case
    limits = {name: F.percentile("radiation", p).over(month) for name, p in (("__q", q), ("__top", top))}
    days = weather.withColumn("__month", F.month("date")).where("__month is not null").withColumns(limits)
    clearness = F.least(F.lit(most), F.greatest(F.lit(0.0), F.when(F.col("__top") > 0, F.col("radiation") / F.col("__top"))))
    return days.select(*weather.columns, (F.col("radiation") >= F.col("__q")).alias("is_clear"), clearness.alias("clearness"))


def largest_drop(years: DataFrame, key: str, value: str, order: str = "year") -> DataFrame:
    """Greatest fall from one year to the next."""
    w = Window.partitionBy(key).orderBy(order)
    return years.withColumn("__d", F.lag(value).over(w) - F.col(value)).groupBy(key).agg(F.max("__d").alias("drop"))


def running_sums(df: DataFrame, order: str, sums: Sequence[str], descending: bool = False, buckets: int = 256) -> DataFrame:
    """Adds ``sums`` up along ``order`` over the whole table, the row itself included, without one partition for all.

    Approximate quantiles cut the order into buckets (what reaches the driver is their bounds); buckets are added
    up first, then rows within a bucket.  ``order`` is a number and distinct, so no bucket is larger for ties.
    """
    cuts = df.agg(F.percentile_approx(order, [k / buckets for k in range(1, buckets)], 10_000).alias("c")).first().c or []
    bounds = F.array(*[F.lit(x) for x in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    rows = df.withColumn("__bucket", F.size(F.filter(bounds, lambda x: x <= F.col(order))))
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    before = Window.orderBy(way("__bucket")).rowsBetween(Window.unboundedPreceding, -1)  # over one row a bucket
    whole = rows.groupBy("__bucket").agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    whole = whole.select("__bucket", *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in sums])
    inside = Window.partitionBy("__bucket").orderBy(way(order))
    out = rows.join(F.broadcast(whole), "__bucket")  # at most ``buckets`` rows
    return out.select(*[c for c in df.columns if c not in sums], *[(F.sum(c).over(inside) + F.col(f"__{c}")).alias(c) for c in sums])


def numbered(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), seed: int = 0, name: str = "__r", buckets: int = 1024) -> DataFrame:
    """Rows numbered from 1 within ``keys`` in an order drawn by a hash of the columns ``order`` (``functions.draws``, so SQL has the same).

    No partition holds a whole group: the hash cuts it into buckets, rows are numbered within a bucket, and buckets are
    counted first (for each group ``buckets`` rows at most).
    """
    h = draws.number(seed, *[F.col(f"`{c}`") for c in order])
    rows = df.withColumn("__h", h).withColumn("__bucket", F.shiftright("__h", 4 * draws.DIGITS - (buckets - 1).bit_length()))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*keys, "__bucket").agg(F.count("*").alias("__size"))
    starts = sizes.select(*keys, "__bucket", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*keys, "__bucket").orderBy("__h", *[F.col(f"`{c}`") for c in order])
    out = rows.join(starts, [*keys, "__bucket"]).withColumn(name, F.col("__before") + F.row_number().over(inside))
    return out.select(*df.columns, name)


def exact_quantile(df: DataFrame, value: str, q: float) -> float | None:
    """The quantile between order statistics over a whole table: values are counted, and ranks are running sums over the
    distinct ones, so no buffer holds them all."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("n")).first().n
    if not total:
        return None
    at = (total - 1) * q
    low = math.floor(at)
    upto = running_sums(counts, "v", ["n"])
    row = upto.agg(F.min(F.when(F.col("n") > low, F.col("v"))).alias("a"), F.min(F.when(F.col("n") > math.ceil(at), F.col("v"))).alias("b")).first()
    return row.a + (row.b - row.a) * (at - low)


def average_rank(df: DataFrame, value: str, name: str = "rank", keys: Sequence[str] = ()) -> DataFrame:
    """Ranks from 1; equal values share the mean of theirs; nulls have none.

    Counted by value and summed by range, so no partition holds all rows: values are counted first
    (equal ones meet in one row), and ranks are running sums over the distinct values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    if keys:
        ranks = counts.select(*keys, value, (F.sum("__n").over(Window.partitionBy(*keys).orderBy(value)) - (F.col("__n") - 1) / 2).alias(name))
    else:
        ranks = running_sums(counts.withColumn("__all", F.col("__n")), value, ["__all"]).select(value, (F.col("__all") - (F.col("__n") - 1) / 2).alias(name))
    return df.join(ranks, [*keys, value], "left")


def percentile_rank(df: DataFrame, value: str, name: str = "pct", keys: Sequence[str] = ()) -> DataFrame:
    """Average rank over the number of values."""
    ranked = average_rank(df, value, "__rank", keys)
    if keys:
        sizes = df.groupBy(*keys).agg(F.count(value).alias("__size"))
        ranked = ranked.join(sizes, list(keys))
        return ranked.withColumn(name, F.col("__rank") / F.col("__size")).drop("__rank", "__size")
    n = df.agg(F.count(value).alias("n")).first().n
    return ranked.withColumn(name, F.col("__rank") / F.lit(float(max(n, 1)))).drop("__rank")


def reference_percentile(df: DataFrame, value: str, reference: DataFrame, of: str, name: str = "pct") -> DataFrame:
    """Share of the reference's values that are at most this one."""
    both = df.select(F.col(value).alias("__v")).distinct().withColumn("__r", F.lit(0)).unionByName(reference.where(F.col(of).isNotNull()).select(F.col(of).alias("__v"), F.lit(1).alias("__r")))
    grouped = both.groupBy("__v").agg(F.sum("__r").alias("__n"))
    n = reference.agg(F.count(of).alias("n")).first().n
    shares = running_sums(grouped, "__v", ["__n"]).select("__v", (F.col("__n") / F.lit(float(max(n, 1)))).alias(name))
    return df.join(shares, F.col(value) == F.col("__v"), "left").drop("__v")


def pettitt(df: DataFrame, keys: Sequence[str], order: str, value: str, least: int = 4) -> DataFrame:
    """Change point of each series: (at, k, p); (-1, 0, 1) for short ones.

    U(t) = 2 * sum of the first t ranks - t (n + 1); the greatest |U| is K.
    """
    ranked = average_rank(df, value, "__rank", keys)
    w = Window.partitionBy(*keys)
    t = F.row_number().over(w.orderBy(order))
    u = 2 * F.sum("__rank").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__t") * (F.col("__n") + 1)
    steps = ranked.withColumn("__t", t).withColumn("__n", F.count("*").over(w)).withColumn("__u", F.abs(u))
    top = steps.where("__t < __n").groupBy(*keys).agg(F.max("__u").alias("k"), F.max_by(F.col("__t"), F.struct(F.col("__u"), -F.col("__t"))).alias("at"), F.first("__n").alias("n"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    long = F.col("n") >= least
    out = df.groupBy(*keys).agg(F.count("*").alias("__c")).join(top, list(keys), "left")
    return out.select(*keys, F.when(long, F.col("at") - 1).otherwise(-1).cast("int").alias("at"), F.when(long, k).otherwise(0.0).alias("k"),
        F.when(long, F.least(F.lit(1.0), 2 * F.exp(-6 * k * k / (n * n * n + n * n)))).otherwise(1.0).alias("p"))


def lag_differences(df: DataFrame, keys: Sequence[str], order: str, value: str, lags: Sequence[int] = (1, 2, 4, 8)) -> DataFrame:
    """Differences over some rows, within a group."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumns({f"diff_{k}": F.col(value) - F.lag(value, k).over(w) for k in lags})


def daily_residual(df: DataFrame, keys: Sequence[str], value: str, q: float = 0.2) -> DataFrame:
    """Value less the day's quantile."""
    base = df.groupBy(*keys).agg(F.percentile(value, q).alias("base"))
    return df.join(base, list(keys)).withColumn("residual", F.col(value) - F.col("base"))


def trailing_median(df: DataFrame, keys: Sequence[str], order: str, value: str, n: int = 4) -> DataFrame:
    """Median of the n rows before."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-n, -1)
    return df.withColumn("before", F.percentile(F.col(value), 0.5).over(w))


def leading_fall(df: DataFrame, keys: Sequence[str], order: str, value: str, n: int = 32) -> DataFrame:
    """Greatest fall to one of the n rows after."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1, n)
    return df.withColumn("fall", F.col(value) - F.min(value).over(w))


def islands(df: DataFrame, keys: Sequence[str], slot: str, test: Column, gap: int = 1, least: int = 1) -> DataFrame:
    """Runs of rows that pass a test; slots that miss ``gap`` at most don't break a run."""
    w = Window.partitionBy(*keys).orderBy(slot)
    hits = df.where(test).select(*keys, slot)
    new = (F.col(slot) - F.coalesce(F.lag(slot).over(w), F.col(slot) - gap - 2) > gap + 1).cast("int")
    numbered = hits.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w))
    runs = numbered.groupBy(*keys, "__run").agg(F.min(slot).alias("start"), (F.max(slot) - F.min(slot) + 1).alias("length"), F.count("*").alias("hits"))
    return runs.where(F.col("length") >= least).drop("__run")


def keep_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key doesn't repeat; all copies go."""
    once = df.groupBy(*keys).count().where("count = 1").select(*keys)
    return df.join(once, list(keys), "left_semi")


def share_of_group(df: DataFrame, keys: Sequence[str], value: str, name: str = "share") -> DataFrame:
    """W25, W01, W06."""
    sums = df.groupBy(*keys).agg(F.sum(value).alias("__s"))
    return df.join(sums, list(keys)).withColumn(name, F.when(F.col("__s") > 0, F.col(value) / F.col("__s"))).drop("__s")


#: Rows that a window without a partition may hold.
SHORT_ROWS = 100_000


def short(df: DataFrame, rows: int = SHORT_ROWS) -> DataFrame:
    """The table, if it is as short as a window without a partition needs it; else an error."""
    if df.limit(rows + 1).count() > rows:
        raise ValueError(f"more than {rows} rows; number them in buckets (numbered, running_sums)")
    return df


def leaderboard(df: DataFrame, *order: Column) -> DataFrame:
    """A position for each experiment; a leaderboard is short, which is checked."""
    return short(df).withColumn("position", F.row_number().over(Window.orderBy(*order)))
