"""Labels, splits and weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import exact_quantile, numbered


def split_groups(df: DataFrame, group: str, label: str, shares: Sequence[float] = (0.6, 0.2, 0.2), names: Sequence[str] = ("train", "validation", "test"), seed: int = 0) -> DataFrame:
    """(group, label, split): groups of each label are put in an order drawn by hash and cut by shares.

    A group lies in one split; its label is the greatest of its rows.
    """
    groups = df.groupBy(group).agg(F.max(label).alias(label))
    placed = numbered(groups, [group], [label], seed).join(groups.groupBy(label).agg(F.count("*").alias("__n")), label)
    at, edge = (F.col("__r") - 0.5) / F.col("__n"), 0.0
    out = None
    for share, name in zip(shares[:-1], names[:-1]):
        edge += share
        out = F.when(at < edge, name) if out is None else out.when(at < edge, name)
    return placed.select(group, label, out.otherwise(names[-1]).alias("split"))


def folds(df: DataFrame, group: str, label: str, k: int = 5, seed: int = 0) -> DataFrame:
    """(group, label, fold), stratified, a group in one fold."""
    groups = df.groupBy(group).agg(F.max(label).alias(label))
    return numbered(groups, [group], [label], seed).select(group, label, ((F.col("__r") - 1) % k).cast("int").alias("fold"))


def equal_weights(df: DataFrame, group: str) -> DataFrame:
    """Each group has the same weight in all, the mean over rows is 1."""
    n = df.groupBy(group).agg(F.count("*").alias("__n"))
    row = n.agg(F.sum("__n").alias("rows"), F.count("*").alias("groups")).first()
    scale = (row.rows or 0) / max(row.groups, 1)
    return df.join(n, group).withColumn("weight", F.lit(float(scale)) / F.col("__n")).drop("__n")


def positive_unlabelled(years: DataFrame, commissioned: str = "commissioned", year: str = "year", key: str = "gp_nr") -> DataFrame:
    """P after the year of commissioning, U before it, that year itself dropped; without a date the latest year is P
    if the label says so."""
    c = F.year(commissioned)
    latest = years.groupBy(key).agg(F.max(year).alias("__y"))
    role = F.when(F.col(commissioned).isNotNull(), F.when(F.col(year) > c, "P").when(F.col(year) < c, "U").otherwise("DROP")).when(F.col(year) == F.col("__y"), F.when(F.col("label") == 1, "P").otherwise("U")).otherwise("DROP")
    return years.join(latest, key).withColumn("role", role).drop("__y")


def label_variants(df: DataFrame, week: str, earliest: str, latest: str, ev: str, washouts: Sequence[int] = (0, 28, 56, 84)) -> DataFrame:
    """The temporal label by several washouts."""
    from ..functions.dates import temporal_label

    return df.withColumns({f"label_{w}": temporal_label(F.col(ev), F.col(week), F.col(earliest), F.col(latest), w) for w in washouts})


def reconciliation(labelled: DataFrame, exploratory: DataFrame, all_rows: DataFrame, key: str) -> DataFrame:
    """One row: how many keys each table has, keys that are there twice, in no part, or in a part only."""
    flag = lambda df, n: df.groupBy(key).agg(F.count("*").alias(n))
    both = flag(labelled, "a").join(flag(exploratory, "b"), key, "full").join(all_rows.select(key).distinct().withColumn("c", F.lit(1)), key, "full")
    n = F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))
    return both.agg(F.count("a").alias("labelled"), F.count("b").alias("exploratory"), F.count("c").alias("whole"), F.count_if(n > 1).alias("twice"), F.count_if(n == 0).alias("left_out"), F.count_if(F.col("c").isNull()).alias("foreign"))


def reconcile(labelled: DataFrame, exploratory: DataFrame, all_rows: DataFrame, key: str) -> bool:
    """Labelled and exploratory rows together are all rows, none twice."""
    row = reconciliation(labelled, exploratory, all_rows, key).first()
    return not (row.twice or row.left_out or row.foreign)


def impute_median(df: DataFrame, columns: Sequence[str], indicator: bool = True) -> DataFrame:
    """Medians of the columns, exact; with an indicator of what was missing."""
    row = {c: exact_quantile(df, c, 0.5) for c in columns}
    new: dict[str, Column] = {}
    for c in columns:
        if indicator:
            new[f"{c}_missing"] = F.col(c).isNull().cast("int")
        new[c] = F.coalesce(F.col(c), F.lit(row[c]))
    return df.withColumns(new)
