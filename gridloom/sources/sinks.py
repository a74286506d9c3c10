"""Writers."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_by_year(df: DataFrame, path: str, date: str) -> None:
    """Parquet in folders by year; only the years in ``df`` are replaced."""
    out = df.withColumn("year", F.year(date))
    out.repartition("year", F.spark_partition_id() % 8).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """K02."""
    df.write.mode("overwrite").option("header", "true").option("sep", sep).csv(path)


def write_table(df: DataFrame, path: str, **properties) -> None:
    """Parquet with a row of properties beside it, instead of pickles and array archives."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    write_json(df.sparkSession, properties, f"{path}/properties")


def _finite(value) -> None:
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("not a number that JSON has")
    for x in value.values() if isinstance(value, dict) else value if isinstance(value, (list, tuple)) else ():
        _finite(x)


def write_json(spark: SparkSession, value, path: str) -> None:
    """Refuses values that aren't finite."""
    _finite(value)
    line = json.dumps(value, ensure_ascii=False, sort_keys=True, allow_nan=False)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def splice(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``old`` whose key isn't in ``new``, and all of ``new``."""
    keys = new.select(key).distinct()
    return old.join(keys, key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def splice_months(path: str, new: DataFrame, month: str = "month") -> None:
    """K05 in place: folders of the months in ``new`` are replaced, all others stay as they are."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(month).parquet(path)


def write_once(df: DataFrame, path: str) -> None:
    """An error if anything is there already."""
    df.write.mode("error").parquet(path)


def split_channels(df: DataFrame, ids: list[str], feed_in: list[str]) -> tuple[DataFrame, DataFrame]:
    """(without feed-in columns, ids and feed-in columns only)."""
    return df.drop(*[c for c in feed_in if c not in ids]), df.select(*ids, *[c for c in feed_in if c not in ids])


def cache_key(*parts) -> str:
    """Name of an intermediate result by what made it."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def cached(spark: SparkSession, folder: str, key: str, make) -> DataFrame:
    """The stored result of ``key``, or that of ``make``, stored."""
    path = f"{folder.rstrip('/')}/{key}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def markdown_lines(df: DataFrame, order: str, rows: int = 50) -> DataFrame:
    """(place, line) of a table for a report: the head, a rule, and the first rows by a column without equal values."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    top = df.orderBy(order).limit(rows).withColumn("place", F.row_number().over(Window.orderBy(order)) + 1)  # ``rows`` rows
    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = df.sparkSession.range(2).select((F.col("id").cast("int")).alias("place"), F.when(F.col("id") == 0, line([F.lit(c) for c in df.columns])).otherwise(line([F.lit("---")] * len(df.columns))).alias("line"))
    return head.unionByName(top.select("place", line([cell(c) for c in df.columns]).alias("line")))


def markdown(df: DataFrame, rows: int = 50) -> str:
    """A small table for a report."""
    head = df.columns
    body = [[str(x) for x in r] for r in df.limit(rows).collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [head, ["---"] * len(head), *body])
