"""Structured Streaming forms of the meter operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import negative_load


def pair_registers_stream(readings: DataFrame, wait: str = "1 hour") -> DataFrame:
    """Import and export of the same meter and interval side by side, as a stream.

    ``readings`` has (mp_id, ts, register, kwh).  Late rows are waited for until the watermark passes;
    an interval of which one register never came is sent then, with a null.
    """
    side = lambda n: F.sum(F.when(F.col("register") == n, F.col("kwh"))).alias(n)
    slot = F.window("ts", "15 minutes")
    both = readings.withWatermark("ts", wait).groupBy("mp_id", slot.alias("slot")).agg(side("import"), side("export"))
    return both.select("mp_id", F.col("slot.start").alias("ts"), "import", "export")


def daily_energy_stream(readings: DataFrame, wait: str = "1 hour") -> DataFrame:
    """Tumbling days."""
    return readings.withWatermark("ts", wait).groupBy("mp_id", "register", F.window("ts", "1 day").alias("day")).agg(F.sum("kwh").alias("kwh"), F.count("*").alias("n")).select("mp_id", "register", F.col("day.start").alias("ts"), "kwh", "n")


def rolling_hour_stream(readings: DataFrame, wait: str = "1 hour") -> DataFrame:
    """Sliding hours, one for each quarter."""
    return readings.withWatermark("ts", wait).groupBy("mp_id", F.window("ts", "1 hour", "15 minutes").alias("hour")).agg(F.sum("kwh").alias("kwh")).select("mp_id", F.col("hour.start").alias("ts"), "kwh")


def sessions_stream(readings: DataFrame, gap: str = "30 minutes", wait: str = "1 hour") -> DataFrame:
    """Runs of readings with no gap longer than ``gap``."""
    s = F.session_window("ts", gap)
    return readings.withWatermark("ts", wait).groupBy("mp_id", s.alias("s")).agg(F.count("*").alias("n"), F.sum("kwh").alias("kwh")).select("mp_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "kwh")


def deduplicated(readings: DataFrame, wait: str = "1 hour") -> DataFrame:
    """A re-sent reading counts once within the watermark."""
    return readings.withWatermark("ts", wait).dropDuplicatesWithinWatermark(["mp_id", "ts", "register"])


def upsert_days(path: str):
    """A ``foreachBatch`` function that replaces the days of each micro-batch; running a batch again
    leaves the same files."""

    def write(batch: DataFrame, _: int) -> None:
        batch.withColumn("date", F.to_date("ts")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)

    return write


def negative_load_batch(pairs: DataFrame) -> DataFrame:
    """The batch reading of what ``pair_registers_stream`` sends."""
    return negative_load(pairs)
