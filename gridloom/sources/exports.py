"""Readers of meter exports, reference tables and artefacts."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

#: German month names, in order.
MONTHS = ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")
#: Registers.
IMPORT, EXPORT = "1-1:1.29.0*255", "1-1:2.29.0*255"
SLOTS = 96
META = ("mp_id", "obis", "date", "plz")


@dataclass(frozen=True)
class MonthlyExport:
    path: str
    year: int
    month: int


def month_of_folder(name: str) -> tuple[int, int] | None:
    """'März 2024' -> (2024, 3)."""
    found = re.fullmatch(rf"({'|'.join(MONTHS)}) (\d{{4}})", name)
    return (int(found[2]), MONTHS.index(found[1]) + 1) if found else None


def choose_exports(paths: list[str], include_stalled: bool = True) -> list[MonthlyExport]:
    """One file for each month; a finished file beats a stalled upload, then the smaller path.  Parts that Spark wrote
    (``part-*``) are one export together: their folder."""
    best: dict[tuple, tuple] = {}
    for path in paths:
        folder, _, name = path.rstrip("/").rpartition("/")
        month = month_of_folder(folder.rpartition("/")[2])
        stalled = ".csv.tmp" in name
        path = folder if name.startswith("part-") else path
        if month and (name.endswith(".csv") or stalled and include_stalled):
            best[month] = min(best.get(month, (True, "~")), (stalled, path)) if month in best else (stalled, path)
    return [MonthlyExport(p, *m) for m, (_, p) in sorted(best.items())]


def list_paths(spark: SparkSession, root: str, pattern: str = "*") -> list[str]:
    """Files below a folder through Hadoop's file system, so any store will do."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return sorted(r.path for r in files.select("path").collect())  # names only: the content column is pruned


def find_single(spark: SparkSession, root: str, pattern: str) -> str:
    """Exactly one match, or an error."""
    found = [p for p in list_paths(spark, root, pattern) if ".tmp." not in p]
    if len(found) != 1:
        raise ValueError(f"{len(found)} files match {pattern}")
    return found[0]


def discover_exports(spark: SparkSession, root: str, include_stalled: bool = True) -> list[MonthlyExport]:
    return choose_exports(list_paths(spark, root, "*.csv*"), include_stalled)


def interval_names() -> list[str]:
    return [f"{(k + 1) * 15 % 1440 // 60:02d}:{(k + 1) * 15 % 60:02d}" for k in range(SLOTS)]


def check_header(header: list[str]) -> str:
    """S04: 'ok', or 'shifted' if the register's label is missing; anything else is an error."""
    names = [h.strip().lstrip("﻿") for h in header]
    times = [n for n in names if re.fullmatch(r"\d{2}:\d{2}", n)]
    if "OBIS-Code" in names:
        if sorted(times) != sorted(interval_names()):
            raise ValueError("the header's intervals aren't the 96 quarter hours")
        return "ok"
    if names[:1] == ["MP ID"] and names[1:2] == ["Datum"]:
        return "shifted"
    raise ValueError("not an export's header")


def read_exports(spark: SparkSession, paths: str | list[str], obis: str | None = None, check: bool = True) -> DataFrame:
    """Exports by position: (mp_id, obis, date, plz, q[96]).

    The header of every file, also of a folder's parts, is held against the known forms before; in the shifted one the label of
    the register is missing, which positions repair.  Cells that aren't numbers are null.  The register predicate runs
    right at the scan.
    """
    if check:
        # first lines only: a file's text is pruned to its first 64 KiB before it is split
        files = spark.read.format("binaryFile").load(paths).select("path", F.make_valid_utf8(F.substring("content", 1, 1 << 16).cast("string")).alias("head"))
        for r in files.select(F.substring_index(F.replace("head", F.lit("\r")), "\n", 1).alias("line")).distinct().collect():
            check_header(r.line.split(";"))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*META, *(f"c{k}" for k in range(SLOTS)), "rest"]])
    raw = spark.read.schema(schema).option("sep", ";").option("header", "true").option("enforceSchema", "true").option("mode", "PERMISSIVE").csv(paths)
    if obis:
        raw = raw.where(F.trim("obis") == obis)
    from ..functions.dates import strict_date

    return raw.select(
        F.trim("mp_id").alias("mp_id"), F.trim("obis").alias("obis"), strict_date(F.col("date")).alias("date"), F.trim("plz").alias("plz"),
        F.array(*[text.number(F.col(f"c{k}")).cast("float") for k in range(SLOTS)]).alias("q"))


def read_reference(spark: SparkSession, path: str, sep: str = ";", rename: dict[str, str] | None = None) -> DataFrame:
    """All text, byte-order mark and white space stripped from header and cells; blank is null."""
    raw = spark.read.option("sep", sep).option("header", "true").option("encoding", "UTF-8").csv(path)
    names = {c: c.lstrip("﻿").strip() for c in raw.columns}
    return raw.select(*[text.squeezed(F.col(f"`{c}`")).alias((rename or {}).get(n, n)) for c, n in names.items()])


def register_profile(readings: DataFrame, rows: int = 200_000) -> DataFrame:
    """Registers in the first rows of a scan; a bounded look, not a statistic of the whole."""
    return readings.limit(rows).groupBy("obis").count()


def by_content(readings: DataFrame, year: int, months: tuple[int, int]) -> DataFrame:
    """Months by the dates in the rows rather than by names of files."""
    return readings.where((F.year("date") == year) & F.month("date").between(*months))


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """By suffix; ``schema`` gives the columns their types."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    schema = options.pop("schema", None)
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        return reader.options(header=True, **options).csv(path)
    if kind in ("json", "jsonl"):
        return reader.options(multiLine=kind == "json", **options).json(path)
    if kind == "orc":
        return reader.options(**options).orc(path)
    if kind in ("pkl", "pickle"):
        raise ValueError("pickles run code when they are read; write the table as Parquet")
    return reader.options(**options).parquet(path)


def read_zipped(spark: SparkSession, path: str, member_suffix: str, sep: str = "\t", quote: str = '"', columns: list[str] | None = None) -> DataFrame:
    """The members of zip archives as text columns; a task reads a member (see ``archives``)."""
    from .archives import read_zipped_text

    return read_zipped_text(spark, path, member_suffix, sep, quote, columns)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Slot profiles (mp_id, month, p10, p50, p90), one array of 96 for each: a Parquet table, or NPZ files."""
    if path.endswith(".npz"):
        from .archives import read_arrays

        return read_arrays(spark, path)
    return spark.read.parquet(path)


def read_config(spark: SparkSession, path: str) -> dict:
    """A small JSON artefact."""
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


#: Months in a period.
PERIODS = {"month": 1, "quarter": 3, "year": 12}


def months_in_order(readings: DataFrame, work, at_once: int = 4, unit: str = "month") -> list:
    """What ``work(first day, rows)`` gives for each period, in order of time.

    Periods are worked on side by side, ``at_once`` of them, so that the tail of one doesn't leave the cluster idle; under a FAIR scheduler each
    has a pool of its own.  A period is asked for by the bounds of its dates, which reach the scan: files and row groups of other periods aren't read.
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    spark = readings.sparkSession
    days = [r.m for r in readings.select(F.trunc("date", unit).alias("m")).distinct().orderBy("m").collect()]
    inside = lambda m: (F.col("date") >= F.lit(m)) & (F.col("date") < F.add_months(F.lit(m), PERIODS[unit]))

    def run(m):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{unit} {m}")
        return work(m, readings.where(inside(m)))

    with ThreadPoolExecutor(at_once) as threads:
        waiting = [threads.submit(inheritable_thread_target(spark)(run), m) for m in days if m is not None]
        return [w.result() for w in waiting]


def months_resumed(readings: DataFrame, work, folder: str, at_once: int = 4, unit: str = "month") -> list[tuple]:
    """(first day, table) of each period, in order.  ``work`` gives a DataFrame, which is stored below ``folder``; a period that was stored to the
    end, by this run or one before it, is neither read nor worked on again."""
    from .sinks import cached

    def run(m, rows: DataFrame):
        return m, cached(readings.sparkSession, folder, f"{unit}={m:%Y-%m-%d}", lambda: work(m, rows))

    return months_in_order(readings, run, at_once, unit)
