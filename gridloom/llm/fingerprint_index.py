"""Log-structured index of window fingerprints.

A *run* is a table of pieces (see ``repeats``): the hash of a piece's gram, a digest of its words, how often it
occurred, and the block of documents that holds it; in a *lasting* index, which outlives its documents, a piece stands once and has the
hashes of its windows instead.  A run is bucketed and sorted by gram, written once and never changed.  ``add`` writes a batch as a
run of level 0; every ``fanout`` runs of a level are merged into one run of the next.  Runs have the same buckets, so they are
merged, summed up and joined bucket by bucket without an exchange; a batch is exchanged once, whatever the history.

Sums and joins stream through a bucket's rows, of which there is one for each block and distinct piece at most: a passage in every
document weighs one row a block, and no group is held.
Pieces count as equal if the hash of the gram (63 bits) and the BLAKE2 digest of the words (64 bits) agree; windows if the
hashes of gram and window do.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FANOUT, BUCKETS = 4, 64
SPELLED = "block long, gram long, window long, n long"
ENTRIES = "gram long, digest long, n long, who long"
LASTING = f"{ENTRIES}, windows array<long>"
#: Block of what comes from the history.
HISTORY = -1


def bucketed(df: DataFrame, key: str, buckets: int, path: str, sort: tuple[str, ...] = (), by: str | None = None) -> DataFrame:
    """``df`` written and read again in buckets of ``key``: what is grouped by it next isn't exchanged.  ``by``: a column of folders."""
    return df.sparkSession.table(_table(df, key, buckets, path, sort, by))


def _table(df: DataFrame, key: str, buckets: int, path: str, sort: tuple[str, ...] = (), by: str | None = None) -> str:
    # groups of (task, block) on both sides lie together already if both are in buckets of the task
    df.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    name = f"t_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(min(buckets, most_buckets(df.sparkSession)), key)
    writer = writer.sortBy(*sort) if sort else writer
    (writer.partitionBy(by) if by else writer).saveAsTable(name)
    return name


def most_buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))


class FingerprintIndex:
    """Runs below ``path`` (``level=L/run=N-BUCKETS``); those that are there already are found again.  Without a path the
    index is empty, and nothing can be added."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT, buckets: int = BUCKETS, lasting: bool = True):
        self.spark, self.path, self.fanout, self.buckets, self.lasting = spark, path, fanout, min(buckets, most_buckets(spark)), lasting
        self.runs: list[tuple[int, int]] = []
        self._tables: dict[tuple[int, int], str] = {}
        for level, number, size in _complete_runs(spark, path) if path else []:
            self.buckets = size
            self.runs.append((level, number))
            name = f"t_{uuid.uuid4().hex}"
            spark.sql(f"CREATE TABLE {name} ({LASTING if lasting else ENTRIES}) USING parquet CLUSTERED BY (gram) SORTED BY (gram, digest) INTO {size} BUCKETS LOCATION '{self._place(level, number)}'")
            self._tables[level, number] = name
        self._next = 1 + max((n for _, n in self.runs), default=-1)

    def rows(self, runs: list[tuple[int, int]] | None = None) -> DataFrame:
        """All rows of some runs, or of all."""
        tables = [self.spark.table(self._tables[r]) for r in runs or self.runs]
        return functools.reduce(DataFrame.unionByName, tables)

    def totals(self) -> DataFrame:
        """(gram, digest, n, who): a row a piece."""
        return _summed(self.rows())

    def add(self, entries: DataFrame) -> None:
        """Adds a batch as a run and merges full levels."""
        if not self.path:
            raise ValueError("an index without a path can't be added to")
        self._write(0, entries.repartition(self.buckets, "gram"))
        level = 0
        while len(full := [r for r in self.runs if r[0] == level]) >= self.fanout:
            self._write(level + 1, self.rows(full))
            self.runs = [r for r in self.runs if r not in full]
            for r in full:  # a run that is left behind by a crash holds what the next level holds too: see _complete_runs
                self.spark.sql(f"DROP TABLE {self._tables.pop(r)}")
                drop_folder(self.spark, self._place(*r))
            level += 1

    def drop(self) -> None:
        """Removes all runs."""
        for r in self.runs:
            self.spark.sql(f"DROP TABLE {self._tables.pop(r)}")
            drop_folder(self.spark, self._place(*r))
        self.runs = []

    def _place(self, level: int, n: int) -> str:
        return f"{self.path}/level={level}/run={n:06d}-{self.buckets}"

    def _write(self, level: int, rows: DataFrame) -> None:
        """``rows`` lie by bucket already, so a bucket gets one file (or one of each run that is merged)."""
        number, self._next = self._next, self._next + 1
        run = rows.groupBy("gram", "digest").agg(F.sum("n").alias("n"), F.min("who").alias("who"), F.first("windows").alias("windows")) if self.lasting else rows
        self._tables[level, number] = _table(run, "gram", self.buckets, self._place(level, number), ("gram", "digest"))
        self.runs.append((level, number))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("gram", "digest").agg(F.sum("n").alias("n"), F.min("who").alias("who"))


def told_pieces(now: FingerprintIndex, before: FingerprintIndex) -> DataFrame:
    """(block, gram, digest, repeated, spell): of the blocks' pieces, which ``now`` holds, those that are repeated, there or in
    ``before``, or whose gram also stands in another piece; one block spells each of the latter."""
    total = now.totals()
    if before.runs:
        total = _summed(total.unionByName(before.totals()))
    of_gram = total.groupBy("gram").agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
    marked = total.join(of_gram, "gram").where("n > 1 or low < high").select("gram", "digest", F.col("n").alias("total"), F.col("who").alias("speller"), (F.col("low") < F.col("high")).alias("open"))
    told = now.rows().join(marked, ["gram", "digest"])
    return told.select(F.col("who").alias("block"), "gram", "digest", (F.col("total") > 1).alias("repeated"), (F.col("open") & (F.col("who") == F.col("speller"))).alias("spell"))


def told_windows(spelled: DataFrame, told: DataFrame, before: FingerprintIndex) -> DataFrame:
    """(block, gram, window): of the spelled windows (SPELLED) those that occur more than once, ``before`` included."""
    rows = spelled.select("gram", "window", "n")
    if before.runs:
        old = before.rows().join(told.select("gram").distinct(), "gram", "left_semi")
        rows = rows.unionByName(old.select("gram", F.explode("windows").alias("window"), F.lit(1).cast("long").alias("n")))
    many = rows.groupBy("gram", "window").agg(F.sum("n").alias("n")).where("n > 1")
    return spelled.join(many.select("gram", "window"), ["gram", "window"]).select("block", "gram", "window")


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def drop_folder(spark: SparkSession, path: str) -> None:
    files, place = _folder(spark, path)
    files.delete(place, True)


def _complete_runs(spark: SparkSession, path: str) -> list[tuple[int, int, int]]:
    """(level, number, buckets) of the runs that were written to the end.  A run replaces all older ones of the level below:
    those that a crash kept from being dropped don't count."""
    files, place = _folder(spark, path)
    found = []
    for level in files.listStatus(place) if files.exists(place) else []:
        for run in files.listStatus(level.getPath()):
            if files.exists(spark._jvm.org.apache.hadoop.fs.Path(run.getPath(), "_SUCCESS")):
                number, _, size = run.getPath().getName().partition("=")[2].partition("-")
                found.append((int(level.getPath().getName().partition("=")[2]), int(number), int(size)))
    newest = {level: max(n for l, n, _ in found if l == level) for level, _, _ in found}
    return sorted((l, n, size) for l, n, size in found if n > newest.get(l + 1, -1))
