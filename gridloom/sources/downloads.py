"""Files of a remote service, fetched once into a shared folder.

What is wanted is a table: one row a file, with its keys (a station, a period) and its address.  Files that the folder
has aren't asked for again.  The others are fetched by the executors, a few at a time, each written under a name of
its own and then renamed: a file that is there is whole, whatever was lost on the way, and of two tasks that
fetch the same file the later one replaces an equal copy.  The body goes from the socket to the store in pieces.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Iterator, Sequence
from urllib.error import HTTPError, URLError
from urllib.request import Request, urlopen

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .archives import located

PIECE = 1 << 20
#: Attempts at a file, and seconds before the second one; then twice as long each time.
ATTEMPTS, PAUSE = 4, 0.5
#: Answers after which asking again may help.
PASSING = (408, 425, 429, 500, 502, 503, 504)
STATE = "path string, url string, bytes long, sha256 string, fetched boolean, error string"


#: Characters that Spark escapes in the folders of partitions; the percent sign first.
ESCAPED = "%\"#'*/:=?\\{[]^"


def _escaped(value: Column) -> Column:
    for c in ESCAPED:
        value = F.replace(value, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return value


def _present(folder: str) -> list[str]:
    """Paths, relative to the folder, of the files that are there."""
    files, place = located(folder)
    if files.get_file_info(place).type != fs.FileType.Directory:
        return []
    found = files.get_file_info(fs.FileSelector(place, recursive=True))
    inside = [f.path[len(place.rstrip("/")) :] for f in found if f.type == fs.FileType.File]
    return [p[1:] for p in inside if "/_" not in p]


def fetch(url: str, root: str, path: str, timeout: float = 60.0, attempts: int = ATTEMPTS, pause: float = PAUSE) -> tuple[int, str]:
    """(bytes, SHA-256) of what was written to ``path`` below ``root``; a passing error is tried again."""
    files, place = located(root)
    place = f"{place.rstrip('/')}/{path}"
    folder, _, name = place.rpartition("/")
    for k in range(attempts):
        staged = f"{folder}/_{name}.{uuid.uuid4().hex}"
        try:
            files.create_dir(folder, recursive=True)
            size, digest = 0, hashlib.sha256()
            with urlopen(Request(url, headers={"User-Agent": "gridloom"}), timeout=timeout) as reply, files.open_output_stream(staged) as out:  # noqa: S310
                expected = reply.headers.get("Content-Length")
                while piece := reply.read(PIECE):
                    out.write(piece)
                    digest.update(piece)
                    size += len(piece)
            if expected and int(expected) != size:
                raise URLError(f"{size} of {expected} bytes")
            files.move(staged, place)
            return size, digest.hexdigest()
        except (URLError, TimeoutError, ConnectionError) as error:
            if files.get_file_info(staged).type == fs.FileType.File:
                files.delete_file(staged)
            if isinstance(error, HTTPError) and error.code not in PASSING or k + 1 == attempts:
                raise
            time.sleep(pause * 2**k)
    raise AssertionError


def download_missing(spark: SparkSession, wanted: DataFrame, folder: str, keys: Sequence[str], url: str = "url", name: str = "data.csv", at_once: int = 8, refresh: str | None = None, strict: bool = True) -> DataFrame:
    """Fetches the files of ``wanted`` (keys and an address) that ``folder`` doesn't have, ``at_once`` side by side at most.

    Gives (path, url, bytes, sha256, fetched, error) of every file wanted: ``fetched`` is false for one that was there.  Rows for which the
    flag ``refresh`` is true are fetched in any case.  An error ends the job, or with ``strict`` false is told in its row.
    The list of paths is small beside the files; it is written as a table and joined.
    """
    files, place = located(folder)
    files.create_dir(place, recursive=True)
    rows = wanted.select(*keys, F.col(url).alias("url"), (F.col(refresh) if refresh else F.lit(False)).alias("again")).distinct()
    # folder/station=X/period=Y/data.csv: Spark reads the keys back as columns
    path = F.concat_ws("/", *[F.concat(F.lit(f"{k}="), _escaped(F.col(k).cast("string"))) for k in keys], F.lit(name))
    have = spark.createDataFrame([(p,) for p in _present(folder)], "path string")
    marked = rows.withColumn("path", path).join(have.withColumn("there", F.lit(True)), "path", "left")
    todo = marked.where(F.col("there").isNull() | F.col("again"))
    root = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                size, digest, error = None, None, None
                try:
                    size, digest = fetch(url, root, path)
                except (URLError, TimeoutError, ConnectionError) as e:
                    if strict:
                        raise
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((path, url, size, digest, error is None, error), (pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string()))], ["path", "url", "bytes", "sha256", "fetched", "error"])

    log = f"{root}/_log/{uuid.uuid4().hex}"
    # the log is written once, so that reading the result doesn't fetch anything again
    todo.select("path", "url").repartition(at_once, "url").mapInArrow(run, STATE).write.parquet(log)
    done = spark.read.schema(STATE).parquet(log)
    kept = marked.where(F.col("there").isNotNull() & ~F.col("again")).select("path", "url", F.lit(None).cast("long").alias("bytes"), F.lit(None).cast("string").alias("sha256"), F.lit(False).alias("fetched"), F.lit(None).cast("string").alias("error"))
    return done.unionByName(kept)


def read_downloads(spark: SparkSession, folder: str, schema: str, name: str = "data.csv", **options) -> DataFrame:
    """All files of the folder as one table; keys are partition columns, so a filter on them leaves files out."""
    return spark.read.schema(schema).options(header=True, pathGlobFilter=name, **options).csv(folder)
