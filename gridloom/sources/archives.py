"""Archives as Spark data sources: zip files of delimited text, and NPZ files of arrays.

Reading: a partition is a member of a zip file, or a range of rows of the arrays of an NPZ file.  The driver reads directories and
headers only; a task opens its archive and reads its own part.  ``columns`` names what is wanted, and nothing else is
parsed or converted; equality filters on ``archive`` and ``member`` leave partitions out before anything is opened
(with ``spark.sql.python.filterPushdown.enabled``).  Object arrays, which would need pickle, are refused.

Writing: a task writes archives under names of its own; they are moved into the folder when all tasks are done.

Paths are URIs that Arrow's file systems know (``file://``, ``hdfs://``, ``s3://``, ``gs://``) or plain ones.
"""

from __future__ import annotations

import csv
import io
import math
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_schema

#: Rows of an NPZ partition, of an archive that is written, and of a batch.
ROWS, BATCH_ROWS = 1 << 20, 1 << 14
STAGE = "_writing"
PLACES = ("archive", "member")


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def archive_paths(path: str, suffix: str) -> list[str]:
    """One archive, or all below a folder; files that are being written don't count."""
    files, place = located(path)
    head = path[: len(path) - len(place)] if path.endswith(place) else "file://"
    found = files.get_file_info(place)
    if found.type == fs.FileType.File:
        return [path]
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    inside = files.get_file_info(fs.FileSelector(place, recursive=True))
    return sorted(head + (quote(f.path, safe="/:=@,;+ ") if head else f.path) for f in inside if f.type == fs.FileType.File and f.path.endswith(suffix) and f"/{STAGE}" not in f.path)


def _opened(path: str) -> zipfile.ZipFile:
    files, place = located(path)
    return zipfile.ZipFile(files.open_input_file(place))


@dataclass
class Part(InputPartition):
    archive: str
    member: str
    begin: int = 0
    end: int = 0


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.schema, self.options = options["path"], schema, options
        self.only: dict[str, set[str]] = {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in PLACES:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only[f.attribute[0]] = self.only.get(f.attribute[0], values) & values
            else:
                yield f

    def wanted(self, **place: str) -> bool:
        return all(value in self.only.get(name, {value}) for name, value in place.items())

    def batch(self, part: Part, columns: dict[str, pa.Array], rows: int) -> pa.RecordBatch:
        """Columns in the schema's order; those that the part doesn't have are null."""
        kinds = to_arrow_schema(self.schema)
        places = {"archive": part.archive, "member": part.member}
        out = []
        for field in kinds:
            if field.name in columns:
                out.append(columns[field.name].cast(field.type))
            else:
                out.append(pa.array([places[field.name]] * rows, field.type) if field.name in places else pa.nulls(rows, field.type))
        return pa.RecordBatch.from_arrays(out, schema=kinds)


# -- zip files of delimited text -------------------------------------------------------
def _header(raw, sep: str, quote: str) -> list[str]:
    line = raw.readline().decode("utf-8-sig")
    how = {"quotechar": quote} if quote else {"quoting": csv.QUOTE_NONE}
    return [h.strip() for h in next(csv.reader([line], delimiter=sep, **how), [])]


class _TextReader(_Reader):
    def partitions(self):
        out = []
        for archive in archive_paths(self.path, ".zip"):
            if self.wanted(archive=archive):
                with _opened(archive) as z:
                    out += [Part(archive, n) for n in sorted(z.namelist()) if n.endswith(self.options.get("suffix", "")) and not n.endswith("/") and self.wanted(member=n)]
        return out or [Part("", "")]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        from pyarrow import csv as arrow_csv

        if not part.archive:
            return
        sep, quote = self.options.get("sep", ","), self.options.get("quote", '"')
        with _opened(part.archive) as z, z.open(part.member) as raw:
            lines = io.BufferedReader(raw, 1 << 20)
            head = _header(lines, sep, quote)
            some = [f.name for f in self.schema if f.name in head]
            if not head or not lines.peek(1):
                return
            stream = arrow_csv.open_csv(
                pa.PythonFile(lines, "r"), read_options=arrow_csv.ReadOptions(column_names=head, block_size=1 << 22, use_threads=False),
                parse_options=arrow_csv.ParseOptions(delimiter=sep, quote_char=quote or False, newlines_in_values=bool(quote)),
                convert_options=arrow_csv.ConvertOptions(column_types={h: pa.string() for h in head}, include_columns=some or head[:1], strings_can_be_null=False),
            )
            for got in stream:
                yield self.batch(part, {n: got.column(n) for n in some}, got.num_rows)


class _Writer(DataSourceArrowWriter):
    """Archives under a name of the task's own, moved into the folder at the end."""

    suffix = ""

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.path, self.schema, self.options, self.overwrite, self.job = options["path"].rstrip("/"), schema, options, overwrite, uuid.uuid4().hex

    def write(self, iterator) -> WriterCommitMessage:
        files, place = located(self.path)
        stage = f"{place}/{STAGE}-{self.job}"
        files.create_dir(stage, recursive=True)
        names = []
        for k, rows in enumerate(self._chunks(iterator)):
            names.append(f"{stage}/{uuid.uuid4().hex}-{k:05d}{self.suffix}")
            with files.open_output_stream(names[-1]) as out:
                self.put(out, rows)
        return Written(names)

    def _chunks(self, iterator) -> Iterator[pa.Table]:
        most, held, n = int(self.options.get("rows", ROWS)), [], 0
        for batch in iterator:
            for at in range(0, batch.num_rows, most):
                piece = batch.slice(at, most)
                if held and n + piece.num_rows > most:
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
                held.append(piece)
                n += piece.num_rows
        if held:
            yield pa.Table.from_batches(held)

    def commit(self, messages) -> None:
        files, place = located(self.path)
        if self.overwrite:
            for old in archive_paths(self.path, self.suffix):
                files.delete_file(located(old)[1])
        for m in messages:
            for name in m.names if m else []:
                files.move(name, f"{place}/{name.rpartition('/')[2]}")
        self._drop(files, place)

    def abort(self, messages) -> None:
        self._drop(*located(self.path))

    def _drop(self, files: fs.FileSystem, place: str) -> None:
        if files.get_file_info(f"{place}/{STAGE}-{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{place}/{STAGE}-{self.job}")


@dataclass
class Written(WriterCommitMessage):
    names: list


class _TextWriter(_Writer):
    suffix = ".zip"

    def put(self, out, rows: pa.Table) -> None:
        """One member with a header; cells as text, null as an empty one."""
        sep, quote = self.options.get("sep", ","), self.options.get("quote", '"')
        how = {"quotechar": quote} if quote else {"quoting": csv.QUOTE_NONE, "escapechar": None}
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z, z.open(self.options.get("member", "rows.csv"), "w") as raw:
            text = io.TextIOWrapper(raw, "utf-8", newline="")
            to = csv.writer(text, delimiter=sep, lineterminator="\n", **how)
            to.writerow(rows.column_names)
            for batch in rows.to_batches(BATCH_ROWS):
                cells = [["" if x is None else x for x in c.cast(pa.string()).to_pylist()] for c in batch.columns]
                to.writerows(zip(*cells))
            text.flush()
            text.detach()


class ZippedText(DataSource):
    """``zipped_text``: options ``path``, ``suffix`` of members, ``sep``, ``quote`` ("" for none), ``columns`` (comma-separated).  All cells are text."""

    @classmethod
    def name(cls) -> str:
        return "zipped_text"

    def schema(self) -> T.StructType:
        names = [c for c in self.options.get("columns", "").split(",") if c]
        if not names:
            for part in _TextReader(self.options, T.StructType()).partitions():
                if part.archive:
                    with _opened(part.archive) as z, z.open(part.member) as raw:
                        names = _header(raw, self.options.get("sep", ","), self.options.get("quote", '"'))
                    break
        return T.StructType([T.StructField(n, T.StringType()) for n in [*names, *PLACES]])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _TextReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool):
        return _TextWriter(dict(self.options), schema, overwrite)


# -- NPZ files of arrays -----------------------------------------------------------------
def _array_header(raw) -> tuple[tuple, np.dtype]:
    version = np.lib.format.read_magic(raw)
    shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(raw)
    if kind.hasobject:
        raise ValueError("object arrays need pickle, which runs code when it is read")
    if by_column and len(shape) > 1:
        raise ValueError("arrays must be stored row by row")
    if len(shape) > 2:
        raise ValueError("arrays have one or two dimensions")
    return shape, kind


def _arrow(values: np.ndarray) -> pa.Array:
    flat = values.reshape(-1)
    flat = flat.astype(flat.dtype.newbyteorder("="))
    if flat.dtype.kind in "US":
        made = pa.array([x.decode() if isinstance(x, bytes) else x for x in flat.tolist()], pa.string())
    elif flat.dtype.kind == "M":
        made = pa.array(flat.astype("datetime64[D]")) if np.datetime_data(flat.dtype)[0] == "D" else pa.array(flat.astype("datetime64[us]"))
    else:
        made = pa.array(flat)
        wider = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.int64(), pa.float16(): pa.float32()}
        made = made.cast(wider.get(made.type, made.type))
    if values.ndim < 2:
        return made
    width = values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * width, pa.int32()), made)


def _headers(archive: str) -> dict[str, tuple[tuple, np.dtype]]:
    with _opened(archive) as z:
        out = {}
        for name in z.namelist():
            if name.endswith(".npy"):
                with z.open(name) as raw:
                    out[name.removesuffix(".npy")] = _array_header(raw)
        return out


class _ArrayReader(_Reader):
    def partitions(self):
        out, most = [], int(self.options.get("rows", ROWS))
        for archive in archive_paths(self.path, ".npz"):
            if self.wanted(archive=archive):
                sizes = {s[0] for n, (s, _) in _headers(archive).items() if s and n in self.schema.names}
                if len(sizes) > 1:
                    raise ValueError(f"{archive}: arrays of different lengths: {sorted(sizes)}")
                n = sizes.pop() if sizes else 0
                out += [Part(archive, "", a, min(n, a + most)) for a in range(0, n, most)]
        return out or [Part("", "")]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.archive:
            return
        with _opened(part.archive) as z:
            arrays, single = {}, {}
            try:
                for name in self.schema.names:
                    if f"{name}.npy" in z.namelist():
                        raw = z.open(f"{name}.npy")
                        shape, kind = _array_header(raw)
                        width = math.prod(shape[1:]) * kind.itemsize
                        if shape:
                            arrays[name] = raw, shape, kind, width
                            raw.seek(part.begin * width, 1)
                        else:  # one value for all rows
                            single[name] = _arrow(np.frombuffer(raw.read(width), kind))
                            raw.close()
                for a in range(part.begin, part.end, BATCH_ROWS):
                    n = min(part.end, a + BATCH_ROWS) - a
                    columns = {name: _arrow(np.frombuffer(raw.read(n * width), kind).reshape(n, *shape[1:])) for name, (raw, shape, kind, width) in arrays.items()}
                    yield self.batch(part, columns | {name: pa.concat_arrays([x] * n) for name, x in single.items()}, n)
            finally:
                for raw, *_ in arrays.values():
                    raw.close()


class _ArrayWriter(_Writer):
    suffix = ".npz"

    def put(self, out, rows: pa.Table) -> None:
        """An array a column, lists of one length as rows of two dimensions; a missing number is NaN, a missing text an empty one."""
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED if self.options.get("compressed", "false") == "true" else zipfile.ZIP_STORED) as z:
            for name, column in zip(rows.column_names, rows.columns):
                with z.open(f"{name}.npy", "w", force_zip64=True) as raw:
                    np.lib.format.write_array(raw, self._values(name, column.combine_chunks()), allow_pickle=False)

    @staticmethod
    def _values(name: str, column: pa.Array) -> np.ndarray:
        if pa.types.is_list(column.type):
            sizes = set(column.value_lengths().to_pylist())
            if len(sizes) != 1 or None in sizes:
                raise ValueError(f"{name}: lists must have one length, not {sizes}")
            return _ArrayWriter._values(name, column.flatten()).reshape(len(column), sizes.pop())
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            return np.array([x or "" for x in column.to_pylist()], np.str_)
        if pa.types.is_floating(column.type):
            return column.fill_null(float("nan")).to_numpy(zero_copy_only=False)
        if column.null_count:
            raise ValueError(f"{name}: whole numbers, dates and flags can't be missing in an array")
        if pa.types.is_date(column.type):
            return column.cast(pa.int32()).to_numpy(zero_copy_only=False).astype("datetime64[D]")
        return column.to_numpy(zero_copy_only=False)


class ArrayArchive(DataSource):
    """``npz``: options ``path``, ``columns``, ``rows`` of a partition.  An array of two dimensions is a column of lists, a single value is the same in
    every row."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> T.StructType:
        some = [c for c in self.options.get("columns", "").split(",") if c]
        found = archive_paths(self.options["path"], ".npz")
        kinds = {n: _arrow(np.zeros((0, *shape[1:]) if shape else 0, kind)).type for n, (shape, kind) in (_headers(found[0]) if found else {}).items()}
        missing = [c for c in some if c not in kinds]
        if missing:
            raise ValueError(f"no such arrays: {missing}")
        return T.StructType([*[T.StructField(n, from_arrow_type(kinds[n])) for n in some or kinds], T.StructField("archive", T.StringType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _ArrayReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool):
        return _ArrayWriter(dict(self.options), schema, overwrite)


def _registered(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (ZippedText, ArrayArchive):
        spark.dataSource.register(source)
    return spark


def read_zipped_text(spark: SparkSession, path: str, suffix: str = ".csv", sep: str = ",", quote: str = '"', columns: list[str] | None = None) -> DataFrame:
    """Members of zip files whose names end in ``suffix``: text columns, ``archive`` and ``member``.  With ``columns`` only those are parsed."""
    reader = _registered(spark).read.format("zipped_text").options(suffix=suffix, sep=sep, quote=quote)
    return (reader.option("columns", ",".join(columns)) if columns else reader).load(path)


def read_arrays(spark: SparkSession, path: str, columns: list[str] | None = None, rows: int = ROWS) -> DataFrame:
    """Arrays of NPZ files side by side, and ``archive``; a partition has ``rows`` rows at most."""
    reader = _registered(spark).read.format("npz").option("rows", rows)
    return (reader.option("columns", ",".join(columns)) if columns else reader).load(path)


def write_zipped_text(df: DataFrame, path: str, sep: str = ",", quote: str = '"', member: str = "rows.csv", rows: int = ROWS) -> None:
    """Zip files of one member of ``rows`` rows each; without quotes, cells must not hold separators or line ends."""
    _registered(df.sparkSession)
    df.write.format("zipped_text").mode("append").options(sep=sep, quote=quote, member=member, rows=rows).save(path)


def write_arrays(df: DataFrame, path: str, rows: int = ROWS, compressed: bool = False) -> None:
    """NPZ files of ``rows`` rows each."""
    _registered(df.sparkSession)
    df.write.format("npz").mode("append").options(rows=rows, compressed=str(compressed).lower()).save(path)
