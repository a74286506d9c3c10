"""Registers paired with state of our own: sent at once when both sides are there, alone when time is up.

The first register of an interval opens it; the second sends the pair and leaves a mark, so that a register that is sent again isn't
taken for a new one.  When the watermark passes the interval, what has only one side is sent with a null, and the interval is
forgotten.  So the state holds the intervals of the waiting time and no more.  Rows behind the watermark are dropped and counted by
Spark (``late_rows``).

Meters share buckets, by a hash of their id, and a bucket is a key: its open intervals are one value, an Arrow table, and it has one timer, for
the first of them.  Each call of the state is a message between two processes, so there are a few for each bucket and
micro-batch, not some for each row, and a bucket's rows are paired as arrays.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

REGISTERS = ("import", "export")
OUT = "mp_id string, ts timestamp, `import` double, export double, complete boolean"
#: The store on disk, of which a micro-batch saves its changes and not all of it.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: A bucket's open intervals; a register that hasn't come is NaN.
OPEN = {"mp_id": "object", "at": "int64", "import": "float64", "export": "float64", "sent": "bool"}
#: Rows of a bucket that are paired at a time.
ROWS = 1 << 17


class Pairing(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "due long, intervals binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due, known = self._load()
        for part in _gathered(rows):
            known, new = paired(known, part)
            yield from _frames(known[new], True)
        self._store(due, known)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, known = self._load()
        over = known["at"] // 1000 < timerValues.getCurrentWatermarkInMs()  # those whose own timers Spark would fire
        yield from _frames(known[over & ~known["sent"]], False)
        self._store(None, known[~over])  # Spark deletes the timer that fired

    def _load(self) -> tuple[int | None, pd.DataFrame]:
        state = self.waiting.get()
        if state is None:
            return None, pd.DataFrame({c: pd.Series(dtype=kind) for c, kind in OPEN.items()})
        return state[0], pa.ipc.open_stream(pa.py_buffer(bytes(state[1]))).read_all().to_pandas()

    def _store(self, due: int | None, known: pd.DataFrame) -> None:
        if known.empty:
            self.waiting.clear()
            return
        first = int(known["at"].min()) // 1000
        if first != due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(first)
        table, sink = pa.Table.from_pandas(known, preserve_index=False).replace_schema_metadata(None), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        self.waiting.update((first, sink.getvalue().to_pybytes()))

    def close(self) -> None:
        pass


def paired(known: pd.DataFrame, rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """Open intervals after ``rows`` (mp_id, at, imported, kwh), which count in their order, and which of them are complete only now."""
    n = len(known)
    meter = np.concatenate([known["mp_id"].to_numpy(object), rows["mp_id"].to_numpy(object)])
    at = np.concatenate([known["at"].to_numpy(), rows["at"].to_numpy()])
    code = pd.factorize(meter, use_na_sentinel=False)[0]
    order = np.lexsort((at, code))  # stable: what is known stands before what comes
    head = np.r_[True, (np.diff(code[order]) != 0) | (np.diff(at[order]) != 0)]
    interval = np.empty(len(order), np.int64)
    interval[order] = np.cumsum(head) - 1
    starts = np.flatnonzero(head)
    out = {r: np.full(len(starts), np.nan) for r in REGISTERS}
    sent, old = np.zeros(len(starts), bool), interval[:n]
    sent[old] = known["sent"].to_numpy()
    for r in REGISTERS:
        out[r][old] = known[r].to_numpy()
    before = sent.copy()
    # an interval's first rows together, then all second ones, and so on
    turn = np.empty(len(order), np.int64)
    turn[order] = np.arange(len(order)) - starts[interval[order]]
    turn, interval = turn[n:] - np.bincount(old, minlength=len(starts))[interval[n:]], interval[n:]
    imported, kwh = rows["imported"].to_numpy(bool), rows["kwh"].to_numpy("float64")
    for these in np.split(np.argsort(turn, kind="stable"), np.cumsum(np.bincount(turn))[:-1]):
        these = these[~sent[interval[these]]]
        which, side = interval[these], imported[these]
        out["import"][which[side]] = kwh[these[side]]
        out["export"][which[~side]] = kwh[these[~side]]
        sent[which] = ~np.isnan(out["import"][which]) & ~np.isnan(out["export"][which])
    first = order[starts]
    return pd.DataFrame({"mp_id": meter[first], "at": at[first], **out, "sent": sent}), sent & ~before


def _gathered(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part)
        if n >= ROWS:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def _frames(rows: pd.DataFrame, complete: bool) -> Iterator[pd.DataFrame]:
    if len(rows):
        yield pd.DataFrame({"mp_id": rows["mp_id"], "ts": pd.to_datetime(rows["at"], unit="us", utc=True), **{r: rows[r] for r in REGISTERS}, "complete": complete})


def paired_when_complete(readings: DataFrame, wait: str = "1 hour", buckets: int = 1024) -> DataFrame:
    """(mp_id, ts, import, export, complete) of a stream of (mp_id, ts, register, kwh), ``ts`` being an interval's start.  A register that is sent again
    before its pair replaces the first; after it, it changes nothing.  Missing values don't count as sent.  ``buckets`` are part of a checkpoint: as many
    as the open intervals need for a bucket to be small."""
    for name, value in STORE.items():
        readings.sparkSession.conf.set(name, value)
    rows = readings.where(F.col("register").isin(*REGISTERS) & F.col("ts").isNotNull())
    rows = rows.select("mp_id", "ts", F.unix_micros("ts").alias("at"), (F.col("register") == "import").alias("imported"), F.col("kwh").cast("double").alias("kwh"), F.pmod(F.hash("mp_id"), F.lit(buckets)).alias("bucket"))
    return rows.withWatermark("ts", wait).groupBy("bucket").transformWithStateInPandas(Pairing(), OUT, "append", "EventTime")


def late_rows(query) -> int:
    """Rows that came behind the watermark, over what the query remembers of its progress."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
