"""Readers, writers and streams."""

import datetime as dt
import random
import types

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.operators.relational import pair_registers
from gridloom.sources import archives, downloads, exports, sinks
from gridloom.streaming import keyed, pairing


def export_file(path, header, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join([";".join(header), *(";".join(r) for r in rows)]) + "\n", encoding="utf-8")


def test_export_variants(spark, tmp_path):
    names = exports.interval_names()
    values = ["0,5"] * 95 + [""]
    row = ["m1", exports.IMPORT, "02.01.2024", "8000", *values]
    export_file(tmp_path / "Januar 2024" / "a.csv", ["MP ID", "OBIS-Code", "Datum", "PLZ", *names], [row])
    shifted = ["MP ID", "Datum", "PLZ", *names, ""]
    export_file(tmp_path / "März 2024" / "b.csv.tmp.1", shifted, [[*row, ""]])
    assert exports.check_header(["MP ID", "OBIS-Code", "Datum", "PLZ", *names]) == "ok"
    assert exports.check_header(shifted) == "shifted"
    with pytest.raises(ValueError):
        exports.check_header(["a", "b"])
    found = exports.discover_exports(spark, f"file://{tmp_path}")
    assert [(e.year, e.month) for e in found] == [(2024, 1), (2024, 3)]
    assert len(exports.discover_exports(spark, f"file://{tmp_path}", include_stalled=False)) == 1
    for e in found:
        r = exports.read_exports(spark, e.path, exports.IMPORT).first()
        assert r.mp_id == "m1" and r.date == dt.date(2024, 1, 2) and len(r.q) == 96 and r.q[0] == 0.5 and r.q[95] is None


def test_headers_are_checked_before_reading(spark, tmp_path):
    export_file(tmp_path / "Mai 2024" / "a.csv", ["MP ID", "OBIS-Code", "Datum", "PLZ", *exports.interval_names()[1:]], [["m"] * 99])
    with pytest.raises(ValueError, match="quarter hours"):
        exports.read_exports(spark, f"file://{tmp_path}/Mai 2024/a.csv")
    assert exports.read_exports(spark, f"file://{tmp_path}/Mai 2024/a.csv", check=False).count() == 1


def test_months_are_read_apart(spark):
    df = spark.createDataFrame([(1, dt.date(2024, 1, 31)), (2, dt.date(2024, 2, 1)), (3, None), (4, dt.date(2024, 2, 29))], "id int, date date")
    assert exports.months_in_order(df, lambda m, rows: (m.month, sorted(r.id for r in rows.collect()))) == [(1, [1]), (2, [2, 4])]


def test_months_are_worked_on_side_by_side_and_resumed(spark, tmp_path):
    import threading

    df = spark.createDataFrame([(i, dt.date(2024, 1 + i % 4, 3)) for i in range(40)], "id int, date date")
    meet = threading.Barrier(2, timeout=60)  # passed only if two months are under way together

    def work(m, rows):
        meet.wait()
        return m.month, rows.count()

    assert exports.months_in_order(df, work, at_once=2) == [(1, 10), (2, 10), (3, 10), (4, 10)]
    made = []

    def table(m, rows):
        made.append(m)
        if m.month == 3 and len(made) < 5:
            raise ValueError("lost")
        return rows.agg(F.sum("id").alias("s"))

    folder = f"file://{tmp_path}/months"
    with pytest.raises(ValueError, match="lost"):
        exports.months_resumed(df, table, folder, at_once=1)
    n = len(made)
    out = exports.months_resumed(df, table, folder, at_once=2) if n >= 4 else None
    while out is None:
        try:
            out = exports.months_resumed(df, table, folder, at_once=1)
        except ValueError:
            pass
    assert [m.month for m, _ in out] == [1, 2, 3, 4] and [t.first().s for _, t in out] == [180, 190, 200, 210]
    assert sorted(made).count(dt.date(2024, 1, 1)) == 1  # what was finished isn't made again


def test_every_part_of_a_folder_is_checked(spark, tmp_path):
    good = ["MP ID", "OBIS-Code", "Datum", "PLZ", *exports.interval_names()]
    export_file(tmp_path / "Mai 2024" / "part-0.csv", good, [["m"] * 100])
    export_file(tmp_path / "Mai 2024" / "part-1.csv", good[:-1], [["m"] * 99])
    found = exports.discover_exports(spark, f"file://{tmp_path}")
    assert [e.path.rpartition("/")[2] for e in found] == ["Mai 2024"] or len(found) == 1
    with pytest.raises(ValueError, match="quarter hours"):
        exports.read_exports(spark, found[0].path)


def test_finished_file_beats_stalled():
    found = exports.choose_exports(["/d/Mai 2024/x.csv.tmp.9", "/d/Mai 2024/y.csv", "/d/misc/z.csv"])
    assert [e.path for e in found] == ["/d/Mai 2024/y.csv"]


def test_reference_with_bom_and_padding(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes("﻿GP-Nr; PV ;Ort\n 1 ; x; Bern \n2;;\n".encode())
    df = exports.read_reference(spark, f"file://{tmp_path}/r.csv", rename={"GP-Nr": "gp_nr", "PV": "pv"})
    assert df.columns == ["gp_nr", "pv", "Ort"]
    assert [tuple(r) for r in df.orderBy("gp_nr").collect()] == [("1", "x", "Bern"), ("2", None, None)]


def test_zip_members(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "g.zip", "w") as z:
        z.writestr("gebaeude.csv", "EGID\tPLZ\n1\t8000\n2\t9000\n")
        z.writestr("readme.txt", "no")
    rows = exports.read_zipped(spark, f"file://{tmp_path}/g.zip", ".csv").collect()
    assert sorted((r.EGID, r.PLZ, r.member) for r in rows) == [("1", "8000", "gebaeude.csv"), ("2", "9000", "gebaeude.csv")]


def test_zip_members_are_partitions(spark, tmp_path):
    """A task a member; filters on members leave them out; only named columns; quoted line ends, marks at the beginning, other columns, empty members."""
    import zipfile

    for a in ("x", "y"):
        with zipfile.ZipFile(tmp_path / f"{a}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("1.csv", "\ufeffid , text,more\r\n1,\"a\nb, \"\"c\"\"\",x\r\n2,,y\r\n".encode())
            z.writestr("2.csv", "".join(["text,id\n", *(f"t{i},{i}\n" for i in range(10, 400))]))
            z.writestr("none.csv", "")
            z.writestr("head.csv", "id,text\n")
            z.writestr("other.txt", "id\n7\n")
    df = archives.read_zipped_text(spark, f"file://{tmp_path}", ".csv", columns=["id", "text"])
    assert df.columns == ["id", "text", "archive", "member"] and df.rdd.getNumPartitions() == 8
    rows = df.where("archive like '%x.zip'").collect()
    assert len(rows) == 392 and {(r.id, r.text) for r in rows} >= {("1", 'a\nb, "c"'), ("2", ""), ("10", "t10"), ("399", "t399")}
    one = df.where("member = '1.csv'")
    assert one.rdd.getNumPartitions() == 2 and one.count() == 4
    assert df.where("member in ('2.csv', 'gone.csv') and archive like '%y.zip'").count() == 390 and df.where("member = 'gone.csv'").count() == 0
    assert archives.read_zipped_text(spark, f"file://{tmp_path}", ".csv", columns=["more", "id"]).where("member = '2.csv'").where("more is not null").count() == 0
    assert archives.read_zipped_text(spark, f"file://{tmp_path}/x.zip", ".txt").columns == ["id", "archive", "member"]
    with pytest.raises(Exception, match="FileNotFound"):
        archives.read_zipped_text(spark, f"file://{tmp_path}/none").collect()


def test_zipped_text_comes_back(spark, tmp_path):
    rows = [(1, 'a "b"\n, c', 1.5), (2, None, None), (3, "é", -2.0)]
    df = spark.createDataFrame(rows, "id int, s string, x double").repartition(2)
    for _ in range(2):  # appended
        archives.write_zipped_text(df, f"file://{tmp_path}/z", rows=1)
    back = archives.read_zipped_text(spark, f"file://{tmp_path}/z")
    assert sorted((r.id, r.s, r.x) for r in back.collect()) == sorted([("1", 'a "b"\n, c', "1.5"), ("2", "", ""), ("3", "é", "-2")] * 2) or sorted((r.id, r.s) for r in back.collect()) == sorted([("1", 'a "b"\n, c'), ("2", ""), ("3", "é")] * 2)
    assert not [p for p in (tmp_path / "z").iterdir() if p.name.startswith("_")] and len(list((tmp_path / "z").iterdir())) == 6


def test_arrays_are_read_by_ranges_of_rows(spark, tmp_path):
    import numpy as np

    n = 1000
    arrays = {"mp_id": np.array([f"m{i}" for i in range(n)]), "p50": np.arange(n * 96, dtype=np.float32).reshape(n, 96), "k": np.arange(n, dtype=">u2"), "day": np.arange(n).astype("datetime64[D]"), "ok": np.arange(n) % 2 == 0, "ym": np.array(202401), "h": np.arange(n, dtype=np.float16)}
    np.savez(tmp_path / "a.npz", **arrays)
    np.savez_compressed(tmp_path / "b.npz", **arrays)
    df = archives.read_arrays(spark, f"file://{tmp_path}", rows=300)
    assert df.rdd.getNumPartitions() == 8 and df.count() == 2000
    assert dict(df.dtypes) == {"mp_id": "string", "p50": "array<float>", "k": "int", "day": "date", "ok": "boolean", "ym": "bigint", "h": "float", "archive": "string"}
    r = df.where("k = 777 and archive like '%b.npz'").first()
    assert r.mp_id == "m777" and r.p50 == [float(777 * 96 + j) for j in range(96)] and r.day == dt.date(1970, 1, 1) + dt.timedelta(days=777) and r.ym == 202401 and not r.ok
    assert archives.read_arrays(spark, f"file://{tmp_path}/a.npz", ["k", "mp_id"]).columns == ["k", "mp_id", "archive"]
    assert exports.read_profiles(spark, f"file://{tmp_path}/a.npz").count() == n
    with pytest.raises(Exception, match="no such arrays"):
        archives.read_arrays(spark, f"file://{tmp_path}", ["absent"])


def test_arrays_that_cannot_be_read(spark, tmp_path):
    import numpy as np

    np.savez(tmp_path / "o.npz", x=np.array([{"a": 1}], object))
    np.savez(tmp_path / "d.npz", x=np.arange(3), y=np.arange(4))
    np.savez(tmp_path / "f.npz", x=np.asfortranarray(np.ones((3, 2))))
    for name, why in (("o", "pickle"), ("d", "different lengths"), ("f", "row by row")):
        with pytest.raises(Exception, match=why):
            archives.read_arrays(spark, f"file://{tmp_path}/{name}.npz").collect()


def test_arrays_come_back(spark, tmp_path):
    rows = [(i, f"s{i}" if i else None, [float(i), None if i == 2 else 1.0], dt.date(2024, 1, 1 + i)) for i in range(7)]
    df = spark.createDataFrame(rows, "i long, s string, v array<double>, d date").repartition(2)
    archives.write_arrays(df, f"file://{tmp_path}/n", rows=2, compressed=True)
    back = {r.i: r for r in archives.read_arrays(spark, f"file://{tmp_path}/n").collect()}
    assert len(back) == 7 and back[0].s == "" and back[3].v == [3.0, 1.0] and back[2].v[1] != back[2].v[1] and back[6].d == dt.date(2024, 1, 7)
    with pytest.raises(Exception, match="one length"):
        archives.write_arrays(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<double>").coalesce(1), f"file://{tmp_path}/bad")
    assert not (tmp_path / "bad").exists() or not list((tmp_path / "bad").glob("*.npz"))


@pytest.fixture()
def service():
    """A local service that counts what it is asked for; every address fails once with a passing error first."""
    import threading
    from collections import Counter
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    asked = Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked[self.path] += 1
            if "gone" in self.path or asked[self.path] == 1:
                self.send_error(404 if "gone" in self.path else 503)
                return
            body = f"day,value\n2024-01-01,{len(self.path)}\n".encode() * (1 if "big" not in self.path else 200_000)
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_only_missing_files_are_asked_for(spark, tmp_path, service):
    from urllib.parse import quote

    root, asked = service
    cache = f"file://{tmp_path}/cache"
    rows = [(s, p, f"{root}/{quote(s)}/{p}") for s in ("BAS", "ZH é/1", "big") for p in ("historical", "recent")]
    df = spark.createDataFrame(rows, "station string, period string, url string")
    some = downloads.download_missing(spark, df.where("period = 'recent'"), cache, ["station", "period"])
    assert {(r.url, r.fetched) for r in some.collect()} == {(u, True) for _, p, u in rows if p == "recent"} and len(asked) == 3
    every = downloads.download_missing(spark, df, cache, ["station", "period"])
    assert every.where("fetched").count() == 3 and every.count() == 6 and set(asked.values()) == {2}
    assert every.where("fetched").agg(F.min(F.length("sha256")), F.min("bytes")).first()[0] == 64
    assert downloads.download_missing(spark, df, cache, ["station", "period"]).where("fetched").count() == 0 and set(asked.values()) == {2}
    again = downloads.download_missing(spark, df.withColumn("again", F.col("period") == "recent"), cache, ["station", "period"], refresh="again")
    assert again.where("fetched").count() == 3 and sorted(asked.values()) == [2, 2, 2, 3, 3, 3]
    got = downloads.read_downloads(spark, cache, "day string, value string, station string, period string")
    assert {(r.station, r.period) for r in got.select("station", "period").distinct().collect()} == {(s, p) for s, p, _ in rows}
    assert got.where("station = 'BAS'").count() == 2 and got.where("station = 'big' and period = 'recent' and value = '11'").count() == 200_000


def test_downloads_that_fail(spark, tmp_path, service):
    root, asked = service
    df = spark.createDataFrame([("a", f"{root}/gone"), ("b", f"{root}/fine")], "station string, url string")
    with pytest.raises(Exception, match="404"):
        downloads.download_missing(spark, df, f"file://{tmp_path}/c", ["station"])
    told = {r.path: r for r in downloads.download_missing(spark, df, f"file://{tmp_path}/d", ["station"], strict=False).collect()}
    assert "404" in told["station=a/data.csv"].error and not told["station=a/data.csv"].fetched and told["station=b/data.csv"].fetched
    assert not [p for p in (tmp_path / "d").rglob("*") if p.name.startswith("_data")]
    assert downloads.download_missing(spark, df.where("false"), f"file://{tmp_path}/e", ["station"]).count() == 0


def test_sinks(spark, tmp_path):
    root = f"file://{tmp_path}"
    df = spark.createDataFrame([(1, dt.date(2023, 5, 1)), (2, dt.date(2024, 5, 1))], "id int, d date")
    sinks.write_by_year(df, f"{root}/y", "d")
    sinks.write_by_year(df.where("id = 2").withColumn("id", F.lit(9)), f"{root}/y", "d")
    assert sorted(r.id for r in spark.read.parquet(f"{root}/y").collect()) == [1, 9]
    sinks.write_once(df, f"{root}/once")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_once(df, f"{root}/once")
    with pytest.raises(ValueError):
        sinks.write_json(spark, {"a": [float("nan")]}, f"{root}/j")
    sinks.write_json(spark, {"a": 1}, f"{root}/j")
    assert exports.read_config(spark, f"{root}/j") == {"a": 1}
    load, feed = sinks.split_channels(df.withColumn("einsp", F.lit(1)), ["id"], ["einsp"])
    assert load.columns == ["id", "d"] and feed.columns == ["id", "einsp"]
    made = []
    for _ in range(2):
        out = sinks.cached(spark, root, sinks.cache_key("rows", 1), lambda: made.append(1) or df)
    assert out.count() == 2 and made == [1]
    assert sinks.markdown(df.orderBy("id")).splitlines()[2].startswith("| 1 ")


def test_stream_equals_batch(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    rows = [("m", t(1), "import", 2.0), ("m", t(3), "export", 0.5), ("m", t(20), "import", 1.0), ("m", t(600), "import", 1.0), ("m", t(900), "import", 1.0)]
    df = spark.createDataFrame(rows, "mp_id string, ts timestamp, register string, kwh double")
    df.repartition(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = pairing.pair_registers_stream(stream).writeStream.outputMode("append").format("memory").queryName("pairs").option("checkpointLocation", f"file://{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.ts.hour * 60 + r.ts.minute): (r["import"], r["export"]) for r in spark.table("pairs").collect()}
    want = pair_registers(df.withColumn("slot", F.window("ts", "15 minutes").start), ["mp_id", "slot"], outer=True).collect()
    expect = {(r.slot.hour * 60 + r.slot.minute): (r["import"], r["export"]) for r in want}
    assert got and all(expect[k] == v for k, v in got.items()) and got[0] == (2.0, 0.5) and got[15] == (1.0, None)


def test_other_streams(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    rows = [("m", t(1), "import", 2.0), ("m", t(1), "import", 2.0), ("m", t(20), "import", 1.0), ("m", t(5000), "import", 1.0)]
    df = spark.createDataFrame(rows, "mp_id string, ts timestamp, register string, kwh double")
    df.repartition(1).write.parquet(f"file://{tmp_path}/in")
    read = lambda: pairing.deduplicated(spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in"))
    for name, make in (("days", pairing.daily_energy_stream), ("hours", pairing.rolling_hour_stream), ("sessions", pairing.sessions_stream)):
        q = make(spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")).writeStream.outputMode("append").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("days").where("kwh = 5").count() == 1
    assert spark.table("sessions").first().n == 3
    q = read().writeStream.foreachBatch(pairing.upsert_days(f"file://{tmp_path}/out")).option("checkpointLocation", f"file://{tmp_path}/c2").start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 3


def _sent(spark, rows, folder):
    spark.createDataFrame(rows, "mp_id string, ts timestamp, register string, kwh double").coalesce(1).write.mode("append").parquet(folder)


def _run(spark, tmp_path, wait="1 hour"):
    """What is new since the last time, from the checkpoint on."""
    schema = "mp_id string, ts timestamp, register string, kwh double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = keyed.paired_when_complete(stream, wait).writeStream.outputMode("append").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).format("parquet").option("path", f"file://{tmp_path}/out").start()
    q.awaitTermination()
    return keyed.late_rows(q)


def test_keyed_pairs_over_restarts(spark, tmp_path):
    """Complete pairs at once, single registers when time is up, repeats without effect, late rows counted; the query is ended after each file."""
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    got = lambda: sorted((r.mp_id, (r.ts - t(0)).total_seconds() / 60, r["import"], r.export, r.complete) for r in spark.read.parquet(f"file://{tmp_path}/out").where("mp_id <> 'end'").collect())
    _sent(spark, [("m", t(0), "import", 1.0), ("m", t(15), "import", 2.0), ("n", t(0), "export", 9.0), ("m", t(30), "export", 3.0), ("m", t(45), "other", 3.0)], f"file://{tmp_path}/in")
    assert _run(spark, tmp_path) == 0
    _sent(spark, [("m", t(0), "export", 0.5), ("m", t(15), "import", 4.0), ("m", t(0), "import", 7.0)], f"file://{tmp_path}/in")
    _run(spark, tmp_path)
    assert got() == [("m", 0, 1.0, 0.5, True)]
    _sent(spark, [("m", t(15), "export", 0.1), ("m", t(100), "import", None)], f"file://{tmp_path}/in")
    _run(spark, tmp_path)
    assert ("m", 15, 4.0, 0.1, True) in got()
    _sent(spark, [("end", t(5000), "import", 0.0)], f"file://{tmp_path}/in")
    _run(spark, tmp_path)
    want = [("m", 0, 1.0, 0.5, True), ("m", 15, 4.0, 0.1, True), ("m", 30, None, 3.0, False), ("m", 100, None, None, False), ("n", 0, None, 9.0, False)]
    assert got() == want
    _sent(spark, [("m", t(30), "import", 5.0)], f"file://{tmp_path}/in")  # far behind the watermark
    assert _run(spark, tmp_path) == 1
    assert got() == want


class _Counted:
    """A state that counts what it is asked: each call is a message between two processes."""

    def __init__(self):
        self.calls, self.value, self.map, self.timers = 0, None, {}, set()

    def __getattribute__(self, name):
        if name in ("get", "update", "clear", "containsKey", "getValue", "updateValue", "removeKey", "iterator", "registerTimer", "deleteTimer"):
            self.calls += 1
        return object.__getattribute__(self, name)

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def containsKey(self, key):
        return key in self.map

    def getValue(self, key):
        return self.map[key]

    def updateValue(self, key, value):
        self.map[key] = value

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_keyed_pairs_ask_the_state_for_a_bucket_and_not_for_a_row():
    state, p = _Counted(), keyed.Pairing()
    p.init(state)
    n = 3000
    rows = pd.DataFrame({"mp_id": [str(k % 7) for k in range(n)], "at": [k * 60_000_000 for k in range(n)], "register": "import", "imported": True, "kwh": 1.0})
    assert list(p.handleInputRows(("0",), iter([rows[:2000], rows[2000:]]), None)) == []
    assert state.calls <= 3 and state.timers == {0}
    (both,) = p.handleInputRows(("0",), iter([rows[2990:].assign(register="export", imported=False, kwh=2.0)]), None)
    assert both["complete"].all() and sorted(both["ts"].dt.minute + 60 * both["ts"].dt.hour + 1440 * (both["ts"].dt.day - 1)) == list(range(2990, 3000))
    now = types.SimpleNamespace(getCurrentWatermarkInMs=lambda: 2995 * 60_000)
    (alone,) = p.handleExpiredTimer(("0",), now, None)
    assert len(alone) == 2990 and not alone["complete"].any() and alone["export"].isna().all()
    assert state.calls <= 9 and state.timers == {0, 2995 * 60_000}  # Spark deletes the one that fired
    now.getCurrentWatermarkInMs = lambda: 10**10
    assert list(p.handleExpiredTimer(("0",), now, None)) == [] and state.value is None


def test_pairing_as_arrays_equals_rows_one_by_one(monkeypatch):
    """Repeats, missing values and null ids, in several calls"""
    draw = random.Random(5)
    monkeypatch.setattr(keyed, "ROWS", 40)
    state, p, known, want, got = _Counted(), keyed.Pairing(), {}, [], []
    p.init(state)
    for _ in range(12):
        rows = [(draw.choice(["a", "b", None]), draw.randrange(25), draw.random() < 0.5, draw.choice([None, 1.0, 2.0, 3.0])) for _ in range(60)]
        for meter, at, imported, kwh in rows:
            one = known.setdefault((meter, at), [None, None, False])
            if not one[2]:
                one[0 if imported else 1] = kwh
                if None not in one[:2]:
                    one[2] = True
                    want.append((str(meter), at, *one[:2]))
        frame = pd.DataFrame(rows, columns=["mp_id", "at", "imported", "kwh"]).astype({"kwh": "float64"})
        for out in p.handleInputRows((0,), iter([frame[:25], frame[25:30], frame[30:]]), None):
            got += [(str(m), int(t.value // 1000), i, e) for m, t, i, e in zip(out["mp_id"], out["ts"], out["import"], out["export"])]
    assert sorted(got) == sorted(want) and len(want) > 40
    (alone,) = p.handleExpiredTimer((0,), types.SimpleNamespace(getCurrentWatermarkInMs=lambda: 1), None)
    plain = lambda x: None if pd.isna(x) else x
    rest = sorted(((str(m), int(t.value // 1000), plain(i), plain(e)) for m, t, i, e in zip(alone["mp_id"], alone["ts"], alone["import"], alone["export"])), key=str)
    assert rest == sorted(((str(m), at, i, e) for (m, at), (i, e, sent) in known.items() if not sent), key=str)
