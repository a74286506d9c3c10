"""Every query against its SQL, at the smallest scale."""

import datetime as dt
import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda x: 0.0 if isinstance(x, float) and x == 0 else x
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    got = rows(df.columns, df.collect())
    reply = duck.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in reply.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, reply.fetchall())


def test_arrays_have_the_signs_of_sql(spark):
    """-0.0 equals 0.0 in the test above"""
    data = "/root/testdata/sf0.01"
    reply = duckdb.connect().execute(catalogue.ORACLE_SQL["array_profiles"].replace("FROM embeddings", f"FROM '{data}/embeddings.parquet'"))
    want = sorted(repr(r) for r in reply.fetchall())
    assert any("-0.0," in r for r in want)
    assert sorted(repr(tuple(r)) for r in catalogue.QUERIES["array_profiles"](spark, data).select("vec_id", "label", "p50").collect()) == want


def test_monthly_features_of_odd_days(spark, tmp_path):
    """Days without energy (NaN in SQL), and a share of 41 / 640, which SQL rounds down"""
    at = lambda day, hour: dt.datetime(2024, 1, day, hour)
    sent = [(1, at(1, 12), 0.0), (1, at(2, 12), 1.0), (1, at(2, 3), 2.0), (2, at(1, 12), 0.0), (3, at(1, 3), 0.0), (3, at(2, 12), 2.0), (4, at(1, 12), 0.41), (4, at(1, 3), 5.99)]
    events = spark.createDataFrame([(user, ts, "view", kwh) for user, ts, kwh in sent], "user_id long, ts timestamp, event_type string, value double")
    events.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type", "value").write.parquet(f"file://{tmp_path}/events.parquet")
    df = catalogue.QUERIES["monthly_features"](spark, f"file://{tmp_path}")
    reply = duckdb.connect().execute(catalogue.ORACLE_SQL["monthly_features"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'"))
    names = [c[0] for c in reply.description]
    want = [dict(zip(names, r)) for r in reply.fetchall()]
    assert {r["mp_id"]: str(r["midday_ratio"]) for r in want} == {"1": "nan", "2": "nan", "3": "1.0", "4": "0.064062"}
    assert sorted(repr(r.asDict()) for r in df.select(names).collect()) == sorted(map(repr, want))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs_without_sql(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
