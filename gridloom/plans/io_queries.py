"""Archives, downloads and keyed streams: each writes what a table holds and reads it back by its own path."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers
from ..session import scratch
from ..sources import archives, downloads, exports
from ..streaming import keyed, pairing
from . import proxies as P
from .registry import query

r4 = lambda c: F.round(c, 4)
_NTZ = lambda c: F.col(c).cast("timestamp_ntz")


@query("SELECT o_orderkey, o_orderpriority AS priority, CAST(o_orderdate AS DATE) AS date, CAST(round(o_totalprice, 2) AS DECIMAL(18, 2)) AS price FROM orders")
def zipped_register(spark, sf):
    """A register in zip files; three of its columns are parsed, a task reads a member"""
    path = scratch(spark, "zipped")
    o = P.load(spark, sf, "orders")
    wide = o.select(F.col("o_orderkey").alias("KEY"), F.col("o_orderpriority").alias("PRIO"), F.date_format("o_orderdate", "yyyyMMdd").alias("DAY"), F.col("o_orderstatus").alias("STATE"), F.round("o_totalprice", 2).cast("decimal(18,2)").alias("PRICE"))
    archives.write_zipped_text(wide, path, "\t", "", "register.tsv", 5000)
    r = archives.read_zipped_text(spark, path, ".tsv", "\t", "", ["KEY", "PRIO", "DAY", "PRICE"])
    return r.select(F.col("KEY").cast("long").alias("o_orderkey"), F.col("PRIO").alias("priority"), F.to_date("DAY", "yyyyMMdd").alias("date"), F.col("PRICE").cast("decimal(18,2)").alias("price"))


@query("SELECT vec_id, label, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 4)) AS p50 FROM embeddings WHERE vec_id % 2 = 0")
def array_profiles(spark, sf):
    """Profiles as arrays of NPZ files, read back by ranges of rows"""
    path = scratch(spark, "arrays")
    e = P.load(spark, sf, "embeddings")
    archives.write_arrays(e.select("vec_id", "label", F.col("embedding").alias("p50"), F.lit(0.0).alias("unread")), path, 100)
    return archives.read_arrays(spark, path, ["vec_id", "label", "p50"], 64).where("vec_id % 2 = 0").select("vec_id", "label", F.transform("p50", lambda x: numbers.rounded(x.cast("double"), 4)).alias("p50"))


@query("""SELECT CAST(s_nationkey AS INTEGER) AS station, CASE WHEN l_shipdate < DATE '1995-06-17' THEN 'historical' ELSE 'recent' END AS period, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, true AS fetched, 0 AS again FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""")
def downloaded_series(spark, sf):
    """A file for each station and period, fetched into the cache by the executors; a second run asks for nothing"""
    path = scratch(spark, "downloads")
    l, s = P.load(spark, sf, "lineitem"), P.load(spark, sf, "supplier")
    period = F.when(F.col("l_shipdate") < "1995-06-17", "historical").otherwise("recent")
    rows = l.join(s, l.l_suppkey == s.s_suppkey).select(F.col("s_nationkey").cast("int").alias("station"), period.alias("period"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), F.col("l_quantity").cast("long").alias("value"))
    rows.repartition("station", "period").write.partitionBy("station", "period").option("header", True).csv(f"{path}/service")
    # the service's addresses: a file each
    served = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(f"{path}/service").select("path")
    key = lambda name: F.regexp_extract("path", f"{name}=([^/]+)/", 1)
    wanted = served.select(key("station").alias("station"), key("period").alias("period"), F.regexp_replace("path", "^file:/+", "file:///").alias("url"))
    first = downloads.download_missing(spark, wanted, f"{path}/cache", ["station", "period"])
    again = downloads.download_missing(spark, wanted, f"{path}/cache", ["station", "period"]).agg(F.count_if("fetched").cast("int").alias("again"), F.count("*").alias("files"))
    fetched = first.agg(F.bool_and("fetched").alias("fetched"))
    series = downloads.read_downloads(spark, f"{path}/cache", "day string, value long, station int, period string")
    out = series.groupBy("station", "period").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.join(F.broadcast(fetched), F.lit(True)).join(F.broadcast(again.select("again")), F.lit(True))  # a row each


@query("""SELECT CAST(user_id AS VARCHAR) AS mp_id, ts, CASE WHEN event_id % 7 <> 0 THEN round(value, 4) END AS import, CASE WHEN event_id % 5 <> 0 THEN round(value / 2, 4) END AS export, event_id % 7 <> 0 AND event_id % 5 <> 0 AS complete FROM events WHERE event_id % 35 <> 0""")
def keyed_pairs(spark, sf):
    """Pairs from keyed state: exports come twenty minutes late, some registers never, some twice"""
    path = scratch(spark, "keyed")
    e = P.load(spark, sf, "events").select(F.col("user_id").cast("string").alias("mp_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    sent = F.explode(F.array(*[F.struct(F.lit(r).alias("register"), v.alias("kwh"), (F.col("event_id") % k != 0).alias("come"), F.expr(f"ts + interval {m} minutes").alias("arrives")) for r, v, k, m in (("import", F.col("value"), 7, 0), ("export", F.col("value") / 2, 5, 20), ("import", F.col("value"), 7, 25))]))
    rows = e.select("mp_id", "ts", sent.alias("s")).select("mp_id", "ts", "s.*").where("come").drop("come")
    middle = rows.agg(F.percentile_approx(F.unix_micros("arrives"), 0.5).alias("m")).first().m
    early = F.unix_micros("arrives") < F.lit(middle)
    columns = ["mp_id", "ts", "register", "kwh"]
    rows.where(early).repartition(4, "mp_id").sortWithinPartitions("arrives").select(*columns).write.parquet(f"{path}/in")
    at_once = max(1, len(exports.list_paths(spark, f"{path}/in", "*.parquet")))
    rows.where(~early).repartition(4, "mp_id").sortWithinPartitions("arrives").select(*columns).write.mode("append").parquet(f"{path}/in")
    end = spark.range(1).select(F.lit("end").alias("mp_id"), F.lit("2030-01-01").cast("timestamp").alias("ts"), F.lit("import").alias("register"), F.lit(0.0).alias("kwh"))
    end.write.mode("append").parquet(f"{path}/in")  # its time closes all others
    schema = "mp_id string, ts timestamp, register string, kwh double"
    stream = keyed.paired_when_complete(spark.readStream.schema(schema).option("maxFilesPerTrigger", at_once).parquet(f"{path}/in"), "1 hour")
    q = stream.writeStream.outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).format("parquet").option("path", f"{path}/out").start()
    q.awaitTermination()
    out = spark.read.parquet(f"{path}/out").where("mp_id <> 'end'")
    return out.select("mp_id", _NTZ("ts").alias("ts"), r4("import").alias("import"), r4("export").alias("export"), "complete")


@query(P.sql("r") + "SELECT mp_id, ts, register, round(kwh, 4) AS kwh, date FROM r")
def streamed_upserts(spark, sf):
    """Micro-batches that replace their days; the first one comes again after the second"""
    path = scratch(spark, "upserts")
    r = P.readings(spark, sf).select("mp_id", F.col("ts").cast("timestamp").alias("ts"), "register", "kwh")
    middle = r.agg(F.percentile_approx(F.unix_date(F.to_date("ts")), 0.5).alias("d")).first().d
    early = F.unix_date(F.to_date("ts")) < F.lit(middle)
    write = pairing.upsert_days(f"{path}/out")
    for part, test in enumerate((early, ~early, early)):
        r.where(test).withColumn("kwh", F.col("kwh") if part else -F.col("kwh")).write.parquet(f"{path}/in{part}")
        stream = spark.readStream.schema(r.schema).parquet(f"{path}/in{part}")
        q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state{part}").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(f"{path}/out").select("mp_id", _NTZ("ts").alias("ts"), "register", r4("kwh").alias("kwh"), "date")
