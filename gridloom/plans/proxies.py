"""The meter operators' inputs, as views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same views in DuckDB's SQL, to put in front of an oracle.
SQL = {
    "r": """r AS (SELECT CAST(user_id AS VARCHAR) AS mp_id, ts, CAST(ts AS DATE) AS date,
        CAST(extract('hour' FROM ts) * 4 + floor(extract('minute' FROM ts) / 15) AS INTEGER) AS slot,
        CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'import' ELSE 'export' END AS register,
        value AS kwh, CAST(user_id % 7 AS VARCHAR) AS plz FROM events)""",
    "facts": """facts AS (SELECT CAST(l_suppkey AS VARCHAR) AS mp_id, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
        CASE WHEN l_linestatus = 'F' THEN 'import' ELSE 'export' END AS register, sum(l_quantity) AS kwh, CAST(count(DISTINCT CAST(l_shipdate AS DATE)) AS INTEGER) AS n_days
        FROM lineitem GROUP BY ALL)""",
    "links": """links AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS gp_nr, CAST(l_suppkey AS VARCHAR) AS mp_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "weather": """weather AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS radiation, CAST(count(*) AS INTEGER) AS stations FROM orders GROUP BY ALL)""",
    "vec": """vec AS (SELECT CAST(vec_id AS VARCHAR) AS mp_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS q FROM embeddings)""",
    "scored": """scored AS (SELECT d.doc_id, CAST(n_chars AS DOUBLE) AS score, toxic AS label, quality, lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id)""",
}

#: The stateful step detector over the rings, limits 0.1 and 0.6, two slots at least: a recursion that moves on by a slot, or behind an accepted run.
STEPS = """WITH RECURSIVE vec AS (SELECT CAST(vec_id AS VARCHAR) AS mp_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS q FROM embeddings),
scan AS (SELECT mp_id, 1 AS i, NULL::INTEGER AS start, NULL::INTEGER AS length, NULL::DOUBLE AS excess FROM vec UNION ALL
  SELECT mp_id, CAST(CASE WHEN ok THEN i + n ELSE i + 1 END AS INTEGER), CASE WHEN ok THEN i END, CASE WHEN ok THEN n END, CASE WHEN ok THEN mid END FROM
    (SELECT *, up AND n >= 2 AND mid BETWEEN 0.1 AND 0.6 AS ok FROM (SELECT *, list_aggregate(list_transform(q[i + 1:i + n], lambda x: x - base), 'quantile_cont', 0.5) AS mid FROM
      (SELECT *, CAST(coalesce(nullif(list_position(list_transform(q[i + 1:64], lambda x: x - base >= 0.8 * 0.1), false), 0), 65 - i) - 1 AS INTEGER) AS n FROM
        (SELECT scan.mp_id, i, q, list_aggregate(q[greatest(i - 3, 1):i], 'quantile_cont', 0.5) AS base, q[i + 1] - q[i] >= 0.8 * 0.1 AS up FROM scan JOIN vec ON scan.mp_id = vec.mp_id WHERE i < 64))))),
found AS (SELECT mp_id, start, length, excess FROM scan WHERE start IS NOT NULL) """


def steps(name: str, series: str, low: float, high: float, least: int) -> str:
    """The step detector over ``series`` (mp_id, q) as CTEs, of which ``name`` is (mp_id, start, length, excess); goes behind WITH RECURSIVE."""
    edge = f"{0.8 * low!r}::DOUBLE"
    within = f"mid >= {low!r}::DOUBLE" + (f" AND mid <= {high!r}::DOUBLE" if high != float("inf") else "")
    return f"""{name}_scan AS (SELECT mp_id, 1 AS i, NULL::INTEGER AS start, NULL::INTEGER AS length, NULL::DOUBLE AS excess FROM {series} UNION ALL
  SELECT mp_id, CAST(CASE WHEN ok THEN i + n ELSE i + 1 END AS INTEGER), CASE WHEN ok THEN i END, CASE WHEN ok THEN n END, CASE WHEN ok THEN mid END FROM
    (SELECT *, up AND n >= {least} AND {within} AS ok FROM (SELECT *, list_aggregate(list_transform(q[i + 1:i + n], lambda x: x - base), 'quantile_cont', 0.5) AS mid FROM
      (SELECT *, CAST(coalesce(nullif(list_position(list_transform(q[i + 1:], lambda x: x - base >= {edge}), false), 0), len(q) + 1 - i) - 1 AS INTEGER) AS n FROM
        (SELECT s.mp_id, i, q, list_aggregate(q[greatest(i - 3, 1):i], 'quantile_cont', 0.5) AS base, q[i + 1] - q[i] >= {edge} AS up FROM {name}_scan s JOIN {series} v ON s.mp_id = v.mp_id WHERE i < len(q)))))),
{name} AS (SELECT mp_id, start, length, excess FROM {name}_scan WHERE start IS NOT NULL)"""


#: A number of 52 bits drawn by a seed and a key, as ``functions.draws`` has it.
NUMBER = "CAST('0x' || md5(concat_ws(':', {0}))[1:13] AS BIGINT)"
#: CRC-32 of a text in DuckDB: bytes, then bits, folded into a register.
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}) + 1), lambda i: ascii({0}[i])::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mp_id, ts, date, slot, register, kwh, plz)"""
    e = load(spark, sf_dir, "events")
    slot = (F.hour("ts") * 4 + F.floor(F.minute("ts") / 15)).cast("int")
    register = F.when(F.col("event_type").isin("view", "click", "purchase"), "import").otherwise("export")
    return e.select(F.col("user_id").cast("string").alias("mp_id"), "ts", F.to_date("ts").alias("date"), slot.alias("slot"), register.alias("register"), F.col("value").alias("kwh"), (F.col("user_id") % 7).cast("string").alias("plz"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mp_id, year, month, register, kwh, n_days)"""
    l = load(spark, sf_dir, "lineitem")
    register = F.when(F.col("l_linestatus") == "F", "import").otherwise("export")
    return l.groupBy(F.col("l_suppkey").cast("string").alias("mp_id"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), register.alias("register")).agg(
        F.sum("l_quantity").alias("kwh"), F.count_distinct(F.to_date("l_shipdate")).cast("int").alias("n_days"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gp_nr, mp_id)"""
    l, o = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders")
    return l.join(o, l.l_orderkey == o.o_orderkey).select(F.col("o_custkey").cast("string").alias("gp_nr"), F.col("l_suppkey").cast("string").alias("mp_id")).distinct()


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, radiation, stations)"""
    o = load(spark, sf_dir, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("radiation"), F.count("*").cast("int").alias("stations"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mp_id, label, q): rings of 64 slots"""
    e = load(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("mp_id"), "label", F.col("embedding").cast("array<double>").alias("q"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, score, label, quality, lang)"""
    d, l = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    return d.select("doc_id", F.col("n_chars").cast("double").alias("score"), "lang").join(l, "doc_id").select("doc_id", "score", F.col("toxic").alias("label"), "quality", "lang")


def sql(*views: str) -> str:
    return "WITH " + ", ".join(SQL[v] for v in views) + " "
