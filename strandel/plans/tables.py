"""The driver tables recast as tracks, clusterings, pixels and graphs, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SINCE = "2024-01-01 00:00:00"

TRACK_SQL = f"""
track AS (
  SELECT user_id, event_type, value AS y, (epoch_us(ts) - epoch_us(TIMESTAMP '{SINCE}')) / 3.6e9 AS x,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS seq
  FROM events)
"""
#: A scene is a day and an event type; a track in it is one user's events, in order.
SCENE_TRACK_SQL = f"""
strack AS (
  SELECT event_type || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS scene, user_id AS iid, value AS y, (epoch_us(ts) - epoch_us(TIMESTAMP '{SINCE}')) / 3.6e9 AS x,
         CAST(row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE), user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS seq
  FROM events)
"""
PIXEL_SQL = """
pixel AS (SELECT DISTINCT l_returnflag AS scene, CAST(l_partkey % 499 AS INTEGER) AS r, CAST(l_orderkey % 499 AS INTEGER) AS c FROM lineitem)
"""
DAG_SQL = """
dag AS (SELECT DISTINCT l_returnflag AS scene, least(l_partkey % 50, l_suppkey % 50) AS lo, greatest(l_partkey % 50, l_suppkey % 50) AS hi FROM lineitem WHERE l_partkey % 50 <> l_suppkey % 50)
"""
#: Steps between event types within a user's day: a small directed graph a scene.
STEP_SQL = """
step AS (SELECT DISTINCT scene, u, v FROM (SELECT user_id || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS scene, ascii(event_type) AS u, lead(ascii(event_type)) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS v FROM events) WHERE v IS NOT NULL)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hours():
    return (F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'{SINCE}', cast(ts as timestamp_ntz))") / 3.6e9).alias("x")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_type, seq, x, y: all events of a user in time order."""
    seq = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("int").alias("seq")
    return table(spark, sf_dir, "events").select("user_id", "event_type", F.col("value").alias("y"), _hours(), seq)


def scene_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene, iid, seq, x, y."""
    day = F.to_date("ts")
    seq = (F.row_number().over(Window.partitionBy("event_type", day, "user_id").orderBy("ts", "event_id")) - 1).cast("int").alias("seq")
    return table(spark, sf_dir, "events").select(F.concat_ws("/", "event_type", day.cast("string")).alias("scene"), F.col("user_id").alias("iid"), F.col("value").alias("y"), _hours(), seq)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene, r, c: a sparse 499 x 499 mask a return flag, from the line keys."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_returnflag").alias("scene"), (F.col("l_partkey") % 499).cast("int").alias("r"), (F.col("l_orderkey") % 499).cast("int").alias("c")).distinct()


def dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene, lo, hi: acyclic relations from the lower to the higher number."""
    a, b = F.col("l_partkey") % 50, F.col("l_suppkey") % 50
    return table(spark, sf_dir, "lineitem").filter(a != b).select(F.col("l_returnflag").alias("scene"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct()


def type_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene, u, v: each step from one event type to the next within a user's day."""
    day, kind = F.to_date("ts"), F.ascii("event_type")
    w = Window.partitionBy("user_id", day).orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), day.cast("string")).alias("scene"), kind.alias("u"), F.lead(kind).over(w).alias("v"))
    return rows.filter("v is not null").distinct()
