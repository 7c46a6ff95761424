"""The canonical trajectory view over the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, task, data_source, quality_label, is_robot, partial_success, num_frames (null without lines), reward."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("int").alias("num_frames"))
    status = F.col("o_orderstatus")
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, o.o_orderkey == n.l_orderkey, "left")
        .select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("task"), F.col("c_mktsegment").alias("data_source"),
            F.when(status == "P", "successful").when(status == "O", "suboptimal").otherwise("failure").alias("quality_label"),
            (F.col("o_orderkey") % 3 != 0).alias("is_robot"), ((F.floor("o_totalprice") % 5) / 4.0).cast("double").alias("partial_success"),
            "num_frames", F.col("o_totalprice").alias("reward"),
        )
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, frame_idx, value, event_type: the series of events of each user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), (F.row_number().over(w) - 1).alias("frame_idx"), "value", "event_type", "ts")


TRAJ = """traj AS (SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS task, c_mktsegment AS data_source,
 CASE o_orderstatus WHEN 'P' THEN 'successful' WHEN 'O' THEN 'suboptimal' ELSE 'failure' END AS quality_label,
 CASE o_orderstatus WHEN 'P' THEN 3 WHEN 'O' THEN 2 ELSE 1 END AS rank,
 (o_orderkey % 3 <> 0) AS is_robot, CAST(CAST(floor(o_totalprice) AS BIGINT) % 5 AS DOUBLE) / 4 AS partial_success, n.num_frames, o_totalprice AS reward
 FROM orders JOIN customer ON o_custkey = c_custkey
 LEFT JOIN (SELECT l_orderkey, CAST(count(*) AS INTEGER) AS num_frames FROM lineitem GROUP BY 1) n ON o_orderkey = n.l_orderkey)"""

FRAMES = """fr AS (SELECT user_id AS id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS frame_idx, value, event_type, ts FROM events)"""
