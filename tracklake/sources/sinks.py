"""Writers: the canonical table with a manifest, and metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.functions.text import cache_key


def cache_folder(root: str, dataset: str, subset: str) -> str:
    """The folder of a dataset's subset, by its path key."""
    return f"{root}/{dataset.replace('/', '_').replace(':', '_')}/{subset.replace('/', '_').replace(':', '_')}"


def save_table(df: DataFrame, path: str, settings: dict[str, object]) -> None:
    """The table as Parquet, and one manifest row: count and a hash of all settings."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    text = ",".join(f"{k}={settings[k]}" for k in sorted(settings))
    saved = df.sparkSession.read.parquet(f"{path}/rows")
    saved.agg(F.count(F.lit(1)).alias("total")).withColumn("config_hash", F.md5(F.lit(text))).withColumn("path", F.lit(path)).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def available(df_names: DataFrame, manifests: DataFrame) -> DataFrame:
    """(name, available): which asked-for tables have a manifest."""
    have = manifests.select(cache_key(F.col("name")).alias("key"), F.lit(True).alias("found"))
    return df_names.withColumn("key", cache_key(F.col("name"))).join(have, "key", "left").select("name", F.coalesce("found", F.lit(False)).alias("available"))


def save_metrics(df: DataFrame, path: str) -> None:
    """(dataset, ...) metrics, one partition a dataset: a dataset written again replaces its own part only."""
    df.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("dataset").parquet(path)


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
