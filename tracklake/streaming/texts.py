"""Vectors of texts, each text encoded once, kept in a table that batches and micro-batches share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STORE = "text string, vector array<float>, round bigint"


def _store(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(STORE).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], STORE)


def encode_new(texts: DataFrame, path: str, encoder: Callable, round_: int) -> DataFrame:
    """Encodes the texts (text) that the store at a path does not hold, and returns the store.

    encoder: annotated as Iterator[pd.Series] -> Iterator[pd.Series], of arrays, in Arrow batches.  A round that is
    run again, as a micro-batch may be, replaces its own part of the store.
    """
    spark = texts.sparkSession
    encode = F.pandas_udf(encoder, "array<float>")
    known = _store(spark, path).where(F.col("round") != round_).select("text")
    new = texts.select("text").where("text is not null").distinct().join(known, "text", "left_anti")
    rows = new.select("text", encode("text").alias("vector"), F.lit(round_).cast("bigint").alias("round"))
    rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("round").parquet(path)
    return _store(spark, path)


def with_vectors(df: DataFrame, path: str, encoder: Callable, text: str = "task", to: str = "lang_vector", round_: int = -1) -> DataFrame:
    """Adds the vector of each row's text; only texts that the store does not hold are encoded."""
    store = encode_new(df.select(F.col(text).alias("text")), path, encoder, round_)
    return df.join(store.select(F.col("text").alias(text), F.col("vector").alias(to)), text, "left")


def attach_in_stream(stream: DataFrame, path: str, out: str, checkpoint: str, encoder: Callable, text: str = "task"):
    """Writes a stream's rows with the vectors of their texts; a text of any micro-batch is encoded once."""

    def flush(batch: DataFrame, number: int) -> None:
        rows = with_vectors(batch, path, encoder, text, round_=number)
        rows.withColumn("batch", F.lit(number)).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("batch").parquet(out)

    return stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
