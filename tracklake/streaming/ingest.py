"""Structured Streaming: micro-batch ingest, label resume, best checkpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def attach_text_vectors(df: DataFrame, encoder: Callable, text: str = "task", to: str = "lang_vector") -> DataFrame:
    """Each different text is encoded once, in Arrow batches, and joined back.  encoder: (iterator of Series) -> iterator of arrays."""
    encode = F.pandas_udf(encoder, "array<float>")
    vectors = df.select(text).where(F.col(text).isNotNull()).distinct().withColumn(to, encode(text))
    return df.join(vectors, text, "left")


def ingest(stream: DataFrame, path: str, checkpoint: str, encoder: Callable | None = None):
    """Appends micro-batches, each once: a batch that is run again replaces its own part."""

    def flush(batch: DataFrame, number: int) -> None:
        rows = attach_text_vectors(batch, encoder) if encoder is not None else batch
        rows.withColumn("batch", F.lit(number)).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("batch").parquet(path)

    return stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def not_yet_done(rows: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys are not among those done."""
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti")


def windowed_counts(events: DataFrame, time: str, by: str, width: str, late: str) -> DataFrame:
    """Counts by event-time window and key; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select("w.start", by, "n")


def best_checkpoints(scores: DataFrame, k: int) -> DataFrame:
    """A stream of (model, step, score): the steps that enter the k best of their model; a tie does not enter a full list."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(zip(*state.get, strict=True)) if state.exists else []
        entered = []
        for batch in batches:
            for step, score in batch.sort_values("step")[["step", "score"]].itertuples(index=False):
                if len(kept) < k or score > min(kept, key=lambda x: (x[1], -x[0]))[1]:
                    if len(kept) == k:
                        kept.remove(min(kept, key=lambda x: (x[1], -x[0])))
                    kept.append((int(step), float(score)))
                    entered.append((key[0], int(step), float(score)))
        state.update(([s for s, _ in kept], [v for _, v in kept]))
        yield pd.DataFrame(entered, columns=["model", "step", "score"])

    return scores.groupBy("model").applyInPandasWithState(update, "model string, step long, score double", "steps array<long>, scores array<double>", "append", GroupStateTimeout.NoTimeout)
