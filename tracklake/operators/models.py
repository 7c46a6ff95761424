"""Models behind Arrow batches: a model is a function of a pandas DataFrame, loaded once a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Model = Callable[[pd.DataFrame], list]


def score(df: DataFrame, load: Callable[[], Model], to: str, kind: str) -> DataFrame:
    """Adds the model's output for each row; ``load`` runs once a task, the key columns travel with the rows."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{to}` {kind}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield batch.assign(**{to: model(batch)})

    return df.mapInPandas(run, schema)


def by_sample_type(df: DataFrame, models: dict[str, Callable[[], Model]], to: str, kind: str) -> DataFrame:
    """Each sample type by its own model; an unknown type is an error when it is read."""
    known = F.col("sample_type").isin(*models)
    checked = df.withColumn("sample_type", F.when(known, F.col("sample_type")).otherwise(F.raise_error(F.lit("unknown sample type"))))
    parts = [score(checked.where(F.col("sample_type") == t), load, to, kind) for t, load in models.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fit_length(values: Column, n: Column, scale_percent: bool = True) -> Column:
    """Per-frame values held to n: the last is repeated or the rest cut; none: zeros; above 1: all divided by 100."""
    raw = F.transform(F.coalesce(values, F.array().cast("array<double>")), lambda x: F.coalesce(x, F.lit(0.0)))
    scaled = F.when(F.array_max(raw) > 1, F.transform(raw, lambda x: x / 100)).otherwise(raw) if scale_percent else raw
    last = F.coalesce(F.try_element_at(scaled, F.lit(-1)), F.lit(0.0))
    return F.slice(F.concat(scaled, F.array_repeat(last, F.greatest(F.lit(0), n - F.size(scaled)))), F.lit(1), n)


def preference_view(df: DataFrame, seed: int, training: bool) -> DataFrame:
    """A and B sides of chosen and rejected: in training by a hash of the id, else the chosen first; label 1 if A is chosen."""
    first = (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(2)) == 0) if training else F.lit(True)
    names = [c[7:] for c in df.columns if c.startswith("chosen_")]
    a = [F.when(first, F.col(f"chosen_{n}")).otherwise(F.col(f"rejected_{n}")).alias(f"a_{n}") for n in names]
    b = [F.when(first, F.col(f"rejected_{n}")).otherwise(F.col(f"chosen_{n}")).alias(f"b_{n}") for n in names]
    return df.select("id", *a, *b, first.cast("double").alias("label"))
