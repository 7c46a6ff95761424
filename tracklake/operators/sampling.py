"""Caps, rounds, weights and strategies with draws by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions.draws import draw, ladder, uniform


def cap_per(df: DataFrame, keys: list[str], k: int | None, seed: int, purpose: str, id_: str = "id") -> DataFrame:
    """At most k rows of each group by their draws; null: all."""
    if k is None or k < 0:
        return df
    w = Window.partitionBy(*keys).orderBy(draw(seed, purpose, id_), id_)
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= k).drop("__k")


def cap_all(df: DataFrame, k: int | None, seed: int, purpose: str, id_: str = "id") -> DataFrame:
    """At most k rows in all by their draws: a top-k, kept small in each partition."""
    return df if k is None or k < 0 else df.orderBy(draw(seed, purpose, id_), id_).limit(k)


def round_robin(df: DataFrame, group: str, key: str, k: int, seed: int, purpose: str) -> DataFrame:
    """k rows of each group: in each round one row of each key, keys and rows by their draws; adds round and place."""
    inner = Window.partitionBy(group, key).orderBy(draw(seed, purpose, "id"), "id")
    rounds = df.withColumn("round", F.row_number().over(inner)).where(F.col("round") <= k)
    outer = Window.partitionBy(group).orderBy("round", draw(seed, purpose + "-key", key, "round"), key)
    return rounds.withColumn("place", F.row_number().over(outer)).where(F.col("place") <= k)


def circular(df: DataFrame, group: str, key: str, k: int | None, seed: int, purpose: str) -> DataFrame:
    """Up to k rows of each group with several keys: round after round one drawn row of each key in the order of the keys, until k or all are taken; null: all.  Adds place."""
    several = df.groupBy(group).agg((F.min(key) != F.max(key)).alias("__several")).where("__several").select(group)
    rows = df.where(F.col(key).isNotNull()).join(several, group, "left_semi")
    inner = Window.partitionBy(group, key).orderBy(draw(seed, purpose, "id"), "id")
    rows = rows.withColumn("__round", F.row_number().over(inner))
    if k is not None:
        rows = rows.where(F.col("__round") <= k)
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("__round", key))).drop("__round")
    return placed if k is None else placed.where(F.col("place") <= k)


def cap_pairs(pairs: DataFrame, per_task: int | None, most: int | None, seed: int, id_: str = "id") -> DataFrame:
    """At most ``per_task`` pairs of each task, then at most ``most`` of what is left, both by their draws; null: all."""
    return cap_all(cap_per(pairs, ["task"], per_task, seed, "pairs of a task", id_), most, seed, "pairs", id_)


def allowed_successes(df: DataFrame, tasks: DataFrame, k: int | None, seed: int) -> DataFrame:
    """At most k successful rows of the listed tasks (task) by their draws; null: all."""
    return cap_all(df.where("quality_label = 'successful'").join(tasks.select("task"), "task", "left_semi"), k, seed, "allowed")


def cap_tasks(df: DataFrame, k: int, seed: int, purpose: str) -> DataFrame:
    """The rows of k tasks, chosen by their draws."""
    some = df.select("task").where("task is not null").distinct().orderBy(draw(seed, purpose, "task"), "task").limit(k)
    return df.join(F.broadcast(some), "task", "left_semi")


def normalized_weights(sources: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(data_source, weight): default 1, in parts of the sum; equal parts if the sum is not positive."""
    raw = F.lit(1.0)
    for name, w in weights.items():
        raw = F.when(F.col("data_source") == name, float(w)).otherwise(raw)
    out = sources.select("data_source").distinct().withColumn("raw", raw)
    total, n = F.sum("raw").over(Window.partitionBy()), F.count(F.lit(1)).over(Window.partitionBy())
    return out.select("data_source", F.when(total > 0, F.col("raw") / total).otherwise(1 / n).alias("weight"))


def weighted_sources(draws: DataFrame, weights: DataFrame) -> DataFrame:
    """Adds data_source to rows with ``u``: the source whose share of [0, 1) holds u, the last one open-ended."""
    w = Window.orderBy("data_source").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = weights.withColumn("hi", F.sum("weight").over(w)).withColumn("lo", F.col("hi") - F.col("weight"))
    edges = edges.withColumn("hi", F.when(F.lead("hi").over(Window.orderBy("data_source")).isNull(), F.lit(2.0)).otherwise(F.col("hi")))
    # Sources are a short list of names.
    return draws.join(F.broadcast(edges.select("data_source", "lo", "hi")), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).drop("lo", "hi")


def balanced_draws(df: DataFrame, n: int, weights: dict[str, float], seed: int) -> DataFrame:
    """(draw, data_source, id): n draws of a source by weight, then of a row of it, each alike."""
    spark = df.sparkSession
    asked = spark.range(n).select(F.col("id").alias("draw")).withColumn("u", uniform(seed, "source", "draw"))
    named = weighted_sources(asked, normalized_weights(df, weights))
    # The rows of a source are numbered in 4096 blocks, so that no source is numbered in one task.
    dealt = df.select("data_source", "id", F.substring(draw(seed, "block", "id"), 1, 3).alias("b"))
    counts = dealt.groupBy("data_source", "b").agg(F.count(F.lit(1)).alias("k"))
    before = F.sum("k").over(Window.partitionBy("data_source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("data_source", "b", F.coalesce(before, F.lit(0)).alias("start"))
    totals = counts.groupBy("data_source").agg(F.sum("k").alias("total"))
    ranked = dealt.join(starts, ["data_source", "b"]).withColumn("rank", F.col("start") + F.row_number().over(Window.partitionBy("data_source", "b").orderBy("id")) - 1)
    spot = named.join(F.broadcast(totals), "data_source").withColumn("rank", F.floor(uniform(seed, "row", "draw") * F.col("total")).cast("bigint"))
    return spot.join(ranked.select("data_source", "rank", "id"), ["data_source", "rank"]).select("draw", "data_source", "id")


def sample_type(df: DataFrame, ratios: dict[str, float], seed: int, attempt: int = 0) -> DataFrame:
    """Adds sample_type: preference for rows that are not successful, else by the ratios."""
    picked = ladder(uniform(seed, f"type-{attempt}", "id"), ratios)
    return df.withColumn("sample_type", F.when(F.col("quality_label") != "successful", "preference").otherwise(picked))


def strategy(df: DataFrame, ratios: dict[str, float], seed: int, blocked: str = "blocked") -> DataFrame:
    """Adds strategy: the first of the strategies in the order of their draws that the row does not block.

    A draw u to the power 1 / weight orders them, so that each comes first in proportion
    to its weight; null if all are blocked.
    """
    options = []
    for name, w in ratios.items():
        if w > 0:
            rank = -F.pow(uniform(seed, f"strategy-{name}", "id") + 1e-12, 1 / w)
            free = ~F.array_contains(F.col(blocked), name) if blocked in df.columns else F.lit(True)
            options.append(F.when(free, F.struct(rank.alias("r"), F.lit(name).alias("name"))))
    return df.withColumn("strategy", F.array_min(F.filter(F.array(*options), lambda x: x.isNotNull()))["name"])


def repeat(df: DataFrame, epochs: int) -> DataFrame:
    """Each row once for each epoch."""
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch")) if epochs > 0 else df.withColumn("epoch", F.lit(0)).limit(0)
