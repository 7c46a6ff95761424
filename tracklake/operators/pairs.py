"""Pairs and triples of trajectories by joins; draws depend on a seed and the keys alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions.draws import draw, uniform
from tracklake.schema import quality_rank


def _sides(df: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    return tuple(df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns]) for p in (a, b))


def quality_pairs(df: DataFrame, robots_only: bool = True) -> DataFrame:
    """(task, chosen_*, rejected_*): rows of one task where the chosen label ranks higher."""
    rows = df.where("is_robot") if robots_only else df
    rows = rows.withColumn("rank", quality_rank(F.col("quality_label")))
    a, b = _sides(rows, "chosen", "rejected")
    return a.join(b, (F.col("chosen_task") == F.col("rejected_task")) & (F.col("chosen_rank") > F.col("rejected_rank")))


def partial_success_pairs(df: DataFrame, digits: int | None = 2) -> DataFrame:
    """Rows of one task where the chosen partial success is greater, rounded half to even or as it is."""
    value = F.col("partial_success").cast("double")
    rows = df.where("is_robot and partial_success is not null").withColumn("value", F.bround(value, digits) if digits is not None else value)
    a, b = _sides(rows, "chosen", "rejected")
    return a.join(b, (F.col("chosen_task") == F.col("rejected_task")) & (F.col("chosen_value") > F.col("rejected_value")))


def partial_success_band(df: DataFrame, least: float = 0.2) -> DataFrame:
    """Ordered pairs of different rows of a task whose partial successes differ by ``least`` or more."""
    a, b = _sides(df.where("partial_success is not null"), "ref", "other")
    apart = F.abs(F.col("ref_partial_success") - F.col("other_partial_success")) >= least
    return a.join(b, (F.col("ref_task") == F.col("other_task")) & (F.col("ref_id") != F.col("other_id")) & apart)


def task_cross(df: DataFrame, tasks: DataFrame) -> DataFrame:
    """Every row with every language task; ``tasks`` is a short list of sampled tasks by design."""
    return df.withColumnRenamed("task", "video_task").crossJoin(F.broadcast(tasks.select(F.col("task").alias("lang_task"))))


def numbered(df: DataFrame, keys: Sequence[str], seed: int, purpose: str, id_: str = "id") -> DataFrame:
    """Adds place, from 0 in each group of keys, and n, its rows; counted in 4096 blocks, so that no group is numbered in one task."""
    dealt = df.withColumn("__b", F.substring(draw(seed, purpose, id_), 1, 3))
    counts = dealt.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__k"))
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("__k").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*keys, "__b", before.alias("__start"), F.sum("__k").over(w).alias("n"))
    own = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(id_)) - 1
    return dealt.join(starts, [*keys, "__b"]).withColumn("place", F.col("__start") + own).drop("__b", "__start")


def spot(seed: int, purpose: str, *key: Column | str) -> Column:
    """A whole number of 32 bits of a row's own."""
    return F.conv(F.substring(draw(seed, purpose + "-spot", *(key or ("id",))), 1, 8), 16, 10).cast("bigint")


def without_own(number: Column, n: Column, own: Column) -> Column:
    """A place below n, each alike but the row's own; null if there is none."""
    m = n - own.isNotNull().cast("int")
    place = F.when(m > 0, number % F.greatest(m, F.lit(1)))
    return place + F.coalesce((place >= own).cast("int"), F.lit(0))


def other_task(refs: DataFrame, pool: DataFrame, seed: int, purpose: str, same_source: float = 0.0, everything: DataFrame | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """(ref_id, task, pick_id, carried columns): for each ref another task, each task alike whatever its size, then a row of it, each alike; nulls if there is none.

    same_source: the share of refs (with data_source) that take a task of their own source,
    of all rows of ``everything``; one that has no row in the pool is drawn once more, and
    two of them give no pick.  Refs whose source has no other task take any task.
    """
    tasks = numbered(pool.select("task").where("task is not null").distinct().withColumn("one", F.lit(1)), ["one"], seed, purpose, "task")
    sized = tasks.select("task", F.col("place").alias("own"), "n")
    total = F.broadcast(tasks.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")))  # one row
    asked = refs.select(F.col("id").alias("ref_id"), "task", *(["data_source"] if same_source > 0 else []))
    asked = asked.crossJoin(total).join(sized.drop("n"), "task", "left")
    # Spots in columns of their own, so that each is drawn once and not in each expression that takes it.
    asked = asked.withColumn("spot", spot(seed, purpose, "ref_id")).withColumn("any_place", without_own(F.col("spot"), F.col("n"), F.col("own"))).drop("n", "own", "spot")
    places = tasks.select(F.col("place").alias("any_place"), F.col("task").alias("any_task"))
    chosen = asked.join(places, "any_place", "left").select("ref_id", *(["task", "data_source"] if same_source > 0 else []), "any_task")
    if same_source > 0:
        of = (pool if everything is None else everything).select("data_source", "task").where("task is not null and data_source is not null").distinct()
        named = numbered(of, ["data_source"], seed, purpose + "-source", "task").join(tasks.select("task", F.lit(True).alias("good")), "task", "left")
        sizes = F.broadcast(named.groupBy("data_source").agg(F.max("n").alias("n")))  # one row a source
        coin = uniform(seed, purpose + "-coin", "ref_id") < same_source
        own = named.select("data_source", "task", F.col("place").alias("own"))
        near = chosen.where(coin).join(sizes, "data_source").join(own, ["data_source", "task"], "left")
        near = near.select("ref_id", "data_source", "n", "own", F.explode(F.array(F.lit(1), F.lit(2))).alias("try"))
        near = near.withColumn("spot", spot(seed, purpose + "-near", "ref_id", "try")).withColumn("place", without_own(F.col("spot"), F.col("n"), F.col("own"))).where("place is not null").drop("spot")
        hits = near.join(named.select("data_source", "place", F.col("task").alias("hit"), "good"), ["data_source", "place"])
        best = hits.groupBy("ref_id").agg(F.min_by("hit", F.when(F.col("good"), F.col("try"))).alias("near_task"), F.lit(True).alias("near"))
        chosen = chosen.join(best, "ref_id", "left").withColumn("any_task", F.when(F.col("near"), F.col("near_task")).otherwise(F.col("any_task")))
    rows = numbered(pool.select("id", "task", *carry).where("task is not null"), ["task"], seed, purpose + "-row")
    counts = rows.groupBy("task").agg(F.max("n").alias("n"))
    wanted = chosen.select("ref_id", F.col("any_task").alias("task")).join(counts, "task", "left")
    wanted = wanted.withColumn("place", spot(seed, purpose + "-pick", "ref_id") % F.col("n")).drop("n")
    found = rows.select("task", "place", F.col("id").alias("pick_id"), *[F.col(c).alias(f"pick_{c}") for c in carry])
    return wanted.join(found, ["task", "place"], "left").select("ref_id", "task", "pick_id", *[f"pick_{c}" for c in carry])


def paired_tasks(df: DataFrame) -> DataFrame:
    """(task, robots, humans): tasks that have both kinds, with their numbers of rows."""
    out = df.groupBy("task").agg(F.count(F.when(F.col("is_robot"), 1)).alias("robots"), F.count(F.when(~F.col("is_robot"), 1)).alias("humans"))
    return out.where("robots > 0 and humans > 0")


def paired_rows(df: DataFrame) -> DataFrame:
    """The rows of tasks that have both kinds: the index of the paired ones."""
    return df.join(paired_tasks(df).select("task"), "task", "left_semi")


def human_robot_triples(df: DataFrame, seed: int, negatives: int, per_side: int = 2) -> DataFrame:
    """(task, human_id, robot_id, negative_task, negative_id) of tasks with both kinds."""
    own = df.withColumn("draw", draw(seed, "side", "id")).withColumn("k", F.row_number().over(Window.partitionBy("task", "is_robot").orderBy("draw", "id"))).where(F.col("k") <= per_side)
    human = own.where("not is_robot").select("task", F.col("id").alias("human_id"))
    robot = own.where("is_robot").select(F.col("task").alias("t"), F.col("id").alias("robot_id"))
    pairs = human.join(robot, F.col("task") == F.col("t")).drop("t")
    slots = pairs.select("*", F.explode(F.sequence(F.lit(1), F.lit(negatives))).alias("slot")).withColumn("id", F.concat_ws("-", "human_id", "robot_id", "slot"))
    other = other_task(slots.select("id", "task"), df, seed, "negative")
    return slots.join(other.select(F.col("ref_id").alias("id"), F.col("task").alias("negative_task"), F.col("pick_id").alias("negative_id")), "id").drop("id")


def swap_by_partial_success(df: DataFrame) -> DataFrame:
    """Chosen and rejected change places where the rejected partial success is greater."""
    swap = F.coalesce(F.col("rejected_partial_success") > F.col("chosen_partial_success"), F.lit(False))
    names = [c[7:] for c in df.columns if c.startswith("chosen_")]
    new = {f"chosen_{n}": F.when(swap, F.col(f"rejected_{n}")).otherwise(F.col(f"chosen_{n}")) for n in names}
    new |= {f"rejected_{n}": F.when(swap, F.col(f"chosen_{n}")).otherwise(F.col(f"rejected_{n}")) for n in names}
    return df.select(*[new.get(c, F.col(c)).alias(c) for c in df.columns])


def with_names(df: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Adds display_name: the short name of the key, else the key itself."""
    return df.join(names.select(F.col("name").alias(key), "short"), key, "left").withColumn("display_name", F.coalesce("short", key)).drop("short")
