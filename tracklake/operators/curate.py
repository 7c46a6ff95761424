"""Filters with reasons, validation, statistics and counts of a trajectory table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklake.schema import TEXT_VECTOR, TRAJECTORY


def drop_reason(keywords: Sequence[str] = (), min_frames: int | None = None, labels: Sequence[str] = ()) -> Column:
    """The first reason to drop a row, or null: task keyword, too few frames, label.  A null task has no keyword."""
    out = F.lit(None).cast("string")
    if labels:
        out = F.when(~F.coalesce(F.col("quality_label").isin(*labels), F.lit(False)), "label").otherwise(out)
    if min_frames is not None:
        out = F.when(F.coalesce(F.col("num_frames") <= min_frames, F.lit(False)), "frames").otherwise(out)
    for k in keywords:
        out = F.when(F.coalesce(F.lower("task").contains(k.lower()), F.lit(False)), "keyword").otherwise(out)
    return out


def filter_rows(df: DataFrame, **rules) -> DataFrame:
    return df.withColumn("__reason", drop_reason(**rules)).where("__reason is null").drop("__reason")


def count_reasons(df: DataFrame, **rules) -> DataFrame:
    """Rows by reason, each row counted once; kept rows as 'kept'."""
    return df.groupBy(F.coalesce(drop_reason(**rules), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def keep_tasks_with_success(df: DataFrame) -> DataFrame:
    """Drops rows without partial success whose task has no successful row; null tasks stay."""
    good = df.where("quality_label = 'successful'").select(F.col("task").alias("__task")).distinct()
    joined = df.join(good, df.task == F.col("__task"), "left")
    return joined.where(F.col("partial_success").isNotNull() | F.col("task").isNull() | F.col("__task").isNotNull()).drop("__task")


#: Tasks of more rows are looked up in a list that every task of Spark holds.
LARGE_TASK = 100_000


def keep_mixed_tasks(df: DataFrame, labels: Sequence[str] = ("successful", "failure"), large: int = LARGE_TASK) -> DataFrame:
    """Rows of tasks that have every one of the labels; rows without a task count as one.

    Flags are gathered a task before they are joined, so the rows of a task never meet: tasks
    of ``large`` rows and more are at most rows / large, and are broadcast; their rows are
    dealt by a salt where the others meet their flags.
    """
    flags = df.groupBy(F.col("task").alias("__task")).agg(F.count(F.lit(1)).alias("__n"), *[F.coalesce(F.bool_or(F.col("quality_label") == label), F.lit(False)).alias(f"__has{k}") for k, label in enumerate(labels)])
    flags = flags.withColumn("__mixed", F.lit(True))
    for k in range(len(labels)):
        flags = flags.withColumn("__mixed", F.col("__mixed") & F.col(f"__has{k}"))
    is_large = F.col("__n") >= large
    of_large = F.broadcast(flags.where(is_large).select(F.col("__task").alias("__t"), F.col("__mixed").alias("__large")))
    # Their salt is computed (0): a literal would be folded out of the join's keys, and rows would be dealt by the task alone.
    of_others = flags.where(~is_large & F.col("__mixed")).select("__task", is_large.cast("int").alias("__s"), F.lit(True).alias("__other"))
    marked = df.join(of_large, F.col("task").eqNullSafe(F.col("__t")), "left").where(F.coalesce("__large", F.lit(True)))
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]), F.lit(4096)) + 1
    marked = marked.withColumn("__salt", F.when(F.col("__large"), spread).otherwise(0).cast("int"))
    met = marked.join(of_others, F.col("task").eqNullSafe(F.col("__task")) & (F.col("__salt") == F.col("__s")), "left")
    return met.where(F.coalesce("__large", "__other", F.lit(False))).select(*[F.col(f"`{c}`") for c in df.columns])


def progress_weight(preference_only: Sequence[str] = ()) -> Column:
    """Whether a row's progress is learnt from: by source, partial success, label and kind of sample."""
    label, source = F.col("quality_label"), F.col("data_source")
    return (
        F.when(source.isin(*preference_only) if preference_only else F.lit(False), 0.0)
        .when(F.col("partial_success").isNotNull() & source.contains("roboreward"), 1.0)
        .when(label.isin("suboptimal", "failure", "failed"), 0.0)
        .when((label == "successful") | (F.col("data_gen_strategy") == "rewind"), 1.0)
        .otherwise(0.0)
    )


def violations(df: DataFrame) -> DataFrame:
    """One row (id, level, problem) for each broken rule of the trajectory schema."""
    required = [c for c in ("id", "task", "data_source", "frames", "is_robot", "quality_label") if c in df.columns]
    checks = [F.when(F.col(c).isNull(), F.struct(F.lit("error").alias("level"), F.lit(f"{c} is missing").alias("problem"))) for c in required]
    if "lang_vector" in df.columns:
        checks.append(F.when(F.size("lang_vector") != TEXT_VECTOR, F.struct(F.lit("error").alias("level"), F.lit("lang_vector has another length").alias("problem"))))
    if "quality_label" in df.columns:
        checks.append(F.when(~F.col("quality_label").isin("successful", "suboptimal", "failure"), F.struct(F.lit("warning").alias("level"), F.lit("quality_label is unknown").alias("problem"))))
    if "partial_success" in df.columns:
        checks.append(F.when(~F.col("partial_success").between(0.0, 1.0), F.struct(F.lit("error").alias("level"), F.lit("partial_success is out of range").alias("problem"))))
    found = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return df.select("id", F.explode(found).alias("v")).select("id", "v.level", "v.problem")


def percentiles(df: DataFrame, by: str, value: str, parts: dict[str, float]) -> DataFrame:
    """Exact percentiles of each group, between neighbours by their distance: from counts of the different values, which Spark can spill."""
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(by)
    counts = counts.withColumn("__upto", F.sum("__n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("__all", F.sum("__n").over(w))
    out = []
    for name, q in parts.items():
        at = F.col("__all") * q - q
        holds = lambda k: (F.col("__upto") - F.col("__n") <= k) & (k < F.col("__upto"))
        low, high = F.max(F.when(holds(F.floor(at)), F.col(value))), F.max(F.when(holds(F.ceil(at)), F.col(value)))
        rest = F.max(at - F.floor(at))
        out.append((low + (high - low) * rest).cast("double").alias(name))
    return counts.groupBy(by).agg(*out)


def frame_statistics(df: DataFrame, by: str) -> DataFrame:
    """Count, sum, range, mean, median, population deviation and quartiles of num_frames."""
    x = F.col("num_frames")
    sums = df.groupBy(by).agg(F.count(x).alias("n"), F.sum(x).alias("total"), F.min(x).alias("least"), F.max(x).alias("most"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("deviation"))
    return sums.join(percentiles(df, by, "num_frames", {"median": 0.5, "q25": 0.25, "q75": 0.75}), by, "left")


def rolled_counts(df: DataFrame, *levels: str) -> DataFrame:
    """Rows and frames by each level and in all, with the ratio of the sums; null marks a total."""
    return df.rollup(*levels).agg(F.count(F.lit(1)).alias("n"), F.sum("num_frames").alias("frames"), F.try_divide(F.sum("num_frames"), F.count("num_frames")).alias("mean_frames"))


def noop_frames(actions: DataFrame, key: str, order: Sequence[str], motion: str, gripper: str, threshold: float = 1e-4) -> DataFrame:
    """Flags frames of almost no motion whose gripper is as in the frame before."""
    before = F.lag(gripper).over(Window.partitionBy(key).orderBy(*order))
    norm = F.sqrt(F.aggregate(motion, F.lit(0.0), lambda a, x: a + x * x))
    return actions.withColumn("is_noop", (norm < threshold) & (before.isNull() | (before == F.col(gripper))))


def inverted_index(df: DataFrame, *keys: str) -> DataFrame:
    """(kind, key, id): an entry for each value of each key column of a row; null values have none.  No list of ids is gathered."""
    entries = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("key")) for k in keys])
    return df.select("id", F.explode(entries).alias("e")).where("e.key is not null").select("e.kind", "e.key", "id")


def resolve_keys(names: Sequence[object], groups: DataFrame) -> DataFrame:
    """(dataset, place): group names become their members, other names stay; the first place of each counts."""
    spark = groups.sparkSession
    flat = [n for x in names for n in (x if isinstance(x, list | tuple) else [x])]
    asked = spark.createDataFrame(list(enumerate(flat)), "pos int, name string")
    got = asked.join(groups.select(F.col("name"), F.posexplode("members").alias("sub", "member")), "name", "left")
    got = got.select("pos", F.coalesce("sub", F.lit(0)).alias("sub"), F.coalesce("member", "name").alias("dataset"))
    return got.groupBy("dataset").agg(F.min(F.struct("pos", "sub")).alias("at")).select("dataset", F.row_number().over(Window.orderBy("at")).alias("place"))  # a short list of names


def with_cutoffs(df: DataFrame, cutoffs: DataFrame, default: float) -> DataFrame:
    """Adds cutoff: the success percent of the row's source in (data_source, success_percent), else the default."""
    joined = df.join(cutoffs.select("data_source", "success_percent"), "data_source", "left")
    return joined.withColumn("cutoff", F.coalesce("success_percent", F.lit(default))).drop("success_percent")


def numbered_tasks(df: DataFrame) -> DataFrame:
    """(task, place): the different tasks in their order; those of equal first two characters are numbered together."""
    tasks = df.select("task").where("task is not null").distinct().withColumn("__b", F.left("task", F.lit(2)))
    counts = tasks.groupBy("__b").agg(F.count(F.lit(1)).alias("__k"))
    before = F.coalesce(F.sum("__k").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over the counts
    own = F.row_number().over(Window.partitionBy("__b").orderBy("task"))
    return tasks.join(counts.select("__b", before.alias("__s")), "__b").select("task", (F.col("__s") + own).cast("bigint").alias("place"))


def filter_by_source(df: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """Rows that the rules of their source keep; a source without rules keeps all."""
    keep = F.lit(True)
    for source, rule in rules.items():
        keep = F.when(F.col("data_source") == source, drop_reason(**rule).isNull()).otherwise(keep)
    return df.where(F.coalesce(keep, F.lit(True)))


def type_violations(df: DataFrame, schema: T.StructType = TRAJECTORY) -> DataFrame:
    """(column, expected, found) of the schema's columns that are missing (null) or of another type."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = [(f.name, f.dataType.simpleString(), have.get(f.name)) for f in schema if have.get(f.name) != f.dataType.simpleString()]
    return df.sparkSession.createDataFrame(rows, "column string, expected string, found string")
