"""Evaluations of predictions over whole series: alignment, success, ranking of several rewards, sampling counters, tables of results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions import frames as fr
from tracklake.operators import metrics

#: Labels of rows that an evaluation takes; others take all.
EVAL_LABELS = {"reward_alignment": ("successful",), "confusion_matrix": ("successful", "suboptimal")}


def eval_rows(df: DataFrame, kind: str, datasets: Sequence[str] = ()) -> DataFrame:
    """Rows of the labels that the evaluation takes; a single dataset with partial success for labels takes all."""
    labels = None if len(datasets) == 1 and "roboreward" in datasets[0] else EVAL_LABELS.get(kind)
    return df if labels is None else df.where(F.col("quality_label").isin(*labels))


def training_rows(df: DataFrame, ratios: Sequence[float], training: bool = True) -> DataFrame:
    """Successful rows only, if training draws progress samples alone."""
    return df.where("quality_label = 'successful'") if training and list(ratios) == [0, 1, 0] else df


def in_category(source: Column, categories: dict[str, Sequence[str]], category: str) -> Column:
    """Whether a source belongs to a category of the table {category: sources}."""
    names = categories.get(category, ())
    return F.coalesce(source.isin(*names), F.lit(False)) if names else F.lit(False)


def suiting_sources(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows of the sources of the names, or all rows if the table has none of them."""
    some = df.where(F.col("data_source").isin(*names)).select(F.lit(True).alias("some")).limit(1)
    flagged = df.join(F.broadcast(some), F.lit(True), "left")  # one row at most
    return flagged.where(F.col("some").isNull() | F.col("data_source").isin(*names)).drop("some")


def combined(parts: dict[str, DataFrame]) -> DataFrame:
    """The rows of several datasets with the dataset's name: a missing column is null, ids are unique with the name."""
    out = None
    for name, part in parts.items():
        named = part.withColumn("dataset", F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


def spread_tasks(df: DataFrame, tasks: str) -> DataFrame:
    """(task_name, fields) of a map from a task to its rows."""
    rows = df.select(F.explode(F.map_entries(tasks)).alias("e")).select(F.col("e.key").alias("task_name"), F.explode("e.value").alias("r"))
    return rows.select("task_name", "r.*")


def key_matches(key: Column, dataset: Column | str, *members: str) -> Column:
    """Whether the part of a metric's key before the slash names a dataset, or the list of its members."""
    shown = "[" + ", ".join(f"'{m}'" for m in members) + "]"
    head = F.substring_index(key, "/", 1)
    return (head == dataset) | (head == shown)


# ---- alignment ------------------------------------------------------------------------------


def alignment_by_trajectory(df: DataFrame, relative: bool = False, partial: bool = False, bins: int = 5) -> DataFrame:
    """(id, data_source, quality_label, loss, pearson, delta, pred_bin, true_bin) of rows with progress_pred and target_progress.

    Mean squared error and correlation (0 if it is not defined) of successful rows; with
    ``partial`` the distance of the last prediction from the partial success, and the bins
    of both.  Relative series are summed up first.
    """
    p, t = F.col("progress_pred"), F.col("target_progress")
    if relative:
        p, t = fr.running_sum(p), fr.running_sum(t)
    rows = df.withColumns({"__p": p, "__t": t})
    last = F.try_element_at("__p", F.lit(-1))
    ends = rows.select("id", "data_source", "quality_label", "partial_success", last.alias("__last"), F.posexplode_outer(F.arrays_zip(F.col("__p").alias("p"), F.col("__t").alias("t"))).alias("k", "x"))
    good = F.col("quality_label") == "successful"
    e = F.when(good, (F.col("x.t") - F.col("x.p")) * (F.col("x.t") - F.col("x.p")))
    out = ends.withColumns({"__x": F.when(good, F.col("x.p")), "__y": F.when(good, F.col("x.t")), "__e": e})
    out = out.groupBy("id", "data_source", "quality_label", "partial_success", "__last").agg(F.avg("__e").alias("loss"), metrics.correlation("__x", "__y").alias("pearson"))
    ps = F.col("partial_success") if partial else F.lit(None).cast("double")
    known = ps.isNotNull()
    return out.select(
        "id", "data_source", "quality_label", "loss", F.when(F.col("quality_label") == "successful", F.coalesce("pearson", F.lit(0.0))).alias("pearson"),
        F.abs(F.col("__last") - ps).alias("delta"), F.when(known, fr.discrete_bin(F.col("__last"), bins)).alias("pred_bin"), F.when(known, fr.discrete_bin(ps, bins)).alias("true_bin"),
    )


def alignment(df: DataFrame, **settings) -> DataFrame:
    """(data_source, loss, pearson, partial_success_abs_delta, mae): means over the trajectories; mae over bins."""
    t = alignment_by_trajectory(df, **settings)
    return t.groupBy("data_source").agg(F.avg("loss").alias("loss"), F.avg("pearson").alias("pearson"), F.avg("delta").alias("partial_success_abs_delta"), F.avg(F.abs(F.col("pred_bin") - F.col("true_bin"))).alias("mae"))


def frames_of(df: DataFrame, by: Sequence[str], **arrays: str) -> DataFrame:
    """One row a frame: the columns ``by``, its number k, and one column for each array of the same length."""
    zipped = F.arrays_zip(*[F.col(c).alias(n) for n, c in arrays.items()])
    return df.select(*by, F.posexplode(zipped).alias("k", "x")).select(*by, "k", *[F.col(f"x.{n}").alias(n) for n in arrays])


def success_metrics(frames: DataFrame, by: Sequence[str], least: float) -> DataFrame:
    """Of frames (logit, target, label, quality_label): loss, accuracy, and that of either label, over the frames that count.

    Frames below ``least`` progress or of label 1 count, and all frames of rows that are not
    successful.  The weights that balance the labels cancel in the mean of the loss.
    """
    bad = F.coalesce(F.lower("quality_label").isin("suboptimal", "failure", "failed"), F.lit(False))
    logit = F.least(F.greatest("logit", F.lit(-50.0)), F.lit(50.0))
    rows = frames.where(bad | (F.col("target") < least) | (F.col("label") > 0.5))
    hit = ((logit > 0) == (F.col("label") > 0.5)).cast("double")
    return rows.groupBy(*by).agg(
        F.avg(metrics.preference_loss(logit, F.col("label"))).alias("loss"), F.avg(hit).alias("accuracy"), F.avg(F.when(F.col("label") > 0.5, hit)).alias("positive"), F.avg(F.when(F.col("label") <= 0.5, hit)).alias("negative"),
        F.count(F.lit(1)).alias("n"),
    )


def masked_spearman(frames: DataFrame, by: Sequence[str], every: DataFrame) -> DataFrame:
    """Of frames (pred, target, mask): the rank correlation of each series over the frames that are not masked; 0 where it is not defined."""
    got = metrics.spearman(frames.where(F.col("mask") > 0), list(by), "pred", "target")
    return every.select(*by).distinct().join(got, list(by), "left").select(*by, F.coalesce("spearman", F.lit(0.0)).alias("spearman"))


def rewards_long(df: DataFrame, predictions: str) -> DataFrame:
    """Each row three times, with the reward taken as the last, the sum and the average of its predictions."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), metrics.trajectory_reward(F.col(predictions), k).alias("reward")) for k in ("last", "sum", "average")])
    return df.select(*[c for c in df.columns if c != predictions], F.explode(kinds).alias("r")).select("*", "r.kind", "r.reward").drop("r")


def ranking_by_reward(df: DataFrame) -> DataFrame:
    """(kind, correct, total, accuracy) over the tasks, for each kind of reward of rows of ``rewards_long``."""
    keyed = df.withColumn("task", F.concat_ws("|", "kind", "task"))
    pairs = metrics.ranking_pairs(metrics._ranked(keyed), "rank").groupBy(F.substring_index("task", "|", 1).alias("kind")).agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"))
    return pairs.withColumn("accuracy", F.col("correct") / F.col("total"))


def accuracy_by_task(df: DataFrame) -> DataFrame:
    """Preference accuracy of each task, and the micro average over all pairs (null task)."""
    valid = F.col("prediction").isNotNull() & F.col("label").isNotNull()
    rows = df.where(valid).withColumn("hit", (F.col("prediction") == F.col("label")).cast("bigint"))
    return rows.rollup("task").agg(F.sum("hit").alias("correct"), F.count(F.lit(1)).alias("total"), F.avg("hit").alias("accuracy"))


# ---- prefixes -------------------------------------------------------------------------------


def prefix_samples(df: DataFrame, n_frames: str, k: int = 4) -> DataFrame:
    """One row for each prefix of a series: frame_step from 1, and k indices spaced over the prefix, repeated where it is short."""
    steps = df.select("*", F.explode(F.when(F.col(n_frames) >= 1, F.sequence(F.lit(1), F.col(n_frames).cast("int")))).alias("frame_step"))
    last = F.col("frame_step") - 1
    spaced = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when((i == k - 1) & F.lit(k > 1), last).otherwise(F.floor(i * (last / max(k - 1, 1)))).cast("int"))
    return steps.withColumn("indices", spaced)


def prefixes_together(df: DataFrame, by: Sequence[str], predictions: str = "progress_pred") -> DataFrame:
    """The last prediction of each prefix, in the order of the steps, as one series; empty predictions have none."""
    last = F.try_element_at(predictions, F.lit(-1))
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(last.isNotNull(), F.struct("frame_step", last.alias("v"))))).alias("s"))
    return rows.select(*by, F.transform("s", lambda x: x["v"]).alias(predictions))


# ---- counters and tables --------------------------------------------------------------------

SHORT = {"preference": "pref", "progress": "prog", "similarity": "sim"}


def sampling_counts(samples: DataFrame) -> DataFrame:
    """(counter, n, fraction) of samples (kind, strategy, data_source): by kind and strategy, by source, by kind; parts of all samples."""
    short = F.create_map(*[F.lit(x) for kv in SHORT.items() for x in kv])[F.col("kind")]
    plural = F.when(F.col("kind") == "progress", "progress").when(F.col("kind") == "similarity", "similarities").otherwise("preferences")
    names = F.array(F.concat_ws("_", short, "strategy"), F.concat(F.lit("total_"), "data_source"), F.concat(F.lit("total_"), plural))
    total = samples.select(F.lit("total_samples").alias("counter"))
    n = samples.select(F.explode(names).alias("counter")).unionAll(total).groupBy("counter").agg(F.count(F.lit(1)).alias("n"))
    whole = F.max(F.when(F.col("counter") == "total_samples", F.col("n"))).over(Window.partitionBy())  # over the counters
    return n.withColumn("fraction", F.col("n") / whole)


def attempt_statistics(samples: DataFrame) -> DataFrame:
    """(name, least, most, mean) of the attempts by kind and strategy, and over all samples (null name)."""
    name = F.regexp_replace(F.concat_ws("_", "kind", "strategy"), "[/ ]", "_")
    rows = samples.where("attempt is not null").withColumn("name", name)
    return rows.rollup("name").agg(F.min("attempt").cast("double").alias("least"), F.max("attempt").cast("double").alias("most"), F.avg("attempt").alias("mean"))


def flat_metrics(df: DataFrame, key: str, values: str) -> DataFrame:
    """(name, value): dataset/metric of a map of metrics; null values are left out."""
    return df.select(key, F.explode(values).alias("metric", "value")).where("value is not null").select(F.concat_ws("/", key, "metric").alias("name"), "value")


def ablation_table(df: DataFrame, datasets: Sequence[str], metric_keys: Sequence[str]) -> DataFrame:
    """One row a model, one column a dataset and metric, of (model, dataset, metric, value)."""
    names = [f"{d}/{m}" for d in datasets for m in metric_keys]
    return df.withColumn("c", F.concat_ws("/", "dataset", "metric")).groupBy("model").pivot("c", names).agg(F.first("value"))


def agreement(df: DataFrame) -> DataFrame:
    """(split, n, agreed, share, confidence) of rows (split, predicted, original, confidence), and over all (null split)."""
    same = (F.col("predicted") == F.col("original")).cast("bigint")
    return df.rollup("split").agg(F.count(F.lit(1)).alias("n"), F.sum(same).alias("agreed"), F.avg(same).alias("share"), F.avg("confidence").alias("confidence"))


def by_motion(df: DataFrame, key: str, frame: str, score: str, k: int) -> DataFrame:
    """The first and the last frame of each series and those of the greatest scores, k in all; equal scores by the earlier frame."""
    w = Window.partitionBy(key)
    ends = (F.col(frame) == F.min(frame).over(w)) | (F.col(frame) == F.max(frame).over(w))
    order = w.orderBy(F.desc("__end"), F.desc_nulls_last(score), frame)
    return df.withColumn("__end", ends).withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= k).drop("__end", "__k")


def progress_loss(df: DataFrame, by: Sequence[str], kind: str = "l2") -> DataFrame:
    """(by, loss) of rows (progress_pred, target_progress, mask): the mean error of each row under its frame mask, summed, by the sum of the masks.

    kind: l1, l2, or ce with logits by frame and bins as targets.
    """
    x = lambda z, k: z[k]

    def error(z: Column) -> Column:
        p, t = x(z, "p"), x(z, "t")
        if kind == "ce":
            top = F.array_max(p)
            return F.log(F.aggregate(p, F.lit(0.0), lambda a, v: a + F.exp(v - top))) + top - F.get(p, F.least(F.greatest(t, F.lit(0)), F.size(p) - 1).cast("int"))
        return F.abs(p - t) if kind == "l1" else (p - t) * (p - t)

    zipped = F.arrays_zip(F.col("progress_pred").alias("p"), F.col("target_progress").alias("t"), F.col("mask").alias("m"))
    summed = F.aggregate(F.transform(zipped, lambda z: error(z) * x(z, "m")), F.lit(0.0), lambda a, v: a + v)
    masks = F.aggregate("mask", F.lit(0.0), lambda a, v: a + v)
    return df.groupBy(*by).agg((F.sum(F.try_divide(summed, F.size("target_progress"))) / (F.sum(masks) + 1e-8)).alias("loss"))
