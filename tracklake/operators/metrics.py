"""Grouped metrics of predictions: accuracy, ranking, correlation, confusion, alignment, similarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.schema import QUALITY_RANK, quality_rank


def trajectory_reward(predictions: Column, how: str) -> Column:
    """last, sum or average of a prediction series; null if it is empty."""
    n = F.size(predictions)
    total = F.aggregate(predictions, F.lit(0.0), lambda a, x: a + x)
    return F.when(n > 0, {"last": F.try_element_at(predictions, F.lit(-1)), "sum": total, "average": total / F.greatest(n, F.lit(1))}[how])


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero of the value itself, as floating point scales it: 0.285 to two digits is 0.28, since 28.499999999999996 is rounded, not its decimal text."""
    return F.round(x * 10.0**digits, 0) / 10.0**digits


def preference_accuracy(df: DataFrame, *by: str) -> DataFrame:
    """correct, total, skipped and accuracy of prediction against label; null predictions or labels are skipped."""
    valid = F.col("prediction").isNotNull() & F.col("label").isNotNull()
    right = F.sum((valid & (F.col("prediction") == F.col("label"))).cast("bigint"))
    total = F.sum(valid.cast("bigint"))
    return df.groupBy(*by).agg(F.coalesce(right, F.lit(0)).alias("correct"), F.coalesce(total, F.lit(0)).alias("total"), F.sum((~valid).cast("bigint")).alias("skipped"), F.try_divide(right, total).alias("accuracy"))


def preference_from_progress(df: DataFrame) -> DataFrame:
    """Share of pairs whose chosen series ends higher than the rejected one; rows without an end or a label are skipped and counted."""
    ok = F.try_element_at("chosen_progress", F.lit(-1)) > F.try_element_at("rejected_progress", F.lit(-1))
    ok = F.when(F.col("label").isNotNull(), ok) if "label" in df.columns else ok
    right, total = F.coalesce(F.sum(ok.cast("bigint")), F.lit(0)), F.count(ok)
    return df.agg(F.try_divide(right, total).alias("accuracy"), right.alias("correct"), total.alias("total"), (F.count(F.lit(1)) - total).alias("skipped"))


def dominated_pairs(df: DataFrame, by: list[str], level: str, order: Column) -> DataFrame:
    """(by, up, equal, total): pairs of rows of different levels, and how many have the lower level before, or an equal order.

    For levels of many values.  Levels and orders become ranks 0, 1, ...; two ranks first
    differ in one binary digit, so the rows that share the digits above it are one small
    problem for each digit: how many rows of digit 0 and a lower rank on the other side each
    row of digit 1 has.  Sums that run along the other side answer it; the side of fewer
    values gives the digits.  The work is n log n for n different rows of a group.
    """
    given = df.where(F.col(level).isNotNull() & order.isNotNull()).select(*by, F.col(level).alias("__level"), order.alias("__order"))
    rows = given.groupBy(*by, "__level", "__order").agg(F.count(F.lit(1)).alias("__n"))
    group, n = Window.partitionBy(*by), F.col("__n")
    # Twice the pairs that are equal in one thing, or differ in it, are the rows' shares in sums over the group.
    rows = rows.withColumns({"__l": F.dense_rank().over(group.orderBy("__level")) - 1, "__like": F.sum(n).over(Window.partitionBy(*by, "__level"))}).drop("__level")
    rows = rows.withColumns({"__r": F.dense_rank().over(group.orderBy("__order")) - 1, "__even": F.sum(n).over(Window.partitionBy(*by, "__order"))}).drop("__order")
    rows = rows.withColumns({"__ml": F.max("__l").over(group), "__mr": F.max("__r").over(group), "__all": F.sum(n).over(group)})
    fewer = F.col("__ml") < F.col("__mr")
    rows = rows.select(*by, "__n", (n * (F.col("__even") - n)).alias("__e"), (n * (F.col("__all") - F.col("__like"))).alias("__t"), F.when(fewer, F.col("__l")).otherwise(F.col("__r")).alias("__d"), F.when(fewer, F.col("__r")).otherwise(F.col("__l")).alias("__s"), F.length(F.bin(F.least("__ml", "__mr").cast("bigint"))).alias("__digits"))
    each = rows.withColumn("__bit", F.explode(F.sequence(F.lit(0), F.col("__digits") - 1)))
    one = F.expr("shiftright(__d, __bit) & 1") == 1
    once = lambda c: F.when(F.col("__bit") == 0, F.col(c)).otherwise(0)
    each = each.select(*by, "__bit", F.expr("shiftright(__d, __bit + 1)").alias("__above"), "__s", F.when(one, 0).otherwise(n).alias("__lo"), F.when(one, n).otherwise(0).alias("__hi"), once("__e").alias("__e"), once("__t").alias("__t"))
    below = F.sum("__lo").over(Window.partitionBy(*by, "__bit", "__above").orderBy("__s").rangeBetween(Window.unboundedPreceding, -1))
    sums = each.withColumn("__below", F.coalesce(below, F.lit(0))).groupBy(*by).agg(F.sum(F.col("__hi") * F.col("__below")).alias("up"), F.sum("__e").alias("__e"), F.sum("__t").alias("__t"))
    return sums.select(*by, "up", F.expr("__e div 2").alias("equal"), F.expr("__t div 2").alias("total"))


def ranking_pairs(df: DataFrame, level: str, strict: bool = False, levels: Sequence[int] = tuple(QUALITY_RANK.values())) -> DataFrame:
    """(task, lower, higher, correct, up, equal, total): pairs of one task and two levels whose rewards stand in their order, or are equal.

    Equal rewards count as right if the lower level has the smaller id, which keeps the
    rule of comparing each pair once in the order of the rows; strict: never.  No pairs of
    rows are formed: sums of each of the few ``levels`` run along the ids of equal rewards,
    then along the rewards of a task, so a task of Spark holds its rows and no tables of groups.
    """
    rows = df.where(F.col("reward").isNotNull() & F.col(level).isin(*levels)).select("task", "reward", "id", F.col(level).alias("__level"))
    low, pairs = sorted(levels)[:-1], [(i, j) for i in sorted(levels) for j in sorted(levels) if i < j]
    equals = Window.partitionBy("task", "reward")
    of = lambda k: ((F.col("__level") == k) & F.col("id").isNotNull()).cast("bigint")
    if not strict:
        rows = rows.withColumns({f"__upto{k}": F.sum(of(k)).over(equals.orderBy("id")) for k in low})
        rows = rows.withColumns({f"__same{k}": F.sum(of(k)).over(Window.partitionBy("task", "reward", "id")) for k in low})
    rows = rows.withColumn("__first", F.row_number().over(equals.orderBy("id")))
    known = {f"__n{k}": F.sum((F.col("__level") == k).cast("bigint")).over(equals) for k in levels}
    ties = {f"__t{i}_{j}": F.lit(0).cast("bigint") if strict else F.sum(of(j) * (F.col(f"__upto{i}") - F.col(f"__same{i}"))).over(equals) for i, j in pairs}
    counts = rows.withColumns(known | ties).where("__first = 1").select("task", "reward", *known, *ties)
    along = Window.partitionBy("task").orderBy("reward").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({f"__below{k}": F.coalesce(F.sum(f"__n{k}").over(along), F.lit(0)) for k in low})
    n = lambda k: F.col(f"__n{k}")
    sums = counts.groupBy("task").agg(*[F.sum(n(k)).alias(f"__all{k}") for k in levels], *[x for i, j in pairs for x in (F.sum(f"__t{i}_{j}").alias(f"__t{i}_{j}"), F.sum(n(j) * F.col(f"__below{i}")).alias(f"__up{i}_{j}"), F.sum(n(j) * n(i)).alias(f"__eq{i}_{j}"))])
    each = [F.struct(F.lit(i).alias("lower"), F.lit(j).alias("higher"), (F.col(f"__up{i}_{j}") + F.col(f"__t{i}_{j}")).alias("correct"), F.col(f"__up{i}_{j}").alias("up"), F.col(f"__eq{i}_{j}").alias("equal"), (F.col(f"__all{i}") * F.col(f"__all{j}")).alias("total")) for i, j in pairs]
    return sums.select("task", F.explode(F.array(*each)).alias("p")).select("task", "p.*").where("total > 0")


def _ranked(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", quality_rank(F.col("quality_label"))).where("rank > 0")


def ranking_accuracy(df: DataFrame, strict: bool = False) -> DataFrame:
    """correct, total and accuracy by pair of labels."""
    names = F.create_map(*[F.lit(x) for name, rank in QUALITY_RANK.items() for x in (rank, name)])
    sums = ranking_pairs(_ranked(df), "rank", strict).groupBy("lower", "higher").agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"))
    return sums.select(names[F.col("lower")].alias("lower"), names[F.col("higher")].alias("higher"), "correct", "total", (F.col("correct") / F.col("total")).alias("accuracy"))


def ranking_by_task(df: DataFrame) -> DataFrame:
    """Per task of two labels or more: tau over all picks, tau of the label means, pair counts, differences of means.

    Tau over the full product of one reward of each label is the mean over label pairs of
    the mean sign of the reward difference, by linearity: no product of three labels.
    """
    sign = (2 * F.col("up") + F.col("equal") - F.col("total")) / F.col("total")
    tau = ranking_pairs(_ranked(df), "rank").groupBy("task").agg(F.avg(sign).alias("tau"), F.sum("correct").alias("correct_pairs"), F.sum("total").alias("total_pairs"))
    means = df.where("reward is not null").groupBy("task").agg(*[F.avg(F.when(F.col("quality_label") == q, F.col("reward"))).alias(q) for q in QUALITY_RANK])
    signs = [F.signum(F.col(b) - F.col(a)) for a, b in (("failure", "suboptimal"), ("suboptimal", "successful"), ("failure", "successful"))]
    some = F.filter(F.array(*signs), lambda x: x.isNotNull())
    means = means.withColumn("tau_of_means", F.aggregate(some, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(some), F.lit(0)))
    diffs = {"succ_subopt": ("successful", "suboptimal"), "subopt_fail": ("suboptimal", "failure"), "succ_fail": ("successful", "failure")}
    means = means.select("task", "tau_of_means", *[(F.col(a) - F.col(b)).alias(n) for n, (a, b) in diffs.items()])
    return tau.join(means, "task")


def partial_success_ranking(df: DataFrame) -> DataFrame:
    """Per task: pairs of different partial success in the order of their rewards, correct and in all, and tau of the mean rewards of three bins.

    Equal rewards count as in ``ranking_pairs``.  The bins are thirds of 0 .. 1; fewer than two of them: null.
    """
    rows = df.where("partial_success is not null")
    # Along (reward, id), an equal reward counts as right if the lower partial success has the smaller id.
    along = F.when(F.col("reward").isNotNull(), F.struct("reward", "id"))
    pairs = dominated_pairs(rows, ["task"], "partial_success", along).where("total > 0").select("task", F.col("up").alias("correct"), "total")
    bin_ = F.when(F.col("partial_success") < 1 / 3, 0).when(F.col("partial_success") < 2 / 3, 1).otherwise(2)
    means = rows.groupBy("task").agg(*[F.avg(F.when(bin_ == k, F.col("reward"))).alias(f"b{k}") for k in range(3)])
    signs = F.filter(F.array(*[F.signum(F.col(f"b{j}") - F.col(f"b{i}")) for i, j in ((0, 1), (1, 2), (0, 2))]), lambda x: x.isNotNull())
    tau = F.aggregate(signs, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(signs), F.lit(0))
    return pairs.join(means.select("task", tau.alias("bin_tau")), "task")


def average_ranks(df: DataFrame, by: list[str], value: str, to: str) -> DataFrame:
    """Adds the mean rank of equal values within each group."""
    w = Window.partitionBy(*by)
    return df.withColumn(to, F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2)


def correlation(x: str, y: str) -> Column:
    """Pearson correlation; null for a constant series or fewer than two rows."""
    return F.when(F.count(x) > 1, F.nanvl(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(None).cast("double")))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Correlation of average ranks; null for a constant series or fewer than two rows."""
    ranked = average_ranks(average_ranks(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), by, x, "__rx"), by, y, "__ry")
    return ranked.groupBy(*by).agg(correlation("__rx", "__ry").alias("spearman"), F.count(F.lit(1)).alias("n"))


def pearson(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*by).agg(correlation(x, y).alias("pearson"), F.count(F.lit(1)).alias("n"))


def tau_a(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(concordant - discordant) / (n (n - 1) / 2) per group; ties add nothing.  Null for fewer than two rows."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    sums = dominated_pairs(rows, by, x, F.col(y)).select(*by, (2 * F.col("up") + F.col("equal") - F.col("total")).alias("__s"))
    n = F.col("__n")
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    return sizes.join(sums, by, "left").select(*by, F.when(n > 1, F.coalesce("__s", F.lit(0)) / (n * (n - 1) / 2)).alias("tau_a"))


def average_precision(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Step average precision over distinct thresholds; 0 if a group has one class."""
    at = df.groupBy(*by, score).agg(F.sum(label).alias("tp"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = at.withColumn("ctp", F.sum("tp").over(w)).withColumn("cn", F.sum("n").over(w))
    out = cum.groupBy(*by).agg(F.sum(F.col("tp") * F.col("ctp") / F.col("cn")).alias("s"), F.sum("tp").alias("p"), F.sum("n").alias("n"))
    return out.select(*by, F.when((F.col("p") == 0) | (F.col("p") == F.col("n")), 0.0).otherwise(F.col("s") / F.nullif(F.col("p"), F.lit(0))).alias("average_precision"))


def roc_auc(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """By the rank sum, from counts of equal scores; 0.5 if a group has one class."""
    at = df.groupBy(*by, score).agg(F.sum(label).alias("p"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = at.withColumn("rank", before + (F.col("n") + 1) / 2).groupBy(*by).agg(F.sum(F.col("rank") * F.col("p")).alias("s"), F.sum("p").alias("p"), (F.sum("n") - F.sum("p")).alias("q"))
    return r.select(*by, F.coalesce(F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")), F.lit(0.5)).alias("auc"))


def class_accuracy(df: DataFrame, by: list[str], probability: str, label: str) -> DataFrame:
    """Accuracy of probability > 0.5 on rows of label 1 and of label 0, and their mean; null for an absent class."""
    hit = ((F.col(probability) > 0.5) == (F.col(label) == 1)).cast("double")
    pos, neg = F.avg(F.when(F.col(label) == 1, hit)), F.avg(F.when(F.col(label) == 0, hit))
    return df.groupBy(*by).agg(pos.alias("positive"), neg.alias("negative"), ((pos + neg) / 2).alias("balanced"))


def confusion(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """(row, column, value) over the square of all labels, the mean value or 0."""
    labels = df.select(F.col(row).alias("l")).union(df.select(F.col(column).alias("l"))).distinct()
    cells = df.groupBy(F.col(row).alias("r"), F.col(column).alias("c")).agg(F.avg(value).alias("v"))
    # The labels are a short list of sampled tasks by design.
    square = labels.select(F.col("l").alias("r")).crossJoin(F.broadcast(labels.select(F.col("l").alias("c"))))
    return square.join(cells, ["r", "c"], "left").select(F.col("r").alias("row"), F.col("c").alias("column"), F.coalesce("v", F.lit(0.0)).alias("value"))


def trace_metrics(matrix: DataFrame, *by: str) -> DataFrame:
    """Size, trace, off-diagonal sum, their difference and the means, of (row, column, value)."""
    on = F.col("row") == F.col("column")
    n = F.count_distinct("row")
    trace, off = F.sum(F.when(on, F.col("value")).otherwise(0.0)), F.sum(F.when(on, 0.0).otherwise(F.col("value")))
    return matrix.groupBy(*by).agg(
        n.alias("size"), trace.alias("trace"), off.alias("off_diagonal"), (trace - off).alias("difference"), (trace / n).alias("mean_trace"), F.try_divide(off, n * (n - 1)).alias("mean_off_diagonal")
    )


def similarity_scores(df: DataFrame) -> DataFrame:
    """Per task: wins and margin, first over the negatives of each pair, then over the pairs."""
    margin = F.col("sim_score_ref_sim") - F.col("sim_score_ref_diff")
    per_pair = df.groupBy("task", "human_id", "robot_id").agg(F.avg((margin > 0).cast("double")).alias("win"), F.avg(margin).alias("margin"))
    return per_pair.groupBy("task").agg(F.avg("win").alias("win"), F.avg("margin").alias("margin"), F.count(F.lit(1)).alias("pairs"))


def macro_mean(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(*[F.avg(c).alias(c) for c in columns])


def stratified_means(df: DataFrame, value: str, mask: Column, *strata: str) -> DataFrame:
    """(stratum, key, mean, n): means of values that are numbers, under the mask, by each stratum on its own."""
    rows = df.where(mask).withColumn("__v", F.nanvl(F.col(value), F.lit(None).cast("double")))
    kind = F.array(*[F.struct(F.lit(s).alias("stratum"), F.col(s).cast("string").alias("key")) for s in strata])
    return rows.select(F.explode(kind).alias("s"), "__v").groupBy("s.stratum", "s.key").agg(F.avg("__v").alias("mean"), F.count("__v").alias("n"))


def reduce_metrics(df: DataFrame, missing_as_zero: bool = False) -> DataFrame:
    """(metric, sum, mean) over ranks of (rank, metric, value); missing and NaN values count as 0 in the mean, or not at all."""
    v = F.when(F.isnan("value") | (F.abs("value") == float("inf")), None).otherwise(F.col("value"))
    out = df.withColumn("v", v).groupBy("metric").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("sum"), F.avg("v").alias("mean"))
    if not missing_as_zero:
        return out
    ranks = df.agg(F.count_distinct("rank").alias("ranks"))  # one row
    return out.crossJoin(F.broadcast(ranks)).select("metric", "sum", (F.col("sum") / F.col("ranks")).alias("mean"))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def held(x: Column) -> Column:
    """A score within -50 .. 50."""
    return F.least(F.greatest(x, F.lit(-50.0)), F.lit(50.0))


def preference_loss(logit: Column, label: Column) -> Column:
    """Binary cross-entropy with logits, which are held to -50 .. 50."""
    return softplus(held(logit)) - held(logit) * label


def similarity_margin(sim: Column, diff: Column) -> Column:
    return held(sim) - held(diff)


def similarity_loss(sim: Column, diff: Column, beta: float) -> Column:
    """softplus of the negative margin times beta; both scores and the product are held to -50 .. 50."""
    return softplus(-held(beta * similarity_margin(sim, diff)))


def leaderboard(df: DataFrame, models: list[str]) -> DataFrame:
    """(block, dataset, one column a model) of (model, block, dataset, value), with a mean row (null dataset) a block."""
    means = df.groupBy("model", "block").agg(F.avg("value").alias("value")).withColumn("dataset", F.lit(None).cast("string"))
    return df.select("model", "block", "dataset", "value").unionByName(means).groupBy("block", "dataset").pivot("model", models).agg(F.first("value"))


def top_by_score(df: DataFrame, by: list[str], k: int, metrics: dict[str, int]) -> DataFrame:
    """The k best rows of each group by the mean of the signed metrics that are there; none: last.  Adds score."""
    parts = F.filter(F.array(*[F.col(m) * s for m, s in metrics.items()]), lambda x: x.isNotNull())
    score = F.coalesce(F.try_divide(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), F.size(parts)), F.lit(float("-inf")))
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "step")
    return df.withColumn("score", score).withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= k).drop("__k")
