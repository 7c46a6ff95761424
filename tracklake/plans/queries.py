"""Queries over the test tables by name, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklake.functions import frames as fr
from tracklake.functions import text as tx
from tracklake.functions.draws import draw
from tracklake.operators import curate, metrics, pairs, samples, sampling
from tracklake.plans.canonical import FRAMES, TRAJ, frames, table, trajectories

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column) -> Column:
    return F.round(c, 6)


def _joined(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# ---- ranking and preference ------------------------------------------------------------

_PAIRS = f"""WITH {TRAJ}, p AS (SELECT a.task, a.id lo_id, b.id hi_id, a.quality_label lo, b.quality_label hi, a.reward lo_r, b.reward hi_r
 FROM traj a JOIN traj b ON a.task = b.task AND a.rank < b.rank)"""
_OK = "(hi_r > lo_r OR (hi_r = lo_r AND lo_id < hi_id))"
#: Few tasks and few rewards: most of the pairs are tied.
_TIED = f"{TRAJ}, t AS (SELECT id, rank, CAST(CAST(task AS BIGINT) % 20 AS VARCHAR) AS task, floor(reward / 20000) AS reward FROM traj)"


@query(f"{_PAIRS} SELECT lo AS lower, hi AS higher, CAST(sum(CASE WHEN {_OK} THEN 1 ELSE 0 END) AS BIGINT) AS correct, count(*) AS total, round(avg(CASE WHEN {_OK} THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p GROUP BY 1, 2")
def policy_ranking_pair_accuracy(spark, d):
    return metrics.ranking_accuracy(trajectories(spark, d)).withColumn("accuracy", r6(F.col("accuracy")))


@query(f"""{_PAIRS}, q AS (SELECT task, lo, hi, avg(sign(hi_r - lo_r)) s, sum(CASE WHEN {_OK} THEN 1 ELSE 0 END) c, count(*) n FROM p GROUP BY 1, 2, 3),
 t AS (SELECT task, avg(s) tau, sum(c) c, sum(n) n FROM q GROUP BY 1),
 m AS (SELECT task, avg(reward) FILTER (rank = 1) f, avg(reward) FILTER (rank = 2) o, avg(reward) FILTER (rank = 3) s FROM traj GROUP BY 1)
 SELECT task, round(tau, 6) AS tau, CAST(c AS BIGINT) AS correct_pairs, CAST(n AS BIGINT) AS total_pairs,
 round((coalesce(sign(o - f), 0) + coalesce(sign(s - o), 0) + coalesce(sign(s - f), 0)) / (CASE WHEN f IS NULL OR o IS NULL OR s IS NULL THEN 1 ELSE 3 END), 6) AS tau_of_means,
 round(s - o, 4) AS succ_subopt, round(o - f, 4) AS subopt_fail, round(s - f, 4) AS succ_fail FROM t JOIN m USING (task)""")
def policy_ranking_by_task(spark, d):
    t = metrics.ranking_by_task(trajectories(spark, d))
    return t.select("task", r6(F.col("tau")).alias("tau"), "correct_pairs", "total_pairs", r6(F.col("tau_of_means")).alias("tau_of_means"), *[F.round(c, 4).alias(c) for c in ("succ_subopt", "subopt_fail", "succ_fail")])


@query(f"""WITH {TRAJ}, p AS (SELECT a.task, CAST(sum(CASE WHEN b.reward > a.reward OR (b.reward = a.reward AND a.id < b.id) THEN 1 ELSE 0 END) AS BIGINT) AS correct, count(*) AS total
 FROM traj a JOIN traj b ON a.task = b.task AND a.partial_success < b.partial_success GROUP BY 1),
 m AS (SELECT task, least(CAST(floor(partial_success * 3 + 1e-9) AS INT), 2) AS bin, avg(reward) AS r FROM traj GROUP BY 1, 2),
 s AS (SELECT a.task, avg(sign(b.r - a.r)) AS bin_tau FROM m a JOIN m b ON a.task = b.task AND a.bin < b.bin GROUP BY 1) SELECT task, correct, total, round(bin_tau, 6) AS bin_tau FROM p LEFT JOIN s USING (task)""")
def partial_success_ranking(spark, d):
    return metrics.partial_success_ranking(trajectories(spark, d)).withColumn("bin_tau", r6(F.col("bin_tau")))


@query(f"""WITH {_TIED}, p AS (SELECT a.task, a.id lo_id, b.id hi_id, a.reward lo_r, b.reward hi_r FROM t a JOIN t b ON a.task = b.task AND a.rank < b.rank)
 SELECT task, CAST(sum(CASE WHEN {_OK} THEN 1 ELSE 0 END) AS BIGINT) AS correct, CAST(sum(CASE WHEN hi_r > lo_r THEN 1 ELSE 0 END) AS BIGINT) AS strict, count(*) AS total FROM p GROUP BY 1""")
def ranking_with_ties(spark, d):
    t = trajectories(spark, d).withColumns({"task": (F.col("task").cast("bigint") % 20).cast("string"), "reward": F.floor(F.col("reward") / 20000).cast("double")})
    return metrics.ranking_pairs(metrics._ranked(t), "rank").groupBy("task").agg(F.sum("correct").alias("correct"), F.sum("up").alias("strict"), F.sum("total").alias("total"))


def _preferences(spark, d):
    t = table(spark, d, "lineitem")
    return t.select("l_returnflag", F.when(F.col("l_quantity") > 5, (F.col("l_discount") > 0.05).cast("int")).alias("prediction"), (F.col("l_tax") > 0.04).cast("int").alias("label"))


@query("""WITH p AS (SELECT l_returnflag, CASE WHEN l_quantity > 5 THEN CAST(l_discount > 0.05 AS INT) END AS prediction, CAST(l_tax > 0.04 AS INT) AS label FROM lineitem)
 SELECT l_returnflag, CAST(coalesce(sum(CAST(prediction = label AS INT)), 0) AS BIGINT) AS correct, count(prediction) AS total, count(*) - count(prediction) AS skipped, round(avg(CAST(prediction = label AS INT)), 6) AS accuracy FROM p GROUP BY 1""")
def preference_accuracy(spark, d):
    return metrics.preference_accuracy(_preferences(spark, d), "l_returnflag").withColumn("accuracy", r6(F.col("accuracy")))


@query(f"""WITH {TRAJ} SELECT CASE WHEN a.quality_label < b.quality_label THEN a.quality_label ELSE b.quality_label END AS one, CASE WHEN a.quality_label < b.quality_label THEN b.quality_label ELSE a.quality_label END AS two,
 count(*) AS pairs, round(avg(CAST(a.reward > b.reward AS INT)), 6) AS accuracy FROM traj a JOIN traj b ON a.task = b.task AND a.rank > b.rank AND a.is_robot AND b.is_robot GROUP BY 1, 2""")
def preference_accuracy_by_quality(spark, d):
    p = pairs.quality_pairs(trajectories(spark, d))
    combo = F.array_sort(F.array("chosen_quality_label", "rejected_quality_label"))
    return p.groupBy(combo[0].alias("one"), combo[1].alias("two")).agg(F.count(F.lit(1)).alias("pairs"), r6(F.avg((F.col("chosen_reward") > F.col("rejected_reward")).cast("int"))).alias("accuracy"))


@query(f"""WITH {TRAJ}, {FRAMES}, s AS (SELECT id, arg_max(value, frame_idx) AS last, avg(value) AS mean, sum(value) AS total FROM fr GROUP BY 1)
 SELECT id, round(last, 6) AS reward_last, round(total, 4) AS reward_sum, round(mean, 6) AS reward_average FROM s""")
def trajectory_rewards(spark, d):
    s = frames(spark, d).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "value"))).alias("f"))
    p = F.transform("f", lambda x: x["value"])
    return s.select("id", r6(metrics.trajectory_reward(p, "last")).alias("reward_last"), F.round(metrics.trajectory_reward(p, "sum"), 4).alias("reward_sum"), r6(metrics.trajectory_reward(p, "average")).alias("reward_average"))


# ---- correlations and classification metrics ---------------------------------------------


@query(f"WITH {TRAJ}, t AS (SELECT * FROM traj WHERE num_frames IS NOT NULL) SELECT data_source, round(corr(num_frames, reward), 6) AS pearson, count(*) AS n FROM t GROUP BY 1")
def pearson_by_source(spark, d):
    return metrics.pearson(trajectories(spark, d).where("num_frames is not null"), ["data_source"], "num_frames", "reward").withColumn("pearson", r6(F.col("pearson")))


@query(f"""WITH {TRAJ}, r AS (SELECT task, rank() OVER (PARTITION BY task ORDER BY partial_success) + (count(*) OVER (PARTITION BY task, partial_success) - 1) / 2.0 AS x,
 rank() OVER (PARTITION BY task ORDER BY reward) + (count(*) OVER (PARTITION BY task, reward) - 1) / 2.0 AS y FROM traj),
 s AS (SELECT task, CASE WHEN count(*) > 1 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END AS c, count(*) AS n FROM r GROUP BY 1) SELECT task, round(c, 6) AS spearman, n FROM s""")
def spearman_by_task(spark, d):
    return metrics.spearman(trajectories(spark, d), ["task"], "partial_success", "reward").withColumn("spearman", r6(F.col("spearman")))


@query(f"WITH {TRAJ}, p AS (SELECT a.task, sum(sign(a.partial_success - b.partial_success) * sign(a.reward - b.reward)) / count(*) AS t FROM traj a JOIN traj b ON a.task = b.task AND a.id < b.id GROUP BY 1) SELECT task, round(t, 6) AS tau_a FROM (SELECT DISTINCT task FROM traj) LEFT JOIN p USING (task)")
def kendall_tau_a(spark, d):
    return metrics.tau_a(trajectories(spark, d), ["task"], "partial_success", "reward").withColumn("tau_a", r6(F.col("tau_a")))


_SCORED = "s AS (SELECT l_returnflag AS g, l_quantity / 50 AS score, CAST(l_discount > 0.05 AS INT) AS y FROM lineitem)"


def _scored(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_quantity") / 50).alias("score"), (F.col("l_discount") > 0.05).cast("int").alias("y"))


@query(f"""WITH {_SCORED}, a AS (SELECT g, score, sum(y) tp, count(*) n FROM s GROUP BY 1, 2),
 c AS (SELECT g, tp, n, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM a WINDOW w AS (PARTITION BY g ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
 SELECT g, round(CASE WHEN sum(tp) = 0 OR sum(tp) = sum(n) THEN 0 ELSE sum(tp * ctp / cn) / sum(tp) END, 6) AS average_precision FROM c GROUP BY 1""")
def average_precision(spark, d):
    return metrics.average_precision(_scored(spark, d), ["g"], "score", "y").withColumn("average_precision", r6(F.col("average_precision")))


@query(f"""WITH {_SCORED}, a AS (SELECT g, score, sum(y) p, count(*) n FROM s GROUP BY 1, 2), r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY g ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS rk FROM a),
 t AS (SELECT g, sum(rk * p) s, sum(p) p, sum(n) - sum(p) q FROM r GROUP BY 1) SELECT g, round(coalesce((s - p * (p + 1) / 2.0) / nullif(p * q, 0), 0.5), 6) AS auc FROM t""")
def roc_auc(spark, d):
    return metrics.roc_auc(_scored(spark, d), ["g"], "score", "y").withColumn("auc", r6(F.col("auc")))


@query(f"""WITH {_SCORED} SELECT g, round(avg(CAST(score > 0.5 AS INT)) FILTER (y = 1), 6) AS positive, round(avg(CAST(score <= 0.5 AS INT)) FILTER (y = 0), 6) AS negative,
 round((avg(CAST(score > 0.5 AS INT)) FILTER (y = 1) + avg(CAST(score <= 0.5 AS INT)) FILTER (y = 0)) / 2, 6) AS balanced FROM s GROUP BY 1""")
def success_class_accuracy(spark, d):
    m = metrics.class_accuracy(_scored(spark, d), ["g"], "score", "y")
    return m.select("g", *[r6(F.col(c)).alias(c) for c in ("positive", "negative", "balanced")])


@query(f"WITH {_SCORED} SELECT g, round(avg(abs(score - y)), 6) AS mae, round(avg((score - y) * (score - y)), 6) AS mse, round(avg(CAST(CAST(round_even(score * 4, 0) AS INT) = y * 4 AS INT)), 6) AS bin_accuracy FROM s GROUP BY 1")
def error_metrics(spark, d):
    s = _scored(spark, d)
    e = F.col("score") - F.col("y")
    return s.groupBy("g").agg(r6(F.avg(F.abs(e))).alias("mae"), r6(F.avg(e * e)).alias("mse"), r6(F.avg((fr.discrete_bin(F.col("score"), 5) == F.col("y") * 4).cast("int"))).alias("bin_accuracy"))


_CELLS = """x AS (SELECT a.event_type AS lang, b.event_type AS video, a.value AS v FROM events a JOIN events b ON a.event_id + 1 = b.event_id)"""


def _cells(spark, d):
    e = table(spark, d, "events")
    b = e.select((F.col("event_id") - 1).alias("event_id"), F.col("event_type").alias("video"))
    return e.join(b, "event_id").select(F.col("event_type").alias("lang"), "video", F.col("value").alias("v"))


@query(f"""WITH {_CELLS}, l AS (SELECT lang AS l FROM x UNION SELECT video FROM x), c AS (SELECT lang, video, avg(v) v FROM x GROUP BY 1, 2)
 SELECT a.l AS "row", b.l AS "column", round(coalesce(c.v, 0), 6) AS value FROM l a CROSS JOIN l b LEFT JOIN c ON c.lang = a.l AND c.video = b.l""")
def confusion_matrix(spark, d):
    return metrics.confusion(_cells(spark, d), "lang", "video", "v").withColumn("value", r6(F.col("value")))


@query(f"""WITH {_CELLS}, l AS (SELECT lang AS l FROM x UNION SELECT video FROM x), c AS (SELECT lang, video, avg(v) v FROM x GROUP BY 1, 2),
 m AS (SELECT a.l r, b.l k, coalesce(c.v, 0) v FROM l a CROSS JOIN l b LEFT JOIN c ON c.lang = a.l AND c.video = b.l),
 t AS (SELECT count(DISTINCT r) n, sum(CASE WHEN r = k THEN v ELSE 0 END) t, sum(CASE WHEN r = k THEN 0 ELSE v END) o FROM m)
 SELECT n AS size, round(t, 4) AS trace, round(o, 4) AS off_diagonal, round(t - o, 4) AS difference, round(t / n, 4) AS mean_trace, round(o / (n * (n - 1)), 4) AS mean_off_diagonal FROM t""")
def confusion_trace(spark, d):
    m = metrics.trace_metrics(metrics.confusion(_cells(spark, d), "lang", "video", "v"))
    return m.select("size", *[F.round(c, 4).alias(c) for c in m.columns[1:]])


@query("""WITH x AS (SELECT p_brand AS task, s_nationkey AS human_id, l_linenumber AS robot_id, l_discount - l_tax AS m FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
 a AS (SELECT task, human_id, robot_id, avg(CAST(m > 0 AS INT)) w, avg(m) m FROM x GROUP BY 1, 2, 3) SELECT task, round(avg(w), 6) AS win, round(avg(m), 6) AS margin, count(*) AS pairs FROM a GROUP BY 1""")
def similarity_score(spark, d):
    li, p, s = table(spark, d, "lineitem"), table(spark, d, "part"), table(spark, d, "supplier")
    x = li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey)
    x = x.select(F.col("p_brand").alias("task"), F.col("s_nationkey").alias("human_id"), F.col("l_linenumber").alias("robot_id"), F.col("l_discount").alias("sim_score_ref_sim"), F.col("l_tax").alias("sim_score_ref_diff"))
    return metrics.similarity_scores(x).select("task", r6(F.col("win")).alias("win"), r6(F.col("margin")).alias("margin"), "pairs")


@query(f"""WITH {FRAMES}, t AS (SELECT id, count(*) n FROM fr GROUP BY 1), p AS (SELECT fr.id, value, (frame_idx + 1.0) / n AS target FROM fr JOIN t USING (id))
 SELECT id, round(avg((value / 100 - target) * (value / 100 - target)), 6) AS mse, round(coalesce(corr(value, target), 0), 6) AS pearson, count(*) AS frames FROM p GROUP BY 1""")
def reward_alignment(spark, d):
    w = Window.partitionBy("id")
    p = frames(spark, d).withColumn("target", (F.col("frame_idx") + 1) / F.count(F.lit(1)).over(w))
    e = F.col("value") / 100 - F.col("target")
    return p.groupBy("id").agg(r6(F.avg(e * e)).alias("mse"), r6(F.coalesce(metrics.correlation("value", "target"), F.lit(0.0))).alias("pearson"), F.count(F.lit(1)).alias("frames"))


@query("""SELECT 'returnflag' AS stratum, l_returnflag AS key, round(avg(l_tax), 6) AS mean, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY 2
 UNION ALL SELECT 'linestatus', l_linestatus, round(avg(l_tax), 6), count(*) FROM lineitem WHERE l_quantity > 10 GROUP BY 2""")
def stratified_means(spark, d):
    li = table(spark, d, "lineitem").select("l_tax", "l_quantity", F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"))
    return metrics.stratified_means(li, "l_tax", F.col("l_quantity") > 10, "returnflag", "linestatus").withColumn("mean", r6(F.col("mean")))


@query("""WITH m AS (SELECT n_regionkey AS rank, c_mktsegment AS metric, avg(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
 SELECT metric, round(sum(v), 4) AS sum, round(avg(v), 4) AS mean FROM m GROUP BY 1""")
def reduce_metrics(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    m = c.join(n, c.c_nationkey == n.n_nationkey).groupBy(F.col("n_regionkey").alias("rank"), F.col("c_mktsegment").alias("metric")).agg(F.avg("c_acctbal").alias("value"))
    return metrics.reduce_metrics(m).select("metric", F.round("sum", 4).alias("sum"), F.round("mean", 4).alias("mean"))


@query("""WITH m AS (SELECT o_orderpriority AS model, c_mktsegment AS dataset, CASE WHEN c_mktsegment < 'F' THEN 'id' ELSE 'ood' END AS block, avg(o_totalprice) v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
 u AS (SELECT * FROM m UNION ALL SELECT model, NULL, block, avg(v) FROM m GROUP BY model, block)
 SELECT block, dataset, round(max(v) FILTER (model = '1-URGENT'), 4) AS m1, round(max(v) FILTER (model = '2-HIGH'), 4) AS m2 FROM u GROUP BY 1, 2""")
def leaderboard(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    m = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("o_orderpriority").alias("model"), F.col("c_mktsegment").alias("dataset")).agg(F.avg("o_totalprice").alias("value"))
    m = m.withColumn("block", F.when(F.col("dataset") < "F", "id").otherwise("ood"))
    b = metrics.leaderboard(m, ["1-URGENT", "2-HIGH"])
    return b.select("block", "dataset", F.round("1-URGENT", 4).alias("m1"), F.round("2-HIGH", 4).alias("m2"))


@query("""WITH s AS (SELECT s_nationkey, s_suppkey AS step, s_acctbal AS score FROM supplier) SELECT s_nationkey, step, round(score, 4) AS score FROM s QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY score DESC, step) <= 3""")
def top_checkpoints(spark, d):
    s = table(spark, d, "supplier").select("s_nationkey", F.col("s_suppkey").alias("step"), F.col("s_acctbal").alias("metric"))
    return metrics.top_by_score(s, ["s_nationkey"], 3, {"metric": 1}).select("s_nationkey", "step", F.round("score", 4).alias("score"))


@query("""SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY 1""")
def latency_summary(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    p = curate.percentiles(li, "l_returnflag", "l_extendedprice", {"p50": 0.5, "p90": 0.9, "p95": 0.95})
    return p.join(li.groupBy("l_returnflag").agg(F.round(F.avg("l_extendedprice"), 4).alias("mean")), "l_returnflag").select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("p50", "p90", "p95")], "mean")


@query("""SELECT l_returnflag, round(avg(greatest(x, 0) + ln(1 + exp(-abs(x))) - x * y), 6) AS preference_loss, round(avg(greatest(-z, 0) + ln(1 + exp(-abs(z)))), 6) AS similarity_loss, round(avg(1 / (1 + exp(-x))), 6) AS probability
 FROM (SELECT l_returnflag, (l_quantity - 25) / 10 AS x, CAST(l_tax > 0.04 AS INT) AS y, 2 * (l_discount - l_tax) AS z FROM lineitem) GROUP BY 1""")
def losses(spark, d):
    li = table(spark, d, "lineitem")
    x, y = (F.col("l_quantity") - 25) / 10, (F.col("l_tax") > 0.04).cast("int")
    return li.groupBy("l_returnflag").agg(
        r6(F.avg(metrics.preference_loss(x, y))).alias("preference_loss"), r6(F.avg(metrics.similarity_loss(F.col("l_discount"), F.col("l_tax"), 2.0))).alias("similarity_loss"), r6(F.avg(metrics.sigmoid(x))).alias("probability")
    )


# ---- curation ----------------------------------------------------------------------------


@query(f"""WITH {TRAJ} SELECT CASE WHEN task LIKE '%13%' THEN 'keyword' WHEN num_frames <= 2 THEN 'frames' WHEN quality_label NOT IN ('successful', 'failure') THEN 'label' ELSE 'kept' END AS reason, count(*) AS n FROM traj GROUP BY 1""")
def filter_reasons(spark, d):
    return curate.count_reasons(trajectories(spark, d), keywords=["13"], min_frames=2, labels=["successful", "failure"])


@query(f"""WITH {TRAJ} SELECT id, task FROM traj WHERE NOT task LIKE '%7%' AND coalesce(num_frames, 99) > 2 AND quality_label IN ('successful')""")
def filter_rows(spark, d):
    return curate.filter_rows(trajectories(spark, d), keywords=["7"], min_frames=2, labels=["successful"]).select("id", "task")


@query(f"""WITH {TRAJ}, t AS (SELECT * REPLACE (CASE WHEN partial_success > 0.5 THEN NULL ELSE partial_success END AS partial_success) FROM traj)
 SELECT id, task FROM t WHERE partial_success IS NOT NULL OR task IN (SELECT task FROM t WHERE quality_label = 'successful')""")
def task_filter(spark, d):
    t = trajectories(spark, d).withColumn("partial_success", F.when(F.col("partial_success") <= 0.5, F.col("partial_success")))
    return curate.keep_tasks_with_success(t).select("id", "task")


@query(f"""WITH {TRAJ}, g AS (SELECT task FROM traj GROUP BY 1 HAVING bool_or(rank = 3) AND bool_or(rank = 1)) SELECT id, task, quality_label FROM traj WHERE task IN (SELECT task FROM g)""")
def mixed_tasks(spark, d):
    return curate.keep_mixed_tasks(trajectories(spark, d)).select("id", "task", "quality_label")


@query(f"""WITH {TRAJ} SELECT data_source, count(num_frames) AS n, CAST(sum(num_frames) AS BIGINT) AS total, min(num_frames) AS least, max(num_frames) AS most, round(avg(num_frames), 6) AS mean,
 quantile_cont(num_frames, 0.5) AS median, round(stddev_pop(num_frames), 6) AS deviation, quantile_cont(num_frames, 0.25) AS q25, quantile_cont(num_frames, 0.75) AS q75 FROM traj GROUP BY 1""")
def frame_statistics(spark, d):
    return curate.frame_statistics(trajectories(spark, d), "data_source").withColumns({c: r6(F.col(c)) for c in ("mean", "deviation")})


@query(f"""WITH {TRAJ} SELECT data_source, quality_label, count(*) AS n, CAST(sum(num_frames) AS BIGINT) AS frames, round(sum(num_frames) / count(num_frames), 6) AS mean_frames FROM traj GROUP BY ROLLUP (data_source, quality_label)""")
def trajectory_counts(spark, d):
    return curate.rolled_counts(trajectories(spark, d), "data_source", "quality_label").withColumn("mean_frames", r6(F.col("mean_frames")))


@query(f"""WITH {TRAJ}, s AS (SELECT data_source, strftime(o_orderdate, '%Y') AS year FROM traj JOIN orders ON id = o_orderkey), c AS (SELECT data_source, count(*) n FROM s WHERE year = '1995' GROUP BY 1)
 SELECT data_source, n, row_number() OVER (ORDER BY n DESC NULLS LAST, data_source) AS place FROM (SELECT DISTINCT data_source FROM s) LEFT JOIN c USING (data_source)""")
def counts_missing_last(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    t = trajectories(spark, d)
    s = t.join(o, t.id == o.o_orderkey).select("data_source", "year")
    c = s.where("year = 1995").groupBy("data_source").agg(F.count(F.lit(1)).alias("n"))
    # The sources are a short list of names.
    return s.select("data_source").distinct().join(c, "data_source", "left").withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("n"), "data_source")).cast("bigint"))


@query("""SELECT p_partkey AS id, 'error' AS level, 'partial_success is out of range' AS problem FROM part WHERE p_size > 40
 UNION ALL SELECT p_partkey, 'warning', 'quality_label is unknown' FROM part WHERE p_brand NOT IN ('successful') AND p_size % 2 = 0""")
def schema_violations(spark, d):
    p = table(spark, d, "part")
    return curate.violations(p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("failure").alias("quality_label"), (F.col("p_size") / 40).alias("partial_success")))


@query(f"""WITH {TRAJ} SELECT 'data_source' AS kind, data_source AS key, count(*) AS n, min(id) AS first FROM traj GROUP BY 2 UNION ALL SELECT 'quality_label', quality_label, count(*), min(id) FROM traj GROUP BY 2""")
def inverted_indices(spark, d):
    i = curate.inverted_index(trajectories(spark, d), "data_source", "quality_label")
    return i.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


@query(f"""WITH {FRAMES}, a AS (SELECT id, frame_idx, value, floor(value) % 2 AS grip FROM fr), b AS (SELECT *, lag(grip) OVER (PARTITION BY id ORDER BY frame_idx) AS g FROM a)
 SELECT id, frame_idx, (abs(value) < 20 AND (g IS NULL OR g = grip)) AS is_noop FROM b""")
def noop_actions(spark, d):
    a = frames(spark, d).select("id", "frame_idx", F.array("value").alias("motion"), (F.floor("value") % 2).alias("grip"))
    return curate.noop_frames(a, "id", ["frame_idx"], "motion", "grip", 20.0).select("id", "frame_idx", "is_noop")


@query(f"""WITH {TRAJ}, t AS (SELECT *, CASE WHEN id % 4 = 0 THEN 'rewind' ELSE 'forward' END AS s FROM traj) SELECT data_source, CAST(sum(CASE WHEN data_source = 'BUILDING' THEN 0 WHEN quality_label <> 'successful' THEN 0 ELSE 1 END) AS DOUBLE) AS weight FROM t GROUP BY 1""")
def progress_mask(spark, d):
    t = trajectories(spark, d).withColumn("data_gen_strategy", F.when(F.col("id") % 4 == 0, "rewind").otherwise("forward"))
    return t.groupBy("data_source").agg(F.sum(curate.progress_weight(["BUILDING"])).alias("weight"))


# ---- pairs ---------------------------------------------------------------------------------


@query(f"WITH {TRAJ} SELECT a.task, a.id AS chosen_id, b.id AS rejected_id FROM traj a JOIN traj b ON a.task = b.task AND a.rank > b.rank AND a.is_robot AND b.is_robot")
def quality_pairs(spark, d):
    return pairs.quality_pairs(trajectories(spark, d)).select(F.col("chosen_task").alias("task"), "chosen_id", "rejected_id")


@query(f"WITH {TRAJ} SELECT a.task, a.id AS chosen_id, b.id AS rejected_id FROM traj a JOIN traj b ON a.task = b.task AND a.partial_success > b.partial_success AND a.is_robot AND b.is_robot")
def partial_success_pairs(spark, d):
    return pairs.partial_success_pairs(trajectories(spark, d)).select(F.col("chosen_task").alias("task"), "chosen_id", "rejected_id")


@query(f"WITH {TRAJ} SELECT a.id AS ref_id, b.id AS other_id FROM traj a JOIN traj b ON a.task = b.task AND a.id <> b.id AND abs(a.partial_success - b.partial_success) >= 0.6")
def partial_success_band(spark, d):
    return pairs.partial_success_band(trajectories(spark, d), 0.6).select("ref_id", "other_id")


@query(f"WITH {TRAJ} SELECT task, list_count(list(id) FILTER (is_robot)) AS robots, list_count(list(id) FILTER (NOT is_robot)) AS humans, min(id) FILTER (is_robot) AS robot FROM traj GROUP BY 1 HAVING bool_or(is_robot) AND bool_or(NOT is_robot)")
def paired_tasks(spark, d):
    t = trajectories(spark, d)
    first = pairs.paired_rows(t).where("is_robot").groupBy("task").agg(F.min("id").alias("robot"))
    return pairs.paired_tasks(t).join(first, "task").select("task", "robots", "humans", "robot")


def _hex(*parts: str) -> str:
    """32 bits of the md5 of a seed, a purpose and keys, in SQL."""
    return f"CAST('0x' || left(md5(concat_ws('|', {', '.join(parts)})), 8) AS BIGINT)"


def _u(*parts: str) -> str:
    return f"({_hex(*parts)} / CAST(4294967296 AS DOUBLE))"


def spot(seed: int, purpose: str, id_: str = "id") -> str:
    return _hex(f"'{seed}'", f"'{purpose}-spot'", f"CAST({id_} AS VARCHAR)")


def numbered(pool: str, keys: str, seed: int, purpose: str) -> str:
    return f"""(SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY left(md5(concat_ws('|', '{seed}', '{purpose}', CAST(id AS VARCHAR))), 3), id) - 1 AS place, count(*) OVER (PARTITION BY {keys}) AS n_rows FROM {pool})"""


def picked(name: str, refs: str, pool: str, keys: list[str], seed: int, purpose: str) -> str:
    """CTEs up to ``name`` (ref_id, pick_id): a row of the pool with the ref's keys that is not the ref."""
    by = ", ".join(keys)
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    return f"""{name}_p AS {numbered(pool, by, seed, purpose)}, {name}_z AS (SELECT {by}, max(n_rows) AS n FROM {name}_p GROUP BY {by}),
 {name}_a AS (SELECT r.*, o.place AS own, z.n - CASE WHEN o.id IS NULL THEN 0 ELSE 1 END AS m, {spot(seed, purpose, "r.id")} AS spot FROM {refs} r LEFT JOIN {name}_p o ON o.id = r.id AND {on("o", "r")} LEFT JOIN {name}_z z ON {on("z", "r")}),
 {name} AS (SELECT a.id AS ref_id, p.id AS pick_id FROM {name}_a a LEFT JOIN {name}_p p ON {on("p", "a")} AND m > 0 AND p.place = spot % greatest(m, 1) + CASE WHEN spot % greatest(m, 1) >= own THEN 1 ELSE 0 END)"""


@query(f"WITH {TRAJ}, {picked('x', '(SELECT * FROM traj WHERE rank < 3)', '(SELECT * FROM traj WHERE rank = 3)', ['task'], 7, 'same')} SELECT ref_id, pick_id FROM x")
def same_task_optimal(spark, d):
    t = trajectories(spark, d)
    return samples.pick(t.where("quality_label <> 'successful'"), t.where("quality_label = 'successful'"), ["task"], 7, "same")


@query(f"WITH {TRAJ}, {picked('x', '(SELECT * REPLACE (NOT is_robot AS is_robot) FROM traj)', 'traj', ['task', 'is_robot'], 7, 'opposite')} SELECT ref_id, pick_id FROM x")
def paired_opposite(spark, d):
    t = trajectories(spark, d)
    return samples.pick(t.withColumn("is_robot", ~F.col("is_robot")), t, ["task", "is_robot"], 7, "opposite")


@query(f"""WITH {TRAJ}, l AS (SELECT DISTINCT task FROM traj ORDER BY md5(concat_ws('|', '3', 'lang', task)), task LIMIT 5) SELECT l.task AS lang_task, count(*) AS n, min(id) AS first FROM traj CROSS JOIN l WHERE rank = 3 GROUP BY 1""")
def lang_video_cross(spark, d):
    t = trajectories(spark, d)
    tasks = t.select("task").distinct().orderBy(draw(3, "lang", "task"), "task").limit(5)
    return pairs.task_cross(t.where("quality_label = 'successful'"), tasks).groupBy("lang_task").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


def _without_own(number: str, n: str, own: str) -> str:
    m = f"({n} - CASE WHEN {own} IS NULL THEN 0 ELSE 1 END)"
    return f"CASE WHEN {m} > 0 THEN {number} % greatest({m}, 1) + CASE WHEN {number} % greatest({m}, 1) >= {own} THEN 1 ELSE 0 END END"


def _other(seed: str, purpose: str, refs: str, pool: str = "traj", same_source: float = 0.0, everything: str = "traj") -> str:
    """CTEs up to ``other`` (ref_id, task, pick_id) for refs (id, task, and data_source for same_source)."""
    order = lambda p, k: f"left(md5(concat_ws('|', '{seed}', '{p}', {k})), 3), {k}"
    number = lambda p, *k: _hex(f"'{seed}'", f"'{p}-spot'", *k)
    out = f"""ot AS (SELECT task, row_number() OVER (ORDER BY {order(purpose, "task")}) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT task FROM {pool})),
 oa AS (SELECT r.id AS ref_id, r.task, {"r.data_source," if same_source else ""} {_without_own(number(purpose, "CAST(r.id AS VARCHAR)"), "(SELECT max(n) FROM ot)", "ot.place")} AS any_place FROM {refs} r LEFT JOIN ot ON ot.task = r.task),
 oc AS (SELECT oa.*, ot.task AS any_task FROM oa LEFT JOIN ot ON ot.place = any_place),"""
    task = "any_task"
    if same_source:
        out += f"""
 os AS (SELECT data_source, task, task IN (SELECT task FROM ot) AS good, row_number() OVER (PARTITION BY data_source ORDER BY {order(purpose + "-source", "task")}) - 1 AS place, count(*) OVER (PARTITION BY data_source) AS n FROM (SELECT DISTINCT data_source, task FROM {everything})),
 oz AS (SELECT data_source, max(n) AS n FROM os GROUP BY 1),
 oy AS (SELECT oc.ref_id, oc.data_source, k, {_without_own(number(purpose + "-near", "CAST(oc.ref_id AS VARCHAR)", "CAST(k AS VARCHAR)"), "oz.n", "os.place")} AS place FROM oc JOIN oz USING (data_source) LEFT JOIN os ON os.data_source = oc.data_source AND os.task = oc.task, range(1, 3) t(k)
  WHERE {_u(f"'{seed}'", f"'{purpose}-coin'", "CAST(oc.ref_id AS VARCHAR)")} < {same_source}),
 oh AS (SELECT ref_id, arg_min(os.task, k) FILTER (os.good) AS near_task FROM oy JOIN os ON os.data_source = oy.data_source AND os.place = oy.place GROUP BY 1),
 ow AS (SELECT oc.ref_id, CASE WHEN oh.ref_id IS NOT NULL THEN near_task ELSE any_task END AS task FROM oc LEFT JOIN oh ON oh.ref_id = oc.ref_id),"""
    else:
        out += " ow AS (SELECT ref_id, any_task AS task FROM oc),"
    return out + f"""
 op AS (SELECT id, task, row_number() OVER (PARTITION BY task ORDER BY {order(purpose + "-row", "CAST(id AS VARCHAR)").rsplit(", ", 1)[0]}, id) - 1 AS place, count(*) OVER (PARTITION BY task) AS n FROM {pool}),
 other AS (SELECT ref_id, ow.task, op.id AS pick_id FROM ow LEFT JOIN op ON op.task = ow.task AND op.place = {number(purpose + "-pick", "CAST(ow.ref_id AS VARCHAR)")} % op.n)"""


@query(f"WITH {TRAJ}, {_other('5', 'other', 'traj')} SELECT ref_id, task, pick_id FROM other")
def different_task(spark, d):
    t = trajectories(spark, d)
    return pairs.other_task(t, t, 5, "other")


@query(f"""WITH {TRAJ}, own AS (SELECT * FROM traj QUALIFY row_number() OVER (PARTITION BY task, is_robot ORDER BY md5(concat_ws('|', '5', 'side', CAST(id AS VARCHAR))), id) <= 2),
 slots AS (SELECT h.task, h.id AS human_id, r.id AS robot_id, s.slot, concat_ws('-', h.id, r.id, s.slot) AS id FROM own h JOIN own r ON h.task = r.task AND r.is_robot AND NOT h.is_robot CROSS JOIN (SELECT unnest([1, 2]) AS slot) s),
 {_other('5', 'negative', 'slots')} SELECT slots.task, human_id, robot_id, CAST(slot AS INTEGER) AS slot, other.task AS negative_task, pick_id AS negative_id FROM slots JOIN other ON other.ref_id = slots.id""")
def human_robot_triples(spark, d):
    return pairs.human_robot_triples(trajectories(spark, d), 5, 2)


@query(f"""WITH {TRAJ}, p AS (SELECT a.id a, b.id b, a.partial_success pa, b.partial_success pb FROM traj a JOIN traj b ON a.task = b.task AND a.rank > b.rank AND a.is_robot AND b.is_robot)
 SELECT CASE WHEN pb > pa THEN b ELSE a END AS chosen_id, CASE WHEN pb > pa THEN a ELSE b END AS rejected_id FROM p""")
def swapped_pairs(spark, d):
    return pairs.swap_by_partial_success(pairs.quality_pairs(trajectories(spark, d))).select("chosen_id", "rejected_id")


@query("SELECT n_name, coalesce(CASE WHEN n_nationkey < 10 THEN left(n_name, 3) END, n_name) AS display_name FROM nation")
def display_names(spark, d):
    n = table(spark, d, "nation")
    names = n.where("n_nationkey < 10").select(F.col("n_name").alias("name"), F.left("n_name", F.lit(3)).alias("short"))
    return pairs.with_names(n.select("n_name"), names, "n_name")


# ---- sampling ------------------------------------------------------------------------------


@query(f"WITH {TRAJ} SELECT id, task FROM traj QUALIFY row_number() OVER (PARTITION BY task, quality_label ORDER BY md5(concat_ws('|', '1', 'per', CAST(id AS VARCHAR))), id) <= 2")
def cap_per_quality(spark, d):
    return sampling.cap_per(trajectories(spark, d), ["task", "quality_label"], 2, 1, "per").select("id", "task")


@query(f"WITH {TRAJ} SELECT id FROM traj ORDER BY md5(concat_ws('|', '1', 'all', CAST(id AS VARCHAR))), id LIMIT 100")
def cap_all(spark, d):
    return sampling.cap_all(trajectories(spark, d), 100, 1, "all").select("id")


@query(f"""WITH {TRAJ}, a AS (SELECT *, row_number() OVER (PARTITION BY data_source, task ORDER BY md5(concat_ws('|', '2', 'rr', CAST(id AS VARCHAR))), id) AS round FROM traj)
 SELECT data_source, id, CAST(round AS INTEGER) AS round FROM a WHERE round <= 50 QUALIFY row_number() OVER (PARTITION BY data_source ORDER BY round, md5(concat_ws('|', '2', 'rr-key', task, CAST(round AS VARCHAR))), task) <= 50""")
def round_robin(spark, d):
    return sampling.round_robin(trajectories(spark, d), "data_source", "task", 50, 2, "rr").select("data_source", "id", "round")


@query(f"""WITH {TRAJ}, s AS (SELECT DISTINCT task FROM traj ORDER BY md5(concat_ws('|', '4', 'tasks', task)), task LIMIT 20) SELECT id, task FROM traj WHERE task IN (SELECT task FROM s)""")
def task_cap(spark, d):
    return sampling.cap_tasks(trajectories(spark, d), 20, 4, "tasks").select("id", "task")


@query(f"""WITH {TRAJ}, w AS (SELECT DISTINCT data_source, CASE data_source WHEN 'BUILDING' THEN 3.0 WHEN 'MACHINERY' THEN 0.5 ELSE 1.0 END AS w FROM traj) SELECT data_source, round(w / sum(w) OVER (), 6) AS weight FROM w""")
def source_weights(spark, d):
    return sampling.normalized_weights(trajectories(spark, d), {"BUILDING": 3.0, "MACHINERY": 0.5}).withColumn("weight", r6(F.col("weight")))


@query(f"""WITH {TRAJ}, s AS (SELECT data_source, count(*) AS total, CASE data_source WHEN 'BUILDING' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS raw FROM traj GROUP BY 1),
 w AS (SELECT data_source, total, sum(raw / (SELECT sum(raw) FROM s)) OVER (ORDER BY data_source) AS hi, row_number() OVER (ORDER BY data_source DESC) = 1 AS last FROM s),
 e AS (SELECT data_source, total, coalesce(lag(hi) OVER (ORDER BY data_source), 0) AS lo, CASE WHEN last THEN 2 ELSE hi END AS hi FROM w),
 a AS (SELECT draw, {_u("'11'", "'source'", "CAST(draw AS VARCHAR)")} AS u, {_u("'11'", "'row'", "CAST(draw AS VARCHAR)")} AS v FROM range(1000) t(draw)),
 r AS (SELECT data_source, id, row_number() OVER (PARTITION BY data_source ORDER BY left(md5(concat_ws('|', '11', 'block', CAST(id AS VARCHAR))), 3), id) - 1 AS rank FROM traj)
 SELECT draw, e.data_source, id FROM a JOIN e ON u >= lo AND u < hi JOIN r ON r.data_source = e.data_source AND r.rank = CAST(floor(v * total) AS BIGINT)""")
def balanced_draws(spark, d):
    return sampling.balanced_draws(trajectories(spark, d), 1000, {"BUILDING": 3.0}, 11)


_TYPES = {"preference": 0.5, "progress": 0.3, "similarity": 0.2}
_STRATEGIES = {"rewind": 0.4, "suboptimal": 0.3, "different_task": 0.2, "reverse": 0.1}
_FIRST_STRATEGY = "list_sort([" + ", ".join(f"{{'r': -pow({_u(chr(39) + '9' + chr(39), chr(39) + 'strategy-' + n + chr(39), 'CAST(id AS VARCHAR)')} + 1e-12, 1 / {w}::DOUBLE), 'name': '{n}'}}" for n, w in _STRATEGIES.items()) + "])[1].name"


@query(f"""WITH {TRAJ}, u AS (SELECT *, {_u("'9'", "'type-0'", "CAST(id AS VARCHAR)")} AS u FROM traj)
 SELECT id, CASE WHEN quality_label <> 'successful' OR u < 0.5 THEN 'preference' WHEN u < 0.8 THEN 'progress' ELSE 'similarity' END AS sample_type, {_FIRST_STRATEGY} AS strategy FROM u""")
def sample_types(spark, d):
    return sampling.strategy(sampling.sample_type(trajectories(spark, d), _TYPES, 9), _STRATEGIES, 9).select("id", "sample_type", "strategy")


@query(f"WITH {TRAJ} SELECT id, CAST(epoch AS INTEGER) AS epoch FROM traj, range(3) AS e(epoch)")
def repeated(spark, d):
    return sampling.repeat(trajectories(spark, d), 3).select("id", "epoch")


# ---- frames and targets -----------------------------------------------------------------------


def _frame_query(name: str, expression: Callable[[Column], Column], sql: str) -> None:
    def f(spark, d):
        t = trajectories(spark, d).where("num_frames is not null").select("id", F.col("num_frames").alias("n"))
        return t.select("id", _joined(expression(F.col("n"))).alias("indices"))

    QUERIES[name] = f
    SQL[name] = f"WITH {TRAJ}, t AS (SELECT id, num_frames AS n FROM traj WHERE num_frames IS NOT NULL) SELECT id, array_to_string({sql}, ',') AS indices FROM t"


_ALL = "range(n)"
#: Frame counts up to 400 and numbers of frames to take up to 64, one of each for every event.
_WIDE = "(SELECT event_id AS id, CAST(event_id * 7919 % 400 + 1 AS INTEGER) AS n, CAST(event_id * 104729 % 63 + 2 AS INTEGER) AS k FROM events)"


@query(f"""SELECT id, array_to_string(list_distinct_sorted, ',') AS indices FROM (SELECT id, CASE WHEN n <= k THEN range(n) ELSE list_sort(list_distinct(list_transform(range(k), lambda i: CASE WHEN i = k - 1 THEN n - 1 ELSE CAST(floor(i * ((n - 1) / (k - 1))) AS BIGINT) END))) END AS list_distinct_sorted FROM {_WIDE})""")
def frames_floor_wide(spark, d):
    t = table(spark, d, "events").selectExpr("event_id AS id", "CAST(event_id * 7919 % 400 + 1 AS INT) AS n", "CAST(event_id * 104729 % 63 + 2 AS INT) AS k")
    return t.select("id", _joined(fr.floor_indices(F.col("n"), F.col("k"))).alias("indices"))


_frame_query("frames_linspace", lambda n: fr.linspace_indices(n, 4), f"CASE WHEN n <= 4 THEN {_ALL} ELSE list_transform(range(4), lambda i: CAST(round_even(i * ((n - 1) / 3), 0) AS BIGINT)) END")
_frame_query("frames_floor", lambda n: fr.floor_indices(n, 4), f"CASE WHEN n <= 4 THEN {_ALL} ELSE list_transform(range(4), lambda i: CAST(floor(i * ((n - 1) / 3)) AS BIGINT)) END")
_frame_query("frames_stride", lambda n: fr.stride_indices(n, 4), f"CASE WHEN n <= 4 THEN {_ALL} ELSE list_transform(range(4), lambda i: i * n // 4) END")
_frame_query("frames_interval", lambda n: fr.interval_indices(n, 30, 10), "list_filter(range(n), lambda i: i % 3 = 0)")
_frame_query("frames_fps", lambda n: fr.fps_indices(n, 30, 10, 3), "list_transform(range(least(greatest(CAST(round_even(n * 10 / 30, 0) AS BIGINT), 1), n, 3)), lambda i: CAST(floor(i * ((n - 1) / greatest(least(greatest(CAST(round_even(n * 10 / 30, 0) AS BIGINT), 1), n, 3) - 1, 1))) AS BIGINT))")
_frame_query("frames_prefix_ends", lambda n: fr.prefix_ends(n, 3), "range(3, n + 1, 3)")
_frame_query("frames_rewind_walk", lambda n: fr.segment_walk(F.lit(0), n - 1, F.floor(n / 2).cast("int")), "list_concat(range(n), list_reverse(range(CAST(floor(n / 2) AS BIGINT), n - 1)))")
_frame_query("frames_padded", lambda n: fr.pad(fr.all_indices(n), 6), "CASE WHEN n >= 6 THEN range(n) ELSE list_concat(range(n), list_transform(range(6 - n), lambda i: n - 1)) END")


def _target_query(name: str, expression: Callable[[Column, Column], Column], sql: str, series: str = "range(n)") -> None:
    """One row a frame: id, k, value."""

    def f(spark, d):
        t = trajectories(spark, d).where("num_frames is not null").select("id", F.col("num_frames").alias("n"), "quality_label", "partial_success")
        t = t.select("id", F.posexplode(expression(fr.all_indices(F.col("n")), F.col("n"))).alias("k", "value"))
        return t.select("id", F.col("k").cast("bigint").alias("k"), r6(F.col("value").cast("double")).alias("value"))

    QUERIES[name] = f
    SQL[name] = f"WITH {TRAJ}, t AS (SELECT id, num_frames AS n, quality_label, partial_success, unnest({series}) AS i FROM traj WHERE num_frames IS NOT NULL) SELECT id, i AS k, round(CAST({sql} AS DOUBLE), 6) AS value FROM t"


_target_query("progress_absolute", lambda i, n: fr.absolute_progress(i, n, 0.8), "CASE WHEN i >= floor(0.8::DOUBLE * n) THEN 1.0 ELSE (i + 1) / n END")
_target_query("progress_first_frame", lambda i, n: fr.first_frame_progress(i, n), "i / greatest(1, n - 1)")
_target_query("progress_first_frame_cutoff", lambda i, n: fr.first_frame_progress(i, n, 0.8), "least(1.0, i / greatest(1, floor(0.8::DOUBLE * n) - 1))")
_target_query("progress_relative", lambda i, n: fr.deltas(fr.first_frame_progress(i, n)), "CASE WHEN i = 0 THEN 0 ELSE i / greatest(1, n - 1) - (i - 1) / greatest(1, n - 1) END")
_target_query("progress_cumulative", lambda i, n: fr.running_sum(fr.deltas(fr.first_frame_progress(i, n))), "i / greatest(1, n - 1)")
_target_query("progress_partial_success", lambda i, n: fr.partial_success_progress(i, fr.first_frame_progress(i, n), n, F.col("partial_success")), "CASE WHEN partial_success = 1 THEN i / greatest(1, n - 1) WHEN i = n - 1 THEN partial_success ELSE 0 END")
_target_query("success_labels", lambda i, n: fr.success_labels(fr.first_frame_progress(i, n), F.col("quality_label"), F.lit(0.9)), "CASE WHEN quality_label = 'successful' AND i / greatest(1, n - 1) >= 0.9 THEN 1 ELSE 0 END")
_target_query("last_frame_mask", lambda i, n: fr.last_frame_mask(i, n, F.col("partial_success")), "CASE WHEN partial_success = 1 OR i = n - 1 THEN 1 ELSE 0 END")
_target_query("progress_bins", lambda i, n: F.transform(fr.first_frame_progress(i, n), lambda p: fr.discrete_bin(p, 5)), "round_even(i / greatest(1, n - 1) * 4, 0)")
_target_query("padding_mask", lambda i, n: fr.padding_mask(n, F.lit(8)), "CASE WHEN i < n THEN 1 ELSE 0 END", "range(8)")
_target_query("two_hot_bins", lambda i, n: fr.two_hot(F.col("partial_success") * 0.9, 6), "greatest(0, 1 - abs(partial_success * 0.9 * 5 - i))", "range(6)")


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS b FROM embeddings), s AS (SELECT vec_id, b, list_transform(b, lambda x: exp(x - list_max(b))) AS w FROM e)
 SELECT vec_id, round(list_sum(list_transform(range(len(b)), lambda i: w[i + 1] * i / (len(b) - 1))) / list_sum(w), 6) AS soft, round((list_position(b, list_max(b)) - 1) / (len(b) - 1), 6) AS hard FROM s""")
def bins_to_values(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("b"))
    return e.select("vec_id", r6(fr.bins_to_value(F.col("b"), False)).alias("soft"), r6(fr.bins_to_value_hard(F.col("b"))).alias("hard"))


@query(f"""WITH {FRAMES}, n AS (SELECT id, count(*) n FROM fr GROUP BY 1), e AS (SELECT id, unnest(range(20, n + 1, 20)) AS step FROM n)
 SELECT e.id, CAST(step AS INTEGER) AS frame_step, round(arg_max(value, frame_idx), 6) AS last, round(avg(value), 6) AS mean FROM e JOIN fr ON fr.id = e.id AND frame_idx < step GROUP BY 1, 2""")
def prefix_predictions(spark, d):
    s = frames(spark, d).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "value"))).alias("f"))
    s = s.select("id", F.transform("f", lambda x: x["value"]).alias("v"))
    e = s.select("id", "v", F.explode(fr.prefix_ends(F.size("v"), 20)).alias("frame_step"))
    prefix = F.slice("v", F.lit(1), F.col("frame_step"))
    return e.select("id", "frame_step", r6(metrics.trajectory_reward(prefix, "last")).alias("last"), r6(metrics.trajectory_reward(prefix, "average")).alias("mean"))


@query(f"WITH {FRAMES} SELECT id, frame_idx, round(coalesce(value - lag(value) OVER w, 0), 6) AS delta, round(sum(value) OVER (w ROWS UNBOUNDED PRECEDING), 4) AS total FROM fr WINDOW w AS (PARTITION BY id ORDER BY frame_idx)")
def frame_deltas(spark, d):
    w = Window.partitionBy("id").orderBy("frame_idx")
    f = frames(spark, d)
    return f.select("id", "frame_idx", r6(F.coalesce(F.col("value") - F.lag("value").over(w), F.lit(0.0))).alias("delta"), F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("total"))


# ---- text -----------------------------------------------------------------------------------


_REPLY = """CASE event_id % 4 WHEN 0 THEN 'Answer: ' || (event_id % 47) || ' of 5' WHEN 1 THEN 'maybe ' || (event_id % 7) || ' or ' || (event_id % 4) WHEN 2 THEN 'answer:' || (event_id % 9) ELSE 'none' END"""


@query(f"""WITH t AS (SELECT event_id, {_REPLY} AS t FROM events), n AS (SELECT *, TRY_CAST(nullif(regexp_extract(t, '(?i)ANSWER:\\s*(\\d+)', 1), '') AS INTEGER) AS own, list_extract(regexp_extract_all(t, '\\b([1-5])\\b', 1), -1) AS last FROM t)
 SELECT event_id, CASE WHEN own BETWEEN 1 AND 5 THEN own ELSE CAST(last AS INTEGER) END AS score FROM n""")
def reply_scores(spark, d):
    return table(spark, d, "events").select("event_id", tx.score_1_to_5(F.expr(_REPLY)).alias("score"))


@query("""SELECT o_orderkey, regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '_', 'g') || '_' || o_orderstatus AS task, CAST(o_custkey AS VARCHAR) AS attempt FROM orders""")
def folder_names(spark, d):
    o = table(spark, d, "orders")
    name = F.concat_ws("_", F.regexp_replace("o_orderpriority", "[^A-Za-z0-9]+", "_"), "o_orderstatus", F.lit("q"), F.col("o_custkey").cast("string"))
    return o.select("o_orderkey", tx.folder_parts(name).alias("p")).select("o_orderkey", "p.task", "p.attempt")


@query("""SELECT o_orderkey, 'shard_' || lpad(CAST(o_orderkey // 1000 AS VARCHAR), 4, '0') AS shard, 'batch_' || lpad(CAST(o_custkey // 100 AS VARCHAR), 4, '0') AS batch FROM orders""")
def shard_names(spark, d):
    return table(spark, d, "orders").select("o_orderkey", tx.stable_shard(F.col("o_orderkey").cast("string")).alias("shard"), tx.batch_folder(F.col("o_custkey"), 100).alias("batch"))


@query("""SELECT url, translate(url, '/:', '__') AS cache_key, md5(url) AS config_hash FROM pages""")
def cache_keys(spark, d):
    return table(spark, d, "pages").select("url", tx.cache_key(F.col("url")).alias("cache_key"), F.md5("url").alias("config_hash"))


@query("""WITH s AS (SELECT url, trim(regexp_replace(regexp_replace('/' || url || ' -x/', '[/:*?"<>| ,]', '_', 'g'), '_+', '_', 'g'), '_') AS p FROM pages)
 SELECT url, CASE WHEN length(p) <= 36 THEN p ELSE rtrim(left(p, 27), '_') || '_' || left(md5('/' || url || ' -x/'), 8) END AS short FROM s""")
def short_names(spark, d):
    return table(spark, d, "pages").select("url", tx.short_name(F.concat(F.lit("/"), "url", F.lit(" -x/")), 36).alias("short"))


@query("""SELECT p_partkey, upper(left(lower(p_name), 1)) || substr(replace(lower(p_name), '_', ' '), 2) AS pretty FROM part""")
def pretty_tasks(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.prettify(F.col("p_name")).alias("pretty"))


# ---- set operations ----------------------------------------------------------------------------


@query(f"WITH {TRAJ} SELECT task FROM traj WHERE rank = 3 INTERSECT SELECT task FROM traj WHERE rank = 2")
def tasks_with_both(spark, d):
    t = trajectories(spark, d)
    return t.where("quality_label = 'successful'").select("task").intersect(t.where("quality_label = 'suboptimal'").select("task"))


@query(f"WITH {TRAJ} SELECT id, task FROM traj WHERE task NOT IN (SELECT task FROM traj WHERE rank = 1)")
def tasks_without_failure(spark, d):
    t = trajectories(spark, d)
    return t.join(t.where("quality_label = 'failure'").select("task").distinct(), "task", "left_anti").select("id", "task")


@query("""WITH g AS (SELECT n_regionkey AS pos, n_name AS dataset, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS sub FROM nation WHERE n_regionkey IN (0, 1) UNION ALL SELECT 2, 'extra', 0)
 SELECT dataset, CAST(row_number() OVER (ORDER BY pos, sub) AS INTEGER) AS place FROM g""")
def resolved_keys(spark, d):
    n = table(spark, d, "nation")
    groups = n.groupBy(F.col("n_regionkey").cast("string").alias("name")).agg(F.array_sort(F.collect_list("n_name")).alias("members"))
    return curate.resolve_keys(["0", ["1", "extra"], "0"], groups)


@query("SELECT c_mktsegment AS data_source, list_sort(list(DISTINCT n_regionkey))[1] AS first, count(DISTINCT c_nationkey) AS tasks FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def tasks_by_source(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    x = c.join(n, c.c_nationkey == n.n_nationkey).groupBy(F.col("c_mktsegment").alias("data_source"))
    return x.agg(F.get(F.array_sort(F.collect_set("n_regionkey")), F.lit(0)).alias("first"), F.size(F.collect_set("c_nationkey")).cast("bigint").alias("tasks"))


from tracklake.plans import batch_queries, binary_queries, layout_queries, metric_queries, sample_queries, source_queries  # noqa: E402, F401  (they add their queries)
