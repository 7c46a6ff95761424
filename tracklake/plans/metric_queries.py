"""Queries of evaluations, samples' counters and series functions, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.functions import frames as fr
from tracklake.functions import text as tx
from tracklake.operators import curate, evals, metrics, sampling
from tracklake.plans.canonical import FRAMES, TRAJ, frames, table, trajectories
from tracklake.plans.queries import _joined, query, r6

#: Series of predictions: one a user, with a label by the id; partial success for some.
SERIES = f"""{FRAMES}, sz AS (SELECT id, count(*) AS n FROM fr GROUP BY 1), se AS (SELECT fr.id, frame_idx, value / 100 AS p, (frame_idx + 1.0) / n AS t, n, CASE fr.id % 3 WHEN 0 THEN 'failure' WHEN 1 THEN 'suboptimal' ELSE 'successful' END AS quality_label,
 's' || (fr.id % 4) AS data_source, CASE WHEN fr.id % 5 > 0 THEN (fr.id % 5 - 1) / 3.0 END AS partial_success FROM fr JOIN sz USING (id))"""


def _series(spark, d) -> DataFrame:
    s = frames(spark, d).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "value"))).alias("f"))
    n = F.size("f")
    s = s.withColumns({"progress_pred": F.transform("f", lambda x: x["value"] / 100), "target_progress": F.transform("f", lambda x: (x["frame_idx"] + 1) / n), "n": n})
    label = F.when(F.col("id") % 3 == 0, "failure").when(F.col("id") % 3 == 1, "suboptimal").otherwise("successful")
    return s.select("id", "progress_pred", "target_progress", "n", label.alias("quality_label"), F.concat(F.lit("s"), F.col("id") % 4).alias("data_source"), F.when(F.col("id") % 5 > 0, (F.col("id") % 5 - 1) / 3.0).alias("partial_success"))


_BINS = lambda x: f"round_even(greatest(least({x}, 1), 0) * 4, 0)"


@query(f"""WITH {SERIES}, a AS (SELECT id, data_source, quality_label, partial_success, avg((t - p) * (t - p)) AS loss, coalesce(corr(p, t), 0) AS pearson, arg_max(p, frame_idx) AS last FROM se GROUP BY ALL)
 SELECT data_source, round(avg(loss) FILTER (quality_label = 'successful'), 6) AS loss, round(avg(pearson) FILTER (quality_label = 'successful'), 6) AS pearson, round(avg(abs(last - partial_success)), 6) AS partial_success_abs_delta,
 round(avg(abs({_BINS("last")} - {_BINS("partial_success")})) FILTER (partial_success IS NOT NULL), 6) AS mae FROM a GROUP BY 1""")
def alignment(spark, d):
    a = evals.alignment(_series(spark, d), partial=True)
    return a.select("data_source", *[r6(F.col(c)).alias(c) for c in a.columns[1:]])


@query(f"""WITH {SERIES}, f AS (SELECT data_source, quality_label, (p - 0.5) * 8 AS x, t, CASE WHEN quality_label = 'successful' AND t >= 0.9 THEN 1 ELSE 0 END AS y FROM se), m AS (SELECT * FROM f WHERE quality_label <> 'successful' OR t < 0.4 OR y = 1)
 SELECT data_source, round(avg(greatest(x, 0) + ln(1 + exp(-abs(x))) - x * y), 6) AS loss, round(avg(CAST((x > 0) = (y = 1) AS INT)), 6) AS accuracy, round(avg(CAST(x > 0 AS INT)) FILTER (y = 1), 6) AS positive, round(avg(CAST(x <= 0 AS INT)) FILTER (y = 0), 6) AS negative, count(*) AS n FROM m GROUP BY 1""")
def success_metrics(spark, d):
    s = _series(spark, d).withColumn("labels", fr.success_labels(F.col("target_progress"), F.col("quality_label"), F.lit(0.9)))
    s = s.withColumn("logits", F.transform("progress_pred", lambda p: (p - 0.5) * 8))
    f = evals.frames_of(s, ["data_source", "quality_label"], logit="logits", target="target_progress", label="labels")
    m = evals.success_metrics(f, ["data_source"], 0.4)
    return m.select("data_source", *[r6(F.col(c)).alias(c) for c in ("loss", "accuracy", "positive", "negative")], "n")


@query(f"""WITH {SERIES}, f AS (SELECT data_source, quality_label, p, CASE WHEN quality_label = 'successful' AND t >= 0.9 THEN 1 ELSE 0 END AS y FROM se), a AS (SELECT data_source AS g, p AS score, sum(y) tp, count(*) n FROM f GROUP BY 1, 2),
 c AS (SELECT g, tp, n, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM a WINDOW w AS (PARTITION BY g ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) SELECT g AS data_source, round(CASE WHEN sum(tp) = 0 OR sum(tp) = sum(n) THEN 0 ELSE sum(tp * ctp / cn) / sum(tp) END, 6) AS success_auprc FROM c GROUP BY 1""")
def success_auprc(spark, d):
    s = _series(spark, d).withColumn("labels", fr.success_labels(F.col("target_progress"), F.col("quality_label"), F.lit(0.9)).cast("array<int>"))
    f = evals.frames_of(s, ["data_source"], p="progress_pred", y="labels")
    return metrics.average_precision(f, ["data_source"], "p", "y").select("data_source", r6(F.col("average_precision")).alias("success_auprc"))


@query(f"""WITH {SERIES}, m AS (SELECT * FROM se WHERE frame_idx % 3 = 0 AND id % 10 > 0), r AS (SELECT id, rank() OVER (PARTITION BY id ORDER BY p) + (count(*) OVER (PARTITION BY id, p) - 1) / 2.0 AS x, rank() OVER (PARTITION BY id ORDER BY t) + (count(*) OVER (PARTITION BY id, t) - 1) / 2.0 AS y FROM m),
 c AS (SELECT id, CASE WHEN count(*) > 1 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END AS s FROM r GROUP BY 1) SELECT sz.id, round(coalesce(s, 0), 6) AS spearman FROM sz LEFT JOIN c USING (id)""")
def masked_spearman(spark, d):
    s = _series(spark, d)
    s = s.withColumn("mask", F.transform("progress_pred", lambda _, k: F.when((k % 3 == 0) & (F.col("id") % 10 > 0), 1.0).otherwise(0.0)))
    return evals.masked_spearman(evals.frames_of(s, ["id"], pred="progress_pred", target="target_progress", mask="mask"), ["id"], s).withColumn("spearman", r6(F.col("spearman")))


@query(f"""WITH {SERIES}, r AS (SELECT data_source, id, sum(abs(p - t) * (frame_idx % 2)) / any_value(n) AS l1, sum((p - t) * (p - t) * (frame_idx % 2)) / any_value(n) AS l2, sum(frame_idx % 2) AS m FROM se GROUP BY 1, 2)
 SELECT data_source, round(sum(l1) / (sum(m) + 1e-8), 6) AS l1, round(sum(l2) / (sum(m) + 1e-8), 6) AS l2 FROM r GROUP BY 1""")
def progress_loss(spark, d):
    s = _series(spark, d).withColumn("mask", F.transform("progress_pred", lambda _, k: (k % 2).cast("double")))
    one, two = (evals.progress_loss(s, ["data_source"], k).select("data_source", r6(F.col("loss")).alias(k)) for k in ("l1", "l2"))
    return one.join(two, "data_source")


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS b FROM embeddings), l AS (SELECT label, ln(list_sum(list_transform(b, lambda x: exp(x - list_max(b))))) + list_max(b) - b[label % 8 + 1] AS ce FROM e)
 SELECT label, round(avg(ce), 6) AS ce FROM l GROUP BY 1""")
def progress_cross_entropy(spark, d):
    e = table(spark, d, "embeddings").select("label", F.array(F.transform("embedding", lambda x: x.cast("double"))).alias("progress_pred"), F.array(F.col("label") % 8).alias("target_progress"), F.array(F.lit(1.0)).alias("mask"))
    return evals.progress_loss(e, ["label"], "ce").select("label", r6(F.col("loss")).alias("ce"))


@query(f"""WITH {SERIES}, i AS (SELECT id, n, unnest(range(1, n + 1)) AS step FROM sz) SELECT id, CAST(step AS INTEGER) AS frame_step, array_to_string(list_transform(range(4), lambda k: CASE WHEN k = 3 THEN step - 1 ELSE CAST(floor(k * ((step - 1) / 3)) AS BIGINT) END), ',') AS indices FROM i""")
def prefix_expansion(spark, d):
    return evals.prefix_samples(_series(spark, d).select("id", "n"), "n").select("id", "frame_step", _joined(F.col("indices")).alias("indices"))


@query(f"""WITH {SERIES} SELECT id, count(*) FILTER (frame_idx % 7 > 0) AS n, round(sum(p * frame_idx) FILTER (frame_idx % 7 > 0), 4) AS weighted, round(arg_max(p, frame_idx) FILTER (frame_idx % 7 > 0), 6) AS last FROM se GROUP BY 1""")
def prefix_aggregation(spark, d):
    s = _series(spark, d)
    one = s.select("id", F.posexplode("progress_pred").alias("frame_step", "p"))
    one = one.withColumn("progress_pred", F.when(F.col("frame_step") % 7 > 0, F.array(F.lit(0.0), F.col("p"))).otherwise(F.array().cast("array<double>")))
    got = evals.prefixes_together(one.withColumn("kept", F.col("p")), ["id"])
    steps = one.where("frame_step % 7 > 0").groupBy("id").agg(F.round(F.sum(F.col("p") * F.col("frame_step")), 4).alias("weighted"))
    return got.join(steps, "id").select("id", F.size("progress_pred").cast("bigint").alias("n"), "weighted", r6(F.try_element_at("progress_pred", F.lit(-1))).alias("last"))


_THREE = f"""{TRAJ}, li AS (SELECT l_orderkey AS id, array_agg(l_extendedprice ORDER BY l_linenumber, l_extendedprice) AS s FROM lineitem GROUP BY 1),
 k AS (SELECT t.*, kind, CASE kind WHEN 'last' THEN s[-1] WHEN 'sum' THEN round(list_sum(s), 2) ELSE round(list_sum(s) / len(s), 2) END AS r FROM traj t JOIN li USING (id) CROSS JOIN (SELECT unnest(['last', 'sum', 'average']) AS kind))"""


@query(f"""WITH {_THREE}, p AS (SELECT a.kind, CASE WHEN b.r > a.r OR (b.r = a.r AND a.id < b.id) THEN 1 ELSE 0 END AS ok FROM k a JOIN k b ON a.kind = b.kind AND a.task = b.task AND a.rank < b.rank)
 SELECT kind, CAST(sum(ok) AS BIGINT) AS correct, count(*) AS total, round(avg(ok), 6) AS accuracy FROM p GROUP BY 1""")
def ranking_by_reward(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_extendedprice"))).alias("s"))
    t = trajectories(spark, d).drop("reward").join(s.select("id", F.transform("s", lambda x: x["l_extendedprice"]).alias("p")), "id")
    long = evals.rewards_long(t, "p").withColumn("reward", F.when(F.col("kind") == "last", F.col("reward")).otherwise(metrics.rounded(F.col("reward"), 2)))
    return evals.ranking_by_reward(long).withColumn("accuracy", r6(F.col("accuracy")))


@query("""WITH p AS (SELECT l_returnflag AS task, CASE WHEN l_quantity > 5 THEN CAST(l_discount > 0.05 AS INT) END AS prediction, CAST(l_tax > 0.04 AS INT) AS label FROM lineitem)
 SELECT task, CAST(sum(CAST(prediction = label AS INT)) AS BIGINT) AS correct, count(*) AS total, round(avg(CAST(prediction = label AS INT)), 6) AS accuracy FROM p WHERE prediction IS NOT NULL GROUP BY ROLLUP (task)""")
def preference_accuracy_by_task(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("task"), F.when(F.col("l_quantity") > 5, (F.col("l_discount") > 0.05).cast("int")).alias("prediction"), (F.col("l_tax") > 0.04).cast("int").alias("label"))
    return evals.accuracy_by_task(li).withColumn("accuracy", r6(F.col("accuracy")))


@query("""WITH p AS (SELECT CAST(l_discount > l_tax AS INT) AS ok, CASE WHEN l_quantity > 10 THEN l_discount END AS c, l_tax AS r, CASE WHEN l_quantity <= 45 THEN 1 END AS label FROM lineitem)
 SELECT round(avg(CASE WHEN c IS NOT NULL AND label IS NOT NULL THEN CAST(c > r AS INT) END), 6) AS accuracy, CAST(sum(CASE WHEN label IS NOT NULL AND c > r THEN 1 ELSE 0 END) AS BIGINT) AS correct, count(*) FILTER (c IS NOT NULL AND label IS NOT NULL) AS total, count(*) FILTER (c IS NULL OR label IS NULL) AS skipped FROM p""")
def preference_from_progress(spark, d):
    li = table(spark, d, "lineitem").select(F.array(F.lit(0.0), F.when(F.col("l_quantity") > 10, F.col("l_discount"))).alias("chosen_progress"), F.array(F.col("l_tax")).alias("rejected_progress"), F.when(F.col("l_quantity") <= 45, 1).alias("label"))
    return metrics.preference_from_progress(li).withColumn("accuracy", r6(F.col("accuracy")))


_SIM = """x AS (SELECT p_brand AS task, s_nationkey AS human_id, l_linenumber AS robot_id, l_discount - l_tax AS m FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
 a AS (SELECT task, human_id, robot_id, avg(CAST(m > 0 AS INT)) w, avg(m) m FROM x GROUP BY 1, 2, 3), t AS (SELECT task, avg(w) AS win, avg(m) AS margin FROM a GROUP BY 1)"""


@query(f"WITH {_SIM} SELECT round(avg(win), 6) AS win, round(avg(margin), 6) AS margin FROM t")
def similarity_macro(spark, d):
    li, p, s = table(spark, d, "lineitem"), table(spark, d, "part"), table(spark, d, "supplier")
    x = li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey)
    x = x.select(F.col("p_brand").alias("task"), F.col("s_nationkey").alias("human_id"), F.col("l_linenumber").alias("robot_id"), F.col("l_discount").alias("sim_score_ref_sim"), F.col("l_tax").alias("sim_score_ref_diff"))
    return metrics.macro_mean(metrics.similarity_scores(x), "win", "margin").select(r6(F.col("win")).alias("win"), r6(F.col("margin")).alias("margin"))


_MADE = "m AS (SELECT CASE event_id % 3 WHEN 0 THEN 'preference' WHEN 1 THEN 'progress' ELSE 'similarity' END AS kind, event_type AS strategy, 'u' || (user_id % 5) AS data_source, CASE WHEN event_id % 11 > 0 THEN event_id % 4 + 1 END AS attempt FROM events)"


def _made(spark, d) -> DataFrame:
    k = F.col("event_id")
    kind = F.when(k % 3 == 0, "preference").when(k % 3 == 1, "progress").otherwise("similarity")
    return table(spark, d, "events").select(kind.alias("kind"), F.col("event_type").alias("strategy"), F.concat(F.lit("u"), F.col("user_id") % 5).alias("data_source"), F.when(k % 11 > 0, k % 4 + 1).alias("attempt"))


@query(f"""WITH {_MADE}, c AS (SELECT CASE kind WHEN 'preference' THEN 'pref' WHEN 'progress' THEN 'prog' ELSE 'sim' END || '_' || strategy AS counter FROM m UNION ALL SELECT 'total_' || data_source FROM m
 UNION ALL SELECT 'total_' || CASE kind WHEN 'preference' THEN 'preferences' WHEN 'progress' THEN 'progress' ELSE 'similarities' END FROM m UNION ALL SELECT 'total_samples' FROM m)
 SELECT counter, count(*) AS n, round(count(*) / (SELECT count(*) FROM m), 6) AS fraction FROM c GROUP BY 1""")
def sampling_counts(spark, d):
    return evals.sampling_counts(_made(spark, d)).withColumn("fraction", r6(F.col("fraction")))


@query(f"""WITH {_MADE}, n AS (SELECT replace(kind || '_' || strategy, ' ', '_') AS name, attempt FROM m WHERE attempt IS NOT NULL) SELECT name, CAST(min(attempt) AS DOUBLE) AS least, CAST(max(attempt) AS DOUBLE) AS most, round(avg(attempt), 6) AS mean FROM n GROUP BY ROLLUP (name)""")
def attempt_statistics(spark, d):
    return evals.attempt_statistics(_made(spark, d)).withColumn("mean", r6(F.col("mean")))


@query("""WITH g AS (SELECT c_mktsegment AS k, round(avg(c_acctbal), 4) AS mean, round(max(c_acctbal), 4) AS top FROM customer GROUP BY 1) SELECT k || '/mean' AS name, mean AS value FROM g UNION ALL SELECT k || '/top', top FROM g""")
def flat_metrics(spark, d):
    g = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.create_map(F.lit("mean"), F.round(F.avg("c_acctbal"), 4), F.lit("top"), F.round(F.max("c_acctbal"), 4), F.lit("none"), F.lit(None).cast("double")).alias("m"))
    return evals.flat_metrics(g, "c_mktsegment", "m")


@query("""WITH m AS (SELECT o_orderpriority AS model, c_mktsegment AS dataset, avg(o_totalprice) AS v, max(o_totalprice) AS w FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
 SELECT model, round(max(v) FILTER (dataset = 'BUILDING'), 4) AS bm, round(max(w) FILTER (dataset = 'BUILDING'), 4) AS bt, round(max(v) FILTER (dataset = 'MACHINERY'), 4) AS mm FROM m GROUP BY 1""")
def ablation_table(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    m = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("o_orderpriority").alias("model"), F.col("c_mktsegment").alias("dataset")).agg(F.avg("o_totalprice").alias("mean"), F.max("o_totalprice").alias("top"))
    long = m.select("model", "dataset", F.explode(F.create_map(F.lit("mean"), F.col("mean"), F.lit("top"), F.col("top"))).alias("metric", "value"))
    a = evals.ablation_table(long, ["BUILDING", "MACHINERY"], ["mean", "top"])
    return a.select("model", *[F.round(F.col(f"`{c}`"), 4).alias(n) for c, n in (("BUILDING/mean", "bm"), ("BUILDING/top", "bt"), ("MACHINERY/mean", "mm"))])


@query("""SELECT l_linestatus AS split, count(*) AS n, CAST(sum(CAST(l_quantity > 20 AS INT)) AS BIGINT) AS agreed, round(avg(CAST(l_quantity > 20 AS INT)), 6) AS share, round(avg(l_tax), 6) AS confidence FROM lineitem GROUP BY ROLLUP (l_linestatus)""")
def label_agreement(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("split"), F.lit("a").alias("predicted"), F.when(F.col("l_quantity") > 20, "a").otherwise("b").alias("original"), F.col("l_tax").alias("confidence"))
    return evals.agreement(li).select("split", "n", "agreed", *[r6(F.col(c)).alias(c) for c in ("share", "confidence")])


@query(f"""WITH {FRAMES}, e AS (SELECT *, frame_idx = min(frame_idx) OVER (PARTITION BY id) OR frame_idx = max(frame_idx) OVER (PARTITION BY id) AS first FROM fr) SELECT id, frame_idx FROM e QUALIFY row_number() OVER (PARTITION BY id ORDER BY first DESC, value DESC NULLS LAST, frame_idx) <= 8""")
def motion_frames(spark, d):
    return evals.by_motion(frames(spark, d), "id", "frame_idx", "value", 8).select("id", "frame_idx")


@query(f"""WITH {TRAJ} SELECT 'reward_alignment' AS kind, count(*) FILTER (rank = 3) AS n FROM traj UNION ALL SELECT 'confusion_matrix', count(*) FILTER (rank > 1) FROM traj UNION ALL SELECT 'policy_ranking', count(*) FROM traj UNION ALL SELECT 'one', count(*) FROM traj UNION ALL SELECT 'training', count(*) FILTER (rank = 3) FROM traj""")
def rows_by_evaluation(spark, d):
    t = trajectories(spark, d)
    parts = {k: evals.eval_rows(t, k) for k in ("reward_alignment", "confusion_matrix", "policy_ranking")} | {"one": evals.eval_rows(t, "reward_alignment", ["roboreward_x"]), "training": evals.training_rows(t, [0, 1, 0])}
    out = None
    for k, p in parts.items():
        one = p.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


_CATEGORIES = {"failure": ["BUILDING", "MACHINERY"], "paired": ["FURNITURE"]}


@query(f"""WITH {TRAJ} SELECT data_source, data_source IN ('BUILDING', 'MACHINERY') AS failure, data_source = 'FURNITURE' AS paired, false AS preference_only, count(*) AS n FROM traj GROUP BY 1""")
def source_categories(spark, d):
    s = F.col("data_source")
    return trajectories(spark, d).groupBy("data_source", *[evals.in_category(s, _CATEGORIES, c).alias(c) for c in ("failure", "paired", "preference_only")]).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {TRAJ} SELECT 'some' AS asked, count(*) AS n FROM traj WHERE data_source IN ('BUILDING', 'nowhere') UNION ALL SELECT 'none', count(*) FROM traj""")
def suiting_sources(spark, d):
    t = trajectories(spark, d)
    some, none = (evals.suiting_sources(t, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("asked"), "n") for k, n in (("some", ["BUILDING", "nowhere"]), ("none", ["nowhere"])))
    return some.unionByName(none)


@query("""SELECT 'customer' AS dataset, c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier""")
def combined_datasets(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    return evals.combined({"customer": c.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")), "supplier": s.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))}).select("dataset", "id", "balance", "segment")


@query("""SELECT n_regionkey AS task_name, n_nationkey, n_name FROM nation""")
def flattened_tasks(spark, d):
    n = table(spark, d, "nation")
    m = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rows"))  # 25 nations
    return evals.spread_tasks(m.select(F.map_from_arrays(F.array("n_regionkey"), F.array("rows")).alias("tasks")), "tasks")


@query("""SELECT name, name LIKE 'ALGERIA/%' OR name LIKE '[''ALGERIA'', ''BRAZIL'']/%' AS matches FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '[''ALGERIA'', ''BRAZIL'']' END || '/m' || n_nationkey AS name FROM nation)""")
def metric_keys(spark, d):
    name = F.concat(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("['ALGERIA', 'BRAZIL']"), F.lit("/m"), F.col("n_nationkey"))
    return table(spark, d, "nation").select(name.alias("name")).withColumn("matches", evals.key_matches(F.col("name"), "ALGERIA", "ALGERIA", "BRAZIL"))


@query(f"""WITH {SERIES}, h AS (SELECT id, frame_idx, p, CASE WHEN frame_idx = 0 THEN '' ELSE md5(concat_ws('|', CAST(id AS VARCHAR), CAST(frame_idx AS VARCHAR))) END AS h FROM se), s AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY h) - 1 AS pos FROM h)
 SELECT id, array_to_string(array_agg(frame_idx ORDER BY pos), ',') AS frames, round(sum(p * frame_idx), 4) AS restored, round(sum(p) FILTER (pos % 2 = 0), 4) AS even, round(sum(p) FILTER (pos % 2 = 1), 4) AS odd FROM s GROUP BY 1""")
def shuffled_frames(spark, d):
    s = _series(spark, d).withColumn("order", fr.shuffled(F.col("n"), F.col("id").cast("string")))
    s = s.withColumn("mixed", fr.gather(F.col("progress_pred"), F.col("order")))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    back = fr.unshuffled(F.col("mixed"), F.col("order"))
    return s.select("id", _joined(F.col("order")).alias("frames"), F.round(total(F.transform(back, lambda v, k: v * k)), 4).alias("restored"), F.round(total(fr.every_other(F.col("mixed"), 0)), 4).alias("even"), F.round(total(fr.every_other(F.col("mixed"), 1)), 4).alias("odd"))


@query(f"WITH {TRAJ} SELECT task, row_number() OVER (ORDER BY task) AS place FROM (SELECT DISTINCT task FROM traj WHERE task IS NOT NULL)")
def unique_tasks(spark, d):
    return curate.numbered_tasks(trajectories(spark, d)).select("task", "place")


_MISSING = "v AS (SELECT n_regionkey AS rank, c_mktsegment AS metric, avg(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE NOT (n_regionkey = 0 AND c_mktsegment = 'BUILDING') GROUP BY 1, 2)"


@query(f"WITH {_MISSING} SELECT metric, round(sum(v), 4) AS sum, round(sum(v) / (SELECT count(DISTINCT rank) FROM v), 4) AS mean FROM v GROUP BY 1")
def reduce_metrics_missing(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    m = c.join(n, c.c_nationkey == n.n_nationkey).where("not (n_regionkey = 0 and c_mktsegment = 'BUILDING')").groupBy(F.col("n_regionkey").alias("rank"), F.col("c_mktsegment").alias("metric")).agg(F.avg("c_acctbal").alias("value"))
    return metrics.reduce_metrics(m, missing_as_zero=True).select("metric", F.round("sum", 4).alias("sum"), F.round("mean", 4).alias("mean"))


@query(f"""WITH {TRAJ}, t AS (SELECT *, num_frames AS n FROM traj WHERE num_frames IS NOT NULL) SELECT id, array_to_string(CASE WHEN n = 1 THEN [0] WHEN n = 2 THEN [0, 1] ELSE list_concat(range(1, least(n - 1, 4) + 1), list_reverse(range(2, least(n - 1, 4)))) END, ',') AS indices FROM t""")
def frames_segment(spark, d):
    t = trajectories(spark, d).where("num_frames is not null")
    return t.select("id", _joined(fr.segment_indices(F.col("num_frames"), F.lit(1), F.lit(2), F.least(F.lit(4), F.col("num_frames")))).alias("indices"))


@query(f"""WITH {TRAJ}, c AS (SELECT data_source, CASE data_source WHEN 'BUILDING' THEN 0.5 WHEN 'MACHINERY' THEN 0.75 END AS cut FROM (SELECT DISTINCT data_source FROM traj)), t AS (SELECT traj.*, cut, unnest(range(num_frames)) AS i FROM traj JOIN c USING (data_source) WHERE num_frames IS NOT NULL)
 SELECT data_source, CAST(sum(CASE WHEN rank = 3 AND i / greatest(1, num_frames - 1) >= coalesce(cut, 1.0) THEN 1 ELSE 0 END) AS BIGINT) AS n FROM t GROUP BY 1""")
def success_cutoffs(spark, d):
    t = trajectories(spark, d).where("num_frames is not null")
    cutoffs = t.select("data_source").distinct().select("data_source", F.when(F.col("data_source") == "BUILDING", 0.5).when(F.col("data_source") == "MACHINERY", 0.75).alias("success_percent")).where("success_percent is not null")
    joined = curate.with_cutoffs(t, cutoffs, 1.0)
    labels = fr.success_labels(fr.first_frame_progress(fr.all_indices(F.col("num_frames")), F.col("num_frames")), F.upper("quality_label"), F.col("cutoff"))
    return joined.groupBy("data_source").agg(F.sum(F.aggregate(labels, F.lit(0.0), lambda a, x: a + x)).cast("bigint").alias("n"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'successful' WHEN event_id % 4 = 1 THEN 'failure' ELSE 'unknown' END AS label, CASE event_id % 4 WHEN 0 THEN 0.6 WHEN 1 THEN CAST(round((event_id % 90 + 10) / 100.0, 2) AS DOUBLE) ELSE 0.5 END AS confidence FROM events""")
def reply_decisions(spark, d):
    k = F.col("event_id")
    t = F.when(k % 4 == 0, F.lit("It was a success")).when(k % 4 == 1, F.concat(F.lit("Reply\nDECISION: it Failed\nConfidence: "), k % 90 + 10, F.lit(" %"))).when(k % 4 == 2, F.lit("who knows")).otherwise("decision: open")
    r = table(spark, d, "events").select("event_id", tx.reply_decision(t).alias("r"))
    return r.select("event_id", "r.label", F.round("r.confidence", 2).alias("confidence"))


@query("""SELECT o_orderkey, upper(left(o_orderpriority, 1)) || substr(replace(o_orderpriority, '-', ' '), 2) || ' of ' || o_orderstatus AS task FROM orders""")
def video_tasks(spark, d):
    name = F.concat(F.lit("dir/"), F.replace("o_orderpriority", F.lit("-"), F.lit("_")), F.lit("_of_"), F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 2 == 0, "_Fail.mp4").otherwise(", take_2.mp4"))
    return table(spark, d, "orders").select("o_orderkey", tx.task_from_video_name(name).alias("task"))


@query(f"WITH {TRAJ}, w AS (SELECT data_source, count(*) AS n FROM traj GROUP BY 1) SELECT data_source, round(1.0 / count(*) OVER (), 6) AS weight FROM w")
def equal_weights(spark, d):
    return sampling.normalized_weights(trajectories(spark, d), {s: 0.0 for s in ("BUILDING", "MACHINERY", "FURNITURE", "AUTOMOBILE", "HOUSEHOLD")}).withColumn("weight", r6(F.col("weight")))


@query(f"""WITH {TRAJ} SELECT id, data_source FROM traj WHERE CASE data_source WHEN 'BUILDING' THEN NOT (task LIKE '%3%') WHEN 'MACHINERY' THEN coalesce(num_frames, 99) > 3 AND rank = 3 ELSE true END""")
def filter_by_source(spark, d):
    rules = {"BUILDING": {"keywords": ["3"]}, "MACHINERY": {"min_frames": 3, "labels": ["successful"]}}
    return curate.filter_by_source(trajectories(spark, d), rules).select("id", "data_source")


@query("""SELECT * FROM (VALUES ('id', 'string', 'bigint'), ('lang_vector', 'array<float>', NULL), ('frames', 'string', NULL), ('partial_success', 'float', 'double')) v("column", expected, found)""")
def type_violations(spark, d):
    return curate.type_violations(trajectories(spark, d))


_HELD = "least(greatest({}, -50), 50)"


@query(f"""WITH s AS (SELECT l_returnflag, {_HELD.format('l_extendedprice / 500 - 60')} AS a, {_HELD.format('l_quantity * 3 - 60')} AS b, CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END AS y FROM lineitem), z AS (SELECT *, {_HELD.format('2 * (a - b)')} AS z FROM s)
 SELECT l_returnflag, round(avg(greatest(-z, 0) + ln(1 + exp(-abs(z)))), 6) AS similarity_loss, round(avg(a - b), 6) AS margin, round(avg(CASE WHEN a > b THEN 1.0 ELSE 0.0 END), 6) AS ranked, round(avg(greatest(a, 0) + ln(1 + exp(-abs(a))) - a * y), 6) AS preference_loss FROM z GROUP BY 1""")
def held_losses(spark, d):
    """Losses and margins of scores of which many lie beyond the bounds."""
    sim, diff = F.col("l_extendedprice") / 500 - 60, F.col("l_quantity") * 3 - 60
    margin = metrics.similarity_margin(sim, diff)
    means = {"similarity_loss": metrics.similarity_loss(sim, diff, 2.0), "margin": margin, "ranked": (margin > 0).cast("double"), "preference_loss": metrics.preference_loss(sim, (F.col("l_tax") > 0.04).cast("int"))}
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(*[r6(F.avg(c)).alias(n) for n, c in means.items()])


@query("""WITH g AS (SELECT p_partkey, CAST(p_size * 13 + 100 AS BIGINT) AS w, p_partkey % 400 + 90 AS h FROM part), s AS (SELECT *, least(w, h) AS e FROM g),
 f AS (SELECT *, CAST(floor(w * (240::DOUBLE / e)) AS BIGINT) AS a, CAST(floor(h * (240::DOUBLE / e)) AS BIGINT) AS b, CAST(floor(e * (240::DOUBLE / e)) AS BIGINT) AS c FROM s)
 SELECT p_partkey, CAST(a + a % 2 AS INTEGER) AS width, CAST(b + b % 2 AS INTEGER) AS height, CAST(floor((w - e) / 2) AS INTEGER) AS x, CAST(floor((h - e) / 2) AS INTEGER) AS y, CAST(c + c % 2 AS INTEGER) AS side FROM f""")
def frame_geometry(spark, d):
    w, h = (F.col("p_size") * 13 + 100).cast("bigint"), F.col("p_partkey") % 400 + 90
    plain, cut = fr.resize_geometry(w, h, 240), fr.resize_geometry(w, h, 240, crop=True)
    return table(spark, d, "part").select("p_partkey", plain["width"].alias("width"), plain["height"].alias("height"), cut["x"].alias("x"), cut["y"].alias("y"), cut["width"].alias("side"))
