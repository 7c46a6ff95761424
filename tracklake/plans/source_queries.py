"""Queries of the readers' joins and name rules over the test tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklake.functions import text as tx
from tracklake.operators import curate, models
from tracklake.plans.canonical import TRAJ, table, trajectories
from tracklake.plans.queries import _joined, query, r6
from tracklake.schema import normalize_quality
from tracklake.sources import readers as rd

_REWARDS = "r AS (SELECT event_id, event_id % 7 AS reward FROM events WHERE event_id % 7 BETWEEN 1 AND 5)"


def _rewards(spark, d):
    e = table(spark, d, "events").withColumn("reward", F.col("event_id") % 7).where("reward between 1 and 5")
    return e.select("event_id", rd.rescale_reward(F.col("reward")).alias("partial_success"))


@query(f"WITH {_REWARDS} SELECT event_id, (reward - 1) / 4 AS partial_success FROM r")
def rescaled_rewards(spark, d):
    return _rewards(spark, d)


@query(f"WITH {_REWARDS} SELECT CAST(k AS INTEGER) AS reward, count(r.event_id) AS n FROM range(1, 6) t(k) LEFT JOIN (SELECT * FROM r WHERE reward <> 3) r ON reward = k GROUP BY 1")
def reward_histogram(spark, d):
    return rd.reward_histogram(_rewards(spark, d).where("partial_success <> 0.5"))


@query("""WITH s AS (SELECT user_id, event_id, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
 SELECT user_id, event_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS run FROM s""")
def sessionized(spark, d):
    return rd.sessionize(table(spark, d, "events").withColumn("part", F.col("user_id")), "event_type", "event_id").select("user_id", "event_id", "run")


@query("""WITH e AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 'success' ELSE 'failure' END AS split, o_orderkey AS index, o_custkey AS task, CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'failure' ELSE 'successful' END END AS correction FROM orders),
 l AS (SELECT *, coalesce(correction, split) AS label FROM e), g AS (SELECT * FROM l WHERE split = 'success' AND label IN ('success', 'successful'))
 SELECT index, task, 'successful' AS quality_label FROM g UNION ALL SELECT index, task, 'failure' FROM l WHERE split = 'failure' AND label = 'failure' AND task IN (SELECT task FROM g)""")
def confirmed_labels(spark, d):
    e = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "P", "success").otherwise("failure").alias("split"), F.col("o_orderkey").alias("index"), F.col("o_custkey").alias("task"))
    c = e.where("index % 5 = 0").select("split", "index", F.when(F.col("index") % 2 == 0, "failure").otherwise("successful").alias("correction"))
    return rd.confirmed_labels(e, c).select("index", "task", "quality_label")


@query(f"""WITH {TRAJ}, v AS (SELECT id, task, num_frames AS n FROM traj WHERE num_frames IS NOT NULL), c AS (SELECT id, 'line ' || l_linenumber AS task, least(greatest(l_linenumber - 3, 0), n) AS start, least(greatest(l_linenumber - 1, 0), n) AS stop, false AS full FROM v JOIN lineitem ON l_orderkey = id)
 SELECT id AS episode_id, task, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, "full" FROM (SELECT id, task, 0 AS start, n AS stop, true AS "full" FROM v UNION ALL SELECT id, task, start, stop, "full" FROM c) WHERE start < stop""")
def expanded_actions(spark, d):
    li = table(spark, d, "lineitem")
    actions = li.groupBy(F.col("l_orderkey").alias("episode_id")).agg(F.collect_list(F.struct(F.concat(F.lit("line "), "l_linenumber").alias("action_text"), (F.col("l_linenumber") - 3).alias("start_frame"), (F.col("l_linenumber") - 1).alias("end_frame"))).alias("actions"))
    t = trajectories(spark, d).where("num_frames is not null")
    episodes = t.select(F.col("id").alias("episode_id"), F.col("task").alias("task_name")).join(actions, "episode_id")
    return rd.expand_actions(t.select(F.col("id").alias("episode_id"), F.lit("f").alias("frames"), F.col("num_frames").alias("n")), episodes).select("episode_id", "task", "start", "stop", "full")


@query("""SELECT c_custkey, 'first' AS view, c_name AS frames FROM customer WHERE c_nationkey % 2 = 0 UNION ALL SELECT c_custkey, 'second', c_mktsegment FROM customer WHERE c_nationkey % 3 = 0""")
def camera_views(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 2 == 0, F.col("c_name")).alias("first"), F.when(F.col("c_nationkey") % 3 == 0, F.col("c_mktsegment")).alias("second"))
    return rd.views(c, ["first", "second"])


_FOLDERS = "SELECT o_orderkey, replace(o_orderpriority, '-', '_') || '_' || CASE o_orderstatus WHEN 'P' THEN 'succ' WHEN 'O' THEN 'close' ELSE 'other' END || '_' || (o_custkey % 9) AS folder FROM orders"


@query(f"""WITH f AS ({_FOLDERS}), p AS (SELECT *, string_split(folder, '_') AS x FROM f) SELECT o_orderkey AS frames, array_to_string(x[1:len(x) - 2], ' ') AS task, CASE x[-2] WHEN 'succ' THEN 'successful' ELSE 'suboptimal' END AS quality_label, x[-1] AS part FROM p WHERE x[-2] IN ('succ', 'close')""")
def folder_grammar(spark, d):
    o = table(spark, d, "orders")
    kind = F.when(F.col("o_orderstatus") == "P", "succ").when(F.col("o_orderstatus") == "O", "close").otherwise("other")
    files = o.select(F.col("o_orderkey").alias("path"), F.concat_ws("_", F.replace("o_orderpriority", F.lit("-"), F.lit("_")), kind, (F.col("o_custkey") % 9).cast("string")).alias("folder"))
    return rd.by_folder_grammar(files, {"succ": "successful", "close": "suboptimal"}).select("frames", "task", "quality_label", "part")


@query("""WITH p AS (SELECT p_partkey, p_name || ': ' || p_size AS task, p_partkey % 2 = 0 AS is_robot FROM part), b AS (SELECT task FROM p WHERE is_robot INTERSECT SELECT task FROM p WHERE NOT is_robot) SELECT task, is_robot, p_partkey AS frames FROM p WHERE task IN (SELECT task FROM b)""")
def shared_instructions(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("video_path"), F.col("p_name").alias("task_instruction"), F.col("p_size").cast("string").alias("motion_description"))
    return rd.shared_instructions(p.where("video_path % 2 = 1"), p.where("video_path % 2 = 0")).select("task", "is_robot", "frames")


_WORDS = "CASE o_orderstatus WHEN 'P' THEN 'success' WHEN 'O' THEN 'optimal' ELSE 'failed' END"


def _label_word():
    return F.when(F.col("o_orderstatus") == "P", "success").when(F.col("o_orderstatus") == "O", "optimal").otherwise("failed")


@query(f"""WITH w AS (SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN o_orderpriority WHEN o_custkey % 7 <> 0 THEN {_WORDS} END AS label FROM orders)
 SELECT o_orderkey, CASE WHEN label IN ('success', 'optimal') OR label IS NULL THEN 'successful' WHEN label = 'failed' THEN 'failure' ELSE label END AS quality_label FROM w""")
def quality_names(spark, d):
    label = F.when(F.col("o_custkey") % 5 == 0, F.col("o_orderpriority")).when(F.col("o_custkey") % 7 != 0, _label_word())
    return table(spark, d, "orders").select("o_orderkey", normalize_quality(label).alias("quality_label"))


@query("""WITH w AS (SELECT o_orderkey, replace(lower(o_orderpriority), ' ', '_') || '_' || o_custkey || CASE o_orderstatus WHEN 'P' THEN '_suboptimal' WHEN 'F' THEN '_failure' ELSE '' END AS folder,
 c_name || CASE o_orderstatus WHEN 'P' THEN '_Close_Succ_' WHEN 'F' THEN '_fail_succ_' ELSE '_SUCC_' END || o_orderkey AS stem FROM orders JOIN customer ON c_custkey = o_custkey)
 SELECT o_orderkey, CASE WHEN contains(folder, 'suboptimal') THEN 'suboptimal' WHEN contains(folder, 'failure') THEN 'failure' ELSE 'successful' END AS by_folder,
 CASE WHEN contains(lower(stem), 'close_succ') THEN 'suboptimal' WHEN contains(lower(stem), 'fail') THEN 'failure' ELSE 'successful' END AS by_stem FROM w""")
def quality_of_names(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    by = lambda p, f, other: F.when(F.col("o_orderstatus") == "P", p).when(F.col("o_orderstatus") == "F", f).otherwise(other)
    folder = F.concat(F.replace(F.lower("o_orderpriority"), F.lit(" "), F.lit("_")), F.lit("_"), "o_custkey", by("_suboptimal", "_failure", ""))
    stem = F.concat("c_name", by("_Close_Succ_", "_fail_succ_", "_SUCC_"), "o_orderkey")
    return o.select("o_orderkey", tx.quality_from_directory(folder).alias("by_folder"), tx.quality_from_stem(stem).alias("by_stem"))


@query(f"WITH {TRAJ}, g AS (SELECT task FROM traj GROUP BY 1 HAVING bool_or(rank = 3) AND bool_or(rank = 1)) SELECT id, task FROM traj WHERE task IN (SELECT task FROM g)")
def tasks_need_both(spark, d):
    return curate.keep_mixed_tasks(trajectories(spark, d)).select("id", "task")


@query(f"WITH {TRAJ} SELECT id, task FROM traj QUALIFY row_number() OVER (PARTITION BY task ORDER BY id) <= 3")
def first_of_folders(spark, d):
    return rd.cap_per_folder(trajectories(spark, d).withColumn("path", F.col("id")), "task", 3).select("id", "task")


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id WHEN 1 THEN event_id % 100 ELSE 0 END AS number FROM events""")
def frame_numbers(spark, d):
    k = F.col("event_id")
    name = F.when(k % 3 == 0, F.concat(F.lit("cam2_f"), k, F.lit(".png"))).when(k % 3 == 1, F.concat(F.lit("f"), k % 100, F.lit("_b"))).otherwise("none.png")
    return table(spark, d, "events").select("event_id", tx.frame_number(name).alias("number"))


@query("""SELECT n_nationkey, n_name AS model, CASE WHEN n_nationkey % 2 = 0 THEN 'r' || n_nationkey END AS revision, 'org_' || replace(n_name, ' ', '_') AS short FROM nation""")
def model_names(spark, d):
    n = table(spark, d, "nation")
    m = tx.model_and_revision(F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("@r"), "n_nationkey")).otherwise("")))
    return n.select("n_nationkey", m["model"].alias("model"), m["revision"].alias("revision"), tx.last_two_parts(F.concat(F.lit("/a/org/"), "n_name", F.lit("/"))).alias("short"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN '[1, ' || event_id || ']' WHEN 1 THEN '-' || (event_id % 10) || '.5' END AS answer FROM events""")
def reply_answers(spark, d):
    k = F.col("event_id")
    t = F.when(k % 3 == 0, F.concat(F.lit("so answer: [1, "), k, F.lit("] end"))).when(k % 3 == 1, F.concat(F.lit("ANSWER:-"), k % 10, F.lit(".5."))).otherwise("no")
    return table(spark, d, "events").select("event_id", tx.answer(t).alias("answer"))


@query(f"""WITH {TRAJ}, t AS (SELECT id, coalesce(num_frames, 0) AS n FROM traj), f AS (SELECT *, CASE WHEN n = 0 THEN [] ELSE list_transform(range(1, n + 1), lambda k: k * 10.0) END AS v FROM t)
 SELECT id, array_to_string(list_transform(range(5), lambda k: CASE WHEN n = 0 THEN 0 ELSE CAST(round(v[least(k + 1, n)]) AS BIGINT) END), ',') AS percent FROM f""")
def fitted_lengths(spark, d):
    n = F.coalesce("num_frames", F.lit(0))
    v = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: k * 10.0))
    return trajectories(spark, d).select("id", _joined(F.transform(models.fit_length(v, F.lit(5)), lambda x: F.rint(x * 100).cast("bigint"))).alias("percent"))


@query(f"WITH {TRAJ}, p AS (SELECT a.id a, b.id b FROM traj a JOIN traj b ON a.task = b.task AND a.rank > b.rank AND a.is_robot AND b.is_robot) SELECT a AS a_id, b AS b_id, CAST(1 AS DOUBLE) AS label FROM p")
def preference_sides(spark, d):
    from tracklake.operators import pairs

    p = pairs.quality_pairs(trajectories(spark, d)).withColumn("id", F.col("chosen_id"))
    return models.preference_view(p, 1, False).select("a_id", "b_id", r6(F.col("label")).alias("label"))
