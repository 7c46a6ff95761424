"""Queries over folder layouts, metadata lists, task tables and replies made of the test tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklake.functions import frames as fr
from tracklake.functions import text as tx
from tracklake.operators import curate, pairs, sampling
from tracklake.plans.canonical import TRAJ, table, trajectories
from tracklake.plans.queries import _joined, query, r6
from tracklake.sources import layouts
from tracklake.sources import readers as rd
from tracklake.sources.shared import fresh_folder

_STATUS = "CASE o_orderstatus WHEN 'P' THEN 'success' WHEN 'O' THEN 'suboptimal' ELSE 'failure' END"
_LABEL = "CASE o_orderstatus WHEN 'P' THEN 'successful' WHEN 'O' THEN 'suboptimal' ELSE 'failure' END"


def _status():
    return F.when(F.col("o_orderstatus") == "P", "success").when(F.col("o_orderstatus") == "O", "suboptimal").otherwise("failure")


@query(f"""WITH f AS (SELECT o_orderpriority AS k, '/d/' || o_orderpriority || '/' || CASE WHEN o_custkey % 11 = 0 THEN 'other' ELSE {_STATUS} END || '/' || o_orderkey || '_' || CASE o_orderkey % 3 WHEN 0 THEN 'ext' WHEN 1 THEN 'wrist' ELSE 'top' END || '.mp4' AS path, o_orderkey % 3 AS v,
  CASE WHEN o_custkey % 11 = 0 THEN 0 ELSE CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 3 ELSE 2 END END AS place FROM orders),
 e AS (SELECT *, row_number() OVER (ORDER BY k, place, path) - 1 AS i, CASE v WHEN 0 THEN 'ext' ELSE 'wrist' END AS part FROM f WHERE v < 2 AND place > 0 AND k <> '5-LOW')
 SELECT 'do ' || k AS task, path AS source_path, 'frankas/shard_' || lpad(CAST(i // 1000 AS VARCHAR), 4, '0') || '/episode_' || lpad(CAST(i AS VARCHAR), 6, '0') || '/' || part || '.mp4' AS frames,
  CASE place WHEN 1 THEN 'suboptimal' WHEN 2 THEN 'failure' ELSE 'successful' END AS quality_label, part, i AS episode_index, true AS is_robot FROM e""")
def quality_folders(spark, d):
    o = table(spark, d, "orders")
    quality = F.when(F.col("o_custkey") % 11 == 0, "other").otherwise(_status())
    view = F.when(F.col("o_orderkey") % 3 == 0, "ext").when(F.col("o_orderkey") % 3 == 1, "wrist").otherwise("top")
    files = o.select(F.concat(F.lit("/d/"), "o_orderpriority", F.lit("/"), quality, F.lit("/"), "o_orderkey", F.lit("_"), view, F.lit(".mp4")).alias("path"))
    known = o.where("o_orderpriority <> '5-LOW'").select(F.col("o_orderpriority").alias("task_name"), F.concat(F.lit("do "), "o_orderpriority").alias("instruction")).distinct()
    return layouts.quality_folders(files, known, "Frankas")


@query(f"""SELECT 'do ' || o_orderpriority AS task, o_orderkey || '.mp4' AS file, 'prank/shard_' || lpad(CAST(o_orderkey // 1000 AS VARCHAR), 4, '0') || '/episode_' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') || '/' || o_orderpriority || '.mp4' AS frames,
 {_LABEL} AS quality_label FROM orders WHERE o_custkey % 9 <> 0""")
def metadata_lists(spark, d):
    """One list a priority and remainder, one a line; entries without an instruction are left out."""
    status = F.when(F.col("o_orderstatus") == "P", "success").when(F.col("o_orderstatus") == "O", "suboptimal").otherwise("fail")
    entry = F.struct(
        F.concat("o_orderkey", F.lit(".mp4")).alias("filename"), status.alias("success"), F.when(F.col("o_custkey") % 9 != 0, F.concat(F.lit("do "), "o_orderpriority")).alias("instruction"),
        F.col("o_orderpriority").alias("task_name"), F.col("o_orderkey").alias("episode_idx"),
    )
    lists = table(spark, d, "orders").groupBy("o_orderpriority", (F.col("o_orderkey") % 64).alias("k")).agg(F.to_json(F.collect_list(entry)).alias("value"))
    path = fresh_folder(spark, "lists")
    lists.select("value").write.text(path)
    out = layouts.metadata_episodes(spark, path, "Prank", "part-*", whole=False)
    return out.select("task", layouts.path_part(F.col("source_path"), -1).alias("file"), "frames", "quality_label")


_IMAGES = """im AS (SELECT l_returnflag AS t, l_orderkey AS seed, CASE WHEN l_linenumber % 3 = 0 AND l_returnflag <> 'N' THEN 'Ground_Truth' ELSE 'try_' || (l_linenumber % 3) END AS attempt,
 CASE l_partkey % 4 WHEN 0 THEN 'front' WHEN 1 THEN 'side' WHEN 2 THEN 'wrist' ELSE 'top' END AS view, CASE WHEN l_suppkey % 4 = 0 THEN 'x' ELSE '' END || l_suppkey AS stem FROM lineitem)"""


def _images(spark, d):
    li = table(spark, d, "lineitem")
    attempt = F.when((F.col("l_linenumber") % 3 == 0) & (F.col("l_returnflag") != "N"), "Ground_Truth").otherwise(F.concat(F.lit("try_"), F.col("l_linenumber") % 3))
    k = F.col("l_partkey") % 4
    view = F.when(k == 0, "front").when(k == 1, "side").when(k == 2, "wrist").otherwise("top")
    stem = F.concat(F.when(F.col("l_suppkey") % 4 == 0, "x").otherwise(""), F.col("l_suppkey"))
    return li.select(F.concat_ws("/", F.lit("/d"), "l_returnflag", "l_orderkey", attempt, view, F.concat(stem, F.lit(".png"))).alias("path"))


@query(f"""WITH {_IMAGES}, e AS (SELECT CASE t WHEN 'A' THEN 'push the cube' ELSE t END AS task, CAST(seed AS VARCHAR) AS seed, attempt, view, string_agg(stem, ',' ORDER BY TRY_CAST(stem AS BIGINT) NULLS LAST, stem) AS images, CASE attempt WHEN 'Ground_Truth' THEN 'successful' ELSE 'failure' END AS quality_label FROM im WHERE view <> 'top' GROUP BY ALL)
 SELECT * FROM e WHERE task IN (SELECT task FROM e GROUP BY 1 HAVING count(DISTINCT quality_label) = 2)""")
def attempt_episodes(spark, d):
    """Whole episodes by task, seed, attempt and view, of tasks with a success and a failure."""
    known = table(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_returnflag").alias("task_name"), F.lit("push the cube").alias("instruction")).distinct()
    out = curate.keep_mixed_tasks(layouts.attempt_episodes(_images(spark, d), known))
    names = F.transform("images", lambda p: F.regexp_extract(p, r"([^/]*)\.png$", 1))
    return out.withColumn("images", F.array_join(names, ","))


@query("""WITH l AS (SELECT DISTINCT 'task ' || (o_custkey % 5) AS t, o_orderkey AS ep, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS label FROM orders WHERE o_custkey % 7 <> 0),
 f AS (SELECT 'task ' || (o_custkey % 5) AS t, o_orderkey AS ep, l_partkey AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 e AS (SELECT t, ep, label, list(n ORDER BY n)[3:] AS n FROM f JOIN l USING (t, ep) WHERE t <> 'task 4' GROUP BY ALL)
 SELECT 'do ' || t AS task, CAST(ep AS INTEGER) AS episode, array_to_string(n, ',') AS images, 'fino/' || t || '/episode_' || lpad(CAST(ep AS VARCHAR), 6, '0') || '/clip.mp4' AS frames, CASE label WHEN 1 THEN 'failure' ELSE 'successful' END AS quality_label FROM e WHERE len(n) > 0""")
def numbered_episodes(spark, d):
    """Annotation files, one a task, joined to the images of the episodes; the first two frames are left out."""
    o = table(spark, d, "orders").withColumn("t", F.concat(F.lit("task "), F.col("o_custkey") % 5))
    path = fresh_folder(spark, "annotations")
    names = [f"task {k}" for k in range(5)]
    labels = o.where("o_custkey % 7 <> 0").select("t", F.col("o_orderkey").alias("episode"), (F.col("o_orderstatus") != "P").cast("int").alias("label"))
    labels.withColumn("folder", F.col("t")).drop("t").write.partitionBy("folder").option("header", True).csv(path)
    read = rd.episode_labels(spark, {n: f"{path}/folder={n}" for n in names})
    images = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat_ws("/", F.lit("/d"), "t", "o_orderkey", F.concat(F.lit("frame"), F.format_string("%07d", "l_partkey"), F.lit(".png"))).alias("path"))
    known = o.where("t <> 'task 4'").select(F.col("t").alias("task_name"), F.concat(F.lit("do "), "t").alias("instruction")).distinct()
    out = layouts.numbered_episodes(images, read, known, "Fino", skip=2)
    return out.select("task", "episode", _joined(F.transform("images", tx.frame_number)).alias("images"), "frames", "quality_label")


@query("""WITH t AS (SELECT c_nationkey AS k, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer),
 s AS (SELECT k, c_name AS task, k || CASE k % 3 WHEN 0 THEN '_Suboptimal' WHEN 1 THEN '_failure' ELSE '_good' END AS dataset, CASE k % 3 WHEN 0 THEN 'suboptimal' WHEN 1 THEN 'failure' ELSE 'successful' END AS quality_label FROM t WHERE n = 1)
 SELECT task, '/v/' || dataset || '/videos/front/' || c_custkey || '.mp4' AS frames, dataset, quality_label FROM customer JOIN s ON k = c_nationkey""")
def dataset_videos(spark, d):
    """Task tables of datasets, one a folder, whose first rows name the tasks of the datasets' videos."""
    c = table(spark, d, "customer")
    k = F.col("c_nationkey") % 3
    name = F.concat(F.col("c_nationkey").cast("string"), F.when(k == 0, "_Suboptimal").when(k == 1, "_failure").otherwise("_good"))
    path = fresh_folder(spark, "tasks")
    rows = c.select(name.alias("dataset"), F.col("c_custkey").alias("task_index"), F.lit(" ").alias("blank"), F.col("c_name").alias("text"))
    rows.repartition("dataset").sortWithinPartitions("dataset", "task_index").write.partitionBy("dataset").parquet(path)
    tasks = layouts.first_task_texts(spark, path, up=2).withColumn("dataset", F.replace("dataset", F.lit("dataset="), F.lit("")))
    files = c.select(F.concat(F.lit("/v/"), name, F.lit("/videos/front/"), "c_custkey", F.lit(".mp4")).alias("path"))
    return layouts.dataset_videos(files, tasks).select("task", "frames", "dataset", "quality_label")


@query(f"""WITH {TRAJ}, t AS (SELECT id, num_frames AS n, reward FROM traj WHERE num_frames IS NOT NULL)
 SELECT id, CASE WHEN id % 5 = 0 THEN '' ELSE array_to_string(list_transform(list_filter(range(n), lambda i: (n - 1 - i) % 3 <> 2), lambda i: CAST((id + n - 1 - i) % 101 AS BIGINT)), ',') END AS percent FROM t""")
def reply_completions(spark, d):
    """Replies on frames that are shown from the last to the first: a fenced list, with every third place left out; some cannot be read."""
    t = trajectories(spark, d).where("num_frames is not null")
    places = F.filter(F.sequence(F.lit(0), F.col("num_frames") - 1), lambda j: j % 3 != 2)
    item = lambda j: F.struct(j.alias("frame_number"), ((F.col("id") + j) % 101).cast("double").alias("task_completion_percentage"))
    body = F.concat(F.lit("Here:\n```json\n"), F.to_json(F.transform(places, item)), F.lit("\n```\nDone."))
    reply = F.when(F.col("id") % 5 == 0, F.concat(F.lit("no list for "), F.col("id"))).otherwise(body)
    shown = F.sequence(F.col("num_frames") - 1, F.lit(0), F.lit(-1))
    return t.select("id", _joined(F.transform(tx.reply_completion(reply, shown), lambda x: F.rint(x * 100).cast("bigint"))).alias("percent"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 4 = 0 THEN c_name ELSE CAST(c_custkey AS VARCHAR) END AS episode, CASE WHEN c_nationkey % 4 <> 0 THEN c_mktsegment END AS camera FROM customer""")
def archive_keys(spark, d):
    c = table(spark, d, "customer")
    key = F.when(F.col("c_nationkey") % 4 == 0, F.concat("c_name", F.lit("/x"))).otherwise(F.concat_ws("/", F.col("c_custkey").cast("string"), F.lit("videos"), "c_mktsegment"))
    parts = tx.episode_and_camera(key)
    return c.select("c_custkey", parts["episode"].alias("episode"), parts["camera"].alias("camera"))


@query(f"WITH {TRAJ} SELECT a.id AS chosen_id, b.id AS rejected_id FROM traj a JOIN traj b ON a.task = b.task AND a.partial_success > b.partial_success WHERE a.is_robot AND b.is_robot")
def raw_partial_success_pairs(spark, d):
    return pairs.partial_success_pairs(trajectories(spark, d), digits=None).select("chosen_id", "rejected_id")


@query(f"""WITH {TRAJ}, t AS (SELECT id, num_frames AS n FROM traj WHERE num_frames IS NOT NULL), m AS (SELECT *, list_transform(range(2), lambda i: CAST(floor(1 + (i + 0.5::DOUBLE) * (n - 2) / 2) AS BIGINT)) AS mid FROM t)
 SELECT id, array_to_string(CASE WHEN n <= 4 THEN range(n) ELSE list_sort(list_distinct(list_concat([0], mid, [n - 1]))) END, ',') AS indices FROM m""")
def frames_ends_and_middle(spark, d):
    return trajectories(spark, d).where("num_frames is not null").select("id", _joined(fr.ends_and_middle_indices(F.col("num_frames"), 4)).alias("indices"))


@query(f"""WITH {TRAJ}, t AS (SELECT id, num_frames AS n, partial_success AS ps FROM traj WHERE num_frames IS NOT NULL), v AS (SELECT *, list_transform(range(n), lambda i: ps * (i + 1) / n * 9) AS x FROM t)
 SELECT id, round(list_sum(list_transform(x, lambda a: floor(a) / 9 * (1 - (a - floor(a))) + least(floor(a) + 1, 9) / 9 * (a - floor(a)))), 6) AS soft, round(list_sum(list_transform(x, lambda a: round_even(a, 0) / 9)), 6) AS hard, CAST(n * 10 AS INTEGER) AS cells FROM v""")
def bin_series(spark, d):
    """Two-hot rows of a series of progress values, back to their values; and the centres of their bins."""
    t = trajectories(spark, d).where("num_frames is not null")
    x = F.transform(F.sequence(F.lit(1), F.col("num_frames")), lambda i: F.col("partial_success") * i / F.col("num_frames"))
    rows = t.withColumn("x", x).withColumn("hot", fr.two_hot_series(F.col("x"), 10))
    total = lambda c: r6(F.aggregate(c, F.lit(0.0), lambda a, y: a + y))
    return rows.select("id", total(F.transform("hot", lambda h: fr.bins_to_value(h, True))).alias("soft"), total(F.transform("x", lambda v: fr.bin_center(fr.discrete_bin(v, 10), 10))).alias("hard"), F.size(F.flatten("hot")).alias("cells"))


@query(f"""WITH {TRAJ}, t AS (SELECT id, num_frames AS n FROM traj WHERE num_frames IS NOT NULL)
 SELECT id, array_to_string(list_concat(list_transform(range(greatest(0, 8 - n)), lambda i: 10), list_transform(range(n), lambda i: (i + 1) * 10)), ',') AS left_padded, array_to_string(list_transform(range(5), lambda i: CASE WHEN i = 4 THEN n ELSE CAST(floor(1 + i * ((n - 1) / 4::DOUBLE)) AS BIGINT) END), ',') AS ends FROM t""")
def frames_left_padded(spark, d):
    t = trajectories(spark, d).where("num_frames is not null")
    v = F.transform(F.sequence(F.lit(1), F.col("num_frames")), lambda i: i * 10)
    return t.select("id", _joined(fr.pad(v, 8, left=True)).alias("left_padded"), _joined(fr.spaced_ends(F.col("num_frames"), 5)).alias("ends"))


@query("""WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN 'people' ELSE 'stretch' END AS kind FROM part) SELECT p_partkey, p_partkey % 3 <> 2 AS is_robot FROM r""")
def robots_by_path(spark, d):
    p = table(spark, d, "part")
    path = F.concat_ws("/", F.lit("/m"), "p_brand", F.when(F.col("p_partkey") % 3 == 2, "human_motion").otherwise("Stretch_motion"), "p_name")
    return p.select("p_partkey", layouts.robot_of_path(path).alias("is_robot"))


@query(f"""WITH {TRAJ}, s AS (SELECT task FROM traj GROUP BY 1 HAVING count(DISTINCT partial_success) > 1), r AS (SELECT id, task, partial_success, row_number() OVER (PARTITION BY task, partial_success ORDER BY md5('7|circular|' || id), id) AS r FROM traj WHERE task IN (SELECT task FROM s))
 SELECT id, task, CAST(row_number() OVER (PARTITION BY task ORDER BY r, partial_success) AS INTEGER) AS place FROM r QUALIFY row_number() OVER (PARTITION BY task ORDER BY r, partial_success) <= 7""")
def circular_samples(spark, d):
    """Seven rows of each task, taken in turn from its partial successes."""
    return sampling.circular(trajectories(spark, d), "task", "partial_success", 7, 7, "circular").select("id", "task", "place")


@query(f"""WITH {TRAJ}, p AS (SELECT a.task, concat_ws('-', a.id, b.id) AS id FROM traj a JOIN traj b ON a.task = b.task AND a.rank > b.rank AND a.is_robot AND b.is_robot), c AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY task ORDER BY md5('7|pairs of a task|' || id), id) <= 3)
 SELECT id, task FROM c ORDER BY md5('7|pairs|' || id), id LIMIT 500""")
def capped_pairs(spark, d):
    """Quality pairs, at most three of a task and five hundred in all."""
    p = pairs.quality_pairs(trajectories(spark, d)).select(F.col("chosen_task").alias("task"), F.concat_ws("-", F.col("chosen_id").cast("string"), F.col("rejected_id").cast("string")).alias("id"))
    return sampling.cap_pairs(p, 3, 500, 7).select("id", "task")


@query(f"WITH {TRAJ} SELECT id, task FROM traj WHERE rank = 3 AND CAST(task AS BIGINT) IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) ORDER BY md5('7|allowed|' || id), id LIMIT 400")
def allowed_successes(spark, d):
    tasks = table(spark, d, "customer").where("c_nationkey < 12").select(F.col("c_custkey").cast("string").alias("task"))
    return sampling.allowed_successes(trajectories(spark, d), tasks, 400, 7).select("id", "task")


@query("""WITH a AS (SELECT n_nationkey AS k, n_name, n_regionkey % 2 = 1 AS is_robot FROM nation WHERE n_nationkey % 5 <> 0), c AS (SELECT c_nationkey AS k, c_name, c_custkey, unnest(['right', 'left']) AS part FROM customer)
 SELECT n_name AS task_name, c_name AS task, '/p/' || c_custkey AS frames, is_robot, part FROM c JOIN a USING (k) WHERE (part = 'right' AND c_custkey % 2 = 0) OR (part = 'left' AND c_custkey % 3 = 0)""")
def camera_rows(spark, d):
    """Files of tasks with attributes in one JSON text, a row for each camera that a file holds."""
    n = table(spark, d, "nation")
    kind = F.struct(F.when(F.col("n_regionkey") % 2 == 1, "two_arms").otherwise("a_Human").alias("embodiment_type"))
    attributes = n.where("n_nationkey % 5 <> 0").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", kind)))).alias("per_task_attributes"))
    has = F.array_compact(F.array(F.when(F.col("c_custkey") % 2 == 0, "right"), F.when(F.col("c_custkey") % 3 == 0, "left"), F.lit("top")))
    files = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("task_name"), F.concat(F.lit("/p/"), "c_custkey").alias("path"), F.col("c_name").alias("description"), has.alias("cameras"))
    return layouts.camera_rows(files, attributes)


@query("""WITH s AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
 r AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS run FROM s)
 SELECT user_id, run, min(event_id) AS "first", max(event_id) AS "last", count(*) AS n, 'do ' || event_type AS task FROM r WHERE event_type <> (SELECT min(event_type) FROM events) GROUP BY user_id, run, event_type""")
def runs_of_tasks(spark, d):
    e = table(spark, d, "events").withColumn("part", F.col("user_id"))
    least = e.agg(F.min("event_type").alias("least"))  # one row
    tasks = e.select("event_type").distinct().join(F.broadcast(least), F.col("event_type") != F.col("least")).select("event_type", F.concat(F.lit("do "), "event_type").alias("task"))
    runs = layouts.runs_of_tasks(rd.sessionize(e, "event_type", "event_id"), tasks, "event_type", "event_id")
    return runs.select(F.col("part").alias("user_id"), "run", "first", "last", "n", "task")


@query("""WITH f AS (SELECT o_orderpriority AS folder, o_orderkey || CASE o_orderstatus WHEN 'P' THEN '_Closs_Succ' WHEN 'F' THEN '_fail_succ' ELSE '_Succ' END AS stem, o_orderkey, o_custkey FROM orders),
 g AS (SELECT *, '/c/' || folder || '/' || stem || '.gif' AS path FROM f), h AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY folder ORDER BY path) <= 200)
 SELECT 'task ' || o_custkey AS task, path AS frames, folder, CASE WHEN contains(stem, 'Closs') THEN 'suboptimal' WHEN contains(stem, 'fail') THEN 'failure' ELSE 'successful' END AS quality_label FROM h WHERE o_custkey % 4 <> 0""")
def labelled_clips(spark, d):
    o = table(spark, d, "orders")
    word = F.when(F.col("o_orderstatus") == "P", "_Closs_Succ").when(F.col("o_orderstatus") == "F", "_fail_succ").otherwise("_Succ")
    files = o.select(F.concat(F.lit("/c/"), "o_orderpriority", F.lit("/"), "o_orderkey", word, F.lit(".gif")).alias("path"))
    known = o.where("o_custkey % 4 <> 0").select(F.col("o_orderkey").cast("string").alias("episode"), F.concat(F.lit("task "), "o_custkey").alias("task"))
    return layouts.labelled_clips(files, known, 200)


@query(f"""WITH {_IMAGES}, e AS (SELECT CASE t WHEN 'A' THEN 'push the cube' ELSE t END AS task, view, string_agg(stem, ',' ORDER BY TRY_CAST(stem AS BIGINT) NULLS LAST, stem) AS images, CASE attempt WHEN 'Ground_Truth' THEN 'successful' ELSE 'failure' END AS quality_label FROM im WHERE view <> 'top' GROUP BY t, seed, attempt, view),
 s AS (SELECT CASE WHEN o_custkey % 3 = 0 THEN 'A' ELSE 'grasp ' || (o_custkey % 10) END AS task, CASE o_orderkey % 2 WHEN 0 THEN 'front' ELSE 'wrist' END AS view, CAST(o_orderkey AS VARCHAR) AS images, CASE WHEN o_orderstatus = 'F' THEN 'failure' ELSE 'successful' END AS quality_label FROM orders),
 u AS (SELECT * FROM e UNION ALL SELECT * FROM s) SELECT * FROM u WHERE task IN (SELECT task FROM u GROUP BY 1 HAVING count(DISTINCT quality_label) = 2)""")
def failure_episodes(spark, d):
    """Whole episodes and all sub-episodes of three views."""
    o = table(spark, d, "orders")
    image = F.concat(F.lit("/d/"), F.when(F.col("o_orderkey") % 2 == 0, "front").otherwise("wrist"), F.lit("/"), "o_orderkey", F.lit(".png"))
    rows = o.select(
        F.lit("A").alias("task"), F.lit("A").alias("instruction"), F.when(F.col("o_custkey") % 3 == 0, "").otherwise(F.concat(F.lit("grasp "), F.col("o_custkey") % 10)).alias("sub_task"),
        F.when(F.col("o_orderstatus") == "F", "slip").when(F.col("o_orderstatus") == "O", "None").alias("failure_type"), F.array(image, F.lit("/d/top/1.png")).alias("image"),
    )
    known = table(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_returnflag").alias("task_name"), F.lit("push the cube").alias("instruction")).distinct()
    out = layouts.failure_episodes(_images(spark, d), rows, known, 7, part=1.0)
    return out.select("task", "view", F.array_join(F.transform("images", lambda p: F.regexp_extract(p, r"([^/]*)\.png$", 1)), ",").alias("images"), "quality_label")
