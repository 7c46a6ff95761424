"""Queries over binary files that are written from the test tables and read back, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklake.functions import text as tx
from tracklake.plans.canonical import TRAJ, table, trajectories
from tracklake.plans.queries import query
from tracklake.sources import archives, hdf5, rlds
from tracklake.sources.shared import fresh_folder

#: An order of an order's lines without ties.
_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
_NONE = {"bytes": "array<binary>", "floats": "array<float>", "ints": "array<bigint>"}


def _feature(**given):
    return F.struct(*[(given[k] if k in given else F.lit(None)).cast(t).alias(k) for k, t in _NONE.items()])


@query(f"""WITH f AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS k, l_partkey || '-' || CAST(l_quantity AS INTEGER) AS a, CASE WHEN l_orderkey % 3 = 0 AND row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) = 1 THEN chr(0) || chr(0) ELSE l_suppkey || '' END AS b FROM lineitem),
 e AS (SELECT id, CASE WHEN id % 10 = 0 THEN 'val' ELSE 'train' END AS split, count(*) AS n, md5(string_agg(a, '' ORDER BY k)) AS a, md5(string_agg(b, '' ORDER BY k)) AS b FROM f GROUP BY id)
 SELECT 'order ' || id AS task, split, 'primary' AS view, CAST(n AS INTEGER) AS num_frames, a AS frames FROM e UNION ALL SELECT 'order ' || id, split, 'secondary', CAST(n AS INTEGER), b FROM e WHERE id % 3 <> 0""")
def rlds_views(spark, d):
    """Each order as an episode: written as two splits of framed records, read in splits of bytes, a view with a black first frame left out."""
    li = table(spark, d, "lineitem").withColumn("k", F.row_number().over(_lines()))
    a = F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_quantity").cast("int").cast("string"))
    b = F.when((F.col("l_orderkey") % 3 == 0) & (F.col("k") == 1), F.unhex(F.lit("0000"))).otherwise(F.col("l_suppkey").cast("string").cast("binary"))
    steps = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("k", a.cast("binary").alias("a"), b.alias("b")))).alias("s"))
    text = F.array(F.concat(F.lit("order "), "l_orderkey").cast("binary"))
    pairs = [("steps/language_instruction", _feature(bytes=text)), ("steps/observation/image", _feature(bytes=F.col("s.a"))), ("steps/observation/side", _feature(bytes=F.col("s.b")))]
    episodes = steps.select("l_orderkey", F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)]).alias("features"))
    path = fresh_folder(spark, "rlds")
    held = F.col("l_orderkey") % 10 == 0
    rlds.write_records(episodes.where(~held), path, "orders", "train")
    rlds.write_records(episodes.where(held), path, "orders", "val")
    views = {"primary": "image", "secondary": "side", "wrist": "wrist"}
    parts = [rlds.camera_rows(rlds.read_records(spark, path, 1 << 18, rlds.chosen_split(path, e)), views).withColumn("split", F.lit(s)) for e, s in ((False, "train"), (True, "val"))]
    joined = F.md5(F.unhex(F.array_join(F.transform("frames", lambda f: F.hex(f)), "")))
    return parts[0].unionByName(parts[1]).select("task", "split", "view", "num_frames", joined.alias("frames"))


def _lines():
    from pyspark.sql import Window

    return Window.partitionBy("l_orderkey").orderBy(*_ORDER.split(", "))


@query(f"""WITH {TRAJ}, v AS (SELECT id, task, num_frames AS n, camera FROM traj, (VALUES ('head_color'), ('hand_left')) c(camera) WHERE num_frames IS NOT NULL),
 c AS (SELECT id, camera, 'line ' || l_linenumber AS task, least(greatest(l_linenumber - 3, 0), n) AS start, least(greatest(l_linenumber - 1, 0), n) AS stop FROM v JOIN lineitem ON l_orderkey = id)
 SELECT id AS episode_id, camera, task, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, "full" FROM (SELECT id, camera, task, 0 AS start, n AS stop, true AS "full" FROM v UNION ALL SELECT id, camera, task, start, stop, false FROM c) WHERE start < stop""")
def archive_clips(spark, d):
    """Each order's lines as videos of three cameras in archives of a thousand orders: two cameras' members are read by ranges, and cut by the lines."""
    t = trajectories(spark, d).where("num_frames is not null").select("id", "task", "num_frames")
    camera = F.explode(F.array(*map(F.lit, ["head_color", "hand_left", "back"]))).alias("camera")
    members = t.select("id", "num_frames", camera).select(tx.stable_shard(F.col("id").cast("string")).alias("archive"), F.concat_ws("/", F.col("id").cast("string"), F.lit("videos"), "camera").alias("member"), F.repeat(F.lpad(F.col("id").cast("string"), 16, "0"), F.col("num_frames")).cast("binary").alias("payload"))
    path = fresh_folder(spark, "archives")
    archives.save_archives(members, path).agg(F.sum("members")).collect()
    cameras = ["head_color", "hand_left"]
    index = archives.tar_index(spark, path).where(F.element_at(F.split("member", "/"), -1).isin(cameras))
    actions = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("episode_id")).agg(F.collect_list(F.struct(F.concat(F.lit("line "), "l_linenumber").alias("action_text"), (F.col("l_linenumber") - 3).alias("start_frame"), (F.col("l_linenumber") - 1).alias("end_frame"))).alias("actions"))
    episodes = t.select(F.col("id").alias("episode_id"), F.col("task").alias("task_name")).join(actions, "episode_id")
    # A frame is 16 bytes that name its episode.
    frames = F.when(F.substring("payload", 1, 16).cast("string").try_cast("bigint") == F.split_part("member", F.lit("/"), F.lit(1)).cast("bigint"), F.octet_length("payload") / 16).otherwise(0)
    return archives.clips(archives.tar_contents(index, 1 << 20), episodes, cameras, frames).select("episode_id", "camera", "task", "start", "stop", "full")


@query(f"""SELECT l_orderkey AS id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) - 1 AS BIGINT) AS row, round(l_quantity, 4) AS x, round(l_discount, 4) AS y, CAST(count(*) OVER (PARTITION BY l_orderkey) AS BIGINT) AS n_actions FROM lineitem""")
def scene_actions(spark, d):
    """Each order's lines as the actions of a demonstration, a thousand orders a file: objects and rows of the arrays."""
    li = table(spark, d, "lineitem")
    file = F.concat(F.lit("KITCHEN_SCENE1_sort_the_lines_"), tx.stable_shard(F.col("l_orderkey").cast("string")))
    rows = li.select(file.alias("file"), F.format_string("data/demo_%d/actions", "l_orderkey").alias("name"), (F.row_number().over(_lines()) - 1).cast("bigint").alias("row"), F.array(F.col("l_quantity").cast("double"), F.col("l_discount").cast("double")).alias("values"))
    path = fresh_folder(spark, "scenes")
    hdf5.save_arrays(rows, path).agg(F.sum("arrays")).collect()
    files = hdf5.files(spark, path)
    number = lambda c: F.regexp_extract(c, r"demo_(\d+)", 1).cast("bigint")
    demos = hdf5.scene_demos(hdf5.members(files)).where("task like 'sort the lines shard%'").select(number("demo").alias("id"), "n_actions")
    got = hdf5.array_rows(files, "data/*/actions").where("error is null")
    return got.select(number("name").alias("id"), "row", F.round(F.col("values")[0], 4).alias("x"), F.round(F.col("values")[1], 4).alias("y")).join(demos, "id")
