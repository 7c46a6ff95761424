"""Readers of raw sources: metadata becomes the canonical trajectory table; frames stay behind a path.

Each reader takes DataFrames or a path and declares its logic as a projection, a join or
an ``explode``.  Files are only read by Spark's readers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklake.functions import text as tx
from tracklake.schema import normalize_quality


def canonical(df: DataFrame, source: str | Column | None = None) -> DataFrame:
    """The canonical columns with their defaults; the id is a hash of what names the row."""
    have = set(df.columns)
    col = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in have else F.lit(default)
    name = source if isinstance(source, Column) else F.lit(source) if source is not None else F.col("data_source")
    return df.where(F.col("frames").isNotNull()).select(
        F.sha2(F.concat_ws("\x1f", name, F.col("task"), F.col("frames").cast("string"), col("part", "").cast("string")), 256).alias("id"),
        F.col("task"), name.alias("data_source"), F.col("frames"), col("is_robot", False).alias("is_robot"),
        normalize_quality(F.col("quality_label") if "quality_label" in have else F.lit(None).cast("string")).alias("quality_label"),
        (F.col("partial_success").cast("float") if "partial_success" in have else F.lit(None).cast("float")).alias("partial_success"),
    )


def list_files(spark: SparkSession, path: str, suffixes: Sequence[str]) -> DataFrame:
    """(path, name, folder, stem) of files by extension; the contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    parts = F.split("path", "/")
    ends = F.lit(False)
    for s in suffixes:
        ends = ends | F.endswith(F.lower("path"), F.lit(s.lower()))
    return files.where(ends).select("path", F.try_element_at(parts, F.lit(-1)).alias("name"), F.try_element_at(parts, F.lit(-2)).alias("folder"), F.regexp_replace("path", r"\.[^./]*$", "").alias("stem"))


def with_sibling(files: DataFrame, siblings: DataFrame) -> DataFrame:
    """Files that have a sibling of the same stem."""
    return files.join(siblings.select("stem").distinct(), "stem", "left_semi")


def first_limit(df: DataFrame, k: int | None, *order: str) -> DataFrame:
    """At most k rows in a stated order; null or negative: all."""
    return df if k is None or k < 0 else df.orderBy(*order).limit(k)


# ---- delimited and line formats -----------------------------------------------------------


def clip_csv(spark: SparkSession, path: str) -> DataFrame:
    """participant_id, video_id, narration, narration_id, start_frame, stop_frame; rows that cannot be read are dropped."""
    raw = spark.read.option("header", "true").csv(path)
    texts = ("participant_id", "video_id", "narration", "narration_id")
    out = raw.select(*[F.trim(c).alias(c) for c in texts], *[F.trim(c).try_cast("int").alias(c) for c in ("start_frame", "stop_frame")])
    return out.dropna(subset=[*texts, "start_frame", "stop_frame"])


def clip_paths(clips: DataFrame, root: str) -> DataFrame:
    """Clips as trajectories: the video's path, and the part by its frames."""
    path = F.concat_ws("/", F.lit(root), "participant_id", F.lit("videos"), F.concat("video_id", F.lit(".MP4")))
    return clips.select(F.col("narration").alias("task"), path.alias("frames"), F.concat_ws("-", "start_frame", "stop_frame").alias("part"))


def reward_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """{file_name, task, reward 1..5}: partial success (r - 1) / 4, source from the first part of the path; bad lines are dropped."""
    raw = spark.read.schema("file_name string, task string, reward int, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = raw.where("_bad is null and file_name is not null and task is not null and reward between 1 and 5")
    head = F.split_part("file_name", F.lit("/"), F.lit(1))
    return rows.select("task", F.col("file_name").alias("frames"), rescale_reward(F.col("reward")).alias("partial_success"), F.concat(F.lit("roboreward_"), F.when(head == "robo_arena", "roboarena").otherwise(head)).alias("data_source"))


def rescale_reward(reward: Column) -> Column:
    return (reward - 1) / 4


def reward_histogram(df: DataFrame) -> DataFrame:
    """Rows by reward 1 to 5, also those without any."""
    n = df.groupBy((F.rint(F.col("partial_success") * 4) + 1).cast("int").alias("reward")).agg(F.count(F.lit(1)).alias("n"))
    return df.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("reward")).join(n, "reward", "left").select("reward", F.coalesce("n", F.lit(0)).alias("n"))


def episode_labels(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """(task, episode, label) of headered files, one a task: label 1 is a failure."""
    parts = [spark.read.option("header", "true").schema("episode int, label int").csv(p).withColumn("task", F.lit(t)) for t, p in files.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def labelled_episodes(episodes: DataFrame, labels: DataFrame, skip: int = 10) -> DataFrame:
    """Episodes with a label; their frames without the first ``skip``."""
    joined = episodes.join(labels, ["task", "episode"])
    return joined.select("task", "episode", F.when(F.col("label") == 1, "failure").otherwise("successful").alias("quality_label"), F.slice(tx.sort_by_number(F.col("images")), skip + 1, 1 << 30).alias("images"))


def success_cutoffs(spark: SparkSession, path: str) -> DataFrame:
    """(data_source, success_percent) of lines with a comma."""
    lines = spark.read.text(path).where(F.col("value").contains(","))
    return lines.select(F.trim(F.split_part("value", F.lit(","), F.lit(1))).alias("data_source"), F.trim(F.split_part("value", F.lit(","), F.lit(2))).try_cast("double").alias("success_percent")).where("success_percent is not null")


def sheet_dictionary(rows: DataFrame) -> DataFrame:
    """(key, task) of sheet rows (key, task), each key with and without .zip; rows with a missing field are dropped."""
    both = F.array(F.regexp_replace("key", r"\.zip$", ""), F.concat(F.regexp_replace("key", r"\.zip$", ""), F.lit(".zip")))
    return rows.dropna(subset=["key", "task"]).select(F.explode(both).alias("key"), "task").dropDuplicates(["key"])


# ---- nested documents -----------------------------------------------------------------------


def policy_sessions(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """Sessions (session, language_instruction, policies map<id, {partial_success, policy_name}>) with their left and right videos."""
    each = sessions.select("session", F.col("language_instruction").alias("task"), F.explode("policies").alias("policy", "p"))
    each = each.select("session", "task", F.concat_ws("_", "policy", "p.policy_name").alias("folder"), F.col("p.partial_success").alias("partial_success"))
    videos = files.where(F.col("name").rlike(r"_(left|right)\.mp4$")).select(F.try_element_at(F.split("path", "/"), F.lit(-3)).alias("session"), "folder", F.col("path").alias("frames"))
    out = each.join(videos, ["session", "folder"])
    return out.select("task", "frames", "partial_success", F.when(F.col("partial_success") == 1.0, "successful").otherwise("failure").alias("quality_label"), F.lit(True).alias("is_robot"))


def task_episodes(spark: SparkSession, path: str) -> DataFrame:
    """(episode_id, task_name, actions) of task files; of files with one episode the last by name counts, with the number of them."""
    schema = "episode_id bigint, task_name string, task_description string, label_info struct<action_config: array<struct<action_text: string, start_frame: int, end_frame: int>>>"
    raw = spark.read.schema(schema).option("multiLine", "true").json(path).withColumn("file", F.col("_metadata.file_path"))
    best = raw.groupBy("episode_id").agg(F.max_by(F.struct("task_name", F.col("label_info.action_config").alias("actions")), "file").alias("r"), F.count(F.lit(1)).alias("copies"))
    return best.select("episode_id", "r.task_name", "r.actions", "copies")


def expand_actions(videos: DataFrame, episodes: DataFrame) -> DataFrame:
    """Each video (episode_id, frames, n) whole and once for each action, held to its frames; empty clips are dropped."""
    joined = videos.join(episodes, "episode_id")
    whole = F.array(F.struct(F.col("task_name").alias("task"), F.lit(0).alias("start"), F.col("n").alias("stop"), F.lit(True).alias("full")))
    held = lambda x: F.least(F.greatest(x, F.lit(0)), F.col("n"))
    clips = F.transform(F.coalesce("actions", F.array().cast("array<struct<action_text: string, start_frame: int, end_frame: int>>")), lambda a: F.struct(a["action_text"].alias("task"), held(a["start_frame"]).alias("start"), held(a["end_frame"]).alias("stop"), F.lit(False).alias("full")))
    return joined.select("episode_id", "frames", F.explode(F.concat(whole, clips)).alias("c")).select("episode_id", "frames", "c.*").where("start < stop")


def sessionize(frames: DataFrame, key: str, order: str) -> DataFrame:
    """Adds run: a number that grows where the key changes in the order of the rows of a partition column ``part``."""
    w = Window.partitionBy("part").orderBy(order)
    fresh = F.coalesce((~F.col(key).eqNullSafe(F.lag(key).over(w))).cast("int"), F.lit(1))
    return frames.withColumn("__fresh", fresh).withColumn("run", F.sum("__fresh").over(w)).drop("__fresh")


def views(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row for each view that is there: view, frames."""
    return df.select("*", F.explode(F.filter(F.array(*[F.struct(F.lit(c).alias("view"), F.col(c).alias("frames")) for c in columns]), lambda v: v["frames"].isNotNull())).alias("v")).select(*[c for c in df.columns if c not in columns], "v.view", "v.frames")


def first_text(*keys: str) -> Column:
    """The first instruction that is there and not empty."""
    return F.coalesce(*[F.nullif(F.trim(k), F.lit("")) for k in keys])


def shared_instructions(human: DataFrame, robot: DataFrame) -> DataFrame:
    """Rows (video_path, task_instruction, motion_description) of instructions that both sets have."""
    task = F.concat("task_instruction", F.lit(": "), "motion_description")
    a, b = (d.select(task.alias("task"), F.col("video_path").alias("frames"), F.lit(r).alias("is_robot")) for d, r in ((human, False), (robot, True)))
    both = a.select("task").intersect(b.select("task"))
    return a.unionByName(b).join(both, "task", "left_semi")


def embodiments(attributes: DataFrame) -> DataFrame:
    """(task, is_robot) of JSON text ``per_task_attributes``: robots lack 'human' in their type."""
    parsed = attributes.select(F.explode(F.from_json("per_task_attributes", "map<string, struct<embodiment_type: string>>")).alias("task", "a"))
    return parsed.select("task", (~F.lower("a.embodiment_type").contains("human")).alias("is_robot"))


def expert_failures(episodes: DataFrame) -> DataFrame:
    """Episodes (task_goal, view, images, subgoal map<'<n>_expert', {augmentation map<name, {label}>}>): a success a view, and a failure a subgoal.

    A failure holds the expert frames before n and the frame of its first failed augmentation.
    """
    number = lambda p: F.coalesce(F.regexp_extract(F.try_element_at(F.split(p, "/"), F.lit(-1)), r"^(\d+)", 1).try_cast("int"), F.lit(1_000_000_000))
    expert = F.filter("images", lambda p: p.contains("expert"))
    good = episodes.select(F.col("task_goal").alias("task"), "view", expert.alias("images"), F.lit("successful").alias("quality_label"))
    each = episodes.select("task_goal", "view", "images", F.explode("subgoal").alias("key", "content")).where(F.col("key").contains("expert"))
    failed = F.filter(F.map_entries("content.augmentation"), lambda e: F.lower(e["value"]["label"]).contains("failure"))
    each = each.withColumns({"k": F.split_part("key", F.lit("_"), F.lit(1)).try_cast("int"), "bad": F.try_element_at(failed, F.lit(1))["key"]}).where("k is not null and bad is not null")
    before = F.filter("images", lambda p: p.contains("expert") & (number(p) < F.col("k")))
    extra = F.slice(F.filter("images", lambda p: p.contains(F.col("bad"))), 1, 1)
    bad = each.select(F.col("task_goal").alias("task"), "view", F.concat(before, extra).alias("images"), F.lit("failure").alias("quality_label"))
    return good.unionByName(bad.where(F.size("images") > 0))


def confirmed_labels(episodes: DataFrame, corrections: DataFrame) -> DataFrame:
    """Episodes (split, index, task, frames): successes not corrected to failure, and failures whose task has such a success."""
    joined = episodes.join(corrections, ["split", "index"], "left").withColumn("label", F.coalesce("correction", F.col("split")))
    good = joined.where("split = 'success' and label in ('success', 'successful')").withColumn("quality_label", F.lit("successful"))
    bad = joined.where("split = 'failure' and label = 'failure'").withColumn("quality_label", F.lit("failure"))
    return good.unionByName(bad.join(good.select("task").distinct(), "task", "left_semi"))


def plan_captions(spark: SparkSession, path: str) -> DataFrame:
    """A list of records, or an object that holds one under data, results, annotations or samples; the caption is the plan's first line."""
    record = "struct<image: string, planing: string, caption: string, score: double>"
    text = spark.read.text(path, wholetext=True).select("value")
    lists = [F.from_json("value", f"array<{record}>"), *[F.from_json("value", f"struct<{k}: array<{record}>>")[k] for k in ("data", "results", "annotations", "samples")]]
    is_list = F.ltrim("value").startswith("[")
    rows = text.select(F.explode(F.when(is_list, lists[0]).otherwise(F.coalesce(*lists[1:]))).alias("r")).select("r.*")
    line = F.substring(F.split_part("planing", F.lit("\n"), F.lit(1)), 2, 1 << 30)
    out = rows.select(F.col("image").alias("frames"), F.coalesce(F.nullif(line, F.lit("")), "caption").alias("task"), "score").where("frames is not null and task is not null")
    return out.withColumn("group", F.when(F.length("task") > 50, F.concat(F.left("task", F.lit(50)), F.lit("..."))).otherwise(F.col("task")))


def sub_episodes(rows: DataFrame, view: str, seed: int, part: float = 1 / 3) -> DataFrame:
    """A hashed part of rows (task, instruction, sub_task, failure_type, image): images of one view, task by the sub-task."""
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.lit(view), F.to_json("image")), F.lit(1_000_000)) < int(part * 1_000_000)
    fine = F.col("failure_type").isNull() | (F.lower("failure_type") == "none")
    return rows.where(drawn).select(F.coalesce(F.nullif("sub_task", F.lit("")), "instruction").alias("task"), F.filter("image", lambda p: p.contains(view)).alias("images"), F.when(fine, "successful").otherwise("failure").alias("quality_label")).where(F.size("images") > 0)


# ---- names and dictionaries --------------------------------------------------------------------


def by_folder_grammar(files: DataFrame, quality: dict[str, str], name: str = "folder") -> DataFrame:
    """{task}_{quality}_{attempt} names: unknown or short names are dropped."""
    table = F.create_map(*[F.lit(x) for kv in quality.items() for x in kv])
    p = files.withColumn("p", tx.folder_parts(F.col(name))).where("p is not null")
    return p.select(F.replace("p.task", F.lit("_"), F.lit(" ")).alias("task"), F.col("path").alias("frames"), F.try_element_at(table, F.col("p.quality")).alias("quality_label"), F.col("p.attempt").alias("part")).where("quality_label is not null")


def scene_task(path: Column) -> Column:
    """The task of a scene file: the words after the one that holds SCENE, without the word demo."""
    words = F.split(F.regexp_replace(F.try_element_at(F.split(path, "/"), F.lit(-1)), r"\.[^.]*$", ""), "_")
    after = F.try_element_at(F.filter(F.transform(words, lambda w, i: F.when(w.contains("SCENE"), i + 1)), lambda i: i.isNotNull()), F.lit(1))
    return F.trim(F.replace(F.array_join(F.slice(words, F.coalesce(after, F.lit(0)) + 1, 1 << 30), " "), F.lit("demo"), F.lit("")))


def hand_or_robot(files: DataFrame) -> DataFrame:
    """Folders that end with _hand hold people; the task is the name without it."""
    return files.select(F.replace(F.replace("folder", F.lit("_hand"), F.lit("")), F.lit("_"), F.lit(" ")).alias("task"), F.col("path").alias("frames"), (~F.col("folder").endswith("_hand")).alias("is_robot"))


def human_and_robot(files: DataFrame, tasks: DataFrame) -> DataFrame:
    """Two rows a file, of folders that the dictionary (folder, task) knows."""
    return files.join(F.broadcast(tasks), "folder").select("task", F.explode(F.array(F.lit("human"), F.lit("robot"))).alias("part"), F.col("path").alias("frames")).withColumn("is_robot", F.col("part") == "robot")


def dictionary_or_contains(files: DataFrame, tasks: DataFrame) -> DataFrame:
    """The task of a folder: its own entry of the dictionary (folder, task, pos), else the first that contains it or is contained, else the name."""
    t = F.broadcast(tasks.select(F.col("folder").alias("k"), F.col("task").alias("found"), "pos"))  # a dictionary of names
    low, key = F.lower("folder"), F.lower("k")
    joined = files.join(t, low.contains(key) | key.contains(low), "left")
    best = joined.groupBy("folder", "path").agg(F.min_by("found", F.struct((low != key).alias("x"), F.col("pos"))).alias("found"))
    return best.select(F.coalesce("found", tx.prettify(F.col("folder"))).alias("task"), F.col("path").alias("frames"), F.lit("failure").alias("quality_label"))


def need_success(df: DataFrame) -> DataFrame:
    """The rows; a task without a success is an error when they are read."""
    flags = df.groupBy(F.col("task").alias("__task")).agg(F.coalesce(F.bool_or(F.col("quality_label") == "successful"), F.lit(False)).alias("__s"))
    joined = df.join(flags, F.col("task").eqNullSafe(F.col("__task")))
    return joined.where(F.when(F.col("__s"), True).otherwise(F.raise_error(F.concat(F.lit("no success of task "), F.coalesce("task", F.lit("null")))))).drop("__task", "__s")


def cap_per_folder(df: DataFrame, folder: str, k: int) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(folder).orderBy("path"))).where(F.col("__k") <= k).drop("__k")


def decode(df: DataFrame, decoder: Callable, schema: str) -> DataFrame:
    """Frames by a decoder of Arrow batches as DataFrames: (iterator) -> iterator.  Errors are for it to put in rows."""
    return df.mapInPandas(decoder, schema)


def result_metrics(spark: SparkSession, path: str, datasets: Sequence[str]) -> DataFrame:
    """(dataset, metric, value) of a JSON map 'dataset/metric' -> value, of the given datasets."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, double>")).alias("key", "value"))
    dataset = F.split_part("key", F.lit("/"), F.lit(1))
    return raw.select(dataset.alias("dataset"), F.regexp_replace("key", "^[^/]*/", "").alias("metric"), "value").where(F.col("dataset").isin(*datasets))


def matrix_json(spark: SparkSession, path: str) -> DataFrame:
    """(row, column, value) of a JSON matrix, bare or under confusion_matrix."""
    text = spark.read.text(path, wholetext=True).select("value")
    m = F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<array<double>>")).otherwise(F.from_json("value", "struct<confusion_matrix: array<array<double>>>")["confusion_matrix"])
    return text.select(F.posexplode(m).alias("row", "r")).select("row", F.posexplode("r").alias("column", "value"))
