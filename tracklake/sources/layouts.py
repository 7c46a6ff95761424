"""Readers of folder layouts: what paths, metadata lists and task tables say becomes rows of trajectories.

Files are listed by Spark (``readers.list_files``) and only their paths travel.  A list of
images is as long as its episode; folders are numbered from their counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklake.functions import text as tx
from tracklake.operators.curate import keep_mixed_tasks
from tracklake.schema import normalize_quality
from tracklake.sources.readers import cap_per_folder, embodiments, first_limit, sub_episodes


def path_part(path: Column, k: int) -> Column:
    """The k-th part of a path, from the end if negative; null if there is none."""
    return F.try_element_at(F.split(path, "/"), F.lit(k))


def number_episodes(df: DataFrame, folders: Sequence[str], name: str, to: str = "episode_index") -> DataFrame:
    """Adds a gapless number from 0 in the order of the folders and of the names within each.

    Only one count a folder meets in one place; the names of a folder are sorted in one task.
    """
    counts = df.groupBy(*folders).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(*folders).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*folders, before.alias("__start"))
    own = F.row_number().over(Window.partitionBy(*folders).orderBy(name)) - 1
    return df.withColumn("__own", own).join(starts, list(folders)).withColumn(to, F.col("__start") + F.col("__own")).drop("__start", "__own")


def episode_path(dataset: str, index: Column, view: Column) -> Column:
    """dataset/shard_0000/episode_000000/view.mp4, a thousand episodes a shard."""
    return F.concat_ws("/", F.lit(dataset.lower()), F.format_string("shard_%04d", F.floor(index / 1000).cast("bigint")), F.format_string("episode_%06d", index), F.concat(view, F.lit(".mp4")))


def quality_folders(files: DataFrame, instructions: DataFrame, dataset: str, qualities: Sequence[str] = ("suboptimal", "failure", "success"), views: Sequence[str] = ("ext", "wrist"), without: Sequence[str] = ()) -> DataFrame:
    """Files (path) {task}/{quality}/{episode}_{view}.mp4 of the tasks in ``instructions`` (task_name, instruction).

    Names of other qualities or views and views in ``without`` are left out.  Episodes are
    numbered by task, quality in its given order, and name.
    """
    name = path_part(F.col("path"), -1)
    view, place = F.lit(None).cast("string"), F.array_position(F.array(*map(F.lit, qualities)), path_part(F.col("path"), -2))
    for v in reversed(views):
        view = F.when(name.contains(f"_{v}.mp4"), v).otherwise(view)
    rows = files.select("path", path_part(F.col("path"), -3).alias("task_name"), place.alias("place"), path_part(F.col("path"), -2).alias("quality"), view.alias("view"))
    rows = rows.where(F.col("view").isNotNull() & (F.col("place") > 0) & ~F.col("view").isin(*without or [""]))
    known = number_episodes(rows.join(instructions, "task_name"), ["task_name", "place"], "path")
    return known.select(
        F.col("instruction").alias("task"), F.col("path").alias("source_path"), episode_path(dataset, F.col("episode_index"), F.col("view")).alias("frames"),
        normalize_quality(F.col("quality")).alias("quality_label"), F.col("view").alias("part"), "episode_index", F.lit(True).alias("is_robot"),
    )


def metadata_episodes(spark: SparkSession, path: str, dataset: str, names: str = "*_metadata.json", whole: bool = True) -> DataFrame:
    """Lists of {filename, success, instruction, task_name, episode_idx} beside their videos; ``whole``: a list is one file, else one line.

    Records that cannot be read or lack a file name or an instruction are left out.
    """
    schema = "filename string, success string, instruction string, task_name string, episode_idx bigint, _bad string"
    raw = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad").option("multiLine", whole).option("pathGlobFilter", names).json(path)
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    rows = raw.select("*", folder.alias("folder")).where("_bad is null and filename is not null and instruction is not null")
    return rows.select(
        F.col("instruction").alias("task"), F.concat_ws("/", "folder", "filename").alias("source_path"), episode_path(dataset, F.col("episode_idx"), F.col("task_name")).alias("frames"),
        normalize_quality(F.col("success")).alias("quality_label"), "episode_idx", F.lit(True).alias("is_robot"),
    )


def sort_images(paths: Column) -> Column:
    """By the number that a name is; names that are none come last, in their own order."""
    stem = lambda p: F.regexp_replace(F.regexp_replace(p, "^.*/", ""), r"\.[^.]*$", "")
    keyed = F.transform(paths, lambda p: F.struct(stem(p).try_cast("bigint").isNull().alias("text"), stem(p).try_cast("bigint").alias("n"), p.alias("p")))
    return F.transform(F.array_sort(keyed), lambda s: s["p"])


def attempt_episodes(images: DataFrame, instructions: DataFrame, views: Sequence[str] = ("front", "side", "wrist"), success: str = "Ground_Truth") -> DataFrame:
    """Images (path) {task}/{seed}/{attempt}/{view}/{n}.png as whole episodes: the attempt named ``success`` is one, any other a failure.

    A task that ``instructions`` (task_name, instruction) does not know keeps its folder's name.
    """
    p = F.col("path")
    rows = images.where(F.lower(p).endswith(".png")).select(*[path_part(p, k).alias(c) for c, k in (("task_name", -5), ("seed", -4), ("attempt", -3), ("view", -2))], p)
    episodes = rows.where(F.col("view").isin(*views)).groupBy("task_name", "seed", "attempt", "view").agg(sort_images(F.collect_list("path")).alias("images"))
    named = episodes.join(F.broadcast(instructions), "task_name", "left")  # a short list of tasks
    label = F.when(F.col("attempt") == success, "successful").otherwise("failure")
    return named.select(F.coalesce("instruction", "task_name").alias("task"), "seed", "attempt", "view", "images", label.alias("quality_label"))


def failure_episodes(images: DataFrame, rows: DataFrame, instructions: DataFrame, seed: int, views: Sequence[str] = ("front", "side", "wrist"), part: float = 1 / 3) -> DataFrame:
    """Whole episodes and, for each view, a drawn part of the sub-episodes ``rows``; only tasks with a success and a failure."""
    out = attempt_episodes(images, instructions, views).select("task", "view", "images", "quality_label")
    for view in views:
        out = out.unionByName(sub_episodes(rows, f"/{view}/", seed, part).withColumn("view", F.lit(view)))
    return keep_mixed_tasks(out)


def camera_rows(files: DataFrame, attributes: DataFrame, cameras: Sequence[str] = ("right", "left")) -> DataFrame:
    """Files (task_name, path, description, cameras array) of tasks with attributes: a row for each known camera that is there."""
    known = F.filter(F.array(*map(F.lit, cameras)), lambda c: F.array_contains("cameras", c))
    joined = files.join(embodiments(attributes).withColumnRenamed("task", "task_name"), "task_name")
    return joined.select("task_name", F.col("description").alias("task"), F.col("path").alias("frames"), "is_robot", F.explode(known).alias("part"))


def runs_of_tasks(frames: DataFrame, tasks: DataFrame, key: str, order: str) -> DataFrame:
    """Frames that ``readers.sessionize`` numbered, as episodes (part, run, first, last, n) with the texts of their tasks (``key``, task)."""
    episodes = frames.groupBy("part", "run", key).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))
    return episodes.join(tasks, key)


def labelled_clips(files: DataFrame, instructions: DataFrame, most: int | None = None) -> DataFrame:
    """Clips (path) {folder}/{episode}_{words}.gif: the quality by words of the name, the task by the episode (episode, task), at most ``most`` of a folder."""
    stem = F.regexp_replace(path_part(F.col("path"), -1), r"\.[^.]*$", "")
    rows = files.where(F.lower("path").endswith(".gif")).select("path", path_part(F.col("path"), -2).alias("folder"), F.split_part(stem, F.lit("_"), F.lit(1)).alias("episode"), stem.alias("stem"))
    held = rows if most is None or most < 0 else cap_per_folder(rows, "folder", most)
    return held.join(instructions, "episode").select("task", F.col("path").alias("frames"), "folder", tx.quality_from_stem(F.col("stem")).alias("quality_label"))


def numbered_episodes(images: DataFrame, labels: DataFrame, instructions: DataFrame, dataset: str, skip: int = 10, most: int | None = None) -> DataFrame:
    """Images (path) {task}/{episode}/frame{n}.png with labels (task, episode, label) and instructions (task_name, instruction).

    Folders that are no number, unlabelled episodes and unknown tasks are left out, as are
    the first ``skip`` frames of each episode and episodes without more; label 1 is a failure.
    """
    p = F.col("path")
    rows = images.where(F.lower(p).endswith(".png")).select(path_part(p, -3).alias("task_name"), path_part(p, -2).try_cast("int").alias("episode"), p).where("episode is not null")
    episodes = rows.groupBy("task_name", "episode").agg(tx.sort_by_number(F.collect_list("path")).alias("images"))
    joined = episodes.join(labels.withColumnRenamed("task", "task_name"), ["task_name", "episode"]).join(instructions, "task_name")
    clip = F.concat_ws("/", F.lit(dataset.lower()), "task_name", F.format_string("episode_%06d", "episode"), F.lit("clip.mp4"))
    out = joined.select(
        F.col("instruction").alias("task"), "task_name", "episode", F.slice("images", skip + 1, 1 << 30).alias("images"), clip.alias("frames"),
        F.when(F.col("label") == 1, "failure").otherwise("successful").alias("quality_label"), F.lit(True).alias("is_robot"),
    )
    return first_limit(out.where(F.size("images") > 0), most, "task_name", "episode")


def first_task_texts(spark: SparkSession, path: str, up: int = 3, index: Sequence[str] = ("__index_level_0__",)) -> DataFrame:
    """(dataset, task) of task tables: the index of the first row if it is text, else the first text of that row that is not blank.

    The dataset is the part of a file's path that is ``up`` from its end; of several files the first by name counts.
    """
    raw = spark.read.option("recursiveFileLookup", "true").parquet(path)
    texts = [c for c, t in raw.dtypes if t == "string"]
    own = [F.col(c) for c in index if c in texts]
    others = [F.when(F.trim(F.col(c)) != "", F.col(c)) for c in texts if c not in index]
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    rows = raw.select(path_part(file, -up).alias("dataset"), F.struct(file, row).alias("at"), F.coalesce(*own, *others, F.lit(None).cast("string")).alias("task"))
    first = rows.groupBy("dataset").agg(F.min_by(F.struct("task"), "at").alias("r"))
    return first.select("dataset", "r.task").where("task is not null")


def dataset_videos(files: DataFrame, tasks: DataFrame, up: int = -4) -> DataFrame:
    """Videos (path) of datasets (a part of the path) with a task; the quality is told by the dataset's name."""
    rows = files.withColumn("dataset", path_part(F.col("path"), up)).join(tasks, "dataset")
    return rows.select("task", F.col("path").alias("frames"), "dataset", tx.quality_from_directory(F.lower("dataset")).alias("quality_label"), F.lit(True).alias("is_robot"))


def robot_of_path(path: Column) -> Column:
    """stretch: a robot; human: none; another path is an error."""
    low = F.lower(path)
    unknown = F.raise_error(F.concat(F.lit("neither robot nor human: "), path)).cast("boolean")
    return F.when(low.contains("stretch"), True).when(low.contains("human"), False).otherwise(unknown)


def folders_with(files: DataFrame, name: str = "videos/color.mp4") -> DataFrame:
    """(folder, path) of the folders that hold a file of this relative name."""
    return files.where(F.col("path").endswith("/" + name)).select(path_part(F.col("path"), -(name.count("/") + 2)).alias("folder"), "path")
