"""An index of episodes for point lookups: rows ordered by id in files whose ranges are known, and a manifest by file.

A version of the index holds the rows, the range of ids of each of its files, and the
manifest: path, length and modification time of each task file.  A refresh reads the task
files that are new or changed, and takes the rows of the others from the last version; what
is complete becomes the current version by its name.  A lookup reads the files whose range
holds the id: one, but for duplicates at a border.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.sources import ranges

RECORD = "episode_id bigint, task_name string, task_description string, label_info struct<action_config: array<struct<action_text: string, start_frame: int, end_frame: int>>>"
ROWS = "episode_id bigint, task_name string, actions array<struct<action_text: string, start_frame: int, end_frame: int>>, file string"
MANIFEST = "file string, length bigint, modified timestamp"


def _versions(folder: str) -> list[str]:
    """Complete versions, the last one last."""
    try:
        found = ranges.listed(folder, "manifest.done")
    except FileNotFoundError:
        return []
    return sorted(p.rsplit("/", 1)[0] for p, _ in found)


def task_files(spark: SparkSession, path: str, pattern: str = "task_*.json") -> DataFrame:
    """``MANIFEST`` of the task files below a path; their contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("file"), "length", F.col("modificationTime").alias("modified"))


def _read(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    raw = spark.read.schema(RECORD).option("multiLine", "true").json(list(files))
    task = F.coalesce(F.nullif("task_name", F.lit("")), "task_description")
    return raw.where("episode_id is not null").select("episode_id", task.alias("task_name"), F.col("label_info.action_config").alias("actions"), F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/").alias("file"))


def refresh(spark: SparkSession, path: str, folder: str, pattern: str = "task_*.json", rows_per_file: int = 100_000) -> int:
    """Brings the index in a folder up to the task files below a path; returns the number of files that were read."""
    now = task_files(spark, path, pattern).withColumn("file", F.regexp_replace("file", "^file:/+", "file:/"))
    versions = _versions(folder)
    old = spark.read.schema(MANIFEST).parquet(f"{versions[-1]}/manifest") if versions else spark.createDataFrame([], MANIFEST)
    # Names of files: a list as long as the one that any read of them makes.
    changed = [r.file for r in now.join(old, ["file", "length", "modified"], "left_anti").select("file").collect()]
    gone = old.join(now, "file", "left_anti").count()
    if versions and not changed and not gone:
        return 0
    rows = _read(spark, changed) if changed else spark.createDataFrame([], ROWS)
    if versions:
        kept = now.where(~F.col("file").isin(changed)) if len(changed) <= 1000 else now.join(spark.createDataFrame([(c,) for c in changed], "file string"), "file", "left_anti")
        rows = rows.unionByName(spark.read.schema(ROWS).parquet(f"{versions[-1]}/rows").join(kept.select("file"), "file", "left_semi"))
    out = f"{folder}/v{len(versions):06d}"
    n = -(-rows.count() // rows_per_file)
    rows.repartitionByRange(max(1, n), "episode_id").sortWithinPartitions("episode_id", "file").write.mode("overwrite").parquet(f"{out}/rows")
    held = spark.read.schema(ROWS).parquet(f"{out}/rows").groupBy(F.col("_metadata.file_path").alias("part")).agg(F.min("episode_id").alias("least"), F.max("episode_id").alias("most"), F.count(F.lit(1)).alias("n"))
    held.coalesce(1).write.mode("overwrite").parquet(f"{out}/ranges")
    now.coalesce(1).write.mode("overwrite").parquet(f"{out}/manifest")
    fs, inner = ranges.store(out)
    with fs.open_output_stream(f"{inner}/manifest.done") as f:
        f.write(b"")
    return len(changed)


def _current(folder: str) -> str:
    versions = _versions(folder)
    if not versions:
        raise FileNotFoundError(f"no index in {folder}; refresh it first")
    return versions[-1]


def _latest(rows: DataFrame) -> DataFrame:
    """Of several records of an id the last by file, with the number of them."""
    best = rows.groupBy("episode_id").agg(F.max_by(F.struct("task_name", "actions", "file"), "file").alias("r"), F.count(F.lit(1)).alias("copies"))
    return best.select("episode_id", "r.*", "copies")


def records_of(spark: SparkSession, folder: str, least: int, most: int) -> DataFrame:
    """The records of ids from least to most, read from the files whose ranges meet them."""
    version = _current(folder)
    parts = [r.part for r in spark.read.parquet(f"{version}/ranges").where((F.col("least") <= most) & (F.col("most") >= least)).select("part").collect()]
    rows = spark.read.schema(ROWS).parquet(*parts) if parts else spark.createDataFrame([], ROWS)
    return _latest(rows.where(F.col("episode_id").between(least, most)))


def record(spark: SparkSession, folder: str, episode_id: int | str):
    """One record; an absent id is an error."""
    found = records_of(spark, folder, int(episode_id), int(episode_id)).first()
    if found is None:
        raise KeyError(f"episode {episode_id} is not in the index")
    return found


def with_records(df: DataFrame, folder: str, episode: Column, strict: bool = True) -> DataFrame:
    """Adds task_name, actions and copies by the id of an episode; strict: an absent id is an error when it is read."""
    spark = df.sparkSession
    index = _latest(spark.read.schema(ROWS).parquet(f"{_current(folder)}/rows")).select(F.col("episode_id").alias("__id"), "task_name", "actions", "copies")
    out = df.withColumn("__asked", episode.try_cast("bigint")).join(index, F.col("__asked") == F.col("__id"), "left")
    if strict:
        absent = F.raise_error(F.concat(F.lit("no record of episode "), F.coalesce(episode.cast("string"), F.lit("null"))))
        out = out.withColumn("copies", F.when(F.col("__id").isNotNull(), F.col("copies")).otherwise(absent.cast("bigint")))
    return out.drop("__asked", "__id")


def texts(records: DataFrame) -> DataFrame:
    """(text): each different instruction of the records once, of whole episodes and of their actions; empty ones are left out."""
    each = F.concat(F.array("task_name"), F.coalesce(F.transform("actions", lambda a: F.trim(a["action_text"])), F.array().cast("array<string>")))
    return records.select(F.explode(each).alias("text")).where("text is not null and text <> ''").distinct()
