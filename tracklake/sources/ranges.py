"""Byte ranges of files in any store that pyarrow reaches, for sources that are larger than a task's memory."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Bytes and files that are dealt to one task.
TASK_BYTES, TASK_FILES = 1 << 28, 256


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it; Spark's file:/ form is a local path."""
    local = re.sub(r"^file:/+", "/", path)
    if "://" not in local:
        return pafs.LocalFileSystem(), local
    return pafs.FileSystem.from_uri(path)


def listed(path: str, pattern: str = "*") -> list[tuple[str, int]]:
    """(path, size) of a file, or of all files below a folder whose names fit, by path; names with _ or . before them are left out."""
    fs, inner = store(path)
    head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = fs.get_file_info(inner)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(inner, recursive=True))
    return sorted((head + f.path, f.size) for f in found if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, pattern) and f.base_name[0] not in "._")


def opened(path: str):
    """The file for seeks and reads."""
    fs, inner = store(path)
    return fs.open_input_file(inner)


def at(f, offset: int, length: int) -> bytes:
    f.seek(offset)
    return f.read(length)


def cuts(size: int, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``limit`` bytes."""
    for a in range(0, size, limit):
        yield a, min(a + limit, size)


def dealt(spark: SparkSession, found: list[tuple[str, int]]) -> DataFrame:
    """(path, bytes) of listed files, in tasks of about ``TASK_BYTES`` and ``TASK_FILES``; few files have a task each, so that all cores work.

    The driver keeps a record of each task, so many small files must share one.  The list
    is not shuffled: from the few bytes of a shuffle Spark would take all that is read of
    the files for small, and join it by a broadcast through the driver.
    """
    tasks = max(spark.sparkContext.defaultParallelism, -(-sum(n for _, n in found) // TASK_BYTES), -(-len(found) // TASK_FILES))
    tasks = max(1, min(len(found), tasks))
    turns = [f for k in range(tasks) for f in found[k::tasks]]
    return spark.createDataFrame(spark.sparkContext.parallelize(turns, tasks), "path string, bytes bigint")
