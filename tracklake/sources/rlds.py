"""Robot episodes kept as one Example each: instruction, camera views and splits as column expressions over the features."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklake.sources import ranges
from tracklake.sources.tfrecord import TfRecords

#: Names under which an episode may hold its instruction, in order: fixed values of the format.
INSTRUCTIONS = ("natural_language_instruction", "language_instruction", "instruction", "language_instruction1", "language_instruction2", "language_instruction3")
SPLIT = r"-([^-/.]+)\.tfrecord[^/]*$"
#: Rows of a batch that is written: Spark sizes the nested columns of a batch anew for each row of it.
WRITTEN_ROWS = 250
PNG = b"\x89PNG\r\n\x1a\n"


def read_records(spark: SparkSession, path: str, split_bytes: int = 1 << 26, split: str = "*") -> DataFrame:
    """The records of all files below a path, or of one split's, with the split that a file's name tells."""
    spark.dataSource.register(TfRecords)
    out = spark.read.format("tfrecord").option("splitBytes", str(split_bytes)).option("pathGlobFilter", f"*-{split}.tfrecord*").load(path)
    return out.withColumn("split", F.regexp_extract("path", SPLIT, 1))


def chosen_split(path: str, evaluation: bool = False) -> str:
    """train, or the only other split by the files' names; none or several others are an error."""
    if not evaluation:
        return "train"
    names = {m.group(1) for p, _ in ranges.listed(path, "*.tfrecord*") if (m := re.search(SPLIT, p))} - {"train"}
    if len(names) != 1:
        raise ValueError(f"an evaluation needs exactly one split besides train, found {sorted(names)}")
    return names.pop()


def write_records(df: DataFrame, path: str, prefix: str = "data", split: str = "train") -> None:
    """Writes the column ``features`` as one split."""
    spark, rows = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.dataSource.register(TfRecords)
    before = spark.conf.get(rows)
    spark.conf.set(rows, str(WRITTEN_ROWS))
    try:
        df.select("features").write.format("tfrecord").option("prefix", prefix).option("split", split).mode("append").save(path)
    finally:
        spark.conf.set(rows, before)


def _value(name: str) -> Column:
    return F.try_element_at("features", F.lit(name))


def instruction(coded: bool = False, keys: Sequence[str] = INSTRUCTIONS) -> Column:
    """The text of the first step under the first name that is there, in an observation before the step.

    coded: an observation holds character codes, filled with zeros, instead of bytes.
    """
    def codes(name: str) -> Column:
        all_codes, steps = _value(name)["ints"], F.greatest(F.size(_value("steps/is_first")["ints"]), F.lit(1))
        first = F.filter(F.slice(all_codes, F.lit(1), (F.size(all_codes) / steps).cast("int")), lambda x: x != 0)
        return F.decode(F.unhex(F.array_join(F.transform(first, lambda x: F.lpad(F.hex(x), 2, "0")), "")), "UTF-8")

    def text(name: str) -> Column:
        return F.decode(F.get(_value(name)["bytes"], F.lit(0)), "UTF-8")

    out = []
    for k in keys:
        seen = f"steps/observation/{k}"
        out += [codes(seen) if coded else text(seen), text(f"steps/{k}")]
    return F.coalesce(*out)


def _black(frame: bytes) -> bool:
    """Whether all pixels are zero: of a PNG without its filter bytes, of other bytes as they are."""
    if not frame.startswith(PNG):
        return not any(frame)
    width, height, depth, colour = int.from_bytes(frame[16:20], "big"), int.from_bytes(frame[20:24], "big"), frame[24], frame[25]
    at, data = 8, []
    while at + 8 <= len(frame):
        n, kind = int.from_bytes(frame[at : at + 4], "big"), frame[at + 4 : at + 8]
        if kind == b"IDAT":
            data.append(frame[at + 8 : at + 8 + n])
        at += 12 + n
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    row = 1 + (width * depth * channels + 7) // 8
    pixels = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, row)[:, 1:]
    return not pixels.any()  # every filter of zeros gives zeros


@F.pandas_udf(T.BooleanType())
def is_black(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """False for null, and for encodings that cannot be read here."""
    def one(f) -> bool:
        try:
            return f is not None and len(f) > 0 and _black(bytes(f))
        except (zlib.error, ValueError, KeyError):
            return False

    for part in frames:
        yield part.map(one).astype(bool)


def camera_rows(records: DataFrame, views: dict[str, str], coded: bool = False, wrist: bool = False) -> DataFrame:
    """(path, offset, task, view, frames, num_frames, is_robot, quality_label): each episode once for each camera.

    views: the observation's key of each view; the wrist's is left out unless asked for.
    Records with errors, episodes without a text, views without frames and views that begin
    with a black frame are left out.  Steps without the view's frame are not in its frames.
    """
    names = {v: k for v, k in views.items() if wrist or v != "wrist"}
    each = F.array(*[F.struct(F.lit(v).alias("view"), _value(f"steps/observation/{k}")["bytes"].alias("frames")) for v, k in names.items()])
    rows = records.where("error is null").select("path", "offset", instruction(coded).alias("task"), F.explode(each).alias("v")).select("path", "offset", "task", "v.*")
    rows = rows.where((F.col("task") != "") & (F.size("frames") > 0))
    # The frame alone goes to Python.
    rows = rows.where(~is_black(F.get("frames", F.lit(0))))
    return rows.select("path", "offset", "task", "view", "frames", F.size("frames").alias("num_frames"), F.lit(True).alias("is_robot"), F.lit("successful").alias("quality_label"))
