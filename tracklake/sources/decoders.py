"""Binary files as rows: arrays of .npz and .npy, members of .tar, pickled records.

Spark lists and reads the files; each task decodes its own in Arrow batches, one file at a
time.  A file that cannot be read is a row with its error, and the others go on.
"""

from __future__ import annotations

import io
import pickle
import tarfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content) of the files below a folder whose names fit the pattern."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select("path", "length", "content")


def _decoded(df: DataFrame, one: Callable[[str, bytes], list[dict]], schema: str) -> DataFrame:
    """Rows of each file by ``one``; a file that fails gives one row with the error."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = [{"path": path, **r, "error": None} for r in one(path, bytes(content))]
                except Exception as e:  # noqa: BLE001  (whatever a decoder raises belongs in the row)
                    rows = [{"path": path, "error": f"{type(e).__name__}: {e}"}]
                if rows:
                    yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in ("path", *names, "error")})

    return df.select("path", "content").mapInPandas(run, f"path string, {schema}, error string")


def npz_frames(df: DataFrame, name: str = "frames") -> DataFrame:
    """(path, frame_idx, shape, payload, error): one row a frame of the array ``name``, its bytes in C order."""

    def one(path: str, content: bytes) -> list[dict]:
        with np.load(io.BytesIO(content), allow_pickle=False) as data:
            frames = data[name]
        return [{"frame_idx": k, "shape": list(f.shape), "payload": np.ascontiguousarray(f).tobytes()} for k, f in enumerate(frames)]

    return _decoded(df, one, "frame_idx int, shape array<int>, payload binary")


def npz_embeddings(df: DataFrame) -> DataFrame:
    """(path, video_embeddings, text_embedding, error) of arrays of these names; a missing text is null."""

    def one(path: str, content: bytes) -> list[dict]:
        with np.load(io.BytesIO(content), allow_pickle=False) as data:
            text = data["text_embedding"].ravel().astype(float).tolist() if "text_embedding" in data else None
            return [{"video_embeddings": [r.tolist() for r in data["video_embeddings"].astype(float)], "text_embedding": text}]

    return _decoded(df, one, "video_embeddings array<array<float>>, text_embedding array<float>")


def npy_matrix(df: DataFrame) -> DataFrame:
    """(path, row, column, value, error): the cells of a matrix; a vector is one row."""

    def one(path: str, content: bytes) -> list[dict]:
        m = np.atleast_2d(np.load(io.BytesIO(content), allow_pickle=False)).astype(float)
        return [{"row": i, "column": j, "value": v} for i, r in enumerate(m.tolist()) for j, v in enumerate(r)]

    return _decoded(df, one, "row int, column int, value double")


def tar_members(df: DataFrame, suffix: str = "") -> DataFrame:
    """(path, member, payload, error): the files of an archive, plain or compressed, whose names end with ``suffix``."""

    def one(path: str, content: bytes) -> list[dict]:
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            return [{"member": m.name, "payload": t.extractfile(m).read()} for m in t if m.isfile() and m.name.endswith(suffix)]

    return _decoded(df, one, "member string, payload binary")


class _Plain(pickle.Unpickler):
    """Reads numbers, texts, containers and numpy arrays; any other class is an error."""

    def find_class(self, module: str, name: str):
        if module.split(".")[0] == "numpy" and name in ("ndarray", "dtype", "_reconstruct", "scalar", "_frombuffer"):
            return super().find_class(module, name)
        raise pickle.UnpicklingError(f"{module}.{name} is not allowed")


def pickled_records(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(path, pos, record, error): the dictionaries of a pickled list, as a map of the given keys to JSON-like texts."""

    def one(path: str, content: bytes) -> list[dict]:
        got = _Plain(io.BytesIO(content)).load()
        rows = got if isinstance(got, list | tuple) else [got]
        return [{"pos": k, "record": {key: None if r.get(key) is None else str(r[key]) for key in keys}} for k, r in enumerate(rows)]

    return _decoded(df, one, "pos int, record map<string,string>")


def stated_shape(frames: DataFrame, shape: Column) -> DataFrame:
    """Adds fits: whether the number of frames of a file is that of the stated shape."""
    n = frames.where("error is null").groupBy("path").agg(F.count(F.lit(1)).alias("n_frames"))
    return n.withColumn("fits", F.col("n_frames") == F.get(shape, F.lit(0)))
