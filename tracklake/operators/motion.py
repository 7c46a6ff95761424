"""Motion of decoded frames: how much each differs from the one before, and the frames that move most."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tracklake.operators.evals import by_motion

#: Parts of red, green and blue in the lightness of a pixel.
LUMA = np.array([0.299, 0.587, 0.114])


def lightness(payload: bytes, shape: list[int]) -> np.ndarray:
    """The lightness of a frame of bytes: of three or four channels by their parts, of one as it is."""
    a = np.frombuffer(payload, np.uint8).reshape(shape)
    return a[..., :3] @ LUMA if a.ndim == 3 and a.shape[-1] in (3, 4) else a.reshape(shape).astype(float)


def motion_scores(frames: DataFrame, key: str = "path") -> DataFrame:
    """(key, frame_idx, score) of rows (key, frame_idx, shape, payload): the mean difference of lightness from the frame before; 0 for the first.

    A series stays in one task, in order, but only two of its frames are held at a time:
    the last frame of an Arrow batch is kept for the next.  A frame of another shape than
    the one before has no score.
    """
    kind = frames.schema[key].dataType.simpleString()
    rows = frames.select(key, "frame_idx", "shape", "payload").where("payload is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series, last = None, None
        for batch in batches:
            scores = []
            for name, shape, payload in zip(batch[key], batch["shape"], batch["payload"], strict=True):
                now = lightness(payload, [int(n) for n in shape])
                if name != series:
                    scores.append(0.0)
                else:
                    scores.append(float(np.abs(now - last).mean()) if now.shape == last.shape else None)
                series, last = name, now
            yield pd.DataFrame({key: batch[key], "frame_idx": batch["frame_idx"], "score": pd.Series(scores, dtype="float64", index=batch.index)})

    return rows.repartition(key).sortWithinPartitions(key, "frame_idx").mapInPandas(run, f"`{key}` {kind}, frame_idx bigint, score double")


def moving_frames(frames: DataFrame, k: int, key: str = "path") -> DataFrame:
    """(key, frame_idx, score): the first and the last frame and those that move most, k in all."""
    return by_motion(motion_scores(frames, key), key, "frame_idx", "score", k)
