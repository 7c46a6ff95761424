"""Episode lookups, shared text vectors, motion of decoded frames and samplers in SQL."""

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F


def write_task(folder, name, ids, task):
    rows = [{"episode_id": i, "task_name": task, "task_description": "d", "label_info": {"action_config": [{"action_text": f" step {i} ", "start_frame": 0, "end_frame": 3}]}} for i in ids]
    (folder / name).write_text(json.dumps(rows))


def test_episode_index(spark, tmp_path):
    from tracklake.sources import episodes

    tasks, index = tmp_path / "tasks", str(tmp_path / "index")
    tasks.mkdir()
    with pytest.raises(FileNotFoundError):
        episodes.record(spark, index, 1)
    for k in range(6):
        write_task(tasks, f"task_{k}.json", range(100 * k, 100 * k + 50), f"task {k}")
    write_task(tasks, "task_9.json", [7, 205], "later")
    assert episodes.refresh(spark, str(tasks), index, rows_per_file=50) == 7
    assert episodes.refresh(spark, str(tasks), index) == 0  # nothing has changed
    r = episodes.record(spark, index, "7")
    assert (r.task_name, r.copies) == ("later", 2) and episodes.record(spark, index, 8).task_name == "task 0"
    for absent in (60, 5000):
        with pytest.raises(KeyError):
            episodes.record(spark, index, absent)
    assert len(episodes.records_of(spark, index, 349, 349).inputFiles()) == 1
    parts = spark.read.parquet(f"{index}/v000000/ranges").collect()
    assert len(parts) > 1 and sum(p.n for p in parts) == 302
    # One file changes, one goes, one comes: only the new and the changed one are read.
    write_task(tasks, "task_9.json", [8, 206, 9], "latest")
    write_task(tasks, "task_95.json", [9000], "new")
    (tasks / "task_5.json").unlink()
    assert episodes.refresh(spark, str(tasks), index) == 2
    assert episodes.record(spark, index, 7).task_name == "task 0" and episodes.record(spark, index, 8).task_name == "latest" and episodes.record(spark, index, 9000).task_name == "new"
    with pytest.raises(KeyError):
        episodes.record(spark, index, 501)
    asked = spark.createDataFrame([("8",), ("120",), ("x",)], "e string")
    got = {r.e: r.task_name for r in episodes.with_records(asked, index, F.col("e"), strict=False).collect()}
    assert got == {"8": "latest", "120": "task 1", "x": None}
    with pytest.raises(Exception, match="no record of episode x"):
        episodes.with_records(asked, index, F.col("e")).collect()
    said = [r.text for r in episodes.texts(episodes.records_of(spark, index, 0, 10)).collect()]
    assert len(said) == len(set(said)) == 13 and "step 3" in said and "latest" in said


def counting(folder):
    """An encoder that notes each text that it is given."""

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import uuid

        for s in batches:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(s))
            yield pd.Series([np.array([len(t), 1.0], "f4") for t in s])

    return encode


def test_texts_are_encoded_once(spark, tmp_path):
    from tracklake.streaming import texts

    seen = tmp_path / "seen"
    seen.mkdir()
    source, store, out = (str(tmp_path / n) for n in ("source", "store", "out"))
    rows = [(k, f"task {k % 7}" if k % 10 else None) for k in range(60)]
    got = texts.with_vectors(spark.createDataFrame(rows, "id int, task string"), store, counting(seen))
    assert {(r.id, r.lang_vector and r.lang_vector[0]) for r in got.collect()} == {(k, len(t) if t else None) for k, t in rows}
    for part in range(3):
        spark.createDataFrame([(k, f"task {k % (8 + part)}") for k in range(30)], "id int, task string").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("id int, task string").option("maxFilesPerTrigger", 1).parquet(source)
    texts.attach_in_stream(stream, store, out, str(tmp_path / "check"), counting(seen)).awaitTermination()
    assert spark.read.parquet(out).where("lang_vector is null").count() == 0 and spark.read.parquet(out).count() == 90
    said = [t for f in seen.iterdir() for t in f.read_text().split("\n") if t]
    assert sorted(said) == sorted(f"task {k}" for k in range(10))


def test_motion_of_decoded_frames(spark, tmp_path, monkeypatch):
    from tracklake.operators import motion
    from tracklake.sources import decoders

    rng = np.random.default_rng(2)
    videos = {f"v{k}": rng.integers(0, 255, (5 + 7 * k, 6, 4, 3)).astype(np.uint8) for k in range(4)}
    for name, v in videos.items():
        np.savez(tmp_path / f"{name}.npz", frames=v)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # neighbours in different batches
    try:
        frames = decoders.npz_frames(decoders.files(spark, str(tmp_path), "*.npz"))
        got = {(r.path.rsplit("/", 1)[1][:-4], r.frame_idx): r.score for r in motion.motion_scores(frames).collect()}
        kept = motion.moving_frames(frames, 6).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for name, v in videos.items():
        light = v.astype(float) @ motion.LUMA
        want = [0.0, *np.abs(np.diff(light, axis=0)).mean((1, 2))]
        assert np.allclose([got[name, k] for k in range(len(v))], want)
        mine = sorted(r.frame_idx for r in kept if r.path.endswith(f"{name}.npz"))
        top = sorted({0, len(v) - 1, *[k for k in np.argsort(-np.array(want), kind="stable").tolist() if 0 < k < len(v) - 1][:4]})
        assert mine == top


def test_samplers_in_sql(spark):
    from tracklake.operators import table_functions

    table_functions.register(spark)
    spark.createDataFrame([(str(k % 3), k, "ab"[k % 5 == 0]) for k in range(60)], "grp string, id bigint, label string").createOrReplaceTempView("own_rows")
    got = spark.sql("SELECT * FROM sample_rows(TABLE(own_rows) PARTITION BY (grp), 4, 1)").collect()
    assert len(got) == 12 and {(r.grp, r.place) for r in got} == {(str(g), p) for g in range(3) for p in range(1, 5)}
    again = spark.sql("SELECT * FROM sample_rows(TABLE(SELECT * FROM own_rows DISTRIBUTE BY id) PARTITION BY (grp), 4, 1)").collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in again}
    for r in spark.sql("SELECT * FROM pair_next(TABLE(own_rows) PARTITION BY (grp) ORDER BY (id))").collect():
        assert r.second_id == min(k for k in range(r.first_id + 1, 60) if str(k % 3) == r.grp and (k % 5 == 0) != (r.first_id % 5 == 0))
    with pytest.raises(ValueError, match="unknown sampler"):
        table_functions.register(spark, ["nothing"])
