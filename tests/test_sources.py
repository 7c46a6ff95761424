import json

from pyspark.sql import functions as F

from tracklake.operators import models
from tracklake.sources import readers as rd
from tracklake.sources import sinks
from tracklake.streaming import ingest as st


def write(folder, name, text):
    p = folder / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)
    return str(p)


def test_clip_csv(spark, tmp_path):
    p = write(tmp_path, "a.csv", "participant_id,video_id,narration,narration_id,start_frame,stop_frame\nP1, V1 , open door ,n1,3,9\nP1,V1,bad,n2,x,9\n")
    got = rd.clip_csv(spark, p).collect()
    assert [tuple(r) for r in got] == [("P1", "V1", "open door", "n1", 3, 9)]
    c = rd.canonical(rd.clip_paths(rd.clip_csv(spark, p), "/root"), "clips").first()
    assert c.frames == "/root/P1/videos/V1.MP4" and c.quality_label == "successful" and len(c.id) == 64


def test_reward_jsonl(spark, tmp_path):
    rows = [{"file_name": "robo_arena/a.mp4", "task": "t", "reward": 5}, {"file_name": "x/b.mp4", "task": "t", "reward": 2}, {"file_name": "x/c.mp4", "task": "t", "reward": 9}]
    p = write(tmp_path, "m.jsonl", "\n".join(map(json.dumps, rows)) + "\nnot json\n")
    df = rd.reward_jsonl(spark, p)
    assert sorted((r.data_source, r.partial_success) for r in df.collect()) == [("roboreward_roboarena", 1.0), ("roboreward_x", 0.25)]
    assert [r.n for r in rd.reward_histogram(df).orderBy("reward").collect()] == [0, 1, 0, 0, 1]


def test_sessions_actions_and_episodes(spark, tmp_path):
    s = spark.createDataFrame([("s1", "wipe", {"A": (1.0, "p"), "B": (0.5, "q")})], "session string, language_instruction string, policies map<string, struct<partial_success: double, policy_name: string>>")
    f = spark.createDataFrame([("/d/s1/A_p/v_left.mp4", "v_left.mp4", "A_p"), ("/d/s1/A_p/v_right.mp4", "v_right.mp4", "A_p"), ("/d/s1/B_q/v_left.mp4", "v_left.mp4", "B_q"), ("/d/s1/B_q/v_wrist.mp4", "v_wrist.mp4", "B_q")], "path string, name string, folder string")
    assert sorted(r.quality_label for r in rd.policy_sessions(s, f).collect()) == ["failure", "successful", "successful"]
    for k, name in ((1, "task_1.json"), (2, "task_2.json")):
        write(tmp_path, name, json.dumps([{"episode_id": 7, "task_name": f"n{k}", "label_info": {"action_config": [{"action_text": "grip", "start_frame": -2, "end_frame": 4}, {"action_text": "none", "start_frame": 9, "end_frame": 12}]}}]))
    e = rd.task_episodes(spark, str(tmp_path))
    assert e.first().task_name == "n2" and e.first().copies == 2
    v = spark.createDataFrame([(7, "f.mp4", 8)], "episode_id bigint, frames string, n int")
    assert sorted((r.task, r.start, r.stop) for r in rd.expand_actions(v, e).collect()) == [("grip", 0, 4), ("n2", 0, 8)]
    w = spark.createDataFrame([(0, k, e_) for k, e_ in enumerate([5, 5, 6, 5])], "part int, i int, ep int")
    assert [r.run for r in rd.sessionize(w, "ep", "i").orderBy("i").collect()] == [1, 1, 2, 3]


def test_joins_of_sources(spark):
    a = spark.createDataFrame([("h1", "open", "slow"), ("h2", "close", "fast")], "video_path string, task_instruction string, motion_description string")
    b = spark.createDataFrame([("r1", "open", "slow")], a.schema)
    assert sorted(r.frames for r in rd.shared_instructions(a, b).collect()) == ["h1", "r1"]
    ep = spark.createDataFrame([("success", 0, "t", "f0"), ("success", 1, "u", "f1"), ("failure", 0, "t", "f2"), ("failure", 1, "u", "f3")], "split string, index int, task string, frames string")
    fix = spark.createDataFrame([("success", 1, "failure")], "split string, index int, correction string")
    assert sorted(r.frames for r in rd.confirmed_labels(ep, fix).collect()) == ["f0", "f2"]
    att = spark.createDataFrame([(json.dumps({"a": {"embodiment_type": "Human_hand"}, "b": {"embodiment_type": "arm"}}),)], "per_task_attributes string")
    assert {r.task: r.is_robot for r in rd.embodiments(att).collect()} == {"a": False, "b": True}
    files = spark.createDataFrame([("/x/heat_soup/v.mp4", "heat_soup"), ("/x/other_one/v.mp4", "other_one")], "path string, folder string")
    d = spark.createDataFrame([("soup", "heat the soup", 0), ("heat_soup", "exact", 1)], "folder string, task string, pos int")
    assert {r.frames: r.task for r in rd.dictionary_or_contains(files, d).collect()} == {"/x/heat_soup/v.mp4": "exact", "/x/other_one/v.mp4": "Other one"}
    g = rd.by_folder_grammar(spark.createDataFrame([("/a/pick_cup_succ_1", "pick_cup_succ_1"), ("/a/bad", "bad")], "path string, folder string"), {"succ": "successful"}).collect()
    assert [(r.task, r.quality_label, r.part) for r in g] == [("pick cup", "successful", "1")]


def test_expert_failures(spark):
    sub = {"4_expert": ({"aug_1.png": ("recoverable_failure",)},), "9_expert": ({"aug_2.png": ("fine",)},)}
    images = [f"{k}_expert.png" for k in (0, 2, 4, 6)] + ["x_aug_1.png"]
    df = spark.createDataFrame([("goal", "front", images, sub)], "task_goal string, view string, images array<string>, subgoal map<string, struct<augmentation: map<string, struct<label: string>>>>")
    got = {r.quality_label: r.images for r in rd.expert_failures(df).collect()}
    assert got == {"successful": images[:4], "failure": ["0_expert.png", "2_expert.png", "x_aug_1.png"]}


def test_captions_and_matrices(spark, tmp_path):
    item = {"image": "a.npy", "planing": "1open the door\nthen", "caption": "c", "score": 1.0}
    for k, root in enumerate([[item], {"results": [item, {"image": None, "planing": "x", "caption": "y"}]}]):
        got = rd.plan_captions(spark, write(tmp_path, f"{k}.json", json.dumps(root))).collect()
        assert [r.task for r in got] == ["open the door"]
    for k, m in enumerate(([[1, 2], [3, 4]], {"confusion_matrix": [[1, 2], [3, 4]]})):
        assert sorted(tuple(r) for r in rd.matrix_json(spark, write(tmp_path, f"m{k}.json", json.dumps(m))).collect()) == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)]
    got = rd.result_metrics(spark, write(tmp_path, "r.json", json.dumps({"a/acc": 1.0, "a/x/y": 2.0, "b/acc": 3.0})), ["a"]).collect()
    assert sorted((r.metric, r.value) for r in got) == [("acc", 1.0), ("x/y", 2.0)]
    cut = rd.success_cutoffs(spark, write(tmp_path, "cut.txt", "a, 0.8\n\nno comma here\nb,0.9\n")).collect()
    assert {r.data_source: r.success_percent for r in cut} == {"a": 0.8, "b": 0.9}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("d1", "m", 1.0), ("d2", "m", 2.0)], "dataset string, metric string, value double")
    sinks.save_metrics(df, str(tmp_path / "m"))
    sinks.save_metrics(df.where("dataset = 'd1'").withColumn("value", F.lit(5.0)), str(tmp_path / "m"))
    assert {r.dataset: r.value for r in spark.read.parquet(str(tmp_path / "m")).collect()} == {"d1": 5.0, "d2": 2.0}
    sinks.save_table(df, str(tmp_path / "t"), {"max_frames": 16, "fps": 1})
    m = spark.read.json(str(tmp_path / "t/manifest")).first()
    assert m.total == 2 and len(m.config_hash) == 32
    assert sinks.cache_folder("/c", "org/set:1", "a") == "/c/org_set_1/a"


def test_streaming(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a", "pick"), ("b", "pick"), ("c", "place")], "id string, task string").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("id string, task string").parquet(str(src))

    def encoder(batches):
        for s in batches:
            yield s.map(lambda t: [float(len(t))])

    from collections.abc import Iterator

    import pandas as pd

    encoder.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    st.ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp"), encoder).awaitTermination()
    assert {r.id: r.lang_vector for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a": [4.0], "b": [4.0], "c": [5.0]}
    done = spark.createDataFrame([("a",)], "id string")
    assert st.not_yet_done(spark.read.parquet(str(src)), done, "id").count() == 2


def test_best_checkpoints(spark, tmp_path):
    rows = [("m", k, v) for k, v in enumerate([0.1, 0.5, 0.5, 0.3, 0.9])]
    spark.createDataFrame(rows, "model string, step long, score double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("model string, step long, score double").parquet(str(tmp_path / "in"))
    st.best_checkpoints(stream, 2).writeStream.format("memory").queryName("best").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert [r.step for r in spark.table("best").orderBy("step").collect()] == [0, 1, 2, 4]


def test_models(spark):
    df = spark.createDataFrame([(k, "progress" if k % 2 else "preference", [0.5, float(k)]) for k in range(6)], "id bigint, sample_type string, values array<double>")
    out = models.by_sample_type(df, {"progress": lambda: lambda b: [1.0] * len(b), "preference": lambda: lambda b: [2.0] * len(b)}, "score", "double").collect()
    assert {r.id: r.score for r in out} == {k: 1.0 if k % 2 else 2.0 for k in range(6)}
    got = df.select(models.fit_length(F.col("values"), F.lit(3)).alias("v")).collect()
    assert got[0].v == [0.5, 0.0, 0.0] and got[4].v == [0.005, 0.04, 0.04]


def test_decoders(spark, tmp_path):
    import io
    import pickle
    import tarfile

    import numpy as np

    from tracklake.sources import decoders as dec

    frames = np.arange(24, dtype=np.uint8).reshape(4, 2, 3)
    np.savez(tmp_path / "a.npz", frames=frames, shape=np.array(frames.shape))
    np.savez(tmp_path / "e.npz", video_embeddings=np.ones((2, 3)), text_embedding=np.zeros(2))
    (tmp_path / "broken.npz").write_bytes(b"no archive")
    np.save(tmp_path / "m.npy", np.array([[1, 2], [3, 4]]))
    with tarfile.open(tmp_path / "t.tar", "w") as t:
        for name, body in (("7/videos/head.mp4", b"abc"), ("7/meta.json", b"{}")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    (tmp_path / "p.pkl").write_bytes(pickle.dumps([{"task": "wipe", "n": 3}, {"task": None}]))
    (tmp_path / "bad.pkl").write_bytes(pickle.dumps(io.BytesIO))
    npz = dec.files(spark, str(tmp_path), "*.npz")
    got = {(r.path.rsplit("/", 1)[1], r.frame_idx): r for r in dec.npz_frames(npz).collect()}
    assert [bytes(got["a.npz", k].payload) for k in range(4)] == [f.tobytes() for f in frames] and got["a.npz", 0].shape == [2, 3]
    assert "KeyError" in got["e.npz", None].error and got["broken.npz", None].error and len(got) == 6
    e = next(r for r in dec.npz_embeddings(npz).collect() if r.error is None)
    assert e.video_embeddings == [[1.0] * 3] * 2 and e.text_embedding == [0.0, 0.0]
    assert sorted((r.row, r.column, r.value) for r in dec.npy_matrix(dec.files(spark, str(tmp_path), "*.npy")).collect()) == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)]
    assert [(r.member, bytes(r.payload)) for r in dec.tar_members(dec.files(spark, str(tmp_path), "*.tar"), ".mp4").collect()] == [("7/videos/head.mp4", b"abc")]
    p = {(r.path.rsplit("/", 1)[1], r.pos): r for r in dec.pickled_records(dec.files(spark, str(tmp_path), "*.pkl"), ("task", "n")).collect()}
    assert p["p.pkl", 0].record == {"task": "wipe", "n": "3"} and p["p.pkl", 1].record == {"task": None, "n": None} and "not allowed" in p["bad.pkl", None].error
    fits = dec.stated_shape(dec.npz_frames(npz), F.array(F.lit(4), F.lit(2), F.lit(3))).collect()
    assert [(r.n_frames, r.fits) for r in fits] == [(4, True)]
