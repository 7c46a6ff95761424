"""Readers of folder layouts, metadata lists and task tables on hand-made files; replies; running sums; samplers in turn."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tracklake.functions import frames as fr
from tracklake.functions import text as tx
from tracklake.operators import sampling
from tracklake.sources import layouts


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def test_quality_folders(spark):
    files = paths(
        spark, "/d/fold/success/2_ext.mp4", "/d/fold/success/1_wrist.mp4", "/d/fold/success/3.mp4", "/d/fold/other/1_ext.mp4", "/d/pour/failure/1_ext.mp4",
        "/d/fold/suboptimal/9_ext.mp4", "/d/nothing/success/1_ext.mp4", "/d/pour/failure/1_ext.mp4", None,
    )
    known = spark.createDataFrame([("fold", "fold it"), ("pour", "pour it")], "task_name string, instruction string")
    got = sorted((r.episode_index, r.task, r.quality_label, r.part, r.frames) for r in layouts.quality_folders(files, known, "New").collect())
    assert got == [
        (0, "fold it", "suboptimal", "ext", "new/shard_0000/episode_000000/ext.mp4"), (1, "fold it", "successful", "wrist", "new/shard_0000/episode_000001/wrist.mp4"), (2, "fold it", "successful", "ext", "new/shard_0000/episode_000002/ext.mp4"),
        (3, "pour it", "failure", "ext", "new/shard_0000/episode_000003/ext.mp4"), (4, "pour it", "failure", "ext", "new/shard_0000/episode_000004/ext.mp4"),
    ]
    assert {r.part for r in layouts.quality_folders(files, known, "New", without=["wrist"]).collect()} == {"ext"}
    assert layouts.quality_folders(files.limit(0), known, "New").count() == 0


def test_numbers_are_gapless(spark):
    rng = random.Random(1)
    names = [(f"t{rng.randrange(6)}", rng.randrange(3), f"{rng.randrange(10**6)}") for _ in range(3000)]
    df = spark.createDataFrame(names, "task string, place int, name string").repartition(7)
    got = sorted((r.episode_index, r.task, r.place, r.name) for r in layouts.number_episodes(df, ["task", "place"], "name").collect())
    assert [g[0] for g in got] == list(range(3000)) and [g[1:] for g in got] == sorted(names)
    assert layouts.episode_path("D", F.lit(12345), F.lit("v")) is not None
    assert spark.range(1).select(layouts.episode_path("D", F.lit(12345), F.lit("v"))).first()[0] == "d/shard_0012/episode_012345/v.mp4"


def test_metadata_lists(spark, tmp_path):
    entry = lambda k, word, **more: {"filename": f"{k}.mp4", "success": word, "instruction": "fold", "task_name": "fold", "episode_idx": k} | more
    (tmp_path / "fold_metadata.json").write_text(json.dumps([entry(1, "success"), entry(2, "fail"), entry(1003, "suboptimal"), entry(4, "success", filename=None), entry(5, "success", instruction=None)], indent=1))
    (tmp_path / "bad_metadata.json").write_text("[{")
    (tmp_path / "empty_metadata.json").write_text("[]")
    (tmp_path / "other.json").write_text(json.dumps([entry(9, "success")]))
    got = sorted((r.frames, r.quality_label, r.source_path.rsplit("/", 1)[1]) for r in layouts.metadata_episodes(spark, str(tmp_path), "P").collect())
    assert got == [("p/shard_0000/episode_000001/fold.mp4", "successful", "1.mp4"), ("p/shard_0000/episode_000002/fold.mp4", "failure", "2.mp4"), ("p/shard_0001/episode_001003/fold.mp4", "suboptimal", "1003.mp4")]


def test_attempts_and_sub_episodes(spark):
    images = paths(
        spark, *[f"/d/Pick/7/Ground_Truth/front/{n}.png" for n in (10, 9, "b", "a", 1)], "/d/Pick/7/slip/front/2.png", "/d/Pick/7/slip/back/2.png", "/d/Pick/7/slip/front/2.txt", "/d/Push/1/slip/side/1.png", "short.png", None,
    )
    known = spark.createDataFrame([("Pick", "pick it")], "task_name string, instruction string")
    got = {(r.task, r.attempt, r.view): [p.rsplit("/", 1)[1] for p in r.images] for r in layouts.attempt_episodes(images, known).collect()}
    assert got == {("pick it", "Ground_Truth", "front"): ["1.png", "9.png", "10.png", "a.png", "b.png"], ("pick it", "slip", "front"): ["2.png"], ("Push", "slip", "side"): ["1.png"]}
    rows = spark.createDataFrame([("k", "i", "Push", None, ["a/side/1.png", "a/front/1.png"]), ("k", "i", "", "slip", ["a/wrist/1.png"]), ("k", "i", None, None, None)], "task string, instruction string, sub_task string, failure_type string, image array<string>")
    out = layouts.failure_episodes(images, rows, known, 1, part=1.0).collect()
    # Push has a failure as an episode and a success as a sub-episode in two views; i has a failure alone.
    assert sorted((r.task, r.view, r.quality_label) for r in out) == [("Push", "front", "successful"), ("Push", "side", "failure"), ("Push", "side", "successful"), ("pick it", "front", "failure"), ("pick it", "front", "successful")]


def test_numbered_episodes(spark):
    images = paths(spark, *[f"/x/pour/9/frame{n:07d}.png" for n in (24, 0, 110)], "/x/pour/10/frame1.png", "/x/pour/other/frame1.png", "/x/dig/9/frame1.png", "/x/push/1/frame1.png", "/x/push/1/frame2.png")
    labels = spark.createDataFrame([("pour", 9, 1), ("pour", 10, 0), ("dig", 9, 0), ("push", 1, 0)], "task string, episode int, label int")
    known = spark.createDataFrame([("pour", "pour it"), ("push", "push it")], "task_name string, instruction string")
    got = layouts.numbered_episodes(images, labels, known, "F", skip=1).collect()
    assert sorted((r.task, r.episode, [p[-6:-4] for p in r.images], r.quality_label) for r in got) == [("pour it", 9, ["24", "10"], "failure"), ("push it", 1, ["e2"], "successful")]
    assert layouts.numbered_episodes(images, labels, known, "F", skip=0, most=2).count() == 2


def test_task_tables(spark, tmp_path):
    table = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/meta")
    table("a_Suboptimal", [(0, "first"), (1, "second")], "task_index long, `__index_level_0__` string")
    table("b", [(0, " ", "said")], "task_index long, blank string, text string")
    table("c", [(0, None)], "task_index long, text string")
    # Tables of one read share their columns.
    tasks = layouts.first_task_texts(spark.newSession(), f"{tmp_path}/a_Suboptimal").unionByName(layouts.first_task_texts(spark, f"{tmp_path}/b")).unionByName(layouts.first_task_texts(spark, f"{tmp_path}/c"))
    assert sorted(map(tuple, tasks.collect())) == [("a_Suboptimal", "first"), ("b", "said")]
    files = paths(spark, "/v/a_Suboptimal/videos/front/1.mp4", "/v/b/videos/front/1.mp4", "/v/c/videos/front/1.mp4")
    assert sorted((r.task, r.quality_label) for r in layouts.dataset_videos(files, tasks).collect()) == [("first", "suboptimal"), ("said", "successful")]


def test_names(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(layouts.robot_of_path(F.lit("/a/Stretch_motion/human.mp4"))) is True and one(layouts.robot_of_path(F.lit("/a/human_motion/x"))) is False
    with pytest.raises(Exception, match="neither robot nor human"):
        one(layouts.robot_of_path(F.lit("/a/b")))
    got = layouts.folders_with(paths(spark, "/d/t1/videos/color.mp4", "/d/t2/videos/depth.mp4", "/d/t3/color.mp4")).collect()
    assert [r.folder for r in got] == ["t1"]
    clips = layouts.labelled_clips(paths(spark, "/c/q/1_closs_succ.gif", "/c/q/2_fail.gif", "/c/q/3_succ.gif", "/c/q/4_succ.mp4"), spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "episode string, task string"), 2)
    assert sorted((r.task, r.quality_label) for r in clips.collect()) == [("a", "suboptimal"), ("b", "failure")]
    attributes = spark.createDataFrame([(json.dumps({"t": {"embodiment_type": "human_hand"}, "u": {"embodiment_type": "h1"}}),)], "per_task_attributes string")
    files = spark.createDataFrame([("t", "/1", "d", ["left", "top", "right"]), ("u", "/2", "e", ["left"]), ("w", "/3", "f", ["left"]), ("t", "/4", "g", None)], "task_name string, path string, description string, cameras array<string>")
    assert sorted((r.frames, r.is_robot, r.part) for r in layouts.camera_rows(files, attributes).collect()) == [("/1", False, "left"), ("/1", False, "right"), ("/2", True, "left")]


def test_reply_completion(spark):
    item = lambda k, v: {"frame_number": k, "task_completion_percentage": v}
    fenced = lambda x: f"so:\n```json\n{json.dumps(x)}\n```\n"
    cases = [
        (fenced([item(0, 10), item(1, 20), item(2, 30), item(1, 25)]), [2, 0, 1], [0.25, 0.3, 0.1]), (fenced([item(7, 10), item(2, 30)]), [2, 0, 1], [0.3]), (json.dumps([item(0, 50.5)]), [0], [0.505]),
        (fenced(item(0, 10)), [0], []), ("none", [0, 1], []), ("", [], []), (None, [0], []),
    ]
    df = spark.createDataFrame([(k, t, p) for k, (t, p, _) in enumerate(cases)], "k int, t string, p array<int>")
    got = {r.k: r.v for r in df.select("k", tx.reply_completion(F.col("t"), F.col("p")).alias("v")).collect()}
    assert got == {k: pytest.approx(v) for k, (_, _, v) in enumerate(cases)}


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [[rng.randrange(-50, 50) / 4 for _ in range(n)] for n in (0, 1, 2, 3, 4, 5, 31, 32, 33, 1000)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate([*rows, None])], "k int, v array<double>")
    got = {r.k: (r.s, r.back) for r in df.select("k", fr.running_sum(F.col("v")).alias("s"), fr.deltas(fr.running_sum(F.col("v"))).alias("back")).collect()}
    for k, v in enumerate(rows):
        assert got[k][0] == list(itertools.accumulate(v)) and got[k][1][1:] == v[1:]
    assert got[len(rows)] == (None, None)


def test_circular(spark):
    rows = [(k, f"t{k % 3}", [0.0, 0.5, None, 1.0][k % 4] if k % 3 else 0.5) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, task string, partial_success double")
    for most in (None, 1, 5, 100):
        got = sampling.circular(df, "task", "partial_success", most, 3, "c").collect()
        again = sampling.circular(df.repartition(5), "task", "partial_success", most, 3, "c").collect()
        assert {(r.id, r.place) for r in got} == {(r.id, r.place) for r in again}
        for t in ("t1", "t2"):
            mine = sorted((r.place, r.partial_success) for r in got if r.task == t)
            left = {v: sum(1 for r in rows if r[1] == t and r[2] == v) for v in (0.0, 0.5, 1.0)}
            want = []
            while any(left.values()) and (most is None or len(want) < most):
                for v in sorted(left):
                    if left[v] and (most is None or len(want) < most):
                        left[v] -= 1
                        want.append(v)
            assert [m[1] for m in mine] == want and [m[0] for m in mine] == list(range(1, len(want) + 1))
        assert not [r for r in got if r.task == "t0"]  # one partial success only


def test_tasks_by_their_labels(spark):
    from tracklake.operators import curate
    from tracklake.sources import readers

    rows = [(1, "a", "successful"), (2, "a", "failure"), (3, "b", "successful"), (4, None, "failure"), (5, None, "successful"), (6, "c", None), (7, "c", "failure"), (1, "a", "successful")]
    df = spark.createDataFrame(rows, "id int, task string, quality_label string")
    assert sorted(r.id for r in curate.keep_mixed_tasks(df).collect()) == [1, 1, 2, 4, 5]
    assert sorted(r.id for r in curate.keep_mixed_tasks(df, ["successful"]).collect()) == [1, 1, 2, 3, 4, 5]
    assert curate.keep_mixed_tasks(df.limit(0)).count() == 0
    assert readers.need_success(df.where("task <> 'c'")).count() == 4
    with pytest.raises(Exception, match="no success of task c"):
        readers.need_success(df).collect()


def test_mixed_tasks_of_any_size(spark):
    from tracklake.operators.curate import keep_mixed_tasks

    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", "c", None, "d", "e"]), rng.choice(["successful", "failure", "suboptimal", None]), k) for k in range(3000)]
    rows = [(t, q if t not in ("b", "d") or q != "failure" else "suboptimal", k) for t, q, k in rows] + [("f", "failure", -1), ("f", "successful", -2), ("g", "failure", -3)]
    df = spark.createDataFrame(rows, "task string, quality_label string, id int").withColumn("__m", F.create_map("id", "id")).withColumn("x.y", F.lit(1))
    want = sorted(k for t, _, k in rows if {"successful", "failure"} <= {q for s, q, _ in rows if s == t})
    for large in (1, 100, 10**9):
        got = keep_mixed_tasks(df, large=large)
        assert got.columns == df.columns and sorted(r.id for r in got.collect()) == want


def test_rows_of_a_large_task_are_dealt(spark):
    from tracklake.operators.curate import keep_mixed_tasks

    df = spark.range(40_000).select("id", F.lit("one").alias("task"), F.when(F.col("id") % 2 == 0, "successful").otherwise("failure").alias("quality_label"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", False)
        sizes = keep_mixed_tasks(df, large=1000).rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 40_000 and max(sizes) < 20_000


def test_reply_blocks_are_looked_for_once(spark):
    from tracklake.functions import text as tx

    item = '{"frame_number": 1, "task_completion_percentage": 50}'
    texts = [f"```json\n[{item}]\n```", f"so [{item}] and", "none", "```\n{}\n```", "```json\n[{\n```", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.reply_items(F.col("t")).alias("r"))
    assert [None if r[0] is None else [tuple(x) for x in r[0]] for r in df.collect()][:4] == [[(1, 50.0)], [(1, 50.0)], None, None]
    assert df.collect()[5][0] is None
    assert df._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") == 2


def test_failure_episodes_of_large_tasks(spark, monkeypatch):
    """Whole episodes and sub-episodes of one large task are the same rows however the task is looked up."""
    from tracklake.operators import curate

    images = paths(spark, *[f"/d/Pick/{k}/{'Ground_Truth' if k % 2 else 'slip'}/front/{n}.png" for k in range(60) for n in (2, 1)], "/d/Push/1/slip/front/1.png")
    rows = spark.createDataFrame([("Pick", "pick it", "", "slip" if k % 3 else None, [f"/d/front/{k}.png"]) for k in range(60)], "task string, instruction string, sub_task string, failure_type string, image array<string>")
    known = spark.createDataFrame([("Pick", "pick it")], "task_name string, instruction string")
    seen = []
    for large in (1, 10**9):
        monkeypatch.setattr(curate.keep_mixed_tasks, "__defaults__", (("successful", "failure"), large))
        seen.append(sorted(map(repr, layouts.failure_episodes(images, rows, known, 7, part=1.0).collect())))
    assert seen[0] == seen[1] and len(seen[0]) == 120


def test_failure_episodes_of_a_large_task_are_dealt(spark):
    """120,000 episodes of one task do not meet in one task of Spark."""
    n = 120_000  # more than curate.LARGE_TASK
    images = spark.range(n).select(F.concat(F.lit("/d/Pick/"), "id", F.when(F.col("id") % 2 == 0, "/Ground_Truth").otherwise("/slip"), F.lit("/front/1.png")).alias("path"))
    rows = spark.createDataFrame([("Push", "push it", "", None, ["/d/front/1.png"])], "task string, instruction string, sub_task string, failure_type string, image array<string>")
    known = spark.createDataFrame([("Pick", "pick it")], "task_name string, instruction string")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", False)
        sizes = [r["count"] for r in layouts.failure_episodes(images, rows, known, 7, part=1.0).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(sizes) == n and max(sizes) < n // 2
