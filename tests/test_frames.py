import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklake.functions import frames as fr
from tracklake.functions import text as tx


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 8, 31])
def test_index_rules(spark, n):
    c = F.lit(n)
    got = one(spark, *[f(c, k) for k in (1, 2, 4, 8) for f in (fr.linspace_indices, fr.floor_indices, fr.stride_indices)])
    at = 0
    for k in (1, 2, 4, 8):
        every = list(range(n))
        spaced = np.linspace(0, n - 1, k) if n else []
        want = (every if n <= k else [n - 1] if k == 1 else np.rint(spaced).astype(int).tolist(), every if n <= k else sorted(set(np.floor(spaced).astype(int).tolist())), every if n <= k else [int(i * n / k) for i in range(k)])
        for w in want:
            assert got[at] == w, (n, k, at)
            at += 1


def test_targets(spark):
    i, n = F.array(*map(F.lit, [2, 3, 4])), F.lit(5)
    p = fr.first_frame_progress(i, n)
    got = one(
        spark, p, fr.absolute_progress(i, n, 0.8), fr.deltas(p), fr.partial_success_progress(i, p, n, F.lit(0.25)), fr.success_labels(p, F.lit("failed"), F.lit(0.1)), fr.success_labels(p, F.lit("successful"), F.lit(0.5)),
        fr.last_frame_mask(i, n, F.lit(0.25)), fr.last_frame_mask(i, n, F.lit(None).cast("double")), fr.pad(i, 5), fr.pad(i, 5, left=True), fr.segment_walk(F.lit(0), F.lit(3), F.lit(1)), fr.walk("rewind", i),
    )
    assert list(got) == [[0.0, 0.5, 1.0], [0.6, 0.8, 1.0][:2] + [1.0], [0.0, 0.5, 0.5], [0.0, 0.0, 0.25], [0.0] * 3, [0.0, 1.0, 1.0], [0.0, 0.0, 1.0], [1.0] * 3, [2, 3, 4, 4, 4], [2, 2, 2, 3, 4], [0, 1, 2, 3, 2, 1], [2, 4, 3]]


def test_bins(spark):
    got = one(spark, fr.discrete_bin(F.lit(0.125), 5), fr.discrete_bin(F.lit(0.375), 5), fr.two_hot(F.lit(0.3), 3), fr.bins_to_value(F.array(*map(F.lit, [0.25, 0.25, 0.5])), True), fr.bins_to_value_hard(F.array(*map(F.lit, [0.1, 0.9, 0.9]))))
    assert got[0] == 0 and got[1] == 2 and got[2] == pytest.approx([0.4, 0.6, 0.0]) and got[3] == pytest.approx(0.625) and got[4] == 0.5


def test_hashed_subset_is_stable(spark):
    got = spark.range(50).select(fr.hashed_subset(F.lit(9), 3, F.col("id").cast("string")).alias("x")).collect()
    assert all(r.x == sorted(set(r.x)) and len(r.x) == 3 for r in got) and len({tuple(r.x) for r in got}) > 10


def test_text(spark):
    c = lambda s: F.lit(s)
    got = one(
        spark, tx.score_1_to_5(c("a 7 then 3 or 4.")), tx.score_1_to_5(c("Answer: 2, not 5")), tx.score_1_to_5(c("nine")), tx.json_block(c("x ```json\n[1]\n``` y")), tx.json_block(c('z [{"a": 1}] z')),
        tx.reply_decision(c("Decision: Failure\nConfidence: 80%\nReasoning: dropped it")), tx.reply_decision(c("looks like success")), tx.task_from_video_name(c("pick_up_cup_fail.mp4")), tx.task_from_video_name(c("open door, try 2.mp4")),
        tx.folder_parts(c("a_b_succ_3")), tx.folder_parts(c("a_b")), tx.third_at_part(c("a@b@c")), tx.third_at_part(c("ab")), tx.stable_shard(c("12345")), tx.sort_by_number(F.array(c("f10.png"), c("f2.png"), c("x.png"))), tx.number_list(c("[1, 2.5]")), tx.number_list(c("no")),
    )
    assert got[:5] == (4, 2, None, "[1]", '[{"a": 1}]')
    assert tuple(got[5]) == ("failure", 0.8, "Decision: Failure\nConfidence: 80%\nReasoning: dropped it") and got[6].label == "successful" and got[6].confidence == 0.6
    assert got[7] == "Pick up cup" and got[8] == "Open door" and tuple(got[9]) == ("a_b", "succ", "3") and got[10] is None
    assert got[11:14] == ("c", "ab", "shard_0012") and got[14] == ["x.png", "f2.png", "f10.png"] and got[15] == [1.0, 2.5] and got[16] == [0.0]


def test_floor_of_wide_ranges(spark):
    """The last frame is never lost to the rounding of a step."""
    cases = [(n, k) for n in (2, 3, 9, 62, 63, 97, 200, 399) for k in range(2, 65)]
    rows = spark.createDataFrame(cases, "n int, k int")
    got = {(r.n, r.k): r.x for r in rows.select("n", "k", fr.floor_indices(F.col("n"), F.col("k")).alias("x")).collect()}
    assert all(got[n, k] == (list(range(n)) if n <= k else np.unique(np.linspace(0, n - 1, k, dtype=int)).tolist()) for n, k in cases)
    ends = rows.select("n", *[fr.spaced_ends(F.col("n"), k).alias(f"k{k}") for k in (1, 2, 8, 31)]).distinct().collect()
    assert all(r[f"k{k}"] == np.linspace(1, r.n, k, dtype=int).tolist() for r in ends for k in (1, 2, 8, 31))


def test_segments(spark):
    c = F.lit
    got = one(
        spark, fr.segment_indices(c(1), c(0), c(5)), fr.segment_indices(c(2), c(1), c(0)), fr.segment_indices(c(2), c(1), c(0), max_frames=1), fr.segment_indices(c(5), c(9), c(2)), fr.segment_indices(c(5), c(-1), c(3), c(1)),
        fr.segment_indices(c(6), c(1), c(2), c(4)), fr.segment_indices(c(6), c(1), c(None).cast("int")), fr.segment_indices(c(6), c(4), c(0), max_frames=1), fr.running_sum(F.array(c(0.5), c(0.25), c(-1.0))), fr.running_sum(F.array().cast("array<double>")),
    )
    assert list(got) == [[0], [0, 1], [0], [4, 3, 2], [0, 1, 2, 3], [1, 2, 3, 4, 3, 2], [1], [4], [0.5, 0.75, -0.25], []]


def test_subsample_ends(spark):
    rows = spark.range(1, 300).select("id", (F.col("id") % 9).cast("int").alias("n"))
    key = F.col("id").cast("string")
    for direction in ("forward", "reverse", "rewind", "bidirectional"):
        kinds = set()
        for r in rows.select("n", *[fr.subsample_ends(direction, F.col("n"), k, key).alias(f"k{k}") for k in (1, 2, 8)]).collect():
            assert (r.k1 is None) == (r.n < 1) and (r.k2 is None) == (r.n < 2) and (r.k8 is None) == (r.n < 3)
            if r.k1:
                assert 0 <= r.k1.start < r.n and r.k1.end is None
            if r.k2:
                assert r.k2.middle is None and ((r.k2.end < r.k2.start) if direction == "reverse" else (r.k2.start < r.k2.end))
            if r.k8:
                a, m, e = r.k8
                kinds.add("forward" if a < m < e else "reverse" if e < m < a else "rewind" if a < e < m else "?")
        assert kinds == ({direction} if direction != "bidirectional" else {"forward", "reverse", "rewind"})


def test_labels_of_any_case(spark):
    i, n, p = F.array(*map(F.lit, [0, 1])), F.lit(2), F.array(F.lit(0.5), F.lit(1.0))
    got = one(spark, fr.success_labels(p, F.lit("Failure"), F.lit(0.5)), fr.success_labels(p, F.lit(None).cast("string"), F.lit(0.6)), fr.last_frame_mask(i, n, F.lit(1.0), F.lit(True)), fr.last_frame_mask(i, n, F.lit(1.0), F.lit(False)))
    assert list(got) == [[0.0, 0.0], [0.0, 1.0], [0.0, 1.0], [1.0, 1.0]]


def test_replies(spark):
    c = lambda s: F.lit(s)
    replies = ["decision: success, not a failure\nconfidence: 0.7", "DECISION: maybe\nconfidence: 1.2.3", "no idea", "a success that did not fail", "decision: fail\ndecision: Success\nreasoning: it is in", "confidence: 90\nit failed"]
    got = [tuple(x) for x in one(spark, *[tx.reply_decision(c(r)) for r in replies])]
    assert got == [
        ("successful", 0.7, replies[0]), ("unknown", 0.5, replies[1]), ("unknown", 0.5, "no idea"), ("failure", 0.6, replies[3]), ("successful", 0.5, "it is in"), ("failure", 0.6, replies[5]),
    ]
    assert list(one(spark, *[tx.score_1_to_5(c(s)) for s in ("ANSWER: 45", "ANSWER: 45 or 3", "answer: 5", "ANSWER: 99999999999999 2")])) == [None, 3, 5, 2]
    assert list(one(spark, *[tx.json_block(c(s)) for s in ('[{"a": 1}] and [{"b": 2}]', "``` \n [1] \n ``` x ``` 2 ```", "none")])) == ['[{"a": 1}]', "[1]", ""]
    assert list(one(spark, *[tx.task_from_video_name(c(s)) for s in ("d/open_the_door, 2.mp4", "success_fail.mp4", "x_Failure_y.mp4", ",a.mp4")])) == ["Open the door", "Complete the task", "X y", "Complete the task"]
    assert list(one(spark, *[tx.third_at_part(c(s)) for s in ("a@b@ c @d", " ab ")])) == ["c", "ab"]
    cut = "x_x_x_x_x_x_" + __import__("hashlib").md5(b"x_" * 40).hexdigest()[:8]
    assert list(one(spark, tx.short_name(c("/data/x/")), tx.short_name(c("a b,c-d")), tx.short_name(c("x_" * 40), 21), tx.short_names(F.array(c("a/b"), c("long name")), {"a_b": "AB"}))) == ["data_x", "a_b_c-d", cut, "AB_long_name"]


def test_similar_names(spark):
    from tracklake.functions.similar import best_match, similarity

    rows = spark.createDataFrame([("Move the Cup",), ("cup",), ("zzz",), (None,)], "n string")
    got = rows.select("n", similarity(F.col("n"), F.lit("move the mug")).alias("s"), best_match(F.col("n"), ["move the mug", "move the cap", "cup"]).alias("b")).collect()
    assert got[0].b == "move the cap" and got[1].b == "cup" and got[2].b is None and got[3].b is None and got[3].s is None
    assert got[0].s == pytest.approx(__import__("difflib").SequenceMatcher(None, "move the cup", "move the mug").ratio())


def test_frame_geometry_and_held_losses(spark):
    import math

    from tracklake.operators import metrics

    sides = [(w, h) for w in (90, 101, 240, 305, 641) for h in (91, 240, 480)]
    df = spark.createDataFrame(sides, "w int, h int")
    for crop in (False, True):
        for r in df.select("w", "h", fr.resize_geometry(F.col("w"), F.col("h"), 240, crop).alias("g")).collect():
            edge = min(r.w, r.h)
            wide, high = (edge, edge) if crop else (r.w, r.h)
            even = lambda n: n if n % 2 == 0 else n + 1
            want = ((r.w - edge) // 2 if crop else 0, (r.h - edge) // 2 if crop else 0, even(int(wide * (240 / edge))), even(int(high * (240 / edge))))
            assert tuple(r.g) == want, (r, crop)
    scores = [(a, b) for a in (-1e4, -60.0, -1.5, 0.0, 30.0, 80.0) for b in (-70.0, 0.25, 49.0, 1e6)]
    hold = lambda x: max(-50.0, min(50.0, x))
    out = spark.createDataFrame(scores, "a double, b double").select("a", "b", metrics.similarity_loss(F.col("a"), F.col("b"), 2.0).alias("s"), metrics.preference_loss(F.col("a"), F.lit(1.0)).alias("p"))
    for r in out.collect():
        z = hold(2 * (hold(r.a) - hold(r.b)))
        assert r.s == pytest.approx(math.log1p(math.exp(-z))) and r.p == pytest.approx(math.log1p(math.exp(-hold(r.a))))


def test_rounded_as_floating_point(spark):
    import duckdb

    from tracklake.operators import metrics

    values = [0.285, 1.005, 2.675, 57007.784999999996, 70955.415, 53748.604999999996, -0.285, -2.5, 0.0, 1e300] + [k / 200 for k in range(1, 4000, 2)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(metrics.rounded(F.col("x"), 2)).collect()] == [v for (v,) in duckdb.connect().sql(f"SELECT round(x, 2) FROM (SELECT unnest({values}::DOUBLE[]) AS x)").fetchall()]


def test_ranking_by_reward_rounds_as_its_sql(spark, tmp_path):
    import duckdb

    from tracklake.plans.queries import QUERIES, SQL

    db = duckdb.connect()
    prices = {1: [57007.78, 57007.79], 2: [57007.78, 57007.78], 3: [70955.41, 70955.42], 4: [70955.41, 70955.41], 5: [53748.6, 53748.61], 6: [53748.6, 53748.6]}
    db.sql("CREATE TABLE customer AS SELECT CAST(k AS BIGINT) AS c_custkey, 'BUILDING' AS c_mktsegment FROM range(1, 4) t(k)")
    db.sql("CREATE TABLE orders AS SELECT CAST(k AS BIGINT) AS o_orderkey, CAST((k + 1) // 2 AS BIGINT) AS o_custkey, CASE k % 2 WHEN 0 THEN 'F' ELSE 'P' END AS o_orderstatus, 1.0::DOUBLE AS o_totalprice FROM range(1, 7) t(k)")
    db.sql("CREATE TABLE lineitem AS SELECT * FROM (VALUES " + ", ".join(f"({k}::BIGINT, {i + 1}, {p}::DOUBLE)" for k, of in prices.items() for i, p in enumerate(of)) + ") t(l_orderkey, l_linenumber, l_extendedprice)")
    for t in ("customer", "orders", "lineitem"):
        db.sql(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    got = QUERIES["ranking_by_reward"](spark, str(tmp_path)).select("kind", "correct", "total", "accuracy").collect()
    assert sorted(map(tuple, got)) == sorted(db.sql(SQL["ranking_by_reward"]).fetchall())
