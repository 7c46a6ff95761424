"""Walks and views of samples, and partners by number, against their definitions."""

import collections

from pyspark.sql import functions as F

from tracklake.operators import samples


def test_views_of_walks(spark):
    kinds = ["forward", "reverse", "rewind", "all"]
    rows = spark.range(200).select(
        "id", (F.col("id") % 41).cast("int").alias("num_frames"), F.element_at(F.array(*map(F.lit, kinds)), (F.col("id") % 4 + 1).cast("int")).alias("walk"),
        F.lit("s").alias("data_source"), F.lit("successful").alias("quality_label"), F.when(F.col("id") % 3 == 0, 0.5).alias("partial_success"),
    )
    for r in samples.trajectory_view(rows, 5, 7).collect():
        if r.num_frames < (1 if r.walk == "all" else 3):
            assert r.indices is None or r.indices == []
            continue
        i = r.indices
        assert len(i) == len(r.target_progress) == len(r.success_label) == len(r.predict_last_frame_mask) == 5 and all(0 <= k < r.num_frames for k in i)
        steps = [b - a for a, b in zip(i, i[1:])]
        if r.walk == "forward":
            assert min(steps) >= 0
        elif r.walk == "reverse":
            assert max(steps) <= 0
        elif r.walk == "rewind":
            turn = i.index(max(i))
            assert all(s >= 0 for s in steps[:turn]) and i[0] < max(i)
        if r.partial_success is None:
            s = min(i) if r.walk != "rewind" else i[0]
            want = [min(1.0, (k - s) / max(1, r.num_frames - s - 1)) for k in i]
            assert all(abs(a - b) < 1e-9 for a, b in zip(want, r.target_progress))
            assert r.predict_last_frame_mask == [1.0] * 5 and r.success_label == [float(p >= 1.0) for p in r.target_progress]
        else:
            assert set(r.target_progress) <= {0.0, 0.5} or r.num_frames - 1 not in i


def test_picks_are_even(spark):
    """Each row of the pool but the ref itself is picked about equally often; a lone row has none."""
    pool = spark.range(50).select("id", F.lit("a").alias("task"))
    refs = spark.range(4000).select("id", F.when(F.col("id") < 3999, "a").otherwise("b").alias("task"))
    got = samples.pick(refs, pool, ["task"], 3, "x").collect()
    n = collections.Counter(r.pick_id for r in got)
    assert len(got) == 4000 and n.pop(None) == 1 and set(n) == set(range(50)) and all(40 < k < 130 for k in n.values())
    assert all(r.ref_id != r.pick_id for r in got)
    assert samples.pick(pool.limit(1), pool.limit(1), ["task"], 3, "x").first().pick_id is None


def test_other_task_of_one_task(spark):
    from tracklake.operators.pairs import other_task

    one = spark.createDataFrame([(1, "a"), (2, "a")], "id bigint, task string")
    assert sorted((r.ref_id, r.task, r.pick_id) for r in other_task(one, one, 1, "x").collect()) == [(1, None, None), (2, None, None)]
    two = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id bigint, task string")
    got = {r.ref_id: r.task for r in other_task(two, two, 1, "x").collect()}
    assert got[1] == "b" and got[2] == "a" and got[3] in ("a", "b")


def test_picks_of_other_partial_success_are_even(spark):
    """Continuous values: only rows that differ enough are picked, each about equally often."""
    import random

    rng = random.Random(4)
    rows = [(k, "a" if k % 4 else "b", rng.choice([rng.random(), 0.5, 0.7])) for k in range(120)] + [(900, "c", 0.5), (901, "c", 0.6), (902, "a", None)]
    df = spark.createDataFrame(rows, "id bigint, task string, partial_success double").repartition(3)
    value, task = {r[0]: r[2] for r in rows}, {r[0]: r[1] for r in rows}
    hits = collections.Counter()
    for seed in range(12):
        got = samples.pick_other_partial(df, 0.2, seed, "x").collect()
        assert len(got) == len(rows)
        for r in got:
            if r.pick_id is None:
                others = [v for i, v in value.items() if v is not None and task[i] == task[r.ref_id] and value[r.ref_id] is not None and (v <= value[r.ref_id] - 0.2 or v >= value[r.ref_id] + 0.2)]
                assert not others
            else:
                assert task[r.pick_id] == task[r.ref_id]
                a, b = value[r.ref_id], value[r.pick_id]
                assert b <= a - 0.2 or b >= a + 0.2
                hits[r.pick_id] += 1
    assert sum(1 for i in range(120) if hits[i]) > 110


def test_other_task_is_even_and_of_the_source(spark):
    from tracklake.operators.pairs import other_task

    rows = [(k, f"t{k % 5}", "s" if k % 5 < 3 else "z", k % 2) for k in range(1000)]
    rows += [(2000 + k, "only bad", "s", 0) for k in range(5)]
    df = spark.createDataFrame(rows, "id bigint, task string, data_source string, good int")
    pool = df.where("good = 1")
    by = {r[0]: r for r in rows}
    got = other_task(df, pool, 3, "x").collect()
    assert len(got) == len(rows) and len({r.pick_id for r in got}) > 400  # not one row a task
    n = collections.Counter((by[r.ref_id][1], r.task) for r in got)
    assert all(by[r.pick_id][1] == r.task != by[r.ref_id][1] and by[r.pick_id][3] == 1 for r in got)
    for t in range(5):
        assert all(25 < n[f"t{t}", f"t{o}"] < 80 for o in range(5) if o != t)
    near = other_task(df, pool, 3, "x", 1.0, df).collect()
    for r in near:
        if r.task is not None:
            assert by[r.pick_id][2] == by[r.ref_id][2]
    # One of the three other tasks of source s has no row in the pool: two draws of it give none.
    lost = [r for r in near if r.task is None]
    assert all(by[r.ref_id][2] == "s" for r in lost) and 0.04 < len(lost) / sum(r[2] == "s" for r in rows) < 0.2
    half = other_task(df, pool, 3, "x", 0.5, df).collect()
    share = sum(r.task is not None and by[r.pick_id][2] == by[r.ref_id][2] for r in half) / len(half)
    assert 0.5 < share < 0.85


def test_tries_against_step_by_step_draws(spark):
    import hashlib

    weights = {"a": 1.0, "b": 2.0, "c": 0.5, "none": 0.0}
    rows = [(k, bool(k & 1), bool(k & 2), bool(k & 4), bool(k & 8)) for k in range(400)]
    df = spark.createDataFrame(rows, "id bigint, a boolean, b boolean, c boolean, known boolean")
    out = df.select("id", samples.tried(weights, {n: F.col(n) for n in "abc"}, 7, "p", {"b": F.col("known")}, 3, 6).alias("s")).collect()
    seen = collections.Counter()
    for r in out:
        can = dict(zip("abc", rows[r.id][1:4], strict=True))
        left = {n: w for n, w in weights.items() if w > 0 and (n != "b" or rows[r.id][4])}
        failed, want = collections.Counter(), None
        for i in range(1, 7):
            if not left:
                break
            u = int(hashlib.md5(f"7|p|{r.id}|{i}".encode()).hexdigest()[:8], 16) / 2**32 * sum(left.values())
            below = 0.0
            for n, w in left.items():
                below += w
                if u < below:
                    break
            if can[n]:
                want = (n, i)
                break
            failed[n] += 1
            if failed[n] == 3:
                del left[n]
        assert (None if r.s is None else tuple(r.s)) == want
        seen[want and want[1]] += 1
    assert seen[None] and max(k for k in seen if k) >= 4


def test_dominated_pairs_by_all_pairs(spark):
    import random

    from tracklake.operators import metrics

    rng = random.Random(5)
    rows = [(k, "ab"[k % 2], rng.choice([round(rng.random(), 1), rng.random()]), rng.choice([float(rng.randint(0, 9)), rng.random()])) for k in range(300)] + [(900, "c", 1.0, 1.0), (901, "a", None, 1.0), (902, "a", 1.0, None)]
    df = spark.createDataFrame(rows, "id bigint, g string, x double, y double")
    got = {r.g: (r.up, r.equal, r.total) for r in metrics.dominated_pairs(df, ["g"], "x", F.col("y")).collect()}
    for g in "abc":
        p = [(x, y) for _, h, x, y in rows if h == g and x is not None and y is not None]
        pairs = [(a, b) for a in p for b in p if a[0] < b[0]]
        assert got[g] == (sum(a[1] < b[1] for a, b in pairs), sum(a[1] == b[1] for a, b in pairs), len(pairs))
    many = spark.range(60_000).select(F.lit("g").alias("g"), F.md5(F.col("id").cast("string")).alias("x"), F.md5(F.concat(F.lit("y"), F.col("id").cast("string"))).alias("y"))
    r = metrics.dominated_pairs(many, ["g"], "x", F.col("y")).first()
    assert r.total == 60_000 * 59_999 // 2 and abs(r.up / r.total - 0.5) < 0.01


def test_dominated_pairs_in_one_pass(spark):
    """Few values on either side give the pairs, by sums along one chain of rows that is not joined to itself."""
    import random

    from tracklake.operators import metrics

    rng = random.Random(6)
    rows = [(g, rng.randint(0, few), rng.randint(0, 60 // (few + 1))) for g, few in (("a", 2), ("b", 40), ("c", 0)) for _ in range(120)]
    out = metrics.dominated_pairs(spark.createDataFrame(rows, "g string, x int, y int"), ["g"], "x", F.col("y"))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    for r in out.collect():
        pairs = [(a, b) for h, *a in rows for k, *b in rows if h == k == r.g and a[0] < b[0]]
        assert (r.up, r.equal, r.total) == (sum(a[1] < b[1] for a, b in pairs), sum(a[1] == b[1] for a, b in pairs), len(pairs))


def test_ranking_pairs_in_one_pass(spark):
    """Pairs of levels with equal rewards, equal and null ids, by sums along one chain of rows that is not joined to itself."""
    import random

    from tracklake.operators import metrics

    rng = random.Random(7)
    rows = [(rng.choice([None, *range(60)]), rng.choice("abc"), rng.choice([1, 2, 3]), rng.choice([None, *map(float, range(8))])) for _ in range(240)] + [(1, "d", 2, 1.0), (2, "e", 1, 1.0), (3, "e", 3, 2.0)]
    df = spark.createDataFrame(rows, "id bigint, task string, rank int, reward double")
    for strict in (False, True):
        out = metrics.ranking_pairs(df, "rank", strict)
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
        want = {}
        for i, t, k, x in rows:
            for j, s, m, y in rows:
                if t == s and k < m and x is not None and y is not None:
                    w = want.setdefault((t, k, m), [0, 0, 0, 0])
                    tie = x == y and not strict and i is not None and j is not None and i < j
                    for n, hit in enumerate((x < y or tie, x < y, x == y, True)):
                        w[n] += hit
        assert {(r.task, r.lower, r.higher): [r.correct, r.up, r.equal, r.total] for r in out.collect()} == want


def test_draws_are_made_once(spark):
    """A try draws once, however many expressions take its draw; partners compute their rows once."""
    df = spark.range(20).withColumns({"task": F.col("id").cast("string"), "data_source": F.lit("s"), "quality_label": F.lit("successful"), "is_robot": F.lit(True), "partial_success": F.lit(0.5), "num_frames": F.lit(5)}).repartition(2)
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    can = {n: F.col("id") % k == 0 for k, n in enumerate("abcd", 2)}
    assert plan(df.select(samples.tried(dict.fromkeys("abcd", 1.0), can, 3, "p"))).count("md5(") <= 2
    assert "Range" not in plan(samples.partners(df, 3))
