"""Queries of training batches, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklake.operators import batches, pairs
from tracklake.plans.canonical import table
from tracklake.plans.queries import _joined, _u, query, r6
from tracklake.plans.sample_queries import ONLY, SAMP, SEED, _samples

#: Views of four frames over all frames, with a cutoff of 0.9.
_VIEWS = f"""{SAMP}, t0 AS (SELECT *, num_frames AS n, list_transform(range(least(num_frames, 4)), lambda k: CASE WHEN num_frames <= 4 THEN k ELSE CAST(round_even(k * ((num_frames - 1) / 3), 0) AS BIGINT) END) AS own FROM samp WHERE num_frames IS NOT NULL),
 t1 AS (SELECT *, list_concat(own, list_transform(range(4 - len(own)), lambda k: own[-1])) AS i,
  list_transform(own, lambda k: CASE WHEN partial_success <> 1 THEN CASE WHEN k = n - 1 THEN partial_success ELSE 0 END ELSE least(1.0, k / greatest(1, floor(0.9::DOUBLE * n) - 1)) END) AS p FROM t0),
 t2 AS (SELECT *, list_concat(p, list_transform(range(4 - len(p)), lambda k: p[-1])) AS target FROM t1),
 v AS (SELECT id, task, data_source, quality_label, rank, partial_success, n, array_to_string(i, ',') AS indices, i[-1] AS last, target, round(list_sum(target), 6) AS progress,
  CAST(list_sum(list_transform(target, lambda x: CASE WHEN rank = 3 AND x >= 0.9 THEN 1 ELSE 0 END)) AS DOUBLE) AS success,
  CAST(CASE WHEN partial_success IS NULL OR (partial_success = 1 AND data_source <> 'AUTOMOBILE') THEN 4 ELSE len(list_filter(own, lambda k: k = n - 1)) END AS DOUBLE) AS masked,
  CAST(CASE WHEN data_source IN ('AUTOMOBILE') THEN 0 WHEN rank < 3 THEN 0 ELSE 1 END AS DOUBLE) AS weight, CAST(least(n, 4) AS DOUBLE) AS shown FROM t2)"""
_PAIRS = "pr AS (SELECT a.id AS c, b.id AS r, concat_ws('-', a.id, b.id) AS id FROM samp a JOIN samp b ON a.task = b.task AND a.rank > b.rank AND a.is_robot AND b.is_robot)"


def _rows(spark, d):
    return _samples(spark, d).where("num_frames is not null").withColumn("cutoff", F.lit(0.9))


def _quality_pairs(spark, d):
    p = pairs.quality_pairs(_samples(spark, d).select("id", "task", "is_robot", "quality_label"))
    return p.select(F.concat_ws("-", "chosen_id", "rejected_id").alias("id"), "chosen_id", "rejected_id", F.lit("suboptimal").alias("strategy"))


def _total(c):
    return r6(F.aggregate(c, F.lit(0.0), lambda a, x: a + x))


@query(f"""WITH {_VIEWS}, {_PAIRS} SELECT pr.id, v.task, v.indices AS chosen_indices, w.indices AS rejected_indices, v.progress AS chosen_progress, w.progress AS rejected_progress, v.quality_label AS chosen_label, w.quality_label AS rejected_label FROM pr JOIN v ON v.id = c JOIN v w ON w.id = r""")
def pair_views(spark, d):
    """Evaluation pairs joined to the frames, targets and labels of both sides."""
    p = batches.sides(_quality_pairs(spark, d), _rows(spark, d), ["chosen", "rejected"], 4, SEED, preference_only=ONLY, need=["chosen", "rejected"])
    return p.select("id", "chosen.task", *[_joined(F.col(f"{s}.indices")).alias(f"{s}_indices") for s in ("chosen", "rejected")], *[_total(F.col(f"{s}.target_progress")).alias(f"{s}_progress") for s in ("chosen", "rejected")], *[F.col(f"{s}.quality_label").alias(f"{s}_label") for s in ("chosen", "rejected")])


@query(f"WITH {_VIEWS} SELECT id, task, indices, n - 1 AS frame_step, progress, success, masked, shown FROM v")
def ranking_views(spark, d):
    """Each trajectory as one policy-ranking sample: its view, with the last frame as its step."""
    rows = _rows(spark, d)
    s = rows.select(F.col("id").alias("key"), F.col("id").alias("trajectory_id"))
    v = batches.sides(s, rows, ["trajectory"], 4, SEED, ONLY).select("trajectory.*")
    return v.select("id", "task", _joined(F.col("indices")).alias("indices"), (F.col("num_frames") - 1).alias("frame_step"), _total(F.col("target_progress")).alias("progress"), _total(F.col("success_label")).alias("success"), _total(F.col("predict_last_frame_mask")).alias("masked"), _total(F.col("padding_mask")).alias("shown"))


_FIRST = _u(f"'{SEED}'", "'first'", "pr.id") + " < 0.5"


@query(f"""WITH {_VIEWS}, {_PAIRS}, x AS (SELECT pr.*, {_FIRST} AS f FROM pr)
 SELECT x.id, CAST(f AS DOUBLE) AS label, v.id AS a_id, w.id AS b_id, v.progress AS a_progress, w.progress AS b_progress, v.success AS a_success, v.weight AS a_weight, w.weight AS b_weight, v.masked AS a_masked, w.shown AS b_shown,
 CASE WHEN f THEN 'subsample_task' ELSE 'suboptimal' END AS a_strategy FROM x JOIN v ON v.id = CASE WHEN f THEN c ELSE r END JOIN v w ON w.id = CASE WHEN f THEN r ELSE c END""")
def preference_batches(spark, d):
    """Both sides in the order of a coin, with targets, masks and weights."""
    b = batches.preference_batch(_quality_pairs(spark, d), _rows(spark, d), 4, SEED, True, preference_only=ONLY)
    return b.select(
        "id", "label", F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), _total(F.col("a.target_progress")).alias("a_progress"), _total(F.col("b.target_progress")).alias("b_progress"), _total(F.col("a.success_label")).alias("a_success"),
        F.col("a.progress_weight").alias("a_weight"), F.col("b.progress_weight").alias("b_weight"), _total(F.col("a.predict_last_frame_mask")).alias("a_masked"), _total(F.col("b.padding_mask")).alias("b_shown"), F.col("a.strategy").alias("a_strategy"),
    )


@query(f"""WITH {_VIEWS} SELECT id, CASE WHEN id % 4 = 0 THEN 'another task' ELSE task END AS instruction, indices, CASE WHEN id % 4 = 0 THEN 0 ELSE progress END AS progress, CASE WHEN id % 4 = 0 THEN 0 ELSE success END AS success, weight, masked, shown,
 'ANS: [' || array_to_string(list_transform(target, lambda x: CAST(CASE WHEN id % 4 = 0 THEN 0 ELSE round_even(x * 100, 0) END AS INTEGER)), ', ') || ']' AS answer FROM v""")
def progress_batches(spark, d):
    """Progress samples, a quarter of them with another task's instruction, whose targets are 0."""
    rows = _rows(spark, d)
    other = F.col("id") % 4 == 0
    s = rows.select("id", F.when(other, "another task").otherwise(F.col("task")).alias("instruction"), F.when(other, "different_task_instruction").otherwise("forward_progress").alias("strategy"), F.lit("all").alias("walk"), other.alias("is_other"))
    t = "trajectory"
    b = batches.progress_batch(s, rows, 4, SEED, preference_only=ONLY)
    return b.select(
        "id", "instruction", _joined(F.col(f"{t}.indices")).alias("indices"), _total(F.col(f"{t}.target_progress")).alias("progress"), _total(F.col(f"{t}.success_label")).alias("success"), F.col(f"{t}.progress_weight").alias("weight"),
        _total(F.col(f"{t}.predict_last_frame_mask")).alias("masked"), _total(F.col(f"{t}.padding_mask")).alias("shown"), batches.progress_answer(F.col(f"{t}.target_progress")).alias("answer"),
    )


@query(f"""WITH {_VIEWS}, s AS (SELECT id, id AS ref, lead(id) OVER w AS sim, lead(id, 2) OVER w AS diff FROM samp WINDOW w AS (PARTITION BY task ORDER BY id)),
 x AS (SELECT s.*, place, CASE place WHEN 0 THEN 'sim' ELSE 'diff' END AS against, CASE place WHEN 0 THEN sim ELSE diff END AS other FROM s, range(2) t(place)),
 y AS (SELECT *, {_u(f"'{SEED}'", "'first'", "CAST(id AS VARCHAR)", "against")} < 0.5 AS f FROM x), z AS (SELECT id, CASE WHEN against = 'diff' THEN 0 ELSE progress END AS p0, progress, against FROM v, (VALUES ('sim'), ('diff')) k(against))
 SELECT y.id, CAST(place AS INTEGER) AS place, CAST(f AS DOUBLE) AS label, CASE WHEN f THEN r.id ELSE o.id END AS a_id, CASE WHEN f THEN o.id ELSE r.id END AS b_id, CASE WHEN f THEN r.progress ELSE o.p0 END AS a_progress, CASE WHEN f THEN o.p0 ELSE r.progress END AS b_progress
 FROM y JOIN v r ON r.id = y.ref JOIN z o ON o.id = y.other AND o.against = y.against""")
def similarity_batches(spark, d):
    """References with a similar and a different side (of another task, so its targets are 0), two comparisons a sample."""
    from pyspark.sql import Window

    w = Window.partitionBy("task").orderBy("id")
    s = _samples(spark, d).select("id", F.col("id").alias("ref_id"), F.lead("id").over(w).alias("sim_id"), F.lead("id", 2).over(w).alias("diff_id"), F.lit("paired_human_robot").alias("strategy"), F.lit("all").alias("diff_walk"), F.lit(True).alias("is_other"))
    b = batches.similarity_batch(s, _rows(spark, d), 4, SEED, True, preference_only=ONLY)
    return b.select("id", "place", "label", F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), _total(F.col("a.target_progress")).alias("a_progress"), _total(F.col("b.target_progress")).alias("b_progress"))


@query(f"""WITH s AS (SELECT vec_id AS id, [embedding[16 * k + 1:16 * k + 16] for k in range(4)] AS v, embedding[1:8] AS t FROM embeddings), p AS (SELECT a.id, a.v AS cv, b.v AS rv, a.t, {_u(f"'{SEED}'", "'first'", "CAST(a.id AS VARCHAR)")} < 0.5 AS f FROM s a JOIN s b ON b.id = a.id + 1),
 c AS (SELECT id, f, t, CASE WHEN f THEN list_concat(cv, rv) ELSE list_concat(rv, cv) END AS e FROM p)
 SELECT id, CAST(f AS DOUBLE) AS label, len(e) AS steps, round(CAST(e[1][1] AS DOUBLE), 6) AS first, round(CAST(e[5][1] AS DOUBLE), 6) AS fifth, round(CAST(t[8] AS DOUBLE), 6) AS text FROM c""")
def embedding_batches(spark, d):
    """Series of vectors of a chosen and a rejected side, one after the other in time, with the text of the chosen one."""
    e = table(spark, d, "embeddings")
    quarter = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice("embedding", 16 * k + 1, 16))
    rows = e.select(F.col("vec_id").alias("id"), F.lit("t").alias("task"), F.lit("s").alias("data_source"), F.lit("successful").alias("quality_label"), F.lit(None).cast("double").alias("partial_success"), F.lit(4).alias("num_frames"), quarter.alias("video_embeddings"), F.slice("embedding", 1, 8).alias("text_embedding"))
    s = e.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("chosen_id"), (F.col("vec_id") + 1).alias("rejected_id"), F.lit("suboptimal").alias("strategy"))
    b = batches.embedded(batches.preference_batch(s, rows, 4, SEED, True, carry=["video_embeddings", "text_embedding"]))
    value = lambda k: F.round(F.col("video_embeddings")[k][0].cast("double"), 6)
    return b.select("id", "label", F.size("video_embeddings").cast("bigint").alias("steps"), value(0).alias("first"), value(4).alias("fifth"), F.round(F.col("text_embedding")[7].cast("double"), 6).alias("text"))


@query(f"""WITH {SAMP}, {_PAIRS}, x AS (SELECT pr.*, task, {_FIRST} AS f FROM pr JOIN samp ON samp.id = c)
 SELECT id, md5('Given these two robot videos, which one makes the most progress towards solving the task, Video 1 or 2? Format your answer as: ANS: 1/2' || chr(10) || chr(10) || 'Task: ' || task) AS question, 'ANS: ' || CASE WHEN f THEN '1' ELSE '2' END AS answer FROM x""")
def preference_questions(spark, d):
    """The question and answer of each pair, by its coin."""
    s = _samples(spark, d)
    p = _quality_pairs(spark, d).join(s.select(F.col("id").alias("chosen_id"), "task"), "chosen_id")
    from tracklake.functions.draws import uniform

    label = (uniform(SEED, "first", "id") < 0.5).cast("double")
    return p.select("id", F.md5(batches.preference_question(F.col("task"))).alias("question"), batches.preference_answer(label).alias("answer"))


@query("""WITH s AS (SELECT p_partkey, 'ANS: no, ' || p_name || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE chr(10) || 'ANS: ' || p_size END AS x FROM part WHERE p_partkey IS NOT NULL),
 t AS (SELECT p_partkey, list_transform(range((length(x) + 2) // 3), lambda k: substr(x, CAST(3 * k + 1 AS INTEGER), 3)) AS pieces FROM s),
 m AS (SELECT *, list_max(list_filter(range(len(pieces)), lambda i: starts_with(regexp_replace(array_to_string(pieces[i + 1:i + 8], ''), '^\\s+', ''), 'ANS:'))) AS start FROM t)
 SELECT p_partkey, array_to_string(list_transform(pieces, lambda x, i: CASE WHEN i - 1 >= start THEN length(x) ELSE -100 END), ',') AS labels FROM m""")
def answer_labels(spark, d):
    """Labels of tokens (three characters each) from the last answer on."""
    p = table(spark, d, "part")
    text = F.concat(F.lit("ANS: no, "), "p_name", F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.concat(F.lit("\nANS: "), "p_size")))
    pieces = F.regexp_extract_all(text, F.lit(r"(?s).{1,3}"), F.lit(0))
    return p.select("p_partkey", _joined(batches.answer_labels(F.transform(pieces, lambda x: F.length(x)), pieces)).alias("labels"))


@query("""WITH b AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, CAST(floor(value * 1000) AS BIGINT) & 4294967295 AS v FROM events WHERE value IS NOT NULL),
 s AS (SELECT *, lag(v) OVER (PARTITION BY id ORDER BY k) AS p FROM b),
 x AS (SELECT id, k, CASE WHEN p IS NULL THEN 0 ELSE (abs((v & 255) - (p & 255)) + abs((v >> 8 & 255) - (p >> 8 & 255)) + abs((v >> 16 & 255) - (p >> 16 & 255)) + abs((v >> 24 & 255) - (p >> 24 & 255))) / 4 END AS score FROM s),
 y AS (SELECT *, k = min(k) OVER (PARTITION BY id) OR k = max(k) OVER (PARTITION BY id) AS at_end FROM x)
 SELECT id, k AS frame_idx, round(score, 6) AS score FROM y QUALIFY row_number() OVER (PARTITION BY id ORDER BY at_end DESC, score DESC, k) <= 8""")
def moving_frames(spark, d):
    """Events as frames of four bytes: the ends of each user's series, and the frames that differ most from those before."""
    from pyspark.sql import Window

    from tracklake.operators import motion

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").where("value is not null").withColumn("frame_idx", (F.row_number().over(w) - 1).cast("bigint"))
    number = F.floor(F.col("value") * 1000).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))
    frames = e.select(F.col("user_id").alias("id"), "frame_idx", F.array(F.lit(2), F.lit(2)).alias("shape"), F.unhex(F.lpad(F.hex(number), 8, "0")).alias("payload"))
    return motion.moving_frames(frames, 8, "id").select("id", "frame_idx", F.round("score", 6).alias("score"))


@query("""WITH t AS (SELECT CAST(o_custkey AS VARCHAR) AS grp, o_orderkey AS id, o_orderstatus AS label FROM orders),
 s AS (SELECT grp, id, CAST(row_number() OVER (PARTITION BY grp ORDER BY md5('7|' || id)) AS INTEGER) AS place FROM t),
 p AS (SELECT a.grp, a.id AS first_id, min(b.id) AS second_id FROM t a JOIN t b ON a.grp = b.grp AND a.label <> b.label AND b.id > a.id GROUP BY 1, 2)
 SELECT 'sample_rows' AS sampler, grp, id, CAST(place AS BIGINT) AS other FROM s WHERE place <= 3 UNION ALL SELECT 'pair_next', grp, first_id, second_id FROM p""")
def sampler_functions(spark, d):
    """Two samplers called by SQL over the orders of each customer."""
    from tracklake.operators import table_functions

    table_functions.register(spark)
    t = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("grp"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("label"))
    sampled = spark.sql("SELECT 'sample_rows' AS sampler, grp, id, CAST(place AS BIGINT) AS other FROM sample_rows(TABLE(SELECT grp, id FROM {t}) PARTITION BY (grp), 3, 7)", t=t)
    paired = spark.sql("SELECT 'pair_next' AS sampler, grp, first_id AS id, second_id AS other FROM pair_next(TABLE(SELECT grp, id, label FROM {t}) PARTITION BY (grp) ORDER BY (id))", t=t)
    return sampled.unionByName(paired)
