"""Queries of the sampling core, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.operators import samples
from tracklake.plans.canonical import TRAJ, trajectories
from tracklake.plans.queries import _joined, _other, _u, _without_own, numbered, query, spot

SEED = 21
#: Half of the rows have a partial success; the sources by category.
SAMP = f"{TRAJ}, samp AS (SELECT * REPLACE (CASE WHEN id % 2 = 0 THEN NULL ELSE partial_success END AS partial_success) FROM traj)"
FAILURES, PAIRED, ONLY = ["BUILDING", "MACHINERY"], ["MACHINERY", "FURNITURE"], ["AUTOMOBILE"]
_GOOD, _BAD = "(SELECT * FROM samp WHERE rank = 3)", "(SELECT * FROM samp WHERE rank < 3)"


def _samples(spark, d) -> DataFrame:
    return trajectories(spark, d).withColumn("partial_success", F.when(F.col("id") % 2 == 1, F.col("partial_success")))


def _names(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


_PARTIAL = f"""pp AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY partial_success, left(md5(concat_ws('|', '{SEED}', 'partial', CAST(id AS VARCHAR))), 3), id) - 1 AS place FROM samp WHERE partial_success IS NOT NULL),
 pv AS (SELECT a.task, a.partial_success AS ps, count(*) FILTER (b.partial_success <= a.partial_success - 0.2) AS low, count(*) FILTER (b.partial_success < a.partial_success + 0.2) AS high, count(*) AS n
  FROM (SELECT DISTINCT task, partial_success FROM pp) a JOIN pp b ON a.task = b.task GROUP BY 1, 2),
 pt AS (SELECT s.id AS ref_id, p.id AS pick_id FROM (SELECT pp.*, low, high, low + n - high AS m, {spot(SEED, "partial")} AS spot FROM pp JOIN pv ON pv.task = pp.task AND pv.ps = pp.partial_success) s
  JOIN pp p ON p.task = s.task AND m > 0 AND p.place = CASE WHEN spot % greatest(m, 1) < low THEN spot % greatest(m, 1) ELSE high + spot % greatest(m, 1) - low END)"""
#: Rows by task and (successful, robot), and places in that order.
_CELLS = f"cells AS (SELECT *, row_number() OVER (PARTITION BY task, cell ORDER BY left(md5(concat_ws('|', '{SEED}', 'cell', CAST(id AS VARCHAR))), 3), id) AS in_cell FROM (SELECT *, CASE WHEN rank = 3 THEN 2 ELSE 0 END + CASE WHEN is_robot THEN 1 ELSE 0 END AS cell FROM samp))"


def _of_cells(name: str, where: str, purpose: str, keys: str = "task", refs: str = "samp") -> str:
    on = lambda a: " AND ".join(f"{a}.{k.strip()} = r.{k.strip()}" for k in keys.split(","))
    number = spot(SEED, purpose, "r.id")
    return f"""{name}_p AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY cell, in_cell) - 1 AS place FROM cells WHERE {where}), {name}_z AS (SELECT {keys}, count(*) AS n FROM {name}_p GROUP BY ALL),
 {name}_a AS (SELECT r.*, {_without_own(number, "z.n", "o.place")} AS want FROM {refs} r JOIN {name}_z z ON {on("z")} LEFT JOIN {name}_p o ON o.id = r.id AND {on("o")}),
 {name} AS (SELECT r.id AS ref_id, p.id AS pick_id FROM {name}_a r JOIN {name}_p p ON {on("p")} AND p.place = want)"""


_PARTNERS = f"""{SAMP}, {_CELLS}, {_of_cells("o", "rank = 3", "optimal")}, {_of_cells("b", "rank < 3", "plain")}, {_PARTIAL}, {_other(str(SEED), "other", "samp", _GOOD, 0.5, "samp")},
 {_of_cells("h", "rank = 3", "opposite", "task, is_robot", "(SELECT * REPLACE (NOT is_robot AS is_robot) FROM samp)")}, {_of_cells("r", "rank < 3 AND is_robot", "robot")},
 pa AS (SELECT s.*, o.pick_id AS optimal_id, CASE WHEN s.partial_success IS NULL THEN b.pick_id ELSE pt.pick_id END AS suboptimal_id, other.pick_id AS other_id, other.task AS other_task, h.pick_id AS opposite_id, r.pick_id AS robot_id
  FROM samp s LEFT JOIN o ON o.ref_id = s.id LEFT JOIN b ON b.ref_id = s.id LEFT JOIN pt ON pt.ref_id = s.id LEFT JOIN other ON other.ref_id = s.id LEFT JOIN h ON h.ref_id = s.id LEFT JOIN r ON r.ref_id = s.id),
 pn AS (SELECT pa.*, x.num_frames AS sub_n, x.partial_success AS sub_ps, y.num_frames AS other_n FROM pa LEFT JOIN samp x ON x.id = suboptimal_id LEFT JOIN samp y ON y.id = other_id)"""


def _q(text) -> str:
    return f"'{text}'"


def _draws(purpose: str, options: dict[str, tuple[float, str]]) -> str:
    """The options in the order of their weighted draws."""
    one = lambda n, w, free: f"{{'r': -pow({_u(_q(SEED), _q(purpose + '-' + n), 'CAST(id AS VARCHAR)')} + 1e-12, 1 / {w}::DOUBLE), 'name': '{n}', 'free': coalesce({free}, false)}}"
    return "list_sort([" + ", ".join(one(n, w, free) for n, (w, free) in options.items()) + "])"


def _tried(name: str, source: str, purpose: str, options: dict[str, tuple[float, str, str]], failures: int = 3, tries: int = 10) -> str:
    """CTEs up to ``name``: the rows of source with name_ and attempt after at most ``tries`` draws.

    options: weight, whether the strategy succeeds, whether it is known, by its name.
    """
    k = range(len(options))
    fails = ", ".join(f"CASE WHEN {known} THEN 0 ELSE {failures} END AS f{j}, coalesce({can}, false) AS c{j}" for j, (_, can, known) in enumerate(options.values()))
    steps = [f"{name}_0 AS (SELECT *, CAST(NULL AS VARCHAR) AS name_, 0 AS attempt, {fails} FROM {source})"]
    left = [f"CASE WHEN f{j} < {failures} THEN {w}::DOUBLE ELSE 0 END" for j, (w, _, _) in enumerate(options.values())]
    total = " + ".join(f"({x})" for x in left)
    names = list(options)
    for i in range(1, tries + 1):
        u = _u(_q(SEED), _q(purpose), "CAST(id AS VARCHAR)", _q(i))
        below = [" + ".join(f"({x})" for x in left[: j + 1]) for j in k]
        at = "CASE " + " ".join(f"WHEN f{j} < {failures} AND {u} * ({total}) < {below[j]} THEN {j}" for j in k) + " " + " ".join(f"WHEN f{j} < {failures} THEN {j}" for j in reversed(k)) + " END"
        hit = "CASE a " + " ".join(f"WHEN {j} THEN c{j}" for j in k) + " END"
        new = ", ".join(f"CASE WHEN a = {j} AND NOT {hit} THEN f{j} + 1 ELSE f{j} END AS f{j}" for j in k)
        named = "CASE a " + " ".join(f"WHEN {j} THEN '{n}'" for j, n in zip(k, names, strict=True)) + " END"
        steps.append(f"{name}_a{i} AS (SELECT *, CASE WHEN name_ IS NULL THEN {at} END AS a FROM {name}_{i - 1})")
        steps.append(f"{name}_{i} AS (SELECT * EXCLUDE (a) REPLACE (CASE WHEN a IS NULL THEN name_ WHEN {hit} THEN {named} END AS name_, CASE WHEN a IS NULL THEN attempt ELSE attempt + 1 END AS attempt, {new}) FROM {name}_a{i})")
    return ",\n ".join([*steps, f"{name} AS (SELECT * REPLACE (CASE WHEN name_ IS NOT NULL THEN attempt END AS attempt) FROM {name}_{tries})"])


_NAME, _ATTEMPT = "list_filter(l, lambda x: x.free)[1].name", "list_position(list_transform(l, lambda x: x.free), true)"


@query(f"WITH {_PARTNERS} SELECT id, optimal_id, suboptimal_id, other_id, other_task, opposite_id, robot_id FROM pa")
def partners(spark, d):
    p = samples.partners(_samples(spark, d), SEED)
    return p.select("id", *[F.col(f"{c}.id").alias(f"{c}_id") for c in ("optimal", "suboptimal", "other", "opposite", "robot")], "other_task")


_PREFERENCE = {"rewind": (1.0, "num_frames >= 3", "true"), "suboptimal": (1.0, "num_frames >= 3 AND sub_n >= 3", "true"), "different_task": (1.0, "num_frames >= 3 AND other_n >= 3", "true"), "reverse_progress": (1.0, "num_frames >= 3", "true")}


@query(f"""WITH {_PARTNERS}, {_tried("l", "pn", "preference", _PREFERENCE)}, w AS (SELECT *, rank < 3 AND partial_success IS NULL AND optimal_id IS NOT NULL AS whole FROM l),
 s AS (SELECT * REPLACE (CASE WHEN whole THEN 1 ELSE attempt END AS attempt), CASE WHEN whole THEN 'suboptimal' ELSE name_ END AS strategy FROM w),
 c AS (SELECT *, CASE WHEN whole THEN optimal_id WHEN strategy IS NOT NULL THEN id END AS c, CASE WHEN whole THEN id WHEN strategy = 'suboptimal' THEN suboptimal_id WHEN strategy = 'different_task' THEN other_id WHEN strategy IS NOT NULL THEN id END AS r,
  coalesce(NOT whole AND strategy = 'suboptimal' AND sub_ps > partial_success, false) AS swap FROM s)
 SELECT id, CASE WHEN swap THEN r ELSE c END AS chosen_id, CASE WHEN swap THEN c ELSE r END AS rejected_id, strategy, CASE WHEN strategy IS NULL THEN NULL WHEN whole THEN 'all' ELSE 'forward' END AS chosen_walk,
 CASE WHEN strategy IS NULL THEN NULL WHEN whole THEN 'all' WHEN strategy = 'rewind' THEN 'rewind' WHEN strategy = 'reverse_progress' THEN 'reverse' ELSE 'forward' END AS rejected_walk, CAST(attempt AS INTEGER) AS attempt FROM c""")
def preference_samples(spark, d):
    return samples.preference_samples(samples.partners(_samples(spark, d), SEED), SEED)


_PROGRESS = {"different_task_instruction": (1.0, "num_frames >= 3 AND other_task IS NOT NULL", "true"), "forward_progress": (1.0, "num_frames >= 3", "true"), "reverse_progress": (1.0, "num_frames >= 3", "true"), "rewind": (1.0, "num_frames >= 3", "true")}


@query(f"""WITH {_PARTNERS}, {_tried("l", "pn", "progress", _PROGRESS)}, s AS (SELECT *, name_ AS strategy FROM l)
 SELECT id, task, CASE WHEN strategy = 'different_task_instruction' THEN other_task WHEN strategy IS NOT NULL THEN task END AS instruction, strategy,
 CASE strategy WHEN 'reverse_progress' THEN 'reverse' WHEN 'rewind' THEN 'rewind' ELSE CASE WHEN strategy IS NOT NULL THEN 'forward' END END AS walk, strategy = 'different_task_instruction' AS is_other, CAST(attempt AS INTEGER) AS attempt FROM s""")
def progress_samples(spark, d):
    return samples.progress_samples(samples.partners(_samples(spark, d), SEED), SEED)


_DIFF = f"CASE WHEN robot_id IS NULL OR ({_u(f'{chr(39)}{SEED}{chr(39)}', chr(39) + 'diff' + chr(39), 'CAST(id AS VARCHAR)')} >= 0.5 AND other_id IS NOT NULL) THEN other_id ELSE robot_id END"
_SIMILARITY = {
    "rewind": (1.0, "optimal_id IS NOT NULL AND num_frames >= 3", "true"), "suboptimal": (2.0, "optimal_id IS NOT NULL AND suboptimal_id IS NOT NULL", f"data_source IN ({_names(FAILURES)})"),
    "paired_human_robot": (2.0, "opposite_id IS NOT NULL AND diff IS NOT NULL", f"data_source IN ({_names(PAIRED)})"),
}


@query(f"""WITH {_PARTNERS}, f AS (SELECT *, {_DIFF} AS diff FROM pn WHERE partial_success IS NOT NULL OR rank = 3), {_tried("l", "f", "similarity", _SIMILARITY, 4)}, s AS (SELECT *, name_ AS strategy FROM l)
 SELECT id, CASE WHEN strategy = 'paired_human_robot' THEN opposite_id WHEN strategy IS NOT NULL THEN optimal_id END AS sim_id, CASE strategy WHEN 'rewind' THEN id WHEN 'suboptimal' THEN suboptimal_id WHEN 'paired_human_robot' THEN diff END AS diff_id, strategy,
 CASE WHEN strategy = 'rewind' THEN 'rewind' WHEN strategy IS NOT NULL THEN 'all' END AS diff_walk, coalesce(strategy = 'paired_human_robot' AND diff = other_id, false) AS is_other, CAST(attempt AS INTEGER) AS attempt FROM s""")
def similarity_samples(spark, d):
    return samples.similarity_samples(samples.partners(_samples(spark, d), SEED), SEED, FAILURES, PAIRED)


_KINDS = _draws("kind", {"preference": (0.5, "num_frames >= 3"), "progress": (0.3, "num_frames >= 3"), "similarity": (0.2, "optimal_id IS NOT NULL")})


@query(f"""WITH {_PARTNERS}, l AS (SELECT *, rank < 3 OR (data_source IN ({_names(ONLY)}) AND coalesce(num_frames >= 3, false)) AS forced, {_KINDS} AS l FROM pn)
 SELECT id, CASE WHEN forced THEN CASE WHEN num_frames >= 3 THEN 'preference' END ELSE {_NAME} END AS kind, CAST(CASE WHEN forced THEN CASE WHEN num_frames >= 3 THEN 1 END ELSE {_ATTEMPT} END AS INTEGER) AS attempt FROM l""")
def sample_kinds(spark, d):
    enough = F.coalesce(F.col("num_frames") >= 3, F.lit(False))
    can = {"preference": enough, "progress": enough, "similarity": F.col("optimal").isNotNull()}
    k = samples.sample_kinds(samples.partners(_samples(spark, d), SEED), SEED, {"preference": 0.5, "progress": 0.3, "similarity": 0.2}, can, ONLY)
    return k.select("id", F.col("kind.name").alias("kind"), F.col("kind.attempt").alias("attempt"))


@query(f"""WITH {SAMP}, t AS (SELECT *, num_frames AS n, list_transform(range(least(num_frames, 4)), lambda k: CASE WHEN num_frames <= 4 THEN k ELSE CAST(round_even(k * ((num_frames - 1) / 3), 0) AS BIGINT) END) AS own FROM samp WHERE num_frames IS NOT NULL),
 f AS (SELECT *, list_concat(own, list_transform(range(4 - len(own)), lambda k: own[-1])) AS i,
  list_transform(own, lambda k: CASE WHEN partial_success <> 1 THEN CASE WHEN k = n - 1 THEN partial_success ELSE 0 END ELSE least(1.0, k / greatest(1, floor(0.9::DOUBLE * n) - 1)) END) AS p FROM t),
 g AS (SELECT *, list_concat(p, list_transform(range(4 - len(p)), lambda k: p[-1])) AS target FROM f)
 SELECT id, array_to_string(i, ',') AS indices, round(list_sum(target), 6) AS progress, CAST(list_sum(list_transform(target, lambda x: CASE WHEN rank = 3 AND x >= 0.9 THEN 1 ELSE 0 END)) AS BIGINT) AS n_success,
 CAST(CASE WHEN partial_success IS NULL OR (partial_success = 1 AND data_source <> 'AUTOMOBILE') THEN 4 ELSE len(list_filter(own, lambda k: k = n - 1)) END AS BIGINT) AS n_mask FROM g""")
def trajectory_views(spark, d):
    t = _samples(spark, d).where("num_frames is not null").withColumns({"walk": F.lit("all"), "cutoff": F.lit(0.9)})
    v = samples.trajectory_view(t, 4, SEED, preference_only=ONLY)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return v.select("id", _joined(F.col("indices")).alias("indices"), F.round(total("target_progress"), 6).alias("progress"), total("success_label").cast("bigint").alias("n_success"), total("predict_last_frame_mask").cast("bigint").alias("n_mask"))


_PER_KIND = {"preference": {"rewind": 0.5, "suboptimal": 0.5}, "progress": {"forward_progress": 0.7, "rewind": 0.3}, "similarity": {"suboptimal": 0.5, "paired_human_robot": 0.5}}


def _own(purpose: str) -> str:
    return _u(f"'{SEED}'", f"'{purpose}'", "CAST(draw AS VARCHAR)")


def _again(purpose: str) -> str:
    return _u(f"'{SEED}'", f"'{purpose}'", "CAST(draw AS VARCHAR)", "CAST(attempt AS VARCHAR)")


_CAN = {
    "preference": {"rewind": "num_frames >= 3", "suboptimal": "num_frames >= 3 AND sub_n >= 3"}, "progress": {"forward_progress": "num_frames >= 3", "rewind": "num_frames >= 3"},
    "similarity": {"suboptimal": "(rank = 3 OR partial_success IS NOT NULL) AND optimal_id IS NOT NULL AND suboptimal_id IS NOT NULL", "paired_human_robot": "(rank = 3 OR partial_success IS NOT NULL) AND opposite_id IS NOT NULL AND (robot_id IS NOT NULL OR other_id IS NOT NULL)"},
}
_FITS = "CASE " + " ".join(f"WHEN made = '{k}' AND strategy = '{s}' THEN coalesce({c}, false)" for k, of in _CAN.items() for s, c in of.items()) + " ELSE false END"


@query(f"""WITH {_PARTNERS}, a AS (SELECT draw, CASE WHEN {_own("kind")} < 0.5 THEN 'preference' WHEN {_own("kind")} < 0.8 THEN 'progress' ELSE 'similarity' END AS kind FROM range(1000) t(draw)),
 s AS (SELECT *, CASE kind WHEN 'preference' THEN CASE WHEN {_own("strategy-preference")} < 0.5 THEN 'rewind' ELSE 'suboptimal' END WHEN 'progress' THEN CASE WHEN {_own("strategy-progress")} < 0.7 THEN 'forward_progress' ELSE 'rewind' END
  ELSE CASE WHEN {_own("strategy-similarity")} < 0.5 THEN 'suboptimal' ELSE 'paired_human_robot' END END AS strategy FROM a),
 c AS (SELECT *, CASE WHEN strategy IN ('rewind', 'forward_progress') THEN 'good' WHEN strategy = 'suboptimal' THEN 'mixed' ELSE 'any' END AS class FROM s),
 hv AS (SELECT list_sort(list(DISTINCT data_source)) AS have FROM samp), u AS (SELECT c.*, attempt, CASE strategy WHEN 'suboptimal' THEN list_filter(have, lambda x: x IN ({_names(FAILURES)})) WHEN 'paired_human_robot' THEN list_filter(have, lambda x: x IN ({_names(PAIRED)})) ELSE have END AS suits FROM c, hv, range(1, 11) r(attempt)),
 v AS (SELECT *, suits[CAST(floor({_again("source")} * len(suits)) AS BIGINT) + 1] AS data_source FROM u),
 mixed AS (SELECT task FROM samp GROUP BY 1 HAVING bool_or(rank = 3) AND bool_or(rank < 3)),
 kn AS (SELECT id, data_source, class FROM samp, (VALUES ('good'), ('mixed'), ('any')) k(class) WHERE class = 'any' OR (class = 'good' AND rank = 3) OR (class = 'mixed' AND task IN (SELECT task FROM mixed))),
 pl AS {numbered("kn", "data_source, class", SEED, "row")},
 m AS (SELECT v.*, pl.id FROM v JOIN pl ON pl.data_source = v.data_source AND pl.class = v.class AND pl.place = CAST(floor({_again("place")} * n_rows) AS BIGINT)),
 f AS (SELECT m.draw, m.kind, m.strategy, m.data_source, m.id, m.attempt, CASE WHEN rank < 3 OR m.data_source IN ({_names(ONLY)}) THEN 'preference' ELSE kind END AS made, pn.* EXCLUDE (id, data_source) FROM m JOIN pn ON pn.id = m.id)
 SELECT draw, kind, strategy, made, data_source, id, CAST(attempt AS INTEGER) AS attempt FROM f WHERE {_FITS} QUALIFY row_number() OVER (PARTITION BY draw ORDER BY f.attempt) = 1""")
def strategy_first(spark, d):
    rows = samples.partners(_samples(spark, d), SEED)
    return samples.strategy_first(rows, 1000, {"preference": 0.5, "progress": 0.3, "similarity": 0.2}, _PER_KIND, {"suboptimal": FAILURES, "paired_human_robot": PAIRED}, SEED, ONLY)


@query(f"""WITH {TRAJ}, both_ AS (SELECT task FROM traj GROUP BY 1 HAVING bool_or(rank = 3) AND bool_or(rank < 3)), s AS (SELECT traj.*, CASE WHEN id % 3 = 0 THEN 'rewind' WHEN id % 3 = 1 THEN 'suboptimal' ELSE 'different_task' END AS strategy FROM traj)
 SELECT strategy, count(*) AS n FROM s WHERE CASE strategy WHEN 'rewind' THEN rank = 3 WHEN 'suboptimal' THEN task IN (SELECT task FROM both_) ELSE true END GROUP BY 1""")
def rows_of_strategies(spark, d):
    t = trajectories(spark, d)
    both = t.groupBy("task").agg(F.max((F.col("quality_label") == "successful").cast("int")).alias("good"), F.max((F.col("quality_label") != "successful").cast("int")).alias("bad")).where("good = 1 and bad = 1").select("task", F.lit(True).alias("both"))
    s = t.join(both, "task", "left").withColumn("strategy", F.when(F.col("id") % 3 == 0, "rewind").when(F.col("id") % 3 == 1, "suboptimal").otherwise("different_task"))
    return s.where(samples.suits_strategy(F.col("strategy"), F.lit("preference"), F.coalesce("both", F.lit(False)))).groupBy("strategy").agg(F.count(F.lit(1)).alias("n"))
