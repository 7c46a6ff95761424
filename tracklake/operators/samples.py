"""Training samples as joins: partners for every row, strategies that a row can have, walks over its frames.

Every partner is looked up once, which tells what strategies a row can have.  Strategies are
then drawn by weight until one fits; one that has failed a few times is drawn no more.  The
draws depend on the row and the number of the try alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions import frames as fr
from tracklake.functions.draws import ladder, uniform
from tracklake.operators.pairs import numbered, other_task, spot, without_own
from tracklake.sources.shared import stored

PREFERENCE = {"rewind": 1.0, "suboptimal": 1.0, "different_task": 1.0, "reverse_progress": 1.0}
PROGRESS = {"different_task_instruction": 1.0, "forward_progress": 1.0, "reverse_progress": 1.0, "rewind": 1.0}
SIMILARITY = {"rewind": 1.0, "suboptimal": 1.0, "paired_human_robot": 1.0}
#: The walk over the frames of the changed side by strategy.
WALKS = {"rewind": "rewind", "reverse_progress": "reverse"}
#: Rows of fewer frames give no walk.
LEAST_FRAMES = 3


def pick(refs: DataFrame, pool: DataFrame, keys: Sequence[str], seed: int, purpose: str, carry: Sequence[str] = ()) -> DataFrame:
    """(ref_id, pick_id, carried columns): for each ref another row of the pool with its keys, each alike; nulls if there is none.

    The rows of a group have numbers, and a ref takes the one of a number of its own: no
    pairs are formed.  A ref that is in the pool leaves out its own number.
    """
    places = numbered(pool.select("id", *keys, *carry), keys, seed, purpose)
    sizes = places.groupBy(*keys).agg(F.max("n").alias("n"))
    own = places.select(F.col("id"), *keys, F.col("place").alias("own"))
    asked = refs.select("id", *keys).join(own, ["id", *keys], "left").join(sizes, list(keys), "left")
    m = F.col("n") - F.col("own").isNotNull().cast("int")
    asked = asked.withColumn("m", m).withColumn("place", F.when(F.col("m") > 0, spot(seed, purpose) % F.greatest("m", F.lit(1))))
    asked = asked.withColumn("place", F.col("place") + F.coalesce((F.col("place") >= F.col("own")).cast("int"), F.lit(0)))
    found = places.select(*keys, "place", F.col("id").alias("pick_id"), *[F.col(c).alias(f"pick_{c}") for c in carry])
    return asked.select(F.col("id").alias("ref_id"), *keys, "place").join(found, [*keys, "place"], "left").drop(*keys, "place")


def pick_other_partial(df: DataFrame, least: float, seed: int, purpose: str, carry: Sequence[str] = ()) -> DataFrame:
    """(ref_id, pick_id, carried columns): for each row with a partial success another of its task whose value is lower or higher by ``least`` or more, each alike.

    The rows of a task have places along their values.  Those that are low enough come
    first, those that are high enough last; how many they are is looked up for each value
    in one pass along all values and all bounds, so no pairs of values are formed.
    """
    return df.select(F.col("id").alias("ref_id")).join(_other_partial(df, least, seed, purpose, carry), "ref_id", "left")


def _other_partial(df: DataFrame, least: float, seed: int, purpose: str, carry: Sequence[str]) -> DataFrame:
    """The rows of ``pick_other_partial`` that have a pick."""
    rows = df.where(F.col("partial_success").isNotNull()).select("id", "task", F.col("partial_success").alias("ps"), *carry)
    places = numbered(rows, ["task", "ps"], seed, purpose)
    sizes = places.groupBy("task", "ps").agg(F.max("n").alias("n"))
    # Bounds stand behind (low) or before (high) the values that are equal to them.
    kinds = [(F.col("ps"), 1, F.col("n")), (F.col("ps") - least, 2, F.lit(0)), (F.col("ps") + least, 0, F.lit(0))]
    marks = sizes.select("task", "ps", F.explode(F.array(*[F.struct(x.alias("x"), F.lit(k).alias("kind"), n.cast("bigint").alias("k")) for x, k, n in kinds])).alias("m")).select("task", "ps", "m.*")
    w = Window.partitionBy("task")
    marks = marks.withColumn("until", F.sum("k").over(w.orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("k").over(w))
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, c))
    known = marks.groupBy("task", "ps").agg(of(1, F.col("until") - F.col("k")).alias("start"), of(2, F.col("until")).alias("low"), of(0, F.col("until")).alias("high"), F.max("all").alias("all"))
    placed = stored(places.join(known, ["task", "ps"]).withColumn("at", F.col("start") + F.col("place")))
    m = F.col("low") + F.col("all") - F.col("high")
    number = F.col("number")
    asked = placed.withColumn("number", F.when(m > 0, spot(seed, purpose) % F.greatest(m, F.lit(1)))).select(F.col("id").alias("ref_id"), "task", F.when(number < F.col("low"), number).otherwise(F.col("high") + number - F.col("low")).alias("at"))
    found = placed.select("task", "at", F.col("id").alias("pick_id"), *[F.col(c).alias(f"pick_{c}") for c in carry])
    return asked.join(found, ["task", "at"]).drop("task", "at")


#: Rows of a task by (successful, robot): the cells of which partners are drawn.
CELLS = {"optimal": (2, 3), "plain": (0, 1), "robot": (1,)}


def partners(df: DataFrame, seed: int, least: float = 0.2, same_source: float = 0.5) -> DataFrame:
    """Each row with its partners (struct of id, task, num_frames, partial_success; null: none).

    optimal: a successful row of its task; suboptimal: a row of its task that is not, or
    one of another partial success where the row has one; other: a row of another task
    that has successful ones, for ``same_source`` of the rows of a task of their source;
    opposite: a successful row of the other kind, human or robot; robot: a robot's row that
    is not successful.  Rows are numbered once, by task and cell; the four picks of a row
    within its task are numbers of one or two cells, and are looked up together.  The rows
    and what is numbered are stored, since each is read several times.
    """
    df = stored(df)
    carry = ["num_frames", "partial_success"]
    cell = 2 * F.coalesce((F.col("quality_label") == "successful").cast("int"), F.lit(0)) + F.coalesce(F.col("is_robot").cast("int"), F.lit(0))
    rows = df.where("quality_label is not null").select("id", "task", "is_robot", cell.alias("cell"), *carry)
    places = stored(numbered(rows, ["task", "cell"], seed, "cell"))
    sizes = places.groupBy("task").agg(*[F.coalesce(F.max(F.when(F.col("cell") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in range(4)])
    asked = places.select("id", "task", "is_robot", F.col("cell").alias("own_cell"), F.col("place").alias("own")).join(sizes, "task")
    # Columns of their own, so that a row's draws are made once and not in each expression that takes them.
    asked = asked.withColumns({f"spot_{p}": spot(seed, p) for p in (*CELLS, "opposite")})
    places_of, wants = {}, []
    for name, cells in [*CELLS.items(), ("human", (2,)), ("machine", (3,))]:
        purpose = "opposite" if name in ("human", "machine") else name
        first, both = F.col(f"n{cells[0]}"), sum(F.col(f"n{c}") for c in cells)
        own = F.when(F.col("own_cell") == cells[0], F.col("own"))
        if len(cells) == 2:
            own = own.when(F.col("own_cell") == cells[1], first + F.col("own"))
        places_of[f"at_{name}"] = without_own(F.col(f"spot_{purpose}"), both, own)
        if name in ("human", "machine"):  # the kind that the row is not
            places_of[f"at_{name}"] = F.when(F.col("is_robot") == (name == "human"), places_of[f"at_{name}"])
        at = F.col(f"at_{name}")
        wants.append(F.struct(F.lit(purpose).alias("name"), F.when(at < first, cells[0]).otherwise(cells[-1]).alias("cell"), F.when(at < first, at).otherwise(at - first).alias("place")))
    wanted = asked.withColumns(places_of).select(F.col("id").alias("ref_id"), "task", F.explode(F.array(*wants)).alias("w")).select("ref_id", "task", "w.*").where("place is not null")
    found = wanted.join(places.select("task", "cell", "place", F.struct("id", *carry).alias("got")), ["task", "cell", "place"])
    picks = found.groupBy(F.col("ref_id").alias("id")).agg(*[F.max(F.when(F.col("name") == n, F.col("got"))).alias(n) for n in ("optimal", "plain", "robot", "opposite")])

    def named(picks: DataFrame, name: str) -> DataFrame:
        return picks.select(F.col("ref_id").alias("id"), F.when(F.col("pick_id").isNotNull(), F.struct(F.col("pick_id").alias("id"), *[F.col(f"pick_{c}").alias(c) for c in carry])).alias(name))

    partial = named(_other_partial(df, least, seed, "partial", carry), "partial")
    drawn = other_task(df, df.where("quality_label = 'successful'"), seed, "other", same_source, df, carry)
    got = F.when(F.col("pick_id").isNotNull(), F.struct(F.col("pick_id").alias("id"), *[F.col(f"pick_{c}").alias(c) for c in carry]))
    other = drawn.select(F.col("ref_id").alias("id"), got.alias("other"), F.col("task").alias("other_task"))
    out = df
    for part in (picks, partial, other):
        out = out.join(part, "id", "left")
    return out.withColumn("suboptimal", F.when(F.col("partial_success").isNotNull(), F.col("partial")).otherwise(F.col("plain"))).drop("plain", "partial")


#: Tries in all, and failures after which a strategy is drawn no more.
MOST_TRIES, MOST_FAILURES, MOST_SIMILARITY_FAILURES = 10, 3, 4


def tried(weights: dict[str, float], can: dict[str, Column], seed: int, purpose: str, has: dict[str, Column] | None = None, failures: int = MOST_FAILURES, tries: int = MOST_TRIES) -> Column:
    """(name, attempt): the first strategy that succeeds, drawn by weight again and again; null if none does.

    A strategy that has failed ``failures`` times is drawn no more, and the others share its
    weight; after ``tries`` draws, or with no strategy left, there is none.  can: whether a
    row's strategy succeeds; has: whether the row's draws know the strategy at all.  A fold
    over the draws carries the failures of each strategy.
    """
    names = [n for n, w in weights.items() if w > 0]
    known = [F.coalesce((has or {}).get(n, F.lit(True)), F.lit(False)) for n in names]
    fine = F.array(*[F.coalesce(can[n], F.lit(False)) for n in names])
    start = F.struct(F.lit(None).cast("string").alias("name"), F.lit(0).alias("attempt"), F.array(*[F.when(k, 0).otherwise(failures) for k in known]).alias("failed"))

    def bound(x: Column, f: Callable[[Column], Column]) -> Column:
        """f of a value that is found once, however often f takes it."""
        return F.get(F.transform(F.array(x), f), F.lit(0))

    def once(state: Column, i: Column, fine: Column) -> Column:
        left = [F.when(F.get(state["failed"], F.lit(k)) < failures, float(weights[n])).otherwise(0.0) for k, n in enumerate(names)]
        total = sum(left, F.lit(0.0))

        def spotted(u: Column) -> Column:
            below, branches = F.lit(0.0), []
            for k in range(len(names)):
                below = below + left[k]
                branches.append(F.when((left[k] > 0) & (u < below), k))
            # Rounding may leave u above all sums: the last one that is left.
            return F.coalesce(*branches, *[F.when(left[k] > 0, k) for k in reversed(range(len(names)))], F.lit(None).cast("int"))

        def drawn(at: Column) -> Column:
            hit = F.get(fine, at)
            failed = F.transform(state["failed"], lambda f, k: F.when((k == at) & ~hit, f + 1).otherwise(f))
            new = F.struct(F.when(hit, F.get(F.array(*map(F.lit, names)), at)).alias("name"), (state["attempt"] + 1).alias("attempt"), failed.alias("failed"))
            return F.when(at.isNull(), state).otherwise(new)

        return F.when(state["name"].isNotNull(), state).otherwise(bound(uniform(seed, purpose, "id", i) * total, lambda u: bound(spotted(u), drawn)))

    end = bound(fine, lambda fine: F.aggregate(F.sequence(F.lit(1), F.lit(tries)), start, lambda state, i: once(state, i, fine)))
    return bound(end, lambda e: F.when(e["name"].isNotNull(), F.struct(e["name"].alias("name"), e["attempt"].alias("attempt"))))


def first_free(weights: dict[str, float], free: dict[str, Column], seed: int, purpose: str) -> Column:
    """(name, attempt): the first option in the order of weighted draws that is free, and its place in that order; null if none is."""
    ranked = F.array_sort(F.array(*[F.struct((-F.pow(uniform(seed, f"{purpose}-{n}", "id") + 1e-12, 1 / w)).alias("r"), F.lit(n).alias("name"), F.coalesce(free[n], F.lit(False)).alias("free")) for n, w in weights.items() if w > 0]))
    tried = F.filter(F.transform(ranked, lambda x, i: F.struct(x["name"].alias("name"), (i + 1).alias("attempt"), x["free"].alias("free"))), lambda x: x["free"])
    first = F.try_element_at(tried, F.lit(1))
    return F.when(F.size(tried) > 0, F.struct(first["name"].alias("name"), first["attempt"].alias("attempt")))


def _enough(side: str | None = None) -> Column:
    return (F.col("num_frames") if side is None else F.col(f"{side}.num_frames")) >= LEAST_FRAMES


def preference_can() -> dict[str, Column]:
    return {"rewind": _enough(), "reverse_progress": _enough(), "suboptimal": _enough() & _enough("suboptimal"), "different_task": _enough() & _enough("other")}


def progress_can() -> dict[str, Column]:
    return {"different_task_instruction": _enough() & F.col("other_task").isNotNull(), "forward_progress": _enough(), "reverse_progress": _enough(), "rewind": _enough()}


def similarity_can() -> dict[str, Column]:
    """Of rows with a reference's right; the sources that know a strategy are not asked here."""
    return {
        "rewind": F.col("optimal").isNotNull() & _enough(),
        "suboptimal": F.col("optimal").isNotNull() & F.col("suboptimal").isNotNull(),
        "paired_human_robot": F.col("opposite").isNotNull() & (F.col("robot").isNotNull() | F.col("other").isNotNull()),
    }


def preference_samples(rows: DataFrame, seed: int, weights: dict[str, float] = PREFERENCE) -> DataFrame:
    """(id, chosen_id, rejected_id, strategy, chosen_walk, rejected_walk, attempt) of rows with partners; nulls where nothing fits.

    A row that is not successful and has no partial success is the rejected one of a
    successful row of its task, with all frames of both; if there is none it is treated as
    the others.  Those are chosen, and the strategy makes or finds the rejected one; of two
    partial successes the greater one is chosen.
    """
    whole = (F.col("quality_label") != "successful") & F.col("partial_success").isNull() & F.col("optimal").isNotNull()
    s = rows.withColumn("s", F.when(whole, F.struct(F.lit("suboptimal").alias("name"), F.lit(1).alias("attempt"))).otherwise(tried(weights, preference_can(), seed, "preference")))
    name = F.col("s.name")
    rejected = F.when(whole, F.col("id")).when(name == "suboptimal", F.col("suboptimal.id")).when(name == "different_task", F.col("other.id")).when(name.isNotNull(), F.col("id"))
    chosen = F.when(whole, F.col("optimal.id")).when(name.isNotNull(), F.col("id"))
    swap = F.coalesce(~whole & (name == "suboptimal") & (F.col("suboptimal.partial_success") > F.col("partial_success")), F.lit(False))
    walk = F.lit("forward")
    for n, w in WALKS.items():
        walk = F.when(name == n, w).otherwise(walk)
    return s.select(
        "id", F.when(swap, rejected).otherwise(chosen).alias("chosen_id"), F.when(swap, chosen).otherwise(rejected).alias("rejected_id"), name.alias("strategy"),
        F.when(name.isNotNull(), F.when(whole, "all").otherwise("forward")).alias("chosen_walk"), F.when(name.isNotNull(), F.when(whole, "all").otherwise(walk)).alias("rejected_walk"), F.col("s.attempt").alias("attempt"),
    )


def progress_samples(rows: DataFrame, seed: int, weights: dict[str, float] = PROGRESS) -> DataFrame:
    """(id, task, instruction, strategy, walk, is_other, attempt); is_other: the instruction is another task's, so all its targets are 0."""
    s = rows.withColumn("s", tried(weights, progress_can(), seed, "progress"))
    name = F.col("s.name")
    walk = F.when(name == "reverse_progress", "reverse").when(name == "rewind", "rewind").when(name.isNotNull(), "forward")
    other = name == "different_task_instruction"
    return s.select("id", "task", F.when(other, F.col("other_task")).when(name.isNotNull(), F.col("task")).alias("instruction"), name.alias("strategy"), walk.alias("walk"), other.alias("is_other"), F.col("s.attempt").alias("attempt"))


def similarity_samples(rows: DataFrame, seed: int, failures: Sequence[str], paired: Sequence[str], weights: dict[str, float] = SIMILARITY) -> DataFrame:
    """(id, sim_id, diff_id, strategy, diff_walk, is_other, attempt) of rows that are successful or have a partial success.

    suboptimal only in sources that have failures, paired ones only in paired sources, both
    with twice their weight; the paired one takes a robot's failure or another task's row,
    by a coin or whichever there is.
    """
    source = F.col("data_source")
    coin = uniform(seed, "diff", "id") < 0.5
    diff = F.when(F.col("robot").isNull() | (~coin & F.col("other").isNotNull()), F.col("other.id")).otherwise(F.col("robot.id"))
    fit = F.col("partial_success").isNotNull() | (F.col("quality_label") == "successful")
    has = {"rewind": F.lit(True), "suboptimal": source.isin(*failures), "paired_human_robot": source.isin(*paired)}
    boosted = {n: w if n == "rewind" else 2 * w for n, w in weights.items()}
    s = rows.where(fit).withColumn("s", tried(boosted, similarity_can(), seed, "similarity", has, MOST_SIMILARITY_FAILURES))
    name = F.col("s.name")
    return s.select(
        "id", F.when(name == "paired_human_robot", F.col("opposite.id")).when(name.isNotNull(), F.col("optimal.id")).alias("sim_id"),
        F.when(name == "rewind", F.col("id")).when(name == "suboptimal", F.col("suboptimal.id")).when(name.isNotNull(), diff).alias("diff_id"),
        name.alias("strategy"), F.when(name.isNotNull(), F.when(name == "rewind", "rewind").otherwise("all")).alias("diff_walk"),
        F.coalesce((name == "paired_human_robot") & (diff == F.col("other.id")), F.lit(False)).alias("is_other"), F.col("s.attempt").alias("attempt"),
    )


def sample_kinds(rows: DataFrame, seed: int, ratios: dict[str, float], can: dict[str, Column], preference_only: Sequence[str] = ()) -> DataFrame:
    """Adds kind (struct of name and attempt): preference for rows that are not successful and for preference-only sources, else the first kind that the row can have; progress as the last resort."""
    forced = (F.col("quality_label") != "successful") | (F.col("data_source").isin(*preference_only) & can["preference"] if preference_only else F.lit(False))
    drawn = F.coalesce(first_free(ratios, can, seed, "kind"), F.when(can["progress"], F.struct(F.lit("progress").alias("name"), F.lit(len(ratios)).alias("attempt"))))
    return rows.withColumn("kind", F.when(forced, F.when(can["preference"], F.struct(F.lit("preference").alias("name"), F.lit(1).alias("attempt")))).otherwise(drawn))


def trajectory_view(df: DataFrame, max_frames: int, seed: int, walk: str = "walk", default_cutoff: float = 1.0, preference_only: Sequence[str] = (), bins: int | None = None) -> DataFrame:
    """Adds indices, target_progress, success_label and predict_last_frame_mask of each row's walk over num_frames frames.

    Frames along the walk, progress from its first frame, at most ``max_frames`` of them
    evenly spaced, padded with the last one; labels by the cutoff (column ``cutoff``, if
    there is one) and the quality label.  A walk without enough frames gives nulls.
    """
    n, key = F.col("num_frames"), F.col("id").cast("string")
    cutoff = F.coalesce(F.col("cutoff"), F.lit(default_cutoff)) if "cutoff" in df.columns else F.lit(default_cutoff)

    def along(direction: str) -> Column:
        e = fr.subsample_ends(direction, n, max_frames, key)
        middle = e["middle"] if direction == "rewind" else F.lit(None).cast("int")
        return F.when(e.isNotNull(), fr.segment_indices(n, e["start"], e["end"], middle, max_frames))

    w = F.col(walk)
    path = F.when(w == "all", fr.all_indices(n)).when(w == "forward", along("forward")).when(w == "reverse", along("reverse")).when(w == "rewind", along("rewind"))
    df = df.withColumn("__path", path)
    p = F.col("__path")
    progress = fr.partial_success_progress(p, fr.first_frame_progress(p, n, cutoff), n, F.col("partial_success"))
    df = df.withColumn("__progress", progress).withColumn("__keep", F.when(F.size(p) > max_frames, fr.linspace_indices(F.size(p), max_frames)).otherwise(fr.all_indices(F.size(p))))
    keep = F.col("__keep")
    padded = lambda x: F.when(p.isNotNull(), fr.pad(fr.gather(x, keep), max_frames))
    target = padded(F.col("__progress"))
    df = df.withColumn("indices", padded(p)).withColumn("__target", target)
    labels = fr.success_labels(F.col("__target"), F.col("quality_label"), cutoff)
    # Partial success: only the frames of the walk that are the last one, not those that pad it.
    whole = F.col("partial_success") == 1.0
    if preference_only:
        whole &= ~F.coalesce(F.col("data_source").isin(*preference_only), F.lit(False))
    own = F.transform(fr.gather(p, keep), lambda i: F.when(i == n - 1, 1.0).otherwise(0.0))
    size = F.size("indices")
    mask = F.when(F.col("partial_success").isNull() | whole, F.array_repeat(F.lit(1.0), size)).otherwise(fr.pad_zero(own, size))
    shown = F.col("__target") if bins is None else F.transform("__target", lambda x: fr.discrete_bin(x, bins).cast("double"))
    df = df.withColumn("target_progress", shown).withColumn("success_label", labels).withColumn("predict_last_frame_mask", F.when(p.isNotNull(), mask))
    return df.drop("__path", "__progress", "__keep", "__target")


def row_class(strategy: Column, kind: Column) -> Column:
    """What a row must be to be drawn for a strategy: good, mixed (its task has both labels) or any."""
    own = (strategy == "rewind") | ((strategy == "reverse_progress") & kind.isin("preference", "progress")) | ((strategy == "forward_progress") & (kind == "progress"))
    return F.when(own, "good").when((strategy == "suboptimal") & kind.isin("preference", "similarity"), "mixed").otherwise("any")


def strategy_first(rows: DataFrame, n: int, kinds: dict[str, float], strategies: dict[str, dict[str, float]], sources: dict[str, Sequence[str]], seed: int, preference_only: Sequence[str] = (), tries: int = MOST_TRIES) -> DataFrame:
    """(draw, kind, strategy, made, data_source, id, attempt): n draws of a kind and a strategy of it, then up to ``tries`` draws of a source and a row of it until one can have the strategy.

    rows: with partners.  ``sources`` names those that suit a strategy; other strategies,
    and those that none of the table's sources suits, take any.  Sources count alike; rows
    are drawn among those that suit the strategy, and none of them is a failed try.  made:
    the kind of the sample, preference for rows that are not successful and for
    preference-only sources.  Draws without a row are left out.  All tries of a draw are
    looked up together; the first that succeeds counts.
    """
    spark, rows = rows.sparkSession, stored(rows)
    asked = spark.range(n).select(F.col("id").alias("draw"), F.col("id"))
    asked = asked.withColumn("kind", ladder(uniform(seed, "kind", "id"), kinds))
    name = F.lit(None).cast("string")
    for kind, ratios in strategies.items():
        name = F.when(F.col("kind") == kind, ladder(uniform(seed, f"strategy-{kind}", "id"), ratios)).otherwise(name)
    asked = asked.withColumn("strategy", name).withColumn("class", row_class(F.col("strategy"), F.col("kind")))
    good = F.col("quality_label") == "successful"
    both = rows.groupBy("task").agg((F.max(good.cast("int")) + F.max((~good).cast("int"))).alias("k")).where("k = 2").select("task", F.lit(True).alias("both"))
    exempt = F.coalesce(F.lower("data_source").rlike("roboarena|roboreward"), F.lit(False))
    classes = F.filter(F.array(F.when(good, "good"), F.when(exempt | F.col("both"), "mixed"), F.lit("any")), lambda x: x.isNotNull())
    known = rows.join(both, "task", "left").select("data_source", "id", F.explode(classes).alias("class"))
    places = numbered(known, ["data_source", "class"], seed, "row")
    sizes = F.broadcast(places.groupBy("data_source", "class").agg(F.max("n").alias("n")))  # three rows a source
    have = rows.agg(F.array_sort(F.collect_set("data_source")).alias("have"))  # a short list of names
    suits = F.col("have")
    for strategy, names in sources.items():
        some = F.filter("have", lambda x: x.isin(*names))  # noqa: B023
        suits = F.when((F.col("strategy") == strategy) & (F.size(some) > 0), some).otherwise(suits)
    each = asked.crossJoin(F.broadcast(have)).withColumn("suits", suits).withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(tries))))
    at = F.floor(uniform(seed, "source", "id", "attempt") * F.size("suits")).cast("int")
    each = each.withColumn("data_source", F.get("suits", at)).join(sizes, ["data_source", "class"])
    each = each.withColumn("place", F.floor(uniform(seed, "place", "id", "attempt") * F.col("n")).cast("bigint")).drop("id", "n", "have", "suits")
    drawn = each.join(places.select("data_source", "class", "place", "id"), ["data_source", "class", "place"])
    can = {"preference": preference_can(), "progress": progress_can(), "similarity": similarity_can()}
    able = rows.select("id", good.alias("good"), (F.col("quality_label") == "successful").alias("reference"), F.col("partial_success").isNotNull().alias("partial"), *[F.coalesce(c, F.lit(False)).alias(f"{k}-{s}") for k, of in can.items() for s, c in of.items()])
    met = drawn.join(able, "id")
    made = F.when(~F.coalesce("good", F.lit(False)) | F.col("data_source").isin(*preference_only), "preference").otherwise(F.col("kind"))
    fits = F.lit(False)
    for k, of in can.items():
        for s in of:
            right = F.col(f"{k}-{s}") & (F.col("reference") | F.col("partial") if k == "similarity" else F.lit(True))
            fits = F.when((F.col("made") == k) & (F.col("strategy") == s), right).otherwise(fits)
    best = met.withColumn("made", made).where(fits).groupBy("draw").agg(F.min(F.struct("attempt", "kind", "strategy", "made", "data_source", "id")).alias("b"))
    return best.select("draw", "b.kind", "b.strategy", "b.made", "b.data_source", "b.id", "b.attempt")


def suits_strategy(strategy: Column, kind: Column, tasks_with_both: Column) -> Column:
    """Whether a row can be drawn for a strategy: successful rows for walks of their own, tasks with both labels for suboptimal partners, save sources with partial success."""
    good = F.col("quality_label") == "successful"
    exempt = F.coalesce(F.lower("data_source").rlike("roboarena|roboreward"), F.lit(False))
    asked = row_class(strategy, kind)
    return F.when(asked == "good", good).when((asked == "mixed") & ~exempt, tasks_with_both).otherwise(F.lit(True))
