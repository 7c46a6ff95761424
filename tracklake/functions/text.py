"""Text, path and reply expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def answer(text: Column) -> Column:
    """The list or number after ANSWER:, or null."""
    return _found(text, r"(?i)ANSWER:\s*(\[[^\]]*\]|-?\d+(?:\.\d+)?)")


def score_1_to_5(text: Column) -> Column:
    """The number after the first ANSWER: if it is 1 to 5, else the last digit of 1 to 5 that stands alone, else null."""
    own = _found(text, r"(?i)ANSWER:\s*(\d+)").try_cast("int")
    alone = F.regexp_extract_all(text, F.lit(r"\b([1-5])\b"), F.lit(1))
    return F.coalesce(F.when(own.between(1, 5), own), F.try_element_at(alone, F.lit(-1)).cast("int"))


def json_block(text: Column) -> Column:
    """The body of the first fenced block, else the first and shortest array of objects, without outer space; else empty."""
    body = F.coalesce(_found(text, r"```(?:json)?\s*([\s\S]*?)\s*```"), _found(text, r"(\[\s*\{[\s\S]*?\}\s*\])"), F.lit(""))
    return F.regexp_replace(body, r"^\s+|\s+$", "")


def reply_items(text: Column) -> Column:
    """The list of {frame_number, task_completion_percentage} in a reply; null if there is none or it cannot be read."""
    read = lambda b: F.when(b.startswith("["), F.from_json(b, "array<struct<frame_number: int, task_completion_percentage: double>>", {"mode": "PERMISSIVE"}))
    # An array of one block, so that it is looked for once.
    return F.get(F.transform(F.array(json_block(text)), read), F.lit(0))


def reply_completion(text: Column, permutation: Column) -> Column:
    """Completion from 0 to 1 in the order of the frames, of a reply on frames shown in the order of the permutation.

    The last item for a shown place counts; places without one are left out.  A reply that
    cannot be read gives an empty list.
    """
    empty = F.array().cast("array<struct<frame_number: int, task_completion_percentage: double>>")

    def placed(items: Column) -> Column:
        said = lambda j: F.try_element_at(F.filter(items, lambda x: x["frame_number"] == j), F.lit(-1))["task_completion_percentage"]
        return F.transform(permutation, lambda i, j: F.struct(i.alias("i"), (said(j) / 100).alias("v")))

    # An array of one list, so that the reply is parsed once.
    rows = F.get(F.transform(F.array(F.coalesce(reply_items(text), empty)), placed), F.lit(0))
    return F.transform(F.array_sort(F.filter(rows, lambda x: x["v"].isNotNull())), lambda x: x["v"])


def number_list(text: Column) -> Column:
    """A list of numbers; [0.0] if it cannot be read."""
    return F.coalesce(F.from_json(text, "array<double>"), F.array(F.lit(0.0)))


def reply_decision(text: Column) -> Column:
    """label, confidence and reasoning of a reply.

    Lines that begin with decision: or confidence: count in any case, the last one of each
    that can be read; reasoning: only in lower case, else the whole reply is the reasoning.
    Success is looked for before failure.  Without a decision the words of the reply
    decide with confidence 0.6, if they do; else the label is unknown.
    """
    start = F.struct(F.lit("unknown").alias("label"), F.lit(0.5).alias("confidence"), text.alias("reasoning"))

    def read(state: Column, line: Column) -> Column:
        low = F.lower(F.trim(line))
        decision, said = F.when(low.startswith("decision:"), F.substring(low, 10, 1 << 30)), F.when(low.startswith("confidence:"), F.regexp_replace(low, "[^0-9.]", ""))
        number = said.try_cast("double")
        why = F.when(low.startswith("reasoning:") & line.contains("reasoning:"), F.trim(F.regexp_replace(line, r"^.*?reasoning:", "")))
        return F.struct(
            F.when(decision.contains("success"), "successful").when(decision.contains("fail"), "failure").otherwise(state["label"]).alias("label"),
            F.when(number > 1, number / 100).when(number.isNotNull(), number).when(F.length(said) > 0, F.lit(0.5)).otherwise(state["confidence"]).alias("confidence"),
            F.coalesce(why, state["reasoning"]).alias("reasoning"),
        )

    lines = F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n")

    def finish(state: Column) -> Column:
        low, none = F.lower(text), state["label"] == "unknown"
        guess = F.when(low.contains("success") & ~low.contains("fail"), "successful").when(low.contains("fail"), "failure")
        return F.struct(
            F.when(none, F.coalesce(guess, state["label"])).otherwise(state["label"]).alias("label"),
            F.when(none & guess.isNotNull(), F.lit(0.6)).otherwise(state["confidence"]).alias("confidence"),
            state["reasoning"].alias("reasoning"),
        )

    return F.aggregate(lines, start, read, finish)


def capital_first(text: Column) -> Column:
    """The first letter in upper case, the rest as it is."""
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substring(text, 2, 1 << 30))


def capitalize(text: Column) -> Column:
    """The first letter in upper case, the rest in lower case."""
    return capital_first(F.lower(text))


def task_from_video_name(name: Column) -> Column:
    """The part before a comma, else the name without its success, fail and failure words; underscores become spaces, the first letter upper case.

    Nothing left: Complete the task.
    """
    stem = F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(?<=.)\.[^.]+$", "")
    words = F.filter(F.split(stem, "_"), lambda w: ~F.lower(w).isin("success", "fail", "failure"))
    task = F.when(stem.contains(","), F.split_part(stem, F.lit(","), F.lit(1))).otherwise(F.array_join(words, "_"))
    return F.when(task == "", "Complete the task").otherwise(capital_first(F.replace(task, F.lit("_"), F.lit(" "))))


def folder_parts(name: Column) -> Column:
    """{task}_{quality}_{attempt}: null if there are fewer than three parts."""
    parts = F.split(name, "_")
    n = F.size(parts)
    return F.when(
        n >= 3,
        F.struct(F.array_join(F.slice(parts, 1, F.greatest(n - 2, F.lit(1))), "_").alias("task"), F.try_element_at(parts, F.lit(-2)).alias("quality"), F.try_element_at(parts, F.lit(-1)).alias("attempt")),
    )


def quality_from_directory(name: Column) -> Column:
    """suboptimal, failure or else successful by what the name holds, in that order."""
    return F.when(name.contains("suboptimal"), "suboptimal").when(name.contains("failure"), "failure").otherwise("successful")


def quality_from_stem(name: Column) -> Column:
    """Ordered rules of clip names; an unknown name is an error."""
    low = F.lower(name)
    return F.when(low.contains("close_succ") | low.contains("closs_succ"), "suboptimal").when(low.contains("fail"), "failure").when(low.contains("succ"), "successful").otherwise(F.raise_error(F.concat(F.lit("no quality in "), name)))


def prettify(name: Column) -> Column:
    return capitalize(F.replace(name, F.lit("_"), F.lit(" ")))


def episode_and_camera(key: Column) -> Column:
    """episode/videos/camera; a null camera for fewer than three parts."""
    parts = F.split(key, "/")
    return F.struct(F.try_element_at(parts, F.lit(1)).alias("episode"), F.when(F.size(parts) >= 3, F.try_element_at(parts, F.lit(3))).alias("camera"))


def third_at_part(text: Column) -> Column:
    """a@b@c: c; with fewer parts the whole text; without outer space."""
    return F.regexp_replace(F.when(F.size(F.split(text, "@")) >= 3, F.split_part(text, F.lit("@"), F.lit(3))).otherwise(text), r"^\s+|\s+$", "")


def stable_shard(key: Column, per: int = 1000) -> Column:
    """shard_%04d of a whole number's thousands; other keys by a stable hash."""
    number = key.try_cast("bigint")
    return F.format_string("shard_%04d", F.coalesce(F.floor(number / per), F.pmod(F.xxhash64(key), F.lit(10_000))).cast("bigint"))


def batch_folder(index: Column, per: int = 1000) -> Column:
    return F.format_string("batch_%04d", F.floor(index / per).cast("bigint"))


def cache_key(name: Column) -> Column:
    """A path key: slashes and colons become underscores."""
    return F.translate(name, "/:", "__")


def short_name(name: Column, limit: int = 60) -> Column:
    """Single underscores for what a file name must not hold; a long name is cut and gets eight digits of its md5."""
    plain = F.btrim(F.regexp_replace(F.regexp_replace(name, r'[/\\:*?"<>| ,]', "_"), "_+", "_"), F.lit("_"))
    head = F.rtrim(F.left(plain, F.lit(limit - 9)), F.lit("_"))
    return F.when(F.length(plain) <= limit, plain).otherwise(F.concat(head, F.lit("_"), F.left(F.md5(name), F.lit(8))))


def short_names(names: Column, mapping: dict[str, str] | None = None, limit: int = 60) -> Column:
    """One name for a list of names: those of the mapping by their short forms, joined, cut and hashed like one."""
    table = F.create_map(*[F.lit(x) for kv in (mapping or {"": ""}).items() for x in kv])
    one = lambda x: F.coalesce(F.try_element_at(table, x), F.try_element_at(table, F.translate(x, "-/", "__")), short_name(x, 1 << 30))
    plain = F.btrim(F.regexp_replace(F.array_join(F.transform(names, one), "_"), "_+", "_"), F.lit("_"))
    head = F.rtrim(F.left(plain, F.lit(limit - 9)), F.lit("_"))
    return F.when(F.length(plain) <= limit, plain).otherwise(F.concat(head, F.lit("_"), F.left(F.md5(F.array_join(names, "_")), F.lit(8))))


def last_two_parts(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.regexp_replace(F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "_"), "[^A-Za-z0-9_.-]+", "_")


def model_and_revision(text: Column) -> Column:
    """name@revision."""
    return F.struct(F.split_part(text, F.lit("@"), F.lit(1)).alias("model"), F.when(text.contains("@"), F.split_part(text, F.lit("@"), F.lit(2))).alias("revision"))


def frame_number(name: Column) -> Column:
    """The number before the extension, else the first number, else 0."""
    return F.coalesce(_found(name, r"(\d+)\.[A-Za-z]+$").try_cast("bigint"), _found(name, r"(\d+)").try_cast("bigint"), F.lit(0).cast("bigint"))


def sort_by_number(names: Column) -> Column:
    return F.transform(F.array_sort(F.transform(names, lambda x: F.struct(frame_number(x).alias("n"), x.alias("x")))), lambda s: s["x"])
