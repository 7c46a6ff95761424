"""Quality rules: a threshold table compiled into one projection, without user functions.

Words are runs of characters other than space, tab, line feed, vertical tab, form feed
and carriage return.  A null text counts as empty; an empty text has no words and fails
the base rules.  Repeated rows are judged one by one; a text of any length is read whole;
an empty table gives an empty one.  Extra columns are passed on; those of the names of the
measures and verdicts are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.llm.components import unused

#: White space other than the space, and symbols; fixed by the definition of the measures.
OTHER_SPACE = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Function words of the four languages, fixed values.
STOP_WORDS = (
    "the of and to in is that it for on with as are was this be by from or an a at not"
    " der die das und in zu den von mit ist des im für auf dem nicht ein eine als auch an er sich"
    " le la les de des et un une du en est que qui dans pour par sur au pas avec il elle ce"
    " el los las y del se un una por con para no su al lo es que en o"
).split()


@dataclass(frozen=True)
class Rule:
    """The text fails if ``measure`` / ``per`` is below ``least`` or above ``most``."""

    name: str
    measure: str
    per: str
    least: float | None = None
    most: float | None = None


#: The threshold table: applies to texts that pass the base rules.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 20.0),
    Rule("symbols_per_word", "n_symbols", "n_words", most=0.5),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=0.3),
    Rule("stop_words", "n_stop_words", "n_words", least=0.02),
)


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and n_stop_words."""
    c = {k: unused(df, f"q_{k}") for k in ("text", "words", "lines", "grams", "order", "same", "at")}
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = df.withColumn(c["text"], body)
    body = F.col(c["text"])
    spaced = F.translate(body, OTHER_SPACE, " " * len(OTHER_SPACE))
    bare = lambda x: F.translate(x, " " + OTHER_SPACE, "")
    df = df.withColumns(
        {
            c["words"]: F.array_remove(F.split(spaced, " "), ""),
            c["lines"]: F.filter(F.split(body, "\n"), lambda x: F.length(bare(x)) > 0),
            "word_chars": F.length(bare(body)).cast("long"),
            "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
        }
    )
    words, lines = F.col(c["words"]), F.col(c["lines"])
    n = F.size(words)
    # Hashes of the five-word windows, from one hash a word.
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    df = df.withColumn(c["grams"], hashes)
    h = F.col(c["grams"])
    zipped = F.arrays_zip(*[F.slice(h, k + 1, F.greatest(n - (WINDOW - 1), F.lit(0))).alias(str(k)) for k in range(WINDOW)])
    df = df.withColumns(
        {
            c["order"]: F.transform(zipped, lambda z: F.xxhash64(*[z[str(k)] for k in range(WINDOW)])),
            "n_words": n.cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long"),
        }
    )
    # Window hashes with their positions, in the order of the hashes: equal ones are neighbours.
    grams = F.col(c["order"])
    repeated = F.size(F.array_distinct(grams)) < F.size(grams)
    pairs = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    df = df.withColumn(c["same"], F.when(repeated, pairs))
    s = F.col(c["same"])
    following = F.slice(s, 2, F.greatest(F.size(s), F.lit(1)))
    equal = F.zip_with(s, following, lambda a, b: F.coalesce(a["g"] == b["g"], F.lit(False)))
    df = df.withColumn(c["at"], equal)
    e = F.col(c["at"])
    # arrays_zip makes one array of both flags and positions; a window counts if it equals either neighbour.
    shifted = F.concat(F.array(F.lit(False)), e)
    flagged = F.zip_with(F.arrays_zip(s.alias("s"), e.alias("e")), F.slice(shifted, 1, F.greatest(F.size(s), F.lit(1))), lambda a, b: F.when(a["e"] | b, a["s"]["i"]))
    df = df.withColumn(c["grams"], F.array_sort(F.filter(flagged, lambda x: x.isNotNull())))
    d = F.col(c["grams"])
    gaps = F.zip_with(d, F.slice(d, 2, F.greatest(F.size(d), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop(*c.values())


def compile_rules(rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """One boolean column for each row of the threshold table; true: the text fails it."""
    out = {}
    for r in rules:
        ratio = F.col(r.measure) / F.greatest(F.col(r.per), F.lit(1))
        tests = [t for t in (None if r.least is None else ratio < r.least, None if r.most is None else ratio > r.most) if t is not None]
        out[f"fails_{r.name}"] = reduce(lambda a, b: a | b, tests)
    return out


def quality_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds the measures, base_failed, one fails_ column a rule, and kept."""
    df = measures(df, text)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    tests = compile_rules(rules)
    failed = reduce(lambda a, b: a | b, tests.values())
    return df.withColumns({"base_failed": base, **tests, "kept": ~(base | failed)})
