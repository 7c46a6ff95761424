"""Conversations as token ids with turn marks and a loss mask, and back.

Each turn's text is encoded by itself, so no token crosses a turn, and reserved ids above
the vocabulary's are spliced around it:

    <s> <<SYS>>text<</SYS>> [INST]text[/INST] [OUT]text</s> [ROLE]name[/ROLE]text[/TURN]

for the roles system, user, assistant and any other one, without the spaces.  The loss
mask is 1 on the tokens of assistant texts: the prefix sums of +1 after each [OUT] and -1
at each </s>.  A mark or a special token of the vocabulary that stands in a text is broken
by ``ESCAPE`` after its first character, and an ``ESCAPE`` in a text is doubled; so the ids
hold no mark but the template's, the formatted text can be cut at its marks, and taking the
first of each ``ESCAPE`` and its follower away gives the text back.

A conversation is all rows of one id (null is an id of its own) by turn, null turns first,
equal turns by role and text; repeated rows are turns of their own.  Null texts and roles
count as empty.  Whole texts of any length are encoded.  Other columns are not passed on,
since a result row stands for many rows; an empty table gives no rows.  One conversation is
one training example and one row, so its turns meet in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.llm import bpe

ESCAPE = "␛"
#: The marks in the order of their ids, which follow those of the vocabulary.
MARKS = ("<s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[OUT]", "</s>", "[ROLE]", "[/ROLE]", "[/TURN]")
#: The marks before and after a text of a role that has its own.
TEMPLATE = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>")}
#: Characters of texts that are encoded at a time.
PART = 1 << 22

FORMATTED = "ids binary, loss_mask binary, formatted string"
READ = "turns array<struct<role:string,text:string>>, loss_text string"


def control_strings(specials: tuple[str, ...] = ("<|endoftext|>",)) -> list[str]:
    return [*MARKS, *specials]


def escaped(text: Column, specials: tuple[str, ...] = ("<|endoftext|>",)) -> Column:
    """The text with broken control strings; null is empty."""
    first = "".join(sorted({re.escape(c[0]) for c in control_strings(specials)}))
    rest = "|".join(re.escape(c[1:]) for c in control_strings(specials))
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit(ESCAPE), F.lit(2 * ESCAPE))
    return F.regexp_replace(doubled, f"([{first}])(?={rest})", f"$1{ESCAPE}")


def unescaped(text: str) -> str:
    return re.sub(f"{ESCAPE}(.)", r"\1", text, flags=re.S) if ESCAPE in text else text


def _ids(model: bpe.PairIndexBpe) -> dict[str, int]:
    return {m: model.size + k for k, m in enumerate(MARKS)}


def loss_mask(ids: np.ndarray, opens: int, closes: int) -> np.ndarray:
    """1 between each ``opens`` and the next ``closes``, by prefix sums."""
    steps = np.zeros(len(ids) + 1, np.int64)
    steps[1:] += ids == opens
    steps[:-1] -= ids == closes
    return (np.cumsum(steps[:-1]) > 0).astype(np.uint8)


def _assembled(model: bpe.PairIndexBpe, turns: list[list[tuple[str, str]]]) -> list[np.ndarray]:
    """The ids of each conversation of (role, escaped text) pairs."""
    mark = {m: np.array([i], "<u4").tobytes() for m, i in _ids(model).items()}
    flat = [s for conv in turns for role, text in conv for s in ([text] if role in TEMPLATE else [role, text])]
    coded = iter(model.encode(flat))
    out = []
    for conv in turns:
        parts = [mark["<s>"]]
        for role, _ in conv:
            if role in TEMPLATE:
                before, after = TEMPLATE[role]
                parts += [mark[before], next(coded), mark[after]]
            else:
                parts += [mark["[ROLE]"], next(coded), mark["[/ROLE]"], next(coded), mark["[/TURN]"]]
        out.append(np.frombuffer(b"".join(parts), "<u4"))
    return out


def format_chat(conversations: DataFrame, path: str, key: str = "conv_id") -> DataFrame:
    """(key, ids, loss_mask, formatted) of each conversation of rows (key, turn, role, text).

    ids: little-endian unsigned 32-bit integers; loss_mask: a byte for each id; formatted:
    the text of the ids.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    shown = F.when(role.isin(*TEMPLATE), role).otherwise(escaped(role))
    # The order of equal turns is that of role and text as they are.
    turn = F.struct(F.col("turn"), role.alias("r"), F.coalesce(F.col("text"), F.lit("")).alias("x"), shown.alias("role"), escaped(F.col("text")).alias("text"))
    rows = conversations.groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    rows = rows.select("key", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))
    key_type = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.load(path)
        model.store.clear()
        marks = _ids(model)
        table = [*model.bytes_of, *(m.encode() for m in MARKS)]
        for batch in batches:
            at = 0
            while at < len(batch):
                turns, size = [], 0
                while at + len(turns) < len(batch) and size < PART:
                    k = at + len(turns)
                    turns.append(list(zip(batch.column(1)[k].as_py(), batch.column(2)[k].as_py(), strict=True)))
                    size += sum(len(t) for _, t in turns[-1])
                coded = _assembled(model, turns)
                # One mask over all conversations of the part: each closes what it opens.
                mask = loss_mask(np.concatenate(coded), marks["[OUT]"], marks["</s>"])
                cuts = np.cumsum([0, *map(len, coded)]).tolist()
                texts = [b"".join([table[i] for i in ids.tolist()]) for ids in coded]
                new = [pa.array([i.tobytes() for i in coded], pa.binary()), pa.array([mask[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(turns)), *new], ["key", "ids", "loss_mask", "formatted"])
                at += len(turns)
        model.store.clear()

    return rows.mapInArrow(run, f"key {key_type}, {FORMATTED}").withColumnRenamed("key", key)


def parse_ids(model: bpe.PairIndexBpe, ids: np.ndarray) -> list[tuple[str, str]]:
    """The (role, text) pairs of one conversation's ids."""
    names = {model.size + k: m for k, m in enumerate(MARKS)}
    at = np.flatnonzero(ids >= model.size).tolist()
    between = lambda k: unescaped(b"".join([model.bytes_of[i] for i in ids[at[k] + 1 : at[k + 1]].tolist()]).decode("utf-8", "replace"))
    own = {before: role for role, (before, _) in TEMPLATE.items()}
    out, k = [], 1
    while k < len(at):
        mark = names[int(ids[at[k]])]
        if mark in own:
            out.append((own[mark], between(k)))
            k += 2
        else:
            out.append((between(k), between(k + 1)))
            k += 3
    return out


def read_chat(formatted: DataFrame, path: str) -> DataFrame:
    """Adds what is read back from ``ids`` and ``loss_mask``: the turns, and all text under the mask."""
    keep = [c for c in formatted.columns if c not in ("turns", "loss_text")]
    schema = ", ".join([*(f"`{c}` {formatted.schema[c].dataType.simpleString()}" for c in keep), READ])
    source = formatted.select(*keep)
    types = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.load(path)
        for batch in batches:
            ids_at, mask_at = keep.index("ids"), keep.index("loss_mask")
            at = 0
            while at < len(batch):
                turns, losses, size = [], [], 0
                while at + len(turns) < len(batch) and size < PART:
                    k = at + len(turns)
                    ids = np.frombuffer(batch.column(ids_at)[k].as_py(), "<u4")
                    under = ids[np.frombuffer(batch.column(mask_at)[k].as_py(), np.uint8) > 0]
                    turns.append([{"role": r, "text": t} for r, t in parse_ids(model, ids)])
                    losses.append(unescaped(b"".join([model.bytes_of[i] for i in under.tolist()]).decode("utf-8", "replace")))
                    size += len(ids)
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(turns)).columns, pa.array(turns, types), pa.array(losses, pa.string())], [*keep, "turns", "loss_text"])
                at += len(turns)

    return source.mapInArrow(run, schema)
