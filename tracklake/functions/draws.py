"""Draws that depend on a seed, a purpose and a key alone, so that they survive retries and repartitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: int, purpose: str, *key: Column | str) -> Column:
    """A hexadecimal draw, to order by."""
    columns = [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *columns))


def uniform(seed: int, purpose: str, *key: Column | str) -> Column:
    """A number in [0, 1) from the first 32 bits of the draw."""
    return F.conv(F.substring(draw(seed, purpose, *key), 1, 8), 16, 10).cast("double") / float(2**32)


def ladder(u: Column, choices: dict[str, float]) -> Column:
    """The choice whose share of [0, 1) holds u; the last one is open-ended."""
    total = sum(choices.values())
    out, below = None, 0.0
    names = [n for n, w in choices.items() if w > 0]
    for name in names[:-1]:
        below += choices[name] / total
        out = F.when(u < below, name) if out is None else out.when(u < below, name)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])
