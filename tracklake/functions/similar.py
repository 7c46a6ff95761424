"""Likeness of short names by matching blocks, in Arrow batches: no built-in function gives this ratio."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratio(a: str | None, b: str | None) -> float | None:
    return None if a is None or b is None else SequenceMatcher(None, a.lower(), b.lower()).ratio()


def similarity(a: Column, b: Column) -> Column:
    """Twice the matching characters by all characters, without regard to case; null if either is."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_ratio(p, q) for p, q in zip(x, y, strict=True)])

    return ratio(a, b)


def best_match(name: Column, options: Sequence[str], threshold: float = 0.6) -> Column:
    """The option most like the name, the first of equal ones, if its likeness is above the threshold; else null.  ``options`` is a short list."""

    @F.pandas_udf("string")
    def best(x: pd.Series) -> pd.Series:
        known: dict[str, str | None] = {}
        for name in x.dropna().unique():
            ratio, _, option = max(((_ratio(name, o), -k, o) for k, o in enumerate(options)), default=(0.0, 0, None))
            known[name] = option if ratio > threshold else None
        return x.map(lambda v: known.get(v) if v is not None else None)

    return best(name)
