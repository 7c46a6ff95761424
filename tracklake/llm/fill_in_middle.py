"""Texts cut in prefix, middle and suffix for fill-in-the-middle training, and put back together.

A text is cut in units (white space with the word behind it, or white space at the end).
Two seeded draws of 0 to n units bound the middle, a third decides whether the text stays
plain, a fourth the order of the parts.  An Arrow-batched pandas UDF collects the ends of
the units in a compact array of offsets, so the cuts are two lookups and three slices.

A null text counts as empty and stays plain, as does a text that holds a mark.  A null key
counts as an empty string of digits.  Whole texts of any length are cut.  Rows are
independent: equal keys draw alike, repeated rows repeat their result, all columns are
passed on (one named like the result is replaced), an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A fixed value: one unit of a text.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def draws(seed: int, key: str) -> list[int]:
    """Four integers of 32 bits from the seed and the key of a row."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def assembled(prefix: str, middle: str, suffix: str, form: str) -> str:
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text that was cut; no part holds a mark, and no mark can begin in a part and end behind it."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    a, _, rest = output[len(first) :].partition(second)
    b, _, middle = rest.partition(MIDDLE)
    return a + middle + b if form == "psm" else b + middle + a


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text", to: str = "fim", seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """Adds the struct ``SCHEMA`` of each row: rate and spm_rate in percent of the texts and of the cut texts.

    n: units of the text; output: the text in its new form; restored_sha256: digest of the
    text that is put together again from output and form.
    """
    # The result is built in a function, so that the compiled pattern is made once in a worker.
    @F.pandas_udf(SCHEMA)
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        import regex

        units = regex.compile(UNIT).finditer
        for keys, texts in batches:
            out = []
            for k, t in zip(keys, texts, strict=True):
                ends = array("Q", [0])
                ends.extend(m.end() for m in units(t))
                n = len(ends) - 1
                h1, h2, h3, h4 = draws(seed, k)
                if not n or h3 % 100 >= rate or PREFIX in t or SUFFIX in t or MIDDLE in t:
                    form, before, middle, output = "plain", None, None, t
                else:
                    form = "spm" if h4 % 100 < spm_rate else "psm"
                    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
                    a, b = ends[a], ends[b]
                    before, middle, output = a, b - a, assembled(t[:a], t[a:b], t[b:], form)
                out.append((n, form, before, middle, output, _sha(output), _sha(restored(output, form))))
            names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
            done = pd.DataFrame(out, columns=names)
            yield done.astype({"prefix_chars": "Int64", "middle_chars": "Int64", "n": "int64"})

    empty = F.lit("")
    return df.withColumn(to, cut(F.coalesce(F.col(key).cast("string"), empty), F.coalesce(F.col(text), empty)))
