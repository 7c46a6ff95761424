"""Samplers as table functions that SQL calls by name over partitions of a table.

    register(spark)
    SELECT * FROM sample_rows(TABLE(t) PARTITION BY (task), 3, 7)

A call reads its partition row by row and holds no more than it returns.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf


class SampleRows:
    """(grp, id, place): k rows of each partition of a table (grp, id), the first by their draws."""

    def __init__(self) -> None:
        self.best: list[tuple[int, int, str, object]] = []
        self.k, self.grp, self.n = 0, None, 0

    def eval(self, row: Row, k: int, seed: int) -> None:
        self.k, self.grp, self.n = k, row["grp"], self.n + 1
        drawn = int(hashlib.md5(f"{seed}|{row['id']}".encode()).hexdigest(), 16)
        entry = (-drawn, self.n, row["id"])  # the greatest draw is at the top
        if len(self.best) < k:
            heapq.heappush(self.best, entry)
        elif k and entry > self.best[0]:
            heapq.heapreplace(self.best, entry)

    def terminate(self) -> Iterator[tuple]:
        for place, (_, _, i) in enumerate(sorted(self.best, reverse=True), 1):
            yield self.grp, i, place


class PairNext:
    """(grp, first_id, second_id): each row of a partition, in the order of its ORDER BY, with the next one of another label."""

    def __init__(self) -> None:
        self.waiting: list[tuple] = []

    def eval(self, row: Row) -> Iterator[tuple]:
        met = [w for w in self.waiting if w[1] != row["label"]]
        # Rows that wait all have one label: the first of another ends the wait of all of them.
        if met:
            self.waiting = []
        for i, _ in met:
            yield row["grp"], i, row["id"]
        self.waiting.append((row["id"], row["label"]))


#: Table functions by the names that SQL knows.
SAMPLERS = {"sample_rows": (SampleRows, "grp string, id bigint, place int"), "pair_next": (PairNext, "grp string, first_id bigint, second_id bigint")}


def register(spark: SparkSession, names: list[str] | None = None) -> None:
    """Makes the samplers callable in SQL; an unknown name is an error."""
    for name in SAMPLERS if names is None else names:
        if name not in SAMPLERS:
            raise ValueError(f"unknown sampler {name}; there are {', '.join(SAMPLERS)}")
        of, schema = SAMPLERS[name]
        spark.udtf.register(name, udtf(of, returnType=schema))
