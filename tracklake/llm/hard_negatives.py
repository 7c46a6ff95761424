"""Hard negatives of anchors by a table of distances to pivots.

Integer vectors x with |x| <= M get one more component, sqrt(M^2 - |x|^2), and anchors q a
zero: then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so high inner products are short distances.
The stored table holds each row's distances to ``PIVOTS`` augmented rows, chosen farthest
first from a sample of at most ``SAMPLE`` rows by a hash of their ids.  By the triangle
inequality the distances of an anchor and of a row to the pivots bracket their distance,
hence their score; only rows whose bracket reaches the scores still wanted are scored, by
an exact integer inner product.  The sample decides speed alone.

Two passes over the table: each anchor's best rows of its own label, then for each of these
positives the best rows of another label within the margins.  Anchors go to the tasks in
chunks of at most ``CHUNK_BYTES``, the rows are read again for each chunk and never
shuffled; a task keeps the best few of each anchor, so a frequent label, vector or id is no
task's burden.  The work is anchors times rows, without what the brackets save.

Rows without an id, a label or a vector, or with a null or non-finite component, take no
part, nor do those with a component of 2^24 or more after scaling (their products would not
fit a long).  Short vectors count as filled with zeros.  Ties go to the smaller id.  Rows of
the anchor's own id are not its partners; equal rows count once, as do rows of one id with
the same score.  Extra columns are left out, as a result row stands for three rows; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.llm.components import written

PIVOTS, SAMPLE = 8, 1000
#: Anchors of a chunk are collected and broadcast together: their vectors take at most so much.
CHUNK_BYTES = 1 << 25
#: Anchors that are compared with an Arrow batch of rows at a time.
TILE = 256
LIMIT = 1 << 24
COLUMNS = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def scaled(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(key: str, label: str, vector: str, scale: int = 256) -> Column:
    """Whether a row takes part; a comparison with a null or NaN component is not true."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(F.floor(x.cast("double") * scale)) < LIMIT), F.lit(False)))
    return F.col(key).isNotNull() & F.col(label).isNotNull() & F.coalesce(fine, F.lit(False))


def _norm2(v: Column) -> Column:
    return F.aggregate(v, F.lit(0).cast("long"), lambda s, x: s + x * x)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of int32 components, filled with zeros to ``dim``."""
    out = np.zeros((len(column), dim), np.int64)
    for k, raw in enumerate(column):
        v = np.frombuffer(raw.as_py(), "<i4")
        out[k, : len(v)] = v
    return out


def _augmented(v: np.ndarray, top: int) -> np.ndarray:
    """The rows with the component that lifts them to length sqrt(top)."""
    rest = np.maximum(top - (v * v).sum(1), 0)
    return np.hstack([v, np.sqrt(rest.astype(np.float64))[:, None]])


def choose_pivots(v: np.ndarray, top: int, count: int = PIVOTS) -> np.ndarray:
    """Augmented rows, each the farthest from those chosen before."""
    points = _augmented(v, top)
    if not len(points):
        return np.zeros((1, v.shape[1] + 1))
    chosen, far = [0], np.full(len(points), np.inf)
    while len(chosen) < min(count, len(points)):
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(1))
        chosen.append(int(far.argmax()))
    return points[chosen]


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((points - p) ** 2).sum(1)) for p in pivots], 1)


def pivot_table(rows: DataFrame, dim: int, top: int, pivots: np.ndarray) -> DataFrame:
    """(id, label, v, d) of rows (id, label, v): components as int32, distances to the pivots as float64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            lengths = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False).astype("<i4")
            v = np.zeros((len(batch), dim), np.int64)
            v[np.arange(dim)[None, :] < lengths[:, None]] = flat
            d = distances(_augmented(v, top), pivots)
            raw = [r.tobytes() for r in v.astype("<i4")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary()), pa.array([r.tobytes() for r in d], pa.binary())], ["id", "label", "v", "d"])

    return rows.mapInArrow(run, "id long, label long, v binary, d binary")


class Best:
    """The best few (score, id) of each of many queries, without equal ones."""

    def __init__(self, queries: int, few: int):
        self.few = few
        self.score = np.full((queries, few), np.iinfo(np.int64).min)
        self.id = np.zeros((queries, few), np.int64)
        self.count = np.zeros(queries, np.int64)

    def least(self) -> np.ndarray:
        """The score that a row must reach to enter; the lowest number while there is room."""
        return self.score[:, -1]

    def enter(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(query):
            return
        fresh = np.unique(query)
        old = np.arange(self.few)[None, :] < self.count[fresh][:, None]
        q = np.concatenate([query, np.repeat(fresh, self.count[fresh])])
        s = np.concatenate([score, self.score[fresh][old]])
        i = np.concatenate([ids, self.id[fresh][old]])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (s[1:] != s[:-1]) | (i[1:] != i[:-1])
        q, s, i = q[new], s[new], i[new]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < self.few
        q, s, i, place = q[kept], s[kept], i[kept], place[kept]
        self.score[fresh] = np.iinfo(np.int64).min
        self.score[q, place], self.id[q, place] = s, i
        self.count[fresh] = np.bincount(q, minlength=len(self.count))[fresh]


def brackets(dq: np.ndarray, dx: np.ndarray, norm2: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each anchor (rows) and table row (columns) that the pivots allow."""
    near = np.zeros((len(dq), len(dx)))
    far = np.full_like(near, np.inf)
    for k in range(dq.shape[1]):
        a, b = dq[:, k : k + 1], dx[None, :, k]
        np.maximum(near, np.abs(a - b), out=near)
        np.minimum(far, a + b, out=far)
    slack = 1e-6 * (1 + np.sqrt(top))  # far above the rounding of the distances
    near, far = np.maximum(near - slack, 0), far + slack
    base = norm2[:, None].astype(np.float64) + top
    rounding = 1 + 1e-12 * base
    return (base - far * far) / 2 - rounding, (base - near * near) / 2 + rounding


def _scores(q: np.ndarray, x: np.ndarray, top: int) -> np.ndarray:
    """Exact integer inner products; floats while every sum stays below 2^53."""
    if top < 1 << 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def search(table: DataFrame, anchors: dict, dim: int, top: int, few: int, low: int, high: int) -> DataFrame:
    """(query, id, score): the best few of each task for each query of a chunk of anchors.

    anchors: arrays id, label, v, d, norm2.  Without ``positive`` a query is an anchor and
    wants rows of its label; with positive (anchors x wanted, scores; ``real`` tells which
    exist) a query is an anchor's positive and wants rows of another label within the margins.
    """
    shared = table.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        n, positive = len(a["id"]), a.get("positive")
        width = 1 if positive is None else positive.shape[1]
        best = Best(n * width, few)
        for batch in batches:
            ids, labels = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            x = _matrix(batch.column(2), dim)
            dx = np.stack([np.frombuffer(r.as_py(), np.float64) for r in batch.column(3)])
            for at in range(0, n, TILE):
                part = slice(at, min(at + TILE, n))
                least, most = brackets(a["d"][part], dx, a["norm2"][part], top)
                same = a["label"][part, None] == labels[None, :]
                if positive is None:
                    want = same & (a["id"][part, None] != ids[None, :])
                    want &= most >= best.least()[part, None]
                else:
                    p, real = positive[part], a["real"][part]
                    room = best.least().reshape(n, width)[part]
                    floor = np.where(real, np.maximum(-(-low * p // high), room), np.iinfo(np.int64).max).min(1)
                    ceiling = np.where(real, p, np.iinfo(np.int64).min).max(1)
                    want = ~same & (most >= floor[:, None]) & (least <= ceiling[:, None])
                columns = np.flatnonzero(want.any(0))
                if not len(columns):
                    continue
                want = want[:, columns]
                s = _scores(a["v"][part], x[columns], top)
                for w in range(width):
                    if positive is None:
                        ok = want & (s >= best.least()[part, None])
                    else:
                        ok = want & real[:, w, None] & (high * s >= low * p[:, w, None]) & (s <= p[:, w, None]) & (s >= room[:, w, None])
                    r, c = np.nonzero(ok)
                    best.enter((r + at) * width + w, s[r, c], ids[columns[c]])
        q, place = np.nonzero(np.arange(few)[None, :] < best.count[:, None])
        for lo in range(0, len(q), 1 << 16):
            cut = slice(lo, lo + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(q[cut]), pa.array(best.id[q[cut], place[cut]]), pa.array(best.score[q[cut], place[cut]])], ["query", "id", "score"])

    return table.mapInArrow(run, "query long, id long, score long")


def _first(found: DataFrame, few: int) -> DataFrame:
    """The first few of each query over all tasks, with their rank."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= few)


def hard_negatives(rows: DataFrame, anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """``COLUMNS``: for each row under ``anchor`` and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of another label with low * positive_score <= high * negative_score <= high * positive_score.

    anchor: a condition on the column ``id``, the key as a long.
    """
    spark = rows.sparkSession
    plain = rows.where(usable(key, label, vector, scale)).select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), scaled(F.col(vector), scale).alias("v"))
    dim, top, n = plain.agg(F.max(F.size("v")), F.max(_norm2(F.col("v"))), F.count_if(anchor)).first()
    if not n:
        return spark.createDataFrame([], COLUMNS)
    sample = plain.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).select("v").collect()
    v = np.zeros((len(sample), dim), np.int64)
    for k, r in enumerate(sample):
        v[k, : len(r.v)] = r.v
    pivots = choose_pivots(v, top)
    table = written(pivot_table(plain, dim, top, pivots))
    chunks = max(1, -(-n * 4 * dim // CHUNK_BYTES))
    own = table.where(anchor).distinct().withColumn("chunk", F.pmod(F.xxhash64("id", "v"), F.lit(chunks)))
    out = None
    for k in range(chunks):
        got = own.where(F.col("chunk") == k).orderBy("id", "label", "v").toArrow()
        q = _matrix(got["v"].combine_chunks(), dim) if len(got) else np.zeros((0, dim), np.int64)
        if not len(q):
            continue
        a = {"id": got["id"].to_numpy(), "label": got["label"].to_numpy(), "v": q, "norm2": (q * q).sum(1)}
        # An anchor's distances to the pivots are those of the anchor with a zero; the table's are of it as a row.
        a["d"] = distances(np.hstack([q, np.zeros((len(q), 1))]), pivots)
        best = _first(search(table, a, dim, top, positives, low, high), positives).toArrow()
        score, ids = np.zeros((len(q), positives), np.int64), np.zeros((len(q), positives), np.int64)
        real = np.zeros((len(q), positives), bool)
        at = best["query"].to_numpy(), best["rank"].to_numpy() - 1
        score[at], ids[at], real[at] = best["score"].to_numpy(), best["id"].to_numpy(), True
        found = _first(search(table, a | {"positive": score, "real": real}, dim, top, negatives, low, high), negatives)
        names = spark.createDataFrame(pa.table({"query": np.arange(ids.size), "anchor_id": np.repeat(a["id"], positives), "positive_id": ids.ravel(), "positive_score": score.ravel()}))
        part = found.join(names, "query").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = part if out is None else out.unionByName(part)
    return out
