"""Near-duplicates by ProbMinHash, banding and verification.

A document is the multiset of its five-word shingles (lower case words; a document of
fewer words is one shingle), each weighted by its number.  Every shingle is a Poisson
process of the rate of its weight: its arrivals choose a register each, and a register
keeps the shingle of its first arrival.  Arrivals are drawn in slices of time, and the
process ends as soon as no later arrival can be first in any register.  Two documents
agree in a register with the probability Jaccard similarity of their weighted shingles.

Bands of registers give candidates, and every candidate link is verified on the whole
texts: the Jaccard similarity of the shingle sets must be ``threshold`` or more.  As that
is a measure of sets, a document with repeated shingles also has the bands of its shingles
with equal weights.  Equal texts are grouped first and stand in the rest of the work as
one.  A bucket of at most ``SMALL`` different texts gives all its pairs; in a larger one
all are compared with its leader first, another for each band.  Where that leaves several
classes in a bucket, all its pairs between classes are compared, block against block.
Documents without words are equal if their texts are.

The class of a document is the least id of its connected component.  A null text is
empty; a null id has a null class; rows that repeat an id share its class, and one id with
several texts is linked through each of them.  A text of any length is read whole, in
slices; an empty table gives an empty one.  Only the id and the class are returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm.components import checkpoint, components, unused
from tracklake.llm.text import binary_column, mix, shingles, slices, words

WORDS, THRESHOLD = 5, 0.8
#: 20 bands of 5 registers: a pair of similarity 0.8 is a candidate with probability 0.9996.
BANDS, ROWS = 20, 5
SMALL = 16
#: A block of a larger bucket: about so many texts, or bytes of text.
BLOCK_ROWS, BLOCK_BYTES = 512, 4 << 20
_BITS = 50


def weighted_shingles(buf: np.ndarray, offsets: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, 50-bit shingle, count) of the distinct shingles of each row, in the order of rows and shingles."""
    _, _, h, at = words(buf, offsets)
    s, row = shingles(h, at, width)
    key = np.sort((row.astype(np.uint64) << np.uint64(_BITS)) | (s >> np.uint64(64 - _BITS)))
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(key)])
    key = key[first]
    return (key >> np.uint64(_BITS)).astype(np.int64), key & np.uint64((1 << _BITS) - 1), count


def prob_minhash(row: np.ndarray, item: np.ndarray, weight: np.ndarray, n_rows: int, registers: int) -> np.ndarray:
    """The (n_rows, registers) signatures: in each register the item of the first arrival."""
    least = np.full(n_rows * registers, np.inf)
    who = np.zeros(n_rows * registers, np.uint64)
    total = np.bincount(row, weights=weight, minlength=n_rows)
    open_ = total > 0
    # Until this time all registers of most rows have an arrival.
    limit = np.zeros(n_rows)
    limit[open_] = registers * (math.log(registers) + 3) / total[open_]
    while open_.any():
        mine = open_[row]
        r, d, w = row[mine], item[mine], weight[mine]
        time, k = np.zeros(len(r)), 0
        least.reshape(n_rows, registers)[open_] = np.inf
        while len(r):
            draw = mix(d, 101 + 2 * k)
            u = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
            time = time - np.log(u) / w
            early = time <= limit[r]
            r, d, w, time = r[early], d[early], w[early], time[early]
            at = r * registers + (mix(d, 102 + 2 * k) % np.uint64(registers)).astype(np.int64)
            np.minimum.at(least, at, time)
            won = least[at] == time
            who[at[won]] = d[won]
            k += 1
        # A register without an arrival: its row needs a later slice.
        open_ &= np.isinf(least.reshape(n_rows, registers)).any(axis=1)
        limit[open_] *= 2
    return who.reshape(n_rows, registers)


def signatures(df: DataFrame, key: str, text: str, bands: int, rows: int) -> DataFrame:
    """(key, digest, band_keys): the digest of the text, and one hash for each band (none without words).

    With repeated shingles there is a second hash for each band, of the shingles with equal weights.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    plain = df.select(F.col(key).alias("id"), F.sha2(body.cast("binary"), 256).alias("digest"), F.lower(body).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = binary_column(batch.column(2))
            for a, b in slices(offsets):
                row, item, count = weighted_shingles(buf, offsets[a : b + 1])
                some = np.bincount(row, minlength=b - a) > 0
                again = np.bincount(row, weights=count > 1, minlength=b - a) > 0
                # Rows with repeated shingles stand for a second time behind the others.
                copy = np.cumsum(again) - 1 + (b - a)
                twice = again[row]
                r, i = np.r_[row, copy[row[twice]]], np.r_[item, item[twice]]
                sig = prob_minhash(r, i, np.r_[count, np.ones(twice.sum())].astype(float), b - a + int(again.sum()), bands * rows)
                keys = np.zeros((len(sig), bands), np.uint64)
                for j in range(rows):
                    keys = mix(keys * np.uint64(31) + sig[:, j::rows], 11 + j)
                keys = mix(keys ^ np.arange(bands, dtype=np.uint64), 3)
                size = np.where(some, np.where(again, 2 * bands, bands), 0)
                own = np.r_[np.flatnonzero(some), np.flatnonzero(again)]
                order = np.argsort(own, kind="stable")
                keys = keys[np.r_[np.flatnonzero(some), np.arange(b - a, len(sig))][order]]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), lists], ["id", "digest", "band_keys"])

    kind = df.schema[key].dataType.simpleString()
    return plain.mapInArrow(run, f"id {kind}, digest string, band_keys array<bigint>")


def buckets(reps: DataFrame) -> DataFrame:
    """(k, id, n, leader) of the buckets with several texts."""
    rows = reps.select("id", F.explode(F.array_distinct("band_keys")).alias("k")).distinct()
    stats = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("id", "k").alias("h"), F.col("id").alias("id")))["id"].alias("leader")).where("n > 1")
    return rows.join(stats, "k")


def candidate_pairs(met: DataFrame) -> DataFrame:
    """(a, b) with a < b that share a bucket: all pairs of small buckets, pairs with the leader of others."""
    star = met.where((F.col("n") > SMALL) & (F.col("id") != F.col("leader"))).select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b"))
    small = met.where(F.col("n") <= SMALL).groupBy("k").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    firsts = small.select("ids", F.posexplode("ids").alias("i", "a"))
    pairs = firsts.select("a", F.explode(F.slice("ids", F.col("i") + 2, SMALL)).alias("b"))
    return star.union(pairs).distinct()


def _linked(k: int, part: pd.DataFrame, cross: bool, threshold: float) -> list[tuple]:
    """Links between the classes of two blocks of bucket ``k`` (or within one) until none is left to join."""
    part = part.sort_values("block", kind="stable")
    n, ids = len(part), part["id"].tolist()
    buf, offsets = binary_column(pa.array(part["t"].tolist(), pa.binary()))
    row, item, _ = weighted_shingles(buf, offsets)
    names, code = np.unique(item, return_inverse=True)
    at, flag = np.searchsorted(row, np.arange(n + 1)), np.zeros(len(names), bool)
    size, root = np.diff(at), np.unique(part["component"], return_inverse=True)[1]
    keys = [np.asarray(x) for x in part["keys"]]
    key, key_row = np.concatenate(keys), np.repeat(np.arange(n), [len(x) for x in keys])
    key_at = np.searchsorted(key_row, np.arange(n + 1))
    left = int((part["block"] == part["block"].iloc[0]).sum()) if cross else n
    out = []
    for x in range(left):
        to = left if cross else x + 1
        others = root[to:] != root[x]
        if others.any():
            # A pair of several buckets is compared in that of the least key.
            shared = np.flatnonzero(np.isin(key[key_at[to] :], keys[x])) + key_at[to]
            least = shared[np.r_[True, np.diff(key_row[shared]) > 0]] if len(shared) else shared
            here = np.zeros(n - to, bool)
            here[key_row[least[key[least] == k]] - to] = True
            others &= here
        if not others.any():
            continue
        mine = code[at[x] : at[x + 1]]
        flag[mine] = True
        common = np.bincount(row[at[to] :][flag[code[at[to] :]]] - to, minlength=n - to)
        flag[mine] = False
        near = others & (common / np.maximum(size[x] + size[to:] - common, 1) >= threshold)
        for y in np.flatnonzero(near) + to:
            if root[y] != root[x]:
                out.append((ids[x], ids[y]))
                root[root == root[y]] = root[x]
    return out


def bucket_links(large: DataFrame, classes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b): verified links that join the classes (node, component) that meet in a large bucket.

    Buckets of one class are settled.  Of the others every pair of members of different
    classes is compared; a bucket is dealt out by pairs of its blocks, and only links come out.
    """
    named = large.join(classes.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = named.groupBy("k").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("k")
    members = checkpoint(named.join(several, "k").select("k", "id", "component"))
    body = texts.select(F.col("w").alias("id"), F.lower(F.coalesce("t", F.lit(""))).cast("binary").alias("t"))
    keys = members.groupBy("id").agg(F.array_sort(F.collect_list("k")).alias("keys"))
    body = checkpoint(body.join(keys, "id"))
    sized = members.join(body.select("id", F.octet_length("t").alias("bytes")), "id")
    blocks = sized.groupBy("k").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("bytes") / BLOCK_BYTES)).alias("blocks"))
    dealt = members.join(blocks, "k").withColumn("block", F.pmod(F.xxhash64("id", "k"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("k", "id", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    # Each task gets the texts of two blocks.
    full = dealt.join(body, "id")
    kind = large.schema["id"].dataType.simpleString()

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        k, i, j = key
        found = [] if i != j and part["block"].nunique() < 2 else _linked(int(k), part, i != j, threshold)
        return pd.DataFrame(found, columns=["a", "b"])

    return full.groupBy("k", "i", "j").applyInPandas(run, f"a {kind}, b {kind}")


def shingle_similarity(pairs: DataFrame, left: str, right: str, to: str = "similarity", width: int = WORDS) -> DataFrame:
    """Adds the Jaccard similarity of the shingle sets of two text columns, which are dropped."""
    kept = [c for c in pairs.columns if c not in (left, right)]
    cast = pairs.select(*kept, *[F.lower(F.coalesce(c, F.lit(""))).cast("binary").alias(c) for c in (left, right)])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema if f.name in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(kept)
            (lb, lo), (rb, ro) = binary_column(batch.column(n)), binary_column(batch.column(n + 1))
            for a, b in slices(lo + ro, 1 << 22):
                lrow, litem, _ = weighted_shingles(lb, lo[a : b + 1], width)
                rrow, ritem, _ = weighted_shingles(rb, ro[a : b + 1], width)
                shift = np.uint64(_BITS)
                lkey, rkey = (lrow.astype(np.uint64) << shift) | litem, (rrow.astype(np.uint64) << shift) | ritem
                both = np.intersect1d(lkey, rkey, assume_unique=True)
                common = np.bincount((both >> shift).astype(np.int64), minlength=b - a)
                union = np.bincount(lrow, minlength=b - a) + np.bincount(rrow, minlength=b - a) - common
                out = common / np.maximum(union, 1)
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns[:n]], pa.array(out)], [*kept, to])

    return cast.mapInArrow(run, f"{fields}, `{to}` double")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, class_id) of each row; class_id is the least id of its near-duplicates."""
    sketch = checkpoint(signatures(df, key, text, bands, rows))
    groups = sketch.where("id is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.min_by("band_keys", "id").alias("band_keys"))
    reps = groups.select(F.col("rep").alias("id"), "band_keys")
    met = checkpoint(buckets(reps))
    pairs = checkpoint(candidate_pairs(met))
    wanted = pairs.select(F.col("a").alias("w")).union(pairs.select(F.col("b").alias("w"))).distinct()
    texts = df.select(F.col(key).alias("w"), F.col(text).alias("t")).join(wanted, "w", "left_semi")
    # One id with several texts has a row for each: it is linked through any of them.
    texts = checkpoint(texts.groupBy("w", F.sha2(F.coalesce("t", F.lit("")), 256)).agg(F.min("t").alias("t")).select("w", "t"))
    joined = pairs.join(texts.select(F.col("w").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("w").alias("b"), F.col("t").alias("tb")), "b")
    links = shingle_similarity(joined.select("a", "b", "ta", "tb"), "ta", "tb").where(F.col("similarity") >= threshold).select("a", "b")
    members = sketch.select("id", "digest").join(groups.select("digest", "rep"), "digest", "left")
    several = members.groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("id", "lo")
    own = members.join(several, "id").where("lo < rep").select(F.col("lo").alias("a"), F.col("rep").alias("b"))
    classes = components(links.union(own))
    large = met.where(F.col("n") > SMALL)
    if not large.isEmpty():
        # What leaders have not joined: few links, as those between members of one class are not asked for.
        classes = checkpoint(classes)
        more = checkpoint(bucket_links(large, classes, texts, threshold))
        if not more.isEmpty():
            classes = components(more.union(classes.select("node", "component")))
    # Copies of a text link to its representative.
    named = members.join(classes.withColumnRenamed("node", "rep"), "rep", "left")
    return named.select(F.col("id").alias(key), F.when(F.col("id").isNotNull(), F.coalesce("component", "rep")).alias("class_id"))


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """Keeps one row of each class, the one of the least id; rows with a null id are kept."""
    classes = near_duplicates(df, key, text, **settings)
    name = unused(df, "gone")
    gone = classes.where(F.col(key) != F.col("class_id")).select(F.col(key).alias(name)).distinct()
    return df.join(gone, df[key] == F.col(name), "left_anti")
