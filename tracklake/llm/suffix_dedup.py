"""Removal of byte strings that occur earlier, by suffix arrays of shards.

Every byte covered by a ``LENGTH``-byte string that also starts earlier (in a document of
smaller id, or earlier in the same one) is removed; strings are judged on the input.

Sorting all suffixes of a corpus would move each byte a hundred times.  So a string is
dealt to a shard by its anchor: of the ``KMER``-byte strings within it the one of the
least hash, the leftmost of equal ones.  The anchor depends on the string alone, so equal
strings meet; neighbouring strings share an anchor and travel as one fragment.  Anchors
that occur once in the corpus are dropped, and equal fragments are one row with their
first place before they reach a shard, so a passage in a third of all documents is one.

A shard is cut into blocks.  A block's suffix array is built by Larsson-Sadakane doubling
in numpy: groups that are settled are not sorted again.  Kasai's invariant gives the
common prefixes of neighbours, along all fragments at once.  Runs of common prefixes of
``LENGTH`` or more are equal strings; the first place of a run keeps it.  If an anchor's
fragments fill more than one block, the strings of later blocks are looked up in the
sorted strings of the earlier ones by binary search.

Null texts are empty; texts shorter than ``LENGTH`` lose nothing.  Rows that repeat an id
and text are one place and treated alike; of one id with several texts, the smaller hash
of the text comes first.  A null id comes after all others, as long as these are less than
2^63 - 2^32; rows without an id stand in the order of two hashes of their texts.  A text
of any length is read whole; an empty table gives an empty one; only the id and the
results are returned.  The sorted strings of an anchor whose fragments fill several
blocks are held by one task: 100 bytes for each of its different strings.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.llm.text import binary_column

LENGTH, KMER = 100, 16
#: The lowest bits of an anchor's hash deal the places of an anchor that are known to be repeated.
SALT_BITS = 10
#: Bytes of the fragments in one suffix array.
BLOCK = 1 << 21
_SPAN = 1 << 20
_LOW = np.uint64(_SPAN - 1)
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x94D049BB133111EB)


def _anchors(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one text: first start, number of starts, and hash of the anchor, of each run of strings with one anchor."""
    at, count, code = [], [], []
    step = _SPAN - LENGTH
    for lo in range(0, len(b) - LENGTH + 1, step):
        part = np.ascontiguousarray(b[lo : lo + step + LENGTH - 1])
        n = len(part) - LENGTH + 1
        if n <= 0:
            break
        a, c, h = _runs(part, np.array([0, len(part)]))
        at.append(a + lo)
        count.append(c)
        code.append(h)
    if not at:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    return np.concatenate(at), np.concatenate(count), np.concatenate(code)


def _runs(b: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for texts that lie end to end between ``bounds``, less than ``_SPAN`` bytes in all."""
    word = np.ndarray(len(b) - 7, "<u8", b.data, 0, (1,))
    h = word[:-8] * _C1 + word[8:] * _C2  # of the KMER = 16 bytes from each place
    h ^= h >> np.uint64(29)
    h *= _C3
    h ^= h >> np.uint64(32)
    key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    width, reach = LENGTH - KMER + 1, 1
    while 2 * reach <= width:
        key = np.minimum(key[:-reach], key[reach:])
        reach *= 2
    if reach < width:
        key = np.minimum(key[: len(key) - (width - reach)], key[width - reach :])
    start = np.arange(len(key))
    inside = start + LENGTH <= np.repeat(bounds[1:], np.diff(bounds))[: len(key)]
    start, place = start[inside], (key & _LOW)[inside].astype(np.int64)
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)])
    return start[first], np.diff(np.r_[first, len(start)]), h[place[first]]


def anchors(rows: DataFrame) -> DataFrame:
    """(h, d, rid, place): the runs of strings of each text ``t`` that share an anchor.

    h is the anchor's hash without its ``SALT_BITS`` lowest bits; these are 0 but for the
    further places of an anchor in a batch.  place is 256 x start + 2 x number of starts,
    plus 1 if the batch has the anchor more than once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, rid = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            buf, offsets = binary_column(batch.column(2))
            parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            row = 0
            while row < len(d):
                end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + _SPAN - 1, "right")) - 1)
                b = buf[offsets[row] : offsets[end]]
                if len(b) >= LENGTH:
                    if len(b) < _SPAN:
                        b = np.ascontiguousarray(b)
                        at, n, h = _runs(b, offsets[row : end + 1] - offsets[row])
                    else:
                        at, n, h = _anchors(b)
                    of = np.searchsorted(offsets[row : end + 1] - offsets[row], at, "right") - 1
                    parts.append((h, row + of, ((at - (offsets[row + of] - offsets[row])) << 8) + 2 * n))
                row = end
            if parts:
                h, of, place = (np.concatenate(c) for c in zip(*parts, strict=True))
                h = (h >> np.uint64(SALT_BITS)) << np.uint64(SALT_BITS)
                order = np.argsort(h, kind="stable")
                same = h[order[1:]] == h[order[:-1]]
                place[order[1:][same]] |= 1
                place[order[:-1][same]] |= 1
                further = order[1:][same]
                salt = (_C1 * (place[further].astype(np.uint64) + d[of[further]].astype(np.uint64))) >> np.uint64(64 - SALT_BITS)
                h[further] |= np.maximum(salt, np.uint64(1))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(d[of]), pa.array(rid[of]), pa.array(place)], ["h", "d", "rid", "place"])

    return rows.mapInArrow(run, "h bigint, d bigint, rid int, place bigint")


def repeated_anchors(met: DataFrame) -> DataFrame:
    """(h, d, rid, at, n): the runs whose anchor occurs more than once in the corpus."""
    counted = met.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("h"))).where((F.col("c") > 1) | (F.col("place") % 2 == 1))
    clear = F.col("h").bitwiseAND(F.lit(-(1 << SALT_BITS)))
    return counted.select(clear.alias("h"), "d", "rid", F.shiftright("place", 8).cast("int").alias("at"), F.shiftright(F.col("place") % 256, 1).cast("int").alias("n"))


def suffix_array(data: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of all suffixes, which stop at ``end`` of their place; equal ones stand in the order of the text.

    Larsson-Sadakane: the rank of a group is the place of its last suffix in the order;
    each round doubles the sorted length and sorts only groups of more than one.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.ndarray(n, ">u8", padded.data, 0, (1,)).astype(np.uint64)
    short = np.minimum(end - np.arange(n), 8)
    # Bytes beyond the end count as zeros; a suffix that ends sorts before one that goes on.
    shift = (np.uint64(8) * (8 - short).astype(np.uint64)) & np.uint64(63)
    key = (key >> shift) << shift
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    edge = np.r_[sorted_[1:] != sorted_[:-1], True]
    last = np.flatnonzero(edge)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(last, np.diff(np.r_[-1, last]))
    h, longest = 8, int((end - np.arange(n)).max(initial=0))
    size = np.diff(np.r_[-1, last])
    open_ = np.flatnonzero(np.repeat(size > 1, size))  # places in the order
    while len(open_) and h < longest:
        at = order[open_]
        group = rank[at]
        after = np.where(at + h < end[at], rank[np.minimum(at + h, n - 1)], -1)
        by = np.argsort(group * np.int64(n + 1) + (after + 1), kind="stable")
        at, group, after = at[by], group[by], after[by]
        order[open_] = at
        edge = np.r_[(group[1:] != group[:-1]) | (after[1:] != after[:-1]), True]
        last = np.flatnonzero(edge)
        size = np.diff(np.r_[-1, last])
        rank[at] = np.repeat(open_[last], size)
        open_ = open_[np.repeat(size > 1, size)]
        h *= 2
    return order, rank


def common_prefixes(data: np.ndarray, order: np.ndarray, begin: np.ndarray, length: np.ndarray, limit: int = LENGTH) -> np.ndarray:
    """Of each suffix, the common prefix with the one before it in the order, up to ``limit``.

    Kasai: from one suffix to the next in the text the value falls by one at most.  All
    fragments (``begin``, ``length``) take the same step at once.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    end = np.repeat(begin + length, length)
    out = np.zeros(n, np.int64)
    keep = np.zeros(len(begin), np.int64)
    rows = np.argsort(-length, kind="stable")
    sizes = length[rows]
    for o in range(int(length.max(initial=0))):
        live = rows[: int(np.searchsorted(-sizes, -o, "left"))]
        i = begin[live] + o
        j = before[i]
        h = np.where(j >= 0, np.maximum(keep[live] - 1, 0), 0)
        most = np.where(j >= 0, np.minimum(np.minimum(end[i] - i, end[j] - j), limit), 0)
        h = np.minimum(h, most)
        grow = np.flatnonzero(h < most)
        while len(grow):
            same = data[i[grow] + h[grow]] == data[j[grow] + h[grow]]
            grow = grow[same]
            h[grow] += 1
            grow = grow[h[grow] < most[grow]]
        out[i] = h
        keep[live] = h
    return out


def first_places(fragments: list[bytes], starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of fragments in the order of their places: for every own start whether an earlier fragment has its string.

    Returns (seen, of, offset): a flag, the fragment and the offset of each own start.
    """
    data = np.frombuffer(b"".join(fragments), np.uint8)
    size = np.fromiter(map(len, fragments), np.int64, len(fragments))
    begin = np.r_[0, np.cumsum(size)[:-1]]
    end = np.repeat(begin + size, size)
    order, _ = suffix_array(data, end)
    lcp = common_prefixes(data, order, begin, size, length)
    # Runs of common prefixes of the whole length; the least fragment of a run is the first place.
    run = np.cumsum(lcp[order] < length) - 1
    fragment = np.repeat(np.arange(len(fragments)), size)[order]
    offset = order - begin[fragment]
    own = offset < starts[fragment]
    run, fragment, offset = run[own], fragment[own], offset[own]
    least = np.full(int(run.max(initial=-1)) + 1, len(fragments), np.int64)
    np.minimum.at(least, run, fragment)
    return least[run] < fragment, fragment, offset


def _strings(fragments: list[bytes], of: np.ndarray, offset: np.ndarray, length: int) -> np.ndarray:
    return np.array([fragments[f][o : o + length] for f, o in zip(of.tolist(), offset.tolist(), strict=True)], f"V{length}").view(f"S{length}")


def first_of_batch(rows: DataFrame) -> DataFrame:
    """Of equal fragments (h, frag) in one Arrow batch the first place only: less to shuffle for passages met often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch]).sort_by([("d", "ascending"), ("at", "ascending"), ("rid", "ascending")])
            first = t.group_by(["h", "frag"], use_threads=False).aggregate([(c, "first") for c in ("d", "rid", "at", "n")])
            yield from first.rename_columns(["h", "frag", "d", "rid", "at", "n"]).select(batch.schema.names).combine_chunks().to_batches()

    return rows.mapInArrow(run, rows.schema)


def kept_strings(rows: DataFrame, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """(d, rid, a, b): runs of starts of first places that keep their strings, from fragments (h, frag, d, rid, at, n) sorted by h, d, at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[tuple] = []
        size = 0
        carried: list = [None, None]  # anchor, sorted strings of its earlier blocks

        def solve(part: list[tuple], more: bool) -> pa.RecordBatch:
            fragments = [r[1] for r in part]
            code = np.array([r[0] for r in part], np.int64)
            seen, of, offset = first_places(fragments, np.array([r[5] for r in part], np.int64), length)
            if carried[0] is not None:
                mine = np.flatnonzero((code[of] == carried[0]) & ~seen)
                if len(mine) and len(carried[1]):
                    s = _strings(fragments, of[mine], offset[mine], length)
                    at = np.minimum(np.searchsorted(carried[1], s), len(carried[1]) - 1)
                    seen[mine[carried[1][at] == s]] = True
            if more:  # the anchor of the last fragment goes on in the next block
                tail = np.flatnonzero((code[of] == code[-1]) & ~seen)
                s = np.sort(_strings(fragments, of[tail], offset[tail], length))
                carried[1] = np.sort(np.concatenate([carried[1], s])) if carried[0] == code[-1] else s
                carried[0] = code[-1]
            else:
                carried[0] = carried[1] = None
            by = np.lexsort((offset, of))
            keep = by[~seen[by]]
            of, offset = of[keep], offset[keep]
            first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (offset[1:] != offset[:-1] + 1)]) if len(of) else np.zeros(0, np.int64)
            count = np.diff(np.r_[first, len(of)])
            d, rid, at = (np.array([r[k] for r in part], np.int64) for k in (2, 3, 4))
            f, a = of[first], at[of[first]] + offset[first]
            return pa.RecordBatch.from_arrays([pa.array(d[f]), pa.array(rid[f].astype(np.int32)), pa.array(a.astype(np.int32)), pa.array((a + count).astype(np.int32))], ["d", "rid", "a", "b"])

        group: list[tuple] = []  # the different fragments of the anchor that is being read
        texts: set[bytes] = set()
        group_size = 0
        lone: list[tuple] = []

        def whole(part: list[tuple]) -> pa.RecordBatch:
            """The only fragments of their anchors: all their strings are first places."""
            d, rid, at, n = (np.array([r[k] for r in part], np.int64) for k in (2, 3, 4, 5))
            return pa.RecordBatch.from_arrays([pa.array(d), pa.array(rid.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array((at + n).astype(np.int32))], ["d", "rid", "a", "b"])

        for batch in itertools.chain(batches, [None]):
            table = zip(*[c.to_pylist() for c in batch.columns], strict=True) if batch is not None else [None]
            for r in table:
                if group and (r is None or group[0][0] != r[0]):  # the anchor is complete
                    if len(group) == 1 and not (pending and pending[-1][0] == group[0][0]) and carried[0] != group[0][0]:
                        lone.append(group[0])
                    else:
                        pending += group
                        size += sum(len(x[1]) for x in group)
                    group, texts, group_size = [], set(), 0
                    if size >= block:
                        yield solve(pending, False)
                        pending, size = [], 0
                    if len(lone) >= 10_000:
                        yield whole(lone)
                        lone = []
                if r is not None and r[1] not in texts:
                    texts.add(r[1])
                    group.append(r)
                    group_size += len(r[1])
                    if group_size >= 2 * block:
                        yield solve(pending + group, True)
                        pending, size, group, texts, group_size = [], 0, [], set(), 0
        if pending:
            yield solve(pending, False)
        if lone:
            yield whole(lone)

    return rows.mapInArrow(run, "d bigint, rid int, a int, b int")


def cut(rows: DataFrame) -> DataFrame:
    """Of each row (id, t, runs, kept): the remaining bytes and the figures; runs less kept are the starts removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, runs, kept = batch.columns
            out: list[list] = [[], [], [], [], []]
            for k in range(len(ids)):
                t = texts[k].as_py() or b""
                gone = spans = 0
                rest = t
                if runs[k].is_valid:
                    change = np.zeros(len(t) + 1, np.int64)
                    for r in runs[k].as_py():
                        change[r["at"]] += 1
                        change[r["at"] + r["n"]] -= 1
                    start = np.cumsum(change)[:-1] > 0
                    if kept[k].is_valid:
                        for r in kept[k].as_py():
                            start[r["a"] : r["b"]] = False
                    where = np.flatnonzero(start)
                    if len(where):
                        change[:] = 0
                        np.add.at(change, where, 1)
                        np.add.at(change, where + LENGTH, -1)
                        covered = np.cumsum(change)[:-1] > 0
                        gone = int(covered.sum())
                        spans = int((covered & ~np.r_[False, covered[:-1]]).sum())
                        rest = np.frombuffer(t, np.uint8)[~covered].tobytes()
                for column, v in zip(out, (len(t), gone, spans, hashlib.sha256(rest).hexdigest(), rest), strict=True):
                    column.append(v)
                if sum(map(len, out[4][-1:])) and k % 256 == 255:
                    yield _cut_batch(ids.slice(k + 1 - len(out[0]), len(out[0])), out)
                    out = [[], [], [], [], []]
            if out[0]:
                yield _cut_batch(ids.slice(len(ids) - len(out[0]), len(out[0])), out)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "t", "runs", "kept").mapInArrow(run, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, rest binary")


def _cut_batch(ids: pa.Array, out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(out, kinds, strict=True)]], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "rest"])


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, rest) of each row."""
    body = F.coalesce(F.col(text), F.lit(""))
    # Two hashes of 32 bits tell rows without an id apart.
    beyond = 2**63 - 2**32
    d = F.coalesce(F.col(key).cast("bigint"), F.lit(beyond) + F.shiftrightunsigned(F.xxhash64(body), 32))
    rows = df.select(d.alias("d"), F.hash(body).alias("rid"), body.cast("binary").alias("t"))
    place = F.struct(F.col("d"), F.col("rid"))
    firsts = rows.select("d", "rid", F.unhex(F.sha2("t", 256)).alias("digest")).groupBy("digest").agg(F.min(place).alias("p")).select("p.d", "p.rid", F.lit(True).alias("first"))
    # One shuffle of the texts by document serves all joins with them.
    by_doc = repeated_anchors(anchors(rows.join(firsts, ["d", "rid"]).select("d", "rid", "t"))).groupBy("d", "rid").agg(F.collect_set(F.struct("h", "at", "n")).alias("runs"))
    pieces = rows.join(by_doc, ["d", "rid"]).select("d", "rid", "t", F.explode_outer("runs").alias("r"))
    fragments = pieces.select(F.col("r.h").alias("h"), F.substring("t", F.col("r.at") + 1, F.col("r.n") + (LENGTH - 1)).alias("frag"), "d", "rid", F.col("r.at").alias("at"), F.col("r.n").alias("n"))
    kept = kept_strings(first_of_batch(fragments).repartition("h").sortWithinPartitions("h", "d", "at", "rid"))
    kept = kept.groupBy("d", "rid").agg(F.collect_list(F.struct("a", "b")).alias("kept"))
    joined = rows.join(firsts, ["d", "rid"], "left").join(by_doc, ["d", "rid"], "left").join(kept, ["d", "rid"], "left")
    # A later one of equal texts: one run of all its starts, of which none is kept.
    n = F.octet_length("t") - (LENGTH - 1)
    copy = F.col("first").isNull() & (n > 0)
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("h"), F.lit(0).alias("at"), n.alias("n")))
    joined = joined.withColumn("runs", F.when(copy, whole).otherwise(F.col("runs")))
    id_ = F.when(F.col("d") < beyond, F.col("d")).cast(df.schema[key].dataType)
    return cut(joined.withColumn("id", id_)).withColumnRenamed("id", key)
