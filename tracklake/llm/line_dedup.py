"""Line dedup by an exact set-similarity join.

A line is the set of its lower-case words.  A line is removed if an earlier line (of a
smaller id, or above in the same document) has a Jaccard similarity of ``THRESHOLD`` or
more; lines are judged on the input, not on what is left.  Lines without words stay.

Lines of equal sets are grouped first, and their first one stands for them in the join.
The words of a line are put in order of rarity, by counts over all documents in a table
of fixed size; any order is right, a good one makes small groups.  Two similar lines of n
and m words share a word among the first n - ceil(0.8 n) + 1 words of each: the prefix,
whose words are the join keys.  A word met more than ``HOT`` times is no key of its own:
each of its pairs with a later word of the prefix and one more is one, as lines that are
similar share a second word there.

Within a key the rows are in order of their numbers of words.  Two rows are a candidate pair if
they pass four filters: length (m >= 0.8 n); position (what is left of the lines from the
key on still allows the overlap that is needed); first meeting (lines whose words before
the key are the same word meet in that word's group as well); and signature (the parities
of the words by 128 bits differ in too many bits for the overlap).  Only rows that have a
candidate go on, with their whole sets of words: once more grouped by key, each is
compared there with its candidates until an earlier one is similar enough.  No pairs are
written, only the lines that have a candidate and the lines that go.

A null text has no lines; a text of any length is read whole, in slices; an empty table
gives an empty one.  Rows that repeat an id and text lose the same lines; of one id with
several texts, the smaller hash of the text comes first at equal line numbers.  A null id
comes after all others, as long as these are less than 2^63 - 2^32.  Extra columns are
passed on, whatever their names; a column of the name of an added one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.llm.components import unused, written
from tracklake.llm.text import binary_column, mix, slices, words

THRESHOLD, LEAST_WORDS = 0.8, 1
#: The table of word counts: 2^20 buckets of words, a fixed 4 MB.
BUCKET_BITS, CHUNK = 20, 4096
#: Words of a bucket met more often are keys only together with a second word.
HOT = 1 << 12
#: Rows of keys, and bytes of words, that a task compares at once.
JOIN_ROWS, JOIN_BYTES = 1 << 19, 1 << 25
_SLICE = 1 << 19
#: Lines that are held at once to find equal ones.
_HELD = 1 << 17
#: Rows of a key that are compared step by step before each open one is compared with all.
_STEPS = 64
#: The lowest bits of a word of a prefix: it is hot, it was met once.
_IS_HOT, _LONE = np.uint32(1), np.uint32(2)


def _rank(count: float) -> float:
    return 1 + min(np.log2(max(count, 1)) * 1000, 65000)


def _line_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of texts: the hash, the row, and the line number of each word."""
    starts, _, h, at = words(buf, offsets)
    base = int(offsets[0])
    breaks = np.flatnonzero(buf[base : int(offsets[-1])] == 10) + base
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    line = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[:-1])[row]
    return h, row, line


def word_counts(texts: DataFrame) -> np.ndarray:
    """Counts of all words of column ``t`` by hash bucket: a table of fixed size, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            buf, offsets = binary_column(batch.column(0))
            for a, b in slices(offsets):
                h = words(buf, offsets[a : b + 1])[2]
                total += np.bincount((h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(total))
        parts = total.reshape(-1, CHUNK)
        salt = int(total.sum()) % 32
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), salt, np.int32)), pa.array([parts[k].tobytes() for k in some], pa.binary())], ["chunk", "salt", "counts"])

    def total(group: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(CHUNK, np.int64)
        for c in group.counts:
            out += np.frombuffer(c, np.int64)
        return pd.DataFrame({"chunk": [group.chunk.iloc[0]], "salt": [group.salt.iloc[0]], "counts": [out.tobytes()]})

    kind = "chunk int, salt int, counts binary"
    parts = texts.mapInArrow(count, kind)
    # Two levels: a chunk's parts of very many tasks are not summed in one.
    parts = parts.groupBy("chunk", "salt").applyInPandas(total, kind).withColumn("salt", F.lit(0)).groupBy("chunk", "salt").applyInPandas(total, kind)
    table = np.zeros((1 << BUCKET_BITS) // CHUNK * CHUNK, np.int64).reshape(-1, CHUNK)
    for r in parts.collect():
        table[r["chunk"]] = np.frombuffer(r["counts"], np.int64)
    return table.ravel()


def ranks(counts: np.ndarray) -> np.ndarray:
    """A 16-bit rank of rarity for each bucket: 0 for a word met once, then growing with the logarithm of the count."""
    return np.where(counts <= 1, 0, 1 + np.minimum(np.log2(np.maximum(counts, 1)) * 1000, 65000)).astype(np.uint16)


def prefix_length(n: np.ndarray, threshold: float) -> np.ndarray:
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def _parity(h: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of parity, in two halves, of each set of words that begins at ``start``."""
    bit = np.uint64(1) << ((h >> np.uint64(36)) & np.uint64(63))
    half = (h >> np.uint64(42)) & np.uint64(1) == 1
    return tuple(np.bitwise_xor.reduceat(np.where(half == v, bit, np.uint64(0)), start) for v in (False, True))


def line_sets(rows: DataFrame, rarity: np.ndarray, threshold: float = THRESHOLD, least: int = LEAST_WORDS, hot: int = HOT) -> DataFrame:
    """(h1, h2, d, line, rid, n, sig, sig2, keys, again): each line's set of words by two hashes, its size, parity and prefix.

    keys: the prefix and one more word, 30 bits each and two flags.
    again: an equal set stands earlier in the same batch; such a line has no keys, and h1 is spread.
    """
    shared = rows.sparkSession.sparkContext.broadcast(rarity)
    names = ["h1", "h2", "d", "line", "rid", "n", "sig", "sig2", "keys", "again"]
    often = _rank(hot)

    def told(parts: list[tuple]) -> pa.RecordBatch:
        h1, h2, d, line, rid, n, sig, sig2 = (np.concatenate(c) for c in list(zip(*parts, strict=True))[:8])
        keys = pa.concat_arrays([p[8] for p in parts])
        order = np.lexsort((rid, line, d, h2, h1))
        again = np.zeros(len(h1), bool)
        again[order[1:]] = (h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]])
        # A repeated row has the same lines at the same places: they are told once.
        head = np.maximum.accumulate(np.where(again[order], 0, np.arange(len(order))))
        first = np.empty(len(order), np.int64)
        first[order] = order[head]
        same = again & (d == d[first]) & (line == line[first]) & (rid == rid[first])
        if same.any():
            keep = np.flatnonzero(~same)
            h1, h2, d, line, rid, n, sig, sig2, again = (c[keep] for c in (h1, h2, d, line, rid, n, sig, sig2, again))
            keys = keys.take(pa.array(keep))
        if again.any():
            h1 = np.where(again, mix(h1.view(np.uint64) + d.view(np.uint64) * np.uint64(31) + line.astype(np.uint64), 23).view(np.int64), h1)
            size = np.where(again, 0, np.diff(keys.offsets.to_numpy()))
            values = keys.flatten().filter(pa.array(np.repeat(~again, np.diff(keys.offsets.to_numpy()))))
            keys = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), values)
        return pa.RecordBatch.from_arrays([*map(pa.array, (h1, h2, d, line, rid, n, sig, sig2)), keys, pa.array(again)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        parts: list[tuple] = []
        for batch in batches:
            d, rid = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            buf, offsets = binary_column(batch.column(2))
            for a, b in slices(offsets, _SLICE):
                h, row, line = _line_words(buf, offsets[a : b + 1])
                if not len(h):
                    continue
                new = np.r_[True, (row[1:] != row[:-1]) | (line[1:] != line[:-1])]
                number = np.cumsum(new) - 1
                head = np.flatnonzero(new)
                for k in range(0, len(head), 1 << 16):
                    lo, hi = head[k], head[k + (1 << 16)] if k + (1 << 16) < len(head) else len(h)
                    first = head[k : k + (1 << 16)]
                    out = _sets(h[lo:hi], number[lo:hi] - k, table, threshold, least, often)
                    if out is not None:
                        of, h1, h2, n, sig, sig2, keys = out
                        r = row[first][of] + a
                        parts.append((h1, h2, d[r], line[first][of].astype(np.int32), rid[r], n.astype(np.int32), sig, sig2, keys))
                if sum(len(p[0]) for p in parts) >= _HELD:
                    yield told(parts)
                    parts = []
        if parts:
            yield told(parts)

    return rows.mapInArrow(run, "h1 bigint, h2 bigint, d bigint, line int, rid int, n int, sig bigint, sig2 bigint, keys array<int>, again boolean")


def _sets(h: np.ndarray, number: np.ndarray, table: np.ndarray, threshold: float, least: int, often: float):
    """The sets of up to 2^16 lines."""
    rank = table[(h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
    order = np.argsort((number.astype(np.uint64) << np.uint64(48)) | (rank.astype(np.uint64) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)))
    h, number, rank = h[order], number[order], rank[order]
    fresh = np.r_[True, (h[1:] != h[:-1]) | (number[1:] != number[:-1])]
    h, number, rank = h[fresh], number[fresh], rank[fresh]
    start = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
    n = np.diff(np.r_[start, len(h)])
    sig, sig2 = _parity(h, start)
    h1, h2 = np.add.reduceat(mix(h, 21), start), np.add.reduceat(mix(h, 22), start)
    enough = n >= least
    if not enough.any():
        return None
    place = np.arange(len(h)) - np.repeat(start, n)
    use = (place <= np.repeat(prefix_length(n, threshold), n)) & np.repeat(enough, n)
    size = np.add.reduceat(use.astype(np.int64), start)[enough]
    token = (h[use] & np.uint64(0xFFFFFFFC)).astype(np.uint32) | np.where(rank[use] > often, _IS_HOT, np.where(rank[use] == 0, _LONE, np.uint32(0)))
    keys = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(token.view(np.int32)))
    return number[start][enough], h1[enough].view(np.int64), h2[enough].view(np.int64), n[enough], sig[enough].view(np.int64), sig2[enough].view(np.int64), keys


def key_rows(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(key, d, sig, sig2, place, before) of each line and key.

    key is 32 bits of the key << 32 | number of words, place the line << 32 | what is left of it from the key on, before the word before the key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, line, n, sig, sig2 = (batch.column(k).to_numpy().astype(np.int64) for k in range(5))
            lists = batch.column(5)
            token = lists.flatten().to_numpy().view(np.uint32)
            size = np.diff(lists.offsets.to_numpy())
            at = np.r_[0, np.cumsum(size)]
            row = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(token)) - at[:-1][row]
            before = np.where(place > 0, np.r_[np.uint32(0), token[:-1]], np.uint32(0)).view(np.int32)
            inside = place < prefix_length(n, threshold)[row]
            one = np.flatnonzero(inside & (token & np.uint32(3) == 0))
            hot = np.flatnonzero(inside & (token & _IS_HOT != 0))
            # A hot word with each later one: lines that meet there first meet in that one next.
            more = at[1:][row[hot]] - hot - 1
            first = np.repeat(hot, more)
            second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(more) - more, more)
            some = token[second] & _LONE == 0
            first, second = first[some], second[some]
            r = np.r_[row[one], row[first]]
            both = mix(token[first].astype(np.uint64) << np.uint64(32) | token[second].astype(np.uint64), 9) >> np.uint64(32)
            key = np.r_[token[one].astype(np.uint64), both].astype(np.int64) << 32 | n[r]
            left = np.r_[n[row[one]] - place[one], n[row[first]] - place[second] + 1]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, d[r], sig[r], sig2[r], line[r] << 32 | left, before[np.r_[one, first]])], ["key", "d", "sig", "sig2", "place", "before"])

    return sets.select("d", "line", "n", "sig", "sig2", "keys").mapInArrow(run, "key bigint, d bigint, sig bigint, sig2 bigint, place bigint, before int")


def by_key(rows: DataFrame) -> DataFrame:
    """The rows of a key in one partition, in the order of their keys and numbers of words: one number, which Spark sorts by its bits."""
    return rows.repartition(F.shiftright("key", 32)).sortWithinPartitions("key")


def _groups(batches: Iterator[pa.RecordBatch], threshold: float, rows: int, size: int) -> Iterator[pa.Table]:
    """Parts of rows in the order of column 0, key << 32 | number of words, each with all pairs of numbers that can be similar.

    A group that goes on beyond a part is carried on by the rows that are long enough for the following ones.
    """
    pending: list[pa.RecordBatch] = []
    held = fresh = weight = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        pending.append(batch)
        held += batch.num_rows
        fresh += batch.num_rows
        weight += batch.nbytes
        if fresh >= rows or weight >= size:
            t = pa.Table.from_batches(pending).combine_chunks()
            code = t.column(0).to_numpy()
            cut = int(np.searchsorted(code, code[-1] >> 32 << 32))  # the last group may go on
            if cut:
                yield t.slice(0, cut).combine_chunks()
            else:
                yield t
                n = code & 0xFFFFFFFF
                cut = int(np.searchsorted(n, np.ceil(threshold * n[-1] - 1e-9)))
            t = t.slice(cut)
            pending, held, fresh, weight = t.to_batches(), t.num_rows, 0, 0
    if held:
        yield pa.Table.from_batches(pending).combine_chunks()


def _alike(n: np.ndarray, sig: np.ndarray, sig2: np.ndarray, p: np.ndarray, o: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the signatures of the rows p and o allow them to be similar."""
    apart = np.bitwise_count(sig[p] ^ sig[o]) + np.bitwise_count(sig2[p] ^ sig2[o])
    return apart <= (1 - threshold) / (1 + threshold) * (n[p] + n[o]) + 1e-9


def involved(keyed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(key, d, line): the rows, sorted by key, that are in a candidate pair; key without the number of words."""

    def marks(t: pa.Table) -> pa.RecordBatch:
        code, d, sig, sig2, place, prev = (t.column(k).to_numpy() for k in range(6))
        key, n, left = code >> 32, code & 0xFFFFFFFF, place & 0xFFFFFFFF
        sig, sig2 = sig.view(np.uint64), sig2.view(np.uint64)
        marked = np.zeros(len(key), bool)
        probe, step = np.arange(len(key)), 1
        while len(probe):
            probe = probe[probe >= step]
            other = probe - step
            on = (key[probe] == key[other]) & (n[other] >= threshold * n[probe] - 1e-9)
            probe, other = probe[on], other[on]
            new = ~(marked[probe] & marked[other])
            p, o = (probe, other) if new.all() else (probe[new], other[new])
            ok = (prev[p] != prev[o]) | (prev[p] == 0)
            p, o = p[ok], o[ok]
            ok = _alike(n, sig, sig2, p, o, threshold)
            p, o = p[ok], o[ok]
            ok = np.minimum(left[p], left[o]) >= threshold / (1 + threshold) * (n[p] + n[o]) - 1e-9
            marked[p[ok]] = marked[o[ok]] = True
            step += 1
        return pa.RecordBatch.from_arrays([pa.array(key[marked].astype(np.int32)), pa.array(d[marked]), pa.array((place[marked] >> 32).astype(np.int32))], ["key", "d", "line"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(marks, _groups(batches, threshold, JOIN_ROWS, 1 << 40))

    return keyed.mapInArrow(run, "key int, d bigint, line int")


def line_tokens(texts: DataFrame) -> DataFrame:
    """(key, d, rid, line, sig, sig2, words) of the lines that rows (d, rid, of, t, ...) name in ``of``, a list of (line, key); 48 bits a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, rid = (batch.column(k).to_numpy() for k in (0, 1))
            of = batch.column(2)
            buf, offsets = binary_column(batch.column(3))
            row = np.repeat(np.arange(len(d)), np.diff(of.offsets.to_numpy()))
            named = of.flatten()
            line, key = named.field(0).to_numpy(), named.field(1).to_numpy()
            lo, hi = int(offsets[0]), int(offsets[-1])
            breaks = np.r_[np.flatnonzero(buf[lo:hi] == 10) + lo, hi]
            before = np.searchsorted(breaks, offsets[:-1])
            n_lines = np.searchsorted(breaks[:-1], offsets[1:]) - before + 1
            real = line < n_lines[row]  # of one id with several texts a shorter one may lack the line
            row, line, key = row[real], line[real], key[real]
            place, at = np.unique(row.astype(np.int64) << 32 | line, return_inverse=True)
            r, k = place >> 32, place & 0xFFFFFFFF
            start = np.where(k == 0, offsets[r], breaks[np.maximum(before[r] + k - 1, 0)] + 1)
            end = np.minimum(breaks[before[r] + k], offsets[r + 1])
            bounds = np.r_[0, np.cumsum(end - start)]
            for a, b in slices(bounds):
                size = np.diff(bounds[a : b + 1])
                part = buf[np.repeat(start[a:b] - bounds[a:b], size) + np.arange(bounds[a], bounds[b])]
                _, _, h, ends = words(part, bounds[a : b + 1] - bounds[a])
                number = np.repeat(np.arange(b - a), np.diff(ends))
                order = np.lexsort((h, number))
                h, number = h[order], number[order]
                fresh = np.r_[True, (h[1:] != h[:-1]) | (number[1:] != number[:-1])] if len(h) else np.zeros(0, bool)
                h, number = h[fresh], number[fresh]
                n = np.bincount(number, minlength=b - a)
                cut = np.r_[0, np.cumsum(n)]
                sig, sig2 = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
                if len(h):
                    sig[n > 0], sig2[n > 0] = _parity(h, cut[:-1][n > 0])
                sets = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((6 * cut).astype(np.int32)), pa.py_buffer(h.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes())])
                mine = np.flatnonzero((at >= a) & (at < b))
                to = at[mine] - a
                keep = n[to] > 0
                mine, to = mine[keep], to[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (key[mine].astype(np.int64) << 32 | n[to], d[row[mine]], rid[row[mine]], line[mine], sig[to].view(np.int64), sig2[to].view(np.int64))] + [sets.take(pa.array(to))],
                    ["key", "d", "rid", "line", "sig", "sig2", "words"],
                )

    return texts.mapInArrow(run, "key bigint, d bigint, rid int, line int, sig bigint, sig2 bigint, words binary")


def similar_lines(dealt: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(d, rid, line): of rows of ``line_tokens`` sorted by key, the lines that an earlier one of their key is similar to."""

    def matched(t: pa.Table) -> pa.RecordBatch:
        code, d, rid, line, sig, sig2 = (t.column(k).to_numpy() for k in range(6))
        buf, offsets = binary_column(t.column(6).combine_chunks())
        token = np.zeros((len(buf) // 6, 8), np.uint8)
        token[:, 2:] = buf[: 6 * len(token)].reshape(-1, 6)
        token = token.view(np.uint64).ravel()
        at = offsets // 6
        key, n, sig, sig2 = code >> 32, code & 0xFFFFFFFF, sig.view(np.uint64), sig2.view(np.uint64)
        found = np.zeros(len(key), bool)

        def compare(p: np.ndarray, o: np.ndarray) -> None:
            """Marks the later ones of pairs of rows, of which p has no fewer words."""
            ok = _alike(n, sig, sig2, p, o, threshold)
            p, o = p[ok], o[ok]
            before = (d[p] < d[o]) | (d[p] == d[o]) & ((line[p] < line[o]) | (line[p] == line[o]) & (rid[p] < rid[o]))
            same = (d[p] == d[o]) & (line[p] == line[o]) & (rid[p] == rid[o])
            later = np.where(before, o, p)
            todo = ~found[later] & ~same
            p, o, later = p[todo], o[todo], later[todo]
            for k in range(0, len(p), 1 << 13):
                a, b = p[k : k + (1 << 13)], o[k : k + (1 << 13)]
                rows, pair = np.r_[a, b], np.r_[np.arange(len(a)), np.arange(len(a))]
                many = n[rows]
                where = np.repeat(at[rows] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(int(many.sum()))
                pair = np.repeat(pair, many)
                value = mix(token[where] + pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 5)
                order = np.argsort(value)
                twice = value[order[1:]] == value[order[:-1]]
                common = np.bincount(pair[order[1:][twice]], minlength=len(a))
                found[later[k : k + (1 << 13)][common >= threshold * (n[a] + n[b] - common) - 1e-9]] = True

        probe = np.arange(len(key))
        for step in range(1, _STEPS + 1):
            probe = probe[probe >= step]
            probe = probe[(key[probe] == key[probe - step]) & (n[probe - step] >= threshold * n[probe] - 1e-9)]
            if not len(probe):
                break
            compare(probe, probe - step)
        # Larger groups: those that are still open with all rows of their key that are not too short or long.
        if len(probe):
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            ends = np.r_[starts[1:], len(key)]
            group = np.searchsorted(starts, np.arange(len(key)), "right") - 1
            for i in np.flatnonzero(~found & ((ends - starts)[group] > _STEPS)).tolist():
                a, b = starts[group[i]], ends[group[i]]
                lo = a + np.searchsorted(n[a:b], np.ceil(threshold * n[i] - 1e-9))
                hi = a + np.searchsorted(n[a:b], np.floor(n[i] / threshold + 1e-9), "right")
                o = np.r_[np.arange(lo, max(lo, i - _STEPS)), np.arange(min(hi, i + _STEPS + 1), hi)]
                o = o[(d[o] < d[i]) | (d[o] == d[i]) & ((line[o] < line[i]) | (line[o] == line[i]) & (rid[o] < rid[i]))]
                for k in range(0, len(o), 256):
                    if found[i]:
                        break
                    compare(np.full(len(o[k : k + 256]), i), o[k : k + 256])
        return pa.RecordBatch.from_arrays([pa.array(d[found]), pa.array(rid[found]), pa.array(line[found].astype(np.int32))], ["d", "rid", "line"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(matched, _groups(batches, threshold, JOIN_ROWS, JOIN_BYTES))

    return dealt.mapInArrow(run, "d bigint, rid int, line int")


def removed_lines(rows: DataFrame, d: str, rid: str, body: str, threshold: float = THRESHOLD, least: int = LEAST_WORDS, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """The rows dealt by document (column ``d``; ``rid`` tells texts of one id apart), and (d, gone): the list of (rid, line) that go."""
    text = F.lower(F.coalesce(F.col(body), F.lit(""))).cast("binary")
    plain = rows.select(F.col(d).alias("d"), F.col(rid).alias("rid"), text.alias("t"))
    rarity = ranks(word_counts(plain.select("t")))
    # Equal sets: of the lines that a task holds one goes into the group, so a line in a third of all documents is met a few times a task.
    group, place = Window.partitionBy("h1", "h2").orderBy("d", "line", "rid"), F.struct("d", "line", "rid")
    sets = line_sets(plain, rarity, threshold, least, hot).withColumns({"own": F.row_number().over(group), "first": F.first(place).over(group)})
    sets = sets.where((F.col("own") == 1) | (place != F.col("first"))).withColumn("gone", F.col("again") | (F.col("own") > 1))
    sets = written(sets.select("d", "line", "rid", "gone", "n", "sig", "sig2", F.when(~F.col("gone"), F.col("keys")).alias("keys")))
    keyed = by_key(key_rows(sets.where("not gone"), threshold))
    of = unused(rows, "of")
    near = written(involved(keyed, threshold).groupBy(F.col("d").alias(of)).agg(F.collect_set(F.struct("line", "key")).alias("keys")))
    # All columns are read here as well, so that one shuffle of the texts serves this join and that of the result.
    dealt = rows.repartition(d)
    others = [F.col(f"`{c}`") for c in rows.columns if c not in (d, rid, body)]
    texts = dealt.join(near.select(of, F.col("keys").alias(of + "_keys")).hint("shuffle_hash"), F.col(d) == F.col(of)).select(F.col(d).alias("d"), F.col(rid).alias("rid"), F.col(of + "_keys").alias("of"), text.alias("t"), F.struct(*others).alias("others"))
    found = similar_lines(by_key(line_tokens(texts)), threshold)
    gone = sets.where("gone").select("d", "rid", "line").union(found)
    return dealt, gone.groupBy("d").agg(F.collect_set(F.struct("rid", "line")).alias("gone"))


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, least: int = LEAST_WORDS, to: str = "kept_text", hot: int = HOT) -> DataFrame:
    """Adds n_lines (with a word), n_removed and the text of the lines that stay."""
    body = F.coalesce(F.col(text), F.lit(""))
    d, rid, of, gone = (unused(df, c) for c in ("d", "rid", "doc", "gone"))
    # Two hashes of 32 bits tell rows without an id apart.
    place = F.coalesce(F.col(key).cast("bigint"), F.lit(2**63 - 2**32) + F.shiftrightunsigned(F.xxhash64(body), 32))
    dealt, removed = removed_lines(df.withColumns({d: place, rid: F.hash(body)}), d, rid, text, threshold, least, hot)
    joined = dealt.join(removed.select(F.col("d").alias(of), F.col("gone").alias(gone)).hint("shuffle_hash"), F.col(d) == F.col(of), "left")
    own = F.transform(F.filter(gone, lambda x: x["rid"] == F.col(rid)), lambda x: x["line"])
    lines, numbers = F.split(body, "\n"), F.col(gone)
    stay = F.filter(lines, lambda x, i: ~F.array_contains(numbers, i))
    added = {
        "n_lines": F.size(F.filter(lines, lambda x: x.rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"))).cast("long"),
        "n_removed": F.coalesce(F.size(gone), F.lit(0)).cast("long"),
        to: F.when(F.coalesce(F.size(gone), F.lit(0)) == 0, body).otherwise(F.array_join(stay, "\n")),
    }
    joined = joined.withColumn(gone, F.when(F.col(gone).isNotNull(), own)).withColumns(added)
    return joined.select(*[f"`{c}`" for c in df.columns if c not in added], *added)
