"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct pre-tokens of a batch that were not met before lie end to end in one array
of symbols, with a link to the next symbol.  The index maps each adjacent pair to all
its positions.  Merge ranks are taken in ascending order; a rank's merge is applied at
all its positions at once (left to right where they overlap), and the lists of the pairs
to the left and right of each merge are updated.  A merge only makes pairs of a later
rank, as a vocabulary's merges are learnt in that order, so one ascending pass over the
active ranks is exact.

Null texts count as empty and give no ids; the whole text is encoded.  Rows are
independent of each other: repeated rows repeat their ids, extra columns are passed on.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The split before the merges; a fixed value of the vocabulary's format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept with their ids from batch to batch in a Python worker; beyond it the store starts anew.
STORE_WORDS = 200_000


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class PairIndexBpe:
    """A vocabulary file, and the merges by pair of ids."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, chars = spec["model"], byte_characters()
        self.vocab: dict[str, int] = model["vocab"]
        size = max([*self.vocab.values(), *(a["id"] for a in spec["added_tokens"])]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in self.vocab.items():
            self.bytes_of[i] = bytes(chars[c] for c in token)
        self.byte_id = np.zeros(256, np.int64)
        for c, b in chars.items():
            self.byte_id[b] = self.vocab[c]
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.size = size
        #: (left id * size + right id) of each merge in ascending order, with its rank and result.
        pairs, out = [], []
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            pairs.append(self.vocab[a] * size + self.vocab[b])
            out.append(self.vocab[a + b])
        pairs_ = np.array(pairs, np.int64)
        order = np.argsort(pairs_, kind="stable")
        self.pairs, self.ranks, self.result = pairs_[order], order.astype(np.int64), np.array(out, np.int64)
        self.split = regex.compile(PATTERN).findall
        self.loose = regex.compile(r" (?:\s|\Z)").search
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.store: dict[str, bytes] = {}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], -1)

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        symbol = self.byte_id[data]
        word = np.repeat(np.arange(len(words)), lengths)
        nxt, prev = np.arange(1, n + 1), np.arange(-1, n - 1)
        bounds = np.cumsum(lengths)[:-1]
        nxt[bounds[bounds > 0] - 1] = n
        prev[bounds[bounds < n]] = -1
        nxt[-1:] = n
        alive = np.ones(n + 1, bool)
        alive[n] = False
        merged = np.zeros(n, bool)
        lists: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(positions: np.ndarray) -> None:
            """Adds the pairs that begin at these positions to the index."""
            positions = positions[nxt[positions] < n]
            if not len(positions):
                return
            rank = self.rank_of(symbol[positions], symbol[nxt[positions]])
            found = rank >= 0
            positions, rank = positions[found], rank[found]
            if not len(rank):
                return
            order = np.argsort(rank, kind="stable")
            positions, rank = positions[order], rank[order]
            firsts = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
            cuts = [*firsts.tolist(), len(rank)]
            for k, r in enumerate(rank[firsts].tolist()):
                if r not in lists:
                    lists[r] = []
                    heapq.heappush(heap, r)
                lists[r].append(positions[cuts[k] : cuts[k + 1]])

        enter(np.arange(n))
        pair_left, pair_right = np.empty(len(self.pairs), np.int64), np.empty(len(self.pairs), np.int64)
        pair_left[self.ranks], pair_right[self.ranks] = self.pairs // self.size, self.pairs % self.size
        while heap:
            r = heapq.heappop(heap)
            at = lists.pop(r)
            if len(at) > 1:
                at = np.sort(np.concatenate(at))
                at = at[np.r_[True, at[1:] != at[:-1]]]
            else:
                at = np.sort(at[0])
            at = at[alive[at]]
            right = nxt[at]
            ok = right < n
            at, right = at[ok], right[ok]
            ok = (symbol[at] == pair_left[r]) & (symbol[right] == pair_right[r])
            at, right = at[ok], right[ok]
            if not len(at):
                continue
            if pair_left[r] == pair_right[r] and len(at) > 1:  # runs such as aaa: every second pair of a run
                joined = np.r_[False, at[1:] == right[:-1]]
                run = np.flatnonzero(~joined)
                place = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
                at, right = at[place % 2 == 0], right[place % 2 == 0]
            symbol[at] = self.result[r]
            alive[right] = False
            after = nxt[right]
            nxt[at] = after
            inner = after < n
            prev[after[inner]] = at[inner]
            before = prev[at]
            before = before[before >= 0]
            merged[at] = True
            before = before[~merged[before]]
            merged[at] = False
            enter(np.concatenate([at, before]))
        left = np.flatnonzero(alive[:n])
        cuts = (4 * np.searchsorted(word[left], np.arange(len(words) + 1))).tolist()
        raw = symbol[left].astype("<u4").tobytes()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def chunks(self, text: str) -> list[str | int]:
        """Parts of the text that can be encoded one by one, and the ids of special tokens.

        A space between a text and a character that is no white space begins a pre-token,
        so a text without other spaces may be cut at each of them.
        """
        if self.cut is not None and any(s in text for s in self.special):
            out: list[str | int] = []
            for part in self.cut(text):
                if part in self.special:
                    out.append(self.special[part])
                elif part:
                    out += self.split(part)
            return out
        if self.loose(text):
            return self.split(text)
        head, *rest = text.split(" ")
        return [head, *[" " + w for w in rest]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.chunks(t) for t in texts]
        if len(self.store) > STORE_WORDS:
            self.store.clear()
        store = self.store
        new = set().union(*split).difference(store)
        chunks = {w: self.split(w) for w in new if isinstance(w, str)}
        for w in new:
            if isinstance(w, int):
                store[w] = np.uint32(w).astype("<u4").tobytes()
        if chunks:
            words = list(set().union(*chunks.values()))
            ids = dict(zip(words, self.merge_all([w.encode() for w in words]), strict=True))
            for w, parts in chunks.items():
                store[w] = ids[parts[0]] if len(parts) == 1 else b"".join([ids[p] for p in parts])
        return [b"".join([store[w] for w in p]) for p in split]

    def decode(self, ids: bytes) -> bytes:
        """The text of ids, as UTF-8; bytes that are no text become U+FFFD."""
        table = self.bytes_of
        raw = b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return raw.decode("utf-8", "replace").encode()


_LOADED: dict[str, PairIndexBpe] = {}


def load(path: str) -> PairIndexBpe:
    """One vocabulary a Python worker."""
    if path not in _LOADED:
        _LOADED[path] = PairIndexBpe(path)
    return _LOADED[path]


def _batches(column: pa.Array, limit: int = 1 << 22) -> Iterator[list[str]]:
    part, size = [], 0
    for t in column:
        t = t.as_py() or ""
        part.append(t)
        size += len(t)
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(df: DataFrame, path: str, text: str = "text", to: str = "ids", decoded: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds the token ids of each whole text, as little-endian unsigned 32-bit integers in one binary.

    decoded: also adds the text of the ids under this name, in the same Python worker.
    keep: the columns to pass on, if not all.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in (to, decoded)]
    added = [T.StructField(to, T.BinaryType()), *([T.StructField(decoded, T.StringType())] if decoded else [])]
    schema = T.StructType([*[df.schema[c] for c in keep], *added])
    source = df.select(*keep, df[text].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        bpe.store.clear()  # the words of another task
        for batch in batches:
            at = 0
            for texts in _batches(batch.column(len(keep))):
                ids = bpe.encode(texts)
                new = [pa.array(ids, pa.binary())]
                if decoded:
                    new.append(pa.array([bpe.decode(i) for i in ids], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(texts)).columns[: len(keep)], *new], schema.names)
                at += len(texts)
        bpe.store.clear()

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the text of the ids, special tokens included; null ids give an empty text."""
    df = df.drop(to)
    schema = T.StructType([*df.schema.fields, T.StructField(to, T.StringType())])
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            column, at = batch.column(names.index(ids)), 0
            while at < len(column):
                n, size = 0, 0
                out = []
                while at + n < len(column) and size < 1 << 24:
                    raw = bpe.decode(column[at + n].as_py() or b"")
                    out.append(raw.decode())
                    size += len(raw)
                    n += 1
                part = batch.slice(at, n)
                at += n
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], [*part.schema.names, to])

    return df.mapInArrow(run, schema)


def token_count(ids: str = "ids"):
    """The number of ids in the binary column."""
    return (F.octet_length(F.coalesce(F.col(ids), F.lit(b""))) / 4).cast("long")
