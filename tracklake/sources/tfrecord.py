"""Files of framed tf.train.Example records as a Spark data source, read in splits and written.

A record is its length (8 bytes), a masked CRC32C of these, the payload and a masked CRC32C
of it.  A split begins at any byte: it looks for the first place whose 8 bytes fit the
checksum behind them, checks that such places follow each other from there to its end (else
the headers from the file's beginning decide), and reads all records that begin before its
end.  So one file is read by many tasks without an index.  A record that fails is a row with
its error; the next ones follow.  Behind a broken header, reading goes on at the next header
that another one follows.  Small records are read, checked and coded many at a time, and go
from and to Spark as Arrow batches.

    spark.dataSource.register(TfRecords)
    spark.read.format("tfrecord").option("splitBytes", "67108864").load(path)
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tracklake.sources import ranges

FEATURES = "map<string, struct<bytes: array<binary>, floats: array<float>, ints: array<bigint>>>"
SCHEMA = f"path string, offset bigint, length bigint, features {FEATURES}, error string"
#: Reflected polynomial of CRC32C, and the constant of the format's mask: fixed values.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
HEAD, TAIL = 12, 4
#: A table's tasks, unless they would hold too much.
TASKS = 128
#: Bytes that are read for the headers in them, and for small records; rows and bytes of payloads of a batch.
GLANCE, WINDOW = 1 << 14, 1 << 20
BATCH_ROWS, BATCH_BYTES = 4096, 1 << 23


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


_T = _table()


def _step(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return _T[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))


def _apply(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The linear map with these images of the 32 bits."""
    out = np.zeros_like(x)
    for k in range(32):
        out ^= np.where((x >> np.uint32(k)) & 1, columns[k], np.uint32(0))
    return out


def _shifts(count: int) -> list[np.ndarray]:
    """Maps of a state over 2^k zero bytes, each as tables of its four bytes."""
    columns = _step(np.uint32(1) << np.arange(32, dtype=np.uint32), np.zeros(32, np.uint32))
    byte, out = np.arange(256, dtype=np.uint32), []
    while len(out) < count:
        out.append(np.stack([_apply(columns, byte << np.uint32(8 * k)) for k in range(4)]))
        columns = _apply(columns, columns)
    return out


_SHIFTS = _shifts(40)
_LIST = _T.tolist()
#: Below so many bytes a plain loop is faster.
SHORT = 4096


def _shifted(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16 & 255] ^ tables[3][x >> 24]


def crc32c(data: bytes) -> int:
    """Many lanes of one length advance together and are joined in pairs; zeros before the data do not count."""
    n = len(data)
    if n < SHORT:
        state = 0xFFFFFFFF
        for b in data:
            state = _LIST[(state ^ b) & 255] ^ (state >> 8)
        return state ^ 0xFFFFFFFF
    step = min(10, max(3, (n.bit_length() - 1) // 2))
    lanes = 1 << max(0, (n - 1).bit_length() - step)
    padded = np.zeros(lanes << step, np.uint8)
    padded[-n:] = np.frombuffer(data, np.uint8)
    padded[len(padded) - n : len(padded) - n + 4] ^= 255  # the state that a CRC begins with
    state = np.zeros(lanes, np.uint32)
    for column in np.ascontiguousarray(padded.reshape(lanes, -1).T):
        state = _step(state, column)
    while len(state) > 1:
        state = _shifted(_SHIFTS[step], state[0::2]) ^ state[1::2]
        step += 1
    return int(state[0]) ^ 0xFFFFFFFF


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def masked_crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Masked checksums of many pieces of a buffer: the short ones advance together, the longest first."""
    crc = np.zeros(len(starts), np.uint32)
    for k in np.flatnonzero(lengths >= SHORT):
        crc[k] = crc32c(data[starts[k] : starts[k] + lengths[k]].tobytes())
    short = np.flatnonzero(lengths < SHORT)
    order = short[np.argsort(-lengths[short], kind="stable")]
    at, state = starts[order], np.full(len(order), 0xFFFFFFFF, np.uint32)
    longest = int(lengths[order[0]]) if len(order) else 0
    live = len(order) - np.searchsorted(lengths[order][::-1], np.arange(longest), side="right")
    for k, n in enumerate(live.tolist()):
        state[:n] = _step(state[:n], data[at[:n] + k])
    crc[order] = state ^ np.uint32(0xFFFFFFFF)
    return _masked(crc)


def _masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)


def _stored(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The checksums that stand at these places."""
    return sum((data[at + k].astype(np.uint32) << np.uint32(8 * k) for k in range(4)), np.zeros(len(at), np.uint32))


def _heads(buf: bytes, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the records whose headers follow each other from the front of a buffer, up to ``most``; the last may end behind it."""
    starts, ends, at, length = [], [], 0, struct.Struct("<Q").unpack_from
    while at < most and at + HEAD <= len(buf):
        starts.append(at)
        at = min(at + HEAD + length(buf, at)[0] + TAIL, 1 << 62)
        ends.append(at)
    s, e, data = np.array(starts, np.int64), np.array(ends, np.int64), np.frombuffer(buf, np.uint8)
    wrong = np.flatnonzero(masked_crcs(data, s, np.full(len(s), 8)) != _stored(data, s + 8))
    return (s[: wrong[0]], e[: wrong[0]]) if len(wrong) else (s, e)


def _places(buf: np.ndarray) -> np.ndarray:
    """Places whose 8 bytes fit the masked checksum behind them."""
    n = len(buf) - HEAD + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    state = np.full(n, 0xFFFFFFFF, np.uint32)
    for k in range(8):
        state = _step(state, buf[k : k + n])
    state ^= np.uint32(0xFFFFFFFF)
    want = ((state >> np.uint32(15)) | (state << np.uint32(17))) + np.uint32(MASK)
    have = np.zeros(n, np.uint32)
    for k in range(4):
        have |= buf[8 + k : 8 + k + n].astype(np.uint32) << np.uint32(8 * k)
    return np.flatnonzero(want == have)


def _length(head: bytes) -> int | None:
    """The payload's length, or None if the header does not fit its checksum."""
    if len(head) < HEAD or struct.unpack("<I", head[8:12])[0] != masked(crc32c(head[:8])):
        return None
    return struct.unpack("<Q", head[:8])[0]


def _after(f, at: int) -> int | None:
    """Where the record at a place ends, if a header is there."""
    length = _length(ranges.at(f, at, HEAD))
    return None if length is None else at + HEAD + length + TAIL


def _candidates(f, start: int, end: int, window: int = 1 << 20) -> Iterator[int]:
    for a in range(start, end, window):
        buf = np.frombuffer(ranges.at(f, a, min(window, end - a) + HEAD - 1), np.uint8)
        yield from (_places(buf) + a).tolist()


def _resumed(f, start: int, end: int, size: int) -> int | None:
    """Behind a broken header, whose length is lost: the first header that another one or the end of the file follows."""
    for p in _candidates(f, start, end):
        after = _after(f, p)
        if after == size or (after < size and _after(f, after) is not None):
            return p
    return None


def _holds(f, at: int, end: int, size: int) -> bool:
    """Whether headers follow each other from a place to the end of a split."""
    while at < min(end, size):
        _, ends = _heads(ranges.at(f, at, GLANCE), min(end, size) - at)
        if not len(ends) or at + ends[-1] > size:
            return False
        at += int(ends[-1])
    return at == size or _after(f, at) is not None


def _walked(f, start: int, end: int, size: int) -> int | None:
    """The first record of a split by the headers from the file's beginning; a broken one belongs to the split before."""
    at: int | None = 0
    while at is not None and at < end:
        after = _after(f, at)
        if after is not None and after <= size:
            if at >= start:
                return at
            at = after
        else:
            at = _resumed(f, at + 1, end, size)
    return None


def synced(f, start: int, end: int, size: int) -> int | None:
    """The first place in [start, end) where a record begins.

    If headers do not follow each other from the first place that looks like one to the end
    of the split, it may be a piece of a payload, and the headers before decide.
    """
    for p in _candidates(f, start, end):
        return p if _holds(f, p, end, size) else _walked(f, start, end, size)
    return None


def _run(f, at: int, end: int, size: int, verify: bool) -> tuple[list[tuple[int, int, bytes | None, str | None]], int]:
    """The records of a window that lie in it whole, up to the first broken header, and where they end."""
    buf = ranges.at(f, at, min(WINDOW, size - at))
    starts, ends = _heads(buf, end - at)
    whole = int(np.searchsorted(ends, len(buf), side="right"))
    if not whole:
        return [], at
    starts, ends, data = starts[:whole], ends[:whole], np.frombuffer(buf, np.uint8)
    lengths = ends - starts - HEAD - TAIL
    right = masked_crcs(data, starts + HEAD, lengths) == _stored(data, ends - TAIL) if verify else np.ones(whole, bool)
    rows = zip(starts.tolist(), lengths.tolist(), right.tolist(), strict=True)
    out = [(at + s, n, buf[s + HEAD : s + HEAD + n], None) if ok else (at + s, n, None, "payload does not fit its checksum") for s, n, ok in rows]
    return out, at + int(ends[-1])


def records(f, start: int, end: int, size: int, verify: bool = True) -> Iterator[tuple[int, int, bytes | None, str | None]]:
    """(offset, length, payload, error) of the records that begin in [start, end).

    A broken header behind the last of them, which no other split can tell from a payload,
    is reported here too.
    """
    at = synced(f, start, end, size) if start else 0
    while at is not None and at < size:
        length = _length(ranges.at(f, at, HEAD))
        if length is not None and length < WINDOW // 4 and at < end:
            run, after = _run(f, at, end, size, verify)
            if run:
                yield from run
                at = after
                continue
        if length is None:
            yield at, 0, None, "header does not fit its checksum"
            at = _resumed(f, at + 1, end, size) if at < end else None
            continue
        if at >= end:
            return
        if at + HEAD + length + TAIL > size:
            yield at, length, None, "record ends behind the file"
            at = _resumed(f, at + 1, end, size)
            continue
        payload = ranges.at(f, at + HEAD, length)
        if verify and struct.unpack("<I", ranges.at(f, at + HEAD + length, TAIL))[0] != masked(crc32c(payload)):
            yield at, length, None, "payload does not fit its checksum"
        else:
            yield at, length, payload, None
        at += HEAD + length + TAIL


# ---- the message of a record ---------------------------------------------------------------


def _varint(b: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        out |= (b[at] & 127) << shift
        at += 1
        if b[at - 1] < 128:
            return out, at
        shift += 7


def _fields(b: bytes) -> list[tuple[int, int | bytes]]:
    """(number, value) of a message: bytes of what has a length or a fixed width."""
    out, at, size = [], 0, len(b)
    while at < size:
        tag, at = (b[at], at + 1) if b[at] < 128 else _varint(b, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(b, at)
        else:
            if kind == 2:
                n, at = (b[at], at + 1) if b[at] < 128 else _varint(b, at)
            else:
                n = {1: 8, 5: 4}.get(kind)
            if n is None or at + n > size:
                raise ValueError(f"field {tag >> 3} of kind {kind} at {at}")
            value, at = b[at : at + n], at + n
        out.append((tag >> 3, value))
    return out


def _ints(b: bytes) -> list[int]:
    """Signed integers of packed varints."""
    out, at = [], 0
    while at < len(b):
        v, at = _varint(b, at)
        out.append(v - (1 << 64) if v >> 63 else v)
    return out


def parsed(payload: bytes) -> dict[str, tuple]:
    """The features of an Example by name: (bytes, floats, ints), the other two null."""
    out: dict[str, tuple] = {}
    for number, features in _fields(payload):
        for inner, entry in _fields(features) if number == 1 else ():
            if inner != 1:
                continue
            parts = dict(_fields(entry))
            value: tuple = (None, None, None)
            for kind, body in _fields(parts.get(2, b"")):
                got = [v for k, v in _fields(body) if k == 1]
                if kind == 1:
                    value = (got, None, None)
                elif kind == 2:
                    value = (None, np.frombuffer(b"".join(got), "<f4").tolist(), None)
                elif kind == 3:
                    value = (None, None, [i for v in got for i in (_ints(v) if isinstance(v, bytes) else _ints(_coded(v)))])
            out[parts.get(1, b"").decode()] = value
    return out


def _coded(v: int) -> bytes:
    out = bytearray()
    v &= (1 << 64) - 1
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    return bytes([*out, v])


def _field(number: int, body: bytes) -> bytes:
    return _coded(number << 3 | 2) + _coded(len(body)) + body


def message(features: dict[str, tuple]) -> bytes:
    """The Example of features (bytes, floats, ints) by name, in the order of the names."""
    out = []
    for name in sorted(features):
        texts, floats, ints = features[name]
        if texts is not None:
            value = _field(1, b"".join(_field(1, bytes(t)) for t in texts))
        elif floats is not None:
            value = _field(2, _field(1, np.array(floats, "<f4").tobytes()))
        else:
            value = _field(3, _field(1, b"".join(_coded(i) for i in ints or [])))
        out.append(_field(1, _field(1, name.encode()) + _field(2, value)))
    return _field(1, b"".join(out))


@lru_cache(1 << 16)
def _start(number: int, length: int) -> bytes:
    return _coded(number << 3 | 2) + _coded(length)


def messages(features: pa.MapArray) -> Iterator[bytes]:
    """The Example of each row of features, as ``message`` gives it; their bytes are not copied before."""
    items, names, ends = features.items, features.keys.to_pylist(), features.offsets.to_pylist()
    lists = [items.field(k) for k in ("bytes", "floats", "ints")]
    if features.null_count or items.null_count or lists[0].values.null_count or lists[2].values.null_count:
        raise ValueError("features, and the bytes and integers in them, cannot be null")
    have = [c.is_valid().to_pylist() for c in lists]
    cuts = [c.offsets.to_pylist() for c in lists]
    texts = lists[0].values.cast(pa.large_binary())
    places = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1].tolist() if len(texts) else [0]
    data = memoryview(texts.buffers()[2] or b"")
    floats, ints = (c.values.to_numpy(zero_copy_only=False) for c in lists[1:])
    for first, last in pairwise(ends):
        out = []
        for j in sorted(range(first, last), key=names.__getitem__):
            if have[0][j]:
                own = places[cuts[0][j] : cuts[0][j + 1] + 1]
                kind, body = 1, b"".join([x for a, b in pairwise(own) for x in (_start(1, b - a), data[a:b])])
            elif have[1][j]:
                kind, body = 2, _field(1, floats[cuts[1][j] : cuts[1][j + 1]].astype("<f4").tobytes())
            else:
                own = ints[cuts[2][j] : cuts[2][j + 1]].tolist() if have[2][j] else []
                kind, body = 3, _field(1, b"".join(map(_coded, own)))
            name = names[j].encode()
            value = len(_start(kind, len(body))) + len(body)
            head = _start(1, len(name)) + name + _start(2, value) + _start(kind, len(body))
            out += [_start(1, len(head) + len(body)), head, body]
        yield b"".join([_start(1, sum(map(len, out))), *out])


def framed_all(payloads: list[bytes]) -> bytes:
    """The records of payloads one after the other."""
    lengths = np.array([len(p) for p in payloads], np.int64)
    data = np.frombuffer(b"".join(payloads), np.uint8)
    tails = masked_crcs(data, np.cumsum(lengths) - lengths, lengths).astype("<u4").tobytes()
    sizes = np.frombuffer(lengths.astype("<u8").tobytes(), np.uint8)
    marks = masked_crcs(sizes, 8 * np.arange(len(lengths)), np.full(len(lengths), 8)).astype("<u4").tobytes()
    numbers = sizes.tobytes()
    return b"".join([x for k, p in enumerate(payloads) for x in (numbers[8 * k : 8 * k + 8], marks[4 * k : 4 * k + 4], p, tails[4 * k : 4 * k + 4])])


def framed(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked(crc32c(head))) + payload + struct.pack("<I", masked(crc32c(payload)))


# ---- the data source ---------------------------------------------------------------------------


VALUE = pa.struct([("bytes", pa.list_(pa.binary())), ("floats", pa.list_(pa.float32())), ("ints", pa.list_(pa.int64()))])
ARROW = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("features", pa.map_(pa.string(), VALUE)), ("error", pa.string())])


def batch_of(rows: list[tuple[str, int, int, dict[str, tuple] | None, str | None]]) -> pa.RecordBatch:
    """Rows of (path, offset, length, features, error)."""
    paths, places, lengths, features, errors = zip(*rows, strict=True)
    flat = [(k, *v) for f in features for k, v in (f or {}).items()]
    names, *values = zip(*flat, strict=True) if flat else ((), (), (), ())
    ends = [0]
    for f in features:
        ends.append(ends[-1] + len(f or {}))
    starts = [None if f is None else a for f, a in zip(features, ends, strict=False)]
    items = pa.StructArray.from_arrays([pa.array(v, t.type) for v, t in zip(values, VALUE, strict=True)], fields=list(VALUE))
    maps = pa.MapArray.from_arrays(pa.array([*starts, ends[-1]], pa.int32()), pa.array(names, pa.string()), items)
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(places, pa.int64()), pa.array(lengths, pa.int64()), maps, pa.array(errors, pa.string())], schema=ARROW)


@dataclass
class Split:
    path: str
    start: int
    end: int
    size: int

class Splits(InputPartition):
    """Splits that one task reads."""

    def __init__(self, splits: list[Split]):
        self.splits = splits


class TfRecordReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.pattern = options["path"], options.get("pathglobfilter", "*.tfrecord*")
        self.limit, self.verify = int(options.get("splitbytes", 1 << 26)), options.get("verify", "true") == "true"

    def partitions(self) -> list[Splits]:
        """Few splits have a task each, so that all cores work; more share ``TASKS`` of them, or as many as hold ``TASK_BYTES`` each."""
        found = [Split(p, a, b, size) for p, size in ranges.listed(self.path, self.pattern) for a, b in ranges.cuts(size, self.limit)]
        per = max(1, min(-(-len(found) // TASKS), ranges.TASK_BYTES // self.limit))
        return [Splits(found[k : k + per]) for k in range(0, len(found), per)] or [Splits([])]

    def read(self, partition: Splits) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for split in partition.splits:
            for row in self._rows(split):
                rows.append(row)
                held += row[2] if row[3] is not None else 0
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield batch_of(rows)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows)

    def _rows(self, split: Split) -> Iterator[tuple]:
        with ranges.opened(split.path) as f:
            for offset, length, payload, error in records(f, split.start, split.end, split.size, self.verify):
                features = None
                if payload is not None:
                    try:
                        features = parsed(payload)
                    except (ValueError, IndexError, TypeError, UnicodeDecodeError) as e:
                        error = f"{type(e).__name__}: {e}"
                yield split.path, offset, length, features, error


@dataclass
class Written(WriterCommitMessage):
    name: str


class TfRecordWriter(DataSourceArrowWriter):
    """One file a task under a name of its attempt; those that are committed get their place in the split."""

    def __init__(self, options: dict[str, str]):
        self.path, self.prefix, self.split = options["path"], options.get("prefix", "data"), options.get("split", "train")

    def write(self, iterator: Iterator) -> Written:
        fs, inner = ranges.store(self.path)
        fs.create_dir(inner)
        name = f"_attempt-{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{inner}/{name}") as out:
            for batch in iterator:
                payloads, held = [], 0
                for payload in messages(batch.column("features")):
                    payloads.append(payload)
                    held += len(payload)
                    if held >= BATCH_BYTES:
                        out.write(framed_all(payloads))
                        payloads, held = [], 0
                if payloads:
                    out.write(framed_all(payloads))
        return Written(name)

    def commit(self, messages: list) -> None:
        fs, inner = ranges.store(self.path)
        done = [m for m in messages if m is not None]
        for k, m in enumerate(done):
            fs.move(f"{inner}/{m.name}", f"{inner}/{self.prefix}-{self.split}.tfrecord-{k:05d}-of-{len(done):05d}")

    def abort(self, messages: list) -> None:
        fs, inner = ranges.store(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{inner}/{m.name}")


class TfRecords(DataSource):
    """Reads ``SCHEMA``; writes the column ``features`` to files of the options prefix and split."""

    @classmethod
    def name(cls) -> str:
        return "tfrecord"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TfRecordReader:
        return TfRecordReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> TfRecordWriter:
        return TfRecordWriter({k.lower(): v for k, v in self.options.items()})
