"""Hierarchical array files read by ranges: groups, attributes, contiguous and chunked arrays of numbers.

Covers what the robot corpora use: superblock versions 0 and 1, symbol-table groups, object
headers of version 1, whole numbers, floats, texts (also of variable length), and the
deflate, shuffle and checksum filters.  Anything else is an error in the row, and the other
objects and files go on.  Arrays are read a slab of rows at a time, so one array may be larger than
a task's memory.
"""

from __future__ import annotations

import fnmatch
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.sources import ranges

SIGNATURE = b"\x89HDF\r\n\x1a\n"
NOWHERE = 0xFFFFFFFFFFFFFFFF
SLAB_BYTES = 1 << 24


def _u(b: bytes, at: int, n: int) -> int:
    return int.from_bytes(b[at : at + n], "little")


@dataclass
class Kind:
    """A type: numpy's, or a text of variable length (``dtype`` None)."""

    size: int
    dtype: np.dtype | None


def _kind(b: bytes) -> Kind:
    cls, bits, size = b[0] & 15, b[1], _u(b, 4, 4)
    order = ">" if bits & 1 else "<"
    if cls == 0:
        return Kind(size, np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}"))
    if cls == 1:
        return Kind(size, np.dtype(f"{order}f{size}"))
    if cls == 3:
        return Kind(size, np.dtype(f"S{size}"))
    if cls == 8:  # an enumeration is its numbers
        return _kind(b[8:])
    if cls == 9 and bits & 15 == 1:
        return Kind(size, None)
    raise ValueError(f"type of class {cls}")


def _shape(b: bytes) -> tuple[int, ...]:
    at = 8 if b[0] == 1 else 4
    return tuple(_u(b, at + 8 * k, 8) for k in range(b[1]))


@dataclass
class Node:
    """An object: a group has links, an array a shape."""

    links: dict[str, int] | None = None
    shape: tuple[int, ...] | None = None
    kind: Kind | None = None
    layout: bytes = b""
    filters: list[tuple[int, list[int]]] = field(default_factory=list)
    attributes: dict[str, object] = field(default_factory=dict)


class File:
    def __init__(self, f):
        self.f = f
        head = ranges.at(f, 0, 96)
        if head[:8] != SIGNATURE or head[8] > 1:
            raise ValueError("no file of superblock version 0 or 1")
        if head[13] != 8 or head[14] != 8:
            raise ValueError("addresses of other than 8 bytes")
        at = 24 + 4 * (head[8] == 1)
        self.base = _u(head, at, 8)
        self.root = _u(head, at + 32 + 8, 8)

    def at(self, address: int, n: int) -> bytes:
        out = ranges.at(self.f, self.base + address, n)
        if len(out) < n:
            raise ValueError(f"{n} bytes at {address} end behind the file")
        return out

    def messages(self, address: int) -> Iterator[tuple[int, bytes]]:
        head = self.at(address, 16)
        if head[0] != 1:
            raise ValueError(f"object header of version {head[0]}")
        left, blocks = _u(head, 2, 2), [(address + 16, _u(head, 8, 4))]
        while blocks and left:
            b = self.at(*blocks.pop(0))
            at = 0
            while at + 8 <= len(b) and left:
                kind, n = _u(b, at, 2), _u(b, at + 2, 2)
                body = b[at + 8 : at + 8 + n]
                if kind == 0x10:
                    blocks.append((_u(body, 0, 8), _u(body, 8, 8)))
                yield kind, body
                at, left = at + 8 + n, left - 1

    def node(self, address: int) -> Node:
        out = Node()
        for kind, b in self.messages(address):
            if kind == 0x11:
                out.links = dict(self._links(_u(b, 0, 8), self._heap(_u(b, 8, 8))))
            elif kind == 0x01:
                out.shape = _shape(b)
            elif kind == 0x03:
                out.kind = _kind(b)
            elif kind == 0x08:
                if b[0] != 3:
                    raise ValueError(f"layout of version {b[0]}")
                out.layout = b[1:]
            elif kind == 0x0B:
                out.filters = self._filters(b)
            elif kind == 0x0C:
                name, value = self._attribute(b)
                out.attributes[name] = value
        return out

    def _heap(self, address: int) -> bytes:
        b = self.at(address, 32)
        return self.at(_u(b, 24, 8), _u(b, 8, 8))

    def _links(self, tree: int, heap: bytes) -> Iterator[tuple[str, int]]:
        head = self.at(tree, 24)
        n = _u(head, 6, 2)
        b = self.at(tree + 24, 16 * n + 8)
        for k in range(n):
            child = _u(b, 8 + 16 * k, 8)
            if head[5]:
                yield from self._links(child, heap)
            else:
                count = _u(self.at(child, 8), 6, 2)
                s = self.at(child + 8, 40 * count)
                for i in range(count):
                    name = _u(s, 40 * i, 8)
                    yield heap[name : heap.index(b"\0", name)].decode(), _u(s, 40 * i + 8, 8)

    @staticmethod
    def _filters(b: bytes) -> list[tuple[int, list[int]]]:
        out, at = [], 8 if b[0] == 1 else 2
        for _ in range(b[1]):
            number = _u(b, at, 2)
            named = b[0] == 1 or number >= 256
            length = _u(b, at + 2, 2) if named else 0
            at += 4 if named else 2
            values = _u(b, at + 2, 2)
            at += 4 + (-(-length // 8) * 8 if b[0] == 1 else length)
            out.append((number, [_u(b, at + 4 * k, 4) for k in range(values)]))
            at += 4 * values + (4 if b[0] == 1 and values % 2 else 0)
        return out

    def _attribute(self, b: bytes) -> tuple[str, object]:
        sizes = [_u(b, 2 + 2 * k, 2) for k in range(3)]
        at, parts = 9 if b[0] == 3 else 8, []
        for n in sizes:
            parts.append(b[at : at + n])
            at += -(-n // 8) * 8 if b[0] == 1 else n
        kind, shape = _kind(parts[1]), _shape(parts[2])
        return parts[0].split(b"\0")[0].decode(), self._plain(kind, shape, b[at : at + kind.size * math.prod(shape)])

    def _plain(self, kind: Kind, shape: tuple[int, ...], raw: bytes) -> object:
        if kind.dtype is None:
            got = [self._long(raw[k : k + kind.size]) for k in range(0, len(raw), kind.size)]
            return got[0] if not shape else got
        a = np.frombuffer(raw, kind.dtype)
        got = [x.rstrip(b"\0").decode("utf-8", "replace") for x in a.tolist()] if kind.dtype.kind == "S" else a.tolist()
        return got[0] if not shape else got

    def _long(self, b: bytes) -> str:
        """A text of variable length, from the collection that holds it."""
        n, address, index = _u(b, 0, 4), _u(b, 4, 8), _u(b, 12, 4)
        if not n:
            return ""
        heap = self.at(address, _u(self.at(address, 16), 8, 8))
        at = 16
        while at + 16 <= len(heap):
            number, size = _u(heap, at, 2), _u(heap, at + 8, 8)
            if number == index:
                return heap[at + 16 : at + 16 + n].decode("utf-8", "replace")
            at += 16 + -(-size // 8) * 8
        raise ValueError(f"no text {index} in the collection at {address}")

    def walk(self, address: int | None = None, name: str = "", above: frozenset = frozenset()) -> Iterator[tuple[str, Node | None, str | None]]:
        """(name, object, error) of all objects below a group, depth first; a link back to a group above is not followed."""
        address = self.root if address is None else address
        try:
            node = self.node(address)
        except (ValueError, IndexError, struct.error) as e:
            yield name or "/", None, f"{type(e).__name__}: {e}"
            return
        yield name or "/", node, None
        for link, child in sorted((node.links or {}).items()):
            if child not in above | {address}:
                yield from self.walk(child, f"{name}/{link}" if name else link, above | {address})

    def rows(self, node: Node, start: int, stop: int) -> np.ndarray:
        """The array's rows [start, stop) of its first dimension."""
        shape, dtype = node.shape or (), node.kind.dtype
        if dtype is None:
            raise ValueError("array of texts of variable length")
        cls, b = node.layout[0], node.layout[1:]
        row = dtype.itemsize * math.prod(shape[1:])
        n, out_shape = stop - start, (stop - start, *shape[1:])
        if cls == 0:
            return np.frombuffer(b[2 + start * row : 2 + stop * row], dtype).reshape(out_shape)
        if cls == 1:
            address = _u(b, 0, 8)
            return np.zeros(out_shape, dtype) if address == NOWHERE else np.frombuffer(self.at(address + start * row, n * row), dtype).reshape(out_shape)
        rank, tree = b[0], _u(b, 1, 8)
        chunk = tuple(_u(b, 9 + 4 * k, 4) for k in range(rank - 1))
        out = np.zeros(out_shape, dtype)
        for place, address, size, mask in self._chunks(tree, rank, start - chunk[0] + 1, stop) if tree != NOWHERE else ():
            piece = np.frombuffer(self._unfiltered(self.at(address, size), node, mask), dtype).reshape(chunk)
            lo = max(start, place[0])
            ends = [min(p + c, s) for p, c, s in zip(place, chunk, shape, strict=True)]
            hi = min(stop, ends[0])
            inner = tuple(slice(p, e) for p, e in zip(place[1:], ends[1:], strict=True))
            out[(slice(lo - start, hi - start), *inner)] = piece[(slice(lo - place[0], hi - place[0]), *(slice(0, e - p) for p, e in zip(place[1:], ends[1:], strict=True)))]
        return out

    def _chunks(self, tree: int, rank: int, least: int, stop: int) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
        """(place, address, size, filter mask) of the chunks whose first index is in [least, stop)."""
        head = self.at(tree, 24)
        n, key = _u(head, 6, 2), 8 + 8 * rank
        b = self.at(tree + 24, n * (key + 8) + key)
        for k in range(n):
            at = k * (key + 8)
            child = _u(b, at + key, 8)
            first = _u(b, at + 8, 8)
            if head[5]:
                if first < stop and _u(b, at + key + 8 + 8, 8) >= least:
                    yield from self._chunks(child, rank, least, stop)
            elif least <= first < stop:
                yield tuple(_u(b, at + 8 + 8 * j, 8) for j in range(rank - 1)), child, _u(b, at, 4), _u(b, at + 4, 4)

    @staticmethod
    def _unfiltered(raw: bytes, node: Node, mask: int) -> bytes:
        for k in reversed(range(len(node.filters))):
            number, values = node.filters[k]
            if mask >> k & 1:
                continue
            if number == 1:
                raw = zlib.decompress(raw)
            elif number == 2:
                width = values[0] if values else node.kind.size
                whole = len(raw) // width * width
                raw = np.frombuffer(raw[:whole], np.uint8).reshape(width, -1).T.tobytes() + raw[whole:]
            elif number == 3:
                raw = raw[:-4]
            else:
                raise ValueError(f"filter {number}")
        return raw


# ---- rows ------------------------------------------------------------------------------------


def _each(df: DataFrame, one, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def frame(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in ("path", *names, "error")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for path in batch["path"]:
                try:
                    with ranges.opened(path) as f:
                        for rows in one(File(f)):
                            held += [{"path": path, **r} for r in rows]
                            size += sum(len(r.get("payload") or r.get("values", ())) for r in rows)
                            if len(held) >= 4096 or size >= SLAB_BYTES:
                                yield frame(held)
                                held, size = [], 0
                except (OSError, ValueError, IndexError, struct.error, zlib.error) as e:
                    held.append({"path": path, "error": f"{type(e).__name__}: {e}"})
        if held:
            yield frame(held)

    return df.select("path").mapInPandas(run, f"path string, {schema}, error string")


def files(spark: SparkSession, path: str, pattern: str = "*.hdf5") -> DataFrame:
    """The paths below a folder; many small files share a task."""
    return ranges.dealt(spark, ranges.listed(path, pattern)).select("path")


def members(paths: DataFrame) -> DataFrame:
    """(path, name, is_group, shape, type, attributes, error) of all objects; attributes as texts."""

    def one(f: File) -> Iterator[list[dict]]:
        for name, node, error in f.walk():
            if node is None:
                yield [{"name": name, "error": error}]
                continue
            group = node.links is not None
            yield [{"name": name, "is_group": group, "shape": None if group else list(node.shape or ()), "type": None if group or node.kind is None else str(node.kind.dtype), "attributes": {k: str(v) for k, v in node.attributes.items()}}]

    return _each(paths, one, "name string, is_group boolean, shape array<bigint>, type string, attributes map<string,string>")


def _slabs(f: File, patterns: tuple[str, ...]) -> Iterator[tuple[str, Node, int, np.ndarray | None, str | None]]:
    for name, node, error in f.walk():
        if not any(fnmatch.fnmatchcase(name, p) for p in patterns):
            continue
        if node is None:
            yield name, node, 0, None, error
        elif node.shape:
            row = max(1, node.kind.size * math.prod(node.shape[1:]))
            step = max(1, SLAB_BYTES // row)
            try:
                for a in range(0, node.shape[0], step):
                    yield name, node, a, f.rows(node, a, min(a + step, node.shape[0])), None
            except (ValueError, IndexError, struct.error, zlib.error) as e:
                yield name, node, 0, None, f"{type(e).__name__}: {e}"


def array_rows(paths: DataFrame, *patterns: str) -> DataFrame:
    """(path, name, row, shape, values, error): one row for each row of the arrays whose names fit, its numbers in C order."""

    def one(f: File) -> Iterator[list[dict]]:
        for name, node, a, slab, error in _slabs(f, patterns):
            if slab is None:
                yield [{"name": name, "error": error}]
            else:
                flat = slab.reshape(len(slab), -1).astype(float)
                yield [{"name": name, "row": a + k, "shape": list(node.shape), "values": v} for k, v in enumerate(flat)]

    return _each(paths, one, "name string, row bigint, shape array<bigint>, values array<double>")


def array_frames(paths: DataFrame, *patterns: str, turned: bool = False) -> DataFrame:
    """(path, name, frame_idx, shape, payload, error): the bytes of each row; turned: pictures by 180 degrees."""

    def one(f: File) -> Iterator[list[dict]]:
        for name, node, a, slab, error in _slabs(f, patterns):
            if slab is None:
                yield [{"name": name, "error": error}]
            else:
                slab = slab[:, ::-1, ::-1] if turned and slab.ndim >= 3 else slab
                yield [{"name": name, "frame_idx": a + k, "shape": list(node.shape[1:]), "payload": np.ascontiguousarray(x).tobytes()} for k, x in enumerate(slab)]

    return _each(paths, one, "name string, frame_idx bigint, shape array<bigint>, payload binary")


# ---- corpora -----------------------------------------------------------------------------------


def scene_demos(members_: DataFrame) -> DataFrame:
    """One successful robot trajectory for each group data/<demo>; frames names the pictures, null without them; n_actions of its actions."""
    from tracklake.sources.readers import scene_task

    m = members_.where("error is null")
    # The groups right below data, and what hangs below them, in one pass.
    part = lambda k: F.try_element_at(F.split("name", "/"), F.lit(k))
    below = m.where(F.col("name").startswith("data/")).withColumn("demo", part(2))
    one = below.groupBy("path", "demo").agg(
        F.max((F.col("is_group") & (F.size(F.split("name", "/")) == 2)).cast("int")).alias("g"),
        F.max(F.when(F.col("name").endswith("/obs/agentview_rgb"), F.col("name"))).alias("frames"),
        F.max(F.when(F.size(F.split("name", "/")) == 3, F.when(part(3) == "actions", F.get("shape", F.lit(0))))).alias("n_actions"),
    )
    return one.where("g = 1").select("path", "demo", scene_task(F.col("path")).alias("task"), "frames", "n_actions", F.lit(True).alias("is_robot"), F.lit("successful").alias("quality_label"))


def described(members_: DataFrame, limit: int | None = None) -> DataFrame:
    """(path, task) of files by the attributes of their root: the second description where they say so; unavailable ones are dropped."""
    from tracklake.sources.readers import first_limit

    value = lambda k: F.try_element_at("attributes", F.lit(k))
    second = (value("which_llm_description").try_cast("double").cast("int") == 2) & value("llm_description2").isNotNull()
    task = F.when(value("llm_description").isNull(), "").when(second, value("llm_description2")).otherwise(value("llm_description"))
    rows = members_.where("name = '/' and error is null").select("path", task.alias("task"))
    return first_limit(rows.where(~F.lower("task").contains("description unavailable")), limit, "path")


#: Joints whose places make up a pose, in order: fixed values of the corpus.
JOINTS = ("transforms/leftHand", "transforms/rightHand", "transforms/leftIndexFingerTip", "transforms/rightIndexFingerTip", "transforms/camera")


def joint_places(paths: DataFrame) -> DataFrame:
    """(path, row, pose): the translation columns of the 4x4 transforms of all joints that are there, side by side."""
    rows = array_rows(paths, *JOINTS).where("error is null")
    place = F.array(*[F.get("values", F.lit(k)) for k in (3, 7, 11)])
    order = F.array_position(F.array(*map(F.lit, JOINTS)), F.col("name"))
    joined = rows.groupBy("path", "row").agg(F.array_sort(F.collect_list(F.struct(order.alias("k"), place.alias("p")))).alias("j"))
    return joined.select("path", "row", F.flatten(F.transform("j", lambda x: x["p"])).alias("pose"))


def proprio_actions(paths: DataFrame) -> DataFrame:
    """(path, row, action): the joint positions, else the end positions with the orientations behind them."""
    rows = array_rows(paths, "action/joint/position", "action/end/position", "action/end/orientation").where("error is null")
    of = lambda n: F.max_by("values", F.when(F.col("name") == n, 1))
    one = rows.groupBy("path", "row").agg(of("action/joint/position").alias("joint"), of("action/end/position").alias("at"), of("action/end/orientation").alias("to"))
    # A file with joint positions has no rows of the others; its joints may be fewer than its ends.
    joint = rows.where("name = 'action/joint/position'").select("path").distinct().withColumn("j", F.lit(True))
    out = one.join(joint, "path", "left").select("path", "row", F.when(F.col("j"), F.col("joint")).otherwise(F.concat("at", F.coalesce("to", F.array().cast("array<double>")))).alias("action"))
    return out.where("action is not null")


# ---- writing --------------------------------------------------------------------------------------


class Tree:
    """The bytes of a file with groups (dictionaries) and arrays, for exports and tests.

    attributes and chunks (with the filters shuffle and deflate) by the object's name; nodes
    of the trees hold at most ``fan`` children.
    """

    def __init__(self, tree: dict, attributes: dict[str, dict] | None = None, chunks: dict[str, tuple[int, ...]] | None = None, filters: tuple[int, ...] = (2, 1), fan: int = 4):
        self.attributes, self.chunks, self.filters, self.fan = attributes or {}, chunks or {}, filters, fan
        self.out = bytearray(96)
        root = self._object(tree, "/")
        head = SIGNATURE + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + struct.pack("<HHI", fan, fan, 0)
        self.out[: len(head) + 72] = head + struct.pack("<QQQQ", 0, NOWHERE, len(self.out), NOWHERE) + struct.pack("<QQII", 0, root, 0, 0) + bytes(16)

    def _put(self, b: bytes) -> int:
        self.out += bytes(-len(self.out) % 8)
        self.out += b
        return len(self.out) - len(b)

    @staticmethod
    def _type(dtype: np.dtype) -> bytes:
        if dtype.kind == "S":
            return bytes([0x13, 0, 0, 0]) + struct.pack("<I", dtype.itemsize)
        bits = 8 * dtype.itemsize
        if dtype.kind == "f":
            exponent, mantissa = (8, 23) if bits == 32 else (11, 52)
            return bytes([0x11, 0x20, bits - 1, 0]) + struct.pack("<IHHBBBBI", dtype.itemsize, 0, bits, mantissa, exponent, 0, mantissa, 2 ** (exponent - 1) - 1)
        return bytes([0x10, 8 if dtype.kind == "i" else 0, 0, 0]) + struct.pack("<IHH", dtype.itemsize, 0, bits)

    @staticmethod
    def _space(shape: tuple[int, ...]) -> bytes:
        return bytes([1, len(shape), 0, 0, 0, 0, 0, 0]) + struct.pack(f"<{len(shape)}Q", *shape)

    def _header(self, messages: list[tuple[int, bytes]]) -> int:
        body = b"".join(struct.pack("<HHBBBB", kind, len(b) + -len(b) % 8, 0, 0, 0, 0) + b + bytes(-len(b) % 8) for kind, b in messages)
        return self._put(struct.pack("<BBHII", 1, 0, len(messages), 1, len(body)) + bytes(4) + body)

    def _named(self, name: str) -> list[tuple[int, bytes]]:
        out = []
        pad = lambda b: b + bytes(-len(b) % 8)
        for key, value in self.attributes.get(name, {}).items():
            if isinstance(value, str) and value.startswith("~"):  # of variable length
                text = value[1:].encode()
                heap = self._put(b"GCOL" + bytes([1, 0, 0, 0]) + struct.pack("<Q", 48 + len(pad(text))) + struct.pack("<HHIQ", 1, 1, 0, len(text)) + pad(text) + bytes(16))
                kind, raw, shape = bytes([0x19, 1, 0, 0]) + struct.pack("<I", 16) + self._type(np.dtype("S1")), struct.pack("<IQI", len(text), heap, 1), ()
            else:
                a = np.array(value.encode() if isinstance(value, str) else value)
                kind, raw, shape = self._type(a.dtype), a.tobytes(), a.shape
            n, space = key.encode() + b"\0", self._space(shape)
            out.append((0x0C, struct.pack("<BBHHH", 1, 0, len(n), len(kind), len(space)) + pad(n) + pad(kind) + pad(space) + raw))
        return out

    def _levels(self, kind: int, keys: list[bytes], children: list[int], last: bytes) -> int:
        """A tree over children; keys[k] stands before child k."""
        level = 0
        while True:
            up_keys, up = [], []
            for a in range(0, max(1, len(children)), self.fan):
                part = list(zip(keys[a : a + self.fan], children[a : a + self.fan], strict=True))
                end = keys[a + self.fan] if a + self.fan < len(keys) else last
                body = b"".join(k + struct.pack("<Q", c) for k, c in part) + end
                up_keys.append(keys[a] if keys else last)
                up.append(self._put(b"TREE" + struct.pack("<BBHQQ", kind, level, len(part), NOWHERE, NOWHERE) + body))
            keys, children, level = up_keys, up, level + 1
            if len(children) == 1:
                return children[0]

    def _object(self, value, name: str) -> int:
        inner = "" if name == "/" else f"{name}/"
        if isinstance(value, dict):
            names = sorted(value)
            places = [self._object(value[n], inner + n) for n in names]
            heap, at = bytearray(8), []
            for n in names:
                at.append(len(heap))
                heap += n.encode() + b"\0" + bytes(-(len(n.encode()) + 1) % 8)
            data = self._put(bytes(heap))
            local = self._put(b"HEAP" + bytes(4) + struct.pack("<QQQ", len(heap), 1, data))
            keys, leaves = [], []
            for a in range(0, len(names), self.fan):
                entries = b"".join(struct.pack("<QQII", o, p, 0, 0) + bytes(16) for o, p in zip(at[a : a + self.fan], places[a : a + self.fan], strict=True))
                keys.append(struct.pack("<Q", at[a - 1] if a else 0))
                leaves.append(self._put(b"SNOD" + struct.pack("<BBH", 1, 0, len(names[a : a + self.fan])) + entries))
            tree = self._levels(0, keys, leaves, struct.pack("<Q", at[-1] if at else 0))
            return self._header([(0x11, struct.pack("<QQ", tree, local)), *self._named(name)])
        a = np.asarray(value)
        messages = [(0x01, self._space(a.shape)), (0x03, self._type(a.dtype))]
        chunk = self.chunks.get(name)
        if chunk is None:
            messages.append((0x08, bytes([3, 1]) + struct.pack("<QQ", self._put(a.tobytes()) if a.size else NOWHERE, a.nbytes)))
        else:
            keys, places = [], []
            for place in np.ndindex(*[-(-s // c) for s, c in zip(a.shape, chunk, strict=True)]):
                corner = [p * c for p, c in zip(place, chunk, strict=True)]
                piece = np.zeros(chunk, a.dtype)
                part = a[tuple(slice(p, p + c) for p, c in zip(corner, chunk, strict=True))]
                piece[tuple(slice(0, n) for n in part.shape)] = part
                raw = piece.tobytes()
                for f in self.filters:
                    raw = np.frombuffer(raw, np.uint8).reshape(-1, a.itemsize).T.tobytes() if f == 2 else zlib.compress(raw) if f == 1 else raw + bytes(4)
                keys.append(struct.pack("<II", len(raw), 0) + struct.pack(f"<{len(chunk) + 1}Q", *corner, 0))
                places.append(self._put(raw))
            last = struct.pack("<II", 0, 0) + struct.pack(f"<{len(chunk) + 1}Q", *a.shape, 0)
            tree = self._levels(1, keys, places, last) if places else NOWHERE
            messages.append((0x08, bytes([3, 2, len(chunk) + 1]) + struct.pack("<Q", tree) + struct.pack(f"<{len(chunk) + 1}I", *chunk, a.itemsize)))
            values = {1: [6], 2: [a.itemsize], 3: []}
            messages.append((0x0B, bytes([1, len(self.filters)]) + bytes(6) + b"".join(struct.pack("<HHHH", f, 0, 0, len(values[f])) + b"".join(struct.pack("<I", v) for v in values[f]) + bytes(4 * (len(values[f]) % 2)) for f in self.filters)))
        return self._header([*messages, *self._named(name)])

    def bytes(self) -> bytes:
        return bytes(self.out)


def save_arrays(rows: DataFrame, path: str) -> DataFrame:
    """Writes rows (file, name, row, values) as arrays of the files ``file``.hdf5; returns (file, arrays) when run.

    A file is put together in one task: deal the arrays to files of a bounded size.
    """

    def one(part: pd.DataFrame) -> pd.DataFrame:
        fs, inner = ranges.store(path)
        fs.create_dir(inner)
        name, tree = part["file"].iloc[0], {}
        groups = part.sort_values(["name", "row"]).groupby("name", sort=True)["values"]
        for array, values in groups:
            at = tree
            *above, last = array.split("/")
            for g in above:
                at = at.setdefault(g, {})
            at[last] = np.stack(values.to_list()).astype(float)
        with fs.open_output_stream(f"{inner}/_attempt-{name}") as out:
            out.write(Tree(tree, fan=64).bytes())
        fs.move(f"{inner}/_attempt-{name}", f"{inner}/{name}.hdf5")
        return pd.DataFrame({"file": [name], "arrays": [len(groups)]})

    return rows.select("file", "name", "row", "values").groupBy("file").applyInPandas(one, "file string, arrays bigint")
