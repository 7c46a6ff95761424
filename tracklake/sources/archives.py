"""Members of .tar archives by byte ranges: an index of the headers, then reads of bounded size, in batch or as a stream.

The index of an archive is read from its headers alone, with seeks over the contents.  The
members are dealt to tasks by bytes, and each task holds one member at a time.  The index
saved with ``save_index`` has a file for each part of an archive; a stream over these files
takes a few parts a micro-batch, and its checkpoint goes on in mid-archive.
"""

from __future__ import annotations

import io
import tarfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklake.sources import ranges

BLOCK = 512
INDEX = "path string, member string, offset bigint, size bigint, error string"
#: Contents of a batch of rows that is handed on at once.
BATCH_BYTES = 1 << 24


def _pax(body: bytes) -> dict[str, str]:
    """The records 'length key=value' of an extended header."""
    out, at = {}, 0
    while at < len(body) and body[at : at + 1].isdigit():
        n = int(body[at : body.index(b" ", at)])
        key, _, value = body[at : at + n].split(b" ", 1)[1].rstrip(b"\n").partition(b"=")
        out[key.decode()] = value.decode("utf-8", "replace")
        at += n
    return out


def headers(f, size: int) -> Iterator[dict]:
    """(member, offset, size) of the files of an archive; a broken header is an error, and the next good one is looked for."""
    at, extra, broken = 0, {}, None
    while at + BLOCK <= size:
        block = ranges.at(f, at, BLOCK)
        if not any(block):
            at += BLOCK
            continue
        try:
            info = tarfile.TarInfo.frombuf(block, "utf-8", "surrogateescape")
        except tarfile.HeaderError as e:
            if broken is None:
                broken = at
                yield {"offset": at, "error": f"{type(e).__name__}: {e}"}
            at, extra = at + BLOCK, {}
            continue
        if broken is not None and block[257:262] != b"ustar":  # a piece of a content
            at += BLOCK
            continue
        broken = None
        after = at + BLOCK
        n = int(extra.get("size", info.size))
        if info.type in (tarfile.GNUTYPE_LONGNAME, tarfile.XHDTYPE):
            body = ranges.at(f, after, info.size)
            extra |= {"path": body.rstrip(b"\0").decode("utf-8", "replace")} if info.type == tarfile.GNUTYPE_LONGNAME else _pax(body)
        else:
            if info.isreg():
                short = after + n > size
                yield {"member": extra.get("path", info.name), "offset": after, "size": n, "error": "content ends behind the archive" if short else None}
            extra = {}
        at = after + -(-info.size // BLOCK) * BLOCK if info.type in (tarfile.GNUTYPE_LONGNAME, tarfile.XHDTYPE) else after + -(-n // BLOCK) * BLOCK * info.isreg()


def _indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", "member", "offset", "size", "error"]
    for batch in batches:
        for path, size in zip(batch["path"], batch["bytes"], strict=True):
            rows = []
            try:
                with ranges.opened(path) as f:
                    for h in headers(f, size):
                        rows.append({"path": path, **h})
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=columns).astype(object)
                            rows = []
            except OSError as e:
                rows.append({"path": path, "error": f"{type(e).__name__}: {e}"})
            if rows:
                out = pd.DataFrame(rows, columns=columns)
                yield out.astype({"offset": "Int64", "size": "Int64"})


def tar_index(spark: SparkSession, path: str, pattern: str = "*.tar") -> DataFrame:
    """``INDEX`` of the plain archives below a path; a task reads one archive after the other."""
    return ranges.dealt(spark, ranges.listed(path, pattern)).mapInPandas(_indexed, INDEX)


def in_parts(index: DataFrame, part_bytes: int = 1 << 28) -> DataFrame:
    """Adds part: pieces of an archive whose members begin within ``part_bytes`` of each other."""
    before = F.sum("size").over(Window.partitionBy("path").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1))
    return index.withColumn("part", F.floor(F.coalesce(before, F.lit(0)) / part_bytes).cast("int"))


def _contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        payloads: list[bytes | None] = []
        errors, begin, held = batch["error"].tolist(), 0, 0
        f, name = None, None
        try:
            for k, (path, offset, size) in enumerate(zip(batch["path"], batch["offset"], batch["size"], strict=True)):
                payload = None
                if errors[k] is None:
                    try:
                        if path != name:
                            if f is not None:
                                f.close()
                            f, name = ranges.opened(path), path
                        payload = ranges.at(f, int(offset), int(size))
                        if len(payload) < size:
                            payload, errors[k] = None, "content ends behind the archive"
                    except OSError as e:
                        f, name, errors[k] = None, None, f"{type(e).__name__}: {e}"
                payloads.append(payload)
                held += len(payload or b"")
                if held >= BATCH_BYTES:
                    yield batch.iloc[begin : k + 1].assign(error=errors[begin : k + 1], payload=payloads)
                    payloads, begin, held = [], k + 1, 0
        finally:
            if f is not None:
                f.close()
        if payloads:
            yield batch.iloc[begin:].assign(error=errors[begin:], payload=payloads)


def contents(index: DataFrame) -> DataFrame:
    """Adds payload; the rows are read where they are, in the order in which they are."""
    rows = index.withColumn("error", F.col("error")).select(*[c for c in index.columns if c != "payload"])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(_contents, f"{kept}, payload binary")


def tar_contents(index: DataFrame, part_bytes: int = 1 << 28) -> DataFrame:
    """The members with their contents; a task reads whole parts, one member at a time, and several parts where they are small and many.

    Filter the index first: what it does not hold is not read.
    """
    parts = in_parts(index, part_bytes)
    total = index.agg(F.sum("size")).first()[0] or 0
    tasks = min(-(-int(total) // part_bytes), max(ranges.TASK_FILES, -(-int(total) // ranges.TASK_BYTES)))
    dealt = parts.repartition(max(1, tasks), "path", "part").sortWithinPartitions("path", "offset")
    return contents(dealt).drop("part")


def save_index(index: DataFrame, path: str, part_bytes: int = 1 << 28) -> None:
    """One file for each part of an archive, for ``tar_stream``; archives that are there already are left out."""
    spark = index.sparkSession
    try:
        done = spark.read.schema(INDEX).parquet(path).select("path").distinct()
        index = index.join(done, "path", "left_anti").select("path", "member", "offset", "size", "error")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    key = F.concat_ws("-", F.md5("path"), F.col("part").cast("string"))
    named = in_parts(index, part_bytes).withColumn("piece", key).drop("part")
    named.repartition("piece").sortWithinPartitions("piece", "offset").write.mode("append").partitionBy("piece").parquet(path)


def tar_stream(spark: SparkSession, path: str, parts_per_batch: int = 8) -> DataFrame:
    """A stream of the members of a saved index with their contents, a few parts a micro-batch."""
    rows = spark.readStream.schema(f"{INDEX}, piece string").option("maxFilesPerTrigger", parts_per_batch).parquet(path)
    return contents(rows)


def save_archives(members: DataFrame, path: str) -> DataFrame:
    """Writes rows (archive, member, payload) as ``archive``.tar, members by name; returns (archive, members) when run.

    An archive is written as its rows come, under a name of its attempt, and then gets its own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, inner = ranges.store(path)
        fs.create_dir(inner)
        name, out, tar, count, done = None, None, None, 0, []

        def close() -> None:
            if name is not None:
                tar.close()
                out.close()
                fs.move(attempt, f"{inner}/{name}.tar")
                done.append((name, count))

        for batch in batches:
            for archive, member, payload in zip(batch["archive"], batch["member"], batch["payload"], strict=True):
                if archive != name:
                    close()
                    attempt = f"{inner}/_attempt-{uuid.uuid4().hex}"
                    name, count, out = archive, 0, fs.open_output_stream(attempt)
                    tar = tarfile.open(fileobj=out, mode="w|", format=tarfile.PAX_FORMAT)
                info = tarfile.TarInfo(member)
                info.size = len(payload)
                tar.addfile(info, io.BytesIO(bytes(payload)))
                count += 1
        close()
        yield pd.DataFrame(done, columns=["archive", "members"])

    return members.select("archive", "member", "payload").repartition("archive").sortWithinPartitions("archive", "member").mapInPandas(run, "archive string, members bigint")


def clips(contents_: DataFrame, episodes: DataFrame, cameras: list[str], frames: Column) -> DataFrame:
    """Members episode/videos/camera as trajectories: each video whole and once for each action of its episode.

    contents_: index rows, with contents where ``frames`` (the number of a video's frames)
    needs them; episodes: as ``readers.task_episodes`` gives them.  Videos of other cameras,
    of unknown episodes and with errors are left out.
    """
    from tracklake.functions.text import episode_and_camera
    from tracklake.sources.readers import expand_actions

    named = contents_.where("error is null").withColumn("k", episode_and_camera(F.col("member"))).where(F.col("k.camera").isin(cameras))
    videos = named.select(F.col("k.episode").try_cast("bigint").alias("episode_id"), F.concat_ws("#", "path", "member").alias("frames"), frames.cast("int").alias("n"))
    return expand_actions(videos, episodes).withColumn("camera", F.element_at(F.split("frames", "/"), -1))
