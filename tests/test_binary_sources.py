"""Framed records, archives and hierarchical files: splits, errors and rows against what was written."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F


def png(pixels: bytes, width: int, height: int, filtered: int = 0) -> bytes:
    """A grey picture; each row under one filter byte."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(bytes([filtered]) + pixels[k * width : (k + 1) * width] for k in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def bitwise_crc32c(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = (c >> 1) ^ 0x82F63B78 if c & 1 else c >> 1
    return c ^ 0xFFFFFFFF


def test_crc32c():
    from tracklake.sources.tfrecord import crc32c

    assert crc32c(b"123456789") == 0xE3069283
    rng = random.Random(4)
    for n in [0, 1, 7, 63, 64, 65, 100, 127, 128, 129, 255, 1000, 4096, 4097, 8191, 8193, 70_001]:
        data = rng.randbytes(n)
        assert crc32c(data) == bitwise_crc32c(data), n


def test_messages():
    from tracklake.sources.tfrecord import message, parsed

    features = {"b": ([b"", b"\x00\xff"], None, None), "f": (None, [1.5, -2.0], None), "i": (None, None, [0, 1, -1, 2**62, -(2**63)]), "é": (None, None, [])}
    assert parsed(message(features)) == features
    # Integers and floats that are not packed, as other writers may leave them.
    from tracklake.sources.tfrecord import _coded, _field

    loose = _field(1, _field(1, _field(1, b"n") + _field(2, _field(3, b"\x08" + _coded(300) + b"\x08" + _coded(5)))))
    loose += _field(1, _field(1, _field(1, b"x") + _field(2, _field(2, b"\x0d" + struct.pack("<f", 0.5)))))
    assert parsed(loose) == {"n": (None, None, [300, 5]), "x": (None, [0.5], None)}


@pytest.fixture(scope="module")
def record_files(tmp_path_factory):
    from tracklake.sources.tfrecord import framed, message

    folder = tmp_path_factory.mktemp("records")
    rng, want = random.Random(6), []
    for name in ("a-train.tfrecord-00000-of-00002", "a-train.tfrecord-00001-of-00002", "a-val.tfrecord-00000-of-00001"):
        out = b""
        for k in range(60):
            inner = framed(message({"trap": ([rng.randbytes(9)], None, None)}))  # a payload that holds a framed record
            payload = message({"k": (None, None, [k]), "p": ([rng.randbytes(rng.randint(0, 700)), inner], None, None)})
            want.append((name, len(out), len(payload), k))
            out += framed(payload)
        (folder / name).write_bytes(out)
    return folder, want


@pytest.mark.parametrize("split_bytes", [50, 997, 20_000, 1 << 26])
def test_records_in_splits(spark, record_files, split_bytes):
    from tracklake.sources import rlds

    folder, want = record_files
    got = rlds.read_records(spark, str(folder), split_bytes).select("path", "offset", "length", F.col("features")["k"]["ints"][0].alias("k"), "error", "split").collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.offset, r.length, r.k) for r in got) == sorted(want)
    assert all(r.error is None for r in got) and {r.split for r in got} == {"train", "val"}


@pytest.mark.parametrize("split_bytes", [300, 1 << 26])
def test_broken_records(spark, record_files, tmp_path, split_bytes):
    from tracklake.sources import rlds

    folder, want = record_files
    name = "a-train.tfrecord-00000-of-00002"
    own = [w for w in want if w[0] == name]
    raw = bytearray((folder / name).read_bytes())
    raw[own[5][1] + 3] ^= 1  # a header
    raw[own[20][1] + 14] ^= 1  # a payload
    raw[own[40][1]] ^= 255
    (tmp_path / name).write_bytes(bytes(raw[: own[59][1] + 20]))  # the last one is cut
    got = rlds.read_records(spark, str(tmp_path), split_bytes).select("offset", F.col("features")["k"]["ints"][0].alias("k"), "error").collect()
    assert sorted(r.k for r in got if r.error is None) == [k for k in range(60) if k not in (5, 20, 40, 59)]
    bad = {r.offset: r.error for r in got if r.error}
    assert set(bad) == {own[k][1] for k in (5, 20, 40, 59)}
    assert "payload" in bad[own[20][1]] and "behind" in bad[own[59][1]]


def test_written_records_come_back(spark, tmp_path):
    from tracklake.sources import rlds

    df = spark.range(100).select(F.create_map(F.lit("id"), F.struct(F.lit(None).cast("array<binary>").alias("bytes"), F.lit(None).cast("array<float>").alias("floats"), F.array("id").alias("ints"))).alias("features")).repartition(3)
    rlds.write_records(df, str(tmp_path / "d"), "d", "train")
    rlds.write_records(df.limit(7), str(tmp_path / "d"), "d", "test")
    d = str(tmp_path / "d")
    back = rlds.read_records(spark, d, split=rlds.chosen_split(d))
    assert sorted(r[0] for r in back.select(F.col("features")["id"]["ints"][0]).collect()) == list(range(100))
    assert rlds.chosen_split(d, True) == "test" and rlds.read_records(spark, d, split="test").count() == 7 and rlds.read_records(spark, d).count() == 107
    assert not list((tmp_path / "d").glob("_attempt*"))
    rlds.write_records(df.limit(1), str(tmp_path / "d"), "d", "val")
    with pytest.raises(ValueError, match="exactly one"):
        rlds.chosen_split(d, True)


def test_many_records_at_once(tmp_path, monkeypatch):
    """Messages, frames, checksums and headers of many records are those of single ones, and small records are not read one by one."""
    import numpy as np
    import pyarrow as pa

    from tracklake.sources import ranges, tfrecord

    rng = random.Random(9)
    texts = lambda: [rng.randbytes(rng.choice([0, 3, 127, 128, 700, 5000])) for _ in range(rng.randint(0, 4))]
    kinds = [lambda: (texts(), None, None), lambda: (None, [1.5, -2.0][: rng.randint(0, 2)], None), lambda: (None, None, [rng.randint(-(2**63), 2**63 - 1) for _ in range(rng.randint(0, 3))]), lambda: (None, None, None)]
    features = [{f"{n}é{k}": rng.choice(kinds)() for k in range(rng.randint(0, 4)) for n in ("b", "a")} for _ in range(300)]
    arrow = pa.array([[(k, dict(zip(("bytes", "floats", "ints"), v, strict=True))) for k, v in f.items()] for f in features], tfrecord.ARROW.field("features").type)
    payloads = list(tfrecord.messages(arrow))
    assert payloads == [tfrecord.message(f) for f in features]
    assert list(tfrecord.messages(arrow.slice(70, 100))) == payloads[70:170]
    whole = b"".join(map(tfrecord.framed, payloads))
    assert tfrecord.framed_all(payloads) == whole
    rows = [("f", k, len(p), tfrecord.parsed(p) if k % 7 else None, None if k % 7 else "e") for k, p in enumerate(payloads)]
    batch = tfrecord.batch_of(rows)
    got = [None if f is None else {k: (v["bytes"], v["floats"], v["ints"]) for k, v in f} for f in batch.column("features").to_pylist()]
    assert got == [r[3] for r in rows] and batch.column("error").to_pylist() == [r[4] for r in rows]
    data = np.frombuffer(whole, np.uint8)
    at = np.array([0, 5, 5, 9000]), np.array([4, 0, 6000, 4095])
    assert tfrecord.masked_crcs(data, *at).tolist() == [tfrecord.masked(tfrecord.crc32c(whole[a : a + n])) for a, n in zip(*at, strict=True)]
    (tmp_path / "r").write_bytes(whole)
    reads = []
    monkeypatch.setattr(ranges, "at", lambda f, a, n, old=ranges.at: reads.append(n) or old(f, a, n))
    with ranges.opened(str(tmp_path / "r")) as f:
        for half in (0, len(whole) // 2):
            reads.clear()
            seen = [p for *_, p, error in tfrecord.records(f, half, len(whole), len(whole)) if error is None]
            assert seen == payloads[300 - len(seen) :] and len(reads) < 100
        assert len(seen) in range(1, 300)
    for limit, tasks in ((1 << 30, 1), (len(whole) // 100, 101), (1000, 128)):  # small splits share a task
        splits = tfrecord.TfRecordReader({"path": str(tmp_path), "pathglobfilter": "r", "splitbytes": str(limit)}).partitions()
        assert 0 < len(splits) <= tasks and sum(s.end - s.start for p in splits for s in p.splits) == len(whole)


def test_camera_rows(spark, tmp_path):
    from tracklake.sources import rlds
    from tracklake.sources.tfrecord import framed, message

    dark, light = png(bytes(12), 4, 3, 2), png(bytes(11) + b"\x01", 4, 3)
    text = lambda t: ([t.encode()] * 2, None, None)
    codes = [*b"push \xc3\xa9", 0, 0]
    episodes = [
        {"steps/language_instruction": text("pick"), "steps/observation/image": ([light, dark], None, None), "steps/observation/wrist": ([light], None, None)},
        {"steps/observation/natural_language_instruction": text("place"), "steps/language_instruction": text("other"), "steps/observation/image": ([dark, light], None, None), "steps/observation/side": ([b"\x00\x00\x01"] * 2, None, None)},
        {"steps/language_instruction": text(""), "steps/instruction": text("never"), "steps/observation/image": ([light], None, None)},
        {"steps/observation/image": ([light], None, None)},
        {"steps/observation/instruction": (None, None, codes * 2), "steps/is_first": (None, None, [1, 0]), "steps/observation/image": ([b"\xff\xd8 no png"], None, None)},
    ]
    (tmp_path / "x-train.tfrecord-00000-of-00001").write_bytes(b"".join(framed(message(e)) for e in episodes))
    records = rlds.read_records(spark, str(tmp_path))
    views = {"primary": "image", "secondary": "side", "wrist": "wrist"}
    got = sorted((r.task, r.view, r.num_frames) for r in rlds.camera_rows(records, views).collect())
    assert got == [("pick", "primary", 2), ("place", "secondary", 2)]
    assert ("pick", "wrist", 1) in {(r.task, r.view, r.num_frames) for r in rlds.camera_rows(records, views, wrist=True).collect()}
    assert [(r.task, r.view) for r in rlds.camera_rows(records, views, coded=True).collect() if r.task.startswith("push")] == [("push é", "primary")]


def tar_bytes(members, form):
    import io
    import tarfile

    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=form) as t:
        for name, body in members:
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
        t.addfile(_folder())
    return out.getvalue()


def _folder():
    import tarfile

    d = tarfile.TarInfo("a_folder")
    d.type = tarfile.DIRTYPE
    return d


@pytest.fixture(scope="module")
def tars(tmp_path_factory):
    import tarfile

    folder, rng, want = tmp_path_factory.mktemp("tars"), random.Random(2), {}
    for k, form in enumerate((tarfile.USTAR_FORMAT, tarfile.GNU_FORMAT, tarfile.PAX_FORMAT)):
        members = [(f"{100 + k}{j}/videos/{'head_color' if j % 2 else 'back'}", rng.randbytes(rng.randint(0, 2000))) for j in range(40)]
        if form != tarfile.USTAR_FORMAT:
            members += [("long/" * 40 + "é.mp4", b"long name")]
        (folder / f"{k}.tar").write_bytes(tar_bytes(members, form))
        want |= {(f"{k}.tar", n): b for n, b in members}
    return folder, want


@pytest.mark.parametrize("part_bytes", [3000, 1 << 28])
def test_tar_by_ranges(spark, tars, part_bytes):
    from tracklake.sources import archives

    folder, want = tars
    index = archives.tar_index(spark, str(folder))
    got = archives.tar_contents(index, part_bytes).collect()
    assert {(r.path.rsplit("/", 1)[1], r.member): bytes(r.payload) for r in got} == want and len(got) == len(want)
    some = archives.tar_contents(index.where(F.col("member").endswith("head_color")), part_bytes)
    assert some.count() == 60
    parts = archives.in_parts(index, 3000).groupBy("path", "part").agg(F.sum("size") - F.max("size")).collect()
    assert all(r[2] <= 3000 for r in parts)


def test_broken_tar(spark, tars, tmp_path):
    from tracklake.sources import archives

    folder, want = tars
    raw = bytearray((folder / "0.tar").read_bytes())
    index = sorted(r.offset for r in archives.tar_index(spark, str(folder / "0.tar"), "*").collect())
    raw[index[7] - 512 + 150] ^= 255  # the header before a content
    (tmp_path / "x.tar").write_bytes(bytes(raw[: index[35] + 1]))
    (tmp_path / "y.tar").write_bytes(b"no archive")
    got = archives.tar_contents(archives.tar_index(spark, str(tmp_path))).collect()
    good = {r.member: bytes(r.payload) for r in got if r.error is None}
    lost = {n for (f, n) in want if f == "0.tar"} - set(good)
    assert f"{100}7/videos/head_color" in lost and all(good[n] == want["0.tar", n] for n in good)
    assert len(good) >= 33 and sorted(r.error.split(":")[0] for r in got if r.error)[-1].startswith("content ends") and any("Header" in r.error for r in got if r.error)


def test_tar_stream_goes_on_in_mid_archive(spark, tars, tmp_path):
    from tracklake.sources import archives

    folder, want = tars
    archives.save_index(archives.tar_index(spark, str(folder)), str(tmp_path / "index"), 5000)
    n = len(list((tmp_path / "index").glob("piece=*")))
    assert n > 6
    batches = []

    def run(limit):
        def flush(batch, number):
            if limit is not None and len(batches) >= limit:
                raise RuntimeError("stopped")
            batch.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={number}"))
            batches.append(number)

        q = archives.tar_stream(spark, str(tmp_path / "index"), 2).writeStream.foreachBatch(flush).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()

    with pytest.raises(Exception, match="stopped"):
        run(2)
    first = spark.read.parquet(str(tmp_path / "out")).select("path", "member").distinct().count()
    assert 0 < first < len(want)
    run(None)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.path.rsplit("/", 1)[1], r.member): bytes(r.payload) for r in got} == want and len(got) == len(want)
    assert len(set(batches)) == len(batches) == -(-n // 2)
    archives.save_index(archives.tar_index(spark, str(folder)), str(tmp_path / "index"), 5000)  # nothing new
    assert len(list((tmp_path / "index").glob("piece=*/*.parquet"))) == n


def test_hdf5_files(spark, tmp_path):
    import numpy as np

    from tracklake.sources import hdf5

    rng = np.random.default_rng(3)
    actions = {k: rng.normal(size=(30 + k, 7)) for k in range(11)}
    rgb = rng.integers(0, 255, (9, 5, 4, 3)).astype(np.uint8)
    tree = {"data": {f"demo_{k}": {"actions": a, "obs": {"agentview_rgb": rgb}} for k, a in actions.items()} | {"no_group": np.arange(3)}, "other": {}}
    chunks = {f"data/demo_{k}/actions": (4, 3) for k in range(5)} | {"data/demo_1/obs/agentview_rgb": (2, 5, 4, 3)}
    made = hdf5.Tree(tree, {"/": {"total": np.int64(5)}, "data/demo_3": {"note": "~é long text", "short": "abc", "pair": np.array([1.5, 2.0])}}, chunks, fan=3)
    (tmp_path / "KITCHEN_SCENE2_put_the_cup_demo.hdf5").write_bytes(made.bytes())
    (tmp_path / "bad.hdf5").write_bytes(b"nothing of the kind")
    paths = hdf5.files(spark, str(tmp_path))
    m = hdf5.members(paths)
    by_name = {r.name: r for r in m.where("name is not null").collect()}
    assert by_name["data/demo_3"].attributes == {"note": "é long text", "short": "abc", "pair": "[1.5, 2.0]"}
    assert by_name["data/demo_2/actions"].shape == [32, 7] and by_name["/"].attributes["total"] == "5" and by_name["other"].is_group
    assert m.where("error is not null").count() == 1
    demos = sorted((int(r.demo[5:]), r.task, r.n_actions) for r in hdf5.scene_demos(m).collect())
    assert demos == [(k, "put the cup", 30 + k) for k in range(11)]
    got = hdf5.array_rows(paths, "data/*/actions").where("error is null").collect()
    assert len(got) == sum(len(a) for a in actions.values())
    for r in got:
        assert r["values"] == actions[int(r.name.split("_")[1].split("/")[0])][r.row].tolist()
    for turned in (False, True):
        frames = hdf5.array_frames(paths, "data/demo_1/obs/*", "data/demo_2/obs/*", turned=turned).where("error is null").collect()
        assert len(frames) == 18
        for r in frames:
            x = rgb[r.frame_idx][::-1, ::-1] if turned else rgb[r.frame_idx]
            assert bytes(r.payload) == x.tobytes() and r["shape"] == [5, 4, 3]


def test_hdf5_slabs(spark, tmp_path, monkeypatch):
    import numpy as np

    from tracklake.sources import hdf5, ranges

    rng = np.random.default_rng(5)
    arrays = {"a": rng.integers(-9, 9, (53, 3)).astype("<i4"), "b": rng.normal(size=(20, 6)).astype("<f4"), "c": np.zeros((0, 4)), "d": np.array([b"xy", b"z"])}
    (tmp_path / "x.h5").write_bytes(hdf5.Tree(arrays, chunks={"a": (7, 2), "b": (3, 6)}, filters=(2, 1, 3), fan=2).bytes())
    with ranges.opened(str(tmp_path / "x.h5")) as f:
        file = hdf5.File(f)
        nodes = {n: x for n, x, _ in file.walk()}
        for name in "ab":
            for lo in range(0, len(arrays[name]), 3):
                for hi in range(lo, len(arrays[name]) + 1, 5):
                    assert (file.rows(nodes[name], lo, hi) == arrays[name][lo:hi]).all()
        assert file.rows(nodes["d"], 0, 2).tolist() == [b"xy", b"z"]


def test_poses_and_actions(spark, tmp_path):
    import numpy as np

    from tracklake.sources import hdf5

    rng = np.random.default_rng(1)
    left, camera = rng.normal(size=(6, 4, 4)), rng.normal(size=(6, 4, 4)).astype("<f4")
    notes = {"llm_description": "~first", "llm_description2": "second", "which_llm_description": np.int64(2)}
    (tmp_path / "a.hdf5").write_bytes(hdf5.Tree({"transforms": {"leftHand": left, "camera": camera}}, {"/": notes}, {"transforms/leftHand": (2, 4, 4)}).bytes())
    (tmp_path / "b.hdf5").write_bytes(hdf5.Tree({}, {"/": {"llm_description": "Description Unavailable now"}}).bytes())
    (tmp_path / "c.hdf5").write_bytes(hdf5.Tree({}, {"/": {"llm_description": "one", "which_llm_description": np.int64(2)}}).bytes())
    paths = hdf5.files(spark, str(tmp_path))
    assert sorted(r.task for r in hdf5.described(hdf5.members(paths)).collect()) == ["one", "second"]
    poses = {r.row: r.pose for r in hdf5.joint_places(paths).collect()}
    for k in range(6):
        assert poses[k] == [*left[k, :3, 3].tolist(), *camera[k, :3, 3].astype(float).tolist()]
    joint, end, turn = rng.normal(size=(4, 14)), rng.normal(size=(5, 2, 3)), rng.normal(size=(5, 2, 4))
    (tmp_path / "p.h5").write_bytes(hdf5.Tree({"action": {"joint": {"position": joint}, "end": {"position": end, "orientation": turn}}}).bytes())
    (tmp_path / "q.h5").write_bytes(hdf5.Tree({"action": {"end": {"position": end, "orientation": turn}}}).bytes())
    (tmp_path / "r.h5").write_bytes(hdf5.Tree({"action": {"end": {"position": end}}}).bytes())
    (tmp_path / "s.h5").write_bytes(hdf5.Tree({"state": {}}).bytes())
    got = {}
    for r in hdf5.proprio_actions(hdf5.files(spark, str(tmp_path), "*.h5")).collect():
        got[r.path.rsplit("/", 1)[1], r.row] = r.action
    want = {("p.h5", k): joint[k].tolist() for k in range(4)} | {("q.h5", k): [*end[k].ravel(), *turn[k].ravel()] for k in range(5)} | {("r.h5", k): end[k].ravel().tolist() for k in range(5)}
    assert got == want


def test_small_archives_share_tasks(spark, tmp_path):
    from tracklake.sources import archives, ranges

    for k in range(600):
        (tmp_path / f"{k:03d}.tar").write_bytes(bytes(1024))
    few = max(spark.sparkContext.defaultParallelism, -(-600 // ranges.TASK_FILES))
    assert archives.tar_index(spark, str(tmp_path)).rdd.getNumPartitions() == few and archives.tar_index(spark, str(tmp_path)).count() == 0
    assert ranges.dealt(spark, [("a", ranges.TASK_BYTES * 9), ("b", ranges.TASK_BYTES * 9)]).rdd.getNumPartitions() == 2
    assert ranges.dealt(spark, []).count() == 0


def test_small_hdf5_files_share_tasks(spark, tmp_path):
    from tracklake.sources import hdf5, ranges

    for k in range(600):
        (tmp_path / f"{k:03d}.hdf5").write_bytes(bytes(8))
    paths = hdf5.files(spark, str(tmp_path))
    assert paths.rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, -(-600 // ranges.TASK_FILES))
    assert hdf5.members(paths).where("error is not null").count() == 600


def test_rows_of_listed_files_are_no_small_table(spark, tmp_path):
    """What is read of a few files may be large: a join is planned by its rows, and not broadcast for the size of the list."""
    import io
    import tarfile

    import numpy as np

    from tracklake.sources import archives, hdf5

    n = 20_000
    (tmp_path / "a.hdf5").write_bytes(hdf5.Tree({"x": np.zeros((n, 2))}).bytes())
    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        for k in range(n):
            tar.addfile(tarfile.TarInfo(str(k)), io.BytesIO())
    rows = [hdf5.array_rows(hdf5.files(spark, str(tmp_path)), "x").select("row", "path"), archives.tar_index(spark, str(tmp_path)).select(F.col("member").cast("bigint").alias("row"), "path")]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        for read in rows:
            joined = read.join(spark.range(n).withColumnRenamed("id", "row"), "row")
            assert len(joined.collect()) == n
            assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
