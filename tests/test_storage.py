"""Files in and out, on files made here."""

import json
import pickle
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundloom.sources import ply, scans, sinks
from groundloom.streaming import jobs, live


def test_ply_round_trip_and_retry_safe_listing(spark, tmp_path):
    p = str(tmp_path / "cloud")
    df = spark.range(2500).selectExpr("CAST(id % 3 AS INT) AS scene_id", "id AS row", "CAST(id AS FLOAT)/8 AS x", "CAST(id*2 AS DOUBLE) AS y", "CAST(id % 256 AS SMALLINT) AS red")
    ply.write_table(df, p, ["x", "y", "red"])
    (tmp_path / "cloud" / "scene-0-999-0.ply").write_bytes(b"left by a lost task")
    back = ply.read_table(spark, p, rowsPerSplit=100)
    assert back.count() == 2500 and {"path", "row", "x", "y", "red"} == set(back.columns)
    assert back.agg(F.sum("y")).first()[0] == sum(2 * k for k in range(2500))
    only = ply.read_table(spark, p, "red smallint")
    assert only.agg(F.sum("red")).first()[0] == sum(k % 256 for k in range(2500))


def write(path, head, body):
    path.write_bytes("\n".join(["ply", *head, "end_header"]).encode() + b"\n" + body)
    return str(path)


def test_ascii_ply_splits_at_lines(spark, tmp_path):
    body = "".join(f"{k} {k / 4} {k % 7}\n" for k in range(500)).encode()
    f = write(tmp_path / "a.ply", ["format ascii 1.0", "element vertex 500", "property float x", "property double y", "property uchar q"], body)
    d = ply.read_table(spark, f, rowsPerSplit=20)
    assert d.count() == 500 and d.agg(F.sum("x")).first()[0] == sum(range(500))
    g = write(tmp_path / "b.ply", ["format ascii 1.0", "element vertex 2", "property float x", "property float y"], b"1 2\n3\n")
    with pytest.raises(Exception, match="expected"):
        ply.read_table(spark, g).count()


@pytest.mark.parametrize("split", [1, 1000])
def test_ascii_faces_are_no_points(spark, tmp_path, split):
    body = b"1 2 3 4\n\n5 6 7 8\n9 10 11 12\n3 0 1 2\n3 2 1 0\n"
    head = ["format ascii 1.0", "element vertex 3", *[f"property float {c}" for c in "xyzq"], "element face 2", "property list uchar int v"]
    d = ply.read_table(spark, write(tmp_path / "f.ply", head, body), rowsPerSplit=split)
    assert sorted(r.x for r in d.collect()) == [1, 5, 9]
    short = write(tmp_path / "g.ply", ["format ascii 1.0", "element vertex 4", "property float x"], b"1\n2\n3\n")
    with pytest.raises(Exception, match="3 vertices of 4"):
        ply.read_table(spark, short, rowsPerSplit=split).count()


@pytest.mark.parametrize("end", [b"\n", b""])
@pytest.mark.parametrize("split", [1, 3, 1000])
def test_ascii_without_a_last_newline(spark, tmp_path, end, split):
    """Every vertex once, numbered from 0, wherever stretches begin; one line is longer than a read."""
    body = b"\n".join([b"1 2", b"", b"3" + b" " * 70000 + b"4", b"5 6", b"7 8"]) + end
    f = write(tmp_path / "e.ply", ["format ascii 1.0", "element vertex 4", "property float x", "property float y"], body)
    for d in (ply.read_table(spark, f, rowsPerSplit=split * 100), spark.read.format("ply").option("rowsPerSplit", split * 100).load("file://" + f)):
        assert sorted((r.row, r.x, r.y) for r in d.collect()) == [(0, 1, 2), (1, 3, 4), (2, 5, 6), (3, 7, 8)]


def test_ply_keeps_large_integers_or_refuses(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, 2**40 + 7, 300)], "scene_id int, row long, big long, small smallint")
    ply.write_table(df, str(tmp_path / "a"), ["big", "small"])
    back = ply.read_table(spark, str(tmp_path / "a"), "big bigint, small smallint").first()
    assert (back.big, back.small) == (2**40 + 7, 300)
    with pytest.raises(Exception, match="2.53"):
        ply.write_table(df.withColumn("big", F.lit(2**60 + 1)), str(tmp_path / "b"), ["big"])
    with pytest.raises(Exception, match="no nulls"):
        ply.write_table(df.withColumn("big", F.lit(None).cast("long")), str(tmp_path / "c"), ["big"])


def test_job_state_over_many_batches(spark, tmp_path):
    """State adds up over micro-batches, an active job outlives the first timer, and a silent one goes."""
    lines = [(1, k, f"2026-01-01 10:{k:02d}:00", "    WARNING: only a few frames placed") for k in range(4)]
    lines += [(1, 4, "2026-01-02 09:00:00", "    WARNING: again"), (2, 0, "2026-01-02 09:30:00", "    WARNING: other"), (1, 5, "2026-01-02 20:00:00", "    WARNING: still here"),
              (2, 1, "2026-01-05 09:00:00", "    WARNING: late"), (2, 2, "2026-01-05 10:00:00", "    WARNING: late"), (1, 6, "2026-01-05 11:00:00", "    WARNING: back")]
    schema = "job_id int, line_no bigint, ts timestamp, line string"
    for n, row in enumerate(lines):
        df = spark.createDataFrame([row], "job_id int, line_no bigint, ts string, line string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "log" / f"b={n:02d}"))
    seen = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "log"))
    q = live.job_state(stream).writeStream.outputMode("update").foreachBatch(lambda b, _: seen.extend(b.select("job_id", "line_no", "warnings").collect())).option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.job_id, r.line_no): r.warnings for r in seen}
    assert [got[1, k] for k in range(6)] == [1, 2, 3, 4, 5, 6]
    assert got[2, 0] == 1 and got[1, 6] == 1  # three days of silence: begun anew


def played(spark, tmp_path, lines, stream_of, mode):
    """Rows that a stream writes for ``lines`` (one list a micro-batch), with the number of their batch."""
    for n, rows in enumerate(lines):
        df = spark.createDataFrame(rows, "job_id int, line_no bigint, ts string, line string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "log" / f"b={n:02d}"))
    seen = []
    stream = spark.readStream.schema("job_id int, line_no bigint, ts timestamp, line string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "log"))
    q = stream_of(stream).writeStream.outputMode(mode).foreachBatch(lambda b, k: seen.extend((k, r) for r in b.collect())).option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return seen


def shuffled_log(batches):
    """Lines of two jobs, shuffled within some minutes of each other and dealt over micro-batches; one is there twice."""
    r = np.random.default_rng(3)
    rows = []
    for job in (1, 2):
        for k in range(1, 121):
            line = ["[2/5] prune" if k % 40 == 7 else "[3/5] poses" if k % 40 == 21 else f"    ~ progress {k}/200 frames placed", "    WARNING: only a few frames placed", f"said {k}"][k % 3]
            rows.append((k * 4 + r.uniform(0, 60), (job, k, f"2026-01-01 10:{k * 4 // 60:02d}:{k * 4 % 60:02d}", line)))
    rows = [x for _, x in sorted(rows)]
    rows.append(rows[5])
    size = -(-len(rows) // batches)
    return [rows[k : k + size] for k in range(0, len(rows), size)]


def batch_of(spark, lines):
    df = spark.createDataFrame(sorted({x for b in lines for x in b}), "job_id int, line_no bigint, ts string, line string").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.parse(df)


def test_shuffled_lines_give_the_batch_answer(spark, tmp_path):
    lines = shuffled_log(5)
    seen = played(spark, tmp_path, lines, live.job_state, "update")
    last = {r.job_id: r for _, r in seen}
    p = batch_of(spark, lines)
    for w in jobs.state(p).collect():
        g = last[w.job_id]
        assert (g.stage, g.phase, g.done, g.total, g.frames, g.warnings) == (w.stage, w.phase, w.done, w.total, w.frames, w.warnings)
        want = {r.phase: r.seconds for r in jobs.phase_durations(p).where(F.col("job_id") == w.job_id).collect() if r.seconds}
        assert json.loads(g.spent) == pytest.approx(want)


def test_shuffled_progress_lines(spark, tmp_path):
    lines = shuffled_log(5)
    seen = played(spark, tmp_path, lines, live.progress, "append")
    want = sorted((r.job_id, r.line_no, r.key) for r in jobs.throttle(batch_of(spark, lines)).collect())
    assert sorted((r.job_id, r.line_no, r.key) for _, r in seen) == want and len(want) > 20


def test_stream_tails(spark, tmp_path):
    """After every micro-batch the tails are those of all lines so far, and never longer than they may be."""
    lines = shuffled_log(4)
    seen = played(spark, tmp_path, lines, live.tails, "update")
    so_far = set()
    for k, rows in enumerate(lines):
        so_far |= set(rows)
        for job in {x[0] for x in rows}:
            kept = sorted((n, line) for j, n, _, line in so_far if j == job and "~ progress" not in line)
            for what, want in (("line", kept[-40:]), ("warning", [x for x in kept if "WARNING" in x[1]][-3:])):
                got = sorted((r.line_no, r.line) for e, r in seen if e == k and r.job_id == job and r.what == what)
                assert got == want


@pytest.mark.parametrize("head,body,why", [
    (["format binary_big_endian 1.0", "element vertex 1", "property float x"], b"\0" * 4, "not supported"),
    (["format binary_little_endian 1.0", "element vertex 1", "property list uchar int v"], b"\0" * 4, "list"),
    (["format binary_little_endian 1.0", "element vertex 0", "property float x"], b"", "no vertices"),
    (["format binary_little_endian 1.0", "element vertex 9", "property float x"], b"\0" * 8, "truncated"),
])
def test_bad_ply_is_refused(spark, tmp_path, head, body, why):
    f = write(tmp_path / "x.ply", head, body)
    with pytest.raises(Exception, match=why):
        ply.read_table(spark, f).count()


def test_camera_models(spark, tmp_path):
    m = tmp_path / "scene" / "0"
    m.mkdir(parents=True)
    (m / "cameras.bin").write_bytes(struct.pack("<QiiQQ4d", 1, 7, 1, 640, 480, 500.0, 501.0, 320.0, 240.0))
    obs = struct.pack("<ddqddq", 1.5, 2.5, 11, 3.0, 4.0, -1)
    (m / "images.bin").write_bytes(struct.pack("<Qi7di", 1, 3, 1.0, 0.0, 0.0, 0.0, 5.0, 6.0, 7.0, 7) + b"frame_00003.jpg\0" + struct.pack("<Q", 2) + obs)
    (m / "points3D.bin").write_bytes(struct.pack("<Qq3d3BdQ", 1, 11, 1.0, 2.0, 3.0, 9, 8, 7, 0.5, 2) + struct.pack("<iiii", 3, 0, 4, 1))
    c = scans.camera_models(spark, str(tmp_path)).first()
    assert (c["camera_id"], c["camera_model"], c["params"][1]) == (7, "PINHOLE", 501.0)
    i = scans.image_poses(spark, str(tmp_path))
    assert i.first()["name"] == "frame_00003.jpg" and i.first()["tz"] == 7.0
    assert [r["pid"] for r in scans.observations(i).collect()] == [11]
    assert scans.sparse_points(spark, str(tmp_path)).first()["track"] == 2


def test_documents_are_guarded(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"format": "dlcameras",\n "version": 3, "count": 2}')
    (tmp_path / "b.json").write_text('{"format": "dlcameras", "version": 9, "count": 2}')
    (tmp_path / "c.json").write_text('{"count": 2}')
    s = scans.scene_documents(spark, str(tmp_path), "dlcameras", "count int")
    assert sorted(r["status"] for r in s.collect()) == ["newer version", "ok", "other format"]
    listed = scans.file_listing(spark, str(tmp_path)).count()
    assert listed == 3


def test_raster_is_never_overwritten(spark, tmp_path):
    g = spark.createDataFrame([(0, 0, 0, 1.5), (0, 0, 1, 2.5)], "scene_id int, i bigint, j bigint, z double")
    m = spark.createDataFrame([(0, 0.0, 1.0, 2, 1)], "scene_id int, x0 double, y1 double, nx bigint, ny bigint")
    p = str(tmp_path / "r")
    assert sinks.write_raster(g, m, 0.5, p) == "written"
    assert sinks.write_raster(g, m, 0.5, p) == "unchanged"
    with pytest.raises(FileExistsError):
        sinks.write_raster(g.withColumn("z", F.col("z") + 1), m, 0.5, p)


def test_obj_files(spark, tmp_path):
    v = spark.createDataFrame([(0, 5, 0.0, 0.0, 0.0), (0, 7, 1.0, 0.0, 0.0), (0, 9, 0.0, 1.0, 0.0), (0, 8, 9.0, 9.0, 9.0)], "scene_id int, vid bigint, x double, y double, z double")
    f = spark.createDataFrame([(0, 1, 5, 7, 9)], "scene_id int, fid bigint, a bigint, b bigint, c bigint")
    sinks.write_obj(v, f, str(tmp_path / "o"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "o")).collect()]
    assert "f 1 2 3" in lines and sum(x.startswith("v ") for x in lines) == 3


@pytest.mark.parametrize("text", ["true", "false"])
def test_small_stretches_share_tasks(spark, tmp_path, text):
    """Many small files cut into short stretches: the tasks are bounded by bytes, the rows are whole, and no task is sent the first pass."""
    rows = [(s, k, float(k) / 4, s) for s in range(120) for k in range(40)]
    p = str(tmp_path / "many")
    ply.write_table(spark.createDataFrame(rows, "scene_id int, point_id bigint, x double, r int"), p, ["x", "r"], ascii=text)
    d = ply.read_table(spark, p, "path string, row bigint, x double, r int", rowsPerSplit=5)
    assert d.rdd.getNumPartitions() <= 2 * ply.TASKS
    assert sorted((q.r, q.x) for q in d.collect()) == sorted((s, x) for s, _, x, _ in rows)
    reader = pickle.loads(pickle.dumps(ply.PlyReader(d.schema, {"path": p, "surveyed": "[]"})))
    assert reader.options == {"path": p}
