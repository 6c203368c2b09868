"""Registered queries that go through files and streams, on tables derived from the given ones.

Scratch tables go to the session's checkpoint folder, which every executor reaches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from groundloom.plans.catalog import query
from groundloom.plans.tables import CELL
from groundloom.plans.logs import PARSED
from groundloom.session import ensure_checkpoint_dir
from groundloom.sources import ply, sinks
from groundloom.streaming import live

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def scratch(t, name: str) -> str:
    return f"{ensure_checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("ply_scan", "SELECT scene_id, count(*) AS points, CAST(sum(CAST(floor(CAST(CAST(x AS FLOAT) AS DOUBLE)*1e4+5e-1) AS BIGINT)) AS BIGINT) AS sum_x, CAST(sum(r) AS BIGINT) AS sum_r FROM points GROUP BY 1", "points")
def ply_scan(t):
    """Points written as PLY files, read back with only the columns asked for."""
    path = scratch(t, "ply")
    p = t.points.select("scene_id", "point_id", *[F.col(c).cast("float").alias(c) for c in "xyz"], *[F.col(c).cast("smallint").alias(c) for c in "rgb"])
    ply.write_table(p, path, ["x", "y", "z", "r", "g", "b"])
    back = ply.read_table(t.spark, path, "path string, row bigint, x float, r smallint")
    scene = F.regexp_extract("path", r"scene-(\d+)-", 1).cast("int")
    return back.groupBy(scene.alias("scene_id")).agg(F.count(F.lit(1)).alias("points"), F.sum(F.floor(F.col("x").cast("double") * 1e4 + 0.5).cast("bigint")).alias("sum_x"), F.sum(F.col("r").cast("bigint")).alias("sum_r"))


@query("ply_scan_ascii", """WITH p AS (SELECT scene_id, point_id, floor(x*1e3+5e-1)/1e3 AS x, floor(y*1e3+5e-1)/1e3 AS y, r FROM points)
 SELECT scene_id, x, y, CAST(r AS DOUBLE) AS r, count(*) AS points FROM p GROUP BY 1,2,3,4""", "points")
def ply_scan_ascii(t):
    """Points written as text, read back from many stretches of each file."""
    path = scratch(t, "ascii")
    p = t.points.select("scene_id", "point_id", *[F.expr(f"floor({c}*1e3+5e-1)/1e3").alias(c) for c in "xy"], F.col("r").cast("int").alias("r"))
    ply.write_table(p, path, ["x", "y", "r"], ascii="true")
    back = ply.read_table(t.spark, path, "path string, row bigint, x double, y double, r int", rowsPerSplit=200)
    scene = F.regexp_extract("path", r"scene-(\d+)-", 1).cast("int")
    return back.groupBy(scene.alias("scene_id"), "x", "y", F.col("r").cast("double").alias("r")).agg(F.count(F.lit(1)).alias("points"))


@query("camera_csv_sink", "SELECT frame, printf('%.6f', px) AS px, CASE WHEN frame % 3 <> 0 THEN printf('%.6f', pz) END AS pz, scene_id FROM walk", "walk")
def camera_csv_sink(t):
    path = scratch(t, "csv")
    sinks.camera_csv(t.walk.select("scene_id", "frame", "px", F.when(F.col("frame") % 3 != 0, F.col("pz")).alias("pz")), path)
    back = t.spark.read.option("header", "true").schema("scene_id int, frame bigint, px string, pz string").csv(path)
    return back.select("scene_id", "frame", "px", F.nullif("pz", F.lit("")).alias("pz"))


@query("raster_sink", "SELECT g.scene_id, count(*) AS cells, any_value(m.x0) AS x0, any_value(m.y1) AS y1, 5e-1 AS cell FROM grid g JOIN meta m ON m.scene_id=g.scene_id GROUP BY 1", "grid meta")
def raster_sink(t):
    path = scratch(t, "raster")
    sinks.write_raster(t.grid, t.meta, CELL, path)
    c = t.spark.read.parquet(path + "/cells").groupBy("scene_id").agg(F.count(F.lit(1)).alias("cells"))
    return c.join(t.spark.read.parquet(path + "/meta").select("scene_id", "x0", "y1", "cell"), "scene_id")


BATCHES = 5


def log_stream(t) -> DataFrame:
    """The log lines as a stream of five files in order of arrival: every third line comes five minutes late, so files hold lines that belong
    before those of the file before."""
    path = scratch(t, "log")
    lines = t.log_lines.withColumn("ts", F.col("ts").cast("timestamp"))
    arrival = F.unix_micros("ts") + F.when(F.pmod(F.xxhash64("job_id", "line_no"), F.lit(3)) == 0, 300_000_000).otherwise(0)
    lines = lines.withColumn("_at", arrival)
    first, last = lines.agg(F.min("_at"), F.max("_at")).first()
    for k in range(BATCHES):
        own = F.floor((F.col("_at") - first) * BATCHES / (last - first + 1)) == k
        lines.where(own).drop("_at").coalesce(1).write.mode("append").parquet(path)
    return t.spark.readStream.schema("job_id int, line_no bigint, ts timestamp, line string").option("maxFilesPerTrigger", 1).parquet(path)


def drained(t, stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over everything there is and return what it wrote."""
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    out = scratch(t, name)

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch(t, name + "-state")).trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return t.spark.read.parquet(out)


@query("job_state_stream", f"""WITH {PARSED} SELECT job_id::BIGINT AS job_id, arg_max(regexp_extract(trim(line), '\\]\\s+(\\S+)', 1), line_no) FILTER (kind='stage') AS stage, CAST(arg_max(regexp_extract(line, 'progress ([0-9]+)/', 1), line_no) FILTER (kind='progress') AS DOUBLE) AS done,
 CAST(arg_max(regexp_extract(line, 'kept ([0-9]+)', 1), line_no) FILTER (kind='kept') AS DOUBLE) AS frames, count(*) FILTER (kind='warning') AS warnings FROM parsed GROUP BY 1""", "log_lines")
def job_state_stream(t):
    """The stateful stream's last word per job equals the batch answer."""
    s = drained(t, live.job_state(log_stream(t)), "update", "state")
    last = F.max_by(F.struct("stage", "done", "frames", "warnings"), "epoch")
    return s.groupBy("job_id").agg(last.alias("s")).select("job_id", "s.stage", F.col("s.done").cast("double").alias("done"), F.col("s.frames").cast("double").alias("frames"), "s.warnings")


@query("progress_stream", f"""WITH {PARSED}, p AS (SELECT job_id::BIGINT AS job_id, line_no, epoch_us(ts) AS us, regexp_extract(line, 'progress ([0-9]+/[0-9]+.*)$', 1) AS key FROM parsed WHERE kind='progress'),
 q AS (SELECT *, lag(key) OVER w AS k0, lag(us) OVER w AS u0 FROM p WINDOW w AS (PARTITION BY job_id ORDER BY line_no)) SELECT job_id, line_no, key FROM q WHERE k0 IS NULL OR (k0<>key AND us-u0>=1000000)""", "log_lines")
def progress_stream(t):
    return drained(t, live.progress(log_stream(t)), "append", "progress").select("job_id", "line_no", "key")


@query("tail_stream", f"""WITH {PARSED}, k AS (SELECT job_id::BIGINT AS job_id, 'line' AS what, line_no, line FROM parsed WHERE kind <> 'progress' UNION ALL SELECT job_id, 'warning', line_no, line FROM parsed WHERE kind = 'warning'),
 r AS (SELECT *, row_number() OVER (PARTITION BY job_id, what ORDER BY line_no DESC) AS back FROM k) SELECT job_id, what, back, line_no, line FROM r WHERE back <= CASE what WHEN 'line' THEN 40 ELSE 3 END""", "log_lines")
def tail_stream(t):
    """The last forty lines and three warnings of every job after the stream's last batch."""
    s = drained(t, live.tails(log_stream(t)), "update", "tail")
    newest = s.groupBy("job_id").agg(F.max("batch").alias("batch"))
    return s.join(newest, ["job_id", "batch"], "left_semi").select("job_id", "what", "back", "line_no", "line")
