"""Readers of camera models, scene documents and file listings."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

# camera models by id: name and number of parameters; fixed values of the public format
MODELS = {0: ("SIMPLE_PINHOLE", 3), 1: ("PINHOLE", 4), 2: ("SIMPLE_RADIAL", 4), 3: ("RADIAL", 5), 4: ("OPENCV", 8), 5: ("OPENCV_FISHEYE", 8),
          6: ("FULL_OPENCV", 12), 7: ("FOV", 5), 8: ("SIMPLE_RADIAL_FISHEYE", 4), 9: ("RADIAL_FISHEYE", 5), 10: ("THIN_PRISM_FISHEYE", 12)}


def binary_files(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(path).select("path", "content")


def _each(parse):
    """Rows of every file; a file is one model's binary table."""

    def run(batches):
        for files in batches:
            for path, content in zip(files["path"], files["content"]):
                model = path.rsplit("/", 1)[0]
                rows = parse(content)
                rows.insert(0, "model", model)
                yield rows

    return run


def _cameras(b: bytes) -> pd.DataFrame:
    (n,), at, out = struct.unpack_from("<Q", b), 8, []
    for _ in range(n):
        cid, model, w, h = struct.unpack_from("<iiQQ", b, at)
        name, k = MODELS[model]
        params = list(struct.unpack_from(f"<{k}d", b, at + 24))
        at += 24 + 8 * k
        out.append((cid, name, w, h, params))
    return pd.DataFrame(out, columns=["camera_id", "camera_model", "width", "height", "params"])


def _images(b: bytes) -> pd.DataFrame:
    (n,), at, out = struct.unpack_from("<Q", b), 8, []
    for _ in range(n):
        head = struct.unpack_from("<i7di", b, at)
        at += 64
        end = b.index(b"\0", at)
        name = b[at:end].decode()
        (m,) = struct.unpack_from("<Q", b, end + 1)
        at = end + 9
        obs = [{"x": x, "y": y, "pid": p} for x, y, p in struct.iter_unpack("<ddq", b[at:at + 24 * m])]
        at += 24 * m
        out.append((head[0], name, head[8], *head[1:8], obs))
    return pd.DataFrame(out, columns=["image_id", "name", "camera_id", "qw", "qx", "qy", "qz", "tx", "ty", "tz", "observations"])


def _points(b: bytes) -> pd.DataFrame:
    (n,), at, out = struct.unpack_from("<Q", b), 8, []
    for _ in range(n):
        pid, x, y, z, r, g, bl, err, track = struct.unpack_from("<q3d3BdQ", b, at)
        at += 51 + 8 * track
        out.append((pid, x, y, z, err, track))
    return pd.DataFrame(out, columns=["point_id", "x", "y", "z", "err", "track"])


def camera_models(spark: SparkSession, path: str) -> DataFrame:
    return binary_files(spark, path, "cameras.bin").mapInPandas(_each(_cameras), "model string, camera_id int, camera_model string, width bigint, height bigint, params array<double>")


def image_poses(spark: SparkSession, path: str) -> DataFrame:
    schema = "model string, image_id int, name string, camera_id int, qw double, qx double, qy double, qz double, tx double, ty double, tz double, observations array<struct<x: double, y: double, pid: bigint>>"
    return binary_files(spark, path, "images.bin").mapInPandas(_each(_images), schema)


def observations(poses: DataFrame) -> DataFrame:
    """Sightings of triangulated points (-1 marks none)."""
    o = poses.select("model", "image_id", "name", F.explode("observations").alias("o"))
    return o.select("model", "image_id", "name", "o.x", "o.y", "o.pid").where("pid >= 0")


def sparse_points(spark: SparkSession, path: str) -> DataFrame:
    return binary_files(spark, path, "points3D.bin").mapInPandas(_each(_points), "model string, point_id bigint, x double, y double, z double, err double, track bigint")


# document formats and the newest version read of each: fixed values
FORMATS = {"dlcameras": 3, "dlsite": 1, "dlsun": 1, "dlscene": 1, "dlscenes": 1}


def scene_documents(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """JSON documents of one format; ``status`` tells the ones that are of another or of a newer version."""
    d = spark.read.schema(f"format string, version int, {schema}").option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    status = F.when(F.col("format").isNull() | (F.col("format") != kind), "other format").when(F.col("version") > FORMATS[kind], "newer version").otherwise("ok")
    return d.withColumn("status", status)


def file_listing(spark: SparkSession, path: str, hashed: bool = True) -> DataFrame:
    """Every file with size and time, and its sha256 where wanted; contents are only read when hashed."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    cols = ["path", F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime")]
    return f.select(*cols, *([F.sha2("content", 256).alias("sha256")] if hashed else []))
