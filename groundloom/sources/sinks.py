"""Writers and the content marks that keep them from overwriting different results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from groundloom.functions.numeric import micro


def raster_fingerprint(grid: DataFrame) -> DataFrame:
    """Order-free mark of a raster's content: cell count, extremes and a position-weighted sum."""
    z = micro("z")
    place = F.col("i") * 31 + F.col("j") * 17 + 1
    term = place * (z % 65521 + 65521) % 2147483647
    return grid.groupBy("scene_id").agg(F.count(F.lit(1)).alias("cells"), F.min(z).alias("low"), F.max(z).alias("high"), F.sum(term).alias("mark"))


def obj_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """OBJ lines per scene in writing order (section, ord): used vertices renumbered densely from 1."""
    from groundloom.functions.numeric import rounded
    from groundloom.operators import sequence

    corner = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("vid")) for k, c in enumerate("abc")]))
    corners = faces.select("scene_id", "fid", corner.alias("c")).select("scene_id", "fid", "c.k", "c.vid")
    used = vertices.join(corners.select("scene_id", "vid").distinct(), ["scene_id", "vid"], "left_semi")
    used = sequence.row_number(used, ["scene_id"], ["vid"], "n", 4.0 * 1048576)
    xyz = [rounded(c) for c in ("x", "y", "z")]
    v = used.select("scene_id", F.lit(0).alias("section"), F.col("vid").alias("ord"), F.format_string("v %.6f %.6f %.6f", *xyz).alias("line"))
    at = corners.join(used.select("scene_id", "vid", "n"), ["scene_id", "vid"])
    place = lambda k: F.max(F.when(F.col("k") == k, F.col("n")))
    f = at.groupBy("scene_id", "fid").agg(*[place(k).alias(f"n{k}") for k in range(3)])
    f = f.select("scene_id", F.lit(1).alias("section"), F.col("fid").alias("ord"), F.format_string("f %d %d %d", "n0", "n1", "n2").alias("line"))
    return v.unionByName(f)


def camera_csv(rows: DataFrame, path: str) -> None:
    """Camera table as CSV: floats with six digits, NULL as an empty field."""
    cols = [F.when(F.col(n).isNotNull(), F.format_string("%.6f", F.col(n))).alias(n) if k in ("double", "float") else F.col(n).cast("string").alias(n) for n, k in rows.dtypes]
    rows.select(*cols).write.mode("errorifexists").option("header", "true").option("nullValue", "").option("emptyValue", "").csv(path)


def write_obj(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """OBJ text per scene, in order, in as many files as the lines need."""
    lines = obj_lines(vertices, faces)
    ordered = lines.repartitionByRange("scene_id", "section", "ord").sortWithinPartitions("scene_id", "section", "ord")
    ordered.select("scene_id", F.col("line").alias("value")).write.mode("errorifexists").partitionBy("scene_id").text(path)


def write_raster(grid: DataFrame, meta: DataFrame, cell: float, path: str) -> str:
    """Persist a raster with its frame; identical content stays as it is, different content is never overwritten.

    Returns 'written', 'unchanged' or raises FileExistsError.
    """
    spark = grid.sparkSession
    mark = raster_fingerprint(grid)
    target = spark._jvm.org.apache.hadoop.fs.Path(path + "/mark")
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        old = spark.read.parquet(path + "/mark")
        if old.exceptAll(mark).isEmpty() and mark.exceptAll(old).isEmpty():
            return "unchanged"
        raise FileExistsError(f"{path} holds a raster with different content")
    grid.select("scene_id", "i", "j", "z").repartition("scene_id", F.floor(F.col("i") / 256), F.floor(F.col("j") / 256)).write.mode("errorifexists").parquet(path + "/cells")
    frame = meta.select("scene_id", "x0", "y1", "nx", "ny", F.lit(cell).alias("cell"), F.lit("local").alias("crs"), F.lit("null").alias("nodata"))
    frame.write.mode("errorifexists").parquet(path + "/meta")
    mark.write.mode("errorifexists").parquet(path + "/mark")  # last: its presence says the rest is whole
    return "written"
