"""Cloth simulation ground filter (Zhang et al. 2016, doi:10.3390/rs8060501)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from groundloom.operators import raster, tiles


def cloth_floor(points: DataFrame, res: float) -> DataFrame:
    """Every cloth cell with the highest inverted height in it; a cell nothing was seen in has the scene's lowest.
    Columns scene_id, iy, ix, floor, unseen, ny, nx, start, drop."""
    e = raster.extents(points)
    n = lambda lo, hi: F.ceil((F.col(hi) - F.col(lo)) / res).cast("bigint") + 2
    frame = e.select("scene_id", n("y0", "y1").alias("ny"), n("x0", "x1").alias("nx"), (-F.col("z1")).alias("lowest"),
                     (-F.col("z0") + res).alias("start"), F.greatest((F.col("z1") - F.col("z0")) / 200, F.lit(1e-6)).alias("drop"))
    every = frame.withColumn("iy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("ny") - 1)))
    every = every.withColumn("ix", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nx") - 1)))
    seen = raster.floor_cells(points, res)
    c = every.join(seen, ["scene_id", "iy", "ix"], "left")
    return c.select("scene_id", "iy", "ix", F.coalesce("floor", "lowest").alias("floor"), F.col("floor").isNull().alias("unseen"), "ny", "nx", "start", "drop")


def classify(points: DataFrame, res: float, threshold: float, rigidness: int = 3, iterations: int = 300) -> DataFrame:
    """Points with ``ground``: within ``threshold`` of where the cloth came to rest."""
    cells = cloth_floor(points, res).select("scene_id", F.col("iy").alias("i"), F.col("ix").alias("j"), "ny", "nx", "floor", "drop", F.col("start").alias("cloth"))
    rest = tiles.rounds(cells, ["floor", "drop", "cloth"], tiles.drape(max(1, rigidness)), reach=max(1, rigidness), sweeps=iterations)
    low = points.groupBy("scene_id").agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"))
    at = points.join(low, "scene_id").withColumn("i", F.floor((F.col("y") - F.col("_y0")) / res).cast("bigint")).withColumn("j", F.floor((F.col("x") - F.col("_x0")) / res).cast("bigint"))
    at = at.join(rest.select("scene_id", "i", "j", "cloth"), ["scene_id", "i", "j"])
    return at.withColumn("ground", F.abs(-F.col("z") - F.col("cloth")) <= threshold).drop("i", "j", "_x0", "_y0", "cloth")
