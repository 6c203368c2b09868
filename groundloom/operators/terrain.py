"""Ground and surface models: cell choice, ground reports, contours, block roughness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from groundloom.functions.numeric import exact_sum, finite, rounded
from groundloom.operators import raster
from groundloom.operators.order_stats import quantiles
from groundloom.session import cut_lineage

KEY = raster.KEY


def density_step(points: DataFrame, cells: DataFrame, min_points: int, keep: float) -> DataFrame:
    """One coarsening round. ``cells`` is (scene_id, cell, settled, rounds)."""
    low = points.groupBy("scene_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    # a scene that has settled is left out of the scan of its points
    at = points.join(low, "scene_id").join(cells.where("NOT settled"), "scene_id")
    counts = at.groupBy(
        "scene_id", F.floor((F.col("x") - F.col("x0")) / F.col("cell")).alias("ix"), F.floor((F.col("y") - F.col("y0")) / F.col("cell")).alias("iy")
    ).agg(F.count(F.lit(1)).alias("n"))
    tally = counts.groupBy("scene_id", "n").agg(F.count(F.lit(1)).alias("times"))
    # few distinct counts exist, so the quantile works on (count, times) pairs
    floor_q = tally.groupBy("scene_id").agg(F.percentile("n", F.lit(1.0 - keep), F.col("times")).alias("q"), F.sum("times").alias("occupied"))
    grown = F.col("cell") * F.least(F.lit(2.0), F.sqrt(F.lit(float(min_points)) / F.greatest(F.col("q"), F.lit(0.5))))
    enough = F.col("q") >= min_points
    return cells.join(floor_q, "scene_id", "left").select(
        "scene_id",
        F.when(F.col("settled") | enough, F.col("cell")).otherwise(grown).alias("cell"),
        (F.col("settled") | F.coalesce(enough, F.lit(True))).alias("settled"),
        (F.col("rounds") + F.when(F.col("settled"), 0).otherwise(1)).cast("int").alias("rounds"),
    )


def density_cell(points: DataFrame, start: Column, min_points: int = 2, keep: float = 0.75, rounds: int = 6) -> DataFrame:
    """Per scene, coarsen the cell until enough of the occupied cells hold ``min_points``."""
    state = raster.extents(points).select("scene_id", start.alias("cell"), F.lit(False).alias("settled"), F.lit(0).alias("rounds"))
    for _ in range(rounds):
        state = cut_lineage(density_step(points, state, min_points, keep))
        if state.where("NOT settled").isEmpty():
            break
    return state.select("scene_id", rounded("cell", 4).alias("cell"), "settled", "rounds")


def contour_interval(points: DataFrame) -> DataFrame:
    """The first round step that cuts the 2-98 % height span into at most 40."""
    q = quantiles(points, ["scene_id"], "z", {"lo": 0.02, "hi": 0.98})
    span = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-9))
    steps = F.array(*[F.lit(s) for s in raster.NICE])
    ok = F.filter(steps, lambda s: span / s <= 40)
    return q.select("scene_id", "lo", "hi", F.coalesce(F.try_element_at(ok, F.lit(1)), F.lit(raster.NICE[-1])).alias("step"))


# marching squares, fixed values: corner bits top-left 1, top-right 2, bottom-right 4, bottom-left 8;
# each pair names the edge (Top, Right, Bottom, Left) a contour enters by and the one it leaves by,
# so that higher ground is always on its left
CONTOUR_CASES = {
    1: "LT", 2: "TR", 3: "LR", 4: "RB", 6: "TB", 7: "LB", 8: "BL", 9: "BT", 11: "BR", 12: "RL", 13: "RT", 14: "TL",
}
SADDLE_HIGH = {5: ("RT", "LB"), 10: ("TL", "BR")}
SADDLE_LOW = {5: ("LT", "RB"), 10: ("TR", "BL")}


def contour_segments(grid: DataFrame, meta: DataFrame, cell: float, step: float) -> DataFrame:
    """Line segments where the raster crosses each multiple of ``step``."""
    low, high = F.least("nw", "ne", "sw", "se"), F.greatest("nw", "ne", "sw", "se")
    b = raster.full_blocks(grid)
    first, last = F.ceil(low / step).cast("bigint"), F.ceil(high / step).cast("bigint") - 1
    b = b.where(first <= last).withColumn("k", F.explode(F.sequence(first, last))).withColumn("level", F.col("k") * step)
    above = lambda c: F.when(F.col(c) > F.col("level"), 1).otherwise(0)
    b = b.withColumn("mask", above("nw") + above("ne") * 2 + above("se") * 4 + above("sw") * 8)
    centre = (F.col("nw") + F.col("ne") + F.col("se") + F.col("sw")) / 4 > F.col("level")
    pairs = F.array().cast("array<string>")
    for m, p in CONTOUR_CASES.items():
        pairs = F.when(F.col("mask") == m, F.array(F.lit(p))).otherwise(pairs)
    for m in (5, 10):
        hi, lo = (F.array(*[F.lit(p) for p in t[m]]) for t in (SADDLE_HIGH, SADDLE_LOW))
        pairs = F.when((F.col("mask") == m) & centre, hi).when(F.col("mask") == m, lo).otherwise(pairs)
    b = b.join(meta.select("scene_id", "x0", "y1"), "scene_id").select("*", F.posexplode(pairs).alias("part", "pair"))
    # the crossing on each edge: start corner, end corner, and the edge's own name
    x = lambda dj: F.col("x0") + (F.col("j") + dj + 0.5) * cell
    y = lambda di: F.col("y1") - (F.col("i") + di + 0.5) * cell
    edges = {"T": ("nw", "ne", 0, 0, 0, 1, "H"), "B": ("sw", "se", 1, 0, 1, 1, "H"), "L": ("nw", "sw", 0, 0, 1, 0, "V"), "R": ("ne", "se", 0, 1, 1, 1, "V")}

    def crossing(letter: Column, what: str) -> Column:
        out = F.lit(None)
        for e, (p, q, i0, j0, i1, j1, kind) in edges.items():
            t = F.when(F.col(q) != F.col(p), (F.col("level") - F.col(p)) / (F.col(q) - F.col(p))).otherwise(F.lit(0.5))
            v = {
                "x": x(j0) + t * (x(j1) - x(j0)), "y": y(i0) + t * (y(i1) - y(i0)),
                "key": F.concat_ws(":", F.lit(kind), (F.col("i") + i0).cast("string"), (F.col("j") + j0).cast("string")),
            }[what]
            out = F.when(letter == e, v).otherwise(out)
        return out

    a, z = F.substring("pair", 1, 1), F.substring("pair", 2, 1)
    return b.select(
        "scene_id", "k", "level", "i", "j", "part",
        crossing(a, "key").alias("e1"), crossing(z, "key").alias("e2"),
        crossing(a, "x").alias("ax"), crossing(a, "y").alias("ay"), crossing(z, "x").alias("bx"), crossing(z, "y").alias("by"),
    )


def block_of(points: DataFrame, meta: DataFrame, size: float) -> DataFrame:
    at = points.join(meta.select("scene_id", F.col("x0").alias("_x0"), F.col("y1").alias("_y1")), "scene_id")
    return at.withColumn("bi", F.floor((F.col("_y1") - F.col("y")) / size).cast("bigint")).withColumn(
        "bj", F.floor((F.col("x") - F.col("_x0")) / size).cast("bigint")).drop("_x0", "_y1")


def block_roughness(
    points: DataFrame, grid: DataFrame, meta: DataFrame, cell: float, block: int = 2,
    ground_cells: float = 1.5, rough: float = 0.3, above: float = 0.1, min_ground: int = 8,
) -> DataFrame:
    """Per block: spread of the ground points about the raster, share of points standing above it,
    and whether the block may be a mesh. Ground and all points share one pass."""
    at = block_of(raster.bilinear(points, grid, meta, cell, "ground"), meta, cell * block).where("ground IS NOT NULL")
    res = F.when(F.col("is_ground"), F.col("z") - F.col("ground"))
    up = F.when(F.col("z") - F.col("ground") > ground_cells * cell, 1).otherwise(0)
    g = at.groupBy("scene_id", "bi", "bj").agg(
        F.count(res).alias("n_ground"), exact_sum(res).alias("s1"), (exact_sum(res * res)).alias("s2"),
        F.count(F.lit(1)).alias("n_points"), F.sum(up).alias("n_up"),
    )
    n = F.greatest(F.col("n_ground"), F.lit(1))
    m1 = F.coalesce("s1", F.lit(0.0)) / n
    m2 = F.coalesce("s2", F.lit(0.0)) / n
    g = g.withColumn("spread", F.sqrt(F.greatest(m2 - m1 * m1, F.lit(0.0))) / cell).withColumn("share_up", F.col("n_up") / F.col("n_points"))
    ok = (F.col("n_ground") >= min_ground) & (F.col("spread") <= rough) & (F.col("share_up") <= above)
    return g.select("scene_id", "bi", "bj", "n_ground", "n_points", "spread", "share_up", ok.alias("mesh"))


def finite_points(points: DataFrame) -> DataFrame:
    return points.where(finite("x") & finite("y") & finite("z"))
