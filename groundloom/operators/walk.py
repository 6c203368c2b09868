"""The filmed walk: an ordered line of camera positions per scene."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from groundloom.functions.numeric import exact_sum, exact_mean, micro
from groundloom.operators import meet, nearest, sequence
from groundloom.operators.order_stats import quantiles
from groundloom.session import cut_lineage

WHOLE = 1 << 20  # points of a scene that one group holds
WIDTH = 128  # frames per chunk: small enough to spread one very long walk


def dense_index(walk: DataFrame) -> DataFrame:
    """1-based position of each frame in its walk."""
    return sequence.row_number(walk, ["scene_id"], ["frame"], "k", WIDTH)


def with_next(walk: DataFrame) -> DataFrame:
    return sequence.neighbour(walk, ["scene_id"], ["frame"], {"nx_": F.col("px"), "ny_": F.col("py"), "nz_": F.col("pz"), "nframe": F.col("frame")}, True, WIDTH)


def cumulative_length(walk: DataFrame, plan: bool = False) -> DataFrame:
    """Adds ``step`` (length to the next frame; NULL on the last) and ``start`` (length walked before).

    Lengths add up in whole micro-units, so the result does not depend on the chunking.
    """
    w = with_next(walk)
    dx, dy, dz = (F.col(n) - F.col(p) for n, p in (("nx_", "px"), ("ny_", "py"), ("nz_", "pz")))
    square = dx * dx + dy * dy if plan else dx * dx + dy * dy + dz * dz
    w = w.withColumn("step", F.sqrt(square))
    w = sequence.running_sum(w, ["scene_id"], ["frame"], F.coalesce(micro("step"), F.lit(0)), "_start", WIDTH, inclusive=False)
    return w.withColumn("start", F.col("_start").cast("double") / 1e6).drop("_start")


def length_and_extent(walk: DataFrame) -> DataFrame:
    s = cumulative_length(walk)
    e = s.groupBy("scene_id").agg(
        (exact_sum("step")).alias("length"), F.count(F.lit(1)).alias("frames"),
        *[(F.max(c) - F.min(c)).alias("e" + c[-1]) for c in ("px", "py", "pz")],
    )
    return e.select("scene_id", "frames", "length", F.sqrt(F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey") + F.col("ez") * F.col("ez")).alias("extent"))


def segments(walk: DataFrame) -> DataFrame:
    """Plan segments of the walk line; those shorter than 1e-6 are left out."""
    s = cumulative_length(walk, plan=True).where("nframe IS NOT NULL")
    s = s.where((F.col("nx_") - F.col("px")) * (F.col("nx_") - F.col("px")) + (F.col("ny_") - F.col("py")) * (F.col("ny_") - F.col("py")) >= 1e-12)
    return s.select("scene_id", F.col("frame").alias("seg"), F.col("px").alias("a_x"), F.col("py").alias("a_y"), F.col("nx_").alias("b_x"), F.col("ny_").alias("b_y"), "start", "step")


def along_walk(points: DataFrame, walk: DataFrame, depth: int | None = None) -> DataFrame:
    """Distance, along and signed across (left +) of each point to the walk line."""
    n = nearest.nearest(points, segments(walk), {"x": "x", "y": "y"}, ["point_id", "x", "y", "z"], "seg", ["seg", "start", "step", "a_x", "a_y", "b_x", "b_y"], depth)
    side = F.signum((F.col("b_x") - F.col("a_x")) * (F.col("y") - F.col("a_y")) - (F.col("b_y") - F.col("a_y")) * (F.col("x") - F.col("a_x")))
    return n.select("scene_id", "point_id", "x", "y", "z", "seg", "distance", (F.col("start") + F.col("t") * F.col("step")).alias("along"), (side * F.col("distance")).alias("across"))


def corridor(points: DataFrame, walk: DataFrame, half_width: float, first: int | None = None, last: int | None = None, least: int = 100) -> DataFrame:
    """Points within ``half_width`` of the walk, or of its frames first..last (1-based, either order).

    ``status`` is 'ok', or says why a scene's corridor cannot be used.
    """
    line = walk
    if first is not None and last is not None:
        lo, hi = min(first, last), max(first, last)
        k = dense_index(walk)
        total = walk.groupBy("scene_id").agg(F.count(F.lit(1)).alias("_n"))
        k = k.join(total, "scene_id").where((F.col("k") >= max(1, lo)) & (F.col("k") <= F.least(F.lit(hi), F.col("_n"))))
        line = k.drop("k", "_n")
    inside = along_walk(points, line).where(F.col("distance") <= half_width)
    counts = inside.groupBy("scene_id").agg(F.count(F.lit(1)).alias("_kept"))
    return inside.join(counts, "scene_id").withColumn("status", F.when(F.col("_kept") < least, "too few points").otherwise("ok")).drop("_kept")


def profile(along: DataFrame, band: float) -> DataFrame:
    """Mean height per band along the walk; bands under ten points are dropped."""
    k = F.floor(F.col("along") / band).cast("bigint")
    g = along.groupBy("scene_id", k.alias("band")).agg(exact_mean("z").alias("mean_z"), F.count(F.lit(1)).alias("points"))
    return g.where("points >= 10").select("scene_id", (F.col("band") * band).alias("from"), ((F.col("band") + 1) * band).alias("to"), "mean_z", "points")


def grade(along: DataFrame) -> DataFrame:
    """Least-squares fall along the walk: sums of micro-units give slope and intercept."""
    s = along.groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("n"), *[(exact_sum(e)).alias(a) for a, e in (
            ("sx", F.col("along")), ("sy", F.col("z")), ("sxx", F.col("along") * F.col("along")), ("sxy", F.col("along") * F.col("z")))],
        (F.max("along") - F.min("along")).alias("run"))
    s = s.where("n > 2 AND run > 0")
    slope = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    return s.withColumn("slope", slope).select("scene_id", "n", "run", (-F.col("slope") * F.col("run")).alias("fall"), (-F.col("slope") * 100).alias("grade_percent"))


def held_height(points: DataFrame, walk: DataFrame, share: float = 0.08, least: int = 30, frames: int = 3) -> DataFrame:
    """How high above the ground the camera was held: per frame the height over the low tenth of the points near it, then the median over frames.

    Scenes with under ``frames`` frames that have ground below take the height over the low points around the first camera (``held_fallback``), or 0.
    Columns scene_id, frames (with ground below), held, and source: 'below the walk', 'around the first camera' or 'none'.
    """
    length = cumulative_length(walk, plan=True).groupBy("scene_id").agg((exact_sum("step")).alias("walk"))
    centres = walk.join(length, "scene_id").select("scene_id", "frame", F.col("px").alias("cx"), F.col("py").alias("cy"), "walk")
    low = low_tenth(points.select("scene_id", "x", "y", "z"), centres.withColumn("r", F.greatest(F.col("walk") * share, F.lit(1e-6))).drop("walk")).where(F.col("n") >= least)
    heights = low.join(walk.select("scene_id", "frame", "pz"), ["scene_id", "frame"]).select("scene_id", (F.col("pz") - F.col("low")).alias("height"))
    med = quantiles(heights, ["scene_id"], "height", {"held": 0.5}, count="frames")
    found = cut_lineage(walk.select("scene_id").distinct().join(med, "scene_id", "left").select("scene_id", F.coalesce("frames", F.lit(0)).alias("frames"), "held"))
    over = found.where(F.col("frames") >= frames).withColumn("source", F.lit("below the walk"))
    bare = found.where(F.col("frames") < frames).drop("held")
    if bare.isEmpty():
        return over
    here = bare.select("scene_id")
    spare = held_fallback(points.join(here, "scene_id", "left_semi"), walk.join(here, "scene_id", "left_semi")).select("scene_id", "held", "enough")
    source = F.when(F.col("enough"), "around the first camera").otherwise("none")
    return over.unionByName(bare.join(spare, "scene_id", "left").select("scene_id", "frames", F.coalesce("held", F.lit(0.0)).alias("held"), source.alias("source")))


def low_tenth(points: DataFrame, centres: DataFrame, whole: int = WHOLE) -> DataFrame:
    """scene_id, frame, low (the 0.1 quantile of z) and n over the points closer in plan than ``r`` to each centre (scene_id, frame, cx, cy, r).

    Scenes of at most ``whole`` points are one group for a block of centres each, so that pairs are no rows; larger ones take the join on cells.
    """
    points = points.where("z IS NOT NULL")
    large = points.groupBy("scene_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > whole).select("scene_id")
    split = not large.isEmpty()
    small = (lambda df: df.join(large, "scene_id", "left_anti")) if split else (lambda df: df)
    types = [centres.schema[c].dataType.simpleString() for c in ("scene_id", "frame")]
    low = meet.in_groups(small(points).withColumn("_one", F.lit(0)), small(centres), ("_one", "frame"), (whole, 4096), _low_tenth, f"scene_id {types[0]}, frame {types[1]}, low double, n bigint")
    if not split:
        return low
    pairs = nearest.within_radius(points.join(large, "scene_id", "left_semi"), centres.join(large, "scene_id", "left_semi"), F.col("r"))
    return low.unionByName(quantiles(pairs, ["scene_id", "frame"], "z", {"low": 0.1}, count="n").select("scene_id", "frame", "low", "n"))


def _low_tenth(a: pa.Table, b: pa.Table) -> pa.Table:
    x, y, z = meet.columns(a, "x", "y", "z")
    order = np.argsort(z, kind="stable")
    x, y, z = x[order], y[order], z[order]
    cx, cy, r = meet.columns(b, "cx", "cy", "r")
    n, low = np.zeros(b.num_rows, dtype=np.int64), np.full(b.num_rows, np.nan)
    step = max(1, meet.TILE // len(z))
    for k in range(0, b.num_rows, step):
        dx, dy = x[None, :] - cx[k:k + step, None], y[None, :] - cy[k:k + step, None]
        near = np.sqrt(dx * dx + dy * dy) < r[k:k + step, None]
        for m, row in enumerate(near, k):
            at = np.flatnonzero(row)
            n[m] = len(at)
            if len(at):
                p = 0.1 * float(len(at) - 1)
                lo = int(np.floor(p))
                first = z[at[lo]]
                low[m] = first + (z[at[min(lo + 1, len(at) - 1)]] - first) * (p - np.floor(p))
    got = pa.array(n > 0)
    return pa.table({"scene_id": b["scene_id"], "frame": b["frame"], "low": low, "n": n}).filter(got)


def held_fallback(points: DataFrame, walk: DataFrame, nearest_points: int = 3000, share: float = 0.05, least: int = 50, salts: int = 16) -> DataFrame:
    """Held height where the walk passes over no scanned ground: the ``share`` quantile of those of the ``nearest_points`` points
    around the first camera (in plan, ties by point_id) that lie below it; 0 where fewer than ``least`` do.

    Ranks are taken in salted subgroups first, so the ranking that decides holds at most ``salts`` times ``nearest_points`` rows.
    """
    first = walk.groupBy("scene_id").agg(F.min_by(F.struct("px", "py", "pz"), "frame").alias("_c"))
    d = points.select("scene_id", "point_id", "x", "y", "z").join(first, "scene_id")
    dx, dy = F.col("x") - F.col("_c.px"), F.col("y") - F.col("_c.py")
    d = d.select("scene_id", "point_id", (dx * dx + dy * dy).alias("_d"), (F.col("z") - F.col("_c.pz")).alias("_z"))
    for keys in (["scene_id", F.pmod(F.xxhash64("point_id"), F.lit(salts))], ["scene_id"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("_d", "point_id"))
        d = d.withColumn("_k", place).where(F.col("_k") <= nearest_points).drop("_k")
    below = d.groupBy("scene_id").agg(F.count(F.when(F.col("_z") < 0, 1)).alias("points"), F.percentile(F.when(F.col("_z") < 0, F.col("_z")), F.lit(share)).alias("_q"))
    below = below.withColumn("enough", F.col("points") >= least)
    return below.select("scene_id", "points", F.when(F.col("enough"), -F.col("_q")).otherwise(0.0).alias("held"), "enough")


def smoothing_kernel(sigma: float) -> list[tuple[int, float]]:
    r = int(math.ceil(3 * sigma))
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    total = sum(w)
    return [(k - r, v / total) for k, v in enumerate(w)]


def gaussian_smooth(indexed: DataFrame, columns: list[str], sigma: float) -> DataFrame:
    """Smooth columns along ``k`` (1..n per scene), ends reflected. Each row is sent to the
    positions it weighs on, its mirror images included, and summed there."""
    taps = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in smoothing_kernel(sigma)])
    n = indexed.groupBy("scene_id").agg(F.max("k").alias("_n"))
    at = indexed.select("scene_id", "k", *columns).join(n, "scene_id").withColumn("_t", F.explode(taps))
    k, last = F.col("k"), F.col("_n")
    spots = F.filter(F.array(k - F.col("_t.d"), F.when(k > 1, 2 - k - F.col("_t.d")), F.when(k < last, 2 * last - k - F.col("_t.d"))),
                     lambda q: q.isNotNull() & (q >= 1) & (q <= last))
    at = at.withColumn("_q", F.explode(spots))
    return at.groupBy("scene_id", F.col("_q").alias("k")).agg(
        *[(F.sum(F.floor(F.col(c) * F.col("_t.w") * 1e9 + 0.5).cast("bigint")).cast("double") / 1e9).alias(c) for c in columns])


def resample(walk: DataFrame, order: str, columns: list[str], rate: float) -> DataFrame:
    """Linear resample of columns on the grid order = first, first + rate, ...; ends clamped.

    Samples and grid are one ordered table; each grid row takes the last sample at or before it and the
    first at or after it.
    """
    span = walk.groupBy("scene_id").agg(F.min(order).alias("_a"), F.max(order).alias("_b"))
    steps = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_b") - F.col("_a")) / rate).cast("bigint"))
    grid = span.select("scene_id", F.explode(steps).alias("g"), "_a").select("scene_id", "g", (F.col("_a") + F.col("g") * rate).alias("t"))
    samples = walk.select("scene_id", F.lit(None).cast("bigint").alias("g"), F.col(order).cast("double").alias("t"), F.struct(F.col(order).cast("double").alias("t"), *columns).alias("s"))
    both = samples.unionByName(grid.withColumn("s", F.lit(None).cast(samples.schema["s"].dataType)))
    # a sample at the same instant sorts first going forward, and last going back
    both = both.withColumn("late", F.when(F.col("s").isNull(), 1).otherwise(0)).withColumn("early", F.lit(1) - F.col("late"))
    both = sequence.last_known(both, ["scene_id"], ["t", "late"], {"before": F.col("s")}, False, WIDTH)
    both = sequence.last_known(both, ["scene_id"], ["t", "early"], {"after": F.col("s")}, True, WIDTH)
    out = both.where("s IS NULL").withColumn("before", F.coalesce("before", "after")).withColumn("after", F.coalesce("after", "before"))
    gap = F.col("after.t") - F.col("before.t")
    f = F.when(gap > 0, (F.col("t") - F.col("before.t")) / gap).otherwise(F.lit(0.0))
    return out.select("scene_id", "g", "t", *[(F.col("before." + c) + f * (F.col("after." + c) - F.col("before." + c))).alias(c) for c in columns])


def run_around(flags: DataFrame, centre: Column) -> DataFrame:
    """Per scene the run of true flags through ``centre`` (an index), or through the nearest true one.

    A run is found without walking it: its ends are the nearest false neighbours of the start index.
    """
    true_rows = flags.where("ok")
    start = true_rows.join(flags.groupBy("scene_id").agg(centre.alias("_c")), "scene_id").groupBy("scene_id").agg(
        F.min_by("k", F.struct(F.abs(F.col("k") - F.col("_c")), F.col("k"))).alias("_s"))
    edge = flags.join(start, "scene_id").groupBy("scene_id", "_s").agg(
        F.max(F.when(~F.col("ok") & (F.col("k") < F.col("_s")), F.col("k"))).alias("_lo"), F.min(F.when(~F.col("ok") & (F.col("k") > F.col("_s")), F.col("k"))).alias("_hi"),
        F.min("k").alias("_k0"), F.max("k").alias("_k1"))
    return edge.select("scene_id", F.coalesce(F.col("_lo") + 1, F.col("_k0")).alias("first"), F.coalesce(F.col("_hi") - 1, F.col("_k1")).alias("last"))


def nearest_view(views: DataFrame, cameras: DataFrame, length: DataFrame, far: float = 0.25, wide: float = 35.0) -> DataFrame:
    """The filmed camera nearest to each view: scene_id, frame, nearest (its frame), near_dist (share of the walk's ``length``), view_angle
    (degrees between the two directions), near_ok (no farther than ``far`` and no more than ``wide`` apart).

    ``views``: scene_id, frame, px, py, pz and a direction ax, ay, az of any length; ``cameras``: scene_id, frame, px, py, pz and unit fx, fy, fz.
    """
    ends = [F.col(c).alias(p + d) for d, c in (("x", "px"), ("y", "py"), ("z", "pz")) for p in ("a_", "b_")]
    cams = cameras.select("scene_id", F.col("frame").alias("nearest"), *ends, "fx", "fy", "fz")
    look = ["ax", "ay", "az"]
    n = nearest.nearest(views, cams, {"x": "px", "y": "py", "z": "pz"}, ["frame", *look], "nearest", ["nearest", "fx", "fy", "fz"])
    a, f = [F.col(c) for c in look], [F.col(c) for c in ("fx", "fy", "fz")]
    cosine = (a[0] * f[0] + a[1] * f[1] + a[2] * f[2]) / F.sqrt(a[0] * a[0] + a[1] * a[1] + a[2] * a[2])
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    share = F.col("distance") / F.col("length")
    n = n.join(length, "scene_id").select("scene_id", "frame", "nearest", share.alias("near_dist"), angle.alias("view_angle"))
    return n.withColumn("near_ok", (F.col("near_dist") <= far) & (F.col("view_angle") <= wide))
