"""The first splat along a ray, by walking rays through voxels.

Splats are ellipsoids of some sigmas. Each lies in the voxels that its box touches, in a grid of its own size class (voxel sides
double from class to class), so a large splat is in a few voxels as well. Rays are cut into the voxels they enter, in order, and meet
splats through an equi-join on the voxel; the exact hit decides. Rays walk in waves, each four times as long as the one before; a ray
whose nearest hit lies within the stretch walked so far stops there, as nothing nearer can come.

Scenes of at most ``PAIRS`` pairs of splats and rays need no voxels: inside one group all their rays meet all their splats in arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from groundloom.operators import meet
from groundloom.session import cut_lineage

AX = ("x", "y", "z")
#: Voxels of the finest grid that the first wave walks, and how much longer each next one is.
REACH, LONGER = 16, 4
#: Most voxels along a scene's longest side.
FINEST = 256
#: Pairs of splats and rays of a scene whose rays meet all splats, and splats of such a scene at the most.
PAIRS, PLAIN = 1 << 24, 1 << 20


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def hit_distance(sigmas: float) -> Column:
    """Distance along the unit ray (ox.., dx..) to the ellipsoid (x.., rotation m00..m22, squared sigmas s0..s2); null where it misses.

    From inside the ellipsoid it is the distance to the way out.
    """
    p, d = [F.col("o" + a) - F.col(a) for a in AX], [F.col("d" + a) for a in AX]
    column = lambda k: [F.col(f"m{r}{k}") for r in range(3)]
    pk, dk, s = [_dot(p, column(k)) for k in range(3)], [_dot(d, column(k)) for k in range(3)], [F.col(f"s{k}") for k in range(3)]
    total = lambda u, v: u[0] * v[0] / s[0] + u[1] * v[1] / s[1] + u[2] * v[2] / s[2]
    a, b, c = total(dk, dk), total(pk, dk), total(pk, pk) - sigmas * sigmas
    root = F.sqrt(b * b - a * c)
    near, far = (-b - root) / a, (-b + root) / a
    return F.when(b * b - a * c >= 0, F.when(near >= 0, near).when(far >= 0, far))


def ray_hits(splats: DataFrame, rays: DataFrame, sigmas: float = 3.0, least_opacity: float = 0.0, reach: int = REACH, pairs: int = PAIRS) -> DataFrame:
    """scene_id, ray_id, splat_id, distance and the place hx, hy, hz of each ray's first hit; rays that hit nothing have no row.

    ``splats``: scene_id, splat_id, x, y, z, ls0..ls2 (log sigmas), m00..m22 (rotation), opacity_logit; ``rays``: scene_id, ray_id, ox, oy, oz and
    the unit direction dx, dy, dz. Splats under ``least_opacity`` (a logit) are not hit; of equal distances the smaller splat_id wins.
    """
    entries = [f"m{r}{k}" for r in range(3) for k in range(3)]
    s = splats.where(F.col("opacity_logit") >= least_opacity).select("scene_id", "splat_id", *AX, *entries, *[F.exp(2 * F.col(f"ls{k}")).alias(f"s{k}") for k in range(3)])
    s = cut_lineage(s)
    n = s.groupBy("scene_id").agg(F.count(F.lit(1)).alias("_s")).join(rays.groupBy("scene_id").agg(F.count(F.lit(1)).alias("_r")), "scene_id")
    n = cut_lineage(n.withColumn("_few", (F.col("_s") * F.col("_r") <= pairs) & (F.col("_s") <= PLAIN) & (F.col("_r") <= PLAIN)))
    few, many = (n.where(w).select("scene_id") for w in ("_few", "NOT _few"))
    if many.isEmpty():
        return _plain(s, rays, sigmas)
    plain = _plain(s.join(few, "scene_id", "left_semi"), rays.join(few, "scene_id", "left_semi"), sigmas)
    return plain.unionByName(_walked(s.join(many, "scene_id", "left_semi"), rays.join(many, "scene_id", "left_semi"), sigmas, reach))


def _plain(s: DataFrame, rays: DataFrame, sigmas: float) -> DataFrame:
    """``ray_hits`` of small scenes: one group a scene."""
    kind = rays.schema["ray_id"].dataType.simpleString()
    scene = rays.schema["scene_id"].dataType.simpleString()
    schema = f"scene_id {scene}, ray_id {kind}, splat_id bigint, distance double, hx double, hy double, hz double"
    entries = [f"m{r}{k}" for r in range(3) for k in range(3)]

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        a = a.sort_by("splat_id")  # of equal distances the first one wins
        splat = {c: v[None, :] for c, v in zip([*AX, *entries, "s0", "s1", "s2"], meet.columns(a, *AX, *entries, "s0", "s1", "s2"))}
        names = ["o" + x for x in AX] + ["d" + x for x in AX]
        ray = dict(zip(names, meet.columns(b, *names)))
        step = max(1, meet.TILE // a.num_rows)
        which, far = np.zeros(b.num_rows, dtype=np.int64), np.full(b.num_rows, np.inf)
        for k in range(0, b.num_rows, step):
            d = _distances(splat, {c: v[k:k + step, None] for c, v in ray.items()}, sigmas)
            which[k:k + step] = d.argmin(axis=1)
            far[k:k + step] = d.min(axis=1)
        hit = np.isfinite(far)
        b, which, far = b.filter(pa.array(hit)), which[hit], far[hit]
        place = {"h" + x: ray["o" + x][hit] + far * ray["d" + x][hit] for x in AX}
        return pa.table({"scene_id": b["scene_id"], "ray_id": b["ray_id"], "splat_id": a["splat_id"].take(pa.array(which)).cast(pa.int64()), "distance": far, **place})

    r = rays.select("scene_id", "ray_id", *["o" + x for x in AX], *["d" + x for x in AX])
    return meet.in_groups(s, r, ("splat_id", "ray_id"), (PLAIN, PLAIN), work, schema)


def _distances(splat: dict, ray: dict, sigmas: float) -> np.ndarray:
    """``hit_distance`` in arrays, infinite where a ray misses or a value is missing."""
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    p, d = [ray["o" + a] - splat[a] for a in AX], [ray["d" + a] for a in AX]
    column = lambda k: [splat[f"m{r}{k}"] for r in range(3)]
    pk, dk, s = [dot(p, column(k)) for k in range(3)], [dot(d, column(k)) for k in range(3)], [splat[f"s{k}"] for k in range(3)]
    total = lambda u, v: u[0] * v[0] / s[0] + u[1] * v[1] / s[1] + u[2] * v[2] / s[2]
    with np.errstate(all="ignore"):
        a, b, c = total(dk, dk), total(pk, dk), total(pk, pk) - sigmas * sigmas
        inner = b * b - a * c
        root = np.sqrt(inner)
        near, far = (-b - root) / a, (-b + root) / a
        t = np.where(near >= 0, near, np.where(far >= 0, far, np.inf))
        return np.where((inner >= 0) & np.isfinite(t), t, np.inf)


def _walked(s: DataFrame, rays: DataFrame, sigmas: float, reach: int) -> DataFrame:
    """``ray_hits`` through voxels."""
    entries = [f"m{r}{k}" for r in range(3) for k in range(3)]
    half = {a: sigmas * F.sqrt(sum((F.col(f"m{r}{k}") * F.col(f"m{r}{k}") * F.col(f"s{k}") for k in (1, 2)), F.col(f"m{r}0") * F.col(f"m{r}0") * F.col("s0"))) for r, a in enumerate(AX)}
    s = cut_lineage(s.withColumns({"e" + a: half[a] * 1.000001 + 1e-9 for a in AX}))
    box = s.groupBy("scene_id").agg(F.count(F.lit(1)).alias("_n"), *[f(F.col(a) + sign * F.col("e" + a)).alias(p + a) for a in AX for f, sign, p in ((F.min, -1, "lo"), (F.max, 1, "hi"))])
    side = F.greatest(*[F.col("hi" + a) - F.col("lo" + a) for a in AX])
    box = box.select("scene_id", *["lo" + a for a in AX], *["hi" + a for a in AX], (side / F.least(F.lit(float(FINEST)), F.greatest(F.lit(1.0), F.ceil(F.cbrt("_n")).cast("double")))).alias("cell"))
    box = cut_lineage(box)
    wide = F.greatest(*[2 * F.col("e" + a) for a in AX]) / F.col("cell")
    placed = s.join(box, "scene_id").withColumn("level", F.when(wide <= 1, 0).otherwise(F.ceil(F.log2(wide))).cast("int"))
    classes = cut_lineage(placed.select("scene_id", "level").distinct())
    size = F.col("cell") * F.pow(F.lit(2.0), F.col("level"))
    for a in AX:
        first, last = (F.floor((F.col(a) + sign * F.col("e" + a) - F.col("lo" + a)) / size) for sign in (-1, 1))
        placed = placed.withColumn("v" + a, F.explode(F.sequence(first, last)))
    placed = cut_lineage(placed.select("scene_id", "level", *["v" + a for a in AX], "splat_id", *AX, *entries, "s0", "s1", "s2"))

    live = rays.select("scene_id", "ray_id", *["o" + a for a in AX], *["d" + a for a in AX]).join(box, "scene_id")
    enter, leave = F.lit(0.0), F.lit(float("inf"))
    for a in AX:
        o, d = F.col("o" + a), F.col("d" + a)
        t0, t1 = (F.col("lo" + a) - o) / F.nullif(d, F.lit(0.0)), (F.col("hi" + a) - o) / F.nullif(d, F.lit(0.0))
        inside = (o >= F.col("lo" + a)) & (o <= F.col("hi" + a))
        enter = F.greatest(enter, F.when(d != 0, F.least(t0, t1)).when(inside, 0.0).otherwise(float("inf")))
        leave = F.least(leave, F.when(d != 0, F.greatest(t0, t1)).otherwise(float("inf")))
    best = F.lit(None).cast("struct<distance:double,splat_id:bigint>")
    live = cut_lineage(live.withColumn("begin", enter).withColumn("last", leave).where("begin <= last").withColumn("best", best))
    done = None
    while True:
        live = live.withColumn("stop", F.least(F.col("last"), F.col("begin") + reach * F.col("cell")))
        found = _hits(live, classes, placed, size, sigmas).groupBy("scene_id", "ray_id").agg(F.min("hit").alias("_hit"))
        live = cut_lineage(live.join(found, ["scene_id", "ray_id"], "left").withColumn("best", F.least("best", "_hit")).drop("_hit"))
        over = (F.col("best.distance") <= F.col("stop")) | (F.col("stop") >= F.col("last"))
        ended = live.where(F.coalesce(over, F.lit(False)) & F.col("best").isNotNull())
        ended = ended.select("scene_id", "ray_id", "best.splat_id", "best.distance", *[(F.col("o" + a) + F.col("best.distance") * F.col("d" + a)).alias("h" + a) for a in AX])
        done = ended if done is None else done.unionByName(ended)
        live = live.where(~F.coalesce(over, F.lit(False))).withColumn("begin", F.col("stop")).drop("stop")
        if live.isEmpty():
            return done
        reach *= LONGER


def _crossing(a: str):
    return lambda k: (F.col("lo" + a) + k.cast("double") * F.col("_size") - F.col("o" + a)) / F.col("d" + a)


def _hits(live: DataFrame, classes: DataFrame, placed: DataFrame, size: Column, sigmas: float) -> DataFrame:
    """Exact hits of the rays with the splats of the voxels they enter between ``begin`` and ``stop``."""
    walk = live.drop("best", "last").join(classes, "scene_id").withColumn("_size", size)
    crossings = [F.array("begin", "stop")]
    for a in AX:
        at = lambda t, a=a: (F.col("o" + a) + F.col(t) * F.col("d" + a) - F.col("lo" + a)) / F.col("_size")
        low, high = F.floor(F.least(at("begin"), at("stop"))), F.floor(F.greatest(at("begin"), at("stop")))
        planes = F.when(high > low, F.sequence(low + 1, high)).otherwise(F.array().cast("array<bigint>"))
        crossings.append(F.transform(planes, _crossing(a)))
    walk = walk.withColumn("_t", F.array_sort(F.concat(*crossings)))
    middles = F.transform(F.sequence(F.lit(0), F.size("_t") - 2), lambda i: (F.get("_t", i) + F.get("_t", i + 1)) / 2)
    walk = walk.withColumn("_m", F.explode(middles))
    voxel = {"v" + a: F.floor((F.col("o" + a) + F.col("_m") * F.col("d" + a) - F.col("lo" + a)) / F.col("_size")) for a in AX}
    walk = walk.withColumns(voxel).select("scene_id", "ray_id", "level", *voxel, *["o" + a for a in AX], *["d" + a for a in AX])
    both = walk.join(placed, ["scene_id", "level", *voxel]).withColumn("distance", hit_distance(sigmas)).where("distance IS NOT NULL")
    return both.select("scene_id", "ray_id", F.struct("distance", F.col("splat_id").cast("bigint").alias("splat_id")).alias("hit"))
