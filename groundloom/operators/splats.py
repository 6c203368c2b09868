"""Gaussian splats: selection, transform, projection, compositing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from groundloom.functions.numeric import sigmoid
from groundloom.operators import sequence
from groundloom.operators.order_stats import quantiles, top_n
from groundloom.session import cut_lineage


def with_visibility(splats: DataFrame) -> DataFrame:
    mean = (F.col("ls0") + F.col("ls1") + F.col("ls2")) / 3
    return splats.withColumn("visibility", sigmoid("opacity_logit") * F.exp(2 * mean))


#: Splats of each level of detail (None: all of them), fixed values.
LEVELS: dict[str, int | None] = {"high": None, "med": 400_000, "low": 150_000, "verylow": 50_000}


def levels(splats: DataFrame, sizes: dict[str, int | None] = LEVELS) -> DataFrame:
    """scene_id, splat_id and level: for each level the most visible splats of each scene (``visibility`` is taken as given where it is a
    column). Each level is cut from the next larger one, so only the largest cut reads all splats."""
    v = splats if "visibility" in splats.columns else with_visibility(splats)
    v = v.select("scene_id", "splat_id", "visibility")
    out = None
    for name, n in sorted(sizes.items(), key=lambda x: -(math.inf if x[1] is None else x[1])):
        if n is not None:
            v = cut_lineage(top_n(v, ["scene_id"], "visibility", "splat_id", n))
        part = v.select("scene_id", "splat_id", F.lit(name).alias("level"))
        out = part if out is None else out.unionByName(part)
    return out


def thin(splats: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` splats per scene with the most opacity x size."""
    size = F.exp((F.col("ls0") + F.col("ls1") + F.col("ls2")) / 3)
    return top_n(splats.withColumn("weight", sigmoid("opacity_logit") * size), ["scene_id"], "weight", "splat_id", keep)


def section(splats: DataFrame, spec: dict, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Rows inside a box given as fractions of the robust bounds; see ``normalise_section``."""
    s = normalise_section(spec)
    if not s["enabled"]:
        return splats
    axes = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("v")) for a in "xyz"]))
    long = splats.select("scene_id", axes.alias("u")).select("scene_id", "u.axis", "u.v")
    q = quantiles(long, ["scene_id", "axis"], "v", {"lo": low, "hi": high}, "lower")
    # a face left at an end is that end itself: lo + (hi - lo) can be one bit off hi
    at = lambda f: F.col("lo") if f == 0 else F.col("hi") if f == 1 else F.col("lo") + (F.col("hi") - F.col("lo")) * f
    face = lambda a, f: F.max(F.when(F.col("axis") == a, at(f)))
    box = q.groupBy("scene_id").agg(*[face(a, s[m][a]).alias(f"_{m}_{a}") for a in "xyz" for m in ("min", "max")])
    inside = F.lit(True)
    for a in "xyz":
        inside = inside & (F.col(a) >= F.col(f"_min_{a}")) & (F.col(a) <= F.col(f"_max_{a}"))
    return splats.join(box, "scene_id").where(inside).drop(*[f"_{m}_{a}" for a in "xyz" for m in ("min", "max")])


def normalise_section(spec: dict | None) -> dict:
    """A valid box from either shape: {min, max} as 0..1 fractions, or one face {axis, t, flip}."""
    box = {"enabled": bool(spec and spec.get("enabled")), "min": dict.fromkeys("xyz", 0.0), "max": dict.fromkeys("xyz", 1.0)}
    if not box["enabled"]:
        return box
    unit = lambda v: float(min(1.0, max(0.0, v)))
    if spec.get("min") or spec.get("max"):
        for a in "xyz":
            ends = unit((spec.get("min") or {}).get(a, 0.0)), unit((spec.get("max") or {}).get(a, 1.0))
            box["min"][a], box["max"][a] = min(ends), max(ends)
    elif spec.get("axis"):
        box["min" if spec.get("flip") else "max"][spec["axis"]] = unit(spec.get("t", 1.0))
    return box


def solid_sample(splats: DataFrame, want: int) -> DataFrame:
    """Opaque splats (sigmoid >= 0.5) among every step-th row of the scene, step = max(1, n // want)."""
    k = sequence.row_number(splats.withColumn("_o", F.col("splat_id")), ["scene_id"], ["_o"], "_k", None)
    n = splats.groupBy("scene_id").agg(F.count(F.lit(1)).alias("_n"))
    step = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("_n") / want).cast("bigint"))
    k = k.join(n, "scene_id").where(((F.col("_k") - 1) % step == 0) & (F.col("opacity_logit") >= 0))
    return k.drop("_o", "_k", "_n")


def covariance(df: DataFrame) -> DataFrame:
    """Adds the six entries of R S S^T R^T from log-scales ls0..2 and the rotation entries m00..m22."""
    s = [F.exp(2 * F.col(f"ls{k}")) for k in range(3)]
    entry = lambda a, b: sum((F.col(f"m{a}{k}") * F.col(f"m{b}{k}") * s[k] for k in (1, 2)), F.col(f"m{a}0") * F.col(f"m{b}0") * s[0])
    return df.withColumns({f"c{a}{b}": entry(a, b) for a in range(3) for b in range(a, 3)})


def footprint(df: DataFrame) -> DataFrame:
    """2-D footprint (a, b, c) in pixels and its 3-sigma radius, for splats given in camera axes
    (X right, Y down, Z forward) with covariance entries c00..c22 in those axes."""
    fz = F.col("focal") / F.col("Z")
    gx, gy = -F.col("focal") * F.col("X") / (F.col("Z") * F.col("Z")), -F.col("focal") * F.col("Y") / (F.col("Z") * F.col("Z"))
    a = fz * fz * F.col("c00") + 2 * fz * gx * F.col("c02") + gx * gx * F.col("c22") + 0.3
    b = fz * fz * F.col("c01") + fz * gy * F.col("c02") + fz * gx * F.col("c12") + gx * gy * F.col("c22")
    c = fz * fz * F.col("c11") + 2 * fz * gy * F.col("c12") + gy * gy * F.col("c22") + 0.3
    df = df.withColumns({"a": a, "b": b, "c": c})
    lam = 0.5 * (F.col("a") + F.col("c")) + F.sqrt(F.greatest(0.25 * (F.col("a") - F.col("c")) * (F.col("a") - F.col("c")) + F.col("b") * F.col("b"), F.lit(0.0)))
    return df.withColumn("radius", F.ceil(3 * F.sqrt(lam)).cast("bigint"))


def composite(hits: DataFrame, pixel: list[str], depth: str, tie: str, channels: list[str], width: float) -> DataFrame:
    """Front-to-back blend per pixel of rows with ``alpha``: rows under 1/255 are dropped, weight is what
    is left of the light times alpha, and stops under 1e-4.

    A pixel's rows are cut into depth slabs of ``width``; slabs pass on their summed log-transmittance.
    """
    h = hits.withColumn("alpha", F.least(F.lit(0.99), F.col("alpha"))).where(F.col("alpha") >= 1 / 255)
    dark = F.floor(F.log(1 - F.col("alpha")) * 1e9 + 0.5).cast("bigint")
    h = sequence.running_sum(h, pixel, [depth, tie], dark, "_before", width, inclusive=False)
    left = F.exp(F.col("_before").cast("double") / 1e9)
    h = h.withColumn("_w", F.when(left > 1e-4, left * F.col("alpha")).otherwise(0.0))
    total = lambda c: F.sum(F.floor(c * 1e9 + 0.5).cast("bigint")).cast("double") / 1e9
    return h.groupBy(*pixel).agg(*[total(F.col("_w") * F.col(c)).alias(c) for c in channels], total(F.col("_w")).alias("opacity"), F.count(F.lit(1)).alias("layers"))


def plan_raster(splats: DataFrame, eye: float, size: int = 100, pad: float = 1.08) -> DataFrame:
    """Colour of the highest splat per plan cell: opaque splats at or below ``eye``, without the biggest
    tenth; a cell needs three."""
    s = splats.where("opacity_logit >= 0").withColumn("_size", F.exp(F.greatest("ls0", "ls1", "ls2")))
    q = quantiles(s, ["scene_id"], "_size", {"_big": 0.9}, "lower")
    axes = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("v")) for a in "xy"]))
    long = s.select("scene_id", axes.alias("u")).select("scene_id", "u.axis", "u.v")
    e = quantiles(long, ["scene_id", "axis"], "v", {"lo": 0.05, "hi": 0.95}, "lower")
    side = lambda a, c: F.max(F.when(F.col("axis") == a, F.col(c)))
    frame = e.groupBy("scene_id").agg(side("x", "lo").alias("u0"), side("x", "hi").alias("u1"), side("y", "lo").alias("v0"), side("y", "hi").alias("v1"))
    frame = frame.withColumn("span", F.greatest(F.col("u1") - F.col("u0"), F.col("v1") - F.col("v0")) * pad)
    frame = frame.select("scene_id", "span", ((F.col("u0") + F.col("u1")) / 2 - F.col("span") / 2).alias("u0"), ((F.col("v0") + F.col("v1")) / 2 - F.col("span") / 2).alias("v0"))
    s = s.join(q, "scene_id").join(frame, "scene_id").where((F.col("_size") <= F.col("_big")) & (F.col("z") <= eye))
    gx = F.floor((F.col("x") - F.col("u0")) / F.col("span") * size).cast("int")
    gy = F.lit(size - 1) - F.floor((F.col("y") - F.col("v0")) / F.col("span") * size).cast("int")
    s = s.withColumn("gx", gx).withColumn("gy", gy).where((F.col("gx") >= 0) & (F.col("gy") >= 0) & (F.col("gx") < size) & (F.col("gy") < size))
    top = F.max_by(F.struct("r", "g", "b"), F.struct(F.col("z"), -F.col("splat_id")))
    return s.groupBy("scene_id", "gx", "gy").agg(F.count(F.lit(1)).alias("n"), top.alias("c")).where("n >= 3").select("scene_id", "gx", "gy", "n", "c.r", "c.g", "c.b")


def voxel_overlap(splats: DataFrame, surface: DataFrame, size: float) -> DataFrame:
    """Splats with ``drop``: in a voxel crossed by the surface or next to one, and smaller (3 sigma) than a voxel."""
    both = splats.select("scene_id", "x", "y", "z").unionByName(surface.select("scene_id", "x", "y", "z"))
    origin = both.groupBy("scene_id").agg(*[(F.min(a) - size).alias("_o" + a) for a in "xyz"])
    cell = lambda a: F.floor((F.col(a) - F.col("_o" + a)) / size).cast("bigint").alias("v" + a)
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.lit(c).alias("z")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]))
    crossed = surface.join(origin, "scene_id").select("scene_id", *[cell(a) for a in "xyz"]).distinct().withColumn("_n", near)
    touched = crossed.select("scene_id", *[(F.col("v" + a) + F.col("_n." + a)).alias("v" + a) for a in "xyz"]).distinct().withColumn("_hit", F.lit(True))
    at = splats.join(origin, "scene_id").select(*splats.columns, *[cell(a) for a in "xyz"]).join(touched, ["scene_id", "vx", "vy", "vz"], "left")
    small = 3 * F.exp(F.greatest("ls0", "ls1", "ls2")) < size
    on = F.coalesce("_hit", F.lit(False))
    return at.withColumn("on_surface", on).withColumn("drop", F.col("on_surface") & small).drop("_hit", "vx", "vy", "vz")
