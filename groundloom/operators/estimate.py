"""Small solves on top of distributed sums: similarity, dominant plane, the vertical, the site frame, camera moves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from groundloom.functions import geometry as g
from groundloom.functions.numeric import exact_sum
from groundloom.operators import visibility
from groundloom.operators.order_stats import quantiles

AX = ("x", "y", "z")


def _mean(c):
    return exact_sum(c) / F.count(F.lit(1))


def similarity(pairs: DataFrame) -> DataFrame:
    """Scale, rotation and shift mapping (px, py, pz) onto (qx, qy, qz) per scene, least squares.

    The sums are native; only one row of them per scene reaches the 3x3 decomposition.
    """
    centre = pairs.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"), *[_mean(F.col(s + a)).alias("m" + s + a) for s in "pq" for a in AX])
    d = pairs.join(centre, "scene_id")
    for s in "pq":
        for a in AX:
            d = d.withColumn("d" + s + a, F.col(s + a) - F.col("m" + s + a))
    sums = d.groupBy("scene_id").agg(*[_mean(F.col("dq" + a) * F.col("dp" + b)).alias(f"c{a}{b}") for a in AX for b in AX],
                                     _mean(sum((F.col("dp" + a) * F.col("dp" + a) for a in "yz"), F.col("dpx") * F.col("dpx"))).alias("var"))
    row = sums.join(centre, "scene_id")

    def solve(batches):
        for rows in batches:
            out = []
            for r in rows.to_dict("records"):
                C = np.array([[r[f"c{a}{b}"] for b in AX] for a in AX])
                U, S, Vt = np.linalg.svd(C)
                flip = np.diag([1.0, 1.0, -1.0 if np.linalg.det(U @ Vt) < 0 else 1.0])
                R = U @ flip @ Vt
                c = float((S * np.diag(flip)).sum() / r["var"]) if r["var"] > 0 else 1.0
                t = np.array([r["mq" + a] for a in AX]) - c * (R @ np.array([r["mp" + a] for a in AX]))
                out.append([r["scene_id"], r["n"], c, *R.ravel(), *t])
            yield pd.DataFrame(out, columns=["scene_id", "n", "scale", *[f"r{a}{b}" for a in range(3) for b in range(3)], "t0", "t1", "t2"])

    return row.mapInPandas(solve, "scene_id int, n bigint, scale double, " + ", ".join(f"r{a}{b} double" for a in range(3) for b in range(3)) + ", t0 double, t1 double, t2 double")


def pose_drift(candidate: DataFrame, reference: DataFrame, match: float = 90.0, rms_limit: float = 0.20, worst_limit: float = 0.60) -> DataFrame:
    """Residuals of a candidate solve against a reference after alignment, as shares of the reference's extent."""
    p = candidate.select("scene_id", "name", "px", "py", "pz")
    q = reference.select("scene_id", "name", F.col("px").alias("qx"), F.col("py").alias("qy"), F.col("pz").alias("qz"))
    both = p.join(q, ["scene_id", "name"])
    fit = similarity(both)
    e = both.join(fit, "scene_id")
    err = [F.col("scale") * (F.col(f"r{k}0") * F.col("px") + F.col(f"r{k}1") * F.col("py") + F.col(f"r{k}2") * F.col("pz")) + F.col(f"t{k}") - F.col("q" + a) for k, a in enumerate(AX)]
    e = e.withColumn("sq", err[0] * err[0] + err[1] * err[1] + err[2] * err[2])
    box = sum(((F.max("q" + a) - F.min("q" + a)) * (F.max("q" + a) - F.min("q" + a)) for a in "yz"), (F.max("qx") - F.min("qx")) * (F.max("qx") - F.min("qx")))
    s = e.groupBy("scene_id").agg(F.count(F.lit(1)).alias("matched"), F.first("scale").alias("scale"), F.first(F.col("r00") + F.col("r11") + F.col("r22")).alias("trace"),
                                  F.sqrt(F.avg("sq")).alias("rms"), F.sqrt(F.max("sq")).alias("worst"), F.sqrt(box).alias("extent"))
    total = q.groupBy("scene_id").agg(F.count(F.lit(1)).alias("total"))
    s = s.join(total, "scene_id").withColumns({"match_pct": 100.0 * F.col("matched") / F.greatest("total", F.lit(1)), "rms_pct": 100 * F.col("rms") / F.col("extent"), "worst_pct": 100 * F.col("worst") / F.col("extent"),
                                               "rotation_deg": F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("trace") - 1) / 2))))})
    ok = (F.col("match_pct") >= match) & (F.col("rms_pct") <= rms_limit) & (F.col("worst_pct") <= worst_limit)
    return s.withColumn("verdict", F.when(F.col("matched") < 4, "too few shared cameras").when(ok, "pass").otherwise("fail"))


def estimate_up(cameras: DataFrame, planes: DataFrame, share: float = 0.6, look: float = 20.0, turning: float = 0.02) -> DataFrame:
    """The vertical per scene: the ground's normal when the cameras look down on it, else from how level they were held."""
    ups = cameras.groupBy("scene_id").agg(*[_mean(F.col(p + a)).alias(n + a) for p, n in (("u", "u"), ("s", "r")) for a in AX],
                                          *[_mean(F.col("s" + a) * F.col("s" + b)).alias(f"m{a}{b}") for a in AX for b in AX])
    c = cameras.join(planes, "scene_id").join(ups.select("scene_id", *[F.col("u" + a).alias("mean" + a) for a in AX]), "scene_id")
    sign = F.when(sum((F.col("n" + a) * F.col("mean" + a) for a in "yz"), F.col("nx") * F.col("meanx")) > 0, 1.0).otherwise(-1.0)
    c = c.withColumn("_s", sign)
    down = F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.col("_s") * (F.col("fx") * F.col("nx") + F.col("fy") * F.col("ny") + F.col("fz") * F.col("nz"))))))
    c = c.withColumn("_down", down).withColumn("_above", F.when(F.col("_s") * (F.col("px") * F.col("nx") + F.col("py") * F.col("ny") + F.col("pz") * F.col("nz")) > F.col("_s") * F.col("d"), 1.0).otherwise(0.0))
    seen = c.groupBy("scene_id").agg(F.avg("_above").alias("above"), F.first("_s").alias("sign")).join(quantiles(c, ["scene_id"], "_down", {"look_down": 0.5}), "scene_id")
    row = ups.join(planes, "scene_id", "left").join(seen, "scene_id", "left")

    def solve(batches):
        for rows in batches:
            out = []
            for r in rows.to_dict("records"):
                mean_up = np.array([r["u" + a] for a in AX])
                mean_up /= np.linalg.norm(mean_up)
                w, V = np.linalg.eigh(np.array([[r[f"m{a}{b}"] for b in AX] for a in AX]))
                spread = w[1] / max(w[2], 1e-12)
                if (r["share"] or 0) >= share and (r["above"] or 0) >= 0.8 and (r["look_down"] or 0) >= look:
                    up, how = np.array([r["n" + a] for a in AX]) * r["sign"], "ground"
                elif spread > turning:
                    up, how = V[:, 0], "held level"
                else:
                    side = np.array([r["r" + a] for a in AX])
                    side /= np.linalg.norm(side)
                    up, how = mean_up - (mean_up @ side) * side, "held level, walk straight"
                up = up / np.linalg.norm(up)
                up = -up if up @ mean_up < 0 else up
                out.append([r["scene_id"], *up, how, spread, r["share"], r["look_down"]])
            yield pd.DataFrame(out, columns=["scene_id", "upx", "upy", "upz", "method", "spread", "share", "look_down"])

    return row.mapInPandas(solve, "scene_id int, upx double, upy double, upz double, method string, spread double, share double, look_down double")


def site_frame(up: DataFrame, cameras: DataFrame, held: DataFrame, scale: float | None = None) -> DataFrame:
    """Per scene the 3x4 matrix into site axes: Z up, Y the walk's mean heading, origin on the ground below the first camera."""
    head = cameras.groupBy("scene_id").agg(*[_mean(F.col("f" + a)).alias("h" + a) for a in AX], *[F.min_by("p" + a, "frame").alias("c" + a) for a in AX], F.min_by("name", "frame").alias("first_camera"))
    r = up.join(head, "scene_id").join(held, "scene_id", "left")
    z = g.vec("upx", "upy", "upz")
    y = g.level_part(g.vec("hx", "hy", "hz"), z)
    r = r.withColumns({"y" + a: c for a, c in zip(AX, y)})
    y = g.vec("yx", "yy", "yz")
    x = g.cross(y, z)
    r = r.withColumns({"x" + a: c for a, c in zip(AX, x)})
    drop = -F.coalesce("held", F.lit(0.0))
    origin = [F.col("c" + a) + drop * F.col("up" + a) for a in AX]
    s = float(scale) if scale else 1.0
    rows = [g.vec("xx", "xy", "xz"), y, z]
    m = {f"m{k}{c}": rows[k][c] * s for k in range(3) for c in range(3)}
    m |= {f"m{k}3": -g.dot(rows[k], tuple(origin)) * s for k in range(3)}
    return r.select("scene_id", *[c.alias(n) for n, c in m.items()], "first_camera", (F.coalesce("held", F.lit(0.0)) * s).alias("first_camera_height"), F.lit("metres" if scale else "scan units").alias("units"))


def move_candidates(scenes: DataFrame, checks: int = 5) -> DataFrame:
    """Cameras of every candidate move: ``scenes`` has poi (ox, oy, oz), side (ex, ey), dist, eye. Columns scene_id, move,
    size (bigger is better), frame, position and pinhole axes."""
    sizes = {"orbit": [float(a) for a in range(120, 0, -20)], "pass_by": [k / 10 for k in range(9, 0, -2)], "rise_and_tilt": [k / 10 for k in range(16, 1, -2)],
             "push_in": [k / 10 for k in range(18, 7, -2)], "dolly_zoom": [k / 10 for k in range(18, 7, -2)]}
    tries = F.array(*[F.struct(F.lit(m).alias("move"), F.lit(s).alias("size")) for m, v in sizes.items() for s in v])
    places = F.array(*[F.lit(k / (checks - 1)) for k in range(checks)])
    c = scenes.withColumn("_m", F.explode(tries)).select(*scenes.columns, "_m.move", "_m.size").withColumn("t", F.explode(places))
    s = F.col("t") * F.col("t") * (3 - 2 * F.col("t"))
    e, a = F.col("move"), F.atan2("ey", "ex") + F.radians(F.col("size") * (s - 0.5))
    side = lambda k: (F.col("ox") + F.col("ex") * F.col("dist") * k, F.col("oy") + F.col("ey") * F.col("dist") * k)
    travel = F.col("size") * (2 * s - 1) * F.col("dist")
    reach = F.when(e == "push_in", F.col("size") * (1 - s) + 0.4 * s).otherwise(0.4 * (1 - s) + F.col("size") * s)
    lift = F.col("eye") * (0.8 + 0.8 * (reach - 0.4) / 1.4)
    px = F.when(e == "orbit", F.col("ox") + 0.9 * F.col("dist") * F.cos(a)).when(e == "pass_by", side(1.0)[0] - F.col("ey") * travel).when(e == "rise_and_tilt", side(1.0)[0] * (1 - s) + F.col("ox") * s).otherwise(side(reach)[0])
    py = F.when(e == "orbit", F.col("oy") + 0.9 * F.col("dist") * F.sin(a)).when(e == "pass_by", side(1.0)[1] + F.col("ex") * travel).when(e == "rise_and_tilt", side(1.0)[1] * (1 - s) + F.col("oy") * s).otherwise(side(reach)[1])
    pz = F.col("oz") + F.when(e == "rise_and_tilt", F.col("eye") * (1 - s) + F.col("size") * F.col("dist") * s).when(e.isin("push_in", "dolly_zoom"), lift).otherwise(F.col("eye"))
    c = c.withColumns({"px": px, "py": py, "pz": pz})
    d = tuple(F.col("o" + q) - F.col("p" + q) for q in AX)
    f = g.unit(d)
    c = c.withColumns({"fx": f[0], "fy": f[1], "fz": f[2], "_far": g.length(d)})
    # looking straight down, "up" in the picture is the heading the camera came with
    side_x, side_y = F.col("fy"), -F.col("fx")
    flat = F.sqrt(side_x * side_x + side_y * side_y)
    c = c.withColumns({"sx": F.when(flat > 1e-6, side_x / flat).otherwise(-F.col("ey")), "sy": F.when(flat > 1e-6, side_y / flat).otherwise(F.col("ex")), "sz": F.lit(0.0)})
    down = g.cross(g.vec("fx", "fy", "fz"), g.vec("sx", "sy", "sz"))
    near = 0.4 * F.col("dist")
    focal = F.when(e == "dolly_zoom", 500.0 * F.col("_far") / F.sqrt(near * near + F.col("eye") * F.col("eye") * 0.64)).otherwise(500.0)
    c = c.withColumns({"dx": down[0], "dy": down[1], "dz": down[2], "focal": focal, "width": F.lit(640), "height": F.lit(480)})
    return c.withColumn("frame", F.xxhash64("move", "size", "t")).drop("_far", "t", "ox", "oy", "oz", "ex", "ey", "dist", "eye")


def frame_coverage(points: DataFrame, cameras: DataFrame, width: int = 64, height: int = 48) -> DataFrame:
    """Share of each frame that shows seen surface; unseen points hide what is behind them."""
    return visibility.coverage(points, cameras, width, height)


def camera_moves(points: DataFrame, cameras: DataFrame, scenes: DataFrame) -> DataFrame:
    """The largest size of each move at which every checked frame covers at least what nine in ten of the walk's frames do.

    All candidates are measured in one job; the reference size is the walk's own coverage.
    """
    walk = frame_coverage(points, cameras)
    yard = quantiles(walk, ["scene_id"], "coverage", {"yard": 0.1})
    cand = move_candidates(scenes)
    cov = frame_coverage(points, cand.drop("move", "size"))
    held = cand.select("scene_id", "frame", "move", "size").join(cov, ["scene_id", "frame"], "left").join(yard, "scene_id")
    worst = held.groupBy("scene_id", "move", "size").agg(F.min(F.coalesce("coverage", F.lit(0.0))).alias("least"), F.first("yard").alias("yard"))
    ok = worst.where(F.col("least") >= F.col("yard"))
    best = ok.groupBy("scene_id", "move").agg(F.max("size").alias("size"), F.max_by("least", "size").alias("least"))
    return best.join(yard, "scene_id")
