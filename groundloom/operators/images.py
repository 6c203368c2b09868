"""Pixel tables: sharpness, edges, depth maps, privacy blocks, observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from groundloom.functions.numeric import exact_sum, exact_mean
from groundloom.operators.order_stats import quantiles, select_ranks
from groundloom.session import in_parts

PIX = ["scene_id", "u", "v"]


def with_neighbours(pixels: DataFrame, value: str, offsets: dict[str, tuple[int, int]], parts: int | None = None) -> DataFrame:
    """Adds the value at u+du, v+dv under each name (NULL where no pixel): one scatter and one gather."""
    steps = [F.struct(F.lit("").alias("n"), F.lit(0).alias("du"), F.lit(0).alias("dv"))]
    steps += [F.struct(F.lit(n).alias("n"), F.lit(-du).alias("du"), F.lit(-dv).alias("dv")) for n, (du, dv) in offsets.items()]
    rest = [c for c in pixels.columns if c not in PIX]
    at = pixels.withColumn("_o", F.explode(F.array(*steps)))
    at = at.withColumn("u", F.col("u") + F.col("_o.du")).withColumn("v", F.col("v") + F.col("_o.dv"))
    own = F.col("_o.n") == ""
    g = in_parts(at, parts, *PIX).groupBy(*PIX).agg(F.max(F.when(own, F.struct(*rest))).alias("_own"), *[F.max(F.when(F.col("_o.n") == n, F.col(value))).alias(n) for n in offsets])
    return g.where("_own IS NOT NULL").select(*PIX, *[F.col("_own." + c).alias(c) for c in rest], *offsets)


CROSS = {"left": (-1, 0), "right": (1, 0), "up": (0, -1), "down": (0, 1)}


def sharpness(pixels: DataFrame, value: str) -> DataFrame:
    """Variance of the four-neighbour Laplacian over interior pixels; whole-number grey makes the sums exact."""
    n = with_neighbours(pixels.select(*PIX, value), value, CROSS).where("left IS NOT NULL AND right IS NOT NULL AND up IS NOT NULL AND down IS NOT NULL")
    lap = (F.col("left") + F.col("right") + F.col("up") + F.col("down") - 4 * F.col(value)).cast("bigint")
    s = n.withColumn("_l", lap).groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"), F.sum("_l").alias("s"), F.sum(F.col("_l") * F.col("_l")).alias("q"))
    mean = F.col("s").cast("double") / F.col("n")
    return s.select("scene_id", "n", (F.col("q").cast("double") / F.col("n") - mean * mean).alias("sharpness"))


def prune_blurry(scored: DataFrame, keys: list[str], score: str, tie: str, percent: float, least: int = 20) -> DataFrame:
    """Adds ``dropped``: among the floor(n * percent / 100) blurriest of the key; keys under ``least`` rows keep all."""
    n = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    s = scored.join(n, keys).withColumn("_drop", F.when((F.col("_n") >= least) & (F.lit(percent) > 0), F.floor(F.col("_n") * percent / 100.0).cast("bigint")).otherwise(0))
    cut = select_ranks(s.where("_drop > 0"), [*keys, "_drop"], score, {"cut": lambda total: F.col("_drop") - 1})
    cut = cut.select(*keys, F.col("value").alias("_cut"))
    s = s.join(cut, keys, "left")
    # rows tied with the threshold fill what room is left, by the smallest tie id
    tied = s.where(F.col(score) == F.col("_cut"))
    below = s.where(F.col(score) < F.col("_cut")).groupBy(*keys).agg(F.count(F.lit(1)).alias("_below"))
    room = tied.join(below, keys, "left").withColumn("_room", F.col("_drop") - F.coalesce("_below", F.lit(0)))
    last = select_ranks(room, [*keys, "_room"], tie, {"last": lambda total: F.least(total, F.col("_room")) - 1}).select(*keys, F.col("value").alias("_last"))
    s = s.join(last, keys, "left")
    gone = F.coalesce((F.col(score) < F.col("_cut")) | ((F.col(score) == F.col("_cut")) & (F.col(tie) <= F.col("_last"))), F.lit(False))
    return s.withColumn("dropped", gone).drop("_n", "_drop", "_cut", "_last")


def depth_edges(pixels: DataFrame, limit: float = 0.03, parts: int | None = None) -> DataFrame:
    """Adds ``keep``: the relative depth step to the previous pixel in u and in v stays under ``limit``."""
    n = with_neighbours(pixels, "depth", {"left": (-1, 0), "up": (0, -1)}, parts)
    step = F.greatest(F.abs(F.col("depth") - F.coalesce("left", "depth")), F.abs(F.col("depth") - F.coalesce("up", "depth")))
    return n.withColumn("step", step / F.greatest("depth", F.lit(1e-6))).withColumn("keep", F.col("step") < limit).drop("left", "up")


def depth_normals(pixels: DataFrame, focal: float, parts: int | None = None) -> DataFrame:
    """Unit normals from central depth differences, one-sided where a neighbour is missing."""
    n = with_neighbours(pixels, "depth", CROSS, parts)
    slope = lambda a, b: F.coalesce((F.col(b) - F.col(a)) / 2, F.col(b) - F.col("depth"), F.col("depth") - F.col(a), F.lit(0.0))
    safe = F.greatest("depth", F.lit(1e-6))
    n = n.withColumns({"gx": slope("left", "right") * focal / safe, "gy": slope("up", "down") * focal / safe})
    ln = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") + 1)
    return n.withColumns({"nx": F.col("gx") / ln, "ny": F.col("gy") / ln, "nz": -1 / ln}).drop("left", "right", "up", "down", "gx", "gy")


def unproject(pixels: DataFrame, focal: float, cx: float, cy: float, stride: int = 1) -> DataFrame:
    """Pixel and depth to camera axes, with the splat size that covers the pixel's own footprint."""
    z = F.col("depth")
    return pixels.where(z > 0).withColumns({"X": (F.col("u") - cx) * z / focal, "Y": (F.col("v") - cy) * z / focal, "Z": z, "size": z * stride / focal * 0.75})


def photo_grid(splats: DataFrame, focal: float, width: int, height: int, stride: int) -> tuple[DataFrame, DataFrame]:
    """Splats back on their photo's stride grid (the first wins a cell), and the counts per scene."""
    s = splats.where("Z > 1e-6")
    spot = lambda a, n: F.floor((F.col(a) / F.col("Z") * focal + n / 2.0) / stride + 0.5).cast("bigint")
    s = s.withColumn("j", spot("X", width)).withColumn("k", spot("Y", height))
    inside = (F.col("j") >= 0) & (F.col("k") >= 0) & (F.col("j") < (width - 1) // stride + 1) & (F.col("k") < (height - 1) // stride + 1)
    grid = s.where(inside).groupBy("scene_id", "k", "j").agg(F.min_by("Z", "splat_id").alias("depth"), F.count(F.lit(1)).alias("hits"))
    counts = s.groupBy("scene_id").agg(F.sum(F.when(inside, 0).otherwise(1)).alias("outside"))
    placed = grid.groupBy("scene_id").agg(F.count(F.lit(1)).alias("placed"), F.sum(F.col("hits") - 1).alias("collided"))
    return grid, counts.join(placed, "scene_id", "left")


def grown_boxes(detections: DataFrame, grow: float, width: int, height: int) -> DataFrame:
    """Boxes grown about their centre and clipped to the frame, in whole pixels."""
    g = lambda p, s: F.col(p) + F.col(s) / 2 - F.col(s) * (1 + grow) / 2
    cut = lambda c, n: F.least(F.lit(n), F.greatest(F.lit(0), c.cast("int")))
    d = detections.withColumns({"x0": cut(g("x", "w"), width), "y0": cut(g("y", "h"), height),
                                "x1": cut(g("x", "w") + F.col("w") * (1 + grow), width), "y1": cut(g("y", "h") + F.col("h") * (1 + grow), height)})
    return d.where("x1 > x0 AND y1 > y0")


def pixelate(pixels: DataFrame, boxes: DataFrame, value: str, block: int = 16) -> DataFrame:
    """Pixels inside a box take the mean of their block of that box (blocks run from the box's corner).

    Boxes meet pixels on block-sized tiles: an equi-join, however large a box is.
    """
    b = boxes.withColumn("_tu", F.explode(F.sequence(F.floor(F.col("x0") / block), F.floor((F.col("x1") - 1) / block))))
    b = b.withColumn("_tv", F.explode(F.sequence(F.floor(F.col("y0") / block), F.floor((F.col("y1") - 1) / block))))
    p = pixels.withColumn("_tu", F.floor(F.col("u") / block)).withColumn("_tv", F.floor(F.col("v") / block))
    hit = p.join(b.select("scene_id", "box", "x0", "y0", "x1", "y1", "_tu", "_tv"), ["scene_id", "_tu", "_tv"]).where("u >= x0 AND v >= y0 AND u < x1 AND v < y1")
    hit = hit.withColumn("bu", F.floor((F.col("u") - F.col("x0")) / block)).withColumn("bv", F.floor((F.col("v") - F.col("y0")) / block))
    mean = hit.groupBy("scene_id", "box", "bu", "bv").agg(exact_mean(F.col(value).cast("double")).alias("mean"), F.count(F.lit(1)).alias("pixels"))
    return mean


def quality_observations(obs: DataFrame, max_err: float = 2.0, min_track: int = 3, min_points: int = 100) -> DataFrame:
    """Sightings of well-triangulated points in front of the camera, in frames that have enough of them."""
    depth = (F.col("x") - F.col("px")) * F.col("fx") + (F.col("y") - F.col("py")) * F.col("fy") + (F.col("z") - F.col("pz")) * F.col("fz")
    good = obs.where((F.col("err") < max_err) & (F.col("track") >= min_track)).withColumn("depth", depth).where("depth > 0")
    n = good.groupBy("scene_id", "frame").agg(F.count(F.lit(1)).alias("points")).where(F.col("points") >= min_points)
    return good.join(n, ["scene_id", "frame"])


def depth_scores(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Per frame: scale s = median(d/p), absolute relative error, share within 1.25, metric bias; p predicted, d true."""
    ok = pairs.where("p > 1e-6").withColumn("_r", F.col("d") / F.col("p")).withColumn("_b", F.col("p") / F.col("d"))
    med = quantiles(ok, keys, "_r", {"s": 0.5}, count="n").join(quantiles(ok, keys, "_b", {"bias": 0.5}), keys)
    at = ok.join(med.select(*keys, "s"), keys)
    ratio = F.col("s") * F.col("p") / F.col("d")
    g = at.groupBy(*keys).agg(exact_mean(F.abs(F.col("s") * F.col("p") - F.col("d")) / F.col("d")).alias("absrel"),
                              (F.sum(F.when(F.greatest(ratio, 1 / ratio) < 1.25, 1).otherwise(0)) / F.count(F.lit(1))).alias("delta1"))
    return med.join(g, keys).select(*keys, "s", "absrel", "delta1", (F.col("bias") - 1).alias("metric"), "n")


def texel_blend(looks: DataFrame, key: list[str], channels: list[str]) -> DataFrame:
    """Colour per texel: score^2-weighted mean of the frames that see it, else its best frame's colour, else grey."""
    w = F.when(F.col("seen"), F.col("score") * F.col("score")).otherwise(0.0)
    g = looks.withColumn("_w", w).groupBy(*key).agg(
        (exact_sum("_w")).alias("_s"), *[(exact_sum(F.col("_w") * F.col(c))).alias("_" + c) for c in channels],
        F.max_by(F.struct(*channels), F.when(F.col("inside"), F.struct("score", -F.col("frame")))).alias("_best"))
    pick = lambda c: F.when(F.col("_s") > 0, F.col("_" + c) / F.col("_s")).otherwise(F.coalesce(F.col("_best." + c).cast("double"), F.lit(128.0)))
    how = F.when(F.col("_s") > 0, "direct").when(F.col("_best").isNotNull(), "fallback").otherwise("grey")
    return g.select(*key, how.alias("how"), *[pick(c).alias(c) for c in channels])


def coverage(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Share of a frame's pixels that show seen surface; ``pixels`` has frame keys, u, v, seen. One-pixel gaps with at
    least six of eight neighbours filled take the majority of them."""
    ring = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    at = pixels.withColumn("_o", ring)
    home = (F.col("_o.a") == 0) & (F.col("_o.b") == 0)
    at = at.select("scene_id", "frame", (F.col("u") + F.col("_o.a")).alias("u"), (F.col("v") + F.col("_o.b")).alias("v"), F.when(home, F.col("seen").cast("int")).alias("own"), F.when(~home, F.col("seen").cast("int")).alias("nb"))
    at = at.where((F.col("u") >= 0) & (F.col("v") >= 0) & (F.col("u") < width) & (F.col("v") < height))
    g = at.groupBy("scene_id", "frame", "u", "v").agg(F.max("own").alias("own"), F.count("nb").alias("nf"), F.coalesce(F.sum("nb"), F.lit(0)).alias("ns"))
    shown = F.coalesce(F.col("own"), F.when((F.col("nf") >= 6) & (2 * F.col("ns") >= F.col("nf")), 1).otherwise(0))
    return g.groupBy("scene_id", "frame").agg(F.sum(shown).alias("seen_pixels"), (F.sum(shown) / (width * height)).alias("coverage"))
