"""A mesh drawn straight from above and from its four sides: the nearest surface and its colour at every pixel."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from groundloom.operators import meet

#: For each view the drawing's right, its up, and the direction towards the viewer, as signed axes.
VIEWS = {"plan": ("x", "y", "z"), "south": ("x", "z", "-y"), "north": ("-x", "z", "y"), "west": ("-y", "z", "-x"), "east": ("y", "z", "x")}
#: Side of a picture tile in pixels.
TILE = 64
EDGE = 1e-9
#: Pixels in the boxes of a scene's faces over all views, and texels of its texture, up to which it is drawn in one group.
WHOLE = 1 << 22
#: The colour of a texel that no frame has painted.
GREY = 128.0


def _along(axis: str, corner: str):
    c = F.col(axis[-1] + corner)
    return -c if axis[0] == "-" else c


def drawings(corners: DataFrame, px: float, views: dict[str, tuple[str, str, str]] = VIEWS, tile: int = TILE) -> DataFrame:
    """scene_id, view, iu, iv, depth, r, g, b, layers for every pixel of every view whose centre some face covers.

    ``corners``: scene_id, fid and for each corner k in a, b, c its place xk, yk, zk and colour rk, gk, bk. Pixels of side ``px`` are counted
    from a view's left upper corner; depth is measured towards the viewer, the largest wins, then the smallest fid; colours are
    interpolated and rounded. A face is cut into the picture tiles that it touches; faces over several tiles are dealt over all tasks tile by
    tile, so one that fills the picture is nobody's alone. Faces seen edge-on cover nothing.
    """
    top = nearest_faces(corners, px, views, tile, "rgb")
    return top.select("scene_id", "view", "iu", "iv", "depth", *[F.floor(F.col(c) + 0.5).cast("int").alias(c) for c in "rgb"], "layers")


def nearest_faces(corners: DataFrame, px: float, views: dict[str, tuple[str, str, str]], tile: int, carry: str) -> DataFrame:
    """What ``drawings`` sees at each pixel: depth, layers, and the columns that the letters of ``carry`` name at the corners, interpolated."""
    faces = corners.select("*", F.explode(F.array(*[
        F.struct(F.lit(name).alias("view"), *[_along(axis, k).alias(p + k) for p, axis in zip("uvd", axes) for k in "abc"]) for name, axes in views.items()
    ])).alias("_v")).select("scene_id", "fid", *[c + k for c in carry for k in "abc"], "_v.*")
    edge = faces.groupBy("scene_id", "view").agg(F.min(F.least("ua", "ub", "uc")).alias("u0"), F.max(F.greatest("va", "vb", "vc")).alias("v1"))
    f = faces.join(edge, ["scene_id", "view"])
    for k in "abc":
        f = f.withColumn("u" + k, (F.col("u" + k) - F.col("u0")) / px).withColumn("v" + k, (F.col("v1") - F.col("v" + k)) / px)
    for p in "uv":  # pixels whose centres lie in the face's box
        f = f.withColumn(p + "_0", F.ceil(F.least(*[p + k for k in "abc"]) - 0.5)).withColumn(p + "_1", F.floor(F.greatest(*[p + k for k in "abc"]) - 0.5))
    side = lambda p, k: F.col(p + k) - F.col(p + "a")
    f = f.withColumn("den", side("u", "b") * side("v", "c") - side("u", "c") * side("v", "b")).where("u_0 <= u_1 AND v_0 <= v_1 AND den <> 0").drop("u0", "v1")
    tiles = lambda p: F.explode(F.sequence(F.floor(F.col(p + "_0") / tile), F.floor(F.col(p + "_1") / tile)))
    several = (F.floor(F.col("u_0") / tile) != F.floor(F.col("u_1") / tile)) | (F.floor(F.col("v_0") / tile) != F.floor(F.col("v_1") / tile))
    wide = f.where(several).withColumn("tu", tiles("u")).withColumn("tv", tiles("v")).repartition("scene_id", "view", "tu", "tv", "fid")
    near = f.where(~several).withColumn("tu", F.floor(F.col("u_0") / tile)).withColumn("tv", F.floor(F.col("v_0") / tile))
    f = wide.unionByName(near)
    for p in "uv":
        first = F.greatest(p + "_0", F.col("t" + p) * tile)
        f = f.withColumn("i" + p, F.explode(F.sequence(first, F.least(F.col(p + "_1"), F.col("t" + p) * tile + (tile - 1)))))
    pu, pv = F.col("iu") + 0.5 - F.col("ua"), F.col("iv") + 0.5 - F.col("va")
    f = f.withColumn("l1", (pu * side("v", "c") - side("u", "c") * pv) / F.col("den")).withColumn("l2", (side("u", "b") * pv - pu * side("v", "b")) / F.col("den"))
    f = f.where((F.col("l1") >= -EDGE) & (F.col("l2") >= -EDGE) & (F.col("l1") + F.col("l2") <= 1 + EDGE))
    mix = lambda c: F.col(c + "a") + F.col("l1") * side(c, "b") + F.col("l2") * side(c, "c")
    shade = F.struct(*[mix(c).alias(c) for c in carry])
    rank = F.struct(mix("d").alias("depth"), (-F.col("fid")).alias("first"))
    top = f.groupBy("scene_id", "view", "iu", "iv").agg(F.max(F.struct(rank.alias("rank"), shade.alias("shade"))).alias("top"), F.count(F.lit(1)).alias("layers"))
    return top.select("scene_id", "view", "iu", "iv", F.col("top.rank.depth").alias("depth"), "top.shade.*", "layers")


def ortho(corners: DataFrame, texture: DataFrame, px: float, parts: int, views: dict[str, tuple[str, str, str]] = VIEWS, whole: int = WHOLE) -> DataFrame:
    """The textured mesh in every view: scene_id, view, iu, iv, depth, r, g, b for every pixel whose centre some face covers; others stay white.

    ``corners``: scene_id, fid, and for each corner k in a, b, c its place xk, yk, zk and its texture coordinates sk (column) and tk (row), texel
    centres at whole numbers; ``texture``: scene_id, row, col, r, g, b, grey where a texel is missing. The nearest face wins as in ``drawings``; its
    texture coordinates are interpolated there, and the colour is looked up between the four texels around them (the border's beyond it).
    Scenes of up to ``whole`` pixels in their faces' boxes and as many texels are drawn in a group of their own, so pixels are not shuffled;
    larger ones are drawn tile by tile and joined with their texels.
    """
    long = lambda axis: f"((greatest({axis}a, {axis}b, {axis}c) - least({axis}a, {axis}b, {axis}c)) / {px!r} + 1)"
    box = " + ".join(f"{long(u[-1])} * {long(v[-1])}" for u, v, _ in views.values())
    boxes = corners.groupBy("scene_id").agg(F.sum(F.expr(box)).alias("_n")).where(F.col("_n") > whole).select("scene_id")
    texels = texture.groupBy("scene_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > whole).select("scene_id")
    large = [x["scene_id"] for x in boxes.unionByName(texels).distinct().collect()]  # there are at most pixels / whole of them
    kinds = {f.name: f.dataType.simpleString() for f in corners.schema}
    schema = f"scene_id {kinds['scene_id']}, view string, iu bigint, iv bigint, depth double, r int, g int, b int"
    keep = lambda df: df.where(~F.col("scene_id").isin(large)) if large else df
    # both stem from the same points: new names for one side
    painted = keep(texture).select(*[F.col(c).alias("_" + c) for c in ("scene_id", "row", "col", "r", "g", "b")])
    meshes, painted = keep(corners).repartition(parts, "scene_id").groupBy("scene_id"), painted.repartition(parts, "_scene_id").groupBy("_scene_id")
    small = meshes.cogroup(painted).applyInArrow(lambda c, x: _ortho(c, x.rename_columns([n.removeprefix("_") for n in x.column_names]), px, views), schema)
    if not large:
        return small
    mine = lambda df: df.where(F.col("scene_id").isin(large))
    return small.unionByName(coloured(nearest_faces(mine(corners), px, views, TILE, "st").drop("layers"), mine(texture)).select(*small.columns))


def coloured(pixels: DataFrame, texture: DataFrame) -> DataFrame:
    """Pixels with texture coordinates s, t and the colour r, g, b there instead: one join on the texel to the upper left, which knows the other three."""
    last = texture.groupBy("scene_id").agg(F.max("row").cast("double").alias("_rows"), F.max("col").cast("double").alias("_cols"))
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    spread = texture.withColumn("_o", steps).select("scene_id", (F.col("row") - F.col("_o.a")).alias("_r0"), (F.col("col") - F.col("_o.b")).alias("_c0"), "_o", "r", "g", "b")
    pick = lambda a, b, c: F.max(F.when((F.col("_o.a") == a) & (F.col("_o.b") == b), F.col(c).cast("double"))).alias(f"_{c}{a}{b}")
    blocks = spread.groupBy("scene_id", "_r0", "_c0").agg(*[pick(a, b, c) for c in "rgb" for a in (0, 1) for b in (0, 1)])
    p = pixels.join(last, "scene_id", "left")
    for c, end in (("s", "_cols"), ("t", "_rows")):
        p = p.withColumn(c, F.least(F.greatest(c, F.lit(0.0)), F.coalesce(end, F.lit(0.0))))
    p = p.withColumn("_r0", F.floor("t")).withColumn("_c0", F.floor("s")).withColumn("_fx", F.col("s") - F.col("_c0")).withColumn("_fy", F.col("t") - F.col("_r0"))
    at = lambda c, a, b: f"coalesce(_{c}{a}{b}, {GREY}D)"
    mix = lambda c: f"{at(c, 0, 0)}*(1-_fx)*(1-_fy)+{at(c, 0, 1)}*_fx*(1-_fy)+{at(c, 1, 0)}*(1-_fx)*_fy+{at(c, 1, 1)}*_fx*_fy"
    return p.join(blocks, ["scene_id", "_r0", "_c0"], "left").select("scene_id", "view", "iu", "iv", "depth", *[F.expr(f"CAST(floor({mix(c)} + 5e-1) AS INT)").alias(c) for c in "rgb"])


def _ortho(corners: pa.Table, texture: pa.Table, px: float, views: dict[str, tuple[str, str, str]]) -> pa.Table:
    """One scene, in the order of operations that the tables have."""
    fid = meet.columns(corners, "fid")[0] if corners.num_rows else np.empty(0, np.int64)
    place = {c + k: corners[c + k].to_numpy().astype(float) for c in "xyzst" for k in "abc"} if corners.num_rows else {}
    along = lambda axis: [-place[axis[-1] + k] if axis[0] == "-" else place[axis[-1] + k] for k in "abc"]
    out = []
    for name, axes in views.items() if corners.num_rows else ():
        u, v, d = map(along, axes)
        u0, v1 = min(x.min() for x in u), max(x.max() for x in v)
        u, v = [(x - u0) / px for x in u], [(v1 - x) / px for x in v]
        first = [np.ceil(np.minimum.reduce(x) - 0.5).astype(np.int64) for x in (u, v)]
        size = [np.floor(np.maximum.reduce(x) - 0.5).astype(np.int64) - f + 1 for x, f in zip((u, v), first)]
        den = (u[1] - u[0]) * (v[2] - v[0]) - (u[2] - u[0]) * (v[1] - v[0])
        n = np.where(den != 0, np.maximum(size[0], 0) * np.maximum(size[1], 0), 0)
        f = np.repeat(np.arange(len(n)), n)  # a row for each pixel of each face's box
        k = np.arange(len(f)) - np.repeat(np.cumsum(n) - n, n)
        iu, iv = first[0][f] + k // size[1][f], first[1][f] + k % size[1][f]
        (ua, ub, uc), (va, vb, vc) = ([c[f] for c in x] for x in (u, v))
        pu, pv = iu + 0.5 - ua, iv + 0.5 - va
        l1, l2 = (pu * (vc - va) - (uc - ua) * pv) / den[f], ((ub - ua) * pv - pu * (vb - va)) / den[f]
        on = (l1 >= -EDGE) & (l2 >= -EDGE) & (l1 + l2 <= 1 + EDGE)
        f, iu, iv, l1, l2 = (c[on] for c in (f, iu, iv, l1, l2))
        mix = lambda a, b, c: a[f] + l1 * (b[f] - a[f]) + l2 * (c[f] - a[f])  # noqa: E731, B023
        depth = mix(*d)
        order = np.lexsort((fid[f], -depth, iu << 32 | iv))
        pixel = (iu << 32 | iv)[order]
        top = order[np.diff(pixel, prepend=-1) != 0]
        s, t = (mix(*along(c))[top] for c in "st")
        out.append(pa.table({"view": pa.repeat(name, len(top)), "iu": iu[top], "iv": iv[top], "depth": depth[top], **_looked_up(texture, s, t)}))
    if not out:
        return pa.table({}, schema=pa.schema([]))
    rows = pa.concat_tables(out)
    return rows.add_column(0, "scene_id", meet.constant(corners["scene_id"][0].as_py(), rows.num_rows, corners, "scene_id"))


def _looked_up(texture: pa.Table, s: np.ndarray, t: np.ndarray) -> dict[str, pa.Array]:
    """Colours between the four texels around (s, t)."""
    row, col = (texture[c].to_numpy().astype(np.int64) if texture.num_rows else np.empty(0, np.int64) for c in ("row", "col"))
    key = row << 32 | col
    order = np.argsort(key)
    key = np.append(key[order], -1)[: len(order)]
    s, t = (np.minimum(np.maximum(c, 0.0), float(last.max()) if len(last) else 0.0) for c, last in ((s, col), (t, row)))
    r0, c0 = np.floor(t).astype(np.int64), np.floor(s).astype(np.int64)
    fx, fy = s - c0, t - r0
    at = []
    for a, b in ((0, 0), (0, 1), (1, 0), (1, 1)):
        want = (r0 + a) << 32 | (c0 + b)
        k = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
        at.append((k, key[k] == want) if len(key) else (k, np.zeros(len(k), bool)))
    out = {}
    for c in "rgb":
        own = texture[c].to_numpy().astype(float)[order] if len(key) else np.zeros(1)
        nw, ne, sw, se = (np.where(there, own[k], GREY) for k, there in at)
        out[c] = pa.array(np.floor(nw * (1 - fx) * (1 - fy) + ne * fx * (1 - fy) + sw * (1 - fx) * fy + se * fx * fy + 0.5).astype(np.int32))
    return out
