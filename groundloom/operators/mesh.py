"""Triangle meshes as vertex and face tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from groundloom.functions.numeric import exact_sum
from groundloom.functions.constants import CELL_STRIDE as S
from groundloom.session import in_parts


def cell_vertices(grid: DataFrame, meta: DataFrame, cell: float = 0.5) -> DataFrame:
    """A vertex per cell centre; its id is i*stride + j."""
    at = grid.join(meta.select("scene_id", "x0", "y1"), "scene_id")
    return at.select(
        "scene_id", (F.col("i") * S + F.col("j")).alias("vid"),
        (F.col("x0") + (F.col("j") + 0.5) * cell).alias("x"), (F.col("y1") - (F.col("i") + 0.5) * cell).alias("y"), "z",
    )


def quad_corner_ids() -> list[Column]:
    """South-west, south-east, north-east, north-west vertex ids of a quad: counter-clockwise from above."""
    i, j = F.col("i"), F.col("j")
    return [(i + 1) * S + j, (i + 1) * S + j + 1, i * S + j + 1, i * S + j]


def quad_faces(quads: DataFrame) -> DataFrame:
    """Two triangles per quad."""
    sw, se, ne, nw = quad_corner_ids()
    base = (F.col("i") * S + F.col("j")) * 2
    tri = F.array(
        F.struct(base.alias("fid"), sw.alias("a"), se.alias("b"), ne.alias("c")),
        F.struct((base + 1).alias("fid"), sw.alias("a"), ne.alias("b"), nw.alias("c")),
    )
    return quads.select("scene_id", F.explode(tri).alias("t")).select("scene_id", "t.fid", "t.a", "t.b", "t.c")


def face_corners(faces: DataFrame, vertices: DataFrame, parts: int | None = None) -> DataFrame:
    """Faces with the coordinates of their corners: one join and one gather instead of three joins."""
    corner = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("vid")) for k, c in enumerate("abc")]))
    spread = faces.select("scene_id", "fid", corner.alias("e")).select("scene_id", "fid", "e.k", "e.vid")
    at = in_parts(spread, parts, "scene_id", "vid").join(in_parts(vertices, parts, "scene_id", "vid"), ["scene_id", "vid"])
    out = [F.max(F.when(F.col("k") == k, F.col(ax))).alias(ax + n) for k, n in enumerate("abc") for ax in ("x", "y", "z")]
    return in_parts(at, parts, "scene_id", "fid").groupBy("scene_id", "fid").agg(*out, F.count(F.lit(1)).alias("_n")).where("_n = 3").drop("_n")


def quad_corners(blocks: DataFrame, meta: DataFrame, cell: float) -> DataFrame:
    """The corners of both faces of each quad as ``face_corners`` has them, and as texture coordinates the texel of each corner's cell (column sk, row tk).

    ``blocks`` are those of ``raster.full_blocks``: a quad knows its four heights, so nothing is joined but the frame.
    """
    spot = {"nw": (0, 0), "ne": (0, 1), "sw": (1, 0), "se": (1, 1)}

    def corner(name: str, k: str) -> list[Column]:
        i, j = F.col("i") + spot[name][0], F.col("j") + spot[name][1]
        x, y = F.col("x0") + (j + 0.5) * cell, F.col("y1") - (i + 0.5) * cell
        return [x.alias("x" + k), y.alias("y" + k), F.col(name).alias("z" + k), j.cast("double").alias("s" + k), i.cast("double").alias("t" + k)]

    base = (F.col("i") * S + F.col("j")) * 2
    face = lambda fid, *names: F.struct(fid.alias("fid"), *[c for n, k in zip(names, "abc") for c in corner(n, k)])
    both = F.array(face(base, "sw", "se", "ne"), face(base + 1, "sw", "ne", "nw"))
    return blocks.join(meta.select("scene_id", "x0", "y1"), "scene_id").select("scene_id", F.explode(both).alias("_f")).select("scene_id", "_f.*")


def cross(u: tuple, v: tuple) -> tuple:
    return (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])


def _vec(p: str, q: str) -> tuple:
    return tuple(F.col(ax + q) - F.col(ax + p) for ax in ("x", "y", "z"))


def with_normal(corners: DataFrame) -> DataFrame:
    """Adds the face normal (length = twice the area), area and edge lengths."""
    n = cross(_vec("a", "b"), _vec("a", "c"))
    ln = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    out = corners.withColumns({"fnx": n[0], "fny": n[1], "fnz": n[2]})
    return out.withColumns({
        "area": F.lit(0.5) * F.sqrt(F.col("fnx") * F.col("fnx") + F.col("fny") * F.col("fny") + F.col("fnz") * F.col("fnz")),
        "longest": F.greatest(ln(_vec("a", "b")), ln(_vec("b", "c")), ln(_vec("c", "a"))),
    })


def vertex_normals(corners: DataFrame, faces: DataFrame) -> DataFrame:
    """Area-weighted vertex normals."""
    n = with_normal(corners).select("scene_id", "fid", "fnx", "fny", "fnz")
    at = faces.join(n, ["scene_id", "fid"]).select("scene_id", F.explode(F.array("a", "b", "c")).alias("vid"), "fnx", "fny", "fnz")
    s = at.groupBy("scene_id", "vid").agg(*[(exact_sum(c)).alias(c) for c in ("fnx", "fny", "fnz")])
    length = F.sqrt(F.col("fnx") * F.col("fnx") + F.col("fny") * F.col("fny") + F.col("fnz") * F.col("fnz")) + F.lit(1e-20)
    return s.select("scene_id", "vid", *[(F.col(c) / length).alias(o) for c, o in (("fnx", "nx"), ("fny", "ny"), ("fnz", "nz"))])


def directed_edges(polygons: DataFrame, names: list[str]) -> DataFrame:
    """Directed edges (a, b) of polygons whose corner ids are the columns ``names``."""
    k = len(names)
    e = F.array(*[F.struct(F.col(names[m]).alias("a"), F.col(names[(m + 1) % k]).alias("b")) for m in range(k)])
    return polygons.select("scene_id", F.explode(e).alias("e")).select("scene_id", "e.a", "e.b")


def border_edges(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """Directed edges that no polygon runs the other way: one grouping on the undirected edge."""
    both = edges.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b"))
    grouped = in_parts(both, parts, "scene_id", "lo", "hi").groupBy("scene_id", "lo", "hi").agg(
        F.sum(F.when(F.col("a") < F.col("b"), 1).otherwise(0)).alias("up"),
        F.sum(F.when(F.col("a") < F.col("b"), 0).otherwise(1)).alias("down"),
    )
    lone = grouped.where("(up = 0) <> (down = 0)")
    return lone.select("scene_id", F.when(F.col("up") > 0, F.col("lo")).otherwise(F.col("hi")).alias("a"),
                       F.when(F.col("up") > 0, F.col("hi")).otherwise(F.col("lo")).alias("b"))


def solid_quads(quads: DataFrame, parts: int | None = None) -> DataFrame:
    """Top, underside (ids negated) and wall quads of a closed solid over a quad mesh."""
    sw, se, ne, nw = quad_corner_ids()
    top = quads.select("scene_id", sw.alias("p"), se.alias("q"), ne.alias("r"), nw.alias("s"))
    under = lambda c: -F.col(c) - 1
    base = top.select("scene_id", under("s").alias("p"), under("r").alias("q"), under("q").alias("r"), under("p").alias("s"), F.lit("base").alias("part"))
    rim = border_edges(directed_edges(top, ["p", "q", "r", "s"]), parts)
    walls = rim.select("scene_id", F.col("a").alias("p"), under("a").alias("q"), under("b").alias("r"), F.col("b").alias("s"), F.lit("wall").alias("part"))
    return top.withColumn("part", F.lit("top")).unionByName(base).unionByName(walls)


def quads_to_triangles(quads: DataFrame) -> DataFrame:
    t = F.array(F.struct(F.col("p").alias("a"), F.col("q").alias("b"), F.col("r").alias("c")),
                F.struct(F.col("p").alias("a"), F.col("r").alias("b"), F.col("s").alias("c")))
    return quads.select("scene_id", F.explode(t).alias("t")).select("scene_id", "t.*")


def closed_check(triangles: DataFrame, parts: int | None = None) -> DataFrame:
    """Per scene: is every directed edge present exactly once, with its reverse."""
    e = directed_edges(triangles, ["a", "b", "c"]).withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b"))
    grouped = in_parts(e, parts, "scene_id", "lo", "hi").groupBy("scene_id", "lo", "hi").agg(
        F.sum(F.when(F.col("a") < F.col("b"), 1).otherwise(0)).alias("up"), F.sum(F.when(F.col("a") < F.col("b"), 0).otherwise(1)).alias("down"))
    return grouped.groupBy("scene_id").agg(F.every((F.col("up") == 1) & (F.col("down") == 1)).alias("closed"),
                                           F.count(F.lit(1)).alias("edges"))


def signed_volume() -> Column:
    """Aggregate over face corners: the volume enclosed."""
    a = tuple(F.col(ax + "a") for ax in ("x", "y", "z"))
    c = cross(tuple(F.col(ax + "b") for ax in ("x", "y", "z")), tuple(F.col(ax + "c") for ax in ("x", "y", "z")))
    return exact_sum(a[0] * c[0] + a[1] * c[1] + a[2] * c[2]) / 6


def sample_surface(faces: DataFrame, per_area: float, seed: int = 7) -> DataFrame:
    """Points spread over the faces in proportion to area; ``faces`` has corners and ``area``.

    Draws are hashes of (seed, face, sample), so they do not depend on partitioning; a face's share that
    is not a whole number is rounded up with that chance.
    """
    draw = lambda salt, *c: (F.pmod(F.xxhash64(F.lit(seed + salt), *c), F.lit(2**53)).cast("double") + 0.5) / float(2**53)
    want = F.col("area") * per_area
    n = (F.floor(want) + F.when(draw(0, "scene_id", "fid") < want - F.floor(want), 1).otherwise(0)).cast("int")
    s = faces.withColumn("_n", n).where("_n > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    s = s.withColumn("_s", F.sqrt(draw(1, "scene_id", "fid", "k"))).withColumn("_t", draw(2, "scene_id", "fid", "k"))
    at = lambda a: (1 - F.col("_s")) * F.col(a + "a") + F.col("_s") * (1 - F.col("_t")) * F.col(a + "b") + F.col("_s") * F.col("_t") * F.col(a + "c")
    return s.withColumns({a: at(a) for a in "xyz"}).drop("_n", "_s", "_t")


def ortho_samples(corners: DataFrame, px: float, parts: int | None = None) -> DataFrame:
    """The depth of the mesh straight down: the highest surface at each pixel centre, for ``surface_grid``. ``drawings.ortho`` draws it in colour, from all sides.

    Pixels are counted from each scene's north-west vertex. A face only meets the pixels of its own box.
    """
    e = corners.groupBy("scene_id").agg(F.least(*[F.min("x" + k) for k in "abc"]).alias("x0"), F.greatest(*[F.max("y" + k) for k in "abc"]).alias("y1"))
    c = in_parts(corners.join(e, "scene_id"), parts, "scene_id", "fid")
    for k in "abc":
        c = c.withColumn("u" + k, (F.col("x" + k) - F.col("x0")) / px).withColumn("v" + k, (F.col("y1") - F.col("y" + k)) / px)
    span = lambda p: F.sequence(F.ceil(F.least(*[p + k for k in "abc"]) - 0.5).cast("bigint"), F.floor(F.greatest(*[p + k for k in "abc"]) - 0.5).cast("bigint"))
    some = lambda p: F.ceil(F.least(*[p + k for k in "abc"]) - 0.5) <= F.floor(F.greatest(*[p + k for k in "abc"]) - 0.5)
    c = c.where(some("u") & some("v")).withColumn("iu", F.explode(span("u"))).withColumn("iv", F.explode(span("v")))
    d = lambda p, k: F.col(p + k) - F.col(p + "a")
    pu, pv = F.col("iu") + 0.5 - F.col("ua"), F.col("iv") + 0.5 - F.col("va")
    den = d("u", "b") * d("v", "c") - d("u", "c") * d("v", "b")
    c = c.where(den != 0).withColumn("l1", (pu * d("v", "c") - d("u", "c") * pv) / den).withColumn("l2", (d("u", "b") * pv - pu * d("v", "b")) / den)
    c = c.where((F.col("l1") >= -1e-9) & (F.col("l2") >= -1e-9) & (F.col("l1") + F.col("l2") <= 1 + 1e-9))
    z = F.col("za") + F.col("l1") * (F.col("zb") - F.col("za")) + F.col("l2") * (F.col("zc") - F.col("za"))
    return in_parts(c.select("scene_id", "iu", "iv", z.alias("_z")), parts, "scene_id", "iu", "iv").groupBy("scene_id", "iu", "iv").agg(F.max("_z").alias("depth"), F.count(F.lit(1)).alias("layers"))


def surface_grid(samples: DataFrame, sub: int, cover: float = 0.5, parts: int | None = None) -> DataFrame:
    """Mean of sub x sub samples per cell; a cell needs ``cover`` of them."""
    at = samples.select("scene_id", F.floor(F.col("iv") / sub).alias("i"), F.floor(F.col("iu") / sub).alias("j"), "depth")
    g = in_parts(at, parts, "scene_id", "i", "j").groupBy("scene_id", "i", "j").agg(
        (exact_sum("depth") / F.count(F.lit(1))).alias("z"), F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") >= cover * sub * sub)
