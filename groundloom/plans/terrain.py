"""Registered terrain queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundloom.functions.numeric import rounded
from groundloom.operators import raster, terrain
from groundloom.operators.order_stats import quantiles
from groundloom.plans.catalog import query
from groundloom.plans.tables import CELL, MIN_POINTS

R9 = lambda c: rounded(c, 9)


def r9(c: str) -> str:
    return f"floor(({c})*1e9+5e-1)/1e9"


def r6(c: str) -> str:
    return f"floor(({c})*1e6+5e-1)/1e6"


@query("rasterise", f"SELECT scene_id, i, j, {r9('z')} AS z, n FROM cells", "cells")
def rasterise(t):
    return t.cells.select("scene_id", "i", "j", R9("z").alias("z"), "n")


@query("rasterise_on", f"""SELECT scene_id, i, j, CASE WHEN n >= 2 THEN {r9('CAST(s AS DOUBLE)/1e6/n')} END AS z, n FROM (
 SELECT p.scene_id, CAST(floor((m.y1-(p.y+75e-2))/5e-1) AS BIGINT) AS i, CAST(floor(((p.x+125e-2)-m.x0)/5e-1) AS BIGINT) AS j, max(m.nx) AS nx, max(m.ny) AS ny,
 count(*) AS n, sum(CAST(floor(p.z*1e6+5e-1) AS BIGINT)) AS s FROM points p JOIN meta m ON p.scene_id=m.scene_id GROUP BY 1,2,3) q
 WHERE i>=0 AND j>=0 AND i<ny AND j<nx""", "points meta")
def rasterise_on(t):
    """A neighbouring cloud (shifted east and north) gridded on the scene's own grid."""
    moved = t.points.withColumn("x", F.expr("x + 125e-2")).withColumn("y", F.expr("y + 75e-2"))
    return raster.rasterise_on(moved, t.meta, CELL, MIN_POINTS).select("scene_id", "i", "j", R9("z").alias("z"), "n")


@query("cell_min_floor", """SELECT e.scene_id, iy, ix, coalesce(f.floor, e.lowest) AS floor, f.floor IS NULL AS unseen FROM (
 SELECT scene_id, unnest(generate_series(0, CAST(ceil((y1-y0)/15e-1) AS BIGINT)+1)) AS iy, nx, lowest FROM (
 SELECT e.*, CAST(ceil((x1-x0)/15e-1) AS BIGINT)+1 AS nx, l.lowest FROM extent e JOIN (SELECT scene_id, min(-z) AS lowest FROM points GROUP BY 1) l ON l.scene_id=e.scene_id) a) e
 CROSS JOIN LATERAL (SELECT unnest(generate_series(0, e.nx)) AS ix) x
 LEFT JOIN (SELECT p.scene_id, CAST(floor((y-y0)/15e-1) AS BIGINT) AS fy, CAST(floor((x-x0)/15e-1) AS BIGINT) AS fx, max(-z) AS floor
 FROM points p JOIN extent e ON e.scene_id=p.scene_id GROUP BY 1,2,3) f ON f.scene_id=e.scene_id AND f.fy=iy AND f.fx=x.ix""", "points extent")
def cell_min_floor(t):
    from groundloom.operators import cloth

    return cloth.cloth_floor(t.points, 1.5).select("scene_id", "iy", "ix", "floor", "unseen")


def _density_sql() -> str:
    """Six unrolled coarsening rounds."""
    parts = ["c0 AS (SELECT scene_id, 2e-1 AS cell, false AS settled, 0 AS rounds FROM extent)"]
    for k in range(6):
        parts.append(f"""q{k} AS (SELECT scene_id, quantile_cont(n, 25e-2) AS q FROM (SELECT p.scene_id, floor((p.x-e.x0)/c.cell) AS ix, floor((p.y-e.y0)/c.cell) AS iy,
 CAST(count(*) AS DOUBLE) AS n FROM points p JOIN extent e ON e.scene_id=p.scene_id JOIN c{k} c ON c.scene_id=p.scene_id GROUP BY 1,2,3) z GROUP BY 1)""")
        parts.append(f"""c{k + 1} AS (SELECT c.scene_id, CASE WHEN settled OR q>=4 THEN cell ELSE cell*least(2e0, sqrt(4e0/greatest(q, 5e-1))) END AS cell,
 settled OR q>=4 AS settled, CAST(rounds + CASE WHEN settled THEN 0 ELSE 1 END AS INT) AS rounds FROM c{k} c JOIN q{k} q ON q.scene_id=c.scene_id)""")
    return "WITH " + ", ".join(parts) + " SELECT scene_id, floor(cell*1e4+5e-1)/1e4 AS cell, settled, rounds FROM c6"


@query("density_cell", _density_sql(), "points extent")
def density_cell(t):
    return terrain.density_cell(t.points, F.lit(0.2), min_points=4)


@query("contour_interval", f"""WITH q AS (SELECT scene_id, quantile_cont(z, 2e-2) AS lo, quantile_cont(z, 98e-2) AS hi FROM points GROUP BY 1),
 nice AS (SELECT unnest([{', '.join(repr(s) for s in raster.NICE)}]::DOUBLE[]) AS step)
 SELECT scene_id, {r6('lo')} AS lo, {r6('hi')} AS hi, coalesce((SELECT min(step) FROM nice WHERE greatest(hi-lo, 1e-9)/step <= 40), 1e2) AS step FROM q""", "points")
def contour_interval(t):
    return terrain.contour_interval(t.points).select("scene_id", rounded("lo").alias("lo"), rounded("hi").alias("hi"), "step")


@query("dtm_limits", f"""SELECT scene_id, {r6('((x1-x0)/5e-2+1)*((y1-y0)/5e-2+1)')} AS cells, {r6('sqrt((x1-x0)*(y1-y0)/1e6)*105e-2')} AS finest,
 ((x1-x0)/5e-2+1)*((y1-y0)/5e-2+1) <= 1e6 AS cells_ok, ((x1-x0)/5e-2+1)*((y1-y0)/5e-2+1)*9e0 <= 5e6 AS shell_ok FROM extent""", "extent")
def dtm_limits(t):
    """Work guards for a 0.05 cell and a three-cell shell."""
    e = raster.extents(t.points)
    est = F.expr("((x1-x0)/5e-2+1)*((y1-y0)/5e-2+1)")
    return e.select("scene_id", rounded(est).alias("cells"), rounded(F.expr("sqrt((x1-x0)*(y1-y0)/1e6)*105e-2")).alias("finest"),
                    (est <= 1e6).alias("cells_ok"), (est * 9.0 <= 5e6).alias("shell_ok"))


@query("robust_bounds", """WITH u AS (SELECT scene_id, 'x' AS axis, x AS v, point_id FROM points UNION ALL SELECT scene_id, 'y', y, point_id FROM points UNION ALL SELECT scene_id, 'z', z, point_id FROM points),
 s AS (SELECT scene_id, axis, v, row_number() OVER (PARTITION BY scene_id, axis ORDER BY v, point_id)-1 AS k, count(*) OVER (PARTITION BY scene_id, axis) AS n FROM u)
 SELECT scene_id, axis, max(v) FILTER (k = floor(2e-2*(n-1))) AS p02, max(v) FILTER (k = floor(98e-2*(n-1))) AS p98, max(v) FILTER (k = floor(5e-2*(n-1))) AS p05,
 max(v) FILTER (k = floor(95e-2*(n-1))) AS p95 FROM s GROUP BY 1,2""", "points")
def robust_bounds(t):
    axes = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("v")) for a in "xyz"]))
    u = t.points.select("scene_id", axes.alias("u")).select("scene_id", "u.axis", "u.v")
    return quantiles(u, ["scene_id", "axis"], "v", {"p02": 0.02, "p98": 0.98, "p05": 0.05, "p95": 0.95}, "lower")


def _fill_sql() -> str:
    parts = ["f0 AS (SELECT scene_id, i, j, z, false AS filled FROM grid)"]
    for k in range(4):
        parts.append(f"""f{k + 1} AS (SELECT scene_id, i, j, z, filled FROM f{k} UNION ALL
 SELECT n.scene_id, n.i, n.j, n.z, true FROM (SELECT f.scene_id, f.i+o.di AS i, f.j+o.dj AS j, CAST(sum(CAST(floor(f.z*1e6+5e-1) AS BIGINT)) AS DOUBLE)/1e6/count(*) AS z
 FROM f{k} f CROSS JOIN (VALUES (-1,0),(1,0),(0,-1),(0,1)) o(di,dj) GROUP BY 1,2,3) n JOIN meta m ON m.scene_id=n.scene_id
 WHERE n.i>=0 AND n.j>=0 AND n.i<m.ny AND n.j<m.nx AND NOT EXISTS (SELECT 1 FROM f{k} h WHERE h.scene_id=n.scene_id AND h.i=n.i AND h.j=n.j))""")
    return "WITH " + ", ".join(parts) + f" SELECT scene_id, i, j, {r9('z')} AS z, filled FROM f4"


FILL_SQL = _fill_sql()


@query("fill_holes", FILL_SQL, "grid meta")
def fill_holes(t):
    return raster.fill_holes(t.grid, t.meta, 4, t.parts).select("scene_id", "i", "j", R9("z").alias("z"), "filled")


@query("despike", f"""WITH n AS (SELECT a.scene_id, a.i, a.j, any_value(a.z) AS own, max(b.z) AS hi, min(b.z) AS lo, quantile_cont(b.z, 5e-1) AS med, count(b.z) AS n
 FROM grid a LEFT JOIN grid b ON b.scene_id=a.scene_id AND abs(a.i-b.i)<=1 AND abs(a.j-b.j)<=1 AND NOT (a.i=b.i AND a.j=b.j) GROUP BY 1,2,3)
 SELECT scene_id, i, j, {r9('CASE WHEN n>=3 AND (own-hi>3e-1 OR lo-own>3e-1) THEN med ELSE own END')} AS z,
 CASE WHEN n>=3 AND own-hi>3e-1 THEN 'spike' WHEN n>=3 AND lo-own>3e-1 THEN 'pit' ELSE 'kept' END AS kind FROM n""", "grid")
def despike(t):
    """Spikes and pits against a limit of three tenths of a unit (three 0.1 cells)."""
    return raster.despike(t.grid, 0.1).select("scene_id", "i", "j", R9("z").alias("z"), "kind")


@query("ball_offset", f"""SELECT b.scene_id, a.i, a.j, {r9('min(b.z - o.d)')} AS z FROM grid b
 CROSS JOIN (VALUES {', '.join(f'({a},{b},{d!r}::DOUBLE)' for a, b, d in raster.ball_offsets(0.5, 1.5))}) o(di,dj,d)
 JOIN grid a ON a.scene_id=b.scene_id AND a.i=b.i+o.di AND a.j=b.j+o.dj GROUP BY 1,2,3""", "grid")
def ball_offset(t):
    return raster.ball_offset(t.grid, CELL, 1.5).select("scene_id", "i", "j", R9("z").alias("z"))


@query("shell_underside", f"""WITH q AS (SELECT a.scene_id, a.i, a.j, a.z AS nw, b.z AS ne, c.z AS sw, d.z AS se FROM grid a JOIN grid b ON a.scene_id=b.scene_id AND a.i=b.i AND b.j=a.j+1
 JOIN grid c ON a.scene_id=c.scene_id AND c.i=a.i+1 AND c.j=a.j JOIN grid d ON a.scene_id=d.scene_id AND d.i=a.i+1 AND d.j=a.j+1),
 s AS (SELECT scene_id, i, j, nw, ne, sw, se, a, b, 1e0-a/4e0 AS s, b/4e0 AS u FROM q CROSS JOIN (VALUES (0),(1),(2),(3),(4)) x(a) CROSS JOIN (VALUES (0),(1),(2),(3),(4)) y(b)),
 f AS (SELECT scene_id, i*4+a AS i, j*4+b AS j, arg_max(CASE WHEN u>=s THEN sw+u*(se-sw)+s*(ne-se) ELSE sw+s*(nw-sw)+u*(ne-nw) END, row(i,j)) AS z FROM s GROUP BY 1,2,3),
 o AS (SELECT f.scene_id, f.i+o.di AS i, f.j+o.dj AS j, min(f.z-o.d) AS z FROM f CROSS JOIN (VALUES {', '.join(f'({a},{b},{d!r}::DOUBLE)' for a, b, d in raster.ball_offsets(0.125, 0.5))}) o(di,dj,d) GROUP BY 1,2,3)
 SELECT o.scene_id, o.i//4 AS i, o.j//4 AS j, {r9('o.z')} AS z FROM o JOIN f ON f.scene_id=o.scene_id AND f.i=o.i AND f.j=o.j WHERE o.i%4=0 AND o.j%4=0""", "grid")
def shell_underside(t):
    """One-cell shell under the triangulated top."""
    return raster.shell_underside(t.grid, t.quads, CELL, 0.5).select("scene_id", "i", "j", R9("z").alias("z"))


@query("quad_mesh", "SELECT scene_id, i, j FROM quads", "quads")
def quad_mesh(t):
    return t.quads


def _contour_sql() -> str:
    cases = " ".join(f"WHEN {m} THEN ['{p}']" for m, p in terrain.CONTOUR_CASES.items())
    sad = " ".join(f"WHEN {m} THEN CASE WHEN centre > level THEN {list(terrain.SADDLE_HIGH[m])} ELSE {list(terrain.SADDLE_LOW[m])} END" for m in (5, 10))
    t = lambda p, q: f"(CASE WHEN {q}<>{p} THEN (level-{p})/({q}-{p}) ELSE 5e-1 END)"
    X, X1, Y, Y1 = "(x0+(j+5e-1)*5e-1)", "(x0+(j+1+5e-1)*5e-1)", "(y1-(i+5e-1)*5e-1)", "(y1-(i+1+5e-1)*5e-1)"

    def x(e):
        return f"CASE {e} WHEN 'T' THEN {X}+{t('nw', 'ne')}*({X1}-{X}) WHEN 'B' THEN {X}+{t('sw', 'se')}*({X1}-{X}) WHEN 'L' THEN {X} ELSE {X1} END"

    def y(e):
        return f"CASE {e} WHEN 'T' THEN {Y} WHEN 'B' THEN {Y1} WHEN 'L' THEN {Y}+{t('nw', 'sw')}*({Y1}-{Y}) ELSE {Y}+{t('ne', 'se')}*({Y1}-{Y}) END"

    def key(e):
        return f"CASE {e} WHEN 'T' THEN 'H:'||i||':'||j WHEN 'B' THEN 'H:'||(i+1)||':'||j WHEN 'L' THEN 'V:'||i||':'||j ELSE 'V:'||i||':'||(j+1) END"

    return f"""WITH q AS (SELECT a.scene_id, a.i, a.j, a.z AS nw, b.z AS ne, c.z AS sw, d.z AS se, m.x0, m.y1 FROM grid a JOIN grid b ON a.scene_id=b.scene_id AND a.i=b.i AND b.j=a.j+1
 JOIN grid c ON a.scene_id=c.scene_id AND c.i=a.i+1 AND c.j=a.j JOIN grid d ON a.scene_id=d.scene_id AND d.i=a.i+1 AND d.j=a.j+1 JOIN meta m ON m.scene_id=a.scene_id),
 zr AS (SELECT min(z) AS lo, max(z) AS hi FROM grid),
 lv AS (SELECT k, k*25e-2 AS level FROM (SELECT unnest(generate_series(CAST(ceil(lo/25e-2) AS BIGINT), CAST(ceil(hi/25e-2) AS BIGINT)-1)) AS k FROM zr) r),
 c AS (SELECT *, (nw+ne+se+sw)/4 AS centre, CASE WHEN nw>level THEN 1 ELSE 0 END + CASE WHEN ne>level THEN 2 ELSE 0 END + CASE WHEN se>level THEN 4 ELSE 0 END + CASE WHEN sw>level THEN 8 ELSE 0 END AS mask
 FROM q JOIN lv ON least(nw,ne,sw,se)<=level AND greatest(nw,ne,sw,se)>level),
 p AS (SELECT *, CASE mask {cases} {sad} ELSE [] END AS pairs FROM c),
 s AS (SELECT *, unnest(pairs) AS pair, generate_subscripts(pairs,1)-1 AS part FROM p),
 e AS (SELECT *, substr(pair,1,1) AS a, substr(pair,2,1) AS b FROM s)
 SELECT scene_id, k, level, i, j, CAST(part AS INT) AS part, {key('a')} AS e1, {key('b')} AS e2, {r9(x('a'))} AS ax, {r9(y('a'))} AS ay, {r9(x('b'))} AS bx, {r9(y('b'))} AS by FROM e"""


@query("contour_segments", _contour_sql(), "grid meta")
def contour_segments(t):
    s = terrain.contour_segments(t.grid, t.meta, CELL, 0.25)
    return s.select("scene_id", "k", "level", "i", "j", "part", "e1", "e2", *[R9(c).alias(c) for c in ("ax", "ay", "bx", "by")])


BILINEAR_SQL = """loc AS (SELECT p.*, (p.x-m.x0)/5e-1-5e-1 AS fx, (m.y1-p.y)/5e-1-5e-1 AS fy, m.nx, m.ny, m.x0, m.y1 FROM points p JOIN meta m ON m.scene_id=p.scene_id),
 ix AS (SELECT *, least(greatest(CAST(floor(fx) AS BIGINT),0),nx-2) AS gj, least(greatest(CAST(floor(fy) AS BIGINT),0),ny-2) AS gi FROM loc),
 tx AS (SELECT *, least(1e0,greatest(0e0,fx-gj)) AS tx, least(1e0,greatest(0e0,fy-gi)) AS ty FROM ix),
 bil AS (SELECT t.*, a.z*(1-tx)*(1-ty)+b.z*tx*(1-ty)+c.z*(1-tx)*ty+d.z*tx*ty AS ground FROM tx t
 LEFT JOIN grid a ON a.scene_id=t.scene_id AND a.i=gi AND a.j=gj LEFT JOIN grid b ON b.scene_id=t.scene_id AND b.i=gi AND b.j=gj+1
 LEFT JOIN grid c ON c.scene_id=t.scene_id AND c.i=gi+1 AND c.j=gj LEFT JOIN grid d ON d.scene_id=t.scene_id AND d.i=gi+1 AND d.j=gj+1)"""


@query("bilinear_sample", f"WITH {BILINEAR_SQL} SELECT scene_id, point_id, {r9('ground')} AS ground FROM bil", "points meta grid")
def bilinear_sample(t):
    return raster.bilinear(t.points, t.grid, t.meta, CELL).select("scene_id", "point_id", R9("ground").alias("ground"))


BLOCK_SQL = BILINEAR_SQL + """,
 blk AS (SELECT scene_id, CAST(floor((y1-y)/1e0) AS BIGINT) AS bi, CAST(floor((x-x0)/1e0) AS BIGINT) AS bj, count(*) FILTER (is_ground) AS n_ground,
 CAST(sum(CAST(floor((z-ground)*1e6+5e-1) AS BIGINT)) FILTER (is_ground) AS DOUBLE)/1e6 AS s1, CAST(sum(CAST(floor((z-ground)*(z-ground)*1e6+5e-1) AS BIGINT)) FILTER (is_ground) AS DOUBLE)/1e6 AS s2,
 count(*) AS n_points, count(*) FILTER (z-ground > 75e-2) AS n_up FROM bil WHERE ground IS NOT NULL GROUP BY 1,2,3),
 rough AS (SELECT scene_id, bi, bj, n_ground, n_points, sqrt(greatest(coalesce(s2,0e0)/greatest(n_ground,1)-(coalesce(s1,0e0)/greatest(n_ground,1))*(coalesce(s1,0e0)/greatest(n_ground,1)),0e0))/5e-1 AS spread,
 n_up/n_points AS share_up FROM blk),
 meshed AS (SELECT *, n_ground>=4 AND spread<=6e-1 AND share_up<=5e-1 AS mesh FROM rough)"""


def roughness(t):
    """Blocks of two cells, with limits that suit the fixture's density."""
    return terrain.block_roughness(t.points, t.grid, t.meta, CELL, block=2, rough=0.6, above=0.5, min_ground=4)


@query("block_roughness", f"WITH {BLOCK_SQL} SELECT scene_id, bi, bj, n_ground, n_points, {r6('spread')} AS spread, {r6('share_up')} AS share_up, mesh FROM meshed", "points meta grid")
def block_roughness(t):
    return roughness(t).select("scene_id", "bi", "bj", "n_ground", "n_points", rounded("spread").alias("spread"), rounded("share_up").alias("share_up"), "mesh")


@query("height_band_recall", f"""WITH {BILINEAR_SQL} SELECT CASE WHEN z-ground<0 THEN 'below' WHEN z-ground<3e-1 THEN '0-0.3' WHEN z-ground<1 THEN '0.3-1' WHEN z-ground<3 THEN '1-3' ELSE 'over 3' END AS band,
 count(*) AS points, {r9('CAST(count(*) FILTER (abs(z-ground)<=25e-2) AS DOUBLE)/count(*)')} AS recall FROM bil WHERE ground IS NOT NULL GROUP BY 1""", "points meta grid")
def height_band_recall(t):
    """Share of points called ground (within a quarter unit of the raster) by height above it."""
    b = raster.bilinear(t.points, t.grid, t.meta, CELL).where("ground IS NOT NULL").withColumn("h", F.expr("z - ground"))
    band = F.expr("CASE WHEN h<0 THEN 'below' WHEN h<3e-1 THEN '0-0.3' WHEN h<1 THEN '0.3-1' WHEN h<3 THEN '1-3' ELSE 'over 3' END")
    counts = b.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("points"), F.sum(F.expr("CASE WHEN abs(h) <= 25e-2 THEN 1 ELSE 0 END")).alias("hit"))
    return counts.select(
        "band", "points", R9(F.col("hit").cast("double") / F.col("points")).alias("recall"))


CLOSE_SQL = """m2 AS (SELECT scene_id, (nx+1)//2+1 AS nx, (ny+1)//2+1 AS ny FROM meta), ok AS (SELECT scene_id, bi AS i, bj AS j FROM meshed WHERE mesh),
 o AS (SELECT a.di, b.dj FROM (VALUES (-1),(0),(1)) a(di) CROSS JOIN (VALUES (-1),(0),(1)) b(dj)),
 grown AS (SELECT DISTINCT k.scene_id, k.i+di AS i, k.j+dj AS j, nx, ny FROM ok k JOIN m2 ON m2.scene_id=k.scene_id CROSS JOIN o WHERE k.i+di>=0 AND k.j+dj>=0 AND k.i+di<ny AND k.j+dj<nx),
 closed AS (SELECT g.scene_id, g.i, g.j FROM grown g WHERE NOT EXISTS (SELECT 1 FROM o WHERE g.i+di>=0 AND g.j+dj>=0 AND g.i+di<g.ny AND g.j+dj<g.nx
 AND NOT EXISTS (SELECT 1 FROM grown h WHERE h.scene_id=g.scene_id AND h.i=g.i+di AND h.j=g.j+dj)))"""


@query("morph_close", f"WITH {BLOCK_SQL}, {CLOSE_SQL} SELECT * FROM closed", "points meta grid")
def morph_close(t):
    blocks = roughness(t).where("mesh").select("scene_id", F.col("bi").alias("i"), F.col("bj").alias("j"))
    return raster.morph_close(blocks, block_meta(t))


def block_meta(t):
    """Frame of the two-cell blocks."""
    return t.meta.selectExpr("scene_id", "CAST(floor((nx+1)/2) AS BIGINT)+1 AS nx", "CAST(floor((ny+1)/2) AS BIGINT)+1 AS ny")


def _smooth_sql() -> str:
    k = raster.gaussian_kernel(1.0)
    half = len(k) // 2
    taps = ", ".join(f"({a - half},{w!r}::DOUBLE)" for a, w in enumerate(k))

    def one(src, axis, n, other):
        refl = f"CASE WHEN t.q+d<0 THEN -(t.q+d) WHEN t.q+d>t.{n}-1 THEN 2*(t.{n}-1)-(t.q+d) ELSE t.q+d END"
        return f"""SELECT t.scene_id, t.q AS {axis}, s.{other}, t.nx, t.ny, CAST(sum(CAST(floor(s.num*w*1e9+5e-1) AS BIGINT)) AS DOUBLE)/1e9 AS num,
 CAST(sum(CAST(floor(s.den*w*1e9+5e-1) AS BIGINT)) AS DOUBLE)/1e9 AS den FROM
 (SELECT scene_id, nx, ny, unnest(generate_series(0,{n}-1)) AS q FROM meta) t CROSS JOIN (VALUES {taps}) k(d,w) JOIN {src} s ON s.scene_id=t.scene_id AND s.{axis}={refl} GROUP BY 1,2,3,4,5"""

    return f"""WITH s0 AS (SELECT scene_id, i, j, z AS num, 1e0 AS den FROM grid), s1 AS ({one('s0', 'i', 'ny', 'j')}), s2 AS ({one('s1', 'j', 'nx', 'i')})
 SELECT g.scene_id, g.i, g.j, {r6('s.num/greatest(s.den,1e-12)')} AS z FROM grid g JOIN s2 s ON s.scene_id=g.scene_id AND s.i=g.i AND s.j=g.j"""


@query("hydro_smooth", _smooth_sql(), "grid meta")
def hydro_smooth(t):
    return raster.smooth(t.grid, t.meta, 1.0).select("scene_id", "i", "j", rounded("z").alias("z"))


@query("world_file", f"SELECT scene_id, 5e-1 AS px, 0e0 AS rot_y, 0e0 AS rot_x, -5e-1 AS py, {r9('x0+25e-2')} AS west, {r9('y1-25e-2')} AS north FROM meta", "meta")
def world_file(t):
    return t.meta.select("scene_id", F.lit(CELL).alias("px"), F.lit(0.0).alias("rot_y"), F.lit(0.0).alias("rot_x"), F.lit(-CELL).alias("py"),
                         R9(F.col("x0") + CELL / 2).alias("west"), R9(F.col("y1") - CELL / 2).alias("north"))


@query("raster_fingerprint", """SELECT scene_id, count(*) AS cells, CAST(min(CAST(floor(z*1e6+5e-1) AS BIGINT)) AS BIGINT) AS low, CAST(max(CAST(floor(z*1e6+5e-1) AS BIGINT)) AS BIGINT) AS high,
 CAST(sum((i*31+j*17+1)*(CAST(floor(z*1e6+5e-1) AS BIGINT)%65521+65521)%2147483647) AS BIGINT) AS mark FROM grid GROUP BY 1""", "grid")
def raster_fingerprint(t):
    """Order-free content mark of each raster: what the sink compares before refusing to overwrite."""
    from groundloom.sources.sinks import raster_fingerprint as mark

    return mark(t.grid)


@query("dem_report", f"""WITH filled AS (SELECT * FROM ({FILL_SQL}) q), c AS (SELECT scene_id, count(*) FILTER (z IS NULL) AS thin, count(*) FILTER (z IS NOT NULL) AS measured FROM cells GROUP BY 1),
 f AS (SELECT scene_id, count(*) FILTER (filled) AS filled, count(*) AS present, min(z) AS z_min, max(z) AS z_max FROM filled GROUP BY 1),
 p AS (SELECT scene_id, count(*) AS points, count(*) FILTER (is_ground) AS ground FROM points GROUP BY 1)
 SELECT p.scene_id, p.points, p.ground AS ground_points, floor(1e3*ground/p.points+5e-1)/1e1 AS ground_share, m.nx, m.ny, c.measured, c.thin, f.filled, m.nx*m.ny-f.present AS empty,
 floor(z_min*1e4+5e-1)/1e4 AS z_min, floor(z_max*1e4+5e-1)/1e4 AS z_max,
 concat_ws('; ', CASE WHEN ground*20<p.points THEN 'almost nothing is ground' END, CASE WHEN (m.nx*m.ny-f.present)*2>m.nx*m.ny THEN 'mostly empty' END, CASE WHEN c.thin*4>c.measured THEN 'many thin cells' END, 'not calibrated') AS caveats
 FROM p JOIN meta m ON m.scene_id=p.scene_id JOIN c ON c.scene_id=p.scene_id JOIN f ON f.scene_id=p.scene_id""", "points cells grid meta")
def dem_report(t):
    one = F.lit(1)
    filled = raster.fill_holes(t.grid, t.meta, 4, t.parts)
    c = t.cells.groupBy("scene_id").agg(F.count("z").alias("measured"), (F.count(one) - F.count("z")).alias("thin"))
    f = filled.groupBy("scene_id").agg(F.sum(F.col("filled").cast("bigint")).alias("filled"), F.count(one).alias("present"), F.min("z").alias("z_min"), F.max("z").alias("z_max"))
    p = t.points.groupBy("scene_id").agg(F.count(one).alias("points"), F.sum(F.col("is_ground").cast("bigint")).alias("ground_points"))
    r = p.join(t.meta, "scene_id").join(c, "scene_id").join(f, "scene_id").withColumn("empty", F.expr("nx*ny - present"))
    caveats = F.concat_ws("; ", F.expr("CASE WHEN ground_points*20 < points THEN 'almost nothing is ground' END"),
                          F.expr("CASE WHEN empty*2 > nx*ny THEN 'mostly empty' END"), F.expr("CASE WHEN thin*4 > measured THEN 'many thin cells' END"), F.lit("not calibrated"))
    return r.select("scene_id", "points", "ground_points", F.expr("floor(1e3*ground_points/points+5e-1)/1e1").alias("ground_share"), "nx", "ny", "measured", "thin", "filled",
                    "empty", rounded("z_min", 4).alias("z_min"), rounded("z_max", 4).alias("z_max"), caveats.alias("caveats"))


@query("point_in_footprint", f"SELECT c.scene_id, c.i, c.j, {r9('c.z')} AS z FROM cells c JOIN quads q ON q.scene_id=c.scene_id AND q.i=c.i AND q.j=c.j WHERE c.z IS NOT NULL", "cells quads")
def point_in_footprint(t):
    """Ground cells kept only where the surface's footprint exists."""
    return t.grid.join(t.quads, ["scene_id", "i", "j"], "left_semi").select("scene_id", "i", "j", R9("z").alias("z"))


@query("occupied_cells", "SELECT scene_id, count(*) AS occupied, count(z) AS measured FROM cells GROUP BY 1", "cells")
def occupied_cells(t):
    return t.cells.groupBy("scene_id").agg(F.count(F.lit(1)).alias("occupied"), F.count("z").alias("measured"))
