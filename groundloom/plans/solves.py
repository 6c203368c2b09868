"""Registered queries: contour lines, outlines, drawings, and estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundloom.functions.constants import CELL_STRIDE
from groundloom.functions.numeric import rounded
from groundloom.operators import chains, drawings as draw, estimate, mesh, planes, raster, repair, simplify, terrain, walk
from groundloom.plans.cameras import out
from groundloom.plans.catalog import query
from groundloom.plans.tables import CELL
from groundloom.plans.terrain import r6, r9, _contour_sql
from groundloom.session import cut_lineage, in_parts

R6 = rounded


@query("contour_lines", f"""WITH RECURSIVE seg AS (SELECT * FROM ({_contour_sql()}) q), nodes AS (SELECT scene_id, k, e1 AS node FROM seg UNION SELECT scene_id, k, e2 FROM seg),
 heads AS (SELECT n.scene_id, n.k, n.node FROM nodes n LEFT JOIN seg s ON s.scene_id=n.scene_id AND s.k=n.k AND s.e2=n.node WHERE s.e2 IS NULL),
 w AS (SELECT scene_id, k, node AS head, node, 0 AS pos FROM heads UNION ALL SELECT w.scene_id, w.k, w.head, s.e2, w.pos+1 FROM w JOIN seg s ON s.scene_id=w.scene_id AND s.k=w.k AND s.e1=w.node)
 SELECT n.scene_id, n.k, n.node, w.node IS NULL AS closed, CASE WHEN w.node IS NOT NULL THEN CAST(w.pos AS DOUBLE) END AS pos, n.k % 5 = 0 AS major FROM nodes n LEFT JOIN w ON w.scene_id=n.scene_id AND w.k=n.k AND w.node=n.node""", "grid meta")
def contour_lines(t):
    """Every contour vertex with its place in its line (places in rings are left to the tests)."""
    s = terrain.contour_segments(t.grid, t.meta, CELL, 0.25)
    c = chains.contour_lines(cut_lineage(s))
    return c.select("scene_id", "k", "node", "closed", F.when(~F.col("closed"), F.col("pos").cast("double")).alias("pos"), "major")


def thinned_rim(t):
    """Border edges of the quad footprint without corner pinches."""
    q = repair.unpinch(t.quads, t.parts)
    sw, se, ne, nw = mesh.quad_corner_ids()
    top = q.select("scene_id", sw.alias("p"), se.alias("q"), ne.alias("r"), nw.alias("s"))
    return cut_lineage(mesh.border_edges(mesh.directed_edges(top, ["p", "q", "r", "s"]), t.parts))


@query("outline")
def outline(t):
    """Outer rings and holes of the thinned quad footprint, with their areas in cells."""
    return chains.outlines(thinned_rim(t), CELL_STRIDE)


@query("ring_simplify", f"""WITH RECURSIVE v AS MATERIALIZED (SELECT scene_id, row_number() OVER (PARTITION BY scene_id ORDER BY frame)-1 AS pos, px AS x, py+value/1e3 AS y FROM walk),
 e AS MATERIALIZED (SELECT scene_id, max(pos) AS n, any_value(x) FILTER (pos=0) AS x0, any_value(y) FILTER (pos=0) AS y0 FROM v GROUP BY 1),
 f AS MATERIALIZED (SELECT v.scene_id, arg_max(pos, row(sqrt((x-x0)*(x-x0)+(y-y0)*(y-y0)), -pos)) AS m FROM v JOIN e ON e.scene_id=v.scene_id GROUP BY 1),
 w AS MATERIALIZED (SELECT * FROM v UNION ALL SELECT scene_id, n+1, x0, y0 FROM e),
 s AS (SELECT scene_id, CAST(0 AS BIGINT) AS a, m AS b FROM f UNION ALL SELECT f.scene_id, m, n+1 FROM f JOIN e ON e.scene_id=f.scene_id UNION ALL
  SELECT scene_id, unnest([a,m]), unnest([m,b]) FROM (SELECT s.scene_id, s.a, s.b, arg_max(v.pos, row(d, -v.pos)) AS m, max(d) AS d FROM (SELECT s.scene_id, s.a, s.b, v.pos,
   CASE WHEN (q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y) > 0 THEN abs((q.x-p.x)*(v.y-p.y)-(q.y-p.y)*(v.x-p.x))/sqrt((q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y)) ELSE sqrt((v.x-p.x)*(v.x-p.x)+(v.y-p.y)*(v.y-p.y)) END AS d
   FROM s JOIN w p ON p.scene_id=s.scene_id AND p.pos=s.a JOIN w q ON q.scene_id=s.scene_id AND q.pos=s.b JOIN v ON v.scene_id=s.scene_id AND v.pos>s.a AND v.pos<s.b) v JOIN s ON s.scene_id=v.scene_id AND s.a=v.a AND s.b=v.b GROUP BY 1,2,3) r WHERE d > 2e-1)
 SELECT DISTINCT v.scene_id, v.pos, {r6('v.x')} AS x, {r6('v.y')} AS y FROM s JOIN v ON v.scene_id=s.scene_id AND v.pos=s.a""", "walk")
def ring_simplify(t):
    """Each scene's walk, moved by its values and closed to a ring, within 0.2 units."""
    v = walk.dense_index(t.walk).select("scene_id", (F.col("k") - 1).alias("pos"), F.col("px").alias("x"), F.expr("py + value / 1e3").alias("y"), F.lit(True).alias("closed"))
    s = simplify.simplify(v, ["scene_id"], 0.2, 64)
    return s.select("scene_id", "pos", R6("x").alias("x"), R6("y").alias("y"))


@query("outline_rings")
def outline_rings(t):
    """Corners of the outlines and holes that stay within one cell, in order."""
    rings = chains.outline_vertices(thinned_rim(t), CELL_STRIDE)
    s = simplify.simplify(rings.withColumn("closed", F.lit(True)), ["scene_id", "line", "kind"], 1.0)
    return s.select("scene_id", "line", "kind", "pos", "x", "y")


ORTHO = """e AS (SELECT scene_id, min(least(xa,xb,xc)) AS x0, max(greatest(ya,yb,yc)) AS y1 FROM corners GROUP BY 1),
 c AS (SELECT q.*, (xa-x0)/125e-3 AS ua, (xb-x0)/125e-3 AS ub, (xc-x0)/125e-3 AS uc, (y1-ya)/125e-3 AS va, (y1-yb)/125e-3 AS vb, (y1-yc)/125e-3 AS vc FROM corners q JOIN e ON e.scene_id=q.scene_id),
 b AS (SELECT *, unnest(generate_series(CAST(ceil(least(ua,ub,uc)-5e-1) AS BIGINT), CAST(floor(greatest(ua,ub,uc)-5e-1) AS BIGINT))) AS iu FROM c),
 d AS (SELECT *, unnest(generate_series(CAST(ceil(least(va,vb,vc)-5e-1) AS BIGINT), CAST(floor(greatest(va,vb,vc)-5e-1) AS BIGINT))) AS iv FROM b),
 l AS (SELECT *, ((iu+5e-1-ua)*(vc-va)-(uc-ua)*(iv+5e-1-va))/den AS l1, ((ub-ua)*(iv+5e-1-va)-(iu+5e-1-ua)*(vb-va))/den AS l2 FROM (SELECT *, (ub-ua)*(vc-va)-(uc-ua)*(vb-va) AS den FROM d) z WHERE den<>0),
 s AS (SELECT scene_id, iu, iv, max(za+l1*(zb-za)+l2*(zc-za)) AS depth, count(*) AS layers FROM l WHERE l1>=-1e-9 AND l2>=-1e-9 AND l1+l2<=1+1e-9 GROUP BY 1,2,3)"""


@query("surface_grid", f"WITH {ORTHO} SELECT scene_id, CAST(floor(iv/4) AS BIGINT) AS i, CAST(floor(iu/4) AS BIGINT) AS j, {r6('CAST(sum(CAST(floor(floor(depth*1e4+5e-1)/1e4*1e6+5e-1) AS BIGINT)) AS DOUBLE)/1e6/count(*)')} AS z, count(*) AS n FROM s GROUP BY 1,2,3 HAVING count(*)>=8", "corners")
def surface_grid(t):
    s = mesh.ortho_samples(mesh.face_corners(t.faces, t.vertices, t.parts), 0.125, t.parts).withColumn("depth", rounded("depth", 4))
    return mesh.surface_grid(s, 4, parts=t.parts).select("scene_id", "i", "j", R6("z").alias("z"), "n")


def second_solve(t):
    """The same walk in another solve's frame: scaled 3.7, turned, shifted; every eleventh frame is missing."""
    return t.walk.where("frame % 11 <> 0").selectExpr("scene_id", "frame", "name", "37e-1*(8e-1*px-6e-1*py)+5e0 AS px", "37e-1*(6e-1*px+8e-1*py)-2e0 AS py", "37e-1*pz+1e0 AS pz")


@query("shared_cameras", "SELECT scene_id, count(*) FILTER (frame % 11 <> 0) AS shared, CASE WHEN count(*) FILTER (frame % 11 <> 0) < 4 THEN 'too few' ELSE 'ok' END AS status FROM walk GROUP BY 1", "walk")
def shared_cameras(t):
    s = t.walk.select("scene_id", "name").join(second_solve(t).select("scene_id", "name"), ["scene_id", "name"])
    return s.groupBy("scene_id").agg(F.count(F.lit(1)).alias("shared")).withColumn("status", F.when(F.col("shared") < 4, "too few").otherwise("ok"))


@query("pose_drift", f"""SELECT scene_id, count(*) FILTER (frame % 11 <> 0) AS matched, {r6('1e2*count(*) FILTER (frame % 11 <> 0)/count(*)')} AS match_pct, 37e-1 AS scale, 3687e-2 AS rotation_deg, 0e0 AS rms, 0e0 AS worst,
 CASE WHEN 1e2*count(*) FILTER (frame % 11 <> 0)/count(*) >= 90 THEN 'pass' ELSE 'fail' END AS verdict FROM walk GROUP BY 1""", "walk")
def pose_drift(t):
    reference = t.walk.selectExpr("scene_id", "name", "37e-1*(8e-1*px-6e-1*py)+5e0 AS px", "37e-1*(6e-1*px+8e-1*py)-2e0 AS py", "37e-1*pz+1e0 AS pz")
    d = estimate.pose_drift(t.walk.where("frame % 11 <> 0"), reference)
    return d.select("scene_id", "matched", R6("match_pct").alias("match_pct"), rounded("scale", 3).alias("scale"), rounded("rotation_deg", 2).alias("rotation_deg"), rounded("rms", 2).alias("rms"), rounded("worst", 2).alias("worst"), "verdict")


def _plane_sql(refits: int, trials: int, again: bool) -> str:
    """Every hypothesis against every point, then least-squares fits to the points near the best one; ``again`` as in ``planes.hypotheses``."""
    corners = lambda s: ", ".join(f"max(CASE WHEN {s}%3={j} THEN {a} END) AS {a}{j}" for a in "xyz" for j in range(3))
    ranked = "SELECT p.*, row_number() OVER (PARTITION BY p.scene_id ORDER BY point_id)-1 AS ord FROM points p JOIN e ON e.scene_id=p.scene_id"
    if again:
        drawn = f"""r AS (SELECT * FROM ({ranked}) q WHERE ord < {3 * trials}), a AS (SELECT scene_id, n, CAST(unnest(generate_series(0, {3 * trials - 1})) AS BIGINT) AS s FROM e),
 t AS (SELECT a.scene_id, s//3 AS k, {corners('s')} FROM a JOIN r ON r.scene_id=a.scene_id AND r.ord = CASE WHEN n < {3 * trials} THEN {planes.drawn('s', 'n')} ELSE s END GROUP BY 1,2)"""
    else:
        drawn = f"t AS (SELECT scene_id, ord//3 AS k, {corners('ord')} FROM ({ranked}) q WHERE ord < {3 * trials} GROUP BY 1,2 HAVING count(*)=3)"
    steps = []
    for k in range(1, refits + 1):
        near = f"""near{k} AS (SELECT scene_id, (px-ox)/ext*1e3 AS x, (py-oy)/ext*1e3 AS y, (pz-oz)/ext*1e3 AS z FROM (SELECT p.scene_id, p.x AS px, p.y AS py, p.z AS pz, e.ox, e.oy, e.oz, e.ext FROM points p JOIN e ON e.scene_id=p.scene_id JOIN fit{k - 1} f ON f.scene_id=p.scene_id WHERE abs(p.x*nx+p.y*ny+p.z*nz-d) < tol) q)"""
        micro = lambda c: f"CAST(sum(CAST(floor({c}*1e6+5e-1) AS BIGINT)) AS DOUBLE)/1e6"
        sums = f"g{k}_0 AS (SELECT e.*, m, " + ", ".join(f"s{c}" for c in ("x", "y", "z", "xx", "xy", "xz", "yy", "yz", "zz")) + f" FROM e JOIN (SELECT scene_id, CAST(count(*) AS DOUBLE) AS m, " + ", ".join(
            f"{micro('*'.join(c))} AS s{c}" for c in ("x", "y", "z", "xx", "xy", "xz", "yy", "yz", "zz")) + f" FROM near{k} GROUP BY 1) s ON s.scene_id=e.scene_id WHERE m >= 10)"
        chain = [f"g{k}_{i + 1} AS (SELECT *, {', '.join(f'{x} AS {c}' for c, x in step.items())} FROM g{k}_{i})" for i, step in enumerate(planes.STEPS)]
        last = f"g{k}_{len(planes.STEPS)}"
        fit = f"fit{k} AS (SELECT f.scene_id, coalesce(u.ux,f.nx) AS nx, coalesce(u.uy,f.ny) AS ny, coalesce(u.uz,f.nz) AS nz, coalesce(u.ud,f.d) AS d FROM fit{k - 1} f LEFT JOIN (SELECT scene_id, ux, uy, uz, {planes.OFFSET} AS ud FROM {last} WHERE p > 0) u ON u.scene_id=f.scene_id)"
        steps += [near, sums, *chain, fit]
    return f"""WITH e AS (SELECT *, 2e-2*ext AS tol FROM (SELECT scene_id, count(*) AS n, min(x) AS ox, min(y) AS oy, min(z) AS oz, greatest(max(x)-min(x),max(y)-min(y),max(z)-min(z)) AS ext FROM points GROUP BY 1 HAVING count(*) >= 50) q),
 {drawn},
 c AS (SELECT scene_id, k, x0, y0, z0, {', '.join(f'({b}1-{b}0)*({c}2-{c}0)-({c}1-{c}0)*({b}2-{b}0) AS c{a}' for a, b, c in ('xyz', 'yzx', 'zxy'))} FROM t),
 u AS (SELECT scene_id, k, x0, y0, z0, cx/l AS nx, cy/l AS ny, cz/l AS nz FROM (SELECT *, sqrt(cx*cx+cy*cy+cz*cz) AS l FROM c) q WHERE l > 1e-12),
 h AS (SELECT scene_id, k, nx, ny, nz, nx*x0+ny*y0+nz*z0 AS d FROM u),
 v AS (SELECT h.scene_id, h.k, count(*) AS votes FROM h JOIN e ON e.scene_id=h.scene_id JOIN points p ON p.scene_id=h.scene_id WHERE abs(x*nx+y*ny+z*nz-d) < tol GROUP BY 1,2),
 b AS (SELECT scene_id, arg_max(k, row(votes,-k)) AS k, max(votes) AS votes FROM v GROUP BY 1),
 fit0 AS (SELECT h.scene_id, nx, ny, nz, d FROM h JOIN b ON b.scene_id=h.scene_id AND b.k=h.k){''.join(', ' + x for x in steps)}"""


def located(t):
    """Points by place only, made once: their ids are hashes of text and every round reads them again."""
    return cut_lineage(t.points.select("scene_id", "point_id", "x", "y", "z"))


@query("plane_votes", f"{_plane_sql(0, 256, False)} SELECT b.scene_id, b.k, b.votes, {r6('nx')} AS nx, {r6('ny')} AS ny, {r6('nz')} AS nz, {r6('d')} AS d FROM b JOIN fit0 f ON f.scene_id=b.scene_id", "points")
def plane_votes(t):
    """The best of 256 planes through drawn points, judged by all points (ids are hashes, so their order is the draw)."""
    points = located(t)
    size = cut_lineage(planes.extents(points, 0.02))
    use = points.join(size.select("scene_id"), "scene_id", "left_semi")
    best = planes.votes(use, planes.hypotheses(use, 256, F.col("point_id"), again=False), size)
    return best.select("scene_id", "k", "votes", *[R6(c).alias(c) for c in ("nx", "ny", "nz", "d")])


R4 = lambda c: rounded(c, 4)
r4 = lambda e: f"floor(({e})*1e4+5e-1)/1e4"


@query("dominant_plane", f"{_plane_sql(2, planes.TRIALS, True)}, s AS (SELECT p.scene_id, CAST(count(*) FILTER (WHERE abs(x*nx+y*ny+z*nz-d) < tol) AS DOUBLE)/any_value(e.n) AS share FROM points p JOIN e ON e.scene_id=p.scene_id JOIN fit2 f ON f.scene_id=p.scene_id GROUP BY 1)"
       f" SELECT f.scene_id, {r4('nx')} AS nx, {r4('ny')} AS ny, {r4('nz')} AS nz, {r4('d')} AS d, {r4('share')} AS share FROM fit2 f JOIN s ON s.scene_id=f.scene_id", "points")
def dominant_plane(t):
    p = planes.dominant_plane(located(t), draw=F.col("point_id"))
    return p.select("scene_id", *[R4(c).alias(c) for c in ("nx", "ny", "nz", "d", "share")])


def up_of(t):
    cams = t.cameras.selectExpr("*", "-dx AS ux", "-dy AS uy", "-dz AS uz")
    return estimate.estimate_up(cams, cut_lineage(planes.dominant_plane(located(t))))


@query("estimate_up")
def estimate_up(t):
    u = up_of(t)
    return u.select("scene_id", *[R6(c).alias(c) for c in ("upx", "upy", "upz", "spread", "share", "look_down")], "method")


@query("site_frame")
def site_frame(t):
    line = cut_lineage(t.walk)
    held = walk.held_height(t.points, line).select("scene_id", "held")
    f = estimate.site_frame(cut_lineage(up_of(t)), t.cameras, held)
    return f.select("scene_id", *[R6(f"m{r}{c}").alias(f"m{r}{c}") for r in range(3) for c in range(4)], "first_camera", R6("first_camera_height").alias("first_camera_height"), "units")


@query("camera_moves")
def camera_moves(t):
    """Largest orbit, pass-by, rise, push-in and dolly of each scene that stay on scanned ground."""
    p = t.points_wide.select("scene_id", "point_id", "x", "y", "z", (F.pmod("point_id", F.lit(4)) != 0).alias("seen"))
    mid = t.walk.groupBy("scene_id").agg(F.avg("px").alias("wx"), F.avg("py").alias("wy"))
    s = t.points.groupBy("scene_id").agg(F.avg("x").alias("ox"), F.avg("y").alias("oy"), F.avg("z").alias("oz")).join(mid, "scene_id")
    s = s.withColumn("dist", F.greatest(F.sqrt((F.col("wx") - F.col("ox")) * (F.col("wx") - F.col("ox")) + (F.col("wy") - F.col("oy")) * (F.col("wy") - F.col("oy"))), F.lit(4.0)))
    s = s.select("scene_id", "ox", "oy", "oz", F.lit(0.0).alias("ex"), F.lit(-1.0).alias("ey"), "dist", F.lit(1.6).alias("eye"))
    m = estimate.camera_moves(p, t.cameras.drop("name"), s)
    return m.select("scene_id", "move", "size", R6("least").alias("least"), R6("yard").alias("yardstick"))


def _drawing_sql(px: str) -> str:
    """All five views of the coloured mesh: every face meets the pixels of its box."""
    at = lambda axis, k: ("-" if axis[0] == "-" else "") + axis[-1] + k
    views = " UNION ALL ".join(
        f"SELECT scene_id, fid, '{name}' AS view, " + ", ".join(f"{at(axis, k)} AS {p}{k}" for p, axis in zip("uvd", axes) for k in "abc") + ", " + ", ".join(f"{c}{k}" for c in "rgb" for k in "abc") + " FROM k"
        for name, axes in draw.VIEWS.items()
    )
    box = lambda p: f"unnest(generate_series(CAST(ceil(least({p}a,{p}b,{p}c)-5e-1) AS BIGINT), CAST(floor(greatest({p}a,{p}b,{p}c)-5e-1) AS BIGINT))) AS i{p}"
    mix = lambda c: f"{c}a+l1*({c}b-{c}a)+l2*({c}c-{c}a)"
    shades = ", ".join(f"CAST(floor({mix(c)}+5e-1) AS INT) AS {c}" for c in "rgb")
    return f"""WITH k AS (SELECT *, {', '.join(f'CAST({v} % {m} AS DOUBLE) AS {c}{v}' for c, m in zip('rgb', (251, 241, 239)) for v in 'abc')} FROM corners),
 w AS ({views}), e AS (SELECT scene_id, view, min(least(ua,ub,uc)) AS u0, max(greatest(va,vb,vc)) AS v1 FROM w GROUP BY 1,2),
 c AS (SELECT w.* REPLACE ((ua-u0)/{px} AS ua, (ub-u0)/{px} AS ub, (uc-u0)/{px} AS uc, (v1-va)/{px} AS va, (v1-vb)/{px} AS vb, (v1-vc)/{px} AS vc) FROM w JOIN e ON e.scene_id=w.scene_id AND e.view=w.view),
 b AS (SELECT *, {box('u')} FROM c), d AS (SELECT *, {box('v')} FROM b),
 l AS (SELECT *, ((iu+5e-1-ua)*(vc-va)-(uc-ua)*(iv+5e-1-va))/den AS l1, ((ub-ua)*(iv+5e-1-va)-(iu+5e-1-ua)*(vb-va))/den AS l2 FROM (SELECT *, (ub-ua)*(vc-va)-(uc-ua)*(vb-va) AS den FROM d) z WHERE den<>0),
 s AS (SELECT scene_id, view, iu, iv, fid, {mix('d')} AS depth, {shades} FROM l WHERE l1>=-1e-9 AND l2>=-1e-9 AND l1+l2<=1+1e-9)
 SELECT scene_id, view, iu, iv, {r6('max(depth)')} AS depth, arg_max(r, row(depth,-fid)) AS r, arg_max(g, row(depth,-fid)) AS g, arg_max(b, row(depth,-fid)) AS b, count(*) AS layers FROM s GROUP BY 1,2,3,4"""


def _ortho_sql(px: str) -> str:
    """All five views of the textured mesh: the nearest face at each pixel, its texture coordinates there, and the four texels around them."""
    at = lambda axis, k: ("-" if axis[0] == "-" else "") + axis[-1] + k
    views = " UNION ALL ".join(
        f"SELECT scene_id, fid, '{name}' AS view, " + ", ".join(f"{at(axis, k)} AS {p}{k}" for p, axis in zip("uvd", axes) for k in "abc") + ", " + ", ".join(f"{c}{k}" for c in "st" for k in "abc") + " FROM k"
        for name, axes in draw.VIEWS.items()
    )
    box = lambda p: f"unnest(generate_series(CAST(ceil(least({p}a,{p}b,{p}c)-5e-1) AS BIGINT), CAST(floor(greatest({p}a,{p}b,{p}c)-5e-1) AS BIGINT))) AS i{p}"
    mix = lambda c: f"{c}a+l1*({c}b-{c}a)+l2*({c}c-{c}a)"
    colour = lambda c: f"CAST(floor(coalesce(t1.{c},128e0)*(1-fx)*(1-fy)+coalesce(t2.{c},128e0)*fx*(1-fy)+coalesce(t3.{c},128e0)*(1-fx)*fy+coalesce(t4.{c},128e0)*fx*fy+5e-1) AS INT) AS {c}"
    around = " ".join(f"LEFT JOIN tex t{1 + 2 * a + b} ON t{1 + 2 * a + b}.scene_id=h.scene_id AND t{1 + 2 * a + b}.i=r0+{a} AND t{1 + 2 * a + b}.j=c0+{b}" for a in (0, 1) for b in (0, 1))
    return f"""WITH k AS (SELECT *, {', '.join(f'CAST({v} % 1048576 AS DOUBLE) AS s{v}, CAST({v} // 1048576 AS DOUBLE) AS t{v}' for v in 'abc')} FROM corners),
 tex AS (SELECT scene_id, i, j, {', '.join(f'CAST(sum({c}) AS DOUBLE)/count(*) AS {c}' for c in 'rgb')} FROM (SELECT p.scene_id, CAST(floor((m.y1-p.y)/5e-1) AS BIGINT) AS i, CAST(floor((p.x-m.x0)/5e-1) AS BIGINT) AS j, r, g, b FROM points p JOIN meta m ON m.scene_id=p.scene_id) q GROUP BY 1,2,3),
 ends AS (SELECT scene_id, CAST(max(i) AS DOUBLE) AS lasti, CAST(max(j) AS DOUBLE) AS lastj FROM tex GROUP BY 1),
 w AS ({views}), e AS (SELECT scene_id, view, min(least(ua,ub,uc)) AS u0, max(greatest(va,vb,vc)) AS v1 FROM w GROUP BY 1,2),
 c AS (SELECT w.* REPLACE ((ua-u0)/{px} AS ua, (ub-u0)/{px} AS ub, (uc-u0)/{px} AS uc, (v1-va)/{px} AS va, (v1-vb)/{px} AS vb, (v1-vc)/{px} AS vc) FROM w JOIN e ON e.scene_id=w.scene_id AND e.view=w.view),
 bu AS (SELECT *, {box('u')} FROM c), bv AS (SELECT *, {box('v')} FROM bu),
 l AS (SELECT *, ((iu+5e-1-ua)*(vc-va)-(uc-ua)*(iv+5e-1-va))/den AS l1, ((ub-ua)*(iv+5e-1-va)-(iu+5e-1-ua)*(vb-va))/den AS l2 FROM (SELECT *, (ub-ua)*(vc-va)-(uc-ua)*(vb-va) AS den FROM bv) z WHERE den<>0),
 n AS (SELECT scene_id, view, iu, iv, fid, {mix('d')} AS depth, {mix('s')} AS s, {mix('t')} AS t FROM l WHERE l1>=-1e-9 AND l2>=-1e-9 AND l1+l2<=1+1e-9),
 top AS (SELECT scene_id, view, iu, iv, max(depth) AS depth, arg_max(s, row(depth,-fid)) AS s, arg_max(t, row(depth,-fid)) AS t FROM n GROUP BY 1,2,3,4),
 g AS (SELECT top.* REPLACE (least(greatest(s,0e0),lastj) AS s, least(greatest(t,0e0),lasti) AS t) FROM top JOIN ends ON ends.scene_id=top.scene_id),
 h AS (SELECT *, CAST(floor(s) AS BIGINT) AS c0, CAST(floor(t) AS BIGINT) AS r0, s-floor(s) AS fx, t-floor(t) AS fy FROM g)
 SELECT h.scene_id, view, iu, iv, {r6('depth')} AS depth, {', '.join(colour(c) for c in 'rgb')} FROM h {around}"""


def cell_texture(t):
    """A texel for each cell with points: their mean colour."""
    at = t.points.join(t.meta, "scene_id")
    at = at.select("scene_id", F.floor((F.col("y1") - F.col("y")) / CELL).alias("row"), F.floor((F.col("x") - F.col("x0")) / CELL).alias("col"), "r", "g", "b")
    return in_parts(at, t.parts, "scene_id", "row", "col").groupBy("scene_id", "row", "col").agg(*[(F.sum(c).cast("double") / F.count(F.lit(1))).alias(c) for c in "rgb"])


@query("ortho_raster", _ortho_sql("125e-3"), "corners points meta")
def ortho_raster(t):
    """The gridded mesh with its cells' colours as texture, drawn from above and from four sides at a quarter of a cell."""
    corners = mesh.quad_corners(raster.full_blocks(t.grid, t.parts), t.meta, CELL)
    return draw.ortho(corners, cell_texture(t), 0.125, t.parts).withColumn("depth", R6("depth"))


@query("drawings", _drawing_sql("25e-2"), "corners")
def drawings(t):
    """Plan and four elevations of the gridded mesh at half a cell, with colours from the vertex ids."""
    shade = [(F.col(v) % m).cast("double").alias(c + v) for c, m in zip("rgb", (251, 241, 239)) for v in "abc"]
    corners = mesh.face_corners(t.faces, t.vertices).join(t.faces.select("scene_id", "fid", *shade), ["scene_id", "fid"])
    return draw.drawings(corners, 0.25).withColumn("depth", R6("depth"))
