"""Registered queries over splats and point selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundloom.functions import geometry as g, harmonics
from groundloom.functions.numeric import exact_sum, finite, rounded, sigmoid
from groundloom.operators import picking, splats, terrain, transform
from groundloom.plans.catalog import query
from groundloom.plans.cameras import out
from groundloom.plans.tables import view
from groundloom.plans.terrain import r6, r9

R6 = rounded

view("plain", ("points",), "SELECT *, point_id AS splat_id, (1e0/(1e0+exp(-opacity_logit)))*exp(2*((ls0+ls1+ls2)/3)) AS vis FROM points")


def plain(t):
    """Points as splats without their colour coefficients (so those are never read)."""
    return t.points.withColumnRenamed("point_id", "splat_id")


@query("visibility", f"SELECT scene_id, splat_id, {r9('vis')} AS visibility FROM plain", "plain")
def visibility(t):
    return splats.with_visibility(plain(t)).select("scene_id", "splat_id", rounded("visibility", 9).alias("visibility"))


# levels are ranked on a rounded visibility so that both engines see the same ties
@query("splat_levels", """WITH r AS (SELECT scene_id, splat_id, row_number() OVER (PARTITION BY scene_id ORDER BY floor(vis*1e9+5e-1) DESC, splat_id) AS k FROM plain)
 SELECT scene_id, splat_id, level FROM r JOIN (VALUES ('high',9000000000),('med',2000),('low',800),('verylow',100)) l(level,n) ON k<=n""", "plain")
def splat_levels(t):
    s = splats.with_visibility(plain(t)).select("scene_id", "splat_id", F.floor(F.col("visibility") * 1e9 + 0.5).alias("visibility"))
    return splats.levels(s, {"high": None, "med": 2000, "low": 800, "verylow": 100})


@query("thin_splats", """WITH r AS (SELECT scene_id, splat_id, x, y, z, row_number() OVER (PARTITION BY scene_id ORDER BY floor((1e0/(1e0+exp(-opacity_logit)))*exp((ls0+ls1+ls2)/3)*1e9+5e-1) DESC, splat_id) AS k FROM plain)
 SELECT scene_id, splat_id, x, y, z FROM r WHERE k<=1500""", "plain")
def thin_splats(t):
    size = F.exp((F.col("ls0") + F.col("ls1") + F.col("ls2")) / 3)
    s = plain(t).select("scene_id", "splat_id", "x", "y", "z", F.floor(sigmoid("opacity_logit") * size * 1e9 + 0.5).alias("weight"))
    return splats.top_n(s, ["scene_id"], "weight", "splat_id", 1500).drop("weight")


@query("opacity_filter", """WITH r AS (SELECT scene_id, splat_id, opacity_logit, row_number() OVER (PARTITION BY scene_id ORDER BY splat_id)-1 AS k, count(*) OVER (PARTITION BY scene_id) AS n FROM plain)
 SELECT scene_id, splat_id FROM r WHERE k % greatest(1, n//700) = 0 AND opacity_logit >= 0""", "plain")
def opacity_filter(t):
    """About 700 evenly taken splats per scene, the opaque ones of them."""
    return splats.solid_sample(plain(t).select("scene_id", "splat_id", "opacity_logit"), 700).select("scene_id", "splat_id")


@query("section_box", """WITH u AS (SELECT scene_id, 'x' AS a, x AS v, splat_id FROM plain UNION ALL SELECT scene_id, 'y', y, splat_id FROM plain UNION ALL SELECT scene_id, 'z', z, splat_id FROM plain),
 s AS (SELECT *, row_number() OVER (PARTITION BY scene_id, a ORDER BY v, splat_id)-1 AS k, count(*) OVER (PARTITION BY scene_id, a) AS n FROM u),
 q AS (SELECT scene_id, a, max(v) FILTER (k=floor(2e-2*(n-1))) AS lo, max(v) FILTER (k=floor(98e-2*(n-1))) AS hi FROM s GROUP BY 1,2),
 b AS (SELECT scene_id, max(lo+(hi-lo)*2e-1) FILTER (a='x') AS x0, max(lo+(hi-lo)*8e-1) FILTER (a='x') AS x1, max(lo) FILTER (a='y') AS y0, max(lo+(hi-lo)*5e-1) FILTER (a='y') AS y1,
 max(lo) FILTER (a='z') AS z0, max(hi) FILTER (a='z') AS z1 FROM q GROUP BY 1)
 SELECT p.scene_id, splat_id FROM plain p JOIN b ON b.scene_id=p.scene_id WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1""", "plain")
def section_box(t):
    """x given inverted (0.8 to 0.2), y clamped from -3 to 0.5, z left whole."""
    spec = {"enabled": True, "min": {"x": 0.8, "y": -3.0}, "max": {"x": 0.2, "y": 0.5}}
    return splats.section(plain(t).select("scene_id", "splat_id", "x", "y", "z"), spec).select("scene_id", "splat_id")


@query("cloud_profile", """SELECT scene_id, count(*) AS splats, 3 AS degree, 'gaussian' AS layout, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM plain GROUP BY 1""", "plain")
def cloud_profile(t):
    s = t.splats
    degree = {0: 0, 9: 1, 24: 2, 45: 3}[45 if "f_rest" in s.columns else 0]
    gaussian = {"ls0", "rw"} <= set(s.columns)
    p = plain(t).groupBy("scene_id").agg(F.count(F.lit(1)).alias("splats"), *[f(a).alias(a + n) for a in "xyz" for f, n in ((F.min, "0"), (F.max, "1"))])
    return p.withColumn("degree", F.lit(degree)).withColumn("layout", F.lit("gaussian" if gaussian else "plain"))


@query("axis_flip", "SELECT scene_id, splat_id, x AS vx, -y AS vy, -z AS vz, x AS gx, z AS gy, -y AS gz FROM plain", "plain")
def axis_flip(t):
    """Viewer frame (x, -y, -z) and glTF frame (x, z, -y)."""
    return plain(t).selectExpr("scene_id", "splat_id", "x AS vx", "-y AS vy", "-z AS vz", "x AS gx", "z AS gy", "-y AS gz")


@query("finite_filter", "SELECT scene_id, count(*) AS kept, CAST(max(total) AS BIGINT)-count(*) AS dropped FROM (SELECT *, count(*) OVER (PARTITION BY scene_id) AS total FROM points) q WHERE r % 10 <> 5 AND g <> 72 GROUP BY 1", "points")
def finite_filter(t):
    """Rows with a NaN (made from r) or an infinite (made from g) coordinate are dropped."""
    p = t.points.withColumn("x", F.expr("CASE WHEN r % 10 = 5 THEN CAST('NaN' AS DOUBLE) ELSE x END")).withColumn("y", F.expr("CASE WHEN g = 72 THEN CAST('Infinity' AS DOUBLE) ELSE y END"))
    ok = finite("x") & finite("y") & finite("z")
    c = p.groupBy("scene_id").agg(F.sum(F.when(ok, 1).otherwise(0)).alias("kept"), F.sum(F.when(ok, 0).otherwise(1)).alias("dropped"))
    return c.where("kept > 0")


view("basis", ("splats",), """SELECT *, x/l AS a, y/l AS b, z/l AS c FROM (SELECT *, sqrt(x*x+y*y+z*z) AS l FROM splats) q""")


def _sh_sql() -> str:
    b1, b2, b3 = harmonics.C1, harmonics.C2, harmonics.C3
    f = lambda v: f"({v!r}::DOUBLE)"
    terms = [f"b*{f(-b1)}", f"c*{f(b1)}", f"a*{f(-b1)}", f"a*b*{f(b2[0])}", f"b*c*{f(b2[1])}", f"(c*c*2-a*a-b*b)*{f(b2[2])}", f"a*c*{f(b2[3])}", f"(a*a-b*b)*{f(b2[4])}",
             f"b*(a*a*3-b*b)*{f(b3[0])}", f"a*b*c*{f(b3[1])}", f"b*(c*c*4-a*a-b*b)*{f(b3[2])}", f"c*(c*c*2-a*a*3-b*b*3)*{f(b3[3])}", f"a*(c*c*4-a*a-b*b)*{f(b3[4])}", f"c*(a*a-b*b)*{f(b3[5])}", f"a*(a*a-b*b*3)*{f(b3[6])}"]
    ch = lambda k, dc: r6(f"greatest({dc}*{f(harmonics.C0)}+(0e0+" + "+".join(f"f_rest[{k * 15 + i + 1}]::DOUBLE*y{i}" for i in range(15)) + ")+5e-1,0e0)")
    return f"WITH y AS (SELECT *, {', '.join(f'{x} AS y{i}' for i, x in enumerate(terms))} FROM basis) SELECT scene_id, splat_id, {ch(0, 'dc0')} AS red, {ch(1, 'dc1')} AS green, {ch(2, 'dc2')} AS blue FROM y"


@query("sh_colour", _sh_sql(), "basis")
def sh_colour(t):
    """Colour seen from the origin."""
    s = t.splats.withColumn("_l", F.expr("sqrt(x*x+y*y+z*z)")).withColumns({"a": F.col("x") / F.col("_l"), "b": F.col("y") / F.col("_l"), "c": F.col("z") / F.col("_l")})
    s = harmonics.colour(s, ("a", "b", "c"), ["dc0", "dc1", "dc2"], "f_rest")
    return out(s, ["scene_id", "splat_id"], red="red", green="green", blue="blue")


view("splatm", ("splats",), """SELECT *, 1-2*(qy*qy+qz*qz) AS m00, 2*(qx*qy-qw*qz) AS m01, 2*(qx*qz+qw*qy) AS m02, 2*(qx*qy+qw*qz) AS m10, 1-2*(qx*qx+qz*qz) AS m11, 2*(qy*qz-qw*qx) AS m12,
 2*(qx*qz-qw*qy) AS m20, 2*(qy*qz+qw*qx) AS m21, 1-2*(qx*qx+qy*qy) AS m22, exp(2*ls0) AS s0, exp(2*ls1) AS s1, exp(2*ls2) AS s2 FROM (SELECT *, rw/n AS qw, rx/n AS qx, ry/n AS qy, rz/n AS qz FROM (
 SELECT scene_id, splat_id, x, y, z, ls0, ls1, ls2, rw, rx, ry, rz, sqrt(rw*rw+rx*rx+ry*ry+rz*rz) AS n FROM splats) q) p""")


@query("covariance_project", f"""WITH c AS (SELECT scene_id, splat_id, x-1e1 AS cx, -(z-3e0) AS cy, y+2e0 AS cz, {', '.join(f'm{a}0*m{b}0*s0+m{a}1*m{b}1*s1+m{a}2*m{b}2*s2 AS k{a}{b}' for a in range(3) for b in range(a, 3))} FROM splatm),
 d AS (SELECT *, k00 AS c00, -k02 AS c01, k01 AS c02, k22 AS c11, -k12 AS c12, k11 AS c22, 5e2/cz AS fz, -5e2*cx/(cz*cz) AS gx, -5e2*cy/(cz*cz) AS gy FROM c),
 e AS (SELECT scene_id, splat_id, fz*fz*c00+2*fz*gx*c02+gx*gx*c22+3e-1 AS a, fz*fz*c01+fz*gy*c02+fz*gx*c12+gx*gy*c22 AS b, fz*fz*c11+2*fz*gy*c12+gy*gy*c22+3e-1 AS c FROM d)
 SELECT scene_id, splat_id, {r6('a')} AS a, {r6('b')} AS b, {r6('c')} AS c, CAST(ceil(3*sqrt(5e-1*(a+c)+sqrt(greatest(25e-2*(a-c)*(a-c)+b*b,0e0)))) AS BIGINT) AS radius FROM e""", "splatm")
def covariance_project(t):
    """Footprints in a camera at (10, -2, 3) looking along +y."""
    s = splats.covariance(g.with_rotation(t.splats, ("rw", "rx", "ry", "rz")))
    # camera axes: right = x, down = -z, forward = y
    s = s.selectExpr("scene_id", "splat_id", "5e2 AS focal", "x - 1e1 AS X", "-(z - 3e0) AS Y", "y + 2e0 AS Z", "c00", "-c02 AS c01", "c01 AS c02", "c22 AS c11", "-c12 AS c12", "c11 AS c22")
    f = splats.footprint(s)
    return f.select("scene_id", "splat_id", R6("a").alias("a"), R6("b").alias("b"), R6("c").alias("c"), "radius")


@query("alpha_composite", f"""WITH h AS (SELECT scene_id, CAST(floor(x*2) AS INT) AS px, CAST(floor(y*2) AS INT) AS py, z, point_id, r, least(99e-2, 1e0/(1e0+exp(-opacity_logit))) AS alpha FROM points),
 k AS (SELECT *, CAST(coalesce(sum(CAST(floor(ln(1-alpha)*1e9+5e-1) AS BIGINT)) OVER (PARTITION BY scene_id, px, py ORDER BY z, point_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS DOUBLE)/1e9 AS l FROM h WHERE alpha >= 1/255e0),
 w AS (SELECT *, CASE WHEN exp(l)>1e-4 THEN exp(l)*alpha ELSE 0e0 END AS w FROM k)
 SELECT scene_id, px, py, {r6('CAST(sum(CAST(floor(w*r*1e9+5e-1) AS BIGINT)) AS DOUBLE)/1e9')} AS r, {r6('CAST(sum(CAST(floor(w*1e9+5e-1) AS BIGINT)) AS DOUBLE)/1e9')} AS opacity, count(*) AS layers FROM w GROUP BY 1,2,3""", "points")
def alpha_composite(t):
    h = t.points.select("scene_id", F.expr("CAST(floor(x*2) AS INT)").alias("px"), F.expr("CAST(floor(y*2) AS INT)").alias("py"), "z", "point_id", "r", sigmoid("opacity_logit").alias("alpha"))
    c = splats.composite(h, ["scene_id", "px", "py"], "z", "point_id", ["r"], 1.0)
    return c.select("scene_id", "px", "py", R6("r").alias("r"), R6("opacity").alias("opacity"), "layers")


@query("top_surface_colour", """WITH s AS (SELECT *, exp(greatest(ls0,ls1,ls2)) AS size FROM plain WHERE opacity_logit >= 0),
 q AS (SELECT scene_id, max(size) FILTER (k=floor(9e-1*(n-1))) AS big FROM (SELECT scene_id, size, row_number() OVER (PARTITION BY scene_id ORDER BY size, splat_id)-1 AS k, count(*) OVER (PARTITION BY scene_id) AS n FROM s) a GROUP BY 1),
 ex AS (SELECT scene_id, max(v) FILTER (a='x' AND k=floor(5e-2*(n-1))) AS u0, max(v) FILTER (a='x' AND k=floor(95e-2*(n-1))) AS u1, max(v) FILTER (a='y' AND k=floor(5e-2*(n-1))) AS v0, max(v) FILTER (a='y' AND k=floor(95e-2*(n-1))) AS v1 FROM (
 SELECT *, row_number() OVER (PARTITION BY scene_id, a ORDER BY v, splat_id)-1 AS k, count(*) OVER (PARTITION BY scene_id, a) AS n FROM (SELECT scene_id, 'x' AS a, x AS v, splat_id FROM s UNION ALL SELECT scene_id, 'y', y, splat_id FROM s) b) c GROUP BY 1),
 f AS (SELECT scene_id, span, (u0+u1)/2-span/2 AS u0, (v0+v1)/2-span/2 AS v0 FROM (SELECT *, greatest(u1-u0,v1-v0)*108e-2 AS span FROM ex) d),
 p AS (SELECT s.scene_id, CAST(floor((x-u0)/span*100) AS INT) AS gx, 99-CAST(floor((y-v0)/span*100) AS INT) AS gy, z, splat_id, r, g, b FROM s JOIN q ON q.scene_id=s.scene_id JOIN f ON f.scene_id=s.scene_id WHERE size<=big AND z<=7e0)
 SELECT scene_id, gx, gy, count(*) AS n, arg_max(r, row(z,-splat_id)) AS r, arg_max(g, row(z,-splat_id)) AS g, arg_max(b, row(z,-splat_id)) AS b FROM p WHERE gx BETWEEN 0 AND 99 AND gy BETWEEN 0 AND 99 GROUP BY 1,2,3 HAVING count(*)>=3""", "plain")
def top_surface_colour(t):
    return splats.plan_raster(plain(t), 7.0)


@query("voxel_anti", """WITH v AS (SELECT scene_id, x, y, z FROM vertices), o AS (SELECT scene_id, min(x)-1e0 AS ox, min(y)-1e0 AS oy, min(z)-1e0 AS oz FROM (SELECT scene_id, x, y, z FROM plain UNION ALL SELECT * FROM v) q GROUP BY 1),
 k AS (SELECT DISTINCT v.scene_id, CAST(floor(x-ox) AS BIGINT) AS i, CAST(floor(y-oy) AS BIGINT) AS j, CAST(floor(z-oz) AS BIGINT) AS k FROM v JOIN o ON o.scene_id=v.scene_id),
 c AS (SELECT DISTINCT scene_id, i+a AS i, j+b AS j, k+c AS k FROM k CROSS JOIN (VALUES (-1),(0),(1)) x(a) CROSS JOIN (VALUES (-1),(0),(1)) y(b) CROSS JOIN (VALUES (-1),(0),(1)) z(c))
 SELECT p.scene_id, p.splat_id, c.i IS NOT NULL AS on_surface, c.i IS NOT NULL AND 3*exp(greatest(ls0,ls1,ls2))<1e0 AS "drop" FROM plain p JOIN o ON o.scene_id=p.scene_id
 LEFT JOIN c ON c.scene_id=p.scene_id AND c.i=CAST(floor(p.x-ox) AS BIGINT) AND c.j=CAST(floor(p.y-oy) AS BIGINT) AND c.k=CAST(floor(p.z-oz) AS BIGINT)""", "plain vertices")
def voxel_anti(t):
    """Splats lying on the gridded surface, and which of them the mesh replaces (one-unit voxels)."""
    s = plain(t).select("scene_id", "splat_id", "x", "y", "z", "ls0", "ls1", "ls2")
    return splats.voxel_overlap(s, t.vertices, 1.0).select("scene_id", "splat_id", "on_surface", "drop")


@query("outer_product_3x3", f"""SELECT scene_id, {', '.join(r6(f'CAST(sum(CAST(floor(s{a}*s{b}*1e6+5e-1) AS BIGINT)) AS DOUBLE)/1e6/count(*)') + f' AS m{a}{b}' for a in 'xyz' for b in 'xyz' if a <= b)} FROM cameras GROUP BY 1""", "cameras")
def outer_product_3x3(t):
    """Mean outer product of the cameras' sideways axes."""
    e = {f"m{a}{b}": R6(exact_sum(F.col("s" + a) * F.col("s" + b)) / F.count(F.lit(1))) for a in "xyz" for b in "xyz" if a <= b}
    return t.cameras.groupBy("scene_id").agg(*[c.alias(n) for n, c in e.items()])


@query("photo_aspect", f"SELECT scene_id, {r6('max(abs((x-1e1)/z))/max(abs((y-6e0)/z))')} AS aspect FROM points WHERE z > 1e-6 GROUP BY 1", "points")
def photo_aspect(t):
    p = t.points.where("z > 1e-6")
    return p.groupBy("scene_id").agg(R6(F.max(F.expr("abs((x-1e1)/z)")) / F.max(F.expr("abs((y-6e0)/z)"))).alias("aspect"))


def _ellipsoid_sql() -> str:
    """Distance of every ray of a scene to every splat of it, as terms a, b, c of the quadratic."""
    k = lambda v, j: "(" + "+".join(f"{v}{a}*m{r}{j}" for r, a in enumerate("xyz")) + ")"
    total = lambda u, v: "+".join(f"{k(u, j)}*{k(v, j)}/s{j}" for j in range(3))
    return f"{total('d', 'd')} AS qa, {total('p', 'd')} AS qb, {total('p', 'p')}-9e0 AS qc"


@query("pick_ray", f"""WITH o AS (SELECT m.* FROM splatm m JOIN points p ON p.scene_id=m.scene_id AND p.point_id=m.splat_id WHERE p.opacity_logit >= 0),
 t AS (SELECT c.scene_id, c.frame, o.splat_id, c.px-o.x AS px, c.py-o.y AS py, c.pz-o.z AS pz, c.fx AS dx, c.fy AS dy, c.fz AS dz, {', '.join(f'm{r}{c}' for r in range(3) for c in range(3))}, s0, s1, s2 FROM cameras c JOIN o ON o.scene_id=c.scene_id),
 q AS (SELECT scene_id, frame, splat_id, {_ellipsoid_sql()} FROM t), h AS (SELECT scene_id, frame, splat_id, CASE WHEN (-qb-sqrt(qb*qb-qa*qc))/qa >= 0 THEN (-qb-sqrt(qb*qb-qa*qc))/qa ELSE (-qb+sqrt(qb*qb-qa*qc))/qa END AS d FROM q WHERE qb*qb-qa*qc >= 0 AND (-qb+sqrt(qb*qb-qa*qc))/qa >= 0)
 SELECT scene_id, frame AS ray_id, arg_min(splat_id, row(d, splat_id)) AS splat_id, {r6('min(d)')} AS distance FROM h GROUP BY 1,2""", "splatm points cameras")
def pick_ray(t):
    """The first opaque splat (three sigmas) along every placed camera's line of sight."""
    rays = t.cameras.select("scene_id", F.col("frame").alias("ray_id"), *[F.col("p" + a).alias("o" + a) for a in "xyz"], *[F.col("f" + a).alias("d" + a) for a in "xyz"])
    hits = picking.ray_hits(g.with_rotation(t.splats, ("rw", "rx", "ry", "rz")), rays)
    return hits.select("scene_id", "ray_id", "splat_id", R6("distance").alias("distance"))


# each scene has its own frame: a turn about its own axis, a scale and a shift
view("siteframes", ("points",), """SELECT *, s*(1-2*(c*c+d*d)) AS a00, s*2*(b*c-w*d) AS a01, s*2*(b*d+w*c) AS a02, s*2*(b*c+w*d) AS a10, s*(1-2*(b*b+d*d)) AS a11, s*2*(c*d-w*b) AS a12,
 s*2*(b*d-w*c) AS a20, s*2*(c*d+w*b) AS a21, s*(1-2*(b*b+c*c)) AS a22, 15e-1 AS t0, -2e0 AS t1, 25e-2+scene_id/1e1 AS t2 FROM (SELECT scene_id, s, qw/n AS w, qx/n AS b, qy/n AS c, qz/n AS d FROM (
 SELECT *, sqrt(qw*qw+qx*qx+qy*qy+qz*qz) AS n FROM (SELECT DISTINCT scene_id, 3125e-4*(1+scene_id/1e1) AS s, 1e0 AS qw, CAST(scene_id % 5 AS DOUBLE)/4e0-3e-1 AS qx, CAST(scene_id % 7 AS DOUBLE)/5e0-6e-1 AS qy, CAST(scene_id % 11 AS DOUBLE)/6e0 AS qz FROM points) q3) q2) q1""")


def site_frames(t):
    f = t.points.select("scene_id").distinct().selectExpr(
        "scene_id", "3125e-4 * (1 + scene_id / 1e1) AS s", "1e0 AS qw", "CAST(scene_id % 5 AS DOUBLE)/4e0-3e-1 AS qx", "CAST(scene_id % 7 AS DOUBLE)/5e0-6e-1 AS qy", "CAST(scene_id % 11 AS DOUBLE)/6e0 AS qz")
    f = g.with_rotation(f, prefix="a")
    return f.select("scene_id", *[(F.col("s") * F.col(e)).alias(e) for e in transform.ENTRIES], F.lit(1.5).alias("t0"), F.lit(-2.0).alias("t1"), (F.lit(0.25) + F.col("scene_id") / F.lit(10.0)).alias("t2"))


def moved(t):
    """Splats in site axes; each has its direction from the origin as a normal."""
    l = F.expr("sqrt(x*x+y*y+z*z)")
    s = t.splats.withColumn("_l", l).withColumns({"n" + a: F.col(a) / F.col("_l") for a in "xyz"}).drop("_l")
    return transform.to_site(s, site_frames(t))


R4 = lambda c: rounded(c, 4)
r4 = lambda e: f"floor(({e})*1e4+5e-1)/1e4"


@query("affine_to_site", f"""SELECT p.scene_id, splat_id, {', '.join(r4(f'a{r}0*x+a{r}1*y+a{r}2*z+t{r}') + f' AS {a}' for r, a in enumerate('xyz'))}, {', '.join(r4(f'ls{k}+ln(s)') + f' AS ls{k}' for k in range(3))},
 {', '.join(r4(f'(a{r}0*x+a{r}1*y+a{r}2*z)/s/sqrt(x*x+y*y+z*z)') + f' AS n{a}' for r, a in enumerate('xyz'))} FROM splats p JOIN siteframes f ON f.scene_id=p.scene_id""", "splats siteframes")
def affine_to_site(t):
    """Positions, normals and log sizes of all splats in the frames of their scenes."""
    m = moved(t)
    return m.select("scene_id", "splat_id", *[R4(c).alias(c) for c in ("x", "y", "z", "ls0", "ls1", "ls2", "nx", "ny", "nz")])


def _turned_cov(i: int, j: int) -> str:
    """Entry of A (R S S' R') A' from the covariance before the move."""
    k = lambda a, b: "+".join(f"m{a}{n}*m{b}{n}*s{n}" for n in range(3))
    return "+".join(f"f.a{i}{a}*f.a{j}{b}*({k(a, b)})" for a in range(3) for b in range(3))


@query("affine_covariance", f"SELECT p.scene_id, splat_id, {', '.join(r4(_turned_cov(i, j)) + f' AS c{i}{j}' for i in range(3) for j in range(i, 3))} FROM splatm p JOIN siteframes f ON f.scene_id=p.scene_id", "splatm siteframes")
def affine_covariance(t):
    """Covariances from the moved sizes and orientations: those from before, carried by the frame."""
    m = splats.covariance(g.with_rotation(moved(t), ("rw", "rx", "ry", "rz")))
    return m.select("scene_id", "splat_id", *[R4(f"c{i}{j}").alias(f"c{i}{j}") for i in range(3) for j in range(i, 3)])


@query("sh_rotate", _sh_sql().replace("*1e6+5e-1)/1e6", "*1e4+5e-1)/1e4"), "basis")
def sh_rotate(t):
    """Colour of the moved splats seen along the turned direction: the colour from before."""
    s = harmonics.colour(moved(t), ("nx", "ny", "nz"), ["dc0", "dc1", "dc2"], "f_rest")
    return s.select("scene_id", "splat_id", *[R4(c).alias(c) for c in ("red", "green", "blue")])
