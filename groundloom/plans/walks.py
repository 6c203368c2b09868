"""Registered queries over the filmed walk."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundloom.functions.numeric import exact_sum, rounded
from groundloom.operators import nearest, raster, sequence, walk
from groundloom.operators.order_stats import quantiles
from groundloom.plans.catalog import query
from groundloom.plans.tables import DIR, view
from groundloom.plans.terrain import r6, r9

R6 = rounded
R9 = lambda c: rounded(c, 9)

view("steps", ("walk",), """SELECT *, CAST(coalesce(sum(CAST(floor(step*1e6+5e-1) AS BIGINT)) OVER (PARTITION BY scene_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS DOUBLE)/1e6 AS start,
 CAST(coalesce(sum(CAST(floor(pstep*1e6+5e-1) AS BIGINT)) OVER (PARTITION BY scene_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS DOUBLE)/1e6 AS pstart FROM (
 SELECT *, sqrt((nx-px)*(nx-px)+(ny-py)*(ny-py)+(nz-pz)*(nz-pz)) AS step, sqrt((nx-px)*(nx-px)+(ny-py)*(ny-py)) AS pstep FROM (
 SELECT *, lead(px) OVER w AS nx, lead(py) OVER w AS ny, lead(pz) OVER w AS nz, row_number() OVER w AS k FROM walk WINDOW w AS (PARTITION BY scene_id ORDER BY frame)) a) b""")
view("along", ("points", "steps"), """SELECT scene_id, point_id, x, y, z, b.seg, b.d AS distance, b.start+b.t*b.len AS along, sign(b.dx*(y-b.ay)-b.dy*(x-b.ax))*b.d AS across FROM (
 SELECT p.scene_id, p.point_id, any_value(p.x) AS x, any_value(p.y) AS y, any_value(p.z) AS z, arg_min({'seg':s.frame,'d':p.d,'t':p.t,'start':s.pstart,'len':s.pstep,'dx':s.nx-s.px,'dy':s.ny-s.py,'ax':s.px,'ay':s.py}, row(p.d, p.frame)) AS b FROM (
 SELECT *, sqrt((rx-t*dx)*(rx-t*dx)+(ry-t*dy)*(ry-t*dy)) AS d FROM (
 SELECT p.*, s.frame, p.x-s.px AS rx, p.y-s.py AS ry, s.nx-s.px AS dx, s.ny-s.py AS dy,
 least(1e0,greatest(0e0,((p.x-s.px)*(s.nx-s.px)+(p.y-s.py)*(s.ny-s.py))/((s.nx-s.px)*(s.nx-s.px)+(s.ny-s.py)*(s.ny-s.py)))) AS t
 FROM points p JOIN steps s ON s.scene_id=p.scene_id WHERE s.nx IS NOT NULL) q) p JOIN steps s ON s.scene_id=p.scene_id AND s.frame=p.frame GROUP BY 1,2) g""")


@query("walk_cumlength", f"SELECT scene_id, frame, {r9('step')} AS step, {r9('start')} AS start FROM steps", "steps")
def walk_cumlength(t):
    return walk.cumulative_length(t.walk).select("scene_id", "frame", R9("step").alias("step"), R9("start").alias("start"))


@query("path_length_extent", f"""SELECT scene_id, count(*) AS frames, {r6('CAST(sum(CAST(floor(step*1e6+5e-1) AS BIGINT)) AS DOUBLE)/1e6')} AS length,
 {r6('sqrt((max(px)-min(px))*(max(px)-min(px))+(max(py)-min(py))*(max(py)-min(py))+(max(pz)-min(pz))*(max(pz)-min(pz)))')} AS extent FROM steps GROUP BY 1""", "steps")
def path_length_extent(t):
    return walk.length_and_extent(t.walk).select("scene_id", "frames", R6("length").alias("length"), R6("extent").alias("extent"))


@query("nearest_segment", f"SELECT scene_id, point_id, seg, {r6('distance')} AS distance, {r6('along')} AS along, {r6('across')} AS across FROM along", "along")
def nearest_segment(t):
    return walk.along_walk(t.points_wide, t.walk).select("scene_id", "point_id", "seg", R6("distance").alias("distance"), R6("along").alias("along"), R6("across").alias("across"))


@query("corridor", f"""WITH c AS (SELECT *, count(*) OVER (PARTITION BY scene_id) AS n FROM along WHERE distance <= 15e-1)
 SELECT scene_id, point_id, {r6('along')} AS along, {r6('across')} AS across, CASE WHEN n < 100 THEN 'too few points' ELSE 'ok' END AS status FROM c""", "along")
def corridor(t):
    return walk.corridor(t.points_wide, t.walk, 1.5).select("scene_id", "point_id", R6("along").alias("along"), R6("across").alias("across"), "status")


@query("profile_along", f"""SELECT scene_id, CAST(floor(along/2e0) AS BIGINT)*2e0 AS "from", (CAST(floor(along/2e0) AS BIGINT)+1)*2e0 AS "to",
 floor(CAST(sum(CAST(floor(z*1e6+5e-1) AS BIGINT)) AS DOUBLE)/1e6/count(*)*1e3+5e-1)/1e3 AS mean_z, count(*) AS points FROM along WHERE distance <= 15e-1 GROUP BY 1,2,3 HAVING count(*) >= 10""", "along")
def profile_along(t):
    return walk.profile(walk.corridor(t.points_wide, t.walk, 1.5), 2.0).withColumn("mean_z", rounded("mean_z", 3))


@query("grade_fit", f"""WITH s AS (SELECT scene_id, count(*) AS n, {', '.join(f"CAST(sum(CAST(floor({e}*1e6+5e-1) AS BIGINT)) AS DOUBLE)/1e6 AS {a}" for a, e in (('sx', 'along'), ('sy', 'z'), ('sxx', '(along*along)'), ('sxy', '(along*z)')))}, max(along)-min(along) AS run
 FROM along WHERE distance <= 15e-1 GROUP BY 1), m AS (SELECT *, (n*sxy-sx*sy)/(n*sxx-sx*sx) AS slope FROM s WHERE n > 2 AND run > 0)
 SELECT scene_id, n, {r6('run')} AS run, floor(-slope*run*1e3+5e-1)/1e3 AS fall, floor(-slope*100*1e1+5e-1)/1e1 AS grade_percent FROM m""", "along")
def grade_fit(t):
    g = walk.grade(walk.corridor(t.points_wide, t.walk, 1.5))
    return g.select("scene_id", "n", R6("run").alias("run"), rounded("fall", 3).alias("fall"), rounded("grade_percent", 1).alias("grade_percent"))


@query("unrolled_raster", f"""WITH c AS (SELECT * FROM along WHERE distance <= 15e-1), e AS (SELECT scene_id, min(along) AS x0, max(across) AS y1 FROM c GROUP BY 1)
 SELECT c.scene_id, CAST(floor((y1-across)/5e-1) AS BIGINT) AS i, CAST(floor((along-x0)/5e-1) AS BIGINT) AS j, CASE WHEN count(*)>=2 THEN {r9('CAST(sum(CAST(floor(z*1e6+5e-1) AS BIGINT)) AS DOUBLE)/1e6/count(*)')} END AS z, count(*) AS n
 FROM c JOIN e ON e.scene_id=c.scene_id GROUP BY 1,2,3""", "along")
def unrolled_raster(t):
    """The corridor laid out flat: along by across."""
    flat = walk.corridor(t.points_wide, t.walk, 1.5).select("scene_id", F.col("along").alias("x"), F.col("across").alias("y"), "z")
    return raster.rasterise(flat, 0.5, 2).select("scene_id", "i", "j", R9("z").alias("z"), "n")


# the points nearest the first camera in plan, k from 1, and how far above it they lie
AROUND_FIRST = """f AS (SELECT scene_id, arg_min({'x':px,'y':py,'z':pz}, frame) AS c FROM walk GROUP BY 1),
 d AS (SELECT p.scene_id, p.z-f.c.z AS dz, row_number() OVER (PARTITION BY p.scene_id ORDER BY (p.x-f.c.x)*(p.x-f.c.x)+(p.y-f.c.y)*(p.y-f.c.y), p.point_id) AS k FROM points p JOIN f ON f.scene_id=p.scene_id)"""


@query("radius_ground", f"""WITH l AS (SELECT scene_id, greatest(CAST(sum(CAST(floor(pstep*1e6+5e-1) AS BIGINT)) AS DOUBLE)/1e6*8e-2, 1e-6) AS r FROM steps GROUP BY 1),
 h AS (SELECT w.scene_id, w.frame, any_value(w.pz)-quantile_cont(p.z, 1e-1) AS height FROM walk w JOIN l ON l.scene_id=w.scene_id JOIN points p ON p.scene_id=w.scene_id
 AND sqrt((p.x-w.px)*(p.x-w.px)+(p.y-w.py)*(p.y-w.py)) < l.r GROUP BY 1,2 HAVING count(*) >= 30),
 m AS (SELECT l.scene_id, count(h.frame) AS frames, quantile_cont(h.height, 5e-1) AS med FROM l LEFT JOIN h ON h.scene_id=l.scene_id GROUP BY 1), {AROUND_FIRST},
 b AS (SELECT scene_id, count(*) FILTER (WHERE dz<0) AS n, -(quantile_cont(dz, 5e-2) FILTER (WHERE dz<0)) AS held FROM d WHERE k<=3000 GROUP BY 1)
 SELECT m.scene_id, frames, {r6('CASE WHEN frames>=3 THEN med WHEN n>=50 THEN b.held ELSE 0e0 END')} AS held,
 CASE WHEN frames>=3 THEN 'below the walk' WHEN n>=50 THEN 'around the first camera' ELSE 'none' END AS source FROM m LEFT JOIN b ON b.scene_id=m.scene_id""", "steps points walk")
def radius_ground(t):
    return walk.held_height(t.points, t.walk).select("scene_id", "frames", R6("held").alias("held"), "source")


@query("held_fallback", f"""WITH {AROUND_FIRST}
 SELECT scene_id, count(*) FILTER (WHERE dz<0) AS points, CASE WHEN count(*) FILTER (WHERE dz<0) >= 50 THEN {r6('-(quantile_cont(dz, 5e-2) FILTER (WHERE dz<0))')} ELSE 0e0 END AS held FROM d WHERE k<=3000 GROUP BY 1""", "walk points")
def held_fallback(t):
    """How high the first camera was held, from the points around it."""
    return walk.held_fallback(t.points, t.walk).select("scene_id", "points", R6("held").alias("held"))


# the views that are asked about: every frame raised by half a unit; every third one looks to the side
ASKED = {"ax": f"CASE WHEN frame % 3 = 0 THEN -({DIR['ry']}) ELSE {DIR['rx']} END", "ay": f"CASE WHEN frame % 3 = 0 THEN {DIR['rx']} ELSE {DIR['ry']} END", "az": DIR["rz"]}


@query("nearest_camera", f"""WITH l AS (SELECT scene_id, CAST(sum(CAST(floor(step*1e6+5e-1) AS BIGINT)) AS DOUBLE)/1e6 AS len FROM steps GROUP BY 1),
 q AS (SELECT scene_id, frame, px, py, pz + 5e-1 AS qz, {', '.join(f'{e} AS {n}' for n, e in ASKED.items())} FROM frames), n AS (SELECT q.scene_id, q.frame, arg_min(c.frame, row(d, c.frame)) AS nearest, min(d) AS d FROM q JOIN LATERAL (
 SELECT frame, sqrt((q.px-c.px)*(q.px-c.px)+(q.py-c.py)*(q.py-c.py)+(q.qz-c.pz)*(q.qz-c.pz)) AS d FROM walk c WHERE c.scene_id=q.scene_id) c ON true GROUP BY 1,2),
 g AS (SELECT n.*, degrees(acos(greatest(-1e0, least(1e0, (q.ax*c.fx+q.ay*c.fy+q.az*c.fz)/sqrt(q.ax*q.ax+q.ay*q.ay+q.az*q.az))))) AS angle FROM n JOIN q ON q.scene_id=n.scene_id AND q.frame=n.frame JOIN cameras c ON c.scene_id=n.scene_id AND c.frame=n.nearest)
 SELECT g.scene_id, g.frame, g.nearest, {r6('d/len')} AS near_dist, floor(angle*1e4+5e-1)/1e4 AS view_angle, d/len <= 25e-2 AND angle <= 35 AS near_ok FROM g JOIN l ON l.scene_id=g.scene_id""", "frames steps cameras")
def nearest_camera(t):
    """Every frame's raised position and direction against the placed cameras."""
    asked = t.frames.select("scene_id", "frame", "px", "py", F.expr("pz + 5e-1").alias("pz"), *[F.expr(e).alias(n) for n, e in ASKED.items()])
    length = walk.length_and_extent(t.walk).select("scene_id", "length")
    n = walk.nearest_view(asked, t.cameras, length)
    return n.select("scene_id", "frame", "nearest", R6("near_dist").alias("near_dist"), rounded("view_angle", 4).alias("view_angle"), "near_ok")


@query("frame_status", """WITH m AS (SELECT scene_id, max(frame) AS last FROM frames WHERE on_disk=1 OR placed=1 GROUP BY 1), a AS (SELECT scene_id, unnest(generate_series(1,last)) AS frame FROM m)
 SELECT a.scene_id, a.frame, CASE WHEN p.frame IS NOT NULL THEN 'placed' WHEN d.frame IS NOT NULL THEN 'not placed by the solve' ELSE 'dropped (blurred)' END AS status
 FROM a LEFT JOIN (SELECT scene_id, frame FROM frames WHERE placed=1) p ON p.scene_id=a.scene_id AND p.frame=a.frame
 LEFT JOIN (SELECT scene_id, frame FROM frames WHERE on_disk=1) d ON d.scene_id=a.scene_id AND d.frame=a.frame""", "frames")
def frame_status(t):
    return status_rows(t)


def status_rows(t):
    """Frame numbers 1..last, each placed, on disk only, or dropped. One grouping instead of two outer joins."""
    marks = t.frames.where("placed = 1").select("scene_id", "frame", F.lit(2).alias("m")).unionByName(
        t.frames.where("on_disk = 1").select("scene_id", "frame", F.lit(1).alias("m")))
    last = marks.groupBy("scene_id").agg(F.max("frame").alias("last"))
    axis = last.select("scene_id", F.explode(F.sequence(F.lit(1).cast("bigint"), "last")).alias("frame"), F.lit(0).alias("m"))
    best = axis.unionByName(marks).groupBy("scene_id", "frame").agg(F.max("m").alias("m"))
    return best.select("scene_id", "frame", F.when(F.col("m") == 2, "placed").when(F.col("m") == 1, "not placed by the solve").otherwise("dropped (blurred)").alias("status"))


@query("capture_summary", f"""WITH m AS (SELECT scene_id, max(frame) AS last FROM frames WHERE on_disk=1 OR placed=1 GROUP BY 1),
 l AS (SELECT scene_id, CAST(sum(CAST(floor(step*1e6+5e-1) AS BIGINT)) AS DOUBLE)/1e6 AS len FROM steps GROUP BY 1),
 c AS (SELECT f.scene_id, count(*) FILTER (placed=1) AS placed, count(*) FILTER (placed=0 AND on_disk=1) AS not_placed FROM frames f GROUP BY 1)
 SELECT m.scene_id, m.last AS frames, c.placed, m.last-c.placed-c.not_placed AS dropped, c.not_placed, {r6('l.len')} AS walk_length, 'scan units' AS units, 'not set -- NOT TO SCALE' AS scale
 FROM m JOIN c ON c.scene_id=m.scene_id JOIN l ON l.scene_id=m.scene_id""", "frames steps")
def capture_summary(t):
    n = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0))
    c = status_rows(t).groupBy("scene_id").agg(F.count(F.lit(1)).alias("frames"), n("placed").alias("placed"), n("dropped (blurred)").alias("dropped"), n("not placed by the solve").alias("not_placed"))
    ln = walk.length_and_extent(t.walk).select("scene_id", R6("length").alias("walk_length"))
    return c.join(ln, "scene_id").select("*", F.lit("scan units").alias("units"), F.lit("not set -- NOT TO SCALE").alias("scale"))


@query("camera_centroid", f"""SELECT scene_id, {', '.join(r9(f'CAST(sum(CAST(floor({c}*1e6+5e-1) AS BIGINT)) AS DOUBLE)/1e6/count(*)') + f' AS {n}' for n, c in (('cx', 'px'), ('cy', '-py'), ('cz', '-pz')))} FROM walk GROUP BY 1""", "walk")
def camera_centroid(t):
    """Mean camera position in the viewer's frame (y and z flipped)."""
    m = lambda c: R9(exact_sum(F.expr(c)) / F.count(F.lit(1)))
    return t.walk.groupBy("scene_id").agg(m("px").alias("cx"), m("-py").alias("cy"), m("-pz").alias("cz"))


def _smooth_sql() -> str:
    taps = ", ".join(f"({d},{w!r}::DOUBLE)" for d, w in walk.smoothing_kernel(2.0))
    src = "CASE WHEN t.k+d<1 THEN 2-(t.k+d) WHEN t.k+d>t.n THEN 2*t.n-(t.k+d) ELSE t.k+d END"
    s = lambda c: r6(f"CAST(sum(CAST(floor(s.{c}*w*1e9+5e-1) AS BIGINT)) AS DOUBLE)/1e9") + f" AS {c}"
    return f"""WITH t AS (SELECT scene_id, k, count(*) OVER (PARTITION BY scene_id) AS n FROM steps)
 SELECT t.scene_id, t.k, {s('px')}, {s('py')}, {s('pz')} FROM t CROSS JOIN (VALUES {taps}) q(d,w) JOIN steps s ON s.scene_id=t.scene_id AND s.k={src} GROUP BY 1,2"""


@query("gaussian_smooth", _smooth_sql(), "steps")
def gaussian_smooth(t):
    s = walk.gaussian_smooth(walk.dense_index(t.walk), ["px", "py", "pz"], 2.0)
    return s.select("scene_id", "k", R6("px").alias("px"), R6("py").alias("py"), R6("pz").alias("pz"))


@query("interp_asof", f"""WITH s AS (SELECT scene_id, min(frame) AS a, max(frame) AS b FROM walk GROUP BY 1),
 g AS (SELECT scene_id, unnest(generate_series(0, CAST(floor((b-a)/75e-2) AS BIGINT))) AS g, a FROM s), q AS (SELECT scene_id, g, a+g*75e-2 AS t FROM g),
 b AS (SELECT q.*, l.frame AS tb, l.px AS xb, l.pz AS zb FROM q ASOF JOIN walk l ON l.scene_id=q.scene_id AND l.frame<=q.t),
 c AS (SELECT b.*, l.frame AS ta, l.px AS xa, l.pz AS za FROM b ASOF JOIN walk l ON l.scene_id=b.scene_id AND l.frame>=b.t)
 SELECT scene_id, g, t, {r9('xb+CASE WHEN ta>tb THEN (t-tb)/(ta-tb) ELSE 0e0 END*(xa-xb)')} AS px, {r9('zb+CASE WHEN ta>tb THEN (t-tb)/(ta-tb) ELSE 0e0 END*(za-zb)')} AS pz FROM c""", "walk")
def interp_asof(t):
    r = walk.resample(t.walk, "frame", ["px", "pz"], 0.75)
    return r.select("scene_id", "g", "t", R9("px").alias("px"), R9("pz").alias("pz"))


@query("run_around", """WITH f AS (SELECT scene_id, frame AS k, value < 3e2 AS ok FROM frames), c AS (SELECT scene_id, CAST(floor((min(k)+max(k))/2e0) AS BIGINT) AS c FROM f GROUP BY 1),
 s AS (SELECT f.scene_id, arg_min(k, row(abs(k-c), k)) AS s FROM f JOIN c ON c.scene_id=f.scene_id WHERE ok GROUP BY 1),
 g AS (SELECT scene_id, k, k-row_number() OVER (PARTITION BY scene_id ORDER BY k) AS island FROM f WHERE ok)
 SELECT a.scene_id, min(a.k) AS first, max(a.k) AS last FROM g a JOIN s ON s.scene_id=a.scene_id JOIN g m ON m.scene_id=s.scene_id AND m.k=s.s AND m.island=a.island GROUP BY 1""", "frames")
def run_around(t):
    f = t.frames.select("scene_id", F.col("frame").alias("k"), F.expr("value < 3e2").alias("ok"))
    return walk.run_around(f, F.floor((F.min("k") + F.max("k")) / 2.0).cast("bigint"))


@query("camera_sampling", """SELECT scene_id, frame, name FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY frame)-1 AS k, count(*) OVER (PARTITION BY scene_id) AS n FROM walk) q
 WHERE k % 10 = 0 OR k = n-1""", "walk")
def camera_sampling(t):
    """Every tenth camera and the last: the named views of an export."""
    n = t.walk.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"))
    return walk.dense_index(t.walk).join(n, "scene_id").where("(k - 1) % 10 = 0 OR k = n").select("scene_id", "frame", "name")


@query("walk_interpolate", f"""WITH y AS (SELECT w.*, atan2(py-1e1, px-1e1) AS yaw FROM walk w), n AS (SELECT *, lead(yaw) OVER w AS yaw2, lead(px) OVER w AS px2, lead(py) OVER w AS py2 FROM y WINDOW w AS (PARTITION BY scene_id ORDER BY frame)),
 d AS (SELECT *, CASE WHEN yaw2-yaw>pi() THEN yaw2-yaw-2*pi() WHEN yaw2-yaw<-pi() THEN yaw2-yaw+2*pi() ELSE yaw2-yaw END AS dy FROM n WHERE yaw2 IS NOT NULL)
 SELECT scene_id, frame, f, {r6('yaw+dy*f')} AS yaw, {r6('px+(px2-px)*f')} AS px, {r6('py+(py2-py)*f')} AS py FROM d CROSS JOIN (VALUES (0e0),(25e-2),(5e-1),(75e-2)) q(f)""", "walk")
def walk_interpolate(t):
    """Four poses per step between consecutive frames; yaw takes the shorter arc."""
    y = t.walk.withColumn("yaw", F.expr("atan2(py - 1e1, px - 1e1)"))
    n = sequence.neighbour(y, ["scene_id"], ["frame"], {"yaw2": F.col("yaw"), "px2": F.col("px"), "py2": F.col("py")}, True, walk.WIDTH).where("yaw2 IS NOT NULL")
    n = n.withColumn("dy", F.expr("CASE WHEN yaw2-yaw > pi() THEN yaw2-yaw-2*pi() WHEN yaw2-yaw < -pi() THEN yaw2-yaw+2*pi() ELSE yaw2-yaw END"))
    n = n.withColumn("f", F.explode(F.array(*[F.lit(v) for v in (0.0, 0.25, 0.5, 0.75)])))
    return n.select("scene_id", "frame", "f", R6(F.expr("yaw + dy*f")).alias("yaw"), R6(F.expr("px + (px2-px)*f")).alias("px"), R6(F.expr("py + (py2-py)*f")).alias("py"))


@query("frame_stride_trim", """SELECT scene_id, frame, (k-1)//7+1 AS out FROM (SELECT scene_id, frame, row_number() OVER (PARTITION BY scene_id ORDER BY frame) AS k FROM frames WHERE frame >= 20 AND frame < 470) q
 WHERE (k-1) % 7 = 0 AND (k-1)//7 < 50""", "frames")
def frame_stride_trim(t):
    """Every 7th frame of the trim [20, 470), counted from its start, at most 50 frames."""
    k = sequence.row_number(t.frames.where("frame >= 20 AND frame < 470").select("scene_id", "frame"), ["scene_id"], ["frame"], "k", walk.WIDTH)
    return k.where("(k - 1) % 7 = 0").select("scene_id", "frame", F.expr("(k - 1) div 7 + 1").alias("out")).where("out <= 50")


@query("auto_subsample", """WITH n AS (SELECT scene_id, count(*) AS n FROM walk GROUP BY 1), s AS (SELECT scene_id, n, CASE WHEN n > 250 THEN greatest(2, CAST(round_even(n/25e1, 0) AS BIGINT)) END AS stride FROM n)
 SELECT w.scene_id, w.frame, s.stride FROM (SELECT scene_id, frame, row_number() OVER (PARTITION BY scene_id ORDER BY frame) AS k FROM walk) w JOIN s ON s.scene_id=w.scene_id WHERE s.stride IS NULL OR (k-1) % s.stride = 0""", "walk")
def auto_subsample(t):
    n = t.walk.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"))
    stride = F.when(F.col("n") > 250, F.greatest(F.lit(2).cast("bigint"), F.bround(F.col("n") / 250.0).cast("bigint")))
    k = walk.dense_index(t.walk).join(n.select("scene_id", stride.alias("stride")), "scene_id")
    return k.where(F.col("stride").isNull() | ((F.col("k") - 1) % F.col("stride") == 0)).select("scene_id", "frame", "stride")


@query("even_pick", """WITH k AS (SELECT scene_id, frame, row_number() OVER (PARTITION BY scene_id ORDER BY frame)-1 AS k, count(*) OVER (PARTITION BY scene_id) AS n FROM walk)
 SELECT DISTINCT scene_id, frame FROM k JOIN (SELECT unnest(generate_series(0,24)) AS m) q ON k.k = CAST(round_even(m*(n-1)/24e0, 0) AS BIGINT) OR n <= 25""", "walk")
def even_pick(t):
    """25 evenly spaced frames per scene, halves to even."""
    n = t.walk.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"))
    picks = n.where("n > 25").select("scene_id", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("m"), "n").select(
        "scene_id", (F.bround(F.col("m") * (F.col("n") - 1) / 24.0).cast("bigint") + 1).alias("k")).distinct()
    k = walk.dense_index(t.walk)
    few = k.join(n.where("n <= 25"), "scene_id", "left_semi")
    return k.join(picks, ["scene_id", "k"], "left_semi").unionByName(few).select("scene_id", "frame")


@query("pick_hit", f"""WITH h AS (SELECT scene_id, user_id AS click, frame, sqrt((px-1e1-sin(user_id))*(px-1e1-sin(user_id))+(py-6e0-cos(user_id))*(py-6e0-cos(user_id)))*5e1 AS d FROM frames WHERE placed=1)
 SELECT scene_id, click, arg_min(frame, row(d, frame)) AS frame, {r6('min(d)')} AS pixels FROM h WHERE d < 30 GROUP BY 1,2""", "frames")
def pick_hit(t):
    """Clicks on the plan and the capture position nearest to each, within 30 pixels."""
    d = F.expr("sqrt((px-1e1-sin(user_id))*(px-1e1-sin(user_id))+(py-6e0-cos(user_id))*(py-6e0-cos(user_id)))*5e1")
    h = t.frames.where("placed = 1").select("scene_id", F.col("user_id").alias("click"), "frame", d.alias("d")).where("d < 30")
    return h.groupBy("scene_id", "click").agg(F.min_by("frame", F.struct("d", "frame")).alias("frame"), R6(F.min("d")).alias("pixels"))
