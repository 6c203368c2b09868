"""Registered queries over camera poses, visibility and the sun."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundloom.functions import geometry as g, sun
from groundloom.functions.constants import WINDS
from groundloom.functions.numeric import modulo, rounded
from groundloom.operators import mesh, sequence, visibility
from groundloom.plans.catalog import query
from groundloom.plans.tables import view
from groundloom.plans.terrain import r6

R6 = rounded


def out(df, keys, **cols):
    return df.select(*keys, *[R6(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in cols.items()])


view("rot", ("poses",), """SELECT *, 1-2*(y*y+z*z) AS m00, 2*(x*y-w*z) AS m01, 2*(x*z+w*y) AS m02, 2*(x*y+w*z) AS m10, 1-2*(x*x+z*z) AS m11, 2*(y*z-w*x) AS m12,
 2*(x*z-w*y) AS m20, 2*(y*z+w*x) AS m21, 1-2*(x*x+y*y) AS m22 FROM (SELECT *, qw/n AS w, qx/n AS x, qy/n AS y, qz/n AS z FROM (SELECT *, sqrt(qw*qw+qx*qx+qy*qy+qz*qz) AS n FROM poses) a) b""")


def rotations(t):
    return g.with_rotation(t.poses)


@query("quat_to_matrix", f"SELECT scene_id, frame, {', '.join(r6(f'm{r}{c}') + f' AS m{r}{c}' for r in range(3) for c in range(3))} FROM rot", "rot")
def quat_to_matrix(t):
    return out(rotations(t), ["scene_id", "frame"], **{f"m{r}{c}": f"m{r}{c}" for r in range(3) for c in range(3)})


@query("camera_pose", f"""SELECT scene_id, frame, {r6('-(m00*tx+m10*ty+m20*tz)')} AS cx, {r6('m01*tx+m11*ty+m21*tz')} AS cy, {r6('m02*tx+m12*ty+m22*tz')} AS cz,
 {r6('m20')} AS dx, {r6('-m21')} AS dy, {r6('-m22')} AS dz, {r6('-m10')} AS ux, {r6('m11')} AS uy, {r6('m12')} AS uz, floor(degrees(2*atan(480/(2*5e2)))*1e3+5e-1)/1e3 AS fov_y FROM rot""", "rot")
def camera_pose(t):
    """Derived capture cameras in the viewer's frame (y and z flipped)."""
    r = rotations(t)
    c = g.camera_centre(("tx", "ty", "tz"))
    return out(r, ["scene_id", "frame"], cx=c[0], cy=-c[1], cz=-c[2], dx="m20", dy="-m21", dz="-m22", ux="-m10", uy="m11", uz="m12").withColumn(
        "fov_y", rounded(F.degrees(2 * F.atan(F.lit(480) / F.lit(1000.0))), 3))


@query("quat_from_matrix", f"""WITH n AS (SELECT *, sqrt(qw*qw+qx*qx+qy*qy+qz*qz) AS nn FROM poses) SELECT scene_id, frame, {', '.join(r6(f'abs(q{a})/nn') + f' AS a{a}' for a in 'wxyz')} FROM n""", "poses")
def quat_from_matrix(t):
    """Back from the matrix: equal to the normalised quaternion up to its sign."""
    r = rotations(t)
    m = [[F.col(f"m{a}{b}") for b in range(3)] for a in range(3)]
    q = g.quaternion(m)
    return out(r, ["scene_id", "frame"], **{f"a{n}": F.abs(c) for n, c in zip("wxyz", q)})


@query("quat_mul", f"""SELECT scene_id, frame, {r6('6e-1*qw-8e-1*qz')} AS w, {r6('6e-1*qx-8e-1*qy')} AS x, {r6('6e-1*qy+8e-1*qx')} AS y, {r6('6e-1*qz+8e-1*qw')} AS z FROM poses""", "poses")
def quat_mul(t):
    """A turn about z (w=0.6, z=0.8) applied before each pose."""
    q = g.quaternion_product([F.lit(0.6), F.lit(0.0), F.lit(0.0), F.lit(0.8)], [F.col(c) for c in ("qw", "qx", "qy", "qz")])
    return out(t.poses, ["scene_id", "frame"], **dict(zip("wxyz", q)))


@query("quat_from_normal", f"""WITH h AS (SELECT *, acos(least(1e0,greatest(-1e0,fz)))/2 AS h, sqrt(fx*fx+fy*fy) AS n FROM cameras)
 SELECT scene_id, frame, {r6('cos(h)')} AS w, {r6('-fy/n*sin(h)')} AS x, {r6('fx/n*sin(h)')} AS y, 0e0 AS z FROM h""", "cameras")
def quat_from_normal(t):
    q = g.quaternion_to(g.vec("fx", "fy", "fz"))
    return out(t.cameras, ["scene_id", "frame"], **dict(zip("wxyz", q)))


@query("heading_pitch_roll_fov", f"""SELECT scene_id, frame, {r6('degrees(atan2(fx,fy))-360*floor(degrees(atan2(fx,fy))/360)')} AS heading, {r6('degrees(asin(greatest(-1e0,least(1e0,fz))))')} AS pitch,
 {r6('degrees(asin(greatest(-1e0,least(1e0,-sz))))')} AS roll, {r6('focal*432666e-4/sqrt(CAST(width*width+height*height AS DOUBLE))')} AS focal_35mm, {r6('degrees(2*atan(width/(2*focal)))')} AS fov_h,
 {r6('degrees(2*atan(height/(2*focal)))')} AS fov_v FROM cameras""", "cameras")
def heading_pitch_roll_fov(t):
    heading = modulo(F.degrees(F.atan2("fx", "fy")), 360.0)
    return out(t.cameras, ["scene_id", "frame"], heading=heading, pitch="degrees(asin(greatest(-1e0, least(1e0, fz))))", roll="degrees(asin(greatest(-1e0, least(1e0, -sz))))",
               focal_35mm="focal * 432666e-4 / sqrt(CAST(width*width + height*height AS DOUBLE))", fov_h="degrees(2*atan(width/(2*focal)))", fov_v="degrees(2*atan(height/(2*focal)))")


@query("geo_offset", f"""WITH f AS (SELECT scene_id, arg_min(px, frame) AS x0, arg_min(py, frame) AS y0, arg_min(pz, frame) AS z0 FROM walk GROUP BY 1),
 l AS (SELECT w.*, x0, y0, z0, 475e-1+(py-y0)/11132e1 AS lat FROM walk w JOIN f ON f.scene_id=w.scene_id)
 SELECT scene_id, frame, floor(lat*1e9+5e-1)/1e9 AS lat, floor((19e0+(px-x0)/(11132e1*cos(radians(lat))))*1e9+5e-1)/1e9 AS lon, {r6('12e1+pz-z0')} AS alt FROM l""", "walk")
def geo_offset(t):
    """Latitude and longitude of each placed frame from the first one's fix."""
    first = t.walk.groupBy("scene_id").agg(*[F.min_by(c, "frame").alias(n) for n, c in (("x0", "px"), ("y0", "py"), ("z0", "pz"))])
    l = t.walk.join(first, "scene_id").withColumn("lat", F.expr("475e-1 + (py - y0) / 11132e1"))
    return l.select("scene_id", "frame", rounded("lat", 9).alias("lat"), rounded(F.expr("19e0 + (px - x0) / (11132e1 * cos(radians(lat)))"), 9).alias("lon"), R6(F.expr("12e1 + pz - z0")).alias("alt"))


@query("hemisphere_fix", """WITH s AS (SELECT scene_id, frame, CASE WHEN frame % 3 = 0 THEN -1 ELSE 1 END AS s, qw, qx, qy, qz FROM poses),
 d AS (SELECT *, CASE WHEN s*lag(s) OVER w*(qw*lag(qw) OVER w+qx*lag(qx) OVER w+qy*lag(qy) OVER w+qz*lag(qz) OVER w) < 0 THEN 1 ELSE 0 END AS flip FROM s WINDOW w AS (PARTITION BY scene_id ORDER BY frame))
 SELECT scene_id, frame, CAST(CASE WHEN sum(flip) OVER (PARTITION BY scene_id ORDER BY frame) % 2 = 1 THEN -1 ELSE 1 END AS INT) AS sign FROM d""", "poses")
def hemisphere_fix(t):
    """Sign that keeps consecutive quaternions (every third stored negated) on one hemisphere."""
    s = F.when(F.col("frame") % 3 == 0, -1.0).otherwise(1.0)
    p = t.poses.select("scene_id", "frame", *[(F.col(c) * s).alias(c) for c in ("qw", "qx", "qy", "qz")])
    n = sequence.neighbour(p, ["scene_id"], ["frame"], {"b" + c: F.col(c) for c in ("qw", "qx", "qy", "qz")}, False, 128)
    flip = F.when(sum((F.col("b" + c) * F.col(c) for c in ("qx", "qy", "qz")), F.col("bqw") * F.col("qw")) < 0, 1).otherwise(0)
    r = sequence.running_sum(n, ["scene_id"], ["frame"], flip, "flips", 128)
    return r.select("scene_id", "frame", F.when(F.col("flips") % 2 == 1, -1).otherwise(1).alias("sign"))


@query("rotation_to_z", f"""WITH u AS (SELECT scene_id, frame, -dx AS x, -dy AS y, -dz AS z FROM cameras)
 SELECT scene_id, frame, {r6('1-x*x/(1+z)')} AS m00, {r6('-x*y/(1+z)')} AS m01, {r6('-x')} AS m02, {r6('1-y*y/(1+z)')} AS m11, {r6('-y')} AS m12, {r6('1-(x*x+y*y)/(1+z)')} AS m22, 0e0 AS lift_x, 0e0 AS lift_y FROM u""", "cameras")
def rotation_to_z(t):
    """Rotation taking each camera's up onto +Z; lift_* show that up indeed lands on z."""
    c = t.cameras.selectExpr("scene_id", "frame", "-dx AS x", "-dy AS y", "-dz AS z")
    m = g.rotation_to_z(g.vec("x", "y", "z"))
    lift = [m[r][0] * F.col("x") + m[r][1] * F.col("y") + m[r][2] * F.col("z") for r in range(2)]
    o = out(c, ["scene_id", "frame"], m00=m[0][0], m01=m[0][1], m02=m[0][2], m11=m[1][1], m12=m[1][2], m22=m[2][2])
    return o.join(c.select("scene_id", "frame", *[F.abs(R6(x)).alias(n) for n, x in zip(("lift_x", "lift_y"), lift)]), ["scene_id", "frame"])


@query("easing", f"""WITH s AS (SELECT scene_id, frame, fx, fy, fz, (frame-1)/499e0 AS t FROM cameras) SELECT scene_id, frame, {r6('t*t*(3-2*t)')} AS ease,
 {r6('tan(asin(fz))/(2*tan(atan(480/(2*5e2))))')} AS shift FROM s""", "cameras")
def easing(t):
    """Smoothstep of the frame's place in the walk, and the lens shift that levels its view."""
    s = t.cameras.withColumn("t", F.expr("(frame - 1) / 499e0"))
    return out(s, ["scene_id", "frame"], ease="t*t*(3-2*t)", shift="tan(asin(fz)) / (2*tan(atan(480/(2*5e2))))")


@query("look_at", f"""WITH d AS (SELECT scene_id, frame, 1e1-px AS x, 6e0-py AS y, 5e0-pz AS z FROM walk), f AS (SELECT scene_id, frame, x/sqrt(x*x+y*y+z*z) AS fx, y/sqrt(x*x+y*y+z*z) AS fy, z/sqrt(x*x+y*y+z*z) AS fz FROM d),
 r AS (SELECT *, fy/sqrt(fx*fx+fy*fy) AS rx, -fx/sqrt(fx*fx+fy*fy) AS ry FROM f)
 SELECT scene_id, frame, {r6('fx')} AS fx, {r6('fy')} AS fy, {r6('fz')} AS fz, {r6('ry*fz')} AS ux, {r6('-rx*fz')} AS uy, {r6('rx*fy-ry*fx')} AS uz FROM r""", "walk")
def look_at(t):
    """Cameras turned to the middle of the site, image up as near to +Z as the view allows."""
    f = g.unit((F.lit(10.0) - F.col("px"), F.lit(6.0) - F.col("py"), F.lit(5.0) - F.col("pz")))
    w = t.walk.select("scene_id", "frame", *[c.alias(n) for c, n in zip(f, ("fx", "fy", "fz"))])
    fwd = g.vec("fx", "fy", "fz")
    side = g.cross(fwd, (F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    spare = g.cross(fwd, (F.lit(0.0), F.lit(1.0), F.lit(0.0)))  # straight up or down
    steep = g.length(side) < 1e-6
    right = g.unit(tuple(F.when(steep, s).otherwise(c) for s, c in zip(spare, side)))
    w = w.withColumns({f"r{a}": c for a, c in zip("xyz", right)})
    up = g.cross(g.vec("rx", "ry", "rz"), fwd)
    return out(w, ["scene_id", "frame"], fx="fx", fy="fy", fz="fz", ux=up[0], uy=up[1], uz=up[2])


@query("fov_resolve", f"""SELECT scene_id, frame, CASE WHEN user_id % 3 = 0 THEN 7e1 WHEN user_id % 3 = 1 THEN lens ELSE 65e0 END AS fov, CASE WHEN user_id % 3 = 0 THEN 'given' WHEN user_id % 3 = 1 THEN 'lens' ELSE 'assumed' END AS source,
 {r6('640*(2e1+user_id)/36e0')} AS focal_px FROM (SELECT *, floor(degrees(2*atan(sqrt(36e0*36e0+24e0*24e0)*640/8e2/(2*(2e1+user_id))))*1e1+5e-1)/1e1 AS lens FROM frames) q""", "frames")
def fov_resolve(t):
    """Field of view as given, else from the lens, else assumed; and the focal length in pixels."""
    f = t.frames.select("scene_id", "frame", F.expr("CASE WHEN user_id % 3 = 0 THEN 7e1 END").alias("given"), F.expr("2e1 + user_id").alias("f35"), F.expr("user_id % 3 <= 1").alias("has_lens"))
    lens = F.when(F.col("has_lens"), rounded(F.degrees(2 * F.atan(F.expr("sqrt(36e0*36e0+24e0*24e0)*640/8e2/(2*f35)"))), 1))
    source = F.when(F.col("given").isNotNull(), "given").when(F.col("has_lens"), "lens").otherwise("assumed")
    return f.select("scene_id", "frame", F.coalesce("given", lens, F.lit(65.0)).alias("fov"), source.alias("source"), R6(F.expr("640*f35/36e0")).alias("focal_px"))


# --- sun

SUN_SQL = """a AS (SELECT *, (ms/86400000+24405875e-1-2451545)/36525 AS t FROM src),
 b AS (SELECT *, l-360*floor(l/360) AS l0, 35752911e-5+t*(3599905029e-5-t*1537e-7) AS m, 16708634e-9-t*(42037e-9+t*1267e-10) AS e, 12504e-2-t*1934136e-3 AS om,
  23+(26+(21448e-3-t*(46815e-3+t*(59e-5-t*1813e-6)))/60)/60 AS ep0 FROM (SELECT *, 28046646e-5+t*(3600076983e-5+t*3032e-7) AS l FROM a) q),
 c AS (SELECT *, l0+sin(radians(m))*(1914602e-6-t*(4817e-6+t*14e-6))+sin(radians(m*2))*(19993e-6-t*101e-6)+sin(radians(m*3))*289e-6-569e-5-sin(radians(om))*478e-5 AS lam, ep0+cos(radians(om))*256e-5 AS eps FROM b),
 d AS (SELECT *, asin(sin(radians(eps))*sin(radians(lam))) AS decl, tan(radians(eps)/2)*tan(radians(eps)/2) AS y FROM c),
 f AS (SELECT *, degrees(y*sin(radians(l0*2))-e*sin(radians(m))*2+e*y*sin(radians(m))*cos(radians(l0*2))*4-y*y*sin(radians(l0*4))*5e-1-e*e*sin(radians(m*2))*125e-2)*4 AS eq FROM d),
 h AS (SELECT *, (tr-1440*floor(tr/1440))/4-180 AS ha FROM (SELECT *, ms/60000-1440*floor(ms/60000/1440)+eq+lon*4 AS tr FROM f) q),
 z AS (SELECT *, least(1e0,greatest(-1e0,sin(radians(lat))*sin(decl)+cos(radians(lat))*cos(decl)*cos(radians(ha)))) AS cz FROM h),
 y AS (SELECT *, degrees(acos(cz)) AS zen FROM z),
 x AS (SELECT *, 90-zen AS geometric, cos(radians(lat))*sin(radians(zen)) AS side FROM y),
 w AS (SELECT *, degrees(acos(least(1e0,greatest(-1e0,(sin(radians(lat))*cz-sin(decl))/side)))) AS az, tan(radians(geometric)) AS tg FROM x),
 sun AS (SELECT *, CASE WHEN abs(side)<1e-9 THEN CASE WHEN lat>0 THEN 18e1 ELSE 0e0 END WHEN ha>0 THEN (az+180)-360*floor((az+180)/360) ELSE (540-az)-360*floor((540-az)/360) END AS azimuth,
  geometric+CASE WHEN geometric>85 THEN 0e0 ELSE CASE WHEN geometric>5 THEN 581e-1/tg-7e-2/(tg*tg*tg)+86e-6/(tg*tg*tg*tg*tg) WHEN geometric>-575e-3 THEN 1735+geometric*(-5182e-1+geometric*(1034e-1+geometric*(-1279e-2+geometric*711e-3))) ELSE -20772e-3/tg END/3600 END AS elevation FROM w)"""
SUN_SRC = "src AS (SELECT event_id, CAST(epoch_us(ts)//1000 AS DOUBLE) AS ms, CAST(user_id AS DOUBLE)-7e1 AS lat, value-18e1 AS lon FROM events)"
DAY_SRC = "days AS (SELECT DISTINCT CAST(epoch_ms(date_trunc('day', ts)) AS DOUBLE) AS day_ms, CAST(user_id % 14 AS DOUBLE)*1e1-65e0 AS lat FROM events)"


def r4(c):
    return f"floor(({c})*1e4+5e-1)/1e4"


def r4s(c):
    return rounded(c, 4)


@query("sun_position", f"WITH {SUN_SRC}, {SUN_SQL} SELECT event_id, {r4('azimuth')} AS azimuth, {r4('elevation')} AS elevation, {r4('90-elevation')} AS zenith, {r4('geometric')} AS geometric FROM sun")
def sun_position(t):
    """The sun at every event's time, at a place made from its user and value."""
    e = t.raw("events").select("event_id", (F.unix_millis(F.col("ts").cast("timestamp"))).alias("ms"), F.expr("CAST(user_id AS DOUBLE) - 7e1").alias("lat"), F.expr("value - 18e1").alias("lon"))
    s = sun.with_sun(e, F.col("ms"), F.col("lat"), F.col("lon"))
    return s.select("event_id", r4s("azimuth").alias("azimuth"), r4s("elevation").alias("elevation"), r4s(90 - F.col("elevation")).alias("zenith"), r4s("geometric").alias("geometric"))


def sun_days(t):
    e = t.raw("events").select(F.unix_millis(F.date_trunc("day", F.col("ts").cast("timestamp"))).cast("double").alias("day_ms"), F.expr("CAST(user_id % 14 AS DOUBLE)*1e1-65e0").alias("lat"))
    return e.distinct().withColumn("lon", F.lit(19.0))


@query("sun_day_table", f"""WITH {DAY_SRC}, src AS (SELECT day_ms, lat, 19e0 AS lon, CAST(m*30 AS INT) AS minute, day_ms+m*1800000 AS ms FROM days CROSS JOIN (SELECT unnest(generate_series(0,47)) AS m) q), {SUN_SQL}
 SELECT day_ms, lat, minute, {r4('elevation')} AS elevation, {r4('azimuth')} AS azimuth, elevation > 0 AS above FROM sun""")
def sun_day_table(t):
    s = sun.day_table(sun_days(t), 30)
    return s.select("day_ms", "lat", "minute", r4s("elevation").alias("elevation"), r4s("azimuth").alias("azimuth"), (F.col("elevation") > 0).alias("above"))


@query("sunrise_sunset", f"""WITH {DAY_SRC}, src AS (SELECT day_ms, lat, 19e0 AS lon, CAST(m AS INT) AS minute, day_ms+m*60000 AS ms FROM days CROSS JOIN (SELECT unnest(generate_series(0,1440)) AS m) q), {SUN_SQL},
 l AS (SELECT *, geometric+833e-3 AS g, lag(geometric+833e-3) OVER (PARTITION BY day_ms, lat ORDER BY minute) AS p FROM sun)
 SELECT day_ms, lat, CAST(min(minute) FILTER (p<0 AND g>=0) AS DOUBLE) AS rise, CAST(min(minute) FILTER (p>=0 AND g<0) AS DOUBLE) AS sunset FROM l GROUP BY 1,2""")
def sunrise_sunset(t):
    r = sun.rise_and_set(sun_days(t), ["day_ms", "lat"])
    return r.select("day_ms", "lat", F.col("rise").cast("double").alias("rise"), F.col("sunset").cast("double").alias("sunset"))


@query("compass_bearing", f"""WITH b AS (SELECT scene_id, frame, px, py, fx, fy, degrees(atan2(fx,fy))-360*floor(degrees(atan2(fx,fy))/360) AS bearing, sqrt(fx*fx+fy*fy) AS h FROM cameras)
 SELECT scene_id, frame, {r6('bearing')} AS bearing, (['{"','".join(WINDS)}'])[CAST(floor(bearing/225e-1+5e-1) AS BIGINT)%16+1] AS wind,
 {r6('cos(radians(3e1))*sin(radians(bearing))')} AS sun_x, {r6('cos(radians(3e1))*cos(radians(bearing))')} AS sun_y, {r6('sin(radians(3e1))')} AS sun_z,
 {r6('0e0')} AS north_x, {r6('1e0')} AS north_y FROM b""", "cameras")
def compass_bearing(t):
    """Bearing of each view with +Y as north, its wind name, the sun vector at that bearing and 30 degrees
    up, and north found back from the view and its bearing."""
    zero, one = F.lit(0.0), F.lit(1.0)
    up, north = (zero, zero, one), (zero, one, zero)
    east = g.cross(north, up)
    h = g.level_part(g.vec("fx", "fy", "fz"), up)
    c = t.cameras.withColumn("bearing", modulo(F.degrees(F.atan2(g.dot(h, east), g.dot(h, north))), 360.0))
    names = F.array(*[F.lit(w) for w in WINDS])
    wind = F.element_at(names, (F.floor(F.col("bearing") / 22.5 + 0.5) % 16 + 1).cast("int"))
    el = F.lit(30.0)
    ce, ca, sa = F.cos(F.radians(el)), F.cos(F.radians("bearing")), F.sin(F.radians("bearing"))
    s = [ce * (ca * north[k] + sa * east[k]) + F.sin(F.radians(el)) * up[k] for k in range(3)]
    back = g.turn_about(h, up, F.col("bearing"))
    o = c.select("scene_id", "frame", R6("bearing").alias("bearing"), wind.alias("wind"), *[R6(x).alias(n) for n, x in zip(("sun_x", "sun_y", "sun_z", "north_x", "north_y"), [*s, *back[:2]])])
    return o.withColumn("north_x", F.abs("north_x"))


@query("north_from_shadow", f"""WITH r AS (SELECT point_id, 5e-1+r/1e3 AS x, g/1e3-1e-1 AS y, 1e0+b/1e2 AS z, CAST(g AS DOUBLE) AS az FROM points), n AS (SELECT *, sqrt(x*x+y*y+z*z) AS l, sqrt(x*x+y*y) AS h FROM r)
 SELECT point_id, {r6('degrees(asin(z/l))')} AS elevation, {r6('x/h*cos(radians(az))-y/h*sin(radians(az))')} AS nx, {r6('y/h*cos(radians(az))+x/h*sin(radians(az))')} AS ny FROM n""", "points")
def north_from_shadow(t):
    """A post's top against its shadow's tip, the sun's azimuth known: north and the measured elevation."""
    p = t.points.selectExpr("point_id", "5e-1 + r/1e3 AS x", "g/1e3 - 1e-1 AS y", "1e0 + b/1e2 AS z", "CAST(g AS DOUBLE) AS az")
    up = (F.lit(0.0), F.lit(0.0), F.lit(1.0))
    ray = g.unit(g.vec("x", "y", "z"))
    n = g.turn_about(g.level_part(ray, up), up, F.col("az"))
    return p.select("point_id", R6(F.degrees(F.asin(ray[2]))).alias("elevation"), R6(n[0]).alias("nx"), R6(n[1]).alias("ny"))


# --- visibility

view("seen", ("points", "cameras"), """SELECT * FROM (SELECT *, focal*rr/depth+width/2 AS u, focal*dd/depth+height/2 AS v FROM (
 SELECT p.scene_id, p.point_id, c.frame, c.focal, c.width, c.height, (x-px)*fx+(y-py)*fy+(z-pz)*fz AS depth, (x-px)*sx+(y-py)*sy+(z-pz)*sz AS rr, (x-px)*dx+(y-py)*dy+(z-pz)*dz AS dd
 FROM points p JOIN cameras c ON c.scene_id=p.scene_id) a WHERE depth > 0) b WHERE u>=0 AND v>=0 AND u<width AND v<height""")
view("zbuf", ("seen",), """SELECT scene_id, frame, iu+a AS iu, iv+b AS iv, min(depth) AS nearest FROM (SELECT scene_id, frame, least(CAST(floor(u/4) AS INT),159) AS iu, least(CAST(floor(v/4) AS INT),119) AS iv, min(depth) AS depth FROM seen GROUP BY 1,2,3,4) q
 CROSS JOIN (VALUES (-1),(0),(1)) x(a) CROSS JOIN (VALUES (-1),(0),(1)) y(b) WHERE iu+a BETWEEN 0 AND 159 AND iv+b BETWEEN 0 AND 119 GROUP BY 1,2,3,4""")


def pairs(t):
    p = t.points_wide.select("scene_id", "point_id", "x", "y", "z")
    return visibility.seen_pairs(p, t.cameras.drop("name"))


@query("frustum_filter", """SELECT scene_id, frame, count(*) AS points, floor(min(depth)*1e6+5e-1)/1e6 AS nearest, floor(max(depth)*1e6+5e-1)/1e6 AS farthest FROM seen
 WHERE u>=width*2e-2 AND v>=height*2e-2 AND u<width-width*2e-2 AND v<height-height*2e-2 GROUP BY 1,2""", "seen")
def frustum_filter(t):
    """Points inside each bordered frame."""
    return pairs(t).where(visibility.in_frame(visibility.BORDER)).groupBy("scene_id", "frame").agg(
        F.count(F.lit(1)).alias("points"), R6(F.min("depth")).alias("nearest"), R6(F.max("depth")).alias("farthest"))


@query("zbuffer", "SELECT scene_id, frame, count(*) AS pixels, CAST(sum(CAST(floor(nearest*1e4+5e-1) AS BIGINT)) AS BIGINT) AS depth_sum FROM zbuf GROUP BY 1,2", "zbuf")
def zbuffer(t):
    """Closed depth images, summed per frame."""
    return visibility.depth_sums(t.points_wide, t.cameras)


VISIBLE_SQL = """vis AS (SELECT s.* FROM seen s JOIN zbuf z ON z.scene_id=s.scene_id AND z.frame=s.frame AND z.iu=least(CAST(floor(u/4) AS INT),159) AND z.iv=least(CAST(floor(v/4) AS INT),119)
 WHERE u>=width*2e-2 AND v>=height*2e-2 AND u<width-width*2e-2 AND v<height-height*2e-2 AND depth<=nearest*(1+3e-2))"""


@query("visible_from", f"WITH {VISIBLE_SQL} SELECT scene_id, frame, count(*) AS visible, min(point_id) AS low_id, max(point_id) AS high_id FROM vis GROUP BY 1,2", "seen zbuf")
def visible_from(t):
    return visibility.visible_counts(t.points_wide, t.cameras)


view("fcent", ("corners",), """SELECT *, cxx/l AS nx, cyy/l AS ny, czz/l AS nz FROM (SELECT *, sqrt(cxx*cxx+cyy*cyy+czz*czz) AS l FROM (SELECT scene_id, fid, (xa+xb+xc)/3 AS x, (ya+yb+yc)/3 AS y, (za+zb+zc)/3 AS z,
 (yb-ya)*(zc-za)-(zb-za)*(yc-ya) AS cxx, (zb-za)*(xc-xa)-(xb-xa)*(zc-za) AS cyy, (xb-xa)*(yc-ya)-(yb-ya)*(xc-xa) AS czz FROM corners) q) r""")


def face_centres(t):
    c = mesh.with_normal(mesh.face_corners(t.faces, t.vertices))
    n = 2 * F.col("area")
    return c.select("scene_id", "fid", *[((F.col(a + "a") + F.col(a + "b") + F.col(a + "c")) / 3).alias(a) for a in "xyz"], *[(F.col("fn" + a) / n).alias("n" + a) for a in "xyz"])


@query("best_frames", f"""WITH s AS (SELECT f.scene_id, f.fid, c.frame, focal, width, height, x, y, z, px, py, pz, nx, ny, nz, (x-px)*fx+(y-py)*fy+(z-pz)*fz AS depth, (x-px)*sx+(y-py)*sy+(z-pz)*sz AS rr, (x-px)*dx+(y-py)*dy+(z-pz)*dz AS dd
 FROM fcent f JOIN cameras c ON c.scene_id=f.scene_id), u AS (SELECT *, focal*rr/depth+width/2 AS u, focal*dd/depth+height/2 AS v FROM s WHERE depth>0),
 w AS (SELECT u.*, abs((px-x)*nx+(py-y)*ny+(pz-z)*nz)/(sqrt((px-x)*(px-x)+(py-y)*(py-y)+(pz-z)*(pz-z))+1e-20) AS cosine FROM u JOIN zbuf b ON b.scene_id=u.scene_id AND b.frame=u.frame AND b.iu=least(CAST(floor(u/4) AS INT),159) AND b.iv=least(CAST(floor(v/4) AS INT),119)
 WHERE u>=width*2e-2 AND v>=height*2e-2 AND u<width-width*2e-2 AND v<height-height*2e-2 AND depth<=nearest*(1+3e-2)),
 r AS (SELECT *, cosine*(focal/depth)*(focal/depth) AS score FROM w WHERE cosine>1e-1)
 SELECT scene_id, fid, frame, CAST(rank AS INT) AS rank, floor(score*1e3+5e-1)/1e3 AS score FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, fid ORDER BY score DESC, frame) AS rank FROM r) q WHERE rank<=3""", "fcent cameras zbuf")
def best_frames(t):
    """The three best frames per face of the gridded mesh, hidden ones left out."""
    b = visibility.best_views(t.points_wide, face_centres(t), t.cameras)
    return b.select("scene_id", "fid", "frame", "rank", rounded("score", 3).alias("score"))
