"""Registered queries over pixels, depth maps and observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundloom.functions.numeric import micro, rounded
from groundloom.operators import images, tiles, visibility
from groundloom.plans.cameras import out, r4
from groundloom.plans.catalog import query
from groundloom.plans.tables import view
from groundloom.plans.terrain import r6, r9

R6 = rounded

view("pixn", ("pixels",), """SELECT p.*, l.depth AS dl, r.depth AS dr, u.depth AS du, d.depth AS dd, l.g AS gl, r.g AS gr, u.g AS gu, d.g AS gd FROM pixels p
 LEFT JOIN pixels l ON l.scene_id=p.scene_id AND l.u=p.u-1 AND l.v=p.v LEFT JOIN pixels r ON r.scene_id=p.scene_id AND r.u=p.u+1 AND r.v=p.v
 LEFT JOIN pixels u ON u.scene_id=p.scene_id AND u.u=p.u AND u.v=p.v-1 LEFT JOIN pixels d ON d.scene_id=p.scene_id AND d.u=p.u AND d.v=p.v+1""")


@query("sharpness", f"""WITH l AS (SELECT scene_id, CAST(gl+gr+gu+gd-4*g AS BIGINT) AS l FROM pixn WHERE gl IS NOT NULL AND gr IS NOT NULL AND gu IS NOT NULL AND gd IS NOT NULL)
 SELECT scene_id, count(*) AS n, {r6('CAST(sum(l*l) AS DOUBLE)/count(*)-(CAST(sum(l) AS DOUBLE)/count(*))*(CAST(sum(l) AS DOUBLE)/count(*))')} AS sharpness FROM l GROUP BY 1""", "pixn")
def sharpness(t):
    return images.sharpness(t.pixels, "g").select("scene_id", "n", R6("sharpness").alias("sharpness"))


@query("prune_blurry", """WITH k AS (SELECT scene_id, frame, value, row_number() OVER (PARTITION BY scene_id ORDER BY value, frame) AS k, count(*) OVER (PARTITION BY scene_id) AS n FROM frames)
 SELECT scene_id, frame, n>=20 AND k<=floor(n*15e0/100) AS dropped FROM k""", "frames")
def prune_blurry(t):
    """The blurriest 15 % of each scene's frames."""
    return images.prune_blurry(t.frames.select("scene_id", "frame", "value"), ["scene_id"], "value", "frame", 15.0).select("scene_id", "frame", "dropped")


@query("depth_edges", f"""SELECT scene_id, u, v, {r6('greatest(abs(depth-coalesce(dl,depth)),abs(depth-coalesce(du,depth)))/greatest(depth,1e-6)')} AS step,
 greatest(abs(depth-coalesce(dl,depth)),abs(depth-coalesce(du,depth)))/greatest(depth,1e-6)<3e-2 AS keep FROM pixn""", "pixn")
def depth_edges(t):
    return images.depth_edges(t.pixels.select("scene_id", "u", "v", "depth"), parts=t.parts).select("scene_id", "u", "v", R6("step").alias("step"), "keep")


@query("depth_gradient", f"""WITH g AS (SELECT scene_id, u, v, coalesce((dr-dl)/2,dr-depth,depth-dl,0e0)*5e2/greatest(depth,1e-6) AS gx, coalesce((dd-du)/2,dd-depth,depth-du,0e0)*5e2/greatest(depth,1e-6) AS gy FROM pixn)
 SELECT scene_id, u, v, {r6('gx/sqrt(gx*gx+gy*gy+1)')} AS nx, {r6('gy/sqrt(gx*gx+gy*gy+1)')} AS ny, {r6('-1/sqrt(gx*gx+gy*gy+1)')} AS nz FROM g""", "pixn")
def depth_gradient(t):
    return out(images.depth_normals(t.pixels.select("scene_id", "u", "v", "depth"), 500.0, t.parts), ["scene_id", "u", "v"], nx="nx", ny="ny", nz="nz")


@query("unproject_depth", f"SELECT scene_id, u, v, {r6('(u-1e2)*depth/5e2')} AS x, {r6('(v-7e1)*depth/5e2')} AS y, {r6('depth')} AS z, {r6('depth*1/5e2*75e-2')} AS size FROM pixels WHERE depth>0", "pixels")
def unproject_depth(t):
    u = images.unproject(t.pixels.select("scene_id", "u", "v", "depth"), 500.0, 100.0, 70.0)
    return out(u, ["scene_id", "u", "v"], x="X", y="Y", z="Z", size="size")


PHOTO = """ph AS (SELECT scene_id, point_id, z, CAST(floor((x-1e1)/z*1e2/4+25e0+5e-1) AS BIGINT) AS j, CAST(floor((y-6e0)/z*1e2/4+15e0+5e-1) AS BIGINT) AS k FROM points WHERE z>1e-6),
 pin AS (SELECT * FROM ph WHERE j>=0 AND k>=0 AND j<50 AND k<30)"""


def photo(t):
    s = t.points.selectExpr("scene_id", "point_id AS splat_id", "x-1e1 AS X", "y-6e0 AS Y", "z AS Z")
    return images.photo_grid(s, 100.0, 200, 120, 4)


@query("photo_grid", """WITH p AS (SELECT scene_id, point_id, z, CAST(floor(((x-1e1)/z*1e2+1e2)/4+5e-1) AS BIGINT) AS j, CAST(floor(((y-6e0)/z*1e2+6e1)/4+5e-1) AS BIGINT) AS k FROM points WHERE z>1e-6)
 SELECT scene_id, k, j, floor(arg_min(z, point_id)*1e6+5e-1)/1e6 AS depth, count(*) AS hits FROM p WHERE j>=0 AND k>=0 AND j<50 AND k<30 GROUP BY 1,2,3""", "points")
def photo_grid(t):
    return photo(t)[0].select("scene_id", "k", "j", R6("depth").alias("depth"), "hits")


@query("photo_grid_counts", """WITH p AS (SELECT scene_id, CAST(floor(((x-1e1)/z*1e2+1e2)/4+5e-1) AS BIGINT) AS j, CAST(floor(((y-6e0)/z*1e2+6e1)/4+5e-1) AS BIGINT) AS k FROM points WHERE z>1e-6), q AS (SELECT *, j>=0 AND k>=0 AND j<50 AND k<30 AS ok FROM p)
 SELECT scene_id, count(*) FILTER (NOT ok) AS outside, count(DISTINCT row(k,j)) FILTER (ok) AS placed, count(*) FILTER (ok)-count(DISTINCT row(k,j)) FILTER (ok) AS collided FROM q GROUP BY 1""", "points")
def photo_grid_counts(t):
    return photo(t)[1]


@query("pixel_bars", """WITH b AS (SELECT scene_id, min(u) AS x, max(u)-min(u)+1 AS w, min(v) AS y, max(v)-min(v)+1 AS h FROM pixels WHERE g>100 AND b<256 AND r>150 GROUP BY 1),
 f AS (SELECT scene_id, max(u)-min(u)+1 AS fw, max(v)-min(v)+1 AS fh FROM pixels GROUP BY 1) SELECT b.scene_id, x, y, w, h, w*h<(1-8e-2)*fw*fh AS crop FROM b JOIN f ON f.scene_id=b.scene_id""", "pixels")
def pixel_bars(t):
    """Box of the picture (pixels over the fixture's luma rule) inside the frame, cropped when bars take 8 %."""
    lit = F.expr("g > 100 AND b < 256 AND r > 150")
    ends = lambda c, cond=None: (F.max(F.when(cond, F.col(c))) - F.min(F.when(cond, F.col(c))) + 1) if cond is not None else F.max(c) - F.min(c) + 1
    g = t.pixels.groupBy("scene_id").agg(F.min(F.when(lit, F.col("u"))).alias("x"), F.min(F.when(lit, F.col("v"))).alias("y"), ends("u", lit).alias("w"), ends("v", lit).alias("h"), ends("u").alias("fw"), ends("v").alias("fh"))
    return g.where("x IS NOT NULL").select("scene_id", "x", "y", "w", "h", F.expr("w*h < (1-8e-2)*fw*fh").alias("crop"))


BOXES = """bx AS (SELECT * FROM (SELECT scene_id, event_id AS box, frame, score, least(200,greatest(0,CAST(trunc(x+w/2-w*16e-1/2) AS INT))) AS x0, least(140,greatest(0,CAST(trunc(y+h/2-h*16e-1/2) AS INT))) AS y0,
 least(200,greatest(0,CAST(trunc(x+w/2-w*16e-1/2+w*16e-1) AS INT))) AS x1, least(140,greatest(0,CAST(trunc(y+h/2-h*16e-1/2+h*16e-1) AS INT))) AS y1 FROM detections) q WHERE x1>x0 AND y1>y0)"""


def boxes(t):
    return images.grown_boxes(t.detections.withColumnRenamed("event_id", "box"), 0.6, 200, 140)


@query("detection_boxes", f"WITH {BOXES} SELECT scene_id, box, x0, y0, x1, y1 FROM bx", "detections")
def detection_boxes(t):
    return boxes(t).select("scene_id", "box", "x0", "y0", "x1", "y1")


@query("detections_summary", """SELECT scene_id, 50 AS frames, count(*) AS faces, count(DISTINCT frame) AS frames_with_faces, floor(max(score)*1e3+5e-1)/1e3 AS best, floor(min(score)*1e3+5e-1)/1e3 AS worst FROM detections GROUP BY 1""", "detections")
def detections_summary(t):
    per_frame = t.detections.groupBy("scene_id", "frame").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("hi"), F.min("score").alias("lo"))
    return per_frame.groupBy("scene_id").agg(F.lit(50).alias("frames"), F.sum("n").alias("faces"), F.count(F.lit(1)).alias("frames_with_faces"), rounded(F.max("hi"), 3).alias("best"), rounded(F.min("lo"), 3).alias("worst"))


@query("block_mean_mask", f"""WITH {BOXES} SELECT b.scene_id, b.box, CAST(floor((u-x0)/16) AS BIGINT) AS bu, CAST(floor((v-y0)/16) AS BIGINT) AS bv, {r6('CAST(sum(CAST(floor(g*1e6+5e-1) AS BIGINT)) AS DOUBLE)/1e6/count(*)')} AS mean, count(*) AS pixels
 FROM bx b JOIN pixels p ON p.scene_id=b.scene_id AND u>=x0 AND v>=y0 AND u<x1 AND v<y1 GROUP BY 1,2,3,4""", "detections pixels")
def block_mean_mask(t):
    m = images.pixelate(t.pixels.select("scene_id", "u", "v", "g"), boxes(t), "g")
    return m.select("scene_id", "box", "bu", "bv", R6("mean").alias("mean"), "pixels")


OBS = """o AS (SELECT *, (x-px)*fx+(y-py)*fy+(z-pz)*fz AS depth FROM observations WHERE err<2 AND track>=3), od AS (SELECT * FROM o WHERE depth>0)"""


@query("observation_quality", f"WITH {OBS}, n AS (SELECT scene_id, frame, count(*) AS points FROM od GROUP BY 1,2 HAVING count(*)>=5) SELECT od.scene_id, od.frame, point_id, {r6('depth')} AS depth, points FROM od JOIN n ON n.scene_id=od.scene_id AND n.frame=od.frame", "observations")
def observation_quality(t):
    q = images.quality_observations(t.observations, min_points=5)
    return q.select("scene_id", "frame", "point_id", R6("depth").alias("depth"), "points")


@query("obs_to_points", "SELECT scene_id, frame, count(*) AS seen, count(*) FILTER (track>=3) AS solid FROM observations GROUP BY 1,2", "observations")
def obs_to_points(t):
    return t.observations.groupBy("scene_id", "frame").agg(F.count(F.lit(1)).alias("seen"), F.sum(F.when(F.col("track") >= 3, 1).otherwise(0)).alias("solid"))


SCORE = f"""WITH {OBS}, s AS (SELECT scene_id, frame, depth AS d, depth*(8e-1+err/5e0) AS p, 'model' AS model FROM od UNION ALL SELECT scene_id, frame, depth, 1e0, 'constant' FROM od),
 m AS (SELECT model, scene_id, frame, quantile_cont(d/p,5e-1) AS s, quantile_cont(p/d,5e-1)-1 AS metric, count(*) AS n FROM s WHERE p>1e-6 GROUP BY 1,2,3)
 SELECT s.model, s.scene_id, s.frame, {r6('any_value(m.s)')} AS s, {r6('CAST(sum(CAST(floor(abs(m.s*p-d)/d*1e6+5e-1) AS BIGINT)) AS DOUBLE)/1e6/count(*)')} AS absrel, {r6('count(*) FILTER (greatest(m.s*p/d,1/(m.s*p/d))<125e-2)/count(*)')} AS delta1,
 {r6('any_value(m.metric)')} AS metric, any_value(m.n) AS n FROM s JOIN m ON m.model=s.model AND m.scene_id=s.scene_id AND m.frame=s.frame WHERE p>1e-6 GROUP BY 1,2,3"""


@query("depth_score", SCORE, "observations")
def depth_score(t):
    """Per frame, a predicted depth and the constant-depth baseline."""
    o = images.quality_observations(t.observations, min_points=1)
    s = o.selectExpr("scene_id", "frame", "explode(array(struct('model' AS model, depth*(8e-1+err/5e0) AS p), struct('constant' AS model, 1e0 AS p))) AS e", "depth AS d").selectExpr("e.model", "scene_id", "frame", "d", "e.p")
    r = images.depth_scores(s, ["model", "scene_id", "frame"])
    return r.select("model", "scene_id", "frame", R6("s").alias("s"), R6("absrel").alias("absrel"), R6("delta1").alias("delta1"), R6("metric").alias("metric"), "n")


LOOK = """lk AS (SELECT scene_id, point_id, frame, err/4e0+1e-1 AS score, track>=3 AS seen, track>=2 AS inside, CAST(floor(abs(x)*12) AS INT) AS r, CAST(floor(abs(y)*15) AS INT) AS g, CAST(floor(err*6e1) AS INT) AS b FROM observations)"""


@query("texel_blend", f"""WITH {LOOK}, w AS (SELECT *, CASE WHEN seen THEN score*score ELSE 0e0 END AS w FROM lk), g AS (SELECT scene_id, point_id, CAST(sum(CAST(floor(w*1e6+5e-1) AS BIGINT)) AS DOUBLE)/1e6 AS s, {', '.join(f"CAST(sum(CAST(floor(w*{c}*1e6+5e-1) AS BIGINT)) AS DOUBLE)/1e6 AS s{c}, arg_max({c}, row(score,-frame)) FILTER (inside) AS f{c}" for c in 'rgb')} FROM w GROUP BY 1,2)
 SELECT scene_id, point_id, CASE WHEN s>0 THEN 'direct' WHEN fr IS NOT NULL THEN 'fallback' ELSE 'grey' END AS how, {', '.join(r6(f'CASE WHEN s>0 THEN s{c}/s ELSE coalesce(CAST(f{c} AS DOUBLE),128e0) END') + f' AS {c}' for c in 'rgb')} FROM g""", "observations")
def texel_blend(t):
    """Points as texels, their sightings as looks; a weak track is not seen, the weakest not even inside."""
    looks = t.observations.selectExpr("scene_id", "point_id", "frame", "err/4e0 + 1e-1 AS score", "track >= 3 AS seen", "track >= 2 AS inside",
                                      "CAST(floor(abs(x)*12) AS INT) AS r", "CAST(floor(abs(y)*15) AS INT) AS g", "CAST(floor(err*6e1) AS INT) AS b")
    return out(images.texel_blend(looks, ["scene_id", "point_id"], ["r", "g", "b"]), ["scene_id", "point_id", "how"], r="r", g="g", b="b")


COVER = """cov AS (SELECT scene_id, frame, CAST(floor(u/1e1) AS INT) AS u, CAST(floor(v/1e1) AS INT) AS v, arg_min(point_id % 4 <> 0, row(depth, point_id)) AS seen FROM seen GROUP BY 1,2,3,4),
 nb AS (SELECT scene_id, frame, u+a AS u, v+b AS v, CASE WHEN a=0 AND b=0 THEN CAST(seen AS INT) END AS own, CASE WHEN a<>0 OR b<>0 THEN CAST(seen AS INT) END AS nb FROM cov CROSS JOIN (VALUES (-1),(0),(1)) x(a) CROSS JOIN (VALUES (-1),(0),(1)) y(b)),
 gp AS (SELECT scene_id, frame, u, v, max(own) AS own, count(nb) AS nf, coalesce(sum(nb),0) AS ns FROM nb WHERE u BETWEEN 0 AND 63 AND v BETWEEN 0 AND 47 GROUP BY 1,2,3,4)"""


@query("coverage_share", f"WITH {COVER} SELECT scene_id, frame, CAST(sum(coalesce(own, CASE WHEN nf>=6 AND 2*ns>=nf THEN 1 ELSE 0 END)) AS BIGINT) AS seen_pixels, {r6('sum(coalesce(own, CASE WHEN nf>=6 AND 2*ns>=nf THEN 1 ELSE 0 END))/3072')} AS coverage FROM gp GROUP BY 1,2", "seen")
def coverage_share(t):
    """Every placed camera's frame at 64 x 48: a quarter of the surface (by id) counts as unseen but still hides."""
    p = t.points_wide.select("scene_id", "point_id", "x", "y", "z", (F.pmod("point_id", F.lit(4)) != 0).alias("seen"))
    c = visibility.coverage(p, t.cameras, 64, 48, tenths=True)
    return c.select("scene_id", "frame", "seen_pixels", R6("coverage").alias("coverage"))


def _photo_fill_sql() -> str:
    """Level-synchronous filling of the 30 x 50 photo grid as a recursive query (60 levels reach any cell)."""
    return f"""WITH RECURSIVE p AS (SELECT scene_id, point_id, z, CAST(floor(((x-1e1)/z*1e2+1e2)/4+5e-1) AS BIGINT) AS j, CAST(floor(((y-6e0)/z*1e2+6e1)/4+5e-1) AS BIGINT) AS k FROM points WHERE z>1e-6),
 g AS (SELECT scene_id, k, j, arg_min(z, point_id) AS z FROM p WHERE j>=0 AND k>=0 AND j<50 AND k<30 GROUP BY 1,2,3),
 a AS (SELECT s.scene_id, k, unnest(generate_series(0,49)) AS j FROM (SELECT scene_id, unnest(generate_series(0,29)) AS k FROM (SELECT DISTINCT scene_id FROM g) d) s),
 f_r AS (SELECT a.scene_id, a.k, a.j, g.z, 0 AS it FROM a LEFT JOIN g ON g.scene_id=a.scene_id AND g.k=a.k AND g.j=a.j UNION ALL
 SELECT scene_id, k, j, coalesce(max(z) FILTER (home), avg(z) FILTER (NOT home)), any_value(it) FROM (SELECT r.scene_id, r.k+x.a AS k, r.j+y.b AS j, z, x.a=0 AND y.b=0 AS home, it+1 AS it FROM f_r r
 CROSS JOIN (VALUES (-1),(0),(1)) x(a) CROSS JOIN (VALUES (-1),(0),(1)) y(b) WHERE it<60) q GROUP BY 1,2,3 HAVING bool_or(home))
 SELECT scene_id, k, j, {r9('z')} AS depth FROM f_r WHERE it=60"""


@query("photo_fill", _photo_fill_sql(), "points")
def photo_fill(t):
    """The photo grid made one sheet: every empty cell filled inward from the edges of its hole."""
    grid = photo(t)[0].select("scene_id", "k", "j", "depth")
    every = grid.select("scene_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(29).cast("bigint")))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(49).cast("bigint"))))
    cells = every.join(grid, ["scene_id", "k", "j"], "left").select("scene_id", F.col("k").alias("i"), "j", F.lit(30).cast("bigint").alias("ny"), F.lit(50).cast("bigint").alias("nx"), F.col("depth").alias("z"))
    full = tiles.rounds(cells, ["z"], tiles.fill_around)
    return full.select("scene_id", F.col("i").alias("k"), "j", rounded("z", 9).alias("depth"))
