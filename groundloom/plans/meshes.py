"""Registered queries over triangle meshes."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundloom.functions.numeric import micro, rounded
from groundloom.operators import mesh, raster, scene_faces, terrain
from groundloom.operators.order_stats import quantiles
from groundloom.plans.catalog import query
from groundloom.plans.cameras import out
from groundloom.plans.tables import CELL, MIN_POINTS, view
from groundloom.plans.terrain import BLOCK_SQL, r6, r9, roughness
from groundloom.session import cut_lineage

R6 = rounded

view("fgeo", ("corners",), """SELECT *, 5e-1*sqrt(nx*nx+ny*ny+nz*nz) AS area, greatest(sqrt((xb-xa)*(xb-xa)+(yb-ya)*(yb-ya)+(zb-za)*(zb-za)),sqrt((xc-xb)*(xc-xb)+(yc-yb)*(yc-yb)+(zc-zb)*(zc-zb)),sqrt((xa-xc)*(xa-xc)+(ya-yc)*(ya-yc)+(za-zc)*(za-zc))) AS longest
 FROM (SELECT *, (yb-ya)*(zc-za)-(zb-za)*(yc-ya) AS nx, (zb-za)*(xc-xa)-(xb-xa)*(zc-za) AS ny, (xb-xa)*(yc-ya)-(yb-ya)*(xc-xa) AS nz FROM corners) q""")
PAINT = "painted AS (SELECT scene_id, (CAST(floor((y1-y)/5e-1) AS BIGINT)*1048576+CAST(floor((x-x0)/5e-1) AS BIGINT))*2+point_id%2 AS fid, avg(CASE WHEN opacity_logit>=0 THEN 1e0 ELSE 0e0 END) AS share FROM (SELECT p.*, m.x0, m.y1 FROM points p JOIN meta m ON m.scene_id=p.scene_id) q GROUP BY 1,2)"


def texels(t):
    """Every point as a texel of one of its cell's two triangles; the opaque ones were painted from a frame."""
    at = t.points.join(t.meta, "scene_id")
    fid = F.expr("(CAST(floor((y1-y)/5e-1) AS BIGINT)*1048576 + CAST(floor((x-x0)/5e-1) AS BIGINT))*2 + point_id % 2")
    return at.select("scene_id", fid.alias("fid"), (F.col("opacity_logit") >= 0).alias("direct"))


def painted_share(t):
    """Share of a face's texels painted directly; faces without texels count 0."""
    s = texels(t).groupBy("scene_id", "fid").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("direct").cast("int")).alias("_d"))
    f = t.faces.select("scene_id", "fid").join(s, ["scene_id", "fid"], "left")
    return f.select("scene_id", "fid", F.coalesce(F.col("_d") / F.col("_n"), F.lit(0.0)).alias("share"))


def geometry(t):
    return mesh.with_normal(mesh.face_corners(t.faces, t.vertices))


@query("face_vertices", f"SELECT scene_id, fid, {', '.join(r9(c) + f' AS {c}' for c in ('xa', 'ya', 'za', 'xb', 'yb', 'zb', 'xc', 'yc', 'zc'))} FROM corners", "corners")
def face_vertices(t):
    return mesh.face_corners(t.faces, t.vertices).select("scene_id", "fid", *[rounded(c, 9).alias(c) for c in ("xa", "ya", "za", "xb", "yb", "zb", "xc", "yc", "zc")])


@query("face_painted_share", f"WITH {PAINT} SELECT f.scene_id, f.fid, {r9('coalesce(p.share,0e0)')} AS share FROM faces f LEFT JOIN painted p ON p.scene_id=f.scene_id AND p.fid=f.fid", "faces points meta")
def face_painted_share(t):
    return painted_share(t).select("scene_id", "fid", rounded("share", 9).alias("share"))


@query("mesh_quality", f"""WITH {PAINT}, m AS (SELECT scene_id, quantile_cont(longest,5e-1) AS med FROM fgeo GROUP BY 1),
 k AS (SELECT g.scene_id, g.area, longest>11e-1*med AS shard, coalesce(share,0e0)<5e-1 AS unpainted, med FROM fgeo g JOIN m ON m.scene_id=g.scene_id LEFT JOIN painted p ON p.scene_id=g.scene_id AND p.fid=g.fid)
 SELECT scene_id, count(*) AS faces, {r6('max(med)')} AS median_edge, count(*) FILTER (shard) AS shards, count(*) FILTER (unpainted) AS unpainted, {r6('count(*) FILTER (shard OR unpainted)/count(*)')} AS left_out_count,
 {r6('CAST(sum(CASE WHEN shard OR unpainted THEN CAST(floor(area*1e6+5e-1) AS BIGINT) ELSE 0 END) AS DOUBLE)/1e6/(CAST(sum(CAST(floor(area*1e6+5e-1) AS BIGINT)) AS DOUBLE)/1e6)')} AS left_out_area FROM k GROUP BY 1""", "fgeo points meta")
def mesh_quality(t):
    """Shards (longest edge over 1.1 medians here) and unpainted faces, by count and by area."""
    g = geometry(t).select("scene_id", "fid", "area", "longest")
    med = quantiles(g, ["scene_id"], "longest", {"med": 0.5})
    k = g.join(med, "scene_id").join(painted_share(t), ["scene_id", "fid"])
    k = k.select("scene_id", "area", "med", (F.col("longest") > 1.1 * F.col("med")).alias("shard"), (F.col("share") < 0.5).alias("unpainted")).withColumn("out", F.col("shard") | F.col("unpainted"))
    n = lambda c: F.sum(F.col(c).cast("bigint"))
    area = lambda c: F.sum(c).cast("double") / 1e6
    return k.groupBy("scene_id").agg(F.count(F.lit(1)).alias("faces"), R6(F.max("med")).alias("median_edge"), n("shard").alias("shards"), n("unpainted").alias("unpainted"),
                                     R6(n("out") / F.count(F.lit(1))).alias("left_out_count"),
                                     R6(area(F.when(F.col("out"), micro("area")).otherwise(0)) / area(micro("area"))).alias("left_out_area"))


@query("vertex_normals", f"""WITH e AS (SELECT scene_id, unnest([a,b,c]) AS vid, nx, ny, nz FROM fgeo), s AS (SELECT scene_id, vid, {', '.join(f'CAST(sum(CAST(floor({c}*1e6+5e-1) AS BIGINT)) AS DOUBLE)/1e6 AS {c}' for c in ('nx', 'ny', 'nz'))} FROM e GROUP BY 1,2)
 SELECT scene_id, vid, {', '.join(r6(f'{c}/(sqrt(nx*nx+ny*ny+nz*nz)+1e-20)') + f' AS {c}' for c in ('nx', 'ny', 'nz'))} FROM s""", "fgeo")
def vertex_normals(t):
    return out(mesh.vertex_normals(mesh.face_corners(t.faces, t.vertices), t.faces), ["scene_id", "vid"], nx="nx", ny="ny", nz="nz")


WALLS = """q AS (SELECT scene_id, (i+1)*1048576+j AS p, (i+1)*1048576+j+1 AS q, i*1048576+j+1 AS r, i*1048576+j AS s FROM quads),
 e AS (SELECT scene_id, p AS a, q AS b FROM q UNION ALL SELECT scene_id, q, r FROM q UNION ALL SELECT scene_id, r, s FROM q UNION ALL SELECT scene_id, s, p FROM q),
 rim AS (SELECT e.* FROM e WHERE NOT EXISTS (SELECT 1 FROM e o WHERE o.scene_id=e.scene_id AND o.a=e.b AND o.b=e.a)),
 solid AS (SELECT scene_id, p, q, r, s, 'top' AS part FROM q UNION ALL SELECT scene_id, -s-1, -r-1, -q-1, -p-1, 'base' FROM q UNION ALL SELECT scene_id, a, -a-1, -b-1, b, 'wall' FROM rim)"""


@query("solid_walls", f"WITH {WALLS} SELECT * FROM solid", "quads")
def solid_walls(t):
    return mesh.solid_quads(t.quads, t.parts)


@query("closed_solid", f"""WITH {WALLS}, tri AS (SELECT scene_id, p AS a, q AS b, r AS c FROM solid UNION ALL SELECT scene_id, p, r, s FROM solid), d AS (SELECT scene_id, a, b FROM tri UNION ALL SELECT scene_id, b, c FROM tri UNION ALL SELECT scene_id, c, a FROM tri),
 g AS (SELECT scene_id, least(a,b) AS lo, greatest(a,b) AS hi, count(*) FILTER (a<b) AS up, count(*) FILTER (a>b) AS down FROM d GROUP BY 1,2,3), c AS (SELECT scene_id, bool_and(up=1 AND down=1) AS closed, count(*) AS edges FROM g GROUP BY 1),
 vv AS (SELECT scene_id, vid, x, y, z, vk FROM vkeys UNION ALL SELECT scene_id, -vid-1, x, y, -5e0, CAST(scene_id AS BIGINT)*1099511627776-vid-1 FROM vkeys),
 t AS (SELECT t.scene_id, A.x*(B.y*C.z-B.z*C.y)+A.y*(B.z*C.x-B.x*C.z)+A.z*(B.x*C.y-B.y*C.x) AS v FROM (SELECT *, CAST(scene_id AS BIGINT)*1099511627776 AS base FROM tri) t JOIN vv A ON A.vk=t.base+t.a JOIN vv B ON B.vk=t.base+t.b JOIN vv C ON C.vk=t.base+t.c)
 SELECT c.scene_id, closed, edges, floor(CAST(v AS DOUBLE)/1e6/6*1e4+5e-1)/1e4 AS volume FROM c JOIN (SELECT scene_id, sum(CAST(floor(v*1e6+5e-1) AS BIGINT)) AS v FROM t GROUP BY 1) s ON s.scene_id=c.scene_id""", "quads vkeys")
def closed_solid(t):
    """The gridded mesh closed by a flat base at -5: is it watertight, and its volume (corner-touching quads not
    thinned here, so scenes that have any are reported open)."""
    tri = mesh.quads_to_triangles(mesh.solid_quads(t.quads, t.parts))
    v = t.vertices
    both = v.unionByName(v.withColumn("vid", -F.col("vid") - 1).withColumn("z", F.lit(-5.0)))
    fid = F.monotonically_increasing_id()
    faces = cut_lineage(tri.select("scene_id", fid.alias("fid"), "a", "b", "c"))
    vol = mesh.face_corners(faces, both, t.parts).groupBy("scene_id").agg(mesh.signed_volume().alias("v"))
    return mesh.closed_check(faces, t.parts).join(vol, "scene_id").select("scene_id", "closed", "edges", rounded("v", 4).alias("volume"))


def face_rules(blocks: str, shard: str) -> str:
    """CTEs up to r: every face with the rules it passes; ``blocks`` has scene_id, bi, bj, mesh."""
    return f"""{PAINT}, med AS (SELECT scene_id, quantile_cont(longest,5e-1) AS med FROM fgeo GROUP BY 1),
 c AS (SELECT g.scene_id, g.fid, (xa+xb+xc)/3 AS x, (ya+yb+yc)/3 AS y, (za+zb+zc)/3 AS z, area, longest<={shard}*med AS whole, coalesce(share,0e0)>=5e-1 AS seen FROM fgeo g JOIN med ON med.scene_id=g.scene_id LEFT JOIN painted p ON p.scene_id=g.scene_id AND p.fid=g.fid),
 d AS (SELECT c.*, CAST(floor((m.y1-y)/1e0) AS BIGINT) AS bi, CAST(floor((x-m.x0)/1e0) AS BIGINT) AS bj, least(greatest(CAST(floor((x-m.x0)/5e-1-5e-1) AS BIGINT),0),nx-2) AS gj, least(greatest(CAST(floor((m.y1-y)/5e-1-5e-1) AS BIGINT),0),ny-2) AS gi,
 (x-m.x0)/5e-1-5e-1 AS fx, (m.y1-y)/5e-1-5e-1 AS fy FROM c JOIN meta m ON m.scene_id=c.scene_id),
 e AS (SELECT d.*, coalesce(k.mesh,false) AS in_block, a.z*(1-(fx-gj))*(1-(fy-gi))+b.z*(fx-gj)*(1-(fy-gi))+h.z*(1-(fx-gj))*(fy-gi)+f.z*(fx-gj)*(fy-gi) AS ground FROM d LEFT JOIN {blocks} k ON k.scene_id=d.scene_id AND k.bi=d.bi AND k.bj=d.bj
 LEFT JOIN grid a ON a.scene_id=d.scene_id AND a.i=gi AND a.j=gj LEFT JOIN grid b ON b.scene_id=d.scene_id AND b.i=gi AND b.j=gj+1 LEFT JOIN grid h ON h.scene_id=d.scene_id AND h.i=gi+1 AND h.j=gj LEFT JOIN grid f ON f.scene_id=d.scene_id AND f.i=gi+1 AND f.j=gj+1),
 r AS (SELECT *, coalesce(abs(z-ground)<=75e-2,false) AS on_ground FROM e)"""


def face_marks(t):
    """Centre, longest edge and painted share of every face."""
    g = geometry(t).select("scene_id", "fid", "longest", *[((F.col(a + "a") + F.col(a + "b") + F.col(a + "c")) / 3).alias(a) for a in "xyz"])
    return g.join(painted_share(t), ["scene_id", "fid"])


@query("keep_as_mesh", f"""WITH {BLOCK_SQL}, {face_rules('meshed', '11e-1')}
 SELECT scene_id, count(*) AS faces, count(*) FILTER (in_block AND on_ground AND seen AND whole) AS kept, count(*) FILTER (NOT on_ground) AS not_on_ground, count(*) FILTER (NOT in_block) AS not_in_block, count(*) FILTER (NOT seen) AS not_seen, count(*) FILTER (NOT whole) AS shards FROM r GROUP BY 1""", "points meta grid fgeo")
def keep_as_mesh(t):
    """Faces kept as mesh, and how many fail each rule. Scenes are judged in groups; those with more points than a group takes, on tables."""
    large = cut_lineage(scene_faces.large_scenes(t.points))
    if large.isEmpty():
        return scene_faces.counts(t.points, MESH_RULES, t.parts)
    small = scene_faces.counts(t.points.join(large, "scene_id", "left_anti"), MESH_RULES, t.parts)
    return small.unionByName(kept_on_tables(t.only(large)))


#: The limits of ``roughness`` and of the faces, as in the SQL.
MESH_RULES = scene_faces.Rules(CELL, min_points=MIN_POINTS, shard=1.1, rough=0.6, above=0.5, min_ground=4)


def kept_on_tables(t):
    g = geometry(t)
    med = quantiles(g.select("scene_id", "longest"), ["scene_id"], "longest", {"med": 0.5})
    c = g.select("scene_id", "fid", "longest", *[((F.col(a + "a") + F.col(a + "b") + F.col(a + "c")) / 3).alias(a) for a in "xyz"])
    c = raster.bilinear(c, t.grid, t.meta, CELL).join(med, "scene_id").join(painted_share(t), ["scene_id", "fid"])
    blocks = roughness(t).where("mesh").select("scene_id", "bi", "bj", F.lit(True).alias("in_block"))
    c = terrain.block_of(c, t.meta, 2 * CELL).join(blocks, ["scene_id", "bi", "bj"], "left")
    rules = c.select("scene_id", F.coalesce(F.abs(F.col("z") - F.col("ground")) <= 1.5 * CELL, F.lit(False)).alias("on_ground"), F.coalesce("in_block", F.lit(False)).alias("in_block"),
                     (F.col("share") >= 0.5).alias("seen"), (F.col("longest") <= 1.1 * F.col("med")).alias("whole"))
    n = lambda e: F.sum(F.when(e, 1).otherwise(0))
    ok = F.col("in_block") & F.col("on_ground") & F.col("seen") & F.col("whole")
    return rules.groupBy("scene_id").agg(F.count(F.lit(1)).alias("faces"), n(ok).alias("kept"), n(~F.col("on_ground")).alias("not_on_ground"), n(~F.col("in_block")).alias("not_in_block"),
                                         n(~F.col("seen")).alias("not_seen"), n(~F.col("whole")).alias("shards"))


@query("surface_samples")
def surface_samples(t):
    """About sixteen hash-drawn points per square unit of the gridded mesh, each on its own face."""
    return mesh.sample_surface(geometry(t), 16.0).select("scene_id", "fid", "k", R6("x").alias("x"), R6("y").alias("y"), R6("z").alias("z"))
