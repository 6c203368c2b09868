"""Registered queries for iterative raster work."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundloom.functions.numeric import rounded
from groundloom.operators import cloth, raster, repair
from groundloom.plans.catalog import query
from groundloom.plans.meshes import face_marks, face_rules
from groundloom.plans.tables import CELL, view
from groundloom.plans.terrain import BLOCK_SQL, CLOSE_SQL, block_meta, r6, r9, roughness

OFF4 = "(VALUES (0,0),(-1,0),(1,0),(0,-1),(0,1)) o(di,dj)"
OFF8 = "(SELECT a.di, b.dj FROM (VALUES (-1),(0),(1)) a(di) CROSS JOIN (VALUES (-1),(0),(1)) b(dj)) o"

view("allcells", ("meta",), "SELECT scene_id, i, unnest(generate_series(0, nx-1)) AS j, ny, nx FROM (SELECT scene_id, unnest(generate_series(0, ny-1)) AS i, ny, nx FROM meta) q")
view("empties", ("allcells", "grid"), "SELECT a.* FROM allcells a LEFT JOIN grid g ON g.scene_id=a.scene_id AND g.i=a.i AND g.j=a.j WHERE g.i IS NULL")


def label_sql(name: str, src: str, off: str, its: int) -> str:
    """Min-label spreading as a recursive query: ``its`` synchronous sweeps."""
    return f"""{name}_r AS (SELECT scene_id, i, j, i*1048576+j AS l, 0 AS it FROM {src} UNION ALL
 SELECT scene_id, i, j, min(l), any_value(it) FROM (SELECT r.scene_id, r.i+di AS i, r.j+dj AS j, l, di=0 AND dj=0 AS home, it+1 AS it FROM {name}_r r CROSS JOIN {off} WHERE it<{its}) q GROUP BY 1,2,3 HAVING bool_or(home)),
 {name} AS (SELECT scene_id, i, j, l FROM {name}_r WHERE it={its})"""


@query("connected_components", f"WITH RECURSIVE {label_sql('lab', 'grid', OFF4, 200)} SELECT scene_id, i, j, l AS label FROM lab", "grid")
def connected_components(t):
    return repair.label(t.grid, t.meta)


HOLES = label_sql("hl", "empties", OFF4, 200) + """, inner_ AS (SELECT h.scene_id, h.i, h.j FROM hl h WHERE NOT EXISTS (SELECT 1 FROM hl o JOIN meta m ON m.scene_id=o.scene_id WHERE o.scene_id=h.scene_id AND o.l=h.l AND (o.i=0 OR o.j=0 OR o.i=m.ny-1 OR o.j=m.nx-1)))"""


@query("interior_holes", f"WITH RECURSIVE {HOLES} SELECT * FROM inner_", "empties meta")
def interior_holes(t):
    return repair.interior_holes(t.grid, t.meta)


@query("keep_main", f"""WITH RECURSIVE {label_sql('lab', 'quads', OFF4, 200)}, sz AS (SELECT scene_id, l, count(*) AS n FROM lab GROUP BY 1,2), mx AS (SELECT scene_id, max(n) AS m FROM sz GROUP BY 1),
 main_ AS (SELECT lab.scene_id, lab.i, lab.j FROM lab JOIN sz ON sz.scene_id=lab.scene_id AND sz.l=lab.l JOIN mx ON mx.scene_id=lab.scene_id WHERE n>=m*5e-2),
 rest AS (SELECT a.* FROM allcells a LEFT JOIN main_ g ON g.scene_id=a.scene_id AND g.i=a.i AND g.j=a.j WHERE g.i IS NULL), {label_sql('rl', 'rest', OFF4, 200)},
 edge AS (SELECT DISTINCT rl.scene_id, rl.l FROM rl JOIN meta m ON m.scene_id=rl.scene_id WHERE rl.i=0 OR rl.j=0 OR rl.i=m.ny-1 OR rl.j=m.nx-1),
 inn AS (SELECT rl.scene_id, rl.i, rl.j FROM rl LEFT JOIN edge e ON e.scene_id=rl.scene_id AND e.l=rl.l WHERE e.l IS NULL)
 SELECT * FROM main_ UNION ALL SELECT q.scene_id, q.i, q.j FROM quads q JOIN inn ON inn.scene_id=q.scene_id AND inn.i=q.i AND inn.j=q.j""", "quads allcells meta")
def keep_main(t):
    """Main patches of the quad footprint (sparser than the cells, so it has islands)."""
    return repair.keep_main(t.quads, t.meta).select("scene_id", "i", "j")


FILL = HOLES + f""", ff_r AS (SELECT scene_id, i, j, z, false AS hole, 0 AS it FROM grid UNION ALL SELECT scene_id, i, j, NULL, true, 0 FROM inner_
 UNION ALL SELECT scene_id, i, j, CASE WHEN max(z) FILTER (home) IS NULL AND bool_or(hole) FILTER (home) THEN avg(z) FILTER (NOT home) ELSE max(z) FILTER (home) END, bool_or(hole) FILTER (home), any_value(it) FROM (
 SELECT r.scene_id, r.i+di AS i, r.j+dj AS j, z, hole, di=0 AND dj=0 AS home, it+1 AS it FROM ff_r r CROSS JOIN {OFF4} WHERE it<30) q GROUP BY 1,2,3 HAVING bool_or(home)),
 rx_r AS (SELECT scene_id, i, j, z, hole, 0 AS it FROM ff_r WHERE it=30 UNION ALL
 SELECT scene_id, i, j, CASE WHEN bool_or(hole) FILTER (home) THEN avg(z) FILTER (NOT home) ELSE max(z) FILTER (home) END, bool_or(hole) FILTER (home), any_value(it) FROM (
 SELECT r.scene_id, r.i+di AS i, r.j+dj AS j, z, hole, di=0 AND dj=0 AS home, it+1 AS it FROM rx_r r CROSS JOIN {OFF4} WHERE it<200) q GROUP BY 1,2,3 HAVING bool_or(home))"""


@query("fill_interior", f"WITH RECURSIVE {FILL} SELECT scene_id, i, j, {r9('z')} AS z, hole AS filled FROM rx_r WHERE it=200", "empties grid meta")
def fill_interior(t):
    f = repair.fill_interior(t.grid, repair.interior_holes(t.grid, t.meta), t.meta)
    return f.select("scene_id", "i", "j", rounded("z", 9).alias("z"), "filled")


@query("hydro_fill", f"""WITH RECURSIVE rim AS (SELECT a.scene_id, a.i, a.j, any_value(a.z) AS z, count(b.i)<9 AS rim FROM grid a JOIN grid b ON b.scene_id=a.scene_id AND b.i BETWEEN a.i-1 AND a.i+1 AND b.j BETWEEN a.j-1 AND a.j+1 GROUP BY 1,2,3),
 w_r AS (SELECT scene_id, i, j, z, rim, CASE WHEN rim THEN z ELSE 'Infinity'::DOUBLE END AS w, 0 AS it FROM rim UNION ALL
 SELECT scene_id, i, j, max(z) FILTER (home), bool_or(rim) FILTER (home), CASE WHEN bool_or(rim) FILTER (home) THEN max(w) FILTER (home) ELSE least(max(w) FILTER (home), CASE WHEN max(z) FILTER (home)>min(w) FILTER (NOT home) THEN max(z) FILTER (home) ELSE min(w) FILTER (NOT home)+5e-6 END) END, any_value(it)
 FROM (SELECT r.scene_id, r.i+di AS i, r.j+dj AS j, z, rim, w, di=0 AND dj=0 AS home, it+1 AS it FROM w_r r CROSS JOIN {OFF8} WHERE it<120) q GROUP BY 1,2,3 HAVING bool_or(home))
 SELECT scene_id, i, j, {r6('w')} AS z, w>z+1e-9 AS raised FROM w_r WHERE it=120""", "grid")
def hydro_fill(t):
    return repair.drain(t.grid, t.meta, CELL).select("scene_id", "i", "j", rounded("z").alias("z"), "raised")


@query("cloth_ground", """WITH RECURSIVE fr AS (SELECT scene_id, x0, y0, CAST(ceil((y1-y0)/15e-1) AS BIGINT)+2 AS ny, CAST(ceil((x1-x0)/15e-1) AS BIGINT)+2 AS nx FROM extent),
 zz AS (SELECT scene_id, -max(z) AS lowest, -min(z)+15e-1 AS start, greatest((max(z)-min(z))/200,1e-6) AS dr FROM points GROUP BY 1),
 ev AS (SELECT scene_id, iy, unnest(generate_series(0,nx-1)) AS ix, ny, nx FROM (SELECT *, unnest(generate_series(0,ny-1)) AS iy FROM fr) q),
 fl AS (SELECT p.scene_id, CAST(floor((y-y0)/15e-1) AS BIGINT) AS iy, CAST(floor((x-x0)/15e-1) AS BIGINT) AS ix, max(-z) AS f FROM points p JOIN fr ON fr.scene_id=p.scene_id GROUP BY 1,2,3),
 c_r AS (SELECT e.scene_id, e.iy AS i, e.ix AS j, e.iy>0 AND e.iy<e.ny-1 AND e.ix>0 AND e.ix<e.nx-1 AS inn, coalesce(f, lowest) AS f, dr, start AS c, 0 AS it FROM ev e JOIN zz ON zz.scene_id=e.scene_id LEFT JOIN fl ON fl.scene_id=e.scene_id AND fl.iy=e.iy AND fl.ix=e.ix
 UNION ALL SELECT scene_id, i, j, bool_or(inn) FILTER (d=0), max(f) FILTER (d=0), max(dr) FILTER (d=0), CASE WHEN any_value(it) % 4 = 1 THEN greatest(max(c) FILTER (d=0)-max(dr) FILTER (d=0), max(f) FILTER (d=0))
 WHEN bool_or(inn) FILTER (d=0) THEN greatest(25e-2*(max(c) FILTER (d=1)+max(c) FILTER (d=2)+max(c) FILTER (d=3)+max(c) FILTER (d=4)), max(f) FILTER (d=0)) ELSE max(c) FILTER (d=0) END, any_value(it) FROM (
 SELECT r.scene_id, r.i+di AS i, r.j+dj AS j, inn, f, dr, c, d, it+1 AS it FROM c_r r CROSS JOIN (VALUES (0,0,0),(1,1,0),(2,-1,0),(3,0,1),(4,0,-1)) o(d,di,dj) WHERE it<1200) q GROUP BY 1,2,3 HAVING bool_or(d=0)),
 rest AS (SELECT * FROM c_r WHERE it=1200)
 SELECT p.scene_id, p.point_id, abs(-p.z-r.c)<=5e-1 AS ground FROM points p JOIN fr ON fr.scene_id=p.scene_id JOIN rest r ON r.scene_id=p.scene_id AND r.i=CAST(floor((p.y-y0)/15e-1) AS BIGINT) AND r.j=CAST(floor((p.x-x0)/15e-1) AS BIGINT)""", "points extent")
def cloth_ground(t):
    """Cloth of 1.5 units, 300 iterations of rigidness 3, half a unit of tolerance."""
    return cloth.classify(t.points.select("scene_id", "point_id", "x", "y", "z"), 1.5, 0.5).select("scene_id", "point_id", "ground")


@query("outlier_groups")
def outlier_groups(t):
    """Against a limit of nine tenths of a unit (three 0.3 cells)."""
    return repair.outlier_groups(t.grid, t.meta, 0.3)[0].select("scene_id", "i", "j", rounded("z").alias("z"))


@query("ground_with_surface")
def ground_with_surface(t):
    """Ground points' raster made whole inside the footprint of all points' raster."""
    ground = raster.rasterise_on(t.points.where("is_ground"), t.meta, CELL, 2).where("z IS NOT NULL").join(t.grid.select("scene_id", "i", "j"), ["scene_id", "i", "j"], "left_semi")
    return repair.ground_with_surface(ground, t.grid, t.meta, 0.1).select("scene_id", "i", "j", rounded("z").alias("z"), "kind")


def _unpinch_sql(rounds: int = 12) -> str:
    parts = ["p0 AS (SELECT * FROM quads)"]
    for k in range(rounds):
        parts.append(f"""a{k} AS (SELECT scene_id, i+a AS vi, j+b AS vj, bool_or(a=1 AND b=1) AS nw, bool_or(a=1 AND b=0) AS ne, bool_or(a=0 AND b=1) AS sw, bool_or(a=0 AND b=0) AS se FROM p{k} CROSS JOIN (VALUES (0),(1)) x(a) CROSS JOIN (VALUES (0),(1)) y(b) GROUP BY 1,2,3)""")
        parts.append(f"""p{k + 1} AS (SELECT q.* FROM p{k} q WHERE NOT EXISTS (SELECT 1 FROM a{k} v WHERE v.scene_id=q.scene_id AND v.vi=q.i AND v.vj=q.j AND nw AND se AND NOT ne AND NOT sw) AND NOT EXISTS (SELECT 1 FROM a{k} v WHERE v.scene_id=q.scene_id AND v.vi=q.i AND v.vj-1=q.j AND ne AND sw AND NOT nw AND NOT se))""")
    return "WITH " + ", ".join(parts) + f" SELECT scene_id, i, j FROM p{rounds}"


@query("quad_unpinch", _unpinch_sql(), "quads")
def quad_unpinch(t):
    return repair.unpinch(t.quads, t.parts).select("scene_id", "i", "j")


@query("mesh_faces", f"""WITH RECURSIVE {BLOCK_SQL}, {CLOSE_SQL}, {label_sql('lab', 'closed', OFF8, 200)}, region AS (SELECT scene_id, l, count(*) AS n FROM lab GROUP BY 1,2),
 drawn AS (SELECT lab.scene_id, lab.i AS bi, lab.j AS bj, true AS mesh FROM lab JOIN region g ON g.scene_id=lab.scene_id AND g.l=lab.l WHERE g.n >= 12), {face_rules('drawn', '8e0')}
 SELECT scene_id, fid, in_block, on_ground, seen, whole, in_block AND on_ground AND seen AND whole AS kept FROM r""", "points meta grid fgeo")
def mesh_faces(t):
    """Every face with the rules it passes: blocks closed, regions of under twelve dropped, edges of at most eight medians."""
    mask = roughness(t).where("mesh").select("scene_id", F.col("bi").alias("i"), F.col("bj").alias("j"))
    blocks = repair.mesh_blocks(mask, block_meta(t))
    return repair.keep_faces(face_marks(t), blocks, t.grid, t.meta, CELL)
