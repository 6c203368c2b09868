"""Scan tables derived from the driver's parquet tables, and the same definitions as SQL.

``Tables`` gives each input as a lazy DataFrame. ``VIEWS`` holds the equal SQL for the oracle.
Scenes, frames and jobs are cut from keys that grow with the data, so more data means more
scenes rather than denser ones.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from groundloom.operators import raster
from groundloom.session import in_parts

CELL = 0.5
MIN_POINTS = 2
PART_POINTS = 250_000

PARQUET = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

POINT_EXPRS = [
    "CAST(floor(l_suppkey / 5) AS INT) AS scene_id",
    "CAST(l_partkey % 200 AS DOUBLE) / 1e1 + l_discount AS x",
    "CAST(l_orderkey % 140 AS DOUBLE) / 1e1 + l_tax AS y",
    "2e0 + 3e-1 * (CAST(l_partkey % 200 AS DOUBLE) / 1e1 + l_discount)"
    " - 2e-1 * (CAST(l_orderkey % 140 AS DOUBLE) / 1e1 + l_tax)"
    " + CASE WHEN l_returnflag = 'R' THEN 5e-1 + l_quantity / 25e0 ELSE l_tax END AS z",
    "(l_quantity - 25e0) / 5e0 AS opacity_logit",
    "-2e0 - l_discount * 2e1 AS ls0",
    "-3e0 + l_tax * 1e1 AS ls1",
    "-4e0 AS ls2",
    "CAST(l_quantity * 5e0 AS INT) AS r",
    "CAST(l_linenumber * 36 AS INT) AS g",
    "CAST(l_suppkey % 256 AS INT) AS b",
    "l_returnflag <> 'R' AS is_ground",
]

FRAME_EXPRS = [
    "event_id",
    "CAST(floor(event_id / 500) AS INT) AS scene_id",
    "event_id % 500 + 1 AS frame",
    "concat('frame_', lpad(CAST(event_id % 500 + 1 AS STRING), 5, '0'), '.jpg') AS name",
    "CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS on_disk",
    "CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 1 ELSE 0 END AS placed",
    "2e0 + CAST(abs(event_id % 500 - 249) AS DOUBLE) * 64e-3 AS px",
    "2e0 + CAST(event_id % 500 + 1 AS DOUBLE) * 2e-2 AS py",
    "value",
    "user_id",
    "ts",
]

LOG_LINE = """CASE event_type
 WHEN 'click' THEN concat('    ~ progress ', CAST(line_no AS STRING), '/', CAST(line_no + 50 AS STRING), ' frames placed')
 WHEN 'view' THEN concat('[', CAST(1 + line_no % 5 AS STRING), '/5] ', CASE line_no % 5 WHEN 0 THEN 'frames' WHEN 1 THEN 'prune' WHEN 2 THEN 'poses' WHEN 3 THEN 'train' ELSE 'place' END)
 WHEN 'signup' THEN concat('    scored 9 in 1s; dropped 3, kept ', CAST(40 + line_no % 9 AS STRING))
 WHEN 'purchase' THEN '    WARNING: only a few frames placed'
 ELSE 'FAILED: only 2 of 118 frames could be placed' END AS line"""

# the viewing direction of a fixture camera: along the walk, tilted down by the event's value
DIR = {
    "rx": "CASE WHEN frame < 250 THEN -64e-3 ELSE 64e-3 END",
    "ry": "2e-2",
    "rz": "-2e-2 - value / 2e4",
}


class Tables:
    """The inputs of one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def only(self, scenes: DataFrame) -> Tables:
        """The same tables with the points of some scenes (scene_id)."""
        t = Tables(self.spark, self.folder)
        t.points = self.points.join(scenes, "scene_id", "left_semi")
        return t

    @cached_property
    def parts(self) -> int:
        """Partitions of what is grouped cell by cell: as many as hold ``PART_POINTS`` points each."""
        return max(self.spark.sparkContext.defaultParallelism, -(-self.raw("lineitem").count() // PART_POINTS))

    @cached_property
    def points(self) -> DataFrame:
        li = self.raw("lineitem")
        text = F.concat_ws(
            "|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")],
            F.col("l_quantity").cast("bigint").cast("string"),
        )
        point_id = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint").alias("point_id")
        return li.select(point_id, *[F.expr(e) for e in POINT_EXPRS])

    @cached_property
    def points_wide(self) -> DataFrame:
        return self.points

    @cached_property
    def frames(self) -> DataFrame:
        base = self.raw("events").select("event_type", *[F.expr(e) for e in FRAME_EXPRS])
        return base.withColumn("pz", F.expr("36e-1 + 3e-1 * px - 2e-1 * py + value / 1e3"))

    @cached_property
    def walk(self) -> DataFrame:
        """Placed frames only: the camera positions in filming order."""
        return self.frames.where("placed = 1").select("scene_id", "frame", "name", "px", "py", "pz", "value")

    @cached_property
    def cameras(self) -> DataFrame:
        """Placed frames as pinhole cameras: unit right / down / forward rows and intrinsics."""
        c = self.walk.selectExpr("*", *[f"{e} AS {n}" for n, e in DIR.items()])
        c = c.selectExpr("scene_id", "frame", "name", "px", "py", "pz", "rx", "ry", "rz", "sqrt(rx*rx+ry*ry+rz*rz) AS rl", "sqrt(rx*rx+ry*ry) AS hl")
        return c.selectExpr(
            "scene_id", "frame", "name", "px", "py", "pz",
            "rx/rl AS fx", "ry/rl AS fy", "rz/rl AS fz",
            "ry/hl AS sx", "-rx/hl AS sy", "0e0 AS sz",
            "rx/rl*rz/hl AS dx", "ry/rl*rz/hl AS dy", "-hl/rl AS dz",
            "5e2 AS focal", "640 AS width", "480 AS height",
        )

    @cached_property
    def log_lines(self) -> DataFrame:
        e = self.raw("events").selectExpr("CAST(floor(event_id / 500) AS INT) AS job_id", "event_id % 500 + 1 AS line_no", "ts", "event_type")
        return e.selectExpr("job_id", "line_no", "ts", LOG_LINE)

    @cached_property
    def cells(self) -> DataFrame:
        """Occupied 0.5-unit cells: mean height where at least two points fell, else NULL."""
        return raster.rasterise(self.points, CELL, MIN_POINTS, self.parts)

    @cached_property
    def grid(self) -> DataFrame:
        return self.cells.where("z IS NOT NULL").select("scene_id", "i", "j", "z")

    @cached_property
    def meta(self) -> DataFrame:
        return raster.raster_meta(self.points, CELL)

    @cached_property
    def quads(self) -> DataFrame:
        return raster.quad_mesh(self.grid, self.parts)

    @cached_property
    def vertices(self) -> DataFrame:
        """One vertex per measured cell centre; the id is the cell's own position."""
        from groundloom.operators import mesh

        return mesh.cell_vertices(self.grid, self.meta)

    @cached_property
    def faces(self) -> DataFrame:
        from groundloom.operators import mesh

        return mesh.quad_faces(self.quads)

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.raw("embeddings")

    @cached_property
    def splats(self) -> DataFrame:
        """Points with 45 view-dependent colour coefficients and an orientation."""
        emb = self.embeddings.selectExpr("vec_id", "transform(slice(embedding, 1, 45), v -> CAST(v AS DOUBLE)) AS f_rest")
        n = self.embeddings.agg(F.count(F.lit(1))).scalar()
        return (
            self.points.withColumn("vec_id", F.pmod(F.col("point_id"), n))
            .join(emb, "vec_id")
            .selectExpr(
                "scene_id", "point_id AS splat_id", "x", "y", "z", "opacity_logit", "ls0", "ls1", "ls2",
                "1e0 AS rw", "(CAST(r AS DOUBLE) - 125e0) / 25e1 AS rx", "(CAST(g AS DOUBLE) - 125e0) / 25e1 AS ry",
                "(CAST(b AS DOUBLE) - 2e1) / 1e2 AS rz",
                "(CAST(r AS DOUBLE) - 125e0) / 125e0 AS dc0", "(CAST(g AS DOUBLE) - 125e0) / 125e0 AS dc1",
                "(CAST(b AS DOUBLE) - 125e0) / 125e0 AS dc2", "f_rest",
            )
        )

    @cached_property
    def poses(self) -> DataFrame:
        """World-to-camera poses with quaternions that are not yet normalised."""
        return self.frames.where("placed = 1").selectExpr(
            "scene_id", "frame", "name",
            "1e0 + value / 1e3 AS qw", "CAST(frame % 17 AS DOUBLE) / 2e1 AS qx",
            "CAST(frame % 13 AS DOUBLE) / 3e1 - 2e-1 AS qy", "CAST(frame % 11 AS DOUBLE) / 4e1 AS qz",
            "px AS tx", "py AS ty", "pz AS tz",
        )

    @cached_property
    def pixels(self) -> DataFrame:
        """One depth sample per (scene, u, v) at a tenth of a unit: the highest point wins."""
        p = self.points.selectExpr("scene_id", "CAST(floor(x * 1e1) AS INT) AS u", "CAST(floor(y * 1e1) AS INT) AS v", "z", "point_id", "r", "g", "b")
        top = F.max_by(F.struct("r", "g", "b"), F.struct("z", F.col("point_id")))
        return in_parts(p, self.parts, "scene_id", "u", "v").groupBy("scene_id", "u", "v").agg(F.max("z").alias("depth"), top.alias("c")).select("scene_id", "u", "v", "depth", "c.r", "c.g", "c.b")

    @cached_property
    def observations(self) -> DataFrame:
        """2-D sightings: every point is seen by the placed frames of its scene that share its residue."""
        p = self.points.selectExpr(
            "scene_id", "point_id", "x", "y", "z", "pmod(point_id, 120) AS k",
            "CAST(pmod(point_id, 40) AS DOUBLE) / 1e1 AS err", "CAST(1 + pmod(point_id, 6) AS INT) AS track",
        )
        f = self.cameras.selectExpr("scene_id", "frame", "frame % 120 AS k", "px", "py", "pz", "fx", "fy", "fz")
        return f.join(p, ["scene_id", "k"]).drop("k")

    @cached_property
    def files(self) -> DataFrame:
        return self.raw("pages").selectExpr("page_id", "url AS path", "CAST(octet_length(html) AS BIGINT) AS bytes", "sha2(html, 256) AS sha256")

    @cached_property
    def detections(self) -> DataFrame:
        return self.raw("events").where("event_type = 'click'").selectExpr(
            "event_id", "CAST(floor(event_id / 500) AS INT) AS scene_id", "event_id % 50 AS frame",
            "value AS x", "CAST(user_id AS DOUBLE) * 2e0 AS y", "1e1 + CAST(user_id % 40 AS DOUBLE) AS w",
            "12e0 + CAST(event_id % 30 AS DOUBLE) AS h", "5e-1 + CAST(event_id % 50 AS DOUBLE) / 1e2 AS score",
        )


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, deps: tuple[str, ...], sql: str) -> None:
    VIEWS[name] = (deps, sql)


def _duck(exprs: list[str]) -> str:
    return ", ".join(exprs)


view("points", (), f"""SELECT CAST('0x' || substr(md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT))), 1, 15) AS BIGINT) AS point_id,
 {_duck(POINT_EXPRS)} FROM lineitem""")
view("frames", (), f"""SELECT *, 36e-1 + 3e-1 * px - 2e-1 * py + value / 1e3 AS pz FROM (SELECT event_type, {_duck(FRAME_EXPRS)} FROM events) q""")
view("walk", ("frames",), "SELECT scene_id, frame, name, px, py, pz, value FROM frames WHERE placed = 1")
view("cameras", ("walk",), f"""SELECT scene_id, frame, name, px, py, pz, rx/rl AS fx, ry/rl AS fy, rz/rl AS fz, ry/hl AS sx, -rx/hl AS sy, 0e0 AS sz,
 rx/rl*rz/hl AS dx, ry/rl*rz/hl AS dy, -hl/rl AS dz, 5e2 AS focal, 640 AS width, 480 AS height FROM (
 SELECT *, sqrt(rx*rx+ry*ry+rz*rz) AS rl, sqrt(rx*rx+ry*ry) AS hl FROM (SELECT *, {DIR['rx']} AS rx, {DIR['ry']} AS ry, {DIR['rz']} AS rz FROM walk) a) b""")
view("log_lines", (), f"""SELECT job_id, line_no, ts, {LOG_LINE} FROM (
 SELECT CAST(floor(event_id / 500) AS INT) AS job_id, event_id % 500 + 1 AS line_no, ts, event_type FROM events) q""")
view("extent", ("points",), "SELECT scene_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS points FROM points GROUP BY scene_id")
view("meta", ("extent",), "SELECT scene_id, x0, y1, CAST(ceil((x1-x0)/5e-1) AS BIGINT)+1 AS nx, CAST(ceil((y1-y0)/5e-1) AS BIGINT)+1 AS ny FROM extent")
view("cells", ("points", "extent"), """SELECT scene_id, i, j, CASE WHEN n >= 2 THEN CAST(s AS DOUBLE)/1e6/n END AS z, n FROM (
 SELECT p.scene_id, CAST(floor((m.y1-p.y)/5e-1) AS BIGINT) AS i, CAST(floor((p.x-m.x0)/5e-1) AS BIGINT) AS j, count(*) AS n,
 sum(CAST(floor(p.z*1e6+5e-1) AS BIGINT)) AS s FROM points p JOIN extent m ON p.scene_id=m.scene_id GROUP BY 1,2,3) q""")
view("grid", ("cells",), "SELECT scene_id, i, j, z FROM cells WHERE z IS NOT NULL")
view("quads", ("grid",), """SELECT a.scene_id, a.i, a.j FROM grid a JOIN grid b ON a.scene_id=b.scene_id AND a.i=b.i AND b.j=a.j+1
 JOIN grid c ON a.scene_id=c.scene_id AND c.i=a.i+1 AND c.j=a.j JOIN grid d ON a.scene_id=d.scene_id AND d.i=a.i+1 AND d.j=a.j+1""")
view("vertices", ("grid", "meta"), """SELECT g.scene_id, g.i*1048576+g.j AS vid, m.x0+(g.j+5e-1)*5e-1 AS x, m.y1-(g.i+5e-1)*5e-1 AS y, g.z
 FROM grid g JOIN meta m ON g.scene_id=m.scene_id""")
view("faces", ("quads",), """SELECT scene_id, (i*1048576+j)*2 AS fid, (i+1)*1048576+j AS a, (i+1)*1048576+j+1 AS b, i*1048576+j+1 AS c FROM quads
 UNION ALL SELECT scene_id, (i*1048576+j)*2+1, (i+1)*1048576+j, i*1048576+j+1, i*1048576+j FROM quads""")
# corner lookups join on one combined key, so no engine is tempted to pair a scene's vertices first
view("vkeys", ("vertices",), "SELECT *, CAST(scene_id AS BIGINT)*1099511627776+vid AS vk FROM vertices")
view("corners", ("faces", "vkeys"), """SELECT f.scene_id, f.fid, f.a, f.b, f.c, p.x AS xa, p.y AS ya, p.z AS za, q.x AS xb, q.y AS yb, q.z AS zb, r.x AS xc, r.y AS yc, r.z AS zc
 FROM (SELECT *, CAST(scene_id AS BIGINT)*1099511627776 AS base FROM faces) f JOIN vkeys p ON p.vk=f.base+f.a JOIN vkeys q ON q.vk=f.base+f.b JOIN vkeys r ON r.vk=f.base+f.c""")
view("splats", ("points",), """SELECT p.scene_id, p.point_id AS splat_id, p.x, p.y, p.z, p.opacity_logit, p.ls0, p.ls1, p.ls2,
 1e0 AS rw, (CAST(p.r AS DOUBLE)-125e0)/25e1 AS rx, (CAST(p.g AS DOUBLE)-125e0)/25e1 AS ry, (CAST(p.b AS DOUBLE)-2e1)/1e2 AS rz,
 (CAST(p.r AS DOUBLE)-125e0)/125e0 AS dc0, (CAST(p.g AS DOUBLE)-125e0)/125e0 AS dc1, (CAST(p.b AS DOUBLE)-125e0)/125e0 AS dc2,
 e.embedding AS f_rest FROM points p JOIN embeddings e ON e.vec_id = p.point_id % (SELECT count(*) FROM embeddings)""")
view("poses", ("frames",), """SELECT scene_id, frame, name, 1e0+value/1e3 AS qw, CAST(frame % 17 AS DOUBLE)/2e1 AS qx, CAST(frame % 13 AS DOUBLE)/3e1-2e-1 AS qy,
 CAST(frame % 11 AS DOUBLE)/4e1 AS qz, px AS tx, py AS ty, pz AS tz FROM frames WHERE placed = 1""")
view("pixels", ("points",), """SELECT scene_id, u, v, max(z) AS depth, arg_max(r, k) AS r, arg_max(g, k) AS g, arg_max(b, k) AS b FROM (
 SELECT scene_id, CAST(floor(x*1e1) AS INT) AS u, CAST(floor(y*1e1) AS INT) AS v, z, r, g, b, row(z, point_id) AS k FROM points) q GROUP BY 1,2,3""")
view("observations", ("points", "cameras"), """SELECT f.scene_id, f.frame, f.px, f.py, f.pz, f.fx, f.fy, f.fz, p.point_id, p.x, p.y, p.z,
 CAST(p.point_id % 40 AS DOUBLE)/1e1 AS err, CAST(1 + p.point_id % 6 AS INT) AS track
 FROM cameras f JOIN points p ON p.scene_id=f.scene_id AND p.point_id % 120 = f.frame % 120""")
view("files", (), "SELECT page_id, url AS path, CAST(strlen(html) AS BIGINT) AS bytes, sha256(html) AS sha256 FROM pages")
view("detections", (), """SELECT event_id, CAST(floor(event_id / 500) AS INT) AS scene_id, event_id % 50 AS frame, value AS x, CAST(user_id AS DOUBLE)*2e0 AS y,
 1e1+CAST(user_id % 40 AS DOUBLE) AS w, 12e0+CAST(event_id % 30 AS DOUBLE) AS h, 5e-1+CAST(event_id % 50 AS DOUBLE)/1e2 AS score FROM events WHERE event_type='click'""")


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs it needs, dependencies first."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    head = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in order)
    body = sql.strip()
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
