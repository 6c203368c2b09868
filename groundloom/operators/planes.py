"""The plane that most points of a scene lie on: many hypotheses, each judged by every point.

Hypotheses are planes through three drawn points, rows of a table. A part of a scene's points meets a block of its hypotheses in one task
and leaves a count for each; the counts of the parts are summed up. Least-squares refits follow from sums over all points near the plane;
no task holds a scene.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from groundloom.functions.numeric import exact_sum
from groundloom.operators import meet
from groundloom.session import cut_lineage

AX = ("x", "y", "z")
#: Points and hypotheses that meet in one group.
PART, BLOCK = 1 << 16, 1024
#: Subgroups of a scene that are ranked apart when points are drawn.
SALTS = 32
LEAST_POINTS, LEAST_NEAR = 50, 10
#: Planes that are tried in each scene.
TRIALS = 600


def extents(points: DataFrame, tolerance: float) -> DataFrame:
    """scene_id, n, lowest corner ox, oy, oz, longest side ext, and tol of scenes with points enough."""
    e = points.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"), *[F.min(a).alias("o" + a) for a in AX], *[(F.max(a) - F.min(a)).alias("_e" + a) for a in AX])
    e = e.withColumn("ext", F.greatest(*["_e" + a for a in AX])).withColumn("tol", F.lit(tolerance) * F.col("ext"))
    return e.where(F.col("n") >= LEAST_POINTS).drop(*["_e" + a for a in AX])


def drawn(s: str, n: str) -> str:
    """SQL for the place that the ``s``-th draw takes among ``n``: a linear sequence squared modulo a prime, the same in any engine."""
    h = f"(({s})*1103515245+12345)%2147483647"
    return f"((({h})*({h}))%2147483647)%({n})"


def hypotheses(points: DataFrame, trials: int, draw: Column, again: bool = True) -> DataFrame:
    """scene_id, k, nx, ny, nz, d: planes through the 3k-th to (3k+2)-th of the points with the smallest ``draw`` (then point_id).

    Scenes with fewer than three points a trial draw points ``again`` for each corner, so they too have that many trials; without, each point is
    drawn once and trials end with the points. Trials whose three points are not apart, or on a line, give no plane.
    """
    order = [F.col("_draw"), F.col("point_id")]
    p = points.withColumn("_draw", draw).withColumn("_salt", F.pmod(F.xxhash64("point_id"), F.lit(SALTS)))
    p = p.withColumn("_r", F.row_number().over(Window.partitionBy("scene_id", "_salt").orderBy(*order))).where(F.col("_r") <= 3 * trials)
    p = p.withColumn("_r", F.row_number().over(Window.partitionBy("scene_id").orderBy(*order)) - 1).where(F.col("_r") < 3 * trials)
    t = p.groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct("_r", *AX))).alias("_p")).withColumn("_n", F.size("_p").cast("bigint"))
    place = lambda s: f"CASE WHEN _n < {3 * trials} THEN {drawn(s, '_n')} ELSE {s} END" if again else s
    corners = ", ".join(f"_p[CAST({place(f'3*k+{j}')} AS INT)] AS c{j}" for j in range(3))
    last = trials - 1 if again else f"least({trials}, floor(_n / 3)) - 1"
    t = t.where("_n >= 3").selectExpr("scene_id", f"explode(transform(sequence(0L, CAST({last} AS BIGINT)), k -> struct(k AS k, {corners}))) AS h")
    t = t.selectExpr("scene_id", "h.k", *[f"h.c{j}.{a} AS {a}{j}" for a in AX for j in range(3)])
    t = t.selectExpr("scene_id", "k", "x0", "y0", "z0", *[f"({b}1-{b}0)*({c}2-{c}0)-({c}1-{c}0)*({b}2-{b}0) AS c{a}" for a, b, c in ("xyz", "yzx", "zxy")])
    t = t.withColumn("_l", F.expr("sqrt(cx*cx+cy*cy+cz*cz)")).where("_l > 1e-12").selectExpr("scene_id", "k", "x0", "y0", "z0", "cx/_l AS nx", "cy/_l AS ny", "cz/_l AS nz")
    return t.selectExpr("scene_id", "k", "nx", "ny", "nz", "nx*x0+ny*y0+nz*z0 AS d")


def _off() -> Column:
    return F.abs(F.expr("x*nx+y*ny+z*nz-d"))


def votes(points: DataFrame, planes: DataFrame, size: DataFrame) -> DataFrame:
    """The plane of each scene that most points lie closer to than tol: scene_id, k, nx, ny, nz, d, votes; of equals the smallest k."""
    asked = planes.select("scene_id", "k", "nx", "ny", "nz", "d").join(size.select("scene_id", "tol"), "scene_id")
    kinds = {f.name: f.dataType.simpleString() for f in asked.schema}
    counts = meet.in_groups(points.select("scene_id", *AX), asked, ("x", "k"), (PART, BLOCK), _counted, f"scene_id {kinds['scene_id']}, k {kinds['k']}, votes bigint")
    total = counts.groupBy("scene_id", "k").agg(F.sum("votes").alias("votes")).join(planes, ["scene_id", "k"])
    top = total.groupBy("scene_id").agg(F.max(F.struct("votes", (-F.col("k")).alias("_k"), "k", "nx", "ny", "nz", "d")).alias("b"))
    return top.select("scene_id", "b.k", "b.nx", "b.ny", "b.nz", "b.d", "b.votes")


def _counted(points: pa.Table, planes: pa.Table) -> pa.Table:
    """Votes of each plane among the points, in the order of operations that SQL has."""
    x, y, z = (c[:, None] for c in meet.columns(points, *AX))
    nx, ny, nz, d, tol = meet.columns(planes, "nx", "ny", "nz", "d", "tol")
    n = np.zeros(len(d), np.int64)
    step = max(1, meet.TILE // len(d))
    for a in range(0, len(x), step):
        s = slice(a, a + step)
        n += (np.abs(x[s] * nx + y[s] * ny + z[s] * nz - d) < tol).sum(0)
    return pa.table({"scene_id": planes["scene_id"], "k": planes["k"], "votes": n})


# the smallest eigenvalue of a symmetric 3x3 matrix and its eigenvector in closed form; text that Spark and other engines read alike
CENTRED = {f"c{a}{b}": f"s{a}{b}/m-s{a}/m*s{b}/m" for a in AX for b in AX if a <= b}
MIDDLE = {"q": "(cxx+cyy+czz)/3e0"}
SPREAD = {"p": "sqrt(((cxx-q)*(cxx-q)+(cyy-q)*(cyy-q)+(czz-q)*(czz-q)+2e0*(cxy*cxy+cxz*cxz+cyz*cyz))/6e0)"}
TURN = {"w": "least(1e0,greatest(-1e0,((cxx-q)*((cyy-q)*(czz-q)-cyz*cyz)-cxy*(cxy*(czz-q)-cyz*cxz)+cxz*(cxy*cyz-(cyy-q)*cxz))/(p*p*p)/2e0))"}
LOWEST = {"lam": "q+2e0*p*cos(acos(w)/3e0+2.0943951023931953e0)"}
CROSSES = {
    "ax": "cxy*cyz-cxz*(cyy-lam)", "ay": "cxz*cxy-(cxx-lam)*cyz", "az": "(cxx-lam)*(cyy-lam)-cxy*cxy",
    "gx": "cxy*(czz-lam)-cxz*cyz", "gy": "cxz*cxz-(cxx-lam)*(czz-lam)", "gz": "(cxx-lam)*cyz-cxy*cxz",
    "ex": "(cyy-lam)*(czz-lam)-cyz*cyz", "ey": "cyz*cxz-cxy*(czz-lam)", "ez": "cxy*cyz-(cyy-lam)*cxz",
}
SIZES = {"la": "ax*ax+ay*ay+az*az", "lb": "gx*gx+gy*gy+gz*gz", "le": "ex*ex+ey*ey+ez*ez"}
LONGEST = {"v" + a: f"CASE WHEN la>=lb AND la>=le THEN a{a}/sqrt(la) WHEN lb>=le THEN g{a}/sqrt(lb) ELSE e{a}/sqrt(le) END" for a in AX}
NORMAL = {"u" + a: f"CASE WHEN vz<0 THEN -v{a} ELSE v{a} END" for a in AX}
STEPS = (CENTRED, MIDDLE, SPREAD, TURN, LOWEST, CROSSES, SIZES, LONGEST, NORMAL)
OFFSET = "ux*(ox+sx/m*ext/1e3)+uy*(oy+sy/m*ext/1e3)+uz*(oz+sz/m*ext/1e3)"


def refitted(points: DataFrame, planes: DataFrame, size: DataFrame) -> DataFrame:
    """Planes (scene_id, nx, ny, nz, d) fitted to all points closer than tol, normals upward; one with few such points stays as it is."""
    p = planes.select("scene_id", "nx", "ny", "nz", "d")
    near = points.select("scene_id", *AX).join(p.join(size, "scene_id"), "scene_id").where(_off() < F.col("tol"))
    for a in AX:
        near = near.withColumn("_" + a, (F.col(a) - F.col("o" + a)) / F.col("ext") * 1e3)
    sums = near.groupBy("scene_id").agg(F.count(F.lit(1)).cast("double").alias("m"), *[exact_sum("_" + a).alias("s" + a) for a in AX], *[exact_sum(F.col("_" + a) * F.col("_" + b)).alias(f"s{a}{b}") for a in AX for b in AX if a <= b])
    s = sums.where(F.col("m") >= LEAST_NEAR).join(size, "scene_id")
    for step in STEPS:
        s = s.withColumns({c: F.expr(e) for c, e in step.items()})
    s = s.where("p > 0 AND greatest(la, lb, le) > 0").selectExpr("scene_id", "ux", "uy", "uz", f"{OFFSET} AS ud")
    new = p.join(s, "scene_id", "left")
    return new.select("scene_id", *[F.when(F.col("ux").isNotNull(), F.col("u" + a)).otherwise(F.col(c)).alias(c) for a, c in (("x", "nx"), ("y", "ny"), ("z", "nz"), ("d", "d"))])


def dominant_plane(points: DataFrame, trials: int = TRIALS, tolerance: float = 0.02, refits: int = 2, draw: Column | None = None) -> DataFrame:
    """scene_id, nx, ny, nz, d, tol, share of the points on the plane n . p = d; scenes of under 50 points have no row.

    ``points``: scene_id, point_id, x, y, z. Points within ``tolerance`` of the longest side count. Draws are hashes of ids unless ``draw`` says otherwise.
    """
    size = cut_lineage(extents(points, tolerance))
    use = points.join(size.select("scene_id"), "scene_id", "left_semi")
    planes = hypotheses(use, trials, F.xxhash64("point_id") if draw is None else draw)
    planes = cut_lineage(votes(use, planes, size))
    for _ in range(refits):
        planes = cut_lineage(refitted(use, planes, size))
    near = use.select("scene_id", *AX).join(planes.join(size.select("scene_id", "tol", "n"), "scene_id"), "scene_id")
    on = near.groupBy("scene_id").agg((F.sum(F.when(_off() < F.col("tol"), 1).otherwise(0)) / F.first("n")).alias("share"))
    return planes.select("scene_id", "nx", "ny", "nz", "d").join(size.select("scene_id", "tol"), "scene_id").join(on, "scene_id")
