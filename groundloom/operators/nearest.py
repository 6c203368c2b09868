"""Nearest-neighbour and range joins as equi-joins on grid cells.

``candidates`` narrows, level by level, which targets can be the nearest one for any place in a
grid cell; the point table then meets only those through an equi-join. The result is exact:
a target is dropped only when another one is nearer for every place in the cell. Bounds are
minima, summed up before they are shuffled, so a scene with very many targets never meets in one task.
Where no scene has more than ``FEW`` targets, its points meet all of them in bounded groups instead, and nothing but the points is shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from groundloom.operators import meet
from groundloom.session import cut_lineage, spread_by

#: Points of a cell that make up for narrowing its candidates once more.
PER_CELL = 64
#: Targets of a scene that its points may all be compared with, points of one group, and pairs looked at together.
FEW, PART, TILE = 2048, 1 << 16, 1 << 16


def segment_distance(at: list[Column], a: list[Column], b: list[Column]) -> tuple[Column, Column]:
    """Distance from a place to the segment a-b, and the clamped position along it (0..1)."""
    d = [q - p for p, q in zip(a, b)]
    l2 = sum((v * v for v in d[1:]), d[0] * d[0])
    rel = [x - p for x, p in zip(at, a)]
    dot = sum((r * v for r, v in zip(rel[1:], d[1:])), rel[0] * d[0])
    t = F.when(l2 > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot / l2))).otherwise(F.lit(0.0))
    off = [r - t * v for r, v in zip(rel, d)]
    return F.sqrt(sum((o * o for o in off[1:]), off[0] * off[0])), t


def candidates(targets: DataFrame, box: DataFrame, dims: list[str], tie: str, depth: int = 5) -> DataFrame:
    """Targets worth comparing per grid cell.

    ``targets`` has scene_id, ``tie`` (unique within a scene) and ``a_<dim>``, ``b_<dim>`` end points; ``box`` has
    scene_id, ``lo_<dim>``, ``hi_<dim>`` covering every point that will be looked up. Adds the
    cell columns ``c_<dim>`` at resolution 2^depth per axis.
    """
    live = spread_by(targets.join(box, "scene_id"), "scene_id", tie)
    first = min(6 // len(dims), depth)  # start from about 64 cells
    cell = ["scene_id", *["c_" + d for d in dims]]
    for level in range(first, depth + 1):
        parts = 2**level
        for d in dims:
            halves = F.array(F.col("c_" + d) * 2, F.col("c_" + d) * 2 + 1) if level > first else F.array(*[F.lit(k) for k in range(parts)])
            live = live.withColumn("c_" + d, F.explode(halves))
        size = {d: (F.col("hi_" + d) - F.col("lo_" + d)) / parts for d in dims}
        centre = [F.col("lo_" + d) + (F.col("c_" + d) + 0.5) * size[d] for d in dims]
        dist, _ = segment_distance(centre, [F.col("a_" + d) for d in dims], [F.col("b_" + d) for d in dims])
        diagonal = F.sqrt(sum((size[d] * size[d] for d in dims[1:]), size[dims[0]] * size[dims[0]]))
        live = live.withColumn("_d", dist)
        # for any place in the cell a target is within dist +- diagonal/2; the slack covers rounding
        best = live.groupBy(*cell).agg((F.min("_d") + F.first(diagonal) * 1.0000001 + 1e-9).alias("_most"))
        live = cut_lineage(live.join(best, cell).where("_d <= _most").drop("_d", "_most"))
    return live.drop(*["lo_" + d for d in dims], *["hi_" + d for d in dims])


def cells_of(points: DataFrame, box: DataFrame, columns: dict[str, str], depth: int = 5) -> DataFrame:
    """Give each point the cell columns used by ``candidates``; ``columns`` maps dim -> point column."""
    at = points.join(box, "scene_id")
    n = 2**depth
    for d, c in columns.items():
        share = F.when(F.col("hi_" + d) > F.col("lo_" + d), (F.col(c) - F.col("lo_" + d)) / (F.col("hi_" + d) - F.col("lo_" + d))).otherwise(F.lit(0.0))
        at = at.withColumn("c_" + d, F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(share * n).cast("int"))))
    return at.drop(*["lo_" + d for d in columns], *["hi_" + d for d in columns])


def bounding_box(points: DataFrame, columns: dict[str, str]) -> DataFrame:
    aggs = [f(c).alias(p + d) for d, c in columns.items() for f, p in ((F.min, "lo_"), (F.max, "hi_"))]
    return points.groupBy("scene_id").agg(F.count(F.lit(1)).alias("_n"), *aggs)


def nearest(points: DataFrame, targets: DataFrame, columns: dict[str, str], point_key: list[str], tie: str, carry: list[str], depth: int | None = None) -> DataFrame:
    """Nearest target per point (first by ``tie`` when equal): keys, ``distance``, ``t`` and the carried target columns.

    Points meet the candidates of their cell row by row in one compiled stage and are reduced by minima of plain numbers: first the
    distance, then the smallest ``tie`` at that distance; what is carried is fetched for the winners only. The grid is about as fine as the
    points of the largest scene, or its targets, pay for, unless ``depth`` says otherwise. Without ``depth``, scenes of few targets need no grid.
    """
    dims = list(columns)
    if depth is None and (targets.groupBy("scene_id").agg(F.count(F.lit(1)).alias("_m")).agg(F.max("_m")).first()[0] or 0) <= FEW:
        return _among_few(points, targets, columns, point_key, tie, carry)
    box = cut_lineage(bounding_box(points, columns).join(targets.groupBy("scene_id").agg(F.count(F.lit(1)).alias("_m")), "scene_id"))
    if depth is None:
        n, m = box.agg(F.max("_n"), F.max("_m")).first()
        cells = min((n or 0) / PER_CELL, m or 0)
        depth = min(12, max(3, math.ceil(math.log2(cells + 1) / len(dims))))
    box = box.drop("_n", "_m")
    cell = ["scene_id", *["c_" + d for d in dims]]
    ends = [p + d for d in dims for p in ("a_", "b_")]
    cand = candidates(targets.select("scene_id", tie, *ends), box, dims, tie, depth).withColumnRenamed(tie, "_tie")
    at = cells_of(points.select(*dict.fromkeys(["scene_id", *point_key, *columns.values()])), box, columns, depth)
    dist, t = segment_distance([F.col(v) for v in columns.values()], [F.col("a_" + d) for d in dims], [F.col("b_" + d) for d in dims])
    own = ["scene_id", *point_key]
    places = [c for c in dict.fromkeys(columns.values()) if c not in own]
    low = at.join(cand, cell).groupBy(*own, *places, *cell[1:]).agg(F.min(dist).alias("distance"))
    won = low.join(cand, cell).where(dist <= F.col("distance")).groupBy(*own, *places, "distance").agg(F.min("_tie").alias("_tie"))
    carried = targets.select("scene_id", F.col(tie).alias("_tie"), *ends, *[F.col(c).alias("_c_" + c) for c in carry])
    return won.join(carried, ["scene_id", "_tie"]).select(*own, "distance", t.alias("t"), *[F.col("_c_" + c).alias(c) for c in carry])


def _among_few(points: DataFrame, targets: DataFrame, columns: dict[str, str], point_key: list[str], tie: str, carry: list[str]) -> DataFrame:
    """``nearest`` by comparing with every target of the scene, a part of its points at a time; the arithmetic is that of ``segment_distance``."""
    own = list(dict.fromkeys(["scene_id", *point_key]))
    ends = [p + d for d in columns for p in ("a_", "b_")]
    p = points.select(*dict.fromkeys([*own, *columns.values()])).dropna(subset=list(columns.values()))
    q = targets.select(*dict.fromkeys(["scene_id", tie, *ends, *carry])).dropna(subset=ends)
    kinds = lambda df, names: [f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names]

    def work(rows: pa.Table, few: pa.Table) -> pa.Table:
        few = few.sort_by(tie)  # the first of equal distances is the smallest
        at = [c[:, None] for c in meet.columns(rows, *columns.values())]
        a, b = meet.columns(few, *["a_" + d for d in columns]), meet.columns(few, *["b_" + d for d in columns])
        d = [y - x for x, y in zip(a, b)]
        l2 = sum((v * v for v in d[1:]), d[0] * d[0])
        safe = np.where(l2 > 0, l2, 1.0)
        n = rows.num_rows
        won, dist, along = np.empty(n, np.int64), np.empty(n), np.empty(n)
        step = max(1, TILE // len(l2))
        for lo in range(0, n, step):
            s = slice(lo, lo + step)
            rel = [x[s] - y for x, y in zip(at, a)]
            dot = sum((r * v for r, v in zip(rel[1:], d[1:])), rel[0] * d[0])
            t = np.where(l2 > 0, np.minimum(1.0, np.maximum(0.0, dot / safe)), 0.0)
            off = [r - t * v for r, v in zip(rel, d)]
            far = np.sqrt(sum((o * o for o in off[1:]), off[0] * off[0]))
            k = far.argmin(1)
            i = np.arange(len(k))
            won[s], dist[s], along[s] = k, far[i, k], t[i, k]
        k = pa.array(won)
        return pa.table({c: rows[c] for c in own} | {"distance": dist, "t": along} | {c: few[c].take(k) for c in carry})

    schema = ", ".join([*kinds(p, own), "distance double", "t double", *kinds(q, carry)])
    return meet.in_groups(p, q, (point_key[0], tie), (PART, FEW), work, schema)


def within_radius(points: DataFrame, centres: DataFrame, radius: Column) -> DataFrame:
    """Pairs (centre, point) closer than ``radius`` in plan, by an equi-join on radius-sized cells.

    ``centres`` has scene_id, cx, cy and a per-scene radius column evaluated by ``radius``; the same
    radius must be reachable from the points' side, so it is joined by scene.
    """
    per_scene = centres.select("scene_id", radius.alias("_r")).distinct()
    p = points.join(per_scene, "scene_id").withColumn("_bx", F.floor(F.col("x") / F.col("_r"))).withColumn("_by", F.floor(F.col("y") / F.col("_r")))
    ring = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    c = centres.withColumn("_r", radius).withColumn("_o", ring)
    c = c.withColumn("_bx", F.floor(F.col("cx") / F.col("_r")) + F.col("_o.a")).withColumn("_by", F.floor(F.col("cy") / F.col("_r")) + F.col("_o.b")).drop("_o")
    both = c.join(p.drop("_r"), ["scene_id", "_bx", "_by"])
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    return both.where(F.sqrt(dx * dx + dy * dy) < F.col("_r")).drop("_bx", "_by", "_r")
