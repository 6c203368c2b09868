"""Ordering directed segments into lines and rings by pointer doubling.

Every node has at most one successor. Each round doubles how far a node has looked ahead, so a
line of n nodes is ordered in about log2(n) joins and never has to fit in one task. Groups of at most
``TOGETHER`` edges are ordered in the same way in arrays, many groups to a task, without a join.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from groundloom.session import cut_lineage

#: Edges of a group, and of all groups a task orders at once, that are held in arrays.
TOGETHER = 1 << 16


def order(edges: DataFrame, group: list[str], start: str, end: str, together: int = TOGETHER) -> DataFrame:
    """Nodes with line (a name shared by the nodes of one line), pos (0..), and closed.

    Open lines are named by their last node; rings by their smallest node, which comes first.
    """
    g = edges.select(*group, F.col(start).alias("node"), F.col(end).alias("nxt"))
    sizes = cut_lineage(g.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.max(F.col("node").isNull() | F.col("nxt").isNull()).alias("_gap")))
    apart = (F.col("_n") > together) | F.col("_gap")
    for c in group:
        apart = apart | F.col(c).isNull()
    total, large = sizes.agg(F.sum("_n"), F.count(F.when(apart, 1))).first()
    if not large:
        return _order_together(g, group, total or 0, together)
    many = sizes.where(apart).select(*[F.col(c).alias("_g" + c) for c in group])
    same = [F.col(c).eqNullSafe(F.col("_g" + c)) for c in group]
    return _order_apart(g.join(many, same, "left_semi"), group, "node", "nxt").unionByName(_order_together(g.join(many, same, "left_anti"), group, total, together))


def _order_together(g: DataFrame, group: list[str], total: int, together: int) -> DataFrame:
    """``order`` for small groups: each task takes a bucket of about ``together`` edges of whole groups."""
    schema = StructType([*g.select(*group, "node", F.col("node").alias("line")).schema, StructField("pos", LongType()), StructField("closed", BooleanType())])
    buckets = max(g.sparkSession.sparkContext.defaultParallelism, -(-total // together))
    names = [f.name for f in schema]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _ordered(rows, group)[names]

    keyed = g.withColumn("_b", F.pmod(F.xxhash64(*group), F.lit(buckets)))
    return keyed.repartition(buckets, "_b").groupBy("_b").applyInPandas(run, schema)


def _ordered(rows: pd.DataFrame, group: list[str]) -> pd.DataFrame:
    """Pointer doubling over the edges (``group``, node, nxt) of several groups."""
    of = rows.groupby(group, sort=False).ngroup().to_numpy()
    ids, code = np.unique(np.concatenate([rows["node"].to_numpy(), rows["nxt"].to_numpy()]), return_inverse=True)
    both = np.concatenate([of, of]) * len(ids) + code.ravel()
    keys, place, at = np.unique(both, return_index=True, return_inverse=True)
    n, m = len(keys), len(rows)
    a, b = at.ravel()[:m], at.ravel()[m:]
    nxt = np.full(n, -1)
    np.maximum.at(nxt, a, b)
    here = np.arange(n)
    rounds = math.ceil(math.log2(max(2, int(np.bincount(keys // len(ids)).max())))) + 1

    def double(nxt: np.ndarray):
        jump, dist, tail = nxt, (nxt >= 0).astype(np.int64), np.where(nxt >= 0, nxt, here)
        low = np.minimum(here, tail)
        for _ in range(rounds):
            go = jump >= 0
            to = np.where(go, jump, 0)
            dist, low = np.where(go, dist + dist[to], dist), np.where(go, np.minimum(low, low[to]), low)
            tail, jump = np.where(go, tail[to], tail), np.where(go, jump[to], -1)
            if not (jump >= 0).any():
                break
        return jump, dist, tail, low

    jump, dist, line, low = double(nxt)
    closed = jump >= 0
    if closed.any():
        cut = np.where(closed & (nxt != low), nxt, -1)
        dist, line = np.where(closed, double(cut)[1], dist), np.where(closed, low, line)
    length = np.zeros(2 * n, dtype=np.int64)
    np.maximum.at(length, line + n * closed, dist)
    out = rows.iloc[place % m][group].reset_index(drop=True)
    node = ids[keys % len(ids)]
    return out.assign(node=node, line=node[line], pos=length[line + n * closed] - dist, closed=closed)


def _order_apart(edges: DataFrame, group: list[str], start: str, end: str) -> DataFrame:
    """``order`` for groups of any size."""
    g = edges.select(*group, F.col(start).alias("node"), F.col(end).alias("nxt"))
    heads = g.select(*group, F.col("nxt").alias("node"), F.lit(None).cast(g.schema["nxt"].dataType).alias("nxt"))
    nodes = cut_lineage(g.unionByName(heads).groupBy(*group, "node").agg(F.max("nxt").alias("nxt")))
    most = nodes.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if not most:
        return nodes.select(*group, "node", F.col("node").alias("line"), F.lit(0).cast("bigint").alias("pos"), F.lit(False).alias("closed"))
    rounds = math.ceil(math.log2(most)) + 1

    def double(state: DataFrame) -> DataFrame:
        """state: group, node, jump, dist, tail, low."""
        for _ in range(rounds):
            ahead = state.select(*group, F.col("node").alias("jump"), F.col("jump").alias("_j"), F.col("dist").alias("_d"), F.col("tail").alias("_t"), F.col("low").alias("_l"))
            state = cut_lineage(state.join(ahead, [*group, "jump"], "left").select(
                *group, "node", F.when(F.col("jump").isNotNull(), F.col("_j")).alias("jump"), (F.col("dist") + F.coalesce("_d", F.lit(0))).alias("dist"),
                F.coalesce("_t", "tail").alias("tail"), F.least("low", F.coalesce("_l", "low")).alias("low")))
            if state.where("jump IS NOT NULL").isEmpty():
                break
        return state

    def begin(n: DataFrame) -> DataFrame:
        return n.select(*group, "node", F.col("nxt").alias("jump"), F.when(F.col("nxt").isNull(), 0).otherwise(1).cast("bigint").alias("dist"),
                        F.coalesce("nxt", "node").alias("tail"), F.least("node", F.coalesce("nxt", "node")).alias("low"))

    far = double(begin(nodes))
    lines = far.where("jump IS NULL").select(*group, "node", "dist", F.col("tail").alias("line"), F.lit(False).alias("closed"))
    rings = far.where("jump IS NOT NULL").select(*group, "node", "low").join(nodes, [*group, "node"])
    if not rings.isEmpty():
        cut = rings.select(*group, "node", F.when(F.col("nxt") != F.col("low"), F.col("nxt")).alias("nxt"))
        around = double(begin(cut)).select(*group, "node", "dist").join(rings.select(*group, "node", F.col("low").alias("line")), [*group, "node"])
        lines = lines.unionByName(around.withColumn("closed", F.lit(True)))
    length = lines.groupBy(*group, "line").agg(F.max("dist").alias("_m"))
    return lines.join(length, [*group, "line"]).select(*group, "node", "line", (F.col("_m") - F.col("dist")).alias("pos"), "closed")


def contour_lines(segments: DataFrame, major: int = 5) -> DataFrame:
    """Vertices of contour lines in order; every ``major``-th level is a major one."""
    p = order(segments, ["scene_id", "k"], "e1", "e2")
    at = segments.select("scene_id", "k", F.explode(F.array(F.struct(F.col("e1").alias("node"), F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("e2").alias("node"), F.col("bx").alias("x"), F.col("by").alias("y")))).alias("p"))
    at = at.select("scene_id", "k", "p.node", "p.x", "p.y").groupBy("scene_id", "k", "node").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    return p.join(at, ["scene_id", "k", "node"]).withColumn("major", F.col("k") % major == 0)


def outlines(rim: DataFrame, stride: int, share: float = 0.002) -> DataFrame:
    """Rings of a mesh's border edges with their signed plan area in cells (holes negative); rings under ``share``
    of their scene's patch are left out. Corner ids are i*stride + j."""
    return _areas(order(rim, ["scene_id"], "a", "b"), rim, stride, share)


def _areas(p: DataFrame, rim: DataFrame, stride: int, share: float) -> DataFrame:
    x, y = F.col("node") % stride, -F.floor(F.col("node") / stride)
    ring = p.join(rim.select("scene_id", F.col("a").alias("node"), "b"), ["scene_id", "node"])
    x2, y2 = F.col("b") % stride, -F.floor(F.col("b") / stride)
    area = ring.groupBy("scene_id", "line").agg((F.sum(x * y2 - x2 * y).cast("double") / 2).alias("area"), F.count(F.lit(1)).alias("corners"))
    whole = area.groupBy("scene_id").agg(F.sum("area").alias("patch"))
    return area.join(whole, "scene_id").where(F.abs(F.col("area")) >= F.col("patch") * share).select("scene_id", "line", "area", "corners", F.when(F.col("area") > 0, "outline").otherwise("hole").alias("kind"))


def outline_vertices(rim: DataFrame, stride: int, share: float = 0.002) -> DataFrame:
    """The corners of the rings that ``outlines`` keeps: line, kind, pos, and x, y in cells (north up)."""
    p = cut_lineage(order(rim, ["scene_id"], "a", "b"))
    at = p.select("scene_id", "line", "pos", (F.col("node") % stride).cast("double").alias("x"), (-F.floor(F.col("node") / stride)).cast("double").alias("y"))
    return at.join(_areas(p, rim, stride, share).select("scene_id", "line", "kind"), ["scene_id", "line"])
