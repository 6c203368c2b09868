"""The gridded mesh of scenes that fit a group, made from their points and judged face by face inside it.

Cells, faces, painted shares, blocks and the median edge of a scene all follow from its own points. So each point is shuffled once, and one
row a scene leaves the group; no cell, corner or face is a row of a table. Sums run over whole micro-units, as everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from groundloom.operators import meet

#: Points of the largest scenes that are judged in a group.
WHOLE = 1 << 18
COUNTS = ("faces", "kept", "not_on_ground", "not_in_block", "not_seen", "shards")


@dataclass(frozen=True)
class Rules:
    """Sizes in cells or units as the operators on tables have them (``repair.keep_faces``, ``terrain.block_roughness``)."""

    cell: float
    min_points: int = 2
    block: int = 2
    ground_cells: float = 1.5
    painted: float = 0.5
    shard: float = 8.0
    rough: float = 0.3
    above: float = 0.1
    min_ground: int = 8


def large_scenes(points: DataFrame, whole: int = WHOLE) -> DataFrame:
    """Scenes of more than ``whole`` points: scene_id."""
    return points.groupBy("scene_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > whole).select("scene_id")


def counts(points: DataFrame, rules: Rules, parts: int) -> DataFrame:
    """Per scene the number of faces, of those kept, and of those that fail each rule. Scenes without faces have no row.

    ``points``: scene_id, point_id, x, y, z, is_ground, opacity_logit; about rows / ``parts`` of them meet in a group, a scene always whole.
    """
    yes = lambda c, n: F.when(c, n).otherwise(0)
    kind = yes(F.col("is_ground"), 1) + yes(F.col("opacity_logit") >= 0, 2) + yes(F.col("point_id") % 2 == 1, 4)
    rows = points.select("scene_id", "x", "y", "z", kind.cast("tinyint").alias("kind")).withColumn("_b", F.pmod(F.xxhash64("scene_id"), F.lit(parts)).cast("int"))
    schema = f"scene_id {points.schema['scene_id'].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in COUNTS)
    return rows.repartition(parts, "_b").groupBy("_b").applyInArrow(lambda t: _judged(t, rules), schema)


class _Places:
    """Sorted places (scene, row, column) and where in them a place is."""

    def __init__(self, s: np.ndarray, i: np.ndarray, j: np.ndarray):
        self.rows = np.unique(s << 40 | i)
        self.keys, self.of = np.unique(np.searchsorted(self.rows, s << 40 | i) << 31 | j, return_inverse=True)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, s: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The place's number, or how many there are where it is none of them."""
        if not len(self):
            return np.zeros(len(s), np.int64)
        r = np.searchsorted(self.rows, s << 40 | i)
        known = (i >= 0) & (j >= 0) & (self.rows[np.minimum(r, len(self.rows) - 1)] == s << 40 | i)
        key = np.where(known, r << 31 | j, -1)
        k = np.searchsorted(self.keys, key)
        return np.where(self.keys[np.minimum(k, len(self) - 1)] == key, k, len(self))


def _exact_sums(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums per group over whole micro-units, as ``exact_sum`` has them."""
    m = np.floor(values * 1e6 + 0.5).astype(np.int64)
    high, low = np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.add.at(high, of, m >> 20)
    np.add.at(low, of, m & ((1 << 20) - 1))
    return (high.astype(float) * float(1 << 20) + low.astype(float)) / 1e6


def _whole(a: np.ndarray) -> np.ndarray:
    return np.floor(a).astype(np.int64)


def _judged(t: pa.Table, rules: Rules) -> pa.Table:
    x, y, z = (c.astype(float) for c in meet.columns(t, "x", "y", "z"))
    ok = np.isfinite(x) & np.isfinite(y)
    t, x, y, z = t.filter(pa.array(ok)), x[ok], y[ok], z[ok]
    kind = meet.columns(t, "kind")[0]
    scenes, s = np.unique(meet.columns(t, "scene_id")[0], return_inverse=True)
    s = s.astype(np.int64)
    none = pa.table({"scene_id": t["scene_id"].slice(0, 0), **{c: pa.array([], pa.int64()) for c in COUNTS}})
    if not len(scenes):
        return none
    cell = rules.cell
    x0, x1, y0, y1 = np.full(len(scenes), np.inf), np.full(len(scenes), -np.inf), np.full(len(scenes), np.inf), np.full(len(scenes), -np.inf)
    np.minimum.at(x0, s, x), np.maximum.at(x1, s, x), np.minimum.at(y0, s, y), np.maximum.at(y1, s, y)
    nx, ny = _whole(np.ceil((x1 - x0) / cell)) + 1, _whole(np.ceil((y1 - y0) / cell)) + 1

    # measured cells, and the blocks of four of them that are named by their north-west cell
    i, j = _whole((y1[s] - y) / cell), _whole((x - x0[s]) / cell)
    cells = _Places(s, i, j)
    measured = np.isfinite(z)
    n = np.bincount(cells.of[measured], minlength=len(cells))
    height = np.full(len(cells) + 1, np.nan)
    height[:-1] = np.where(n >= max(1, rules.min_points), _exact_sums(cells.of[measured], z[measured], len(cells)) / np.maximum(n, 1), np.nan)
    first = np.full(len(cells), -1)
    first[cells.of] = np.arange(len(s))
    cs, ci, cj = s[first], i[first], j[first]
    nw, ne, sw, se = (height[cells.find(cs, ci + a, cj + b)] for a in (0, 1) for b in (0, 1))
    full = np.append(np.isfinite(nw) & np.isfinite(ne) & np.isfinite(sw) & np.isfinite(se), False)
    nw, ne, sw, se = (np.append(c, np.nan) for c in (nw, ne, sw, se))

    def ground_at(s: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """``raster.bilinear``: NaN where a corner is not measured."""
        fx, fy = (x - x0[s]) / cell - 0.5, (y1[s] - y) / cell - 0.5
        gj, gi = np.minimum(np.maximum(_whole(fx), 0), nx[s] - 2), np.minimum(np.maximum(_whole(fy), 0), ny[s] - 2)
        k = cells.find(s, gi, gj)
        tx, ty = np.minimum(1.0, np.maximum(0.0, fx - gj)), np.minimum(1.0, np.maximum(0.0, fy - gi))
        value = nw[k] * (1 - tx) * (1 - ty) + ne[k] * tx * (1 - ty) + sw[k] * (1 - tx) * ty + se[k] * tx * ty
        return np.where(full[k], value, np.nan)

    # blocks whose ground points lie close to the raster and over which few points stand
    size = cell * rules.block
    over = ground_at(s, x, y)
    on = np.flatnonzero(~np.isnan(over))
    res = (z - over)[on]
    blocks = _Places(s[on], _whole((y1[s] - y)[on] / size), _whole((x - x0[s])[on] / size))
    seen_ground = (kind[on] & 1 > 0) & measured[on]
    count = lambda mask: np.bincount(blocks.of[mask], minlength=len(blocks))
    n_ground, n_points, n_up = count(seen_ground), count(slice(None)), count(res > rules.ground_cells * cell)
    m1, m2 = (_exact_sums(blocks.of[seen_ground], v[seen_ground], len(blocks)) / np.maximum(n_ground, 1) for v in (res, res * res))
    spread = np.sqrt(np.maximum(m2 - m1 * m1, 0.0)) / cell
    drawn = np.append((n_ground >= rules.min_ground) & (spread <= rules.rough) & (n_up / n_points <= rules.above), False)

    # two faces a block: south-west, south-east, north-east and south-west, north-east, north-west
    q = np.flatnonzero(full)
    fs, west, north = cs[q], x0[cs[q]] + (cj[q] + 0.5) * cell, y1[cs[q]] - (ci[q] + 0.5) * cell
    east, south = x0[fs] + (cj[q] + 1 + 0.5) * cell, y1[fs] - (ci[q] + 1 + 0.5) * cell
    at = {"sw": (west, south, sw[q]), "se": (east, south, se[q]), "ne": (east, north, ne[q]), "nw": (west, north, nw[q])}
    a, b, c = (tuple(np.concatenate([at[p][k], at[r][k]]) for k in range(3)) for p, r in (("sw", "sw"), ("se", "ne"), ("ne", "nw")))
    fs, place, half = np.tile(fs, 2), np.tile(q, 2), np.repeat([0, 1], len(q))
    edge = lambda p, r: np.sqrt((r[0] - p[0]) * (r[0] - p[0]) + (r[1] - p[1]) * (r[1] - p[1]) + (r[2] - p[2]) * (r[2] - p[2]))
    longest = np.maximum(np.maximum(edge(a, b), edge(b, c)), edge(c, a))
    mx, my, mz = ((a[k] + b[k] + c[k]) / 3 for k in range(3))

    # a scene's median edge: its faces in order of length
    faces = np.bincount(fs, minlength=len(scenes))
    start = np.cumsum(faces) - faces
    ordered = longest[np.lexsort((longest, fs))]
    p = 0.5 * np.maximum(faces - 1, 0).astype(float)
    lo = np.where(faces > 0, start + _whole(p), 0)
    hi = np.where(faces > 0, np.minimum(start + _whole(p) + 1, start + faces - 1), 0)
    if not len(ordered):
        return none
    median = ordered[lo] + (ordered[hi] - ordered[lo]) * (p - np.floor(p))

    # every point is a texel of one of its cell's two faces
    texel = 2 * cells.of + (kind >> 2 & 1)
    texels, direct = (np.bincount(texel[m], minlength=2 * len(cells)) for m in (slice(None), kind & 2 > 0))
    face = 2 * place + half
    share = np.where(texels[face] > 0, direct[face] / np.maximum(texels[face], 1), 0.0)

    on_ground = np.abs(mz - ground_at(fs, mx, my)) <= rules.ground_cells * cell
    in_block = drawn[blocks.find(fs, _whole((y1[fs] - my) / size), _whole((mx - x0[fs]) / size))]
    seen, whole = share >= rules.painted, longest <= rules.shard * median[fs]
    have = np.flatnonzero(faces)
    per = lambda mask: np.bincount(fs[mask], minlength=len(scenes))[have]
    got = dict(zip(COUNTS, (faces[have], per(on_ground & in_block & seen & whole), per(~on_ground), per(~in_block), per(~seen), per(~whole))))
    return pa.table({"scene_id": pa.array(scenes[have], t.schema.field("scene_id").type), **{c: pa.array(v, pa.int64()) for c, v in got.items()}})
