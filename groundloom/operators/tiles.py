"""Iterative raster stencils in rounds over tiles with halos.

Each round copies a tile's surroundings (its halo) to it, runs sweeps on the dense tile and keeps
the tile's own cells. Scenes of one tile are stacked, many to a group. K sweeps of reach r are exact with a halo of K*r, so N sweeps cost N*r/halo shuffles
instead of N. A tile is at most (TILE + 2*HALO)^2 cells, whatever the scene's size. Scenes that fit
one tile finish in one round.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from groundloom.session import cut_lineage

TILE, HALO = 256, 48
#: Cells that one group of small scenes holds at about, cells of the stacked tiles that a kernel takes at once, and the step of their sides.
GROUP, STACK, ROUND = 1 << 18, 1 << 16, 8
Arrays = dict[str, np.ndarray]


class Frame:
    """Where dense tiles of one shape sit in their scenes: cell (k, r, c) is cell (i0[k] + r, j0[k] + c) of tile k's scene."""

    def __init__(self, i0: np.ndarray, j0: np.ndarray, shape: tuple[int, int], ny: np.ndarray, nx: np.ndarray, present: np.ndarray):
        self.i0, self.j0, self.shape, self.ny, self.nx, self.present = i0, j0, shape, ny, nx, present

    def sides(self) -> dict[tuple[int, int], np.ndarray]:
        """Where the neighbour in each of the four directions lies beyond the scene's raster."""
        rows, cols = self.i0[:, None] + np.arange(self.shape[0]), self.j0[:, None] + np.arange(self.shape[1])
        return {(-1, 0): (rows == 0)[:, :, None], (1, 0): (rows == self.ny[:, None] - 1)[:, :, None],
                (0, -1): (cols == 0)[:, None, :], (0, 1): (cols == self.nx[:, None] - 1)[:, None, :]}


def shifted(a: np.ndarray, di: int, dj: int, fill: float = np.nan) -> np.ndarray:
    """a[..., i + di, j + dj] at (..., i, j)."""
    out = np.full(a.shape, fill, dtype=a.dtype)
    h, w = a.shape[-2:]
    out[..., max(0, -di):h - max(0, di), max(0, -dj):w - max(0, dj)] = a[..., max(0, di):h - max(0, -di), max(0, dj):w - max(0, -dj)]
    return out


def rounds(cells: DataFrame, values: list[str], kernel: Callable[[Arrays, Frame, int | None], Arrays], reach: int = 1,
           sweeps: int | None = None, tile: int = TILE, halo: int = HALO, monotone: bool = False) -> DataFrame:
    """Run ``kernel`` over the scenes' rasters; the result does not depend on ``tile`` and ``halo``.

    ``cells`` has scene_id, i, j, ny, nx and double ``values``. With ``sweeps`` the kernel is run for exactly that
    many; without, rounds go on until no tile changes. A ``monotone`` update may then repeat until its tile is still:
    whatever it took from a cut-off halo is bettered later. Any other is held to the sweeps for which the halo is wide
    enough, since what it fills stays. Tiles far from any change stay out of the later rounds.
    """
    size = cells.agg(F.max("ny").alias("h"), F.max("nx").alias("w"), F.count(F.lit(1)).alias("n")).first()
    if size["h"] is None:
        return cells
    single = size["h"] <= tile and size["w"] <= tile
    buckets = max(cells.sparkSession.sparkContext.defaultParallelism, -(-size["n"] // GROUP))
    pad = 0 if single else halo
    schema = "scene_id int, i bigint, j bigint, ny bigint, nx bigint, " + ", ".join(f"{v} double" for v in values) + ", changed boolean"
    left = sweeps
    state = cells.select("scene_id", "i", "j", "ny", "nx", *values)
    within = max(1, halo // reach)
    about = -(-halo // tile)  # tiles in reach of a tile's halo
    span = range(-about, about + 1)
    tile_of = [F.floor(F.col(c) / tile).alias(t) for c, t in (("i", "_ti"), ("j", "_tj"))]
    active = None
    while True:
        if single:
            take = left
        elif left is None:
            take = None if monotone else within
        else:
            take = min(left, within)

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            """Tiles of like shape are stacked, so that a sweep is one step over all of them; still tiles stay as they are."""
            of = rows.groupby(["scene_id", "_ti", "_tj"], sort=False, dropna=False).ngroup().to_numpy()
            order = np.argsort(of, kind="stable")
            rows, of = rows.iloc[order], of[order]
            first = np.flatnonzero(np.diff(of, prepend=-1))
            i, j = rows["i"].to_numpy(), rows["j"].to_numpy()
            lows = [np.minimum.reduceat(c, first) for c in (i, j)]
            spans = [np.maximum.reduceat(c, first) - low + 1 for c, low in zip((i, j), lows)]
            own = (i // tile == rows["_ti"].to_numpy()) & (j // tile == rows["_tj"].to_numpy())
            was = {v: rows[v].to_numpy() for v in values}
            now = {v: np.empty(len(rows)) for v in values}
            room = np.stack([-(-n // ROUND) * ROUND for n in spans], axis=1)
            ends = np.append(first, len(rows))
            for shape in np.unique(room, axis=0):
                alike = np.flatnonzero((room == shape).all(axis=1))
                most = max(1, STACK // int(shape.prod()))
                for part in (alike[k:k + most] for k in range(0, len(alike), most)):
                    pick = np.concatenate([np.arange(ends[k], ends[k + 1]) for k in part])
                    layer = np.repeat(np.arange(len(part)), ends[part + 1] - ends[part])
                    at = (layer, i[pick] - lows[0][part][layer], j[pick] - lows[1][part][layer])
                    size3 = (len(part), *map(int, shape))
                    dense: Arrays = {v: np.full(size3, np.nan) for v in values}
                    for v in values:
                        dense[v][at] = was[v][pick]
                    present = np.zeros(size3, bool)
                    present[at] = True
                    ny, nx = (rows[c].to_numpy()[first[part]] for c in ("ny", "nx"))
                    new = kernel(dense, Frame(lows[0][part], lows[1][part], size3[1:], ny, nx, present), take)
                    for v in values:
                        now[v][pick] = new[v][at]
            out = rows.loc[own, ["scene_id", "i", "j", "ny", "nx"]].copy()
            changed = np.zeros(int(own.sum()), bool)
            for v in values:
                a, b = was[v][own], now[v][own]
                out[v] = b
                changed |= ~((a == b) | (np.isnan(a) & np.isnan(b)))
            out["changed"] = changed
            return out

        near = lambda c: F.sequence(F.floor((F.col(c) - pad) / tile), F.floor((F.col(c) + pad) / tile))
        spread = state.withColumn("_ti", F.explode(near("i"))).withColumn("_tj", F.explode(near("j")))
        if active is not None:
            spread = spread.join(active, ["scene_id", "_ti", "_tj"], "left_semi")
        # a bucket holds about GROUP cells of whole tiles; tiles that are large already have one each
        deal = F.pmod(F.xxhash64("scene_id", "_ti", "_tj"), F.lit(buckets))
        done = spread.withColumn("_b", deal).repartition(buckets, "_b").groupBy("_b", *([] if single else ["scene_id", "_ti", "_tj"])).applyInPandas(run, schema)
        # Arrow brings NaN; the tables use NULL
        done = done.select("scene_id", "i", "j", "ny", "nx", *[F.nanvl(F.col(v), F.lit(None).cast("double")).alias(v) for v in values], "changed")
        if active is not None:
            still = state.select("*", *tile_of).join(active, ["scene_id", "_ti", "_tj"], "left_anti").drop("_ti", "_tj")
            done = done.unionByName(still.withColumn("changed", F.lit(False)))
        state = cut_lineage(done)
        if left is not None:
            left -= take
            if left <= 0:
                break
        elif single or state.where("changed").isEmpty():
            break
        else:
            moved = state.where("changed").select("scene_id", *tile_of).distinct()
            steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in span for b in span]))
            active = cut_lineage(moved.withColumn("_o", steps).select("scene_id", (F.col("_ti") + F.col("_o.a")).alias("_ti"), (F.col("_tj") + F.col("_o.b")).alias("_tj")).distinct())
        state = state.drop("changed")
    return state.drop("changed")


# --- kernels


def spread_min(steps: list[tuple[int, int]]):
    """Smallest value of each connected patch (monotone)."""

    def kernel(a: Arrays, f: Frame, _: int | None) -> Arrays:
        label = np.where(f.present, a["label"], np.inf)
        while True:
            new = label
            for di, dj in steps:
                new = np.minimum(new, shifted(label, di, dj, np.inf))
            new = np.where(f.present, new, np.inf)
            if np.array_equal(new, label):
                return {"label": np.where(f.present, label, np.nan)}
            label = new

    return kernel


def fill_from_rims(a: Arrays, f: Frame, sweeps: int | None) -> Arrays:
    """Empty hole cells (hole = 1, z NaN) take the mean of their filled 4-neighbours, rim by rim."""
    z, hole = a["z"], a["hole"] > 0
    for _ in range(sweeps if sweeps is not None else 1 << 30):
        around = [shifted(z, *s) for s in ((-1, 0), (1, 0), (0, -1), (0, 1))]
        n = sum(np.isfinite(x).astype(float) for x in around)
        total = sum(np.where(np.isfinite(x), x, 0.0) for x in around)
        can = hole & np.isnan(z) & (n > 0)
        if not can.any():
            break
        z = np.where(can, total / np.maximum(n, 1), z)
    return {"z": z, "hole": a["hole"]}


def fill_around(a: Arrays, f: Frame, sweeps: int | None) -> Arrays:
    """Empty cells take the mean of their filled 8-neighbours, level by level from the edge of each hole."""
    z = a["z"]
    ring = [(di, dj) for di in (-1, 0, 1) for dj in (-1, 0, 1) if di or dj]
    for _ in range(sweeps if sweeps is not None else 1 << 30):
        around = [shifted(z, *s) for s in ring]
        n = sum(np.isfinite(x).astype(float) for x in around)
        total = sum(np.where(np.isfinite(x), x, 0.0) for x in around)
        can = f.present & np.isnan(z) & (n > 0)
        if not can.any():
            break
        z = np.where(can, total / np.maximum(n, 1), z)
    return {"z": z}


def relax(a: Arrays, f: Frame, sweeps: int | None) -> Arrays:
    """Hole cells become the mean of their four neighbours; a neighbour beyond the raster's edge is the cell itself."""
    shape, at = a["z"].shape, np.flatnonzero(a["hole"] > 0)
    z, place = np.append(a["z"].ravel(), np.nan), np.arange(a["z"].size).reshape(shape)
    # where the neighbours of each hole cell lie; absent ones are the NaN at the end
    near = [np.where(off, place, shifted(place, *s, place.size)).ravel()[at] for s, off in f.sides().items()]
    for _ in range(sweeps or 0):
        around = [z[k] for k in near]
        n = sum(np.isfinite(x).astype(float) for x in around)
        total = sum(np.where(np.isfinite(x), x, 0.0) for x in around)
        z[at] = np.where(n > 0, total / np.maximum(n, 1), 0.0)
    return {"z": z[:-1].reshape(shape), "hole": a["hole"]}


def patches(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set cells of stacked masks as flat positions, and for each the number of its 8-connected patch (its first cell's place in the list)."""
    at = np.flatnonzero(mask)
    place = np.full(mask.shape, -1)
    place.ravel()[at] = np.arange(len(at))
    pairs = []
    for step in ((0, 1), (1, -1), (1, 0), (1, 1)):
        other = shifted(place, *step, -1).ravel()[at]
        pairs.append(np.stack([np.flatnonzero(other >= 0), other[other >= 0]]))
    a, b = np.concatenate(pairs, axis=1)
    label = np.arange(len(at))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if np.array_equal(new, label):
            return at, label
        label = new


def outstanding(z: np.ndarray, most: float, largest: int) -> np.ndarray:
    """Cells of 8-connected groups of at most ``largest`` that stand more than ``most`` above (or are sunk below) every cell around them.

    Candidates differ by more than ``most`` from the median of the measured cells among the 24 around them. A cell's verdict depends on the
    cells up to ``largest`` + 2 away.
    """
    ring = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if (a, b) != (0, 0)]
    around = np.sort(np.stack([shifted(z, *s) for s in ring], axis=-1), axis=-1)  # NaN comes last
    n = (~np.isnan(around)).sum(-1)
    pick = lambda k: np.take_along_axis(around, k[..., None], -1)[..., 0]
    dev = z - (0.5 * pick(np.maximum(n - 1, 0) // 2) + 0.5 * pick(np.minimum(n // 2, len(ring) - 1)))
    holes = np.zeros(z.shape, bool)
    place = np.arange(z.size).reshape(z.shape)
    for sign in (1, -1):
        at, label = patches(dev * sign > most)
        fits = (np.bincount(label, minlength=len(at)) <= largest)[label]
        at, label = at[fits], label[fits]
        own = np.full(z.size + 1, -1)
        own[at] = label
        height = np.append(z.ravel() * sign, np.nan)
        low, top = np.full(z.size, np.inf), np.full(z.size, -np.inf)
        np.minimum.at(low, label, height[at])
        for s in ((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b):
            k = shifted(place, *s, z.size).ravel()[at]
            outside = (own[k] != label) & ~np.isnan(height[k])
            np.maximum.at(top, label[outside], height[k[outside]])
        stands = (top[label] > -np.inf) & (low[label] - top[label] > most)
        holes.ravel()[at[stands]] = True
    return holes


def refill_outliers(most: float, largest: int, passes: int, sweeps: int):
    """Outstanding groups are emptied and filled from around them, until none is left or ``passes`` times; whole scenes only. ``times`` counts
    how often a cell was emptied."""

    def kernel(a: Arrays, f: Frame, _: int | None) -> Arrays:
        z, times, todo = a["z"].copy(), a["times"].copy(), np.arange(len(a["z"]))
        for _ in range(passes):
            holes = outstanding(z[todo], most, largest)
            hit = holes.any(axis=(1, 2))
            todo, holes = todo[hit], holes[hit]
            if not len(todo):
                break
            part = Frame(f.i0[todo], f.j0[todo], f.shape, f.ny[todo], f.nx[todo], f.present[todo])
            empty = {"z": np.where(holes, np.nan, z[todo]), "hole": holes.astype(float)}
            z[todo] = relax(fill_from_rims(empty, part, None), part, sweeps)["z"]
            times[todo] += holes
        return {"z": z, "times": times}

    return kernel


def mark_outliers(most: float, largest: int):
    """``mark``: 2 for cells of outstanding groups, 1 for the cells around them, 0 for others."""

    def kernel(a: Arrays, f: Frame, _: int | None) -> Arrays:
        holes = outstanding(a["z"], most, largest)
        beside = np.zeros(holes.shape, bool)
        for s in ((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b):
            beside |= shifted(holes, *s, False)
        return {"z": a["z"], "mark": np.where(holes, 2.0, np.where(beside, 1.0, 0.0))}

    return kernel


def drain(a: Arrays, f: Frame, _: int | None) -> Arrays:
    """Lowest water level that still runs off to the rim: w = z where z is above its lowest neighbour's w, else that
    neighbour's w plus eps (monotone; rim cells start at z, others at infinity)."""
    z, eps = a["z"], a["eps"]
    w = np.where(np.isnan(a["w"]), np.inf, a["w"])
    fixed = a["rim"] > 0
    while True:
        low = np.full(w.shape, np.inf)
        for di in (-1, 0, 1):
            for dj in (-1, 0, 1):
                if di or dj:
                    low = np.minimum(low, shifted(w, di, dj, np.inf))
        new = np.where(fixed | ~f.present, w, np.minimum(w, np.where(z > low, z, low + eps)))
        if np.array_equal(new, w):
            return {**a, "w": np.where(np.isfinite(w), w, np.nan)}
        w = new


def drape(rigidness: int):
    """Cloth iterations: sink by ``drop``, stop at the floor, then smooth ``rigidness`` times (edge cells are
    never smoothed)."""

    def kernel(a: Arrays, f: Frame, sweeps: int | None) -> Arrays:
        cloth, floor, drop = a["cloth"], a["floor"], a["drop"]
        north, south, west, east = f.sides().values()
        inner = ~(north | south | west | east)
        for _ in range(sweeps or 0):
            cloth = np.maximum(cloth - drop, floor)
            for _ in range(rigidness):
                mean = 0.25 * (shifted(cloth, -1, 0) + shifted(cloth, 1, 0) + shifted(cloth, 0, -1) + shifted(cloth, 0, 1))
                cloth = np.maximum(np.where(inner, mean, cloth), floor)
        return {**a, "cloth": cloth}

    return kernel
