"""Splats moved by their scene's own similarity: positions, normals, sizes, orientations and view-dependent colour."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from groundloom.functions import geometry as g
from groundloom.functions.harmonics import rotation_matrix

AX = ("x", "y", "z")
ENTRIES = [f"a{r}{c}" for r in range(3) for c in range(3)]
SOLVED = "scale double, " + ", ".join(f"r{r}{c} double" for r in range(3) for c in range(3)) + ", bands array<array<array<double>>>"


def solved_frames(frames: DataFrame, degree: int = 3) -> DataFrame:
    """``frames`` (scene_id, a00..a22, t0..t2: p' = A p + t) with ``scale`` (the cube root of det A), the rotation r00..r22 = A / scale, and
    ``bands``: for each colour band the matrix, by columns, that takes its coefficients to those of the turned scene.

    One small solve a scene, in batches. A mirrored or flat A (det <= 0) has no rotation: an error names the scene.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frames.schema) + ", " + SOLVED

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            A = x[ENTRIES].to_numpy(float).reshape(-1, 3, 3)
            det = np.linalg.det(A)
            if (det <= 0).any():
                raise ValueError(f"the frame of scene {x['scene_id'].iloc[int(det.argmin())]} mirrors or flattens")
            scale = np.cbrt(det)
            R = A / scale[:, None, None]
            out = x.assign(scale=scale, **{f"r{r}{c}": R[:, r, c] for r in range(3) for c in range(3)})
            out["bands"] = [bands_of(m, degree) for m in R]
            yield out

    return frames.mapInPandas(solve, schema)


def bands_of(R: np.ndarray, degree: int = 3) -> list[list[list[float]]]:
    """Blocks of the coefficient matrix of one rotation, each as a list of columns."""
    whole, out, first = np.asarray(rotation_matrix(R, degree)), [], 0
    for band in range(1, degree + 1):
        s = slice(first, first + 2 * band + 1)
        out.append(whole[s, s].T.tolist())
        first = s.stop
    return out


def turned(rest: Column, bands: Column, degree: int = 3) -> Column:
    """Channel-major coefficients through the band matrices of the row's scene."""
    n = (degree + 1) ** 2 - 1
    parts, first = [], {b: b * b - 1 for b in range(1, degree + 1)}
    for channel in range(3):
        for b in range(1, degree + 1):
            own = F.slice(rest, channel * n + first[b] + 1, 2 * b + 1)
            parts.append(F.transform(F.get(bands, b - 1), _product(own)))
    return F.concat(*parts)


def _product(own: Column):
    return lambda column: F.aggregate(F.zip_with(own, column, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def to_site(splats: DataFrame, frames: DataFrame, degree: int = 3) -> DataFrame:
    """``splats`` (scene_id, x, y, z, ls0..ls2, rw, rx, ry, rz; nx, ny, nz and f_rest where present) in the axes of their scene's frame.

    Positions take the whole of A and t; normals its rotation; log sizes grow by ln(scale); orientations are multiplied from the left; colour
    coefficients turn by band, so that a splat looks from a turned direction as it did before. Other columns stay. Splats of scenes
    without a frame are left out.
    """
    solved = solved_frames(frames, degree)
    own = [*ENTRIES, "t0", "t1", "t2", "scale", *[f"r{r}{c}" for r in range(3) for c in range(3)], "bands"]
    f = solved.select("scene_id", F.struct(*own).alias("_f"))
    s = splats.join(f, "scene_id")
    entry = lambda p, r, c: F.col(f"_f.{p}{r}{c}")
    times = lambda p, r, v: entry(p, r, 0) * F.col(v[0]) + entry(p, r, 1) * F.col(v[1]) + entry(p, r, 2) * F.col(v[2])
    new = {a: times("a", r, AX) + F.col(f"_f.t{r}") for r, a in enumerate(AX)}
    normals = [c for c in ("nx", "ny", "nz") if c in splats.columns]
    if normals:
        new |= {c: times("r", r, normals) for r, c in enumerate(normals)}
    new |= {f"ls{k}": F.col(f"ls{k}") + F.log("_f.scale") for k in range(3)}
    q = g.quaternion([[entry("r", r, c) for c in range(3)] for r in range(3)])
    new |= dict(zip(("rw", "rx", "ry", "rz"), g.quaternion_product(q, [F.col(c) for c in ("rw", "rx", "ry", "rz")]), strict=True))
    if "f_rest" in splats.columns:
        new["f_rest"] = turned(F.col("f_rest"), F.col("_f.bands"), degree)
    return s.withColumns(new).select(*splats.columns)
