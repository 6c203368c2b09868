"""Rays against ellipsoids: the voxel walk finds what comparing every ray with every splat finds."""

import numpy as np
import pytest

from groundloom.functions import geometry as g
from groundloom.operators import picking


def brute(splats, rays, sigmas):
    out = {}
    for scene, ray, *v in rays:
        o, d = np.array(v[:3]), np.array(v[3:])
        best = None
        for s, i, x, y, z, l0, l1, l2, w, qx, qy, qz, logit in splats:
            if s != scene or logit < 0:
                continue
            n = np.sqrt(w * w + qx * qx + qy * qy + qz * qz)
            w_, a, b, c = w / n, qx / n, qy / n, qz / n
            R = np.array([[1 - 2 * (b * b + c * c), 2 * (a * b - w_ * c), 2 * (a * c + w_ * b)], [2 * (a * b + w_ * c), 1 - 2 * (a * a + c * c), 2 * (b * c - w_ * a)], [2 * (a * c - w_ * b), 2 * (b * c + w_ * a), 1 - 2 * (a * a + b * b)]])
            sig = np.exp([l0, l1, l2])
            p, q = R.T @ (o - [x, y, z]) / sig, R.T @ d / sig
            A, B, C = q @ q, p @ q, p @ p - sigmas**2
            if B * B - A * C < 0:
                continue
            t = [(-B + k * np.sqrt(B * B - A * C)) / A for k in (-1, 1)]
            t = [x for x in t if x >= 0]
            if t and (best is None or (t[0], i) < best):
                best = (t[0], i)
        if best:
            out[scene, ray] = best
    return out


@pytest.mark.parametrize("reach", [1, 16])
def test_first_hit(spark, reach):
    r = np.random.default_rng(4)
    splats, rays = [], []
    for scene, n in ((1, 400), (2, 1), (3, 60)):
        for i in range(n):
            big = 2.0 if i % 40 == 7 else 0.0  # some reach over many voxels
            splats.append((scene, i, *r.uniform(-10, 10, 3).tolist(), *(r.uniform(-4, -1, 3) + big).tolist(), *r.normal(size=4).tolist(), float(r.uniform(-1, 3))))
        for k in range(60):
            d = np.eye(3)[k % 3] * (1 if k % 2 else -1) if k < 12 else r.normal(size=3)
            o = r.uniform(-14, 14, 3) if k < 50 else np.array(splats[-1][2:5])  # from outside, between, and inside a splat
            rays.append((scene, k, *o.tolist(), *(d / np.linalg.norm(d)).tolist()))
    rays.append((9, 0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0))  # a scene without splats
    s = spark.createDataFrame(splats, "scene_id int, splat_id long, x double, y double, z double, ls0 double, ls1 double, ls2 double, rw double, rx double, ry double, rz double, opacity_logit double")
    q = spark.createDataFrame(rays, "scene_id int, ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    got = {(x.scene_id, x.ray_id): x for x in picking.ray_hits(g.with_rotation(s, ("rw", "rx", "ry", "rz")), q, reach=reach).collect()}
    want = brute(splats, rays, 3.0)
    assert set(got) == set(want) and len(want) > 25
    for k, (t, i) in want.items():
        assert got[k].splat_id == i and abs(got[k].distance - t) < 1e-9, k


@pytest.mark.parametrize("pairs", [0, 2000, 1 << 24])
def test_scenes_in_groups_and_through_voxels(spark, pairs):
    """Small scenes in arrays and larger ones through voxels have the same hits, ties by the smaller id included."""
    r = np.random.default_rng(5)
    splats, rays = [], []
    for scene, n in ((1, 80), (2, 7)):
        for i in range(n):
            v = (*r.uniform(-5, 5, 3).tolist(), *r.uniform(-3, 0, 3).tolist(), *r.normal(size=4).tolist(), 1.0)
            splats += [(scene, 2 * i + 1, *v), (scene, 2 * i, *v)]
        for k in range(40):
            d = r.normal(size=3)
            rays.append((scene, k, *r.uniform(-7, 7, 3).tolist(), *(d / np.linalg.norm(d)).tolist()))
    s = spark.createDataFrame(splats, "scene_id int, splat_id long, x double, y double, z double, ls0 double, ls1 double, ls2 double, rw double, rx double, ry double, rz double, opacity_logit double")
    q = spark.createDataFrame(rays, "scene_id int, ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    hits = picking.ray_hits(g.with_rotation(s, ("rw", "rx", "ry", "rz")), q, pairs=pairs)
    plan = hits._jdf.queryExecution().analyzed().toString()
    assert "FlatMapCoGroupsInArrow" in plan and ("lox#" in plan) == (pairs < 1 << 24)
    got, want = {(x.scene_id, x.ray_id): x for x in hits.collect()}, brute(splats, rays, 3.0)
    assert set(got) == set(want) and all(got[k].splat_id == i and abs(got[k].distance - t) < 1e-9 for k, (t, i) in want.items())
