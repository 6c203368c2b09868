"""Outstanding groups: the same as looking at every group of every raster, whole scenes or tile by tile, in few jobs."""

import numpy as np
import pandas as pd

from groundloom.operators import repair


def relaxed(z, holes):
    """Holes filled from their rims inward, then relaxed 200 times."""
    todo = holes.copy()
    pad = lambda a, **k: np.pad(a, 1, **k)
    four = lambda p: np.stack([p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])
    while todo.any():
        st = four(pad(z, constant_values=np.nan))
        can = todo & np.isfinite(st).any(0)
        if not can.any():
            break
        z[can] = np.nansum(st, 0)[can] / np.isfinite(st).sum(0)[can]
        todo &= ~can
    for _ in range(200):
        st = four(pad(z, mode="edge"))
        z[holes] = (np.nansum(st, 0) / np.maximum(np.isfinite(st).sum(0), 1))[holes]
    return z


def brute(z, most, largest=12, passes=3):
    h, w = z.shape
    z, found = z.copy(), 0
    around = lambda c, r: {(a, b) for a in range(c[0] - r, c[0] + r + 1) for b in range(c[1] - r, c[1] + r + 1) if 0 <= a < h and 0 <= b < w and np.isfinite(z[a, b])} - {c}
    for _ in range(passes):
        cells = [c for c in np.ndindex(h, w) if np.isfinite(z[c])]
        dev = {c: z[c] - np.median([z[k] for k in around(c, 2)]) for c in cells if around(c, 2)}
        holes = np.zeros(z.shape, bool)
        for sign in (1, -1):
            left = {c for c, d in dev.items() if d * sign > most}
            while left:
                group, front = set(), [left.pop()]
                while front:
                    c = front.pop()
                    group.add(c)
                    more = around(c, 1) & left
                    left -= more
                    front += more
                ring = set().union(*(around(c, 1) for c in group)) - group
                if len(group) <= largest and ring and min(z[c] * sign for c in group) - max(z[c] * sign for c in ring) > most:
                    for c in group:
                        holes[c] = True
        if not holes.any():
            break
        found += int(holes.sum())
        z[holes] = np.nan
        z = relaxed(z, holes)
    return z, found


def scenes():
    r = np.random.default_rng(4)
    out = {}
    for scene, (h, w) in enumerate([(9, 11), (20, 14), (41, 37), (13, 50)]):
        i, j = np.mgrid[:h, :w]
        z = 0.1 * i - 0.05 * j + r.normal(size=(h, w)) * 0.02
        for _ in range(h * w // 18):  # groups of all sizes, some side by side, some too large
            a, b, n, m = r.integers(0, h), r.integers(0, w), *r.integers(1, 5, 2)
            z[a:a + n, b:b + m] += r.choice([-1, 1]) * r.uniform(0.5, 4)
        z[r.random((h, w)) < 0.15] = np.nan
        out[scene] = z
    out[2][14:18, 15:18] = 9.0  # twelve cells over the corner of a tile of 16, and thirteen
    out[2][30:43, 16] = 9.0
    return out


def test_like_every_group_by_itself(spark):
    want, found = {}, 0
    rows, sizes = [], []
    for scene, z in scenes().items():
        got, n = brute(z, 0.3)
        found += n
        want |= {(scene, i, j): got[i, j] for i, j in np.argwhere(np.isfinite(z)).tolist()}
        rows += [(scene, i, j, float(z[i, j])) for i, j in np.argwhere(np.isfinite(z)).tolist()]
        sizes.append((scene, 0.0, 0.0, z.shape[1], z.shape[0]))
    grid = spark.createDataFrame(pd.DataFrame(rows, columns=["scene_id", "i", "j", "z"])).selectExpr("CAST(scene_id AS INT) AS scene_id", "i", "j", "z")
    meta = spark.createDataFrame(sizes, "scene_id int, x0 double, y1 double, nx bigint, ny bigint")
    assert found > 60
    for tile in (256, 16):  # whole scenes; all but one cut into tiles
        out, n = repair.outlier_groups(grid, meta, 0.1, tile=tile)
        got = {(x.scene_id, x.i, x.j): x.z for x in out.collect()}
        assert got.keys() == want.keys() and n == found
        assert np.allclose([got[k] for k in want], list(want.values()), atol=1e-9)


def test_small_scenes_take_few_jobs(spark):
    z = scenes()[1]
    cells = np.argwhere(np.isfinite(z)).tolist()
    grid = spark.createDataFrame([(s, i, j, float(z[i, j])) for s in range(3) for i, j in cells], "scene_id int, i bigint, j bigint, z double")
    meta = spark.createDataFrame([(s, 0.0, 0.0, z.shape[1], z.shape[0]) for s in range(3)], "scene_id int, x0 double, y1 double, nx bigint, ny bigint")
    sc = spark.sparkContext
    sc.setJobGroup("outliers", "")
    repair.outlier_groups(grid, meta, 0.1)[0].count()
    jobs = len(sc.statusTracker().getJobIdsForGroup("outliers"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs < 30, jobs
