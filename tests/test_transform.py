"""Splats in site axes: covariance and colour go with the frame of each scene."""

import numpy as np
import pytest

from groundloom.functions import geometry as g, harmonics
from groundloom.operators import splats as ops
from groundloom.operators import transform


def rotation(q):
    w, x, y, z = np.asarray(q) / np.linalg.norm(q)
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


@pytest.mark.parametrize("degree", [1, 3])
def test_covariance_and_colour(spark, degree):
    r = np.random.default_rng(8)
    n = 3 * ((degree + 1) ** 2 - 1)
    frames = {k: (float(r.uniform(0.2, 3)) * rotation(q), r.normal(size=3)) for k, q in enumerate([(1, 0, 0, 0), (0, 1, 0, 0), *r.normal(size=(3, 4))])}
    rows = [(k % 5, k, *r.normal(size=3).tolist(), *r.uniform(-3, 0, 3).tolist(), *r.normal(size=4).tolist(), *r.normal(size=3).tolist(), r.normal(size=n).tolist(), "kept") for k in range(60)]
    s = spark.createDataFrame(rows, "scene_id int, splat_id long, x double, y double, z double, ls0 double, ls1 double, ls2 double, rw double, rx double, ry double, rz double, dc0 double, dc1 double, dc2 double, f_rest array<double>, note string")
    f = spark.createDataFrame([(k, *A.ravel().tolist(), *t.tolist()) for k, (A, t) in frames.items()], "scene_id int, " + ", ".join(f"{e} double" for e in transform.ENTRIES) + ", t0 double, t1 double, t2 double")
    look = r.normal(size=3)
    look /= np.linalg.norm(look)

    def seen(df, turn):
        d = {k: (A / np.cbrt(np.linalg.det(A))) @ look if turn else look for k, (A, _) in frames.items()}
        e = spark.createDataFrame([(k, *v.tolist()) for k, v in d.items()], "scene_id int, a double, b double, c double")
        df = ops.covariance(g.with_rotation(harmonics.colour(df.join(e, "scene_id"), ("a", "b", "c"), ["dc0", "dc1", "dc2"], "f_rest", degree), ("rw", "rx", "ry", "rz")))
        return {x.splat_id: x for x in df.collect()}

    before, after = seen(s, False), seen(transform.to_site(s, f, degree), True)
    assert len(after) == 60
    for i, b in before.items():
        A, t = frames[b.scene_id]
        a = after[i]
        assert np.allclose([a.x, a.y, a.z], A @ [b.x, b.y, b.z] + t, atol=1e-12)
        sym = lambda v: np.array([[v.c00, v.c01, v.c02], [v.c01, v.c11, v.c12], [v.c02, v.c12, v.c22]])
        assert np.allclose(sym(a), A @ sym(b) @ A.T, atol=1e-9)
        assert np.allclose([a.red, a.green, a.blue], [b.red, b.green, b.blue], atol=1e-9) and a.note == "kept"


def test_mirrors_are_refused(spark):
    f = spark.createDataFrame([(7, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, -1.0)], "scene_id int, " + ", ".join(f"{e} double" for e in transform.ENTRIES))
    with pytest.raises(Exception, match="scene 7 mirrors"):
        transform.solved_frames(f).collect()
