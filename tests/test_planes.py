"""Votes by bounds on voxels equal counting every point for every hypothesis."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from groundloom.operators import planes


def test_votes_are_exact(spark):
    r = np.random.default_rng(1)
    parts = []
    for scene, n in ((0, 3000), (1, 49), (2, 400), (3, 60)):
        p = r.uniform(-5, 5, (n, 3)) * [1, 1, 0.4]
        k = n // 2
        p[:k, 2] = 0.2 * p[:k, 0] - 0.1 * p[:k, 1] + r.normal(size=k) * 0.05
        if scene == 3:
            p[:] = p[0]  # all in one place: no hypothesis
        parts.append(pd.DataFrame({"scene_id": np.int32(scene), "point_id": r.permutation(n).astype(np.int64), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]}))
    df = pd.concat(parts)
    points = spark.createDataFrame(df).repartition(5)
    size = planes.extents(points, 0.02)
    hyp = planes.hypotheses(points.join(size.select("scene_id"), "scene_id", "left_semi"), 100, F.col("point_id"))
    tol = {x.scene_id: x.tol for x in size.collect()}
    assert set(tol) == {0, 2, 3}
    want = {}
    for h in hyp.collect():
        own = df[df["scene_id"] == h.scene_id]
        v = int((np.abs(own["x"] * h.nx + own["y"] * h.ny + own["z"] * h.nz - h.d) < tol[h.scene_id]).sum())
        want[h.scene_id] = max(want.get(h.scene_id, (0, 0)), (v, -h.k))
    got = {x.scene_id: (x.votes, -x.k) for x in planes.votes(points, hyp, size).collect()}
    assert got == want and set(want) == {0, 2}
    # the refit is the smallest principal axis of the points near the plane
    first = planes.votes(points, hyp, size)
    b = {x.scene_id: x for x in first.collect()}
    for x in planes.refitted(points, first, size).collect():
        own, h = df[df["scene_id"] == x.scene_id][["x", "y", "z"]].to_numpy(), b[x.scene_id]
        near = own[np.abs(own @ [h.nx, h.ny, h.nz] - h.d) < tol[x.scene_id]]
        n = np.linalg.eigh(np.cov((near - near.mean(0)).T))[1][:, 0]
        n = n if n[2] >= 0 else -n
        assert np.allclose([x.nx, x.ny, x.nz, x.d], [*n, n @ near.mean(0)], atol=1e-6)


def test_votes_add_up_over_parts_and_blocks(spark, monkeypatch):
    """Points and hypotheses dealt into several groups each: the same votes as in one group, and as by counting all pairs."""
    r = np.random.default_rng(2)
    df = pd.concat([pd.DataFrame({"scene_id": np.int32(s), "point_id": np.arange(n), **{a: r.uniform(-3, 3, n) for a in "xyz"}}) for s, n in ((0, 700), (1, 60))])
    points = spark.createDataFrame(df)
    size = planes.extents(points, 0.02)
    hyp = planes.hypotheses(points, 40, F.col("point_id")).localCheckpoint()
    whole = {tuple(x) for x in planes.votes(points, hyp, size).collect()}
    monkeypatch.setattr(planes, "PART", 100)
    monkeypatch.setattr(planes, "BLOCK", 7)
    assert {tuple(x) for x in planes.votes(points, hyp, size).collect()} == whole
    pairs = hyp.join(size, "scene_id").join(points, "scene_id").where("abs(x*nx+y*ny+z*nz-d) < tol").groupBy("scene_id", "k").count().groupBy("scene_id").agg(F.max("count").alias("n"))
    assert {(x.scene_id, x.n) for x in pairs.collect()} == {(x[0], x[6]) for x in whole}


def test_every_scene_has_all_trials(spark):
    """600 trials in a scene of any size from 50 points on; only those whose points coincide or lie on a line are lost."""
    r = np.random.default_rng(3)
    df = pd.concat([pd.DataFrame({"scene_id": np.int32(s), "point_id": r.permutation(n).astype(np.int64), **{a: r.uniform(-3, 3, n) for a in "xyz"}}) for s, n in ((0, 2500), (1, 50), (2, 400))])
    hyp = planes.hypotheses(spark.createDataFrame(df).repartition(3), planes.TRIALS, F.col("point_id")).toPandas()
    n = hyp.groupby("scene_id")["k"].nunique()
    assert planes.TRIALS == 600 and n[0] == 600 and n[1] > 540 and n[2] > 590
    distinct = hyp[["scene_id", "nx", "ny", "nz", "d"]].round(9).drop_duplicates().groupby("scene_id").size()
    assert distinct[1] > 530 and distinct[2] > 585
    # each plane runs through three points of its scene
    for s, h in hyp.groupby("scene_id"):
        p, v = df[df["scene_id"] == s][["x", "y", "z"]].to_numpy(), h[["nx", "ny", "nz"]].to_numpy()
        assert ((np.abs(p @ v.T - h["d"].to_numpy()) < 1e-9).sum(0) >= 3).all()


def test_dominant_plane_of_small_scenes_matches_sql(spark, tmp_path):
    import duckdb

    from groundloom.plans import catalog
    from groundloom.plans.verify import differences

    catalog.load()
    rows = pd.read_parquet("/root/testdata/sf0.001/lineitem.parquet").head(700)
    rows["l_suppkey"] = [0] * 60 + [5] * 49 + [10] * 591
    rows.to_parquet(tmp_path / "lineitem.parquet", coerce_timestamps="us")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    for name in ("dominant_plane", "plane_votes"):
        got = catalog.QUERIES[name](spark, str(tmp_path)).toPandas()
        assert sorted(got["scene_id"]) == [0, 2]
        assert differences(got, con.execute(catalog.ORACLES[name]).df()) is None
