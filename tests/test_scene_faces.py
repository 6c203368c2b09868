"""Faces judged inside groups: the same counts as from tables of cells, corners and faces, with one shuffle of the points."""

import numpy as np
import pandas as pd

from groundloom.operators import scene_faces
from groundloom.plans import catalog

catalog.load()
from groundloom.plans import meshes  # noqa: E402
from groundloom.plans.tables import Tables  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def scan(scene, n, width, depth, r, rough=0.02):
    x, y = r.uniform(-width / 2, width / 2, n), r.uniform(0, depth, n)
    standing = r.random(n) < 0.2
    z = 2 + 0.3 * x - 0.2 * y + r.normal(size=n) * rough + standing * r.uniform(0.2, 3, n)
    return pd.DataFrame({"scene_id": np.int32(scene), "point_id": r.permutation(n).astype(np.int64), "x": x, "y": y, "z": z, "is_ground": ~standing, "opacity_logit": r.normal(size=n)})


def points(spark):
    r = np.random.default_rng(8)
    df = [scan(1, 3000, 20, 14, r), scan(2, 900, 9, 30, r, 0.3), scan(3, 40, 6, 6, r), scan(5, 2000, 4, 4, r), scan(7, 1, 1, 1, r)]
    # two by two cells whose points all lie to the north-west of the cells' centres: faces, but no point over one
    corner = [(9, 0.2 * k + 0.5 * a, 5 - 0.2 * k - 0.5 * b) for a in (0, 1) for b in (0, 1) for k in (0, 1)]
    df.append(pd.DataFrame({"scene_id": np.int32(9), "point_id": np.arange(8), "x": [c[1] for c in corner], "y": [c[2] for c in corner], "z": np.arange(8) / 10, "is_ground": True, "opacity_logit": 1.0}))
    df = pd.concat(df, ignore_index=True)
    df.loc[r.choice(3000, 40, False), "z"] = None  # not measured, but seen
    rows = [tuple(None if v != v else v for v in t) for t in df.itertuples(index=False)]
    return spark.createDataFrame(rows, "scene_id int, point_id bigint, x double, y double, z double, is_ground boolean, opacity_logit double").repartition(5)


def tables(spark, df):
    t = Tables(spark, FOLDER)
    t.points, t.parts = df, 3
    return t


def test_like_on_tables(spark, monkeypatch):
    df = points(spark).localCheckpoint()
    want = {tuple(x) for x in meshes.kept_on_tables(tables(spark, df)).select("scene_id", *scene_faces.COUNTS).collect()}
    assert {x[0] for x in want} == {1, 2, 5, 9} and sum(x[2] for x in want) > 100
    got = scene_faces.counts(df, meshes.MESH_RULES, 3)
    assert {tuple(x) for x in got.collect()} == want
    # scenes of more points than a group takes go by tables, the others by groups
    assert {x.scene_id for x in scene_faces.large_scenes(df, 1500).collect()} == {1, 5}
    large = scene_faces.large_scenes
    monkeypatch.setattr(scene_faces, "large_scenes", lambda p: large(p, 1500))
    mixed = meshes.keep_as_mesh(tables(spark, df)).select("scene_id", *scene_faces.COUNTS)
    assert {tuple(x) for x in mixed.collect()} == want


def test_points_are_shuffled_once(spark):
    plan = meshes.keep_as_mesh(tables(spark, points(spark).localCheckpoint()))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
