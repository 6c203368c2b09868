"""How high the camera was held: below the walk, else around the first camera, else zero."""

import duckdb
import numpy as np
import pandas as pd

from groundloom.operators import walk
from groundloom.plans import catalog
from groundloom.plans.verify import differences

catalog.load()


def test_each_source(spark):
    r = np.random.default_rng(5)
    clouds, frames, want = [], [], {}
    for scene, (n, shift, z) in enumerate([(4000, 0, 0.0), (4000, 100, 0.0), (49, 100, 0.0), (200, 100, 9.0), (0, 0, 0.0)]):
        p = np.c_[r.uniform(-5, 5, (n, 2)) + [shift, 0], z + r.uniform(-1, 1, n)]
        cams = np.c_[np.linspace(-4, 4, 20), np.zeros(20), 1.5 + 0.01 * np.arange(20)]
        clouds.append(pd.DataFrame({"scene_id": np.int32(scene), "point_id": r.permutation(n).astype(np.int64), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]}))
        frames.append(pd.DataFrame({"scene_id": np.int32(scene), "frame": np.arange(20, dtype=np.int64) + 1, "px": cams[:, 0], "py": cams[:, 1], "pz": cams[:, 2]}))
        near = [p[np.hypot(p[:, 0] - c[0], p[:, 1] - c[1]) < 0.08 * 8, 2] for c in cams]
        heights = [c[2] - np.percentile(k, 10) for c, k in zip(cams, near) if len(k) >= 30]
        low = p[np.argsort(np.hypot(*(p[:, :2] - cams[0, :2]).T))[:3000], 2] - cams[0, 2]
        low = low[low < 0]
        if len(heights) >= 3:
            want[scene] = (len(heights), float(np.median(heights)), "below the walk")
        elif len(low) >= 50:
            want[scene] = (len(heights), -float(np.percentile(low, 5)), "around the first camera")
        else:
            want[scene] = (len(heights), 0.0, "none")
    assert [w[2] for w in want.values()] == ["below the walk", "around the first camera", "none", "none", "none"]
    got = walk.held_height(spark.createDataFrame(pd.concat(clouds)), spark.createDataFrame(pd.concat(frames))).collect()
    assert {x.scene_id: (x.frames, round(x.held, 9), x.source) for x in got} == {k: (f, round(h, 9), s) for k, (f, h, s) in want.items()}


def test_radius_ground_of_thin_scenes_matches_sql(spark, tmp_path):
    rows = pd.read_parquet("/root/testdata/sf0.001/lineitem.parquet")
    rows["l_suppkey"] = [0] * 200 + [5] * 30 + [10] * (len(rows) - 230)
    rows.to_parquet(tmp_path / "lineitem.parquet", coerce_timestamps="us")
    events = pd.read_parquet("/root/testdata/sf0.001/events.parquet")
    events = pd.concat([events.head(1000), events.head(500).assign(event_id=np.arange(500) + 1000), events.head(500).assign(event_id=np.arange(500) + 1500)])
    events.to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    con = duckdb.connect()
    for t in ("lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = catalog.QUERIES["radius_ground"](spark, str(tmp_path)).toPandas()
    assert set(got["source"]) == {"below the walk", "around the first camera", "none"} and len(got) == 4 and got["held"].notna().all()
    assert differences(got, con.execute(catalog.ORACLES["radius_ground"]).df()) is None
