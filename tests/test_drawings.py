"""Drawings: one face over the whole picture, nearer faces in front of it, every side."""

import numpy as np

from groundloom.operators import drawings

CORNERS = "scene_id int, fid long, " + ", ".join(f"{c}{k} double" for k in "abc" for c in "xyzrgb")


def face(scene, fid, *points, colour=(10.0, 20.0, 30.0)):
    return (scene, fid, *[float(v) for p in points for v in (*p, *colour)])


def brute(faces, axes, px):
    """Nearest face per pixel by looking at every pixel of every face."""
    sign = lambda p, a: -p["xyz".index(a[-1])] if a[0] == "-" else p["xyz".index(a[-1])]
    flat = [(f[1], [tuple(sign(f[2 + 6 * k : 5 + 6 * k], a) for a in axes) for k in range(3)], [f[5 + 6 * k : 8 + 6 * k] for k in range(3)]) for f in faces]
    u0, v1 = min(p[0] for _, c, _ in flat for p in c), max(p[1] for _, c, _ in flat for p in c)
    best = {}
    for fid, c, shade in flat:
        (ua, va), (ub, vb), (uc, vc) = [((p[0] - u0) / px, (v1 - p[1]) / px) for p in c]
        den = (ub - ua) * (vc - va) - (uc - ua) * (vb - va)
        if den == 0:
            continue
        for iu in range(int(np.ceil(min(ua, ub, uc) - 0.5)), int(np.floor(max(ua, ub, uc) - 0.5)) + 1):
            for iv in range(int(np.ceil(min(va, vb, vc) - 0.5)), int(np.floor(max(va, vb, vc) - 0.5)) + 1):
                pu, pv = iu + 0.5 - ua, iv + 0.5 - va
                l1, l2 = (pu * (vc - va) - (uc - ua) * pv) / den, ((ub - ua) * pv - pu * (vb - va)) / den
                if l1 >= -1e-9 and l2 >= -1e-9 and l1 + l2 <= 1 + 1e-9:
                    mix = lambda x, y, z: x + l1 * (y - x) + l2 * (z - x)  # noqa: E731, B023
                    key = (mix(*[p[2] for p in c]), -fid)
                    if (iu, iv) not in best or key > best[iu, iv][0]:
                        best[iu, iv] = (key, tuple(int(np.floor(mix(*[s[j] for s in shade]) + 0.5)) for j in range(3)))
    return {k: (round(v[0][0], 9), v[1]) for k, v in best.items()}


def test_every_side(spark):
    r = np.random.default_rng(6)
    faces = [face(1, 0, (0, 0, 0), (30, 0, 0), (0, 30, 1))]  # over the whole plan: many tiles
    faces += [face(1, 1 + k, *(r.uniform(0, 30, 3) + r.normal(size=(3, 3)) * 2).tolist(), colour=r.uniform(0, 255, 3).tolist()) for k in range(40)]
    faces += [face(1, 90, (5, 5, 3), (9, 5, 3), (5, 9, 3)), face(1, 91, (5, 5, 3), (9, 5, 3), (5, 9, 3), colour=(200.0, 0.0, 0.0))]  # equal depth: the smaller fid
    faces += [face(1, 92, (1, 1, 1), (2, 2, 2), (3, 3, 3))]  # a line
    df = spark.createDataFrame(faces, CORNERS)
    got = {}
    for x in drawings.drawings(df, 0.25, tile=16).collect():
        got.setdefault(x.view, {})[x.iu, x.iv] = (round(x.depth, 9), (x.r, x.g, x.b))
    assert set(got) == set(drawings.VIEWS)
    for name, axes in drawings.VIEWS.items():
        assert got[name] == brute(faces, axes, 0.25), name
    assert len(got["plan"]) > 7000


def test_textured_views(spark):
    """Every view in texture colours, in groups and on tables alike: the nearest face's texture coordinates, between four texels, grey where none is."""
    r = np.random.default_rng(9)
    rows, texels = [], []
    for scene in (1, 2):
        for fid in range(30):
            p = (r.uniform(0, 6, 3) + r.normal(size=(3, 3)) * 1.5).tolist()
            rows.append((scene, fid, *[float(x) for k in range(3) for x in (*p[k], *r.uniform(-2, 9, 2))]))  # beyond the border too
        rows.append((scene, 90, *[0.0, 0.0, 9.0, 1.0, 1.0, 3.0, 0.0, 9.0, 5.0, 1.0, 0.0, 3.0, 9.0, 1.0, 5.0]))
        rows.append((scene, 91, *[0.0, 0.0, 9.0, 7.0, 1.0, 3.0, 0.0, 9.0, 5.0, 7.0, 0.0, 3.0, 9.0, 7.0, 5.0]))  # equal depth: the smaller fid
        if scene == 1:  # the other has no texture
            texels += [(scene, a, b, *[float(v) for v in r.uniform(0, 255, 3)]) for a in range(6) for b in range(8) if r.random() < 0.8 or (a, b) == (5, 7)]
    corners = spark.createDataFrame(rows, "scene_id int, fid long, " + ", ".join(f"{c}{k} double" for k in "abc" for c in "xyzst"))
    texture = spark.createDataFrame(texels, "scene_id int, row long, col long, r double, g double, b double")
    want = {}
    for scene in (1, 2):
        tex = {(t[1], t[2]): np.array(t[3:]) for t in texels if t[0] == scene}
        rows_, cols = (max((k[0] for k in tex), default=0), max((k[1] for k in tex), default=0))
        for name, axes in drawings.VIEWS.items():
            flat = [(f[1], [[(-1 if a[0] == "-" else 1) * f[2 + 5 * k + "xyz".index(a[-1])] for a in axes] for k in range(3)], [f[5 + 5 * k:7 + 5 * k] for k in range(3)]) for f in rows if f[0] == scene]
            u0, v1 = min(p[0] for _, c, _ in flat for p in c), max(p[1] for _, c, _ in flat for p in c)
            best = {}
            for fid, c, uv in flat:
                (ua, va), (ub, vb), (uc, vc) = [((p[0] - u0) / 0.25, (v1 - p[1]) / 0.25) for p in c]
                den = (ub - ua) * (vc - va) - (uc - ua) * (vb - va)
                for iu in range(int(np.ceil(min(ua, ub, uc) - 0.5)), int(np.floor(max(ua, ub, uc) - 0.5)) + 1) if den else ():
                    for iv in range(int(np.ceil(min(va, vb, vc) - 0.5)), int(np.floor(max(va, vb, vc) - 0.5)) + 1):
                        pu, pv = iu + 0.5 - ua, iv + 0.5 - va
                        l1, l2 = (pu * (vc - va) - (uc - ua) * pv) / den, ((ub - ua) * pv - pu * (vb - va)) / den
                        if l1 >= -1e-9 and l2 >= -1e-9 and l1 + l2 <= 1 + 1e-9:
                            mix = lambda x, y, z: x + l1 * (y - x) + l2 * (z - x)  # noqa: E731, B023
                            key = (mix(*[p[2] for p in c]), -fid)
                            if (iu, iv) not in best or key > best[iu, iv][0]:
                                best[iu, iv] = (key, [mix(*[p[m] for p in uv]) for m in (0, 1)])
            for (iu, iv), (key, (s, t)) in best.items():
                s, t = min(max(s, 0.0), cols), min(max(t, 0.0), rows_)
                i, j = int(np.floor(t)), int(np.floor(s))
                c = sum(tex.get((i + a, j + b), np.full(3, 128.0)) * (t - i if a else 1 - t + i) * (s - j if b else 1 - s + j) for a in (0, 1) for b in (0, 1))
                want[scene, name, iu, iv] = (round(key[0], 9), *np.floor(c + 0.5).astype(int).tolist())
    assert len({v[1:] for v in want.values()}) > 1000
    for whole in (1 << 22, 0):
        got = {(x.scene_id, x.view, x.iu, x.iv): (round(x.depth, 9), x.r, x.g, x.b) for x in drawings.ortho(corners, texture, 0.25, 3, whole=whole).collect()}
        assert got == want, whole


def test_quad_corners_like_joined_corners(spark):
    from groundloom.operators import mesh, raster
    from groundloom.plans.tables import CELL, Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    want = mesh.face_corners(t.faces, t.vertices)
    got = mesh.quad_corners(raster.full_blocks(t.grid), t.meta, CELL)
    assert want.count() > 1000 and want.exceptAll(got.select(want.columns)).isEmpty() and got.select(want.columns).exceptAll(want).isEmpty()
    at = got.join(t.faces, ["scene_id", "fid"])
    assert at.where("ta * 1048576 + sa <> a OR tb * 1048576 + sb <> b OR tc * 1048576 + sc <> c").isEmpty()
