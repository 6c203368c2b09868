"""Simplification by levels against a recursive version, on short and long lines and rings."""

import numpy as np
import pytest

from groundloom.operators import simplify


def recursive(p, a, b, tolerance, out):
    """Positions strictly between a and b that stay; p ends with the first vertex again for rings."""
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        best, at = -1.0, None
        dx, dy = p[b][0] - p[a][0], p[b][1] - p[a][1]
        n = np.sqrt(dx * dx + dy * dy)
        for k in range(a + 1, b):
            qx, qy = p[k][0] - p[a][0], p[k][1] - p[a][1]
            d = abs(dx * qy - dy * qx) / n if n > 0 else np.sqrt(qx * qx + qy * qy)
            if d > best:
                best, at = d, k
        if best > tolerance:
            out.add(at)
            stack += [(a, at), (at, b)]


def brute(points, closed, tolerance):
    keep, n = {0}, len(points)
    if not closed:
        keep.add(n - 1)
        recursive(points, 0, n - 1, tolerance, keep)
        return keep
    d = [np.hypot(x - points[0][0], y - points[0][1]) for x, y in points]
    m = int(np.argmax([np.sqrt((x - points[0][0]) * (x - points[0][0]) + (y - points[0][1]) * (y - points[0][1])) for x, y in points])) if max(d) > 0 else 0
    keep.add(m)
    ring = [*points, points[0]]
    recursive(ring, 0, m, tolerance, keep)
    recursive(ring, m, n, tolerance, keep)
    return keep


@pytest.mark.parametrize("short", [3, 4096])
def test_against_recursion(spark, short):
    r = np.random.default_rng(2)
    lines = {0: ([(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)], True), 1: ([(0.0, 0.0)], False), 2: ([(0.0, 0.0), (3.0, 1.0)], False), 3: ([(1.0, 1.0)] * 5, True),
             4: ([(float(k), float(k % 2)) for k in range(40)], False)}  # vertices equally far: the smaller position
    for i in range(5, 12):
        n = int(r.integers(3, 200))
        t = np.linspace(0, 2 * np.pi, n, endpoint=False)
        lines[i] = ([(float(a), float(b)) for a, b in zip(np.cos(t) * 9 + r.normal(size=n) * 0.3, np.sin(t) * 5 + r.normal(size=n) * 0.3)], i % 2 == 0)
    rows = [(i, k, x, y, c) for i, (p, c) in lines.items() for k, (x, y) in enumerate(p)]
    df = spark.createDataFrame(rows, "line int, pos long, x double, y double, closed boolean").repartition(4)
    got = {}
    for x in simplify.simplify(df, ["line"], 0.4, short).collect():
        assert x.pos not in got.setdefault(x.line, set())
        got[x.line].add(x.pos)
    assert got == {i: brute(p, c, 0.4) for i, (p, c) in lines.items()}


def test_long_ring(spark):
    """100,000 vertices: the long stretches go through levels, none is gathered before it is short."""
    n = 100_000
    t = np.linspace(0, 2 * np.pi, n, endpoint=False)
    radius = 50 + 5 * np.sin(40 * t) + 0.01 * np.sin(9000 * t)
    x, y = (radius * np.cos(t)).tolist(), (radius * np.sin(t)).tolist()
    df = spark.createDataFrame([(1, k, x[k], y[k], True) for k in range(n)], "line int, pos long, x double, y double, closed boolean")
    got = {r.pos for r in simplify.simplify(df, ["line"], 0.2).collect()}
    # the same rule with arrays
    import pandas as pd

    d = np.sqrt((np.array(x) - x[0]) ** 2 + (np.array(y) - y[0]) ** 2)
    m, want = int(d.argmax()), {0}
    want.add(m)
    for a, b in ((0, m), (m, n)):
        rows = pd.DataFrame({"x": x[a + 1 : b], "y": y[a + 1 : b]}).assign(ax=x[a], ay=y[a], bx=x[b % n], by=y[b % n])
        want |= {a + 1 + int(k) for k in np.flatnonzero(simplify._short(rows, 0.2))}
    assert got == want and 50 < len(got) < 2000


def test_stretches_are_finished_together(spark):
    """Stretches are no groups of Python calls: they pass through tasks in batches, and stay as the plain rule has them."""
    import pandas as pd

    r = np.random.default_rng(8)
    lines = {k: np.round(r.random((int(r.integers(3, 300)), 2)) * 8) / 4 for k in range(150)}
    rows = [(k, p, float(x), float(y), False) for k, v in lines.items() for p, (x, y) in enumerate(v)]
    s = simplify.simplify(spark.createDataFrame(rows, "k int, pos bigint, x double, y double, closed boolean"), ["k"], 0.4)
    assert "FlatMapGroupsInPandas" not in s._jdf.queryExecution().analyzed().toString()
    got = {(q.k, q.pos) for q in s.collect()}
    want = set()
    for k, v in lines.items():
        d = pd.DataFrame({"x": v[1:-1, 0], "y": v[1:-1, 1], "ax": v[0, 0], "ay": v[0, 1], "bx": v[-1, 0], "by": v[-1, 1]})
        want |= {(k, 0), (k, len(v) - 1)} | {(k, 1 + int(j)) for j in np.flatnonzero(simplify._short(d, 0.4))}
    assert got == want
