"""Line simplification (Douglas-Peucker) by levels.

A stretch is open while some vertex lies farther from the chord of its ends than the tolerance. One aggregation a level finds the
farthest vertex of every open stretch; it is kept and splits the stretch in two. So a long ring is spread over tasks by its vertices.
Stretches of at most ``SHORT`` vertices are finished where they are, many of them at once in arrays, by the same rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from groundloom.session import cut_lineage

#: Vertices of a stretch that one task finishes alone.
SHORT = 4096


def chord_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance to the line through the chord's ends, or to the end where both are one place."""
    dx, dy = bx - ax, by - ay
    length = F.sqrt(dx * dx + dy * dy)
    alone = F.sqrt((x - ax) * (x - ax) + (y - ay) * (y - ay))
    return F.when(length > 0, F.abs(dx * (y - ay) - dy * (x - ax)) / length).otherwise(alone)


def _short(rows: pd.DataFrame, tolerance: float) -> np.ndarray:
    """Which vertices of one stretch (sorted by pos) stay."""
    x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
    of = rows.iloc[0]
    x, y = np.concatenate(([of["ax"]], x, [of["bx"]])), np.concatenate(([of["ay"]], y, [of["by"]]))
    keep = np.zeros(len(x), dtype=bool)
    open_ = [(0, len(x) - 1)]
    while open_:
        a, b = open_.pop()
        if b - a < 2:
            continue
        px, py, dx, dy = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a], x[b] - x[a], y[b] - y[a]
        length = np.sqrt(dx * dx + dy * dy)
        d = np.abs(dx * py - dy * px) / length if length > 0 else np.sqrt(px * px + py * py)
        k = int(d.argmax())  # the first of equals
        if d[k] > tolerance:
            keep[a + 1 + k] = True
            open_ += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep[1:-1]


def simplify(vertices: DataFrame, keys: list[str], tolerance: float, short: int = SHORT) -> DataFrame:
    """The vertices (``keys``, pos, x, y) of lines that stay; ``vertices`` has ``closed`` beside them, alike along a line.

    Open lines keep both ends. Closed ones (no vertex twice, pos from 0) keep the first vertex and the one farthest from it, and each
    half is simplified on its own. Of vertices equally far the one of smaller pos is taken. Lines of one or two vertices stay whole.
    """
    v = vertices.select(*keys, "pos", "x", "y", "closed")
    here = F.struct("x", "y")
    ends = v.groupBy(*keys).agg(F.min("pos").alias("p0"), F.max("pos").alias("p1"), F.min_by(here, "pos").alias("e0"), F.max_by(here, "pos").alias("e1"))
    v = cut_lineage(v.join(ends, keys))
    # closed lines: the far vertex is the other anchor, and the first one stands behind the last as well
    off = F.sqrt((F.col("x") - F.col("e0.x")) * (F.col("x") - F.col("e0.x")) + (F.col("y") - F.col("e0.y")) * (F.col("y") - F.col("e0.y")))
    far = v.where("closed").groupBy(*keys).agg(F.max(F.struct(off.alias("d"), (-F.col("pos")).alias("k"), here.alias("at"))).alias("m"))
    far = far.select(*keys, (-F.col("m.k")).alias("pm"), F.col("m.at").alias("em"))
    v = v.join(far, keys, "left")
    low = F.col("closed") & (F.col("pos") > F.col("pm"))
    stretch = v.select(
        *keys, "pos", "x", "y",
        F.when(low, F.col("pm")).otherwise(F.col("p0")).alias("a"), F.when(F.col("closed"), F.when(low, F.col("p1") + 1).otherwise(F.col("pm"))).otherwise(F.col("p1")).alias("b"),
        F.when(low, F.col("em")).otherwise(F.col("e0")).alias("ea"), F.when(F.col("closed"), F.when(low, F.col("e0")).otherwise(F.col("em"))).otherwise(F.col("e1")).alias("eb"),
    )
    stretch = cut_lineage(stretch.select(*keys, "pos", "x", "y", "a", "b", F.col("ea.x").alias("ax"), F.col("ea.y").alias("ay"), F.col("eb.x").alias("bx"), F.col("eb.y").alias("by")))
    anchor = (F.col("pos") == F.col("a")) | (F.col("pos") == F.col("b"))
    kept = stretch.where(anchor).select(*keys, "pos", "x", "y")
    stretch = stretch.where(~anchor)
    while True:
        few = F.col("b") - F.col("a") - 1 <= short
        kept = kept.unionByName(_finish(stretch.where(few), keys, tolerance))
        live = cut_lineage(stretch.where(~few))
        if live.isEmpty():
            return kept
        d = chord_distance(*[F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")])
        top = live.groupBy(*keys, "a").agg(F.max(F.struct(d.alias("d"), (-F.col("pos")).alias("k"), here.alias("at"))).alias("m"))
        top = top.where(F.col("m.d") > tolerance).select(*keys, "a", (-F.col("m.k")).alias("pm"), F.col("m.at.x").alias("mx"), F.col("m.at.y").alias("my"))
        live = cut_lineage(live.join(top, [*keys, "a"]))  # stretches within the tolerance end here
        kept = kept.unionByName(live.where("pos = pm").select(*keys, "pos", "x", "y"))
        left = F.col("pos") < F.col("pm")
        pick = lambda low, high: F.when(left, F.col(low)).otherwise(F.col(high))
        stretch = live.where("pos <> pm").select(
            *keys, "pos", "x", "y", pick("a", "pm").alias("a"), pick("pm", "b").alias("b"), pick("ax", "mx").alias("ax"), pick("ay", "my").alias("ay"), pick("mx", "bx").alias("bx"), pick("my", "by").alias("by")
        )


def _finish(stretch: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Stretches dealt to tasks by a hash, as many together as a batch holds."""
    schema = stretch.select(*keys, "pos", "x", "y").schema
    names = [f.name for f in schema]
    own = [*keys, "a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by stretch; the last stretch of a batch waits for the next batch."""
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            starts = _starts(rows, own)
            cut = starts[-1] if len(starts) else 0
            rest = rows.slice(cut).combine_chunks()
            if cut:
                yield from _kept_rows(rows.slice(0, cut), starts[:-1], tolerance, names).to_batches()
        if rest is not None and rest.num_rows:
            yield from _kept_rows(rest, np.zeros(1, dtype=np.int64), tolerance, names).to_batches()

    return stretch.repartition(*own).sortWithinPartitions(*own, "pos").mapInArrow(run, schema)


def _starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """The rows at which another stretch begins."""
    new = np.zeros(rows.num_rows, dtype=bool)
    new[:1] = True
    for k in keys:
        codes = pc.dictionary_encode(rows[k].combine_chunks(), null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _kept_rows(rows: pa.Table, starts: np.ndarray, tolerance: float, names: list[str]) -> pa.Table:
    x, y, ax, ay, bx, by = (rows[c].to_numpy() for c in ("x", "y", "ax", "ay", "bx", "by"))
    return rows.select(names).filter(pa.array(_many(x, y, ax, ay, bx, by, starts, tolerance)))


def _many(x, y, ax, ay, bx, by, starts: np.ndarray, tolerance: float) -> np.ndarray:
    """Which vertices of many stretches stay, level by level: ``_short`` on all of them at once."""
    keep = np.zeros(len(x), dtype=bool)
    at = np.arange(len(x))
    begin = np.zeros(len(x), dtype=bool)
    begin[starts] = True
    while len(at):
        seg = np.flatnonzero(begin)
        size = np.diff(np.append(seg, len(at)))
        of = np.repeat(np.arange(len(seg)), size)
        px, py, dx, dy = x[at] - ax, y[at] - ay, bx - ax, by - ay
        length = np.sqrt(dx * dx + dy * dy)
        d = np.where(length > 0, np.abs(dx * py - dy * px) / np.where(length > 0, length, 1.0), np.sqrt(px * px + py * py))
        most = np.maximum.reduceat(d, seg)
        hit = np.flatnonzero(d == most[of])
        first = np.full(len(seg), -1)
        first[of[hit][::-1]] = hit[::-1]  # the first of equals
        open_ = (most > tolerance) & (first >= 0)
        keep[at[first[open_]]] = True
        live = open_[of]
        top = np.where(live, first[of], 0)
        here = np.arange(len(at))
        left = here < top
        mx, my = x[at[top]], y[at[top]]
        ax, ay, bx, by = np.where(left, ax, mx), np.where(left, ay, my), np.where(left, mx, bx), np.where(left, my, by)
        begin = begin | (here == top + 1)
        stay = live & (here != top)
        at, ax, ay, bx, by, begin = at[stay], ax[stay], ay[stay], bx[stay], by[stay], begin[stay]
    return keep
