"""Tables that meet scene by scene in groups of bounded size.

A scene's points are dealt into parts and what they meet (cameras, planes, targets) into blocks; each pair of a part and a block is one
group. Inside, every point meets every row of the block in arrays, so pairs are neither shuffled nor written: only what the group makes
of them leaves it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Pairs looked at together inside a group.
TILE = 1 << 19


def dealt(df: DataFrame, name: str, spread: Column, most: int) -> tuple[DataFrame, DataFrame | None]:
    """``df`` with its group number ``name`` (0 in scenes of at most ``most`` rows), and the scenes with more: scene_id, _n<name> groups.

    There are at most rows / ``most`` such scenes; None when there is none.
    """
    large = df.groupBy("scene_id").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > most)
    rows = [(r["scene_id"], -(-r["_c"] // most)) for r in large.collect()]
    if not rows:
        return df.withColumn(name, F.lit(0)), None
    kind = df.schema["scene_id"].dataType.simpleString()
    groups = df.sparkSession.createDataFrame(rows, f"scene_id {kind}, _n{name} int")
    many = df.join(F.broadcast(groups), "scene_id", "left")
    return many.withColumn(name, F.pmod(F.xxhash64(spread), F.coalesce("_n" + name, F.lit(1))).cast("int")).drop("_n" + name), groups


def repeated(df: DataFrame, name: str, groups: DataFrame | None) -> DataFrame:
    """``df`` once for every group of its scene."""
    if groups is None:
        return df.withColumn(name, F.lit(0))
    return df.join(F.broadcast(groups), "scene_id", "left").withColumn(name, F.explode(F.sequence(F.lit(0), F.coalesce("_n" + name, F.lit(1)) - 1))).drop("_n" + name)


def in_groups(points: DataFrame, others: DataFrame, spread: tuple[str, str], sizes: tuple[int, int], work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Runs ``work`` on each part of a scene's points with each block of its others; groups without both give nothing.

    ``spread`` names the columns that deal points and others, ``sizes`` the rows of a part and of a block.
    """
    a, parts = dealt(points, "_part", F.col(spread[0]), sizes[0])
    b, blocks = dealt(others, "_block", F.col(spread[1]), sizes[1])
    key = ["scene_id", "_part", "_block"]
    n = 4 * points.sparkSession.sparkContext.defaultParallelism
    n = max(n, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    a, b = repeated(a, "_block", blocks), repeated(b, "_part", parts)
    # both may stem from one table: new names for one side
    b = b.select(*[F.col(c).alias("_o_" + c) for c in b.columns])
    a, b = a.repartition(n, *key).groupBy(*key), b.repartition(n, *["_o_" + k for k in key]).groupBy(*["_o_" + k for k in key])
    empty = pa.schema([])

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.rename_columns([c.removeprefix("_o_") for c in right.column_names])
        return work(left, right) if left.num_rows and right.num_rows else pa.table({}, schema=empty)

    return a.cogroup(b).applyInArrow(both, schema)


def columns(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [rows[c].to_numpy() for c in names]


def constant(value, n: int, rows: pa.Table, column: str) -> pa.Array:
    """``value`` n times, with the type of a column of ``rows``."""
    return pa.repeat(pa.scalar(value, rows.schema.field(column).type), n)
