"""Row-order operators (lag, lead, running sums, row numbers) that split hot keys.

A window over (key) alone sends a whole key to one task. Here a key is cut into chunks by a
monotone bucket of its order column; windows run inside chunks, and one summary row per chunk
carries the boundary value to the next chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

WIDTH = 4096


def with_chunk(df: DataFrame, order: str, width: float | None = WIDTH) -> DataFrame:
    """``width`` is a chunk's span of the order column. None takes the span that about ``WIDTH`` rows fill, found in one pass over
    the rows: ids from 0 on, hashes and times in microseconds are all split alike."""
    if width is None:
        lo, hi, n = df.agg(F.min(order).cast("double"), F.max(order).cast("double"), F.count(order)).first()
        width = max((hi - lo) / max(1, n) * WIDTH, 1e-9) if n else 1.0
    return df.withColumn("_chunk", F.floor(F.col(order) / F.lit(width)).cast("bigint"))


def running_sum(
    df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, width: float | None = WIDTH, inclusive: bool = True
) -> DataFrame:
    """Sum of ``value`` over rows up to this one (or strictly before it)."""
    cut = with_chunk(df.withColumn("_value", value), order[0], width)
    totals = cut.groupBy(*keys, "_chunk").agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_chunk", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return (
        cut.withColumn("_part", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .join(offsets, keys + ["_chunk"])
        .withColumn(out, F.col("_offset") + F.col("_part"))
        .drop("_value", "_chunk", "_part", "_offset")
    )


def row_number(df: DataFrame, keys: list[str], order: list[str], out: str, width: float | None = WIDTH) -> DataFrame:
    """1-based position of each row within its key."""
    return running_sum(df, keys, order, F.lit(1).cast("bigint"), out, width)


def neighbour(
    df: DataFrame, keys: list[str], order: list[str], columns: dict[str, Column], forward: bool = False, width: float | None = WIDTH
) -> DataFrame:
    """Add columns read from the previous (or following) row of the key."""
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    rank = F.struct(*[F.col(o) for o in order])
    cut = with_chunk(df, order[0], width).withColumn("_row", packed)
    pick = F.min_by if forward else F.max_by
    edges = cut.groupBy(*keys, "_chunk").agg(pick("_row", rank).alias("_edge"))
    shift = F.lead if forward else F.lag
    carried = edges.select(*keys, "_chunk", shift("_edge").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_carry"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    near = (
        cut.withColumn("_near", shift("_row").over(inside))
        .join(carried, keys + ["_chunk"])
        .withColumn("_near", F.coalesce("_near", "_carry"))
    )
    for name in columns:
        near = near.withColumn(name, F.col(f"_near.{name}"))
    return near.drop("_chunk", "_row", "_near", "_carry")


def last_known(
    df: DataFrame, keys: list[str], order: list[str], columns: dict[str, Column], forward: bool = False, width: float | None = WIDTH
) -> DataFrame:
    """Add, per output name, the nearest non-null value at or before (at or after) this row."""
    cut = with_chunk(df, order[0], width)
    for name, c in columns.items():
        cut = cut.withColumn("_in_" + name, c)
    rank = F.struct(*[F.col(o) for o in order])
    pick = F.min_by if forward else F.max_by
    ends = cut.groupBy(*keys, "_chunk").agg(
        *[pick(F.col("_in_" + n), F.when(F.col("_in_" + n).isNotNull(), rank)).alias("_end_" + n) for n in columns]
    )
    if forward:
        between = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(1, Window.unboundedFollowing)
        take = lambda n: F.first("_end_" + n, ignorenulls=True).over(between)
        inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
        here = lambda n: F.first("_in_" + n, ignorenulls=True).over(inside)
    else:
        between = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        take = lambda n: F.last("_end_" + n, ignorenulls=True).over(between)
        inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        here = lambda n: F.last("_in_" + n, ignorenulls=True).over(inside)
    carried = ends.select(*keys, "_chunk", *[take(n).alias("_carry_" + n) for n in columns])
    out = cut.join(carried, keys + ["_chunk"])
    for name in columns:
        out = out.withColumn(name, F.coalesce(here(name), F.col("_carry_" + name)))
    return out.drop("_chunk", *["_in_" + n for n in columns], *["_carry_" + n for n in columns])
