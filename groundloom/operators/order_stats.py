"""Exact order statistics without ever gathering a group in one task.

A first pass counts values into equal-width bins per key (combined before the shuffle). The bins
that hold the wanted ranks are then known, and a second pass sorts the distinct values of those
bins only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

BINS = 4096


def select_ranks(df: DataFrame, keys: list[str], value: Column | str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """The value at each 0-based ascending rank.

    ``ranks`` maps a name to a rank as a function of the key's row count. Returns keys, name,
    rank, value, total and ``upto`` (how many rows are at or below the value).
    """
    base = df.select(*keys, (F.col(value) if isinstance(value, str) else value).alias("_v")).where("_v IS NOT NULL")
    span = base.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("total"))
    lo, hi, v = (F.col(c).cast("double") for c in ("_lo", "_hi", "_v"))
    # halves keep the span finite for values at both ends of the double range
    slot = F.when(hi > lo, F.least(F.lit(BINS - 1), F.floor((v / 2 - lo / 2) / (hi / 2 - lo / 2) * BINS).cast("int"))).otherwise(0)
    hist = base.join(span, keys).groupBy(*keys, "total", slot.alias("_slot")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
    running = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.withColumn("_upto", F.sum("_n").over(running)).withColumn("_before", F.col("_upto") - F.col("_n"))
    asks = F.array(*[F.struct(F.lit(n).alias("name"), rank(F.col("total")).cast("bigint").alias("rank")) for n, rank in ranks.items()])
    mine = F.filter(asks, lambda a: (a["rank"] >= F.col("_before")) & (a["rank"] < F.col("_upto")))
    chosen = hist.select(*keys, "total", "_before", "_from", "_to", F.explode(mine).alias("_a")).select(
        *keys, "total", "_before", "_from", "_to", F.col("_a.name").alias("name"), F.col("_a.rank").alias("rank"))
    inside = base.join(chosen, keys).where((F.col("_v") >= F.col("_from")) & (F.col("_v") <= F.col("_to")))
    counted = inside.groupBy(*keys, "name", "rank", "total", "_before", "_v").agg(F.count(F.lit(1)).alias("_n"))
    within = Window.partitionBy(*keys, "name").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = counted.withColumn("upto", F.col("_before") + F.sum("_n").over(within))
    found = found.where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("_n")))
    return found.select(*keys, "name", "rank", F.col("_v").alias("value"), "total", "upto")


def quantiles(
    df: DataFrame, keys: list[str], value: Column | str, wanted: dict[str, float], method: str = "linear", count: str | None = None
) -> DataFrame:
    """keys + one column per wanted quantile (+ the number of values, when ``count`` names it).

    ``linear`` interpolates between the two neighbouring ranks; ``lower`` takes the value at
    floor(q*(n-1)).
    """

    def position(q: float, total: Column) -> Column:
        return F.lit(float(q)) * (total - 1).cast("double")

    ranks: dict[str, Callable[[Column], Column]] = {}
    for name, q in wanted.items():
        ranks[name + ":lo"] = lambda n, q=q: F.floor(position(q, n))
        if method == "linear":
            ranks[name + ":hi"] = lambda n, q=q: F.least(F.floor(position(q, n)) + 1, n - 1)
    got = select_ranks(df, keys, value, ranks)
    pick = lambda label: F.max(F.when(F.col("name") == label, F.col("value")))
    wide = got.groupBy(*keys).agg(F.max("total").alias("_total"), *[pick(r).alias("_" + r.replace(":", "_")) for r in ranks])
    cols = [F.col("_total").alias(count)] if count else []
    for name, q in wanted.items():
        low = F.col(f"_{name}_lo")
        if method == "linear":
            p = position(q, F.col("_total"))
            low = low + (F.col(f"_{name}_hi") - low) * (p - F.floor(p).cast("double"))
        cols.append(low.alias(name))
    return wide.select(*keys, *cols)


def top_n(df: DataFrame, keys: list[str], score: str, tie: str, n: int) -> DataFrame:
    """The rows with the n highest scores per key, ties by the smallest ``tie`` id.

    Works by threshold, so n may be millions and a key may hold any share of the table.
    """
    cut = select_ranks(df, keys, score, {"cut": lambda total: F.greatest(total - n, F.lit(0))})
    # rows above the threshold are all in; what is left of n goes to the tied rows
    cut = cut.select(*keys, F.col("value").alias("_cut"), (F.lit(n) - (F.col("total") - F.col("upto"))).alias("_room"))
    marked = df.join(cut, keys)
    sure = marked.where(F.col(score) > F.col("_cut"))
    tied = marked.where(F.col(score) == F.col("_cut"))
    last = select_ranks(tied, [*keys, "_room"], tie, {"last": lambda total: F.least(total, F.col("_room")) - 1})
    admitted = tied.join(last.select(*keys, F.col("value").alias("_last")), keys).where(F.col(tie) <= F.col("_last")).drop("_last")
    return sure.unionByName(admitted).drop("_cut", "_room")
