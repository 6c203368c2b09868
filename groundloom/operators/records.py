"""Manifests, indexes and small records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from groundloom.functions.numeric import exact_sum, finite

# suffixes other programs leave beside the files they open: fixed values
SIDE_FILES = (".aux.xml", ".blend1", ".blend2", ".ovr", ".~lock", "Thumbs.db", "desktop.ini", ".DS_Store")


def without_side_files(files: DataFrame) -> DataFrame:
    side = F.lit(False)
    for s in SIDE_FILES:
        side = side | F.col("path").endswith(s)
    return files.where(~side & ~F.element_at(F.split("path", "/"), -1).startswith(".~lock"))


def manifest_diff(want: DataFrame, have: DataFrame) -> DataFrame:
    missing = want.exceptAll(have).withColumn("side", F.lit("missing"))
    return missing.unionByName(have.exceptAll(want).withColumn("side", F.lit("extra")))


def content_state(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """One grouping instead of a full outer join: each key's new and old hash side by side."""
    both = new.select(key, F.col("sha256").alias("n"), F.lit(None).cast("string").alias("o")).unionByName(old.select(key, F.lit(None).cast("string").alias("n"), F.col("sha256").alias("o")))
    g = both.groupBy(key).agg(F.max("n").alias("n"), F.max("o").alias("o"))
    return g.select(key, F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "left").when(F.col("n") == F.col("o"), "unchanged").otherwise("conflict").alias("state"))


def same_content(files: DataFrame, key: str) -> DataFrame:
    """Copies per file. Only files whose size repeats are hashed; copies are counted, not paired."""
    sized = files.select(key, F.length("content").alias("_size"), "content")
    repeated = sized.groupBy("_size").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select("_size")
    hashed = sized.join(repeated, "_size", "left_semi").select(key, F.sha2("content", 256).alias("_h"))
    # counts per hash join back by hash; a hash many files share is one row on the other side
    n = hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"))
    counted = hashed.join(n, "_h").select(key, (F.col("_n") - 1).alias("_c"))
    return files.select(key).join(counted, key, "left").select(key, F.coalesce("_c", F.lit(0)).alias("copies"))


def latest(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The last written row per key (append or replace by name)."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(key, *[F.col("_r." + c).alias(c) for c in rest])


def positions(rows: DataFrame) -> DataFrame:
    """Place of each scene in the listing, newest first, undated last: each day is numbered on its own and
    offset by the days before it, so no task holds the whole listing."""
    day = F.coalesce(F.substring("created", 1, 10), F.lit(""))
    r = rows.withColumn("_day", day)
    sizes = r.groupBy("_day").agg(F.count(F.lit(1)).alias("_n"))
    # one row per day
    before = sizes.select("_day", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    k = F.row_number().over(Window.partitionBy("_day").orderBy(F.desc_nulls_last("created"), "name"))
    return r.withColumn("_k", k).join(before, "_day").select("name", "created", "megabytes", (F.col("_off") + F.col("_k")).alias("position"))


def readiness(scenes: DataFrame, present: DataFrame, required: list[str]) -> DataFrame:
    have = present.groupBy("scene_id").agg(*[F.max(F.when(F.col("file") == f, 1)).alias(f"_{k}") for k, f in enumerate(required)])
    s = scenes.join(have, "scene_id", "left")
    missing = F.concat_ws(",", *[F.when(F.col(f"_{k}").isNull(), f) for k, f in enumerate(required)])
    return s.select("scene_id", missing.alias("missing"), (missing == "").alias("ready"))


def redact(df: DataFrame, meta: str, private: tuple[str, ...] = ("where",)) -> DataFrame:
    return df.withColumn(meta, F.col(meta).dropFields(*private))


def validate_sun(rows: DataFrame, vectors: list[str], numbers: list[str], texts: list[str]) -> DataFrame:
    """Whitelisted fields: bad vectors are refused, bad numbers and long texts left out."""
    verdict = F.lit("ok")
    for v in vectors:
        good = (F.size(v) == 3) & F.forall(v, finite)
        verdict = F.when(F.col(v).isNotNull() & ~good, F.lit(f"{v} must be three finite numbers")).otherwise(verdict)
    return rows.select("event_id", verdict.alias("verdict"), *[F.when(finite(n), F.col(n)).alias(n) for n in numbers], *[F.when(F.length(x) <= 120, F.col(x)).alias(x) for x in texts])


def scale_factor(metres: Column, raw: Column) -> Column:
    return F.when(finite(metres) & (metres > 0) & (raw > 0), metres / raw)


def scaled(value: Column, kind: Column, factor: Column) -> Column:
    return F.when(factor.isNull(), value).when(kind == "area", value * factor * factor).otherwise(value * factor)


def ring_area(points: DataFrame, ring: list[str], order: str) -> DataFrame:
    """Newell area of ordered 3-D rings (a ring is hand-drawn, so small); under three points it is 0."""
    w = Window.partitionBy(*ring).orderBy(order)
    nxt = {a: F.coalesce(F.lead(a).over(w), F.first(a).over(w)) for a in "xyz"}
    p = points.withColumns({a + "2": c for a, c in nxt.items()})
    term = lambda a, b: exact_sum((F.col(a) - F.col(a + "2")) * (F.col(b) + F.col(b + "2")))
    s = p.groupBy(*ring).agg(F.count(F.lit(1)).alias("n"), term("y", "z").alias("nx"), term("z", "x").alias("ny"), term("x", "y").alias("nz"))
    return s.select(*ring, F.when(F.col("n") < 3, 0.0).otherwise(F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz")) / 2).alias("area"))


def quality_gate(frames: DataFrame, least: int, share: float) -> DataFrame:
    fails = (F.col("got") < least) | (F.col("got") / F.col("frames") < share)
    return frames.withColumn("fails", fails).withColumn("enough", F.greatest(F.lit(least).cast("bigint"), F.bround(F.col("frames") * 0.8).cast("bigint")))


def largest_model(models: DataFrame) -> DataFrame:
    """Most registered images wins; 'sparse_best' overrides."""
    rank = F.struct((F.col("model") == "sparse_best").cast("int"), F.col("registered"), F.col("model"))
    return models.groupBy("work").agg(F.max_by(F.struct("model", "registered"), rank).alias("m")).select("work", "m.model", "m.registered")
