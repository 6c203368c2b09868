"""Job logs: the same column logic for a batch table and for a stream of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from groundloom.operators import sequence

# starting cost model: phase -> (seconds, seconds per unit, unit); fixed values
PHASES = {
    "frames": (2.0, 0.015, "n"), "prune": (1.0, 0.03, "n"), "privacy": (2.0, 0.07, "n"), "features": (2.0, 0.05, "n"), "match": (3.0, 0.9, "n"),
    "map": (3.0, 0.0072, "n2"), "undistort": (1.0, 0.05, "n"), "train": (10.0, 0.022, "steps"), "place": (5.0, 0.00001, "steps"),
}
# the line a tool prints when it enters a phase; fixed values
PHASE_LINES = {"feature extraction": "features", "matching": "match", "mapping (this is the slow one)": "map", "undistorting": "undistort", "compressing to SPZ": "compress"}

PROGRESS = r"^\s*~ progress (\d+)/(\d+)\s*(.*)$"
STAGE = r"^\[(\d+)(b?)/(\d+)\]\s+(\S+)"
WRITTEN = r"(\d+) frames written|(\d+) images copied|reusing (\d+) frames"
KEPT = r"dropped \d+, kept (\d+)"
REGISTERED = r"registered (\d+) of (\d+) frames"


def parse(lines: DataFrame) -> DataFrame:
    """Adds kind, stage, phase, done, total, what, frames, registered; the first matching rule wins."""
    line, text = F.col("line"), F.trim("line")
    part = lambda c, p, k: F.nullif(F.regexp_extract(c, p, k), F.lit(""))
    phase = F.lit(None).cast("string")
    for said, name in PHASE_LINES.items():
        phase = F.when(text == said, name).otherwise(phase)
    kind = (
        F.when(line.rlike(PROGRESS), "progress").when(text.rlike(STAGE), "stage").when(phase.isNotNull(), "phase").when(text.rlike(WRITTEN), "frames")
        .when(text.rlike(KEPT), "kept").when(text.rlike(REGISTERED), "registered").when(text.startswith("WARNING"), "warning").otherwise("other")
    )
    d = lines.withColumn("kind", kind)
    only = lambda k, c: F.when(F.col("kind").isin(*k.split()), c)
    written = F.coalesce(*[part(text, WRITTEN, k) for k in (1, 2, 3)])
    return d.withColumns({
        "stage": only("stage", part(text, STAGE, 4)), "phase": F.coalesce(only("phase", phase), only("stage", part(text, STAGE, 4))),
        "done": only("progress", part(line, PROGRESS, 1)).cast("bigint"), "total": only("progress", part(line, PROGRESS, 2)).cast("bigint"), "what": only("progress", F.trim(F.regexp_extract(line, PROGRESS, 3))),
        "frames": F.coalesce(only("frames", written), only("kept", part(text, KEPT, 1))).cast("bigint"), "registered": only("registered", part(text, REGISTERED, 1)).cast("bigint"),
    })


def state(parsed: DataFrame) -> DataFrame:
    """Latest stage, phase, counter, frames and number of warnings per job: one aggregation, no ordering of the log."""
    last = lambda c, k=None: F.max_by(c, F.when((F.col(k or c)).isNotNull(), F.col("line_no"))).alias(c)
    return parsed.groupBy("job_id").agg(last("stage"), last("phase"), last("done"), last("total", "done"), last("frames"), last("registered"),
                                        F.sum(F.when(F.col("kind") == "warning", 1).otherwise(0)).alias("warnings"), F.max("ts").alias("seen"),
                                        F.max(F.when(F.col("phase").isNotNull(), F.col("ts"))).alias("phase_since"))


def phase_durations(parsed: DataFrame) -> DataFrame:
    """Seconds spent per phase, from each entry to the next."""
    e = parsed.where("phase IS NOT NULL").select("job_id", "line_no", "phase", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    e = sequence.neighbour(e, ["job_id"], ["line_no"], {"until": F.col("us")}, True, 256)
    return e.groupBy("job_id", "phase").agg(F.count(F.lit(1)).alias("visits"), (F.sum(F.col("until") - F.col("us")).cast("double") / 1e6).alias("seconds"))


def explain_failure(lines: DataFrame, after: int = 5) -> DataFrame:
    """The last FAILED line, up to two lines of explanation and the first advice; else the last Error line."""
    marks = lines.groupBy("job_id").agg(F.max(F.when(F.col("line").contains("FAILED:"), F.col("line_no"))).alias("at"),
                                        F.max_by("line", F.when(F.col("line").contains("Error"), F.col("line_no"))).alias("error_line"))
    near = lines.join(marks.where("at IS NOT NULL"), "job_id").where((F.col("line_no") >= F.col("at")) & (F.col("line_no") <= F.col("at") + after))
    # at most six lines per job reach this list
    told = near.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct((F.col("line_no") - F.col("at")).alias("k"), F.trim("line").alias("t")))).alias("l"))
    head = F.trim(F.regexp_extract(F.expr("l[0].t"), r"FAILED:\s*(.*)$", 1))
    stop = F.array_min(F.transform(F.filter("l", lambda e: (e["k"] > 0) & (e["t"].startswith("command:") | e["t"].startswith("output tail"))), lambda e: e["k"]))
    told = told.withColumn("stop", F.coalesce(stop, F.lit(after + 1).cast("bigint"))).withColumn("head", head)
    told = told.withColumn("rest", F.transform(F.filter("l", lambda e: (e["k"] > 0) & (e["k"] < F.col("stop")) & (e["t"] != "")), lambda e: e["t"]))
    told = told.withColumn("hint", F.get(F.filter("rest", lambda s: s.startswith("Try")), F.lit(0)))
    more = F.array_join(F.slice(F.filter("rest", lambda s: F.col("hint").isNull() | (s != F.col("hint"))), 1, 2), " ")
    error = F.when((more != "") & (F.length("head") < 400), F.concat_ws(" ", "head", more)).otherwise(F.col("head"))
    other = marks.where("at IS NULL AND error_line IS NOT NULL").select("job_id", F.trim("error_line").alias("error"), F.lit(None).cast("string").alias("hint"))
    return told.select("job_id", error.alias("error"), "hint").unionByName(other)


def tail(lines: DataFrame, k: int) -> DataFrame:
    """The last k lines per job with their place from the end."""
    return lines.withColumn("back", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("line_no")))).where(F.col("back") <= k)


def throttle(parsed: DataFrame, seconds: float = 1.0) -> DataFrame:
    """Progress lines unless they repeat the one before, or come within ``seconds`` of it unfinished."""
    p = parsed.where("kind = 'progress'").withColumn("key", F.regexp_extract("line", r"progress (\d+/\d+.*)$", 1)).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    p = sequence.neighbour(p, ["job_id"], ["line_no"], {"k0": F.col("key"), "u0": F.col("us")}, False, 256)
    late = (F.col("us") - F.col("u0") >= int(seconds * 1e6)) | (F.col("done") >= F.col("total"))
    return p.where(F.col("k0").isNull() | ((F.col("k0") != F.col("key")) & late))


def stereo_minutes(views: Column, size: Column, geometric: Column) -> Column:
    """4.4 s per view at 640 px, growing with the square of the size; twice when geometric."""
    m = views * 4.4 * (size / 640.0) * (size / 640.0) * F.when(geometric, 2).otherwise(1) / 60.0
    return F.floor(m * 1e6 + 0.5).cast("double") / 1e6


def coefficients(spark: SparkSession) -> DataFrame:
    """The nine-row cost model."""
    rows = [(k, p, *c) for k, (p, c) in enumerate(PHASES.items())]
    return spark.createDataFrame(rows, "ord int, phase string, a double, b double, kind string")


def units(kind: Column, n: Column, steps: Column) -> Column:
    return F.when(kind == "n", n).when(kind == "n2", n * n).otherwise(steps)


def predict(jobs: DataFrame, model: DataFrame) -> DataFrame:
    """Predicted seconds per job (with n frames and training steps) and phase; the nine model rows are one array value."""
    rows = model.agg(F.collect_list(F.struct("ord", "phase", "a", "b", "kind")).alias("m")).scalar()
    p = jobs.withColumn("_m", F.explode(rows)).select(*jobs.columns, "_m.*")
    s = F.col("a") + F.col("b") * units(F.col("kind"), F.col("n"), F.col("steps"))
    return p.withColumn("seconds", F.floor(s * 1e6 + 0.5).cast("double") / 1e6)


def learn(finished: DataFrame, model: DataFrame) -> DataFrame:
    """b <- (b + fitted) / 2 per finished job in order, in closed form over all jobs: the k-th from the end weighs 2^-k, what was
    known before 2^-n. Places come from chunked numbering, so a phase of very many jobs is no single task."""
    f = finished.join(model, "phase").where((F.col("units") > 0) & (F.col("secs") > F.col("a"))).withColumn("fit", (F.col("secs") - F.col("a")) / F.col("units"))
    f = f.withColumn("_o", -F.col("finished").cast("double"))
    f = sequence.row_number(f, ["phase"], ["_o"], "back", None)
    weight = F.pow(F.lit(0.5), F.col("back"))
    return f.groupBy("phase").agg((F.first("b") * F.pow(F.lit(0.5), F.count(F.lit(1))) + F.sum(F.col("fit") * weight)).alias("b"))


def eta(state: DataFrame, spent: DataFrame, model: DataFrame, steps: int, frames: int = 118) -> DataFrame:
    """Percent and seconds left, weighted by predicted phase times and scaled by how the finished phases went."""
    jobs = state.select("job_id", "phase", "done", "total", "phase_since", "seen", F.coalesce("frames", F.lit(frames)).cast("double").alias("n"), F.lit(float(steps)).alias("steps"))
    p = predict(jobs.withColumnRenamed("phase", "current"), model).withColumnRenamed("seconds", "pred")
    at = model.select(F.col("phase").alias("current"), F.col("ord").alias("cur"))
    p = p.join(F.broadcast(at), "current", "left").withColumn("cur", F.coalesce("cur", F.lit(0)))
    p = p.join(spent.select("job_id", "phase", "seconds"), ["job_id", "phase"], "left")
    part = lambda e, c: F.sum(F.when(e, F.col(c)).otherwise(0.0))
    before, here, later = F.col("ord") < F.col("cur"), F.col("ord") == F.col("cur"), F.col("ord") > F.col("cur")
    g = p.groupBy("job_id").agg(part(before, "pred").alias("done_pred"), F.coalesce(part(before, "seconds"), F.lit(0.0)).alias("done_real"), part(here, "pred").alias("pred"), part(later, "pred").alias("later"),
                                F.first("done").alias("done"), F.first("total").alias("total"), F.first((F.unix_micros(F.col("seen").cast("timestamp")) - F.unix_micros(F.col("phase_since").cast("timestamp"))) / 1e6).alias("inside"))
    speed = F.when((F.col("done_pred") >= 20) & (F.col("done_real") > 0), F.greatest(F.lit(0.4), F.least(F.lit(3.0), F.col("done_real") / F.col("done_pred")))).otherwise(1.0)
    g = g.withColumn("speed", speed)
    frac = F.when(F.col("total") > 0, F.least(F.lit(1.0), F.col("done") / F.col("total"))).otherwise(F.least(F.lit(0.9), F.coalesce("inside", F.lit(0.0)) / F.greatest(F.lit(1.0), F.col("pred") * F.col("speed"))))
    g = g.withColumn("frac", frac)
    all_pred = F.col("done_pred") + F.col("pred") + F.col("later")
    pct = F.least(F.lit(99.5), 100 * (F.col("done_pred") + F.col("pred") * F.col("frac")) / all_pred)
    left = F.greatest(F.lit(5.0), (F.col("pred") * (1 - F.col("frac")) + F.col("later")) * F.col("speed"))
    return g.select("job_id", F.round(pct, 1).alias("pct"), F.round(left).alias("eta_seconds"), F.round("speed", 3).alias("speed"))
