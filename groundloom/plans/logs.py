"""Registered queries over job logs (the batch form of the streams)."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundloom.plans.catalog import query
from groundloom.streaming import jobs

PARSED = """parsed AS (SELECT job_id, line_no, ts, line, CASE WHEN regexp_matches(line, '^\\s*~ progress [0-9]+/[0-9]+') THEN 'progress' WHEN regexp_matches(trim(line), '^\\[[0-9]+b?/[0-9]+\\]\\s+\\S+') THEN 'stage'
 WHEN regexp_matches(line, 'dropped [0-9]+, kept [0-9]+') THEN 'kept' WHEN starts_with(trim(line), 'WARNING') THEN 'warning' ELSE 'other' END AS kind FROM log_lines)"""


@query("log_parse", f"""WITH {PARSED} SELECT job_id, line_no, kind, CASE WHEN kind='stage' THEN regexp_extract(trim(line), '\\]\\s+(\\S+)', 1) END AS stage,
 TRY_CAST(CASE WHEN kind='progress' THEN regexp_extract(line, 'progress ([0-9]+)/', 1) END AS DOUBLE) AS done, TRY_CAST(CASE WHEN kind='progress' THEN regexp_extract(line, '/([0-9]+)', 1) END AS DOUBLE) AS total,
 TRY_CAST(CASE WHEN kind='kept' THEN regexp_extract(line, 'kept ([0-9]+)', 1) END AS DOUBLE) AS frames FROM parsed""", "log_lines")
def log_parse(t):
    p = jobs.parse(t.log_lines)
    return p.select("job_id", "line_no", "kind", "stage", *[F.col(c).cast("double").alias(c) for c in ("done", "total", "frames")])


@query("job_state", f"""WITH {PARSED} SELECT job_id, arg_max(regexp_extract(trim(line), '\\]\\s+(\\S+)', 1), line_no) FILTER (kind='stage') AS stage, CAST(arg_max(regexp_extract(line, 'progress ([0-9]+)/', 1), line_no) FILTER (kind='progress') AS DOUBLE) AS done,
 CAST(arg_max(regexp_extract(line, '/([0-9]+)', 1), line_no) FILTER (kind='progress') AS DOUBLE) AS total, CAST(arg_max(regexp_extract(line, 'kept ([0-9]+)', 1), line_no) FILTER (kind='kept') AS DOUBLE) AS frames,
 count(*) FILTER (kind='warning') AS warnings FROM parsed GROUP BY 1""", "log_lines")
def job_state(t):
    s = jobs.state(jobs.parse(t.log_lines))
    return s.select("job_id", "stage", *[F.col(c).cast("double").alias(c) for c in ("done", "total", "frames")], "warnings")


@query("phase_durations", f"""WITH {PARSED}, s AS (SELECT job_id, regexp_extract(trim(line), '\\]\\s+(\\S+)', 1) AS phase, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER (PARTITION BY job_id ORDER BY line_no) AS nxt FROM parsed WHERE kind='stage')
 SELECT job_id, phase, count(*) AS visits, CAST(sum(nxt-us) AS DOUBLE)/1e6 AS seconds FROM s GROUP BY 1,2""", "log_lines")
def phase_durations(t):
    return jobs.phase_durations(jobs.parse(t.log_lines)).select("job_id", "phase", "visits", "seconds")


@query("failure_explain", """WITH f AS (SELECT job_id, max(line_no) AS at FROM log_lines WHERE line LIKE '%FAILED:%' GROUP BY 1),
 r AS (SELECT l.job_id, l.line_no-f.at AS k, trim(line) AS line FROM log_lines l JOIN f ON f.job_id=l.job_id AND l.line_no>=f.at AND l.line_no<=f.at+5),
 s AS (SELECT job_id, min(k) FILTER (k>0 AND (starts_with(line,'command:') OR starts_with(line,'output tail'))) AS stop FROM r GROUP BY 1),
 u AS (SELECT r.*, s.stop FROM r JOIN s ON s.job_id=r.job_id WHERE k=0 OR (line<>'' AND (stop IS NULL OR k<stop))), h AS (SELECT job_id, arg_min(line, k) FILTER (k>0 AND starts_with(line,'Try')) AS hint FROM u GROUP BY 1),
 m AS (SELECT u.job_id, h.hint, max(regexp_extract(line, 'FAILED:\\s*(.*)$', 1)) FILTER (k=0) AS head, array_to_string(list_slice(list(line ORDER BY k) FILTER (k>0 AND (hint IS NULL OR line<>hint)),1,2),' ') AS more FROM u JOIN h ON h.job_id=u.job_id GROUP BY 1,2)
 SELECT job_id, CASE WHEN coalesce(more,'')<>'' AND length(head)<400 THEN head || ' ' || more ELSE head END AS error, hint FROM m""", "log_lines")
def failure_explain(t):
    return jobs.explain_failure(t.log_lines)


@query("tail_k", """WITH k AS (SELECT job_id, line_no, line, row_number() OVER (PARTITION BY job_id ORDER BY line_no DESC) AS back FROM log_lines WHERE NOT regexp_matches(line, '^\\s*~ progress'))
 SELECT job_id, line_no, line, back<=15 AS in_error_tail FROM k WHERE back<=40""", "log_lines")
def tail_k(t):
    """The last forty kept lines per job; the last fifteen of them are the error tail."""
    return jobs.tail(jobs.parse(t.log_lines).where("kind <> 'progress'"), 40).select("job_id", "line_no", "line", (F.col("back") <= 15).alias("in_error_tail"))


@query("progress_throttle", f"""WITH {PARSED}, p AS (SELECT job_id, line_no, epoch_us(ts) AS us, regexp_extract(line, 'progress ([0-9]+/[0-9]+.*)$', 1) AS key FROM parsed WHERE kind='progress'),
 q AS (SELECT *, lag(key) OVER w AS k0, lag(us) OVER w AS u0 FROM p WINDOW w AS (PARTITION BY job_id ORDER BY line_no)) SELECT job_id, line_no, key FROM q WHERE k0 IS NULL OR (k0<>key AND us-u0>=1000000)""", "log_lines")
def progress_throttle(t):
    """Progress lines that differ from, and come a second or more after, the line before."""
    return jobs.throttle(jobs.parse(t.log_lines)).select("job_id", "line_no", "key")


@query("stage_throughput", f"""WITH {PARSED} SELECT regexp_extract(trim(line), '\\]\\s+(\\S+)', 1) AS stage, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') AS hour, count(*) AS lines FROM parsed WHERE kind='stage' GROUP BY 1,2""", "log_lines")
def stage_throughput(t):
    p = jobs.parse(t.log_lines).where("kind = 'stage'")
    return p.groupBy("stage", F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("lines")).select("stage", F.date_format("w.start", "yyyy-MM-dd HH:00").alias("hour"), "lines")


@query("estimate_minutes", """SELECT job_id, views, size, floor(views*44e-1*(size/64e1)*(size/64e1)*CASE WHEN geometric THEN 2 ELSE 1 END/6e1*1e6+5e-1)/1e6 AS minutes FROM (
 SELECT event_id AS job_id, user_id+20 AS views, CASE event_id % 3 WHEN 0 THEN 480 WHEN 1 THEN 800 ELSE 1200 END AS size, event_id % 3 = 2 AS geometric FROM events) q""")
def estimate_minutes(t):
    q = t.raw("events").selectExpr("event_id AS job_id", "user_id + 20 AS views", "CASE event_id % 3 WHEN 0 THEN 480 WHEN 1 THEN 800 ELSE 1200 END AS size", "event_id % 3 = 2 AS geometric")
    return q.select("job_id", "views", "size", jobs.stereo_minutes(F.col("views"), F.col("size"), F.col("geometric")).alias("minutes"))


COEF = ", ".join(f"('{p}',{a!r}::DOUBLE,{b!r}::DOUBLE,'{k}')" for p, (a, b, k) in jobs.PHASES.items())


@query("phase_seconds", f"""SELECT event_id AS job_id, phase, floor((a+b*CASE kind WHEN 'n' THEN n WHEN 'n2' THEN n*n ELSE steps END)*1e6+5e-1)/1e6 AS seconds FROM (SELECT event_id, user_id+20 AS n, 1000+event_id%7*1000 AS steps FROM events) j
 CROSS JOIN (VALUES {COEF}) c(phase,a,b,kind)""")
def phase_seconds(t):
    j = t.raw("events").selectExpr("event_id AS job_id", "user_id + 20 AS n", "1000 + event_id % 7 * 1000 AS steps")
    return jobs.predict(j, jobs.coefficients(t.spark)).select("job_id", "phase", "seconds")


@query("eta_coefficients", f"""WITH j AS (SELECT event_id, 2e0+15e-3*(user_id+20)+value AS secs, user_id+20 AS n, row_number() OVER (ORDER BY event_id) AS k, count(*) OVER () AS c FROM events WHERE event_type='purchase'),
 w AS (SELECT *, (secs-2e0)/n AS fit, c-k AS left_ FROM j) SELECT 'frames' AS phase, floor((15e-3*pow(5e-1,max(c))+sum(fit*pow(5e-1,left_+1)))*1e6+5e-1)/1e6 AS b FROM w""")
def eta_coefficients(t):
    """Half-weight moving average of the fitted seconds per frame, in the order jobs finished."""
    j = t.raw("events").where("event_type = 'purchase'").selectExpr("event_id AS finished", "'frames' AS phase", "2e0 + 15e-3*(user_id+20) + value AS secs", "CAST(user_id + 20 AS DOUBLE) AS units")
    return jobs.learn(j, jobs.coefficients(t.spark)).select("phase", F.expr("floor(b*1e6+5e-1)/1e6").alias("b"))


@query("job_eta")
def job_eta(t):
    """Percent done and seconds left per job, from its last stage, counter and phase times."""
    p = jobs.parse(t.log_lines)
    return jobs.eta(jobs.state(p), jobs.phase_durations(p), jobs.coefficients(t.spark), steps=7000)
