"""Registered queries over records: files, sets, text, times, measurements, reports."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from groundloom.functions import text
from groundloom.functions.numeric import js_round, rounded
from groundloom.operators import raster, records
from groundloom.plans.catalog import query
from groundloom.plans.tables import view
from groundloom.plans.terrain import r6

R6 = rounded



@query("file_manifest", f"SELECT path, bytes, sha256 FROM files WHERE NOT ({' OR '.join(f'''ends_with(path, '{s}')''' for s in records.SIDE_FILES)})", "files")
def file_manifest(t):
    return records.without_side_files(t.files).select("path", "bytes", "sha256")


def want_and_have(t):
    w = t.files.select("path", "bytes")
    h = t.files.where("page_id % 7 <> 0").select("path", F.expr("CASE WHEN page_id % 11 = 0 THEN bytes + 1 ELSE bytes END").alias("bytes"))
    return w, h


WH = "w AS (SELECT path, bytes FROM files), h AS (SELECT path, CASE WHEN page_id % 11 = 0 THEN bytes+1 ELSE bytes END AS bytes FROM files WHERE page_id % 7 <> 0)"


@query("manifest_diff", f"WITH {WH} SELECT path, bytes, 'missing' AS side FROM (SELECT * FROM w EXCEPT ALL SELECT * FROM h) a UNION ALL SELECT path, bytes, 'extra' FROM (SELECT * FROM h EXCEPT ALL SELECT * FROM w) b", "files")
def manifest_diff(t):
    return records.manifest_diff(*want_and_have(t))


@query("content_conflicts", """WITH n AS (SELECT page_id AS id, sha256 FROM files WHERE page_id % 5 <> 0), o AS (SELECT page_id AS id, CASE WHEN page_id % 13 = 0 THEN 'x' || sha256 ELSE sha256 END AS sha256 FROM files WHERE page_id % 3 <> 0)
 SELECT coalesce(n.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'left' WHEN n.sha256=o.sha256 THEN 'unchanged' ELSE 'conflict' END AS state FROM n FULL OUTER JOIN o ON o.id=n.id""", "files")
def content_conflicts(t):
    new = t.files.where("page_id % 5 <> 0").selectExpr("page_id AS id", "sha256")
    old = t.files.where("page_id % 3 <> 0").selectExpr("page_id AS id", "CASE WHEN page_id % 13 = 0 THEN concat('x', sha256) ELSE sha256 END AS sha256")
    return records.content_state(new, old, "id")


@query("same_content", """SELECT a.doc_id, count(*)-1 AS copies FROM documents a JOIN documents b ON length(a.text)=length(b.text) AND sha256(a.text)=sha256(b.text) GROUP BY 1""")
def same_content(t):
    """Documents with an exact copy elsewhere: sizes first, hashes only where a size repeats."""
    return records.same_content(t.raw("documents").select("doc_id", F.col("text").alias("content")), "doc_id")


@query("frames_union", "SELECT scene_id, frame FROM frames WHERE placed=1 UNION SELECT scene_id, frame FROM frames WHERE on_disk=1", "frames")
def frames_union(t):
    return t.frames.where("placed = 1").select("scene_id", "frame").union(t.frames.where("on_disk = 1").select("scene_id", "frame")).distinct()


@query("name_intersect", "SELECT scene_id, name FROM walk INTERSECT SELECT scene_id, name FROM walk WHERE frame % 11 <> 0", "walk")
def name_intersect(t):
    return t.walk.select("scene_id", "name").intersect(t.walk.where("frame % 11 <> 0").select("scene_id", "name"))


@query("scene_index_upsert", """WITH e AS (SELECT 'scene_' || (user_id) AS name, event_id AS seq, CASE WHEN event_type <> 'signup' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS created, value AS megabytes FROM events)
 SELECT name, created, megabytes, row_number() OVER (ORDER BY created DESC NULLS LAST, name) AS position FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq DESC) AS k FROM e) q WHERE k=1""")
def scene_index_upsert(t):
    e = t.raw("events").select(F.concat(F.lit("scene_"), F.col("user_id").cast("string")).alias("name"), F.col("event_id").alias("seq"),
                               F.when(F.col("event_type") != "signup", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")).alias("created"), F.col("value").alias("megabytes"))
    return records.positions(records.latest(e, "name", "seq"))


@query("newest_scenes", """WITH e AS (SELECT 'scene_' || (user_id) AS name, event_id AS seq, CASE WHEN event_type <> 'signup' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS created FROM events)
 SELECT name, created FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq DESC) AS k FROM e) q WHERE k=1""")
def newest_scenes(t):
    """All scenes, newest first, those without a date last."""
    e = t.raw("events").select(F.concat(F.lit("scene_"), F.col("user_id").cast("string")).alias("name"), F.col("event_id").alias("seq"),
                               F.when(F.col("event_type") != "signup", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")).alias("created"))
    return records.latest(e, "name", "seq").select("name", "created").orderBy(F.col("created").desc_nulls_last(), "name")


@query("scene_readiness", """WITH s AS (SELECT scene_id, max(CASE WHEN event_type='click' AND value>48e1 THEN 1 ELSE 0 END) AS a, max(CASE WHEN event_type='view' AND value>465e0 THEN 1 ELSE 0 END) AS b, max(CASE WHEN value>47e1 THEN 1 ELSE 0 END) AS c FROM frames GROUP BY 1)
 SELECT scene_id, concat_ws(',', CASE WHEN a=0 THEN 'site.json' END, CASE WHEN b=0 THEN 'splat' END, CASE WHEN c=0 THEN 'texture' END) AS missing, a+b+c=3 AS ready FROM s""", "frames")
def scene_readiness(t):
    """Which of the required files each scene still lacks."""
    f = t.frames.select("scene_id", F.explode(F.expr("""filter(array(CASE WHEN event_type='click' AND value>48e1 THEN 'site.json' END, CASE WHEN event_type='view' AND value>465e0 THEN 'splat' END,
        CASE WHEN value>47e1 THEN 'texture' END), f -> f IS NOT NULL)""")).alias("file")).distinct()
    return records.readiness(t.frames.select("scene_id").distinct(), f, ["site.json", "splat", "texture"])


@query("redact_location", "SELECT event_id, event_type, CAST(value AS DOUBLE) AS focal, NOT (props LIKE '%where%') AS clean FROM events")
def redact_location(t):
    """The place is dropped from nested metadata before sharing."""
    meta = t.raw("events").select("event_id", F.struct(F.col("event_type"), F.struct(F.col("value").alias("focal")).alias("camera"), F.struct(F.col("user_id").alias("lat")).alias("where")).alias("meta"))
    m = records.redact(meta, "meta")
    return m.select("event_id", "meta.event_type", F.col("meta.camera.focal").alias("focal"), F.lit("where" not in m.schema["meta"].dataType.names).alias("clean"))


@query("sun_record_validate", """SELECT event_id, CASE WHEN value < 4e2 AND user_id % 9 <> 0 THEN 'ok' WHEN user_id % 9 = 0 THEN 'north must be three finite numbers' ELSE 'ok' END AS verdict, CASE WHEN user_id % 5 <> 0 THEN value END AS azimuth_deg,
 CASE WHEN length(props)*20 <= 180 THEN event_type END AS note FROM events""")
def sun_record_validate(t):
    """North must be three finite numbers (every ninth user sends two), azimuth is kept when finite, texts up to
    a length limit."""
    r = t.raw("events").select(
        "event_id", F.expr("CASE WHEN user_id % 9 = 0 THEN array(value, 1e0) ELSE array(value, 0e0, 1e0) END").alias("north"),
        F.expr("CASE WHEN user_id % 5 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END").alias("azimuth_deg"),
        F.expr("CASE WHEN length(props)*20 <= 180 THEN event_type ELSE repeat(event_type, 40) END").alias("note"))
    return records.validate_sun(r, ["north"], ["azimuth_deg"], ["note"])


# --- text and time

TAGS = "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN '+' ELSE '-' END || lpad(CAST(user_id % 90 AS VARCHAR),2,'0') || '.' || lpad(CAST(event_id % 10000 AS VARCHAR),4,'0') || CASE WHEN user_id % 3 = 0 THEN '-' ELSE '+' END || lpad(CAST(event_id % 180 AS VARCHAR),3,'0') || '.5' || CASE WHEN user_id % 4 <> 0 THEN '+' || CAST(event_id % 500 AS VARCHAR) || '.25' ELSE '' END || '/' AS tag FROM events"


@query("iso6709", f"""WITH t AS ({TAGS}) SELECT event_id, CAST(regexp_extract(tag, '^([+-][0-9.]+)', 1) AS DOUBLE) AS lat, CAST(regexp_extract(tag, '^[+-][0-9.]+([+-][0-9.]+)', 1) AS DOUBLE) AS lon,
 TRY_CAST(nullif(regexp_extract(tag, '^[+-][0-9.]+[+-][0-9.]+([+-][0-9.]+)', 1), '') AS DOUBLE) AS alt FROM t""")
def iso6709(t):
    e = t.raw("events").selectExpr("event_id", """concat(CASE WHEN user_id % 2 = 0 THEN '+' ELSE '-' END, lpad(CAST(user_id % 90 AS STRING),2,'0'), '.', lpad(CAST(event_id % 10000 AS STRING),4,'0'),
        CASE WHEN user_id % 3 = 0 THEN '-' ELSE '+' END, lpad(CAST(event_id % 180 AS STRING),3,'0'), '.5', CASE WHEN user_id % 4 <> 0 THEN concat('+', CAST(event_id % 500 AS STRING), '.25') ELSE '' END, '/') AS tag""")
    return text.with_iso6709(e, F.col("tag")).drop("tag")


@query("dms", f"SELECT event_id, {r6('CASE WHEN user_id % 2 = 0 THEN -1 ELSE 1 END * (user_id % 90 + event_id % 60 / 6e1 + value / 1e1 / 36e2)')} AS degrees FROM events")
def dms(t):
    e = t.raw("events")
    d = text.dms(F.col("user_id") % 90, F.col("event_id") % 60, F.expr("value / 1e1"), F.expr("CASE WHEN user_id % 2 = 0 THEN 'S' ELSE 'N' END"))
    return e.select("event_id", d.alias("degrees"))


@query("hfov_from_35mm", "SELECT event_id, floor(degrees(2*atan(sqrt(36e0*36e0+24e0*24e0)*19e2/sqrt(19e2*19e2+1e3*1e3)/(2*(2e1+user_id))))*1e1+5e-1)/1e1 AS hfov FROM events")
def hfov_from_35mm(t):
    return t.raw("events").select("event_id", text.hfov_from_35mm(F.expr("2e1 + user_id"), F.lit(1900.0), F.lit(1000.0)).alias("hfov"))


WHEN = """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END || CASE WHEN user_id % 5 = 0 THEN 'Z' WHEN user_id % 5 = 1 THEN '+0' || CAST(user_id % 10 AS VARCHAR) || '30' WHEN user_id % 5 = 2 THEN '-0' || CAST(user_id % 10 AS VARCHAR) || ':00' ELSE '' END AS s, ts, user_id FROM events"""


@query("parse_when", f"""WITH w AS ({WHEN}), o AS (SELECT *, CASE WHEN user_id % 5 = 0 THEN 0 WHEN user_id % 5 = 1 THEN (user_id % 10)*60+30 WHEN user_id % 5 = 2 THEN -(user_id % 10)*60 END AS off FROM w)
 SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M:%S') AS time, CAST(off AS DOUBLE) AS offset_min, CAST(epoch(date_trunc('second', ts)) AS BIGINT)*1000-coalesce(off,0)*60000 AS utc_ms,
 CASE WHEN off IS NOT NULL THEN CASE WHEN off<0 THEN '-' ELSE '+' END || lpad(CAST(abs(off)//60 AS VARCHAR),2,'0') || ':' || lpad(CAST(abs(off)%60 AS VARCHAR),2,'0') END AS offset_text FROM o""")
def parse_when(t):
    e = t.raw("events").select("event_id", F.concat(
        F.when(F.col("event_id") % 2 == 0, F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")),
        F.expr("""CASE WHEN user_id % 5 = 0 THEN 'Z' WHEN user_id % 5 = 1 THEN concat('+0', CAST(user_id % 10 AS STRING), '30') WHEN user_id % 5 = 2 THEN concat('-0', CAST(user_id % 10 AS STRING), ':00') ELSE '' END""")).alias("s"))
    w = text.with_when(e, F.col("s"))
    return w.select("event_id", "date", "time", F.col("offset_min").cast("double").alias("offset_min"), "utc_ms", text.format_offset(F.col("offset_min")).alias("offset_text"))


@query("safe_name", "SELECT page_id, substr(regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g'), 1, 60) AS name, CAST(coalesce(nullif(regexp_extract(url, '([0-9]+)', 1), ''), '-1') AS BIGINT) AS number FROM pages")
def safe_name(t):
    return t.raw("pages").select("page_id", text.safe_name(F.col("url")).alias("name"), text.frame_number(F.col("url")).alias("number"))


@query("clean_empty", "SELECT event_id, CASE WHEN user_id % 3 <> 0 THEN event_type END AS make, CASE WHEN value >= 1e2 THEN CAST(user_id AS VARCHAR) END AS model, (CASE WHEN user_id % 3 <> 0 THEN 1 ELSE 0 END) + (CASE WHEN value >= 1e2 THEN 1 ELSE 0 END) AS tags FROM events")
def clean_empty(t):
    e = t.raw("events").select("event_id", F.create_map(F.lit("make"), F.expr("CASE WHEN user_id % 3 <> 0 THEN event_type ELSE '' END"), F.lit("model"), F.expr("CASE WHEN value >= 1e2 THEN CAST(user_id AS STRING) END"),
                                                        F.lit("gps"), F.lit("{}"), F.lit("list"), F.lit("[]")).alias("tags"))
    c = e.withColumn("tags", text.clean_empty(F.col("tags")))
    return c.select("event_id", F.try_element_at("tags", F.lit("make")).alias("make"), F.try_element_at("tags", F.lit("model")).alias("model"), F.size("tags").alias("tags"))


@query("clean_nested", """WITH d AS (SELECT event_id, concat_ws(',', CASE WHEN user_id % 3 <> 0 THEN '"kind":"' || event_type || '"' END, CASE WHEN user_id % 5 = 0 THEN '"num":"' || user_id || '"' END) AS deep,
  CASE WHEN event_id % 2 = 0 THEN '"note":"seen"' END AS note, CASE WHEN user_id % 2 = 0 THEN '"gps":{"place":"' || user_id || '"}' END AS gps, CASE WHEN event_id % 4 = 0 THEN '"list":["","' || event_id || '"]' END AS list FROM events),
 o AS (SELECT event_id, concat_ws(',', CASE WHEN deep <> '' THEN '"deep":{' || deep || '}' END, note) AS inside, gps, list FROM d),
 a AS (SELECT event_id, concat_ws(',', CASE WHEN inside <> '' THEN '"outer":{' || inside || '}' END, CASE WHEN gps <> '' THEN '"tags":{' || gps || '}' END, list) AS whole FROM o)
 SELECT event_id, CASE WHEN whole <> '' THEN '{' || whole || '}' END AS kept FROM a""")
def clean_nested(t):
    """Records of three levels, empty at any of them, as JSON of what says something."""
    deep = "named_struct('kind', CASE WHEN user_id % 3 <> 0 THEN event_type ELSE '' END, 'num', CASE WHEN user_id % 5 = 0 THEN CAST(user_id AS STRING) END, 'raw', CAST('x' AS BINARY))"
    outer = f"named_struct('deep', {deep}, 'note', CASE WHEN event_id % 2 = 0 THEN 'seen' ELSE '' END)"
    tags = "map('gps', map('place', CASE WHEN user_id % 2 = 0 THEN CAST(user_id AS STRING) ELSE '' END), 'none', map('place', ''))"
    e = t.raw("events").selectExpr("event_id", f"named_struct('outer', {outer}, 'tags', {tags}, 'list', CASE WHEN event_id % 4 = 0 THEN array('', CAST(event_id AS STRING)) ELSE array() END) AS record")
    kept = F.to_json(text.clean(F.col("record"), e.schema["record"].dataType))
    return e.select("event_id", kept.alias("kept"))


# --- measurements

view("measured", (), """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'distance' WHEN 1 THEN 'height' ELSE 'area' END AS kind, value/1e1 AS ax, user_id/1e1 AS ay, 1e0 AS az, value/2e1+1 AS bx, user_id/7e0 AS by_, 3e0+value/5e1 AS bz FROM events""")


def measured(t):
    return t.raw("events").selectExpr("event_id", "CASE event_id % 3 WHEN 0 THEN 'distance' WHEN 1 THEN 'height' ELSE 'area' END AS kind", "value/1e1 AS ax", "user_id/1e1 AS ay", "1e0 AS az", "value/2e1+1 AS bx", "user_id/7e0 AS by_", "3e0+value/5e1 AS bz")


@query("measure", f"SELECT event_id, {r6('sqrt((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)+(bz-az)*(bz-az))')} AS distance, {r6('abs(by_-ay)')} AS height FROM measured", "measured")
def measure(t):
    return measured(t).select("event_id", R6(F.expr("sqrt((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)+(bz-az)*(bz-az))")).alias("distance"), R6(F.expr("abs(by_-ay)")).alias("height"))


@query("calibrate", f"""WITH m AS (SELECT event_id, kind, sqrt((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)+(bz-az)*(bz-az)) AS raw, CASE WHEN event_id % 17 = 0 THEN 0e0 ELSE ay END AS metres FROM measured)
 SELECT event_id, {r6('CASE WHEN metres>0 AND raw>0 THEN metres/raw END')} AS factor, {r6('CASE WHEN metres>0 AND raw>0 THEN CASE WHEN kind=$$area$$ THEN raw*(metres/raw)*(metres/raw) ELSE raw*(metres/raw) END ELSE raw END')} AS value FROM m""", "measured")
def calibrate(t):
    m = measured(t).select("event_id", "kind", F.expr("sqrt((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)+(bz-az)*(bz-az))").alias("raw"), F.expr("CASE WHEN event_id % 17 = 0 THEN 0e0 ELSE ay END").alias("metres"))
    factor = records.scale_factor(F.col("metres"), F.col("raw"))
    m = m.withColumn("factor", factor)
    return m.select("event_id", R6("factor").alias("factor"), R6(records.scaled(F.col("raw"), F.col("kind"), F.col("factor"))).alias("value"))


@query("format_measure", """WITH v AS (SELECT event_id, kind, event_id % 4 AS how, CASE WHEN kind='area' THEN raw*CASE WHEN event_id%4=0 THEN 1e0 ELSE 25e-2 END ELSE raw*CASE WHEN event_id%4=0 THEN 1e0 ELSE 5e-1 END END AS v FROM (
 SELECT *, floor(sqrt((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)+(bz-az)*(bz-az))*1e3+5e-1)/1e3+1e-5 AS raw FROM measured) q)
 SELECT event_id, CASE WHEN how=1 THEN '≈ ' || CASE WHEN v>=1e1 AND v<1e2 THEN printf('%.0f', v) WHEN v>=1 AND v<1e1 THEN printf('%.1f', v) WHEN v>=1e-1 AND v<1 THEN printf('%.2f', v) WHEN v<1e-1 THEN printf('%.3f', v) ELSE printf('%.0f', floor(v/1e1+5e-1)*1e1) END || CASE WHEN kind='area' THEN ' m² est.' ELSE ' m est.' END
 WHEN kind='area' THEN printf('%.2f', v) || CASE WHEN how=0 THEN ' units²' ELSE ' m²' END WHEN v<10 THEN printf('%.3f', v) || CASE WHEN how=0 THEN ' units' ELSE ' m' END ELSE printf('%.2f', v) || CASE WHEN how=0 THEN ' units' ELSE ' m' END END AS label FROM v""", "measured")
def format_measure(t):
    """Labels: a quarter uncalibrated, a quarter estimated, the rest calibrated by one half."""
    m = measured(t).select("event_id", "kind", (rounded(F.expr("sqrt((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)+(bz-az)*(bz-az))"), 3) + 1e-5).alias("raw"), F.expr("event_id % 4").alias("how"))
    label = text.format_measure(F.col("raw"), F.col("kind"), F.when(F.col("how") == 0, 1.0).otherwise(0.5), F.col("how") != 0, F.col("how") == 1)
    return m.select("event_id", label.alias("label"))


@query("polygon_area", f"""WITH r AS (SELECT frame//10 AS ring, scene_id, frame, px AS x, py AS y, pz AS z FROM frames), n AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2, coalesce(lead(z) OVER w, first_value(z) OVER w) AS z2,
 count(*) OVER (PARTITION BY scene_id, ring) AS n FROM r WINDOW w AS (PARTITION BY scene_id, ring ORDER BY frame)),
 s AS (SELECT scene_id, ring, any_value(n) AS n, {', '.join(f"CAST(sum(CAST(floor({e}*1e6+5e-1) AS BIGINT)) AS DOUBLE)/1e6 AS {a}" for a, e in (('nx', '(y-y2)*(z+z2)'), ('ny', '(z-z2)*(x+x2)'), ('nz', '(x-x2)*(y+y2)')))} FROM n GROUP BY 1,2)
 SELECT scene_id, ring, {r6('CASE WHEN n<3 THEN 0e0 ELSE sqrt(nx*nx+ny*ny+nz*nz)/2 END')} AS area FROM s""", "frames")
def polygon_area(t):
    r = t.frames.selectExpr("scene_id", "frame div 10 AS ring", "frame", "px AS x", "py AS y", "pz AS z")
    return records.ring_area(r, ["scene_id", "ring"], "frame").select("scene_id", "ring", R6("area").alias("area"))


NICE_SQL = f"[{', '.join(repr(s) for s in raster.NICE)}]::DOUBLE[]"


@query("nice_steps", f"SELECT event_id, coalesce(list_min(list_filter({NICE_SQL}, lambda s: s >= value/1e1-1e-12)), value/1e1) AS up, coalesce(list_max(list_filter({NICE_SQL}, lambda s: s <= value/5)), 1e-3) AS bar FROM events")
def nice_steps(t):
    ladder = F.array(*[F.lit(s) for s in raster.NICE])
    v = F.expr("value/1e1")
    up = F.coalesce(F.array_min(F.filter(ladder, lambda s: s >= v - 1e-12)), v)
    bar = F.coalesce(F.array_max(F.filter(ladder, lambda s: s <= F.expr("value/5"))), F.lit(raster.NICE[0]))
    return t.raw("events").select("event_id", up.alias("up"), bar.alias("bar"))


@query("obj_text", f"""WITH e AS (SELECT scene_id, a AS vid FROM faces UNION SELECT scene_id, b FROM faces UNION SELECT scene_id, c FROM faces),
 u AS (SELECT v.scene_id, v.vid, x, y, z, vk, row_number() OVER (PARTITION BY v.scene_id ORDER BY v.vid) AS k FROM vkeys v JOIN e ON e.scene_id=v.scene_id AND e.vid=v.vid)
 SELECT scene_id, 0 AS section, vid AS ord, 'v ' || printf('%.6f', x) || ' ' || printf('%.6f', y) || ' ' || printf('%.6f', z) AS line FROM (SELECT scene_id, vid, {r6('x')} AS x, {r6('y')} AS y, {r6('z')} AS z FROM u) q
 UNION ALL SELECT f.scene_id, 1, f.fid, 'f ' || a.k || ' ' || b.k || ' ' || c.k FROM (SELECT *, CAST(scene_id AS BIGINT)*1099511627776 AS base FROM faces) f JOIN u a ON a.vk=f.base+f.a JOIN u b ON b.vk=f.base+f.b JOIN u c ON c.vk=f.base+f.c""", "vkeys faces")
def obj_text(t):
    """OBJ lines: only used vertices, renumbered densely from 1."""
    from groundloom.sources import sinks

    return sinks.obj_lines(t.vertices, t.faces)


@query("quality_gate", """WITH f AS (SELECT user_id AS scene, count(*) AS frames, count(*) FILTER (placed=1) AS got FROM frames GROUP BY 1)
 SELECT scene, frames, got, got<20 OR got/frames<6e-1 AS fails, greatest(20, CAST(round_even(8e-1*frames,0) AS BIGINT)) AS enough FROM f""", "frames")
def quality_gate(t):
    """Per walker: too few frames placed (share limit 0.6 here), and how many would be enough."""
    f = t.frames.groupBy(F.col("user_id").alias("scene")).agg(F.count(F.lit(1)).alias("frames"), F.sum("placed").alias("got"))
    return records.quality_gate(f, 20, 0.6)


@query("largest_model", """WITH m AS (SELECT user_id AS work, CASE WHEN event_type='error' AND user_id % 4 = 0 THEN 'sparse_best' ELSE event_type END AS model, count(*) AS registered FROM events GROUP BY 1,2)
 SELECT work, arg_max(model, row(CASE WHEN model='sparse_best' THEN 1 ELSE 0 END, registered, model)) AS model, arg_max(registered, row(CASE WHEN model='sparse_best' THEN 1 ELSE 0 END, registered, model)) AS registered FROM m GROUP BY 1""")
def largest_model(t):
    m = t.raw("events").groupBy(F.col("user_id").alias("work"), F.expr("CASE WHEN event_type='error' AND user_id % 4 = 0 THEN 'sparse_best' ELSE event_type END").alias("model")).agg(F.count(F.lit(1)).alias("registered"))
    return records.largest_model(m)
