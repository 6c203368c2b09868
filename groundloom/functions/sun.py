"""Sun position as column expressions (the public NOAA solar equations; constants are fixed values)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from groundloom.functions.numeric import clamp, modulo

HORIZON = 0.833  # degrees: half the disc plus refraction at the horizon


def refraction(el: Column) -> Column:
    t = F.tan(F.radians(el))
    high = 58.1 / t - 0.07 / (t * t * t) + 0.000086 / (t * t * t * t * t)
    mid = 1735 + el * (-518.2 + el * (103.4 + el * (-12.79 + el * 0.711)))
    return F.when(el > 85, 0.0).otherwise(F.when(el > 5, high).when(el > -0.575, mid).otherwise(-20.772 / t) / 3600)


def with_sun(df: DataFrame, utc_ms: Column, lat: Column, lon: Column) -> DataFrame:
    """Adds geometric elevation, elevation with refraction, and azimuth clockwise from true north."""
    sin, cos, rad, deg = (lambda d: F.sin(F.radians(d))), (lambda d: F.cos(F.radians(d))), F.radians, F.degrees
    c = F.col
    d = df.withColumns({"_ms": utc_ms.cast("double"), "_lat": lat, "_lon": lon})
    d = d.withColumn("_T", (c("_ms") / 86400000 + 2440587.5 - 2451545) / 36525)
    T = c("_T")
    # fixed formulas: the NOAA solar calculator's, after Meeus, Astronomical Algorithms
    d = d.withColumns({
        "_L0": modulo(280.46646 + T * (36000.76983 + 0.0003032 * T), 360.0),
        "_M": 357.52911 + T * (35999.05029 - 0.0001537 * T),
        "_e": 0.016708634 - T * (0.000042037 + 0.0000001267 * T),
        "_omega": 125.04 - 1934.136 * T,
        "_ep0": 23 + (26 + (21.448 - T * (46.815 + T * (0.00059 - 0.001813 * T))) / 60) / 60,
    })
    L0, M, e, omega = c("_L0"), c("_M"), c("_e"), c("_omega")
    centre = sin(M) * (1.914602 - T * (0.004817 + 0.000014 * T)) + sin(2 * M) * (0.019993 - 0.000101 * T) + sin(3 * M) * 0.000289
    d = d.withColumns({"_lam": L0 + centre - 0.00569 - 0.00478 * sin(omega), "_eps": c("_ep0") + 0.00256 * cos(omega)})
    y = F.tan(rad(c("_eps")) / 2) * F.tan(rad(c("_eps")) / 2)
    d = d.withColumns({"_decl": F.asin(sin(c("_eps")) * sin(c("_lam"))), "_y": y})
    y = c("_y")
    eq = 4 * F.degrees(y * sin(2 * L0) - 2 * e * sin(M) + 4 * e * y * sin(M) * cos(2 * L0) - 0.5 * y * y * sin(4 * L0) - 1.25 * e * e * sin(2 * M))
    d = d.withColumn("_eq", eq)
    solar = modulo(modulo(c("_ms") / 60000, 1440.0) + c("_eq") + c("_lon") * 4, 1440.0)
    d = d.withColumn("_ha", solar / 4 - 180)
    phi = rad(c("_lat"))
    cz = clamp(F.sin(phi) * F.sin(c("_decl")) + F.cos(phi) * F.cos(c("_decl")) * cos(c("_ha")), -1.0, 1.0)
    d = d.withColumn("_cz", cz).withColumn("_zen", deg(F.acos(c("_cz"))))
    side = F.cos(phi) * sin(c("_zen"))
    a = deg(F.acos(clamp((F.sin(phi) * c("_cz") - F.sin(c("_decl"))) / side, -1.0, 1.0)))
    az = F.when(F.abs(side) < 1e-9, F.when(phi > 0, 180.0).otherwise(0.0)).when(c("_ha") > 0, modulo(a + 180, 360.0)).otherwise(modulo(540 - a, 360.0))
    d = d.withColumns({"azimuth": az, "geometric": 90 - c("_zen")})
    d = d.withColumn("elevation", c("geometric") + refraction(c("geometric")))
    return d.drop("_ms", "_lat", "_lon", "_T", "_L0", "_M", "_e", "_omega", "_ep0", "_lam", "_eps", "_decl", "_y", "_eq", "_ha", "_cz", "_zen")


def day_table(days: DataFrame, minutes: int) -> DataFrame:
    """A row every ``minutes`` of each local day: key columns, minute, sun. ``days`` has day_ms (UTC of local midnight), lat, lon."""
    steps = F.sequence(F.lit(0), F.lit(1440 if minutes == 1 else 1440 - minutes), F.lit(minutes))
    m = days.withColumn("minute", F.explode(steps))
    return with_sun(m, F.col("day_ms") + F.col("minute") * 60000, F.col("lat"), F.col("lon"))


def rise_and_set(days: DataFrame, keys: list[str]) -> DataFrame:
    """First minute the sun comes over and goes under the horizon each day; NULL where it does not."""
    m = day_table(days, 1).withColumn("_g", F.col("geometric") + HORIZON)
    # a day is 1441 rows by construction, so this window's groups are bounded
    before = F.lag("_g").over(Window.partitionBy(*keys).orderBy("minute"))
    m = m.withColumn("_b", before)
    up, down = (F.col("_b") < 0) & (F.col("_g") >= 0), (F.col("_b") >= 0) & (F.col("_g") < 0)
    return m.groupBy(*keys).agg(F.min(F.when(up, F.col("minute"))).alias("rise"), F.min(F.when(down, F.col("minute"))).alias("sunset"))
