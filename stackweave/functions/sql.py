"""The scalar functions for SQL users, as SQL functions that the optimizer inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "sw_decay(g_inf DOUBLE, g0 DOUBLE, tau DOUBLE, dt DOUBLE) RETURNS DOUBLE": "g_inf + (g0 - g_inf) * exp(-dt / tau)",
    "sw_unit(x DOUBLE) RETURNS DOUBLE": "greatest(0D, least(1D, coalesce(x, 0D)))",
    "sw_quality_class(score DOUBLE) RETURNS STRING": "CASE WHEN score IS NULL THEN 'unknown' WHEN score >= 0.40 THEN 'good' WHEN score >= 0.25 THEN 'risky' ELSE 'bad' END",
    "sw_annual_repeat(dt BIGINT, most INT) RETURNS BOOLEAN": "exists(sequence(1, most), n -> abs(dt - n * 365) <= 20)",
    "sw_end_of_day(d STRING) RETURNS STRING": "CASE WHEN d <> '' AND NOT contains(d, 'T') AND NOT contains(d, ':') THEN concat(d, 'T23:59:59') ELSE d END",
    "sw_area_key(wkt STRING) RETURNS STRING": "substring(sha2(wkt, 256), 1, 8)",
    "sw_metres(phase DOUBLE, wavelength DOUBLE) RETURNS DOUBLE": "phase * (-wavelength / (4 * pi()))",
    "sw_scene_date(name STRING) RETURNS STRING": r"CASE WHEN name RLIKE '^\\d{8}$' THEN name WHEN regexp_extract(name, '_(\\d{8})T\\d{6}', 1) <> '' THEN regexp_extract(name, '_(\\d{8})T\\d{6}', 1) WHEN length(name) > 25 AND substring(name, 18, 8) RLIKE '^\\d{8}$' THEN substring(name, 18, 8) ELSE '' END",
    "sw_scene_hour(name STRING) RETURNS INT": r"try_cast(regexp_extract(name, '\\d{8}T(\\d{2})\\d{4}', 1) AS INT)",
    "sw_start_stamp(name STRING) RETURNS STRING": r"regexp_extract(name, '(\\d{8}T\\d{6})', 1)",
    "sw_mission(platform STRING) RETURNS STRING": "CASE WHEN contains(upper(platform), '1A') THEN 'S1A' WHEN contains(upper(platform), '1B') THEN 'S1B' WHEN contains(upper(platform), '1C') THEN 'S1C' WHEN contains(upper(platform), '1D') THEN 'S1D' END",
    "sw_round_hour(hhmmss STRING) RETURNS INT": "pmod(CAST(substring(hhmmss, 1, 2) AS INT) + CAST(CAST(substring(hhmmss, 3, 2) AS INT) * 60 + CAST(substring(hhmmss, 5, 2) AS INT) > 1800 AS INT), 24)",
    "sw_composite_code(day DATE) RETURNS STRING": "concat('A', date_format(day, 'yyyyDDD'))",
    "sw_composite_day(code STRING) RETURNS DATE": "date_add(make_date(CAST(substring(code, 2, 4) AS INT), 1, 1), CAST(substring(code, 6, 3) AS INT) - 1)",
    "sw_day_offset_id(day DATE) RETURNS STRING": "concat(year(day), lpad(CAST(dayofyear(day) - 1 AS STRING), 3, '0'))",
    "sw_pair_key(ref STRING, sec STRING, d_ref DATE, d_sec DATE) RETURNS STRING": "CASE WHEN d_ref <= d_sec THEN concat_ws(':', ref, sec) ELSE concat_ws(':', sec, ref) END",
    "sw_tile_lat(lat DOUBLE, step INT) RETURNS STRING": "concat(CASE WHEN floor(lat / step) * step >= 0 THEN 'N' ELSE 'S' END, lpad(CAST(abs(CAST(floor(lat / step) * step AS INT)) AS STRING), 2, '0'))",
    "sw_tile_lon(lon DOUBLE, step INT) RETURNS STRING": "concat(CASE WHEN floor(lon / step) * step >= 0 THEN 'E' ELSE 'W' END, lpad(CAST(abs(CAST(floor(lon / step) * step AS INT)) AS STRING), 3, '0'))",
    "sw_freeze_thaw(t1 DOUBLE, t2 DOUBLE) RETURNS INT": "coalesce(CAST((t1 < 0) <> (t2 < 0) AS INT), 0)",
    "sw_snow_delta(s1 DOUBLE, s2 DOUBLE) RETURNS DOUBLE": "bround(abs(s1 - s2), 4)",
    "sw_wind_speed(u DOUBLE, v DOUBLE) RETURNS DOUBLE": "CASE WHEN u <> 0 AND v <> 0 THEN sqrt(u * u + v * v) END",
    "sw_celsius(kelvin DOUBLE) RETURNS DOUBLE": "kelvin - 273.15D",
    "sw_coherence_penalty(coh DOUBLE) RETURNS DOUBLE": "power(greatest(0D, least(1D, coalesce((0.40D - coh) / 0.30D, 0D))), 2)",
    "sw_rescaled(score DOUBLE, most DOUBLE) RETURNS DOUBLE": "CASE WHEN most <= 1.5D THEN greatest(0D, least(100D, bround(score * 100, 0))) ELSE score END",
    "sw_los_up(east DOUBLE, north DOUBLE) RETURNS DOUBLE": "sqrt(greatest(0D, least(1D, 1 - east * east - north * north)))",
    "sw_vertical(value DOUBLE, up DOUBLE) RETURNS DOUBLE": "CASE WHEN up > 1e-6D THEN value / up END",
    "sw_route(bperp DOUBLE) RETURNS STRING": "CASE WHEN bperp IS NULL THEN 'missing' WHEN abs(bperp) > 5000 THEN 'fallback' ELSE 'ok' END",
    "sw_band_of(lat DOUBLE) RETURNS INT": "CAST(least(floor(abs(lat) / 10) * 10, 80) AS INT)",
}


def register(spark: SparkSession) -> None:
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
