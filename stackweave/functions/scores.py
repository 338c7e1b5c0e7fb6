"""Column functions of pair features and quality scores. Null features count as 0, as in sums of penalties."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the flat score and of the three land-cover branches.
FLAT = {"dt_normalized": 0.22, "bperp_normalized": 0.08, "snow_cover_frac_d1": 0.10, "snow_cover_frac_d2": 0.10, "delta_snow_cover": 0.08, "freeze_thaw": 0.08, "veg_temporal": 0.08, "precip_7day_d1": 0.04, "precip_7day_d2": 0.04, "season_penalty": 0.06, "lc_forest_fraction": 0.03, "lc_water_fraction": 0.02, "is_annual_repeat": -0.18}
URBAN_BARE = {"dt_normalized": 0.15, "bperp_normalized": 0.12, "snow_cover_frac_d1": 0.08, "snow_cover_frac_d2": 0.08, "delta_snow_cover": 0.06, "freeze_thaw": 0.06, "precip_7day_d1": 0.04, "precip_7day_d2": 0.04, "season_penalty": 0.04, "veg_temporal": 0.00, "lc_forest_fraction": 0.02, "lc_water_fraction": 0.02, "is_annual_repeat": -0.15}
VEGETATION = {"dt_normalized": 0.18, "bperp_normalized": 0.08, "snow_cover_frac_d1": 0.08, "snow_cover_frac_d2": 0.08, "delta_snow_cover": 0.07, "freeze_thaw": 0.07, "precip_7day_d1": 0.04, "precip_7day_d2": 0.04, "season_penalty": 0.08, "veg_temporal": 0.12, "lc_forest_fraction": 0.02, "lc_water_fraction": 0.02, "is_annual_repeat": -0.18}
FOREST = {"dt_normalized": 0.25, "bperp_normalized": 0.10, "snow_cover_frac_d1": 0.08, "snow_cover_frac_d2": 0.08, "delta_snow_cover": 0.06, "freeze_thaw": 0.05, "precip_7day_d1": 0.04, "precip_7day_d2": 0.04, "season_penalty": 0.08, "veg_temporal": 0.15, "lc_forest_fraction": 0.05, "lc_water_fraction": 0.02, "is_annual_repeat": -0.18}
FOREST_CAP, CROSSING_CAP, NDVI_ACTIVE, VEGETATED = 0.25, 0.50, 0.30, 0.40
# Seasons by month, in the north.
SEASONS = ("winter", "winter", "spring", "spring", "spring", "summer", "summer", "summer", "autumn", "autumn", "autumn", "winter")


# Vegetation index by band of latitude (from, to) and month; VEGETATION_ELSEWHERE outside all bands.
VEGETATION_CLIMATOLOGY = (
    (-90, -70, (0.03, 0.05, 0.08, 0.05, 0.03, 0.02, 0.02, 0.02, 0.03, 0.04, 0.03, 0.02)),
    (-70, -55, (0.10, 0.12, 0.10, 0.07, 0.04, 0.03, 0.03, 0.04, 0.06, 0.09, 0.10, 0.10)),
    (-55, -40, (0.42, 0.42, 0.38, 0.32, 0.25, 0.20, 0.19, 0.22, 0.28, 0.35, 0.40, 0.42)),
    (-40, -23, (0.52, 0.52, 0.50, 0.46, 0.40, 0.34, 0.33, 0.36, 0.42, 0.48, 0.51, 0.52)),
    (-23, 23, (0.55, 0.55, 0.57, 0.62, 0.65, 0.64, 0.62, 0.61, 0.60, 0.57, 0.55, 0.54)),
    (23, 35, (0.22, 0.24, 0.32, 0.42, 0.52, 0.56, 0.55, 0.51, 0.46, 0.37, 0.28, 0.22)),
    (35, 50, (0.12, 0.14, 0.22, 0.38, 0.56, 0.65, 0.66, 0.61, 0.52, 0.38, 0.22, 0.13)),
    (50, 62, (0.07, 0.07, 0.10, 0.22, 0.44, 0.60, 0.63, 0.55, 0.38, 0.20, 0.09, 0.07)),
    (62, 70, (0.04, 0.04, 0.05, 0.10, 0.30, 0.50, 0.55, 0.44, 0.24, 0.09, 0.04, 0.04)),
    (70, 90, (0.02, 0.02, 0.03, 0.05, 0.12, 0.22, 0.26, 0.20, 0.10, 0.04, 0.02, 0.02)),
)
VEGETATION_ELSEWHERE = 0.03


def vegetation_climatology(lat: Column, month: Column) -> Column:
    """The index of the band of latitude and the month."""
    out = F.lit(None).cast("double")
    for lo, hi, months in VEGETATION_CLIMATOLOGY:
        out = F.when((lat >= lo) & (lat < hi), F.element_at(F.array(*map(F.lit, months)), month.cast("int"))).otherwise(out)
    return F.coalesce(out, F.lit(VEGETATION_ELSEWHERE))


def unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x.cast("double"), F.lit(0.0))))


def zero(x: Column | str) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(0.0))


def season(month: Column, lat: Column, fall: bool = False) -> Column:
    """Season of a month; six months later south of the equator. The coherence tables say fall for autumn."""
    names = [("fall" if fall and s == "autumn" else s) for s in SEASONS]
    m = F.when(lat < 0, F.pmod(month + 5, F.lit(12)) + 1).otherwise(month)
    return F.element_at(F.array(*map(F.lit, names)), m.cast("int"))


def season_penalty(m1: Column, m2: Column, lat: Column) -> Column:
    """0 in one season, .35 for neighbours, .95 for winter and summer, .70 for spring and autumn."""
    order = {"winter": 0, "spring": 1, "summer": 2, "autumn": 3}
    number = F.create_map(*(x for k, v in order.items() for x in (F.lit(k), F.lit(v))))
    a, b = number[season(m1, lat)], number[season(m2, lat)]
    gap = F.pmod(a - b, F.lit(4))
    return F.when(gap == 0, 0.0).when(gap != 2, 0.35).when(F.pmod(a, F.lit(2)) == 0, 0.95).otherwise(0.70)


def annual_repeat(dt: Column, most: int = 5, tol: int = 20) -> Column:
    return F.exists(F.sequence(F.lit(1), F.lit(most)), lambda n: F.abs(dt - n * 365) <= tol)


def freeze_thaw(t1: Column, t2: Column, most1: Column | None = None, most2: Column | None = None) -> Column:
    """1 if one of the two temperatures is below zero and the other is not; null: 0.

    Temperatures are those of the overpass; the day's highest (``most``) stands in where they are null.
    """
    t1, t2 = (t if most is None else F.coalesce(t, most) for t, most in ((t1, most1), (t2, most2)))
    return F.coalesce(((t1 < 0) != (t2 < 0)).cast("int"), F.lit(0))


def snow_delta(s1: Column, s2: Column) -> Column:
    return F.bround(F.abs(s1 - s2), 4)


def weighted(weights: Mapping[str, float], rain: Column | None = None) -> Column:
    """Sum of weight times feature, each clamped to [0, 1]; ``rain`` divides the 7-day sums first."""
    total = F.lit(0.0)
    for name, w in weights.items():
        x = F.col(name).cast("double")
        total = total + F.lit(w) * unit(x / rain if rain is not None and name.startswith("precip_7day") else x)
    return total


def flat_score(weights: Mapping[str, float] = FLAT, digits: int = 4) -> Column:
    return F.round(unit(1 - weighted(weights)), digits)


def contributions(weights: Mapping[str, float] = FLAT, least: float = 0.001) -> Column:
    """Map of the features' shares beyond ``least``."""
    pairs = [x for k, w in weights.items() for x in (F.lit(k), F.round(F.lit(w) * unit(F.col(k)), 4))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: F.abs(v) > least)


def wet_snow() -> Column:
    one = lambda d: F.coalesce((F.col(f"temp_max_{d}") > 0) & (F.col(f"snow_cover_frac_{d}") > 0.30), F.lit(False))
    return one("d1") | one("d2")


# Shares of water and of snow and ice, rain of a day in millimetres, change and share of snow cover beyond
# which a pair is ruled out.
WATER_MOST, SNOW_ICE_MOST, RAIN_MOST, SNOWFALL_MOST, SNOW_MOST = 0.50, 0.40, 30.0, 0.50, 0.90


def hard_kills() -> Column:
    """Names of the rules that rule a pair out, in a fixed order."""
    snow = F.greatest(zero("snow_cover_frac_d1"), zero("snow_cover_frac_d2"))
    rules = {
        "water_dominant": zero("lc_water_fraction") > WATER_MOST,
        "snow_ice_dominant": zero("lc_snow_fraction") > SNOW_ICE_MOST,
        "heavy_rain": F.greatest(zero("precip_d1"), zero("precip_d2")) > RAIN_MOST,
        "wet_snow": wet_snow(),
        "fresh_snowfall": zero("delta_snow_cover") > SNOWFALL_MOST,
        "heavy_snow_cover": snow > SNOW_MOST,
        "fire": F.coalesce(F.col("fire"), F.lit(False)),
    }
    return F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules.items())))


def landcover_score(digits: int = 4) -> Column:
    """The branches' scores mixed by their shares of the ground; 0 after any kill."""
    a = zero("lc_urban_fraction") + zero("lc_bare_fraction")
    veg = zero("lc_crop_fraction") + zero("lc_grass_fraction") + zero("lc_shrub_fraction")
    c = zero("lc_forest_fraction")
    total = F.when(a + veg + c == 0, 1.0).otherwise(a + veg + c)
    rain = F.lit(80.0)
    branch = lambda w: unit(1 - weighted(w, rain))
    mixed = (a / total) * branch(URBAN_BARE) + (veg / total) * branch(VEGETATION) + (c / total) * F.least(branch(FOREST), F.lit(FOREST_CAP))
    crossing = F.coalesce((veg >= VEGETATED) & ((F.col("ndvi_d1") >= NDVI_ACTIVE) != (F.col("ndvi_d2") >= NDVI_ACTIVE)), F.lit(False))
    capped = F.when(crossing, F.least(mixed, F.lit(CROSSING_CAP))).otherwise(mixed)
    return F.when(F.size(hard_kills()) > 0, 0.0).otherwise(F.round(unit(capped), digits))


# The coherence from which nothing is lost and the span below it, the weights of snow, rain and frost,
# and the three-day rain in millimetres that counts in full.
COHERENT, COHERENT_SPAN, SNOW_WEIGHT, RAIN_WEIGHT, FROST_WEIGHT, FULL_RAIN = 0.40, 0.30, 0.25, 0.75, 0.05, 30.0


def coherence_penalty(coh: Column) -> Column:
    """0 from .40, 1 up to .10, quadratic between."""
    return F.pow(unit((COHERENT - coh) / COHERENT_SPAN), 2)


def coherence_points(coh: Column, freeze_thaw_weight: float = 0.05) -> Column:
    """0 to 100 from a coherence and the weather; wet snow gives 0."""
    snow = F.least(F.lit(1.0), F.greatest(zero("snow_cover_frac_d1"), zero("snow_cover_frac_d2"), zero("delta_snow_cover")))
    rain = lambda d: unit(F.col(f"precip_3day_{d}") / FULL_RAIN)
    total = coherence_penalty(coh) + SNOW_WEIGHT * snow + RAIN_WEIGHT * rain("d1") + RAIN_WEIGHT * rain("d2") + FROST_WEIGHT * (freeze_thaw_weight * zero("freeze_thaw"))
    points = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround((1 - total) * 100, 0)))
    return F.when(wet_snow(), 0.0).otherwise(points)


def coherence_score() -> Column:
    """struct<tier, score01, score100>: measured coherence, else land cover, else climatology, else the flat score."""
    failed = F.col("coherence_expected").isNull() | (F.coalesce("coherence_source", F.lit("s3")) == "failed")
    cover = F.col("lc_dominant_class").isNotNull() | F.col("lc_forest_fraction").isNotNull() | F.col("ndvi_max").isNotNull() | F.col("ndvi_d1").isNotNull()
    clim = F.col("coherence_climatology")
    make = lambda tier, p: F.struct(F.lit(tier).alias("tier"), (p / 100).alias("score01"), p.alias("score100"))
    return (
        F.when(~failed, make("coherence", coherence_points(F.col("coherence_expected"))))
        .when(cover, make("landcover", landcover_score() * 100))
        .when(clim.isNotNull(), make("climatology", coherence_points(clim)))
        .otherwise(make("flat", flat_score() * 100))
    )


def snow_depth_penalty(depth: Column, snowfall: Column, temp: Column) -> Column:
    return F.when(zero(depth) > 20, F.when(temp > 0, 1.0).otherwise(0.85)).when(zero(depth) > 5, 0.60).when(zero(snowfall) > 1.0, 0.30).otherwise(0.0)


def legacy_score(dt: Column, bperp: Column, snow: Column, season_term: Column, ndvi: Column, digits: int = 4) -> Column:
    """Older score with saturation at 180 days and 300 m, and a bonus for annual repeats up to four years."""
    d = F.least(dt / 180, F.lit(1.0))
    raw = 0.30 * d + 0.15 * F.least(F.abs(bperp) / 300, F.lit(1.0)) + 0.25 * snow + 0.15 * season_term + 0.15 * ndvi * d - F.when(annual_repeat(dt, 4), 0.30).otherwise(0.0)
    return F.round(unit(1 - raw), digits)


def decay(g_inf: Column, g0: Column, tau: Column, dt: Column) -> Column:
    return g_inf + (g0 - g_inf) * F.exp(-dt / tau)


def rescaled(score: Column, most: Column) -> Column:
    """Scores whose largest is at most 1.5 are on the 0 to 1 scale and become whole points."""
    return F.when(most <= 1.5, F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(score * 100, 0)))).otherwise(score)


def wind_speed(u: Column, v: Column) -> Column:
    """Null if a component is null or exactly zero."""
    return F.when((u != 0) & (v != 0), F.sqrt(u * u + v * v))


def celsius(kelvin: Column) -> Column:
    return kelvin - 273.15


def area_key(wkt: Column) -> Column:
    """Eight hex digits of the SHA-256 of an area's WKT."""
    return F.substring(F.sha2(wkt, 256), 1, 8)
