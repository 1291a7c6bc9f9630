"""Geodesy: distances, geohashes, grid cells for radius joins, coordinate checks and precision."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
KM_PER_DEGREE = EARTH_KM * math.pi / 180
#: Metres of half a unit in the last place of a latitude in decimal degrees, by digits of its fraction.
PRECISION_M = (55_600.0, 5_560.0, 556.0, 55.6, 5.56, 0.556)
#: Own table: how far from a feature's point its place may reach, in metres.
FEATURE_PRECISION_M = {"PPL": 5_000.0, "ADM": 50_000.0, "PCL": 500_000.0, "POS": 10_000.0}


def km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance by the haversine formula."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def degrees_apart(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.sqrt(F.pow(lat2 - lat1, 2) + F.pow(lon2 - lon1, 2))


def geohash(lat: Column, lon: Column, size: int = 6) -> Column:
    """Base-32 geohash; plain arithmetic, so it stays in generated code. Null outside of the valid range."""
    n_lat, n_lon = size * 5 // 2, size * 5 - size * 5 // 2
    y = F.least(F.floor((lat + 90) / 180 * (1 << n_lat)), F.lit((1 << n_lat) - 1)).cast("long")
    x = F.least(F.floor((lon + 180) / 360 * (1 << n_lon)), F.lit((1 << n_lon) - 1)).cast("long")
    chars = []
    for c in range(size):
        value = F.lit(0).cast("long")
        for b in range(5):
            i = 5 * c + b
            axis, n = (x, n_lon) if i % 2 == 0 else (y, n_lat)
            bit = F.shiftright(axis, n - 1 - i // 2).bitwiseAND(F.lit(1).cast("long"))
            value = value + bit * (1 << (4 - b))
        chars.append(F.substring(F.lit(ALPHABET), (value + 1).cast("int"), F.lit(1)))
    return F.when(is_coord(lat, lon), F.concat(*chars))


def is_coord(lat: Column, lon: Column) -> Column:
    return F.coalesce((F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.lit(False))


def is_zero(lat: Column, lon: Column) -> Column:
    return F.coalesce((lat == 0) & (lon == 0), F.lit(False))


def format_latlon(lat: Column, lon: Column) -> Column:
    return F.format_string("%.5f,%.5f", lat, lon)


def parse_latlon(text: Column) -> Column:
    """'lat,lon' -> struct<lat, lon>; null where it isn't a valid pair."""
    lat, lon = (F.expr("cast(null as double)"),) * 2
    lat = F.try_element_at(F.split(text, ","), F.lit(1)).try_cast("double")
    lon = F.try_element_at(F.split(text, ","), F.lit(2)).try_cast("double")
    return F.when(is_coord(lat, lon), F.struct(lat.alias("lat"), lon.alias("lon")))


def precision_m(fraction_digits: Column) -> Column:
    """Metres, from the number of digits after the point of decimal degrees."""
    return F.element_at(F.array(*[F.lit(x) for x in PRECISION_M]), F.least(fraction_digits, F.lit(len(PRECISION_M) - 1)) + 1)


def feature_precision_m(feat_class: Column, feat_code: Column) -> Column:
    p = FEATURE_PRECISION_M
    return F.when(feat_code.startswith("PCL"), p["PCL"]).when(feat_class == "A", p["ADM"]).when(feat_class == "P", p["PPL"]).otherwise(p["POS"])


def location_accuracy(confidence: Column, precision: Column) -> Column:
    """Own contract: confidence as a share, damped by the magnitude of the error in metres; 0 to 1, four digits."""
    return F.round(confidence / 100 * (1 - F.log10(F.greatest(precision, F.lit(1.0))) / 8), 4)


# --- grid cells ------------------------------------------------------------------------------
def _bands(radius_km: float) -> float:
    return radius_km / KM_PER_DEGREE


def _count(band: Column, step: float) -> Column:
    """Cells around the globe in a band of latitude: each at least `step` degrees wide on the ground where the band is widest."""
    edge = F.least(F.abs(band * step), F.abs((band + 1) * step))
    return F.greatest(F.floor(F.lit(360 / step) * F.cos(F.radians(F.least(edge, F.lit(90.0))))), F.lit(1)).cast("long")


def cell(lat: Column, lon: Column, radius_km: float) -> Column:
    """The grid cell of a place: struct<band, slot>."""
    step = _bands(radius_km)
    band = F.floor(lat / step).cast("long")
    n = _count(band, step)
    return F.struct(band.alias("band"), F.pmod(F.floor((lon + 180) / 360 * n).cast("long"), n).alias("slot"))


def cells_within(lat: Column, lon: Column, radius_km: float) -> Column:
    """All cells that a circle about a point can touch, poles and the date line included: about nine. Equi-join them with cell()."""
    step = _bands(radius_km)
    reach = radius_km / EARTH_KM * 1.0001
    ratio = F.lit(math.sin(min(reach, math.pi / 2))) / F.cos(F.radians(lat))
    wide = F.when((F.abs(lat) + step * 1.0001 >= 90) | (ratio >= 1) | F.lit(reach >= math.pi / 2), F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))))
    bands = F.sequence(F.floor((lat - step * 1.0001) / step).cast("long"), F.floor((lat + step * 1.0001) / step).cast("long"))

    def slots(band: Column) -> Column:
        n = _count(band, step)
        lo, hi = (F.floor((lon + d + 180) / 360 * n).cast("long") for d in (-wide, wide))
        return F.transform(F.array_distinct(F.transform(F.sequence(lo, F.least(hi, lo + n)), lambda s: F.pmod(s, n))), lambda s: F.struct(band.alias("band"), s.alias("slot")))

    return F.flatten(F.transform(bands, slots))
