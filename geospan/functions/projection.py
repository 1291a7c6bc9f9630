"""Grid coordinates: the inverse transverse Mercator projection by Krüger's series, as plain expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

_A, _FLAT = 6378137.0, 1 / 298.257223563
_N = _FLAT / (2 - _FLAT)
_RECTIFYING = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_SCALE, _FALSE_EAST, _FALSE_NORTH = 0.9996, 500_000.0, 10_000_000.0
BANDS = "CDEFGHJKLMNPQRSTUVWX"
COLUMNS = ("STUVWXYZ", "ABCDEFGH", "JKLMNPQR")
ROWS = "ABCDEFGHJKLMNPQRSTUV"


def _southern_edge(band: str) -> float:
    """Northing of a band's southern edge on the central meridian, rounded down to 100 km."""
    phi = math.radians(-80 + 8 * BANDS.index(band))
    t = math.sinh(math.atanh(math.sin(phi)) - 2 * math.sqrt(_N) / (1 + _N) * math.atanh(2 * math.sqrt(_N) / (1 + _N) * math.sin(phi)))
    xi = math.atan(t)
    alpha = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
    y = _SCALE * _RECTIFYING * (xi + sum(a * math.sin(2 * (j + 1) * xi) for j, a in enumerate(alpha)))
    return math.floor((y + (_FALSE_NORTH if phi < 0 else 0)) / 1e5) * 1e5


def utm_to_latlon(zone: Column, north: Column, easting: Column, northing: Column) -> Column:
    """struct<lat, lon> in degrees. Each step is worked out once: as nested expressions the series would grow out of bounds."""
    start = F.struct(((northing - F.when(north, F.lit(0.0)).otherwise(F.lit(_FALSE_NORTH))) / (_SCALE * _RECTIFYING)).alias("xi"), ((easting - _FALSE_EAST) / (_SCALE * _RECTIFYING)).alias("eta"))

    def conformal(p: Column) -> Column:
        x, e = p.xi, p.eta
        for j, b in enumerate(_BETA, 1):
            x = x - b * F.sin(2 * j * p.xi) * F.cosh(2 * j * p.eta)
            e = e - b * F.cos(2 * j * p.xi) * F.sinh(2 * j * p.eta)
        return F.struct(x.alias("x"), e.alias("e"))

    def geodetic(q: Column) -> Column:
        def latitude(chi: Column) -> Column:
            lat = chi
            for j, d in enumerate(_DELTA, 1):
                lat = lat + d * F.sin(2 * j * chi)
            return F.degrees(lat)

        lat = let(F.asin(F.sin(q.x) / F.cosh(q.e)), latitude)
        return F.struct(lat.alias("lat"), (F.degrees(F.atan2(F.sinh(q.e), F.cos(q.x))) + zone * 6 - 183).alias("lon"))

    return let(let(start, conformal), geodetic)


def mgrs_to_utm(zone: Column, band: Column, square: Column, east: Column, north: Column) -> Column:
    """struct<easting, northing>: east and north are equally many digits within the square of 100 km."""
    at = lambda letters, c: F.position(c, F.lit(letters))
    column = F.when(zone % 3 == 0, at(COLUMNS[0], F.substring(square, 1, 1))).when(zone % 3 == 1, at(COLUMNS[1], F.substring(square, 1, 1))).otherwise(at(COLUMNS[2], F.substring(square, 1, 1)))
    row = F.pmod(at(ROWS, F.substring(square, 2, 1)) - 1 - F.when(zone % 2 == 0, F.lit(5)).otherwise(F.lit(0)), F.lit(20))
    low = F.try_element_at(F.create_map(*[F.lit(v) for b in BANDS for v in (b, _southern_edge(b))]), band)
    metres = lambda d: d.cast("double") * F.pow(F.lit(10.0), 5 - F.length(d))
    base = row * 100_000.0
    # Rows repeat every 2000 km: the first repeat at or above the band's edge.
    northing = let(base, lambda b: b + F.ceil((low - b) / 2_000_000.0) * 2_000_000.0) + metres(north)
    return F.struct((column * 100_000.0 + metres(east)).alias("easting"), northing.alias("northing"))
