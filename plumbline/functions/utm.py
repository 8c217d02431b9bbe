"""WGS84 <-> UTM with the Krüger series to sixth order in the third flattening (Karney 2011)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
SCALE = 0.9996
FALSE_EASTING = 500000.0
FALSE_NORTHING = 10000000.0

_N = FLATTENING / (2 - FLATTENING)
ECCENTRICITY = (FLATTENING * (2 - FLATTENING)) ** 0.5
#: radius of the rectifying sphere times the central scale
RADIUS = SCALE * SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)


def _series(*rows: tuple[tuple[int, int], ...]) -> list[float]:
    """Row ``j`` lists the fractions of ``n**j, n**(j+1), ...``."""
    return [sum(p / q * _N ** (j + i) for i, (p, q) in enumerate(row)) for j, row in enumerate(rows, start=1)]


# Published series coefficients.
FORWARD = _series(
    ((1, 2), (-2, 3), (5, 16), (41, 180), (-127, 288), (7891, 37800)),
    ((13, 48), (-3, 5), (557, 1440), (281, 630), (-1983433, 1935360)),
    ((61, 240), (-103, 140), (15061, 26880), (167603, 181440)),
    ((49561, 161280), (-179, 168), (6601661, 7257600)),
    ((34729, 80640), (-3418889, 1995840)),
    ((212378941, 319334400),),
)
INVERSE = _series(
    ((1, 2), (-2, 3), (37, 96), (-1, 360), (-81, 512), (96199, 604800)),
    ((1, 48), (1, 15), (-437, 1440), (46, 105), (-1118711, 3870720)),
    ((17, 480), (-37, 840), (-209, 4480), (5569, 90720)),
    ((4397, 161280), (-11, 504), (-830251, 7257600)),
    ((4583, 161280), (-108847, 3991680)),
    ((20648693, 638668800),),
)
LATITUDE = _series(
    ((2, 1), (-2, 3), (-2, 1), (116, 45), (26, 45), (-2854, 675)),
    ((7, 3), (-8, 5), (-227, 45), (2704, 315), (2323, 945)),
    ((56, 15), (-136, 35), (-1262, 105), (73814, 2835)),
    ((4279, 630), (-332, 35), (-399572, 14175)),
    ((4174, 315), (-144838, 6237)),
    ((601676, 22275),),
)


def zone_number(lon: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(60), F.floor((lon + 180) / 6).cast("int") + 1))


def zone_epsg(lon: Column, lat: Column) -> Column:
    """EPSG number of the plain 6-degree zone; NULL outside the valid range."""
    valid = lon.between(-180, 180) & lat.between(-90, 90)
    return F.when(valid, F.when(lat >= 0, 32600).otherwise(32700) + zone_number(lon))


def crs_code(epsg: Column) -> Column:
    return F.concat(F.lit("EPSG:"), epsg.cast("string"))


def crs_name(epsg: Column) -> Column:
    hemisphere = F.when(epsg < 32700, "N").otherwise("S")
    return F.concat(F.lit("WGS 84 / UTM zone "), (epsg % 100).cast("string"), hemisphere)


def is_utm(epsg: Column) -> Column:
    return epsg.between(32601, 32660) | epsg.between(32701, 32760)


def crs_metadata(epsg: Column, altitude_reference: Column) -> Column:
    return F.struct(
        F.lit("EPSG:4326").alias("source_crs"),
        crs_code(epsg).alias("target_crs"),
        crs_name(epsg).alias("target_name"),
        altitude_reference.alias("altitude_reference"),
        F.lit("easting, northing, altitude").alias("axis_order"),
    )


def _central_meridian(epsg: Column) -> Column:
    return F.radians((epsg % 100) * 6.0 - 183.0)


def _northing_offset(epsg: Column) -> Column:
    return F.when(epsg >= 32700, FALSE_NORTHING).otherwise(0.0)


def to_utm(lon: Column, lat: Column, epsg: Column) -> Column:
    """``struct(easting, northing)`` in metres."""
    phi = F.radians(lat)
    lam = F.radians(lon) - _central_meridian(epsg)
    t = F.sinh(F.atanh(F.sin(phi)) - ECCENTRICITY * F.atanh(ECCENTRICITY * F.sin(phi)))
    xi = F.atan2(t, F.cos(lam))
    eta = F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))

    def project(angles: Column) -> Column:
        a, b = angles["xi"], angles["eta"]
        north = a
        east = b
        for j, c in enumerate(FORWARD, start=1):
            north = north + c * F.sin(2 * j * a) * F.cosh(2 * j * b)
            east = east + c * F.cos(2 * j * a) * F.sinh(2 * j * b)
        return F.struct(
            (FALSE_EASTING + RADIUS * east).alias("easting"),
            (_northing_offset(epsg) + RADIUS * north).alias("northing"),
        )

    return project(F.struct(xi.alias("xi"), eta.alias("eta")))


def to_wgs84(easting: Column, northing: Column, epsg: Column) -> Column:
    """``struct(lon, lat)`` in degrees."""
    xi = (northing - _northing_offset(epsg)) / RADIUS
    eta = (easting - FALSE_EASTING) / RADIUS
    a, b = xi, eta
    for j, c in enumerate(INVERSE, start=1):
        a = a - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        b = b - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(a) / F.cosh(b))
    lam = F.atan2(F.sinh(b), F.cos(a))
    phi = chi
    for j, c in enumerate(LATITUDE, start=1):
        phi = phi + c * F.sin(2 * j * chi)
    return F.struct(
        F.degrees(lam + _central_meridian(epsg)).alias("lon"),
        F.degrees(phi).alias("lat"),
    )


def geojson_point(lon: Column, lat: Column, alt: Column) -> Column:
    """Coordinate array in longitude, latitude, altitude order, rounded for publication."""
    return F.array(F.bround(lon, 7), F.bround(lat, 7), F.bround(alt, 3))
