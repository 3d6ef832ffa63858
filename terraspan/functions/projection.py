"""Map projections undone: easting and northing to longitude and latitude, as native column expressions.

Reference systems by EPSG code: 4326 (and undefined ones, 0 and -1) as they are, 3857 (Web Mercator, sphere), 32601 to
32660 and 32701 to 32760 (UTM north and south on WGS 84), 25828 to 25838 (UTM on GRS 80). The code may differ from row to
row. Another code gives NULL; readers refuse it. Transverse Mercator is Krüger's series to the sixth power of the third
flattening, exact to far below 1e-9 degrees within a zone and its neighbours.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraspan.functions.scalar import normal_longitude

RADIUS, SCALE, FALSE_EAST, FALSE_NORTH = 6378137.0, 0.9996, 500_000.0, 10_000_000.0
FLATTENING = {"WGS84": 1 / 298.257223563, "GRS80": 1 / 298.257222101}
#: Coefficients of the inverse series, by multiple of the angle, of the powers from that multiple on.
INVERSE = {
    1: ["1/2", "-2/3", "37/96", "-1/360", "-81/512", "96199/604800"],
    2: ["1/48", "1/15", "-437/1440", "46/105", "-1118711/3870720"],
    3: ["17/480", "-37/840", "-209/4480", "5569/90720"],
    4: ["4397/161280", "-11/504", "-830251/7257600"],
    5: ["4583/161280", "-108847/3991680"],
    6: ["20648693/638668800"],
}
DEGREES, MERCATOR, NORTH, SOUTH, EUROPE = {4326, 0, -1}, 3857, range(32601, 32661), range(32701, 32761), range(25828, 25839)


def supported(epsg: int) -> bool:
    return epsg in DEGREES or epsg == MERCATOR or epsg in NORTH or epsg in SOUTH or epsg in EUROPE


def series(flattening: float) -> tuple[float, float, dict[int, float]]:
    """Eccentricity, radius of the rectifying sphere and the coefficients of the inverse series."""
    n = flattening / (2 - flattening)
    sphere = RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    return math.sqrt(flattening * (2 - flattening)), sphere, {j: sum(float(Fraction(c)) * n ** (j + k) for k, c in enumerate(cs)) for j, cs in INVERSE.items()}


def _let(value: Column, body) -> Column:
    """Bind ``value`` once and use it any number of times in ``body``."""
    return F.transform(F.array(value), body)[0]


def transverse_inverse(east: Column, north: Column, europe: Column) -> Column:
    """A struct of degrees from the central meridian and latitude, from metres off the false origin; europe: on GRS 80."""
    (e, sphere, beta), (e80, sphere80, beta80) = series(FLATTENING["WGS84"]), series(FLATTENING["GRS80"])
    of = lambda a, b: F.when(europe, F.lit(b)).otherwise(F.lit(a))
    scaled = F.struct((north / of(SCALE * sphere, SCALE * sphere80)).alias("xi"), (east / of(SCALE * sphere, SCALE * sphere80)).alias("eta"))

    def onto_sphere(p: Column) -> Column:
        up, across = p["xi"], p["eta"]
        for j in beta:
            up = up - of(beta[j], beta80[j]) * F.sin(2 * j * p["xi"]) * F.cosh(2 * j * p["eta"])
            across = across - of(beta[j], beta80[j]) * F.cos(2 * j * p["xi"]) * F.sinh(2 * j * p["eta"])
        return F.struct(up.alias("up"), across.alias("across"), of(e, e80).alias("e"))

    def with_isometric(s: Column) -> Column:
        return F.struct(F.atan2(F.sinh(s["across"]), F.cos(s["up"])).alias("lon"), F.atanh(F.sin(s["up"]) / F.cosh(s["across"])).alias("q"), s["e"].alias("e"))

    def onto_ellipsoid(s: Column) -> Column:
        lat = F.atan(F.sinh(s["q"]))
        for _ in range(7):  # each step leaves less than a hundredth of the error
            lat = F.atan(F.sinh(s["q"] + s["e"] * F.atanh(s["e"] * F.sin(lat))))
        return F.struct(F.degrees(s["lon"]).alias("lon"), F.degrees(lat).alias("lat"))

    return _let(_let(_let(scaled, onto_sphere), with_isometric), onto_ellipsoid)


def lon_lat(x: Column, y: Column, epsg: Column | int) -> Column:
    """A struct of lon (in [-180, 180) if it was projected) and lat."""
    code = F.lit(epsg) if isinstance(epsg, int) else epsg
    south, europe = code.between(SOUTH[0], SOUTH[-1]), code.between(EUROPE[0], EUROPE[-1])
    zone = F.when(europe, code - 25800).when(south, code - 32700).otherwise(code - 32600)
    pair = lambda lon, lat: F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat"))
    degrees = transverse_inverse(x - F.lit(FALSE_EAST), y - F.when(south, F.lit(FALSE_NORTH)).otherwise(F.lit(0.0)), europe)
    zoned = _let(degrees, lambda p: pair(normal_longitude(p["lon"] + (zone * 6 - 183)), p["lat"]))
    mercator = pair(normal_longitude(F.degrees(x / RADIUS)), F.degrees(F.atan(F.sinh(y / RADIUS))))
    is_zoned = south | europe | code.between(NORTH[0], NORTH[-1])
    return F.when(code.isin(*DEGREES), pair(x, y)).when(code == MERCATOR, mercator).when(is_zoned, zoned)


def reprojected_sides(sides: DataFrame, epsg: Column | int) -> DataFrame:
    """Polygon sides (x1, y1, x2, y2 and others) in degrees: corners are moved, and stay joined by straight sides."""
    ends = sides.withColumns({"_a": lon_lat(F.col("x1"), F.col("y1"), epsg), "_b": lon_lat(F.col("x2"), F.col("y2"), epsg)})
    return ends.withColumns({"x1": F.col("_a.lon"), "y1": F.col("_a.lat"), "x2": F.col("_b.lon"), "y2": F.col("_b.lat")}).drop("_a", "_b")
