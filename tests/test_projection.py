"""Projections undone, held against forward formulas of their own."""

import math
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import polygon

from terraspan.functions import projection as P
from terraspan.operators import spatial
from terraspan.sources import geopackage

#: The forward series.
FORWARD = [
    lambda n: n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4 - 127 / 288 * n**5 + 7891 / 37800 * n**6,
    lambda n: 13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4 + 281 / 630 * n**5 - 1983433 / 1935360 * n**6,
    lambda n: 61 / 240 * n**3 - 103 / 140 * n**4 + 15061 / 26880 * n**5 + 167603 / 181440 * n**6,
    lambda n: 49561 / 161280 * n**4 - 179 / 168 * n**5 + 6601661 / 7257600 * n**6,
    lambda n: 34729 / 80640 * n**5 - 3418889 / 1995840 * n**6,
    lambda n: 212378941 / 319334400 * n**6,
]


def forward(lon, lat, epsg):
    if epsg == 3857:
        return P.RADIUS * math.radians(lon), P.RADIUS * math.log(math.tan(math.pi / 4 + math.radians(lat) / 2))
    f = P.FLATTENING["GRS80" if epsg < 26000 else "WGS84"]
    zone = epsg % 100
    n, e = f / (2 - f), math.sqrt(f * (2 - f))
    phi, lam = math.radians(lat), math.radians(lon - (zone * 6 - 183))
    t = math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi)))
    xi, eta = math.atan2(t, math.cos(lam)), math.asinh(math.sin(lam) / math.hypot(t, math.cos(lam)))
    x = eta + sum(a(n) * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, a in enumerate(FORWARD, 1))
    y = xi + sum(a(n) * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, a in enumerate(FORWARD, 1))
    k = 0.9996 * P.RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    return 500_000 + k * x, k * y + (1e7 if epsg // 100 == 327 else 0)


def test_known_points(spark):
    rng = np.random.default_rng(0)
    points = []
    for epsg in [3857, 32601, 32660, 32632, 32733, 32701, 25832, 25838]:
        for _ in range(40):
            lat = rng.uniform(-84, 84) if epsg == 3857 else rng.uniform(-80, 0) if epsg // 100 == 327 else rng.uniform(0, 84)
            lon = rng.uniform(-180, 180) if epsg == 3857 else (epsg % 100) * 6 - 183 + rng.uniform(-4.5, 4.5)
            points.append((*forward(lon, lat, epsg), epsg, (lon + 180) % 360 - 180, lat))
    points += [(630084.0, 4833438.0, 32617, -79.387139, 43.642567), (12.5, -7.25, 4326, 12.5, -7.25), (500000.0, 0.0, 32631, 3.0, 0.0)]
    df = spark.createDataFrame(points, "x double, y double, epsg int, lon double, lat double")
    for r in df.withColumn("p", P.lon_lat(F.col("x"), F.col("y"), F.col("epsg"))).collect():
        near = 2e-5 if r.x == 630084.0 else 1e-9
        assert abs((r.p.lon - r.lon + 180) % 360 - 180) < near and abs(r.p.lat - r.lat) < near, r
    assert df.limit(1).select(P.lon_lat(F.col("x"), F.col("y"), 2154).alias("p")).first().p is None


def test_meridian_arc():
    """The rectifying sphere against the length of a quarter meridian by quadrature."""
    f = P.FLATTENING["WGS84"]
    e, sphere, _ = P.series(f)
    x, w = np.polynomial.legendre.leggauss(60)
    phi = (x + 1) * math.pi / 4
    arc = (P.RADIUS * (1 - e**2) / (1 - (e * np.sin(phi)) ** 2) ** 1.5 * w).sum() * math.pi / 4
    assert sphere * math.pi / 2 == pytest.approx(arc, abs=1e-6)


def test_projected_polygons(spark, tmp_path):
    """The same polygon in degrees, Web Mercator and UTM holds the same cells."""
    ring = [(6.2, 45.1), (11.5, 45.3), (11.1, 49.7), (8.8, 47.9), (6.6, 49.9), (6.2, 45.1)]
    path = tmp_path / "r.gpkg"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE basins (code INTEGER PRIMARY KEY, geom BLOB)")
        for code, (epsg, end) in enumerate([(4326, "<"), (3857, ">"), (32632, "<"), (25832, "<")], 1):
            moved = [p if epsg == 4326 else forward(*p, epsg) for p in ring]
            db.execute("INSERT INTO basins VALUES (?, ?)", (code, b"GP\x00\x01" + struct.pack("<i", epsg) + polygon([moved], end)))
    spark.dataSource.register(geopackage.GeoPackage)
    sides = geopackage.polygon_sides(spark.read.format("regions_gpkg").options(path=str(path), table="basins", id_column="code").load())
    corners = {k: sorted((round(r.x1, 9), round(r.y1, 9)) for r in sides.where(f"region_id = {k}").collect()) for k in range(1, 5)}
    assert corners[1] == corners[2] == corners[3] == corners[4]
    rng = np.random.default_rng(1)
    cells = spark.createDataFrame([(float(a), float(b)) for a, b in zip(rng.uniform(5, 13, 300), rng.uniform(44, 51, 300), strict=True)], "lon double, lat double")
    held = [{(r.lon, r.lat) for r in spatial.cells_in_regions(cells, sides.where(f"region_id = {k}")).collect()} for k in range(1, 5)]
    assert held[0] == held[1] == held[2] == held[3] and 60 < len(held[0]) < 200



def test_cover_tells_what_crossings_tell(spark):
    """A concave ring with a hole, a thin one, boxes on the grid's lines and one across the antimeridian; same cells as by
    counting all sides, and far fewer pairs to look at."""
    turn = np.linspace(0, 2 * np.pi, 181)[:-1]
    star = [(60 * math.cos(t) * (1 + 0.3 * math.sin(7 * t)), 40 * math.sin(t) * (1 + 0.3 * math.sin(7 * t))) for t in turn]
    hole = [(12 * math.cos(t), 9 * math.sin(t)) for t in turn]
    rings = [(1, star), (1, hole), (2, [(-90, -45), (-45, -45), (-45, 0), (-90, 0)]), (3, [(100, -80), (100.01, -80), (110, 80)]), (4, [(170, 10), (190, 12), (200, 50), (160, 45)]), (5, [(-180, -90), (-100, -90), (-100, -60), (-180, -60)])]
    wrap = lambda x: x if -180 <= x <= 180 else (x + 180) % 360 - 180
    sides = [(k, float(wrap(p[0])), float(p[1]), float(wrap(q[0])), float(q[1])) for k, ring in rings for p, q in zip(ring, ring[1:] + ring[:1], strict=True)]
    flat = [(k, float(p[0]) - t, float(p[1]), float(q[0]) - t, float(q[1])) for k, ring in rings for t in ((0, 360) if k == 4 else (0,)) for p, q in zip(ring, ring[1:] + ring[:1], strict=True)]
    rng = np.random.default_rng(4)
    places = [(float(a), float(b)) for a, b in zip(rng.uniform(-180, 180, 3000), rng.uniform(-90, 90, 3000), strict=True)]
    places += [(float(a), float(b)) for a in range(-180, 180, 15) for b in range(-90, 91, 15)]
    want = {}
    for lon, lat in places:
        odd = {}
        for k, x1, y1, x2, y2 in flat:
            if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
                odd[k] = odd.get(k, 0) + 1
        if inside := [k for k, n in odd.items() if n % 2]:
            want[lon, lat] = min(inside)
    edges = spark.createDataFrame(sides, "region_id long, x1 double, y1 double, x2 double, y2 double")
    cells = spark.createDataFrame(places, "lon double, lat double")
    got = {(r.lon, r.lat): r.region_id for r in spatial.cells_in_regions(cells, edges).collect()}
    assert got == want
    pairs = [spatial.placements(cells, edges, levels)[1].count() for levels in (1, 4, 6)]
    assert pairs[2] < pairs[1] / 3 < pairs[0] / 9
    assert spatial.cells_in_regions(cells.limit(0), edges).count() == 0 and spatial.cells_in_regions(cells, edges.limit(0)).count() == 0
