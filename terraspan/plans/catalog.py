"""Queries over the driver's tables and their SQL.

Roles: a nation is a region, a customer or supplier a grid cell, line items by month are source A, orders by month
source B. Missing values are put in where the tables have none.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraspan.functions import columns as C
from terraspan.functions import projection
from terraspan.functions.scalar import days_since, latitude_weight, month_index, normal_longitude
from terraspan.functions.storage import new_path
from terraspan.operators import align, explore, moments, multiscale, normalize, ranges, spatial, windows
from terraspan.plans import regional
from terraspan.sources import files, netcdf

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

VARIABLES = ["qty", "price", "total"]
SPLIT = windows.SplitSpec(train_until=1996, val_until=1998)
SETTINGS = regional.Settings(split=SPLIT)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Round, and turn -0.0 into 0.0."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in names})


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- grid ------------------------------------------------------------------------------------------------------------


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Customers as cells with coordinates made from their keys."""
    key = F.col("c_custkey")
    return read(spark, d, "customer").select(
        key.alias("cell"), F.col("c_nationkey").cast("long").alias("region_id"),
        ((key * 37) % 720 - 360 + F.lit(0.5)).alias("lon"), ((key * 53) % 179 - 89 + F.lit(0.25)).alias("lat"),
    )


CELLS = """cells AS (SELECT c_custkey AS cell, c_nationkey::BIGINT AS region_id, (c_custkey * 37) % 720 - 360 + 0.5::DOUBLE AS lon,
  (c_custkey * 53) % 179 - 89 + 0.25::DOUBLE AS lat FROM customer)"""
WRAP = "((lon + 180) - 360 * floor((lon + 180) / 360)) - 180"


@query("lon_normalize", f"WITH {CELLS} SELECT cell, {WRAP} AS lon FROM cells")
def lon_normalize(spark, d):
    return cells(spark, d).select("cell", normal_longitude(F.col("lon")).alias("lon"))


@query("lon_range", f"WITH {CELLS} SELECT min({WRAP}) AS least, max({WRAP}) AS largest FROM cells")
def lon_range(spark, d):
    lon = normal_longitude(F.col("lon"))
    return cells(spark, d).agg(F.min(lon).alias("least"), F.max(lon).alias("largest"))


@query("lat_weights", f"WITH {CELLS} SELECT cell, {r('cos(radians(lat))', 9)} AS weight FROM cells")
def lat_weights(spark, d):
    return rounded(cells(spark, d).select("cell", latitude_weight(F.col("lat")).alias("weight")), "weight", digits=9)


def grid(spark: SparkSession, d: str) -> DataFrame:
    """Order values at cells by month; some missing, and one region without any."""
    price = F.when((F.col("o_orderkey") % 7 != 0) & (F.col("region_id") != 3), F.col("o_totalprice"))
    orders = read(spark, d, "orders").select("o_custkey", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("time"), "o_orderkey", "o_totalprice")
    joined = orders.join(cells(spark, d), orders.o_custkey == F.col("cell"))
    return joined.select("region_id", "time", "lat", price.alias("total"), F.col("o_orderkey").cast("double").alias("number"))


GRID = f"""{CELLS}, grid AS (SELECT region_id, date_trunc('month', o_orderdate) AS time, lat,
  CASE WHEN o_orderkey % 7 <> 0 AND region_id <> 3 THEN o_totalprice END AS total, o_orderkey::DOUBLE AS number
  FROM orders JOIN cells ON o_custkey = cell),
means AS (SELECT region_id, time, sum(total * cos(radians(lat))) / nullif(sum(CASE WHEN total IS NOT NULL THEN cos(radians(lat)) END), 0) AS total,
  sum(number * cos(radians(lat))) / sum(cos(radians(lat))) AS number FROM grid GROUP BY region_id, time)"""


def by_month(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c not in ("region_id", "time")]
    return df.select("region_id", F.year("time").alias("year"), F.month("time").alias("month"), *rest)


YM = "year(time)::INT AS year, month(time)::INT AS month"


@query("region_weighted_mean", f"WITH {GRID} SELECT region_id, {YM}, {r('total', 4)} AS total, {r('number', 4)} AS number FROM means")
def region_weighted_mean(spark, d):
    return rounded(by_month(spatial.weighted_means(grid(spark, d), ["total", "number"])), "total", "number", digits=4)


@query("region_weighted_mean_dense", f"""WITH {GRID}, regions AS (SELECT n_nationkey::BIGINT AS region_id FROM nation UNION ALL SELECT 99),
times AS (SELECT DISTINCT time FROM means)
SELECT region_id, {YM}, {r('total', 4)} AS total, {r('number', 4)} AS number FROM regions CROSS JOIN times LEFT JOIN means USING (region_id, time)""")
def region_weighted_mean_dense(spark, d):
    regions = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("region_id")).unionByName(spark.range(99, 100).toDF("region_id"))
    means = spatial.weighted_means(grid(spark, d), ["total", "number"])
    return rounded(by_month(spatial.dense(means, regions)), "total", "number", digits=4)


#: Rings of test regions: a box, a box that overlaps it, a concave shape, a box with a hole, and one without cells.
RINGS = [
    (1, [(-170, -60), (-100, -60), (-100, 20), (-170, 20)]),
    (2, [(-120, -30), (-40, -30), (-40, 60), (-120, 60)]),
    (3, [(0, -50), (80, -50), (80, 50), (40, 0), (0, 50)]),
    (4, [(90, -70), (170, -70), (170, 70), (90, 70)]),
    (4, [(110, -40), (150, -40), (150, 40), (110, 40)]),
    (5, [(0.6, 0.3), (0.7, 0.3), (0.65, 0.35)]),
]
SIDES = [(region, *map(float, p), *map(float, q)) for region, ring in RINGS for p, q in zip(ring, ring[1:] + ring[:1], strict=True)]
PLACED = f"""{CELLS}, wrapped AS (SELECT cell, {WRAP} AS lon, lat FROM cells),
sides(region_id, x1, y1, x2, y2) AS (VALUES {", ".join(f"({s[0]}::BIGINT, {s[1]}::DOUBLE, {s[2]}::DOUBLE, {s[3]}::DOUBLE, {s[4]}::DOUBLE)" for s in SIDES)}),
inside AS (SELECT cell, region_id FROM wrapped JOIN sides ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1
  GROUP BY cell, region_id HAVING count(*) % 2 = 1),
placed AS (SELECT cell, min(region_id) AS region_id FROM inside GROUP BY cell)"""


def sides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SIDES, "region_id long, x1 double, y1 double, x2 double, y2 double")


def outlines(spark: SparkSession, d: str) -> DataFrame:
    """Nations as four-cornered regions made from their keys, those of every fourth one across the antimeridian."""
    key = F.col("n_nationkey")
    west, south = F.when(key % 4 == 0, 150.0 + key).otherwise((key * 67) % 260 - 170 + F.lit(0.25)), (key * 31) % 110 - 70 + F.lit(0.5)
    wide, high = F.when(key % 4 == 0, 40.0 + key).otherwise(25.0 + key), 10.0 + key
    corner = lambda dx, dy: F.struct(normal_longitude(west + dx * wide).alias("x"), (south + dy * high).alias("y"))
    ring = [corner(0.0, 0.0), corner(1.0, 0.125), corner(0.75, 1.0), corner(0.125, 0.875)]
    sides = F.array(*[F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")) for p, q in zip(ring, ring[1:] + ring[:1], strict=True)])
    return read(spark, d, "nation").select(key.cast("long").alias("region_id"), F.inline(sides))


CORNERS = ["0.0, 0.0", "1.0, 0.125", "0.75, 1.0", "0.125, 0.875"]
OUTLINES = f"""boxes AS (SELECT n_nationkey::BIGINT AS region_id, CASE WHEN n_nationkey % 4 = 0 THEN 150.0 + n_nationkey ELSE (n_nationkey * 67) % 260 - 170 + 0.25 END::DOUBLE AS west,
  ((n_nationkey * 31) % 110 - 70 + 0.5)::DOUBLE AS south, CASE WHEN n_nationkey % 4 = 0 THEN 40.0 + n_nationkey ELSE 25.0 + n_nationkey END::DOUBLE AS wide, (10.0 + n_nationkey)::DOUBLE AS high FROM nation),
corners(k, ax, ay, ex, ey) AS (VALUES {", ".join(f"({k}, {p}, {q})" for k, (p, q) in enumerate(zip(CORNERS, CORNERS[1:] + CORNERS[:1], strict=True)))}),
flat AS (SELECT region_id, west + ax * wide AS x1, south + ay * high AS y1, west + ex * wide AS x2, south + ey * high AS y2 FROM boxes, corners)"""
TURNED = "{0} - 360 * floor(({0} + 180) / 360)"


@query("region_outlines", f"WITH {OUTLINES} SELECT region_id, {r(TURNED.format('x1'))} AS x1, {r('y1')} AS y1, {r(TURNED.format('x2'))} AS x2, {r('y2')} AS y2 FROM flat")
def region_outlines(spark, d):
    """What a map of the regions alone draws."""
    return rounded(outlines(spark, d), "x1", "y1", "x2", "y2")


@query("cell_to_outline", f"""WITH {OUTLINES}, {CELLS}, wrapped AS (SELECT cell, {WRAP} AS lon, lat FROM cells),
moved AS (SELECT region_id, x1 - t AS x1, y1, x2 - t AS x2, y2 FROM flat, (VALUES (0), (360)) AS s(t)),
inside AS (SELECT cell, region_id FROM wrapped JOIN moved ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1 GROUP BY cell, region_id HAVING count(*) % 2 = 1)
SELECT cell, min(region_id) AS region_id FROM inside GROUP BY cell""")
def cell_to_outline(spark, d):
    """Cells in regions that overlap, some of which cross the antimeridian."""
    wrapped = cells(spark, d).select("cell", normal_longitude(F.col("lon")).alias("lon"), "lat")
    return spatial.cells_in_regions(wrapped, outlines(spark, d)).select("cell", "region_id")


@query("cell_to_region", f"WITH {PLACED} SELECT cell, region_id FROM placed")
def cell_to_region(spark, d):
    wrapped = cells(spark, d).select("cell", normal_longitude(F.col("lon")).alias("lon"), "lat")
    return spatial.cells_in_regions(wrapped, sides(spark)).select("cell", "region_id")


@query("regional_series", f"""WITH {PLACED}, g AS (SELECT p.region_id, date_trunc('month', o_orderdate) AS time, lat, o_totalprice AS total
  FROM orders JOIN cells c ON o_custkey = c.cell JOIN placed p ON p.cell = c.cell),
m AS (SELECT region_id, time, sum(total * cos(radians(lat))) / sum(cos(radians(lat))) AS total FROM g GROUP BY region_id, time)
SELECT region_id, {YM}, {r('total', 4)} AS total FROM (SELECT DISTINCT region_id FROM sides) CROSS JOIN (SELECT DISTINCT time FROM m) LEFT JOIN m USING (region_id, time)""")
def regional_series(spark, d):
    orders = read(spark, d, "orders").select("o_custkey", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("time"), F.col("o_totalprice").alias("total"))
    gridded = orders.join(cells(spark, d), orders.o_custkey == F.col("cell")).select("time", normal_longitude(F.col("lon")).alias("lon"), "lat", "total")
    return rounded(by_month(regional.regional_series(gridded, sides(spark), ["total"])), "total", digits=4)


@query("days_since_decode", """SELECT event_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS decoded, year(t)::INT AS year, month(t)::INT AS month
FROM (SELECT event_id, TIMESTAMP '2002-01-01' + to_microseconds((event_id / 8.0 * 86400000000)::BIGINT) AS t FROM events)""")
def days_since_decode(spark, d):
    t = days_since(F.col("event_id") / 8.0)
    return read(spark, d, "events").select("event_id", F.date_format(t, "yyyy-MM-dd HH:mm:ss").alias("decoded"), F.year(t).alias("year"), F.month(t).alias("month"))


# ---- projections -----------------------------------------------------------------------------------------------------


def projected(spark: SparkSession, d: str) -> DataFrame:
    """Customers at projected places: Web Mercator, and UTM zones of either half and either ellipsoid."""
    key = F.col("c_custkey")
    code = F.when(key % 4 == 0, 3857).when(key % 4 == 1, 32601 + key % 60).when(key % 4 == 2, 32701 + key % 60).otherwise(25828 + key % 11)
    x = F.when(key % 4 == 0, (key * 7919) % 40_000_000 - 20_000_000).otherwise(200_000 + (key * 7919) % 600_000)
    y = F.when(key % 4 == 0, (key * 104_729) % 30_000_000 - 15_000_000).otherwise((key * 104_729) % 9_300_000 + F.when(key % 4 == 2, 600_000).otherwise(0))
    return read(spark, d, "customer").select(key.alias("cell"), code.alias("epsg"), x.cast("double").alias("x"), y.cast("double").alias("y"))


def utm_sql(flattening: float) -> str:
    """lon and lat of ``x`` and ``y`` in a query over p, step by step."""
    e, sphere, beta = projection.series(flattening)
    total = lambda f, g: " - ".join(f"{b!r} * {f}(2 * {j} * xi) * {g}(2 * {j} * eta)" for j, b in beta.items())
    steps = f"SELECT *, atan(sinh(q)) AS f0 FROM (SELECT *, atanh(sin(up) / cosh(across)) AS q FROM (SELECT *, xi - {total('sin', 'cosh')} AS up, eta - {total('cos', 'sinh')} AS across FROM (SELECT *, (y - off) / {projection.SCALE * sphere!r} AS xi, (x - 500000) / {projection.SCALE * sphere!r} AS eta FROM p)))"
    for k in range(7):
        steps = f"SELECT *, atan(sinh(q + {e!r} * atanh({e!r} * sin(f{k})))) AS f{k + 1} FROM ({steps})"
    return f"SELECT cell, degrees(atan2(sinh(across), cos(up))) + zone * 6 - 183 AS lon, degrees(f7) AS lat FROM ({steps})"


@query("reprojected_cells", f"""WITH k AS (SELECT c_custkey AS cell, c_custkey % 4 AS m, CASE c_custkey % 4 WHEN 0 THEN (c_custkey * 7919) % 40000000 - 20000000 ELSE 200000 + (c_custkey * 7919) % 600000 END::DOUBLE AS x,
  CASE c_custkey % 4 WHEN 0 THEN (c_custkey * 104729) % 30000000 - 15000000 ELSE (c_custkey * 104729) % 9300000 + CASE WHEN c_custkey % 4 = 2 THEN 600000 ELSE 0 END END::DOUBLE AS y FROM customer),
p AS (SELECT *, CASE m WHEN 3 THEN 28 + cell % 11 ELSE 1 + cell % 60 END AS zone, CASE m WHEN 2 THEN 1e7 ELSE 0 END AS off FROM k),
w AS ({utm_sql(projection.FLATTENING["WGS84"])}), g AS ({utm_sql(projection.FLATTENING["GRS80"])}),
a AS (SELECT cell, degrees(x / 6378137) AS lon, degrees(2 * atan(exp(y / 6378137)) - pi() / 2) AS lat FROM p WHERE m = 0
  UNION ALL SELECT cell, lon, lat FROM w WHERE cell % 4 IN (1, 2) UNION ALL SELECT cell, lon, lat FROM g WHERE cell % 4 = 3)
SELECT cell, {r(WRAP, 8)} AS lon, {r('lat', 8)} AS lat FROM a""")
def reprojected_cells(spark, d):
    degrees = projection.lon_lat(F.col("x"), F.col("y"), F.col("epsg"))
    return rounded(projected(spark, d).select("cell", degrees.alias("p")).select("cell", "p.lon", "p.lat"), "lon", "lat", digits=8)


# ---- files -----------------------------------------------------------------------------------------------------------


def coarse_grid(spark: SparkSession, d: str) -> DataFrame:
    """Mean order value and number of orders by month and box of 15 by 30 degrees; most cells have none."""
    coarse = lambda c, step: (F.floor(F.col(c) / step) * step + step / 2).alias(c)
    orders = read(spark, d, "orders").select("o_custkey", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("time"), "o_totalprice")
    joined = orders.join(cells(spark, d), orders.o_custkey == F.col("cell"))
    return joined.groupBy("time", coarse("lat", 15), coarse("lon", 30)).agg(F.avg("o_totalprice").alias("price"), F.count("*").cast("int").alias("n"))


COARSE = f"""{CELLS}, coarse AS (SELECT date_trunc('month', o_orderdate) AS time, floor(lat / 15) * 15 + 7.5 AS lat, floor(lon / 30) * 30 + 15.0 AS lon,
  avg(o_totalprice) AS price, count(*)::BIGINT AS n FROM orders JOIN cells ON o_custkey = cell GROUP BY 1, 2, 3)"""


def grid_file(spark: SparkSession, d: str) -> str:
    """The grid as a NetCDF file in the shared folder."""
    path = new_path(spark, "grid").removeprefix("file://").removeprefix("file:") + ".nc"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    netcdf.write_netcdf(coarse_grid(spark, d), path, ["time", "lat", "lon"], {"title": "orders by month"})
    return path


@query("netcdf_round_trip", f"""WITH {COARSE} SELECT {YM}, lat, lon, {r('price', 4)} AS price, n FROM (SELECT DISTINCT time FROM coarse)
  CROSS JOIN (SELECT DISTINCT lat FROM coarse) CROSS JOIN (SELECT DISTINCT lon FROM coarse) LEFT JOIN coarse USING (time, lat, lon)""")
def netcdf_round_trip(spark, d):
    """Every cell of the grid as the file gives it back, those without orders too."""
    back = netcdf.read_netcdf(spark, grid_file(spark, d))
    return rounded(back.select(F.year("time").alias("year"), F.month("time").alias("month"), "lat", "lon", "price", "n"), "price", digits=4)


@query("netcdf_box", f"WITH {COARSE} SELECT {YM}, lat, lon, n FROM coarse WHERE time BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1998-06-30' AND lat BETWEEN -45 AND 45 AND lon >= 0")
def netcdf_box(spark, d):
    """One variable in a box of times and cells; nothing else of the file is read."""
    box = {"time": (datetime(1996, 3, 1), datetime(1998, 6, 30)), "lat": (-45, 45), "lon": (0, None)}
    back = netcdf.read_netcdf(spark, grid_file(spark, d), ["n"], box=box)
    return back.where("n is not null").select(F.year("time").alias("year"), F.month("time").alias("month"), "lat", "lon", "n")


@query("clustered_box", f"WITH {COARSE} SELECT {YM}, lat, lon, {r('price', 4)} AS price FROM coarse WHERE time BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1997-06-30' AND lat BETWEEN 0 AND 45 AND lon BETWEEN -90 AND 30")
def clustered_box(spark, d):
    """A box out of a grid that is stored along a curve; the scan skips row groups by their statistics."""
    path = new_path(spark, "clustered")
    files.write_clustered(coarse_grid(spark, d), path)
    ntz = lambda s: F.lit(s).cast("timestamp_ntz")
    box = spark.read.parquet(path).where(F.col("time").between(ntz("1996-03-01"), ntz("1997-06-30")) & F.col("lat").between(0, 45) & F.col("lon").between(-90, 30))
    return rounded(box.select(F.year("time").alias("year"), F.month("time").alias("month"), "lat", "lon", "price"), "price", digits=4)


# ---- series and alignment --------------------------------------------------------------------------------------------


def series_a(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem").select("l_suppkey", "l_shipdate", "l_linenumber", "l_quantity", "l_extendedprice")
    suppliers = read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("region_id"))
    month = F.date_trunc("month", "l_shipdate").cast("timestamp_ntz")
    joined = lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey)
    return joined.groupBy("region_id", month.alias("time")).agg(
        F.avg(F.when(F.col("l_linenumber") % 7 != 0, F.col("l_quantity"))).alias("qty"), F.avg("l_extendedprice").alias("price")
    )


def series_b(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customers = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("region_id"))
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).groupBy("region_id", month.alias("time")).agg(F.avg("o_totalprice").alias("total"))


def series_b_twice(spark: SparkSession, d: str) -> DataFrame:
    """Source B with a second observation in April for some regions."""
    b = series_b(spark, d)
    again = b.where("region_id % 7 = 0 and month(time) = 4").withColumns({"time": F.timestamp_add("DAY", F.lit(10), F.col("time")), "total": F.col("total") + 1.0})
    return b.unionByName(again)


def merged(spark: SparkSession, d: str, twice: bool = False) -> DataFrame:
    b = (series_b_twice if twice else series_b)(spark, d)
    return align.merge(align.calendar_keys(series_a(spark, d), "a"), align.calendar_keys(b, "b"))


BASE = """a AS (SELECT s_nationkey::BIGINT AS region_id, year(l_shipdate)::INT AS year, month(l_shipdate)::INT AS month,
  avg(CASE WHEN l_linenumber % 7 <> 0 THEN l_quantity END) AS qty, avg(l_extendedprice) AS price
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3),
b AS (SELECT c_nationkey::BIGINT AS region_id, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, avg(o_totalprice) AS total
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
bb AS (SELECT *, 0 AS again FROM b UNION ALL SELECT region_id, year, month, total + 1.0, 1 FROM b WHERE region_id % 7 = 0 AND month = 4),
m AS (SELECT * FROM a JOIN b USING (region_id, year, month)),
mm AS (SELECT * FROM a JOIN bb USING (region_id, year, month))"""


def each(template: str, of: list[str] = VARIABLES) -> str:
    return ", ".join(template.format(v=v) for v in of)


NORM = f"""{BASE},
n1 AS (SELECT *, {each('avg({v}) OVER (PARTITION BY region_id, month) AS {v}_climatology')} FROM m),
n2 AS (SELECT *, {each('{v} - {v}_climatology AS {v}_anomaly')} FROM n1),
n3 AS (SELECT *, {each('stddev_pop({v}_anomaly) OVER (PARTITION BY region_id) AS {v}_anomaly_std')} FROM n2),
n AS (SELECT *, {each('{v}_anomaly / nullif({v}_anomaly_std, 0) AS {v}_anomaly_normalized')} FROM n3)"""


@query("monthly_series_a", f"WITH {BASE} SELECT region_id, year, month, {r('qty')} AS qty, {r('price')} AS price FROM a")
def monthly_series_a(spark, d):
    return rounded(align.calendar_keys(series_a(spark, d), "a").drop("time_a"), "qty", "price")


@query("monthly_series_b", f"WITH {BASE} SELECT region_id, year, month, {r('total')} AS total FROM b")
def monthly_series_b(spark, d):
    return rounded(align.calendar_keys(series_b(spark, d), "b").drop("time_b"), "total")


@query("merge_ab", f"WITH {BASE} SELECT region_id, year, month, {each('round({v}, 6) + 0.0 AS {v}')} FROM m")
def merge_ab(spark, d):
    return rounded(merged(spark, d).drop("time_a", "time_b"), *VARIABLES)


@query("merge_fanout_counts", f"WITH {BASE} SELECT region_id, year, month, count(*) AS n_rows FROM mm GROUP BY 1, 2, 3")
def merge_fanout_counts(spark, d):
    return align.multiplicity(merged(spark, d, twice=True))


@query("dup_histogram", f"WITH {BASE}, c AS (SELECT count(*) AS n_rows FROM mm GROUP BY region_id, year, month) SELECT n_rows, count(*) AS n_keys FROM c GROUP BY n_rows ORDER BY n_rows LIMIT 20")
def dup_histogram(spark, d):
    return align.multiplicity_histogram(merged(spark, d, twice=True))


@query("repeated_keys", f"WITH {BASE} SELECT region_id, year, month, {r('total')} AS total FROM mm SEMI JOIN (SELECT region_id, year, month FROM mm GROUP BY ALL HAVING count(*) > 1) k USING (region_id, year, month)")
def repeated_keys(spark, d):
    return rounded(align.repeated_keys(merged(spark, d, twice=True)).select(*align.KEY, "total"), "total")


@query("dedupe_keep_first", f"""WITH {BASE} SELECT region_id, year, month, {r('total')} AS total FROM mm
QUALIFY row_number() OVER (PARTITION BY region_id, year, month ORDER BY again) = 1""")
def dedupe_keep_first(spark, d):
    return rounded(align.keep_first(merged(spark, d, twice=True), ["time_b", "time_a"]).select(*align.KEY, "total"), "total")


# ---- normalisation ---------------------------------------------------------------------------------------------------


def normalized(spark: SparkSession, d: str) -> DataFrame:
    return regional.normalized(series_a(spark, d), series_b(spark, d), VARIABLES)


@query("climatology", f"WITH {BASE} SELECT region_id, month, {each('round(avg({v}), 6) + 0.0 AS {v}_climatology')} FROM m GROUP BY 1, 2")
def climatology(spark, d):
    return rounded(normalize.climatology(merged(spark, d), VARIABLES), *[f"{v}_climatology" for v in VARIABLES])


@query("anomaly", f"WITH {NORM} SELECT region_id, year, month, {each('round({v}_anomaly, 5) + 0.0 AS {v}_anomaly')} FROM n")
def anomaly(spark, d):
    names = [f"{v}_anomaly" for v in VARIABLES]
    return rounded(normalize.with_anomalies(merged(spark, d), VARIABLES).select(*align.KEY, *names), *names, digits=5)


@query("anomaly_std", f"WITH {NORM} SELECT region_id, {each('round(stddev_pop({v}_anomaly), 5) + 0.0 AS {v}_anomaly_std')} FROM n GROUP BY 1")
def anomaly_std(spark, d):
    return rounded(normalize.anomaly_std(normalize.with_anomalies(merged(spark, d), VARIABLES), VARIABLES), *[f"{v}_anomaly_std" for v in VARIABLES], digits=5)


@query("normalized_anomaly", f"WITH {NORM} SELECT region_id, year, month, {each('round({v}_anomaly_normalized, 6) + 0.0 AS {v}_anomaly_normalized')} FROM n")
def normalized_anomaly(spark, d):
    names = [f"{v}_anomaly_normalized" for v in VARIABLES]
    return rounded(normalized(spark, d).select(*align.KEY, *names), *names)


def long_sql(suffix: str) -> str:
    return " UNION ALL ".join(f"SELECT '{v}' AS variable, region_id, year, month, {v}{suffix} AS value FROM n" for v in VARIABLES)


@query("qc_monthly_mean", f"""WITH {NORM}, l AS ({long_sql('_anomaly')}), g AS (SELECT variable, abs(avg(value)) AS x FROM l GROUP BY variable, region_id, month)
SELECT variable, avg(x) < 1e-6 AS mean_ok, median(x) < 1e-6 AS median_ok, max(x) < 1e-6 AS max_ok FROM g GROUP BY 1""")
def qc_monthly_mean(spark, d):
    found = normalize.check_monthly_means(normalized(spark, d), VARIABLES)
    return found.select("variable", *[(F.col(f"{x}_abs") < 1e-6).alias(f"{x}_ok") for x in ("mean", "median", "max")])


@query("qc_normalized_std", f"""WITH {NORM}, l AS ({long_sql('_anomaly_normalized')}), g AS (SELECT variable, stddev_pop(value) AS x FROM l GROUP BY variable, region_id)
SELECT variable, {r('avg(x)')} AS mean_std, {r('median(x)')} AS median_std, {r('min(x)')} AS min_std, {r('max(x)')} AS max_std FROM g GROUP BY 1""")
def qc_normalized_std(spark, d):
    return rounded(normalize.check_normalized_std(normalized(spark, d), VARIABLES), "mean_std", "median_std", "min_std", "max_std")


FIT = f"""{BASE}, c AS (SELECT region_id, month, {each('avg({v}) AS {v}_climatology')} FROM m WHERE year <= 1996 GROUP BY 1, 2),
sd AS (SELECT region_id, {each('sqrt(avg(pow({v} - {v}_climatology, 2))) AS {v}_std')} FROM m JOIN c USING (region_id, month) WHERE year <= 1996 GROUP BY 1)"""
NORMALIZED = [f"{v}_anomaly_normalized" for v in VARIABLES]


@query("fitted_normalized", f"""WITH {FIT} SELECT region_id, year, month, {each('round(({v} - {v}_climatology) / nullif({v}_std, 0), 6) + 0.0 AS {v}_anomaly_normalized')}
FROM m LEFT JOIN c USING (region_id, month) LEFT JOIN sd USING (region_id)""")
def fitted_normalized(spark, d):
    """All months, normalised by what the training years alone say."""
    rows = merged(spark, d)
    fitted = moments.merged(moments.states(rows.where(F.col("year") <= SPLIT.train_until), VARIABLES))
    return rounded(moments.normalized(rows, fitted, VARIABLES).select(*align.KEY, *NORMALIZED), *NORMALIZED)


@query("incremental_normalized", f"WITH {NORM} SELECT region_id, year, month, {each('round({v}_anomaly_normalized, 6) + 0.0 AS {v}_anomaly_normalized')} FROM n")
def incremental_normalized(spark, d):
    """The same as from all rows at once, from states stored in three batches, one of which comes twice."""
    rows, path = merged(spark, d), new_path(spark, "states")
    for batch, test in (("first", "year <= 1996"), ("second", "year = 1997"), ("second", "year = 1997"), ("third", "year > 1997")):
        moments.add_batch(spark, path, rows.where(test), VARIABLES, batch)
    return rounded(moments.normalized(rows, moments.load(spark, path), VARIABLES).select(*align.KEY, *NORMALIZED), *NORMALIZED)


@query("anomaly_quantiles", f"""WITH {NORM}, l AS ({long_sql('_anomaly_normalized')}) SELECT variable, month, {r('quantile_cont(value, 0.05)')} AS low, {r('quantile_cont(value, 0.5)')} AS middle, {r('quantile_cont(value, 0.95)')} AS high
FROM l WHERE value IS NOT NULL GROUP BY 1, 2""")
def anomaly_quantiles(spark, d):
    long = normalize.long_form(normalized(spark, d), align.KEY, {f"{v}_anomaly_normalized": v for v in VARIABLES})
    return rounded(ranges.quantiles(long, "value", {"low": 0.05, "middle": 0.5, "high": 0.95}, ["variable", "month"]), "low", "middle", "high")


# ---- bands -----------------------------------------------------------------------------------------------------------


def lacking(value: Column) -> Column:
    return F.when((F.col("region_id") * 31 + F.col("time")) % 11 != 0, value)


def long_rows(spark: SparkSession, d: str) -> DataFrame:
    """Normalised anomalies, some missing; regions with a short series, and one with too few values, among them."""
    rows = normalized(spark, d).withColumn("time", month_index(F.col("year"), F.col("month")))
    long = normalize.long_form(rows, ["region_id", "year", "month", "time"], {"qty_anomaly_normalized": "qty", "total_anomaly_normalized": "total"})
    long = long.where((F.col("region_id") != 1) | (F.col("year") < 1996)).where((F.col("region_id") != 2) | (F.col("year") < 1998))
    return long.withColumn("value", F.when((F.col("region_id") != 2) | (F.col("time") % 3 == 0), lacking(F.col("value"))))


def smoothed(x: str, step: int, order: int = 4) -> str:
    """A pass of the half-band filter over the list ``x`` of ``np`` values."""
    terms = "".join(f" + {w!r} * ({x}[(i - {k * step} + 4096 * np) % np + 1] + {x}[(i + {k * step}) % np + 1])" for k, w in multiscale.half_band(order)[1])
    return f"list_transform(range(0, np), lambda i: 0.5 * {x}[i + 1]{terms})"


def bands_sql(rows: str, level: int = 5, order: int = 4, smooth: int = 3) -> str:
    """CTEs from l (region_id, year, month, time, variable, value), given by ``rows``, to g (filled) and a0, a1, ... of each series."""
    return f"""l AS ({rows}),
i AS (SELECT *, row_number() OVER w AS i, count(*) OVER p AS rows_there, count(value) OVER p AS finite FROM l
  WINDOW w AS (PARTITION BY region_id, variable ORDER BY time), p AS (PARTITION BY region_id, variable)),
f AS (SELECT *, last_value(value IGNORE NULLS) OVER back AS pv, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER back AS pi,
  first_value(value IGNORE NULLS) OVER ahead AS nv, first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER ahead AS ni FROM i WHERE rows_there >= 16
  WINDOW back AS (PARTITION BY region_id, variable ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         ahead AS (PARTITION BY region_id, variable ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
g AS (SELECT *, finite >= 24 AS kept, CASE WHEN finite < 24 THEN NULL WHEN value IS NOT NULL THEN value WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv
  ELSE pv + (nv - pv) * ((i - pi)::DOUBLE / (ni - pi)) END AS filled FROM f),
x AS (SELECT region_id, variable, list(filled ORDER BY time) AS x, count(*) AS n, (ceil(count(*) / {1 << level}.0) * {1 << level})::BIGINT AS np FROM g WHERE kept GROUP BY 1, 2),
a0 AS (SELECT *, list_transform(range(0, np), lambda i: x[CASE WHEN i < n THEN i ELSE 2 * (n - 1) - i END + 1]) AS a0 FROM x),
{", ".join(f"a{k + 1} AS (SELECT *, {smoothed(f'a{k}', 1 << k, order)} AS a{k + 1} FROM a{k})" for k in range(smooth))}"""


BANDS = """bands AS (SELECT g.region_id, g.variable, g.year, g.month, g.time, g.kept, g.value, g.filled, g.filled - a2[g.i] AS short, a2[g.i] - a3[g.i] AS seasonal, a3[g.i] AS long
  FROM g LEFT JOIN a3 ON a3.region_id = g.region_id AND a3.variable = g.variable)"""
LONG_ROWS = """SELECT region_id, year, month, year * 12 + month AS time, variable,
  CASE WHEN (region_id <> 2 OR (year * 12 + month) % 3 = 0) AND (region_id * 31 + year * 12 + month) % 11 <> 0 THEN value END AS value
  FROM (SELECT region_id, year, month, 'qty' AS variable, qty_anomaly_normalized AS value FROM n
        UNION ALL SELECT region_id, year, month, 'total', total_anomaly_normalized FROM n)
  WHERE (region_id <> 1 OR year < 1996) AND (region_id <> 2 OR year < 1998)"""
LONG = f"{NORM}, {bands_sql(LONG_ROWS)}, {BANDS}"


def banded(spark: SparkSession, d: str) -> DataFrame:
    return multiscale.bands(long_rows(spark, d), ["time", "year", "month"])


@query("interpolate_both", f"WITH {LONG} SELECT region_id, variable, time, {r('filled')} AS filled FROM g WHERE kept")
def interpolate_both(spark, d):
    return rounded(banded(spark, d).where("kept").select("region_id", "variable", "time", "filled"), "filled")


@query("reflect_pad", f"WITH {LONG} SELECT region_id, variable, np::INT AS padded, {r('list_sum(a0)', 5)} AS total, {r('a0[np]')} AS at_end FROM a0")
def reflect_pad(spark, d):
    whole = multiscale.padded(long_rows(spark, d), ["region_id", "variable"], ["time"], multiscale.BandSpec()).where("kept")
    out = whole.groupBy("region_id", "variable").agg(F.count("*").cast("int").alias("padded"), F.round(F.sum("filled"), 5).alias("total"), F.max_by("filled", "place").alias("at_end"))
    return rounded(out, "at_end").withColumn("total", F.col("total") + F.lit(0.0))


@query("wavelet_bands", f"WITH {LONG} SELECT region_id, variable, year, month, {each('round({v}, 6) + 0.0 AS {v}', ['short', 'seasonal', 'long'])} FROM bands WHERE kept")
def wavelet_bands(spark, d):
    names = ["short", "seasonal", "long"]
    return rounded(banded(spark, d).where("kept").select("region_id", "variable", "year", "month", *names), *names)


def convolved(x: str, taps: tuple[float, ...], step: int) -> str:
    """An analysis filter over the list ``x``, centred."""
    terms = " + ".join(f"{w!r} * {x}[(i + {(len(taps) // 2 - k) * step} + 4096 * np) % np + 1]" for k, w in enumerate(taps))
    return f"list_transform(range(0, np), lambda i: {terms})"


def coefficients_sql() -> str:
    low, high = multiscale.analysis(4)
    levels = [f"c{j} AS (SELECT *, {convolved(f'b{j - 1}', high, 1 << (j - 1))} AS d{j}, {convolved(f'b{j - 1}', low, 1 << (j - 1))} AS b{j} FROM c{j - 1})" for j in range(1, 6)]
    return f"{NORM}, {bands_sql(LONG_ROWS, smooth=0).rstrip().rstrip(',')}, c0 AS (SELECT *, a0 AS b0 FROM a0), {', '.join(levels)}"


PARTS = ["d1", "d2", "d3", "d4", "d5", "a5"]


@query("wavelet_coefficients", f"WITH {coefficients_sql()} SELECT g.region_id, g.variable, g.year, g.month, {each('round({v}[g.i], 6) + 0.0 AS {v}', PARTS[:5])}, round(b5[g.i], 6) + 0.0 AS a5 FROM g JOIN c5 USING (region_id, variable) WHERE kept")
def wavelet_coefficients(spark, d):
    """The transform itself, at the samples of each series."""
    found = multiscale.coefficients(long_rows(spark, d), ["time", "year", "month"]).where("time is not null")
    return rounded(found.select("region_id", "variable", "year", "month", *PARTS), *PARTS)


@query("wavelet_inverse", f"WITH {LONG} SELECT region_id, variable, year, month, round(short, 6) + 0.0 AS short, round(seasonal, 6) + 0.0 AS seasonal, round(filled, 6) + 0.0 AS whole FROM bands WHERE kept")
def wavelet_inverse(spark, d):
    """Rebuilt from chosen coefficients: the first two details, the third, all."""
    coeffs, keys = multiscale.coefficients(long_rows(spark, d), ["time", "year", "month"]), ["region_id", "variable", "place"]
    out = coeffs.where("time is not null").select(*keys, "year", "month")
    for name, keep in (("short", PARTS[:2]), ("seasonal", PARTS[2:3]), ("whole", PARTS)):
        out = out.join(multiscale.inverse(coeffs, keep).withColumnRenamed("rebuilt", name), keys)
    return rounded(out.drop("place"), "short", "seasonal", "whole")


#: Settings as a file of them holds.
SCALES = {"wavelet_transform": {"transform_type": "swt", "wavelet_family": "db2", "levels": 3}, "scale_grouping": {"fast": "D1", "middle": "D2 + D3", "slow": "A3"}}


@query("wavelet_scales", f"""WITH {NORM}, {bands_sql(LONG_ROWS, level=3, order=2)} SELECT g.region_id, g.variable, g.year, g.month,
  round(g.filled - a1[g.i], 6) + 0.0 AS fast, round(a1[g.i] - a3[g.i], 6) + 0.0 AS middle, round(a3[g.i], 6) + 0.0 AS slow FROM g JOIN a3 USING (region_id, variable) WHERE kept""")
def wavelet_scales(spark, d):
    """Another filter, fewer levels and other groups, in small blocks."""
    spec = replace(multiscale.BandSpec.of(SCALES), block=32)
    found = multiscale.bands(long_rows(spark, d), ["time", "year", "month"], spec)
    return rounded(found.where("kept").select("region_id", "variable", "year", "month", *spec.names), *spec.names)


WIDE = ", ".join(f"max(CASE WHEN variable = '{v}' THEN {p} END) AS {v}_{p}" for v in ("qty", "total") for p in ("short", "seasonal", "long"))
WIDE_NAMES = [f"{v}_{p}" for v in ("qty", "total") for p in ("short", "seasonal", "long")]


@query("wavelet_outer_merge", f"""WITH {LONG}, w AS (SELECT region_id, year, month, {WIDE} FROM bands WHERE kept GROUP BY 1, 2, 3)
SELECT m.region_id, m.year, m.month, {each('round({v}, 6) + 0.0 AS {v}', WIDE_NAMES)} FROM m LEFT JOIN w USING (region_id, year, month)""")
def wavelet_outer_merge(spark, d):
    wide = multiscale.wide(banded(spark, d), ["qty", "total"], align.KEY)
    return rounded(merged(spark, d).select(*align.KEY).join(wide, align.KEY, "left").select(*align.KEY, *WIDE_NAMES), *WIDE_NAMES)


@query("wavelet_guards", f"WITH {LONG} SELECT region_id, variable, count(*) AS n_rows, count(short) AS n_bands, bool_and(kept) AS kept FROM bands GROUP BY 1, 2")
def wavelet_guards(spark, d):
    return banded(spark, d).groupBy("region_id", "variable").agg(F.count("*").alias("n_rows"), F.count("short").alias("n_bands"), F.bool_and("kept").alias("kept"))


DIAG = f"""{LONG}, diag AS (SELECT region_id, variable, nullif(count(filled), 0) AS n_obs, avg(filled) AS signal_mean, stddev_pop(filled) AS signal_std,
  min(filled) AS signal_min, max(filled) AS signal_max,
  {', '.join(f"CASE WHEN count(CASE WHEN kept THEN value END) >= 2 THEN var_pop({p}) / nullif(var_pop(CASE WHEN kept THEN value END), 0) END AS {p}_frac" for p in ('short', 'seasonal', 'long'))},
  sqrt(avg(pow(filled - (short + seasonal + long), 2))) AS rmse FROM bands GROUP BY 1, 2)"""
FRACS = ["short_frac", "seasonal_frac", "long_frac"]
SIGNAL = ["signal_mean", "signal_std", "signal_min", "signal_max"]


def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return multiscale.diagnostics(banded(spark, d))


@query("variance_partition", f"WITH {DIAG} SELECT region_id, variable, {each('round({v}, 6) + 0.0 AS {v}', FRACS)} FROM diag")
def variance_partition(spark, d):
    return rounded(diagnostics(spark, d).select("region_id", "variable", *FRACS), *FRACS)


@query("recon_error", f"WITH {DIAG} SELECT region_id, variable, rmse < 1e-9 AS exact FROM diag")
def recon_error(spark, d):
    return diagnostics(spark, d).select("region_id", "variable", (F.col("rmse") < 1e-9).alias("exact"))


@query("signal_stats", f"WITH {DIAG} SELECT region_id, variable, n_obs, {each('round({v}, 6) + 0.0 AS {v}', SIGNAL)} FROM diag")
def signal_stats(spark, d):
    return rounded(diagnostics(spark, d).select("region_id", "variable", "n_obs", *SIGNAL), *SIGNAL)


@query("summary_tidy", f"WITH {DIAG} SELECT variable, region_id AS region, {each('round({v}, 6) + 0.0 AS {v}', FRACS)}, rmse < 1e-9 AS exact FROM diag ORDER BY variable, region")
def summary_tidy(spark, d):
    tidy = diagnostics(spark, d).select("variable", F.col("region_id").alias("region"), *FRACS, (F.col("rmse") < 1e-9).alias("exact"))
    return rounded(tidy, *FRACS).orderBy("variable", "region")


@query("summary_by_variable", f"WITH {DIAG} SELECT variable, {each('round(avg({v}), 6) + 0.0 AS {v}', FRACS)} FROM diag GROUP BY 1")
def summary_by_variable(spark, d):
    return rounded(diagnostics(spark, d).groupBy("variable").agg(*[F.avg(c).alias(c) for c in FRACS]), *FRACS)


# ---- windows ---------------------------------------------------------------------------------------------------------


def channel_rows(spark: SparkSession, d: str) -> DataFrame:
    """Merged rows with splits; a missing channel, a gap and a repeated month among them."""
    rows = merged(spark, d).where((F.col("region_id") != 5) | (F.col("year") != 2000) | (F.col("month") != 6))
    rows = rows.withColumn("qty", F.when((F.col("region_id") != 6) | (F.col("year") != 1999) | (F.col("month") != 3), F.col("qty")))
    again = rows.where("region_id = 8 and year = 1995 and month = 9")
    return windows.with_split(rows.unionByName(again), SPLIT)


WIN = f"""{BASE}, rows AS (SELECT region_id, year, month, CASE WHEN region_id = 6 AND year = 1999 AND month = 3 THEN NULL ELSE qty END AS qty, total FROM m
  WHERE NOT (region_id = 5 AND year = 2000 AND month = 6)),
twice AS (SELECT * FROM rows UNION ALL SELECT * FROM rows WHERE region_id = 8 AND year = 1995 AND month = 9),
s AS (SELECT *, CASE WHEN year <= 1996 THEN 'train' WHEN year <= 1998 THEN 'val' WHEN year > 1998 THEN 'test' ELSE 'unknown' END AS split, year * 12 + month AS mi FROM twice),
k AS (SELECT region_id, split, year AS start_year, month AS start_month, lead(year, 23) OVER w AS end_year, lead(month, 23) OVER w AS end_month,
  lead(mi, 23) OVER w - mi AS span, count(DISTINCT mi) OVER (PARTITION BY region_id, split ORDER BY mi RANGE BETWEEN CURRENT ROW AND 23 FOLLOWING) AS months,
  count(*) OVER (PARTITION BY region_id, split ORDER BY mi RANGE BETWEEN CURRENT ROW AND 23 FOLLOWING) AS n,
  count(CASE WHEN qty IS NULL OR total IS NULL THEN 1 END) OVER (PARTITION BY region_id, split ORDER BY mi RANGE BETWEEN CURRENT ROW AND 23 FOLLOWING) AS bad
  FROM s WINDOW w AS (PARTITION BY region_id, split ORDER BY mi)),
win AS (SELECT row_number() OVER (ORDER BY region_id, split, start_year, start_month) - 1 AS sample_id, region_id, split, start_year, start_month, end_year, end_month,
  make_timestamp(start_year, start_month, 1, 0, 0, 0) AS start_time, make_timestamp(end_year, end_month, 1, 0, 0, 0) AS end_time,
  24 AS window_length, 2 AS n_channels FROM k WHERE span = 23 AND months = 24 AND n = 24 AND bad = 0)"""  # fmt: skip


def found(spark: SparkSession, d: str) -> DataFrame:
    return windows.windows(channel_rows(spark, d), ["qty", "total"])


@query("split_assign", f"WITH {WIN} SELECT region_id, year, month, split FROM s")
def split_assign(spark, d):
    return channel_rows(spark, d).select("region_id", "year", "month", "split")


@query("split_unknown_count", f"WITH {WIN} SELECT count(*) FILTER (split = 'unknown') AS n_unknown FROM s")
def split_unknown_count(spark, d):
    return windows.unknown_splits(channel_rows(spark, d))


@query("windows", f"WITH {WIN} SELECT sample_id, region_id, split, start_year, start_month, end_year, end_month, window_length, n_channels FROM win")
def all_windows(spark, d):
    return found(spark, d).drop("start_time", "end_time")


@query("window_counts_describe", f"""WITH {WIN}, c AS (SELECT split, region_id, count(*) AS n FROM win GROUP BY 1, 2)
SELECT split, count(*) AS regions, {r('avg(n)')} AS mean, {r('stddev_samp(n)')} AS std, min(n) AS least, {r('quantile_cont(n, 0.25)')} AS q25,
  {r('quantile_cont(n, 0.5)')} AS q50, {r('quantile_cont(n, 0.75)')} AS q75, max(n) AS largest FROM c GROUP BY 1""")
def window_counts_describe(spark, d):
    return rounded(windows.counts_by_split(found(spark, d)), "mean", "std", "q25", "q50", "q75")


@query("split_leakage", f"WITH {WIN}, c AS (SELECT count(DISTINCT split) AS n FROM win GROUP BY region_id, start_time, end_time) SELECT count(*) FILTER (n > 1) AS leaking FROM c")
def split_leakage(spark, d):
    return windows.leaks(found(spark, d))


@query("window_shape_check", f"WITH {WIN} SELECT count(*) FILTER (window_length <> 24) AS wrong_length, count(*) FILTER (n_channels <> 2) AS wrong_channels FROM win")
def window_shape_check(spark, d):
    return windows.wrong_shapes(found(spark, d), 24, 2)


@query("split_ranges", f"""WITH {WIN} SELECT split, strftime(min(start_time), '%Y-%m') AS first_start, strftime(max(end_time), '%Y-%m') AS last_end, count(*) AS n_windows FROM win GROUP BY 1""")
def split_ranges(spark, d):
    month = lambda c: F.date_format(c, "yyyy-MM").alias(c)
    return windows.split_ranges(found(spark, d)).select("split", month("first_start"), month("last_end"), "n_windows")


#: Bands exist for every month of a series that is long enough, so a month's channels are there if each series' are. A
#: normalised anomaly is NULL where the value is, or where the variable does not vary.
CHAIN = f"""{BASE}, t1 AS (SELECT *, {each('{v} - avg({v}) OVER (PARTITION BY region_id, month) AS {v}_anomaly')} FROM mm),
t2 AS (SELECT *, {each('stddev_pop({v}_anomaly) OVER (PARTITION BY region_id) AS {v}_std')} FROM t1),
long_enough AS (SELECT region_id FROM t2 GROUP BY region_id
  HAVING count(*) >= 16 AND {' AND '.join(f'count(CASE WHEN {v}_std > 1e-8 THEN {v}_anomaly END) >= 24' for v in VARIABLES)}),
rows AS (SELECT DISTINCT region_id, year, month FROM mm WHERE region_id IN (SELECT region_id FROM long_enough)),
s AS (SELECT *, CASE WHEN year <= 1996 THEN 'train' WHEN year <= 1998 THEN 'val' ELSE 'test' END AS split, year * 12 + month AS mi FROM rows),
k AS (SELECT region_id, split, year AS start_year, month AS start_month, lead(year, 23) OVER w AS end_year, lead(month, 23) OVER w AS end_month,
  lead(mi, 23) OVER w - mi AS span FROM s WINDOW w AS (PARTITION BY region_id, split ORDER BY mi))"""


@query("multiscale_windows", f"""WITH {CHAIN} SELECT row_number() OVER (ORDER BY region_id, split, start_year, start_month) - 1 AS sample_id,
  region_id, split, start_year, start_month, end_year, end_month, 24 AS window_length, 9 AS n_channels FROM k WHERE span = 23""")
def multiscale_windows(spark, d):
    """The whole chain from monthly series to windows over band channels."""
    rows = regional.normalized(series_a(spark, d), series_b_twice(spark, d), VARIABLES)
    table, _ = regional.multiscale_table(rows, VARIABLES, SETTINGS, from_b=("total",))
    return regional.window_table(table, SETTINGS).drop("start_time", "end_time")


CHAIN_ROWS = " UNION ALL ".join(f"SELECT region_id, year, month, (year * 12 + month) * 2 + again AS time, '{v}' AS variable, {v}_anomaly / nullif({v}_std, 0) AS value FROM t2" for v in VARIABLES)
CHAIN_NAMES = [f"{v}_{p}" for v in VARIABLES for p in ("short", "seasonal", "long")]


@query("multiscale_values", f"""WITH {CHAIN.split("long_enough AS")[0]} {bands_sql(CHAIN_ROWS)}, {BANDS}
SELECT mm.region_id, mm.year, mm.month, round(max(total), 6) + 0.0 AS total, {", ".join(f"round(max(CASE WHEN variable = '{v}' THEN {p} END), 6) + 0.0 AS {v}_{p}" for v in VARIABLES for p in ("short", "seasonal", "long"))}
FROM mm LEFT JOIN bands b ON b.region_id = mm.region_id AND b.year = mm.year AND b.month = mm.month AND b.time % 2 = 0 AND b.kept WHERE again = 0 GROUP BY 1, 2, 3""")
def multiscale_values(spark, d):
    """The chain's bands month by month: where a month has two observations, the values and bands of the earlier one, from a
    series that holds both, in the order of each variable's own source."""
    rows = regional.normalized(series_a(spark, d), series_b_twice(spark, d), VARIABLES)
    table, _ = regional.multiscale_table(rows, VARIABLES, SETTINGS, from_b=("total",))
    return rounded(table.select(*align.KEY, "total", *CHAIN_NAMES), "total", *CHAIN_NAMES)


# ---- exploration -----------------------------------------------------------------------------------------------------


@query("field_stats", f"""WITH {BASE}, u AS (SELECT 'qty' AS variable, CASE WHEN region_id % 5 <> 0 THEN qty END AS value FROM m UNION ALL SELECT 'total', total FROM m)
SELECT variable, count(*) AS total, count(value) AS valid, count(*) - count(value) AS missing, {r('100.0 * (count(*) - count(value)) / count(*)')} AS missing_percent,
  {r('min(value)')} AS least, {r('max(value)')} AS largest, {r('avg(value)')} AS mean, {r('stddev_pop(value)')} AS std FROM u GROUP BY 1""")
def field_stats(spark, d):
    rows = merged(spark, d).withColumn("qty", F.when(F.col("region_id") % 5 != 0, F.col("qty")))
    return rounded(explore.field_statistics(rows, ["qty", "total"]), "missing_percent", "least", "largest", "mean", "std")


@query("available_year_months", "SELECT DISTINCT year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month FROM orders")
def available_year_months(spark, d):
    return explore.year_months(read(spark, d, "orders"), "o_orderdate")


SLICE = f"{BASE}, slice AS (SELECT region_id, total FROM b WHERE year = 1997 AND month = 5)"


@query("time_slice", f"WITH {SLICE} SELECT region_id, {r('total')} AS total FROM slice")
def time_slice(spark, d):
    return rounded(explore.at_month(series_b_twice(spark, d), 1997, 5).select("region_id", "total"), "total")


@query("step_slice", f"WITH {BASE} SELECT region_id, {r('total')} AS total FROM b WHERE (year, month) = (SELECT (year, month) FROM b GROUP BY year, month ORDER BY year, month LIMIT 1 OFFSET 7)")
def step_slice(spark, d):
    return rounded(explore.at_step(series_b(spark, d), 7).select("region_id", "total"), "total")


def mapped(spark: SparkSession, d: str) -> DataFrame:
    """Regions with the deviation of May 1997 from a round number; some regions are left without a value."""
    regions = read(spark, d, "nation").select(F.col("n_nationkey").alias("region_id"), "n_name")
    values = explore.at_month(series_b(spark, d), 1997, 5).where("region_id % 4 <> 1").select("region_id", (F.col("total") - 150000.0).alias("value"))
    return explore.on_map(regions, values)


MAPPED = f"{SLICE}, mapped AS (SELECT n_nationkey::VARCHAR AS region_id, n_name, total - 150000.0 AS value FROM nation LEFT JOIN slice ON slice.region_id = n_nationkey AND n_nationkey % 4 <> 1)"


@query("region_map_join", f"WITH {MAPPED} SELECT region_id, n_name, {r('value')} AS value FROM mapped")
def region_map_join(spark, d):
    return rounded(mapped(spark, d), "value")


@query("map_match_counts", f"WITH {MAPPED} SELECT count(value) AS matched, count(*) AS total FROM mapped")
def map_match_counts(spark, d):
    return explore.match_counts(mapped(spark, d), "value")


@query("map_color_scale", f"""WITH {MAPPED}, q AS (SELECT quantile_cont(value, 0.02) AS a, quantile_cont(value, 0.98) AS b FROM mapped)
SELECT {r('CASE WHEN a < 0 AND b > 0 THEN -greatest(abs(a), abs(b)) ELSE a END')} AS vmin, {r('CASE WHEN a < 0 AND b > 0 THEN greatest(abs(a), abs(b)) ELSE b END')} AS vmax,
  CASE WHEN a < 0 AND b > 0 THEN 'diverging' ELSE 'sequential' END AS mode FROM q WHERE a IS NOT NULL""")
def map_color_scale(spark, d):
    return rounded(explore.colour_scale(mapped(spark, d), "value"), "vmin", "vmax")


@query("unmatched_ids", f"WITH {MAPPED} SELECT region_id, 'region' AS side FROM mapped WHERE value IS NULL")
def unmatched_ids(spark, d):
    m = mapped(spark, d)
    return explore.unmatched(m, m.where("value is not null"))


@query("plot_bands", f"""WITH {LONG} SELECT year, month, {r('qty_anomaly_normalized')} AS raw, {each('round({v}, 6) + 0.0 AS {v}', ['short', 'seasonal', 'long'])}
FROM bands JOIN n USING (region_id, year, month) WHERE region_id = 7 AND variable = 'qty' AND kept ORDER BY year, month""")
def plot_bands(spark, d):
    names = ["short", "seasonal", "long"]
    raw = normalized(spark, d).where("region_id = 7").select(*align.KEY, F.col("qty_anomaly_normalized").alias("raw"))
    drawn = banded(spark, d).where("region_id = 7 and variable = 'qty' and kept").select(*align.KEY, *names)
    return rounded(raw.join(drawn, align.KEY).select("year", "month", "raw", *names), "raw", *names).orderBy("year", "month")


@query("plot_raw_vs_anomaly", f"WITH {NORM} SELECT year, month, {r('total')} AS total, {r('total_anomaly', 5)} AS total_anomaly FROM n WHERE region_id = 4 ORDER BY year, month")
def plot_raw_vs_anomaly(spark, d):
    rows = explore.one_region(normalized(spark, d), 4, ["year", "month", "total", "total_anomaly"], "time_b").drop("time_b")
    return rounded(rounded(rows, "total"), "total_anomaly", digits=5)


#: Position, name, type, nullable, metadata of the columns that the merged and normalised table must have.
FEATURES = [("region_id", "bigint"), ("year", "int"), ("month", "int"), *[(v + x, "double") for x in ("", "_climatology", "_anomaly", "_anomaly_std", "_anomaly_normalized") for v in VARIABLES]]


@query("feature_catalog", f"""SELECT * FROM (VALUES {", ".join(f"({i}, '{c}', '{kind}', true, '{{}}')" for i, (c, kind) in enumerate(FEATURES))}) AS t(position, name, type, nullable, metadata)""")
def feature_catalog(spark, d):
    rows = normalized(spark, d)
    features = C.feature_columns(rows, {"region_id", "year", "month"})
    return explore.catalogue(rows.select(*align.KEY, *features))
