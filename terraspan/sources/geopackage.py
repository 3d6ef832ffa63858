"""Polygons of a GeoPackage (SQLite with WKB) as a Spark data source: ``spark.read.format("regions_gpkg")``.

Options: path (a file every executor can open), table, id_column, geometry_column (default geom), and attributes: names
of further columns, separated by commas, or * for all; they come as strings. Reference systems that
``functions.projection`` undoes are accepted: a geometry of another one than EPSG:4326 carries its code, and
``polygon_sides`` gives degrees. The source lists feature ids in ranges, one for each partition.
"""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terraspan.functions.projection import DEGREES, reprojected_sides, supported

SCHEMA = "region_id long, wkb binary"
SIDES = "struct<srid:int,sides:array<struct<x1:double,y1:double,x2:double,y2:double>>>"
#: Marks a WKB type that is followed by the code of its reference system.
CODED = 0x20000000
#: Doubles in the envelope of a GeoPackage geometry header, by its code.
ENVELOPE = {0: 0, 1: 4, 2: 6, 3: 6, 4: 8}


class Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class GeoPackageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table, self.id_column = options["path"], options["table"], options["id_column"]
        self.geometry = options.get("geometry_column", "geom")
        self.size = int(options.get("rows_per_partition", 10_000))
        self.attributes = attributes_of(options)

    def open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[Rows]:
        with self.open() as db:
            names = [r[1] for r in db.execute(f'PRAGMA table_info("{self.table}")')]
            if self.id_column not in names:
                raise ValueError(f"no column {self.id_column} among {names}")
            first, last = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        return [] if first is None else [Rows(a, min(a + self.size - 1, last)) for a in range(first, last + 1, self.size)]

    def read(self, part: Rows) -> Iterator[tuple]:
        columns = ", ".join(f'"{c}"' for c in (self.id_column, self.geometry, *self.attributes))
        with self.open() as db:
            for region_id, blob, *rest in db.execute(f'SELECT {columns} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', (part.first, part.last)):
                if blob is not None:
                    yield int(region_id), wkb_of(blob), *[None if x is None else str(x) for x in rest]


def attributes_of(options: dict) -> list[str]:
    """Names of the attribute columns asked for."""
    wanted = [x.strip() for x in options.get("attributes", "").split(",") if x.strip()]
    if wanted != ["*"]:
        return wanted
    with sqlite3.connect(f"file:{options['path']}?mode=ro", uri=True) as db:
        names = [r[1] for r in db.execute(f'PRAGMA table_info("{options["table"]}")')]
    return [x for x in names if x not in (options["id_column"], options.get("geometry_column", "geom"))]


class GeoPackage(DataSource):
    @classmethod
    def name(cls) -> str:
        return "regions_gpkg"

    def schema(self) -> str:
        return SCHEMA + "".join(f", `{x}` string" for x in attributes_of(self.options))

    def reader(self, schema) -> GeoPackageReader:
        return GeoPackageReader(self.options)


def wkb_of(blob: bytes) -> bytes:
    """The WKB behind a GeoPackage geometry header, with the code of the reference system if that isn't degrees."""
    if blob[:2] != b"GP":
        raise ValueError("not a GeoPackage geometry")
    flags = blob[3]
    srs = struct.unpack_from("<i" if flags & 1 else ">i", blob, 4)[0]
    if not supported(srs):
        raise ValueError(f"reference system {srs} cannot be turned into degrees")
    wkb = bytes(blob[8 + 8 * ENVELOPE[(flags >> 1) & 7] :])
    if srs in DEGREES:
        return wkb
    end = "<" if wkb[0] else ">"
    return wkb[:1] + struct.pack(end + "Ii", struct.unpack_from(end + "I", wkb, 1)[0] | CODED, srs) + wkb[5:]


def sides_of(wkb: bytes) -> tuple[int, list[tuple[float, float, float, float]]]:
    """Code of the reference system, and the sides of all rings of a WKB polygon or multipolygon."""
    srid = 4326

    def geometry(at: int) -> tuple[int, list]:
        nonlocal srid
        end = "<" if wkb[at] else ">"
        kind = struct.unpack_from(end + "I", wkb, at + 1)[0]
        if kind & CODED:
            srid = struct.unpack_from(end + "i", wkb, at + 5)[0]
            at += 4
        kind &= 0xFFFF
        n = struct.unpack_from(end + "I", wkb, at + 5)[0]
        at, out = at + 9, []
        for _ in range(n):
            if kind == 6:
                at, more = geometry(at)
                out += more
            elif kind == 3:
                points = struct.unpack_from(end + "I", wkb, at)[0]
                flat = struct.unpack_from(f"{end}{2 * points}d", wkb, at + 4)
                ring = list(zip(flat[::2], flat[1::2], strict=True))
                out += [(*p, *q) for p, q in zip(ring, ring[1:], strict=False)]
                at += 4 + 16 * points
            else:
                raise ValueError(f"geometry type {kind} is no polygon")
        return at, out

    sides = geometry(0)[1]
    return srid, sides


def polygon_sides(regions: DataFrame) -> DataFrame:
    """region_id, x1, y1, x2, y2 of ``regions`` (region_id, wkb), in degrees."""
    sides = F.udf(lambda w: sides_of(bytes(w)), SIDES, useArrow=False)  # a row for each region, not for each cell
    found = regions.where("wkb is not null").select("region_id", sides("wkb").alias("s")).select("region_id", "s.srid", F.inline("s.sides"))
    return reprojected_sides(found, F.col("srid")).drop("srid")
