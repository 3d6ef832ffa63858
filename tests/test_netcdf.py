"""NetCDF files read and written."""

import datetime
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from terraspan.sources import files, netcdf as N


def name(s, count=">i"):
    return struct.pack(count, len(s)) + s.encode() + b"\0" * (-len(s) % 4)


def classic(path, version=1, steps=5, records=None):
    """A file by hand: unlimited time, packed and float variables over records, a bounds variable beside the grid."""
    count, offset = (">q" if version == 5 else ">i"), (">i" if version == 1 else ">q")
    n = lambda x: struct.pack(count, x)
    text = lambda k, v: name(k, count) + struct.pack(">i", 2) + n(len(v)) + v.encode() + b"\0" * (-len(v) % 4)
    number = lambda k, kind, fmt, v: name(k, count) + struct.pack(">i", kind) + n(1) + (raw := struct.pack(">" + fmt, v)) + b"\0" * (-len(raw) % 4)
    attrs = lambda *a: struct.pack(">i", 12 if a else 0) + n(len(a)) + b"".join(a)
    lat, lon = np.array([10.0, 0.0, -10.0]), np.array([0.0, 90.0, 180.0, 270.0])
    time = np.arange(steps) * 30.5
    packed = (np.arange(steps * 12).reshape(steps, 3, 4) - 20).astype(">i2")
    packed[1, 1, 1] = -999
    plain = np.arange(steps * 12).reshape(steps, 3, 4).astype(">f4") / 4
    plain[2, 0, 3] = np.nan
    sizes = [8, 16, 24, 48]  # of a record: time, bounds, packed, plain
    table = [
        ("lat", [1], attrs(text("units", "degrees_north")), 6, 24), ("lon", [2], attrs(), 6, 32), ("time", [0], attrs(text("units", "days since 2002-1-1")), 6, sizes[0]),
        ("time_bounds", [0, 3], attrs(), 6, sizes[1]), ("tws", [0, 1, 2], attrs(number("_FillValue", 3, "h", -999), number("scale_factor", 6, "d", 0.5), number("add_offset", 6, "d", 1.0)), 3, sizes[2]),
        ("sro", [0, 1, 2], attrs(text("long_name", "runoff")), 5, sizes[3]),
    ]
    dims = [("time", 0), ("lat", 3), ("lon", 4), ("nv", 2)]

    def head(begins):
        out = b"CDF" + bytes([version]) + n(steps if records is None else records) + struct.pack(">i", 10) + n(4) + b"".join(name(d, count) + n(k) for d, k in dims) + attrs(text("title", "made"))
        out += struct.pack(">i", 11) + n(len(table))
        for (v, ids, a, kind, size), at in zip(table, begins, strict=True):
            out += name(v, count) + n(len(ids)) + b"".join(map(n, ids)) + a + struct.pack(">i", kind) + n(size) + struct.pack(offset, at)
        return out

    at = len(head([0] * 6))
    begins = [at, at + 24, at + 56, at + 64, at + 80, at + 104]
    with open(path, "wb") as f:
        f.write(head(begins) + lat.astype(">f8").tobytes() + lon.astype(">f8").tobytes())
        for k in range(steps):
            f.write(time[k : k + 1].astype(">f8").tobytes() + np.array([k, k + 1], ">f8").tobytes() + packed[k].tobytes() + plain[k].astype(">f4").tobytes())
    return lat, lon, time, packed, plain


@pytest.mark.parametrize("version", [1, 2, 5])
def test_a_file_made_elsewhere(spark, tmp_path, version):
    path = str(tmp_path / "a.nc")
    lat, lon, time, packed, plain = classic(path, version, records=-1 if version == 2 else None)
    df = N.read_netcdf(spark, path, rows_per_partition=7)
    assert df.dtypes == [("time", "timestamp_ntz"), ("lat", "double"), ("lon", "double"), ("tws", "double"), ("sro", "double")]
    got = {(r.time, r.lat, r.lon): (r.tws, r.sro) for r in df.collect()}
    assert len(got) == 60
    for k, i, j in np.ndindex(5, 3, 4):
        t = datetime.datetime(2002, 1, 1) + datetime.timedelta(days=30.5 * k)
        tws, sro = packed[k, i, j] * 0.5 + 1, plain[k, i, j]
        assert got[t, lat[i], lon[j]] == (None if (k, i, j) == (1, 1, 1) else tws, None if np.isnan(sro) else sro)
    raw = N.read_netcdf(spark, path, ["sro", "nothing"], decode_times=False)
    assert raw.dtypes == [("time", "double"), ("lat", "double"), ("lon", "double"), ("sro", "double")]
    assert raw.where("time >= 61 and time < 92 and lat = 0").count() == 8 and raw.groupBy().count().first()[0] == 60
    with pytest.raises(ValueError, match="none of"):
        N.read_netcdf(spark, path, ["nothing"])
    grid = files.read_grid(spark, path, ["sro"])
    assert sorted(r[0] for r in grid.select("lon").distinct().collect()) == [-180, -90, 0, 90]


def test_boxes_and_predicates(spark, tmp_path):
    path = str(tmp_path / "a.nc")
    classic(path)
    day = datetime.datetime(2002, 2, 20)
    test = (F.col("time") >= F.lit(str(day)).cast("timestamp_ntz")) & F.col("lat").isin(0.0, -10.0) & (F.col("lon") > 100)
    pushed = N.read_netcdf(spark, path, pushdown=True, rows_per_partition=4).where(test)
    assert pushed.count() == 12 and pushed.rdd.getNumPartitions() == 3
    assert N.read_netcdf(spark, path, pushdown=True).where("lat = 77").count() == 0
    boxed = N.read_netcdf(spark, path, ["sro"], box={"time": (day, None), "lat": (-10, 0), "lon": (100.5, 270)}, rows_per_partition=4)
    assert boxed.count() == 12 and boxed.rdd.getNumPartitions() == 3 and N.read_netcdf(spark, path, box={"lat": (50, 60)}).count() == 0
    plain = N.read_netcdf(spark, path)
    assert plain.where("lat = 0").join(plain.where("lat = 10"), ["time", "lon"]).count() == 20 and plain.count() == 60
    with pytest.raises(ValueError, match="no coordinates"):
        N.read_netcdf(spark, path, box={"sro": (0, 1)})


class Counted:
    def __init__(self, f):
        self.f, self.n = f, 0

    def seek(self, at):
        self.f.seek(at)

    def read(self, n):
        self.n += n
        return self.f.read(n)


def test_bytes_read(tmp_path, monkeypatch):
    """Only the slabs, rows and columns that are asked for."""
    monkeypatch.setattr(N, "GAP", 0)
    path = str(tmp_path / "a.nc")
    classic(path)

    def read(columns, *filters):
        r = N.PushedReader({"path": path, "decode_times": "false"}, columns)
        assert list(r.pushFilters(list(filters))) == list(filters)
        rows = total = 0
        for p in r.partitions():
            with open(path, "rb") as f:
                counted = Counted(f)
                rows += sum(b.num_rows for b in r.batches(counted, N.file_header(path), p.ranges))
                total += counted.n - 8 * (5 + 3 + 4)  # the coordinates
        return rows, total

    assert read(["time", "sro"]) == (60, 240)
    assert read(["time", "sro", "tws"]) == (60, 360)
    assert read(["time", "sro"], GreaterThanOrEqual(("time",), 61.0), LessThan(("time",), 100.0)) == (24, 96)
    assert read(["sro"], EqualTo(("lat",), 0.0)) == (20, 80)
    assert read(["sro"], EqualTo(("lat",), 0.0), In(("lon",), (90.0, 180.0))) == (10, 40)
    assert read(["sro"], EqualTo(("lat",), 5.0)) == (0, 0)
    assert read([], EqualTo(("sro",), 5.0)) == (60, 0)
    monkeypatch.setattr(N, "GAP", 1 << 14)
    assert read(["sro"], EqualTo(("lat",), 0.0)) == (20, 240)


@pytest.mark.parametrize("version, slab_cells", [(5, 7), (2, 1 << 20), (1, 13)])
def test_round_trip(spark, tmp_path, version, slab_cells):
    rng = np.random.default_rng(version)
    rows = [(datetime.datetime(2000 + k // 12, k % 12 + 1, 1, 6, 30, 0, 250_000), float(i), float(-j) / 3, None if rng.random() < 0.2 else float(rng.normal()), int(rng.integers(99)), float(k)) for k in range(20) for i in range(4) for j in range(3) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "time timestamp_ntz, lat double, lon double, v double, n int, f float").repartition(5)
    df = files.with_metadata(df, {"v": {"long_name": "value", "units": "mm"}})
    path = str(tmp_path / "b.nc")
    N.write_netcdf(df, path, ["time", "lat", "lon"], {"source": "test"}, version=version, slab_cells=slab_cells)
    back = N.read_netcdf(spark, path)
    assert back.count() == len({r[0] for r in rows}) * 12
    got = {tuple(r)[:3]: tuple(r)[3:] for r in back.collect()}
    want = {r[:3]: r[3:] for r in rows}
    assert all(got[k] == v for k, v in want.items()) and all(v == (None, None, None) for k, v in got.items() if k not in want)
    header = N.file_header(path)
    assert header.attributes == {"source": "test"} and header.variables["v"].attributes["long_name"] == "value" and os.listdir(tmp_path) == ["b.nc"]
    with pytest.raises(FileExistsError):
        N.write_netcdf(df, path, ["time", "lat", "lon"])
    N.write_netcdf(df.where("lat = 0"), path, ["time", "lat", "lon"], overwrite=True)
    assert {r[0] for r in N.read_netcdf(spark, path).select("lat").distinct().collect()} == {0.0}


def test_failures_leave_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, 3.0), (1, 2.0, 4.0), (2, 2.0, 5.0)], "region long, t double, v double")
    path = str(tmp_path / "c.nc")
    with pytest.raises(Exception, match="several rows"):
        N.write_netcdf(df, path, ["region", "t"])
    with pytest.raises(ValueError, match="missing somewhere"):
        N.write_netcdf(df.withColumn("t", F.lit(None).cast("double")), path, ["region", "t"])
    broken = df.dropDuplicates(["region"]).withColumn("v", F.when(F.col("v") < 9, F.raise_error(F.lit("broken"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken"):
        N.write_netcdf(broken, path, ["region", "t"])
    with pytest.raises(ValueError, match="no numbers"):
        N.write_netcdf(df.withColumn("s", F.lit("x")), path, ["region", "t"])
    assert os.listdir(tmp_path) == []
    N.write_netcdf(df.limit(0), path, ["region", "t"])
    assert N.read_netcdf(spark, path).count() == 0


def test_several_files_and_bad_ones(spark, tmp_path):
    for k in range(3):
        df = spark.createDataFrame([(k, float(r), k * 10.0 + r) for r in range(4)], "step int, region double, v double")
        N.write_netcdf(df, str(tmp_path / f"{k}.nc"), ["step", "region"])
    assert N.read_netcdf(spark, str(tmp_path)).where("step >= 1").agg(F.sum("v")).first()[0] == 132
    (tmp_path / "x.nc").write_bytes(b"\x89HDF\r\n\x1a\n")
    with pytest.raises(ValueError, match="HDF5"):
        N.file_header(str(tmp_path / "x.nc"))
    (tmp_path / "y.nc").write_bytes(b"CDF\x01\0\0")
    with pytest.raises(ValueError, match="too soon"):
        N.file_header(str(tmp_path / "y.nc"))


def test_time_units():
    v = lambda units, **a: N.Variable("t", ("t",), 6, 0, {"units": units, **a})
    at = lambda units, x, kind=">f8": str(N.decoded(v(units), np.array([x], kind))[0][0])
    assert at("days since 2002-01-01", 107.5) == "2002-04-18T12:00:00.000000"
    assert at("hours since 1900-01-01 00:00:0.0", 24) == "1900-01-02T00:00:00.000000"
    assert at("seconds since 1970-01-01T06:30", 1, ">i4") == "1970-01-01T06:30:01.000000"
    assert N.decoded(v("mm"), np.array([1.0]))[0].dtype == "f8"
    with pytest.raises(ValueError, match="calendar"):
        N.decoded(v("days since 2000-01-01", calendar="noleap"), np.array([1.0]))
