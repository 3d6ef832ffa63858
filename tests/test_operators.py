"""Edge cases of the series operators on small literal tables."""

import math
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraspan.functions import columns as C
from terraspan.functions import scalar as S
from terraspan.operators import align, explore, multiscale, normalize, spatial, windows
from terraspan.plans import regional
from terraspan.sources import files, geopackage


def values(df, c):
    return [r[c] for r in df.collect()]


def test_longitude(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 180.0, 190.0, 359.5, -180.0, -190.0)], "x double")
    assert values(df.select(S.normal_longitude(F.col("x")).alias("x")), "x") == [0, -180, -170, -0.5, -180, 170]


def test_days(spark):
    t = spark.createDataFrame([(107.5,), (None,)], "x double").select(S.days_since(F.col("x")).alias("t"))
    assert [str(x) for x in values(t, "t")] == ["2002-04-18 12:00:00", "None"]


def test_nan_becomes_null(spark):
    df = S.no_nan(spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "a float, b int"))
    assert values(df, "a") == [None, 2.0] and dict(df.dtypes) == {"a": "double", "b": "int"}


def test_weighted_mean(spark):
    rows = [(1, 1, 0.0, None), (1, 1, 60.0, 4.0), (2, 1, 0.0, None), (3, 1, 0.0, 1.0), (3, 1, 60.0, 4.0), (None, 1, 0.0, 9.0)]
    grid = spark.createDataFrame(rows, "region_id long, time int, lat double, v double")
    means = spatial.weighted_means(grid, ["v"])
    found = {r.region_id: r.v for r in means.collect()}
    assert found[1] == pytest.approx(4) and found[2] is None and found[3] == pytest.approx(2) and len(found) == 3
    regions = spark.createDataFrame([(1,), (2,), (3,), (7,)], "region_id long")
    assert {r.region_id: r.v for r in spatial.dense(means, regions).collect()}[7] is None


def test_empty_tables(spark):
    grid = spark.createDataFrame([], "region_id long, time int, lat double, v double")
    assert spatial.weighted_means(grid, ["v"]).count() == 0
    rows = spark.createDataFrame([], "region_id long, year int, month int, split string, v double")
    assert windows.windows(rows, ["v"]).columns[0] == "sample_id" and windows.windows(rows, ["v"]).count() == 0
    long = spark.createDataFrame([], "region_id long, variable string, time int, value double")
    assert multiscale.diagnostics(multiscale.bands(long, ["time"])).count() == 0


def test_constant_series_has_no_normalised_anomaly(spark):
    rows = spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.0), (2, 1, 1.0)], "region_id long, month int, v double")
    found = normalize.with_normalized(normalize.with_anomalies(rows, ["v"]), ["v"])
    assert values(found, "v_anomaly_normalized") == [None] * 3


def test_interpolation_and_padding(spark):
    xs = [None, None, 1.0, None, None, 4.0, 5.0, None, 7.0, None]
    df = spark.createDataFrame([(k, i, x) for k, own in ((1, xs), (2, [None] * 3), (3, [2.0])) for i, x in enumerate(own)], "k int, t int, value double")
    got = multiscale.interpolated(df.repartition(3), ["k"], ["t"]).orderBy("k", "place").collect()
    assert [r.filled for r in got] == [1, 1, 1, 2, 3, 4, 5, 6, 7, 7, None, None, None, 2] and [r.place for r in got[:10]] == list(range(10))
    for n, level, pad in ((24, 5, 8), (31, 5, 1), (32, 5, 0), (33, 5, 31), (96, 5, 0), (97, 5, 31), (9, 5, 23), (2, 3, 6)):
        q = spark.range(n).select(F.col("id").cast("int").alias("place"), F.lit(n).cast("long").alias("n")).withColumn("q", F.explode(multiscale.mirrored(level)))
        got = {r.q: r.place for r in q.collect()}
        assert [got[i] for i in range(n + pad)] == np.pad(np.arange(n), (0, pad), mode="reflect").tolist() and len(got) == n + pad


#: Daubechies filter of eight taps.
DB4 = [-0.010597401785069032, 0.0328830116668852, 0.030841381835560764, -0.18703481171909309, -0.027983769416859854, 0.6308807679298589, 0.7148465705529157, 0.2303778133088965]


def stationary_bands(x, level=5, taps=DB4):
    """Details and approximation by filtering in both directions, in the frequency domain."""
    n = len(x)
    spectrum, out = np.fft.fft(x), []
    gain = lambda s: abs(sum(h * np.exp(-2j * np.pi * np.arange(n) * k * s / n) for k, h in enumerate(taps))) ** 2 / 2
    now = spectrum
    for j in range(level):
        low = now * gain(1 << j)
        out.append(np.fft.ifft(now - low).real)
        now = low
    return out, np.fft.ifft(now).real


def walk(spark, n, seed=1):
    x = np.random.default_rng(seed).normal(size=n).cumsum()
    return x, spark.createDataFrame([(1, "v", i, float(v)) for i, v in enumerate(x)], "region_id long, variable string, time int, value double").repartition(3)


def test_bands_match_a_transform(spark):
    x, df = walk(spark, 96)
    rows = multiscale.bands(df, ["time"]).orderBy("time").collect()
    details, rest = stationary_bands(x)
    for name, want in (("short", details[0] + details[1]), ("seasonal", details[2]), ("long", details[3] + details[4] + rest)):
        assert np.abs(np.array([r[name] for r in rows]) - want).max() < 1e-9
    assert np.abs(np.array([r["reconstructed"] for r in rows]) - x).max() < 1e-9


def test_filters():
    """Orthonormal, flat, and the autocorrelation is the half-band filter; the order of eight taps is the known one."""
    assert np.abs(np.array(multiscale.analysis(4)[0]) * math.sqrt(2) - DB4).max() < 1e-12
    for order in range(1, 13):
        low, high = map(np.array, multiscale.analysis(order))
        auto = np.correlate(low, low, "full")[2 * order - 1 :]
        centre, sides = multiscale.half_band(order)
        assert abs(auto[0] - centre) < 1e-9 and max(abs(auto[k] - w) for k, w in sides) < 1e-7 and np.abs(auto[2::2]).max(initial=0) < 1e-7
        assert abs(low @ high) < 1e-9 and max(abs(np.dot(high, np.arange(2.0 * order) ** m)) for m in range(min(order, 4))) < 1e-4


@pytest.mark.parametrize("n, order, level, block", [(96, 2, 3, 32), (1000, 2, 3, 32), (257, 4, 2, 64), (500, 3, 4, 500), (130, 1, 5, 40)])
def test_any_order_in_blocks(spark, n, order, level, block):
    """Bands of blocks equal those of the whole series; the largest row holds a block and what it reaches."""
    groups = tuple((f"p{j}", (f"D{j}",)) for j in range(1, level + 1)) + (("rest", (f"A{level}",)), ("odd", ("D1", f"A{level}")))
    spec = multiscale.BandSpec(level=level, order=order, groups=groups, block=block)
    x, df = walk(spark, n)
    padded = np.pad(x, (0, -n % (1 << level)), mode="reflect")
    details, rest = stationary_bands(padded, level, np.array(multiscale.analysis(order)[0]) * math.sqrt(2))
    rows = multiscale.bands(df, ["time"], spec).orderBy("time").collect()
    assert [r.time for r in rows] == list(range(n))
    for name, want in (*((f"p{j + 1}", d) for j, d in enumerate(details)), ("rest", rest), ("odd", details[0] + rest)):
        assert np.abs(np.array([r[name] for r in rows]) - want[:n]).max() < 1e-9
    largest = multiscale.blocks(multiscale.padded(df, ["region_id", "variable"], ["time"], spec), ["region_id"], spec, ["filled"]).agg(F.max(F.size("s"))).first()[0]
    assert largest <= block + 2 * spec.reach
    coeffs = multiscale.coefficients(df, ["time"], spec).cache()
    assert coeffs.count() == len(padded) and coeffs.where("time is null").count() == len(padded) - n
    assert math.isclose(sum(coeffs.agg(*[F.sum(F.col(c) ** 2) for c in coeffs.columns if c[0] in "da" and c[1:].isdigit()]).first()), (padded**2).sum(), rel_tol=1e-9)
    whole = [f"D{j}" for j in range(1, level + 1)] + [f"A{level}"]
    for keep, want in ((whole, padded), (["D1"], details[0]), ([f"A{level}"], rest), ([f"d{level}"], details[-1])):
        got = [r.rebuilt for r in multiscale.inverse(coeffs, keep, spec).orderBy("place").collect()]
        assert np.abs(np.array(got) - want).max() < 1e-8


def test_band_settings():
    settings = {"wavelet_transform": {"wavelet_family": "db2", "levels": 3}, "scale_grouping": {"fast": "D1 + D2", "slow": "D3+A3"}}
    spec = multiscale.BandSpec.of(settings)
    assert (spec.order, spec.level, spec.groups) == (2, 3, (("fast", ("D1", "D2")), ("slow", ("D3", "A3"))))
    assert multiscale.BandSpec.of({}).groups == multiscale.BandSpec().groups
    for bad in ({"wavelet_transform": {"wavelet_family": "sym4"}}, {"wavelet_transform": {"padding_method": "zero"}}, {"scale_grouping": {"x": "D6"}}):
        with pytest.raises(ValueError):
            multiscale.BandSpec.of(bad)


def test_band_guards(spark):
    rows = [(1, "v", i, float(i % 7)) for i in range(15)] + [(2, "v", i, float(i) if i < 23 else None) for i in range(30)] + [(3, "v", i, float(i)) for i in range(24)]
    df = spark.createDataFrame(rows, "region_id long, variable string, time int, value double")
    found = multiscale.bands(df, ["time"])
    assert {(r.region_id, r.kept) for r in found.select("region_id", "kept").distinct().collect()} == {(2, False), (3, True)}
    diag = {r.region_id: r for r in multiscale.diagnostics(found).collect()}
    assert diag[2].n_obs is None and diag[2].rmse is None and diag[3].n_obs == 24 and diag[3].rmse < 1e-9


def months(n, first=0, region=1):
    return [(region, 2000 + (first + k) // 12, (first + k) % 12 + 1, "train", 1.0) for k in range(n)]


@pytest.mark.parametrize(
    "rows, n",
    [
        (months(23), 0), (months(24), 1), (months(25), 2),
        (months(12) + months(24, first=13), 1), (months(30) + months(1, first=20), 0),
        (months(10) + [(1, 2000, 11, "train", None)] + months(24, first=11), 1),
    ],
)
def test_windows(spark, rows, n):
    df = spark.createDataFrame(rows, "region_id long, year int, month int, split string, v double")
    found = windows.windows(df, ["v"])
    assert found.count() == n and sorted(values(found, "sample_id")) == list(range(n))


def test_windows_against_scan(spark):
    rng = np.random.default_rng(2)
    rows = [r for g in range(5) for r in months(80, region=g) if rng.random() > 0.02]
    rows = [(a, b, c, d, None if rng.random() < 0.01 else v) for a, b, c, d, v in rows]
    want = set()
    for g in range(5):
        own = [r for r in rows if r[0] == g]
        for k in range(len(own) - 5):
            w = own[k : k + 6]
            mi = [r[1] * 12 + r[2] for r in w]
            if np.all(np.diff(mi) == 1) and all(r[4] is not None for r in w):
                want.add((g, w[0][1], w[0][2]))
    df = spark.createDataFrame(rows, "region_id long, year int, month int, split string, v double")
    found = windows.windows(df, ["v"], windows.WindowSpec(length=6))
    assert {(r.region_id, r.start_year, r.start_month) for r in found.collect()} == want


def test_splits(spark):
    df = spark.createDataFrame([(2016,), (2017,), (2020,), (2021,), (None,)], "year int")
    assert values(windows.with_split(df), "split") == ["train", "val", "val", "test", "unknown"]


def test_keep_first_and_multiplicity(spark):
    df = spark.createDataFrame([(1, 2000, 1, 2), (1, 2000, 1, 1), (1, 2000, 2, 3)], "region_id long, year int, month int, t int")
    assert sorted(values(align.keep_first(df, ["t"]), "t")) == [1, 3]
    assert sorted((r.n_rows, r.n_keys) for r in align.multiplicity_histogram(df).collect()) == [(1, 1), (2, 1)]


def test_merge_suffixes_clashing_names(spark):
    a = spark.createDataFrame([(1, 2000, 1, 1.0)], "region_id long, year int, month int, v double")
    assert align.merge(a, a).columns == ["region_id", "year", "month", "v_a", "v_b"]


@pytest.mark.parametrize("xs, want", [([1.0, 2.0, 3.0], (1.0, 3.0, "sequential")), ([-1.0, 4.0], (-4.0, 4.0, "diverging")), ([None], None)])
def test_colour_scale(spark, xs, want):
    got = explore.colour_scale(spark.createDataFrame([(x,) for x in xs], "v double"), "v", robust=False).collect()
    assert (tuple(got[0]) if got else None) == want


def test_statistics_of_a_field_without_values(spark):
    r = explore.field_statistics(spark.createDataFrame([(None,), (None,)], "v double"), ["v"]).first()
    assert (r.total, r.valid, r.missing, r.missing_percent, r["mean"]) == (2, 0, 2, 100.0, None)


def test_column_choices(spark):
    df = spark.createDataFrame([], "valid_time int, time int, longitude double, lon double, lat double, b boolean, s string")
    assert C.canonical_grid(df.drop("time", "lon")).columns == ["time", "lon", "lat", "b", "s"]
    assert C.feature_columns(df, {"time"}) == ["valid_time", "longitude", "lon", "lat", "b"]
    with pytest.raises(C.MissingColumn):
        C.subset(df, [], ["x"])
    with pytest.raises(C.MissingColumn):
        C.with_suffix(df, "_short")


def test_read_and_write(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 190.0, 10.0, float("nan"), 2.0)], "time double, longitude double, latitude double, v double, w double")
    files.write_table(df, str(tmp_path / "grid"))
    got = files.read_grid(spark, str(tmp_path / "grid"), ["v", "w", "z"], day_origin="2002-01-01").first()
    assert str(got.time) == "2002-01-02 00:00:00" and got.lon == -170 and got.v is None and got.w == 2
    files.write_table(files.with_metadata(df, {"w": {"long_name": "wind"}}), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).schema["w"].metadata == {"long_name": "wind"}
    files.write_settings(spark, {"window": windows.WindowSpec()}, str(tmp_path / "s"))
    assert "24" in spark.read.text(str(tmp_path / "s")).first()[0]


def polygon(rings, end="<"):
    body = struct.pack(end + "BII", end == "<", 3, len(rings))
    for ring in rings:
        body += struct.pack(end + "I", len(ring)) + b"".join(struct.pack(end + "2d", *p) for p in ring)
    return body


def test_geopackage(spark, tmp_path):
    box = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    hole = [(4, 4), (6, 4), (6, 6), (4, 6), (4, 4)]
    far = [(20, 0), (30, 0), (30, 10), (20, 10), (20, 0)]
    several = struct.pack("<BII", 1, 6, 2) + polygon([box, hole]) + polygon([far])
    header = b"GP\x00\x01" + struct.pack("<i", 4326)
    path = tmp_path / "r.gpkg"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE basins (fid INTEGER PRIMARY KEY, code INTEGER, geom BLOB)")
        db.execute("INSERT INTO basins VALUES (1, 4000000001, ?), (2, 7, NULL), (3, 8, ?)", (header + several, header + polygon([far], ">")))
    spark.dataSource.register(geopackage.GeoPackage)
    load = lambda **o: spark.read.format("regions_gpkg").options(path=str(path), table="basins", **o).load()
    regions = load(id_column="code", rows_per_partition="2")
    assert sorted(values(regions, "region_id")) == [8, 4000000001]
    cells = spark.createDataFrame([(1.0, 1.0), (5.0, 5.0), (25.0, 5.0), (15.0, 5.0)], "lon double, lat double")
    found = {(r.lon, r.lat): r.region_id for r in spatial.cells_in_regions(cells, geopackage.polygon_sides(regions)).collect()}
    assert found == {(1.0, 1.0): 4000000001, (25.0, 5.0): 8}
    with sqlite3.connect(path) as db:
        db.execute("ALTER TABLE basins ADD COLUMN name TEXT")
        db.execute("UPDATE basins SET name = 'far one' WHERE code = 8")
    assert {(r.region_id, r.name) for r in load(id_column="code", attributes="name").select("region_id", "name").collect()} == {(8, "far one"), (4000000001, None)}
    assert load(id_column="code", attributes="*").columns == ["region_id", "wkb", "fid", "name"]
    with pytest.raises(Exception, match="no column"):
        load(id_column="nothing").count()
    with pytest.raises(ValueError, match="2154"):
        geopackage.wkb_of(b"GP\x00\x01" + struct.pack("<i", 2154) + polygon([box]))


def test_slices(spark):
    rows = [("2000-01-05", 1), ("2000-01-20", 2), ("2000-02-05", 3)]
    df = spark.createDataFrame(rows, "t string, v int").select(F.col("t").cast("timestamp_ntz").alias("time"), "v")
    assert values(explore.at_month(df, 2000, 1), "v") == [1] and explore.at_month(df, 1999, 1).count() == 0
    assert values(explore.at_step(df, 2), "v") == [3]
    assert [(r.year, r.month) for r in explore.year_months(df).collect()] == [(2000, 1), (2000, 2)]
    assert math.isclose(spark.range(1).select(S.latitude_weight(F.lit(60.0))).first()[0], 0.5)


def test_small_choices_of_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, "x"), (2, 3.0, "x")], "number int, v double, expver string")
    assert C.without(df).columns == ["v"] and C.without(C.without(df)).columns == ["v"]
    assert C.unique(["b", "a", "b"]) == ["b", "a"]
    assert C.require(df, {"v"}) is df
    with pytest.raises(C.MissingColumn, match="w"):
        C.require(df, {"v", "w"})
    times = spark.createDataFrame([(1, 2)], "time_a int, time_b int")
    assert (C.time_column(times, "a"), C.time_column(times, "b"), C.time_column(times.drop("time_b"), "b"), C.time_column(df, "a")) == ("time_a", "time_b", "time_a", None)
    lon = lambda *x: spark.createDataFrame([(float(v),) for v in x], "lon double")
    assert S.one_longitude_range(lon(-170, 170)).count() == 2 and S.one_longitude_range(lon(0, 359)).count() == 2 and S.one_longitude_range(lon().limit(0)).count() == 0
    with pytest.raises(ValueError, match="lon"):
        S.one_longitude_range(lon(-10, 190))
    files.write_report(df.select("v"), str(tmp_path / "report"))
    assert sorted(values(spark.read.csv(str(tmp_path / "report"), header=True, inferSchema=True), "v")) == [2.0, 3.0]


@pytest.mark.parametrize("dedupe", ["late", "early"])
def test_repeated_months_keep_the_earliest_observation_and_its_bands(spark, dedupe):
    """Two observations in one month of source B, the later one with the smaller value, and one in source A."""
    import datetime

    rows = []
    for i in range(40):
        year, month = 2000 + i // 12, i % 12 + 1
        day = lambda d, year=year, month=month: datetime.datetime(year, month, d)
        rows.append((1, year, month, day(1), day(1), math.sin(i), math.cos(i)))
        if i == 7:
            rows.append((1, year, month, day(1), day(20), math.sin(i), -9.0))
    schema = "region_id long, year int, month int, time_a timestamp_ntz, time_b timestamp_ntz, x_anomaly_normalized double, y_anomaly_normalized double"
    df = spark.createDataFrame(rows, schema).repartition(3)
    table, _ = regional.multiscale_table(df, ["x", "y"], from_b=("y",), dedupe=dedupe)
    got = table.orderBy("year", "month").collect()
    assert len(got) == 40
    for r in got:
        assert r.x_short + r.x_seasonal + r.x_long == pytest.approx(r.x_anomaly_normalized) and r.y_short + r.y_seasonal + r.y_long == pytest.approx(r.y_anomaly_normalized)
    assert got[7].y_anomaly_normalized == math.cos(7) and got[7].time_b.day == 1
    with pytest.raises(ValueError, match="dedupe"):
        regional.multiscale_table(df, ["x"], dedupe="never")
