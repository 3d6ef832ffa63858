"""Running sums, quantiles, mergeable states and clustered files."""

import datetime
import glob

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from terraspan.operators import moments, normalize, ranges
from terraspan.sources import files


def test_running_sums(spark):
    rng = np.random.default_rng(0)
    rows = [(int(g), float(v), k) for k, (g, v) in enumerate(zip(rng.integers(0, 3, 500), rng.normal(size=500), strict=True))]
    got = ranges.running_sums(spark.createDataFrame(rows, "g int, v double, k int").repartition(7), ["g", "v", "k"], {"n": F.lit(1), "s": F.col("k")}).collect()
    total = 0
    for i, r in enumerate(sorted(got, key=lambda r: (r.g, r.v, r.k)), 1):
        total += r.k
        assert (r.n, r.s) == (i, total)
    assert ranges.running_sums(spark.createDataFrame([], "k int"), ["k"], {"n": F.lit(1)}).count() == 0


def test_quantiles(spark):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=301), "b": np.array([5.0]), "c": np.repeat([1.0, 2.0, 9.0], [700, 1, 40]), None: rng.integers(0, 4, 50).astype(float), "e": None}
    rows = [(g, float(x)) for g, xs in groups.items() if xs is not None for x in xs] + [("e", None), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    ps = {"least": 0.0, "q1": 0.25, "q2": 0.5, "q9": 0.98, "most": 1.0}
    got = {r.g: tuple(r)[1:] for r in ranges.quantiles(df, "v", ps, ["g"]).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g, xs in got.items():
        assert xs == pytest.approx(np.quantile(groups[g], list(ps.values())))
    whole = [x for _, x in rows if x is not None]
    assert tuple(ranges.quantiles(df, "v", ps).first()) == pytest.approx(np.quantile(whole, list(ps.values())))
    assert [r.m for r in ranges.quantiles(df.where("v is null"), "v", {"m": 0.5}).collect()] in ([], [None])
    summary = ranges.with_quantiles(df.groupBy("g").count(), df, "v", {"m": 0.5}, ["g"])
    assert {r.g: r.m for r in summary.collect()}["e"] is None and summary.count() == 5


def test_states(spark, tmp_path):
    """Batches, one of them twice and one compacted, equal all rows at once; far values lose no digits."""
    rng = np.random.default_rng(2)
    rows = [(g, y, m, None if rng.random() < 0.1 else float(1e6 + rng.normal()), 5.0 if g == 1 else float(y)) for g in range(4) for y in range(2000, 2009) for m in range(1, 13)]
    df = spark.createDataFrame(rows, "region_id long, year int, month int, x double, y double")
    path, later = f"{tmp_path}/a", f"{tmp_path}/b"
    for batch, test in (("1", "year < 2003"), ("2", "year = 2003"), ("2", "year = 2003")):
        moments.add_batch(spark, path, df.where(test), ["x", "y"], batch)
    moments.compact(spark, path, later)
    for year in range(2004, 2009):
        moments.add_batch(spark, later, df.where(f"year = {year}"), ["x", "y"], str(year))
    got = moments.normalized(df, moments.load(spark, later), ["x", "y"])
    want = normalize.with_normalized(normalize.with_anomalies(df, ["x", "y"]), ["x", "y"])
    columns = [f"{v}_{c}" for v in "xy" for c in ("climatology", "anomaly", "anomaly_std", "anomaly_normalized")]
    key = lambda df: {(r.region_id, r.year, r.month): [r[c] for c in columns] for r in df.collect()}
    a, b = key(got), key(want)
    assert a.keys() == b.keys()
    for k in a:
        assert all((p is None) == (q is None) and (p is None or abs(p - q) <= 1e-12 * max(1, abs(q)) + 1e-9 * ("x" in c and abs(q) < 9)) for p, q, c in zip(a[k], b[k], columns, strict=True)), k
    part = moments.states(df.where("year < 2004 and region_id > 0"), ["x"])
    assert moments.normalized(df, part, ["x"]).where("region_id = 0 and x_climatology is null").count() == 108
    assert moments.load(spark, later).schema.simpleString() == moments.merged(part).schema.simpleString()


def test_clustered(spark, tmp_path):
    """Rows stay; a slice of any coordinate, and a box, read fewer rows than from files in order of time."""
    start = datetime.datetime(2000, 1, 1)
    df = spark.range(64 * 32 * 64).select(
        F.timestamp_add("DAY", (F.col("id") / 2048).cast("int"), F.lit(str(start)).cast("timestamp_ntz")).alias("time"),
        ((F.col("id") / 64).cast("int") % 32 * 5.0 - 80).alias("lat"), (F.col("id") % 64 * 5.0 - 160).alias("lon"), F.rand(1).alias("v"),
    )
    files.write_clustered(df, f"{tmp_path}/curve", row_group=1 << 16, partitions=64)
    df.repartitionByRange(64, "time").sortWithinPartitions("time", "lat", "lon").write.option("parquet.block.size", 1 << 16).parquet(f"{tmp_path}/time")
    curve = spark.read.parquet(f"{tmp_path}/curve")
    assert curve.columns == df.columns and curve.agg(F.count("*"), F.sum("v")).first() == pytest.approx(tuple(df.agg(F.count("*"), F.sum("v")).first()))

    def rows_read(name, **box):
        total = 0
        for f in glob.glob(f"{tmp_path}/{name}/*.parquet"):
            m = pq.ParquetFile(f).metadata
            for g in range(m.num_row_groups):
                stats = {m.row_group(g).column(c).path_in_schema: m.row_group(g).column(c).statistics for c in range(3)}
                total += m.row_group(g).num_rows * all(stats[c].min <= hi and stats[c].max >= lo for c, (lo, hi) in box.items())
        return total

    day = lambda k: start + datetime.timedelta(days=k)
    n = 64 * 32 * 64
    assert rows_read("curve", lat=(0, 10)) <= 0.4 * n and rows_read("time", lat=(0, 10)) > 0.99 * n
    assert rows_read("curve", time=(day(9), day(9))) <= 0.6 * n
    box = {"lat": (0, 30), "lon": (10, 60), "time": (day(10), day(20))}
    assert rows_read("curve", **box) <= rows_read("time", **box) / 1.5
    files.write_clustered(df.limit(0), f"{tmp_path}/none")
    assert spark.read.parquet(f"{tmp_path}/none").count() == 0
    with pytest.raises(ValueError, match="three"):
        files.write_clustered(df, f"{tmp_path}/x", by=("time", "lat", "lon", "v"))
