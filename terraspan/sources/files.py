"""Reading and writing."""

from __future__ import annotations

import json
from dataclasses import asdict, is_dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraspan.functions.columns import canonical_grid, subset
from terraspan.functions.scalar import days_since, no_nan, normal_longitude
from terraspan.sources.netcdf import read_netcdf


def read_grid(spark: SparkSession, path: str, variables: list[str], short_first: bool = False, day_origin: str | None = None) -> DataFrame:
    """A grid, a row for each cell and time: time, lat, lon and those of ``variables`` that exist. path: Parquet, or NetCDF
    classic files if it ends in .nc.

    NaN becomes NULL, longitude goes to [-180, 180), and a time in days since ``day_origin`` is decoded."""
    if path.endswith(".nc"):
        source = read_netcdf(spark, path, variables, decode_times=day_origin is None)
    else:
        source = spark.read.parquet(path)
    grid = canonical_grid(no_nan(source), short_first)
    grid, _ = subset(grid, ["time", "lat", "lon"], variables)
    if day_origin is not None:
        grid = grid.withColumn("time", days_since(F.col("time"), day_origin))
    return grid.withColumn("lon", normal_longitude(F.col("lon")))


def with_metadata(df: DataFrame, metadata: dict[str, dict]) -> DataFrame:
    """Attach long names, sources and the like to columns; Parquet keeps them."""
    return df.select(*[F.col(c).alias(c, metadata=metadata[c]) if c in metadata else F.col(c) for c in df.columns])


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(path)


#: Bits of each coordinate in a place on the curve.
BITS = 16


def curve_place(*shares: Column) -> Column:
    """Place on a curve that winds through a box of coordinates, from each one's share (0 to 1) of its range: their bits are
    taken in turn, so that neighbours on the curve are neighbours in all of them."""
    cells = [F.floor(F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)) * ((1 << BITS) - 1)) for s in shares]
    place = F.lit(0).cast("long")
    for b in range(BITS):
        for k, c in enumerate(cells):
            bit = F.shiftright(c, b).bitwiseAND(F.lit(1).cast("long"))
            place = place.bitwiseOR(F.shiftleft(bit, b * len(cells) + k))
    return place


def write_clustered(df: DataFrame, path: str, by: tuple[str, ...] = ("time", "lat", "lon"), row_group: int = 8 << 20, partitions: int | None = None) -> None:
    """Write a grid as Parquet in the order of a curve over ``by`` (up to three columns). Files and row groups then hold small
    boxes, and their statistics let a slice or a box of any of the columns skip the others. row_group: bytes of one."""
    if not 1 <= len(by) * BITS < 64:
        raise ValueError("at most three columns")
    number = lambda c: F.unix_micros(F.col(c).cast("timestamp")).cast("double") if dict(df.dtypes)[c].startswith(("timestamp", "date")) else F.col(c).cast("double")
    ends = df.agg(*[f(number(c)).alias(f"{c}_{n}") for c in by for n, f in (("a", F.min), ("b", F.max))]).first()
    shares = [F.coalesce((number(c) - F.lit(ends[f"{c}_a"])) / F.lit((ends[f"{c}_b"] - ends[f"{c}_a"]) or 1.0), F.lit(0.0)) if ends[f"{c}_a"] is not None else F.lit(0.0) for c in by]
    placed = df.withColumn("_place", curve_place(*shares))
    dealt = placed.repartitionByRange(partitions, "_place") if partitions else placed.repartitionByRange("_place")
    out = dealt.sortWithinPartitions("_place").drop("_place")
    out.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", row_group).option("parquet.page.row.count.limit", 4096).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_settings(spark: SparkSession, settings: dict, path: str) -> None:
    """Settings as one JSON line, keys in their order, through Spark's writer so that any store will do."""
    plain = {k: asdict(v) if is_dataclass(v) else v for k, v in settings.items()}
    spark.createDataFrame([(json.dumps(plain),)], "value string").coalesce(1).write.mode("overwrite").text(path)
