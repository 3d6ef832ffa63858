"""Field statistics, slices, map joins and the data behind plots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraspan.operators.normalize import long_form
from terraspan.operators.ranges import quantiles


def field_statistics(rows: DataFrame, variables: list[str]) -> DataFrame:
    """For each variable: rows, values, missing ones and their percentage, least, largest, mean, population deviation."""
    long = long_form(rows, [], {v: v for v in variables})
    n, there = F.count("*"), F.count("value")
    return long.groupBy("variable").agg(
        n.alias("total"), there.alias("valid"), (n - there).alias("missing"), (F.lit(100.0) * (n - there) / n).alias("missing_percent"),
        F.min("value").alias("least"), F.max("value").alias("largest"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
    )


def year_months(rows: DataFrame, time: str = "time") -> DataFrame:
    return rows.select(F.year(time).alias("year"), F.month(time).alias("month")).distinct().orderBy("year", "month")


def at_month(rows: DataFrame, year: int, month: int, time: str = "time") -> DataFrame:
    """The rows of the first time step in a month; none if there is no such step. A range of times, so that the filter
    reaches the scan."""
    begin = F.make_timestamp_ntz(F.lit(year), F.lit(month), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    inside = rows.where((F.col(time) >= begin) & (F.col(time) < F.timestamp_add("MONTH", F.lit(1), begin)))
    first = inside.agg(F.min(time).alias("_first"))
    return inside.join(F.broadcast(first), F.col(time) == F.col("_first")).drop("_first")  # one row


def at_step(rows: DataFrame, index: int, time: str = "time") -> DataFrame:
    """The rows of the time step of that number, from 0."""
    step = rows.select(time).distinct().orderBy(time).offset(index).limit(1)
    return rows.join(F.broadcast(step), time)  # one row


def on_map(regions: DataFrame, values: DataFrame, key: str = "region_id") -> DataFrame:
    """All regions, with the values of those that have some; ids are compared as strings."""
    as_text = lambda df: df.withColumn(key, F.col(key).cast("string"))
    return as_text(regions).join(as_text(values), key, "left")


def match_counts(mapped: DataFrame, value: str) -> DataFrame:
    return mapped.agg(F.count(value).alias("matched"), F.count("*").alias("total"))


def colour_scale(mapped: DataFrame, value: str, robust: bool = True) -> DataFrame:
    """vmin, vmax and mode for a map: diverging and symmetric if values lie on both sides of 0, else sequential. No row
    without values. robust: from the 2nd to the 98th percentile."""
    ends = quantiles(mapped, value, {"a": 0.02, "b": 0.98}) if robust else mapped.agg(F.min(value).alias("a"), F.max(value).alias("b"))
    ends = ends.where("a is not null")
    both = (F.col("a") < 0) & (F.col("b") > 0)
    most = F.greatest(F.abs("a"), F.abs("b"))
    return ends.select(
        F.when(both, -most).otherwise(F.col("a")).alias("vmin"), F.when(both, most).otherwise(F.col("b")).alias("vmax"),
        F.when(both, "diverging").otherwise("sequential").alias("mode"),
    )


def unmatched(regions: DataFrame, values: DataFrame, key: str = "region_id") -> DataFrame:
    """Ids that only one side has."""
    a, b = (df.select(F.col(key).cast("string").alias(key)).distinct() for df in (regions, values))
    return a.join(b, key, "left_anti").withColumn("side", F.lit("region")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("value")))


def one_region(rows: DataFrame, region_id: int, columns: list[str], time: str) -> DataFrame:
    """A region's series in order of time."""
    return rows.where(F.col("region_id") == region_id).select(time, *columns).orderBy(time)


def catalogue(df: DataFrame) -> DataFrame:
    """Columns of a table with type and metadata."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable, str(f.metadata or {})) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string, nullable boolean, metadata string")
