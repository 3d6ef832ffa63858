"""Splits, sliding windows and their checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraspan.functions.scalar import month_index, month_start
from terraspan.functions.storage import stored
from terraspan.operators.ranges import with_quantiles


@dataclass(frozen=True)
class SplitSpec:
    """Last year of training, and of validation."""

    train_until: int = 2016
    val_until: int = 2020


@dataclass(frozen=True)
class WindowSpec:
    length: int = 24
    stride: int = 1


def with_split(rows: DataFrame, spec: SplitSpec = SplitSpec()) -> DataFrame:
    year = F.col("year")
    split = F.when(year <= spec.train_until, "train").when(year <= spec.val_until, "val").when(year > spec.val_until, "test").otherwise("unknown")
    return rows.withColumn("split", split)


def windows(rows: DataFrame, channels: list[str], spec: WindowSpec = WindowSpec()) -> DataFrame:
    """Metadata of all windows of ``length`` consecutive months of a region inside one split with every channel there.

    rows: region_id, year, month, split and the channels. A gap or a repeated month, or a missing channel, rejects
    every window over it. ``sample_id`` numbers windows by region, split and start; it is a running count over
    regions plus a place in the region, so nothing but a count for each region and split goes through one task.
    """
    last = spec.length - 1
    by = Window.partitionBy("region_id", "split").orderBy("year", "month")
    ahead, gaps = by.rowsBetween(0, last), by.rowsBetween(0, max(last - 1, 0))
    missing = F.lit(False)
    for c in channels:
        missing = missing | F.col(c).isNull()
    marked = rows.where(F.col("split").isin("train", "val", "test")).select(
        "region_id", "split", "year", "month", missing.cast("int").alias("bad"), month_index(F.col("year"), F.col("month")).alias("mi")
    )
    marked = marked.withColumn("jump", (F.lead("mi").over(by) - F.col("mi") != 1).cast("int"))
    found = marked.select(
        "region_id", "split", F.col("year").alias("start_year"), F.col("month").alias("start_month"),
        F.lead("year", last).over(by).alias("end_year"), F.lead("month", last).over(by).alias("end_month"),
        F.count("*").over(ahead).alias("n"), F.sum("bad").over(ahead).alias("n_bad"),
        (F.sum("jump").over(gaps) if last else F.lit(0)).alias("n_jumps"), F.row_number().over(by).alias("place"),
    ).where((F.col("n") == spec.length) & (F.col("n_bad") == 0) & (F.coalesce("n_jumps", F.lit(0)) == 0) & ((F.col("place") - 1) % spec.stride == 0))
    return numbered(found.select(
        "region_id", "split",
        month_start(F.col("start_year"), F.col("start_month")).alias("start_time"), month_start(F.col("end_year"), F.col("end_month")).alias("end_time"),
        "start_year", "start_month", "end_year", "end_month",
        F.lit(spec.length).alias("window_length"), F.lit(len(channels)).alias("n_channels"),
    ))


def numbered(found: DataFrame) -> DataFrame:
    """Add ``sample_id``: 0, 1, ... by region, split, start."""
    group = ["region_id", "split"]
    counts = found.groupBy(*group).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy(*group).rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select(*group, F.coalesce(before, F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy("start_time"))
    rest = [c for c in found.columns]
    return found.withColumn("_place", place).join(base, group).select((F.col("base") + F.col("_place") - 1).cast("long").alias("sample_id"), *rest)


def counts_by_split(found: DataFrame) -> DataFrame:
    """Number of regions, and mean, sample deviation, least, quartiles and largest of their numbers of windows."""
    per = stored(found.groupBy("split", "region_id").agg(F.count("*").alias("n")), "counts")
    summary = per.groupBy("split").agg(F.count("*").alias("regions"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"), F.min("n").alias("least"), F.max("n").alias("largest"))
    whole = with_quantiles(summary, per, "n", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ["split"])
    return whole.select("split", "regions", "mean", "std", "least", "q25", "q50", "q75", "largest")


def leaks(found: DataFrame) -> DataFrame:
    """Number of windows that occur in more than one split."""
    per = found.groupBy("region_id", "start_time", "end_time").agg(F.countDistinct("split").alias("n"))
    return per.agg(F.count_if(F.col("n") > 1).alias("leaking"))


def wrong_shapes(found: DataFrame, length: int, n_channels: int) -> DataFrame:
    return found.agg(F.count_if(F.col("window_length") != length).alias("wrong_length"), F.count_if(F.col("n_channels") != n_channels).alias("wrong_channels"))


def split_ranges(found: DataFrame) -> DataFrame:
    return found.groupBy("split").agg(F.min("start_time").alias("first_start"), F.max("end_time").alias("last_end"), F.count("*").alias("n_windows"))


def unknown_splits(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("split") == "unknown").alias("n_unknown"))
