"""Climatology, anomalies, normalised anomalies and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraspan.functions.scalar import ratio
from terraspan.functions.storage import stored
from terraspan.operators.ranges import with_quantiles


def climatology(rows: DataFrame, variables: list[str]) -> DataFrame:
    """Mean of each variable by region and calendar month."""
    return rows.groupBy("region_id", "month").agg(*[F.avg(v).alias(f"{v}_climatology") for v in variables])


def with_anomalies(rows: DataFrame, variables: list[str]) -> DataFrame:
    """Add each variable's climatology and anomaly. A window, so there is no join and one shuffle."""
    by = Window.partitionBy("region_id", "month")
    means = rows.select("*", *[F.avg(v).over(by).alias(f"{v}_climatology") for v in variables])
    return means.select("*", *[(F.col(v) - F.col(f"{v}_climatology")).alias(f"{v}_anomaly") for v in variables])


def anomaly_std(rows: DataFrame, variables: list[str]) -> DataFrame:
    """Population standard deviation of each anomaly by region."""
    return rows.groupBy("region_id").agg(*[F.stddev_pop(f"{v}_anomaly").alias(f"{v}_anomaly_std") for v in variables])


def with_normalized(rows: DataFrame, variables: list[str], least_std: float = 0.0) -> DataFrame:
    """Add each anomaly's deviation by region and the anomaly divided by it; NULL where that is not above ``least_std``."""
    by = Window.partitionBy("region_id")
    stds = rows.select("*", *[F.stddev_pop(f"{v}_anomaly").over(by).alias(f"{v}_anomaly_std") for v in variables])
    std = lambda v: F.when(F.col(f"{v}_anomaly_std") > least_std, F.col(f"{v}_anomaly_std"))
    return stds.select("*", *[ratio(F.col(f"{v}_anomaly"), std(v)).alias(f"{v}_anomaly_normalized") for v in variables])


def long_form(rows: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """keys, variable, value; columns: variable by column."""
    each = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(c).cast("double").alias("value")) for c, v in columns.items()])
    return rows.select(*keys, F.inline(each))


def check_monthly_means(rows: DataFrame, variables: list[str]) -> DataFrame:
    """Mean, median and largest of the absolute mean anomaly over regions and months; all are about 0."""
    long = long_form(rows, ["region_id", "month"], {f"{v}_anomaly": v for v in variables})
    means = stored(long.groupBy("variable", "region_id", "month").agg(F.abs(F.avg("value")).alias("x")), "means")
    summary = means.groupBy("variable").agg(F.avg("x").alias("mean_abs"), F.max("x").alias("max_abs"))
    return with_quantiles(summary, means, "x", {"median_abs": 0.5}, ["variable"]).select("variable", "mean_abs", "median_abs", "max_abs")


def check_normalized_std(rows: DataFrame, variables: list[str]) -> DataFrame:
    """Mean, median, least and largest deviation of the normalised anomaly over regions; all are about 1."""
    long = long_form(rows, ["region_id"], {f"{v}_anomaly_normalized": v for v in variables})
    stds = stored(long.groupBy("variable", "region_id").agg(F.stddev_pop("value").alias("x")), "stds")
    summary = stds.groupBy("variable").agg(F.avg("x").alias("mean_std"), F.min("x").alias("min_std"), F.max("x").alias("max_std"))
    return with_quantiles(summary, stds, "x", {"median_std": 0.5}, ["variable"]).select("variable", "mean_std", "median_std", "min_std", "max_std")
