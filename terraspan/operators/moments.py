"""Normalisation from stored, mergeable states: a table of count, mean and sum of squared deviations by region, month and
variable, to which each batch of new months adds its own.

The mean of a state is the climatology. Anomalies of the fitted rows add up to 0 in every month, so the deviation of a
region's anomalies follows from its states as well: the stored table is all that normalising new rows takes, and rows that
were fitted before are not read again. Which rows are fitted is the caller's choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraspan.functions.scalar import ratio
from terraspan.operators.normalize import long_form

KEYS = ["region_id", "month", "variable"]
STATE = "region_id long, month int, variable string, n long, mean double, m2 double"


def states(rows: DataFrame, variables: list[str]) -> DataFrame:
    """KEYS, n, mean, m2 of the values there are; a variable without any in a region and month has no state."""
    long = long_form(rows, ["region_id", "month"], {v: v for v in variables}).where("value is not null")
    n = F.count("*")
    return long.groupBy(*KEYS).agg(n.alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * n).alias("m2"))


def merged(parts: DataFrame) -> DataFrame:
    """One state for each key from several, each as many as there are batches; in order of size, so that the result doesn't
    depend on how they come."""

    def add(a: Column, b: Column) -> Column:
        n, d = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + d * (b["n"] / n)).alias("mean"), (a["m2"] + b["m2"] + d * d * (a["n"] * (b["n"] / n))).alias("m2"))

    several = parts.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("n", "mean", "m2"))).alias("s"))
    one = F.aggregate(F.slice("s", 2, F.size("s")), F.col("s")[0], add)
    return several.select(*KEYS, one.alias("s")).select(*KEYS, "s.n", "s.mean", "s.m2")


def add_batch(spark: SparkSession, path: str, rows: DataFrame, variables: list[str], batch: str) -> None:
    """Store the states of a batch of rows below ``path``. A batch that comes again replaces itself, so a job that is repeated
    counts nothing twice; batches must not share rows."""
    states(rows, variables).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch={batch}")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The states of all batches below ``path``, merged."""
    return merged(spark.read.schema(STATE + ", batch string").parquet(path))


def compact(spark: SparkSession, path: str, to: str) -> None:
    """The states of all batches as the first batch of a new table; batches after that go there."""
    load(spark, path).write.mode("errorifexists").option("compression", "zstd").parquet(f"{to}/batch=until-now")


def normalized(rows: DataFrame, fitted: DataFrame, variables: list[str], least_std: float = 0.0) -> DataFrame:
    """``rows`` with climatology, anomaly, deviation and normalised anomaly of each variable from ``fitted`` states, as
    ``normalize.with_normalized`` gives them from the rows themselves. NULL where nothing was fitted, or the deviation is not
    above ``least_std``."""
    only = lambda v, c: F.max(F.when(F.col("variable") == v, c))
    months = fitted.groupBy("region_id", "month").agg(*[only(v, F.col("mean")).alias(f"{v}_climatology") for v in variables])
    spread = fitted.groupBy("region_id", "variable").agg(F.sqrt(F.sum("m2") / F.sum("n")).alias("std"))
    stds = spread.groupBy("region_id").agg(*[only(v, F.col("std")).alias(f"{v}_anomaly_std") for v in variables])
    joined = rows.join(months, ["region_id", "month"], "left").join(stds, "region_id", "left")
    out = joined.withColumns({f"{v}_anomaly": F.col(v) - F.col(f"{v}_climatology") for v in variables})
    std = lambda v: F.when(F.col(f"{v}_anomaly_std") > least_std, F.col(f"{v}_anomaly_std"))
    return out.withColumns({f"{v}_anomaly_normalized": ratio(F.col(f"{v}_anomaly"), std(v)) for v in variables})
