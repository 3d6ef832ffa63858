"""Calendar keys, alignment of sources and de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["region_id", "year", "month"]


def calendar_keys(series: DataFrame, source: str, time: str = "time") -> DataFrame:
    """Add year and month of ``time`` (integers) and name it ``time_<source>``."""
    return series.withColumns({"year": F.year(time), "month": F.month(time)}).withColumnRenamed(time, f"time_{source}")


def merge(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("a", "b"), keys: list[str] = KEY) -> DataFrame:
    """Inner join on region and calendar month. Several rows of a month in one source make as many rows; a month that
    either source lacks is left out. Other columns of equal name get the sources' suffixes."""
    both = (set(a.columns) & set(b.columns)) - set(keys)
    suffixed = lambda df, x: df.withColumnsRenamed({c: f"{c}_{x}" for c in both})
    return suffixed(a, names[0]).join(suffixed(b, names[1]), keys)


def keep_first(rows: DataFrame, order: list[str], keys: list[str] = KEY) -> DataFrame:
    """The first row of each key by ``order``."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(by)).where("_place = 1").drop("_place")


def multiplicity(rows: DataFrame, keys: list[str] = KEY) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"))


def multiplicity_histogram(rows: DataFrame, keys: list[str] = KEY, top: int = 20) -> DataFrame:
    """How many keys have how many rows, fewest rows first."""
    return multiplicity(rows, keys).groupBy("n_rows").agg(F.count("*").alias("n_keys")).orderBy("n_rows").limit(top)


def repeated_keys(rows: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Rows whose key occurs more than once."""
    return rows.join(multiplicity(rows, keys).where("n_rows > 1").select(*keys), keys, "left_semi")
