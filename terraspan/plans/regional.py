"""The whole chain: grids to regional means, alignment, normalisation, bands, windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraspan.functions import columns as C
from terraspan.functions.columns import with_suffix
from terraspan.functions.scalar import month_index
from terraspan.operators import align, multiscale, normalize, spatial, windows


@dataclass(frozen=True)
class Settings:
    split: windows.SplitSpec = windows.SplitSpec()
    window: windows.WindowSpec = windows.WindowSpec()
    band: multiscale.BandSpec = multiscale.BandSpec()


def regional_series(grid: DataFrame, edges: DataFrame, variables: list[str]) -> DataFrame:
    """Dense series of regional means. Cells are placed once for the grid, not once for each time."""
    placed = spatial.cells_in_regions(grid.select("lon", "lat").distinct(), edges)
    means = spatial.weighted_means(grid.join(placed, ["lon", "lat"]), variables)
    return spatial.dense(means, edges)


def normalized(a: DataFrame, b: DataFrame, variables: list[str]) -> DataFrame:
    merged = align.merge(align.calendar_keys(a, "a"), align.calendar_keys(b, "b"))
    return normalize.with_normalized(normalize.with_anomalies(merged, variables), variables)


def multiscale_table(
    rows: DataFrame, variables: list[str], settings: Settings = Settings(), from_b: tuple[str, ...] = (), dedupe: str = "late"
) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the bands of each variable and their sum, one row a region and month, and the diagnostics of each series.

    A variable's series runs in the order of its source's time: ``time_b`` for those of ``from_b``, else ``time_a``, or
    the one of the two that is there, or the month; the other time settles ties. Where a month has several
    observations each is a sample of the series, and the earliest one's values and bands stay (dedupe: late), or the
    later ones go before the bands are taken (early).
    """
    if dedupe not in ("late", "early"):
        raise ValueError(f"dedupe is late or early, not {dedupe}")
    timed = rows.withColumn("time", month_index(F.col("year"), F.col("month")))
    order = [c for c in ("time_b", "time_a") if c in rows.columns] or ["time"]
    if dedupe == "early":
        timed = align.keep_first(timed, order)
    keys, pieces = ["region_id", "year", "month"], []
    for v in variables:
        time = C.time_column(rows, "b" if v in from_b else "a") or "time"
        other = next((c for c in ("time_a", "time_b") if c in rows.columns and c != time), time)
        value = F.col(f"{v}_anomaly_normalized").cast("double")
        pieces.append(F.struct(F.lit(v).alias("variable"), F.col(time).alias("time"), F.col(other).alias("other_time"), value.alias("value")))
    banded = multiscale.bands(timed.select(*keys, F.inline(F.array(*pieces))), ["time", "other_time", "year", "month"], settings.band)
    wide = multiscale.wide(banded, variables, align.KEY, settings.band)
    table = align.keep_first(timed.join(wide, align.KEY, "left"), order).drop("time")
    return table, multiscale.diagnostics(banded, spec=settings.band)


def window_table(table: DataFrame, settings: Settings = Settings()) -> DataFrame:
    channels = with_suffix(table, *[f"_{name}" for name in settings.band.names], in_order=True)
    return windows.windows(windows.with_split(table, settings.split), channels, settings.window)
