"""Scalar column functions of the engine. Missing values are NULL; a NaN is made NULL where data come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def no_nan(df: DataFrame) -> DataFrame:
    """NaN to NULL in every float or double column, FLOAT to DOUBLE."""
    floating = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) if c in floating else F.col(c) for c in df.columns])


def normal_longitude(lon) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def one_longitude_range(df: DataFrame, lon: str = "lon") -> DataFrame:
    """``df``, unless its longitudes lie both below 0 and above 180: then they are of two conventions, an error. Reads
    that column once."""
    both = df.agg((F.min(lon) < 0) & (F.max(lon) > 180)).first()[0]
    if both:
        raise ValueError(f"{lon} holds values below 0 and above 180")
    return df


def latitude_weight(lat) -> Column:
    return F.cos(F.radians(lat))


def days_since(days, origin: str = "2002-01-01") -> Column:
    """Fractional days since ``origin`` as a timestamp without time zone."""
    micros = F.round(days * F.lit(86_400_000_000.0)).cast("long")
    return F.timestamp_add("MICROSECOND", micros, F.lit(f"{origin} 00:00:00").cast("timestamp_ntz"))


def month_index(year, month) -> Column:
    return year * 12 + month


def month_start(year, month) -> Column:
    return F.make_timestamp_ntz(year, month, F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def is_finite(x) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def ratio(a, b) -> Column:
    """a / b; NULL if b is 0 or NULL."""
    return F.try_divide(a, b)
