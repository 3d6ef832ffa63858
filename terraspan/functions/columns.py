"""Choices of columns by name or type. They read the schema only, so none of them runs a job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

LONGITUDE = ("longitude", "lon")
LATITUDE = ("latitude", "lat")
TIME = ("valid_time", "time")


class MissingColumn(ValueError):
    pass


def first_present(df: DataFrame, wanted: tuple[str, ...], what: str = "column") -> str:
    for c in wanted:
        if c in df.columns:
            return c
    raise MissingColumn(f"no {what} among {df.columns}: one of {list(wanted)} is needed")


def canonical_grid(df: DataFrame, short_first: bool = False) -> DataFrame:
    """Rename the grid's coordinates to time, lat and lon. short_first: the other preference where several are there."""
    order = (lambda x: x[::-1]) if short_first else (lambda x: x)
    names = {first_present(df, order(w), what): to for w, what, to in ((LONGITUDE, "longitude", "lon"), (LATITUDE, "latitude", "lat"), (TIME, "time", "time"))}
    return df.withColumnsRenamed({a: b for a, b in names.items() if a != b})


def time_column(df: DataFrame, source: str) -> str | None:
    """The time of a variable's source (a or b), or the other source's; None if neither is there."""
    return next((c for c in (f"time_{source}", "time_a", "time_b") if c in df.columns), None)


def without(df: DataFrame, names: tuple[str, ...] = ("number", "expver")) -> DataFrame:
    """``df`` without auxiliary columns; those that are not there do no harm."""
    return df.drop(*[c for c in names if c in df.columns])


def unique(names: list[str]) -> list[str]:
    """Names without repetitions, in order."""
    return list(dict.fromkeys(names))


def subset(df: DataFrame, keys: list[str], wanted: list[str]) -> tuple[DataFrame, list[str]]:
    """Keys and those of ``wanted`` that exist, and the names that do not; an error if none exists."""
    there = [c for c in unique(wanted) if c in df.columns and c not in keys]
    if not there:
        raise MissingColumn(f"none of {wanted} is there")
    return df.select(*keys, *there), [c for c in wanted if c not in df.columns]


def feature_columns(df: DataFrame, keys: set[str]) -> list[str]:
    """Numeric and boolean columns that are no keys, in order."""
    return [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name not in keys]


def with_suffix(df: DataFrame, *suffixes: str, in_order: bool = False) -> list[str]:
    found = [c for c in df.columns if c.endswith(suffixes)]
    if not found:
        raise MissingColumn(f"no column ends with {suffixes}")
    return sorted(found) if in_order else found


def require(df: DataFrame, columns: set[str]) -> DataFrame:
    if missing := columns - set(df.columns):
        raise MissingColumn(f"missing columns: {sorted(missing)}")
    return df
