"""Stationary wavelet decomposition of series as native array functions: bands, coefficients and their inverse.

Reconstructing a level of a stationary transform with an orthonormal filter is a circular convolution with the filter's
autocorrelation, a half-band filter. So the approximation of level j is j smoothings with growing steps, details are
differences of approximations, and bands are sums of details. The coefficients themselves, and the inverse from any choice
of them, take the analysis filters. Filters of any Daubechies order are derived here.

A series is cut into blocks of a bounded number of samples. A block brings along the neighbours that its filters reach, at
the ends of the series those from the other end, and is filtered by itself, so no row holds a whole series.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraspan.functions.scalar import is_finite, ratio

Groups = tuple[tuple[str, tuple[str, ...]], ...]


@dataclass(frozen=True)
class BandSpec:
    """level: of the transform. order: vanishing moments of the Daubechies filter, of twice as many taps. groups: names of
    bands and the details (D1, ...) and approximation (A of the last level) each is made of. block: samples that are
    filtered together."""

    level: int = 5
    least_rows: int = 16
    least_values: int = 24
    order: int = 4
    groups: Groups = (("short", ("D1", "D2")), ("seasonal", ("D3",)), ("long", ("D4", "D5", "A5")))
    block: int = 4096

    def __post_init__(self):
        parts = {f"D{j}" for j in range(1, self.level + 1)} | {f"A{self.level}"}
        if unknown := {p for _, ps in self.groups for p in ps} - parts:
            raise ValueError(f"{sorted(unknown)} are no parts of a transform of {self.level} levels")
        if self.block < self.reach:
            raise ValueError(f"a block has at least {self.reach} samples")

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.groups]

    @property
    def reach(self) -> int:
        """Samples on either side that a sample's bands and coefficients depend on."""
        return (2 * self.order - 1) * ((1 << self.level) - 1)

    def weights(self, parts: tuple[str, ...]) -> list[int]:
        """A band as a sum of approximations: the weight of each level, from 0 (the series itself)."""
        out = [0] * (self.level + 1)
        for p in parts:
            j = int(p[1:])
            if p[0] == "A":
                out[j] += 1
            else:
                out[j - 1] += 1
                out[j] -= 1
        return out

    @classmethod
    def of(cls, settings: dict) -> BandSpec:
        """From settings: wavelet_transform (wavelet_family as db4, levels) and scale_grouping (as short: D1 + D2)."""
        transform = settings.get("wavelet_transform", {})
        if transform.get("transform_type", "swt") != "swt" or transform.get("padding_method", "reflect") != "reflect":
            raise ValueError("only the stationary transform with reflection is offered")
        family = re.fullmatch(r"db(\d+)", str(transform.get("wavelet_family", "db4")))
        if family is None:
            raise ValueError(f"{transform['wavelet_family']} is no Daubechies filter")
        level = int(transform.get("levels", 5))
        groups = tuple((k, tuple(p.strip() for p in v.split("+"))) for k, v in settings.get("scale_grouping", {}).items())
        return cls(level=level, order=int(family[1]), groups=groups or cls.groups, block=max(cls.block, (4 * int(family[1])) << level))


# ---- filters ---------------------------------------------------------------------------------------------------------


@lru_cache
def half_band(order: int) -> tuple[float, tuple[tuple[int, float], ...]]:
    """The autocorrelation of a Daubechies filter over its sum of squares of 2: weight of the sample itself, and of those at
    odd distances on either side. The maximally flat half-band filter, in exact fractions."""
    top = math.prod(Fraction(2 * order + 1 - 2 * i, 2) for i in range(1, 2 * order + 1))
    sides = []
    for m in range(1, order + 1):
        w = (-1) ** (m + order + 1) * top / (math.factorial(order - m) * math.factorial(order - 1 + m) * (2 * m - 1))
        sides.append((2 * m - 1, float(w)))
    return 0.5, tuple(sides)


@lru_cache
def analysis(order: int) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Low and high pass of the decomposition, scaled so that their squares sum to 1/2 each: by factors of the half-band
    polynomial whose roots lie inside the unit circle."""
    ys = np.roots([math.comb(order - 1 + k, k) for k in range(order)][::-1]) if order > 1 else np.array([])
    roots = []
    for y in ys:
        z = np.roots([1, 4 * y - 2, 1])
        roots.append(z[np.argmin(abs(z))])
    h = np.real(np.poly([*[-1.0] * order, *roots]))
    low = (h / h.sum())[::-1]
    return tuple(low.tolist()), tuple(((-1.0) ** (k + 1) * x for k, x in enumerate(low[::-1].tolist())))


def smooth(values: Column, step: int, order: int = 4) -> Column:
    """One pass of the half-band filter, circular, with ``step`` samples between its taps."""
    n, (centre, sides) = F.size(values), half_band(order)

    def at(i: Column) -> Column:
        total = F.lit(centre) * F.get(values, i)
        for k, w in sides:
            total = total + F.lit(w) * (F.get(values, F.pmod(i - k * step, n)) + F.get(values, F.pmod(i + k * step, n)))
        return total

    return F.transform(F.sequence(F.lit(0), n - 1), at)


def filtered(values: Column, taps: tuple[float, ...], step: int, back: bool = False) -> Column:
    """A circular convolution, centred; back: its adjoint."""
    n, half = F.size(values), len(taps) // 2

    def at(i: Column) -> Column:
        total = None
        for k, w in enumerate(taps):
            shift = (k - half if back else half - k) * step
            term = F.lit(w) * F.get(values, F.pmod(i + shift, n))
            total = term if total is None else total + term
        return total

    return F.transform(F.sequence(F.lit(0), n - 1), at)


# ---- series in blocks ------------------------------------------------------------------------------------------------


def interpolated(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``place`` in the series (from 0), ``n`` rows and ``finite`` values there, and ``filled``: a missing value lies on the
    line between the last known value before and the next one after, by place; outside of these it is the nearer one.
    Two running aggregates; a sample looks at no other ones."""
    whole = Window.partitionBy(*keys)
    there = lambda p: F.when(F.col("value").isNotNull(), F.struct(F.col(p).alias("p"), F.col("value").alias("v")))
    known = lambda by: F.last(there("place"), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    s = rows.withColumn("place", F.row_number().over(whole.orderBy(*order, "value")) - 1)
    s = s.withColumns({"n": F.count("*").over(whole), "finite": F.count_if(is_finite(F.col("value"))).over(whole)})
    s = s.withColumn("_a", known(whole.orderBy("place"))).withColumn("_b", known(whole.orderBy(F.desc("place"))))
    a, b = F.col("_a"), F.col("_b")
    between = a["v"] + (b["v"] - a["v"]) * ((F.col("place") - a["p"]) / F.nullif(b["p"] - a["p"], F.lit(0)))
    return s.withColumn("filled", F.when(F.col("value").isNotNull(), F.col("value")).when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(between)).drop("_a", "_b")


def mirrored(level: int) -> Column:
    """Places that a sample of a series of ``n`` takes when it is mirrored at its ends up to a multiple of 2 ** level: its own,
    and those from n on."""
    n, place = F.col("n"), F.col("place")
    length, period = padded_length(n, level), F.greatest(2 * (n - 1), F.lit(1))
    rounds = F.sequence(F.lit(0).cast("long"), F.floor(length / period) + 1)
    more = F.flatten(F.transform(rounds, lambda m: F.array(m * period - place, m * period + place)))
    return F.array_distinct(F.concat(F.array(place.cast("long")), F.filter(more, lambda q: (q >= n) & (q < length))))


def padded_length(n: Column, level: int) -> Column:
    return F.ceil(n / F.lit(1 << level)) * (1 << level)


def blocks(rows: DataFrame, keys: list[str], spec: BandSpec, columns: list[str]) -> DataFrame:
    """Keys, block and ``s``: the ordered samples of a block with those in reach around it, as structs of at (place, beyond the
    ends too), own (of the block itself) and ``columns``. rows: keys, place (all from 0 on), length of the series and the
    columns. A series of at most ``block`` samples is one block without neighbours, to be filtered in a circle."""
    size, reach, length, place = spec.block, spec.reach, F.col("length"), F.col("place")
    last = F.floor((length - 1) / size)

    def copies(shift: Column) -> Column:
        v = place + shift
        near = F.sequence(F.greatest(F.floor((v - reach) / size), F.lit(0).cast("long")), F.least(F.floor((v + reach) / size), last))
        inside = F.filter(near, lambda b: v < F.least((b + 1) * size, length) + reach)
        return F.when((v + reach >= 0) & (v < length + reach), F.transform(inside, lambda b: F.struct(b.alias("b"), v.alias("at")))).otherwise(F.array().cast("array<struct<b:bigint,at:bigint>>"))

    alone = F.array(F.struct(F.lit(0).cast("long").alias("b"), place.cast("long").alias("at")))
    spread = F.concat(*[copies(k * length) for k in (-1, 0, 1)])
    each = rows.withColumn("_c", F.explode(F.when(length <= size, alone).otherwise(spread)))
    own = (F.col("_c.at") == place) & (F.col("_c.b") == F.floor(place / size))
    sample = F.struct(F.col("_c.at").alias("at"), own.alias("own"), *columns)
    return each.groupBy(*keys, F.col("_c.b").alias("block")).agg(F.sort_array(F.collect_list(sample)).alias("s"))


def padded(rows: DataFrame, keys: list[str], order: list[str], spec: BandSpec) -> DataFrame:
    """Interpolated series of enough rows with the mirrored samples at their end: keys, kept, place, length, order, value,
    filled; ``real`` is false for the mirrored ones. A series of too few values has its own rows only, and is not kept."""
    s = interpolated(rows, keys, order).where(F.col("n") >= spec.least_rows).withColumn("kept", F.col("finite") >= spec.least_values)
    own = F.when(F.col("kept"), mirrored(spec.level)).otherwise(F.array(F.col("place").cast("long")))
    s = s.withColumn("_q", F.explode(own)).withColumn("length", F.when(F.col("kept"), padded_length(F.col("n"), spec.level)).otherwise(F.col("n")))
    return s.select(*keys, "kept", F.col("_q").alias("place"), "length", *order, "value", "filled", (F.col("_q") == F.col("place")).alias("real"))


def series(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key with its ordered samples: ``s``, an array of structs of ``order`` and ``value``."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, "value"))).alias("s"))


def bands(rows: DataFrame, order: list[str], spec: BandSpec = BandSpec(), keys: tuple[str, ...] = ("region_id", "variable")) -> DataFrame:
    """keys, the columns of ``order``, value, filled, the bands of ``spec``, reconstructed and ``kept``.

    rows: keys, order, value. A series of fewer than ``least_rows`` rows gives none; one of fewer than
    ``least_values`` finite values gives its rows without bands (kept is false), so that diagnostics see it. A gap in
    the calendar is no gap in the series. One shuffle; each stage is a projection of its own.
    """
    s = blocks(padded(rows, list(keys), order, spec), [*keys, "kept"], spec, [*order, "value", "filled", "real"])
    empty = F.array().cast("array<double>")
    some = lambda c: F.when(F.col("kept"), c).otherwise(empty)
    s = s.withColumn("a0", some(F.transform("s", lambda e: e["filled"])))
    weights = {name: spec.weights(parts) for name, parts in spec.groups}
    for k in range(max(j for w in weights.values() for j, x in enumerate(w) if x)):
        s = s.withColumn(f"a{k + 1}", some(smooth(F.col(f"a{k}"), 1 << k, spec.order)))

    def band(w: list[int], i: Column) -> Column:
        total = None
        for j, x in enumerate(w):
            if x:
                term = F.get(f"a{j}", i) if abs(x) == 1 else F.lit(float(abs(x))) * F.get(f"a{j}", i)
                total = (term if x > 0 else -term) if total is None else total + term if x > 0 else total - term
        return F.lit(None).cast("double") if total is None else total

    each = F.transform("s", lambda e, i: F.struct(
        e["own"].alias("own"), e["real"].alias("real"), *[e[c].alias(c) for c in order], e["value"].alias("value"), F.get("a0", i).alias("filled"),
        *[band(w, i).alias(name) for name, w in weights.items()],
    ))
    out = s.select(*keys, "kept", F.inline(each)).where("own and real").drop("own", "real")
    total = F.col(spec.names[0])
    for name in spec.names[1:]:
        total = total + F.col(name)
    return out.withColumn("reconstructed", total)


def coefficients(rows: DataFrame, order: list[str], spec: BandSpec = BandSpec(), keys: tuple[str, ...] = ("region_id", "variable")) -> DataFrame:
    """The transform itself: keys, place (from 0), length, order, filled, d1 and so on, and a of the last level. Only series
    that give bands. Rows past the end of a series, which stand for its mirrored samples, have NULL in ``order``."""
    whole = padded(rows, list(keys), order, spec).where("kept")
    s = blocks(whole, [*keys, "length"], spec, [*order, "filled", "real"]).withColumn("a0", F.transform("s", lambda e: e["filled"]))
    low, high = analysis(spec.order)
    for j in range(1, spec.level + 1):
        s = s.withColumns({f"d{j}": filtered(F.col(f"a{j - 1}"), high, 1 << (j - 1)), f"a{j}": filtered(F.col(f"a{j - 1}"), low, 1 << (j - 1))})
    names = [*[f"d{j}" for j in range(1, spec.level + 1)], f"a{spec.level}"]
    each = F.transform("s", lambda e, i: F.struct(
        e["own"].alias("own"), e["at"].alias("place"), *[F.when(e["real"], e[c]).alias(c) for c in order], e["filled"].alias("filled"), *[F.get(c, i).alias(c) for c in names],
    ))
    return s.select(*keys, "length", F.inline(each)).where("own").drop("own")


def inverse(coeffs: DataFrame, keep: list[str], spec: BandSpec = BandSpec(), keys: tuple[str, ...] = ("region_id", "variable")) -> DataFrame:
    """Series rebuilt from the coefficients named in ``keep`` (as d3, a5), the others taken as 0: keys, place, rebuilt."""
    names = [c.lower() for c in keep]
    s = blocks(coeffs.select(*keys, "place", "length", *names), list(keys), spec, names)
    s = s.withColumn("x", F.transform("s", lambda e: e[f"a{spec.level}"] if f"a{spec.level}" in names else F.lit(0.0)))
    low, high = analysis(spec.order)
    for j in range(spec.level, 0, -1):
        rebuilt = filtered(F.col("x"), low, 1 << (j - 1), back=True)
        if f"d{j}" in names:
            detail = filtered(F.col(f"s.d{j}"), high, 1 << (j - 1), back=True)
            rebuilt = F.zip_with(rebuilt, detail, lambda a, b: a + b)
        s = s.withColumn("x", rebuilt)
    each = F.transform("s", lambda e, i: F.struct(e["own"].alias("own"), e["at"].alias("place"), F.get("x", i).alias("rebuilt")))
    return s.select(*keys, F.inline(each)).where("own").drop("own")


def diagnostics(banded: DataFrame, keys: tuple[str, ...] = ("region_id", "variable"), spec: BandSpec = BandSpec()) -> DataFrame:
    """A row for each series that had enough rows: number, mean, deviation, least and largest of the filled signal, the
    bands' shares of the raw variance (NULL if that is 0, or below two values) and the error of the reconstruction."""
    raw = F.when(is_finite(F.col("value")) & F.col("kept"), F.col("value"))
    share = lambda c: ratio(F.when(F.count(raw) >= 2, F.var_pop(c)), F.nullif(F.var_pop(raw), F.lit(0.0)))
    both = F.when(is_finite(F.col("filled")) & is_finite(F.col("reconstructed")), F.pow(F.col("filled") - F.col("reconstructed"), 2))
    n = F.count("filled")
    return banded.groupBy(*keys).agg(
        F.when(n > 0, n).alias("n_obs"), F.avg("filled").alias("signal_mean"), F.stddev_pop("filled").alias("signal_std"),
        F.min("filled").alias("signal_min"), F.max("filled").alias("signal_max"),
        *[share(c).alias(f"{c}_frac") for c in spec.names],
        F.sqrt(F.avg(both)).alias("rmse"),
    )


def wide(banded: DataFrame, variables: list[str], keys: list[str], spec: BandSpec = BandSpec()) -> DataFrame:
    """One row for each of ``keys`` with a column for each band and one for their sum, for each variable. Of several samples of a key the first by
    ``time``, and ``other_time`` if it is there, counts. Keys that any variable has are there, as after a chain of full
    outer joins."""
    parts = (*spec.names, "reconstructed")
    kept = banded.where("kept")
    first = lambda v, p: F.min_by(F.when(F.col("variable") == v, F.col(p)), F.when(F.col("variable") == v, F.struct("time", *[c for c in ("other_time",) if c in banded.columns]))).alias(f"{v}_{p}")
    return kept.groupBy(*keys).agg(*[first(v, p) for v in variables for p in parts])
