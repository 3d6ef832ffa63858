"""Running sums and exact quantiles over a whole table, without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraspan.functions.storage import stored


def running_sums(rows: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with the sum of each of ``sums`` over all rows up to and with their own, by ``order`` (unique, any columns
    that can be sorted).

    Rows are dealt by ranges of ``order`` and kept in the shared folder; a window adds up inside a range, and the sums of
    the ranges before it are added, of which the driver holds a row a range.
    """
    valued = rows.select("*", *[c.cast("long").alias(n) for n, c in sums.items()])
    dealt = stored(valued.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_range").agg(*[F.sum(n).alias(n) for n in sums]).orderBy("_range").collect()
    before, base = dict.fromkeys(sums, 0), []
    for t in totals:
        base.append((t["_range"], *before.values()))
        before = {n: v + (t[n] or 0) for n, v in before.items()}
    offsets = rows.sparkSession.createDataFrame(base, ", ".join(["_range int", *[f"`_before_{n}` long" for n in sums]]))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = dealt.withColumns({n: F.sum(n).over(inside) for n in sums}).join(F.broadcast(offsets), "_range")  # a row a range
    return added.select(*rows.columns, *[(F.coalesce(n, F.lit(0)) + F.col(f"_before_{n}")).alias(n) for n in sums])


def quantiles(rows: DataFrame, value: str, ps: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Exact quantiles of ``value`` (NULL apart) for each group of ``by``, on the line between the two nearest ranks: the
    columns of ``by`` and those named in ``ps``. Groups without values give no row.

    Equal values are counted first, so that a frequent one is a row; the values are then sorted by ranges and ranked by
    running sums, and only those at wanted ranks go on. A group may be as large as the table.
    """
    by = by or []
    names = [f"_by{k}" for k in range(len(by))]
    counted = rows.where(F.col(value).isNotNull()).groupBy(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    ranked = stored(running_sums(counted, [*names, "_v"], {"_upto": F.col("_n")}), "ranks")
    first = F.col("_upto") - F.col("_n")
    groups = ranked.groupBy(*names).agg(F.min(first).alias("_start"), (F.max("_upto") - F.min(first)).alias("_size")).withColumnsRenamed({n: f"{n}_" for n in names})
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}_"))
    joined = ranked.join(groups, same) if names else ranked.join(F.broadcast(groups))  # one row
    place = {n: F.lit(p) * (F.col("_size") - 1) for n, p in ps.items()}
    holds = lambda k: (F.col("_start") + k >= first) & (F.col("_start") + k < F.col("_upto"))
    at = {(n, end): f(x) for n, x in place.items() for end, f in (("low", F.floor), ("high", F.ceil))}
    wanted = F.lit(False)
    for k in at.values():
        wanted = wanted | holds(k)
    found = joined.where(wanted).groupBy(*names).agg(
        *[F.max(F.when(holds(k), F.col("_v"))).alias(f"{n}_{end}") for (n, end), k in at.items()], *[F.max(x - F.floor(x)).alias(f"{n}_part") for n, x in place.items()]
    )
    line = lambda n: F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * F.col(f"{n}_part")
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, by, strict=True)], *[line(n).alias(n) for n in ps])


def with_quantiles(summary: DataFrame, rows: DataFrame, value: str, ps: dict[str, float], by: list[str]) -> DataFrame:
    """``summary``, a row for each group of ``by``, with the quantiles of that group, NULL where it has no values."""
    found = quantiles(rows, value, ps, by).withColumnsRenamed({c: f"_q_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_q_{c}"))
    return summary.join(found, same, "left").drop(*[f"_q_{c}" for c in by])
