"""Cells to regions, and regional means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraspan.functions.scalar import latitude_weight, ratio
from terraspan.functions.storage import stored


#: Sizes of the cover's cells in degrees, from coarse to fine; each is half of the one before.
COARSE, LEVELS = 45.0, 6


def unwrapped(edges: DataFrame) -> DataFrame:
    """Sides in a frame without a seam. A region with a side of more than 180 degrees crosses the antimeridian: its western
    part is moved east by a turn, and everything is there a second time, a turn to the west. A point in [-180, 180) is then
    inside one of the two if it is inside the region. Rings around a pole are not meant."""
    seam = edges.groupBy("region_id").agg(F.max(F.abs(F.col("x2") - F.col("x1"))).alias("_w")).where("_w > 180").select("region_id", F.lit(True).alias("_seam"))
    east = lambda c: F.when(F.col(c) < 0, F.col(c) + 360).otherwise(F.col(c))
    marked = edges.select("region_id", "x1", "y1", "x2", "y2").join(seam, "region_id", "left")
    as_is = F.array(F.struct("x1", "x2"))
    twice = F.array(*[F.struct((east("x1") - k).alias("x1"), (east("x2") - k).alias("x2")) for k in (0.0, 360.0)])
    spread = marked.withColumn("_x", F.explode(F.when(F.col("_seam"), twice).otherwise(as_is)))
    return spread.select("region_id", F.col("_x.x1").alias("x1"), "y1", F.col("_x.x2").alias("x2"), "y2").where("x1 >= -180 or x2 >= -180")


def cover(edges: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Cells of a quadtree that cover each region: those wholly inside, as coarse as can be (region_id, level, ix, iy), and
    those of the last level that a side touches. edges: unwrapped.

    Cells above a touched one are touched. What lies beside a touched cell, below a touched one, and is not touched itself
    lies wholly inside or outside, which one crossing count at its centre tells, against the region's sides in its row of
    cells. All levels go through one join each.
    """
    size = lambda k: F.lit(COARSE) / F.pow(F.lit(2.0), k) if isinstance(k, Column) else F.lit(COARSE / (1 << k))
    span = lambda a, b, k: F.sequence(F.floor((F.least(a, b) - 1e-9) / size(k)), F.floor((F.greatest(a, b) + 1e-9) / size(k)))
    corner = lambda c, n: F.shiftleft(F.col(c), n)

    def touched(sides: DataFrame, k: int) -> DataFrame:
        """Those of ``sides`` (with ix, iy) that meet their closed cell, a little enlarged."""
        dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
        cx, cy = (F.col("ix") + 0.5) * size(k), (F.col("iy") + 0.5) * size(k)
        room = COARSE / (1 << k) / 2 * (1 + 1e-9) + 1e-9
        box = (F.least("x1", "x2") <= cx + room) & (F.greatest("x1", "x2") >= cx - room) & (F.least("y1", "y2") <= cy + room) & (F.greatest("y1", "y2") >= cy - room)
        off = F.abs(dx * (cy - F.col("y1")) - dy * (cx - F.col("x1"))) <= room * (F.abs(dx) + F.abs(dy))
        return sides.where(box & off & (F.col("ix") * size(k) < 180) & ((F.col("ix") + 1) * size(k) > -180))

    sides = touched(edges.withColumn("ix", F.explode(span(F.col("x1"), F.col("x2"), 0))).withColumn("iy", F.explode(span(F.col("y1"), F.col("y2"), 0))), 0)
    for k in range(1, levels):  # a long side is split where it runs, not over its whole box
        four = F.array(*[F.struct((F.col("ix") * 2 + i).alias("ix"), (F.col("iy") * 2 + j).alias("iy")) for i in (0, 1) for j in (0, 1)])
        sides = touched(sides.withColumn("_c", F.explode(four)).select("region_id", "x1", "y1", "x2", "y2", F.col("_c.ix").alias("ix"), F.col("_c.iy").alias("iy")), k)
    border = stored(sides.select("region_id", "ix", "iy").distinct(), "border")
    up = lambda k: F.struct(F.lit(k).alias("level"), F.shiftright("ix", levels - 1 - k).alias("ix"), F.shiftright("iy", levels - 1 - k).alias("iy"))
    marked = border.select("region_id", F.inline(F.array(*map(up, range(levels))))).distinct()
    four = F.array(*[F.struct((F.col("level") + 1).alias("level"), (corner("ix", 1) + i).alias("ix"), (corner("iy", 1) + j).alias("iy")) for i in (0, 1) for j in (0, 1)])
    ends = edges.groupBy("region_id").agg(F.min(F.least("x1", "x2")).alias("a"), F.max(F.greatest("x1", "x2")).alias("b"), F.min(F.least("y1", "y2")).alias("c"), F.max(F.greatest("y1", "y2")).alias("d"))
    first = ends.withColumn("ix", F.explode(span(F.greatest("a", F.lit(-179.9)), F.least("b", F.lit(179.9)), 0))).withColumn("iy", F.explode(span(F.col("c"), F.col("d"), 0)))
    beside = marked.where(F.col("level") < levels - 1).select("region_id", F.inline(four)).unionByName(first.select("region_id", F.lit(0).alias("level"), "ix", "iy"))
    untouched = beside.join(marked, ["region_id", "level", "ix", "iy"], "left_anti")
    rows = edges.where("y1 <> y2").withColumn("level", F.explode(F.array(*map(F.lit, range(levels)))))
    rows = rows.withColumn("iy", F.explode(span(F.col("y1"), F.col("y2"), F.col("level"))))
    lon, lat = (F.col("ix") + 0.5) * size(F.col("level")), (F.col("iy") + 0.5) * size(F.col("level"))
    odd = untouched.join(rows, ["region_id", "level", "iy"]).where(crosses(lon, lat)).groupBy("region_id", "level", "ix", "iy").agg((F.count("*") % 2).alias("odd"))
    return odd.where("odd = 1").drop("odd"), border


def crosses(lon: Column, lat: Column) -> Column:
    """Whether a ray from a point to the east crosses the side of the row."""
    return ((F.col("y1") > lat) != (F.col("y2") > lat)) & (
        lon < (F.col("x2") - F.col("x1")) * (lat - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) + F.col("x1")
    )


def placements(cells: DataFrame, edges: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Places (lon, lat, region_id) that are inside by their cell alone, and the pairs of place and side that have to be looked
    at: the places in border cells with the sides of that region in their row of cells."""
    edges = stored(unwrapped(edges), "sides")
    inner, border = cover(edges, levels)
    size = lambda k: COARSE / (1 << k)
    points = cells.select("lon", "lat").distinct()
    keyed = points.withColumn("_k", F.explode(F.array(*[
        F.struct(F.lit(k).alias("level"), F.floor(F.col("lon") / size(k)).alias("ix"), F.floor(F.col("lat") / size(k)).alias("iy")) for k in range(levels)
    ]))).select("lon", "lat", "_k.*")
    sure = keyed.join(inner, ["level", "ix", "iy"]).select("lon", "lat", "region_id")
    near = keyed.where(F.col("level") == levels - 1).join(border, ["ix", "iy"]).select("lon", "lat", "iy", "region_id")
    rows = edges.where("y1 <> y2").withColumn("iy", F.explode(F.sequence(F.floor(F.least("y1", "y2") / size(levels - 1)), F.floor(F.greatest("y1", "y2") / size(levels - 1)))))
    return sure, near.join(rows, ["region_id", "iy"])


def cells_in_regions(cells: DataFrame, edges: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``cells`` (lon, lat, others) joined to the region that holds each: ``region_id``.

    edges: region_id and the sides x1, y1, x2, y2 of all rings of its polygons; holes and several parts need nothing
    more, and rings may cross the antimeridian. A cell is inside if a ray to the east crosses an odd number of sides (an
    edge belongs to the region above it and to its right). Of several regions the smallest id wins. Cells meet regions by
    the cells of a quadtree that cover these: in inner ones they are inside, in border ones the sides in their row are
    counted. Both are equi-joins on keys as many as there are cells of the cover.
    """
    sure, pairs = placements(cells, edges, levels)
    inside = pairs.where(crosses(F.col("lon"), F.col("lat"))).groupBy("lon", "lat", "region_id").agg((F.count("*") % 2).alias("odd")).where("odd = 1")
    chosen = sure.unionByName(inside.drop("odd")).groupBy("lon", "lat").agg(F.min("region_id").alias("region_id"))
    return cells.join(chosen, ["lon", "lat"])


def weighted_means(grid: DataFrame, variables: list[str], keys: tuple[str, ...] = ("region_id", "time")) -> DataFrame:
    """Mean of each variable over the cells of a region at a time, weighted by the cosine of latitude.

    A cell that lacks a variable counts in neither sum; a region without any value gets NULL. One shuffle for all
    variables, with partial sums before it. Cells outside every region (NULL region_id) are left out.
    """
    w = latitude_weight(F.col("lat"))
    means = [ratio(F.sum(F.col(v) * w), F.sum(F.when(F.col(v).isNotNull(), w))).alias(v) for v in variables]
    return grid.where(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(*means)


def dense(means: DataFrame, regions: DataFrame, keys: tuple[str, str] = ("region_id", "time")) -> DataFrame:
    """A row for every region at every time; NULL where there is no mean. Both lists are distinct keys, so the product
    has as many rows as the result must have."""
    times = means.select(keys[1]).distinct()
    return regions.select(keys[0]).distinct().crossJoin(times).join(means, list(keys), "left")
