"""Keys that make range joins equi-joins, whatever the sizes: a range lies in bins of about its own size, so it has two keys
an axis at most, and a point has one key for each level that some range lies on. The levels are found by a scalar subquery
over the ranges, so nothing runs before the query does."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["__level", "__k0", "__k1"]


def level_of(size: Column, unit: float) -> Column:
    """The least level, from 0, whose bins, unit * 2 ** level wide, are as wide as the range."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(size, F.lit(unit)) / unit))).cast("int")


def _bin(x: Column, unit: float) -> Column:
    return F.floor(x / (F.lit(unit) * F.pow(F.lit(2.0), F.col("__level")))).cast("bigint")


def keyed_ranges(ranges: DataFrame, bounds: list[tuple[Column, Column]], unit: float) -> DataFrame:
    """ranges with their keys: one row for each bin that the range touches on its own level; bounds: lowest and highest value by axis."""
    size = reduce(F.greatest, [high - low for low, high in bounds])
    out = ranges.withColumn("__level", level_of(size, unit))
    for k, (low, high) in enumerate(bounds):
        out = out.withColumn(KEYS[1 + k], F.explode(F.sequence(_bin(low, unit), _bin(high, unit))))
    return out


def keyed_points(points: DataFrame, place: list[Column], ranges: DataFrame, unit: float, levels: Column | None = None) -> DataFrame:
    """points with their keys: one row for each level that keyed `ranges` have, or for each of the array `levels`, where finding those would compute costly ranges twice."""
    if levels is None:
        levels = ranges.agg(F.sort_array(F.collect_set("__level")).alias("levels")).scalar()  # some dozens at most
    out = points.withColumn("__level", F.explode(levels))
    return out.withColumns({KEYS[1 + k]: _bin(x, unit) for k, x in enumerate(place)})


def keys(axes: int) -> list[str]:
    return KEYS[: 1 + axes]
