"""Pixel layers from one grid to another of the same CRS: nearest, bilinear, area mean.

Both grids are regular, so which target pixels a source pixel bears on is arithmetic on its row and
column: every source row is exploded to those few targets with its weight.  Nearest needs no
shuffle (a target centre lies in one source pixel); the other two sum weighted values in
one hash aggregate with partial sums before its shuffle.  There is no join, and borders of
files or tiles play no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Grid


def _axes(src: Grid, dst: Grid):
    return (("row", src.origin_y, src.step_y, dst.origin_y, dst.step_y), ("col", src.origin_x, src.step_x, dst.origin_x, dst.step_x))


def _edges(axis: str, o: float, s: float, to: float, ts: float) -> tuple[Column, Column]:
    """A source pixel's two ends in target pixels, smaller first."""
    a, b = ((F.lit(o) + (F.col(axis) + F.lit(float(k))) * F.lit(s) - F.lit(to)) / F.lit(ts) for k in (0, 1))
    return F.least(a, b), F.greatest(a, b)


def _some(low: Column, high: Column) -> Column:
    """The integers from low to high as longs; none if high < low."""
    low, high = low.cast("long"), high.cast("long")
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<long>"))


def _targets(df: DataFrame, ranges: dict[str, Column], bands: Sequence[str]) -> DataFrame:
    """Every source row once per target pixel: source row, col, the target's _row, _col and the bands."""
    out = df.select("row", "col", *bands)
    for axis in ("row", "col"):
        out = out.withColumn(f"_{axis}", F.explode(ranges[axis]))
    return out


def nearest(df: DataFrame, src: Grid, dst: Grid, bands: Sequence[str]) -> DataFrame:
    """(row, col, *bands): each target pixel takes the source pixel that holds its centre.

    A centre on a border belongs to one of the two pixels.  Target pixels whose centre lies in no given
    source pixel are not returned; masked (null) values stay so.
    """
    ranges = {}
    for axis, *where in _axes(src, dst):
        low, high = _edges(axis, *where)
        ranges[axis] = _some(F.ceil(low - 0.5), F.ceil(high - 0.5) - 1)
    return _targets(df, ranges, bands).select(F.col("_row").cast("int").alias("row"), F.col("_col").cast("int").alias("col"), *bands)


def area_mean(df: DataFrame, src: Grid, dst: Grid, bands: Sequence[str], min_share: float = 0.0) -> DataFrame:
    """(row, col, *bands): mean of the source pixels a target pixel overlaps, weighted by overlap.

    Masked (null) values do not count; a band is null where the known part covers no more of the target
    than ``min_share`` (0: where nothing is known).
    """
    ranges, share = {}, None
    for axis, *where in _axes(src, dst):
        low, high = _edges(axis, *where)
        ranges[axis] = _some(F.floor(low), F.ceil(high) - 1)
        j = F.col(f"_{axis}")
        part = F.least(high, j + 1) - F.greatest(low, j)
        share = part if share is None else share * part
    weighted = _targets(df, ranges, bands).withColumn("_w", share).where("_w > 0")
    sums = weighted.groupBy("_row", "_col").agg(
        *[F.sum(F.col("_w") * F.col(b)).alias(f"_s_{b}") for b in bands],
        *[F.sum(F.when(F.col(b).isNotNull(), F.col("_w"))).alias(f"_w_{b}") for b in bands])
    return sums.select(F.col("_row").cast("int").alias("row"), F.col("_col").cast("int").alias("col"), *[
        F.when(F.col(f"_w_{b}") > min_share, F.col(f"_s_{b}") / F.col(f"_w_{b}")).alias(b) for b in bands])


def bilinear(df: DataFrame, src: Grid, dst: Grid, bands: Sequence[str]) -> DataFrame:
    """(row, col, *bands): linear between the (up to four) source centres around a target centre.

    A band is null where one of those centres is missing or masked; target pixels without any are not returned.
    """
    ranges, weight, needed = {}, None, None
    for axis, o, s, to, ts in _axes(src, dst):
        ends = [(F.lit(o) + (F.col(axis) + F.lit(k + 0.5)) * F.lit(s) - F.lit(to)) / F.lit(ts) - 0.5 for k in (-1.0, 1.0)]
        # One more on either side: the weight, worked out alike for all, decides.
        ranges[axis] = _some(F.floor(F.least(*ends)), F.ceil(F.greatest(*ends)))
        at = (F.lit(to) + (F.col(f"_{axis}") + 0.5) * F.lit(ts) - F.lit(o)) / F.lit(s) - 0.5
        w = F.lit(1.0) - F.abs(at - F.col(axis))
        around = F.when(at == F.floor(at), 1).otherwise(2)
        weight = w if weight is None else F.when((weight > 0) & (w > 0), weight * w).otherwise(0.0)
        needed = around if needed is None else needed * around
    spread = _targets(df, ranges, bands).withColumn("_w", weight).withColumn("_n", needed).where("_w > 0")
    sums = spread.groupBy("_row", "_col").agg(
        F.max("_n").alias("_n"), *[F.sum(F.col("_w") * F.col(b)).alias(f"_s_{b}") for b in bands],
        *[F.count(b).alias(f"_c_{b}") for b in bands])
    return sums.select(F.col("_row").cast("int").alias("row"), F.col("_col").cast("int").alias("col"), *[
        F.when(F.col(f"_c_{b}") == F.col("_n"), F.col(f"_s_{b}")).alias(b) for b in bands])
