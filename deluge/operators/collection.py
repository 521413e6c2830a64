"""Image-collection operators on long pixel tables (one row per pixel per scene)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import REFLECTANCE_SCALE, REQUIRED_BANDS, Grid
from ..functions.dates import half_open


def filter_date(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Half-open [start, end); pushed into the parquet scan by Catalyst.

    When the table is partitioned by ``year``/``month`` (the layout for observation
    tables at scale) the same range is also stated on the partition columns, so whole
    partition directories are pruned before any file is opened.
    """
    out = df.where(half_open(F.col(ts), start, end))
    if "year" in df.columns and "month" in df.columns:
        y0, m0 = int(start[:4]), int(start[5:7])
        y1, m1 = int(end[:4]), int(end[5:7])
        ym = F.col("year") * 100 + F.col("month")
        out = out.where(ym.between(y0 * 100 + m0, y1 * 100 + m1))
    return out


def filter_bounds(df: DataFrame, aoi: Sequence[float] | None, prefix: str = "") -> DataFrame:
    """Keep rows whose bbox (minx, miny, maxx, maxy) touches the AOI [w, s, e, n]."""
    if aoi is None:
        return df
    w, s, e, n = aoi
    c = lambda k: F.col(prefix + k)
    return df.where((c("minx") <= e) & (c("maxx") >= w) & (c("miny") <= n) & (c("maxy") >= s))


def pixel_centre(grid: Grid, row: str = "row", col: str = "col") -> tuple[Column, Column]:
    """x and y of a pixel's centre in the grid's units."""
    return (F.lit(grid.origin_x) + (F.col(col) + F.lit(0.5)) * F.lit(grid.step_x),
            F.lit(grid.origin_y) + (F.col(row) + F.lit(0.5)) * F.lit(grid.step_y))


def clip(df: DataFrame, aoi: Sequence[float] | None, grid: Grid = Grid()) -> DataFrame:
    """Drop pixels whose centre lies outside the AOI (in the grid's units).

    Stated as a range of the integer columns, which the scan can use to skip row groups.
    """
    if aoi is None:
        return df
    w, s, e, n = aoi

    def span(low, high, origin, step):
        a, b = sorted(((low - origin) / step - 0.5, (high - origin) / step - 0.5))
        return math.ceil(a - 1e-9), math.floor(b + 1e-9)
    cols, rows = span(w, e, grid.origin_x, grid.step_x), span(s, n, grid.origin_y, grid.step_y)
    return df.where(F.col("col").between(*cols) & F.col("row").between(*rows))


def filter_list_contains(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.where(F.array_contains(F.col(column), value))


def filter_eq(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def valid_scenes(scenes: DataFrame, required: Sequence[str] = REQUIRED_BANDS,
                 bands: str = "band_names") -> DataFrame:
    """Scenes that carry every required band."""
    need = F.array(*[F.lit(b) for b in required])
    return scenes.where(F.size(F.array_intersect(F.col(bands), need)) == len(set(required)))


def save_first(left: DataFrame, right: DataFrame, key: Sequence[str],
               order: Sequence[str] | None = None, outer: bool = False) -> DataFrame:
    """Each left row gets the first matching right row (smallest ``order``, then payload).

    The pick is a hash aggregate with map-side combine, so a key holding a large share
    of right rows never lands whole in one task.  A single payload column ordered by a
    single column uses primitive ``min`` / ``min_by`` buffers (HashAggregate); wider
    payloads fall back to a struct-valued ``min_by``.
    """
    key = list(key)
    payload = [c for c in right.columns if c not in key]
    order = list(order or payload)
    if len(payload) == 1 and order == payload:
        firsts = right.groupBy(*key).agg(F.min(payload[0]).alias(payload[0]))
    elif len(payload) == 1 and len(order) == 1:
        firsts = right.groupBy(*key).agg(F.min_by(payload[0], order[0]).alias(payload[0]))
    else:
        order_cols = order + [c for c in payload if c not in order]
        firsts = (right.groupBy(*key)
                  .agg(F.min_by(F.struct(*payload), F.struct(*order_cols)).alias("_first"))
                  .select(*key, *[F.col("_first")[c].alias(c) for c in payload]))
    return left.join(firsts, key, "left" if outer else "inner")


def cloud_mask(df: DataFrame, threshold: int, bands: Sequence[str] = REQUIRED_BANDS,
               prob: str = "probability") -> DataFrame:
    """Mask bands where cloud probability >= threshold, scale to reflectance.

    Unmatched scenes (NULL probability, outer save-first) count as clear.
    """
    clear = F.coalesce(F.col(prob), F.lit(0)) < threshold
    keep = [c for c in df.columns if c not in bands and c != prob]
    return df.select(*keep, *[F.when(clear, F.col(b) / F.lit(REFLECTANCE_SCALE)).alias(b) for b in bands])


def drop_fully_masked(df: DataFrame, bands: Sequence[str] = REQUIRED_BANDS) -> DataFrame:
    """Masked observations add nothing to a median: drop them before the shuffle."""
    cond = None
    for b in bands:
        c = F.col(b).isNotNull()
        cond = c if cond is None else (cond | c)
    return df.where(cond)


def dropna_any(df: DataFrame) -> DataFrame:
    """Drop rows with a NULL (or NaN) in any column; safe for names like '.geo'."""
    cond = None
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        ok = c.isNotNull()
        if f.dataType.typeName() in ("double", "float"):
            ok = ok & ~F.isnan(c)
        cond = ok if cond is None else (cond & ok)
    return df if cond is None else df.where(cond)
