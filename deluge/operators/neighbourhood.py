"""Pixel-neighbourhood operators: capped connected-component size and slope.

Connected count (cap k, 4-connected, equal values): a tile's window of core +/- (k-1)
cells is exact.  If a pixel's component inside the window has fewer than k cells, all
of them lie within k-2 steps, so none of their neighbours leaves the window and the
component is complete; otherwise the cap is reached.  Each pixel is copied to every
tile whose window holds it (at most 4 when tile > 2(k-1)), tiles are labelled in one
``applyInPandas`` pass, and only core pixels are kept.  One shuffle, no iteration,
and a group never exceeds (tile + 2(k-1))^2 pixels however the data is skewed.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# The per-tile function is shipped by value (it needs only numpy and pandas), so Python
# workers do not have to import this package: it works from --py-files, an installed
# wheel, or neither.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def component_labels(values: np.ndarray, present: np.ndarray) -> np.ndarray:
    """For each cell (flat) the smallest cell of its 4-connected equal-value component; absent cells are alone."""
    h, w = values.shape
    idx = np.arange(h * w).reshape(h, w)
    right = present[:, :-1] & present[:, 1:] & (values[:, :-1] == values[:, 1:])
    down = present[:-1, :] & present[1:, :] & (values[:-1, :] == values[1:, :])
    u = np.concatenate([idx[:, :-1][right], idx[:-1, :][down]])
    v = np.concatenate([idx[:, 1:][right], idx[1:, :][down]])
    parent = np.arange(h * w)
    while u.size:
        pu, pv = parent[u], parent[v]
        diff = pu != pv
        if not diff.any():
            break
        lo, hi = np.minimum(pu[diff], pv[diff]), np.maximum(pu[diff], pv[diff])
        np.minimum.at(parent, hi, lo)
        while True:
            nxt = parent[parent]
            if np.array_equal(nxt, parent):
                break
            parent = nxt
    return parent


def component_sizes(values: np.ndarray, present: np.ndarray) -> np.ndarray:
    """Size of each cell's 4-connected equal-value component (0 where absent)."""
    h, w = values.shape
    parent, flat_present = component_labels(values, present), present.ravel()
    sizes = np.bincount(parent[flat_present], minlength=h * w)
    out = np.where(flat_present, sizes[parent], 0)
    return out.reshape(h, w)


def _tile_counter(tile: int, halo: int, cap: int, value_col: str, payload: tuple):
    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(pdf["_tr"].iloc[0]), int(pdf["_tc"].iloc[0])
        r0, c0 = tr * tile - halo, tc * tile - halo
        size = tile + 2 * halo
        rr = pdf["row"].to_numpy(dtype=np.int64) - r0
        cc = pdf["col"].to_numpy(dtype=np.int64) - c0
        vals = np.zeros((size, size), dtype=np.int64)
        present = np.zeros((size, size), dtype=bool)
        vals[rr, cc] = pdf[value_col].to_numpy(dtype=np.int64)
        present[rr, cc] = True
        sizes = component_sizes(vals, present)
        core = (rr >= halo) & (rr < halo + tile) & (cc >= halo) & (cc < halo + tile)
        out = pd.DataFrame({
            "row": pdf["row"].to_numpy()[core].astype(np.int32),
            "col": pdf["col"].to_numpy()[core].astype(np.int32),
            value_col: pdf[value_col].to_numpy()[core].astype(np.int32),
            "count": np.minimum(sizes[rr[core], cc[core]], cap).astype(np.int32),
        })
        for p in payload:
            out[p] = pdf[p].to_numpy()[core]
        return out
    return count


#: Bits of a column number in a pixel's label; rows have the rest.
_COLUMN_BITS = 31


def _tile_labels(tile: int, value_col: str, payload: tuple):
    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        rr, cc = pdf["row"].to_numpy(dtype=np.int64), pdf["col"].to_numpy(dtype=np.int64)
        r0, c0 = int(pdf["_tr"].iloc[0]) * tile, int(pdf["_tc"].iloc[0]) * tile
        at = (rr - r0) * tile + cc - c0
        vals, present = np.zeros(tile * tile, np.int64), np.zeros(tile * tile, bool)
        vals[at], present[at] = pdf[value_col].to_numpy(dtype=np.int64), True
        low = component_labels(vals.reshape(tile, tile), present.reshape(tile, tile))[at]
        sizes = np.bincount(low, minlength=tile * tile)
        out = pd.DataFrame({
            "row": rr.astype(np.int32), "col": cc.astype(np.int32), value_col: pdf[value_col].to_numpy().astype(np.int32),
            "_label": ((low // tile + r0) << _COLUMN_BITS) + low % tile + c0, "_local": sizes[low].astype(np.int64)})
        for p in payload:
            out[p] = pdf[p].to_numpy()
        return out
    return label


def connected_pixel_count_any(df: DataFrame, value_col: str, cap: int | None = None, tile: int = 256,
                              payload: tuple = ()) -> DataFrame:
    """(row, col, value, count, *payload) for a cap of any size, or none: no halo grows with it.

    Tiles are labelled on their own.  Pixels at tile borders meet their neighbours across the
    border by an equi-join on the position; the pairs of labels they yield form a graph whose
    components (``graph.components``) merge the tiles' labels.  A component's size is the sum of its
    parts' sizes, so a component over all tiles is as many rows as it has parts.
    """
    from .graph import components
    src = df.where(F.col(value_col).isNotNull()).select(
        F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"),
        F.col(value_col).cast("int").alias(value_col), *payload)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name in payload]
    tiles = src.withColumns({"_tr": F.floor(F.col("row") / tile), "_tc": F.floor(F.col("col") / tile)})
    labelled = cut_lineage(tiles.groupBy("_tr", "_tc").applyInPandas(
        _tile_labels(tile, value_col, tuple(payload)),
        schema=", ".join([f"row int, col int, `{value_col}` int, _label long, _local long", *fields])))

    def last(c):
        return F.pmod(F.col(c), F.lit(tile)) == tile - 1

    def first(c):
        return F.pmod(F.col(c), F.lit(tile)) == 0
    links = None
    for axis, other in (("row", "col"), ("col", "row")):
        here = labelled.where(last(axis)).select((F.col(axis) + 1).alias(axis), other, value_col, F.col("_label").alias("a"))
        there = labelled.where(first(axis)).select(axis, other, value_col, F.col("_label").alias("b"))
        pairs = here.join(there, [axis, other, value_col]).select("a", "b")
        links = pairs if links is None else links.unionByName(pairs)
    roots = components(links.distinct())
    parts = labelled.select("_label", "_local").distinct().join(
        roots.withColumnRenamed("node", "_label"), "_label", "left").withColumn("root", F.coalesce("root", "_label"))
    # Only labels that reach over a border need the join; all others know their size.
    sizes = parts.groupBy("root").agg(F.sum("_local").alias("_size"))
    merged = roots.join(sizes, "root").select(F.col("node").alias("_label"), "_size")
    out = labelled.join(merged, "_label", "left").withColumn("count", F.coalesce("_size", "_local"))
    count = F.col("count") if cap is None else F.least(F.col("count"), F.lit(cap).cast("long"))
    return out.select("row", "col", value_col, count.alias("count"), *payload)


def connected_pixel_count(df: DataFrame, value_col: str, cap: int, tile: int = 256,
                          payload: tuple = ()) -> DataFrame:
    """(row, col, value, count, *payload): count = min(cap, size of the pixel's
    equal-value 4-connected component).  ``payload`` columns ride along, so callers
    need no join back.  Masked (NULL) pixels belong to no component and are not returned.
    A cap too large for a halo inside the tile goes through ``connected_pixel_count_any``.
    """
    halo = cap - 1
    if tile <= 2 * halo:
        any_ = connected_pixel_count_any(df, value_col, cap, tile, payload)
        return any_.withColumn("count", F.col("count").cast("int"))
    src = df.where(F.col(value_col).isNotNull()).select(
        F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"),
        F.col(value_col).cast("int").alias(value_col), *payload)
    tiles = (src
             .withColumn("_tr", F.explode(F.sequence(F.floor((F.col("row") - halo) / tile),
                                                       F.floor((F.col("row") + halo) / tile))))
             .withColumn("_tc", F.explode(F.sequence(F.floor((F.col("col") - halo) / tile),
                                                       F.floor((F.col("col") + halo) / tile)))))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name in payload]
    schema = ", ".join([f"row int, col int, `{value_col}` int, count int"] + fields)
    return tiles.groupBy("_tr", "_tc").applyInPandas(
        _tile_counter(tile, halo, cap, value_col, tuple(payload)), schema=schema)


def _tile_slope(tile: int, dx: float, dy: float):
    def slope(pdf: pd.DataFrame) -> pd.DataFrame:
        size = tile + 2
        rr = pdf["row"].to_numpy(dtype=np.int64) - (int(pdf["_tr"].iloc[0]) * tile - 1)
        cc = pdf["col"].to_numpy(dtype=np.int64) - (int(pdf["_tc"].iloc[0]) * tile - 1)
        e = np.full((size, size), np.nan)
        e[rr, cc] = pdf["_e"].to_numpy(dtype=float)
        core = (rr >= 1) & (rr <= tile) & (cc >= 1) & (cc <= tile)
        r, c = rr[core], cc[core]
        gx = (e[r, c + 1] - e[r, c - 1]) / (2.0 * dx)
        gy = (e[r + 1, c] - e[r - 1, c]) / (2.0 * dy)
        return pd.DataFrame({"row": pdf["row"].to_numpy()[core].astype(np.int32),
                             "col": pdf["col"].to_numpy()[core].astype(np.int32),
                             "slope": np.degrees(np.arctan(np.sqrt(gx * gx + gy * gy)))})
    return slope


def slope_degrees(df: DataFrame, elevation: str = "elevation", dx: float = 30.0, dy: float = 30.0,
                  tile: int = 256) -> DataFrame:
    """(row, col, slope) from the 4-connected neighbours; NULL where a neighbour is missing.

    A tile with a border of one pixel holds all it needs, so only border pixels travel more
    than once (about 3 % more rows at 256 x 256), in one shuffle.
    """
    low = lambda c: F.floor((F.col(c) - 1) / tile)
    high = lambda c: F.floor((F.col(c) + 1) / tile)
    tiles = (df.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"),
                       F.col(elevation).cast("double").alias("_e"))
             .withColumn("_tr", F.explode(F.sequence(low("row"), high("row"))))
             .withColumn("_tc", F.explode(F.sequence(low("col"), high("col")))))
    out = tiles.groupBy("_tr", "_tc").applyInPandas(_tile_slope(tile, dx, dy), "row int, col int, slope double")
    return out.select("row", "col", F.nanvl("slope", F.lit(None).cast("double")).alias("slope"))
