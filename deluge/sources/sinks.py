"""Sinks: CSV, GeoJSON features, JSON report, tiled raster tables, models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import cut_lineage


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def write_geojson(df: DataFrame, path: str, geom: str = "geometry") -> None:
    """One GeoJSON Feature per line: {"type":"Feature","geometry":..,"properties":{..}}."""
    props = [c for c in df.columns if c != geom]
    feature = F.concat(F.lit('{"type":"Feature","geometry":'), G.to_geojson(F.col(geom)),
                       F.lit(',"properties":'), F.to_json(F.struct(*[F.col(f"`{c}`") for c in props])), F.lit("}"))
    df.select(feature.alias("value")).write.mode("overwrite").text(path)


def write_geojson_if_any(df: DataFrame, path: str, geom: str = "geometry") -> bool:
    """Written only when there is at least one row (the reference skips empty layers).

    The rows are computed once, into a table that both the test and the writer read.
    """
    df = cut_lineage(df)
    if df.isEmpty():
        return False
    write_geojson(df, path, geom)
    return True


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report as JSON (one small file)."""
    report.coalesce(1).write.mode("overwrite").json(path)


def write_raster(df: DataFrame, path: str, tile: int = 256, max_pixels: float | None = None,
                 tiles_per_folder: int = 64) -> None:
    """Pixel table sorted by tile, in folders of ``tiles_per_folder`` x ``tiles_per_folder`` tiles.

    Rows of a tile lie together in their file, so a reader of one tile skips the rest by row
    group statistics; the number of folders stays small (at 256 x 64 pixels a side about four
    thousand for 1e12 pixels).  ``max_pixels``, if given, refuses larger exports; the pixels
    are then counted on a table already written, not on the plan.  A file without rows carries the
    schema, so an empty export can be read back, too.
    """
    if max_pixels is not None:
        df = cut_lineage(df)
        n = df.count()
        if n > max_pixels:
            raise ValueError(f"export of {n} pixels exceeds max_pixels={max_pixels:g}")
    tiled = (df.withColumn("tile_row", F.floor(F.col("row") / tile)).withColumn("tile_col", F.floor(F.col("col") / tile))
             .withColumn("block_row", F.floor(F.col("tile_row") / tiles_per_folder))
             .withColumn("block_col", F.floor(F.col("tile_col") / tiles_per_folder)))
    (tiled.repartition("tile_row", "tile_col").sortWithinPartitions("block_row", "block_col", "tile_row", "tile_col")
     .write.mode("overwrite").partitionBy("block_row", "block_col").parquet(path))
    bare = tiled.drop("block_row", "block_col").schema
    (tiled.sparkSession.createDataFrame([], bare).coalesce(1)
     .write.mode("append").parquet(f"{path}/block_row=0/block_col=0"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)
