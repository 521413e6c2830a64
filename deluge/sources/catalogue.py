"""Image collections on disk: a scene catalogue beside an observation table partitioned for pruning.

Layout below one folder:

* ``scenes``  one row per scene: id, time, footprint, and what the collection's kind adds (bands, cloud
  probability, mode, polarisations), with the partition (``month``, ``tile``) its observations lie in;
* ``obs``     one row per scene and pixel, in folders ``month=yyyy-MM/tile=<x>_<y>``; the tile is the square of
  ``tile_size`` units that holds the centre of the scene's footprint.  Where that makes more than ``FOLDERS``
  folders, squares are twice as wide, and so on: a folder then grows with the collection, not their number.

Filters on time, footprint and properties are answered by the catalogue.  The scenes that pass are joined
with the observations on (month, tile, scene_id): their partitions become a dynamic filter of
the scan, so folders of other months and tiles are never listed or opened.  Both tables are read with
explicit schemas, so opening a collection looks at no file.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import collection as C
from ..session import cut_lineage

_SCENE = "scene_id long, ts timestamp_ntz, minx double, miny double, maxx double, maxy double"
_PLACE = "month string, tile string"
#: Columns of the scenes and the observations of each kind of collection.
KINDS = {
    "optical": (f"{_SCENE}, band_names array<string>, {_PLACE}",
                f"scene_id long, row int, col int, ts timestamp_ntz, B3 double, B4 double, B8 double, B11 double, B12 double, {_PLACE}"),
    "cloud": (f"{_SCENE}, {_PLACE}", f"scene_id long, row int, col int, ts timestamp_ntz, probability int, {_PLACE}"),
    "radar": (f"{_SCENE}, mode string, pols array<string>, {_PLACE}",
              f"scene_id long, row int, col int, ts timestamp_ntz, VV double, {_PLACE}"),
}
#: Scenes (three narrow columns each, some 50 bytes) that are still broadcast to the scan.
SCENES_BROADCAST = 1_000_000
#: Folders of observations aimed at, at most; tiles widen up to 2^LEVELS times for that.
FOLDERS, LEVELS = 1024, 40


def _widening(placed: DataFrame) -> int:
    """Doublings of the tiles (``month``, ``_tx``, ``_ty``) after which there are at most ``FOLDERS`` folders, about."""
    levels = range(LEVELS + 1)
    folder = lambda k: F.xxhash64("month", F.shiftright("_tx", k), F.shiftright("_ty", k))
    n = placed.agg(*[F.approx_count_distinct(folder(k)).alias(str(k)) for k in levels]).first()
    return next((k for k in levels if n[k] <= FOLDERS), LEVELS)


def write_collection(scenes: DataFrame, obs: DataFrame, path: str, kind: str, tile_size: float) -> None:
    """Write scenes (id, time, properties) and their observations in the layout above.

    Footprints are those of the observations' pixels (x = col, y = row) unless the scenes carry them; a scene without
    observations and footprint is left out.  Observations without a scene are left out, too.
    Scenes must be unique by id.
    """
    if not {"minx", "miny", "maxx", "maxy"} <= set(scenes.columns):
        boxes = obs.groupBy("scene_id").agg(
            F.min("col").cast("double").alias("minx"), F.min("row").cast("double").alias("miny"),
            F.max("col").cast("double").alias("maxx"), F.max("row").cast("double").alias("maxy"))
        scenes = scenes.join(boxes, "scene_id")
    centre = [F.floor((F.col(a) + F.col(b)) / 2 / tile_size).alias(c) for a, b, c in (("minx", "maxx", "_tx"), ("miny", "maxy", "_ty"))]
    scenes = cut_lineage(scenes.select("*", F.date_format("ts", "yyyy-MM").alias("month"), *centre))
    k = _widening(scenes)
    scenes = scenes.withColumn("tile", F.concat_ws("_", *[F.shiftright(c, k).cast("string") for c in ("_tx", "_ty")]))
    schemas = [SparkSession.active().createDataFrame([], ddl).schema for ddl in KINDS[kind]]
    shaped = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas[0]]
    scenes.select(*shaped).write.mode("overwrite").parquet(f"{path}/scenes")
    placed = scenes.sparkSession.read.schema(schemas[0]).parquet(f"{path}/scenes").select("scene_id", "ts", "month", "tile")
    rows = obs.drop("ts", "month", "tile").join(placed, "scene_id").select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas[1]])
    # By range, not by hash: a partition that holds a large share of the rows is cut by scene.
    (rows.repartitionByRange("month", "tile", "scene_id").sortWithinPartitions("month", "tile", "scene_id", "row", "col")
     .write.mode("overwrite").partitionBy("month", "tile").parquet(f"{path}/obs"))


@dataclass(frozen=True)
class Collection:
    """Scenes and, lazily, the observations of the scenes that are left."""

    scenes: DataFrame
    obs: DataFrame

    def filter_date(self, start: str, end: str) -> Collection:
        """Scenes in [start, end); their months also bound the folders of the observations."""
        kept = C.filter_date(self.scenes, start, end)
        return replace(self, scenes=kept, obs=self.obs.where(F.col("month").between(start[:7], end[:7])))

    def filter_bounds(self, aoi: Sequence[float] | None) -> Collection:
        """Scenes whose footprint touches the box."""
        return replace(self, scenes=C.filter_bounds(self.scenes, aoi))

    def filter_bands(self, required: Sequence[str]) -> Collection:
        """Scenes that carry every band named."""
        return replace(self, scenes=C.valid_scenes(self.scenes, required))

    def filter_eq(self, column: str, value) -> Collection:
        return replace(self, scenes=C.filter_eq(self.scenes, column, value))

    def filter_contains(self, column: str, value) -> Collection:
        return replace(self, scenes=C.filter_list_contains(self.scenes, column, value))

    def size(self) -> int:
        return self.scenes.count()

    def observations(self, properties: Sequence[str] = ()) -> DataFrame:
        """Observations of the scenes left, with scene ``properties`` as further columns.

        The scenes are broadcast only up to ``SCENES_BROADCAST`` of them (counted on the
        catalogue); beyond that they are joined by shuffle and months still prune by ``filter_date``.
        """
        kept = self.scenes.select("scene_id", "month", "tile", *properties)
        if kept.limit(SCENES_BROADCAST + 1).count() <= SCENES_BROADCAST:
            kept = F.broadcast(kept)
        return self.obs.join(kept, ["month", "tile", "scene_id"]).drop("month", "tile")


def open_collection(spark: SparkSession, path: str, kind: str) -> Collection:
    scenes, obs = (spark.createDataFrame([], ddl).schema for ddl in KINDS[kind])
    return Collection(spark.read.schema(scenes).parquet(f"{path}/scenes"), spark.read.schema(obs).parquet(f"{path}/obs"))
