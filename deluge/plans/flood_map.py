"""Flood map extraction (stage 1) as one lazily built Spark plan.

optical obs --date/AOI filter--> semi-join valid scenes --save-first--> cloud probability
  --> month tags (pre, post) --> cloud mask, drop masked --> one shuffle by pixel
  --> monthly medians --> median of monthly medians (pre and post in one aggregate)
radar obs --filters--> per-pixel median
pixel frame (static layers) <-left join-- composites, radar; empty-collection guard
  --> water indices --> 2-of-3 consensus --> change code, new water OR radar water
  --> capped connected count (halo tiles) --> urban / permanent-water masks --> flood_final
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import OUTPUT_NAMES, REQUIRED_BANDS, FloodSettings
from ..functions import geometry as G
from ..functions import indices as I
from ..functions import masks as M
from ..functions.dates import epoch_millis, month_start
from ..operators import collection as C
from ..operators import composite as X
from ..operators import neighbourhood as N
from ..operators import sampling as S
from ..session import cut_lineage
from ..sources import fixtures
from ..sources import layers as LY

PERIODS = ("pre", "post")


@dataclass
class FloodInputs:
    s2_obs: DataFrame      # scene_id, row, col, ts, B3..B12 (scaled 0-10000)
    s2_scene: DataFrame    # scene_id, band_names
    s2_cloud: DataFrame    # scene_id, probability
    s1_obs: DataFrame      # row, col, ts, VV, mode, pols
    px_static: DataFrame   # row, col, elevation, Map, seasonality (a stored layer if settings.buckets is set)


def fixture_inputs(spark: SparkSession, sf_dir: str) -> FloodInputs:
    return FloodInputs(fixtures.s2_obs(spark, sf_dir), fixtures.s2_scene(spark, sf_dir),
                       fixtures.s2_cloud(spark, sf_dir), fixtures.s1_obs(spark, sf_dir),
                       fixtures.px_static(spark, sf_dir))


class FloodMap:
    def __init__(self, inputs: FloodInputs, settings: FloodSettings = FloodSettings(),
                 materialize: bool = False):
        """``materialize=True`` checkpoints the per-pixel change stack (into the shared
        ``spark.checkpoint.dir``) so the flood mask, change map, samples and predictors
        share one computation of the composites instead of recomputing them."""
        self.inp = inputs
        self.s = settings
        self.materialize = materialize
        # With stored layers (``settings.buckets``) every shuffle by pixel goes into as many parts.
        self.by_pixel = ([settings.buckets] if settings.buckets else []) + ["row", "col"]

    @property
    def periods(self):
        s = self.s
        return [("pre", s.pre_start, s.pre_end), ("post", s.post_start, s.post_end)]

    # ---- optical collection -------------------------------------------------
    @cached_property
    def scenes_valid(self) -> DataFrame:
        return C.valid_scenes(self.inp.s2_scene)

    @cached_property
    def s2_joined(self) -> DataFrame:
        """Observations of valid scenes with their first cloud record (F1, P11, F5, J1)."""
        obs = C.filter_date(self.inp.s2_obs, self.s.pre_start, self.s.post_end)
        obs = C.clip(obs, self.s.aoi, self.s.grid)
        if {"row", "col"} <= set(self.inp.s2_cloud.columns):
            return self._with_pixel_clouds(obs)
        return obs.join(self.scene_table.select("scene_id", "probability"), "scene_id", "inner")

    def _with_pixel_clouds(self, obs: DataFrame) -> DataFrame:
        """Cloud probability as an image: the first record of each scene and pixel.

        Cloud records are cut to the observations' dates and area before they are grouped.
        """
        cloud = C.clip(self.inp.s2_cloud, self.s.aoi, self.s.grid)
        if "ts" in cloud.columns:
            cloud = C.filter_date(cloud, self.s.pre_start, self.s.post_end)
        obs = obs.join(self.scenes_valid.select("scene_id"), "scene_id", "left_semi")
        return C.save_first(obs, cloud.select("scene_id", "row", "col", "probability"), ["scene_id", "row", "col"],
                            order=["probability"], outer=self.s.keep_unmatched_scenes)

    @cached_property
    def scene_table(self) -> DataFrame:
        """Valid scenes with their first cloud record, resolved on the (small) scene table,
        so each observation probes one scene-level table once.  Scene time and footprint
        filters apply here when the scene table carries ``ts`` / a bbox."""
        sc = self.scenes_valid
        if "ts" in sc.columns:
            sc = C.filter_date(sc, self.s.pre_start, self.s.post_end)
        if {"minx", "miny", "maxx", "maxy"} <= set(sc.columns):
            sc = C.filter_bounds(sc, self.s.aoi)
        keep = ["scene_id"] + (["ts"] if "ts" in sc.columns else [])
        cloud = self.inp.s2_cloud
        if "ts" in cloud.columns:
            cloud = C.filter_date(cloud, self.s.pre_start, self.s.post_end)
        if {"minx", "miny", "maxx", "maxy"} <= set(cloud.columns):
            cloud = C.filter_bounds(cloud, self.s.aoi)
        cloud = cloud.select("scene_id", "probability")
        return C.save_first(sc.select(*keep), cloud, ["scene_id"], order=["probability"],
                            outer=self.s.keep_unmatched_scenes)

    @cached_property
    def s2_tagged(self) -> DataFrame:
        return X.assign_months(self.s2_joined, self.periods, self.s.inclusive_tail_month)

    @cached_property
    def s2_masked(self) -> DataFrame:
        masked = C.cloud_mask(self.s2_tagged, self.s.cloud_threshold)
        return C.drop_fully_masked(masked).select("row", "col", "period", "k", *REQUIRED_BANDS)

    @cached_property
    def s2_by_pixel(self) -> DataFrame:
        # The one wide shuffle of stage 1: months, periods and the join with the pixel frame all
        # group by pixel.  A pixel has one observation per scene, so no key outgrows a task.
        return self.s2_masked.repartition(*self.by_pixel)

    @cached_property
    def monthly(self) -> DataFrame:
        return X.monthly_median(self.s2_by_pixel)

    def monthly_with_metadata(self) -> DataFrame:
        """Monthly composites with the start of their window in epoch milliseconds, its year and month."""
        starts = {name: start for name, start, _ in self.periods}
        first = None
        for name, start in starts.items():
            first = F.when(F.col("period") == name, month_start(start, F.col("k"))) if first is None else \
                first.when(F.col("period") == name, month_start(start, F.col("k")))
        return self.monthly.withColumn("_first", first).withColumns({
            "time_start": epoch_millis(F.col("_first")), "year": F.year("_first"), "month": F.month("_first")}).drop("_first")

    @cached_property
    def composite(self) -> DataFrame:
        # The same as X.period_composite(self.monthly, PERIODS), without an aggregate per pixel and month.
        return X.pixel_composite(self.s2_by_pixel, PERIODS).repartition(*self.by_pixel)

    @cached_property
    def counts(self) -> DataFrame:
        """One row: n_pre, n_post (months with images), n_s1 (radar observations).

        With one timestamp per scene (real scene metadata) the months are counted on the
        scene table; otherwise they are derived from the observations (two narrow columns).
        """
        if "ts" in self.scene_table.columns:
            tagged = X.assign_months(self.scene_table.select("ts"), self.periods, self.s.inclusive_tail_month)
        else:  # a month follows from the time alone
            tagged = X.assign_months(self.s2_joined.select("ts").distinct(), self.periods, self.s.inclusive_tail_month)
        return X.month_counts(tagged, PERIODS).crossJoin(
            self.s1_filtered.agg(F.count(F.lit(1)).alias("n_s1")))

    # ---- radar ----------------------------------------------------------------
    @cached_property
    def s1_filtered(self) -> DataFrame:
        s1 = C.filter_date(self.inp.s1_obs, self.s.post_start, self.s.post_end)
        s1 = C.filter_list_contains(s1, "pols", "VV")
        s1 = C.filter_eq(s1, "mode", "IW")
        return C.clip(s1, self.s.aoi, self.s.grid).select("row", "col", "ts", "VV")

    @cached_property
    def sar(self) -> DataFrame:
        s1 = self.s1_filtered
        return X.temporal_median(s1.repartition(*self.by_pixel) if self.s.buckets else s1, "VV")

    # ---- pixel stack ------------------------------------------------------------
    @cached_property
    def static_layers(self) -> DataFrame:
        return C.clip(self.inp.px_static, self.s.aoi, self.s.grid).select("row", "col", "elevation", "Map", "seasonality")

    @cached_property
    def pixels(self) -> DataFrame:
        # Hash-partitioned by pixel: the joins with the per-pixel composites need this
        # distribution anyway, and everything downstream (indices, scoring) inherits the
        # parallelism whatever the source file layout.  A stored layer has it already.
        return self.static_layers if self.s.buckets else self.static_layers.repartition("row", "col")

    @cached_property
    def stack(self) -> DataFrame:
        stacked = (self.pixels.join(self.composite, ["row", "col"], "left")
                   .join(self.sar, ["row", "col"], "left"))
        return X.guard_empty(stacked, self.counts, {
            "n_pre": [f"{b}_pre" for b in REQUIRED_BANDS],
            "n_post": [f"{b}_post" for b in REQUIRED_BANDS],
            "n_s1": ["VV"]})

    @cached_property
    def indices(self) -> DataFrame:
        cols = {}
        for p in PERIODS:
            g, n, s1, s2 = (F.col(f"{b}_{p}") for b in ("B3", "B8", "B11", "B12"))
            cols[f"ndwi_{p}"] = I.ndwi(g, n)
            cols[f"mndwi_{p}"] = I.mndwi(g, s1)
            cols[f"awei_{p}"] = I.awei_expression(suffix=f"_{p}")  # expression string, bound bands
        cols["s1_water"] = M.lt(F.col("VV"), self.s.vv_threshold)
        return self.stack.withColumns(cols)

    @cached_property
    def water(self) -> DataFrame:
        s = self.s
        cols = {f"water_{p}": M.consensus(M.gt(F.col(f"ndwi_{p}"), s.ndwi_threshold),
                                          M.gt(F.col(f"mndwi_{p}"), s.mndwi_threshold),
                                          M.gt(F.col(f"awei_{p}"), s.awei_threshold)) for p in PERIODS}
        return self.indices.withColumns(cols)

    @cached_property
    def change(self) -> DataFrame:
        post, pre = F.col("water_post"), F.col("water_pre")
        flood_map = M.m_and(post, M.m_not(pre))
        out = self.water.withColumns({
            "change": M.change_code(post, pre),
            "flood_map": flood_map,
            "combined_flood": M.m_or(flood_map, F.col("s1_water")),
        })
        return self._kept(out)

    def _kept(self, df: DataFrame) -> DataFrame:
        """``df`` written once when outputs share it: as a stored layer, or as a plain table."""
        if not self.materialize:
            return df
        return LY.write_layer(df, self.s.buckets) if self.s.buckets else cut_lineage(df)

    # ---- cleaning -------------------------------------------------------------------
    @cached_property
    def connected(self) -> DataFrame:
        """(row, col, combined_flood, count, Map, seasonality) for valid pixels."""
        out = N.connected_pixel_count(self.change, "combined_flood", self.s.min_component,
                                      tile=self.s.tile_size, payload=("Map", "seasonality"))
        return self._kept(out)

    @cached_property
    def flood_final(self) -> DataFrame:
        """(row, col, flood) for pixels that survive size, urban and permanent-water masks."""
        s = self.s
        v = M.update_mask(F.col("combined_flood"), M.gte(F.col("count"), s.min_component))
        v = M.update_mask(v, M.m_not(M.eq(F.col("Map"), s.urban_class)))
        v = M.update_mask(v, M.m_not(M.gte(F.col("seasonality"), s.permanent_seasonality)))
        return self.connected.select("row", "col", v.alias("flood")).where(F.col("flood").isNotNull())

    @cached_property
    def slope(self) -> DataFrame:
        # Its own neighbour shuffle re-keys the rows, so it starts from the unpartitioned layer.
        out = N.slope_degrees(self.static_layers, "elevation", dx=self.s.scale, dy=self.s.scale, tile=self.s.tile_size)
        return out.repartition(*self.by_pixel) if self.s.buckets else out

    # ---- ML inputs --------------------------------------------------------------------
    @cached_property
    def sample_bands(self) -> DataFrame:
        """Every pixel valid in all nine sample bands (stratifiedSample drops nulls)."""
        vv = F.col("s1_water") if self.s.sample_vv == "water" else F.col("VV")
        bands = (self.change.join(self.slope, ["row", "col"], "left")
                 .select("row", "col", "ndwi_post", "mndwi_post", "awei_post", vv.cast("double").alias("VV"),
                         "elevation", "slope", "Map", F.col("seasonality").alias("jrc_seasonality")))
        joined = self.flood_final.join(bands, ["row", "col"], "inner")
        return C.dropna_any(joined)

    @cached_property
    def samples(self) -> DataFrame:
        """Stratified sample, up to ``samples_per_class`` per class, with a point geometry."""
        picked = S.stratified_sample(self.sample_bands, "flood", self.s.samples_per_class, self.s.seed,
                                     order_cols=("row", "col"))
        return picked.select(
            F.concat_ws("_", F.col("row").cast("string"), F.col("col").cast("string")).alias("system:index"),
            "flood", "ndwi_post", "mndwi_post", "awei_post", "VV", "elevation", "slope", "Map",
            "jrc_seasonality", G.to_geojson(G.point(*C.pixel_centre(self.s.grid))).alias(".geo"))

    @cached_property
    def predictors(self) -> DataFrame:
        """Eight float predictor bands over every pixel (raw radar dB in ``VV``)."""
        # From ``change`` (it carries every index column) so a checkpointed stack is reused.
        base = self.change.join(self.slope, ["row", "col"], "left")
        return base.select(
            "row", "col",
            *[F.col(c).cast("float").alias(c) for c in
              ("ndwi_post", "mndwi_post", "awei_post", "VV", "elevation", "slope", "Map")],
            F.col("seasonality").cast("float").alias("jrc_seasonality"),
            G.to_geojson(G.point(*C.pixel_centre(self.s.grid))).alias(".geo"))

    # ---- exports (K5-K8, K10) ----------------------------------------------------------
    def export(self, out_dir: str) -> dict[str, str]:
        """Write the four stage-1 outputs, named by the post-period start date.

        With ``materialize=True`` the four exports share one computation of the composites;
        without it each computes its own.
        """
        from ..functions.dates import compact_date
        from ..sources import sinks as SK
        tag = compact_date(self.s.post_start)
        paths = {k: f"{out_dir}/{name}_{tag}" for k, name in OUTPUT_NAMES.items()}
        SK.write_raster(self.flood_final, paths["flood_mask"], self.s.tile_size, self.s.max_pixels)
        SK.write_csv(self.samples, paths["samples"])
        SK.write_raster(self.change.select("row", "col", "change"), paths["change_map"], self.s.tile_size,
                        self.s.max_pixels)
        SK.write_raster(self.predictors.drop(".geo"), paths["predictors"], self.s.tile_size, self.s.max_pixels)
        return paths

    # ---- statistics (Q6) -------------------------------------------------------------
    def run_statistics(self) -> DataFrame:
        aoi = self.s.aoi
        area = G.sphere_rectangle_area_km2(*aoi) if aoi else None
        sizes = self.counts
        scenes = self.s2_joined.agg(F.count_distinct("scene_id").alias("s2_images"))
        s1_images = self.s1_filtered.agg(F.count_distinct("ts").alias("s1_images"))
        return (sizes.crossJoin(scenes).crossJoin(s1_images)
                .select(F.lit(area).cast("double").alias("aoi_area_km2"), "s2_images",
                        F.col("n_pre").alias("pre_months"), F.col("n_post").alias("post_months"), "s1_images"))
