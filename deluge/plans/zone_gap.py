"""Zone-gap analysis (stage 3): predicted floods outside the regulatory flood zones.

predictions (.geo text, flood_predicted) --validate--> parse GeoJSON (native from_json)
  --> drop unparsable rows --> flooded rows --spatial anti-join--> zones selected by
  source fallback and zone-code filter --> report (one aggregate) and map layers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EXTENT_BUFFER, LEGACY_REPORT_NAMES, ZoneSettings
from ..functions import geometry as G
from ..operators import spatial as SP
from ..operators import zones as Z
from ..session import cut_lineage
from ..sources import sinks as SK

REQUIRED = (".geo", "flood_predicted")


def validate(df: DataFrame, required: Sequence[str] = REQUIRED) -> DataFrame:
    """Required columns present and at least one row, else ValueError."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"predictions lack the columns {missing}")
    if df.isEmpty():
        raise ValueError("there are no predictions")
    return df


@dataclass(frozen=True)
class Statistics:
    """What one aggregate over the parsed predictions yields."""

    success: int
    failed: int
    flooded: int
    #: minx, miny, maxx, maxy in the predictions' CRS and in that of the zones; None without a geometry.
    bounds: tuple | None
    zone_bounds: tuple | None
    #: Extents in the zones' CRS as powers of two (None: points), as ``spatial_join`` wants them.
    powers: tuple


class ZoneGap:
    def __init__(self, predictions: DataFrame, zone_sources: Sequence[DataFrame],
                 settings: ZoneSettings = ZoneSettings(), geo_col: str = ".geo"):
        self.raw = predictions
        self.sources = list(zone_sources)
        self.s = settings
        self.geo_col = geo_col

    @cached_property
    def parsed(self) -> DataFrame:
        return G.with_geometry(self.raw, F.col(f"`{self.geo_col}`"), "geometry")

    def parse_stats(self) -> DataFrame:
        return self.parsed.agg(F.count_if(F.col("geometry").isNotNull()).alias("success"),
                               F.count_if(F.col("geometry").isNull()).alias("failed"))

    @property
    def gdf(self) -> DataFrame:
        return G.keep_valid(self.parsed, "geometry")

    @cached_property
    def statistics(self) -> Statistics:
        """Parses the predictions once, into a table that everything below reads, and sums it up in one aggregate.

        Its rows are one per power of two that extents have: a few dozen whatever the data.
        """
        self.parsed = cut_lineage(self.parsed)
        own, there = G.bbox("geometry"), G.bbox("_in_zone")
        names = ("minx", "miny", "maxx", "maxy")
        d = self._in_zone_crs(self.parsed, "_in_zone").select(
            F.col("geometry").isNull().alias("bad"), (F.col("flood_predicted") == 1).alias("wet"),
            *[own[n].alias(n) for n in names], *[there[n].alias(f"z{n}") for n in names])
        extent = F.greatest(F.col("zmaxx") - F.col("zminx"), F.col("zmaxy") - F.col("zminy"))
        rows = d.groupBy("bad", SP.power(extent).alias("k")).agg(
            F.count(F.lit(1)).alias("n"), F.count_if("wet").alias("wet"),
            *[(F.min if n.startswith("min") else F.max)(p + n).alias(p + n) for p in ("", "z") for n in names]).collect()
        good = [r for r in rows if not r["bad"]]

        def box(prefix):
            known = [r for r in good if r[prefix + "minx"] is not None]
            return tuple((min if n.startswith("min") else max)(r[prefix + n] for r in known) for n in names) if known else None
        return Statistics(sum(r["n"] for r in good), sum(r["n"] for r in rows if r["bad"]), sum(r["wet"] for r in good),
                          box(""), box("z"), tuple({r["k"] for r in good}))

    @cached_property
    def zones(self) -> DataFrame:
        """Zones of the study area: sources cut to the predictions' envelope, then the first source
        that has any (later ones are not read), then its listed codes (all its codes if none is listed)."""
        if not self.sources:
            return None
        near = [Z.within_box(s, self.statistics.zone_bounds) for s in self.sources]
        return Z.filter_zone_codes(Z.first_nonempty_source(near), self.s.zone_field, self.s.sfha_zones)

    def _in_zone_crs(self, df: DataFrame, out: str = "geometry") -> DataFrame:
        """Predictions with their geometry in the zone layer's CRS (geographic and Web Mercator, either way)."""
        return df.withColumn(out, G.convert(F.col("geometry"), self.s.initial_crs, self.s.zone_crs))

    @property
    def flooded(self) -> DataFrame:
        return self.gdf.where(F.col("flood_predicted") == 1)

    @cached_property
    def outside(self) -> DataFrame:
        """Flooded rows that intersect no selected zone (all flooded rows if no zones), in their own CRS."""
        if self.zones is None:
            return self.flooded
        z = self.zones.select("geom")
        left = self._in_zone_crs(self.flooded, "_in_zone")
        return SP.spatial_join(left, z, "left_anti", left_geom="_in_zone", right_geom="geom", cell_size=self.s.cell_size,
                               broadcast_vertex_limit=self.s.broadcast_vertex_limit,
                               left_powers=self.statistics.powers).drop("_in_zone")

    def spatial_left(self) -> DataFrame:
        """Every valid prediction with each intersecting zone (NULL zone if none)."""
        z = self.zones.select("zone_id", *[c for c in (self.s.zone_field,) if c in self.zones.columns], "geom")
        return SP.spatial_join(self._in_zone_crs(self.gdf, "_in_zone"), z, "left", left_geom="_in_zone",
                               right_geom="geom", cell_size=self.s.cell_size,
                               broadcast_vertex_limit=self.s.broadcast_vertex_limit,
                               left_powers=self.statistics.powers).drop("_in_zone")

    def total_bounds(self, df: DataFrame | None = None) -> DataFrame:
        df = self.gdf if df is None else df
        bb = G.bbox("geometry")
        return df.select(*[bb[k].alias(k) for k in ("minx", "miny", "maxx", "maxy")]).agg(
            F.min("minx").alias("minx"), F.min("miny").alias("miny"),
            F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))

    def report(self, with_date: bool = True) -> DataFrame:
        """One row: counts and bounds from ``statistics``, and two counts over the selected zones and the anti-join."""
        st, spark = self.statistics, self.raw.sparkSession
        box = st.bounds or (None,) * 4
        agg = spark.range(1).select(
            F.lit(st.success).cast("long").alias("total_areas_analyzed"), F.lit(st.flooded).cast("long").alias("flood_predictions_count"),
            *[F.lit(v).cast("double").alias(n) for n, v in zip(("minx", "miny", "maxx", "maxy"), box)])
        outside = self.outside.agg(F.count(F.lit(1)).alias("flooded_outside_fema_count"))
        if self.zones is None:
            zones = spark.range(1).select(F.lit(0).cast("long").alias("fema_zones_count"))
        else:
            zones = Z.dissolved_count(self.zones)
        pct = F.coalesce(F.bround(F.try_divide(F.col("flood_predictions_count"), F.col("total_areas_analyzed"))
                                  * F.lit(100.0), 2), F.lit(0.0))
        cols = []
        if with_date:
            cols.append(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("analysis_date"))
        cols += [F.col("total_areas_analyzed"), F.col("flood_predictions_count"), pct.alias("flood_percentage"),
                 (F.col("fema_zones_count") > 0).alias("fema_data_available"), F.col("fema_zones_count"),
                 F.col("flooded_outside_fema_count"),
                 F.array("minx", "miny", "maxx", "maxy").alias("bbox"), F.lit(self.s.initial_crs).alias("crs")]
        out = agg.crossJoin(zones).crossJoin(outside).select(*cols)
        if self.s.report_names == "legacy":
            out = out.withColumnsRenamed(LEGACY_REPORT_NAMES)
        return out

    def map_layers(self) -> DataFrame:
        """Study area, zones, flooded and outside features in EPSG:3857 with a layer tag."""
        self.statistics  # from here on the predictions are a parsed table

        def layer(df, name, id_col, geom_col, crs=self.s.initial_crs):
            g = G.convert(F.col(geom_col), crs, self.s.web_mercator_crs)
            bb = G.bbox("_g")
            return (df.select(F.col(id_col).cast("string").alias("feature_id"), g.alias("_g"))
                      .select(F.lit(name).alias("layer"), "feature_id", F.col("_g.type").alias("geom_type"),
                              *[bb[k].alias(k) for k in ("minx", "miny", "maxx", "maxy")]))
        idc = "system:index"
        parts = [layer(self.gdf, "study_area", idc, "geometry")]
        if self.zones is not None:
            parts.append(layer(self.zones, "zones", "zone_id", "geom", self.s.zone_crs))
        parts += [layer(self.flooded, "flooded", idc, "geometry"), layer(self.outside, "outside", idc, "geometry")]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def map_extent(self, layers: DataFrame | None = None) -> DataFrame:
        """Projected total bounds of the study area widened by 15 % on each side."""
        lay = (self.map_layers() if layers is None else layers).where(F.col("layer") == "study_area")
        b = lay.agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"),
                    F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))
        bx = (F.col("maxx") - F.col("minx")) * EXTENT_BUFFER
        by = (F.col("maxy") - F.col("miny")) * EXTENT_BUFFER
        return b.select((F.col("minx") - bx).alias("xmin"), (F.col("maxx") + bx).alias("xmax"),
                        (F.col("miny") - by).alias("ymin"), (F.col("maxy") + by).alias("ymax"))


def prediction_summary(predictions: DataFrame, geo_col: str = ".geo") -> DataFrame:
    """Strict parse (only '{...}' JSON), valid geometries, total and flooded counts."""
    df = G.with_geometry(predictions, F.col(f"`{geo_col}`"), "geometry", strict=True)
    flooded = (F.count_if((F.col("flood_predicted") == 1) & F.col("geometry").isNotNull())
               if "flood_predicted" in predictions.columns else F.lit(None).cast("long"))
    return df.agg(F.count(F.lit(1)).alias("rows_read"),
                  F.count_if(F.col("geometry").isNotNull()).alias("valid_geometries"),
                  F.count_if(F.col("geometry").isNull()).alias("parse_errors"),
                  flooded.alias("flooded"))


@dataclass
class ZoneGapResult:
    report: DataFrame
    parse_stats: dict


def run_analysis(predictions: DataFrame, zone_sources: Sequence[DataFrame], out_dir: str,
                 settings: ZoneSettings = ZoneSettings()) -> ZoneGapResult:
    """The whole zone-gap job: validate, parse, select zones, anti-join, write outputs.

    Writes all_predictions (GeoJSON features), outside_fema (only when non-empty),
    map_layers (parquet) and analysis_report (JSON); returns the report frame and the
    parse statistics (success / failed).
    Unlike the reference, failures raise instead of being logged.
    """
    validate(predictions)
    zg = ZoneGap(predictions, zone_sources, settings)
    # Parsing, zone selection and the anti-join each run once; everything below reads tables.
    stats = zg.statistics
    if not stats.success:
        raise ValueError("no prediction has a usable geometry")
    if zg.zones is not None:
        zg.zones = cut_lineage(zg.zones)
    zg.outside = cut_lineage(zg.outside)
    keep = [F.col(f"`{c}`") for c in zg.gdf.columns if c != zg.geo_col]
    SK.write_geojson(zg.gdf.select(*keep), f"{out_dir}/all_predictions")
    if not zg.outside.isEmpty():
        SK.write_geojson(zg.outside.select(*keep), f"{out_dir}/outside_fema")
    zg.map_layers().write.mode("overwrite").parquet(f"{out_dir}/map_layers")
    report = zg.report()
    SK.write_report(report, f"{out_dir}/analysis_report")
    return ZoneGapResult(report, {"success": stats.success, "failed": stats.failed})
