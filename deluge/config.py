"""Job settings.

Fixed values below must equal the reference tool's for equal results; they are
stated plainly and together.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- fixed values (must match the reference tool) ---------------------------
REQUIRED_BANDS = ["B3", "B4", "B8", "B11", "B12"]
REFLECTANCE_SCALE = 10000.0
CLOUD_PROBABILITY_THRESHOLD = 50
EXPORT_SCALE_M = 30
NDWI_THRESHOLD = 0.30
MNDWI_THRESHOLD = 0.0
AWEI_THRESHOLD = 0.0
AWEI_EXPRESSION = "4*(GREEN-SWIR1)-(0.25*NIR+2.75*SWIR2)"
VV_THRESHOLD_DB = -17.0
MIN_COMPONENT_PIXELS = 10
URBAN_LANDCOVER_CLASS = 50
PERMANENT_WATER_SEASONALITY = 10
SAMPLES_PER_CLASS = 3000
SEED = 42
TEST_FRACTION = 0.25
CV_FOLDS = 5
RF_TREES = 200
RF_MAX_DEPTH = 12
RF_MIN_LEAF = 5
SFHA_ZONES = ["A", "AE", "AH", "AO", "AR", "A99", "V", "VE", "VO"]
ZONE_FIELD = "FLD_ZONE"
INITIAL_CRS = "EPSG:4326"
WEB_MERCATOR_CRS = "EPSG:3857"
# Report key names of the older copy of the tool (report_names="legacy").
LEGACY_REPORT_NAMES = {
    "flood_predictions_count": "model_flood_predictions_count",
    "flood_percentage": "model_flood_percentage_of_total",
    "fema_data_available": "fema_data_processed",
    "flooded_outside_fema_count": "model_flooded_outside_fema_count",
    "bbox": "area_of_interest_bbox",
    "crs": "aoi_crs",
}
EXTENT_BUFFER = 0.15
FEATURES = ["ndwi_post", "mndwi_post", "awei_post", "VV",
            "elevation", "slope", "Map", "jrc_seasonality"]
LABEL = "flood"
# Days in a month when the length of a period is turned into months.
DAYS_PER_MONTH = 30.436875
# Names of the four stage-1 outputs; the post-period start date follows.
OUTPUT_NAMES = {"flood_mask": "flood_mask_final", "samples": "FloodSamples",
                "change_map": "changeMap", "predictors": "predictors"}
# ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Grid:
    """Where pixel (row, col) lies: centre x = origin_x + (col + 0.5) * step_x, y likewise.

    The default puts pixel centres at x = col, y = row.  For a north-up raster give the
    upper-left corner and a negative ``step_y``.
    """

    origin_x: float = -0.5
    origin_y: float = -0.5
    step_x: float = 1.0
    step_y: float = 1.0
    crs: str = INITIAL_CRS


@dataclass(frozen=True)
class FloodSettings:
    """Stage-1 (flood map extraction) parameters."""

    pre_start: str = "2020-01-01"
    pre_end: str = "2023-12-31"
    post_start: str = "2024-01-01"
    post_end: str = "2024-12-31"
    cloud_threshold: int = CLOUD_PROBABILITY_THRESHOLD
    scale: float = EXPORT_SCALE_M
    grid: Grid = field(default_factory=Grid)
    # [west, south, east, north] in the grid's units, for pixels, footprints and area alike;
    # None = everything.
    aoi: tuple | None = None
    ndwi_threshold: float = NDWI_THRESHOLD
    mndwi_threshold: float = MNDWI_THRESHOLD
    awei_threshold: float = AWEI_THRESHOLD
    vv_threshold: float = VV_THRESHOLD_DB
    min_component: int = MIN_COMPONENT_PIXELS
    urban_class: int = URBAN_LANDCOVER_CLASS
    permanent_seasonality: int = PERMANENT_WATER_SEASONALITY
    samples_per_class: int = SAMPLES_PER_CLASS
    seed: int = SEED
    # Month list 0..round(diff) is inclusive of a tail month (the reference's default).
    inclusive_tail_month: bool = True
    # Save-first join keeps unmatched optical scenes (cloud probability 0) when True.
    keep_unmatched_scenes: bool = False
    # 'water' = radar water flag in samples (reference default), 'db' = raw backscatter.
    sample_vv: str = "water"
    tile_size: int = 256
    # The static layers are a stored layer of so many buckets by pixel (sources/layers.py); None = a plain table.
    buckets: int | None = None
    # Largest raster export; None = no limit (opt in, as an export quota).
    max_pixels: float | None = None


@dataclass(frozen=True)
class ZoneSettings:
    """Stage-3 (zone comparison) parameters."""

    zone_field: str = ZONE_FIELD
    sfha_zones: tuple = tuple(SFHA_ZONES)
    initial_crs: str = INITIAL_CRS
    web_mercator_crs: str = WEB_MERCATOR_CRS
    # CRS of the zone layer; predictions are reprojected to it when it differs.
    zone_crs: str = INITIAL_CRS
    # "current" or "legacy" report key names.
    report_names: str = "current"
    # Grid cell edge for the spatial join; None = derive from zone extents.
    cell_size: float | None = None
    # Zones are broadcast only when their replicated vertex count stays below this.
    broadcast_vertex_limit: int = 4_000_000


@dataclass(frozen=True)
class ModelSettings:
    trees: int = RF_TREES
    max_depth: int = RF_MAX_DEPTH
    min_leaf: int = RF_MIN_LEAF
    seed: int = SEED
    test_fraction: float = TEST_FRACTION
    folds: int = CV_FOLDS
    features: tuple = tuple(FEATURES)
    label: str = LABEL
    categorical: str = "Map"
    # Most category codes to one-hot; None = as many as there are.
    max_codes: int | None = None


# Dates used against the driver's TPC-H-style tables (ship dates 1992-1998+).
FIXTURE_SETTINGS = FloodSettings(
    pre_start="1995-01-01", pre_end="1998-12-31",
    post_start="1999-01-01", post_end="1999-12-31",
    aoi=None, tile_size=64,
)
