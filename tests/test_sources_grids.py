import pytest
from pyspark.sql import functions as F

from deluge.config import Grid
from deluge.functions import geometry as G
from deluge.operators import regrid as RG
from deluge.operators import zones as Z
from deluge.plans.zone_gap import ZoneGap
from deluge.config import ZoneSettings
from deluge.sources import catalogue as CAT
from deluge.sources import fixtures
from deluge.sources import sinks as SK

from .conftest import SF001
from .test_spatial_zones import _zones


# --- collections -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def optical(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("collection"))
    CAT.write_collection(fixtures.collection_scenes(spark, SF001), fixtures.collection_pixels(spark, SF001), path, "optical", 10.0)
    return path


def test_a_collection_is_opened_without_reading(spark, optical):
    c = CAT.open_collection(spark, optical, "optical")
    assert c.scenes.schema == spark.createDataFrame([], CAT.KINDS["optical"][0]).schema
    assert c.size() == fixtures.collection_pixels(spark, SF001).select("scene_id").distinct().count()
    assert c.observations().count() == fixtures.collection_pixels(spark, SF001).count()


def test_filters_prune_folders_of_the_observations(spark, optical):
    c = CAT.open_collection(spark, optical, "optical").filter_bounds((0, 0, 4, 1)).filter_bands(["B3", "B12"])
    obs = c.observations()
    plan = obs._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    scenes = {r.scene_id for r in c.scenes.collect()}
    assert {r.scene_id for r in obs.collect()} == scenes and 0 < len(scenes) < CAT.open_collection(spark, optical, "optical").size()
    dated = CAT.open_collection(spark, optical, "optical").filter_date("1996-02-01", "1996-03-01")
    text = dated.observations()._jdf.queryExecution().executedPlan().toString()
    assert "month" in text.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert all(r.ts.strftime("%Y-%m") == "1996-02" for r in dated.observations().collect())


def test_a_collection_without_scenes(spark, optical, monkeypatch):
    none = CAT.open_collection(spark, optical, "optical").filter_date("1970-01-01", "1970-02-01")
    assert none.size() == 0 and none.observations().count() == 0
    monkeypatch.setattr(CAT, "SCENES_BROADCAST", 1)
    assert CAT.open_collection(spark, optical, "optical").observations().count() == fixtures.collection_pixels(spark, SF001).count()


def test_folders_stay_few_where_scenes_spread(spark, tmp_path, monkeypatch):
    """Scenes of one month, far apart: tiles widen until the folders are few, and no row is lost."""
    monkeypatch.setattr(CAT, "FOLDERS", 20)
    obs = spark.range(900).select(F.col("id").alias("scene_id"), (F.col("id") % 30 * 100 - 1500).cast("int").alias("row"),
                                  (F.floor(F.col("id") / 30) * 100).cast("int").alias("col"), *[F.lit(1.0).alias(b) for b in ("B3", "B4", "B8", "B11", "B12")])
    scenes = obs.select("scene_id", F.expr("timestamp_ntz'1996-02-03'").alias("ts"), F.array(F.lit("B3")).alias("band_names"))
    CAT.write_collection(scenes, obs, str(tmp_path), "optical", 10.0)
    assert 1 < len(list(tmp_path.glob("obs/month=*/tile=*"))) <= 25
    c = CAT.open_collection(spark, str(tmp_path), "optical")
    assert c.observations().count() == 900
    assert {r.scene_id for r in c.filter_bounds((0, -1500, 100, -1400)).observations().collect()} == {0, 1, 30, 31}


# --- grids -----------------------------------------------------------------------------------------------------------


def _layer(spark, rows):
    return spark.createDataFrame(rows, "row int, col int, v double")


def test_regridding_to_the_same_grid_changes_nothing(spark):
    rows = [(r, c, None if (r, c) == (1, 1) else float(r * 10 + c)) for r in range(3) for c in range(3)]
    g = Grid(5.0, 7.0, 2.0, -3.0)
    for f in (RG.nearest, RG.area_mean, RG.bilinear):
        assert sorted(map(tuple, f(_layer(spark, rows), g, g, ["v"]).collect()), key=repr) == sorted(rows, key=repr), f


def test_area_mean_weighs_by_overlap_and_passes_over_masked_pixels(spark):
    rows = [(0, 0, 1.0), (0, 1, 4.0), (0, 2, None), (0, 3, 10.0)]
    src, dst = Grid(0.0, 0.0, 1.0, 1.0), Grid(0.0, 0.0, 1.5, 1.0)
    got = {r.col: r.v for r in RG.area_mean(_layer(spark, rows), src, dst, ["v"]).collect()}
    assert got[0] == pytest.approx((1.0 + 0.5 * 4.0) / 1.5) and got[1] == pytest.approx(4.0) and got[2] == pytest.approx(10.0)
    strict = {r.col: r.v for r in RG.area_mean(_layer(spark, rows), src, dst, ["v"], min_share=0.6).collect()}
    assert strict[1] is None


def test_bilinear_needs_all_its_neighbours(spark):
    rows = [(r, c, float(r + 2 * c)) for r in range(4) for c in range(4) if (r, c) != (2, 2)]
    src, dst = Grid(0.0, 0.0, 1.0, 1.0), Grid(0.5, 0.5, 1.0, 1.0)
    got = {(r.row, r.col): r.v for r in RG.bilinear(_layer(spark, rows), src, dst, ["v"]).collect()}
    assert got[(0, 0)] == pytest.approx(1.5) and got[(1, 1)] is None and got[(3, 3)] is None


def test_nearest_gives_every_target_once_without_a_shuffle(spark):
    rows = [(r, c, float(r * 7 + c)) for r in range(7) for c in range(7)]
    df = RG.nearest(_layer(spark, rows), Grid(0.0, 0.0, 1.0, 1.0), Grid(-0.3, 7.1, 0.4, -0.45), ["v"])
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    out = df.collect()
    assert len(out) == len({(r.row, r.col) for r in out})
    for r in out:
        x, y = -0.3 + (r.col + 0.5) * 0.4, 7.1 - (r.row + 0.5) * 0.45
        assert r.v in {float(int(y + d) * 7 + int(x + e)) for d in (-1e-9, 1e-9) for e in (-1e-9, 1e-9)}


# --- zones and geometries ---------------------------------------------------------------------------------------------


def test_an_empty_raster_can_be_read_back(spark, tmp_path):
    df = spark.createDataFrame([], "row int, col int, flood int")
    SK.write_raster(df, str(tmp_path / "empty"))
    back = spark.read.parquet(str(tmp_path / "empty"))
    assert back.count() == 0 and {"row", "col", "flood"} <= set(back.columns)


def test_later_sources_are_not_read(spark):
    z = _zones(spark, [("A", (0.0, 0.0, 1.0, 1.0))])
    fails = z.withColumn("zone_id", F.raise_error(F.lit("read")).cast("long"))
    assert Z.first_nonempty_source([z.where("false"), z, fails]).count() == 1


COLLECTION = ('{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[9,9]},'
              '{"type":"LineString","coordinates":[[0,0],[4,0],[4,4],[0,0]]},{"type":"Polygon","coordinates":[[[20,20],[24,20],[24,24],[20,20]]]}]}')


def test_collections_of_geometries(spark):
    rows = [("c", COLLECTION), ("nested", '{"type":"GeometryCollection","geometries":[%s,{"type":"Point","coordinates":[1,2]}]}' % COLLECTION),
            ("empty", '{"type":"GeometryCollection","geometries":[]}'),
            ("bad", '{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":["x"]}]}'),
            ("python", COLLECTION.replace('"', "'"))]
    g = G.with_geometry(spark.createDataFrame(rows, "id string, t string"), F.col("t"), "geometry").drop("t")
    bb = G.bbox("geometry")
    got = {r.id: r for r in g.select("id", "geometry", *[bb[k].alias(k) for k in ("minx", "maxx")], G.to_geojson(F.col("geometry")).alias("text")).collect()}
    assert got["bad"].geometry is None and got["empty"].geometry.parts == [] and got["empty"].minx is None
    assert (got["c"].minx, got["c"].maxx) == (0.0, 24.0) == (got["python"].minx, got["python"].maxx) == (got["nested"].minx, got["nested"].maxx)
    again = G.with_geometry(spark.createDataFrame([("c", got["c"].text)], "id string, t string"), F.col("t"), "geometry").first().geometry
    assert again.parts == got["c"].geometry.parts
    from deluge.operators import spatial as SP
    p = spark.createDataFrame([("on", 9.0, 9.0), ("in", 23.0, 21.0), ("ring", 3.0, 1.0), ("line", 4.0, 2.0)], "pid string, x double, y double").select(
        "pid", G.point(F.col("x"), F.col("y")).alias("geom"))
    hits = {(r.id, r.pid) for r in SP.spatial_join(g, p, "inner", left_geom="geometry").collect() if r.id == "c"}
    assert hits == {("c", "on"), ("c", "in"), ("c", "line")}  # a closed line has no area
    back = {(r.pid, r.id) for r in SP.spatial_join(p, g, "inner", right_geom="geometry").collect() if r.id == "c"}
    assert back == {(b, a) for a, b in hits}


@pytest.mark.parametrize("initial, zone", [("EPSG:3857", "EPSG:4326"), ("EPSG:4326", "EPSG:3857"), ("EPSG:3857", "EPSG:3857"), ("EPSG:4326", "EPSG:4269")])
def test_any_pair_of_reference_systems(spark, initial, zone):
    """The same rows are outside whatever system predictions and zones come in."""
    preds, z = fixtures.predictions(spark, SF001), fixtures.zones(spark, SF001)
    want = sorted(r[0] for r in ZoneGap(preds, [z]).outside.select("system:index").collect())
    def moved(df, geom, crs):
        return df.withColumn(geom, G.convert(F.col(geom), "EPSG:4326", crs))
    text = moved(G.with_geometry(preds, F.col("`.geo`"), "_g"), "_g", initial)
    preds = text.withColumn(".geo", F.coalesce(G.to_geojson(F.col("_g")), F.col("`.geo`"))).drop("_g")
    zg = ZoneGap(preds, [moved(z, "geom", zone)], ZoneSettings(initial_crs=initial, zone_crs=zone))
    assert sorted(r[0] for r in zg.outside.select("system:index").collect()) == want


def test_unknown_reference_systems_are_refused(spark):
    with pytest.raises(ValueError, match="unsupported CRS"):
        G.convert(F.col("g"), "EPSG:4326", "EPSG:32618")


def test_the_report_parses_once(spark):
    """Everything the report needs of the predictions comes from one parsed table."""
    zg = ZoneGap(fixtures.predictions(spark, SF001), [fixtures.zones(spark, SF001)])
    plan = zg.report(with_date=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan
    st = zg.statistics
    row = zg.report(with_date=False).first()
    assert (st.success, st.flooded, list(st.bounds)) == (row.total_areas_analyzed, row.flood_predictions_count, row.bbox)


def test_a_source_without_the_zone_field_counts_whole(spark):
    """No zone field: all zones are used, as where no code is listed."""
    preds, z = fixtures.predictions(spark, SF001), fixtures.zones(spark, SF001)
    bare = ZoneGap(preds, [z.where("zone_id < 0"), z.drop("FLD_ZONE")])
    every = ZoneGap(preds, [z.withColumn("FLD_ZONE", F.lit("A"))])
    assert sorted(r[0] for r in bare.outside.select("system:index").collect()) == sorted(r[0] for r in every.outside.select("system:index").collect())
    assert "FLD_ZONE" not in bare.spatial_left().columns
