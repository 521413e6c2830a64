import json
import uuid

import pytest
from pyspark.sql import functions as F

from deluge.config import ModelSettings
from deluge.operators import ml as ML
from deluge.session import output_root
from deluge.sources import files as FI
from deluge.sources import sinks as SK


def test_csv_keeps_quoted_geojson_whole(spark):
    geo = '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}'
    df = spark.createDataFrame([("a", geo, 1)], "`system:index` string, `.geo` string, flood_predicted int")
    path = f"{output_root(spark)}/csv-{uuid.uuid4().hex}"
    SK.write_csv(df, path)
    back = FI.read_csv(spark, path, df.schema).collect()
    assert back[0][".geo"] == geo


def test_raster_export_guard(spark):
    df = spark.createDataFrame([(0, 0, 1), (0, 1, 2)], "row int, col int, change int")
    with pytest.raises(ValueError):
        SK.write_raster(df, f"{output_root(spark)}/r-{uuid.uuid4().hex}", max_pixels=1)


def test_zone_feature_scan(spark, tmp_path):
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"FLD_ZONE": "AE"},
         "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]}}]}
    p = tmp_path / "zones.json"
    p.write_text(json.dumps(fc))
    z = FI.read_zone_features(spark, str(p), collection=True).collect()
    assert z[0].FLD_ZONE == "AE" and z[0].geom.type == "Polygon"


def test_one_hot_unseen_code_is_zero(spark):
    df = spark.createDataFrame([(10,), (50,), (None,)], "Map int")
    out = ML.align(ML.one_hot(df, "Map", [10, 20]), ["Map_10", "Map_20", "Map_30"]).collect()
    assert [tuple(r) for r in out] == [(1.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]


def test_forest_quality_on_flood_samples(spark):
    from deluge.config import FIXTURE_SETTINGS
    from deluge.operators import metrics as MT
    from deluge.plans.flood_map import FloodMap, fixture_inputs
    fm = FloodMap(fixture_inputs(spark, "/root/testdata/sf0.01"), FIXTURE_SETTINGS, materialize=True)
    ms = ModelSettings(trees=50)
    res = ML.train(fm.samples, ms)
    auc = MT.roc_auc(res.test_scored, "flood", "flood_probability")
    assert auc > 0.8
    path = f"{output_root(spark)}/m-{uuid.uuid4().hex}"
    SK.save_model(res.model, path)
    again = ML.score(FI.load_model(path), res.test).select("flood_probability").collect()
    first = res.test_scored.select("flood_probability").collect()
    assert sorted(r[0] for r in again) == sorted(r[0] for r in first)


def test_stream_scoring_matches_batch(spark):
    from deluge.config import FIXTURE_SETTINGS
    from deluge.plans.flood_map import FloodMap, fixture_inputs
    from deluge.streaming import score_stream
    fm = FloodMap(fixture_inputs(spark, "/root/testdata/sf0.01"), FIXTURE_SETTINGS, materialize=True)
    res = ML.train(fm.samples, ModelSettings(trees=20))
    root = f"{output_root(spark)}/stream-{uuid.uuid4().hex}"
    preds = fm.predictors
    preds.write.parquet(f"{root}/in")
    q = score_stream(spark, res.model, f"{root}/in", preds.schema, f"{root}/out", f"{root}/ckpt")
    q.awaitTermination(300)
    got = spark.read.parquet(f"{root}/out")
    assert got.count() == preds.count()
    batch = ML.score(res.model, spark.read.parquet(f"{root}/in"))
    assert got.select("row", "col", "flood_predicted").exceptAll(batch.select("row", "col", "flood_predicted")).count() == 0


def test_calibrated_model_save_load(spark):
    from deluge.config import FIXTURE_SETTINGS
    from deluge.plans.flood_map import FloodMap, fixture_inputs
    fm = FloodMap(fixture_inputs(spark, "/root/testdata/sf0.01"), FIXTURE_SETTINGS, materialize=True)
    res = ML.train(fm.samples, ModelSettings(trees=20))
    iso = ML.fit_calibrator(res.model, res.train, "flood")
    path = f"{output_root(spark)}/mc-{uuid.uuid4().hex}"
    ML.save(res.model, path, calibrator=iso)
    model, cal = ML.load(path, calibrated=True)
    a = ML.score(model, res.test, calibrator=cal).select("system:index", "flood_probability").collect()
    b = ML.score(res.model, res.test, calibrator=iso).select("system:index", "flood_probability").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert all(0.0 <= r.flood_probability <= 1.0 for r in a)
