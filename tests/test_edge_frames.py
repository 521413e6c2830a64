"""Hand-made edge frames from FIXTURES.md section 3."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from deluge.config import FloodSettings, ZoneSettings
from deluge.operators.composite import assign_months
from deluge.plans.flood_map import FloodInputs, FloodMap
from deluge.plans.zone_gap import ZoneGap, validate

S = FloodSettings(pre_start="2020-01-01", pre_end="2023-12-31", post_start="2024-01-01",
                  post_end="2024-12-31", aoi=None, tile_size=32)


def _inputs(spark, prob, obs_days=("2021-03-05", "2024-06-01"), scenes=True):
    rows = []
    for i, d in enumerate(obs_days):
        for r in range(3):
            for c in range(3):
                rows.append((i, r, c, dt.datetime.fromisoformat(d), 1000.0, 900.0, 500.0, 300.0, 200.0))
    obs = spark.createDataFrame(rows, "scene_id long, row int, col int, ts timestamp_ntz, "
                                      "B3 double, B4 double, B8 double, B11 double, B12 double")
    if not scenes:
        obs = obs.where("false")
    sc = spark.createDataFrame([(i, ["B3", "B4", "B8", "B11", "B12"]) for i in range(len(obs_days))],
                               "scene_id long, band_names array<string>")
    cl = spark.createDataFrame([(i, prob) for i in range(len(obs_days))], "scene_id long, probability int")
    s1 = spark.createDataFrame([(r, c, dt.datetime(2024, 5, 1), -20.0, "IW", ["VV"]) for r in range(3) for c in range(3)],
                               "row int, col int, ts timestamp_ntz, VV double, mode string, pols array<string>")
    px = spark.createDataFrame([(r, c, 10.0, 10, 0) for r in range(3) for c in range(3)],
                               "row int, col int, elevation double, Map int, seasonality int")
    return FloodInputs(obs, sc, cl, s1, px)


def test_month_tail_leak(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 15),), (dt.datetime(2023, 12, 31),)], "ts timestamp_ntz")
    periods = [("pre", S.pre_start, S.pre_end), ("post", S.post_start, S.post_end)]
    got = sorted((r.ts.day, r.period, r.k) for r in assign_months(df, periods).collect())
    assert got == [(15, "post", 0), (15, "pre", 48), (31, "pre", 47)]


def test_all_masked_is_null_not_zero(spark):
    fm = FloodMap(_inputs(spark, prob=90), S)
    rows = fm.stack.select("B3_pre", "B3_post").collect()
    assert len(rows) == 9 and all(r.B3_pre is None and r.B3_post is None for r in rows)
    assert fm.counts.first().n_pre == 1  # the month exists, only its pixels are masked


def test_empty_collection_gives_zero_image(spark):
    fm = FloodMap(_inputs(spark, prob=10, scenes=False), S)
    rows = fm.stack.select("B3_pre", "B8_post").collect()
    assert all(r.B3_pre == 0.0 and r.B8_post == 0.0 for r in rows)
    assert all(r.ndwi_pre is None for r in fm.indices.select("ndwi_pre").collect())  # 0/0 is masked


def test_clear_scene_composites(spark):
    fm = FloodMap(_inputs(spark, prob=10), S)
    r = fm.change.where("row = 1 and col = 1").first()
    assert abs(r.B3_pre - 0.1) < 1e-12 and r.s1_water == 1 and r.combined_flood == 1


def _preds(spark, rows):
    return spark.createDataFrame(rows, "`system:index` string, flood_predicted int, `.geo` string")


def test_empty_predictions_raise_and_zero_percentage(spark):
    empty = _preds(spark, [])
    with pytest.raises(ValueError):
        validate(empty)
    with pytest.raises(ValueError):
        validate(empty.drop(".geo"))
    rep = ZoneGap(empty, [], ZoneSettings()).report(with_date=False).first()
    assert rep.total_areas_analyzed == 0 and rep.flood_percentage == 0.0 and rep.fema_zones_count == 0


def test_zones_absent_all_flooded_outside(spark):
    p = _preds(spark, [("a", 1, '{"type":"Point","coordinates":[1,1]}'),
                       ("b", 0, '{"type":"Point","coordinates":[2,2]}'),
                       ("c", 1, '{"type":"Point","coordinates":[3,3]}')])
    zg = ZoneGap(p, [], ZoneSettings())
    assert sorted(r["system:index"] for r in zg.outside.collect()) == ["a", "c"]
    rep = zg.report(with_date=False).first()
    assert rep.fema_data_available is False and rep.flooded_outside_fema_count == 2
    assert rep.flood_percentage == round(2 / 3 * 100, 2)


def test_partitioned_observations_are_pruned(spark, tmp_path):
    from deluge.operators.collection import filter_date
    from deluge.session import partition_sizing
    rows = [(dt.datetime(2020, m, 10), 2020, m) for m in range(1, 13)] + [(dt.datetime(2021, 2, 1), 2021, 2)]
    spark.createDataFrame(rows, "ts timestamp_ntz, year int, month int").write.partitionBy("year", "month").parquet(
        str(tmp_path / "obs"))
    df = filter_date(spark.read.parquet(str(tmp_path / "obs")), "2020-03-01", "2020-06-01")
    assert df.count() == 3
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "year" in plan
    conf = partition_sizing(100e12, 8, 1000)
    assert int(conf["spark.sql.shuffle.partitions"]) >= 16000


def test_zone_crs_reprojection_and_legacy_names(spark):
    from pyspark.sql import functions as F
    from deluge.functions import geometry as G
    p = _preds(spark, [("a", 1, '{"type":"Point","coordinates":[-77.0,39.0]}'),
                       ("b", 1, '{"type":"Point","coordinates":[-76.0,39.0]}')])
    x0, y0 = -77.1, 38.9
    z = spark.createDataFrame([(1, "AE", x0, y0, -76.9, 39.1)], "zone_id long, FLD_ZONE string, a double, b double, c double, d double")
    # the zone is stored in Web Mercator
    zm = z.select("zone_id", "FLD_ZONE", G.rectangle(G.mercator_x(F.col("a")), G.mercator_y(F.col("b")),
                                                    G.mercator_x(F.col("c")), G.mercator_y(F.col("d"))).alias("geom"))
    zg = ZoneGap(p, [zm], ZoneSettings(zone_crs="EPSG:3857", report_names="legacy"))
    assert [r["system:index"] for r in zg.outside.collect()] == ["b"]
    rep = zg.report(with_date=False)
    assert "model_flooded_outside_fema_count" in rep.columns and rep.first().model_flooded_outside_fema_count == 1


def test_scene_level_month_counts_match_observation_counts(spark):
    inp = _inputs(spark, prob=90, obs_days=("2021-03-05", "2021-03-20", "2022-07-01", "2024-06-01"))
    by_obs = FloodMap(inp, S).counts.first()
    scene_ts = spark.createDataFrame(inp.s2_obs.groupBy("scene_id").agg(F.min("ts").alias("ts")).collect(),
                                     "scene_id long, ts timestamp_ntz")
    inp2 = FloodInputs(inp.s2_obs, inp.s2_scene.join(scene_ts, "scene_id"), inp.s2_cloud, inp.s1_obs, inp.px_static)
    fm2 = FloodMap(inp2, S)
    by_scene = fm2.counts.first()
    assert (by_obs.n_pre, by_obs.n_post) == (by_scene.n_pre, by_scene.n_post) == (2, 1)
    plan = fm2.counts._jdf.queryExecution().executedPlan().toString()
    import re
    assert not re.search(r"\bB4#\d+", plan)  # observation band columns are never read for the guard


def test_zone_gap_job_parse_stats(spark, tmp_path):
    from deluge.plans.zone_gap import run_analysis
    p = _preds(spark, [("a", 1, '{"type":"Point","coordinates":[1,1]}'), ("b", 0, "{oops"), ("c", 1, None)])
    res = run_analysis(p, [], str(tmp_path / "out"))
    rep = res.report.first()
    assert res.parse_stats == {"success": 1, "failed": 2}
    assert rep.total_areas_analyzed == 1 and rep.flooded_outside_fema_count == 1
