import datetime as dt

from pyspark.sql import functions as F

from deluge.functions import dates as D
from deluge.functions import indices as I
from deluge.functions import masks as M
from deluge.functions import geometry as G


def test_mask_algebra_is_null_strict(spark):
    vals = [0, 1, None]
    rows = [(a, b) for a in vals for b in vals]
    df = spark.createDataFrame(rows, "a int, b int")
    out = df.select("a", "b", M.m_and(F.col("a"), F.col("b")).alias("and_"),
                    M.m_or(F.col("a"), F.col("b")).alias("or_"), M.m_not(F.col("a")).alias("not_")).collect()
    for r in out:
        if r.a is None or r.b is None:
            assert r.and_ is None and r.or_ is None
        else:
            assert r.and_ == (r.a & r.b) and r.or_ == (r.a | r.b)
        assert r.not_ == (None if r.a is None else 1 - r.a)


def test_update_mask_and_change_code(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (None, 1)], "post int, pre int")
    got = [r[0] for r in df.select(M.change_code(F.col("post"), F.col("pre"))).collect()]
    assert got == [3, 2, 1, 0, None]
    m = spark.createDataFrame([(5.0, 1), (5.0, 0), (5.0, None)], "v double, m int")
    assert [r[0] for r in m.select(M.update_mask(F.col("v"), F.col("m"))).collect()] == [5.0, None, None]


def test_normalized_difference_masks_zero_and_negative(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, -1.0), (-0.1, 0.5), (0.3, 0.1)], "a double, b double")
    got = [r[0] for r in df.select(I.normalized_difference(F.col("a"), F.col("b"))).collect()]
    assert got[0] is None and got[1] is None and got[2] is None
    assert abs(got[3] - 0.5) < 1e-12


def test_awei_expression_matches_columns(spark):
    df = spark.createDataFrame([(0.1, 0.2, 0.3, 0.4)], "B3 double, B8 double, B11 double, B12 double")
    a = df.select(I.awei_expression().alias("x")).first().x
    b = df.select(I.awei(F.col("B3"), F.col("B11"), F.col("B8"), F.col("B12"))).first()[0]
    assert abs(a - b) < 1e-12 and abs(a - (4 * (0.1 - 0.3) - (0.25 * 0.2 + 2.75 * 0.4))) < 1e-12


def test_median_even_count(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (20.0,), (None,)], "v double")
    assert df.agg(F.median("v")).first()[0] == 6.0


def test_month_count_inclusive_tail():
    assert D.month_count("2020-01-01", "2023-12-31") == 49
    assert D.month_count("2024-01-01", "2024-12-31") == 13
    assert D.month_count("1995-01-01", "1998-12-31") == 49


def test_month_offset_matches_add_months(spark):
    starts = ["1995-01-01", "1995-01-31", "1996-02-29", "1999-03-15"]
    days = [dt.datetime(1995, 1, 1) + dt.timedelta(days=d) for d in range(0, 1900, 3)]
    df = spark.createDataFrame([(d,) for d in days], "ts timestamp_ntz")
    for s in starts:
        rows = df.select("ts", D.month_offset(F.col("ts"), s).alias("k"),
                         D.month_start(s, D.month_offset(F.col("ts"), s)).alias("a"),
                         D.month_start(s, D.month_offset(F.col("ts"), s) + 1).alias("b")).collect()
        for r in rows:
            assert dt.datetime.combine(r.a, dt.time()) <= r.ts < dt.datetime.combine(r.b, dt.time())


def test_parse_geojson_edge_texts(spark):
    texts = ['{"type":"Point","coordinates":[1,2]}',
             '{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,2],[0,0]]]}',
             "{'type': 'Point', 'coordinates': [3, 4]}",
             "{'type': 'Point', 'coordinates': (5, 6)}",
             "{oops", "", None, "5", '{"type":"LineString","coordinates":[[0,0],[1,1]]}',
             '{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]]]}']
    df = spark.createDataFrame([(t,) for t in texts], "g string")
    got = G.with_geometry(df, F.col("g"), "geom").select("geom.type").collect()
    assert [r[0] for r in got] == ["Point", "Polygon", "Point", "Point", None, None, None, None, "LineString", "MultiPolygon"]
    strict = G.with_geometry(df, F.col("g"), "geom", strict=True).select("geom.type").collect()
    assert [r[0] for r in strict][:4] == ["Point", "Polygon", None, None]


def test_point_in_polygon_boundary_and_hole(spark):
    poly = ('{"type":"Polygon","coordinates":[[[0,0],[10,0],[10,10],[0,10],[0,0]],'
            '[[4,4],[6,4],[6,6],[4,6],[4,4]]]}')
    pts = [(5.0, 5.0, False), (5.0, 4.0, True), (0.0, 0.0, True), (10.0, 5.0, True), (2.0, 2.0, True),
           (11.0, 5.0, False), (4.0, 5.0, True), (-0.1, 5.0, False)]
    df = spark.createDataFrame([(poly, x, y) for x, y, _ in pts], "g string, x double, y double")
    df = G.with_geometry(df, F.col("g"), "geom")
    got = [r[0] for r in df.select(G.point_in_geometry("geom", "x", "y")).collect()]
    assert got == [e for _, _, e in pts]


def test_reproject_known_values(spark):
    import math
    df = spark.createDataFrame([(180.0, 0.0), (-77.3, 38.8), (0.0, 89.9)], "x double, y double")
    r = df.select(G.mercator_x(F.col("x")), G.mercator_y(F.col("y"))).collect()
    assert abs(r[0][0] - 20037508.342789244) < 1e-6 and abs(r[0][1]) < 1e-9
    assert abs(r[1][1] - 6378137.0 * math.log(math.tan(math.pi / 4 + math.radians(38.8) / 2))) < 1e-6
    assert abs(r[2][1] - 20037508.342789244) < 1.0  # clamped to the Mercator limit


def test_months_are_average_months():
    assert abs(D.months_between("2021-03-17", "2021-02-01") - 44 / 30.436875) < 1e-12
    # 44 days are nearer to one month than to two; 105 days are nearer to three.
    assert D.month_count("2021-02-01", "2021-03-17", inclusive_tail=False) == 1
    assert D.month_count("2021-02-01", "2021-05-17", inclusive_tail=False) == 3


def test_auc_with_one_class_and_many_rows(spark):
    from deluge.operators import metrics as MT
    one = spark.createDataFrame([(1, 0.2), (1, 0.7)], "y int, s double")
    assert MT.roc_auc_frame(one, "y", "s").first()["auc"] is None
    two = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.5), (0, 0.5)], "y int, s double")
    assert MT.roc_auc_frame(two, "y", "s").first()["auc"] == 0.875


def test_malformed_geometry_is_null_and_never_raises(spark):
    texts = ['{"type":"Polygon","coordinates":[[]]}', '{"type":"MultiPolygon","coordinates":[[]]}',
             '{"type":"Polygon","coordinates":[[[1]]]}', '{"type":"Polygon","coordinates":[[[0,0],null,[1,1],[0,0]]]}',
             '{"type":"Point","coordinates":[]}', '{"type":"LineString","coordinates":[[0,0]]}', '{"type":"GeometryCollection"}',
             '{"type":"Polygon","coordinates":[]}', '{"type":"MultiPoint","coordinates":[]}', '{"type":"Polygon"}', "[1,2]"]
    good = ["{'type': 'Polygon', 'coordinates': (((0, 0), (2, 0), (2, 2), (0, 0)),)}", "{'type': 'Point', 'coordinates': (1.5, 2.0)}",
            '{"type":"MultiPoint","coordinates":[[0,0],[2,2]]}', '{"type":"MultiLineString","coordinates":[[[0,0],[2,2]],[[1,1],[2,0]]]}',
            '{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2]]]}', '{"type":"Point","coordinates":[1,2,9]}']
    df = G.with_geometry(spark.createDataFrame([(t,) for t in texts + good], "t string"), F.col("t"), "geometry")
    bb = G.bbox("geometry")
    rows = df.select("t", F.col("geometry.type").alias("k"), bb["maxx"].alias("x"), F.size(G.edges("geometry")).alias("n"),
                     G.to_geojson(F.col("geometry")).alias("out")).collect()
    kinds = {r.t: r.k for r in rows}
    assert all(kinds[t] is None for t in texts) and all(kinds[t] for t in good)
    n = {r.t: r.n for r in rows}
    assert n[good[0]] == 3 and n[good[4]] == 3  # an open ring is closed
    again = spark.createDataFrame([(r.out,) for r in rows if r.out], "t string")
    assert len([r for r in rows if r.out]) == len(good)
    assert all(r[0] for r in G.with_geometry(again, F.col("t"), "geometry").select("geometry.type").collect())


def test_sorted_composites_equal_the_aggregates(spark):
    """Medians of monthly medians by one sort: as the two aggregates give them, with nulls, NaN and pixels over batches."""
    import random

    from deluge.operators import composite as X
    rng = random.Random(3)
    values = [None, float("nan"), -1.0, 0.0, 0.25, 1.0, 3.0, 7.5, 1e300]
    rows = [(rng.choice([None, 0, 1, -4]), rng.choice([None, 2, 0]), rng.choice(["pre", "post", "other"]), rng.randrange(3),
             rng.choice(values), rng.choice([None, 5.0])) for _ in range(400)]
    rows += [(9, 9, "pre", 1, float(i % 7), None) for i in range(60)]  # more than a batch of one pixel
    df = spark.createDataFrame(rows, "row int, col int, period string, k int, a double, b double").repartition(3, "row", "col")
    old = X.period_composite(X.monthly_median(df, ["a", "b"]), ("pre", "post"), ["a", "b"])
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "7", kept):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            new = X.pixel_composite(df, ("pre", "post"), ["a", "b"])
            assert new.schema.simpleString() == old.schema.simpleString()
            assert sorted(map(repr, new.collect())) == sorted(map(repr, old.collect()))
        assert X.pixel_composite(df.where("false"), ("pre", "post"), ["a", "b"]).collect() == []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


def test_flood_map_groups_no_observations_by_pixel_and_month(spark):
    """The composites need no aggregate per pixel and month, and months are counted on the different times."""
    from deluge.config import FIXTURE_SETTINGS
    from deluge.plans.flood_map import FloodMap, fixture_inputs
    fm = FloodMap(fixture_inputs(spark, "/root/testdata/sf0.001"), FIXTURE_SETTINGS)
    plan = fm.composite._jdf.queryExecution().executedPlan().toString()
    assert "keys=[row" not in plan and "MapInArrow" in plan
    counts = fm.counts._jdf.queryExecution().executedPlan().toString()
    explode = counts.index("Generate explode")
    assert "HashAggregate(keys=[ts" in counts[explode:]  # below it: one row per time
