import json
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from deluge.config import FIXTURE_SETTINGS, ModelSettings
from deluge.operators import calibration as CAL
from deluge.operators import ml as ML
from deluge.operators import neighbourhood as N
from deluge.operators.graph import components
from deluge.plans.flood_map import FloodMap, fixture_inputs
from deluge.sources import files as FI
from deluge.sources import layers as LY

from .conftest import SF001


# --- components -------------------------------------------------------------------------------------------------------


def _roots(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components_of_random_graphs_chains_and_hubs(spark):
    rng = random.Random(2)
    for links in ([(rng.randrange(200), rng.randrange(200)) for _ in range(120)],
                  [(k + 1, k) for k in range(90)], [(7, k) for k in range(8, 60)] + [(3, 3)], []):
        got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert got == _roots(links)


@pytest.mark.parametrize("cap, tile", [(None, 4), (None, 64), (9, 4), (40, 5)])
def test_component_sizes_over_tiles(spark, cap, tile):
    rng = np.random.default_rng(tile)
    grid = rng.random((23, 31)) < 0.62
    present = rng.random(grid.shape) < 0.95
    rows = [(int(r), int(c), int(grid[r, c]), int(r * c)) for r, c in zip(*np.nonzero(present))]
    rows.append((2, 40, None, 0))
    df = spark.createDataFrame(rows, "row int, col int, v int, p int")
    want = N.component_sizes(grid.astype(int), present)
    got = N.connected_pixel_count_any(df, "v", cap, tile, ("p",)).collect()
    assert len(got) == present.sum()
    for r in got:
        assert r["count"] == (want[r.row, r.col] if cap is None else min(cap, want[r.row, r.col])) and r.p == r.row * r.col
    if cap is not None:  # the halo form, where it goes, and its way out agree
        again = N.connected_pixel_count(df, "v", cap, tile).select("row", "col", "count").collect()
        assert {tuple(r) for r in again} == {(r.row, r.col, r["count"]) for r in got}


# --- stored layers ----------------------------------------------------------------------------------------------------


def _scan_parts(plan):
    """The lines of a plan between a scan of the stored layer and its first join."""
    return [line for line in plan.splitlines() if "layer_" in line or "Exchange" in line or "Join" in line]


def test_layers_of_one_bucketing_join_without_an_exchange(spark, tmp_path):
    df = fixture_inputs(spark, SF001).px_static
    a, b = LY.write_layer(df.select("row", "col", "elevation"), 6), LY.write_layer(df.select("row", "col", "Map"), 6, str(tmp_path / "map"))
    conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = a.join(b, ["row", "col"])
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
        assert both.count() == df.count()
        opened = LY.open_layer(spark, str(tmp_path / "map"), "row int, col int, Map int", 6)
        again = a.join(opened, ["row", "col"])
        assert "Exchange" not in again._jdf.queryExecution().executedPlan().toString()
        assert again.count() == df.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", conf)


def test_the_stack_leaves_a_stored_layer_where_it_is(spark):
    inp = fixture_inputs(spark, SF001)
    fm = FloodMap(replace(inp, px_static=LY.write_layer(inp.px_static, 12)), replace(FIXTURE_SETTINGS, buckets=12), materialize=True)
    conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (fm.stack, fm.predictors):
            lines = _scan_parts(df._jdf.queryExecution().executedPlan().toString())
            # Read upwards from a layer's scan, a join comes before any exchange.
            for k, line in enumerate(lines):
                if "layer_" in line and "FileScan" in line:
                    above = next(x for x in reversed(lines[:k]) if "Exchange" in x or "Join" in x)
                    # The slope's tiles are another distribution, of the elevation alone.
                    assert "Join" in above or "REPARTITION_BY_NUM" in above or "_tr#" in above, above
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", conf)
    plain = FloodMap(inp, FIXTURE_SETTINGS).predictors
    cols = ["row", "col", "ndwi_post", "VV", "slope", "Map"]
    assert sorted(map(tuple, fm.predictors.select(cols).collect()), key=repr) == sorted(map(tuple, plain.select(cols).collect()), key=repr)


# --- one large document -----------------------------------------------------------------------------------------------


def _feature(k, comma):
    ring = [[k, 0], [k + 1, 0], [k + 1, 1], [k, 0]]
    return json.dumps({"type": "Feature", "properties": {"FLD_ZONE": "AE", "note": '{"type": "Feature", } \\" }]'},
                       "geometry": {"type": "Polygon", "coordinates": [ring]}}) + comma


def test_a_collection_is_read_by_many_tasks(spark, tmp_path):
    n = 2000
    body = "\n".join(_feature(k, "," if k < n - 1 else "") for k in range(n))
    (tmp_path / "one.geojson").write_text('{"type": "FeatureCollection", "name": "z", "features": [\n' + body + "\n]}")
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.json").write_text("\n".join(_feature(k, "") for k in range(n)))
    conf = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        whole = FI.read_zone_features(spark, str(tmp_path / "one.geojson"), collection=True)
        assert whole.rdd.getNumPartitions() > 4
        lines = FI.read_zone_features(spark, str(tmp_path / "lines"))
        assert sorted(whole.collect()) == sorted(lines.collect()) and whole.count() == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", conf)


def test_a_collection_written_in_two_ways_is_read_whole(spark, tmp_path):
    odd = json.loads(_feature(1, ""))
    text = json.dumps({"type": "FeatureCollection", "features": [json.loads(_feature(0, "")), {k: odd[k] for k in ("geometry", "properties", "type")}]})
    (tmp_path / "odd.geojson").write_text(text)
    assert FI.feature_mark(spark, str(tmp_path / "odd.geojson")) is None
    assert FI.read_zone_features(spark, str(tmp_path / "odd.geojson"), collection=True).count() == 2


# --- isotonic steps, balanced subsamples --------------------------------------------------------------------------------


def _fit(points):
    """Min-max formula over summed points [(score, sum, weight)]."""
    def mean(a, b):
        return sum(p[1] for p in points[a:b + 1]) / sum(p[2] for p in points[a:b + 1])
    n = len(points)
    return [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]


@pytest.mark.parametrize("blocks", [1, 3, 16])
@pytest.mark.parametrize("trend", [-1, 0, 1])
def test_isotonic_steps_equal_the_formula(spark, blocks, trend):
    rng = random.Random(blocks * 7 + trend)
    rows = [(float(rng.randrange(40)), float(rng.random() < 0.5 + trend * 0.4 * rng.random()) + trend * 0.01 * k, 1.0 + k % 3) for k in range(150)]
    rows += [(None, 1.0, 1.0), (3.0, None, 1.0), (4.0, 1.0, 0.0), (float("nan"), 1.0, 1.0)]
    sums = {}
    for s, y, w in rows[:150]:
        a, b = sums.get(s, (0.0, 0.0))
        sums[s] = (a + y * w, b + w)
    points = [(s, *sums[s]) for s in sorted(sums)]
    df = spark.createDataFrame(rows, "s double, y double, w double")
    steps = CAL.isotonic_steps(df, "s", "y", "w", blocks)
    got = sorted(steps.collect())
    assert all(a.high < b.low and a.value < b.value for a, b in zip(got, got[1:]))
    fitted = [next(r.value for r in got if r.low <= p[0] <= r.high) for p in points]
    assert fitted == pytest.approx(_fit(points), abs=1e-9)
    out = CAL.calibrate(df, steps, "s").select("s", "calibrated").collect()
    want = dict(zip((p[0] for p in points), fitted))
    assert all(r.calibrated == pytest.approx(want[r.s], abs=1e-9) for r in out if r.s in want)
    assert all(r.calibrated is None for r in out if r.s is None or r.s != r.s)


def test_isotonic_steps_of_nothing(spark):
    df = spark.createDataFrame([], "s double, y double")
    assert CAL.isotonic_steps(df, "s", "y").collect() == []


def test_bootstrap_draws_are_poisson_and_balanced(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 5 == 0).cast("int").alias("y"))
    drawn = ML.bootstrap(df, "k", 3, 42)
    share = {r.draws: r.n / 60_000 for r in drawn.groupBy("draws").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert share[1] == pytest.approx(0.3679, abs=0.01) and share[2] == pytest.approx(0.1839, abs=0.01) and share[3] == pytest.approx(0.0613, abs=0.01)
    w = ML.bootstrap_weights(drawn, "y").collect()
    assert len(w) == 6 and all(sum(r.n * r.weight for r in w if r.tree == t and r["class"] == c) == pytest.approx(
        sum(r.n for r in w if r.tree == t) / 2) for t in range(3) for c in (0, 1))
    assert sorted(drawn.collect()) == sorted(ML.bootstrap(df, "k", 3, 42).collect())


def test_a_balanced_forest_learns(spark):
    rng = random.Random(5)
    rows = []
    for k in range(600):
        y = int(rng.random() < 0.15)
        rows.append((str(k), y, *[rng.gauss(2.0 * y, 1.0) for _ in range(7)], 10 * rng.randrange(1, 4)))
    cols = ["ndwi_post", "mndwi_post", "awei_post", "VV", "elevation", "slope", "jrc_seasonality"]
    df = spark.createDataFrame(rows, "`system:index` string, flood int, " + ", ".join(f"{c} double" for c in cols) + ", Map int")
    forest = ML.fit_balanced(df.where("`system:index` % 3 <> 0"), ModelSettings(trees=6, max_depth=4))
    out = forest.score(df.where("`system:index` % 3 = 0")).collect()
    assert set(df.columns) | {"flood_probability", "flood_predicted"} == set(out[0].asDict())
    right = sum(r.flood == r.flood_predicted for r in out) / len(out)
    caught = sum(r.flood_predicted for r in out if r.flood) / sum(r.flood for r in out)
    assert right > 0.9 and caught > 0.8
