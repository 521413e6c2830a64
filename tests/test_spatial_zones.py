import random

from pyspark.sql import functions as F

from deluge.functions import geometry as G
from deluge.operators import spatial as SP
from deluge.operators import zones as Z


def _zones(spark, rects):
    df = spark.createDataFrame([(i, code, *r) for i, (code, r) in enumerate(rects)],
                               "zone_id long, FLD_ZONE string, x0 double, y0 double, x1 double, y1 double")
    return df.select("zone_id", "FLD_ZONE", G.rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("geom"))


def _points(spark, pts):
    df = spark.createDataFrame([(str(i), x, y) for i, (x, y) in enumerate(pts)], "id string, x double, y double")
    return df.select("id", G.point(F.col("x"), F.col("y")).alias("geometry"))


def test_zone_border_cases(spark):
    z = _zones(spark, [("AE", (0.0, 0.0, 4.0, 4.0))])
    p = _points(spark, [(4.0, 2.0), (0.0, 0.0), (2.0, 2.0), (4.0001, 2.0), (-1.0, -1.0)])
    anti = {r.id for r in SP.spatial_join(p, z, "left_anti", left_geom="geometry").collect()}
    semi = {r.id for r in SP.spatial_join(p, z, "left_semi", left_geom="geometry").collect()}
    assert semi == {"0", "1", "2"} and anti == {"3", "4"}


def test_random_points_rectangles_vs_brute_force(spark):
    rng = random.Random(11)
    rects = []
    for _ in range(60):
        x, y = rng.uniform(0, 100), rng.uniform(0, 100)
        rects.append(("A", (x, y, x + rng.uniform(0.5, 15), y + rng.uniform(0.5, 15))))
    rects.append(("A", (-50.0, -50.0, 300.0, 3.0)))  # one very large zone
    pts = [(rng.uniform(-5, 110), rng.uniform(-5, 110)) for _ in range(800)]
    z, p = _zones(spark, rects), _points(spark, pts)
    want = {str(i) for i, (x, y) in enumerate(pts)
            if any(a <= x <= c and b <= y <= d for _, (a, b, c, d) in rects)}
    for kw in ({}, {"cell_size": 0.4}, {"broadcast_vertex_limit": 0}):
        semi = {r.id for r in SP.spatial_join(p, z, "left_semi", left_geom="geometry", **kw).collect()}
        anti = {r.id for r in SP.spatial_join(p, z, "left_anti", left_geom="geometry", **kw).collect()}
        assert semi == want and semi | anti == {str(i) for i in range(len(pts))} and not (semi & anti)
    pairs = SP.spatial_join(p, z, "inner", left_geom="geometry").count()
    brute = sum(1 for x, y in pts for _, (a, b, c, d) in rects if a <= x <= c and b <= y <= d)
    assert pairs == brute


def test_polygon_polygon_intersects(spark):
    z = _zones(spark, [("A", (0.0, 0.0, 10.0, 10.0))])
    sq = spark.createDataFrame([("in", 2.0, 2.0, 3.0, 3.0), ("touch", 10.0, 1.0, 12.0, 2.0),
                                ("cross", 9.0, -1.0, 11.0, 11.0), ("out", 11.0, 11.0, 12.0, 12.0),
                                ("around", -5.0, -5.0, 20.0, 20.0)], "id string, a double, b double, c double, d double")
    left = sq.select("id", G.rectangle(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("geometry"))
    semi = {r.id for r in SP.spatial_join(left, z, "left_semi", left_geom="geometry").collect()}
    assert semi == {"in", "touch", "cross", "around"}


def test_zone_filter_fallbacks(spark):
    z = _zones(spark, [("X", (0.0, 0.0, 1.0, 1.0)), ("D", (2.0, 2.0, 3.0, 3.0))])
    assert Z.filter_zone_codes(z, "FLD_ZONE", ["A", "AE"]).count() == 2      # no listed code: keep all
    z2 = _zones(spark, [("X", (0.0, 0.0, 1.0, 1.0)), ("AE", (2.0, 2.0, 3.0, 3.0))])
    assert [r.FLD_ZONE for r in Z.filter_zone_codes(z2, "FLD_ZONE", ["A", "AE"]).collect()] == ["AE"]
    assert Z.filter_zone_codes(z.drop("FLD_ZONE"), "FLD_ZONE", ["A"]).count() == 2  # field missing
    empty = z.where("false")
    picked = Z.first_nonempty_source([empty, z2, z])
    assert picked.count() == 2 and {r.source_priority for r in picked.collect()} == {1}
    assert Z.dissolved_count(empty).first()[0] == 0 and Z.dissolved_count(z).first()[0] == 1


def _pip(x, y, rings):
    """Reference point-in-polygon (even-odd over all rings), boundary included."""
    inside = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
            if cross == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                return True
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                inside = not inside
    return inside


def test_random_polygons_vs_reference(spark):
    import json
    import math
    rng = random.Random(5)
    zones, polys = [], []
    for i in range(40):
        cx, cy, rad = rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(2, 9)
        k = rng.choice([3, 5, 6])
        ring = [(round(cx + rad * math.cos(2 * math.pi * j / k + 0.3), 3), round(cy + rad * math.sin(2 * math.pi * j / k + 0.3), 3))
                for j in range(k)]
        ring.append(ring[0])
        polys.append([ring])
        zones.append((i, json.dumps({"type": "Polygon", "coordinates": [ring]})))
    # one multipolygon zone made of two triangles
    mp = [[[(70.0, 0.0), (80.0, 0.0), (75.0, 8.0), (70.0, 0.0)]], [[(70.0, 20.0), (80.0, 20.0), (75.0, 28.0), (70.0, 20.0)]]]
    zones.append((99, json.dumps({"type": "MultiPolygon", "coordinates": mp})))
    zdf = G.with_geometry(spark.createDataFrame(zones, "zone_id long, g string"), F.col("g"), "geom").drop("g")
    pts = [(round(rng.uniform(-2, 85), 2), round(rng.uniform(-2, 65), 2)) for _ in range(1500)]
    pts += [polys[0][0][0], polys[1][0][1], (75.0, 4.0), (75.0, 12.0)]  # vertices and multipolygon parts
    p = _points(spark, pts)
    got = {r.id for r in SP.spatial_join(p, zdf, "left_semi", left_geom="geometry").collect()}
    allp = polys + [[m[0]] for m in mp]
    want = {str(i) for i, (x, y) in enumerate(pts) if any(_pip(x, y, rings) for rings in allp)}
    assert got == want


def _seg_touch(a, b, c, d):
    def o(p, q, r):
        v = (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
        return (v > 0) - (v < 0)
    box = (max(a[0], b[0]) >= min(c[0], d[0]) and max(c[0], d[0]) >= min(a[0], b[0]) and
           max(a[1], b[1]) >= min(c[1], d[1]) and max(c[1], d[1]) >= min(a[1], b[1]))
    return o(a, b, c) * o(a, b, d) <= 0 and o(c, d, a) * o(c, d, b) <= 0 and box


def _poly_hit(p, q):
    ep = [(u, v) for r in p for u, v in zip(r, r[1:])]
    eq = [(u, v) for r in q for u, v in zip(r, r[1:])]
    if any(_seg_touch(a, b, c, d) for a, b in ep for c, d in eq):
        return True
    return _pip(p[0][0][0], p[0][0][1], q) or _pip(q[0][0][0], q[0][0][1], p)


def test_random_squares_vs_polygons_reference(spark):
    import json
    import math
    rng = random.Random(9)
    polys, zones = [], []
    for i in range(30):
        cx, cy, rad = rng.uniform(0, 50), rng.uniform(0, 50), rng.uniform(2, 8)
        ring = [(round(cx + rad * math.cos(2 * math.pi * j / 5), 3), round(cy + rad * math.sin(2 * math.pi * j / 5), 3))
                for j in range(5)]
        ring.append(ring[0])
        polys.append([ring])
        zones.append((i, json.dumps({"type": "Polygon", "coordinates": [ring]})))
    zdf = G.with_geometry(spark.createDataFrame(zones, "zone_id long, g string"), F.col("g"), "geom").drop("g")
    sq = []
    for i in range(600):
        x, y, s = round(rng.uniform(-3, 58), 2), round(rng.uniform(-3, 58), 2), round(rng.uniform(0.2, 3), 2)
        sq.append((str(i), x, y, x + s, y + s))
    left = spark.createDataFrame(sq, "id string, a double, b double, c double, d double").select(
        "id", G.rectangle(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("geometry"))
    got = {r.id for r in SP.spatial_join(left, zdf, "left_semi", left_geom="geometry").collect()}
    want = set()
    for i, a, b, c, d in sq:
        ring = [[(a, b), (c, b), (c, d), (a, d), (a, b)]]
        if any(_poly_hit(ring, z) for z in polys):
            want.add(i)
    assert got == want


def test_left_join_pairs_plus_unmatched(spark):
    z = _zones(spark, [("A", (0.0, 0.0, 4.0, 4.0)), ("AE", (3.0, 3.0, 6.0, 6.0))])
    p = _points(spark, [(3.5, 3.5), (1.0, 1.0), (9.0, 9.0)])
    for kw in ({}, {"cell_size": 0.01}):
        rows = sorted((r.id, r.zone_id) for r in SP.spatial_join(p, z, "left", left_geom="geometry", **kw).collect())
        assert rows == [("0", 0), ("0", 1), ("1", 0), ("2", None)]


def test_one_wide_left_polygon_keeps_cells_small(spark):
    """A geometry over everything must not pull all rows into one cell, nor change any result."""
    rng = random.Random(5)
    rects = [("A", (x, y, x + 1.5, y + 1.5)) for x, y in ((rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(80))]
    pts = [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(2000)]
    z = _zones(spark, rects)
    wide = spark.range(1).select(F.lit("wide").alias("id"), G.rectangle(*[F.lit(v) for v in (-10.0, -10.0, 900.0, 900.0)]).alias("geometry"))
    left = _points(spark, pts).select("id", "geometry").unionByName(wide)
    got = sorted((r.id, r.zone_id) for r in SP.spatial_join(left, z, "left", left_geom="geometry").collect())
    want = [("wide", k) for k in range(len(rects))]
    for i, (x, y) in enumerate(pts):
        hit = [k for k, (_, (a, b, c, d)) in enumerate(rects) if a <= x <= c and b <= y <= d]
        want += [(str(i), k) for k in hit] or [(str(i), None)]
    assert got == sorted(want, key=lambda r: (r[0], -1 if r[1] is None else r[1])) or sorted(
        map(str, got)) == sorted(map(str, want))
    # Points stay on the finest grid: no cell holds more than a hundredth of them.
    L = SP._prep(left, "geometry", "_l_").withColumn("_a", SP._level("_l_", 1)).where("_a = 0")
    cells = L.groupBy(F.floor(F.col("_l_minx") / 2), F.floor(F.col("_l_miny") / 2)).count()
    assert cells.agg(F.max("count")).first()[0] <= 20


def test_points_lines_and_null_geometries(spark):
    text = spark.createDataFrame([
        ("p", '{"type":"Point","coordinates":[1,1]}'), ("q", '{"type":"Point","coordinates":[1,1]}'),
        ("l", '{"type":"LineString","coordinates":[[0,0],[2,2]]}'), ("far", '{"type":"Point","coordinates":[5,5]}'),
        ("ring", '{"type":"LineString","coordinates":[[0,0],[4,0],[4,4],[0,4],[0,0]]}'), ("none", None)], "id string, t string")
    g = G.with_geometry(text, F.col("t"), "geometry").drop("t")
    right = g.select(F.col("id").alias("other"), F.col("geometry").alias("geom"))
    got = {(r.id, r.other) for r in SP.spatial_join(g, right, "inner", left_geom="geometry").collect()}
    same = {("p", "q"), ("q", "p"), ("p", "l"), ("l", "p"), ("q", "l"), ("l", "q"), ("l", "ring"), ("ring", "l")}
    assert got == same | {(k, k) for k in ("p", "q", "l", "far", "ring")}  # a point inside a closed line is not on it
    anti = {r.id for r in SP.spatial_join(g, right, "left_anti", left_geom="geometry").collect()}
    assert anti == {"none"}
