import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from deluge.functions import geometry as G
from deluge.operators import dissolve as D
from deluge.operators import spatial as SP
from deluge.sources import fixtures

from .conftest import SF001
from .test_spatial_zones import _pip, _points, _poly_hit, _zones


def _polygons(spark, polys, kind="Polygon"):
    rows = [(i, json.dumps({"type": kind, "coordinates": p})) for i, p in enumerate(polys)]
    return G.with_geometry(spark.createDataFrame(rows, "zone_id long, g string"), F.col("g"), "geom").drop("g")


def _star(rng, n, cx, cy, r, digits=6):
    """A ring of n vertices at random distances, seen from its centre in order."""
    ring = [(round(cx + r * f * math.cos(2 * math.pi * k / n), digits), round(cy + r * f * math.sin(2 * math.pi * k / n), digits))
            for k, f in ((k, rng.uniform(0.4, 1.0)) for k in range(n))]
    return ring + ring[:1]


def _covered(edges, w, area, p):
    """Point test through the record of the point's cell."""
    at = (math.floor(p[0] / w), math.floor(p[1] / w))
    for cx, cy, full, some, turns, odd in SP.cover(edges, w, area):
        if (cx, cy) == at:
            if full:
                return True
            inside = bool(odd) != (sum(t > p[1] for t in turns) % 2 == 1)
            for ax, ay, bx, by in edges[some]:
                cross = (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)
                if cross == 0 and min(ax, bx) <= p[0] <= max(ax, bx) and min(ay, by) <= p[1] <= max(ay, by):
                    return True
                if (ay > p[1]) != (by > p[1]) and p[0] < (bx - ax) * (p[1] - ay) / (by - ay) + ax:
                    inside = not inside
            return inside
    return False


@pytest.mark.parametrize("digits", [0, 1, 6])
def test_cover_answers_as_the_whole_ring_does(digits):
    rng = random.Random(digits)
    for n in (3, 20, 120):
        rings = [_star(rng, n, 10, 10, 9, digits), _star(rng, 5, 10, 10, 2, digits)[::-1]]
        edges = np.array([(*a, *b) for r in rings for a, b in zip(r, r[1:])], float)
        for w in (0.5, 2.0, 8.0):
            pts = [(round(rng.uniform(0, 20), digits), round(rng.uniform(0, 20), digits)) for _ in range(60)] + rings[0][:10]
            for p in pts:
                assert _covered(edges, w, True, p) == _pip(*p, rings), (n, w, p)


@pytest.mark.parametrize("kw", [{}, {"broadcast_vertex_limit": 0}, {"cell_size": 0.3}])
def test_covered_zones_equal_brute_force(spark, kw):
    """Zones of few and many edges, with holes and parts; points, squares of all sizes and null geometries."""
    rng = random.Random(3)
    polys = [[_star(rng, rng.choice([4, 60, 400]), rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(3, 20))] for _ in range(12)]
    polys.append([_star(rng, 300, 30, 30, 25), [(25.0, 25.0), (35.0, 25.0), (35.0, 35.0), (25.0, 35.0), (25.0, 25.0)]])
    zones = _polygons(spark, polys)
    pts = [(rng.uniform(-5, 65), rng.uniform(-5, 65)) for _ in range(400)] + polys[-1][0][:20]
    sq = [(x, y, x + s, y + s) for x, y, s in ((rng.uniform(-5, 60), rng.uniform(-5, 60), 2 ** rng.uniform(-4, 6)) for _ in range(150))]
    squares = spark.createDataFrame([(f"s{i}", *s) for i, s in enumerate(sq)], "id string, a double, b double, c double, d double").select(
        "id", G.rectangle(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("geometry"))
    none = spark.range(1).select(F.lit("none").alias("id"), F.lit(None).cast(G.GEOM_DDL).alias("geometry"))
    left = _points(spark, pts).unionByName(squares).unionByName(none)
    want = {(str(i), k) for i, p in enumerate(pts) for k, z in enumerate(polys) if _pip(*p, z)}
    for i, (a, b, c, d) in enumerate(sq):
        ring = [[(a, b), (c, b), (c, d), (a, d), (a, b)]]
        want |= {(f"s{i}", k) for k, z in enumerate(polys) if _poly_hit(ring, z) or any(_pip(*v[0], ring) for v in z[1:])}
    ids = {r.id for r in left.collect()}
    hit = {i for i, _ in want}
    got = SP.spatial_join(left, zones, "inner", left_geom="geometry", **kw).select("id", "zone_id", "right_geometry.type").collect()
    assert {(r.id, r.zone_id) for r in got} == want and len(got) == len(want) and {r.type for r in got} == {"Polygon"}
    outer = SP.spatial_join(left, zones, "left", left_geom="geometry", **kw).select("id", "zone_id").collect()
    assert sorted(map(tuple, outer), key=repr) == sorted(want | {(i, None) for i in ids - hit}, key=repr)
    assert sorted(r.id for r in SP.spatial_join(left, zones, "left_semi", left_geom="geometry", **kw).collect()) == sorted(hit)
    assert sorted(r.id for r in SP.spatial_join(left, zones, "left_anti", left_geom="geometry", **kw).collect()) == sorted(ids - hit)


def test_a_large_zone_costs_a_cell_not_a_ring(spark):
    """100,000 vertices: an equi-join, and no record carries more than a small share of the edges."""
    rng = random.Random(8)
    n = 100_000
    ring = [(round(50 + 40 * math.cos(2 * math.pi * k / n) + rng.uniform(-.01, .01), 6),
             round(50 + 40 * math.sin(2 * math.pi * k / n) + rng.uniform(-.01, .01), 6)) for k in range(n)]
    ring.append(ring[0])
    edges = np.array([(*a, *b) for a, b in zip(ring, ring[1:])])
    sizes = [len(r[3]) for r in SP.cover(edges, 0.5, True)]
    assert max(sizes) < 2000 and sum(s == 0 for s in sizes) > 10_000
    zones = _polygons(spark, [[ring]])
    pts = [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(3000)]
    joined = SP.spatial_join(_points(spark, pts), zones, "left_semi", left_geom="geometry", broadcast_vertex_limit=0)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    near = {str(i) for i, (x, y) in enumerate(pts) if math.hypot(x - 50, y - 50) < 39.9}
    far = {str(i) for i, (x, y) in enumerate(pts) if math.hypot(x - 50, y - 50) > 40.1}
    got = {r.id for r in joined.collect()}
    assert near <= got and not (far & got)


def test_zones_as_rows_of_edges_equal_whole_ones(spark):
    """Two zones edge by edge, with a hole; points, squares of all sizes, parts, lines and a null geometry."""
    rng = random.Random(5)
    rings = {1: [_star(rng, 400, 30, 30, 25), [(25.0, 25.0), (35.0, 25.0), (35.0, 35.0), (25.0, 35.0), (25.0, 25.0)]], 2: [_star(rng, 60, 50, 40, 20, 0)]}
    edges = spark.createDataFrame([(z, *a, *b) for z, rs in rings.items() for r in rs for a, b in zip(r, r[1:])],
                                  "zone_id long, ax double, ay double, bx double, by double")
    whole = _polygons(spark, [[], rings[1], rings[2]]).where("zone_id > 0")
    texts = [{"type": "Point", "coordinates": p} for p in [(rng.uniform(0, 70), rng.uniform(0, 70)) for _ in range(200)] + rings[2][0]]
    for _ in range(80):
        x, y, s = rng.uniform(-5, 60), rng.uniform(-5, 60), 2 ** rng.uniform(-4, 7)
        texts.append({"type": "Polygon", "coordinates": [[(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]]})
        texts.append({"type": "MultiPoint", "coordinates": [(x, y), (x + s, y + s)]})
        texts.append({"type": "LineString", "coordinates": [(x, y), (x + s, y + s / 3)]})
    rows = [(i, json.dumps(t)) for i, t in enumerate(texts)] + [(len(texts), None)]
    left = G.with_geometry(spark.createDataFrame(rows, "id long, g string"), F.col("g"), "geometry").drop("g")
    for turned in (False, True):  # the columns run along either axis
        kw = {"right_edges": ("ay", "ax", "by", "bx") if turned else ("ax", "ay", "bx", "by")}
        l2, whole2 = left, whole
        if turned:
            flip = "struct(g.type as type, transform(g.parts, a -> transform(a, r -> transform(r, v -> array(v[1], v[0])))) as parts)"
            l2 = left.withColumn("geometry", F.expr("if(geometry is null, null, " + flip.replace("g.", "geometry.") + ")"))
            whole2 = whole.withColumn("geom", F.expr(flip.replace("g.", "geom.")))
        for how in ("inner", "left_semi") if turned else ("left", "left_anti"):
            cols = ["id", "zone_id"] if how in ("inner", "left") else ["id"]
            want, got = (sorted(map(tuple, SP.spatial_join(l2, z, how, left_geom="geometry", **k).select(*cols).collect()), key=repr)
                         for z, k in ((whole2, {}), (edges, kw)))
            assert got == want and want, (how, turned)


def test_a_skyline_is_numbered_and_closed_in_pieces(spark, monkeypatch):
    """No row holds the ring: its edges follow each other, whatever the groups of bars."""
    monkeypatch.setattr(fixtures, "BARS", 64)
    zone = fixtures.skyline_zone(spark, SF001)
    rows = zone.collect()
    n = fixtures.table(spark, SF001, "lineitem").count()
    assert set(zone.columns) == {"zone_id", "ax", "ay", "bx", "by"} and len(rows) == 2 * n + 2
    assert sorted((r.ax, r.ay) for r in rows) == sorted((r.bx, r.by) for r in rows)  # closed
    assert sorted(r.ax for r in rows if r.bx == r.ax + 1) == [float(k) for k in range(n)]


def test_lines_of_many_vertices(spark):
    line = [(k / 10, math.sin(k / 10)) for k in range(600)]
    zones = _polygons(spark, [line], "LineString")
    p = _points(spark, [line[5], line[300], (3.0, 5.0), (10.0, 0.9)])
    assert {r.id for r in SP.spatial_join(p, zones, "left_semi", left_geom="geometry").collect()} == {"0", "1"}


# --- dissolve --------------------------------------------------------------------------------------------------------


def _in_any(x, y, polys):
    return any(_pip(x, y, p) for p in polys)


def _rows(df):
    return [(r.geom["parts"][0], r.area) for r in df.select("geom", "area").collect()]


def test_dissolve_of_squares(spark):
    """Shared borders, an overlap, a repeat, a hole, squares that touch in a corner, and one apart."""
    z = _zones(spark, [("A", r) for r in ((0., 0., 2., 2.), (2., 0., 4., 2.), (1., 1., 3., 3.), (0., 0., 2., 2.), (10., 10., 11., 11.),
                                          (11., 11., 12., 12.), (20., 0., 21., 3.), (22., 0., 23., 3.), (20., 0., 23., 1.), (20., 2., 23., 3.))])
    got = sorted((round(a, 9), len(p)) for p, a in _rows(D.dissolve(z)))
    assert got == [(1.0, 1), (1.0, 1), (8.0, 2), (10.0, 1)]
    empty = D.dissolve(z.where("false"))
    assert empty.collect() == [] and empty.columns == ["geom", "area"]


def test_dissolve_by_column_keeps_groups_apart(spark):
    z = _zones(spark, [("A", (0., 0., 2., 2.)), ("A", (1., 0., 3., 2.)), ("B", (0., 0., 2., 2.)), (None, (5., 5., 6., 6.)), (None, (5., 5., 7., 6.))])
    got = sorted((str(r.FLD_ZONE), r.area) for r in D.dissolve(z, by=["FLD_ZONE"]).collect())
    assert got == [("A", 6.0), ("B", 4.0), ("None", 2.0)]


def test_dissolve_of_random_polygons_holds_the_same_points(spark):
    rng = random.Random(12)
    polys = [[_star(rng, rng.choice([3, 5, 9]), rng.uniform(0, 40), rng.uniform(0, 40), rng.uniform(3, 9), 3)] for _ in range(25)]
    polys.append([[(50., 50.), (60., 50.), (60., 60.), (50., 60.), (50., 50.)], [(52., 52.), (52., 58.), (58., 58.), (58., 52.), (52., 52.)]])
    parts = _rows(D.dissolve(_polygons(spark, polys + polys[:3])))
    edges = [(a, b) for rings, _ in parts for r in rings for a, b in zip(r, r[1:])]
    for _ in range(3000):
        x, y = rng.uniform(-5, 65), rng.uniform(-5, 65)
        inside = sum(_pip(x, y, [[tuple(v) for v in r] for r in rings]) for rings, _ in parts)
        assert inside == int(_in_any(x, y, polys)), (x, y)
    assert len(edges) == len({(tuple(a), tuple(b)) for a, b in edges})


def test_a_long_ring_is_numbered_in_order(spark):
    """A strip of 300 squares: one ring whose places follow each other."""
    z = _zones(spark, [("A", (float(k), 0.0, k + 1.0, 1.0)) for k in range(300)])
    r = D.rings(D.border(z)).orderBy("ring", "place").collect()
    assert len(r) == 602 and [x.place for x in r] == list(range(602)) and len({x.ring for x in r}) == 1
    assert all((a.bx, a.by) == (b.ax, b.ay) for a, b in zip(r, r[1:] + r[:1]))
