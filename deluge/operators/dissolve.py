"""Union of polygon layers as distributed edge work: no task ever holds a layer.

1. Rings become directed segments with the area on their left.  Equal segments are counted per
   direction (one group-by), so a border that many zones share is one row.
2. Segments are split where they meet others (spatial join of segments; a crossing is computed from
   the pair in a fixed order, so both sides get the same point) and counted again.
3. A piece used in both directions has area on both sides and goes.  Of the rest, the other side is
   probed by a point a millionth of the piece's length away: pieces with a zone there lie inside the union (spatial
   anti-join) and go, too.  What stays is the border of the union.
4. At every vertex an incoming piece is followed by the next outgoing one clockwise (one sort per
   vertex), so areas that touch in a point stay apart.
5. Rings are found by pointer doubling: in round k a piece knows the smallest id within 2^k steps, how far
   off it is, and the piece 2^k steps on.  When no piece learns anything new every piece knows its ring
   and its place in it: about log2(longest ring) joins.

Gaps and slivers thinner than a millionth of their edge count as closed.  Zones may overlap,
touch, repeat and have holes; points and lines have no area and are passed over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import cut_lineage
from .spatial import spatial_join

#: Distance of the probe from a piece, as a share of its length.
PROBE = 2.0 ** -20
_SEG = ("ax", "ay", "bx", "by")


def directed_segments(zones: DataFrame, geom: str = "geom", by: Sequence[str] = ()) -> DataFrame:
    """(*by, ax, ay, bx, by, fwd, bwd): segments from the smaller end to the larger, and how often a zone has
    its area to their left (fwd) or right (bwd).  ``by`` columns come as ``_by0`` ..."""
    named = [F.col(f"`{c}`").alias(f"_by{k}") for k, c in enumerate(by)]
    keys = [f"_by{k}" for k in range(len(by))]
    polygons = zones.where(F.col(f"`{geom}`.type").isin("Polygon", "MultiPolygon"))
    rings = (polygons.select(*named, F.explode(F.col(f"`{geom}`.parts")).alias("part"))
             .select(*keys, F.posexplode("part").alias("place", "ring")))
    twice = F.expr("""aggregate(sequence(0, size(ring) - 2), 0D, (s, i) ->
        s + (ring[i][0] - ring[0][0]) * (ring[i + 1][1] - ring[0][1]) - (ring[i + 1][0] - ring[0][0]) * (ring[i][1] - ring[0][1]))""")
    # A shell runs counter-clockwise, a hole clockwise.
    turned = F.when((twice > 0) == (F.col("place") == 0), F.col("ring")).otherwise(F.reverse("ring"))
    edges = (rings.where(F.size("ring") > 3).withColumn("ring", turned)
             .select(*keys, F.explode(F.expr("transform(sequence(0, size(ring) - 2), i -> named_struct("
                                             "'p', named_struct('x', ring[i][0], 'y', ring[i][1]), "
                                             "'q', named_struct('x', ring[i + 1][0], 'y', ring[i + 1][1])))")).alias("e"))
             .select(*keys, "e.p", "e.q").where("p != q"))
    low, high = F.least("p", "q"), F.greatest("p", "q")
    return (edges.groupBy(*keys, low.alias("low"), high.alias("high"))
            .agg(F.count_if(F.col("p") < F.col("q")).alias("fwd"), F.count_if(F.col("p") > F.col("q")).alias("bwd"))
            .select(*keys, F.col("low.x").alias("ax"), F.col("low.y").alias("ay"),
                    F.col("high.x").alias("bx"), F.col("high.y").alias("by"), "fwd", "bwd"))


def _line(prefix: str = "") -> Column:
    ends = [F.array(F.col(prefix + a), F.col(prefix + b)) for a, b in (("ax", "ay"), ("bx", "by"))]
    return F.struct(F.lit("LineString").alias("type"), F.array(F.array(F.array(*ends))).alias("parts"))


def _meeting_points() -> Column:
    """Points at which segment e is met by segment o: ends of o on e, and a proper crossing."""
    def side(s, x, y):
        return (F.col(s + "bx") - F.col(s + "ax")) * (y - F.col(s + "ay")) - (F.col(s + "by") - F.col(s + "ay")) * (x - F.col(s + "ax"))

    def end(x, y):
        px, py = F.col("o" + x), F.col("o" + y)
        within = (px.between(F.least("eax", "ebx"), F.greatest("eax", "ebx"))
                  & py.between(F.least("eay", "eby"), F.greatest("eay", "eby")))
        return F.when((side("e", px, py) == 0) & within, F.struct(px.alias("x"), py.alias("y")))

    across = ((F.signum(side("e", F.col("oax"), F.col("oay"))) * F.signum(side("e", F.col("obx"), F.col("oby"))) < 0)
              & (F.signum(side("o", F.col("eax"), F.col("eay"))) * F.signum(side("o", F.col("ebx"), F.col("eby"))) < 0))
    first = F.struct(*[F.col("e" + c) for c in _SEG]) < F.struct(*[F.col("o" + c) for c in _SEG])
    v = {c: F.when(first, F.col("e" + c)).otherwise(F.col("o" + c)) for c in _SEG}
    w = {c: F.when(first, F.col("o" + c)).otherwise(F.col("e" + c)) for c in _SEG}
    vx, vy, wx, wy = v["bx"] - v["ax"], v["by"] - v["ay"], w["bx"] - w["ax"], w["by"] - w["ay"]
    t = F.try_divide((w["ax"] - v["ax"]) * wy - (w["ay"] - v["ay"]) * wx, vx * wy - vy * wx)
    crossing = F.when(across, F.struct((v["ax"] + t * vx).alias("x"), (v["ay"] + t * vy).alias("y")))
    return F.filter(F.array(end("ax", "ay"), end("bx", "by"), crossing), lambda p: p.isNotNull())


def split_segments(segments: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The segments cut at every point where another of the same group meets them, counted anew per piece."""
    s = cut_lineage(segments.withColumn("id", F.monotonically_increasing_id()))
    left = s.select("id", *[F.col(k).alias(f"l{k}") for k in keys], *[F.col(c).alias("e" + c) for c in _SEG], _line().alias("line"))
    right = s.select(F.col("id").alias("oid"), *[F.col(k).alias(f"r{k}") for k in keys],
                     *[F.col(c).alias("o" + c) for c in _SEG], _line().alias("geom"))
    meet = spatial_join(left, right, "inner", left_geom="line", right_geom="geom").where("id != oid")
    for k in keys:
        meet = meet.where(F.col(f"l{k}").eqNullSafe(F.col(f"r{k}")))
    points = meet.select("id", F.explode(_meeting_points()).alias("p")).groupBy("id").agg(F.collect_set("p").alias("cuts"))
    ends = F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))
    # Along a segment from its smaller to its larger end points are in the order of the longer axis.
    ordered = F.expr("""transform(array_sort(transform(stops, p -> named_struct('t',
        if(abs(bx - ax) >= abs(by - ay), p.x - ax, (p.y - ay) * signum(by - ay)), 'p', p))), s -> s.p)""")
    stops = F.array_distinct(F.concat(ends, F.coalesce(F.col("cuts"), F.array().cast("array<struct<x:double,y:double>>"))))
    pieces = (s.join(points, "id", "left").withColumn("stops", stops).withColumn("stops", ordered)
              .select(*keys, "fwd", "bwd", F.explode(F.expr(
                  "transform(sequence(0, size(stops) - 2), i -> named_struct('p', stops[i], 'q', stops[i + 1]))")).alias("e"))
              .select(*keys, "fwd", "bwd", "e.p", "e.q"))
    # A rounded crossing can turn a piece round by an ulp; its smaller end still comes first.
    up = F.col("p") < F.col("q")
    return (pieces.where("p != q").groupBy(*keys, F.least("p", "q").alias("low"), F.greatest("p", "q").alias("high"))
            .agg(F.sum(F.when(up, F.col("fwd")).otherwise(F.col("bwd"))).alias("fwd"),
                 F.sum(F.when(up, F.col("bwd")).otherwise(F.col("fwd"))).alias("bwd"))
            .select(*keys, F.col("low.x").alias("ax"), F.col("low.y").alias("ay"),
                    F.col("high.x").alias("bx"), F.col("high.y").alias("by"), "fwd", "bwd"))


def border(zones: DataFrame, geom: str = "geom", by: Sequence[str] = ()) -> DataFrame:
    """(*by, ax, ay, bx, by): directed pieces of the border of the union of ``zones`` (per ``by``), area on their left."""
    keys = [f"_by{k}" for k in range(len(by))]
    pieces = split_segments(directed_segments(zones, geom, by), keys).where("(fwd > 0) != (bwd > 0)")
    sign = F.when(F.col("fwd") > 0, 1.0).otherwise(-1.0) * PROBE
    probe = G.point((F.col("ax") + F.col("bx")) / 2 + (F.col("by") - F.col("ay")) * sign,
                    (F.col("ay") + F.col("by")) / 2 - (F.col("bx") - F.col("ax")) * sign)
    pieces = cut_lineage(pieces.withColumn("id", F.monotonically_increasing_id()).withColumn("probe", probe))
    if not by:
        kept = spatial_join(pieces, zones.select(F.col(f"`{geom}`").alias("geom")), "left_anti", left_geom="probe", left_powers=[None])
    else:  # only zones of the piece's own group count
        own = zones.select(*[F.col(f"`{c}`").alias(f"_z{k}") for k, c in enumerate(by)], F.col(f"`{geom}`").alias("geom"))
        hits = spatial_join(pieces, own, "inner", left_geom="probe", left_powers=[None])
        for k in range(len(by)):
            hits = hits.where(F.col(f"_by{k}").eqNullSafe(F.col(f"_z{k}")))
        kept = pieces.join(hits.select("id").distinct(), "id", "left_anti")
    turn = F.col("fwd") > 0
    return kept.select(
        *[F.col(k).alias(c) for k, c in zip(keys, by)],
        *[F.when(turn, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in zip(_SEG, ("bx", "by", "ax", "ay"))])


def _following(pieces: DataFrame, by: Sequence[str]) -> DataFrame:
    """(id, next): at its end every piece is followed by the first outgoing piece clockwise."""
    def angle(x, y):
        return F.atan2(F.col(y[0]) - F.col(y[1]), F.col(x[0]) - F.col(x[1]))
    back = pieces.select(*by, F.col("bx").alias("x"), F.col("by").alias("y"), F.col("id").alias("came"),
                         F.lit(None).cast("long").alias("goes"), angle(("ax", "bx"), ("ay", "by")).alias("angle"))
    on = pieces.select(*by, F.col("ax").alias("x"), F.col("ay").alias("y"), F.lit(None).cast("long").alias("came"),
                       F.col("id").alias("goes"), angle(("bx", "ax"), ("by", "ay")).alias("angle"))
    w = Window.partitionBy(*by, "x", "y").orderBy("angle")
    ends = back.unionByName(on).withColumn(
        "before", F.last("goes", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn(
        "last", F.last("goes", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return ends.where("came is not null").select(F.col("came").alias("id"), F.coalesce("before", "last").alias("next"))


def rings(pieces: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, ring, place, ax, ay, bx, by): border pieces with their ring (its smallest piece id) and place in it from 0."""
    pieces = cut_lineage(pieces.withColumn("id", F.monotonically_increasing_id()))
    state = cut_lineage(_following(pieces, by).select("id", F.col("id").alias("ring"), F.lit(0).cast("long").alias("off"), "next"))
    step = 1
    while True:
        ahead = state.select(F.col("id").alias("next"), F.col("ring").alias("a_ring"), F.col("off").alias("a_off"),
                             F.col("next").alias("a_next"))
        better = F.col("a_ring") < F.col("ring")
        state = cut_lineage(state.join(ahead, "next").select(
            "id", F.when(better, F.col("a_ring")).otherwise(F.col("ring")).alias("ring"),
            F.when(better, F.col("a_off") + step).otherwise(F.col("off")).alias("off"),
            F.col("a_next").alias("next"), better.alias("moved")))
        if state.where("moved").isEmpty():
            break
        step *= 2
    sizes = state.groupBy("ring").agg(F.count(F.lit(1)).alias("n"))
    placed = state.join(sizes, "ring").select("id", "ring", F.pmod(F.col("n") - F.col("off"), F.col("n")).alias("place"))
    return pieces.join(placed, "id").select(*by, "ring", "place", *_SEG)


def ring_table(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, ring, pieces, area, length, minx, miny, maxx, maxy, vertices) per ring; holes have a negative area."""
    cross = F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")
    return parts.groupBy(*by, "ring").agg(
        F.count(F.lit(1)).alias("pieces"), (F.sum(cross) / 2).alias("area"),
        F.sum(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).alias("length"),
        F.min("ax").alias("minx"), F.min("ay").alias("miny"), F.max("ax").alias("maxx"), F.max("ay").alias("maxy"),
        F.transform(F.array_sort(F.collect_list(F.struct("place", "ax", "ay"))), lambda v: F.array(v.ax, v.ay)).alias("vertices"))


def dissolve(zones: DataFrame, geom: str = "geom", by: Sequence[str] = ()) -> DataFrame:
    """(*by, geom, area): the union of ``zones``, one polygon with its holes per row.

    Polygons of one group are disjoint (they may touch in points); together they are the group's
    dissolved geometry.  A hole belongs to the smallest shell around it.
    """
    parts = rings(border(zones, geom, by), by)
    table = cut_lineage(ring_table(parts, by))
    closed = F.concat("vertices", F.slice("vertices", 1, 1))
    shells = table.where("area > 0").select(*by, F.col("ring").alias("shell"), F.col("area").alias("shell_area"),
                                            F.struct(F.lit("Polygon").alias("type"), F.array(F.array(closed)).alias("parts")).alias("geom"))
    holes = table.where("area < 0").select(*by, F.col("ring").alias("hole"), F.col("area").alias("hole_area"), closed.alias("inner"), "vertices")
    a, b = F.col("vertices")[0], F.col("vertices")[1]
    # Just inside the hole, to the right of its first piece.
    inside = G.point((a[0] + b[0]) / 2 + (b[1] - a[1]) * PROBE, (a[1] + b[1]) / 2 - (b[0] - a[0]) * PROBE)
    around = spatial_join(holes.select(*[F.col(f"`{c}`").alias(f"_h{k}") for k, c in enumerate(by)], "hole", "hole_area", "inner",
                                       inside.alias("at")),
                          shells, "inner", left_geom="at", right_geom="geom", left_powers=[None])
    for k, c in enumerate(by):
        around = around.where(F.col(f"_h{k}").eqNullSafe(F.col(f"`{c}`")))
    owner = around.groupBy("hole").agg(F.min_by(F.struct("shell", "hole_area", "inner"), F.struct("shell_area", "shell")).alias("of"))
    of_shell = owner.groupBy("of.shell").agg(F.sum("of.hole_area").alias("gone"), F.collect_list("of.inner").alias("inners"))
    whole = F.concat(F.col("geom.parts")[0], F.coalesce("inners", F.array().cast("array<array<array<double>>>")))
    return shells.join(of_shell, "shell", "left").select(
        *by, F.struct(F.lit("Polygon").alias("type"), F.array(whole).alias("parts")).alias("geom"),
        (F.col("shell_area") + F.coalesce("gone", F.lit(0.0))).alias("area"))
