"""Geometry as plain Spark columns.

A geometry is ``struct<type: string, parts: array<array<array<array<double>>>>>``:
parts -> rings -> points -> [x, y].  A point is one part with one ring of one point, a line
one part with one ring of its vertices.  Predicates are SQL higher-order functions
(``exists``/``aggregate``/``transform``): they run in the JVM, interpreted per row (Spark does
not generate code for them), with no Python in the loop.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GEOM_DDL = "struct<type:string,parts:array<array<array<array<double>>>>>"
_RAW_DDL = "type string, coordinates string, geometries string"
EARTH_RADIUS_M = 6378137.0
MERCATOR_MAX_LAT = 85.0511287798066


def _brackets(text: Column) -> Column:
    """Python tuples as JSON arrays: round brackets squared, commas before a closing one dropped."""
    return F.regexp_replace(F.translate(text, "()", "[]"), r",(\s*\])", "$1")


_DEPTHS = {"Point": 1, "MultiPoint": 2, "LineString": 2, "MultiLineString": 3, "Polygon": 3, "MultiPolygon": 4}


def _parts_sql(kind: str, coords: dict[int, str]) -> str:
    """Parts of a geometry of type ``kind`` whose coordinates, by depth of nesting, are ``coords``."""
    return f"""CASE {kind}
        WHEN 'Point' THEN array(array(array({coords[1]})))
        WHEN 'MultiPoint' THEN transform({coords[2]}, p -> array(array(p)))
        WHEN 'LineString' THEN array(array({coords[2]}))
        WHEN 'MultiLineString' THEN transform({coords[3]}, l -> array(l))
        WHEN 'Polygon' THEN array({coords[3]})
        WHEN 'MultiPolygon' THEN {coords[4]} END"""


def _sound_sql(parts: str, kind: str) -> str:
    """Every vertex two numbers; a line two vertices, a ring three; no empty part or ring."""
    least = f"CASE WHEN {kind} LIKE '%Polygon' THEN 3 WHEN {kind} LIKE '%LineString' THEN 2 ELSE 1 END"
    return f"""coalesce(size({parts}) > 0 AND forall({parts}, part -> coalesce(size(part) > 0 AND forall(part, ring ->
        coalesce(size(ring) >= {least} AND forall(ring, v -> coalesce(size(v) >= 2 AND get(v, 0) IS NOT NULL
        AND get(v, 1) IS NOT NULL, false)), false)), false)), false)"""


def _closed_sql(parts: str, kind: str) -> str:
    """Only x and y are kept; an open ring is closed."""
    return f"""transform({parts}, part -> transform(part, ring -> CASE
        WHEN {kind} LIKE '%Polygon' AND slice(element_at(ring, 1), 1, 2) != slice(element_at(ring, -1), 1, 2)
        THEN transform(concat(ring, array(element_at(ring, 1))), v -> slice(v, 1, 2))
        ELSE transform(ring, v -> slice(v, 1, 2)) END))"""


def with_geometry(df: DataFrame, text: Column, out: str = "geometry", python_literals: bool = True,
                  strict: bool = False) -> DataFrame:
    """Add geometry column ``out`` parsed from GeoJSON text.

    Robust mode: NULL/empty -> NULL; JSON; Python-literal dict (single quotes, tuples)
    as fallback, with the trailing commas Python prints; anything else -> NULL: bad text,
    empty or malformed coordinates.  All seven types of GeoJSON are kept; a
    GeometryCollection holds the parts of its members (collections within it: one level), one member
    that cannot be read makes it NULL, and an empty one has no parts and meets nothing.
    ``strict=True`` accepts only ``{...}`` JSON with double quotes.  Each ``from_json`` is its own
    projected column, so it runs once per row (Catalyst does not inline a non-cheap expression
    that is referenced several times).
    """
    opts = {"allowSingleQuotes": "false" if strict else ("true" if python_literals else "false")}
    t = F.trim(text)
    ok = t.isNotNull() & (t != "")
    if strict:
        ok = ok & t.startswith("{")
    d = df.withColumn("_g_t", F.when(ok, t))
    d = d.withColumn("_g_raw", F.from_json("_g_t", _RAW_DDL, opts))
    if python_literals and not strict:
        d = d.withColumn("_g_raw", F.when(F.col("_g_raw.type").isNull() & F.col("_g_t").isNotNull(),
                                          F.from_json(_brackets(F.col("_g_t")), _RAW_DDL, opts))
                                    .otherwise(F.col("_g_raw")))
    typ, coords = F.col("_g_raw.type"), F.col("_g_raw.coordinates")
    raw = {}
    for depth in sorted(set(_DEPTHS.values())):
        kinds = [k for k, v in _DEPTHS.items() if v == depth]
        raw[f"_g_{depth}"] = F.when(typ.isin(kinds), F.from_json(coords, "array<" * depth + "double" + ">" * depth))
    d = d.withColumns(raw)
    d = d.withColumn("_g_parts", F.expr(_parts_sql("_g_raw.type", {k: f"_g_{k}" for k in set(_DEPTHS.values())})))
    clean = F.expr(_closed_sql("_g_parts", "_g_raw.type"))
    geom = F.when(F.expr(_sound_sql("_g_parts", "_g_raw.type")), F.struct(typ.alias("type"), clean.alias("parts")))
    # Members of collections, each parsed as a geometry of its own; a nested collection gives its members.
    member = "array<struct<type:string,coordinates:string,geometries:array<struct<type:string,coordinates:string>>>>"
    d = d.withColumn("_g_of", F.when(typ == "GeometryCollection", F.from_json("_g_raw.geometries", member, opts)))
    d = d.withColumn("_g_of", F.expr("""flatten(transform(_g_of, m -> CASE WHEN m.type = 'GeometryCollection' THEN m.geometries
        ELSE array(named_struct('type', m.type, 'coordinates', m.coordinates)) END))"""))
    read = {k: f"from_json(m.coordinates, '{'array<' * k}double{'>' * k}')" for k in set(_DEPTHS.values())}
    d = d.withColumn("_g_of", F.expr(
        f"transform(_g_of, m -> named_struct('type', m.type, 'parts', {_parts_sql('m.type', read)}))"))
    # A closed line is kept as two, so that only rings of areas are closed in a collection.
    lines = _closed_sql("m.parts", "m.type")
    whole = (f"flatten(transform(_g_of, m -> CASE WHEN m.type LIKE '%LineString' THEN flatten(transform({lines}, p -> "
             "CASE WHEN size(p[0]) > 2 AND p[0][0] = element_at(p[0], -1) "
             "THEN array(array(slice(p[0], 1, 2)), array(slice(p[0], 2, size(p[0]) - 1))) ELSE array(p) END)) "
             f"ELSE {lines} END))")
    fit = F.expr(f"_g_of IS NOT NULL AND forall(_g_of, m -> {_sound_sql('m.parts', 'm.type')})")
    collected = F.when(F.coalesce(fit, F.lit(False)), F.struct(typ.alias("type"), F.expr(whole).alias("parts")))
    d = d.withColumn(out, F.when(typ == "GeometryCollection", collected).otherwise(geom))
    return d.drop("_g_t", "_g_raw", *raw, "_g_parts", "_g_of")


def keep_valid(df: DataFrame, geom: str = "geometry") -> DataFrame:
    """Drop rows whose geometry is NULL.

    Done with a generator (explode of a filtered one-element array) rather than a
    Filter: a Filter on a derived column is pushed below the projections that build
    it, with the parse expression substituted in (and multiplied per staged column);
    a Generate is a barrier, so the parse runs exactly once per row.
    """
    return df.withColumn(geom, F.explode(F.filter(F.array(F.col(geom)), lambda g: g.isNotNull())))


def point(x: Column, y: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"),
                    F.array(F.array(F.array(F.array(x.cast("double"), y.cast("double"))))).alias("parts"))


def rectangle(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    ring = F.array(F.array(minx, miny), F.array(maxx, miny), F.array(maxx, maxy),
                   F.array(minx, maxy), F.array(minx, miny))
    return F.struct(F.lit("Polygon").alias("type"), F.array(F.array(ring)).alias("parts"))


def _points(geom_sql: str) -> str:
    return f"flatten(flatten({geom_sql}.parts))"


def bbox(geom: str) -> dict[str, Column]:
    """minx, miny, maxx, maxy of a geometry column named ``geom``."""
    pts = _points(f"`{geom}`")
    return {
        "minx": F.expr(f"array_min(transform({pts}, p -> p[0]))"),
        "miny": F.expr(f"array_min(transform({pts}, p -> p[1]))"),
        "maxx": F.expr(f"array_max(transform({pts}, p -> p[0]))"),
        "maxy": F.expr(f"array_max(transform({pts}, p -> p[1]))"),
    }


def edges(geom: str) -> Column:
    """array<array<double>> of segments [ax, ay, bx, by] over every ring; a point is a segment of length 0."""
    return F.expr(
        f"flatten(transform(flatten(`{geom}`.parts), r -> "
        f"CASE WHEN size(r) = 1 THEN array(array(r[0][0], r[0][1], r[0][0], r[0][1])) ELSE "
        f"transform(sequence(0, size(r) - 2), i -> array(r[i][0], r[i][1], r[i + 1][0], r[i + 1][1])) END))")


def area_edges(geom: str, edges_col: str) -> Column:
    """The segments that bound an area: those of polygons; in a collection, of its closed parts."""
    closed = F.expr(f"flatten(transform(flatten(filter(`{geom}`.parts, p -> size(p[0]) > 3 AND p[0][0] = element_at(p[0], -1))), r -> "
                    "transform(sequence(0, size(r) - 2), i -> array(r[i][0], r[i][1], r[i + 1][0], r[i + 1][1]))))")
    return (F.when(F.col(f"`{geom}`.type").isin("Polygon", "MultiPolygon"), F.col(edges_col))
            .when(F.col(f"`{geom}`.type") == "GeometryCollection", closed)
            .otherwise(F.array().cast("array<array<double>>")))


def anchors(geom: str) -> Column:
    """One vertex per part (enough for containment tests once no edges cross)."""
    return F.expr(f"transform(`{geom}`.parts, p -> p[0][0])")


def _on_segment(e: str, p: str) -> str:
    return (f"(({e}[2] - {e}[0]) * ({p}[1] - {e}[1]) - ({e}[3] - {e}[1]) * ({p}[0] - {e}[0]) = 0"
            f" AND {p}[0] BETWEEN least({e}[0], {e}[2]) AND greatest({e}[0], {e}[2])"
            f" AND {p}[1] BETWEEN least({e}[1], {e}[3]) AND greatest({e}[1], {e}[3]))")


def _crosses_ray(e: str, p: str) -> str:
    return (f"((({e}[1] > {p}[1]) != ({e}[3] > {p}[1])) AND "
            f"{p}[0] < try_divide(({e}[2] - {e}[0]) * ({p}[1] - {e}[1]), ({e}[3] - {e}[1])) + {e}[0])")


def _point_in(edges_sql: str, p: str, tag: str, beyond: tuple[str, str] | None = None) -> str:
    """Point in polygon set given by its edges, boundary included (even-odd rule).

    ``beyond`` (flag, heights) stands for edges to the right that are not listed: the ray meets an odd
    number of them when the flag differs from the parity of the heights above the point.
    """
    e1, e2, acc, t = f"e_{tag}1", f"e_{tag}2", f"acc_{tag}", f"t_{tag}"
    start = f"({beyond[0]} != (size(filter({beyond[1]}, {t} -> {t} > {p}[1])) % 2 = 1))" if beyond else "false"
    return (f"(exists({edges_sql}, {e1} -> {_on_segment(e1, p)}) OR "
            f"aggregate({edges_sql}, {start}, ({acc}, {e2}) -> {acc} != coalesce({_crosses_ray(e2, p)}, false)))")


def _orient(e: str, x: str, y: str) -> str:
    return f"signum(({e}[2] - {e}[0]) * ({y} - {e}[1]) - ({e}[3] - {e}[1]) * ({x} - {e}[0]))"


def _segments_touch(e: str, f: str) -> str:
    return (f"({_orient(e, f + '[0]', f + '[1]')} * {_orient(e, f + '[2]', f + '[3]')} <= 0 AND "
            f"{_orient(f, e + '[0]', e + '[1]')} * {_orient(f, e + '[2]', e + '[3]')} <= 0 AND "
            f"greatest({e}[0], {e}[2]) >= least({f}[0], {f}[2]) AND greatest({f}[0], {f}[2]) >= least({e}[0], {e}[2]) AND "
            f"greatest({e}[1], {e}[3]) >= least({f}[1], {f}[3]) AND greatest({f}[1], {f}[3]) >= least({e}[1], {e}[3]))")


def intersects_sql(edges_a: str, anchors_a: str, edges_b: str, anchors_b: str,
                   area_a: str | None = None, area_b: str | None = None,
                   beyond_b: tuple[str, str] | None = None) -> str:
    """Boundary-inclusive intersects given edges, anchors and the edges that bound areas.

    ``beyond_b``: see ``_point_in``, for a side b of which only the edges near a are listed.
    """
    return (f"(exists({anchors_a}, pa -> {_point_in(area_b or edges_b, 'pa', 'b', beyond_b)}) OR "
            f"exists({anchors_b}, pb -> {_point_in(area_a or edges_a, 'pb', 'a')}) OR "
            f"exists({edges_a}, ea -> exists({edges_b}, eb -> {_segments_touch('ea', 'eb')})))")


def point_in_geometry(geom: str, x: str, y: str) -> Column:
    """Point (columns ``x``, ``y``) in (multi)polygon column ``geom``, boundary included."""
    e = (f"flatten(transform(flatten(`{geom}`.parts), r -> CASE WHEN size(r) < 2 THEN array() ELSE "
         f"transform(sequence(0, size(r) - 2), i -> array(r[i][0], r[i][1], r[i + 1][0], r[i + 1][1])) END))")
    return F.expr(_point_in(e, f"array(double(`{x}`), double(`{y}`))", "p"))


def to_web_mercator(geom: Column) -> Column:
    """EPSG:4326 -> EPSG:3857 on every vertex (latitude clamped to the Mercator limit)."""
    def proj(p):
        lat = F.greatest(F.least(p[1], F.lit(MERCATOR_MAX_LAT)), F.lit(-MERCATOR_MAX_LAT))
        return F.array(F.lit(EARTH_RADIUS_M) * F.radians(p[0]),
                       F.lit(EARTH_RADIUS_M) * F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)))
    parts = F.transform(geom.getField("parts"),
                        lambda part: F.transform(part, lambda ring: F.transform(ring, proj)))
    return F.when(geom.isNotNull(), F.struct(geom.getField("type").alias("type"), parts.alias("parts")))


def from_web_mercator(geom: Column) -> Column:
    """EPSG:3857 -> EPSG:4326 on every vertex."""
    def proj(p):
        return F.array(F.degrees(p[0] / F.lit(EARTH_RADIUS_M)),
                       F.degrees(F.lit(2.0) * F.atan(F.exp(p[1] / F.lit(EARTH_RADIUS_M))) - F.lit(math.pi / 2)))
    parts = F.transform(geom.getField("parts"),
                        lambda part: F.transform(part, lambda ring: F.transform(ring, proj)))
    return F.when(geom.isNotNull(), F.struct(geom.getField("type").alias("type"), parts.alias("parts")))


def convert(geom: Column, source: str, target: str) -> Column:
    """A geometry from one CRS to another; codes that mean the same are the same CRS."""
    codes = {"4326": "lonlat", "4269": "lonlat", "3857": "mercator", "900913": "mercator", "102100": "mercator"}
    a, b = (codes.get(c.split(":")[-1]) for c in (source, target))
    if source == target or (a and a == b):
        return geom
    if (a, b) == ("lonlat", "mercator"):
        return to_web_mercator(geom)
    if (a, b) == ("mercator", "lonlat"):
        return from_web_mercator(geom)
    raise ValueError(f"unsupported CRS pair {source} -> {target}")


def mercator_x(lon: Column) -> Column:
    return F.lit(EARTH_RADIUS_M) * F.radians(lon)


def mercator_y(lat: Column) -> Column:
    lat = F.greatest(F.least(lat, F.lit(MERCATOR_MAX_LAT)), F.lit(-MERCATOR_MAX_LAT))
    return F.lit(EARTH_RADIUS_M) * F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def to_geojson(geom: Column) -> Column:
    """Geometry struct -> GeoJSON geometry text."""
    parts, kind = geom.getField("parts"), geom.getField("type")
    coords = (F.when(kind == "Point", F.to_json(parts[0][0][0]))
               .when(kind == "MultiPoint", F.to_json(F.transform(parts, lambda p: p[0][0])))
               .when(kind == "LineString", F.to_json(parts[0][0]))
               .when(kind == "MultiLineString", F.to_json(F.transform(parts, lambda p: p[0])))
               .when(kind == "Polygon", F.to_json(parts[0]))
               .otherwise(F.to_json(parts)))

    def member(p):
        """A part of a collection: closed rings are areas, single vertices points, the rest lines."""
        ring = p[0]
        return (F.when(F.size(ring) == 1, F.concat(F.lit('{"type":"Point","coordinates":'), F.to_json(ring[0])))
                .when((F.size(ring) > 3) & (ring[0] == F.element_at(ring, -1)),
                      F.concat(F.lit('{"type":"Polygon","coordinates":'), F.to_json(p)))
                .otherwise(F.concat(F.lit('{"type":"LineString","coordinates":'), F.to_json(ring))))
    inner = F.array_join(F.transform(parts, lambda p: F.concat(member(p), F.lit("}"))), ",")
    return (F.when(kind == "GeometryCollection", F.concat(F.lit('{"type":"GeometryCollection","geometries":['), inner, F.lit("]}")))
            .when(geom.isNotNull(), F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), coords, F.lit("}"))))


def snap_to_grid(df: DataFrame, id_col: str, scale: float, geom: str = "geometry") -> DataFrame:
    """(cell_row, cell_col, id, n): per grid cell the geometry whose bbox centre is nearest to the cell's.

    Every geometry type counts by the centre of its bbox (a point by itself); ties go to the
    smaller id.
    """
    bb = bbox(geom)
    d = df.select(id_col, ((bb["minx"] + bb["maxx"]) / 2).alias("_x"), ((bb["miny"] + bb["maxy"]) / 2).alias("_y"))
    d = d.withColumns({"cell_row": F.floor(F.col("_y") / scale), "cell_col": F.floor(F.col("_x") / scale)})
    d2 = ((F.col("_x") - (F.col("cell_col") * scale + scale / 2)) ** 2
          + (F.col("_y") - (F.col("cell_row") * scale + scale / 2)) ** 2)
    return d.groupBy("cell_row", "cell_col").agg(
        F.min_by(F.col(f"`{id_col}`"), F.struct(d2, F.col(f"`{id_col}`"))).alias(id_col), F.count(F.lit(1)).alias("n"))


def sphere_rectangle_area(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Area of a lon/lat rectangle on a sphere, km^2."""
    return (F.lit(EARTH_RADIUS_M ** 2) * F.radians(maxx - minx)
            * (F.sin(F.radians(maxy)) - F.sin(F.radians(miny))) / F.lit(1e6))


def authority_code(crs: Column) -> Column:
    """Numeric code of a CRS name such as ``EPSG:3857``; NULL without one."""
    return F.nullif(F.regexp_extract(crs, r":(\d+)$", 1), F.lit("")).cast("int")


def sphere_rectangle_area_km2(w: float, s: float, e: float, n: float, radius_m: float = EARTH_RADIUS_M) -> float:
    """Area of a lon/lat rectangle on a sphere, km^2."""
    return radius_m ** 2 * math.radians(e - w) * (math.sin(math.radians(n)) - math.sin(math.radians(s))) / 1e6
