"""Exact spatial join (boundary-inclusive intersects) as one grid-cell equi-join.

Plan
  * a cell at level k is ``2^(base + k)`` wide; a left geometry has the level a whose cells it
    fits in, a zone the level f of the finest grid it is kept on;
  * the two meet on the grid of level g = max(a, f).  The left geometry goes to ONE cell there, that of its
    bbox's lower-left corner, so it lies in the block of 2 x 2 cells to the upper right, and a zone has
    a record in every cell whose block it touches.  Every (left, zone) pair meets in exactly one cell: no
    duplicates, no distinct, and a wide geometry on either side coarsens only its own grid;
  * a zone of few edges is kept whole on the grid of its own extent (at most nine records);
  * a zone of many edges is covered by finer cells, about as many across as the root of its edges.  Cells whose block
    lies inside it need no exact test; cells at its border carry only the edges that touch
    the block, and, for the ray of the point test, the parity of all edges further right: a flag
    and the heights at which it changes (ends of chains of edges; only comparisons of given
    coordinates, so results equal those of a walk around the whole ring);
  * join condition = cell equality, then bbox overlap, then the exact predicate (SQL higher-order
    functions, see functions/geometry.py).
Where zones have several levels a left row is copied to its few grids (``inner``), or the levels are
joined one after the other (``left_anti``).  Hot cells are the large side of an equi-join, which adaptive
execution splits.  Zone records are broadcast only while they stay below a limit.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import cut_lineage

# Python workers do not have to import this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Levels above the finest; wider geometries would not fit any coordinate range.
MAX_LEVEL = 60
#: Zones of more edges are covered by cells.
CLIP_EDGES = 48
#: Edges that the cover of a zone hands on at a time.
OUT_EDGES = 100_000
#: Zones given edge by edge: a left geometry takes up to 2^FINER + 1 columns, rather than edges more grids.
FINER = 4
#: Edges of one extent that are broadcast: few wide ones would bring all left rows together in their columns.
FEW_EDGES = 2_000


def _prep(df: DataFrame, geom: str, prefix: str) -> DataFrame:
    bb = G.bbox(geom)
    d = df.withColumns({
        f"{prefix}minx": bb["minx"], f"{prefix}miny": bb["miny"],
        f"{prefix}maxx": bb["maxx"], f"{prefix}maxy": bb["maxy"],
        f"{prefix}edges": G.edges(geom), f"{prefix}anchors": G.anchors(geom)})
    return d.withColumn(f"{prefix}area", G.area_edges(geom, f"{prefix}edges"))


def _condition(clipped: bool):
    overlap = ((F.col("_l_minx") <= F.col("_r_maxx")) & (F.col("_l_maxx") >= F.col("_r_minx")) &
               (F.col("_l_miny") <= F.col("_r_maxy")) & (F.col("_l_maxy") >= F.col("_r_miny")))
    exact = F.expr(G.intersects_sql("_l_edges", "_l_anchors", "_r_edges", "_r_anchors", "_l_area", "_r_area",
                                    ("_r_odd", "_r_turns") if clipped else None))
    return overlap & ((F.col("_r_full") | exact) if clipped else exact)


def _extent(prefix: str):
    return F.greatest(F.col(f"{prefix}maxx") - F.col(f"{prefix}minx"), F.col(f"{prefix}maxy") - F.col(f"{prefix}miny"))


def power(extent):
    """Smallest k with extent <= 2^k; null for extent 0 and for a null geometry."""
    k = F.ceil(F.log2(extent))
    # The logarithm may be off by an ulp at exact powers: one level up is always safe.
    return F.when(extent > F.pow(F.lit(2.0), k), k + 1).otherwise(k).cast("int")


def _level(prefix: str, base: int, least: int = 0):
    """Level of a geometry on grids whose cells of level 0 are 2^base wide; at least ``least``."""
    return F.least(F.greatest(F.coalesce(power(_extent(prefix)) - F.lit(base), F.lit(least)), F.lit(least)), F.lit(MAX_LEVEL))


def _depth(edges: str, clip_edges: int):
    """How many levels below its extent a zone is covered: 2^depth is about the root of its edges; 0: kept whole.

    A collection stays whole, as only some of its edges bound an area.
    """
    return F.when((F.size(edges) > clip_edges) & (F.col("_r_geom.type") != "GeometryCollection"), 2 * F.greatest(F.lit(1), F.round(F.log2(F.size(edges)) / 4))).otherwise(0).cast("int")


def _finest(sizes: Sequence, cell_size: float | None) -> int:
    """Exponent of the cells of level 0: the median zone's extent, or ``cell_size`` if given."""
    if cell_size:
        return math.ceil(math.log2(cell_size))
    known = sorted((r["k"], r["n"]) for r in sizes if r["k"] is not None)
    half, seen = sum(n for _, n in known) / 2, 0
    for k, n in known:
        seen += n
        if seen >= half:
            return k
    return 0


# --- cover of a zone by cells ---------------------------------------------------------------------------------------


def _strips(edges: np.ndarray, w: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(block row, edge, first and last cell) of every edge in every row of blocks it touches.

    A block row R is the strip between R*w and (R+2)*w.  What lies within a millionth of a
    cell's width counts as touching, so edges left out are clear of the block.
    """
    ax, ay, bx, by = edges.T
    m = w * 1e-6
    low = np.floor((np.minimum(ay, by) - m) / w).astype(np.int64)
    count = np.floor((np.maximum(ay, by) + m) / w).astype(np.int64) - low + 1
    e = np.repeat(np.arange(len(edges)), count)
    row = np.repeat(low, count) + np.arange(len(e)) - np.repeat(np.cumsum(count) - count, count)
    dy = (by - ay)[e]
    flat = dy == 0
    slope = np.where(flat, 1.0, dy)
    t = np.stack([(row * w - m - ay[e]) / slope, ((row + 1) * w + m - ay[e]) / slope])
    t = np.where(flat, np.array([[0.0], [1.0]]), np.clip(t, 0.0, 1.0))
    x = ax[e] + t * (bx - ax)[e]
    first = np.floor((x.min(0) - m) / w).astype(np.int64)
    last = np.floor((x.max(0) + m) / w).astype(np.int64)
    # A cell row belongs to two rows of blocks; an edge in both cell rows of a block row counts once.
    row, e = np.concatenate([row, row - 1]), np.concatenate([e, e])
    first, last = np.concatenate([first, first]), np.concatenate([last, last])
    order = np.lexsort((e, row))
    row, e, first, last = row[order], e[order], first[order], last[order]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (e[1:] != e[:-1])]))
    return row[new], e[new], np.minimum.reduceat(first, new), np.maximum.reduceat(last, new)


def cover(edges: np.ndarray, w: float, area: bool) -> Iterator[tuple]:
    """(cx, cy, full, edge numbers, turns, odd) for every cell of width ``w`` whose block of 2 x 2 cells a zone touches.

    ``full``: the block lies inside the zone.  Else ``edge numbers`` touch the block, and a ray to the
    right meets, besides them, an odd number of edges when ``odd`` differs from the parity of the
    ``turns`` above it.
    """
    row, e, first, last = _strips(edges, w)
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    for a, b in zip(starts.tolist(), np.append(starts[1:], len(row)).tolist()):
        cy, some, lo, hi = int(row[a]), e[a:b], first[a:b], last[a:b]
        top = (cy + 2) * w
        cells = np.arange(lo.min() - 1, hi.max() + 1)
        touched = np.zeros(len(cells) + 1, np.int64)
        np.add.at(touched, lo - 1 - cells[0], 1)
        np.add.at(touched, hi + 1 - cells[0], -1)
        touched = np.cumsum(touched)[:-1] > 0
        if area:
            by_first = np.argsort(lo, kind="stable")
            ends = edges[some[by_first]][:, [1, 3]]
            # Ends above the block among the edges right of a cell's block, which start at cell + 2 or later.
            above = np.concatenate([np.cumsum((ends > top).sum(1)[::-1])[::-1], [0]])
            beyond = np.searchsorted(lo[by_first], cells + 2)
            odd = above[beyond] % 2 == 1
            for cx in cells[~touched & odd].tolist():
                yield cx, cy, True, some[:0], (), False
        for k in np.flatnonzero(touched).tolist():
            cx = int(cells[k])
            listed = some[(lo - 1 <= cx) & (cx <= hi)]
            if not area:
                yield cx, cy, False, listed, (), False
                continue
            y, n = np.unique(ends[beyond[k]:], return_counts=True)
            y = y[(n % 2 == 1) & (y >= cy * w) & (y <= top)]
            yield cx, cy, False, listed, y, bool(odd[k])


def _cover_rows(base: int):
    """mapInArrow function: zones (_zk, _f, _z, _poly, _grids, edges) to their records on every grid finer than their extent."""
    schema = pa.schema([("_zk", pa.int64()), ("_f", pa.int32()), ("_g", pa.int32()), ("_cx", pa.int64()), ("_cy", pa.int64()),
                        ("_r_full", pa.bool_()), ("_r_edges", pa.list_(pa.list_(pa.float64()))),
                        ("_r_turns", pa.list_(pa.float64())), ("_r_odd", pa.bool_())])

    def batch(held: list, edges: list, turns: list) -> pa.RecordBatch:
        cols = list(zip(*held))
        sizes = np.array([len(x) for x in edges])
        flat = np.concatenate(edges) if sizes.sum() else np.empty((0, 4))
        quads = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * 4), pa.array(flat.ravel()))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), quads)
        arrays = [pa.array(c, f.type) for c, f in zip(cols[:6], schema)]
        return pa.RecordBatch.from_arrays([*arrays, lists, pa.array(turns, schema.field("_r_turns").type),
                                           pa.array(cols[6], pa.bool_())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]):
        held, edges, turns, size = [], [], [], 0
        for b in batches:
            for i in range(b.num_rows):
                zk, f, poly, grids = (b.column(c)[i].as_py() for c in range(4))
                flat = b.column(4)[i].values.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
                for g in grids:
                    for cx, cy, full, some, turn, odd in cover(flat, 2.0 ** (base + g), poly):
                        held.append((zk, f, g, cx, cy, full, odd))
                        edges.append(flat[some])
                        turns.append(list(turn))
                        size += len(some) + 1
                        if size > OUT_EDGES:
                            yield batch(held, edges, turns)
                            held, edges, turns, size = [], [], [], 0
        if held:
            yield batch(held, edges, turns)

    return run, ("_zk long, _f int, _g int, _cx long, _cy long, _r_full boolean, _r_edges array<array<double>>, "
                 "_r_turns array<double>, _r_odd boolean")


def _records(R: DataFrame, base: int, lefts: list[int], clipped: bool) -> DataFrame:
    """Zone records by grid and cell: whole zones in up to nine cells, covered zones in the cells they touch."""
    def cell(value):
        return F.floor(value / F.pow(F.lit(2.0), F.col("_g").cast("double") + F.lit(float(base))))

    width = F.pow(F.lit(2.0), F.col("_g").cast("double") + F.lit(float(base)))
    grids = F.array_distinct(F.transform(F.array(*[F.lit(a) for a in lefts]), lambda a: F.greatest(a, F.col("_f"))))
    R = R.withColumn("_grids", grids)
    whole = (R.withColumn("_g", F.explode(F.filter("_grids", lambda g: g >= F.col("_z")) if clipped else F.col("_grids")))
             .withColumn("_cx", F.explode(F.sequence(cell(F.col("_r_minx") - width), cell(F.col("_r_maxx")))))
             .withColumn("_cy", F.explode(F.sequence(cell(F.col("_r_miny") - width), cell(F.col("_r_maxy"))))).drop("_grids"))
    if not clipped:
        return whole
    run, ddl = _cover_rows(base)
    polygon = F.col("_r_kind").isin("Polygon", "MultiPolygon")
    fine = (R.where(F.col("_f") < F.col("_z"))
            .select("_zk", "_f", polygon.alias("_poly"), F.filter("_grids", lambda g: g < F.col("_z")).alias("_grids"), "_r_edges")
            .where(F.size("_grids") > 0).repartition(F.col("_zk")).mapInArrow(run, ddl))
    box = R.select("_zk", polygon.alias("_poly"), "_r_minx", "_r_miny", "_r_maxx", "_r_maxy")
    fine = (fine.join(box, "_zk")
            .withColumn("_r_anchors", F.transform("_r_edges", lambda e: F.slice(e, 1, 2)))
            .withColumn("_r_area", F.when(F.col("_poly"), F.col("_r_edges")).otherwise(F.array().cast("array<array<double>>"))).drop("_poly"))
    whole = (whole.withColumn("_r_full", F.lit(False)).withColumn("_r_odd", F.lit(False))
             .withColumn("_r_turns", F.array().cast("array<double>")))
    return whole.select(fine.columns).unionByName(fine)


# --- zones given edge by edge -----------------------------------------------------------------------------------------


def _edge_join(left: DataFrame, right: DataFrame, how: str, left_geom: str, edges: Sequence[str]) -> DataFrame:
    """``spatial_join`` with zones of any size, as rows of their edges; the other columns name the zone.

    Edges and left geometries meet in columns of the axis that a line across crosses fewest edges of.  A pair meets on
    the grid of the wider one's extent, so an edge has at most two records per grid and a left geometry ``2^FINER + 1``.  A left
    geometry meets a zone where one of its edges touches, or has its start inside, or where an odd number of the zone's
    edges lies beyond an anchor: these are summed over the rows, so that no task holds a zone.
    """
    along, across = ("x", "y")
    names = dict(zip(("ax", "ay", "bx", "by"), edges))
    zone = [c for c in right.columns if c not in edges]
    E = right.select(*[F.col(f"`{c}`").alias(f"_z{k}") for k, c in enumerate(zone)],
                     *[F.col(f"`{c}`").cast("double").alias(f"_{k}") for k, c in names.items()]).where("_ax IS NOT NULL AND _ay IS NOT NULL AND _bx IS NOT NULL AND _by IS NOT NULL")
    E = cut_lineage(E)
    reach = E.agg(*[f(F.abs(F.col(f"_b{c}") - F.col(f"_a{c}"))).alias(f"s{c}") for c in "xy" for f in (F.sum,)],
                  *[(F.max(F.greatest(f"_a{c}", f"_b{c}")) - F.min(F.least(f"_a{c}", f"_b{c}"))).alias(f"w{c}") for c in "xy"]).first()
    stabs = {c: (reach[f"s{c}"] or 0.0) / (reach[f"w{c}"] or 1.0) for c in "xy"}
    if stabs["y"] < stabs["x"]:
        along, across = across, along
    L = cut_lineage(left.withColumn("_row", F.monotonically_increasing_id()))
    # One row per part, for its anchor; the first also stands for the geometry's own edges.
    P = _prep(L.select("_row", F.col(f"`{left_geom}`").alias("_geom")).withColumn("_geom", F.explode(F.array("_geom"))), "_geom", "_l_")
    first = F.col("_part") == 0
    at = {"x": 0, "y": 1}
    quads = F.array().cast("array<array<double>>")
    P = P.select("*", F.posexplode("_l_anchors").alias("_part", "_p")).select(
        "_row", "_part", "_p", F.when(first, F.col("_l_edges")).otherwise(quads).alias("_l_edges"), F.when(first, F.col("_l_area")).otherwise(quads).alias("_l_area"),
        *[F.when(first, F.col(f"_l_{m}{c}")).otherwise(F.col("_p")[at[c]]).alias(f"_l_{m}{c}") for m in ("min", "max") for c in "xy"])
    P = cut_lineage(P)

    low, high = F.least(f"_a{along}", f"_b{along}"), F.greatest(f"_a{along}", f"_b{along}")
    counts = {r["k"]: r["n"] for r in E.select(power(high - low).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    base = _finest([{"k": k, "n": n} for k, n in counts.items()], None)
    level = lambda extent, finer=0: F.least(F.greatest(F.coalesce(power(extent) - F.lit(base + finer), F.lit(0)), F.lit(0)), F.lit(MAX_LEVEL))
    of = lambda k: min(max((k if k is not None else base) - base, 0), MAX_LEVEL)
    few: dict[int, int] = {}
    for k, n in counts.items():
        few[of(k)] = few.get(of(k), 0) + n
    width = F.col(f"_l_max{along}") - F.col(f"_l_min{along}")
    P = P.withColumn("_a", level(width, FINER))
    grids = sorted(r[0] for r in P.select("_a").distinct().collect())
    E = E.withColumn("_f", level(high - low))

    def column(value):
        return F.floor(value / F.pow(F.lit(2.0), F.col("_g").cast("double") + F.lit(float(base)))).cast("long")

    def placed(df, levels, own, a, b):
        every = F.array_distinct(F.transform(F.array(*[F.lit(v) for v in levels]), lambda v: F.greatest(v, F.col(own))))
        df = df.withColumn("_g", F.explode(every))
        return df.withColumn("_c", F.explode(F.sequence(column(a), column(b))))

    overlap = " AND ".join(f"_l_min{c} <= greatest(_a{c}, _b{c}) AND _l_max{c} >= least(_a{c}, _b{c})" for c in "xy")
    touch = (f"({overlap}) AND (exists(_l_edges, ea -> {G._segments_touch('ea', 'eb')}) OR {G._point_in('_l_area', 'pb', 'a')})")
    hit = F.expr(f"exists(array(array(_ax, _ay, _bx, _by)), eb -> exists(array(array(_ax, _ay)), pb -> {touch}))")
    p, q, n, m = (f"_p[{at[along]}]", f"_p[{at[across]}]", along, across)
    beyond = F.expr(f"coalesce((_a{n} > {p}) != (_b{n} > {p}) AND {q} < try_divide((_b{m} - _a{m}) * ({p} - _a{n}), (_b{n} - _a{n})) + _a{m}, false)")
    keys = [f"_z{k}" for k in range(len(zone))]

    def met(levels: list[int], small: bool) -> DataFrame:
        edges_ = placed(E.where(F.col("_f").isin(levels)), grids, "_f", low, high)
        edges_ = edges_.withColumnsRenamed({"_g": "_eg", "_c": "_ec"}).withColumnRenamed("_f", "_ef")
        parts = placed(P.withColumn("_lf", F.explode(F.array(*[F.lit(v) for v in levels]))).withColumn("_own", F.greatest("_a", "_lf")),
                       [0], "_own", F.col(f"_l_min{along}"), F.col(f"_l_max{along}"))
        parts = parts.withColumn("_here", column(F.expr(p)) == F.col("_c"))
        on = (F.col("_g") == F.col("_eg")) & (F.col("_c") == F.col("_ec")) & (F.col("_lf") == F.col("_ef"))
        pairs = parts.join(F.broadcast(edges_) if small else edges_, on)
        return pairs.select("_row", "_part", *keys, hit.alias("_hit"), (F.col("_here") & beyond).alias("_odd")).where("_hit OR _odd")

    small = [f for f, c in few.items() if c <= FEW_EDGES]
    large = [f for f in few if f not in small]
    pairs = [met(sorted(fs), s) for fs, s in ((small, True), (large, False)) if fs and grids]
    if not pairs:
        hits = L.select("_row", *[F.lit(None).cast(right.schema[c].dataType).alias(k) for k, c in zip(keys, zone)]).limit(0)
    else:
        both = pairs[0] if len(pairs) == 1 else pairs[0].unionByName(pairs[1])
        hits = (both.groupBy("_row", "_part", *keys).agg(F.max("_hit").alias("_hit"), F.count_if("_odd").alias("_n"))
                .where("_hit OR _n % 2 = 1").select("_row", *keys).distinct())
    if how in ("left_semi", "left_anti"):
        return L.join(hits.select("_row"), "_row", how).drop("_row")
    return L.join(hits, "_row", how).select(*[F.col(f"`{c}`") for c in left.columns], *[F.col(k).alias(c) for k, c in zip(keys, zone)])


def spatial_join(left: DataFrame, right: DataFrame, how: str = "inner", left_geom: str = "geom",
                 right_geom: str = "geom", cell_size: float | None = None, broadcast_vertex_limit: int = 4_000_000,
                 clip_edges: int = CLIP_EDGES, left_powers: Sequence[int | None] | None = None,
                 right_edges: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``left`` joined to intersecting rows of ``right``.

    how: 'inner' | 'left' (pairs, unmatched left rows with NULL right columns) |
         'left_semi' | 'left_anti'.  Right payload columns keep their names; the right
         geometry is returned as ``right_geometry`` for pair joins.  A null geometry
         intersects nothing.  ``cell_size`` is the width of the cells of level 0 (rounded up to a
         power of two); by default the median extent of the zones.  Zones of more than
         ``clip_edges`` edges are covered by cells.  ``left_powers``: the extents of the left geometries as
         powers of two (``power``), where they are known; else they are counted.  ``right_edges``: names of the
         columns ax, ay, bx, by where ``right`` has one row per edge of areas too large for one value; its
         other columns then name the zone, and pair joins return them without a geometry.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(how)
    if right_edges:
        return _edge_join(left, right, how, left_geom, right_edges)
    q = lambda c: f"`{c}`"  # noqa: E731  (names such as '.geo' need quoting)
    lcols = left.columns
    # Geometries pass through a generator on both sides: filters on what is derived from them then
    # stop there, instead of being pushed below with the whole parse expression copied in.
    L = _prep(left.withColumn(left_geom, F.explode(F.array(F.col(q(left_geom))))), left_geom, "_l_")
    # Right columns get names of their own, so that both sides may come from one table.
    rpay = {f"_p{k}": c for k, c in enumerate(c for c in right.columns if c != right_geom)}
    R = right.select(F.col(q(right_geom)).alias("_r_geom"), *[F.col(q(c)).alias(p) for p, c in rpay.items()])
    R = _prep(G.keep_valid(R, "_r_geom"), "_r_geom", "_r_")

    # Extents of both sides by powers of two: a few dozen rows whatever the data.
    payload = F.length(F.to_json(F.struct(*rpay))) if rpay else F.lit(0)
    sizes = R.select(power(_extent("_r_")).alias("k"), _depth("_r_edges", clip_edges).alias("d"),
                     (F.size("_r_edges") + 1 + payload / 40).alias("w")).groupBy("k", "d").agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("w")).collect()
    if left_powers is None:
        left_powers = [r[0] for r in L.select(power(_extent("_l_"))).distinct().collect()]
    base = _finest(sizes, cell_size)
    z_of = lambda k: min(max((k if k is not None else base) - base, 0), MAX_LEVEL)
    f_of = {(r["k"], r["d"]): z_of(r["k"]) if not r["d"] or r["k"] is None else r["k"] - base - r["d"] for r in sizes}
    levels = sorted(set(f_of.values()))
    clipped = any(r["d"] and r["k"] is not None for r in sizes)
    least = min([0, *levels])
    lefts = sorted({min(max((k if k is not None else base + least) - base, least), MAX_LEVEL) for k in left_powers}) or [least]

    R = R.withColumn("_z", _level("_r_", base)).withColumn(
        "_f", F.when((F.col("_z") >= 0) & (_depth("_r_edges", clip_edges) > 0) & power(_extent("_r_")).isNotNull(),
                     power(_extent("_r_")) - F.lit(base) - _depth("_r_edges", clip_edges)).otherwise(F.col("_z")))
    zone_side = None
    if clipped:  # records carry a key instead of the zone's other columns, which a large geometry would multiply
        R = cut_lineage(R.withColumn("_zk", F.monotonically_increasing_id()).withColumn("_r_kind", F.col("_r_geom.type")))
        zone_side = R.select("_zk", *rpay, "_r_geom")
    records = _records(R, base, lefts, clipped)
    # Records of a whole zone: nine per grid; of a covered one: its edges in four blocks each and as many cells inside.
    weight = sum((9 * r["w"] if not r["d"] else 16 * r["w"]) for r in sizes) * len(lefts)
    small = weight <= broadcast_vertex_limit
    L = L.withColumn("_a", _level("_l_", base, least))

    def placed(df: DataFrame, f) -> DataFrame:
        def at(c):
            return F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_lg").cast("double") + F.lit(float(base))))
        return (df.withColumn("_lf", f).withColumn("_lg", F.greatest(F.col("_a"), F.col("_lf")))
                .withColumn("_lx", at("_l_minx")).withColumn("_ly", at("_l_miny")))

    on = ((F.col("_lg") == F.col("_g")) & (F.col("_lx") == F.col("_cx")) & (F.col("_ly") == F.col("_cy"))
          & (F.col("_lf") == F.col("_f")) & _condition(clipped))
    shown = [F.col(q(c)) for c in lcols]
    nulls = [*[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in rpay.values()],
             F.lit(None).cast(right.schema[right_geom].dataType).alias("right_geometry")]

    def of_level(f: int) -> DataFrame:
        own = records.where(F.col("_f") == f) if len(levels) > 1 else records
        return F.broadcast(own) if small else own

    def pairs(side: DataFrame, own: DataFrame, how_: str = "inner", also: tuple = ()) -> DataFrame:
        left_side = [F.col(q(c)) for c in (*lcols, *also)]
        hit = side.join(own, on, how_)
        if zone_side is not None:
            hit = hit.select(*left_side, F.col("_zk").alias("_hit")).join(zone_side, F.col("_hit") == F.col("_zk"), how_)
        return hit.select(*left_side, *[F.col(p).alias(c) for p, c in rpay.items()], F.col("_r_geom").alias("right_geometry"))

    if not levels:
        return (L.select(*shown) if how == "left_anti" else L.select(*shown).limit(0) if how == "left_semi"
                else L.select(*shown, *nulls) if how == "left" else L.select(*shown, *nulls).limit(0))
    if how == "left_anti":
        for f in levels:
            L = placed(L, F.lit(f)).join(of_level(f), on, "left_anti").drop("_lf", "_lg", "_lx", "_ly")
        return L.select(*shown)
    if len(levels) == 1:  # one cell per left row: any kind of join is direct
        side = placed(L, F.lit(levels[0]))
        if how == "left_semi":
            return side.join(of_level(levels[0]), on, "left_semi").select(*shown)
        return pairs(side, of_level(levels[0]), how)
    every = F.explode(F.array(*[F.lit(f) for f in levels]))
    own = F.broadcast(records) if small else records
    if how == "inner":
        return pairs(placed(L, every), own)
    # Several levels, and left rows asked for once: they are written with a number, so that they can be told apart.
    L = cut_lineage(L.withColumn("_row", F.monotonically_increasing_id()))
    if how == "left_semi":
        hits = placed(L, every).join(own, on, "left_semi").select("_row").distinct()
        return L.join(hits, "_row", "left_semi").select(*shown)
    hits = pairs(placed(L, every), own, also=("_row",))
    rest = L
    for f in levels:
        rest = placed(rest, F.lit(f)).join(of_level(f), on, "left_anti").drop("_lf", "_lg", "_lx", "_ly")
    return hits.drop("_row").unionByName(rest.select(*shown, *nulls))
