"""DuckDB oracle SQL for the registered queries (same fixture mapping as sources/fixtures.py).

Written independently of the Spark plans: plain joins, GROUP BY, a recursive CTE for the
capped connected count and neighbour self-joins for slope.
"""

from __future__ import annotations

import math
from datetime import date

from ..config import FIXTURE_SETTINGS as FS

R = '"row"'

VIEWS = {
    "s2_obs": f"""select l_orderkey as scene_id, cast((l_partkey-1)%40 as int) as col,
        cast(floor((l_partkey-1)/40) as int) as {R}, l_shipdate as ts,
        l_quantity*200 as B3, cast((l_orderkey*37+l_linenumber*11)%10000 as double) as B4,
        l_discount*100000 as B8, l_tax*100000 as B11, l_extendedprice/60 as B12 from lineitem""",
    "s2_scene": """select o_orderkey as scene_id, string_split(case when o_orderkey%17=0 then 'B3,B4,B8,B11'
        else 'B3,B4,B8,B11,B12' end, ',') as band_names from orders""",
    "s2_cloud": """select o_orderkey as scene_id, cast((o_orderkey*31)%100 as int) as probability
        from orders where o_orderkey%13<>0""",
    "s1_obs": f"""select cast((l_partkey-1)%40 as int) as col, cast(floor((l_partkey-1)/40) as int) as {R},
        l_shipdate as ts, -21+l_quantity*0.25 as VV,
        case when l_returnflag='N' then 'EW' else 'IW' end as mode,
        string_split(case when l_linestatus='F' then 'VV,VH' else 'HH' end, ',') as pols from lineitem""",
    "px_static": f"""select cast((p_partkey-1)%40 as int) as col, cast(floor((p_partkey-1)/40) as int) as {R},
        cast(p_size as double) as elevation, cast(10+10*(p_partkey%6) as int) as Map,
        cast(p_size%13 as int) as seasonality from part""",
}


def _k(start: str) -> str:
    k0 = f"datediff('month', DATE '{start}', ts)"
    return f"cast({k0} - case when ts < DATE '{start}' + to_months(cast({k0} as int)) then 1 else 0 end as int)"


def _windows(start: str, end: str) -> int:
    """Month windows of a period, worked out apart from the library: average months, rounded, tail included."""
    return int((date.fromisoformat(end) - date.fromisoformat(start)).days / 30.436875 + 0.5) + 1


N_PRE = _windows(FS.pre_start, FS.pre_end)
N_POST = _windows(FS.post_start, FS.post_end)
BANDS = ["B3", "B4", "B8", "B11", "B12"]


def _flood_ctes() -> str:
    b = ", ".join(f"case when probability < 50 then {x}/10000.0 end as {x}" for x in BANDS)
    med = ", ".join(f"median({x}) as {x}" for x in BANDS)
    comp = ", ".join(f"median({x}) filter (where period='{p}') as {x}_{p}" for p in ("pre", "post") for x in BANDS)
    guard = ", ".join(f"case when n_{p} > 0 then c.{x}_{p} else 0.0 end as {x}_{p}" for p in ("pre", "post") for x in BANDS)

    def nd(a, c, p):
        return (f"case when {a}_{p} >= 0 and {c}_{p} >= 0 then ({a}_{p} - {c}_{p}) / nullif({a}_{p} + {c}_{p}, 0) end")
    idx = []
    for p in ("pre", "post"):
        idx += [f"{nd('B3', 'B8', p)} as ndwi_{p}", f"{nd('B3', 'B11', p)} as mndwi_{p}",
                f"4*(B3_{p}-B11_{p})-(0.25*B8_{p}+2.75*B12_{p}) as awei_{p}"]
    water = ", ".join(
        f"cast((cast(ndwi_{p} > 0.3 as int) + cast(mndwi_{p} > 0.0 as int) + cast(awei_{p} > 0.0 as int)) >= 2 as int) as water_{p}"
        for p in ("pre", "post"))
    views = ",\n".join(f"{k} as ({v})" for k, v in VIEWS.items())
    return f"""{views},
valid as (select scene_id from s2_scene where len(list_distinct(list_intersect(band_names, ['B3','B4','B8','B11','B12']))) = 5),
cloud1 as (select scene_id, min(probability) as probability from s2_cloud group by scene_id),
s2j as (select o.*, c.probability from s2_obs o join cloud1 c on o.scene_id = c.scene_id
        where o.scene_id in (select scene_id from valid)
          and o.ts >= TIMESTAMP '{FS.pre_start}' and o.ts < TIMESTAMP '{FS.post_end}'),
tagged as (select * from (select s2j.*, 'pre' as period, {_k(FS.pre_start)} as k from s2j) where k between 0 and {N_PRE - 1}
           union all
           select * from (select s2j.*, 'post' as period, {_k(FS.post_start)} as k from s2j) where k between 0 and {N_POST - 1}),
masked as (select {R}, col, period, k, {b} from tagged where probability < 50),
monthly as (select {R}, col, period, k, {med} from masked group by {R}, col, period, k),
comp as (select {R}, col, {comp} from monthly group by {R}, col),
s1f as (select {R}, col, ts, VV from s1_obs where ts >= TIMESTAMP '{FS.post_start}' and ts < TIMESTAMP '{FS.post_end}'
        and list_contains(pols, 'VV') and mode = 'IW'),
sar as (select {R}, col, median(VV) as VV from s1f group by {R}, col),
counts as (select (select count(distinct k) from tagged where period='pre') as n_pre,
                  (select count(distinct k) from tagged where period='post') as n_post,
                  (select count(*) from s1f) as n_s1),
stack as (select p.{R}, p.col, p.elevation, p.Map, p.seasonality, {guard},
                 case when n_s1 > 0 then s.VV else 0.0 end as VV
          from px_static p left join comp c on p.{R} = c.{R} and p.col = c.col
          left join sar s on p.{R} = s.{R} and p.col = s.col cross join counts),
idx as (select *, {", ".join(idx)}, cast(VV < -17 as int) as s1_water from stack),
water as (select *, {water} from idx),
chg as (select *, water_post*water_pre*3 + water_post*(1-water_pre)*2 + water_pre*(1-water_post) as change,
               water_post*(1-water_pre) as flood_map,
               cast(water_post*(1-water_pre) + s1_water >= 1 as int) as combined_flood from water),
cc_src as (select {R} as r, col as c, combined_flood as v from chg where combined_flood is not null),
reach(r0, c0, v0, r, c, d) as (
    select r, c, v, r, c, 0 from cc_src
    union
    select reach.r0, reach.c0, reach.v0, n.r, n.c, reach.d + 1
    from reach cross join (values (0, 1), (0, -1), (1, 0), (-1, 0)) o(dr, dc)
    join cc_src n on n.r = reach.r + o.dr and n.c = reach.c + o.dc and n.v = reach.v0
    where reach.d < {FS.min_component - 1}),
cnt as (select r0 as {R}, c0 as col, v0 as combined_flood, cast(least(count(distinct (r, c)), {FS.min_component}) as int) as count
        from reach group by r0, c0, v0),
ff as (select cnt.{R}, cnt.col, case when cnt.count >= {FS.min_component} and p.Map <> 50 and p.seasonality < 10
                                    then cnt.combined_flood end as flood
       from cnt join px_static p on cnt.{R} = p.{R} and cnt.col = p.col),
sl as (select p.{R}, p.col, degrees(atan(sqrt(((xp.elevation - xm.elevation) / 60.0) * ((xp.elevation - xm.elevation) / 60.0)
                                             + ((yp.elevation - ym.elevation) / 60.0) * ((yp.elevation - ym.elevation) / 60.0)))) as slope
       from px_static p
       left join px_static xp on xp.{R} = p.{R} and xp.col = p.col + 1
       left join px_static xm on xm.{R} = p.{R} and xm.col = p.col - 1
       left join px_static yp on yp.{R} = p.{R} + 1 and yp.col = p.col
       left join px_static ym on ym.{R} = p.{R} - 1 and ym.col = p.col)"""


def _with(body: str, recursive: bool = True, aoi: tuple | None = None, outer: bool = False) -> str:
    ctes = _flood_ctes()
    if aoi is not None:
        w, s_, e, n = aoi
        for v in ("s2_obs", "s1_obs", "px_static"):
            ctes = ctes.replace(f"{v} as ({VIEWS[v]})",
                                f"{v} as (select * from ({VIEWS[v]}) where col between {w} and {e} and {R} between {s_} and {n})")
    if outer:
        ctes = ctes.replace("from s2_obs o join cloud1 c on", "from s2_obs o left join cloud1 c on")
        ctes = ctes.replace("case when probability < 50 then", "case when coalesce(probability, 0) < 50 then")
        ctes = ctes.replace("from tagged where probability < 50", "from tagged where coalesce(probability, 0) < 50")
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}"


def flood_oracles() -> dict[str, str]:
    q = {}
    q["scene_save_first"] = _with(f"select scene_id, {R}, col, strftime(ts, '%Y-%m-%d') as day, probability from s2j")
    q["valid_bands"] = _with(
        "select scene_id, cast(len(list_distinct(list_intersect(band_names, ['B3','B4','B8','B11','B12']))) = 5 as int) as is_valid from s2_scene")
    q["cloud_masked"] = _with(f"select {R}, col, period, k, " + ", ".join(BANDS) + " from masked")
    q["date_filter"] = _with(f"select {R}, col, strftime(ts, '%Y-%m-%d') as day, VV from s1f")
    q["bbox_filter"] = _with(
        "select scene_id, minx, miny, maxx, maxy from (select scene_id, cast(min(col) as double) as minx, "
        f"cast(min({R}) as double) as miny, cast(max(col) as double) as maxx, cast(max({R}) as double) as maxy "
        "from s2_obs group by scene_id) where minx <= 19 and maxx >= 0 and miny <= 24 and maxy >= 0")
    q["monthly_composite"] = _with(f"select {R}, col, period, k, " + ", ".join(BANDS) + " from monthly")
    for p in ("pre", "post"):
        q[f"{p}_composite"] = _with(
            f"select {R}, col, " + ", ".join(f"{b}_{p}" for b in BANDS)
            + " from comp where " + " or ".join(f"{b}_{p} is not null" for b in BANDS))
    q["sar_composite"] = _with(f"select {R}, col, VV from sar")
    q["collection_sizes"] = _with(
        "select (select count(distinct scene_id) from s2j) as s2_images, n_pre as pre_months, n_post as post_months, "
        "(select count(distinct ts) from s1f) as s1_images from counts")
    q["water_indices"] = _with(
        f"select {R}, col, " + ", ".join(f"{i}_{p}" for p in ("pre", "post") for i in ("ndwi", "mndwi", "awei"))
        + ", s1_water from idx")
    q["water_consensus"] = _with(f"select {R}, col, water_pre, water_post from water")
    q["change_map"] = _with(f"select {R}, col, change from chg")
    q["change_counts"] = _with("select change, combined_flood, count(*) as pixels from chg group by change, combined_flood")
    q["combined_flood"] = _with(f"select {R}, col, flood_map, s1_water, combined_flood from chg")
    q["connected_count"] = _with(f"select {R}, col, combined_flood, count from cnt")
    q["flood_final"] = _with(f"select {R}, col, flood from ff where flood is not null")
    q["slope"] = _with(f"select {R}, col, round(slope, 6) as slope from sl")
    q["stratified_sample_sizes"] = _with(
        f"select flood, least(count(*), {FS.samples_per_class}) as n from ff "
        f"join chg using ({R}, col) join sl using ({R}, col) "
        "where flood is not null and ndwi_post is not null and mndwi_post is not null and awei_post is not null "
        "and s1_water is not null and elevation is not null and slope is not null and Map is not null "
        "and seasonality is not null group by flood")
    q["predictor_stack"] = _with(
        f"select i.{R}, i.col, " + ", ".join(f"round(cast(cast({c} as float) as double), 4) as {c}" for c in
                                            ("ndwi_post", "mndwi_post", "awei_post", "VV", "elevation", "slope", "Map"))
        + ", round(cast(cast(seasonality as float) as double), 4) as jrc_seasonality"
        f" from idx i left join sl on i.{R} = sl.{R} and i.col = sl.col")
    return q


# ---- stage 3: predictions, zones, spatial join, report ------------------------------------------
SFHA_SQL = "('A','AE','AH','AO','AR','A99','V','VE','VO')"


def _zone_ctes(envelope: bool = True) -> str:
    """Predictions and zones; with ``envelope`` only zones that touch the predictions' bounds can be selected."""
    geo = """case when k%97=5 then NULL when k%97=7 then '{oops' when k%97=11 then '' when k%97=13 then '5'
       when k%97=17 then '{"type":"LineString","coordinates":[[' || c || ',' || r || '],[' || (c+1) || ',' || r || ']]}'
       when k%50=3 then '{"type":"Polygon","coordinates":[[[' || (c-1) || ',' || (r-1) || '],[' || (c+1) || ',' || (r-1)
            || '],[' || (c+1) || ',' || (r+1) || '],[' || (c-1) || ',' || (r+1) || '],[' || (c-1) || ',' || (r-1) || ']]]}'
       when k%50=9 then '{''type'': ''Point'', ''coordinates'': [' || c || ', ' || r || ']}'
       else '{"type":"Point","coordinates":[' || c || ',' || r || ']}' end"""
    return f"""pred_src as (select p_partkey as k, cast((p_partkey-1)%40 as int) as c,
                        cast(floor((p_partkey-1)/40) as int) as r from part),
predictions as (select cast(k as varchar) as "system:index", ((k*7919)%1000)/cast(1000 as double) as flood_probability,
                       cast(case when ((k*7919)%1000)/cast(1000 as double) >= 0.5 then 1 else 0 end as int) as flood_predicted,
                       {geo} as ".geo" from pred_src),
pj as (select *, case when trim(coalesce(".geo", '')) <> '' and json_valid(replace(trim(".geo"), '''', '"'))
                      then replace(trim(".geo"), '''', '"') end as j from predictions),
pt as (select *, json_extract_string(j, '$.type') as t0 from pj),
parsed as (select *, case when t0 in ('Point', 'Polygon', 'LineString') then t0 end as gtype,
       case when t0 = 'Point' then cast(json_extract(j, '$.coordinates[0]') as double)
            when t0 = 'Polygon' then list_min(cast(json_extract(j, '$.coordinates[0][*][0]') as double[]))
            when t0 = 'LineString' then list_min(cast(json_extract(j, '$.coordinates[*][0]') as double[])) end as minx,
       case when t0 = 'Point' then cast(json_extract(j, '$.coordinates[1]') as double)
            when t0 = 'Polygon' then list_min(cast(json_extract(j, '$.coordinates[0][*][1]') as double[]))
            when t0 = 'LineString' then list_min(cast(json_extract(j, '$.coordinates[*][1]') as double[])) end as miny,
       case when t0 = 'Point' then cast(json_extract(j, '$.coordinates[0]') as double)
            when t0 = 'Polygon' then list_max(cast(json_extract(j, '$.coordinates[0][*][0]') as double[]))
            when t0 = 'LineString' then list_max(cast(json_extract(j, '$.coordinates[*][0]') as double[])) end as maxx,
       case when t0 = 'Point' then cast(json_extract(j, '$.coordinates[1]') as double)
            when t0 = 'Polygon' then list_max(cast(json_extract(j, '$.coordinates[0][*][1]') as double[]))
            when t0 = 'LineString' then list_max(cast(json_extract(j, '$.coordinates[*][1]') as double[])) end as maxy
       from pt),
gdf as (select * from parsed where gtype is not null),
zones as (select s_suppkey as zone_id, case s_suppkey%6 when 0 then 'X' when 1 then 'AE' when 2 then 'A' when 3 then 'VE'
                 when 4 then 'D' else 'AH' end as FLD_ZONE,
                 cast((s_suppkey*7)%40 as double)-0.5 as zminx, cast((s_suppkey*7)%40 as double)+2.5 as zmaxx,
                 cast((s_suppkey*3)%50 as double)-0.5 as zminy, cast((s_suppkey*3)%50 as double)+1.5 as zmaxy from supplier),
area as (select min(minx) as ax0, min(miny) as ay0, max(maxx) as ax1, max(maxy) as ay1 from gdf),
near as (select zones.* from zones{", area where zminx <= ax1 and zmaxx >= ax0 and zminy <= ay1 and zmaxy >= ay0" if envelope else ""}),
sfha as (select * from near where FLD_ZONE in {SFHA_SQL}),
zsel as (select * from sfha union all select * from near where not exists (select 1 from sfha)),
flooded as (select * from gdf where flood_predicted = 1),
outside as (select * from flooded f where not exists (select 1 from zsel z where f.minx <= z.zmaxx and f.maxx >= z.zminx
                                                      and f.miny <= z.zmaxy and f.maxy >= z.zminy))"""


def _zwith(body: str, envelope: bool = True) -> str:
    return f"WITH {_zone_ctes(envelope)}\n{body}"


def _merc_x(c: str) -> str:
    return f"6378137.0 * radians({c})"


def _merc_y(c: str) -> str:
    lat = f"greatest(least({c}, 85.0511287798066), -85.0511287798066)"
    return f"6378137.0 * ln(tan(pi() / 4 + radians({lat}) / 2))"


def zone_oracles() -> dict[str, str]:
    q = {}
    q["parse_geometry"] = _zwith('select "system:index", gtype, minx, miny, maxx, maxy from parsed')
    q["parse_stats"] = _zwith("select count(*) filter (where gtype is not null) as success, "
                              "count(*) filter (where gtype is null) as failed from parsed")
    q["total_bounds"] = _zwith("select min(minx) as minx, min(miny) as miny, max(maxx) as maxx, max(maxy) as maxy from gdf")
    q["reproject"] = _zwith(
        'select "system:index", ' + ", ".join(
            f"round({f(c)}, 4) as {c}" for c, f in (("minx", _merc_x), ("miny", _merc_y), ("maxx", _merc_x), ("maxy", _merc_y)))
        + " from gdf")
    q["dropna_rows"] = _zwith('select "system:index", flood_probability, flood_predicted, ".geo" from predictions '
                              'where ".geo" is not null')
    q["zone_filter"] = _zwith("select zone_id, FLD_ZONE from zsel", envelope=False)
    q["zone_fallback"] = _zwith("select zone_id, FLD_ZONE from zones where FLD_ZONE in ('X', 'D')")
    q["source_fallback"] = _zwith("select zone_id, FLD_ZONE, 1 as source_priority from zones where FLD_ZONE = 'X'")
    q["distinct_zones"] = _zwith("select distinct FLD_ZONE from zones")
    q["spatial_left"] = _zwith(
        'select g."system:index", z.zone_id from gdf g left join zsel z on g.minx <= z.zmaxx and g.maxx >= z.zminx '
        "and g.miny <= z.zmaxy and g.maxy >= z.zminy")
    q["outside_zones"] = _zwith('select "system:index", flood_probability from outside')
    q["report"] = _zwith(
        "select (select count(*) from gdf) as total_areas_analyzed, "
        "(select count(*) from gdf where flood_predicted = 1) as flood_predictions_count, "
        "coalesce(round_even((select count(*) from gdf where flood_predicted = 1) * 100.0 / "
        "nullif((select count(*) from gdf), 0), 2), 0.0)::double as flood_percentage, "
        "(select count(*) > 0 from zsel) as fema_data_available, "
        "(select least(count(*), 1) from zsel) as fema_zones_count, "
        "(select count(*) from outside) as flooded_outside_fema_count, "
        "(select min(minx) from gdf) as bbox_minx, (select min(miny) from gdf) as bbox_miny, "
        "(select max(maxx) from gdf) as bbox_maxx, (select max(maxy) from gdf) as bbox_maxy, 'EPSG:4326' as crs")
    lay = lambda name, src, idc, a, b, cc, d: (
        f"select '{name}' as layer, cast({idc} as varchar) as feature_id, {{t}} as geom_type, "
        f"round({_merc_x(a)}, 4) as minx, round({_merc_y(b)}, 4) as miny, "
        f"round({_merc_x(cc)}, 4) as maxx, round({_merc_y(d)}, 4) as maxy from {src}")
    layers = " union all ".join([
        lay("study_area", "gdf", '"system:index"', "minx", "miny", "maxx", "maxy").format(t="gtype"),
        lay("zones", "zsel", "zone_id", "zminx", "zminy", "zmaxx", "zmaxy").format(t="'Polygon'"),
        lay("flooded", "flooded", '"system:index"', "minx", "miny", "maxx", "maxy").format(t="gtype"),
        lay("outside", "outside", '"system:index"', "minx", "miny", "maxx", "maxy").format(t="gtype")])
    q["map_layers"] = _zwith(layers)
    q["map_extent"] = _zwith(
        f"select round(x0 - (x1 - x0) * 0.15, 4) as xmin, round(x1 + (x1 - x0) * 0.15, 4) as xmax, "
        f"round(y0 - (y1 - y0) * 0.15, 4) as ymin, round(y1 + (y1 - y0) * 0.15, 4) as ymax from "
        f"(select min({_merc_x('minx')}) as x0, max({_merc_x('maxx')}) as x1, min({_merc_y('miny')}) as y0, "
        f"max({_merc_y('maxy')}) as y1 from gdf)")
    q["aoi_area"] = _zwith(
        "select round(6378137.0 * 6378137.0 * radians(max(maxx) - min(minx)) * "
        "(sin(radians(max(maxy))) - sin(radians(min(miny)))) / 1e6, 3) as area_km2 from gdf")
    q["prediction_summary"] = _zwith(
        "select count(*) as rows_read, "
        "count(*) filter (where gtype is not null and starts_with(trim(\".geo\"), '{') and json_valid(trim(\".geo\"))) as valid_geometries, "
        "count(*) filter (where not (gtype is not null and starts_with(trim(\".geo\"), '{') and json_valid(trim(\".geo\")))) as parse_errors, "
        "count(*) filter (where flood_predicted = 1 and gtype is not null and starts_with(trim(\".geo\"), '{') "
        "and json_valid(trim(\".geo\"))) as flooded from parsed")
    return q


def ml_oracles() -> dict[str, str]:
    q = {}
    n_c = (f"select flood, least(count(*), {FS.samples_per_class}) as n_c from ff join chg using ({R}, col) "
           f"join sl using ({R}, col) where flood is not null and ndwi_post is not null and mndwi_post is not null "
           "and awei_post is not null and s1_water is not null and elevation is not null and slope is not null "
           "and Map is not null and seasonality is not null group by flood")
    q["split_sizes"] = _with(
        f"select flood, 1 as is_test, cast(ceil(n_c * 0.25) as bigint) as n from ({n_c}) "
        f"union all select flood, 0 as is_test, n_c - cast(ceil(n_c * 0.25) as bigint) as n from ({n_c})")
    q["fold_sizes"] = _with(
        f"select flood, cast(f as int) as fold, cast(floor((tr - 1 - f) / 5) + 1 as bigint) as n from "
        f"(select flood, n_c - cast(ceil(n_c * 0.25) as bigint) as tr from ({n_c})) cross join range(5) t(f) where tr > f")
    q["snap_to_grid"] = _zwith(
        "select cell_row, cell_col, \"system:index\", n from (select *, row_number() over (partition by cell_row, cell_col "
        "order by d2, \"system:index\") as rn, count(*) over (partition by cell_row, cell_col) as n from "
        "(select \"system:index\", cast(floor(y / 2) as bigint) as cell_row, cast(floor(x / 2) as bigint) as cell_col, "
        "(x - (floor(x / 2) * 2 + 1)) ** 2 + (y - (floor(y / 2) * 2 + 1)) ** 2 as d2 from "
        "(select \"system:index\", (minx + maxx) / 2 as x, (miny + maxy) / 2 as y from gdf))) where rn = 1")
    q["confusion_matrix"] = (
        "select quality as truth, count(*) filter (where toxic = 0) as pred_0, count(*) filter (where toxic = 1) as pred_1 "
        "from labels group by quality")
    q["classification_report"] = """
with n as (select count(*) filter (where quality=0 and toxic=0)::double as n00, count(*) filter (where quality=0 and toxic=1)::double as n01,
                  count(*) filter (where quality=1 and toxic=0)::double as n10, count(*) filter (where quality=1 and toxic=1)::double as n11 from labels),
m as (select coalesce(n00 / nullif(n00 + n10, 0), 0.0) as p0, coalesce(n00 / nullif(n00 + n01, 0), 0.0) as r0,
             coalesce(n11 / nullif(n11 + n01, 0), 0.0) as p1, coalesce(n11 / nullif(n11 + n10, 0), 0.0) as r1,
             n00 + n01 as s0, n10 + n11 as s1, n00 + n01 + n10 + n11 as tot,
             coalesce((n00 + n11) / nullif(n00 + n01 + n10 + n11, 0), 0.0) as acc from n),
f as (select *, coalesce(2.0 * p0 * r0 / nullif(p0 + r0, 0), 0.0) as f0, coalesce(2.0 * p1 * r1 / nullif(p1 + r1, 0), 0.0) as f1 from m)
select '0' as label, p0 as precision, r0 as recall, f0 as f1_score, cast(s0 as bigint) as support from f
union all select '1', p1, r1, f1, cast(s1 as bigint) from f
union all select 'accuracy', null, null, acc, cast(tot as bigint) from f
union all select 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, cast(tot as bigint) from f
union all select 'weighted avg', coalesce((p0 * s0 + p1 * s1) / nullif(tot, 0), 0.0), coalesce((r0 * s0 + r1 * s1) / nullif(tot, 0), 0.0),
                 coalesce((f0 * s0 + f1 * s1) / nullif(tot, 0), 0.0), cast(tot as bigint) from f"""
    q["roc_auc"] = """
with s as (select c_acctbal as score, cast(c_mktsegment = 'BUILDING' as int) as y from customer),
g as (select score, sum(y) as pos, sum(1 - y) as neg from s group by score),
c as (select pos, neg, coalesce(sum(neg) over (order by score rows between unbounded preceding and 1 preceding), 0) as below from g)
select round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 10) as auc from c"""
    q["class_weights"] = ("select quality as class, count(*) as n_c, sum(count(*)) over () / "
                          "(count(*) over () * count(*)) as weight from labels group by quality")
    q["one_hot_aligned"] = (
        f"WITH px_static as ({VIEWS['px_static']}) select {R}, col, "
        + ", ".join(f"coalesce(cast(Map = {c} as double), 0.0) as Map_{c}" for c in (10, 20, 30, 40, 60))
        + " from px_static")
    # CSV keeps no difference between empty text and NULL (as with pandas): '' comes back NULL.
    q["csv_roundtrip"] = _zwith('select "system:index", flood_probability, flood_predicted, nullif(".geo", \'\') as ".geo" from predictions')
    q["geojson_roundtrip"] = _zwith('select "system:index", gtype, minx, miny, maxx, maxy from gdf')
    q["raster_roundtrip"] = _with(f"select {R}, col, change from chg")
    return q


def job_oracles() -> dict[str, str]:
    q = {}
    q["zone_geojson_roundtrip"] = _zwith("select FLD_ZONE, zminx as minx, zminy as miny, zmaxx as maxx, zmaxy as maxy from zones")
    pre0 = ", ".join(f"case when n_pre > 0 then c.{x}_pre else 0.0 end as {x}_pre" for x in ("B3", "B8", "B11"))
    q["dummy_composite"] = (
        f"WITH s2_obs as ({VIEWS['s2_obs']}), s2_scene as ({VIEWS['s2_scene']}), s2_cloud as ({VIEWS['s2_cloud']}), "
        f"px_static as ({VIEWS['px_static']}), "
        "valid as (select scene_id from s2_scene where len(list_distinct(list_intersect(band_names, ['B3','B4','B8','B11','B12']))) = 5), "
        "cloud1 as (select scene_id, min(probability) as probability from s2_cloud group by scene_id), "
        "s2j as (select o.*, c.probability from s2_obs o join cloud1 c on o.scene_id = c.scene_id "
        "where o.scene_id in (select scene_id from valid) and o.ts >= TIMESTAMP '1980-01-01' and o.ts < TIMESTAMP '1999-12-31'), "
        f"tagged as (select * from (select s2j.*, 'pre' as period, {_k('1980-01-01')} as k from s2j) "
        f"where k between 0 and {_windows('1980-01-01', '1980-12-31') - 1} "
        f"union all select * from (select s2j.*, 'post' as period, {_k(FS.post_start)} as k from s2j) where k between 0 and {N_POST - 1}), "
        f"comp as (select {R}, col, median(B3) filter (where period='pre') as B3_pre, median(B8) filter (where period='pre') as B8_pre, "
        "median(B11) filter (where period='pre') as B11_pre, median(B3) filter (where period='post') as B3_post from "
        f"(select {R}, col, period, k, median(B3) as B3, median(B8) as B8, median(B11) as B11 from "
        f"(select {R}, col, period, k, B3/10000.0 as B3, B8/10000.0 as B8, B11/10000.0 as B11 from tagged where probability < 50) "
        f"group by {R}, col, period, k) group by {R}, col), "
        "counts as (select (select count(distinct k) from tagged where period='pre') as n_pre, "
        "(select count(distinct k) from tagged where period='post') as n_post) "
        f"select {pre0}, count(*) as pixels, count(case when n_post > 0 then c.B3_post else 0.0 end) as post_valid "
        f"from px_static p left join comp c on p.{R} = c.{R} and p.col = c.col cross join counts group by all")
    n_c = (f"select flood, least(count(*), {FS.samples_per_class}) as n_c from ff join chg using ({R}, col) "
           f"join sl using ({R}, col) where flood is not null and ndwi_post is not null and mndwi_post is not null "
           "and awei_post is not null and s1_water is not null and elevation is not null and slope is not null "
           "and Map is not null and seasonality is not null group by flood")
    q["flood_exports"] = _with(
        f"select (select count(*) from ff where flood is not null) as flood_mask, (select cast(coalesce(sum(n_c), 0) as bigint) from ({n_c})) as samples, "
        "(select count(*) from chg) as change_map, (select count(*) from idx) as predictors")
    q["scene_save_first_outer"] = _with(
        f"select scene_id, {R}, col, strftime(ts, '%Y-%m-%d') as day, probability from s2j", outer=True)
    q["change_counts_outer"] = _with(
        "select change, combined_flood, count(*) as pixels from chg group by change, combined_flood", outer=True)
    q["clipped_change_counts"] = _with(
        "select change, combined_flood, count(*) as pixels from chg group by change, combined_flood", aoi=(0, 0, 19, 24))
    q["prediction_head"] = _zwith('select "system:index", flood_probability, flood_predicted, ".geo" from predictions '
                                  'order by "system:index" limit 5')
    q["zone_gap_job"] = _zwith(
        "select (select count(*) from gdf) as total_areas_analyzed, "
        "(select count(*) from gdf where flood_predicted = 1) as flood_predictions_count, "
        "coalesce(round_even((select count(*) from gdf where flood_predicted = 1) * 100.0 / "
        "nullif((select count(*) from gdf), 0), 2), 0.0)::double as flood_percentage, "
        "(select least(count(*), 1) from zsel) as fema_zones_count, "
        "(select count(*) from outside) as flooded_outside_fema_count, (select count(*) from outside) as outside_features")
    return q


#: Type and bbox by p_partkey % 18 of the edge texts; all others are null.
EDGE_BOXES = {0: ("Point", 1, 2, 1, 2), 1: ("MultiPoint", 0, 1, 3, 4), 2: ("LineString", 0, 0, 2, 5),
              3: ("MultiLineString", 0, 0, 6, 3), 4: ("Polygon", 0, 0, 4, 3), 5: ("MultiPolygon", 0, 0, 7, 8),
              6: ("Polygon", 0, 0, 2, 2), 7: ("Point", 8, 9, 8, 9), 14: ("GeometryCollection", "null", "null", "null", "null"),
              16: ("GeometryCollection", 1, 2, 7, 8), 17: ("GeometryCollection", 1, 2, 7, 8)}


def round2_oracles() -> dict[str, str]:
    """Real coordinates, study-area bounds, edge geometries, projected zones, stage 2."""
    q = {}
    grouped = "select change, combined_flood, count(*) as pixels from chg group by change, combined_flood"
    # A box of degrees on the 0.01-degree grid, as a test of each pixel centre.
    ctes = _flood_ctes()
    for v in ("s2_obs", "s1_obs", "px_static"):
        ctes = ctes.replace(f"{v} as ({VIEWS[v]})", f"{v} as (select * from ({VIEWS[v]}) where "
                            f"-77.3 + (col + 0.5) * 0.01 between -77.15 and -76.95 and 39.7 - ({R} + 0.5) * 0.01 between 39.3 and 39.6)")
    q["clip_lonlat"] = f"WITH RECURSIVE {ctes}\n{grouped}"
    n_all = (f"select {R}, col, flood from ff join chg using ({R}, col) join sl using ({R}, col) "
             "where flood is not null and ndwi_post is not null and mndwi_post is not null and awei_post is not null "
             "and s1_water is not null and elevation is not null and slope is not null and Map is not null and seasonality is not null")
    q["sample_points"] = _with(
        f"select {R} || '_' || col as \"system:index\", flood, round(-77.3 + (col + 0.5) * 0.01, 6) as x, "
        f"round(39.7 - ({R} + 0.5) * 0.01, 6) as y from ({n_all})")
    zones = _zone_ctes()
    flood = ", ".join(f"{k} as ({v})" for k, v in VIEWS.items())
    q["predictors_to_zones"] = (
        f"WITH {flood}, s1f as (select * from s1_obs where ts >= TIMESTAMP '{FS.post_start}' and ts < TIMESTAMP '{FS.post_end}' "
        f"and list_contains(pols, 'VV') and mode = 'IW'), sar as (select {R}, col, median(VV) as VV from s1f group by {R}, col), "
        f"px as (select p.{R} as r, p.col as c, case when (select count(*) from s1f) > 0 then cast(s.VV as float) else 0 end < -17 as wet "
        f"from px_static p left join sar s on p.{R} = s.{R} and p.col = s.col), "
        "zz as (select s_suppkey%6 as code, (s_suppkey*7)%40-0.5 as x0, (s_suppkey*7)%40+2.5 as x1, (s_suppkey*3)%50-0.5 as y0, "
        "(s_suppkey*3)%50+1.5 as y1 from supplier where s_suppkey%6 not in (0, 4) and (s_suppkey*7)%40-0.5 <= (select max(c) from px) "
        "and (s_suppkey*7)%40+2.5 >= (select min(c) from px) and (s_suppkey*3)%50-0.5 <= (select max(r) from px) "
        "and (s_suppkey*3)%50+1.5 >= (select min(r) from px)) "
        "select count(*) as total_areas_analyzed, count(*) filter (where wet) as flood_predictions_count, "
        "(select least(count(*), 1) from zz) as fema_zones_count, count(*) filter (where wet and not exists "
        "(select 1 from zz where c between x0 and x1 and r between y0 and y1)) as flooded_outside_fema_count from px")
    wide = zones.replace("zones as (select s_suppkey", "zones0 as (select s_suppkey").replace(
        "from supplier),\narea", """from supplier),
zones as (select zone_id, FLD_ZONE, zminx * 10 as zminx, zmaxx * 10 as zmaxx, zminy, zmaxy from zones0),
area""")
    q["zone_envelope"] = f"WITH {wide}\nselect zone_id, FLD_ZONE from zsel"
    q["source_fallback_bounds"] = _zwith("select zone_id, FLD_ZONE, 1 as source_priority from zsel")
    q["report_bounds"] = f"""WITH {wide}
select (select count(*) from gdf) as total_areas_analyzed, (select count(*) from flooded) as flood_predictions_count,
       (select count(*) > 0 from zsel) as fema_data_available, (select least(count(*), 1) from zsel) as fema_zones_count,
       (select count(*) from outside) as flooded_outside_fema_count"""
    rows = ", ".join(f"({k}, '{t}', {a}::double, {b}::double, {c}::double, {d}::double)" for k, (t, a, b, c, d) in EDGE_BOXES.items())
    q["parse_geometry_edge"] = (f"select p_partkey as k, gtype, minx, miny, maxx, maxy from part left join "
                                f"(values {rows}) t(m, gtype, minx, miny, maxx, maxy) on p_partkey % 18 = m")
    q["spatial_outlier"] = _zwith(
        'select g."system:index", z.zone_id from gdf g left join zsel z on g.minx <= z.zmaxx and g.maxx >= z.zminx '
        "and g.miny <= z.zmaxy and g.maxy >= z.zminy union all select 'all', zone_id from zsel")
    q["map_layers_projected"] = zone_oracles()["map_layers"]
    px = (f"select l_orderkey as scene_id, cast(floor((l_partkey-1)/40) as int) as {R}, cast((l_partkey-1)%40 as int) as col, "
          "min(cast((l_orderkey*31 + l_partkey*7)%100 as int)) as probability from lineitem where l_orderkey%13<>0 group by all")
    q["cloud_masked_pixel"] = (
        "WITH RECURSIVE " + _flood_ctes().replace(
            "cloud1 as (select scene_id, min(probability) as probability from s2_cloud group by scene_id)", f"cloud1 as ({px})")
        .replace("join cloud1 c on o.scene_id = c.scene_id", f"join cloud1 c on o.scene_id = c.scene_id and o.{R} = c.{R} and o.col = c.col")
        + f"\nselect {R}, col, period, k, " + ", ".join(BANDS) + " from masked")
    parts = []
    for name, start, end in (("a", "1995-02-01", "1995-03-17"), ("b", "1995-02-01", "1995-05-17"), ("c", "1996-01-31", "1997-07-16")):
        parts.append(f"select '{name}' as period, cast(w as int) as k, count(*) as n from lineitem join "
                     f"range({_windows(start, end)}) t(w) on l_shipdate >= DATE '{start}' + to_months(cast(w as int)) "
                     f"and l_shipdate < DATE '{start}' + to_months(cast(w + 1 as int)) group by all")
    q["month_windows"] = " union all ".join(parts)
    q["composite_metadata"] = _with(
        "select period, k, epoch_ms(cast(d as timestamp)) as time_start, cast(year(d) as int) as year, cast(month(d) as int) as month, "
        f"count(*) as pixels from (select *, case period when 'pre' then DATE '{FS.pre_start}' else DATE '{FS.post_start}' end "
        "+ to_months(k) as d from monthly) group by all")
    test = (f"select flood, cast(ceil(count(*) * 0.25) as bigint) as n from ({n_all}) group by flood")
    q["holdout_report"] = _with(
        f"select cast(flood as varchar) as label, n as support, true as consistent from ({test}) union all "
        f"select label, sum(n)::bigint, true from ({test}), (values ('accuracy'), ('macro avg'), ('weighted avg')) v(label) group by label")
    q["train_job"] = _with(
        f"select 'report' as part, cast(flood as varchar) as name, n from ({test}) union all select 'report', label, sum(n)::bigint "
        f"from ({test}), (values ('accuracy'), ('macro avg'), ('weighted avg')) v(label) group by label union all "
        f"select 'matrix', cast(flood as varchar), n from ({test}) union all select 'auc', name, 1::bigint from (values ('holdout'), "
        "('holdout_calibrated'), ('cv_mean'), ('fold_0'), ('fold_1'), ('fold_2'), ('fold_3'), ('fold_4')) v(name)")
    q["score_job_columns"] = flood_oracles()["predictor_stack"].replace(
        f"select i.{R}, i.col, ", f"select true as valid_probability, true as valid_class, i.{R}, i.col, ")
    q["model_invariants"] = _with(f"select flood, n, n as ids, true as valid, true as class_follows, true as same_auc, "
                                  f"true as importances_add_up from ({test})")
    return q


#: Directed border steps of cells (x, y) covered by ``cells``: area on the left.
STEPS = """steps as (
  select x-0.5 as x0, y-0.5 as y0, x+0.5 as x1, y-0.5 as y1 from cells c where not exists (select 1 from cells d where d.x=c.x and d.y=c.y-1)
  union all select x+0.5, y-0.5, x+0.5, y+0.5 from cells c where not exists (select 1 from cells d where d.x=c.x+1 and d.y=c.y)
  union all select x+0.5, y+0.5, x-0.5, y+0.5 from cells c where not exists (select 1 from cells d where d.x=c.x and d.y=c.y+1)
  union all select x-0.5, y+0.5, x-0.5, y-0.5 from cells c where not exists (select 1 from cells d where d.x=c.x-1 and d.y=c.y))"""


def round3_oracles() -> dict[str, str]:
    """Large zones, dissolve, collections on disk, other grids."""
    q = {}
    bars = "bars as (select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as i, l_quantity as h from lineitem)"
    sites = ("sites as (select p_partkey as site_id, p_partkey*30.0-7.25 as x0, p_size::double as y0, case when p_partkey%2=0 then 0 else 3 end as s from part)")
    hit = "exists (select 1 from bars where i between floor(x0) and ceil(x0 + s) + 1 and i - 1 <= x0 + s and i >= x0 and y0 <= h)"
    q["large_zone"] = f"WITH {bars}, {sites} select site_id from sites where {hit}"
    q["large_zone_outside"] = f"WITH {bars}, {sites} select site_id from sites where not {hit}"
    cells = ("cells as (select distinct x::double as x, y::double as y from zsel, generate_series((zminx+0.5)::bigint, (zmaxx-0.5)::bigint) a(x), "
             "generate_series((zminy+0.5)::bigint, (zmaxy-0.5)::bigint) b(y))")
    zc = f"{_zone_ctes()}, {cells}, {STEPS}"
    q["dissolve_border"] = f"WITH {zc} select x0, y0, x1, y1 from steps"
    # A left turn goes before straight on, and that before a right turn.
    q["dissolve_rings"] = f"""WITH RECURSIVE {zc},
named as (select row_number() over (order by x0, y0, x1, y1) as id, * from steps),
follows as (select a.id, b.id as nxt from named a join named b on b.x0 = a.x1 and b.y0 = a.y1
  qualify row_number() over (partition by a.id order by (a.x1-a.x0)*(b.y1-b.y0)-(a.y1-a.y0)*(b.x1-b.x0) desc) = 1),
walk as (select id, id as cur from named union select w.id, f.nxt from walk w join follows f on f.id = w.cur),
ring as (select id, min(cur) as ring from walk group by id)
select sum(x0*y1-x1*y0)/2 as area, count(*)::double as length, min(x0) as minx, min(y0) as miny, max(x0) as maxx, max(y0) as maxy
from named join ring using (id) group by ring"""
    flood = """reach as (select x, y, x as fx, y as fy from cells union
  select r.x, r.y, c.x, c.y from reach r join cells c on abs(c.x-r.fx)+abs(c.y-r.fy) = 1),
part as (select x, y, min(fx*1000+fy) as p from reach group by x, y)"""
    q["dissolve"] = f"""WITH RECURSIVE {zc}, {flood}
select count(*)::double as area, min(x)-0.5 as minx, min(y)-0.5 as miny, max(x)+0.5 as maxx, max(y)+0.5 as maxy from part group by p"""
    q["dissolve_by_code"] = f"""WITH RECURSIVE {_zone_ctes()},
cells as (select distinct FLD_ZONE, x::double as x, y::double as y from zones, generate_series((zminx+0.5)::bigint, (zmaxx-0.5)::bigint) a(x),
  generate_series((zminy+0.5)::bigint, (zmaxy-0.5)::bigint) b(y)),
reach as (select FLD_ZONE, x, y, x as fx, y as fy from cells union select r.FLD_ZONE, r.x, r.y, c.x, c.y
  from reach r join cells c on c.FLD_ZONE = r.FLD_ZONE and abs(c.x-r.fx)+abs(c.y-r.fy) = 1),
part as (select FLD_ZONE, x, y, min(fx*1000+fy) as p from reach group by all)
select FLD_ZONE, count(distinct p) as polygons, count(*)::double as area from part group by FLD_ZONE"""
    for name, like in (("stored_change_counts", "change_counts"), ("stored_predictor_stack", "predictor_stack"),
                       ("stored_sample_sizes", "stratified_sample_sizes")):
        q[name] = flood_oracles()[like]
    q["zone_collection"] = _zwith("select FLD_ZONE, zminx as minx, zminy as miny, zmaxx as maxx, zmaxy as maxy from zones")
    # The fit at i: over all a up to i the largest of the smallest means of a..b, b from i on.
    q["isotonic_steps"] = """WITH g as (select c_acctbal as s, sum(case when c_mktsegment = 'BUILDING' then 1 else 0 end)::double as y, count(*)::double as w
  from customer group by 1),
p as (select row_number() over (order by s) as i, s, sum(y) over (order by s) as ys, sum(w) over (order by s) as ws, w, y from g),
m as (select a.i as a, b.i as b, (b.ys - a.ys + a.y) / (b.ws - a.ws + a.w) as mean from p a join p b on b.i >= a.i),
low as (select a, b as i, min(mean) over (partition by a order by b desc) as v from m),
fit as (select i, round(max(v), 9) as value from low group by i)
select min(s) as low, max(s) as high, value, sum(w) as weight from fit join p using (i) group by value"""
    n_all = (f"select {R} || '_' || col as id, flood from ff join chg using ({R}, col) join sl using ({R}, col) "
             "where flood is not null and ndwi_post is not null and mndwi_post is not null and awei_post is not null "
             "and s1_water is not null and elevation is not null and slope is not null and Map is not null and seasonality is not null")
    at_most = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(9)]
    draws = " + ".join(f"(u >= {p!r}::double)::int" for p in at_most)
    q["bootstrap_weights"] = _with(
        f"select tree, class, n, sum(n) over (partition by tree) / (count(*) over (partition by tree) * n) as weight from "
        f"(select cast(tree as int) as tree, flood as class, sum({draws})::bigint as n from (select *, "
        f"('0x' || substr(md5(id || ':' || tree || ':42'), 1, 8))::bigint / 4294967296.0::double as u from ({n_all}) cross join range(20) t(tree)) "
        f"group by all having sum({draws}) > 0)")
    test = f"select flood, cast(ceil(count(*) * 0.25) as bigint) as n from ({n_all}) group by flood"
    q["balanced_forest"] = _with(f"select flood, n, true as valid, true as class_follows from ({test})")
    day = FS.post_start.replace("-", "")
    q["export_names"] = "select kind, name, true as written from (values " + ", ".join(
        f"('{k}', '{n}_{day}')" for k, n in (("flood_mask", "flood_mask_final"), ("samples", "FloodSamples"), ("change_map", "changeMap"),
                                             ("predictors", "predictors"))) + ") v(kind, name)"
    q["outside_without_zones"] = _zwith('select "system:index", flood_probability from flooded')
    q["prediction_summary_plain"] = (f"select rows_read, valid_geometries, parse_errors, null::bigint as flooded from "
                                     f"({zone_oracles()['prediction_summary']})")
    case = lambda name, where, taken, usable="count(gtype)": (
        f"select '{name}' as input, count(*) as rows, {usable} as usable, {taken} as taken from parsed where {where}")
    q["refused_inputs"] = _zwith(" union all ".join([
        case("all", "true", "count(gtype) > 0"), case("without a geometry column", "true", "false", "0::bigint"),
        case("without a flag", "true", "false"), case("no rows", "flood_probability > 2", "count(gtype) > 0"),
        case("no usable text", "\".geo\" is null or length(\".geo\") < 8", "count(gtype) > 0")]))
    q["fold_auc_mean"] = """with s as (select c_custkey % 5 as fold, c_acctbal as score, cast(c_mktsegment = 'BUILDING' as int) as y from customer),
g as (select fold, score, sum(y) as pos, sum(1 - y) as neg from s group by all),
c as (select fold, pos, neg, coalesce(sum(neg) over (partition by fold order by score rows between unbounded preceding and 1 preceding), 0) as below from g),
a as (select cast(fold as varchar) as fold, sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) as auc from c group by fold)
select fold, round(auc, 10) as auc from a union all select 'mean', round(avg(auc), 10) from a"""
    q["crs_codes"] = ("select s_suppkey as k, case when s_suppkey % 7 <> 0 then cast(s_suppkey as int) end as code from supplier")
    sizes = ("with recursive whole as (select r as r0, c as c0, v, r, c from cc_src union select w.r0, w.c0, w.v, n.r, n.c from whole w join cc_src n "
             "on abs(n.r - w.r) + abs(n.c - w.c) = 1 and n.v = w.v) select r0, c0, v, count(*) as n from whole group by all")
    for name, count in (("256", "cast(least(n, 256) as int)"), ("all", "n")):
        q[f"connected_count_{name}"] = _with(f"select r0 as {R}, c0 as col, v as combined_flood, {count} as count from ({sizes})")
    px = (f"px as (select l_orderkey as scene_id, cast((l_partkey-1)%40 as int) as col, cast(floor((l_partkey-1)/40) as int) as {R}, o_orderdate as ts, "
          "o_orderstatus, l_quantity from lineitem join orders on l_orderkey = o_orderkey)")
    foot = f"foot as (select scene_id, min(col) as c0, max(col) as c1, min({R}) as r0, max({R}) as r1 from px group by scene_id)"
    q["collection_scan"] = f"""WITH {px}, {foot}
select strftime(ts, '%Y-%m') as month, count(distinct scene_id) as scenes, count(*) as n, sum(l_quantity*200) as b3 from px join foot using (scene_id)
where ts >= TIMESTAMP '1996-01-15' and ts < TIMESTAMP '1998-01-15' and scene_id % 17 <> 0 and c0 <= 9 and c1 >= 0 and r0 <= 9 and r1 >= 0 group by all"""
    q["collection_radar"] = f"""WITH {px}
select 'IW' as mode, count(distinct scene_id) as scenes, count(*) as n, sum(-21 + l_quantity*0.25) as vv from px
where ts >= TIMESTAMP '1997-03-01' and ts < TIMESTAMP '1997-09-01' and o_orderstatus <> 'O' and scene_id % 5 <> 0 having count(*) > 0"""
    monthly = ", ".join(f"median(v_{b}) as {b}" for b in BANDS)
    scaled = {"B3": "l_quantity*200", "B4": "cast((l_orderkey*37+l_linenumber*11)%10000 as double)", "B8": "l_discount*100000",
              "B11": "l_tax*100000", "B12": "l_extendedprice/60"}
    parts = []
    for name, start in (("pre", "1996-01-01"), ("post", "1997-01-01")):
        parts.append(f"select *, '{name}' as period, {_k(start)} as k from obs where ts >= TIMESTAMP '1996-01-01' and ts < TIMESTAMP '1997-06-30'")
    q["collection_composite"] = (
        f"WITH obs as (select cast((l_partkey-1)%40 as int) as col, cast(floor((l_partkey-1)/40) as int) as {R}, o_orderdate as ts, "
        + ", ".join(f"({scaled[b]})/10000.0 as v_{b}" for b in BANDS)
        + " from lineitem join orders on l_orderkey = o_orderkey where o_orderkey%17<>0 and o_orderkey%13<>0 and (o_orderkey*31)%100 < 50), "
        f"tagged as ({' union all '.join(parts)}) select {R}, col, period, k, {monthly} from tagged "
        f"where k between 0 and case period when 'pre' then {_windows('1996-01-01', '1996-06-30') - 1} else {_windows('1997-01-01', '1997-06-30') - 1} end group by {R}, col, period, k")
    layer = (f"layer as (select cast((p_partkey-1)%40 as int) as c, cast(floor((p_partkey-1)/40) as int) as r, p_size::double as elevation, "
             "nullif(p_size%13, 0)::double as season from part)")
    span = "span as (select max(c) as c1, max(r) as r1 from layer)"
    grid = (f"{layer}, {span}, grid as (select i as {R}, j as col, 0.25 + j*1.5 as x0, 0.25 + (j+1)*1.5 as x1, 50.5 - (i+1)*1.25 as y0, 50.5 - i*1.25 as y1 "
            "from span, generate_series(-1, ((c1+1)/1.5)::bigint + 1) a(j), generate_series(((49.5-r1)/1.25)::bigint - 2, 42) b(i))")
    q["regrid_nearest"] = (f"WITH {grid} select cast({R} as int) as {R}, cast(col as int) as col, elevation, season from grid join layer "
                           "on c = floor((x0+x1)/2) and r = ceil((y0+y1)/2) - 1")
    q["regrid_area_mean"] = (
        f"WITH {grid}, o as (select {R}, col, elevation, season, (least(x1, c+1)-greatest(x0, c)) * (least(y1, r+1)-greatest(y0, r)) as w from grid join layer "
        f"on c < x1 and c+1 > x0 and r < y1 and r+1 > y0) select cast({R} as int) as {R}, cast(col as int) as col, round(sum(w*elevation)/sum(w), 6) as elevation, "
        f"round(sum(w*season)/sum(case when season is not null then w end), 6) as season from o group by {R}, col")
    q["regrid_bilinear"] = (
        f"WITH {grid}, p as (select *, (x0+x1)/2-0.5 as u, (y0+y1)/2-0.5 as v from grid), "
        f"o as (select p.{R}, p.col, elevation, season, (1-abs(u-c))*(1-abs(v-r)) as w, (case when u=floor(u) then 1 else 2 end)*(case when v=floor(v) then 1 else 2 end) as n "
        f"from p join layer on abs(u-c) < 1 and abs(v-r) < 1) select cast({R} as int) as {R}, cast(col as int) as col, "
        f"round(case when count(elevation) = max(n) then sum(w*elevation) end, 6) as elevation, round(case when count(season) = max(n) then sum(w*season) end, 6) as season "
        f"from o group by {R}, col")
    return q


def all_oracles() -> dict[str, str]:
    out = {}
    out.update(flood_oracles())
    out.update(zone_oracles())
    out.update(ml_oracles())
    out.update(job_oracles())
    out.update(round2_oracles())
    out.update(round3_oracles())
    return out
