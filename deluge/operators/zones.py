"""Regulatory-zone selection: source fallback, zone-code filter with fallback, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import cut_lineage


def within_box(zones: DataFrame, box: tuple | None, geom: str = "geom") -> DataFrame:
    """Zones whose bbox touches ``box`` (minx, miny, maxx, maxy), as an envelope query returns them; none without a box."""
    if box is None:
        return zones.where(F.lit(False))
    bb = G.bbox(geom)
    return zones.where((bb["minx"] <= F.lit(box[2])) & (bb["maxx"] >= F.lit(box[0]))
                       & (bb["miny"] <= F.lit(box[3])) & (bb["maxy"] >= F.lit(box[1])))


def first_nonempty_source(sources: Sequence[DataFrame]) -> DataFrame:
    """Rows of the first source (in list order) that has at least one row, with its place as ``source_priority``.

    Sources are asked in turn: each is read once, into a table, and those after the first that
    answers are not read at all.
    """
    if not sources:
        raise ValueError("no zone sources")
    for i, s in enumerate(sources):
        answer = cut_lineage(s.withColumn("source_priority", F.lit(i)))
        if not answer.isEmpty():
            break
    return answer


def filter_zone_codes(zones: DataFrame, zone_field: str, codes: Sequence[str]) -> DataFrame:
    """Keep zones whose code is listed; if none is (or the field is missing) keep all."""
    if zone_field not in zones.columns:
        return zones
    hit = F.col(zone_field).isin(list(codes))
    any_hit = zones.agg(F.max(hit.cast("int")).alias("_any"))
    return (zones.crossJoin(F.broadcast(any_hit))
                 .where(hit | (F.coalesce(F.col("_any"), F.lit(0)) == 0)).drop("_any"))


def distinct_codes(zones: DataFrame, zone_field: str) -> DataFrame:
    return zones.select(zone_field).distinct()


def dissolved_count(zones: DataFrame) -> DataFrame:
    """Feature count after dissolving into one geometry: 1 if any zone, else 0.

    The union itself is never materialised: 'outside the union' is the anti-join
    against the parts, which keeps zones parallel.
    """
    return zones.agg(F.least(F.count(F.lit(1)), F.lit(1)).cast("long").alias("fema_zones_count"))
