"""Temporal composites: month windows, per-pixel medians, collection-size guards."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..config import REQUIRED_BANDS
from ..functions.dates import month_count, month_offset

# Python workers do not have to import this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def assign_months(df: DataFrame, periods: Sequence[tuple[str, str, str]], inclusive_tail: bool = True,
                  ts: str = "ts") -> DataFrame:
    """Tag each observation with (period, k): k-th month window starting at the period start.

    ``periods`` = [(name, start, end)].  Windows are [add_months(start,k), add_months(start,k+1))
    for k in 0..n-1, n = month_count(start, end).  An observation may fall in two periods
    (the tail month of one period overlapping the next); it is then emitted once per period.
    Computed per row (no range join), so the scan streams straight into the shuffle.
    """
    # Each offset is computed once per row, as a column; the arrays of tags only read them.
    offsets = [f"_k_{i}" for i in range(len(periods))]
    tagged = df.withColumns({c: month_offset(F.col(ts), start) for c, (_, start, _) in zip(offsets, periods)})
    tags = [F.when((F.col(c) >= 0) & (F.col(c) < month_count(start, end, inclusive_tail)),
                   F.struct(F.lit(name).alias("period"), F.col(c).alias("k")))
            for c, (name, start, end) in zip(offsets, periods)]
    return (tagged.withColumn("_pk", F.explode(F.array(*tags))).where("_pk is not null")
            .withColumn("period", F.col("_pk.period")).withColumn("k", F.col("_pk.k")).drop("_pk", *offsets))


def monthly_median(df: DataFrame, bands: Sequence[str] = REQUIRED_BANDS,
                   keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """Per pixel, period and month: exact median of each band (NULLs skipped)."""
    return df.groupBy(*keys, "period", "k").agg(*[F.median(b).alias(b) for b in bands])


def period_composite(monthly: DataFrame, periods: Sequence[str], bands: Sequence[str] = REQUIRED_BANDS,
                     keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """Median of monthly medians per pixel, one column per band and period (``B3_pre``...).

    One aggregate for all periods: conditional medians skip the other period's rows.
    """
    aggs = [F.median(F.when(F.col("period") == p, F.col(b))).alias(f"{b}_{p}")
            for p in periods for b in bands]
    return monthly.groupBy(*keys).agg(*aggs)


def group_medians(group: np.ndarray, groups: int, values: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exact median, whether there is one) of each group's valid values; ``group`` is 0, 0, 1, ... in order."""
    at = np.flatnonzero(valid)
    g, v = group[at], values[at]
    n = np.bincount(g, minlength=groups)
    several = np.flatnonzero(n[g] > 1)
    v[several] = v[several[np.lexsort((v[several], g[several]))]]  # NaN sorts last, as in Spark
    some = n > 0
    first, size = (np.cumsum(n) - n)[some], n[some]
    low, high = v[first + (size - 1) // 2], v[first + size // 2]
    out = np.zeros(groups)
    out[some] = np.where(size % 2 == 1, high, low * 0.5 + high * 0.5)
    return out, some


def _heads(columns: Sequence[pa.Array]) -> np.ndarray:
    """Whether a row differs from the one before in any of the columns (nulls are equal)."""
    head = np.zeros(len(columns[0]), bool)
    head[:1] = True
    for c in columns:
        for x in (pc.fill_null(c, 0), pc.is_null(c)):
            x = x.to_numpy(zero_copy_only=False)
            head[1:] |= x[1:] != x[:-1]
    return head


def _composites(periods: int, bands: Sequence[str], keys: Sequence[str], schema: pa.Schema):
    """mapInArrow over rows sorted by pixel, period and month: a row per pixel, medians of its monthly medians."""
    def one(table: pa.Table) -> pa.RecordBatch:
        columns = {c: table.column(c).combine_chunks() for c in table.column_names}
        pixel, month = _heads([columns[c] for c in keys]), _heads([columns[c] for c in (*keys, "_p", "k")])
        of_row, starts = np.cumsum(month) - 1, np.flatnonzero(month)
        pixels = np.flatnonzero(pixel)
        of_month = (np.cumsum(pixel) - 1)[starts]
        period = columns["_p"].to_numpy(zero_copy_only=False)[starts]
        out = {c: columns[c].take(pa.array(pixels)) for c in keys}
        for b in bands:
            valid = columns[b].is_valid().to_numpy(zero_copy_only=False)
            values = pc.fill_null(columns[b], 0.0).to_numpy(zero_copy_only=False)
            monthly, some = group_medians(of_row, len(starts), values, valid)
            for p in range(periods):
                value, known = group_medians(of_month, len(pixels), monthly, some & (period == p))
                out[f"{b}_{p}"] = pa.array(value, pa.float64(), mask=~known)
        return pa.RecordBatch.from_arrays([out[n] for n in schema.names], schema=schema)

    def run(batches):
        held = []  # rows of the last pixel so far, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            before = [pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1)])] if held else []
            edge = pa.concat_tables([*before, pa.Table.from_batches([batch])])
            change = np.flatnonzero(_heads([edge.column(c).combine_chunks() for c in keys])[1:]) + 1 - len(before)
            if len(change):
                last = int(change[-1])
                yield one(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = [batch.slice(last)]
            else:
                held.append(batch)
        if held:
            yield one(pa.Table.from_batches(held))

    return run


def pixel_composite(df: DataFrame, periods: Sequence[str], bands: Sequence[str] = REQUIRED_BANDS,
                    keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """``period_composite`` of ``monthly_median``, from observations dealt by pixel: one sort, medians in NumPy.

    Nearly every pixel and month is a group of its own, too many and too small for an aggregate that keeps a map
    of values per group and band.  ``df`` must be partitioned by ``keys``.  A task holds a batch and one pixel's rows.
    """
    number = F.coalesce(*[F.when(F.col("period") == p, i) for i, p in enumerate(periods)], F.lit(-1))
    rows = df.select(*keys, number.alias("_p"), F.col("k").cast("int").alias("k"), *[F.col(b).cast("double").alias(b) for b in bands])
    names = [f"{b}_{p}" for p in range(len(periods)) for b in bands]
    kinds = {c: rows.schema[c].dataType for c in keys}
    schema = pa.schema([*((c, to_arrow_type(t)) for c, t in kinds.items()), *((n, pa.float64()) for n in names)])
    ddl = ", ".join([*(f"`{c}` {t.simpleString()}" for c, t in kinds.items()), *(f"`{n}` double" for n in names)])
    out = rows.sortWithinPartitions(*keys, "_p", "k").mapInArrow(_composites(len(periods), list(bands), list(keys), schema), ddl)
    return out.withColumnsRenamed({f"{b}_{i}": f"{b}_{p}" for i, p in enumerate(periods) for b in bands})


def month_counts(tagged: DataFrame, periods: Sequence[str]) -> DataFrame:
    """One row: number of month windows holding >= 1 image, per period (``n_<period>``)."""
    months = tagged.select("period", "k").distinct()
    return months.agg(*[F.count_if(F.col("period") == p).alias(f"n_{p}") for p in periods])


def guard_empty(pixels: DataFrame, counts: DataFrame, columns_by_count: dict[str, Sequence[str]],
                fill: float = 0.0) -> DataFrame:
    """If a whole collection is empty, its bands become a constant image (``fill``).

    ``counts`` is a one-row frame, so the cross join is a broadcast of a single row.
    """
    joined = pixels.crossJoin(F.broadcast(counts))
    guarded = {c: F.when(F.col(n_col) > 0, F.col(c)).otherwise(F.lit(fill)).alias(c)
               for n_col, cols in columns_by_count.items() for c in cols}
    return joined.select(*[guarded.get(c, F.col(c)) for c in pixels.columns])


def temporal_median(df: DataFrame, column: str, keys: Sequence[str] = ("row", "col")) -> DataFrame:
    return df.groupBy(*keys).agg(F.median(column).alias(column))
