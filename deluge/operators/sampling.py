"""Seeded stratified sampling, train/test split and k-fold assignment.

Order within a class is a seeded 64-bit hash of the row's key columns, so results are
repeatable across runs and independent of partitioning.  A class can hold billions of
pixels, so ``stratified_sample`` first keeps rows whose hash falls under a per-class
threshold sized for n plus a wide margin (a pushed-down filter, no shuffle), and only
ranks that bounded remainder.  If the threshold ever keeps too few rows for a class,
the exact full ranking is used for that class instead.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SPAN = float(2 ** 53)


def uniform_hash(seed: int, cols: Sequence[str]) -> Column:
    """Deterministic U[0,1) from a seeded xxhash64 of ``cols``."""
    h = F.xxhash64(F.lit(int(seed)), *[F.col(c) for c in cols])
    return F.pmod(h, F.lit(2 ** 53)).cast("double") / F.lit(_SPAN)


def _margin(n: int) -> float:
    """Rows expected to survive the hash threshold: n plus ten standard deviations."""
    return n + 10 * math.sqrt(n) + 100


def _rank(df: DataFrame, class_col: str, order_cols: Sequence[str]) -> DataFrame:
    """``_rank`` from 1 within each class in the order of ``_u``, however many rows a class has.

    ``_u`` is uniform, so equal slices of its range hold about equally many rows: rows are
    numbered within a slice and shifted by the rows of the lower slices (a small aggregate).
    """
    slices = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    d = df.withColumn("_b", F.floor(F.col("_u") * F.lit(slices)).cast("int"))
    sizes = d.groupBy(class_col, "_b").agg(F.count(F.lit(1)).alias("_n"))
    lower = Window.partitionBy(class_col).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(F.col(class_col).alias("_rc"), F.col("_b").alias("_rb"),
                         F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_before"))
    w = Window.partitionBy(class_col, "_b").orderBy("_u", *[F.col(f"`{c}`") for c in order_cols])
    return (d.join(shift, F.col(class_col).eqNullSafe(F.col("_rc")) & (F.col("_b") == F.col("_rb")))
            .withColumn("_rank", F.row_number().over(w) + F.col("_before")).drop("_b", "_rc", "_rb", "_before"))


def stratified_sample(df: DataFrame, class_col: str, n: int, seed: int,
                      order_cols: Sequence[str]) -> DataFrame:
    """Up to ``n`` rows per class value (NULL class excluded), seeded.

    Pass 1: class sizes.  Pass 2: keep rows whose hash is under a per-class fraction
    sized for n plus a wide margin, rank only those, checkpoint the (bounded) result.
    A class that came up short (probability about exp(-50)) is redone with a 4x larger
    fraction, and so on up to 1, so every ranking window stays proportional to the rows
    kept and the result is exact.
    """
    from ..session import cut_lineage
    base = df.where(F.col(class_col).isNotNull()).withColumn("_u", uniform_hash(seed, order_cols))
    sizes = {r[0]: r[1] for r in base.groupBy(class_col).count().collect()}  # one row per class
    if not sizes:
        return base.drop("_u").limit(0)
    margin = _margin(n)
    frac = {c: min(1.0, margin / cnt) for c, cnt in sizes.items()}
    todo, done = list(sizes), None
    while todo:
        thr = None
        for c in todo:
            cond = F.when(F.col(class_col) == F.lit(c), F.lit(frac[c]))
            thr = cond if thr is None else F.coalesce(thr, cond)
        picked = cut_lineage(_rank(base.where(F.col(class_col).isin(todo) & (F.col("_u") < thr)),
                                   class_col, order_cols).where(F.col("_rank") <= n).drop("_u", "_rank"))
        got = {r[0]: r[1] for r in picked.groupBy(class_col).count().collect()}
        short = [c for c in todo if got.get(c, 0) < min(n, sizes[c]) and frac[c] < 1.0]
        ok = picked.where(~F.col(class_col).isin(short)) if short else picked
        done = ok if done is None else done.unionByName(ok)
        for c in short:
            frac[c] = min(1.0, frac[c] * 4)
        todo = short
    return done


def stratified_split(df: DataFrame, class_col: str, test_fraction: float, seed: int,
                     order_cols: Sequence[str]) -> DataFrame:
    """Adds ``is_test`` (0/1): per class the first ceil(f * n_c) rows by seeded hash."""
    base = df.withColumn("_u", uniform_hash(seed, order_cols))
    ranked = _rank(base, class_col, order_cols)
    cut = base.groupBy(class_col).agg(F.ceil(F.count(F.lit(1)) * F.lit(test_fraction)).alias("_cut")).select(
        F.col(class_col).alias("_cc"), "_cut")
    return (ranked.join(cut, F.col(class_col).eqNullSafe(F.col("_cc")))
                  .withColumn("is_test", (F.col("_rank") <= F.col("_cut")).cast("int"))
                  .drop("_u", "_rank", "_cc", "_cut"))


def stratified_folds(df: DataFrame, class_col: str, k: int, seed: int, order_cols: Sequence[str]) -> DataFrame:
    """Adds ``fold`` in 0..k-1, dealt round-robin per class in seeded-hash order."""
    ranked = _rank(df.withColumn("_u", uniform_hash(seed + 1, order_cols)), class_col, order_cols)
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_u", "_rank")
