"""Isotonic regression by pool-adjacent-violators in blocks, with a merge of block borders."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# Python workers do not have to import this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STEPS = "block long, low double, high double, sum double, weight double"


def pool(steps: Iterator[tuple[float, float, float, float]]) -> list[list[float]]:
    """Steps (low, high, sum, weight) in order of score, pooled until their means do not fall."""
    out: list[list[float]] = []
    for low, high, total, weight in steps:
        out.append([low, high, total, weight])
        # Means compared as cross products: no division, no rounding of its own.
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            _, high, total, weight = out.pop()
            out[-1][1] = high
            out[-1][2] += total
            out[-1][3] += weight
    return out


def _pool_block(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("low")
    done = pool(zip(pdf["low"], pdf["high"], pdf["sum"], pdf["weight"]))
    out = pd.DataFrame(done, columns=["low", "high", "sum", "weight"])
    out.insert(0, "block", int(pdf["block"].iloc[0]))
    return out


def isotonic_steps(df: DataFrame, score: str, label: str, weight: str | None = None, blocks: int | None = None) -> DataFrame:
    """(low, high, value, weight): the non-decreasing least-squares fit of ``label`` over ``score``, one row per step.

    Equal scores are summed first.  The scores are cut into blocks by quantiles and pooled block
    by block; then only blocks whose border values fall are joined with their neighbours and
    pooled again, until none falls.  Pooled blocks give the same fit in any order, so the result is the
    exact one.  Rows without a score, label or weight, or with a weight of zero, take no part.
    """
    spark = df.sparkSession
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    y, w = F.col(label).cast("double"), F.lit(1.0) if weight is None else F.col(weight).cast("double")
    points = (df.select(F.col(score).cast("double").alias("low"), y.alias("y"), w.alias("w"))
              .where("low is not null and not isnan(low) and y is not null and w > 0")
              .groupBy("low").agg(F.sum(F.col("y") * F.col("w")).alias("sum"), F.sum("w").alias("weight")))
    points = cut_lineage(points)
    share = [k / blocks for k in range(1, blocks)]
    cuts = sorted(set(points.approxQuantile("low", share, 0.1 / blocks))) if share else []
    block = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c < F.col("low"))).cast("long")
    steps = points.select(block.alias("block"), "low", F.col("low").alias("high"), "sum", "weight")
    while True:
        steps = cut_lineage(steps.groupBy("block").applyInPandas(_pool_block, STEPS))
        value = F.col("sum") / F.col("weight")
        # One row per block.
        ends = steps.groupBy("block").agg(F.min_by(F.struct("sum", "weight"), "low").alias("first"),
                                          F.max_by(F.struct("sum", "weight"), "low").alias("last")).orderBy("block").collect()
        joined, home = {}, None
        for before, now in zip(ends, ends[1:]):
            if before.last["sum"] * now.first["weight"] >= now.first["sum"] * before.last["weight"]:
                home = joined.get(before.block, before.block)
                joined[now.block] = home
        if not joined:
            return steps.select("low", "high", value.alias("value"), "weight")
        to = F.create_map(*[F.lit(x) for pair in joined.items() for x in pair])
        steps = steps.withColumn("block", F.coalesce(F.try_element_at(to, "block"), F.col("block")).cast("long"))


def calibrate(df: DataFrame, steps: DataFrame, score: str, out: str = "calibrated") -> DataFrame:
    """``df`` with the step value of each score; between two steps, the line between their ends.

    Scores outside the fitted range take the nearest step's value.  ``steps`` (as ``isotonic_steps``
    gives them) are collected into one sorted array, so they must be few: at most a million is accepted.
    """
    n = steps.limit(1_000_001).count()
    if n > 1_000_000:
        raise ValueError("more than a million steps: round the scores before fitting")
    one = steps.agg(F.array_sort(F.collect_list(F.struct("low", "high", "value"))).alias("_steps"))

    def fit(s, v):
        x = s.cast("double")
        below = F.filter(v, lambda p: p.low <= x)
        above = F.filter(v, lambda p: p.low > x)
        a, b = F.try_element_at(below, F.lit(-1)), F.get(above, F.lit(0))
        line = a.value + (b.value - a.value) * (x - a.high) / (b.low - a.high)
        return (F.when(x.isNull() | F.isnan(x), None).when(a.isNull(), b.value)
                .when(b.isNull() | (x <= a.high), a.value).otherwise(line))
    return df.crossJoin(F.broadcast(one)).withColumn(out, fit(F.col(score), F.col("_steps"))).drop("_steps")
