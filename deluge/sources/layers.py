"""Pixel layers stored by pixel buckets, so that stacking them needs no exchange.

A layer is written as ``buckets`` files' worth of rows hashed by (row, col), as Spark's bucketed tables
are; a scan of it reports that distribution, and a join or aggregate by pixel whose other side is
shuffled into the same number of parts leaves the layer where it is.  Layers of one bucket count join
each other with no exchange at all.  The number of buckets is a property of the data (some 100 to 200 MB a
bucket), not of the session.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..session import output_root

KEYS = ("row", "col")


def write_layer(df: DataFrame, buckets: int, path: str | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Write ``df`` hashed by ``keys`` into ``buckets`` sorted buckets; returns the stored layer.

    ``path`` defaults to a new folder among the session's outputs.  Rows are dealt to their
    bucket's task first, so there is one file per bucket.
    """
    spark = df.sparkSession
    name = f"layer_{uuid.uuid4().hex}"
    path = path or f"{output_root(spark)}/{name}"
    (df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
     .option("path", path).saveAsTable(name))
    return spark.table(name)


def open_layer(spark: SparkSession, path: str, ddl: str, buckets: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """A layer that another session wrote: columns, bucket count and keys as they were written."""
    name = f"layer_{uuid.uuid4().hex}"
    by = ", ".join(f"`{k}`" for k in keys)
    spark.sql(f"CREATE TABLE {name} ({ddl}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS "
              f"LOCATION '{path}'")
    return spark.table(name)
