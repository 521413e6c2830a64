"""Helpers shared by the training-data operators.

Words are ``[^\\x20\\x09-\\x0D]+`` everywhere; ``bytes.split()`` cuts at exactly those six
ASCII characters, so a text is encoded once and split as bytes.  A null text is treated as
empty throughout.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deluge.session import cut_lineage

#: Rows of one Arrow batch that an operator emits; bounds the memory of a task.
OUT_ROWS = 20_000


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back (cuts lineage)."""
    return cut_lineage(df)


def documents_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns every text operator needs, whatever else the frame carries."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def text_bytes(value) -> bytes:
    return b"" if value is None else value.encode()


def rows_of(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of the named columns as Python tuples, converted a few at a time (texts may be long)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names))


_GIVEN = [0.0]


def give_back(every: float = 2.0) -> None:
    """Hand freed memory back to the system, at most once in ``every`` seconds.

    Python workers outlive their tasks, and several of them wait beside each executor.
    """
    import ctypes
    import gc
    import time
    if time.monotonic() - _GIVEN[0] < every:
        return
    _GIVEN[0] = time.monotonic()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to do


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``size`` rows from an iterator of tuples."""
    while chunk := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*chunk), schema)], schema=schema)
        del chunk
    give_back()


def map_rows(df: DataFrame, func: Callable[[Iterator[tuple]], Iterator[tuple]], columns: list[str],
             schema: pa.Schema, ddl: str) -> DataFrame:
    """``mapInArrow`` over selected columns with a generator of tuples."""
    def run(batches):
        yield from batches_of(func(rows_of(batches, *columns)), schema)
    return df.select(*columns).mapInArrow(run, ddl)


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Boolean mask of ``n`` positions that lie in any of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge)[:n] > 0


def salted_rank(df: DataFrame, keys: list[str], order: list[str], salt: str, out: str) -> DataFrame:
    """Gapless rank from 0 within ``keys`` that never puts a whole group into one task.

    ``salt`` is an integer column spreading a group's rows; rows are numbered within
    (keys, salt) and shifted by the rows of the smaller salts, which are a small aggregate.
    Null keys form a group of their own.
    """
    from pyspark.sql import Window
    part = [*keys, salt]
    sizes = df.groupBy(*part).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*[F.col(k).alias(f"_r_{k}") for k in part],
                         F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in part]
    number = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
    return (df.join(shift, on, "inner")
            .withColumn(out, (F.col("_before") + number - 1).cast("long"))
            .drop("_before", *[f"_r_{k}" for k in part]))


#: Bytes of an Arrow batch sent to a Python worker, unless the session says otherwise.
BATCH_BYTES = 8 << 20


def ship(spark) -> None:
    """Send this package to the Python workers of the session, once (as ``--py-files`` would).

    Batches are bounded in bytes, too: ten thousand long texts at once would not fit a worker.
    """
    import os
    import tempfile
    import zipfile

    import deluge
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_deluge_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(deluge.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="deluge-py-"), "deluge.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("deluge", os.path.relpath(full, top)))
    sc.addPyFile(path)
    sc._deluge_shipped = True
