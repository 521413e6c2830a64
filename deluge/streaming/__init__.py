"""Incremental scoring with Structured Streaming.

The reference is batch only; this applies the same scoring plan (one-hot stage, assembler,
forest) to predictor files as they land, exactly once, with state in a checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import ml as ML
from ..session import checkpoint_dir


def score_stream(spark: SparkSession, model: PipelineModel, source_dir: str, schema: StructType,
                 sink_dir: str, checkpoint: str | None = None, available_now: bool = True,
                 max_files_per_trigger: int = 64) -> StreamingQuery:
    """readStream parquet predictors -> score -> append parquet predictions."""
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
           .parquet(source_dir))
    scored = ML.score(model, src)
    # One checkpoint per sink, the same one after a restart.
    name = uuid.uuid5(uuid.NAMESPACE_URL, sink_dir).hex
    ckpt = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/stream-score-{name}"
    writer = (scored.writeStream.format("parquet").option("path", sink_dir)
              .option("checkpointLocation", ckpt).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
