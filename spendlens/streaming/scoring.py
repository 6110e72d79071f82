"""Scoring files as they arrive (SEG10 on a stream).

Scoring is a per-row transformation with frozen state, so the same plan as
``pipeline.score`` runs unchanged on a streaming DataFrame. The ordered fill
needs the whole table and is not applied to a stream: rows must arrive with
their inputs present (or the encoder / band rules take the gaps).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from spendlens.plans import pipeline
from spendlens.session import checkpoint_dir
from spendlens.sources.io import to_columns


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Customer files landing in ``path`` as a stream (header names mapped)."""
    r = spark.readStream.schema(schema)
    if fmt == "csv":
        r = r.option("header", True)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return to_columns(r.format(fmt).load(path))


def score_stream(stream: DataFrame, fitted: pipeline.FittedPipeline, **score_args) -> DataFrame:
    """The scored stream: input columns + Predicted_Spending_Score + Customer_Segment."""
    return pipeline.score(stream, fitted, do_fill=False, **score_args)


def start(scored: DataFrame, sink: str, name: str, fmt: str = "parquet", checkpoint: str | None = None,
          once: bool = False) -> StreamingQuery:
    """Write the scored stream (append). The checkpoint lives under the
    cluster's ``spark.checkpoint.dir`` unless given, so a restarted query
    resumes exactly where it stopped."""
    spark = scored.sparkSession
    folder = None if checkpoint else checkpoint_dir(spark)
    if not (checkpoint or folder):
        raise ValueError("give a checkpoint folder or set spark.checkpoint.dir to a shared folder")
    ck = checkpoint or f"{folder}/streams/{name}"
    w = scored.writeStream.outputMode("append").option("checkpointLocation", ck).queryName(name)
    if once:
        w = w.trigger(availableNow=True)
    if fmt == "memory":
        return w.format("memory").start()
    if fmt == "csv":
        w = w.option("header", True)
    return w.format(fmt).option("path", sink).start()
