"""Scoring of a candidate stream; stateless, so it is the batch code on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from screenspark import fixed_values as fixed
from screenspark.operators.models import ScreeningModel
from screenspark.operators.scoring import predict


def read_items(spark: SparkSession, path: str, schema: T.StructType | str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of prediction items, picked up as they arrive."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def score_stream(
    items: DataFrame,
    model: ScreeningModel,
    out: str,
    checkpoint: str,
    features: str = "features",
    threshold: float | None = None,
) -> StreamingQuery:
    """Append predictions to Parquet until the files present are done.

    ``checkpoint`` must lie in storage every executor reaches: it makes a
    restart neither lose nor repeat a batch.
    """
    scored = predict(items, model, features, threshold)
    return (
        scored.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def stop_after_batches(stream: StreamingQuery, batches: int) -> None:
    """Stop a running stream once so many batches are committed, or when it ends by itself."""
    while stream.isActive and len(stream.recentProgress) < batches:
        stream.awaitTermination(0.1)
    stream.stop()
    if stream.exception():
        raise stream.exception()
