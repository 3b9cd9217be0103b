"""Stateless operators on streaming DataFrames: features, payloads, encoders, model scores.

The operators are the batch ones; this module only drives source and sink.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from querysieve.functions import lexical as lx
from querysieve.session import scratch_path

# Files of a batch for each core: a batch keeps all cores busy, and a restart repeats one batch at most.
FILES_PER_CORE = 8


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def write_stream(df: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append to a columnar folder, exactly once by the file sink's commit log."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(path)


def with_lexical(df: DataFrame) -> DataFrame:
    return df.withColumns(lx.lexical_features(F.col("full_query")))


def run_once(
    spark: SparkSession, source: str, schema, transform: Callable[[DataFrame], DataFrame], files_per_trigger: int | None = None
) -> DataFrame:
    """Stream everything now in ``source`` through ``transform`` and read the sink back.

    A batch takes ``files_per_trigger`` files, by default some for each core of the session.
    """
    files_per_trigger = files_per_trigger or FILES_PER_CORE * spark.sparkContext.defaultParallelism
    sink, checkpoint = scratch_path(spark, "sink"), scratch_path(spark, "offsets")
    out = transform(read_stream(spark, source, schema, files_per_trigger))
    write_stream(out, sink, checkpoint, once=True).awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)


def stream_lexical(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Lexical features of a table replayed as a stream."""
    source = scratch_path(spark, "source")
    rows.write.parquet(source)
    return run_once(spark, source, rows.schema, with_lexical).select("id", *lx.FEATURES)


def stop_and_resume(
    spark: SparkSession, rows: DataFrame, transform: Callable[[DataFrame], DataFrame], files_per_trigger: int = 1
) -> DataFrame:
    """Replay a table as a stream that stops after its first batches and goes on from its checkpoint.

    The second run sees the same source, sink and checkpoint: batches that are committed are not done again, those that
    were not are, and the sink's log counts every file once.
    """
    source, sink, checkpoint = (scratch_path(spark, name) for name in ("source", "sink", "offsets"))
    rows.write.parquet(source)
    out = transform(read_stream(spark, source, rows.schema, files_per_trigger))
    first = write_stream(out, sink, checkpoint)
    while first.isActive and (first.lastProgress is None or first.lastProgress["batchId"] < 1):
        first.awaitTermination(0.2)
    first.stop()
    again = transform(read_stream(spark, source, rows.schema, files_per_trigger))
    write_stream(again, sink, checkpoint, once=True).awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)
