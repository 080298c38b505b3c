"""Structured Streaming form of the preprocessing stage.

The recode groups are stateless column expressions, so the same functions run
on a streaming DataFrame.  Whole-column scaling needs the extremes of the full
column, which an unbounded stream does not have; the stream is therefore
scaled with extremes measured once on a reference batch (``extremes``), and
the batch pipeline stays the place where extremes are measured.

The sink is ``foreachBatch``: every micro-batch is written to its own folder
named by the batch id with ``overwrite``, so a batch retried after a failure
replaces its own output (idempotent), and progress is tracked in a
checkpoint under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from equipoise.session import ensure_checkpoint_dir, scratch_path


def read_stream(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over ``path`` (a folder or glob) with an explicit schema."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def run_to_folder(stream: DataFrame, sink: str, checkpoint: str | None = None, available_now: bool = True,
                  fmt: str = "parquet"):
    """Write every micro-batch to ``sink/batch_id=<n>`` (overwrite = idempotent retries); returns the query."""
    spark = stream.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "stream-ckpt")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").format(fmt).save(f"{sink}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def preprocess_stream(spark: SparkSession, source: str, schema: StructType | str,
                      transform: Callable[[DataFrame], DataFrame], sink: str | None = None) -> DataFrame:
    """Stream ``source`` through ``transform`` (stateless recodes) until the files present are done.

    Returns the written result as a batch DataFrame read back from ``sink``.
    """
    ensure_checkpoint_dir(spark)
    sink = sink or scratch_path(spark, "stream-out")
    query = run_to_folder(transform(read_stream(spark, source, schema)), sink)
    query.awaitTermination()
    return spark.read.parquet(sink).drop("batch_id")
