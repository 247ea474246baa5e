"""Incremental receiving diagnosis with Structured Streaming.

The source report is run on demand for one receiving operation.  Here newly
landed receiving operations (a file or table stream of
``cll_f189_entry_operations`` rows) are diagnosed as they arrive: each micro-batch
becomes the driving table of the ordinary batch plan, joined to the other tables.
They are asked for anew in each batch if ``tables`` is a function, so rows that land
with or before an operation are seen; given as DataFrames, file tables stay as they
were when the stream was started.  There is no streaming state: every batch is a complete,
stateless batch query.

Exactly once: each batch is written to its own ``batch_id=<n>`` folder with
``overwrite``, so a batch re-run after a failure (the checkpoint records which
batches committed) replaces its own output instead of appending twice.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from supplyscope.plans.receiving import receiving_diagnosis, scope_to_operations
from supplyscope.session import ensure_checkpoint_dir
from supplyscope.sources.schemas import schema


def operations_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 100) -> DataFrame:
    """New receiving operations landing as parquet files under ``path``."""
    return (spark.readStream.schema(schema("cll_f189_entry_operations"))
            .option("maxFilesPerTrigger", max_files_per_trigger).parquet(path))


def diagnose_stream(spark: SparkSession, operations: DataFrame,
                    tables: Mapping[str, DataFrame] | Callable[[], Mapping[str, DataFrame]], sink: str,
                    checkpoint: str | None = None, language: str = "PTB", available_now: bool = False,
                    processing_time: str | None = None) -> StreamingQuery:
    """Start the incremental diagnosis; returns the running query.

    ``tables``: the other source tables, or a function called once a batch that returns
    them (for example ``lambda: parquet_tables(spark, root)``).
    ``checkpoint`` defaults to a folder of the sink's own under the cluster's shared
    ``spark.checkpoint.dir``, so streams into different sinks never share one.
    """
    checkpoint = checkpoint or ensure_checkpoint_dir(spark).rstrip("/") + f"/receiving-diagnosis-stream-{zlib.crc32(sink.encode()):08x}"

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        # the batch's operations drive the plan; every other table is first cut to
        # what they reach, so a batch costs in proportion to its operations
        now = tables() if callable(tables) else tables
        out = receiving_diagnosis(scope_to_operations(now, batch), language=language, sort=False)
        out.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    writer = operations.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
