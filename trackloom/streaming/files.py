"""Event files as a stream: the batch operators applied to every micro-batch of new files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELL_FILE = T.StructType([T.StructField(n, t) for n, t in (("geometry_id", T.LongType()), ("measurement_id", T.LongType()), ("channel0", T.IntegerType()), ("channel1", T.IntegerType()), ("timestamp", T.FloatType()), ("value", T.FloatType()))])


def cell_stream(spark: SparkSession, path: str, *, files_per_batch: int = 64) -> DataFrame:
    """Cells of event files as they arrive; an event is one file, so a micro-batch holds whole events."""
    rows = spark.readStream.schema(CELL_FILE).option("header", True).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "event*-cells.csv").csv(path)
    return rows.withColumn("event_id", F.regexp_extract(F.col("_metadata.file_path"), r"event(\d{9})-", 1).cast("long"))


def run_stage(stream: DataFrame, stage: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, *, once: bool = True):
    """Apply ``stage`` to each micro-batch and append the result to the Parquet table ``out``.

    A batch that is repeated after a failure overwrites its own folder, so its rows are there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        stage(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
