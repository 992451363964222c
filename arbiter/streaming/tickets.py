"""Structured Streaming: continuous ticket classification (T1) and running decision counts.
Runs that stop, continue and reset are in ``runs.py``, latency statistics in ``running.py``.

Sources are file streams (new files = arriving tickets); every query has a
checkpoint in the shared checkpoint folder so a lost executor or a restarted
driver resumes where it stopped. Tests and the registered queries use
``trigger(availableNow=True)`` so a stream drains what is there and stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbiter.operators.rules import classify

DECISION_COLS = ["id", "expected", "conclusion", "label", "status"]


def decide(tickets: DataFrame) -> DataFrame:
    """The result row of each ticket (rules, no state)."""
    return classify(tickets).select(*DECISION_COLS)


def ticket_stream(spark: SparkSession, source_dir: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(source_dir)


def classify_stream(stream: DataFrame, sink_dir: str, checkpoint: str, available_now: bool = True):
    """Decide each ticket as it arrives; exactly-once parquet sink."""
    writer = (
        decide(stream).writeStream.format("parquet")
        .option("path", sink_dir)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def stats_stream(stream: DataFrame, stats_dir: str, checkpoint: str, available_now: bool = True):
    """Running (expected, label) counts; each batch writes a snapshot folder of its own.

    The aggregate is labels² rows however many tickets arrive, so the
    complete-mode state and the snapshot stay small. Readers take the newest complete
    one (``read_stats``), so none ever sees half a snapshot.
    """
    cells = (
        classify(stream)
        .groupBy(F.col("expected"), F.col("label").alias("predicted"))
        .agg(F.count(F.lit(1)).alias("n"))
    )

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{stats_dir}/epoch={epoch}")

    writer = cells.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def read_stats(spark: SparkSession, stats_dir: str) -> DataFrame:
    """The newest snapshot of ``stats_stream``."""
    all_ = spark.read.parquet(stats_dir)
    return all_.where(F.col("epoch") == all_.agg(F.max("epoch")).scalar()).drop("epoch")
