"""Statistics of a run while its results arrive.

The state is one row per (expected, label, latency bin): counts, an exact decimal sum, the largest
value, network times, first and last time. Rows of any two parts of a run add up, so the state is a
mergeable sketch: counts, recall per class, averages and the maximum are exact; a quantile is known to
the bin that holds its position. Bins split each power of ten into 900 parts, so a quantile is off by
half a bin: at most 0.5 % of its value, and ``p50_error``/``p95_error`` state how much. The state holds
at most (classes + 1)^2 * 10,801 rows however many results arrive.

Defined results: a null latency counts as 0; latencies below 0.001 (also negative ones) share bin 0
and count as 0 there, with an error of 0.001 (their sum and maximum stay exact); from 10^9 on all share
the last bin, whose error is not bounded and therefore null. A null label is an invalid result, a null
expected label is no class. No results: counts of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbiter.operators.metrics import headline, per_class
from arbiter.functions.subquery import row_value

#: Powers of ten that bins cover: values from 10^LOW to 10^HIGH.
LOW, HIGH = -3, 9
LAST = (HIGH - LOW + 1) * 1000
MONEY = "decimal(38,9)"


def latency_bin(value: Column) -> Column:
    """Bin number: 0 below 10^LOW, else 1000 * (decade + 1) + the first three digits (100 to 999)."""
    out = F.lit(LAST)
    for k, e in reversed(list(enumerate(range(LOW, HIGH)))):
        digits = F.least(F.greatest(F.floor(value / F.lit(10.0 ** (e - 2))), F.lit(100)), F.lit(999))
        out = F.when(value < F.lit(10.0 ** (e + 1)), F.lit(1000 * (k + 1)) + digits).otherwise(out)
    return F.when(value < F.lit(10.0**LOW), F.lit(0)).otherwise(out).cast("int")


def bin_value(bin_: Column) -> tuple[Column, Column]:
    """(middle of a bin, half its width)."""
    step = F.pow(F.lit(10.0), F.floor(bin_ / 1000) - 1 + LOW - 2)
    middle = F.when(bin_ == 0, F.lit(0.0)).otherwise((F.pmod(bin_, F.lit(1000)) + 0.5) * step)
    error = F.when(bin_ == 0, F.lit(10.0**LOW)).otherwise(step / 2)
    return middle, F.when(bin_ < LAST, error)


def run_cells(results: DataFrame) -> DataFrame:
    """The sketch of a run's results: batch or stream of expected, label, latency_ms, client_ms, ts."""
    latency = F.coalesce("latency_ms", F.lit(0.0))
    net = F.greatest(F.lit(0.0), F.col("client_ms") - latency)
    return results.groupBy("expected", F.col("label").alias("predicted"), latency_bin(latency).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(latency.cast(MONEY)).alias("latency_sum"),
        F.max(latency).alias("latency_max"),
        F.count(net).alias("net_n"),
        F.sum(net.cast(MONEY)).alias("net_sum"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def run_stats_stream(stream: DataFrame, stats_dir: str, checkpoint: str, available_now: bool = True):
    """Keep the sketch of arriving results; every micro-batch writes a snapshot folder of its own."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{stats_dir}/epoch={epoch}")

    writer = run_cells(stream).writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(write)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def snapshots(spark: SparkSession, stats_dir: str) -> DataFrame:
    """All snapshots; ``epoch`` is the micro-batch after which one was written."""
    return spark.read.parquet(stats_dir)


def newest(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("epoch") == cells.agg(F.max("epoch")).scalar()).drop("epoch")


def run_quantiles(cells: DataFrame, probs: dict[str, float]) -> DataFrame:
    """One row: each quantile (rule sorted[min(n - 1, floor(p * n))]) with its error."""
    bins = cells.groupBy("bin").agg(F.sum("n").alias("n"))
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # one row a bin
    bins = bins.withColumns({"end": F.sum("n").over(upto), "total": F.sum("n").over(Window.partitionBy())})
    cols = []
    for name, p in probs.items():
        place = F.least(F.col("total") - 1, F.floor(F.col("total") * F.lit(p)))
        value, error = bin_value(F.min(F.when(F.col("end") > place, F.col("bin"))))
        cols += [value.alias(f"{name}_ms"), error.alias(f"{name}_error")]
    return bins.agg(*cols)


def run_stats(cells: DataFrame) -> DataFrame:
    """One row: done, correct, invalid and rates, average, quantiles, maximum, network time, throughput."""
    head = row_value(headline(cells))
    q = row_value(run_quantiles(cells, {"p50": 0.5, "p95": 0.95}))
    secs = (F.unix_micros(F.max("last_ts").cast("timestamp")) - F.unix_micros(F.min("first_ts").cast("timestamp"))) / 1e6
    one = cells.agg(
        F.coalesce((F.sum("latency_sum") / F.sum("n")).cast("double"), F.lit(0.0)).alias("avg_ms"),
        F.max("latency_max").alias("max_ms"),
        F.coalesce((F.sum("net_sum") / F.nullif(F.sum("net_n"), F.lit(0))).cast("double"), F.lit(0.0)).alias("net_avg_ms"),
        F.coalesce(secs, F.lit(0.0)).alias("secs"),
    )
    done = head["n"]
    return one.select(
        done.alias("done"), head["correct"].alias("correct"), head["invalid_count"].alias("invalid"),
        head["accuracy"].alias("accuracy"), head["invalid_rate"].alias("invalid_rate"), "avg_ms",
        *[q[c].alias(c) for c in ("p50_ms", "p50_error", "p95_ms", "p95_error")], "max_ms", "net_avg_ms", "secs",
        F.when(F.col("secs") > 0, done / F.col("secs")).otherwise(0.0).alias("throughput"),
    )


def class_stats(cells: DataFrame) -> DataFrame:
    """Recall per expected label."""
    return per_class(cells)
