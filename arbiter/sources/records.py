"""Record sources and sinks.

Scans use an explicit schema (no inference pass over 100 TB) and either
FAILFAST (abort on the first bad line, like the original loader) or
PERMISSIVE with a quarantine column. Sinks are partitioned by split.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbiter.functions.json import json_text, parse_json
from arbiter.functions.subquery import row_value
from arbiter.functions.text import py_strip

RECORD_SCHEMA = (
    "rec_id BIGINT, state STRING, question STRING, "
    "options ARRAY<STRUCT<label: STRING, key: STRING, description: STRING>>, answer STRING"
)
CORRUPT = "_corrupt_record"


def read_records(spark: SparkSession, paths, mode: str = "FAILFAST", schema: str = RECORD_SCHEMA) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped by the reader.

    PERMISSIVE keeps bad lines in ``_corrupt_record`` (quarantine them with
    ``quarantine``); FAILFAST aborts the job on the first malformed line.
    """
    reader = spark.read.schema(f"{schema}, {CORRUPT} STRING" if mode == "PERMISSIVE" else schema)
    reader = reader.option("mode", mode).option("columnNameOfCorruptRecord", CORRUPT)
    df = reader.json(paths)
    return df.withColumn("source_file", F.col("_metadata.file_path"))


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    bad = F.col(CORRUPT).isNotNull()
    return df.where(~bad).drop(CORRUPT), df.where(bad)


def write_records(df: DataFrame, path: str, by: str = "split") -> None:
    """UTF-8 JSON lines (non-ASCII kept), one folder per split."""
    df.write.mode("overwrite").partitionBy(by).json(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = spark.sparkContext.getCheckpointDir()
    if not base:
        raise RuntimeError("no checkpoint directory; call session.ensure_checkpoint_dir first")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def parse_record_json(df: DataFrame, body: str = "body") -> DataFrame:
    """S1 on a column: from_json with the record schema (null = malformed)."""
    return df.withColumn("rec", F.from_json(F.col(body), RECORD_SCHEMA))


def split_states(df: DataFrame, blob: str, batch_key: str) -> DataFrame:
    """S3: a blob is a JSON array (leading ``[``) or blank-line separated
    states; each state stripped, empties dropped, numbered from 1.

    Returns (batch_key, item_no, state) plus ``error`` rows for empty batches
    and invalid JSON arrays (item_no null).
    """
    # One step a column: a text used twice within one select is stripped and parsed for every use
    # (and a filter before the explode would be pushed down and re-parse the blob).
    stripped = df.select(F.col(batch_key), py_strip(F.coalesce(F.col(blob), F.lit(""))).alias("_raw"))
    is_json = F.startswith("_raw", F.lit("["))
    split = stripped.select(batch_key, "_raw", F.when(is_json, F.col("_raw")).alias("_json"))
    # JSON elements are kept as they are; text blocks are stripped, empties dropped.
    arr = F.transform(F.try_variant_get(parse_json(F.col("_json")), "$", "array<variant>"), json_text)
    blocks = F.filter(F.transform(F.split("_raw", "\n\n", -1), py_strip), lambda s: s != "")
    states = F.when(F.col("_json").isNotNull(), arr).otherwise(blocks)
    parsed = split.select(batch_key, "_raw", states.alias("states"))
    error = (
        F.when(F.col("_raw") == "", "empty batch")
        .when(F.col("states").isNull(), "invalid JSON array")
        .when(F.size("states") == 0, "empty batch")
    )
    with_err = parsed.select(batch_key, "states", error.alias("error"))
    ok = with_err.select(
        batch_key, F.posexplode(F.when(F.col("error").isNull(), F.col("states"))).alias("pos", "state")
    )
    return ok.select(batch_key, (F.col("pos") + 1).alias("item_no"), "state"), with_err.where(
        F.col("error").isNotNull()
    ).select(batch_key, "error")


def parse_requests(df: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Request JSON → typed (state, question, options) or a rejection reason."""
    df = df.withColumn("_v", parse_json(F.col(body)))
    v = F.col("_v")
    is_obj = F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    opts = F.try_variant_get(v, "$.options", "string")
    reason = (
        F.when(v.isNull(), "invalid JSON")
        .when(~is_obj, "not an object")
        .when(opts.isNull() | (opts == ""), "missing options")
    )
    typed = df.select(
        "*",
        reason.alias("reason"),
        F.coalesce(F.try_variant_get(v, "$.state", "string"), F.lit("")).alias("state"),
        F.coalesce(F.try_variant_get(v, "$.question", "string"), F.lit("")).alias("question"),
        opts.alias("options_text"),
    )
    typed = typed.drop("_v")
    return typed.where(F.col("reason").isNull()).drop("reason"), typed.where(F.col("reason").isNotNull())


def head_n(df: DataFrame, n: int | None, order_cols: list[str]) -> DataFrame:
    """First n rows in an explicit (total) order; 0 or None means all rows.

    Spark's top-k: each task keeps its best n and one merge ends it (n is the caller's).
    """
    return df.orderBy(*order_cols).limit(n) if n else df


def catalogue(df: DataFrame) -> DataFrame:
    """The listing's count."""
    return df.agg(F.count(F.lit(1)).alias("count"))


def listing(df: DataFrame) -> DataFrame:
    """The listing itself, each ticket with the label it should get."""
    return df.select(
        "id", "category", "tag", "state", "question", F.transform("options", lambda o: o["label"]).alias("labels"), "expected"
    )


def export_results(
    summary: DataFrame, per_class: DataFrame, tickets: DataFrame, path: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """The run export as {summary, perClass} (one small JSON document,
    bounded by the number of classes) plus one JSON line per ticket.

    The per-ticket part stays a distributed table rather than a list inside
    the document, so an export of any size is written by all tasks. With
    ``path`` both are written under it (``summary/`` and ``tickets/``).
    """
    doc, lines = _export_frames(summary, per_class, tickets)
    if path:
        doc.coalesce(1).write.mode("overwrite").text(f"{path}/summary")
        lines.write.mode("overwrite").text(f"{path}/tickets")
    return doc, lines


def _export_frames(summary: DataFrame, per_class: DataFrame, tickets: DataFrame) -> tuple[DataFrame, DataFrame]:
    pc = per_class.agg(
        F.map_from_entries(
            F.collect_list(
                F.struct(
                    F.col("expected"),
                    F.struct(
                        F.col("n"), F.col("correct"), F.round("accuracy", 4).alias("accuracy")
                    ),
                )
            )
        ).alias("perClass")
    )
    doc = summary.select(
        F.struct(*summary.columns).alias("summary"),
        row_value(pc)["perClass"].alias("perClass"),
    )
    lines = tickets.select(F.to_json(F.struct(*tickets.columns)).alias("value"))
    return doc.select(F.to_json(F.struct("summary", "perClass")).alias("value")), lines
