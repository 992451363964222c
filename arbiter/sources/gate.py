"""F2 with S2: records are checked while they are written, and published only when all are right.

One job reads, checks and writes: the written rows pass an ``observe`` that counts violations by split.
The files go to a staging folder beside the target; the target appears by a rename once every split's
count is zero, and otherwise the folder is deleted and the failing splits are named with their counts.

Defined results: a split not among ``splits`` is counted under its own heading ``other``; a null split
likewise; no records publish an empty folder. An existing target is an error before anything is read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

SPLITS = ("train", "valid", "test")
OTHER = "other"


class GateClosed(ValueError):
    """Splits that failed, with their violations: ``counts``."""

    def __init__(self, counts: dict[str, int]):
        bad = {s: n for s, n in counts.items() if n}
        super().__init__("Validation failed for " + ", ".join(f"{s}: {n} error(s)" for s, n in bad.items()))
        self.counts = counts


def observed(records: DataFrame, violations: Column, by: str, splits: tuple[str, ...]) -> tuple[DataFrame, Observation]:
    """``records`` with an observation of the violations (``violations``: a count per row) of each split."""
    known = F.col(by).isin(*splits)
    counts = [F.sum(F.when(F.col(by) == s, violations)).alias(s) for s in splits]
    counts.append(F.sum(F.when(F.coalesce(~known, F.lit(True)), violations)).alias(OTHER))
    seen = Observation()
    return records.observe(seen, *counts), seen


def write_checked(
    records: DataFrame, violations: Column, path: str, by: str = "split", splits: tuple[str, ...] = SPLITS,
    columns: list[str] | None = None,
) -> dict[str, int]:
    """Write ``columns`` as JSON lines, a folder per split, if no record has a violation; else raise.

    Returns the counts (all zero). Nothing stands at ``path`` unless all records are right.
    """
    spark = records.sparkSession
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target = fs_path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(path)
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    rows, seen = observed(records.withColumn("_n", violations), F.col("_n"), by, splits)
    kept = [c for c in (columns or records.columns) if c != by]
    try:
        rows.select(by, *kept).write.partitionBy(by).json(staging)
        counts = {s: int(n or 0) for s, n in seen.get.items()}
        if any(counts.values()):
            raise GateClosed(counts)
        if not fs.rename(fs_path(staging), target):
            raise OSError(f"cannot publish {path}")
    finally:
        fs.delete(fs_path(staging), True)
    return counts
