"""Cross-split leakage (J1) and global duplicate states.

Both shuffle a 256-bit digest of STATE instead of the text. The first owner of a
state is found by a map-side combined ``min`` (a state repeated by a third of
all rows collapses to one row per task before the shuffle). Joining it back is
many-to-one: a hot leaked state is one key of that join, which adaptive execution
splits; no window over a state group is ever formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLIT_NAMES = ["train", "valid", "test"]


def state_digest(col: str = "state"):
    return F.sha2(F.col(col), 256)


def leakage(records: DataFrame, preview_chars: int = 80) -> DataFrame:
    """Rows whose exact state was first seen in an earlier split.

    ``records`` needs rec_id, split_rank (0 train, 1 valid, 2 test), state.
    Returns (first_split, split, rec_id, preview); rows that share a rec_id are rows of their own.
    """
    # The preview's few characters travel with the row: ids may repeat, so nothing is fetched by id.
    preview = F.substring("state", 1, preview_chars).alias("preview")
    keyed = records.select("rec_id", "split_rank", state_digest().alias("h"), preview)
    seen = keyed.groupBy("h").agg(F.min("split_rank").alias("first_rank"), F.max("split_rank").alias("last_rank"))
    # Only states of several splits come back to the rows.
    first = seen.where("last_rank > first_rank").drop("last_rank")
    leaks = keyed.join(first, "h").where(F.col("split_rank") > F.col("first_rank")).drop("h")
    names = F.array(*[F.lit(s) for s in SPLIT_NAMES])
    return leaks.select(
        F.get(names, F.col("first_rank")).alias("first_split"),
        F.get(names, F.col("split_rank")).alias("split"),
        "rec_id",
        "preview",
    )


def leakage_counts(leaks: DataFrame) -> DataFrame:
    return leaks.groupBy("first_split", "split").agg(F.count(F.lit(1)).alias("n"))


def duplicate_states(records: DataFrame) -> DataFrame:
    """States occurring more than once anywhere (also within a split)."""
    return (
        records.groupBy(state_digest().alias("state_sha256"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
    )
