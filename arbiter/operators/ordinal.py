"""Exact positions within groups without a per-group window.

``row_number() over (partition by g order by v)`` sends each whole group to
one task; with one group holding a third of all rows that task becomes the
job. Instead we range-partition on (g, v) — a hot group spreads over many
partitions — number rows inside each partition, and add the count of the
group's rows in earlier partitions. The per-(partition, group) count table
has at most partitions + groups rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbiter.session import staged

ROWS_PER_PARTITION = 1_000_000
_PID = "_ord_pid"
_LOCAL = "_ord_local"


def ordinal_within(
    df: DataFrame,
    group_cols: list[str],
    order_cols: list[str],
    out: str = "pos",
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``out`` = 0-based position of each row inside its group.

    ``order_cols`` must make the order total (add a unique key as last
    tie-breaker), otherwise positions among equal rows are arbitrary — but
    still a permutation.
    """
    keys = [*group_cols, *order_cols]
    # As many partitions as the rows need: the table decides, not a session default.
    df = staged(df, "ordinal-rows")
    n = num_partitions or max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_PARTITION))
    ranged = df.repartitionByRange(n, *keys)
    ranged = ranged.sortWithinPartitions(*keys).withColumn(_PID, F.spark_partition_id())
    # Inside a sorted partition this id grows with the sort order.
    ranged = ranged.withColumn(_LOCAL, F.monotonically_increasing_id())
    # Range bounds come from sampling, so two evaluations of this plan may cut
    # the key space differently. Write it once (shared checkpoint folder) and
    # take the counts and the rows from the same materialisation.
    ranged = staged(ranged, "ordinal")
    counts = ranged.groupBy(_PID, *group_cols).agg(
        F.count(F.lit(1)).alias("_ord_n"), F.min(_LOCAL).alias("_ord_first")
    )
    before = Window.partitionBy(*group_cols).orderBy(_PID).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        _PID,
        *group_cols,
        "_ord_first",
        F.coalesce(F.sum("_ord_n").over(before), F.lit(0)).alias("_ord_offset"),
    )
    joined = ranged.join(offsets, [_PID, *group_cols])
    return joined.withColumn(
        out, F.col("_ord_offset") + F.col(_LOCAL) - F.col("_ord_first")
    ).drop(_PID, _LOCAL, "_ord_first", "_ord_offset")


CUTS = 64


def group_quantiles(
    df: DataFrame, group_cols: list[str], value_col: str, probs: dict[str, float]
) -> DataFrame:
    """Exact rule quantile per group: sorted[min(n-1, floor(p*n))].

    Returns one row per group with a column per entry of ``probs``. No sort of the
    data: approximate cut points split each group's values into ``CUTS`` bins, exact
    bin counts (combined before the shuffle) tell which bin holds each wanted
    position, and only the distinct values of those bins are counted and ordered. A
    value on a third of all rows is one (value, count) row a task.
    """
    # Read three times, so whatever computes the values runs once.
    data = staged(df.select(*group_cols, F.col(value_col).alias("_v")).where(F.col(value_col).isNotNull()), "values")
    key = [F.col(c) for c in group_cols]
    cuts = staged(
        data.groupBy(*key).agg(
            F.array_distinct(F.percentile_approx("_v", [i / CUTS for i in range(1, CUTS)], F.lit(10_000))).alias("_cuts")
        ),
        "cuts",
    )
    binned = _attach(data, cuts, group_cols).withColumn("_bin", F.size(F.filter("_cuts", lambda x: x < F.col("_v"))))
    bins = binned.groupBy(*key, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    # At most CUTS rows a group.
    w = Window.partitionBy(*key) if group_cols else Window.partitionBy(F.lit(0))
    upto = w.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.select(
        *key, "_bin", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"), "_n", F.sum("_n").over(w).alias("_all")
    )
    wanted = F.array(
        *[
            F.struct(
                F.lit(name).alias("q"),
                F.least(F.col("_all") - 1, F.floor(F.col("_all") * F.lit(p).cast("double"))).cast("long").alias("k"),
            )
            for name, p in probs.items()
        ]
    )
    held = F.filter(wanted, lambda t: (t["k"] >= F.col("_before")) & (t["k"] < F.col("_before") + F.col("_n")))
    bins = staged(bins.select(*key, "_bin", "_before", held.alias("_q")).where(F.size("_q") > 0), "wanted-bins")
    inside = _attach(binned.drop("_cuts"), bins, [*group_cols, "_bin"])
    inside = inside.groupBy(*key, "_bin", "_before", "_q", "_v").agg(F.count(F.lit(1)).alias("_c"))
    run = Window.partitionBy(*key, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_end", F.col("_before") + F.sum("_c").over(run))
    inside = inside.select(*key, "_v", "_end", "_c", F.explode("_q").alias("t")).where(
        (F.col("t.k") < F.col("_end")) & (F.col("t.k") >= F.col("_end") - F.col("_c"))
    )
    return inside.groupBy(*key).pivot("t.q", list(probs)).agg(F.first("_v"))


def _attach(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Join on columns that may hold nulls; without columns, ``small`` is one row."""
    if not on:
        one = small.select(F.struct(*small.columns)).scalar()
        return rows.select("*", *[one[c].alias(c) for c in small.columns])
    renamed = small.select(*[F.col(c).alias(f"_k{i}") if c in on else F.col(c) for i, c in enumerate(small.columns)])
    names = {c: f"_k{i}" for i, c in enumerate(small.columns) if c in on}
    cond = None
    for c in on:
        e = rows[c].eqNullSafe(renamed[names[c]])
        cond = e if cond is None else cond & e
    return rows.join(renamed, cond).drop(*names.values())
