"""Evaluation metrics (A1–A12), pairing joins (J3, J4, J9) and result filters.

A2–A4 share one aggregate to (expected, predicted, n): a map-side combined
group-by whose output is tiny (labels², not rows), so every metric after it
costs nothing and skewed labels never reach one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbiter.functions.subquery import row_value
from arbiter.operators.ordinal import group_quantiles
from arbiter.sources.catalogue import INVALID_LABEL


def _ratio(num: Column, den: Column) -> Column:
    return F.coalesce(num / F.nullif(den, F.lit(0)), F.lit(0.0)).cast("double")


def cells(df: DataFrame, expected: str = "expected", predicted: str = "label") -> DataFrame:
    """(expected, predicted, n): the only pass over the scored rows."""
    return df.groupBy(
        F.col(expected).alias("expected"), F.col(predicted).alias("predicted")
    ).agg(F.count(F.lit(1)).alias("n"))


def headline(c: DataFrame) -> DataFrame:
    """A2: n, correct, accuracy, invalid_count, invalid_rate (all zero when n = 0)."""
    hit = F.col("predicted").isNotNull() & (F.col("predicted") == F.col("expected"))
    agg = c.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("correct"),
        F.coalesce(F.sum(F.when(F.col("predicted").isNull(), F.col("n"))), F.lit(0)).alias(
            "invalid_count"
        ),
    )
    return agg.select(
        "n",
        "correct",
        _ratio(F.col("correct"), F.col("n")).alias("accuracy"),
        "invalid_count",
        _ratio(F.col("invalid_count"), F.col("n")).alias("invalid_rate"),
    )


def per_class(c: DataFrame) -> DataFrame:
    """A3: recall per expected label; null expected is not a class."""
    return (
        c.where(F.col("expected").isNotNull())
        .groupBy("expected")
        .agg(
            F.sum("n").alias("n"),
            F.coalesce(
                F.sum(F.when(F.col("predicted") == F.col("expected"), F.col("n"))), F.lit(0)
            ).alias("correct"),
        )
        .withColumn("accuracy", _ratio(F.col("correct"), F.col("n")))
    )


def confusion(c: DataFrame) -> DataFrame:
    """A4 long form: (expected, predicted or '<invalid>', n)."""
    return (
        c.where(F.col("expected").isNotNull())
        .groupBy("expected", F.coalesce("predicted", F.lit(INVALID_LABEL)).alias("predicted"))
        .agg(F.sum("n").alias("n"))
    )


OTHER_LABEL = "<other>"


def confusion_wide(c: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """A4 wide form: one column per predicted label, ``<invalid>`` and, where ``labels``
    names the columns, ``<other>`` for predictions outside them. No prediction is lost:
    without ``labels`` the columns are the labels that occur (a label set, not data)."""
    long = confusion(c)
    if labels is None:
        labels = sorted(r[0] for r in long.select("predicted").distinct().collect() if r[0] != INVALID_LABEL)
        cols = [*labels, INVALID_LABEL]
    else:
        cols = [*labels, INVALID_LABEL, OTHER_LABEL]
        long = long.withColumn("predicted", F.when(F.col("predicted").isin(cols), F.col("predicted")).otherwise(OTHER_LABEL))
    return long.groupBy("expected").pivot("predicted", cols).agg(F.sum("n")).fillna(0)


def latency_stats(df: DataFrame, group_cols: list[str], value: str) -> DataFrame:
    """A5: n, avg, p50, p95, max per group, with the rule quantile
    sorted[min(n-1, floor(p*n))] computed exactly (see ordinal.py)."""
    basic = df.groupBy(*group_cols).agg(
        F.count(value).alias("n"), F.avg(value).alias("avg"), F.max(value).alias("max")
    )
    q = group_quantiles(df, group_cols, value, {"p50": 0.5, "p95": 0.95})
    if not group_cols:  # one row each: attach as a scalar, not a keyless join
        one = row_value(q)
        return basic.select("*", one["p50"].alias("p50"), one["p95"].alias("p95"))
    return basic.join(q, group_cols, "left")


def run_stats(results: DataFrame, latency: str, client: str, ts: str) -> DataFrame:
    """Done, avg network overhead max(0, client − engine), throughput done/second."""
    agg = results.agg(
        F.count(F.lit(1)).alias("done"),
        F.avg(F.greatest(F.lit(0.0), F.col(client) - F.col(latency))).alias("net_avg_ms"),
        (
            (F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp")))
            / 1e6
        ).alias("secs"),
    )
    return agg.select(
        "done",
        F.coalesce("net_avg_ms", F.lit(0.0)).alias("net_avg_ms"),
        F.coalesce("secs", F.lit(0.0)).alias("secs"),
        F.when(F.col("secs") > 0, F.col("done") / F.col("secs")).otherwise(0.0).alias("throughput"),
    )


def coverage(tickets: DataFrame) -> DataFrame:
    """Counts over every combination of category and display tag (cube)."""
    tag = F.coalesce("variant", "adversarial", "tag").alias("display_tag")
    return (
        tickets.select("category", tag)
        .cube("category", "display_tag")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
    )


def violation_counts(violations: DataFrame) -> DataFrame:
    """A10: rollup(split, rule)."""
    return violations.rollup("split", "rule").agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid")
    )


def report_lines(head: DataFrame, classes: DataFrame, title: str = "Evaluation") -> DataFrame:
    """The text report as (line_no, line) rows over the tiny metric tables."""
    rule = "-" * len(title)
    top = head.select(
        F.array(
            F.lit(title),
            F.lit(rule),
            F.lit(""),
            F.format_string("Examples:           %d", "n"),
            F.format_string("Accuracy:           %.1f%%", F.col("accuracy") * 100),
            F.format_string("Invalid outputs:    %.1f%%", F.col("invalid_rate") * 100),
            F.lit(""),
            F.lit("Per-class:"),
        ).alias("lines")
    ).select(F.posexplode("lines").alias("line_no", "line"))
    # One row per class: the classes table is tiny, so one ordered window is fine.
    by_label = Window.orderBy("expected")
    per = classes.select(
        (F.lit(7) + F.row_number().over(by_label)).alias("line_no"),
        F.format_string("%-20s%.1f%%", "expected", F.col("accuracy") * 100).alias("line"),
    )
    return top.unionByName(per)


# ---- pairing joins --------------------------------------------------------------


def pair(expected: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """Full outer join by key; unmatched sides show up with a null column."""
    return expected.join(predicted, key, "full_outer")


def compare_runs(base: DataFrame, tuned: DataFrame, key: str = "rec_id", by: list[str] | None = None) -> DataFrame:
    """Same records, two predictors — accuracy and invalid rate side by side,
    plus fixed (wrong → right) and broken (right → wrong) counts, per ``by``.

    ``base`` carries key, expected, label (and the ``by`` columns); ``tuned``
    carries key and label."""
    by = by or []
    b = base.select(key, *by, "expected", F.col("label").alias("base_label"))
    t = tuned.select(key, F.col("label").alias("tuned_label"))
    j = b.join(t, key)
    right_b = F.col("base_label").isNotNull() & (F.col("base_label") == F.col("expected"))
    right_t = F.col("tuned_label").isNotNull() & (F.col("tuned_label") == F.col("expected"))
    agg = j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(right_b.cast("long")).alias("base_correct"),
        F.sum(right_t.cast("long")).alias("tuned_correct"),
        F.sum(F.col("base_label").isNull().cast("long")).alias("base_invalid"),
        F.sum(F.col("tuned_label").isNull().cast("long")).alias("tuned_invalid"),
        F.sum((~right_b & right_t).cast("long")).alias("fixed"),
        F.sum((right_b & ~right_t).cast("long")).alias("broken"),
    )
    return agg.select(
        *by,
        "n",
        _ratio(F.col("base_correct"), F.col("n")).alias("base_accuracy"),
        _ratio(F.col("tuned_correct"), F.col("n")).alias("tuned_accuracy"),
        _ratio(F.col("base_invalid"), F.col("n")).alias("base_invalid_rate"),
        _ratio(F.col("tuned_invalid"), F.col("n")).alias("tuned_invalid_rate"),
        F.coalesce("fixed", F.lit(0)).alias("fixed"),
        F.coalesce("broken", F.lit(0)).alias("broken"),
    )


def result_filters() -> dict[str, Column]:
    """the condition of each filter; ``wrong`` is scored and label ≠ expected, null labels included."""
    scored = F.col("status").isNotNull()
    return {
        "all": F.lit(True),
        "correct": scored & F.equal_null(F.col("label"), F.col("expected")),
        "wrong": scored & ~F.equal_null(F.col("label"), F.col("expected")),
        "adversarial": F.col("adversarial").isNotNull(),
        "variations": F.col("variant").isNotNull(),
    }


def filter_results(joined: DataFrame, which: str) -> DataFrame:
    """all / correct / wrong / adversarial / variations over tickets ⟕ results."""
    return joined.where(result_filters()[which])


def pending(tickets: DataFrame, results: DataFrame, key: str = "id") -> DataFrame:
    """tickets not scored yet (left anti join)."""
    return tickets.join(results.select(key), key, "left_anti")
