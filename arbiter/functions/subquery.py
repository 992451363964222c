"""Attaching single-row results to every row without a join.

A one-row aggregate (a count, a constant, a small class table folded into an
array) is evaluated once as a scalar subquery and read as a literal by every
task, so no join — and no nested-loop join — appears in the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def row_value(one_row: DataFrame) -> Column:
    """struct of the single row of ``one_row`` (a scalar subquery)."""
    return one_row.select(F.struct(*one_row.columns)).scalar()


def class_array(classes: DataFrame) -> Column:
    """The class table as one array value (its size is the label set's, not the data's)."""
    return classes.select(F.collect_list(F.struct(*classes.columns))).scalar()


def attach_classes(items: DataFrame, classes: DataFrame) -> DataFrame:
    """One row per (item, class): the class array is exploded next to each item, no join."""
    out = items.select("*", F.explode(class_array(classes)).alias("_c"))
    return out.select(*items.columns, *[F.col(f"_c.{c}").alias(c) for c in classes.columns])
