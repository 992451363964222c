"""Reconciliation joins: J6 (two-sided match with tolerance), J7 (duplicates),
J8 (missing references).

Each side is first reduced to one row per reference with a map-side combined
aggregate, so the join is one-to-one: a reference carrying a third of all
rows costs one row per task after the partial aggregate, not a hot join key.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbiter.operators.rules import conclude_recon
from arbiter.sources.fixtures import facts

MONEY = "decimal(24,2)"


def reduce_side(df: DataFrame, key: str, amount, currency=None, prefix: str = "l") -> DataFrame:
    """One row per reference: count, summed amount (DECIMAL), currency.

    Without a currency column no string aggregate is planned, so the
    aggregate stays a (codegen'd) hash aggregate instead of a sort aggregate.
    """
    aggs = [
        F.count(F.lit(1)).alias(f"{prefix}_n"),
        F.round(F.sum(amount), 2).cast(MONEY).alias(f"{prefix}_amount"),
    ]
    if currency is not None:
        aggs.append(F.min(currency).alias(f"{prefix}_cur"))
    out = df.groupBy(F.col(key).alias("ref")).agg(*aggs)
    if currency is None:
        out = out.withColumn(f"{prefix}_cur", F.lit(None).cast("string"))
    return out


def reconcile(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    left_amount,
    right_amount,
    left_currency=None,
    right_currency=None,
    tolerance: float | None = None,
    relative: bool = True,
    dedupe_left: bool = True,
) -> DataFrame:
    """(ref, a, b, cur_a, cur_b, status ∈ match / mismatch / needs_review).

    Missing on either side ⇒ needs_review; repeated left reference ⇒
    duplicate ⇒ mismatch; currencies differ ⇒ mismatch; equal amounts ⇒
    match; |a − b| ≤ tolerance (inclusive, unrounded; relative tolerances scale
    |b|) ⇒ match. A row without a reference belongs to no other row: each is a
    ``needs_review`` row of its own.
    """
    lside = reduce_side(left.where(F.col(left_key).isNotNull()), left_key, left_amount, left_currency, "l")
    rside = reduce_side(right.where(F.col(right_key).isNotNull()), right_key, right_amount, right_currency, "r")
    j = lside.join(rside, "ref", "full_outer")
    tol = None
    if tolerance is not None:
        t = F.lit(Decimal(str(tolerance)))
        tol = (t * F.abs(F.col("r_amount"))) if relative else t
    f = facts(
        kind=F.lit("recon"),
        a=F.col("l_amount"),
        b=F.col("r_amount"),
        curA=F.col("l_cur"),
        curB=F.col("r_cur"),
        missingRef=F.col("l_n").isNull() | F.col("r_n").isNull(),
        duplicate=(F.col("l_n") > 1) if dedupe_left else F.lit(False),
        dupVocab=F.lit(False),
    )
    # The facts type rounds to cents; amounts and the tolerance are compared as they are.
    f = f.withField("a", F.col("l_amount")).withField("b", F.col("r_amount"))
    f = f.withField("tolerance", F.lit(None).cast(MONEY) if tol is None else tol)
    out = j.select(
        "ref",
        F.col("l_amount").alias("a"),
        F.col("r_amount").alias("b"),
        conclude_recon(f).alias("conclusion"),
    )
    none = F.lit(None).cast(MONEY)
    review = F.lit("needs_review").alias("conclusion")

    def alone(side: DataFrame, key: str, amount, at: int) -> DataFrame:
        value = F.round(amount, 2).cast(MONEY)
        pair = [value if i == at else none for i in (0, 1)]
        return side.where(F.col(key).isNull()).select(
            F.col(key).alias("ref"), pair[0].alias("a"), pair[1].alias("b"), review
        )

    out = out.unionByName(alone(left, left_key, left_amount, 0)).unionByName(alone(right, right_key, right_amount, 1))
    return out.withColumn(
        "status",
        F.when(F.col("conclusion") == "needs_review", "needs_review")
        .when(F.col("conclusion").isin("match", "unique"), "match")
        .otherwise("mismatch"),
    )


def find_duplicates(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Every row after the first of its key group, the order made total
    by ``order`` then all remaining columns (identical rows: all but one).

    Identical rows are collapsed with a count first, the first row per key
    is a map-side ``min(struct)``, and the survivors are re-expanded by count.
    """
    cols = df.columns
    rest = [c for c in cols if c not in keys and c not in order]
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_copies"))
    ordkey = F.struct(*[F.col(c) for c in [*order, *rest]])
    first = counted.groupBy(*keys).agg(F.min(ordkey).alias("_first"))
    j = counted.join(first, keys)
    extra = F.col("_copies") - F.when(F.equal_null(ordkey, F.col("_first")), 1).otherwise(0)
    kept = j.select(*cols, extra.alias("_extra")).where(F.col("_extra") > 0)
    # Copies are cut into chunks of at most COPY_CHUNK and the chunks (only the
    # duplicated rows, before expansion) are spread over tasks, so a row
    # repeated by a third of the table is expanded by many tasks, not one.
    return (
        kept.select(
            *cols, "_extra", F.explode(F.sequence(F.lit(0), F.floor((F.col("_extra") - 1) / COPY_CHUNK))).alias("_chunk")
        )
        .repartition(*[F.col(c) for c in keys], F.col("_chunk"))
        .select(
            *cols,
            F.explode(
                F.sequence(F.lit(1), F.least(F.lit(COPY_CHUNK), F.col("_extra") - F.col("_chunk") * COPY_CHUNK))
            ).alias("_copy"),
        )
        .drop("_copy")
    )


COPY_CHUNK = 1_000_000


def unreferenced(payments: DataFrame, invoices: DataFrame, pay_key: str, inv_key: str) -> DataFrame:
    """Payments whose reference has no invoice (left anti join)."""
    refs = invoices.select(F.col(inv_key).alias(pay_key)).distinct()
    return payments.join(refs, pay_key, "left_anti")
