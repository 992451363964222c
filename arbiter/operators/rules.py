"""Decision rules over structured evidence (D1–D4) and option lookup.

All of it is one projection: no shuffle, no Python. STATE is never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbiter.functions.labels import resolve_label
from arbiter.sources.catalogue import ABSTAIN_TEXT


def conclude_recon(f: Column) -> Column:
    """D1, first hit wins; tolerance is inclusive."""
    return (
        F.when(F.coalesce(f["missingRef"], F.lit(False)), "needs_review")
        .when(
            F.coalesce(f["duplicate"], F.lit(False)),
            F.when(F.coalesce(f["dupVocab"], F.lit(False)), "duplicate").otherwise("mismatch"),
        )
        .when(~F.equal_null(f["curA"], f["curB"]), "mismatch")
        .when(
            F.equal_null(f["a"], f["b"]),
            F.when(F.coalesce(f["dupVocab"], F.lit(False)), "unique").otherwise("match"),
        )
        .when(
            f["tolerance"].isNotNull() & (F.abs(f["a"] - f["b"]) <= f["tolerance"]), "match"
        )
        .otherwise("mismatch")
    )


def conclude_logic(f: Column) -> Column:
    """Unknown or missing value/threshold ⇒ needs_review; value ≥ threshold ⇒ yes."""
    return (
        F.when(
            F.coalesce(f["unknown"], F.lit(False)) | f["value"].isNull() | f["threshold"].isNull(),
            "needs_review",
        )
        .when(f["value"] >= f["threshold"], "yes")
        .otherwise("no")
    )


def conclude_categorical(f: Column) -> Column:
    """D3: sentiment / intent / routing pass through; factual with unknown ⇒ needs_review."""
    return (
        F.when(f["kind"] == "sentiment", f["sentiment"])
        .when(f["kind"] == "intent", f["intent"])
        .when(f["kind"] == "routing", f["queue"])
        .when(
            f["kind"] == "factual",
            F.when(
                F.coalesce(f["unknown"], F.lit(False)) | f["truth"].isNull(), "needs_review"
            ).otherwise(f["truth"]),
        )
    )


def conclude(f: Column) -> Column:
    return (
        F.when(f["kind"] == "recon", conclude_recon(f))
        .when(f["kind"] == "logic", conclude_logic(f))
        .otherwise(conclude_categorical(f))
    )


def option_for(options: Column, conclusion: Column) -> Column:
    """First option whose key equals the conclusion (null if none).

    ``array_position`` rather than a ``filter`` lambda: same option, but compiled code.
    """
    return F.get(options, F.array_position(options["key"], conclusion).cast("int") - 1)


def classify(tickets: DataFrame, facts: str = "facts", options: str = "options") -> DataFrame:
    """Facts → conclusion → option → label resolution; adds conclusion, label, status."""
    f = F.col(facts)
    opt = option_for(F.col(options), conclude(f))
    raw = F.coalesce(opt["label"], F.lit(ABSTAIN_TEXT))
    allowed = F.transform(F.col(options), lambda o: F.upper(o["label"]))
    res = resolve_label(raw, allowed)
    return tickets.withColumn("conclusion", conclude(f)).withColumn("_res", res).select(
        "*", F.col("_res.label").alias("label"), F.col("_res.status").alias("status")
    ).drop("_res")
