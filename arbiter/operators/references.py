"""Typed references in STATE texts (D7): which invoice, order and payment a text speaks of, and where.

A reference is a kind (INV, PO, PAY), a hyphen and digits, standing as a word of its own. All of a
text's references are listed with their positions; the first of a kind has that kind's role. Column
expressions only: one projection, no shuffle.

Defined results: null text has a null list and null roles; a text without references an empty list
and null roles; letters are read in any case and written in upper case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# FIXED VALUES: reference kinds and the columns of their roles.
ROLES = {"INV": "invoice_ref", "PO": "po_ref", "PAY": "payment_ref"}
REFERENCE = r"(?i)(?<![\w-])(?:INV|PO|PAY)-\d+(?![\w-])"


def references(text: Column) -> Column:
    """array<struct<kind, number, ref, pos>> in text order; ``pos``: 0-based character of its first letter."""
    found = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
    # Characters before the i-th reference: those of the first i + 1 gaps and the first i references.
    gaps = F.split(text, REFERENCE, -1)
    length = lambda parts: F.aggregate(parts, F.lit(0), lambda n, p: n + F.char_length(p))

    def one(ref: Column, i: Column) -> Column:
        pos = length(F.slice(gaps, 1, i + 1)) + length(F.slice(found, 1, i))
        return F.struct(
            F.upper(F.substring_index(ref, "-", 1)).alias("kind"),
            F.substring_index(ref, "-", -1).alias("number"),
            F.upper(ref).alias("ref"),
            pos.alias("pos"),
        )

    return F.transform(found, one)


def role_refs(refs: Column) -> list[Column]:
    """invoice_ref, po_ref and payment_ref of a list of references."""

    def first(kind: str) -> Column:
        return F.get(F.filter(refs, lambda r: r["kind"] == kind), 0)["ref"]

    return [first(kind).alias(column) for kind, column in ROLES.items()]


def with_references(df: DataFrame, text: str = "state") -> DataFrame:
    """``df`` with refs, invoice_ref, po_ref and payment_ref."""
    rows = df.withColumn("refs", references(F.col(text)))
    return rows.select("*", *role_refs(F.col("refs")))
