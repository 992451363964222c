"""Label resolution (D5, D6) and allowed-label sets (P4) as Catalyst expressions.

The regex for a row is built from its allowed labels; Spark keeps the last
compiled pattern per task, so sorting or clustering rows by option set makes
the compile cost per set rather than per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arbiter.functions.text import col_, norm_label

RESOLUTION_TYPE = "struct<label:string,status:string,raw:string>"
PLAIN_LABEL = r"\A[A-Z0-9]+\z"

# Exact ASCII word boundary (JavaScript's \b), for the per-label dialect.
_W = "[A-Za-z0-9_]"
_ASCII_B = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"


def allowed_labels(options: Column | str) -> Column:
    """upper(strip(label)) of every option, in option order."""
    return F.transform(col_(options), lambda o: norm_label(o["label"]))


def _quote(c: Column) -> Column:
    """Regex-quote a string with \\Q..\\E (an embedded \\E is split out)."""
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def label_pattern(allowed_norm: Column) -> Column:
    """(?U)\\b(L1|L2|...)\\b with every label quoted, alternation in label order."""
    return F.concat(
        F.lit("(?U)\\b("),
        F.array_join(F.transform(allowed_norm, _quote), "|"),
        F.lit(")\\b"),
    )


def resolve_label(raw: Column | str, allowed: Column | str) -> Column:
    """One allowed label, or abstain.

    ok: upper(strip(raw)) is itself an allowed label. extracted: exactly one
    distinct allowed label occurs standalone (Unicode word boundaries,
    left-to-right, non-overlapping). invalid_output otherwise, or when there
    are no allowed labels. raw is kept, null becomes ''.
    """
    raw = col_(raw)
    allowed_n = F.transform(F.coalesce(col_(allowed), F.array().cast("array<string>")), norm_label)
    # Such a label is its own normal form: if it is allowed as it stands, no normal form is made of the others.
    plain = F.regexp(raw, F.lit(PLAIN_LABEL)) & F.array_contains(col_(allowed), raw)
    exact = F.struct(raw.alias("label"), F.lit("ok").alias("status"), raw.alias("raw"))

    def found(norm: Column, allowed_n: Column) -> Column:
        return F.array_distinct(F.regexp_extract_all(norm, label_pattern(allowed_n), F.lit(1)))

    return F.when(plain, exact).otherwise(_resolved(raw, norm_label(raw), allowed_n, found))


def _may_occur(norm: Column, label: Column) -> Column:
    """False only where no pattern made of ``label`` can match: plain text that ``norm`` does not contain.

    Cheaper than compiling a pattern for it. Labels with other characters may be patterns themselves (D6).
    """
    return ~label.rlike("^[A-Za-z0-9_ -]+$") | F.contains(norm, label)


def _resolved(raw: Column, norm: Column, allowed: Column, found) -> Column:
    """The resolution struct; ``found(norm, allowed)`` is searched once, and only where a label may occur and there is no exact hit."""
    bound = F.array(F.struct(norm.alias("norm"), allowed.alias("allowed")))

    def search(d: Column) -> Column:
        exact = F.coalesce(F.array_contains(d["allowed"], d["norm"]), F.lit(False))
        hits = F.when(~exact & F.exists(d["allowed"], lambda a: _may_occur(d["norm"], a)), found(d["norm"], d["allowed"]))
        return F.struct(d["norm"].alias("norm"), exact.alias("exact"), hits.alias("hits"))

    def resolve(d: Column) -> Column:
        one = F.size(d["hits"]) == 1
        label = F.when(d["exact"], d["norm"]).when(one, F.get(d["hits"], 0))
        status = F.when(d["exact"], "ok").when(one, "extracted").otherwise("invalid_output")
        return F.struct(
            label.cast("string").alias("label"), status.alias("status"), F.coalesce(raw, F.lit("")).alias("raw")
        )

    # One-element arrays bind what is used several times.
    return F.transform(F.transform(bound, search), resolve)[0]


def resolve_label_per_label(raw: Column | str, allowed: Column | str) -> Column:
    """Each label tested on its own, unescaped, labels not normalised.

    JavaScript-style: trim, upper, exact test against the raw labels, then
    the labels whose ``\\b<label>\\b`` (ASCII boundary) occurs; exactly one
    distinct hit is extracted.
    """
    raw = col_(raw)
    allowed = F.coalesce(col_(allowed), F.array().cast("array<string>"))
    norm = F.upper(F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)^\s+|\s+$", ""))

    def found(norm: Column, allowed: Column) -> Column:
        pattern = lambda a: F.concat(F.lit(_ASCII_B), a, F.lit(_ASCII_B))
        hit = lambda a: F.when(_may_occur(norm, a), F.regexp(norm, pattern(a))).otherwise(F.lit(False))
        return F.array_distinct(F.filter(allowed, hit))

    return _resolved(raw, norm, allowed, found)
