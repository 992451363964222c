"""Generators on Spark: perturbations (G5), option permutation with answer remap (G6). The split
composer (G4) is in ``selection.py``.

Perturbations multiply each record by a fixed, small probe list with
``explode`` of a literal array (a projection), not a join: output grows
exactly ×probes and never pairs records with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbiter.operators.rules import option_for
from arbiter.sources import catalogue as C
from arbiter.sources.fixtures import case_on

CONFLICT_SUFFIX = " Amount matches but currency differs (EUR vs USD)."
MISSING_SUFFIX = " There is no invoice reference."
UNKNOWN_REF = "an unlabelled document"


def rotate_options(options: Column, shift: int = 1) -> Column:
    """Labels stay in place, keys/descriptions move by ``shift`` positions."""
    n = F.size(options)
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(
            F.get(options, i)["label"].alias("label"),
            F.get(options, F.pmod(i + shift, n))["key"].alias("key"),
            F.get(options, F.pmod(i + shift, n))["description"].alias("description"),
        ),
    )


def remap_answer(old_options: Column, new_options: Column, answer: Column) -> Column:
    """The label that holds the old answer's key in the new option order."""
    key = F.get(old_options, F.array_position(old_options["label"], answer).cast("int") - 1)["key"]
    return option_for(new_options, key)["label"]


def permute_options(df: DataFrame, shift: int = 1) -> DataFrame:
    new = rotate_options(F.col("options"), shift)
    return df.withColumn("answer", remap_answer(F.col("options"), new, F.col("answer"))).withColumn(
        "options", new
    )


def perturb(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each record × the six probes → (rec_id, probe, state, options, expected, *keep).

    ``expected`` follows the first-hit rules on the perturbed evidence:
    injection / filler probes keep the answer; a currency conflict gives
    mismatch unless a missing reference or a duplicate decides first;
    dropping the reference gives needs_review; reordering remaps the answer.
    """
    st, opts, ans, kind = F.col("state"), F.col("options"), F.col("answer"), F.col("kind")
    filler = F.repeat(F.lit(C.FILLER), C.FILLER_REPEAT)
    conflict_key = F.when(kind.isin(7, 9), "needs_review").when(kind == 2, "duplicate").otherwise("mismatch")
    # Answers and rotated options are made once a record; a probe's text is made in the row that the explode
    # of the names gives it, in compiled code, and no array of all six texts is built.
    once = records.withColumn("_rotated", rotate_options(opts)).select(
        "rec_id", "kind", "state", "options", "_rotated", *keep,
        ans.alias("_answer"),
        option_for(opts, conflict_key)["label"].alias("_conflict"),
        option_for(opts, F.lit("needs_review"))["label"].alias("_review"),
        remap_answer(opts, F.col("_rotated"), ans).alias("_remapped"),
    )
    states = {
        "prompt_injection": F.concat(st, F.lit(C.INJECTION_SUFFIX)),
        "irrelevant_info": F.concat(st, filler),
        "conflicting_evidence": F.concat(st, F.lit(CONFLICT_SUFFIX)),
        "missing_info": F.concat(F.regexp_replace(st, r"(?:INV|PO|PAY)-\d+", UNKNOWN_REF), F.lit(MISSING_SUFFIX)),
        "option_ordering": st,
        "long_state_evidence_at_end": F.concat(filler, F.lit(" "), st),
    }
    expected = {
        "conflicting_evidence": F.col("_conflict"),
        "missing_info": F.col("_review"),
        "option_ordering": F.col("_remapped"),
    }
    probe = F.col("probe")
    names = F.explode(F.array(*[F.lit(name) for name in states]))
    return once.withColumn("probe", names).select(
        "rec_id",
        "kind",
        "probe",
        case_on(probe, states).alias("state"),
        case_on(probe, {"option_ordering": F.col("_rotated")}, opts).alias("options"),
        case_on(probe, expected, F.col("_answer")).alias("expected"),
        *keep,
    )
