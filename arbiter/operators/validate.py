"""Record validation (F1, F2, F3, F6) on raw JSON record bodies.

Bodies are parsed to VARIANT so the rules can tell an absent key from a JSON
null and a string from a number, as the rules require. One row in, an array
of violations out, then ``explode``: a single projection, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbiter.functions.json import parse_json
from arbiter.functions.text import py_strip

FIELDS = ["state", "question", "options", "answer"]
VIOLATION = "struct<rule:string,detail:string>"


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _type(x: Column) -> Column:
    return F.schema_of_variant(x)


def _v(rule: str, detail) -> Column:
    d = detail if isinstance(detail, Column) else F.lit(detail)
    return F.struct(F.lit(rule).alias("rule"), d.cast("string").alias("detail"))


def _blank_or_not_string(x: Column) -> Column:
    # absent ⇒ "" ⇒ blank; JSON null or non-string ⇒ not a string
    s = F.try_variant_get(x, "$", "string")
    return x.isNull() | (_type(x) != "STRING") | (py_strip(s) == "")


def parse_records(df: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``v`` (VARIANT, null when the body is not valid JSON)."""
    return df.withColumn("v", parse_json(F.col(body)))


def violations_expr(v: Column) -> Column:
    """Array of (rule, detail) for one parsed record, in the rule order."""
    state, question, options, answer = (_field(v, f) for f in FIELDS)
    r1 = [F.when(_field(v, f).isNull(), _v("missing_field", f)) for f in FIELDS]
    r2 = F.when(_blank_or_not_string(state), _v("empty_field", "state"))
    r3 = F.when(_blank_or_not_string(question), _v("empty_field", "question"))
    opts = F.try_variant_get(v, "$.options", "array<variant>")
    bad_opts = options.isNull() | opts.isNull() | (F.size(opts) < 2)
    r4 = F.when(bad_opts, _v("bad_options", "options must be a list with >= 2 entries"))

    def complete(o: Column) -> Column:
        return (
            F.try_variant_get(o, "$.label", "variant").isNotNull()
            & F.try_variant_get(o, "$.key", "variant").isNotNull()
            & F.try_variant_get(o, "$.description", "variant").isNotNull()
            & F.startswith(_type(o), F.lit("OBJECT"))
        )

    r5 = F.transform(
        F.coalesce(opts, F.array().cast("array<variant>")),
        lambda o, i: F.when(~complete(o), _v("bad_option", i)),
    )
    seen = F.transform(
        F.filter(F.coalesce(opts, F.array().cast("array<variant>")), complete),
        lambda o: F.upper(F.try_variant_get(o, "$.label", "string")),
    )
    ans = F.upper(
        F.when(answer.isNull(), F.lit(""))
        .when(_type(answer) == "VOID", F.lit("None"))
        .otherwise(F.try_variant_get(answer, "$", "string"))
    )
    r6 = F.when(~F.array_contains(seen, ans), _v("answer_not_in_labels", ans))
    before = F.array(*r1, r2, r3, r4)
    after = F.concat(r5, F.array(r6))
    allv = F.when(bad_opts, before).otherwise(F.concat(before, after))
    return F.when(v.isNull(), F.array(_v("invalid_json", ""))).otherwise(F.array_compact(allv))


def validate(records: DataFrame, key: str = "rec_id", extra: list[str] | None = None) -> DataFrame:
    """one row per violation: (key, *extra, rule, detail)."""
    extra = extra or []
    return records.select(
        key, *extra, F.explode(violations_expr(F.col("v"))).alias("x")
    ).select(key, *extra, "x.rule", "x.detail")


def violation_totals(violations: DataFrame, by: str = "split") -> DataFrame:
    """violations per split; a split with any count fails the gate."""
    return violations.groupBy(by).agg(F.count(F.lit(1)).alias("n_violations"))


def assert_valid(totals: DataFrame, by: str = "split") -> None:
    """F2 gate (an action): raise listing each failing split and its count."""
    bad = totals.where(F.col("n_violations") > 0).collect()
    if bad:
        detail = ", ".join(f"{r[by]}: {r['n_violations']} error(s)" for r in bad)
        raise ValueError(f"Validation failed for {detail}")


def parsed_label_distribution(records: DataFrame) -> DataFrame:
    """A1 on raw bodies: upper(str(answer)) per split; records failing R4 skipped."""
    v = F.col("v")
    opts = F.try_variant_get(v, "$.options", "array<variant>")
    answer = _field(v, "answer")
    ans = F.upper(
        F.when(answer.isNull(), F.lit(""))
        .when(_type(answer) == "VOID", F.lit("None"))
        .otherwise(F.try_variant_get(answer, "$", "string"))
    )
    ok = v.isNotNull() & opts.isNotNull() & (F.size(opts) >= 2)
    return records.where(ok).groupBy("split", ans.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def check_tickets(tickets: DataFrame, required_categories: list[str]) -> DataFrame:
    """ticket contract as one row of counts (all zero / true ⇒ valid)."""
    labels = F.transform("options", lambda o: o["label"])
    # Only required categories are gathered: the set stays as small as the list asked for.
    cats = F.collect_set(F.when(F.col("category").isin(required_categories), F.col("category")))

    def fault(holds: Column) -> Column:
        """Rows where the rule does not hold; a null field breaks it, an empty table has none."""
        return F.coalesce(F.sum((~F.coalesce(holds, F.lit(False))).cast("int")), F.lit(0))

    return tickets.agg(
        F.count(F.lit(1)).alias("n"),
        (F.count(F.lit(1)) - F.count_distinct("id")).alias("duplicate_ids"),
        (F.count(F.lit(1)) - F.count_distinct(F.sha2("state", 256))).alias("duplicate_states"),
        fault(py_strip("state") != "").alias("blank_states"),
        fault(py_strip("question") != "").alias("blank_questions"),
        fault(F.size("options") >= 2).alias("few_options"),
        fault(F.array_contains(labels, F.col("expected"))).alias("expected_not_in_labels"),
        fault(F.size(F.array_distinct(labels)) == F.size(labels)).alias("duplicate_labels"),
        F.size(F.array_except(F.array(*[F.lit(c) for c in required_categories]), cats)).alias(
            "missing_categories"
        ),
    )


def reject_blank(df: DataFrame, cols: list[str]) -> DataFrame:
    """adds ``reason`` — the first column that is null or blank after strip."""
    reason = None
    for c in cols:
        cond = F.col(c).isNull() | (py_strip(c) == "")
        reason = F.when(cond, F.lit(f"blank {c}")) if reason is None else reason.when(cond, F.lit(f"blank {c}"))
    return df.withColumn("reason", reason)
