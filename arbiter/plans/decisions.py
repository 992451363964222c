"""Decision queries: rules (D1–D4, J5), label resolution (D5, D6, A11) and
the headline metrics family (A2–A4) over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbiter.functions.labels import resolve_label, resolve_label_per_label
from arbiter.operators import metrics as M
from arbiter.operators.rules import classify, conclude_logic, conclude_categorical, option_for, conclude
from arbiter.plans import oracle_fixtures as O
from arbiter.plans.registry import query
from arbiter.session import Tables
from arbiter.sources import fixtures as X

# ---- shared builders ------------------------------------------------------------


def classified_tickets(spark, sf_dir):
    return classify(X.ticket_set(Tables(spark, sf_dir).orders))


def resolved_outputs(spark, sf_dir):
    t = Tables(spark, sf_dir)
    raw = X.raw_outputs(t.orders, t.conversations)
    return raw.select(
        "source", "rec_id", resolve_label(F.col("raw"), F.col("allowed")).alias("r")
    ).select("source", "rec_id", "r.label", "r.status", "r.raw")


def scored_outputs(spark, sf_dir):
    """Finance answers with the label resolved from the model-like output of the
    same record: expectation and prediction come from one row, so no join."""
    fin = X.finance_set(Tables(spark, sf_dir).orders)
    raw = X.wrapped_answer(F.col("rec_id"), F.col("answer"))
    allowed = F.transform("options", lambda o: o["label"])
    return fin.select("rec_id", F.col("answer").alias("expected"), resolve_label(raw, allowed)["label"].alias("label"))


# ---- oracle pieces ----------------------------------------------------------------

RECON_SQL = """CASE WHEN f_missing_ref THEN 'needs_review'
  WHEN f_duplicate THEN CASE WHEN f_dup_vocab THEN 'duplicate' ELSE 'mismatch' END
  WHEN f_cur_a IS DISTINCT FROM f_cur_b THEN 'mismatch'
  WHEN f_a IS NOT DISTINCT FROM f_b THEN CASE WHEN f_dup_vocab THEN 'unique' ELSE 'match' END
  WHEN f_tolerance IS NOT NULL AND abs(f_a - f_b) <= f_tolerance THEN 'match'
  ELSE 'mismatch' END"""


def _tickets_decided_sql() -> str:
    return f"""WITH t AS ({O.ticket_set()}),
    c AS (SELECT *, {RECON_SQL} AS conclusion FROM t),
    o AS (SELECT *, list_filter(options, lambda x: x.key = conclusion)[1] AS opt FROM c)
    SELECT id, expected, conclusion, opt.label AS opt_label, opt.key AS opt_key,
      CASE WHEN opt IS NULL THEN NULL ELSE upper(opt.label) END AS label,
      CASE WHEN opt IS NULL THEN 'invalid_output' ELSE 'ok' END AS status,
      category, tag, variant, adversarial, rec_id
    FROM o"""


def _ws_norm(x: str) -> str:
    return f"upper({O.strip(f'coalesce({x}, {chr(39)}{chr(39)})')})"


def _resolve_sql(source: str, labels: list[str], frm: str) -> str:
    """Oracle D5 for a constant allowed set: one constant pattern per label."""
    norm = _ws_norm("raw")
    hits = [
        f"CASE WHEN regexp_matches(n, '(^|[^\\p{{L}}\\p{{N}}_]){lab}([^\\p{{L}}\\p{{N}}_]|$)') THEN 1 ELSE 0 END"
        for lab in labels
    ]
    one = " ".join(
        f"WHEN h{i} = 1 THEN '{lab}'" for i, lab in enumerate(labels)
    )
    inlist = ", ".join(f"'{lab}'" for lab in labels)
    cols = ", ".join(f"{h} AS h{i}" for i, h in enumerate(hits))
    return f"""SELECT '{source}' AS source, rec_id, coalesce(raw, '') AS raw,
        CASE WHEN n IN ({inlist}) THEN n WHEN {' + '.join(f'h{i}' for i in range(len(labels)))} = 1
             THEN CASE {one} END END AS label,
        CASE WHEN n IN ({inlist}) THEN 'ok' WHEN {' + '.join(f'h{i}' for i in range(len(labels)))} = 1
             THEN 'extracted' ELSE 'invalid_output' END AS status
      FROM (SELECT *, {cols} FROM (SELECT *, {norm} AS n FROM ({frm})))"""


def _resolved_sql() -> str:
    raw = O.raw_outputs()
    parts = [
        _resolve_sql("priority", ["URGENT", "HIGH", "LOW"], f"SELECT * FROM ({raw}) WHERE source = 'priority'"),
        _resolve_sql("assistant", ["A", "THE", "LA"], f"SELECT * FROM ({raw}) WHERE source = 'assistant'"),
        _resolve_sql("finance", ["A", "B", "C"], f"SELECT * FROM ({raw}) WHERE source = 'finance'"),
    ]
    return " UNION ALL ".join(f"({p})" for p in parts)


def _scored_sql() -> str:
    return f"""SELECT f.rec_id, f.answer AS expected, r.label AS label
      FROM ({O.finance_set()}) f JOIN ({_resolved_sql()}) r ON r.source = 'finance' AND r.rec_id = f.rec_id"""


# ---- D4 / D1 / J5 ---------------------------------------------------------------


@query("d4_classify_tickets", sql=lambda: f"SELECT id, expected, conclusion, label, status FROM ({_tickets_decided_sql()})")
def d4_classify_tickets(spark, sf_dir):
    """D4 (with D1 and J5 inside): decide every ticket from its facts."""
    return classified_tickets(spark, sf_dir).select("id", "expected", "conclusion", "label", "status")


@query(
    "d1_conclude_recon",
    sql=lambda: f"SELECT conclusion, count(*) AS n FROM ({_tickets_decided_sql()}) GROUP BY conclusion",
)
def d1_conclude_recon(spark, sf_dir):
    """Reconciliation conclusions over all tickets."""
    t = X.ticket_set(Tables(spark, sf_dir).orders)
    return t.groupBy(conclude(F.col("facts")).alias("conclusion")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "j5_resolve_option",
    sql=lambda: f"SELECT id, conclusion, opt_label, opt_key FROM ({_tickets_decided_sql()})",
)
def j5_resolve_option(spark, sf_dir):
    """First option whose key equals the conclusion."""
    t = X.ticket_set(Tables(spark, sf_dir).orders)
    c = t.withColumn("conclusion", conclude(F.col("facts")))
    o = option_for(F.col("options"), F.col("conclusion"))
    return c.select("id", "conclusion", o["label"].alias("opt_label"), o["key"].alias("opt_key"))


@query(
    "d2_conclude_logic",
    sql="""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'needs_review'
        WHEN o_totalprice >= 150000 THEN 'yes' ELSE 'no' END AS conclusion FROM orders""",
)
def d2_conclude_logic(spark, sf_dir):
    """Approval threshold (≥) on order totals; pending orders are unknown."""
    o = Tables(spark, sf_dir).orders
    f = X.facts(
        kind=F.lit("logic"),
        value=F.col("o_totalprice"),
        threshold=F.lit(150000.0),
        unknown=F.col("o_orderstatus") == "P",
    )
    return o.select("o_orderkey", conclude_logic(f).alias("conclusion"))


@query(
    "d3_conclude_categorical",
    sql="""SELECT event_id, CASE
        WHEN event_type IN ('purchase', 'signup') THEN 'positive'
        WHEN event_type = 'error' THEN 'negative'
        WHEN event_type = 'view' THEN 'neutral' END AS sentiment_conclusion,
      CASE WHEN event_type = 'click' THEN 'needs_review'
        WHEN event_type = 'error' THEN 'false' ELSE 'true' END AS factual_conclusion
      FROM events""",
)
def d3_conclude_categorical(spark, sf_dir):
    """D3: sentiment pass-through and factual with unknown, from event types."""
    e = Tables(spark, sf_dir).events
    et = F.col("event_type")
    sent = (
        F.when(et.isin("purchase", "signup"), "positive")
        .when(et == "error", "negative")
        .when(et == "view", "neutral")
    )
    sf = X.facts(kind=F.lit("sentiment"), sentiment=sent)
    ff = X.facts(
        kind=F.lit("factual"),
        truth=F.when(et == "error", "false").otherwise("true"),
        unknown=et == "click",
    )
    return e.select(
        "event_id",
        conclude_categorical(sf).alias("sentiment_conclusion"),
        conclude_categorical(ff).alias("factual_conclusion"),
    )


# ---- metrics over decisions -----------------------------------------------------


def _headline_sql(src: str) -> str:
    return f"""SELECT count(*) AS n,
        coalesce(sum(CASE WHEN label IS NOT NULL AND label = expected THEN 1 ELSE 0 END), 0) AS correct,
        coalesce(sum(CASE WHEN label IS NOT NULL AND label = expected THEN 1 ELSE 0 END) / nullif(count(*), 0), 0.0) AS accuracy,
        coalesce(sum(CASE WHEN label IS NULL THEN 1 ELSE 0 END), 0) AS invalid_count,
        coalesce(sum(CASE WHEN label IS NULL THEN 1 ELSE 0 END) / nullif(count(*), 0), 0.0) AS invalid_rate
      FROM ({src})"""


def _per_class_sql(src: str) -> str:
    return f"""SELECT expected, count(*) AS n,
        sum(CASE WHEN label = expected THEN 1 ELSE 0 END) AS correct,
        sum(CASE WHEN label = expected THEN 1 ELSE 0 END) / count(*) AS accuracy
      FROM ({src}) WHERE expected IS NOT NULL GROUP BY expected"""


@query("a2_headline_rules", sql=lambda: _headline_sql(_tickets_decided_sql()))
def a2_headline_rules(spark, sf_dir):
    """A2 over the rule engine's decisions on all tickets."""
    return M.headline(M.cells(classified_tickets(spark, sf_dir)))


@query("a3_per_class_rules", sql=lambda: _per_class_sql(_tickets_decided_sql()))
def a3_per_class_rules(spark, sf_dir):
    """A3 over the rule engine (the flagship query)."""
    return M.per_class(M.cells(classified_tickets(spark, sf_dir)))


@query("a2_headline_outputs", sql=lambda: _headline_sql(_scored_sql()))
def a2_headline_outputs(spark, sf_dir):
    """A2 over labels resolved from wrapped raw outputs."""
    return M.headline(M.cells(scored_outputs(spark, sf_dir)))


@query("a3_per_class_outputs", sql=lambda: _per_class_sql(_scored_sql()))
def a3_per_class_outputs(spark, sf_dir):
    """A3 over resolved outputs."""
    return M.per_class(M.cells(scored_outputs(spark, sf_dir)))


@query(
    "a4_confusion",
    sql=lambda: f"""SELECT expected, coalesce(label, '<invalid>') AS predicted, count(*) AS n
      FROM ({_scored_sql()}) WHERE expected IS NOT NULL GROUP BY 1, 2""",
)
def a4_confusion(spark, sf_dir):
    """A4 long form."""
    return M.confusion(M.cells(scored_outputs(spark, sf_dir)))


@query(
    "a4_confusion_wide",
    sql=lambda: f"""SELECT expected,
        count(*) FILTER (WHERE label = 'A') AS "A", count(*) FILTER (WHERE label = 'B') AS "B",
        count(*) FILTER (WHERE label = 'C') AS "C", count(*) FILTER (WHERE label IS NULL) AS "<invalid>",
        count(*) FILTER (WHERE label NOT IN ('A', 'B', 'C')) AS "<other>"
      FROM ({_scored_sql()}) WHERE expected IS NOT NULL GROUP BY 1""",
)
def a4_confusion_wide(spark, sf_dir):
    """A4 wide form (pivot with the option labels given, so no extra pass)."""
    return M.confusion_wide(M.cells(scored_outputs(spark, sf_dir)), ["A", "B", "C"])


# ---- label resolution -----------------------------------------------------------


@query("d5_resolve_labels", sql=_resolved_sql)
def d5_resolve_labels(spark, sf_dir):
    """D5 over priorities, assistant turns and wrapped finance answers."""
    return resolved_outputs(spark, sf_dir)


def _per_label_sql() -> str:
    raw = O.raw_outputs()
    out = []
    for src, labels in (("priority", ["URGENT", "HIGH", "LOW"]), ("assistant", ["A", "THE", "LA"]), ("finance", ["A", "B", "C"])):
        hits = " + ".join(
            f"(CASE WHEN regexp_matches(n, '(^|[^A-Za-z0-9_]){lab}([^A-Za-z0-9_]|$)') THEN 1 ELSE 0 END)" for lab in labels
        )
        one = " ".join(
            f"WHEN regexp_matches(n, '(^|[^A-Za-z0-9_]){lab}([^A-Za-z0-9_]|$)') THEN '{lab}'" for lab in labels
        )
        inl = ", ".join(f"'{lab}'" for lab in labels)
        out.append(
            f"""SELECT source, rec_id, coalesce(raw, '') AS raw,
              CASE WHEN n IN ({inl}) THEN n WHEN {hits} = 1 THEN CASE {one} END END AS label,
              CASE WHEN n IN ({inl}) THEN 'ok' WHEN {hits} = 1 THEN 'extracted' ELSE 'invalid_output' END AS status
            FROM (SELECT *, {_ws_norm('raw')} AS n FROM ({raw}) WHERE source = '{src}')"""
        )
    return " UNION ALL ".join(f"({p})" for p in out)


@query("d6_resolve_per_label", sql=_per_label_sql)
def d6_resolve_per_label(spark, sf_dir):
    """The per-label dialect (labels as given, ASCII word boundary)."""
    t = Tables(spark, sf_dir)
    raw = X.raw_outputs(t.orders, t.conversations)
    return raw.select(
        "source", "rec_id", resolve_label_per_label(F.col("raw"), F.col("allowed")).alias("r")
    ).select("source", "rec_id", "r.label", "r.status", "r.raw")


@query(
    "a11_status_counts",
    sql=lambda: f"SELECT source, status, count(*) AS n FROM ({_resolved_sql()}) GROUP BY 1, 2",
)
def a11_status_counts(spark, sf_dir):
    """Ok / extracted / invalid_output per output family."""
    return resolved_outputs(spark, sf_dir).groupBy("source", "status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "d5_found_counts",
    sql=lambda: f"""SELECT n_found, count(*) AS n FROM (
        SELECT (CASE WHEN regexp_matches(n, '(^|[^\\p{{L}}\\p{{N}}_])A([^\\p{{L}}\\p{{N}}_]|$)') THEN 1 ELSE 0 END)
             + (CASE WHEN regexp_matches(n, '(^|[^\\p{{L}}\\p{{N}}_])THE([^\\p{{L}}\\p{{N}}_]|$)') THEN 1 ELSE 0 END)
             + (CASE WHEN regexp_matches(n, '(^|[^\\p{{L}}\\p{{N}}_])LA([^\\p{{L}}\\p{{N}}_]|$)') THEN 1 ELSE 0 END) AS n_found
        FROM (SELECT {_ws_norm('text')} AS n FROM conversations WHERE role = 'assistant'))
      GROUP BY 1""",
)
def d5_found_counts(spark, sf_dir):
    """D5 detail: how many distinct allowed labels occur per assistant turn."""
    from arbiter.functions.labels import label_pattern
    from arbiter.functions.text import norm_label

    c = Tables(spark, sf_dir).conversations.where(F.col("role") == "assistant")
    allowed = F.array(F.lit("A"), F.lit("THE"), F.lit("LA"))
    found = F.array_distinct(F.regexp_extract_all(norm_label("text"), label_pattern(allowed), F.lit(1)))
    return c.groupBy(F.size(found).alias("n_found")).agg(F.count(F.lit(1)).alias("n"))
