"""Generators (G1–G6), evidence route (D7), run evaluation (A5, A6, A8, A9,
A12, S5), ticket/result joins and filters (J4, F4, F5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbiter.functions.options import format_options
from arbiter.functions.subquery import row_value
from arbiter.operators import generate as G
from arbiter.operators import metrics as M
from arbiter.operators.evidence import decide_from_text
from arbiter.operators.rules import classify
from arbiter.plans import oracle_fixtures as O
from arbiter.plans.decisions import RECON_SQL, _per_class_sql, _scored_sql, _headline_sql, classified_tickets, scored_outputs
from arbiter.plans.records import _fmt_line_sql
from arbiter.plans.registry import query
from arbiter.session import Tables, spread
from arbiter.sources import fixtures as X
from arbiter.sources.catalogue import FILLER, FILLER_REPEAT, INJECTION_SUFFIX

WS = O.WS


def _spread_orders(spark, sf_dir):
    """The order columns that records and tickets are made of, for work that is long for each row."""
    return spread(Tables(spark, sf_dir).orders.select("o_orderkey", "o_totalprice"))


# ---- G1 / G2 / G3 / G4 ----------------------------------------------------------------------


@query(
    "g1_finance_records",
    sql=lambda: f"SELECT rec_id, kind, md5(state) AS state_md5, length(state) AS state_len, question, answer, len(options) AS n_options FROM ({O.finance_set()})",
)
def g1_finance_records(spark, sf_dir):
    """G1: finance records (ten kinds) from orders."""
    f = X.finance_set(Tables(spark, sf_dir).orders)
    return f.select(
        "rec_id", "kind", F.md5("state").alias("state_md5"), F.length("state").alias("state_len"),
        "question", "answer", F.size("options").alias("n_options"),
    )


@query(
    "g2_general_records",
    sql=lambda: f"SELECT rec_id, kind, state, question, answer, len(options) AS n_options FROM ({O.general_set()})",
)
def g2_general_records(spark, sf_dir):
    """General records (sentiment, intent, logic, factual, routing) from customers."""
    g = X.general_set(Tables(spark, sf_dir).customer)
    return g.select("rec_id", "kind", "state", "question", "answer", F.size("options").alias("n_options"))


@query(
    "g2_general_decisions",
    sql=lambda: f"""SELECT rec_id, conclusion, list_filter(options, lambda o: o.key = conclusion)[1].label AS label, answer
      FROM ({O.general_set()})""",
)
def g2_general_decisions(spark, sf_dir):
    """D2/D3/D4 on generated general records: decision from facts vs answer."""
    d = classify(X.general_set(Tables(spark, sf_dir).customer))
    return d.select("rec_id", "conclusion", "label", "answer")


@query(
    "g3_tickets",
    sql=lambda: f"SELECT id, category, tag, variant, adversarial, expected, md5(state) AS state_md5 FROM ({O.ticket_set()})",
)
def g3_tickets(spark, sf_dir):
    """Tickets with evidence, variants and adversarial texts."""
    t = X.ticket_set(Tables(spark, sf_dir).orders)
    return t.select("id", "category", "tag", "variant", "adversarial", "expected", F.md5("state").alias("state_md5"))


# ---- G6 / D7 / G5 / A9 ------------------------------------------------------------------------


def _rotate_sql(opts: str) -> str:
    return f"""list_transform(generate_series(0, len({opts}) - 1), lambda i: struct_pack(
        label := {opts}[i + 1].label, key := {opts}[((i + 1) % len({opts})) + 1].key,
        description := {opts}[((i + 1) % len({opts})) + 1].description))"""


def _remap_sql(old: str, new: str, ans: str) -> str:
    return f"list_filter({new}, lambda o: o.key = list_filter({old}, lambda x: x.label = {ans})[1].key)[1].label"


@query(
    "g6_permute_options",
    sql=lambda: f"""SELECT rec_id, answer, new_answer,
        array_to_string(list_transform(new_opts, lambda o: {_fmt_line_sql('o')}), chr(10)) AS options_block
      FROM (SELECT rec_id, answer, {_rotate_sql('options')} AS new_opts,
              {_remap_sql('options', _rotate_sql('options'), 'answer')} AS new_answer FROM ({O.finance_set()}))""",
)
def g6_permute_options(spark, sf_dir):
    """Options rotated (labels stay), answer remapped to the label now holding its key."""
    f = X.finance_set(Tables(spark, sf_dir).orders).select("rec_id", "options", "answer")
    p = G.permute_options(f.withColumnRenamed("answer", "answer_old").withColumn("answer", F.col("answer_old")))
    return p.select(
        "rec_id", F.col("answer_old").alias("answer"), F.col("answer").alias("new_answer"),
        format_options("options").alias("options_block"),
    )


def _facts_sql(state: str, options: str) -> str:
    """Oracle D7 over columns g1..g6 (the six groups of every amount match)."""
    from arbiter.operators import evidence as EV

    conflict = EV.CONFLICT

    def amt(i):
        return (f"coalesce(nullif(g1[{i}], ''), nullif(g4[{i}], ''), CASE WHEN g5[{i}] = '€' "
                f"THEN replace(replace(g6[{i}], '.', ''), ',', '.') ELSE replace(g6[{i}], ',', '') END)")

    def cur(i):
        return (f"coalesce(nullif(g2[{i}], ''), nullif(g3[{i}], ''), "
                f"CASE g5[{i}] WHEN '€' THEN 'EUR' WHEN '$' THEN 'USD' WHEN '£' THEN 'GBP' END)")

    return f"""CAST({amt(1)} AS DECIMAL(14,2)) AS f_a, CAST({amt(2)} AS DECIMAL(14,2)) AS f_b,
      coalesce(CASE WHEN regexp_matches({state}, '{conflict}') THEN nullif(regexp_extract({state}, '{conflict}', 1), '') END,
               nullif(regexp_extract({state}, '{EV.BILLED_IN}', 1), ''), {cur(1)}) AS f_cur_a,
      coalesce(CASE WHEN regexp_matches({state}, '{conflict}') THEN nullif(regexp_extract({state}, '{conflict}', 2), '') END,
               nullif(regexp_extract({state}, '{EV.IS_IN}', 1), ''), {cur(2)}) AS f_cur_b,
      CAST(nullif(regexp_extract({state}, '{EV.TOLERANCE}', 1), '') AS DECIMAL(14,2)) AS f_tolerance,
      regexp_matches({state}, '{EV.MISSING}') AS f_missing_ref,
      regexp_matches({state}, '{EV.DUPLICATE}') AS f_duplicate,
      list_contains(list_transform({options}, lambda o: o.key), 'duplicate') AS f_dup_vocab"""


def _text_decided_sql(src: str) -> str:
    from arbiter.operators.evidence import AMOUNT

    groups = ", ".join(f"regexp_extract_all(state, '{AMOUNT}', {i}) AS g{i}" for i in range(1, 7))
    return f"""SELECT *, list_filter(options, lambda o: o.key = conclusion)[1].label AS label FROM (
        SELECT *, {RECON_SQL} AS conclusion FROM (
          SELECT *, {_facts_sql('state', 'options')} FROM (SELECT *, {groups} FROM ({src}))))"""


@query(
    "d7_ticket_text",
    sql=lambda: f"""SELECT id, variant, f_a AS a, f_b AS b, f_cur_a AS cur_a, f_cur_b AS cur_b, conclusion, label, expected
      FROM ({_text_decided_sql(O.ticket_set().replace(" f_a,", " f_a0,").replace(" f_b,", " f_b0,").replace(" f_cur_a,", " f_cur_a0,").replace(" f_cur_b,", " f_cur_b0,").replace(" f_tolerance,", " f_tolerance0,").replace(" f_missing_ref,", " f_missing_ref0,").replace(" f_duplicate,", " f_duplicate0,").replace(" f_dup_vocab", " f_dup_vocab0"))})""",
)
def d7_ticket_text(spark, sf_dir):
    """D7 on ticket texts (paraphrases, German and symbol amounts, review reasons):
    the label read from text against the expected label."""
    t = decide_from_text(X.ticket_set(_spread_orders(spark, sf_dir)).drop("facts"))
    return t.select(
        "id", "variant", F.col("facts.a").alias("a"), F.col("facts.b").alias("b"),
        F.col("facts.curA").alias("cur_a"), F.col("facts.curB").alias("cur_b"), "conclusion", "label", "expected",
    )


@query(
    "d7_extract_facts",
    sql=lambda: f"""SELECT rec_id, f_a AS a, f_b AS b, f_cur_a AS cur_a, f_cur_b AS cur_b, f_tolerance AS tolerance,
        f_duplicate AS duplicate, f_missing_ref AS missing_ref, conclusion, label, answer
      FROM ({_text_decided_sql(O.finance_set())})""",
)
def d7_extract_facts(spark, sf_dir):
    """Facts read from STATE text, decided by the reconciliation rules."""
    f = decide_from_text(X.finance_set(_spread_orders(spark, sf_dir)))
    return f.select(
        "rec_id", F.col("facts.a").alias("a"), F.col("facts.b").alias("b"), F.col("facts.curA").alias("cur_a"),
        F.col("facts.curB").alias("cur_b"), F.col("facts.tolerance").alias("tolerance"),
        F.col("facts.duplicate").alias("duplicate"), F.col("facts.missingRef").alias("missing_ref"),
        "conclusion", "label", "answer",
    )


def _perturb_sql() -> str:
    f = O.finance_set()
    filler = f"repeat({O.sql_str(FILLER)}, {FILLER_REPEAT})"
    conflict_key = "CASE WHEN kind IN (7, 9) THEN 'needs_review' WHEN kind = 2 THEN 'duplicate' ELSE 'mismatch' END"
    rot = _rotate_sql("options")
    return f"""SELECT rec_id, kind, 'prompt_injection' AS probe, state || {O.sql_str(INJECTION_SUFFIX)} AS state, options, answer AS expected FROM ({f})
      UNION ALL SELECT rec_id, kind, 'irrelevant_info', state || {filler}, options, answer FROM ({f})
      UNION ALL SELECT rec_id, kind, 'conflicting_evidence', state || {O.sql_str(G.CONFLICT_SUFFIX)}, options,
        list_filter(options, lambda o: o.key = {conflict_key})[1].label FROM ({f})
      UNION ALL SELECT rec_id, kind, 'missing_info',
        regexp_replace(state, '(?:INV|PO|PAY)-\\d+', {O.sql_str(G.UNKNOWN_REF)}, 'g') || {O.sql_str(G.MISSING_SUFFIX)}, options,
        list_filter(options, lambda o: o.key = 'needs_review')[1].label FROM ({f})
      UNION ALL SELECT rec_id, kind, 'option_ordering', state, {rot}, {_remap_sql('options', rot, 'answer')} FROM ({f})
      UNION ALL SELECT rec_id, kind, 'long_state_evidence_at_end', {filler} || ' ' || state, options, answer FROM ({f})"""


@query(
    "g5_perturb",
    sql=lambda: f"SELECT rec_id, probe, md5(state) AS state_md5, expected FROM ({_perturb_sql()})",
)
def g5_perturb(spark, sf_dir):
    """Every finance record × six robustness probes."""
    p = G.perturb(X.finance_set(Tables(spark, sf_dir).orders))
    return p.select("rec_id", "probe", F.md5("state").alias("state_md5"), "expected")


@query(
    "a9_robustness",
    sql=lambda: f"""WITH base AS (SELECT rec_id, label AS base_label FROM ({_text_decided_sql(O.finance_set())})),
      p AS ({_text_decided_sql(_perturb_sql())})
      SELECT probe, count(*) AS n, sum(CASE WHEN label IS NOT DISTINCT FROM expected THEN 1 ELSE 0 END) AS passed,
        avg(CASE WHEN label IS NOT DISTINCT FROM expected THEN 1.0 ELSE 0.0 END) AS pass_rate,
        sum(CASE WHEN label IS DISTINCT FROM base_label THEN 1 ELSE 0 END) AS label_changed
      FROM p JOIN base ON p.rec_id = base.rec_id GROUP BY probe""",
)
def a9_robustness(spark, sf_dir):
    """Pass rate per probe (label = expected) and how often the label moved."""
    f = X.finance_set(_spread_orders(spark, sf_dir))
    # The unperturbed decision is made first and carried along: no join back.
    base = decide_from_text(f).select(*f.columns, F.col("label").alias("base_label"))
    p = decide_from_text(G.perturb(base, keep=("base_label",)))
    ok = F.equal_null(F.col("label"), F.col("expected"))
    return p.groupBy("probe").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(ok.cast("long")).alias("passed"),
        F.avg(ok.cast("double")).alias("pass_rate"),
        F.sum((~F.equal_null(F.col("label"), F.col("base_label"))).cast("long")).alias("label_changed"),
    )


# ---- results: J4 / F4 / F5 / A5 / A6 / S5 --------------------------------------------------------


def results(spark, sf_dir):
    """Run results: every ticket that has an event is 'scored', with the
    event value as engine latency and a client time around it."""
    t = Tables(spark, sf_dir)
    dec = classified_tickets(spark, sf_dir).select("rec_id", "id", "label", "status")
    ev = t.events.select(
        F.col("event_id").alias("rec_id"),
        F.col("value").alias("latency_ms"),
        (F.col("value") + (F.col("user_id") % 7 - 2) * 0.5).alias("client_ms"),
        "ts",
    )
    return dec.join(ev, "rec_id")


RESULTS_SQL_TMPL = """SELECT d.rec_id, d.id, d.label, d.status, e.value AS latency_ms,
    e.value + (e.user_id % 7 - 2) * 0.5 AS client_ms, e.ts
  FROM ({dec}) d JOIN events e ON e.event_id = d.rec_id"""


def _results_sql() -> str:
    from arbiter.plans.decisions import _tickets_decided_sql

    return RESULTS_SQL_TMPL.format(dec=_tickets_decided_sql())


def _joined(spark, sf_dir):
    tk = X.ticket_set(Tables(spark, sf_dir).orders).select("id", "expected", "adversarial", "variant", "category", "tag")
    return tk.join(results(spark, sf_dir).drop("rec_id"), "id", "left")


def _joined_sql() -> str:
    return f"""SELECT t.id, t.expected, t.adversarial, t.variant, t.category, t.tag, r.label, r.status, r.latency_ms, r.client_ms, r.ts
      FROM ({O.ticket_set()}) t LEFT JOIN ({_results_sql()}) r ON t.id = r.id"""


@query(
    "j4_tickets_results",
    sql=lambda: f"SELECT id, expected, label, status, round(latency_ms, 4) AS latency_ms FROM ({_joined_sql()})",
)
def j4_tickets_results(spark, sf_dir):
    """Tickets ⟕ results (unscored tickets keep null result columns)."""
    return _joined(spark, sf_dir).select("id", "expected", "label", "status", F.round("latency_ms", 4).alias("latency_ms"))


@query(
    "f4_filter_results",
    sql=lambda: f"""SELECT 'all' AS filter, count(*) AS n FROM ({_joined_sql()})
      UNION ALL SELECT 'correct', count(*) FROM ({_joined_sql()}) WHERE status IS NOT NULL AND label IS NOT DISTINCT FROM expected
      UNION ALL SELECT 'wrong', count(*) FROM ({_joined_sql()}) WHERE status IS NOT NULL AND label IS DISTINCT FROM expected
      UNION ALL SELECT 'adversarial', count(*) FROM ({_joined_sql()}) WHERE adversarial IS NOT NULL
      UNION ALL SELECT 'variations', count(*) FROM ({_joined_sql()}) WHERE variant IS NOT NULL""",
)
def f4_filter_results(spark, sf_dir):
    """size of each result filter (all / correct / wrong / adversarial / variations)."""
    names = ["all", "correct", "wrong", "adversarial", "variations"]
    holds = M.result_filters()
    one = _joined(spark, sf_dir).agg(*[F.count(F.when(holds[n], 1)).alias(n) for n in names])
    rows = F.array(*[F.struct(F.lit(n).alias("filter"), F.col(n).alias("n")) for n in names])
    return one.select(F.explode(rows).alias("r")).select("r.filter", "r.n")


@query(
    "f5_pending",
    sql=lambda: f"SELECT id FROM ({O.ticket_set()}) t WHERE NOT EXISTS (SELECT 1 FROM ({_results_sql()}) r WHERE r.id = t.id)",
)
def f5_pending(spark, sf_dir):
    """tickets not scored yet (resume point)."""
    tk = X.ticket_set(Tables(spark, sf_dir).orders).select("id")
    return M.pending(tk, results(spark, sf_dir).select("id"))


def _quantile_sql(src: str, group: str, value: str) -> str:
    return f"""WITH r AS (SELECT {group} AS g, {value} AS v,
          row_number() OVER (PARTITION BY {group} ORDER BY {value}) - 1 AS rn,
          count(*) OVER (PARTITION BY {group}) AS n FROM ({src}) WHERE {value} IS NOT NULL)
      SELECT g AS {group}, any_value(n) AS n, round(avg(v), 4) AS avg, max(v) AS max,
        max(CASE WHEN rn = least(n - 1, floor(n * CAST(0.5 AS DOUBLE))) THEN v END) AS p50,
        max(CASE WHEN rn = least(n - 1, floor(n * CAST(0.95 AS DOUBLE))) THEN v END) AS p95
      FROM r GROUP BY g"""


@query("a5_latency_stats", sql=lambda: _quantile_sql("SELECT * FROM events", "event_type", "value"))
def a5_latency_stats(spark, sf_dir):
    """A5: n, avg, p50, p95, max of event values per type (exact rule quantiles)."""
    s = M.latency_stats(Tables(spark, sf_dir).events, ["event_type"], "value")
    return s.select("event_type", "n", F.round("avg", 4).alias("avg"), "max", "p50", "p95")


@query(
    "a6_run_stats",
    sql=lambda: f"""SELECT count(*) AS done, round(avg(greatest(0.0, client_ms - latency_ms)), 4) AS net_avg_ms,
        round(epoch(max(ts)) - epoch(min(ts)), 3) AS secs,
        round(count(*) / (epoch(max(ts)) - epoch(min(ts))), 4) AS throughput
      FROM ({_results_sql()})""",
)
def a6_run_stats(spark, sf_dir):
    """Network overhead and throughput of a run."""
    s = M.run_stats(results(spark, sf_dir), "latency_ms", "client_ms", "ts")
    return s.select(
        "done", F.round("net_avg_ms", 4).alias("net_avg_ms"), F.round("secs", 3).alias("secs"),
        F.round("throughput", 4).alias("throughput"),
    )


@query(
    "s5_export_summary",
    sql=lambda: f"""WITH j AS ({_joined_sql()}), r AS (SELECT * FROM j WHERE status IS NOT NULL),
      q AS ({_quantile_sql("SELECT 'run' AS run, latency_ms FROM r", 'run', 'latency_ms')})
      SELECT (SELECT count(*) FROM r) AS done,
        (SELECT count(*) FROM r WHERE label = expected) AS correct,
        (SELECT count(*) FROM r WHERE label IS NULL) AS invalid,
        (SELECT round(avg(CASE WHEN label = expected THEN 1.0 ELSE 0.0 END), 4) FROM r) AS accuracy,
        (SELECT round(avg(CASE WHEN label IS NULL THEN 1.0 ELSE 0.0 END), 4) FROM r) AS invalid_rate,
        (SELECT avg FROM q) AS engine_avg_ms, (SELECT round(p95, 4) FROM q) AS engine_p95_ms,
        (SELECT round(avg(greatest(0.0, client_ms - latency_ms)), 3) FROM r) AS round_trip_avg_ms""",
)
def s5_export_summary(spark, sf_dir):
    """The export's summary numbers (the JSON document is ``records.export_results``)."""
    r = results(spark, sf_dir)
    tk = X.ticket_set(Tables(spark, sf_dir).orders).select("id", "expected")
    j = r.join(tk, "id")
    hit = F.col("label") == F.col("expected")
    head = j.agg(
        F.count(F.lit(1)).alias("done"),
        F.sum(hit.cast("long")).alias("correct"),
        F.sum(F.col("label").isNull().cast("long")).alias("invalid"),
        F.round(F.avg(F.coalesce(hit, F.lit(False)).cast("double")), 4).alias("accuracy"),
        F.round(F.avg(F.col("label").isNull().cast("double")), 4).alias("invalid_rate"),
        F.round(F.avg(F.greatest(F.lit(0.0), F.col("client_ms") - F.col("latency_ms"))), 3).alias("round_trip_avg_ms"),
    )
    lat = row_value(M.latency_stats(j, [], "latency_ms").select("avg", "p95"))
    return head.select(
        "*", F.round(lat["avg"], 4).alias("engine_avg_ms"), F.round(lat["p95"], 4).alias("engine_p95_ms")
    )


@query(
    "s5_export_document",
    sql=lambda: f"""WITH r AS (SELECT * FROM ({_joined_sql()}) WHERE status IS NOT NULL)
      SELECT 'summary' AS section, '' AS key, NULL AS label, count(*) AS n, count(*) FILTER (WHERE label = expected) AS correct,
        round(count(*) / (epoch(max(ts)) - epoch(min(ts))), 4) AS throughput_per_sec FROM r
      UNION ALL SELECT 'class', expected, NULL, count(*), count(*) FILTER (WHERE label = expected), NULL FROM r GROUP BY expected
      UNION ALL SELECT 'ticket', id, label, 1, CASE WHEN label = expected THEN 1 ELSE 0 END, NULL FROM r""",
)
def s5_export_document(spark, sf_dir):
    """The whole export as one table: summary with throughput, one row a class, one row a ticket."""
    r = results(spark, sf_dir)
    tk = X.ticket_set(Tables(spark, sf_dir).orders).select("id", "expected")
    j = r.join(tk, "id").withColumn("hit", F.coalesce(F.col("label") == F.col("expected"), F.lit(False)).cast("long"))
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    run = M.run_stats(j.withColumn("c", F.col("client_ms")), "latency_ms", "c", "ts").select("throughput")
    total = j.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("correct"))
    speed = F.round(row_value(run)["throughput"], 4)
    per = j.groupBy("expected").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("correct"))

    def section(name, df, key, label, last):
        return df.select(
            F.lit(name).alias("section"), key.alias("key"), label.alias("label"),
            F.col("n").cast("long").alias("n"), F.col("correct").cast("long").alias("correct"), last.alias("throughput_per_sec"),
        )

    lines = j.select("id", "label", F.lit(1).alias("n"), F.col("hit").alias("correct"))
    return (
        section("summary", total, F.lit(""), text, speed)
        .unionByName(section("class", per, F.col("expected"), text, none))
        .unionByName(section("ticket", lines, F.col("id"), F.col("label"), none))
    )


# ---- A8 / A12 ----------------------------------------------------------------------------------


@query(
    "a8_coverage",
    sql=lambda: f"""SELECT category, coalesce(variant, adversarial, tag) AS display_tag, count(*) AS n,
        CAST(grouping(category, coalesce(variant, adversarial, tag)) AS INTEGER) AS gid
      FROM ({O.ticket_set()}) GROUP BY CUBE (category, coalesce(variant, adversarial, tag))""",
)
def a8_coverage(spark, sf_dir):
    """Ticket coverage over category × display tag, every grouping (cube)."""
    c = M.coverage(X.ticket_set(Tables(spark, sf_dir).orders))
    return c.withColumn("gid", F.col("gid").cast("int"))


@query(
    "a12_report",
    sql=lambda: f"""WITH h AS ({_headline_sql(_scored_sql())}), c AS ({_per_class_sql(_scored_sql())})
      SELECT 0 AS line_no, 'Evaluation' AS line UNION ALL SELECT 1, '----------' UNION ALL SELECT 2, ''
      UNION ALL SELECT 3, printf('Examples:           %d', n) FROM h
      UNION ALL SELECT 4, printf('Accuracy:           %.1f%%', accuracy * 100) FROM h
      UNION ALL SELECT 5, printf('Invalid outputs:    %.1f%%', invalid_rate * 100) FROM h
      UNION ALL SELECT 6, '' UNION ALL SELECT 7, 'Per-class:'
      UNION ALL SELECT 7 + row_number() OVER (ORDER BY expected), printf('%-20s%.1f%%', expected, accuracy * 100) FROM c""",
)
def a12_report(spark, sf_dir):
    """The text report over resolved outputs, one row per line."""
    c = M.cells(scored_outputs(spark, sf_dir))
    return M.report_lines(M.headline(c), M.per_class(c), "Evaluation")
