"""DuckDB SQL for the derived tables in ``sources.fixtures`` (oracle side).

Written against DuckDB's dialect on purpose (lists, ``lambda``, ``//``), so
the check is an independent formulation, not the Spark plan re-run.
"""

from __future__ import annotations

from arbiter.functions.text import sql_str, template_sql
from arbiter.sources import catalogue as C
from arbiter.sources.fixtures import ADVERSARIAL, QUALITY_OPTIONS, QUALITY_QUESTION, RAW_WRAPPERS, SHORT_TAG, TICKET_CATEGORY, TICKET_TAG

WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def rstrip(x: str) -> str:
    return f"rtrim({x}, {WS})"


def opts_sql(opts) -> str:
    items = ", ".join(
        f"{{'label': {sql_str(a)}, 'key': {sql_str(b)}, 'description': {sql_str(c)}}}" for a, b, c in opts
    )
    return f"[{items}]"


def lst(values) -> str:
    return "[" + ", ".join(sql_str(v) if isinstance(v, str) else str(v) for v in values) + "]"


def case(key: str, mapping: dict, default: str | None = None) -> str:
    whens = " ".join(f"WHEN {key} = {k} THEN {v}" for k, v in mapping.items())
    tail = f" ELSE {default}" if default is not None else ""
    return f"CASE {whens}{tail} END"


def split_sql(idc: str) -> tuple[str, str]:
    m = f"({idc} % 10)"
    return (
        f"CASE WHEN {m} < 6 THEN 'train' WHEN {m} < 8 THEN 'valid' ELSE 'test' END",
        f"CASE WHEN {m} < 6 THEN 0 WHEN {m} < 8 THEN 1 ELSE 2 END",
    )


def doc_records() -> str:
    s, r = split_sql("doc_id")
    return f"SELECT doc_id AS rec_id, {s} AS split, {r} AS split_rank, text AS state FROM documents"


def d_set() -> str:
    s, r = split_sql("d.doc_id")
    return f"""SELECT d.doc_id AS rec_id, {s} AS split, {r} AS split_rank, d.text AS state,
      {sql_str(QUALITY_QUESTION)} AS question, {opts_sql(QUALITY_OPTIONS)} AS options,
      CASE WHEN l.quality = 1 THEN 'A' ELSE 'B' END AS answer
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""


def _fin_values(tol: str = "1") -> dict:
    amount = "CAST(o_totalprice AS DECIMAL(14,2))"
    cur = f"({lst(C.CURRENCIES)})[o_orderkey % 3 + 1]"
    diff = f"({lst(C.DIFFS)})[(o_orderkey // 10) % 5 + 1]"
    return {
        "key": "CAST(o_orderkey AS VARCHAR)",
        "inv": "'INV-' || CAST(o_orderkey AS VARCHAR)",
        "po": "'PO-' || CAST(o_orderkey AS VARCHAR)",
        "vendor": f"({lst(C.VENDORS)})[o_orderkey % 6 + 1]",
        "cur": cur,
        "cur2": f"CASE WHEN {cur} = 'EUR' THEN 'USD' ELSE 'EUR' END",
        "amt": f"CAST({amount} AS VARCHAR)",
        "amt_diff": f"CAST(CAST({amount} + {diff} AS DECIMAL(14,2)) AS VARCHAR)",
        "amt_plus1": f"CAST(CAST({amount} + {tol} AS DECIMAL(14,2)) AS VARCHAR)",
        "day": "CAST(o_orderkey % 9 + 1 AS VARCHAR)",
        "diff": f"CAST({diff} AS VARCHAR)",
        "amt_en": f"format('{{:,.2f}}', {amount})",
        "amt_de": f"translate(format('{{:,.2f}}', {amount}), ',.', '.,')",
        "amt_diff_de": f"translate(format('{{:,.2f}}', CAST({amount} + {diff} AS DECIMAL(14,2))), ',.', '.,')",
        "_amount": amount,
        "_diff": diff,
    }


def finance_set() -> str:
    v = _fin_values()
    k = "(o_orderkey % 10)"
    spec = C.FINANCE_KINDS
    return f"""SELECT o_orderkey AS rec_id, CAST({k} AS INTEGER) AS kind, {v['vendor']} AS vendor,
      {v['_amount']} AS amount, {v['_diff']} AS diff, {v['cur']} AS cur, {v['cur2']} AS cur2,
      {case(k, {i: template_sql(s[0], v) for i, s in spec.items()})} AS state,
      {case(k, {i: sql_str(s[1]) for i, s in spec.items()})} AS question,
      {case(k, {i: opts_sql(s[2]) for i, s in spec.items()})} AS options,
      {case(k, {i: sql_str(s[3]) for i, s in spec.items()})} AS answer
    FROM orders"""


def ticket_set() -> str:
    """Tickets with flattened facts columns (f_kind, f_a, ...)."""
    k = "(o_orderkey % 10)"
    r = "((o_orderkey // 10) % 8)"
    b_ok = f"({k} = 8 AND {r} = 2)"
    b_bad = f"({k} = 8 AND {r} = 3)"
    tol = f"(CASE WHEN {b_ok} THEN 5 WHEN {b_bad} THEN 6 ELSE 1 END)"
    v = _fin_values(tol)
    v["review"] = f"({lst(C.REVIEW_STATES)})[{r} % 5 + 1]"
    spec = C.FINANCE_KINDS
    tt = C.TICKET_TEXTS
    reorder = f"({k} = 3 AND {r} = 1)"
    at = {name: f"({k} = {kk} AND {r} = {rr})" for name, (_, kk, rr) in ADVERSARIAL.items()}
    adv = " ".join(f"WHEN {at[name]} THEN {sql_str(spec[0])}" for name, spec in ADVERSARIAL.items())
    adv_tag = " ".join(f"WHEN {cond} THEN {sql_str(name)}" for name, cond in at.items())
    any_adv = " OR ".join(at.values())
    short = f"({k} IN (3, 4) AND {r} IN (2, 3))"
    short_para = f"({k} = 3 AND {r} = 3)"
    filler = f"repeat({sql_str(C.TICKET_FILLER)}, {C.TICKET_FILLER_REPEAT})"
    para = {0: "invoice_paraphrase", 2: "duplicate_paraphrase", 4: "ledger_paraphrase", 7: "missing_paraphrase"}
    is_para = f"({k} IN (0, 2, 4, 7) AND {r} = 0)"
    euro = f"({k} = 1 AND {r} = 6)"
    sym = f"({k} = 6 AND {r} = 6)"
    base = f"""CASE WHEN {is_para} THEN {case(k, {i: template_sql(tt[n], v) for i, n in para.items()})}
        WHEN {euro} THEN {template_sql(tt['mismatch_euro_format'], v)}
        WHEN {sym} THEN {template_sql(tt['currency_symbols'], v)}
        WHEN {k} = 9 THEN {template_sql(tt['needs_review'], v)}
        WHEN {short_para} THEN {template_sql(tt['payment_short_paraphrase'], v)}
        WHEN {short} AND {k} = 3 THEN {template_sql(tt['payment_short'], v)}
        WHEN {short} THEN {template_sql(tt['ledger_off'], v)}
        ELSE {case(k, {i: template_sql(s[0], v) for i, s in spec.items()})} END"""
    amount, diff = v["_amount"], v["_diff"]
    pad = "CAST(o_orderkey + 1 AS VARCHAR)"
    return f"""SELECT o_orderkey AS rec_id,
      'T-' || CASE WHEN length({pad}) >= 3 THEN {pad} ELSE lpad({pad}, 3, '0') END AS id,
      CASE WHEN {any_adv} THEN 'Adversarial' ELSE {case(k, {i: sql_str(c) for i, c in TICKET_CATEGORY.items()})} END AS category,
      CASE {adv_tag} WHEN {short} THEN {case(k, {i: sql_str(c) for i, c in SHORT_TAG.items()})} WHEN {b_bad} THEN 'tolerance-exceeded' ELSE {case(k, {i: sql_str(c) for i, c in TICKET_TAG.items()})} END AS tag,
      CASE WHEN {at['injection']} THEN {base} || {sql_str(C.INJECTION_SUFFIX)}
           WHEN {at['filler']} THEN {base} || {filler}
           WHEN {at['conflict']} THEN {template_sql(tt['conflict'], v)}
           WHEN {at['missing']} THEN {template_sql(tt['missing'], v)}
           WHEN {at['long-state']} THEN {filler} || {template_sql(tt['key_fact'], v)} ELSE {base} END AS state,
      {case(k, {i: sql_str(s[1]) for i, s in spec.items()})} AS question,
      CASE WHEN {reorder} THEN {opts_sql(C.TICKET_REORDERED_OPTIONS)}
           WHEN {at['reorder']} THEN {opts_sql(C.TICKET_ADVERSARIAL_OPTIONS)}
           WHEN {k} = 2 THEN {opts_sql(C.TICKET_DUP_OPTIONS)} ELSE {opts_sql(C.TICKET_OPTIONS)} END AS options,
      CASE WHEN {reorder} OR {at['reorder']} THEN 'C' WHEN {b_bad} OR {short} THEN 'B' ELSE {case(k, {i: sql_str(s[3]) for i, s in spec.items()})} END AS expected,
      CASE {adv} END AS adversarial,
      CASE WHEN {is_para} OR {short_para} THEN 'paraphrase' WHEN {reorder} THEN 'order'
           WHEN {b_ok} OR {b_bad} THEN 'boundary' WHEN {euro} OR {sym} THEN 'format' END AS variant,
      'recon' AS f_kind,
      CASE WHEN {at['missing']} THEN 0 WHEN {k} IN (1, 5) THEN {amount} + {diff} WHEN {k} = 8 THEN {amount} + {tol} ELSE {amount} END AS f_a,
      CASE WHEN {k} IN (7, 9) THEN 0 WHEN {short} THEN {amount} + {diff} ELSE {amount} END AS f_b,
      CASE WHEN {euro} OR {at['missing']} THEN 'EUR' WHEN {sym} THEN 'USD' ELSE {v['cur']} END AS f_cur_a,
      CASE WHEN {euro} OR {sym} OR {at['missing']} THEN 'EUR' WHEN {k} = 6 THEN {v['cur2']} ELSE {v['cur']} END AS f_cur_b,
      CASE WHEN {k} = 8 THEN 5 END AS f_tolerance,
      {k} IN (7, 9) AS f_missing_ref, {k} = 2 AS f_duplicate, {k} = 2 AS f_dup_vocab
    FROM orders"""


def raw_outputs() -> str:
    fin_k = "(rec_id % 10)"
    wrap = case(
        fin_k,
        {
            i: (template_sql(w, {"label": "answer", "lower": "lower(answer)"}) if w is not None else "NULL")
            for i, w in enumerate(RAW_WRAPPERS)
        },
    )
    return f"""SELECT 'priority' AS source, CAST(o_orderkey AS VARCHAR) AS rec_id, o_orderpriority AS raw,
        ['URGENT', 'HIGH', 'LOW'] AS allowed FROM orders
      UNION ALL
      SELECT 'assistant', conv_id || ':' || turn, text, ['A', 'THE', 'LA'] FROM conversations
        WHERE role = 'assistant'
      UNION ALL
      SELECT 'finance', CAST(rec_id AS VARCHAR), {wrap}, list_transform(options, lambda o: o.label)
        FROM ({finance_set()}) f"""


def general_set() -> str:
    k = "c_custkey"
    kind = f"({k} % 5)"
    sp = f"({k} % 3)"
    sub = f"(({k} // 3) % 3 + 1)"
    ks = f"CAST({k} AS VARCHAR)"
    sent = (
        f"CASE {sp} WHEN 0 THEN ({lst(C.POSITIVE_TEXTS)})[{sub}] WHEN 1 THEN ({lst(C.NEGATIVE_TEXTS)})[{sub}] "
        f"ELSE ({lst(C.NEUTRAL_TEXTS)})[{sub}] END"
    )
    intent = case(f"({k} % 4)", {i: template_sql(t, {"key": ks}) for i, t in enumerate(C.INTENT_TEXTS)})
    even = f"({k} % 2 = 0)"
    value = f"CASE WHEN {even} THEN ({k} % 19 + 2) * 10 + 1000 ELSE 900 - (({k} // 19) % 19 + 2) END"
    fact = f"CASE WHEN {even} THEN {template_sql(C.FACTUAL_TEXTS[0], {'key': ks})} ELSE {template_sql(C.FACTUAL_TEXTS[1], {'key': ks})} END"
    route = case(
        sp,
        {i: template_sql(t, {"key": ks, "quarter": f"CAST({k} % 4 + 1 AS VARCHAR)"}) for i, t in enumerate(C.ROUTING_TEXTS)},
    )
    text = case(kind, {0: sent, 1: intent, 3: fact, 4: route})
    vals = {"key": ks, "text": text, "value": f"CAST({value} AS VARCHAR)"}
    g = C.GENERAL_KINDS
    abc = f"(['A', 'B', 'C'])[{sp} + 1]"
    answer = case(
        kind,
        {0: abc, 1: f"(['A', 'B', 'C', 'D'])[{k} % 4 + 1]", 2: f"CASE WHEN {even} THEN 'A' ELSE 'B' END",
         3: f"CASE WHEN {even} THEN 'A' ELSE 'B' END", 4: abc},
    )
    opts = case(
        kind,
        {0: opts_sql(C.SENTIMENT_OPTIONS), 1: opts_sql(C.INTENT_OPTIONS), 2: opts_sql(C.LOGIC_OPTIONS),
         3: opts_sql(C.FACTUAL_OPTIONS), 4: opts_sql(C.ROUTING_OPTIONS)},
    )
    conclusion = case(
        kind,
        {
            0: f"(['positive', 'negative', 'neutral'])[{sp} + 1]",
            1: f"(['billing', 'cancel', 'technical', 'general'])[{k} % 4 + 1]",
            2: f"CASE WHEN {value} >= 1000 THEN 'yes' ELSE 'no' END",
            3: f"CASE WHEN {even} THEN 'true' ELSE 'false' END",
            4: f"(['billing', 'technical', 'sales'])[{sp} + 1]",
        },
    )
    return f"""SELECT {k} AS rec_id, CAST({kind} AS INTEGER) AS kind,
      {case(kind, {i: template_sql(t[0], vals) for i, t in g.items()})} AS state,
      {case(kind, {i: sql_str(t[1]) for i, t in g.items()})} AS question,
      {opts} AS options, {answer} AS answer, {conclusion} AS conclusion
    FROM customer"""
