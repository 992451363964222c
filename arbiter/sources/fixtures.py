"""Decision-record tables derived from the given warehouse tables.

Every table here is a pure projection (or one join) of the input tables, so
its size grows with them and no shuffle is added beyond the join itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbiter.functions.text import template
from arbiter.sources import catalogue as C

OPTION_TYPE = "array<struct<label:string,key:string,description:string>>"

QUALITY_QUESTION = "Is this document of good quality?"
QUALITY_OPTIONS = [("A", "good", "Good quality"), ("B", "poor", "Poor quality")]

FACTS_FIELDS = [
    ("kind", "string"),
    ("a", "decimal(14,2)"),
    ("b", "decimal(14,2)"),
    ("curA", "string"),
    ("curB", "string"),
    ("tolerance", "decimal(14,2)"),
    ("missingRef", "boolean"),
    ("duplicate", "boolean"),
    ("dupVocab", "boolean"),
    ("sentiment", "string"),
    ("intent", "string"),
    ("value", "double"),
    ("threshold", "double"),
    ("unknown", "boolean"),
    ("truth", "string"),
    ("queue", "string"),
]


def options_lit(opts) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(lab).alias("label"), F.lit(key).alias("key"), F.lit(desc).alias("description")
            )
            for lab, key, desc in opts
        ]
    )


def facts(**given: Column) -> Column:
    """One wide nullable struct standing in for the tagged union of fact kinds."""
    fields = []
    for name, typ in FACTS_FIELDS:
        c = given.get(name)
        fields.append((c if c is not None else F.lit(None)).cast(typ).alias(name))
    return F.struct(*fields)


def case_on(key: Column, mapping: dict, default: Column | None = None) -> Column:
    out = None
    for k, v in mapping.items():
        v = v if isinstance(v, Column) else F.lit(v)
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(default) if default is not None else out


def pick(values: list, index: Column) -> Column:
    """values[index] for a small fixed list (0-based)."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def split_of(rec_id: Column) -> tuple[Column, Column]:
    m = rec_id % 10
    split = F.when(m < 6, "train").when(m < 8, "valid").otherwise("test")
    rank = F.when(m < 6, 0).when(m < 8, 1).otherwise(2)
    return split, rank


# ---- documents as decision records -----------------------------------------------


def doc_records(documents: DataFrame) -> DataFrame:
    """All documents as (rec_id, split, split_rank, state); no answer."""
    split, rank = split_of(F.col("doc_id"))
    return documents.select(
        F.col("doc_id").alias("rec_id"),
        split.alias("split"),
        rank.alias("split_rank"),
        F.col("text").alias("state"),
    )


def d_set(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled quality records: documents ⋈ labels, answer A (good) / B (poor)."""
    split, rank = split_of(F.col("doc_id"))
    return documents.select("doc_id", "text").join(
        labels.select("doc_id", "quality"), "doc_id"
    ).select(
        F.col("doc_id").alias("rec_id"),
        split.alias("split"),
        rank.alias("split_rank"),
        F.col("text").alias("state"),
        F.lit(QUALITY_QUESTION).alias("question"),
        options_lit(QUALITY_OPTIONS).alias("options"),
        F.when(F.col("quality") == 1, "A").otherwise("B").alias("answer"),
    )


# ---- finance records from orders (G1) ---------------------------------------------


def _finance_values(key: Column, price: Column, tol_diff: Column | None = None) -> dict:
    amount = price.cast("decimal(14,2)")
    diff = pick(C.DIFFS, F.floor(key / 10) % 5)
    cur = pick(C.CURRENCIES, key % 3)
    tol_diff = F.lit(1) if tol_diff is None else tol_diff
    return {
        "key": key.cast("string"),
        "inv": F.concat(F.lit("INV-"), key.cast("string")),
        "po": F.concat(F.lit("PO-"), key.cast("string")),
        "vendor": pick(C.VENDORS, key % 6),
        "cur": cur,
        "cur2": F.when(cur == "EUR", "USD").otherwise("EUR"),
        "amt": amount.cast("string"),
        "amt_diff": (amount + diff).cast("decimal(14,2)").cast("string"),
        "amt_plus1": (amount + tol_diff).cast("decimal(14,2)").cast("string"),
        "day": (key % 9 + 1).cast("string"),
        "diff": diff.cast("string"),
        "amt_en": _en(amount),
        "amt_de": _de(amount),
        "amt_diff_de": _de((amount + diff).cast("decimal(14,2)")),
        "_amount": amount,
        "_diff": diff,
    }


def _en(amount: Column) -> Column:
    """1,234.56 (en-US grouping)."""
    return F.format_number(amount, 2)


def _de(amount: Column) -> Column:
    """1.234,56 (de-DE grouping)."""
    return F.translate(F.format_number(amount, 2), ",.", ".,")


def finance_facts(
    kind: Column,
    v: dict,
    tol_diff: Column | None = None,
    cur_a: Column | None = None,
    cur_b: Column | None = None,
    short: Column | None = None,
    blank: Column | None = None,
) -> Column:
    """``short``: the second amount is higher by the difference; ``blank``: no amount is known, in euro."""
    amount = v["_amount"]
    tol_diff = F.lit(1) if tol_diff is None else tol_diff
    a = case_on(
        kind,
        {1: amount + v["_diff"], 5: amount + v["_diff"], 8: amount + tol_diff},
        amount,
    )
    b = case_on(kind, {7: F.lit(0), 9: F.lit(0)}, amount)
    if short is not None:
        b = F.when(short, amount + v["_diff"]).otherwise(b)
    if blank is not None:
        a, b = (F.when(blank, F.lit(0)).otherwise(x) for x in (a, b))
    return facts(
        kind=F.lit("recon"),
        a=a,
        b=b,
        curA=F.coalesce(cur_a, v["cur"]) if cur_a is not None else v["cur"],
        curB=F.coalesce(cur_b, F.when(kind == 6, v["cur2"]).otherwise(v["cur"]))
        if cur_b is not None
        else F.when(kind == 6, v["cur2"]).otherwise(v["cur"]),
        tolerance=F.when(kind == 8, F.lit(5)),
        missingRef=kind.isin(7, 9),
        duplicate=kind == 2,
        dupVocab=kind == 2,
    )


def finance_set(orders: DataFrame) -> DataFrame:
    """G1 over orders: kind = o_orderkey mod 10, all picks by key arithmetic."""
    key = F.col("o_orderkey")
    kind = key % 10
    v = _finance_values(key, F.col("o_totalprice"))
    # Columns of their own, as in ticket_set: written out in every template they make a method too long to be compiled.
    orders = orders.select("o_orderkey", *[c.alias(f"_v_{name}") for name, c in v.items()])
    v = {name: F.col(f"_v_{name}") for name in v}
    spec = C.FINANCE_KINDS
    return orders.select(
        key.alias("rec_id"),
        kind.cast("int").alias("kind"),
        v["vendor"].alias("vendor"),
        v["_amount"].alias("amount"),
        v["_diff"].alias("diff"),
        v["cur"].alias("cur"),
        v["cur2"].alias("cur2"),
        case_on(kind, {k: template(s[0], v) for k, s in spec.items()}).alias("state"),
        case_on(kind, {k: s[1] for k, s in spec.items()}).alias("question"),
        case_on(kind, {k: options_lit(s[2]) for k, s in spec.items()}).alias("options"),
        case_on(kind, {k: s[3] for k, s in spec.items()}).alias("answer"),
        finance_facts(kind, v).alias("facts"),
    )


# ---- tickets with evidence (G3) ----------------------------------------------------

TICKET_CATEGORY = {
    0: "Invoice / PO", 1: "Invoice / PO", 2: "Invoice / PO", 3: "Reconciliation",
    4: "Reconciliation", 5: "Invoice / PO", 6: "Invoice / PO", 7: "Triage",
    8: "Invoice / PO", 9: "Triage",
}
TICKET_TAG = {
    0: "invoice-match", 1: "po-mismatch", 2: "duplicate", 3: "payment-match",
    4: "ledger-match", 5: "po-mismatch", 6: "currency-mismatch", 7: "missing-ref",
    8: "tolerance-ok", 9: "needs-review",
}
SHORT_TAG = {3: "payment-mismatch", 4: "ledger-mismatch"}
#: tag: (adversarial kind, kind, r) of the tickets in the Adversarial category.
ADVERSARIAL = {
    "injection": ("prompt-injection", 1, 4),
    "filler": ("irrelevant-info", 0, 5),
    "conflict": ("conflicting-evidence", 6, 4),
    "missing": ("missing-info", 7, 4),
    "reorder": ("option-order", 1, 5),
    "long-state": ("evidence-at-end", 0, 7),
}


def ticket_set(orders: DataFrame) -> DataFrame:
    """Tickets: finance records + id, category, tag, variant, adversarial, facts.

    Everything is picked by kind = key mod 10 and r = (key div 10) mod 8. Variants: paraphrase
    (kinds 0, 2, 4, 7 at r 0, kind 3 at r 3: reworded texts), order (kind 3, r 1: shuffled
    options, match is C), boundary (kind 8, r 2: difference exactly 5, still a match; r 3:
    difference 6, a mismatch), format (kind 1, r 6: German amounts in euro; kind 6, r 6: $ vs €
    symbols). Kind 9 cycles through five review reasons. Reconciliation: kinds 3 and 4 at r 2 and
    r 3 are short by the difference (payment-mismatch, ledger-mismatch).
    Adversarial category, one kind each: prompt injection (kind 1, r 4) and filler (kind 0, r 5)
    appended to STATE, contradicting currencies (kind 6, r 4), a payment without a reference
    (kind 7, r 4), shuffled options (kind 1, r 5: mismatch is C), evidence after filler (kind 0,
    r 7). The rule decision never reads STATE.
    """
    key = F.col("o_orderkey")
    kind = key % 10
    r = F.floor(key / 10) % 8
    boundary_ok = (kind == 8) & (r == 2)
    boundary_bad = (kind == 8) & (r == 3)
    tol_diff = F.when(boundary_ok, 5).when(boundary_bad, 6).otherwise(1)
    v = _finance_values(key, F.col("o_totalprice"), tol_diff)
    v["review"] = pick(C.REVIEW_STATES, r % 5)
    # The values are columns of their own: written out in every template they outgrow one generated method.
    orders = orders.select("o_orderkey", tol_diff.alias("_tol"), *[c.alias(f"_v_{name}") for name, c in v.items()])
    v, tol_diff = {name: F.col(f"_v_{name}") for name in v}, F.col("_tol")
    spec = C.FINANCE_KINDS
    tt = C.TICKET_TEXTS
    reorder = (kind == 3) & (r == 1)
    attack = {name: (kind == k) & (r == at) for name, (_, k, at) in ADVERSARIAL.items()}
    short = kind.isin(*SHORT_TAG) & r.isin(2, 3)
    paraphrase = {0: "invoice_paraphrase", 2: "duplicate_paraphrase", 4: "ledger_paraphrase", 7: "missing_paraphrase"}
    short_para = (kind == 3) & (r == 3)
    is_para = kind.isin(*paraphrase) & (r == 0)
    euro = (kind == 1) & (r == 6)
    symbols = (kind == 6) & (r == 6)
    base_state = case_on(kind, {k: template(s[0], v) for k, s in spec.items()})
    base_state = (
        F.when(is_para, case_on(kind, {k: template(tt[name], v) for k, name in paraphrase.items()}))
        .when(euro, template(tt["mismatch_euro_format"], v))
        .when(symbols, template(tt["currency_symbols"], v))
        .when(kind == 9, template(tt["needs_review"], v))
        .when(short_para, template(tt["payment_short_paraphrase"], v))
        .when(short, case_on(kind, {3: template(tt["payment_short"], v), 4: template(tt["ledger_off"], v)}))
        .otherwise(base_state)
    )
    filler = F.repeat(F.lit(C.TICKET_FILLER), C.TICKET_FILLER_REPEAT)
    state = (
        F.when(attack["injection"], F.concat(base_state, F.lit(C.INJECTION_SUFFIX)))
        .when(attack["filler"], F.concat(base_state, filler))
        .when(attack["conflict"], template(tt["conflict"], v))
        .when(attack["missing"], template(tt["missing"], v))
        .when(attack["long-state"], F.concat(filler, template(tt["key_fact"], v)))
        .otherwise(base_state)
    )
    opts = (
        F.when(reorder, options_lit(C.TICKET_REORDERED_OPTIONS))
        .when(attack["reorder"], options_lit(C.TICKET_ADVERSARIAL_OPTIONS))
        .when(kind == 2, options_lit(C.TICKET_DUP_OPTIONS))
        .otherwise(options_lit(C.TICKET_OPTIONS))
    )
    answer = case_on(kind, {k: s[3] for k, s in spec.items()})
    expected = F.when(reorder | attack["reorder"], "C").when(boundary_bad | short, "B").otherwise(answer)
    variant = (
        F.when(is_para | short_para, "paraphrase")
        .when(reorder, "order")
        .when(boundary_ok | boundary_bad, "boundary")
        .when(euro | symbols, "format")
    )
    hit = [F.when(cond, F.struct(F.lit(name).alias("tag"), F.lit(ADVERSARIAL[name][0]).alias("kind"))) for name, cond in attack.items()]
    hit = F.coalesce(*hit)
    adversarial = hit["kind"]
    tag = F.coalesce(
        hit["tag"],
        F.when(boundary_bad, "tolerance-exceeded").when(short, case_on(kind, SHORT_TAG)),
        case_on(kind, TICKET_TAG),
    )
    return orders.select(
        key.alias("rec_id"),
        F.concat(F.lit("T-"), _pad3(key + 1)).alias("id"),
        F.when(adversarial.isNotNull(), "Adversarial").otherwise(case_on(kind, TICKET_CATEGORY)).alias("category"),
        tag.alias("tag"),
        state.alias("state"),
        case_on(kind, {k: s[1] for k, s in spec.items()}).alias("question"),
        opts.alias("options"),
        expected.alias("expected"),
        adversarial.alias("adversarial"),
        variant.alias("variant"),
        finance_facts(
            kind,
            v,
            tol_diff,
            cur_a=F.when(euro | attack["missing"], "EUR").when(symbols, "USD"),
            cur_b=F.when(euro | symbols | attack["missing"], "EUR"),
            short=short,
            blank=attack["missing"],
        ).alias("facts"),
    )


def _pad3(c: Column) -> Column:
    s = c.cast("string")
    return F.when(F.length(s) >= 3, s).otherwise(F.lpad(s, 3, "0"))


# ---- general records from customers (G2) -------------------------------------------


def general_set(customer: DataFrame) -> DataFrame:
    """G2 over customer: kind = c_custkey mod 5 (sentiment, intent, logic, factual, routing)."""
    k = F.col("c_custkey")
    kind = k % 5
    ks = k.cast("string")
    s_pick = k % 3
    sent_text = F.get(
        F.array(
            pick(C.POSITIVE_TEXTS, F.floor(k / 3) % 3),
            pick(C.NEGATIVE_TEXTS, F.floor(k / 3) % 3),
            pick(C.NEUTRAL_TEXTS, F.floor(k / 3) % 3),
        ),
        s_pick.cast("int"),
    )
    i_pick = k % 4
    intent_text = F.get(
        F.array(*[template(t, {"key": ks}) for t in C.INTENT_TEXTS]), i_pick.cast("int")
    )
    lo_a = k % 19 + 2
    lo_b = F.floor(k / 19) % 19 + 2
    even = k % 2 == 0
    value = F.when(even, lo_a * 10 + 1000).otherwise(900 - lo_b)
    fact_text = F.when(even, template(C.FACTUAL_TEXTS[0], {"key": ks})).otherwise(
        template(C.FACTUAL_TEXTS[1], {"key": ks})
    )
    route_text = F.get(
        F.array(
            *[
                template(t, {"key": ks, "quarter": (k % 4 + 1).cast("string")})
                for t in C.ROUTING_TEXTS
            ]
        ),
        s_pick.cast("int"),
    )
    text = case_on(kind, {0: sent_text, 1: intent_text, 3: fact_text, 4: route_text})
    vals = {"key": ks, "text": text, "value": value.cast("string")}
    g = C.GENERAL_KINDS
    abc = pick(["A", "B", "C"], s_pick)
    answer = case_on(
        kind,
        {
            0: abc,
            1: pick(["A", "B", "C", "D"], i_pick),
            2: F.when(even, "A").otherwise("B"),
            3: F.when(even, "A").otherwise("B"),
            4: abc,
        },
    )
    opts = case_on(
        kind,
        {
            0: options_lit(C.SENTIMENT_OPTIONS),
            1: options_lit(C.INTENT_OPTIONS),
            2: options_lit(C.LOGIC_OPTIONS),
            3: options_lit(C.FACTUAL_OPTIONS),
            4: options_lit(C.ROUTING_OPTIONS),
        },
    )
    fact = case_on(
        kind,
        {
            0: facts(kind=F.lit("sentiment"), sentiment=pick(["positive", "negative", "neutral"], s_pick)),
            1: facts(kind=F.lit("intent"), intent=pick(["billing", "cancel", "technical", "general"], i_pick)),
            2: facts(kind=F.lit("logic"), value=value, threshold=F.lit(1000.0)),
            3: facts(kind=F.lit("factual"), truth=F.when(even, "true").otherwise("false")),
            4: facts(kind=F.lit("routing"), queue=pick(["billing", "technical", "sales"], s_pick)),
        },
    )
    return customer.select(
        k.alias("rec_id"),
        kind.cast("int").alias("kind"),
        case_on(kind, {i: template(t[0], vals) for i, t in g.items()}).alias("state"),
        case_on(kind, {i: t[1] for i, t in g.items()}).alias("question"),
        opts.alias("options"),
        answer.alias("answer"),
        fact.alias("facts"),
    )


# ---- raw model outputs (D5 input) -------------------------------------------------

# FIXED VALUES: wrappers around a finance answer, picked by key mod 10.
RAW_WRAPPERS = [
    "{label}",
    "{lower}",
    "  {lower} ",
    "The answer is {label} because amounts differ.",
    "I don't know.",
    "A or B?",
    "Z",
    "ABC",
    "",
    None,
]


def raw_outputs(orders: DataFrame, conversations: DataFrame) -> DataFrame:
    """(source, rec_id, raw, allowed) from three families of model-like text."""
    pri = orders.select(
        F.lit("priority").alias("source"),
        F.col("o_orderkey").cast("string").alias("rec_id"),
        F.col("o_orderpriority").alias("raw"),
        F.array(F.lit("URGENT"), F.lit("HIGH"), F.lit("LOW")).alias("allowed"),
    )
    conv = conversations.where(F.col("role") == "assistant").select(
        F.lit("assistant").alias("source"),
        F.concat_ws(":", "conv_id", "turn").alias("rec_id"),
        F.col("text").alias("raw"),
        F.array(F.lit("A"), F.lit("THE"), F.lit("LA")).alias("allowed"),
    )
    wrap = finance_set(orders).select(
        F.lit("finance").alias("source"),
        F.col("rec_id").cast("string").alias("rec_id"),
        wrapped_answer(F.col("rec_id"), F.col("answer")).alias("raw"),
        F.transform("options", lambda o: o["label"]).alias("allowed"),
    )
    return pri.unionByName(conv).unionByName(wrap)


def wrapped_answer(rec_id: Column, answer: Column) -> Column:
    """A model-like raw output around the answer, wrapper picked by rec_id mod 10."""
    vals = {"label": answer, "lower": F.lower(answer)}
    return case_on(
        rec_id % 10,
        {i: (template(w, vals) if w is not None else F.lit(None).cast("string")) for i, w in enumerate(RAW_WRAPPERS)},
    )


# ---- records with seeded defects (F1 input) ----------------------------------------

DEFECTS = {
    0: "none",
    1: "drop state",
    2: "null state",
    3: "numeric question",
    4: "one option",
    5: "option without description",
    6: "answer Z",
}


def corrupt_set(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """D-set rendered as JSON bodies, defect picked by doc_id mod 7."""
    d = d_set(documents, labels)
    k = F.col("rec_id") % 7
    st, q, o, a = F.col("state"), F.col("question"), F.col("options"), F.col("answer")
    no_desc = F.transform(
        o,
        lambda x, i: F.struct(
            x["label"].alias("label"),
            x["key"].alias("key"),
            F.when(i != 1, x["description"]).alias("description"),
        ),
    )
    body = case_on(
        k,
        {
            0: F.to_json(F.struct(st.alias("state"), q.alias("question"), o.alias("options"), a.alias("answer"))),
            1: F.to_json(F.struct(q.alias("question"), o.alias("options"), a.alias("answer"))),
            2: F.to_json(
                F.struct(
                    F.lit(None).cast("string").alias("state"), q.alias("question"),
                    o.alias("options"), a.alias("answer"),
                ),
                {"ignoreNullFields": "false"},
            ),
            3: F.to_json(F.struct(st.alias("state"), F.lit(42).alias("question"), o.alias("options"), a.alias("answer"))),
            4: F.to_json(F.struct(st.alias("state"), q.alias("question"), F.slice(o, 1, 1).alias("options"), a.alias("answer"))),
            5: F.to_json(F.struct(st.alias("state"), q.alias("question"), no_desc.alias("options"), a.alias("answer"))),
            6: F.to_json(F.struct(st.alias("state"), q.alias("question"), o.alias("options"), F.lit("Z").alias("answer"))),
        },
    )
    return d.select("rec_id", "split", "split_rank", k.cast("int").alias("defect"), body.alias("body"))
