"""Validation counts (F1), split parsing (S3), request ingest (S4), the
reconciliation rules (D1–D4), duplicates (J7) and leakage (J1)."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from arbiter.operators import validate as V
from arbiter.operators.leakage import leakage, leakage_counts
from arbiter.operators.recon import find_duplicates
from arbiter.operators.rules import classify, conclude
from arbiter.session import Tables
from arbiter.sources import fixtures as X
from arbiter.sources import records as R
from tests.conftest import SF01

OPTS = [{"label": "A", "key": "match", "description": "d"}, {"label": "B", "key": "mismatch", "description": "d"}]


def violations(spark, bodies):
    df = spark.createDataFrame([(i, "train", b) for i, b in enumerate(bodies)], "rec_id long, split string, body string")
    rows = V.validate(V.parse_records(df), "rec_id").collect()
    out = {i: [] for i in range(len(bodies))}
    for r in rows:
        out[r.rec_id].append((r.rule, r.detail))
    return out


def test_validation_counts(spark):
    good = {"state": "s", "question": "q", "options": OPTS, "answer": "a"}
    no_state = {k: v for k, v in good.items() if k != "state"}
    null_state = {**good, "state": None}
    no_options = {k: v for k, v in good.items() if k != "options"}
    no_answer = {k: v for k, v in good.items() if k != "answer"}
    one_option = {**good, "options": OPTS[:1]}
    missing_desc = {**good, "options": [OPTS[0], {"label": "B", "key": "k"}], "answer": "B"}
    got = violations(spark, [json.dumps(x) for x in [good, no_state, null_state, no_options, no_answer, one_option, missing_desc]] + ["{bad"])
    assert got[0] == []
    assert got[1] == [("missing_field", "state"), ("empty_field", "state")]
    assert got[2] == [("empty_field", "state")]
    assert [r for r, _ in got[3]] == ["missing_field", "bad_options"]
    assert got[4] == [("missing_field", "answer"), ("answer_not_in_labels", "")]
    assert [r for r, _ in got[5]] == ["bad_options"]
    assert got[6] == [("bad_option", "1"), ("answer_not_in_labels", "B")]
    assert got[7] == [("invalid_json", "")]


def test_gate_raises(spark):
    df = spark.createDataFrame([("valid", 3)], "split string, n_violations long")
    with pytest.raises(ValueError, match="valid: 3"):
        V.assert_valid(df)


def test_split_states(spark):
    blobs = ["a\n\nb\n\n\nc", '["x", 1, "  y "]', "   ", "[not json"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blobs)], "b long, blob string")
    ok, err = R.split_states(df, "blob", "b")
    got = sorted((r.b, r.item_no, r.state) for r in ok.collect())
    assert got == [(0, 1, "a"), (0, 2, "b"), (0, 3, "c"), (1, 1, "x"), (1, 2, "1"), (1, 3, "  y ")]
    assert sorted((r.b, r.error) for r in err.collect()) == [(2, "empty batch"), (3, "invalid JSON array")]


def test_a_batch_is_stripped_once(spark):
    df = spark.createDataFrame([(0, "a\n\nb"), (1, '["x"]')], "b long, blob string")
    plan = R.split_states(df, "blob", "b")[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(coalesce(blob") == 1


def test_read_records_modes(spark, tmp_path):
    good = json.dumps({"rec_id": 1, "state": "s", "question": "q", "options": OPTS, "answer": "A"})
    (tmp_path / "part.jsonl").write_text(good + "\n\n{broken\n", encoding="utf-8")
    ok, bad = R.quarantine(R.read_records(spark, str(tmp_path), mode="PERMISSIVE"))
    assert [r.rec_id for r in ok.collect()] == [1]
    assert [r[R.CORRUPT] for r in bad.collect()] == ["{broken"]
    with pytest.raises(Exception):
        R.read_records(spark, str(tmp_path), mode="FAILFAST").collect()


def test_head_n(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("k"))
    assert [r.k for r in R.head_n(df, 40, ["k"]).collect()] == list(range(40))
    assert R.head_n(df, 0, ["k"]).count() == R.head_n(df, None, ["k"]).count() == 500


def test_export_results(spark, tmp_path):
    summary = spark.createDataFrame([(2, 1, 0.5)], "done long, correct long, accuracy double")
    per = spark.createDataFrame([("A", 1, 1, 1.0), ("B", 1, 0, 0.0)], "expected string, n long, correct long, accuracy double")
    tickets = spark.createDataFrame([("T-001", "A", "A"), ("T-002", "B", None)], "id string, expected string, got string")
    doc, lines = R.export_results(summary, per, tickets, str(tmp_path / "run"))
    d = json.loads(doc.first().value)
    assert d["summary"]["done"] == 2 and d["perClass"]["B"]["correct"] == 0
    assert sorted(json.loads(r.value)["id"] for r in spark.read.text(str(tmp_path / "run" / "tickets")).collect()) == [
        "T-001", "T-002"
    ]


def test_parse_requests(spark):
    bodies = ['{"state": "s", "question": "q", "options": "A: x | B: y"}', '"k": 1}', "[1]", '{"state": "s"}']
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i long, body string")
    ok, bad = R.parse_requests(df)
    assert [r.options_text for r in ok.collect()] == ["A: x | B: y"]
    assert sorted((r.i, r.reason) for r in bad.collect()) == [(1, "invalid JSON"), (2, "not an object"), (3, "missing options")]


def facts_row(**kw):
    base = {k: None for k, _ in X.FACTS_FIELDS}
    base.update(kw)
    return base


def test_recon_rules(spark):
    from decimal import Decimal as D

    schema = "struct<" + ",".join(f"{n}:{t}" for n, t in X.FACTS_FIELDS) + ">"
    cases = [
        (facts_row(kind="recon", a=D(5), b=D(5), curA="EUR", curB="EUR", missingRef=True), "needs_review"),
        (facts_row(kind="recon", a=D(5), b=D(5), curA="EUR", curB="EUR", duplicate=True, dupVocab=True), "duplicate"),
        (facts_row(kind="recon", a=D(5), b=D(6), curA="EUR", curB="EUR", duplicate=True), "mismatch"),
        (facts_row(kind="recon", a=D(5), b=D(5), curA="EUR", curB="USD"), "mismatch"),
        (facts_row(kind="recon", a=D(5), b=D(5), curA="EUR", curB="EUR", dupVocab=True), "unique"),
        (facts_row(kind="recon", a=D(105), b=D(100), curA="EUR", curB="EUR", tolerance=D(5)), "match"),
        (facts_row(kind="recon", a=D(106), b=D(100), curA="EUR", curB="EUR", tolerance=D(5)), "mismatch"),
        (facts_row(kind="logic", value=1000.0, threshold=1000.0), "yes"),
        (facts_row(kind="logic", value=999.0, threshold=1000.0), "no"),
        (facts_row(kind="logic", value=None, threshold=1000.0), "needs_review"),
        (facts_row(kind="factual", truth="true", unknown=True), "needs_review"),
        (facts_row(kind="sentiment", sentiment="neutral"), "neutral"),
    ]
    df = spark.createDataFrame([(i, f) for i, (f, _) in enumerate(cases)], f"i int, f {schema}")
    got = [r.c for r in df.select("i", conclude(F.col("f")).alias("c")).orderBy("i").collect()]
    assert got == [c for _, c in cases]


def test_tickets_all_correct(spark):
    t = classify(X.ticket_set(Tables(spark, SF01).orders))
    wrong = t.where(~F.equal_null(F.col("label"), F.col("expected"))).count()
    assert wrong == 0
    assert t.where(F.col("variant") == "order").count() > 0


def test_duplicates_identical_rows(spark, monkeypatch):
    rows = [(1, 1, 5.0), (1, 1, 5.0), (1, 1, 5.0), (1, 1, 4.0), (2, 1, 1.0)]
    df = spark.createDataFrame(rows, "k long, n long, v double")
    d = find_duplicates(df, ["k", "n"], ["v"])
    assert sorted(tuple(r) for r in d.collect()) == [(1, 1, 5.0), (1, 1, 5.0), (1, 1, 5.0)]
    # a hot row repeated beyond the chunk size is expanded in spread chunks
    from arbiter.operators import recon

    monkeypatch.setattr(recon, "COPY_CHUNK", 2)
    hot = spark.createDataFrame([(1, 1, 5.0)] * 9 + [(3, 3, 3.0)] * 2, "k long, n long, v double")
    assert sorted(tuple(r) for r in recon.find_duplicates(hot, ["k", "n"], ["v"]).collect()) == [(1, 1, 5.0)] * 8 + [
        (3, 3, 3.0)
    ]


def test_reconcile_cases(spark):
    from arbiter.operators.recon import reconcile

    inv = spark.createDataFrame([(1, 100.0), (2, 100.0), (3, 100.0), (3, 100.0), (4, 50.0), (5, 10.0)], "k long, amt double")
    po = spark.createDataFrame(
        [(1, 60.0), (1, 40.0), (2, 115.0), (3, 100.0), (4, 55.0)] + [(6, 1.0)] * 50, "k long, amt double"
    )
    r = reconcile(inv, po, "k", "k", F.col("amt"), F.col("amt"), tolerance=0.1, relative=True)
    got = {row.ref: row.status for row in r.collect()}
    # 1 equal; 2 off by 15 > 10 % of 115; 3 duplicate invoice; 4 within 10 % of 55;
    # 5 and 6 lack the other side (6 is a hot reference on one side only)
    assert got == {1: "match", 2: "mismatch", 3: "mismatch", 4: "match", 5: "needs_review", 6: "needs_review"}


def test_leakage_hot_state_against_brute_force(spark):
    # One state carries a third of the rows, spread over all splits.
    rows = []
    for i in range(600):
        state = "HOT" if i % 3 == 0 else f"s{i % 170}"
        rows.append((i, i % 3 if i % 5 else (i // 5) % 3, state))
    df = spark.createDataFrame(rows, "rec_id long, split_rank int, state string")
    got = sorted((r.first_split, r.split, r.rec_id) for r in leakage(df).collect())
    names = ["train", "valid", "test"]
    first = {}
    for _, rank, s in rows:
        first[s] = min(first.get(s, rank), rank)
    want = sorted((names[first[s]], names[rank], i) for i, rank, s in rows if rank > first[s])
    assert got == want


def test_leakage_counts_sf001(spark):
    recs = X.doc_records(Tables(spark, SF01).documents)
    got = {(r.first_split, r.split): r.n for r in leakage_counts(leakage(recs)).collect()}
    assert got == {("train", "valid"): 10, ("train", "test"): 12, ("valid", "test"): 8}


def test_ticket_set_has_every_tag_category_and_kind(spark):
    from arbiter.operators.validate import check_tickets

    t = X.ticket_set(Tables(spark, SF01).orders)
    seen = {r.category: (set(r.tags), set(r.kinds)) for r in t.groupBy("category").agg(
        F.collect_set("tag").alias("tags"), F.collect_set("adversarial").alias("kinds")).collect()}
    assert set(seen) == {"Invoice / PO", "Reconciliation", "Triage", "Adversarial"}
    assert sum(len(tags) for tags, _ in seen.values()) == 18
    assert seen["Reconciliation"][0] == {"payment-match", "payment-mismatch", "ledger-match", "ledger-mismatch"}
    assert seen["Adversarial"] == (
        {"injection", "filler", "conflict", "missing", "reorder", "long-state"},
        {"prompt-injection", "irrelevant-info", "conflicting-evidence", "missing-info", "option-order", "evidence-at-end"},
    )
    assert all(not kinds for category, (_, kinds) in seen.items() if category != "Adversarial")
    contract = check_tickets(t, sorted(seen)).first().asDict()
    assert contract.pop("n") == t.count()
    assert set(contract.values()) == {0}


def test_leaks_of_a_repeated_id_come_once(spark):
    rows = [(1, 0, "same"), (1, 1, "same"), (1, 2, "other"), (2, 2, "same"), (2, 2, None)]
    got = leakage(spark.createDataFrame(rows, "rec_id long, split_rank int, state string")).collect()
    assert sorted(tuple(r) for r in got) == [("train", "test", 2, "same"), ("train", "valid", 1, "same")]
