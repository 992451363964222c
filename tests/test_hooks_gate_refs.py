"""Generation once a prompt (U1), the writing gate (F2), references in texts."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from arbiter.operators import generation as G
from arbiter.operators import validate as V
from arbiter.operators.references import with_references
from arbiter.sources import gate as W

# ---- U1 ------------------------------------------------------------------------------------------


def test_equal_prompts_are_generated_once(spark, tmp_path):
    log = str(tmp_path / "calls")
    os.makedirs(log)

    def factory():
        def generate(prompts):
            with open(f"{log}/{os.getpid()}", "a", encoding="utf-8") as f:
                f.writelines(p + "\n" for p in prompts)
            return [None if p == "p3" else f"Answer: {p[-1]}" for p in prompts]

        return generate

    rows = [(i, f"p{i % 7}" if i % 3 else "pA", ["A", "1", "2"]) for i in range(600)] + [(600, None, ["A"])]
    df = spark.createDataFrame(rows, "rec_id long, prompt string, labels array<string>").repartition(6)
    out = G.generated_labels(df, factory, batch=3)
    got = {r["rec_id"]: r for r in out.collect()}
    assert out.count() == 601 and len(got) == 601  # a second read generates nothing anew
    calls = [line.strip() for f in os.listdir(log) for line in open(f"{log}/{f}", encoding="utf-8")]
    assert sorted(calls) == sorted({p for _, p, _ in rows if p})
    assert (got[0]["label"], got[0]["status"]) == ("A", "extracted")
    assert got[1]["label"] == "1" and got[4]["status"] == "invalid_output"
    assert [got[i][c] for i in (10, 600) for c in ("raw", "label")] == [None] * 4
    assert got[600]["status"] == "invalid_output"


def test_generator_must_answer_every_prompt(spark):
    df = spark.createDataFrame([("a",), ("b",)], "prompt string")
    with pytest.raises(Exception, match="texts"):
        G.with_generator(df, lambda: lambda prompts: []).count()
    assert G.with_generator(df.where("false"), G.phrase_stub_factory).count() == 0


# ---- F2 ------------------------------------------------------------------------------------------

GOOD = '{"state":"s é","question":"q","options":[{"label":"A","key":"k","description":"d"},{"label":"B","key":"l","description":"e"}],"answer":"A"}'


def bodies(spark, rows):
    return V.parse_records(spark.createDataFrame(rows, "rec_id long, split string, body string"))


def test_gate_publishes_right_records_only(spark, tmp_path):
    count = F.size(V.violations_expr(F.col("v")))
    path = str(tmp_path / "out")
    right = [(i, ("train", "valid", "test")[i % 3], GOOD) for i in range(30)]
    wrong = right + [(30, "valid", GOOD.replace('"A"}', '"Z"}')), (31, "valid", "{"), (32, None, "[]")]
    with pytest.raises(W.GateClosed, match="valid: 2 error") as e:
        W.write_checked(bodies(spark, wrong), count, path, columns=["rec_id", "body"])
    assert e.value.counts["train"] == 0 and e.value.counts["valid"] == 2 and e.value.counts["other"] > 0
    assert os.listdir(tmp_path) == []
    assert set(W.write_checked(bodies(spark, right), count, path, columns=["rec_id", "body"]).values()) == {0}
    assert sorted(r["rec_id"] for r in spark.read.json(path).collect()) == list(range(30))
    assert sorted(f for f in os.listdir(tmp_path)) == ["out"]
    with pytest.raises(FileExistsError):
        W.write_checked(bodies(spark, right), count, path)
    rows, _ = W.observed(bodies(spark, right), F.lit(0), "split", W.SPLITS)
    plan = rows._jdf.queryExecution().toString()
    assert "CollectMetrics" in plan and plan.split("Physical Plan")[-1].count("Scan") <= 1


# ---- D7 ------------------------------------------------------------------------------------------


def test_references_of_hand_written_texts(spark):
    texts = [
        "We settled inv-0042 today with PAY-7; your order PO-9 is still open. INV-43 follows.",
        "See PO-12/INV-5, not PO-13.",
        "RE: (PAY-100) — Überweisung für INV-8é und INV-9",
        "XINV-1 INV-2x INV- 3 PO12 pay-5-6 INV_4",
        "", None, "PO-1PO-2 PO-3",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, state string")
    got = {r["i"]: r for r in with_references(df).collect()}
    refs = lambda i: [(r["kind"], r["number"], r["ref"]) for r in got[i]["refs"]]
    assert refs(0) == [("INV", "0042", "INV-0042"), ("PAY", "7", "PAY-7"), ("PO", "9", "PO-9"), ("INV", "43", "INV-43")]
    assert (got[0]["invoice_ref"], got[0]["po_ref"], got[0]["payment_ref"]) == ("INV-0042", "PO-9", "PAY-7")
    assert [r[2] for r in refs(1)] == ["PO-12", "INV-5", "PO-13"] and got[1]["payment_ref"] is None
    assert got[2]["payment_ref"] == "PAY-100" and "INV-9" in [r[2] for r in refs(2)]
    assert refs(3) == [] and refs(4) == [] and got[5]["refs"] is None and got[5]["invoice_ref"] is None
    assert [r[2] for r in refs(6)] == ["PO-3"]
    for i, t in enumerate(texts):
        for r in got[i]["refs"] or []:
            assert t[r["pos"] : r["pos"] + len(r["ref"])].upper() == r["ref"]
