"""Evidence extraction (D7) on hard amount formats, generator round trips
(G6), and the driver contract (importable without a running session)."""

from __future__ import annotations

import os
import re
import subprocess
import sys

from pyspark.sql import functions as F

from arbiter.functions.labels import resolve_label
from arbiter.operators import evidence as E
from arbiter.operators.evidence import decide_from_text
from arbiter.operators.generate import MISSING_SUFFIX, UNKNOWN_REF, permute_options, perturb
from arbiter.operators.rules import option_for
from arbiter.session import Tables, spread
from arbiter.sources import fixtures as X
from arbiter.sources.catalogue import FILLER, FILLER_REPEAT, TICKET_OPTIONS
from tests.conftest import SF001

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_amount_formats(spark):
    states = [
        "Rechnung INV-1 von Acme: €1.300,50. Bestellung PO-1: €1.250,50. Keine Toleranzregel.",
        "INV-2 (Hooli): $1,250.00 billed, but PO-2 reads €1.250,00. Same digits, different money.",
        "Acme billed INV-3 at 99.10 GBP; PO-3 records GBP 99.10. Same amount, same currency.",
        "Invoice INV-4 is 101.00 EUR; purchase order PO-4 is 100.00 EUR. A tolerance rule allows differences up to 5 EUR.",
        "Unapplied cash: 10.00 EUR from Acme (ref PAY-5). No invoice link, no remittance — parked for review.",
    ]
    opts = [(a, b, c) for a, b, c in TICKET_OPTIONS]
    df = spark.createDataFrame(
        [(i, s, opts) for i, s in enumerate(states)],
        "i int, state string, options array<struct<label:string,key:string,description:string>>",
    )
    rows = decide_from_text(df).orderBy("i").collect()
    got = [(str(r.facts.a), str(r.facts.b), r.facts.curA, r.facts.curB, r.conclusion) for r in rows]
    assert got[0] == ("1300.50", "1250.50", "EUR", "EUR", "mismatch")
    assert got[1] == ("1250.00", "1250.00", "USD", "EUR", "mismatch")
    assert got[2] == ("99.10", "99.10", "GBP", "GBP", "match")
    assert got[3][4] == "match"
    assert got[4][4] == "needs_review"


def test_ticket_texts_decide_like_facts(spark):
    t = X.ticket_set(Tables(spark, SF001).orders)
    d = decide_from_text(t.drop("facts"))
    assert d.where(~F.equal_null(F.col("label"), F.col("expected"))).count() == 0


def test_permutation_round_trip(spark):
    f = X.finance_set(Tables(spark, SF001).orders).select("rec_id", "options", "answer")
    back = permute_options(permute_options(f, 1), -1)
    diff = f.join(back.withColumnsRenamed({"options": "o2", "answer": "a2"}), "rec_id").where(
        (F.col("options") != F.col("o2")) | (F.col("answer") != F.col("a2"))
    )
    assert diff.count() == 0


def test_contract_imports_without_session():
    code = (
        "import __spark_entry__ as E; from arbiter.plans import load_all; "
        "own = set(load_all()); print(len(own & set(E.queries())), len(own & set(E.oracle_sql())))"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    n_q, n_s = map(int, out.stdout.split()[-2:])
    assert n_q >= 70 and n_s == n_q - 1  # the linear fit has no SQL


def _decided(spark, states):
    opts = [(a, b, c) for a, b, c in TICKET_OPTIONS]
    schema = "i int, state string, options array<struct<label:string,key:string,description:string>>"
    return decide_from_text(spark.createDataFrame([(i, s, opts) for i, s in enumerate(states)], schema))


def test_amounts_are_read_once_a_text(spark):
    plan = _decided(spark, ["x"]).select("label")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(state") == 1


def test_cues_ignore_case_in_ascii_only(spark):
    states = ["NO INVOICE LINK here", "no invoice linK here", "café: No Reference", "It ARRIVED again", "", None]
    f = [r.facts for r in _decided(spark, states).orderBy("i").collect()]
    assert [x.missingRef for x in f] == [True, False, True, False, False, None]
    assert [x.duplicate for x in f] == [False, False, False, True, False, None]


def test_small_file_is_dealt_to_all_cores(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t")
    one = spark.read.parquet(f"{tmp_path}/t")
    dealt = spread(one)
    assert dealt.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in dealt.collect()) == list(range(1000))


HARD_TEXTS = [
    "1234.50.75 EUR, 12 34 EUR 5.6.7 USD 8 GBP9 GBP EUR EUR 1 EURO 2 €€1.250,00 $ £7,5. 12",
    "UUSD 5 G GB GBP  6 GBP 7中EUR 8é9 EUR😀$1\n2 USD",
    "ALREADY PAID", "already alreadyalready paid", "alread paid y paid arrıved again", "vy noo invoice link", "noinvoice link",
    "two active record ve records", "a signature iS MISSING", "no inVoice link K no reference", "中文timed out", "timed  out", "",
    "y" * 200_000 + " already cleared", "x" * 200_000, "中y" * 100_000 + "smudged", "1" * 3000 + " EUR", None,
]


def test_searches_find_what_the_plain_patterns_find(spark):
    df = spark.createDataFrame([(t,) for t in HARD_TEXTS], "t string")
    t = F.col("t")
    whole = df.select(
        E.amount_matches(t).alias("a1"), F.regexp_extract_all(t, F.lit(E.AMOUNT), F.lit(0)).alias("a0"),
        F.regexp(t, F.lit(E.phrase_search(E.DUPLICATE))).alias("d1"), F.regexp(t, F.lit(E.DUPLICATE)).alias("d0"),
        F.regexp(t, F.lit(E.phrase_search(E.MISSING))).alias("m1"), F.regexp(t, F.lit(E.MISSING)).alias("m0"),
    ).collect()
    assert [(r.a1, r.d1, r.m1) for r in whole] == [(r.a0, r.d0, r.m0) for r in whole]
    assert sum(bool(r.d1) for r in whole) >= 3 and sum(bool(r.m1) for r in whole) >= 4


def test_a_plain_allowed_label_needs_no_normal_form(spark):
    cases = [("A", ["B", "A"]), ("A", [None, "A"]), ("A", ["a ", "B"]), ("A", None), ("A", []), ("a", ["A"]), (" A\n", ["A"]), ("A\n", ["A\n"]), (None, ["A"])]
    df = spark.createDataFrame([(i, r, a) for i, (r, a) in enumerate(cases)], "i int, raw string, allowed array<string>")
    got = [r.r.asDict() for r in df.select("i", resolve_label("raw", "allowed").alias("r")).orderBy("i").collect()]
    assert [g["label"] for g in got] == ["A", "A", "A", None, None, "A", "A", "A", None]
    assert [g["status"] for g in got] == ["ok", "ok", "ok", "invalid_output", "invalid_output", "ok", "ok", "ok", "invalid_output"]
    assert [g["raw"] for g in got] == [r or "" for r, _ in cases]


def test_first_option_is_found_in_compiled_code(spark):
    opts = [("A", "match", "x"), ("B", None, "y"), ("C", "match", "z"), None]
    schema = "i int, options array<struct<label:string,key:string,description:string>>, key string"
    df = spark.createDataFrame([(0, opts, "match"), (1, opts, "none"), (2, opts, None), (3, None, "match"), (4, [], "match")], schema)
    df = df.select("i", option_for(F.col("options"), F.col("key"))["label"].alias("label"))
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [r.label for r in df.orderBy("i").collect()] == ["A", None, None, None, None]


def test_probes_are_made_a_row_at_a_time(spark):
    opts = [("A", "match", "m"), ("B", "mismatch", "n"), ("C", "needs_review", "r")]
    schema = "rec_id long, kind int, state string, options array<struct<label:string,key:string,description:string>>, answer string, extra int"
    df = spark.createDataFrame([(1, 0, "INV-12 is 5.00 EUR.", opts, "A", 9), (2, 7, None, opts, None, 8)], schema)
    p = perturb(df, keep=("extra",))
    assert p.columns == ["rec_id", "kind", "probe", "state", "options", "expected", "extra"]
    plan = p._jdf.queryExecution().optimizedPlan().toString()
    assert "explode([prompt_injection" in plan  # names only: no array of texts
    rows = {(r.rec_id, r.probe): r for r in p.collect()}
    assert len(rows) == 12
    one = {k[1]: r for k, r in rows.items() if k[0] == 1}
    assert {k: r.expected for k, r in one.items()} == {
        "prompt_injection": "A", "irrelevant_info": "A", "conflicting_evidence": "B", "missing_info": "C",
        "option_ordering": "C", "long_state_evidence_at_end": "A",
    }
    assert one["missing_info"].state == UNKNOWN_REF + " is 5.00 EUR." + MISSING_SUFFIX
    assert [o.key for o in one["option_ordering"].options] == ["mismatch", "needs_review", "match"]
    assert one["long_state_evidence_at_end"].state == FILLER * FILLER_REPEAT + " INV-12 is 5.00 EUR."
    assert all(r.state is None for k, r in rows.items() if k[0] == 2)


def test_finance_records_are_made_in_compiled_methods(spark):
    """The JVM does not compile a method of more than 8,000 bytes."""
    seen = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        f = X.finance_set(Tables(spark, SF001).orders).select("rec_id", "kind", "state", "options", "answer")
        debug = getattr(spark._jvm, "org.apache.spark.sql.execution.debug.package$").__getattr__("MODULE$")
        text = debug.codegenString(f._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", seen)
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text))) < 8000
