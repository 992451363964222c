"""Runs with state (T3), running statistics (T2), failing lines (S1), the document sink (S5), splits."""

from __future__ import annotations

import collections
import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from arbiter.operators import metrics as M
from arbiter.operators import selection as SE
from arbiter.sources import document as D
from arbiter.sources import lines as L
from arbiter.sources.records import RECORD_SCHEMA
from arbiter.streaming import running as RS
from arbiter.streaming.runs import TicketRun

# ---- T3 ------------------------------------------------------------------------------------------


def plain_score(df):
    return df.select("id", F.lit("x").alias("expected"), F.lit(None).cast("string").alias("conclusion"), "label", F.lit("ok").alias("status"))


@pytest.fixture
def arrivals(spark, tmp_path):
    source = str(tmp_path / "in")
    os.makedirs(source)

    def arrive(name, ids):
        rows = [(None if i is None else f"T-{i}", f"L{name}") for i in ids]
        spark.createDataFrame(rows, "id string, label string").write.parquet(f"{source}/part={name}")

    return source, "id string, label string", arrive


def test_run_stops_continues_and_resets(spark, tmp_path, arrivals):
    source, schema, arrive = arrivals
    run = TicketRun(spark, str(tmp_path / "run"), plain_score)
    assert run.results().count() == 0
    arrive(0, [*range(50), 3, 3, None])
    run.start(source, schema).awaitTermination()
    arrive(1, range(40, 80))
    run = TicketRun(spark, str(tmp_path / "run"), plain_score)  # another driver continues
    run.start(source, schema, files_per_trigger=1).awaitTermination()
    got = collections.Counter(r["id"] for r in run.results().collect())
    assert len(got) == 81 and set(got.values()) == {1}
    assert run.state().count() == 81
    assert {r["id"]: r["label"] for r in run.results().collect()}["T-45"] == "L0"
    run.reset()
    assert run.number == 1 and run.results().count() == 0
    run.start(source, schema).awaitTermination()
    assert run.results().count() == 81 == run.results().select("id").distinct().count()


def test_replayed_batch_adds_nothing(spark, tmp_path, arrivals):
    source, schema, arrive = arrivals
    run = TicketRun(spark, str(tmp_path / "run"), plain_score)
    for k in range(2):
        arrive(k, range(30 * k, 30 * k + 30))
        run.start(source, schema).awaitTermination()
    log = f"{run.checkpoint_dir}/commits"
    last = max((f for f in os.listdir(log) if f.isdigit()), key=int)
    for f in (last, f".{last}.crc"):  # the driver died before this batch was marked as done
        if os.path.exists(f"{log}/{f}"):
            os.remove(f"{log}/{f}")
    arrive(2, range(55, 70))
    run.start(source, schema).awaitTermination()
    ids = [r["id"] for r in run.results().collect()]
    assert len(ids) == len(set(ids)) == 70


def test_run_plan_reads_no_results(spark, tmp_path, arrivals):
    source, schema, arrive = arrivals
    arrive(0, range(5))
    run = TicketRun(spark, str(tmp_path / "run"), plain_score)
    query = run.start(source, schema)
    query.awaitTermination()
    plan = query._jsq.explainInternal(False)
    assert "StreamingDeduplicate" in plan and plan.count("FileScan") == 1 and "Join" not in plan
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != run.session.conf.get(
        "spark.sql.streaming.stateStore.providerClass"
    )


# ---- T2 ------------------------------------------------------------------------------------------

RESULTS = "expected string, label string, latency_ms double, client_ms double, ts timestamp"


def result_rows(n, seed=1):
    rnd, t0 = random.Random(seed), datetime.datetime(2026, 1, 1)
    latency = lambda: rnd.choice([rnd.lognormvariate(2, 2), 7.0, round(rnd.uniform(0, 3), 2), 0.0, None, 0.0004])
    rows = []
    for i in range(n):
        v = latency()
        client = None if i % 7 == 0 else (v or 0) + rnd.uniform(-1, 2)
        rows.append((rnd.choice(["A", "B", "C", None]), rnd.choice(["A", "B", None]), v, client, t0 + datetime.timedelta(seconds=i)))
    return rows


def test_sketch_holds_the_exact_quantiles(spark):
    for n in (1, 2, 19, 400, 3001):
        df = spark.createDataFrame(result_rows(n, n), RESULTS)
        values = sorted(0.0 if r["latency_ms"] is None else r["latency_ms"] for r in df.collect())
        s = RS.run_stats(RS.run_cells(df)).first()
        for name, p in (("p50", 0.5), ("p95", 0.95)):
            exact = values[min(n - 1, int(p * n))]
            assert abs(s[f"{name}_ms"] - exact) <= s[f"{name}_error"] + 1e-12
            assert s[f"{name}_error"] <= max(0.001, 0.0051 * exact)
        assert s["done"] == n and s["max_ms"] == values[-1]
        assert abs(s["avg_ms"] - sum(values) / n) < 1e-6


def test_running_stats_equal_the_batch_after_every_wave(spark, tmp_path):
    source, stats, ckpt = (str(tmp_path / n) for n in ("in", "stats", "ckpt"))
    rows, seen = result_rows(900), []
    for w in range(3):
        part = rows[300 * w : 300 * w + 300]
        seen += part
        spark.createDataFrame(part, RESULTS).write.parquet(f"{source}/w={w}")
        RS.run_stats_stream(spark.readStream.schema(RESULTS).parquet(source), stats, ckpt).awaitTermination()
        running = RS.newest(RS.snapshots(spark, stats))
        batch = spark.createDataFrame(seen, RESULTS)
        assert RS.run_stats(running).first() == RS.run_stats(RS.run_cells(batch)).first()
        head = M.headline(M.cells(batch)).first()
        assert [RS.run_stats(running).first()[c] for c in ("done", "correct", "invalid")] == [head.n, head.correct, head.invalid_count]
        classes = lambda df: sorted(map(tuple, df.collect()))
        assert classes(RS.class_stats(running)) == classes(M.per_class(M.cells(batch)))
        most = running.count()
    assert most <= 4 * 3 * 2000


def test_sketch_of_no_results_and_out_of_range_values(spark):
    s = RS.run_stats(RS.run_cells(spark.createDataFrame([], RESULTS))).first()
    assert (s["done"], s["correct"], s["invalid"], s["avg_ms"], s["throughput"]) == (0, 0, 0, 0.0, 0.0)
    odd = spark.createDataFrame([("A", "A", v, None, None) for v in (-5.0, 1e9, 1e12)], RESULTS)
    s = RS.run_stats(RS.run_cells(odd)).first()
    assert s["p95_error"] is None and s["max_ms"] == 1e12 and s["net_avg_ms"] == 0.0


# ---- S1 ------------------------------------------------------------------------------------------


def lines_in(folder, files):
    os.makedirs(folder)
    want = []
    for name, text in sorted(files.items()):
        with open(f"{folder}/{name}", "w", encoding="utf-8", newline="") as f:
            f.write(text)
        with open(f"{folder}/{name}", encoding="utf-8") as f:
            for no, line in enumerate(f, 1):
                if line.strip():
                    try:
                        json.loads(line)
                    except ValueError:
                        want.append((name, no))
    return want


@pytest.mark.parametrize("split", ["64", "700", "128m"])
def test_wrong_lines_in_small_splits(spark, tmp_path, split):
    rnd = random.Random(2)
    record = lambda i: json.dumps({"rec_id": i, "state": "é" * rnd.randint(0, 60), "question": "q", "options": [], "answer": "A"}, ensure_ascii=False)
    files = {}
    for k in range(4):
        body = []
        for i in range(120):
            kind = rnd.random()
            body.append("" if kind < 0.1 else "  " if kind < 0.15 else record(i)[:-4] if kind < 0.2 else record(i))
        files[f"f{k}.jsonl"] = ("\r\n" if k == 2 else "\n").join(body) + ("\n" if k % 2 else "")
    files["empty.jsonl"] = ""
    files["right.jsonl"] = record(1)
    want = lines_in(tmp_path / "d", files)
    s = spark.newSession()
    s.conf.set("spark.sql.files.maxPartitionBytes", split)
    s.conf.set("spark.sql.files.openCostInBytes", "1")
    path = str(tmp_path / "d")
    assert s.read.text(path).rdd.getNumPartitions() > (20 if split == "64" else 0)
    got = [(r["file"].rsplit("/", 1)[1], r["line"]) for r in L.wrong_lines(s, path).collect()]
    assert sorted(got) == sorted(want) and len(want) > 10
    file, line = L.first_wrong_line(s, path)
    assert (file.rsplit("/", 1)[1], line) == want[0]
    with pytest.raises(L.BadLine, match=rf"{want[0][0]}:{want[0][1]}: invalid JSON"):
        L.load_records(s, path)


def test_right_files_load(spark, tmp_path):
    lines_in(tmp_path / "d", {"a.jsonl": '{"rec_id":1,"state":"s","answer":"A"}\n\n{"rec_id":2}\n'})
    got = L.load_records(spark, str(tmp_path / "d"))
    assert sorted(r["rec_id"] for r in got.collect()) == [1, 2]
    assert got.schema.simpleString() == spark.createDataFrame([], RECORD_SCHEMA).schema.simpleString()


# ---- S5 ------------------------------------------------------------------------------------------


def joined(path):
    return "".join(open(f"{path}/{f}", encoding="utf-8").read() for f in sorted(os.listdir(path)) if not f.startswith("."))


@pytest.mark.parametrize("n", [0, 1, 500])
def test_document_is_one_json_text_in_order(spark, tmp_path, n):
    rows = spark.createDataFrame([(i, json.dumps({"id": i, "t": "é\n"})) for i in range(n)], "id long, line string").repartition(7)
    path = str(tmp_path / "doc")
    D.write_document(rows, ["id"], "line", path, '{"a":1,\n"rows":[', "]}")
    assert json.loads(joined(path)) == {"a": 1, "rows": [{"id": i, "t": "é\n"} for i in range(n)]}
    assert [f for f in os.listdir(tmp_path) if "staging" in f] == []
    with pytest.raises(Exception, match="doc"):
        D.write_document(rows, ["id"], "line", path, "[", "]")
    D.write_document(rows, ["id"], "line", path, "[", "]", overwrite=True)
    assert len(json.loads(joined(path))) == n


def test_failed_document_leaves_nothing(spark, tmp_path):
    rows = spark.range(400).select("id", F.when(F.col("id") == 399, F.raise_error(F.lit("boom"))).otherwise(F.lit("1")).alias("line"))
    with pytest.raises(Exception, match="boom"):
        D.write_document(rows, ["id"], "line", str(tmp_path / "doc"), "[", "]")
    assert os.listdir(tmp_path) == []


# ---- G4 ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("small", [1, 5, 10_000])
def test_cut_points_take_exactly_the_first_rows(spark, small):
    rnd = random.Random(small)
    rows = [(rnd.getrandbits(60) >> rnd.choice([0, 0, 30]), i) for i in range(600)] + [(5 << 40, 1000 + i) for i in range(20)]
    df = spark.createDataFrame(rows, "h long, key long")
    counts = [0, 1, 17, 300, 599, 620]
    cuts = SE.cut_points(df, counts, small=max(small, 21))
    for c, cut in zip(counts, cuts):
        assert sorted(map(tuple, df.where(SE.upto(cut)).collect())) == sorted(rows)[:c]
    with pytest.raises(ValueError):
        SE.cut_points(df, [621])


def test_family_counts_and_bases():
    assert [SE.family_counts(n) for n in (120, 30, 60)] == [(70, 50), (17, 13), (35, 25)]
    assert [SE.family_counts(n)[0] for n in (0, 1, 50, 150)] == [0, 1, 29, 87]
    assert list(SE.id_bases({"train": 120, "valid": 30, "test": 60}).values()) == [1000, 2000, 3000]
    assert list(SE.id_bases({"train": 4000, "valid": 30}).values()) == [10_000, 20_000]


def test_splits_are_exact_and_disjoint(spark):
    rec = lambda n, w: spark.range(n).selectExpr(
        "id AS rec_id", f"concat('{w} ', id) AS state", "'q' AS question",
        "array(named_struct('label', 'A', 'key', 'k', 'description', 'd')) AS options", "'A' AS answer",
    )
    sizes = {"train": 120, "valid": 30, "test": 60}
    s = SE.build_splits(("finance", rec(400, "f")), ("general", rec(90, "g")), sizes, small=16).collect()
    by = collections.Counter((r["split"], r["family"]) for r in s)
    assert by == {("train", "finance"): 70, ("train", "general"): 50, ("valid", "finance"): 17, ("valid", "general"): 13,
                  ("test", "finance"): 35, ("test", "general"): 25}
    assert len({r["state"] for r in s}) == 210
    for k, (split, n) in enumerate(sizes.items()):
        own = [r for r in s if r["split"] == split]
        assert sorted(r["shuffle_pos"] for r in own) == list(range(n))
        for family in ("finance", "general"):
            ids = sorted(r["id"] for r in own if r["family"] == family)
            assert ids == list(range(1000 * (k + 1), 1000 * (k + 1) + by[split, family]))
    first = [r["family"] for r in sorted(s, key=lambda r: (r["split"], r["shuffle_pos"])) if r["split"] == "train"]
    assert {"finance", "general"} == set(first[:20])  # shuffled, not one family after the other
