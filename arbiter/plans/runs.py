"""Runs as they happen: resumable scoring (T3), running statistics (T2), failing lines (S1), the export
document (S5), exact splits (G4), generation (U1), the writing gate (F2) and references (D7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from arbiter.functions.json import parse_json
from arbiter.functions.options import format_options
from arbiter.functions.prompts import render_prompt
from arbiter.functions.subquery import row_value
from arbiter.functions.text import sql_str
from arbiter.operators import generation as G
from arbiter.operators import metrics as M
from arbiter.operators import validate as V
from arbiter.operators.references import ROLES, with_references
from arbiter.operators.selection import build_splits, family_counts, id_bases
from arbiter.plans import oracle_fixtures as O
from arbiter.plans.decisions import _resolve_sql, _tickets_decided_sql
from arbiter.plans.evaluation import _joined_sql, _quantile_sql, results
from arbiter.plans.records import _violations_sql
from arbiter.plans.registry import query
from arbiter.session import Tables, staged
from arbiter.sources import document as D
from arbiter.sources import fixtures as X
from arbiter.sources import gate as W
from arbiter.sources import lines as L
from arbiter.sources.records import scratch_path
from arbiter.streaming import running as RS
from arbiter.streaming.runs import TicketRun

# ---- T3 ------------------------------------------------------------------------------------------


@query(
    "t3_reset_run",
    sql=lambda: f"""WITH d AS ({_tickets_decided_sql()})
      SELECT 0 AS run, count(*) AS n, count(DISTINCT id) AS ids, count(*) FILTER (WHERE label = expected) AS correct
      FROM d WHERE rec_id % 2 = 0
      UNION ALL SELECT 1, count(*), count(DISTINCT id), count(*) FILTER (WHERE label = expected) FROM d""",
)
def t3_reset_run(spark, sf_dir):
    """A run that is stopped after half of the tickets, then reset; the new run scores all of them.

    Both halves arrive twice, so results equal the batch only if no id is scored twice in a run."""
    tk = X.ticket_set(Tables(spark, sf_dir).orders)
    source, out = scratch_path(spark, "t3-in"), []
    run = TicketRun(spark, scratch_path(spark, "t3-run"))
    half = tk.where(F.col("rec_id") % 2 == 0)

    def summary():
        one = run.results().agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"),
            F.count(F.when(F.col("label") == F.col("expected"), 1)).alias("correct"),
        )
        return one.select(F.lit(run.number).alias("run"), "n", "ids", "correct")

    half.write.parquet(f"{source}/part=0")
    run.start(source, tk.schema).awaitTermination()
    half.write.parquet(f"{source}/part=1")
    run.start(source, tk.schema).awaitTermination()
    out.append(summary())
    run.reset()
    tk.write.parquet(f"{source}/part=2")
    run.start(source, tk.schema).awaitTermination()
    out.append(summary())
    return out[0].unionByName(out[1])


# ---- T2 ------------------------------------------------------------------------------------------

RESULT_COLS = ["expected", "label", "latency_ms", "client_ms", "ts"]
WAVES = 3


def scored_results(spark, sf_dir):
    """Results with the label their ticket should get."""
    tk = X.ticket_set(Tables(spark, sf_dir).orders).select("id", "expected")
    return results(spark, sf_dir).join(tk, "id")


def _waves_sql() -> str:
    return f"""SELECT w.wave, r.* FROM (SELECT unnest(range({WAVES})) AS wave) w
      JOIN ({_joined_sql()}) r ON r.status IS NOT NULL AND CAST(substr(r.id, 3) AS BIGINT) % {WAVES} <= w.wave"""


def _bin_sql(v: str) -> str:
    whens = [f"WHEN {v} < CAST(1e{RS.LOW} AS DOUBLE) THEN 0"]
    for k, e in enumerate(range(RS.LOW, RS.HIGH)):
        digits = f"least(greatest(floor({v} / CAST(1e{e - 2} AS DOUBLE)), 100), 999)"
        whens.append(f"WHEN {v} < CAST(1e{e + 1} AS DOUBLE) THEN {1000 * (k + 1)} + {digits}")
    return f"CASE {' '.join(whens)} ELSE {RS.LAST} END"


def _bin_value_sql(b: str) -> tuple[str, str]:
    step = f"pow(10.0, floor({b} / 1000) - 1 + {RS.LOW - 2})"
    return f"CASE WHEN {b} = 0 THEN 0.0 ELSE ({b} % 1000 + 0.5) * {step} END", f"CASE WHEN {b} = 0 THEN 1e{RS.LOW} ELSE {step} / 2 END"


def _running_sql() -> str:
    b, rank = _bin_sql("latency_ms"), "row_number() OVER (PARTITION BY wave ORDER BY latency_ms) - 1"

    def at(p):
        bin_ = f"max(CASE WHEN rn = least(n - 1, floor(n * CAST({p} AS DOUBLE))) THEN b END)"
        return [f"round({x}, 6)" for x in _bin_value_sql(bin_)]

    (p50, e50), (p95, e95) = at(0.5), at(0.95)
    return f"""WITH r AS ({_waves_sql()}),
      q AS (SELECT *, {b} AS b, {rank} AS rn, count(*) OVER (PARTITION BY wave) AS n FROM r)
      SELECT CAST(wave AS INTEGER) AS wave, count(*) AS done, count(*) FILTER (WHERE label = expected) AS correct,
        count(*) FILTER (WHERE label IS NULL) AS invalid,
        round(count(*) FILTER (WHERE label = expected) / count(*), 6) AS accuracy, round(avg(latency_ms), 4) AS avg_ms,
        {p50} AS p50_ms, {e50} AS p50_error, {p95} AS p95_ms, {e95} AS p95_error, max(latency_ms) AS max_ms,
        round(avg(greatest(0.0, client_ms - latency_ms)), 4) AS net_avg_ms,
        round(epoch(max(ts)) - epoch(min(ts)), 3) AS secs
      FROM q GROUP BY wave"""


def _arrived(spark, sf_dir):
    """Write results in waves and drain the stream after each; returns the folder of snapshots."""
    r = scored_results(spark, sf_dir).withColumn("wave", F.substring("id", 3, 30).cast("long") % WAVES)
    source, stats, ckpt = (scratch_path(spark, f"t2-{n}") for n in ("in", "stats", "ckpt"))
    schema = r.select(*RESULT_COLS).schema
    for w in range(WAVES):
        r.where(F.col("wave") == w).select(*RESULT_COLS).write.parquet(f"{source}/wave={w}")
        stream = spark.readStream.schema(schema).parquet(source)
        RS.run_stats_stream(stream, f"{stats}/wave={w}", ckpt).awaitTermination()
    return stats


@query("t2_running_stats", sql=_running_sql)
def t2_running_stats(spark, sf_dir):
    """The run's numbers after each wave of results: counts, average and maximum exact, p50 and p95
    from the sketch with the error they may have."""
    stats, out = _arrived(spark, sf_dir), []
    for w in range(WAVES):
        s = RS.run_stats(RS.newest(RS.snapshots(spark, f"{stats}/wave={w}")))
        out.append(
            s.select(
                F.lit(w).alias("wave"), "done", "correct", "invalid", F.round("accuracy", 6).alias("accuracy"),
                F.round("avg_ms", 4).alias("avg_ms"),
                *[F.round(c, 6).alias(c) for c in ("p50_ms", "p50_error", "p95_ms", "p95_error")],
                "max_ms", F.round("net_avg_ms", 4).alias("net_avg_ms"), F.round("secs", 3).alias("secs"),
            )
        )
    return reduce(lambda a, b: a.unionByName(b), out)


@query(
    "t2_running_classes",
    sql=lambda: f"""SELECT CAST(wave AS INTEGER) AS wave, expected, count(*) AS n, count(*) FILTER (WHERE label = expected) AS correct,
        count(*) FILTER (WHERE label = expected) / count(*) AS accuracy
      FROM ({_waves_sql()}) WHERE expected IS NOT NULL GROUP BY 1, 2""",
)
def t2_running_classes(spark, sf_dir):
    """Recall per class after each wave of results."""
    stats = _arrived(spark, sf_dir)
    each = [
        RS.class_stats(RS.newest(RS.snapshots(spark, f"{stats}/wave={w}"))).withColumn("wave", F.lit(w)) for w in range(WAVES)
    ]
    return reduce(lambda a, b: a.unionByName(b), each).select("wave", "expected", "n", "correct", "accuracy")


# ---- S1 ------------------------------------------------------------------------------------------

#: Records of one file, by id; every BROKEN-th record is cut short, every BLANK-th is followed by a blank line.
IDS_PER_FILE, BROKEN, BLANK = 8_192, 997, 13


@query(
    "s1_wrong_lines",
    sql=lambda: f"""WITH r AS (SELECT rec_id, rec_id // {IDS_PER_FILE} AS file FROM ({O.finance_set()})),
      p AS (SELECT *, row_number() OVER w AS k, count(*) FILTER (WHERE rec_id % {BLANK} = 0) OVER w
                - CASE WHEN rec_id % {BLANK} = 0 THEN 1 ELSE 0 END AS blanks
            FROM r WINDOW w AS (PARTITION BY file ORDER BY rec_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
      SELECT file, k + blanks AS line, '{L.REASON}' AS reason FROM p WHERE rec_id % {BROKEN} = 0""",
)
def s1_wrong_lines(spark, sf_dir):
    """File and line of every wrong line, over many files that are read in splits smaller than a file."""
    f = X.finance_set(Tables(spark, sf_dir).orders).select("rec_id", "state", "question", "options", "answer")
    text = F.to_json(F.struct(*f.columns))
    text = F.when(F.col("rec_id") % BROKEN == 0, F.substring(text, 1, 60)).otherwise(text)
    text = F.when(F.col("rec_id") % BLANK == 0, F.concat(text, F.lit("\n  "))).otherwise(text)
    path = scratch_path(spark, "s1-lines")
    # One file a folder, in id order: the line numbers are those of the ids.
    rows = f.select("rec_id", F.floor(F.col("rec_id") / IDS_PER_FILE).cast("long").alias("file"), text.alias("value"))
    rows.repartition("file").sortWithinPartitions("file", "rec_id").drop("rec_id").write.partitionBy("file").text(path)
    small = spark.newSession()  # its split size does not reach the caller's queries
    small.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    found = L.wrong_lines(small, path)
    return found.select(F.regexp_extract("file", r"/file=(\d+)/", 1).cast("long").alias("file"), "line", "reason")


# ---- S5 ------------------------------------------------------------------------------------------


def export_document(spark, sf_dir, path: str) -> None:
    """Write the export of a run: {summary, perClass, tickets}, tickets in id order."""
    tk = X.ticket_set(Tables(spark, sf_dir).orders)
    tag = F.coalesce("variant", "adversarial", "tag").alias("tag")
    j = results(spark, sf_dir).join(tk.select("id", "expected", "category", tag), "id")
    cells = staged(RS.run_cells(j), "s5-cells")  # one pass over the run; the rest reads this small table
    s = row_value(RS.run_stats(cells))
    p95 = row_value(M.latency_stats(j, [], "latency_ms").select("p95"))["p95"]
    summary = F.struct(
        s["done"].alias("done"), s["correct"].alias("correct"), s["invalid"].alias("invalid"),
        F.round(s["accuracy"], 4).alias("accuracy"), F.round(s["invalid_rate"], 4).alias("invalidRate"),
        F.round(s["avg_ms"], 4).alias("engineAvgMs"), F.round(p95, 4).alias("engineP95Ms"),
        F.round(s["net_avg_ms"], 3).alias("roundTripAvgMs"), F.round(s["throughput"], 2).alias("throughputPerSec"),
    )
    one = F.struct("n", "correct", F.round("accuracy", 4).alias("accuracy"))
    classes = RS.class_stats(cells).agg(  # a row per class
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("expected", one)))).alias("c")
    )
    head = spark.range(1).select(F.to_json(summary).alias("s"), F.to_json(row_value(classes)["c"]).alias("c")).first()
    ticket = F.struct(
        "id", "category", "tag", "expected", F.col("label").alias("got"), "status",
        F.round("latency_ms", 3).alias("engineMs"),
    )
    lines = j.select("id", F.to_json(ticket, {"ignoreNullFields": "false"}).alias("line"))
    D.write_document(lines, ["id"], "line", path, f'{{"summary":{head["s"]},\n"perClass":{head["c"]},\n"tickets":[', "]}")


@query(
    "s5_document",
    sql=lambda: f"""WITH r AS (SELECT * FROM ({_joined_sql()}) WHERE status IS NOT NULL),
      q AS ({_quantile_sql("SELECT 'run' AS run, latency_ms FROM r", 'run', 'latency_ms')})
      SELECT 'summary' AS section, NULL AS key, NULL AS category, NULL AS tag, NULL AS got, count(*) AS n,
        count(*) FILTER (WHERE label = expected) AS correct,
        round(count(*) FILTER (WHERE label = expected) / count(*), 4) AS accuracy,
        round(avg(latency_ms), 4) AS engine_ms, (SELECT round(p95, 4) FROM q) AS p95_ms,
        round(count(*) / (epoch(max(ts)) - epoch(min(ts))), 2) AS throughput FROM r
      UNION ALL SELECT 'class', expected, NULL, NULL, NULL, count(*), count(*) FILTER (WHERE label = expected),
        round(count(*) FILTER (WHERE label = expected) / count(*), 4), NULL, NULL, NULL FROM r GROUP BY expected
      UNION ALL SELECT 'ticket', id, category, coalesce(variant, adversarial, tag), label, 1,
        CASE WHEN label = expected THEN 1 ELSE 0 END, NULL, round(latency_ms, 3), NULL, NULL FROM r""",
)
def s5_document(spark, sf_dir):
    """The export document written by all tasks, read back as rows: summary, classes, tickets."""
    path = scratch_path(spark, "s5-document")
    export_document(spark, sf_dir, path)
    lines = D.read_document_lines(spark, path).withColumn("value", F.regexp_replace("value", "^,", ""))
    v = F.col("v")
    get = lambda p, t: F.try_variant_get(v, p, t)
    columns = "section key category tag got n correct accuracy engine_ms p95_ms throughput".split()
    types = ["string"] * 5 + ["long"] * 2 + ["double"] * 4

    def rows(df, **given):
        none = F.lit(None)
        return df.select(*[given.get(c, none).cast(t).alias(c) for c, t in zip(columns, types)])

    head = lines.where(F.startswith("value", F.lit('{"summary":')))
    head = head.select(parse_json(F.regexp_replace(F.expr("substring(value, 12)"), ",$", "")).alias("v"))
    per = lines.where(F.startswith("value", F.lit('"perClass":')))
    per = per.select(F.from_json(F.regexp_replace(F.expr("substring(value, 12)"), ",$", ""), "map<string,struct<n:long,correct:long,accuracy:double>>").alias("m"))
    per = per.select(F.explode("m").alias("key", "c"))
    one = lines.where(F.startswith("value", F.lit('{"id":'))).select(parse_json(F.col("value")).alias("v"))
    hit = F.coalesce(get("$.got", "string") == get("$.expected", "string"), F.lit(False)).cast("long")
    return (
        rows(
            head, section=F.lit("summary"), n=get("$.done", "long"), correct=get("$.correct", "long"),
            accuracy=get("$.accuracy", "double"), engine_ms=get("$.engineAvgMs", "double"),
            p95_ms=get("$.engineP95Ms", "double"), throughput=get("$.throughputPerSec", "double"),
        )
        .unionByName(rows(per, section=F.lit("class"), key=F.col("key"), n=F.col("c.n"), correct=F.col("c.correct"), accuracy=F.col("c.accuracy")))
        .unionByName(
            rows(
                one, section=F.lit("ticket"), key=get("$.id", "string"), category=get("$.category", "string"),
                tag=get("$.tag", "string"), got=get("$.got", "string"), n=F.lit(1), correct=hit, engine_ms=get("$.engineMs", "double"),
            )
        )
    )


# ---- G4 ------------------------------------------------------------------------------------------

SPLITS = {"train": 120, "valid": 30, "test": 60}
SEED = 7


def split_sizes(n_first: int, n_second: int) -> dict[str, int]:
    """The default sizes times the largest factor that both families' tables have records for."""
    first, second = (sum(c) for c in zip(*(family_counts(n) for n in SPLITS.values())))
    factor = max(1, min(n_first // first, n_second // (second + 1)))
    return {s: n * factor for s, n in SPLITS.items()}


def _split_sql(sizes_sql: str) -> str:
    """Splits by plain ranking. ``sizes_sql``: (split, k, f, g, base): number, records of each family, first id."""
    h = "md5('{seed}:' || family || ':' || CAST(rec_id AS VARCHAR))".format(seed=SEED)
    return f"""WITH z AS ({sizes_sql}),
      b AS (SELECT *, sum(f) OVER (ORDER BY k) AS f_end, sum(g) OVER (ORDER BY k) AS g_end FROM z),
      a AS (SELECT 'finance' AS family, rec_id, state, answer FROM ({O.finance_set()})
            UNION ALL SELECT 'general', rec_id, state, answer FROM ({O.general_set()})),
      r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY {h}, rec_id) AS place FROM a),
      s AS (SELECT r.*, b.split, b.base FROM r JOIN b ON CASE family WHEN 'finance' THEN place > f_end - f AND place <= f_end
              ELSE place > g_end - g AND place <= g_end END)
      SELECT split, family, base + row_number() OVER (PARTITION BY split, family ORDER BY place) - 1 AS id,
        row_number() OVER (PARTITION BY split ORDER BY md5('{SEED}:shuffle:' || family || ':' || CAST(rec_id AS VARCHAR)), family, rec_id) - 1 AS shuffle_pos,
        rec_id, md5(state) AS state_md5, answer FROM s"""


def _default_sizes_sql() -> str:
    rows = []
    for k, (s, n) in enumerate(SPLITS.items()):
        f, g = family_counts(n)
        rows.append(f"({sql_str(s)}, {k}, {f}, {g}, {id_bases(SPLITS)[s]})")
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t(split, k, f, g, base)"


def _whole_sizes_sql() -> str:
    first, second = (sum(c) for c in zip(*(family_counts(n) for n in SPLITS.values())))
    sizes = " UNION ALL ".join(f"SELECT {sql_str(s)} AS split, {k} AS k, {n} * factor AS n FROM u" for k, (s, n) in enumerate(SPLITS.items()))
    return f"""WITH u AS (SELECT greatest(1, least((SELECT count(*) FROM ({O.finance_set()})) // {first},
          (SELECT count(*) FROM ({O.general_set()})) // {second + 1})) AS factor),
        y AS ({sizes})
      SELECT split, k, CAST(round_even(n * CAST(0.58 AS DOUBLE), 0) AS BIGINT) AS f, n - CAST(round_even(n * CAST(0.58 AS DOUBLE), 0) AS BIGINT) AS g,
        (k + 1) * CAST(greatest(1000, pow(10, ceil(log10((SELECT max(n) FROM y))))) AS BIGINT) AS base FROM y"""


def _splits(spark, sf_dir, sizes=None):
    t = Tables(spark, sf_dir)
    fin, gen = X.finance_set(t.orders), X.general_set(t.customer)
    sizes = sizes or split_sizes(fin.count(), gen.count())
    s = build_splits(("finance", fin), ("general", gen), sizes, seed=SEED)
    return s.select("split", "family", "id", "shuffle_pos", "rec_id", F.md5(F.col("state")).alias("state_md5"), "answer")


@query(
    "g4_build_splits",
    sql=lambda: f"""SELECT 'finance' AS family, split, f AS n FROM ({_whole_sizes_sql()})
      UNION ALL SELECT 'general', split, g FROM ({_whole_sizes_sql()})""",
)
def g4_build_splits(spark, sf_dir):
    """Records of each split and family."""
    return _splits(spark, sf_dir).groupBy("family", "split").agg(F.count(F.lit(1)).alias("n"))


@query("g4_default_splits", sql=lambda: _split_sql(_default_sizes_sql()))
def g4_default_splits(spark, sf_dir):
    """G4 at the default sizes 120, 30 and 60: 70 + 50, 17 + 13 and 35 + 25 records, ids and shuffle."""
    return _splits(spark, sf_dir, SPLITS)


@query("g4_whole_splits", sql=lambda: _split_sql(_whole_sizes_sql()))
def g4_whole_splits(spark, sf_dir):
    """G4 at the largest multiple of the default sizes that both record tables fill."""
    return _splits(spark, sf_dir)


# ---- U1 ------------------------------------------------------------------------------------------

_PHRASES_SQL = """CASE length(p) % 7 % 6 WHEN 0 THEN l WHEN 1 THEN ' ' || lower(l) || chr(10) WHEN 2 THEN 'Answer: ' || l
  WHEN 3 THEN 'The label is ' || l || '.' WHEN 4 THEN 'I cannot tell' ELSE '' END"""


def _generated_sql() -> str:
    from arbiter.plans.records import _prompt_sql

    raw = f"""SELECT rec_id, {_PHRASES_SQL} AS raw FROM (SELECT rec_id, p, ['A', 'B', 'C'][length(p) % 3 + 1] AS l
      FROM (SELECT rec_id, {_prompt_sql()} AS p FROM ({O.d_set()})))"""
    return f"SELECT rec_id, raw, label, status FROM ({_resolve_sql('generated', ['A', 'B'], raw)})"


@query("u1_generated_labels", sql=_generated_sql)
def u1_generated_labels(spark, sf_dir):
    """A user's generator (deterministic stub), once for each distinct prompt; the label found in its text."""
    t = Tables(spark, sf_dir)
    rows = X.d_set(t.documents, t.labels).select(
        "rec_id",
        render_prompt("state", "question", format_options("options")).alias("prompt"),
        F.transform("options", lambda o: o["label"]).alias("labels"),
    )
    return G.generated_labels(rows, G.phrase_stub_factory).select("rec_id", "raw", "label", "status")


# ---- F2 ------------------------------------------------------------------------------------------


@query(
    "f2_write_gate",
    sql=lambda: f"""WITH s AS (SELECT unnest(['train', 'valid', 'test', 'other']) AS split),
      v AS (SELECT split, count(*) AS n FROM ({_violations_sql()}) GROUP BY split),
      r AS (SELECT split, count(*) AS n FROM ({O.d_set()}) GROUP BY split)
      SELECT 'seeded' AS input, s.split, coalesce(v.n, 0) AS violations, 0 AS published FROM s LEFT JOIN v USING (split)
      UNION ALL SELECT 'right', s.split, 0, coalesce(r.n, 0) FROM s LEFT JOIN r USING (split)""",
)
def f2_write_gate(spark, sf_dir):
    """records with seeded defects are not published, right ones are; each in the one job that writes them."""
    t = Tables(spark, sf_dir)
    d = X.d_set(t.documents, t.labels)
    body = F.to_json(F.struct("state", "question", "options", "answer")).alias("body")
    out = []
    for name, rows in (("seeded", X.corrupt_set(t.documents, t.labels)), ("right", d.select("rec_id", "split", body))):
        path = scratch_path(spark, "f2-gate")
        checked = V.parse_records(rows)
        try:
            counts = W.write_checked(checked, F.size(V.violations_expr(F.col("v"))), path, columns=["rec_id", "body"])
            there = dict(spark.read.json(path).groupBy("split").count().collect())
        except W.GateClosed as e:
            counts, there = e.counts, {}
        out += [(name, s, n, there.get(s, 0)) for s, n in counts.items()]
    return spark.createDataFrame(out, "input string, split string, violations long, published long")  # a row a split


# ---- D7 ------------------------------------------------------------------------------------------


def _refs_sql(src: str) -> str:
    first = lambda k: f"nullif(regexp_extract(state, '\\b({k}-[0-9]+)', 1), '')"
    return f"""SELECT *, {first('INV')} AS invoice_ref, {first('PO')} AS po_ref, {first('PAY')} AS payment_ref,
        len(regexp_extract_all(state, '\\b(INV|PO|PAY)-[0-9]+')) AS n_refs,
        strpos(state, regexp_extract(state, '\\b(INV|PO|PAY)-[0-9]+')) - 1 AS first_pos FROM ({src})"""


@query(
    "d7_references",
    sql=lambda: f"""SELECT id, invoice_ref, po_ref, payment_ref, n_refs, CASE WHEN n_refs > 0 THEN first_pos END AS first_pos
      FROM ({_refs_sql(O.ticket_set())})""",
)
def d7_references(spark, sf_dir):
    """Invoice, order and payment that each ticket's text names, how many references it has, where the first stands."""
    r = with_references(X.ticket_set(Tables(spark, sf_dir).orders).select("id", "state"))
    return r.select("id", *ROLES.values(), F.size("refs").alias("n_refs"), F.get("refs", 0)["pos"].alias("first_pos"))


@query(
    "d7_unreferenced_payments",
    sql=lambda: f"""WITH r AS ({_refs_sql(O.finance_set())})
      SELECT CASE WHEN payment_ref IS NULL THEN 'no payment' WHEN invoice_ref IS NULL THEN 'payment without invoice'
        ELSE 'payment of an invoice' END AS role, count(*) AS n, count(DISTINCT payment_ref) AS payments, count(DISTINCT invoice_ref) AS invoices
      FROM r GROUP BY 1""",
)
def d7_unreferenced_payments(spark, sf_dir):
    """What payments the record texts name refer to, from the texts alone."""
    r = with_references(X.finance_set(Tables(spark, sf_dir).orders).select("rec_id", "state"))
    role = (
        F.when(F.col("payment_ref").isNull(), "no payment")
        .when(F.col("invoice_ref").isNull(), "payment without invoice")
        .otherwise("payment of an invoice")
    )
    return r.groupBy(role.alias("role")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("payment_ref").alias("payments"), F.count_distinct("invoice_ref").alias("invoices")
    )
