"""Streaming queries (T1–T3) and the scorer hook.

Each streaming query writes the ticket table as arriving files, drains the
stream with ``availableNow`` and returns the final sink table, which must
equal the batch result (the oracle is the batch SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbiter.functions.options import format_options
from arbiter.functions.prompts import render_prompt
from arbiter.operators import hook as H
from arbiter.operators import metrics as M
from arbiter.operators import scoring as S
from arbiter.plans import oracle_fixtures as O
from arbiter.plans.decisions import _headline_sql, _tickets_decided_sql
from arbiter.plans.records import _prompt_sql
from arbiter.plans.registry import REGISTRY, query
from arbiter.plans.scoring import _decide_sql2
from arbiter.session import Tables, spread
from arbiter.sources import fixtures as X
from arbiter.sources.records import scratch_path
from arbiter.streaming import tickets as T
from arbiter.streaming.runs import TicketRun


def _arrivals(spark, sf_dir, waves: int = 4):
    """Write tickets as ``waves`` arrival folders; returns (root, schema, files in a wave).

    A wave's files grow with the orders. A stream that takes a wave at a time has as many micro-batches, and
    sends as many task results and state commits to the driver, whatever the number of tickets.
    """
    orders = spread(Tables(spark, sf_dir).orders.select("o_orderkey", "o_totalprice"))
    tk = X.ticket_set(orders)
    root = scratch_path(spark, "tickets-in")
    tk.withColumn("wave", F.col("rec_id") % waves).write.partitionBy("wave").parquet(root)
    return root, tk.schema, max(1, -(-len(spark.read.parquet(root).inputFiles()) // waves))


@query("t1_classify_stream", sql=lambda: f"SELECT id, expected, conclusion, label, status FROM ({_tickets_decided_sql()})")
def t1_classify_stream(spark, sf_dir):
    """Tickets decided as they arrive (file stream → parquet sink)."""
    root, schema, _ = _arrivals(spark, sf_dir)
    sink, ckpt = scratch_path(spark, "t1-out"), scratch_path(spark, "t1-ckpt")
    q = T.classify_stream(T.ticket_stream(spark, root, schema), sink, ckpt)
    q.awaitTermination()
    return spark.read.parquet(sink).select(*T.DECISION_COLS)


@query("t2_stats_stream", sql=lambda: _headline_sql(_tickets_decided_sql()))
def t2_stats_stream(spark, sf_dir):
    """Running counts; the final snapshot gives the batch headline."""
    root, schema, files = _arrivals(spark, sf_dir)
    stats, ckpt = scratch_path(spark, "t2-stats"), scratch_path(spark, "t2-ckpt")
    q = T.stats_stream(T.ticket_stream(spark, root, schema, files_per_trigger=files), stats, ckpt)
    q.awaitTermination()
    return M.headline(T.read_stats(spark, stats))


@query(
    "t2_stats_per_class",
    sql=lambda: f"""SELECT expected, count(*) AS n, count(*) FILTER (WHERE label = expected) AS correct,
        count(*) FILTER (WHERE label = expected) / count(*) AS accuracy
      FROM ({_tickets_decided_sql()}) WHERE expected IS NOT NULL GROUP BY 1""",
)
def t2_stats_per_class(spark, sf_dir):
    """Running recall per class from the newest snapshot."""
    root, schema, files = _arrivals(spark, sf_dir)
    stats, ckpt = scratch_path(spark, "t2-stats"), scratch_path(spark, "t2-ckpt")
    T.stats_stream(T.ticket_stream(spark, root, schema, files_per_trigger=files), stats, ckpt).awaitTermination()
    return M.per_class(T.read_stats(spark, stats))


@query("t3_resume_stream", sql=lambda: f"SELECT id, label, status FROM ({_tickets_decided_sql()})")
def t3_resume_stream(spark, sf_dir):
    """Stop after part of the input, continue with the rest and with tickets that came before; no
    ticket is scored twice."""
    tk = X.ticket_set(Tables(spark, sf_dir).orders)
    root = scratch_path(spark, "t3-in")
    run = TicketRun(spark, scratch_path(spark, "t3-run"))
    tk.where(F.col("rec_id") % 2 == 0).write.parquet(f"{root}/part=0")
    run.start(root, tk.schema).awaitTermination()
    tk.where(F.col("rec_id") % 3 < 2).write.parquet(f"{root}/part=1")
    tk.where(F.col("rec_id") % 2 == 1).write.parquet(f"{root}/part=2")
    run.start(root, tk.schema).awaitTermination()
    return run.results().select("id", "label", "status")


# ---- U1 --------------------------------------------------------------------------------------


@query(
    "u1_scorer_hook",
    sql=lambda: f"""SELECT rec_id, generate_subscripts(options, 1) - 1 AS pos, unnest(options).label AS label,
        -CAST((length(p) + 3 * ascii(unnest(options).label)) % 11 AS DOUBLE) AS logp
      FROM (SELECT rec_id, options, {_prompt_sql()} AS p FROM ({O.d_set()}))""",
)
def u1_scorer_hook(spark, sf_dir):
    """A user scorer (deterministic stub) run through mapInPandas."""
    t = Tables(spark, sf_dir)
    d = X.d_set(t.documents, t.labels)
    rows = d.select(
        "rec_id",
        render_prompt("state", "question", format_options("options")).alias("prompt"),
        F.transform("options", lambda o: o["label"]).alias("labels"),
    )
    return H.with_scorer(rows, H.length_stub_factory)


@query("u1_hook_decisions", sql=lambda: _decide_sql2(REGISTRY["u1_scorer_hook"].sql))
def u1_hook_decisions(spark, sf_dir):
    """U1 → W1 → W2: decisions from the user scorer ."""
    scores = u1_scorer_hook(spark, sf_dir)
    p = S.softmax(scores, "rec_id")
    return S.rank_options(p, "rec_id").where(F.col("rank") == 1).select("rec_id", "label", "p")
