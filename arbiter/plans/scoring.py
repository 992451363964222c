"""Scoring queries: vocabulary (P9), masks (P8), budget fitting (P7), naive
Bayes (M1, W3), centroids (W4), softmax/ranking/assembly (W1, W2, P12),
continuation split (W5), seeded shuffle (W6), pairing and comparison (J3,
J9), batch classification (D8, A7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbiter.functions.options import format_options
from arbiter.functions.prompts import fit_state, render_prompt, render_training_text
from arbiter.functions.text import preview, template_sql, tokens, words, sql_str
from arbiter.operators import metrics as M
from arbiter.operators import scoring as S
from arbiter.operators.linear import fit_linear, score_linear
from arbiter.operators.ordinal import ordinal_within
from arbiter.plans import oracle_fixtures as O
from arbiter.plans.records import _blob, _fmt_line_sql, _split_sql
from arbiter.plans.registry import query
from arbiter.session import Tables, staged
from arbiter.sources import fixtures as X
from arbiter.sources import records as R
from arbiter.sources.catalogue import DEFAULT_PERSONA, PROMPT_TEMPLATE

WS = O.WS
TOK_SQL = "list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda t: t <> '')"
WORDS_SQL = "len(list_filter(string_split_regex({x}, '[ \\n\\t\\r]+'), lambda t: t <> ''))"


def _tok(x: str) -> str:
    return TOK_SQL.format(x=x)


# ---- P9 -------------------------------------------------------------------------------


@query(
    "p9_vocab",
    sql=f"""SELECT token, n, row_number() OVER (ORDER BY n DESC, token) - 1 AS id FROM (
        SELECT token, count(*) AS n FROM (SELECT unnest({TOK_SQL.format(x='text')}) AS token FROM documents) GROUP BY 1)""",
)
def p9_vocab(spark, sf_dir):
    """Token vocabulary over all documents, ids by frequency."""
    return S.build_vocab(Tables(spark, sf_dir).documents, "text").select("token", "n", "id")


# ---- M1 / W3 / J9 / J3 ------------------------------------------------------------------


def _dset(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return X.d_set(t.documents, t.labels)


def _fit(spark, sf_dir):
    d = _dset(spark, sf_dir)
    return S.fit_nb(d.where(F.col("split") == "train"), "rec_id", "state", "answer")


def _nb_sql(items: str, key: str = "rec_id", text: str = "state") -> str:
    """Oracle naive Bayes: scores of every row of ``items`` for every class."""
    return f"""WITH d AS ({O.d_set()}),
      tr AS (SELECT answer AS label, unnest({_tok('state')}) AS token FROM d WHERE split = 'train'),
      lt AS (SELECT label, token, count(*) AS c FROM tr GROUP BY 1, 2),
      nl AS (SELECT label, sum(c) AS n_tok FROM lt GROUP BY 1),
      v AS (SELECT count(DISTINCT token) AS nv FROM lt),
      nd AS (SELECT answer AS label, count(*) AS n_label FROM d WHERE split = 'train' GROUP BY 1),
      pri AS (SELECT nd.label, ln(n_label / (SELECT sum(n_label) FROM nd)) AS log_prior,
                coalesce(nl.n_tok, 0) + (SELECT nv FROM v) AS denom
              FROM nd LEFT JOIN nl ON nd.label = nl.label),
      it AS ({items}),
      tv AS (SELECT {key} AS k, token FROM (SELECT {key}, unnest({_tok(text)}) AS token FROM it)
             WHERE token IN (SELECT token FROM lt)),
      sc AS (SELECT tv.k, pri.label, sum(ln((coalesce(lt.c, 0) + 1) / pri.denom)) AS s
             FROM tv CROSS JOIN pri LEFT JOIN lt ON lt.label = pri.label AND lt.token = tv.token
             GROUP BY 1, 2)
      SELECT it.{key} AS {key}, pri.label, pri.log_prior + coalesce(sc.s, 0) AS logp
      FROM it CROSS JOIN pri LEFT JOIN sc ON sc.k = it.{key} AND sc.label = pri.label"""


@query(
    "m1_fit_model",
    sql=f"""WITH d AS ({O.d_set()}),
      tr AS (SELECT answer AS label, unnest({_tok('state')}) AS token FROM d WHERE split = 'train')
      SELECT label, token, count(*) AS c, round(ln(count(*) + 1), 6) AS delta FROM tr GROUP BY 1, 2""",
)
def m1_fit_model(spark, sf_dir):
    """M1: the fitted model table (train split only)."""
    m = _fit(spark, sf_dir)["model"]
    return m.select("label", "token", "c", F.round("delta", 6).alias("delta"))


@query(
    "w3_nb_scores",
    sql=lambda: f"SELECT rec_id, label, round(logp, 4) AS logp FROM ({_nb_sql('SELECT * FROM d')})",
)
def w3_nb_scores(spark, sf_dir):
    """Naive-Bayes log-likelihood of every record for every label."""
    d = _dset(spark, sf_dir)
    s = S.score_nb(d, _fit(spark, sf_dir), "rec_id", "state")
    return s.select("rec_id", "label", F.round("logp", 4).alias("logp"))


def _decide(scores, key):
    """W1 → W2 → top row: label with the highest rounded p, ties by label order."""
    p = S.softmax(scores.withColumn("pos", F.ascii("label") - 65), key)
    r = S.rank_options(p, key)
    return r.where(F.col("rank") == 1).select(*([key] if isinstance(key, str) else key), "label", "p")


def _decide_sql2(scores: str, key: str = "rec_id") -> str:
    # DuckDB does not nest window functions; stage the max first.
    return f"""SELECT {key}, label, p FROM (
        SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY p DESC, label) AS rk FROM (
          SELECT {key}, label, round(z / sum(z) OVER (PARTITION BY {key}), 6) AS p FROM (
            SELECT {key}, label, exp(logp - max(logp) OVER (PARTITION BY {key})) AS z FROM ({scores}))))
      WHERE rk = 1"""


@query(
    "j9_compare_runs",
    sql=lambda: f"""WITH d AS ({O.d_set()}),
      b AS ({_decide_sql2(f"SELECT d.rec_id, pri.label, pri.log_prior AS logp FROM d CROSS JOIN (SELECT answer AS label, ln(count(*) / (SELECT count(*) FROM d WHERE split = 'train')) AS log_prior FROM d WHERE split = 'train' GROUP BY 1) pri")}),
      t AS ({_decide_sql2(_nb_sql('SELECT * FROM d'))}),
      j AS (SELECT d.split, d.answer AS expected, b.label AS bl, t.label AS tl FROM d JOIN b ON d.rec_id = b.rec_id JOIN t ON d.rec_id = t.rec_id)
      SELECT split, count(*) AS n,
        avg(CASE WHEN bl = expected THEN 1.0 ELSE 0.0 END) AS base_accuracy,
        avg(CASE WHEN tl = expected THEN 1.0 ELSE 0.0 END) AS tuned_accuracy,
        avg(CASE WHEN bl IS NULL THEN 1.0 ELSE 0.0 END) AS base_invalid_rate,
        avg(CASE WHEN tl IS NULL THEN 1.0 ELSE 0.0 END) AS tuned_invalid_rate,
        sum(CASE WHEN bl <> expected AND tl = expected THEN 1 ELSE 0 END) AS fixed,
        sum(CASE WHEN bl = expected AND tl <> expected THEN 1 ELSE 0 END) AS broken
      FROM j GROUP BY split""",
)
def j9_compare_runs(spark, sf_dir):
    """Prior-only (base) vs fitted (tuned) scorer on the same records, per split."""
    d = _dset(spark, sf_dir)
    fitted = _fit(spark, sf_dir)
    base = _decide(S.score_nb(d, fitted, prior_only=True), "rec_id")
    tuned = _decide(S.score_nb(d, fitted), "rec_id")
    exp = d.select("rec_id", "split", F.col("answer").alias("expected"))
    b = exp.join(base.select("rec_id", "label"), "rec_id")
    return M.compare_runs(b, tuned.select("rec_id", "label"), "rec_id", by=["split"])


@query("m1_linear_compare")
def m1_linear_compare(spark, sf_dir):
    """M1, second backend: naive Bayes (base) against the saved linear pipeline (tuned), both fitted on
    the train split, over all records by split (J9). An iterative fit: no SQL, see tests/test_linear.py."""
    d = _dset(spark, sf_dir)
    path = fit_linear(d.where(F.col("split") == "train"), R.scratch_path(spark, "linear-model"))
    base = _decide(S.score_nb(d, _fit(spark, sf_dir)), "rec_id")
    tuned = _decide(score_linear(d, path), "rec_id")
    exp = d.select("rec_id", "split", F.col("answer").alias("expected"))
    return M.compare_runs(exp.join(base.select("rec_id", "label"), "rec_id"), tuned, "rec_id", by=["split"])


@query(
    "j3_pair_predictions",
    sql=lambda: f"""WITH p AS ({_decide_sql2(_nb_sql('SELECT doc_id, text FROM documents', 'doc_id', 'text'), 'doc_id')}),
      e AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'A' ELSE 'B' END AS expected FROM labels),
      j AS (SELECT e.doc_id AS ed, p.doc_id AS pd, expected, label FROM e FULL OUTER JOIN p ON e.doc_id = p.doc_id)
      SELECT count(*) FILTER (WHERE ed IS NOT NULL AND pd IS NOT NULL) AS matched,
        count(*) FILTER (WHERE pd IS NULL) AS only_expected,
        count(*) FILTER (WHERE ed IS NULL) AS only_predicted,
        count(*) FILTER (WHERE ed IS NOT NULL AND pd IS NOT NULL AND label = expected) AS correct
      FROM j""",
)
def j3_pair_predictions(spark, sf_dir):
    """Labels (expected) ⟗ predictions for every document, by key."""
    t = Tables(spark, sf_dir)
    fitted = _fit(spark, sf_dir)
    pred = _decide(S.score_nb(t.documents.select("doc_id", "text"), fitted, "doc_id", "text"), "doc_id")
    exp = t.labels.select("doc_id", F.when(F.col("quality") == 1, "A").otherwise("B").alias("expected"))
    j = M.pair(exp.withColumn("_e", F.lit(1)), pred.withColumn("_p", F.lit(1)), "doc_id")
    both = F.col("_e").isNotNull() & F.col("_p").isNotNull()
    return j.agg(
        F.sum(both.cast("long")).alias("matched"),
        F.sum(F.col("_p").isNull().cast("long")).alias("only_expected"),
        F.sum(F.col("_e").isNull().cast("long")).alias("only_predicted"),
        F.sum((both & (F.col("label") == F.col("expected"))).cast("long")).alias("correct"),
    )


# ---- W4 / W1 / W2 / P12 -------------------------------------------------------------------


def _centroid_scores(spark, sf_dir):
    e = Tables(spark, sf_dir).embeddings
    cents = S.centroids(e.where(F.col("vec_id") % 5 != 0))
    return S.score_centroid(e, cents, "vec_id")


CENTROID_SQL = """WITH tr AS (SELECT label, unnest(embedding) AS x, unnest(generate_series(0, len(embedding) - 1)) AS dim
        FROM embeddings WHERE vec_id % 5 <> 0),
      c AS (SELECT label, dim, avg(CAST(x AS DOUBLE)) AS c FROM tr GROUP BY 1, 2),
      it AS (SELECT vec_id, unnest(embedding) AS x, unnest(generate_series(0, len(embedding) - 1)) AS dim FROM embeddings)
      SELECT vec_id, label, sum(CAST(x AS DOUBLE) * c) AS logp FROM it JOIN c ON it.dim = c.dim GROUP BY 1, 2"""


@query(
    "w4_centroid_scores",
    sql=f"SELECT vec_id, label, round(logp, 4) + 0.0 AS logp FROM ({CENTROID_SQL})",
)
def w4_centroid_scores(spark, sf_dir):
    """Dot product of every vector with every class centroid (fit on 4 of 5 ids)."""
    return _centroid_scores(spark, sf_dir).select("vec_id", "label", (F.round("logp", 4) + 0.0).alias("logp"))


def _softmax_sql() -> str:
    return f"""SELECT vec_id, label, round(z / sum(z) OVER (PARTITION BY vec_id), 6) AS p FROM (
        SELECT vec_id, label, exp(logp - max(logp) OVER (PARTITION BY vec_id)) AS z FROM ({CENTROID_SQL}))"""


@query("w1_softmax", sql=lambda: f"SELECT vec_id, label, p FROM ({_softmax_sql()})")
def w1_softmax(spark, sf_dir):
    """Per-vector softmax over classes."""
    p = S.softmax(_centroid_scores(spark, sf_dir), "vec_id")
    return p.select("vec_id", "label", "p")


def _rank_sql() -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, label) AS rank FROM ({_softmax_sql()})"


@query("w2_rank_options", sql=lambda: f"SELECT vec_id, label, rank FROM ({_rank_sql()})")
def w2_rank_options(spark, sf_dir):
    """Stable ranking by rounded p, ties by option position."""
    p = S.softmax(_centroid_scores(spark, sf_dir), "vec_id").withColumnRenamed("label", "label_i")
    p = p.withColumn("label", F.col("label_i")).withColumn("pos", F.col("label_i"))
    return S.rank_options(p, "vec_id").select("vec_id", "label", "rank")


@query(
    "p12_assemble_decision",
    sql=lambda: f"""SELECT vec_id, CAST(arg_min(label, rank) AS VARCHAR) AS label, max(p) AS confidence,
        string_agg(CAST(label AS VARCHAR), ',' ORDER BY rank) AS ranking FROM ({_rank_sql()}) GROUP BY 1""",
)
def p12_assemble_decision(spark, sf_dir):
    """Decision record per vector: top label, confidence, ranking."""
    p = S.softmax(_centroid_scores(spark, sf_dir), "vec_id")
    p = p.withColumn("pos", F.col("label")).withColumn("label", F.col("label").cast("string")).withColumn(
        "key", F.concat(F.lit("class "), F.col("label"))
    )
    d = S.assemble_decision(S.rank_options(p, "vec_id"), "vec_id")
    return d.select(
        "vec_id",
        "label",
        "confidence",
        F.array_join(F.transform("ranking", lambda r: r["label"]), ",").alias("ranking"),
    )


# ---- W5 / W6 -------------------------------------------------------------------------------


@query(
    "w5_continuation",
    sql=lambda: f"""WITH d AS ({O.d_set()}),
      o AS (SELECT rec_id, o.label AS label, rtrim(state, {WS}) AS base FROM d, unnest(options) AS u(o)),
      w AS (SELECT rec_id, label,
          list_filter(string_split_regex(base || ' ANSWER:', '[ \\n\\t\\r]+'), lambda t: t <> '') AS a,
          list_filter(string_split_regex(base || ' ANSWER:' || label, '[ \\n\\t\\r]+'), lambda t: t <> '') AS b FROM o),
      s AS (SELECT rec_id, label, a, b, coalesce(list_position(list_transform(generate_series(1, greatest(len(a), len(b))),
              lambda i: a[i] IS DISTINCT FROM b[i]), true) - 1, least(len(a), len(b))) AS shared FROM w)
      SELECT rec_id, label, shared, array_to_string(b[shared + 1:], ' ') AS tail FROM s""",
)
def w5_continuation(spark, sf_dir):
    """Answer tokens = full sequence after the common prefix with the prompt."""
    d = _dset(spark, sf_dir)
    o = d.select("rec_id", F.regexp_replace("state", r"(?U)\s+$", "").alias("base"), F.explode("options").alias("o"))
    a = words(F.concat(F.col("base"), F.lit(" ANSWER:")))
    b = words(F.concat(F.col("base"), F.lit(" ANSWER:"), F.col("o.label")))
    c = S.continuation(a, b)
    return o.select("rec_id", F.col("o.label").alias("label"), c["shared"].alias("shared"), F.array_join(c["tail"], " ").alias("tail"))


@query(
    "w6_shuffle",
    sql=lambda: f"""SELECT rec_id, split, row_number() OVER (PARTITION BY split ORDER BY md5('7:' || CAST(rec_id AS VARCHAR)), rec_id) - 1 AS shuffle_pos
      FROM ({O.d_set()})""",
)
def w6_shuffle(spark, sf_dir):
    """Seeded shuffle position inside each split (range-partitioned, no per-split window)."""
    d = _dset(spark, sf_dir).select(
        "rec_id", "split", F.md5(F.concat(F.lit("7:"), F.col("rec_id").cast("string"))).alias("_h")
    )
    return ordinal_within(d, ["split"], ["_h", "rec_id"], out="shuffle_pos").select("rec_id", "split", "shuffle_pos")


# ---- P7 / P8 -------------------------------------------------------------------------------

# The original's limits: space/app.py (prompt budget), scripts/train.py (max_seq_len).
FIT_MAX_LEN = 1536
QUALITY_BLOCK = "A: good — Good quality\nB: poor — Poor quality"


def _fit_sql(max_len: int = FIT_MAX_LEN) -> str:
    limit = max_len - 8

    def prompt(s: str) -> str:
        return template_sql(
            PROMPT_TEMPLATE,
            {"persona": sql_str(DEFAULT_PERSONA), "state": s, "question": sql_str(X.QUALITY_QUESTION), "options": sql_str(QUALITY_BLOCK)},
        )

    nw = WORDS_SQL.format(x=prompt("s"))
    return f"""WITH RECURSIVE r(doc_id, s, step) AS (
        SELECT doc_id, trim(text, {WS}), 0 FROM documents
        UNION ALL
        SELECT doc_id, rtrim(substr(s, 1, greatest(40, CAST(floor(length(s) * CAST(0.7 AS DOUBLE)) AS INTEGER))), {WS}), step + 1
        FROM r WHERE step < 48 AND length(s) > 80 AND {nw} > {limit})
      SELECT doc_id, {WORDS_SQL.format(x=prompt('s'))} AS n_tokens, step > 0 AS truncated, length(s) AS state_len, md5({prompt('s')}) AS prompt_md5
      FROM (SELECT doc_id, arg_max(s, step) AS s, max(step) AS step FROM r GROUP BY doc_id)"""


@query("p7_fit_state", sql=_fit_sql)
def p7_fit_state(spark, sf_dir):
    """Shrink each document's state until the prompt fits 1536 − 8 words."""
    d = Tables(spark, sf_dir).documents
    f = fit_state(F.col("text"), F.lit(X.QUALITY_QUESTION), F.lit(QUALITY_BLOCK), max_len=FIT_MAX_LEN)
    return d.select("doc_id", f.alias("f")).select(
        "doc_id", "f.n_tokens", "f.truncated", F.length("f.state").alias("state_len"), F.md5("f.prompt").alias("prompt_md5")
    )


MASK_MAX_LEN = 2048


def _mask_sql() -> str:
    prompt = template_sql(
        PROMPT_TEMPLATE,
        {
            "persona": sql_str(DEFAULT_PERSONA),
            "state": f"trim(state, {WS})",
            "question": f"trim(question, {WS})",
            "options": f"array_to_string(list_transform(options, lambda o: {_fmt_line_sql('o')}), chr(10))",
        },
    )
    return f"""WITH d AS ({O.d_set()}),
      t AS (SELECT rec_id, len({_tok('p')}) AS n_prompt, {_tok("p || upper(trim(answer, " + WS + ")) || chr(10)")} AS full_toks
            FROM (SELECT rec_id, answer, {prompt} AS p FROM d)),
      v AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) - 1 AS id FROM (
            SELECT token, count(*) AS n FROM (SELECT unnest(full_toks) AS token FROM t) GROUP BY 1)),
      e AS (SELECT rec_id, n_prompt, unnest(full_toks) AS token, unnest(generate_series(1, len(full_toks))) AS pos FROM t),
      ids AS (SELECT rec_id, n_prompt, list(v.id ORDER BY pos) FILTER (WHERE pos <= {MASK_MAX_LEN}) AS ids
              FROM e JOIN v ON e.token = v.token GROUP BY 1, 2),
      m AS (SELECT rec_id, ids, least(n_prompt, len(ids)) AS n_mask FROM ids)
      SELECT rec_id, len(ids) AS n_input,
        CASE WHEN n_mask >= len(ids) THEN len(ids) - 1 ELSE n_mask END AS n_masked,
        CASE WHEN n_mask >= len(ids) THEN CAST(ids[len(ids)] AS VARCHAR)
             ELSE array_to_string(ids[n_mask + 1:], ' ') END AS supervised
      FROM m"""


@query("p8_mask_examples", sql=_mask_sql)
def p8_mask_examples(spark, sf_dir):
    """Answer-only label masks over vocabulary ids (max length 2048)."""
    t = Tables(spark, sf_dir)
    d = X.d_set(t.documents, t.labels)
    prompt = render_prompt("state", "question", format_options("options"))
    full = render_training_text(prompt, "answer")
    # The vocabulary covers the texts being encoded, so no token is dropped.
    vocab = S.build_vocab(d.select(full.alias("t")), "t").select(S.token_key(F.col("token")).alias("_token"), "n", "id")
    vocab = staged(vocab, "vocabulary")
    # Only the first MASK_MAX_LEN tokens have a place in the example.
    ex = d.select("rec_id", F.size(tokens(prompt)).alias("n_prompt"), F.slice(tokens(full), 1, MASK_MAX_LEN).alias("toks"))
    parts = S.hot_and_cold(vocab, "n")
    if parts[1] is not None:
        ex = staged(ex, "example-tokens")
    e = ex.select("rec_id", "n_prompt", F.posexplode("toks").alias("pos", "token"))
    ids = (
        S.with_values(e, "token", parts, "n")
        .groupBy("rec_id", "n_prompt")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("ps"))
        .select("rec_id", "n_prompt", F.transform("ps", lambda x: x["id"].cast("int")).alias("ids"))
    )
    lab = S.answer_mask(F.col("n_prompt"), F.col("ids"), MASK_MAX_LEN)
    m = ids.select("rec_id", F.slice("ids", 1, MASK_MAX_LEN).alias("ids"), lab.alias("labels"))
    sup = F.filter("labels", lambda x: x != S.IGNORE)
    return m.select(
        "rec_id",
        F.size("ids").alias("n_input"),
        (F.size("labels") - F.size(sup)).alias("n_masked"),
        F.array_join(sup, " ").alias("supervised"),
    )


# ---- D8 / A7 ----------------------------------------------------------------------------------


def _batch_decisions(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents.select("doc_id", _blob().alias("blob"))
    items, _err = R.split_states(docs, "blob", "doc_id")
    # The preview is cut before scoring and travels with the key, so no state is shuffled.
    key = ["doc_id", "item_no", "preview"]
    items = items.select("doc_id", "item_no", preview("state", 160).alias("preview"), "state")
    top = _decide(S.score_nb(items, _fit(spark, sf_dir), key, "state"), key)
    keys = F.when(F.col("label") == "A", "good").otherwise("poor")
    return top.select(*key, "label", keys.alias("key"), F.col("p").alias("confidence"))


def _batch_sql() -> str:
    items = f"SELECT CAST(doc_id AS VARCHAR) || ':' || CAST(item_no AS VARCHAR) AS item, doc_id, item_no, state FROM ({_split_sql()})"
    return f"""WITH it AS ({items}),
      top AS ({_decide_sql2(_nb_sql('SELECT item, state FROM (' + items + ')', 'item', 'state'), 'item')})
      SELECT it.doc_id, it.item_no, substr(replace(it.state, chr(10), ' '), 1, 160) AS preview, top.label,
        CASE WHEN top.label = 'A' THEN 'good' ELSE 'poor' END AS key, top.p AS confidence
      FROM it JOIN top ON it.item = top.item"""


@query("d8_classify_batch", sql=_batch_sql)
def d8_classify_batch(spark, sf_dir):
    """Every state of every batch → label, key, confidence, preview."""
    return _batch_decisions(spark, sf_dir)


@query("a7_batch_spread", sql=lambda: f"SELECT doc_id, label, count(*) AS n FROM ({_batch_sql()}) GROUP BY 1, 2")
def a7_batch_spread(spark, sf_dir):
    """Label spread per batch."""
    return _batch_decisions(spark, sf_dir).groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n"))
