"""Record queries: sources/sinks (S1–S7), validation (F1–F3, F6, A1, A10),
option parsing and prompt rendering (P1–P6, P10, P11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbiter.functions.labels import allowed_labels
from arbiter.functions.options import format_options, parse_options_lenient, parse_options_strict
from arbiter.functions.prompts import render_prompt, render_training_text
from arbiter.functions.text import preview, sql_str, template_sql
from arbiter.operators import metrics as M
from arbiter.operators import validate as V
from arbiter.plans import oracle_fixtures as O
from arbiter.plans.registry import query
from arbiter.session import Tables, spread
from arbiter.sources import fixtures as X
from arbiter.sources import records as R
from arbiter.sources.catalogue import DEFAULT_PERSONA, PROMPT_TEMPLATE

WS = O.WS

# ---- S1 / S2 ----------------------------------------------------------------------


@query(
    "s1_parse_records",
    sql=lambda: f"SELECT rec_id, split, question, answer, len(options) AS n_options, md5(state) AS state_md5 FROM ({O.d_set()})",
)
def s1_parse_records(spark, sf_dir):
    """Records rendered to JSON lines and parsed back with the declared schema."""
    t = Tables(spark, sf_dir)
    d = X.d_set(t.documents, t.labels)
    lines = d.select("split", F.to_json(F.struct("rec_id", "state", "question", "options", "answer")).alias("body"))
    p = R.parse_record_json(lines)
    return p.select(
        "rec.rec_id", "split", "rec.question", "rec.answer",
        F.size("rec.options").alias("n_options"), F.md5("rec.state").alias("state_md5"),
    )


@query(
    "s2_write_read_records",
    sql=lambda: f"SELECT split, count(*) AS n, sum(length(state)) AS chars FROM ({O.d_set()}) GROUP BY split",
)
def s2_write_read_records(spark, sf_dir):
    """S2 → S1: write one JSON folder per split, read back with FAILFAST."""
    t = Tables(spark, sf_dir)
    d = X.d_set(t.documents, t.labels)
    path = R.scratch_path(spark, "records")
    R.write_records(d.select("rec_id", "state", "question", "options", "answer", "split"), path)
    back = R.read_records(spark, path, mode="FAILFAST", schema=R.RECORD_SCHEMA + ", split STRING")
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("state")).alias("chars"))


# ---- S3 / S4 ----------------------------------------------------------------------


def _blob():
    return F.when(
        F.col("doc_id") % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    ).otherwise(F.to_json(F.split(F.col("text"), "\n", -1)))


def _split_sql() -> str:
    raw = f"trim(CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(10) || chr(10)) ELSE CAST(to_json(string_split(text, chr(10))) AS VARCHAR) END, {WS})"
    return f"""WITH b AS (SELECT doc_id, {raw} AS raw FROM documents),
      s AS (SELECT doc_id, CASE WHEN starts_with(raw, '[')
               THEN json_transform(CASE WHEN json_valid(raw) THEN raw ELSE 'null' END, '["VARCHAR"]')
             ELSE list_filter(list_transform(string_split(raw, chr(10) || chr(10)), lambda x: trim(x, {WS})), lambda x: x <> '') END AS states
            FROM b WHERE raw <> '')
      SELECT doc_id, unnest(generate_series(1, len(states))) AS item_no, unnest(states) AS state
      FROM s WHERE len(states) > 0"""


@query("s3_split_states", sql=_split_sql)
def s3_split_states(spark, sf_dir):
    """S3: state batches (blank-line text or JSON arrays) → numbered states."""
    docs = Tables(spark, sf_dir).documents.select("doc_id", _blob().alias("blob"))
    ok, _errors = R.split_states(docs, "blob", "doc_id")
    return ok


def _request_body():
    k = F.col("event_id") % 4
    good = F.concat(
        F.lit('{"state": "event '), F.col("event_type"),
        F.lit('", "question": "Keep this event?", "options": "A: keep | B: drop", "props": '),
        F.col("props"), F.lit("}"),
    )
    return (
        F.when(k == 0, F.substr(F.col("props"), F.lit(2)))
        .when(k == 1, F.col("props"))
        .when(k == 2, F.concat(F.lit("["), F.col("props"), F.lit("]")))
        .otherwise(good)
    )


def _requests_sql() -> str:
    body = """CASE WHEN event_id % 4 = 0 THEN substr(props, 2)
      WHEN event_id % 4 = 1 THEN props WHEN event_id % 4 = 2 THEN '[' || props || ']'
      ELSE '{"state": "event ' || event_type || '", "question": "Keep this event?", "options": "A: keep | B: drop", "props": ' || props || '}' END"""
    return f"""SELECT event_id,
        CASE WHEN NOT ok THEN 'invalid JSON' WHEN json_type(j) <> 'OBJECT' THEN 'not an object'
             WHEN coalesce(json_extract_string(j, '$.options'), '') = '' THEN 'missing options' END AS reason,
        CASE WHEN json_type(j) = 'OBJECT' THEN coalesce(json_extract_string(j, '$.state'), '') ELSE '' END AS state,
        CASE WHEN json_type(j) = 'OBJECT' THEN coalesce(json_extract_string(j, '$.question'), '') ELSE '' END AS question,
        CASE WHEN json_type(j) = 'OBJECT' THEN json_extract_string(j, '$.options') END AS options_text
      FROM (SELECT event_id, ok, CASE WHEN ok THEN b ELSE 'null' END AS j
            FROM (SELECT event_id, b, json_valid(b) AS ok FROM (SELECT event_id, {body} AS b FROM events)))"""


@query("s4_parse_requests", sql=_requests_sql)
def s4_parse_requests(spark, sf_dir):
    """Request bodies → typed requests; bad JSON / non-objects / no options rejected."""
    e = Tables(spark, sf_dir).events.select("event_id", _request_body().alias("body"))
    ok, rejected = R.parse_requests(e)
    cols = ["event_id", "reason", "state", "question", "options_text"]
    okc = ok.select("event_id", F.lit(None).cast("string").alias("reason"), "state", "question", "options_text")
    bad = rejected.select(
        "event_id", "reason",
        F.when(F.col("reason") == "missing options", F.col("state")).otherwise(F.lit("")).alias("state"),
        F.when(F.col("reason") == "missing options", F.col("question")).otherwise(F.lit("")).alias("question"),
        "options_text",
    )
    return okc.unionByName(bad).select(*cols)


HARD_BATCHES = {
    0: ('["a", "b "]', ["a", "b "], None),
    1: ('["a", "b"] junk', None, "invalid JSON array"),
    2: ('[null, true, false, "null"]', ["None", "True", "False", "null"], None),
    3: ("[]", None, "empty batch"),
    4: ("  ", None, "empty batch"),
    5: ("x\n\n y \n\n", ["x", "y"], None),
    6: ('["a"]["b"]', None, "invalid JSON array"),
    7: ('["a"', None, "invalid JSON array"),
}
HARD_REQUESTS = {
    0: ('{"options": "A: x", "state": "s"}', None, "A: x"),
    1: ('{"options": "A: x"} junk}', "invalid JSON", None),
    2: ('{"options": "A: x"}{"options": "A: y"}', "invalid JSON", None),
    3: ('{"options": "A: x", "options": "B: y"}', None, "B: y"),
    4: ("{'options': 'A: x'}", "invalid JSON", None),
    5: ('"options"', "not an object", None),
    6: ('{"options": ""}', "missing options", ""),
    7: ('{"options": "A: x"}]', "invalid JSON", None),
}
_OPTS = '"options": [{"label": "A", "key": "k", "description": "d"}, {"label": "B", "key": "m", "description": "e"}]'
HARD_BODIES = {
    0: ('{"state": "s", "question": "q", ' + _OPTS + ', "answer": "A"}', None),
    1: ('{"state": "s", "question": "q", ' + _OPTS + ', "answer": "A"} trailing', "invalid_json"),
    2: ('"text": 1}', "invalid_json"),
    3: ('{"state": "s", "question": "q", ' + _OPTS + ', "answer": "Z", "answer": "B"}', None),
    4: ('{"state": "s", "question": "q", ' + _OPTS + ', "answer": "A", "answer": "Z"}', "answer_not_in_labels"),
    5: ('{"state": "s"}{"state": "t"}', "invalid_json"),
}


def _pick(cases: dict, key):
    return F.element_at(F.array(*[F.lit(c[0]) for c in cases.values()]), (key % len(cases) + 1).cast("int"))


def _pick_sql(cases: dict, key: str, at: int) -> str:
    vals = ", ".join("NULL" if c[at] is None else sql_str(c[at]) for c in cases.values())
    return f"([{vals}])[{key} % {len(cases)} + 1]"


@query(
    "s3_hard_batches",
    sql=lambda: "SELECT event_id, CAST(NULL AS INTEGER) AS item_no, NULL AS state, "
    f"{_pick_sql(HARD_BATCHES, 'event_id', 2)} AS error FROM events WHERE {_pick_sql(HARD_BATCHES, 'event_id', 2)} IS NOT NULL"
    + "".join(
        f" UNION ALL SELECT event_id, {n + 1}, {sql_str(s)}, NULL FROM events WHERE event_id % {len(HARD_BATCHES)} = {k}"
        for k, c in HARD_BATCHES.items() if c[1] for n, s in enumerate(c[1])
    ),
)
def s3_hard_batches(spark, sf_dir):
    """S3 on trailing text, several documents, non-string elements and empty batches."""
    e = Tables(spark, sf_dir).events.select("event_id", _pick(HARD_BATCHES, F.col("event_id")).alias("blob"))
    ok, err = R.split_states(e, "blob", "event_id")
    none = F.lit(None)
    return ok.select("event_id", F.col("item_no").cast("int").alias("item_no"), "state", none.cast("string").alias("error")).unionByName(
        err.select("event_id", none.cast("int").alias("item_no"), none.cast("string").alias("state"), "error")
    )


@query(
    "s4_hard_requests",
    sql=lambda: f"SELECT event_id, {_pick_sql(HARD_REQUESTS, 'event_id', 1)} AS reason, "
    f"{_pick_sql(HARD_REQUESTS, 'event_id', 2)} AS options_text FROM events",
)
def s4_hard_requests(spark, sf_dir):
    """S4 on trailing text, two documents, repeated keys, single quotes and bare strings."""
    e = Tables(spark, sf_dir).events.select("event_id", _pick(HARD_REQUESTS, F.col("event_id")).alias("body"))
    ok, bad = R.parse_requests(e)
    return ok.select("event_id", F.lit(None).cast("string").alias("reason"), "options_text").unionByName(
        bad.select("event_id", "reason", "options_text")
    )


@query(
    "f1_hard_bodies",
    sql=lambda: f"SELECT event_id, {_pick_sql(HARD_BODIES, 'event_id', 1)} AS rule FROM events "
    f"WHERE {_pick_sql(HARD_BODIES, 'event_id', 1)} IS NOT NULL",
)
def f1_hard_bodies(spark, sf_dir):
    """F1 on trailing text, a bare member, two documents and repeated keys."""
    e = Tables(spark, sf_dir).events.select("event_id", _pick(HARD_BODIES, F.col("event_id")).alias("body"))
    return V.validate(V.parse_records(e), "event_id").select("event_id", "rule")


# ---- S6 / S7 / S5 ---------------------------------------------------------------------


@query(
    "s6_head_n",
    sql="SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100",
)
def s6_head_n(spark, sf_dir):
    """The first 100 records in key order (a bounded top-k)."""
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_totalprice")
    return R.head_n(o, 100, ["o_orderkey"])


@query("s7_catalogue", sql="SELECT count(*) AS count FROM orders")
def s7_catalogue(spark, sf_dir):
    """Ticket catalogue count."""
    return R.catalogue(X.ticket_set(Tables(spark, sf_dir).orders))


@query(
    "s7_listing",
    sql=lambda: f"SELECT id, category, tag, md5(state) AS state_md5, array_to_string(list_transform(options, lambda o: o.label), ',') AS labels, expected FROM ({O.ticket_set()})",
)
def s7_listing(spark, sf_dir):
    """The tickets themselves."""
    t = R.listing(X.ticket_set(Tables(spark, sf_dir).orders))
    return t.select("id", "category", "tag", F.md5("state").alias("state_md5"), F.array_join("labels", ",").alias("labels"), "expected")


# ---- F1 / F2 / A10 / A1 -------------------------------------------------------------------


def _corrupt_sql() -> str:
    return f"""SELECT rec_id, split, rec_id % 7 AS defect, CAST(CASE rec_id % 7
        WHEN 0 THEN json_object('state', state, 'question', question, 'options', options, 'answer', answer)
        WHEN 1 THEN json_object('question', question, 'options', options, 'answer', answer)
        WHEN 2 THEN json_object('state', NULL, 'question', question, 'options', options, 'answer', answer)
        WHEN 3 THEN json_object('state', state, 'question', 42, 'options', options, 'answer', answer)
        WHEN 4 THEN json_object('state', state, 'question', question, 'options', options[1:1], 'answer', answer)
        WHEN 5 THEN json_object('state', state, 'question', question, 'options',
             json_array(options[1], json_object('label', options[2].label, 'key', options[2].key)), 'answer', answer)
        ELSE json_object('state', state, 'question', question, 'options', options, 'answer', 'Z') END AS VARCHAR) AS body
      FROM ({O.d_set()})"""


def _violations_sql() -> str:
    bad = "(coalesce(json_type(body, '$.options'), '') <> 'ARRAY' OR json_array_length(body, '$.options') < 2)"
    complete = "(json_type(e) = 'OBJECT' AND list_has_all(json_keys(e), ['label', 'key', 'description']))"
    ans = """CASE WHEN NOT list_contains(json_keys(body), 'answer') THEN ''
        WHEN json_type(body, '$.answer') = 'NULL' THEN 'NONE' ELSE upper(json_extract_string(body, '$.answer')) END"""

    def empty(f):
        return (
            f"SELECT rec_id, split, 'empty_field' AS rule, '{f}' AS detail FROM c WHERE coalesce(json_type(body, '$.{f}'), '') <> 'VARCHAR' "
            f"OR trim(json_extract_string(body, '$.{f}'), {WS}) = ''"
        )

    return f"""WITH c AS ({_corrupt_sql()}),
      o AS (SELECT rec_id, split, i, json_extract(body, '$.options[' || i || ']') AS e
            FROM (SELECT rec_id, split, body, unnest(range(CAST(json_array_length(body, '$.options') AS BIGINT))) AS i FROM c WHERE NOT {bad})),
      seen AS (SELECT rec_id, list(upper(json_extract_string(e, '$.label'))) FILTER (WHERE {complete}) AS labels FROM o GROUP BY rec_id)
      SELECT rec_id, split, 'missing_field' AS rule, f AS detail
        FROM (SELECT rec_id, split, body, unnest(['state', 'question', 'options', 'answer']) AS f FROM c)
        WHERE NOT list_contains(json_keys(body), f)
      UNION ALL {empty('state')}
      UNION ALL {empty('question')}
      UNION ALL SELECT rec_id, split, 'bad_options', 'options must be a list with >= 2 entries' FROM c WHERE {bad}
      UNION ALL SELECT rec_id, split, 'bad_option', CAST(i AS VARCHAR) FROM o WHERE NOT {complete}
      UNION ALL SELECT c.rec_id, c.split, 'answer_not_in_labels', {ans}
        FROM c LEFT JOIN seen ON c.rec_id = seen.rec_id
        WHERE NOT {bad} AND NOT coalesce(list_contains(seen.labels, {ans}), false)"""


def _violations(spark, sf_dir):
    t = Tables(spark, sf_dir)
    c = V.parse_records(X.corrupt_set(t.documents, t.labels))
    return V.validate(c, "rec_id", ["split"])


@query("f1_validate", sql=_violations_sql)
def f1_validate(spark, sf_dir):
    """one row per violation on records with seeded defects."""
    return _violations(spark, sf_dir)


@query(
    "f2_violation_totals",
    sql=lambda: f"SELECT split, count(*) AS n_violations FROM ({_violations_sql()}) GROUP BY split",
)
def f2_violation_totals(spark, sf_dir):
    """violations per split (the gate fails every split listed)."""
    return V.violation_totals(_violations(spark, sf_dir))


@query(
    "a10_violation_counts",
    sql=lambda: f"""SELECT split, rule, count(*) AS n, CAST(grouping(split, rule) AS BIGINT) AS gid
      FROM ({_violations_sql()}) GROUP BY ROLLUP (split, rule)""",
)
def a10_violation_counts(spark, sf_dir):
    """A10: rollup of violations by split and rule."""
    return M.violation_counts(_violations(spark, sf_dir)).withColumn("gid", F.col("gid").cast("long"))


@query(
    "a1_label_distribution",
    sql=lambda: f"""SELECT split, CASE WHEN NOT list_contains(json_keys(body), 'answer') THEN ''
        WHEN json_type(body, '$.answer') = 'NULL' THEN 'NONE' ELSE upper(json_extract_string(body, '$.answer')) END AS label,
        count(*) AS n
      FROM ({_corrupt_sql()})
      WHERE json_type(body, '$.options') = 'ARRAY' AND json_array_length(body, '$.options') >= 2 GROUP BY 1, 2""",
)
def a1_label_distribution(spark, sf_dir):
    """A1: answer distribution per split (records failing the options rule skipped)."""
    t = Tables(spark, sf_dir)
    return V.parsed_label_distribution(V.parse_records(X.corrupt_set(t.documents, t.labels)))


# ---- F3 / F6 --------------------------------------------------------------------------


@query(
    "f3_check_tickets",
    sql=lambda: f"""SELECT count(*) AS n, count(*) - count(DISTINCT id) AS duplicate_ids,
        count(*) - count(DISTINCT sha256(state)) AS duplicate_states,
        sum(CASE WHEN trim(state, {WS}) = '' THEN 1 ELSE 0 END) AS blank_states,
        sum(CASE WHEN trim(question, {WS}) = '' THEN 1 ELSE 0 END) AS blank_questions,
        sum(CASE WHEN len(options) < 2 THEN 1 ELSE 0 END) AS few_options,
        sum(CASE WHEN NOT list_contains(list_transform(options, lambda o: o.label), expected) THEN 1 ELSE 0 END) AS expected_not_in_labels,
        sum(CASE WHEN len(list_distinct(list_transform(options, lambda o: o.label))) <> len(options) THEN 1 ELSE 0 END) AS duplicate_labels,
        len(list_filter(['Invoice / PO', 'Reconciliation', 'Triage', 'Adversarial'],
            lambda c: NOT list_contains(list(DISTINCT category), c))) AS missing_categories
      FROM ({O.ticket_set()})""",
)
def f3_check_tickets(spark, sf_dir):
    """ticket contract checks over the generated set, all four categories required."""
    return V.check_tickets(
        X.ticket_set(Tables(spark, sf_dir).orders),
        ["Invoice / PO", "Reconciliation", "Triage", "Adversarial"],
    )


@query(
    "f6_reject_blank",
    sql=f"""SELECT CASE WHEN text IS NULL OR trim(text, {WS}) = '' THEN 'blank text' END AS reason,
        role, count(*) AS n FROM conversations GROUP BY 1, 2""",
)
def f6_reject_blank(spark, sf_dir):
    """blank-input quarantine over conversation turns, counted by reason."""
    c = V.reject_blank(Tables(spark, sf_dir).conversations, ["text"])
    return c.groupBy("reason", "role").agg(F.count(F.lit(1)).alias("n"))


# ---- P1 / P2 / P3 / P4 ------------------------------------------------------------------


def _strict_text():
    k = F.col("p_partkey") % 4
    return (
        F.when(k == 0, F.concat(F.lit("a:"), F.col("p_brand"), F.lit("|B:"), F.col("p_type"), F.lit(":"), F.col("p_name")))
        .when(k == 1, F.concat(F.col("p_brand"), F.lit(" | "), F.col("p_type"), F.lit("|")))
        .when(k == 2, F.concat(F.lit("A:"), F.col("p_brand"), F.lit("|a:"), F.col("p_type")))
        .otherwise(F.lit(" | "))
    )


STRICT_SQL = """CASE p_partkey % 4 WHEN 0 THEN 'a:' || p_brand || '|B:' || p_type || ':' || p_name
  WHEN 1 THEN p_brand || ' | ' || p_type || '|' WHEN 2 THEN 'A:' || p_brand || '|a:' || p_type ELSE ' | ' END"""


def _lenient_text():
    k = F.col("p_partkey") % 4
    nl = F.lit("\n")
    return (
        F.when(k == 0, F.concat(F.col("p_brand"), nl, F.col("p_type"), F.lit("|:"), F.col("p_name")))
        .when(k == 1, F.concat(F.lit("x:"), F.col("p_brand"), nl, F.lit("y: "), F.col("p_type"), F.lit(": "), F.col("p_name"), F.lit("|z:")))
        .when(k == 2, F.col("p_brand"))
        .otherwise(F.concat(F.lit("A:"), F.col("p_brand"), F.lit("|a:"), F.col("p_type")))
    )


LENIENT_SQL = """CASE p_partkey % 4 WHEN 0 THEN p_brand || chr(10) || p_type || '|:' || p_name
  WHEN 1 THEN 'x:' || p_brand || chr(10) || 'y: ' || p_type || ': ' || p_name || '|z:'
  WHEN 2 THEN p_brand ELSE 'A:' || p_brand || '|a:' || p_type END"""


def _parsed(spark, sf_dir, parsed):
    """The parts with their option text parsed; parsed once a row, also where a filter reads the error."""
    parts = spread(Tables(spark, sf_dir).part.select("p_partkey", "p_brand", "p_type", "p_name"))
    # A one-element array that is exploded: a filter on the error is not pushed down to parse a second time.
    return parts.select("p_partkey", F.explode(F.array(parsed)).alias("p"))


def _exploded(parsed_df):
    return parsed_df.select(
        "p_partkey", F.col("p.error").alias("error"), F.posexplode_outer("p.options").alias("pos", "o")
    ).select("p_partkey", "error", "pos", "o.label", "o.key", "o.description")


def _strict_sql() -> str:
    s = f"trim(x, {WS})"
    seg = f"""SELECT p_partkey, txt, segs, pos, seg,
        strpos(seg, ':') > 0 AS has,
        trim(substr(seg, strpos(seg, ':') + 1), {WS}) AS rest
      FROM (SELECT p_partkey, txt, segs, unnest(generate_series(0, len(segs) - 1)) AS pos, unnest(segs) AS seg
            FROM (SELECT p_partkey, txt, list_filter(list_transform(string_split(txt, '|'), lambda x: {s}), lambda x: x <> '') AS segs
                  FROM (SELECT p_partkey, {STRICT_SQL} AS txt FROM part)))"""
    return f"""WITH s AS ({seg}),
      o AS (SELECT p_partkey, pos,
          CASE WHEN has THEN upper(trim(substr(seg, 1, strpos(seg, ':') - 1), {WS})) ELSE upper(seg) END AS label,
          CASE WHEN has AND strpos(rest, ':') > 0 THEN trim(substr(rest, 1, strpos(rest, ':') - 1), {WS}) WHEN has THEN rest ELSE seg END AS key,
          CASE WHEN has AND strpos(rest, ':') > 0 THEN trim(substr(rest, strpos(rest, ':') + 1), {WS}) WHEN has THEN rest ELSE seg END AS description
        FROM s),
      e AS (SELECT p_partkey, CASE WHEN trim(txt, {WS}) = '' THEN 'options string must not be empty'
          WHEN len(segs) = 0 THEN 'could not parse options' END AS e0 FROM (SELECT p_partkey, {STRICT_SQL} AS txt,
          list_filter(list_transform(string_split({STRICT_SQL}, '|'), lambda x: {s}), lambda x: x <> '') AS segs FROM part)),
      d AS (SELECT p_partkey, count(*) <> count(DISTINCT label) AS dup FROM o GROUP BY 1),
      err AS (SELECT e.p_partkey, coalesce(e0, CASE WHEN d.dup THEN 'duplicate option labels' END) AS error
        FROM e LEFT JOIN d ON e.p_partkey = d.p_partkey)
      SELECT err.p_partkey, err.error, o.pos, o.label, o.key, o.description
        FROM err JOIN o ON err.p_partkey = o.p_partkey WHERE err.error IS NULL
      UNION ALL SELECT p_partkey, error, NULL, NULL, NULL, NULL FROM err WHERE error IS NOT NULL"""


@query("p1_parse_strict", sql=_strict_sql)
def p1_parse_strict(spark, sf_dir):
    """Strict option strings → option rows, or one error row per string."""
    p = _parsed(spark, sf_dir, parse_options_strict(_strict_text()))
    return _exploded(p)


def _lenient_sql() -> str:
    s = f"trim(x, {WS})"
    return f"""WITH s AS (
        SELECT p_partkey, segs, pos, seg, strpos(seg, ':') > 0 AS has,
          trim(substr(seg, 1, strpos(seg, ':') - 1), {WS}) AS head, substr(seg, strpos(seg, ':') + 1) AS rest
        FROM (SELECT p_partkey, segs, unnest(generate_series(0, len(segs) - 1)) AS pos, unnest(segs) AS seg
              FROM (SELECT p_partkey, list_filter(list_transform(string_split(replace({LENIENT_SQL}, '|', chr(10)), chr(10)), lambda x: {s}), lambda x: x <> '') AS segs FROM part))),
      o1 AS (SELECT p_partkey, pos, has AND head <> '' AS labelled, has, head, rest, seg, strpos(rest, ':') > 0 AS rest_has FROM s),
      o2 AS (SELECT p_partkey, pos,
          CASE WHEN labelled THEN upper(head) ELSE chr(CAST(65 + pos AS INTEGER)) END AS label,
          CASE WHEN labelled THEN trim(CASE WHEN rest_has THEN substr(rest, 1, strpos(rest, ':') - 1) ELSE rest END, {WS})
               WHEN has THEN trim(rest, {WS}) ELSE seg END AS key0,
          CASE WHEN labelled AND rest_has THEN trim(substr(rest, strpos(rest, ':') + 1), {WS}) END AS desc0
        FROM o1),
      o AS (SELECT p_partkey, pos, label, CASE WHEN key0 = '' THEN label ELSE key0 END AS key,
          CASE WHEN desc0 IS NULL OR desc0 = '' THEN CASE WHEN key0 = '' THEN label ELSE key0 END ELSE desc0 END AS description FROM o2),
      agg AS (SELECT p_partkey, count(*) AS n, count(DISTINCT label) AS nd FROM o GROUP BY 1),
      err AS (SELECT part.p_partkey, CASE WHEN agg.n IS NULL THEN 'give at least two options'
          WHEN agg.n <> agg.nd THEN 'duplicate option label' WHEN agg.n < 2 THEN 'give at least two options' END AS error
        FROM part LEFT JOIN agg ON part.p_partkey = agg.p_partkey)
      SELECT err.p_partkey, err.error, o.pos, o.label, o.key, o.description
        FROM err JOIN o ON err.p_partkey = o.p_partkey WHERE err.error IS NULL
      UNION ALL SELECT p_partkey, error, NULL, NULL, NULL, NULL FROM err WHERE error IS NOT NULL"""


@query("p2_parse_lenient", sql=_lenient_sql)
def p2_parse_lenient(spark, sf_dir):
    """Lenient option text (pipes or lines, positional labels)."""
    p = _parsed(spark, sf_dir, parse_options_lenient(_lenient_text()))
    return _exploded(p)


def _fmt_line_sql(o: str) -> str:
    lab = f"upper(trim(coalesce({o}.label, ''), {WS}))"
    key = f"trim(coalesce({o}.key, ''), {WS})"
    desc = f"trim(coalesce({o}.description, ''), {WS})"
    return (
        f"CASE WHEN {desc} <> '' AND {key} <> '' AND {desc} <> {key} THEN {lab} || ': ' || {key} || ' — ' || {desc} "
        f"WHEN {key} <> '' THEN {lab} || ': ' || {key} ELSE {lab} END"
    )


@query(
    "p3_format_options",
    sql=lambda: f"""SELECT p_partkey, string_agg(line, chr(10) ORDER BY pos) AS options_block FROM (
        SELECT p_partkey, pos, {_fmt_line_sql('struct_pack(label := label, key := key, description := description)')} AS line
        FROM ({_strict_sql()}) WHERE error IS NULL) GROUP BY 1""",
)
def p3_format_options(spark, sf_dir):
    """Parsed option sets rendered as the prompt's options block."""
    p = _parsed(spark, sf_dir, parse_options_strict(_strict_text()))
    return p.where(F.col("p.error").isNull()).select(
        "p_partkey", format_options(F.col("p.options")).alias("options_block")
    )


@query(
    "p4_allowed_labels",
    sql=lambda: f"""SELECT id, array_to_string(list_transform(options, lambda o: upper(trim(o.label, {WS}))), ',') AS allowed
      FROM ({O.ticket_set()})""",
)
def p4_allowed_labels(spark, sf_dir):
    """Allowed-label set per ticket."""
    t = X.ticket_set(Tables(spark, sf_dir).orders)
    return t.select("id", F.array_join(allowed_labels("options"), ",").alias("allowed"))


# ---- P5 / P6 / P10 / P11 ------------------------------------------------------------------


def _prompt_sql(persona: str = DEFAULT_PERSONA) -> str:
    block = f"array_to_string(list_transform(options, lambda o: {_fmt_line_sql('o')}), chr(10))"
    return template_sql(
        PROMPT_TEMPLATE,
        {
            "persona": sql_str(persona),
            "state": f"trim(state, {WS})",
            "question": f"trim(question, {WS})",
            "options": block,
        },
    )


@query(
    "p5_render_prompt",
    sql=lambda: f"SELECT rec_id, md5(p) AS prompt_md5, length(p) AS prompt_len FROM (SELECT rec_id, {_prompt_sql()} AS p FROM ({O.d_set()}))",
)
def p5_render_prompt(spark, sf_dir):
    """P5: the prompt corpus (single-pass render; STATE is never re-expanded)."""
    t = Tables(spark, sf_dir)
    d = X.d_set(t.documents, t.labels)
    p = render_prompt("state", "question", format_options("options"))
    return d.select("rec_id", F.md5(p).alias("prompt_md5"), F.length(p).alias("prompt_len"))


@query(
    "p6_training_text",
    sql=lambda: f"""SELECT rec_id, md5(p || upper(trim(answer, {WS})) || chr(10)) AS text_md5,
        length(p || upper(trim(answer, {WS})) || chr(10)) AS text_len
      FROM (SELECT rec_id, answer, {_prompt_sql()} AS p FROM ({O.d_set()}))""",
)
def p6_training_text(spark, sf_dir):
    """Training text = prompt + answer label + newline."""
    t = Tables(spark, sf_dir)
    d = X.d_set(t.documents, t.labels)
    txt = render_training_text(render_prompt("state", "question", format_options("options")), "answer")
    return d.select("rec_id", F.md5(txt).alias("text_md5"), F.length(txt).alias("text_len"))


@query(
    "p10_preview",
    sql="SELECT doc_id, substr(replace(text, chr(10), ' '), 1, 160) AS preview FROM documents",
)
def p10_preview(spark, sf_dir):
    """P10: 160-character one-line previews."""
    d = Tables(spark, sf_dir).documents
    return d.select("doc_id", preview("text", 160).alias("preview"))


@query(
    "p11_ticket_tag",
    sql=lambda: f"SELECT id, coalesce(variant, adversarial, tag) AS display_tag FROM ({O.ticket_set()})",
)
def p11_ticket_tag(spark, sf_dir):
    """Ticket ids (T-nnn) and display tags."""
    t = X.ticket_set(Tables(spark, sf_dir).orders)
    return t.select("id", F.coalesce("variant", "adversarial", "tag").alias("display_tag"))
