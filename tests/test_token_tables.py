"""Token tables: broadcast where frequent, joined where rare, the same scores and masks either way."""

from __future__ import annotations

from conftest import SF001

from arbiter.functions.text import TOKEN_SPLIT
from arbiter.operators import scoring as S
from arbiter.plans import load_all

LONG = "x" * 300
TRAIN = [(1, "a a a b c", "A"), (2, "a b b d", "B"), (3, f"{LONG} a", "B")]
DOCS = [(1, "a b c d e"), (2, "e e"), (3, None), (4, ""), (5, f"{LONG} {LONG}y c"), (6, "a " * 5000)]


def _scores(spark):
    fitted = S.fit_nb(spark.createDataFrame(TRAIN, "rec_id long, state string, answer string"))
    docs = spark.createDataFrame(DOCS, "rec_id long, state string")
    return S.score_nb(docs, fitted)


def _rounded(df):
    return sorted((r.rec_id, r.label, round(r.logp, 6)) for r in df.collect())


def test_scores_do_not_depend_on_what_is_broadcast(spark, monkeypatch):
    whole = _rounded(_scores(spark))
    assert len(whole) == 2 * len(DOCS)
    row = S.TOKEN_BYTES + 8 * 8
    for rows in (0, 1, 2, 4):
        monkeypatch.setattr(S, "HOT_BYTES", rows * row)
        assert _rounded(_scores(spark)) == whole


def test_masks_do_not_depend_on_what_is_broadcast(spark, monkeypatch):
    build = load_all()["p8_mask_examples"].build
    whole = sorted(tuple(r) for r in build(spark, SF001).collect())
    monkeypatch.setattr(S, "HOT_BYTES", 4_000)
    assert sorted(tuple(r) for r in build(spark, SF001).collect()) == whole


def test_tokens_are_no_shuffle_key_while_the_model_fits(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _scores(spark)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "hashpartitioning(_token" not in plan and "hashpartitioning(token" not in plan


def test_texts_are_split_once_when_the_model_does_not_fit(spark, monkeypatch):
    """Both parts of the model read the written tokens, not the texts."""
    monkeypatch.setattr(S, "HOT_BYTES", S.TOKEN_BYTES + 8 * 8)
    for df in (_scores(spark), load_all()["p8_mask_examples"].build(spark, SF001)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Union" in plan and TOKEN_SPLIT not in plan
