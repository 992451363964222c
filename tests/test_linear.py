"""The linear backend: fitted on train only, saved and reloaded, every row scored."""

from __future__ import annotations

import math

import pytest
from conftest import SF01
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from arbiter.operators import linear
from arbiter.plans import load_all
from arbiter.sources.records import scratch_path

TRAIN = [(1, "good clean text", "A"), (2, "clean good words", "A"), (3, "bad noise junk", "B"), (4, "junk bad bad", "B"), (5, "good", None)]
SCHEMA = "rec_id long, state string, answer string"


def test_reloaded_pipeline_scores_every_row(spark):
    train = spark.createDataFrame(TRAIN, SCHEMA)
    path = linear.fit_linear(train, scratch_path(spark, "linear"), positions=256)
    rows = [(1, "good words"), (2, "bad junk"), (3, None), (4, ""), (4, ""), (5, "good " * 200_000), (6, "never seen before")]
    docs = spark.createDataFrame(rows, "rec_id long, state string").withColumn("label", F.lit("own")).withColumn("_tokens", F.lit(1))
    out = linear.score_linear(docs, path).collect()
    assert len(out) == 2 * len(rows) and {r.label for r in out} == {"A", "B"}
    assert all(math.isfinite(r.logp) for r in out)
    p = {(r.rec_id, r.label): math.exp(r.logp) for r in out}
    assert p[1, "A"] > 0.5 > p[1, "B"] and p[2, "B"] > 0.5 and p[5, "A"] > 0.5
    assert all(abs(p[k, "A"] + p[k, "B"] - 1) < 1e-9 for k in range(1, 7))
    assert p[3, "A"] == p[4, "A"]
    # The scores are those of the weights: softmax of the summed weights of the hashed tokens.
    model = PipelineModel.load(path)
    hashing, _, lr = model.stages
    z = [lr.interceptVector[c] + sum(lr.coefficientMatrix[c, hashing.indexOf(t)] for t in ("good", "words")) for c in (0, 1)]
    assert abs(p[1, "A"] - math.exp(z[0]) / (math.exp(z[0]) + math.exp(z[1]))) < 1e-9
    assert linear.score_linear(docs.limit(0), path).count() == 0


def test_training_texts_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(text):
        seen.add(1)
        return text

    train = spark.createDataFrame(TRAIN[:4], SCHEMA).withColumn("state", F.udf(count, "string")("state"))
    linear.fit_linear(train, scratch_path(spark, "linear"), positions=256)
    assert seen.value == 4


def test_no_labels_is_an_error(spark):
    with pytest.raises(ValueError, match="no labelled"):
        linear.fit_linear(spark.createDataFrame([(1, "x", None)], SCHEMA), scratch_path(spark, "linear"))


def test_compared_with_naive_bayes(spark):
    rows = {r.split: r for r in load_all()["m1_linear_compare"].build(spark, SF01).collect()}
    assert set(rows) == {"train", "valid", "test"}
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    assert sum(r.n for r in rows.values()) == labels.join(docs, "doc_id").count()
    for split in ("valid", "test"):
        r = rows[split]
        print(split, r)
        assert r.tuned_invalid_rate == 0 and r.tuned_accuracy >= r.base_accuracy - 0.02
        assert r.fixed - r.broken == round((r.tuned_accuracy - r.base_accuracy) * r.n)
