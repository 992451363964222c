"""The second scoring backend (M1): logistic regression over hashed token counts, a saved Spark ML pipeline.

Tokens are hashed to a fixed number of positions, so the model has the same size whatever the
vocabulary: no vocabulary table, no join by token. A text becomes one sparse vector where it is read;
scoring is a projection. Fitting sums gradients over the tasks (a tree aggregate); the driver holds
``positions`` x classes weights, whatever the number of rows.

Defined results: null and empty texts have no tokens and get the intercepts' scores; training rows
without a label are left out; a training table without labels is an error; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbiter.functions.text import tokens
from arbiter.session import staged

#: Positions that tokens are hashed to, and the fit's bounds.
POSITIONS, ROUNDS, PENALTY = 1 << 16, 50, 0.001


def _tokenized(df: DataFrame, text: str, *columns) -> DataFrame:
    none = F.array().cast("array<string>")
    return df.select(*columns, F.coalesce(tokens(text), none).alias("_tokens"))


def fit_linear(
    train: DataFrame, path: str, text: str = "state", label: str = "answer", positions: int = POSITIONS
) -> str:
    """Fit on ``train`` alone and save the whole pipeline (hashing, label names, weights) under ``path``."""
    hashing = HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=positions)
    rows = _tokenized(train.where(F.col(label).isNotNull()), text, F.col(label).cast("string").alias("_label"))
    # The vectors are written once: label names, feature spreads and gradients read them, not the texts.
    counts = staged(hashing.transform(rows).select("_label", "_counts"), "linear-counts")
    if counts.isEmpty():
        raise ValueError("no labelled training rows")
    indexer = StringIndexer(inputCol="_label", outputCol="_class", stringOrderType="alphabetAsc").fit(counts)
    regression = LogisticRegression(
        featuresCol="_counts", labelCol="_class", probabilityCol="_probability", family="multinomial",
        maxIter=ROUNDS, regParam=PENALTY,
    ).fit(indexer.transform(counts))
    PipelineModel([hashing, indexer, regression]).write().save(path)
    return path


def score_linear(docs: DataFrame, path: str, key: str = "rec_id", text: str = "state") -> DataFrame:
    """(key, label, logp) of every row for every label, by the pipeline saved under ``path``."""
    model = PipelineModel.load(path)
    names = F.array(*[F.lit(name) for name in model.stages[1].labelsArray[0]])
    scored = model.transform(_tokenized(docs, text, F.col(key).alias("_key")))
    pairs = F.arrays_zip(names.alias("label"), vector_to_array("_probability").alias("p"))
    out = scored.select(F.col("_key").alias(key), F.explode(pairs).alias("s"))
    # A probability too small for a double keeps a finite logarithm.
    return out.select(key, "s.label", F.log(F.greatest("s.p", F.lit(5e-324))).alias("logp"))
