"""Pluggable scorer hook (U1): bring your own model.

``with_scorer`` runs a user scorer over (prompt, labels) rows with
``mapInArrow``: the factory is called once per task (load weights once per
worker process, not per row), rows arrive as Arrow batches
(``spark.sql.execution.arrow.maxRecordsPerBatch``), prompts become Python
strings ``PIECE_ROWS`` rows at a time and the output is the
long (key, pos, label, logp) table the softmax/ranking operators take.
This is the only place Python runs on executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

SCORES_SCHEMA = "{key} long, pos int, label string, logp double"

#: Rows whose prompts a worker holds as Python strings at once; a call of the scorer gets their options.
PIECE_ROWS = 500
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"

Scorer = Callable[[pd.Series, pd.Series], pd.Series]


def with_scorer(
    df: DataFrame,
    factory: Callable[[], Scorer],
    key: str = "rec_id",
    prompt: str = "prompt",
    labels: str = "labels",
) -> DataFrame:
    """``factory()`` returns ``score(prompts, labels) -> logp`` working on
    aligned pandas Series (one element per (row, option))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = factory()
        for batch in batches:
            long = batch.select([key, labels]).to_pandas().explode(labels)
            long = long[long[labels].notna()]
            pos = long.groupby(key, sort=False).cumcount().astype("int32")
            for at in range(0, batch.num_rows, PIECE_ROWS):
                part = (long.index >= at) & (long.index < at + PIECE_ROWS)
                texts = batch.column(prompt).slice(at, PIECE_ROWS).to_pandas()
                options = long[labels][part].reset_index(drop=True)
                logp = score(texts.iloc[long.index[part] - at].reset_index(drop=True), options).astype("float64")
                columns = [
                    pa.array(long[key][part].astype("int64"), pa.int64()),
                    pa.array(pos[part], pa.int32()),
                    pa.array(options.astype(str), pa.string()),
                    pa.array(logp, pa.float64(), from_pandas=True),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "pos", "label", "logp"])
            pa.default_memory_pool().release_unused()

    # As in the pipeline: a batch on its way to a worker is as small as a piece, however many rows a task has.
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_CONF)) <= PIECE_ROWS:
        conf.set(BATCH_CONF, str(PIECE_ROWS))
    return df.select(key, prompt, labels).mapInArrow(run, SCORES_SCHEMA.format(key=key))


def length_stub_factory() -> Scorer:
    """A deterministic stand-in model: logp = −((len(prompt) + 3·code(label[0])) mod 11)."""

    def score(prompts: pd.Series, labels: pd.Series) -> pd.Series:
        codes = labels.str.slice(0, 1).map(ord)
        return -((prompts.str.len() + 3 * codes) % 11).astype("float64")

    return score
