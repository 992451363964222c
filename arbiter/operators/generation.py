"""Generation hook (U1): a user's text generator, called once for each distinct prompt.

Prompts that are equal get one text: they are grouped by a digest first, the distinct ones are generated
in batches (``mapInPandas``, the factory once per task) and written, and the texts are joined back by
digest. A prompt that stands in a third of all rows costs one call and one key of a many-to-one join,
whose large side adaptive execution splits. What comes back is resolved to a label (D5).

Defined results: a null prompt is not generated: its text is null and its status invalid_output; a
generator that returns null for a prompt gives the same; no rows give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbiter.functions.labels import resolve_label
from arbiter.session import staged

Generator = Callable[[list[str]], list[str | None]]


def with_generator(
    df: DataFrame, factory: Callable[[], Generator], prompt: str = "prompt", out: str = "raw", batch: int = 32
) -> DataFrame:
    """``df`` with column ``out``: the text of ``factory()(prompts)`` for each row's prompt.

    The generator gets lists of at most ``batch`` different prompts and returns as many texts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = factory()
        for pdf in batches:
            for lo in range(0, len(pdf), batch):
                part = pdf[lo : lo + batch]
                texts = generate(part["_prompt"].tolist())
                if len(texts) != len(part):
                    raise ValueError(f"{len(part)} prompts, {len(texts)} texts")
                yield pd.DataFrame({"_digest": part["_digest"].to_numpy(), "_text": pd.Series(texts, dtype=object)})

    digest = F.sha2(F.col(prompt), 256)
    each = df.where(F.col(prompt).isNotNull()).groupBy(digest.alias("_digest")).agg(F.any_value(prompt).alias("_prompt"))
    texts = staged(each.mapInPandas(run, "_digest string, _text string"), "generated")
    rows = df.withColumn("_digest", digest)
    return rows.join(texts, "_digest", "left").drop("_digest").withColumnRenamed("_text", out)


def generated_labels(
    df: DataFrame, factory: Callable[[], Generator], prompt: str = "prompt", allowed: str = "labels", batch: int = 32
) -> DataFrame:
    """``df`` with raw, label and status: the generated text and the allowed label found in it."""
    rows = with_generator(df, factory, prompt, "raw", batch)
    r = resolve_label(F.col("raw"), F.col(allowed))
    return rows.withColumn("_r", r).select("*", "_r.label", "_r.status").drop("_r")


def phrase_stub_factory() -> Generator:
    """A deterministic stand-in model: one of six phrases around the label A, B or C, by prompt length."""

    def one(p: str) -> str:
        label = "ABC"[len(p) % 3]
        return [label, f" {label.lower()}\n", f"Answer: {label}", f"The label is {label}.", "I cannot tell", ""][len(p) % 7 % 6]

    return lambda prompts: [one(p) for p in prompts]
