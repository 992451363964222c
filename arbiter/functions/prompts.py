"""Prompt rendering (P5), training text (P6) and token-budget fitting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from arbiter.functions.options import format_options
from arbiter.functions.text import col_, norm_label, py_rstrip, py_strip, template, word_count
from arbiter.sources.catalogue import DEFAULT_PERSONA, PROMPT_TEMPLATE

# 0.7^48 shrinks any string below 80 characters from > 10^8 characters.
FIT_STEPS = 48


def render_prompt(
    state: Column | str,
    question: Column | str,
    options_block: Column,
    persona: str = DEFAULT_PERSONA,
) -> Column:
    """P5: one single-pass ``concat``; null state/question/options ⇒ null."""
    return template(
        PROMPT_TEMPLATE,
        {
            "persona": F.lit(persona),
            "state": py_strip(col_(state)),
            "question": py_strip(col_(question)),
            "options": options_block,
        },
    )


def render_training_text(prompt: Column, answer: Column | str) -> Column:
    """Prompt + upper(strip(answer)) + newline."""
    return F.concat(prompt, F.upper(py_strip(col_(answer))), F.lit("\n"))


def fit_state(
    state: Column | str,
    question: Column | str,
    options_block: Column,
    max_len: int = 1536,
    token_count: Callable[[Column], Column] = word_count,
    persona: str = DEFAULT_PERSONA,
) -> Column:
    """Shrink STATE by 0.7 steps (never below 40 chars, stop at 80) until
    the rendered prompt has at most ``max_len - 8`` tokens.

    A bounded ``aggregate`` fold inside Catalyst; rows that already fit skip it.
    Returns struct<prompt, n_tokens, truncated, state>.
    """
    limit = max_len - 8
    s0 = py_strip(col_(state))

    def render(s: Column) -> Column:
        return render_prompt(s, question, options_block, persona)

    # The accumulator carries the current token count and a "settled" flag, so
    # every step after the state fits is a no-op and each cut is counted once.
    def settled(s: Column, n: Column) -> Column:
        return (n <= limit) | (F.length(s) <= 80)

    def step(acc: Column, _i: Column) -> Column:
        s = acc["state"]
        cut = F.greatest(F.lit(40), F.floor(F.length(s) * F.lit(0.7).cast("double")).cast("int"))
        shrunk = py_rstrip(F.substring(s, 1, cut))
        n = token_count(render(shrunk))
        moved = F.struct(
            shrunk.alias("state"), n.alias("n"), F.lit(True).alias("truncated"), settled(shrunk, n).alias("done")
        )
        return F.when(acc["done"], acc).otherwise(moved)

    n0 = token_count(render(s0))
    init = F.struct(s0.alias("state"), n0.alias("n"), F.lit(False).alias("truncated"), settled(s0, n0).alias("done"))
    folded = F.aggregate(F.sequence(F.lit(1), F.lit(FIT_STEPS)), init, step)
    return F.struct(
        render(folded["state"]).alias("prompt"),
        folded["n"].alias("n_tokens"),
        folded["truncated"].alias("truncated"),
        folded["state"].alias("state"),
    )
