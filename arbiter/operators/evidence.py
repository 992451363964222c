"""Evidence extraction from STATE text (D7): the text → facts route.

Regular-expression extracts only; the facts feed the same reconciliation
rules (D1) as structured tickets. One projection, no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbiter.functions.labels import resolve_label
from arbiter.operators.rules import conclude_recon, option_for
from arbiter.sources.catalogue import ABSTAIN_TEXT
from arbiter.sources.fixtures import facts

# FIXED VALUES: cue patterns of the finance record and ticket texts.
# An amount is "1250.00 EUR", "EUR 1250.00" or a symbol form "€1.250,00" /
# "$1,250.00": after € the dot groups thousands and the comma is decimal,
# after $ and £ the other way round.
AMOUNT = r"(\d+(?:\.\d+)?) (EUR|USD|GBP)|(EUR|USD|GBP) (\d+(?:\.\d+)?)|([€$£])(\d[\d.,]*\d|\d)"
SYMBOL_CURRENCY = {"€": "EUR", "$": "USD", "£": "GBP"}
TOLERANCE = r"(?:differences up to|allows up to) (\d+(?:\.\d+)?)"
BILLED_IN = r"billed in (EUR|USD|GBP)"
IS_IN = r"is in (EUR|USD|GBP)"
CONFLICT = r"currency differs \((EUR|USD|GBP) vs (EUR|USD|GBP)\)"
# One match a stop: group 1 is AMOUNT's match, or empty where a character that could begin one begins none. Runs of
# characters that begin none are passed over in one tight loop (a plain ASCII set is a table look-up; ranges,
# look-aheads and attempts at every character are not). After digits that begin no amount the rest of them do not
# either. \\z lets the last run match: a run that ended in a failed attempt would be tried again from every character.
_NO_AMOUNT = "[" + "".join(re.escape(c) for c in map(chr, [*b"\t\n\r", *range(32, 127)]) if c not in "0123456789EUG$") + "]*"
AMOUNT_STOPS = (
    rf"(?s){_NO_AMOUNT}(?:({re.sub(r'[(](?![?])', '(?:', AMOUNT)})"
    rf"|(?:\d+|[EUG$]|[^\x00-\x7F€£]+){_NO_AMOUNT}|.|\z)"
)
DUPLICATE = r"(?i)already paid|arrived again|already cleared|reappeared"
MISSING = (
    r"(?i)no reference|no invoice reference|no invoice link|unreadable|timed out|smudged|two active records"
    r"|does not exist|signature is missing|inconclusive"
)


def _opt(pattern: str, group: int, text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _symbol_amount(symbol: Column, digits: Column) -> Column:
    """Locale digits → plain decimal text, decided by the currency symbol."""
    euro = F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    other = F.replace(digits, F.lit(","), F.lit(""))
    return F.when(symbol == "€", euro).otherwise(other)


# English letters from the most frequent to the rarest.
_LETTERS = "etaoinshrdlcumwfgypbvkjxqz"


def phrase_search(pattern: str) -> str:
    """A pattern that finds what ``pattern``, an "(?i)" alternation of plain phrases, finds, in fewer steps a character.

    Every phrase is looked for at its rarest letter. Characters that are no such letter (Latin-1 ones by a table
    look-up) are passed over in one tight loop; an alternation would try all phrases at every character. The
    loop over the letters is possessive: no recursion, so no limit on the length of a text.
    """
    phrases = pattern.removeprefix("(?i)").split("|")
    at = [max(range(len(p)), key=lambda k, p=p: _LETTERS.find(p[k])) for p in phrases]
    letters = "".join(sorted({p[k] for p, k in zip(phrases, at)}))
    skip = "[" + "".join(f"\\x{c:02x}" for c in range(256) if chr(c).lower() not in letters) + "]*"
    hit = "|".join(f"{p[k:]}(?<={p})" for p, k in zip(phrases, at))
    return rf"(?si)\A(?>{skip})(?:(?:(?!{hit})[{letters}]|[^\x00-\xff]+){skip})*+[{letters}]"


def _cue(text: Column, pattern: str) -> Column:
    return F.regexp(text, F.lit(phrase_search(pattern)))


def amount_matches(state: Column) -> Column:
    """Every amount of a text as it is written, in text order across the three amount forms."""
    return F.array_remove(F.regexp_extract_all(state, F.lit(AMOUNT_STOPS), F.lit(1)), "")


def _amount(m: Column) -> Column:
    """The number of one match as plain decimal text: number first, code first, or symbol first."""
    first = F.substring(m, 1, 1)
    return (
        F.when(first.between("0", "9"), F.substring_index(m, " ", 1))
        .when(first.between("A", "Z"), F.substring_index(m, " ", -1))
        .otherwise(_symbol_amount(first, F.substr(m, F.lit(2))))
    )


def _currency(m: Column) -> Column:
    first = F.substring(m, 1, 1)
    symbol_cur = F.create_map(*[F.lit(x) for kv in SYMBOL_CURRENCY.items() for x in kv])
    return (
        F.when(first.between("0", "9"), F.substring_index(m, " ", -1))
        .when(first.between("A", "Z"), F.substring_index(m, " ", 1))
        .otherwise(F.element_at(symbol_cur, first))
    )


def extract_facts(state: Column, options: Column, matches: Column) -> Column:
    """facts struct from text: amounts a, b (first two, tolerance excluded),
    currencies, tolerance, duplicate / missing-reference cues. ``matches`` (``amount_matches``) is a
    column made before, as several fields read it."""
    one, two = F.get(matches, 0), F.get(matches, 1)
    # Both groups of CONFLICT have text wherever it matches.
    cur_a = F.coalesce(_opt(CONFLICT, 1, state), _opt(BILLED_IN, 1, state), _currency(one))
    cur_b = F.coalesce(_opt(CONFLICT, 2, state), _opt(IS_IN, 1, state), _currency(two))
    return facts(
        kind=F.lit("recon"),
        a=_amount(one).cast("decimal(14,2)"),
        b=_amount(two).cast("decimal(14,2)"),
        curA=cur_a,
        curB=cur_b,
        # A pattern that is plain text is searched in leaps, TOLERANCE at every character.
        tolerance=F.when(F.regexp(state, F.lit("s up to ")), _opt(TOLERANCE, 1, state)).cast("decimal(14,2)"),
        missingRef=_cue(state, MISSING),
        duplicate=_cue(state, DUPLICATE),
        dupVocab=F.exists(options, lambda o: o["key"] == "duplicate"),
    )


def decide_from_text(df: DataFrame, state: str = "state", options: str = "options") -> DataFrame:
    """D7 → D1 → J5 → D5: adds facts, conclusion, label, status."""
    read = df.withColumn("_matches", amount_matches(F.col(state)))
    f = extract_facts(F.col(state), F.col(options), F.col("_matches"))
    out = read.withColumn("facts", f).drop("_matches").withColumn("conclusion", conclude_recon(F.col("facts")))
    opt = option_for(F.col(options), F.col("conclusion"))
    out = out.withColumn("_raw", F.coalesce(opt["label"], F.lit(ABSTAIN_TEXT)))
    res = resolve_label("_raw", F.col(options)["label"])
    return out.withColumn("_r", res).select("*", "_r.label", "_r.status").drop("_r", "_raw")
