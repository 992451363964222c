"""Scalar text helpers, all Catalyst expressions (no Python on executors)."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() removes Unicode whitespace; Spark's trim only spaces.
_STRIP = r"(?U)^\s+|\s+$"
_RSTRIP = r"(?U)\s+$"
WORD_SPLIT = "[ \n\t\r]+"
TOKEN_SPLIT = "[^a-z0-9]+"


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    return F.regexp_replace(col_(c), _STRIP, "")


def py_rstrip(c: Column | str) -> Column:
    return F.regexp_replace(col_(c), _RSTRIP, "")


def norm_label(c: Column | str) -> Column:
    """upper(strip(x or '')) — the label normal form."""
    return F.upper(py_strip(F.coalesce(col_(c), F.lit(""))))


def words(c: Column | str) -> Column:
    """Whitespace words (the default token counter).

    ``array_remove`` rather than a ``filter`` lambda: same result on split
    output (never null), but compiled code instead of an interpreted lambda.
    """
    return F.array_remove(F.split(col_(c), WORD_SPLIT), "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def tokens(c: Column | str) -> Column:
    """Lower-cased ASCII alphanumeric tokens; other characters separate."""
    return F.array_remove(F.split(F.lower(col_(c)), TOKEN_SPLIT), "")


def preview(c: Column | str, n: int = 160) -> Column:
    """P10: newlines become spaces, first ``n`` characters."""
    return F.substring(F.regexp_replace(col_(c), "\n", " "), 1, n)


def money(c: Column | str) -> Column:
    """Amount printed with two decimals (DECIMAL(14,2) rendering)."""
    return col_(c).cast("decimal(14,2)").cast("string")


def template(tpl: str, values: dict[str, Column]) -> Column:
    """Render a ``{name}`` template as one ``concat`` (null in ⇒ null out).

    Substitution happens once, so text inside a value is never re-expanded.
    """
    parts: list[Column] = []
    for literal, field, _spec, _conv in string.Formatter().parse(tpl):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            parts.append(values[field])
    return F.concat(*parts) if parts else F.lit("")


def template_sql(tpl: str, values: dict[str, str]) -> str:
    """Same template as a SQL ``||`` chain (used by the DuckDB oracles)."""
    parts: list[str] = []
    for literal, field, _spec, _conv in string.Formatter().parse(tpl):
        if literal:
            parts.append(sql_str(literal))
        if field is not None:
            parts.append(f"({values[field]})")
    return "(" + " || ".join(parts) + ")" if parts else "''"


def sql_str(s: str) -> str:
    """A SQL string literal; newlines spelled with chr(10) so both engines agree."""
    pieces = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in pieces]
    return " || chr(10) || ".join(quoted)
