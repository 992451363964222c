"""Strict JSON on a string column.

Spark's readers stop after the first complete value and allow single quotes. Here a text
is JSON only when nothing but white space surrounds one document: it is put as the first
member of an object whose second member's name (a digest of the text, which the text
cannot contain) must come out as the one other name.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_json(text: Column) -> Column:
    """Whether the text is exactly one JSON document (null: false)."""
    mark = F.md5(F.coalesce(text, F.lit("")))
    wrapped = F.concat(F.lit('{"v":'), text, F.lit(',"'), mark, F.lit('":0}'))
    names = F.json_object_keys(wrapped) == F.array(F.lit("v"), mark)
    strict = {"columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false"}
    return F.coalesce(names & F.from_json(wrapped, "_bad string", strict)["_bad"].isNull(), F.lit(False))


def parse_json(text: Column) -> Column:
    """VARIANT of a strictly valid text, else null; of a repeated key in an object the last counts."""
    plain = F.try_parse_json(text)
    members = F.map_entries(F.from_json(text, "map<string,variant>"))
    last = F.filter(
        members, lambda m, i: ~F.exists(F.slice(members, i + 2, F.size(members)), lambda o: o["key"] == m["key"])
    )
    again = F.to_variant_object(F.map_from_entries(last))
    return F.when(valid_json(text), F.when(plain.isNull(), again).otherwise(plain))


def json_text(element: Column) -> Column:
    """An array element as text: strings as they are, null as None, booleans capitalised."""
    kind = F.schema_of_variant(element)
    text = F.try_variant_get(element, "$", "string")
    return (
        F.when(element.isNull() | (kind == "VOID"), "None").when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)
    )
