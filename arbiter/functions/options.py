"""Option-set parsing (P1 strict, P2 lenient) and formatting.

Parsers never raise inside a job: they return ``struct<options, error>``;
rows with an error go to quarantine by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arbiter.functions.text import col_, py_strip

OPTION = "struct<label:string,key:string,description:string>"
PARSED_TYPE = f"struct<options:array<{OPTION}>,error:string>"


def _bind(value: Column, use) -> Column:
    """``use(value)``, the value made once however often it is used: the element of a one-element array."""
    return F.get(F.transform(F.array(value), use), 0)


def _cut(c: Column) -> Column:
    """struct<has, head, rest> of a text at its first colon; without one head and rest are ''."""
    at = F.instr(c, ":")
    has = at > 0
    return F.struct(
        has.alias("has"),
        F.when(has, F.substring_index(c, ":", 1)).otherwise("").alias("head"),
        F.when(has, F.substr(c, at + 1)).otherwise("").alias("rest"),
    )


def _opt(label: Column, key: Column, desc: Column) -> Column:
    return F.struct(label.alias("label"), key.alias("key"), desc.alias("description"))


def _dup_error(opts: Column) -> Column:
    labels = F.transform(opts, lambda o: o["label"])
    return F.size(F.array_distinct(labels)) != F.size(labels)


def parse_options_strict(text: Column | str) -> Column:
    """``A:match|B:mismatch:desc`` — pipes only; description defaults to key."""
    s = col_(text)
    segs = F.filter(F.transform(F.split(s, r"\|", -1), py_strip), lambda x: x != "")

    def one(seg: Column) -> Column:
        def labelled(d: Column) -> Column:
            key, desc = py_strip(d["r"]["head"]), py_strip(d["r"]["rest"])
            rest_has = d["r"]["has"]
            return _opt(d["label"], F.when(rest_has, key).otherwise(d["rest"]), F.when(rest_has, desc).otherwise(d["rest"]))

        def parted(d: Column) -> Column:
            cut = F.struct(
                F.upper(py_strip(d["head"])).alias("label"), d["rest"].alias("rest"), _cut(d["rest"]).alias("r")
            )
            return F.when(d["has"], _bind(cut, labelled)).otherwise(_opt(F.upper(seg), seg, seg))

        return _bind(_cut(seg).withField("rest", py_strip(_cut(seg)["rest"])), parted)

    def result(d: Column) -> Column:
        error = (
            F.when(F.coalesce(py_strip(s) == "", F.lit(True)), "options string must not be empty")
            .when(F.size(d["segs"]) == 0, "could not parse options")
            .when(_dup_error(d["opts"]), "duplicate option labels")
        )
        return _bind(error, lambda e: F.struct(F.when(e.isNull(), d["opts"]).alias("options"), e.alias("error")))

    both = _bind(segs, lambda x: F.struct(x.alias("segs"), F.transform(x, one).alias("opts")))
    return _bind(both, result).cast(PARSED_TYPE)


def parse_options_lenient(text: Column | str) -> Column:
    """Pipes or newlines; unlabeled segments get A, B, C… by position; ≥ 2 options."""
    s = F.coalesce(col_(text), F.lit(""))
    segs = F.filter(
        F.transform(F.split(F.replace(s, F.lit("|"), F.lit("\n")), "\n", -1), py_strip),
        lambda x: x != "",
    )

    def one(seg: Column, i: Column) -> Column:
        def keyed(d: Column) -> Column:
            label = F.when(d["labelled"], F.upper(d["head"])).otherwise(F.char(i + 65))
            key = (
                F.when(d["labelled"], py_strip(F.when(d["r"]["has"], d["r"]["head"]).otherwise(d["rest"])))
                .when(d["has"], py_strip(d["rest"]))
                .otherwise(seg)
            )
            desc = F.when(d["labelled"] & d["r"]["has"], py_strip(d["r"]["rest"]))
            return _bind(_opt(label, key, desc), defaults)

        def defaults(o: Column) -> Column:
            key = F.when(o["key"] == "", o["label"]).otherwise(o["key"])
            desc = o["description"]
            return _opt(o["label"], key, F.when(desc.isNull() | (desc == ""), key).otherwise(desc))

        def parted(d: Column) -> Column:
            return _bind(
                F.struct(
                    d["has"].alias("has"), d["head"].alias("head"), d["rest"].alias("rest"),
                    (d["has"] & (d["head"] != "")).alias("labelled"), _cut(d["rest"]).alias("r"),
                ),
                keyed,
            )

        return _bind(_cut(seg).withField("head", py_strip(_cut(seg)["head"])), parted)

    def result(opts: Column) -> Column:
        error = (
            F.when(F.size(opts) == 0, "give at least two options")
            .when(_dup_error(opts), "duplicate option label")
            .when(F.size(opts) < 2, "give at least two options")
        )
        return _bind(error, lambda e: F.struct(F.when(e.isNull(), opts).alias("options"), e.alias("error")))

    return _bind(F.transform(segs, one), result).cast(PARSED_TYPE)


def format_options(options: Column | str) -> Column:
    """``label: key — desc`` / ``label: key`` / ``label``, one per line."""

    def line(o: Column) -> Column:
        parts = _opt(
            F.upper(py_strip(F.coalesce(o["label"], F.lit("")))),
            py_strip(F.coalesce(o["key"], F.lit(""))),
            py_strip(F.coalesce(o["description"], F.lit(""))),
        )
        return _bind(parts, joined)

    def joined(d: Column) -> Column:
        label, key, desc = d["label"], d["key"], d["description"]
        return (
            F.when((desc != "") & (key != "") & (desc != key), F.concat(label, F.lit(": "), key, F.lit(" — "), desc))
            .when(key != "", F.concat(label, F.lit(": "), key))
            .otherwise(label)
        )

    return F.array_join(F.transform(col_(options), line), "\n")
