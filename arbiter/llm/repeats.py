"""Removal of repeated byte strings by anchored hash grouping, in place of full prefix doubling.

A byte goes when a string of ``length`` (100) bytes that covers it also starts earlier: in a
document of smaller id, or earlier in the same document. Plain prefix doubling ranks every byte
position by sorted (rank, rank at an offset) pairs at offsets 1, 2, 4, ... That is one row a byte and
seven shuffles of all of them (0.9 G rows on 0.5 GB). Here positions become rows only while their
prefix is shared, and a rank pair is (rank of the shorter prefix, name of the grown one):

* Round 1. Of the ``SEED``-byte (24) substrings in each 100-byte window the one with the least hash is
  the window's anchor: equal windows choose equal anchors, so ranks of anchors (one position in
  about 40) decide which windows can repeat. A run of windows with one anchor is one row:
  (anchor name, name of the run's whole text).
* Round 2. Runs whose anchor is shared by runs of different text are cut in groups of ``STEP`` (8)
  windows: (name of the 93 bytes all of them share, name of the group's whole text).
* Round 3. Groups that share the 93 bytes but differ in text become single windows: (93 bytes, 100).

In every round Spark groups the pairs: unique short names drop out; of equal pairs all but the
earliest are repeats as they stand (no further row, so hot passages shrink to one row a round); only
the earliest of each pair goes on, and only where its short name has several continuations.
Names are 64-bit polynomial hashes, compared in pairs only (128 bits decide an equality).

Texts are staged once, bucketed by document, so the three joins that need them shuffle no text.

Defined results: null text is empty; texts under 100 bytes lose nothing; an empty table gives an
empty result; extra columns are ignored. Rows that
share an id count as documents of neighbouring ids (null ids last).
"""

from __future__ import annotations

import functools
import hashlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbiter.llm.common import by_row, drop_staged, framed, shared_dir, staged

SEED, STEP = 24, 8
#: Windows of one pass over a long text; a text of any length is done in such portions.
PORTION = 1 << 19
#: Bits of a packed position (start, windows - 1) for the second part.
BITS = 20
_U = np.uint64
_LOW = _U((1 << BITS) - 1)


def _final(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value of each byte, powers of the base and of its inverse modulo 2^64."""
    base = 0x9E3779B97F4A7C15
    n = PORTION + 4096

    def powers(b: int) -> np.ndarray:
        out, m = np.ones(n, _U), 1
        while m < n:
            step = min(m, n - m)
            out[m : m + step] = out[:step] * _U(pow(b, m, 2**64))
            m += step
        return out

    value = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64)
    return value, powers(base), powers(pow(base, -1, 2**64))


class _Names:
    """Names of substrings of one portion in constant time."""

    def __init__(self, raw: np.ndarray):
        value, power, self.inverse = _tables()
        self.sums = np.zeros(len(raw) + 1, _U)
        np.cumsum(value[raw] * power[: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        z = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return _final(z + (end - start).astype(_U))


def _window_min(h: np.ndarray, w: int) -> np.ndarray:
    pad = (-len(h)) % w
    x = np.concatenate([h, np.full(pad, ~_U(0))]).reshape(-1, w)
    up = np.minimum.accumulate(x, axis=1).ravel()
    down = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[: len(h) - w + 1], up[w - 1 : len(h)])


def _portions(raw: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(start, bytes): every window lies in the one portion that holds its start."""
    for s in range(0, max(0, len(raw) - length + 1), PORTION):
        yield s, raw[s : s + PORTION + length - 1]


def _anchors(part: np.ndarray, length: int) -> tuple[_Names, np.ndarray, np.ndarray]:
    """(names, hash of every seed, per window its least seed: hash above, place in the low bits)."""
    names, at = _Names(part), np.arange(len(part) - SEED + 1)
    h = names.of(at, at + SEED)
    # The low bits of a hash make room for the place: the leftmost wins ties.
    return names, h, _window_min((h & ~_LOW) | at.astype(_U), length - SEED + 1)


def _starts(changes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the runs that begin where ``changes`` (of index 1, 2, ...) holds."""
    lo = np.flatnonzero(np.concatenate([[True], changes]))
    return lo, np.concatenate([lo[1:], [len(changes) + 1]]) - 1


def _joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    if not parts:
        return (np.empty(0, _U),) * 2 + (np.empty(0, np.int64),) * 2
    return tuple(np.concatenate(c) for c in zip(*parts))


def _runs(raw: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor name, text name, first window, windows - 1) of every run of a text."""
    out = []
    for s, part in _portions(raw, length):
        names, h, least = _anchors(part, length)
        lo, hi = _starts(least[1:] != least[:-1])
        out.append((h[(least[lo] & _LOW).astype(np.int64)], names.of(lo, hi + length), lo + s, hi - lo))
    return _joined(out)


def _spread(packed: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """(item number, window) of all windows of packed positions, windows counted from ``s``."""
    n = (packed & ((1 << BITS) - 1)) + 1
    item = np.repeat(np.arange(len(packed)), n)
    return item, (packed >> BITS)[item] - s + np.arange(len(item)) - (np.cumsum(n) - n)[item]


def _groups(raw: np.ndarray, runs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(shared name, text name, first window, windows - 1) of the window groups of given runs."""
    out = []
    for s, part in _portions(raw, length):
        mine = runs[(runs >> BITS >= s) & (runs >> BITS < s + PORTION)]
        if not len(mine):
            continue
        names, _, least = _anchors(part, length)
        item, p = _spread(mine, s)
        anchor = (least[p] & _LOW).astype(np.int64)
        block = (anchor - p) // STEP
        first, last = _starts((item[1:] != item[:-1]) | (block[1:] != block[:-1]))
        cut, end, core = p[first], p[last], anchor[first] - block[first] * STEP
        # The group's place relative to its anchor is part of both names.
        place = (block[first] + 1).astype(_U)
        inside = (anchor[first] - cut).astype(_U)
        out.append((
            _final(names.of(core, core + length - STEP + 1) + place),
            _final(names.of(cut, end + length) + inside * _U(0x9E3779B97F4A7C15)),
            cut + s, end - cut,
        ))
    return _joined(out)


def _windows(raw: np.ndarray, groups: np.ndarray, shared: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(shared name, window name, window, 0) of the single windows of given groups."""
    out = []
    for s, part in _portions(raw, length):
        mine = (groups >> BITS >= s) & (groups >> BITS < s + PORTION)
        if mine.any():
            item, p = _spread(groups[mine], s)
            out.append((shared[mine][item].view(_U), _Names(part).of(p, p + length), p + s, np.zeros(len(p), np.int64)))
    return _joined(out)


def _first_in_text(short: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Whether each (short, full) pair stands at its first place in the text."""
    order = np.lexsort((np.arange(len(full)), full, short))
    s, f = short[order], full[order]
    first = np.ones(len(full), bool)
    first[order[1:]] = (s[1:] != s[:-1]) | (f[1:] != f[:-1])
    return first


_ROWS = "short long, full long, id long, at long, again boolean"


def _rows(i, short, full, lo, more) -> pd.DataFrame:
    return pd.DataFrame({
        "short": short.view(np.int64), "full": full.view(np.int64), "id": i,
        "at": (lo.astype(np.int64) << BITS) | more.astype(np.int64), "again": ~_first_in_text(short, full),
    })


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _rank(rows: DataFrame, name: str, deeper: bool) -> tuple[DataFrame, DataFrame | None]:
    """One round over (short, full) pairs: (repeats, what the next round must look at).

    Each written table goes as soon as its last reader is written.
    """
    again = staged(rows.where("again").select("id", "at"), f"{name}-again")
    own = rows.where("NOT again").drop("again")
    shared = own.groupBy("short").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("short")
    hits = staged(own.join(shared, "short", "left_semi"), f"{name}-hits")
    drop_staged(rows)
    pairs = hits.groupBy("short", "full").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    if deeper:
        pairs = staged(pairs, f"{name}-pairs")
        several = pairs.groupBy("short").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("short", F.lit(True).alias("several"))
        pairs = pairs.join(several, "short", "left").withColumn("several", F.coalesce("several", F.lit(False)))
    else:
        pairs = pairs.withColumn("several", F.lit(False))
    told = hits.join(pairs.where("n > 1 OR several"), ["short", "full"])
    told = staged(
        told.select("id", "at", "short", (F.col("id") > F.col("first")).alias("repeat"), "several").where("repeat OR several"),
        f"{name}-told",
    )
    drop_staged(hits)
    repeats = told.where("repeat").select("id", "at").union(again)
    return repeats, told.where("several AND NOT repeat").select("id", "at", "short") if deeper else None


def _per_text(rows: DataFrame, *cols: str) -> DataFrame:
    """The rows of a text as arrays: bounded by the text's own length."""
    return rows.groupBy("id").agg(*[F.collect_list(c).alias(c) for c in cols])


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256.

    Of rows that share an id, one comes before the other as documents of neighbouring ids do.
    """
    docs = docs.select(id_col, text_col)
    return by_row(docs, id_col, text_col, lambda d: _drop_repeats(d, id_col, text_col, length))


def _drop_repeats(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """`drop_repeats` of distinct ids."""
    texts = _bucketed(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def each():
            for pdf in batches:
                for i, t in zip(pdf["id"], pdf["text"]):
                    if t and len(raw := _bytes(t)) >= length:
                        yield _rows(i, *_runs(raw, length))

        yield from framed(each())

    runs = staged(texts.mapInPandas(first, _ROWS), "runs")
    repeats1, deeper = _rank(runs, "runs", True)

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def each():
            for pdf in batches:
                for i, t, at in zip(pdf["id"], pdf["text"], pdf["at"]):
                    yield _rows(i, *_groups(_bytes(t), np.sort(at), length))

        yield from framed(each())

    looked = texts.join(_per_text(deeper, "at").hint("shuffle_hash"), "id")
    groups = staged(looked.mapInPandas(second, _ROWS), "groups")
    repeats2, deeper = _rank(groups, "groups", True)

    def third(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def each():
            for pdf in batches:
                for i, t, items in zip(pdf["id"], pdf["text"], pdf["items"]):
                    at = np.array([x["at"] for x in items], np.int64)
                    key = np.array([x["short"] for x in items], np.int64)
                    order = np.argsort(at)
                    yield _rows(i, *_windows(_bytes(t), at[order], key[order], length))

        yield from framed(each())

    items = _per_text(deeper.select("id", F.struct("at", "short").alias("items")), "items")
    windows = staged(texts.join(items.hint("shuffle_hash"), "id").mapInPandas(third, _ROWS), "windows")
    repeats3, _ = _rank(windows, "windows", False)
    spans = staged(_per_text(repeats1.union(repeats2).union(repeats3), "at"), "spans")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t, at in zip(pdf["text"], pdf["at"]):
                raw = _bytes(t)
                gone = _covered(len(raw), at, length)
                edges = np.diff(np.concatenate([[False], gone]).astype(np.int8))
                kept = raw[~gone].tobytes()
                out.append((len(raw), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
            out = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
            out.insert(0, "id", pdf["id"].to_numpy())
            yield out

    return texts.join(spans.hint("shuffle_hash"), "id", "left").mapInPandas(
        cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def _covered(n: int, at: np.ndarray | None, length: int) -> np.ndarray:
    """Which bytes the windows of packed positions cover."""
    if at is None or not len(at):
        return np.zeros(n, bool)
    at = np.asarray(at, np.int64)
    lo, more = at >> BITS, at & ((1 << BITS) - 1)
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, lo, 1)
    np.add.at(step, lo + more + length, -1)
    return np.cumsum(step[:n]) > 0


def _bucketed(texts: DataFrame) -> DataFrame:
    """The texts as a table bucketed by id in the shared folder: later joins shuffle no text."""
    spark = texts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"llm_texts_{uuid.uuid4().hex}"
    path = os.path.join(shared_dir(spark), name)
    texts.write.bucketBy(n, "id").option("path", path).saveAsTable(name)
    return spark.table(name)
