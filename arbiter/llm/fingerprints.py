"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, for every i, the polynomial hash of its first i code points modulo
2^31 - 1 under two bases. Two lookups and a shift give the hash of any span, so any two spans are
compared in constant time, and the longest common extension from two places is found by binary
search (`Prefixes.same`, `Prefixes.extension`).

A fingerprint is made of span hashes only: the hash of the whole text and its length, and the least
KEPT of the (mixed) hashes of all its spans of SPAN code points; a span that stands k times in a text
counts as k. `likeness` reads two fingerprints:
among the least values of both it takes the share that both hold as Jaccard similarity J of the span
sets, exact for short texts, and gives 2J / (1 + J), the part of the spans that they share.

An edited text keeps a prefix of the old one: its prefix array goes on from the old array at the cut,
only the new end is hashed.

Rows are put in id order by ranges of ids of bounded row count; a range is one sorted stream that holds
two texts at a time, and gets a copy of the row that begins the next range. Whole texts are shuffled
once, nothing is numbered globally.

Defined results: null text is the empty text; an empty text's fingerprint equals only that of another
empty text (likeness 1), else likeness 0. Texts shorter than a span are one span. Rows are ordered by
id, equal ids by a hash of the text; null ids come first. A table of one row is its own next; an empty
table gives an empty result; other columns are ignored. Texts of any length are hashed whole, at some
60 bytes a code point.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points of a span, and least span hashes kept.
SPAN, KEPT = 6, 64
#: Rows of one range of ids.
RANGE_ROWS = 4_000
_PRIME = (1 << 31) - 1
_P = np.uint64(_PRIME)
_BASES = (1_203_911_621, 718_281_829)
_SHIFT = np.uint64(31)
_STEP = 1 << 16


def _fold(x: np.ndarray) -> np.ndarray:
    """A smaller number of the same remainder: below 2^32 + 2^31 for x below 2^63; ``x`` is overwritten."""
    high = x >> _SHIFT
    x &= _P
    x += high
    return x


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo the Mersenne prime 2^31 - 1, for x below 2^63; ``x`` is overwritten."""
    x = _fold(_fold(x))
    return np.minimum(x, x - _P, out=x)  # x - _P wraps round where x is smaller


class _Powers:
    """base^0 .. base^n of each base and of its inverse, grown by doubling."""

    def __init__(self):
        self.up = [np.ones(1, np.uint64) for _ in _BASES]
        self.down = [np.ones(1, np.uint64) for _ in _BASES]

    def reach(self, n: int) -> None:
        while len(self.up[0]) <= n:
            for table, bases in ((self.up, _BASES), (self.down, [pow(b, -1, _PRIME) for b in _BASES])):
                for k, b in enumerate(bases):
                    t = table[k]
                    table[k] = np.concatenate([t, _mod(t * np.uint64(pow(b, len(t), _PRIME)))])


_POWERS = _Powers()


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")


class Prefixes:
    """Prefix hashes of a text; ``sums[k][i]``: of its first i code points under base k."""

    def __init__(self, sums: list[np.ndarray]):
        self.sums = sums
        self.n = len(sums[0]) - 1

    @classmethod
    def of(cls, points: np.ndarray) -> "Prefixes":
        return cls([np.zeros(1, np.uint32) for _ in _BASES]).extended(points)

    def cut(self, n: int) -> "Prefixes":
        """Of the first n code points."""
        return Prefixes([s[: n + 1] for s in self.sums])

    def extended(self, points: np.ndarray) -> "Prefixes":
        """Of this text followed by ``points``."""
        total = self.n + len(points)
        _POWERS.reach(total)
        out = []
        for k, s in enumerate(self.sums):
            more = np.empty(total + 1, np.uint32)
            more[: self.n + 1] = s
            carry = np.uint64(s[-1])
            for lo in range(0, len(points), _STEP):
                c = points[lo : lo + _STEP].astype(np.uint64) + np.uint64(1)
                at = self.n + lo
                c *= _POWERS.up[k][at : at + len(c)]
                run = np.cumsum(_fold(c))
                run += carry
                run = _mod(run)
                more[at + 1 : at + 1 + len(c)] = run
                carry = run[-1]
            out.append(more)
        return Prefixes(out)

    def spans(self, size: int, start: int = 0, base: int = 0) -> np.ndarray:
        """Hashes under one base of all spans of ``size`` code points, from the one at ``start`` on."""
        total = self.n - size + 1
        _POWERS.reach(self.n)
        s, down = self.sums[base], _POWERS.down[base]
        out = np.empty(max(0, total - start), np.uint32)
        for lo in range(start, total, _STEP):
            hi = min(lo + _STEP, total)
            gap = s[lo + size : hi + size] + _P  # 64 bits
            gap -= s[lo:hi]
            gap *= down[lo:hi]
            out[lo - start : hi - start] = _mod(gap)
        return out

    def span(self, start: int, size: int) -> int:
        """Hash of one span: two lookups and a shift by a power of each base."""
        _POWERS.reach(start)
        out = 0
        for s, down in zip(self.sums, _POWERS.down):
            out = out << 31 | (int(s[start + size]) - int(s[start])) * int(down[start]) % _PRIME
        return out

    def same(self, i: int, other: "Prefixes", j: int, size: int) -> bool:
        """Whether the spans of ``size`` code points at i here and at j there are equal."""
        return self.span(i, size) == other.span(j, size)

    def extension(self, i: int, other: "Prefixes", j: int) -> int:
        """Longest common extension: code points that agree from i here and j there.

        Doubles the length while the spans agree, then halves the interval.
        """
        most = min(self.n - i, other.n - j)
        lo, hi = 0, 1
        while hi <= most and self.same(i, other, j, hi):
            lo, hi = hi, 2 * hi
        hi = min(hi - 1, most)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.same(i, other, j, mid):
                lo = mid
            else:
                hi = mid - 1
        return lo


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(24)  # 40 bits


def least_spans(h: np.ndarray, kept: int = KEPT) -> np.ndarray:
    """The least ``kept`` mixed values of span hashes, ascending; the k-th equal span counts as its own."""
    if not len(h):
        return h.astype(np.uint64)
    h = np.sort(h)
    at = np.arange(len(h), dtype=np.uint32)
    first = at.copy()
    first[1:][h[1:] == h[:-1]] = 0
    time = at - np.maximum.accumulate(first)
    h = _mixed(h.astype(np.uint64) | time.astype(np.uint64) << np.uint64(32))
    few = 2 * kept
    if len(h) > few:
        top = np.unique(np.partition(h, few)[:few])
        if len(top) >= kept:
            return top[:kept]
    return np.unique(h)[:kept]


class _Text:
    """A text's prefix array, span hashes and fingerprint."""

    def __init__(self, prefixes: Prefixes, spans: np.ndarray, kept: int):
        self.prefixes, self.spans = prefixes, spans
        # Length and hash of the whole text, then the least span hashes, as hexadecimal words.
        least = least_spans(spans, kept)
        self.least = set(least.tolist())
        words = least.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().hex()
        self.fp = f"{prefixes.n:x}.{prefixes.span(0, prefixes.n):016x}.{words}"

    @classmethod
    def of(cls, points: np.ndarray, span: int, kept: int) -> "_Text":
        p = Prefixes.of(points)
        return cls(p, p.spans(min(span, p.n)) if p.n else np.empty(0, np.uint32), kept)

    def edited(self, keep: int, end: np.ndarray, span: int, kept: int) -> "_Text":
        """Of the first ``keep`` code points and ``end``: the old arrays go on at the cut."""
        p = self.prefixes.cut(keep).extended(end)
        size = min(span, p.n)
        if not size:
            return _Text(p, np.empty(0, np.uint32), kept)
        old = max(0, keep - size + 1) if size == span else 0
        return _Text(p, np.concatenate([self.spans[:old], p.spans(size, old)]), kept)


def fingerprint(text: str | None, span: int = SPAN, kept: int = KEPT) -> str:
    """Fingerprint of one text."""
    return _Text.of(code_points(text), span, kept).fp


def likeness(a: str, b: str, kept: int = KEPT) -> float:
    """Share of spans that two fingerprinted texts have in common, 0 to 1."""
    return 1.0 if a == b else _shared(_values(a), _values(b), kept)


def _shared(x: set, y: set, kept: int) -> float:
    union = sorted(x | y)[:kept]
    if not union:
        return 0.0
    j = len(x & y & set(union)) / len(union)
    return 2 * j / (1 + j)


def _values(fp: str) -> set[str]:
    v = fp.rpartition(".")[2]
    return {v[i : i + 10] for i in range(0, len(v), 10)}


def _row(a: _Text, points: np.ndarray, b: _Text, following: np.ndarray, span: int, kept: int) -> tuple:
    """n_chars, digest, both fingerprints, likenesses and common starts of a text and its next."""
    n = len(points)
    keep, end = n - n // 4, following[: n // 4]
    e = a.edited(keep, end, span, kept)
    text = (points[:keep].tobytes() + end.tobytes()).decode("utf-32-le", "surrogatepass")
    return (
        n, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), a.fp, e.fp,
        *(1.0 if a.fp == t.fp else _shared(a.least, t.least, kept) for t in (e, b)),
        keep + a.prefixes.extension(keep, e.prefixes, keep), a.prefixes.extension(0, b.prefixes, 0),
    )


COLUMNS = (
    "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double, same_start_edited long, same_start_next long"
)


def _ranges(ids: DataFrame, rows_per_range: int) -> np.ndarray:
    """The least id of each range of about ``rows_per_range`` rows; a null id counts as the least long."""
    n = max(1, -(-ids.count() // rows_per_range))
    dealt = ids.repartitionByRange(n, "o").select("o", F.spark_partition_id().alias("p"))
    starts = dealt.groupBy("p").agg(F.min("o").alias("start")).select("start").collect()  # one a range
    return np.array(sorted(r["start"] for r in starts), np.int64)


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    span: int = SPAN, kept: int = KEPT, rows_per_range: int = RANGE_ROWS,
) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and how near they and the next are.

    The edited text replaces the last quarter (rounded down) of the code points by as many of the
    next document's first. ``same_start_*``: code points that agree from the start.
    """
    spark = docs.sparkSession
    least = F.lit(-(2**63)).cast("long")
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), least).alias("o"))
    starts = _ranges(ids, rows_per_range)
    if not len(starts):
        return spark.createDataFrame([], COLUMNS)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    rows = rows.withColumns({"o": F.coalesce("id", least), "h": F.xxhash64("text"), "last": F.lit(False)})

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(g=np.searchsorted(starts, pdf["o"].to_numpy(), "right") - 1)

    # Rows that begin a range end the range before it; the first of all follows the last.
    table = spark.createDataFrame(
        [(int(s), (i - 1) % len(starts)) for i, s in enumerate(starts)], "o long, g long"
    )  # one row a range
    heads = rows.join(F.broadcast(table), "o").groupBy("g").agg(F.min(F.struct("o", "h", "id", "text")).alias("r"))
    heads = heads.select("g", "r.*").withColumn("last", F.lit(True))
    placed = rows.mapInPandas(place, "id long, text string, o long, h long, last boolean, g long")
    stream = placed.unionByName(heads).repartition("g").sortWithinPartitions("g", "last", "o", "h")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, group = None, None
        for pdf in batches:
            out = []
            for g, i, text, last in zip(pdf["g"], pdf["id"], pdf["text"], pdf["last"]):
                if g != group:
                    held, group = None, g
                if held and held[3] == text:
                    now, points = held[1:3]
                else:
                    points = code_points(text)
                    now = _Text.of(points, span, kept)
                if held:
                    out.append((held[0], *_row(held[1], held[2], now, points, span, kept)))
                held = None if last else (i, now, points, text)
            if out:
                frame = pd.DataFrame(out, columns=[c.split()[0] for c in COLUMNS.split(", ")])
                yield frame.assign(id=pd.array([None if pd.isna(r[0]) else int(r[0]) for r in out], "Int64"))

    return stream.select("g", "id", "text", "last").mapInPandas(run, COLUMNS)
