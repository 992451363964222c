"""Cross-tokenizer alignment by an associative fragment monoid.

Two tokenizers cut the same bytes; byte offsets where tokens of both end cut them into groups. The
tokens that end in a byte range make a *fragment*: an open prefix (tokens up to the first common end,
whose group may have begun before the range), closed groups, and an open suffix (tokens after the last
common end). Two neighbouring fragments compose to one: the suffix of the first and the prefix of the
second are one group. Composition is associative, so the ranges of a document may be reduced in a tree.

1. Documents up to ``chunk`` bytes are one range. Longer ones are cut at byte offsets; a row carries
   its range with the words it cuts whole, so each range is tokenized on its own, in any task. Both
   tokenizers break before a U+0020 that follows a character that is no white space (`word_starts`;
   checked against the vocabulary), so a word's tokens do not depend on what stands around it. A's ids
   come from an encoder by ranks where its file allows (ids in merge order), from its library elsewhere.
2. Fragments of a document are composed in rounds of ``FAN`` neighbours until one is left.
3. Pairs of linked ids are counted over the corpus. Pairs that hold at least 1 / HOT of all links, so
   at most HOT pairs, are looked up by broadcast; all others, whose rows are few by that very bound,
   by a join on the pair. Each document gets its sums by a combining aggregate.

Defined results: null and empty texts, and texts whose tokens' bytes differ from space + text (a
U+2581 in the text does that), have no tokens: zeros and an empty digest. Repeated rows and ids count
each for themselves. A run without a break is tokenized in one task, as the libraries do, however long;
a range never ends inside a run of more than ``WORD`` bytes. An empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbiter.llm.common import drop_staged, sole, staged

#: Bytes of a range of a long document, fragments composed at once, and bytes of a word that may be cut.
CHUNK, FAN, WORD = 32_768, 16, 4_096
#: Pairs that may be broadcast: those with at least 1 / HOT of all links.
HOT = 200_000
_CUT = re.compile(r"(?<=\S)(?= )")
_SPACED = re.compile(r"\s ")


def word_starts(text: str) -> list[str]:
    """Words of space + text, each without its first space: cut before a U+0020 after non-white space."""
    if not _SPACED.search(text) and not text.startswith(" "):
        return text.split(" ")
    return [w[1:] for w in _CUT.split(" " + text)]


# ---- fragments -----------------------------------------------------------------------------------


class Pair:
    """Both tokenizers of a worker, with the bytes and decimal names of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(path_a)
        a.no_truncation()
        a.no_padding()
        a.encode_special_tokens = True
        self.library_a = a
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = _byte_letters()
        vocab = {i: bytes(letters[c] for c in t) for t, i in a.get_vocab(False).items()}
        self.n_a, self.n_b = max(vocab) + 1, self.b.get_piece_size()
        self.bytes_a = [vocab.get(i, b"") for i in range(self.n_a)]
        # Ids follow the merge order in this file, so they serve as ranks; `usual` tells where that holds.
        with open(path_a, encoding="utf-8") as f:
            file = json.load(f)
        merged = [m if isinstance(m, str) else " ".join(m) for m in file["model"]["merges"]]
        ids = [file["model"]["vocab"][m.replace(" ", "")] for m in merged]
        plain = file["normalizer"] is None and file["pre_tokenizer"] == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True
        }
        self.usual = None
        if plain and ids == sorted(ids):
            ranks = {t: i for i, t in vocab.items()}
            self.usual = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece holds a space inside a word: texts cannot be cut at words")
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.len_a, self.len_b = (np.array([len(t) for t in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        #: Text of a token by its place: first of A, later of A, first of B, later of B in a group.
        self.names = [f"{c}{i}" for c, n in ((";", self.n_a), (",", self.n_a), ("|", self.n_b), (",", self.n_b)) for i in range(n)]

    def ids_a(self, text: str) -> list[int]:
        if self.usual is None:
            return self.library_a.encode(text, add_special_tokens=False).ids
        return self.usual.encode_ordinary(text)

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """Ids of space + text, and whether both sides' tokens spell it."""
        a, b = self.ids_a(" " + text), self.b.encode(text) or [self.b.piece_to_id("▁")]
        raw = (" " + text).encode("utf-8", "surrogatepass")
        ok = all(b"".join([v[i] for i in ids]) == raw for v, ids in ((self.bytes_a, a), (self.bytes_b, b)))
        return np.array(a, np.int64), np.array(b, np.int64), ok


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself,
    the others in order from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Fragment:
    """Tokens whose ends lie in a byte range.

    ``prefix`` and ``suffix`` are (ids of A, ids of B) of the open ends. ``closed`` is the text of the
    closed groups, each beginning with a semicolon; None while the range holds no common end: then
    ``prefix`` holds all its tokens. ``pairs``/``times`` count the links inside closed groups, a pair being
    id of A * size of B + id of B. A document's first range begins at a common end, so its prefix is empty.
    """

    prefix: tuple = ((), ())
    suffix: tuple = ((), ())
    closed: str | None = None
    n_groups: int = 0
    n_a: int = 0
    n_b: int = 0
    pairs: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    ok: bool = True


def _joined(x: tuple, y: tuple) -> tuple:
    return tuple((*p, *q) for p, q in zip(x, y))


def _counted_pairs(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    u, at = np.unique(np.concatenate(pairs), return_inverse=True)
    return u, np.bincount(at, np.concatenate(times), len(u)).astype(np.int64)


def fragment(v: Pair, a: np.ndarray, b: np.ndarray, start_a: int = 0, start_b: int = 0, first: bool = True) -> Fragment:
    """Of tokens in order; they begin at byte ``start_a``/``start_b``; ``first``: the range begins a document."""
    ends_a, ends_b = start_a + np.cumsum(v.len_a[a]), start_b + np.cumsum(v.len_b[b])
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    if not len(common) and not first:
        return Fragment((tuple(a.tolist()), tuple(b.tolist())))
    lo = 0 if first else int(common[0])
    hi = int(common[-1]) if len(common) else 0
    (i, p), (j, q) = (np.searchsorted(e, [lo, hi], "right").tolist() for e in (ends_a, ends_b))
    out = Fragment(
        (tuple(a[:i].tolist()), tuple(b[:j].tolist())), (tuple(a[p:].tolist()), tuple(b[q:].tolist())),
        n_groups=len(common) - (not first), n_a=p - i, n_b=q - j,
    )
    a, b, ends_a, ends_b = a[i:p], b[j:q], ends_a[i:p], ends_b[j:q]
    # Tokens in the order of the text: by group, A before B; the first of a side has its own sign.
    group = [np.searchsorted(common, e) for e in (ends_a, ends_b)]
    fresh = [np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.empty(0, bool) for g in group]
    code = np.concatenate([a + np.where(fresh[0], 0, v.n_a), 2 * v.n_a + b + np.where(fresh[1], 0, v.n_b)])
    order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
    out.closed = "".join([v.names[c] for c in code[order].tolist()])
    # Every end closes a stretch that lies in one token of A and one of B.
    ends = np.union1d(ends_a, ends_b)
    links = a[np.searchsorted(ends_a, ends)] * v.n_b + b[np.searchsorted(ends_b, ends)]
    out.pairs, out.times = np.unique(links, return_counts=True)
    return out


def compose(v: Pair, x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges. Associative; an empty Fragment() is neutral."""
    ok = x.ok and y.ok
    if x.closed is None:
        return replace(y, prefix=_joined(x.prefix, y.prefix), ok=ok)
    if y.closed is None:
        return replace(x, suffix=_joined(x.suffix, y.prefix), ok=ok)
    middle = _joined(x.suffix, y.prefix)
    m = fragment(v, *(np.array(t, np.int64) for t in middle)) if any(middle) else Fragment(closed="")
    pairs, times = _counted_pairs([x.pairs, m.pairs, y.pairs], [x.times, m.times, y.times])
    sums = (x.n_groups + m.n_groups + y.n_groups, x.n_a + m.n_a + y.n_a, x.n_b + m.n_b + y.n_b)
    return Fragment(x.prefix, y.suffix, x.closed + m.closed + y.closed, *sums, pairs, times, ok)


_LOADED: dict = {}


def _pair(path_a: str, path_b: str) -> Pair:
    sole(_LOADED)
    if (path_a, path_b) not in _LOADED:
        _LOADED.clear()
        _LOADED[path_a, path_b] = Pair(path_a, path_b)
    return _LOADED[path_a, path_b]


# ---- rows ----------------------------------------------------------------------------------------

DOC = "row long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
_NONE = (0, 0, 0, 0, "", [], [])


def _closed(f: Fragment) -> tuple:
    """The row of a document: its one range, or all its ranges composed."""
    if not f.ok or f.closed is None or any(f.prefix) or any(f.suffix):
        return _NONE
    digest = hashlib.sha256(f.closed[1:].encode()).hexdigest()
    return f.n_a, f.n_b, f.n_groups, int(f.times.sum()), digest, f.pairs, f.times


def _whole(v: Pair, text: str) -> tuple:
    """The row of a document of one range."""
    if not text:
        return _NONE
    a, b, ok = v.tokens(text)
    return _closed(fragment(v, a, b)) if ok else _NONE


def _frame(rows: list[tuple], schema: str = DOC) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
    return frame.assign(id=pd.array([None if pd.isna(r[1]) else int(r[1]) for r in rows], "Int64"))


def cut_ranges(text: str, chunk: int) -> Iterator[tuple[int, str, int, int]]:
    """(number, words of the range joined, first and last byte offset within them) of a long text.

    Ranges meet at multiples of ``chunk`` bytes, moved to the next word where the word there is long. The
    words that a range cuts are given whole on both sides.
    """
    words = word_starts(text)
    size = np.array([len(w.encode("utf-8", "surrogatepass")) + 1 for w in words])
    end = np.cumsum(size)
    total = int(end[-1])
    cuts = [0]
    for c in range(chunk, total, chunk):
        w = int(np.searchsorted(end, c, "left"))  # the word that holds byte c - 1
        c = int(end[w]) if size[w] > WORD else c
        if cuts[-1] < c < total:
            cuts.append(c)
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:] + [total])):
        first, last = int(np.searchsorted(end, lo, "right")), int(np.searchsorted(end, hi, "left"))
        begin = int(end[first] - size[first])
        yield k, " ".join(words[first : last + 1]), lo - begin, hi - begin


def range_fragment(v: Pair, k: int, words: str, lo: int, hi: int) -> Fragment:
    """Range ``k`` of a document: the tokens that end after byte ``lo`` and up to byte ``hi`` of space + words."""
    a, b, ok = v.tokens(words)
    if not ok:
        return Fragment(ok=False)
    ea, eb = np.cumsum(v.len_a[a]), np.cumsum(v.len_b[b])
    i, j = (np.searchsorted(e, [lo, hi], "right").tolist() for e in (ea, eb))
    begin = [int(e[x[0] - 1]) if x[0] else 0 for e, x in ((ea, i), (eb, j))]
    return fragment(v, a[i[0] : i[1]], b[j[0] : j[1]], *begin, first=k == 0)


RANGE = "row long, id long, k long, words string, lo long, hi long"
FRAGMENT = (
    "row long, id long, k long, ok boolean, prefix_a array<int>, prefix_b array<int>, suffix_a array<int>,"
    " suffix_b array<int>, closed string, n_groups long, n_a long, n_b long, pairs array<long>, times array<int>"
)


def _row_of(row: int, doc_id, k: int, f: Fragment) -> tuple:
    ends = (list(t) for t in (*f.prefix, *f.suffix))
    return row, doc_id, k, f.ok, *ends, f.closed, f.n_groups, f.n_a, f.n_b, f.pairs, f.times


def _fragment_of(r) -> Fragment:
    ends = [tuple(int(i) for i in r[c]) for c in ("prefix_a", "prefix_b", "suffix_a", "suffix_b")]
    return Fragment(
        tuple(ends[:2]), tuple(ends[2:]), r["closed"], int(r["n_groups"]), int(r["n_a"]), int(r["n_b"]),
        np.asarray(r["pairs"], np.int64), np.asarray(r["times"], np.int64), bool(r["ok"]),
    )


def _reduced(fragments: DataFrame, fan: int, path_a: str, path_b: str) -> DataFrame:
    """One fragment a document: neighbours are composed ``fan`` at a time, in rounds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = _pair(path_a, path_b)
        held, key = None, None
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                now = (int(r["row"]), int(r["k"]) // fan)
                f = _fragment_of(r)
                if held is not None and now == (key[0], key[2]):
                    held = compose(pair, held, f)
                else:
                    if held is not None:
                        out.append(_row_of(*key, held))
                    held, key = f, (now[0], r["id"], now[1])
            if out:
                yield _frame(out, FRAGMENT)
        if held is not None:
            yield _frame([_row_of(*key, held)], FRAGMENT)

    most = fragments.agg(F.max("k")).first()[0] or 0
    while most > 0:
        near = fragments.withColumn("g", F.floor(F.col("k") / fan)).repartition("row", "g")
        after = staged(near.sortWithinPartitions("row", "k").drop("g").mapInPandas(run, FRAGMENT), "fragments")
        drop_staged(fragments)
        fragments, most = after, most // fan
    return fragments


def aligned(docs: DataFrame, path_a: str, path_b: str, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """One row per row of ``docs`` (row, id, text): counts, digest, and its linked id pairs with their times."""

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = _pair(path_a, path_b)
        for pdf in batches:
            for lo in range(0, len(pdf), 1_000):
                part = pdf[lo : lo + 1_000]
                yield _frame([(r, i, *_whole(pair, t)) for r, i, t in zip(part["row"], part["id"], part["text"])])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r, i, t in zip(pdf["row"], pdf["id"], pdf["text"]):
                yield _frame([(r, i, *c) for c in cut_ranges(t, chunk)], RANGE)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = _pair(path_a, path_b)
        for pdf in batches:
            for r in pdf.to_dict("records"):
                f = range_fragment(pair, r["k"], r["words"], r["lo"], r["hi"])
                yield _frame([_row_of(r["row"], r["id"], r["k"], f)], FRAGMENT)

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield _frame([(r["row"], r["id"], *_closed(_fragment_of(r))) for r in pdf.to_dict("records")])

    long = F.octet_length("text") >= chunk
    # Keys of long documents are negative: the two scans need not number rows alike.
    ranges = docs.where(long).withColumn("row", -1 - F.col("row")).mapInPandas(cut, RANGE)
    fragments = staged(ranges.repartition("row", "k").mapInPandas(each, FRAGMENT), "fragments")
    whole = docs.where(~long).mapInPandas(short, DOC)
    return whole.unionByName(_reduced(fragments, fan, path_a, path_b).mapInPandas(close, DOC))


def _counted(links: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): corpus-wide count of every linked pair, and whether it is its B id's highest."""
    counts = staged(links.groupBy("pair").agg(F.sum("times").alias("n")), "pair-counts")
    b = F.col("pair") % F.lit(n_b)
    top = counts.groupBy(b.alias("b")).agg(F.max("n").alias("top"))  # at most one row a token of B
    marked = counts.withColumn("b", b).join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    return staged(marked, "pair-marks")


def align(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
    chunk: int = CHUNK, fan: int = FAN, hot: int = HOT,
) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # a row's own key, whatever its id
    done = staged(aligned(rows, path_a, path_b, chunk, fan), "aligned")

    links = done.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l"))
    links = links.select("row", F.col("l.pairs").alias("pair"), F.col("l.times").cast("long").alias("times"))
    counts = _counted(links, Pair(path_a, path_b).n_b)
    total = done.agg(F.sum("n_links")).first()[0] or 0
    often = F.col("n") * F.lit(hot) >= F.lit(total)  # so at most `hot` pairs
    sums = [
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    ]
    head = links.join(F.broadcast(counts.where(often)), "pair", "left")
    near = head.where("n IS NOT NULL").groupBy("row").agg(*sums)
    rare = head.where("n IS NULL").select("row", "pair", "times").join(counts.where(~often), "pair").groupBy("row").agg(*sums)
    found = near.unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = done.drop("pairs", "times").join(found, "row", "left")
    return out.select(
        "id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0).cast("long")).alias("n_best"),
        F.coalesce("count_sum", F.lit(0).cast("long")).alias("count_sum"), "groups_sha256",
    )
