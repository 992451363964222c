"""BPE encoding and decoding as streaming transducers with bounded lookahead.

`sufficient_lookahead` reads the merge list: whether a token survives can only depend on text to
its right through a chain of merges whose ranks fall from step to step (a neighbour is taken away
by an earlier merge, which itself depends on a yet earlier one). The longest chain, in symbols, is
a distance beyond which nothing can change a token. `PieceTransducer` buffers a bounded number of
symbols and emits a token once that many symbols follow it; the rest of the piece is then encoded
as if it began there. Short pieces repeat, so their ids are kept in a bounded table.

`TokenDecoder` is the way back: ids in, text out as soon as it is complete; a multi-byte character
may be split over tokens, so bytes pass an incremental UTF-8 state machine.

Defined results: null text counts as empty (no ids, empty decoding); strings of special tokens in
a text become their ids, as the tokenizers library does by default; extra columns are ignored.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbiter.llm.common import sole

#: Pieces up to this many bytes are remembered; the table is emptied when it holds so many.
KEPT_PIECE, KEPT_PIECES = 48, 250_000
#: Symbols a transducer takes in before it looks for stable tokens.
STEP = 2048
#: Characters of text per front-end window (extended to the next white space).
WINDOW = 1 << 16


def sufficient_lookahead(merges: list[tuple[int, int, int]], length: dict[int, int]) -> int:
    """Symbols after a token that suffice to know it is final.

    ``merges``: (left, right, result) ids by rank; ``length``: symbols of each id. For a token t
    and rank q let F(t, q) be the reach of what can still take t (or a right part of it while t
    was being built) before rank q. A merge q of (a, b) reaches E(q) = |b| + F(b, q); F(t, q) is
    the largest E of merges (t, .) below q, or F(right part of t, rank that built t). Ranks only
    fall along the chain, so one pass in rank order computes all of it.
    """
    built: dict[int, int] = {}
    taken: dict[int, int] = {}
    for a, b, z in merges:
        reach = max(built.get(b, 0), taken.get(b, 0))
        taken[a] = max(taken.get(a, 0), length[b] + reach)
        built[z] = max(built.get(z, 0), reach)
    return max([0, *built.values(), *taken.values()])


def merge_all(ids: list[int], rank: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """BPE of a symbol list: the lowest rank first, the leftmost pair on ties."""
    n = len(ids)
    if n < 2:
        return ids
    if n <= 24:
        ids = list(ids)
        while len(ids) > 1:
            best, at = None, -1
            for i, pair in enumerate(zip(ids, ids[1:])):
                r = rank.get(pair)
                if r is not None and (best is None or r[0] < best[0]):
                    best, at = r, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids
    sym, nxt, prev = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
    nxt[-1] = -1
    heap = [(r[0], i, r[1], ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1])))]
    heapq.heapify(heap)
    while heap:
        _, i, new, left, right = heapq.heappop(heap)
        j = nxt[i] if sym[i] == left else -1
        if j < 0 or sym[j] != right:
            continue
        sym[i], sym[j] = new, -1
        nxt[i] = nxt[j]
        if nxt[j] >= 0:
            prev[nxt[j]] = i
        for a, b in ((prev[i], i), (i, nxt[i])):
            if a >= 0 and b >= 0 and (r := rank.get((sym[a], sym[b]))):
                heapq.heappush(heap, (r[0], a, r[1], sym[a], sym[b]))
    return [s for s in sym if s >= 0]


class PieceTransducer:
    """Encode one piece fed in portions; ``feed`` returns the tokens that became final."""

    def __init__(self, rank, length, lookahead: int, step: int = STEP):
        self.rank, self.length, self.lookahead, self.step = rank, length, lookahead, step
        self.buffer: list[int] = []

    def feed(self, symbols: list[int]) -> list[int]:
        out: list[int] = []
        at = 0
        while at < len(symbols):
            room = self.step + self.lookahead - len(self.buffer)
            self.buffer += symbols[at : at + room]
            at += room
            if len(self.buffer) >= self.step + self.lookahead:
                out += self._stable()
        return out

    def _stable(self) -> list[int]:
        limit, end, done = len(self.buffer) - self.lookahead, 0, []
        for t in merge_all(self.buffer, self.rank):
            if end + self.length[t] > limit:
                break
            end += self.length[t]
            done.append(t)
        self.buffer = self.buffer[end:]
        # One token longer than a step: take in more before the next look.
        self.step = max(self.step, 2 * len(self.buffer)) if not done else self.step
        return done

    def finish(self) -> list[int]:
        rest, self.buffer = merge_all(self.buffer, self.rank), []
        return rest


def byte_alphabet() -> list[str]:
    """The printable character standing for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


class _Pieces(dict):
    """piece -> its ids as little-endian 32-bit bytes, filled on demand, bounded."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode("utf-8")
        out = np.asarray(self.encode(raw), "<u4").tobytes()
        if len(raw) <= KEPT_PIECE:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = out
        return out


class WordBpe:
    """A lower-casing word BPE with an end-of-word suffix, read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(split, regex.V0).findall
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")")
        shown = byte_alphabet()
        self.inner = [vocab[c] for c in shown]
        self.last = [vocab[c + self.suffix] for c in shown]
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.length = dict.fromkeys([*self.inner, *self.last], 1)
        rules = []
        for n, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            a_id, b_id, z = vocab[a], vocab[b], vocab[a + b]
            self.rank[a_id, b_id] = (n, z)
            self.length[z] = self.length[a_id] + self.length[b_id]
            rules.append((a_id, b_id, z))
        self.lookahead = sufficient_lookahead(rules, self.length)
        self.pieces = _Pieces(self.encode_piece)

    def encode_piece(self, raw: bytes, step: int = STEP) -> list[int]:
        """Ids of one piece; a long one passes the transducer in portions."""
        if len(raw) <= step:
            return merge_all([*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]], self.rank)
        t = PieceTransducer(self.rank, self.length, self.lookahead, step)
        out: list[int] = []
        for i in range(0, len(raw) - 1, step):
            out += t.feed([*map(self.inner.__getitem__, raw[i : min(i + step, len(raw) - 1)])])
        return out + t.feed([self.last[raw[-1]]]) + t.finish()

    @staticmethod
    def _normal(s: str) -> str:
        if not s.isascii():
            s = unicodedata.normalize("NFC", s)
            if "Σ" in s:  # lower-cased character by character: no final form
                return "".join(c.lower() for c in s)
        return s.lower()

    def windows(self, text: str) -> Iterator[str]:
        """Cut text after a white space about every WINDOW characters; no piece or character
        composition crosses such a cut. A longer run without white space is one window."""
        at, n = 0, len(text)
        while n - at > WINDOW:
            end = text.find(" ", at + WINDOW)
            if end < 0:
                break
            yield text[at : end + 1]
            at = end + 1
        yield text[at:]

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids of a text in order, as portions of little-endian 32-bit integers."""
        for part in self.specials.split(text) if any(s in text for s in self.special) else (text,):
            if part in self.special:
                yield np.asarray([self.special[part]], "<u4").tobytes()
                continue
            for w in self.windows(part):
                yield b"".join(map(self.pieces.__getitem__, self.find(self._normal(w))))


class TokenDecoder:
    """Ids to text, portion by portion.

    ``spaced`` (the library's result for a file without a decoder): token strings joined by one
    space. Otherwise the original bytes: byte alphabet undone, end-of-word suffix as a space, and
    an incremental UTF-8 machine that holds back an unfinished character.
    """

    def __init__(self, bpe: WordBpe, spaced: bool = True):
        self.spaced, self.started = spaced, False
        if spaced:
            self.table = _spaced_table(bpe)
        else:
            self.table = _byte_table(bpe)
            self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str | bytes:
        """The finished text of these ids: str, or its UTF-8 bytes when ``spaced``."""
        if self.spaced:
            if not ids:
                return b""
            out = b" ".join(map(self.table.__getitem__, ids))
            out = b" " + out if self.started else out
            self.started = True
            return out
        return self.machine.decode(b"".join(map(self.table.__getitem__, ids)))

    def finish(self) -> str | bytes:
        return b"" if self.spaced else self.machine.decode(b"", final=True)


@functools.lru_cache(maxsize=4)
def _spaced_table(bpe: WordBpe) -> dict[int, bytes]:
    return {i: t.encode("utf-8") for i, t in bpe.token.items()}


@functools.lru_cache(maxsize=4)
def _byte_table(bpe: WordBpe) -> dict[int, bytes]:
    byte = {c: b for b, c in enumerate(byte_alphabet())}
    special = set(bpe.special.values())
    out = {}
    for i, t in bpe.token.items():
        if i in special:
            out[i] = t.encode("utf-8")
            continue
        ends = t.endswith(bpe.suffix) and len(t) > len(bpe.suffix)
        body = t[: -len(bpe.suffix)] if ends else t
        out[i] = bytes(byte[c] for c in body) + b" " * ends
    return out


@functools.lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    """Read once per Python worker."""
    return WordBpe(path)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_tokens, ids_sha256, decoded_sha256 of its encoding and decoding."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        sole(bpe.pieces)
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                n, ids_sha, out_sha, decoder = 0, hashlib.sha256(), hashlib.sha256(), TokenDecoder(bpe)
                for ids in bpe.encode(text or ""):
                    n += len(ids) // 4
                    ids_sha.update(ids)
                    out_sha.update(decoder.feed(np.frombuffer(ids, "<u4").tolist()))
                out_sha.update(decoder.finish())
                rows.append((n, ids_sha.hexdigest(), out_sha.hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, id_col, pdf["id"].to_numpy())
            yield out

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(
        run, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def encode_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its ids as an array (the training input itself)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        sole(bpe.pieces)
        for pdf in batches:
            ids = [np.frombuffer(b"".join(bpe.encode(t or "")), "<u4").astype(np.int32) for t in pdf["text"]]
            yield pd.DataFrame({id_col: pdf["id"], "n_tokens": [len(x) for x in ids], "ids": ids})

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(
        run, f"{id_col} long, n_tokens long, ids array<int>"
    )


def decode_table(encoded: DataFrame, path: str, id_col: str = "doc_id", spaced: bool = False) -> DataFrame:
    """Per document: the text of its ``ids`` (null ids: empty)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        sole(bpe.pieces)
        for pdf in batches:
            texts = []
            for ids in pdf["ids"]:
                d = TokenDecoder(bpe, spaced)
                out = d.feed([] if ids is None else list(ids)) + d.finish()
                texts.append(out.decode("utf-8") if spaced else out)
            yield pd.DataFrame({id_col: pdf["id"], "text": texts})

    return encoded.select(F.col(id_col).alias("id"), "ids").mapInPandas(run, f"{id_col} long, text string")
