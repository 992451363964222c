"""Token counts without tokens: a count-only Viterbi over Aho-Corasick matches.

The automaton names every vocabulary piece ending at a character; the dynamic programme keeps per
position only the best score and the number of pieces on that path, in a ring as long as the
longest piece. Tie rules are those of the unigram model of the tokenizers library: pieces are tried
by start from left to right and only a strictly better score replaces a path; a character that is
no piece itself may be an unknown at the least score minus 10; with byte fallback an unknown counts
its UTF-8 bytes, without it a run of unknowns counts once.

No piece spans certain cuts (`Unigram.cut`), so a text is the sum over its segments, most of which
repeat and are looked up. That holds exactly while scores add without rounding, which is checked
when the vocabulary is read (whole-number scores) and against each text's length; otherwise a text
is one segment.

Defined results: null and empty texts have 0 tokens and score 0 (no prefix is put before nothing).
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbiter.llm.common import sole

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
KEPT_SEGMENT, KEPT_SEGMENTS = 64, 250_000


class Unigram(dict):
    """Segment -> (tokens, score), filled on demand and bounded."""

    def __init__(self, vocab: list[tuple[str, float]], unknown_id: int = 0, byte_fallback: bool = True):
        super().__init__()
        self.byte_fallback = byte_fallback and all(f"<0x{b:02X}>" in dict(vocab) for b in range(256))
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece and not self.automaton.exists(piece):
                self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        self.longest = max((len(p) for p, _ in vocab), default=1)
        self.unknown = min((s for _, s in vocab), default=0.0) - UNKNOWN_PENALTY
        exact = all(float(s).is_integer() for _, s in vocab)
        # Sums of whole numbers below 2^53 are exact, whatever the order of adding.
        self.exact_chars = int(2**52 / max(1.0, -self.unknown, *(abs(s) for _, s in vocab)))
        crossing = any(SPACE in p.lstrip(SPACE) for p, _ in vocab)
        newline = "" if any("\n" in p for p, _ in vocab) or not self.byte_fallback else "\n"
        self.cut = None if crossing or not exact else re.compile(
            f"{SPACE}*[^{SPACE}{newline}]+|{SPACE}+" + (f"|{newline}" if newline else "")
        )

    def __missing__(self, segment: str) -> tuple[int, float]:
        found = self.count(segment)
        if len(segment) <= KEPT_SEGMENT:
            if len(self) >= KEPT_SEGMENTS:
                self.clear()
            self[segment] = found
        return found

    def count(self, s: str) -> tuple[int, float]:
        """(tokens, score) of the best path over ``s``; memory of one longest piece."""
        size = self.longest + 1
        score, tokens, unk = [0.0] * size, [0] * size, [False] * size
        matches = self.automaton.iter(s)
        end, hit = next(matches, (-1, None))
        for i, ch in enumerate(s):
            best, n, u, single = None, 0, False, False
            while end == i:  # longest piece first: the earliest start first
                length, value = hit
                at = (i + 1 - length) % size
                cand = score[at] + value
                if best is None or cand > best:
                    best, n, u = cand, tokens[at] + 1, False
                single |= length == 1
                end, hit = next(matches, (-1, None))
            if not single:
                at = i % size
                cand = score[at] + self.unknown
                if best is None or cand > best:
                    more = len(ch.encode("utf-8", "surrogatepass")) if self.byte_fallback else not unk[at]
                    best, n, u = cand, tokens[at] + more, True
            at = (i + 1) % size
            score[at], tokens[at], unk[at] = best, n, u
        at = len(s) % size
        return (tokens[at], score[at]) if s else (0, 0.0)

    def of(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        s = SPACE + text.replace(" ", SPACE)
        if self.cut is None or len(s) > self.exact_chars:
            return self.count(s)
        parts = [*map(self.__getitem__, self.cut.findall(s))]
        return sum(p[0] for p in parts), float(sum(p[1] for p in parts))


def read_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) by id of a sentencepiece file; control pieces match no text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [("" if sp.is_control(i) else sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


@functools.lru_cache(maxsize=4)
def load(path: str) -> Unigram:
    return Unigram(read_pieces(path))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_tokens and the score of the best segmentation."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(path)
        sole(model)
        for pdf in batches:
            found = [model.of(t) for t in pdf["text"]]
            yield pd.DataFrame(
                {id_col: pdf["id"], "n_tokens": [f[0] for f in found], "score": [f[1] for f in found]}
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(
        run, f"{id_col} long, n_tokens long, score double"
    )
