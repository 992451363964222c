"""Quality classifier from weak labels.

1. Overlapping heuristic labellers look at a whole document and vote good, bad or abstain.
2. Votes are counted by pattern in Spark: at most 3^m patterns for m labellers, whatever the corpus.
   Expectation-maximisation over that table estimates each labeller's confusion with the unknown
   class, and with it the posterior of every pattern.
3. Posterior labels train a hashed linear scorer (logistic regression over hashed word shapes) on a
   bounded sample (``SAMPLE`` documents, by hash of the id; everything else covers all documents).
4. The scorer judges every whole document; those it is sure are bad are rejected.

Defined results: null and empty texts draw no vote and are kept (nothing speaks against them); texts
under ``MIN_WORDS`` words are judged by their votes; an empty table gives an empty result; extra
columns are ignored; equal texts get equal scores; rows of a repeated id share one row's votes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbiter.llm.common import by_row, lean, sole, staged

#: Documents that train the scorer, and the size of its hashed weight vector.
SAMPLE, DIMENSIONS = 3000, 1 << 12
#: Probability of "bad" above which a document is rejected.
REJECT = 0.8
#: A shorter text shows too few shapes for the scorer: its votes alone decide.
MIN_WORDS = 8
KEPT_WORDS, KEPT_CHARS = 200_000, 200

# Frequent function words of the four languages of the corpus.
STOP_WORDS = frozenset(
    "the of and to in a is that for it was on with as are be this by from at or an have not "
    "le la de et les des en un une est que pour dans qui sur au avec pas il elle "
    "der die das und ist von zu den mit für auf im dem nicht ein eine als sich "
    "el los las y del que por con una para se su al es".split()
)
GOOD, BAD, NONE = 1, 0, 2
#: Byte classes: 1 lower case, 2 upper case, 3 marks, 4 shouting, 0 all else.
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123], _CLASS[65:91] = 1, 2
_CLASS[[*b"#$%&*|@^~<>{}[]=_/+"]], _CLASS[[*b"!?"]] = 3, 4
_PROSE = re.compile(r"[^\W\d_]+[.,;:]?")


class _Words(dict):
    """Word -> 1 for a function word, plus 2 for letters only (a stop after them is fine)."""

    def __missing__(self, w: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        v = self[w] = (w.lower().rstrip(".,;:") in STOP_WORDS) + 2 * bool(_PROSE.fullmatch(w))
        return v


_WORDS = _Words()


class Look:
    """What the labellers see of a text, measured once over all of it."""

    def __init__(self, text: str):
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        _, self.lower, self.upper, self.marks, self.shouts = np.bincount(_CLASS[raw], minlength=5).tolist()
        words = text.split()
        self.n = max(1, len(words))
        kind = np.bincount(np.fromiter(map(_WORDS.__getitem__, words), np.int64, len(words)), minlength=4)
        self.stop, self.prose = (kind[1] + kind[3]) / self.n, (kind[2] + kind[3]) / self.n
        self.bars = words.count("|") / self.n
        self.again = sum(map(str.__eq__, words, words[1:])) / self.n
        self.distinct = len(set(words)) / self.n
        self.length = (len(text) - self.n) / self.n


def _marks(x):
    return BAD if x.marks / x.n >= 0.25 else NONE


def _capitals(x):
    return BAD if x.upper + x.lower >= 8 and x.upper >= 0.4 * (x.upper + x.lower) else NONE


def _shouting(x):
    return BAD if x.shouts / x.n >= 0.3 else NONE


def _table(x):
    return BAD if x.bars >= 0.1 else NONE


def _repetition(x):
    return BAD if x.n >= 8 and x.again >= 0.15 else NONE


def _few_words(x):
    return BAD if x.n >= 30 and x.distinct < 0.25 and x.n * x.distinct < 200 else NONE


def _stop_words(x):
    return GOOD if x.stop >= 0.06 and x.again <= 0.15 else BAD if x.stop < 0.015 and x.n >= 30 else NONE


def _prose(x):
    return GOOD if x.prose >= 0.9 and x.again <= 0.05 else BAD if x.prose < 0.6 and x.n >= 5 else NONE


def _word_length(x):
    return NONE if x.n < 8 else BAD if x.length > 14 or x.length < 1.2 else NONE


def _calm(x):
    return GOOD if (x.marks + x.shouts) / x.n <= 0.03 and x.again <= 0.05 else NONE


#: Overlapping on purpose: each kind of junk is seen by several labellers.
LABELLERS = (_marks, _capitals, _shouting, _table, _repetition, _few_words, _stop_words, _prose, _word_length, _calm)


def votes(text: str | None) -> int:
    """The votes of all labellers as one number in base 3."""
    x = Look(text) if text and not text.isspace() else None
    out = 0
    for f in LABELLERS:
        out = out * 3 + (f(x) if x else NONE)
    return out


def vote_table(patterns: np.ndarray) -> np.ndarray:
    m = len(LABELLERS)
    return patterns[:, None] // 3 ** np.arange(m - 1, -1, -1)[None, :] % 3


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> dict:
    """Accuracy of each labeller where it votes, class prior, and posterior "bad" per pattern.

    An abstention says nothing. A labeller starts at 0.8 and carries the weight of a few votes at
    that value; accuracies stay above one half, so the classes cannot change places.
    """
    v = vote_table(np.asarray(patterns, np.int64))
    w = np.asarray(counts, float)
    says_bad, says_good = v == BAD, v == GOOD
    accuracy, prior, bad = np.full(v.shape[1], 0.8), 0.2, np.zeros(len(w))
    for _ in range(rounds):
        weight = np.log(accuracy) - np.log1p(-accuracy)
        z = np.log(prior) - np.log1p(-prior) + says_bad @ weight - says_good @ weight
        new = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        right = (w * new) @ says_bad + (w * (1 - new)) @ says_good
        cast = w @ (says_bad | says_good)
        accuracy = np.clip((right + 8) / (cast + 10), 0.55, 0.99)
        prior = float(np.clip((w @ new + 2) / (w.sum() + 10), 0.01, 0.5))
        done = np.abs(new - bad).max(initial=0) < 1e-12
        bad = new
        if done:
            break
    return {"prior": prior, "accuracy": accuracy, "bad": dict(zip(np.asarray(patterns).tolist(), bad.tolist()))}


class _Shapes(dict):
    """Word -> (shape hash): letters to a or A, digits to 0, runs shortened, marks as they are."""

    def __missing__(self, w: str) -> int:
        s = "".join("a" if c.islower() else "A" if c.isalpha() else "0" if c.isdigit() else c for c in w)
        h = xxhash.xxh64_intdigest(re.sub(r"(.)\1+", r"\1", s).encode("utf-8", "surrogatepass"))
        if len(w) <= KEPT_CHARS:  # the whole word has a shape, only short ones are remembered
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[w] = h
        return h


_SHAPES = _Shapes()
_U = np.uint64


def features(text: str | None, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Hashed positions of a text's word shapes, pairs of shapes, and repeated words."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.int64)
    s = np.fromiter(map(_SHAPES.__getitem__, words), _U, len(words))
    pair = (s[:-1] * _U(0x9E3779B97F4A7C15) + s[1:]) * _U(0xBF58476D1CE4E5B9) >> _U(20)
    same = np.fromiter(map(str.__eq__, words, words[1:]), bool, len(words) - 1)
    again = np.full(int(same.sum()), 7, _U)
    return (np.concatenate([s, pair, again]) % _U(dimensions)).astype(np.int64)


def train(rows: list[np.ndarray], target: np.ndarray, dimensions: int = DIMENSIONS, steps: int = 200) -> np.ndarray:
    """Logistic regression with soft targets; weights, then the bias. Features are shares of a text."""
    # Only positions that several texts use get a weight.
    used = np.bincount(np.concatenate([[], *(np.unique(r) for r in rows)]).astype(np.int64), minlength=dimensions)
    kept = np.flatnonzero(used >= 3)
    x = np.zeros((len(rows), len(kept) + 1), np.float32)
    x[:, -1] = 1
    for i, r in enumerate(rows):
        if len(r):
            x[i, :-1] = np.sqrt(np.bincount(r, minlength=dimensions)[kept] / len(r))
    y = np.asarray(target, np.float32)
    w = momentum = np.zeros(x.shape[1], np.float32)
    for _ in range(steps):
        e = (1 / (1 + np.exp(-(x @ w))) - y) / np.float32(max(1, len(y)))
        momentum = np.float32(0.9) * momentum - np.float32(4.0) * (x.T @ e + np.float32(1e-5) * w)
        w = w + momentum
    out = np.zeros(dimensions + 1)
    out[kept], out[-1] = w[:-1], w[-1]
    return out


def score(text: str | None, w: np.ndarray) -> float:
    """Probability that a whole text is bad."""
    f = features(text, len(w) - 1)
    z = w[-1]
    if len(f):
        z = z + w[:-1] @ np.sqrt(np.bincount(f, minlength=len(w) - 1) / len(f))
    return float(1 / (1 + np.exp(-z)))


def _judge(text: str | None, w: np.ndarray) -> tuple[float, bool]:
    """(scorer's probability of "bad", whether the text is too short for it)."""
    if not text:
        return 0.0, True
    return score(text, w), len(text.split(None, MIN_WORDS)) < MIN_WORDS


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> dict:
    """Votes of every document (staged), posterior "bad" by vote pattern, and the scorer's weights."""
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sole(_WORDS, _SHAPES)
        for pdf in batches:
            pdf["votes"] = [votes(t) for t in pdf["text"]]
            yield pdf[["id", "votes"]]

    voted = staged(text.mapInPandas(vote, "id long, votes int"), "votes")
    table = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3^m rows
    model = expectation_maximisation(np.array([r.votes for r in table], int), np.array([r.n for r in table], int))

    # A hash threshold picks about ``sample`` documents in one scan, on any partitioning.
    rows = sum(r.n for r in table)
    bound = int(2**64 * min(1.0, sample / max(1, rows)) - 2**63) - 1
    picked = staged(voted.where(F.xxhash64("id", F.lit(4)) <= F.lit(min(bound, 2**63 - 1))).limit(2 * sample), "sample")

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sole(_WORDS, _SHAPES)
        for pdf in batches:
            yield pd.DataFrame({"votes": pdf["votes"], "f": [np.sort(features(t)).astype(np.int32) for t in pdf["text"]]})

    training = text.join(picked, "id").mapInPandas(featured, "votes int, f array<int>").collect()
    training.sort(key=lambda r: (r.votes, r.f))
    w = train([np.array(r.f, np.int64) for r in training], np.array([model["bad"][r.votes] for r in training]))
    return model | {"voted": voted, "weights": w}


def classify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, reject: float = REJECT
) -> DataFrame:
    """One row per document: id, votes, weak_bad (posterior of its votes), bad (scorer), kept.

    Rows that share an id are judged each by its own text.
    """
    docs = docs.select(id_col, text_col)
    return by_row(docs, id_col, text_col, lambda d: _classify(d, id_col, text_col, sample, reject))


def _classify(docs: DataFrame, id_col: str, text_col: str, sample: int, reject: float) -> DataFrame:
    """`classify` of distinct ids."""
    model = fit(docs, id_col, text_col, sample)
    w, posterior = model["weights"], model["bad"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sole(_WORDS, _SHAPES)
        for pdf in batches:
            found = [_judge(t, w) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "bad": [f[0] for f in found], "short": [f[1] for f in found]})

    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scored = text.mapInPandas(run, "id long, bad double, short boolean")
    voted = model["voted"]
    table = voted.sparkSession.createDataFrame([*posterior.items()] or [(0, 0.0)], "votes int, weak_bad double")
    weak = staged(voted.join(F.broadcast(table), "votes", "left"), "weak")  # at most 3^m rows
    verdict = F.when(F.col("short"), F.col("weak_bad")).otherwise(F.col("bad"))
    return scored.join(weak, "id", "left").select(
        "id", "votes", F.round("weak_bad", 9).alias("weak_bad"), F.round("bad", 9).alias("bad"),
        F.coalesce(verdict < reject, F.lit(True)).alias("kept"),
    )


def keep_good(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, reject: float = REJECT
) -> DataFrame:
    """The rows of ``docs``, all columns, that `classify` keeps; judged where they are read."""
    model = fit(docs, id_col, text_col, sample)
    w, posterior = model["weights"], model["bad"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole(_WORDS, _SHAPES)
        for batch in batches:
            keep = []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                bad, short = _judge(t, w)
                keep.append((posterior[votes(t)] if short else bad) < reject)
            # Arrow hands the other columns through as they are, whatever their types.
            yield batch.select([*range(batch.num_columns - 1)]).filter(pa.array(keep, pa.bool_()))

    return docs.withColumn("_t", F.col(text_col)).mapInArrow(lean(run), docs.schema)
