"""Small tables with awkward rows, and brute-force versions of the operators."""

from __future__ import annotations

import collections
import random

SCHEMA = "doc_id long, text string, source string, id long, n long, value string, label string, shard int, at long"


def awkward_docs(spark, seed: int = 1, n: int = 120):
    """Nulls, empty and white-space texts, a very long one, copies, near copies, clashing columns."""
    rnd = random.Random(seed)
    words = [a + b for a in "bcdfgklmnprst" for b in ("a", "en", "ot", "ier", "usch")]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 90))) for _ in range(25)]
    texts = [None, "", " ", "\t\n", "One", "one", "One two", "A" * 5000, " ".join(rnd.choice(words) for _ in range(6000)), "ba " * 300]
    while len(texts) < n:
        t = rnd.choice(base)
        kind = rnd.random()
        if kind < 0.3:
            w = t.split()
            w[rnd.randrange(len(w))] = rnd.choice(words)
            t = " ".join(w)
        elif kind < 0.4:
            t = t.replace(" ", rnd.choice(["  ", "\n", "\t"]), 2)
        elif kind < 0.5:
            t = t.upper()
        elif kind < 0.6:
            t = t + "\n" + rnd.choice(base)
        texts.append(t)
    order = list(range(len(texts)))
    rnd.shuffle(order)
    rows = [
        (i * 3, texts[j], None if i % 17 == 0 else "hot" if i % 3 else f"s{i % 5}", -1, 7, "x", None, 3, 9)
        for i, j in enumerate(order)
    ]
    return spark.createDataFrame(rows, SCHEMA), {r[0]: r[1] for r in rows}


def with_repeated_ids(spark, docs):
    """Rows that stand twice, rows with another text under a known id, and rows without an id."""
    twice = docs.where("doc_id < 60")
    kept = [c for c in docs.columns if c not in ("doc_id", "text")]
    other = docs.where("doc_id BETWEEN 30 AND 120").selectExpr("doc_id + 3 AS doc_id", "concat(text, ' more')  AS text", *kept)
    null = docs.where("doc_id IN (63, 66)").selectExpr("CAST(null AS long) AS doc_id", "text", *kept)
    return docs.union(twice).union(other).union(null).repartition(5)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


class Joined:
    """Union-find with the least member as the name of a set."""

    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    k = min(k, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def near_groups(texts: dict, k: int = 2, percent: int = 80) -> dict:
    sets = {i: shingles(t, k) for i, t in texts.items()}
    joined = Joined(sets)
    ids = sorted(i for i, s in sets.items() if s)
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            if 100 * len(a & b) >= percent * len(a | b):
                joined.join(ids[x], ids[y])
    return {i: (len(sets[i]), joined.find(i)) for i in sets}


def group_by_value(pairs):
    out = collections.defaultdict(list)
    for k, v in pairs:
        out[v].append(k)
    return out
