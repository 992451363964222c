"""Exact, near and substring deduplication against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbiter.llm import exact_dedup, minhash, near_vectors, repeats
from arbiter.llm.common import components, shared_counts, with_position
from tests.llm import helpers as H


def test_binary_fuse_filter_has_no_false_negatives():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 10, 1000, 60_000):
        keys = np.unique(rng.integers(0, 2**60, n).astype(np.uint64))
        seed, segment, segments, table = exact_dedup.build_filter(keys)
        assert exact_dedup.may_contain(keys, seed, segment, segments, table).all()
        other = rng.integers(2**60, 2**61, 50_000).astype(np.uint64)
        assert exact_dedup.may_contain(other, seed, segment, segments, table).mean() < 1e-3


def test_exact_dedup_against_brute_force(spark):
    docs, texts = H.awkward_docs(spark)
    got = {r.id: r for r in exact_dedup.exact_dedup(docs).collect()}
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in texts.items()}
    groups = H.group_by_value(norm.items())
    assert got.keys() == texts.keys()
    for i, r in got.items():
        g = groups[norm[i]]
        sha = hashlib.sha256(norm[i].encode()).hexdigest()
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(g), len(g), i == min(g), sha)


def test_a_filter_positive_with_other_bytes_does_not_link(spark):
    docs = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "alpha")], "doc_id long, text string")
    d = exact_dedup.digests(docs)
    entries, filters = exact_dedup.build_snapshot(exact_dedup.group_batch(d.where("id < 3")), 1)
    # A batch whose digest claims to be that of document 1 although its text is another one.
    fake = d.where("id = 1").select(F.lit(2).cast("long").alias("id"), "digest")
    known = exact_dedup.match_snapshot(exact_dedup.group_batch(fake), entries, filters, 1, docs)
    assert known.count() == 0
    known = exact_dedup.match_snapshot(exact_dedup.group_batch(d.where("id = 3")), entries, filters, 1, docs)
    assert [r.old_id for r in known.collect()] == [1]


@pytest.mark.parametrize("words", [2, 5])
def test_near_dups_against_brute_force(spark, words):
    docs, texts = H.awkward_docs(spark, seed=words)
    want = H.near_groups(texts, words)
    got = {r.id: (r.n_shingles, r.component_id) for r in minhash.near_dups(docs, words=words).collect()}
    assert got == want


def test_near_dups_in_small_blocks(spark, monkeypatch):
    """A long list is dealt out over many blocks; chains of links need every one of them."""
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows, w = [], list(base)
    for i in range(80):
        w = list(w)
        w[rnd.randrange(60)] = f"v{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(minhash._between, "__defaults__", (7,))
    got = {r.id: (r.n_shingles, r.component_id) for r in minhash.near_dups(docs).collect()}
    assert got == H.near_groups(dict(rows))


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, j) for j in range(2, 60)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[j] == 1 for j in range(1, 60))


def test_shared_counts():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 50, rng.integers(0, 40))) for _ in range(30)]
    m = shared_counts(sets[:10], sets[10:])
    assert all(m[i, j] == len(set(sets[i]) & set(sets[10 + j])) for i in range(10) for j in range(20))


def test_near_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 24))
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=24) * rng.choice([0.05, 0.2, 0.3])], i % 3) for i in range(300)]
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(20)]
    rows += [
        (2000, None, 1), (2001, [0.0] * 24, 1), (2002, [float("nan")] + [1.0] * 23, 1), (2003, rows[0][1], None),
        (2004, [], 1), (2005, [1.0, None], 1), (2006, [float("inf")] * 24, 1), (2007, [1.0, 2.0], 1),
    ]
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], "vec_id long, embedding array<double>, label int, id long, m long")
    got = {r.id: r for r in near_vectors.near_vectors(df, block=16).collect()}
    ok = {i: np.array(v) / np.linalg.norm(v) for i, v, l in rows if l is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: l for i, v, l in rows}
    joined, links = H.Joined([r[0] for r in rows]), dict.fromkeys((r[0] for r in rows), 0)
    ids = sorted(ok)
    for x in ids:
        for y in ids:
            if x < y and label[x] == label[y] and len(ok[x]) == len(ok[y]) and ok[x] @ ok[y] >= 0.93:
                joined.join(x, y)
                links[x] += 1
                links[y] += 1
    found = sum(r.n_links for r in got.values())
    assert found >= 0.99 * sum(links.values()) and all(got[i].n_links <= links[i] for i in links)
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (2000, 2001, 2002, 2003, 2004, 2005, 2006))
    assert all(got[1000 + i].component_id == joined.find(1000 + i) for i in range(20))


def _removed(texts: dict, length: int) -> dict:
    seen, out = set(), {}
    for i, t in sorted(texts.items()):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                gone[p : p + length] = True
            seen.add(s)
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[i] = (len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_against_brute_force(spark):
    rnd = random.Random(9)
    docs, texts = H.awkward_docs(spark, seed=4)
    passage = "".join(rnd.choice("abcde fgh é") for _ in range(180))
    more = [
        (1000 + i, "".join(rnd.choice("xyz uvw") for _ in range(rnd.randint(0, 90))) + passage[rnd.randint(0, 60) : rnd.randint(100, 180)] + "q" * rnd.randint(0, 250))
        for i in range(60)
    ]
    more += [(2000, passage), (2001, passage[:100]), (2002, passage[:99]), (2003, passage + passage), (2004, "ab" * 400)]
    both = docs.select("doc_id", "text", "id", "at").unionByName(
        spark.createDataFrame([(*r, 1, 2) for r in more], "doc_id long, text string, id long, at long")
    )
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.drop_repeats(both).collect()}
    assert got == _removed(texts | dict(more), 100)


def test_repeats_in_portions(spark, monkeypatch):
    """A text longer than a portion is ranked in pieces with the same result."""
    rnd = random.Random(3)
    a = "".join(rnd.choice("abcdefgh ") for _ in range(3000))
    rows = {1: a, 2: a[500:2500] + "x" + a[:700], 3: "tail" + a[1990:2600]}
    monkeypatch.setattr(repeats, "PORTION", 256)
    runs = repeats._runs(np.frombuffer(a.encode(), np.uint8), 100)
    assert int((runs[3] + 1).sum()) == len(a) - 99  # every window once
    monkeypatch.undo()
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.drop_repeats(docs).collect()}
    assert got == _removed(rows, 100)


def test_positions_are_gapless_in_every_group(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 != 0, F.lit("b")).alias("g"))
    rows = with_position(df, ["g"], ["id"], "p", 5000, per_bucket=200).collect()
    for g in ("hot", "b", None):
        p = sorted(r.p for r in rows if r.g == g)
        assert p == list(range(len(p))) and p


def test_empty_tables(spark):
    docs = H.empty_docs(spark)
    assert exact_dedup.exact_dedup(docs).count() == 0
    assert minhash.near_dups(docs).count() == 0
    assert repeats.drop_repeats(docs).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert near_vectors.near_vectors(vectors).count() == 0


# ---- rows that share an id -----------------------------------------------------------------------


def rows_in_order(docs):
    """Rows as the operators order them: by id, null last."""
    return sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is None, r[0] or 0))


def test_near_dups_of_repeated_ids(spark):
    docs = H.with_repeated_ids(spark, H.awkward_docs(spark)[0])
    rows = rows_in_order(docs)
    want = H.near_groups(dict(enumerate(t for _, t in rows)))
    want = [(rows[k][0], n, rows[c][0] if n else rows[k][0]) for k, (n, c) in want.items()]
    got = minhash.near_dups(docs).collect()
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(want, key=str)
    assert all(r.kept == (r.id == r.component_id) for r in got)


def test_repeats_of_repeated_ids(spark):
    """Rows of one id are told apart: the first copy of a string stays somewhere."""
    rnd = random.Random(8)
    a, b = ("".join(rnd.choice("abcdefgh ") for _ in range(n)) for n in (400, 250))
    rows = [(1, a), (1, a), (2, "start " + a[100:350] + " end"), (2, b), (3, b + "x"), (None, a), (4, None), (4, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.id, r.n_bytes, r.n_removed, r.n_spans) for r in repeats.drop_repeats(docs).collect()), key=str)
    want = [(1, 400, 0, 0), (1, 400, 400, 1), (2, 250, 0, 0), (2, 260, 250, 1), (3, 251, 250, 1), (None, 400, 400, 1), (4, 0, 0, 0), (4, 5, 0, 0)]
    assert got == sorted(want, key=str)


def test_near_vectors_of_repeated_ids(spark):
    v = lambda *x: [float(i) for i in x]
    rows = [(1, v(1, 0, 0), 1), (1, v(0, 1, 0), 1), (2, v(1, 0.01, 0), 1), (2, v(1, 0.01, 0), 1), (3, v(0, 0, 1), 1), (None, v(0, 1, 0.01), 1)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(((r.id, r.n_links, r.component_id) for r in near_vectors.near_vectors(docs).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 1, 1), (2, 2, 1), (2, 2, 1), (3, 0, 3), (None, 1, 1)], key=str)
