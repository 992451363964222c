"""Fingerprints, tokenizer alignment and vector codes against brute force."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import public_tokenizers as P
import pytest

from arbiter.llm import alignment as al
from arbiter.llm import fingerprints as fp
from arbiter.llm import vector_codes as vc
from tests.llm import helpers as H


def with_repeats(spark, docs):
    """The awkward documents, rows that stand twice, other texts under a known id, and a null id."""
    rows = docs.where("doc_id < 60")
    other = rows.selectExpr("doc_id", "concat(coalesce(text, ''), ' more')", "source", "id", "n", "value", "label", "shard", "at")
    null = docs.where("doc_id = 9").selectExpr("CAST(null AS long)", "text", "source", "id", "n", "value", "label", "shard", "at")
    return docs.union(rows).union(other).union(null)


# ---- fingerprints --------------------------------------------------------------------------------


def test_spans_and_extensions_equal_brute_force():
    rnd = random.Random(3)
    texts = ["", "a", "abab" * 40, "".join(rnd.choice("ab") for _ in range(300)), "x😀日" * 50 + "y"]
    pre = [fp.Prefixes.of(fp.code_points(t)) for t in texts]
    for a, p in zip(texts, pre):
        for b, q in zip(texts, pre):
            for _ in range(60):
                i, j = rnd.randint(0, len(a)), rnd.randint(0, len(b))
                n = rnd.randint(0, min(len(a) - i, len(b) - j))
                assert p.same(i, q, j, n) == (a[i : i + n] == b[j : j + n])
                lce = next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))
                assert p.extension(i, q, j) == lce
        assert p.cut(len(a) // 2).extended(fp.code_points(a[len(a) // 2 :])).span(0, len(a)) == p.span(0, len(a))
        if len(a) >= 4:
            both = zip(p.spans(4, base=0).tolist(), p.spans(4, base=1).tolist())
            assert [x << 31 | y for x, y in both] == [p.span(i, 4) for i in range(len(a) - 3)]


def test_likeness_is_the_share_of_common_spans():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(400)]
    for _ in range(30):
        a = " ".join(rnd.choice(words) for _ in range(300))
        cut = rnd.randint(0, len(a))
        b = a[:cut] + " ".join(rnd.choice(words) for _ in range(300))[: len(a) - cut]
        x, y = ({(a[i : i + 6], k) for i, k in _nth(a)}, {(b[i : i + 6], k) for i, k in _nth(b)})
        j = len(x & y) / len(x | y)
        assert abs(fp.likeness(fp.fingerprint(a), fp.fingerprint(b)) - 2 * j / (1 + j)) < 0.25
    assert fp.likeness(fp.fingerprint(""), fp.fingerprint(None)) == 1
    assert fp.likeness(fp.fingerprint(""), fp.fingerprint("a")) == 0


def _nth(t):
    seen: dict = {}
    for i in range(len(t) - 5):
        seen[t[i : i + 6]] = seen.get(t[i : i + 6], -1) + 1
        yield i, seen[t[i : i + 6]]


@pytest.mark.parametrize("rows_per_range", [7, 10_000])
def test_fingerprints_follow_the_order_of_ids(spark, rows_per_range):
    docs, texts = H.awkward_docs(spark)
    got = {r["id"]: r for r in fp.fingerprints(docs, rows_per_range=rows_per_range).collect()}
    ids = sorted(texts)
    assert sorted(got) == ids
    for i, after in zip(ids, ids[1:] + ids[:1]):
        t, u = texts[i] or "", texts[after] or ""
        q = len(t) // 4
        e, r = t[: len(t) - q] + u[:q], got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fp.fingerprint(t), fp.fingerprint(e))
        assert r["near_edited"] == fp.likeness(fp.fingerprint(t), fp.fingerprint(e))
        assert r["near_next"] == fp.likeness(fp.fingerprint(t), fp.fingerprint(u))
        assert r["same_start_edited"] >= len(t) - q or t == e
    prints = {t or "": fp.fingerprint(t) for t in texts.values()}
    assert len(set(prints.values())) == len(prints)


def test_fingerprints_of_repeated_null_and_no_rows(spark):
    docs, _ = H.awkward_docs(spark)
    docs = with_repeats(spark, docs)
    out = fp.fingerprints(docs, rows_per_range=11)
    assert out.count() == docs.count() and out.where("id IS NULL").count() == 1
    assert fp.fingerprints(H.empty_docs(spark)).collect() == []
    one = fp.fingerprints(docs.where("doc_id = 63")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1


# ---- vector codes --------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, code string, row long"


def lloyd(rows, parts, entries, rounds, scale):
    """Plain Lloyd rounds in Python integers over (vec_id, embedding) rows in order."""
    ints = [[math.floor(scale * float(np.float32(x))) for x in e] for _, e in rows]
    w = len(ints[0]) // parts
    cut = [[v[p * w : (p + 1) * w] for v in ints] for p in range(parts)]
    books = [[list(v) for v in cut[p][:entries]] for p in range(parts)]
    far = lambda x, b: sum((i - j) ** 2 for i, j in zip(x, b))
    nearest = lambda p, x: min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            code = [nearest(p, x) for x in cut[p]]
            for e in range(len(books[p])):
                own = [x for x, c in zip(cut[p], code) if c == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    codes = [[nearest(p, cut[p][i]) for p in range(parts)] for i in range(len(ints))]
    error = [sum(far(cut[p][i], books[p][c]) for p, c in enumerate(code)) for i, code in enumerate(codes)]
    text = ",".join(str(c) for p in books for e in p for c in e)
    return codes, error, hashlib.sha256(text.encode()).hexdigest()


def vector_rows(seed, n, width=16):
    rnd = random.Random(seed)
    centre = [[rnd.uniform(-1, 1) for _ in range(width)] for _ in range(9)]
    rows = [
        (i * 2, [x + rnd.gauss(0, rnd.choice([0, 0.01, 0.3])) for x in rnd.choice(centre)], rnd.choice([None, 1, 2]), "x", 5)
        for i in range(n)
    ]
    rows += [rows[3], rows[4], (rows[2][0], rows[n - 1][1], 1, "x", 5)]  # repeated rows and ids
    bad = [None, [], [None] + [0.5] * (width - 1), [float("nan")] * width, [float("-inf")] * width, [0.5] * (width - 1), [1.0] * 2 * width]
    return rows + [(10_000 + i, v, 3, None, None) for i, v in enumerate(bad)]


@pytest.mark.parametrize("n,block", [(700, 64), (300, 4096), (5, 4096)])
def test_vector_codes_equal_plain_lloyd(spark, n, block):
    rows = vector_rows(n, n)
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = vc.vector_codes(df, parts=4, block=block).collect()
    kept = sorted(((r[0], [float(np.float32(x)) for x in r[1]], r[2]) for r in rows if r[0] < 10_000), key=lambda r: (r[0], r[1]))
    codes, error, digest = lloyd([r[:2] for r in kept], 4, 16, 6, 4096)
    total = {}
    for (_, _, label), e in zip(kept, error):
        total[label] = total.get(label, 0) + e
    want = sorted(
        (r[0], "".join(f"{c:02x}" for c in code), e, total[r[2]], digest) for r, code, e in zip(kept, codes, error)
    )
    assert sorted(map(tuple, got)) == want


def test_vector_codes_of_no_rows_and_equal_vectors(spark):
    assert vc.vector_codes(spark.createDataFrame([], VECTORS)).collect() == []
    same = spark.createDataFrame([(i, [0.25] * 16, None, None, None) for i in range(40)], VECTORS)
    got = vc.vector_codes(same, parts=4).collect()
    assert {(r["code"], r["error"], r["label_error"]) for r in got} == {("00000000", 0, 0)} and len(got) == 40


def test_few_combinations_reach_the_leaves():
    """Node bounds decide most rows of well separated groups without a distance of their own."""
    rnd = np.random.default_rng(1)
    pts = (rnd.integers(0, 8, 4000)[:, None] * 5000 + rnd.integers(0, 300, (4000, 8))).astype(np.int64)
    row = vc._pack([vc.PartTree(pts)], pts)
    block, seen = vc.Block(row, 1, 8), {"whole": 0, "leaf": 0}
    tree = vc.EntryTree(np.arange(8)[:, None] * 5000 + np.full((8, 8), 150))
    vc._assign(
        block, 0, tree, lambda at, runs, e: seen.update(whole=seen["whole"] + int((runs[1] - runs[0]).sum())),
        lambda rows, e: seen.update(leaf=seen["leaf"] + len(rows)),
    )
    assert sum(seen.values()) == 4000 and seen["leaf"] < 400


# ---- alignment -----------------------------------------------------------------------------------

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute_alignment(libraries, texts):
    """[(n_a, n_b, n_groups, n_links, n_best, count_sum, digest)] from the libraries on whole texts."""
    a, b = libraries
    letters = al._byte_letters()
    rows, count = [], {}
    for t in texts:
        groups, links = [], []
        if t:
            raw = (" " + t).encode()
            x = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids]
            y = [
                (i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode())
                for i in b.encode(t)
            ]
            if b"".join(v for _, v in x) == raw == b"".join(v for _, v in y):
                spans = []
                for tokens in (x, y):
                    at, out = 0, []
                    for i, v in tokens:
                        out.append((i, at, at + len(v)))
                        at += len(v)
                    spans.append(out)
                ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
                lo = 0
                for e in ends:
                    own = [[s for s in side if lo < s[2] <= e] for side in spans]
                    groups.append(",".join(str(s[0]) for s in own[0]) + "|" + ",".join(str(s[0]) for s in own[1]))
                    links += [(p[0], q[0]) for p in own[0] for q in own[1] if p[1] < q[2] and q[1] < p[2]]
                    lo = e
        if not groups:
            x = y = []
        for link in links:
            count[link] = count.get(link, 0) + 1
        rows.append((len(x), len(y), groups, links))
    top = {}
    for (_, q), n in count.items():
        top[q] = max(top.get(q, 0), n)
    return [
        (
            n_a, n_b, len(groups), len(links), sum(count[v] == top[v[1]] for v in links), sum(count[v] for v in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
        )
        for n_a, n_b, groups, links in rows
    ]


TEXTS = [
    "a  b", " a", "a ", "  ", "\n \n x\n y \t z", "Ähnliche Wörter, don't we'll 12345 <|endoftext|> </s> <0x41>", "x\u2581y",
    "日本語の文章 と😀絵文字", "supercalifragilistic" * 300, "a\x00b\x1c c\u00a0 d \x85 e", "ab " * 30, "\u3000 \u2003 .", "é" * 900,
]


@pytest.mark.parametrize("chunk,fan", [(40, 2), (300, 3), (32_768, 16)])
def test_alignment_equals_brute_force(spark, libraries, chunk, fan, monkeypatch):
    monkeypatch.setattr(al, "WORD", 30)
    docs, _ = H.awkward_docs(spark)
    more = spark.createDataFrame([(500 + i, t, None, 0, 0, "", None, 0, 0) for i, t in enumerate(TEXTS)], H.SCHEMA)
    docs = with_repeats(spark, docs.where("length(text) < 3000 OR text IS NULL")).union(more)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute_alignment(libraries, [t for _, t in rows])
    want = sorted(((i, *w) for (i, _), w in zip(rows, want)), key=str)
    got = al.align(docs, A, B, chunk=chunk, fan=fan, hot=50).collect()
    assert sorted(map(tuple, got), key=str) == want


def test_fragments_compose_in_any_order(monkeypatch):
    monkeypatch.setattr(al, "WORD", 400)
    pair = al.Pair(A, B)
    rnd = random.Random(4)
    for t in TEXTS[-5:] + ["".join(rnd.choice("ab é日 .\n") for _ in range(400)) for _ in range(10)]:
        if not pair.tokens(t)[2]:
            continue
        parts = [al.range_fragment(pair, *c) for c in al.cut_ranges(t, rnd.choice([3, 7, 20]))]
        assert len(parts) > 3 or len(t) < 60 or len(t) > 400
        left = parts[0]
        for p in parts[1:]:
            left = al.compose(pair, left, p)
        while len(parts) > 1:
            i = rnd.randrange(len(parts) - 1)
            parts[i : i + 2] = [al.compose(pair, *parts[i : i + 2])]
        rows = [al._closed(f) for f in (left, parts[0], al.compose(pair, al.Fragment(), left))] + [al._whole(pair, t)]
        assert len({r[:5] for r in rows}) == 1 and rows[0][0] > 0
        assert len({(tuple(r[5]), tuple(r[6])) for r in rows}) == 1


def test_both_encoders_of_a_agree(libraries):
    pair = al.Pair(A, B)
    assert pair.usual is not None
    rnd = random.Random(9)
    more = ["".join(rnd.choice("abcé日 '\n\t.,1٣x\u00a0\x1c😀") for _ in range(200)) for _ in range(300)]
    for t in TEXTS + more:
        assert pair.usual.encode_ordinary(t) == libraries[0].encode(t, add_special_tokens=False).ids


def test_alignment_of_no_rows(spark):
    assert al.align(H.empty_docs(spark), A, B).collect() == []
