"""Tokenisers against the library, the quality classifier on held-out labels, licence lines."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer, models, normalizers

from arbiter.llm import bpe, licences, quality, token_counts
from tests.conftest import SF01
from tests.llm import helpers as H

HARD = [
    "", "   ", "don't WE'LL x's 'submarine", "İstanbul ΣΑΣ éa ẛ̣ ﬁ 𝔘𝔫𝔦 日本語 😀😀", "a<|endoftext|> b<|startoftext|><| |>",
    "Ⅷ ½ ٣ 42", "a" * 9000, "é" * 3000, "\x00\x01　  x​y", "<s> ▁ a▁b  c\n\nd",
]


@pytest.fixture(scope="module")
def word_bpe():
    return bpe.load(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))


def _random_words(seed=1):
    rnd = random.Random(seed)
    out = ["".join(rnd.choice(a) for _ in range(n)) for a in ("ab", "etaoinshr", "aé漢") for n in (40, 400, 4000)]
    return out + ["".join(rnd.choice(["in", "ing", "th", "the", "tion", "s"]) for _ in range(2000))]


def test_encoding_and_decoding_equal_the_library(word_bpe):
    own, library = word_bpe
    for t in HARD + _random_words():
        ids = np.frombuffer(b"".join(own.encode(t)), "<u4").tolist()
        want = library.encode(t, add_special_tokens=False).ids
        assert ids == want
        d = bpe.TokenDecoder(own)
        text = b"".join(d.feed(ids[i : i + 3]) for i in range(0, len(ids), 3)) + d.finish()
        assert text.decode() == library.decode(want, skip_special_tokens=False)


def test_streaming_with_the_computed_lookahead_is_exact(word_bpe):
    own, _ = word_bpe
    for t in _random_words(2):
        raw = t.encode()
        assert own.encode_piece(raw, 16) == own.encode_piece(raw, 10**9)


def test_transducer_memory_is_bounded(word_bpe):
    own, _ = word_bpe
    t = bpe.PieceTransducer(own.rank, own.length, own.lookahead, 64)
    most = 0
    for _ in range(200):
        t.feed([own.inner[b] for b in b"thingstionabcd"])
        most = max(most, len(t.buffer))
    assert most <= 64 + own.lookahead


def test_lookahead_of_a_small_merge_list():
    # b c merges first, so "a b" depends on the next symbol: one symbol after b, two after a.
    length = {0: 1, 1: 1, 2: 1, 3: 2, 4: 2}
    assert bpe.sufficient_lookahead([(1, 2, 3), (0, 1, 4)], length) == 2
    assert bpe.sufficient_lookahead([], {}) == 0


def test_byte_decoder_holds_back_unfinished_characters(word_bpe):
    own, _ = word_bpe
    text = "日本 語 é a"
    ids = np.frombuffer(b"".join(own.encode(text)), "<u4").tolist()
    d = bpe.TokenDecoder(own, spaced=False)
    out = "".join(d.feed([i]) for i in ids) + d.finish()
    assert out == "日本 語 é a "  # every word end is a space


def test_round_trip_table(spark, word_bpe):
    own, library = word_bpe
    docs, texts = H.awkward_docs(spark, n=40)
    got = {r.doc_id: r for r in bpe.round_trip(docs, P.path("word_bpe_49k.json")).collect()}
    for i, t in texts.items():
        e = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(e)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(e, skip_special_tokens=False).encode()).hexdigest()
    encoded = bpe.encode_table(docs, P.path("word_bpe_49k.json"))
    back = {r.doc_id: r.text for r in bpe.decode_table(encoded, P.path("word_bpe_49k.json")).collect()}
    assert all(back[i].split() == (t or "").lower().split() for i, t in texts.items())
    assert bpe.round_trip(H.empty_docs(spark), P.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("fallback", [True, False])
def test_token_counts_equal_the_library(fallback):
    pieces = token_counts.read_pieces(P.path("piece_bpe_32k.model"))
    own = token_counts.Unigram(pieces, byte_fallback=fallback)
    vocab = [(p or f"\x00control{i}", s) for i, (p, s) in enumerate(pieces)]
    library = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=fallback))
    library.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    for t in HARD + _random_words():
        if len(t) <= 5000 and "\x00" not in t:
            assert own.of(t)[0] == len(library.encode(t, add_special_tokens=False).ids), t[:60]


def test_ties_and_uneven_scores_equal_the_library():
    rnd = random.Random(4)
    for scores in ([-1.0, -2.0, -3.0], [-0.1, -0.2, -0.3, -0.7]):
        parts = sorted({"".join(rnd.choice("ab▁") for _ in range(rnd.randint(1, 4))) for _ in range(40)})
        vocab = [("<unk>", 0.0), *((p, rnd.choice(scores)) for p in parts)]
        own = token_counts.Unigram(vocab, byte_fallback=False)
        library = Tokenizer(models.Unigram(vocab, unk_id=0))
        library.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
        for _ in range(200):
            t = "".join(rnd.choice("abbc ") for _ in range(rnd.randint(1, 30)))
            assert own.of(t)[0] == len(library.encode(t, add_special_tokens=False).ids), (t, vocab)


def test_token_count_table(spark):
    docs, texts = H.awkward_docs(spark, n=30)
    model = token_counts.load(P.path("piece_bpe_32k.model"))
    rows = token_counts.token_counts(docs, P.path("piece_bpe_32k.model")).collect()
    assert {r.doc_id: (r.n_tokens, r.score) for r in rows} == {i: model.of(t) for i, t in texts.items()}
    assert token_counts.token_counts(H.empty_docs(spark), P.path("piece_bpe_32k.model")).count() == 0


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(1)
    m = len(quality.LABELLERS)
    accuracy = np.array([0.95, 0.9, 0.85, 0.8, 0.75, 0.95, 0.9, 0.85, 0.8, 0.9])[:m]
    bad = rng.random(20_000) < 0.3
    right = rng.random((20_000, m)) < accuracy
    v = np.where(right == bad[:, None], quality.BAD, quality.GOOD)
    v[rng.random(v.shape) < 0.4] = quality.NONE
    code = (v * 3 ** np.arange(m - 1, -1, -1)).sum(axis=1)
    patterns, counts = np.unique(code, return_counts=True)
    model = quality.expectation_maximisation(patterns, counts)
    assert np.abs(model["accuracy"] - accuracy).max() < 0.05 and abs(model["prior"] - 0.3) < 0.03
    post = np.array([model["bad"][c] for c in code.tolist()])
    assert ((post > 0.5) == bad).mean() > 0.95


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    got = {r.id: r for r in quality.classify(docs).collect()}
    assert len(got) == docs.count()
    good = [got[i].kept for i, q in labels.items() if q == 1]
    junk = [not got[i].kept for i, q in labels.items() if q == 0]
    assert np.mean(good) >= 0.99 and np.mean(junk) >= 0.95
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_quality_of_awkward_rows(spark):
    docs, texts = H.awkward_docs(spark, n=40)
    got = {r.id: r for r in quality.classify(docs).collect()}
    assert got.keys() == texts.keys()
    assert all(got[i].kept for i, t in texts.items() if not (t or "").strip())
    assert quality.classify(H.empty_docs(spark)).count() == 0


def test_licences(spark):
    lines = {
        "MIT": "Released under the MIT License.",
        "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
        "GPL": "This work is licensed under the GNU General Public License, version 3.",
        "CC-BY-NC": "Licensed under CC BY-NC 4.0.",
        "CC-BY-SA": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    }
    none = [None, "", "A license is needed to drive.", "plain words only", "The software was sold under the bridge.", "x " * 20_000]
    rows = [(i, f"some words\n{t}\nmore of it") for i, t in enumerate(lines.values())]
    rows += [(100 + i, t) for i, t in enumerate(none)]
    rows += [(200, "\n".join(lines.values()))]
    docs = spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id long, text string, paragraph long, words string")
    got = {r.id: r for r in licences.licences(docs).collect()}
    assert len(got) == len(rows)
    assert [got[i].families for i in range(len(lines))] == list(lines) and got[0].paragraphs == "1" and got[0].n_paragraphs == 3
    assert all(got[100 + i].n_licences == 0 and got[100 + i].families == "" for i in range(len(none)))
    assert got[200].families == ",".join(sorted(lines)) and got[200].n_licences == 5
    assert licences.licences(docs.limit(0)).count() == 0


MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
GPL_TEXT = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version."""


def test_wrapped_and_commented_licences(spark):
    """Notices over several lines, in comments, narrow, after a long line, and far down a text."""
    prose = "\n".join(f"plain prose number {i} about nothing at all" for i in range(3000))
    narrow = "\n".join(" ".join(MIT_TEXT.split()[i : i + 2]) for i in range(0, len(MIT_TEXT.split()), 2))
    rows = {
        0: (f"import os\n\n{MIT_TEXT}\n\nprint()", "MIT", "2"),
        1: ("\n".join(f"# {t}" for t in BSD_TEXT.split("\n")), "BSD", "0"),
        2: ("/*\n" + "\n".join(f" * {t}" for t in GPL_TEXT.split("\n")) + "\n */\nint x;", "GPL", "2"),  # its second line is confirmed by itself
        3: ("\n".join(f"dnl {t}" for t in MIT_TEXT.split("\n")), "MIT", "0"),
        4: (narrow, "MIT", "0"),
        5: (f"{prose}\n{BSD_TEXT}\n{prose}", "BSD", "3000"),
        6: ("word " * 200 + "\nReleased under the\nMIT License.\nmore", "MIT", "1"),
        7: (f"{prose}\nA license is needed\nto drive a car in this\nstate.", "", ""),
    }
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in rows.items()], "doc_id long, text string")
    got = {r.id: (r.families, r.paragraphs, r.n_licences) for r in licences.licences(docs).collect()}
    assert got == {i: (f, p, int(f != "")) for i, (_, f, p) in rows.items()}


def test_verdicts_of_repeated_ids_and_whole_words(spark):
    docs = H.with_repeated_ids(spark, H.awkward_docs(spark)[0])
    rows = quality.classify(docs).collect()
    assert len(rows) == docs.count()
    long = "b" * 200
    a, b = quality.features(long + "#" * 50), quality.features(long + "9" * 9)
    assert a.tolist() != b.tolist()
