"""Mixing, sharding, and the pipeline as a whole."""

from __future__ import annotations

import collections
import random
import zlib

import corpus_pipeline
from pyspark.sql import functions as F

from arbiter.llm import minhash, mixing, quality, sharding
from arbiter.llm.common import staged
from tests.conftest import SF001
from tests.llm import helpers as H


def _edf(blocks: list[int]) -> list[int]:
    """The source of every slot of a mix, scheduled slot after slot."""
    total, done, out = sum(blocks), [0] * len(blocks), []
    for t in range(total):
        ready = [
            (-(-(done[s] + 1) * total // b), s) for s, b in enumerate(blocks) if done[s] < b and done[s] * total // b <= t
        ]
        due, s = min(ready)
        assert due > t
        done[s] += 1
        out.append(s)
    return out


def _mix(spark, docs, cap=0.25, block=4):
    return mixing.mix(docs, mixing.capped_weights(docs, cap), block=block).collect()


def test_schedule_equals_a_sequential_scheduler(spark):
    """Frames scheduled apart give the schedule of one run over all slots, whatever their size."""
    rnd = random.Random(5)
    for frame in (1, 2, 7, 40, None):
        for _ in range(1 if frame == 1 else 3):
            blocks = [rnd.choice([1, 1, 2, rnd.randint(1, 9), rnd.randint(1, 40)]) for _ in range(rnd.randint(1, 9))]
            total = sum(blocks)
            names = [None] + [f"s{i}" for i in range(1, len(blocks))]
            weights = spark.createDataFrame([(s, 4 * b, b / total) for s, b in zip(names, blocks)], "source string, rows long, weight double")
            got = sorted(mixing.schedule(mixing.in_blocks_of(weights, 4), frame).collect(), key=lambda r: r.slot)
            assert [r.slot for r in got] == list(range(total))
            assert [r.i for r in got] == _edf(blocks)
            assert all(r.release == r.block * total // blocks[r.i] for r in got)
            assert all(r.deadline == -(-(r.block + 1) * total // blocks[r.i]) for r in got)


def test_runs_of_boundaries(spark, monkeypatch):
    """Blocks that lie across many boundaries: the running minimum goes from window to window."""
    monkeypatch.setattr(mixing, "RUN", 3)
    blocks = [30, 17, 1, 1, 2, 5, 1]
    weights = spark.createDataFrame([(f"s{i}", b, b / 57) for i, b in enumerate(blocks)], "source string, rows long, weight double")
    got = mixing.schedule(mixing.in_blocks_of(weights, 1), 2).orderBy("slot").collect()
    assert [r.i for r in got] == _edf(blocks)


def test_large_numbers_of_slots(spark):
    """Sums and products of the shares stay exact beyond 64 bits."""
    blocks = [3_000_000_007, 2_000_000_011, 999_999_937]
    total, k = sum(blocks), 5_859_374
    s = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(b).cast("long").alias("blocks")) for i, b in enumerate(blocks)])
    got = spark.range(k, k + 1).select(mixing._at(s, F.col("id"), 1024, F.lit(total).cast("long")).alias("s")).first().s
    assert [(e.c, e.f) for e in got] == [divmod(b * k * 1024, total) for b in blocks]


def test_mix_keeps_every_block_in_its_window(spark):
    docs, texts = H.awkward_docs(spark, n=400)
    rows = _mix(spark, docs)
    assert {r.id for r in rows} == texts.keys() and len({r.position for r in rows}) == len(rows)
    blocks = {(r.source, r.block): r for r in rows}
    assert len({r.slot for r in blocks.values()}) == len(blocks)
    assert all(r.release <= r.slot < r.deadline for r in blocks.values())
    # Below the horizon every source has its share of the slots to within less than one block.
    horizon = max(r.slot for r in rows if r.in_mix) + 1
    share = {s: max((r.block + 1) / r.deadline for r in rows if r.source == s) for s, _ in blocks}
    for s in share:
        b = [r for r in blocks.values() if r.source == s]
        for t in range(1, horizon + 1):
            served = sum(r.slot < t for r in b)
            assert sum(r.deadline <= t for r in b) <= served <= sum(r.release < t for r in b)


def _sized(spark, sizes: dict):
    rows = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame(rows, "doc_id long, source string")


def test_small_sources_do_not_end_the_mix(spark):
    """A tiny and a null source leave all the others at their exact weights."""
    sizes = {f"s{k:02d}": 700 for k in range(19)} | {"hot": 6650, "tiny": 5, None: 37}
    rows = _mix(spark, _sized(spark, sizes))
    kept = collections.Counter(r.source for r in rows if r.in_mix)
    rest = sum(n for s, n in sizes.items() if s != "hot")
    assert kept == {s: n for s, n in sizes.items() if s != "hot"} | {"hot": rest // 3}
    even = {f"s{k:02d}": 700 for k in range(20)} | {None: 100}
    assert all(r.in_mix for r in _mix(spark, _sized(spark, even)))
    # No slot is empty or given twice, and shares hold in the order served, not just at the end.
    blocks = {(r.source, r.block): r.slot for r in rows if r.in_mix}
    end = len(blocks)
    assert sorted(blocks.values()) == list(range(end))
    for s, n in collections.Counter(s for s, _ in blocks).items():
        at = sorted(t for (x, _), t in blocks.items() if x == s)
        assert all(abs(i - t * n / end) < 1 and abs(i + 1 - (t + 1) * n / end) < 1 for i, t in enumerate(at))
    # A source above its weight gives rows by hash, not its lowest ids.
    hot = [r for r in rows if r.source == "hot"]
    taken = sorted(r.id for r in hot if r.in_mix)
    assert len(taken) == rest // 3 and taken[-1] > max(r.id for r in hot) - 50


def test_no_source_is_above_the_cap(spark):
    """Sources raised by the capping of others are capped in turn."""
    for sizes in ([450, 230, 120, 120, 80], [500, 240, 240, 20], [300, 300, 200, 100, 60, 40], [900, 30, 30, 20, 20], [70, 30]):
        docs = _sized(spark, {f"s{k}": n for k, n in enumerate(sizes)})
        weights = {r.source: r.weight for r in mixing.capped_weights(docs, 0.25).collect()}
        cap = max(0.25, 1 / len(sizes))
        assert abs(sum(weights.values()) - 1) < 1e-9 and max(weights.values()) < cap + 1e-9
        kept = collections.Counter(r.source for r in _mix(spark, docs) if r.in_mix)
        # A row may be missing from a capped source's share, never one too many in it.
        assert max(kept.values()) <= cap * sum(kept.values()) + 1
        assert all(kept[s] == n for s, n in zip(sorted(weights), sizes) if weights[s] < cap - 1e-9)


def test_mix_of_edge_tables(spark):
    assert _mix(spark, H.empty_docs(spark)) == []
    one = spark.createDataFrame([(1, "x", None), (1, "x", None)], "doc_id long, text string, source string")
    assert [r.in_mix for r in _mix(spark, one)] == [True, True]


def test_shards_are_even_and_keep_groups(spark):
    docs, texts = H.awkward_docs(spark, n=300)
    rows = sharding.shard(docs, shards=7).collect()
    assert sorted(r.id for r in rows) == sorted(texts)
    per = H.group_by_value((r.slot, r.shard) for r in rows)
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1 and len(per) == 7
    assert all(sorted(s) == list(range(len(s))) for s in per.values())
    for r in rows:
        raw = (texts[r.id] or "").encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)
    split = sum(len({r.shard for r in rows if (texts[r.id] or "") == t}) > 1 for t in {t or "" for t in texts.values()})
    assert split == 0


def test_shards_of_pairs_only(spark):
    """Members far apart in id; with production settings nearly all pairs come together."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 2000).alias("text"))
    rows = sharding.shard(docs, shards=8).collect()
    assert set(collections.Counter(r.shard for r in rows).values()) == {500}
    shards = collections.defaultdict(set)
    for r in rows:
        shards[r.id % 2000].add(r.shard)
    # A swap takes two pairs that lie across the same two shards: at most one of each two shards is left.
    assert sum(len(s) > 1 for s in shards.values()) <= 8 * 7 // 2


def test_shards_of_repeated_rows(spark):
    docs = H.with_repeated_ids(spark, H.awkward_docs(spark, n=300)[0])
    rows = sharding.shard(docs, shards=7).collect()
    want = collections.Counter((r.doc_id, len((r.text or "").encode()) + 16) for r in docs.collect())
    assert collections.Counter((r.id, r.size) for r in rows) == want
    per = collections.Counter(r.shard for r in rows)
    assert max(per.values()) - min(per.values()) <= 1
    slots = H.group_by_value((r.slot, r.shard) for r in rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_with_a_group_larger_than_a_shard(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    rows = sharding.shard(docs, shards=10).collect()
    assert set(collections.Counter(r.shard for r in rows).values()) == {40}
    assert len({r.shard for r in rows if r.id % 3 == 0}) == 4  # 134 copies, 40 a shard
    assert sharding.shard(H.empty_docs(spark)).count() == 0
    few = sharding.shard(docs.limit(3), shards=10).collect()
    assert sorted(r.slot for r in few) == [0, 0, 0] and len({r.shard for r in few}) == 3


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, SF001), "test-stage")
        before, after = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id for r in out.collect()}
        assert after <= before.keys()
        if name == "quality classifier":
            assert after == {r.id for r in quality.classify(docs).where("kept").collect()}
        elif name == "exact dedup":
            groups = H.group_by_value((i, " ".join(t.split(" "))) for i, t in before.items())
            folded = H.group_by_value((i, quality.re.sub(r"[\x20\x09-\x0D]+", " ", t)) for i, t in before.items())
            assert after == {min(g) for g in folded.values()} and len(folded) <= len(groups)
        elif name == "MinHash near-dedup":
            want = H.near_groups(before, corpus_pipeline.SHINGLE, corpus_pipeline.SIMILAR)
            assert after == {i for i, (_, c) in want.items() if c == i}
        elif name == "mixing sources to target weights":
            m = mixing.mix(docs, mixing.capped_weights(docs, corpus_pipeline.SOURCE_CAP)).collect()
            assert after == {r.id for r in m if r.in_mix}
        else:
            assert after == before.keys() and out.columns[:2] == ["doc_id", "n_tokens"]
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        docs = out
        seen.append(name)
    assert len(seen) == 5
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF001).collect()} == {tuple(r) for r in docs.collect()}


def test_pipeline_keeps_one_row_of_each_text(spark):
    """Repeated ids: equal rows lose all but one, a text's only copy stays."""
    rows = [(1, "x"), (5, "only copy of this text"), (5, "x"), (7, "same"), (7, "same"), (None, "x"), (None, "alone")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string").repartition(4)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.exact_copies(spark, docs, "").collect()), key=str)
    assert got == [(1, "x"), (5, "only copy of this text"), (7, "same"), (None, "alone")]
    docs = H.with_repeated_ids(spark, H.awkward_docs(spark)[0])
    exact = staged(corpus_pipeline.exact_copies(spark, docs, ""), "test-stage")
    fold = lambda t: quality.re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    texts = [fold(r.text) for r in exact.collect()]
    assert sorted(texts) == sorted({fold(r.text) for r in docs.collect()})
    near = corpus_pipeline.near_copies(spark, exact, "").collect()
    groups = H.near_groups(dict(enumerate(texts)), corpus_pipeline.SHINGLE, corpus_pipeline.SIMILAR)
    assert len(near) == len({c for _, c in groups.values()})


def test_pipeline_of_awkward_rows(spark):
    docs, texts = H.awkward_docs(spark, n=60)
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, ""), "test-stage")
    assert 0 < docs.count() <= len(texts)
    empty = H.empty_docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        empty = staged(stage(spark, empty, ""), "test-stage")
    assert empty.count() == 0 and minhash.K == 32
