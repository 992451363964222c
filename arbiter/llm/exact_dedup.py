"""Exact deduplication: binary-fuse filters per immutable snapshot screen incoming digests.

* A snapshot is a written, never changed table of (digest, keep_id, n) plus one static
  binary-fuse filter per digest bucket (`build_snapshot`).
* An incoming batch is first grouped by itself (`group_batch`: new-batch duplicates, combined
  before the shuffle, so a text copied a billion times is one row from there on).
* Its distinct digests meet the filter of their bucket; negatives are new for certain. Positives
  join the exact entries on the whole digest, and the texts of both sides are compared byte by
  byte before a link counts (`match_snapshot`).

Defined results: null text counts as empty, all empty texts are one group; an empty table gives an
empty result; extra columns are ignored; repeated ids count as rows of their group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbiter.llm.common import staged

#: Digests a bucket (one filter, one task) holds on average.
BUCKET_KEYS = 250_000
#: Only runs that differ from one plain space need rewriting; the result equals replacing every run.
_RUNS = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"


def normalised(text):
    """Text with each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _RUNS, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest")
    )


def group_batch(d: DataFrame) -> DataFrame:
    """One row per digest of a batch: the least id and the number of rows."""
    return d.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))


def _key64(digest):
    return F.conv(F.substring(F.hex(digest), 1, 15), 16, 10).cast("long")


def _bucketed(groups: DataFrame, buckets: int) -> DataFrame:
    # The bucket comes from the tail of the digest, the filter key from its head.
    tail = F.conv(F.substring(F.hex("digest"), 57, 8), 16, 10).cast("long")
    return groups.withColumn("key", _key64(F.col("digest"))).withColumn("bucket", (tail % buckets).cast("int"))


# ---- static binary-fuse filter (three segments, 16-bit fingerprints) -------------------------

_U = np.uint64


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        z = x + _U(seed)
        z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
        return z ^ (z >> _U(31))


def _slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """The three neighbouring-segment slots of each hash, one column per segment."""
    first = ((h >> _U(32)) * _U(segments) >> _U(32)).astype(np.int64)
    mask = segment - 1
    offs = [(h >> _U(s)).astype(np.int64) & mask for s in (0, 10, 20)]
    return np.stack([(first + j) * segment + offs[j] for j in range(3)], axis=1)


def _fingerprint(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> _U(37))).astype(np.uint16)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, starting segments, fingerprints) over distinct 64-bit keys.

    Slots touched by one remaining key are peeled in rounds; filled in reverse order each key's
    three slots xor to its fingerprint. A seed that leaves a core is replaced by the next one.
    """
    n = len(keys)
    segment = 1 << max(2, min(18, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    for attempt in range(200):
        # Small sets and unlucky seeds get more room.
        size = int(n * factor * (1 + 0.05 * (attempt // 4))) + 32
        segments = max(1, -(-size // segment) - 2)
        seed = (0x9E3779B97F4A7C15 * (attempt + 1)) % (1 << 63)
        h = _mix(keys, seed)
        s = _slots(h, segment, segments)
        table = np.zeros((segments + 2) * segment, np.uint16)
        count = np.bincount(s.ravel(), minlength=len(table))
        owner = np.zeros(len(table), np.int64)
        index = np.arange(n, dtype=np.int64)
        for j in range(3):
            np.bitwise_xor.at(owner, s[:, j], index)
        rounds, ready, left = [], np.flatnonzero(count == 1), n
        while len(ready):
            key, at = np.unique(owner[ready], return_index=True)
            slot = ready[at]
            rounds.append((key, slot))
            left -= len(key)
            touched = s[key].ravel()
            np.subtract.at(count, touched, 1)
            np.bitwise_xor.at(owner, touched, np.repeat(key, 3))
            touched = np.unique(touched)
            ready = touched[count[touched] == 1]
        if left == 0:
            fp = _fingerprint(h)
            for key, slot in reversed(rounds):
                others = table[s[key, 0]] ^ table[s[key, 1]] ^ table[s[key, 2]]
                table[slot] = fp[key] ^ others
            return seed, segment, segments, table.tobytes()
    raise ValueError("keys are not distinct")


def may_contain(keys: np.ndarray, seed: int, segment: int, segments: int, table: bytes) -> np.ndarray:
    t = np.frombuffer(table, np.uint16)
    h = _mix(keys, seed)
    s = _slots(h, segment, segments)
    return (t[s[:, 0]] ^ t[s[:, 1]] ^ t[s[:, 2]]) == _fingerprint(h)


def _build_group(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = np.unique(pdf["key"].to_numpy().astype(np.uint64))
    seed, segment, segments, table = build_filter(keys)
    return pd.DataFrame(
        {"bucket": [int(pdf["bucket"].iat[0])], "seed": [seed], "segment": [segment], "segments": [segments], "table": [table]}
    )


def build_snapshot(groups: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Write a snapshot: its exact entries and one filter per bucket; neither changes later."""
    entries = staged(_bucketed(groups, buckets), "snapshot")
    filters = (
        entries.select("bucket", "key")
        .groupBy("bucket")
        .applyInPandas(_build_group, "bucket int, seed long, segment int, segments int, table binary")
    )
    return entries, staged(filters, "filters")


def _screen_group(new: pd.DataFrame, filt: pd.DataFrame) -> pd.DataFrame:
    out = new[["digest", "keep_id"]]
    if not len(new) or not len(filt):
        return out.iloc[:0]
    f = filt.iloc[0]
    keys = new["key"].to_numpy().astype(np.uint64)
    return out[may_contain(keys, int(f["seed"]), int(f["segment"]), int(f["segments"]), f["table"])]


def screen(batch: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The digests of a grouped batch that a snapshot's filter does not rule out."""
    new = _bucketed(batch, buckets).select("bucket", "key", "digest", "keep_id")
    return new.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(
        _screen_group, "digest binary, keep_id long"
    )


def match_snapshot(
    batch: DataFrame, entries: DataFrame, filters: DataFrame, buckets: int,
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(digest, old_id) of batch digests whose bytes equal those of a snapshot entry.

    ``docs`` holds the texts of both sides; only those of the positives are read.
    """
    positives = staged(
        screen(batch, filters, buckets)
        .join(entries.select("digest", F.col("keep_id").alias("old_id")), "digest")
        .select("digest", F.col("keep_id").alias("new_id"), "old_id"),
        "positives",
    )
    wanted = staged(positives.select(F.explode(F.array("new_id", "old_id")).alias("id")).distinct(), "wanted")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).join(wanted, "id", "left_semi")
    # An id that stands on several rows may carry several texts: the digest picks the right one.
    texts = texts.select("id", normalised(F.col("t")).alias("t")).withColumn("digest", F.unhex(F.sha2("t", 256)))
    texts = staged(texts.dropDuplicates(["id", "digest"]), "texts")
    old = texts.select(F.col("id").alias("old_id"), "digest", F.col("t").alias("old_t"))
    new = texts.select(F.col("id").alias("new_id"), "digest", F.col("t").alias("new_t"))
    return (
        positives.join(old, ["old_id", "digest"]).join(new, ["new_id", "digest"])
        .where(F.col("old_t") == F.col("new_t")).select("digest", "old_id")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deduplicate a table as a snapshot (the lower half of the id range) and an incoming batch.

    Returns one row per document: id, keep_id, group_size, kept, text_sha256.
    """
    d = staged(digests(docs, id_col, text_col), "digests")
    lo, hi, rows = d.agg(F.min("id"), F.max("id"), F.count(F.lit(1))).first()
    middle = 0 if lo is None else (lo + hi) // 2
    buckets = max(1, -(-rows // (2 * BUCKET_KEYS)))
    snapshot = group_batch(d.where(F.col("id").isNull() | (F.col("id") <= middle)))
    batch = staged(group_batch(d.where(F.col("id") > middle)), "batch")
    entries, filters = build_snapshot(snapshot, buckets)
    known = match_snapshot(batch, entries, filters, buckets, docs, id_col, text_col)
    groups = (
        entries.select("digest", "keep_id", "n")
        .union(batch.join(known, "digest", "left").select("digest", F.coalesce("old_id", "keep_id"), "n"))
        .groupBy("digest", "keep_id")
        .agg(F.sum("n").alias("group_size"))
    )
    # A text that stands alone needs no lookup: only repeated digests are joined back.
    repeated = staged(groups.where("group_size > 1"), "repeated")
    keep = F.coalesce("keep_id", "id")
    return d.join(repeated, "digest", "left").select(
        F.col("id"),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (keep == F.col("id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
