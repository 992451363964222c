"""Exact-count seeded selection without sorting the table, and the split composer (G4) on it.

Rows get a 60-bit hash of (seed, family, key). To take the first n rows in hash order, the table is
counted by the hash's leading bits; the cut lies in one of these buckets, whose rows are counted by the
next bits, until the bucket is small enough to be sorted by itself. The (hash, key) found there is a
threshold: a row is taken or not by a comparison. Each level reads the key column once; no level
shuffles more than one count per bucket and task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbiter.operators.ordinal import ordinal_within

BITS, LEVEL = 60, 15
#: Rows of a bucket that may be sorted by themselves.
SMALL = 4_096


def seeded_hash(seed: int, family: str, key: Column) -> Column:
    """The first 60 bits of md5("seed:family:key") as a long."""
    text = F.md5(F.concat(F.lit(f"{seed}:{family}:"), key.cast("string")))
    return F.conv(F.substring(text, 1, BITS // 4), 16, 10).cast("long")


def cut_points(rows: DataFrame, counts: list[int], small: int = SMALL) -> list[tuple[int, int] | None]:
    """For each count c the (h, key) of the c-th row (from 1) of ``rows`` (h, key) in order, None for 0.

    A row is among the first c exactly when (h, key) is not greater, keys being distinct; a key that
    stands several times stays whole. A count above the table's is an error.
    """
    found: list[tuple[int, int] | None] = [None] * len(counts)
    # Open cuts: (position in counts, hash prefix so far, rows to go inside that prefix).
    open_ = [(i, 0, c) for i, c in enumerate(counts) if c > 0]
    shift = BITS
    while open_:
        ready: list[tuple[int, int, int]] = []
        shift -= LEVEL
        at = rows
        if shift < BITS - LEVEL:
            at = rows.where(F.shiftright("h", shift + LEVEL).isin(sorted({p for _, p, _ in open_})))
        # At most 2^LEVEL counts for each of the few open prefixes.
        sizes = dict(at.groupBy(F.shiftright("h", shift).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())
        deeper = []
        for i, prefix, c in open_:
            for b in sorted(b for b in sizes if shift + LEVEL >= BITS or b >> LEVEL == prefix):
                if c <= sizes[b]:
                    (ready if sizes[b] <= small or shift == 0 else deeper).append((i, b, c))
                    break
                c -= sizes[b]
            else:
                raise ValueError(f"{counts[i]} rows wanted, the table has fewer")
        for i, b, c in ready:
            if sizes[b] <= small:
                inside = rows.where(F.shiftright("h", shift) == b).select("h", "key").sort("h", "key").collect()
                found[i] = tuple(inside[c - 1])
            else:  # equal hashes throughout: one key many times
                found[i] = tuple(rows.where(F.col("h") == b).agg(F.min("h"), F.max("key")).first())
        open_ = deeper
    return found


def upto(cut: tuple[int, int] | None) -> Column:
    """Whether a row (h, key) is among those up to a cut."""
    if cut is None:
        return F.lit(False)
    return (F.col("h") < cut[0]) | ((F.col("h") == cut[0]) & (F.col("key") <= cut[1]))


def family_counts(n: int, share: float = 0.58) -> tuple[int, int]:
    """(first, second) family's rows of a split of n: share of n rounded half to even, and the rest."""
    first = round(n * share)
    return first, n - first


def id_bases(sizes: dict[str, int], step: int = 1000) -> dict[str, int]:
    """First id of each split: multiples of ``step``, or of the next power of ten that holds a split."""
    while step < max(sizes.values(), default=0):
        step *= 10
    return {s: (i + 1) * step for i, s in enumerate(sizes)}


def build_splits(
    first: tuple[str, DataFrame], second: tuple[str, DataFrame], sizes: dict[str, int],
    share: float = 0.58, seed: int = 7, small: int = SMALL,
) -> DataFrame:
    """Splits of exactly the given sizes from two record families, shuffled.

    Each family's rows are taken in seeded order, split by split, so no record is in two splits. Returns
    split, family, id (the split's base + the record's number within split and family), shuffle_pos
    (seeded position within the split) and the record's columns. ``rec_id`` must be distinct in a family.
    """
    bases, chosen = id_bases(sizes), []
    for k, (name, df) in enumerate((first, second)):
        rows = df.select(F.col("rec_id").cast("long").alias("key"))
        rows = rows.withColumn("h", seeded_hash(seed, name, F.col("key")))
        ends, total = [], 0
        for n in sizes.values():
            total += family_counts(n, share)[k]
            ends.append(total)
        cuts = cut_points(rows, ends, small)
        split = reduce(lambda out, s: F.when(upto(s[1]), F.lit(s[0])).otherwise(out), reversed([*zip(sizes, cuts)]), F.lit(None))
        chosen.append(rows.withColumns({"family": F.lit(name), "split": split}).where("split IS NOT NULL"))
    every = chosen[0].unionByName(chosen[1])
    numbered = ordinal_within(every, ["split", "family"], ["h", "key"], out="no")
    again = F.md5(F.concat(F.lit(f"{seed}:shuffle:"), "family", F.lit(":"), F.col("key").cast("string")))
    placed = ordinal_within(numbered.withColumn("s", again), ["split"], ["s", "family", "key"], out="shuffle_pos")
    base = reduce(lambda out, s: F.when(F.col("split") == s, F.lit(bases[s])).otherwise(out), sizes, F.lit(0))
    placed = placed.select("split", "family", (base + F.col("no")).alias("id"), "shuffle_pos", F.col("key").alias("rec_id"))
    columns = ["rec_id", "state", "question", "options", "answer"]
    records = first[1].select(F.lit(first[0]).alias("family"), *columns).unionByName(
        second[1].select(F.lit(second[0]).alias("family"), *columns)
    )
    return placed.join(records, ["family", "rec_id"])
