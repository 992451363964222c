"""Balanced label propagation: linked documents move to their neighbours' shard. DataFrame only.

Documents start in even random shards. In each round a linked document proposes the shard that
could hold most of its group (what it holds of it and has room for); proposals a -> b are granted against proposals b -> a one for one, and
beyond those up to the room that unlinked documents leave in b. Unlinked documents fill the shards
last, so row counts end at most one apart whatever moved.

Links are given by group: members of one group are linked to one another, which takes one row per
member and no pair. A group larger than a shard is cut into parts of a shard's size first (it has
to be split somewhere); its members are counted per (part, shard) with a combining aggregate.

Defined results: null text has size 16, checksum 0 and groups with empty texts; rows that share an id
are documents of their own; fewer documents than shards leave shards empty; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbiter.llm.common import by_row, staged, with_position

SHARDS, ROUNDS, OVERHEAD = 40, 12, 16
SEED = 20240229


def _shard_of(position, rows: int, shards: int):
    """Even shards of positions 0 .. rows - 1: counts at most one apart."""
    small, more = divmod(rows, shards)
    edge = more * (small + 1)
    return F.when(
        F.col(position) < edge, F.floor(F.col(position) / F.lit(small + 1))
    ).otherwise(F.lit(more) + F.floor((F.col(position) - edge) / F.lit(max(1, small)))).cast("int")


def _capacity(rows: int, shards: int):
    small, more = divmod(rows, shards)
    return F.lit(small) + (F.col("shard") < more).cast("long")


def _propagate(linked: DataFrame, rows: int, n_linked: int, shards: int, turn: int) -> DataFrame:
    """One round: (id, part, size columns..., shard) of linked documents after granted moves."""
    held = linked.groupBy("group", "part", "shard").agg(F.count(F.lit(1)).alias("n"), F.min("group_rows").alias("m"))
    load = linked.groupBy("shard").agg(F.count(F.lit(1)).alias("load"))
    every = linked.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    room = staged(every.join(load, "shard", "left").select(
        "shard", (_capacity(rows, shards) - F.coalesce("load", F.lit(0))).alias("room")
    ), "room")
    # The shard that could hold most of the part: what it holds and has room for.
    held = held.join(F.broadcast(room), "shard")  # one row a shard
    fits = F.least(F.col("n") + F.greatest("room", F.lit(0)), F.least("m", F.lit(max(1, rows // shards))))
    held = held.withColumn("fits", fits)
    # Ties go by a hash of part, shard and round: equal groups do not all run to one shard, and members
    # that were refused ask for another of their group's shards in the next round.
    best = held.groupBy("group", "part").agg(
        F.max(F.struct("fits", "n", F.xxhash64("group", "part", "shard", F.lit(turn)).alias("h"), "shard")).alias("b")
    ).select("group", "part", F.col("b.shard").alias("to"))
    asked = linked.join(best, ["group", "part"])
    movers = staged(asked.where("to <> shard").select("id", "group", "part", F.col("shard").alias("from"), "to"), "movers")
    wanted = movers.groupBy("from", "to").agg(F.count(F.lit(1)).alias("m"))  # at most shards^2 rows
    back = wanted.select(F.col("from").alias("to"), F.col("to").alias("from"), F.col("m").alias("r"))
    w = wanted.join(back, ["from", "to"], "left").join(room.withColumnRenamed("shard", "to"), "to")
    w = w.withColumn("swap", F.least("m", F.coalesce("r", F.lit(0)))).withColumn("rest", F.col("m") - F.col("swap"))
    before = Window.partitionBy("to").orderBy("from").rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("before", F.coalesce(F.sum("rest").over(before), F.lit(0)))
    extra = F.greatest(F.lit(0), F.least("rest", F.col("room") - F.col("before")))
    quota = staged(w.select("from", "to", (F.col("swap") + extra).alias("quota")), "quotas")
    ranked = with_position(movers, ["from", "to"], ["group", "part", "id"], "place", n_linked)
    granted = ranked.join(F.broadcast(quota), ["from", "to"]).where("place < quota").select("id", "group", "part", "to")  # at most shards^2 rows
    moved = linked.join(granted, ["id", "group", "part"], "left")
    return staged(moved.withColumn("shard", F.coalesce("to", "shard")).select(linked.columns), "linked")


def shard(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, rounds: int = ROUNDS
) -> DataFrame:
    """One row per document: id, size, text_crc32, shard, slot, group_rows; row counts even.

    Rows that share an id are documents of their own.
    """
    docs = docs.select(id_col, text_col)
    return by_row(docs, id_col, text_col, lambda d: _shard(d, id_col, text_col, shards, rounds))


def _shard(docs: DataFrame, id_col: str, text_col: str, shards: int, rounds: int) -> DataFrame:
    """`shard` of distinct ids."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text, 256).alias("group"),
        F.xxhash64(F.lit(SEED), F.col(id_col).cast("long")).alias("mixed"),  # the seeded order of the start
    )
    d = staged(d, "sizes")
    rows = d.count()
    capacity = max(1, rows // shards)
    groups = staged(
        d.groupBy("group").agg(F.count(F.lit(1)).alias("group_rows")).where("group_rows > 1"), "groups"
    )
    start = with_position(d, [], ["mixed", "id"], "p", rows)
    start = start.withColumn("shard", _shard_of("p", rows, shards)).drop("p")
    start = staged(start.join(groups, "group", "left"), "start")
    single = start.where("group_rows IS NULL").withColumn("group_rows", F.lit(1).cast("long"))
    linked = start.where("group_rows IS NOT NULL")
    n_linked = linked.count()
    # A group above a shard's size is cut in parts; all other groups are one part.
    large = linked.where(F.col("group_rows") > capacity)
    large = with_position(large, ["group"], ["id", "size"], "p", rows).withColumn("part", F.floor(F.col("p") / capacity)).drop("p")
    linked = linked.where(F.col("group_rows") <= capacity).withColumn("part", F.lit(0).cast("long")).unionByName(large)
    linked = staged(linked, "linked")
    for turn in range(rounds):
        after = _propagate(linked, rows, n_linked, shards, turn)
        still = linked.agg(F.sum(F.xxhash64("id", "shard").cast("decimal(38,0)"))).first()
        linked, same = after, still == after.agg(F.sum(F.xxhash64("id", "shard").cast("decimal(38,0)"))).first()
        if same:  # nothing was granted
            break

    # What room is left in the shards, in shard order, is dealt to the unlinked documents by position.
    every = docs.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    load = linked.groupBy("shard").agg(F.count(F.lit(1)).alias("load"))
    free = every.join(load, "shard", "left").withColumn("free", _capacity(rows, shards) - F.coalesce("load", F.lit(0)))
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)  # one row a shard
    free = free.select("shard", F.sum("free").over(upto).alias("end"))
    ends = [r["end"] for r in free.sort("shard").collect()]  # one number a shard
    place = with_position(single.drop("shard"), [], ["mixed", "id"], "p", rows)
    place = place.withColumn("shard", F.size(F.filter(F.array(*[F.lit(int(e)) for e in ends]), lambda e: e <= F.col("p"))).cast("int")).drop("p")
    out = staged(linked.drop("part").unionByName(place), "placed")
    return with_position(out, ["shard"], ["mixed", "id"], "slot", rows).drop("group", "mixed")
