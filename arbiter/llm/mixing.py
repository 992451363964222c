"""Mixing sources to target weights by Pfair scheduling. DataFrame functions only.

The mix is as large as the target weights allow: ``take`` rows of each source, so that the source
scarcest for its weight is used up and no other falls short. Each source's documents, in the order of
a seeded hash, are cut into blocks; b blocks of a source in a mix of N slots make its weight b / N.

Block j is released at slot floor(j * N / b) and due by slot ceil((j + 1) * N / b); in each slot the
released block with the earliest deadline runs, ties to the lower source. Windows of this kind always
have a schedule without an empty slot, so after every slot each source has had its share of the slots
served so far to within less than one block, over the whole mix.

The schedule is made frame by frame, all frames at once. What a frame needs to know is which blocks
released before it are still waiting. Every slot is used, so a slot's backlog (blocks released before it
that have not run) is known without a schedule: a sum over the sources. Of the blocks whose windows lie
across a frame's first slot, those that wait are the latest by deadline that leave, for every earlier
slot, no more waiting blocks released before that slot than the least backlog since then. Those least
backlogs are found inside frames, then carried from frame to frame by a running minimum.

Shares are those of whole blocks: a source's last block may be short of rows and still takes one slot.
Per frame the work is its slots times the sources; a row of work holds all sources, so their number is
meant to be tens of thousands at most.

``in_mix`` tells which documents the mix takes. Every row is returned; those it does not take follow
after the mix, in slots of their own, or, in the last block taken of a source, behind the rows taken.

Defined results: null is a source of its own; an empty source does not exist; equal ids are ordered
arbitrarily among themselves; texts are not read; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbiter.llm.common import staged, with_position

#: Documents of a block; least number of slots of a frame; seed of the order of a source's documents.
BLOCK, FRAME, SEED = 16, 1_024, 11
#: Boundaries in one window of the running minimum; tasks of the frames at most.
RUN, TASKS = 4_096, 4_096


def capped_weights(docs: DataFrame, cap: float, source_col: str = "source") -> DataFrame:
    """(source, rows, weight): shares of the rows, none above ``cap`` (1 / sources at least).

    Sources above it are set to it and the rest is spread over the others in proportion to their
    rows; the largest of those may then be above it in turn, so the level is solved for all of them.
    """
    n = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("rows"))
    n = staged(n, "source-rows")
    total, m = n.agg(F.sum("rows"), F.count(F.lit(1))).first()
    left, cap = total or 0, max(cap, 1.0 / max(1, m))
    # At most 1 / cap sources are capped. With the k largest capped the others make up 1 - k * cap.
    size, capped = float(left), []
    for r in n.orderBy(F.desc("rows")).limit(math.ceil(1 / cap)).collect():
        if r["rows"] <= cap * size * (1 + 1e-9) or len(capped) >= m - 1:
            break
        capped.append(r["rows"])
        left -= r["rows"]
        size = left / (1.0 - cap * len(capped))
    big = F.col("rows") >= F.lit(min(capped, default=None))
    return n.select("source", "rows", F.when(big, F.lit(cap)).otherwise(F.col("rows") / F.lit(size)).alias("weight"))


def in_blocks_of(weights: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slots, s): one row; ``s`` has i, source, rows, take, blocks and after of every source.

    ``take`` is the source's rows in the mix and ``blocks`` what they fill; ``after`` is the first slot
    of the blocks the mix does not take, which follow source by source.
    """
    w = weights.groupBy().agg(
        F.sort_array(F.collect_list(F.struct("source", "weight", "rows"))).alias("s"),
        F.min(F.col("rows") / F.col("weight")).alias("size"),
    ).where(F.size("s") > 0)
    # The thousandth of a row is for the last bits of weight * (rows / weight).
    w = w.withColumn("s", F.transform("s", lambda x: F.struct(
        x["source"].alias("source"), x["rows"].alias("rows"),
        F.least(x["rows"], F.floor(x["weight"] * F.col("size") + 0.001)).alias("take"))))
    w = w.withColumn("s", F.transform("s", lambda x, i: F.struct(
        i.alias("i"), x["source"].alias("source"), x["rows"].alias("rows"), x["take"].alias("take"),
        F.greatest(F.ceil(x["take"] / block), F.lit(1)).alias("blocks"))))
    w = w.withColumn("slots", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["blocks"]))
    left = lambda x: F.ceil(x["rows"] / block) - x["blocks"]
    after = F.aggregate("s", F.struct(F.col("slots").alias("at"), F.array().cast("array<long>").alias("all")), lambda a, x: F.struct(
        (a["at"] + left(x)).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")), lambda a: a["all"])
    w = w.withColumn("after", after)
    return w.select("slots", F.transform("s", lambda x, i: x.withField("after", F.col("after")[i])).alias("s"))


def _up(a: Column, b: Column) -> Column:
    """a / b rounded up, of whole numbers with b > 0 and a >= 0."""
    return F.call_function("div", a + b - 1, b)


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is named in ``use``."""
    return F.transform(F.array(value), use)[0]


def _at(s: Column, k: Column, frame: int, slots: Column) -> Column:
    """The sources at the first slot of frame k: c blocks wholly due before it and f / slots of the next."""
    wide = lambda x: x.cast("decimal(19,0)")
    share = lambda x: wide(x["blocks"]) * wide(k * frame)
    return F.transform(s, lambda x: F.struct(
        x["i"].alias("i"), x["blocks"].alias("b"),
        F.call_function("div", share(x), wide(slots)).cast("long").alias("c"), (share(x) % wide(slots)).cast("long").alias("f")))


def boundaries(plan: DataFrame, slots: int, frame: int) -> DataFrame:
    """(k, i, b, c, f, low): the sources at the first slot of every frame.

    ``low`` is the least backlog of the slots after the release of the block whose window lies across
    that first slot, the first slot itself left out (null: there is none).
    """
    n, count = F.lit(slots).cast("long"), -(-slots // frame)
    step = max(1, count // TASKS)
    first = F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"), F.lit(step).cast("long"))
    frames = plan.select("s", F.explode(first).alias("k0")).repartition(min(count, TASKS), "k0")
    last = F.least(F.col("k0") + step - 1, F.lit(count - 1))
    frames = frames.select("s", F.explode(F.sequence("k0", last)).alias("k")).where(F.col("k") < count - 1)

    now, following = _at(F.col("s"), F.col("k"), frame, n), _at(F.col("s"), F.col("k") + 1, frame, n)
    backlog = _once(now, lambda s: F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(frame - 1).cast("long")),
        lambda x: F.aggregate(s, -(F.col("k") * frame + x), lambda a, e: a + e["c"] + _up(e["f"] + e["b"] * x, n))))
    # Counted from the frame's first slot; below 0: released before this frame.
    released = lambda e: F.lit(frame) - _up(e["f"], e["b"])
    low = lambda e, v: F.when(released(e) < 0, F.array_min(v)).otherwise(
        F.array_min(F.slice(v, F.greatest(released(e) + 2, F.lit(1)).cast("int"), frame)))
    ends = _once(backlog, lambda v: F.transform(following, lambda e: e.withField("low", F.when(e["f"] > 0, low(e, v)))))
    zero = F.lit(0).cast("long")
    start = F.transform("s", lambda x: F.struct(
        x["i"].alias("i"), x["blocks"].alias("b"), zero.alias("c"), zero.alias("f"), F.lit(None).cast("long").alias("low")))
    rows = frames.select("k", F.explode(ends).alias("e")).select((F.col("k") + 1).alias("k"), "e")
    rows = rows.union(plan.select(zero, F.explode(start)))
    rows = staged(rows.select("k", "e.*", F.floor(F.col("k") / RUN).alias("run")), "boundaries")

    # The same block lies across one boundary after another: the running minimum, in two steps.
    block = ["i", "c"]
    runs = rows.groupBy(*block, "run").agg(F.min("low").alias("least"))
    earlier = Window.partitionBy(*block).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*block, "run", F.min("least").over(earlier).alias("before"))
    within = Window.partitionBy(*block, "run").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("low", F.min("low").over(within)).join(runs, [*block, "run"])
    return rows.select("k", "i", "b", "c", "f", F.least("low", "before").alias("low"))


def _waiting(s: Column, first: Column, slots: Column) -> Column:
    """The sources whose block across the frame's first slot still waits there."""
    total = F.aggregate(s, -first, lambda a, e: a + e["c"] + (e["f"] > 0).cast("long"))
    across = _once(total, lambda backlog: F.transform(F.filter(s, lambda e: e["f"] > 0), lambda e: F.struct(
        _up(slots - e["f"], e["b"]).alias("due"), e["i"].alias("i"), (-_up(e["f"], e["b"])).alias("released"),
        F.least(e["low"], backlog).alias("room"))))

    def step(state, e):
        fits = F.forall(state["room"], lambda q: (q["released"] < e["released"]) | (q["room"] > 0))
        return _once(fits, lambda ok: F.struct(
            F.transform(state["room"], lambda q: q.withField(
                "room", q["room"] - (ok & (q["released"] >= e["released"])).cast("long"))).alias("room"),
            F.when(ok, F.concat(state["waits"], F.array(e["i"]))).otherwise(state["waits"]).alias("waits")))

    start = lambda a: F.struct(a.alias("room"), F.array().cast("array<int>").alias("waits"))
    return _once(across, lambda a: F.aggregate(F.reverse(F.sort_array(a)), start(a), step, lambda state: state["waits"]))


def _earliest_deadline(s: Column, waiting: Column, size: Column, slots: Column) -> Column:
    """(i, block, release, due) of each slot of a frame, counted from its first slot."""

    def job(e, y):
        # Block c + y of the source; its release, below 0 where it was before the frame, is rounded down.
        return F.struct(
            _up((y + 1) * slots - e["f"], e["b"]).alias("due"), e["i"].alias("i"),
            F.call_function(
                "div", y * slots - e["f"] - F.when(y * slots < e["f"], e["b"] - 1).otherwise(F.lit(0)), e["b"]).alias("release"),
            y.alias("y"), e["b"].alias("b"), e["c"].alias("c"), e["f"].alias("f"))

    started = lambda e, w: ((e["f"] > 0) & ~F.array_contains(w, e["i"])).cast("long")
    start = _once(waiting, lambda w: F.struct(
        F.transform(s, lambda e: job(e, started(e, w))).alias("next"),
        F.array().cast("array<struct<i:int,block:bigint,release:bigint,due:bigint>>").alias("slots")))

    def step(state, t):
        pick = F.array_min(F.filter(state["next"], lambda e: e["release"] <= t))
        return _once(pick, lambda p: F.struct(
            F.transform(state["next"], lambda e: F.when(e["i"] == p["i"], job(e, e["y"] + 1)).otherwise(e)).alias("next"),
            F.concat(state["slots"], F.array(F.struct(
                p["i"].alias("i"), (p["c"] + p["y"]).alias("block"), p["release"].alias("release"), p["due"].alias("due")))).alias("slots")))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), size - 1), start, step, lambda state: state["slots"])


def schedule(plan: DataFrame, frame: int | None = None) -> DataFrame:
    """(i, block, slot, release, deadline): one row per slot of the mix, of a plan by `in_blocks_of`."""
    head = plan.select("slots", F.size("s").alias("n")).first()
    slots, n = (head["slots"], head["n"]) if head else (1, 1)
    frame = frame or 1 << math.ceil(math.log2(max(FRAME, 2 * n)))
    total, first = F.lit(slots).cast("long"), F.col("k") * frame
    rows = boundaries(plan, slots, frame)
    # A fixed number of tasks: a frame is a small row and much work.
    rows = rows.repartition(min(-(-slots // frame), TASKS), "k").groupBy("k").agg(
        F.sort_array(F.collect_list(F.struct("i", "b", "c", "f", "low"))).alias("s"))
    size = F.least(F.lit(frame).cast("long"), total - first)
    rows = rows.select("k", _earliest_deadline(F.col("s"), _waiting(F.col("s"), first, total), size, total).alias("slots"))
    rows = rows.select(first.alias("first"), F.posexplode("slots").alias("at", "x"))
    f = F.col("first")
    return rows.select("x.i", "x.block", (f + F.col("at")).alias("slot"), (f + F.col("x.release")).alias("release"), (f + F.col("x.due")).alias("deadline"))


def mix(
    docs: DataFrame, weights: DataFrame, id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK,
    frame: int | None = None,
) -> DataFrame:
    """One row per document: id, source, block, release, deadline, slot, position, in_mix.

    ``weights``: (source, rows, weight), e.g. of `capped_weights`. ``release`` and ``deadline`` are the
    window of the block; ``position`` orders the mix. ``frame``: slots scheduled in one go; the result
    is the same for any.
    """
    plan = staged(in_blocks_of(weights, block), "mix-plan")
    slots = staged(schedule(plan, frame), "schedule")
    rows = weights.agg(F.sum("rows")).first()[0] or 0
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"))
    d = d.withColumn("seed", F.xxhash64(F.lit(SEED), "id"))
    d = with_position(d, ["source"], ["seed", "id"], "n", rows).drop("seed")
    sources = staged(plan.select(F.explode("s").alias("x")).select("x.*"), "sources")
    # One row per source: where they are few, a hot source stays spread over all tasks.
    j = d.join(F.broadcast(sources) if _small(sources) else sources, d["source"].eqNullSafe(sources["source"]))
    j = j.select("id", d["source"].alias("source"), "n", "i", F.floor(F.col("n") / block).alias("block"), "take", "blocks", "after")
    j = j.join(slots, ["i", "block"], "left")
    # Blocks beyond those taken stand after the mix, each in a slot of its own.
    beyond = F.col("after") + F.col("block") - F.col("blocks")
    slot = F.coalesce("slot", beyond)
    return j.select(
        "id", "source", "block",
        F.coalesce("release", beyond).alias("release"), F.coalesce("deadline", beyond + 1).alias("deadline"),
        slot.alias("slot"), (slot * block + F.pmod(F.col("n"), F.lit(block))).alias("position"),
        (F.col("n") < F.col("take")).alias("in_mix"),
    )


def _small(sources: DataFrame, limit: int = 32 << 20) -> bool:
    """Whether the table of sources is small enough to send to every task, by the bytes of its names."""
    size = F.sum(F.coalesce(F.octet_length(F.col("source").cast("string")), F.lit(0)) + 64)
    return (sources.agg(size).first()[0] or 0) <= limit
