"""Shared helpers: staging tables in the shared folder, distributed positions, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbiter.session import ensure_checkpoint_dir


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir`` of the session)."""
    return ensure_checkpoint_dir(spark).rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage (a lost executor re-reads a file, it does not recompute the past) and
    gives later plans a measured size, so a join broadcasts only what is known to be small.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete a staged table after its last reader has been written itself."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/llm-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


_TABLES: list[dict] = []


def sole(*tables: dict) -> None:
    """Keep only these lookup tables of a Python worker; those of other operators are emptied.

    A worker serves one operator after another, and each remembers words or pieces. Called where a
    partition starts, so a worker never holds the tables of two operators.
    """
    gone = [t for t in _TABLES if t and not any(t is mine for mine in tables)]
    for t in gone:
        t.clear()
    _TABLES[:] = tables
    _give_back()


def _give_back() -> None:
    """Return freed memory of this Python worker to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a partition's batches, whose memory goes back to the system at its end."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        _give_back()

    return whole


def read_documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def unique_ids(df: DataFrame, id_col: str) -> bool:
    """Whether the ids are distinct and none is null; shuffles ids only."""
    counts = df.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where("n > 1 OR id IS NULL").isEmpty()


def row_keyed(df: DataFrame, id_col: str, content: str) -> tuple[DataFrame, str]:
    """(``df`` with a distinct long for every row, that column's name); keys follow the ids, null last.

    Distinct ids are their own keys: the table stays as it is and the name is ``id_col``. Otherwise the
    rows are sorted by (id, content) in ranges and written once, with keys that grow along the ranges;
    equal rows get their keys in any order.
    """
    if unique_ids(df, id_col):
        return df, id_col
    key = "_row"
    while key in df.columns:
        key += "_"
    order = [F.col(id_col).asc_nulls_last(), F.xxhash64(F.col(content))]
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return staged(ranged.withColumn(key, F.monotonically_increasing_id()), "row-keyed"), key


def by_row(
    df: DataFrame, id_col: str, content: str, operator: Callable[[DataFrame], DataFrame], *id_columns: str
) -> DataFrame:
    """Run an operator that needs distinct ids in ``id_col`` on any table.

    ``operator(rows)`` returns ``id`` and perhaps ``id_columns``, which hold other rows' ids. Where ids
    repeat it works on row keys, which come back as the rows' ids; ``kept``, where there, then says again
    whether the first of ``id_columns`` is the row's own id.
    """
    keyed, key = row_keyed(df, id_col, content)
    if key == id_col:
        return operator(df)
    out = operator(keyed.drop(id_col).withColumnRenamed(key, id_col))
    columns = out.columns
    ids = keyed.select(F.col(key).alias("_key"), F.col(id_col).cast("long").alias("_id"))
    for c in ("id", *id_columns):
        out = out.join(ids.withColumnRenamed("_key", c), c, "left").drop(c).withColumnRenamed("_id", c)
    if "kept" in columns and id_columns:
        out = out.withColumn("kept", F.col("id").eqNullSafe(F.col(id_columns[0])))
    return out.select(columns)


def with_position(
    df: DataFrame, group: list[str], order: list[str], out: str, rows: int, per_bucket: int = 5_000
) -> DataFrame:
    """Add ``out``: the 0-based position of a row in its group, in the order of ``order``' hash.

    A group of any size is cut into hash buckets of about ``per_bucket`` rows; a window numbers
    the rows of one (group, bucket) and a running sum over the bucket counts shifts them. No
    task ever holds a whole group. ``order`` must identify a row; ``rows`` is the table's row
    count (it fixes the number of buckets, hence the same positions on every evaluation).
    """
    n = max(1, -(-rows // per_bucket))
    h = F.xxhash64(F.lit(20240229), *order)
    df = df.withColumn("_pb", F.pmod(h, F.lit(n)).cast("int"))
    counts = df.groupBy(*group, "_pb").agg(F.count(F.lit(1)).alias("_pn"))
    before = Window.partitionBy(*group).orderBy("_pb").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, "_pb", F.coalesce(F.sum("_pn").over(before), F.lit(0)).alias("_po"))
    inside = Window.partitionBy(*group, "_pb").orderBy(*order)
    numbered = df.withColumn("_pr", F.row_number().over(inside))
    on = [numbered[c].eqNullSafe(counts[c]) for c in [*group, "_pb"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    kept = [numbered[c] for c in df.columns if c != "_pb"]
    return numbered.join(counts, cond).select(
        *kept, (F.col("_po") + F.col("_pr") - 1).cast("long").alias(out)
    )


def components(edges: DataFrame, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` (long ids): (node, component) with the least id.

    Alternates large-star and small-star steps; every step is a group-by-minimum (combined
    before the shuffle) and a join that adaptive execution may split, so neither a hub node nor
    a huge component ends in one task. Nodes without an edge are not returned.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = staged(e, name)
    seen = None
    for _ in range(max_rounds):
        sym = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            sym.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).where("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a")
        e = staged(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(small.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct(),
            name,
        )
        mark = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )


def in_blocks(
    rows: DataFrame, group: list[str], id_col: str, block: int, weight: str | None = None, heavy: int = 1 << 20
) -> DataFrame:
    """Deal the rows of each group out to blocks so that any two rows of a group share a block.

    A group of m rows has c = ceil(m / block) hashed parts and a block for each pair of parts; a
    row goes to the c blocks of its part. Adds ``_g`` (64-bit block key), ``_i``, ``_j`` (the
    block's parts) and ``_c`` (the row's part). No block holds more than about 2 * block rows, nor, where
    a column ``weight`` is named, rows of more than about 2 * heavy together (but for a heavier row).
    """
    parts = F.count(F.lit(1)) / block
    parts = F.greatest(parts, F.sum(weight) / heavy) if weight else parts
    sizes = rows.groupBy(*group).agg(F.ceil(parts).cast("int").alias("_n"))
    rows = rows.join(sizes, group).withColumn("_c", F.pmod(F.xxhash64(id_col), F.col("_n")).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    rows = rows.withColumns({"_i": F.least("_c", "_o").cast("int"), "_j": F.greatest("_c", "_o").cast("int")})
    return rows.withColumn("_g", F.xxhash64(*group, "_i", "_j")).drop("_n", "_o")


def by_block(rows: DataFrame) -> DataFrame:
    """Rows of a block next to each other in one partition, for ``blocks`` in a mapInPandas."""
    return rows.repartition(F.col("_g")).sortWithinPartitions("_g")


def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[dict[str, np.ndarray]]:
    """The runs of equal ``_g`` in a sorted stream of frames, as columns; holds one block and one batch."""
    rest: dict[str, np.ndarray] = {}
    for pdf in batches:
        cols = {c: pdf[c].to_numpy() for c in pdf.columns}
        if rest:
            cols = {c: np.concatenate([rest[c], v]) for c, v in cols.items()}
        g = cols["_g"]
        edges = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1)] if len(g) else []
        for lo, hi in zip(edges, edges[1:]):
            yield {c: v[lo:hi] for c, v in cols.items()}
        rest = {c: v[edges[-1] :] for c, v in cols.items()} if edges else {}
    if rest:
        yield rest


def shared_counts(sets: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """Matrix of intersection sizes of duplicate-free value arrays."""
    if len(sets) == 1 and len(other) <= 4:
        return np.array([[len(np.intersect1d(sets[0], o, assume_unique=True)) for o in other]], np.int64)
    _, col, n = np.unique(np.concatenate([*sets, *other]), return_inverse=True, return_counts=True)
    keep = np.cumsum(n > 1) - 1
    keep[n == 1] = -1  # a value held once is in no intersection
    width = int(keep.max()) + 1 if len(keep) else 0
    col = keep[col]
    out = np.zeros((len(sets), len(other)), np.float32)
    lens = [len(s) for s in (*sets, *other)]
    row = np.repeat(np.arange(len(lens)), lens)
    for lo in range(0, width, 4096):
        at = (col >= lo) & (col < lo + 4096)
        m = np.zeros((len(lens), min(4096, width - lo)), np.float32)
        m[row[at], col[at] - lo] = 1
        out += m[: len(sets)] @ m[len(sets) :].T
    return out.astype(np.int64)


def forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions of the edges (a[i], b[i]) that join something new: at most one a label."""
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append(i)
    return out


def framed(parts: Iterator[pd.DataFrame], size: int = 200_000) -> Iterator[pd.DataFrame]:
    """Small frames joined to frames of about ``size`` rows."""
    held, n = [], 0
    for p in parts:
        held.append(p)
        n += len(p)
        if n >= size:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)
