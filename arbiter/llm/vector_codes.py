"""Vector code compression: product codebooks fitted by dual-tree Lloyd rounds, exact in integers.

1. Every vector becomes integers floor(scale * x) and is cut into equal consecutive parts. Rows are
   taken in blocks as they are read; a block is written once with a tree for each part: nodes of
   halves by the widest component, each with its bounding box, row count and component sums.
2. A round descends the block's tree and the codebook's tree together. Bounds on the distance of two
   boxes drop the combinations that hold no nearest entry for any row of the node; where one entry
   is left, the node's cached sum and count are added to it as a whole; leaves that stay uncertain
   compute integer distances row by row. Ties go to the lower index: a combination is dropped only
   when it is strictly farther.
3. A task returns one sum and count per (part, entry); Spark adds them up. Only codebooks
   (parts x entries x part length numbers) pass through the driver.

Integers keep every sum exact, so results do not depend on blocks or partitions.

Defined results: vectors that are null, empty or hold null or non-finite components are dropped; so
are vectors whose length is not a multiple of the parts or differs from that of the first kept
vector, and vectors with a component of 2^17 or more in size (their squared distances would not fit a
long). With fewer kept rows than entries the codebook is as small. Repeated vec_ids are rows of their
own; a null vec_id comes last. Null labels form one group. An empty table gives an empty result;
other columns are ignored. Entries that start equal stay apart: the lower index takes the rows, the
other is unused and stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbiter.llm.common import drop_staged, staged

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows of one block, and rows at which a node of its trees is a leaf.
BLOCK, LEAF = 4096, 16
#: Components of this size or more are out of range.
RANGE = 1 << 17

TREE = "n int, points binary, ranks binary, low binary, high binary, sums binary"


def kept_vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str | None, parts: int) -> DataFrame:
    """(vec_id, label, v) of the rows whose vector can be coded; ``v``: finite doubles."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float(RANGE))))
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), v.alias("v"))
    return rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % parts == 0) & fine)


def _integers(vectors, scale: int) -> np.ndarray:
    return np.floor(np.stack([np.asarray(v, np.float64) for v in vectors]) * scale).astype(np.int64)


# ---- trees over the rows of a block --------------------------------------------------------------


class PartTree:
    """Halves of a block's rows for one part, level by level; node j of a level has children 2j, 2j + 1.

    ``order`` lists the rows so that every node is a run of it; ``levels`` holds for each level the
    run bounds, bounding boxes and component sums of its nodes.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        n = len(points)
        self.points, self.order = points, np.arange(n)
        self.bounds = [np.array([0, n])]
        while n > leaf << (len(self.bounds) - 1):
            cuts = [0]
            for lo, hi in zip(self.bounds[-1], self.bounds[-1][1:]):
                mid = (lo + hi) // 2
                if hi - lo > 1:
                    rows = self.order[lo:hi]
                    p = points[rows]
                    wide = np.argmax(p.max(axis=0) - p.min(axis=0))
                    self.order[lo:hi] = rows[np.argpartition(p[:, wide], mid - lo)]
                cuts += [mid, hi]
            self.bounds.append(np.array(cuts))
        self.levels = []
        p = points[self.order]
        for b in self.bounds:
            at = np.minimum(b[:-1], max(n - 1, 0))
            self.levels.append(
                (np.minimum.reduceat(p, at), np.maximum.reduceat(p, at), np.add.reduceat(p, at), np.diff(b))
            )


def _pack(trees: list[PartTree], ints: np.ndarray) -> dict:
    stack = lambda k: np.stack([np.concatenate([lv[k] for lv in t.levels]) for t in trees])
    return {
        "n": len(ints),
        "points": ints.astype("<i4").tobytes(),
        "ranks": np.stack([t.order for t in trees]).astype("<i4").tobytes(),
        "low": stack(0).astype("<i4").tobytes(),
        "high": stack(1).astype("<i4").tobytes(),
        "sums": stack(2).astype("<i8").tobytes(),
    }


class Block:
    """A packed block read back: rows, and for each part the row order and node arrays."""

    def __init__(self, row, parts: int, width: int):
        n, self.width = int(row["n"]), width
        self.points = np.frombuffer(row["points"], "<i4").reshape(n, parts, width).astype(np.int64)
        self.order = np.frombuffer(row["ranks"], "<i4").reshape(parts, n)
        shape = (parts, -1, width)
        self.low, self.high = (np.frombuffer(row[c], "<i4").reshape(shape).astype(np.int64) for c in ("low", "high"))
        self.sums = np.frombuffer(row["sums"], "<i8").reshape(shape)
        self.bounds = [np.array([0, n])]
        while sum(len(b) - 1 for b in self.bounds) < self.low.shape[1]:
            b = self.bounds[-1]
            self.bounds.append(np.append(np.stack([b[:-1], (b[:-1] + b[1:]) // 2], 1).ravel(), n))


class EntryTree:
    """Halves of a codebook's entries by the widest component: ``levels`` of (entry lists, low, high)."""

    def __init__(self, entries: np.ndarray):
        groups = [np.arange(len(entries))]
        self.entries, self.levels = entries, []
        while True:
            low = np.stack([entries[g].min(axis=0) for g in groups])
            high = np.stack([entries[g].max(axis=0) for g in groups])
            self.levels.append((groups, low, high))
            if all(len(g) == 1 for g in groups):
                break
            halves, self_of = [], []
            for j, g in enumerate(groups):
                if len(g) == 1:
                    halves.append(g)
                    self_of.append(j)
                    continue
                p = entries[g]
                g = g[np.argsort(p[:, np.argmax(p.max(axis=0) - p.min(axis=0))], kind="stable")]
                halves += [g[: len(g) // 2], g[len(g) // 2 :]]
                self_of += [j, j]
            groups = halves
            self.levels[-1] += (np.array(self_of),)


def _assign(block: Block, part: int, tree: EntryTree, whole, leaf) -> None:
    """Descend both trees. ``whole(nodes, runs, entries)`` gets nodes of one nearest entry,
    ``leaf(rows, entries)`` the nearest entries of the rows of uncertain leaves."""
    start, order, pts = 0, block.order[part], block.points[:, part]
    level, last = 0, len(block.bounds) - 1
    nodes = np.array([0])
    step = 0
    open_ = np.ones((1, len(tree.levels[0][0])), bool)
    while len(nodes):
        groups, elow, ehigh = tree.levels[step][:3]
        at = start + nodes
        qlow, qhigh = block.low[part, at][:, None], block.high[part, at][:, None]
        gap = np.maximum(np.maximum(elow - qhigh, qlow - ehigh), 0)
        far = np.maximum(np.abs(qhigh - elow), np.abs(ehigh - qlow))
        near, most = (gap * gap).sum(2), (far * far).sum(2)
        best = np.where(open_, most, np.iinfo(np.int64).max).min(1)
        open_ &= near <= best[:, None]
        single = step == len(tree.levels) - 1
        if single:
            sure = open_.sum(1) == 1
            if sure.any():
                which = np.array([g[0] for g in groups])[open_[sure].argmax(1)]
                whole(at[sure], (block.bounds[level][nodes[sure]], block.bounds[level][nodes[sure] + 1]), which)
                nodes, open_ = nodes[~sure], open_[~sure]
        else:  # entries one level down
            open_ = open_[:, tree.levels[step][3]]
            step += 1
        if level < last:  # rows one level down
            start += len(block.bounds[level]) - 1
            level += 1
            nodes = np.stack([2 * nodes, 2 * nodes + 1], 1).ravel()
            open_ = np.repeat(open_, 2, axis=0)
            empty = block.bounds[level][nodes] == block.bounds[level][nodes + 1]
            nodes, open_ = nodes[~empty], open_[~empty]
        elif single:
            _leaves(block, level, nodes, open_, groups, order, pts, tree.entries, leaf)
            return


def _leaves(block, level, nodes, open_, groups, order, pts, entries, leaf) -> None:
    b = block.bounds[level]
    size = b[nodes + 1] - b[nodes]
    if not size.sum():
        return
    rows = order[np.concatenate([np.arange(b[i], b[i + 1]) for i in nodes])]
    allowed = np.zeros((len(nodes), len(entries)), bool)
    allowed[:, [g[0] for g in groups]] = open_
    allowed = np.repeat(allowed, size, axis=0)
    d = pts[rows][:, None] - entries[None]
    d = np.where(allowed, (d * d).sum(2), np.iinfo(np.int64).max)
    leaf(rows, d.argmin(1))  # the first least: ties to the lower index


# ---- the job -------------------------------------------------------------------------------------


def _blocks(rows: DataFrame, parts: int, width: int, scale: int, block: int) -> DataFrame:
    """Blocks of rows as they lie, with their trees; ids and labels stand beside."""
    label = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def packed(pdf):
            ints = _integers(pdf["v"], scale)
            cut = ints.reshape(len(ints), parts, width)
            row = _pack([PartTree(cut[:, p]) for p in range(parts)], ints)
            return pd.DataFrame([row | {"rows": pdf[["vec_id", "label"]].to_dict("records")}])

        for pdf in batches:
            held.append(pdf.astype({"vec_id": "Int64"}).astype(object).where(pdf.notna(), None))
            while sum(map(len, held)) >= block:
                every = pd.concat(held, ignore_index=True)
                yield packed(every[:block])
                held = [every[block:].reset_index(drop=True)]
        if sum(map(len, held)):
            yield packed(pd.concat(held, ignore_index=True))

    of = rows.where(F.size("v") == parts * width).select("vec_id", "label", "v")
    return of.mapInPandas(run, f"{TREE}, rows array<struct<vec_id: long, label: {label}>>")


def _sums(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, n, sums) over all rows, each counted at its nearest entry."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = [EntryTree(b) for b in books]
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for pdf in batches:
            for row in pdf.to_dict("records"):
                b = Block(row, parts, width)
                for p in range(parts):

                    def whole(at, runs, which, p=p, b=b):
                        np.add.at(n[p], which, runs[1] - runs[0])
                        np.add.at(sums[p], which, b.sums[p, at])

                    def leaf(rows, which, p=p, b=b):
                        np.add.at(n[p], which, 1)
                        np.add.at(sums[p], which, b.points[rows, p])

                    _assign(b, p, trees[p], whole, leaf)
        p, e = np.nonzero(n)
        yield pd.DataFrame({"part": p, "entry": e, "n": n[p, e], "sums": list(sums[p, e])})

    each = blocks.select(*[c.split()[0] for c in TREE.split(", ")]).mapInPandas(
        run, "part int, entry int, n long, sums array<long>"
    )
    total = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)]
    return each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total)


def _codes(blocks: DataFrame, books: np.ndarray, label: str) -> DataFrame:
    """(vec_id, label, code, error) of every row under the final codebooks."""
    parts, _, width = books.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = [EntryTree(b) for b in books]
        for pdf in batches:
            for row in pdf.to_dict("records"):
                b = Block(row, parts, width)
                code = np.empty((int(row["n"]), parts), np.int64)
                for p in range(parts):

                    def whole(at, runs, which, p=p, b=b):
                        for lo, hi, w in zip(*runs, which):
                            code[b.order[p, lo:hi], p] = w

                    def leaf(rows, which, p=p):
                        code[rows, p] = which

                    _assign(b, p, trees[p], whole, leaf)
                d = b.points - books[np.arange(parts), code]
                names = [bytes(c).hex() for c in code.astype(np.uint8)]
                yield pd.DataFrame({"rows": row["rows"], "code": names, "error": (d * d).sum((1, 2))})

    return blocks.mapInPandas(
        run, f"rows struct<vec_id: long, label: {label}>, code string, error long"
    ).select("rows.vec_id", "rows.label", "code", "error")


def first_books(rows: DataFrame, parts: int, entries: int, scale: int) -> np.ndarray | None:
    """Parts of the kept vectors with the least ids: (parts, entries, part length)."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    if not first:
        return None
    rows = rows.where(F.size("v") == len(first[0]["v"]))
    least = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()  # `entries` rows
    ints = _integers([r["v"] for r in least], scale)
    return ints.reshape(len(least), parts, -1).transpose(1, 0, 2).copy()


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK,
) -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256."""
    rows = kept_vectors(vectors, id_col, vec_col, label_col, parts)
    label = rows.schema["label"].dataType.simpleString()
    books = first_books(rows, parts, entries, scale)
    if books is None:
        empty = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
        return vectors.sparkSession.createDataFrame([], empty)
    blocks = staged(_blocks(rows, parts, books.shape[2], scale, block), "code-blocks")
    for _ in range(rounds):
        books = books.copy()
        for r in _sums(blocks, books).collect():  # at most parts * entries rows
            books[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(books.shape[2])]
    coded = staged(_codes(blocks, books, label), "codes")
    drop_staged(blocks)
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    same = coded["label"].eqNullSafe(by_label["label"])
    return coded.join(by_label, same).select(
        "vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")
    )


def codes_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same by plain Lloyd rounds in DuckDB SQL over ``embeddings``."""
    near = (
        "SELECT row, part, min(entry) AS entry, any_value(least) AS d FROM ("
        " SELECT row, part, entry, d, min(d) OVER (PARTITION BY row, part) AS least FROM ("
        "  SELECT x.row, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v))::BIGINT AS d"
        "  FROM x JOIN {book} b USING (part, pos) GROUP BY ALL)) WHERE d = least GROUP BY row, part"
    )
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS row,
        vec_id, label, embedding AS e FROM embeddings WHERE embedding IS NOT NULL
        AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c) OR abs(c) >= {RANGE}]) = 0
        AND len(embedding) > 0 AND len(embedding) % {parts} = 0),
      x AS MATERIALIZED (SELECT row, (i // w)::INT AS part, (i % w)::INT AS pos, v FROM (
        SELECT row, len(e) // {parts} AS w, unnest(range(len(e))) AS i,
        unnest([floor({scale} * c::DOUBLE)::BIGINT FOR c IN e]) AS v FROM kept)),
      b0 AS MATERIALIZED (SELECT part, row AS entry, pos, v FROM x WHERE row < {entries})"""
    ]
    for r in range(rounds):
        steps.append(f"n{r} AS MATERIALIZED ({near.format(book=f'b{r}')})")
        steps.append(
            f"m{r} AS (SELECT part, entry, pos, sum(v)::HUGEINT AS s,"
            f" count(*) AS c FROM x JOIN n{r} USING (row, part) GROUP BY part, entry, pos)"
        )
        exact = "(CASE WHEN s >= 0 THEN s // c ELSE -((-s + c - 1) // c) END)::BIGINT"
        steps.append(
            f"b{r + 1} AS MATERIALIZED (SELECT part, entry, pos, CASE WHEN c IS NULL THEN b.v ELSE {exact} END AS v"
            f" FROM b{r} b LEFT JOIN m{r} USING (part, entry, pos))"
        )
    return (
        "WITH " + ",\n      ".join(steps) + f""",
      f AS MATERIALIZED ({near.format(book=f'b{rounds}')}),
      c AS (SELECT row, string_agg(printf('%02x', entry::INT), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
        FROM f GROUP BY row)
      SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
        (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b{rounds}) AS codebooks_sha256
      FROM kept JOIN c USING (row)"""
    )
