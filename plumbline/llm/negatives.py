"""Hard-negative mining by a secondary-sort shuffle.

Each anchor's scored rows are sorted by the packed key (anchor, descending score, positives first, id), dealt by anchor: a
repartition by anchor that sorts within its partitions, as repartitionAndSortWithinPartitions does, on columns. One
streaming pass over each partition opens a window at each positive and gives out the next negatives that fall into open
windows; its state is the windows of one anchor, never its rows.

Only rows that can count reach that sort. Anchors and rows are dealt to blocks, each pair of blocks is one task, and a task
keeps an anchor's first `positives` rows of its label; once these are merged, the windows are known, and a second meeting
of blocks keeps the first `negatives` rows of other labels in each window. The first ones of all blocks include the first
ones of all rows, so the result is that of sorting every pair. A hot label is split into blocks like the rest.

Scores are inner products of floor(scale * x), x as double, in exact integers (in floating point only where every sum stays
below 2^53, in Python integers where 64 bits may not do); they are stored as long, and saturate there. Rows with a null id,
label or vector, or with a null or non-finite component, take no part. Vectors meet only others of their length; empty ones
score 0. Repeated ids are separate rows, each with a list of its own where it is an anchor. Ties in score go to the smaller
id, then to the row read first. An anchor without positives, or a positive without negatives in its window, gives no rows;
nor does a positive with a negative score. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_enough

#: Rows of a block at most, and the number of (label, block) counts that are broadcast; above it they are joined.
BLOCK_ROWS, BROADCAST_BLOCKS = 16_384, 200_000
PICKED = "anchor long, anchor_id long, row long, id long, score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(vectors: DataFrame, is_anchor: Column, scale: float, id_col: str, label_col: str, vec_col: str) -> DataFrame:
    """(row, id, label, vec, d, anchor) of the rows that take part, written out, so that row numbers hold."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("vec"), F.size(v).alias("d"), fine.alias("fine"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND fine").withColumn("anchor", F.coalesce(is_anchor, F.lit(False)))
    return cut(rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", "vec", "d", "anchor"), "vectors")


def meet(anchors: DataFrame, rows: DataFrame, by: list[str], task, block_rows: int) -> DataFrame:
    """PICKED rows of `task`, run on each pair of a block of anchors and a block of rows that are equal in `by`."""
    n = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("m")).where("m > 0")
    parts = 2 * rows.sparkSession.sparkContext.defaultParallelism
    size = F.least(F.lit(block_rows), F.greatest(F.lit(1024), F.ceil(F.col("n") / parts)))
    blocks = small_enough(n.select(*by, F.ceil(F.col("n") / size).cast("int").alias("row_blocks"), F.ceil(F.col("m") / size).cast("int").alias("anchor_blocks")), BROADCAST_BLOCKS)
    deal = lambda seed, count: F.pmod(F.xxhash64(F.lit(seed), "row"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    left = anchors.join(blocks, by).withColumn("a", deal(1, "anchor_blocks")).withColumn("r", every("row_blocks"))
    right = rows.select("row", "id", "label", "vec", "d").join(blocks, by).withColumn("r", deal(2, "row_blocks")).withColumn("a", every("anchor_blocks"))
    right = right.toDF(*right.columns)  # columns of its own: both sides stem from `rows`
    return left.groupBy(*by, "a", "r").cogroup(right.groupBy(*by, "a", "r")).applyInArrow(task, PICKED)


def matrix(t, d: int) -> np.ndarray:
    return t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, d)


def products(a: np.ndarray, b: np.ndarray):
    """For each row of a, its exact integer inner products with the rows of b."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        a, b = a.astype(np.float64), b.astype(np.float64)
        for i in range(0, len(a), 256):
            yield from np.rint(a[i : i + 256] @ b.T).astype(np.int64)
    elif most < 2.0**62:
        yield from (b @ x for x in a)
    else:
        wide = b.astype(object)
        for x in a.astype(object):
            yield np.array([min(max(int(s), -(2**63)), 2**63 - 1) for s in wide @ x], dtype=np.int64)


def first(at: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The k of the places `at` with the largest scores; ties go to the smaller id, then row."""
    if len(at) > k:
        s = score[at]
        at = at[s >= np.partition(s, len(s) - k)[len(s) - k]]
    return at[np.lexsort((rows[at], ids[at], ~score[at]))][:k]  # ~x falls as x grows, and cannot overflow


def picker(choose):
    """A task of `meet`: choose(score, anchor's label, anchor's row, its windows, block) names the places to keep."""

    def task(anchors, block):
        import pyarrow as pa

        out = [[np.zeros(0, np.int64)] for _ in range(5)]
        if anchors.num_rows and block.num_rows:
            d = anchors.column("d")[0].as_py()
            ids, rows = block.column("id").to_numpy(), block.column("row").to_numpy()
            labels = block.column("label").to_numpy(zero_copy_only=False)
            own = anchors.column("label").to_numpy(zero_copy_only=False)
            a_ids, a_rows = anchors.column("id").to_numpy(), anchors.column("row").to_numpy()
            windows = anchors.column("windows").to_pylist() if "windows" in anchors.column_names else [None] * anchors.num_rows
            for i, score in enumerate(products(matrix(anchors, d), matrix(block, d))):
                at = choose(score, labels == own[i], rows != a_rows[i], windows[i], ids, rows)
                for x, v in zip(out, (np.full(len(at), a_rows[i]), np.full(len(at), a_ids[i]), rows[at], ids[at], score[at])):
                    x.append(v)
        return pa.table(dict(zip(("anchor", "anchor_id", "row", "id", "score"), map(np.concatenate, out))))

    return task


def sweep(k: int, low: int, high: int, den: int):
    """The streaming pass: rows of one anchor arrive by descending score, positives before negatives of the same score."""

    def run(batches):
        import pyarrow as pa

        anchor, opened = None, []
        for b in batches:
            out = []
            for a, a_id, score, negative, i in zip(*(b.column(c).to_pylist() for c in ("anchor", "anchor_id", "score", "negative", "id"))):
                if a != anchor:
                    anchor, opened = a, []
                if not negative:
                    opened.append([i, score, 0])
                    continue
                for w in opened:
                    if low * w[1] <= den * score <= high * w[1]:
                        w[2] += 1
                        out.append((a_id, w[0], w[2], i, w[1], score))
                opened = [w for w in opened if w[2] < k and den * score >= low * w[1]]
            names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
            cols = zip(*out) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32() if n == "rank" else pa.int64()) for n, c in zip(names, cols)], names=list(names))

    return run


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, den: int = 100, scale: float = 256.0, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For each anchor (is_anchor: a Column over `id`) and each of its first `positives` rows of the same label, the first
    `negatives` rows of other labels with low/den * positive_score <= negative_score <= high/den * positive_score."""
    rows = usable(vectors, is_anchor, scale, id_col, label_col, vec_col)
    anchors = rows.where("anchor").select("row", "id", "label", "vec", "d")
    near = meet(anchors, rows, ["d", "label"], picker(lambda score, same, other, _, ids, at: first(np.flatnonzero(same & other), score, ids, at, positives)), block_rows)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc("id"), F.asc("row"))
    near = cut(near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives).drop("place"), "positives")

    def in_windows(score, same, other, windows, ids, at):
        kept = [np.zeros(0, np.int64)]
        for p in windows:
            inside = ~same & (score >= -((-low * p) // den)) & (score <= (high * p) // den)
            kept.append(first(np.flatnonzero(inside), score, ids, at, negatives))
        return np.unique(np.concatenate(kept))

    # at most `positives` scores an anchor
    windows = near.groupBy(F.col("anchor").alias("row")).agg(F.collect_set("score").alias("windows"))
    far = meet(anchors.join(windows, "row"), rows, ["d"], picker(in_windows), block_rows)
    both = near.withColumn("negative", F.lit(0)).union(far.withColumn("negative", F.lit(1)))
    ready = both.repartition("anchor").sortWithinPartitions("anchor", F.desc("score"), "negative", "id", "row")
    return ready.select("anchor", "anchor_id", "score", "negative", "id").mapInArrow(sweep(negatives, low, high, den), RESULT)
