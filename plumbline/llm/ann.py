"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots, cut off after `prefix` of them. Each block of rows keeps one
inverted file per pivot: the rows that have the pivot in their prefix, by its place there. A query opens the files of its
own prefix only, and in each reads only the places within `reach` of the pivot's place in the query; the other files are
skipped. With places counted from 0 and absent pivots at `prefix`, the footrule distance |place in the query - place in
the row|, summed over all pivots, is a constant of the two prefix lengths less twice the sum, over the pivots that both
have, of prefix - max(both places): so that adding up what is read ranks the rows. Those with the smallest distances
(`share` of the block, and all that tie with the last) are reranked by exact cosine in double precision on the original
vectors.

Rows are dealt to blocks by a hash of their id, queries to blocks too, and each pair of blocks is one task, so that no
task holds more than two blocks and no hot vector gathers rows. Pivots are a bounded sample (`pivots` rows with the
smallest hashes); every row is indexed. Vectors without any structure need a share of the rows for a given recall, so
that work grows with queries times rows; a smaller `share` suffices where vectors cluster.

Vectors that are null, empty, all zero, or hold a null or non-finite component take no part, nor do null ids. Each
dimension is a space of its own. Repeated ids count as separate rows; a query's own row is left out by its id. With fewer
than k other rows, all of them are returned. Ties in cosine go to the smaller id, ties in footrule are all reranked.
Columns beside id and vector are not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


PIVOTS, PREFIX, REACH = 512, 64, 32
#: Share of a block that is reranked, and the least number of its rows.
RERANK_SHARE, RERANK_LEAST = 0.08, 256
RESULT = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, d) of the rows that take part."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("vec"), F.size(v).alias("d")).where(F.col("id").isNotNull() & fine)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def prefixes(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The nearest pivots of each unit vector, nearest first."""
    near = x @ pivots.T
    if length < near.shape[1]:
        top = np.argpartition(-near, length - 1, axis=1)[:, :length]
    else:
        top = np.broadcast_to(np.arange(near.shape[1]), near.shape)
    order = np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable")
    return np.take_along_axis(top, order, axis=1)


class Postings:
    """Inverted files of a block of rows: for each pivot its rows, by the place that it has in them."""

    def __init__(self, order: np.ndarray, pivots: int):
        n, self.length = order.shape
        place = np.broadcast_to(np.arange(self.length), order.shape)
        slot = (order * self.length + place).ravel()
        by = np.argsort(slot, kind="stable")
        self.rows = np.repeat(np.arange(n, dtype=np.int32), self.length)[by]
        self.places = place.ravel()[by].astype(np.int32)
        self.starts = np.searchsorted(slot[by], np.arange(pivots * self.length + 1))
        self.n = n

    def likeness(self, order: np.ndarray, reach: int) -> np.ndarray:
        """Sum over common pivots of length - max(places) for each row, read from the files of one query's pivots."""
        places = np.arange(len(order))
        low, high = np.maximum(0, places - reach), np.minimum(self.length, places + reach + 1)
        start, end = self.starts[order * self.length + low], self.starts[order * self.length + high]
        n = end - start
        at = np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
        return np.bincount(self.rows[at], self.length - np.maximum(self.places[at], np.repeat(places, n)), self.n)


def permutation_search(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX, reach: int = REACH, share: float = RERANK_SHARE, block_rows: int = 16_384) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows nearest by cosine to each row for which is_query (a Column over `id`) holds."""
    rows = usable(vectors, id_col, vec_col)
    found = None
    for d in sorted(r.d for r in rows.select("d").distinct().collect()):
        of = _search(rows.where(F.col("d") == d).select("id", "vec"), is_query, k, pivots, prefix, reach, share, block_rows)
        found = of if found is None else found.union(of)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], RESULT)
    # the k best of each block, then of all: at most k rows a query and block reach this
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, is_query, k: int, pivots: int, prefix: int, reach: int, share: float, block_rows: int) -> DataFrame:
    sample = unit(np.array([r.vec for r in rows.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()], dtype=np.float64))
    length = min(prefix, len(sample))
    n, n_queries = rows.count(), rows.where(is_query).count()
    size = int(min(block_rows, max(2048, n // (2 * rows.sparkSession.sparkContext.defaultParallelism))))
    row_blocks, query_blocks = -(-n // size), max(1, -(-n_queries // size))
    block = lambda seed, count: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(count)).cast("int")
    left = rows.where(is_query).withColumn("q", block(1, query_blocks)).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    right = rows.withColumn("r", block(2, row_blocks)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def matrix(t) -> np.ndarray:
        return t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)

    def search(queries, block_of_rows):
        import pyarrow as pa

        out: dict[str, list] = {"query_id": [np.zeros(0, np.int64)], "vec_id": [np.zeros(0, np.int64)], "score": [np.zeros(0)]}
        if queries.num_rows and block_of_rows.num_rows:
            q, v = unit(matrix(queries)), unit(matrix(block_of_rows))
            q_ids, ids = queries.column("id").to_numpy(), block_of_rows.column("id").to_numpy()
            files = Postings(prefixes(v, sample, length), len(sample))
            asked = prefixes(q, sample, length)
            most = min(len(ids), max(RERANK_LEAST, k + 1, int(len(ids) * share)))
            for i in range(len(q)):
                like = files.likeness(asked[i], reach)
                best = np.flatnonzero(like >= np.partition(like, len(ids) - most)[len(ids) - most])
                best = best[ids[best] != q_ids[i]]
                score = (v[best] * q[i]).sum(axis=1)  # one order of addition for every row: equal vectors tie exactly
                take = np.lexsort((ids[best], -score))[:k]
                out["query_id"].append(np.full(len(take), q_ids[i]))
                out["vec_id"].append(ids[best][take])
                out["score"].append(score[take])
        return pa.table({c: np.concatenate(x) for c, x in out.items()})

    return left.groupBy("r", "q").cogroup(right.groupBy("r", "q")).applyInArrow(search, RESULT)
