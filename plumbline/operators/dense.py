"""Exact dense search: block-maximum bounds and a threshold for each question decide which blocks of vectors are scored.

Vectors are dealt to blocks of about `block_rows`, those with like largest components together (short texts have few, large
ones). Each block keeps its largest and smallest value of every component, so that a question's best possible score in it
is one dot product. A question first scores the block with the best bound; its k-th best score there is a threshold that
any other block's bound must reach. What remains is scored block by block, a block meeting at most QUESTIONS questions at a
time. Every task holds one block, whatever the sizes; the pairs of questions and blocks are the only product.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

BLOCK_ROWS, QUESTIONS = 4096, 1024


def matrix(column) -> np.ndarray:
    """The rows of an Arrow column of lists of one length."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def ranges(batches):
    """(block, hi, lo) of each block in a batch: largest and smallest value of every component."""
    import pyarrow as pa

    for b in batches:
        if b.num_rows:
            block, x = b.column(0).to_numpy(), matrix(b.column(1))
            order = np.argsort(block, kind="stable")
            at = np.flatnonzero(np.append(True, np.diff(block[order]) != 0))
            pick = lambda f: pa.array(list(f.reduceat(x[order], at, axis=0)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(block[order][at]), pick(np.maximum), pick(np.minimum)], names=["block", "hi", "lo"])


def merged(t):
    import pyarrow as pa

    wrap = lambda x: pa.array([x], pa.list_(pa.float64()))
    return pa.table({"block": t.column("block").slice(0, 1), "hi": wrap(matrix(t.column("hi")).max(axis=0)), "lo": wrap(matrix(t.column("lo")).min(axis=0))})


def bounds(batches):
    """Adds `bound`, the most that a question can score in a block, to (question, block, vec, hi, lo)."""
    import pyarrow as pa

    for b in batches:
        if b.num_rows:
            q, hi, lo = (matrix(b.column(c)) for c in ("vec", "hi", "lo"))
            bound = np.where(q > 0, q * hi, q * lo).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bound)], names=["q", "block", "bound"])


def best_of_block(k: int, digits: int):
    """Task: the k best rows of a block for each of some questions, ties by key."""

    def run(questions, rows):
        import pyarrow as pa
        import pyarrow.compute as pc

        out = []
        if questions.num_rows and rows.num_rows:
            scores = np.round(matrix(questions.column("vec")) @ matrix(rows.column("vec")).T, digits)
            keys, asked = rows.column("c").combine_chunks(), questions.column("q").combine_chunks()
            for i, s in enumerate(scores):
                at = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k]) if len(s) > k else np.arange(len(s))
                t = pa.table({"s": pa.array(s[at]), **{f"k{n}": keys.field(n).take(pa.array(at)) for n in range(keys.type.num_fields)}})
                at = at[pc.sort_indices(t, [("s", "descending"), *((n, "ascending") for n in t.column_names[1:])]).to_numpy()[:k]]
                out.append(pa.table({"q": asked.take(pa.array(np.full(len(at), i))), "c": keys.take(pa.array(at)), "dense": pa.array(s[at])}))
        return pa.concat_tables(out) if out else pa.table({"q": questions.column("q").slice(0, 0), "c": rows.column("c").slice(0, 0), "dense": pa.array([], pa.float64())})

    return run


def unit(vec: Column) -> Column:
    """The vector over its length; null for null and zero vectors, and those with a null or non-finite component."""
    v = vec.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(fine & (norm > 0), F.transform(v, lambda x: x / norm))


def dense_search(questions: DataFrame, chunks: DataFrame, q_key: list[str], c_key: list[str], k: int, within: list[str] | None = None, digits: int = 9, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """q_key, c_key, dense, dense_rank: the k chunks with the largest dot product (the cosine, for unit vectors) with each
    question, ties by c_key; with `within`, only chunks that are equal in these columns.

    Both sides have a column `vec`, an array of one length without nulls; rows with a null `vec` take no part.
    """
    within = within or []
    scope = F.xxhash64(*within) if within else F.lit(0).cast("long")
    peak = F.floor(2 * F.log2(F.greatest(F.array_max(F.transform("vec", F.abs)), F.lit(1e-9)))).cast("int")
    rows = chunks.where("vec IS NOT NULL").select(F.struct(*c_key).alias("c"), "vec", scope.alias("scope"), peak.alias("peak"))
    rows = written(rows)
    sizes = rows.groupBy("scope", "peak").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))
    rows = rows.join(sizes, ["scope", "peak"]).withColumn("block", F.xxhash64("scope", "peak", F.pmod(F.xxhash64("c"), "blocks")))
    top = rows.select("block", "vec").mapInArrow(ranges, "block long, hi array<double>, lo array<double>").groupBy("block").applyInArrow(merged, "block long, hi array<double>, lo array<double>")
    top = top.join(rows.select("block", "scope").distinct(), "block").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(15))))
    asked = questions.where("vec IS NOT NULL").select(F.struct(*q_key).alias("q"), "vec", scope.alias("scope"), F.pmod(F.xxhash64(*q_key), F.lit(16)).cast("int").alias("qb"))
    asked = written(asked)
    pairs = asked.join(top, ["scope", "qb"]).select("q", "block", "vec", "hi", "lo")
    pairs = written(pairs.mapInArrow(bounds, pairs.select("q", "block", F.lit(0.0).alias("bound")).schema))
    pairs = pairs.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "block")))
    found = f"q {pairs.schema['q'].dataType.simpleString()}, c {rows.schema['c'].dataType.simpleString()}, dense double"

    def score(pairs: DataFrame) -> DataFrame:
        """The k best rows of each pair's block: a block's rows are dealt to as many tasks as it has groups of questions."""
        p = pairs.select("q", "block").join(asked.select("q", "vec"), "q")
        groups = pairs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUESTIONS).alias("groups"))
        left = p.join(groups, "block").withColumn("g", F.pmod(F.xxhash64("q"), "groups"))
        right = rows.join(groups, "block").withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
        left, right = left.select("q", "vec", "block", "g"), right.select("c", "vec", "block", "g")
        right = right.toDF(*right.columns)
        return left.groupBy("block", "g").cogroup(right.groupBy("block", "g")).applyInArrow(best_of_block(k, digits), found)

    first = written(score(pairs.where("place = 1")))
    least = first.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("dense")))).where(F.col("place") == k).select("q", F.col("dense").alias("least"))
    rest = pairs.where("place > 1").join(least, "q", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 10.0**-digits))
    every = first.union(score(rest))
    ranked = every.withColumn("dense_rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("dense"), "c"))).where(F.col("dense_rank") <= k)
    return ranked.select("q.*", "c.*", "dense", "dense_rank")
