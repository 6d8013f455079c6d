"""Mixing sources to target weights over a time-varying curriculum.

Sources in code-point order (null last) get the given weights by turns. Their targets share the budget by weight; a
target stops at `most` times its source's size, and what it leaves is shared again by weight until none is above.

A source's weight runs over training time t in [0, 1] on a piecewise linear schedule, scaled so that its integral is the
source's target. The words that the mix takes from a source are laid on one line, document after document in the order
of a keyed hash, epoch after epoch; the document that covers word c of the source gets the position t at which the
integral of the schedule reaches c. A copy is taken if its middle lies within the target, so that the words taken differ
from the target by half a document at most, and no document is taken more than ceil(most) times.

A document's size is its number of words, of texts of any length; null and empty texts have size 0 and are taken 0
times. Repeated and null ids are separate rows. Sources of equal words are told apart by their place. A table without
words has targets of 0, an empty one an empty result. Columns beside doc_id, source and text are not read by `mix`;
`training_order` carries them in a struct, so that none clashes with its own.

Hot sources: documents are dealt to hash buckets of about BUCKET_ROWS rows of a source; bucket sums give each bucket's
first word, and only within a bucket do windows order single documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

WEIGHTS = (1.0, 2.0, 3.0)
#: Rows that a hash bucket holds on average if all rows are of one source.
BUCKET_ROWS = 20_000
#: (t, relative weight) knots: the shape that each source's weight follows, by turns; each is scaled to its target.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: float = 3.0) -> DataFrame:
    """(source, source_size, place, weight, target) from (source, source_size), one row a source.

    Each round is one distributed sum: the words left over the weights left; sources above their cap are fixed.
    """
    # dense place by code point: sources are range-partitioned, and each partition's count tells where the next one starts
    order = F.col("source").asc_nulls_last()
    rows = cut(sizes.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "sources")
    before = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    parts = rows.groupBy("part").count().select("part", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1 + F.col("before")
    rows = rows.join(parts, "part").withColumn("place", place)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = cut(rows.select("source", "source_size", "place", weight.alias("weight")), "sources")

    total = rows.agg(F.sum("source_size")).first()[0] or 0
    share = 0.0
    left = None
    while True:  # the share grows with each round, so each round fixes a source or is the last
        capped = F.col("weight") * F.lit(share) > F.lit(most) * F.col("source_size")
        s = rows.agg(F.sum(F.when(capped, F.lit(most) * F.col("source_size"))).alias("fixed"), F.sum(F.when(~capped, F.col("weight"))).alias("free"), F.count_if(capped).alias("n")).first()
        if s.n == left or not s.free:
            break
        left, share = s.n, (total - (s.fixed or 0.0)) / s.free
    target = F.least(F.col("weight") * F.lit(share), F.lit(most) * F.col("source_size")).cast("double")
    return rows.withColumn("target", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(target))


def position(fraction: Column, schedule) -> Column:
    """The time t at which the integral of a piecewise linear schedule reaches `fraction` of its whole."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:])]
    whole, before = sum(areas), 0.0
    out = None
    for (a, b), area in reversed(list(zip(zip(schedule, schedule[1:]), areas))):
        before = sum(x for x, k in zip(areas, schedule) if k[0] < a[0])
        y = F.greatest(fraction * whole - F.lit(before), F.lit(0.0))
        slope = (b[1] - a[1]) / (b[0] - a[0])
        # solve a1 * x + slope / 2 * x^2 = y in the form that is safe for small slopes
        x = 2 * y / (F.lit(a[1]) + F.sqrt(F.greatest(F.lit(a[1] ** 2) + F.lit(2 * slope) * y, F.lit(1e-300))))
        t = F.lit(a[0]) + x
        out = t if out is None else F.when(fraction * whole < before + area, t).otherwise(out)
    return F.least(out, F.lit(1.0))


def mix(docs: DataFrame, weights=WEIGHTS, most: float = 3.0, bucket_rows: int = BUCKET_ROWS, seed: int = 1, schedules=SCHEDULES) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies, first_position) for every row of docs."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))
    rows = cut(rows, "sizes")
    buckets = rows.count() // bucket_rows + 1
    rows = rows.withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 20), F.lit(buckets)))
    sums = cut(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "sums")
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")
    firsts = sums.withColumn("first", before)
    firsts = cut(firsts.alias("f").join(targets.alias("t"), F.expr("f.source <=> t.source")).select("f.source", "bucket", "first", "source_size", "target", "place"), "firsts")
    # doc_id orders equal hashes; rows that are wholly equal may change places without any effect
    inner = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = rows.withColumn("within", F.sum("size").over(inner) - F.col("size")).alias("r")
    out = laid.join(firsts.alias("f"), F.expr("r.source <=> f.source AND r.bucket = f.bucket")).select("doc_id", "r.source", "size", "source_size", "target", "place", (F.col("first") + F.col("within")).alias("start"))
    middle = F.col("start") + F.col("size") / 2
    copies = F.when(F.col("size") == 0, 0).otherwise(F.least(F.ceil((F.col("target") - middle) / F.col("source_size")), F.lit(int(-(-most // 1)))))
    out = out.withColumn("copies", F.greatest(F.coalesce(copies, F.lit(0)), F.lit(0)).cast("int"))
    part = F.when(F.col("target") > 0, F.least((F.col("start") + 0.0) / F.col("target"), F.lit(1.0)))
    at = None
    for i, s in enumerate(schedules):
        p = position(part, s)
        at = p if at is None else F.when(F.col("place") % len(schedules) == i, p).otherwise(at)
    return out.withColumn("taken", F.col("copies") * F.col("size")).withColumn("first_position", F.when(F.col("copies") > 0, at))


def training_order(docs: DataFrame, weights=WEIGHTS, most: float = 3.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **parameters) -> DataFrame:
    """The rows of docs that the mix takes, one for each copy, range-sorted by training position; columns unchanged.

    Later copies lie one pass of the source later. Rows are found again by a hash of id, source and text; of rows that are
    equal in all three one takes part.
    """
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(source_col), F.col(text_col))
    packed = docs.select(key.alias("doc_id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    narrow = docs.select(key.alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    plan = cut(mix(narrow, weights, most, **parameters).where("copies > 0").select("doc_id", "copies", "first_position", "source_size", "target"), "plan")
    again = cut(plan.groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if not again.isEmpty():
        packed = packed.join(again, "doc_id", "left_anti").unionByName(packed.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
        kept = packed.select("doc_id", F.col("row")[source_col].alias("source"), F.col("row")[text_col].alias("text"))
        plan = cut(mix(kept, weights, most, **parameters).where("copies > 0").select("doc_id", "copies", "first_position", "source_size", "target"), "plan")
    span = F.coalesce(F.when(F.col("target") > 0, F.col("source_size") / F.col("target")), F.lit(0.0))
    rows = packed.join(plan, "doc_id").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    order = [F.col("first_position") + F.col("epoch") * span, F.col("doc_id"), F.col("epoch")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("row.*")
