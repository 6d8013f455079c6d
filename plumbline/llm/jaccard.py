"""N-gram Jaccard self-join with token-combination prefixes.

A text's tokens are hashes of its distinct word n-grams. Two texts link if intersection / union >= threshold.

1. Sieve: of the tokens whose hash lies below a fixed share of the hash space, all texts' counts are taken. A text with
   more than t = n - ceil(threshold * n) tokens that no other text holds cannot link, for a partner lacks at most t of
   its n tokens. Texts with equal token sets are one class from here on.
2. For the rest, counts over all their tokens give the exact number of a class's own tokens (u) and the order of shared
   ones: rare first, then frequent ones, by hash. The same test with u leaves few classes.
3. Signatures: own tokens stand first in the order and use up u of the t + 1 places of the prefix. Rare tokens are
   indexed singly. Tokens in more than FREQUENT classes are indexed in pairs within subclasses, and the prefix is
   extended by one token for each subclass that it enters: if no pair of a subclass with m prefix tokens is shared, m - 1
   of them are missing at least, so that two linked classes share a rare token or a pair. The number of subclasses grows
   with the set's size (by doublings, both sides of a border get both), which keeps pairs in proportion to the prefix.
4. Each signature's bucket is compared with a pivot, never pair by pair: the class with fewest own tokens of those that
   are no near miss of an earlier pivot. Classes that do not link with the pivot, and lie too far from it to link with
   those that do, go on with the next pivot; so do those with fewer own tokens than the pivot, linked or not, for the
   step below is exact for the others only. Buckets without such classes are done. A near miss can link to a class beside the pivot: of their differences from the pivot they must have one in common, so such
   pairs meet in a join on (pivot, difference), and counts of common differences give the exact intersection.
5. Links become components. Two classes linked with one pivot are in one component, whether they link themselves or not;
   that follows from the same differences, and is worked out where links are counted.

Everything is keyed by class (the token set's digest and a row number, never doc_id), and ids come in last. Rows are the
nodes: repeated ids with different texts are documents of their own, each with the least id that its own links reach.

Null and empty texts have no token and are alone; with fewer words than n the whole sequence is one token. Repeated
rows are one class. Null ids take part like others, but no component is named after one: a component of null ids alone
has a null component_id. Texts of any length count whole (batches are cut by bytes). Columns beside id and text are not
read, whatever their names. An empty table gives an empty result. Tokens are 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, column_bytes, components, cut, hash_spans, lowered, mix, word_spans

#: Share of the hash space that the sieve counts; classes that may hold a token before it counts as frequent.
SIEVE, FREQUENT = 0.25, 32
#: Mean number of prefix tokens that a subclass of frequent tokens is to hold.
SUBCLASS = 6
#: Classes of a pivot, and differences of theirs, that are compared with as many at once; values of them in one matrix.
BLOCK, SLAB = (512, 1 << 19), 4096
#: Pairs for each row, and pairs besides, up to which buckets are compared pair by pair.
OUTRIGHT = 4, 20_000


def shingle_arrays(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, sorted within it, and their n + 1 bounds."""
    starts, ends, before = word_spans(data, offsets)
    h = hash_spans(data, starts, ends)
    count = np.diff(before)
    grams = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(count)), grams)
    first = np.repeat(before[:-1], grams) + np.arange(len(owner)) - np.repeat(np.cumsum(grams) - grams, grams)
    x = np.full(len(owner), 0x9E3779B97F4A7C15, dtype=np.uint64)
    padded = np.concatenate([h, np.zeros(n, np.uint64)])
    limit = np.repeat(before[1:], grams)
    with np.errstate(over="ignore"):
        for k in range(n):
            inside = first + k < limit
            x = np.where(inside, mix(x * np.uint64(0x2545F4914F6CDD1D) + padded[first + k]), x)
    order = np.lexsort((x, owner))
    x, owner = x[order], owner  # owner is sorted already
    fresh = np.ones(len(x), bool)
    fresh[1:] = (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])
    bounds = np.searchsorted(owner[fresh], np.arange(len(count) + 1))
    return x[fresh].view(np.int64), bounds


def _digest(tokens: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def token_sets(rows: DataFrame, n: int, sieve: float | None) -> DataFrame:
    """(id, key, n, digest, tokens) of rows (t, id, key): tokens sorted as unsigned numbers; with a sieve only those below its share."""
    bound = np.uint64(int(sieve * 2**64) - 1) if sieve is not None and sieve < 1 else np.uint64(2**64 - 1)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in byte_slices(batch):
                data, offsets = column_bytes(part.column(0))
                tokens, bounds = shingle_arrays(lowered(data), offsets, n)
                sizes = np.diff(bounds)
                digests = [_digest(tokens[i:j]) for i, j in zip(bounds[:-1], bounds[1:])]
                keep = tokens.view(np.uint64) <= bound
                cum = np.concatenate([[0], np.cumsum(keep)])[bounds]
                lists = pa.ListArray.from_arrays(pa.array(cum.astype(np.int32)), pa.array(tokens[keep]))
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(sizes.astype(np.int64)), pa.array(digests, pa.binary()), lists], names=["id", "key", "n", "digest", "tokens"])

    return rows.select("t", "id", "key").mapInArrow(run, "id long, key long, n long, digest binary, tokens array<long>")


def row_key(id_col: str, text_col: str):
    """A hash of id and text, by which rows are found again; rows that share one by chance are told apart by their tokens."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def need(n, num: int, den: int):
    """ceil(threshold * n) as a column or number, threshold = num / den."""
    return F.floor((n * num + (den - 1)) / den) if not isinstance(n, int) else -(-n * num // den)


def signatures(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(sig, id, n, u) from (id, n, u, shared: array<struct<df, token>>) of the classes that may link."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            sig, owner = [], []
            ids = b.column(0).to_numpy()
            for k in range(b.num_rows):
                n, u = b.column(1)[k].as_py(), b.column(2)[k].as_py()
                s = b.column(3)[k].values
                df, tok = s.field("df").to_numpy(), s.field("token").to_numpy().view(np.uint64)
                places = n - (-(-n * num // den)) + 1 - u  # misses that must be forced from shared tokens
                if places <= 0:
                    continue
                often = df > FREQUENT
                order = np.lexsort((tok, often))
                tok, often = tok[order], often[order]
                rare = int((~often).sum())
                singles = tok[: min(rare, places)]
                low, high = -(-n * num // den), n * den // num
                left = places - len(singles)
                frequent = tok[rare:]
                for band in range(max(low, 1).bit_length(), max(high, 1).bit_length() + 1):
                    salt = np.uint64(band * 2 + 1)
                    with np.errstate(over="ignore"):
                        if band == max(low, 1).bit_length():
                            sig.append(mix(singles ^ np.uint64(0xA5A5A5A5)).view(np.int64))
                            owner.append(np.full(len(singles), k))
                        if left <= 0:
                            continue
                        groups = max(1, int(2 ** (band - 1) * 1.5 * (den - num) / den / SUBCLASS))
                        cls = (mix(frequent * np.uint64(0x9E3779B1) + salt) % np.uint64(groups)).astype(np.int64)
                        # each subclass costs one token more: the shortest prefix with enough forced misses
                        fresh = np.zeros(len(cls), bool)
                        fresh[np.unique(cls, return_index=True)[1]] = True
                        enough = np.flatnonzero(np.cumsum(~fresh) >= left)
                        take = int(enough[0]) + 1 if len(enough) else len(frequent)
                        for g in np.unique(cls[:take]):
                            members = frequent[:take][cls[:take] == g]
                            i, j = np.triu_indices(len(members), 1)
                            sig.append(mix(mix(members[i] + salt) * np.uint64(31) + members[j]).view(np.int64))
                            owner.append(np.full(len(i), k))
            sig, owner = np.concatenate(sig) if sig else np.zeros(0, np.int64), np.concatenate(owner) if owner else np.zeros(0, np.int64)
            owner = owner.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(ids[owner]), pa.array(b.column(1).to_numpy()[owner]), pa.array(b.column(2).to_numpy()[owner])], names=["sig", "id", "n", "u"])

    return rows.select("id", "n", "u", "shared").mapInArrow(run, "sig long, id long, n long, u long")


def links_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, num: int = 85, den: int = 100, most_rounds: int = 6) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(members, classes, links, linked): members (id, key, n, digest) of every row; classes (digest, n, rep, first), where
    first is the class's row with the least id, nulls last; links (a, b), a < b, between the reps of classes, which connect
    every component; linked (p, id, n, d, differ) the links of pivots. All other links are between two classes that are linked
    with one pivot: `within` counts those."""
    t = F.col("n") - need(F.col("n"), num, den)
    rows = docs.select(F.col(text_col).cast("string").alias("t"), F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("key"))
    sieved = cut(token_sets(rows, n, SIEVE).withColumn("row", F.monotonically_increasing_id()), "sieve")
    members = sieved.select("id", "key", "n", "digest")
    first = F.min(F.struct(F.col("id").isNull().alias("without"), "id", "key"))
    classes = cut(sieved.where("n > 0").groupBy("digest", "n").agg(F.min("row").alias("rep"), first.alias("first")), "classes")

    # 1. the sieve: a token whose rows are all of one class is that class's own
    kind = F.xxhash64("digest").alias("kind")
    held = sieved.select(kind, F.explode("tokens").alias("token")).groupBy("token").agg(F.min("kind").alias("kind"), F.max("kind").alias("other")).where("kind = other")
    own = cut(held.groupBy("kind").agg(F.count(F.lit(1)).alias("own")), "own")
    maybe = classes.select("digest", F.col("rep").alias("id"), F.col("first.key").alias("key"), "n", kind).join(own, "kind", "left").where(F.coalesce("own", F.lit(0)) <= t)
    maybe = cut(maybe.select("digest", "id", "key"), "maybe")

    # 2. exact counts over all tokens of what is left
    again = rows.join(maybe.select("key").distinct(), "key", "left_semi")
    full = token_sets(again, n, None).where("n > 0").select("digest", "n", "tokens").dropDuplicates(["digest"])
    full = cut(full.join(maybe.select("digest", "id"), "digest").select("id", "n", "tokens"), "full")
    counts = full.select("id", F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("id").alias("id"))
    counts = cut(counts, "counts")
    own = counts.where("df = 1").groupBy("id").agg(F.count(F.lit(1)).alias("u"))
    near = cut(full.join(own, "id", "left").withColumn("u", F.coalesce("u", F.lit(0))).where(F.col("u") <= t), "near")
    marked = near.select("id", F.explode("tokens").alias("token")).join(counts.where("df > 1").select("token", "df"), "token")
    shared = marked.groupBy("id").agg(F.collect_list(F.struct("df", "token")).alias("shared"))
    near = cut(near.select("id", "n", "u").join(shared, "id"), "shared")

    # 3. signatures of classes that share one with another
    sigs = signatures(near, num, den).distinct()
    sigs = cut(sigs, "signatures")
    active = sigs.withColumn("miss", F.lit(None).cast("long")).join(sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("sig"), "sig", "left_semi")

    # 4. pivots
    sets = near.select("id", "n", "u", F.transform("shared", lambda x: x["token"]).alias("tokens"))
    found, linked = [], []
    step = 0
    while True:
        active = cut(active, "active")
        # pairs of near misses of one pivot are settled; those with another row of their bucket are not
        far = F.count_if(F.col("miss").isNull())
        size = active.groupBy("sig").agg(F.count(F.lit(1)).alias("k"), far.alias("f")).agg(F.sum("k").alias("rows"), F.sum(F.col("f") * (F.col("f") - 1) / 2 + F.col("f") * (F.col("k") - F.col("f"))).alias("pairs")).first()
        if not size.rows:
            break
        if size.pairs <= OUTRIGHT[0] * size.rows + OUTRIGHT[1] or step >= most_rounds:  # small buckets of different texts are left
            a, b = active.alias("a"), active.alias("b")
            fit = F.expr(f"least(a.n, b.n) * {den} >= {num} * greatest(a.n, b.n) AND (a.n + b.n - a.u - b.u) * {num + den} >= 2 * {num} * (a.n + b.n)")
            pairs = a.join(b, F.expr("a.sig = b.sig AND a.id < b.id AND coalesce(a.miss <> b.miss, true)") & fit).select(F.col("a.id").alias("p"), F.col("b.id").alias("id")).distinct()
            found.append(cut(judge(cut(pairs, "pairs"), sets, num, den), "judged").where("linked").select(F.col("p").alias("a"), F.col("id").alias("b")))
            break
        step += 1
        order = F.struct(F.col("miss").isNotNull().alias("late"), "u", "id")
        pivots = cut(active.groupBy("sig").agg(F.min(order).alias("p")).select("sig", F.col("p.id").alias("p")), "pivots")
        active = cut(active.join(pivots, "sig").where("id <> p"), "active")
        judged = cut(judge(cut(active.select("p", "id").distinct(), "pairs"), sets, num, den), "judged")
        found.append(judged.where("linked").select(F.col("p").alias("a"), F.col("id").alias("b")))
        found.append(beside(judged, num, den))
        linked.append(judged.where("linked").select("p", "id", "n", (F.size("differ") + F.col("u")).alias("d"), "differ"))
        # a row with fewer own tokens than the pivot is a near miss of an earlier one: it stays, as `beside` leaves it out
        rest = active.join(judged.select("p", "id", "linked", "near", "p_u"), ["p", "id"]).where("NOT linked OR u < p_u")
        rest = cut(rest.select("sig", "id", "n", "u", F.coalesce("miss", F.when(F.col("near"), F.col("p"))).alias("miss")), "rest")
        open_ = rest.groupBy("sig").agg(F.count(F.lit(1)).alias("k"), far.alias("f"), F.min("miss").alias("x"), F.max("miss").alias("y")).where("k > 1 AND (f > 0 OR x <> y)")
        active = rest.join(open_.select("sig"), "sig", "left_semi")
    none = near.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    links = reduce(DataFrame.union, found, none).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pivoted = near.select(F.col("id").alias("p"), "id", "n", F.col("n").alias("d"), F.transform("shared", lambda x: x["token"]).alias("differ")).limit(0)
    return members, classes, cut(links, "links"), cut(reduce(DataFrame.union, linked, pivoted).dropDuplicates(["p", "id"]), "linked")


def judge(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(p, id, linked, near, p_n, n, u, differ): exact comparison of (p, id) pairs.

    near: within twice the allowed Jaccard distance; only then `differ` holds the shared tokens that one of the two lacks.
    """
    left = sets.select(F.col("id").alias("p"), F.col("n").alias("p_n"), F.col("u").alias("p_u"), F.col("tokens").alias("p_tokens"))
    both = pairs.join(sets, "id").join(left, "p")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            cols = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            n1, n2 = cols["p_n"].to_numpy(), cols["n"].to_numpy()
            linked, near, differ = [], [], []
            for k in range(b.num_rows):
                x, y = cols["p_tokens"][k].values.to_numpy(), cols["tokens"][k].values.to_numpy()
                common = len(np.intersect1d(x, y, assume_unique=True))
                union = int(n1[k] + n2[k]) - common
                linked.append(den * common >= num * union)
                near.append(den * common >= (2 * num - den) * union)
                differ.append(np.setxor1d(x, y, assume_unique=True) if near[-1] else None)
            yield pa.RecordBatch.from_arrays([cols["p"], cols["id"], pa.array(linked, pa.bool_()), pa.array(near, pa.bool_()), cols["p_n"], cols["n"], cols["p_u"], cols["u"], pa.array(differ, pa.list_(pa.int64()))], names=["p", "id", "linked", "near", "p_n", "n", "p_u", "u", "differ"])

    return both.select("p", "id", "p_n", "n", "p_u", "u", "p_tokens", "tokens").mapInArrow(run, "p long, id long, linked boolean, near boolean, p_n long, n long, p_u long, u long, differ array<long>")


def beside(judged: DataFrame, num: int, den: int) -> DataFrame:
    """Links between near misses and classes beside the same pivot, by their common differences from it.

    |A - B| + |B - A| = |dA| + |dB| - 2 |dA and dB| for the differences dA, dB from the pivot; own tokens are differences
    that nobody shares. A link needs that sum to be most * (n_a + n_b) at most, so B must have `common` of its d shared
    differences in common with A, where A is no nearer to the pivot than the nearest miss. Some common one is then among
    any d - common + 1 of them: B is indexed by so few, A by all. `common` is above 0 for every B that has no fewer own
    tokens than the pivot; others are left out as B, and their bucket must go on with them.
    """
    most = (den - num) / (den + num)
    rows = judged.where("near").select("p", "id", "n", F.size("differ").alias("d"), "u", "p_u", "linked", "differ")
    miss = cut(rows.where("NOT linked"), "misses")
    low = cut(miss.groupBy("p").agg(F.min(F.col("d") + F.col("u") - most * F.col("n")).alias("least")), "least")
    a = miss.select("p", F.col("id").alias("a"), F.explode("differ").alias("token"))
    common = F.greatest(F.ceil((F.col("d") + F.col("u") + F.col("least") - most * F.col("n")) / 2 - 1e-6), F.lit(1))
    b = rows.where("u >= p_u").join(low, "p").withColumn("common", common).where("common <= d")
    ordered = F.array_sort(F.transform("differ", lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("x"))))
    b = b.select("p", F.col("id").alias("b"), F.col("linked").alias("b_linked"), F.explode(F.slice(ordered, F.lit(1), F.col("d") - F.col("common").cast("int") + 1)).alias("o"))
    b = b.select("p", "b", "b_linked", F.col("o.x").alias("token"))
    met = cut(a.join(b, ["p", "token"]).where("a <> b AND (b_linked OR a < b)").select("p", "a", "b").distinct(), "met")
    side = lambda k: rows.select("p", F.col("id").alias(k), F.col("n").alias(f"{k}_n"), (F.col("d") + F.col("u")).alias(f"{k}_d"), F.col("differ").alias(f"{k}_x"))
    both = met.join(side("a"), ["p", "a"]).join(side("b"), ["p", "b"])
    apart = F.col("a_d") + F.col("b_d") - 2 * F.size(F.array_intersect("a_x", "b_x"))
    inter = (F.col("a_n") + F.col("b_n") - apart) / 2
    return both.where(den * inter >= num * (F.col("a_n") + F.col("b_n") - inter)).select("a", "b")


def shared_counts(x: list, y: list) -> np.ndarray:
    """How many values each array of x has in common with each of y; an array holds a value once. SLAB values at a time."""
    values, k = np.unique(np.concatenate([*x, *y, np.zeros(0, np.int64)]), return_inverse=True)
    ends = np.cumsum([len(v) for v in x] + [len(v) for v in y])
    row = np.searchsorted(ends, np.arange(len(k)), side="right")
    often = np.bincount(k, minlength=len(values)) > 1  # the others are shared by none
    k, row, left = (np.cumsum(often) - 1)[k][often[k]], row[often[k]], int(often.sum())
    out = np.zeros((len(x), len(y)), np.float32)
    for at in range(0, left, SLAB):
        here = (k >= at) & (k < at + SLAB)
        held = np.zeros((len(x) + len(y), min(SLAB, left - at)), np.float32)
        held[row[here], k[here] - at] = 1
        out += held[: len(x)] @ held[len(x) :].T
    return out.astype(np.int64)


def within(linked: DataFrame, num: int, den: int) -> DataFrame:
    """(rep, n): how many classes each class links with of those that are linked with a pivot that it is linked with, too.

    linked: (p, id, n, d, differ) of the links of pivots, d with own tokens. Links follow from differences as in `beside`. Two classes
    are compared at each pivot of both and counted at the first. A pivot's classes are dealt into blocks, and two blocks meet at a
    time, however large the group: work is the square of a group of near copies, pairs are neither shuffled nor stored.
    """
    of = linked.groupBy("id").agg(F.sort_array(F.collect_set("p")).alias("pivots"))
    need_cells = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK[0], F.sum(F.size("differ")) / BLOCK[1])).cast("int")
    groups = linked.groupBy("p").agg(F.count(F.lit(1)).alias("k"), F.greatest(need_cells, F.lit(1)).alias("blocks")).where("k > 1")
    rows = linked.join(groups.select("p", "blocks"), "p").join(of, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    rows = rows.withColumn("meet", F.explode(meets)).select("p", "meet.i", "meet.j", "block", "id", "n", "d", "differ", "pivots")

    def count(held):
        (p, i, j), sides = held[0][:3], ([], [])
        for r in held:
            sides[0 if r[3] == i else 1].append(r)
        x, y = sides[0], sides[0] if i == j else sides[1]
        earlier = [[r[8][r[8] < p] for r in side] for side in (x, y)]
        fine = shared_counts(*earlier) == 0
        if i == j:
            np.fill_diagonal(fine, False)
        if not fine.any():
            return [], []
        total, apart = (np.add.outer([r[c] for r in x], [r[c] for r in y]) for c in (5, 6))
        twice = total - apart + 2 * shared_counts([r[7] for r in x], [r[7] for r in y])  # twice the intersection
        fine &= den * twice >= num * (2 * total - twice)
        ids, n = [r[4] for r in x], fine.sum(axis=1).tolist()
        return (ids, n) if i == j else (ids + [r[4] for r in y], n + fine.sum(axis=0).tolist())

    def run(batches):
        import pyarrow as pa

        held = []
        for b in batches:
            plain = [b.column(c).to_pylist() for c in range(7)]
            for k, r in enumerate(zip(*plain)):
                if held and held[0][:3] != r[:3]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in count(held)], names=["rep", "n"])
                    held = []
                held.append((*r, b.column(7)[k].values.to_numpy(), b.column(8)[k].values.to_numpy()))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in count(held)], names=["rep", "n"])

    met = rows.repartition("p", "i", "j").sortWithinPartitions("p", "i", "j").mapInArrow(run, "rep long, n long")
    return met.groupBy("rep").agg(F.sum("n").alias("n"))


def grouped(docs: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int, every: bool = True) -> tuple[DataFrame, DataFrame]:
    """(members, classes): classes (digest, first, n_links), where first is the first row of the class's whole component."""
    members, classes, links, linked = links_of(docs, id_col, text_col, n, num, den)
    ends = links.select(F.col("a").alias("rep")).union(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    if every:
        of = linked.groupBy("id").agg(F.collect_set("p").alias("pivots"))
        side = lambda k: of.select(F.col("id").alias(k), F.col("pivots").alias(f"{k}_of"))
        # those of one pivot are among the ones that `within` counts
        alone = links.join(side("a"), "a", "left").join(side("b"), "b", "left").where("NOT coalesce(arrays_overlap(a_of, b_of), false)")
        met = alone.select(F.explode(F.array("a", "b")).alias("rep"), F.lit(1).cast("long").alias("n")).union(within(linked, num, den))
        ends = met.groupBy("rep").agg(F.sum("n").alias("n_links"))
    linked = cut(components(links).withColumnRenamed("node", "rep").join(ends, "rep").join(classes.select("rep", "first"), "rep"), "linked")
    heads = linked.groupBy("component").agg(F.min("first").alias("head"))
    found = linked.join(heads, "component").select("rep", "head", "n_links")
    # few classes have links: the others meet nothing
    out = classes.join(found, "rep", "left").select("digest", F.coalesce("head", "first").alias("first"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return members, cut(out, "components")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row.

    n_links counts the other classes (distinct token sets) that the row's class links with; copies of one set count once.
    """
    members, classes = grouped(docs, id_col, text_col, n, num, den)
    # rows of a hot class meet one small row
    out = members.where("n > 0").join(classes, "digest").select("id", "n", F.col("first.id").alias("component_id"), "n_links")
    out = out.union(members.where("n = 0").select("id", "n", F.col("id").alias("component_id"), F.lit(0).cast("long")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "n_links")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without near copies, columns unchanged: of each component the row with the least id stays, nulls last.

    Rows without words are in no component and stay. Of rows that are equal in id and text one stays.
    """
    members, classes = grouped(docs, id_col, text_col, n, num, den, every=False)
    judged = members.where("n > 0").join(classes, "digest").select("key", (F.col("key") != F.col("first.key")).alias("copy"))
    keys = cut(judged.groupBy("key").agg(F.bool_and("copy").alias("copy"), F.count(F.lit(1)).alias("rows")), "keys")
    key = row_key(id_col, text_col)
    copies = keys.where("copy").select(F.col("key").alias("copy_key"))
    out = docs.join(copies, key == copies["copy_key"], "left_anti")
    again = cut(keys.where("NOT copy AND rows > 1").select(F.col("key").alias("again_key")), "again")
    if again.isEmpty():
        return out.select(*docs.columns)
    once = out.join(again, key == again["again_key"], "left_anti").select(*docs.columns)
    return once.unionByName(out.join(again, key == again["again_key"], "left_semi").select(*docs.columns).dropDuplicates([id_col, text_col]))
