"""Phrase collocation mining by multikey three-way quicksort of suffix pointers.

A text is lower-cased (A-Z), split into pieces at marks and line ends, and those into words at blanks. A suffix is a place
of a word in its piece; its keys are its first three words. Suffix pointers are sorted by multikey quicksort: a partition
is split three ways around a pivot word, the part that equals the pivot goes on at the next word, down to the third. The
size of an equal part is the count of its phrase, and parts with less than `least` occurrences are abandoned. All
partitions of a level are split in one numpy pass.

Five scans of the texts, none of which moves a text:
1. every task counts its pairs of adjacent words in cells of a hash table of fixed size, and ships its cells; the cells
   that reach `least` over all tasks are a bit map of 2^26 bits, which is broadcast (its size never grows). A pair whose
   cell falls short cannot be a phrase; a full map only lets more pairs pass.
2. the same for three words whose two pairs pass.
3. tasks sort the pointers of the pairs that pass, which counts equal suffixes where they lie, and route what they have by
   buckets of the two leading words, so that a frequent leading word is dealt out by its followers, and a frequent pair
   is one entry of each task's run at most. A run's suffixes of one bucket travel as one row of packed columns, sorted.
   Where they arrive, the same sort adds the counts up, one bucket at a time; the number of buckets grows with the pairs.
4. words of the phrases found are counted by hash and routed by buckets in packed columns, as suffixes are.
5. the phrases that can be among the best, by score and count, with all that equal the last of them, are known then. The texts
   of their words alone are sent, and the counts of all words of each language.

Words are 64-bit hashes of language and text up to the last step. Words of the phrases found are counted with a second hash; if
two different words share the first one, the whole is done again with another seed, and so it is where the texts of the last
step differ. Scores are integers in decimal(38).

Null text is empty; null lang is `und`. Empty texts have no words; repeated rows count each time. Only the language and the
text are read, whatever the other columns. Texts of any length are cut by words, one at a time where they are long. Ties in
score go by count, then by the phrase's bytes; equal cuts to the first. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, byte_slices, column_bytes, cut, hash_spans, lowered, mix

#: Bits of the maps of pairs and words, bits of a block of cells, pointers that a task sorts at once, pairs of a bucket, words
#: that a task holds at once.
BITS, BLOCK_BITS, RUN, BUCKET_PAIRS, HELD = 26, 16, 1 << 20, 1 << 18, 1 << 19
DEPTH = 3
CELLS = "block int, cells binary, counts binary"
SUFFIXES, PACKED, COUNTED = "a long, b long, c long, n long", "bucket int, a binary, b binary, c binary, n binary", "bucket int, lang string, h binary, other binary, n binary"

_blank, _end = np.zeros(256, bool), np.zeros(256, bool)
_blank[[32, 9]] = True
_end[list(b".,;:!?\n\x0b\x0c\r")] = True
_word = ~(_blank | _end)
#: Bytes in another order: the second hash of a word is the first hash of other bytes.
_other = np.random.default_rng(11).permutation(256).astype(np.uint8)


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every word, and whether the next word follows it in the same piece of the same text."""
    solid = _word[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = solid[1:] != solid[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    keep = solid[at[:-1]]
    starts, ends = at[:-1][keep], at[1:][keep]
    pieces = np.cumsum(_end[data])
    owner = np.searchsorted(offsets, starts, side="right") - 1
    follows = np.zeros(len(starts), bool)
    follows[:-1] = (owner[1:] == owner[:-1]) & (pieces[starts[1:]] == pieces[starts[:-1]])
    return starts, ends, owner, follows


class Words:
    """The words of a slice of rows (lang, text), hashed with their language."""

    def __init__(self, part, seed: int):
        langs = part.column(0).dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        self.data, offsets = column_bytes(part.column(1))
        self.data = lowered(self.data)
        if len(self.data):
            self.starts, self.ends, owner, self.follows = split_words(self.data, offsets)
        else:
            self.starts, self.ends, owner, self.follows = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
        self.lang = langs.indices.to_numpy(zero_copy_only=False)[owner]
        salts = np.array([lang_hash(x, seed) for x in self.langs], np.uint64)
        self.hash = np.zeros(0, np.uint64)
        if len(self.starts):
            with np.errstate(over="ignore"):
                self.hash = np.maximum(mix(hash_spans(self.data, self.starts, self.ends) + salts[self.lang]), np.uint64(1))  # 0: no word

    def joined(self, h: np.ndarray) -> np.ndarray:
        """A hash of each word and what h says of the next (meant only where there is one)."""
        with np.errstate(over="ignore"):
            return mix(self.hash * np.uint64(0x9E3779B97F4A7C15) + np.append(h[1:], np.uint64(1))[: len(h)])

    def pairs(self, bits: np.ndarray) -> np.ndarray:
        """Whether each word begins a pair that passes."""
        return self.follows & is_set(bits, cell(self.joined(self.hash)))

    def threes(self, pairs: np.ndarray, bits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Words that begin two pairs that pass, and the cells of their three words; with bits, only those that pass."""
        at = np.flatnonzero(pairs[:-1] & pairs[1:])
        cells = cell(self.joined(self.joined(self.hash)))[at]
        fine = slice(None) if bits is None else is_set(bits, cells)
        return at[fine], cells[fine]


def lang_hash(lang: str, seed: int) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")


def cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.uint32)


def is_set(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bits[cells >> np.uint32(3)] >> (cells & np.uint32(7)).astype(np.uint8)) & np.uint8(1) > 0


def slices(batches, seed: int):
    for batch in batches:
        for part in byte_slices(batch, 1):
            yield Words(part, seed)


def cell_rows(cells: np.ndarray, counts: np.ndarray):
    """CELLS rows of sorted distinct cells: a row for each block of cells, counts capped at 255."""
    import pyarrow as pa

    block = (cells >> np.uint32(BLOCK_BITS)).astype(np.int32)
    at = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
    ends = np.append(at[1:], len(block))
    low, n = (cells & np.uint32(2**BLOCK_BITS - 1)).astype(np.uint16), np.minimum(counts, 255).astype(np.uint8)
    pick = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(at, ends)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(block[at]), pick(low), pick(n)], names=["block", "cells", "counts"])


def bit_map(counted: DataFrame, least: int) -> tuple[np.ndarray, int]:
    """Bits of the cells whose counts in CELLS rows reach `least` (at most 255): 2^26 bits, whatever the input; and the sum
    of their counts."""

    def run(batches):
        import pyarrow as pa

        last, total, least_n = None, np.zeros(2**BLOCK_BITS, np.int64), min(least, 255)
        out = lambda: pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([np.packbits(total >= least_n, bitorder="little").tobytes()], pa.binary()), pa.array([int(total[total >= least_n].sum())])], names=["block", "bits", "n"])
        for b in batches:
            for block, cells, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if block != last and last is not None:
                    yield out()
                    total[:] = 0
                last = block
                total[np.frombuffer(cells.as_buffer(), np.uint16)] += np.frombuffer(n.as_buffer(), np.uint8)
        if last is not None:
            yield out()

    bits, n = np.zeros(2 ** (BITS - 3), np.uint8), 0
    size = 2 ** (BLOCK_BITS - 3)
    for r in counted.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block int, bits binary, n long").collect():
        bits[r.block * size : (r.block + 1) * size] = np.frombuffer(r.bits, np.uint8)
        n += r.n
    return bits, n


def prefix_counts(keys: np.ndarray, weight: np.ndarray, least: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """Multikey three-way quicksort of pointers into keys (DEPTH x n): for each depth, (a pointer, the count) of every prefix
    of that many words whose weights add up to `least` or more."""
    found: list[list] = [[(np.zeros(0, np.int64),) * 2] for _ in range(DEPTH)]
    ptr = np.arange(keys.shape[1])
    size, level = np.array([len(ptr)]), np.zeros(1, np.int64)
    while len(ptr):
        start = np.cumsum(size) - size
        segment = np.repeat(np.arange(len(size)), size)
        k = keys[level[segment], ptr]
        a, b, c = k[start], k[start + size // 2], k[start + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[segment]
        kinds = (k < pivot, k == pivot, k > pivot)
        sizes = np.stack([np.bincount(segment[kind], minlength=len(size)) for kind in kinds], axis=1).ravel()
        first = np.cumsum(sizes) - sizes
        moved = np.empty_like(ptr)
        for j, kind in enumerate(kinds):  # each pointer's place in its part: a running count, in the order that they had
            mine = np.flatnonzero(kind)
            before = np.cumsum(sizes[j::3]) - sizes[j::3]
            moved[(first[j::3] - before)[segment[mine]] + np.arange(len(mine))] = ptr[mine]
        level = np.repeat(level, 3)
        level[1::3] += 1
        heavy = np.flatnonzero(sizes > 0)
        heavy = heavy[(total := np.add.reduceat(weight[moved], first[heavy])) >= least]
        total = total[total >= least]
        one, at = moved[first[heavy]], level[heavy]
        for d in range(DEPTH):
            # an equal part is a prefix; a part of one pointer is all its longer prefixes too
            hit = (heavy % 3 == 1) & (at == d + 1) | (sizes[heavy] == 1) & (at <= d)
            found[d].append((one[hit], total[hit]))
        stay = np.zeros(len(sizes), bool)
        stay[heavy[(at < DEPTH) & (sizes[heavy] > 1)]] = True
        ptr, size, level = moved[np.repeat(stay, sizes)], sizes[stay], level[stay]
    return [tuple(np.concatenate(x) for x in zip(*f)) for f in found]


def suffix_batch(keys: np.ndarray, n: np.ndarray):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([*(pa.array(k.view(np.int64)) for k in keys), pa.array(n)], names=["a", "b", "c", "n"])


def cell_counts(seed: int, bits=None):
    """Task of the first two scans: pairs, or with the bits of pairs three words, counted by cell."""

    def run(batches):
        held, n = [], 0
        for w in slices(batches, seed):
            held.append(cell(w.joined(w.hash))[w.follows] if bits is None else w.threes(w.pairs(bits.value), None)[1])
            n += len(held[-1])
            if n >= 4 * RUN:
                yield cell_rows(*np.unique(np.concatenate(held), return_counts=True))
                held, n = [], 0
        if n:
            yield cell_rows(*np.unique(np.concatenate(held), return_counts=True))

    return run


def suffixes(seed: int, bits, bits_of_threes, buckets: int):
    """Task of the third scan: equal suffixes of the pairs that pass, counted and packed by bucket; c is 0 where the three
    words do not pass."""

    def run(batches):
        import pyarrow as pa

        held, n = [], 0

        def packed():
            keys = np.concatenate(held, axis=1)
            at, count = prefix_counts(keys, np.ones(keys.shape[1], np.int64))[DEPTH - 1]
            keys = keys[:, at]
            with np.errstate(over="ignore"):
                bucket = (mix(keys[0] * np.uint64(0x9E3779B97F4A7C15) + keys[1]) % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((keys[0], bucket))
            bucket, columns = bucket[order], [*(k[order] for k in keys), count[order].astype(np.uint32)]
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            ends = np.append(first[1:], len(bucket))
            pack = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(first, ends)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(bucket[first]), *map(pack, columns)], names=["bucket", "a", "b", "c", "n"])

        for w in slices(batches, seed):
            fine = w.pairs(bits.value)
            third = np.zeros(len(fine), np.uint64)
            longer = w.threes(fine, bits_of_threes.value)[0]
            third[longer] = w.hash[longer + 2]
            at = np.flatnonzero(fine)
            held.append(np.stack([w.hash[at], w.hash[at + 1], third[at]]))
            n += len(at)
            if n >= RUN:
                yield packed()
                held, n = [], 0
        if n:
            yield packed()

    return run


def added_up(least: int):
    """Task behind the routing, a bucket at a time: prefixes of two and three words that are frequent."""

    def frequent(held):
        keys = np.stack([np.frombuffer(b"".join(r[k] for r in held), np.uint64) for k in range(DEPTH)])
        out = prefix_counts(keys, np.frombuffer(b"".join(r[DEPTH] for r in held), np.uint32).astype(np.int64), least)
        pairs, threes = keys[:, out[1][0]], keys[:, out[2][0]]
        pairs[2] = 0
        real = threes[2] != 0
        return suffix_batch(np.concatenate([pairs, threes[:, real]], axis=1), np.concatenate([out[1][1], out[2][1][real]]))

    def run(batches):
        last, held = None, []
        for b in batches:
            for bucket, *columns in zip(*(c.to_pylist() for c in b.columns)):
                if bucket != last and held:
                    yield frequent(held)
                    held = []
                last = bucket
                held.append(columns)
        if held:
            yield frequent(held)

    return run


def word_cells(batches):
    for b in batches:
        h = np.unique(np.concatenate([c.to_numpy() for c in b.columns]))
        cells = np.unique(cell(h[h != 0].view(np.uint64)))
        yield cell_rows(cells, np.full(len(cells), 255))


def same_spans(w: Words, at: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether the words `at` are those of `other`, byte by byte and in language; SLICE_BYTES are compared at once."""
    n = w.ends[at] - w.starts[at]
    same = (n == w.ends[other] - w.starts[other]) & (w.lang[at] == w.lang[other]) & (at != other)
    check, same = np.flatnonzero(same), same | (at == other)
    total, k = np.cumsum(n[check]), 0
    while k < len(check):
        to = max(k + 1, int(np.searchsorted(total, total[k] - n[check[k]] + SLICE_BYTES, side="right")))
        rows = check[k:to]
        first = np.cumsum(n[rows]) - n[rows]
        place = np.arange(int(n[rows].sum())) - np.repeat(first, n[rows])
        equal = w.data[place + np.repeat(w.starts[at[rows]], n[rows])] == w.data[place + np.repeat(w.starts[other[rows]], n[rows])]
        same[rows] = np.logical_and.reduceat(equal, first)
        k = to
    return same


def word_counts(seed: int, bits, buckets: int):
    """Task of the fourth scan: words whose bit is set, counted by both hashes and packed by language and bucket."""

    def run(batches):
        import pyarrow as pa

        held, n, langs = [], 0, {}

        def packed():
            h, other, lang, count = (np.concatenate(x) for x in zip(*held))
            bucket = (h % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((other, h, lang, bucket))
            h, other, lang, count, bucket = (x[order] for x in (h, other, lang, count, bucket))
            group = np.append(True, (bucket[1:] != bucket[:-1]) | (lang[1:] != lang[:-1]))
            new = np.flatnonzero(group | np.append(True, (h[1:] != h[:-1]) | (other[1:] != other[:-1])))
            columns = [h[new], other[new], np.add.reduceat(count, new)]
            first = np.flatnonzero(group[new])
            ends = np.append(first[1:], len(new))
            pack = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(first, ends)], pa.binary())
            names = pa.array(list(langs), pa.string()).take(pa.array(lang[new][first]))
            return pa.RecordBatch.from_arrays([pa.array(bucket[new][first]), names, *map(pack, columns)], names=["bucket", "lang", "h", "other", "n"])

        for w in slices(batches, seed):
            seen = np.flatnonzero(is_set(bits.value, cell(w.hash)))
            if not len(seen):
                continue
            _, one, group = np.unique(w.hash[seen], return_index=True, return_inverse=True)
            same = same_spans(w, seen, seen[one][group])
            at = np.concatenate([seen[one], seen[~same]])
            count = np.append(np.bincount(group[same], minlength=len(one)), np.ones(int((~same).sum()), np.int64))
            own = np.array([langs.setdefault(x, len(langs)) for x in w.langs], np.int64)
            held.append((w.hash[at], hash_spans(_other[w.data], w.starts[at], w.ends[at]), own[w.lang[at]], count))
            n += len(at)
            if n >= RUN:
                yield packed()
                held, n = [], 0
        if n:
            yield packed()

    return run


def words_added(batches):
    """Task behind the routing, a bucket at a time: (h, lang, n) of its words, and whether another word has the hash."""
    import pyarrow as pa

    def summed(held):
        langs = {}
        h, other, n = (np.frombuffer(b"".join(r[k] for r in held), kind) for k, kind in ((1, np.uint64), (2, np.uint64), (3, np.int64)))
        lang = np.repeat([langs.setdefault(r[0], len(langs)) for r in held], [len(r[1]) // 8 for r in held])
        order = np.lexsort((other, lang, h))
        h, other, lang, n = h[order], other[order], lang[order], n[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        last = np.append(first[1:], len(h)) - 1
        clash = (other[first] != other[last]) | (lang[first] != lang[last])
        names = pa.array(list(langs), pa.string()).take(pa.array(lang[first]))
        return pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), names, pa.array(np.add.reduceat(n, first)), pa.array(clash)], names=["h", "lang", "n", "clash"])

    last, held = None, []
    for b in batches:
        for bucket, *columns in zip(*(c.to_pylist() for c in b.columns)):
            if bucket != last and held:
                yield summed(held)
                held = []
            last = bucket
            held.append(columns)
    if held:
        yield summed(held)


def words_of(seed: int, bits):
    """Task of the last scan: (h, lang, word, n) of words whose bit is set, and (h, lang, null, n) of all words of a language.

    Counts are added up over a task's slices, up to HELD words at once. Words that share a hash are told apart by their bytes.
    """

    def run(batches):
        import pyarrow as pa

        def rows():
            h, langs, words = zip(*held)
            texts = [None if x is None else x.decode("utf-8", "replace") for x in words]
            return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(langs, pa.string()), pa.array(texts, pa.string()), pa.array(held.values(), pa.int64())], names=["h", "lang", "word", "n"])

        held: dict = {}
        for w in slices(batches, seed):
            seen = np.flatnonzero(is_set(bits.value, cell(w.hash)))
            _, one, group = np.unique(w.hash[seen], return_index=True, return_inverse=True)
            same = same_spans(w, seen, seen[one][group])
            count = np.bincount(group[same], minlength=len(one))
            at, n = np.concatenate([seen[one], seen[~same]]), np.concatenate([count, np.ones(int((~same).sum()), np.int64)])
            data = w.data.tobytes()
            for h, lang, i, j, k in zip(w.hash[at].view(np.int64).tolist(), w.lang[at].tolist(), w.starts[at].tolist(), w.ends[at].tolist(), n.tolist()):
                x = (h, w.langs[lang], data[i:j])
                held[x] = held.get(x, 0) + k
            for lang, k in zip(*(x.tolist() for x in np.unique(w.lang, return_counts=True))):
                x = (int(np.uint64(lang_hash(w.langs[lang], seed)).view(np.int64)), w.langs[lang], None)
                held[x] = held.get(x, 0) + k
            if len(held) >= HELD:
                yield rows()
                held.clear()
        if held:
            yield rows()

    return run


def routed(rows: DataFrame, task, kind: str, behind, out: str) -> DataFrame:
    """What tasks made of rows, by bucket, through the task behind."""
    return rows.mapInArrow(task, kind).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(behind, out)


def counted(rows: DataFrame, least: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(a, b, c, n): frequent phrases of rows (lang, text) as word hashes, c 0 for pairs; (h, lang, n, clash): their words."""
    sc = rows.sparkSession.sparkContext
    bits, n = bit_map(rows.mapInArrow(cell_counts(seed), CELLS), least)
    buckets = max(64, n // BUCKET_PAIRS)
    pairs = sc.broadcast(bits)
    threes = sc.broadcast(bit_map(rows.mapInArrow(cell_counts(seed, pairs), CELLS), least)[0])
    phrases = cut(routed(rows, suffixes(seed, pairs, threes, buckets), PACKED, added_up(least), SUFFIXES), "phrases")
    used = sc.broadcast(bit_map(phrases.select("a", "b", "c").mapInArrow(word_cells, CELLS), 1)[0])
    words = routed(rows, word_counts(seed, used, buckets), COUNTED, words_added, "h long, lang string, n long, clash boolean")
    return phrases, cut(words, "counts")


def best_hashes(phrases: DataFrame, words: DataFrame, most: int, inside: int) -> DataFrame:
    """lang, a, b, c, n, l, r, score: phrases as word hashes (c null for pairs), of which `most` of each language are the best:
    all that have the rank by score and count."""
    score = lambda a, l, r: F.expr(f"cast({a} as decimal(18,0)) * cast({a} as decimal(18,0)) * 1000000 div (cast({l} as decimal(18,0)) * cast({r} as decimal(18,0)))")  # noqa: E731, E741
    w = lambda k: words.select(F.col("h").alias(k), F.col("n").alias(f"n_{k}"), F.col("lang").alias(f"lang_{k}"))
    pairs = phrases.where("c = 0").select("a", "b", F.col("n").alias("n_ab")).join(w("a"), "a").join(w("b").drop("lang_b"), "b")
    pairs = cut(pairs, "pairs")
    threes = phrases.where("c <> 0").withColumnRenamed("n", "n_abc")
    ahead = pairs.select("a", "b", "n_ab", "n_a", "lang_a")
    behind = pairs.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("n_ab").alias("n_bc"), F.col("n_b").alias("n_c"))
    t = threes.join(ahead, ["a", "b"]).join(behind, ["b", "c"])
    t = t.withColumn("x", score("n_abc", "n_a", "n_bc")).withColumn("y", score("n_abc", "n_ab", "n_c"))
    early = F.col("x") <= F.col("y")
    t = t.select(F.col("lang_a").alias("lang"), "a", "b", "c", F.col("n_abc").alias("n"), F.when(early, F.col("n_a")).otherwise(F.col("n_ab")).alias("l"), F.when(early, F.col("n_bc")).otherwise(F.col("n_c")).alias("r"), F.least("x", "y").alias("score"))
    around = threes.select("a", "b", "n_abc").union(threes.select("b", "c", "n_abc")).groupBy("a", "b").agg(F.max("n_abc").alias("longer"))
    p = pairs.join(around, ["a", "b"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("n_ab")))
    p = p.select(F.col("lang_a").alias("lang"), "a", "b", F.lit(None).cast("long").alias("c"), F.col("n_ab").alias("n"), F.col("n_a").alias("l"), F.col("n_b").alias("r"), score("n_ab", "n_a", "n_b").alias("score"))
    # the best of each of 64 parts of a language, then of those
    best = p.union(t).withColumn("part", F.pmod(F.xxhash64("a", "b", "c"), F.lit(64)))
    for key in (["lang", "part"], ["lang"]):
        best = best.withColumn("rank", F.rank().over(Window.partitionBy(*key).orderBy(F.desc("score"), F.desc("n")))).where(F.col("rank") <= most)
    return best.drop("part", "rank")


def mine(docs: DataFrame, least: int = 10, most: int = 2000, inside: int = 50, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `most` best collocations of two and three words of each language.

    a, l, r: counts of the phrase and of its two parts at the cut that scores least; n: words of the language. A pair is
    dropped if a three-word phrase around it has `inside` percent of its count or more.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    seed = 0
    while True:
        phrases, counts = counted(rows, least, seed)
        if counts.where("clash").isEmpty():
            best = cut(best_hashes(phrases, counts, most, inside), "best")
            used = sc.broadcast(bit_map(best.select("a", "b", F.coalesce("c", F.lit(0))).mapInArrow(word_cells, CELLS), 1)[0])
            each = rows.mapInArrow(words_of(seed, used), "h long, lang string, word string, n long")
            words = each.groupBy("h").agg(F.sum("n").alias("n"), F.min(F.struct("lang", "word")).alias("w"), F.max(F.struct("lang", "word")).alias("other"))
            words = cut(words, "words")
            if words.where(~F.col("w").eqNullSafe(F.col("other"))).isEmpty():
                break
        seed += 1
    w = lambda k: words.where("w.word IS NOT NULL").select(F.col("h").alias(k), F.col("w.word").alias(f"w_{k}"))
    best = best.join(w("a"), "a").join(w("b"), "b").join(w("c"), "c", "left").withColumn("phrase", F.concat_ws(" ", "w_a", "w_b", "w_c"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = best.select("lang", "phrase", F.col("n").alias("a"), "l", "r", "score")
    # again in two steps: many may equal the last of the best
    best = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    for key in (["lang", "part"], ["lang"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= most)
    total = words.where("w.word IS NULL").select("w.lang", "n")
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
