"""Quality classifier from weak labels.

Several overlapping heuristic labellers vote good (1), bad (-1) or abstain (0) on each text. Expectation-maximisation
over the counts of all vote patterns estimates each labeller's accuracy and the share of good texts; the posterior of its
pattern is each text's soft label. A linear scorer over hashed features is then trained on the posteriors of a bounded
sample of rows, and scores every row.

Features are word shapes (runs of letters, capitals, digits and each mark), shape pairs, and bins of text statistics,
hashed to a fixed number of slots; the whole text counts, of any length (batches are cut by bytes). Null and empty texts
have no words: they score 0. Repeated rows score alike, and train the scorer once. Null and repeated ids are rows like
others. Kept columns travel inside a struct, so that none clashes with the score. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, column_bytes, cut, hash_spans, lowered, mix, word_spans

SLOTS = 512
#: Distinct rows whose posteriors and features train the scorer: a bounded sample, those with the smallest hashes.
TRAIN_ROWS = 4000
#: Labellers, in the order of their votes.
LABELLERS = ("marks", "letters", "pipes", "unbroken", "shouting", "exclaiming", "repeats", "variety", "prose", "sentences")

_letter = np.zeros(256, bool)
_letter[65:91] = _letter[97:123] = True
_letter[128:] = True
_mark = ~_letter
_mark[48:58] = _mark[32] = False
_mark[9:14] = False
_plain, _stop = np.zeros(256, bool), np.zeros(256, bool)
_plain[list(b".,;:!?'\"()-")] = True
_stop[list(b".!?")] = True
_class = np.arange(256, dtype=np.uint8)  # each mark stands for itself
_class[97:123] = _class[128:] = 97
_class[65:91] = 65
_class[48:58] = 48
_class[9:14] = 32
_ascii_letter = _letter & (np.arange(256) < 128)


def describe(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics (texts x 9), hashed features (texts x SLOTS), and word counts of a batch of texts."""
    starts, ends, before = word_spans(data, offsets)
    n = np.diff(before)
    many = np.maximum(n, 1)
    owner = np.repeat(np.arange(len(n)), n)
    h = hash_spans(lowered(data), starts, ends)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    # distinct words of each text: sort by text and 40 bits of the hash
    key = np.sort((owner.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    distinct = np.bincount((key[fresh] >> np.uint64(40)).astype(np.int64), minlength=len(n))
    repeats = np.bincount(owner[again], minlength=len(n))
    # how often each byte occurs in each text
    seen = np.stack([np.bincount(data[i:j], minlength=256) for i, j in zip(offsets[:-1], offsets[1:])])
    solid = np.maximum(seen.sum(axis=1) - seen[:, 9:14].sum(axis=1) - seen[:, 32], 1)
    letters = seen @ _letter
    stats = np.stack([
        seen @ (_mark & ~_plain) / many, seen[:, 124] / many, seen[:, 65:91].sum(axis=1) / np.maximum(seen @ _ascii_letter, 1),
        repeats / many, distinct / many ** 0.75, letters / solid, solid / many, seen @ _stop / many, seen[:, 33] / many,
    ], axis=1).astype(np.float64)

    # shapes: the classes of a word's bytes without repeats
    cls = _class[data]
    first = np.ones(len(data), bool)
    first[1:] = cls[1:] != cls[:-1]
    if len(starts):
        first[starts] = True
    first &= cls != 32
    kept = np.flatnonzero(first)
    shape_at = np.searchsorted(kept, starts)
    shape_end = np.append(shape_at[1:], len(kept)) if len(starts) else shape_at
    shape = hash_spans(cls[kept], shape_at, shape_end)
    slot = (shape % np.uint64(SLOTS // 2)).astype(np.int64)
    with np.errstate(over="ignore"):
        pair = mix(shape[1:] * np.uint64(31) + shape[:-1]) % np.uint64(SLOTS // 4)
    same = owner[1:] == owner[:-1]
    x = np.bincount(owner * SLOTS + slot, minlength=len(n) * SLOTS).astype(np.float64)
    x += np.bincount((owner[1:] * SLOTS + SLOTS // 2 + pair.astype(np.int64))[same], minlength=len(n) * SLOTS)
    x = x.reshape(len(n), SLOTS) / many[:, None]
    for j in range(stats.shape[1]):
        place = np.minimum((stats[:, j] * 12).astype(np.int64), 13)
        x[np.arange(len(n)), SLOTS // 4 * 3 + (place * 9 + j)] += 1.0
    x[n == 0] = 0
    return stats, x, n


def votes(stats: np.ndarray, n: np.ndarray) -> np.ndarray:
    """-1 (bad), 0 (abstains) or 1 (good) of each labeller; every labeller abstains on a text without words."""
    odd, pipes, capitals, again, variety, letters, length, stops, calls = stats.T
    long = n >= 8
    bad = [
        odd > 0.3, letters < 0.85, pipes > 0.15, long & (stops < 0.01), long & (capitals > 0.4), long & (calls > 0.2), long & (again > 0.15), (n >= 30) & (variety < 0.6),
    ]
    clean = (odd < 0.1) & (pipes < 0.05) & (again < 0.1) & (calls < 0.1) & ((capitals < 0.35) | ~long)
    good = [clean & (letters > 0.85) & ((variety > 0.7) | (n < 30)), clean & (stops > 0.02) & (stops < 0.5) & (length < 12)]
    out = np.stack([*(np.where(x, -1, 0) for x in bad), *(np.where(x, 1, 0) for x in good)], axis=1)
    out[n == 0] = 0
    return out.astype(np.int8)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of good texts, each labeller's accuracy where it votes, and the posterior of each pattern.

    Labellers are taken as independent given the class, right with a probability of their own where they vote, and as
    likely to abstain on either class. Accuracies stay within 0.55 and 0.995: a labeller is better than chance.
    """
    share, accuracy = 0.8, np.full(patterns.shape[1], 0.85)
    post = np.full(len(patterns), share)
    for _ in range(rounds):
        weight = np.log(accuracy / (1 - accuracy))
        new = 1 / (1 + np.exp(-np.clip(np.log(share / (1 - share)) + patterns @ weight, -50, 50)))
        done = np.abs(new - post).max() < 1e-6
        post = new
        if done:
            break
        share = float(np.clip((post * counts).sum() / counts.sum(), 0.05, 0.95))
        for j in range(patterns.shape[1]):
            up, down = patterns[:, j] > 0, patterns[:, j] < 0
            right = (post * counts)[up].sum() + ((1 - post) * counts)[down].sum()
            accuracy[j] = np.clip((right + 8.5) / (counts[up | down].sum() + 10), 0.55, 0.995)
    return share, accuracy, post


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 300, rate: float = 1.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic scorer on soft labels, by full-batch gradient steps with momentum."""
    w, b = np.zeros(x.shape[1]), 0.0
    vw, vb = np.zeros_like(w), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = (p - y) * weight
        vw, vb = 0.9 * vw - rate * (x.T @ g + decay * w), 0.9 * vb - rate * g.sum()
        w, b = w + vw, b + vb
    return w, b


class Scorer:
    """A trained classifier: what each labeller is worth, and the linear weights."""

    def __init__(self, weights: np.ndarray, offset: float, share: float, accuracies: np.ndarray):
        self.weights, self.offset, self.share, self.accuracies = weights, offset, share, accuracies

    def rows(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """(row, score): every row of docs as a struct, and its score in 0..1; no shuffle."""
        w, b = self.weights, self.offset

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for part in byte_slices(batch):
                    _, x, n = describe(*column_bytes(part.column(0)))
                    s = np.where(n > 0, 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))), 0.0)
                    yield pa.RecordBatch.from_arrays([part.column(1), pa.array(s)], names=["row", "score"])

        rows = docs.select(F.col(text_col).cast("string").alias("t"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
        return rows.mapInArrow(run, rows.select("row", F.lit(0.0).alias("score")).schema)


def vote_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h, pattern) of every row: a hash of its id and text, and its votes as one string of 0, 1, 2."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in byte_slices(batch):
                stats, _, n = describe(*column_bytes(part.column(0)))
                v = (votes(stats, n) + 49).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([r.tobytes().decode() for r in v], pa.string())], names=["h", "pattern"])

    return _hashed(docs, id_col, text_col).mapInArrow(run, "h long, pattern string")


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(text_col).cast("string").alias("t"), F.xxhash64(id_col, text_col).alias("h"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Scorer:
    """Vote patterns of all rows (3 ** labellers at most reach the driver as counts), then the scorer on `rows` rows."""
    voted = cut(vote_rows(docs, id_col, text_col), "votes")
    found = voted.groupBy("pattern").count().orderBy("pattern").collect()
    if not found:
        return Scorer(np.zeros(SLOTS), 0.0, 0.5, np.full(len(LABELLERS), 0.5))
    patterns = np.array([[int(c) - 1 for c in r.pattern] for r in found])
    counts = np.array([r["count"] for r in found], dtype=np.float64)
    share, accuracies, post = expectation_maximisation(patterns, counts)
    posterior = {r.pattern: p for r, p in zip(found, post)}
    # the sample: the distinct rows with the smallest hashes; their bound is the `rows`-th hash
    low = voted.select("h").distinct().orderBy("h").limit(rows).agg(F.max("h")).first()[0]

    def features(batches):
        import pyarrow as pa

        for batch in batches:
            for part in byte_slices(batch):
                stats, x, n = describe(*column_bytes(part.column(0)))
                v = (votes(stats, n) + 49).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([r.tobytes().decode() for r in v], pa.string()), pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary())], names=["h", "pattern", "x"])

    picked = _hashed(docs, id_col, text_col).where(F.col("h") <= low).mapInArrow(features, "h long, pattern string, x binary").dropDuplicates(["h"]).collect()
    picked.sort(key=lambda r: r.h)
    x = np.stack([np.frombuffer(r.x, dtype=np.float32) for r in picked]).astype(np.float64)
    y = np.array([posterior.get(r.pattern, share) for r in picked])
    w, b = train(x, y, np.full(len(y), 1 / len(y)))
    return Scorer(w, b, share, accuracies)


def classify(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on docs and score them: id, score, good (score >= threshold)."""
    scored = fit(docs, id_col, text_col).rows(docs.select(id_col, text_col), text_col)
    return scored.select(F.col("row")[id_col].alias(id_col), "score", (F.col("score") >= threshold).alias("good"))


def good_rows(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that score `threshold` or more, columns unchanged."""
    return fit(docs, id_col, text_col).rows(docs, text_col).where(F.col("score") >= threshold).select("row.*")
