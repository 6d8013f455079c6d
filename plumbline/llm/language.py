"""Language identification by hierarchical discrimination.

A linear support vector machine for each language family (one against the rest) names the family; inside it, a machine for
each pair of its languages votes (one versus one), and margins settle equal votes. Families of common languages are given
(`FAMILIES`); a language that is not listed is a family of its own.

Features are the bytes of words: runs of two to four letter bytes with the word's borders, and whole words, hashed to
`SLOTS` places, as shares of all features of the text. ASCII letters and bytes of 128 and more are letters, all others
part words; capitals of ASCII and Latin-1 count as small letters. Whole texts count, of any length: batches are cut by
bytes, and a text's features are summed over slices.

The machines are trained on a bounded sample: about `TRAIN_ROWS` distinct texts of each language, those with the smallest
hashes, and up to `PARTS` stretches of words from each, so that short texts are known too. Training is full-batch gradient
descent on the squared hinge loss, so that it does not depend on the order of rows.

Null texts and texts without a letter are `und`, score 0; so are all if nothing can be learned. A single learned language
is predicted for every text with letters. Rows to learn from with a null language or text are skipped. Repeated rows count
once in training and are predicted alike; null and repeated ids are rows like others. Kept columns travel inside a struct,
so that none clashes. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, column_bytes, hash_spans, mix

SLOTS, TRAIN_ROWS, PARTS, PART_WORDS = 1 << 14, 300, 6, 8
#: Bytes of a text that are worked on at once; longer texts are summed over such stretches.
STRETCH = 1 << 20

# Languages of each family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "turkic": "tr az kk ky uz tk tt",
    "uralic": "fi et hu",
    "indic": "hi mr ne bn pa gu ur",
    "semitic": "ar he mt am",
    "celtic": "ga cy gd br",
    "baltic": "lt lv",
}


def family(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang.lower().split("-")[0].split("_")[0] in members.split()), f"only {lang}")


_letter = np.zeros(256, bool)
_letter[65:91] = _letter[97:123] = _letter[128:] = True


def small(data: np.ndarray) -> np.ndarray:
    """A-Z and capital letters of Latin-1 (two bytes in UTF-8) in lower case."""
    out = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    if len(out) > 1:
        latin = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][latin] += 32
    return out


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of every feature of a batch of texts."""
    x = small(data)
    solid = _letter[x]
    edge = np.ones(len(x) + 1, bool)
    edge[1:-1] = solid[1:] != solid[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    keep = solid[at[:-1]]
    starts, ends = at[:-1][keep], at[1:][keep]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    # the words laid out with a blank before and after each
    n = ends - starts + 2
    first = np.cumsum(n) - n
    laid = np.full(int(n.sum()), 32, np.uint64)
    inner = np.repeat(first + 1, ends - starts) + np.arange(int((ends - starts).sum())) - np.repeat(np.cumsum(ends - starts) - (ends - starts), ends - starts)
    laid[inner] = x[np.flatnonzero(solid)]
    of = np.repeat(owner, n)
    left = np.repeat(first + n, n) - np.arange(len(laid))  # bytes to the end of the word's stretch
    texts, slots = [owner], [_slot(hash_spans(x, starts, ends), 5)]
    code = laid.copy()
    for k in (2, 3, 4):
        code = code[:-1] << np.uint64(8) | laid[k - 1 :]
        fine = left[: len(code)] >= k
        texts.append(of[: len(code)][fine])
        slots.append(_slot(code[fine], k))
    return np.concatenate(texts), np.concatenate(slots)


def _slot(code: np.ndarray, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(code * np.uint64(8) + np.uint64(kind)) >> np.uint64(50)).astype(np.int64)  # 14 bits


def stretches(part, column: int = 0):
    """(bytes, offsets, owner) of a slice of rows; a long text comes as several stretches that end at a non-letter."""
    data, offsets = column_bytes(part.column(column))
    cuts, owner = [0], []
    for i in range(len(offsets) - 1):
        at, end = int(offsets[i]), int(offsets[i + 1])
        while end - at > STRETCH:
            window = np.flatnonzero(~_letter[data[at + 1 : at + STRETCH]])
            at += int(window[-1]) + 1 if len(window) else STRETCH
            cuts.append(at)
            owner.append(i)
        cuts.append(end)
        owner.append(i)
    at = 0
    while at < len(owner):  # about STRETCH bytes at a time
        to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + STRETCH, side="right")) - 1)
        yield data[cuts[at] : cuts[to]], np.array(cuts[at : to + 1]) - cuts[at], np.array(owner[at:to])
        at = to


def train_machine(indptr: np.ndarray, slots: np.ndarray, share: np.ndarray, y: np.ndarray, rounds: int = 60, decay: float = 2e-6) -> np.ndarray:
    """Weights of SLOTS features and an offset: squared hinge loss, classes weighing alike, by accelerated gradient steps."""
    n = len(y)
    owner = np.repeat(np.arange(n), np.diff(indptr))
    cost = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    norm = np.bincount(owner, share * share, n) + 0.01
    step = 0.5 / (cost @ norm)  # the loss bends no more than this
    w, b = np.zeros(SLOTS), 0.0
    ow, ob = w, b
    for k in range(rounds):
        mw, mb = w + k / (k + 3) * (w - ow), b + k / (k + 3) * (b - ob)
        ow, ob = w, b
        short = np.maximum(0, 1 - y * (np.bincount(owner, mw[slots] * share, n) + 0.1 * mb))
        g = -2 * cost * y * short
        w = mw - step * (np.bincount(slots, g[owner] * share, SLOTS) + decay * mw)
        b = mb - step * 0.1 * g.sum()
    return np.append(w, 0.1 * b)


class Model:
    """Languages, their families, and the machines: one for each family (one for two families), one for each pair inside a family."""

    def __init__(self, langs: list[str], machines: dict):
        self.langs, self.machines = langs, machines
        self.families = sorted({family(x) for x in langs})

    def decide(self, sums: np.ndarray, total: np.ndarray) -> tuple[list, np.ndarray]:
        """Language and score of texts, from each machine's summed weights and the number of features."""
        margin = {k: sums[:, i] / np.maximum(total, 1) + self.machines[k][-1] for i, k in enumerate(self.machines)}
        sure = lambda m: 1 / (1 + np.exp(-np.clip(3 * m, -30, 30)))
        n = len(total)
        if len(self.families) > 1:
            first = margin[self.families[0]]
            by = np.stack([first, -first] if len(self.families) == 2 else [margin[f] for f in self.families], axis=1)
            pick = by.argmax(axis=1)
            score = sure(by[np.arange(n), pick])
        else:
            pick, score = np.zeros(n, np.int64), np.ones(n)
        lang = np.full(n, "und", object)
        for j, f in enumerate(self.families):
            own, mine = [x for x in self.langs if family(x) == f], pick == j
            votes, margins = np.zeros((n, len(own))), np.zeros((n, len(own)))
            for a in range(len(own)):
                for b in range(a + 1, len(own)):
                    m = margin[own[a], own[b]]
                    votes[:, a] += m >= 0
                    votes[:, b] += m < 0
                    margins[:, a] += m
                    margins[:, b] -= m
            best = np.lexsort((margins.T, votes.T), axis=0)[-1] if len(own) > 1 else np.zeros(n, np.int64)
            inside = sure(margins[np.arange(n), best] / max(len(own) - 1, 1)) if len(own) > 1 else np.ones(n)
            lang[mine] = np.array(own, object)[best[mine]]
            score = np.where(mine, score * inside, score)
        return list(lang), score

    def rows(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """(row, lang_pred, score): every row of docs as a struct, with its language; no shuffle."""
        model, table = self, np.stack([w[:-1] for w in self.machines.values()], axis=1) if self.machines else np.zeros((SLOTS, 0))
        shared = docs.sparkSession.sparkContext.broadcast(table.astype(np.float32))

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for part in byte_slices(batch):
                    n = part.num_rows
                    sums, total = np.zeros((n, shared.value.shape[1])), np.zeros(n)
                    for data, offsets, owner in stretches(part):
                        text, slot = grams(data, offsets)
                        text = owner[text]
                        total += np.bincount(text, minlength=n)
                        for i in range(sums.shape[1]):
                            sums[:, i] += np.bincount(text, shared.value[slot, i], n)
                    lang, score = model.decide(sums, total) if model.langs else (["und"] * n, np.zeros(n))
                    known = part.column(2).to_numpy(zero_copy_only=False) & bool(model.langs)
                    yield pa.RecordBatch.from_arrays([part.column(1), pa.array([x if k else "und" for x, k in zip(lang, known)], pa.string()), pa.array(np.where(known, score, 0.0))], names=["row", "lang_pred", "score"])

        text = F.col(text_col).cast("string")
        rows = docs.select(text.alias("t"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
        return rows.mapInArrow(run, rows.select("row", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema)


def examples(batches):
    """(h, part, lang, slots, shares) of each text of a batch and of stretches of its words."""
    import pyarrow as pa

    for batch in batches:
        for piece in byte_slices(batch):
            out = []
            for text, h, lang in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), piece.column(2).to_pylist()):
                words = text.split()
                starts = [int(k * max(len(words) - PART_WORDS, 0) / max(PARTS - 1, 1)) for k in range(PARTS)] if len(words) > PART_WORDS else []
                parts = [text, *(" ".join(words[s : s + 1 + (k * PART_WORDS) // PARTS]) for k, s in enumerate(starts))]
                for k, p in enumerate(parts):
                    total = np.zeros(SLOTS)
                    for data, offsets, _ in stretches(pa.RecordBatch.from_arrays([pa.array([p])], names=["t"])):
                        total += np.bincount(grams(data, offsets)[1], minlength=SLOTS)
                    if total.any():
                        slots = np.flatnonzero(total)
                        out.append((h, k, lang, slots.astype(np.uint16).tobytes(), (total[slots] / total.sum()).astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_pylist([dict(zip(("h", "part", "lang", "slots", "shares"), r)) for r in out], schema=pa.schema([("h", pa.int64()), ("part", pa.int32()), ("lang", pa.string()), ("slots", pa.binary()), ("shares", pa.binary())]))


def fit(docs: DataFrame, learn: Column | None = None, lang_col: str = "lang", text_col: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """A model of the rows of docs for which `learn` holds (all, if not given). At most `rows` texts of each language reach
    the driver, as features; the counts of languages decide which hashes are taken."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.lit(True) if learn is None else learn))
    known = known.select(F.col(text_col).cast("string").alias("t"), F.xxhash64(text_col).alias("h"), F.col(lang_col).cast("string").alias("lang"))
    n = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not n:
        return Model([], {})
    spread = 1 << 30
    take = F.create_map(*[F.lit(x) for lang, c in sorted(n.items()) for x in (lang, min(spread, -(-spread * rows // c)))])
    picked = known.where(F.pmod(F.xxhash64("h"), F.lit(spread)) < F.get(F.array(take), F.lit(0))[F.col("lang")])
    found = picked.mapInArrow(examples, "h long, part int, lang string, slots binary, shares binary").dropDuplicates(["lang", "h", "part"]).collect()
    found.sort(key=lambda r: (r.lang, r.h, r.part))
    kept, texts = [], {}
    for r in found:  # no language has more than `rows` texts
        seen = texts.setdefault(r.lang, set())
        if r.h in seen or len(seen) < rows:
            seen.add(r.h)
            kept.append(r)
    langs = sorted(texts)
    families = sorted({family(x) for x in langs})
    slots = [np.frombuffer(r.slots, np.uint16).astype(np.int64) for r in kept]
    shares = [np.frombuffer(r.shares, np.float32).astype(np.float64) for r in kept]

    def machine(of: list[int], y: list[int]) -> np.ndarray:
        return train_machine(np.cumsum([0, *(len(slots[i]) for i in of)]), np.concatenate([slots[i] for i in of]), np.concatenate([shares[i] for i in of]), np.array(y, np.float64))

    machines: dict = {}
    if len(families) > 1:
        for f in families[: 1 if len(families) == 2 else None]:  # of two, the other one is the rest
            machines[f] = machine(list(range(len(kept))), [1 if family(r.lang) == f else -1 for r in kept])
    for i, a in enumerate(langs):
        for b in langs[i + 1 :]:
            if family(a) == family(b):
                of = [j for j, r in enumerate(kept) if r.lang in (a, b)]
                machines[a, b] = machine(of, [1 if kept[j].lang == a else -1 for j in of])
    return Model(langs, machines)


def predict(docs: DataFrame, held_out: Column, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred, score of every row of docs, by a model of the rows that are not held out."""
    model = fit(docs, ~held_out, lang_col, text_col)
    out = model.rows(docs.select(id_col, text_col, F.coalesce(held_out, F.lit(False)).alias("held_out")), text_col)
    return out.select(F.col("row")[id_col].alias(id_col), "row.held_out", "lang_pred", "score")
