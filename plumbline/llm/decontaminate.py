"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Words are lower-cased and freed of punctuation at their ends. Numbers (in digits or in words), names and units (known unit
words after a number) become typed placeholders. A name is a run of capitalised words, of any script: at the start of a
sentence only if its first word is no common opening word, elsewhere in any case. Numbers and names of several words are
one placeholder. Windows of WINDOW canonical words of texts and items meet in a hash join. Windows with fewer than half
literal words don't count.

Slots must be filled consistently, so that one renaming explains a whole occurrence. Inside a window the pattern of equal
and unequal values must be that of the item. Beyond it, each slot value of the item has an ordinal, and the windows of one
occurrence (those equally far from their places in the item) must give every ordinal one value; occurrences at other
distances count with the largest one if none of their values contradicts it. A re-parameterised question passes, a text
that only has its frame in common does not.

Names are known by their capitals, so that a copy in other case has other templates. Windows of plain words in lower
case, without the rule on literal words, therefore meet in the same join beside them.

An item of fewer than WINDOW words (two at least) is one window of its own length, and matches texts that hold it
anywhere. A text is contaminated by an item if it holds at least `coverage` of the item's distinct windows or `run` of
them, typed or plain ones; typed ones are reported if they are enough.

Null and empty texts or items match nothing. `contaminated` takes repeated rows of one id as one document and rows with
a null id as one more; `clean` judges each row by itself. Repeated items are separate items. Texts of any length count
whole. Columns beside id and text are not read, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_enough

WINDOW, COVERAGE, RUN = 8, 0.5, 6
#: Benchmark windows that are broadcast at most (some 150 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Stands for a blank inside a placeholder.
JOINT = "\x01"
PUNCTUATION = ".,;:!?\"'()[]"
#: Bits of the map of openings for each opening, and bits of the map at most (beyond, more windows pass to the join).
BITS, MOST_BITS = 16, 1 << 26
#: Words that open sentences without being names, fixed.
OPENERS = ("the", "a", "an", "this", "that", "these", "those", "there", "here", "it", "he", "she", "they", "we", "you", "i", "his", "her", "their", "its", "my", "our", "your", "if", "when", "where", "what", "which", "who", "whom", "whose", "why", "how", "in", "on", "at", "by", "for", "from", "with", "to", "of", "as", "and", "but", "or", "so", "is", "are", "was", "were", "do", "does", "did", "has", "have", "had", "can", "could", "will", "would", "should", "after", "before", "each", "every", "all", "some", "let", "find", "then", "while")
#: Number words, fixed.
NUMBER_WORDS = ("two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion", "dozen")
#: Unit words, fixed.
UNITS = ("mm", "cm", "m", "km", "inch", "inches", "feet", "foot", "mile", "miles", "mg", "g", "kg", "pound", "pounds", "ounces", "ml", "l", "liter", "liters", "litres", "seconds", "second", "minutes", "minute", "hours", "hour", "days", "day", "weeks", "week", "months", "month", "years", "year", "dollars", "dollar", "cents", "euros", "euro", "percent", "degrees", "kmh", "mph", "%")


def joined(text: Column) -> Column:
    """The text with JOINT in place of the blanks inside names and number words of several words."""
    number = "(?:" + "|".join(NUMBER_WORDS) + ")"
    letters = "".join(sorted({w[0] for w in NUMBER_WORDS}))
    return F.regexp_replace(text, rf" (?=[\p{{Lu}}{letters}])(?:(?=\p{{Lu}}\p{{L}})(?<=\p{{Lu}}[\p{{L}}'’-]{{0,30}} )|(?=[{letters}])(?={number}\b)(?<=\b{number} ))", JOINT)


def canonical(text: Column) -> Column:
    """The text with a placeholder for each whole word that is a number or a name, in lower case.

    Words are replaced one for one, so that canonical and plain words stay aligned. Each pattern opens with a look at one
    character, so that most places cost no more than that. The repeat of number words is possessive: a joint cannot end a
    number word, so nothing is given back, and the repeat is a loop instead of a recursion.
    """
    blank = r"\x20\x09-\x0D"
    openers = "|".join(w.capitalize() for w in OPENERS)
    t = F.regexp_replace(text, rf"(?=\p{{Lu}})(?<![^{blank}(\"'“‘\[])(?!(?:{openers})(?![\p{{L}}{JOINT}]))[^{blank}]+", "<name>")
    t = F.regexp_replace(t, rf"(?=[$€£+\-0-9])(?<![^{blank}])[$€£+\-]?[0-9][^{blank}]*", "<num>")
    number = "(?:" + "|".join(sorted(NUMBER_WORDS, key=len, reverse=True)) + ")"
    opens = "|".join(sorted({w[:2] for w in NUMBER_WORDS}))
    return F.regexp_replace(F.lower(t), rf"(?=[{''.join(sorted({w[0] for w in NUMBER_WORDS}))}])(?<![^{blank}(\"'])(?={opens}){number}(?:[{JOINT}-]{number})*+(?![^{blank}.,;:!?)\"'\]])", "<num>")


def with_units(canon: Column) -> Column:
    """Canonical text with a placeholder for unit words behind numbers."""
    blank = r"\x20\x09-\x0D"
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    return F.when(F.contains(canon, F.lit("<num>")), F.regexp_replace(canon, rf"(?<=<num>[{blank}])(?:{units})(?=[.,;:!?\"')\]]*(?:[{blank}]|$))", "<unit>")).otherwise(canon)


def split_words(text: Column) -> Column:
    """Words without punctuation at their ends; white space separates them, with the punctuation beside it.

    A separator begins where a run of punctuation does, so that a long run is read once, not from each of its marks.
    """
    p = re.escape(PUNCTUATION)
    return F.split(F.btrim(text, F.lit(PUNCTUATION + " \t\n\v\f\r")), rf"(?<![{p}])[{p}]*+[\x20\x09-\x0D][{p}\x20\x09-\x0D]*+")


def word_lists(rows: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """keep, t, raw, plain, slots: canonical words and the plain ones aligned with them, all plain words singly, and
    whether canonical and plain ones may differ."""
    w = rows.select(*keep, joined(F.coalesce(F.col(text_col), F.lit(""))).alias("j"))
    # generators of one row: what they make is not worked out again for each use
    w = w.select(*keep, F.explode(F.array(F.struct(canonical(F.col("j")).alias("canon"), F.lower("j").alias("low")))).alias("p"))
    slots = F.col("p.canon").contains("<n")
    several = F.when(F.col("p.low").contains(JOINT), split_words(F.translate(F.col("p.low"), JOINT, " ")))
    w = w.select(*keep, F.explode(F.array(F.struct(split_words(with_units(F.col("p.canon"))).alias("t"), split_words(F.col("p.low")).alias("raw"), several.alias("several"), slots.alias("slots")))).alias("p"))
    return w.select(*keep, "p.t", "p.raw", F.coalesce("p.several", "p.raw").alias("plain"), "p.slots")


def opening_hashes(words: str, n: int) -> str:
    places = ", ".join(f"get({words}, i + {k - 1})" for k in range(n))
    return f"CASE WHEN size({words}) >= {n} THEN transform(sequence(1, size({words}) - {n - 1}), i -> xxhash64({places})) ELSE array() END"


def windows(w: DataFrame, *keep: str, lengths: list[int], openings: dict[int, tuple[str, int]] | None) -> DataFrame:
    """keep, k, t, c, r, p, v for every window of word_lists: its kind (0 typed, 1 plain), hashes of its words, of its slot
    pattern and of its plain words, its place, and hashes of what fills its slots.

    openings: for each length of an opening, the map of those that the windows asked for begin with; others are not
    built. None has all built.
    """
    # get reads one place of the array; slice inside a lambda would copy the whole array for each window
    at = lambda c, i, n: [F.get(F.col(c), i - 1 + k) for k in range(n)]
    none = F.lit(0).cast("long")
    empty = F.expr("cast(array() as array<bigint>)")

    def plain(i, n, k):
        h = F.xxhash64(*at("plain" if k else "raw", i, n))  # where there are no slots, canonical words are the plain ones
        return F.struct(F.lit(k).alias("k"), h.alias("t"), none.alias("c"), h.alias("r"), i.alias("p"), empty.alias("v"))

    def slotted(i, n):
        both = F.arrays_zip(F.array(*at("t", i, n)).alias("t"), F.array(*at("raw", i, n)).alias("r"))
        values = F.transform(F.filter(both, lambda x: x["t"].isin("<name>", "<num>", "<unit>")), lambda x: F.xxhash64(x["r"]))
        first_places = F.transform(values, lambda v: F.array_position(values, v))
        c = F.when(F.size(values) > 0, F.xxhash64(first_places)).otherwise(none)
        return F.when((n - F.size(values)) * 2 >= n, F.struct(F.lit(0).alias("k"), F.xxhash64(*at("t", i, n)).alias("t"), c.alias("c"), F.xxhash64(*at("raw", i, n)).alias("r"), i.alias("p"), values.alias("v")))

    for size in sorted({opening_size(n) for n in lengths}):
        for k, words in ((0, "t"), (1, "plain")):
            test = "true"
            if openings:
                bits, mask = openings[size]
                bit = lambda h: f"getbit(get({bits}, cast(shiftrightunsigned({h}, 6) & {mask} as int)), cast({h} & 63 as int)) = 1"
                test = f"{bit('h')} AND {bit('shiftrightunsigned(h, 32)')}"
            w = w.withColumn(f"at{size}_{k}", F.expr(f"array_compact(transform({opening_hashes(words, size)}, (h, i) -> CASE WHEN {test} THEN i + 1 END))"))

    def of_length(n):
        room = lambda words: lambda i: i + (n - 1) <= F.size(words)
        typed, bare = F.filter(f"at{opening_size(n)}_0", room("t")), F.filter(f"at{opening_size(n)}_1", room("plain"))
        return F.when(F.col("slots"), F.transform(typed, lambda i: slotted(i, n))).otherwise(F.transform(typed, lambda i: plain(i, n, 0))), F.transform(bare, lambda i: plain(i, n, 1))

    every = [x for n in lengths for x in of_length(n)]
    # the outer form: Spark pushes no test of the array below, which would compute it twice
    return w.select(*keep, F.explode_outer(F.concat(*every)).alias("x")).where("x is not null").select(*keep, "x.*")


def opening_size(n: int) -> int:
    """Words of the opening by which windows of n words are found."""
    return min(n, 3)


def opening_map(w: DataFrame, n: int) -> tuple[str, int]:
    """A bit map of the hashes of all openings of n words of the items' word lists, as SQL text, and the mask of its words.

    Each hash has two bits, of its low and of its high half.
    """
    hashes = w.select(F.explode(F.expr(f"concat({opening_hashes('t', n)}, {opening_hashes('plain', n)})")).alias("h")).distinct()
    hashes = hashes.select(F.explode(F.array(F.col("h"), F.shiftrightunsigned("h", 32))).alias("h"))
    count, size = hashes.count(), 1 << 10
    while size < min(BITS * count, MOST_BITS):
        size *= 2
    mask = size // 64 - 1
    word = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(mask))
    found = dict(hashes.groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).collect())
    # SQL text reaches the JVM in one call; the least long has no literal of its own
    text = ",".join(str(found.get(i, 0)) if found.get(i, 0) != -(2**63) else "(-9223372036854775807 - 1)" for i in range(mask + 1))
    return f"cast(array({text}) as array<bigint>)", mask


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, run: int = RUN) -> DataFrame:
    """(doc_id, item_id, n_windows, n_exact, item_windows, coverage, reparameterised) of every contaminated pair."""
    listed = word_lists(benchmark.where("item_id is not null"), "text", "item_id").where("size(t) > 1")
    listed = cut(listed.withColumn("own", F.least(F.size("t"), F.lit(WINDOW))), "items")
    lengths = sorted(r.own for r in listed.select("own").distinct().collect()) or [WINDOW]
    openings = {size: opening_map(listed.where(F.least("own", F.lit(3)) == size), size) for size in sorted({opening_size(n) for n in lengths})}
    items = None
    for n in lengths:
        of = windows(listed.where(F.col("own") == n), "item_id", lengths=[n], openings=None)
        items = of if items is None else items.union(of)
    items = cut(items.select("item_id", "k", "t", F.col("c").alias("item_c"), F.col("r").alias("item_r"), F.col("p").alias("item_p"), F.col("v").alias("item_v")), "windows")
    totals = cut(items.groupBy("item_id", "k").agg(F.countDistinct("t").alias("item_windows")), "totals")

    # null ids are one more document: a struct of a null is a key like others
    texts = word_lists(docs.select(F.struct("doc_id").alias("d"), "text"), "text", "d")
    found = windows(texts, "d", lengths=lengths, openings=openings).join(small_enough(items, BROADCAST_ROWS), ["k", "t"]).where(F.col("c") == F.col("item_c"))
    exact = (F.col("r") == F.col("item_r")).cast("int")
    found = cut(found.select("d", "item_id", "k", "t", exact.alias("exact"), (F.col("p") - F.col("item_p")).alias("apart"), F.arrays_zip(F.col("item_v").alias("slot"), F.col("v").alias("value")).alias("slots")), "found")

    kept = found.where("k = 1").select("d", "item_id", "k", "t", "exact").unionByName(consistent(found.where("k = 0")))
    each = kept.groupBy("d", "item_id", "k", "t").agg(F.max("exact").alias("exact"))
    out = each.groupBy("d", "item_id", "k").agg(F.count(F.lit(1)).alias("n_windows"), F.sum("exact").alias("n_exact"))
    out = out.join(small_enough(totals, BROADCAST_ROWS), ["item_id", "k"]).withColumn("coverage", F.col("n_windows") / F.col("item_windows"))
    out = out.where((F.col("coverage") >= coverage) | (F.col("n_windows") >= run))
    out = out.groupBy("d", "item_id").agg(F.min(F.struct("k", "n_windows", "n_exact", "item_windows", "coverage")).alias("x")).select("d.doc_id", "item_id", "x.*")
    return out.select("doc_id", "item_id", "n_windows", "n_exact", "item_windows", F.round("coverage", 6).alias("coverage"), (F.col("n_exact") < F.col("n_windows")).alias("reparameterised"))


def consistent(typed: DataFrame) -> DataFrame:
    """Typed matches (d, item_id, k, t, exact) whose occurrence fills each of the item's slots with one value, and which do
    not contradict the item's largest occurrence in the document."""
    one = ["d", "item_id", "apart"]
    slot, value = F.col("s.slot").alias("slot"), F.col("s.value").alias("value")
    bound = typed.select(*one, F.explode("slots").alias("s")).select(*one, slot, value).groupBy(*one, "slot").agg(F.min("value").alias("value"), F.max("value").alias("other"))
    bound = bound.groupBy(*one).agg(F.bool_or(F.col("value") != F.col("other")).alias("torn"), F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("bound"))
    sizes = typed.groupBy(*one).agg(F.countDistinct("t").alias("n"))
    whole = sizes.join(bound, one, "left").where(~F.coalesce("torn", F.lit(False))).select(*one, "n", F.coalesce("bound", F.expr("cast(map() as map<bigint, bigint>)")).alias("bound"))
    whole = cut(whole, "occurrences")
    best = whole.groupBy("d", "item_id").agg(F.max_by("bound", F.struct("n", -F.col("apart"))).alias("best"))
    against = F.exists(F.map_entries("bound"), lambda e: F.coalesce(F.try_element_at("best", e["key"]) != e["value"], F.lit(False)))
    fit = whole.join(best, ["d", "item_id"]).where(~against).select(*one)
    return typed.join(fit, one, "left_semi").select("d", "item_id", "k", "t", "exact")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """docs without the contaminated rows, columns unchanged. Rows are found again by a hash of id and text."""
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))
    narrow = docs.select(key.alias("doc_id"), F.col(text_col).alias("text"))
    bad = cut(contaminated(narrow, benchmark, **parameters).select(F.col("doc_id").alias("bad_key")).distinct(), "contaminated")
    return docs.join(bad, key == bad["bad_key"], "left_anti").select(*docs.columns)
