"""License scans: MinHash bands over overlapping text windows, then exact shingle containment; DataFrame functions only.

A template is cut into overlapping pieces of at most PIECE words; shingles are pairs of neighbouring words, lower-cased,
without punctuation at their ends. A text's windows have the lengths of the pieces and start at every word, so that each
occurrence of a piece lies in a window of its own length. Only windows with a shingle of some template can share a
minimum with a piece (the least hash of a set is the hash of one of its members), so others are not built: this loses
nothing. MinHash of HASHES functions in BANDS bands retrieves the pieces; a window that differs from a piece in one of
eight words has a Jaccard similarity of 5/9 and collides with probability 1 - (1 - (5/9)^2)^16 = 0.997; an exact one
collides surely. Candidates are kept if they contain at least half of `containment` of the piece's shingles, exactly
counted; the template's shingles are then counted in them and in the PIECE words on both sides of them, so that a piece
with a changed word still gives those it has, and one that no band retrieved is seen from its neighbours. A license is
reported if at least `containment` of all its template's shingles is found.

Null and empty texts, and texts of one word, hold nothing. Templates of one word are refused. Repeated ids are scanned
as separate rows and reported together. Templates are a parameter, at most MAX_TEMPLATES of them, so that joins with
them broadcast safely.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut

PIECE, STRIDE, HASHES, BANDS, MAX_TEMPLATES = 8, 4, 32, 16, 2000
PUNCTUATION = ".,;:!?\"'()[]{}<>*#-"

#: Fixed texts of public license notices.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"],
    "MIT": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "All-rights-reserved": ["All rights reserved"],
}


def words(text: Column) -> Column:
    """Lower-cased words without punctuation at their ends; words of punctuation alone are left out."""
    bare = F.transform(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: F.lower(F.btrim(w, F.lit(PUNCTUATION))))
    return F.filter(bare, lambda w: w != "")


def pairs(w: Column) -> Column:
    """Hashes of neighbouring words, one for each word but the last."""
    return F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def bands(shingles: Column) -> Column:
    """One hash for each band of the MinHash signature, with the band's number."""
    least = lambda i: F.array_min(F.transform(shingles, lambda s: F.xxhash64(F.lit(i), s)))
    rows = HASHES // BANDS
    return F.array(*(F.xxhash64(F.lit(b), *(least(b * rows + i) for i in range(rows))) for b in range(BANDS)))


def pieces(spark, templates: dict[str, list[str]]) -> DataFrame:
    """(license, template, piece, n, shingles): the pieces of every template."""
    rows = [(name, i, text) for name, texts in templates.items() for i, text in enumerate(texts)]
    if len(rows) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates")
    t = spark.createDataFrame(rows, "license string, template int, text string").withColumn("w", words(F.col("text")))
    last = F.greatest(F.size("w") - PIECE, F.lit(0))
    starts = F.array_distinct(F.concat(F.filter(F.sequence(F.lit(0), last, F.lit(STRIDE)), lambda s: s <= last), F.array(last)))
    out = t.withColumn("start", F.explode(starts)).withColumn("w", F.slice("w", F.col("start") + 1, PIECE))
    return out.select("license", "template", F.col("start").alias("piece"), F.size("w").alias("n"), F.array_distinct(pairs(F.col("w"))).alias("shingles"))


def key_words(templates: dict[str, list[str]], containment: float) -> list[str]:
    """Words of which every text that contains `containment` of some template's shingles holds one at least.

    Of s distinct shingles, m = floor((1 - containment) * s) may be missing; of m + 1 of them one is there, and so is
    its longer word.
    """
    out = set()
    for text in (t for texts in templates.values() for t in texts):
        w = [x for x in (x.strip(PUNCTUATION).lower() for x in text.split()) if x]
        shingles = list(dict.fromkeys(zip(w, w[1:])))
        need = math.floor((1 - containment) * len(shingles) + 1e-9) + 1
        out.update(max(x, key=len) for x in sorted(shingles, key=lambda x: -max(map(len, x)))[:need])
    return sorted(out)


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, containment: float = 0.8) -> DataFrame:
    """(doc_id, license, containment, n_pieces, first_word): licenses found, one row for each and document.

    Only windows that hold a template's shingle are shuffled, after equal ones of a task are merged; what follows joins
    them with the broadcast templates and groups the matches.
    """
    spark = docs.sparkSession
    known = cut(pieces(spark, templates), "pieces")
    lengths = [r.n for r in known.select("n").distinct().orderBy("n").collect()]
    if not lengths or lengths[0] < 2:
        raise ValueError("a template needs two words at least")
    vocabulary = sorted({s for r in known.select("shingles").collect() for s in r.shingles})

    # a text without any key word of a template can't hold the template's share of shingles: nothing is lost here
    keys = "|".join(map(re.escape, key_words(templates, containment)))
    rows = docs.where(F.col("text").rlike(f"(?i)(?<![A-Za-z0-9])(?:{keys})")).select("doc_id", pairs(words(F.col("text"))).alias("p"))
    hit = F.expr(f"filter(transform(p, (s, i) -> CASE WHEN s IN ({','.join(map(str, vocabulary))}) THEN i END), i -> i IS NOT NULL)")
    rows = rows.withColumn("hits", hit).where(F.size("hits") > 0)
    # shingles of the templates where they stand, null elsewhere: neighbours are sliced from it, however many hits a text has
    rows = rows.withColumn("q", F.expr(f"transform(p, s -> CASE WHEN s IN ({','.join(map(str, vocabulary))}) THEN s END)"))

    # every window start, of every length, that holds one of the hits
    def around(n):
        near = F.flatten(F.transform("hits", lambda i: F.sequence(F.greatest(i - (n - 2), F.lit(0)), i)))
        # the hits in the window and in PIECE words on both sides
        beside = lambda s: F.array_compact(F.slice("q", F.greatest(s - PIECE, F.lit(0)) + 1, F.least(s, F.lit(PIECE)) + n - 1 + PIECE))
        return F.transform(F.array_distinct(near), lambda s: F.struct(s.alias("start"), F.lit(n).alias("n"), beside(s).alias("region"), F.array_distinct(F.slice("p", s + 1, n - 1)).alias("shingles")))

    spots = F.concat(*map(around, lengths))
    # equal windows of a document, with equal neighbours, say the same: the first one stands for all
    windows = rows.select("doc_id", F.explode(spots).alias("x")).select("doc_id", "x.*").groupBy("doc_id", "n", "shingles", "region").agg(F.min("start").alias("start"))
    windows = cut(windows, "windows")

    signed = windows.withColumn("band", F.explode(bands(F.col("shingles"))))
    keys = known.withColumn("band", F.explode(bands(F.col("shingles")))).select("license", "template", "piece", F.col("n").alias("piece_n"), F.col("shingles").alias("wanted"), "band")
    pairs_found = signed.join(F.broadcast(keys), "band").where(F.col("n") == F.col("piece_n"))
    share = F.size(F.array_intersect("shingles", "wanted")) / F.size("wanted")
    verified = pairs_found.withColumn("share", share).where(F.col("share") >= containment / 2)
    # a piece starts at its first window of enough share, or else at its best one, not where a window only touches it
    first = F.coalesce(F.min(F.when(F.col("share") >= containment, F.col("start"))), F.max_by("start", F.struct("share", -F.col("start"))))
    best = verified.groupBy("doc_id", "license", "template", "piece").agg(F.max_by("region", F.struct("share", -F.col("start"))).alias("region"), first.alias("start"))
    whole = known.groupBy("license", "template").agg(F.array_distinct(F.flatten(F.collect_list("shingles"))).alias("all"))
    texts = best.groupBy("doc_id", "license", "template").agg(F.flatten(F.collect_list("region")).alias("region"), F.count(F.lit(1)).alias("n_pieces"), F.min("start").alias("start"))
    texts = texts.join(F.broadcast(whole), ["license", "template"]).withColumn("containment", F.size(F.array_intersect("region", "all")) / F.size("all")).where(F.col("containment") >= containment)
    return texts.groupBy("doc_id", "license").agg(F.round(F.max("containment"), 6).alias("containment"), F.sum("n_pieces").alias("n_pieces"), F.min("start").cast("long").alias("first_word"))
