"""Claim-level citations: markers in the answer and quotes from the sources."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUOTE = 320


def quote(claim: str, text: str, most: int = QUOTE) -> str:
    """The window of `most` characters around a claim word of four letters or more that holds most of the claim's words."""
    import re

    text = " ".join((text or "").split())
    if len(text) <= most:
        return text
    low, words = text.lower(), {w for w in re.findall(r"\w{4,}", claim.lower())}
    places = [m.start() for w in sorted(words, key=len, reverse=True)[:8] for m in re.finditer(re.escape(w), low)] or [0]
    best = max((max(0, min(p - most // 3, len(text) - most)) for p in places), key=lambda s: (sum(w in low[s : s + most] for w in words), -s))
    piece = text[best : best + most]
    if best:
        after = re.search(r"[.!?]\s+", piece[: most // 3])
        piece = "… " + (piece[after.end() :] if after else piece)
    return piece.strip() + (" …" if best + most < len(text) else "")


def mark(answer: str, claims: list[str]) -> tuple[str, list[int]]:
    """The answer with [n] before the last mark of each claim found in it, and the number of each claim (0: not found)."""
    spans, at, numbers = [], 0, []
    for c in claims:
        i = answer.find(c, at)
        i = i if i >= 0 else answer.find(c)
        i = i if i >= 0 else answer.lower().find(c.lower())
        if i < 0 or any(i < e and s < i + len(c) for s, e in spans):
            numbers.append(0)
            continue
        spans.append((i, i + len(c)))
        numbers.append(len(spans))
        at = i + len(c)
    out = answer
    for n, (_, e) in sorted(enumerate(spans, 1), key=lambda x: -x[1][1]):
        stop = e - 1 if out[e - 1 : e] in ".!?" and e else e
        out = f"{out[:stop]} [{n}]{out[stop:]}"
    return out, numbers


def attach_citations(answers: DataFrame, matches: DataFrame, sources: DataFrame, key: str = "answer_id", no_answer=None) -> DataFrame:
    """key, answer with markers, citations: supported claims only, numbered in order of the claims."""
    fine = matches.where("supported").join(sources.select(key, "source_index", "text"), [key, "source_index"])
    grouped = fine.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("claim_no", "claim", "source_index", "coverage", "text"))).alias("found"))

    @F.pandas_udf("answer string, citations array<struct<id:int,claim:string,source_index:int,quote:string,coverage:double>>")
    def run(answer: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = []
        for a, f in zip(answer, found):
            f = list(f) if f is not None else []
            text, numbers = mark(a or "", [x["claim"] for x in f])
            rows.append((text, [{"id": n, "claim": x["claim"], "source_index": int(x["source_index"]), "quote": quote(x["claim"], x["text"]), "coverage": float(x["coverage"])} for n, x in zip(numbers, f) if n]))
        return pd.DataFrame(rows, columns=["answer", "citations"])

    out = answers.join(grouped, key, "left")
    return out.select(key, run("answer", "found").alias("r")).select(key, "r.answer", "r.citations")
