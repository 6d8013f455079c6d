"""Facts of a claim as canonical strings: percentages, money, durations, dates, other numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon
from .text import any_of, ascii_borders, normalize_for_matching, once

# fixed patterns of the fact kinds
NUMBER = r"[0-9][0-9.,]*"
MONEY = rf"\b({NUMBER})\s*(tl|lira|usd|eur|dolar|euro)[a-z']*\b"
LIRA = rf"\b({NUMBER})\s*₺"
DURATION = rf"\b({NUMBER})\s*(gun|hafta|ay|yil|saat|dakika)[a-z']*\b"
PERCENT = r"(?:%\s*|\byuzde\s+)(\d+(?:[.,]\d+)?)"
DAY_FIRST = r"\b([0-3]?\d)[./-]([01]?\d)[./-]((?:19|20)?\d{2})\b"
ISO = r"\b((?:19|20)\d{2})-([01]\d)-([0-3]\d)\b"
NAMED = rf"\b([0-3]?\d)\s+({'|'.join(lexicon.MONTHS)})\s+((?:19|20)\d{{2}})\b"


# what a text must hold for a pattern to match it: looking for it is much faster than the pattern
SIGNS = {MONEY: ("tl", "lira", "usd", "eur", "dolar"), LIRA: ("₺",), DURATION: ("gun", "hafta", "ay", "yil", "saat", "dakika"), PERCENT: ("%", "yuzde"), ISO: ("-",)}
# the beginnings of the patterns with their first character first, and then what may stand before it: few places of a text have that character
FIRST = {
    r"\b([0-9]": r"([0-9](?<![A-Za-z0-9_].)",
    r"\b([0-3]?\d)": r"([0-9](?<![A-Za-z0-9_].)(?:(?<=[0-3])\d)?)",
    r"\b((?:19|20)\d{2})": r"([12](?<![A-Za-z0-9_].)(?:(?<=1)9|(?<=2)0)\d{2})",
    r"(?:%\s*|\byuzde\s+)": r"[%y](?:(?<=%)|(?<=y)(?<![A-Za-z0-9_]y)uzde(?=\s))\s*",
    r"(?<![a-z])\d+": r"\d(?<![a-z].)\d*",
}


def fast(*patterns: str) -> str:
    """One of the patterns, the same matches, with their first characters first."""
    each = []
    for p in patterns:
        (begins,) = [b for b in FIRST if p.startswith(b)]
        each.append(ascii_borders(FIRST[begins] + p.removeprefix(begins)))
    return "|".join(each)


def none() -> Column:
    return F.expr("cast(array() as array<string>)")


def found(text: Column, pattern: str, f) -> Column:
    """f of every match of a pattern, in the texts that hold one of its signs, if it has any."""
    each = F.transform(F.regexp_extract_all(text, F.lit(fast(pattern)), F.lit(0)), f)
    return F.when(any_of(text, SIGNS[pattern]), each).otherwise(none()) if pattern in SIGNS else each


def group(match: Column, pattern: str, i: int) -> Column:
    """A group of a match. The match is matched again alone, and a few characters are matched much faster than the text they are from."""
    return F.regexp_extract(match, fast(pattern), i)


def strip_zeros(v: Column) -> Column:
    return F.when(F.contains(v, F.lit(".")), F.regexp_replace(v, r"\.?0+$", "")).otherwise(v)


def canonical_number(raw: Column) -> Column:
    """Locale repair: of two kinds of separators the later is the decimal one; three digits after one dot are a group."""
    return once(F.trim(raw), _canonical)


def _canonical(v: Column) -> Column:
    comma, dot = F.contains(v, F.lit(",")), F.contains(v, F.lit("."))
    last = lambda m: F.length(v) - F.instr(F.reverse(v), m)
    dots = F.length(v) - F.length(F.replace(v, F.lit(".")))
    no = lambda c, m: F.replace(c, F.lit(m))
    both = F.when(last(",") > last("."), F.replace(no(v, "."), F.lit(","), F.lit("."))).otherwise(no(v, ","))
    repaired = F.when(comma & dot, both).when(comma, F.replace(v, F.lit(","), F.lit("."))).when((dots == 1) & v.rlike(r"^\d{0,3}\.\d{3}$"), no(v, ".")).when(dots > 1, no(v, ".")).otherwise(v)
    number = lambda x: once(F.regexp_replace(F.regexp_replace(x, r"^0+(?=\d)", ""), r"^\.", "0."), strip_zeros)
    return once(repaired, lambda x: F.when(x.rlike(r"^(\d+\.?\d*|\.\d+)$"), F.regexp_replace(number(x), r"\.$", "")).otherwise(x))


def canonical_money_unit(unit: Column) -> Column:
    u = normalize_for_matching(unit)
    return F.when(u.isin("tl", "lira"), "try").when(u.isin("usd", "dolar"), "usd").when(u.isin("eur", "euro"), "eur").otherwise(u)


def distinct_sorted(x: Column) -> Column:
    return F.array_sort(F.array_distinct(x))


def extract_percentages(text: Column) -> Column:
    return once(normalize_for_matching(text), _percentages)


def _percentages(normal: Column) -> Column:
    plain = lambda v: F.regexp_replace(strip_zeros(F.replace(v, F.lit(","), F.lit("."))), r"\.$", "")
    shares = distinct_sorted(F.transform(F.regexp_extract_all(normal, F.lit(fast(PERCENT)), F.lit(1)), plain))
    return F.when(any_of(normal, SIGNS[PERCENT]), shares).when(normal.isNotNull(), none())


def extract_dates(normal: Column) -> Column:
    """yyyy-MM-dd of every date in a text in matching normal form; days are not checked against the calendar."""
    two = lambda c: F.lpad(c, 2, "0")
    year = lambda y: F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    a = found(normal, DAY_FIRST, lambda m: once(F.split(m, "[./-]"), lambda g: F.concat_ws("-", year(g[2]), two(g[1]), two(g[0]))))
    b = found(normal, ISO, lambda m: m)
    months = F.array(*map(F.lit, lexicon.MONTHS))
    c = found(normal, NAMED, lambda m: F.concat_ws("-", group(m, NAMED, 3), two(F.array_position(months, group(m, NAMED, 2)).cast("string")), two(group(m, NAMED, 1))))
    return distinct_sorted(F.concat(a, b, c))


def extract_claim_facts(text: Column) -> Column:
    """struct<percentages, money, durations, dates, numbers>, each a sorted array of canonical strings, empty for null.

    The normal form is worked out once, and only for texts with a digit. Patterns run over a text once each, and only where
    the text holds one of their signs.
    """
    nothing = F.struct(*(none().alias(k) for k in KINDS))
    facts = lambda plain: once(_mended(plain), lambda n: _facts(n, _percentages(plain)))
    return F.when(F.regexp_like(text, F.lit("[0-9]")), once(normalize_for_matching(text), facts)).otherwise(nothing)


def _mended(n: Column) -> Column:
    """Class years that were read as decimals: 3 ve .4s inif is 3 ve 4 sinif."""
    n = F.when(F.contains(n, F.lit("ve")), F.regexp_replace(n, r"\.(?<!\d\.)(\d)(?=\s+ve(?![A-Za-z0-9_]))", "$1")).otherwise(n)
    return once(n, lambda n: F.when(F.contains(n, F.lit("inif")), F.regexp_replace(n, r"\.(?<!\d\.)(\d)s?\s+inif(?![A-Za-z0-9_])", "$1 sinif")).otherwise(n))


def _facts(n: Column, percentages: Column) -> Column:
    money = found(n, MONEY, lambda m: F.concat_ws(":", canonical_number(group(m, MONEY, 1)), canonical_money_unit(group(m, MONEY, 2))))
    lira = found(n, LIRA, lambda m: F.concat(canonical_number(group(m, LIRA, 1)), F.lit(":try")))
    durations = found(n, DURATION, lambda m: F.concat_ws(":", canonical_number(group(m, DURATION, 1)), group(m, DURATION, 2)))
    numbers = lambda rest: F.transform(F.regexp_extract_all(rest, F.lit(fast(r"(?<![a-z])\d+(?:[.,]\d+)*(?![a-z])")), F.lit(0)), canonical_number)
    return F.struct(percentages.alias("percentages"), distinct_sorted(F.concat(money, lira)).alias("money"), distinct_sorted(durations).alias("durations"), extract_dates(n).alias("dates"), distinct_sorted(once(_without_facts(n), numbers)).alias("numbers"))


def _without_facts(n: Column) -> Column:
    """A text without its dates, percentages, money and durations, each of which leaves a blank."""
    steps = [(fast(DAY_FIRST, ISO), ()), (fast(NAMED), ()), (fast(PERCENT), SIGNS[PERCENT]), (fast(MONEY, LIRA), SIGNS[MONEY] + SIGNS[LIRA]), (fast(DURATION), SIGNS[DURATION])]

    def left(text, steps):
        if not steps:
            return text
        (pattern, signs), *more = steps
        cut = F.regexp_replace(text, pattern, " ")
        # each step's text is worked out once: the next looks for its signs in it, and then for its pattern
        return once(F.when(any_of(text, signs), cut).otherwise(text) if signs else cut, lambda t: left(t, more))

    return left(n, steps)


KINDS = ("percentages", "money", "durations", "dates", "numbers")


def has_facts(facts: Column) -> Column:
    return F.size(F.concat(*(facts[k] for k in KINDS))) > 0


def facts_supported(claim: Column, source: Column) -> Column:
    out = None
    for k in KINDS:
        one = F.size(F.array_except(claim[k], source[k])) == 0
        out = one if out is None else out & one
    return out
