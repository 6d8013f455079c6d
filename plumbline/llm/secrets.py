"""Secret scans with multipart credential linking, in DataFrame functions only.

Base spans (contract of the scan): `assign` a keyword with a value of six or more characters, `access` an AKIA
identifier of 20 or more characters, `hex` a run of 24 or more lower-case hex digits. They are reported wherever found.

Weak candidates are parts of a credential that say little alone: `identifier` (a user or client name that is assigned),
`weak_secret` (a value assigned to a password-like word of short form, or the base spans `assign` and `hex`), and
`endpoint` (a URL or a host with a port). Each candidate has a scope: its own span widened by `reach` code points to each
side, within its document. An interval join of scopes finds, for each candidate, the other kinds of part near it;
identifiers, weak secrets and endpoints are reported only where an identifier and a secret co-occur, endpoints only with
one of these two beside it. Scopes are joined by bins as wide as the reach; a bin keeps the least start and greatest end
of each kind, so that a text with many candidates costs one row for each of them, never their pairs.

Weak kinds begin at a word border: "monkey: banana" holds no key.

Offsets count code points, ends are exclusive. Null and empty texts have no spans; texts of any length are read whole, and
spans are placed in blocks, so that a text with many of them costs little more than their number. Repeated ids are
separate rows, null ids too. Columns beside id and text are not read, whatever their names. An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

# Fixed patterns of the base kinds. Letters of the keywords stand in either case, ASCII only.
_KEYWORD = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = _KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
# Weak kinds. Their order continues that of the base kinds.
WEAK = {
    "identifier": r"""(?<![A-Za-z0-9])(?:[Uu][Ss][Ee][Rr](?:_?[Nn][Aa][Mm][Ee])?|[Ll][Oo][Gg][Ii][Nn]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt])["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""",
    "weak_secret": r"""(?<![A-Za-z0-9])(?:[Pp][Ww][Dd]|[Pp][Aa][Ss][Ss]|[Pp][Ii][Nn]|[Kk][Ee][Yy]|[Aa][Uu][Tt][Hh])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{4,}""",
    "endpoint": r"""(?<![A-Za-z0-9])(?:https?|ftp|ssh|postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9.-]+(?::[0-9]{2,5})?|(?<![A-Za-z0-9.-])[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++:[0-9]{2,5}""",
}
KINDS = [*BASE, *WEAK]
#: Spans of one text that are placed in one fold.
BLOCK = 256


def spans(text: Column, kind: str, pattern: str) -> Column:
    """array<struct<s, o, e>>: code-point start, order of the kind, end, of each leftmost non-overlapping match.

    Pieces between the matches and the matches themselves are as many, so running sums of their lengths give the places.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.arrays_zip(F.transform(F.slice(gaps, 1, F.size(found)), F.char_length).alias("g"), F.transform(found, F.char_length).alias("m"))
    none = F.expr("cast(array() as array<struct<s:int,o:int,e:int>>)")
    order = F.lit(KINDS.index(kind))

    def step(acc, x):
        start = acc["at"] + x["g"]
        end = start + x["m"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("s"), order.alias("o"), end.alias("e")))).alias("out"))

    def block(acc, b):
        # a fold copies what it has so far with each span: blocks keep that short
        inner = F.struct(acc["at"].alias("at"), none.alias("out"))
        return F.aggregate(F.slice(lengths, b * BLOCK + 1, BLOCK), inner, step, lambda a: F.struct(a["at"].alias("at"), F.concat(acc["out"], a["out"]).alias("out")))

    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    placed = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")), start, block, lambda a: a["out"])
    # cheap tests first: what every match of the pattern holds
    may = {"access": text.contains("AKIA"), "hex": F.lit(True)}.get(kind, text.contains(":") | text.contains("="))
    return F.when(may & text.rlike(pattern), placed).otherwise(none)


def assign_spans(text: Column) -> Column:
    """As spans, without the matches whose value has fewer than six characters."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    both = F.arrays_zip(spans(text, "assign", ASSIGN).alias("p"), values.alias("v"))
    kept = F.transform(F.filter(both, lambda x: F.char_length(x["v"]) >= 6), lambda x: x["p"])
    return F.when((text.contains(":") | text.contains("=")) & text.rlike(ASSIGN), kept).otherwise(F.expr("cast(array() as array<struct<s:int,o:int,e:int>>)"))


def listed(found: Column) -> Column:
    """kind:start:end of each span, by start, then kind as listed."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", F.get(names, x["o"]), x["s"], x["e"])), ",")


def scan(docs: DataFrame, reach: int = 200, text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    The base scan has no shuffle. Only rows with weak candidates are exploded and joined, by (row, bin).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col("doc_id"), text.alias("t"))
    t = F.col("t")
    rows = rows.select("doc_id", assign_spans(t).alias("assign"), spans(t, "access", ACCESS).alias("access"), spans(t, "hex", HEX).alias("hex"), *(spans(t, k, p).alias(k) for k, p in WEAK.items()))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "spans")

    weak = rows.where(F.size("identifier") + F.size("weak_secret") + F.size("endpoint") > 0)
    candidates = weak.select("row", F.explode(F.concat("assign", "access", "hex", "identifier", "weak_secret", "endpoint")).alias("x")).select("row", "x.*").distinct()
    names = {k: i for i, k in enumerate(KINDS)}
    part = F.when(F.col("o").isin(names["access"], names["identifier"]), "identifier").when(F.col("o") == names["endpoint"], "endpoint").otherwise("secret")
    candidates = candidates.withColumn("part", part)
    # bins hold the ends of each part: least start and greatest end tell whether a scope meets one there
    bins = candidates.withColumn("bin", F.explode(F.sequence(F.floor(F.col("s") / reach), F.floor((F.col("e") - 1) / reach))))
    firsts = lambda p, f, c: f(F.when(F.col("part") == p, F.col(c)))
    held = bins.groupBy("row", "bin").agg(*(x for p in ("identifier", "secret", "endpoint") for x in (firsts(p, F.min, "s").alias(f"{p}_s"), firsts(p, F.max, "e").alias(f"{p}_e"))))
    scoped = candidates.withColumn("bin", F.explode(F.sequence(F.floor(F.greatest(F.col("s") - reach, F.lit(0)) / reach), F.floor((F.col("e") + reach - 1) / reach))))
    meets = lambda p: (F.col(f"{p}_s") < F.col("e") + reach) & (F.col(f"{p}_e") > F.col("s") - reach)
    joined = scoped.join(held, ["row", "bin"]).groupBy("row", "s", "o", "e", "part").agg(*(F.coalesce(F.bool_or(meets(p)), F.lit(False)).alias(p) for p in ("identifier", "secret", "endpoint")))
    own = F.col("o") >= len(BASE)
    linked = F.when(F.col("part") == "endpoint", F.col("identifier") | F.col("secret")).otherwise(F.col("identifier") & F.col("secret"))
    kept = joined.where(own & linked).groupBy("row").agg(F.collect_list(F.struct("s", "o", "e")).alias("weak"))
    out = rows.join(kept, "row", "left")
    base = F.concat("assign", "access", "hex")
    every = F.concat(base, F.coalesce("weak", F.expr("cast(array() as array<struct<s:int,o:int,e:int>>)")))
    count = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(every).alias("spans"), F.size(every).cast("long").alias("n_spans"))
