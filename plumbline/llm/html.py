"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive (words inside links less, or negative), tags negative; a
linear scan finds the contiguous region with the greatest sum. The weights come from pages that mark their content with
<article> or <main>: a tag that is rarer inside than outside costs more, and a linked word counts by its log odds. They
are counted where the pages lie; only one row a tag name reaches the driver.

Elements that are never text (scripts, styles, titles, ...) are left out. Elements that by their name or by a token of
their class, id or role say that they are no main text (menus, headers, footers, forms, asides, adverts, notices,
comments) are breaks in the sequence, and end any region, unless they hold every <article> and <main> of the page or, on a
page without those, nearly all of its words: a form or wrapper around the whole page is unwrapped, and what it holds is judged in its place. Tokens of
layout (has-sidebar, no-header, with-nav) mean nothing. A header inside an article goes too, but for its headings.
Headings are never cut by class, id or role. Tokens that a text may be about just as well (search, related, menu, ...)
cut a paragraph, or a section by its id, only where most of its words are linked, and no other element of an article
that holds most of the article's words.

The region grows to all of the smallest article or main around it, with the mostly unlinked articles beside it (of one
parent: two stories of a page are both its text) and the h1 that stands before it in its main. A run over several
articles takes them whole. Where there is none, it grows to whole blocks, and
over neighbouring blocks as long as they are mostly unlinked words in a text element (p, h1..h6, li, ...) or in elements
nested like those of the region; breaks are skipped, so that an advert does not end an article.

Tags are read as HTML does: a quote opens a value only after "=" (and only if it is closed somewhere), a stray one is part
of a name. End tags that HTML lets authors omit (p, li, td, ...) are implied. Null and empty pages give an empty text. Cut-off pages
are read as far as they go, and pages of any length whole. Repeated rows, also of one id, and null ids are separate rows.
Ties go to the first region. Columns beside id, url and html are not read, whatever their names. An empty table gives an
empty result.
"""

from __future__ import annotations

import heapq
import html as entities
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices

#: Elements whose content is never text of the page.
SILENT = frozenset("script style noscript template title textarea select option button input iframe object embed svg canvas audio video dialog".split())
#: Elements that are no main text by their name.
ASIDE = frozenset("nav aside footer form menu header".split())
#: Tokens, or parts of them between hyphens and underscores, of class, id and role that say the same.
BOILERPLATE = re.compile(r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|alert|sidebar|menu|nav|navbar|navigation|breadcrumbs?|header|masthead|footer|comments?|respond|reply|replies|disqus|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|popup|modal|overlay|pagination|pager|search|widget|toolbar|skip|complementary|contentinfo)", re.I)
#: Those that never wrap a page, and make an article one of a reader.
COMMENT = re.compile(r"comments?|respond|reply|replies", re.I)
#: Those of BOILERPLATE that a text may be about, or that wrap texts.
TOPICAL = re.compile(r"banner|menu|nav|navbar|navigation|header|masthead|sharing|share|social|related|recommend\w*|search|widget|toolbar|skip|overlay|modal|popup", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: First parts of tokens that speak of the layout, not of the element.
LAYOUT = frozenset("has with without no is show hide wide full one two three".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that hold running text.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt figcaption caption td th".split())
#: Elements that a start tag ends if they are open, and the elements up to which that reaches.
BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"td", "th", "tr"}, {"table"}), "tbody": ({"td", "th", "tr", "thead", "tbody"}, {"table"}), "tfoot": ({"td", "th", "tr", "thead", "tbody"}, {"table"})}
#: An attribute: its name, and its value in double, single or no quotes. Nothing is given back, so that it is linear.
ATTRIBUTE = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*"|'[^']*'|[^\s>]*+))?+"""
TAG = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?=[^a-zA-Z])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{ATTRIBUTE})*+)(?:>|\Z)", re.S)
NAMED = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]*+)))?+""")
#: Used where no page marks its content.
DEFAULT_WEIGHTS = {"word": 1.0, "link_word": -1.0, "tag": -2.0}
#: A wrapper of boilerplate name is unwrapped if fewer unlinked words than this share of all stay outside of such elements.
LEAST_OUTSIDE = 0.1


class Element:
    """An element with its parent, the aside around it, whether an article is around it, and the names above it as one hash."""

    __slots__ = ("name", "parent", "aside", "outer", "inside", "around", "path", "words", "linked", "articles")

    def __init__(self, name: str, parent: Element | None, aside: int):
        self.name, self.parent, self.aside, self.words, self.linked = name, parent, aside, 0, 0
        self.articles = int(name in ("article", "main") and not aside)
        self.outer = parent and (parent if parent.aside else parent.outer)
        self.inside = bool(self.articles) or parent is not None and parent.inside
        self.around = self if self.articles else parent and parent.around  # the smallest article or main, itself included
        self.path = hash((parent.path, name)) if parent else 0


def says_aside(name: str, attributes: str) -> int:
    """Whether an element's name, class, id or role says that it is no main text: 0 if not, 2 if it does and never wraps
    the page, 1 if it may, 3 if only topical tokens say so, and 4 if they stand at running text or are a section's id."""
    if name in ASIDE:
        return 1 if name in ("form", "header") else 2
    if name in ("body", "html", "main") or name in HEADINGS or not attributes:
        return 0
    said = set()
    for key, *values in NAMED.findall(attributes):
        key = key.lower()
        for token in "".join(values).split() if key in ("class", "id", "role") else ():
            parts = [x for x in re.split(r"[-_]+", token) if x]
            if parts and parts[0].lower() not in LAYOUT:
                if any(COMMENT.fullmatch(x) for x in parts):
                    return 2
                named = [x for x in parts if BOILERPLATE.fullmatch(x)] if name != "article" else []
                if any(not TOPICAL.fullmatch(x) for x in named):
                    said.add(1)
                elif named:
                    said.add(4 if name in ("p", "blockquote", "pre") or name == "section" and key == "id" else 3)
    return min(said, default=0)


def parse(page: str) -> list[tuple]:
    """Events in page order: ('text', decoded text, in a link, element) and ('open', 'close' or 'void', name, element)."""
    out: list[tuple] = []
    here = Element("", None, 0)
    opened: Counter = Counter()
    links, at, n = 0, 0, len(page)

    def text(piece: str) -> None:
        if piece:
            piece = entities.unescape(piece) if "&" in piece else piece
            if links:
                here.linked += len(piece.split())
            else:
                here.words += len(piece.split())
            out.append(("text", piece, links > 0, here))

    def close() -> None:
        nonlocal here, links
        out.append(("close", here.name, here))
        opened[here.name] -= 1
        if here.name == "a":
            links = max(0, links - 1)
        up = here.parent
        up.words += here.words
        up.linked += here.linked
        up.articles += here.articles
        here = up

    def close_open(names, stop) -> None:
        """End the innermost open element of `names`, with what it holds, unless one of `stop` stands between."""
        if not any(opened[x] for x in names):
            return
        e = here
        while e.parent is not None and e.name not in names and e.name not in stop:
            e = e.parent
        if e.parent is not None and e.name in names:
            while here is not e.parent:
                close()

    while at < n:
        m = TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            close_open({name}, ())
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            out.append(("void", name, here))
            continue
        if name in BLOCKS:
            close_open({"p"}, {"td", "th", "li", "dd", "dt", "button", "object"})
        if name in IMPLIED:
            close_open(*IMPLIED[name])
        if name in VOID or m[0].endswith("/>"):
            out.append(("void", name, here))
            continue
        if name == "a":
            links += 1
        here = Element(name, here, 2 if name in SILENT else says_aside(name, m[3] or ""))
        opened[name] += 1
        out.append(("open", name, here))
    while here.parent is not None:
        close()
    return out


def no_break(x: Element) -> bool:
    """Whether an element named by topical tokens is text all the same, by what it holds."""
    if x.aside == 4:
        return x.words >= x.linked
    if x.aside == 3 and x.inside:
        return 2 * x.words > x.around.words
    return False


def breaks(events: list[tuple]) -> set[Element]:
    """The outermost elements that are no main text: those that say so, but for wrappers of all articles or of the whole page."""
    if not events:
        return set()
    top = [e[2] for e in events if e[0] == "open" and e[2].aside]
    within: dict[Element | None, list[Element]] = {}
    for x in top:
        within.setdefault(x.outer, []).append(x)
    root = events[0][3] if events[0][0] == "text" else events[0][2]
    while root.parent is not None:
        root = root.parent
    # what holds every article is no break; without articles the largest one is what the page is about, if little is outside
    found, heap, outside, total = set(), [], root.words, root.words
    todo = list(within.get(None, ()))
    while todo or heap and not root.articles and outside < LEAST_OUTSIDE * total:
        if not todo:
            x = heapq.heappop(heap)[2]
            found.discard(x)
            outside += x.words
            todo = list(within.get(x, ()))
            continue
        x = todo.pop()
        if root.articles and x.articles == root.articles and x.name not in SILENT or no_break(x):
            todo += within.get(x, ())
            continue
        found.add(x)
        outside -= x.words
        if x.aside == 2:
            total -= x.words
        elif x.words:
            heapq.heappush(heap, (-x.words, len(heap), x))
    return found


def scan(scores: list[float]) -> tuple[int, int]:
    """First and last + 1 place of the contiguous run with the greatest sum above 0, the first of equals; (0, 0) if none."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, best_at = total, (start, i + 1)
    return best_at


def pieces(page: str, weights: dict[str, float]) -> list[tuple]:
    """Events without what breaks hold: each break is one ('cut', -, -); headings of headers inside articles stay."""
    events = parse(page)
    cut = breaks(events)
    out, skipping, heading = [], None, None
    for e in events:
        element = e[3] if e[0] == "text" else e[2]
        if skipping is None and e[0] == "open" and element in cut:
            skipping = element
            out.append(("cut", "", element))
        if skipping is None:
            out.append(e)
            continue
        if skipping.name == "header":
            if heading is None and e[0] == "open" and e[1] in HEADINGS and skipping.inside:
                heading = element
            if heading is not None:
                out.append(e)
                if e[0] == "close" and element is heading:
                    heading = None
        if e[0] == "close" and element is skipping:
            skipping = None
    return out


def score(event: tuple, weights: dict[str, float]) -> float:
    if event[0] == "text":
        return len(event[1].split()) * weights["link_word" if event[2] else "word"]
    if event[0] == "cut":
        return 4 * weights["tag"]
    return weights.get(event[1], weights["tag"])


def block_of(element: Element) -> Element:
    """The innermost element of a text that is no inline one."""
    while element.parent is not None and element.name in INLINE:
        element = element.parent
    return element


def blocks(events: list[tuple]) -> list[list]:
    """[first, last + 1, words, linked words, element] of every run of texts within one block element."""
    out: list[list] = []
    held = None
    for i, e in enumerate(events):
        if e[0] == "text":
            element, n = block_of(e[3]), len(e[1].split())
            if held is element:
                out[-1][1] = i + 1
                out[-1][2] += n
                out[-1][3] += n if e[2] else 0
            elif n:
                out.append([i, i + 1, n, n if e[2] else 0, element])
                held = element
        elif e[0] == "cut" or e[1] not in INLINE and e[0] != "void":
            held = None
    return out


def regions(events: list[tuple], weights: dict[str, float]) -> list[tuple[int, int]]:
    """First and last + 1 events of the main text, in page order: the best run, grown to its articles, with those beside
    them and the h1 before them, or to whole neighbouring blocks."""
    first, last = scan([score(e, weights) for e in events])
    if first == last:
        return []
    texts = [e[3] for e in events[first:last] if e[0] == "text" and not e[1].isspace()]
    starts = {e[2]: i for i, e in enumerate(events) if e[0] == "open"}
    ends = {e[2]: i + 1 for i, e in enumerate(events) if e[0] == "close"}
    head, tail = texts[0].around, texts[-1].around
    if head is not None:
        e = head
        while e is not None and not (e.articles and e.name in ("article", "main") and ends.get(e, 0) >= last):
            e = e.parent
        if e is None:  # a run over several articles
            return [(starts[head], max(last, ends[tail] if tail is not None else 0))]
        beside = [x for x in starts if x.name == "article" and not x.aside and x.parent is e.parent and x in ends and (x is e or x.words > x.linked)] if e.name == "article" else [e]
        out = [(starts[x], ends[x]) for x in beside]
        around = e.parent.around
        if around is not None:
            out += [(starts[x], ends[x]) for x in starts if x.name == "h1" and x in ends and starts[x] < out[0][0] and x.around is around]
        return sorted(out)
    found = blocks(events)
    at = [k for k, b in enumerate(found) if b[0] < last and b[1] > first]
    low, high = at[0], at[-1]
    nested = {found[k][4].path for k in at}

    def fits(b) -> bool:
        return b[3] * 2 < b[2] and (b[4].name in TEXTUAL or b[4].path in nested) and not b[4].inside

    while low > 0 and fits(found[low - 1]):
        low -= 1
    while high + 1 < len(found) and fits(found[high + 1]):
        high += 1
    return [(min(found[low][0], first), max(found[high][1], last, ends[tail] if tail is not None else 0))]


def main_text(page: str | None, weights: dict[str, float]) -> str:
    if not page:
        return ""
    events = pieces(page, weights)
    out = []
    for first, last in regions(events, weights):
        for e in events[first:last]:
            if e[0] == "text":
                out.append(e[1])
            elif e[0] == "cut" or e[1] not in INLINE:
                out.append(" ")
    return " ".join("".join(out).split())


def page_counts(page: str) -> dict[tuple[bool, str], int]:
    """How often words, linked words and tags stand inside and outside the article or main of a page; {} without one."""
    events = parse(page)
    if not any(e[0] == "open" and e[1] in ("article", "main") for e in events):
        return {}
    seen: Counter = Counter()
    for e in events:
        element = e[3] if e[0] == "text" else e[2]
        if e[0] == "text":
            seen[element.inside, "link_word" if e[2] else "word"] += len(e[1].split())
        elif e[1] not in ("article", "main") and len(e[1]) <= 16:  # longer names are no HTML
            seen[element.inside, e[1]] += 1
    return dict(seen)


def fit_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = 400) -> dict[str, float]:
    """Weights from at most `sample` distinct pages, those with the smallest hashes, where they mark their content."""
    h = F.xxhash64(id_col, html_col)
    marked = pages.where(F.col(html_col).rlike("(?i)<(?:article|main)[ >]"))
    low = marked.select(h.alias("h")).distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if low is None:
        return DEFAULT_WEIGHTS

    def count(batches):
        import pyarrow as pa

        for b in (x for batch in batches for x in byte_slices(batch)):
            seen: Counter = Counter()
            for page in b.column(0).to_pylist():
                seen.update(page_counts(page))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.bool_()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["inside", "name", "n"])

    rows = marked.where(h <= low).select(F.col(html_col).cast("string").alias("html")).mapInArrow(count, "inside boolean, name string, n long")
    found = rows.groupBy("name").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("b")).collect()
    seen = {True: {r.name: r.a for r in found}, False: {r.name: r.b for r in found}}
    if not seen[True].get("word"):
        return DEFAULT_WEIGHTS
    total = {side: sum(c.values()) + 1.0 for side, c in seen.items()}
    odds = {k: math.log((seen[True][k] + 1) / total[True]) - math.log((seen[False][k] + 1) / total[False]) for k in seen[True]}
    # a word counts 1; a tag costs 0.5 to 8 words, by how strange it is to content
    out = {k: -min(8.0, max(0.5, 1.0 - v)) for k, v in odds.items() if k not in ("word", "link_word")}
    return out | {"tag": DEFAULT_WEIGHTS["tag"], "word": 1.0, "link_word": max(-4.0, min(0.5, odds.get("link_word", -1.0)))}


def extract(pages: DataFrame, weights: dict[str, float] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages; no shuffle."""
    w = weights or fit_weights(pages, id_col, html_col)

    def run(batches):
        import pyarrow as pa

        for b in (x for batch in batches for x in byte_slices(batch, 2)):
            texts = [main_text(x, w) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
