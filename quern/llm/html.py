"""Main text of web pages by a maximum-scoring subsequence.

A page is read as one sequence of words and tags.  Words score positive, tags negative; one linear scan over the whole
page finds the contiguous region of greatest total score, the first among equals.  Nothing but the weights
decides where it lies: ``<article>`` and ``<main>`` are tags like others there.

The weights come from labelled pages, those with exactly one ``<article>``: of every tag (with its first class, and
without) and of the words by their nearest container, ``fit`` counts on the executors how often they stand inside
and outside of the article, whose own tags count as outside.  With r = log(P(x inside) / P(x outside)) a tag weighs r, from
``LEAST_TAG`` to ``MOST_TAG``, a word r, from ``LEAST_WORD`` to ``MOST_WORD``; what no labelled page holds has the weight of ``DEFAULT``.
The labelled ones of about ``max_pages`` pages train, those of the least hash of their id; ``MAX_KEYS`` counts are kept.

Elements that never are main text score as one tag (``LEFT_OUT``), and a region that holds them goes on without them:
script, style, menus, asides, forms, footers, headers outside of an article or main, roles such as navigation, and
classes or ids that are learned (``LEARNED`` times as frequent outside of articles) or consist of words of ``NAMES``.
A p or li ends where the next tag implies it, all end with the container around them.  If all text of a page is left
out so, articles and main parts are read in spite of their names and of what is open around them.

A block is the text between tags of block elements.  Character references are decoded, white space within a block
becomes one space, ends are trimmed, empty blocks left out, the others joined by two line feeds.

Defined results: a null or empty page, or one without words, gives an empty text; broken markup is read as far
as it goes; an unclosed comment, script or style lasts to the end of the page; repeated rows give repeated rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

MAX_PAGES, MAX_KEYS, LEARNED, LEAST_SEEN = 2000, 5000, 20.0, 10
LEAST_WORD, MOST_WORD, LEAST_TAG, MOST_TAG, LEFT_OUT = 0.05, 2.0, -8.0, -0.05, -0.2

_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_RAW = {"script", "style", "textarea", "noscript", "iframe", "svg", "template", "title", "math", "object", "canvas", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_SKIP = {"head", "nav", "aside", "footer", "form", "menu", "button", "select", "dialog", "datalist", "fieldset", "label", "audio", "video"} | _RAW
_BLOCK = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"} | _SKIP
#: Blocks of _BLOCK that may stand in a p.
_INLINE = {"button", "select", "datalist", "label", "audio", "video", "script", "style", "textarea", "noscript", "iframe", "svg", "template", "title", "math", "object", "canvas", "head"}
#: Containers whose end ends whatever is open in them; lists are counted for their li.
_ENCLOSING = {"article", "main", "section", "div", "td", "li", "body", "blockquote", "ul", "ol", "menu"}
_ROOMS = {"article", "main", "section", "div", "td", "li", "body", "p", "blockquote", "h1", "h2", "h3", "a", "nav", "aside", "footer", "header", "form"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alertdialog", "alert", "toolbar"}

Token = tuple[int, str, str, bool]  # kind (0 text, 1 start, 2 end), text or tag, key of the weight, whether it is left out

#: What a class or an id says of an element without any training, if it consists of these words alone.
NAMES = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies notice newsletter nav navbar navigation promo promoted reader reply respond sidebar site footer skip social sponsored subscribe teaser user widget".split())
_TEXTUAL = {"p": -0.1, "h1": -0.1, "h2": -0.1, "h3": -0.1, "h4": -0.1, "b": -0.05, "i": -0.05, "em": -0.05, "strong": -0.05, "br": -0.05, "span": -0.05, "code": -0.05, "sub": -0.05, "sup": -0.05, "li": -0.3, "ul": -0.3, "ol": -0.3, "blockquote": -0.2, "pre": -0.2, "a": -0.5, "article": -1.0, "main": -1.0, "body": -3.0, "html": -3.0}
#: Weights of what wasn't seen in training, and of all without any.
DEFAULT = {"tags": {**dict.fromkeys(("nav", "aside", "footer", "header", "form"), -3.0), **_TEXTUAL}, "words": {"a": 0.3}, "names": NAMES, "skip": frozenset(_SKIP)}


def _classes(attributes: str) -> list[str]:
    """Names in class and id, in lower case."""
    return [n.lower() for m in _ATTR.finditer(attributes) if m[1].lower() != "role" for n in (m[2] or m[3] or m[4] or "").split()]


def _key(name: str, attributes: str) -> str:
    """A tag with its first class."""
    m = next((m for m in _ATTR.finditer(attributes) if m[1].lower() == "class"), None) if attributes else None
    value = (m[2] or m[3] or m[4] or "").split() if m else ()
    return f"{name}.{value[0].lower()[:40]}" if value else name


def _named(attributes: str, names: Iterable[str]) -> bool:
    """Whether a class, an id or a role names what never is main text."""
    if not attributes:
        return False
    if any(m[1].lower() == "role" and (m[2] or m[3] or m[4] or "").lower() in _ROLES for m in _ATTR.finditer(attributes)):
        return True
    return any(n in names or NAMES & names and all(x in names for x in re.split(r"[-_]+", n) if x) and n.strip("-_") for n in _classes(attributes))


def _ends(skip: str, name: str, closing: bool, within: Counter, rooms: list[tuple[str, str]]) -> bool:
    """Whether a tag ends an element left out that has another end: a p or li by what implies its end, any by the end of a container around it."""
    if closing:
        return name != skip and name in _ENCLOSING and not within[name] and (any(r[0] == name for r in rooms) or skip == "li" and name in ("ul", "ol"))
    if skip == "p":
        return name in _BLOCK - _INLINE
    return skip == "li" and name == "li" and not within["ul"] and not within["ol"] and not within["menu"]


def tokens(page: str, weights: dict = DEFAULT, trust: bool = True) -> list[Token]:
    """Texts and tags of a page; without trust, articles and main parts end what is left out and aren't for their names."""
    out: list[Token] = []
    rooms: list[tuple[str, str]] = []
    names, skipped = weights["names"], weights["skip"]
    skip, depth, inside, at, end = "", 0, 0, 0, len(page)
    within: Counter = Counter()  # containers open in the element left out
    lower = None

    def room() -> str:
        return rooms[-1][1] if rooms else "body"

    while at < end:
        i = page.find("<", at)
        if i < 0:
            i = end
        if i > at:
            out.append((0, page[at:i], room(), bool(skip)))
        if i == end:
            break
        m = _TOKEN.match(page, i)
        if not m:
            out.append((0, "<", room(), bool(skip)))
            at = i + 1
            continue
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if name in _RAW:
            if not closing:
                if lower is None:
                    lower = page.lower()
                found = lower.find("</" + name, at)
                if found < 0:
                    break
                at = found
            continue
        key = _key(name, attributes)
        if skip and not trust and name in ("article", "main") and not closing or skip and _ends(skip, name, closing, within, rooms):
            skip, depth = "", 0
        starts = False
        if skip:
            if name in _ENCLOSING:
                within[name] += -1 if closing and within[name] else 0 if closing else 1
            if name == skip:
                depth += -1 if closing else 1
                if depth == 0:
                    skip = ""
                    out.append((2, name, key, True))
                    continue
            elif name in ("body", "html") or skip == "head" and name not in ("meta", "link", "base"):
                skip, depth = "", 0
        elif not closing and name not in _VOID and not attributes.rstrip().endswith("/"):
            marked = name in ("article", "main")
            starts = name in skipped or name == "header" and not inside and bool(skipped) or name not in ("body", "html") and (trust or not marked) and _named(attributes, names)
            if starts:
                skip, depth, within = name, 1, Counter()
        if name in ("article", "main"):
            inside = max(0, inside + (-1 if closing else 1))
        if not skip and name in _ROOMS and name not in _VOID:
            if not closing:
                if name in _BLOCK:
                    while rooms and rooms[-1][0] in ("a", "p"):  # neither holds blocks here, or they weren't closed
                        rooms.pop()
                rooms.append((name, key))
            elif any(r[0] == name for r in rooms):
                while True:
                    r = rooms.pop()
                    if r[0] == name:
                        key = r[1]
                        break
        out.append((2 if closing else 1, name, key, bool(skip) and not starts))
        if starts:
            out[-1] = (1, "hr", "", False)  # the element as a whole
    return out


def observed(page: str | None) -> Counter:
    """(what, key, whether inside) -> count, of a page with exactly one article; what is tag, word or name."""
    out: Counter = Counter()
    if not page or len(re.findall(r"<article[\s>]", page, re.I)) != 1:
        return out
    inside = False
    for kind, value, key, _ in tokens(page, {"names": frozenset(), "skip": frozenset()}):
        if kind and value == "article":
            inside = kind == 1
            out["tag", key, False] += 1
        elif kind:
            out["tag", key, inside] += 1
            if key != value:
                out["name", key.partition(".")[2], inside] += kind == 1
        else:
            out["word", key, inside] += len(value.split())
    return out


def weigh(counts: Counter) -> dict:
    """Weights of observed counts."""
    sums = Counter()
    for (what, _, inside), n in counts.items():
        sums[what, inside] += n
    keys = {k[:2] for k in counts}

    def ratio(what: str, key: str) -> float:
        return math.log((counts[what, key, True] + 0.5) / (sums[what, True] + 1)) - math.log((counts[what, key, False] + 0.5) / (sums[what, False] + 1))

    tags = {k: max(LEAST_TAG, min(MOST_TAG, ratio(w, k))) for w, k in keys if w == "tag"}
    words = {k: max(LEAST_WORD, min(MOST_WORD, ratio(w, k))) for w, k in keys if w == "word"}
    noise = {k for w, k in keys if w == "name" and counts[w, k, False] >= max(LEAST_SEEN, LEARNED * counts[w, k, True])}
    return {"tags": DEFAULT["tags"] | tags, "words": DEFAULT["words"] | words, "names": NAMES | noise, "skip": DEFAULT["skip"]}


def train(pages: Iterable[str | None]) -> dict:
    """Weights from pages in memory."""
    counts: Counter = Counter()
    for page in pages:
        counts.update(observed(page))
    return weigh(counts)


def scores(found: list[Token], weights: dict) -> list[float]:
    """What every token adds to a region."""
    tags, words = weights["tags"], weights["words"]
    out = []
    for kind, value, key, out_ in found:
        if out_:
            out.append(0.0)
        elif kind == 0:
            n = len(value.split())
            out.append(n * (words[key] if key in words else words.get(key.partition(".")[0], 1.0)) if n else 0.0)
        elif value == "hr":
            out.append(LEFT_OUT)
        else:
            out.append(tags[key] if key in tags else tags.get(value, -1.0))
    return out


def region(found: list[Token], weights: dict) -> tuple[int, int]:
    """(first token, end) of the contiguous region of greatest score, by one linear scan; the first and shortest among equals."""
    best, span, score, begin = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores(found, weights)):
        score += x
        if score > best:
            best, span = score, (begin, i + 1)
        if score <= 0:
            score, begin = 0.0, i + 1
    return span


def _blocks(found: list[Token], first: int, last: int) -> list[str]:
    out, part = [], []

    def close():
        if part:
            said = " ".join(unescape("".join(part)).split())
            if said:
                out.append(said)
            part.clear()

    for kind, value, _, left_out in found[first:last]:
        if left_out:
            continue
        if kind == 0:
            part.append(value)
        elif value == "br":
            part.append(" ")
        elif value in _BLOCK:
            close()
    close()
    return out


def extract(page: str | None, weights: dict = DEFAULT) -> str:
    """The main text of a page; empty if there is none."""
    if not page:
        return ""
    for trust in (True, False):
        found = tokens(page, weights, trust)
        blocks = _blocks(found, *region(found, weights))
        if blocks or not re.search(r"<(?:article|main)[\s>]", page, re.I):
            break
    return "\n\n".join(blocks)


def fit(pages: DataFrame, key: str = "page_id", html: str = "html", max_pages: int = MAX_PAGES) -> dict:
    """Train on the labelled ones of about max_pages pages, those of the least hash of their id.

    The hash's limit follows from the number of pages.  Counts are added up on the executors; the driver gets the MAX_KEYS
    most frequent of each kind, so pages don't leave the scan."""
    n = pages.count()
    share = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
    chosen = pages.where(share <= max_pages / max(1, n)) if n > max_pages else pages
    arrow = pa.schema([("what", pa.string()), ("name", pa.string()), ("inside", pa.bool_()), ("n", pa.int64())])

    def make():
        def work(cols):
            counts: Counter = Counter()
            for page in cols[0]:
                counts.update(observed(page))
            return [list(c) for c in zip(*((*k, v) for k, v in counts.items()), strict=True)] if counts else [[] for _ in arrow]

        return work

    rows = map_rows(chosen.select(F.col(html).alias("html")), make, "what string, name string, inside boolean, n bigint", arrow)
    per = rows.groupBy("what", "name").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("i"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("o"))
    counts: Counter = Counter()
    for what in ("tag", "word", "name"):
        for r in per.where(F.col("what") == what).orderBy(F.desc(F.col("i") + F.col("o")), "name").limit(MAX_KEYS).collect():
            counts.update({(what, r.name, True): r.i, (what, r.name, False): r.o})
    return weigh(counts)


def main_text(pages: DataFrame, weights: dict, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text and n_chars of every page."""
    arrow = pa.schema([("key", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def make():
        def work(cols):
            said = [extract(p, weights) for p in cols[2]]
            return [cols[0], cols[1], said, list(map(len, said))]

        return work

    rows = pages.select(F.col(key).cast("bigint").alias("key"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return map_rows(rows, make, "key bigint, url string, text string, n_chars bigint", arrow).withColumnRenamed("key", key)
