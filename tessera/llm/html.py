"""Main text of web pages: the contiguous region with the greatest score."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept, stable, table

# Element names by their part in a page.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "select", "summary",
    "table", "tbody", "td", "template", "tfoot", "th", "thead", "tr", "ul", "title", "textarea", "noscript",
}
BOILERPLATE = {"script", "style", "noscript", "template", "head", "title", "nav", "menu", "footer", "aside", "form", "button", "select", "textarea", "input", "label", "fieldset", "iframe", "dialog", "search", "svg", "canvas", "object", "noembed", "noframes"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
INLINE = {
    "a", "abbr", "acronym", "audio", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "map", "mark", "math", "meter", "nobr", "output", "picture", "progress", "q", "rp", "rt",
    "ruby", "s", "samp", "slot", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "video", "button", "label", "svg", "canvas", "object",
}
# Prior weights of words of class and id attributes. MARKS speak for a part that is no article,
# PLAIN say nothing; any other word speaks for text until the pages tell otherwise.
MARKS = {
    "ad", "ads", "advert", "advertisement", "adverts", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disclaimer", "discussion", "disqus",
    "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "overlay", "pager", "pagination", "popup", "promo", "promoted", "recommended",
    "related", "reply", "replies", "respond", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget",
}
PLAIN = {
    "area", "article", "articles", "bar", "block", "bottom", "box", "btn", "button", "buttons", "col", "column", "container", "element", "form", "global", "group", "icon", "icons", "inner", "item", "items", "label", "left",
    "link", "links", "list", "main", "module", "outer", "page", "panel", "post", "posts", "primary", "reader", "readers", "right", "row", "secondary", "section", "site", "slot", "top", "unit", "user", "users", "wrap", "wrapper",
}
ARTICLE = {"article", "main"}
#: Pages that weights are learned from: one for each range of 12 bits of the md5 of the html.
LABELLED = 4096
WORD_PRIOR, TAG_PRIOR, BOILERPLATE_PRIOR = 1.0, -0.5, -1.0
#: A word of class attributes is learned from if this part of the labelled pages has it; so many words at most are 100 times those of a mean page.
CLASS_SHARE = 0.01

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'<]|"[^"<]*"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>|<[/a-zA-Z!?][^>]*\Z""", re.S)
_CLOSE = {name: re.compile(rf"</{name}[\s/>]", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def class_prior(word: str) -> float:
    return -1.0 if word in MARKS else 0.0 if word in PLAIN else 1.0


def _classes(name: str, attributes: str) -> tuple[str, tuple[str, ...]]:
    """Why an element is no article content by its name or role (empty if it may be), and the words of its class and id."""
    if name in BOILERPLATE:
        return name, ()
    if name in ("html", "body", "main") or "=" not in attributes:
        return "", ()
    words: list[str] = []
    for key, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values)
        if key.lower() == "role":
            if value.lower() in ROLES:
                return f"role={value.lower()}", ()
        else:
            words += [w.lower() for w in _PARTS.findall(value)]
    return "", tuple(dict.fromkeys(words))


def _speaks_against(name: str, words: tuple[str, ...], classes: dict[str, float]) -> bool:
    """Whether the words of an element's class and id, taken together, mark it as no article; an article is only marked by being a comment or an advert."""
    if name == "article":
        words = tuple(w for w in words if w in ("comment", "comments", "reply", "ad", "ads") or class_prior(w) > 0)
    return sum(classes.get(w, class_prior(w)) for w in words) < 0


Piece = tuple[str, str, str, bool, tuple[str, ...]]


class _Open:
    """An open element with what its content inherits, so that no tag looks further up than its parent."""

    __slots__ = ("article", "classes", "header", "name", "reason")

    def __init__(self, name: str, attributes: str, parent: _Open | None, weights: dict[str, float]):
        self.name = name
        own, words = _classes(name, attributes)
        if not own and words and _speaks_against(name, words, weights):
            own = "class"
        starts = name in ARTICLE and not own
        self.article = starts or parent is not None and parent.article and not own
        self.reason = "" if starts else own or (parent.reason if parent else "")
        self.header = not starts and (name == "header" or parent is not None and parent.header)
        if self.header and not self.article and not self.reason:
            self.reason = "header"
        self.classes = words or (parent.classes if parent and not starts else ())


def tokens(page: str, classes: dict[str, float] = {}) -> Iterator[Piece]:  # noqa: B006
    """(feature, text, block mark, inside an article, words of the nearest class) of tags and texts in page order, in linear time.

    A text's feature names the boilerplate it stands in or else its nearest element; the block mark is
    "|" at tags that end a block. Elements that HTML does not know share one name. Whether the words of a class speak
    for boilerplate is told by their weights. An article or main element starts anew, whatever was left open before it.
    """
    stack: list[_Open] = []
    names: Counter[str] = Counter()

    def text(raw: str) -> Piece:
        top = stack[-1] if stack else None
        feature = f"!{top.reason}" if top and top.reason else f"w:{_known(top.name) if top else ''}"
        return feature, html.unescape(raw) if "&" in raw else raw, "", bool(top and top.article and not top.reason), top.classes if top else ()

    def pop() -> str:
        name = stack.pop().name
        names[name] -= 1
        return name

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            yield text(page[at:])
            return
        if m.start() > at:
            yield text(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[4]), (m[3] or m[6] or "")
        if closing:
            if names[name]:
                while pop() != name:
                    pass
        elif name in RAW:
            found = _CLOSE[name].search(page, at)
            at = found.start() if found else end
        elif name not in VOID:
            if name in BLOCK and stack and stack[-1].name == "p":
                pop()
            if name in ("li", "option", "dt", "dd", "tr", "td", "th", "p"):
                for depth in range(1, min(3, len(stack)) + 1):
                    if stack[-depth].name == name:
                        for _ in range(depth):
                            pop()
                        break
                    if stack[-depth].name in BLOCK:
                        break
            if not attributes.endswith("/"):
                stack.append(_Open(name, attributes, stack[-1] if stack else None, classes))
                names[name] += 1
        tag = _known(name)
        yield f"</{tag}>" if closing else f"<{tag}>", " " if name == "br" else "", "|" if name in BLOCK else "", bool(stack and stack[-1].article), ()


def _known(name: str) -> str:
    return name if name in BLOCK or name in INLINE or name in VOID or name in RAW or name in BOILERPLATE or name in ARTICLE else "?"


def _is_tag(feature: str) -> bool:
    return feature.startswith("<")


def prior(feature: str) -> float:
    return TAG_PRIOR if _is_tag(feature) else BOILERPLATE_PRIOR if feature.startswith("!") else WORD_PRIOR


@dataclass
class Weights:
    """Weights of tags and texts by feature, and of words of class and id attributes."""

    features: dict[str, float] = field(default_factory=dict)
    classes: dict[str, float] = field(default_factory=dict)


def weigh_classes(inside: dict[str, float], outside: dict[str, float]) -> dict[str, float]:
    """Weights of class words from the words of text below them inside and outside articles: log odds drawn to the prior by ten pseudo-counts, between -1 and 1."""
    total_in, total_out = sum(inside.values()) + 1, sum(outside.values()) + 1
    out = {}
    for w in inside.keys() | outside.keys():
        a, b = inside.get(w, 0), outside.get(w, 0)
        odds = math.log((a + 0.5) / total_in) - math.log((b + 0.5) / total_out)
        out[w] = max(-1.0, min(1.0, (odds * (a + b) + class_prior(w) * 10) / (a + b + 10)))
    return out


def weigh(inside: dict[str, float], outside: dict[str, float]) -> dict[str, float]:
    """Weights from counts of each feature inside and outside the articles of labelled pages.

    A weight is the log odds, drawn to the feature's prior by ten pseudo-counts, between -1 and 2: a
    word of text may count twice what a word of boilerplate takes, so advertisements do not cut an article. Tags stay negative and words outside boilerplate stay positive
    unless the pages say otherwise.
    """
    total_in, total_out = sum(inside.values()) + 1, sum(outside.values()) + 1
    out = {}
    for f in inside.keys() | outside.keys():
        a, b, p = inside.get(f, 0), outside.get(f, 0), prior(f)
        odds = math.log((a + 0.5) / total_in) - math.log((b + 0.5) / total_out)
        weight = (odds * (a + b) + p * 10) / (a + b + 10)
        out[f] = max(-1.0, min(-0.05, weight)) if _is_tag(f) or f.startswith("!") else max(-1.0, min(2.0, weight))
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """Half-open bounds of the contiguous stretch with the greatest positive sum, the first and longest of equals; (0, 0) if there is none."""
    best, bounds, run, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, bounds = run, (start, i + 1)
    return bounds


def main_text(page: str | None, weights: Weights) -> str:
    """Blocks of the best region, one a line."""
    if not page:
        return ""
    pieces = list(tokens(page, weights.classes))
    words = [0 if _is_tag(p[0]) else len(p[1].split()) for p in pieces]
    scores = [(weights.features.get(p[0], prior(p[0])) * (1 if _is_tag(p[0]) else n)) for p, n in zip(pieces, words, strict=True)]
    start, end = best_region(scores)
    blocks, own = [], []
    for feature, text, mark, *_ in pieces[start:end]:
        if mark:
            blocks.append("".join(own))
            own = []
        elif feature[0] != "!":
            own.append(text)
    blocks.append("".join(own))
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def count_features(pages: list[str]) -> tuple[int, dict[str, list[int]]]:
    """Labelled pages, and [inside, outside, pages] of each feature and class word (written .word): tags once each, texts by their words.

    Text in parts that their name, role or class marks as no article counts as outside wherever it stands.
    """
    labelled, counts = 0, {}
    for page in pages:
        pieces = list(tokens(page))
        if not any(p[3] for p in pieces):
            continue
        labelled += 1
        seen: set[str] = set()
        for feature, text, _, article, classes in pieces:
            n = 1 if _is_tag(feature) else len(text.split())
            for f in (feature, *(f".{c}" for c in classes)):
                own = counts.setdefault(f, [0, 0, 0])
                own[0 if article else 1] += n
                own[2] += f not in seen
                seen.add(f)
    return labelled, counts


def fit(pages: DataFrame, html_col: str = "html") -> Weights:
    """Learn weights from pages that label themselves with an article or main element.

    At most LABELLED pages are read: of each range of the md5 of the html the page with the least. The hashes
    are reduced first, so at most LABELLED of them are broadcast and only their pages are shuffled, copies once a task.
    Names of elements that HTML does not know are one feature, and words of classes need CLASS_SHARE of the pages, so what reaches the
    driver is bounded. Pages without such an element, null and empty ones teach nothing; without any, the priors hold.
    """
    slim = pages.select(F.md5(F.col(html_col).cast("binary")).alias("h"), F.col(html_col).alias("html")).filter("length(html) > 0")
    least = slim.groupBy(F.substring("h", 1, 3).alias("range")).agg(F.min("h").alias("h")).select("h")
    some = slim.join(F.broadcast(least), "h").groupBy("h").agg(F.min("html").alias("html")).select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labelled, counts = count_features(b.column(0).to_pylist())
            rows = [("", labelled, 0, 0), *((f, *own) for f, own in counts.items())]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *[pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3)]], names=["feature", "a", "b", "pages"])

    counts = stable(some.mapInArrow(run, "feature string, a long, b long, pages long").groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("a", "b", "pages")]))
    labelled = sum(r["a"] for r in counts.filter("feature = ''").collect())
    got = counts.filter((F.col("feature") != "") & (~F.col("feature").startswith(".") | (F.col("pages") >= CLASS_SHARE * labelled))).collect()
    words = [{r["feature"][1:]: r[k] for r in got if r["feature"][0] == "."} for k in ("a", "b")]
    return Weights(weigh(*[{r["feature"]: r[k] for r in got if r["feature"][0] != "."} for k in ("a", "b")]), weigh_classes(*words))


def extract(pages: DataFrame, weights: Weights, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """Main text of whole pages by the maximum-scoring subsequence of words (positive) and tags (negative).

    One linear scan finds the contiguous region whose weights sum to most. Parts inside it that are no
    article (navigation, page headers, footers, asides, forms, scripts, styles, and elements whose role or words of class and
    id, weighed together, say menu, notice, advert, comment and the like) score negative and are left out of the text. Character
    references are decoded, white space in a block (br included) becomes one space, and blocks are joined by a line end.

    Result: one row per row of pages: page_id, the columns named in keep (NAME_kept if they bear the name of
    another column of the result), text, n_chars. Null and empty pages have empty text; repeated rows each get
    their row; an empty table gives an empty result.
    """
    slim = pages.select(F.col(id_col).alias("page_id"), *kept(keep, ("page_id", "text", "n_chars", "__html")), F.col(html_col).alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                texts = [main_text(p, weights) for p in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*part.schema.names[:-1], "text", "n_chars"])

    return slim.mapInArrow(run, T.StructType([*slim.drop("__html").schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))


def op1_max_subsequence(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages), keep=("url",))
