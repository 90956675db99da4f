"""Main text of web pages: streaming parser events, text-to-tag ratio per line, smoothing, threshold clusters.

The parser turns a page into lines, one for each block, and knows of each which elements it stands in. Lines in
menus, adverts and the like are out by their element; a form or an element's class is evidence only, which the page's
dense text can outweigh. Of the other lines, the text-to-tag ratio smoothed by a Gaussian tells dense from sparse ones;
where the dense text gathers is the content region, an article or main element if one holds it, and all of its lines are
the article, short ones too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship

# Element names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
APART = set("td th br option".split())
SILENT = set("audio button canvas datalist dialog embed head iframe input map menu nav noembed noframes noscript object option script select style svg template textarea title video aside footer".split())
CONTAINERS = set("article body center div main section table td tr tbody ul ol dl form details".split())
ENDS_PARAGRAPH = BLOCKS - {"body", "html", "caption", "legend", "summary", "tbody", "tfoot", "thead", "tr"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "p": {"div", "article", "section", "td", "li", "blockquote", "main", "body", "table"}}
#: Words in an element's class, id or role that say it isn't part of the article.
NAMES = (
    r"ads?|adverts?|advertisement|adsense|sponsor(?:ed)?|promo(?:tion)?|banner|breadcrumbs?|comments?|commentlist|disqus|replies|respond|cookies?(?:bar|banner|notice)?|consent|gdpr|notices?|"
    r"alert|popup|modal|overlay|dialog|newsletter|subscribe|subscription|signup|login|search|searchbox|share|sharing|social|sidebar|side|widgets?|rail|related|recommend(?:ed|ations)?|menu|"
    r"nav|navbar|navigation|topbar|toolbar|masthead|pager|pagination|paginator|footer|foot|copyright|complementary|contentinfo|skip|toc|header|site-header|page-header"
)
ASIDE = re.compile(rf"(?:^|[\s_-])(?:{NAMES})(?:$|[\s_-]|\d)", re.IGNORECASE)
#: One of a class's names says this and nothing else ("comments", not "comments-open").
WHOLLY = re.compile(rf"(?:^|\s)(?:{NAMES})(?:[_-]?(?:{NAMES}|list|box|area|section|block|wrapper|container|form|item|body|text|\d+))*(?:$|\s)", re.IGNORECASE)
#: Names that are the content's own, whatever else they hold.
CONTENT = re.compile(r"(?:^|[\s_-])(?:article|article-?body|entry|entry-content|post|post-content|story|content|main|main-content)(?:$|[\s_-])", re.IGNORECASE)
SIGMA, RADIUS = 1.5, 4
#: The share of the dense text that an element must hold to be taken for the region in place of its parent.
REGION = 0.6
LINKED = 0.8


class Line:
    __slots__ = ("aside", "linked", "path", "tags", "text")

    def __init__(self, text: str, tags: int, linked: int, path: tuple[int, ...], aside: bool):
        self.text, self.tags, self.linked, self.path, self.aside = text, tags, linked, path, aside


class Lines(HTMLParser):
    """Collects a page's lines as the parser's events come in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int]] = []  # name, whether out, number if it is a container
        self.out = self.links = self.articles = self.count = 0
        self.kinds: dict[int, str] = {}
        self.doubted: dict[int, bool] = {}  # numbers of elements that may be out, and whether a name says only that
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append(Line(text, self.tags, self.linked, tuple(n for _, _, n in self.open if n), self.out > 0))
                self.tags = 0
            self.parts, self.linked = [], 0

    def pop(self) -> None:
        name, out, _ = self.open.pop()
        self.out -= out
        self.links -= name == "a"
        self.articles -= name in ("article", "main")

    def pop_to(self, k: int) -> None:
        while len(self.open) > k:
            self.pop()

    def close_open(self, names: set[str], stops: set[str]) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in names:
                return self.pop_to(k)
            if self.open[k][0] in stops:
                return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        elif tag in APART:
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag in ENDS_PARAGRAPH:
            self.close_open({"p"}, STOPS["p"])
        if tag in SIBLINGS:
            self.close_open(SIBLINGS[tag], STOPS[tag])
        if tag in ("article", "main") and not self.articles and self.out:  # a menu or the like that was never closed
            outer = next(k for k, (_, out, _) in enumerate(self.open) if out)
            if self.open[outer][0] in ("nav", "menu", "header"):
                self.pop_to(outer)
        names = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        out = tag in SILENT or tag == "header" and not self.articles
        doubt = tag == "form"
        if not out and names and tag not in ("html", "body", "main"):
            doubt = doubt or bool(ASIDE.search(names)) and not (CONTENT.search(names) and not re.search(r"comment|related|sidebar|\bads?\b", names, re.IGNORECASE))
        out = out or doubt and tag not in BLOCKS
        out = out or any(k in ("hidden",) or (k, v) == ("aria-hidden", "true") for k, v in attrs)
        number = 0
        if tag in CONTAINERS or doubt and not out:
            self.count += 1
            number = self.count
            self.kinds[number] = tag
            if doubt and not out:
                self.doubted[number] = bool(WHOLLY.search(names))
        self.open.append((tag, out, number))
        self.out += out
        self.links += tag == "a"
        self.articles += tag in ("article", "main")

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        elif tag in APART:
            self.parts.append(" ")
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                return self.pop_to(k)
            if self.open[k][0] in CONTAINERS and tag not in BLOCKS:
                return None

    def handle_data(self, data: str) -> None:
        if self.out and any(out and name not in BLOCKS for name, out, _ in self.open):
            return  # a button in a paragraph, say: the line goes on without it
        self.parts.append(data)
        if self.links:
            self.linked += len(data.strip())


def parse(html: str) -> Lines:
    cut = html.rfind("<")
    if cut > html.rfind(">") and re.match(r"<[a-zA-Z/!?]", html[cut:]):  # a tag that the page's end cuts off
        html = html[:cut]
    page = Lines()
    page.feed(html)
    page.close()
    page.end_line()
    return page


def dense(lines: list[Line]) -> np.ndarray:
    """Whether each line's smoothed text-to-tag ratio is above the threshold between sparse and dense lines.

    A line's ratio is its text outside links over the tags since the line before it. A page whose text is all in
    links, or out, has no dense line and so no article.
    """
    ratio = np.array([0.0 if x.aside else (len(x.text) - x.linked) / max(1, x.tags) for x in lines])
    kernel = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    smooth = np.convolve(ratio, kernel / kernel.sum(), "full")[RADIUS : RADIUS + len(ratio)]
    low, high = smooth.min(), smooth.max()
    for _ in range(20):  # two means in one dimension; the threshold is halfway between
        edge = (low + high) / 2
        below, above = smooth[smooth < edge], smooth[smooth >= edge]
        new = (below.mean() if len(below) else low, above.mean())
        if new == (low, high):
            break
        low, high = new
    return (smooth > 0) & (smooth >= min((low + high) / 2, smooth.std() or 0.0)) & np.array([not x.aside for x in lines])


def settle(page: Lines) -> None:
    """Marks the lines of doubted elements as out, but for those elements that hold the page's dense text.

    A doubted element stays if it holds an article or main, or most of the dense text (the latter not if a name says
    wholly that it's something else), and no content worth the name stands outside.
    """
    lines = page.lines
    total, inside, holds, own, above = 0, dict.fromkeys(page.doubted, 0), set(), {0: 0}, {}
    for x, is_dense in zip(lines, dense(lines)):
        doubted = [n for n in x.path if n in page.doubted]
        for k, n in enumerate(doubted):
            above.setdefault(n, [0, *doubted[:k]])
        if is_dense:
            total += len(x.text)
            marked = max((n for n in x.path if page.kinds[n] in ("article", "main")), default=0)
            for n in doubted:
                inside[n] += len(x.text)
            holds.update(n for n in doubted if n <= marked)
            if marked:  # by the innermost doubted element
                own[max(doubted, default=0)] = own.get(max(doubted, default=0), 0) + len(x.text)
    gone = set()
    for n, wholly in page.doubted.items():
        # of other doubted elements only those around this one count as content
        outside = sum(own.get(m, 0) for m in above.get(n, ()))
        clear = outside == 0 if wholly else outside * REGION <= inside[n] * (1 - REGION)
        if not (inside[n] and clear and (n in holds or not wholly and inside[n] >= REGION * total)):
            gone.add(n)
    for x in lines:
        x.aside = x.aside or not gone.isdisjoint(x.path)


def main_text(html: str | None) -> str:
    """The article of a page, its blocks joined by line feeds; empty if the page has none."""
    page = parse(html or "")
    lines = page.lines
    if page.doubted and any(not x.aside for x in lines):
        settle(page)
    if not any(not x.aside for x in lines):
        return ""
    chosen = dense(lines)
    if not chosen.any():
        return ""
    weight: dict[int, int] = {}
    for x, is_dense in zip(lines, chosen):
        if is_dense:
            for n in x.path:
                weight[n] = weight.get(n, 0) + len(x.text)
    total = sum(len(x.text) for x, is_dense in zip(lines, chosen) if is_dense)
    # the innermost article or main that holds most of the dense text; else go down while one element holds it
    region = max((n for n, size in weight.items() if page.kinds[n] in ("article", "main") and size >= REGION * total), default=None)
    whole, depth = region is not None, 0
    while not whole:
        inner = {x.path[depth] for x in lines if len(x.path) > depth and (region is None or region in x.path)}
        best = max(inner, key=lambda n: weight.get(n, 0), default=None)
        if best is None or weight.get(best, 0) < REGION * total or page.kinds[best] in ("tr", "td", "li"):
            break
        region, depth = best, depth + 1
    kept = [x for x in lines if not x.aside and (region is None or region in x.path) and (whole or x.linked < LINKED * len(x.text))]
    # articles within the region that hold the lesser part of its dense text are teasers or replies
    inner_articles = {n for n, kind in page.kinds.items() if kind == "article" and n > (region or 0)}
    nested = sum(len(x.text) for x, is_dense in zip(lines, chosen) if is_dense and (region is None or region in x.path) and inner_articles.intersection(x.path))
    if nested <= (1 - REGION) * (weight[region] if region else total):
        kept = [x for x in kept if not inner_articles.intersection(x.path)]
    return "\n".join(x.text for x in kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each page: the article's text, empty if there is none, and its code points.

    Null html counts as empty; repeated and unclosed elements, and pages cut off anywhere, are read as far as
    they go. Other columns of ``pages`` are left out.
    """
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x.as_py()) for x in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
