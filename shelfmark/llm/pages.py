"""Main text of web pages: parser events, text-to-tag ratios, smoothing and threshold clustering.

The standard library's parser gives events, from which the page becomes a sequence of blocks (lines).
Each block has its text, the tags met since the block before, and the elements it stands in. The
ratio of text to tags, smoothed by a Gaussian, is high in running text; blocks over the threshold (the
mean less half the deviation) form clusters. The clusters select the content region: the article element (or
main) that holds them, else the whole page. Within the region every block counts, short ones too, except
in elements that are never the article (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, comments of readers). A class or id says so only of an element that does not wrap the
article, or nearly all of the text ("layout has-sidebar").
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shelfmark.llm.tables import mapped

SIGMA = 1.0
#: Share of the text from which an element is a wrapper of it, whatever its class says.
HOLDS = 0.8
FEED = 1 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp "
    "small span strike strong sub sup time tt u var wbr img".split()
)
#: Elements, roles and words of class or id that are never part of the article.
LEFT_OUT = frozenset(
    "head script style noscript template nav menu header footer aside form button select option textarea input "
    "fieldset iframe object svg canvas audio video dialog title".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation "
    "menu breadcrumb breadcrumbs sidebar footer header masthead notice notices cookie cookies consent gdpr alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments "
    "reply replies disqus related recommended widget toolbar pagination pager".split()
)
#: Start tags that close an open paragraph or item of the same kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}


def _never(tag: str, attributes: list) -> bool:
    if tag in LEFT_OUT:
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    for name, value in attributes:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "role" and (value or "").strip().lower() in ROLES:
            return True
    return False


def _named_so(tag: str, attributes: list) -> bool:
    """Whether a class or id has one of the words; html, body, main and article are not asked."""
    if tag in ("html", "body", "main", "article"):
        return False
    for name, value in attributes:
        if name in ("class", "id") and value:
            if not WORDS.isdisjoint(re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower())):
                return True
    return False


class Blocks(HTMLParser):
    """Collects blocks as (text, tags before it, chain of open elements, left out)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, tuple, bool]] = []
        self.open: list[tuple[str, int, bool]] = []  # tag, number, left out (itself or around it)
        self.names: dict[int, str] = {}
        self.named_so: set[int] = set()  # numbers of elements whose class or id has one of the words
        self.text: list[str] = []
        self.tags = 0

    def _end_block(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text.clear()
        if text:
            out = bool(self.open) and self.open[-1][2]
            self.blocks.append((text, self.tags, tuple(n for _, n, _ in self.open), out))
            self.tags = 0

    def _close(self, at: int) -> None:
        self._end_block()
        del self.open[at:]

    def handle_starttag(self, tag, attributes):
        never, named_so = _never(tag, attributes), _named_so(tag, attributes)
        if never or named_so or tag not in INLINE:
            self._end_block()
        self.tags += 1
        if tag in VOID:
            return
        kinds = CLOSES.get(tag, {"p"} if tag not in INLINE else ())
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] in kinds:
                self._close(at)
                break
            if self.open[at][0] not in INLINE and self.open[at][0] != "p":
                break
        number = len(self.names)
        self.names[number] = tag
        if named_so:
            self.named_so.add(number)
        self.open.append((tag, number, never or (bool(self.open) and self.open[-1][2])))

    def handle_startendtag(self, tag, attributes):
        if tag in VOID:
            self.handle_starttag(tag, attributes)
        else:
            self.handle_starttag(tag, attributes)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag not in INLINE:
            self._end_block()
        for at in range(len(self.open) - 1, -1, -1):
            name, number, out = self.open[at]
            if name == tag:
                if tag in INLINE and not out and number not in self.named_so:
                    if at == len(self.open) - 1:  # text goes on in the same block
                        self.open.pop()
                    elif not self.named_so.isdisjoint(k for _, k, _ in self.open[at:]):
                        self._close(at)
                    elif all(n in INLINE for n, _, _ in self.open[at:]):
                        del self.open[at]
                else:
                    self._close(at)
                return
            if tag in INLINE and name not in INLINE:
                return

    def handle_data(self, data):
        self.text.append(data)

    def unknown_decl(self, data):
        pass


def blocks(html: str) -> Blocks:
    parser = Blocks()
    try:
        for at in range(0, len(html), FEED):
            parser.feed(html[at : at + FEED])
        parser.close()
    except AssertionError:  # the parser gives up at a malformed <![ ; it is text then
        return blocks(html.replace("<![", "&lt;!&#91;"))
    parser._end_block()
    left = parser.named_so - _wrappers(parser)
    if left:
        parser.blocks = [(t, k, chain, out or not left.isdisjoint(chain)) for t, k, chain, out in parser.blocks]
    return parser


def _wrappers(page: Blocks) -> set[int]:
    """Of the elements named so, those around an article (or main), or with nearly all of the text.

    Articles inside more elements named so than another one (comments of readers, related pages) don't
    count. The text is that of the articles that do, or of the page if it has none.
    """
    if not page.named_so:
        return set()
    around: dict[int, set[int]] = {}
    for _, _, chain, out in page.blocks:
        if not out:
            for at, number in enumerate(chain):
                if page.names[number] in ("article", "main") and number not in around:
                    around[number] = page.named_so.intersection(chain[:at])
    least = min(map(len, around.values()), default=0)
    articles = {n for n, those in around.items() if len(those) == least}
    found = set().union(*(around[n] for n in articles))
    held: dict[int, int] = {}
    total = 0
    for text, _, chain, out in page.blocks:
        if not out and (not articles or not articles.isdisjoint(chain)):
            total += len(text)
            for number in page.named_so.intersection(chain):
                held[number] = held.get(number, 0) + len(text)
    return found | {n for n, size in held.items() if size >= HOLDS * total}


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel, "full")[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel, "full")[reach : reach + len(ratios)] / weight


def extract(html: str | None) -> str:
    """The article's blocks, joined by one space; empty if there is none."""
    if not html:
        return ""
    page = blocks(html)
    found = page.blocks
    if not any(not out for _, _, _, out in found):
        return ""
    ratios = smoothed(np.array([0.0 if out else len(t) / max(1, tags) for t, tags, _, out in found]))
    threshold = ratios.mean() - ratios.std() / 2
    chosen = [i for i, (_, _, _, out) in enumerate(found) if not out and ratios[i] >= threshold]
    region = _region(page, chosen or [i for i, b in enumerate(found) if not b[3]])
    return " ".join(t for t, _, chain, out in found if not out and (region is None or not region.isdisjoint(chain)))


def _region(page: Blocks, chosen: list[int]) -> set[int] | None:
    """Numbers of the elements that hold the content; None for the whole page."""
    held: dict[int, int] = {}
    total = 0
    for i in chosen:
        text, _, chain, _ = page.blocks[i]
        total += len(text)
        for number in chain:
            held[number] = held.get(number, 0) + len(text)
    for kind in ("article", "main"):
        those = {n for n in held if page.names[n] == kind}
        if sum(len(page.blocks[i][0]) for i in chosen if not those.isdisjoint(page.blocks[i][2])) * 2 >= total > 0:
            if those:
                return those
    articles = {n for _, _, chain, out in page.blocks if not out for n in chain if page.names[n] == "article"}
    if len(articles) == 1:
        return articles
    return None


def main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """`pages` without `html`, with text and n_chars (code points): the article of every whole page.

    Null or empty html gives an empty text. Columns named text or n_chars are replaced, all others and
    all rows stay, repeated ones too; an empty table gives an empty table.
    """

    def make():
        def run(pages):
            texts = [extract(h) for h in pages]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return run

    kept = [c for c in pages.columns if c != html]
    return mapped(pages, html, kept, [("text", "string"), ("n_chars", "long")], make)
