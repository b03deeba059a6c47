"""Main text of web pages, from flat blocks of text.

A page becomes a flat list of blocks.  Each is described by its number of
words and the share of them that are links, by those of the blocks before and
after it, and by what kind of element holds it; a decision tree, trained on a
small labelled table of pages, tells main text from the rest.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import slices
from termloom.llm.html_samples import labelled_pages

#: Splits that one path of the tree has at most, and labelled blocks in a leaf at least.
DEPTH = 10
LEAST_BLOCKS = 2

#: Elements of HTML by how they are read.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav noscript ol option p pre section select summary table tbody td tfoot "
    "th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SKIPPED = frozenset("template svg math object canvas audio video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = frozenset("li dd dt td th option".split())
#: Elements that an opening one of the kind ends, and what hides them from it.
ENDED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
MAIN_TAGS = frozenset("article main".split())
OTHER_TAGS = frozenset("nav aside footer header form menu dialog button select fieldset label noscript".split())
MAIN_ROLES = frozenset("main article".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Words in a class or id that tell what an element holds.
MAIN_WORDS = frozenset("article articlebody content entry post story text main blog hentry body artikel inhalt contenu articulo".split())
OTHER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion promoted "
    "nav navbar navi navigation topnav menu submenu sidebar side aside rail widget widgets footer foot header masthead topbar toolbar "
    "breadcrumb breadcrumbs pager pagination comment comments commentlist respond reply replies disqus discussion cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login register share sharing "
    "social related recommended recommendations teaser teasers trending popular tags tagcloud meta byline copyright legal disclaimer "
    "imprint search form hidden tooltip skip".split()
)
#: Words of a heading that opens something else than main text.
OTHER_HEADINGS = frozenset(
    "comments comment replies kommentare commentaires comentarios related recommended newsletter subscribe share sponsored".split()
)
_NOT_HERE = frozenset("with has no without".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++)))?+""")
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SENTENCE = tuple(".!?…。！？\"»”")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    features: list[float] = field(default_factory=list)
    marked: bool = False


@dataclass
class _Open:
    """An open element: what it and those around it tell."""

    tag: str
    hint: int = 0
    head: bool = False
    other: bool = False
    main: bool = False
    skipped: bool = False
    link: bool = False
    marked: bool = False


def _hint(tag: str, attributes: dict[str, str]) -> int:
    """1 if the element names main text, -1 if it names something else."""
    if tag in ("html", "body"):
        return 0
    hint = 1 if tag in MAIN_TAGS else -1 if tag in OTHER_TAGS else 0
    if not attributes:
        return hint
    role = attributes.get("role", "").lower()
    style = attributes.get("style", "").lower().replace(" ", "")
    if role in OTHER_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in style:
        return -1
    names = _NAME_WORD.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}")
    names = [n.lower() for n in names]
    if any(n in OTHER_WORDS and (not i or names[i - 1] not in _NOT_HERE) for i, n in enumerate(names)):
        return -1
    if role in MAIN_ROLES or "articlebody" in attributes.get("itemprop", "").lower() or not MAIN_WORDS.isdisjoint(names):
        return hint or 1
    return hint


class _Page:
    """Reads one page into blocks, in one pass."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.open = [_Open("")]
        self.count: dict[str, int] = defaultdict(int)
        self.links = 0
        self.pieces: list[str] = []
        self.linked = 0
        self.tag = ""
        self.first_heading = False
        self.apart = False

    def add(self, text: str) -> None:
        if not text or self.open[-1].skipped:
            return
        text = html.unescape(text) if "&" in text else text
        self.pieces.append(text)
        if self.links:
            self.linked += len(text.split())

    def end_block(self) -> None:
        if not self.pieces:
            return
        words = "".join(self.pieces).split()
        linked, self.linked = self.linked, 0
        self.pieces = []
        if not words:
            return
        top, heading = self.open[-1], float(self.tag in HEADINGS)
        if heading:
            self.first_heading = True
            self.apart = not OTHER_HEADINGS.isdisjoint(w.lower().strip(":.()") for w in words)
        block = Block(" ".join(words), len(words), min(linked, len(words)), marked=top.marked)
        block.features = [
            heading,
            float(self.tag in ITEMS),
            float(words[-1].endswith(_SENTENCE)),
            float(top.hint),
            float(top.head),
            float(top.other),
            float(top.main),
            float(self.first_heading),
            float(self.apart),
        ]
        self.blocks.append(block)

    def pop_to(self, tag: str) -> None:
        while True:
            top = self.open.pop()
            self.count[top.tag] -= 1
            self.links -= top.link
            if top.tag == tag:
                return

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in BLOCKS:
            self.end_block()
            self.tag = tag
            if self.count["p"]:
                for inner in reversed(self.open):
                    if inner.tag == "p":
                        self.pop_to("p")
                    if inner.tag == "p" or inner.tag in BLOCKS:
                        break
            if tag in ENDED:
                same, around = ENDED[tag]
                if any(self.count[t] for t in same):
                    for inner in reversed(self.open):
                        if inner.tag in same:
                            self.pop_to(inner.tag)
                        if inner.tag in same or inner.tag in around:
                            break
        elif tag == "br":
            self.add(" ")
        if tag in VOID:
            return
        if tag == "a" and self.count["a"]:
            self.pop_to("a")
        around = self.open[-1]
        hint = _hint(tag, attributes)
        link = tag == "a" and "href" in attributes
        self.open.append(
            _Open(
                tag,
                hint or around.hint,
                tag == "header" and around.main if hint else around.head,
                around.other or hint < 0,
                around.main or hint > 0,
                around.skipped or tag in SKIPPED,
                link,
                "data-main" in attributes or (around.marked and tag not in BLOCKS),
            )
        )
        self.count[tag] += 1
        self.links += link

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_block()
        if self.count[tag]:
            self.pop_to(tag)
        if tag in BLOCKS:
            self.tag = self.open[-1].tag


def read_blocks(page: str) -> list[Block]:
    """Blocks of ``page`` in their order; whatever the markup lacks, all its text is in one of them.

    Comments, scripts, styles and the title have none.
    """
    state = _Page()
    at, n = 0, len(page)
    while at < n:
        sign = page.find("<", at)
        if sign < 0:
            state.add(page[at:])
            break
        state.add(page[at:sign])
        if page.startswith("<!--", sign):
            end = page.find("-->", sign + 2)
            at = n if end < 0 else end + 3
            continue
        follows = page[sign + 1 : sign + 3]
        if follows[:1] in ("!", "?") or (follows[:1] == "/" and not follows[1:].isalpha()):
            end = page.find(">", sign)
            at = n if end < 0 else end + 1
            continue
        if not (follows[:1].isalpha() or follows[:1] == "/"):
            state.add("<")
            at = sign + 1
            continue
        found = _TAG.match(page, sign)
        if not found:
            # A quote that never ends: up to the next bracket, or a tag that the page's end cut off.
            end = page.find(">", sign)
            at = n if end < 0 else end + 1
            continue
        at = found.end()
        tag = found[2].lower()
        if found[1]:
            state.end(tag)
            continue
        if tag in RAW:
            if tag == "iframe" or tag == "textarea":
                state.end_block()
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            end = page.find(">", close.end()) if close else -1
            at = n if end < 0 else end + 1
            continue
        attributes = {}
        if found[3]:
            for m in _ATTRIBUTE.finditer(found[3]):
                attributes.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        state.start(tag, attributes)
    state.end_block()
    return state.blocks


def features(blocks: Sequence[Block]) -> list[list[float]]:
    """Numbers that describe each of a page's blocks and its two neighbours."""
    size = [float(b.words) for b in blocks]
    share = [b.linked / b.words for b in blocks]
    main = float(any(b.features[6] for b in blocks))
    out = []
    for i, block in enumerate(blocks):
        before = (size[i - 1], share[i - 1]) if i else (0.0, 0.0)
        after = (size[i + 1], share[i + 1]) if i + 1 < len(blocks) else (0.0, 0.0)
        out.append([size[i], share[i], *block.features, main, *before, *after])
    return out


@dataclass(frozen=True)
class Tree:
    """A decision tree: for each node the feature and limit that part it, and its children (0: a leaf)."""

    feature: tuple[int, ...]
    limit: tuple[float, ...]
    below: tuple[int, ...]
    above: tuple[int, ...]
    main: tuple[bool, ...]

    def predict(self, rows: np.ndarray) -> np.ndarray:
        feature, limit, below, above = (np.array(a) for a in (self.feature, self.limit, self.below, self.above))
        node = np.zeros(len(rows), np.int64)
        some = np.arange(len(rows)) if below[0] else np.zeros(0, np.int64)
        while len(some):
            at = node[some]
            node[some] = np.where(rows[some, feature[at]] <= limit[at], below[at], above[at])
            some = some[below[node[some]] > 0]
        return np.array(self.main)[node]


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = DEPTH, least: int = LEAST_BLOCKS) -> Tree:
    """A tree by Gini impurity; equal splits go to the first feature, then the lowest limit."""
    feature, limit, below, above, main = [], [], [], [], []

    def impurity(n: np.ndarray, ones: np.ndarray) -> np.ndarray:
        return 2 * ones * (n - ones) / np.maximum(n, 1)

    def add(which: np.ndarray, left: int) -> int:
        number, n = len(feature), len(which)
        ones = int(labels[which].sum())
        for column, value in ((feature, 0), (limit, 0.0), (below, 0), (above, 0), (main, 2 * ones > n)):
            column.append(value)
        if not left or ones in (0, n):
            return number
        best = (impurity(np.float64(n), np.float64(ones)) - 1e-9, 0, 0.0)
        for f in range(rows.shape[1]):
            order = np.argsort(rows[which, f], kind="stable")
            value, hit = rows[which, f][order], np.cumsum(labels[which][order])
            cut = np.flatnonzero(value[1:] > value[:-1])
            cut = cut[(cut + 1 >= least) & (n - cut - 1 >= least)]
            if len(cut):
                cost = impurity(cut + 1, hit[cut]) + impurity(n - cut - 1, ones - hit[cut])
                if cost.min() < best[0]:
                    place = cut[cost.argmin()]
                    best = (cost.min(), f, (value[place] + value[place + 1]) / 2)
        if best[2] == 0.0 and best[1] == 0:
            return number
        feature[number], limit[number] = best[1], float(best[2])
        under = rows[which, best[1]] <= best[2]
        below[number] = add(which[under], left - 1)
        above[number] = add(which[~under], left - 1)
        ends = [below[number], above[number]]
        if not any(below[e] for e in ends) and main[ends[0]] == main[ends[1]]:
            below[number] = above[number] = 0
        return number

    add(np.arange(len(rows)), depth)
    return Tree(tuple(feature), tuple(limit), tuple(below), tuple(above), tuple(main))


def train(pages: Sequence[str] | None = None, depth: int = DEPTH) -> Tree:
    """The tree learnt from ``pages``, whose elements of main text have an attribute ``data-main``.

    By default the labelled table of the package.  The table is small by
    purpose and read by the driver; without main blocks nothing is main text.
    """
    rows, labels = [], []
    for page in labelled_pages() if pages is None else pages:
        blocks = read_blocks(page)
        rows += features(blocks)
        labels += [b.marked for b in blocks]
    width = len(rows[0]) if rows else 1
    return grow(np.array(rows, float).reshape(-1, width), np.array(labels, bool), depth)


def extract(pages: DataFrame, tree: Tree) -> DataFrame:
    """Each row of ``pages`` (page_id, url, html) as (page_id, url, text, n_chars).

    ``text`` joins the main blocks by line feeds in their order; it is empty
    where there are none, as for null and empty pages.  Pages are read one by
    one, so repeated and null ids each give a row; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "html"):
                read = [read_blocks(page or "") for page in some.column("html").to_pylist()]
                rows = [r for blocks in read for r in features(blocks)]
                main = iter(tree.predict(np.array(rows)).tolist() if rows else ())
                texts = ["\n".join([b.text for b in blocks if next(main)]) for blocks in read]
                columns = [some.column("page_id"), some.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), *(F.col(c).cast("string").alias(c) for c in ("url", "html")))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
