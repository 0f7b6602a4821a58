"""Main text of HTML pages by a tree-structured graphical model.

The nodes are the block elements of a page and its runs of text. Each is neutral, content, or apart (menus, notices, comments and
the like). A child's state depends on its parent's by a learned table, and the signs of a node (kind of tag, words in class and
id, length, links, punctuation) depend on its own state. Messages go up from the leaves and down from the root once; their
product is the exact probability of content of every node. The tables are counts over labelled pages, here pages whose markup
names the article, and a few made-up counts.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dietlens.llm.common import fresh

#: Most labelled pages that the tables are fitted on: those with the smallest hash of id and page.
SAMPLE = 2_000
NEUTRAL, CONTENT, APART = range(3)

# Kinds of elements. Fixed values.
_KINDS = {
    "article": "article main",
    "apart": "nav header footer aside form menu dialog address fieldset",
    "heading": "h1 h2 h3 h4 h5 h6 hgroup",
    "text": "p blockquote pre figcaption summary caption",
    "list": "ul ol dl table thead tbody tfoot tr",
    "item": "li dt dd td th",
    "page": "html body",
    "block": "div section center details figure hr",
}
KIND = {tag: kind for kind, tags in _KINDS.items() for tag in tags.split()}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
SKIPPED = frozenset("head noscript template button select option optgroup datalist object svg math canvas audio video".split())
# What may stand in a head. Any other start tag, and text, ends a head whose end tag is left out.
HEAD = frozenset("title meta link base script style noscript noframes template".split())
# An element ends where one of these begins, unless one of the tags behind it stands between.
ENDS = {
    **{tag: ("p", "") for tag in KIND if tag not in ("html", "body")},
    "li": ("li", "ul ol"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
}
_ENDS = {tag: (frozenset(a.split()), frozenset(b.split()) | {"body", "table", "td"} - set(a.split())) for tag, (a, b) in ENDS.items()}
# Words in class, id and role that mark parts beside the article, and the article. Fixed values.
APART_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus disclaimer "
    "dialog footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notification outbrain pager "
    "pagination paywall popup promo promotion recommended related reply replies respond search share sharing sidebar signup social "
    "sponsor sponsored subscribe taboola toolbar topbar tracking widget widgets complementary contentinfo alert skyscraper".split()
)
ARTICLE_WORDS = frozenset("article articlebody content main post entry story body text prose".split())

_TAG = re.compile(r"<!--.*?-->|<!--.*+|<!\[CDATA\[|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)", re.S)
_PLAIN = re.compile(r"[^<>\"']*+")
_SIGN = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}


def _tag_end(source: str, at: int, unclosed: dict[str, int]) -> int:
    """Where the attributes from `at` on end: at the first `>` outside of quoted values, of any length.

    If a quote does not close, or `<` comes before, at the first `>` at all; there is one. `unclosed` keeps from where on a quote
    is known not to close.
    """
    place = at
    while True:
        place = _PLAIN.match(source, place).end()
        sign = source[place : place + 1]
        if sign == ">":
            return place
        if sign not in ("'", '"') or place >= unclosed.get(sign, len(source)):
            return source.find(">", at)
        close = source.find(sign, place + 1)
        if close < 0:
            unclosed[sign] = place
            return source.find(">", at)
        place = close + 1


class Page:
    """The tree of a page in document order: parents stand before their children.

    parent, signs (list of `sign=value`), region (CONTENT, APART or None) of each node, and text by leaf.
    """

    def __init__(self, source: str):
        self.parent, self.signs, self.region = [-1], [["kind=page"]], [None]
        self.text: dict[int, str] = {}
        self._stack: list[tuple[str, int]] = [("", 0)]  # tag and node; of inline elements the node around them
        self._places: dict[str, list[int]] = defaultdict(list)  # of the open elements of each tag, in the stack
        self._blocks: list[int] = []
        self._run: list[str] = []
        self._linked = 0
        self._skip = 0
        self._read(source)
        self._flush()

    def _flush(self) -> None:
        """End the run of text, which becomes a leaf of the innermost block."""
        if not self._run:
            return
        words = html.unescape("".join(self._run)).split()
        linked, self._run, self._linked = self._linked, [], 0
        if not words:
            return
        text = " ".join(words)
        block = self._stack[-1][1]
        share = min(1.0, linked / len(text))
        links = "none" if not share else "some" if share < 0.3 else "many" if share < 0.7 else "most"
        ends = "stop" if text[-1] in ".!?…。\"'”»)" else "open"
        self.parent.append(block)
        self.region.append(None)
        # An item is short, open-ended and often a link wherever it stands: what is around it tells.
        form = [f"links={links}", f"length={min(12, len(words).bit_length())}", f"ends={ends}"]
        self.signs.append(["kind=run", *([f"item={links}"] if self.signs[block][0] == "kind=item" else form)])
        self.text[len(self.parent) - 1] = text

    def _end_head(self) -> None:
        """End a head that was left open, if it is the innermost element."""
        if self._stack[-1][0] == "head":
            self._pop()

    def _add(self, raw: str) -> None:
        if self._skip and raw.strip():
            self._end_head()
        if not self._skip:
            self._run.append(raw)
            if self._places["a"]:
                self._linked += len(raw)

    def _pop(self) -> None:
        tag, _ = self._stack[-1]
        if tag in KIND:
            self._flush()
        if tag in SKIPPED:
            self._skip -= 1
        self._stack.pop()
        self._places[tag].pop()
        if tag in KIND:
            self._blocks.pop()

    def _close(self, tags: frozenset[str], barrier: frozenset[str] | None) -> None:
        """End the innermost open element of `tags`, and those in it, if no barrier (None: no block) stands between."""
        depth = self._last(tags)
        if depth and depth >= (self._blocks[-1] if barrier is None and self._blocks else self._last(barrier or ())):
            while len(self._stack) > depth:
                self._pop()

    def _last(self, tags: Iterable[str]) -> int:
        return max((self._places[t][-1] for t in tags if self._places.get(t)), default=0)

    def _push(self, tag: str, attributes: str) -> None:
        if tag in _ENDS:
            self._close(*_ENDS[tag])
        if tag in KIND:
            self._flush()
            words = {w.lower() for m in _SIGN.findall(attributes) for w in _WORD.findall(m)}
            words = "apart" if words & APART_WORDS else "article" if words & ARTICLE_WORDS else "none"
            kind = KIND[tag]
            self.parent.append(self._stack[-1][1])
            self.signs.append([f"kind={kind}", f"words={words}"])
            self.region.append(APART if kind == "apart" or words == "apart" else CONTENT if kind == "article" else None)
            node = len(self.parent) - 1
        else:
            node = self._stack[-1][1]
        if tag in VOID:
            self._add(" ")
            return
        self._places[tag].append(len(self._stack))
        if tag in KIND:
            self._blocks.append(len(self._stack))
        self._stack.append((tag, node))
        if tag in SKIPPED:
            self._skip += 1

    def _read(self, source: str) -> None:
        at = 0
        unclosed: dict[str, int] = {}
        last = source.rfind(">") + 1  # no tag ends behind it
        last_data = source.rfind("]]>")
        while match := _TAG.search(source, at, last):
            if match.start() > at:
                self._add(source[at : match.start()])
            at = match.end()
            end, tag = match.group(1, 2)
            if tag is None:
                if match[0].startswith("<!--") and not match[0].endswith("-->"):
                    return  # the rest is a comment
                if match[0].startswith("<![CDATA["):
                    close = source.find("]]>", at) if at <= last_data else -1
                    if close >= 0:
                        self._add(html.escape(source[at:close]))
                    at = close + 3 if close >= 0 else source.find(">", at) + 1
                continue
            stop = _tag_end(source, at, unclosed)
            attributes, at = source[at:stop], stop + 1
            tag = tag.lower()
            if not end and tag not in HEAD:
                self._end_head()
            if end:
                self._close(frozenset([tag]), frozenset() if tag in KIND or tag in SKIPPED else None)
            elif tag in RAW:
                close = _CLOSE[tag].search(source, at)
                at = close.end() if close else len(source)
            else:
                if tag == "body":  # ends a head that was left open, and what is open in it
                    self._close(frozenset(["head"]), frozenset())
                self._push(tag, attributes)
        if at < len(source):
            self._add(source[at:])


def labels(page: Page) -> list[int] | None:
    """The states of a page whose markup names its article: each region's for its nodes; None if it names none."""
    if CONTENT not in page.region:
        return None
    out = [NEUTRAL]
    for node in range(1, len(page.parent)):
        own = page.region[node]
        out.append(out[page.parent[node]] if own is None else own)
    return out


def counts(page: Page, states: Sequence[int]) -> Counter:
    """What the tables are made of: `state sign` and `parent state>state`."""
    out: Counter = Counter()
    for node, state in enumerate(states):
        if node:
            out[f"{states[page.parent[node]]}>{state}"] += 1
        for sign in page.signs[node]:
            out[f"{state} {sign}"] += 1
    return out


#: Made-up shares by state (neutral, content, apart): what the names mean. They count like PSEUDO nodes of each state beside the
#: counted ones, so they fade as labelled pages grow, and stay where these never show a sign.
PSEUDO = 1000
STEPS = {NEUTRAL: (60, 8, 32), CONTENT: (1, 90, 9), APART: (0.95, 0.05, 99)}
SIGNS = {
    "kind=article": (0.01, 30, 0.01), "kind=apart": (0.01, 0.01, 60), "kind=heading": (1, 10, 6), "kind=text": (2, 60, 15), "kind=block": (80, 30, 60),
    "kind=list": (10, 20, 30), "kind=item": (10, 40, 60), "kind=page": (20, 0.2, 0.02),
    "kind=run": (2, 60, 60),
    "words=apart": (0.01, 0.01, 60), "words=article": (4, 60, 0.5), "words=none": (80, 60, 60),
    "links=none": (60, 80, 50), "links=some": (10, 20, 10), "links=many": (10, 3, 20), "links=most": (10, 1, 60),
    "item=none": (60, 70, 50), "item=some": (10, 15, 10), "item=many": (10, 6, 20), "item=most": (20, 9, 40),
    "ends=stop": (30, 80, 30), "ends=open": (60, 20, 80), **{f"length={k}": (10, 10, 10) for k in range(1, 13)},
}
#: How far a sign may speak for one state over another, as a ratio. Names speak as loud as they are counted; form is
#: damped, because the signs of a text, and of the texts beside it, say much the same.
DAMPED = {
    # Lists and tables make up menus as well as articles, and labelled pages may show but one of these.
    "kind=list": 1.2, "kind=item": 1.05, "item": 1.2,
    "kind=text": 4.5, "kind=heading": 3.0, "kind=block": 2.0, "kind=run": 20.0, "words=article": 30.0, "words=none": 2.0, "links": 20.0, "ends": 3.0, "length": 4.5,
}


class Model:
    """Tables out of counts: step[parent state][state], and by sign how likely it is in each state."""

    def __init__(self, found: Mapping[str, int]):
        self.step = []
        for above in range(3):
            row = [found.get(f"{above}>{s}", 0) for s in range(3)]
            self.step.append([(PSEUDO * m / sum(STEPS[above]) + c) / (PSEUDO + sum(row)) for m, c in zip(STEPS[above], row, strict=True)])
        names: dict[str, list[str]] = {}
        for sign in SIGNS:
            names.setdefault(sign.split("=")[0], []).append(sign)
        self.sign = {}
        for name, signs in names.items():
            made = [sum(SIGNS[x][s] for x in signs) for s in range(3)]
            seen = [sum(found.get(f"{s} {x}", 0) for x in signs) for s in range(3)]
            for sign in signs:
                share = [
                    (PSEUDO * SIGNS[sign][s] / made[s] + found.get(f"{s} {sign}", 0)) / (PSEUDO + seen[s]) for s in range(3)
                ]
                limit = DAMPED.get(sign, DAMPED.get(name, math.inf))
                middle = sorted(share)[1]
                self.sign[sign] = tuple(min(max(x / middle, 1 / limit), limit) for x in share)

    def marginals(self, page: Page) -> list[float]:
        """Probability of content of every node, by one pass up and one down."""
        parent, sign, step = page.parent, self.sign, self.step
        n = len(parent)
        own = []  # signs, later also the messages from below
        for signs in page.signs:
            a = b = c = 1.0
            for name in signs:
                if name in sign:
                    x, y, z = sign[name]
                    a, b, c = a * x, b * y, c * z
            own.append((a, b, c))
        (s00, s01, s02), (s10, s11, s12), (s20, s21, s22) = step
        up = [(1.0, 1.0, 1.0)] * n  # message of each node to its parent, by the parent's state
        for node in range(n - 1, 0, -1):
            a, b, c = own[node]
            x, y, z = s00 * a + s01 * b + s02 * c, s10 * a + s11 * b + s12 * c, s20 * a + s21 * b + s22 * c
            whole = x + y + z
            up[node] = x, y, z = x / whole, y / whole, z / whole
            a, b, c = own[parent[node]]
            a, b, c = a * x, b * y, c * z
            whole = a + b + c
            own[parent[node]] = (a / whole + 1e-300, b / whole + 1e-300, c / whole + 1e-300)
        out = [0.0] * n
        for node in range(n):
            a, b, c = own[node]
            if node:  # the parent's belief without what came from here, through the table
                (x, y, z), (d, e, f) = own[parent[node]], up[node]
                x, y, z = x / d, y / e, z / f
                a, b, c = a * (x * s00 + y * s10 + z * s20), b * (x * s01 + y * s11 + z * s21), c * (x * s02 + y * s12 + z * s22)
            whole = a + b + c
            own[node] = a / whole + 1e-300, b / whole + 1e-300, c / whole + 1e-300
            out[node] = own[node][1]
        return out

    def extract(self, source: str) -> str:
        """Texts of the leaves that are more likely content than not, one per line."""
        page = Page(source)
        likely = self.marginals(page)
        return "\n".join(text for node, text in page.text.items() if likely[node] > 0.5)


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> Model:
    """Tables from at most about `sample` pages (more only by equal hashes) whose markup names the article."""
    named = pages.filter(F.col(html_col).rlike(r"(?i)<(?:article|main)[\s>]"))
    named = named.select(F.xxhash64(id_col, html_col).alias("hash"), F.col(html_col).alias("html"))
    least = named.select("hash").orderBy("hash").limit(sample).agg(F.max("hash")).first()[0]
    if least is None:
        return Model({})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for source in batch.column(0).to_pylist():
                page = Page(source)
                states = labels(page)
                if states:
                    total.update(counts(page, states))
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["key", "n"])

    chosen = named.filter(F.col("hash") <= least).select("html")
    sums = chosen.mapInArrow(count, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return Model({r["key"]: r["n"] for r in sums.collect()})  # a row per state and sign, about 200


def extract(
    pages: DataFrame, model: Model, html_col: str = "html", keep: Sequence[str] = ("page_id", "url"), out: str = "text"
) -> DataFrame:
    """Per row the `keep` columns and the main text, empty if there is none or the page is null.

    Rows are read one by one, so repeated rows and null ids are like others. An empty table gives an empty table. Pages of any length
    are read whole, in time that grows with their length, as do nested and unclosed tags. Other columns are not read, whatever
    their names.
    """
    data = fresh("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = batch.column(batch.num_columns - 1)
            texts = [model.extract(s) for at in range(0, len(sources), 256) for s in sources.slice(at, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep, out])

    slim = pages.select(*keep, F.coalesce(F.col(html_col), F.lit("")).alias(data))
    return slim.mapInArrow(run, T.StructType([slim.schema[c] for c in keep]).add(out, "string"))
