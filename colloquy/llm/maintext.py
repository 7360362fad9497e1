"""Main text of web pages by minimum-cut labelling of their text blocks.

A page is cut into blocks at block-level tags.  A linear classifier gives each
block a cost of being content and one of being boilerplate, the capacities to
the two terminals.  It adds fixed weights (tags and class words around a block,
link share, length, punctuation) and log-odds that ``fit`` learns on pages whose
markup names their main text (``article`` or ``main``): class words, tags, link
share, length, depth and place of blocks inside and outside of it.  At most
SAMPLE pages are read for that, those of smallest hash; every page is extracted.
Neighbours in page order, and blocks of the same container, are joined by
smoothness edges.  The minimum cut labels the blocks, so that those of small
cost follow their neighbours; the ones on the content side are joined in order.

Defined results: a null or empty page has no text; unclosed and truncated tags
end at the end of the page; scripts, styles, comments, templates, forms and
other tags of RAW_TAGS never give blocks.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|([^<]+|<(?![a-zA-Z/!?]))", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAMED = ("class", "id", "role", "aria-label")
_STATE = re.compile(r"(?:has|with|no)-", re.I)  # classes that tell what a wrapper holds or lacks
_NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_SPACE = re.compile(r"\s+")
_TAG_END = re.compile(r">|\Z")

BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template textarea title xmp iframe noembed noframes svg select option button object canvas audio video map datalist".split())

#: Costs in units of the classifier: positive speaks for content.
TAG_COST = {"article": 4.0, "main": 3.0, "nav": -12.0, "footer": -12.0, "header": -7.0, "aside": -12.0, "form": -14.0, "menu": -12.0, "dialog": -10.0, "fieldset": -8.0}
OWN_COST = {"p": 1.5, "h1": 1.5, "h2": 1.0, "h3": 1.0, "h4": 0.5, "blockquote": 1.0, "pre": 1.0, "li": -0.5, "td": -0.5, "th": -0.5, "figcaption": 0.5}
GOOD_NAMES = re.compile(r"(?:^|[\s_-])(?:article|content|entry|post|story|main|text|body|prose)(?:$|[\s_-])", re.I)
_BAD = r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|menu|nav\w*|breadcrumbs?|footer|header|masthead|topbar|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscri\w*|signup|login|share|sharing|social|related|recommend\w*|comments?|commentlist|disqus|replies|respond|reviews?|widget|toolbar|pagination|pager|copyright|skip|contentinfo|complementary)"
#: Parts of names that say where a thing is or how it is held, not what it is.
_PLACE = r"(?:site|page|main|top|bottom|left|right|global|primary|secondary|inner|outer|sticky|list|box|bar|wrap|wrapper|container|section|area|block|group|row|col|item|items|link|links|button|buttons|icon|icons|form|posts|stories|articles|thread|panel|zone|slot|unit|js|\d+)"
#: A class or id that names boilerplate and nothing else: all of its parts are bad words or places, one at least a bad word.
BAD_NAMES = re.compile(rf"(?:{_PLACE}[_-]+)*{_BAD}(?:[_-]+(?:{_BAD}|{_PLACE}))*", re.I)
#: A name with a bad word among others, such as share-prices: outside of articles a weak sign.
HALF_BAD = re.compile(rf"(?:^|[\s_-]){_BAD}(?:$|[\s_-])", re.I)
#: Words that boilerplate has, but parts of articles too: they leave the length, links and neighbours of a block to decide.
WEAK_NAMES = re.compile(r"(?:^|[\s_-])(?:side|foot|notice|alert|more|reply|legal|disclaimer|tags?|meta|byline|search)(?:$|[\s_-])", re.I)
HIDDEN = "not-shown"  # in place of a class word, of elements that are not shown
ENDS = ".!?…»\"”"
GOOD_COST, WEAK_COST, BAD_COST = 1.5, -5.0, -12.0
IN_ORDER, SAME_PARENT, FURTHER = 1.5, 1.0, 0.5  # smoothness edges
BIAS = -1.0
SAMPLE = 2_000  # pages that teach the log-odds
LEAST = 20  # blocks that must have a feature
LEARNED, MOST = 0.3, 3.0  # weight of the sum of log-odds, and its bound
AROUND = 4  # elements around a block whose class words count as its features


class Block:
    """A block of text: its tag, the element around it, what that element and those around it cost together."""

    __slots__ = ("article", "context", "depth", "links", "parent", "parts", "path", "tag", "text", "words")

    def __init__(self, holder: Element | None) -> None:
        h = holder or ROOT
        self.tag, self.parent, self.path, self.context, self.article, self.depth, self.words = h.block_tag, h.block, h.path, h.context, h.article, h.depth, h.words
        self.parts, self.links, self.text = [], 0, ""


class Element:
    """An open element.  All that its blocks need to know of what is around is kept here, so depth costs nothing."""

    __slots__ = ("article", "block", "block_tag", "context", "depth", "names", "path", "tag", "tags", "words")

    def __init__(self, tag: str, words: str, number: int, around: Element | None) -> None:
        self.tag = tag
        self.article = bool(around and around.article) or tag in ("article", "main")
        cost = -1.0 if tag == "header" and self.article else TAG_COST.get(tag, 0.0)  # the head of an article holds its title
        if HIDDEN in words.split():
            cost += BAD_COST
        names = (around.names if around else 0.0) + (0.0 if tag == "header" and self.article else name_cost(words, self.article))
        if tag in ("article", "main"):  # what these and the elements around them are called says nothing against them
            names = max(names, 0.0)
        self.names, self.tags = names, (around.tags if around else 0.0) + cost
        self.context = self.names + self.tags
        shown = tag in BLOCK_TAGS or words
        self.path = hash((around.path if around else 0, tag, words)) if shown else around.path if around else 0
        self.depth, self.words = (around.depth + 1, (*around.words[-AROUND + 1 :], words)) if around else (0, (words,))
        own = tag in BLOCK_TAGS
        self.block, self.block_tag = (number, tag) if own else (around.block, around.block_tag) if around else (-1, "")


def name_cost(words: str, inside: bool = False) -> float:
    """What the names of an element cost; ``inside`` an article only those that name boilerplate and nothing else count against it."""
    if not words:
        return 0.0
    if any(BAD_NAMES.fullmatch(w) for w in words.split() if w != HIDDEN):
        return BAD_COST
    if GOOD_NAMES.search(words):
        return GOOD_COST
    return WEAK_COST if WEAK_NAMES.search(words) or (not inside and HALF_BAD.search(words)) else 0.0


ROOT = Element("", "", -1, None)


class Open:
    """The open elements, with the places of each tag and of blocks, so that no tag needs a search through them."""

    def __init__(self) -> None:
        self.elements: list[Element] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def top(self) -> Element | None:
        return self.elements[-1] if self.elements else None

    def last(self, tag: str) -> int:
        return self.places[tag][-1] if self.places.get(tag) else -1

    def last_block(self) -> int:
        return self.blocks[-1] if self.blocks else -1

    def push(self, tag: str, words: str, number: int) -> None:
        self.places.setdefault(tag, []).append(len(self.elements))
        if tag in BLOCK_TAGS:
            self.blocks.append(len(self.elements))
        self.elements.append(Element(tag, words, number, self.top()))

    def close_from(self, k: int) -> None:
        while len(self.elements) > k:
            tag = self.elements.pop().tag
            self.places[tag].pop()
            if tag in BLOCK_TAGS:
                self.blocks.pop()


_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW_TAGS}


def _raw_end(page: str, tag: str, at: int) -> int:
    """Where the end tag of a raw element begins; the end of the page if there is none."""
    m = _RAW_END[tag].search(page, at)
    return m.start() if m else len(page)


def _words(attributes: str) -> str:
    """The class words of a tag; HIDDEN is one of those that are not shown."""
    held: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        held.setdefault(name.lower(), a or b or c)
    words = [w for n in _NAMED for w in held.get(n, "").split() if n != "class" or not _STATE.match(w)]
    if "hidden" in held or held.get("aria-hidden", "").strip().lower() == "true" or _NOT_SHOWN.search(held.get("style", "")):
        words.append(HIDDEN)
    return " ".join(words)


def blocks_of(page: str) -> list[Block]:
    """Blocks with text in page order."""
    out: list[Block] = []
    open_ = Open()
    count, at = 0, 0
    now: Block | None = None

    def close() -> None:
        nonlocal now
        if now is not None:
            now.text = _SPACE.sub(" ", html.unescape("".join(now.parts))).strip()
            if now.text:
                out.append(now)
        now = None

    n = len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        if m is None:  # a tag whose quotes never end
            at = _TAG_END.search(page, at + 1).end()
            continue
        at = m.end()
        if m[4] is not None:
            if now is None:
                if m[4].isspace():
                    continue
                now = Block(open_.top())
            now.parts.append(m[4])
            if open_.last("a") >= 0:
                now.links += len(m[4].strip())
            continue
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK_TAGS:
                close()
            k = open_.last(tag)
            if k >= 0 and (tag in BLOCK_TAGS or k > open_.last_block()):  # an inline end tag closes nothing outside its block
                open_.close_from(k)
            continue
        if tag in RAW_TAGS:
            if not m[3].rstrip().endswith("/"):
                at = _TAG_END.search(page, _raw_end(page, tag, at)).end()
            if now is not None:
                now.parts.append(" ")
            continue
        if tag == "br":
            if now is not None:
                now.parts.append(" ")
            continue
        if tag in BLOCK_TAGS:
            close()
            # a block ends an open paragraph, with the inline elements in it
            k = open_.last_block()
            around = open_.elements[k].tag if k >= 0 else ""
            if around == "p" or around == tag == "li" or around in ("td", "th") and tag in ("td", "th", "tr"):
                open_.close_from(k)
        if tag in VOID_TAGS or m[3].rstrip().endswith("/"):
            continue
        count += 1
        open_.push(tag, _words(m[3]) if m[3].strip() and tag not in ("html", "body") else "", count)
    close()
    return out


def features(b: Block, place: float) -> list[str]:
    """What ``fit`` learns about a block; whether it is inside the marked main text is not among it."""
    n = len(b.text)
    named = {f"c:{w.lower()}" for words in b.words for w in words.split()}
    return [f"t:{b.tag}", f"l:{4 * b.links // max(1, n)}", f"n:{min(n, 1000).bit_length()}", f"e:{b.text[-1] in ENDS}", f"d:{min(b.depth, 15) // 3}", f"q:{int(4 * place)}", *sorted(named)]


def cost(b: Block, place: float = 0.5, model: dict[str, float] | None = None) -> float:
    """The classifier: over 0 speaks for content."""
    n = len(b.text)
    c = BIAS + OWN_COST.get(b.tag, 0.0) + b.context + min(n, 300) / 200 - (2.0 if b.article else 4.0) * b.links / max(1, n)
    if model:
        c += max(-MOST, min(MOST, LEARNED * sum(model.get(f, 0.0) for f in features(b, place))))
    return c + (0.5 if n > 20 and b.text[-1] in ENDS else 0.0)


class Cut:
    """Minimum cut by Dinic's algorithm over adjacency lists."""

    def __init__(self, n: int) -> None:
        self.n, self.s, self.t = n, n, n + 1
        self.head: list[list[int]] = [[] for _ in range(n + 2)]
        self.to: list[int] = []
        self.cap: list[float] = []

    def edge(self, a: int, b: int, there: float, back: float = 0.0) -> None:
        self.head[a].append(len(self.to))
        self.to.append(b)
        self.cap.append(there)
        self.head[b].append(len(self.to))
        self.to.append(a)
        self.cap.append(back)

    def levels(self) -> list[int]:
        level = [-1] * (self.n + 2)
        level[self.s] = 0
        queue = deque([self.s])
        while queue:
            a = queue.popleft()
            for e in self.head[a]:
                if self.cap[e] > 1e-9 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        return level

    def source_side(self) -> list[bool]:
        while (level := self.levels())[self.t] >= 0:
            at = [0] * (self.n + 2)
            while True:
                path, a = [], self.s
                while a != self.t:
                    edges = self.head[a]
                    while at[a] < len(edges):
                        e = edges[at[a]]
                        if self.cap[e] > 1e-9 and level[self.to[e]] == level[a] + 1:
                            break
                        at[a] += 1
                    if at[a] < len(edges):
                        path.append(edges[at[a]])
                        a = self.to[edges[at[a]]]
                    elif path:
                        e = path.pop()
                        a = self.to[e ^ 1]
                        at[a] += 1
                    else:
                        break
                if a != self.t:
                    break
                flow = min(self.cap[e] for e in path)
                for e in path:
                    self.cap[e] -= flow
                    self.cap[e ^ 1] += flow
        return [x >= 0 for x in level[: self.n]]


def content(found: list[Block], model: dict[str, float] | None = None) -> list[bool]:
    g = Cut(len(found))
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        c = cost(b, i / len(found), model)
        if c > 0:
            g.edge(g.s, i, c)
        elif c < 0:
            g.edge(i, g.t, -c)
        if i:
            g.edge(i - 1, i, w := IN_ORDER if b.path == found[i - 1].path else FURTHER, w)
        if b.parent in last and last[b.parent] != i - 1:
            g.edge(last[b.parent], i, SAME_PARENT, SAME_PARENT)
        last[b.parent] = i
    return g.source_side()


def main_text(page: str | None, model: dict[str, float] | None = None) -> str:
    if not page:
        return ""
    found = blocks_of(page)
    return "\n".join(b.text for b, keep in zip(found, content(found, model), strict=True) if keep)


def _teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, content, n): blocks of pages that mark their main text; a null feature: all blocks."""
    seen: Counter = Counter()
    for batch in batches:
        for page in batch.column(0).to_pylist():
            found = blocks_of(page or "")
            if any(b.article for b in found):
                for i, b in enumerate(found):
                    label = b.article and b.context > 0
                    seen.update((f, label) for f in (None, *features(b, i / len(found))))
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in seen], pa.string()), pa.array([y for _, y in seen], pa.bool_()), pa.array(list(seen.values()), pa.int64())], names=["feature", "content", "n"])


def fit(pages: DataFrame) -> dict[str, float]:
    """Log-odds of features, from the marked pages among SAMPLE ones; empty where there is too little to learn from."""
    ship(pages.sparkSession)
    rows = pages.select(F.col("html").cast("string").alias("html")).where("html is not null").withColumn("h", F.xxhash64("html"))
    last = rows.select("h").distinct().orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]  # only hashes are sorted
    chosen = rows.where(F.col("h") <= F.lit(last if last is not None else 0)).groupBy("h").agg(F.first("html").alias("html"))
    seen = chosen.select("html").repartition(8).mapInArrow(_teach, "feature string, content boolean, n long").groupBy("feature").agg(F.sum(F.when(F.col("content"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(~F.col("content"), F.col("n")).otherwise(0)).alias("b"))
    got = seen.where(F.col("feature").isNull() | (F.col("a") + F.col("b") >= LEAST)).collect()  # features of at most SAMPLE pages
    a, b = next(((r["a"], r["b"]) for r in got if r["feature"] is None), (0, 0))
    if min(a, b) < LEAST:
        return {}
    odds = lambda x, y: math.log((x + 0.5) / (a + 1)) - math.log((y + 0.5) / (b + 1))
    return {r["feature"]: max(-MOST, min(MOST, odds(r["a"], r["b"]))) for r in got if r["feature"] is not None}


def extract(pages: DataFrame, model: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page; ``model``: of ``fit``, else learned from these pages."""
    ship(pages.sparkSession)
    held = pages.sparkSession.sparkContext.broadcast(fit(pages) if model is None else model)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                b = batch.slice(k, 128)
                text = [main_text(p, held.value) for p in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    return rows.mapInArrow(run, "page_id long, url string, text string").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
