"""HTML extraction: the maximum-scoring run of a page's tokens, with weights learned from labelled pages.

A page is read as a sequence of text runs and tags.  Every word scores the learned log odds that words of its place
(nearest container and innermost block) are article text, every tag a learned negative score; one linear scan finds the
contiguous run with the largest sum.  Pages that mark their article (one ``article`` or ``main`` element) are the labelled
pages; the weights also hold for pages that mark nothing.  Menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments inside the run are known by element, role, class or id and left out; a class, id or
role that names one of them does not count on an element that wraps the article itself.  Reading is linear in the page's
length, also where tags, quotes and elements are left open.

Text: character references are decoded, white space inside a block becomes one blank (``br`` counts as white space),
blocks are trimmed and joined in page order by one line break, empty blocks are left out; nothing else is dropped.

Fitted on a bounded sample: at most ``SAMPLE`` pages (all, when there are fewer), chosen by a hash of page_id; at most
``MAX_PLACES`` places reach the driver.  Every page is extracted whole.

Defined results: a null or empty html, and a page without text, give the empty text.  Unclosed and misnested elements
are closed with their parents, an unclosed script or comment reaches the page's end.  Extra columns are ignored, rows
may repeat.  An empty table gives an empty result.
"""

from __future__ import annotations

import html as references
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilebook.llm.common import bounded_sample

SAMPLE = 5_000
MAX_PLACES = 5_000
LEAST_TAG, MOST_TAG = -0.3, -0.02

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: A tag with more quoted values than this ends at its first ">".
MOST_QUOTED = 200
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAMES = re.compile(r"[A-Za-z][a-z]*|[A-Z]+|[0-9]+")

#: HTML elements by role.
RAW = set("iframe script style svg template textarea".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
             "hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
CONTAINERS = set("article aside body div footer form head header main nav section table".split())
LEFT_OUT = set("aside button dialog footer form head header menu nav select".split())
HEAD_ONLY = set("base link meta title".split())
#: Words of class and id names, and roles, of what is not the article.
LEFT_OUT_NAMES = set("ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr "
                     "masthead menu modal nav navbar navigation newsletter notice notices notification popup promo promoted promotion related replies reply respond share "
                     "sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split())
LEFT_OUT_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NEVER_LEFT_OUT = set("html body article main".split())
#: Elements that may wrap a whole page, and names of reader comments, which are left out however long they are.
WRAPPERS = set("dialog form".split())
COMMENT_NAMES = set("comment comments commentlist disqus replies reply respond".split())


def _names(rest: str) -> tuple[set[str], str]:
    """Words of an element's class and id, and its role."""
    words, role = set(), ""
    for kind, a, b, c in ATTRIBUTE.findall(rest):
        value = a or b or c
        if kind.lower() == "role":
            role = value.strip().lower()
        else:
            words |= {w.lower() for w in NAMES.findall(value)}
    return words, role


class _Reader:
    """Searches in a page; what was not found once is not looked for again, so reading stays linear on broken pages."""

    def __init__(self, page: str):
        self.page, self.gone = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        k = self.page.find(what, at)
        if k < 0:
            self.gone.add(what)
        return k

    def tag_end(self, at: int) -> int:
        """The ">" that ends a tag, outside quoted values; the first one where a quote is not closed; -1 without one."""
        first = self.find(">", at)
        if first < 0:
            return -1
        gt = first
        for _ in range(MOST_QUOTED):
            q = min((k for k in (self.page.find('"', at, gt), self.page.find("'", at, gt)) if k >= 0), default=-1)
            if q < 0:
                return gt
            end = self.find(self.page[q], q + 1)
            if end < 0:
                return first
            at = end + 1
            if gt < at:
                gt = self.find(">", at)
                if gt < 0:
                    return first
        return first


def scan(page: str):
    """The page's pieces in order: ("text", text), ("open", name, attributes), ("close", name)."""
    r, at, n = _Reader(page), 0, len(page)
    while at < n:
        lt = r.find("<", at)
        if lt != at:
            yield "text", page[at:lt] if lt >= 0 else page[at:]
        if lt < 0:
            return
        at = lt + 1
        if page.startswith("!--", at):
            end = r.find("-->", at + 3)
            at = n if end < 0 else end + 3
            continue
        close = page.startswith("/", at)
        name = NAME.match(page, at + close)
        special = page[at:at + 1] in ("!", "?", "/")
        end = r.tag_end(name.end()) if name else r.find(">", at) if special else -1
        if end < 0:
            yield "text", "<"
            continue
        at = end + 1
        if not name:
            continue
        tag = name[0].lower()
        if close:
            yield "close", tag
        elif tag in RAW and not page.startswith("/", end - 1):
            over = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(page, at)
            at = over.end() if over else n
        elif tag not in RAW:
            yield "open", tag, page[name.end():end]


class _Element:
    """An open element: what it is, whether its kind, its names or only its use as a wrapper leave it out, and its words."""

    __slots__ = ("name", "parent", "container", "block", "kind_out", "name_out", "comments", "article", "words", "kept", "out")

    def __init__(self, name: str, parent: _Element | None, rest: str):
        words, role = _names(rest) if "=" in rest else (set(), "")
        self.name, self.parent, self.words, self.kept = name, parent, 0, False
        up = parent or self
        self.container = f"{name}.{'.'.join(sorted(words))}" if name in ("div", "section", "table") and words else name if name in CONTAINERS or not parent else up.container
        self.block = name if name in BLOCKS or not parent else up.block
        self.article = name in ("article", "main") or parent is not None and parent.article
        self.comments = bool(words & COMMENT_NAMES) or parent is not None and parent.comments
        named = name not in NEVER_LEFT_OUT and (bool(words & LEFT_OUT_NAMES) or role in LEFT_OUT_ROLES or name in WRAPPERS)
        self.name_out = named and not (name in LEFT_OUT - WRAPPERS)
        self.kind_out = name in LEFT_OUT - WRAPPERS or name == "noscript" and not self.article


def tokens(page: str):
    """The page's tokens in order: ("text", text, place, out, article) and ("tag", name, place, out, article).

    place: nearest container (a div or section with its names) and innermost block; out: inside something left out;
    article: inside an article or main element.

    An element whose kind leaves it out (a menu, a footer) is always out.  One that only its names leave out, or a form or
    dialog, stays when it wraps the page's main part: the article or main element with most words, or more than half of
    the words outside what is left out by kind.  Reader comments are out however long they are.
    """
    root = _Element("body", None, "")
    root.name, root.block = "", ""
    seen: list[tuple] = []
    stack, count = [root], {}
    articles: list[_Element] = []
    barred = 0   # open elements left out by kind
    special: list[int] = []   # where the open nav, header, footer and head elements are in the stack

    def close_to(depth: int) -> None:
        nonlocal barred
        while len(stack) > depth:
            e = stack.pop()
            count[e.name] -= 1
            barred -= e.kind_out
            stack[-1].words += e.words
            if special and special[-1] == len(stack):
                special.pop()

    for piece in scan(page):
        if piece[0] == "text":
            seen.append(("text", piece[1], stack[-1]))
            if not barred:
                stack[-1].words += len(piece[1].split())
            continue
        name = piece[1]
        if piece[0] == "close":
            if count.get(name):
                close_to(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name))
            seen.append(("tag", name, stack[-1]))
            continue
        rest = piece[2]
        if name in ("body", "article", "main") and special:
            close_to(special[0])
        elif stack[-1].name == "head" and name not in HEAD_ONLY:
            close_to(len(stack) - 1)
        e = _Element(name, stack[-1], rest)
        seen.append(("tag", name, e))
        if name in VOID or rest.endswith("/"):
            continue
        if name in ("nav", "header", "footer", "head"):
            special.append(len(stack))
        stack.append(e)
        count[name] = count.get(name, 0) + 1
        barred += e.kind_out
        if name in ("article", "main") and not barred and not e.comments:
            articles.append(e)
    close_to(1)
    primary = max(articles, key=lambda e: e.words, default=None)
    up = primary
    while up is not None:
        up.kept, up = True, up.parent
    half = (primary or root).words / 2
    for _, _, e in seen:
        _settle(e, half)
    for kind, what, e in seen:
        yield kind, what, (e.container, e.block), e.out, e.article


def _settle(e: _Element, half: float) -> None:
    """Whether an element is out, from its outermost ancestor that is not settled inwards."""
    path = []
    while e is not None and not hasattr(e, "out"):
        path.append(e)
        e = e.parent
    for e in reversed(path):
        wraps = e.kept or e.words > half and not e.comments
        e.out = (e.parent is not None and e.parent.out) or e.kind_out or e.name_out and not wraps


def _counts(page: str) -> dict[str, list[int]]:
    """For a page that marks its article: words by place and tags by name, outside and inside the article."""
    out: dict[str, list[int]] = {}
    seen = list(tokens(page))
    if sum(1 for kind, name, _, _, article in seen if kind == "tag" and article and name in ("article", "main")) == 0:
        return out
    for kind, what, place, left, article in seen:
        at = int(article and not left)
        if kind == "tag":
            out.setdefault(f"tag {what}", [0, 0])[at] += 1
        elif n := len(what.split()):
            for key in (f"place {place[0]} {place[1]}", f"container {place[0]}", f"block {place[1]}"):
                out.setdefault(key, [0, 0])[at] += n
    return out


def train(pages: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Learned scores by key (place, container, block, tag)."""
    def run(batches):
        for b in batches:
            total: dict[str, list[int]] = {}
            for page in b.column("html").to_pylist():
                for k, (o, i) in _counts(page).items():
                    t = total.setdefault(k, [0, 0])
                    t[0] += o
                    t[1] += i
            yield pa.RecordBatch.from_pydict({"key": list(total), "outside": [t[0] for t in total.values()], "inside": [t[1] for t in total.values()]},
                                             schema=pa.schema([("key", pa.string()), ("outside", pa.int64()), ("inside", pa.int64())]))

    rows = bounded_sample(pages.filter(F.col("html").isNotNull()).select("page_id", "html"), "page_id", sample).select("html")
    counts = rows.mapInArrow(run, "key string, outside long, inside long").groupBy("key").agg(F.sum("outside").alias("outside"), F.sum("inside").alias("inside"))
    top = counts.orderBy((F.col("outside") + F.col("inside")).desc(), "key").limit(MAX_PLACES)
    odds = lambda r: math.log((r["inside"] + 1) / (r["outside"] + 1))
    return {r["key"]: max(LEAST_TAG, min(MOST_TAG, 0.1 * odds(r))) if r["key"].startswith("tag ") else max(-3.0, min(3.0, odds(r))) for r in top.collect()}


def best_run(scores: list[float]) -> tuple[int, int]:
    """Begin and end of the contiguous run with the largest sum; (0, 0) when no sum is positive.  Ties: the first run."""
    best, found, total, begin = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += s
        if total > best:
            best, found = total, (begin, i + 1)
    return found


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The main text of one page."""
    if not page:
        return ""
    seen = list(tokens(page))
    scores = []
    for kind, what, place, left, _ in seen:
        if kind == "tag":
            scores.append(weights.get(f"tag {what}", LEAST_TAG / 2))
        elif left:
            scores.append(0.0)
        else:
            n = len(what.split())
            if n:
                w = next((weights[k] for k in (f"place {place[0]} {place[1]}", f"container {place[0]}", f"block {place[1]}") if k in weights), 1.0)
                n *= w
            scores.append(float(n))
    begin, end = best_run(scores)
    blocks: list[list[str]] = [[]]
    for kind, what, _, left, _ in seen[begin:end]:
        if kind == "text":
            if not left:
                blocks[-1].append(references.unescape(what))
        elif what in BLOCKS:
            blocks.append([])
        elif what == "br":
            blocks[-1].append(" ")
    return "\n".join(t for t in (" ".join("".join(b).split()) for b in blocks) if t)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    weights = pages.sparkSession.sparkContext.broadcast(train(pages))

    def run(batches):
        for b in batches:
            texts = [extract(p, weights.value) for p in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
