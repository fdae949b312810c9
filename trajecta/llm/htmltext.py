"""Main text of web pages: the maximum-scoring run of a page's words and tags.

A page is read as a sequence of words and tags. Words of running text score positive, tags
negative; how much is learned from pages that mark their article themselves (``article`` or
``main``), as log-odds of each tag, and of words by the element they stand in. One linear scan
finds the contiguous region with the largest sum; boilerplate elements inside it are left out.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, slices

SAMPLE = 2_000  # labelled pages that weights are learned from, at most

_TOKEN = re.compile(
    r"""(?is)<!--.*?(?:-->|\Z)
    |<(?P<raw>script|style|title|textarea|noscript|template|iframe|svg)\b[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)
    |<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^"'<>]++|"[^"<]*+"|'[^'<]*+')*+)>
    |<[a-z/!?][^>]*+(?:>|\Z)
    |(?P<text>[^<]+|<)""",
    re.X,
)
_NAMED = re.compile(r"""(?i)\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
_FOREIGN = r"ad|ads|advert\w*|sponsor\w*|promo\w*|cookies?|consent|popup|modal|comments?|disqus|replies|newsletter|subscribe"
_HINT = re.compile(rf"(?i)(?:^|[\s_\"'-])(?:(?P<foreign>{_FOREIGN})|banner|notice|sidebar|menu|nav\w*|breadcrumbs?|footer|header|share|social|related|pagination|widget)(?:$|[\s_\"'-])")
_BOILER = frozenset("nav header footer aside form button select option label dialog menu".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo cite code del dfn em font i img ins kbd mark q s samp small span strong sub sup time tt u var wbr".split())
_MAIN = frozenset(("article", "main"))
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_ENDS = frozenset((None, "body", "html"))  # what is still open there was never closed
_WHOLE = frozenset("html body article main".split())
_CHOICES = frozenset("select option".split())  # hold no blocks: a block ends them
_BLOCKS = frozenset("article blockquote div h1 h2 h3 main p section table".split())

#: What says that an element is no part of the article: nothing; a part of a name; its tag, a whole name or a part of
#: a name of what others write; a whole such name.
NOTHING, PART, NAME, FOREIGN = range(4)


def _suspicion(tag: str, attrs: str) -> int:
    if tag in _WHOLE:
        return NOTHING
    out = NAME if tag in _BOILER else NOTHING
    if "=" in attrs:
        for v in _NAMED.findall(attrs):
            v = v.strip("\"'")
            name = v.split()
            for m in _HINT.finditer(v):
                whole = any(_HINT.fullmatch(x) and m[0].strip("\"' _-") in x for x in name)
                if m["foreign"] and whole:
                    return FOREIGN
                out = max(out, NAME if whole or m["foreign"] else PART)
    return out


class Page:
    """Tags and text runs of a page in order, and the elements that may be boilerplate.

    ``tokens`` has (feature, text, element, inside a marked article); a tag's text is ``""`` (inline),
    ``" "`` (line break) or ``"\\n"`` (block border), and the element is the innermost suspected one (0: the page).
    ``suspicion``, ``parent`` and ``holds_main`` describe these. One that no end tag closes ends at its first block:
    what follows is an element of its own in its parent. A marked article ends what was left open before it.
    """

    def __init__(self, page: str):
        self.tokens: list[tuple[str, str, int, bool]] = []
        self.suspicion, self.parent, self.holds_main = [NOTHING], [0], [False]
        self._rest: dict[int, int] = {}  # of an element, the part from its first block on
        self._stack: list[tuple[str, int, bool, bool]] = []  # tag, innermost suspected element, in main, is suspected itself
        self._open: dict[str, list[int]] = {}
        for m in _TOKEN.finditer(page):
            if m["text"] is not None:
                _, own, main, _ = self._top()
                self.tokens.append((f"in {self._stack[-1][0] if self._stack else 'page'}", m["text"], own, main))
            elif m["tag"]:
                self._tag(m["tag"].lower(), bool(m["end"]), m["attrs"])
            else:
                self.tokens.append((f"<{(m['raw'] or '!').lower()}", "", -1, False))
        self._close(0, None)

    def _top(self) -> tuple[str, int, bool, bool]:
        if not self._stack:
            return "", 0, False, False
        tag, own, main, suspected = self._stack[-1]
        return tag, self._rest.get(own, own), main, suspected

    def _add(self, suspicion: int, parent: int) -> int:
        self.suspicion.append(suspicion)
        self.parent.append(parent)
        self.holds_main.append(False)
        return len(self.parent) - 1

    def _close(self, at: int, by: str | None) -> None:
        """Close all elements from place ``at`` of the stack on, by the end of an element ``by`` (None: of the page)."""
        while len(self._stack) > at:
            tag, own, _, suspected = self._stack.pop()
            self._open[tag].pop()
            if suspected and own in self._rest and by in _ENDS:
                rest = self._rest[own]
                self.parent[rest], self.suspicion[rest] = self.parent[own], NOTHING

    def _tag(self, tag: str, end: bool, attrs: str) -> None:
        text = "" if tag in _INLINE else " " if tag == "br" else "\n"
        if end:
            if self._open.get(tag):
                at = self._open[tag][-1]
                self._close(at, tag)
            _, own, main, _ = self._top()
            self.tokens.append((f"</{tag}", text, own, main))
            return
        if tag in _CLOSES_P:
            at = next((i for i in range(len(self._stack) - 1, max(-1, len(self._stack) - 8), -1) if self._stack[i][0] == "p"), None)
            if at is not None and all(x[0] in _INLINE for x in self._stack[at + 1 :]):
                self._close(at, "p")
        if tag in _BLOCKS:
            while self._stack and self._stack[-1][0] in _CHOICES:
                self._close(len(self._stack) - 1, self._stack[-1][0])
        if tag in _MAIN:
            while self._stack and self._top()[1]:
                self._close(len(self._stack) - 1, tag)
        _, own, main, _ = self._top()
        if tag in _BLOCKS and self._stack and self._stack[-1][3] and self._stack[-1][1] not in self._rest:
            first = self._stack[-1][1]
            self._rest[first] = own = self._add(self.suspicion[first], first)
        suspicion = _suspicion(tag, attrs)
        if suspicion:
            own = self._add(suspicion, own)
        if tag in _MAIN:
            main = self.holds_main[own] = True
        if tag not in _VOID and not attrs.endswith("/"):
            self._open.setdefault(tag, []).append(len(self._stack))
            self._stack.append((tag, own, main, bool(suspicion)))
        self.tokens.append((f"<{tag}", text, own, main))

    def left_out(self, model: dict | None) -> list[bool]:
        """Of each element, whether it is boilerplate; without a model, whether anything says so.

        What an element itself holds, without suspected elements inside, has a best region. One
        with a name of what others write is left out if there is text elsewhere; one with a
        boilerplate tag or name unless no other region of the page scores more; one with
        such a part in its name if its region scores less than half of the page's best. On a page that marks
        its article, regions count inside the mark only. An element that holds one that stays, stays.
        """
        n = len(self.parent)
        stays = [s == NOTHING for s in self.suspicion]
        if model is not None:
            marked, total, best, told = any(t[3] for t in self.tokens), [0.0] * n, [0.0] * n, [False] * n
            for feature, text, own, main in self.tokens:
                if own < 0 or marked and not main:
                    continue
                if own and not told[own]:  # left out whole, it costs its parent one tag's place
                    told[own] = True
                    total[self.parent[own]] = max(0.0, total[self.parent[own]] - 1.0)
                total[own] = max(0.0, total[own] + _score(feature, text, model))
                best[own] = max(best[own], total[own])
            most = max((b for b, s in zip(best, self.suspicion, strict=True) if s != FOREIGN), default=0.0)
            need = [0.0, most / 2, most, most if most <= 0 else math.inf]
            if most <= 0:
                need[FOREIGN] = max(best)
            stays = [s == NOTHING or b > 0 and b >= need[s] for s, b in zip(self.suspicion, best, strict=True)]
        holds = list(self.holds_main)
        for i in range(n - 1, 0, -1):  # parts come after what holds them
            stays[i] |= holds[i]
            if stays[i] and self.suspicion[i]:
                stays[self.parent[i]] = True
            holds[self.parent[i]] |= holds[i]
        out = [False] * n
        for i in range(1, n):  # and what holds them before
            out[i] = not stays[i] or out[self.parent[i]]
        return out


def _counts(pages: list[str]) -> tuple[Counter, Counter]:
    inside, outside = Counter(), Counter()
    for page in pages:
        read = Page(page)
        if not any(t[3] for t in read.tokens):
            continue
        out = read.left_out(None)
        for feature, text, own, main in read.tokens:
            n = len(text.split()) if feature.startswith("in ") else 1
            (inside if main and own >= 0 and not out[own] else outside)[feature] += n
    return inside, outside


#: Used where no page marks its article. What frames a heading or a paragraph costs less than a word gains.
DEFAULT = {"word": 1.0, "tag": -3.0, "weights": {"in a": -1.0, "in li": -0.5, "<br": -0.1} | {f"{end}{tag}": -0.1 for end in ("<", "</") for tag in "p h1 h2 h3 h4 h5 h6 blockquote pre section div".split()}}


def learn(pages: DataFrame, sample: int = SAMPLE) -> dict:
    """Weights from ``pages(page_id, html)`` that mark an article; at most about ``sample`` pages, by a hash of the id.

    Executors count; only the counts of tag names reach the driver.
    """
    marked = pages.where("html is not null").where(F.rlike("html", F.lit(r"(?i)<(?:article|main)\b"))).withColumn("_pick", F.xxhash64("page_id"))
    last = marked.select("_pick").orderBy("_pick").limit(sample).agg(F.max("_pick")).first()[0]
    if last is None:
        return DEFAULT

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, column="html"):
            inside, outside = _counts(b.column("html").to_pylist())
            keys = sorted({*inside, *outside})
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([inside[k] for k in keys], pa.int64()), pa.array([outside[k] for k in keys], pa.int64())], names=["feature", "inside", "outside"])

    found = marked.where(F.col("_pick") <= last).select("html").mapInArrow(count, "feature string, inside long, outside long")
    rows = found.groupBy("feature").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).collect()
    n_in, n_out = sum(r["i"] for r in rows) + len(rows), sum(r["o"] for r in rows) + len(rows)
    weights = {}
    for r in rows:
        odds = math.log((r["i"] + 0.5) / n_in) - math.log((r["o"] + 0.5) / n_out)
        if r["feature"][1:].lstrip("/") in _MAIN:
            odds = -0.1  # the marks that give the labels say nothing about pages without them
        weights[r["feature"]] = odds if r["feature"].startswith("in ") else min(odds, -0.1)
    return {"word": 0.5, "tag": -3.0, "weights": weights}


def _score(feature: str, text: str, model: dict) -> float:
    if feature.startswith("in "):
        return len(text.split()) * model["weights"].get(feature, model["word"])
    return model["weights"].get(feature, model["tag"])


def extract(page: str | None, model: dict) -> str:
    """Text of the best region: blocks joined by an empty line."""
    read = Page(page or "")
    out = read.left_out(model)
    tokens = [(feature, text, own < 0 or out[own]) for feature, text, own, _ in read.tokens]
    best, total, start, region = 0.0, 0.0, 0, (0, 0)
    for i, (feature, text, boiler) in enumerate(tokens):
        if boiler:  # it is left out whole, so only its place counts
            total -= 0.0 if i and tokens[i - 1][2] else 1.0
        else:
            total += _score(feature, text, model)
        if total > best:
            best, region = total, (start, i + 1)
        elif total <= 0:
            total, start = 0.0, i + 1
    blocks, run = [], []
    for feature, text, boiler in tokens[slice(*region)]:
        if not feature.startswith("in ") and text == "\n":
            blocks.append("".join(run))
            run = []
        elif not boiler:
            run.append(html.unescape(text))
    blocks.append("".join(run))
    return "\n\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def extract_pages(pages: DataFrame, model: dict) -> DataFrame:
    """``page_id, url, text`` of every row of ``pages(page_id, url, html)``.

    The whole page is read, however long, in time that grows with its length. An element whose tag, class, id or role says that
    it is boilerplate is left out, unless it holds a marked article or the page's best region of text (see
    ``Page.left_out``), so an article stays whatever its wrapper is called. A null or empty page, and one without running text, gives an
    empty text; markup may be cut off anywhere. Repeated rows are each extracted; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, column="html"):
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array([extract(x, model) for x in b.column("html").to_pylist()], pa.string())], names=["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")


def op9_extract_html(spark, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return extract_pages(pages, learn(pages)).withColumn("n_chars", F.length("text").cast("long"))
