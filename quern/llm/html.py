"""Operator 8, main text of web pages as a maximum-scoring subsequence of tokens.

A page is a sequence of words and tags. Words score by how often words in such a block, and under
elements of such names, are content on labelled pages; tags score below zero by how rarely they
stand in content; one linear scan finds the contiguous run with the largest sum, which is the
content region. No list of names takes part in that. What stands inside the region but is no article
text by its element or class (`BOILER_TAGS`, `BOILER_NAMES`: menus, notices, adverts, forms,
comments) is left out of the region's text, and costs too little to part an article.

Labelled pages are those that mark their content with an article element, at most `SAMPLE` of them,
the smallest by the hash of the page; the element itself is no feature. Reading is linear in a page.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table, texts_of

#: Labelled pages at most.
SAMPLE = 400

# A quoted value may hold >, but only if its closing quote ends a value; else a quote is a sign like others.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][\w:-]*)((?:[^>\"']|\"[^\"<]*\"(?=[\s/>]|\Z)|'[^'<]*'(?=[\s/>]|\Z)|[\"'])*+)(?:>|\Z)",
    re.S,
)
_RAW = ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "title")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in _RAW}
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: Elements, and words in class, id or role, of what isn't the article.
BOILER_TAGS = frozenset("nav footer aside form menu button select dialog head".split())
BOILER_NAMES = frozenset("nav navbar navigation menu topbar footer sidebar aside ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent notice popup modal comment comments replies disqus share sharing social related recommended breadcrumb breadcrumbs subscribe newsletter login signup search pagination pager widget complementary contentinfo".split())


#: Elements that hold content and all else alike, or that the nearest block tells of already.
_NEUTRAL = frozenset("html body main article section div span p".split())


def _names(tag: str, attrs: str) -> set[str]:
    """The words of an element's class, id and role."""
    if not attrs or tag in ("html", "body", "main", "article"):
        return set()
    return {w for m in _NAMES.finditer(attrs) for w in re.split(r"[^a-z]+", (m[1] or m[2] or m[3] or "").lower()) if w}


class Page:
    """Tokens of a page: (kind, text, block, within, boiler); kind is w for a run of text, the tag, or /tag.

    `block` is the nearest block element; `within` numbers an entry of `contexts`, (the one around it,
    names that it adds), names being tags and words of class, id or role; `article` tells for each
    token whether it stands in an article element. Broken markup is read as it comes: an end tag
    closes the nearest open element of its name, an open p ends where a block begins.
    """

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str, str, int, bool]] = []
        self.article: list[bool] = []
        self.contexts: list[tuple[int, list[str]]] = [(0, [])]
        stack = [("", "body", 0, False, False, [])]  # tag, nearest block, context, boilerplate, in an article, names added
        open_tags, open_names = Counter(), set()
        at, n = 0, len(source)
        self.labelled = False

        def put(kind, text):
            _, block, within, boiler, article, _ = stack[-1]
            self.tokens.append((kind, text, block, within, boiler))
            self.article.append(article)

        def close(tag):
            while True:
                top = stack.pop()
                open_tags[top[0]] -= 1
                open_names.difference_update(top[5])
                if top[0] == tag:
                    return

        while at < n:
            m = _TOKEN.search(source, at)
            end = m.start() if m else n
            if end > at:
                put("w", source[at:end])
            if not m:
                break
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                put("/" + tag, "")
                if open_tags[tag]:
                    close(tag)
                continue
            if tag in _RAW:
                found = _RAW_END[tag].search(source, at)
                at = found.end() if found else n
                continue
            if tag in BLOCK and any(x[0] == "p" for x in stack[-4:]):
                close("p")
            _, block, within, boiler, article, _ = stack[-1]
            own = _names(tag, m[3])
            # A header is the page's unless it stands in an article.
            boiler = boiler or tag in BOILER_TAGS or not BOILER_NAMES.isdisjoint(own) or (tag == "header" and not article)
            self.labelled |= tag == "article"
            if tag not in VOID and not m[3].endswith("/"):
                new = sorted((own | ({tag} - _NEUTRAL)) - open_names)
                if new:
                    open_names.update(new)
                    self.contexts.append((within, new))
                    within = len(self.contexts) - 1
                stack.append((tag, tag if tag in BLOCK else block, within, boiler, article or tag == "article", new))
                open_tags[tag] += 1
            put(tag, "")


def _odds(inside: Counter, outside: Counter, floor: float) -> dict[str, float]:
    a, b = sum(inside.values()) + 1, sum(outside.values()) + 1
    return {k: math.log((inside[k] / a + floor) / (outside[k] / b + floor)) for k in inside | outside}


class Extractor:
    """Weights of words by block and names and of tags, and the scan that uses them.

    `lists` False leaves the lists of boilerplate out, so that the scan alone decides."""

    def __init__(self, labelled: list[str], lists: bool = True):
        self.lists = lists
        words, names, tags = ((Counter(), Counter()) for _ in range(3))
        for source in labelled:
            page = Page(source)
            under = [[0, 0] for _ in page.contexts]
            for (kind, text, block, within, _), on in zip(page.tokens, page.article, strict=True):
                if kind == "w":
                    n = len(text.split())
                    words[not on][block] += n
                    under[within][not on] += n
                elif kind.strip("/") != "article":
                    tags[not on][kind] += 1
            for i in range(len(under) - 1, 0, -1):  # inner contexts follow outer ones
                up, new = page.contexts[i]
                for side in (0, 1):
                    under[up][side] += under[i][side]
                    for x in new:
                        names[side][x] += under[i][side]
        total = [Counter({"": 1}) + Counter({"": sum(c.values())}) for c in words]
        self.word = _odds(*words, 1e-4)
        self.name = {k: math.log((names[0][k] / total[0][""] + 1e-3) / (names[1][k] / total[1][""] + 1e-3)) for k in names[0] | names[1]}
        self.tag = {k: min(-0.02, max(-1.0, x)) for k, x in _odds(*tags, 1e-2).items()}

    def weights(self, page: Page) -> list[float]:
        """Blocks and tags not seen on labelled pages count a little, unseen names nothing. What is left
        out of a region's text anyway costs a fiftieth at most: too little to part an article."""
        sums = [0.0]
        for up, new in page.contexts[1:]:
            sums.append(sums[up] + sum(self.name.get(x, 0.0) for x in new))
        out = []
        for kind, text, block, within, boiler in page.tokens:
            boiler = boiler and self.lists
            if kind != "w":
                w = self.tag.get(kind, -0.2)
            elif n := len(text.split()):
                w = n * max(-2.0, min(-0.5 if boiler else 2.0, self.word.get(block, 0.5) + sums[within]))
            else:
                w = 0.0
            out.append(0.02 * w if boiler else w)
        return out

    def region(self, page: Page) -> tuple[int, int]:
        """Token range with the largest sum, the first of the longest such; empty if no sum is above 0."""
        best, span, total, start = 0.0, (0, 0), 0.0, 0
        for i, w in enumerate(self.weights(page)):
            if total <= 0:
                total, start = 0.0, i
            total += w
            if total > best:
                best, span = total, (start, i + 1)
        return span

    def text(self, source: str) -> str:
        page = Page(source)
        if not page.tokens:
            return ""
        start, end = self.region(page)
        blocks, now = [], []
        for kind, text, _, _, boiler in page.tokens[start:end]:
            if kind == "w":
                if not (boiler and self.lists):
                    now.append(html.unescape(text))
            elif kind in ("br", "/br"):
                now.append(" ")
            elif kind.strip("/") in BLOCK:
                blocks.append("".join(now))
                now = []
        blocks.append("".join(now))
        return " ".join(x for b in blocks if (x := " ".join(b.split())))


def fitted(pages: DataFrame, rows: int = SAMPLE) -> Extractor:
    # Hashes alone are ranked, so no task sends pages that another's then displace; equal pages count once.
    marked = pages.where(F.col("html").contains("<article")).select("html", F.xxhash64("html").alias("h"))
    least = marked.groupBy("h").agg(F.lit(1).alias("one")).orderBy("h").limit(rows).select("h")
    some = marked.join(F.broadcast(least), "h").groupBy("h").agg(F.first("html").alias("html")).orderBy("h").select("html").collect()
    return Extractor([r[0] for r in some])


def extracted(pages: DataFrame, extractor: Extractor) -> DataFrame:
    """page_id, url, text, n_chars. A null or empty page has an empty text; repeated rows each return
    a row; an empty table returns none; extra columns are left out."""
    kinds = dict(pages.dtypes)

    def make():
        def step(batch):
            got = [extractor.text(t) for t in texts_of(batch, "html")]
            return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": got, "n_chars": [len(t) for t in got]}

        return step

    return map_batches(pages.select("page_id", "url", "html"), f"page_id {kinds['page_id']}, url string, text string, n_chars long", "html", make)


def op8_max_subsequence_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extracted(pages, fitted(pages))
