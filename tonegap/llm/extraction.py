"""Main text of web pages by consensus of a host's pages on where it stands.

A first pass scores each page's containers by the text of their blocks, less what stands in links, and
names the best one by its generalised path: the tags from the root on, with their classes, digits
made equal. In Spark every page votes for its path and each host's most voted path wins. A second pass
extracts again, now from the elements on the host's path; a page that has none, or no text there,
keeps its own best container, and so does one whose own container encloses these elements and has twice their text.
"""

from __future__ import annotations

import html
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegap.llm.common import arrow_map, stored
from tonegap.llm.url_rules import url_host

_TOKEN = regex.compile(
    r"<!--(?s:.*?)(?:-->|\Z)|<!\[CDATA\[(?s:.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+'|[\"'])*?)(?:>|\Z)"
)
_ATTR = regex.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = regex.compile(r"[^\W_]+")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup; it goes with them.
RAW = set("script style textarea title xmp noembed noframes".split())
#: Elements that are never part of an article.
AWAY = set(
    "nav footer aside form script style noscript template iframe svg math canvas audio video object head title button "
    "select option textarea label input dialog menu menuitem datalist xmp noembed noframes".split()
)
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
CONTAINERS = set("#root article main section div td body html blockquote center".split())
#: A start tag in the key closes an open element of the value, up to the next table or list.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIERS = set("table ul ol dl select html body".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of a class or id that mark what is not the article, whatever else is there.
MARKS = set(
    "nav navbar navigation menu footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored promo "
    "promotion cookie cookies consent gdpr notice notices popup modal overlay comment comments commentlist disqus respond "
    "replies share sharing social related recommended recommendations newsletter subscribe subscription breadcrumb breadcrumbs "
    "pagination pager login signup skip".split()
)
#: The same, unless a word of ``OWN`` stands beside it.
WEAK_MARKS = set("header masthead topbar banner widget widgets toolbar search alert form tags bottom copyright".split())
OWN = set("article post entry content story body main text".split())


@dataclass
class Element:
    """``holder`` is the nearest container (maybe itself), ``step`` a hash of the path down to here."""

    tag: str
    name: str
    away: bool
    parent: int
    holder: int
    step: int
    in_article: bool


def step_hash(above: int, name: str) -> int:
    return xxhash.xxh3_64_intdigest(name.encode("utf-8", "replace"), above)


@dataclass
class Page:
    """Elements and blocks (text, innermost element, characters in links) in page order."""

    elements: list[Element]
    blocks: list[tuple[str, int, int]]

    def path(self, at: int) -> str:
        names = []
        while at > 0:
            names.append(self.elements[at].name)
            at = self.elements[at].parent
        return "/".join(reversed(names))

    def on_path(self, path: str) -> list[int]:
        step = 0
        for name in path.split("/") if path else []:
            step = step_hash(step, name)
        return [i for i, e in enumerate(self.elements) if e.step == step and not e.away]

    def best(self) -> tuple[int, float] | None:
        """The container with the most text in its blocks, with half the weight each level up, and its score.

        An article or main element around it takes its place, else the widest element around it, below the body,
        each level of which adds text that is not mostly links.
        """
        scores: dict[int, float] = {}
        for text, at, linked in self.blocks:
            weight = max(0, len(text) - 2 * linked)
            for _ in range(3):
                if at < 0:
                    break
                at = self.elements[at].holder
                scores[at] = scores.get(at, 0) + weight
                weight, at = weight * 0.5, self.elements[at].parent
        if not scores or not any(scores.values()):
            return None
        at = top = max(scores, key=lambda i: (scores[i], -i))
        found: dict[str, int] = {}
        while top >= 0:
            found[self.elements[top].tag] = top
            top = self.elements[top].parent
        return found.get("article", found.get("main", self.widened(at))), scores[at]

    def widened(self, at: int) -> int:
        weights, counts = [0] * len(self.elements), [0] * len(self.elements)
        for text, i, linked in self.blocks:
            weights[i] += len(text) - 2 * linked
            counts[i] += 1
        for i in range(len(self.elements) - 1, 0, -1):  # parents come first
            weights[self.elements[i].parent] += weights[i]
            counts[self.elements[i].parent] += counts[i]
        wide, up = at, self.elements[at].parent
        while up >= 0 and self.elements[up].tag not in ("body", "html", "#root"):
            if counts[up] > counts[wide]:
                if weights[up] <= weights[wide]:
                    break
                wide = up
            up = self.elements[up].parent
        return wide

    def encloses(self, top: int, others: list[int]) -> bool:
        inside = [False] * len(self.elements)
        inside[top] = True
        for i in range(top + 1, len(self.elements)):
            inside[i] = inside[self.elements[i].parent]
        return all(inside[i] for i in others)

    def text(self, tops: list[int]) -> str:
        inside = [False] * len(self.elements)
        for i in tops:
            inside[i] = True
        for i, e in enumerate(self.elements):  # parents come first
            inside[i] = inside[i] or (e.parent >= 0 and inside[e.parent])
        return "\n".join(text for text, at, _ in self.blocks if inside[at])


def is_away(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Whether an element is boilerplate by its tag, role or names."""
    if tag in AWAY or (tag == "header" and not in_article):
        return True
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in ROLES:
        return True
    if "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    if tag in ("body", "html", "main", "article") and not in_article:
        return bool({"comment", "comments"} & set(_PART.findall(attrs.get("class", "").lower())))
    words = set(_PART.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()))
    return bool(words & MARKS or words & WEAK_MARKS and not words & OWN)


def parse(source: str | None) -> Page:
    """Blocks of a whole page outside boilerplate, for any input, however broken."""
    source = source or ""
    elements, blocks = [Element("#root", "", False, -1, 0, 0, False)], []
    stack, open_blocks, words, linked = [0], [], [], 0
    at, links, open_tags = 0, 0, Counter()

    def flush():
        nonlocal words, linked
        text = " ".join("".join(words).split())
        if text and not elements[stack[-1]].away:
            blocks.append((text, stack[-1], min(linked, len(text))))
        words, linked = [], 0

    def add(raw: str):
        nonlocal linked
        if raw and not elements[stack[-1]].away:
            words.append(html.unescape(raw))
            if links:
                linked += len(raw.strip())

    def close(depth: int):
        nonlocal links
        gone = [elements[i].tag for i in stack[depth:]]
        if any(t in BLOCKS for t in gone):
            flush()
        links -= gone.count("a")
        open_tags.subtract(gone)
        del stack[depth:]
        while open_blocks and open_blocks[-1] >= depth:
            open_blocks.pop()

    while at < len(source):
        m = _TOKEN.search(source, at)
        if m is None:
            add(source[at:])
            break
        add(source[at : m.start()])
        at = m.end()
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if open_tags[tag] > 0:
                close(next(d for d in range(len(stack) - 1, 0, -1) if elements[stack[d]].tag == tag))
            elif tag in BLOCKS:
                flush()
            continue
        if tag == "br":
            words.append(" ")
            continue
        if tag in VOID:
            if tag in BLOCKS:
                flush()
            continue
        attrs = {a[0].lower(): html.unescape(a[1] or a[2] or a[3]) for a in _ATTR.findall(m["attrs"])} if m["attrs"].strip() else {}
        if tag in RAW:
            ends = regex.compile(rf"</{regex.escape(tag)}(?=[\s/>]|\Z)[^>]*+>?", regex.I).search(source, at)
            at = ends.end() if ends else len(source)
            continue
        if tag in BLOCKS and open_blocks and elements[stack[open_blocks[-1]]].tag == "p":
            close(open_blocks[-1])
        for d in range(len(stack) - 1, 0, -1) if any(open_tags[t] > 0 for t in CLOSES.get(tag, ())) else ():
            open_tag = elements[stack[d]].tag
            if open_tag in BARRIERS:
                break
            if open_tag in CLOSES.get(tag, ()):
                close(d)
                break
        if tag in BLOCKS:
            flush()
        over = elements[stack[-1]]
        name = tag + "".join("." + regex.sub(r"\d+", "#", c) for c in sorted(set(attrs.get("class", "").split())))
        name = name.replace("/", "|")
        away = over.away or is_away(tag, attrs, over.in_article)
        holder = len(elements) if tag in CONTAINERS else over.holder
        inner = over.in_article or tag in ("article", "main")
        elements.append(Element(tag, name, away, stack[-1], holder, step_hash(over.step, name), inner))
        if tag in BLOCKS:
            open_blocks.append(len(stack))
        stack.append(len(elements) - 1)
        open_tags[tag] += 1
        links += tag == "a"
    flush()
    return Page(elements, blocks)


def best_path(source: str | None) -> tuple[str | None, float]:
    """The generalised path of a page's best container and its score; None without text."""
    page = parse(source)
    best = page.best()
    return (None, 0.0) if best is None else (page.path(best[0]), best[1])


def main_text(source: str | None, path: str | None) -> str:
    """Text of the elements on ``path``, else of the page's own best container.

    The latter also if it encloses these elements and has at least twice their text.
    """
    page = parse(source)
    tops = [] if path is None else page.on_path(path)
    text = page.text(tops)
    best = page.best()
    if best is None or tops == [best[0]]:
        return text
    if not text or page.encloses(best[0], tops):
        own = page.text([best[0]])
        if len(own) >= 2 * len(text):
            return own
    return text


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path, votes): the path that most pages of a host voted for; ties go by score, then path."""

    def make():
        def work(batch: pa.RecordBatch):
            found = [best_path(h) for h in batch.column("html").to_pylist()]
            return {"host": batch.column("host"), "path": [p for p, _ in found], "score": [s for _, s in found]}

        return work

    votes = arrow_map(pages.filter(F.col("host") != ""), ["host", "html"], "host string, path string, score double", make)
    return (
        votes.filter(F.col("path").isNotNull())
        .groupBy("host", "path")
        .agg(F.count("*").alias("votes"), F.sum(F.floor("score").cast("long")).alias("score"))
        .groupBy("host")
        .agg(F.max_by(F.struct("path", "votes"), F.struct("votes", "score", "path")).alias("best"))
        .select("host", "best.path", "best.votes")
    )


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html, ...).

    Null or empty html, and html without any article text, gives an empty text. A page without host (null url, no
    ``://``) neither votes nor follows: its own best container counts. Repeated rows are extracted
    alike; null ids stay null; an empty table gives no rows; further columns are ignored.
    """
    source = pages.select("page_id", "url", F.col("html").cast("string").alias("html")).withColumn("host", url_host(F.col("url")))
    winners = stored(host_paths(source), "paths").select("host", "path")

    def make():
        def work(batch: pa.RecordBatch):
            texts = [main_text(h, p) for h, p in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist())]
            return {c: batch.column(c) for c in ("page_id", "url")} | {"text": texts}

        return work

    kind = dict(source.dtypes)["page_id"]
    placed = source.join(winners, "host", "left")
    out = arrow_map(placed, ["page_id", "url", "html", "path"], f"page_id {kind}, url string, text string", make)
    return out.withColumn("n_chars", F.length("text").cast("long"))
