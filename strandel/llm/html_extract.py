"""Main-text extraction by maximum-scoring subsequence over a page's words and tags.

A page becomes a row of words and tags. Words score positive by the element they stand in and tags
negative by their name, with weights counted on labelled pages: pages that mark their own content
(article or main) teach how often each kind of token lies inside it. One linear scan finds the
contiguous region of the highest score; its blocks are the text. Scripts, styles, comments, forms
and elements hidden or by tag no content are taken out beforehand. An element whose class, id or role
names it a menu, advert, notice or the like is scored by its own words, and is out at 0 or less; one
that holds a heading h1, the marked content or most words of the mark around it (of the page, where
none is marked) never is.

Defined results: a null or empty page, or one without words, gives the empty text; markup that
never closes is read as far as it goes; kinds of tokens that no labelled page holds weigh as in
DEFAULT; words of links then count only in a block with other words or in article or main; repeated
rows each get a row; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandel.llm.common import table
from strandel.llm.words import slices

#: Most labelled pages that the weights are counted on.
TRAIN_PAGES = 2_000
#: Most kinds of tokens that have a weight of their own, the most frequent ones.
MOST_KINDS = 20_000
_MARKED = r"(?i)<(article|main)[\s/>]"
#: The cost in words of a tag that is found outside the content on every labelled page; less in proportion.
OUTSIDE_COST = 4.0
#: That of a tag that only shapes a text, and of any tag inside an article or main.
TEXT_COST = 0.5
TAG_COST = 0.02
#: Tags that shape a text: inline ones, headings, lists, tables, quotes and formulas.
TEXT_TAGS = set(
    "p br hr h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption colgroup col thead tbody tfoot tr th td blockquote figure figcaption img picture pre a abbr b bdi bdo cite code data del dfn em i ins kbd "
    "mark q rp rt ruby s samp small span strong sub sup time tt u var wbr math semantics mi mn mo ms mtext mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover mtable mtr mtd mspace mpadded".split()
)
#: Weights of kinds that the labelled pages do not hold: text tags are free, their words count in full.
DEFAULT = {f"{kind}:{t}": x for t in sorted(TEXT_TAGS) for kind, x in (("tag", 0.0), ("word", 1.0)) if t != "a"} | {"tag:a": 0.0, "tag:article": 0.0, "tag:main": 0.0}
UNSEEN_WORD, UNSEEN_TAG = 0.6, 0.75

RAW = "script|style|noscript|template|svg|textarea|select|iframe|object"
DROPPED = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "head", "annotation", "annotation-xml"}
#: Names in class, id or role by which an element may say that it is not content.
HINTS = {
    "ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies",
    "disqus", "footer", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo",
    "promotion", "related", "replies", "respond", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: Of these, the ones that content bears as well.
SOFT = {"banner", "notice", "related", "social"}
#: Words before a hint that make it tell what else the element holds or lacks.
TELLS_OF = {"has", "have", "hide", "hides", "is", "no", "not", "show", "shows", "with", "without"}
#: Words beside a hint that leave it the element's own name (ad-slot, but not share-price).
SHAPES = {
    "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "content", "form", "group", "head", "header", "icons", "inner", "items", "left", "link", "links", "list",
    "main", "page", "panel", "popular", "posts", "right", "section", "signup", "site", "slot", "stories", "thread", "top", "unit", "wrap", "wrapper",
}
#: Words that an element outside marked content needs to outweigh a doubtful name.
HINT_COST = 10
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table",
    "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\shidden(?=[\s=/]|\Z)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


def _named(rest: str) -> int:
    """2 where class, id or role say that the element is not content, 1 where they may, else 0."""
    found = 0
    for m in _NAMES.finditer(rest):
        for name in next(x for x in m.groups() if x is not None).lower().split():
            parts = [w for w in re.split(r"[^a-z]+", name) if w]
            hits = [w for w in parts if w in HINTS]
            if not hits or TELLS_OF & set(parts[: parts.index(hits[0])]):
                continue
            own = parts[-1] in HINTS or all(w in HINTS or w in SHAPES for w in parts)
            found = max(found, 2 if own and not SOFT.issuperset(hits) else 1)
    return found


class _Held:
    """What lies between two places of a page's raw tokens, from running sums."""

    def __init__(self, raw: list[tuple[str, str, str]], ends: dict[int, int]):
        words, links, marks, h1 = [0], [0], [0], [0]
        gone = linked = -1
        for i, (kind, value, rest) in enumerate(raw):
            if kind == "tag" and value in DROPPED and value != "form":
                gone = max(gone, ends.get(i, -1))
            if kind == "tag" and value == "a":
                linked = max(linked, ends.get(i, -1))
            n = len(value.split()) if kind == "text" and i > gone else 0
            words.append(words[-1] + n)
            links.append(links[-1] + (n if i < linked else 0))
            marks.append(marks[-1] + (kind == "tag" and i > gone and value in ("article", "main") and _named(rest) < 2))
            h1.append(h1[-1] + (kind == "tag" and i > gone and value == "h1"))
        self.words, self.links, self.marks, self.h1 = words, links, marks, h1

    def content(self, a: int, b: int, mark: tuple[int, int] | None) -> bool:
        """Whether it holds the marked content, a heading h1, or most words of the mark it stands in (of the page, where none is marked)."""
        within = lambda x: x[b] - x[a]
        whole = self.words[mark[1]] - self.words[mark[0]] if mark else 0 if self.marks[-1] else self.words[-1]
        return bool(within(self.marks) or within(self.h1) or whole and 2 * within(self.words) > whole)

    def score(self, a: int, b: int, named: int, cost: int) -> int:
        words, links = self.words[b] - self.words[a], self.links[b] - self.links[a]
        return words - 2 * links - (2 * words if named == 2 else 0) - cost


def tokens(page: str) -> list[tuple[str, str]]:
    """("tag" | "/tag", name) and (element, text) of a page, without what is surely not content."""
    raw: list[tuple[str, str, str]] = []
    for m in _TOKEN.finditer(page):
        if m["text"] is not None:
            raw.append(("text", m["text"], ""))
        elif m["name"] is not None and m["raw"] is None:
            raw.append(("/tag" if m["close"] else "tag", m["name"].lower(), m["rest"]))
    ends: dict[int, int] = {}
    waiting: dict[str, list[int]] = {}
    for i, (kind, name, _) in enumerate(raw):
        if kind == "tag" and name not in VOID:
            waiting.setdefault(name, []).append(i)
        elif kind == "/tag" and waiting.get(name):
            ends[waiting[name].pop()] = i
    held: _Held | None = None

    def aside(i: int, name: str, rest: str) -> bool:
        nonlocal held
        if name in DROPPED - {"form"}:
            return True
        hidden = bool(rest) and bool(_HIDDEN.search(rest))
        named = _named(rest) if rest and name not in HEADINGS else 0
        tagged = name == "form" or name == "header" and not content
        if name in ("html", "body", "article", "main") or not (hidden or named or tagged):
            return False
        held = held or _Held(raw, ends)
        if hidden:
            return not held.marks[ends[i]] - held.marks[i] and (name in BLOCK or all(raw[k][:2] != ("tag", "math") for k in range(i, ends[i])))
        mark = next(((k, ends[k]) for k in reversed(marked) if ends.get(k, -1) > i), None)
        return not held.content(i, ends[i], mark) and (tagged or held.score(i, ends[i], named, 0 if content else HINT_COST) <= 0)

    out, inside, i, content, marked = [], ["html"], 0, 0, []
    while i < len(raw):
        kind, name, rest = raw[i]
        if kind == "text":
            out.append((inside[-1], name))
        elif kind == "tag":
            if i in ends and aside(i, name, rest):
                i = ends[i] + 1
                continue
            if name in ("article", "main"):
                content += 1
                marked.append(i)
            out.append((kind, name))
            if name not in VOID:
                if name in BLOCK and inside[-1] == "p":
                    inside.pop()
                inside.append(name)
        else:
            out.append((kind, name))
            if name in ("article", "main") and content:
                content -= 1
                marked.pop()
            if name in inside:
                while inside.pop() != name:
                    pass
                inside = inside or ["html"]
        i += 1
    return out


def _key(kind: str, value: str) -> str:
    return f"tag:{value}" if kind in ("tag", "/tag") else f"word:{kind}"


def count_labelled(page: str) -> Counter:
    """(kind of token, inside the marked content) counts of a page that marks its content, else none."""
    found, depth, seen = Counter(), 0, False
    for kind, value in tokens(page):
        mark = value in ("article", "main") and kind in ("tag", "/tag")
        depth += mark and kind == "tag"
        seen |= depth > 0
        found[_key(kind, value), depth > 0] += 1 if kind in ("tag", "/tag") else len(value.split())
        depth -= mark and kind == "/tag" and depth > 0
    return found if seen else Counter()


def learn(pages: DataFrame, most_pages: int = TRAIN_PAGES, html_col: str = "html") -> dict[str, float]:
    """Of each kind of word the share inside the content, of each tag the share outside it."""
    rows = pages.select(F.col(html_col).cast("string").alias("html")).filter(F.col("html").rlike(_MARKED))
    share = min(1.0, most_pages / max(1, rows.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for page in b.column(0).to_pylist():
                total.update(count_labelled(page))
        yield pa.record_batch([pa.array([k for k, _ in total]), pa.array([x for _, x in total]), pa.array(list(total.values()), pa.int64())], schema=kinds)

    kinds = pa.schema([("kind", pa.string()), ("inside", pa.bool_()), ("n", pa.int64())])
    drawn = rows.filter(F.pmod(F.xxhash64("html"), F.lit(1 << 20)) < share * (1 << 20))
    counts = drawn.mapInArrow(run, "kind string, inside boolean, n long").groupBy("kind").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inside"))
    found = {r["kind"]: (r["inside"], r["n"]) for r in counts.orderBy(F.desc("n"), "kind").limit(MOST_KINDS).collect() if r["n"]}
    return DEFAULT | {k: (a / n if k[:5] == "word:" else 1 - a / n) for k, (a, n) in found.items()}


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The text of the region of the highest score."""
    row = tokens(page or "")
    best, best_at, run, start, depth, block = 0.0, (0, 0), 0.0, 0, 0, 0
    prose, blocks_of = [False], []
    for kind, value in row:
        if kind in ("tag", "/tag"):
            if value in BLOCK or value == "br":
                block += 1
                prose.append(False)
        elif kind != "a" and not value.isspace():
            prose[block] = True
        blocks_of.append(block)
    for i, (kind, value) in enumerate(row):
        if kind in ("tag", "/tag"):
            score = -TAG_COST - (TEXT_COST if depth or value in TEXT_TAGS else OUTSIDE_COST) * weights.get(f"tag:{value}", UNSEEN_TAG)
            if value in ("article", "main"):
                depth = depth + 1 if kind == "tag" else max(0, depth - 1)
        else:
            unseen = UNSEEN_WORD if kind != "a" or depth or prose[blocks_of[i]] else -0.01
            score = (0.01 + weights.get(f"word:{kind}", unseen)) * len(value.split())
        if run <= 0:
            run, start = 0.0, i
        run += score
        if run > best:
            best, best_at = run, (start, i + 1)
    blocks, part = [], []
    for kind, value in row[best_at[0] : best_at[1]]:
        if kind not in ("tag", "/tag"):
            part.append(value)
        elif value in BLOCK:
            blocks.append("".join(part))
            part = []
        elif value == "br":
            part.append(" ")
    blocks.append("".join(part))
    clean = (" ".join(entities.unescape(b).split()) for b in blocks)
    return "\n\n".join(b for b in clean if b)


def main_text(pages: DataFrame, weights: dict[str, float], html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [extract(p, weights) for p in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col(html_col).cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return main_text(pages, learn(pages))
