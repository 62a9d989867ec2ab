"""HTML extraction by maximum-scoring subsequence.

A page is a sequence of words and tags. Words score +1, and a little less than nothing within boilerplate elements;
tags score what labelled pages say of them: the more a tag (or its class, where it has one) stands outside main text,
the more it costs. One linear scan finds the contiguous region of highest score; boilerplate elements within it are
left out.

Labelled pages are those that mark their main text themselves (``article`` or ``main``); weights come from a bounded,
documented sample of them and apply to all pages, marked or not.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style)\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?][^>]*+>",
    re.S | re.I,
)
#: A tag with a quote that does not close.
BROKEN = re.compile(r"<()(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>", re.I)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
UNSHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that are never main text.
OUTSIDE = frozenset("head nav header footer aside form button select textarea noscript template iframe svg dialog menu object".split())
#: Parts of class, id and role that name boilerplate. Marked pages cannot teach these alone: an advert or a notice within
#: a main element is inside by its page's marks, and is to be left out all the same.
NAMES = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer form header menu nav navbar navigation newsletter "
    "notice notices popup promo promotion related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
MAIN = frozenset(("article", "main"))
#: Elements that hold the page or its main text: no class, id or role makes them boilerplate.
WHOLE = MAIN | {"html", "body"}
#: From such a word on, a class ("has-sidebar", "page-no-comments") says what an element goes with, not what it is.
ABOUT = frozenset("has have hide hides no non not show shows with without".split())
#: What a word or a tag within boilerplate costs: it keeps a region from growing over it without need.
FAINT = 0.02


def attributes(text: str) -> dict[str, str]:
    """Attributes by lower-cased name; the first of a name counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def names(given: dict[str, str]) -> set[str]:
    """Lower-cased parts of an element's class, id and role."""
    parts = set()
    for key in ("class", "id", "role"):
        for token in given.get(key, "").lower().split():
            some = [p for p in re.split(r"[^a-z0-9]+", token) if p]
            k = next((k for k, p in enumerate(some[:-1]) if p in ABOUT), len(some))
            parts.update(some[:k], ["-".join(some[k:])] if some[k:] else [])
    return parts


def hidden(given: dict[str, str]) -> bool:
    return "hidden" in given or given.get("aria-hidden", "").strip().lower() == "true" or bool(UNSHOWN.search(given.get("style", "")))


@dataclass
class Weights:
    """Costs of tags and classes, as log odds of standing outside main text (0 or more), and how much they count."""

    odds: dict[str, float] = field(default_factory=dict)
    scale: float = 0.15
    sure: float = 3.0  # log odds from which an element with such a class is boilerplate

    def cost(self, keys: list[str]) -> float:
        return self.scale * max((self.odds.get(k, 0.0) for k in keys), default=0.0) + 0.01

    def outside(self, tag: str, parts: set[str]) -> bool:
        if tag in WHOLE:
            return False
        return tag in OUTSIDE or bool(parts & NAMES) or any(self.odds.get(f"{tag}.{p}", 0.0) >= self.sure for p in parts)


def tokens(page: str) -> Iterator[re.Match]:
    """Comments, scripts, styles and tags in page order, in time that grows with the page alone: a "<" that begins none of
    them is text, one whose quotes do not close ends at the next ">", and behind the last ">" only a comment can begin."""
    last, at = page.rfind(">"), page.find("<")
    while at >= 0:
        m = TOKEN.match(page, at) if at < last or page.startswith("<!--", at) else None
        if not m and at < last and page[at + 1 : at + 2].strip("/").isalpha():
            m = BROKEN.match(page, at)
        if not m and at >= last:
            at = page.find("<!--", at + 1)
            continue
        if m:
            yield m
        at = page.find("<", m.end() if m else at + 1)


def walk(page: str, weights: Weights) -> Iterator[tuple[str, str, float, bool, bool]]:
    """(kind, text, score, outside, inside a marked main element) of each run of text and each tag, in page order."""
    stack: list[tuple[str, bool, bool]] = []
    opened: Counter[str] = Counter()
    firmly = softly = out = marked = at = base = 0  # base: elements open from here on count by their names
    for m in tokens(page):
        if m.start() > at and (text := page[at : m.start()]).strip():
            n = len(text.split())
            yield "text", text, -n * FAINT if out else n, out > 0, marked > 0
        elif m.start() > at:
            yield "text", page[at : m.start()], 0, out > 0, marked > 0
        at = m.end()
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            while opened[tag]:  # ends what is open within it too
                name, flag, firm = stack.pop()
                opened[name] -= 1
                firmly -= firm
                softly -= flag and not firm and len(stack) >= base
                base = min(base, len(stack))
                marked -= name in MAIN
                if name == tag:
                    break
            out = firmly + softly
            yield "/" + tag, "", -FAINT, out > 0, marked > 0
            continue
        given = attributes(m[4]) if m[4].strip() else {}
        parts = names(given)
        if tag == "main":  # what holds it is boilerplate by its element or as hidden only, not by its names
            softly, base = 0, len(stack)
            out = firmly
        firm = tag in OUTSIDE or hidden(given)
        flag = firm or weights.outside(tag, parts)
        cost = FAINT if out or flag else weights.cost([f"{tag}.{p}" for p in parts] or [tag])
        yield tag, " ".join(sorted(parts)), -cost, out > 0, marked > 0
        if tag not in VOID and not m[4].endswith("/"):
            stack.append((tag, flag, firm))
            opened[tag] += 1
            firmly += firm
            softly += flag and not firm
            out = firmly + softly
            marked += tag in MAIN
    if at < len(page):
        n = len(page[at:].split())
        yield "text", page[at:], -n * FAINT if out else n, out > 0, marked > 0


def best_region(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous part of highest sum; the longest of the first such. Empty where nothing is positive."""
    best, lo, hi, total, start = 0.0, 0, 0, 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, lo, hi = total, start, k + 1
    return lo, hi


def main_text(page: str | None, weights: Weights) -> str:
    parts = list(walk(page or "", weights))
    lo, hi = best_region([p[2] for p in parts])
    blocks, now = [], []
    for kind, text, _, out, _ in parts[lo:hi]:
        if kind == "text":
            if not out:
                now.append(text)
        elif kind.lstrip("/") not in INLINE:
            blocks.append("".join(now))
            now = []
    blocks.append("".join(now))
    return " ".join(b for b in (" ".join(entities.unescape(x).split()) for x in blocks) if b)


def holders(kinds: list[str]) -> set[int]:
    """Places of the tags whose elements hold a main element: these stand neither inside nor outside main text."""
    stack: list[int] = []
    found: set[int] = set()
    for k, kind in enumerate(kinds):
        if kind[0] == "/":
            if (depth := next((n for n in range(len(stack) - 1, -1, -1) if kinds[stack[n]] == kind[1:]), None)) is not None:
                del stack[depth:]
        elif kind in MAIN:
            found.update(stack)
            stack.append(k)
        elif kind != "text" and kind not in VOID:
            stack.append(k)
    return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tags and classes of marked pages, inside and outside their main elements."""
    blank = Weights()
    for batch in batches:
        inside, outside = Counter(), Counter()
        for page in batch.column("html").to_pylist():
            parts = list(walk(page or "", blank))
            if not any(p[4] for p in parts):
                continue
            around = holders([p[0] for p in parts])
            for k, (kind, text, _, _, marked) in enumerate(parts):
                if kind != "text" and kind[0] != "/" and kind not in MAIN and k not in around:
                    side = inside if marked else outside
                    side.update([f"{kind}.{p}" for p in text.split()] or [kind])
        keys = sorted(inside.keys() | outside.keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([inside[k] for k in keys], pa.int64()), pa.array([outside[k] for k in keys], pa.int64())], ["key", "inside", "outside"])


#: Start of a main element, and what ``TOKEN`` passes over as comment or script, for Spark's regular expressions.
OPENS = r"(?i)<(article|main)(?![a-z0-9:-])"
UNREAD = r"(?is)<!--.*?(-->|\z)|<(script|style)\b[^>]*+>.*?(</\2\s*+>|\z)"


def learn(pages: DataFrame, sample: int = 500, keys: int = 5000, id_col: str = "page_id", html_col: str = "html") -> Weights:
    """Weights from the ``sample`` pages with a main element of least id hash, of tags and classes seen there five times
    or more: of the ``keys`` of these that stand outside main elements most often (what is not among them costs nothing).
    Pages without an id or html teach nothing; without a marked page no tag has a weight."""
    small_batches(pages.sparkSession)
    some = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html")).where("page_id is not null and html is not null")
    some = some.where(F.col("html").rlike(OPENS) & F.regexp_replace("html", UNREAD, "").rlike(OPENS))
    ids = [r["page_id"] for r in some.select("page_id", F.xxhash64("page_id").alias("h")).orderBy("h", "page_id").limit(sample).collect()]
    counted = some.where(F.col("page_id").isin(ids)).select("html").mapInArrow(_count, "key string, inside long, outside long")
    counted = counted.groupBy("key").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).where("i + o >= 5").orderBy(F.desc("o"), "key").limit(keys)
    return Weights({r["key"]: max(0.0, math.log((r["o"] + 0.5) / (r["i"] + 0.5))) for r in counted.collect()})


def extract(pages: DataFrame, weights: Weights, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row: blocks in page order, joined by one space.

    A null or empty page, or one without words outside boilerplate, has an empty text. Unclosed tags, comments and
    scripts end with the page. Rows with equal or null ids are read each for itself. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, weights) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return base.mapInArrow(run, "page_id long, url string, text string, n_chars long")
