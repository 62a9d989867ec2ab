"""URL filters: rules, and gradient-boosted trees on lexical features where no rule fits.

Features of a URL: lengths, depth, digit ratios, entropies, parameter count, and the block rates of its host's suffixes
among the training URLs. Trees are grown on quantiles by the second-order gain of the logistic loss.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches

_LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path: the host after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; the path from there
    up to ``? #`` or the end. Both are empty without a url or ``://``."""
    rest = (url or "").partition("://")
    if not rest[1]:
        return "", ""
    cut = re.search(r"[/?#]", rest[2])
    host, tail = (rest[2][: cut.start()], rest[2][cut.start() :]) if cut else (rest[2], "")
    return host.translate(_LOWER), re.split(r"[?#]", tail, maxsplit=1)[0]


@dataclass(frozen=True)
class Rule:
    text: str  # host and path, as in "net/es/"
    verdict: str  # allow or block

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (
    Rule("com/", "allow"),
    Rule("example.com/en/", "block"),
    Rule("www.example.com/en/", "allow"),
    Rule("net/es/", "block"),
    Rule("net/fr/", "block"),
)


class RuleBook:
    """Rules by host; a URL is looked up by each suffix of its host, so cost does not grow with the rules."""

    def __init__(self, rules: Iterable[Rule]):
        self.by_host: dict[str, list[Rule]] = defaultdict(list)
        for r in rules:
            self.by_host[r.host].append(r)

    def find(self, host: str, path: str) -> Rule | None:
        """The longest rule whose host is the URL's or a domain above it and whose path begins the URL's."""
        fits, labels = [], host.split(".")
        for k in range(len(labels)):
            fits += [r for r in self.by_host.get(".".join(labels[k:]), ()) if path.startswith(r.path)]
        return max(fits, key=lambda r: (len(r.text), r.text), default=None)


def suffixes(host: str) -> list[str]:
    labels = host.split(".")
    return [".".join(labels[-k:]) for k in (1, 2, 3)]


#: Lexical features, in the order of ``lexical``; the last three are block rates of the host's last one, two and three labels.
FEATURES = ("length", "host length", "path length", "depth", "digit ratio", "host digit ratio", "host entropy", "path entropy", "parameters", "suffix 1", "suffix 2", "suffix 3")


def entropy(text: str) -> float:
    """Bits a character."""
    n = np.array(list(Counter(text).values()), float)
    return float(-(n / n.sum() * np.log2(n / n.sum())).sum()) if len(n) else 0.0


def lexical(urls: list[str | None], rates: dict[str, float], prior: float) -> np.ndarray:
    x = np.zeros((len(urls), len(FEATURES)))
    for row, url in zip(x, urls, strict=True):
        url = url or ""
        host, path = split_url(url)
        query = url.partition("#")[0].partition("?")[2]
        digits = lambda text: sum(c.isdigit() for c in text) / max(1, len(text))
        depth = sum(map(bool, path.split("/")))
        row[:] = (len(url), len(host), len(path), depth, digits(url), digits(host), entropy(host), entropy(path), sum(map(bool, query.split("&"))), *(rates.get(s, prior) for s in suffixes(host)))
    return x


@dataclass
class Boosted:
    """Trees as arrays: feature, threshold and the two children of each node, leaves with a value."""

    rates: dict[str, float] = field(default_factory=dict)
    prior: float = 0.5
    base: float = 0.0
    trees: list[list[tuple]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        y = np.full(len(x), self.base)
        for tree in self.trees:
            at = np.zeros(len(x), np.int64)
            feature, limit, left, right, value = (np.array(c) for c in zip(*tree, strict=True))
            while (inner := feature[at] >= 0).any():
                go = x[np.arange(len(x)), feature[at].clip(min=0)] <= limit[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            y += value[at]
        return y

    def score(self, urls: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(lexical(urls, self.rates, self.prior)))) if urls else np.zeros(0)


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float) -> list[tuple]:
    nodes: list[tuple] = []

    def node(rows: np.ndarray, level: int) -> int:
        k = len(nodes)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        nodes.append((-1, 0.0, 0, 0, -rate * total_g / (total_h + 1)))
        best = (1e-3, None)
        if level < depth and len(rows) >= 20:
            for f in range(x.shape[1]):
                v = x[rows, f]
                for t in np.unique(np.quantile(v, np.linspace(0.05, 0.95, 19))):
                    go = v <= t
                    if go.all() or not go.any():
                        continue
                    a, b = g[rows][go].sum(), h[rows][go].sum()
                    gain = a * a / (b + 1) + (total_g - a) ** 2 / (total_h - b + 1) - total_g**2 / (total_h + 1)
                    if gain > best[0]:
                        best = (gain, (f, float(t), go))
        if best[1]:
            f, t, go = best[1]
            left, right = node(rows[go], level + 1), node(rows[~go], level + 1)
            nodes[k] = (f, t, left, right, 0.0)
        return k

    node(np.arange(len(x)), 0)
    return nodes


def fit(urls: list[str], block: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.2) -> Boosted:
    """Train on labelled URLs. Every other one teaches the suffix rates (smoothed), the rest the trees, so that no label
    reaches the trees through its own suffix."""
    prior = float(np.mean(block)) if len(block) else 0.5
    total, bad = Counter(), Counter()
    for u, b in zip(urls[::2], block[::2], strict=True):
        for s in suffixes(split_url(u)[0]):
            total[s] += 1
            bad[s] += int(b)
    m = Boosted({s: (bad[s] + 4 * prior) / (n + 4) for s, n in total.items() if n >= 5}, prior)
    if not len(block) or prior in (0.0, 1.0):
        m.base = 4.0 if prior == 1 else -4.0
        return m
    x, label = lexical(urls[1::2], m.rates, prior), block[1::2]
    m.base = float(np.log(prior / (1 - prior)))
    y = np.full(len(x), m.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-y))
        tree = _grow(x, p - label, p * (1 - p), depth, rate)
        m.trees.append(tree)
        y = y + Boosted(trees=[tree]).raw(x)
    return m


#: Syllables of which the training URLs' names are made; no name tells the label.
_SYLLABLES = ("ba", "ce", "di", "fo", "gu", "ha", "ki", "lo", "mar", "nel", "or", "pin", "qua", "rest", "sol", "tan", "ul", "ver", "win", "yes", "zen")


def labelled_urls(n: int = 4000, seed: int = 5) -> tuple[list[str], np.ndarray]:
    """Labelled URLs made by rule. Every trait is found in both classes, and none decides: a URL's odds of being blocked
    add up digits and randomness in the host, digits in the path, parameters, depth, length and the site it is on, and
    parameters on a random host count extra. The label is drawn with these odds. Hyphens and words have no part in it."""
    rng = np.random.default_rng(seed)
    name = lambda k: "".join(rng.choice(_SYLLABLES, k))
    noise = lambda k: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), k))
    sites = [(f"{name(2)}.{top}", float(rng.normal(0, 1.2))) for top in ("com", "org", "net", "info") for _ in range(10)]
    tops = {"com": 0.0, "org": -0.6, "net": 0.2, "info": 0.9}
    urls, block = [], []
    for _ in range(n):
        odd, digits, depth, pars = rng.random() < 0.35, int(rng.poisson(0.7)), int(rng.integers(0, 7)), int(rng.poisson(0.9))
        own = noise(int(rng.integers(8, 20))) if odd else name(int(rng.integers(2, 5)))
        if rng.random() < 0.4:
            k = int(rng.integers(1, len(own)))
            own = f"{own[:k]}-{own[k:]}"
        own += "".join(rng.choice(list("0123456789"), digits))
        if rng.random() < 0.5:
            site, worth = sites[rng.integers(len(sites))]
        else:
            site = rng.choice(list(tops))
            worth = 0.0
        host = f"{rng.choice(['', 'www.', 'blog.', 'm.'])}{own}.{site}"
        parts = [str(rng.integers(1, 10**6)) if rng.random() < 0.3 else name(int(rng.integers(1, 4))) for _ in range(depth)]
        numbers = sum(p.isdigit() for p in parts)
        tail = "/" + "/".join(parts) + rng.choice(["", "/", ".html"]) if parts else rng.choice(["", "/"])
        query = "&".join(f"{name(1)}={noise(int(rng.integers(1, 12)))}" for _ in range(pars))
        urls.append(f"http{rng.choice(['', 's'])}://{host}{tail}{'?' + query if query else ''}{rng.choice(['', '', '#top'])}")
        odds = -4.4 + 1.6 * odd + 0.9 * digits + 0.9 * pars + 0.5 * numbers + 0.25 * depth + 1.2 * (odd and pars > 0) + worth + tops[site.rpartition(".")[2]]
        block.append(rng.random() < 1 / (1 + np.exp(-2 * odds)))
    return urls, np.array(block, float)


@lru_cache(1)
def made_by_rule() -> Boosted:
    return fit(*labelled_urls())


def judge(pages: DataFrame, rules: Iterable[Rule] = RULES, model: Boosted | None = None, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row: the longest fitting rule's verdict, else the trees'.

    ``threshold``: the least score that blocks.

    A null url, or one without ``://``, has empty host and path, fits no rule and is judged by the trees. Rows with
    equal or null ids are judged each for itself. Other columns are ignored.
    """
    book, model = RuleBook(rules), model or made_by_rule()
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column("url").to_pylist()
            split = [split_url(u) for u in urls]
            found = [book.find(h, p) for h, p in split]
            score = model.score(urls)
            verdict = [r.verdict if r else "block" if s >= threshold else "allow" for r, s in zip(found, score, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), pa.array([h for h, _ in split], pa.string()), pa.array([p for _, p in split], pa.string()), pa.array([r.text if r else None for r in found], pa.string()), pa.array(verdict, pa.string()), pa.array(score)],
                ["page_id", "host", "path", "rule", "verdict", "score"],
            )

    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return base.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")
