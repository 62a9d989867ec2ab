"""Language ID by interpolated Kneser-Ney character models.

One model a language, n-grams of up to ``ORDER`` characters within a word and its two bounds, in sorted hash arrays:
a row an n-gram, a column a language, for its discounted probability and for its weight as a context. A text goes to
the language of lowest cross-entropy per character. The entropy of training texts calibrates the rejection of texts
that fit no language, and the temperature of the reported confidence.

Fitting takes a bounded, documented sample: about ``per_language`` rows of each label, by id hash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import keep, small_batches
from .textops import ALPHA, U, Words, blocks, mix, raw

ORDER = 5
SPACE = ord(" ")
UNIT = 1 / 512  # of a character never seen
WORDS = 4096  # scored at once


def grams(code: np.ndarray, inside: np.ndarray) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each place, n from 1; inside: place within its word."""
    out = [mix(code.astype(np.uint64) + U(1))]
    for n in range(2, ORDER + 1):
        h = np.zeros(len(code), np.uint64)
        h[1:] = mix(out[-1][:-1] * U(0x9E3779B97F4A7C15) + out[0][1:] + U(n))
        out.append(h)
    return out


def spell(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of " word " for all words in a row, each one's place in its word, and its word."""
    text = "".join(f" {w} " for w in words)
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    size = np.array([len(w) + 2 for w in words], np.int64)
    first = np.cumsum(size) - size
    return code, np.arange(len(code)) - np.repeat(first, size), np.repeat(np.arange(len(words)), size)


def letters(code: np.ndarray) -> np.ndarray:
    one, back = np.unique(code, return_inverse=True)
    return np.array([chr(c).isalpha() for c in one.tolist()], bool)[back] if len(code) else np.zeros(0, bool)


@dataclass
class Model:
    languages: list[str]
    keys: list[np.ndarray]  # of each order, sorted
    prob: list[np.ndarray]  # (row, language); the last row is for n-grams never seen
    back: list[np.ndarray]
    start: np.ndarray  # weight of UNIT below the unigrams
    limit: np.ndarray  # entropy and its spread, by language
    spread: np.ndarray
    heat: float = 1.0
    words: np.ndarray | None = None  # hashes of training words, sorted, and their scores
    known: np.ndarray | None = None

    def word_scores(self, words: list[str]) -> np.ndarray:
        """(word, language): log probability of each word's characters and its end; the last column counts them."""
        n_lang = len(self.languages)
        out = np.zeros((len(words), n_lang + 1))
        if not words:
            return out
        code, inside, word = spell(words)
        g = grams(code, inside)
        slot = []
        for n in range(ORDER):
            k = self.keys[n]
            at = np.searchsorted(k, g[n]).clip(max=max(0, len(k) - 1))
            slot.append(np.where((k[at] == g[n]) & (inside >= n), at, len(k)) if len(k) else np.zeros(len(code), np.int64))
        p = self.prob[0][slot[0]] + self.start * UNIT
        for n in range(1, ORDER):
            here = np.flatnonzero(inside >= n)
            p[here] = self.prob[n][slot[n][here]] + self.back[n - 1][slot[n - 1][here - 1]] * p[here]
        lp = np.log(p)
        seen = inside > 0
        for c in range(n_lang):
            out[:, c] = np.bincount(word[seen], lp[seen, c], len(words))
        out[:, -1] = np.bincount(word[seen], minlength=len(words))
        out[np.bincount(word, letters(code), len(words)) == 0] = 0
        return out

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, language) cross-entropy per character, and the characters of each text (0 where it has no letter)."""
        off = raw(column)[1]
        n_lang, total = len(self.languages), []
        for i, j in blocks(off):
            w = Words(*raw(pc.utf8_lower(column.slice(i, j - i))), 0, j - i, ALPHA, lower=False)
            rows = np.zeros((j - i, n_lang + 1))
            if len(w.hash):
                at = np.searchsorted(self.words, w.hash).clip(max=max(0, len(self.words) - 1)) if len(self.words) else np.zeros(len(w.hash), np.int64)
                old = self.words[at] == w.hash if len(self.words) else np.zeros(len(w.hash), bool)
                new = np.flatnonzero(~old)
                _, one, back = np.unique(w.hash[new], return_index=True, return_inverse=True)
                b = w.data.tobytes()
                fresh = self.word_scores([b[w.start[k] : w.end[k]].decode() for k in new[one]])
                for c in range(n_lang + 1):
                    rows[:, c] += np.bincount(w.doc[old], self.known[at[old], c], j - i) + np.bincount(w.doc[new], fresh[back, c], j - i)
            total.append(rows)
        t = np.concatenate(total) if total else np.zeros((0, n_lang + 1))
        return -t[:, :-1] / np.maximum(t[:, -1:], 1), t[:, -1]

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language (und without letters or without a learned language), confidence, and whether it is rejected."""
        n_texts = len(column)
        if not self.languages:
            return ["und"] * n_texts, np.zeros(n_texts), np.ones(n_texts, bool)
        h, n = self.entropies(column)
        best = h.argmin(1) if len(h) else np.zeros(0, np.int64)
        least = h[np.arange(len(h)), best]
        share = np.exp(-(h - least[:, None]) * n[:, None] * self.heat)
        sure = np.where(n > 0, 1 / np.maximum(share.sum(1), 1e-300), 0.0)
        odd = least > self.limit[best] + self.spread[best] * np.sqrt(1 + 400 / np.maximum(n, 1))
        return [self.languages[b] if k else "und" for b, k in zip(best.tolist(), n.tolist(), strict=True)], sure, odd | (n == 0)


def estimate(counts: dict[str, Counter]) -> Model:
    """Models from the word counts of each language."""
    languages = sorted(counts)
    parts: list[list[tuple]] = []
    start = np.zeros(len(languages))
    for lang in languages:
        words = sorted(counts[lang])
        code, inside, word = spell(words)
        weight = np.array([counts[lang][w] for w in words], float)[word] if words else np.zeros(0)
        g = grams(code, inside)
        orders = []
        for n in range(1, ORDER + 1):
            here = np.flatnonzero(inside >= max(n - 1, 1))
            key, first, back = np.unique(g[n - 1][here], return_index=True, return_inverse=True)
            c = np.bincount(back, weight[here], len(key))
            place = here[first]
            orders.append([key, c, g[n - 2][place - 1] if n > 1 else np.zeros(len(key), np.uint64), place])
        for n in range(1, ORDER):  # continuation counts, but for n-grams at a word's start, which nothing precedes
            longer = orders[n]
            suffix = g[n - 1][longer[3]]
            at = np.searchsorted(orders[n - 1][0], suffix)
            cont = np.bincount(at, minlength=len(orders[n - 1][0])).astype(float)
            begins = inside[orders[n - 1][3]] == n - 1
            orders[n - 1][1] = np.where((cont > 0) & ~begins, cont, orders[n - 1][1])
        made = []
        for n, (key, c, context, _) in enumerate(orders, 1):
            once, twice = (c == 1).sum(), (c == 2).sum()
            d = once / (once + 2 * twice) if once and twice else 0.5
            d = min(max(d, 0.1), 0.95)
            ctx, back = np.unique(context, return_inverse=True)
            total = np.bincount(back, c, len(ctx))
            weight_of = d * np.bincount(back, minlength=len(ctx)) / np.maximum(total, 1e-9)
            made.append((key, np.maximum(c - d, 0) / total[back] if len(key) else c, ctx, weight_of))
        start[languages.index(lang)] = made[0][3][0] if len(made[0][3]) else 1.0
        parts.append(made)
    keys, prob, back = [], [], []
    for n in range(ORDER):
        k = np.unique(np.concatenate([np.zeros(0, np.uint64), *(p[n][0] for p in parts), *(p[n + 1][2] for p in parts if n + 1 < ORDER)]))
        a, b = np.zeros((len(k) + 1, len(languages))), np.ones((len(k) + 1, len(languages)))
        for c, p in enumerate(parts):
            a[np.searchsorted(k, p[n][0]), c] = p[n][1]
            if n + 1 < ORDER:
                b[np.searchsorted(k, p[n + 1][2]), c] = p[n + 1][3]
        keys.append(k)
        prob.append(a)
        back.append(b)
    m = Model(languages, keys, prob, back, start, np.zeros(len(languages)), np.ones(len(languages)))
    every = sorted({w for c in counts.values() for w in c})
    h = Words(*raw(pa.array(every, pa.large_string())), 0, len(every), ALPHA, lower=False) if every else None
    if h is not None and len(h.hash) == len(every):
        order = np.argsort(h.hash)
        scores = np.concatenate([m.word_scores(every[i : i + WORDS]) for i in range(0, len(every), WORDS)])  # few at once, for the driver's memory
        m.words, m.known = h.hash[order], scores[order]
    else:
        m.words, m.known = np.zeros(0, np.uint64), np.zeros((0, len(languages) + 1))
    return m


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got: dict[str, Counter] = {}
        column = batch.column("text")
        langs = batch.column("lang").to_pylist()
        for i, j in blocks(raw(column)[1]):
            w = Words(*raw(pc.utf8_lower(column.slice(i, j - i))), 0, j - i, ALPHA, lower=False)
            b = w.data.tobytes()
            for d, s, e in zip(w.doc.tolist(), w.start.tolist(), w.end.tolist(), strict=True):
                got.setdefault(langs[i + d], Counter())[b[s:e]] += 1
        rows = [(lang, w.decode(), n) for lang, c in got.items() for w, n in c.items()]
        rows = [r for r in rows if any(ch.isalpha() for ch in r[1])]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])


def train(docs: DataFrame, keep_row: Column | None = None, per_language: int = 500, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on about ``per_language`` rows of each language for which ``keep_row`` holds. Rows without id, text or
    language teach nothing; without any the model knows no language and calls everything und."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    base = base.where("doc_id is not null and text is not null and lang is not null")
    if keep_row is not None:
        base = base.where(keep_row)
    total = {r["lang"]: r["count"] for r in base.groupBy("lang").count().collect()}  # a row a language
    if not total:
        return estimate({})
    share = F.create_map(*(x for lang, n in total.items() for x in (F.lit(lang), F.lit(min(1.0, per_language / n)))))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 53)) / float(1 << 53)  # so fine that the sample's size holds for any number of rows
    sample = keep(base.where(draw < share[F.col("lang")]).select("lang", "text"), "labelled")
    counts: dict[str, Counter] = {lang: Counter() for lang in total}
    for r in sample.mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["lang"]][r["word"]] = r["n"]
    m = estimate({lang: c for lang, c in counts.items() if c})

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = m.entropies(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(list(h), pa.list_(pa.float64())), pa.array(n)], ["lang", "h", "n"])

    got = sample.mapInArrow(own, "lang string, h array<double>, n double").where("n > 0").collect()  # numbers of the sample
    at = {lang: c for c, lang in enumerate(m.languages)}
    got = [r for r in got if r["lang"] in at]
    for lang, c in at.items():
        h = np.array([r["h"][c] for r in got if r["lang"] == lang])
        if len(h):
            m.limit[c] = np.quantile(h, 0.5)
            m.spread[c] = max(1.0, 3 * (np.quantile(h, 0.995) - m.limit[c]))
    losses = {}
    for heat in (1.0, 0.3, 0.1, 0.03, 0.01):
        x = [-(np.array(r["h"]) - r["h"][at[r["lang"]]]) * r["n"] * heat for r in got]
        losses[heat] = sum(np.log(np.exp(np.clip(v, -700, 300)).sum()) for v in x)
    m.heat = min(losses, key=losses.get)
    return m


def identified(docs: DataFrame, m: Model, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """(doc_id, text, lang_pred, score, rejected) and the columns ``more`` for each row.

    A null text or one without a letter is und with score 0, and rejected. Texts alone go to Python, in batches of
    bounded bytes. Rows with equal or null ids are taken each for itself; an empty table gives no rows. Columns that are
    not named are ignored.
    """
    small_batches(docs.sparkSession)
    kinds = [pa.field("lang_pred", pa.string()), pa.field("score", pa.float64()), pa.field("rejected", pa.bool_())]

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def found(text: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(m.predict(text), kinds, strict=True)], fields=kinds)

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)
    return base.withColumn("_found", found("text")).select("*", "_found.*").drop("_found")
