"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased words and their first four and five bytes (so that unseen inflections of a stem still count),
hashed to 64 bits. The machine is w0 + sum w_i + sum_{i<j} <v_i, v_j> over the terms a text has: the second sum learns
pairs, such as an insult with a mention of a group, that additive weights miss.

Fitting takes a bounded, documented sample of labelled rows: at most ``Settings.per_class`` of each label, those of
least id hash. Term choice, vectors and the intercept (corrected for the sampling) come from these rows alone. What the
driver gets is bounded by these: a number for each term of a sampled text, so 12,000 texts of at most 4,096 terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import keep, small_batches
from .textops import ALNUM, U, Words, as_long, blocks, mix, raw


@dataclass(frozen=True)
class Settings:
    per_class: int = 6000
    terms: int = 4096
    least_docs: int = 5
    factors: int = 4
    steps: int = 150
    decay: float = 2e-4
    threshold: float = 0.3


def terms(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(doc, term hash) of every word and its prefixes."""
    parts = [w.hash] + [mix(w.span(w.start, np.minimum(w.end, w.start + k)) + U(k)) for k in (4, 5)] if len(w.start) else [w.hash]
    return np.tile(w.doc, len(parts)), np.concatenate(parts)


@dataclass
class Machine:
    vocabulary: np.ndarray  # sorted term hashes
    w0: float
    w: np.ndarray
    v: np.ndarray

    def features(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (doc, vocabulary index) pairs of a block, sorted."""
        n = len(self.vocabulary)
        doc, h = terms(w)
        if not n or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(self.vocabulary, h).clip(max=n - 1)
        hit = self.vocabulary[at] == h
        both = np.unique(doc[hit] * n + at[hit])
        return both // n, both % n

    def raw_score(self, row: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        y = self.w0 + np.bincount(row, self.w[term], n) if len(row) else np.full(n, self.w0)
        for f in range(self.v.shape[1] if len(row) else 0):
            x = self.v[term, f]
            y = y + 0.5 * (np.bincount(row, x, n) ** 2 - np.bincount(row, x * x, n))
        return y

    def score(self, column: pa.Array) -> np.ndarray:
        data, off = raw(column)
        out = [np.zeros(0)]
        for i, j in blocks(off):
            y = self.raw_score(*self.features(Words(data, off, i, j, ALNUM)), j - i)
            out.append(1 / (1 + np.exp(-np.clip(y, -30, 30))))
        return np.concatenate(out)


#: Terms of training rows that a step of the fit takes at once.
PART = 200_000


def fit_machine(vocabulary: np.ndarray, row: np.ndarray, term: np.ndarray, label: np.ndarray, s: Settings) -> Machine:
    """Logistic loss, full-batch Adam, squared penalty on weights and vectors. ``row`` is sorted; a step goes through the
    rows in parts of about ``PART`` terms, so that beside its input it holds little."""
    n, k = len(vocabulary), s.factors
    rng = np.random.default_rng(1)
    m = Machine(vocabulary, 0.0, np.zeros(n), rng.normal(0, 0.01, (n, k)))
    theta = np.concatenate(([0.0], m.w, m.v.ravel()))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    start = np.searchsorted(row, np.arange(len(label) + 1))
    docs = np.unique(np.concatenate(([0], np.searchsorted(start, np.arange(PART, len(row), PART)), [len(label)])))
    for step in range(1, s.steps + 1):
        m.w0, m.w, m.v = theta[0], theta[1 : n + 1], theta[n + 1 :].reshape(n, k)
        e, gw, gv = np.zeros(len(label)), np.zeros(n), np.zeros((n, k))
        for i, j in zip(docs[:-1], docs[1:], strict=True):
            r, t = row[start[i] : start[j]].astype(np.int64) - i, term[start[i] : start[j]].astype(np.int64)
            p = 1 / (1 + np.exp(-np.clip(m.raw_score(r, t, j - i), -30, 30)))
            e[i:j] = (p - label[i:j]) / max(1, len(label))
            er = e[i:j][r]
            gw += np.bincount(t, er, n)
            for f in range(k):
                x = m.v[t, f]
                gv[:, f] += np.bincount(t, er * (np.bincount(r, x, j - i)[r] - x), n)
        g = np.concatenate(([e.sum()], gw, gv.ravel()))
        g[1:] += s.decay * theta[1:]
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        theta = theta - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    m.w0, m.w, m.v = float(theta[0]), theta[1 : n + 1].copy(), theta[n + 1 :].reshape(n, k).copy()
    return m


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label that have a term, by task."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy()
        data, off = raw(batch.column("text"))
        for i, j in blocks(off, 1 << 20):
            doc, h = terms(Words(data, off, i, j, ALNUM))
            one = np.unique(mix(h + doc.astype(np.uint64) * U(0x9E3779B97F4A7C15)), return_index=True)[1]
            label = toxic[i:j][doc[one]]
            term, back = np.unique(h[one], return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(as_long(term)), pa.array(np.bincount(back, label, len(term)).astype(np.int64)), pa.array(np.bincount(back, 1 - label, len(term)).astype(np.int64))],
                ["term", "pos", "neg"],
            )


def _rows(m: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = raw(batch.column("text"))
            found: list[list[int]] = []
            for i, j in blocks(off):
                row, term = m.features(Words(data, off, i, j, ALNUM))
                cut = np.searchsorted(row, np.arange(j - i + 1))
                found += [term[a:b].tolist() for a, b in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], ["toxic", "terms"])

    return run


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), keep_row: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """Fit on the labelled rows for which ``keep_row`` holds. Null ids and labels teach nothing; of repeated ids the
    largest label counts. With no labelled row the machine has no terms and scores everything 0.5."""
    small_batches(docs.sparkSession)
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    if keep_row is not None:
        rows = rows.where(keep_row)
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    pick = lambda x: rows.where(F.col("toxic") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.per_class)
    chosen = F.broadcast(pick(0).union(pick(1)))  # at most twice ``per_class`` rows of two numbers
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sample = keep(base.join(chosen, "doc_id").select("toxic", "text"), "labelled")
    counted = sample.mapInArrow(_counts, "term long, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    used = {x: min(total.get(x, 0), s.per_class) for x in (0, 1)}
    p, q = F.col("pos") / max(1, used[1]), F.col("neg") / max(1, used[0])
    mean = (F.col("pos") + F.col("neg")) / max(1, used[0] + used[1])
    z = F.abs(p - q) / F.sqrt(mean * (1 - mean) + 1e-9)
    best = counted.where(F.col("pos") + F.col("neg") >= s.least_docs).orderBy(z.desc(), "term").limit(s.terms).select("term").collect()
    vocabulary = np.sort(np.array([r["term"] for r in best], np.int64).view(np.uint64))
    blank = Machine(vocabulary, 0.0, np.zeros(len(vocabulary)), np.zeros((len(vocabulary), s.factors)))
    got = sample.mapInArrow(_rows(blank), "toxic int, terms array<int>").toArrow()
    label = got.column("toxic").to_numpy().astype(float)
    lists = got.column("terms").combine_chunks() if len(label) else pa.array([], pa.list_(pa.int32()))
    row = np.repeat(np.arange(len(label), dtype=np.int32), np.asarray(lists.value_lengths(), np.int64) if len(label) else 0)
    term = np.asarray(lists.flatten(), np.int32) if len(label) else np.zeros(0, np.int32)
    m = fit_machine(vocabulary, row, term, label, s)
    if used[0] and used[1]:  # the labels' own odds instead of the sample's
        m.w0 += np.log(total[1] / used[1]) - np.log(total[0] / used[0])
    return m


def scored(docs: DataFrame, m: Machine, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """(doc_id, text, score) and the columns ``more`` for each row; null and empty texts score as texts without terms.

    Texts alone go to Python, in batches of bounded bytes, and numbers alone come back. Rows with equal or null ids are
    scored each for itself; an empty table gives no rows. Columns that are not named are ignored.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(m.score(text), pa.float64())

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)
    return base.withColumn("score", score("text"))
