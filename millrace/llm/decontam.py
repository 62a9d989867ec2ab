"""Benchmark decontamination: rare n-gram seeds and Smith-Waterman alignment.

Seeds are word pairs, adjacent or with one word between. Those of test items are counted over all documents; each item
keeps its rarest as seeds, so many that no alignment of the score asked for can do without one of them (see ``Seeds``):
the result is that of an alignment of every document with every item. Seeds join documents to items, seed places give
windows of the document that hold all such an alignment can reach, and a local alignment of words scores each window
against the item. Items are taken in blocks of bounded size, each block's seeds against all documents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches
from .textops import _MULT, ALNUM, Words, as_long, blocks, raw

MATCH, MISS, GAP = 2, -1, -1


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local alignment of two word sequences: its score, and its end in ``text``."""
    n = len(text)
    before, best, end = np.zeros(n + 1, np.int64), 0, 0
    ramp = np.arange(n + 1) * -GAP
    for w in item:
        row = np.zeros(n + 1, np.int64)
        np.maximum(before[:-1] + np.where(text == w, MATCH, MISS), before[1:] + GAP, out=row[1:])
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + ramp) - ramp  # gaps in the item
        if (top := int(row.max())) > best:
            best, end = top, int(row.argmax())
        before = row
    return best, end


def _pairs(h: np.ndarray, doc: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Words with the word ``step`` places on in the same text: their places, and hashes of the pairs."""
    at = np.flatnonzero(doc[: len(doc) - step] == doc[step:])
    return at, h[at] * _MULT[0] + h[at + step] * _MULT[1]


class Seeds:
    """Items' words and hashes of their word pairs; ``grams`` sorted, with the item and the place of the first word.

    A pair is a word with the next one or the next but one. In an alignment of score s, matches follow one another with
    at most one error between them (MATCH 2, MISS and GAP -1) at s / 2 - 1 places or more: m matches and e errors give
    s = 2 m - e, and at most e / 2 of the m - 1 steps between matches have two errors or more. Those steps are pairs of
    the item that stand in the document as pairs.
    """

    def __init__(self, items: list[tuple[int, str]], width: int, least: float):
        self.ids = [i for i, _ in items]
        self.width = width
        data, off = raw(pa.array([t or "" for _, t in items], pa.large_string()))
        w = Words(data, off, 0, len(items), ALNUM)
        first = np.concatenate(([0], np.cumsum(w.count)))
        self.words = [w.hash[first[k] : first[k + 1]] for k in range(len(items))]
        self.whole = defaultdict(list)
        for k, x in enumerate(self.words):
            if 0 < len(x) < width:
                self.whole[tuple(x.tolist())].append(k)
        #: Score that counts; pairs that an alignment of that score holds at least.
        self.score = np.ceil(MATCH * least * w.count - 1e-9).astype(np.int64)
        self.shared = (self.score + 1) // 2 - 1
        #: Words of a document that an alignment may skip.
        self.slack = np.maximum(MATCH * w.count - self.score, 0)
        long = w.count >= width
        self.steps = [1, 2] if not (long & (self.shared < 1)).any() else [0, 1, 2]
        found = []
        for step in self.steps:
            at, h = _pairs(w.hash, w.doc, step)
            own = w.doc[at]
            use = long[own] & ((self.shared[own] >= 1) == (step > 0))  # one word is all such an alignment needs to hold
            found.append((h[use], own[use], (at - first[own])[use]))
        h, own, place = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(h, kind="stable")
        self.grams, self.item, self.place = h[order], own[order], place[order]

    def rarest(self, frequency: dict[int, int]) -> None:
        """Keep the pairs of each item's rarest words: so many that those left out are fewer than an alignment holds."""
        n = np.array([frequency.get(int(g), 0) for g in as_long(self.grams)], np.int64)
        longest = max((len(x) for x in self.words), default=0) + 1
        start, own = np.unique(self.item * longest + self.place, return_inverse=True)
        total = np.bincount(own, weights=n, minlength=len(start))
        item = start // longest
        order = np.lexsort((start, total, item))
        size = np.bincount(item, minlength=len(self.ids))
        rank = np.empty(len(start), np.int64)
        rank[order] = np.arange(len(start)) - np.repeat(np.concatenate(([0], np.cumsum(size)[:-1])), size)
        good = (rank <= (size - np.maximum(self.shared, 1))[item])[own]
        self.grams, self.item, self.place = self.grams[good], self.item[good], self.place[good]


def _hits(seeds: Seeds, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word pairs of documents that are among the seeds' hashes: place of the first word, and index of the hash."""
    at, slots = [], []
    if len(seeds.distinct):
        for step in seeds.steps:
            place, h = _pairs(w.hash, w.doc, step)
            some = np.flatnonzero(seeds.table[(h >> seeds.shift).astype(np.int64)])
            h = h[some]
            slot = np.searchsorted(seeds.distinct, h).clip(max=len(seeds.distinct) - 1)
            hit = np.flatnonzero(seeds.distinct[slot] == h)
            at.append(place[some[hit]])
            slots.append(slot[hit])
    return (np.concatenate(at), np.concatenate(slots)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _prepare(seeds: Seeds) -> Seeds:
    seeds.distinct, seeds.lo = np.unique(seeds.grams, return_index=True)
    seeds.hi = np.append(seeds.lo[1:], len(seeds.grams))
    return seeds


def _table(seeds: Seeds) -> None:
    """Leading bits of the hashes, so that few words of documents are searched for."""
    bits = max(16, (16 * len(seeds.distinct)).bit_length())
    seeds.shift = np.uint64(64 - bits)
    seeds.table = np.zeros(1 << bits, bool)
    seeds.table[(seeds.distinct >> seeds.shift).astype(np.int64)] = True


def _frequency(seeds: Seeds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _table(seeds)
        n = np.zeros(len(seeds.distinct), np.int64)
        for batch in batches:
            data, off = raw(batch.column("text"))
            for i, j in blocks(off):
                w = Words(data, off, i, j, ALNUM)
                at, slot = _hits(seeds, w)
                n += np.bincount(np.unique(w.doc[at] * len(n) + slot) % max(len(n), 1), minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(as_long(seeds.distinct[some])), pa.array(n[some])], ["gram", "n"])

    return run


def _candidates(seeds: Seeds, w: Words, first: np.ndarray) -> dict[tuple[int, int], list[int]]:
    """Where the item would start in the document, by each seed, for each (document, item) that shares one."""
    near = {}
    for d in np.flatnonzero((w.count > 0) & (w.count < seeds.width)) if seeds.whole else ():
        for t in seeds.whole.get(tuple(w.hash[first[d] : first[d + 1]].tolist()), ()):
            near[int(d), t] = [0]
    at, slot = _hits(seeds, w)
    if not len(at):
        return near
    size = seeds.hi[slot] - seeds.lo[slot]
    k = np.repeat(seeds.lo[slot] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))
    at = np.repeat(at, size)
    doc, item = w.doc[at], seeds.item[k]
    start = at - first[doc] - seeds.place[k]
    order = np.lexsort((start, item, doc))
    doc, item, start = doc[order], item[order], start[order]
    cut = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(item, prepend=-1) != 0))
    for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(doc)], strict=True):
        near[int(doc[lo]), int(item[lo])] = start[lo:hi].tolist()
    return near


def _search(seeds: Seeds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _table(seeds)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            ids = batch.column("doc_id").to_pylist()
            data, off = raw(batch.column("text"))
            for i, j in blocks(off):
                w = Words(data, off, i, j, ALNUM)
                first = np.concatenate(([0], np.cumsum(w.count)))
                for (d, t), starts in _candidates(seeds, w, first).items():
                    item = seeds.words[t]
                    words = w.hash[first[d] : first[d + 1]]
                    needed, slack = int(seeds.score[t]), int(seeds.slack[t])
                    starts = sorted(set(starts))
                    best, window = (0, 0), [starts[0], starts[0]]
                    for s in [*starts[1:], None]:
                        if s is not None and s - window[1] <= slack:
                            window[1] = s
                            continue
                        x = max(0, window[0] - slack)
                        part = words[x : window[1] + len(item) + slack]
                        if MATCH * np.count_nonzero(np.isin(item, part)) >= needed:
                            score, end = align(item, part)
                            best = max(best, (score, -(x + end)))
                        window = [s, s]
                    if best[0] >= max(needed, 1):
                        for column, value in zip(out, (ids[i + d], seeds.ids[t], best[0] / (MATCH * len(item)), -best[1]), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.int64())],
                ["doc_id", "item_id", "score", "end_word"],
            )

    return run


#: Items whose seeds are sent to every task at once.
BLOCK = 10_000


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 3, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, end_word) for each document and test item that aligns with at least ``least`` of the
    item's best possible score; end_word is the document word after the aligned passage.

    Items without words, and null, empty or wordless texts, match nothing. Items shorter than ``width`` words are
    sought as documents that are that sequence as a whole. Rows with equal or null ids count each for itself; of
    equal items each is reported. Empty tables give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    rows = items.orderBy("item_id", "text").toLocalIterator()
    found, block = [], []

    def add(block: list[tuple[int, str]]) -> None:
        seeds = _prepare(Seeds(block, width, least))
        if not len(seeds.grams) and not seeds.whole:
            return
        counted = base.select("text").mapInArrow(_frequency(seeds), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
        seeds.rarest({r["gram"]: r["n"] for r in counted})
        found.append(base.mapInArrow(_search(_prepare(seeds)), "doc_id long, item_id long, score double, end_word long"))

    for r in rows:
        block.append((r["item_id"], r["text"]))
        if len(block) == BLOCK:
            add(block)
            block = []
    if block:
        add(block)
    out = spark.createDataFrame([], "doc_id long, item_id long, score double, end_word long") if not found else found[0]
    for x in found[1:]:
        out = out.union(x)
    return out
