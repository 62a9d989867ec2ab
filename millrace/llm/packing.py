"""Best-fit packing with a swap-based local search.

Only lengths matter to packing, and there are at most ``size`` of them. So documents are tokenised in one pass, the
histogram of piece lengths (a table of at most ``size`` rows) comes to the driver, and bins are planned there as
patterns with multiplicities: best fit in decreasing order, then a local search between underfull patterns. The plan
goes back as ranges of ranks within each length, so the whole corpus is placed without moving its texts.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import keep, small_batches

SPECIAL = "<|endoftext|>"
#: White space that the second library's pattern would go back over place by place, until its stack ends.
LONG_SPACE = 50_000
_space = re.compile(r"\s{%d}" % LONG_SPACE)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(4)
def encoder(vocabulary: str, ranks: str):
    """Text to ids of the tokenizer file ``vocabulary``.

    ``ranks`` holds the same vocabulary for a second library that gives the same ids in a quarter of the time;
    a text that spells the special token, or holds ``LONG_SPACE`` places of white space in a row, goes to the tokenizer
    itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(vocabulary)
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(text: str) -> list[int]:
        if SPECIAL in text or len(text) >= LONG_SPACE and _space.search(text):
            return exact.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def cut(total: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of ``size`` but the first, which may be shorter."""
    first = (total - 1) % size + 1
    return [(0, first), *((s, size) for s in range(first, total, size))]


def _tokenise(vocabulary: str, ranks: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks)
        for batch in batches:
            doc, out = [], [[], [], [], []]
            for d, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids = np.array([*encode(text.as_py() or ""), 0], "<u4")
                for k, (start, length) in enumerate(cut(len(ids), size)):
                    doc.append(d.as_py())
                    for column, value in zip(out, (k, start, length, zlib.crc32(ids[start : start + length].tobytes())), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(out[0], pa.int32()), *(pa.array(x, pa.int64()) for x in out[1:])],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


Pattern = tuple[int, ...]  # lengths in a bin, in decreasing order


def best_fit(counts: dict[int, int], size: int) -> Counter[Pattern]:
    """Best fit decreasing over a histogram; equal bins are one pattern with a multiplicity."""
    free: dict[int, Counter[Pattern]] = defaultdict(Counter)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        room = sorted(f for f in free if f >= length and free[f])
        at = 0
        while left:
            if at < len(room):
                f = room[at]
                pattern, many = next(iter(free[f].items()))
            else:
                f, pattern, many = size, (), left
            each = f // length
            bins = min(many, left // each)
            took = each if bins else left
            bins = bins or 1
            if pattern:
                free[f][pattern] -= bins
                if not free[f][pattern]:
                    del free[f][pattern]
            free[f - took * length][pattern + (length,) * took] += bins
            left -= bins * took
            while at < len(room) and not free[room[at]]:
                at += 1
    out: Counter[Pattern] = Counter()
    for group in free.values():
        out.update(group)
    return out


class _Underfull:
    """Underfull patterns by each length they hold (0 for none), in order of their room."""

    def __init__(self, plan: Counter[Pattern], size: int):
        self.plan, self.size = plan, size
        self.holds: dict[int, list[tuple[int, Pattern]]] = defaultdict(list)
        self.fullest: list[tuple[int, Pattern]] = []
        for p in plan:
            self._enter(p)

    def _enter(self, p: Pattern) -> None:
        if (room := self.size - sum(p)) > 0:
            insort(self.fullest, (room, p))
            for y in {0, *p}:
                insort(self.holds[y], (room, p))

    def change(self, p: Pattern, by: int) -> None:
        new = p not in self.plan
        self.plan[p] += by
        if new:
            self._enter(p)
        elif not self.plan[p]:
            del self.plan[p]
            if (room := self.size - sum(p)) > 0:
                for x in (self.fullest, *(self.holds[y] for y in {0, *p})):
                    del x[bisect_left(x, (room, p))]

    def exchange(self, p: Pattern) -> tuple[Pattern, tuple[int, ...], int] | None:
        """The bin q, as full as ``p`` or fuller, what ``p`` gives it and what it takes for that (0: nothing) that fill
        q most: one document moved, or one or two swapped for one. That raises the sum of squared fills most."""
        most = self.size - sum(p)
        takes, rooms, bins = [], [], []
        for y, some in self.holds.items():
            k = bisect_right(some, most, key=lambda x: x[0]) - 1
            if k >= 0 and some[k][1] == p and self.plan[p] < 2:
                k -= 1
            if k >= 0:
                takes.append(y)
                rooms.append(some[k][0])
                bins.append(some[k][1])
        if not takes:
            return None
        twice = {x for x, n in Counter(p).items() if n > 1}
        own = sorted(set(p))
        gives = [(x,) for x in own] + [(a, b) for i, a in enumerate(own) for b in own[:i]] + [(x, x) for x in sorted(twice)]
        gain = np.array([sum(g) for g in gives])[:, None] - np.array(takes)[None, :]
        good = (gain > 0) & (gain <= np.array(rooms)[None, :])
        good[len(own) :] &= np.array(takes)[None, :] > 0
        gain[~good] = 0
        i, j = np.unravel_index(int(gain.argmax()), gain.shape)
        return (bins[j], gives[i], takes[j]) if gain[i, j] else None


def _swapped(p: Pattern, away: tuple[int, ...], into: tuple[int, ...]) -> Pattern:
    out = Counter(p)
    out.subtract(away)
    out.update(into)
    return tuple(sorted(out.elements(), reverse=True))


def improve(plan: Counter[Pattern], size: int) -> Counter[Pattern]:
    """Local search: the least filled bins give documents to fuller ones, as many equal bins at once as there are.

    Each exchange raises the sum of squared fills, so the search ends: when no exchange is left, or when the total length
    needs every bin that is left.
    """
    plan = Counter(plan)
    least = -(-sum(sum(p) * n for p, n in plan.items()) // size)
    under, bins, changed = _Underfull(plan, size), sum(plan.values()), True
    while changed and bins > least:
        changed, limit = False, (size, ())
        while bins > least and (at := bisect_left(under.fullest, limit)):
            room, p = under.fullest[at - 1]  # the least filled that this pass has not left behind
            if not (found := under.exchange(p)):
                limit = (room, p)
                continue
            q, give, take = found
            many = plan[p] // 2 if p == q else min(plan[p], plan[q])
            taken = (take,) if take else ()
            poorer, fuller = _swapped(p, give, taken), _swapped(q, taken, give)
            for x in (p, q):
                under.change(x, -many)
            under.change(fuller, many)
            if poorer:
                under.change(poorer, many)
                limit = max(limit, (size - sum(poorer) + 1, ()))
            else:
                bins -= many
            changed = True
    return plan


def _place(keys: np.ndarray, seq: np.ndarray, offset: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = (batch.column("length").to_numpy() << 44) + batch.column("rank").to_numpy()
            at = np.searchsorted(keys, key, "right") - 1
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(seq[at] + key - keys[at]), pa.array(offset[at])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row of ``docs``.

    A null or empty text is one piece, the closing id 0 alone. Rows with equal or null ids are packed like any
    other, each on its own. An empty table gives an empty result. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    vocabulary, ranks = vocabulary or tokenizer_path("byte_bpe_50k.json"), ranks or tokenizer_path("byte_bpe_50k.tiktoken")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = keep(base.mapInArrow(_tokenise(vocabulary, ranks, size), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``size`` rows
    plan = improve(best_fit(counts, size), size)

    # Ranges of ranks within a length, by slot of a pattern.
    used: Counter[int] = Counter()
    rows, sequence = [], 0
    for pattern, many in sorted(plan.items(), reverse=True):
        at = 0
        for length in pattern:
            rows.append(((length << 44) + used[length], sequence, at))
            used[length] += many
            at += length
        sequence += many
    assert used == Counter(counts), "the plan must place every piece once"
    rows.sort()
    keys, seq, offset = (np.array([r[i] for r in rows], np.int64) for i in range(3))

    # Ranks: lengths that many pieces have are dealt to parts, whose counts give each part's first rank.
    spark = docs.sparkSession
    parts = spark.createDataFrame([(k, min(4096, -(-n // 500))) for k, n in counts.items()], "length long, parts int")
    dealt = pieces.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.hash("doc_id", "piece", "ids_crc32"), F.col("parts"))).drop("parts")
    first = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    first = first.select("length", "part", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("first"))
    order = W.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(order) - 1).join(first, ["length", "part"])
    ranked = ranked.withColumn("rank", (F.col("rank") + F.col("first")).cast("long"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        _place(keys, seq, offset), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
