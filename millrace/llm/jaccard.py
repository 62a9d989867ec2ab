"""N-gram Jaccard join by a count-vector R-tree.

A document is the set of its distinct word shingles. Shingles are hashed into groups; the group counts are a point,
and the sum of coordinate minima of two points bounds the intersection from above, so that only pairs whose bound
reaches the threshold are verified on the sets themselves.

Two sets that reach the threshold differ in at most K(size) shingles. Routing uses this: at each size level the
hashes are dealt by their leading bits into blocks. Sets of up to about 200 shingles take more blocks than K, so that a
linked pair agrees on the whole of at least one that is not empty. Larger sets take half as many again as K and send a
fixed number of them (about 70), of which a linked pair agrees on none with a chance of at most 2 ** -64. A pair
therefore meets in a bucket of equal blocks. Sets that share a bucket often share many, so buckets of one hub (its least
member) are one group from there on: each set is in it once, however many of these buckets it is in. Within a group

1. every member is compared with the hub by their points, which are much smaller than texts, and verified on the sets
   where the bound suffices; links are contracted to components: first against the least hub of a member's groups, then
   against those of its hubs that are still in other components;
2. in groups of three or more that still hold several components, R-trees over the members' points (one for each
   ``MEMBERS`` of a group, in tasks of their own) find, for each member outside the largest component, the partners in other components whose bound suffices. They are verified
   best bound first, 1, then 16, then 256 ... a member, until it is connected or no partner is left. So no link
   between components is lost, and members of a large group of near copies are not paired with each other once they
   are connected.

Equal sets are one node from the start (a map-side pass emits each once a task). Nodes are 64-bit set hashes for
routing; texts are compared by their own shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import components, forget, keep, sized_broadcast, small_batches
from .textops import NONSPACE, U, Words, as_long, blocks, mix, raw


@dataclass(frozen=True)
class Rule:
    """Linked when ``den * intersection >= num * union``, over shingles of ``width`` lower-cased words."""

    width: int = 5
    num: int = 80
    den: int = 100

    def differ(self, total: int) -> int:
        """Most elements in which two linked sets of ``total`` elements together differ."""
        return total * (self.den - self.num) // (self.den + self.num)

    def needed(self, total):
        """Least intersection of two linked sets of ``total`` elements together."""
        return -(-self.num * total // (self.den + self.num))


#: A linked pair is missed by a level of more blocks than ``sent`` with a chance of at most ``2 ** -MISS``: no more than
#: two sets have of one 64-bit hash.
MISS = 64


@dataclass(frozen=True)
class Level:
    """Sets of ``low`` elements or more are dealt to ``blocks``. Of the first ``sent`` there is a signature each, and a
    linked pair agrees on one of them; it may leave out up to ``spare`` empty blocks."""

    low: int
    blocks: int
    sent: int
    spare: int


def _every(rule: Rule, low: int, high: int) -> Level:
    """More blocks than a linked pair differs in, all sent."""
    k = rule.differ(2 * high) + 1
    z = 0
    for _ in range(6):
        empty = (k + z) * np.exp(-(rule.num * low / rule.den) / (k + z))
        z = int(np.ceil(empty + 4 * np.sqrt(empty)))
    return Level(low, k + z, k + z, z)


def _some(rule: Rule, low: int, high: int) -> Level:
    """So many of the blocks that a linked pair agrees on one that is not empty, but for a chance of ``2 ** -MISS``.

    A block serves a pair when no element in which its sets differ falls into it, and some common one does. Elements fall
    into blocks independently, so that blocks which do not serve are negatively associated, and the chance that none of
    ``sent`` serves is at most the product of theirs. It is largest at the least or the greatest total size.
    """
    blocks = rule.differ(2 * high) * 3 // 2 + 1
    stays = 1 - 1 / blocks
    serves = min(stays ** rule.differ(total) * (1 - stays ** rule.needed(total)) for total in (low + rule.num * low // rule.den, 2 * high))
    return Level(low, blocks, int(np.ceil(-MISS * np.log(2) / np.log1p(-serves))), blocks)


@lru_cache(None)
def levels(rule: Rule) -> tuple[np.ndarray, list[Level]]:
    """Lower size of each level, and the levels: all blocks for small sets, some for large ones."""
    low = next(n for n in range(1, 10_000) if rule.differ(2 * n) >= 1)
    out = []
    while low < 1 << 40:
        high, wide = max(low, int(low * 1.25)), int(low * 1.5)
        every, some = _every(rule, low, high), _some(rule, low, wide)
        fewer = some.sent < min(every.sent, some.blocks)
        out.append(some if fewer else every)
        low = (wide if fewer else high) + 1
    return np.array([x.low for x in out]), out


def sets(column: pa.Array, rule: Rule) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, off = raw(column)
    for i, j in blocks(off):
        at, h = Words(data, off, i, j, NONSPACE).shingles(rule.width)
        for d in range(j - i):
            yield np.unique(h[at[d] : at[d + 1]])


def signatures(s: np.ndarray, rule: Rule) -> list[np.ndarray]:
    """A hash of each block of the set that is sent, at its own level and those a larger partner may have."""
    lows, every = levels(rule)
    n = len(s)
    first = max(0, int(np.searchsorted(lows, n, "right")) - 1)
    last = int(np.searchsorted(lows, n * rule.den // rule.num, "right")) - 1
    mixed = mix(s ^ U(0x5851F42D4C957F2D))
    out = []
    for k in range(first, last + 1):
        level = every[k]
        block = ((s >> U(32)) * U(level.blocks)) >> U(32)
        block = block[: np.searchsorted(block, U(level.sent))]
        start = np.flatnonzero(np.diff(block, prepend=U(level.sent)))
        full = block[start]
        if len(full):
            out.append(mix(np.add.reduceat(mixed[: len(block)], start) + mix(full + U(k << 40))))
        if level.blocks - len(full) > level.spare:
            out.append(mix(np.setdiff1d(np.arange(level.blocks, dtype=np.uint64), full) + U(k << 40) + U(1 << 60)))
    return out


#: Sets whose signatures a task has sent are remembered up to this number; beyond it some are only sent again.
SEEN = 500_000


#: What a row that stands for a document carries; rows that stand for a signature have none.
DOC = pa.struct([("doc_id", pa.int64()), ("code", pa.int64()), ("n", pa.int64())])
ROW = "sig long, k1 long, doc struct<doc_id: long, code: long, n: long>"

#: Signatures that a task gathers before it sends them.
SEND = 200_000


def _scan(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, dealt out by its place, and rows (sig, k1) of its set."""
        seen: set[int] = set()
        place = 0
        for batch in batches:
            n, k1 = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            sig, own, total = [], [], 0
            named = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            for d, s in enumerate(sets(batch.column("text"), rule)):
                n[d] = len(s)
                k1[d] = a = int(as_long(mix(s).sum(keepdims=True))[0]) if len(s) else 0
                if not len(s) or not named[d] or a in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(a)
                new = signatures(s, rule)
                sig += new
                total += sum(map(len, new))
                own.append((a, total))
                if total >= SEND:
                    yield _sent(sig, own)
                    sig, own, total = [], [], 0
            if sig:  # sets so small that only equal ones are linked have none
                yield _sent(sig, own)
            deal = as_long(mix(np.arange(place, place + len(n), dtype=np.uint64) ^ mix(k1.view(U))))
            place += len(n)
            doc = pa.StructArray.from_arrays([batch.column("doc_id"), batch.column("code"), pa.array(n)], fields=list(DOC))
            yield pa.RecordBatch.from_arrays([pa.array(deal), pa.array(k1), doc], ["sig", "k1", "doc"])

    return run


def _sent(sig: list[np.ndarray], own: list[tuple[int, int]]) -> pa.RecordBatch:
    k1, end = (np.array(c, np.int64) for c in zip(*own, strict=True))
    flat = as_long(np.concatenate(sig))
    return pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(k1, np.diff(end, prepend=0))), pa.nulls(len(flat), DOC)], ["sig", "k1", "doc"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by sig, k1: members of buckets with two sets or more, each with its bucket's hub; and the documents."""
    lone = np.zeros((2, 0), np.int64)  # the last row, if its bucket has no other so far
    opened = hub = last = None  # the last bucket, if its rows have been sent; its hub and last member
    for batch in batches:
        is_doc = batch.column("doc").is_valid()
        docs, batch = batch.filter(is_doc), batch.filter(pc.invert(is_doc))
        if docs.num_rows:
            yield docs.append_column("hub", pa.nulls(docs.num_rows, pa.int64()))
        rows = np.concatenate((lone, np.stack([batch.column("sig").to_numpy(), batch.column("k1").to_numpy()])), axis=1)
        if not rows.shape[1]:
            continue
        new = np.concatenate(([opened is None or (rows[0, 0], rows[1, 0]) != (opened, last)], (rows[:, 1:] != rows[:, :-1]).any(0)))
        sig, k = rows[:, new]
        if not len(sig):
            continue
        head = np.concatenate(([opened is None or sig[0] != opened], sig[1:] != sig[:-1]))
        hubs = k[head] if head[0] else np.concatenate(([hub], k[head]))
        group = np.cumsum(head) - int(head[0])
        size = np.bincount(group, minlength=len(hubs))
        if not head[0]:
            size[0] += 2
        many = size[group] > 1
        if size[-1] > 1:
            opened, hub, last, lone = sig[-1], hubs[-1], k[-1], np.zeros((2, 0), np.int64)
        else:
            opened, lone = None, np.array([[sig[-1]], [k[-1]]])
        yield pa.RecordBatch.from_arrays([pa.array(sig[many]), pa.array(k[many]), pa.nulls(int(many.sum()), DOC), pa.array(hubs[group][many])], ["sig", "k1", "doc", "hub"])


#: Coordinates of a point. The bound tells sets apart while they have few hashes a group.
GROUPS = 512


def point(s: np.ndarray) -> np.ndarray:
    """Counts of a set's hashes in ``GROUPS`` groups."""
    return np.bincount((s & U(GROUPS - 1)).astype(np.int64), minlength=GROUPS)


class CountTree:
    """Packed R-tree over count vectors: pages of members in order of size and leading coordinates, and above them
    each page's largest coordinates and its range of sizes. Queries go down in blocks, so that a page is compared with
    all queries that reach it at once."""

    def __init__(self, points: np.ndarray, page: int = 64):
        self.size = points.sum(1, dtype=np.int64)
        self.kind = np.uint16 if not len(points) or self.size.max() < 65_536 else np.int64
        self.order = np.lexsort((points[:, 1], points[:, 0], self.size))
        self.columns = np.ascontiguousarray(points[self.order].T.astype(self.kind))  # a row a coordinate
        self.cut = np.arange(0, len(points), page)
        self.top = np.maximum.reduceat(self.columns, self.cut, axis=1)
        small = self.size[self.order]
        self.low, self.high = np.minimum.reduceat(small, self.cut), np.maximum.reduceat(small, self.cut)
        self.page = page

    def _bound(self, queries: np.ndarray, others: np.ndarray, block: int = 128) -> np.ndarray:
        out = np.empty((queries.shape[1], others.shape[1]), np.int64)
        for i in range(0, others.shape[1], block):
            out[:, i : i + block] = np.minimum(queries[:, :, None], others[:, None, i : i + block]).sum(0, dtype=self.kind)
        return out

    def near(self, points: np.ndarray, rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, member, slack) of members whose summed coordinate minima with a query's point suffice for a link;
        slack: the sum above what is needed. ``points``: a row of counts a query, few at once."""
        n = points.sum(1, dtype=np.int64)
        if len(n) and n.max() >= 65_536 and self.kind is np.uint16:
            self.kind, self.columns, self.top = np.int64, self.columns.astype(np.int64), self.top.astype(np.int64)
        q = np.ascontiguousarray(points.T.astype(self.kind))
        fits = self._bound(q, self.top) >= rule.needed(n[:, None] + self.low)
        fits &= (self.high * rule.den >= rule.num * n[:, None]) & (n[:, None] * rule.den >= rule.num * self.low)
        for k in np.flatnonzero(fits.any(0)):
            some = np.flatnonzero(fits[:, k])
            members = self.order[self.cut[k] : self.cut[k] + self.page]
            slack = self._bound(q[:, some], self.columns[:, self.cut[k] : self.cut[k] + self.page]) - rule.needed(n[some, None] + self.size[members])
            x, y = np.nonzero(slack >= 0)
            yield some[x], members[y], slack[x, y]

    def search(self, ask: np.ndarray, rule: Rule, block: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same for members ``ask``, which are not paired with themselves."""
        place = np.empty(len(self.order), np.int64)
        place[self.order] = np.arange(len(self.order))
        for i in range(0, len(ask), block):
            rows = ask[i : i + block]
            for x, y, slack in self.near(self.columns[:, place[rows]].T, rule):
                own = rows[x] != y
                yield rows[x[own]], y[own], slack[own]


def _verify(rule: Rule):
    """Rows (hub, part, k1, text), each part's hub first: links (a, b) between a hub and its members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, at = None, None, None
        for batch in batches:
            a, b = [], []
            rows = zip(batch.column("hub").to_pylist(), batch.column("part").to_pylist(), batch.column("k1").to_pylist(), sets(batch.column("text"), rule), strict=True)
            for hub, part, k, s in rows:
                if (hub, part) != key:
                    key, own, at = (hub, part), None, None
                if k == hub:
                    own, at = s, point(s)
                    continue
                if own is None:
                    continue
                need = rule.needed(len(s) + len(own))
                if np.minimum(at, point(s)).sum() >= need and len(np.intersect1d(own, s, assume_unique=True)) >= need:
                    a.append(hub)
                    b.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _bounded(rule: Rule):
    """Rows (hub, part, k1, point), each part's hub first: pairs (hub, k1) whose bound suffices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            hub, part, k = (batch.column(c).to_numpy() for c in ("hub", "part", "k1"))
            points = _points_of(batch.column("point"))
            close = np.zeros(len(k), bool)
            cut = np.flatnonzero((hub[1:] != hub[:-1]) | (part[1:] != part[:-1])) + 1
            for i, j in zip([0, *cut], [*cut, len(k)], strict=True):
                if (hub[i], part[i]) != key:
                    key, own = (hub[i], part[i]), None
                if k[i] == hub[i]:
                    own, i = points[i].astype(np.int64), i + 1
                if own is not None:
                    some = points[i:j].astype(np.int64)
                    close[i:j] = np.minimum(some, own).sum(1) >= rule.needed(some.sum(1) + own.sum())
            yield pa.RecordBatch.from_arrays([pa.array(hub[close]), pa.array(k[close])], ["hub", "k1"])

    return run


#: Members that one task verifies against one hub.
PART = 128


def verified(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """Of distinct pairs (hub, k1), those linked, as (a, b)."""
    return _with_hubs(pairs, texts, "text", _verify(rule), "a long, b long", "links")


def near(pairs: DataFrame, points: DataFrame, rule: Rule) -> DataFrame:
    """Of distinct pairs (hub, k1), those whose bound suffices for a link."""
    return _with_hubs(pairs, points, "point", _bounded(rule), "hub long, k1 long", "near")


def _with_hubs(pairs: DataFrame, values: DataFrame, column: str, run, schema: str, name: str) -> DataFrame:
    """``run`` over rows (hub, part, k1, value) of distinct pairs (hub, k1), each part's hub first. Members of a frequent
    hub are dealt to several parts. Of ``values`` (k1, column) only those that the pairs name are sent."""
    spark = pairs.sparkSession
    if getattr(pairs, "kept_rows", None) == 0:
        out = spark.createDataFrame([], schema)
        out.kept_rows = 0
        return out
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    parts = keep(parts, "parts")
    members = pairs.join(sized_broadcast(parts), "hub").select("hub", F.pmod(F.hash("k1"), F.col("parts")).alias("part"), "k1")
    hubs = parts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("hub").alias("k1"))
    dealt = keep(members.union(hubs), "dealt")
    wanted = keep(dealt.select("k1").distinct(), "wanted")
    rows = dealt.join(values.join(sized_broadcast(wanted), "k1", "left_semi"), "k1").select("hub", "part", "k1", column, (F.col("k1") != F.col("hub")).alias("member"))
    rows = rows.repartition(n, "hub", "part").sortWithinPartitions("hub", "part", "member")
    out = keep(rows.select("hub", "part", "k1", column).mapInArrow(run, schema), name)
    forget(parts, dealt, wanted)
    return out


#: Partners of a member that are verified first.
FIRST = 1


#: Types of a point's counts; the smallest that holds them is sent, counts below 16 two a byte.
KINDS = np.dtype(np.uint8), np.dtype(np.uint16), np.dtype(np.uint32)


def _packed(counts: np.ndarray) -> bytes:
    """A point as bytes."""
    most = counts.max()
    if most < 16:
        return (counts[::2] | counts[1::2] << 4).astype(np.uint8).tobytes()
    return counts.astype(next(k for k in KINDS if most <= np.iinfo(k).max)).tobytes()


def _points_of(column: pa.Array) -> np.ndarray:
    """A row of counts for each value that ``_packed`` has made."""
    data, off = raw(column)
    size = np.diff(off)
    kinds = [None, *KINDS]
    width = [GROUPS // 2, *(GROUPS * k.itemsize for k in KINDS)]
    out = np.empty((len(size), GROUPS), next((k or KINDS[0] for k, w in zip(kinds, width, strict=True) if w == size.max(initial=0)), KINDS[0]))
    for kind, w in zip(kinds, width, strict=True):
        at = np.flatnonzero(size == w)
        some = data[off[at][:, None] + np.arange(w)] if len(at) else np.zeros((0, w), np.uint8)
        if kind is None:
            out[at, ::2], out[at, 1::2] = some & 15, some >> 4
        else:
            out[at] = some.view(kind)
    return out


#: Members of a bucket, about, that one task puts in a tree; larger buckets are dealt to several.
MEMBERS = 1024

#: Queries whose partners are ranked at once.
ASKED = 64


class _Part:
    """One part of a bucket: its members' tree, and the partners of those who ask."""

    def __init__(self, rule: Rule, most: int):
        self.rule, self.most = rule, most
        self.held: list[tuple[np.ndarray, ...]] = []  # (k1, comp, ask, point) of members
        self.tree: CountTree | None = None

    def plant(self) -> Iterator[np.ndarray]:
        """Once all members are there: their tree, and pairs of those among them who ask."""
        if self.tree is not None or not self.held:
            return
        k, comp, ask, points = map(np.concatenate, zip(*self.held, strict=True))
        self.k, one = np.unique(k, return_index=True)
        self.comp, ask, points = comp[one], ask[one], points[one]
        self.tree, self.held = CountTree(points), []
        if ask.any():
            yield from self.pairs(self.k[ask], self.comp[ask], points[ask])

    def pairs(self, k: np.ndarray, comp: np.ndarray, points: np.ndarray) -> Iterator[np.ndarray]:
        """(hub, k1, more): of each query the ``most`` best partners in other components whose bound suffices. more: 1 if
        the hub has further partners, 2 if k1 has."""
        for i in range(0, len(k) if self.tree is not None else 0, ASKED):
            rows = slice(i, i + ASKED)
            got = [(x[o], y[o], z[o]) for x, y, z in self.tree.near(points[rows], self.rule) if (o := comp[rows][x] != self.comp[y]).any()]
            if not got:
                continue
            x, y, slack = (np.concatenate(c) for c in zip(*got, strict=True))
            order = np.lexsort((self.k[y], -slack, x))
            x, y = x[order], y[order]
            rank = np.arange(len(x)) - np.searchsorted(x, x)
            more = (rank == 0) & np.isin(x, x[rank == self.most])
            kept = rank < self.most
            a, b, more = k[rows][x[kept]], self.k[y[kept]], more[kept]
            yield np.stack((np.minimum(a, b), np.maximum(a, b), np.where(more, np.where(a < b, 1, 2), 0)))


def _across(rule: Rule, most: int):
    """Rows (sig, part, k1, comp, ask, member, point), of each part of a bucket its members first."""

    def sent(found: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in np.unique(np.concatenate([np.zeros((3, 0), np.int64), *found], axis=1), axis=1)], ["hub", "k1", "more"])

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        key, now = None, _Part(rule, most)
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, part, k, comp = (batch.column(c).to_numpy() for c in ("sig", "part", "k1", "comp"))
            ask, member = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("ask", "member"))
            points = _points_of(batch.column("point"))
            cut = np.flatnonzero((sig[1:] != sig[:-1]) | (part[1:] != part[:-1])) + 1
            for i, j in zip([0, *cut], [*cut, len(sig)], strict=True):
                if (sig[i], part[i]) != key:
                    yield from now.plant()
                    key, now = (sig[i], part[i]), _Part(rule, most)
                m = i + int(member[i:j].sum())
                if i < m:
                    now.held.append((k[i:m], comp[i:m], ask[i:m], points[i:m]))
                if m < j:  # queries from other parts
                    yield from now.plant()
                    yield from now.pairs(k[m:j], comp[m:j], points[m:j])
        yield from now.plant()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = [], 0
        for pairs in every(batches):
            found.append(pairs)
            total += pairs.shape[1]
            if total >= SEND:
                yield sent(found)
                found, total = [], 0
        yield sent(found)

    return run


def _open(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs (hub, k1) whose ends are in different components."""
    hub, own = comp.toDF("hub", "x"), comp.toDF("k1", "y")
    both = pairs.join(sized_broadcast(hub, table=comp), "hub", "left").join(sized_broadcast(own, table=comp), "k1", "left")
    return both.where(F.coalesce("x", "hub") != F.coalesce("y", "k1")).select("hub", "k1")


def _apart(groups: DataFrame, comp: DataFrame) -> DataFrame:
    """Rows (sig, k1, comp, parts) of groups of three or more members in several components; of groups with the same
    members (by two 64-bit hashes of the set) one. parts: in how many the group is searched."""
    rows = groups.join(sized_broadcast(comp.withColumnRenamed("node", "k1"), table=comp), "k1", "left").select("sig", "k1", F.coalesce("comp", "k1").alias("comp"))
    whole = rows.groupBy("sig").agg(
        F.count("*").alias("size"),
        F.min("comp").alias("lo"),
        F.max("comp").alias("hi"),
        F.bit_xor(F.xxhash64("k1")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), "k1")).alias("y"),
    )
    apart = whole.where("size > 2 and lo != hi").groupBy("size", "x", "y").agg(F.min("sig").alias("sig"))
    apart = keep(apart.select("sig", F.ceil(F.col("size") / MEMBERS).cast("int").alias("parts")), "sigs")
    return keep(rows.join(sized_broadcast(apart), "sig"), "apart")


def _outside(rows: DataFrame) -> DataFrame:
    """``rows`` of ``_apart``, with ask: whether a member is outside its bucket's largest component."""
    largest = rows.groupBy("sig", "comp").agg(F.count("*").alias("n")).groupBy("sig").agg(F.max_by("comp", F.struct("n", "comp")).alias("largest"))
    return keep(rows.join(sized_broadcast(keep(largest, "largest")), "sig").select("sig", "k1", "comp", "parts", (F.col("comp") != F.col("largest")).alias("ask")), "asked")


def _dealt(rows: DataFrame) -> DataFrame:
    """Members in one part of their bucket each, those who ask in every part."""
    own = F.pmod(F.xxhash64("k1"), F.col("parts")).cast("int")
    part = F.explode(F.when(F.col("ask"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own)))
    return rows.select("sig", "k1", "comp", "ask", own.alias("own"), part.alias("part")).select("sig", "part", "k1", "comp", "ask", (F.col("part") == F.col("own")).alias("member"))


def _points(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [point(s) for s in sets(batch.column("text"), rule)]
            yield pa.RecordBatch.from_arrays([batch.column("k1"), pa.array([_packed(c) for c in counts], pa.binary())], ["k1", "point"])

    return run


def similarity_groups(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``.

    component_id is the smallest id reachable by links, itself included. Null, empty and wordless texts have no
    shingles and link with nothing. Rows of one id are taken one by one, each with its own set; a row without an id
    keeps its n_shingles, links nothing and has a null component_id. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = base.withColumn("code", F.xxhash64("text"))
    # One exchange takes signatures to their buckets and documents along, so signatures are not stored before it.
    rows = base.mapInArrow(_scan(rule), ROW).repartition(n, "sig").sortWithinPartitions("sig", "k1")
    both = keep(rows.mapInArrow(_buckets, ROW + ", hub long"), "buckets")
    scan, buckets = both.where("doc is not null").select("doc.*", "k1"), both.where("doc is null").select("sig", "k1", "hub")
    ids = scan.where("doc_id is not null and n > 0").groupBy("k1").agg(F.min(F.struct("doc_id", "code")).alias("one")).select("k1", "one.*")
    pairs = keep(buckets.where("k1 != hub").select("hub", "k1").distinct(), "pairs")
    nodes = keep(pairs.select("k1").union(pairs.select("hub")).distinct().join(ids, "k1"), "nodes")
    texts = keep(
        base.join(sized_broadcast(nodes), ["doc_id", "code"]).select("k1", "text"),
        "texts",
    )
    # Each set once a group, however many of the group's buckets it is in.
    groups = pairs.select(F.col("hub").alias("sig"), "k1").union(pairs.select("hub", "hub").distinct())
    points = keep(texts.mapInArrow(_points(rule), "k1 long, point binary"), "points")
    close = near(pairs, points, rule)
    first = keep(close.groupBy("k1").agg(F.min("hub").alias("hub")).select("hub", "k1"), "first")
    links = verified(first, texts, rule)
    comp, used = components(links), [pairs, nodes, texts, points, close, first, links]
    rest = keep(_open(close, comp).join(first, ["hub", "k1"], "left_anti"), "rest")
    others = verified(rest, texts, rule)
    used += [rest, others]
    if others.kept_rows:
        links = links.union(others)
        forget(comp)
        comp = components(links)

    apart = _apart(groups, comp)
    rows, most = _outside(apart), FIRST
    used += [apart, rows]
    while rows.kept_rows:
        left = keep(rows.select("k1").distinct(), "left")
        full = _dealt(rows).join(points.join(sized_broadcast(left), "k1", "left_semi"), "k1").repartition(n, "sig", "part").sortWithinPartitions("sig", "part", F.desc("member"))
        found = full.select("sig", "part", "k1", "comp", "ask", "member", "point").mapInArrow(_across(rule, most), "hub long, k1 long, more long").distinct()
        found = keep(found, "across")
        new = keep(found.select("hub", "k1").distinct().join(close, ["hub", "k1"], "left_anti"), "new")
        more = found.where("more = 1").select(F.col("hub").alias("k1")).union(found.where("more = 2").select("k1")).distinct()
        more = keep(more.withColumn("ask", F.lit(True)), "more")
        linked = verified(new, texts, rule)
        used += [left, found, new, more, linked]
        joined = linked.kept_rows
        if joined:
            links = links.union(linked)
            forget(comp)
            comp = components(links)
        if not more.kept_rows:
            break
        close = close.union(new)
        if joined:
            rows = _apart(rows.select("sig", "k1"), comp)
            used.append(rows)
        rows = rows.drop("ask")
        rows = keep(rows.join(sized_broadcast(more), "k1", "left").withColumn("ask", F.coalesce("ask", F.lit(False))), "asked")
        asked = keep(rows.where("ask").select("sig").distinct(), "sigs")
        used += [rows, asked]
        rows = keep(rows.join(sized_broadcast(asked), "sig", "left_semi"), "apart")
        used.append(rows)
        most *= 16
    forget(*used)

    # A document id stands for its sets, a component for the least id in it.
    class_id = scan.where("n > 0 and doc_id is not null").select("k1", "doc_id").join(comp.withColumnRenamed("node", "k1"), "k1", "left")
    least = class_id.groupBy(F.coalesce("comp", "k1").alias("comp")).agg(F.min("doc_id").alias("component_id"))
    named = comp.join(least, "comp").select(F.col("node").alias("k1"), "component_id")
    single = scan.where("n > 0 and doc_id is not null").groupBy("k1").agg(F.min("doc_id").alias("own"))
    names = single.join(named, "k1", "left").select("k1", F.coalesce("component_id", "own").alias("component_id"))
    out = scan.select("doc_id", F.col("n").alias("n_shingles"), "k1").join(names, "k1", "left")
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
