"""Document fingerprints by consistent weighted sampling.

A document is its word shingles weighted by their counts. For each of ``SAMPLES`` draws every term has r and c from
Gamma(2, 1) and b from U(0, 1), taken by the term's hash from seeded tables; the term of least
ln c - r (t - b) - r with t = floor(ln w / r + b) is drawn, together with t. Two documents draw the same with
the probability of their generalised Jaccard similarity, so the share of equal samples estimates it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import small_batches
from .textops import NONSPACE, U, Words, blocks, mix, raw

#: The share of equal samples has a standard error of sqrt(s (1 - s) / SAMPLES) at similarity s: 0.035 at 0.8, 0.027 at 0.9.
SAMPLES = 128
WIDTH = 5
_BITS = 18


@lru_cache(1)
def _tables():
    rng = np.random.default_rng(77)
    r, c = rng.gamma(2, 1, 1 << _BITS), rng.gamma(2, 1, 1 << _BITS)
    b = rng.random(1 << _BITS)
    turn = rng.integers(1, 2**63, SAMPLES, dtype=np.uint64) * U(2) + U(1)
    return r, np.log(c), b, (np.log(c) + r * b - r).astype(np.float32), turn


def sample(terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """16-bit samples of one document, its distinct terms (sorted hashes) and their weights."""
    if not len(terms):
        return np.full(SAMPLES, 0xFFFF, np.uint16)
    r, ln_c, b, once, turn = _tables()
    least, term, tick = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.uint64), np.zeros(SAMPLES, np.int64)
    rows = np.arange(SAMPLES)
    for i in range(0, len(terms), 4096):
        part, w = terms[i : i + 4096], weights[i : i + 4096]
        slot = ((turn[:, None] * part[None, :]) >> U(64 - _BITS)).astype(np.int64)
        value = once.take(slot)
        t = None
        if (heavy := np.flatnonzero(w > 1)).size:
            at = slot[:, heavy]
            t = np.floor(np.log(w[heavy])[None, :] / r[at] + b[at])
            value[:, heavy] = ln_c[at] - r[at] * (t - b[at]) - r[at]
        best = value.argmin(1)
        better = value[rows, best] < least
        least = np.where(better, value[rows, best], least)
        term = np.where(better, part[best], term)
        now = np.zeros(SAMPLES, np.int64)
        if t is not None:
            place = np.searchsorted(heavy, best).clip(max=len(heavy) - 1)
            now = np.where(heavy[place] == best, t[rows, place], 0).astype(np.int64)
        tick = np.where(better, now, tick)
    return (mix(term + tick.view(np.uint64) * U(0x9E3779B97F4A7C15) + rows.astype(np.uint64)) & U(0xFFFF)).astype(np.uint16)


def fingerprints(column: pa.Array, width: int = WIDTH) -> np.ndarray:
    """A row of samples for each text. A null, empty or wordless text has the same fixed row."""
    data, off = raw(column)
    out = []
    for i, j in blocks(off):
        at, h = Words(data, off, i, j, NONSPACE).shingles(width)
        out += [sample(*np.unique(h[at[d] : at[d + 1]], return_counts=True)) for d in range(j - i)]
    return np.stack(out) if out else np.zeros((0, SAMPLES), np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(-1)


def _in_order(width: int):
    """Rows (doc_id, text, bucket, ghost) in order; a bucket's last row, the ghost, is the next bucket's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row: id, text, fingerprint
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                prints = fingerprints(part.column("text"), width)
                texts = part.column("text").to_pylist()
                done, edited = [], []
                for d, text, ghost, own in zip(part.column("doc_id").to_pylist(), texts, part.column("ghost").to_pylist(), prints, strict=True):
                    text = text or ""
                    if held is not None:
                        mine = held[1]
                        half = len(mine) // 2
                        edited.append(mine[: len(mine) - half] + text[:half])
                        done.append((held[0], len(mine), held[2], own))
                    held = None if ghost else (d, text, own)
                if not done:
                    continue
                new = fingerprints(pa.array(edited, pa.large_string()), width)
                old, after = np.stack([x[2] for x in done]), np.stack([x[3] for x in done])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x in done], pa.int64()),
                        pa.array([x[1] for x in done], pa.int64()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                        pa.array([x.tobytes().hex() for x in old]),
                        pa.array([x.tobytes().hex() for x in new]),
                        pa.array(likeness(old, new)),
                        pa.array(likeness(old, after)),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return run


def placed(spark: SparkSession, n: int) -> np.ndarray:
    """For each of ``n`` partitions a number that ``repartition(n, number)`` deals to it, so that each range has a
    partition of its own."""
    found: dict[int, int] = {}
    size = 16 * n
    while len(found) < n:
        rows = spark.range(size).select(F.col("id").cast("int").alias("x")).groupBy(F.pmod(F.hash("x"), F.lit(n)).alias("part")).agg(F.min("x").alias("x"))
        found, size = {r["part"]: r["x"] for r in rows.collect()}, 4 * size  # a row a partition
    return np.array([found[k] for k in range(n)], np.int32)


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_chain(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Each row of ``docs`` with its fingerprint, its edited text's, and its likeness to that and to the next row's.

    Rows are dealt by ranges of the id, in one shuffle of the texts; each range also gets the first row of the next.
    Order is by id, then text; a null id comes before all. The row after the last is the first; a single row is its
    own next. Null texts are empty; an empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = -(2**63)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(least))
    cuts = base.select(F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], 100 * n).alias("x")).first()["x"] or []
    bounds = np.array(sorted(set(cuts)), np.int64)
    own = placed(spark, n)

    @F.pandas_udf("int")
    def bucket(k: pd.Series) -> pd.Series:
        return pd.Series(own[np.searchsorted(bounds, k.to_numpy(), "right")])

    firsts = sorted((r["k"], r["b"]) for r in base.groupBy(bucket(key).alias("b")).agg(F.min(key).alias("k")).collect())  # a row a bucket
    if not firsts:
        return spark.createDataFrame([], OUT)
    before = {k: firsts[i - 1][1] for i, (k, _) in enumerate(firsts)}
    to = spark.createDataFrame(list(before.items()), "k long, bucket int")
    heads = base.where(key.isin(list(before))).groupBy("doc_id").agg(F.min("text").alias("text"))
    ghosts = heads.join(F.broadcast(to), key == F.col("k")).select("doc_id", "text", "bucket", F.lit(True).alias("ghost"))
    rows = base.select("doc_id", "text", bucket(key).alias("bucket"), F.lit(False).alias("ghost")).union(ghosts)
    rows = rows.repartition(n, "bucket").sortWithinPartitions("bucket", "ghost", "doc_id", "text")
    return rows.mapInArrow(_in_order(width), OUT)
