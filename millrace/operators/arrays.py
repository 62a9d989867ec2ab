"""Arrow columns as arrays of numbers, and aggregates of many slices of them at once.

A slice is a window's rows: ``lo`` and ``hi`` are arrays of places, ``lo[i]:hi[i]`` the i-th window. Counts and sums of
whole or decimal numbers are differences of running totals, which are exact. Whatever can't be taken away again is merged
from pieces of 1, 2, 4, ... rows, so a window costs the logarithm of its length.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WORD = (1 << 64) - 1


def unscaled(x: pa.Array) -> np.ndarray:
    """Decimals as whole numbers of their last place, 0 for nulls: 64 bits where all fit, else Python's numbers."""
    if not len(x):
        return np.zeros(0, np.int64)
    y = x.cast(pa.decimal128(38, x.type.scale))
    words = np.frombuffer(y.buffers()[1], np.int64, count=2 * (y.offset + len(y))).reshape(-1, 2)[y.offset :]
    words = np.where(valid(x)[:, None], words, 0)
    low, high = words[:, 0], words[:, 1]
    if (high == low >> 63).all():
        return low
    out = np.empty(len(x), object)
    out[:] = [(int(h) << 64) | (int(v) & _WORD) for h, v in zip(high, low, strict=True)]
    return out


def from_unscaled(v: np.ndarray, ok: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The decimals of whole numbers, null where not ``ok``."""
    if v.dtype == object:
        words = b"".join((int(x) if k else 0).to_bytes(16, "little", signed=True) for x, k in zip(v, ok, strict=True))
    else:
        words = np.stack([v, v >> 63], 1).astype(np.int64).tobytes()
    mask = None if ok.all() else pa.py_buffer(np.packbits(ok, bitorder="little").tobytes())
    return pa.Array.from_buffers(kind, len(v), [mask, pa.py_buffer(words)])


def valid(x: pa.Array) -> np.ndarray:
    return x.is_valid().to_numpy(zero_copy_only=False)


def column(t: pa.Table, name: str) -> pa.Array:
    x = t[name].combine_chunks()
    return x if isinstance(x, pa.Array) else pa.concat_arrays(x.chunks)


def numbers(x: pa.Array) -> tuple[np.ndarray, int | None]:
    """(values, places after the point): whole numbers for those and for decimals, else doubles and None; 0 for nulls."""
    if pa.types.is_decimal(x.type):
        return unscaled(x), x.type.scale
    whole = pa.types.is_integer(x.type) or pa.types.is_boolean(x.type)
    return pc.fill_null(x.cast(pa.int64() if whole else pa.float64()), 0).to_numpy(zero_copy_only=False), 0 if whole else None


def doubles(v: np.ndarray, places: int | None) -> np.ndarray:
    if places is None:
        return v
    return np.array([int(x) / 10**places for x in v], float) if v.dtype == object else v / 10.0**places


def roomy(v: np.ndarray, carried: int = 0) -> np.ndarray:
    """Whole numbers of which no sum (with what is carried) leaves 64 bits, by becoming Python's where one could."""
    return v if v.dtype == object or np.abs(v.astype(float)).sum() + abs(carried) < 2.0**62 and abs(carried) < 2**62 else v.astype(object)


def coded(x: pa.Array) -> tuple[np.ndarray, Callable[[np.ndarray, np.ndarray], pa.Array]]:
    """Whole numbers in the order of the values, and the way back: (numbers, which are there) -> values."""
    ok = valid(x)
    if pa.types.is_decimal(x.type) and (v := unscaled(x)).dtype != object:
        return v, lambda c, there: from_unscaled(np.where(there, c, 0), there, x.type)
    if pa.types.is_integer(x.type):
        return numbers(x)[0], lambda c, there: pa.array(np.where(there, c, 0), mask=~there).cast(x.type)
    if pa.types.is_floating(x.type):  # not a number is above all numbers
        known, codes = np.unique(x.drop_null().to_numpy(zero_copy_only=False), return_inverse=True)
        known = pa.array(known, x.type)
    else:
        known = pc.unique(x.drop_null())
        known = known.take(pc.sort_indices(known))
        codes = pc.index_in(x.drop_null(), known).to_numpy(zero_copy_only=False)
    out = np.zeros(len(x), np.int64)
    out[ok] = codes
    return out, lambda c, there: known.take(pa.array(np.where(there, c, 0), pa.int64(), mask=~there))


def sums(v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sums of slices of whole numbers."""
    v = roomy(v)
    total = np.zeros(len(v) + 1, v.dtype)
    total[1:] = np.cumsum(v)
    return total[hi] - total[lo]


def merged(parts: tuple[np.ndarray, ...], empty: tuple, lo: np.ndarray, hi: np.ndarray, op: Callable) -> tuple[np.ndarray, ...]:
    """Slices merged by ``op`` on tuples of arrays, which is associative and commutative; ``empty`` for slices of no rows."""
    out = tuple(np.full(len(lo), e, p.dtype) for p, e in zip(parts, empty, strict=True))
    at, left, size = lo.astype(np.int64), (hi - lo).astype(np.int64), 1
    while (left > 0).any():
        some = np.flatnonzero(left & size)
        if len(some):
            got = op(tuple(o[some] for o in out), tuple(p[at[some]] for p in parts))
            for o, g in zip(out, got, strict=True):
                o[some] = g
            at[some] += size
            left[some] -= size
        parts = op(tuple(p[:-size] for p in parts), tuple(p[size:] for p in parts)) if (left > 0).any() else parts
        size *= 2
    return out


def _add(a, b):
    return (a[0] + b[0],)


def _spread(a, b):
    """Number, mean and sum of squared distances from it, of both."""
    (n, m, q), (k, l, r) = a, b
    both = np.maximum(n + k, 1)
    d = l - m
    return n + k, np.where(n > 0, m + d * k / both, l), q + r + d * d * n * k / both


def _nothing(x: pa.Array) -> pa.Array:
    """Not a number as null."""
    return pc.if_else(pc.fill_null(pc.is_nan(x), False), pa.scalar(None, x.type), x) if pa.types.is_floating(x.type) else x


def rows_of(kind: str, x: pa.Array) -> dict:
    """A column as what ``aggregate`` takes: every row on its own. Not a number counts as null."""
    x = _nothing(x)
    ok = valid(x)
    got = {"n": ok.astype(np.int64), "rows": np.ones(len(x), np.int64)}
    if kind in ("sum", "mean"):
        got["s"] = numbers(x)
    elif kind in ("min", "max"):
        got["e"] = x
    elif kind in ("var", "std"):
        got |= {"m": doubles(*numbers(x)), "q": np.zeros(len(x))}
    elif kind != "count":
        got["v"] = doubles(*numbers(x))
    return got


def parts_of(t: pa.Table, k: int) -> dict:
    """As ``rows_of``, of a table whose rows stand for many: columns _rows and, of the k-th column, _n_k, _s_k, ..."""
    number = lambda c: numbers(column(t, c))
    got = {"n": number(f"_n_{k}")[0], "rows": number("_rows")[0]}
    for c in t.column_names:
        if c == f"_s_{k}":
            got["s"] = number(c)
        elif c == f"_e_{k}":
            got["e"] = column(t, c)
        elif c in (f"_m_{k}", f"_q_{k}"):
            got[c[1]] = number(c)[0]
    return got


def aggregate(kind: str, got: dict, lo: np.ndarray, hi: np.ndarray, least: int, out: pa.DataType, q: float = 0.5) -> pa.Array:
    """An aggregate of each slice, null for fewer than ``least`` values (of count: rows)."""
    n = sums(got["n"], lo, hi)
    if kind == "count":
        return pa.array(n, out, mask=sums(got["rows"], lo, hi) < least)
    ok = n >= max(least, 1)
    if kind in ("sum", "mean"):
        v, places = got["s"]
        s = merged((v,), (0.0,), lo, hi, _add)[0] if places is None else sums(v, lo, hi)
        if kind == "mean":
            v = np.array([int(x) / (10**places * max(int(k), 1)) for x, k in zip(s, n, strict=True)], float) if s.dtype == object else s / ((10.0 ** (places or 0)) * np.maximum(n, 1))
            return pa.array(v, out, mask=~ok)
        if pa.types.is_decimal(out):
            return from_unscaled(s, ok, out)
        return pa.array(s, out, mask=~ok) if pa.types.is_integer(out) else pa.array(doubles(s, places), out, mask=~ok)
    if kind in ("min", "max"):
        codes, back = coded(got["e"])
        end = np.iinfo(np.int64).max if kind == "min" else np.iinfo(np.int64).min
        codes = np.where(got["n"] > 0, codes, end)
        op = (lambda a, b: (np.minimum(a[0], b[0]),)) if kind == "min" else (lambda a, b: (np.maximum(a[0], b[0]),))
        return back(merged((codes,), (end,), lo, hi, op)[0], ok).cast(out)
    if kind in ("var", "std"):
        k, _, d = merged((got["n"], got["m"], got["q"]), (0, 0.0, 0.0), lo, hi, _spread)
        v = d / np.maximum(k - 1, 1)
        return pa.array(np.sqrt(v) if kind == "std" else v, out, mask=~ok | (k < 2))
    return pa.array(quantiles(got["v"], got["n"] > 0, lo, hi, q), out, mask=~ok)


def quantiles(v: np.ndarray, ok: np.ndarray, lo: np.ndarray, hi: np.ndarray, q: float) -> np.ndarray:
    """Interpolated quantiles of slices that move on; of short ones by sorting each, else in a list that is kept sorted."""
    out = np.zeros(len(lo))
    if not len(lo):
        return out
    width = int((hi - lo).max())
    if width <= 64:
        x, step, there = np.append(np.where(ok, v, np.inf), np.inf), max(1, 1_000_000 // max(width, 1)), sums(ok.astype(np.int64), lo, hi)
        for k in range(0, len(lo), step):
            a, b = lo[k : k + step], hi[k : k + step]
            at = a[:, None] + np.arange(max(width, 1))
            s = np.sort(x[np.where(at < b[:, None], at, len(v))], axis=1)
            last = np.maximum(there[k : k + step] - 1, 0)
            i, row = (q * last).astype(int), np.arange(len(a))
            low, high, part = s[row, i], s[row, np.minimum(i + 1, last)], q * last - i
            out[k : k + step] = low + np.where(part > 0, high - low, 0) * part
        return out
    kept, a, b = [], int(lo[0]), int(lo[0])
    for k, (i, j) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
        for x in v[b:j][ok[b:j]].tolist():
            bisect.insort(kept, x)
        for x in v[a:i][ok[a:i]].tolist():
            del kept[bisect.bisect_left(kept, x)]
        a, b = i, max(b, j)
        if kept:
            place = q * (len(kept) - 1)
            m = int(place)
            out[k] = kept[m] + (kept[min(m + 1, len(kept) - 1)] - kept[m]) * (place - m)
    return out
