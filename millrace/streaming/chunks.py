"""Ordered operators on streams, chunk by chunk.

A micro-batch's rows are dealt by ranges of the order, and each range is sorted and packed into chunks of Arrow data. A
stateful processor takes a sequence's chunks (a key's, or the stream's) in order, one in memory at a time, since they lie
in a temporary file; it gives chunks of results, which are dealt out again and unpacked. So what runs in one task a
sequence is the carry from chunk to chunk, on arrays; sorting, packing, unpacking and all that follows run in many.

An operator is a generator function of (state, tables): it yields tables of results and returns the new state. State is
what the next micro-batch needs of the past; it is kept in the state store, by key.
"""

from __future__ import annotations

import pickle
import tempfile
import zlib
from collections.abc import Callable, Generator, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from ..operators import arrays
from ..operators.arrays import column
from ..operators.steps import records, typed

Operator = Callable[[Any, Iterator[pa.Table]], Generator[pa.Table, None, Any]]
RANGES, CHUNK, SENT, KEPT = 64, 20_000, 4 << 20, 32 << 20  # ranges, rows a chunk, bytes a batch, bytes kept in memory


def _bytes(t: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, t.schema) as w:
        w.write_table(t)
    return out.getvalue().to_pybytes()


def run(df: DataFrame, order: list[str], operator: Operator, result: StructType, key: str | None = None) -> DataFrame:
    """Rows that ``operator`` makes of a stream's rows, or of each key's, in the order of these columns."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by, first = [*([key] if key else []), *order], order[0]
    kinds = [StructField("k", df.schema[key].dataType if key else IntegerType()), StructField("first", df.schema[first].dataType), StructField("nth", IntegerType()), StructField("data", BinaryType())]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not batches:
            return
        t = pa.Table.from_batches(batches).combine_chunks()
        del batches
        t = t.take(pc.sort_indices(t, [(c, "ascending") for c in by]))
        ends = column(t, key) if key else None
        ends = [t.num_rows] if ends is None else pc.run_end_encode(ends).run_ends.to_pylist()
        rows, size, at = [], 0, 0

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], t.schema.field(key).type if key else pa.int32()), pa.array([r[1] for r in rows], t.schema.field(first).type), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.binary())], ["k", "first", "nth", "data"])

        for end in ends:
            for nth, a in enumerate(range(at, end, CHUNK)):
                part = t.slice(a, min(CHUNK, end - a))
                rows.append((t[key][a].as_py() if key else 0, t[first][a].as_py(), nth, _bytes(part)))
                size += len(rows[-1][-1])
                if size >= SENT or len(rows) >= 1000:
                    yield sent()
                    rows, size = [], 0
            at = end
        if rows:
            yield sent()

    names = to_arrow_schema(result)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                yield from pa.ipc.open_stream(data.as_buffer()).read_all().select(names.names).cast(names).to_batches()

    packed = df.repartitionByRange(max(RANGES, parts), *by).mapInArrow(pack, StructType(kinds))
    made = packed.groupBy("k").transformWithStateInPandas(processor(operator), outputStructType="at long, data binary", outputMode="append", timeMode="none")
    return made.repartition(parts, "at").mapInArrow(unpack, result)


def processor(operator: Operator):
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class Processor(StatefulProcessor):
        def init(self, handle) -> None:
            self.state = handle.getValueState("state", "data binary")

        def handleInputRows(self, key, rows, timers):
            state = pickle.loads(self.state.get()[0]) if self.state.exists() else None
            with tempfile.SpooledTemporaryFile(max_size=KEPT) as file:
                places, at = [], 0
                for frame in rows:
                    for first, nth, data in zip(frame["first"], frame["nth"], frame["data"], strict=True):
                        places.append((first, nth, at, len(data)))
                        file.write(data)
                        at += len(data)

                def tables():
                    for _, _, start, size in sorted(places):
                        file.seek(start)
                        yield pa.ipc.open_stream(file.read(size)).read_all()

                running = operator(state, tables())
                while True:
                    try:
                        out = next(running)
                    except StopIteration as end:
                        state = end.value
                        break
                    if out.num_rows:
                        data = _bytes(out)
                        yield pd.DataFrame({"at": [zlib.crc32(data)], "data": [data]})
            self.state.update((pickle.dumps(state),))

        def close(self) -> None:
            pass

    return Processor()


# Operators


def joined(*parts: pa.Array | None) -> pa.Array:
    some = [x for x in parts if x is not None]
    kind = some[-1].type
    return pa.concat_arrays([x.cast(kind) for x in some])


def copied(x: pa.Array) -> pa.Array:
    """A slice without the rest of its buffers."""
    return x.take(pa.array(np.arange(len(x)), pa.int64()))


def lists(values: pa.Array, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """An array of lists ``values[start:end]``."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], size)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values.take(pa.array(at, pa.int64())))


def _table(t: pa.Table, kept: list[str], made: dict[str, pa.Array]) -> pa.Table:
    return pa.table({c: t[c] for c in kept} | made)


def running(columns: dict[str, tuple[str, str]], kept: list[str]) -> Operator:
    """Running folds name=(kind, column); nulls are skipped, and give null but for counts."""

    def fold(kind: str, x: pa.Array, carried):
        """(results, carry). Carried values are whole numbers of the last place, doubles or Python's values."""
        x = arrays._nothing(x)
        ok = arrays.valid(x)
        if kind == "count":
            got = np.cumsum(ok) + (carried or 0)
            return pa.array(got, pa.int64()), int(got[-1]) if len(got) else carried
        if not ok.any():
            return pa.nulls(len(x)), carried
        some = x.drop_null()
        v, places = (None, None) if kind in ("min", "max") else arrays.numbers(some)
        if kind == "product":
            v, places = arrays.doubles(v, places), None
        if v is None:
            every = some if carried is None else joined(pa.array([carried], some.type), some)
            codes, back = arrays.coded(every)
            got = (np.minimum if kind == "min" else np.maximum).accumulate(codes)[len(every) - len(some) :]
            made = back(got, np.ones(len(got), bool))
            carried = made[-1].as_py()
        else:
            if places is not None:
                v = arrays.roomy(v, carried or 0)
            if carried is not None:
                v = np.concatenate([np.array([carried], v.dtype), v])
            got = (np.multiply if kind == "product" else np.add).accumulate(v)[len(v) - len(some) :]
            carried = int(got[-1]) if places is not None else float(got[-1])
            if pa.types.is_decimal(some.type) and places is not None:
                made = arrays.from_unscaled(got, np.ones(len(got), bool), pa.decimal128(38, places))
            else:
                made = pa.array(got)
        return made.take(pa.array(np.cumsum(ok) - 1, pa.int64(), mask=~ok)), carried

    def operator(state, tables):
        state = dict(state or {})
        for t in tables:
            made = {}
            for n, (kind, c) in columns.items():
                made[n], state[n] = fold(kind, column(t, c), state.get(n))
            yield _table(t, kept, made)
        return state

    return operator


def rolling(columns: dict[str, str], kind: str, out: pa.DataType, kept: list[str], n: int | None = None, ts: str | None = None, width: int | None = None, least: int = 1, q: float = 0.5) -> Operator:
    """Aggregates result=column of the last n rows, or of the rows whose ``ts`` (in the order of which they come) is in (t - width, t]:
    rows of one time see each other, as long as they come in one micro-batch."""
    names = [*columns.values(), *([ts] if ts else [])]

    def operator(state, tables):
        for t in together(tables, ts) if ts else tables:
            past = 0 if state is None else state.num_rows
            every = t.select(names) if state is None else pa.concat_tables([state, t.select(names)]).combine_chunks()
            if ts:
                times = column(every, ts)
                some = len(times) - times.null_count  # those without a time come last, and see one another only
                at = times.slice(0, some).to_numpy(zero_copy_only=False)
                order = np.argsort(at, kind="stable")  # late rows of a later micro-batch go back to their place
                at, mine = at[order], np.sort(np.flatnonzero(order >= past))
                lo, hi = np.searchsorted(at, at[mine] - width, "right"), np.searchsorted(at, at[mine], "right")
                back = np.argsort(order[mine])
                order = np.concatenate([order, np.arange(some, len(times))])
                lo, hi = np.concatenate([lo[back], np.full(len(times) - some, some)]), np.concatenate([hi[back], np.full(len(times) - some, len(times))])
                first = np.searchsorted(at, at[-1] - width, "right") if some else 0
                left = every.take(pa.array(order, pa.int64()))
                every, state = left, left.slice(int(first), some - int(first))
            else:
                at = np.arange(past, past + t.num_rows)
                lo, hi = np.maximum(at - n + 1, 0), at + 1
                state = every.slice(max(every.num_rows - n + 1, 0))
            state = pa.table({c: copied(column(state, c)) for c in names})
            yield _table(t, kept, {r: arrays.aggregate(kind, arrays.rows_of(kind, column(every, c)), lo, hi, least, out, q) for r, c in columns.items()})
        return state

    return operator


def together(tables: Iterable[pa.Table], ts: str) -> Iterator[pa.Table]:
    """The same rows, cut where a new time begins."""
    rest = []
    for t in tables:
        x = column(t, ts)
        if x.null_count:  # the last rows
            rest.append(t)
            continue
        x = x.to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(x, x[-1]))
        if cut or rest and column(rest[-1], ts)[-1].as_py() != x[0]:
            yield pa.concat_tables([*rest, t.slice(0, cut)]).combine_chunks()
            rest = []
        rest.append(t.slice(cut))
    if rest:
        yield pa.concat_tables(rest).combine_chunks()


def sliding_window(c: str, n: int, kept: list[str], partial: bool = True) -> Operator:
    def operator(state, tables):
        step = max(1, 1_000_000 // n)
        for whole in tables:
            for a in range(0, whole.num_rows, step):
                t = whole.slice(a, step)
                past = 0 if state is None else len(state)
                x = joined(state, column(t, c))
                at = np.arange(past, len(x))
                if not partial:
                    at, t = at[at >= n - 1], t.slice(max(n - 1 - past, 0))
                yield _table(t, kept, {"values": lists(x, np.maximum(at - n + 1, 0), at + 1)})
                state = copied(x.slice(max(len(x) - n + 1, 0)))
        return state

    return operator


def partition(c: str, n: int, kept: list[str]) -> Operator:
    def operator(state, tables):
        for t in tables:
            past = 0 if state is None else len(state)
            x = joined(state, column(t, c))
            k = len(x) // n
            last = pa.array(np.arange(1, k + 1) * n - 1 - past, pa.int64())
            yield _table(t.take(last), kept, {"values": lists(x, np.arange(k) * n, np.arange(1, k + 1) * n)})
            state = copied(x.slice(k * n))
        return state

    return operator


def collect(flush: str, c: str, kept: list[str]) -> Operator:
    """Values since the last flush, at each flush. What waits is kept in pieces, so that a long wait is joined once."""

    def operator(state, tables):
        waiting = [] if state is None else [state]
        for t in tables:
            f = column(t, flush).to_numpy(zero_copy_only=False).astype(bool)
            x = column(t, c).filter(pa.array(~f))
            if not f.any():
                waiting.append(x)
                continue
            past = sum(map(len, waiting))
            ends = np.cumsum(~f)[f] + past
            x = joined(*waiting, x)
            yield _table(t.filter(pa.array(f)), kept, {"values": lists(x, np.concatenate([[0], ends[:-1]]), ends)})
            waiting = [copied(x.slice(int(ends[-1])))]
        return joined(*waiting) if waiting else None

    return operator


def taken(start: int, end: int | None, every: int | None) -> Operator:
    def operator(state, tables):
        k = state or 0
        for t in tables:
            at = np.arange(k, k + t.num_rows)
            keep = at >= start
            if end is not None:
                keep &= at < end
            if every:
                keep &= at % every == 0
            yield t.filter(pa.array(keep))
            k += t.num_rows
        return k

    return operator


def _sides(t: pa.Table, values: list[str]) -> tuple[np.ndarray, list[pa.Array]]:
    return column(t, "side").to_numpy(zero_copy_only=False), [column(t, c) for c in values]


def _last(side: np.ndarray, k: int) -> np.ndarray:
    """Place of the last row of a side up to each row, -1 before the first."""
    return np.maximum.accumulate(np.where(side == k, np.arange(len(side)), -1))


def combine_latest(values: list[str], emit_on: list[int] | None) -> Operator:
    """Rows (seq, side) with the value of side k in column ``values[k]``: the latest of all sides at each row, or at those of
    some sides."""

    def operator(state, tables):
        state = dict(state or {})
        for t in tables:
            side, columns = _sides(t, values)
            made, full = {}, np.isin(side, emit_on) if emit_on is not None else np.ones(len(side), bool)
            for k, x in enumerate(columns):
                at = _last(side, k)
                full &= (at >= 0) | (k in state)
                made[f"_{k}"] = joined(state.get(k, pa.nulls(1)), x).take(pa.array(at + 1, pa.int64()))
                if len(at) and at[-1] >= 0:
                    state[k] = copied(x.slice(int(at[-1]), 1))
            yield _table(t, ["seq"], made).filter(pa.array(full))
        return state

    return operator


def zip_latest(values: list[str]) -> Operator:
    """Each row of side 0 once, with the others' latest; early ones wait, in pieces, for the others' first."""

    def operator(state, tables):
        others, waiting = state or ({}, [])
        others, waiting = dict(others), list(waiting)
        for t in tables:
            side, columns = _sides(t, values)
            at = {k: _last(side, k) for k in range(1, len(values))}
            ready = np.ones(len(side), bool)
            for k, x in at.items():
                ready &= (x >= 0) | (k in others)
            own = side == 0
            mine = pa.table({"seq": t["seq"], "_0": columns[0]})
            then = int(np.argmax(ready)) if ready.any() else len(side)  # from here on no row waits
            early, now = mine.slice(0, then).filter(pa.array(own[:then])), np.flatnonzero(own & ready)
            if early.num_rows:
                waiting.append(early.take(pa.array(np.arange(early.num_rows), pa.int64())))
            look = {k: joined(others.get(k, pa.nulls(1)), columns[k]) for k in at}
            if then < len(side):
                for w in waiting:
                    yield pa.table({"seq": w["seq"], "_0": w["_0"]} | {f"_{k}": look[k].take(pa.array(np.full(w.num_rows, at[k][then] + 1), pa.int64())) for k in at})
                waiting = []
                yield pa.table({"seq": t["seq"], "_0": columns[0]} | {f"_{k}": look[k].take(pa.array(at[k] + 1, pa.int64())) for k in at}).take(pa.array(now, pa.int64()))
            for k, x in at.items():
                if len(x) and x[-1] >= 0:
                    others[k] = copied(columns[k].slice(int(x[-1]), 1))
        return others, waiting

    return operator


def zipped(values: list[str], names: list[str]) -> Operator:
    """Tuples by position, with the order of the row that completed each. A side that is ahead waits in pieces."""

    def operator(state, tables):
        waiting = [list(w) for w in state or [[] for _ in values]]
        sizes = [sum(map(len, w)) for w in waiting]
        for t in tables:
            side, columns = _sides(t, values)
            came = [np.flatnonzero(side == k) for k in range(len(values))]
            new = [columns[k].take(pa.array(x, pa.int64())) for k, x in enumerate(came)]
            ready = min(s + len(x) for s, x in zip(sizes, came, strict=True))
            made, last = {}, np.full(ready, -1, np.int64)
            for k, x in enumerate(came):
                if ready:
                    some, left, need = [], [], ready
                    for piece in [*waiting[k], new[k]]:
                        some.append(piece.slice(0, need))
                        if len(piece) > need:
                            left.append(piece.slice(need))
                        need = max(need - len(piece), 0)
                    made[names[k]] = joined(*some)
                    last = np.maximum(last, np.concatenate([np.full(min(sizes[k], ready), -1), x])[:ready].astype(np.int64))
                    waiting[k] = left
                elif len(x):
                    waiting[k].append(new[k])
                sizes[k] += len(x) - ready
            if ready:
                yield pa.table({"seq": column(t, "seq").take(pa.array(last, pa.int64()))} | made)
        return [[copied(joined(*w))] if w else [] for w in waiting]

    return operator


def by_row(step: Callable, value: Callable[[dict], Any], seq: str, kind: StructField, key: str | None = None) -> Operator:
    """A step function, row by row; (key, seq, nth, result) of each result."""
    arrow = to_arrow_schema(StructType([kind])).field(0).type

    def operator(state, tables):
        for t in tables:
            at, nth, results = [], [], []
            for k, row in enumerate(records(t)):
                state, got = step(state, value(row))
                at += [k] * len(got)
                nth += range(len(got))
                results += got
            some = t.take(pa.array(at, pa.int64()))
            yield pa.table(({key: some[key]} if key else {}) | {"seq": some[seq], "nth": pa.array(nth, pa.int32()), "result": typed(results, arrow)})
        return state

    return operator
