"""Sequential operators as step functions, one code for bounded tables and for streams.

A step takes (state, element) and returns (state, list of results). Bounded tables run a step over each key's rows in
order, batch by batch; streams run it in a stateful processor (``millrace.streaming.chunks``). Without a key all rows are one sequence.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType, _parse_datatype_string

Step = Callable[[Any, Any], tuple[Any, list]]
EMPTY = "__empty__"


def accumulate(fn: Callable, start: Any = EMPTY, returns_state: bool = False, with_state: bool = False) -> Step:
    """Fold; without ``start`` the first element is the first state and comes out as it is."""

    def step(state, x):
        state = start if state is None else state[0]
        if isinstance(state, str) and state == EMPTY:
            return (x,), [(x, x) if with_state else x]
        got = fn(state, x)
        state, result = got if returns_state else (got, got)
        return (state,), [(state, result) if with_state else result]

    return step


def partition(n: int) -> Step:
    def step(state, x):
        state = [*(state or []), x]
        return ([], [state]) if len(state) == n else (state, [])

    return step


def partition_unique(n: int, key: Callable = lambda x: x, keep: str = "first") -> Step:
    """Lists of n elements of different keys; of equal keys the first stays in its place, or the last at the end."""

    def step(state, x):
        state = OrderedDict(state or {})
        k = key(x)
        if keep == "last":
            state.pop(k, None)
        state.setdefault(k, x)
        return ({}, [list(state.values())]) if len(state) == n else (dict(state), [])

    return step


def sliding_window(n: int, return_partial: bool = True) -> Step:
    def step(state, x):
        state = [*(state or []), x][-n:]
        return state, [state] if return_partial or len(state) == n else []

    return step


def unique(maxsize: int | None = None, key: Callable = lambda x: x) -> Step:
    """First of each key; with ``maxsize`` only that many keys are remembered, least recently seen ones go first."""

    def step(state, x):
        state = OrderedDict.fromkeys(state or ())
        k = key(x)
        known = k in state
        state.pop(k, None)
        state[k] = None
        if maxsize and len(state) > maxsize:
            state.popitem(last=False)
        return list(state), [] if known else [x]

    return step


def ewm_mean(alpha: float) -> Step:
    """Exponentially weighted mean with adjusted weights."""

    def step(state, x):
        total, weight = state or (0.0, 0.0)
        total, weight = total * (1 - alpha) + x, weight * (1 - alpha) + 1
        return (total, weight), [total / weight]

    return step


def last_n(n: int, fn: Callable[[list], Any]) -> Step:
    def step(state, x):
        state = deque(state or (), maxlen=n)
        state.append(x)
        return list(state), [fn(list(state))]

    return step


def run_bounded(df: DataFrame, seq: str, step: Step, result: str, value: Callable[[dict], Any], key: str | None = None) -> DataFrame:
    """(key, seq, nth, result) of each result; nth counts results of one element. Rows of a key come sorted, batch by batch,
    so that a task holds one batch and one state, however many rows a key has."""
    kinds = [*([StructField(key, df.schema[key].dataType)] if key else []), StructField("seq", df.schema[seq].dataType), StructField("nth", IntegerType()), StructField("result", _parse_datatype_string(result))]
    schema = StructType(kinds)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = None, ()
        for batch in batches:
            at, nth, results = [], [], []
            for k, row in enumerate(records(batch)):
                if key and (row[key],) != last:
                    state, last = None, (row[key],)
                state, out = step(state, value(row))
                at += [k] * len(out)
                nth += range(len(out))
                results += out
            some = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*([some[key]] if key else []), some[seq], pa.array(nth, pa.int32()), typed(results, arrow.field("result").type)], names=arrow.names)

    dealt = df.repartition(key) if key else df.repartition(1)
    return dealt.sortWithinPartitions(*([key] if key else []), seq).mapInArrow(run, schema)


def records(t: pa.Table | pa.RecordBatch) -> Iterator[dict]:
    """Rows as dicts of Python's values; not a number is null."""
    columns = []
    for x in t.columns:
        v = x.to_pylist()
        columns.append([None if y != y else y for y in v] if pa.types.is_floating(x.type) else v)
    return (dict(zip(t.schema.names, r, strict=True)) for r in zip(*columns, strict=True))


def typed(values: list, kind: pa.DataType) -> pa.Array:
    """Results as the declared type, by a cast where they are of another (a decimal for a double)."""
    try:
        return pa.array(values, kind)
    except (pa.ArrowInvalid, pa.ArrowTypeError):
        return pa.array(values).cast(kind)
