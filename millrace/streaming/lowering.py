"""Ordered operators on streams, as stateful operators on chunks (``chunks``).

A stream has no last row, so an ordered operator keeps what it needs of the past in the state store: the last n elements,
an open part, the latest of each side, a running total. Rows of a micro-batch are taken in the order of ``seq`` (for
windows of time: of the time); the result of a row is sent once. With a key the sequences of different keys run in
parallel; without one the whole stream is one sequence, by what the operator means: the carry from chunk to chunk runs in
one task a micro-batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..operators import steps
from . import chunks


def _fields(df: DataFrame, seq: str, key: str | None, **made: str) -> StructType:
    """(key, seq, made columns)."""
    kept = [*([StructField(key, df.schema[key].dataType)] if key else []), StructField("seq", df.schema[seq].dataType)]
    return StructType([*kept, *(StructField(c, _parse_datatype_string(k)) for c, k in made.items())])


def _ordered(df: DataFrame, seq: str, key: str | None, *columns: str) -> DataFrame:
    """The columns that an operator reads, with the order as ``seq``."""
    some = [c for c in dict.fromkeys(columns) if c not in (seq, key)]
    again = {seq, key} & set(columns)
    return df.select(*([key] if key else []), F.col(seq).alias("seq"), *(F.col(c).alias(f"_v_{c}") for c in [*some, *again]))


def _run(df: DataFrame, seq: str, key: str | None, columns: list[str], operator: Callable[[Callable, list[str]], chunks.Operator], **made: str) -> DataFrame:
    """(key, seq, made columns) of an operator that is made from the columns' names in the chunks and what it keeps."""
    kept = [*([key] if key else []), "seq"]
    return chunks.run(_ordered(df, seq, key, *columns), ["seq"], operator(lambda c: f"_v_{c}", kept), _fields(df, seq, key, **made), key)


def sequence(df: DataFrame, seq: str, step: steps.Step, result: str, value: Callable[[dict], Any], key: str | None = None) -> DataFrame:
    """(key, seq, nth, result) of a step function's results."""
    kind = StructField("result", _parse_datatype_string(result))
    return chunks.run(df, [seq], chunks.by_row(step, value, seq, kind, key), _fields(df, seq, key, nth="int", result=result), key)


def whole_rows(df: DataFrame, seq: str, operator: chunks.Operator, key: str | None = None) -> DataFrame:
    """An operator that lets whole rows through."""
    return chunks.run(df, [seq], operator, StructType([StructField(f.name, f.dataType) for f in df.schema]), key)


def running(df: DataFrame, seq: str, columns: dict[str, tuple[str, str]], key: str | None = None) -> DataFrame:
    """(key, seq, folds) of each row: name=(kind, column), as ``ordered.running`` does on tables."""
    kinds = dict(df.dtypes)
    wide = lambda c: re.sub(r"decimal\(\d+,", "decimal(38,", kinds[c])
    made = {n: wide(c) if k == "sum" and kinds[c].startswith("decimal") else "bigint" if k == "count" or k == "sum" and kinds[c] in ("int", "bigint", "smallint", "tinyint") else "double" if k == "product" or kinds[c] == "float" else kinds[c] for n, (k, c) in columns.items()}
    return _run(df, seq, key, [c for _, c in columns.values()], lambda name, kept: chunks.running({n: (k, name(c)) for n, (k, c) in columns.items()}, kept), **made)


def rolling(df: DataFrame, seq: str, columns: list[str], kind: str, n: int | None = None, ts: str | None = None, width: float | None = None, least: int = 1, q: float = 0.5) -> DataFrame:
    """(seq, columns) of each row: an aggregate over the last n rows, or the last ``width`` seconds of ``ts``."""
    result = "bigint" if kind == "count" else "double"
    out = to_arrow_type(_parse_datatype_string(result))
    if not ts:
        return _run(df, seq, None, columns, lambda name, kept: chunks.rolling({c: name(c) for c in columns}, kind, out, kept, n, least=least, q=q), **dict.fromkeys(columns, result))
    rows = df.select(F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"), F.col(seq).alias("seq"), *(F.col(c).alias(f"_v_{c}") for c in columns))
    return chunks.run(rows, ["_t", "seq"], chunks.rolling({c: f"_v_{c}" for c in columns}, kind, out, ["seq"], ts="_t", width=int(width * 1e6), least=least, q=q), _fields(df, seq, None, **dict.fromkeys(columns, result)))


def sliding_window(df: DataFrame, seq: str, column: str, n: int, partial: bool = True, key: str | None = None) -> DataFrame:
    """(key, seq, values)."""
    return _run(df, seq, key, [column], lambda name, kept: chunks.sliding_window(name(column), n, kept, partial), values=f"array<{dict(df.dtypes)[column]}>")


def partition(df: DataFrame, seq: str, column: str, n: int, key: str | None = None) -> DataFrame:
    """(key, seq, values)."""
    return _run(df, seq, key, [column], lambda name, kept: chunks.partition(name(column), n, kept), values=f"array<{dict(df.dtypes)[column]}>")


def collect(df: DataFrame, seq: str, flush: str, column: str, key: str | None = None) -> DataFrame:
    """(key, seq, values) at each row for which the column ``flush`` holds."""
    return _run(df, seq, key, [flush, column], lambda name, kept: chunks.collect(name(flush), name(column), kept), values=f"array<{dict(df.dtypes)[column]}>")


def _sides(sides: list[tuple[DataFrame, str]], column: str) -> tuple[DataFrame, list[str], list[str]]:
    """The sides' rows in one stream (seq, side, values), their types, and the column of each side's values."""
    kinds = [dict(df.dtypes)[column] for df, _ in sides]
    if len(set(kinds)) == 1:
        rows = [df.select(F.col(seq).alias("seq"), F.lit(k).alias("side"), F.col(column).alias("value")) for k, (df, seq) in enumerate(sides)]
        return reduce(DataFrame.unionAll, rows), kinds, ["value"] * len(sides)
    rows = [df.select(F.col(seq).alias("seq"), F.lit(k).alias("side"), *((F.col(column) if j == k else F.lit(None).cast(kind)).alias(f"_{j}") for j, kind in enumerate(kinds))) for k, (df, seq) in enumerate(sides)]
    return reduce(DataFrame.unionAll, rows), kinds, [f"_{k}" for k in range(len(sides))]


def latest(sides: list[tuple[DataFrame, str]], operator: Callable[[list[str]], chunks.Operator], column: str) -> DataFrame:
    """(seq, _0, _1, ...) that an operator on sides makes. Rows of a micro-batch are taken by seq over all sides."""
    rows, kinds, values = _sides(sides, column)
    return chunks.run(rows, ["seq", "side"], operator(values), _fields(rows, "seq", None, **{f"_{k}": kind for k, kind in enumerate(kinds)}))


def zipped(sides: list[tuple[int, DataFrame, str]], fixed: dict[int, Any], column: str) -> DataFrame:
    """(seq, _0, _1, ...) by position, with constants at their places; seq is that of the row that completed the tuple."""
    rows, kinds, values = _sides([(df, seq) for _, df, seq in sides], column)
    names = [f"_{k}" for k, _, _ in sides]
    out = chunks.run(rows, ["seq", "side"], chunks.zipped(values, names), _fields(rows, "seq", None, **dict(zip(names, kinds, strict=True))))
    out = out.withColumns({f"_{k}": F.lit(v) for k, v in fixed.items()})
    return out.select("seq", *sorted((c for c in out.columns if c != "seq"), key=lambda c: int(c[1:])))
