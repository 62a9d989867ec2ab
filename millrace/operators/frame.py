"""Frames over ordered rows: elementwise algebra, reductions, grouping and windows.

Results come in three cadences: final (one result), per batch (the value at each batch's last row, over all rows up to
there) and per row. Nulls and NaN are skipped, null keys are dropped, var of a single row is null.
"""

from __future__ import annotations

import ast
import io
import tokenize
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import clean, divide, floor_div, floor_mod, half_even, seconds, variance
from ..streaming import lowering
from . import ordered

#: Sums are exact to the cent and the same in any order where values are cast first.
AGGREGATES = ("sum", "mean", "count", "size", "var", "std")


def aggregate(kind: str, c: Column, ddof: int = 1) -> Column:
    x = c
    if kind == "sum":
        return F.coalesce(F.sum(x), F.lit(0))
    if kind == "mean":
        return F.avg(x.cast("double"))
    if kind == "count":
        return F.count(x)
    if kind == "size":
        return F.count(F.lit(1))
    if kind in ("var", "std"):
        v = {1: F.var_samp, 0: F.var_pop}[ddof](x) if ddof in (0, 1) else variance(F.count(x), F.sum(x), F.sum(x * x), ddof)
        return F.sqrt(v) if kind == "std" else v
    return {"min": F.min, "max": F.max, "median": lambda y: F.percentile(y, 0.5), "product": F.product}[kind](x)


class Series:
    """A column of a frame."""

    def __init__(self, frame: FlowFrame, col: Column, name: str = "value"):
        self.frame, self.col, self.name = frame, col, name

    def _of(self, col: Column) -> Series:
        return Series(self.frame, col, self.name)

    def astype(self, kind: str) -> Series:
        return self._of(self.col.try_cast(kind))

    def round(self, decimals: int = 0) -> Series:
        return self._of(half_even(self.col, decimals))

    def isin(self, *values) -> Series:
        return self._of(self.col.isin(*values))

    def map(self, fn, kind: str, na_action: str | None = None) -> Series:
        @F.pandas_udf(kind)
        def apply(x: pd.Series) -> pd.Series:
            return x.map(fn, na_action=na_action)

        return self._of(apply(self.col))

    def to_frame(self, name: str | None = None) -> FlowFrame:
        f = self.frame
        return f._next(f.df.select(*f._kept(), self.col.alias(name or self.name)))

    def __getattr__(self, kind: str):
        if kind in (*AGGREGATES, "value_counts", "cumsum", "cumprod", "cummin", "cummax", "rolling", "window", "expanding", "ewm"):
            return getattr(self.to_frame(), kind)
        raise AttributeError(kind)


def _value(x):
    return x.col if isinstance(x, Series) else F.lit(x) if not isinstance(x, Column) else x


_BINARY = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "truediv": divide,
    "floordiv": floor_div,
    "mod": floor_mod,
    "pow": F.pow,
    "and": lambda a, b: a & b,
    "or": lambda a, b: a | b,
    "xor": lambda a, b: a.bitwiseXOR(b),
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
    "lshift": lambda a, b: F.call_function("shiftleft", a, b.cast("int")),
    "rshift": lambda a, b: F.call_function("shiftright", a, b.cast("int")),
}
for _name, _fn in _BINARY.items():
    setattr(Series, f"__{_name}__", lambda self, other, f=_fn: self._of(f(self.col, _value(other))))
    if _name not in ("eq", "ne", "lt", "le", "gt", "ge"):
        setattr(Series, f"__r{_name}__", lambda self, other, f=_fn: self._of(f(_value(other), self.col)))
Series.__neg__ = lambda self: self._of(-self.col)
Series.__abs__ = lambda self: self._of(F.abs(self.col))
Series.__invert__ = lambda self: self._of(~self.col)
Series.__hash__ = object.__hash__


class FlowFrame:
    def __init__(self, df: DataFrame, seq: str = "seq", index: str | None = None, batch: str | None = None):
        self.df, self.seq, self.index_col, self.batch = df, seq, index, batch

    def _next(self, df: DataFrame, **changed) -> FlowFrame:
        return FlowFrame(df, **{"seq": self.seq, "index": self.index_col, "batch": self.batch} | changed)

    def _kept(self) -> list[str]:
        return [c for c in dict.fromkeys((self.seq, self.batch, self.index_col)) if c and c in self.df.columns]

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c not in self._kept()]

    @property
    def dtypes(self) -> dict[str, str]:
        return {c: t for c, t in self.df.dtypes if c in self.columns}

    def __dir__(self):
        return [*super().__dir__(), *self.columns]

    def __getattr__(self, name: str) -> Series:
        if name.startswith("_") or name not in self.__dict__.get("df").columns:
            raise AttributeError(name)
        return Series(self, F.col(name), name)

    def __getitem__(self, what) -> Series | FlowFrame:
        if isinstance(what, Series):
            return self._next(self.df.filter(what.col))
        if isinstance(what, list):
            return self._next(self.df.select(*dict.fromkeys([*self._kept(), *what])))
        return getattr(self, what)

    def __setitem__(self, name, value) -> None:
        pairs = zip(name, (Series(value, F.col(c), c) for c in value.columns), strict=True) if isinstance(name, list) else ((name, value),)
        self.df = self.df.withColumns({n: _value(v) for n, v in pairs})

    def verify(self, df: DataFrame) -> None:
        if df.columns != self.df.columns:
            raise IndexError(f"columns are {df.columns}, not {self.df.columns}")

    @classmethod
    def from_series(cls, **series: Series) -> FlowFrame:
        f = next(iter(series.values())).frame
        return f._next(f.df.select(*f._kept(), *(s.col.alias(n) for n, s in series.items())))

    def query(self, text: str) -> FlowFrame:
        """Rows for which a predicate in the dataframe library's notation holds."""
        return self._next(self.df.filter(predicate(text)))

    def assign(self, **columns) -> FlowFrame:
        return self._next(self.df.withColumns({n: _value(v) for n, v in columns.items()}))

    def round(self, decimals: int = 0) -> FlowFrame:
        return self._next(self.df.withColumns({c: half_even(F.col(c), decimals) for c, t in self.dtypes.items() if t in ("double", "float") or t.startswith("decimal")}))

    def astype(self, kind: str) -> FlowFrame:
        return self._next(self.df.withColumns({c: F.col(c).try_cast(kind) for c in self.columns}))

    def set_index(self, name: str) -> FlowFrame:
        return self._next(self.df, index=name)

    def reset_index(self) -> FlowFrame:
        return self._next(self.df, index=None)

    @property
    def index(self) -> Series:
        return Series(self, F.col(self.index_col or self.seq), "index")

    def tail(self, n: int = 5) -> FlowFrame:
        """Last n rows of each batch."""
        w = W.partitionBy(self.batch or F.lit(1)).orderBy(F.desc(self.seq))
        return self._next(self.df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r"))

    def map_partitions(self, fn, schema: str) -> FlowFrame:
        return self._next(self.df.mapInPandas(lambda it: (fn(x) for x in it), schema))

    # Reductions

    def reduce(self, kind: str, ddof: int = 1) -> DataFrame:
        if kind == "size":
            return self.df.agg((F.count(F.lit(1)) * len(self.columns)).alias("size"))
        return self.df.agg(*(aggregate(kind, F.col(c), ddof).alias(c) for c in self.columns))

    sum = lambda self: self.reduce("sum")
    mean = lambda self: self.reduce("mean")
    count = lambda self: self.reduce("count")
    size = lambda self: self.reduce("size")
    var = lambda self, ddof=1: self.reduce("var", ddof)
    std = lambda self, ddof=1: self.reduce("std", ddof)

    def value_counts(self, column: str | None = None) -> DataFrame:
        c = column or self.columns[0]
        return self.df.where(F.col(c).isNotNull()).groupBy(c).count()

    def nlargest(self, n: int, column: str) -> DataFrame:
        return self.df.orderBy(F.desc(column), *self._kept()).limit(n)

    def state(self, *keys: str, start: DataFrame | None = None) -> DataFrame:
        """Partial sums (n, sum, sum of squares of each column) by key: what a later run adds its own rows to."""
        one = []
        for c in self.columns:
            if c not in keys:
                one += [F.count(c).alias(f"{c}_n"), F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_sum"), F.coalesce(F.sum(F.col(c) * F.col(c)), F.lit(0)).alias(f"{c}_sq")]
        now = self.df.groupBy(*keys).agg(*one)
        if start is None:
            return now
        return now.unionByName(start).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in now.columns if c not in keys))

    def reduce_per_batch(self, kind: str, ddof: int = 1) -> DataFrame:
        """(batch, columns) over all rows up to each batch's end, from batch totals: any of ``AGGREGATES``. size has one
        column, rows times columns."""
        if kind not in AGGREGATES:
            raise ValueError(f"one of {AGGREGATES}")
        t = self.df.groupBy(self.batch).agg(F.count("*").alias("_rows"), *(x for c in self.columns for x in totals(c)))
        w = W.orderBy(self.batch).rowsBetween(W.unboundedPreceding, 0)  # a row a batch
        if kind == "size":
            return t.select(self.batch, (F.sum("_rows").over(w) * len(self.columns)).alias("size"))
        return t.select(self.batch, *(merged(kind, c, lambda x: F.sum(x).over(w), ddof).alias(c) for c in self.columns))

    def value_counts_per_batch(self, column: str | None = None) -> DataFrame:
        """(batch, value, count): counts of every value seen so far at each batch's end."""
        c = column or self.columns[0]
        return self.groupby(c).agg_per_batch("size").withColumnRenamed("size", "count")

    def aggregate(self, agg, schema: str, start=None) -> DataFrame:
        """Results of a user aggregation after each batch, as rows of ``schema``.

        ``agg`` has initial(rows) -> state and on_new(state, rows) -> (state, result), on pandas frames; a result is a
        frame, or a value for a schema of one column. States follow one another, so batches are taken one by one, in one
        task: ``Grouped.aggregate`` runs one sequence a key.
        """
        return self.groupby(F.lit(0)).aggregate(agg, schema, start)

    def groupby(self, *keys: str | Column | Series) -> Grouped:
        return Grouped(self, [k.col if isinstance(k, Series) else F.col(k) if isinstance(k, str) else k for k in keys], [k if isinstance(k, str) else k.name if isinstance(k, Series) else f"key{i}" for i, k in enumerate(keys)])

    # Running and windowed

    def _running(self, kind: str) -> FlowFrame:
        if self.df.isStreaming:
            return FlowFrame(lowering.running(self.df, self.seq, {c: (kind, c) for c in self.columns}), "seq")
        made = {f"_{c}": (kind, F.col(c)) for c in self.columns}
        out = ordered.running(self.df, self.seq, **made)
        return self._next(out.select(*self._kept(), *(F.when(F.col(c).isNotNull(), F.col(f"_{c}")).alias(c) for c in self.columns)))

    cumsum = lambda self: self._running("sum")
    cumprod = lambda self: self._running("product")
    cummin = lambda self: self._running("min")
    cummax = lambda self: self._running("max")

    def rolling(self, window: int | str, min_periods: int | None = None, ts: str | None = None) -> Rolling:
        return Rolling(self, window, min_periods, ts or self.index_col)

    def window(self, n: int | str | None = None, value: str | None = None, ts: str | None = None) -> BatchWindow:
        if isinstance(n, str):
            n, value = None, n
        return BatchWindow(self, n, value, ts or self.index_col)

    def expanding(self) -> Expanding:
        return Expanding(self)

    def ewm(self, com: float | None = None, span: float | None = None, halflife: float | None = None, alpha: float | None = None) -> Ewm:
        return Ewm(self, weight(com, span, halflife, alpha))


def totals(c: str) -> list[Column]:
    """Partial sums of a column: number, sum and sum of squares (in double, exact sums stay exact)."""
    x = F.col(c)
    return [F.count(x).alias(f"{c}_n"), F.sum(x).alias(f"{c}_s"), F.sum(x.cast("double") * x.cast("double")).alias(f"{c}_q")]


def merged(kind: str, c: str, add, ddof: int = 1) -> Column:
    """An aggregate from partial sums, which ``add`` adds up."""
    n, s, q = (add(F.col(f"{c}_{x}")) for x in "nsq")
    n, s = F.coalesce(n, F.lit(0)), F.coalesce(s, F.lit(0))
    if kind in ("var", "std"):
        v = F.greatest(variance(n, s.cast("double"), F.coalesce(q, F.lit(0.0)), ddof), F.lit(0.0))
        return F.sqrt(v) if kind == "std" else v
    return {"sum": s, "count": n, "mean": F.try_divide(s.cast("double"), n)}[kind]


def predicate(text: str) -> Column:
    """A predicate in the dataframe library's notation: comparisons (chained too), ``in`` with lists, arithmetic, and, or,
    not, with ``&``, ``|`` and ``~`` for these. Literals are taken as they are."""
    words = {"&": "and", "|": "or", "~": "not"}
    made = [(tokenize.NAME, words[x.string]) if x.type == tokenize.OP and x.string in words else (x.type, x.string) for x in tokenize.generate_tokens(io.StringIO(text.strip()).readline)]
    return _column(ast.parse(tokenize.untokenize(made).strip(), mode="eval").body)


_COMPARE = {ast.Eq: "eq", ast.NotEq: "ne", ast.Lt: "lt", ast.LtE: "le", ast.Gt: "gt", ast.GtE: "ge"}
_ARITHMETIC = {ast.Add: "add", ast.Sub: "sub", ast.Mult: "mul", ast.Div: "truediv", ast.FloorDiv: "floordiv", ast.Mod: "mod", ast.Pow: "pow"}


def _column(e: ast.expr) -> Column:
    if isinstance(e, ast.Name):
        return F.col(f"`{e.id}`")
    if isinstance(e, ast.Constant):
        return F.lit(e.value)
    if isinstance(e, ast.BoolOp):
        return reduce(lambda a, b: a & b if isinstance(e.op, ast.And) else a | b, map(_column, e.values))
    if isinstance(e, ast.UnaryOp):
        x = _column(e.operand)
        return ~x if isinstance(e.op, ast.Not) else -x if isinstance(e.op, ast.USub) else x
    if isinstance(e, ast.BinOp) and type(e.op) in _ARITHMETIC:
        return _BINARY[_ARITHMETIC[type(e.op)]](_column(e.left), _column(e.right))
    if isinstance(e, ast.Compare):
        out, left = [], e.left
        for op, right in zip(e.ops, e.comparators, strict=True):
            if isinstance(op, (ast.In, ast.NotIn)) or isinstance(right, (ast.List, ast.Tuple)):
                some = _column(left).isin(*map(ast.literal_eval, right.elts))
                out.append(~some if isinstance(op, (ast.NotIn, ast.NotEq)) else some)
            else:
                out.append(_BINARY[_COMPARE[type(op)]](_column(left), _column(right)))
            left = right
        return reduce(lambda a, b: a & b, out)
    raise ValueError(f"not understood: {ast.unparse(e)}")


@dataclass
class Expanding:
    """All rows so far: any aggregate, per row of the result a batch, or final."""

    frame: FlowFrame

    def __getattr__(self, name: str):
        if name in AGGREGATES:
            return lambda ddof=1: self.frame.reduce(name, ddof)
        return getattr(self.frame, name)


def weight(com: float | None = None, span: float | None = None, halflife: float | None = None, alpha: float | None = None) -> float:
    """Alpha from exactly one of the four."""
    given = [x for x in (com, span, halflife, alpha) if x is not None]
    if len(given) != 1:
        raise ValueError("give exactly one of com, span, halflife and alpha")
    if com is not None:
        if com < 0:
            raise ValueError("com must be 0 or more")
        return 1 / (1 + com)
    if span is not None:
        if span < 1:
            raise ValueError("span must be 1 or more")
        return 2 / (span + 1)
    if halflife is not None:
        if halflife <= 0:
            raise ValueError("halflife must be above 0")
        return 1 - 0.5 ** (1 / halflife)
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be above 0 and 1 at most")
    return alpha


@dataclass
class Ewm:
    frame: FlowFrame
    alpha: float

    def mean(self, key: str | None = None) -> DataFrame:
        """Final mean of each column (by key); nulls are skipped, without a step in weight.

        Each range of the order is folded on its own, in the JVM, to (sum, weight, number); a key's ranges, in order,
        then give its mean. So no row holds more than a range's values."""
        f, keep = self.frame, F.lit(1 - self.alpha)
        by, columns = [key] if key else [], [c for c in f.columns if c != key]
        zero = F.struct(F.lit(0.0).alias("r"), F.lit(0.0).alias("w"), F.lit(0).cast("long").alias("n"))
        parts, out = [], []
        for c in columns:
            xs = F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col(f.seq).alias("s"), F.col(c).cast("double").alias("x")))))
            parts.append(F.aggregate(xs, zero, lambda a, e: F.struct((a["r"] * keep + e["x"]).alias("r"), (a["w"] * keep + 1).alias("w"), (a["n"] + 1).alias("n"))).alias(c))
            ends = F.array_sort(F.collect_list(F.struct("_range", F.col(c).alias("x"))))
            late = lambda a, e: F.pow(keep, e["x"]["n"])
            step = lambda a, e: F.struct((a["r"] * late(a, e) + e["x"]["r"]).alias("r"), (a["w"] * late(a, e) + e["x"]["w"]).alias("w"), (a["n"] + e["x"]["n"]).alias("n"))
            out.append(F.aggregate(ends, zero, step, lambda a: F.try_divide(a["r"], a["w"])).alias(c))
        return ordered.ranges(f.df, f.seq).groupBy(*by, "_range").agg(*parts).groupBy(*by).agg(*out)

    def mean_per_batch(self) -> DataFrame:
        """(batch, columns): the mean so far at each batch's end. Batches are folded on their own; the carry is a fold over
        a row a batch."""
        f, keep = self.frame, F.lit(1 - self.alpha)
        zero = F.struct(F.lit(0.0).alias("r"), F.lit(0.0).alias("w"), F.lit(0).cast("long").alias("n"))
        parts = []
        for c in f.columns:
            xs = F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col(f.seq).alias("s"), F.col(c).cast("double").alias("x")))))
            parts.append(F.aggregate(xs, zero, lambda a, e: F.struct((a["r"] * keep + e["x"]).alias("r"), (a["w"] * keep + 1).alias("w"), (a["n"] + 1).alias("n"))).alias(c))
        t = f.df.groupBy(f.batch).agg(*parts)  # a row a batch
        names, batch, left = f.columns, f.batch, 1 - self.alpha

        def carry(x):
            x = x.sort_values(batch)
            out = {batch: x[batch]}
            for c in names:
                r = w = 0.0
                got = []
                for e in x[c]:
                    r, w = r * left ** e["n"] + e["r"], w * left ** e["n"] + e["w"]
                    got.append(r / w if w else None)
                out[c] = got
            return type(x)(out)

        return t.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(lambda x: carry(x), f"{batch} {dict(f.df.dtypes)[batch]}, " + ", ".join(f"`{c}` double" for c in names))


@dataclass
class Grouped:
    frame: FlowFrame
    keys: list[Column]
    names: list[str]
    chosen: list[str] | None = None

    def __getitem__(self, columns) -> Grouped:
        return Grouped(self.frame, self.keys, self.names, columns if isinstance(columns, list) else [columns])

    def __getattr__(self, name: str):
        if name in AGGREGATES:
            return lambda ddof=1: self.agg(name, ddof)
        if not name.startswith("_") and name in self.frame.df.columns:
            return self[name]
        raise AttributeError(name)

    def _rows(self) -> DataFrame:
        df = self.frame.df.withColumns({f"_k{i}": k for i, k in enumerate(self.keys)})
        return df.where(" and ".join(f"_k{i} is not null" for i in range(len(self.keys))))

    def _columns(self) -> list[str]:
        return self.chosen or [c for c in self.frame.columns if c not in self.names]

    def agg(self, kind: str, ddof: int = 1) -> DataFrame:
        made = [aggregate(kind, F.col(c), ddof).alias(c) for c in self._columns()] if kind != "size" else [F.count("*").alias("size")]
        return self._rows().groupBy(*(F.col(f"_k{i}").alias(n) for i, n in enumerate(self.names))).agg(*made)

    def agg_per_batch(self, kind: str, ddof: int = 1) -> DataFrame:
        """(batch, keys, columns): an aggregate of every key seen so far at each batch's end; whole-number batches.

        A key has a row from its first batch to the last one, which is the result's size; the grid is made from each
        key's bounds, without a join of keys with batches."""
        f, ks = self.frame, [f"_k{i}" for i in range(len(self.keys))]
        cols = [] if kind == "size" else self._columns()
        t = self._rows().groupBy(f.batch, *ks).agg(F.count("*").alias("_rows"), *(x for c in cols for x in totals(c)))
        last = f.df.agg(F.max(f.batch)).first()[0]
        made = t.groupBy(*ks).agg(F.min(f.batch).alias("_first")).withColumn(f.batch, F.explode(F.sequence(F.col("_first"), F.lit(last).cast(dict(f.df.dtypes)[f.batch])))).drop("_first")
        grid = made.join(f.df.select(f.batch).distinct(), f.batch, "left_semi")
        w = W.partitionBy(*ks).orderBy(f.batch).rowsBetween(W.unboundedPreceding, 0)
        full = grid.join(t, [f.batch, *ks], "left")
        out = [F.sum("_rows").over(w).alias("size")] if kind == "size" else [merged(kind, c, lambda x: F.sum(x).over(w), ddof).alias(c) for c in cols]
        return full.select(f.batch, *(F.col(k).alias(n) for k, n in zip(ks, self.names, strict=True)), *out)

    def sum_per_batch(self) -> DataFrame:
        return self.agg_per_batch("sum")

    def aggregate(self, agg, schema: str, start=None) -> DataFrame:
        """As ``FlowFrame.aggregate``, a sequence of states a key; ``schema`` starts with the batch (and with the keys, if
        named), which the result's rows are given."""
        f, ks = self.frame, [f"_k{i}" for i in range(len(self.keys))]
        batch, seq, names, cols = f.batch, f.seq, list(self.names), self._columns()
        fields = [x.name for x in self.frame.df.sparkSession.createDataFrame([], schema).schema]

        more = [c for c in fields if c != batch and c not in names]

        def run(frames):
            """Rows come by key, batch and order; a task holds those of one Arrow batch and of the batch that is open."""
            state, last, rest = start, None, []
            for frame in frames:
                if not len(frame):
                    continue
                new = (frame[by] != frame[by].shift()).any(axis=1).to_numpy()
                new[0] = not rest or tuple(rest[-1][by].iloc[-1]) != tuple(frame[by].iloc[0])
                at = new.nonzero()[0].tolist()
                if not at:  # all of it belongs to the open batch
                    rest.append(frame)
                    continue
                parts = [*rest, frame.iloc[: at[0]]] if at[0] else rest
                done = [pd.concat(parts) if len(parts) > 1 else parts[0]] if parts else []
                done += [frame.iloc[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
                rest = [frame.iloc[at[-1] :]]
                if done:
                    out, state, last = fold(done, state, last)
                    yield out
            if rest:
                yield fold([pd.concat(rest)], state, last)[0]

        def fold(batches, state, last):
            made, whole = {c: [] for c in fields}, []
            for rows in batches:
                first = {c: rows[c].iat[0] for c in by}
                key = tuple(first[k] for k in ks)
                if key != last:
                    state, last = start, key
                some = rows[cols].reset_index(drop=True)
                state = agg.initial(some.iloc[:0]) if state is None else state
                state, result = agg.on_new(state, some)
                given = {batch: first[batch]} | {n: first[k] for k, n in zip(ks, names, strict=True) if n in fields}
                if hasattr(result, "columns"):
                    whole.append(result.assign(**given))
                    continue
                for c, v in (given | {more[0]: result}).items():
                    made[c].append(v)
            frames = [x[fields] for x in whole] + ([pd.DataFrame(made)] if made[batch] else [])
            return pd.concat(frames) if len(frames) > 1 else frames[0] if frames else pd.DataFrame(made), state, last

        by = [*ks, batch]
        rows = self._rows().select(*dict.fromkeys([*by, seq, *cols]))
        return rows.repartition(*ks).sortWithinPartitions(*by, seq).mapInPandas(lambda x: run(x), schema)


@dataclass
class Rolling:
    """Per-row windows: the last n rows, or (t - T, t]."""

    frame: FlowFrame
    window: int | str
    min_periods: int | None
    ts: str | None

    def agg(self, kind: str, q: float = 0.5) -> FlowFrame:
        f = self.frame
        least = self.min_periods if self.min_periods is not None else self.window if isinstance(self.window, int) else 1
        if f.df.isStreaming:
            cols = [c for c in f.columns if c != self.ts]
            of = {"n": self.window} if isinstance(self.window, int) else {"ts": self.ts, "width": seconds(self.window)}
            return FlowFrame(lowering.rolling(f.df, f.seq, cols, kind, least=least, q=q, **of), "seq")
        if not isinstance(self.window, int) and kind in ordered.MERGED:
            cols = [c for c in f.columns if c != self.ts]
            out = ordered.rolling_time(f.df, self.ts, int(seconds(self.window) * 1e6), kind, cols, least)
            return f._next(out.select(*f._kept(), *(F.col(f"_o_{c}").alias(c) for c in cols)))
        if isinstance(self.window, int):
            rows, own, block = ordered.halo(ordered.position(f.df, f.seq, "_pos"), "_pos", self.window)
            w = W.partitionBy(block).orderBy("_pos").rowsBetween(1 - self.window, 0)
        else:
            width = seconds(self.window)
            rows, own, block = ordered.time_halo(f.df, self.ts, width)
            rows = rows.withColumn("_t", F.unix_micros(F.col(self.ts).cast("timestamp")))
            w = W.partitionBy(block).orderBy("_t").rangeBetween(-(int(width * 1e6) - 1), 0)
        made = {}
        for c in f.columns:
            if c == self.ts:
                continue
            x = F.percentile(F.col(c), q) if kind == "quantile" else aggregate(kind, F.col(c))
            enough = F.count(c).over(w) >= least if kind != "count" else F.count(F.lit(1)).over(w) >= least
            made[c] = F.when(enough, F.sqrt(F.var_samp(c).over(w)) if kind == "std" else (F.sum(c) if kind == "sum" else x).over(w))
        out = rows.withColumns({f"_o_{c}": v for c, v in made.items()}).where(own)
        return f._next(out.select(*f._kept(), *(F.col(f"_o_{c}").alias(c) for c in made)))

    def __getattr__(self, name: str):
        if name in ("sum", "mean", "min", "max", "median", "std", "var", "count"):
            return lambda: self.agg(name)
        if name == "quantile":
            return lambda q: self.agg("quantile", q)
        raise AttributeError(name)


@dataclass
class BatchWindow:
    """Windows at each batch's end: the last n rows, or the last T of time, over all rows."""

    frame: FlowFrame
    n: int | None
    value: str | None
    ts: str | None

    def rows(self) -> DataFrame:
        """Each row once for every batch whose window has it, as ``_w``: by a join on blocks of the order, not a cross join."""
        f = self.frame
        if self.n:
            p = ordered.position(f.df, f.seq, "_p")
            width = self.n
        else:
            width = int(seconds(self.value) * 1e6)
            p = f.df.withColumn("_p", F.unix_micros(F.col(self.ts).cast("timestamp")))
        ends = p.groupBy(f.batch).agg(F.max("_p").alias("_hi")).withColumnRenamed(f.batch, "_w")
        if not self.n:  # an empty or late batch sees the newest time so far
            ends = ends.withColumn("_hi", F.max("_hi").over(W.orderBy("_w").rowsBetween(W.unboundedPreceding, 0)))
        ends = ends.withColumn("_b", F.explode(F.sequence(F.floor((F.col("_hi") - width + 1) / width), F.floor(F.col("_hi") / width))))
        last = f.df.groupBy(f.batch).agg(F.max(f.seq).alias("_last")).withColumnRenamed(f.batch, "_w")
        out = p.withColumn("_b", F.floor(F.col("_p") / width)).join(ends, "_b").where((F.col("_p") > F.col("_hi") - width) & (F.col("_p") <= F.col("_hi")))
        return out.join(last, "_w").where(F.col(f.seq) <= F.col("_last")).drop("_b", "_p", "_hi", "_last")

    full = rows

    def agg(self, kind: str, *keys: str, ddof: int = 1) -> DataFrame:
        """(batch, keys, columns); groups without rows in a window are not there."""
        f = self.frame
        made = [F.count("*").alias("size")] if kind == "size" else [aggregate(kind, F.col(c), ddof).alias(c) for c in f.columns if c not in keys and c != self.ts]
        return self.rows().where(" and ".join(f"{k} is not null" for k in keys) or "true").groupBy(F.col("_w").alias(f.batch), *keys).agg(*made)

    def value_counts(self, column: str) -> DataFrame:
        return self.rows().where(F.col(column).isNotNull()).groupBy(F.col("_w").alias(self.frame.batch), column).count()

    def apply(self, fn, schema: str) -> DataFrame:
        """fn(pandas frame) of each window."""
        return self.rows().groupBy("_w").applyInPandas(fn, schema)


__all__ = ["FlowFrame", "Series", "aggregate", "clean", "weight"]
