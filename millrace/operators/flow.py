"""Event flows: ordered sequences of rows, with the event-stream combinators as DataFrame operations.

A flow is a DataFrame with an order column ``seq`` (unique), an optional ``key`` and an optional ``batch`` column.
Every method returns a new flow. Order-sensitive combinators number a table's rows by ranges, so no task holds the whole
of it; to place the ranges they look up quantiles of the order column when they are called. On a stream they run as
stateful steps (``millrace.streaming``), one sequence a key; the rest runs nothing until a sink.
"""

from __future__ import annotations

import asyncio
import logging
import warnings
from collections.abc import Callable, Iterator
from functools import reduce
from importlib.metadata import entry_points
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import seconds, truthy
from ..streaming import chunks, lowering
from . import ordered, steps


class Flow:
    def __init__(self, df: DataFrame, seq: str = "seq", key: str | None = None, batch: str | None = None, name: str = "source", upstreams: tuple[Flow, ...] = (), trigger: dict[str, Any] | None = None):
        self.df, self.seq, self.key, self.batch, self.name, self.upstreams, self.trigger = df, seq, key, batch, name, upstreams, trigger

    def __repr__(self) -> str:
        return f"<{self.name}: {', '.join(f'{c} {t}' for c, t in self.df.dtypes)}>"

    def _next(self, df: DataFrame, name: str, *others: Flow, **changed: Any) -> Flow:
        return type(self)(df, **{"seq": self.seq, "key": self.key, "batch": self.batch, "trigger": self.trigger} | changed, name=name, upstreams=(self, *others))

    # Registry of operators

    @classmethod
    def register_api(cls, modifier: Callable = lambda f: f, attribute_name: str | None = None):
        """Decorator: make a function or class an operator of flows."""

        def put(fn):
            setattr(cls, attribute_name or fn.__name__, modifier(fn))
            return fn

        return put

    @classmethod
    def load_plugins(cls, group: str = "millrace.operators") -> None:
        """Operators of installed packages, imported at first use. A name that exists is kept, with a warning."""
        for ep in entry_points(group=group):
            if hasattr(cls, ep.name):
                warnings.warn(f"operator {ep.name} exists; {ep.value} is ignored", stacklevel=2)
                continue
            setattr(cls, ep.name, lambda self, *a, _ep=ep, **k: _ep.load()(self, *a, **k))

    @property
    def upstream(self) -> Flow | None:
        if len(self.upstreams) > 1:
            raise ValueError("a flow of several upstreams has no single one")
        return self.upstreams[0] if self.upstreams else None

    def connect(self, other: Flow) -> Flow:
        return self.union(other)

    def disconnect(self, other: Flow) -> Flow:
        """The union this flow is, without one of its upstreams. A query that runs keeps its graph: start a new one."""
        left = [u for u in self.upstreams if u is not other]
        if len(left) == len(self.upstreams) or not left:
            raise ValueError("not an upstream, or the only one")
        return left[0].union(*left[1:]) if len(left) > 1 else left[0]

    # Elementwise

    def transform(self, fn: Callable[..., DataFrame], *args, **kwargs) -> Flow:
        return self._next(fn(self.df, *args, **kwargs), "transform")

    def _kept(self, columns: dict[str, Column]) -> list[Column]:
        return [F.col(c) for c in dict.fromkeys((self.seq, self.key, self.batch)) if c and c not in columns]

    def map(self, **columns: Column | str) -> Flow:
        """New columns from expressions; order, key and batch columns stay."""
        made = {n: F.expr(c) if isinstance(c, str) else c for n, c in columns.items()}
        return self._next(self.df.select(*self._kept(made), *(c.alias(n) for n, c in made.items())), "map")

    starmap = map

    def map_python(self, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> Flow:
        return self._next(self.df.mapInPandas(lambda it: (fn(x) for x in it), schema), "map_python")

    def map_async(self, fn: Callable, column: str, result: str, parallelism: int = 8, on_error: str = "drop") -> Flow:
        """An awaitable function of one column, so many at once in each task; order stays. A failing element is left
        out, or stops the query with ``on_error='raise'``."""
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.df.schema) + f", result {result}"

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            async def every(values):
                gate = asyncio.Semaphore(parallelism)

                async def one(x):
                    async with gate:
                        try:
                            return True, await fn(x)
                        except Exception:
                            if on_error == "raise":
                                raise
                            logging.getLogger(__name__).exception("an element failed and is left out")
                            return False, None

                return await asyncio.gather(*(one(x) for x in values))

            for frame in frames:
                got = asyncio.run(every(frame[column]))
                good = [ok for ok, _ in got]
                yield frame[good].assign(result=[r for ok, r in got if ok])

        return self._next(self.df.mapInPandas(run, schema), "map_async")

    def filter(self, predicate: Column | str | None = None, column: str = "value") -> Flow:
        """Rows for which the predicate holds (null: not); without one, those whose ``column`` is truthy."""
        if predicate is None:
            predicate = truthy(F.col(column), dict(self.df.dtypes)[column])
        return self._next(self.df.filter(predicate), "filter")

    def remove(self, predicate: Column | str) -> Flow:
        p = F.expr(predicate) if isinstance(predicate, str) else predicate
        return self._next(self.df.filter(~F.coalesce(p, F.lit(False))), "remove")

    def pluck(self, pick: str | int | list, column: str = "value", name: str = "value") -> Flow:
        """An item of a struct, map, array or JSON text; of a list of picks, a struct of them."""
        kind = dict(self.df.dtypes)[column]

        def one(p) -> Column:
            if kind == "string":
                return F.get_json_object(column, f"$.{p}" if isinstance(p, str) else f"$[{p}]")
            return F.col(column)[p] if isinstance(p, int) else F.col(column).getItem(p)

        return self.map(**{name: F.struct(*(one(p).alias(f"_{k}") for k, p in enumerate(pick))) if isinstance(pick, list) else one(pick)})

    def flatten(self, column: str = "value", name: str = "value") -> Flow:
        """A row an array element, in order; (seq, pos) is the new order."""
        rest = [c for c in self.df.columns if c != column]
        return self._next(self.df.select(*rest, F.posexplode(column).alias("pos", name)), "flatten")

    concat = flatten

    def union(self, *others: Flow) -> Flow:
        return self._next(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (o.df for o in others), self.df), "union", *others)

    # Folds

    def accumulate(self, fn: Callable | str, column: str = "value", start: Any = steps.EMPTY, result: str = "double", name: str = "result", **options: bool) -> Flow:
        """Running fold, a result a row. ``fn`` of sum, min, max, count, product runs as a prefix scan (by ``key`` as a
        window); a function of (state, element) runs row by row, by key."""
        if isinstance(fn, str):
            return self.running(**{name: (fn, column)})
        return self.steps(steps.accumulate(fn, start, **options), column, result)

    scan = accumulate

    def running(self, **columns: tuple[str, str]) -> Flow:
        """Several running folds (kind, column) in one pass, by key, if there is one."""
        if self.df.isStreaming:
            return self._next(lowering.running(self.df, self.seq, columns, self.key), "accumulate", seq="seq", batch=None)
        return self._next(ordered.running(self.df, self.seq, self.key, **{n: (k, F.col(c)) for n, (k, c) in columns.items()}), "accumulate")

    def steps(self, step: steps.Step, column: str | None = "value", result: str = "double") -> Flow:
        """Any step function, on a table or, with a key, on a stream."""
        value = (lambda row: row[column]) if column else (lambda row: row)
        if self.df.isStreaming:
            df = lowering.sequence(self.df, self.seq, step, result, value, self.key)
        else:
            df = steps.run_bounded(self.df, self.seq, step, result, value, self.key)
        return self._next(df, "steps", seq="seq", batch=None)

    def frequencies(self, column: str = "value", running: bool = False) -> Flow:
        """Counts of each value; running: the count so far of each row's value."""
        if running:
            if self.df.isStreaming:
                return self._next(lowering.running(self.df, self.seq, {"count": ("count", self.seq)}, column), "frequencies", seq="seq", batch=None)
            return self._next(ordered.running(self.df, self.seq, column, count=("count", F.lit(1))), "frequencies")
        return self._next(self.df.groupBy(column).count(), "frequencies")

    # Windows of events

    def slice(self, start: int | None = None, end: int | None = None, step: int | None = None) -> Flow:
        """Rows by place. The step counts from place 0, not from ``start``; an ``end`` of 0 gives nothing."""
        if any(x is not None and x < 0 for x in (start, end, step)):
            raise ValueError("places can't be negative")
        if self.df.isStreaming:
            return self._next(lowering.whole_rows(self.df, self.seq, chunks.taken(start or 0, end, step), self.key), "slice")
        p = ordered.position(self.df, self.seq, "_pos")
        keep = F.col("_pos") >= (start or 0)
        if end is not None:
            keep &= F.col("_pos") < end
        if step:
            keep &= F.col("_pos") % step == 0
        return self._next(p.where(keep).drop("_pos"), "slice")

    def partition(self, n: int, column: str = "value", keep_partial: bool = False) -> Flow:
        """Arrays of n consecutive elements (by key, if there is one); the tail is left out unless ``keep_partial``."""
        if self.df.isStreaming:
            if keep_partial:
                raise ValueError("a stream has no last part")
            return self._next(lowering.partition(self.df, self.seq, column, n, self.key), "partition", seq="seq", batch=None)
        p = ordered.position(self.df, self.seq, "_pos", self.key).withColumn("part", F.floor(F.col("_pos") / n))
        keys = [self.key] if self.key else []
        g = p.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct(F.col(self.seq).alias("s"), F.col(column).alias("v")))).alias("_x"))
        if not keep_partial:
            g = g.where(F.size("_x") == n)
        return self._next(g.select(*keys, "part", F.element_at("_x", -1)["s"].alias(self.seq), F.transform("_x", lambda x: x["v"]).alias("values")), "partition")

    def partition_unique(self, n: int, column: str = "value", keep: str = "first", kind: str = "bigint") -> Flow:
        return self.steps(steps.partition_unique(n, keep=keep), column, f"array<{kind}>")

    def sliding_window(self, n: int, column: str = "value", return_partial: bool = True) -> Flow:
        """Array of the last n elements at each row."""
        if self.df.isStreaming:
            return self._next(lowering.sliding_window(self.df, self.seq, column, n, return_partial, self.key), "sliding_window", seq="seq", batch=None)
        if self.key:
            rows, own, parts = self.df, F.lit(True), [self.key]
        else:
            rows, own, block = ordered.halo(ordered.position(self.df, self.seq, "_pos"), "_pos", n)
            parts = [block]
        w = W.partitionBy(*parts).orderBy(self.seq).rowsBetween(1 - n, 0)
        out = rows.withColumn("values", F.collect_list(F.struct(F.col(column).alias("v"))).over(w)).where(own).drop("_block", "_pos")
        out = out.withColumn("values", F.transform("values", lambda x: x["v"]))
        return self._next(out if return_partial else out.where(F.size("values") == n), "sliding_window")

    def timed_window(self, interval: str, ts: str = "ts", column: str = "value", emit_empty: bool = False) -> Flow:
        """Array of each interval's elements, in order; intervals without any give empty arrays on demand."""
        width = int(seconds(interval) * 1e6)
        micros = F.unix_micros(F.col(ts).cast("timestamp"))
        rows = self.df.withColumn("window", F.floor(micros / width))
        g = rows.groupBy("window").agg(F.array_sort(F.collect_list(F.struct(F.col(self.seq).alias("s"), F.col(column).alias("v")))).alias("_x"))
        g = g.select("window", F.transform("_x", lambda x: x["v"]).alias("values"))
        if emit_empty:
            ends = g.agg(F.min("window").alias("a"), F.max("window").alias("b"))
            g = ends.where("a is not null").select(F.explode(F.sequence("a", "b")).alias("window")).join(g, "window", "left").withColumn("values", F.coalesce("values", F.array()))
        return self._next(g.withColumn("start", F.timestamp_micros(F.col("window") * width)), "timed_window", seq="window", batch=None)

    def timed_window_unique(self, interval: str, ts: str = "ts", column: str = "value", keep: str = "first") -> Flow:
        """As timed_window, an element a distinct value, in the order of first (or last) appearance."""
        width = int(seconds(interval) * 1e6)
        rows = self.df.withColumn("window", F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / width))
        pick = F.min if keep == "first" else F.max
        one = rows.groupBy("window", column).agg(pick(self.seq).alias("_s"))
        g = one.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("_s", F.col(column).alias("v")))).alias("_x"))
        return self._next(g.select("window", F.transform("_x", lambda x: x["v"]).alias("values")), "timed_window_unique", seq="window", batch=None)

    def delay(self, interval: str, ts: str = "ts") -> Flow:
        """Event times moved by the interval; rows and order stay."""
        return self._next(self.df.withColumn(ts, F.col(ts) + F.expr(f"interval {int(seconds(interval) * 1e6)} microseconds")), "delay")

    def rate_limit(self, interval: str) -> Flow:
        """Pace of the query that a sink starts: a trigger each interval."""
        return self._next(self.df, "rate_limit", trigger={"processingTime": f"{seconds(interval)} seconds"})

    def buffer(self, n: int | None = None) -> Flow:
        """Nothing to do: sources replay from offsets."""
        return self._next(self.df, "buffer")

    def scatter(self, n: int | None = None) -> Flow:
        return self._next(self.df.repartition(n) if n else self.df, "scatter")

    def gather(self) -> Flow:
        return self

    # Combinations

    def zip(self, *others: Flow | Any, column: str = "value") -> Flow:
        """Tuples by position, as columns _0, _1, ...; what is not a flow is a constant at its place."""
        flows = [(k, o) for k, o in enumerate((self, *others)) if isinstance(o, Flow)]
        if self.df.isStreaming:
            fixed = {k: o for k, o in enumerate((self, *others)) if not isinstance(o, Flow)}
            return self._next(lowering.zipped([(k, o.df, o.seq) for k, o in flows], fixed, column), "zip", *(o for _, o in flows[1:]), seq="seq", key=None, batch=None)
        sides = [ordered.position(o.df.select(o.seq, F.col(column).alias(f"_{k}")), o.seq, "pos").select("pos", f"_{k}") for k, o in flows]
        out = reduce(lambda a, b: a.join(b, "pos"), sides)
        made = {k: F.col(f"_{k}") for k, _ in flows} | {k: F.lit(o) for k, o in enumerate((self, *others)) if not isinstance(o, Flow)}
        return self._next(out.select("pos", *(made[k].alias(f"_{k}") for k in sorted(made))), "zip", *(o for _, o in flows[1:]), seq="pos", key=None, batch=None)

    def _tagged(self, others: tuple[Flow, ...], column: str) -> DataFrame:
        every = (self, *others)
        kinds = [o.df.select(F.struct(F.col(column).alias("v")).alias("x")).schema["x"].dataType for o in every]
        rows = [
            o.df.select(
                F.col(o.seq).alias("seq"),
                F.lit(k).alias("side"),
                *((F.struct(F.col(column).alias("v")) if j == k else F.lit(None).cast(kinds[j])).alias(f"_{j}") for j in range(len(every))),
            )
            for k, o in enumerate(every)
        ]
        return reduce(DataFrame.unionAll, rows)

    def _latest(self, rows: DataFrame, n: int, order: str) -> DataFrame:
        """Last value so far of each side, carried over ranges of the order."""
        dealt = ordered.ranges(rows, order)
        w = W.partitionBy("_range").orderBy(order, "side").rowsBetween(W.unboundedPreceding, 0)
        ends = dealt.groupBy("_range").agg(*(F.max_by(f"_{k}", F.when(F.col(f"_{k}").isNotNull(), F.struct(order, "side"))).alias(f"_e{k}") for k in range(n)))
        over = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
        before = ends.select("_range", *(F.last(f"_e{k}", ignorenulls=True).over(over).alias(f"_b{k}") for k in range(n)))
        out = dealt.select("_range", order, "side", "seq" if order != "seq" else F.lit(None).alias("_"), *(F.last(f"_{k}", ignorenulls=True).over(w).alias(f"_{k}") for k in range(n)))
        return out.join(F.broadcast(before), "_range").withColumns({f"_{k}": F.coalesce(f"_{k}", f"_b{k}") for k in range(n)})

    def combine_latest(self, *others: Flow, emit_on: int | list[int] | None = None, column: str = "value") -> Flow:
        """Latest of each side at every element, or at those of the sides ``emit_on``, once all sides have one."""
        n = len(others) + 1
        if emit_on is not None and not isinstance(emit_on, list):
            emit_on = [emit_on]
        if self.df.isStreaming:
            sides = [(o.df, o.seq) for o in (self, *others)]
            return self._next(lowering.latest(sides, lambda values: chunks.combine_latest(values, emit_on), column), "combine_latest", *others, seq="seq", key=None, batch=None)
        out = self._latest(self._tagged(others, column), n, "seq")
        out = out.where(reduce(lambda a, b: a & b, (F.col(f"_{k}").isNotNull() for k in range(n))))
        if emit_on is not None:
            out = out.where(F.col("side").isin(emit_on))
        return self._next(out.select("seq", *(F.col(f"_{k}.v").alias(f"_{k}") for k in range(n))), "combine_latest", *others, seq="seq", key=None, batch=None)

    def zip_latest(self, *others: Flow, column: str = "value") -> Flow:
        """Every element of this flow once, with the others' latest; early ones wait until all others have a value."""
        n = len(others) + 1
        if self.df.isStreaming:
            sides = [(o.df, o.seq) for o in (self, *others)]
            return self._next(lowering.latest(sides, chunks.zip_latest, column), "zip_latest", *others, seq="seq", key=None, batch=None)
        firsts = [o.df.agg(F.min(o.seq).alias("m")).first()["m"] for o in others]
        rows = self._tagged(others, column)
        if any(m is None for m in firsts):
            return self._next(rows.limit(0).select("seq", *(F.col(f"_{k}.v").alias(f"_{k}") for k in range(n))), "zip_latest", *others, seq="seq", key=None, batch=None)
        ready = max(firsts)
        own, rest = F.col("side") == 0, F.col("side") > 0
        later = self._latest(rows.where(rest | (F.col("seq") > ready)), n, "seq").where(own)
        # Early elements all meet the values of one moment: a single row, broadcast, so that they are not one hot key.
        then = rows.where(rest & (F.col("seq") <= ready)).groupBy(F.lit(1).alias("_at")).agg(*(F.max_by(f"_{k}", F.when(F.col("side") == k, F.col("seq"))).alias(f"_{k}") for k in range(1, n)))
        early = rows.where(own & (F.col("seq") <= ready)).select("seq", "_0", F.lit(1).alias("_at")).join(F.broadcast(then), "_at")
        out = later.select("seq", *(f"_{k}" for k in range(n))).unionByName(early.drop("_at"))
        return self._next(out.select("seq", *(F.col(f"_{k}.v").alias(f"_{k}") for k in range(n))), "zip_latest", *others, seq="seq", key=None, batch=None)

    # Distinct, collect, latest

    def unique(self, column: str = "value", maxsize: int | None = None) -> Flow:
        """First row of each value; with ``maxsize`` of 1, rows that differ from the one before; else an LRU of that size."""
        if self.df.isStreaming and maxsize is None:
            return self._next(self.df.dropDuplicates([column]), "unique")
        if maxsize is None:
            first = self.df.groupBy(column).agg(F.min(F.struct(self.seq, *(c for c in self.df.columns if c not in (self.seq, column)))).alias("_r"))
            return self._next(first.select(F.col(column), "_r.*").select(*self.df.columns), "unique")
        if maxsize == 1:
            rows, own, block = ordered.halo(ordered.position(self.df, self.seq, "_pos"), "_pos", 2)
            w = W.partitionBy(block).orderBy(self.seq)
            out = rows.withColumn("_same", F.col(column).eqNullSafe(F.lag(column).over(w)) & (F.col("_pos") > 0)).where(own & ~F.col("_same"))
            return self._next(out.drop("_same", "_block", "_pos"), "unique")
        return self.steps(steps.unique(maxsize), column, dict(self.df.dtypes)[column])

    def collect(self, flush: Column, column: str = "value") -> Flow:
        """Arrays of what came since the last flush; rows for which ``flush`` holds are the flushes and give no element."""
        if self.df.isStreaming:
            df = self.df.withColumn("_f", F.coalesce(flush, F.lit(False)))
            return self._next(lowering.collect(df, self.seq, "_f", column, self.key), "collect", seq="seq", batch=None)
        marked = self.df.withColumn("_f", F.coalesce(flush, F.lit(False)).cast("long"))
        epochs = ordered.running(marked, self.seq, _epoch=("sum", F.col("_f"))).withColumn("epoch", F.col("_epoch") - F.col("_f"))
        g = epochs.groupBy("epoch").agg(
            F.max(F.when(F.col("_f") == 1, F.col(self.seq))).alias(self.seq),
            F.array_sort(F.collect_list(F.when(F.col("_f") == 0, F.struct(F.col(self.seq).alias("s"), F.col(column).alias("v"))))).alias("_x"),
        )
        return self._next(g.where(F.col(self.seq).isNotNull()).select("epoch", self.seq, F.transform("_x", lambda x: x["v"]).alias("values")), "collect")

    def latest(self, column: str = "value") -> Flow:
        """Newest element of each batch."""
        return self._next(self.df.groupBy(self.batch).agg(F.max_by(column, self.seq).alias(column), F.max(self.seq).alias(self.seq)), "latest")

    # Views and sinks

    def to_batch(self, size: int) -> Flow:
        p = ordered.position(self.df, self.seq, "_pos")
        return self._next(p.withColumn("batch_id", F.floor(F.col("_pos") / size)).drop("_pos"), "to_batch", batch="batch_id")

    def to_frame(self, schema: str | None = None, column: str = "value"):
        """A frame of the columns, or of JSON texts in ``column`` with the given schema."""
        from .frame import FlowFrame

        df = self.df.select(*self._kept({}), F.from_json(column, schema).alias("r")).select(*self._kept({}), "r.*") if schema else self.df
        return FlowFrame(df, self.seq, batch=self.batch)

    def sink(self, fn: Callable[[DataFrame, int], None], **options: str):
        """Call fn(frame, id) for each micro-batch of a stream, or once."""
        if not self.df.isStreaming:
            return fn(self.df, 0)
        return self.df.writeStream.options(**options).trigger(**(self.trigger or {"availableNow": True})).foreachBatch(fn).start()

    def sink_to_list(self, column: str = "value") -> list:
        return [r[0] for r in self.df.orderBy(self.seq).select(column).collect()]

    def sink_to_textfile(self, path: str, column: str = "value", prefix: str = "", end: str = "\n", mode: str = "append", **options: str):
        """Texts with the prefix before and ``end`` after each."""
        out = self.df.select(F.concat(F.lit(prefix), F.col(column).cast("string")).alias("value"))
        if self.df.isStreaming:
            return out.writeStream.format("text").option("lineSep", end).options(**options).trigger(**(self.trigger or {"availableNow": True})).start(path)
        return out.write.mode(mode).option("lineSep", end).text(path)

    def current_value(self, column: str = "value") -> Any:
        return self.df.agg(F.max_by(column, self.seq)).first()[0]

    def visualize(self) -> str:
        from ..plans.graph import dot

        return dot(self)
