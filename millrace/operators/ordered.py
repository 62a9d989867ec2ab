"""Order over a whole table without one task that holds it.

A global window without PARTITION BY runs in one task. Here rows are dealt by ranges of the order column; each range
is numbered or accumulated on its own, and what comes before it is carried in from one small table of range totals.
Frames of bounded length get the rows they need from the range before (a halo). Order columns are taken as unique.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from . import arrays


def ranges(df: DataFrame, seq: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``_range``, an int that grows with ``seq``."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = []
    if parts > 1:
        cuts = df.select(F.percentile_approx(seq, [k / parts for k in range(1, parts)], max(10_000, 10 * parts)).alias("x")).first()["x"] or []
    return df.withColumn("_range", place(F.col(seq), sorted(set(cuts))))


def place(x: Column, cuts: list) -> Column:
    """How many of the sorted bounds are at ``x`` or below."""
    if not cuts:
        return F.lit(0)
    # Two levels, so that a row is compared with about twice the square root of the bounds.
    m = int(len(cuts) ** 0.5) + 1
    groups = [cuts[i : i + m] for i in range(0, len(cuts), m)]
    below = lambda bounds: F.size(F.filter(bounds, lambda b: b <= x))
    k = below(F.array(*(F.lit(g[0]) for g in groups)))
    inner = F.array(*(F.array(*map(F.lit, g)) for g in groups))
    return F.when(k == 0, 0).otherwise((k - 1) * m + below(F.element_at(inner, F.greatest(k, F.lit(1)))))


def position(df: DataFrame, seq: str, name: str = "pos", key: str | None = None) -> DataFrame:
    """``df`` with the 0-based place of each row in the order of ``seq``; of each ``key``'s rows, if one is given."""
    if key:
        return running(df, seq, key, **{name: ("count", F.lit(1))}).withColumn(name, (F.col(name) - 1).cast("long"))
    dealt = ranges(df, seq)
    totals = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = totals.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row a range
    local = F.row_number().over(W.partitionBy("_range").orderBy(seq)) - 1
    return dealt.withColumn(name, local).join(F.broadcast(before), "_range").withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_range", "_before")


_FOLD = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "count": (F.count, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
    "product": (F.product, lambda a, b: F.coalesce(a, F.lit(1.0)) * F.coalesce(b, F.lit(1.0))),
}


def running(df: DataFrame, seq: str, key: str | None = None, **columns: tuple[str, Column | str]) -> DataFrame:
    """``df`` with running aggregates (of each ``key``'s rows, if one is given): name=(kind, column), kind of sum, count,
    min, max, product; nulls are skipped.

    A frequent key's rows are spread over the ranges too. Totals carried in are a row a range, which is broadcast, or a
    row a range and key, which is joined.
    """
    dealt = ranges(df, seq)
    by = ["_range"]
    if key:  # a null key is a key of its own
        by, dealt = ["_range", "_key", "_none"], dealt.withColumn("_key", F.col(key)).withColumn("_none", F.col(key).isNull())
    w = W.partitionBy(*by).orderBy(seq).rowsBetween(W.unboundedPreceding, 0)
    totals = dealt.groupBy(*by).agg(*(_FOLD[k][0](c).alias(f"_t_{n}") for n, (k, c) in columns.items()))
    over = W.partitionBy(*by[1:]).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    outer = {"count": F.sum}
    carried = totals.select(*by, *(outer.get(k, _FOLD[k][0])(f"_t_{n}").over(over).alias(f"_c_{n}") for n, (k, _) in columns.items()))
    local = dealt.select("*", *(_FOLD[k][0](c).over(w).alias(f"_l_{n}") for n, (k, c) in columns.items()))
    if key:
        there = carried.select(F.col("_range").alias("_r"), F.col("_key").alias("_k"), *(f"_c_{n}" for n in columns))
        out = local.join(there, (F.col("_range") == F.col("_r")) & F.col("_key").eqNullSafe(F.col("_k"))).drop("_r", "_k", "_key", "_none")
    else:
        out = local.join(F.broadcast(carried), "_range")  # a row a range
    out = out.withColumns({n: _FOLD[k][1](F.col(f"_l_{n}"), F.col(f"_c_{n}")) for n, (k, _) in columns.items()})
    return out.drop("_range", *(f"_{x}_{n}" for n in columns for x in "lc"))


def halo(df: DataFrame, pos: str, n: int, block: int | None = None) -> tuple[DataFrame, Column, str]:
    """Rows in blocks of places, each with the ``n`` - 1 rows before it: (rows, which are the block's own, block column)."""
    block = block or max(8 * n, 50_000)
    own = F.floor(F.col(pos) / block)
    both = F.when((F.pmod(F.col(pos), F.lit(block)) > block - n), F.array(own, own + 1)).otherwise(F.array(own))
    rows = df.withColumn("_block", F.explode(both))
    return rows, F.col("_block") == own, "_block"


def time_halo(df: DataFrame, ts: str, width: float) -> tuple[DataFrame, Column, str]:
    """As ``halo`` for frames of ``width`` seconds before a row's time."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    block = int(max(8 * width, 86_400) * 1e6)
    own = F.floor(micros / block)
    both = F.when(F.pmod(micros, F.lit(block)) >= block - int(width * 1e6), F.array(own, own + 1)).otherwise(F.array(own))
    rows = df.withColumn("_block", F.explode(both))
    return rows, F.col("_block") == own, "_block"


#: Rows a range of time, so that a task's share does not grow with the table, and ranges at most.
SHARE, RANGES = 100_000, 2_000
#: Aggregates of a window that are made from aggregates of its parts.
MERGED = ("sum", "mean", "min", "max", "var", "std", "count")


def _part(kind: str, c: str) -> dict[str, Column]:
    """What is kept of a column's rows, to be merged with others."""
    x, double = F.col(c), F.col(c).cast("double")
    return {"n": F.count(x)} | {
        "sum": lambda: {"s": F.sum(x)},
        "mean": lambda: {"s": F.sum(x)},
        "min": lambda: {"e": F.min(x)},
        "max": lambda: {"e": F.max(x)},
        "var": lambda: {"m": F.avg(double), "q": F.var_pop(double) * F.count(x)},
        "count": dict,
    }["var" if kind == "std" else kind]()


def rolling_time(df: DataFrame, ts: str, width: int, kind: str, columns: list[str], least: int) -> DataFrame:
    """``df`` with _o_{c}, an aggregate of a column over the rows with times in (t - width, t], in microseconds.

    A result depends on a row's time only, so rows of one time are merged first. Times are dealt by ranges, of as many
    comings and goings (a time goes when ``width`` is over). A range has its own times, those that go within it, and, already
    merged, those that come before and go after it: each time is sent twice at most, however many a window has.
    """
    rows = df.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    both = rows.select(F.explode(F.array("_t", F.col("_t") + width)).alias("x"))
    seen = both.agg(F.count("x").alias("n"), F.percentile_approx("x", [k / RANGES for k in range(1, RANGES)], 10 * RANGES).alias("x")).first()
    parts = min(max(seen["n"] // (2 * SHARE), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), RANGES)
    cuts = sorted({seen["x"][k * RANGES // parts - 1] for k in range(1, parts)}) if seen["x"] else []
    made = {f"_{p}_{k}": x for k, c in enumerate(columns) for p, x in _part(kind, c).items()} | {"_rows": F.count(F.lit(1))}
    kept = [F.col(f"`{c}`") for c in made]
    comes, goes = place(F.col("_t"), cuts), place(F.col("_t") + width, cuts)
    some = rows.groupBy("_t").agg(*(x.alias(c) for c, x in made.items())).withColumns({"_in": comes, "_out": goes})
    where = F.array_distinct(F.array("_in", "_out"))
    near = some.select(F.explode(where).alias("_range"), "_in", "_t", *kept).withColumn("_own", F.col("_in") == F.col("_range")).drop("_in")
    over = rows.withColumns({"_in": comes, "_out": goes}).where(F.col("_out") > F.col("_in") + 1).groupBy("_in", "_out").agg(F.max("_t").alias("_t"), *(x.alias(c) for c, x in made.items()))
    far = over.select(F.explode(F.sequence(F.col("_in") + 1, F.col("_out") - 1)).alias("_range"), "_t", *kept, F.lit(False).alias("_own"))
    types = {c: f"decimal({min(f.dataType.precision + 10, 38)},{f.dataType.scale})" if kind == "sum" and (f := df.schema[c]).dataType.typeName() == "decimal" else None for c in columns}
    kinds = dict(some.dtypes)
    out = {c: "bigint" if kind == "count" else "double" if kind in ("mean", "var", "std") else types[c] or kinds[f"_{'s' if kind == 'sum' else 'e'}_{k}"] for k, c in enumerate(columns)}
    schema = _parse_datatype_string(", ".join(["_at bigint", *(f"_o_{k} {t}" for k, t in enumerate(out.values()))]))
    results = to_arrow_schema(schema)

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by("_t")  # no time: last
        times = arrays.column(t, "_t")
        n = len(times) - times.null_count
        at = times.slice(0, n).to_numpy(zero_copy_only=False)
        own = arrays.column(t, "_own").to_numpy(zero_copy_only=False)
        mine, rest = np.flatnonzero(own[:n]), np.arange(n, len(times))
        lo, hi = np.searchsorted(at, at[mine] - width, "right"), mine + 1
        lo, hi = np.concatenate([lo, rest]), np.concatenate([hi, rest + 1])
        got = [arrays.aggregate(kind, arrays.parts_of(t, k), lo, hi, least, results.field(k + 1).type) for k in range(len(columns))]
        return pa.table([times.take(pa.array(np.concatenate([mine, rest]), pa.int64())), *got], schema=results)

    found = near.unionByName(far).groupBy("_range").applyInArrow(lambda t: run(t), schema)
    out = rows.join(found, F.col("_t").eqNullSafe(F.col("_at"))).drop("_t", "_at")
    return out.withColumnsRenamed({f"_o_{k}": f"_o_{c}" for k, c in enumerate(columns)})
