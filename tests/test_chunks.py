"""Stream operators chunk by chunk: results by brute force, and memory that does not grow with the micro-batch."""

import pickle
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from millrace.streaming import chunks


class State:
    def __init__(self):
        self.data = None

    def exists(self):
        return self.data is not None

    def get(self):
        return self.data

    def update(self, data):
        self.data = data


class Handle:
    def __init__(self):
        self.state = State()

    def getValueState(self, *_):
        return self.state


def run(operator, batches, size):
    """Results of micro-batches, each a table in order; chunks of ``size`` rows come in any order. And the most bytes held."""
    handle, out, most = Handle(), [], 0
    for t in batches:
        p = chunks.processor(operator)
        p.init(handle)
        places = list(range(0, t.num_rows, size))
        random.Random(0).shuffle(places)
        frames = (pd.DataFrame({"first": [t["seq"][a].as_py()], "nth": [0], "data": [chunks._bytes(t.slice(a, size))]}) for a in places)
        before = pa.total_allocated_bytes()
        for frame in p.handleInputRows((0,), frames, None):
            most = max(most, pa.total_allocated_bytes() - before)
            out += pa.ipc.open_stream(frame["data"][0]).read_all().to_pylist()
    assert isinstance(pickle.loads(handle.state.data[0]), object)
    return out, most


def table(n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(-500, 500, n)
    return pa.table({
        "seq": pa.array(np.arange(n)),
        "x": pa.array([None if v % 11 == 3 else v / 4 for v in x.tolist()], pa.float64()),
        "n": pa.array(x),
        "t": pa.array(np.sort(rng.integers(0, n // 3, n)) * 10),
        "side": pa.array(rng.integers(0, 2, n), pa.int32()),
        "f": pa.array(x % 5 == 0),
    })


def rolling(kind, rows):
    def want(r):
        for k, row in enumerate(r):
            some = [y["x"] for y in r[max(0, k - 6) : k + 1]]
            yield {"seq": row["seq"], "x": None if k < 6 else kind(some)}

    return list(want(rows))


def timed(rows):
    got = []
    for row in rows:
        some = [y["x"] for y in rows if row["t"] - 300 < y["t"] <= row["t"] and y["x"] is not None]
        got.append({"seq": row["seq"], "x": sum(some) / len(some) if some else None})
    return got


def check(operator, want, cut=1, size=50):
    """As one micro-batch and as two; ``want`` is a function of the rows."""
    t = table(1500)
    rows = t.to_pylist()
    for batches in ([t], [t.slice(0, 700), t.slice(700)]) if cut else ([t],):
        got = run(operator, batches, size)[0]
        made = want(rows)
        assert len(got) == len(made)
        for a, b in zip(sorted(got, key=lambda r: r["seq"]), made, strict=True):
            assert a.keys() == b.keys()
            for c in a:
                assert a[c] == (pytest.approx(b[c]) if isinstance(b[c], float) else b[c])


def flat(operator):
    """Ten times the rows, the same memory but for a tenth."""
    small, large = (run(operator, [table(n)], 1000)[1] for n in (20_000, 200_000))
    assert large < small * 1.1 + 100_000


def test_rolling_time():
    op = chunks.rolling({"x": "x"}, "mean", pa.float64(), ["seq"], ts="t", width=300)
    check(op, timed, cut=0)
    flat(op)


def test_stream_by_time_equals_table(spark, tmp_path):
    """Times that do not follow the order, and times of several rows: as the table has it."""
    from pyspark.sql import functions as F

    from millrace.operators.frame import FlowFrame
    from millrace.streaming.sinks import drained

    df = spark.range(200).select(F.col("id").alias("seq"), F.timestamp_seconds(F.col("id") * 37 % 50 * 600).alias("ts"), (F.col("id") % 7).cast("double").alias("x"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = FlowFrame(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "seq").rolling("2h", ts="ts").mean()
    rows = lambda d: sorted((r.seq, round(r.x, 9)) for r in d.select("seq", "x").collect())
    assert rows(drained(live.df)) == rows(FlowFrame(df, "seq").rolling("2h", ts="ts").mean().df)


def of_last(rows, i, kind):
    s = pd.Series([y["x"] for y in rows[max(0, i - 6) : i + 1]], dtype=float)
    got = getattr(s, kind)() if s.count() else 0 if kind == "count" else None
    return int(got) if kind == "count" else None if got is None or got != got else float(got)


def test_rolling_n_var():
    op = chunks.rolling({"x": "x"}, "var", pa.float64() if "var" != "count" else pa.int64(), ["seq"], n=7, least=1)
    check(op, lambda rows: [{"seq": r["seq"], "x": of_last(rows, i, "var")} for i, r in enumerate(rows)])
    flat(op)


def test_running_sum():
    op = chunks.running({"n": ("sum", "n")}, ["seq"])
    check(op, lambda rows: [{"seq": r["seq"], "n": int(v)} for r, v in zip(rows, pd.Series([r["n"] for r in rows]).cumsum(), strict=True)])
    flat(op)


def test_rolling_n_sum():
    op = chunks.rolling({"x": "x"}, "sum", pa.float64() if "sum" != "count" else pa.int64(), ["seq"], n=7, least=1)
    check(op, lambda rows: [{"seq": r["seq"], "x": of_last(rows, i, "sum")} for i, r in enumerate(rows)])
    flat(op)


def test_running_min():
    op = chunks.running({"n": ("min", "n")}, ["seq"])
    check(op, lambda rows: [{"seq": r["seq"], "n": int(v)} for r, v in zip(rows, pd.Series([r["n"] for r in rows]).cummin(), strict=True)])
    flat(op)


def test_rolling_n_mean():
    op = chunks.rolling({"x": "x"}, "mean", pa.float64() if "mean" != "count" else pa.int64(), ["seq"], n=7, least=1)
    check(op, lambda rows: [{"seq": r["seq"], "x": of_last(rows, i, "mean")} for i, r in enumerate(rows)])
    flat(op)


def test_rolling_n_median():
    op = chunks.rolling({"x": "x"}, "median", pa.float64() if "median" != "count" else pa.int64(), ["seq"], n=7, least=1)
    check(op, lambda rows: [{"seq": r["seq"], "x": of_last(rows, i, "median")} for i, r in enumerate(rows)])
    flat(op)


def test_running_max():
    op = chunks.running({"n": ("max", "n")}, ["seq"])
    check(op, lambda rows: [{"seq": r["seq"], "n": int(v)} for r, v in zip(rows, pd.Series([r["n"] for r in rows]).cummax(), strict=True)])
    flat(op)


def test_rolling_n_count():
    op = chunks.rolling({"x": "x"}, "count", pa.float64() if "count" != "count" else pa.int64(), ["seq"], n=7, least=1)
    check(op, lambda rows: [{"seq": r["seq"], "x": of_last(rows, i, "count")} for i, r in enumerate(rows)])
    flat(op)


def test_running_of_several():
    op = chunks.running({"s": ("sum", "x"), "k": ("count", "x")}, ["seq"])

    def want(rows):
        total, k = 0.0, 0
        for r in rows:
            k += r["x"] is not None
            total += r["x"] or 0
            yield {"seq": r["seq"], "s": None if r["x"] is None else total, "k": k}

    check(op, lambda rows: list(want(rows)))
    flat(op)


def test_running_count():
    op = chunks.running({"count": ("count", "seq")}, ["seq"])
    check(op, lambda rows: [{"seq": r["seq"], "count": k + 1} for k, r in enumerate(rows)])
    flat(op)


def test_sliding_window():
    op = chunks.sliding_window("n", 4, ["seq"])
    check(op, lambda rows: [{"seq": r["seq"], "values": [y["n"] for y in rows[max(0, k - 3) : k + 1]]} for k, r in enumerate(rows)])
    check(chunks.sliding_window("n", 4, ["seq"], False), lambda rows: [{"seq": rows[k]["seq"], "values": [y["n"] for y in rows[k - 3 : k + 1]]} for k in range(3, len(rows))])
    flat(op)


def test_collect():
    def want(rows):
        some = []
        for r in rows:
            if r["f"]:
                yield {"seq": r["seq"], "values": some}
                some = []
            else:
                some.append(r["n"])

    op = chunks.collect("f", "n", ["seq"])
    check(op, lambda rows: list(want(rows)))
    flat(op)


def latest(rows, emit=(0, 1)):
    now = {}
    for r in rows:
        now[r["side"]] = r["n"]
        if len(now) == 2 and r["side"] in emit:
            yield {"seq": r["seq"], "_0": now[0], "_1": now[1]}


def test_combine_latest():
    op = chunks.combine_latest(["n", "n"], None)
    check(op, lambda rows: list(latest(rows)))
    flat(op)


def test_combine_latest_emit_on():
    op = chunks.combine_latest(["n", "n"], [0])
    check(op, lambda rows: list(latest(rows, (0,))))
    flat(op)


def test_zip_latest():
    def want(rows):
        now, waiting = None, []
        for r in rows:
            if r["side"]:
                now = r["n"]
            else:
                waiting.append(r)
            if now is not None:
                yield from ({"seq": w["seq"], "_0": w["n"], "_1": now} for w in waiting)
                waiting = []

    op = chunks.zip_latest(["n", "n"])
    check(op, lambda rows: list(want(rows)))
    flat(op)


def test_partition():
    op = chunks.partition("n", 7, ["seq"])
    check(op, lambda rows: [{"seq": rows[k + 6]["seq"], "values": [y["n"] for y in rows[k : k + 7]]} for k in range(0, len(rows) - 6, 7)])
    flat(op)


def test_zip():
    def want(rows):
        a, b = ([r for r in rows if r["side"] == k] for k in (0, 1))
        return [{"seq": max(x["seq"], y["seq"]), "_0": x["n"], "_1": y["n"]} for x, y in zip(a, b, strict=False)]

    check(chunks.zipped(["n", "n"], ["_0", "_1"]), want)
    flat(chunks.zipped(["n", "n"], ["_0", "_1"]))
