import numpy as np
import pandas as pd
import pytest

from millrace.operators.frame import FlowFrame, weight


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    ts = pd.Timestamp("2000-01-01") + pd.to_timedelta(np.cumsum(rng.integers(1, 4000, 60)), "s")
    return pd.DataFrame({"seq": np.arange(60), "b": np.arange(60) // 7, "ts": ts, "k": np.arange(60) % 3, "x": rng.random(60)})


@pytest.fixture(scope="module")
def frame(spark, data):
    return FlowFrame(spark.createDataFrame(data), "seq", batch="b")


def column(f, c="x"):
    return f.df.orderBy("seq").toPandas()[c].to_numpy(float)


@pytest.mark.parametrize("kind", ["sum", "mean", "min", "max", "median", "var", "std", "count"])
@pytest.mark.parametrize("window", [2, 7, "2h"])
def test_rolling(frame, data, kind, window):
    got = column(frame[["x", "ts"]].rolling(window, ts="ts").agg(kind))
    x = data.set_index("ts").x.rolling(window)
    want = getattr(x, kind)().to_numpy(float)
    np.testing.assert_allclose(got, want, rtol=1e-9, equal_nan=True)


@pytest.mark.parametrize("kind", ["cumsum", "cumprod", "cummin", "cummax"])
def test_cumulative(frame, data, kind):
    np.testing.assert_allclose(column(getattr(frame[["x"]], kind)()), getattr(data.x, kind)().to_numpy())


@pytest.mark.parametrize("kind", ["sum", "mean", "count", "var", "std"])
@pytest.mark.parametrize("ddof", [0, 1])
def test_groupby(frame, data, kind, ddof):
    got = frame.groupby("k").x.agg(kind, ddof).orderBy("k").toPandas().x.to_numpy(float)
    g = data.groupby("k").x
    want = getattr(g, kind)(ddof=ddof) if kind in ("var", "std") else getattr(g, kind)()
    np.testing.assert_allclose(got, want.to_numpy(float))


@pytest.mark.parametrize("n", [1, 4, 20])
def test_window_n(frame, data, n):
    got = frame[["x"]].window(n=n).agg("sum").orderBy("b").toPandas().x.to_numpy()
    want = [data.x[: (i + 1) * 7][-n:].sum() for i in range(9)]
    np.testing.assert_allclose(got, want)


def test_window_t(frame, data):
    got = frame[["x", "ts"]].window("2h", ts="ts").agg("sum").orderBy("b").toPandas().x.to_numpy()
    want = []
    for i in range(9):
        seen = data[: (i + 1) * 7]
        want.append(seen.x[seen.ts > seen.ts.max() - pd.Timedelta("2h")].sum())
    np.testing.assert_allclose(got, want)


def test_ewm(frame, data):
    got = frame[["x"]].ewm(com=1).mean().first().x
    assert got == pytest.approx(data.x.ewm(alpha=0.5).mean().iloc[-1])
    for bad in ({}, {"com": 1, "span": 2}, {"com": -1}, {"span": 0.5}, {"halflife": 0}, {"alpha": 2}):
        with pytest.raises(ValueError):
            weight(**bad)


def test_resume(frame, data):
    half = frame._next(frame.df.where("seq < 20"))[["x", "k"]].state("k")
    whole = frame._next(frame.df.where("seq >= 20"))[["x", "k"]].state("k", start=half).orderBy("k").toPandas()
    np.testing.assert_allclose(whole.x_sum, data.groupby("k").x.sum())


def test_null_keys_and_values(spark):
    f = FlowFrame(spark.createDataFrame([(0, None, 1.0), (1, "a", None), (2, "a", 3.0)], "seq long, k string, x double"))
    assert [tuple(r) for r in f.groupby("k").x.count().collect()] == [("a", 1)]
    assert f[["x"]].sum().first().x == 4.0


def test_elementwise(spark):
    f = FlowFrame(spark.createDataFrame([(0, -7, 3), (1, 7, 0)], "seq long, x long, y long"))
    got = f.assign(m=f.x % f.y, d=f.x // f.y, r=2 - f.x, q=f.x > 0).df.orderBy("seq").collect()
    assert tuple(got[0])[3:] == (2, -3, 9, False)
    assert got[1]["m"] is None and got[1]["d"] is None


def test_query_takes_literals_as_they_are(spark):
    rows = [(0, "a&b", 1), (1, "x|y", 2), (2, "c==d", 3), (3, "[z]", 4), (4, "~", 5)]
    f = FlowFrame(spark.createDataFrame(rows, "seq long, name string, n long"), "seq")
    ask = lambda text: sorted(r.seq for r in f.query(text).df.collect())
    assert [ask(f"name == '{t}'") for _, t, _ in rows] == [[0], [1], [2], [3], [4]]
    assert ask("n > 1 & n < 4 | name == '~'") == [1, 2, 4] and ask("1 < n <= 3") == [1, 2]
    assert ask("name in ['a&b', '[z]'] and not n == 4") == [0] and ask("~(n % 2 == 0)") == [0, 2, 4] and ask("n not in (1, 2)") == [2, 3, 4]


def test_division_by_zero(spark):
    f = FlowFrame(spark.createDataFrame([(0, 1.0, 0.0), (1, -1.0, 0.0), (2, 0.0, 0.0), (3, 3.0, 2.0)], "seq long, a double, b double"), "seq")
    got = [r.q for r in f.assign(q=f.a / f.b).df.orderBy("seq").collect()]
    assert got[:2] == [float("inf"), float("-inf")] and got[2] != got[2] and got[3] == 1.5


def test_ewm_skips_nulls_and_spans_ranges(spark):
    x = [None if k % 5 == 2 else float(k % 7) for k in range(200)]
    f = FlowFrame(spark.createDataFrame(list(enumerate(x)), "seq long, x double"), "seq")
    r = w = 0.0
    for v in x:
        if v is not None:
            r, w = r * 0.5 + v, w * 0.5 + 1
    assert f.ewm(com=1).mean().first().x == pytest.approx(r / w)


def test_user_aggregation(spark):
    class Count:
        def initial(self, rows):
            return 0

        def on_new(self, state, rows):
            return state + len(rows), state + len(rows)

    f = FlowFrame(spark.createDataFrame([(k, k // 4, "ab"[k % 2]) for k in range(10)], "seq long, b long, key string"), "seq", batch="b")
    assert sorted(tuple(r) for r in f.aggregate(Count(), "b long, n long").collect()) == [(0, 4), (1, 8), (2, 10)]
    assert sorted(tuple(r) for r in f.aggregate(Count(), "b long, n long", start=100).collect()) == [(0, 104), (1, 108), (2, 110)]
    assert sorted(tuple(r) for r in f.groupby("key").aggregate(Count(), "b long, key string, n long").collect())[-1] == (2, "b", 5)


@pytest.mark.parametrize("kind", ["max", "mean", "sum", "min", "var", "std", "count"])
@pytest.mark.parametrize("hours", [1, 30, 10_000])
def test_rolling_time_over_many_ranges(spark, monkeypatch, kind, hours):
    """Windows within a range, over several and over all; times of several rows, no time, no value. No window frames."""
    from decimal import Decimal

    from pyspark.sql import functions as F

    from millrace.operators import ordered

    monkeypatch.setattr(ordered, "SHARE", 5)
    rows = [(k, None if k % 31 == 7 else k * 53 % 97 * (1 if k % 97 < 60 else 40), None if k % 9 == 4 else Decimal(k * 17 % 101) / 4) for k in range(300)]
    df = spark.createDataFrame(rows, "seq long, h long, x decimal(18,2)").select("seq", F.timestamp_seconds(F.col("h") * 3600).alias("ts"), "x")
    out = FlowFrame(df, "seq").rolling(f"{hours}h", ts="ts").agg(kind).df
    assert "Window" not in out._jdf.queryExecution().toString()
    got = {r.seq: r.x for r in out.collect()}
    for seq, h, _ in rows:
        some = pd.Series([float(x) for _, t, x in rows if x is not None and (t == h if h is None or t is None else h - hours < t <= h)], dtype=float)
        want = getattr(some, kind)() if len(some) else 0 if kind == "count" else None
        if want is None or want != want:
            assert got[seq] is None
        else:
            assert float(got[seq]) == pytest.approx(want)


def test_user_aggregation_streams_through_a_key(spark):
    """No grouped map, which would hold all of a key's rows; batches that span Arrow batches stay whole."""
    from pyspark.sql import functions as F

    class Rows:
        def initial(self, rows):
            return 0

        def on_new(self, state, rows):
            return state + len(rows), state + len(rows)

    df = spark.range(50_000).select(F.col("id").alias("seq"), F.floor(F.col("id") / 25_000).alias("b"), F.when(F.col("id") % 2 == 0, "a").otherwise("z").alias("key"))
    out = FlowFrame(df.repartition(5), "seq", batch="b").groupby("key").aggregate(Rows(), "b long, key string, n long")
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in out.collect()) == [(0, "a", 12_500), (0, "z", 12_500), (1, "a", 25_000), (1, "z", 25_000)]
