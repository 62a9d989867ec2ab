import pytest
from pyspark.sql import functions as F

from millrace.operators import steps
from millrace.operators.flow import Flow
from millrace.sources.spool import from_iterable, kafka_options


def values(flow, column="value"):
    return flow.sink_to_list(column)


def side(spark, pairs, kind="string"):
    return Flow(spark.createDataFrame(pairs, f"seq long, value {kind}"))


def test_scan(spark):
    assert values(from_iterable(spark, [0, 1, 2], "long").accumulate("sum", name="value")) == [0, 1, 3]


def test_fold_without_start_passes_the_first(spark):
    f = from_iterable(spark, [5, 1, 2], "long").accumulate(lambda a, x: a * 10 + x, result="long")
    assert values(f, "result") == [5, 51, 512]


def test_filter_truthy_and_remove(spark):
    f = from_iterable(spark, [k % 3 for k in range(10)], "long")
    assert values(f.filter()) == [1, 2, 1, 2, 1, 2]
    assert values(from_iterable(spark, [1, None, 2], "long").remove("value = 1")) == [None, 2]


def test_partition(spark):
    f = from_iterable(spark, range(11), "long").partition(2)
    assert values(f, "values") == [[k, k + 1] for k in range(0, 10, 2)]


@pytest.mark.parametrize(("keep", "want"), [("first", [[1, 2, 3], [1, 3, 2]]), ("last", [[2, 1, 3], [1, 3, 2]])])
def test_partition_unique(spark, keep, want):
    f = from_iterable(spark, [1, 2, 1, 3, 1, 3, 3, 2], "long").partition_unique(3, keep=keep)
    assert values(f, "result") == want


def test_sliding_window(spark):
    f = from_iterable(spark, range(4), "long")
    assert values(f.sliding_window(2), "values") == [[0], [0, 1], [1, 2], [2, 3]]
    assert values(f.sliding_window(2, return_partial=False), "values") == [[0, 1], [1, 2], [2, 3]]


def test_zip_with_a_constant(spark):
    a, b = side(spark, [(1, "a"), (4, "b")]), side(spark, [(2, "x"), (3, "y"), (9, "z")])
    assert [tuple(r)[1:] for r in a.zip(123, b).df.orderBy("pos").collect()] == [("a", 123, "x"), ("b", 123, "y")]


def test_combine_latest(spark):
    a, b = side(spark, [(1, "1"), (2, "2"), (4, "3")]), side(spark, [(3, "a"), (5, "b")])
    rows = lambda f: [(r["_0"], r["_1"]) for r in f.df.orderBy("seq").collect()]
    assert rows(a.combine_latest(b)) == [("2", "a"), ("3", "a"), ("3", "b")]
    assert rows(a.combine_latest(b, emit_on=0)) == [("3", "a")]


def test_zip_latest(spark):
    a, b = side(spark, [(1, "1"), (2, "2"), (5, "3")]), side(spark, [(3, "a"), (4, "b")])
    assert [(r["_0"], r["_1"]) for r in a.zip_latest(b).df.orderBy("seq").collect()] == [("1", "a"), ("2", "a"), ("3", "b")]


def test_unique(spark):
    assert values(from_iterable(spark, [1, 2, 1], "long").unique()) == [1, 2]
    assert values(from_iterable(spark, [1, 1, 2, 2, 1], "long").unique(maxsize=1)) == [1, 2, 1]
    lru = from_iterable(spark, [1, 2, 1, 2, 1, 2, 3, 2, 1, 2, 3, 2], "long").unique(maxsize=2)
    assert values(lru, "result") == [1, 2, 3, 1, 3]


def test_collect(spark):
    f = side(spark, [(1, "1"), (2, "2"), (3, "!"), (4, "!"), (5, "3"), (6, "!"), (7, "4")]).collect(F.col("value") == "!")
    assert values(f, "values") == [["1", "2"], [], ["3"]]


def test_slice(spark):
    f = from_iterable(spark, range(6), "long")
    assert values(f.slice(1, 5, 2)) == [2, 4]
    assert values(f.slice(3, 1)) == []
    with pytest.raises(ValueError):
        f.slice(-1)


def test_map_async_keeps_order_and_drops_failures(spark):
    async def fn(x):
        return 10 // x

    f = from_iterable(spark, [5, 0, 2], "long").map_async(fn, "value", "long")
    assert values(f, "result") == [2, 5]


def test_empty(spark):
    f = Flow(spark.createDataFrame([], "seq long, value long"))
    assert values(f.partition(2), "values") == []
    assert values(f.accumulate("sum", name="value")) == []
    assert values(f.sliding_window(3), "values") == []


def test_stream_equals_table(spark, tmp_path):
    rows = [(k, k % 2, k * 3) for k in range(20)]
    df = spark.createDataFrame(rows, "seq long, k long, value long")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = Flow(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), key="k")
    want = {tuple(r) for r in Flow(df, key="k").steps(steps.sliding_window(3), "value", "array<long>").df.selectExpr("k", "seq", "cast(result as string)").collect()}
    q = stream.steps(steps.sliding_window(3), "value", "array<long>").df.writeStream.format("memory").queryName("out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.table("out").selectExpr("k", "seq", "cast(result as string)").collect()}
    assert got == want


def test_registry_and_graph(spark):
    @Flow.register_api(attribute_name="plus_one")
    def plus_one(self):
        return self.map(value="value + 1")

    f = from_iterable(spark, [1], "long").plus_one()
    assert values(f) == [2]
    assert "from_iterable" in f.visualize()


def test_kafka_options():
    o = kafka_options("t", {"bootstrap.servers": "h:1", "group.id": "g"}, max_batch_size=4)
    assert o["subscribe"] == "t" and o["maxOffsetsPerTrigger"] == "4"
    with pytest.raises(ValueError):
        kafka_options("t", {}, npartitions=0)


def test_zip_latest_pairs_early_elements_with_one_moment(spark):
    a, b, c = side(spark, [(k, f"a{k}") for k in (0, 1, 2, 5, 9)]), side(spark, [(3, "b"), (7, "B")]), side(spark, [(4, "c"), (6, "C")])
    assert sorted(tuple(r) for r in a.zip_latest(b, c).df.collect()) == [(0, "a0", "b", "c"), (1, "a1", "b", "c"), (2, "a2", "b", "c"), (5, "a5", "b", "c"), (9, "a9", "B", "C")]
    assert a.zip_latest(b, side(spark, [])).df.count() == 0


def test_rate_limit_holds_for_later_operators(spark):
    f = side(spark, [(0, "x")]).rate_limit("500ms").filter("value is not null")
    assert f.trigger == {"processingTime": "0.5 seconds"}


def test_disconnect(spark):
    a, b, c = (side(spark, [(k, str(k))]) for k in range(3))
    both = a.connect(b)
    assert values(both.disconnect(b)) == ["0"]
    with pytest.raises(ValueError):
        both.disconnect(c)


def test_running_by_key_spreads_a_hot_key(spark):
    rows = [(k, None if k % 10 == 3 else "hot" if k % 10 else "rare", k) for k in range(500)]
    f = Flow(spark.createDataFrame(rows, "seq long, key string, value long"), key="key")
    got = {r.seq: r.total for r in f.accumulate("sum", name="total").df.collect()}
    seen = {}
    for seq, key, v in rows:
        seen[key] = seen.get(key, 0) + v
        assert got[seq] == seen[key]
    assert [r.part for r in f.partition(50).df.where("key = 'rare'").collect()] == [0]


def test_streams_carry_state_over_micro_batches(spark, tmp_path):
    """Four files, one a micro-batch: the same results as on the whole table."""
    import time

    df = spark.range(40).select(F.col("id").alias("seq"), (F.col("id") * 7 % 11).alias("value"))
    for k in range(4):
        df.where(f"seq div 10 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    live = Flow(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    table = Flow(df)

    def rows(f):
        return sorted(tuple(r) for r in f.collect())

    from millrace.streaming.sinks import drained

    assert rows(drained(live.sliding_window(3).df.select("seq", "values"))) == rows(table.sliding_window(3).df.select("seq", "values"))
    assert rows(drained(live.partition(7).df.select("seq", "values"))) == rows(table.partition(7).df.select("seq", "values"))
    assert rows(drained(live.accumulate("sum", name="t").df.select("seq", "t"))) == rows(table.accumulate("sum", name="t").df.select("seq", "t"))
    flush = F.col("value") == 0
    assert rows(drained(live.collect(flush).df.select("seq", "values"))) == rows(table.collect(flush).df.select("seq", "values"))


def test_python_fold_streams_through_a_key(spark):
    """No grouped map, which would hold all of a key's rows; a key over many batches keeps its state, a new one starts anew."""
    df = spark.range(30_000).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), F.lit(1).cast("long").alias("value"))
    f = Flow(df.repartition(7), key="k").accumulate(lambda a, x: a + x, "value", 0, "bigint")
    assert "FlatMapGroups" not in f.df._jdf.queryExecution().toString()
    assert all(r.result == r.seq // 3 + 1 for r in f.df.collect())
