"""Catalogue of queries with their equivalents in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import steps
from .operators.flow import Flow
from .operators.frame import FlowFrame, Series
from .streaming.sinks import drained

BATCH = 97  # events a batch


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None):
    def put(fn):
        QUERIES[fn.__name__] = Query(fn, sql)
        return fn

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> Flow:
    """Events in order, values as exact decimals, with a batch id."""
    df = table(spark, d, "events").withColumn("value", F.col("value").cast("decimal(18,2)"))
    return Flow(df.withColumn("batch_id", F.floor(F.col("event_id") / BATCH)), "event_id", batch="batch_id")


def frame(spark: SparkSession, d: str, *columns: str) -> FlowFrame:
    return FlowFrame(events(spark, d).df.select("event_id", "batch_id", *(columns or ("value",))), "event_id", batch="batch_id")


def dbl(c: str | Column, digits: int = 7) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), digits)


def texts(c: str | Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


E = f"(select *, value::decimal(18,2) as v, event_id // {BATCH} as b from events)"


@query("select event_type, round(avg(v)::double, 7) as mean_value, count(*) as n from " + E + " where v > 10 group by 1")
def flow_filter_groupby_mean(s, d):
    f = events(s, d).filter("value > 10").to_frame()
    return f.df.groupBy("event_type").agg(dbl(F.avg(F.col("value").cast("double"))).alias("mean_value"), F.count("*").alias("n"))


@query("select event_id, (v*2+1)::double as y from " + E)
def flow_map(s, d):
    return events(s, d).map(y="cast(value*2+1 as double)").df.drop("batch_id")


@query("select event_id, user_id*10+event_id as y from events")
def flow_starmap(s, d):
    return events(s, d).starmap(y=F.col("user_id") * 10 + F.col("event_id")).df.drop("batch_id")


@query("select event_id, user_id from events where user_id % 3 <> 0")
def flow_filter_truthy(s, d):
    return events(s, d).map(value="user_id % 3", user_id="user_id").filter().df.select("event_id", "user_id")


@query("select event_id from events where not coalesce(event_type = 'click', false)")
def flow_remove(s, d):
    return events(s, d).remove("event_type = 'click'").df.select("event_id")


@query("select event_id, sum(v) over (order by event_id)::double as total, max(v) over (order by event_id)::double as top, min(v) over (order by event_id)::double as low, count(*) over (order by event_id) as n from " + E)
def flow_accumulate(s, d):
    f = events(s, d).running(total=("sum", "value"), top=("max", "value"), low=("min", "value"), n=("count", "value"))
    return f.df.select("event_id", *(F.col(c).cast("double").alias(c) for c in ("total", "top", "low")), "n")


@query("select event_id, sum(v) over (partition by user_id order by event_id)::double as total from " + E)
def flow_accumulate_keyed(s, d):
    f = events(s, d)
    f.key = "user_id"
    return f.accumulate("sum", "value", name="total").df.select("event_id", F.col("total").cast("double").alias("total"))


@query("select event_id, sum(case when r = 1 then 1 else 0 end) over (order by event_id)::bigint as distinct_users from (select event_id, row_number() over (partition by user_id order by event_id) as r from events)")
def flow_num_distinct_running(s, d):
    f = events(s, d)
    first = f.unique("user_id").df.select("event_id", F.lit(1).alias("one"))
    marked = Flow(f.df.select("event_id").join(first, "event_id", "left"), "event_id")
    return marked.accumulate("count", "one", name="distinct_users").df.select("event_id", F.col("distinct_users").cast("bigint").alias("distinct_users"))


@query("select event_id from (select event_id, row_number() over (order by event_id) - 1 as i from events) where i >= 10 and i < 500 and i % 7 = 0")
def flow_slice(s, d):
    return events(s, d).slice(10, 500, 7).df.select("event_id")


@query("select i // 5 as part, sum(v)::double as total, string_agg(event_id::varchar, ',' order by event_id) as members from (select *, row_number() over (order by event_id) - 1 as i from " + E + ") group by 1 having count(*) = 5")
def flow_partition(s, d):
    f = events(s, d).map(pair=F.struct("event_id", "value")).partition(5, "pair")
    total = F.aggregate("values", F.lit(0).cast("decimal(28,2)"), lambda a, x: (a + x["value"]).cast("decimal(28,2)")).cast("double")
    return f.df.select("part", texts(F.transform("values", lambda x: x["event_id"])).alias("members"), total.alias("total"))


@query("select user_id, i // 4 as part, string_agg(event_id::varchar, ',' order by event_id) as members from (select *, row_number() over (partition by user_id order by event_id) - 1 as i from events) group by 1, 2 having count(*) = 4")
def flow_partition_keyed(s, d):
    f = events(s, d)
    f.key = "user_id"
    return f.partition(4, "event_id").df.select("user_id", "part", texts("values").alias("members"))


def _partition_unique(new: str) -> str:
    return (
        "with recursive e as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) as i from events), "
        "f(user_id, i, seq, buf) as (select user_id, i, event_id, [event_type] from e where i = 1 union all "
        f"select e.user_id, e.i, e.event_id, {new} from (select user_id, i, case when len(buf) = 3 then [] else buf end as buf from f) f join e on e.user_id = f.user_id and e.i = f.i + 1) "
        "select user_id, seq, array_to_string(buf, ',') as members from f where len(buf) = 3 and (i = 1 or not exists (select 1 from f p where p.user_id = f.user_id and p.i = f.i - 1 and p.buf = f.buf))"
    )


@query(_partition_unique("case when list_contains(f.buf, e.event_type) then f.buf else list_append(f.buf, e.event_type) end"))
def flow_partition_unique_first(s, d):
    f = events(s, d)
    f.key = "user_id"
    return f.partition_unique(3, "event_type", "first", "string").df.select("user_id", "seq", texts("result").alias("members"))


@query(_partition_unique("list_append(list_filter(f.buf, lambda x: x <> e.event_type), e.event_type)"))
def flow_partition_unique_last(s, d):
    f = events(s, d)
    f.key = "user_id"
    return f.partition_unique(3, "event_type", "last", "string").df.select("user_id", "seq", texts("result").alias("members"))


@query("select event_id, array_to_string(list(event_id) over (order by event_id rows 3 preceding), ',') as members from events")
def flow_sliding_window(s, d):
    return events(s, d).sliding_window(4, "event_id").df.select("event_id", texts("values").alias("members"))


@query("select * from (select event_id, array_to_string(list(event_id) over (order by event_id rows 3 preceding), ',') as members from events) where event_id >= 3")
def flow_sliding_window_full(s, d):
    return events(s, d).sliding_window(4, "event_id", return_partial=False).df.select("event_id", texts("values").alias("members"))


@query("select date_trunc('day', ts)::date as day, count(*) as n, max(event_id) as last_id from events group by 1")
def flow_timed_window(s, d):
    w = events(s, d).timed_window("1 day", column="event_id").df
    return w.select(F.to_date("start").alias("day"), F.size("values").cast("bigint").alias("n"), F.element_at("values", -1).alias("last_id"))


def _timed_unique(order: str) -> str:
    return f"select day, string_agg(user_id::varchar, ',' order by s) as users from (select date_trunc('day', ts)::date as day, user_id, {order}(event_id) as s from events group by 1, 2) group by 1"


@query(_timed_unique("min"))
def flow_timed_window_unique_first(s, d):
    w = events(s, d).timed_window_unique("1 day", column="user_id").df
    return w.select(F.to_date(F.timestamp_seconds(F.col("window") * 86400)).alias("day"), texts("values").alias("users"))


@query(_timed_unique("max"))
def flow_timed_window_unique_last(s, d):
    w = events(s, d).timed_window_unique("1 day", column="user_id", keep="last").df
    return w.select(F.to_date(F.timestamp_seconds(F.col("window") * 86400)).alias("day"), texts("values").alias("users"))


@query("select event_id, ts + interval 90 second as ts from events")
def flow_delay(s, d):
    return events(s, d).delay("90s").df.select("event_id", "ts")


def sides(s, d) -> list[Flow]:
    return [Flow(events(s, d).df.where(f"event_type = '{t}'").select("event_id", F.col("event_id").alias("value")), "event_id") for t in ("click", "purchase", "view")]


def _side(t: str, name: str) -> str:
    return f"(select event_id as {name}, row_number() over (order by event_id) - 1 as pos from events where event_type = '{t}')"


@query("select pos, c as _0, 7 as _1, p as _2 from " + _side("click", "c") + " join " + _side("purchase", "p") + " using (pos)")
def flow_zip(s, d):
    a, b, _ = sides(s, d)
    return a.zip(7, b).df


_LATEST = "select event_id as seq, event_type, max(case when event_type='click' then event_id end) over (order by event_id) as _0, max(case when event_type='purchase' then event_id end) over (order by event_id) as _1 from events where event_type in ('click','purchase')"


@query(f"select seq, _0, _1 from ({_LATEST}) where _0 is not null and _1 is not null")
def flow_combine_latest(s, d):
    a, b, _ = sides(s, d)
    return a.combine_latest(b).df


@query(f"select seq, _0, _1 from ({_LATEST}) where _0 is not null and _1 is not null and event_type = 'click'")
def flow_combine_latest_emit_on(s, d):
    a, b, _ = sides(s, d)
    return a.combine_latest(b, emit_on=0).df


@query(
    "select c.event_id as seq, c.event_id as _0, (select max(event_id) from events p where event_type='purchase' and p.event_id <= greatest(c.event_id, r.ready)) as _1, "
    "(select max(event_id) from events w where event_type='view' and w.event_id <= greatest(c.event_id, r.ready)) as _2 from events c, "
    "(select greatest(min(case when event_type='purchase' then event_id end), min(case when event_type='view' then event_id end)) as ready from events) r where c.event_type='click'"
)
def flow_zip_latest(s, d):
    a, b, c = sides(s, d)
    return a.zip_latest(b, c).df


@query("select event_id from events where event_type = 'click' union all select event_id from events where event_type in ('purchase', 'view')")
def flow_union(s, d):
    a, b, c = sides(s, d)
    return a.union(b, c).df.select("event_id")


@query("select min(event_id) as event_id, user_id from events group by user_id")
def flow_unique(s, d):
    return events(s, d).unique("user_id").df.select("event_id", "user_id")


@query("select event_id from (select event_id, event_type, lag(event_type) over (order by event_id) as p from events) where p is distinct from event_type")
def flow_unique_last1(s, d):
    return events(s, d).unique("event_type", 1).df.select("event_id")


@query("with e as (select event_id, user_id, event_type, lag(event_id) over (partition by user_id, event_type order by event_id) as p from events) select a.event_id from e a where p is null or (select count(distinct event_type) from events b where b.user_id = a.user_id and b.event_id > a.p and b.event_id < a.event_id) >= 2")
def flow_unique_lru(s, d):
    f = events(s, d)
    f.key = "user_id"
    return f.unique("event_type", 2).df.select(F.col("seq").alias("event_id"))


@query("select event_id, json_extract_string(props, '$.k') as k from events")
def flow_pluck(s, d):
    return events(s, d).pluck("k", "props", "k").df.select("event_id", "k")


@query("select word, count(*) as n from (select unnest(string_split(text, ' ')) as word from documents where text is not null) group by 1")
def flow_flatten(s, d):
    docs = Flow(table(s, d, "documents").where("text is not null").select("doc_id", F.split("text", " ").alias("value")), "doc_id")
    return docs.flatten(name="word").frequencies("word").df.select("word", F.col("count").alias("n"))


@query("select event_type, count(*) as count from events group by 1")
def flow_frequencies(s, d):
    return events(s, d).frequencies("event_type").df


@query("select event_id, count(*) over (partition by event_type order by event_id) as count from events")
def flow_frequencies_running(s, d):
    return events(s, d).frequencies("event_type", running=True).df.select("event_id", "count")


@query("select epoch, coalesce(max(case when f = 1 then event_id end)) as event_id, coalesce(string_agg(case when f = 0 then event_id::varchar end, ',' order by event_id), '') as members from (select event_id, f, sum(f) over (order by event_id)::bigint - f as epoch from (select event_id, (event_type = 'purchase')::int as f from events)) group by 1 having max(f) = 1")
def flow_collect(s, d):
    return events(s, d).collect(F.col("event_type") == "purchase", "event_id").df.select("epoch", "event_id", texts("values").alias("members"))


@query("select b as batch_id, max(event_id) as event_id, arg_max(v, event_id)::double as value from " + E + " group by 1")
def flow_latest(s, d):
    return events(s, d).latest("value").df.select("batch_id", "event_id", F.col("value").cast("double").alias("value"))


@query("select b as batch_id, sum(sum(v)) over (order by b)::double as value from " + E + " group by b")
def batch_sum(s, d):
    return frame(s, d).reduce_per_batch("sum").select("batch_id", F.col("value").cast("double").alias("value"))


@query("select event_id, json_extract_string(props, '$.k')::bigint + 1 as k from events where event_id // 10 % 2 = 0")
def batch_pluck_map(s, d):
    b = events(s, d).to_batch(10).filter("batch_id % 2 = 0").pluck("k", "props", "k").map(k="cast(k as bigint) + 1")
    return b.df.select("event_id", "k")


@query("select k, count(*) as n from (select json_extract_string(props, '$.k')::bigint as k from events) group by 1")
def batch_to_frame(s, d):
    f = Flow(table(s, d, "events").select("event_id", F.col("props").alias("value")), "event_id").to_frame("k bigint")
    return f.df.groupBy("k").agg(F.count("*").alias("n"))


def line(s, d) -> FlowFrame:
    df = table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus", *(F.col(c).cast("decimal(18,2)").alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
    return FlowFrame(df, "l_orderkey")


L = "(select l_orderkey, l_partkey, l_linenumber, l_returnflag, l_linestatus, l_quantity::decimal(18,2) as q, l_extendedprice::decimal(18,2) as p, l_discount::decimal(18,2) as disc, l_tax::decimal(18,2) as tax from lineitem)"


@query("select l_orderkey, l_linenumber, q::double as l_quantity from " + L + " where q > 30")
def frame_getitem_filter(s, d):
    f = line(s, d)
    return f[f.l_quantity > 30].df.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity"))


@query("select l_orderkey, l_linenumber from " + L + " where q > 30 and l_returnflag = 'R' or l_linenumber in (6, 7)")
def frame_query(s, d):
    return line(s, d).query("l_quantity > 30 and l_returnflag == 'R' or l_linenumber in [6, 7]").df.select("l_orderkey", "l_linenumber")


@query("select l_orderkey, l_linenumber, (p * (1 - disc))::double as net, 1 as one from " + L)
def frame_assign(s, d):
    f = line(s, d)
    g = f.assign(net=f.l_extendedprice * (1 - f.l_discount), one=1)
    return g.df.select("l_orderkey", "l_linenumber", F.col("net").cast("double").alias("net"), "one")


@query("select l_orderkey, l_partkey as a, l_linenumber + 1 as b from " + L)
def frame_from_dict(s, d):
    f = line(s, d)
    return FlowFrame.from_series(a=f.l_partkey, b=f.l_linenumber + 1).df


@query("select l_orderkey, -l_partkey as l_partkey from " + L)
def frame_setitem(s, d):
    f = line(s, d)[["l_partkey"]]
    f["l_partkey"] = -f.l_partkey
    return f.df


@query(
    "select event_id, a + 3 as plus, 3 - a as minus, a * 2 as times, (a / 4)::double as div, floor(a / 4.0)::bigint as floordiv, a - floor(a / 7.0)::bigint * 7 as modulo, pow(a, 2)::double as power, abs(a) as absolute, a & 5 as bit_and, a | 5 as bit_or, xor(a, 5) as bit_xor, a < 0 as negative, (a >= 0) = (event_id % 2 = 0) as both_ from (select event_id, user_id - 70 as a from events)"
)
def frame_arith(s, d):
    f = FlowFrame(table(s, d, "events").select("event_id", (F.col("user_id") - 70).alias("a")), "event_id")
    a: Series = f.a
    bits = {"bit_and": a.col.bitwiseAND(5), "bit_or": a.col.bitwiseOR(5), "bit_xor": (a ^ 5).col}
    out = f.assign(plus=a + 3, minus=3 - a, times=a * 2, div=a / 4, floordiv=a // 4, modulo=a % 7, power=a**2, absolute=abs(a), negative=a < 0, both_=F.col("a") >= 0, **bits)
    even = F.col("event_id") % 2 == 0
    return out.df.withColumn("both_", F.col("both_") == even).drop("a")


@query("select event_id, round_even(v, 0)::double as value from " + E)
def frame_round(s, d):
    return frame(s, d).round(0).df.select("event_id", F.col("value").cast("double").alias("value"))


@query("select event_id, trunc(v)::bigint as value from " + E)
def frame_astype(s, d):
    return frame(s, d).astype("bigint").df.select("event_id", "value")


@query("select event_id, batch_id from (select event_id, b as batch_id, row_number() over (partition by b order by event_id desc) as r from " + E + ") where r <= 5")
def frame_tail(s, d):
    return frame(s, d).tail(5).df.select("event_id", "batch_id")


def _stats(f: FlowFrame, kind: str, digits: int = 7) -> DataFrame:
    return f.reduce(kind).select(*(dbl(c, digits).alias(c) for c in f.columns))


for _kind, _sql in (("sum", "sum"), ("mean", "avg"), ("var", "var_samp"), ("std", "stddev_samp")):
    QUERIES[f"reduce_{_kind}"] = Query(
        lambda s, d, k=_kind: _stats(line(s, d)[["l_quantity", "l_discount"]], k, 3),
        f"select round({_sql}(q)::double, 3) as l_quantity, round({_sql}(disc)::double, 3) as l_discount from {L}",
    )
    QUERIES[f"groupby_{_kind}"] = Query(
        lambda s, d, k=_kind: line(s, d).groupby("l_returnflag", "l_linestatus").l_quantity.agg(k).withColumn("l_quantity", dbl("l_quantity", 3)),
        f"select l_returnflag, l_linestatus, round({_sql}(q)::double, 3) as l_quantity from {L} group by 1, 2",
    )


@query("select count(l_orderkey) as l_partkey, count(q) as l_quantity from " + L)
def reduce_count(s, d):
    return line(s, d)[["l_partkey", "l_quantity"]].count()


@query("select count(*) * 2 as size from lineitem")
def reduce_size(s, d):
    return line(s, d)[["l_partkey", "l_quantity"]].size()


@query("select b as batch_id, round((sum(sum(v)) over (order by b) / sum(count(v)) over (order by b))::double, 7) as value from " + E + " group by b")
def reduce_mean_per_batch(s, d):
    return frame(s, d).reduce_per_batch("mean").select("batch_id", dbl("value").alias("value"))


@query("select event_type, count(*) as count from events where event_type is not null group by 1")
def value_counts(s, d):
    return frame(s, d, "event_type").value_counts("event_type")


@query("select user_id, count(*) as count from events group by 1 order by 2 desc, 1 limit 3")
def value_counts_nlargest(s, d):
    f = FlowFrame(frame(s, d, "user_id").value_counts("user_id"), "user_id")
    return f.nlargest(3, "count")


@query("select k as k, count(*) as size from (select l_orderkey % 7 as k from lineitem) group by 1")
def groupby_size_computed(s, d):
    f = line(s, d)
    return f.groupby(F.col("l_orderkey") % 7).size().select(F.col("key0").alias("k"), "size")


@query("select l_returnflag, count(q) as l_quantity from " + L + " group by 1")
def groupby_count(s, d):
    return line(s, d).groupby("l_returnflag").l_quantity.count()


@query("select round(sum(m)::double, 3) as l_quantity from (select avg(q) as m from " + L + " group by l_returnflag)")
def groupby_sum_of_mean(s, d):
    return FlowFrame(line(s, d).groupby("l_returnflag").l_quantity.mean(), "l_returnflag").reduce("sum").select(dbl("l_quantity", 3).alias("l_quantity"))


@query("with t as (select b, event_type, sum(v) as v from " + E + " group by 1, 2), k as (select event_type, min(b) as f from t group by 1), g as (select distinct x.b, k.event_type from t x join k on x.b >= k.f) select g.b as batch_id, g.event_type, sum(coalesce(t.v, 0)) over (partition by g.event_type order by g.b)::double as value from g left join t using (b, event_type)")
def groupby_sum_per_batch(s, d):
    return frame(s, d, "event_type", "value").groupby("event_type").value.sum_per_batch().select("batch_id", "event_type", F.col("value").cast("double").alias("value"))


for _kind, _sql in (("var", "var_samp"), ("std", "stddev_samp"), ("count", "count"), ("size", "count")):
    _out = f"{_sql}(v) over (order by b)" if _sql == "count" else f"round({_sql}(v::double) over (order by b), 3)"
    _name = "size" if _kind == "size" else "value"
    if _kind != "count":
        QUERIES[f"reduce_{_kind}_per_batch"] = Query(
            lambda s, d, k=_kind: frame(s, d).reduce_per_batch(k) if k == "size" else frame(s, d).reduce_per_batch(k).withColumn("value", dbl("value", 3)),
            f"select distinct b as batch_id, {_out} as {_name} from {E}",
        )

_GRID = f"with k as (select event_type, min(b) as f from {E} where event_type is not null group by 1), g as (select distinct x.b, k.event_type from {E} x join k on x.b >= k.f)"
for _kind, _sql in (("mean", "round(avg(e.v)::double, 3)"), ("count", "count(e.v)"), ("size", "count(*)"), ("var", "round(var_samp(e.v::double), 3)"), ("std", "round(stddev_samp(e.v::double), 3)")):
    _name = "size" if _kind == "size" else "value"
    QUERIES[f"groupby_{_kind}_per_batch"] = Query(
        lambda s, d, k=_kind: (lambda x: x if k in ("count", "size") else x.withColumn("value", dbl("value", 3)))(frame(s, d, "event_type", "value").groupby("event_type").value.agg_per_batch(k)),
        f"{_GRID} select g.b as batch_id, g.event_type, {_sql} as {_name} from g join {E} e on e.event_type = g.event_type and e.b <= g.b group by 1, 2",
    )


@query(_GRID + f" select g.b as batch_id, g.event_type, count(*) as count from g join {E} e on e.event_type = g.event_type and e.b <= g.b group by 1, 2")
def value_counts_per_batch(s, d):
    return frame(s, d, "event_type").value_counts_per_batch("event_type")


class Spread:
    """A user's aggregation: the range of the values so far."""

    def initial(self, rows):
        return None

    def on_new(self, state, rows):
        low, high = float(rows.value.astype(float).min()), float(rows.value.astype(float).max())
        state = (min(state[0], low), max(state[1], high)) if state else (low, high)
        return state, round(state[1] - state[0], 7)


@query("select distinct event_type, b as batch_id, round((max(v) over w - min(v) over w)::double, 7) as spread from " + E + " window w as (partition by event_type order by b)")
def aggregate_user(s, d):
    return frame(s, d, "event_type", "value").groupby("event_type").value.aggregate(Spread(), "batch_id long, event_type string, spread double")


@query("with recursive e as (select b, v::double as x, row_number() over (order by event_id) as i from " + E + "), f(i, r, w) as (select i, x, 1.0::double from e where i = 1 union all select e.i, f.r * 0.5 + e.x, f.w * 0.5 + 1 from f join e on e.i = f.i + 1) select b as batch_id, round(arg_max(r / w, i), 7) as value from f join e using (i) group by 1")
def ewm_mean_per_batch(s, d):
    return frame(s, d).ewm(com=1).mean_per_batch().withColumn("value", F.round("value", 7))


def _window_sql(cols: str, by: str = "", n: int = 40) -> str:
    return f"with h as (select b, max(event_id) as hi from {E} group by 1) select h.b as batch_id, {cols} from h join {E} e on e.event_id <= h.hi and e.event_id > h.hi - {n} group by 1{by}"


for _kind, _sql in (("sum", "sum"), ("mean", "avg"), ("var", "var_samp"), ("std", "stddev_samp"), ("count", "count")):
    _out = "count(v) as value" if _kind == "count" else f"round({_sql}(v)::double, 7) as value"
    QUERIES[f"window_n_{_kind}"] = Query(lambda s, d, k=_kind: _w(frame(s, d).window(n=40).agg(k), k), _window_sql(_out))
    QUERIES[f"window_groupby_n_{_kind}"] = Query(lambda s, d, k=_kind: _w(frame(s, d, "event_type", "value").window(n=40).agg(k, "event_type"), k), _window_sql("event_type, " + _out, ", 2"))
    _t = f"with h as (select b, max(ts) as hi from {E} group by 1) select h.b as batch_id, {_out} from h join {E} e on e.ts <= h.hi and e.ts > h.hi - interval 7200 second group by 1"
    QUERIES[f"window_t_{_kind}"] = Query(lambda s, d, k=_kind: _w(frame(s, d, "ts", "value").window(value="2h", ts="ts").agg(k), k), _t)


def _w(df: DataFrame, kind: str) -> DataFrame:
    return df if kind == "count" else df.withColumn("value", dbl("value"))


@query(_window_sql("event_type, count(*) as count", ", 2"))
def window_n_value_counts(s, d):
    return frame(s, d, "event_type").window(n=40).value_counts("event_type")


@query("with h as (select b, max(ts) as hi from " + E + " group by 1) select h.b as batch_id, event_type, count(*) as size from h join " + E + " e on e.ts <= h.hi and e.ts > h.hi - interval 7200 second group by 1, 2")
def window_groupby_t_size(s, d):
    return frame(s, d, "ts", "event_type").window("2h", ts="ts").agg("size", "event_type")


@query(_window_sql("max(v)::double - min(v)::double as spread"))
def window_apply(s, d):
    fn = lambda x: x.groupby("_w", as_index=False).value.agg(lambda v: float(v.astype(float).max() - v.astype(float).min())).rename(columns={"_w": "batch_id", "value": "spread"})
    return frame(s, d).window(n=40).apply(fn, "batch_id long, spread double").select("batch_id", dbl("spread").alias("spread"))


QUERIES["window_apply"] = Query(QUERIES["window_apply"].run, _window_sql("round(max(v)::double - min(v)::double, 7) as spread"))


@query("select b as batch_id, sum(count(v)) over (order by b)::bigint as value from " + E + " group by b")
def expanding_count(s, d):
    return frame(s, d).expanding().reduce_per_batch("count")


@query("with recursive e as (select user_id, v::double as x, row_number() over (partition by user_id order by event_id) as i from " + E + "), f(user_id, i, r, w) as (select user_id, i, x, 1.0::double from e where i = 1 union all select e.user_id, e.i, f.r * 0.5 + e.x, f.w * 0.5 + 1 from f join e on e.user_id = f.user_id and e.i = f.i + 1) select user_id, round(r / w, 7) as value from f where (user_id, i) in (select user_id, max(i) from e group by 1)")
def ewm_mean(s, d):
    f = FlowFrame(events(s, d).df.select("event_id", "user_id", "value"), "event_id")
    return f.ewm(com=1).mean("user_id").withColumn("value", F.round("value", 7))


for _kind, _sql in (("sum", "sum(v)"), ("mean", "avg(v)"), ("min", "min(v)"), ("max", "max(v)"), ("var", "var_samp(v)"), ("std", "stddev_samp(v)"), ("median", "quantile_cont(v::double, 0.5)"), ("quantile", "quantile_cont(v::double, 0.25)")):
    _run = (lambda r, k: r.agg(k, 0.25)) if _kind == "quantile" else (lambda r, k: r.agg(k))
    QUERIES[f"rolling_n_{_kind}"] = Query(
        lambda s, d, k=_kind, r=_run: r(frame(s, d).rolling(7), k).df.select("event_id", dbl("value").alias("value")),
        f"select event_id, case when event_id >= 6 then round(({_sql} over (order by event_id rows 6 preceding))::double, 7) end as value from {E}",
    )
    if _kind in ("sum", "mean", "min", "max"):
        QUERIES[f"rolling_t_{_kind}"] = Query(
            lambda s, d, k=_kind, r=_run: r(frame(s, d, "ts", "value").rolling("2h", ts="ts"), k).df.select("event_id", dbl("value").alias("value")),
            f"select event_id, round(({_sql} over (order by ts range between interval 7199999999 microseconds preceding and current row))::double, 7) as value from {E}",
        )


@query("select event_id, case when event_id >= 6 then count(v) over (order by event_id rows 6 preceding) end as value from " + E)
def rolling_n_count(s, d):
    return frame(s, d).rolling(7).count().df.select("event_id", "value")


for _kind, _sql in (("cumsum", "sum"), ("cummin", "min"), ("cummax", "max")):
    QUERIES[_kind] = Query(lambda s, d, k=_kind: getattr(frame(s, d), k)().df.select("event_id", dbl("value").alias("value")), f"select event_id, round(({_sql}(v) over (order by event_id))::double, 7) as value from {E}")


@query("select event_id, round(product(1 + (event_id % 3 - 1) / 1000.0) over (order by event_id), 6) as value from events")
def cumprod(s, d):
    f = FlowFrame(table(s, d, "events").select("event_id", (1 + (F.col("event_id") % 3 - 1) / F.lit(1000.0)).alias("value")), "event_id")
    return f.cumprod().df.select("event_id", F.round("value", 6).alias("value"))


@query("select event_type, count(v) as n, sum(v)::double as total, round(avg(v)::double, 7) as mean_value from " + E + " group by 1")
def resume_groupby(s, d):
    f = frame(s, d, "event_type", "value")
    half = f._next(f.df.where("event_id < 500")).state("event_type")
    t = f._next(f.df.where("event_id >= 500")).state("event_type", start=half)
    return t.select("event_type", F.col("value_n").alias("n"), F.col("value_sum").cast("double").alias("total"), dbl(F.col("value_sum").cast("double") / F.col("value_n")).alias("mean_value"))


@query("select event_id, sum(user_id) over (partition by event_type order by event_id)::bigint as total from events")
def fold_python(s, d):
    f = events(s, d)
    f.key = "event_type"
    return f.accumulate(lambda a, x: a + x, "user_id", 0, "bigint").df.select(F.col("seq").alias("event_id"), F.col("result").alias("total"))


def stream_of(s, d) -> DataFrame:
    return s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/events.parquet*")


@query("select event_type, count(*) as n, sum(v)::double as total from " + E + " where v > 10 group by 1")
def stream_groupby(s, d):
    df = stream_of(s, d).where("value > 10").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))
    return drained(df, "complete")


@query("select min(event_id) is not null as seen, user_id from events group by user_id")
def stream_unique(s, d):
    return drained(Flow(stream_of(s, d).select("user_id", F.lit(True).alias("seen")), "user_id").unique("user_id").df, "append")


@query("select event_type, event_id as seq, sum(user_id) over (partition by event_type order by event_id)::bigint as result from events")
def stream_accumulate(s, d):
    f = Flow(stream_of(s, d).select("event_id", "event_type", "user_id"), "event_id", key="event_type")
    return drained(f.steps(steps.accumulate(lambda a, x: a + x, 0), "user_id", "bigint").df.select("event_type", "seq", "result"), "append")


@query("select user_id, seq, members from (select user_id, max(event_id) as seq, string_agg(event_id::varchar, ',' order by event_id) as members from (select *, row_number() over (partition by user_id order by event_id) - 1 as i from events) group by user_id, i // 4 having count(*) = 4)")
def stream_partition(s, d):
    f = Flow(stream_of(s, d).select("event_id", "user_id"), "event_id", key="user_id")
    return drained(f.steps(steps.partition(4), "event_id", "array<bigint>").df.select("user_id", "seq", texts("result").alias("members")), "append")


def stream(s, d, *columns: str, key: str | None = None) -> Flow:
    """The events as a stream, with exact values."""
    df = stream_of(s, d).withColumn("value", F.col("value").cast("decimal(18,2)"))
    return Flow(df.select(*dict.fromkeys(("event_id", *columns))), "event_id", key=key)


def stream_sides(s, d) -> list[Flow]:
    return [Flow(stream_of(s, d).where(f"event_type = '{t}'").select("event_id", F.col("event_id").alias("value")), "event_id") for t in ("click", "purchase", "view")]


@query(QUERIES["flow_sliding_window"].sql)
def stream_sliding_window(s, d):
    return drained(stream(s, d).sliding_window(4, "event_id").df.select(F.col("seq").alias("event_id"), texts("values").alias("members")))


@query("select max(event_id) as event_id, string_agg(event_id::varchar, ',' order by event_id) as members from (select *, row_number() over (order by event_id) - 1 as i from events) group by i // 5 having count(*) = 5")
def stream_partition_whole(s, d):
    return drained(stream(s, d).partition(5, "event_id").df.select(F.col("seq").alias("event_id"), texts("values").alias("members")))


@query(QUERIES["flow_slice"].sql)
def stream_slice(s, d):
    return drained(stream(s, d).slice(10, 500, 7).df)


@query("select _0, _1, _2 from (" + QUERIES["flow_zip"].sql + ")")
def stream_zip(s, d):
    a, b, _ = stream_sides(s, d)
    return drained(a.zip(7, b).df.drop("seq"))


@query(QUERIES["flow_combine_latest"].sql)
def stream_combine_latest(s, d):
    a, b, _ = stream_sides(s, d)
    return drained(a.combine_latest(b).df)


@query(QUERIES["flow_combine_latest_emit_on"].sql)
def stream_combine_latest_emit_on(s, d):
    a, b, _ = stream_sides(s, d)
    return drained(a.combine_latest(b, emit_on=0).df)


@query(QUERIES["flow_zip_latest"].sql)
def stream_zip_latest(s, d):
    a, b, c = stream_sides(s, d)
    return drained(a.zip_latest(b, c).df)


@query("select event_id, members from (" + QUERIES["flow_collect"].sql + ")")
def stream_collect(s, d):
    f = stream(s, d, "event_type").collect(F.col("event_type") == "purchase", "event_id")
    return drained(f.df.select(F.col("seq").alias("event_id"), texts("values").alias("members")))


@query(QUERIES["flow_accumulate"].sql)
def stream_accumulate_whole(s, d):
    f = stream(s, d, "value").running(total=("sum", "value"), top=("max", "value"), low=("min", "value"), n=("count", "value"))
    return drained(f.df.select(F.col("seq").alias("event_id"), *(F.col(c).cast("double").alias(c) for c in ("total", "top", "low")), "n"))


@query(QUERIES["flow_frequencies_running"].sql)
def stream_frequencies_running(s, d):
    return drained(stream(s, d, "event_type").frequencies("event_type", running=True).df.select(F.col("seq").alias("event_id"), "count"))


@query("select user_id, seq, members from (" + QUERIES["flow_partition_unique_first"].sql + ")")
def stream_partition_unique(s, d):
    f = stream(s, d, "user_id", "event_type", key="user_id").partition_unique(3, "event_type", "first", "string")
    return drained(f.df.select("user_id", "seq", texts("result").alias("members")))


@query(QUERIES["flow_unique_lru"].sql)
def stream_unique_lru(s, d):
    return drained(stream(s, d, "user_id", "event_type", key="user_id").unique("event_type", 2).df.select(F.col("seq").alias("event_id")))


for _kind in ("cumsum", "cummin", "cummax"):
    QUERIES[f"stream_{_kind}"] = Query(
        lambda s, d, k=_kind: drained(getattr(FlowFrame(stream(s, d, "value").df, "event_id"), k)().df.select(F.col("seq").alias("event_id"), dbl("value").alias("value"))),
        QUERIES[_kind].sql,
    )
for _kind in ("sum", "mean", "var", "median", "count"):
    QUERIES[f"stream_rolling_n_{_kind}"] = Query(
        lambda s, d, k=_kind: drained((lambda x: x.select(F.col("seq").alias("event_id"), "value" if k == "count" else dbl("value").alias("value")))(FlowFrame(stream(s, d, "value").df, "event_id").rolling(7).agg(k).df)),
        QUERIES[f"rolling_n_{_kind}"].sql,
    )


@query(QUERIES["rolling_t_mean"].sql)
def stream_rolling_t_mean(s, d):
    f = FlowFrame(stream(s, d, "ts", "value").df, "event_id").rolling("2h", ts="ts").mean()
    return drained(f.df.select(F.col("seq").alias("event_id"), dbl("value").alias("value")))
