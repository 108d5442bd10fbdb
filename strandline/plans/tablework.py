"""Queries of slices, unions, memberships, digits, titles and market metadata, over stand-ins out of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.operators import cleaning as C
from strandline.operators import markets as M
from strandline.sources.tables import BARS, TICKS

from .registry import query


@query("c2_time_slice", f"with {BARS} select symbol, bar_id, close from bars where time between timestamp '2024-01-05' and timestamp '2024-01-20 12:00:00'")
def c2(t):
    return t.bars.where("time between timestamp_ntz'2024-01-05 00:00:00' and timestamp_ntz'2024-01-20 12:00:00'").select("symbol", "bar_id", "close")


@query("c6_union_by_name", f"with {BARS} select symbol, bar_id, close, null::double as high from bars where close < open union all by name select symbol, bar_id, high, null::double as close from bars where close >= open")
def c6(t):
    return t.bars.where("close < open").select("symbol", "bar_id", "close").unionByName(t.bars.where("close >= open").select("bar_id", "high", "symbol"), allowMissingColumns=True)


@query("c9_membership", "select o_orderkey, o_orderpriority in ('1-URGENT', '2-HIGH') as urgent, o_custkey in (select c_custkey from customer where c_acctbal < 0) as owes from orders")
def c9(t):
    owing = t.read("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("owes"))
    return t.read("orders").join(owing, "o_custkey", "left").select("o_orderkey", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("urgent"), F.coalesce("owes", F.lit(False)).alias("owes"))


@query("c11_drop_missing", f"with {BARS}, l as (select symbol, bar_id, lag(close, 3) over (partition by symbol order by bar_id) as before from bars) select * from l where before is not null")
def c11(t):
    from strandline.functions.windows import lag

    return t.bars.select("symbol", "bar_id", lag("close", 3).alias("before")).na.drop(subset=["before"])


@query("c15_heads", f"with {BARS}, h as (select symbol, bar_id, close from bars order by close desc, symbol, bar_id limit 7), l as (select symbol, arg_min(bar_id, close) as bar_id from (select * from bars order by bar_id) group by symbol) select symbol, bar_id, 'head' as what from h union all select symbol, min(bar_id), 'least' from bars b where close = (select min(close) from bars c where c.symbol = b.symbol) group by symbol")
def c15(t):
    head = t.bars.orderBy(F.desc("close"), "symbol", "bar_id").limit(7).select("symbol", "bar_id", F.lit("head").alias("what"))
    return head.unionByName(t.bars.groupBy("symbol").agg(F.min_by("bar_id", F.struct("close", "bar_id")).alias("bar_id")).withColumn("what", F.lit("least")))


@query("c17_local_time", "select event_id, hour(l) as hour, dayname(l) as day from (select event_id, (ts at time zone 'UTC') at time zone 'Asia/Seoul' as l from events)")
def c17(t):
    local = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Seoul"), "ts")
    return t.read("events").select("event_id", F.hour(local).cast("long").alias("hour"), F.date_format(local, "EEEE").alias("day"))


@query("c19_fold_months", "with m as (select distinct o_orderpriority as fold, date_trunc('month', min(o_orderdate) over (partition by o_orderpriority)) as a, date_trunc('month', max(o_orderdate) over (partition by o_orderpriority)) as b from orders) select fold, a::timestamp as first, (b + interval 1 month - interval 1 second)::timestamp as last from m")
def c19(t):
    m = t.read("orders").groupBy(F.col("o_orderpriority").alias("fold")).agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    first = lambda c: F.date_trunc("month", c).cast("timestamp_ntz")
    return m.select("fold", first("a").alias("first"), (first("b") + F.expr("interval 1 month") - F.expr("interval 1 second")).alias("last"))


@query("c22_first_digits", f"with {BARS} select symbol, bar_id, substring(replace(replace(round(close, 2)::varchar, '.', ''), '0', ''), 1, 2) as digits from bars")
def c22(t):
    return t.bars.select("symbol", "bar_id", F.substring(F.regexp_replace(F.round("close", 2).cast("string"), "[.0]", ""), 1, 2).alias("digits"))


_TITLE = """with s as (select o_orderkey, case o_orderkey % 4 when 0 then 'Listing (' || upper(substr(o_orderpriority, 3, 3)) || ') and (KRX) market (NOT)' when 1 then 'New BTC and ' || upper(substr(o_orderpriority, 3, 4)) || ' USDT pairs' when 2 then 'nothing here' end as title from orders)"""


def _titles(t):
    p = F.col("o_orderpriority")
    title = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("Listing ("), F.upper(F.substring(p, 3, 3)), F.lit(") and (KRX) market (NOT)"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("New BTC and "), F.upper(F.substring(p, 3, 4)), F.lit(" USDT pairs"))).when(F.col("o_orderkey") % 4 == 2, F.lit("nothing here"))
    return t.read("orders").select("o_orderkey", title.alias("title"))


@query("c23_title_tickers", _TITLE + r""", b as (select o_orderkey, title, list_distinct(regexp_extract_all(regexp_extract(title, '^(.*?)market', 1), '\((\w+)\)', 1)) as inner_, list_filter(regexp_split_to_array(title, '[^A-Za-z0-9_]+'), lambda x: regexp_full_match(x, '[A-Z]{2,}') and x not in ('USDT', 'KRW', 'BTC')) as caps from s)
select o_orderkey, list_aggregate(list_sort(case when len(inner_) > 0 then inner_ else list_distinct(caps) end), 'string_agg', ',') as tickers from b where title is not null and len(case when len(inner_) > 0 then inner_ else caps end) > 0""")  # fmt: skip
def c23(t):
    found = _titles(t).where("title is not null").select("o_orderkey", F.array_sort(C.title_tickers("title", "market")).alias("x"))
    return found.where(F.size("x") > 0).select("o_orderkey", F.array_join("x", ",").alias("tickers"))


@query("c24_title_prefix", _TITLE + " select o_orderkey from s where starts_with(title, 'Listing')")
def c24(t):
    return _titles(t).where(F.col("title").startswith("Listing")).select("o_orderkey")


@query("c26_gather", f"with {BARS}, i as (select symbol, bar_id as i0, step, bar_id + step * 5 as at from bars, range(3) r(step) where close < open) select i.symbol, i.i0, i.step, b.close, coalesce(b.close > b.open, false) as rose, i.i0 // 24 as bucket from i left join bars b on b.symbol = i.symbol and b.bar_id = i.at")
def c26(t):
    """An index matrix (event, step) -> values, null where it points past the end; the flag and the day bucket come with it."""
    i = t.bars.where("close < open").select("symbol", F.col("bar_id").alias("i0"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("step"))
    i = i.withColumn("bar_id", F.col("i0") + F.col("step") * 5)
    g = i.join(t.bars.select("symbol", "bar_id", "close", "open"), ["symbol", "bar_id"], "left")
    return g.select("symbol", "i0", F.col("step").cast("long").alias("step"), "close", F.coalesce(F.col("close") > F.col("open"), F.lit(False)).alias("rose"), F.expr("i0 div 24").alias("bucket"))


_EXCHANGE = "select 'X' || (o_custkey % 7)::varchar as exchange, o_totalprice as volume from orders"


def _pairs(t):
    return t.read("orders").select(F.concat(F.lit("X"), (F.col("o_custkey") % 7).cast("string")).alias("exchange"), F.col("o_totalprice").alias("volume"))


@query("a9_dominant_exchange", f"with p as ({_EXCHANGE}) select exchange, round(sum(volume), 2) as volume from p group by exchange order by volume desc, exchange limit 1")
def a9(t):
    return M.dominant(_pairs(t)).select("exchange", F.round("volume", 2).alias("volume"))


@query("a10_sum_by_prefix", "select substring(p_brand, 1, 7) as kind, round(sum(p_retailprice), 2) as total from part group by kind")
def a10(t):
    return t.read("part").groupBy(F.substring("p_brand", 1, 7).alias("kind")).agg(F.round(F.sum("p_retailprice"), 2).alias("total"))


@query("s4_header_repair", f"with {TICKS}, c as (select id, round(price, 2)::varchar || case when id % 3 = 0 then '.' || qty::varchar when id % 3 = 1 then '.7.' || qty::varchar else '' end as cell from ticks) select id, split_part(cell, '.', 1) || case when cell like '%.%' then '.' || replace(substring(cell, length(split_part(cell, '.', 1)) + 2), '.', '') else '' end as cell from c")
def s4(t):
    third = F.col("id") % 3
    tail = F.when(third == 0, F.concat(F.lit("."), F.col("qty"))).when(third == 1, F.concat(F.lit(".7."), F.col("qty"))).otherwise("")
    return t.ticks.select("id", F.concat(F.round("price", 2).cast("string"), tail).alias("cell")).select("id", M.repaired("cell").alias("cell"))


@query("s9_partitions", "select o_orderpriority as symbol, unnest(generate_series(date_trunc('month', min(o_orderdate)), max(o_orderdate), interval 1 month))::timestamp as partition from orders group by o_orderpriority")
def s9(t):
    return M.months_between(t.read("orders").withColumnRenamed("o_orderpriority", "symbol"), "o_orderdate").withColumn("partition", F.col("partition").cast("timestamp_ntz"))


@query("s13_panel", f"with {BARS} pivot (select time, symbol, close from bars qualify row_number() over (partition by symbol order by bar_id desc) <= 20) on symbol in ('click', 'view') using max(close)")
def s13(t):
    last = t.bars.withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("bar_id")))).where("n <= 20")
    return last.groupBy("time").pivot("symbol", ["click", "view"]).agg(F.max("close"))


@query("s14_spread", f"with {BARS} select a.time, round((b.close - a.close) / a.close, 9) as spread from bars a join bars b on a.time = b.time and a.symbol = 'purchase' and b.symbol = 'signup'")
def s14(t):
    spot, fut = (t.bars.where(F.col("symbol") == s).select("time", F.col("close").alias(c)) for s, c in (("purchase", "s"), ("signup", "f")))
    return spot.join(fut, "time").select("time", F.round((F.col("f") - F.col("s")) / F.col("s"), 9).alias("spread"))


_JSON = """select o_orderkey, '[{"candle_date_time_utc":"' || strftime(o_orderdate + interval 1 hour, '%Y-%m-%dT%H:%M:%S') || '","opening_price":2,"high_price":4,"low_price":1,"trade_price":' || o_custkey || ',"candle_acc_trade_volume":1},{"candle_date_time_utc":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '","opening_price":1,"high_price":3,"low_price":1,"trade_price":2,"candle_acc_trade_volume":5}]' as json from orders"""


@query("s15_json_candles", "select o_orderkey, unnest([o_orderdate, o_orderdate + interval 1 hour])::timestamp as time, unnest([2.0::double, o_custkey::double]) as close, unnest([5.0::double, 1.0::double]) as volume from orders")
def s15(t):
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    one = lambda when, o, h, close, v: F.concat(F.lit('{"candle_date_time_utc":"'), when, F.lit(f'","opening_price":{o},"high_price":{h},"low_price":1,"trade_price":'), close, F.lit(f',"candle_acc_trade_volume":{v}}}'))
    day = F.col("o_orderdate").cast("timestamp_ntz")
    json = F.concat(F.lit("["), one(stamp(day + F.expr("interval 1 hour")), 2, 4, F.col("o_custkey").cast("string"), 1), F.lit(","), one(stamp(day), 1, 3, F.lit("2"), 5), F.lit("]"))
    c = t.read("orders").select("o_orderkey", F.explode(M.candles(json)).alias("c"))
    return c.select("o_orderkey", "c.time", "c.close", "c.volume")


@query("s17_current_prices", f"with {BARS}, m as (select 'KRW-' || symbol as market, close from bars qualify row_number() over (partition by symbol order by bar_id desc) = 1) select replace(market, 'KRW-', '') as ticker, close as price from m")
def s17(t):
    m = t.bars.groupBy(F.concat(F.lit("KRW-"), "symbol").alias("market")).agg(F.max_by("close", "bar_id").alias("price"))
    return m.select(F.regexp_replace("market", "^KRW-", "").alias("ticker"), "price")


@query("s18_markets", "select p_partkey, p_brand as base from part where p_size > 10 and p_type <> (select min(p_type) from part)")
def s18(t):
    """Markets of one quote that are active: a dimension with a filter that reaches the scan."""
    p = t.read("part")
    return p.where("p_size > 10").where(F.col("p_type") != p.agg(F.min("p_type")).scalar()).select("p_partkey", F.col("p_brand").alias("base"))


@query("s18_listed_markets", "select p_brand as base, p_type as quote, p_partkey as id from part where p_type = 'STANDARD' and p_size % 2 = 0 and p_size > 10")
def s18_listed(t):
    p = t.read("part").select(F.col("p_brand").alias("base"), F.col("p_type").alias("quote"), F.when(F.col("p_size") % 2 == 0, "spot").otherwise("swap").alias("type"), (F.col("p_size") > 10).alias("active"), F.col("p_partkey").alias("id"))
    return M.listed_markets(p, "STANDARD", "spot").select("base", "quote", "id")


_BASES = """with spot as (select distinct upper(n_name) as base from nation where n_nationkey % 3 <> 1 union select unnest(['LUNA', 'DODO', 'PEPE'])),
futures as (select distinct case when n_nationkey % 4 = 2 then '1000' else '' end || upper(n_name) as base from nation where n_nationkey % 5 <> 0 union select unnest(['LUNA2', 'DODOX', '1000PEPE']))"""


def _bases(t):
    n = t.read("nation")
    more = lambda *x: t.spark.range(1).select(F.explode(F.array(*map(F.lit, x))).alias("base"))
    spot = n.where("n_nationkey % 3 <> 1").select(F.upper("n_name").alias("base")).union(more("LUNA", "DODO", "PEPE")).distinct()
    kilo = F.when(F.col("n_nationkey") % 4 == 2, "1000").otherwise("")
    return spot, n.where("n_nationkey % 5 <> 0").select(F.concat(kilo, F.upper("n_name")).alias("base")).union(more("LUNA2", "DODOX", "1000PEPE")).distinct()


@query("s19_symbols", _BASES + ", t as (select upper(n_name) as ticker from nation union select 'PEPE') select ticker, (select any_value(base || '/USDT') from spot where base = ticker) as spot, coalesce((select any_value(base || '/USDT:USDT') from futures where base = '1000' || ticker), (select any_value(base || '/USDT:USDT') from futures where base = ticker)) as futures from t")
def s19(t):
    spot, futures = _bases(t)
    tickers = t.read("nation").select(F.upper("n_name").alias("ticker")).union(t.spark.range(1).select(F.lit("PEPE"))).distinct()
    return M.to_symbols(tickers, spot, futures)


@query("s19_tickers", _BASES + " select base || '/USDT:USDT' as symbol, case replace(base, '1000', '') when 'LUNA2' then 'LUNA' when 'DODOX' then 'DODO' else replace(base, '1000', '') end as ticker from futures")
def s19b(t):
    return _bases(t)[1].select(F.concat("base", F.lit("/USDT:USDT")).alias("symbol")).withColumn("ticker", M.to_ticker("symbol"))


@query("s20_both_markets", _BASES + ", c as (select s.base as spot, f.base as futures, case when f.base = s.base then 0 when f.base = '1000' || s.base then 1 else 2 end as rank from spot s join futures f on f.base = s.base or f.base = '1000' || s.base or (s.base = 'LUNA' and f.base = 'LUNA2') or (s.base = 'DODO' and f.base = 'DODOX')) select spot, arg_min(futures, rank) as futures from c group by spot")
def s20(t):
    return M.both_markets(*_bases(t))


@query("s21_wallet_status", "select o_orderkey, s in ('working', 'deposit_only') as deposit, s in ('working', 'withdraw_only') as withdraw from (select o_orderkey, ['working', 'deposit_only', 'withdraw_only', 'paused'][o_orderkey % 4 + 1] as s from orders)")
def s21(t):
    status = F.element_at(F.array(*map(F.lit, ("working", "deposit_only", "withdraw_only", "paused"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    s = t.read("orders").select("o_orderkey", status.alias("s"))
    return s.select("o_orderkey", F.col("s").isin(*M.CAN_DEPOSIT).alias("deposit"), F.col("s").isin(*M.CAN_WITHDRAW).alias("withdraw"))


@query("s22_volume_share", f"with p as ({_EXCHANGE}) select round(100 * sum(case when exchange in ('X1', 'X3') then volume else 0 end) / sum(volume), 6) as share from p")
def s22(t):
    return M.volume_share(_pairs(t), ["X1", "X3"]).select(F.round("share", 6).alias("share"))


_RANKED = "select p_brand as symbol, p_name as slug, case when p_size > 5 then p_size end as rank from part"


@query("s23_best_ranked", f"with r as ({_RANKED}) select symbol, slug from r qualify row_number() over (partition by symbol order by rank nulls last, slug) = 1")
def s23(t):
    r = t.read("part").select(F.col("p_brand").alias("symbol"), F.col("p_name").alias("slug"), F.when(F.col("p_size") > 5, F.col("p_size")).alias("rank"))
    return M.best_ranked(r, "symbol", "slug", "rank")


@query("s24_backdated_volume", f"with {BARS}, q as (select symbol, time::date as date, sum(volume) as volume, last(close order by bar_id) as close from bars group by symbol, time::date), e as (select distinct symbol, time::date as date from bars where close < open) select e.symbol, e.date::timestamp as date, round(avg(q.volume * q.close), 4) as dollars, any_value(round(p.close * 1000, 0)) as cap from e left join q on q.symbol = e.symbol and q.date between e.date - 5 and e.date - 1 left join q p on p.symbol = e.symbol and p.date = e.date - 1 group by e.symbol, e.date")
def s24(t):
    day = F.to_date("time")
    q = t.bars.groupBy("symbol", day.alias("date")).agg(F.sum("volume").alias("volume"), F.max_by("close", "bar_id").alias("close"))
    e = t.bars.where("close < open").select("symbol", day.alias("date")).distinct()
    cap = q.select("symbol", F.date_add("date", 1).alias("date"), F.round(F.col("close") * 1000, 0).alias("cap"))
    return M.backdated_volume(e, q, 5).join(cap, ["symbol", "date"], "left").select("symbol", F.col("date").cast("timestamp_ntz").alias("date"), F.round("dollars", 4).alias("dollars"), "cap")


@query("s26_news", "select o_orderpriority as exchange, 'Listing ' || o_orderkey as title, o_orderdate::timestamp as date, '/notice?id=' || o_orderkey as link from orders")
def s26(t):
    notice = F.struct(F.col("o_orderkey").alias("id"), F.concat(F.lit("Listing "), F.col("o_orderkey")).alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("listed_at"))
    pages = t.read("orders").groupBy(F.col("o_orderpriority").alias("exchange"), F.expr("o_orderkey div 50").alias("page")).agg(F.to_json(F.struct(F.struct(F.collect_list(notice).alias("notices")).alias("data"))).alias("json"))
    return M.news(pages)


@query("k14_time_split", f"with {BARS} select symbol, case when time < timestamp '2024-01-15' then 'train' else 'test' end as part, count(*) as n, round(sum(close), 4) as total from bars group by all")
def k14(t):
    part = F.when(F.col("time") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), "train").otherwise("test")
    return t.bars.groupBy("symbol", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("close"), 4).alias("total"))
