"""Registered queries of runs, health, dry runs, clean-up plans and model replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as R
from ..sources import tables as T
from .registry import folder, q
from .registry import table as _t

NOW = "timestamp '2025-06-01 12:00:00'"
_RUNS = """runs as (select cast(o_orderdate as date) as day, substr(o_orderpriority, 1, 1) as source, o_orderstatus <> 'F' as success, o_orderkey % 7 as episodes, o_orderkey % 4 as fetched, o_orderkey % 3 as filtered, o_orderkey % 100 as seconds from orders)"""


def _runs(spark, sf):
    k = F.col("o_orderkey")
    return _t(spark, sf, "orders").select(
        F.to_date("o_orderdate").alias("day"), F.substring("o_orderpriority", 1, 1).alias("source"), (F.col("o_orderstatus") != "F").alias("success"), (k % 7).alias("episodes"), (k % 4).alias("fetched"), (k % 3).alias("filtered"), (k % 100).alias("seconds"))


@q(f"""with {_RUNS} select cast(day as varchar) as day, count(*) as runs, cast(sum(episodes) as bigint) as episodes, count(*) filter (where not success) as failed, coalesce(string_agg(distinct case when not success then source end, ', ' order by case when not success then source end), '') as failed_sources,
case when bool_and(not success) then 'all failed' when bool_or(not success) then 'partial' else 'ok' end as level from runs group by day""")
def q157_cycle_summary(spark, sf):
    """A-18: a day's runs as a cycle."""
    return R.cycle_summary(_runs(spark, sf), "day").withColumn("day", F.col("day").cast("string"))


@q("""select l_suppkey as batch, count(*) as total, count(*) filter (where l_linenumber = 1) as ok, count(*) filter (where l_linenumber = 2) as skipped, count(*) filter (where l_linenumber = 3) as error from lineitem group by 1""")
def q158_batch_totals(spark, sf):
    """A-18."""
    status = F.element_at(F.create_map(F.lit(1), F.lit("ok"), F.lit(2), F.lit("skipped_duplicate"), F.lit(3), F.lit("error")), F.col("l_linenumber").cast("int"))
    return R.batch_totals(_t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("batch"), status.alias("status")), "batch")


@q(f"""with e as (select 'u' || (user_id % 50) as source, ts, event_id, event_id % 7 < 2 as ok, 'E' || event_id as error from events),
g as (select source, max((ts, event_id)) filter (where ok) as good, max(ts) as ran from e group by 1), s as (select e.source, count(*) as streak, arg_max(error, (ts, event_id)) as why from e join g using (source) where not ok and (good is null or (ts, event_id) > good) group by 1)
select source, case when coalesce(streak, 0) >= 6 then 'down' when streak > 0 then 'degraded' else 'ok' end as status, strftime(coalesce(struct_extract(good, 1), ran), '%Y-%m-%d %H:%M:%S') as last_update,
cast(floor((epoch_us({NOW}) - epoch_us(coalesce(struct_extract(good, 1), ran))) / 60000000.0) as bigint) as latency_minutes, why as error from g left join s using (source)
union all select 'never', 'down', '2025-06-01 12:00:00', 0, 'No pipeline runs recorded yet'""")
def q159_source_health(spark, sf):
    """A-21, API-5."""
    k = F.col("event_id")
    d = _t(spark, sf, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("source"), F.col("ts").alias("at"), k.alias("pos"), (k % 7 < 2).alias("ok"), F.concat(F.lit("E"), k.cast("string")).alias("error"))
    now = F.expr(NOW)
    return R.health(d.withColumn("at", F.col("at").cast("timestamp")), now, ["u0", "never"]).withColumn("last_update", F.date_format("last_update", "yyyy-MM-dd HH:mm:ss"))


@q(f"""with {_RUNS}, d as (select source, success, coalesce(nullif(fetched, 0), episodes) as fetched, filtered, episodes, seconds from runs)
select coalesce(source, 'TOTAL') as source, cast(sum(fetched) filter (where success) as bigint) as fetched, cast(sum(filtered) filter (where success) as bigint) as filtered, cast(sum(episodes) filter (where success) as bigint) as normalized, cast(sum(seconds) as bigint) as seconds,
count(*) filter (where not success) as errors from d group by rollup (source)""")
def q160_dry_run_summary(spark, sf):
    """IO-31."""
    return R.dry_run_summary(_runs(spark, sf))


@q("""select 'C' || o_custkey as content_hash, count(*) as again from orders where o_custkey not in (select o_custkey from orders where o_orderkey % 3 <> 2) and o_custkey % 5 <> 0 group by 1""")
def q161_failed_rows_come_again(spark, sf):
    """X-16: rows that the next cycle takes again after the written ones are registered."""
    d = _t(spark, sf, "orders").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("content_hash"), F.element_at(F.array(F.lit("ok"), F.lit("skipped_duplicate"), F.lit("error")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("status"), (F.col("o_custkey") % 5 == 0).alias("old"))
    path = folder(spark, "seen")
    d.where("old").select("content_hash").distinct().write.parquet(path)
    R.newly_written(d, spark.read.parquet(path)).write.mode("append").parquet(path)
    return d.join(spark.read.parquet(path), "content_hash", "left_anti").groupBy("content_hash").agg(F.count("*").alias("again"))


_LEAKY = "case doc_id % 3 when 0 then coalesce(text, '') || ' [end of content] rest' when 1 then text end"


@q("""with d as (select doc_id, case when doc_id % 3 = 0 then trim(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' "' || chr(39)) end as a from documents)
select doc_id, 'body' as property, md5(coalesce(nullif(a, ''), '-')) as new_md5, case when a = '' then 'removed' else 'set' end as action from d where a is not null
union all select doc_id, 'note', md5('-'), 'removed' from documents where doc_id % 4 = 0""")
def q162_leak_plan(spark, sf):
    """X-15: texts cut at a marker, and notes that are nothing but one."""
    note = F.when(F.col("doc_id") % 4 == 0, " ENTITY RESOLUTION RULES: none").otherwise("a note")
    d = _t(spark, sf, "documents").select("doc_id", F.expr(_LEAKY).alias("body"), note.alias("note"))
    return R.leak_plan(d, "doc_id", ["body", "note"]).select("doc_id", "property", F.md5(F.coalesce("new", F.lit("-"))).alias("new_md5"), "action")


@q("""select s_suppkey, case when s_suppkey % 5 = 0 then '' else chr(10) || '[END OF CONTENT]' || chr(10) || chr(10) || 'PRE-EXTRACTED ENTITIES (for reference):' || chr(10) || '- Stock: ' || s_name || ' (T' || s_suppkey || case when s_suppkey % 2 = 0 then ' (sector=Oil; exchange=X)' else ' (exchange=X)' end || ')'
|| chr(10) || '- Person: ' || s_name || chr(10) || '- Stock: none' end as suffix from supplier""")
def q163_entity_suffix(spark, sf):
    """S-29."""
    k, name = F.col("s_suppkey"), F.col("s_name")
    e = lambda n, t, ticker, sector, ex: F.struct(n.alias("name"), F.lit(t).alias("type"), ticker.alias("ticker"), sector.alias("sector"), ex.alias("exchange"))
    none = F.lit(None).cast("string")
    listed = F.array(e(name, "stock", F.concat(F.lit("T"), k.cast("string")), F.when(k % 2 == 0, "Oil"), F.lit("X")), e(name, "person", none, none, none), e(F.lit("none"), "stock", none, none, none))
    return _t(spark, sf, "supplier").select("s_suppkey", R.entity_suffix(F.when(k % 5 != 0, listed)).alias("suffix"))


@q("""with d as (select o_custkey, count(*) filter (where o_orderstatus = 'F') as c, count(*) filter (where o_orderstatus = 'O') as h, min(o_orderpriority) as t from orders group by 1)
select o_custkey, t || ' 可能对 Oil, Gas 板块产生影响。' as impact, '当前整体风险等级 ' || case when c > h then 'HIGH' else 'LOW' end || ' (risk_score=' || printf('%.2f', c / 8.0) || ')。监测到 ' || c || ' 条 critical 级别事件、' || h || ' 条 high 级别事件。建议关注高风险板块并调整防御仓位比例。' as summary from d""")
def q164_risk_texts(spark, sf):
    """S-38."""
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    d = _t(spark, sf, "orders").groupBy("o_custkey").agg(n("F").alias("c"), n("O").alias("h"), F.min("o_orderpriority").alias("t"))
    level = F.when(F.col("c") > F.col("h"), "HIGH").otherwise("LOW")
    return d.select("o_custkey", R.impact_text(F.col("t"), F.array(F.lit("Oil"), F.lit("Gas"))).alias("impact"), R.risk_text(level, F.col("c") / F.lit(8.0), F.col("c"), F.col("h")).alias("summary"))


@q("""select p_partkey, case p_partkey % 6 when 0 then 'edges=[' || p_partkey || ']' when 1 then 'edges=[],note=' when 2 then 'edges=[' || p_partkey || ']' when 3 then 'edges=[],note=n' || p_partkey when 4 then 'edges=[1],more=2,note=' else null end as fields from part""")
def q165_repaired_replies(spark, sf):
    """K-06: a list, a schema, a schema that holds data, objects that lack a field, and no JSON."""
    k = F.col("p_partkey")
    s = k.cast("string")
    text = F.when(k % 6 == 0, F.concat(F.lit(" ["), s, F.lit("] "))).when(k % 6 == 1, '{"properties":{"edges":{"type":"array"}},"type":"object"}').when(k % 6 == 2, F.concat(F.lit('{"properties":{"edges":['), s, F.lit(']},"type":"object"}')))
    text = text.when(k % 6 == 3, F.concat(F.lit('{"note":"n'), s, F.lit('"}'))).when(k % 6 == 4, '{"edges":[1],"more":2}').otherwise("sorry")
    got = R.repaired_reply(text, {"edges": "[]", "note": ""})
    return _t(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(F.transform(F.map_entries(got), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("fields"))


@q("""select 'pulled' as which, 'S' || s_suppkey as symbol, s_name as name_en, '' as sector from supplier union all select 'cached', 'S' || s_suppkey, s_name, '' from supplier""")
def q166_ticker_pull_or_cache(spark, sf):
    """IO-28: a pull becomes the cache; one that fails gives the cache."""
    t = F.struct(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"), F.col("s_name").alias("name_en"))
    base, shots = folder(spark, "tickers"), T.Snapshots(folder(spark, "ticker-cache"))
    _t(spark, sf, "supplier").select(F.array(t).alias("tickers")).write.json(base)
    schema = "tickers array<struct<symbol:string,biz_code:string,name_zh:string,name_en:string,sector:string,exchange:string>>"
    pulled = R.ticker_rows(spark.read.schema(schema).json(base))
    shots.save(pulled)
    first = shots.latest(spark, pulled.schema)
    failed = T.with_fallback(pulled.limit(0), pulled.limit(0), first)  # the second pull gives nothing
    return first.select(F.lit("pulled").alias("which"), "symbol", "name_en", "sector").unionByName(failed.select(F.lit("cached").alias("which"), "symbol", "name_en", "sector"))
