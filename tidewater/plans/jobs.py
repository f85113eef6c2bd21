"""Registered queries of the remaining bodies, nested front matter, a model's rules, the pushed whitelist and the queue's upkeep by command."""

from __future__ import annotations

from importlib.util import find_spec

from pyspark.sql import functions as F

from .. import __main__ as CLI
from ..functions import articles as A
from ..operators import records as C
from ..operators import runs as R
from ..operators import state as Q
from ..operators import upkeep as U
from ..sources import register as G
from ..sources import tables as T
from ..sources import whitelist as W
from .registry import folder, q
from .registry import table as _t
from .upkeep import _FILES, START, _landed, _registered

NOW = "timestamp '2025-06-01 12:00:00'"


@q("""with d as (select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, (o_orderkey % 500) / 100.0 as two, (o_orderkey % 7 * 10) / 100.0 as gap, o_orderkey % 4 > 0 as pair from orders),
e as (select *, two + gap - 0.3 as ten, round((gap - 0.3) * 100) as bp from d)
select o_orderkey, case when o_orderkey % 9 = 8 then null else concat('美国国债收益率曲线（', day, '）：3个月期1.50%', case when pair then printf('，2年期%.2f%%，10年期%.2f%%', two, ten) else '' end, '。', case when pair then concat('2s10s利差', case when bp > 0 then '+' else '' end, bp::int, 'bp，',
case when bp > 0 then '收益率曲线形态正常，无倒挂风险信号。' when bp > -25 then '收益率曲线形态趋平，接近倒挂区间。' else '收益率曲线形态倒挂，倒挂是衰退预警信号。' end) else '' end) end as told,
case when o_orderkey % 9 = 8 then null else concat('## US Treasury Yield Curve — ', day, chr(10), chr(10), '- 3mo: 1.50%', case when pair then printf('
- 2yr: %.2f%%
- 10yr: %.2f%%', two, ten) else '' end, chr(10), case when pair then concat(chr(10), printf('Spread (2s10s): %.1f bp | Shape: ', bp),
case when bp > 0 then 'normal' when bp > -25 then 'flat' else 'inverted' end) else '' end) end as listed from e""")
def q167_curve_bodies(spark, sf):
    """S-20, S-21: the yield curve as sentences and as a list; `1.5mo` has no name, and a day without rates has no body."""
    k = F.col("o_orderkey")
    two, ten = (k % 500) / 100, (k % 500 + k % 7 * 10 - 30) / 100
    one = lambda term, v: F.create_map(F.lit(term), v)
    both = F.map_concat(one("1.5mo", F.lit(9.0)), one("3mo", F.lit(1.5)), one("2yr", two), one("10yr", ten))
    rates = F.when(k % 9 == 8, F.create_map().cast("map<string,double>")).when(k % 4 > 0, both).otherwise(one("3mo", F.lit(1.5)))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return _t(spark, sf, "orders").select("o_orderkey", C.curve_text(rates, day).alias("told"), C.curve_list(rates, day).alias("listed"))


@q("""with d as (select c_custkey as k, (['gdp', 'cpi', 'ppi', 'pmi', 'caixin_pmi', 'm2'])[c_custkey % 6 + 1] as i, (c_custkey % 200) / 4.0 - 1 as v, strftime(date '2024-01-01' + (c_custkey % 300)::int, '%Y-%m-%d') as day from customer)
select k as c_custkey, case when k % 11 = 0 then null when i = 'm2' then printf('## China m2 — %s

- Value: %.2f
- Frequency: unknown
', day, v) else concat('中国', case i when 'gdp' then 'GDP（国内生产总值）' when 'cpi' then 'CPI（居民消费价格指数）' when 'ppi' then 'PPI（工业生产者出厂价格指数）' when 'pmi' then 'PMI（官方制造业采购经理指数）' else 'PMI（财新制造业采购经理指数）' end,
'，', day, '：', case i when 'gdp' then '同比增长' else '' end, printf('%.2f', v), case when i in ('gdp', 'cpi', 'ppi') then '%' else '' end, '。', case i when 'gdp' then '衡量中国经济总体规模的核心指标' when 'cpi' then '衡量通胀水平的核心指标' when 'ppi' then '衡量工业品价格变化，反映上游成本压力' when 'pmi' then '50以上为扩张区间，以下为收缩区间' else '偏向中小企业，与官方PMI互为补充' end, '。') end as told,
case when k % 11 = 0 then null else concat('## China ', case i when 'pmi' then 'PMI (Official Manufacturing)' when 'caixin_pmi' then 'PMI (Caixin Manufacturing)' when 'm2' then 'm2' else upper(i) end, ' — ', day, chr(10), chr(10), printf('- Value: %.2f', v), case i when 'gdp' then ' 亿元' when 'cpi' then ' %' when 'ppi' then ' %' else '' end, chr(10), '- Frequency: ', case i when 'gdp' then 'quarterly' when 'm2' then 'unknown' else 'monthly' end, chr(10),
case when i in ('gdp', 'm2') then '' else concat(chr(10), '**Interpretation**: ', case when i like '%pmi' then case when v > 50 then 'Expansion (above 50 threshold)' else 'Contraction (below 50 threshold)' end when i = 'cpi' then case when v > 3 then 'High inflation (above 3% target)' when v < 0 then 'Deflation (negative CPI)' else 'Moderate inflation' end when v > 0 then 'Producer price inflation' else 'Producer price deflation' end) end) end as listed from d""")
def q168_china_bodies(spark, sf):
    """S-20 of China's series, told and listed."""
    k = F.col("c_custkey")
    i = F.element_at(F.array(*[F.lit(x) for x in ("gdp", "cpi", "ppi", "pmi", "caixin_pmi", "m2")]), (k % 6 + 1).cast("int"))
    v = F.when(k % 22 == 0, F.lit(float("nan"))).when(k % 11 > 0, (k % 200) / 4 - 1)
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int")), "yyyy-MM-dd")
    return _t(spark, sf, "customer").select("c_custkey", C.china_body(i, v, day).alias("told"), C.china_body(i, v, day, {}).alias("listed"))


@q("""select doc_id, md5('Notice ' || doc_id || case when length(coalesce(text, '')) > length('Notice ' || doc_id) then chr(10) || chr(10) || text else '' end) as body from documents""")
def q169_notice_bodies(spark, sf):
    """S-20 of telegraphs and announcements."""
    return _t(spark, sf, "documents").select("doc_id", F.md5(C.notice_body(F.concat(F.lit("Notice "), F.col("doc_id").cast("string")), F.col("text"))).alias("body"))


if find_spec("yaml"):

    @q("""select p_partkey, case p_partkey % 4 when 3 then '{}' else concat('{"title": "', p_name, '", "tags": ["a", "b: c", ', p_partkey, '], "by": {"name": "', p_brand, '", "on": "2024-01-05", "ok": true}, "none": null}') end as metadata, case p_partkey % 4 when 3 then concat('--- no fence', chr(10), p_name) else concat('# ', p_name, chr(10), '---', chr(10)) end as body from part""")
    def q170_nested_front_matter(spark, sf):
        """S-37: lists, nested maps, dates, flags and nulls; a text without fences."""
        name, k = F.col("p_name"), F.col("p_partkey")
        block = F.concat(F.lit("---\ntitle: '"), name, F.lit("'\ntags:\n  - a\n  - 'b: c'\n  - "), k.cast("string"), F.lit("\nby: {name: '"), F.col("p_brand"), F.lit("', 'on': 2024-01-05, ok: yes}\nnone:\n---\n# "), name, F.lit("\n---\n"))
        x = A.front_matter_tree(F.when(k % 4 == 3, F.concat(F.lit("--- no fence\n"), name)).otherwise(block))
        return _t(spark, sf, "part").select("p_partkey", x.alias("x")).select("p_partkey", "x.metadata", "x.body")


@q("""select s_suppkey, concat('Rules', case when s_suppkey % 2 = 0 then ' (stocks)' else '' end, ': 银行 (bank), 能源, Oil (oil)', case when s_suppkey % 5 = 0 then '' else concat(chr(10), chr(10), 'ENTITY RESOLUTION RULES:', chr(10), '1. Use the canonical names listed below as the preferred forms for entity resolution', chr(10),
'2. Do NOT add or remove suffixes (Ltd, Inc, Corp, 控股, etc.)', chr(10), '3. If the same entity appears with different names, use the FIRST name listed', chr(10), chr(10), 'CANONICAL ENTITY NAMES:', chr(10), '- ', s_name, ' (T', s_suppkey, ')', chr(10), '- N', s_nationkey) end) as rules from supplier""")
def q171_extraction_rules(spark, sf):
    """S-30."""
    k = F.col("s_suppkey")
    none = F.array().cast("array<string>")
    s = lambda n, a: F.struct(F.lit(n).alias("name"), a.alias("aliases"))
    names = R.sector_names(F.array(s("银行", F.array(F.lit("银行业"), F.lit("bank"), F.lit("banks"))), s("能源", none), s("Oil", F.array(F.lit("oil")))))
    e = lambda n, t: F.struct(n.alias("name"), t.alias("ticker"))
    own = F.when(k % 5 > 0, F.array(e(F.col("s_name"), F.concat(F.lit("T"), k.cast("string"))), e(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")), F.lit(None).cast("string"))))
    return _t(spark, sf, "supplier").select("s_suppkey", R.extraction_rules(k % 2 == 0, F.concat(F.lit("Rules (stocks): "), names), F.concat(F.lit("Rules: "), names), own).alias("rules"))


@q("""select 'T' || s_suppkey as ticker, s_name as name, 'B' || s_suppkey as biz_code, '2025-06-01T20:00:00+08:00' as updated_at, 'push' as source from supplier where s_suppkey % 3 > 0""")
def q172_whitelist_push(spark, sf):
    """API-6, IO-27: a push replaces the whole list; one with a row that lacks its code changes nothing."""
    k = F.col("s_suppkey").cast("string")
    rows = _t(spark, sf, "supplier").select(F.concat(F.lit("T"), k).alias("ticker"), F.lit("Oil").alias("sector"), F.concat(F.lit("B"), k).alias("biz_code"), F.col("s_name").alias("name"), "s_suppkey")
    shots = T.Snapshots(folder(spark, "whitelist"))
    now = F.expr(NOW)
    said = [W.push(d, shots, now).first().status for d in (rows, rows.where("s_suppkey % 3 > 0"), rows.withColumn("biz_code", F.expr("if(s_suppkey % 2 = 0, null, biz_code)")))]
    if said != ["ok", "ok", "invalid"]:
        raise AssertionError(said)
    return W.latest(spark, shots).select("ticker", "name", "biz_code", "updated_at", "source")


_STATES = f"""{_FILES}, st as (select h, p.f as f, split_part(split_part(p.f, '/', 2), '-', 1) as source, left(p.f, 10) as day, case when h[1:1] < '4' then 'done' when h[1:1] < '8' then 'skipped' when h[1:1] < 'a' then 'dead' else 'processing' end as told, status from idx)"""


def _upkeep(spark, sf):
    """All landed files as index, and a log of what became of the first two cycles' rows."""
    lines, index, _ = _registered(spark, _landed(spark, sf))
    index = T.written(G.rebuild(lines, index, F.expr(START))[0], "upkeep-index")
    log = index.where("status = 'done'").select("content_hash", F.lit(3).cast("long").alias("seq"), F.expr("case when left(content_hash, 1) < '4' then 'done' when left(content_hash, 1) < '8' then 'skipped' when left(content_hash, 1) < 'a' then 'dead' else 'processing' end").alias("status"), F.lit(2).alias("attempts"), F.lit("w").alias("owner"), F.expr(START).alias("until"), F.expr(START).alias("at"))
    return index, log


@q(f"""with {_STATES}, x as (select case when status = 'done' then told else status end as status, source, day from st)
select 'status' as kind, status as value, count(*) as n from x group by 2 union all select 'source_type', source, count(*) from x group by 2 union all select 'day', day, count(*) from x group by 2 union all select 'total', null, count(*) from x""")
def q173_queue_stats(spark, sf):
    """API-8 --stats, A-01: by status, source and day, and in total."""
    return U.stats(*_upkeep(spark, sf))


@q(f"""with {_STATES} select 'replay' as mode, h as content_hash, 4 as seq, 'pending' as status, 0 as attempts from st where status = 'done' and told in ('done', 'skipped') and source = 'S1' and day = '2024-01-02'
union all select 'dead', h, 4, 'pending', 0 from st where status = 'done' and told = 'dead' union all select 'new', h, 0, 'pending', 0 from st where status = 'pending'""")
def q174_replay_modes(spark, sf):
    """API-8 --replay with a range and a source, --retry-dead, and states that the log lacks."""
    index, log = _upkeep(spark, sf)
    now = F.expr(NOW)
    day = F.lit(U.moment("2024-01-02")), F.lit(U.moment("2024-01-02", end=True))
    say = lambda mode, d: d.select(F.lit(mode).alias("mode"), "content_hash", "seq", "status", "attempts")
    return say("replay", U.replay(index, log, now, *day, "S1")).unionByName(say("dead", U.retry_dead(log, now))).unionByName(say("new", U.missing_states(index, log, now)))


@q(f"""with {_FILES}, every as (select h, min({{'f': batch_file, 'n': line_no}}) as p from lines where not bad group by h), x as (select split_part(split_part(p.f, '/', 2), '-', 1) as source, left(p.f, 10) as day from every)
select 'status' as kind, 'pending' as value, count(*) as n from x having count(*) > 0 union all select 'source_type', source, count(*) from x group by 2 union all select 'day', day, count(*) from x group by 2 union all select 'total', null, count(*) from x""")
def q175_rebuild_by_command(spark, sf):
    """API-8 --rebuild-index, twice, then --stats: the second finds nothing new."""
    args = ["--queue", folder(spark, "queue"), "--landed", _landed(spark, sf)]
    first, second = (CLI.run(spark, CLI.arguments([*args, "--rebuild-index"])).first().n for _ in range(2))
    if second or not first:
        raise AssertionError((first, second))
    return CLI.run(spark, CLI.arguments([*args, "--stats"]))
