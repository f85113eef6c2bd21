"""Registered queries of scalar rules, each over a whole table whose columns are put into the form that the rule reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import filters as X
from .registry import q
from .registry import table as _t

# expressions that Spark and DuckDB read alike
_MARKED = "concat('a &amp;lt; <b class=\"x\">', coalesce(text, ''), '</b> &quot;y&quot;&nbsp;&#39;z&#39; &gt;')"


@q(f"""with t as (select doc_id, concat({_MARKED}, chr(7), 'e') t from documents)
select doc_id, regexp_replace(replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') as cleaned from t""")
def q75_unescape_and_clean(spark, sf):
    """S-03, S-04."""
    return _t(spark, sf, "documents").select("doc_id", S.clean_text(F.concat(F.expr(_MARKED), F.chr(F.lit(7)), F.lit("e"))).alias("cleaned"))


@q(f"""with t as (select doc_id, {_MARKED} t from documents), n as (select doc_id, t, regexp_replace(t, '<[^>]+>', '', 'g') n from t)
select doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(n, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) as html,
trim(replace(replace(replace(replace(n, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')) as telegraph,
trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(t, '&[a-zA-Z]+;|&#[0-9]+;', ' ', 'g'), '<[^>]+>', '', 'g'), chr(9), ' '), ' +', ' ', 'g'), '[\\x00-\\x09\\x0B-\\x1F]', '', 'g')) as extracted from n""")
def q76_strip_variants(spark, sf):
    """S-05, S-06, S-08."""
    t = F.expr(_MARKED)
    return _t(spark, sf, "documents").select("doc_id", S.strip_html(t).alias("html"), S.strip_html_telegraph(t).alias("telegraph"), S.clean_extracted(t).alias("extracted"))


@q("""select doc_id, array_to_string(list_filter(regexp_extract_all(concat('经济 a 数 12中文bc', coalesce(text, '')), '[\\x{4e00}-\\x{9fff}]+|[A-Za-z]+'), lambda x: length(x) >= 2)[1:10], ',') as words from documents""")
def q77_keyword_runs(spark, sf):
    """S-10, T-07."""
    return _t(spark, sf, "documents").select("doc_id", F.array_join(S.keywords_runs(F.concat(F.lit("经济 a 数 12中文bc"), F.coalesce("text", F.lit("")))), ",").alias("words"))


@q("""select c_custkey, concat(replace(c_name, '#', '-'), ',', c_mktsegment) as persons, concat(c_mktsegment, ', ', replace(c_name, '#', '-'), ';', replace(c_name, '#', '-')) as locations from customer""")
def q78_person_and_place_lists(spark, sf):
    """S-17, S-18."""
    name = F.replace("c_name", F.lit("#"), F.lit("-"))
    people = F.concat(name, F.lit("; ;x#1;"), "c_mktsegment", F.lit(" ;"))
    places = F.concat(F.lit("4#a#b#"), "c_mktsegment", F.lit(" , mid, "), name, F.lit("#x|1#US#US# "), name, F.lit("#|bad|2#a#b##"))
    return _t(spark, sf, "customer").select("c_custkey", F.array_join(S.persons(people), ",").alias("persons"), F.array_join(S.locations(places), ";").alias("locations"))


@q("""select p_partkey, concat(trim(p_brand), ',', p_partkey) as programs, case p_partkey % 4 when 0 then 'person' when 1 then 'vessel' when 2 then 'aircraft' else 'legalEntity' end as target_type from part""")
def q79_sanction_programs_and_types(spark, sf):
    """S-26, S-27, F-23."""
    k = F.col("p_partkey")
    kind = F.when(k % 4 == 0, "Individual ").when(k % 4 == 1, " vessel").when(k % 4 == 2, "AIRCRAFT")
    return _t(spark, sf, "part").select("p_partkey", F.array_join(S.programs(F.concat(F.lit("["), F.trim("p_brand"), F.lit("] [-0-] ["), k.cast("string"), F.lit("]"))), ",").alias("programs"), S.target_type(kind).alias("target_type"))


_LABELS = ["Entity,Sector", "stock", "COUNTRY,PERSON", "Policy", "topic", "Organization", "EVENT", "person,thing", "thing", "thing,other"]


@q("""select event_id, (['sector','stock','country','policy','topic','organization','event','person','unknown','stock'])[event_id % 10 + 1] as kind from events""")
def q80_entity_types(spark, sf):
    """S-35: by label in priority order, then by ticker."""
    i = F.col("event_id") % 10
    labels = F.split(F.element_at(F.array(*map(F.lit, _LABELS)), (i + 1).cast("int")), ",")
    return _t(spark, sf, "events").select("event_id", S.entity_type(labels, F.when(i == 9, "T1").when(i == 8, "")).alias("kind"))


@q("""select o_orderkey, case when o_orderkey % 7 <> 0 then strftime(o_orderdate, '%Y-%m-%d') end as day, case when o_orderkey % 7 <> 0 then strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') else '2024-01-31 00:00:00' end as stamp,
case o_orderkey % 3 when 0 then strftime(o_orderdate, '%Y-%m-01') when 1 then strftime(o_orderdate, '%Y-12-31') end as period,
case o_orderkey % 3 when 0 then strftime(o_orderdate, '%Y-%m-01') when 1 then strftime(o_orderdate, '%Y-%m-%d') end as month_or_day,
case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y-%m-01') when 1 then concat(year(o_orderdate), '-', lpad(cast(3 * quarter(o_orderdate) as varchar), 2, '0'), '-01') when 2 then concat(year(o_orderdate), '-12-01') else strftime(o_orderdate, '%Y-%m-%d') end as chinese,
strftime(o_orderdate - interval 8 hour, '%Y-%m-%d %H:%M:%S') as china_time, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as iso from orders""")
def q81_dates(spark, sf):
    """D-01 to D-06, D-09, D-11."""
    at, k = F.col("o_orderdate"), F.col("o_orderkey")
    fmt = lambda f: F.date_format(at, f)
    text = lambda c, f="yyyy-MM-dd": F.date_format(c, f)
    full = "yyyy-MM-dd HH:mm:ss"
    year = F.year(at).cast("string")
    local = F.when(k % 2 == 0, fmt(full)).otherwise(fmt("yyyy/MM/dd HH:mm:ss"))
    chinese = F.when(k % 4 == 0, F.concat(year, F.lit("年"), F.month(at).cast("string"), F.lit("月份"))).when(k % 4 == 1, F.concat(year, F.lit("年第"), F.quarter(at).cast("string"), F.lit("季度"))).when(k % 4 == 2, F.concat(year, F.lit("年第1-4季度"))).otherwise(fmt("yyyy-MM-dd"))
    return _t(spark, sf, "orders").select(
        "o_orderkey",
        text(S.day(F.when(k % 7 == 0, "2024-1").otherwise(fmt("yyyyMMdd")))).alias("day"),
        text(S.stamp(F.when(k % 7 == 0, "x").otherwise(F.concat(fmt("yyyyMMddHHmmss"), F.lit("99"))), F.lit("2024-01-31").cast("timestamp")), full).alias("stamp"),
        text(S.period_date(year, F.when(k % 3 == 0, F.concat(F.lit("M"), fmt("MM"))).when(k % 3 == 1, "M13").otherwise("S01"))).alias("period"),
        text(S.month_or_day(F.when(k % 3 == 0, fmt("yyyy-MM")).when(k % 3 == 1, fmt("yyyy-MM-dd")).otherwise("soon"))).alias("month_or_day"),
        text(S.chinese_date(chinese)).alias("chinese"), text(S.china_time(local), full).alias("china_time"), S.iso(at).alias("iso"),
    )


@q("""select p_partkey, cast(1000 + p_size as integer) as i, case when p_partkey % 2 = 0 then p_size + 0.5 end as d, case when p_partkey % 2 = 0 then p_size else 0 end as bad from part""")
def q82_safe_numbers(spark, sf):
    """K-05."""
    n, even = F.col("p_size").cast("string"), F.col("p_partkey") % 2 == 0
    return _t(spark, sf, "part").select(
        "p_partkey", S.safe_int(F.concat(F.lit(" 1,"), F.lpad(n, 3, "0"), F.lit(".7 "))).alias("i"),
        S.safe_double(F.when(even, F.concat(F.lit(" "), n, F.lit(".5"))).otherwise("n/a")).alias("d"), S.safe_int(F.when(even, n).otherwise("none")).alias("bad"),
    )


@q("select page_id, page_id % 4 in (0, 1) as excluded from pages")
def q83_excluded_urls(spark, sf):
    """F-08."""
    k = F.col("page_id") % 4
    url = F.when(k == 0, "https://www.bbc.co.uk/sounds/").when(k == 1, "https://bbc.co.uk/play/").when(k == 2, "https://bbc.co.uk/news/").otherwise("https://other.org/sounds/")
    return _t(spark, sf, "pages").select("page_id", X.excluded_url(F.concat(url, F.col("page_id").cast("string"))).alias("excluded"))


@q("""select event_id, case event_id % 4 when 0 then event_id / 1000.0 when 1 then cast(event_id as double) when 2 then event_id * 60.0 else event_id * 3600.0 end as seconds from events""")
def q84_durations(spark, sf):
    """M-04."""
    unit = F.element_at(F.array(*map(F.lit, ("ms", "s", "m", "h"))), (F.col("event_id") % 4 + 1).cast("int"))
    return _t(spark, sf, "events").select("event_id", S.seconds_of(F.concat(F.col("event_id").cast("string"), unit)).alias("seconds"))


@q("""select o_orderkey, concat('evt-', case when hour(o_orderdate) >= 16 then strftime(o_orderdate + interval 1 day, '%Y%m%d') else strftime(o_orderdate, '%Y%m%d') end, '-', upper(substr(replace(concat('a-b', cast(o_orderkey as varchar)), '-', ''), 1, 3))) as event_id from orders""")
def q85_event_ids(spark, sf):
    """S-33 (quirk Q6: ids collide), with the order's time as now."""
    return _t(spark, sf, "orders").select("o_orderkey", S.event_id(F.concat(F.lit("a-b"), F.col("o_orderkey").cast("string")), F.col("o_orderdate")).alias("event_id"))


_BODY = "concat('  ', chr(10), ' head of ', coalesce(source, ''), ' ', chr(10), case when doc_id % 5 > 0 then coalesce(text, '') else ' short ' end, chr(10), ' ')"


@q(f"""with b as (select doc_id, regexp_replace({_BODY}, '^\\s+', '') b from documents), r as (select doc_id, b, regexp_replace(substr(b, instr(b, chr(10)) + 1), '^\\s+|\\s+$', '', 'g') r from b)
select doc_id, trim(left(trim(split_part(b, chr(10), 1)), 200)) as title, case when length(r) > 10 then left(r, 500) end as summary from r""")
def q86_title_and_summary(spark, sf):
    """S-34."""
    body = F.expr(_BODY)
    return _t(spark, sf, "documents").select("doc_id", S.first_line(body).alias("title"), S.summary_of(body).alias("summary"))


@q("select doc_id, md5(sha1(concat('app=1&id=', cast(doc_id as varchar)))) as sign from documents")
def q87_request_signature(spark, sf):
    """S-31."""
    return _t(spark, sf, "documents").select("doc_id", S.signature(F.concat(F.lit("app=1&id="), F.col("doc_id").cast("string"))).alias("sign"))


@q("""select o_orderkey, case when o_orderkey % 3 = 0 then 'INVOLVES' when o_orderkey % 3 = 1 then 'AFFECTS' else 'AFFECTS' end as name, o_orderkey % 3 <> 2 as changed from orders""")
def q88_edge_renormalization(spark, sf):
    """X-13, X-14: a generic name from its fact, a retired one by prefix, a core one stays."""
    from ..operators import graph as G

    k = F.col("o_orderkey") % 3
    edges = _t(spark, sf, "orders").select("o_orderkey", F.when(k == 0, "RELATES_TO").when(k == 1, "IMPACTS").otherwise("AFFECTS").alias("name"), F.when(k == 0, "He joined the board").otherwise("It was so").alias("fact"))
    old = F.col("name")
    return G.renormalize(edges.withColumn("old", old)).select("o_orderkey", "name", (F.col("old") != F.col("name")).alias("changed"))
