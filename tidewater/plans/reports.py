"""Registered queries of briefings, fallbacks, audits, record bodies, vendor readers and composed answers."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..functions import articles as A
from ..functions import scalars as S
from ..operators import answers as W
from ..operators import audit as U
from ..operators import briefings as B
from ..operators import filters as X
from ..operators import graph as G
from ..operators import records as C
from ..operators import state as Q
from ..sources import files as IO
from ..sources import tables as T
from ..streaming.watch import fetched_only
from .answers import NOW, _episodes, _entities, _LOW
from .catalogue import _CUR, _log
from .registry import folder, q
from .registry import table as _t


def _s(c):
    return F.col(c).cast("string")


# briefings


def _items(spark, sf, changed: str):
    none = F.array().cast("array<string>")
    updated = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.expr(f"if({changed}, '*', '')"))
    return _t(spark, sf, "orders").select(
        F.concat(F.lit("C"), _s("o_custkey")).alias("sector"), F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("title"), F.lit("high").alias("severity"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("first_seen"),
        updated.alias("last_updated"), F.lit(1).alias("source_count"), F.lit(None).cast("string").alias("summary"), F.array(F.col("o_orderstatus")).alias("tickers"), none.alias("keywords"), F.col("o_orderdate").alias("created_at"))


@q("""with t as (select *, 'C' || o_custkey as sector, strftime(o_orderdate, '%Y-%m-%d') || case when o_orderkey % 50 = 0 then '*' else '' end as u from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) <= 20)
select sector, left(sha256(string_agg(o_orderkey || ':' || u, '|' order by cast(o_orderkey as varchar))), 16) as fingerprint, concat('## 行业: ', sector, chr(10), '## 统计: 总事件 ', count(*), ' 个, 涉及 ', count(distinct o_orderstatus), ' 只标的') as head
from t group by sector having bool_or(o_orderkey % 50 = 0)""")
def q126_briefing_refresh(spark, sf):
    """API-7, A-17: after a first run, only sectors with a changed event are written; a third run writes nothing."""
    path = folder(spark, "briefings")
    day = lambda n: F.lit(f"2024-01-0{n} 00:00:00").cast("timestamp")
    B.refresh(spark, path, _items(spark, sf, "false"), day(1))
    B.refresh(spark, path, _items(spark, sf, "o_orderkey % 50 = 0"), day(2))
    if not B.refresh(spark, path, _items(spark, sf, "o_orderkey % 50 = 0"), day(3)).isEmpty():
        raise AssertionError("nothing changed, but a briefing was written")
    now = spark.read.schema(B.CACHE).parquet(path).where(F.col("generated_at") == day(2))
    return now.select("sector", "fingerprint", F.regexp_extract("briefing", r"(?s)^(.*?)\n\n", 1).alias("head"))


# fallback

@q("""select 'events' as which, o_orderkey as id, 1 as tier, false as degraded, null as domain from orders where o_orderkey % 3 = 0 union all
select 'gkg', c_custkey, 2, true, c_mktsegment from customer where c_custkey % 2 = 0 union all select 'cached', c_custkey, 3, true, c_mktsegment from customer where c_custkey % 2 = 0""")
def q127_fallback_tiers(spark, sf):
    """J-19, F-25: events; without any, the second source; without that, the last good result."""
    shots = T.Snapshots(folder(spark, "last-good"))
    events = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    gkg = _t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("domain"))
    out = None
    for which, e, g in (("events", "id % 3 = 0", "true"), ("gkg", "false", "id % 2 = 0"), ("cached", "false", "false")):
        d = T.fetch_or_last_good(events.where(e), gkg.where(g), shots).select(F.lit(which).alias("which"), "id", "tier", "degraded", "domain")
        out = d if out is None else out.unionByName(d)
    return out


# audits and plans of edges


def _facts(spark, sf):
    """Edges of every order: names and facts of all families, loose and retired ones among them."""
    k = F.col("o_orderkey")
    names = F.element_at(F.array(*map(F.lit, ("RELATES_TO", "RELATES_TO", "INVOLVES", "INVESTS_IN", "EXPOSED_TO", "AFFECTS", "PART_OF"))), (k % 7 + 1).cast("int"))
    facts = F.element_at(F.array(*map(F.lit, _FACTS)), (k % len(_FACTS) + 1).cast("int"))
    return _t(spark, sf, "orders").select(k.alias("id"), F.concat(F.lit("N"), (k % 40).cast("string")).alias("src"), F.concat(F.lit("N"), (F.col("o_custkey") % 50).cast("string")).alias("dst"), names.alias("name"), facts.alias("fact"))


_FACTS = ("A subsidiary of it", "It acquired a firm", "She joined it", "Its chairman spoke", "It became the largest", "He partners with it", "It threatens trade", "It led to losses", "It took place in Rome", "It was so", "It is a key part of a group")
_CORES = ("PART_OF", "PART_OF", "INVOLVES", "INVOLVES", None, None, "AFFECTS", "TRIGGERS", "HAPPENED_IN", None, "PART_OF")
_OLD = ("SUBSIDIARY_OF", "ACQUIRED_BY", "EMPLOYED_BY", "CHAIRMAN_OF", None, None, "AFFECTS", "TRIGGERS", "HAPPENED_IN", None, "PART_OF")
_list = lambda x: "[" + ", ".join("null" if v is None else f"'{v}'" for v in x) + "]"
_EDGES = f"""e as (select o_orderkey as id, concat('N', o_orderkey % 40) as src, concat('N', o_custkey % 50) as dst, (['RELATES_TO','RELATES_TO','INVOLVES','INVESTS_IN','EXPOSED_TO','AFFECTS','PART_OF'])[o_orderkey % 7 + 1] as name,
({_list(_FACTS)})[o_orderkey % 11 + 1] as fact, ({_list(_CORES)})[o_orderkey % 11 + 1] as core, ({_list(_OLD)})[o_orderkey % 11 + 1] as legacy from orders)"""


@q(f"""with {_EDGES}, s as (select core, string_agg(x, '; ' order by x) as samples from (select core, id || ': ' || fact as x from e where name = 'RELATES_TO' and core is not null qualify row_number() over (partition by core order by x) <= 3) group by 1)
select legacy, e.core, count(*) as n, any_value(s.samples) as samples from e left join s on s.core = e.core where name = 'RELATES_TO' group by 1, 2""")
def q128_edge_migration_counts(spark, sf):
    """A-16, S-24: all five families, edges kept, three samples of each core."""
    d = G.migration_counts(_facts(spark, sf))
    return d.select("legacy", "core", "n", F.when(F.col("samples").isNotNull(), F.array_join("samples", "; ")).alias("samples"))


@q(f"""with {_EDGES} select id, case name when 'RELATES_TO' then 1 when 'INVOLVES' then 2 else 3 end as stage, case when name = 'RELATES_TO' then legacy end as legacy, name as from_name, coalesce(core, 'RELATES_TO') as name
from e where (name = 'RELATES_TO' and core is not null) or (name = 'INVOLVES' and (fact like '%became%' or fact like '%partners%')) or name in ('INVESTS_IN', 'EXPOSED_TO')""")
def q129_edge_renormalization_plan(spark, sf):
    """X-14: three stages; INVOLVES edges with a loose fact are judged again."""
    return G.renormalization_plan(_facts(spark, sf))


@q(f"""with {_EDGES} select id, case when name = 'INVOLVES' and (fact like '%became%' or fact like '%partners%') then 'RELATES_TO' when name in ('RELATES_TO', 'INVESTS_IN', 'EXPOSED_TO') then coalesce(core, 'RELATES_TO') else name end as name from e""")
def q130_edges_renormalized(spark, sf):
    """X-13, X-14: a second run changes nothing."""
    return G.renormalize(G.renormalize(_facts(spark, sf))).select("id", "name")


@q("""with g as (select left(sha256(coalesce(text, '')), 12) as suffix, concat('rss-', doc_id, '-', left(sha256(coalesce(text, '')), 12)) as name from documents),
t as (select suffix, count(*) as n from g group by 1 having n > 1 order by n desc, suffix limit 20)
select t.suffix, any_value(t.n) as n, string_agg(name, ',' order by name) as names from (select * from g qualify row_number() over (partition by suffix order by name) <= 3) g join t on t.suffix = g.suffix group by 1""")
def q131_largest_duplicate_groups(spark, sf):
    """A-15: the 20 largest, three names of each; the limits are the feature."""
    digest = F.left(F.sha2(F.coalesce("text", F.lit("")), 256), F.lit(12))
    e = _t(spark, sf, "documents").select(F.concat(F.lit("rss-"), _s("doc_id"), F.lit("-"), digest).alias("name"))
    return U.duplicate_names(e).select("suffix", "n", F.array_join("names", ",").alias("names"))


_NODES = """v as (select c_custkey as k, concat('N', c_custkey % 60) as name, case c_custkey % 3 when 0 then 'Stock' when 1 then 'Sector' else 'Topic' end as label, case when c_custkey % 2 = 0 then 'T' end as ticker from customer where c_custkey <= 60 union all
select c_custkey, c_name || case c_custkey % 5 when 0 then ' reuters' when 1 then ' MOUTAI' else '' end, case when c_custkey % 3 = 0 then 'Stock' end, case when c_custkey % 4 = 0 then 'T' when c_custkey % 4 = 1 then '' end from customer where c_custkey > 60)"""


@q(f"""with {_EDGES}, {_NODES}, o as (select name as n, min(coalesce(label, '')) as label from v group by 1), b as (select e.name, count(*) as n from e join e f on e.src = f.dst and e.dst = f.src and e.name = f.name where e.src < e.dst group by 1),
d as (select left(sha256(coalesce(text, '')), 12) as s, count(*) as n from documents group by 1)
select 'nodes' as check, '*' as key, count(*) as n from v union all select 'nodes by label', coalesce(label, ''), count(*) from v group by 2 union all
select 'ticker', case when coalesce(ticker, '') <> '' then 'with' else 'without' end, count(*) from v where label = 'Stock' group by 2 union all select 'media', name, count(*) from v where name like '%reuters%' group by 2 union all
select 'alias Moutai', name, count(*) from v where name like '%MOUTAI%' group by 2 union all select 'edges', '*', count(*) from e union all select 'edges by name', name, count(*) from e group by 2 union all
select 'PART_OF by target', coalesce(o.label, ''), count(*) from e left join o on o.n = e.dst where e.name = 'PART_OF' group by 2 union all
select 'edges by labels', concat(coalesce(p.label, ''), '→', coalesce(o.label, '')), count(*) from e left join o on o.n = e.dst left join o p on p.n = e.src group by 2 union all select 'opposite edges', name, n from b union all
select 'episodes', '*', sum(n) from d union all select 'episodes', 'groups', count(*) from d where n > 1 union all select 'episodes', 'in groups', coalesce(sum(n), 0) from d where n > 1""")
def q132_graph_audit(spark, sf):
    """API-9, A-13: all eight checks, one grouped count a table."""
    k = F.col("c_custkey")
    low = k <= 60
    label = F.when(low, F.element_at(F.array(F.lit("Stock"), F.lit("Sector"), F.lit("Topic")), (k % 3 + 1).cast("int"))).when(k % 3 == 0, "Stock")
    name = F.when(low, F.concat(F.lit("N"), (k % 60).cast("string"))).otherwise(F.concat("c_name", F.when(k % 5 == 0, " reuters").when(k % 5 == 1, " MOUTAI").otherwise("")))
    ticker = F.when(F.when(low, k % 2 == 0).otherwise(k % 4 == 0), "T").when(~low & (k % 4 == 1), "")
    nodes = _t(spark, sf, "customer").select(name.alias("name"), F.array_compact(F.array(label)).alias("labels"), ticker.alias("ticker"))
    digest = F.left(F.sha2(F.coalesce("text", F.lit("")), 256), F.lit(12))
    episodes = _t(spark, sf, "documents").select(F.concat(F.lit("n-"), digest).alias("name"))
    return U.audit(nodes, _facts(spark, sf), episodes)


@q("select count(*) filter (length(text) >= 100) as kept, count(*) filter (coalesce(length(text) < 100, true)) as skipped from documents")
def q133_skipped_rows_counted(spark, sf):
    """F-12: counts taken while the rows are written, not by a second job."""
    seen = Observation("fetched")
    fetched_only(_t(spark, sf, "documents").select("doc_id", "text"), F.length("text") >= 100, seen).write.parquet(folder(spark, "fetched"))
    return spark.createDataFrame([(seen.get["kept"], seen.get["skipped"])], "kept bigint, skipped bigint")


# articles and records


_CLEAN = "trim(regexp_replace(translate(text, chr(10) || chr(13) || chr(9), '   '), ' +', ' ', 'g'))"


@q(f"""with t as (select doc_id, concat('aa bb ', {_CLEAN}) as x from documents where text is not null and not regexp_matches(text, '[<&>]|[^\\x00-\\x7F]'))
select doc_id, trim(x) as article, case doc_id % 3 when 0 then 'next_data' when 1 then 'json_ld' else 'page' end as engine from t where length(x) >= 220""")
def q134_article_tiers_cleaned(spark, sf):
    """K-04: entities, tabs, double spaces and neighbouring tags in every tier's text; texts of plain letters that are long enough."""
    one_line = F.trim(F.regexp_replace(F.translate("text", "\n\r\t", "   "), " +", " "))
    d = _t(spark, sf, "documents").where("text is not null").where(~F.rlike("text", F.lit(r"[<&>]|[^\x00-\x7F]"))).select("doc_id", one_line.alias("x"))
    text = F.concat(F.lit("aa &amp; \t bb  "), F.col("x"))
    state = F.concat(F.lit('<script id="__NEXT_DATA__">'), F.to_json(F.struct(F.struct(text.alias("body")).alias("article"))), F.lit("</script>"))
    linked = F.concat(F.lit('<script type="application/ld+json">'), F.to_json(F.struct(F.lit("Article").alias("@type"), text.alias("articleBody"))), F.lit("</script>"))
    page = F.concat(F.lit("<style>p {}</style><p>aa</p><p>bb</p> "), F.col("x"))
    way = F.col("doc_id") % 3
    e = A.extract(F.when(way == 0, state).when(way == 1, linked).otherwise(page))
    d = d.select("doc_id", "x", e.alias("e")).where(F.length(F.concat(F.lit("aa bb "), F.col("x"))) >= 220)
    return d.select("doc_id", F.col("e.text").alias("article"), "e.engine")


@q("""select doc_id, regexp_matches(lower(coalesce(text, '')), '\\b(war|oil|rate|bank|ev)\\b') or doc_id % 2 = 0 as hit, doc_id % 5 = 0 or doc_id % 4 = 0 as known from documents""")
def q135_default_vocabularies(spark, sf):
    """F-06, F-07, IO-34: the hosts and the feed words; title and summary count together."""
    k = F.col("doc_id")
    title = F.when(k % 2 == 0, "Central Bank").otherwise("none")
    words = X.feed_relevant(title, F.col("text"), ["war", "oil", "rate", "bank", "ev"])
    host = F.when(k % 5 == 0, " Reuters.com ").otherwise("e.org")
    return _t(spark, sf, "documents").select("doc_id", words.alias("hit"), X.relevant(host, F.when(k % 4 == 0, "GDP").otherwise("none")).alias("known"))


@q("""select c_custkey, case c_custkey % 3 when 0 then 'person=Ann,person=Bo C,organization=Firm ' || c_custkey || ',location=Beijing, China (PRC),country=' || c_name when 1 then 'organization=Firm ' || c_custkey || ',location=Rome; Oslo' else '' end as entities from customer""")
def q136_record_entities(spark, sf):
    """S-18, S-19."""
    k = F.col("c_custkey") % 3
    firm = F.concat(F.lit("Firm "), _s("c_custkey"))
    d = _t(spark, sf, "customer").select(
        "c_custkey", F.when(k == 0, "Ann; Bo C;;").alias("persons"), F.when(k < 2, firm).alias("organizations"), F.when(k == 0, "#1#2#Beijing, Beijing,China#CN#X; ECON_X").when(k == 1, "#1#2#Rome#IT|#1#2#Oslo#NO|#VNM").alias("locations"),
        F.when(k == 0, "A").alias("actor1_code"), F.when(k == 0, F.col("c_name")).alias("actor1_name"), F.lit("B").alias("actor2_code"), F.lit("B").alias("actor2_name"))
    e = C.record_entities({"CN": "PRC"})
    return d.select("c_custkey", F.array_join(F.transform(e, lambda x: F.concat(x["type"], F.lit("="), x["name"])), ",").alias("entities"))


@q("""select c_custkey, concat_ws(chr(10), '## GDELT News Report', '', case when c_custkey % 2 = 0 then '**Date**: 20240101 UTC' end, '**Domain**: e.org', '',
concat('**Summary**: ', case c_custkey % 4 when 0 then 'A news development from e.org.' when 1 then 'News coverage related to Gdp.' when 2 then 'News coverage related to Gdp and Oil.' else 'News coverage related to Gdp, Oil, and War.' end), '',
case when c_custkey % 4 > 0 then concat('**Key Topics**: ', (['Gdp', 'Gdp, Oil', 'Gdp, Oil, War'])[c_custkey % 4], chr(10)) end, concat('**Key Persons**: ', c_name, ', X', chr(10)), case when c_custkey % 3 = 0 then concat('**Source**: https://e.org/', c_custkey) end) as body from customer""")
def q137_news_bodies(spark, sf):
    """S-20 of news records."""
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    d = _t(spark, sf, "customer").select(
        "c_custkey", F.when(k % 2 == 0, "20240101").alias("valid_at"), F.lit("e.org").alias("domain"), F.array_join(F.slice(F.array(F.lit("GDP,12"), F.lit("OIL"), F.lit("WAR")), F.lit(1), (k % 4).cast("int")), ";").alias("themes"),
        F.concat("c_name", F.lit("; X")).alias("persons"), none.alias("organizations"), none.alias("locations"), F.when(k % 3 == 0, F.concat(F.lit("https://e.org/"), _s("c_custkey"))).alias("source_url"))
    return d.select("c_custkey", C.news_body().alias("body"))


@q("""select o_orderkey, concat_ws(chr(10), '## GDELT Events Report', '', concat('**Date**: ', strftime(o_orderdate, '%Y-%m-%d')), '**Event**: Protest (CAMEO 14)', concat('**Actors**: ', o_orderpriority, case when o_orderkey % 2 = 0 then ' → CHN' else '' end),
case when o_orderkey % 3 > 0 then printf('**Goldstein Score**: %+.1f (%s)', (o_orderkey % 21 - 10)::double, case when abs(o_orderkey % 21 - 10) >= 8 then 'critical' when abs(o_orderkey % 21 - 10) >= 6 then 'high' when abs(o_orderkey % 21 - 10) >= 4 then 'medium' else 'low' end) end, '**Tone**: -1.5', '',
case when o_orderkey % 4 = 0 then concat('**Sources**:', chr(10), '1. u', o_orderkey, chr(10), '2. v') else '**Source**: s' end) as body, concat(strftime(o_orderdate, '%Y%m%d'), '000000') as valid_at, case when o_orderkey % 4 = 0 then concat('u', o_orderkey) else '' end as source_url from orders""")
def q138_event_records(spark, sf):
    """S-20, F-24 of events."""
    k = F.col("o_orderkey")
    d = _t(spark, sf, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("event_date"), F.lit("14").alias("cameo_code"), F.lit("").alias("actor1_name"), F.col("o_orderpriority").alias("actor1_code"), F.lit(None).cast("string").alias("actor2_name"),
        F.when(k % 2 == 0, "CHN").alias("actor2_code"), F.when(k % 3 > 0, (k % 21 - 10).cast("double")).alias("goldstein_scale"), F.lit(-1.5).alias("avg_tone"), F.lit("s").alias("source_url"), F.when(k % 4 == 0, F.array(F.concat(F.lit("u"), _s("o_orderkey")), F.lit("v"))).alias("urls"))
    d = d.withColumn("body", C.event_body(F.lit("Protest"), F.col("urls")))
    return d.select("o_orderkey", "body", *C.event_record(F.col("urls"))).select("o_orderkey", "body", "valid_at", "source_url")


@q("""select s_suppkey, concat('## FRED: ', s_name, ' (S', s_suppkey, ')', chr(10), chr(10), '- Observation date: 2024-01-01', chr(10), '- Latest value: ', s_suppkey % 7, ' %', case s_suppkey % 3 when 0 then '' when 1 then printf('\n- Change vs previous observation: %+.2f %% (%s)', (s_suppkey % 7 - 3)::double, case when s_suppkey % 7 > 3 then 'up' when s_suppkey % 7 < 3 then 'down' else 'flat' end) else concat(chr(10), '- Previous value: . %') end) as series,
concat('## ', s_name, chr(10), chr(10), 'x') as article, concat('## Sanctions: ', s_name, chr(10), chr(10), '- Target type: person', chr(10), '- Sanction program: SDGT — Terror; P', s_nationkey, chr(10), '- Source: ofac') as sanction,
concat_ws(chr(10) || chr(10), s_name, case s_suppkey % 3 when 0 then '[O] W | 评级: 买入' when 1 then 'O' end, 'c') as research from supplier""")
def q139_source_bodies(spark, sf):
    """S-20 of series, articles, sanctions and research."""
    k, none = F.col("s_suppkey") % 3, F.lit(None).cast("string")
    d = _t(spark, sf, "supplier").select("*", F.col("s_name").alias("entity_name"), F.lit("person").alias("target_type"), none.alias("country"), F.concat(F.lit("SDGT] [P"), _s("s_nationkey")).alias("sanction_program"), none.alias("listing_date"), F.lit("ofac").alias("source"))
    value = (F.col("s_suppkey") % 7).cast("string")
    series = C.series_body("FRED", F.concat(F.lit("S"), _s("s_suppkey")), F.col("s_name"), F.lit("2024-01-01"), value, F.when(k == 1, "3").when(k == 2, "."), F.lit("%"))
    research = C.research_body(F.col("s_name"), F.lit("c"), F.when(k < 2, "O"), F.when(k == 0, "W"), F.when(k == 0, "买入"))
    return d.select("s_suppkey", series.alias("series"), C.article_body(F.col("s_name"), F.lit(" x ")).alias("article"), C.sanction_body({"SDGT": "Terror"}).alias("sanction"), research.alias("research"))


@q("""with f as (select * from lineitem where l_linenumber <> 3), x as (select l_orderkey, arg_max(l_linenumber, l_linenumber) as n from f group by 1)
select o_orderkey, coalesce(case when n % 2 = 0 then 'page ' || n end, '') as html, case when x.n is null then 'Unknown error: request never completed' when n % 2 = 1 then 'failed' end as error, coalesce(n % 2 = 1, true) as retry, coalesce(n % 2 = 0, false) as content_fetched
from orders left join x on l_orderkey = o_orderkey""")
def q140_fetch_outcomes(spark, sf):
    """J-03, J-20: the last outcome of each url; a miss is an error to try again."""
    n = F.col("l_linenumber")
    page = F.when(n % 2 == 0, F.concat(F.lit("page "), n.cast("string")))
    got = _t(spark, sf, "lineitem").where("l_linenumber <> 3").select(_s("l_orderkey").alias("url"), n.alias("seq"), F.lit(200).alias("status"), page.alias("html"), F.when(n % 2 == 1, "failed").alias("error"), (n % 2 == 0).alias("success"), page.alias("text"))
    asked = _t(spark, sf, "orders").select("o_orderkey", _s("o_orderkey").alias("url"))
    d = C.outcomes(asked, got, "o_orderkey")
    return C.attach_text(d, got, "url").select("o_orderkey", "html", "error", "retry", "content_fetched")


# vendor readers


def _json(spark, tag: str, df):
    path = folder(spark, tag)
    df.write.json(path)
    return path


@q("""select c_name as entity_name, case when c_custkey % 2 = 0 then 'person' else 'legalEntity' end as target_type, case when c_custkey % 3 = 0 then 'XX' else '' end as country, case c_custkey % 4 when 0 then 'P1' when 1 then 'T1' else '' end as sanction_program,
case when c_custkey % 5 <> 2 then case c_custkey % 5 when 0 then '2024-01-05' else '2024-01-09' end end as listing_date, concat('https://www.opensanctions.org/entities/', c_custkey, '/') as source_url from customer where c_custkey % 5 <> 0""")
def q141_read_listed_sanctions(spark, sf):
    """IO-13."""
    k = F.col("c_custkey")
    some = lambda c, *v: F.when(c, F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>"))
    props = F.struct(some(k % 3 == 0, "XX", "YY").alias("countries"), some(k % 4 == 0, "P1").alias("programs"), some(k % 4 == 1, "T1").alias("topics"), some(k % 5 == 0, "2024-01-05").alias("first_seen"), some(~(k % 5).isin(0, 2), "2024-01-09").alias("start_date"))
    item = F.struct(_s("c_custkey").alias("id"), F.col("c_name").alias("caption"), F.when(k % 2 == 0, "Person").otherwise("Company").alias("schema"), props.alias("properties"))
    path = _json(spark, "search-json", _t(spark, sf, "customer").select(F.array(item).alias("results")))
    return IO.read_listed_sanctions(spark, path, F.lit("2024-01-10 00:00:00").cast("timestamp"), 3).drop("source")


def _listed(spark, sf):
    n, k = _t(spark, sf, "nation"), F.col("n_nationkey").cast("string")
    return n.select(F.concat(F.lit("6000"), F.lpad(k, 2, "0")).alias("biz_code"), F.col("n_name").alias("name"), F.concat(F.lit("T"), k).alias("ticker"), F.lit("S").alias("sector"), F.lit("SSE").alias("exchange"))


_CODE = "concat('6000', lpad(cast(c_nationkey as varchar), 2, '0'))"


@q(f"""select cast(c_custkey as varchar) as ann_id, c_name as title, case when c_custkey % 2 = 0 then '1' else {_CODE} end as sec_code, case when c_custkey % 3 = 0 then 'own' else n_name end as sec_name, 'SSE' as exchange from customer join nation on n_nationkey = c_nationkey""")
def q142_read_announcements(spark, sf):
    """IO-21, S-28."""
    k = F.col("c_custkey")
    item = F.struct(_s("c_custkey").alias("announcementId"), F.col("c_name").alias("announcementTitle"), F.when(k % 2 == 0, "1").alias("secCode"), F.when(k % 3 == 0, "own").alias("secName"))
    code = F.concat(F.lit("6000"), F.lpad(_s("c_nationkey"), 2, "0"))
    path = _json(spark, "announcements-json", _t(spark, sf, "customer").select(code.alias("asked"), F.array(item).alias("announcements")))
    return IO.read_announcements(spark, path, _listed(spark, sf)).select("ann_id", "title", "sec_code", "sec_name", "exchange")


@q("""select cast(event_id as varchar) as info_code, event_type as title, 'R' as author, case when event_id % 2 = 0 then '600000' else 'asked' end as stock_code from events where ts >= timestamp '2024-01-11' and ts <= timestamp '2024-01-21'""")
def q143_read_research(spark, sf):
    """IO-23."""
    k = F.col("event_id")
    item = F.struct(_s("event_id").alias("infoCode"), F.col("event_type").alias("title"), F.lit("R").alias("researcher"), F.when(k % 2 == 0, "600000").alias("stockCode"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("publishDate"))
    path = _json(spark, "research-json", _t(spark, sf, "events").select(F.lit("asked").alias("asked"), F.array(item).alias("data")))
    return IO.read_research(spark, path, F.lit("2024-01-21 00:00:00").cast("timestamp"), 10).select("info_code", "title", "author", "stock_code")


@q(f"""select c_name as title, case when c_custkey % 2 = 0 then c_mktsegment else '' end as link, {_CODE} as symbol, n_name as ticker_name from customer join nation on n_nationkey = c_nationkey where c_nationkey <> 7""")
def q144_read_stock_news(spark, sf):
    """IO-24: Chinese column names, missing columns, shares that aren't listed."""
    c = _t(spark, sf, "customer")
    path = folder(spark, "news-csv")
    code = F.concat(F.lit("6000"), F.lpad(_s("c_nationkey"), 2, "0"))
    c.select(F.col("c_name").alias("新闻标题"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("新闻链接"), code.alias("symbol")).write.option("header", True).csv(path)
    return IO.read_stock_news(spark, path, _listed(spark, sf).where("biz_code <> '600007'")).select("title", "link", "symbol", "ticker_name")


@q("select c_nationkey % 5 as name, count(*) as n, arg_max(c_custkey, c_custkey) as ticker from customer group by 1 having n > 1")
def q145_duplicate_listings(spark, sf):
    """IO-26: names listed more than once; the last one counts."""
    return IO.duplicate_listings(_t(spark, sf, "customer").select((F.col("c_nationkey") % 5).alias("name"), F.col("c_custkey").alias("ticker"), F.col("c_custkey").alias("pos")))


# composed answers


@q(f"""select event_id, {_LOW} as severity from events where ts > {NOW} - interval 7 day and {_LOW} in ('critical', 'high') order by ts desc, event_id limit 50""")
def q146_active_events_from_severity(spark, sf):
    """API-1, F-15 (quirk Q7); the limit is the feature."""
    return W.active_events(_episodes(spark, sf), _entities(spark, sf), F.expr(NOW), min_severity="HIGH").select("event_id", "severity")


@q(f"""with e as (select event_id, {_LOW} as s from events where user_id % 50 = 7 and ts > {NOW} - interval 7 day and {_LOW} <> 'low' order by ts desc, event_id limit 30), a as (select avg(case s when 'critical' then 4 when 'high' then 3 else 2 end) as m, count(*) as n from e)
select n, case when m >= 3.5 then 'critical' when m >= 2.5 then 'high' when m >= 1.5 then 'medium' else 'low' end as avg_severity, case when m >= 3.5 then 'CRITICAL' when m >= 2.5 then 'HIGH' when m >= 1.5 then 'MEDIUM' else 'LOW' end as risk_level, round_even(least(1, greatest(0, 1 - (m - 1) / 3)), 2) as sentiment from a""")
def q147_entity_answer_summary(spark, sf):
    """API-2, A-06, F-15; the limit of 30 is the feature."""
    return W.entity_summary(W.entity_events(_episodes(spark, sf), _entities(spark, sf), "T7", F.expr(NOW)))


def _share_graph(spark, sf):
    """Suppliers and their nations; S1 has an edge, supplier 0 none."""
    s, n = _t(spark, sf, "supplier"), _t(spark, sf, "nation")
    lab = lambda x: F.array(F.lit(x))
    share = s.select(F.concat(F.lit("S"), _s("s_suppkey")).alias("name"), lab("Stock").alias("labels"), F.concat(F.lit("T"), _s("s_suppkey")).alias("ticker"))
    nation = n.select(F.col("n_name").alias("name"), lab("Country").alias("labels"), F.lit(None).cast("string").alias("ticker"))
    alone = spark.range(1).select(F.lit("alone").alias("name"), lab("Stock").alias("labels"), F.lit("T-alone").alias("ticker"))
    edges = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.concat(F.lit("S"), _s("s_suppkey")).alias("src"), F.col("n_name").alias("dst"), F.lit("located_in").alias("name"), F.lit("there").alias("fact"))
    return share.unionByName(nation).unionByName(alone), edges


_NEAR = "(select s_suppkey, n_name from supplier join nation on n_nationkey = s_nationkey where s_nationkey = (select s_nationkey from supplier where s_suppkey = 1) order by s_suppkey limit 200)"


@q(f"""select 'edge' as what, 'S' || s_suppkey || '>' || n_name || ' ' || 'LOCATED_IN' as item from {_NEAR} union all select 'node', 'S' || s_suppkey || ' stock' from {_NEAR} union all select distinct 'node', n_name || ' country' from {_NEAR}
union all select 'one hop', 'S1>' || n_name || ' LOCATED_IN' from supplier join nation on n_nationkey = s_nationkey where s_suppkey = 1 union all select 'alone', 'alone stock'""")
def q148_entity_answer_graph(spark, sf):
    """API-2, J-11, A-12, T-05: nodes and edges two hops and one hop away, and of a start without edges; the limit of 200 edges is the feature."""
    nodes, edges = _share_graph(spark, sf)
    two, one, none = (W.graph_records(nodes, edges, t, h) for t, h in (("T1", 2), ("T1", 1), ("T-alone", 3)))
    edge = lambda r, what: W.graph_edges(r).select(F.lit(what).alias("what"), F.concat("source", F.lit(">"), "target", F.lit(" "), "type").alias("item"))
    node = lambda r, what: W.graph_nodes(r).select(F.lit(what).alias("what"), F.concat("id", F.lit(" "), "type").alias("item"))
    return edge(two, "edge").union(node(two, "node")).union(edge(one, "one hop")).union(node(none, "alone"))


@q(f"""with e as (select *, {_LOW} s from events where event_type = 'error' and ts > {NOW} - interval 7 day)
select count(*) as n_events, count(distinct user_id % 50) as n_tickers, (select s from e group by s order by count(*) desc, min(event_id) limit 1) as dominant, 'error' as sector, 'quiet' as briefing from e""")
def q149_sector_answer_with_briefing(spark, sf):
    """API-3: statistics and the cached briefing."""
    briefing = spark.createDataFrame([("error", "quiet"), ("view", "loud")], "sector string, briefing string")
    return W.sector_answer(_episodes(spark, sf), _entities(spark, sf), "error", F.expr(NOW), briefing)[1]


@q("select c_custkey, count(o_orderkey) as degree from customer left join orders on o_custkey = c_custkey group by 1")
def q150_node_degrees(spark, sf):
    """J-17: 0 for nodes without edges."""
    edges = _t(spark, sf, "orders").select(F.col("o_custkey").alias("src"), (-1 - F.col("o_orderkey")).alias("dst"))
    return G.degrees(_t(spark, sf, "customer").select("c_custkey"), edges, "c_custkey")


@q("select doc_id, doc_id % 3 = 0 as medium, doc_id % 4 = 0 as leak from documents")
def q151_media_and_leak_flags(spark, sf):
    """F-21."""
    k = F.col("doc_id")
    name = F.when(k % 3 == 0, "the REUTERS desk").otherwise("somebody")
    text = F.when(k % 4 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" [end of content] more"))).otherwise("plain")
    return _t(spark, sf, "documents").select("doc_id", X.is_medium(name).alias("medium"), X.has_leak(text).alias("leak"))


# queue operations, config and small forms


@q(f"with {_CUR} select content_hash, seq + 1 as seq, 'done' as status from cur where status = 'processing' and owner = 'w1'")
def q152_finish_own_rows(spark, sf):
    """X-03: only the owner's rows in process."""
    log = _log(spark, sf)
    return Q.finish(log, log.select("content_hash").distinct(), "w1", F.expr(NOW)).select("content_hash", "seq", "status")


@q(f"with {_CUR} select content_hash, seq + 1 as seq, 'pending' as status, 0 as attempts from cur where status = 'done'")
def q153_replay_from_zero(spark, sf):
    """X-09."""
    log = _log(spark, sf)
    return Q.replay(log, Q.current(log).where("status = 'done'").select("content_hash"), F.expr(NOW)).select("content_hash", "seq", "status", "attempts")


@q("""with e as (select o_orderkey as id, 'C' || o_custkey as src, 'D' || (o_orderkey % 9) as dst from orders), m as (select distinct l_suppkey as ep, l_orderkey as id from lineitem)
select distinct ep as episode_id, unnest([src, dst]) as entity from m join e using (id)""")
def q154_episode_entities(spark, sf):
    """J-08, A-05, U-02, R-04 (quirk Q4: each once)."""
    edges = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("C"), _s("o_custkey")).alias("src"), F.concat(F.lit("D"), (F.col("o_orderkey") % 9).cast("string")).alias("dst"))
    # an episode's edges in runs of a hundred orders, so that no list grows with the table
    episodes = _t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("episode_id"), F.floor(F.col("l_orderkey") / 100).alias("run")).agg(F.collect_set("l_orderkey").alias("entity_edges"))
    return G.episode_entities(episodes, edges)


@q("""with e as (select o_orderkey, '0' || substr(o_orderpriority, 1, 1) || '1' as code, (o_totalprice - 250000) / 25000 as g from orders), n as (select l_orderkey, count(*) as n from lineitem group by 1)
select o_orderkey, n as n_mentions from e join n on l_orderkey = o_orderkey where substr(code, 1, 2) in ('01', '03') and abs(g) >= 5 and n >= 2""")
def q155_configured_filter(spark, sf):
    """F-04, F-05: parts of the configuration that are wrong or missing fall back to the defaults."""
    raw = {"cameo_filter": {"mode": "odd", "codes": ["01", "03"]}, "goldstein": {"min_abs_value": -1}, "mentions": {"min_count": 2}}
    e = _t(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("0"), F.substring("o_orderpriority", 1, 1), F.lit("1")).alias("code"), F.expr("(o_totalprice - 250000) / 25000").alias("g"))
    m = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return X.filter_events(e, m, X.FilterConfig.of(raw), "o_orderkey", "code", "g").select("o_orderkey", "n_mentions")


@q("""select c_custkey, c_custkey % 3 = 0 as article, case when c_custkey % 2 = 0 then 'A,AFFECTS,PART_OF' else 'PART_OF,B,AFFECTS' end as allowed, concat(c_name, ',', case when c_custkey % 2 = 0 then 'Alias Firm' else 'Plain' end) as names, c_custkey % 2 <> 0 as canonical, concat('n:', c_name, ',n:x') as labelled,
case when c_custkey % 2 = 0 then 'a=1,z=9' else 'a=1,b=2,z=9' end as merged from customer""")
def q156_array_and_map_forms(spark, sf):
    """S-02, U-05, U-06, R-02, R-03, R-06."""
    k = F.col("c_custkey")
    aliases = {"short": "Alias Firm"}
    two = F.when(k % 2 == 0, "short").otherwise("Plain")
    allowed = F.create_map(F.lit("x"), F.when(k % 2 == 0, F.array(F.lit("A"))).otherwise(F.array(F.lit("PART_OF"), F.lit("B"))))
    flat = F.flatten(F.array(F.array("c_name"), F.array(F.lit("x"))))
    known = F.map_filter(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.when(k % 2 == 1, "2")), lambda _, v: v.isNotNull())
    merged = F.map_concat(known, F.create_map(F.lit("z"), F.lit("9")))
    core = S.with_core_types(allowed, ["AFFECTS", "PART_OF"])["x"]
    return _t(spark, sf, "customer").select(
        "c_custkey", S.types_meet(F.when(k % 3 == 0, F.array(F.lit("Thing"), F.lit("NewsArticle"))).otherwise(F.array(F.lit("Thing"))), ["newsarticle"]).alias("article"), F.array_join(core, ",").alias("allowed"),
        F.array_join(S.canonical_names(F.array(F.col("c_name"), two), aliases), ",").alias("names"), S.is_canonical(two, aliases).alias("canonical"), F.array_join(F.transform(flat, lambda n: F.concat(F.lit("n:"), n)), ",").alias("labelled"),
        F.array_join(F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("merged"))
