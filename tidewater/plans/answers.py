"""Registered queries of the interface's answers; events stand for episodes, orders for rows of the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers as W
from .registry import q
from .registry import table as _t

NOW = "timestamp '2024-01-31 00:00:00'"
_SEV = "case event_id % 5 when 0 then 'critical' when 1 then 'HIGH' when 2 then 'medium' when 3 then 'low' else 'odd' end"
_LOW = "case event_id % 5 when 0 then 'critical' when 1 then 'high' when 3 then 'low' else 'medium' end"
_BODY = "concat(chr(10), ' ', event_type, ' ', event_id, chr(10), 'value ', event_id, ' of it ')"


def _episodes(spark, sf):
    e = _t(spark, sf, "events")
    return e.select("event_id", F.lit("episode").alias("name"), F.expr(_BODY).alias("content"), F.expr(_SEV).alias("severity"), F.col("ts").alias("valid_at"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 3 == 0, '{"scope": "MACRO"}').otherwise("{}").alias("metadata"))


def _entities(spark, sf):
    """Each event has a stock of its type's sector, and every other one the sector itself, twice."""
    e = _t(spark, sf, "events")
    stock = F.struct(F.concat(F.lit("S"), (F.col("user_id") % 50).cast("string")).alias("name"), F.col("event_type").alias("sector"), F.array(F.lit("Entity"), F.lit("Stock")).alias("labels"), F.concat(F.lit("T"), (F.col("user_id") % 50).cast("string")).alias("ticker"))
    sector = F.struct(F.col("event_type").alias("name"), F.lit(None).cast("string").alias("sector"), F.array(F.lit("Sector")).alias("labels"), F.lit(None).cast("string").alias("ticker"))
    both = F.when(F.col("event_id") % 2 == 0, F.array(stock, sector, sector)).otherwise(F.array(stock))
    return e.select("event_id", F.inline(both))


_NAMES = "case when event_id % 2 = 0 then concat('S', user_id % 50, '=stock,', event_type, '=sector') else concat('S', user_id % 50, '=stock') end"


def _named():
    return F.array_join(F.transform("entities", lambda x: F.concat(x["name"], F.lit("="), x["type"])), ",").alias("entities")


@q(f"""select event_id, concat(event_type, ' ', event_id) as title, case when length(concat('value ', event_id, ' of it')) > 10 then concat('value ', event_id, ' of it') end as summary, {_LOW} as severity, {_NAMES} as entities
from events where ts > {NOW} - interval 7 day order by ts desc, event_id limit 50""")
def q107_active_events_answer(spark, sf):
    """API-1, S-36, A-05, T-01, F-14; the limit is the feature."""
    d = W.active_events(_episodes(spark, sf), _entities(spark, sf), F.expr(NOW))
    return d.select("event_id", "title", "summary", "severity", _named())


@q(f"""select event_id, {_LOW} as severity from events where ts > {NOW} - interval 7 day and (contains(event_type, 'err') or contains(concat('S', user_id % 50), 'err')) order by ts desc, event_id limit 120""")
def q108_active_events_of_sector(spark, sf):
    """API-1 with a sector and a limit."""
    return W.active_events(_episodes(spark, sf), _entities(spark, sf), F.expr(NOW), limit=120, sector="err").select("event_id", "severity")


@q(f"""with e as (select *, {_LOW} s from events where event_type = 'error' and ts > {NOW} - interval 7 day)
select count(*) as n_events, count(distinct user_id % 50) as n_tickers, (select s from e group by s order by count(*) desc, min(event_id) limit 1) as dominant from e""")
def q109_sector_answer(spark, sf):
    """API-3, J-10, A-07."""
    n = _entities(spark, sf)
    return W.sector_statistics(W.sector_events(_episodes(spark, sf), n, "error", F.expr(NOW)), n)


_RISKS = f"(select *, {_LOW} s from events where event_id % 3 = 0 and ts > {NOW} - interval 14 day order by ts desc, event_id limit 10)"


@q(f"""with r as {_RISKS}, k as (select count(*) n, round_even(least(1.0, (count(*) filter (s = 'critical') + cast(0.7 as double) * count(*) filter (s = 'high') + cast(0.3 as double) * count(*) filter (s = 'medium')) / count(*)), 4) risk_score from r)
select n, risk_score, case when risk_score >= 0.7 then 'HIGH' when risk_score >= 0.4 then 'MEDIUM' else 'LOW' end as risk_level from k""")
def q110_risk_answer(spark, sf):
    """API-4, F-17, T-03, A-08; the ten newest are the feature."""
    return W.risk_summary(W.recent_risks(_episodes(spark, sf), F.expr(NOW)))


@q(f"""with r as {_RISKS} select case when event_id % 2 = 0 then event_type else '综合' end as sector, upper(arg_min(s, -epoch_us(ts))) as level from r group by 1""")
def q111_risk_levels_answer(spark, sf):
    """API-4, A-09."""
    return W.sector_risks(W.recent_risks(_episodes(spark, sf), F.expr(NOW)), _entities(spark, sf))


def _records(spark, sf):
    k = F.col("o_orderkey")
    label = F.when(k % 2 == 0, F.array(F.lit("Stock"))).otherwise(F.array(F.lit("topic")))
    none = F.lit(None).cast("string")
    return _t(spark, sf, "orders").select(
        k.alias("pos"), F.lit("start").alias("start_name"), F.array(F.lit("Entity")).alias("start_labels"), F.lit("T0").alias("start_ticker"),
        F.when(k % 11 > 0, F.concat(F.lit("C"), F.col("o_custkey").cast("string"))).alias("source_name"), label.alias("source_labels"), none.alias("source_ticker"),
        F.concat(F.lit("D"), (k % 100).cast("string")).alias("target_name"), F.array(F.lit("x")).alias("target_labels"), none.alias("target_ticker"),
        F.when(k % 3 == 0, "affects").when(k % 3 == 1, "AFFECTS").alias("edge_type"), k.cast("string").alias("fact"),
    )


@q("""select 'start' as id, 'stock' as type, 'T0' as ticker union all select concat('C', o_custkey), arg_min(case when o_orderkey % 2 = 0 then 'stock' else 'topic' end, o_orderkey), null from orders where o_orderkey % 11 > 0 group by 1
union all select distinct concat('D', o_orderkey % 100), 'unknown', null from orders where o_orderkey % 11 > 0""")
def q112_graph_nodes_answer(spark, sf):
    """API-2, A-12, S-35."""
    return W.graph_nodes(_records(spark, sf))


@q("""select concat('C', o_custkey) as source, concat('D', o_orderkey % 100) as target, case when o_orderkey % 3 < 2 then 'AFFECTS' else 'RELATED_TO' end as type, cast(min(o_orderkey) as varchar) as fact from orders where o_orderkey % 11 > 0 group by 1, 2, 3""")
def q113_graph_edges_answer(spark, sf):
    """API-2, A-12."""
    return W.graph_edges(_records(spark, sf))


@q("""with r as (select concat('ep', o_custkey) id, o_orderkey pos, o_orderdate from orders), f as (select id, min(pos) p, arg_min(o_orderdate, pos) d from r group by 1 order by 3, 1 limit 50),
n as (select id, concat('E', pos % 4) n, pos * 2 a from r where pos % 5 > 0 union all select id, concat('E', pos % 3), pos * 2 + 1 from r), m as (select id, n, min(a) a from n group by 1, 2)
select f.id, concat('line ', p) as title, strftime(d, '%Y-%m-%d') as day, (select string_agg(n, ',' order by a) from m where m.id = f.id) as entities from f""")
def q114_episode_items_answer(spark, sf):
    """API-2, A-11, W-08, T-04; the limit of 50 is the feature."""
    k = F.col("o_orderkey")
    rows = _t(spark, sf, "orders").select(
        k.alias("pos"), F.concat(F.lit("ep"), F.col("o_custkey").cast("string")).alias("id"), F.lit("n").alias("name"), F.concat(F.lit("\n line "), k.cast("string"), F.lit(" \nrest")).alias("content"), F.col("o_orderdate").alias("valid_at"),
        F.when(k % 5 > 0, F.concat(F.lit("E"), (k % 4).cast("string"))).alias("entity_name"), F.concat(F.lit("E"), (k % 3).cast("string")).alias("peer_name"),
    )
    return W.episode_items(rows).select("id", "title", F.date_format("valid_at", "yyyy-MM-dd").alias("day"), F.array_join("entities", ",").alias("entities"))


@q(f"""select event_id, case when event_id % 7 = 0 then 'high' else {_SEV} end as severity from events""")
def q115_severity_update(spark, sf):
    """X-12: unknown levels change nothing."""
    e = _episodes(spark, sf)
    found = e.where("event_id % 7 < 2").select("event_id", F.when(F.col("event_id") % 7 == 0, "High").otherwise("none").alias("severity"))
    return W.update_severity(e, found).select("event_id", "severity")


@q(f"""with n as (select concat('S', user_id % 50) n, ts from events union all select event_type, ts from events where event_id % 2 = 0) select n as name from n group by 1 having max(ts) < {NOW} - interval 3 hour""")
def q116_entities_of_expired_episodes(spark, sf):
    """X-11: with three hours to live, so that some entities go."""
    e, n = _episodes(spark, sf), _entities(spark, sf)
    kept = e.where(F.col("created_at") >= F.expr(NOW) - F.expr("interval 3 hours"))
    return W.without_edges_left(n.select("name").distinct(), n, kept)
