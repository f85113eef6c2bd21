"""What the query interface answers, as DataFrames; survey ids in docstrings.

episodes: event_id, name, content, severity, valid_at, created_at, metadata.  entities: event_id, name, sector, labels, ticker, a row for
each entity that a relation of the episode touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import relational as R
from .graph import khop_of

LEVELS = ("critical", "high", "medium", "low")


def severity_of(raw: Column) -> Column:
    """Lower-cased; unknown or missing is medium."""
    low = F.lower(raw)
    return F.when(low.isin(*LEVELS), low).otherwise("medium")


def event_items(episodes: DataFrame, entities: DataFrame) -> DataFrame:
    """S-36, A-05: an item for each episode, its distinct entities in an array sorted by name. Meant for the few rows of one answer."""
    kind = S.entity_type(F.col("labels"), F.col("ticker"))
    of = entities.join(episodes.select("event_id"), "event_id", "left_semi").groupBy("event_id").agg(F.array_sort(F.collect_set(F.struct("name", kind.alias("type"), "ticker"))).alias("entities"))
    title = F.coalesce(F.nullif(S.first_line(F.coalesce("content", F.lit(""))), F.lit("")), "name")
    d = episodes.select(
        "event_id", F.left(title, F.lit(200)).alias("title"), S.summary_of(F.col("content")).alias("summary"), severity_of(F.col("severity")).alias("severity"),
        F.coalesce("valid_at", "created_at").alias("first_seen"), F.coalesce("created_at", "valid_at").alias("last_updated"),
    )
    return d.join(of, "event_id", "left").withColumn("entities", F.coalesce("entities", F.array().cast(of.schema["entities"].dataType)))


def newest(episodes: DataFrame, limit: int, *columns: str) -> DataFrame:
    """T-01, T-03: missing times first, as the store sorts them; ties by id."""
    return episodes.orderBy(*[F.desc_nulls_first(c) for c in columns], "event_id").limit(limit)


def since(episodes: DataFrame, now: Column, days: int) -> DataFrame:
    """F-14: created less than `days` days before now."""
    return episodes.where(F.col("created_at") > now - F.make_dt_interval(F.lit(days)))


def at_least(severity: Column, least: str) -> Column:
    """F-15: unknown or missing levels count as medium."""
    return S.weight(severity_of(severity)) >= S.weight(F.lit(least.lower()))


def active_events(episodes: DataFrame, entities: DataFrame, now: Column, limit: int = 50, sector: str | None = None, days: int = 7, min_severity: str = "low") -> DataFrame:
    """API-1: the newest of the last week, of a sector if given (F-16), from a severity on (quirk Q7; the default keeps all), by severity, then time (T-02)."""
    found = since(episodes, now, days).where(at_least(F.col("severity"), min_severity))
    if sector is not None:
        hit = F.contains("sector", F.lit(sector)) | F.contains("name", F.lit(sector))
        found = found.join(entities.where(hit).select("event_id"), "event_id", "left_semi")
    return event_items(newest(found, limit, "valid_at", "created_at"), entities).orderBy(S.weight(F.col("severity")).desc(), F.desc("last_updated"), "event_id")


def sector_events(episodes: DataFrame, entities: DataFrame, sector: str, now: Column, days: int = 7) -> DataFrame:
    """API-3, J-10: recent episodes that touch a stock of the sector, the newest first."""
    stocks = entities.where(F.col("sector") == sector).select("event_id")
    return since(episodes, now, days).join(stocks, "event_id", "left_semi").orderBy(F.desc_nulls_first("valid_at"), F.desc_nulls_first("created_at"), "event_id")


def sector_statistics(events: DataFrame, entities: DataFrame) -> DataFrame:
    """API-3, A-07: (n_events, n_tickers, dominant) of given events."""
    tickers = entities.join(events.select("event_id"), "event_id", "left_semi").agg(F.countDistinct(F.nullif("ticker", F.lit(""))).alias("n_tickers"))
    d = events.select("event_id", severity_of(F.col("severity")).alias("severity"), F.lit(0).alias("one"))
    main = d.groupBy("one").agg(F.count("*").alias("n_events")).join(R.dominant(d, ["one"], "severity", "event_id", "dominant"), "one")
    return main.crossJoin(F.broadcast(tickers)).select("n_events", "n_tickers", "dominant")  # one row each


def sector_answer(episodes: DataFrame, entities: DataFrame, sector: str, now: Column, briefing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """API-3: (events, one row of statistics with the cached briefing (sector, briefing), null if there is none)."""
    events = sector_events(episodes, entities, sector, now)
    one = sector_statistics(events, entities).withColumn("sector", F.lit(sector))
    return events, one.join(briefing.where(F.col("sector") == sector).select("sector", "briefing"), "sector", "left")


def entity_events(episodes: DataFrame, entities: DataFrame, ticker: str, now: Column, limit: int = 30, min_severity: str = "medium", days: int = 7) -> DataFrame:
    """API-2: the newest recent episodes that touch an entity of the ticker, from a severity on."""
    touched = entities.where(F.col("ticker") == ticker).select("event_id")
    found = since(episodes, now, days).where(at_least(F.col("severity"), min_severity)).join(touched, "event_id", "left_semi")
    return event_items(newest(found, limit, "valid_at", "created_at"), entities)


def entity_summary(events: DataFrame) -> DataFrame:
    """API-2, A-06: one row (n, avg_severity, risk_level, sentiment) over the answer's events."""
    d = events.agg(F.count("*").alias("n"), F.avg(S.weight(F.col("severity"))).alias("avg"))
    s = R.severity_summary(F.coalesce("avg", F.lit(2.0)))
    return d.select("n", s["avg_severity"].alias("avg_severity"), F.upper(s["avg_severity"]).alias("risk_level"), s["sentiment"].alias("sentiment"))


def graph_records(nodes: DataFrame, edges: DataFrame, ticker: str, hops: int = 3, limit: int = 200) -> DataFrame:
    """API-2, J-11, T-05: records (pos, start_*, source_*, target_*, edge_type, fact) of the edges up to `hops` away from the ticker's nodes, the first `limit` by id.

    A start without edges has a record of its own, its edge null.  nodes: name, labels, ticker.  edges: id, src, dst, name, fact.
    """
    if not 1 <= hops <= 3:
        raise ValueError("hops must be 1, 2 or 3")
    start = nodes.where(F.col("ticker") == ticker)
    near = khop_of(edges, start.select(F.col("name").alias("a")), hops).orderBy("id").limit(limit)
    end = lambda which, key: nodes.select(F.col("name").alias(key), F.col("name").alias(f"{which}_name"), F.col("labels").alias(f"{which}_labels"), F.col("ticker").alias(f"{which}_ticker")).dropDuplicates([key])
    d = near.join(end("source", "src"), "src", "left").join(end("target", "dst"), "dst", "left")
    d = d.select(F.col("id").cast("long").alias("pos"), *[f"{w}_{c}" for w in ("source", "target") for c in ("name", "labels", "ticker")], F.col("name").alias("edge_type"), "fact")
    one = start.groupBy().agg(F.min_by(F.struct("name", "labels", "ticker"), "name").alias("s"))  # one row, null without a start
    named = lambda x: x.select("*", *[F.col(f"s.{c}").alias(f"start_{c}") for c in ("name", "labels", "ticker")]).drop("s")
    alone = one.withColumn("pos", F.lit(-1).cast("long"))
    return named(d.crossJoin(F.broadcast(one))).unionByName(named(alone), allowMissingColumns=True).where("start_name is not null")


def recent_risks(episodes: DataFrame, now: Column, days: int = 14, limit: int = 10) -> DataFrame:
    """API-4, F-17, T-03: the newest episodes of macro scope."""
    return newest(since(episodes, now, days).where(F.contains("metadata", F.lit("MACRO"))), limit, "created_at")


def risk_summary(risks: DataFrame) -> DataFrame:
    """API-4, A-08: one row, also without any risk."""
    return risks.agg(*[c.alias(n) for n, c in R.risk_score(severity_of(F.col("severity"))).items()])


def sector_risks(risks: DataFrame, entities: DataFrame) -> DataFrame:
    """API-4, A-09: the upper-cased severity of each sector's newest risk."""
    sectors = entities.where(S.entity_type(F.col("labels"), F.col("ticker")) == "sector").groupBy("event_id").agg(F.collect_set("name").alias("sectors"))
    d = risks.join(sectors, "event_id", "left").withColumns({"severity": F.upper(severity_of(F.col("severity"))), "age": -F.unix_micros(F.col("created_at").cast("timestamp"))})
    return R.first_severity(d, "sectors", "severity", ["age", "event_id"])


def graph_nodes(records: DataFrame) -> DataFrame:
    """API-2, A-12: nodes of (pos, start_*, source_*, target_* with name, labels, ticker), the first of each name.

    A record without a source or a target tells of its start alone.
    """
    whole = (F.coalesce("source_name", F.lit("")) != "") & (F.coalesce("target_name", F.lit("")) != "")

    def end(slot: int, which: str):
        return F.struct((F.col("pos") * 3 + slot).alias("at"), F.col(f"{which}_name").alias("name"), F.col(f"{which}_labels").alias("labels"), F.col(f"{which}_ticker").alias("ticker"))

    ends = F.when(whole, F.array(end(0, "start"), end(1, "source"), end(2, "target"))).otherwise(F.array(end(0, "start")))
    d = records.select(F.inline(ends)).where("coalesce(name, '') <> ''")
    d = d.groupBy("name").agg(F.min_by(F.struct("labels", "ticker"), "at").alias("x"))
    return d.select(F.col("name").alias("id"), S.entity_type(F.col("x.labels"), F.col("x.ticker")).alias("type"), "x.ticker")


def graph_edges(records: DataFrame) -> DataFrame:
    """API-2, A-12: edges by (source, target, upper-cased type), the first fact of each; no type is RELATED_TO."""
    d = records.where("coalesce(source_name, '') <> '' and coalesce(target_name, '') <> ''")
    kind = F.upper(F.coalesce(F.nullif("edge_type", F.lit("")), F.lit("RELATED_TO")))
    return d.groupBy(F.col("source_name").alias("source"), F.col("target_name").alias("target"), kind.alias("type")).agg(F.min_by("fact", "pos").alias("fact"))


def episode_items(rows: DataFrame, limit: int = 50) -> DataFrame:
    """API-2, A-11, W-08, T-04: (pos, id, name, content, valid_at, entity_name, peer_name) by id, entities in the order first seen, oldest first."""
    named = F.array(F.struct((F.col("pos") * 2).alias("at"), F.col("entity_name").alias("n")), F.struct((F.col("pos") * 2 + 1).alias("at"), F.col("peer_name").alias("n")))
    d = rows.where("coalesce(id, '') <> ''")
    first = d.groupBy("id").agg(F.min_by(F.struct("name", "content", "valid_at"), "pos").alias("x"))
    title = F.coalesce(F.nullif(S.first_line(F.coalesce("x.content", F.lit(""))), F.lit("")), F.nullif("x.name", F.lit("")), F.lit("Untitled Episode"))
    top = first.orderBy(F.asc_nulls_first("x.valid_at"), "id").limit(limit).select("id", F.left(title, F.lit(200)).alias("title"), "x.valid_at")
    e = d.join(F.broadcast(top.select("id")), "id", "left_semi").select("id", F.inline(named)).where("coalesce(n, '') <> ''").groupBy("id", "n").agg(F.min("at").alias("at"))
    e = e.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "n"))), lambda s: s["n"]).alias("entities"))
    return top.join(e, "id", "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))


def update_severity(episodes: DataFrame, found: DataFrame) -> DataFrame:
    """X-12: the episodes with the severities of found (event_id, severity); unknown levels change nothing."""
    new = found.where(F.lower("severity").isin(*LEVELS)).groupBy("event_id").agg(F.max(F.lower("severity")).alias("_new"))
    return episodes.join(new, "event_id", "left").withColumn("severity", F.coalesce("_new", "severity")).drop("_new")


def without_edges_left(nodes: DataFrame, entities: DataFrame, kept: DataFrame) -> DataFrame:
    """X-11: nodes that only episodes which are gone have touched; nodes that none ever touched stay out."""
    touched = entities.join(kept.select("event_id"), "event_id", "left_semi").select("name")
    return nodes.join(entities.select("name"), "name", "left_semi").join(touched, "name", "left_anti")
