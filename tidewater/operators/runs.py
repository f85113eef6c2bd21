"""Runs of sources: totals of cycles and batches, health, dry runs, what was written, and clean-up plans.

Every function aggregates by key with partial sums; no list grows with the runs, only with the number of sources.
Runs without a source count under null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocab

# The sources of `all`, and what health says of a source that never ran.
SOURCES = ["gdelt", "rss", "stock", "fred", "sanctions", "acled", "eia", "bls", "treasury", "china_macro"]
NEVER_RAN = "No pipeline runs recorded yet"


def sources(name: str | None = "all") -> list[str]:
    """IO-37: all of them, or the one named, known or not."""
    return list(SOURCES) if name in (None, "all") else [name]


def cycle_summary(runs: DataFrame, cycle: str) -> DataFrame:
    """A-18: runs (source, success, episodes) -> runs, episodes, failed, failed_sources and level of each cycle; a null success is a failure."""
    ok = F.coalesce(F.col("success"), F.lit(False))
    d = runs.groupBy(cycle).agg(
        F.count("*").alias("runs"), F.coalesce(F.sum("episodes"), F.lit(0)).alias("episodes"), F.count_if(~ok).alias("failed"),
        F.array_join(F.array_sort(F.collect_set(F.when(~ok, F.col("source")))), ", ").alias("failed_sources"))
    level = F.when(F.col("failed") == F.col("runs"), "all failed").when(F.col("failed") > 0, "partial").otherwise("ok")
    return d.withColumn("level", level)


def batch_totals(results: DataFrame, batch: str, status: str = "status") -> DataFrame:
    """A-18: total, ok, skipped and error of each batch; other statuses count in the total alone."""
    n = lambda s: F.count_if(F.coalesce(F.col(status) == s, F.lit(False)))
    return results.groupBy(batch).agg(F.count("*").alias("total"), n("ok").alias("ok"), n("skipped_duplicate").alias("skipped"), n("error").alias("error"))


def health(runs: DataFrame, now: Column, known: list[str] = ()) -> DataFrame:
    """A-21, API-5: (source, status, last_update, latency_minutes, error) of runs (source, at, pos, ok, error).

    The last success, else the last run, gives last_update and the whole minutes since; the error is that of the last failure,
    and only shown when failures followed the last success: none ok, one to five degraded, from six down.  Sources of `known` without runs
    are down as of now.  Runs of equal time stand in the order of pos.
    """
    at = F.struct("at", "pos")
    d = runs.select("source", "at", "pos", F.coalesce("ok", F.lit(False)).alias("ok"), "error")
    last = d.groupBy("source").agg(F.max(F.when(F.col("ok"), at)).alias("good"), F.max("at").alias("ran"), F.max_by("error", F.when(~F.col("ok"), at)).alias("why"))
    since = last.select(F.col("source").alias("of"), "good")
    streak = d.where("not ok").join(since, F.col("source").eqNullSafe(F.col("of"))).where(F.col("good").isNull() | (at > F.col("good"))).groupBy("of").agg(F.count("*").alias("streak"))
    d = last.join(streak, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("streak", F.coalesce("streak", F.lit(0)))
    seen = F.coalesce(F.col("good.at"), F.col("ran"), now)
    status = F.when(F.col("streak") >= 6, "down").when(F.col("streak") > 0, "degraded").otherwise("ok")
    minutes = F.floor((F.unix_micros(now) - F.unix_micros(seen)) / 60_000_000).cast("long")
    out = d.select("source", status.alias("status"), seen.alias("last_update"), minutes.alias("latency_minutes"), F.when(F.col("streak") > 0, F.col("why")).alias("error"))
    if not known:
        return out
    named = runs.sparkSession.createDataFrame([(n,) for n in known], "source string")
    absent = named.join(last.select("source"), "source", "left_anti")
    return out.unionByName(absent.select("source", F.lit("down").alias("status"), now.alias("last_update"), F.lit(0).cast("long").alias("latency_minutes"), F.lit(NEVER_RAN).alias("error")))


def dry_run_summary(runs: DataFrame) -> DataFrame:
    """IO-31: (source, fetched, filtered, normalized, seconds, errors) of each source and, as source TOTAL, of all.

    Counts are of runs that succeeded, seconds of all; a source none of whose runs succeeded has null counts.  Where nothing was counted
    as fetched, what was normalized counts.
    """
    ok = F.coalesce(F.col("success"), F.lit(False))
    fetched = F.coalesce(F.when(F.col("fetched") != 0, F.col("fetched")), F.col("episodes"))
    total = lambda c: F.sum(F.when(ok, F.coalesce(c, F.lit(0))))
    d = runs.groupBy("source").agg(
        total(fetched).alias("fetched"), total(F.col("filtered")).alias("filtered"), total(F.col("episodes")).alias("normalized"), F.sum("seconds").alias("seconds"), F.count_if(~ok).alias("errors"))
    # one row without any source too; the sums per source are shuffled once for both
    whole = d.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in d.columns[1:]])
    return d.unionByName(whole.select(F.lit("TOTAL").alias("source"), "*"))


def newly_written(results: DataFrame, seen: DataFrame) -> DataFrame:
    """X-16: hashes to append to `seen`: those written or found to be duplicates, once each.

    Failed rows aren't among them, so the next cycle takes them again.  Null and empty hashes never are.
    """
    done = results.where(F.col("status").isin("ok", "skipped_duplicate") & (F.col("content_hash") != "")).select("content_hash").distinct()
    return done.join(seen.select("content_hash"), "content_hash", "left_anti")


def leak_plan(nodes: DataFrame, key: str, properties: list[str]) -> DataFrame:
    """X-15: (key, property, old, new, action) for each text property with a leak marker: set what is left of it, or remove it if nothing is."""
    d = nodes.select(F.col(key), *[F.col(p).cast("string").alias(p) for p in properties]).unpivot(key, properties, "property", "old")
    d = d.where(F.col("old").rlike("(?is)(?:" + "|".join(vocab.LEAK_MARKERS) + ")")).withColumn("new", S.truncate_leaked(F.col("old")))
    return d.withColumn("action", F.when(F.col("new").isNull(), "removed").otherwise("set"))


def without_leaks(nodes: DataFrame, properties: list[str]) -> DataFrame:
    """X-15: the nodes as the plan leaves them; properties without a marker stay as they are."""
    marked = lambda p: F.col(p).rlike("(?is)(?:" + "|".join(vocab.LEAK_MARKERS) + ")")
    return nodes.withColumns({p: F.when(marked(p), S.truncate_leaked(F.col(p))).otherwise(F.col(p)) for p in properties})


def ticker_rows(raw: DataFrame) -> DataFrame:
    """IO-28: the six text columns of a pulled `tickers` array, empty where an entry lacks one.  Entries that are null count as empty ones."""
    names = ("symbol", "biz_code", "name_zh", "name_en", "sector", "exchange")
    d = raw.select(F.explode("tickers").alias("t"))
    return d.select(*[F.coalesce(F.col("t")[n].cast("string"), F.lit("")).alias(n) for n in names])


def repaired_reply(text: Column, fields: dict[str, str]) -> Column:
    """K-06: a model's JSON reply as a map of field to JSON text; fields: each required field with its default as JSON text.

    A list goes under the only field whose default is a list; a schema is unwrapped if its properties hold data, else all defaults; an object
    gets the fields it lacks; anything else is null.  Values that are texts come without quotes, nested ones as JSON.
    """
    as_map = lambda c: F.from_json(c, "map<string,string>")
    defaults = F.create_map(*[F.lit(x) for kv in fields.items() for x in kv])
    lists = [k for k, v in fields.items() if v.lstrip().startswith("[")]
    t = F.trim(text)
    whole = as_map(t)
    held = as_map(whole["properties"])
    first = F.get(F.map_values(held), F.lit(0))
    object_ = F.trim(first).startswith("{")
    schema = F.when(first.isNull() | (object_ & F.coalesce(F.map_contains_key(as_map(first), "type"), F.lit(False))), defaults).otherwise(held)
    filled = F.map_concat(whole, F.map_filter(defaults, lambda k, _: ~F.map_contains_key(whole, k)))
    wrapped = F.create_map(F.lit(lists[0]), t) if len(lists) == 1 else defaults
    is_schema = F.map_contains_key(whole, "properties") & F.map_contains_key(whole, "type")
    return F.when(t.startswith("["), wrapped).when(t.startswith("{") & is_schema, schema).when(t.startswith("{"), filled)


# Fixed values of the two texts below: stored answers are compared with them.
def impact_text(title: Column, sectors: Column) -> Column:
    """S-38: what a risk may do, where no model says it."""
    return F.concat(title, F.lit(" 可能对 "), F.array_join(sectors, ", "), F.lit(" 板块产生影响。"))


def risk_text(level: Column, score: Column, critical: Column, high: Column) -> Column:
    """S-38: the summary of an answer about risk."""
    n = lambda c: c.cast("string")
    return F.concat(
        F.lit("当前整体风险等级 "), level, F.format_string(" (risk_score=%.2f)。", F.bround(score, 2)), F.lit("监测到 "), n(critical), F.lit(" 条 critical 级别事件、"), n(high), F.lit(" 条 high 级别事件。建议关注高风险板块并调整防御仓位比例。"))


def entity_suffix(entities: Column) -> Column:
    """S-29: the block that lists an episode's entities (name, type, ticker, sector, exchange) after its body; empty without any."""
    def line(e: Column) -> Column:
        there = lambda c: F.coalesce(e[c], F.lit("")) != ""
        more = F.array_join(F.array_compact(F.array(F.when(there("sector"), F.concat(F.lit("sector="), e["sector"])), F.when(there("exchange"), F.concat(F.lit("exchange="), e["exchange"])))), "; ")
        extra = F.concat(e["ticker"], F.when(more != "", F.concat(F.lit(" ("), more, F.lit(")"))).otherwise(""))
        name = F.coalesce(e["name"], F.lit(""))
        return F.when((e["type"] == "stock") & there("ticker"), F.concat(F.lit("- Stock: "), name, F.lit(" ("), extra, F.lit(")"))).otherwise(F.concat(F.lit("- "), F.initcap(F.coalesce(e["type"], F.lit(""))), F.lit(": "), name))

    head = F.lit("\n[END OF CONTENT]\n\nPRE-EXTRACTED ENTITIES (for reference):\n")
    return F.when(F.coalesce(F.size(entities), F.lit(0)) <= 0, "").otherwise(F.concat(head, F.array_join(F.transform(entities, line), "\n")))


def sector_names(sectors: Column) -> Column:
    """S-30: the sectors (name, aliases) in one line, each with its first ASCII alias."""
    def one(s: Column) -> Column:
        plain = F.filter(s["aliases"], lambda a: F.rlike(a, F.lit(r"^[\x00-\x7F]*$")))
        return F.concat(s["name"], F.coalesce(F.concat(F.lit(" ("), F.get(plain, F.lit(0)), F.lit(")")), F.lit("")))

    return F.array_join(F.transform(sectors, one), ", ")


def extraction_rules(stock: Column, of_stocks: Column, of_others: Column, entities: Column) -> Column:
    """S-30: what a model is told beside a body: the caller's rules for stock or other sources, then the episode's own names, if it has any."""
    # Leaked rules are recognized by these headings (S-25).
    head = "\n\nENTITY RESOLUTION RULES:\n1. Use the canonical names listed below as the preferred forms for entity resolution\n2. Do NOT add or remove suffixes (Ltd, Inc, Corp, 控股, etc.)\n3. If the same entity appears with different names, use the FIRST name listed\n\nCANONICAL ENTITY NAMES:\n"
    name = lambda e: F.concat(F.lit("- "), F.coalesce(e["name"], F.lit("")), F.when(e["ticker"] != "", F.concat(F.lit(" ("), e["ticker"], F.lit(")"))).otherwise(""))
    own = F.concat(F.lit(head), F.array_join(F.transform(entities, name), "\n"))
    rules = F.when(stock, of_stocks).otherwise(of_others)
    return F.when(F.coalesce(F.size(entities), F.lit(0)) <= 0, rules).otherwise(F.concat(rules, own))
