"""Sector briefings that are rebuilt only where their events changed (API-3, API-7).

items: sector, event_id, title, severity, first_seen, last_updated, source_count, summary, tickers, keywords, created_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import upsert
from .relational import least_per

# How many events a briefing is built of, of how many words, and what its lines say.
EVENTS, WORDS = 20, 5
ICONS = {"critical": "🔴", "high": "🟠", "medium": "🟡", "low": "🟢"}
NO_ICON, NO_TITLE, NO_SUMMARY = "⚪", "无标题", "无"

CACHE = "sector string, fingerprint string, briefing string, generated_at timestamp, bucket int"
BUCKETS = 64


def _event_text(e: Column) -> Column:
    icon = F.lit(NO_ICON)
    for level, sign in ICONS.items():
        icon = F.when(e["severity"] == level, sign).otherwise(icon)
    t = lambda c: e[c].cast("string")
    listed = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ", ")
    return F.concat(
        F.lit("### ["), icon, F.lit("] "), F.coalesce(t("title"), F.lit(NO_TITLE)), F.lit("\n- 严重级别: "), F.coalesce(t("severity"), F.lit("unknown")),
        F.lit("\n- 时间: "), F.coalesce(t("first_seen"), F.lit("?")), F.lit(" ~ "), F.coalesce(t("last_updated"), F.lit("?")), F.lit("\n- 信源数: "), F.coalesce(t("source_count"), F.lit("0")),
        F.lit("\n- 摘要: "), F.coalesce(t("summary"), F.lit(NO_SUMMARY)), F.lit("\n- 受影响标的: "), listed(e["tickers"]), F.lit("\n- 关键词: "), listed(F.slice(e["keywords"], 1, WORDS)), F.lit("\n"),
    )


def briefings(items: DataFrame) -> DataFrame:
    """(sector, fingerprint, briefing) of each sector's newest EVENTS events; at most so many rows of a sector meet in one group.

    The fingerprint is of `event_id:last_updated` in the order of ids (A-17).
    """
    top = least_per(items, ["sector"], [F.desc_nulls_last("created_at"), "event_id"], EVENTS)
    shown = F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("age"), "event_id", "title", "severity", "first_seen", "last_updated", "source_count", "summary", "tickers", "keywords")
    d = top.groupBy("sector").agg(F.array_sort(F.collect_list(shown)).alias("e"))
    key = F.array_sort(F.transform("e", lambda e: F.struct(e["event_id"].cast("string").alias("i"), e["last_updated"].cast("string").alias("u"))))
    digest = F.left(F.sha2(F.array_join(F.transform(key, lambda x: F.concat(x["i"], F.lit(":"), x["u"])), "|"), 256), F.lit(16))
    n_tickers = F.size(F.array_distinct(F.flatten(F.transform("e", lambda e: F.coalesce(e["tickers"], F.array().cast("array<string>"))))))
    text = F.concat(
        F.lit("## 行业: "), "sector", F.lit("\n## 统计: 总事件 "), F.size("e").cast("string"), F.lit(" 个, 涉及 "), n_tickers.cast("string"), F.lit(" 只标的\n\n## 事件列表:\n\n"), F.array_join(F.transform("e", _event_text), "\n"))
    return d.select("sector", digest.alias("fingerprint"), text.alias("briefing"))


def changed(fresh: DataFrame, cache: DataFrame) -> DataFrame:
    """Briefings whose fingerprint the cache doesn't have for their sector."""
    return fresh.join(cache.select("sector", "fingerprint"), ["sector", "fingerprint"], "left_anti")


def refresh(spark: SparkSession, path: str, items: DataFrame, now: Column, write: Column | None = None) -> DataFrame:
    """API-7: rewrites the cached briefings of sectors whose events changed, and returns these; a sector without events keeps its own.

    write: what a briefing says, made of `briefing`, which lists the events; by default that list.  With nothing changed, nothing is written.
    """
    empty = spark.createDataFrame([], CACHE)
    empty.write.mode("append").partitionBy("bucket").parquet(path)
    new = changed(briefings(items), spark.read.schema(CACHE).parquet(path))
    bucket = F.pmod(F.xxhash64("sector"), F.lit(BUCKETS)).cast("int")
    new = new.select("sector", "fingerprint", (F.col("briefing") if write is None else write).alias("briefing"), now.alias("generated_at"), bucket.alias("bucket"))
    if new.isEmpty():
        return empty
    upsert(spark, path, new, ["bucket", "sector"], "bucket")
    return spark.read.schema(CACHE).parquet(path).where(F.col("generated_at") == now)


def cached(spark: SparkSession, path: str, sector: str) -> DataFrame:
    """API-3: the briefing of a sector, no row if there is none."""
    return spark.read.schema(CACHE).parquet(path).where(F.col("sector") == sector).select("sector", "briefing", "generated_at")
