"""The pushed whitelist (API-6, IO-27): replaced as a whole, and never seen half-written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Snapshots

REQUIRED = ("ticker", "sector", "biz_code")
OPTIONAL = ("name", "exchange")
ENTRY = "ticker string, sector string, biz_code string, name string, exchange string, updated_at string, source string"


def push(rows: DataFrame, shots: Snapshots, now: Column, source: str = "push") -> DataFrame:
    """API-6: (status, count, timestamp): the rows become the whitelist, `ok` with how many there are.

    If a row lacks a ticker, sector or business code, nothing is written: `invalid` with how many do.  Empty texts are texts; names and
    exchanges that are null become empty; other columns are left out; no rows make an empty whitelist; repeated rows stay.  Times are
    of China's zone, to the second.
    """
    spark = rows.sparkSession
    stamp = F.concat(F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("Asia/Hong_Kong"), F.to_utc_timestamp(now, F.current_timezone()).cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00"))
    text = [F.col(c).cast("string").alias(c) for c in REQUIRED] + [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in OPTIONAL]
    d = rows.select(*text, stamp.alias("updated_at"), F.lit(source).alias("source"))
    lacking = d.where(" or ".join(f"{c} is null" for c in REQUIRED)).count()
    if lacking:
        return spark.range(1).select(F.lit("invalid").alias("status"), F.lit(lacking).cast("long").alias("count"), stamp.alias("timestamp"))
    shots.save(d)
    n = latest(spark, shots).agg(F.count("*").alias("count"), F.max("updated_at").alias("at"))
    return n.select(F.lit("ok").alias("status"), "count", F.coalesce("at", stamp).alias("timestamp"))


def latest(spark: SparkSession, shots: Snapshots) -> DataFrame:
    """The whitelist as last pushed, no rows before the first push."""
    return shots.latest(spark, spark.createDataFrame([], ENTRY).schema)
