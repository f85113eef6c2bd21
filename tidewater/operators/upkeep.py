"""Upkeep of the queue (API-8): statistics, replays, dead rows, and the index rebuilt from landed files.

`index` are the registered rows (sources.register.INDEX), `log` their states (operators.state.LOG).  Nothing is changed in
place: every operation gives rows to append, and gives none when it is run again on what it has done.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import state as Q

DAYS = 30


def moment(text: str, end: bool = False) -> dt.datetime:
    """D-10: a day or ISO time, UTC unless it says otherwise; as an end, a day counts whole.  ValueError for anything else."""
    at = dt.datetime.fromisoformat(text.strip())
    at = at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)
    return at + dt.timedelta(days=1) if end and re.fullmatch(r"\d{4}-\d{2}-\d{2}", text.strip()) else at


def states(index: DataFrame, log: DataFrame) -> DataFrame:
    """Registered rows with the status that the log tells, or that of the index where it tells none."""
    now = Q.current(log).select("content_hash", F.col("status").alias("told"))
    return index.join(now, "content_hash", "left").withColumn("status", F.coalesce("told", "status")).drop("told")


def stats(index: DataFrame, log: DataFrame) -> DataFrame:
    """A-01: (kind, value, n) by status, source and day of capture (the newest 30), and in total; one pass over the states.  An empty index gives no rows."""
    d = states(index, log).select("status", "source_type", F.date_format("captured_at", "yyyy-MM-dd").alias("day"))
    kinds = {"status": 0b011, "source_type": 0b101, "day": 0b110}
    n = d.groupingSets([["status"], ["source_type"], ["day"], []], "status", "source_type", "day").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    kind = F.coalesce(*[F.when(F.col("g") == g, name) for name, g in kinds.items()], F.lit("total"))
    n = n.select(kind.alias("kind"), F.coalesce("status", "source_type", "day").alias("value"), "n")
    w = Window.partitionBy("kind").orderBy(F.desc_nulls_last("value"))  # days: one row each
    return n.withColumn("nth", F.row_number().over(w)).where((F.col("kind") != "day") | (F.col("nth") <= DAYS)).drop("nth")


def replay(index: DataFrame, log: DataFrame, now: Column, since: Column | None = None, until: Column | None = None, source: str | None = None) -> DataFrame:
    """X-09, F-20: done and skipped rows captured in [since, until), of one source if given, pending again from zero.  A row without a time of capture is in no range."""
    d = states(index, log).where(F.col("status").isin("done", "skipped"))
    for c in (None if since is None else F.col("captured_at") >= since, None if until is None else F.col("captured_at") < until, None if source is None else F.col("source_type") == source):
        d = d if c is None else d.where(c)
    return Q.replay(log, d.select("content_hash"), now)


def retry_dead(log: DataFrame, now: Column) -> DataFrame:
    """X-09: dead rows, pending again from zero."""
    return Q.replay(log, Q.current(log).where("status = 'dead'").select("content_hash"), now)


def missing_states(index: DataFrame, log: DataFrame, now: Column) -> DataFrame:
    """X-01: pending rows for registered keys that the log lacks, so that a rebuild cut off between index and log can be repeated."""
    return Q.capture(index.where("status = 'pending'"), log, now)
