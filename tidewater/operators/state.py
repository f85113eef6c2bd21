"""Durable queue as a status log: rows (content_hash, seq, status, attempts, owner, until, at); the last row of a key counts.

No row is changed in place: every operation returns rows to append, so a lost run can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vocab

LOG = "content_hash string, seq bigint, status string, attempts int, owner string, until timestamp, at timestamp"


def current(log: DataFrame) -> DataFrame:
    """W-06: latest status of each key."""
    rest = [c for c in log.columns if c not in ("content_hash", "seq")]
    return log.groupBy("content_hash").agg(F.max_by(F.struct("seq", *rest), "seq").alias("x")).select("content_hash", "x.*")


def _next(rows: DataFrame, status: Column, now: Column, attempts: Column | None = None, owner: Column | None = None, until: Column | None = None) -> DataFrame:
    return rows.select(
        "content_hash", (F.col("seq") + 1).alias("seq"), status.alias("status"), (F.col("attempts") if attempts is None else attempts).cast("int").alias("attempts"),
        (owner if owner is not None else F.lit(None)).cast("string").alias("owner"), (until if until is not None else F.lit(None)).cast("timestamp").alias("until"), now.alias("at"),
    )


def capture(batch: DataFrame, log: DataFrame, now: Column) -> DataFrame:
    """X-01: pending rows for keys not seen."""
    new = batch.select("content_hash").distinct().join(log.select("content_hash"), "content_hash", "left_anti")
    return _next(new.withColumns({"seq": F.lit(-1).cast("long"), "attempts": F.lit(0)}), F.lit("pending"), now)


def claim(log: DataFrame, captured: DataFrame, owner: str, now: Column, lease_seconds: int, n: int) -> DataFrame:
    """X-02, T-06: the n oldest pending."""
    rows = current(log).where("status = 'pending'").join(captured.select("content_hash", "captured_at"), "content_hash").orderBy("captured_at", "content_hash").limit(n)
    return _next(rows, F.lit("processing"), now, owner=F.lit(owner), until=now + F.make_dt_interval(secs=F.lit(lease_seconds)))


def finish(log: DataFrame, keys: DataFrame, owner: str, now: Column, status: str = "done") -> DataFrame:
    """X-03: only for the owner's rows in process."""
    return _next(current(log).where((F.col("status") == "processing") & (F.col("owner") == owner)).join(keys, "content_hash", "left_semi"), F.lit(status), now)


def fail(log: DataFrame, keys: DataFrame, now: Column, most: int, owner: str | None = None) -> DataFrame:
    """X-04: one attempt more; at the limit dead. Only the owner's rows, if one is given."""
    mine = (F.col("status") == "processing") & (F.lit(True) if owner is None else F.col("owner") == owner)
    rows = current(log).where(mine).join(keys, "content_hash", "left_semi")
    n = F.col("attempts") + 1
    return _next(rows, F.when(n >= most, "dead").otherwise("failed"), now, attempts=n)


def recover(log: DataFrame, now: Column) -> DataFrame:
    """X-05: expired or missing leases are pending again."""
    return _next(current(log).where((F.col("status") == "processing") & (F.col("until").isNull() | (F.col("until") < now))), F.lit("pending"), now)


def retry(log: DataFrame, now: Column, most: int) -> DataFrame:
    """X-06: failed rows whose back-off has passed; dead when they have no attempt left."""
    rows = current(log).where("status = 'failed'")
    due = now >= F.col("at") + F.make_dt_interval(secs=S.backoff(F.col("attempts")))
    return _next(rows.where((F.col("attempts") >= most) | due), F.when(F.col("attempts") >= most, "dead").otherwise("pending"), now)


def replay(log: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """X-09: pending again from zero."""
    return _next(current(log).join(keys, "content_hash", "left_semi"), F.lit("pending"), now, attempts=F.lit(0))


def retain(log: DataFrame, before: Column) -> DataFrame:
    """X-10: the log without keys that ended (done, skipped, dead) before the cut-off."""
    gone = current(log).where(F.col("status").isin("done", "skipped", "dead") & (F.col("at") < before)).select("content_hash")
    return log.join(gone, "content_hash", "left_anti")


def summary(status: DataFrame, retryable: Column) -> DataFrame:
    """A-02: all six statuses, zero-filled, with how many could be tried again."""
    every = status.sparkSession.createDataFrame([(s,) for s in vocab.STATUSES], "status string")
    n = status.groupBy("status").agg(F.count("*").alias("n"), F.count_if(retryable).alias("retryable"))
    return every.join(n, "status", "left").select("status", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n", "retryable")])
