"""Counts taken beside the data, without a second pass: skipped rows, and the queue's level with an alert (F-12, §2.11)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def fetched_only(df: DataFrame, fetched: Column, seen: Observation) -> DataFrame:
    """F-12: rows whose text was fetched; `seen` tells kept and skipped once they have been written."""
    ok = F.coalesce(fetched, F.lit(False))
    return df.observe(seen, F.count_if(ok).alias("kept"), F.count_if(~ok).alias("skipped")).where(ok)


def with_level(stream: DataFrame, name: str = "queue") -> DataFrame:
    """A stream of log rows that reports, of each batch, by how many its pending rows grow: those that become pending less those that leave."""
    grown = F.count_if(F.col("status") == "pending") - F.count_if(F.col("status") == "processing")
    return stream.observe(name, grown.alias("pending"))


class HighWater(StreamingQueryListener):
    """Back-pressure: adds up the levels of a stream's batches and calls `alert` when they reach the mark, once until they fall below it."""

    def __init__(self, mark: int, alert: Callable[[int], None], name: str = "queue"):
        self.mark, self.alert, self.name, self.pending, self.told = mark, alert, name, 0, False

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is None:
            return
        self.pending += row["pending"]
        if self.pending >= self.mark and not self.told:
            self.alert(self.pending)
        self.told = self.pending >= self.mark

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
