"""The durable queue as a stream: one keyed state machine, with timers for leases and back-offs.

Commands are rows (content_hash, at, kind, owner, until).  capture makes a key pending; claim takes a pending one until its lease
ends; done, skip and fail count only from the owner while it is in process; replay and retry_dead put ended keys back.
A lease that has ended makes its key pending again just after its end, a failed key is pending again after its back-off or dead
when it has no attempt left.  Both happen at their own time, whether a timer or the key's next command finds
them, so the log is the same for every cut of the stream into batches.  Output: rows of the status log (state.LOG).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

COMMAND = "content_hash string, at timestamp, kind string, owner string, until timestamp"
ROW = "seq bigint, status string, attempts int, owner string, until bigint, at bigint"
OUT = f"content_hash string, {ROW}"
FIELDS = tuple(f.split()[0] for f in ROW.split(", "))
#: Rows of a slice, a column in each array: the store's client sends a type along with every value.
KEPT = ", ".join(f"{name} array<{kind}>" for name, kind in (f.split() for f in OUT.split(", ")))
#: Of commands of one instant, the order in which they count.
KINDS = ("capture", "replay", "retry_dead", "done", "skip", "fail", "claim")
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Seconds of the back-off.
BASE, MOST = 600, 6 * 3600
#: Slices of the keys. A checkpoint holds its rows by them, so another number needs a new one.
SLICES = 1024


def due(row: dict) -> int | None:
    """When a key changes by itself, in milliseconds."""
    if row["status"] == "processing":
        return (row["at"] if row["until"] is None else row["until"]) + 1
    if row["status"] == "failed":
        return row["at"] + 1000 * min(MOST, BASE * 2 ** row["attempts"])
    return None


def step(row: dict | None, kind: str, at: int, owner: str | None, until: int | None, most: int) -> dict | None:
    """The row after a command, None if it has no effect."""
    if kind == "capture":
        return {"seq": 0, "status": "pending", "attempts": 0, "owner": None, "until": None, "at": at} if row is None else None
    if row is None:
        return None
    new = {"seq": row["seq"] + 1, "attempts": row["attempts"], "owner": None, "until": None, "at": at}
    status, mine = row["status"], row["status"] == "processing" and row["owner"] == owner
    if kind == "claim" and status == "pending":
        return new | {"status": "processing", "owner": owner, "until": until}
    if kind in ("done", "skip") and mine:
        return new | {"status": "done" if kind == "done" else "skipped"}
    if kind == "fail" and mine:
        n = row["attempts"] + 1
        return new | {"status": "dead" if n >= most else "failed", "attempts": n}
    if kind == "replay" and status in ("done", "skipped") or kind == "retry_dead" and status == "dead":
        return new | {"status": "pending", "attempts": 0}
    return None


def lapse(row: dict | None, now: int) -> dict | None:
    """The row after its lease or back-off has ended by `now`, None if it hasn't."""
    at = due(row) if row else None
    if at is None or at > now:
        return None
    return {"seq": row["seq"] + 1, "status": "pending", "attempts": row["attempts"], "owner": None, "until": None, "at": at}


def first_due(rows: dict[str, dict]) -> int | None:
    """When the first of the rows changes by itself."""
    return min((end for row in rows.values() if (end := due(row)) is not None), default=None)


def order(command: tuple) -> tuple:
    """Of (content_hash, at, kind, owner, until): by key, then time, kind and owner; other kinds and missing owners last."""
    key, at, kind, owner, _ = command
    return key, at, KINDS.index(kind) if kind in KINDS else len(KINDS), owner is None, owner or ""


def _plain(commands: pd.DataFrame) -> list[tuple]:
    """The commands of a key and a time, nulls as None."""
    d = commands[commands["content_hash"].notna() & commands["at_ms"].notna()]
    none = lambda c: d[c].astype(object).where(d[c].notna(), None)
    return list(zip(d["content_hash"], d["at_ms"].astype("int64").tolist(), none("kind"), none("owner"), (None if v is None else int(v) for v in none("until_ms")), strict=True))


class QueueMachine(StatefulProcessor):
    """Rows and commands of one slice of the keys, with a timer at the first time at which one of its rows changes by itself.

    What a batch asks of Python and of the state store, but for the rows themselves, grows with the slices and not with the keys.
    """

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("rows", KEPT)

    def _rows(self) -> dict[str, dict]:
        found = self.state.get()
        return {} if found is None else {key: dict(zip(FIELDS, row, strict=True)) for key, *row in zip(*found, strict=True)}

    def _keep(self, rows: dict[str, dict], log: list[tuple[str, dict]]) -> pd.DataFrame:
        flat = lambda pairs: [(key, *(row[f] for f in FIELDS)) for key, row in pairs]
        self.state.update(tuple(map(list, zip(*flat(rows.items()), strict=True))))
        return pd.DataFrame(flat(log), columns=["content_hash", *FIELDS]).astype({"until": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        commands = sorted((c for d in rows for c in _plain(d)), key=order)
        if not commands:
            return
        kept, log = self._rows(), []
        timer = first_due(kept)
        for h, at, kind, owner, until in commands:
            if (row := lapse(kept.get(h), at)) is not None:
                kept[h] = row
                log.append((h, row))
            if (row := step(kept.get(h), kind, at, owner, until, self.most)) is not None:
                kept[h] = row
                log.append((h, row))
        if not log:
            return
        if (new := first_due(kept)) != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if new is not None:
                self.handle.registerTimer(new)
        yield self._keep(kept, log)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept, log = self._rows(), []
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        for h, before in kept.items():
            if (row := lapse(before, now)) is not None:
                log.append((h, row))
        kept.update(log)
        if (new := first_due(kept)) is not None:
            self.handle.registerTimer(new)
        if log:
            yield self._keep(kept, log)

    def close(self) -> None:
        pass


def run_machine(commands: DataFrame, most: int = 3, late: str = "1 minute") -> DataFrame:
    """X-02 to X-06 as a stream of log rows. Needs the RocksDB state store; commands older than `late` behind the newest are dropped.

    A row without a content_hash only moves the time on; one without a time does nothing.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the stream's own runner doesn't read files added to the session
    ms = lambda c: F.unix_millis(F.col(c))
    piece = F.pmod(F.xxhash64("content_hash"), F.lit(SLICES)).alias("slice")
    d = commands.withWatermark("at", late).select(piece, "content_hash", "at", "kind", "owner", ms("at").alias("at_ms"), ms("until").alias("until_ms"))
    out = d.groupBy("slice").transformWithStateInPandas(QueueMachine(most), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
    time = lambda c: F.timestamp_millis(F.col(c)).alias(c)
    return out.select("content_hash", "seq", "status", "attempts", "owner", time("until"), time("at"))


def run_queue(commands: DataFrame, checkpoint: str, log: str, most: int = 3, late: str = "1 minute") -> DataFrame:
    """All commands there are now, then stop; the log so far. Running it again goes on from the checkpoint."""
    spark: SparkSession = commands.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key, None)
    spark.conf.set(key, PROVIDER)
    try:
        out = run_machine(commands, most, late)
        out.writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, was) if was else spark.conf.unset(key)
    return spark.read.schema(out.schema).parquet(log)
