"""API-8: upkeep of a queue from the command line, as `spark-submit` or `python -m tidewater` run it.

    python -m tidewater --stats --queue QUEUE
    python -m tidewater --replay --since 2024-01-05 --until 2024-01-10 --source rss --queue QUEUE
    python -m tidewater --rebuild-index --landed LANDED --queue QUEUE

QUEUE is a folder that all executors share, with the tables `log`, `index` and `runs`.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .operators import state as Q
from .operators import upkeep as U
from .sources import register as G


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tidewater", description="Upkeep of a durable queue.")
    p.add_argument("--queue", required=True, help="folder of the tables log, index and runs")
    p.add_argument("--landed", help="folder of landed JSON lines, for --rebuild-index")
    mode = p.add_mutually_exclusive_group(required=True)
    mode.add_argument("--stats", action="store_true", help="counts by status, source and day")
    mode.add_argument("--replay", action="store_true", help="done and skipped rows of the range are pending again")
    mode.add_argument("--replay-all", action="store_true", help="all done and skipped rows are pending again; the range is ignored")
    mode.add_argument("--retry-dead", action="store_true", help="dead rows are pending again, without attempts")
    mode.add_argument("--rebuild-index", action="store_true", help="register all landed files; known rows keep their status")
    p.add_argument("--source", default="all")
    p.add_argument("--since", help="a day or ISO time, UTC")
    p.add_argument("--until", help="a day, which counts whole, or ISO time, UTC")
    a = p.parse_args(args)
    if a.rebuild_index and not a.landed:
        p.error("--rebuild-index needs --landed")
    try:
        a.since, a.until = (text and U.moment(text, end) for text, end in ((a.since, False), (a.until, True)))
    except ValueError as e:
        p.error(str(e))
    return a


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, which is laid down without rows if it isn't there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        spark.createDataFrame([], schema).write.mode("append").parquet(path)
        return spark.read.schema(schema).parquet(path)


def run(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """What the mode has done: (kind, value, n) of --stats, else (what, n)."""
    base, now = a.queue.rstrip("/"), F.current_timestamp()
    log, index = _table(spark, f"{base}/log", Q.LOG), _table(spark, f"{base}/index", G.INDEX)
    if a.stats:
        return U.stats(index, log)
    if a.rebuild_index:
        new, runs = G.register(G.landed_lines(spark, a.landed), index, now)
        new.write.mode("append").parquet(f"{base}/index")
        G.upsert_runs(spark, f"{base}/runs", runs)
        rows = U.missing_states(spark.read.schema(G.INDEX).parquet(f"{base}/index"), log, now)
    elif a.retry_dead:
        rows = U.retry_dead(log, now)
    else:
        since, until = (None if at is None or a.replay_all else F.lit(at) for at in (a.since, a.until))
        rows = U.replay(index, log, now, since, until, None if a.replay_all or a.source == "all" else a.source)
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(f"{base}/log")
    return spark.createDataFrame([("pending", seen.get["n"])], "what string, n bigint")


def main(args: list[str] | None = None) -> int:
    a = arguments(args)
    run(SparkSession.builder.appName("tidewater-upkeep").getOrCreate(), a).show(200, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
