"""Tables that are changed in place: merge by key, and snapshots of the last good result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one in the warehouse where it is unset.

    A folder of one machine is refused unless the session runs on it alone.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (found or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch").rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, written once to the shared folder and read back, so that its lineage ends there."""
    path = f"{scratch(df.sparkSession)}/tidewater/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upsert(spark: SparkSession, path: str, new: DataFrame, key: list[str], part: str) -> DataFrame:
    """Replaces rows of equal keys, which are unique in `new`, in a table partitioned by `part`, a column of the key or a function of it.

    Only partitions that `new` touches are rewritten.  Doing it again changes nothing.  The table as it is then.
    """
    spark.createDataFrame([], new.schema).write.mode("append").partitionBy(part).parquet(path)
    old = spark.read.schema(new.schema).parquet(path)
    others = old.join(new.select(part).distinct(), part, "left_semi").join(new.select(*key), key, "left_anti")
    both = others.unionByName(new)
    both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    return spark.read.schema(new.schema).parquet(path)


class Snapshots:
    """The last good result, kept as numbered runs; an earlier one stays until a later one is whole."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _runs(self, spark: SparkSession) -> list[int]:
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path + "/run=*/_SUCCESS")
        found = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(root) or ()
        return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found)

    def save(self, df: DataFrame) -> None:
        df.write.parquet(f"{self.path}/run={(self._runs(df.sparkSession) or [0])[-1] + 1}")

    def latest(self, spark: SparkSession, schema) -> DataFrame:
        """The newest whole run, no rows if there is none."""
        runs = self._runs(spark)
        return spark.read.schema(schema).parquet(f"{self.path}/run={runs[-1]}") if runs else spark.createDataFrame([], schema)


def with_fallback(events: DataFrame, gkg: DataFrame, cached: DataFrame) -> DataFrame:
    """J-19, F-25: rows of the first of events, gkg and cached that has any, with `tier` 1 to 3 and `degraded` from the second on.

    Columns that one of them lacks are null.
    """
    tiers = [d.withColumns({"tier": F.lit(i), "degraded": F.lit(i > 1)}) for i, d in enumerate((events, gkg, cached), 1)]
    every = tiers[0].unionByName(tiers[1], allowMissingColumns=True).unionByName(tiers[2], allowMissingColumns=True)
    best = every.agg(F.min("tier").alias("best"))
    name = next(n for n in ("best_tier", "best_tier_", "best_tier__") if n not in every.columns)
    return every.join(F.broadcast(best.withColumnRenamed("best", name)), F.col("tier") == F.col(name)).drop(name)  # one row


def fetch_or_last_good(events: DataFrame, gkg: DataFrame, snapshots: Snapshots) -> DataFrame:
    """J-19: as with_fallback over the last snapshot; a result that isn't from the snapshot becomes the next one."""
    spark, columns = events.sparkSession, events.columns + [c for c in gkg.columns if c not in events.columns]
    fresh = events.unionByName(gkg, allowMissingColumns=True)
    found = with_fallback(events, gkg, snapshots.latest(spark, fresh.schema))
    if not found.where("tier < 3").isEmpty():
        snapshots.save(found.select(*columns))
        tier = found.select("tier", "degraded").limit(1)
        return snapshots.latest(spark, fresh.schema).join(F.broadcast(tier), how="cross")  # one row
    return found
