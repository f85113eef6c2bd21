"""Landing as a stream: file source, dedup by content hash, idempotent append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The table's partitions: by so many first characters of the hash.
PREFIX, PART = 2, "digest_prefix"


def deduplicated(stream: DataFrame, digest: str, at: str | None = None, late: str = "14 days") -> DataFrame:
    """First row of each hash; with an event time the state is bounded by the age window."""
    if at is None:
        return stream.dropDuplicates([digest])
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([digest])


def append_new(path: str, digest: str):
    """foreachBatch sink: appends hashes that the table doesn't have; a repeated batch adds nothing.

    The table is partitioned by the hash's first PREFIX characters, and of it only the partitions of the batch's hashes are read.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([digest]).withColumn(PART, F.left(F.col(digest), F.lit(PREFIX)))
        parts = [r[0] for r in new.select(PART).distinct().collect()]  # so many values that PREFIX hexadecimal signs have
        old = spark.read.schema(new.schema).parquet(path).where(F.col(PART).isin(parts)).select(digest)
        new.join(old, digest, "left_anti").write.mode("append").partitionBy(PART).parquet(path)

    return write


def run_available(stream: DataFrame, checkpoint: str, target: str, digest: str) -> DataFrame:
    """All that is there now, then stop; the table so far."""
    spark: SparkSession = stream.sparkSession
    schema = stream.withColumn(PART, F.lit("")).schema
    spark.createDataFrame([], schema).write.mode("append").partitionBy(PART).parquet(target)
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(append_new(target, digest)).start().awaitTermination()
    return spark.read.schema(schema).parquet(target).select(*stream.columns)


def hourly(stream: DataFrame, at: str, key: str, late: str = "1 day") -> DataFrame:
    """Counts by hour and key, final once the watermark has passed."""
    return stream.withWatermark(at, late).groupBy(F.window(at, "1 hour"), key).agg(F.count("*").alias("n"))
